"""Route calibration: every recommendation threshold from the route's own history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.config import Clamps, Splits, SPLITS
from vanflow.functions.numeric import clamp, percentiles_by_key, py_round
from vanflow.operators.pairs import item_pair_counts
from vanflow.session import small_side

CORPUS_FIELDS = (
    "frequency_floor", "dormancy_days", "qty_benchmark", "completion_gate",
    "basket_min_confidence", "recency_half_life_days",
)
TIERS = (("must_stock", 0.90), ("should_stock", 0.75), ("consider", 0.50), ("monitor", 0.25))


def route_windows(history: DataFrame, c: Clamps) -> DataFrame:
    """Trailing window per route; routes with too few days or customers use all history."""
    days = int(min(max(c.window_days, c.window_bounds[0]), c.window_bounds[1]))
    ends = history.groupBy("RouteCode").agg(F.max("TrxDate").alias("window_end"))
    start = F.date_sub("window_end", days)
    inside = history.join(ends, "RouteCode").filter(F.col("TrxDate") >= start)
    counted = inside.groupBy("RouteCode", "window_end").agg(
        F.countDistinct("TrxDate").alias("window_days"),
        F.countDistinct("CustomerCode").alias("window_customers"),
    )
    return counted.select(
        "RouteCode", start.alias("window_start"), "window_end", "window_days", "window_customers",
        (
            (F.col("window_days") < c.fallback_min_days)
            | (F.col("window_customers") < c.fallback_min_customers)
        ).alias("fallback"),
    )


def windowed_history(history: DataFrame, windows: DataFrame) -> DataFrame:
    bounds = windows.select("RouteCode", "window_start", "fallback")
    return (
        history.join(bounds, "RouteCode")
        .filter(F.col("fallback") | (F.col("TrxDate") >= F.col("window_start")))
        .drop("window_start", "fallback")
    )


def active_customers(history: DataFrame) -> DataFrame:
    return history.groupBy("RouteCode").agg(
        F.countDistinct("CustomerCode").alias("active_customers")
    )


def corpus_median_customers(history: DataFrame) -> DataFrame:
    """Median number of active customers over the routes, on full history."""
    return active_customers(history).agg(
        F.percentile(F.col("active_customers").cast("double"), 0.5).alias("corpus_median_customers")
    )


def visit_days(history: DataFrame) -> DataFrame:
    """Distinct visit days per customer."""
    return history.select("RouteCode", "CustomerCode", "TrxDate").distinct()


def visit_gaps(history: DataFrame) -> DataFrame:
    """Days between successive visits of a customer."""
    w = Window.partitionBy("RouteCode", "CustomerCode").orderBy("TrxDate")
    gap = F.datediff("TrxDate", F.lag("TrxDate").over(w))
    return visit_days(history).withColumn("gap", gap).filter(F.col("gap").isNotNull())


def item_frequencies(windowed: DataFrame) -> DataFrame:
    """Share of a customer's visits that include the item."""
    visits = visit_days(windowed).groupBy("RouteCode", "CustomerCode").agg(
        F.count(F.lit(1)).alias("visits")
    )
    items = windowed.groupBy("RouteCode", "CustomerCode", "ItemCode").agg(
        F.countDistinct("TrxDate").alias("item_visits")
    )
    return items.join(visits, ["RouteCode", "CustomerCode"]).withColumn(
        "frequency", F.col("item_visits") / F.col("visits")
    )


def raw_frequency_floor(windowed: DataFrame) -> DataFrame:
    return percentiles_by_key(
        item_frequencies(windowed), ["RouteCode"], "frequency", {"freq_p25": 0.25}
    )


def sparsity_factor(active: Column, corpus_median: Column, c: Clamps) -> Column:
    """Relief for routes with few customers against the corpus median."""
    share = active / corpus_median
    t = F.greatest(F.lit(0.0), share / c.sparse_customer_ratio)
    relieved = c.sparse_relief + (1.0 - c.sparse_relief) * t
    return F.when(
        (corpus_median > 0) & (share < c.sparse_customer_ratio), relieved
    ).otherwise(F.lit(1.0))


def frequency_floor(raw: Column, factor: Column, c: Clamps) -> Column:
    return F.coalesce(clamp(raw * factor, c.freq_floor), F.lit(c.freq_floor[0]))


def dormancy_days(windowed: DataFrame, c: Clamps) -> DataFrame:
    """P95 of each customer's longest gap between visits."""
    longest = visit_gaps(windowed).groupBy("RouteCode", "CustomerCode").agg(
        F.max("gap").cast("double").alias("gap")
    )
    p = percentiles_by_key(longest, ["RouteCode"], "gap", {"gap_p95": 0.95})
    return p.select(
        "RouteCode", "gap_p95",
        clamp("gap_p95", c.dormancy_days).cast("int").alias("dormancy_days"),
    )


def qty_benchmark(windowed: DataFrame, c: Clamps) -> DataFrame:
    """P90 of the items' mean quantities."""
    means = windowed.groupBy("RouteCode", "ItemCode").agg(F.avg("TotalQuantity").alias("mean_qty"))
    p = percentiles_by_key(means, ["RouteCode"], "mean_qty", {"qty_p90": 0.90})
    return p.select(
        "RouteCode", "qty_p90", clamp("qty_p90", c.qty_benchmark).alias("qty_benchmark")
    )


def tier_cuts(windowed: DataFrame, c: Clamps) -> DataFrame:
    """Percentiles of the average-rank percentile of purchase counts.

    Ranks come from the histogram of counts, which stays small however many
    pairs a route has.
    """
    counts = windowed.groupBy("RouteCode", "CustomerCode", "ItemCode").agg(
        F.count(F.lit(1)).alias("n")
    )
    hist = counts.groupBy("RouteCode", "n").agg(F.count(F.lit(1)).alias("pairs"))
    below = Window.partitionBy("RouteCode").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("pairs").over(Window.partitionBy("RouteCode"))
    rank = F.coalesce(F.sum("pairs").over(below), F.lit(0)) + (F.col("pairs") + 1) / 2
    ranked = hist.withColumn("rank_pct", rank / total * 100)
    bounds = (c.tier_must, c.tier_should, c.tier_consider, c.tier_monitor)
    return ranked.groupBy("RouteCode").agg(
        *[
            clamp(F.percentile("rank_pct", p, F.col("pairs")), b).alias(f"tier_{name}")
            for (name, p), b in zip(TIERS, bounds)
        ]
    )


def median_cycle(windowed: DataFrame) -> DataFrame:
    """Whole-day median of the customers' gaps between visits."""
    gaps = visit_gaps(windowed).filter(F.col("gap") > 0).withColumn("gap", F.col("gap").cast("double"))
    p = percentiles_by_key(gaps, ["RouteCode"], "gap", {"_m": 0.5})
    return p.select("RouteCode", F.col("_m").cast("int").alias("median_cycle"))


def completion_gate(cycle: Column, c: Clamps) -> Column:
    return F.when(cycle > 1, clamp(1.0 - 1.0 / cycle, c.completion_gate)).otherwise(
        F.lit(c.completion_gate[1])
    )


def recency_half_life(cycle: Column, c: Clamps) -> Column:
    return F.when(cycle > 0, clamp(cycle * 3.0, c.half_life)).otherwise(F.lit(c.half_life[0]))


def pair_confidences(purchases: DataFrame, splits: Splits = SPLITS) -> DataFrame:
    """P(item | anchor) over customers, for anchors with three buyers and two in common."""
    counts = item_pair_counts(purchases, splits=splits, min_both=2)
    return counts.filter(F.col("buyers") >= 3).withColumn(
        "confidence", F.col("both") / F.col("buyers")
    )


def basket_min_confidence(windowed: DataFrame, c: Clamps, splits: Splits = SPLITS) -> DataFrame:
    p = percentiles_by_key(
        pair_confidences(windowed, splits), ["RouteCode"], "confidence", {"conf_p60": 0.60}
    )
    return p.select(
        "RouteCode", "conf_p60", clamp("conf_p60", c.basket_confidence).alias("basket_min_confidence")
    )


def peer_limits(active: Column, benchmark: Column, c: Clamps) -> dict[str, Column]:
    return {
        "peer_k": clamp(F.sqrt(F.greatest(active, F.lit(1)).cast("double")), c.peer_k).cast("int"),
        "peer_floor": F.lit(c.peer_floor[0]),
        "peer_max": clamp(benchmark / max(1.0, c.peer_max_divisor), c.peer_max).cast("int"),
    }


def sanity_clamp(calibration: DataFrame, corpus: DataFrame, c: Clamps) -> DataFrame:
    """Pull fields more than z deviations from the corpus of routes to its P95.

    The corpus is one row per route; its moments come back as scalar values.
    Fewer than five routes, or no spread, leave the field alone.
    """
    stats = corpus.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            *[
                f
                for name in CORPUS_FIELDS
                for f in (
                    F.avg(name).alias(f"{name}_mean"),
                    F.stddev_pop(name).alias(f"{name}_std"),
                    F.percentile(F.col(name).cast("double"), c.sanity_percentile).alias(f"{name}_cap"),
                )
            ],
        ).alias("s")
    )
    out = calibration.withColumn("_s", stats.scalar())
    fixed = {}
    for name in CORPUS_FIELDS:
        value = F.col(name).cast("double")
        mean, std, cap = (F.col(f"_s.{name}_{k}") for k in ("mean", "std", "cap"))
        odd = (F.col("_s.n") >= 5) & (std > 0) & (F.abs(value - mean) / std > c.sanity_z)
        new = F.when(odd, cap).otherwise(value)
        fixed[name] = py_round(new).cast("int") if name == "dormancy_days" else new
    return out.withColumns(fixed).drop("_s")


def classify_tier(score: Column) -> Column:
    branches = None
    for name, _ in TIERS:
        cond = score >= F.col(f"tier_{name}")
        label = {"must_stock": "MUST_STOCK", "should_stock": "SHOULD_STOCK",
                 "consider": "CONSIDER", "monitor": "MONITOR"}[name]
        branches = F.when(cond, label) if branches is None else branches.when(cond, label)
    return branches.otherwise("EXCLUDE")


def base_calibration(history: DataFrame, windowed: DataFrame, windows: DataFrame,
                     c: Clamps, splits: Splits = SPLITS) -> DataFrame:
    """Unclamped-by-corpus thresholds, one row per route."""
    parts = [
        windows,
        active_customers(windowed),
        raw_frequency_floor(windowed),
        dormancy_days(windowed, c),
        qty_benchmark(windowed, c),
        tier_cuts(windowed, c),
        median_cycle(windowed),
        basket_min_confidence(windowed, c, splits),
    ]
    out = reduce(lambda a, b: a.join(b, "RouteCode", "left"), parts)
    middle = min(max(0.5, c.basket_confidence[0]), c.basket_confidence[1])
    cycle = F.coalesce("median_cycle", F.lit(0))
    return (
        out.withColumn("median_cycle", cycle)
        .withColumn("dormancy_days", F.coalesce("dormancy_days", F.lit(c.dormancy_days[0])))
        .withColumn("basket_min_confidence", F.coalesce("basket_min_confidence", F.lit(middle)))
        .withColumn("frequency_floor", frequency_floor(F.col("freq_p25"), F.lit(1.0), c))
        .withColumn("completion_gate", completion_gate(F.col("median_cycle"), c))
        .withColumn("recency_half_life_days", recency_half_life(F.col("median_cycle"), c))
        .withColumns(peer_limits(F.col("active_customers"), F.col("qty_benchmark"), c))
    )


def calibrate(history: DataFrame, c: Clamps, splits: Splits = SPLITS, materialise=None) -> DataFrame:
    """Calibrated thresholds of all routes.

    ``materialise`` (for instance a reliable checkpoint) is applied to the
    windowed history, which every threshold reads, and to the one-row-per-route
    base pass, which the corpus clamp reads twice.
    """
    windows = route_windows(history, c)
    windowed = windowed_history(history, windows)
    if materialise is not None:
        windows = small_side(materialise(windows))
        windowed = materialise(windowed_history(history, windows))
    base = base_calibration(history, windowed, windows, c, splits)
    base = base.join(
        active_customers(history).withColumnRenamed("active_customers", "history_customers"),
        "RouteCode", "left",
    )
    if materialise is not None:
        base = materialise(base)
    median = base.agg(F.percentile(F.col("history_customers").cast("double"), 0.5)).scalar()
    factor = sparsity_factor(F.col("active_customers"), F.col("_median"), c)
    adjusted = base.withColumn("_median", median).withColumn(
        "frequency_floor", frequency_floor(F.col("freq_p25"), factor, c)
    ).drop("_median")
    return sanity_clamp(adjusted, base, c)
