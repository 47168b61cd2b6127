"""Scores of customer-item pairs at a target date.

A pair's visit dates and lines fit one row: distinct dates are bounded by the
calendar. All measures are array expressions over that row, so the history is
shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanflow.config import Clamps
from vanflow.functions.numeric import py_round

PAIR = ("RouteCode", "CustomerCode", "ItemCode")
TINY = 1e-9

# ratio of recent to usual cycle, below which the label and factor apply
TREND_BANDS = (
    (0.8, False, "ACCELERATING_FAST", 1.30),
    (0.9, False, "ACCELERATING", 1.15),
    (1.1, True, "STABLE", 1.00),
    (1.2, True, "DECLINING", 0.85),
)
TREND_LAST = ("DECLINING_FAST", 0.70)
# coefficient of variation up to which the quality and label apply
QUALITY_BANDS = ((0.3, 1.0, "consistent"), (0.7, 0.7, "moderate"), (1.0, 0.4, "erratic"))
QUALITY_LAST = (0.1, "very_erratic")


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation on an ascending array."""
    pos = (F.size(ordered) - 1) * F.lit(float(p))
    low = F.floor(pos).cast("int")
    high = F.ceil(pos).cast("int")
    a = F.get(ordered, low).cast("double")
    b = F.get(ordered, high).cast("double")
    return a + (b - a) * (pos - low)


def array_mean_std(values: Column) -> tuple[Column, Column]:
    n = F.size(values)
    mean = array_total(values) / n
    spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x) / n - mean * mean
    return mean, F.sqrt(F.greatest(spread, F.lit(0.0)))


def weighted_median(points: Column) -> Column:
    """First value whose cumulative weight reaches half the total.

    ``points`` is an array of (value, weight) structs.
    """
    ordered = F.array_sort(points)
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p.weight)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("value"))

    def step(s: Column, p: Column) -> Column:
        cum = s.cum + p.weight
        hit = s.value.isNull() & (cum * (1 + TINY) >= total / 2)
        return F.struct(
            cum.alias("cum"), F.when(hit, p.value.cast("double")).otherwise(s.value).alias("value")
        )

    return F.aggregate(ordered, start, step, lambda s: s.value)


def pair_histories(history: DataFrame, target: str) -> DataFrame:
    """One row per pair: sorted dates, gaps and lines, plus the customer's visits."""
    day = F.lit(target).cast("date")
    lines = F.struct(
        F.greatest(F.datediff(day, "TrxDate"), F.lit(0)).alias("age"),
        F.col("TotalQuantity").cast("double").alias("qty"),
    )
    pairs = history.groupBy(*PAIR).agg(
        F.array_sort(F.collect_set("TrxDate")).alias("dates"),
        F.array_sort(F.collect_list(lines)).alias("lines"),
        F.avg("TotalQuantity").alias("avg_qty"),
        F.count(F.lit(1)).alias("purchase_count"),
    )
    visits = (
        history.select("RouteCode", "CustomerCode", "TrxDate").distinct()
        .groupBy("RouteCode", "CustomerCode")
        .agg(F.count(F.lit(1)).alias("total_visits"), F.max("TrxDate").alias("last_visit"))
    )
    n = F.size("dates")
    later = F.slice("dates", F.lit(2), F.greatest(n - 1, F.lit(0)))
    return (
        pairs.join(visits, ["RouteCode", "CustomerCode"])
        .withColumn("gaps", F.transform(later, lambda d, i: F.datediff(d, F.get("dates", i))))
        .withColumn("item_visits", n)
        .withColumn("frequency", F.col("item_visits") / F.col("total_visits"))
        .withColumn("days_since", F.datediff(day, F.element_at("dates", -1)))
    )


def pair_stats(history: DataFrame, target: str) -> DataFrame:
    return pair_histories(history, target).select(
        *PAIR, "total_visits", "item_visits", "frequency", "days_since", "purchase_count", "avg_qty"
    )


def gap_modes(gaps: Column) -> Column:
    """Gaps occurring at least twice, as (count, -first position, gap)."""
    distinct = F.array_distinct(gaps)
    counted = F.transform(
        distinct,
        lambda g, i: F.struct(
            F.size(F.filter(gaps, lambda x: x == g)).alias("n"), (-i).alias("order"), g.alias("gap")
        ),
    )
    return F.filter(counted, lambda m: m.n >= 2)


def has_patterns(gaps: Column, modes: Column) -> Column:
    """Two modes a week apart, among at least four gaps."""
    values = F.transform(modes, lambda m: m.gap)
    apart = F.array_max(values) - F.array_min(values) >= 7
    return (F.size(gaps) >= 4) & (F.size(modes) >= 2) & apart


def gap_weights(target: str, half_life: Column) -> Column:
    """Gaps with weights 2^(-age / half-life), aged from the gap's end date."""
    day = F.lit(target).cast("date")
    half = F.greatest(half_life, F.lit(1.0))
    return F.transform(
        "gaps",
        lambda g, i: F.struct(
            g.alias("value"),
            F.pow(
                F.lit(2.0),
                -F.greatest(F.datediff(day, F.get("dates", i + 1)), F.lit(0)) / half,
            ).alias("weight"),
        ),
    )


def cycle_confidence(gaps: Column, n_dates: Column) -> Column:
    depth = F.when(n_dates >= 10, 1.0).when(n_dates >= 5, 0.7).when(n_dates >= 3, 0.5).otherwise(0.3)
    mean, std = array_mean_std(gaps)
    cv = F.when(mean > 0, std / mean).otherwise(1.0)
    steady = F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1.0 - cv * 0.8))
    return py_round(F.least(F.lit(1.0), depth * 0.6 + steady * 0.4), 4)


def with_cycle(pairs: DataFrame, target: str, half_life: Column) -> DataFrame:
    """Purchase cycle in days with its confidence and method."""
    staged = pairs.withColumn("_modes", gap_modes(F.col("gaps")))
    n = F.size("gaps")
    modal = has_patterns(F.col("gaps"), F.col("_modes"))
    dominant = F.array_max("_modes")["gap"]
    median = weighted_median(gap_weights(target, half_life))

    def described(days: Column, confidence: Column, method: Column) -> Column:
        return F.struct(
            F.greatest(F.lit(1), days).alias("days"), confidence.alias("conf"),
            method.alias("method"),
        )

    patterns = F.concat(F.lit("multi_pattern_"), F.size("_modes").cast("string"))
    info = (
        F.when(n < 1, described(F.lit(30), F.lit(0.0), F.lit("insufficient")))
        .when(n == 1, described(F.get("gaps", F.lit(0)), F.lit(0.3), F.lit("two_purchases")))
        .when(modal, described(dominant, F.lit(0.7), patterns))
        .otherwise(
            described(
                median.cast("int"),
                cycle_confidence(F.col("gaps"), F.col("item_visits")),
                F.lit("weighted_recent"),
            )
        )
    )
    return staged.withColumn("_c", info).select(
        *pairs.columns,
        F.col("_c.days").alias("cycle_days"),
        F.col("_c.conf").alias("cycle_confidence"),
        F.col("_c.method").alias("cycle_method"),
    )


def with_pattern_quality(pairs: DataFrame) -> DataFrame:
    mean, std = array_mean_std(F.col("gaps"))
    cv = std / mean
    usable = (F.size("gaps") > 0) & (mean > 0)
    quality, label = F.when(~usable, 0.0), F.when(~usable, "unknown")
    for limit, q, name in QUALITY_BANDS:
        quality, label = quality.when(cv <= limit, q), label.when(cv <= limit, name)
    return pairs.withColumns(
        {"pattern_quality": quality.otherwise(QUALITY_LAST[0]),
         "pattern_type": label.otherwise(QUALITY_LAST[1])}
    )


def with_trend(pairs: DataFrame) -> DataFrame:
    """Median of the last three trimmed gaps against the median of all of them."""
    gaps = F.col("gaps")
    n = F.size(gaps)
    ordered = F.sort_array(gaps)
    q1, q3 = array_quantile(ordered, 0.25), array_quantile(ordered, 0.75)
    staged = pairs.withColumn("_q", F.struct(q1.alias("q1"), q3.alias("q3")))
    iqr = F.col("_q.q3") - F.col("_q.q1")
    low = F.greatest(F.lit(1.0), F.col("_q.q1") - 1.5 * iqr)
    high = F.col("_q.q3") + 1.5 * iqr
    trimmed = F.filter(gaps, lambda g: (g >= low) & (g <= high))
    keep_all = (n < 4) | (iqr == 0) | (F.size(trimmed) < n * 0.4)
    staged = staged.withColumn("_clean", F.when(keep_all, gaps).otherwise(trimmed))
    clean = F.col("_clean")
    last = F.least(F.size(clean), F.lit(3))
    recent = F.slice(clean, F.size(clean) - last + 1, last)
    enough = (F.size("dates") >= 4) & (n >= 3) & (F.size(clean) >= 3)
    staged = staged.withColumns(
        {
            "_usual": F.when(enough, array_quantile(F.sort_array(clean), 0.5)),
            "_recent": F.when(enough, array_quantile(F.sort_array(recent), 0.5)),
        }
    )
    ratio = F.col("_recent") / F.col("_usual")
    label = F.when(F.col("_usual").isNull(), "INSUFFICIENT_DATA").when(F.col("_usual") == 0, "STABLE")
    factor = F.when(F.col("_usual").isNull() | (F.col("_usual") == 0), 1.0)
    for limit, closed, name, f in TREND_BANDS:
        cond = ratio <= limit if closed else ratio < limit
        label, factor = label.when(cond, name), factor.when(cond, f)
    return staged.select(
        *pairs.columns,
        factor.otherwise(TREND_LAST[1]).alias("trend_factor"),
        label.otherwise(TREND_LAST[0]).alias("trend_type"),
        F.col("_usual").cast("int").alias("usual_cycle"),
        F.col("_recent").cast("int").alias("recent_cycle"),
    )


def with_weighted_qty(pairs: DataFrame, half_life: Column, c: Clamps) -> DataFrame:
    """Recency-weighted mean quantity, large lines capped at their P95 from four lines on."""
    qtys = F.transform("lines", lambda x: x.qty)
    upper = array_quantile(F.sort_array(qtys), c.winsor_percentile)
    staged = pairs.withColumn(
        "_cap", F.when((F.size("lines") >= 4) & (upper > 0), upper)
    )
    half = F.greatest(half_life, F.lit(1.0))
    points = F.transform(
        "lines",
        lambda x: F.struct(
            F.least(x.qty, F.coalesce(F.col("_cap"), x.qty)).alias("qty"),
            F.pow(F.lit(2.0), -x.age / half).alias("weight"),
        ),
    )
    weights = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p.weight)
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p.weight * p.qty)
    plain = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p.qty) / F.size("lines")
    return staged.withColumn(
        "weighted_qty", F.when(weights > 0, total / weights).otherwise(plain)
    ).drop("_cap")


def recommended_qty(weighted: Column, trend: Column, van: Column, c: Clamps) -> Column:
    """Expected quantity aimed at the middle of the accuracy zone, at least 1, at most the van's."""
    expected = F.greatest(F.lit(0.0), weighted * trend)
    middle = (c.qty_center[0] + c.qty_center[1]) / 2.0
    qty = F.least(F.greatest(F.lit(1), py_round(expected * middle).cast("int")), van.cast("int"))
    return F.when(expected > 0, qty).otherwise(F.lit(0))


def timing_score(days_since: Column, cycle_days: Column) -> Column:
    cycles = days_since / cycle_days
    score = F.exp(-F.pow(cycles - 1.0, F.lit(2.0)) / 2.0)
    return F.when((cycle_days <= 0) | (days_since < 0), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    )


def quantity_score(avg_qty: Column, benchmark: Column) -> Column:
    score = F.log1p(avg_qty) / F.log1p(F.greatest(benchmark, F.lit(1.0)))
    return F.when(avg_qty <= 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def consistency_score(gaps: Column) -> Column:
    mean, std = array_mean_std(gaps)
    steady = F.greatest(F.lit(0.3), 1.0 - std / mean * 0.7)
    depth = F.least(F.lit(0.2), F.size(gaps) * 0.02)
    return F.when((F.size(gaps) >= 1) & (mean > 0), F.least(F.lit(1.0), steady + depth)).otherwise(0.3)


def blend(frequency: Column, floor: Column, low: float, high: float) -> Column:
    """Weight between its low- and high-frequency value, linear in frequency."""
    ceiling = F.greatest(floor + 1e-6, F.lit(0.5))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (frequency - floor) / (ceiling - floor)))
    return F.lit(low) + t * F.lit(high - low)


def with_priority(pairs: DataFrame, c: Clamps) -> DataFrame:
    """Timing, quantity and consistency scores, their weights and the 0-100 priority.

    Expects cycle_days and the calibration columns on each row.
    """
    floor, freq = F.col("frequency_floor"), F.col("frequency")
    parts = {
        "timing": timing_score(F.col("days_since"), F.col("cycle_days")),
        "quantity": quantity_score(F.col("avg_qty"), F.col("qty_benchmark")),
        "consistency": consistency_score(F.col("gaps")),
    }
    out = pairs.withColumns(parts)
    weights = {
        f"w_{name}": blend(freq, floor, c.weights_low[i], c.weights_high[i])
        for i, name in enumerate(parts)
    }
    out = out.withColumns(weights)
    raw = F.lit(0.0)
    for name in parts:
        raw = raw + F.col(f"w_{name}") * F.col(name)
    return out.withColumn(
        "priority", py_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100)), 2)
    )


def score_pairs(history: DataFrame, calibration: DataFrame, target: str, c: Clamps) -> DataFrame:
    """All measures of every pair of the history, on its route's thresholds."""
    pairs = pair_histories(history, target).join(calibration, "RouteCode")
    half = F.col("recency_half_life_days")
    out = with_cycle(pairs, target, half)
    out = with_pattern_quality(out)
    out = with_trend(out)
    out = with_weighted_qty(out, half, c)
    return with_priority(out, c)
