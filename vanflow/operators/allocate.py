"""Feedback adjustment, merging of lanes, row shaping and van-stock allocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.functions.numeric import py_round
from vanflow.operators import explain as ex
from vanflow.operators.calibration import classify_tier
from vanflow.session import cut_lineage

PAIR = ["RouteCode", "CustomerCode", "ItemCode"]


def apply_feedback(candidates: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Scale priorities by the route's multiplier of their source and say so."""
    m = multipliers.select(
        F.col("route").alias("RouteCode"), "source", "multiplier",
        F.col("confidence").alias("_mc"), F.col("n").alias("_mn"),
    )
    joined = candidates.join(m, ["RouteCode", "source"], "left")
    active = F.abs(F.coalesce("multiplier", F.lit(1.0)) - 1.0) > 1e-6
    note = ex.feedback_signal(
        F.col("multiplier"), F.col("source"), F.coalesce("_mc", F.lit(0.0)),
        F.coalesce("_mn", F.lit(0)),
    )
    return joined.withColumns(
        {
            "priority": F.when(active, py_round(F.col("priority") * F.col("multiplier"), 2))
            .otherwise(F.col("priority")),
            "signals": F.when(active, F.concat("signals", F.array(note))).otherwise(F.col("signals")),
        }
    ).drop("multiplier", "_mc", "_mn").select(*candidates.columns)


def merge_and_rank(candidates: DataFrame) -> DataFrame:
    """One row per customer and item.

    The highest priority wins and the earlier lane wins ties; signals of kinds
    the winner lacks are appended. A group holds at most one row per lane.
    """
    payload = [c for c in candidates.columns if c not in PAIR]
    rest = [c for c in payload if c not in ("lane", "priority", "signals")]
    row = F.struct("lane", "priority", "signals", *rest)
    grouped = candidates.groupBy(*PAIR).agg(F.collect_list(row).alias("_rows"))
    by_lane = F.array_sort(
        F.col("_rows"), lambda a, b: a.lane.cast("int") - b.lane.cast("int")
    )

    def step(acc, c):
        def extra(kept, other):
            kinds = F.transform(kept, lambda s: s.kind)
            return F.concat(kept, F.filter(other, lambda s: ~F.array_contains(kinds, s.kind)))

        wins = c.priority > acc.priority
        merged = F.when(wins, extra(c.signals, acc.signals)).otherwise(extra(acc.signals, c.signals))
        keep = lambda f: F.when(wins, c[f]).otherwise(acc[f]).alias(f)
        return F.struct(
            keep("lane"), keep("priority"), merged.alias("signals"), *[keep(f) for f in rest]
        )

    first = F.element_at("_sorted", 1)
    others = F.slice("_sorted", F.lit(2), F.greatest(F.size("_sorted") - 1, F.lit(0)))
    return (
        grouped.withColumn("_sorted", by_lane)
        .withColumn("_w", F.aggregate(others, first, step))
        .select(*PAIR, *[F.col(f"_w.{c}").alias(c) for c in payload])
    )


def shape_rows(
    ranked: DataFrame, calibration: DataFrame, names: DataFrame, customer_names: DataFrame,
    date: str, global_names: DataFrame | None = None,
) -> DataFrame:
    """Tiered rows in the published 23-column layout; EXCLUDE rows are dropped."""
    cuts = calibration.select(
        "RouteCode", "tier_must_stock", "tier_should_stock", "tier_consider", "tier_monitor"
    )
    tiered = (
        ranked.join(cuts, "RouteCode")
        .withColumn("Tier", classify_tier(F.col("priority")))
        .filter("Tier <> 'EXCLUDE'")
        .join(names, ["RouteCode", "ItemCode"], "left")
        .join(customer_names, ["RouteCode", "CustomerCode"], "left")
    )
    item_name = F.coalesce("ItemName", F.lit(""))
    if global_names is not None:
        named = names.select("RouteCode").distinct().withColumn("_named", F.lit(True))
        tiered = tiered.join(named, "RouteCode", "left").join(global_names, "ItemCode", "left")
        fallback = F.when(F.col("_named").isNull(), F.col("_global_name"))
        item_name = F.coalesce(F.col("ItemName"), fallback, F.lit(""))
    return tiered.select(
        F.lit(date).cast("date").alias("TrxDate"), "RouteCode", "CustomerCode",
        F.coalesce("CustomerName", F.lit("")).alias("CustomerName"), "ItemCode",
        item_name.alias("ItemName"),
        F.col("qty").cast("int").alias("RecommendedQuantity"), "Tier",
        F.col("van_qty").cast("int").alias("VanLoad"),
        F.col("priority").alias("PriorityScore"),
        py_round("avg_qty").cast("int").alias("AvgQuantityPerVisit"),
        F.col("days_since").alias("DaysSinceLastPurchase"),
        F.col("cycle_days").alias("PurchaseCycleDays"),
        F.col("frequency_pct").alias("FrequencyPercent"),
        F.col("churn_probability").alias("ChurnProbability"),
        F.col("pattern_quality").alias("PatternQuality"),
        F.col("purchase_count").alias("PurchaseCount"),
        F.col("trend_factor").alias("TrendFactor"),
        F.col("signals").alias("Signals"),
        F.col("why_item").alias("WhyItem"),
        F.col("why_quantity").alias("WhyQuantity"),
        F.col("confidence").alias("Confidence"),
        F.col("source").alias("Source"),
    )


ITEM = ["TrxDate", "RouteCode", "ItemCode"]


def _by_priority() -> list[Column]:
    return [F.desc("PriorityScore"), F.asc("CustomerCode")]


def priority_ranges(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows with the number of their range in the order of item, priority and customer.

    Spark samples the rows for ranges of equal size, so that a hot item lies in
    as many of them as its share of the rows asks for.
    """
    if ranges is None:
        ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartitionByRange(ranges, *ITEM, *_by_priority()).withColumn("_range", F.spark_partition_id()))


def allocate_van_load(rows: DataFrame, splits: int | None = None) -> DataFrame:
    """Greedy allocation of van stock by priority, as a prefix sum in two levels.

    A row gets what the rows before it left over. Each (item, range) is summed,
    the few sums of an item are added up in order, and only ranges that begin
    before the van is used up are summed row by row, each on its own.
    `splits` is the number of ranges (the session's shuffle partitions if not given).
    """
    want = F.col("RecommendedQuantity")
    each = [*ITEM, "_range"]

    def before(keys, by, value):
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0))

    placed = priority_ranges(rows.filter(want > 0), splits)
    sums = placed.groupBy(*each).agg(F.sum(want).alias("_sum"))
    starts = sums.select(
        *[F.col(c).alias(f"_{c}") for c in each], before(ITEM, ["_range"], "_sum").alias("_start"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in each])
    cut = (
        placed.join(starts, same).filter(F.col("_start") < F.col("VanLoad"))
        .withColumn("_used", F.col("_start") + before(each, _by_priority(), "RecommendedQuantity"))
        .drop("_start", "_range", *[f"_{c}" for c in each])
    )
    given = F.least(want, F.greatest(F.col("VanLoad") - F.col("_used"), F.lit(0))).cast("int")
    note = F.format_string(" [Van constrained: %d/%d]", F.col("_given"), want)
    return (
        cut.withColumn("_given", given)
        .filter("_given > 0")
        .withColumn(
            "WhyQuantity",
            F.when(F.col("_given") < want, F.concat(F.coalesce("WhyQuantity", F.lit("")), note))
            .otherwise(F.col("WhyQuantity")),
        )
        .withColumn("RecommendedQuantity", F.col("_given"))
        .select(*rows.columns)
    )


def customer_groups(rows: DataFrame) -> DataFrame:
    """Items and total quantity per customer."""
    name = F.trim(F.max("CustomerName"))
    return rows.groupBy("TrxDate", "RouteCode", "CustomerCode").agg(
        F.when(name != "", name).otherwise(F.col("CustomerCode")).alias("CustomerName"),
        F.count(F.lit(1)).alias("items"),
        F.sum("RecommendedQuantity").alias("total_qty"),
    )


def route_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("TrxDate", "RouteCode").agg(
        F.countDistinct("CustomerCode").alias("customers"),
        F.countDistinct("ItemCode").alias("skus"),
        F.sum("RecommendedQuantity").alias("total_qty"),
    )


def generator_metrics(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Candidates, kept rows, share of kept rows and mean peer similarity per lane."""
    similarity = F.get("signals", F.lit(0))["evidence"]["similarity_score"].cast("double")
    made = candidates.groupBy("RouteCode", "source").agg(
        F.count(F.lit(1)).alias("candidates"),
        py_round(F.avg(F.when(F.col("source") == "peer", similarity)), 4).alias("similarity_avg"),
    )
    left = kept.groupBy("RouteCode", F.col("Source").alias("source")).agg(
        F.count(F.lit(1)).alias("kept")
    )
    joined = made.join(left, ["RouteCode", "source"], "left").fillna(0, ["kept"])
    total = F.sum("kept").over(Window.partitionBy("RouteCode"))  # five rows per route
    share = F.when(total > 0, py_round(F.col("kept") * 100.0 / total, 2)).otherwise(0.0)
    return joined.withColumn("source_pct", share)
