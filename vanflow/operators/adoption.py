"""How far customers followed the recommendations, and the upcoming plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanflow.config import DASHBOARD, DashboardConfig
from vanflow.functions.numeric import py_round, ratio
from vanflow.functions.text import clean_code
from vanflow.operators.scoring import array_total

KEYS = ["trx_date", "route_code", "customer_code", "item_code"]


def _keyed(df: DataFrame, dealt: bool, *more: Column) -> DataFrame:
    code = F.col if dealt else clean_code
    return df.select(
        F.to_date("TrxDate").alias("trx_date"), code("RouteCode").alias("route_code"),
        code("CustomerCode").alias("customer_code"), clean_code("ItemCode").alias("item_code"),
        *more,
    )


def merge_adoption(recs: DataFrame, sales: DataFrame, dealt: bool = False) -> DataFrame:
    """Recommended and sold lines of recommended visits, side by side.

    A line is adopted (recommended and sold), over-recommended (recommended
    only) or missed (sold without a recommendation on a recommended visit).
    Sides that are `dealt` alike by customer, their route and customer codes
    trimmed, meet where they lie.
    """
    r = _keyed(
        recs, dealt, F.col("RecommendedQuantity").cast("double").alias("recommended_qty"),
        F.col("Tier").alias("tier"), F.lit(True).alias("_rec"),
    )
    s = _keyed(
        sales, dealt, F.col("TotalQuantity").cast("double").alias("actual_qty"), F.lit(True).alias("_sold")
    ).join(r.select(*KEYS[:3]).distinct(), KEYS[:3], "left_semi")
    joined = r.join(s, KEYS, "full_outer").fillna(0.0, ["recommended_qty", "actual_qty"])
    rec, sold = F.col("_rec").isNotNull(), F.col("_sold").isNotNull()
    bought = F.col("actual_qty") > 0
    return joined.select(
        *KEYS, "tier", "recommended_qty", "actual_qty", rec.alias("recommended"),
        (rec & sold & bought).alias("adopted"),
        (rec & ~(sold & bought)).alias("over_recommended"),
        (~rec).alias("missed"),
    )


def _count(flag: str) -> Column:
    return F.count(F.when(F.col(flag), 1))


def _pct(num: Column, den: Column, default: float | None = None) -> Column:
    return ratio(py_round(num / den * 100, 1), den, default)


def _rate(num: str, den: str, default: float | None = 0.0) -> Column:
    n, d = _count(num), _count(den)
    return F.when(d > 0, py_round(n / d * 100, 1)).otherwise(F.lit(default))


def adoption_summary(merged: DataFrame) -> DataFrame:
    pushed = F.coalesce(F.avg(F.when(F.col("adopted"), F.col("actual_qty"))), F.lit(0.0))
    unpushed = F.coalesce(F.avg(F.when(F.col("missed"), F.col("actual_qty"))), F.lit(0.0))
    return merged.agg(
        _count("recommended").alias("rows_recommended"),
        _count("adopted").alias("rows_adopted"),
        _count("over_recommended").alias("rows_over_recommended"),
        _count("missed").alias("rows_missed"),
        _rate("adopted", "recommended", None).alias("adoption_pct"),
        F.when(unpushed > 0, py_round((pushed - unpushed) / unpushed * 100, 1)).alias("uplift_pct"),
        py_round(F.sum(F.when(F.col("recommended"), F.col("recommended_qty"))), 1)
        .alias("total_recommended_qty"),
        py_round(F.sum("actual_qty"), 1).alias("total_sold_qty"),
    )


def daily_adoption(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("trx_date").isNotNull()).groupBy("trx_date").agg(
        _count("recommended").alias("recommended"), _count("adopted").alias("adopted"),
        _rate("adopted", "recommended").alias("adoption_pct"),
    )


def top_adoption_items(merged: DataFrame, which: str, k: int = 10) -> DataFrame:
    """Items most often over-recommended or missed."""
    flag, qty = {
        "over": ("over_recommended", "recommended_qty"), "missed": ("missed", "actual_qty"),
    }[which]
    return (
        merged.filter(F.col(flag)).groupBy("item_code")
        .agg(F.count(F.lit(1)).alias("rows"), py_round(F.sum(qty), 1).alias("qty"))
        .orderBy(F.desc("rows"), "item_code").limit(k)
    )


def adoption_by_tier(merged: DataFrame) -> DataFrame:
    tiered = merged.filter(F.col("recommended") & (F.coalesce("tier", F.lit("")) != ""))
    return tiered.groupBy("tier").agg(
        _count("recommended").alias("recommended"), _count("adopted").alias("adopted"),
        _rate("adopted", "recommended").alias("adoption_pct"),
    )


def adoption_highlights(merged: DataFrame) -> DataFrame:
    """Coverage, late-minus-early trend, best day and best tier.

    The days of the period fit one array; the tiers are at most a handful.
    """
    point = F.struct("trx_date", "adoption_pct")
    days = (
        daily_adoption(merged).filter("recommended > 0")
        .agg(F.array_sort(F.collect_list(point)).alias("days"))
    )
    tier_rank = F.struct("adoption_pct", "recommended", "tier")
    best_tier = adoption_by_tier(merged).agg(F.max(tier_rank)).scalar()
    adopted, missed = _count("adopted"), _count("missed")
    coverage = merged.agg(
        F.when(adopted + missed > 0, adopted / (adopted + missed) * 100)
    ).scalar()
    pct = F.transform("days", lambda d: d.adoption_pct)
    n = F.size("days")
    mid = F.floor(n / 2).cast("int")
    early, late = F.slice(pct, F.lit(1), mid), F.slice(pct, mid + 1, n - mid)
    trend = F.when(n >= 2, array_total(late) / F.size(late) - array_total(early) / F.size(early))
    best_pct = F.array_max(pct)
    best_day = F.element_at(F.filter("days", lambda d: d.adoption_pct == F.array_max(
        F.transform("days", lambda x: x.adoption_pct))), 1)
    return days.withColumn("_tier", best_tier).select(
        coverage.alias("coverage_pct"), trend.alias("trend_pp"),
        best_day["trx_date"].alias("best_day"), best_pct.alias("best_day_pct"),
        F.col("_tier.tier").alias("best_tier"), F.col("_tier.adoption_pct").alias("best_tier_pct"),
    )


def item_prices(customer: DataFrame) -> DataFrame:
    """Mean unit price per item; items without a positive price have none."""
    return (
        customer.groupBy("ItemCode").agg(F.avg("AvgUnitPrice").alias("price")).filter("price > 0")
    )


def upcoming_plan(
    spark: SparkSession, journey: DataFrame, demand: DataFrame, prices: DataFrame,
    today: str, days: int, cfg: DashboardConfig = DASHBOARD,
) -> DataFrame:
    """Planned customers and routes, predicted quantity and revenue per day of the horizon (1 to `max_plan_days`)."""
    if not 1 <= days <= cfg.max_plan_days:
        raise ValueError(f"days must be between 1 and {cfg.max_plan_days}")
    start = F.lit(today).cast("date")
    horizon = spark.range(1).select(
        F.explode(F.sequence(start, F.date_add(start, days - 1))).alias("date")
    )
    inside = lambda c: F.col(c).between(start, F.date_add(start, days - 1))
    visits = (
        journey.filter(inside("JourneyDate")).groupBy(F.col("JourneyDate").alias("date"))
        .agg(
            F.countDistinct("CustomerCode").alias("customers"),
            F.countDistinct("RouteCode").alias("routes"),
        )
    )
    per_item = demand.filter(inside("TrxDate")).groupBy("TrxDate", "ItemCode").agg(
        F.sum("Predicted").alias("qty")
    )
    volume = (
        per_item.join(prices, "ItemCode", "left").groupBy(F.col("TrxDate").alias("date"))
        .agg(F.sum("qty").alias("_qty"), F.sum(F.col("qty") * F.col("price")).alias("_revenue"))
    )
    revenue = F.when(F.col("_revenue") > 0, py_round("_revenue", 2))
    return (
        horizon.join(visits, "date", "left").join(volume, "date", "left")
        .select(
            "date", F.coalesce("customers", F.lit(0)).alias("customers"),
            F.coalesce("routes", F.lit(0)).alias("routes"),
            py_round(F.coalesce("_qty", F.lit(0.0)), 1).alias("predicted_qty"),
            revenue.alias("est_revenue"),
        )
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    """Totals over the horizon; the peak is the first day with the largest quantity."""
    peak = F.max(F.struct(F.col("predicted_qty"), (-F.unix_date("date")).alias("o"), F.col("date")))
    busy = (F.col("customers") > 0) | (F.col("predicted_qty") > 0)
    revenue = F.sum("est_revenue")
    return plan.agg(
        F.sum("customers").alias("total_visits"),
        py_round(F.sum("predicted_qty"), 1).alias("total_qty"),
        F.when(revenue > 0, py_round(revenue, 2)).alias("total_revenue"),
        peak["date"].alias("peak_day"), peak["predicted_qty"].alias("peak_qty"),
        F.count(F.when(busy, 1)).alias("active_days"),
    )


def journey_counts(journey: DataFrame, date: str) -> DataFrame:
    return (
        journey.filter(F.col("JourneyDate") == F.lit(date).cast("date"))
        .groupBy("RouteCode").agg(F.countDistinct("CustomerCode").alias("customers"))
    )
