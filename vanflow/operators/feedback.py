"""Closed loop: attribute recommendations to visits and reweight their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanflow.config import Clamps
from vanflow.functions.numeric import clamp, py_round
from vanflow.functions.text import clean_code

VISIT = ["route_code", "date", "customer_code"]
LINE = [*VISIT, "item_code"]


def window_days(c: Clamps) -> int:
    low, high = c.feedback_window_bounds
    return max(low, min(high, int(c.feedback_window_days)))


def in_window(df: DataFrame, date_col: str, today: str, days: int) -> DataFrame:
    """Rows of the trailing window, today included; prunes date partitions."""
    end = F.lit(today).cast("date")
    return df.filter(F.col(date_col).between(F.date_sub(end, days), end))


def build_attribution(recs: DataFrame, sessions: DataFrame, dealt: bool = False) -> DataFrame:
    """Recommendations of visited customers with what was sold of each.

    Customers that were planned but not visited say nothing about the
    recommendation and drop out. Sides that are `dealt` alike by customer,
    their route and customer codes trimmed, meet where they lie.
    """
    code = F.col if dealt else clean_code
    r = recs.select(
        code("RouteCode").alias("route_code"), F.to_date("TrxDate").alias("date"),
        code("CustomerCode").alias("customer_code"), clean_code("ItemCode").alias("item_code"),
        F.coalesce(F.col("RecommendedQuantity").cast("int"), F.lit(0)).alias("recommended_qty"),
        clean_code("Source").alias("source"),
        F.coalesce(F.col("Confidence").cast("double"), F.lit(0.0)).alias("confidence"),
    )
    s = sessions.select(
        code("route_code").alias("route_code"), F.to_date("date").alias("date"),
        code("customer_code").alias("customer_code"), clean_code("item_code").alias("item_code"),
        clean_code("session_id").alias("session_id"), "visited", "actual_qty", "was_sold",
    )
    # a visit's outcomes travel as one row: either side moves once, by visit
    visited = s.filter("visited")
    lines = (visited if dealt else visited.repartition(*VISIT)).groupBy(*LINE).agg(
        F.sum("actual_qty").alias("actual_qty"),
        F.max("was_sold").alias("was_sold"),
        F.min("session_id").alias("session_id"),
    )
    outcome = F.struct("item_code", F.struct("actual_qty", "was_sold", "session_id"))
    named = F.when(F.col("item_code").isNotNull() & (F.col("item_code") != ""), outcome)
    visits = lines.groupBy(*VISIT).agg(F.map_from_entries(F.collect_list(named)).alias("_of"))
    found = F.when(F.col("item_code").isNotNull(), F.col("_of")[F.col("item_code")])
    joined = r.join(visits, VISIT).withColumn("_o", found).select(
        *r.columns, "_o.actual_qty", "_o.was_sold", "_o.session_id").fillna(
        {"actual_qty": 0, "was_sold": False, "session_id": ""}
    ).select(*LINE, "recommended_qty", "source", "confidence", "actual_qty", "was_sold", "session_id")
    rec, act = F.col("recommended_qty"), F.col("actual_qty")
    error = F.abs(rec - act) / F.greatest(rec, act, F.lit(1))
    return joined.withColumns(
        {"was_bought": act > 0, "qty_accuracy": 1.0 - F.least(F.lit(1.0), error)}
    )


def session_reject_rates(attribution: DataFrame) -> DataFrame:
    bought = F.sum(F.col("was_bought").cast("int"))
    return attribution.groupBy("route_code", "session_id").agg(
        (1.0 - bought / F.count(F.lit(1))).alias("reject_rate")
    )


def drop_adversarial_sessions(attribution: DataFrame, c: Clamps) -> DataFrame:
    """Remove sessions whose reject rate stands far outside their route's distribution."""
    rates = session_reject_rates(attribution)
    stats = rates.groupBy("route_code").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("reject_rate").alias("_mean"),
        F.stddev_pop("reject_rate").alias("_std"),
    ).filter((F.col("_n") >= 3) & (F.col("_std") > 0))
    z = F.abs(F.col("reject_rate") - F.col("_mean")) / F.col("_std")
    odd = rates.join(stats, "route_code").filter(z > c.feedback_adversarial_z)
    keys = ["route_code", "session_id"]
    return attribution.join(odd.select(*keys), keys, "left_anti")


def _rates(*keys: str):
    def build(attribution: DataFrame) -> DataFrame:
        return attribution.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("was_bought").cast("int")).alias("hits"),
            F.avg("qty_accuracy").alias("qty_accuracy"),
        ).withColumn("hit_rate", F.col("hits") / F.col("n"))

    return build


route_hit_rates = _rates("route_code", "source")


def corpus_hit_rates(attribution: DataFrame, c: Clamps) -> DataFrame:
    """Hit rate per source over all routes; weak sources are flagged."""
    return _rates("source")(attribution).withColumn(
        "weak_source", F.col("hit_rate") < c.feedback_weak_source
    )


def shrunk_multipliers(attribution: DataFrame, c: Clamps) -> DataFrame:
    """Route hit rate, shrunk towards the source's corpus rate and relative to it.

    The prior weighs as much as a quarter of the median sample of a
    (route, source), at least one.
    """
    per = route_hit_rates(attribution)
    corpus = per.groupBy("source").agg((F.sum("hits") / F.sum("n")).alias("corpus_rate"))
    median = per.agg(F.percentile(F.col("n").cast("double"), 0.5)).scalar()
    k = F.greatest(F.lit(1.0), median / max(1.0, c.feedback_prior_divisor))
    n, rate, corp = F.col("n"), F.col("hit_rate"), F.col("corpus_rate")
    shrunk = (n * rate + F.col("k") * corp) / (n + F.col("k"))
    raw = F.when(corp <= 0, 1.0).otherwise(shrunk / corp)
    return per.join(corpus, "source").withColumn("k", k).select(
        F.col("route_code").alias("route"), "source", "n", "k",
        clamp(raw, c.feedback_multiplier).alias("raw_multiplier"),
    )


def smoothed_multipliers(raw: DataFrame, previous: DataFrame, c: Clamps) -> DataFrame:
    """Blend with the previous run; pairs without new evidence keep their values."""
    alpha = c.feedback_ema_alpha
    old = previous.select(
        "route", "source", F.col("multiplier").alias("_m"), F.col("confidence").alias("_c"),
        F.col("n").alias("_n"),
    )
    joined = raw.join(old, ["route", "source"], "full_outer")
    blended = clamp(
        alpha * F.col("raw_multiplier") + (1.0 - alpha) * F.coalesce("_m", F.lit(1.0)),
        c.feedback_multiplier,
    )
    fresh = F.col("raw_multiplier").isNotNull()
    trust = F.least(F.lit(1.0), F.col("n") / F.greatest(F.col("k"), F.lit(1.0)))
    return joined.select(
        "route", "source",
        F.when(fresh, py_round(blended, 4)).otherwise(F.col("_m")).alias("multiplier"),
        F.when(fresh, py_round(trust, 4)).otherwise(F.col("_c")).alias("confidence"),
        F.when(fresh, F.col("n")).otherwise(F.col("_n")).cast("int").alias("n"),
    )


def active_routes(multipliers: DataFrame) -> DataFrame:
    changed = multipliers.filter(F.abs(F.col("multiplier") - 1.0) > 1e-6)
    return changed.agg(F.countDistinct("route").alias("active_routes"))
