"""Candidate generators: history, look-alike peers, basket, reactivation and seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.config import Clamps, Splits, SPLITS
from vanflow.functions.numeric import clamp, first_ranked, py_round
from vanflow.operators import explain as ex
from vanflow.operators import scoring as sg
from vanflow.operators.calibration import active_customers, pair_confidences
from vanflow.operators.pairs import nearest_peers

LANES = {"history": 0, "peer": 1, "basket": 2, "reactivation": 3, "seed": 4}
PAIR = ["RouteCode", "CustomerCode", "ItemCode"]


def van_items(demand: DataFrame, date: str) -> DataFrame:
    """Van quantity per route and item; a route's forecast rows replace its other rows."""
    planned = F.col("DataSplit") == "Forecast"
    per_item = (
        demand.filter(F.col("TrxDate") == F.lit(date).cast("date"))
        .groupBy("RouteCode", "ItemCode")
        .agg(
            F.sum("Predicted").alias("_all"),
            F.sum(F.when(planned, F.col("Predicted"))).alias("_planned"),
            F.max(planned).alias("_has"),
        )
    )
    route_has = F.max("_has").over(Window.partitionBy("RouteCode"))  # a route's catalogue
    chosen = per_item.withColumn("_route_has", route_has).withColumn(
        "_qty", F.when(F.col("_route_has"), F.col("_planned")).otherwise(F.col("_all"))
    )
    qty = py_round(F.greatest(F.col("_qty"), F.lit(0.0))).cast("int")
    return chosen.select("RouteCode", "ItemCode", qty.alias("van_qty")).filter("van_qty > 0")


def journey_customers(journey: DataFrame, date: str) -> DataFrame:
    return (
        journey.filter(F.col("JourneyDate") == F.lit(date).cast("date"))
        .select("RouteCode", "CustomerCode").dropna().distinct()
    )


def top_van_items(van: DataFrame, k: int) -> DataFrame:
    return first_ranked(van, ["RouteCode"], [F.desc("van_qty"), F.asc("ItemCode")], k, "van_rank")


def _first_names(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    filled = df.filter(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    return filled.groupBy(*keys).agg(F.min(F.struct("TrxDate", name))[name].alias(name))


def item_names(demand: DataFrame, customer: DataFrame) -> DataFrame:
    """Item names per route, from the forecast first and the sales history second."""
    keys = ["RouteCode", "ItemCode"]
    first = _first_names(demand, keys, "ItemName").withColumnRenamed("ItemName", "_a")
    second = _first_names(customer, keys, "ItemName").withColumnRenamed("ItemName", "_b")
    return first.join(second, keys, "full_outer").select(
        *keys, F.coalesce("_a", "_b").alias("ItemName")
    )


def global_item_names(demand: DataFrame, customer: DataFrame) -> DataFrame:
    """Names regardless of route, for routes that have none of their own."""
    first = _first_names(demand, ["ItemCode"], "ItemName").withColumnRenamed("ItemName", "_a")
    second = _first_names(customer, ["ItemCode"], "ItemName").withColumnRenamed("ItemName", "_b")
    return first.join(second, "ItemCode", "full_outer").select(
        "ItemCode", F.coalesce("_a", "_b").alias("_global_name")
    )


def customer_names(customer: DataFrame) -> DataFrame:
    return customer.groupBy("RouteCode", "CustomerCode").agg(
        F.min(F.struct("TrxDate", "CustomerName"))["CustomerName"].alias("CustomerName")
    )


def _candidate(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    """A lane's rows in the common candidate layout."""
    zero = F.lit(0.0)
    layout: dict[str, Column] = {
        "qty": None, "priority": None, "van_qty": F.col("van_qty"), "avg_qty": None,
        "days_since": F.lit(0), "cycle_days": zero, "frequency_pct": zero,
        "pattern_quality": F.lit(0.5), "purchase_count": F.lit(0), "trend_factor": F.lit(1.0),
        "churn_probability": zero, "item_signals": ex.no_signals(), "qty_signals": ex.no_signals(),
    }
    layout.update(cols)
    ints = {"qty", "van_qty", "days_since", "purchase_count"}
    signals = {"item_signals", "qty_signals"}
    picked = [
        (c if name in signals else c.cast("int" if name in ints else "double")).alias(name)
        for name, c in layout.items()
    ]
    return df.select(
        *PAIR, F.lit(source).alias("source"), F.lit(LANES[source]).alias("lane"), *picked
    )


def history_lane(scored: DataFrame, van: DataFrame, c: Clamps) -> DataFrame:
    """The customer's own items that are due, regular and strong enough."""
    qty = sg.recommended_qty(F.col("weighted_qty"), F.col("trend_factor"), F.col("van_qty"), c)
    score = F.col("priority") * F.col("trend_factor")
    due = (
        scored.join(van, ["RouteCode", "ItemCode"])
        .filter(
            (F.col("days_since") > c.min_days_since_purchase)
            & (F.col("frequency") >= F.col("frequency_floor"))
            & (F.col("days_since") / F.col("cycle_days") >= F.col("completion_gate"))
            & (score >= F.col("tier_monitor"))
        )
        .withColumn("_qty", qty)
        .filter("_qty > 0")
    )
    return _candidate(
        due, "history", qty=F.col("_qty"), priority=py_round(score, 2), avg_qty=F.col("avg_qty"),
        days_since=F.col("days_since"), cycle_days=F.col("cycle_days"),
        frequency_pct=py_round(F.col("frequency") * 100, 1),
        pattern_quality=py_round("pattern_quality", 2), purchase_count=F.col("purchase_count"),
        trend_factor=py_round("trend_factor", 2),
        item_signals=ex.history_signals(), qty_signals=ex.history_qty_signals(F.col("_qty")),
    )


def lookalike_weights(history: DataFrame, calibration: DataFrame, target: str) -> DataFrame:
    """Recency weight e^(-age / half-life) and mean quantity per customer and item."""
    day = F.lit(target).cast("date")
    age = F.greatest(F.datediff(day, "TrxDate"), F.lit(0))
    half = F.greatest(F.col("recency_half_life_days"), F.lit(1.0))
    lines = history.join(calibration.select("RouteCode", "recency_half_life_days"), "RouteCode")
    return lines.groupBy(*PAIR).agg(
        F.sum(F.exp(-age / half)).alias("weight"), F.avg("TotalQuantity").alias("mean_qty")
    )


def peers(
    weights: DataFrame, targets: DataFrame, calibration: DataFrame, c: Clamps,
    splits: Splits = SPLITS,
) -> DataFrame:
    """The route's k nearest customers of every target customer."""
    near = nearest_peers(weights, targets, c.peer_k[1], splits=splits)
    limits = calibration.select("RouteCode", "peer_k")
    return near.join(limits, "RouteCode").filter("peer_rank <= peer_k").drop("peer_k")


def large_enough_routes(history: DataFrame, c: Clamps) -> DataFrame:
    """Routes with enough customers for similarities to mean anything."""
    return active_customers(history).filter(
        F.col("active_customers") >= c.peer_min_customers
    ).select("RouteCode")


def _peer_purchases(peer_table: DataFrame, weights: DataFrame, van: DataFrame) -> DataFrame:
    bought = weights.filter("weight > 0").select(
        "RouteCode", F.col("CustomerCode").alias("peer"), "ItemCode", "weight", "mean_qty"
    )
    stocked = bought.join(van, ["RouteCode", "ItemCode"])
    return peer_table.join(stocked, ["RouteCode", "peer"])


def peer_scores(peer_table: DataFrame, weights: DataFrame, van: DataFrame) -> DataFrame:
    """Similarity-weighted recency per van item, over the peers who bought it.

    The weighted median of the buyers' mean quantities comes from the same
    group: a customer has at most k peers.
    """
    sims = F.sum("sim")
    points = F.collect_list(F.struct(F.col("mean_qty").alias("value"), F.col("sim").alias("weight")))
    scored = _peer_purchases(peer_table, weights, van).groupBy(*PAIR, "van_qty").agg(
        py_round(F.sum(F.col("sim") * F.col("weight")) / sims, 9).alias("peer_score"),
        F.count(F.lit(1)).alias("peer_buyers"),
        points.alias("_points"),
    )
    return scored.withColumn("median_qty", sg.weighted_median(F.col("_points"))).drop("_points")


def rank_peer_items(scores: DataFrame, calibration: DataFrame, c: Clamps) -> DataFrame:
    """Items at or above the customer's score floor, best first, up to the route's limit."""
    limits = calibration.select(
        "RouteCode", "peer_floor", "peer_max", "tier_consider", "tier_should_stock"
    )
    mine = Window.partitionBy("RouteCode", "CustomerCode")
    positive = scores.filter("peer_score > 0").join(limits, "RouteCode")
    floor = clamp(
        F.greatest(F.col("peer_floor"), F.percentile("peer_score", 0.75).over(mine)), c.peer_floor
    )
    order = mine.orderBy(F.desc("peer_score"), F.asc("ItemCode"))
    return (
        positive.withColumn("score_floor", floor)
        .filter(F.col("peer_score") >= F.col("score_floor"))
        .withColumn("item_rank", F.row_number().over(order))
        .filter(F.col("item_rank") <= F.col("peer_max"))
    )


def between_tiers(score: Column) -> Column:
    """Place a 0-1 score between the consider and should-stock cuts."""
    low, high = F.col("tier_consider"), F.col("tier_should_stock")
    return low + F.least(F.lit(1.0), score) * (high - low)


def peer_lane(
    peer_table: DataFrame, weights: DataFrame, van: DataFrame, calibration: DataFrame, c: Clamps
) -> DataFrame:
    considered = peer_table.groupBy("RouteCode", "CustomerCode").agg(
        F.count(F.lit(1)).alias("peers_considered")
    )
    ranked = (
        rank_peer_items(peer_scores(peer_table, weights, van), calibration, c)
        .filter("median_qty > 0")
        .join(considered, ["RouteCode", "CustomerCode"])
    )
    qty = F.least(F.col("van_qty"), F.greatest(F.lit(1), py_round("median_qty").cast("int")))
    return _candidate(
        ranked, "peer", qty=qty, priority=py_round(between_tiers(F.col("peer_score")), 2),
        avg_qty=F.col("median_qty"), frequency_pct=py_round(F.col("peer_score") * 100, 1),
        item_signals=ex.peer_signals(), qty_signals=ex.peer_qty_signals(),
    )


def median_co_quantities(pairs: DataFrame, means: DataFrame) -> DataFrame:
    """Median, over customers buying both, of the customer's mean quantity of the item.

    Runs on chosen (route, anchor, item) pairs only; equal quantities are
    counted before the median is taken.
    """
    anchors = means.select("RouteCode", "CustomerCode", F.col("ItemCode").alias("anchor"))
    items = means.select(
        "RouteCode", "CustomerCode", F.col("ItemCode").alias("item"), "mean_qty"
    )
    keys = ["RouteCode", "anchor", "item"]
    return (
        pairs.select(*keys).distinct()
        .join(anchors, ["RouteCode", "anchor"])
        .join(items, ["RouteCode", "CustomerCode", "item"])
        .groupBy(*keys, "mean_qty").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys).agg(F.percentile("mean_qty", 0.5, F.col("_n")).alias("median_qty"))
    )


def confident_pairs(
    history: DataFrame, calibration: DataFrame, splits: Splits = SPLITS
) -> DataFrame:
    limits = calibration.select("RouteCode", "basket_min_confidence")
    return (
        pair_confidences(history, splits).join(limits, "RouteCode")
        .filter(F.col("confidence") >= F.col("basket_min_confidence"))
        .select("RouteCode", "anchor", "item", "confidence")
    )


def co_occurrence(
    history: DataFrame, calibration: DataFrame, splits: Splits = SPLITS
) -> DataFrame:
    """Confident item pairs with the median quantity of the second item."""
    means = history.groupBy(*PAIR).agg(F.avg("TotalQuantity").alias("mean_qty"))
    pairs = confident_pairs(history, calibration, splits)
    return pairs.join(median_co_quantities(pairs, means), ["RouteCode", "anchor", "item"])


def basket_lane(
    history_picks: DataFrame,
    already: DataFrame,
    pairs: DataFrame,
    means: DataFrame,
    van: DataFrame,
    calibration: DataFrame,
    names: DataFrame,
    c: Clamps,
) -> DataFrame:
    """Items that go with the customer's history picks and were not picked yet."""
    stocked = pairs.join(
        van.select("RouteCode", F.col("ItemCode").alias("item"), "van_qty"), ["RouteCode", "item"]
    )
    anchors = history_picks.select("RouteCode", "CustomerCode", F.col("ItemCode").alias("anchor"))
    best = (
        anchors.join(stocked, ["RouteCode", "anchor"])
        .groupBy("RouteCode", "CustomerCode", F.col("item").alias("ItemCode"), "van_qty")
        .agg(F.min(F.struct((-F.col("confidence")).alias("_neg"), "anchor", "confidence")).alias("_b"))
        .select("RouteCode", "CustomerCode", "ItemCode", "van_qty", "_b.anchor", "_b.confidence")
        .join(already.select(*PAIR), PAIR, "left_anti")
    )
    top = first_ranked(
        best, ["RouteCode", "CustomerCode"], [F.desc("confidence"), F.asc("ItemCode")],
        c.basket_top_k, "basket_rank",
    )
    medians = median_co_quantities(
        top.select("RouteCode", "anchor", F.col("ItemCode").alias("item")), means
    ).withColumnRenamed("item", "ItemCode")
    labels = names.select("RouteCode", F.col("ItemCode").alias("anchor"),
                          F.col("ItemName").alias("anchor_name"))
    limits = calibration.select("RouteCode", "tier_consider", "tier_should_stock")
    rows = (
        top.join(medians, ["RouteCode", "anchor", "ItemCode"], "left")
        .join(labels, ["RouteCode", "anchor"], "left")
        .join(limits, "RouteCode")
        .withColumn("median_qty", F.greatest(F.lit(1.0), F.coalesce("median_qty", F.lit(1.0))))
    )
    qty = F.least(F.col("van_qty"), py_round("median_qty").cast("int"))
    return _candidate(
        rows.filter(qty > 0), "basket", qty=qty,
        priority=py_round(between_tiers(F.col("confidence")), 2), avg_qty=F.col("median_qty"),
        frequency_pct=py_round(F.col("confidence") * 100, 1),
        item_signals=ex.basket_signals(F.coalesce("anchor_name", "anchor")),
        qty_signals=ex.basket_qty_signals(),
    )


def customer_activity(history: DataFrame, targets: DataFrame, date: str) -> DataFrame:
    """Lines and days since the last purchase of planned customers with history."""
    return (
        history.join(targets, ["RouteCode", "CustomerCode"], "left_semi")
        .groupBy("RouteCode", "CustomerCode")
        .agg(
            F.datediff(F.lit(date).cast("date"), F.max("TrxDate")).alias("days_since"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def _starter_qty(c: Clamps) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(c.seed_qty), F.col("van_qty")))


def reactivation_lane(
    activity: DataFrame, top_items: DataFrame, calibration: DataFrame, c: Clamps
) -> DataFrame:
    """Top van items for customers silent longer than the route's dormancy."""
    limits = calibration.select("RouteCode", "dormancy_days", "tier_consider")
    silent = activity.join(limits, "RouteCode").filter(
        F.col("days_since") > F.col("dormancy_days")
    )
    rows = silent.join(top_items, "RouteCode")
    qty = _starter_qty(c)
    return _candidate(
        rows, "reactivation", qty=qty, priority=py_round("tier_consider", 2), avg_qty=qty,
        days_since=F.col("days_since"), pattern_quality=F.lit(0.4),
        purchase_count=F.col("lines"), churn_probability=F.lit(0.5),
        item_signals=ex.reactivation_signals(), qty_signals=ex.seed_qty_signals(qty),
    )


def seed_lane(
    targets: DataFrame, activity: DataFrame, top_items: DataFrame, calibration: DataFrame,
    c: Clamps,
) -> DataFrame:
    """Top van items for planned customers without any history."""
    limits = calibration.select("RouteCode", "tier_consider")
    new = targets.join(activity, ["RouteCode", "CustomerCode"], "left_anti")
    rows = new.join(top_items, "RouteCode").join(limits, "RouteCode")
    qty = _starter_qty(c)
    return _candidate(
        rows, "seed", qty=qty, priority=py_round("tier_consider", 2), avg_qty=qty,
        churn_probability=F.lit(0.5),
        item_signals=ex.first_visit_signals(), qty_signals=ex.seed_qty_signals(qty),
    )
