"""Visit supervision: sessions, scores, redistribution of unsold stock, replay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.config import SUPERVISION, SupervisionConfig
from vanflow.functions.numeric import first_ranked, py_round

SESSION = ["session_id", "route_code", "date"]
CUSTOMER = [*SESSION, "customer_code"]
ITEM_FIELDS = (
    "item_code", "item_name", "recommended_qty", "adjustment", "actual_qty", "was_sold",
    "was_edited", "tier", "priority_score", "days_since_last_purchase", "purchase_cycle_days",
    "frequency_percent", "van_inventory_qty",
)


def build_session_items(recs: DataFrame) -> DataFrame:
    """Open sessions, one per route and day, from published recommendations."""
    zero = F.lit(0)
    return recs.filter(F.trim(F.coalesce("CustomerCode", F.lit(""))) != "").select(
        F.concat_ws("_", "RouteCode", "TrxDate").alias("session_id"),
        F.col("RouteCode").alias("route_code"), F.col("TrxDate").alias("date"),
        F.col("CustomerCode").alias("customer_code"), F.col("CustomerName").alias("customer_name"),
        F.col("ItemCode").alias("item_code"), F.col("ItemName").alias("item_name"),
        F.coalesce("RecommendedQuantity", zero).cast("int").alias("recommended_qty"),
        zero.alias("adjustment"), zero.alias("actual_qty"),
        F.lit(False).alias("was_sold"), F.lit(False).alias("was_edited"),
        F.col("Tier").alias("tier"), F.col("PriorityScore").alias("priority_score"),
        F.col("DaysSinceLastPurchase").alias("days_since_last_purchase"),
        F.col("PurchaseCycleDays").alias("purchase_cycle_days"),
        F.col("FrequencyPercent").alias("frequency_percent"),
        F.col("VanLoad").alias("van_inventory_qty"),
        F.lit(False).alias("visited"), zero.alias("visit_sequence"),
    )


def nest_customers(items: DataFrame) -> DataFrame:
    """Items nested under their customer."""
    item = F.struct(*[F.col(c) for c in ITEM_FIELDS])
    return items.groupBy(*CUSTOMER).agg(
        F.max("customer_name").alias("customer_name"), F.max("visited").alias("visited"),
        F.max("visit_sequence").alias("visit_sequence"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )


def effective() -> Column:
    return F.col("recommended_qty") + F.col("adjustment")


def item_accuracy(actual: Column, recommended: Column, cfg: SupervisionConfig = SUPERVISION) -> Column:
    """100 inside the accuracy zone, linear to 0 below it and up to the upper limit."""
    ratio = actual / recommended
    over = (ratio - cfg.perfect_high) / (cfg.max_over - cfg.perfect_high)
    return (
        F.when(recommended <= 0, F.when(actual == 0, 100.0).otherwise(0.0))
        .when(actual == 0, 0.0)
        .when(ratio.between(cfg.perfect_low, cfg.perfect_high), 100.0)
        .when(ratio < cfg.perfect_low, py_round(ratio / cfg.perfect_low * 100, 1))
        .when(ratio <= cfg.max_over, py_round(F.greatest(F.lit(0.0), 100.0 - over * 100), 1))
        .otherwise(0.0)
    )


def _mean_of_tenths(value: str) -> Column:
    """Mean of one-decimal values rounded to one decimal; summed in whole tenths."""
    tenths = F.sum(F.rint(F.col(value) * 10))
    return F.rint(tenths / F.count(value)) / 10


def _rate(num: Column, den: Column) -> Column:
    return py_round(num / F.greatest(den, F.lit(1)) * 100, 1)


def customer_scores(items: DataFrame, cfg: SupervisionConfig = SUPERVISION) -> DataFrame:
    """Coverage, accuracy and score of every customer of a session."""
    acc = item_accuracy(F.col("actual_qty"), effective(), cfg)
    n = F.count(F.lit(1))
    sold = F.count(F.when(F.col("was_sold"), 1))
    per = items.withColumn("_acc", acc).groupBy(*CUSTOMER).agg(
        F.max("visited").alias("visited"), F.max("visit_sequence").alias("visit_sequence"),
        n.alias("total_items"), sold.alias("items_sold"),
        F.sum(effective()).alias("total_recommended"), F.sum("actual_qty").alias("total_actual"),
        py_round(sold / n * 100, 1).alias("coverage"), _mean_of_tenths("_acc").alias("accuracy"),
    )
    score = cfg.coverage_weight * F.col("coverage") + cfg.accuracy_weight * F.col("accuracy")
    return per.withColumn("score", py_round(score, 1))


def route_scores(scores: DataFrame) -> DataFrame:
    """Mean score of visited customers, customer coverage and quantity fulfilment."""
    seen = F.col("visited")
    visited = F.count(F.when(seen, 1))
    mean = F.rint(F.sum(F.when(seen, F.rint(F.col("score") * 10))) / visited) / 10
    rec = F.sum(F.when(seen, F.col("total_recommended")).otherwise(0))
    act = F.sum(F.when(seen, F.col("total_actual")).otherwise(0))
    none = visited == 0
    return scores.groupBy(*SESSION).agg(
        F.when(none, 0.0).otherwise(mean).alias("route_score"),
        F.when(none, 0.0).otherwise(_rate(visited, F.count(F.lit(1)))).alias("customer_coverage"),
        F.when(none, 0.0).otherwise(_rate(act, rec)).alias("qty_fulfillment"),
    )


def apply_visits(items: DataFrame, visits: DataFrame, sales: DataFrame) -> DataFrame:
    """Write invoiced quantities onto the planned items of visited customers.

    ``visits`` orders the stops of a session (session_id, customer_code,
    visit_order); ``sales`` is the day's invoices. Customers already visited
    keep their sequence number.
    """
    known = items.groupBy("session_id").agg(
        F.max(F.when(F.col("visited"), F.col("visit_sequence"))).alias("_done")
    )
    fresh = items.filter(~F.col("visited")).select("session_id", "customer_code").distinct()
    order = Window.partitionBy("session_id").orderBy("visit_order", "customer_code")
    stops = visits.join(fresh, ["session_id", "customer_code"], "left_semi").join(known, "session_id")
    # A customer's later stops overwrite quantities but keep the number of the first.
    stops = stops.groupBy("session_id", "customer_code", "_done").agg(F.min("visit_order").alias("visit_order"))
    numbered = stops.select(
        "session_id", "customer_code",
        (F.coalesce("_done", F.lit(0)) + F.row_number().over(order)).alias("_seq"),
    ).repartition("customer_code")  # sessions are few: items are not to be sent after them
    again = visits.select("session_id", "customer_code", F.lit(True).alias("_stop")).distinct()
    again = again.join(numbered, ["session_id", "customer_code"], "left")
    sold = sales.groupBy(
        F.col("RouteCode").alias("route_code"), F.col("TrxDate").alias("date"),
        F.col("CustomerCode").alias("customer_code"), F.col("ItemCode").alias("item_code"),
    ).agg(F.sum("TotalQuantity").cast("int").alias("_sold"))
    joined = (
        items.join(again, ["session_id", "customer_code"], "left")
        .join(sold, ["route_code", "date", "customer_code", "item_code"], "left")
    )
    stop = F.col("_stop").isNotNull()
    qty = F.coalesce("_sold", F.lit(0))
    out = joined.withColumns(
        {
            "actual_qty": F.when(stop, qty).otherwise(F.col("actual_qty")),
            "was_sold": F.when(stop, qty > 0).otherwise(F.col("was_sold")),
            "was_edited": F.col("was_edited") | (stop & F.col("_sold").isNotNull()),
            "visited": F.col("visited") | stop,
            "visit_sequence": F.coalesce("_seq", "visit_sequence"),
            "unsold": F.when(stop, F.greatest(effective() - qty, F.lit(0))).otherwise(F.lit(0)),
        }
    )
    return out.select(*items.columns, "unsold")


def _tier_rank(cfg: SupervisionConfig) -> Column:
    branches = None
    for i, name in enumerate(cfg.tier_order):
        cond = F.col("tier") == name
        branches = F.when(cond, i) if branches is None else branches.when(cond, i)
    return branches.otherwise(99)


def max_addition(cfg: SupervisionConfig) -> Column:
    half = F.floor(F.col("recommended_qty") * cfg.max_increase).cast("int")
    return F.greatest(F.lit(1), half)


def redistribute(items: DataFrame, unsold: DataFrame, cfg: SupervisionConfig = SUPERVISION) -> DataFrame:
    """Hand one visit's unsold units to unvisited customers holding the item.

    ``unsold`` has one row per session and item: from_customer and quantity.
    Recipients are the best five by tier and priority; each takes at most half
    its own recommendation (at least one unit) of what those before it left.
    """
    keys = ["session_id", "item_code"]
    holders = (
        items.filter(~F.col("visited")).join(unsold.filter("unsold > 0"), keys)
        .filter(F.col("customer_code") != F.col("from_customer"))
        .withColumns({"tier_rank": _tier_rank(cfg), "max_add": max_addition(cfg)})
    )
    order = [F.asc("tier_rank"), F.desc("priority_score"), F.asc("customer_code")]
    chosen = first_ranked(holders, keys, order, cfg.max_recipients, "recipient_rank")
    before = Window.partitionBy(*keys).orderBy("recipient_rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.col("unsold") - F.coalesce(F.sum("max_add").over(before), F.lit(0))
    given = F.greatest(F.lit(0), F.least(left, F.col("max_add"))).cast("int")
    return chosen.withColumn("quantity", given).filter("quantity > 0").select(
        "session_id", "from_customer", F.col("customer_code").alias("to_customer"), "item_code",
        "item_name", "quantity",
        F.concat(F.lit("Unsold by "), "from_customer", F.lit(", tier="), "tier").alias("reason"),
    )


NOT_VISITED = np.iinfo(np.int64).max


def replay_item(
    rec: np.ndarray, adj: np.ndarray, act: np.ndarray, seq: np.ndarray,
    cfg: SupervisionConfig = SUPERVISION,
) -> tuple[np.ndarray, np.ndarray]:
    """Adjustments and unsold units of one item of one session after all its visits.

    Arrays hold the item's customers in recipient order; ``seq`` is the visit
    number, ``NOT_VISITED`` for customers without a visit.
    """
    adj = adj.copy()
    cap = np.maximum(1, (rec * cfg.max_increase).astype(np.int64))
    unsold = np.zeros(len(rec), dtype=np.int64)
    n = len(rec)
    following, previous = [*range(1, n + 1), 0], [n, *range(n)]  # waiting holders, a ring closed by place n
    visits = np.argsort(seq, kind="stable")[: np.count_nonzero(seq != NOT_VISITED)].tolist()
    gone = 0
    for i in visits:
        while gone < len(visits) and seq[visits[gone]] <= seq[i]:
            j = visits[gone]
            following[previous[j]], previous[following[j]] = following[j], previous[j]
            gone += 1
        left = unsold[i] = max(0, rec[i] + adj[i] - act[i])
        j, passed = following[n], 0
        while left > 0 and j != n and passed < cfg.max_recipients:
            give = min(left, cap[j])
            adj[j] += give
            left -= give
            j, passed = following[j], passed + 1
    return adj, unsold


def replay_sessions(items: DataFrame, cfg: SupervisionConfig = SUPERVISION) -> DataFrame:
    """Sequential replay: later visits see the adjustments of earlier ones.

    Items never influence each other, so the sequential unit is one item of one
    session, at most a day's stops. Units are packed into arrays and replayed
    by the Arrow batch.
    """
    keys = ["session_id", "item_code"]
    rest = [c for c in items.columns if c not in (*keys, "adjustment", "unsold")]
    row = F.struct(
        _tier_rank(cfg).alias("_tier"), (-F.col("priority_score")).alias("_score"),
        F.col("customer_code").alias("_customer"), "adjustment", *rest,
    )
    packed = items.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    @F.pandas_udf("struct<adjustment:array<int>,unsold:array<int>>")
    def replay(rec: pd.Series, adj: pd.Series, act: pd.Series, seq: pd.Series) -> pd.DataFrame:
        done = [
            replay_item(*(np.asarray(x, dtype=np.int64) for x in unit), cfg)
            for unit in zip(rec, adj, act, seq)
        ]
        return pd.DataFrame({"adjustment": [a for a, _ in done], "unsold": [u for _, u in done]})

    values = lambda f: F.transform("rows", f)
    order = values(lambda r: F.when(r.visited, r.visit_sequence.cast("bigint")).otherwise(
        F.lit(int(NOT_VISITED))))
    result = replay(
        values(lambda r: r.recommended_qty), values(lambda r: r.adjustment),
        values(lambda r: r.actual_qty), order,
    )
    zipped = F.arrays_zip("rows", F.col("_r.adjustment").alias("adjustment"),
                          F.col("_r.unsold").alias("unsold"))
    return (
        packed.withColumn("_r", result)
        .select(*keys, F.explode(zipped).alias("z"))
        .select(*keys, *[F.col(f"z.rows.{c}").alias(c) for c in rest],
                F.col("z.adjustment").alias("adjustment"), F.col("z.unsold").alias("unsold"))
    )


def update_actuals(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Overwrite some actual quantities (session_id, customer_code, item_code, new_qty)."""
    keys = ["session_id", "customer_code", "item_code"]
    joined = items.join(edits.select(*keys, "new_qty"), keys, "left")
    edited = F.col("new_qty").isNotNull()
    return joined.withColumns(
        {
            "actual_qty": F.coalesce("new_qty", "actual_qty"),
            "was_sold": F.when(edited, F.col("new_qty") > 0).otherwise(F.col("was_sold")),
            "was_edited": F.col("was_edited") | edited,
        }
    ).select(*items.columns)


def session_summary(scores: DataFrame) -> DataFrame:
    seen = F.col("visited")
    rec, act = F.sum("total_recommended"), F.sum(F.when(seen, F.col("total_actual")).otherwise(0))
    vrec = F.sum(F.when(seen, F.col("total_recommended")).otherwise(0))
    n, visited = F.count(F.lit(1)), F.count(F.when(seen, 1))
    return scores.groupBy(*SESSION).agg(
        n.alias("total_customers"), visited.alias("visited_customers"),
        (n - visited).alias("remaining_customers"),
        rec.alias("total_recommended"), act.alias("total_actual"),
        vrec.alias("visited_recommended"),
        _rate(act, vrec).alias("visited_achievement"), _rate(act, rec).alias("overall_achievement"),
    )


def _sold_lines(sales: DataFrame) -> DataFrame:
    return sales.filter("TotalQuantity > 0").select(
        F.col("RouteCode").alias("route_code"), F.col("TrxDate").alias("date"),
        F.trim("CustomerCode").alias("customer_code"), F.trim("ItemCode").alias("item_code"),
        F.col("TotalQuantity").cast("int").alias("qty"),
    ).filter(F.col("customer_code") != "")


def also_bought(items: DataFrame, sales: DataFrame) -> DataFrame:
    """Items planned customers bought outside their plan."""
    stop = ["route_code", "date", "customer_code"]
    return (
        _sold_lines(sales).join(items, stop, "left_semi")
        .join(items, [*stop, "item_code"], "left_anti")
    )


def unplanned_visits(items: DataFrame, sales: DataFrame) -> DataFrame:
    """Customers invoiced on a session's route and day without being planned."""
    lines = _sold_lines(sales).join(items, ["route_code", "date"], "left_semi")
    return (
        lines.join(items, ["route_code", "date", "customer_code"], "left_anti")
        .groupBy("route_code", "date", "customer_code")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("qty").alias("total_qty"))
    )


def live_split(items: DataFrame, sales: DataFrame) -> DataFrame:
    """Planned, live and unplanned customer counts per session."""
    stop = ["route_code", "date", "customer_code"]
    planned = items.select(*stop).distinct().withColumn("_p", F.lit(1))
    live = _sold_lines(sales).join(items, ["route_code", "date"], "left_semi").select(
        *stop).distinct().withColumn("_l", F.lit(1))
    joined = planned.join(live, stop, "full_outer")
    return joined.groupBy("route_code", "date").agg(
        F.count("_p").alias("planned_count"), F.count("_l").alias("live_count"),
        F.count(F.when(F.col("_p").isNull(), 1)).alias("unplanned_count"),
        F.count(F.when(F.col("_p").isNotNull() & F.col("_l").isNotNull(), 1)).alias("planned_visited"),
    )


def session_counts(items: DataFrame, today: str) -> DataFrame:
    day = F.col("date") == F.lit(today).cast("date")
    return items.agg(
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct(F.when(day, F.col("session_id"))).alias("today_sessions"),
    )
