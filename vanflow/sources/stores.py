"""Partitioned stores: recommendations, forecasts, sessions, artifacts, run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanflow.functions.numeric import py_round
from vanflow.functions.text import clean_code
from vanflow.operators.explain import SIGNALS_TYPE
from vanflow.operators.supervision import CUSTOMER, ITEM_FIELDS, SESSION
from vanflow.sources import slices
from vanflow.sources.imports import FORECAST_COLUMNS

ARTIFACTS = (
    "test_predictions", "future_forecast", "model_metrics", "training_summary",
    "pair_model_lookup", "pair_classes", "pair_explainability",
)

# published recommendation column -> result table column
RECOMMENDATION_COLUMNS = {
    "TrxDate": "trx_date", "RouteCode": "route_code", "CustomerCode": "customer_code",
    "CustomerName": "customer_name", "ItemCode": "item_code", "ItemName": "item_name",
    "RecommendedQuantity": "recommended_quantity", "Tier": "tier", "VanLoad": "van_load",
    "PriorityScore": "priority_score", "AvgQuantityPerVisit": "avg_quantity_per_visit",
    "DaysSinceLastPurchase": "days_since_last_purchase", "PurchaseCycleDays": "purchase_cycle_days",
    "FrequencyPercent": "frequency_percent", "ChurnProbability": "churn_probability",
    "PatternQuality": "pattern_quality", "PurchaseCount": "purchase_count",
    "TrendFactor": "trend_factor",
}

# analytic forecast column -> result table column, with the value of absent ones
FORECAST_RESULTS = {
    "TrxDate": ("trx_date", None), "RouteCode": ("route_code", ""), "ItemCode": ("item_code", ""),
    "ItemName": ("item_name", ""), "class": ("demand_class", ""), "best_model": ("model_used", ""),
    "prediction": ("predicted", 0.0), "p_demand": ("p_demand", 0.0),
    "qty_if_demand": ("qty_if_demand", 0.0), "TotalQuantity": ("actual_qty", 0.0),
    "q_10": ("lower_bound", 0.0), "q_90": ("upper_bound", 0.0), "adi": ("adi", None),
    "cv2": ("cv2", None), "nonzero_ratio": ("nonzero_ratio", None), "mean_qty": ("mean_qty", None),
    "avg_gap_between_demand": ("avg_gap_days", None),
}


def replace_slices(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace exactly the slices the frame touches; until the switch readers see the former ones."""
    slices.replace(df, path, partition_by)


def read_store(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return slices.read(spark, path, schema)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a database table in batches of a thousand rows."""
    df.write.format("jdbc").mode("append").options(
        url=url, dbtable=table, batchsize="1000", **options
    ).save()


def stored_routes(store: DataFrame, date: str) -> DataFrame:
    """Routes that already have recommendations for a date."""
    return store.filter(F.col("TrxDate") == F.lit(date).cast("date")).select("RouteCode").distinct()


def generation_info(store: DataFrame) -> DataFrame:
    return store.groupBy("TrxDate").agg(
        F.count(F.lit(1)).alias("total_records"), F.countDistinct("RouteCode").alias("routes_count"),
        F.countDistinct("CustomerCode").alias("customers_count"),
        F.countDistinct("ItemCode").alias("items_count"),
    )


def retrieve(
    store: DataFrame, date: str, route: str | None = None, customer: str | None = None,
    item: str | None = None, tier: str | None = None, min_priority: float | None = None,
    offset: int = 0, limit: int | None = None,
) -> DataFrame:
    """Filtered page of a date's recommendations with clean types and decoded signals."""
    out = store.filter(F.col("TrxDate") == F.lit(date).cast("date"))
    for column, value in (
        ("RouteCode", route), ("CustomerCode", customer), ("ItemCode", item), ("Tier", tier),
    ):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if min_priority is not None:
        out = out.filter(F.col("PriorityScore") >= min_priority)
    out = out.orderBy("RouteCode", "CustomerCode", F.desc("PriorityScore"), "ItemCode").offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return decode(out)


def decode(rows: DataFrame) -> DataFrame:
    """Codes as trimmed strings, missing texts empty, signals as an array of structs."""
    empty = F.lit("")
    out = rows.withColumns({c: clean_code(c) for c in ("RouteCode", "CustomerCode", "ItemCode")})
    texts = ("CustomerName", "ItemName", "WhyItem", "WhyQuantity", "Source")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), empty) for c in texts})
    signals = F.coalesce(
        F.from_json(F.col("Signals"), SIGNALS_TYPE), F.array().cast(SIGNALS_TYPE)
    ) if dict(rows.dtypes)["Signals"] == "string" else F.col("Signals")
    return out.withColumns(
        {"Signals": signals,
         "Confidence": F.coalesce(F.col("Confidence").cast("double"), F.lit(0.0))}
    )


def store_summary(store: DataFrame, routes_configured: int) -> DataFrame:
    """Key figures of the latest stored date."""
    latest = store.agg(F.max("TrxDate")).scalar()
    return store.filter(F.col("TrxDate") == latest).agg(
        F.max("TrxDate").alias("last_generated_date"),
        F.count(F.lit(1)).alias("total_recs_latest_date"),
        F.countDistinct("RouteCode").alias("routes_with_recs_latest"),
        F.countDistinct("CustomerCode").alias("customers_latest"),
    ).withColumn("routes_configured", F.lit(routes_configured))


def missing_routes(journey: DataFrame, store: DataFrame, date: str) -> DataFrame:
    """Planned routes of a date without stored recommendations."""
    planned = journey.filter(F.col("JourneyDate") == F.lit(date).cast("date")).select(
        clean_code("RouteCode").alias("RouteCode")).dropna().distinct()
    return planned.join(stored_routes(store, date), "RouteCode", "left_anti")


def forecast_result_rows(predictions: DataFrame, split: str) -> DataFrame:
    """Predictions in the layout of the forecast result table."""
    present = set(predictions.columns)

    def value(name: str, default) -> Column:
        if name == "best_model" and "model_used" in present:
            return F.col("model_used")
        return F.col(name) if name in present else F.lit(default)

    types = {"trx_date": "date", "route_code": "string", "item_code": "string",
             "item_name": "string", "demand_class": "string", "model_used": "string"}
    columns = {
        target: value(name, default).cast(types.get(target, "double"))
        for name, (target, default) in FORECAST_RESULTS.items()
    }
    columns["data_split"] = F.lit(split.capitalize())
    return predictions.select(*[columns[c].alias(c) for c in FORECAST_COLUMNS])


def recommendation_result_rows(rows: DataFrame, generated_by: str = "API") -> DataFrame:
    """Recommendations in the layout of the result table, reasons included."""
    decimals = {
        "priority_score": "decimal(6,2)", "purchase_cycle_days": "decimal(10,2)",
        "frequency_percent": "decimal(6,2)", "churn_probability": "decimal(5,3)",
        "pattern_quality": "decimal(5,3)", "trend_factor": "decimal(4,2)",
    }
    mapped = [
        F.col(a).cast(decimals[b]).alias(b) if b in decimals else F.col(a).alias(b)
        for a, b in RECOMMENDATION_COLUMNS.items()
    ]
    return rows.select(
        *mapped, F.col("Source").alias("reason_status"), F.col("WhyItem").alias("reason_explanation"),
        F.col("Confidence").cast("decimal(5,3)").alias("reason_confidence"),
        F.lit(generated_by).alias("generated_by"),
    )


# ---- supervision sessions -------------------------------------------------------------------


RECORD = (
    "customer_name", "visited", "visit_sequence", "score", "coverage", "accuracy", "total_items", "items_sold",
    "total_recommended", "total_actual", "items",
)


def session_records(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per (session, customer) with its figures and items: what is stored of a session."""
    numbers = scores.select(*CUSTOMER, *RECORD[3:-1])
    return customers.join(numbers, CUSTOMER).select(*CUSTOMER, *RECORD)


def nest_records(records: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Documents on request: one row per session with a map of customer code to record.

    A document grows with its route, so ask for the sessions that are to be shown.
    """
    record = F.struct(*[c for c in records.columns if c not in (*CUSTOMER, *keys)])
    return records.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("customer_code", record))).alias("customers")
    )


def nest_sessions(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per session with a map of customer code to its nested record."""
    return nest_records(session_records(customers, scores))


def write_session_records(records: DataFrame, path: str, in_place: bool = False) -> None:
    """Records in one slice per route and day; rewriting a day replaces it whole.

    Records read from such a store lie by slice and are written back `in_place`.
    """
    keyed = records.withColumns({"p_route": F.col("route_code"), "p_date": F.col("date")})
    slices.replace(keyed, path, ["p_route", "p_date"], in_place=in_place)


def read_session_records(
    spark: SparkSession, path: str, route: str | None = None, date: str | None = None
) -> DataFrame:
    """Stored records, of one route or day only where given: other folders are not read."""
    where = F.lit(True)
    if route is not None:
        where &= F.col("p_route") == route
    if date is not None:
        where &= F.col("p_date") == F.lit(date).cast("date")
    return slices.read(spark, path, where=where).drop("p_route", "p_date")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """JSON documents, one folder per route and day; rewriting a day replaces it.

    Sessions come nested or as records. A line holds one customer's record, as
    a session's whole document grows with its route; lines are packed.
    """
    if "customers" in sessions.columns:
        lines = sessions.select(*SESSION, F.explode_outer("customers").alias("customer_code", "record"))
    else:
        record = F.struct(*[c for c in sessions.columns if c not in CUSTOMER])
        lines = sessions.select(*CUSTOMER, record.alias("record"))
    keyed = lines.withColumns({"p_route": F.col("route_code"), "p_date": F.col("date")})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(
        "p_route", "p_date").json(path)


def read_sessions(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored sessions, nested as `schema` says; lines that do not parse are dropped."""
    record = schema["customers"].dataType.valueType
    line = T.StructType([*(schema[c] for c in SESSION), T.StructField("customer_code", T.StringType()), T.StructField("record", record)])
    read = spark.read.schema(line).option("mode", "DROPMALFORMED").json(path).filter(F.col("session_id").isNotNull())
    entry = F.when(F.col("customer_code").isNotNull(), F.struct("customer_code", "record"))
    return read.groupBy(*SESSION).agg(F.map_from_entries(F.collect_list(entry)).alias("customers"))


def list_sessions(items: DataFrame) -> DataFrame:
    return items.select(*SESSION).distinct()


def unnest_sessions(sessions: DataFrame) -> DataFrame:
    """Item rows of nested sessions; planned customers without a visit keep one row without item."""
    customer = sessions.select(*SESSION, F.explode("customers").alias("customer_code", "c"))
    return customer.select(
        *CUSTOMER, F.col("c.visited").alias("visited"),
        F.explode_outer(F.when(F.col("c.visited"), F.col("c.items"))).alias("i"),
    ).select(
        *CUSTOMER, "visited", F.coalesce("i.item_code", F.lit("")).alias("item_code"),
        F.coalesce("i.actual_qty", F.lit(0)).alias("actual_qty"),
        F.coalesce("i.was_sold", F.lit(False)).alias("was_sold"),
        F.coalesce("i.was_edited", F.lit(False)).alias("was_edited"),
    )


def _share(num: str, den: str) -> Column:
    return py_round(F.col(num) / F.greatest(F.col(den), F.lit(1)) * 100, 1)


def session_route_rows(summary: DataFrame, routes: DataFrame, started_at: Column) -> DataFrame:
    """Route-level result rows; the route score is kept apart from the achievement."""
    return summary.join(routes.select(*SESSION, "route_score"), SESSION).select(
        "session_id", "route_code", F.col("date").alias("supervision_date"),
        F.col("total_customers").alias("total_customers_planned"),
        F.col("visited_customers").alias("total_customers_visited"),
        _share("visited_customers", "total_customers").alias("customer_completion_rate"),
        F.col("total_recommended").alias("total_qty_recommended"),
        F.col("total_actual").alias("total_qty_actual"),
        _share("total_actual", "total_recommended").alias("qty_fulfillment_rate"),
        F.col("route_score").alias("route_performance_score"), "visited_achievement",
        F.lit("closed").alias("session_status"), started_at.alias("session_started_at"),
    )


def session_customer_rows(scores: DataFrame) -> DataFrame:
    return scores.filter("visited").select(
        "session_id", "customer_code", "visit_sequence",
        F.col("total_items").alias("total_skus_recommended"), F.col("items_sold").alias("total_skus_sold"),
        F.col("coverage").alias("sku_coverage_rate"),
        F.col("total_recommended").alias("total_qty_recommended"),
        F.col("total_actual").alias("total_qty_actual"),
        _share("total_actual", "total_recommended").alias("qty_fulfillment_rate"),
        F.col("score").alias("customer_performance_score"),
    )


def session_item_rows(items: DataFrame) -> DataFrame:
    return items.filter("visited").select(
        "session_id", "customer_code", "item_code", "item_name",
        F.col("recommended_qty").alias("original_recommended_qty"),
        (F.col("recommended_qty") + F.col("adjustment")).alias("adjusted_recommended_qty"),
        F.col("adjustment").alias("recommendation_adjustment"), "actual_qty",
        F.col("was_edited").cast("int").alias("was_manually_edited"),
        F.col("was_sold").cast("int").alias("was_item_sold"),
        F.col("tier").alias("recommendation_tier"), "priority_score", "van_inventory_qty",
        "days_since_last_purchase", "purchase_cycle_days",
        F.col("frequency_percent").alias("purchase_frequency_pct"),
    )


def latest_sessions(route_rows: DataFrame) -> DataFrame:
    """The session that started last per route and day."""
    w = Window.partitionBy("route_code", "supervision_date").orderBy(
        F.desc("session_started_at"), F.desc("session_id"))
    return route_rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rebuild_records(customer_rows: DataFrame, item_rows: DataFrame) -> DataFrame:
    """One row per (session, customer) from the result tables.

    The original quantity is restored, so the adjustment is not counted twice.
    """
    item = F.struct(
        "item_code", "item_name", F.col("original_recommended_qty").alias("recommended_qty"),
        F.col("recommendation_adjustment").alias("adjustment"), "actual_qty",
        (F.col("was_item_sold") == 1).alias("was_sold"),
        (F.col("was_manually_edited") == 1).alias("was_edited"),
        F.col("recommendation_tier").alias("tier"), "priority_score", "days_since_last_purchase",
        "purchase_cycle_days", F.col("purchase_frequency_pct").alias("frequency_percent"),
        "van_inventory_qty",
    )
    nested = item_rows.groupBy("session_id", "customer_code").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return customer_rows.join(nested, ["session_id", "customer_code"], "left").select(
        "session_id", "customer_code", F.lit(True).alias("visited"), "visit_sequence",
        F.col("customer_performance_score").alias("score"),
        F.col("sku_coverage_rate").alias("coverage"),
        F.col("qty_fulfillment_rate").alias("accuracy"),
        F.col("total_skus_recommended").alias("total_items"),
        F.col("total_skus_sold").alias("items_sold"),
        F.col("total_qty_recommended").alias("total_recommended"),
        F.col("total_qty_actual").alias("total_actual"), "items",
    )


def rebuild_sessions(
    route_rows: DataFrame, customer_rows: DataFrame, item_rows: DataFrame
) -> DataFrame:
    """Nested sessions from the three result tables, the latest of each route and day."""
    customers = nest_records(rebuild_records(customer_rows, item_rows), ["session_id"])
    return latest_sessions(route_rows).join(customers, "session_id", "left")


# ---- artifacts and run metrics --------------------------------------------------------------


def write_artifact(df: DataFrame, base: str, name: str) -> None:
    if name not in ARTIFACTS:
        raise ValueError(f"unknown artifact {name}")
    slices.replace(df, f"{base}/{name}")


def read_artifact(
    spark: SparkSession, base: str, name: str, route: str | None = None, item: str | None = None,
    demand_class: str | None = None, order: Sequence[str] = ("RouteCode", "ItemCode"),
    offset: int = 0, limit: int | None = None,
) -> DataFrame:
    if name not in ARTIFACTS:
        raise ValueError(f"unknown artifact {name}")
    return filter_artifact(
        slices.read(spark, f"{base}/{name}"), route, item, demand_class, order, offset, limit
    )


def filter_artifact(
    df: DataFrame, route: str | None = None, item: str | None = None,
    demand_class: str | None = None, order: Sequence[str] = ("RouteCode", "ItemCode"),
    offset: int = 0, limit: int | None = None,
) -> DataFrame:
    """Route, item and class filters with stable paging."""
    for column, value in (("RouteCode", route), ("ItemCode", item), ("class", demand_class)):
        if value is not None and column in df.columns:
            df = df.filter(F.col(column) == value)
    if offset or limit is not None:
        df = df.orderBy(*[c for c in order if c in df.columns]).offset(offset)
    return df if limit is None else df.limit(limit)


def generation_metric_rows(metrics: DataFrame, fallback: DataFrame, date: str, run_at: str) -> DataFrame:
    """Per-run, per-lane metric rows ready to append."""
    return metrics.join(
        fallback.select("RouteCode", F.col("fallback").alias("calibration_fallback")), "RouteCode"
    ).select(
        F.lit(run_at).alias("timestamp"), F.lit(date).cast("date").alias("date"),
        F.col("RouteCode").alias("route"), F.col("source").alias("gen"), "candidates", "kept",
        "source_pct", "similarity_avg", "calibration_fallback",
    )


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("date").parquet(path)


def flat_items(sessions: DataFrame) -> DataFrame:
    """All item fields of nested sessions, one row per item."""
    customer = sessions.select(*SESSION, F.explode("customers").alias("customer_code", "c"))
    return customer.select(
        *CUSTOMER, F.col("c.visited").alias("visited"),
        F.col("c.visit_sequence").alias("visit_sequence"), F.explode("c.items").alias("i"),
    ).select(*CUSTOMER, "visited", "visit_sequence", *[F.col(f"i.{c}").alias(c) for c in ITEM_FIELDS])
