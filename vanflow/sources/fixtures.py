"""Business tables derived from the driver's TPC-H-like tables.

The derivations are plain arithmetic, so the DuckDB side can state them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanflow.session import cut_lineage, prepare, rows_in_place
from vanflow.sources import imports

TARGET = "2001-07-02"
EVENT_TARGET = "2024-01-31"
PLAN_DAYS = 28


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def raw_sales(spark: SparkSession, sf: str, route: str = "region", item: str = "brand", keep: tuple[str, ...] = ()) -> DataFrame:
    """Order lines as sales-view rows; route is nation or region, item brand or type; `keep` names further source columns."""
    line = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    part = table(spark, sf, "part")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "CustomerCode", F.col("c_custkey").cast("string"))
    # Customers come last and by their code: narrow rows move to them, and groups by customer are then made where the rows lie.
    joined = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(buyers.hint("shuffle_hash"), F.col("o_custkey").cast("string") == F.col("CustomerCode"))
    )
    item_col = F.col(f"p_{item}")
    return joined.select(
        F.to_date("o_orderdate").alias("TrxDate"),
        F.col(f"n_{route}key").cast("string").alias("RouteCode"),
        "CustomerCode",
        F.col("c_name").alias("CustomerName"),
        item_col.alias("ItemCode"),
        item_col.alias("ItemName"),
        F.col("p_type").alias("CategoryCode"),
        F.col("p_type").alias("CategoryName"),
        F.col("n_regionkey").cast("string").alias("WarehouseCode"),
        F.col("r_name").alias("WarehouseName"),
        F.when(F.round(F.col("l_tax") * 100).cast("int") == 8, "FreeItem")
        .otherwise("OrderItem").alias("ItemType"),
        F.when(F.col("o_orderstatus") == "P", "Quotation")
        .otherwise("SalesInvoice").alias("TrxType"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity"))
        .otherwise(F.col("l_quantity")).alias("QuantityInPCs"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
        *keep,
    ).select(*imports.RAW_SALES.fieldNames(), *keep)


def event_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sales rows with dense per-customer histories; ``ts`` is the event time."""
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("TrxDate"),
        (F.col("user_id") % 5).cast("string").alias("RouteCode"),
        F.col("user_id").cast("string").alias("CustomerCode"),
        F.col("event_type").alias("ItemCode"),
        F.col("value").alias("QuantityInPCs"),
    )


def sales_recent(spark, sf, route="region", item="brand") -> DataFrame:
    return imports.sales_recent(raw_sales(spark, sf, route, item))


def customer_data(spark, sf, route="region", item="brand") -> DataFrame:
    return imports.customer_data(raw_sales(spark, sf, route, item))


def history(spark, sf, route="region", item="brand") -> DataFrame:
    """Purchases known before the target date."""
    return imports.purchases_only(customer_data(spark, sf, route, item)).filter(
        F.col("TrxDate") < F.lit(TARGET).cast("date")
    )


def journey(spark: SparkSession, sf: str, first: str = "2001-06-02", days: int = 60) -> DataFrame:
    """Customer is planned on day d when (key * 7 + day number) mod 10 < 3."""
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    start = F.lit(first).cast("date")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.explode(F.sequence(start, F.date_add(start, days - 1))).alias("JourneyDate"),
            F.col("n_regionkey").cast("string").alias("RouteCode"),
            F.col("c_custkey").alias("_key"),
        )
        .filter(
            (F.col("_key") * 7 + F.datediff("JourneyDate", F.lit("1995-01-01").cast("date"))) % 10
            < 3
        )
        .select("JourneyDate", "RouteCode", F.col("_key").cast("string").alias("CustomerCode"))
    )


def forecast_results(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast result rows: 28 scored days before the target, 14 future days after.

    Future Predicted is the 28-day quantity before the target scaled by day of
    horizon; scored Predicted is the mean daily quantity of the 28 days before.
    """
    day = F.lit(TARGET).cast("date")
    sales = (
        sales_recent(spark, sf)
        .groupBy("TrxDate", "RouteCode", "ItemCode")
        .agg(F.sum("TotalQuantity").alias("q"))
    )
    pairs = sales.filter(F.col("TrxDate") < day).groupBy("RouteCode", "ItemCode").agg(
        F.coalesce(
            F.sum(F.when(F.col("TrxDate") >= F.date_sub(day, 28), F.col("q"))), F.lit(0.0)
        ).alias("q28"),
        F.coalesce(
            F.sum(
                F.when(
                    F.col("TrxDate").between(F.date_sub(day, 56), F.date_sub(day, 29)),
                    F.col("q"),
                )
            ),
            F.lit(0.0),
        ).alias("q56"),
    )
    dates = pairs.select(
        "*",
        F.explode(F.sequence(F.date_sub(day, 28), F.date_add(day, 13))).alias("trx_date"),
    )
    step = F.datediff("trx_date", day)
    rows = (
        dates.join(
            sales.withColumnRenamed("TrxDate", "trx_date"),
            ["trx_date", "RouteCode", "ItemCode"],
            "left",
        )
        .withColumn("future", F.col("trx_date") >= day)
        .withColumn(
            "predicted",
            F.when(F.col("future"), F.col("q28") * (10 + step % 7) / 10).otherwise(
                F.col("q56") / 28
            ),
        )
    )
    zero = F.lit(0.0)
    return rows.select(
        "trx_date",
        F.col("RouteCode").alias("route_code"),
        F.col("ItemCode").alias("item_code"),
        F.col("ItemCode").alias("item_name"),
        F.when(F.col("future"), "Forecast").otherwise("Test").alias("data_split"),
        F.lit("intermittent").alias("demand_class"),
        F.lit("moving_average").alias("model_used"),
        "predicted",
        F.when(F.col("predicted") > 0, 1.0).otherwise(0.5).alias("p_demand"),
        F.col("predicted").alias("qty_if_demand"),
        F.when(F.col("future"), F.lit(None).cast("double"))
        .otherwise(F.coalesce("q", zero)).alias("actual_qty"),
        (F.col("predicted") * 0.5).alias("lower_bound"),
        (F.col("predicted") * 1.5).alias("upper_bound"),
        F.lit(None).cast("double").alias("adi"),
        F.lit(None).cast("double").alias("cv2"),
        F.lit(None).cast("double").alias("nonzero_ratio"),
        F.lit(None).cast("double").alias("mean_qty"),
        F.lit(None).cast("double").alias("avg_gap_days"),
    )


def demand_forecast(spark, sf) -> DataFrame:
    return imports.demand_forecast(forecast_results(spark, sf))


_BOUGHT: dict[tuple, DataFrame] = {}
_PAIRS_A_TASK = 100_000
OF_ROUTE = ("RouteCode", "CustomerCode")
OF_CUSTOMER = ("CustomerCode",)  # for frames run with `rows_in_place`: a customer's sessions lie together as well


def bought_pairs(spark: SparkSession, sf: str, by: tuple[str, ...] = OF_ROUTE) -> DataFrame:
    """What every customer bought before the run's date, stored once and dealt by customer.

    The plan's days repeat these rows; rows dealt by customer need not move
    again to meet the plan or to be grouped by a customer's visit.
    """
    return _stored_pairs(spark, sf).repartition(_tasks(spark, sf), *by)


def _stored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BOUGHT:
        _BOUGHT[key] = cut_lineage(_bought_pairs(spark, sf))
    return _BOUGHT[key]


def tasks_of(stored: DataFrame) -> int:
    """To how many tasks a stored frame's rows are dealt."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // _PAIRS_A_TASK))


def _tasks(spark: SparkSession, sf: str) -> int:
    return tasks_of(_stored_pairs(spark, sf))


def cut_dealt(df: DataFrame, tasks: int) -> DataFrame:
    """`cut_lineage` of a frame whose large inputs are dealt to `tasks` by customer."""
    with rows_in_place(df.sparkSession, tasks):
        return cut_lineage(df)


def cut_in_place(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """`cut_lineage` of a frame whose large inputs are dealt `OF_CUSTOMER`."""
    return cut_dealt(df, _tasks(spark, sf))


def _bought_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        history(spark, sf)
        .groupBy("RouteCode", "CustomerCode", "CustomerName", "ItemCode")
        .agg(
            F.sum("TotalQuantity").alias("q"),
            F.count(F.lit(1)).alias("n"),
            F.max("TrxDate").alias("last"),
        )
    )


def stored_recommendations(spark: SparkSession, sf: str, dealt: bool = True, by: tuple[str, ...] = OF_ROUTE) -> DataFrame:
    """Recommendation rows of the PLAN_DAYS days from the run's date on: planned customers times all items they bought before.

    `dealt` rows lie together by customer (`by`). A row's figures do not depend on its day, so they are put together once a pair.
    """
    day = F.lit(TARGET).cast("date")
    pairs = bought_pairs(spark, sf, by) if dealt else _bought_pairs(spark, sf)
    plan = journey(spark, sf, TARGET, PLAN_DAYS).withColumnRenamed("JourneyDate", "TrxDate")
    if dealt:  # the plan moves to the pairs; small pairs sent to it would leave all rows to the tasks of its file
        plan = plan.hint("shuffle_hash")
    key = F.col("CustomerCode").cast("int")
    brand = F.regexp_extract("ItemCode", r"(\d+)$", 1).cast("int")
    score = (key * 37 + brand * 11 + F.col("n").cast("int") * 13) % 9000 / 100.0 + 10.0
    tier = (
        F.when(F.col("PriorityScore") >= 75, "MUST_STOCK")
        .when(F.col("PriorityScore") >= 55, "SHOULD_STOCK")
        .when(F.col("PriorityScore") >= 35, "CONSIDER")
        .otherwise("MONITOR")
    )
    lanes = F.array(*[F.lit(x) for x in ("history", "peer", "basket", "reactivation", "seed")])
    figures = (
        pairs.withColumn("PriorityScore", score)
        .withColumn("Tier", tier)
        .withColumn(
            "RecommendedQuantity",
            F.greatest(F.lit(1), F.floor(F.col("q") / F.col("n")).cast("int")),
        )
        .select(
            "RouteCode", "CustomerCode", "CustomerName", "ItemCode",
            F.col("ItemCode").alias("ItemName"), "RecommendedQuantity", "Tier",
            (F.col("RecommendedQuantity") * 3).alias("VanLoad"), "PriorityScore",
            F.floor(F.col("q") / F.col("n")).cast("int").alias("AvgQuantityPerVisit"),
            F.datediff(day, "last").alias("DaysSinceLastPurchase"),
            ((key + brand) % 30 + 1).cast("double").alias("PurchaseCycleDays"),
            ((key * 3 + brand) % 100).cast("double").alias("FrequencyPercent"),
            F.lit(0.0).alias("ChurnProbability"),
            F.lit(0.5).alias("PatternQuality"),
            F.col("n").cast("int").alias("PurchaseCount"),
            F.when((key + brand) % 3 == 0, 1.15).otherwise(1.0).alias("TrendFactor"),
            F.concat(
                F.lit('[{"kind":"regular_buyer","detail":"Bought on '), F.col("n").cast("string"),
                F.lit(' visits.","weight":1.0}]'),
            ).alias("Signals"),
            F.when(
                (key + brand) % 4 != 0,
                F.concat(F.lit("Bought on "), F.col("n").cast("string"), F.lit(" visits.")),
            ).alias("WhyItem"),
            F.lit("Usual quantity.").alias("WhyQuantity"),
            (0.5 + (key % 5) / 10.0).alias("Confidence"),
            F.element_at(lanes, (key + brand) % 5 + 1).alias("Source"),
        )
    )
    return plan.join(figures, ["RouteCode", "CustomerCode"]).select("TrxDate", *figures.columns)


def session_items(spark: SparkSession, sf: str, dealt: bool = True, by: tuple[str, ...] = OF_ROUTE) -> DataFrame:
    """Supervised visits of those days: one session per route and day.

    Customers whose key is a multiple of five are no-shows; actual quantity is
    0, 50, 100 or 150 percent of the recommendation by key modulo four.
    """
    key = F.col("CustomerCode").cast("int")
    visited = key % 5 != 0
    actual = F.when(visited, F.expr("RecommendedQuantity * (CAST(CustomerCode AS INT) % 4) div 2"))
    return stored_recommendations(spark, sf, dealt, by).select(
        F.concat_ws("_", "RouteCode", "TrxDate").alias("session_id"),
        F.col("RouteCode").alias("route_code"),
        F.col("TrxDate").alias("date"),
        F.col("CustomerCode").alias("customer_code"),
        F.col("CustomerName").alias("customer_name"),
        F.col("ItemCode").alias("item_code"),
        F.col("ItemName").alias("item_name"),
        F.col("RecommendedQuantity").alias("recommended_qty"),
        F.lit(0).alias("adjustment"),
        F.coalesce(actual, F.lit(0)).cast("int").alias("actual_qty"),
        F.col("Tier").alias("tier"),
        F.col("PriorityScore").alias("priority_score"),
        F.col("DaysSinceLastPurchase").alias("days_since_last_purchase"),
        F.col("PurchaseCycleDays").alias("purchase_cycle_days"),
        F.col("FrequencyPercent").alias("frequency_percent"),
        F.col("VanLoad").alias("van_inventory_qty"),
        visited.alias("visited"),
        F.when(visited, key).otherwise(0).alias("visit_sequence"),
    ).withColumn("was_sold", F.col("actual_qty") > 0).withColumn(
        "was_edited", F.col("visited")
    )


def visit_sales(spark: SparkSession, sf: str, by: tuple[str, ...] = OF_ROUTE) -> DataFrame:
    """Invoiced quantities of those days: session actuals plus unplanned lines, of one reading of the sessions.

    With `OF_CUSTOMER` the lines are dealt as the recommendations are.
    """
    key = F.col("customer_code").cast("int")
    planned = F.struct(
        F.col("customer_code").alias("CustomerCode"), F.col("item_code").alias("ItemCode"),
        F.col("actual_qty").cast("double").alias("TotalQuantity"),
    )
    extra = F.struct(
        F.when(key % 7 == 0, F.concat(F.lit("U"), F.col("customer_code")))
        .otherwise(F.col("customer_code")).alias("CustomerCode"),
        F.concat(F.lit("X"), F.col("item_code")).alias("ItemCode"),
        (key % 5 + 1).cast("double").alias("TotalQuantity"),
    )
    both = F.array(
        F.when(F.col("actual_qty") > 0, planned), F.when((key + F.dayofmonth("date")) % 3 == 0, extra))
    lines = session_items(spark, sf, by=by).select(
        F.col("date").alias("TrxDate"), F.col("route_code").alias("RouteCode"), F.explode(both).alias("_l"),
    ).filter(F.col("_l").isNotNull()).select("TrxDate", "RouteCode", "_l.*")
    if by == OF_ROUTE:
        return lines
    return lines.repartition(_tasks(spark, sf), *by)
