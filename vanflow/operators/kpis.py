"""Exploratory sales aggregates and business KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanflow.functions.numeric import one_row_value, py_round, ratio
from vanflow.functions.text import clean_code
from vanflow.sources.imports import invoiced, positive_qty

ITEM_WINDOWS = (("last_week", 7), ("last_4_weeks", 28), ("last_3_months", 90), ("last_6_months", 180))


def with_revenue(sales: DataFrame) -> DataFrame:
    """Numeric coercion (bad text and nulls to 0) plus revenue; undated rows are dropped."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return (
        sales.withColumn("TotalQuantity", number("TotalQuantity"))
        .withColumn("AvgUnitPrice", number("AvgUnitPrice"))
        .withColumn("revenue", F.col("TotalQuantity") * F.col("AvgUnitPrice"))
        .dropna(subset=["TrxDate"])
    )


def _qty_and_revenue() -> list[Column]:
    return [
        F.sum("TotalQuantity").alias("quantity"),
        py_round(F.sum("revenue"), 2).alias("revenue"),
    ]


def sales_totals(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count(F.lit(1)).alias("transactions"),
        py_round(F.sum("TotalQuantity"), 1).alias("total_quantity"),
        py_round(F.sum("revenue"), 2).alias("total_revenue"),
        F.countDistinct("RouteCode").alias("unique_routes"),
        F.countDistinct("ItemCode").alias("unique_items"),
        F.countDistinct("WarehouseCode").alias("unique_warehouses"),
        F.countDistinct("CategoryName").alias("unique_categories"),
        F.min("TrxDate").alias("first_date"),
        F.max("TrxDate").alias("last_date"),
        F.datediff(F.max("TrxDate"), F.min("TrxDate")).alias("days_covered"),
    )


def daily_trend(sales: DataFrame, days: int = 90) -> DataFrame:
    start = F.date_sub(one_row_value(sales, F.max("TrxDate")), days)
    return (
        sales.filter(F.col("TrxDate") >= start)
        .groupBy(F.col("TrxDate").alias("date"))
        .agg(*_qty_and_revenue())
    )


def top_items(sales: DataFrame, k: int = 10) -> DataFrame:
    return (
        sales.groupBy("ItemCode", "ItemName").agg(*_qty_and_revenue())
        .orderBy(F.desc("quantity"), "ItemCode").limit(k)
    )


def top_routes(sales: DataFrame, k: int = 10) -> DataFrame:
    return (
        sales.groupBy("RouteCode")
        .agg(*_qty_and_revenue(), F.countDistinct("ItemCode").alias("items"))
        .orderBy(F.desc("quantity"), "RouteCode").limit(k)
    )


def top_categories(sales: DataFrame, k: int = 10) -> DataFrame:
    """Rows without a category do not form a group."""
    return (
        sales.filter(F.col("CategoryName").isNotNull())
        .groupBy("CategoryName").agg(*_qty_and_revenue())
        .orderBy(F.desc("quantity"), "CategoryName").limit(k)
    )


def item_catalog(sales: DataFrame, days: int = 365) -> DataFrame:
    """Mean and latest price per item over the last year.

    The latest price is that of the newest row; rows of one day are ordered by
    warehouse and route, then by price.
    """
    start = F.date_sub(one_row_value(sales, F.max("TrxDate")), days)
    recent = sales.filter(F.col("TrxDate") >= start)
    newest = F.struct("TrxDate", "WarehouseCode", "RouteCode", "AvgUnitPrice")
    return (
        recent.dropna(subset=["ItemCode", "ItemName", "CategoryName"])
        .groupBy(clean_code("ItemCode").alias("ItemCode"), "ItemName", "CategoryName")
        .agg(
            # Whole cents add up alike in any order.
            (F.rint(F.sum(F.rint(F.col("AvgUnitPrice") * 100).cast("long")) / F.count("AvgUnitPrice")) / 100).alias("avg_price"),
            py_round(F.max(newest)["AvgUnitPrice"], 2).alias("last_price"),
            py_round(F.sum("TotalQuantity"), 1).alias("total_quantity"),
            F.count("TrxDate").alias("transactions"),
            F.max("TrxDate").alias("last_seen"),
        )
    )


def business_kpis(sales: DataFrame) -> DataFrame:
    """Last-day and 7-day revenue against the week before, in one pass over 14 days."""
    anchor = one_row_value(sales, F.max("TrxDate"))
    recent = sales.filter(F.col("TrxDate") >= F.date_sub(anchor, 13))
    age = F.datediff(F.col("anchor"), F.col("TrxDate"))
    total = lambda lo, hi: F.coalesce(
        F.sum(F.when(F.col("age").between(lo, hi), F.col("revenue"))), F.lit(0.0)
    )
    sums = (
        recent.withColumn("anchor", anchor)
        .withColumn("age", age)
        .groupBy("anchor")
        .agg(
            total(0, 0).alias("_day"), total(7, 7).alias("_day_before"),
            total(0, 6).alias("_week"), total(7, 13).alias("_week_before"),
        )
    )
    delta = lambda now, prev: F.when(
        F.col(prev) > 0, py_round((F.col(now) - F.col(prev)) / F.col(prev) * 100, 1)
    )
    return sums.select(
        F.col("anchor").alias("anchor_date"),
        py_round("_day", 2).alias("day_revenue"),
        delta("_day", "_day_before").alias("day_delta_pct"),
        py_round("_week", 2).alias("week_revenue"),
        py_round("_week_before", 2).alias("prior_week_revenue"),
        delta("_week", "_week_before").alias("week_delta_pct"),
    )


def recent_forecast_accuracy(forecast: DataFrame, anchor: Column | str, days: int = 7) -> DataFrame:
    """100 - WAPE over rows with positive actuals in the trailing window."""
    end = F.lit(anchor).cast("date") if isinstance(anchor, str) else anchor
    window = forecast.filter(F.col("TrxDate").between(F.date_sub(end, days - 1), end))
    scored = window.filter(F.col("ActualQty") > 0)
    return scored.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        py_round(
            F.greatest(
                F.lit(0.0),
                100 - F.sum(F.abs(F.col("ActualQty") - F.col("Predicted")))
                / F.sum("ActualQty") * 100,
            ), 1,
        ).alias("accuracy_pct"),
    ).withColumn("window_days", F.lit(days))


def operations_summary(journey: DataFrame, today: str, days: int = 7) -> DataFrame:
    end = F.lit(today).cast("date")
    window = journey.filter(F.col("JourneyDate").between(F.date_sub(end, days - 1), end))
    return window.agg(
        F.countDistinct("RouteCode").alias("routes"),
        F.countDistinct("CustomerCode").alias("customers"),
        F.countDistinct("JourneyDate").alias("days_active"),
    )


def item_window_stats(sales: DataFrame, by_route: bool = False) -> DataFrame:
    """7/28/90/180-day totals and means per active day, from each item's own last day."""
    keys = ["ItemCode", "RouteCode"] if by_route else ["ItemCode"]
    daily = sales.groupBy(*keys, "TrxDate").agg(
        F.sum("TotalQuantity").alias("qty"), F.count(F.lit(1)).alias("n")
    )
    span = daily.groupBy(*keys).agg(
        F.max("TrxDate").alias("anchor_date"), F.sum("n").alias("total_transactions")
    )
    aggs: list[Column] = []
    for name, days in ITEM_WINDOWS:
        inside = F.col("TrxDate") >= F.date_sub("anchor_date", days - 1)
        total = F.sum(F.when(inside, F.col("qty")))
        active = F.count(F.when(inside & (F.col("qty") > 0), 1))
        aggs += [
            py_round(ratio(total, active), 2).alias(f"{name}_avg"),
            py_round(total, 2).alias(f"{name}_total"),
            active.alias(f"{name}_active_days"),
        ]
    return daily.join(span, keys).groupBy(*keys, "anchor_date", "total_transactions").agg(*aggs)


def route_sales_lines(raw: DataFrame, date: str | None = None, route: str | None = None) -> DataFrame:
    """Positive quantity per (route, day, customer, item); zero lines are dropped."""
    sales = invoiced(raw)
    if date is not None:
        sales = sales.filter(F.col("TrxDate") == F.lit(date).cast("date"))
    if route is not None:
        sales = sales.filter(F.col("RouteCode") == route)
    return (
        sales.groupBy(
            "RouteCode", "TrxDate", clean_code("CustomerCode").alias("CustomerCode"),
            clean_code("ItemCode").alias("ItemCode"),
        )
        .agg(
            F.max("CustomerName").alias("CustomerName"),
            F.floor(F.sum(positive_qty())).cast("int").alias("qty"),
        )
        .filter((F.col("qty") > 0) & (F.col("CustomerCode") != "") & (F.col("ItemCode") != ""))
    )


def route_sales_on(raw: DataFrame, date: str | None = None, route: str | None = None) -> DataFrame:
    """The same lines with items nested under each customer."""
    return (
        route_sales_lines(raw, date, route)
        .groupBy("RouteCode", "TrxDate", "CustomerCode")
        .agg(
            F.trim(F.max("CustomerName")).alias("CustomerName"),
            F.array_sort(
                F.collect_list(F.struct(F.col("ItemCode").alias("item_code"), "qty"))
            ).alias("items"),
            F.sum("qty").alias("total_qty"),
        )
    )


def customer_sales_on(raw: DataFrame, route: str, date: str, customer: str) -> DataFrame:
    lines = route_sales_lines(raw.filter(F.col("CustomerCode") == customer), date, route)
    return lines.select("ItemCode", "qty")


def customer_overview(raw: DataFrame, today: str, lookback_days: int = 90) -> DataFrame:
    """Visits, items, quantity and last purchase per customer."""
    start = F.date_sub(F.lit(today).cast("date"), lookback_days)
    return (
        invoiced(raw).filter(F.col("TrxDate") >= start)
        .groupBy("CustomerCode")
        .agg(
            F.max("CustomerName").alias("customer_name"),
            F.max("RouteCode").alias("route_code"),
            F.countDistinct("TrxDate").alias("visits"),
            F.countDistinct("ItemCode").alias("unique_items"),
            F.sum(positive_qty()).alias("total_quantity"),
            F.max("TrxDate").alias("last_purchase"),
        )
    )


def customer_overview_totals(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.countDistinct("CustomerCode").alias("active_customers"),
        F.sum("visits").alias("total_visits"),
        py_round(F.sum("total_quantity"), 1).alias("total_quantity"),
        py_round(F.avg("visits"), 1).alias("avg_visits_per_customer"),
    )


def customer_overview_top(overview: DataFrame, k: int = 10) -> DataFrame:
    return overview.orderBy(F.desc("total_quantity"), "CustomerCode").limit(k)


def customer_overview_by_route(overview: DataFrame) -> DataFrame:
    return overview.groupBy("route_code").agg(
        F.countDistinct("CustomerCode").alias("customers"),
        F.sum("total_quantity").alias("total_quantity"),
    )
