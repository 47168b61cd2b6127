"""Predicted against actual demand: comparison, drift and dashboard aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanflow.config import DashboardConfig
from vanflow.functions.numeric import py_round
from vanflow.functions.text import clean_code
from vanflow.operators.evaluate import accuracy
from vanflow.sources.imports import invoiced, positive_qty

KEYS = ["trx_date", "route_code", "item_code"]


def comparison(predictions: DataFrame, raw: DataFrame) -> DataFrame:
    """Forecast rows with the positive invoiced quantity of the same day, route and item."""
    span = predictions.agg(F.struct(F.min("trx_date").alias("a"), F.max("trx_date").alias("b")))
    limits = span.scalar()
    actuals = (
        invoiced(raw)
        .filter(F.col("TrxDate").between(limits["a"], limits["b"]))
        .groupBy(
            F.col("TrxDate").alias("trx_date"), clean_code("RouteCode").alias("route_code"),
            clean_code("ItemCode").alias("item_code"),
        )
        .agg(F.sum(positive_qty()).alias("actual_qty"))
    )
    columns = [*KEYS, "item_name", "demand_class", "model_used", "predicted", "lower_bound", "upper_bound"]
    joined = predictions.select(*columns).join(actuals, KEYS, "left").fillna(0.0, ["actual_qty"])
    variance = F.col("actual_qty") - F.col("predicted")
    pct = F.when(F.col("predicted") > 0, variance / F.col("predicted") * 100).otherwise(0.0)
    return joined.withColumns({"variance": variance, "variance_pct": pct})


def ordered(rows: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    page = rows.orderBy(*KEYS).offset(offset)
    return page if limit is None else page.limit(limit)


def comparison_summary(rows: DataFrame) -> DataFrame:
    """Totals over all rows, errors over rows with positive actuals."""
    y, p = F.col("actual_qty"), F.col("predicted")
    err = F.when(y > 0, F.abs(y - p))
    wape = F.sum(err) / F.sum(F.when(y > 0, y)) * 100
    return rows.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        py_round(F.sum(p), 1).alias("total_predicted"),
        py_round(F.sum(y), 1).alias("total_actual"),
        py_round(F.avg(err), 2).alias("mae"),
        py_round(F.sqrt(F.avg(err * err)), 2).alias("rmse"),
        py_round(wape, 2).alias("wape"),
        py_round(F.greatest(F.lit(0.0), 100 - wape), 1).alias("accuracy_pct"),
    )


def drift_status(
    baseline: DataFrame, live: DataFrame, test: DataFrame, today: str, cfg: DashboardConfig
) -> DataFrame:
    """Live accuracy of the last 7 days against the training baseline.

    ``baseline`` and ``test`` hold (trx_date, actual_qty, predicted) of the test
    set. Without live evidence the last 7 days of the test set stand in.
    """
    y, p = F.col("actual_qty"), F.col("predicted")
    end = F.lit(today).cast("date")
    recent_live = live.filter(F.col("trx_date").between(F.date_sub(end, 7), end)).agg(
        py_round(accuracy(y, p), 1)
    ).scalar()
    last = test.agg(F.max("trx_date")).scalar()
    recent_test = test.filter(F.col("trx_date") >= F.date_sub(last, 7)).agg(
        py_round(accuracy(y, p), 2)
    ).scalar()
    base = baseline.agg(py_round(accuracy(y, p), 2).alias("baseline_accuracy"))
    row = base.withColumns({"_live": recent_live, "_test": recent_test})
    usable = F.col("_live") > 0
    row = row.withColumns(
        {
            "recent_accuracy": F.when(usable, F.col("_live")).otherwise(F.col("_test")),
            "source": F.when(usable, "live").when(F.col("_test").isNotNull(), "test_set")
            .otherwise("unavailable"),
        }
    )
    delta = py_round(F.col("recent_accuracy") - F.col("baseline_accuracy"), 2)
    drop = F.abs(F.least(F.lit(0.0), delta))
    return row.select(
        "baseline_accuracy", "recent_accuracy", delta.alias("delta"), "source",
        F.when(delta.isNull(), "unavailable").when(drop > cfg.drift_alert, "significant")
        .when(drop > cfg.drift_warn, "drifting").otherwise("stable").alias("status"),
    )


def daily_stats(rows: DataFrame, cfg: DashboardConfig, by: Sequence[str] = ()) -> DataFrame:
    """On-target days, longest streak, best day, trend, bias and demand served.

    Rows collapse to one point per day first; the days of a window fit one
    array, over which streak and halves are folded.
    """
    y, p = F.col("actual_qty"), F.col("predicted")
    per_day = rows.groupBy(*by, "trx_date").agg(
        F.sum(p).alias("p"), F.sum(y).alias("a"),
        F.sum(F.when(y > 0, F.abs(y - p))).alias("err"), F.sum(F.when(y > 0, y)).alias("sold"),
        F.sum(F.least(p, y)).alias("served"),
    )
    point = F.when(F.col("a") > 0, F.struct("trx_date", "p", "a"))
    whole = per_day.groupBy(*by).agg(
        F.array_sort(F.collect_list(point)).alias("days"),
        F.sum("p").alias("total_predicted"), F.sum("a").alias("total_actual"),
        F.sum("err").alias("_err"), F.sum("sold").alias("_sold"),
        F.sum("served").alias("demand_served"),
    )
    gap = lambda d: F.abs(d.p - d.a)
    hit = lambda d: gap(d) / d.a <= cfg.tolerance
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def extend(s, d):
        now = F.when(hit(d), s.now + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s.best, now).alias("best"))

    def half_accuracy(part: Column) -> Column:
        err = F.aggregate(part, F.lit(0.0), lambda acc, d: acc + gap(d))
        act = F.aggregate(part, F.lit(0.0), lambda acc, d: acc + d.a)
        return F.when(act > 0, F.greatest(F.lit(0.0), 100 - err / act * 100))

    n = F.size("days")
    mid = F.floor(n / 2).cast("int")
    trend = F.when(
        n >= 2,
        half_accuracy(F.slice("days", mid + 1, n - mid))
        - half_accuracy(F.slice("days", F.lit(1), mid)),
    )
    scored = F.transform(
        "days",
        lambda d: F.struct(
            F.greatest(F.lit(0.0), 100 - gap(d) / d.a * 100).alias("acc"),
            (-F.unix_date(d.trx_date)).alias("o"), d.trx_date.alias("day"),
        ),
    )
    best = F.array_max(scored)
    tp, ta = F.col("total_predicted"), F.col("total_actual")
    return whole.select(
        *by,
        F.when(F.col("_sold") > 0, F.greatest(F.lit(0.0), 100 - F.col("_err") / F.col("_sold") * 100))
        .alias("accuracy_pct"),
        F.when(ta > 0, (tp - ta) / ta * 100).alias("bias_pct"),
        "demand_served",
        F.when(tp > 0, F.least(ta, tp) / tp * 100).alias("sell_through_pct"),
        F.size(F.filter("days", hit)).alias("days_on_target"),
        n.alias("days_scored"),
        F.aggregate("days", start, extend, lambda s: s.best).alias("best_streak"),
        best["day"].alias("best_day"), best["acc"].alias("best_day_accuracy"),
        trend.alias("trend_pp"),
        F.when(trend >= cfg.trend_step_pp, "Improving").when(trend <= -cfg.trend_step_pp, "Slipping")
        .when(trend.isNotNull(), "Steady").alias("trend"),
    )


def daily_chart(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trx_date").agg(
        py_round(F.sum("predicted"), 2).alias("predicted"),
        py_round(F.sum("actual_qty"), 2).alias("actual"),
    )


def item_variance(rows: DataFrame, k: int = 10) -> DataFrame:
    """Items with the largest absolute variance."""
    p, a = F.sum("predicted"), F.sum("actual_qty")
    return (
        rows.groupBy("item_code")
        .agg(
            py_round(p, 1).alias("predicted"), py_round(a, 1).alias("actual"),
            py_round(a - p, 1).alias("variance"),
        )
        .orderBy(F.desc(F.abs("variance")), "item_code").limit(k)
    )


def most_accurate_item(rows: DataFrame, cfg: DashboardConfig) -> DataFrame:
    """Smallest relative variance among the charted items with a significant volume."""
    total = rows.agg(F.sum("actual_qty")).scalar()
    charted = item_variance(rows).filter(
        (F.col("actual") > 0) & (F.col("actual") >= total * cfg.significant_share)
    )
    off = F.abs("variance") / F.col("actual")
    rank = F.struct(off.alias("err"), (-F.abs("variance")).alias("o"), F.col("item_code"))
    return charted.agg(F.min(rank).alias("_b")).filter("_b IS NOT NULL").select(
        F.col("_b.item_code").alias("item_code"), F.col("_b.err").alias("error_share")
    )


def van_load_summary(forecast: DataFrame, cfg: DashboardConfig, by: Sequence[str]) -> DataFrame:
    """SKUs, quantity, revenue and uncertain lines."""
    return forecast.groupBy(*by).agg(
        F.countDistinct("ItemCode").alias("skus"),
        py_round(F.sum("prediction"), 2).alias("total_qty"),
        F.sum(F.col("prediction") * F.col("AvgUnitPrice")).alias("revenue"),
        F.count(F.when(F.col("p_demand") < cfg.at_risk_probability, 1)).alias("at_risk"),
    )


def enrich_forecast(forecast: DataFrame, catalog: DataFrame) -> DataFrame:
    """Price (last, else mean) and name from the item catalogue.

    An item listed under several categories counts with its most recent entry.
    """
    price = F.when(F.col("last_price") > 0, F.col("last_price")).when(
        F.col("avg_price") > 0, F.col("avg_price")
    ).otherwise(0.0)
    latest = catalog.withColumn("_price", price).groupBy("ItemCode").agg(
        F.max(F.struct("last_seen", "CategoryName", "_price", "ItemName")).alias("_e")
    ).select("ItemCode", F.col("_e._price").alias("_price"), F.col("_e.ItemName").alias("_name"))
    joined = forecast.join(latest, "ItemCode", "left")
    own_price = [F.col("AvgUnitPrice")] if "AvgUnitPrice" in forecast.columns else []
    own_name = [F.col("ItemName")] if "ItemName" in forecast.columns else []
    return joined.withColumns(
        {
            "AvgUnitPrice": F.coalesce(*own_price, F.col("_price")),
            "ItemName": F.coalesce(*own_name, F.col("_name"), F.lit("")),
        }
    ).drop("_price", "_name")


def top_forecast_items(forecast: DataFrame, k: int = 10) -> DataFrame:
    return forecast.withColumn("predicted", py_round("prediction", 1)).orderBy(
        F.desc("prediction"), "RouteCode", "ItemCode"
    ).limit(k)


def forecast_chart(forecast: DataFrame, today: str, items: Sequence[str] | None = None) -> DataFrame:
    """Future totals per day; bounds add up only where one item is in view."""
    view = forecast.filter(F.col("TrxDate") >= F.lit(today).cast("date"))
    if items:
        view = view.filter(F.col("ItemCode").isin(list(items)))
    # one distinct item exactly when the smallest and largest code agree
    single = view.agg(F.min("ItemCode") == F.max("ItemCode")).scalar()
    bound = lambda c: py_round(F.sum(F.when(F.col("_one"), F.col(c)).otherwise(0.0)), 2)
    return view.withColumn("_one", single).groupBy("TrxDate").agg(
        py_round(F.sum("prediction"), 2).alias("predicted"),
        bound("q_10").alias("q10"), bound("q_90").alias("q90"),
    )


def route_status(routes: DataFrame, forecast_summary: DataFrame, counts: DataFrame) -> DataFrame:
    """Every route with its forecast and plan, or what is missing of them."""
    joined = routes.select(F.col("RouteCode")).distinct().join(
        forecast_summary.withColumnRenamed("route_code", "RouteCode"), "RouteCode", "left"
    ).join(counts, "RouteCode", "left")
    planned = F.coalesce("customers", F.lit(0))
    status = (
        F.when((planned > 0) & F.col("skus").isNotNull(),
               F.concat(planned.cast("string"), F.lit(" customers")))
        .when(planned > 0, F.concat(planned.cast("string"), F.lit(" planned, no forecast")))
        .otherwise("No visits")
    )
    ready = (planned > 0) & F.col("skus").isNotNull()
    return joined.select(
        "RouteCode", status.alias("status"), F.when(ready, F.col("skus")).alias("items"),
        F.when(ready, F.col("predicted_qty")).alias("van_load"),
    )
