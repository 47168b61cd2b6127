"""Sources, incremental merge and exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanflow.config import DASHBOARD
from vanflow.operators import kpis
from vanflow.session import shared_dir
from vanflow.sources import fixtures as fx
from vanflow.sources import imports as im
from vanflow.sources import slices
from vanflow.catalog import sqlbase as sb

ROUTES = ["0", "1", "3"]
TODAY = "2001-08-01"


def _sales(spark, sf):
    return kpis.with_revenue(fx.sales_recent(spark, sf))


def _merge_parts(spark, sf):
    """Existing rows up to a cut and a re-read of the month before it at raised prices."""
    cust = fx.customer_data(spark, sf)
    cut, overlap = F.lit("2001-06-30").cast("date"), F.lit("2001-05-31").cast("date")
    existing = cust.filter(F.col("TrxDate") <= cut)
    incoming = cust.filter(F.col("TrxDate") > overlap).withColumn(
        "AvgUnitPrice", F.col("AvgUnitPrice") + 1
    )
    return existing, incoming


def _merge_lines(spark, sf):
    """The same existing rows and single invoice lines after the month before the cut, many to a key; the last line of a key wins."""
    existing, _ = _merge_parts(spark, sf)
    lines = im.invoiced(fx.raw_sales(spark, sf, keep=("l_orderkey", "l_linenumber"))).filter("TrxDate > DATE '2001-05-31'")
    incoming = lines.select(
        *im.CUSTOMER_KEYS, im.positive_qty().alias("TotalQuantity"), F.col("UnitPrice").alias("AvgUnitPrice"),
        F.struct("l_orderkey", "l_linenumber").alias("line"),
    )
    return im.incremental_merge(existing, incoming, sequence="line")


def _full_refresh(spark, sf):
    datasets = {
        "sales_recent": (fx.sales_recent(spark, sf), "TrxDate"),
        "journey_plan": (fx.journey(spark, sf), "JourneyDate"),
    }
    import uuid

    paths = im.refresh_all(datasets, f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}")
    stored = {n: (slices.read(spark, p), datasets[n][1]) for n, p in paths.items()}
    return im.dataset_status(stored)


def _status_inputs(spark, sf):
    return {
        "customer_data": (fx.customer_data(spark, sf), "TrxDate"),
        "sales_recent": (fx.sales_recent(spark, sf), "TrxDate"),
        "journey_plan": (fx.journey(spark, sf), "JourneyDate"),
        "demand_forecast": (fx.demand_forecast(spark, sf), "TrxDate"),
    }


def _text_dates(spark, sf):
    """Sales with the date as text, unreadable for one line in seven."""
    return fx.sales_recent(spark, sf).withColumn(
        "TrxDate",
        F.when(F.dayofmonth("TrxDate") % 7 == 0, F.lit("n/a")).otherwise(
            F.date_format("TrxDate", "yyyy-MM-dd")
        ),
    )


def _padded(spark, sf):
    return fx.customer_data(spark, sf).withColumn(
        "ItemCode", F.concat(F.lit(" "), F.col("ItemCode"), F.lit("  "))
    )


def _freshness(spark, sf):
    return im.freshness(
        fx.journey(spark, sf), fx.customer_data(spark, sf), fx.demand_forecast(spark, sf),
        fx.sales_recent(spark, sf), "2001-07-30", "2001-08-03", DASHBOARD.rest_weekday,
    )


def _overview(spark, sf):
    return kpis.customer_overview(fx.raw_sales(spark, sf), TODAY)


QUERIES = {
    "A1_customer_data": lambda s, d: im.customer_data(
        fx.raw_sales(s, d), routes=ROUTES, today=TODAY, lookback_days=365),
    "A1_customer_data_since": lambda s, d: im.customer_data(
        fx.raw_sales(s, d, "nation"), since="2001-01-01"),
    "A2_sales_recent": lambda s, d: im.sales_recent(fx.raw_sales(s, d, "nation")),
    "A3_journey_plan": lambda s, d: im.journey_plan(
        fx.journey(s, d), routes=ROUTES, today=fx.TARGET, window_days=5),
    "A4_demand_forecast": lambda s, d: im.demand_forecast(
        fx.forecast_results(s, d), routes=ROUTES, since="2001-06-15"),
    "A5_incremental_merge": lambda s, d: im.incremental_merge(*_merge_parts(s, d)),
    "A5_last_line_of_a_key": _merge_lines,
    "A6_full_refresh": _full_refresh,
    "A7_dataset_status": lambda s, d: im.dataset_status(_status_inputs(s, d)),
    "A7_status_summary": lambda s, d: im.status_summary(im.dataset_status(_status_inputs(s, d))),
    "A8_bad_date_drop": lambda s, d: im.parse_dates(_text_dates(s, d), "TrxDate"),
    "A9_normalise": lambda s, d: im.purchases_only(_padded(s, d)).select(
        "TrxDate", "RouteCode", "CustomerCode", "ItemCode", "CategoryCode", "TotalQuantity"),
    "A9_confident_demand": lambda s, d: im.confident_demand(
        fx.demand_forecast(s, d), DASHBOARD.min_demand_probability
    ).select("TrxDate", "RouteCode", "ItemCode", "DemandProbability"),
    "A10_validate_input": lambda s, d: im.validate_input(
        fx.sales_recent(s, d), ["RouteCode", "ItemCode", "TrxDate", "TotalQuantity"],
        "TotalQuantity", "TrxDate", ["AvgUnitPrice"]),
    "A11_freshness": _freshness,
    "H1_sales_load": lambda s, d: _sales(s, d).select(
        "TrxDate", "RouteCode", "ItemCode", "CategoryName", "TotalQuantity", "AvgUnitPrice", "revenue"),
    "H2_sales_totals": lambda s, d: kpis.sales_totals(_sales(s, d)),
    "H3_daily_trend": lambda s, d: kpis.daily_trend(_sales(s, d)),
    "H4_top_items": lambda s, d: kpis.top_items(_sales(s, d)),
    "H4_top_routes": lambda s, d: kpis.top_routes(_sales(s, d)),
    "H4_top_categories": lambda s, d: kpis.top_categories(_sales(s, d)),
    "H5_item_catalog": lambda s, d: kpis.item_catalog(_sales(s, d)),
    "H6_business_kpis": lambda s, d: kpis.business_kpis(_sales(s, d)),
    "H7_forecast_accuracy_7d": lambda s, d: kpis.recent_forecast_accuracy(
        fx.demand_forecast(s, d), "2001-07-01"),
    "H8_operations_summary": lambda s, d: kpis.operations_summary(fx.journey(s, d), fx.TARGET),
    "H9_item_window_stats": lambda s, d: kpis.item_window_stats(_sales(s, d)),
    "H9_item_route_window_stats": lambda s, d: kpis.item_window_stats(_sales(s, d), by_route=True),
    "H10_route_sales_on_date": lambda s, d: kpis.route_sales_on(fx.raw_sales(s, d)).withColumn(
        "items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x.item_code, x.qty)), ",")),
    "H11_customer_sales_on_date": lambda s, d: kpis.customer_sales_on(
        fx.raw_sales(s, d), "2", "1996-01-20", "817"),
    "H12_customer_overview": _overview,
    "H12_customer_totals": lambda s, d: kpis.customer_overview_totals(_overview(s, d)),
    "H12_customer_top": lambda s, d: kpis.customer_overview_top(_overview(s, d)),
    "H12_customers_by_route": lambda s, d: kpis.customer_overview_by_route(_overview(s, d)),
}

_S = sb.with_(*sb.TO_SALES, """rev AS (SELECT *, TotalQuantity * AvgUnitPrice AS revenue FROM sales)""")
_C = sb.with_(*sb.TO_CUST)
_QR = "SUM(TotalQuantity) AS quantity, " + sb.rint("SUM(revenue)", 2) + " AS revenue"
_OV = sb.with_(sb.RAW, """ov AS (SELECT CustomerCode, MAX(CustomerName) AS customer_name,
    MAX(RouteCode) AS route_code, COUNT(DISTINCT TrxDate) AS visits,
    COUNT(DISTINCT ItemCode) AS unique_items,
    SUM(CASE WHEN QuantityInPCs > 0 THEN QuantityInPCs ELSE 0 END) AS total_quantity,
    MAX(TrxDate) AS last_purchase FROM raw
  WHERE ItemType = 'OrderItem' AND TrxType = 'SalesInvoice' AND TrxDate >= DATE '2001-08-01' - 90
  GROUP BY CustomerCode)""")
_STATUS = sb.with_(*sb.TO_CUST, sb.SALES, sb.journey(), sb.FORECAST, """st AS (
  SELECT 'customer_data' AS dataset, COUNT(*) AS rows, MIN(TrxDate) AS first_date, MAX(TrxDate) AS last_date FROM cust
  UNION ALL SELECT 'sales_recent', COUNT(*), MIN(TrxDate), MAX(TrxDate) FROM sales
  UNION ALL SELECT 'journey_plan', COUNT(*), MIN(JourneyDate), MAX(JourneyDate) FROM journey
  UNION ALL SELECT 'demand_forecast', COUNT(*), MIN(TrxDate), MAX(TrxDate) FROM fcst)""")


def _window_sql(keys: str) -> str:
    cols = []
    for name, days in kpis.ITEM_WINDOWS:
        cond = f"TrxDate >= anchor_date - {days - 1}"
        total = f"SUM(CASE WHEN {cond} THEN qty END)"
        active = f"COUNT(CASE WHEN {cond} AND qty > 0 THEN 1 END)"
        cols.append(
            f"CASE WHEN {active} > 0 THEN {sb.rint(f'{total} / {active}', 2)} END AS {name}_avg, "
            f"{sb.rint(total, 2)} AS {name}_total, {active} AS {name}_active_days"
        )
    return sb.with_(*sb.TO_SALES, f"""daily AS (SELECT {keys}, TrxDate, SUM(TotalQuantity) AS qty,
      COUNT(*) AS n FROM sales GROUP BY {keys}, TrxDate),
    sp AS (SELECT {keys}, MAX(TrxDate) AS anchor_date, CAST(SUM(n) AS BIGINT) AS total_transactions
      FROM daily GROUP BY {keys})""") + (
        f"SELECT {keys}, anchor_date, total_transactions, {', '.join(cols)} "
        f"FROM daily JOIN sp USING ({keys}) GROUP BY {keys}, anchor_date, total_transactions"
    )


_LINES = """lines AS (SELECT RouteCode, TrxDate, CustomerCode, ItemCode, MAX(CustomerName) AS CustomerName,
    CAST(floor(SUM(CASE WHEN QuantityInPCs > 0 THEN QuantityInPCs ELSE 0 END)) AS INT) AS qty
  FROM raw WHERE ItemType = 'OrderItem' AND TrxType = 'SalesInvoice' GROUP BY ALL)"""

ORACLES = {
    "A1_customer_data": _C + """SELECT * FROM cust WHERE RouteCode IN ('0', '1', '3')
        AND TrxDate >= DATE '2001-08-01' - 365""",
    "A1_customer_data_since": sb.with_(sb.raw("nation"), sb.CUSTOMER)
    + "SELECT * FROM cust WHERE TrxDate > DATE '2001-01-01'",
    "A2_sales_recent": sb.with_(sb.raw("nation"), sb.SALES) + "SELECT * FROM sales",
    "A3_journey_plan": sb.with_(sb.journey()) + f"""SELECT * FROM journey
        WHERE RouteCode IN ('0', '1', '3')
        AND JourneyDate BETWEEN {sb.TARGET} - 5 AND {sb.TARGET} + 5""",
    "A4_demand_forecast": sb.with_(*sb.TO_FCST) + """SELECT * FROM fcst
        WHERE RouteCode IN ('0', '1', '3') AND TrxDate > DATE '2001-06-15'""",
    "A5_incremental_merge": _C + """, u AS (
        SELECT *, 0 AS seq FROM cust WHERE TrxDate <= DATE '2001-06-30'
        UNION ALL SELECT * REPLACE (AvgUnitPrice + 1 AS AvgUnitPrice), 1 FROM cust
        WHERE TrxDate > DATE '2001-05-31')
        SELECT * EXCLUDE (seq) FROM u QUALIFY row_number() OVER (PARTITION BY TrxDate, RouteCode,
        CustomerCode, CustomerName, ItemCode, ItemName, CategoryCode, CategoryName
        ORDER BY seq DESC) = 1""",
    "A5_last_line_of_a_key": sb.with_(sb.raw(keep=", l_orderkey, l_linenumber"), sb.CUSTOMER, """u AS (
        SELECT *, 0 AS seq, 0 AS l_orderkey, 0 AS l_linenumber FROM cust WHERE TrxDate <= DATE '2001-06-30'
        UNION ALL SELECT TrxDate, RouteCode, CustomerCode, CustomerName, ItemCode, ItemName, CategoryCode, CategoryName,
        greatest(QuantityInPCs, 0), UnitPrice, 1, l_orderkey, l_linenumber FROM raw
        WHERE ItemType = 'OrderItem' AND TrxType = 'SalesInvoice' AND TrxDate > DATE '2001-05-31')""") + """
        SELECT * EXCLUDE (seq, l_orderkey, l_linenumber) FROM u QUALIFY row_number() OVER (PARTITION BY TrxDate, RouteCode,
        CustomerCode, CustomerName, ItemCode, ItemName, CategoryCode, CategoryName
        ORDER BY seq DESC, l_orderkey DESC, l_linenumber DESC, TotalQuantity DESC, AvgUnitPrice DESC) = 1""",
    "A6_full_refresh": _STATUS + "SELECT * FROM st WHERE dataset IN ('sales_recent', 'journey_plan')",
    "A10_validate_input": sb.with_(*sb.TO_SALES, """n AS (SELECT COUNT(*) AS n, COUNT(TrxDate) AS good FROM sales)""") + """
        SELECT 'required_columns' AS "check", true AS passed, '' AS detail UNION ALL SELECT 'numeric_target', true, 'double'
        UNION ALL SELECT 'causal_columns', true, ''
        UNION ALL SELECT 'parseable_dates', good > 0 OR n = 0, concat(good, '/', n) FROM n""",
    "A7_dataset_status": _STATUS + "SELECT * FROM st",
    "A7_status_summary": _STATUS + """SELECT COUNT(*) AS datasets,
        CAST(SUM(rows) AS BIGINT) AS total_rows, MAX(last_date) AS newest_date FROM st""",
    "A8_bad_date_drop": _S + "SELECT * EXCLUDE (revenue) FROM rev WHERE day(TrxDate) % 7 <> 0",
    "A9_normalise": _C + """SELECT TrxDate, RouteCode, CustomerCode, ItemCode, CategoryCode,
        TotalQuantity FROM cust WHERE TotalQuantity > 0""",
    "A9_confident_demand": sb.with_(*sb.TO_FCST) + """SELECT TrxDate, RouteCode, ItemCode,
        DemandProbability FROM fcst WHERE DemandProbability >= 0.99""",
    "A11_freshness": sb.with_(*sb.TO_CUST, sb.SALES, sb.journey(), sb.FORECAST) + """,
        m AS (SELECT (SELECT MAX(JourneyDate) FROM journey) AS journey_max_date,
          (SELECT MAX(TrxDate) FROM cust) AS customer_max_date,
          (SELECT MAX(TrxDate) FROM fcst) AS demand_max_date,
          (SELECT MAX(TrxDate) FROM sales) AS sales_max_date)
        SELECT *, isodow(DATE '2001-07-30') <> 5 AND (journey_max_date IS NULL
          OR journey_max_date < DATE '2001-07-30') AS journey_stale,
          sales_max_date IS NULL OR sales_max_date < DATE '2001-08-03' AS sales_need_full_refresh
        FROM m""",
    "H1_sales_load": _S + """SELECT TrxDate, RouteCode, ItemCode, CategoryName, TotalQuantity,
        AvgUnitPrice, revenue FROM rev""",
    "H2_sales_totals": _S + f"""SELECT COUNT(*) AS transactions,
        {sb.rint('SUM(TotalQuantity)', 1)} AS total_quantity, {sb.rint('SUM(revenue)', 2)} AS total_revenue,
        COUNT(DISTINCT RouteCode) AS unique_routes, COUNT(DISTINCT ItemCode) AS unique_items,
        COUNT(DISTINCT WarehouseCode) AS unique_warehouses,
        COUNT(DISTINCT CategoryName) AS unique_categories, MIN(TrxDate) AS first_date,
        MAX(TrxDate) AS last_date,
        CAST(date_diff('day', MIN(TrxDate), MAX(TrxDate)) AS INT) AS days_covered FROM rev""",
    "H3_daily_trend": _S + f"""SELECT TrxDate AS date, {_QR} FROM rev
        WHERE TrxDate >= (SELECT MAX(TrxDate) FROM rev) - 90 GROUP BY TrxDate""",
    "H4_top_items": _S + f"""SELECT ItemCode, ItemName, {_QR} FROM rev GROUP BY ALL
        ORDER BY quantity DESC, ItemCode LIMIT 10""",
    "H4_top_routes": _S + f"""SELECT RouteCode, {_QR}, COUNT(DISTINCT ItemCode) AS items FROM rev
        GROUP BY RouteCode ORDER BY quantity DESC, RouteCode LIMIT 10""",
    "H4_top_categories": _S + f"""SELECT CategoryName, {_QR} FROM rev
        WHERE CategoryName IS NOT NULL GROUP BY CategoryName
        ORDER BY quantity DESC, CategoryName LIMIT 10""",
    "H5_item_catalog": _S + f"""SELECT trim(ItemCode) AS ItemCode, ItemName, CategoryName,
        {sb.rint(f"CAST(SUM(CAST({sb.rint('AvgUnitPrice * 100', 0)} AS BIGINT)) AS DOUBLE) / COUNT(AvgUnitPrice)", 0)} / 100 AS avg_price,
        {sb.rint("arg_max(AvgUnitPrice, (TrxDate, WarehouseCode, RouteCode, AvgUnitPrice))", 2)} AS last_price,
        {sb.rint('SUM(TotalQuantity)', 1)} AS total_quantity, COUNT(TrxDate) AS transactions,
        MAX(TrxDate) AS last_seen FROM rev
        WHERE TrxDate >= (SELECT MAX(TrxDate) FROM rev) - 365 GROUP BY ALL""",
    "H6_business_kpis": _S + f""", a AS (SELECT MAX(TrxDate) AS anchor FROM rev),
        g AS (SELECT anchor, date_diff('day', TrxDate, anchor) AS age, revenue FROM rev, a),
        t AS (SELECT anchor,
          COALESCE(SUM(CASE WHEN age = 0 THEN revenue END), 0) AS d0,
          COALESCE(SUM(CASE WHEN age = 7 THEN revenue END), 0) AS d1,
          COALESCE(SUM(CASE WHEN age BETWEEN 0 AND 6 THEN revenue END), 0) AS w0,
          COALESCE(SUM(CASE WHEN age BETWEEN 7 AND 13 THEN revenue END), 0) AS w1 FROM g GROUP BY anchor)
        SELECT anchor AS anchor_date, {sb.rint('d0', 2)} AS day_revenue,
          CASE WHEN d1 > 0 THEN {sb.rint('(d0 - d1) / d1 * 100', 1)} END AS day_delta_pct,
          {sb.rint('w0', 2)} AS week_revenue, {sb.rint('w1', 2)} AS prior_week_revenue,
          CASE WHEN w1 > 0 THEN {sb.rint('(w0 - w1) / w1 * 100', 1)} END AS week_delta_pct FROM t""",
    "H7_forecast_accuracy_7d": sb.with_(*sb.TO_FCST) + f"""SELECT COUNT(*) AS rows_compared,
        {sb.rint('greatest(0, 100 - SUM(abs(ActualQty - Predicted)) / SUM(ActualQty) * 100)', 1)} AS accuracy_pct,
        7 AS window_days FROM fcst
        WHERE TrxDate BETWEEN DATE '2001-07-01' - 6 AND DATE '2001-07-01' AND ActualQty > 0""",
    "H8_operations_summary": sb.with_(sb.journey()) + f"""SELECT COUNT(DISTINCT RouteCode) AS routes,
        COUNT(DISTINCT CustomerCode) AS customers, COUNT(DISTINCT JourneyDate) AS days_active
        FROM journey WHERE JourneyDate BETWEEN {sb.TARGET} - 6 AND {sb.TARGET}""",
    "H9_item_window_stats": _window_sql("ItemCode"),
    "H9_item_route_window_stats": _window_sql("ItemCode, RouteCode"),
    "H10_route_sales_on_date": sb.with_(sb.RAW, _LINES) + """SELECT RouteCode, TrxDate, CustomerCode,
        MAX(CustomerName) AS CustomerName,
        string_agg(ItemCode || ':' || qty, ',' ORDER BY ItemCode) AS items,
        CAST(SUM(qty) AS BIGINT) AS total_qty
        FROM lines WHERE qty > 0 GROUP BY RouteCode, TrxDate, CustomerCode""",
    "H11_customer_sales_on_date": sb.with_(sb.RAW, _LINES) + """SELECT ItemCode, qty FROM lines
        WHERE qty > 0 AND RouteCode = '2' AND CustomerCode = '817' AND TrxDate = DATE '1996-01-20'""",
    "H12_customer_overview": _OV + "SELECT * FROM ov",
    "H12_customer_totals": _OV + f"""SELECT COUNT(DISTINCT CustomerCode) AS active_customers,
        CAST(SUM(visits) AS BIGINT) AS total_visits, {sb.rint('SUM(total_quantity)', 1)} AS total_quantity,
        {sb.rint('AVG(visits)', 1)} AS avg_visits_per_customer FROM ov""",
    "H12_customer_top": _OV + "SELECT * FROM ov ORDER BY total_quantity DESC, CustomerCode LIMIT 10",
    "H12_customers_by_route": _OV + """SELECT route_code, COUNT(DISTINCT CustomerCode) AS customers,
        SUM(total_quantity) AS total_quantity FROM ov GROUP BY route_code""",
}
