"""DuckDB statements of the derived business tables, as named CTE texts."""

from __future__ import annotations

TARGET = "DATE '2001-07-02'"


def rint(expr: str, digits: int = 0) -> str:
    scale = 10**digits
    return f"(round_even(CAST(({expr}) AS DOUBLE) * {scale}.0::DOUBLE, 0) / {scale}.0::DOUBLE)"


def halfup(expr: str, digits: int) -> str:
    scale = 10**digits
    return f"(floor(CAST(({expr}) AS DOUBLE) * {scale}.0::DOUBLE + 0.5::DOUBLE) / {scale}.0::DOUBLE)"


def raw(route: str = "region", item: str = "brand", keep: str = "") -> str:
    return f"""raw AS (
  SELECT CAST(o_orderdate AS DATE) AS TrxDate, CAST(n_{route}key AS VARCHAR) AS RouteCode,
    CAST(c_custkey AS VARCHAR) AS CustomerCode, c_name AS CustomerName,
    p_{item} AS ItemCode, p_{item} AS ItemName, p_type AS CategoryCode, p_type AS CategoryName,
    CAST(n_regionkey AS VARCHAR) AS WarehouseCode, r_name AS WarehouseName,
    CASE WHEN CAST(round(l_tax*100) AS INT) = 8 THEN 'FreeItem' ELSE 'OrderItem' END AS ItemType,
    CASE WHEN o_orderstatus = 'P' THEN 'Quotation' ELSE 'SalesInvoice' END AS TrxType,
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS QuantityInPCs,
    l_extendedprice / l_quantity AS UnitPrice{keep}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""


_CUST_KEYS = (
    "TrxDate, RouteCode, CustomerCode, CustomerName, ItemCode, ItemName, CategoryCode, CategoryName"
)
_SALES_KEYS = "TrxDate, WarehouseCode, WarehouseName, RouteCode, ItemCode, ItemName, CategoryName"
_SALES_AGG = (
    "SUM(CASE WHEN QuantityInPCs > 0 THEN QuantityInPCs ELSE 0 END) AS TotalQuantity, "
    + halfup("AVG(UnitPrice)", 2)
    + " AS AvgUnitPrice"
)
_INVOICED = "FROM raw WHERE ItemType = 'OrderItem' AND TrxType = 'SalesInvoice'"

CUSTOMER = f"cust AS (SELECT {_CUST_KEYS}, {_SALES_AGG} {_INVOICED} GROUP BY {_CUST_KEYS})"
SALES = f"sales AS (SELECT {_SALES_KEYS}, {_SALES_AGG} {_INVOICED} GROUP BY {_SALES_KEYS})"
HISTORY = f"hist AS (SELECT * FROM cust WHERE TotalQuantity > 0 AND TrxDate < {TARGET})"


def journey(first: str = "2001-06-02", days: int = 60) -> str:
    return f"""journey AS (
  SELECT CAST(d AS DATE) AS JourneyDate, CAST(n_regionkey AS VARCHAR) AS RouteCode,
    CAST(c_custkey AS VARCHAR) AS CustomerCode
  FROM customer JOIN nation ON c_nationkey = n_nationkey,
    range(DATE '{first}', DATE '{first}' + {days}, INTERVAL 1 DAY) AS t(d)
  WHERE (c_custkey * 7 + date_diff('day', DATE '1995-01-01', CAST(d AS DATE))) % 10 < 3)"""


FORECAST = f"""qd AS (SELECT TrxDate, RouteCode, ItemCode, SUM(TotalQuantity) AS q FROM sales GROUP BY ALL),
pairs AS (SELECT RouteCode, ItemCode,
    COALESCE(SUM(CASE WHEN TrxDate >= {TARGET} - 28 THEN q END), 0) AS q28,
    COALESCE(SUM(CASE WHEN TrxDate BETWEEN {TARGET} - 56 AND {TARGET} - 29 THEN q END), 0) AS q56
  FROM qd WHERE TrxDate < {TARGET} GROUP BY ALL),
fdates AS (SELECT pairs.*, CAST(d AS DATE) AS trx_date FROM pairs,
    range({TARGET} - 28, {TARGET} + 14, INTERVAL 1 DAY) AS t(d)),
fr0 AS (SELECT f.trx_date, f.RouteCode AS route_code, f.ItemCode AS item_code,
    f.trx_date >= {TARGET} AS future,
    CASE WHEN f.trx_date >= {TARGET}
      THEN q28 * (10 + date_diff('day', {TARGET}, f.trx_date) % 7) / 10 ELSE q56 / 28 END AS predicted, qd.q
  FROM fdates f LEFT JOIN qd ON qd.TrxDate = f.trx_date AND qd.RouteCode = f.RouteCode
    AND qd.ItemCode = f.ItemCode),
fcst AS (SELECT trx_date AS TrxDate, route_code AS RouteCode, item_code AS ItemCode,
    item_code AS ItemName, CASE WHEN future THEN 'Forecast' ELSE 'Test' END AS DataSplit,
    'intermittent' AS DemandClass, 'moving_average' AS ModelUsed, predicted AS Predicted,
    CASE WHEN predicted > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS DemandProbability,
    predicted AS QtyIfDemand,
    CASE WHEN future THEN NULL ELSE COALESCE(q, 0) END AS ActualQty,
    predicted * 0.5::DOUBLE AS LowerBound, predicted * 1.5::DOUBLE AS UpperBound,
    CAST(NULL AS DOUBLE) AS Adi, CAST(NULL AS DOUBLE) AS Cv2, CAST(NULL AS DOUBLE) AS NonzeroRatio,
    CAST(NULL AS DOUBLE) AS MeanQty, CAST(NULL AS DOUBLE) AS AvgGapDays FROM fr0)"""

RECS = f"""rp AS (SELECT RouteCode, CustomerCode, CustomerName, ItemCode, SUM(TotalQuantity) AS q,
    COUNT(*) AS n, MAX(TrxDate) AS last_buy,
    CAST(CustomerCode AS INT) AS k, CAST(regexp_extract(ItemCode, '(\\d+)$', 1) AS INT) AS b
  FROM hist GROUP BY ALL),
plan AS ({journey('2001-07-02', 28)[len('journey AS ('):]},
r0 AS (SELECT p.JourneyDate AS TrxDate, rp.*, ((k * 37 + b * 11 + CAST(n AS INT) * 13) % 9000) / 100.0::DOUBLE + 10.0::DOUBLE AS PriorityScore,
    greatest(1, CAST(floor(q / n) AS INT)) AS RecommendedQuantity
  FROM plan p JOIN rp USING (RouteCode, CustomerCode)),
recs AS (SELECT TrxDate, RouteCode, CustomerCode, CustomerName, ItemCode, ItemCode AS ItemName,
    RecommendedQuantity,
    CASE WHEN PriorityScore >= 75 THEN 'MUST_STOCK' WHEN PriorityScore >= 55 THEN 'SHOULD_STOCK'
      WHEN PriorityScore >= 35 THEN 'CONSIDER' ELSE 'MONITOR' END AS Tier,
    RecommendedQuantity * 3 AS VanLoad, PriorityScore,
    CAST(floor(q / n) AS INT) AS AvgQuantityPerVisit,
    CAST(date_diff('day', last_buy, {TARGET}) AS INT) AS DaysSinceLastPurchase,
    CAST((k + b) % 30 + 1 AS DOUBLE) AS PurchaseCycleDays,
    CAST((k * 3 + b) % 100 AS DOUBLE) AS FrequencyPercent,
    0.0::DOUBLE AS ChurnProbability, 0.5::DOUBLE AS PatternQuality, CAST(n AS INT) AS PurchaseCount,
    CASE WHEN (k + b) % 3 = 0 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS TrendFactor,
    '[{{"kind":"regular_buyer","detail":"Bought on ' || n || ' visits.","weight":1.0}}]' AS Signals,
    CASE WHEN (k + b) % 4 <> 0 THEN 'Bought on ' || n || ' visits.' END AS WhyItem,
    'Usual quantity.' AS WhyQuantity, 0.5::DOUBLE + (k % 5) / 10.0::DOUBLE AS Confidence,
    list_extract(['history', 'peer', 'basket', 'reactivation', 'seed'], (k + b) % 5 + 1) AS Source
  FROM r0)"""

SESSIONS = """sess AS (SELECT RouteCode || '_' || CAST(TrxDate AS VARCHAR) AS session_id,
    RouteCode AS route_code, TrxDate AS date, CustomerCode AS customer_code,
    CustomerName AS customer_name, ItemCode AS item_code, ItemName AS item_name,
    RecommendedQuantity AS recommended_qty, 0 AS adjustment,
    CASE WHEN CAST(CustomerCode AS INT) % 5 <> 0
      THEN CAST(RecommendedQuantity * (CAST(CustomerCode AS INT) % 4) // 2 AS INT) ELSE 0 END AS actual_qty,
    Tier AS tier, PriorityScore AS priority_score,
    DaysSinceLastPurchase AS days_since_last_purchase, PurchaseCycleDays AS purchase_cycle_days,
    FrequencyPercent AS frequency_percent, VanLoad AS van_inventory_qty,
    CAST(CustomerCode AS INT) % 5 <> 0 AS visited,
    CASE WHEN CAST(CustomerCode AS INT) % 5 <> 0 THEN CAST(CustomerCode AS INT) ELSE 0 END AS visit_sequence
  FROM recs),
sitems AS (SELECT *, actual_qty > 0 AS was_sold, visited AS was_edited FROM sess)"""

VISITS = """vsales AS (
  SELECT date AS TrxDate, route_code AS RouteCode, customer_code AS CustomerCode,
    item_code AS ItemCode, CAST(actual_qty AS DOUBLE) AS TotalQuantity
  FROM sitems WHERE actual_qty > 0
  UNION ALL
  SELECT date, route_code,
    CASE WHEN CAST(customer_code AS INT) % 7 = 0 THEN 'U' || customer_code ELSE customer_code END,
    'X' || item_code, CAST(CAST(customer_code AS INT) % 5 + 1 AS DOUBLE)
  FROM sitems WHERE (CAST(customer_code AS INT) + day(date)) % 3 = 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


RAW = raw()
TO_SALES = (RAW, SALES)
TO_CUST = (RAW, CUSTOMER)
TO_HIST = (RAW, CUSTOMER, HISTORY)
TO_FCST = (RAW, SALES, FORECAST)
TO_RECS = (RAW, CUSTOMER, HISTORY, RECS)
TO_SESS = (*TO_RECS, SESSIONS)
TO_VISITS = (*TO_SESS, VISITS)
EVENTS = """ev AS (SELECT ts, CAST(ts AS DATE) AS TrxDate, CAST(user_id % 5 AS VARCHAR) AS RouteCode,
    CAST(user_id AS VARCHAR) AS CustomerCode, event_type AS ItemCode, value AS QuantityInPCs FROM events)"""
