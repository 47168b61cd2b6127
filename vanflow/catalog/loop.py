"""Feedback, adoption, planning and accuracy aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanflow.catalog import sqlbase as sb
from vanflow.catalog.helpers import rounded, shared
from vanflow.config import CLAMPS, DASHBOARD
from vanflow.operators import accuracy as ac
from vanflow.operators import adoption as ad
from vanflow.operators import evaluate, kpis
from vanflow.operators import feedback as fb
from vanflow.plans.feedback_run import feedback_run
from vanflow.sources import fixtures as fx

TODAY = "2001-07-29"


def recs(s, d, by=fx.OF_ROUTE):
    """Not stored: its rows are the plan's days times what was bought, which is."""
    return fx.stored_recommendations(s, d, by=by)


def sessions(s, d, by=fx.OF_ROUTE):
    return fx.session_items(s, d, by=by)


def attribution(s, d):
    return shared("attribution", s, d, lambda: fb.build_attribution(
        recs(s, d, fx.OF_CUSTOMER), sessions(s, d, fx.OF_CUSTOMER), dealt=True), lambda df: fx.cut_in_place(s, d, df))


def previous(s, d):
    """Last run's multipliers: three lanes per route, and as many of closed routes."""
    base = recs(s, d).groupBy("RouteCode", "Source").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("Source").isin("history", "basket", "seed"))
    row = lambda route: base.select(
        route.alias("route"), F.col("Source").alias("source"),
        (F.lit(0.6) + F.col("n") % 9 / 10.0).alias("multiplier"),
        (F.col("n") % 10 / 10.0).alias("confidence"), F.col("n").cast("int").alias("n"))
    return row(F.col("RouteCode")).unionByName(row(F.concat(F.lit("closed-"), F.col("RouteCode"))))


def raw_multipliers(s, d):
    return fb.shrunk_multipliers(attribution(s, d), CLAMPS)


def multipliers(s, d):
    return fb.smoothed_multipliers(raw_multipliers(s, d), previous(s, d), CLAMPS)


def merged(s, d):
    return shared("merged-adoption", s, d, lambda: ad.merge_adoption(
        recs(s, d, fx.OF_CUSTOMER), fx.visit_sales(s, d, fx.OF_CUSTOMER), dealt=True), lambda df: fx.cut_in_place(s, d, df))


def plan(s, d):
    return ad.upcoming_plan(s, fx.journey(s, d), fx.demand_forecast(s, d),
                            ad.item_prices(fx.customer_data(s, d)), fx.TARGET, 20)


def compared(s, d):
    rows = fx.forecast_results(s, d).filter("data_split = 'Test'")
    return shared("compared", s, d, lambda: ac.comparison(rows, fx.raw_sales(s, d)))


def future(s, d):
    """Future rows with the columns of a published forecast."""
    return fx.demand_forecast(s, d).filter("DataSplit = 'Forecast'").select(
        "TrxDate", "RouteCode", "ItemCode", F.col("Predicted").alias("prediction"),
        F.when(F.col("Predicted") > 20, 0.9).otherwise(0.6).alias("p_demand"),
        F.col("LowerBound").alias("q_10"), F.col("UpperBound").alias("q_90"))


def enriched(s, d):
    return ac.enrich_forecast(future(s, d), kpis.item_catalog(kpis.with_revenue(fx.sales_recent(s, d))))


def _drift(s, d):
    test = compared(s, d).select("trx_date", "actual_qty", "predicted")
    return ac.drift_status(test, test.filter("trx_date > DATE '2001-06-30'"), test, "2001-07-05", DASHBOARD)


def _route_status(s, d):
    f = evaluate.future_route_summary(
        future(s, d).filter("RouteCode <> '2'"), _FC, date=fx.TARGET)
    counts = ad.journey_counts(fx.journey(s, d).filter("RouteCode <> '3'"), fx.TARGET)
    return ac.route_status(fx.journey(s, d), f, counts)


class _FC:
    """Key names of the published forecast."""

    group_keys = ("RouteCode", "ItemCode")
    date_col = "TrxDate"


QUERIES = {
    "M1_attribution": lambda s, d: rounded(attribution(s, d)),
    "M2_adversarial_sessions": lambda s, d: rounded(fb.drop_adversarial_sessions(
        attribution(s, d), _strict())),
    "M3_corpus_hit_rates": lambda s, d: rounded(fb.corpus_hit_rates(attribution(s, d), CLAMPS)),
    "M3_route_hit_rates": lambda s, d: rounded(fb.route_hit_rates(attribution(s, d))),
    "M4_shrunk_multipliers": lambda s, d: rounded(raw_multipliers(s, d)),
    "M5_smoothed_multipliers": lambda s, d: rounded(multipliers(s, d)),
    "M6_feedback_run": lambda s, d: rounded(feedback_run(
        fx.stored_recommendations(s, d), fx.session_items(s, d), previous(s, d), TODAY)),
    "M7_active_feedback_routes": lambda s, d: fb.active_routes(multipliers(s, d)),
    "N1_adoption_merge": merged,
    "N2_adoption_summary": lambda s, d: ad.adoption_summary(merged(s, d)),
    "N3_daily_adoption": lambda s, d: ad.daily_adoption(merged(s, d)),
    "N4_top_over_recommended": lambda s, d: ad.top_adoption_items(merged(s, d), "over"),
    "N4_top_missed": lambda s, d: ad.top_adoption_items(merged(s, d), "missed"),
    "N5_adoption_by_tier": lambda s, d: ad.adoption_by_tier(merged(s, d)),
    "N6_adoption_highlights": lambda s, d: rounded(ad.adoption_highlights(merged(s, d)), 4),
    "N7_upcoming_plan": plan,
    "N8_plan_summary": lambda s, d: ad.plan_summary(plan(s, d)),
    "N9_journey_counts": lambda s, d: ad.journey_counts(fx.journey(s, d), fx.TARGET),
    "G1_comparison": lambda s, d: rounded(ac.ordered(compared(s, d))),
    "G2_comparison_summary": lambda s, d: ac.comparison_summary(compared(s, d)),
    "G3_drift_status": _drift,
    "G4_daily_stats": lambda s, d: rounded(ac.daily_stats(compared(s, d), DASHBOARD), 4),
    "G4_daily_stats_by_route": lambda s, d: rounded(ac.daily_stats(compared(s, d), DASHBOARD, ["route_code"]), 4),
    "G4_daily_chart": lambda s, d: ac.daily_chart(compared(s, d)),
    "G5_item_variance": lambda s, d: ac.item_variance(compared(s, d)),
    "G5_most_accurate_item": lambda s, d: rounded(ac.most_accurate_item(compared(s, d), DASHBOARD)),
    "G6_van_load_summary": lambda s, d: rounded(ac.van_load_summary(
        enriched(s, d), DASHBOARD, ["RouteCode", "TrxDate"]), 4),
    "G7_forecast_enrichment": lambda s, d: rounded(enriched(s, d)),
    "G7_top_forecast_items": lambda s, d: rounded(ac.top_forecast_items(
        enriched(s, d).filter(F.col("TrxDate") == F.lit(fx.TARGET).cast("date")))),
    "G8_forecast_chart": lambda s, d: ac.forecast_chart(future(s, d), fx.TARGET),
    "G8_forecast_chart_one_item": lambda s, d: ac.forecast_chart(future(s, d), fx.TARGET, ["Brand#7"]),
    "G9_route_status": _route_status,
}


def _strict():
    """A lower z limit, so that the filter has something to drop."""
    from dataclasses import replace

    return replace(CLAMPS, feedback_adversarial_z=1.0)


_ATT = """vis AS (SELECT DISTINCT route_code, date, customer_code FROM sitems WHERE visited),
outc AS (SELECT route_code, date, customer_code, item_code, CAST(SUM(actual_qty) AS BIGINT) AS actual_qty,
    bool_or(was_sold) AS was_sold, MIN(session_id) AS session_id FROM sitems WHERE visited AND item_code <> '' GROUP BY ALL),
att AS (SELECT r.RouteCode AS route_code, r.TrxDate AS date, r.CustomerCode AS customer_code, r.ItemCode AS item_code,
    RecommendedQuantity AS recommended_qty, Source AS source, Confidence AS confidence,
    COALESCE(o.actual_qty, 0) AS actual_qty, COALESCE(o.was_sold, false) AS was_sold, COALESCE(o.session_id, '') AS session_id
  FROM recs r JOIN vis v ON v.route_code = r.RouteCode AND v.date = r.TrxDate AND v.customer_code = r.CustomerCode
  LEFT JOIN outc o ON o.route_code = r.RouteCode AND o.date = r.TrxDate AND o.customer_code = r.CustomerCode
    AND o.item_code = r.ItemCode),
attr AS (SELECT *, actual_qty > 0 AS was_bought,
    1 - least(1, abs(recommended_qty - actual_qty) / greatest(recommended_qty, actual_qty, 1)) AS qty_accuracy FROM att),
rr AS (SELECT route_code, session_id, 1 - COUNT(*) FILTER (was_bought) / COUNT(*) AS reject_rate FROM attr GROUP BY ALL),
rs AS (SELECT route_code, AVG(reject_rate) AS m, stddev_pop(reject_rate) AS sd FROM rr GROUP BY ALL
  HAVING COUNT(*) >= 3 AND stddev_pop(reject_rate) > 0)"""


def _mult(source: str) -> str:
    return f"""per AS (SELECT route_code, source, COUNT(*) AS n, COUNT(*) FILTER (was_bought) AS hits, AVG(qty_accuracy) AS qty_accuracy
  FROM {source} GROUP BY ALL),
corp AS (SELECT source, SUM(hits) / SUM(n) AS cr FROM per GROUP BY ALL),
kk AS (SELECT greatest(1, quantile_cont(CAST(n AS DOUBLE), 0.5) / 4) AS k FROM per),
rawm AS (SELECT route_code AS route, source, n, k, greatest(0.5::DOUBLE, least(1.5::DOUBLE,
    CASE WHEN cr <= 0 THEN 1 ELSE (n * (hits / n) + k * cr) / (n + k) / cr END)) AS raw_multiplier
  FROM per JOIN corp USING (source), kk),
pb AS (SELECT RouteCode, Source, COUNT(*) AS n FROM recs WHERE Source IN ('history', 'basket', 'seed') GROUP BY ALL),
prev AS (SELECT RouteCode AS route, Source AS source, 0.6::DOUBLE + n % 9 / 10.0::DOUBLE AS multiplier, n % 10 / 10.0::DOUBLE AS confidence, n FROM pb
  UNION ALL SELECT 'closed-' || RouteCode, Source, 0.6::DOUBLE + n % 9 / 10.0::DOUBLE, n % 10 / 10.0::DOUBLE, n FROM pb),
mult AS (SELECT route, source,
    CASE WHEN raw_multiplier IS NOT NULL THEN {sb.rint('greatest(0.5, least(1.5, 0.3::DOUBLE * raw_multiplier + 0.7::DOUBLE * COALESCE(p.multiplier, 1)))', 4)}
      ELSE p.multiplier END AS multiplier,
    CASE WHEN raw_multiplier IS NOT NULL THEN {sb.rint('least(1, r.n / greatest(k, 1))', 4)} ELSE p.confidence END AS confidence,
    CAST(CASE WHEN raw_multiplier IS NOT NULL THEN r.n ELSE p.n END AS INT) AS n
  FROM rawm r FULL OUTER JOIN prev p USING (route, source))"""


_M = sb.with_(*sb.TO_SESS, _ATT, _mult("attr"))
_MW = sb.with_(*sb.TO_SESS, _ATT, """clean AS (SELECT attr.* FROM attr LEFT JOIN
    (SELECT rr.route_code, session_id FROM rr JOIN rs USING (route_code) WHERE abs(reject_rate - m) / sd > 3) b
    USING (route_code, session_id) WHERE b.session_id IS NULL AND date BETWEEN DATE '2001-07-29' - 30 AND DATE '2001-07-29')""",
               _mult("clean"))
_ATT_COLS = f"""route_code, date, customer_code, item_code, recommended_qty, source, {sb.rint('confidence', 6)} AS confidence,
  actual_qty, was_sold, session_id, was_bought, {sb.rint('qty_accuracy', 6)} AS qty_accuracy"""
_AD = sb.with_(*sb.TO_VISITS, """vk AS (SELECT DISTINCT TrxDate, RouteCode, CustomerCode FROM recs),
vs AS (SELECT vsales.* FROM vsales JOIN vk USING (TrxDate, RouteCode, CustomerCode)),
mg AS (SELECT TrxDate AS trx_date, RouteCode AS route_code, CustomerCode AS customer_code, ItemCode AS item_code, r.Tier AS tier,
    CAST(COALESCE(r.RecommendedQuantity, 0) AS DOUBLE) AS recommended_qty, COALESCE(v.TotalQuantity, 0) AS actual_qty,
    r.Tier IS NOT NULL AS recommended, r.Tier IS NOT NULL AND COALESCE(v.TotalQuantity, 0) > 0 AS adopted,
    r.Tier IS NOT NULL AND COALESCE(v.TotalQuantity, 0) <= 0 AS over_recommended, r.Tier IS NULL AS missed
  FROM recs r FULL OUTER JOIN vs v USING (TrxDate, RouteCode, CustomerCode, ItemCode)),
dly AS (SELECT trx_date, COUNT(*) FILTER (recommended) AS recommended, COUNT(*) FILTER (adopted) AS adopted,
    CASE WHEN COUNT(*) FILTER (recommended) > 0 THEN """ + sb.rint("COUNT(*) FILTER (adopted) / COUNT(*) FILTER (recommended) * 100", 1)
               + """ ELSE 0 END AS adoption_pct FROM mg GROUP BY trx_date),
trs AS (SELECT tier, COUNT(*) AS recommended, COUNT(*) FILTER (adopted) AS adopted,
    """ + sb.rint("COUNT(*) FILTER (adopted) / COUNT(*) * 100", 1) + """ AS adoption_pct FROM mg WHERE recommended GROUP BY tier)""")
_PLAN = sb.with_(*sb.TO_CUST, sb.SALES, sb.journey(), sb.FORECAST, f"""hz AS (SELECT CAST(d AS DATE) AS date
    FROM range({sb.TARGET}, {sb.TARGET} + 20, INTERVAL 1 DAY) t(d)),
pr AS (SELECT ItemCode, AVG(AvgUnitPrice) AS price FROM cust GROUP BY ALL HAVING AVG(AvgUnitPrice) > 0),
vi AS (SELECT JourneyDate AS date, COUNT(DISTINCT CustomerCode) AS customers, COUNT(DISTINCT RouteCode) AS routes FROM journey GROUP BY ALL),
vo AS (SELECT TrxDate AS date, SUM(Predicted) AS q, SUM(Predicted * price) AS rv FROM fcst LEFT JOIN pr USING (ItemCode) GROUP BY ALL),
pl AS (SELECT date, COALESCE(customers, 0) AS customers, COALESCE(routes, 0) AS routes, {sb.rint('COALESCE(q, 0)', 1)} AS predicted_qty,
    CASE WHEN rv > 0 THEN {sb.rint('rv', 2)} END AS est_revenue FROM hz LEFT JOIN vi USING (date) LEFT JOIN vo USING (date))""")
_G = sb.with_(*sb.TO_FCST, f"""act AS (SELECT TrxDate, RouteCode, ItemCode, SUM(CASE WHEN QuantityInPCs > 0 THEN QuantityInPCs ELSE 0 END) AS aq
  FROM raw WHERE ItemType = 'OrderItem' AND TrxType = 'SalesInvoice' GROUP BY ALL),
cmp AS (SELECT f.TrxDate AS trx_date, f.RouteCode AS route_code, f.ItemCode AS item_code, ItemName AS item_name, DemandClass AS demand_class,
    ModelUsed AS model_used, Predicted AS predicted, LowerBound AS lower_bound, UpperBound AS upper_bound, COALESCE(aq, 0) AS actual_qty
  FROM fcst f LEFT JOIN act USING (TrxDate, RouteCode, ItemCode) WHERE DataSplit = 'Test'),
fu AS (SELECT TrxDate, RouteCode, ItemCode, Predicted AS prediction, CASE WHEN Predicted > 20 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS p_demand,
    LowerBound AS q_10, UpperBound AS q_90 FROM fcst WHERE DataSplit = 'Forecast'),
cat AS (SELECT ItemCode, CategoryName, {sb.rint('AVG(AvgUnitPrice)', 2)} AS avg_price,
    {sb.rint('arg_max(AvgUnitPrice, (TrxDate, WarehouseCode, RouteCode, AvgUnitPrice))', 2)} AS last_price, MAX(TrxDate) AS last_seen
  FROM sales WHERE TrxDate >= (SELECT MAX(TrxDate) FROM sales) - 365 GROUP BY ItemCode, CategoryName),
lat AS (SELECT ItemCode, CASE WHEN last_price > 0 THEN last_price WHEN avg_price > 0 THEN avg_price ELSE 0 END AS price FROM cat
  QUALIFY row_number() OVER (PARTITION BY ItemCode ORDER BY last_seen DESC, CategoryName DESC) = 1),
en AS (SELECT fu.*, price AS AvgUnitPrice, CASE WHEN price IS NULL THEN '' ELSE fu.ItemCode END AS ItemName FROM fu LEFT JOIN lat USING (ItemCode)),
iv AS (SELECT item_code, {sb.rint('SUM(predicted)', 1)} AS predicted, {sb.rint('SUM(actual_qty)', 1)} AS actual,
    {sb.rint('SUM(actual_qty) - SUM(predicted)', 1)} AS variance FROM cmp GROUP BY item_code ORDER BY abs(variance) DESC, item_code LIMIT 10)""")


def _acc(cond: str = "true", digits: int = 2, source: str = "cmp") -> str:
    inner = ("greatest(0, 100 - SUM(CASE WHEN actual_qty > 0 THEN abs(actual_qty - predicted) END) "
             "/ SUM(CASE WHEN actual_qty > 0 THEN actual_qty END) * 100)")
    return f"(SELECT {sb.rint(inner, digits)} FROM {source} WHERE {cond})"


def _daily_stats_sql(by: str) -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    using = f"USING ({by})" if by else "ON true"
    r4 = lambda e: sb.rint(e, 4)
    return _G + f""", dd AS (SELECT {key}trx_date, SUM(predicted) AS p, SUM(actual_qty) AS a,
      SUM(CASE WHEN actual_qty > 0 THEN abs(actual_qty - predicted) END) AS err, SUM(CASE WHEN actual_qty > 0 THEN actual_qty END) AS sold,
      SUM(least(predicted, actual_qty)) AS served FROM cmp GROUP BY ALL),
    ds AS (SELECT *, abs(p - a) / a <= 0.2 AS hit, greatest(0, 100 - abs(p - a) / a * 100) AS acc,
      row_number() OVER ({part} ORDER BY trx_date) AS i, COUNT(*) OVER ({part}) AS n FROM dd WHERE a > 0),
    st AS (SELECT *, i - row_number() OVER (PARTITION BY {key}hit ORDER BY trx_date) AS island FROM ds),
    sk AS (SELECT {key}MAX(len) AS best_streak FROM (SELECT {key}island, COUNT(*) AS len FROM st WHERE hit GROUP BY ALL) GROUP BY {by or '()'}),
    w AS (SELECT {key}SUM(p) AS tp, SUM(a) AS ta, SUM(err) AS err, SUM(sold) AS sold, SUM(served) AS served FROM dd GROUP BY {by or '()'}),
    h AS (SELECT {key}COUNT(*) AS days_scored, COUNT(*) FILTER (hit) AS days_on_target, arg_max(trx_date, (acc, -epoch(trx_date))) AS best_day,
      MAX(acc) AS best_acc,
      CASE WHEN COUNT(*) >= 2 THEN greatest(0, 100 - SUM(CASE WHEN i > n // 2 THEN abs(p - a) END) / SUM(CASE WHEN i > n // 2 THEN a END) * 100)
        - greatest(0, 100 - SUM(CASE WHEN i <= n // 2 THEN abs(p - a) END) / SUM(CASE WHEN i <= n // 2 THEN a END) * 100) END AS trend
      FROM st GROUP BY {by or '()'})
    SELECT {key}{r4('CASE WHEN sold > 0 THEN greatest(0, 100 - err / sold * 100) END')} AS accuracy_pct,
      {r4('CASE WHEN ta > 0 THEN (tp - ta) / ta * 100 END')} AS bias_pct,
      {r4('served')} AS demand_served, {r4('CASE WHEN tp > 0 THEN least(ta, tp) / tp * 100 END')} AS sell_through_pct,
      COALESCE(days_on_target, 0) AS days_on_target, COALESCE(days_scored, 0) AS days_scored,
      COALESCE(best_streak, 0) AS best_streak, best_day, {r4('best_acc')} AS best_day_accuracy, {r4('trend')} AS trend_pp,
      CASE WHEN trend >= 2 THEN 'Improving' WHEN trend <= -2 THEN 'Slipping' WHEN trend IS NOT NULL THEN 'Steady' END AS trend
    FROM w LEFT JOIN h {using} LEFT JOIN sk {using}"""


ORACLES = {
    "M1_attribution": _M + f"SELECT {_ATT_COLS} FROM attr",
    "M2_adversarial_sessions": _M + f"""SELECT {_ATT_COLS} FROM attr WHERE NOT EXISTS (SELECT 1 FROM rr JOIN rs USING (route_code)
      WHERE rr.route_code = attr.route_code AND rr.session_id = attr.session_id AND abs(reject_rate - m) / sd > 1)""",
    "M3_corpus_hit_rates": _M + f"""SELECT source, COUNT(*) AS n, COUNT(*) FILTER (was_bought) AS hits,
      {sb.rint('AVG(qty_accuracy)', 6)} AS qty_accuracy, {sb.rint('COUNT(*) FILTER (was_bought) / COUNT(*)', 6)} AS hit_rate,
      COUNT(*) FILTER (was_bought) / COUNT(*) < 0.05 AS weak_source FROM attr GROUP BY source""",
    "M3_route_hit_rates": _M + f"""SELECT route_code, source, n, hits, {sb.rint('qty_accuracy', 6)} AS qty_accuracy,
      {sb.rint('hits / n', 6)} AS hit_rate FROM per""",
    "M4_shrunk_multipliers": _M + f"SELECT route, source, n, k, {sb.rint('raw_multiplier', 6)} AS raw_multiplier FROM rawm",
    "M5_smoothed_multipliers": _M + f"SELECT route, source, {sb.rint('multiplier', 6)} AS multiplier, confidence, n FROM mult",
    "M6_feedback_run": _MW + f"SELECT route, source, {sb.rint('multiplier', 6)} AS multiplier, confidence, n FROM mult",
    "M7_active_feedback_routes": _M + "SELECT COUNT(DISTINCT route) AS active_routes FROM mult WHERE abs(multiplier - 1) > 1e-6",
    "N1_adoption_merge": _AD + "SELECT * FROM mg",
    "N2_adoption_summary": _AD + f"""SELECT COUNT(*) FILTER (recommended) AS rows_recommended, COUNT(*) FILTER (adopted) AS rows_adopted,
      COUNT(*) FILTER (over_recommended) AS rows_over_recommended, COUNT(*) FILTER (missed) AS rows_missed,
      {sb.rint('COUNT(*) FILTER (adopted) / COUNT(*) FILTER (recommended) * 100', 1)} AS adoption_pct,
      {sb.rint('(AVG(actual_qty) FILTER (adopted) - AVG(actual_qty) FILTER (missed)) / AVG(actual_qty) FILTER (missed) * 100', 1)} AS uplift_pct,
      {sb.rint('SUM(recommended_qty) FILTER (recommended)', 1)} AS total_recommended_qty, {sb.rint('SUM(actual_qty)', 1)} AS total_sold_qty FROM mg""",
    "N3_daily_adoption": _AD + "SELECT * FROM dly",
    "N4_top_over_recommended": _AD + f"""SELECT item_code, COUNT(*) AS rows, {sb.rint('SUM(recommended_qty)', 1)} AS qty FROM mg
      WHERE over_recommended GROUP BY item_code ORDER BY rows DESC, item_code LIMIT 10""",
    "N4_top_missed": _AD + f"""SELECT item_code, COUNT(*) AS rows, {sb.rint('SUM(actual_qty)', 1)} AS qty FROM mg
      WHERE missed GROUP BY item_code ORDER BY rows DESC, item_code LIMIT 10""",
    "N5_adoption_by_tier": _AD + "SELECT * FROM trs",
    "N6_adoption_highlights": _AD + f""", o AS (SELECT *, row_number() OVER (ORDER BY trx_date) AS i, COUNT(*) OVER () AS n
        FROM dly WHERE recommended > 0)
      SELECT (SELECT {sb.rint('COUNT(*) FILTER (adopted) / (COUNT(*) FILTER (adopted) + COUNT(*) FILTER (missed)) * 100', 4)} FROM mg) AS coverage_pct,
        {sb.rint('AVG(CASE WHEN i > n // 2 THEN adoption_pct END) - AVG(CASE WHEN i <= n // 2 THEN adoption_pct END)', 4)} AS trend_pp,
        arg_max(trx_date, (adoption_pct, -epoch(trx_date))) AS best_day, MAX(adoption_pct) AS best_day_pct,
        (SELECT arg_max(tier, (adoption_pct, recommended, tier)) FROM trs) AS best_tier,
        (SELECT MAX(adoption_pct) FROM trs) AS best_tier_pct FROM o""",
    "N7_upcoming_plan": _PLAN + "SELECT * FROM pl",
    "N8_plan_summary": _PLAN + f"""SELECT CAST(SUM(customers) AS BIGINT) AS total_visits, {sb.rint('SUM(predicted_qty)', 1)} AS total_qty,
      {sb.rint('SUM(est_revenue)', 2)} AS total_revenue, arg_max(date, (predicted_qty, -epoch(date))) AS peak_day,
      MAX(predicted_qty) AS peak_qty, COUNT(*) FILTER (customers > 0 OR predicted_qty > 0) AS active_days FROM pl""",
    "N9_journey_counts": sb.with_(sb.journey()) + f"""SELECT RouteCode, COUNT(DISTINCT CustomerCode) AS customers
      FROM journey WHERE JourneyDate = {sb.TARGET} GROUP BY RouteCode""",
    "G1_comparison": _G + f"""SELECT trx_date, route_code, item_code, item_name, demand_class, model_used, {sb.rint('predicted', 6)} AS predicted,
      {sb.rint('lower_bound', 6)} AS lower_bound, {sb.rint('upper_bound', 6)} AS upper_bound, actual_qty,
      {sb.rint('actual_qty - predicted', 6)} AS variance,
      {sb.rint('CASE WHEN predicted > 0 THEN (actual_qty - predicted) / predicted * 100 ELSE 0 END', 6)} AS variance_pct FROM cmp""",
    "G2_comparison_summary": _G + f"""SELECT COUNT(*) AS rows_compared, {sb.rint('SUM(predicted)', 1)} AS total_predicted,
      {sb.rint('SUM(actual_qty)', 1)} AS total_actual,
      {sb.rint('AVG(CASE WHEN actual_qty > 0 THEN abs(actual_qty - predicted) END)', 2)} AS mae,
      {sb.rint('sqrt(AVG(CASE WHEN actual_qty > 0 THEN (actual_qty - predicted) * (actual_qty - predicted) END))', 2)} AS rmse,
      {sb.rint('SUM(CASE WHEN actual_qty > 0 THEN abs(actual_qty - predicted) END) / SUM(CASE WHEN actual_qty > 0 THEN actual_qty END) * 100', 2)} AS wape,
      {_acc(digits=1)} AS accuracy_pct FROM cmp""",
    "G3_drift_status": _G + f""", a AS (SELECT {_acc()} AS b,
        {_acc("trx_date > DATE '2001-06-30' AND trx_date BETWEEN DATE '2001-07-05' - 7 AND DATE '2001-07-05'", 1)} AS l,
        {_acc("trx_date >= (SELECT MAX(trx_date) FROM cmp) - 7")} AS t),
      r AS (SELECT b, CASE WHEN l > 0 THEN l ELSE t END AS ra, CASE WHEN l > 0 THEN 'live' WHEN t IS NOT NULL THEN 'test_set' ELSE 'unavailable' END AS source FROM a),
      q AS (SELECT *, {sb.rint('ra - b', 2)} AS delta FROM r)
      SELECT b AS baseline_accuracy, ra AS recent_accuracy, delta, source, CASE WHEN abs(least(0, delta)) > 7 THEN 'significant'
        WHEN abs(least(0, delta)) > 3 THEN 'drifting' ELSE 'stable' END AS status FROM q""",
    "G4_daily_stats": _daily_stats_sql(""),
    "G4_daily_stats_by_route": _daily_stats_sql("route_code"),
    "G4_daily_chart": _G + f"""SELECT trx_date, {sb.rint('SUM(predicted)', 2)} AS predicted, {sb.rint('SUM(actual_qty)', 2)} AS actual
      FROM cmp GROUP BY trx_date""",
    "G5_item_variance": _G + "SELECT * FROM iv",
    "G5_most_accurate_item": _G + f"""SELECT item_code, {sb.rint('abs(variance) / actual', 6)} AS error_share FROM iv
      WHERE actual > 0 AND actual >= (SELECT SUM(actual_qty) FROM cmp) * 0.05
      ORDER BY abs(variance) / actual, abs(variance) DESC, item_code LIMIT 1""",
    "G6_van_load_summary": _G + f"""SELECT RouteCode, TrxDate, COUNT(DISTINCT ItemCode) AS skus, {sb.rint('SUM(prediction)', 2)} AS total_qty,
      {sb.rint('SUM(prediction * AvgUnitPrice)', 4)} AS revenue, COUNT(*) FILTER (p_demand < 0.7) AS at_risk FROM en GROUP BY ALL""",
    "G7_forecast_enrichment": _G + "SELECT * FROM en",
    "G7_top_forecast_items": _G + f"""SELECT *, {sb.rint('prediction', 1)} AS predicted FROM en WHERE TrxDate = {sb.TARGET}
      ORDER BY prediction DESC, RouteCode, ItemCode LIMIT 10""",
    "G8_forecast_chart": _G + f"""SELECT TrxDate, {sb.rint('SUM(prediction)', 2)} AS predicted, 0.0::DOUBLE AS q10, 0.0::DOUBLE AS q90
      FROM fu GROUP BY TrxDate""",
    "G8_forecast_chart_one_item": _G + f"""SELECT TrxDate, {sb.rint('SUM(prediction)', 2)} AS predicted,
      {sb.rint('SUM(q_10)', 2)} AS q10, {sb.rint('SUM(q_90)', 2)} AS q90 FROM fu WHERE ItemCode = 'Brand#7' GROUP BY TrxDate""",
    "G9_route_status": sb.with_(*sb.TO_FCST, sb.journey()) + f""", f AS (SELECT RouteCode, COUNT(DISTINCT ItemCode) AS skus,
        {sb.rint('SUM(Predicted)', 1)} AS q FROM fcst WHERE DataSplit = 'Forecast' AND TrxDate = {sb.TARGET} AND RouteCode <> '2' GROUP BY ALL),
      c AS (SELECT RouteCode, COUNT(DISTINCT CustomerCode) AS n FROM journey WHERE JourneyDate = {sb.TARGET} AND RouteCode <> '3' GROUP BY ALL)
      SELECT r.RouteCode, CASE WHEN COALESCE(n, 0) > 0 AND skus IS NOT NULL THEN n || ' customers' WHEN COALESCE(n, 0) > 0
        THEN n || ' planned, no forecast' ELSE 'No visits' END AS status,
        CASE WHEN COALESCE(n, 0) > 0 THEN skus END AS items, CASE WHEN COALESCE(n, 0) > 0 THEN q END AS van_load
      FROM (SELECT DISTINCT RouteCode FROM journey) r LEFT JOIN f USING (RouteCode) LEFT JOIN c USING (RouteCode)""",
}
