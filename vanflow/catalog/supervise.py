"""Supervised visits and the stores around them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vanflow.catalog import forecast as fc
from vanflow.catalog import loop
from vanflow.catalog import orders
from vanflow.catalog import sqlbase as sb
from vanflow.catalog import sqlorders as so
from vanflow.catalog.forecast import classes, stitched
from vanflow.catalog.helpers import rounded, shared
from vanflow.operators import allocate
from vanflow.operators import feedback as fb
from vanflow.operators import supervision as sv
from vanflow.operators.supervision import SESSION
from vanflow.session import cut_lineage, shared_dir, small_side
from vanflow.sources import fixtures as fx
from vanflow.sources import stores as st


def visit_key():
    """The order of stops; built when a session is there."""
    return F.col("customer_code").cast("int")


def folder(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def items(s, d, by=fx.OF_ROUTE):
    return loop.sessions(s, d, by)


def scores(s, d):
    return shared("scores", s, d, lambda: sv.customer_scores(items(s, d)))


def opened(s, d, by=fx.OF_ROUTE):
    return sv.build_session_items(loop.recs(s, d, by))


def visits(s, d, by=fx.OF_ROUTE):
    stops = items(s, d, by).filter("visited").select("session_id", "customer_code").distinct()
    return stops.withColumn("visit_order", visit_key())


def applied(s, d):
    by = fx.OF_CUSTOMER
    return shared("applied", s, d, lambda: sv.apply_visits(
        opened(s, d, by), visits(s, d, by), fx.visit_sales(s, d, by)), lambda df: fx.cut_in_place(s, d, df))


def first_visit(s, d):
    """Only the first stop of every session has happened."""
    by = fx.OF_CUSTOMER
    first = visits(s, d, by).groupBy("session_id").agg(
        F.min(F.struct("visit_order", "customer_code")).alias("f")).select(
        "session_id", "f.customer_code", "f.visit_order")
    return sv.apply_visits(opened(s, d, by), cut_lineage(first), fx.visit_sales(s, d, by))


def _redistributed(s, d):
    after = shared("first-visit", s, d, lambda: first_visit(s, d), lambda df: fx.cut_in_place(s, d, df))
    unsold = after.filter("unsold > 0").select(
        "session_id", "item_code", F.col("customer_code").alias("from_customer"), "unsold")
    return sv.redistribute(after.drop("unsold"), small_side(unsold))


def _updated(s, d):
    edits = items(s, d).filter(F.col("visited") & ((visit_key() + F.length("item_code")) % 11 == 0)).select(
        "session_id", "customer_code", "item_code", F.col("recommended_qty").alias("new_qty"))
    return sv.customer_scores(sv.update_actuals(items(s, d), edits))


def nested(s, d):
    return st.nest_sessions(sv.nest_customers(items(s, d)), scores(s, d))


def _stored_sessions(s, d):
    path = folder(s, "sessions")
    records = st.session_records(sv.nest_customers(items(s, d)), scores(s, d))
    st.write_sessions(records, path)
    return st.read_sessions(s, path, st.nest_records(records).schema)


def _stored_records(s, d):
    """Every session's records stored, the days after the 15th written again with one unit more sold, and read back."""
    path = folder(s, "session-records")
    held = st.session_records(sv.nest_customers(items(s, d)), scores(s, d))
    st.write_session_records(held, path)
    later = st.read_session_records(s, path).filter(F.dayofmonth("date") > 15).withColumn("total_actual", F.col("total_actual") + 1)
    st.write_session_records(later, path, in_place=True)
    return rounded(st.read_session_records(s, path).select(
        *SESSION, "customer_code", "visited", "score", "total_actual", F.size("items").alias("n_items")))


def _rebuilt_records(s, d):
    rows = rounded(st.rebuild_records(
        st.session_customer_rows(scores(s, d)), st.session_item_rows(items(s, d, fx.OF_CUSTOMER))).select(
        "session_id", "customer_code", "visit_sequence", "score", "coverage", "total_items", "total_actual",
        F.size("items").alias("n_items")))
    return shared("rebuilt-records", s, d, lambda: rows, lambda df: fx.cut_in_place(s, d, df))


def _route_rows(s, d):
    return st.session_route_rows(
        sv.session_summary(scores(s, d)), sv.route_scores(scores(s, d)),
        F.col("date").cast("timestamp"))


def _with_reruns(s, d):
    """On even days a second session was started later on every route."""
    rows = _route_rows(s, d)
    again = rows.filter(F.dayofmonth("supervision_date") % 2 == 0).withColumns(
        {"session_id": F.concat("session_id", F.lit("_b")),
         "session_started_at": F.col("session_started_at") + F.expr("interval 1 hour")})
    return rows.unionByName(again)


def _rebuilt(s, d):
    whole = st.rebuild_sessions(
        _route_rows(s, d), st.session_customer_rows(scores(s, d)), st.session_item_rows(items(s, d)))
    return st.flat_items(whole.withColumnRenamed("supervision_date", "date")).select(
        "session_id", "customer_code", "visit_sequence", "item_code", "recommended_qty", "adjustment",
        "actual_qty", "was_sold", "tier", "priority_score")


def _store(s, d):
    path = folder(s, "recommendations")
    st.replace_slices(loop.recs(s, d), path, ["TrxDate", "RouteCode"])
    return st.read_store(s, path, loop.recs(s, d).schema)


def _partial_store(s, d):
    """The store before route 4 of the target date was generated."""
    day = F.col("TrxDate") == F.lit(fx.TARGET).cast("date")
    return loop.recs(s, d).filter(~(day & (F.col("RouteCode") == "4")))


def _artifact(s, d):
    base = folder(s, "artifacts")
    st.write_artifact(classes(s, d), base, "pair_classes")
    return rounded(st.read_artifact(s, base, "pair_classes", demand_class="erratic", offset=3, limit=20))


def _metrics(s, d):
    run = orders.run(s, d)
    rows = st.generation_metric_rows(
        allocate.generator_metrics(run.candidates, run.rows), run.calibration, fx.TARGET,
        "2001-07-02T04:00:00")
    path = folder(s, "generation-metrics")
    st.append_metrics(rows, path)
    return rounded(s.read.schema(rows.schema).parquet(path))


def _window(s, d):
    frame = fb.in_window(nested(s, d), "date", "2001-07-20", 14)
    return st.unnest_sessions(frame).drop("date")


_SCORE = ["session_id", "customer_code", "visited", "total_items", "items_sold", "total_recommended",
          "total_actual", "coverage", "accuracy", "score"]

QUERIES = {
    "A12_recommendation_store": lambda s, d: st.generation_info(_store(s, d)),
    "A13_recommendation_retrieval": lambda s, d: st.retrieve(
        loop.recs(s, d), fx.TARGET, tier="SHOULD_STOCK", min_priority=60.0, offset=20, limit=100
    ).select("RouteCode", "CustomerCode", "ItemCode", "PriorityScore", "WhyItem", "Confidence",
             F.size("Signals").alias("signals"), F.get("Signals", F.lit(0))["kind"].alias("first_kind")),
    "A14_store_summary": lambda s, d: st.store_summary(loop.recs(s, d), 12),
    "A14_missing_routes": lambda s, d: st.missing_routes(
        fx.journey(s, d), _partial_store(s, d), fx.TARGET),
    "A15_forecast_result_rows": lambda s, d: rounded(st.forecast_result_rows(stitched(s, d), "test").select(
        "trx_date", "route_code", "item_code", "item_name", "data_split", "demand_class", "model_used",
        "predicted", "actual_qty", "lower_bound", "adi")),
    "A15_recommendation_result_rows": lambda s, d: st.recommendation_result_rows(loop.recs(s, d)).select(
        "trx_date", "route_code", "customer_code", "item_code", "recommended_quantity",
        F.col("priority_score").cast("double").alias("priority_score"),
        F.col("trend_factor").cast("double").alias("trend_factor"), "reason_status",
        "reason_explanation", "generated_by"),
    "A16_session_list": lambda s, d: st.list_sessions(_stored_sessions(s, d)),
    "A16_session_records": _stored_records,
    "A17_session_route_rows": lambda s, d: _route_rows(s, d).drop("session_started_at"),
    "A17_session_customer_rows": lambda s, d: st.session_customer_rows(scores(s, d)),
    "A17_session_item_rows": lambda s, d: st.session_item_rows(items(s, d)).select(
        "session_id", "customer_code", "item_code", "original_recommended_qty", "adjusted_recommended_qty",
        "actual_qty", "was_manually_edited", "was_item_sold", "recommendation_tier"),
    "A18_latest_sessions": lambda s, d: st.latest_sessions(_with_reruns(s, d)).select(
        "session_id", "route_code", "supervision_date", "total_qty_actual"),
    "A18_rebuilt_sessions": _rebuilt,
    "A18_rebuilt_records": _rebuilt_records,
    "A19_session_window": _window,
    "A20_artifact_read": _artifact,
    "A21_generation_metrics": _metrics,
    "O1_session_build": lambda s, d: sv.nest_customers(opened(s, d)).select(
        "session_id", "customer_code", "customer_name", F.size("items").alias("items"),
        F.array_join(F.transform("items", lambda i: F.concat_ws(":", i.item_code, i.recommended_qty)), ",")
        .alias("plan")),
    "O2_item_accuracy": lambda s, d: items(s, d).select(
        "session_id", "customer_code", "item_code",
        sv.item_accuracy(F.col("actual_qty"), sv.effective()).alias("accuracy")),
    "O3_customer_scores": lambda s, d: scores(s, d).select(*_SCORE),
    "O4_route_scores": lambda s, d: sv.route_scores(scores(s, d)),
    "O5_apply_visits": lambda s, d: applied(s, d).select(
        "session_id", "customer_code", "item_code", "actual_qty", "was_sold", "was_edited", "visited",
        "visit_sequence", "unsold"),
    "O6_redistribution": _redistributed,
    "O7_session_replay": lambda s, d: sv.replay_sessions(items(s, d)).select(
        "session_id", "customer_code", "item_code", "recommended_qty", "adjustment", "unsold"),
    "O8_update_actuals": lambda s, d: _updated(s, d).select(*_SCORE),
    "O9_session_summary": lambda s, d: sv.session_summary(scores(s, d)),
    "O10_also_bought": lambda s, d: sv.also_bought(items(s, d), fx.visit_sales(s, d)),
    "O11_unplanned_visits": lambda s, d: sv.unplanned_visits(items(s, d), fx.visit_sales(s, d)),
    "O11_live_split": lambda s, d: sv.live_split(items(s, d), fx.visit_sales(s, d)),
    "O12_session_counts": lambda s, d: sv.session_counts(items(s, d), "2001-07-10"),
}


def item_acc(a: str, r: str) -> str:
    return f"""CASE WHEN {r} <= 0 THEN CASE WHEN {a} = 0 THEN 100 ELSE 0 END WHEN {a} = 0 THEN 0
      WHEN {a} / {r} BETWEEN 0.75 AND 1.2 THEN 100 WHEN {a} / {r} < 0.75 THEN {sb.rint(f'{a} / {r} / 0.75::DOUBLE * 100', 1)}
      WHEN {a} / {r} <= 2 THEN {sb.rint(f'greatest(0, 100 - ({a} / {r} - 1.2::DOUBLE) / (2.0::DOUBLE - 1.2::DOUBLE) * 100)', 1)} ELSE 0 END::DOUBLE"""


def _rate(a: str, b: str) -> str:
    return sb.rint(f"{a} / greatest({b}, 1) * 100", 1)


def _scores_sql(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT session_id, route_code, date, customer_code, bool_or(visited) AS visited, MAX(visit_sequence) AS visit_sequence,
    COUNT(*) AS total_items, COUNT(*) FILTER (was_sold) AS items_sold, CAST(SUM(recommended_qty + adjustment) AS BIGINT) AS total_recommended,
    CAST(SUM(actual_qty) AS BIGINT) AS total_actual, {sb.rint('COUNT(*) FILTER (was_sold) / COUNT(*) * 100', 1)} AS coverage,
    round_even(SUM(round_even({item_acc('actual_qty', '(recommended_qty + adjustment)')} * 10, 0)) / COUNT(*), 0) / 10 AS accuracy
  FROM {source} GROUP BY ALL),
{name} AS (SELECT *, {sb.rint('0.4::DOUBLE * coverage + 0.6::DOUBLE * accuracy', 1)} AS score FROM {name}0)"""


_O = sb.with_(*sb.TO_VISITS, _scores_sql("cs", "sitems"), f"""rsc AS (SELECT session_id, route_code, date,
    CASE WHEN COUNT(*) FILTER (visited) = 0 THEN 0 ELSE round_even(SUM(round_even(score * 10, 0)) FILTER (visited) / COUNT(*) FILTER (visited), 0) / 10 END AS route_score,
    {_rate('COUNT(*) FILTER (visited)', 'COUNT(*)')} AS customer_coverage,
    {_rate('COALESCE(SUM(total_actual) FILTER (visited), 0)', 'COALESCE(SUM(total_recommended) FILTER (visited), 0)')} AS qty_fulfillment
  FROM cs GROUP BY ALL),
ssm AS (SELECT session_id, route_code, date, COUNT(*) AS total_customers, COUNT(*) FILTER (visited) AS visited_customers,
    COUNT(*) - COUNT(*) FILTER (visited) AS remaining_customers, CAST(SUM(total_recommended) AS BIGINT) AS total_recommended,
    CAST(COALESCE(SUM(total_actual) FILTER (visited), 0) AS BIGINT) AS total_actual,
    CAST(COALESCE(SUM(total_recommended) FILTER (visited), 0) AS BIGINT) AS visited_recommended FROM cs GROUP BY ALL),
ssum AS (SELECT *, {_rate('total_actual', 'visited_recommended')} AS visited_achievement,
    {_rate('total_actual', 'total_recommended')} AS overall_achievement FROM ssm),
rrow AS (SELECT session_id, route_code, date AS supervision_date, total_customers AS total_customers_planned,
    visited_customers AS total_customers_visited, {_rate('visited_customers', 'total_customers')} AS customer_completion_rate,
    total_recommended AS total_qty_recommended, total_actual AS total_qty_actual,
    {_rate('total_actual', 'total_recommended')} AS qty_fulfillment_rate, route_score AS route_performance_score, visited_achievement,
    'closed' AS session_status FROM ssum JOIN rsc USING (session_id, route_code, date)),
sold AS (SELECT RouteCode AS route_code, TrxDate AS date, CustomerCode AS customer_code, ItemCode AS item_code,
    CAST(SUM(TotalQuantity) AS INT) AS sold FROM vsales GROUP BY ALL),
sold_l AS (SELECT RouteCode AS route_code, TrxDate AS date, CustomerCode AS customer_code, ItemCode AS item_code,
    CAST(TotalQuantity AS INT) AS qty FROM vsales),
stp AS (SELECT session_id, customer_code, row_number() OVER (PARTITION BY session_id ORDER BY CAST(customer_code AS INT), customer_code) AS seq
  FROM (SELECT DISTINCT session_id, customer_code FROM sitems WHERE visited)),
fst AS (SELECT session_id, customer_code AS from_customer FROM stp WHERE seq = 1),
uns AS (SELECT i.session_id, i.item_code, from_customer, greatest(recommended_qty - COALESCE(sold, 0), 0) AS unsold
  FROM sitems i JOIN fst ON fst.session_id = i.session_id AND fst.from_customer = i.customer_code
  LEFT JOIN sold USING (route_code, date, customer_code, item_code)),
rcp AS (SELECT i.session_id, u.from_customer, i.customer_code AS to_customer, i.item_code, i.item_name, i.tier, u.unsold,
    greatest(1, CAST(floor(i.recommended_qty * 0.5) AS INT)) AS max_add,
    row_number() OVER (PARTITION BY i.session_id, i.item_code ORDER BY CASE i.tier WHEN 'MUST_STOCK' THEN 0 WHEN 'SHOULD_STOCK' THEN 1
      WHEN 'CONSIDER' THEN 2 WHEN 'MONITOR' THEN 3 ELSE 99 END, i.priority_score DESC, i.customer_code) AS rk
  FROM sitems i JOIN uns u ON u.session_id = i.session_id AND u.item_code = i.item_code AND u.unsold > 0 AND i.customer_code <> u.from_customer),
gv AS (SELECT *, greatest(0, least(unsold - COALESCE(SUM(max_add) OVER (PARTITION BY session_id, item_code ORDER BY rk
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), max_add)) AS quantity FROM rcp WHERE rk <= 5)""")
_SC = ", ".join(_SCORE)
_F = sb.with_(*fc._TEST)

ORACLES = {
    "A12_recommendation_store": sb.with_(*sb.TO_RECS) + """SELECT TrxDate, COUNT(*) AS total_records, COUNT(DISTINCT RouteCode) AS routes_count,
      COUNT(DISTINCT CustomerCode) AS customers_count, COUNT(DISTINCT ItemCode) AS items_count FROM recs GROUP BY TrxDate""",
    "A13_recommendation_retrieval": sb.with_(*sb.TO_RECS) + f"""SELECT RouteCode, CustomerCode, ItemCode, PriorityScore, COALESCE(WhyItem, '') AS WhyItem,
      Confidence, 1 AS signals, 'regular_buyer' AS first_kind FROM recs WHERE TrxDate = {sb.TARGET} AND Tier = 'SHOULD_STOCK' AND PriorityScore >= 60
      ORDER BY RouteCode, CustomerCode, PriorityScore DESC, ItemCode LIMIT 100 OFFSET 20""",
    "A14_store_summary": sb.with_(*sb.TO_RECS) + """SELECT MAX(TrxDate) AS last_generated_date, COUNT(*) AS total_recs_latest_date,
      COUNT(DISTINCT RouteCode) AS routes_with_recs_latest, COUNT(DISTINCT CustomerCode) AS customers_latest, 12 AS routes_configured
      FROM recs WHERE TrxDate = (SELECT MAX(TrxDate) FROM recs)""",
    "A14_missing_routes": sb.with_(*sb.TO_RECS, sb.journey()) + f"""SELECT DISTINCT RouteCode FROM journey WHERE JourneyDate = {sb.TARGET}
      AND RouteCode NOT IN (SELECT RouteCode FROM recs WHERE TrxDate = {sb.TARGET} AND RouteCode <> '4')""",
    "A15_forecast_result_rows": _F + f"""SELECT TrxDate AS trx_date, RouteCode AS route_code, ItemCode AS item_code, '' AS item_name,
      'Test' AS data_split, class AS demand_class, best_model AS model_used, {sb.rint('prediction', 6)} AS predicted, y AS actual_qty,
      0.0::DOUBLE AS lower_bound, CAST(NULL AS DOUBLE) AS adi FROM st""",
    "A15_recommendation_result_rows": sb.with_(*sb.TO_RECS) + """SELECT TrxDate AS trx_date, RouteCode AS route_code, CustomerCode AS customer_code,
      ItemCode AS item_code, RecommendedQuantity AS recommended_quantity, PriorityScore AS priority_score, TrendFactor AS trend_factor,
      Source AS reason_status, WhyItem AS reason_explanation, 'API' AS generated_by FROM recs""",
    "A16_session_list": _O + "SELECT DISTINCT session_id, route_code, date FROM sitems",
    "A16_session_records": _O + f"""SELECT session_id, route_code, date, customer_code, visited, {sb.rint('score', 6)} AS score,
      total_actual + CASE WHEN day(date) > 15 THEN 1 ELSE 0 END AS total_actual, CAST(total_items AS INTEGER) AS n_items FROM cs""",
    "A18_rebuilt_records": _O + f"""SELECT session_id, customer_code, visit_sequence, {sb.rint('score', 6)} AS score,
      {sb.rint('coverage', 6)} AS coverage, total_items, total_actual, CAST(total_items AS INTEGER) AS n_items FROM cs WHERE visited""",
    "A17_session_route_rows": _O + "SELECT * FROM rrow",
    "A17_session_customer_rows": _O + f"""SELECT session_id, customer_code, visit_sequence, total_items AS total_skus_recommended,
      items_sold AS total_skus_sold, coverage AS sku_coverage_rate, total_recommended AS total_qty_recommended, total_actual AS total_qty_actual,
      {_rate('total_actual', 'total_recommended')} AS qty_fulfillment_rate, score AS customer_performance_score FROM cs WHERE visited""",
    "A17_session_item_rows": _O + """SELECT session_id, customer_code, item_code, recommended_qty AS original_recommended_qty,
      recommended_qty + adjustment AS adjusted_recommended_qty, actual_qty, CAST(was_edited AS INT) AS was_manually_edited,
      CAST(was_sold AS INT) AS was_item_sold, tier AS recommendation_tier FROM sitems WHERE visited""",
    "A18_latest_sessions": _O + """SELECT CASE WHEN day(supervision_date) % 2 = 0 THEN session_id || '_b' ELSE session_id END AS session_id,
      route_code, supervision_date, total_qty_actual FROM rrow""",
    "A18_rebuilt_sessions": _O + """SELECT session_id, customer_code, visit_sequence, item_code, recommended_qty, adjustment, actual_qty,
      was_sold, tier, priority_score FROM sitems WHERE visited""",
    "A19_session_window": _O + """SELECT session_id, route_code, customer_code, visited, item_code, actual_qty, was_sold, was_edited FROM sitems
      WHERE visited AND date BETWEEN DATE '2001-07-06' AND DATE '2001-07-20'
      UNION ALL SELECT DISTINCT session_id, route_code, customer_code, false, '', 0, false, false FROM sitems
      WHERE NOT visited AND date BETWEEN DATE '2001-07-06' AND DATE '2001-07-20'""",
    "A20_artifact_read": _F + f"""SELECT RouteCode, ItemCode, {sb.rint('adi', 6)} AS adi, {sb.rint('cv2', 6)} AS cv2, class FROM classes
      WHERE class = 'erratic' ORDER BY RouteCode, ItemCode LIMIT 20 OFFSET 3""",
    "A21_generation_metrics": orders.ORACLES["L10_generator_metrics"].replace(
        "SELECT gm.RouteCode, gm.source, candidates,",
        f"SELECT '2001-07-02T04:00:00' AS timestamp, {so.T} AS date, gm.RouteCode AS route, gm.source AS gen, "
        "(SELECT fallback FROM cal WHERE cal.RouteCode = gm.RouteCode) AS calibration_fallback, candidates,"),
    "O1_session_build": sb.with_(*sb.TO_RECS) + """SELECT RouteCode || '_' || CAST(TrxDate AS VARCHAR) AS session_id, CustomerCode AS customer_code,
      MAX(CustomerName) AS customer_name, COUNT(*) AS items,
      string_agg(ItemCode || ':' || RecommendedQuantity, ',' ORDER BY ItemCode) AS plan FROM recs GROUP BY TrxDate, RouteCode, CustomerCode""",
    "O2_item_accuracy": _O + f"SELECT session_id, customer_code, item_code, {item_acc('actual_qty', 'recommended_qty')} AS accuracy FROM sitems",
    "O3_customer_scores": _O + f"SELECT {_SC} FROM cs",
    "O4_route_scores": _O + "SELECT * FROM rsc",
    "O5_apply_visits": _O + """SELECT session_id, customer_code, item_code, CASE WHEN visited THEN COALESCE(sold, 0) ELSE 0 END AS actual_qty,
      visited AND COALESCE(sold, 0) > 0 AS was_sold, visited AND sold IS NOT NULL AS was_edited, visited, COALESCE(seq, 0) AS visit_sequence,
      CASE WHEN visited THEN greatest(recommended_qty - COALESCE(sold, 0), 0) ELSE 0 END AS unsold
      FROM sitems LEFT JOIN sold USING (route_code, date, customer_code, item_code) LEFT JOIN stp USING (session_id, customer_code)""",
    "O6_redistribution": _O + """SELECT session_id, from_customer, to_customer, item_code, item_name, CAST(quantity AS INT) AS quantity,
      'Unsold by ' || from_customer || ', tier=' || tier AS reason FROM gv WHERE quantity > 0""",
    "O8_update_actuals": sb.with_(*sb.TO_SESS, """upd0 AS (SELECT * REPLACE (CASE WHEN visited AND (CAST(customer_code AS INT) + length(item_code)) % 11 = 0
        THEN recommended_qty ELSE actual_qty END AS actual_qty) FROM sitems)""",
                                  "upd AS (SELECT * REPLACE (actual_qty > 0 AS was_sold) FROM upd0)", _scores_sql("us", "upd"))
    + f"SELECT {_SC} FROM us",
    "O9_session_summary": _O + "SELECT * FROM ssum",
    "O10_also_bought": _O + """SELECT route_code, date, customer_code, item_code, qty FROM sold_l s WHERE EXISTS (SELECT 1 FROM sitems i
      WHERE i.route_code = s.route_code AND i.date = s.date AND i.customer_code = s.customer_code) AND NOT EXISTS (SELECT 1 FROM sitems i
      WHERE i.route_code = s.route_code AND i.date = s.date AND i.customer_code = s.customer_code AND i.item_code = s.item_code)""",
    "O11_unplanned_visits": _O + """SELECT route_code, date, customer_code, COUNT(*) AS items, CAST(SUM(qty) AS BIGINT) AS total_qty FROM sold_l s
      WHERE NOT EXISTS (SELECT 1 FROM sitems i WHERE i.route_code = s.route_code AND i.date = s.date AND i.customer_code = s.customer_code)
      GROUP BY ALL""",
    "O11_live_split": _O + """, p AS (SELECT DISTINCT route_code, date, customer_code, 1 AS p FROM sitems),
      l AS (SELECT DISTINCT route_code, date, customer_code, 1 AS l FROM sold_l)
      SELECT route_code, date, COUNT(p) AS planned_count, COUNT(l) AS live_count, COUNT(*) FILTER (p IS NULL) AS unplanned_count,
        COUNT(*) FILTER (p IS NOT NULL AND l IS NOT NULL) AS planned_visited
      FROM p FULL OUTER JOIN l USING (route_code, date, customer_code) GROUP BY route_code, date""",
    "O12_session_counts": _O + """SELECT COUNT(DISTINCT session_id) AS total_sessions,
      COUNT(DISTINCT CASE WHEN date = DATE '2001-07-10' THEN session_id END) AS today_sessions FROM sitems""",
}
