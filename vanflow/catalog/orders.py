"""Candidate lanes, merging, explanation and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanflow.catalog import sqlbase as sb
from vanflow.catalog import sqlorders as so
from vanflow.catalog.helpers import rounded, shared
from vanflow.catalog.scoring import calibrated, hist
from vanflow.config import CLAMPS, DASHBOARD
from vanflow.operators import allocate, lanes
from vanflow.operators import scoring as sg
from vanflow.plans.recommend import recommend
from vanflow.session import cut_lineage
from vanflow.sources import fixtures as fx
from vanflow.sources import imports as im

PAIR = lanes.PAIR
_RUNS: dict = {}


def history(s, d):
    return hist(s, d, "region", "brand")


def cal(s, d):
    return calibrated(s, d, "region", "brand")


def demand(s, d):
    return shared("demand", s, d, lambda: im.confident_demand(
        fx.demand_forecast(s, d), DASHBOARD.min_demand_probability))


def van(s, d):
    return lanes.van_items(demand(s, d), fx.TARGET)


def targets(s, d):
    return lanes.journey_customers(fx.journey(s, d), fx.TARGET)


def weights(s, d):
    return shared("weights", s, d, lambda: lanes.lookalike_weights(history(s, d), cal(s, d), fx.TARGET))


def peers(s, d):
    return shared("peers", s, d, lambda: lanes.peers(
        weights(s, d), targets(s, d), cal(s, d), CLAMPS))


def run(s, d):
    """The whole run; its frames serve the queries below."""
    key = (s.sparkContext.applicationId, d)
    if key not in _RUNS:
        _RUNS[key] = recommend(history(s, d), demand(s, d), fx.journey(s, d), fx.TARGET)
    return _RUNS[key]


def fresh_run(s, d):
    """The run from raw tables, nothing shared."""
    return recommend(
        cut_lineage(fx.history(s, d, "region", "brand")),
        cut_lineage(im.confident_demand(fx.demand_forecast(s, d), DASHBOARD.min_demand_probability)),
        fx.journey(s, d), fx.TARGET,
    ).allocated


_CAND = ["qty", "priority", "van_qty", "avg_qty", "days_since", "cycle_days", "frequency_pct",
         "pattern_quality", "purchase_count", "trend_factor", "churn_probability"]


def _lane(source):
    return lambda s, d: rounded(run(s, d).candidates.filter(F.col("source") == source).select(
        *PAIR, "source", "lane", *_CAND))


def _multipliers(s, d):
    """A multiplier per route and lane, from the number of the route's customers."""
    routes = history(s, d).groupBy("RouteCode").agg(F.countDistinct("CustomerCode").alias("n"))
    lane_rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("source"), F.lit(i).alias("i")) for n, i in lanes.LANES.items()]))
    return routes.select("RouteCode", "n", lane_rows.alias("l")).select(
        F.col("RouteCode").alias("route"), F.col("l.source").alias("source"),
        (F.lit(0.5) + ((F.col("n") + F.col("l.i") * 3) % 11) / 10.0).alias("multiplier"),
        F.lit(0.8).alias("confidence"), F.col("n").cast("int").alias("n"))


def _feedback(s, d):
    adjusted = allocate.apply_feedback(run(s, d).candidates, _multipliers(s, d))
    last = F.element_at("signals", -1)
    return rounded(adjusted.select(
        *PAIR, "source", "priority",
        F.when(last["kind"] == "feedback_adjusted", last["detail"]).alias("note")))


def _merged(s, d):
    return shared("merged", s, d, lambda: allocate.merge_and_rank(run(s, d).candidates))


def _all_signal_rows(s, d):
    """Signals of all lanes' picks, one row each, before merging."""
    picks = run(s, d).candidates
    return rounded(picks.select(*PAIR, "source", F.posexplode("signals").alias("pos", "sg")).select(
        *PAIR, "source", "pos", F.col("sg.kind").alias("kind"), F.col("sg.detail").alias("detail"),
        F.col("sg.weight").alias("weight")))


def _signal_rows(s, d):
    """The history lane's part of all signals."""
    return _all_signal_rows(s, d).filter("source = 'history'").drop("source")


QUERIES = {
    "K1_van_items": van,
    "K2_journey_customers": targets,
    "K3_item_names": lambda s, d: lanes.item_names(demand(s, d), history(s, d)),
    "K3_customer_names": lambda s, d: lanes.customer_names(history(s, d)),
    "K4_history_lane": _lane("history"),
    "K5_lookalike_weights": lambda s, d: rounded(weights(s, d)),
    "K6_nearest_customers": lambda s, d: lanes.nearest_peers(weights(s, d), targets(s, d), 20),
    "K7_top_peers": peers,
    "K8_peer_scores": lambda s, d: rounded(lanes.peer_scores(
        peers(s, d), weights(s, d), van(s, d)).select(*PAIR, "van_qty", "peer_score", "peer_buyers")),
    "K9_peer_floor_rank": lambda s, d: rounded(lanes.rank_peer_items(
        lanes.peer_scores(peers(s, d), weights(s, d), van(s, d)), cal(s, d), CLAMPS
    ).select(*PAIR, "peer_score", "score_floor", "item_rank")),
    "K10_peer_median_qty": lambda s, d: rounded(lanes.peer_scores(
        peers(s, d), weights(s, d), van(s, d)).select(*PAIR, "median_qty")),
    "K11_peer_lane": _lane("peer"),
    "K12_comparable_routes": lambda s, d: lanes.large_enough_routes(history(s, d), CLAMPS),
    "K13_co_occurrence": lambda s, d: rounded(lanes.co_occurrence(history(s, d), cal(s, d))),
    "K14_basket_lane": _lane("basket"),
    "K15_reactivation_lane": _lane("reactivation"),
    "K16_seed_lane": _lane("seed"),
    "K17_top_van_items": lambda s, d: lanes.top_van_items(van(s, d), CLAMPS.seed_top_k),
    "L1_feedback_adjustment": _feedback,
    "L2_merge_and_rank": lambda s, d: rounded(_merged(s, d).select(*PAIR, "source", "lane", *_CAND)),
    "L2_merged_signal_kinds": lambda s, d: _merged(s, d).select(
        *PAIR, F.array_join(F.array_sort(F.transform("signals", lambda x: x.kind)), ",").alias("kinds")),
    "L3_signals": _signal_rows,
    "L3_signals_all_lanes": _all_signal_rows,
    "L4_signal_weights": lambda s, d: rounded(run(s, d).candidates.select(
        *PAIR, "source", F.size("signals").alias("signals"),
        sg.py_round(F.aggregate("signals", F.lit(0.0), lambda a, x: a + x.weight), 2).alias("total"))),
    "L5_explanations": lambda s, d: rounded(run(s, d).candidates.select(
        *PAIR, "source", "why_item", "why_quantity", "confidence")),
    "L6_shaped_rows": lambda s, d: rounded(run(s, d).rows.select(
        "TrxDate", *PAIR, "CustomerName", "ItemName", "RecommendedQuantity", "Tier", "VanLoad", "PriorityScore",
        "AvgQuantityPerVisit", "DaysSinceLastPurchase", "PurchaseCount", "Source")),
    "L7_van_allocation": lambda s, d: rounded(run(s, d).allocated.select(
        *PAIR, "RecommendedQuantity", "Tier", "PriorityScore", "VanLoad", "Source",
        F.col("WhyQuantity").contains("[Van constrained").alias("constrained"))),
    "L8_generation_run": lambda s, d: rounded(fresh_run(s, d).select(
        *PAIR, "RecommendedQuantity", "Tier", "PriorityScore", "VanLoad", "Source", "Confidence")),
    "L9_customer_groups": lambda s, d: allocate.customer_groups(run(s, d).allocated),
    "L9_route_stats": lambda s, d: allocate.route_stats(run(s, d).allocated),
    "L10_generator_metrics": lambda s, d: rounded(allocate.generator_metrics(
        run(s, d).candidates, run(s, d).rows)),
}

_L = sb.with_(*so.LANES)
_C = """source, lane, qty, priority, van_qty, {avg} AS avg_qty, days_since, cycle_days, frequency_pct,
  pattern_quality, purchase_count, trend_factor, churn_probability""".format(avg=sb.rint("avg_qty", 6))


def _pct(x: str, digits: int = 0) -> str:
    v = sb.rint(f"({x}) * 100", digits)
    return f"CAST(CAST({v} AS INT) AS VARCHAR) || '%'"


def _num(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {sb.rint(x, digits)})"


# signals of the five lanes as long rows: position, kind, detail and raw weight
_SIGNALS = f"""hs AS (SELECT {so.P}, source, lane, unnest([
    {{'pos': 0, 'item': true, 'kind': CASE WHEN item_visits / total_visits >= frequency_floor THEN 'regular_buyer' END,
      'detail': 'Bought on ' || item_visits || ' of last ' || total_visits || ' visits.',
      'weight': CAST(least(1, item_visits / total_visits + 0.1::DOUBLE) AS DOUBLE)}},
    {{'pos': 1, 'item': true, 'kind': CASE WHEN days_since / cycle_days - 1 >= 1 THEN 'overdue' WHEN timing >= 0.6 THEN 'due_now' END,
      'detail': CASE WHEN days_since / cycle_days - 1 >= 1
        THEN {_num('days_since / cycle_days - 1 + 1', 1)} || ' cycles overdue (' || days_since || 'd since last buy).'
        ELSE 'Last bought ' || days_since || 'd ago; typical cycle is ' || cycle_days || 'd.' END,
      'weight': CAST(CASE WHEN days_since / cycle_days - 1 >= 1 THEN least(1, 0.4::DOUBLE + 0.2::DOUBLE * (days_since / cycle_days - 1)) ELSE timing END AS DOUBLE)}},
    {{'pos': 2, 'item': true, 'kind': CASE WHEN consistency >= 0.75 THEN 'consistent_pattern' END,
      'detail': 'Very regular buying pattern (variability ' || {_pct('greatest(0, (1 - consistency) / 0.7::DOUBLE)')} || ').',
      'weight': CAST(0.4::DOUBLE * consistency AS DOUBLE)}},
    {{'pos': 3, 'item': true, 'kind': CASE WHEN starts_with(trend_type, 'ACCELERATING') THEN 'trending_up'
        WHEN starts_with(trend_type, 'DECLINING') THEN 'trending_down' END,
      'detail': CASE WHEN starts_with(trend_type, 'ACCELERATING') THEN 'Buying faster lately -- cycle shrank from '
        ELSE 'Buying slower lately -- cycle grew from ' END || usual_cycle || 'd to ' || recent_cycle || 'd.',
      'weight': CAST(CASE WHEN starts_with(trend_type, 'ACCELERATING') THEN 0.4 ELSE 0.3 END AS DOUBLE)}},
    {{'pos': 4, 'item': false, 'kind': 'qty_derivation',
      'detail': 'Recency-weighted avg ' || {_num('weighted_qty', 1)} || ' (raw avg ' || {_num('avg_qty', 1)} || ') x trend '
        || {_num('trend_factor', 2)} || ' -> ' || rq || ' (clamped to perfect zone).', 'weight': 1.0::DOUBLE}}], recursive := true)
  FROM (SELECT *, 'history' AS source, 0 AS lane FROM hpick)),
os AS (
  SELECT {so.P}, 'peer' AS source, 1 AS lane, 0 AS pos, true AS item, 'lookalike_peer' AS kind,
    'Customers with similar baskets to yours buy this item (similarity-weighted score ' || {_pct('peer_score')} || ', ' || peer_buyers || ' peers).' AS detail,
    CAST(least(1, peer_score) AS DOUBLE) AS weight FROM ptop WHERE median_qty > 0
  UNION ALL SELECT {so.P}, 'peer', 1, 4, false, 'qty_derivation', 'Similarity-weighted median qty across ' || peer_buyers
    || ' lookalike peers is ' || {_num('median_qty', 0)} || ' units.', 1.0 FROM ptop WHERE median_qty > 0
  UNION ALL SELECT {so.P}, 'basket', 2, 0, true, 'basket_complement', 'Often bought with ' || anchor || ' (co-purchase rate '
    || {_pct('confidence')} || ').', confidence FROM btop
  UNION ALL SELECT {so.P}, 'basket', 2, 4, false, 'qty_derivation', 'Median co-purchased quantity is '
    || {_num('greatest(1, median_qty)', 0)} || ' units.', 1.0 FROM btop
  UNION ALL SELECT {so.P}, source, lane, 0, true, 'reactivation', 'No visits in ' || days_since
    || 'd -- offering top route items to restart the relationship.', 1.0 FROM rlane
  UNION ALL SELECT {so.P}, source, lane, 0, true, 'first_visit',
    'First-time customer on this route -- seeding popular van items.', 1.0 FROM slane
  UNION ALL SELECT {so.P}, source, lane, 4, false, 'qty_derivation', 'Fixed seed qty of ' || qty
    || ' for a first-time customer -- low-risk starter.', 1.0 FROM (SELECT * FROM rlane UNION ALL SELECT * FROM slane)),
sg AS (SELECT {so.P}, source, lane, pos, item, kind, detail, weight FROM hs WHERE kind IS NOT NULL UNION ALL SELECT * FROM os),
sgn AS (SELECT *, SUM(weight) OVER (PARTITION BY {so.P}, source) AS tot,
    COUNT(*) OVER (PARTITION BY {so.P}, source) AS n FROM sg)"""
_X = sb.with_(*so.LANES, _SIGNALS)

ORACLES = {
    "K1_van_items": _L + "SELECT RouteCode, ItemCode, van_qty FROM van",
    "K2_journey_customers": _L + "SELECT RouteCode, CustomerCode FROM jc",
    "K3_item_names": _L + """SELECT DISTINCT RouteCode, ItemCode, ItemCode AS ItemName FROM (
      SELECT RouteCode, ItemCode FROM hist UNION ALL SELECT RouteCode, ItemCode FROM fcst WHERE DemandProbability >= 0.99)""",
    "K3_customer_names": _L + "SELECT RouteCode, CustomerCode, MIN(CustomerName) AS CustomerName FROM hist GROUP BY ALL",
    "K4_history_lane": _L + f"SELECT {so.P}, {_C} FROM hlane",
    "K5_lookalike_weights": _L + f"SELECT {so.P}, {sb.rint('weight', 6)} AS weight, {sb.rint('mean_qty', 6)} AS mean_qty FROM lk",
    "K6_nearest_customers": _L + "SELECT RouteCode, CustomerCode, peer, sim, peer_rank FROM near20",
    "K7_top_peers": _L + "SELECT RouteCode, CustomerCode, peer, sim, peer_rank FROM prs",
    "K8_peer_scores": _L + f"SELECT {so.P}, van_qty, {sb.rint('peer_score', 6)} AS peer_score, peer_buyers FROM psc",
    "K9_peer_floor_rank": _L + f"""SELECT {so.P}, {sb.rint('peer_score', 6)} AS peer_score,
      {sb.rint('score_floor', 6)} AS score_floor, item_rank FROM ptop""",
    "K10_peer_median_qty": _L + f"SELECT {so.P}, {sb.rint('median_qty', 6)} AS median_qty FROM pmed",
    "K11_peer_lane": _L + f"SELECT {so.P}, {_C} FROM plane",
    "K12_comparable_routes": _L + "SELECT RouteCode FROM hact WHERE history_customers >= 3",
    "K13_co_occurrence": _L + f"""SELECT RouteCode, anchor, item, {sb.rint('confidence', 6)} AS confidence,
      {sb.rint('median_qty', 6)} AS median_qty FROM cooc""",
    "K14_basket_lane": _L + f"SELECT {so.P}, {_C} FROM blane",
    "K15_reactivation_lane": _L + f"SELECT {so.P}, {_C} FROM rlane",
    "K16_seed_lane": _L + f"SELECT {so.P}, {_C} FROM slane",
    "K17_top_van_items": _L + "SELECT RouteCode, ItemCode, van_qty, van_rank FROM top5",
    "L1_feedback_adjustment": _L + f""", nr AS (SELECT RouteCode, COUNT(DISTINCT CustomerCode) AS n FROM hist GROUP BY ALL),
      fm AS (SELECT cand.*, 0.5::DOUBLE + ((n + lane * 3) % 11) / 10.0::DOUBLE AS m, n FROM cand JOIN nr USING (RouteCode))
      SELECT {so.P}, source, CASE WHEN abs(m - 1) > 1e-6 THEN {sb.rint('priority * m', 2)} ELSE priority END AS priority,
      CASE WHEN abs(m - 1) > 1e-6 THEN CASE WHEN (m - 1) * 100 >= 0 THEN 'Boosted' ELSE 'Dampened' END || ' by '
        || {_num('abs((m - 1) * 100)', 0)} || '% based on driver outcomes (' || source || ' lane, ' || n
        || ' attributed recs on this route).' END AS note FROM fm""",
    "L2_merge_and_rank": _L + f"SELECT {so.P}, {_C} FROM rank1",
    "L2_merged_signal_kinds": _X + f"""SELECT {so.P}, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
      FROM sg GROUP BY {so.P}""",
    "L3_signals": _X + f"""SELECT {so.P}, row_number() OVER (PARTITION BY {so.P} ORDER BY pos) - 1 AS pos, kind, detail,
      {sb.rint('weight / tot', 4)} AS weight FROM sgn WHERE source = 'history'""",
    "L3_signals_all_lanes": _X + f"""SELECT {so.P}, source, row_number() OVER (PARTITION BY {so.P}, source ORDER BY pos) - 1 AS pos,
      kind, detail, {sb.rint('weight / tot', 4)} AS weight FROM sgn""",
    "L4_signal_weights": _X + f"""SELECT {so.P}, source, COUNT(*) AS signals,
      {sb.rint(f"SUM({sb.rint('weight / tot', 4)})", 2)} AS total FROM sgn GROUP BY {so.P}, source""",
    "L5_explanations": _X + f""", rkd AS (SELECT *, row_number() OVER (PARTITION BY {so.P}, source, item ORDER BY weight DESC, pos) AS rr FROM sgn)
      SELECT {so.P}, source, string_agg(CASE WHEN item AND rr <= 2 THEN detail END, ' ' ORDER BY rr) AS why_item,
      MAX(CASE WHEN NOT item AND rr = 1 THEN detail END) AS why_quantity,
      {sb.rint('least(1, MAX(tot) / MAX(n) * (0.7::DOUBLE + 0.3::DOUBLE * least(1, sqrt(MAX(n) / 3.0))))', 4)} AS confidence
      FROM rkd GROUP BY {so.P}, source""",
    "L6_shaped_rows": _L + f""", cn AS (SELECT RouteCode, CustomerCode, MIN(CustomerName) AS CustomerName FROM hist GROUP BY ALL)
      SELECT {so.T} AS TrxDate, kept.RouteCode, kept.CustomerCode, kept.ItemCode, COALESCE(CustomerName, '') AS CustomerName,
      kept.ItemCode AS ItemName, qty AS RecommendedQuantity, tier AS Tier, van_qty AS VanLoad, priority AS PriorityScore,
      CAST({sb.rint('avg_qty')} AS INT) AS AvgQuantityPerVisit, days_since AS DaysSinceLastPurchase,
      purchase_count AS PurchaseCount, source AS Source FROM kept LEFT JOIN cn USING (RouteCode, CustomerCode)""",
    "L7_van_allocation": _L + f"""SELECT {so.P}, CAST(given AS INT) AS RecommendedQuantity, tier AS Tier,
      priority AS PriorityScore, van_qty AS VanLoad, source AS Source, given < qty AS constrained FROM alloc""",
    "L8_generation_run": _X + f""", cs AS (SELECT {so.P}, source,
        {sb.rint('least(1, MAX(tot) / MAX(n) * (0.7::DOUBLE + 0.3::DOUBLE * least(1, sqrt(MAX(n) / 3.0))))', 4)} AS Confidence
        FROM sgn GROUP BY {so.P}, source)
      SELECT {so.P}, CAST(given AS INT) AS RecommendedQuantity, tier AS Tier, priority AS PriorityScore, van_qty AS VanLoad,
      source AS Source, Confidence FROM alloc JOIN cs USING ({so.P}, source)""",
    "L9_customer_groups": _L + f""", cn AS (SELECT RouteCode, CustomerCode, MIN(CustomerName) AS nm FROM hist GROUP BY ALL)
      SELECT {so.T} AS TrxDate, alloc.RouteCode, alloc.CustomerCode, COALESCE(MAX(nm), alloc.CustomerCode) AS CustomerName,
      COUNT(*) AS items, CAST(SUM(given) AS BIGINT) AS total_qty
      FROM alloc LEFT JOIN cn USING (RouteCode, CustomerCode) GROUP BY alloc.RouteCode, alloc.CustomerCode""",
    "L9_route_stats": _L + f"""SELECT {so.T} AS TrxDate, RouteCode, COUNT(DISTINCT CustomerCode) AS customers,
      COUNT(DISTINCT ItemCode) AS skus, CAST(SUM(given) AS BIGINT) AS total_qty FROM alloc GROUP BY RouteCode""",
    "L10_generator_metrics": _L + f""", gm AS (SELECT RouteCode, source, COUNT(*) AS candidates FROM cand GROUP BY ALL),
      sm AS (SELECT RouteCode, 'peer' AS source, {sb.rint(f"AVG({sb.rint('peer_score', 4)})", 4)} AS similarity_avg
        FROM ptop WHERE median_qty > 0 GROUP BY RouteCode),
      kp AS (SELECT RouteCode, source, COUNT(*) AS k FROM kept GROUP BY ALL)
      SELECT gm.RouteCode, gm.source, candidates, similarity_avg, COALESCE(k, 0) AS kept,
      {sb.rint('COALESCE(k, 0) * 100.0::DOUBLE / SUM(COALESCE(k, 0)) OVER (PARTITION BY gm.RouteCode)', 2)} AS source_pct
      FROM gm LEFT JOIN sm USING (RouteCode, source) LEFT JOIN kp USING (RouteCode, source)""",
}
