"""Route calibration and customer-item scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanflow.catalog import sqlbase as sb
from vanflow.catalog import sqlorders as so
from vanflow.catalog.helpers import rounded, shared
from vanflow.config import CLAMPS
from vanflow.operators import calibration as cb
from vanflow.operators import scoring as sg
from vanflow.session import cut_lineage
from vanflow.sources import fixtures as fx

PAIR = list(sg.PAIR)


def hist(s, d, route="region", item="type"):
    return shared(f"hist-{route}-{item}", s, d, lambda: fx.history(s, d, route, item))


def windowed(s, d, route="nation"):
    h = hist(s, d, route)
    return cb.windowed_history(h, cb.route_windows(h, CLAMPS))


def calibrated(s, d, route="region", item="type"):
    return shared(f"cal-{route}-{item}", s, d,
                  lambda: cb.calibrate(hist(s, d, route, item), CLAMPS, materialise=cut_lineage))


def scored(s, d):
    """Pairs, visits and scores of a customer are made where the customer's lines lie: only those move, once."""
    h = hist(s, d)
    tasks = fx.tasks_of(h)
    return shared("scored", s, d, lambda: sg.score_pairs(
        h.repartition(tasks, "CustomerCode"), calibrated(s, d), fx.TARGET, CLAMPS), lambda df: fx.cut_dealt(df, tasks))


def event_history(s, d):
    """Daily event values per user and type: long, irregular histories."""
    return fx.event_sales(s, d).groupBy("TrxDate", "RouteCode", "CustomerCode", "ItemCode").agg(
        F.sum("QuantityInPCs").alias("TotalQuantity")).filter("TotalQuantity > 0")


def event_pairs(s, d):
    return sg.pair_histories(event_history(s, d), fx.EVENT_TARGET)


def _base(s, d):
    h = hist(s, d, "nation")
    w = cb.route_windows(h, CLAMPS)
    return cb.base_calibration(h, cb.windowed_history(h, w), w, CLAMPS)


def _sparsity(s, d):
    h = hist(s, d, "nation")
    median = cb.corpus_median_customers(h).scalar()
    return cb.active_customers(windowed(s, d)).withColumn("_m", median).select(
        "RouteCode", sg.py_round(cb.sparsity_factor(F.col("active_customers"), F.col("_m"), CLAMPS), 6)
        .alias("sparsity_factor"))


def _tiers(s, d):
    counts = scored(s, d)
    return counts.select(*PAIR, "priority", cb.classify_tier(F.col("priority")).alias("tier"))


def _cols(*names):
    return lambda s, d: rounded(scored(s, d).select(*PAIR, *names))


QUERIES = {
    "I1_route_windows": lambda s, d: cb.route_windows(hist(s, d, "nation"), CLAMPS),
    "I2_frequency_floor": lambda s, d: rounded(cb.raw_frequency_floor(windowed(s, d))),
    "I2_sparsity_factor": _sparsity,
    "I3_corpus_median_customers": lambda s, d: cb.corpus_median_customers(hist(s, d, "nation")),
    "I4_dormancy_days": lambda s, d: rounded(cb.dormancy_days(windowed(s, d), CLAMPS)),
    "I5_qty_benchmark": lambda s, d: rounded(cb.qty_benchmark(windowed(s, d), CLAMPS)),
    "I6_tier_cuts": lambda s, d: rounded(cb.tier_cuts(windowed(s, d), CLAMPS)),
    "I7_median_cycle": lambda s, d: cb.median_cycle(windowed(s, d)),
    "I8_completion_gate": lambda s, d: rounded(cb.median_cycle(windowed(s, d)).select(
        "RouteCode", cb.completion_gate(F.col("median_cycle"), CLAMPS).alias("completion_gate"))),
    "I9_basket_min_confidence": lambda s, d: rounded(cb.basket_min_confidence(windowed(s, d), CLAMPS)),
    "I10_peer_limits": lambda s, d: _base(s, d).select("RouteCode", "peer_k", "peer_floor", "peer_max"),
    "I11_recency_half_life": lambda s, d: rounded(cb.median_cycle(windowed(s, d)).select(
        "RouteCode", cb.recency_half_life(F.col("median_cycle"), CLAMPS).alias("recency_half_life_days"))),
    "I12_sanity_clamp": lambda s, d: rounded(calibrated(s, d, "nation").select(
        "RouteCode", *cb.CORPUS_FIELDS)),
    "I12_calibration": lambda s, d: rounded(calibrated(s, d).select(
        "RouteCode", *cb.CORPUS_FIELDS, "tier_must_stock", "tier_should_stock", "tier_consider",
        "tier_monitor", "peer_k", "peer_max", "median_cycle", "fallback")),
    "I13_tier_classification": _tiers,
    "J1_purchase_cycle": _cols("cycle_days", "cycle_method"),
    "J2_multi_pattern": lambda s, d: event_pairs(s, d).withColumn("m", sg.gap_modes(F.col("gaps"))).select(
        *PAIR, F.size("m").alias("modes"),
        F.coalesce(sg.has_patterns(F.col("gaps"), F.col("m")), F.lit(False)).alias("multi_pattern"),
        F.array_max("m")["gap"].alias("dominant_gap")),
    "J3_weighted_median_gap": lambda s, d: event_pairs(s, d).filter(F.size("gaps") > 0).select(
        *PAIR, sg.weighted_median(sg.gap_weights(fx.EVENT_TARGET, F.lit(14.0))).cast("int").alias("gap")),
    "J4_cycle_confidence": _cols("cycle_confidence"),
    "J5_pattern_quality": _cols("pattern_quality", "pattern_type"),
    "J6_trend": lambda s, d: sg.with_trend(event_pairs(s, d)).select(
        *PAIR, "trend_factor", "trend_type", "usual_cycle", "recent_cycle"),
    "J6_trend_sales": _cols("trend_factor", "trend_type", "usual_cycle", "recent_cycle"),
    "J7_quantity": lambda s, d: rounded(scored(s, d).select(
        *PAIR, "weighted_qty", sg.recommended_qty(
            F.col("weighted_qty"), F.col("trend_factor"), F.lit(40), CLAMPS).alias("recommended_qty"))),
    "J8_timing_score": _cols("timing"),
    "J9_quantity_score": _cols("quantity"),
    "J10_consistency_score": _cols("consistency"),
    "J11_blend_weights": _cols("w_timing", "w_quantity", "w_consistency"),
    "J12_priority": _cols("priority"),
    "J13_pair_stats": lambda s, d: rounded(sg.pair_stats(hist(s, d), fx.TARGET)),
}

_N = sb.with_(sb.raw("nation", "type"), sb.CUSTOMER, sb.HISTORY, *so.CALIBRATION)
_R = sb.with_(sb.raw("region", "type"), sb.CUSTOMER, sb.HISTORY, *so.SCORED)
_EV = "DATE '2024-01-31'"
_E = sb.with_(
    sb.EVENTS,
    "hist AS (SELECT * FROM (SELECT TrxDate, RouteCode, CustomerCode, ItemCode, SUM(QuantityInPCs) AS TotalQuantity "
    "FROM ev GROUP BY ALL) WHERE TotalQuantity > 0)",
    "cal AS (SELECT DISTINCT RouteCode, 14.0::DOUBLE AS recency_half_life_days, 0.02::DOUBLE AS frequency_floor, "
    "50.0::DOUBLE AS qty_benchmark FROM hist)",
    so.GAPS, so.SCORES,
).replace(so.T, _EV)


def _r(*names: str, exact: tuple[str, ...] = ()) -> str:
    cols = ", ".join([*(f"{sb.rint(n, 6)} AS {n}" for n in names), *exact])
    return _R + f"SELECT {so.P}, {cols} FROM sc"


_F6 = ", ".join(f"{sb.rint(n, 6)} AS {n}" if n != "dormancy_days" else n for n in cb.CORPUS_FIELDS)
_T4 = ", ".join(f"{sb.rint(n, 6)} AS {n}" for n in
                ("tier_must_stock", "tier_should_stock", "tier_consider", "tier_monitor"))

ORACLES = {
    "I1_route_windows": _N + """SELECT RouteCode, window_start, window_end, window_days, window_customers, fallback FROM win""",
    "I2_frequency_floor": _N + f"SELECT RouteCode, {sb.rint('freq_p25', 6)} AS freq_p25 FROM fl",
    "I2_sparsity_factor": _N + f"""SELECT RouteCode, {sb.rint('''CASE WHEN m > 0 AND active_customers / m < 0.75
      THEN 0.5 + 0.5 * greatest(0, active_customers / m / 0.75) ELSE 1 END''', 6)} AS sparsity_factor FROM act, med""",
    "I3_corpus_median_customers": _N + "SELECT m AS corpus_median_customers FROM med",
    "I4_dormancy_days": _N + f"SELECT RouteCode, {sb.rint('gap_p95', 6)} AS gap_p95, dormancy_days FROM base WHERE gap_p95 IS NOT NULL",
    "I5_qty_benchmark": _N + f"""SELECT RouteCode, {sb.rint('qty_p90', 6)} AS qty_p90,
      {sb.rint('qty_benchmark', 6)} AS qty_benchmark FROM base""",
    "I6_tier_cuts": _N + f"SELECT RouteCode, {_T4} FROM tc",
    "I7_median_cycle": _N + "SELECT RouteCode, median_cycle FROM mc",
    "I8_completion_gate": _N + f"SELECT RouteCode, {sb.rint('completion_gate', 6)} AS completion_gate FROM base JOIN mc USING (RouteCode)",
    "I9_basket_min_confidence": _N + f"""SELECT RouteCode, {sb.rint('conf_p60', 6)} AS conf_p60,
      {sb.rint('basket_min_confidence', 6)} AS basket_min_confidence FROM base WHERE conf_p60 IS NOT NULL""",
    "I10_peer_limits": _N + "SELECT RouteCode, peer_k, peer_floor, peer_max FROM base",
    "I11_recency_half_life": _N + "SELECT RouteCode, recency_half_life_days FROM base JOIN mc USING (RouteCode)",
    "I12_sanity_clamp": _N + f"SELECT RouteCode, {_F6} FROM cal",
    "I12_calibration": _R + f"SELECT RouteCode, {_F6}, {_T4}, peer_k, peer_max, median_cycle, fallback FROM cal",
    "I13_tier_classification": _R + f"""SELECT {so.P}, priority, CASE WHEN priority >= tier_must_stock THEN 'MUST_STOCK'
      WHEN priority >= tier_should_stock THEN 'SHOULD_STOCK' WHEN priority >= tier_consider THEN 'CONSIDER'
      WHEN priority >= tier_monitor THEN 'MONITOR' ELSE 'EXCLUDE' END AS tier FROM sc""",
    "J1_purchase_cycle": _r(exact=("cycle_days", "cycle_method")),
    "J2_multi_pattern": _E + f"""SELECT {so.P}, CAST(COALESCE(n_modes, 0) AS INT) AS modes,
      COALESCE(n_gaps >= 4 AND n_modes >= 2 AND spread >= 7, false) AS multi_pattern, dominant AS dominant_gap
      FROM ps LEFT JOIN ga USING ({so.P}) LEFT JOIN mp USING ({so.P})""",
    "J3_weighted_median_gap": _E + f"SELECT {so.P}, med_gap AS gap FROM wm",
    "J4_cycle_confidence": _r("cycle_confidence"),
    "J5_pattern_quality": _r("pattern_quality", exact=("pattern_type",)),
    "J6_trend": _E + f"SELECT {so.P}, trend_factor, trend_type, usual_cycle, recent_cycle FROM (SELECT * FROM s0_)",
    "J6_trend_sales": _r(exact=("trend_factor", "trend_type", "usual_cycle", "recent_cycle")),
    "J7_quantity": _R + f"""SELECT {so.P}, {sb.rint('weighted_qty', 6)} AS weighted_qty,
      CASE WHEN weighted_qty * trend_factor > 0 THEN least(greatest(1, CAST({sb.rint('weighted_qty * trend_factor * 0.975::DOUBLE')} AS INT)), 40)
        ELSE 0 END AS recommended_qty FROM sc""",
    "J8_timing_score": _r("timing"),
    "J9_quantity_score": _r("quantity"),
    "J10_consistency_score": _r("consistency"),
    "J11_blend_weights": _R + f"""SELECT {so.P}, {sb.rint('0.30 + tt * 0.25::DOUBLE', 6)} AS w_timing,
      {sb.rint('0.40 - tt * 0.15::DOUBLE', 6)} AS w_quantity, {sb.rint('0.30 - tt * 0.10::DOUBLE', 6)} AS w_consistency FROM sc""",
    "J12_priority": _r("priority"),
    "J13_pair_stats": _R + f"""SELECT {so.P}, total_visits, item_visits, {sb.rint('frequency', 6)} AS frequency,
      days_since, purchase_count, {sb.rint('avg_qty', 6)} AS avg_qty FROM ps""",
}
ORACLES["J6_trend"] = ORACLES["J6_trend"].replace("(SELECT * FROM s0_)", "s0")
