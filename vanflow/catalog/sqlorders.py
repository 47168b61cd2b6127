"""DuckDB statements of calibration, pair scoring and the candidate lanes."""

from __future__ import annotations

from vanflow.catalog import sqlbase as sb

P = "RouteCode, CustomerCode, ItemCode"
T = sb.TARGET


def clamp(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"


WINDOWS = """w0 AS (SELECT RouteCode, MAX(TrxDate) AS window_end FROM hist GROUP BY ALL),
wn AS (SELECT RouteCode, window_end, window_end - 90 AS window_start, COUNT(DISTINCT TrxDate) AS window_days,
    COUNT(DISTINCT CustomerCode) AS window_customers
  FROM hist JOIN w0 USING (RouteCode) WHERE TrxDate >= window_end - 90 GROUP BY ALL),
win AS (SELECT *, window_days < 14 OR window_customers < 5 AS fallback FROM wn),
wh AS (SELECT hist.* FROM hist JOIN win USING (RouteCode) WHERE fallback OR TrxDate >= window_start)"""

CAL_PARTS = """act AS (SELECT RouteCode, COUNT(DISTINCT CustomerCode) AS active_customers FROM wh GROUP BY ALL),
hact AS (SELECT RouteCode, COUNT(DISTINCT CustomerCode) AS history_customers FROM hist GROUP BY ALL),
fq AS (SELECT RouteCode, CustomerCode, ItemCode, item_visits, visits, item_visits / visits AS frequency
  FROM (SELECT RouteCode, CustomerCode, ItemCode, COUNT(DISTINCT TrxDate) AS item_visits FROM wh GROUP BY ALL)
  JOIN (SELECT RouteCode, CustomerCode, COUNT(DISTINCT TrxDate) AS visits FROM wh GROUP BY ALL)
  USING (RouteCode, CustomerCode)),
fl AS (SELECT RouteCode, quantile_cont(frequency, 0.25) AS freq_p25 FROM fq GROUP BY ALL),
vg AS (SELECT RouteCode, CustomerCode, date_diff('day', lag(TrxDate) OVER (PARTITION BY RouteCode, CustomerCode
    ORDER BY TrxDate), TrxDate) AS gap FROM (SELECT DISTINCT RouteCode, CustomerCode, TrxDate FROM wh)),
dmn AS (SELECT RouteCode, quantile_cont(CAST(g AS DOUBLE), 0.95) AS gap_p95 FROM
  (SELECT RouteCode, CustomerCode, MAX(gap) AS g FROM vg WHERE gap IS NOT NULL GROUP BY ALL) GROUP BY ALL),
qb AS (SELECT RouteCode, quantile_cont(m, 0.9) AS qty_p90 FROM
  (SELECT RouteCode, ItemCode, AVG(TotalQuantity) AS m FROM wh GROUP BY ALL) GROUP BY ALL),
pc AS (SELECT RouteCode, CustomerCode, ItemCode, COUNT(*) AS n FROM wh GROUP BY ALL),
rk AS (SELECT RouteCode, (rank() OVER (PARTITION BY RouteCode ORDER BY n)
    + (COUNT(*) OVER (PARTITION BY RouteCode, n) - 1) / 2) / COUNT(*) OVER (PARTITION BY RouteCode) * 100 AS rp FROM pc),
tc AS (SELECT RouteCode, greatest(70::DOUBLE, least(95::DOUBLE, quantile_cont(CAST(rp AS DOUBLE), 0.9))) AS tier_must_stock,
    greatest(50::DOUBLE, least(80::DOUBLE, quantile_cont(CAST(rp AS DOUBLE), 0.75))) AS tier_should_stock,
    greatest(30::DOUBLE, least(60::DOUBLE, quantile_cont(CAST(rp AS DOUBLE), 0.5))) AS tier_consider,
    greatest(10::DOUBLE, least(40::DOUBLE, quantile_cont(CAST(rp AS DOUBLE), 0.25))) AS tier_monitor
  FROM rk GROUP BY RouteCode),
mc AS (SELECT RouteCode, CAST(floor(quantile_cont(CAST(gap AS DOUBLE), 0.5)) AS INT) AS median_cycle
  FROM vg WHERE gap > 0 GROUP BY ALL),
bi AS (SELECT DISTINCT RouteCode, CustomerCode, ItemCode FROM wh),
nb AS (SELECT RouteCode, ItemCode, COUNT(*) AS buyers FROM bi GROUP BY ALL),
cf0 AS (SELECT a.RouteCode, a.ItemCode AS anchor, b.ItemCode AS item, buyers, COUNT(*) AS both_n FROM bi a
  JOIN bi b ON a.RouteCode = b.RouteCode AND a.CustomerCode = b.CustomerCode AND a.ItemCode <> b.ItemCode
  JOIN nb ON nb.RouteCode = a.RouteCode AND nb.ItemCode = a.ItemCode GROUP BY 1, 2, 3, 4),
cf AS (SELECT *, both_n / buyers AS confidence FROM cf0 WHERE buyers >= 3 AND both_n >= 2),
bc AS (SELECT RouteCode, quantile_cont(confidence, 0.6) AS conf_p60 FROM cf GROUP BY ALL)"""

BASE = f"""base AS (SELECT win.RouteCode, window_start, window_end, window_days, window_customers, fallback,
    active_customers, freq_p25, gap_p95, qty_p90, tier_must_stock, tier_should_stock, tier_consider, tier_monitor,
    conf_p60, history_customers, COALESCE(median_cycle, 0) AS median_cycle,
    CAST(COALESCE(floor({clamp('gap_p95', 30, 180)}), 30) AS INT) AS dormancy_days,
    {clamp('qty_p90', 5, 500)} AS qty_benchmark,
    COALESCE({clamp('conf_p60', 0.3, 0.7)}, 0.5::DOUBLE) AS basket_min_confidence,
    {clamp('freq_p25', 0.02, 0.5)} AS frequency_floor,
    CASE WHEN median_cycle > 1 THEN {clamp('1 - 1 / median_cycle', 0.3, 0.6)} ELSE 0.6::DOUBLE END AS completion_gate,
    CASE WHEN median_cycle > 0 THEN {clamp('median_cycle * 3.0', 14, 180)} ELSE 14::DOUBLE END AS recency_half_life_days,
    CAST(floor({clamp('sqrt(greatest(active_customers, 1))', 5, 20)}) AS INT) AS peer_k, 0.05::DOUBLE AS peer_floor,
    CAST(floor({clamp(clamp('qty_p90', 5, 500) + ' / 10', 2, 8)}) AS INT) AS peer_max
  FROM win LEFT JOIN act USING (RouteCode) LEFT JOIN hact USING (RouteCode) LEFT JOIN fl USING (RouteCode)
  LEFT JOIN dmn USING (RouteCode) LEFT JOIN qb USING (RouteCode) LEFT JOIN tc USING (RouteCode)
  LEFT JOIN mc USING (RouteCode) LEFT JOIN bc USING (RouteCode))"""

_FIELDS = ("frequency_floor", "dormancy_days", "qty_benchmark", "completion_gate",
           "basket_min_confidence", "recency_half_life_days")


def _sane(name: str) -> str:
    value = f"CAST(adj.{name} AS DOUBLE)"
    new = (f"CASE WHEN c.n >= 5 AND c.{name}_s > 0 AND abs({value} - c.{name}_m) / c.{name}_s > 3 "
           f"THEN c.{name}_c ELSE {value} END")
    return f"CAST({sb.rint(new)} AS INT) AS {name}" if name == "dormancy_days" else f"{new} AS {name}"


_STATS = ", ".join(
    f"AVG({n}) AS {n}_m, stddev_pop({n}) AS {n}_s, quantile_cont(CAST({n} AS DOUBLE), 0.95) AS {n}_c" for n in _FIELDS
)
CAL = f"""med AS (SELECT quantile_cont(CAST(history_customers AS DOUBLE), 0.5) AS m FROM base),
adj AS (SELECT base.* REPLACE (COALESCE({clamp('''freq_p25 * CASE WHEN m > 0 AND active_customers / m < 0.75
    THEN 0.5 + 0.5 * greatest(0, active_customers / m / 0.75) ELSE 1 END''', 0.02, 0.5)}, 0.02::DOUBLE) AS frequency_floor)
  FROM base, med),
cstat AS (SELECT COUNT(*) AS n, {_STATS} FROM base),
cal AS (SELECT adj.* REPLACE ({', '.join(_sane(n) for n in _FIELDS)}) FROM adj, cstat c)"""

CALIBRATION = (WINDOWS, CAL_PARTS, BASE, CAL)

GAPS = f"""dd AS (SELECT DISTINCT {P}, TrxDate FROM hist),
gp AS (SELECT *, date_diff('day', lag(TrxDate) OVER (PARTITION BY {P} ORDER BY TrxDate), TrxDate) AS gap,
    row_number() OVER (PARTITION BY {P} ORDER BY TrxDate) AS rn FROM dd),
g AS (SELECT * FROM gp WHERE gap IS NOT NULL),
tv AS (SELECT RouteCode, CustomerCode, COUNT(DISTINCT TrxDate) AS total_visits, MAX(TrxDate) AS last_visit FROM hist GROUP BY ALL),
pa AS (SELECT {P}, COUNT(DISTINCT TrxDate) AS item_visits, date_diff('day', MAX(TrxDate), {T}) AS days_since,
    COUNT(*) AS purchase_count, AVG(TotalQuantity) AS avg_qty FROM hist GROUP BY ALL),
ps AS (SELECT pa.*, total_visits, item_visits / total_visits AS frequency FROM pa JOIN tv USING (RouteCode, CustomerCode)),
ga AS (SELECT {P}, COUNT(*) AS n_gaps, AVG(gap) AS mean_gap, stddev_pop(gap) AS std_gap,
    quantile_cont(CAST(gap AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(gap AS DOUBLE), 0.75) AS q3,
    MIN(gap) AS only_gap FROM g GROUP BY ALL)"""

SCORES = f"""md AS (SELECT {P}, gap, COUNT(*) AS n, MIN(rn) AS first_rn FROM g GROUP BY ALL HAVING COUNT(*) >= 2),
mp AS (SELECT {P}, COUNT(*) AS n_modes, MAX(gap) - MIN(gap) AS spread, arg_max(gap, (n, -first_rn)) AS dominant FROM md GROUP BY ALL),
gw AS (SELECT g.*, pow(2::DOUBLE, -greatest(date_diff('day', TrxDate, {T}), 0) / greatest(recency_half_life_days, 1)) AS w
  FROM g JOIN cal USING (RouteCode)),
gc AS (SELECT *, SUM(w) OVER (PARTITION BY {P} ORDER BY gap, w, rn ROWS UNBOUNDED PRECEDING) AS cum,
    SUM(w) OVER (PARTITION BY {P}) AS total FROM gw),
wm AS (SELECT {P}, MIN(gap) AS med_gap FROM gc WHERE cum * (1 + 1e-9) >= total / 2 GROUP BY ALL),
trm AS (SELECT g.*, gap >= greatest(1, q1 - 1.5 * (q3 - q1)) AND gap <= q3 + 1.5 * (q3 - q1) AS inside, n_gaps, q3 - q1 AS iqr
  FROM g JOIN ga USING ({P})),
trc AS (SELECT *, COUNT(*) FILTER (inside) OVER (PARTITION BY {P}) AS n_in FROM trm),
cl AS (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY rn DESC) AS back FROM trc
  WHERE inside OR n_gaps < 4 OR iqr = 0 OR n_in < n_gaps * 0.4),
tm AS (SELECT {P}, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS usual,
    quantile_cont(CASE WHEN back <= 3 THEN CAST(gap AS DOUBLE) END, 0.5) AS recent
  FROM cl GROUP BY ALL HAVING COUNT(*) >= 3),
lc AS (SELECT {P}, COUNT(*) AS n_lines, quantile_cont(CAST(TotalQuantity AS DOUBLE), 0.95) AS p95 FROM hist GROUP BY ALL),
lw AS (SELECT hist.RouteCode, hist.CustomerCode, hist.ItemCode,
    CASE WHEN n_lines >= 4 AND p95 > 0 THEN least(TotalQuantity, p95) ELSE TotalQuantity END AS q,
    pow(2::DOUBLE, -greatest(date_diff('day', TrxDate, {T}), 0) / greatest(recency_half_life_days, 1)) AS w
  FROM hist JOIN lc USING ({P}) JOIN cal ON cal.RouteCode = hist.RouteCode),
wq AS (SELECT {P}, CASE WHEN SUM(w) > 0 THEN SUM(w * q) / SUM(w) ELSE AVG(q) END AS weighted_qty FROM lw GROUP BY ALL),
s0 AS (SELECT ps.*, n_gaps, mean_gap, std_gap, weighted_qty, cal.* EXCLUDE (RouteCode),
    CASE WHEN n_gaps IS NULL THEN 30 WHEN n_gaps = 1 THEN greatest(1, only_gap)
      WHEN n_gaps >= 4 AND n_modes >= 2 AND spread >= 7 THEN greatest(1, dominant) ELSE greatest(1, med_gap) END AS cycle_days,
    CASE WHEN n_gaps IS NULL THEN 0 WHEN n_gaps = 1 THEN 0.3 WHEN n_gaps >= 4 AND n_modes >= 2 AND spread >= 7 THEN 0.7
      ELSE {sb.rint('''least(1, CASE WHEN item_visits >= 10 THEN 1.0 WHEN item_visits >= 5 THEN 0.7 WHEN item_visits >= 3 THEN 0.5
        ELSE 0.3 END * 0.6::DOUBLE + greatest(0.2, least(1, 1 - CASE WHEN mean_gap > 0 THEN std_gap / mean_gap ELSE 1 END * 0.8)) * 0.4::DOUBLE)''', 4)}
      END AS cycle_confidence,
    CASE WHEN n_gaps IS NULL THEN 'insufficient' WHEN n_gaps = 1 THEN 'two_purchases'
      WHEN n_gaps >= 4 AND n_modes >= 2 AND spread >= 7 THEN 'multi_pattern_' || n_modes ELSE 'weighted_recent' END AS cycle_method,
    CASE WHEN COALESCE(mean_gap, 0) = 0 THEN 0 WHEN std_gap / mean_gap <= 0.3 THEN 1.0 WHEN std_gap / mean_gap <= 0.7 THEN 0.7
      WHEN std_gap / mean_gap <= 1 THEN 0.4 ELSE 0.1 END AS pattern_quality,
    CASE WHEN COALESCE(mean_gap, 0) = 0 THEN 'unknown' WHEN std_gap / mean_gap <= 0.3 THEN 'consistent'
      WHEN std_gap / mean_gap <= 0.7 THEN 'moderate' WHEN std_gap / mean_gap <= 1 THEN 'erratic' ELSE 'very_erratic' END AS pattern_type,
    CASE WHEN usual IS NULL OR n_gaps < 3 THEN 1.0 WHEN usual = 0 THEN 1.0 WHEN recent / usual < 0.8 THEN 1.3 WHEN recent / usual < 0.9 THEN 1.15
      WHEN recent / usual <= 1.1 THEN 1.0 WHEN recent / usual <= 1.2 THEN 0.85 ELSE 0.7 END::DOUBLE AS trend_factor,
    CASE WHEN usual IS NULL OR n_gaps < 3 THEN 'INSUFFICIENT_DATA' WHEN usual = 0 THEN 'STABLE' WHEN recent / usual < 0.8 THEN 'ACCELERATING_FAST'
      WHEN recent / usual < 0.9 THEN 'ACCELERATING' WHEN recent / usual <= 1.1 THEN 'STABLE'
      WHEN recent / usual <= 1.2 THEN 'DECLINING' ELSE 'DECLINING_FAST' END AS trend_type,
    CAST(floor(usual) AS INT) AS usual_cycle, CAST(floor(recent) AS INT) AS recent_cycle
  FROM ps LEFT JOIN ga USING ({P}) LEFT JOIN mp USING ({P}) LEFT JOIN wm USING ({P}) LEFT JOIN tm USING ({P})
  LEFT JOIN wq USING ({P}) JOIN cal ON cal.RouteCode = ps.RouteCode),
s1 AS (SELECT *, greatest(0, least(1, (frequency - frequency_floor) / (greatest(frequency_floor + 1e-6, 0.5) - frequency_floor))) AS tt,
    CASE WHEN days_since < 0 THEN 0 ELSE exp(-pow(days_since / cycle_days - 1, 2) / 2) END AS timing,
    CASE WHEN avg_qty <= 0 THEN 0 ELSE least(1, ln(1 + avg_qty) / ln(1 + greatest(qty_benchmark, 1))) END AS quantity,
    CASE WHEN n_gaps >= 1 AND mean_gap > 0 THEN least(1, greatest(0.3, 1 - std_gap / mean_gap * 0.7)
      + least(0.2, n_gaps * 0.02)) ELSE 0.3 END AS consistency FROM s0),
sc AS (SELECT *, {sb.rint('''greatest(0, least(100, ((0.30 + tt * 0.25::DOUBLE) * timing + (0.40 - tt * 0.15::DOUBLE) * quantity
    + (0.30 - tt * 0.10::DOUBLE) * consistency) * 100))''', 2)} AS priority FROM s1)"""

SCORED = (*CALIBRATION, GAPS, SCORES)

VAN = f"""van0 AS (SELECT RouteCode, ItemCode, SUM(Predicted) AS a, SUM(CASE WHEN DataSplit = 'Forecast' THEN Predicted END) AS f,
    MAX(CASE WHEN DataSplit = 'Forecast' THEN 1 ELSE 0 END) AS has_f
  FROM fcst WHERE DemandProbability >= 0.99 AND TrxDate = {T} GROUP BY ALL),
van AS (SELECT RouteCode, ItemCode, CAST({sb.rint('''greatest(CASE WHEN rh = 1 THEN f ELSE a END, 0)''')} AS INT) AS van_qty
  FROM (SELECT *, MAX(has_f) OVER (PARTITION BY RouteCode) AS rh FROM van0)
  WHERE {sb.rint('''greatest(CASE WHEN rh = 1 THEN f ELSE a END, 0)''')} > 0),
jc AS (SELECT DISTINCT RouteCode, CustomerCode FROM journey WHERE JourneyDate = {T}),
top5 AS (SELECT *, row_number() OVER (PARTITION BY RouteCode ORDER BY van_qty DESC, ItemCode) AS van_rank FROM van
  QUALIFY row_number() OVER (PARTITION BY RouteCode ORDER BY van_qty DESC, ItemCode) <= 5)"""

PEERS = f"""lk AS (SELECT {P}, SUM(exp(-greatest(date_diff('day', TrxDate, {T}), 0) / greatest(recency_half_life_days, 1))) AS weight,
    AVG(TotalQuantity) AS mean_qty FROM hist JOIN cal USING (RouteCode) GROUP BY ALL),
nrm AS (SELECT RouteCode, CustomerCode, sqrt(SUM(weight * weight)) AS nm FROM lk GROUP BY ALL),
un AS (SELECT {P}, weight / nm AS u FROM lk JOIN nrm USING (RouteCode, CustomerCode)),
sims AS (SELECT RouteCode, CustomerCode, peer, {sb.rint('dot', 9)} AS sim FROM (
  SELECT a.RouteCode, a.CustomerCode, b.CustomerCode AS peer, SUM(a.u * b.u) AS dot FROM un a
    JOIN jc ON jc.RouteCode = a.RouteCode AND jc.CustomerCode = a.CustomerCode
    JOIN un b ON a.RouteCode = b.RouteCode AND a.ItemCode = b.ItemCode AND a.CustomerCode <> b.CustomerCode GROUP BY 1, 2, 3)),
near20 AS (SELECT *, row_number() OVER (PARTITION BY RouteCode, CustomerCode ORDER BY sim DESC, peer) AS peer_rank FROM sims
  WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY RouteCode, CustomerCode ORDER BY sim DESC, peer) <= 20),
prs AS (SELECT near20.* FROM near20 JOIN cal USING (RouteCode) WHERE peer_rank <= peer_k),
pp AS (SELECT prs.RouteCode, prs.CustomerCode, lk.ItemCode, van_qty, sim, weight, mean_qty FROM prs
  JOIN lk ON lk.RouteCode = prs.RouteCode AND lk.CustomerCode = prs.peer
  JOIN van ON van.RouteCode = lk.RouteCode AND van.ItemCode = lk.ItemCode),
pmed AS (SELECT {P}, MIN(mean_qty) AS median_qty FROM (SELECT *, SUM(sim) OVER (PARTITION BY {P} ORDER BY mean_qty, sim ROWS UNBOUNDED PRECEDING) AS cum,
    SUM(sim) OVER (PARTITION BY {P}) AS tot FROM pp) WHERE cum * (1 + 1e-9) >= tot / 2 GROUP BY ALL),
psc AS (SELECT {P}, van_qty, {sb.rint('SUM(sim * weight) / SUM(sim)', 9)} AS peer_score, COUNT(*) AS peer_buyers FROM pp GROUP BY {P}, van_qty),
pfl AS (SELECT RouteCode, CustomerCode, {clamp('greatest(0.05::DOUBLE, quantile_cont(peer_score, 0.75))', 0.05, 0.5)} AS score_floor
  FROM psc WHERE peer_score > 0 GROUP BY ALL),
prk AS (SELECT psc.*, score_floor, median_qty, row_number() OVER (PARTITION BY psc.RouteCode, psc.CustomerCode ORDER BY peer_score DESC, psc.ItemCode) AS item_rank
  FROM psc JOIN pfl USING (RouteCode, CustomerCode) JOIN pmed USING ({P}) WHERE peer_score > 0 AND peer_score >= score_floor),
ptop AS (SELECT prk.*, tier_consider, tier_should_stock FROM prk JOIN cal USING (RouteCode) WHERE item_rank <= peer_max),
plane AS (SELECT {P}, 'peer' AS source, 1 AS lane, CAST(least(van_qty, greatest(1, {sb.rint('median_qty')})) AS INT) AS qty,
    {sb.rint('tier_consider + least(1, peer_score) * (tier_should_stock - tier_consider)', 2)} AS priority, van_qty,
    median_qty AS avg_qty, 0 AS days_since, 0 AS cycle_days, {sb.rint('peer_score * 100', 1)} AS frequency_pct, 0.5 AS pattern_quality,
    0 AS purchase_count, 1.0 AS trend_factor, 0.0 AS churn_probability FROM ptop WHERE median_qty > 0)"""

HISTORY_LANE = f"""hl0 AS (SELECT sc.*, van_qty, priority * trend_factor AS raw_score,
    CASE WHEN weighted_qty * trend_factor > 0 THEN CAST(least(greatest(1, {sb.rint('weighted_qty * trend_factor * 0.975::DOUBLE')}), van_qty) AS INT) ELSE 0 END AS rq
  FROM sc JOIN jc USING (RouteCode, CustomerCode) JOIN van ON van.RouteCode = sc.RouteCode AND van.ItemCode = sc.ItemCode),
hpick AS (SELECT * FROM hl0 WHERE days_since > 1 AND frequency >= frequency_floor AND days_since / cycle_days >= completion_gate
  AND raw_score >= tier_monitor AND rq > 0),
hlane AS (SELECT {P}, 'history' AS source, 0 AS lane, rq AS qty, {sb.rint('raw_score', 2)} AS priority, van_qty, avg_qty, days_since, cycle_days,
    {sb.rint('frequency * 100', 1)} AS frequency_pct, {sb.rint('pattern_quality', 2)} AS pattern_quality, purchase_count,
    {sb.rint('trend_factor', 2)} AS trend_factor, 0.0 AS churn_probability FROM hpick)"""

BASKET = f"""hbi AS (SELECT {P}, AVG(TotalQuantity) AS mean_qty FROM hist GROUP BY ALL),
hnb AS (SELECT RouteCode, ItemCode, COUNT(*) AS buyers FROM hbi GROUP BY ALL),
hco AS (SELECT a.RouteCode, a.ItemCode AS anchor, b.ItemCode AS item, buyers, COUNT(*) AS both_n,
    quantile_cont(CAST(b.mean_qty AS DOUBLE), 0.5) AS median_qty FROM hbi a
  JOIN hbi b ON a.RouteCode = b.RouteCode AND a.CustomerCode = b.CustomerCode AND a.ItemCode <> b.ItemCode
  JOIN hnb ON hnb.RouteCode = a.RouteCode AND hnb.ItemCode = a.ItemCode GROUP BY 1, 2, 3, 4),
cooc AS (SELECT hco.RouteCode, anchor, item, both_n / buyers AS confidence, median_qty FROM hco JOIN cal USING (RouteCode)
  WHERE buyers >= 3 AND both_n >= 2 AND both_n / buyers >= basket_min_confidence),
bb AS (SELECT h.RouteCode, h.CustomerCode, c.item AS ItemCode, c.anchor, c.confidence, median_qty, v.van_qty FROM hlane h
  JOIN cooc c ON c.RouteCode = h.RouteCode AND c.anchor = h.ItemCode
  JOIN van v ON v.RouteCode = c.RouteCode AND v.ItemCode = c.item
  QUALIFY row_number() OVER (PARTITION BY h.RouteCode, h.CustomerCode, c.item ORDER BY c.confidence DESC, c.anchor) = 1),
bfree AS (SELECT bb.* FROM bb WHERE NOT EXISTS (SELECT 1 FROM (SELECT {P} FROM hlane UNION ALL SELECT {P} FROM plane) x
  WHERE x.RouteCode = bb.RouteCode AND x.CustomerCode = bb.CustomerCode AND x.ItemCode = bb.ItemCode)),
btop AS (SELECT * FROM bfree QUALIFY row_number() OVER (PARTITION BY RouteCode, CustomerCode ORDER BY confidence DESC, ItemCode) <= 3),
blane AS (SELECT {P}, 'basket' AS source, 2 AS lane, CAST(least(van_qty, {sb.rint('greatest(1, median_qty)')}) AS INT) AS qty,
    {sb.rint('tier_consider + confidence * (tier_should_stock - tier_consider)', 2)} AS priority, van_qty,
    greatest(1, median_qty) AS avg_qty, 0 AS days_since, 0 AS cycle_days, {sb.rint('confidence * 100', 1)} AS frequency_pct,
    0.5 AS pattern_quality, 0 AS purchase_count, 1.0 AS trend_factor, 0.0 AS churn_probability
  FROM btop JOIN cal USING (RouteCode))"""

STARTERS = f"""acty AS (SELECT RouteCode, CustomerCode, date_diff('day', MAX(TrxDate), {T}) AS days_since, COUNT(*) AS lines
  FROM hist JOIN jc USING (RouteCode, CustomerCode) GROUP BY ALL),
rlane AS (SELECT a.RouteCode, a.CustomerCode, t.ItemCode, 'reactivation' AS source, 3 AS lane, greatest(1, least(5, t.van_qty)) AS qty,
    {sb.rint('tier_consider', 2)} AS priority, t.van_qty, greatest(1, least(5, t.van_qty)) AS avg_qty, days_since, 0 AS cycle_days,
    0 AS frequency_pct, 0.4 AS pattern_quality, lines AS purchase_count, 1.0 AS trend_factor, 0.5 AS churn_probability
  FROM acty a JOIN cal USING (RouteCode) JOIN top5 t ON t.RouteCode = a.RouteCode WHERE days_since > dormancy_days),
slane AS (SELECT j.RouteCode, j.CustomerCode, t.ItemCode, 'seed' AS source, 4 AS lane, greatest(1, least(5, t.van_qty)) AS qty,
    {sb.rint('tier_consider', 2)} AS priority, t.van_qty, greatest(1, least(5, t.van_qty)) AS avg_qty, 0 AS days_since, 0 AS cycle_days,
    0 AS frequency_pct, 0.5 AS pattern_quality, 0 AS purchase_count, 1.0 AS trend_factor, 0.5 AS churn_probability
  FROM jc j JOIN top5 t USING (RouteCode) JOIN cal ON cal.RouteCode = j.RouteCode
  WHERE NOT EXISTS (SELECT 1 FROM acty WHERE acty.RouteCode = j.RouteCode AND acty.CustomerCode = j.CustomerCode))"""

MERGED = f"""cand AS (SELECT * FROM hlane UNION ALL SELECT * FROM plane UNION ALL SELECT * FROM blane
  UNION ALL SELECT * FROM rlane UNION ALL SELECT * FROM slane),
rank1 AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY {P} ORDER BY priority DESC, lane) = 1),
shaped AS (SELECT r.*, CASE WHEN priority >= tier_must_stock THEN 'MUST_STOCK' WHEN priority >= tier_should_stock THEN 'SHOULD_STOCK'
    WHEN priority >= tier_consider THEN 'CONSIDER' WHEN priority >= tier_monitor THEN 'MONITOR' ELSE 'EXCLUDE' END AS tier
  FROM rank1 r JOIN cal USING (RouteCode)),
kept AS (SELECT * FROM shaped WHERE tier <> 'EXCLUDE'),
alloc AS (SELECT * FROM (SELECT *, greatest(0, least(qty, van_qty - COALESCE(SUM(qty) OVER (PARTITION BY RouteCode, ItemCode
    ORDER BY priority DESC, CustomerCode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given FROM kept) WHERE given > 0)"""

LANES = (sb.RAW, sb.CUSTOMER, sb.HISTORY, sb.SALES, sb.FORECAST, sb.journey(), *SCORED, VAN, PEERS, HISTORY_LANE, BASKET, STARTERS, MERGED)
