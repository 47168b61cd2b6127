"""Statistical forecasts, metrics, selection and inference tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from vanflow.catalog import demand as dm
from vanflow.catalog import sqlbase as sb
from vanflow.catalog.helpers import rounded, shared
from vanflow.operators import classify, evaluate, features, forecasters, panel

CFG = dm.MONTHLY
KEYS = list(CFG.group_keys)
ROW = [*KEYS, CFG.date_col]


def split(s, d):
    return shared("split", s, d, lambda: panel.time_based_split(
        dm.monthly_panel(s, d), CFG, panel.latest_period(dm.monthly_sales(s, d), CFG)))


def train(s, d):
    return split(s, d).filter("split = 'train'")


def classes(s, d):
    return shared("classes", s, d, lambda: classify.classify_dataset(
        split(s, d).filter("split <> 'test'"), CFG))


def rows(s, d, name):
    return split(s, d).filter(F.col("split") == name).select(*ROW, CFG.target_col)


def level(s, d, model):
    return rounded(forecasters.stat_levels(train(s, d), CFG, [model]))


def predictions(s, d, name="val"):
    """Every statistical model on the validation (or test) rows, with the pair's class."""
    fit = train(s, d) if name == "val" else split(s, d).filter("split <> 'test'")
    return forecasters.flat_forecast(
        forecasters.stat_levels(fit, CFG), rows(s, d, name), CFG
    ).join(classes(s, d).select(*KEYS, "class"), KEYS)


def metrics(s, d, name="val"):
    return evaluate.compute_metrics(predictions(s, d, name), CFG, ["class", "model"])


def weights(s, d):
    return forecasters.inverse_metric_weights(metrics(s, d), CFG.selection_metric)


def best(s, d):
    return evaluate.best_model_per_pair(predictions(s, d), CFG)


def stitched(s, d):
    return evaluate.stitch_best(predictions(s, d, "test"), best(s, d), CFG)


def future(s, d):
    return evaluate.future_skeleton(split(s, d), CFG)


def future_forecast(s, d):
    """Best statistical model of every pair over its future periods."""
    levels = forecasters.stat_levels(split(s, d), CFG)
    return evaluate.stitch_best(
        forecasters.flat_forecast(levels, future(s, d), CFG), best(s, d), CFG)


def _crossed(s, d):
    """Stitched predictions with raw bounds that cross for every third month."""
    odd = F.month(CFG.date_col) % 3 == 0
    p = F.col("prediction")
    return stitched(s, d).withColumns(
        {"q_10": F.when(odd, p * 1.5 + 1).otherwise(p * 0.5 - 1),
         "q_90": F.when(odd, p * 0.5).otherwise(p * 1.5)})


QUERIES = {
    "E1_pair_history_flat_forecast": lambda s, d: rounded(forecasters.flat_forecast(
        forecasters.stat_levels(train(s, d), CFG, ["naive"]), rows(s, d, "val"), CFG, ["naive"])),
    "E2_naive": lambda s, d: level(s, d, "naive"),
    "E3_moving_average": lambda s, d: level(s, d, "moving_average"),
    "E4_croston": lambda s, d: level(s, d, "croston"),
    "E5_croston_sba": lambda s, d: level(s, d, "croston_sba"),
    "E6_ets": lambda s, d: level(s, d, "ets"),
    "E6_ets_seasonal": lambda s, d: rounded(forecasters.seasonal_smoothing(train(s, d), CFG, 6, season=12)),
    "E12_residual_quantiles": lambda s, d: rounded(evaluate.residual_quantiles(
        evaluate.stitch_best(predictions(s, d), best(s, d), CFG), CFG)),
    "E12_quantile_intervals": lambda s, d: rounded(evaluate.merge_intervals(evaluate.add_intervals(
        stitched(s, d), evaluate.residual_quantiles(
            evaluate.stitch_best(predictions(s, d), best(s, d), CFG), CFG)))).select(
        *ROW, "best_model", "prediction", "q_10", "q_90"),
    "E14_weighted_ensemble": lambda s, d: rounded(forecasters.weighted_ensemble(
        predictions(s, d), weights(s, d), CFG)),
    "E15_inverse_metric_weights": lambda s, d: rounded(weights(s, d)),
    "F1_mae_rmse_bias": lambda s, d: rounded(evaluate.compute_metrics(
        predictions(s, d), CFG, ["model"], ["mae", "rmse", "bias"])),
    "F2_mape_smape": lambda s, d: rounded(evaluate.compute_metrics(
        predictions(s, d), CFG, ["model"], ["mape", "smape"])),
    "F3_wape": lambda s, d: rounded(evaluate.compute_metrics(predictions(s, d), CFG, KEYS + ["model"], ["wape"])),
    "F4_metrics_by_class_model": lambda s, d: rounded(metrics(s, d)),
    "F5_temporal_folds": lambda s, d: evaluate.fold_sizes(split(s, d), CFG),
    "F9_best_model_per_pair": lambda s, d: rounded(best(s, d)),
    "F10_stitched_predictions": lambda s, d: rounded(stitched(s, d).select(
        *ROW, CFG.target_col, "class", "best_model", "prediction")),
    "F11_best_model_per_class": lambda s, d: rounded(evaluate.best_model_per_class(metrics(s, d), CFG)),
    "F12_interval_merge": lambda s, d: rounded(evaluate.merge_intervals(_crossed(s, d)).select(
        *ROW, "prediction", "q_10", "q_90")),
    "F13_explainability_join": lambda s, d: rounded(evaluate.join_explainability(
        stitched(s, d), classify.pair_explainability(split(s, d).filter("split <> 'test'"), CFG), CFG
    ).select(*ROW, "prediction", "class", "class_expl", "n_periods", "mean_qty", "adi", "avg_gap_between_demand")),
    "F14_future_skeleton": lambda s, d: rounded(future(s, d)),
    "F16_future_route_summary": lambda s, d: evaluate.future_route_summary(future_forecast(s, d), CFG),
    "F17_forecast_kpis": lambda s, d: evaluate.forecast_kpis(
        stitched(s, d), classes(s, d), future_forecast(s, d), CFG),
    "F18_training_overview": lambda s, d: evaluate.training_overview(
        stitched(s, d), metrics(s, d, "test"), CFG,
        len(features.feature_columns(dm.feature_frame(s, d), dm.MONTHLY))),
}

_SPLIT = f"""sp AS (SELECT *, CASE WHEN TrxDate >= {dm.M_TEST} THEN 'test'
    WHEN TrxDate >= {dm.M_VAL} THEN 'val' ELSE 'train' END AS split FROM panel)"""
_ALPHAS = CFG.ets_alphas
# Price, activity, history length; dates; lags; rolling statistics; three of gaps; holidays in all; events; encoding;
# and two holidays a region.
_SETTLED = (
    3 + 10 + len({n for lags in CFG.lags.values() for n in lags})
    + len(CFG.rolling_windows) * len({x for stats in CFG.rolling_stats.values() for x in stats})
    + 3 + 1 + len(CFG.custom_events) + 1
)
_FEATURES = f"CAST({_SETTLED} + 2 * (SELECT COUNT(DISTINCT r_name) FROM region) AS INTEGER)"


def _levels(name: str, source: str, cond: str) -> str:
    """Level columns of all models for the rows of ``source`` meeting ``cond``."""
    init = "{'z': NULL::DOUBLE, 'p': NULL::DOUBLE, 'q': 1.0::DOUBLE}"
    cro = f"""list_reduce(h, lambda s, v: {{
      'z': CASE WHEN v > 0 THEN CASE WHEN s.z IS NULL THEN v ELSE 0.4::DOUBLE * v + 0.6::DOUBLE * s.z END ELSE s.z END,
      'p': CASE WHEN v > 0 THEN CASE WHEN s.z IS NULL THEN s.q ELSE 0.4::DOUBLE * s.q + 0.6::DOUBLE * s.p END ELSE s.p END,
      'q': CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE s.q + 1 END}}, {init})"""
    fits = ", ".join(
        f"""list_reduce(h[2:], lambda s, v: {{'sse': s.sse + (v - s.level) * (v - s.level),
          'alpha': s.alpha, 'level': s.level + s.alpha * (v - s.level)}},
          {{'sse': 0.0::DOUBLE, 'alpha': {a}::DOUBLE, 'level': h[1]}})"""
        for a in _ALPHAS
    )
    return f"""{name}h AS (SELECT RouteCode, ItemCode, list(CAST(y AS DOUBLE) ORDER BY TrxDate) AS h
    FROM {source} WHERE {cond} GROUP BY ALL),
{name}0 AS (SELECT RouteCode, ItemCode, h, {cro} AS c FROM {name}h),
{name} AS (SELECT RouteCode, ItemCode, h[-1] AS naive,
    list_sum(h[greatest(len(h) - 6, 1):]) / least(len(h), 7) AS moving_average,
    CASE WHEN c.z IS NULL OR c.p = 0 THEN 0 ELSE c.z / c.p END AS croston,
    CASE WHEN c.z IS NULL OR c.p = 0 THEN 0 ELSE 0.8::DOUBLE * c.z / c.p END AS croston_sba,
    CASE WHEN len(h) < 4 THEN list_avg(h) ELSE list_sort([{fits}])[1].level END AS ets FROM {name}0)"""


def _preds(name: str, levels: str, source: str, cond: str) -> str:
    return f"""{name} AS (SELECT r.RouteCode, r.ItemCode, r.TrxDate, r.y, k.class, m.model,
    greatest(COALESCE(CASE m.model WHEN 'naive' THEN l.naive WHEN 'moving_average' THEN l.moving_average
      WHEN 'croston' THEN l.croston WHEN 'croston_sba' THEN l.croston_sba ELSE l.ets END, 0), 0) AS prediction
  FROM {source} r CROSS JOIN (VALUES ('naive'), ('moving_average'), ('croston'), ('croston_sba'), ('ets')) m(model)
  LEFT JOIN {levels} l ON l.RouteCode = r.RouteCode AND l.ItemCode = r.ItemCode
  JOIN classes k ON k.RouteCode = r.RouteCode AND k.ItemCode = r.ItemCode WHERE {cond})"""


_METRICS = {
    "mae": "AVG(abs(y - prediction))",
    "rmse": "sqrt(AVG((y - prediction) * (y - prediction)))",
    "mape": "AVG(CASE WHEN abs(y) > 1e-9 THEN abs((y - prediction) / y) END) * 100",
    "smape": "AVG(abs(y - prediction) / ((abs(y) + abs(prediction)) / 2 + 1e-9)) * 100",
    "bias": "AVG(prediction - y)",
    "wape": "SUM(CASE WHEN y > 1e-9 THEN abs(y - prediction) END) / SUM(CASE WHEN y > 1e-9 THEN y END) * 100",
}


def _metric_cols(*names: str) -> str:
    return ", ".join(f"{sb.rint(_METRICS[n], 6)} AS {n}" for n in names)


def _order() -> str:
    whens = " ".join(
        f"WHEN class = '{c}' AND model = '{m}' THEN {i}"
        for c, names in CFG.models.items() for i, m in enumerate(names)
    )
    return f"CASE {whens} ELSE 99 END"


_BASE = (*dm.PANEL_M, dm.TRAIN_M, dm.CLASSES, _SPLIT, _levels("lv", "sp", "split = 'train'"))
_VAL = (*_BASE, _preds("pv", "lv", "sp", "r.split = 'val'"))
_WEIGHTS = f"""mt AS (SELECT class, model, {_METRICS['rmse']} AS rmse FROM pv GROUP BY ALL),
wt AS (SELECT class, model, (1 / (rmse + 1e-9)) / SUM(1 / (rmse + 1e-9)) OVER (PARTITION BY class) AS weight FROM mt)"""
_BEST = f"""ps AS (SELECT RouteCode, ItemCode, class, model, {_METRICS['rmse']} AS score FROM pv GROUP BY ALL),
best AS (SELECT RouteCode, ItemCode, class, model AS best_model, score FROM ps
  QUALIFY row_number() OVER (PARTITION BY RouteCode, ItemCode ORDER BY score, {_order()}, model) = 1)"""
_TEST = (*_VAL, _BEST, _levels("lt", "sp", "split <> 'test'"), _preds("pt", "lt", "sp", "r.split = 'test'"),
         """st AS (SELECT pt.RouteCode, pt.ItemCode, TrxDate, y, pt.class, best_model, prediction FROM pt
           JOIN best ON pt.RouteCode = best.RouteCode AND pt.ItemCode = best.ItemCode AND model = best_model)""")
_FUTURE = (*_TEST, """lastp AS (SELECT RouteCode, ItemCode, MAX(TrxDate) AS b,
    arg_max(WarehouseName, TrxDate) AS WarehouseName, arg_max(CategoryName, TrxDate) AS CategoryName,
    arg_max(AvgUnitPrice, TrxDate) FILTER (AvgUnitPrice IS NOT NULL) AS AvgUnitPrice FROM sp GROUP BY ALL),
fut AS (SELECT lastp.*, CAST(b + to_months(CAST(h AS INT)) AS DATE) AS TrxDate FROM lastp, range(1, 7) t(h))""",
           _levels("lf", "sp", "true"),
           """ff AS (SELECT fut.RouteCode, fut.ItemCode, fut.TrxDate, greatest(CASE best_model
    WHEN 'naive' THEN l.naive WHEN 'moving_average' THEN l.moving_average WHEN 'croston' THEN l.croston
    WHEN 'croston_sba' THEN l.croston_sba ELSE l.ets END, 0) AS prediction
  FROM fut JOIN lf l USING (RouteCode, ItemCode) JOIN best USING (RouteCode, ItemCode))""")
_BAND = "CAST(floor(log2(1.0 + greatest({p}, 0))) AS INT)"
_STV = """sv AS (SELECT pv.RouteCode, pv.ItemCode, TrxDate, y, pv.class, prediction FROM pv
  JOIN best ON pv.RouteCode = best.RouteCode AND pv.ItemCode = best.ItemCode AND model = best_model)"""
_RQ = f"""rq AS (SELECT class, {_BAND.format(p='prediction')} AS band,
    quantile_cont({sb.rint('y - prediction', 2)}, 0.1) AS low_offset,
    quantile_cont({sb.rint('y - prediction', 2)}, 0.9) AS high_offset FROM sv GROUP BY ALL)"""
_EXPL_TRAIN = dm._EXPL.split("ix AS (")[1]


def _seasonal_sql(season: int, steps: int) -> str:
    """Holt-Winters as one list fold per pair and grid point; the cycle rotates, so that its head is the current place."""
    new = "(a * (v - s.cyc[1]) + (1 - a) * (s.level + s.slope))"
    error = "(v - (s.level + s.slope + s.cyc[1]))"
    return sb.with_(*_BASE, f"""hw AS (SELECT RouteCode, ItemCode, h, len(h) >= {2 * season} AS cyclic FROM lvh),
      h0 AS (SELECT *, CASE WHEN cyclic THEN {season} ELSE 1 END AS m, CASE WHEN cyclic THEN list_avg(h[:{season}]) ELSE h[1] END AS l0 FROM hw),
      grid AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.8)) AS x(a), (VALUES (0.1::DOUBLE), (0.3)) AS y(b), (VALUES (0.1::DOUBLE), (0.3)) AS z(g)),
      fits AS (SELECT RouteCode, ItemCode, m, a, b, g, list_reduce(h[m + 1:], lambda s, v: {{'level': {new},
          'slope': b * ({new} - s.level) + (1 - b) * s.slope,
          'cyc': list_append(s.cyc[2:], CASE WHEN cyclic THEN g * (v - {new}) + (1 - g) * s.cyc[1] ELSE 0 END),
          'sse': s.sse + {error} * {error}}},
          {{'level': l0, 'slope': 0.0::DOUBLE, 'cyc': CASE WHEN cyclic THEN list_transform(h[:{season}], lambda x: x - l0) ELSE [0.0::DOUBLE] END,
            'sse': 0.0::DOUBLE}}) AS f FROM h0, grid WHERE len(h) >= 4),
      fit AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY RouteCode, ItemCode ORDER BY f.sse, a, b, g) = 1)""") + f"""
      SELECT RouteCode, ItemCode, CAST(i AS INTEGER) AS step,
        {sb.rint('greatest(CASE WHEN f IS NULL THEN list_avg(h) ELSE f.level + f.slope * i + f.cyc[(i - 1) % m + 1] END, 0)', 6)} AS prediction
      FROM (SELECT RouteCode, ItemCode, h0.h, h0.m, f FROM h0 LEFT JOIN fit USING (RouteCode, ItemCode)), range(1, {steps + 1}) AS t(i)"""


def _level_sql(model: str) -> str:
    return sb.with_(*_BASE) + f"SELECT RouteCode, ItemCode, {sb.rint(model, 6)} AS {model} FROM lv"


ORACLES = {
    "E1_pair_history_flat_forecast": sb.with_(*_BASE) + f"""SELECT r.RouteCode, r.ItemCode, r.TrxDate,
      r.y AS TotalQuantity, 'naive' AS model, {sb.rint('greatest(COALESCE(naive, 0), 0)', 6)} AS prediction
      FROM sp r LEFT JOIN lv USING (RouteCode, ItemCode) WHERE split = 'val'""",
    "E2_naive": _level_sql("naive"),
    "E3_moving_average": _level_sql("moving_average"),
    "E4_croston": _level_sql("croston"),
    "E5_croston_sba": _level_sql("croston_sba"),
    "E6_ets": _level_sql("ets"),
    "E6_ets_seasonal": _seasonal_sql(12, 6),
    "E12_residual_quantiles": sb.with_(*_VAL, _BEST, _STV, _RQ) + f"""SELECT class, band,
      {sb.rint('low_offset', 6)} AS low_offset, {sb.rint('high_offset', 6)} AS high_offset FROM rq""",
    "E12_quantile_intervals": sb.with_(*_TEST, _STV, _RQ) + f"""SELECT RouteCode, ItemCode, TrxDate, best_model,
      {sb.rint('prediction', 6)} AS prediction,
      {sb.rint('least(greatest(lo, 0), greatest(hi, 0), prediction)', 6)} AS q_10,
      {sb.rint('greatest(lo, hi, prediction, 0)', 6)} AS q_90
      FROM (SELECT st.*, prediction + COALESCE(low_offset, 0) AS lo, prediction + COALESCE(high_offset, 0) AS hi
        FROM st LEFT JOIN rq ON rq.class = st.class AND rq.band = {_BAND.format(p='st.prediction')})""",
    "E14_weighted_ensemble": sb.with_(*_VAL, _WEIGHTS) + f"""SELECT class, RouteCode, ItemCode, TrxDate,
      {sb.rint('SUM(weight * prediction) / SUM(weight)', 6)} AS prediction, 'ensemble' AS model
      FROM pv JOIN wt USING (class, model) GROUP BY ALL""",
    "E15_inverse_metric_weights": sb.with_(*_VAL, _WEIGHTS)
    + f"SELECT class, model, {sb.rint('weight', 6)} AS weight FROM wt",
    "F1_mae_rmse_bias": sb.with_(*_VAL) + f"SELECT model, {_metric_cols('mae', 'rmse', 'bias')} FROM pv GROUP BY model",
    "F2_mape_smape": sb.with_(*_VAL) + f"SELECT model, {_metric_cols('mape', 'smape')} FROM pv GROUP BY model",
    "F3_wape": sb.with_(*_VAL) + f"SELECT RouteCode, ItemCode, model, {_metric_cols('wape')} FROM pv GROUP BY ALL",
    "F4_metrics_by_class_model": sb.with_(*_VAL)
    + f"SELECT class, model, {_metric_cols(*evaluate.METRICS)} FROM pv GROUP BY class, model",
    "F5_temporal_folds": sb.with_(*_BASE) + """, dd AS (SELECT DISTINCT TrxDate FROM sp),
      ct AS (SELECT COUNT(*) AS total FROM dd),
      lastd AS (SELECT TrxDate AS cutoff FROM dd ORDER BY 1 DESC LIMIT 3),
      fo AS (SELECT CAST(row_number() OVER (ORDER BY cutoff) AS INT) AS fold, cutoff FROM lastd, ct WHERE total >= 5)
      SELECT fold, cutoff, COUNT(*) FILTER (TrxDate < cutoff) AS train_rows,
        COUNT(*) FILTER (TrxDate = cutoff) AS val_rows
      FROM fo, ct, sp WHERE total - 3 + fold - 1 >= 2 GROUP BY fold, cutoff""",
    "F9_best_model_per_pair": sb.with_(*_VAL, _BEST)
    + f"SELECT RouteCode, ItemCode, class, best_model, {sb.rint('score', 6)} AS score FROM best",
    "F10_stitched_predictions": sb.with_(*_TEST) + f"""SELECT RouteCode, ItemCode, TrxDate, y AS TotalQuantity,
      class, best_model, {sb.rint('prediction', 6)} AS prediction FROM st""",
    "F11_best_model_per_class": sb.with_(*_VAL) + f""", mt AS (SELECT class, model, {_METRICS['rmse']} AS score
      FROM pv GROUP BY ALL) SELECT class, model AS best_model, {sb.rint('score', 6)} AS score FROM mt
      QUALIFY row_number() OVER (PARTITION BY class ORDER BY score, {_order()}, model) = 1""",
    "F12_interval_merge": sb.with_(*_TEST) + f"""SELECT RouteCode, ItemCode, TrxDate,
      {sb.rint('prediction', 6)} AS prediction, {sb.rint('least(greatest(lo, 0), greatest(hi, 0), prediction)', 6)} AS q_10,
      {sb.rint('greatest(lo, hi, prediction, 0)', 6)} AS q_90
      FROM (SELECT *, CASE WHEN month(TrxDate) % 3 = 0 THEN prediction * 1.5::DOUBLE + 1 ELSE prediction * 0.5::DOUBLE - 1 END AS lo,
        CASE WHEN month(TrxDate) % 3 = 0 THEN prediction * 0.5::DOUBLE ELSE prediction * 1.5::DOUBLE END AS hi FROM st)""",
    "F13_explainability_join": sb.with_(*_TEST) + ", ix AS (" + _EXPL_TRAIN + f"""
      SELECT st.RouteCode, st.ItemCode, TrxDate, {sb.rint('prediction', 6)} AS prediction, st.class,
        classes.class AS class_expl, n_periods, mean_qty,
        CASE WHEN isinf(adi) THEN NULL ELSE {sb.rint('adi', 6)} END AS adi, avg_gap_between_demand
      FROM st LEFT JOIN ex USING (RouteCode, ItemCode) LEFT JOIN classes USING (RouteCode, ItemCode)""",
    "F14_future_skeleton": sb.with_(*_FUTURE) + f"""SELECT RouteCode, ItemCode, TrxDate, 0.0::DOUBLE AS TotalQuantity,
      0 AS activity_flag, WarehouseName, ItemCode AS ItemName, CategoryName,
      {sb.rint('AvgUnitPrice', 6)} AS AvgUnitPrice FROM fut""",
    "F16_future_route_summary": sb.with_(*_FUTURE) + f"""SELECT RouteCode AS route_code,
      COUNT(DISTINCT ItemCode) AS skus, {sb.rint('SUM(prediction)', 1)} AS predicted_qty FROM ff GROUP BY RouteCode""",
    "F17_forecast_kpis": sb.with_(*_FUTURE) + f"""SELECT {sb.rint('''COALESCE(greatest(0, 100 - SUM(CASE WHEN y > 0
        THEN abs(y - prediction) END) / SUM(CASE WHEN y > 0 THEN y END) * 100), 0)''', 2)} AS accuracy_pct,
      COUNT(*) AS test_predictions_count, (SELECT COUNT(*) FROM classes) AS total_pairs,
      (SELECT COUNT(*) FROM ff) AS future_forecast_count, (SELECT MAX(TrxDate) FROM ff) AS last_forecast_date FROM st""",
    "F18_training_overview": sb.with_(*_TEST) + f""", mt AS (SELECT class, model, {_METRICS['rmse']} AS score
        FROM pt GROUP BY ALL),
      cc AS (SELECT class, COUNT(*) AS models_competed FROM mt GROUP BY class),
      w AS (SELECT class, model AS best_model, score FROM mt
        QUALIFY row_number() OVER (PARTITION BY class ORDER BY score, {_order()}, model) = 1)
      SELECT class, best_model, {sb.rint('score', 1)} AS score, models_competed,
        (SELECT MIN(TrxDate) FROM st) AS test_date_start, (SELECT MAX(TrxDate) FROM st) AS test_date_end,
        (SELECT COUNT(DISTINCT RouteCode) FROM st) AS test_routes,
        (SELECT COUNT(DISTINCT ItemCode) FROM st) AS test_items, {_FEATURES} AS feature_count
      FROM w JOIN cc USING (class)""",
}
