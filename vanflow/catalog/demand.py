"""Panel, classification and features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from vanflow.catalog import sqlbase as sb
from vanflow.catalog.helpers import rounded
from vanflow.config import DEMAND
from vanflow.operators import classify, features, panel
from vanflow.sources import fixtures as fx

# nation x type by month: all four demand classes occur
MONTHLY = replace(
    DEMAND, granularity="M", max_inactivity_periods=6, test_horizon=6, validation_horizon=6,
    forecast_horizon=6,
)
# region x brand by week
WEEKLY = replace(
    DEMAND, granularity="W", max_inactivity_periods=26, test_horizon=8, validation_horizon=8,
    forecast_horizon=8, custom_events=(("Spring Push", "1999-03-01", "1999-04-30"),
                                       ("Year End (retail)", "2000-12-01", "2000-12-31")),
)
# region x type by day
DAILY = DEMAND


def monthly_sales(s, d):
    return fx.sales_recent(s, d, "nation", "type")


def weekly_sales(s, d):
    return fx.sales_recent(s, d, "region", "brand")


def daily_sales(s, d):
    return fx.sales_recent(s, d, "region", "type")


def monthly_panel(s, d):
    return panel.build_panel(monthly_sales(s, d), MONTHLY)


def weekly_panel(s, d):
    return panel.build_panel(weekly_sales(s, d), WEEKLY)


def daily_panel(s, d):
    return panel.build_panel(daily_sales(s, d), DAILY)


def monthly_train(s, d):
    return panel.train_window(
        monthly_panel(s, d), MONTHLY, panel.latest_period(monthly_sales(s, d), MONTHLY)
    )


def monthly_classes(s, d):
    return classify.classify_dataset(monthly_train(s, d), MONTHLY)


def holiday_calendar(s, d):
    """Regional anniversaries: one combined entry per region and year."""
    region = fx.table(s, d, "region")
    return region.select(
        F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("_year"), "r_regionkey", "r_name"
    ).select(
        F.make_date("_year", F.col("r_regionkey") * 2 + 1, F.lit(10) + F.col("r_regionkey"))
        .alias("date"),
        F.concat(
            F.initcap("r_name"), F.lit("'s Day (observed); "), F.col("r_name"), F.lit(" Eve Holiday")
        ).alias("name"),
    )


def _features(df, names):
    return rounded(df.select(*DEMAND.group_keys, DEMAND.date_col, *names))


def _class_features(s, d):
    return features.class_features(monthly_panel(s, d), monthly_classes(s, d), MONTHLY)


def feature_frame(s, d):
    return features.build_features(
        monthly_panel(s, d), monthly_classes(s, d), MONTHLY, monthly_train(s, d),
        features.holiday_names(holiday_calendar(s, d)),
    )


def _feature_list(s, d):
    df = feature_frame(s, d)
    cols = features.feature_columns(df, MONTHLY)
    one = df.agg(*[F.count(c).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("filled_rows")) for c in cols])))


def _holiday_query(s, d):
    names = features.holiday_names(holiday_calendar(s, d))
    flagged = features.holiday_flags(weekly_panel(s, d), names, WEEKLY)
    return flagged.select(
        *WEEKLY.group_keys, WEEKLY.date_col, *[c for c in flagged.columns if c.startswith("hol_")],
        "n_holidays_in_period",
    )


def _event_query(s, d):
    out = features.event_flags(weekly_panel(s, d), WEEKLY)
    return out.select(*WEEKLY.group_keys, WEEKLY.date_col, *[c for c in out.columns if c.startswith("evt_")])


def _encoding(s, d):
    return rounded(
        features.apply_target_encoding(monthly_panel(s, d), monthly_train(s, d), MONTHLY).select(
            *MONTHLY.group_keys, MONTHLY.date_col, "te_pair_mean")
    )


def _outliers(s, d):
    cfg = replace(MONTHLY, iqr_multiplier=1.0)
    train = monthly_train(s, d)
    classes = classify.classify_dataset(train, cfg)
    treated = panel.treat_outliers(
        monthly_panel(s, d), panel.outlier_bounds(train, cfg), classes, cfg)
    return rounded(treated.select(*cfg.group_keys, cfg.date_col, cfg.target_col))


def _signed_panel(s, d):
    """Net quantities, returns included, so that negatives occur."""
    raw = fx.raw_sales(s, d)
    net = raw.groupBy("TrxDate", "RouteCode", "ItemCode").agg(F.sum("QuantityInPCs").alias("TotalQuantity"))
    cfg = replace(WEEKLY, causal_cols=(), meta_cols=())
    return panel.clip_negative_to_zero(panel.build_panel(net, cfg), "TotalQuantity").select(
        "RouteCode", "ItemCode", "TrxDate", "TotalQuantity")


_CAUSAL_MIX = replace(
    DEMAND, granularity="Q",
    causal_cols=(("AvgUnitPrice", "median"), ("WarehouseCode", "max"), ("CategoryCode", "nunique")),
)


def _quarterly(s, d):
    return rounded(panel.aggregate_to_period(
        fx.customer_data(s, d, "nation").withColumn("WarehouseCode", F.col("RouteCode")), _CAUSAL_MIX))


_PERIOD = {"D": "TrxDate", "W": "CAST(date_trunc('week', TrxDate) AS DATE)",
           "M": "CAST(date_trunc('month', TrxDate) AS DATE)"}
_STEP = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH"}


def panel_sql(gran: str, route: str, item: str) -> tuple[str, ...]:
    return (
        sb.raw(route, item), sb.SALES,
        f"""agg AS (SELECT RouteCode, ItemCode, {_PERIOD[gran]} AS p, SUM(TotalQuantity) AS q,
    AVG(AvgUnitPrice) AS price, MIN((TrxDate, CategoryName)) AS fc,
    MIN((TrxDate, WarehouseName)) AS fw FROM sales GROUP BY ALL)""",
        """span AS (SELECT RouteCode, ItemCode, MIN(p) AS a, MAX(p) AS b,
    struct_extract_at(MIN(fc), 2) AS CategoryName, struct_extract_at(MIN(fw), 2) AS WarehouseName
  FROM agg GROUP BY ALL)""",
        f"""cal AS (SELECT RouteCode, ItemCode, CategoryName, WarehouseName,
    CAST(unnest(generate_series(a, b, {_STEP[gran]})) AS DATE) AS p FROM span)""",
        """panel AS (SELECT cal.RouteCode, cal.ItemCode, cal.p AS TrxDate, COALESCE(q, 0) AS y,
    price AS AvgUnitPrice, CASE WHEN q IS NULL THEN 0 ELSE 1 END AS activity_flag,
    CategoryName, WarehouseName
  FROM cal LEFT JOIN agg ON agg.RouteCode = cal.RouteCode AND agg.ItemCode = cal.ItemCode AND agg.p = cal.p)""",
    )


PANEL_M = panel_sql("M", "nation", "type")
PANEL_W = panel_sql("W", "region", "brand")
PANEL_D = panel_sql("D", "region", "type")
M_TEST = "(SELECT MAX(TrxDate) FROM panel) - INTERVAL 5 MONTH"
M_VAL = "(SELECT MAX(TrxDate) FROM panel) - INTERVAL 11 MONTH"
TRAIN_M = f"train AS (SELECT * FROM panel WHERE TrxDate < {M_TEST})"
TRAIN_W = "train AS (SELECT * FROM panel WHERE TrxDate < (SELECT MAX(TrxDate) FROM panel) - 49)"
CLASSES = """ac AS (SELECT RouteCode, ItemCode, COUNT(*) AS n,
    CASE WHEN COUNT(*) FILTER (y > 0) > 0 THEN COUNT(*) / COUNT(*) FILTER (y > 0)
      ELSE CAST('inf' AS DOUBLE) END AS adi,
    pow(stddev_pop(y) FILTER (y > 0) / AVG(y) FILTER (y > 0), 2) AS cv2 FROM train GROUP BY ALL),
classes AS (SELECT RouteCode, ItemCode, adi, cv2, CASE WHEN cv2 IS NULL THEN 'intermittent'
    WHEN adi >= 1.32 AND cv2 >= 0.49 THEN 'lumpy' WHEN adi >= 1.32 THEN 'intermittent'
    WHEN cv2 >= 0.49 THEN 'erratic' ELSE 'smooth' END AS class FROM ac)"""
_K = "RouteCode, ItemCode, TrxDate"
_W = "OVER (PARTITION BY RouteCode, ItemCode ORDER BY TrxDate)"


def _before(n: int | str) -> str:
    lo = "UNBOUNDED" if n == "all" else str(n)
    return (f"OVER (PARTITION BY RouteCode, ItemCode ORDER BY TrxDate "
            f"ROWS BETWEEN {lo} PRECEDING AND 1 PRECEDING)")


def _temporal_sql() -> str:
    dow, month, quarter = "isodow(TrxDate) - 1", "month(TrxDate)", "quarter(TrxDate)"
    circle = lambda f, x, n: sb.rint(f"{f}(2 * pi() * ({x}) / {n}.0)", 6)
    return f"""SELECT {_K}, {dow} AS day_of_week, {circle('sin', dow, 7)} AS day_of_week_sin,
      {circle('cos', dow, 7)} AS day_of_week_cos, day(TrxDate) AS day_of_month,
      weekofyear(TrxDate) AS week_of_year, {month} AS month, {circle('sin', month, 12)} AS month_sin,
      {circle('cos', month, 12)} AS month_cos, CASE WHEN {dow} = 4 THEN 1 ELSE 0 END AS is_weekend,
      date_diff('day', MIN(TrxDate) OVER (PARTITION BY RouteCode, ItemCode), TrxDate) AS days_since_start,
      {quarter} AS quarter, {circle('sin', quarter, 4)} AS quarter_sin,
      {circle('cos', quarter, 4)} AS quarter_cos, year(TrxDate) AS year FROM panel"""


def _rolling_cols(windows=(7, 14, 28)) -> dict[str, str]:
    out = {}
    for w in windows:
        f = _before(w)
        out[f"roll_mean_{w}"] = f"AVG(y) {f}"
        out[f"roll_std_{w}"] = f"stddev_samp(y) {f}"
        out[f"roll_min_{w}"] = f"MIN(y) {f}"
        out[f"roll_max_{w}"] = f"MAX(y) {f}"
        out[f"roll_median_{w}"] = f"quantile_cont(y, 0.5) {f}"
        out[f"roll_sum_{w}"] = f"SUM(y) {f}"
        out[f"roll_nonzero_ratio_{w}"] = (
            f"CASE WHEN row_number() {_W} > 1 THEN COUNT(CASE WHEN y > 0 THEN 1 END) {f} "
            f"/ least(row_number() {_W}, {w}) END"
        )
    return out


def _select(cols: dict[str, str], source: str = "panel") -> str:
    return f"SELECT {_K}, " + ", ".join(f"{sb.rint(e, 6)} AS {n}" for n, e in cols.items()) + f" FROM {source}"


_ROLL = _rolling_cols()
_INTER = {
    "nonzero_mean_to_date": f"CASE WHEN rn > 1 THEN COALESCE(AVG(CASE WHEN y > 0 THEN y END) {_before('all')}, 0) END",
    "inter_demand_interval": f"CASE WHEN rn > 1 THEN rn / greatest(COUNT(CASE WHEN y > 0 THEN 1 END) {_before('all')}, 1) END",
    "last_nonzero_gap": f"CASE WHEN rn > 1 THEN rn - 1 - COALESCE(MAX(CASE WHEN y > 0 THEN rn END) {_before('all')}, 0) END",
}
_NUMBERED = f"numbered AS (SELECT *, row_number() {_W} AS rn FROM panel)"


def _class_features_sql() -> str:
    cfg = MONTHLY
    parts = []
    for n in (1, 7, 14, 21, 28):
        users = [c for c, lags in cfg.lags.items() if n in lags]
        parts.append((f"lag_{n}", f"lag(y, {n}) {_W}", users))
    for name, expr in _ROLL.items():
        stat = name[5:].rsplit("_", 1)[0]
        parts.append((name, expr, [c for c, group in cfg.rolling_stats.items() if stat in group]))
    for name, expr in _INTER.items():
        parts.append((name, expr, ["intermittent", "lumpy"]))
    cols = {}
    for name, expr, users in parts:
        names = ", ".join(f"'{u}'" for u in users)
        cols[name] = f"CASE WHEN class IN ({names}) THEN {expr} END" if users else "NULL"
    cols["pair_history_len"] = "COUNT(y) OVER (PARTITION BY RouteCode, ItemCode)"
    return (
        sb.with_(*PANEL_M, TRAIN_M, CLASSES, _NUMBERED,
                 "cp AS (SELECT numbered.*, class FROM numbered JOIN classes USING (RouteCode, ItemCode))")
        + _select(cols, "cp").replace(f"SELECT {_K}", f"SELECT {_K}, class")
    )


_CLASS_COLS = (
    ["class"] + [f"lag_{n}" for n in (1, 7, 14, 21, 28)]
    + [c for c in _ROLL] + list(_INTER) + ["pair_history_len"]
)
_HOLIDAYS = """cal0 AS (SELECT make_date(yr, r_regionkey * 2 + 1, 10 + r_regionkey) AS date,
    upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) || '''s Day (observed); ' || r_name || ' Eve Holiday' AS name
  FROM region, range(1995, 2002) AS t(yr)),
parts AS (SELECT date, trim(unnest(string_split(name, ';'))) AS part FROM cal0),
hol AS (SELECT DISTINCT date, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(
    part, '\\s*\\([^)]*\\)', '', 'g'), '\\s*holiday\\s*$', '', 'gi'), '[''’]', '', 'g')),
    '[^a-z0-9]+', '_', 'g'), '_') AS name FROM parts WHERE part <> '')"""


def _holiday_sql() -> str:
    names = []
    # region names of the generated data, slugged; the flags are one column each
    for r in ("africa", "america", "asia", "europe", "middle_east"):
        names += [f"{r}s_day", f"{r}_eve"]
    flags = ", ".join(f"MAX(CASE WHEN name = '{n}' THEN 1 ELSE 0 END) AS hol_{n}" for n in names)
    outs = ", ".join(f"COALESCE(hol_{n}, 0) AS hol_{n}" for n in names)
    return sb.with_(*PANEL_W, _HOLIDAYS, f"""per AS (SELECT CAST(date_trunc('week', date) AS DATE) AS m,
      COUNT(*) AS n, {flags} FROM hol GROUP BY ALL)""") + (
        f"SELECT {_K}, {outs}, CAST(COALESCE(n, 0) AS INT) AS n_holidays_in_period "
        "FROM panel LEFT JOIN per ON m = TrxDate")


_EXPL = sb.with_(*PANEL_M, TRAIN_M, CLASSES, f"""ix AS (SELECT *, row_number() {_W} AS i FROM train),
ex AS (SELECT RouteCode, ItemCode, COUNT(*) AS n_periods, COUNT(*) FILTER (y > 0) AS n_nonzero_periods,
    {sb.rint('COUNT(*) FILTER (y > 0) / COUNT(*)', 6)} AS nonzero_ratio, {sb.rint('AVG(y)', 6)} AS mean_qty,
    {sb.rint('quantile_cont(y, 0.5)', 6)} AS median_qty, MIN(y) AS min_qty, MAX(y) AS max_qty,
    {sb.rint('stddev_pop(y)', 6)} AS std_qty, SUM(y) AS sum_qty,
    {sb.rint('COALESCE(AVG(y) FILTER (y > 0), 0)', 6)} AS nonzero_mean,
    {sb.rint('COALESCE(stddev_pop(y) FILTER (y > 0), 0)', 6)} AS nonzero_std,
    {sb.rint('''CASE WHEN COUNT(*) FILTER (y > 0) >= 2 THEN (MAX(i) FILTER (y > 0) - MIN(i) FILTER (y > 0))
      / (COUNT(*) FILTER (y > 0) - 1) END''', 6)} AS avg_gap_between_demand FROM ix GROUP BY ALL)""")

QUERIES = {
    "B1_aggregate_to_period": lambda s, d: rounded(panel.aggregate_to_period(monthly_sales(s, d), MONTHLY)),
    "B1_aggregate_quarterly_causal": _quarterly,
    "B2_fill_missing_periods": lambda s, d: rounded(panel.fill_missing_periods(
        panel.aggregate_to_period(weekly_sales(s, d), WEEKLY, with_meta=False), WEEKLY)),
    "B3_build_panel": lambda s, d: rounded(monthly_panel(s, d)),
    "B3_build_panel_daily": lambda s, d: rounded(daily_panel(s, d)),
    "B4_drop_inactive_pairs": lambda s, d: panel.drop_inactive_pairs(
        monthly_panel(s, d), replace(MONTHLY, max_inactivity_periods=1)).select(
        "RouteCode", "ItemCode", "TrxDate", "TotalQuantity"),
    "B5_clip_negative": _signed_panel,
    "B6_outlier_treatment": _outliers,
    "B7_time_based_split": lambda s, d: panel.time_based_split(monthly_panel(s, d), MONTHLY).select(
        "RouteCode", "ItemCode", "TrxDate", "split"),
    "C1_adi_cv2": lambda s, d: rounded(classify.pair_intervals(monthly_panel(s, d), MONTHLY)),
    "C2_classify_pair": lambda s, d: classify.classify_dataset(weekly_panel(s, d), WEEKLY).select(
        "RouteCode", "ItemCode", "class"),
    "C3_classify_dataset": lambda s, d: rounded(monthly_classes(s, d)),
    "C4_pair_explainability": lambda s, d: rounded(
        classify.pair_explainability(monthly_train(s, d), MONTHLY)),
    "C5_avg_gap": lambda s, d: rounded(classify.avg_gap_between_demand(monthly_train(s, d), MONTHLY)),
    "C6_class_summary": lambda s, d: classify.class_summary(monthly_classes(s, d)),
    "D1_temporal_features": lambda s, d: _features(
        features.temporal_features(daily_panel(s, d), DAILY), features.TEMPORAL),
    "D2_lag_features": lambda s, d: _features(
        features.lag_features(daily_panel(s, d), DAILY, [1, 7, 14, 21, 28]),
        [f"lag_{n}" for n in (1, 7, 14, 21, 28)]),
    "D3_rolling_features": lambda s, d: _features(
        features.rolling_features(weekly_panel(s, d), WEEKLY, (7, 14, 28),
                                  ("mean", "std", "min", "max", "median", "sum")),
        [c for c in _ROLL if "ratio" not in c]),
    "D4_rolling_nonzero_ratio": lambda s, d: _features(
        features.rolling_features(daily_panel(s, d), DAILY, (7, 14, 28), ("nonzero_ratio",)),
        [c for c in _ROLL if "ratio" in c]),
    "D5_nonzero_mean_to_date": lambda s, d: _features(
        features.intermittent_features(weekly_panel(s, d), WEEKLY), ["nonzero_mean_to_date"]),
    "D6_inter_demand_interval": lambda s, d: _features(
        features.intermittent_features(weekly_panel(s, d), WEEKLY), ["inter_demand_interval"]),
    "D7_last_nonzero_gap": lambda s, d: _features(
        features.intermittent_features(monthly_panel(s, d), MONTHLY), ["last_nonzero_gap"]),
    "D8_history_length": lambda s, d: _features(
        features.history_length(monthly_panel(s, d), MONTHLY), ["pair_history_len"]),
    "D9_holiday_flags": _holiday_query,
    "D10_holiday_names": lambda s, d: features.holiday_names(holiday_calendar(s, d)),
    "D11_event_flags": _event_query,
    "D12_target_encoding": _encoding,
    "D13_class_features": lambda s, d: _features(_class_features(s, d), _CLASS_COLS),
    "D14_feature_columns": _feature_list,
}

_BASIC = "y AS TotalQuantity"
_PANEL_COLS = f"""RouteCode, ItemCode, TrxDate, {_BASIC}, {sb.rint('AvgUnitPrice', 6)} AS AvgUnitPrice,
  activity_flag, WarehouseName, ItemCode AS ItemName, CategoryName"""

ORACLES = {
    "B1_aggregate_to_period": sb.with_(*PANEL_M) + f"""SELECT RouteCode, ItemCode, p AS TrxDate,
      q AS TotalQuantity, {sb.rint('price', 6)} AS AvgUnitPrice, WarehouseName, ItemCode AS ItemName,
      CategoryName FROM agg JOIN span USING (RouteCode, ItemCode)""",
    "B1_aggregate_quarterly_causal": sb.with_(sb.raw("nation"), sb.CUSTOMER, """f AS (
      SELECT RouteCode, ItemCode, struct_extract_at(MIN((TrxDate, CategoryName)), 2) AS CategoryName
      FROM cust GROUP BY ALL)""") + f"""SELECT RouteCode, ItemCode,
      CAST(date_trunc('quarter', TrxDate) AS DATE) AS TrxDate, SUM(TotalQuantity) AS TotalQuantity,
      {sb.rint('quantile_cont(CAST(AvgUnitPrice AS DOUBLE), 0.5)', 6)} AS AvgUnitPrice,
      MAX(RouteCode) AS WarehouseCode, COUNT(DISTINCT CategoryCode) AS CategoryCode,
      ItemCode AS ItemName, f.CategoryName
      FROM cust JOIN f USING (RouteCode, ItemCode)
      GROUP BY RouteCode, ItemCode, date_trunc('quarter', TrxDate), f.CategoryName""",
    "B2_fill_missing_periods": sb.with_(*PANEL_W) + f"""SELECT RouteCode, ItemCode, TrxDate, {_BASIC},
      {sb.rint('AvgUnitPrice', 6)} AS AvgUnitPrice, activity_flag FROM panel""",
    "B3_build_panel": sb.with_(*PANEL_M) + f"SELECT {_PANEL_COLS} FROM panel",
    "B3_build_panel_daily": sb.with_(*PANEL_D) + f"SELECT {_PANEL_COLS} FROM panel",
    "B4_drop_inactive_pairs": sb.with_(*PANEL_M) + f"""SELECT {_K}, {_BASIC} FROM panel
      QUALIFY MAX(CASE WHEN y > 0 THEN TrxDate END) OVER (PARTITION BY RouteCode, ItemCode)
        >= (SELECT MAX(TrxDate) FROM panel) - INTERVAL 1 MONTH""",
    "B5_clip_negative": sb.with_(sb.RAW, """agg AS (SELECT RouteCode, ItemCode,
        CAST(date_trunc('week', TrxDate) AS DATE) AS p, SUM(QuantityInPCs) AS q FROM raw GROUP BY ALL),
      span AS (SELECT RouteCode, ItemCode, MIN(p) AS a, MAX(p) AS b FROM agg GROUP BY ALL),
      cal AS (SELECT RouteCode, ItemCode, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS p FROM span)""")
    + """SELECT RouteCode, ItemCode, p AS TrxDate, greatest(COALESCE(q, 0), 0) AS TotalQuantity
      FROM cal LEFT JOIN agg USING (RouteCode, ItemCode, p)""",
    "B6_outlier_treatment": sb.with_(*PANEL_M, TRAIN_M, CLASSES, """qs AS (SELECT RouteCode, ItemCode,
        quantile_cont(CAST(y AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(y AS DOUBLE), 0.75) AS q3
        FROM train GROUP BY ALL),
      lim AS (SELECT qs.RouteCode, qs.ItemCode, greatest(q1 - (q3 - q1), 0) AS lo, q3 + (q3 - q1) AS hi
        FROM qs JOIN classes USING (RouteCode, ItemCode) WHERE class NOT IN ('intermittent', 'lumpy'))""")
    + f"""SELECT {_K}, {sb.rint('CASE WHEN hi IS NULL THEN y ELSE least(greatest(y, lo), hi) END', 6)} AS TotalQuantity
      FROM panel LEFT JOIN lim USING (RouteCode, ItemCode)""",
    "B7_time_based_split": sb.with_(*PANEL_M) + f"""SELECT {_K}, CASE WHEN TrxDate >= {M_TEST} THEN 'test'
      WHEN TrxDate >= {M_VAL} THEN 'val' ELSE 'train' END AS split FROM panel""",
    "C1_adi_cv2": sb.with_(*PANEL_M, "train AS (SELECT * FROM panel)", CLASSES)
    + f"SELECT RouteCode, ItemCode, {sb.rint('adi', 6)} AS adi, {sb.rint('cv2', 6)} AS cv2 FROM classes",
    "C2_classify_pair": sb.with_(*PANEL_W, "train AS (SELECT * FROM panel)", CLASSES)
    + "SELECT RouteCode, ItemCode, class FROM classes",
    "C3_classify_dataset": sb.with_(*PANEL_M, TRAIN_M, CLASSES)
    + f"SELECT RouteCode, ItemCode, {sb.rint('adi', 6)} AS adi, {sb.rint('cv2', 6)} AS cv2, class FROM classes",
    "C4_pair_explainability": _EXPL + f"""SELECT ex.*, CASE WHEN isinf(adi) THEN NULL ELSE {sb.rint('adi', 6)} END AS adi,
      {sb.rint('cv2', 6)} AS cv2, class FROM ex JOIN classes USING (RouteCode, ItemCode)""",
    "C5_avg_gap": _EXPL + "SELECT RouteCode, ItemCode, avg_gap_between_demand FROM ex",
    "C6_class_summary": sb.with_(*PANEL_M, TRAIN_M, CLASSES)
    + "SELECT class, COUNT(*) AS pairs FROM classes GROUP BY class",
    "D1_temporal_features": sb.with_(*PANEL_D) + _temporal_sql(),
    "D2_lag_features": sb.with_(*PANEL_D) + _select({f"lag_{n}": f"lag(y, {n}) {_W}" for n in (1, 7, 14, 21, 28)}),
    "D3_rolling_features": sb.with_(*PANEL_W) + _select({k: v for k, v in _ROLL.items() if "ratio" not in k}),
    "D4_rolling_nonzero_ratio": sb.with_(*PANEL_D) + _select({k: v for k, v in _ROLL.items() if "ratio" in k}),
    "D5_nonzero_mean_to_date": sb.with_(*PANEL_W, _NUMBERED)
    + _select({"nonzero_mean_to_date": _INTER["nonzero_mean_to_date"]}, "numbered"),
    "D6_inter_demand_interval": sb.with_(*PANEL_W, _NUMBERED)
    + _select({"inter_demand_interval": _INTER["inter_demand_interval"]}, "numbered"),
    "D7_last_nonzero_gap": sb.with_(*PANEL_M, _NUMBERED)
    + _select({"last_nonzero_gap": _INTER["last_nonzero_gap"]}, "numbered"),
    "D8_history_length": sb.with_(*PANEL_M)
    + f"SELECT {_K}, COUNT(y) OVER (PARTITION BY RouteCode, ItemCode) AS pair_history_len FROM panel",
    "D9_holiday_flags": _holiday_sql(),
    "D10_holiday_names": sb.with_(_HOLIDAYS) + "SELECT date, name FROM hol",
    "D11_event_flags": sb.with_(*PANEL_W) + f"""SELECT {_K},
      CASE WHEN TrxDate BETWEEN DATE '1999-03-01' AND DATE '1999-04-26' THEN 1 ELSE 0 END AS evt_spring_push,
      CASE WHEN TrxDate BETWEEN DATE '2000-11-27' AND DATE '2000-12-25' THEN 1 ELSE 0 END AS evt_year_end
      FROM panel""",
    "D12_target_encoding": sb.with_(*PANEL_M, TRAIN_M, """g AS (SELECT AVG(y) AS gm FROM train),
      te AS (SELECT RouteCode, ItemCode, (COUNT(y) * AVG(y) + 10 * gm) / (COUNT(y) + 10) AS te
        FROM train, g GROUP BY RouteCode, ItemCode, gm)""")
    + f"SELECT {_K}, {sb.rint('COALESCE(te, gm)', 6)} AS te_pair_mean FROM panel LEFT JOIN te USING (RouteCode, ItemCode), g",
    "D13_class_features": _class_features_sql(),
}
