"""Sales, journey-plan and forecast reads, and the incremental merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanflow.functions.numeric import sql_round
from vanflow.functions.text import clean_code
from vanflow.sources import slices

RAW_SALES = T.StructType(
    [
        T.StructField("TrxDate", T.DateType()),
        T.StructField("RouteCode", T.StringType()),
        T.StructField("CustomerCode", T.StringType()),
        T.StructField("CustomerName", T.StringType()),
        T.StructField("ItemCode", T.StringType()),
        T.StructField("ItemName", T.StringType()),
        T.StructField("CategoryCode", T.StringType()),
        T.StructField("CategoryName", T.StringType()),
        T.StructField("WarehouseCode", T.StringType()),
        T.StructField("WarehouseName", T.StringType()),
        T.StructField("ItemType", T.StringType()),
        T.StructField("TrxType", T.StringType()),
        T.StructField("QuantityInPCs", T.DoubleType()),
        T.StructField("UnitPrice", T.DoubleType()),
    ]
)

CUSTOMER_KEYS = (
    "TrxDate", "RouteCode", "CustomerCode", "CustomerName",
    "ItemCode", "ItemName", "CategoryCode", "CategoryName",
)
SALES_KEYS = (
    "TrxDate", "WarehouseCode", "WarehouseName", "RouteCode",
    "ItemCode", "ItemName", "CategoryName",
)
MEASURES = ("TotalQuantity", "AvgUnitPrice")

# forecast result table column -> analytic column
FORECAST_COLUMNS = {
    "trx_date": "TrxDate",
    "route_code": "RouteCode",
    "item_code": "ItemCode",
    "item_name": "ItemName",
    "data_split": "DataSplit",
    "demand_class": "DemandClass",
    "model_used": "ModelUsed",
    "predicted": "Predicted",
    "p_demand": "DemandProbability",
    "qty_if_demand": "QtyIfDemand",
    "actual_qty": "ActualQty",
    "lower_bound": "LowerBound",
    "upper_bound": "UpperBound",
    "adi": "Adi",
    "cv2": "Cv2",
    "nonzero_ratio": "NonzeroRatio",
    "mean_qty": "MeanQty",
    "avg_gap_days": "AvgGapDays",
}


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str,
    bounds: tuple[str, str], partitions: int, **options: str,
) -> DataFrame:
    """A partitioned JDBC scan; filters and columns are pushed into the source."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .option("partitionColumn", partition_column)
        .option("lowerBound", bounds[0])
        .option("upperBound", bounds[1])
        .option("numPartitions", str(partitions))
        .load()
    )


def invoiced(raw: DataFrame) -> DataFrame:
    """Sales invoices of ordered items only."""
    return raw.filter((F.col("ItemType") == "OrderItem") & (F.col("TrxType") == "SalesInvoice"))


def in_scope(
    df: DataFrame,
    date_col: str,
    routes: Sequence[str] | None = None,
    since: str | None = None,
    today: str | None = None,
    lookback_days: int | None = None,
) -> DataFrame:
    """Route list plus either the incremental or the look-back date window."""
    if routes is not None:
        df = df.filter(F.col("RouteCode").isin(list(routes)))
    if since is not None:
        return df.filter(F.col(date_col) > F.lit(since).cast("date"))
    if today is not None and lookback_days is not None:
        return df.filter(
            F.col(date_col) >= F.date_sub(F.lit(today).cast("date"), lookback_days)
        )
    return df


def positive_qty(c: str = "QuantityInPCs"):
    return F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))


def _sales_at(raw: DataFrame, keys: Sequence[str], **scope) -> DataFrame:
    sales = in_scope(invoiced(raw), "TrxDate", **scope)
    return sales.groupBy(*keys).agg(
        F.sum(positive_qty()).alias("TotalQuantity"),
        sql_round(F.avg("UnitPrice"), 2).alias("AvgUnitPrice"),
    )


def customer_data(raw: DataFrame, **scope) -> DataFrame:
    """Quantity and mean price per day, route, customer and item."""
    return _sales_at(raw, CUSTOMER_KEYS, **scope)


def sales_recent(raw: DataFrame, **scope) -> DataFrame:
    """Quantity and mean price per day, warehouse, route and item."""
    return _sales_at(raw, SALES_KEYS, **scope)


def journey_plan(
    plan: DataFrame,
    routes: Sequence[str] | None = None,
    since: str | None = None,
    today: str | None = None,
    window_days: int | None = None,
) -> DataFrame:
    """Planned visits after a date, or within a window either side of today."""
    if since is None and today is not None and window_days is not None:
        day = F.lit(today).cast("date")
        plan = plan.filter(
            F.col("JourneyDate").between(
                F.date_sub(day, window_days), F.date_add(day, window_days)
            )
        )
    return in_scope(plan, "JourneyDate", routes=routes, since=since)


def demand_forecast(results: DataFrame, **scope) -> DataFrame:
    """Forecast results under their analytic column names."""
    renamed = results.select(*[F.col(a).alias(b) for a, b in FORECAST_COLUMNS.items()])
    return in_scope(renamed, "TrxDate", **scope)


def incremental_merge(
    existing: DataFrame,
    incoming: DataFrame,
    date_col: str = "TrxDate",
    measures: Sequence[str] = MEASURES,
    sequence: str | Column | None = None,
) -> DataFrame:
    """Append newer rows; on equal keys the latest row wins.

    Keys are all columns but the measures, compared null-safely. Existing rows
    older than the first incoming date cannot collide, so only the overlap is
    shuffled for the anti-join; rows without a date are compared and kept like
    any other. ``sequence``, such as the column of `with_arrival`, orders rows
    of one key inside a batch; of rows with equal sequences, or without one,
    that with the larger measures wins. The choice is an aggregate, so most
    repeats are gone before the shuffle.
    """
    keys = [c for c in existing.columns if c not in measures]
    values = [c for c in existing.columns if c in measures]
    order = [] if sequence is None else [(F.col(sequence) if isinstance(sequence, str) else sequence).alias("_sequence")]
    if order or values:
        newest = F.max(F.struct(*order, *values)).alias("_newest")
        latest = incoming.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in values])
    else:
        latest = incoming.dropDuplicates(keys)
    latest = latest.select(*existing.columns)
    first = incoming.agg(F.min(date_col)).scalar()
    undated = F.col(date_col).isNull()
    untouched = existing.filter(~undated & (first.isNull() | (F.col(date_col) < first)))
    overlap = existing.filter(undated | (F.col(date_col) >= first))
    new_keys = latest.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    survivors = overlap.join(new_keys, same, "left_anti")
    return untouched.unionByName(survivors).unionByName(latest)


ARRIVAL = "_arrival"


def with_arrival(files: DataFrame) -> DataFrame:
    """Adds each row's place in the order of arrival to a frame or stream read from Parquet files: file time, file, row."""
    m = F.col("_metadata")
    place = F.struct(m["file_modification_time"].alias("time"), m["file_path"].alias("file"), m["row_index"].alias("row"))
    return files.withColumn(ARRIVAL, place)


def newer_than_watermark(source: DataFrame, existing: DataFrame, date_col: str) -> DataFrame:
    """Source rows after the newest date already held."""
    mark = existing.agg(F.max(date_col)).scalar()
    return source.filter(mark.isNull() | (F.col(date_col) > mark))


def refresh_all(datasets: dict[str, tuple[DataFrame, str]], base: str) -> dict[str, str]:
    """Replace every registered dataset whole, in slices by its date column's month; read back with `slices.read`."""
    written = {}
    for name, (df, date_col) in datasets.items():
        path = f"{base}/{name}"
        slices.replace(df.withColumn("_month", F.date_format(date_col, "yyyy-MM")), path, ["_month"], whole=True)
        written[name] = path
    return written


def dataset_status(datasets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and date span per dataset, from one narrow scan each."""
    out = None
    for name, (df, date_col) in datasets.items():
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(date_col).alias("first_date"),
            F.max(date_col).alias("last_date"),
        ).select(F.lit(name).alias("dataset"), "rows", "first_date", "last_date")
        out = row if out is None else out.unionByName(row)
    return out


def status_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum("rows").alias("total_rows"),
        F.max("last_date").alias("newest_date"),
    )


def parse_dates(df: DataFrame, date_col: str, fmt: str | None = None) -> DataFrame:
    """Parse a text date column; rows whose date cannot be read are dropped."""
    parsed = F.try_to_date(F.col(date_col).cast("string"), fmt) if fmt else F.try_to_date(
        F.col(date_col).cast("string")
    )
    return df.withColumn(date_col, parsed).dropna(subset=[date_col])


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType, date_col: str
) -> DataFrame:
    """CSV with an explicit schema; the date column arrives as text."""
    text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == date_col else f.dataType)
            for f in schema.fields
        ]
    )
    return parse_dates(spark.read.csv(path, header=True, schema=text), date_col)


def normalise(df: DataFrame, date_cols: Sequence[str] = ("TrxDate", "JourneyDate")) -> DataFrame:
    """Trim code columns to strings and parse dates; bad dates become null."""
    for c in ("RouteCode", "CustomerCode", "ItemCode"):
        if c in df.columns:
            df = df.withColumn(c, clean_code(c))
    types = dict(df.dtypes)
    for c in date_cols:
        if c in df.columns and types[c] != "date":
            df = df.withColumn(c, F.try_to_date(F.col(c).cast("string")))
    return df


def purchases_only(customer: DataFrame) -> DataFrame:
    """Customer history net of returns and zero rows."""
    return normalise(customer).filter(F.col("TotalQuantity") > 0)


def confident_demand(demand: DataFrame, threshold: float) -> DataFrame:
    return normalise(demand).filter(F.col("DemandProbability") >= threshold)


def validate_input(
    df: DataFrame,
    required: Sequence[str],
    target_col: str,
    date_col: str,
    causal_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per check with its verdict; schema checks need no scan."""
    types = dict(df.dtypes)
    missing = [c for c in required if c not in types]
    numeric = types.get(target_col, "").split("(")[0] in {
        "double", "float", "int", "bigint", "smallint", "tinyint", "decimal",
    }
    missing_causal = [c for c in causal_cols if c not in types]
    checks = [
        ("required_columns", not missing, ",".join(missing)),
        ("numeric_target", numeric, types.get(target_col, "absent")),
        ("causal_columns", not missing_causal, ",".join(missing_causal)),
    ]
    static = [
        F.struct(F.lit(n).alias("check"), F.lit(ok).alias("passed"), F.lit(d).alias("detail"))
        for n, ok, d in checks
    ]
    if date_col in types:
        readable = F.count(F.try_to_date(F.col(date_col).cast("string")))
    else:
        readable = F.lit(0).cast("bigint")
    dated = df.agg(readable.alias("good"), F.count(F.lit(1)).alias("n"))
    dates = F.struct(
        F.lit("parseable_dates").alias("check"),
        ((F.col("good") > 0) | (F.col("n") == 0)).alias("passed"),
        F.concat_ws("/", F.col("good").cast("string"), F.col("n").cast("string")).alias("detail"),
    )
    return dated.select(F.inline(F.array(*static, dates)))


def require_valid(report: DataFrame) -> None:
    """Raise with the failing checks of a validation report (four rows at most)."""
    failed = report.filter(~F.col("passed")).collect()
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['detail']}" for r in failed))


def freshness(
    journey: DataFrame, customer: DataFrame, demand: DataFrame, sales: DataFrame,
    target: str, today: str, rest_weekday: int,
) -> DataFrame:
    """Newest date per dataset with the staleness verdicts."""
    day = F.lit(target).cast("date")
    row = (
        journey.agg(F.max("JourneyDate").alias("journey_max_date"))
        .select(
            "journey_max_date",
            customer.agg(F.max("TrxDate")).scalar().alias("customer_max_date"),
            demand.agg(F.max("TrxDate")).scalar().alias("demand_max_date"),
            sales.agg(F.max("TrxDate")).scalar().alias("sales_max_date"),
        )
    )
    resting = F.weekday(day) == rest_weekday
    late = F.col("journey_max_date").isNull() | (F.col("journey_max_date") < day)
    stale = F.col("sales_max_date").isNull() | (
        F.col("sales_max_date") < F.lit(today).cast("date")
    )
    return row.withColumn("journey_stale", ~resting & late).withColumn(
        "sales_need_full_refresh", stale
    )


def require_fresh(report: DataFrame) -> None:
    row = report.first()
    if row["journey_stale"]:
        raise RuntimeError(f"journey plan ends {row['journey_max_date']}, before the target date")
