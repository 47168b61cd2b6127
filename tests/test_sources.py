import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanflow.config import DASHBOARD
from vanflow.operators import supervision as sv
from vanflow.sources import imports as im
from vanflow.sources import stores as st
from vanflow.streaming import live

CUST = "TrxDate date, RouteCode string, ItemCode string, CategoryName string, TotalQuantity double, AvgUnitPrice double"


def test_csv_rows_with_bad_dates_are_dropped(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("TrxDate,RouteCode,TotalQuantity\n2024-01-02,1,3\nnot a date,1,4\n,1,5\n")
    schema = T.StructType.fromDDL("TrxDate date, RouteCode string, TotalQuantity double")
    out = im.load_csv(spark, str(path), schema, "TrxDate").collect()
    assert [(str(r.TrxDate), r.TotalQuantity) for r in out] == [("2024-01-02", 3.0)]


def test_codes_are_trimmed_and_returns_dropped(rows):
    df = rows([("2024-01-01", "1", " A ", "c", 2.0, 1.0), ("2024-01-01", "1", "B", "c", -2.0, 1.0),
               ("2024-01-01", "1", "C", "c", 0.0, 1.0)], CUST)
    assert [r.ItemCode for r in im.purchases_only(df).collect()] == ["A"]


def test_merge_replaces_equal_keys_null_safely(rows):
    old = rows([("2024-01-01", "1", "A", None, 1.0, 1.0), ("2024-01-02", "1", "A", None, 2.0, 1.0),
                ("2024-01-02", "1", "B", "c", 3.0, 1.0)], CUST)
    new = rows([("2024-01-02", "1", "A", None, 9.0, 5.0), ("2024-01-03", "1", "A", None, 4.0, 1.0)], CUST)
    out = {(str(r.TrxDate), r.ItemCode): r.TotalQuantity for r in im.incremental_merge(old, new).collect()}
    assert out == {("2024-01-01", "A"): 1.0, ("2024-01-02", "A"): 9.0, ("2024-01-02", "B"): 3.0,
                   ("2024-01-03", "A"): 4.0}


def test_merge_of_an_empty_batch_keeps_everything(rows):
    old = rows([("2024-01-01", "1", "A", None, 1.0, 1.0)], CUST)
    assert im.incremental_merge(old, old.filter("false")).count() == 1


def test_last_row_of_a_batch_wins(rows):
    old = rows([], CUST)
    new = rows([("2024-01-02", "1", "A", "c", 1.0, 1.0), ("2024-01-02", "1", "A", "c", 7.0, 1.0)], CUST)
    seq = new.withColumn("seq", F.col("TotalQuantity"))
    out = im.incremental_merge(old, seq, sequence="seq").collect()
    assert [r.TotalQuantity for r in out] == [7.0]


def test_merge_without_a_sequence_does_not_depend_on_row_order(rows):
    twice = [("2024-01-02", "1", "A", "c", 1.0, 3.0), ("2024-01-02", "1", "A", "c", 1.0, 2.0)]
    for data in (twice, twice[::-1]):
        assert [r.AvgUnitPrice for r in im.incremental_merge(rows([], CUST), rows(data, CUST)).collect()] == [3.0]


def test_last_row_to_arrive_wins_in_the_import_stream(spark, rows, tmp_path):
    path, store, cp = (str(tmp_path / x) for x in ("in", "store", "cp"))
    key = ("2024-01-02", "1", "A", "c")
    for first, last in ((9.0, 2.0), (8.0, 5.0)):  # larger values come first, in each file and in the older file
        batch = rows([(*key, first, 1.0), (*key, last, 1.0), ("2024-01-03", "1", "B", "c", last, 1.0)], CUST)
        batch.coalesce(1).write.mode("append").parquet(path)
    schema = batch.schema

    def merged():
        live.import_stream(live.read_files(spark, path, schema, arrival=True), store, cp)
        return {r.ItemCode: r.TotalQuantity for r in spark.read.parquet(store).collect()}

    assert merged() == {"A": 5.0, "B": 5.0}
    rows([(*key, 1.0, 1.0)], CUST).write.mode("append").parquet(path)
    assert merged() == {"A": 1.0, "B": 5.0}
    assert "_arrival" not in spark.read.parquet(store).columns


def test_validation_names_what_is_missing(rows):
    df = rows([("2024-01-01", "1", "A", "c", 2.0, 1.0)], CUST)
    report = im.validate_input(df, ["RouteCode", "Depot"], "RouteCode", "TrxDate", ["AvgUnitPrice"])
    got = {r["check"]: (r["passed"], r["detail"]) for r in report.collect()}
    assert got["required_columns"] == (False, "Depot")
    assert got["numeric_target"][0] is False
    assert got["causal_columns"][0] and got["parseable_dates"][0]


def test_friday_needs_no_journey(rows):
    plan = rows([("2024-01-01", "1", "c")], "JourneyDate date, RouteCode string, CustomerCode string")
    cust = rows([("2024-01-01", "1", "A", "c", 2.0, 1.0)], CUST)
    for day, stale in (("2024-01-05", False), ("2024-01-04", True)):
        row = im.freshness(plan, cust, cust, cust, day, "2024-01-02", DASHBOARD.rest_weekday).first()
        assert row.journey_stale is stale and row.sales_need_full_refresh


def test_only_touched_slices_are_replaced(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    schema = "TrxDate date, RouteCode string, RecommendedQuantity int"
    st.replace_slices(rows([("2024-01-01", "1", 1), ("2024-01-01", "2", 2)], schema), path, ["TrxDate", "RouteCode"])
    st.replace_slices(rows([("2024-01-01", "2", 5)], schema), path, ["TrxDate", "RouteCode"])
    out = st.read_store(spark, path, T.StructType.fromDDL(schema)).collect()
    assert sorted((r.RouteCode, r.RecommendedQuantity) for r in out) == [("1", 1), ("2", 5)]


def _items(rows):
    data = [("s", "1", "2024-01-01", "c1", "n", "A", "a", 4, 1, 4, True, True, "MUST_STOCK", 90.0, 1, 2.0, 3.0, 9, True, 1),
            ("s", "1", "2024-01-01", "c2", "n", "A", "a", 4, 0, 0, False, False, "CONSIDER", 40.0, 1, 2.0, 3.0, 9, False, 0)]
    return rows(data, "session_id string, route_code string, date date, customer_code string, customer_name string, "
                "item_code string, item_name string, recommended_qty int, adjustment int, actual_qty int, was_sold boolean, "
                "was_edited boolean, tier string, priority_score double, days_since_last_purchase int, purchase_cycle_days double, "
                "frequency_percent double, van_inventory_qty int, visited boolean, visit_sequence int")


def test_session_documents_survive_storage_and_bad_files_do_not(spark, rows, tmp_path):
    items = _items(rows)
    nested = st.nest_sessions(sv.nest_customers(items), sv.customer_scores(items))
    path = str(tmp_path / "sessions")
    st.write_sessions(nested, path)
    bad = tmp_path / "sessions" / "p_route=9" / "p_date=2024-01-09"
    bad.mkdir(parents=True)
    (bad / "part-0.json").write_text("{broken\n" + json.dumps({"session_id": 3, "customers": 7}) + "\n")
    back = st.read_sessions(spark, path, nested.schema).filter("route_code = '1'")
    flat = {r.customer_code: (r.visited, r.item_code, r.actual_qty) for r in st.unnest_sessions(back).collect()}
    assert flat == {"c1": (True, "A", 4), "c2": (False, "", 0)}


def test_a_stored_line_holds_one_customer(spark, rows, tmp_path):
    """A session's document grows with its route: it is put together on reading."""
    items = _items(rows)
    records = st.session_records(sv.nest_customers(items), sv.customer_scores(items))
    nested = st.nest_records(records)
    for name, frame in (("records", records), ("nested", nested)):
        path = str(tmp_path / name)
        st.write_sessions(frame, path)
        assert spark.read.text(path).count() == 2
        back = st.read_sessions(spark, path, nested.schema)
        assert back.schema.simpleString() == nested.schema.simpleString()
        assert back.first().asDict(True) == nested.first().asDict(True)


def test_rebuild_does_not_count_the_adjustment_twice(rows):
    items = _items(rows)
    scores = sv.customer_scores(items)
    routes = st.session_route_rows(sv.session_summary(scores), sv.route_scores(scores), F.lit("2024-01-01").cast("timestamp"))
    whole = st.rebuild_sessions(routes, st.session_customer_rows(scores), st.session_item_rows(items))
    row = st.flat_items(whole.withColumnRenamed("supervision_date", "date")).first()
    assert (row.recommended_qty, row.adjustment) == (4, 1)


def test_merge_keeps_and_replaces_rows_without_a_date(rows):
    schema = "TrxDate date, Code string, TotalQuantity double"
    held = rows([("2024-01-01", "a", 1.0), (None, "b", 2.0), (None, "c", 3.0)], schema)
    new = rows([("2024-01-02", "a", 4.0), (None, "c", 5.0)], schema)
    merged = im.incremental_merge(held, new, measures=["TotalQuantity"])
    assert sorted((str(r.TrxDate), r.Code, r.TotalQuantity) for r in merged.collect()) == [
        ("2024-01-01", "a", 1.0), ("2024-01-02", "a", 4.0), ("None", "b", 2.0), ("None", "c", 5.0)
    ]
    undated = im.incremental_merge(held, new.filter("TrxDate is null"), measures=["TotalQuantity"])
    assert undated.count() == 3


def test_a_second_stop_does_not_multiply_items(rows):
    items = rows(
        [("s", "r", "2024-01-01", "c1", "i1", 5, 0, 0, False, False, False, None)],
        "session_id string, route_code string, date date, customer_code string, item_code string, recommended_qty int, "
        "adjustment int, actual_qty int, was_sold boolean, was_edited boolean, visited boolean, visit_sequence int",
    )
    visits = rows([("s", "c1", 1), ("s", "c1", 3)], "session_id string, customer_code string, visit_order int")
    sales = rows([("r", "2024-01-01", "c1", "i1", 4.0)], "RouteCode string, TrxDate date, CustomerCode string, ItemCode string, TotalQuantity double")
    got = sv.apply_visits(items, visits, sales).collect()
    assert [(r.actual_qty, r.visit_sequence) for r in got] == [(4, 1)]


def test_session_records_are_stored_by_customer_and_nested_on_request(spark, rows, tmp_path):
    items = _items(rows)
    held = st.session_records(sv.nest_customers(items), sv.customer_scores(items))
    path = str(tmp_path / "records")
    st.write_session_records(held, path)
    st.write_session_records(held.withColumns({"route_code": F.lit("2"), "session_id": F.lit("t")}), path)
    one = st.read_session_records(spark, path, route="1", date="2024-01-01")
    assert {(r.session_id, r.customer_code) for r in one.collect()} == {("s", "c1"), ("s", "c2")}
    assert st.read_session_records(spark, path).count() == 4
    document = st.nest_records(one).first()
    assert document.customers["c1"]["items"][0]["item_code"] == "A" and not document.customers["c2"]["visited"]
    again = st.nest_sessions(sv.nest_customers(items), sv.customer_scores(items)).first()
    assert document == again
