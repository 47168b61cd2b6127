"""Stored recommendations by customer, and number cells of prompts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from vanflow.catalog import loop
from vanflow.catalog import scoring as sc
from vanflow.catalog import supervise as sp
from vanflow.catalog import texts
from vanflow.functions.text import prompt_safe
from vanflow.operators import adoption as ad
from vanflow.operators import feedback as fb
from vanflow.operators import prompts as pt
from vanflow.operators import scoring as sg
from vanflow.operators import supervision as sv
from vanflow.session import rows_in_place
from vanflow.sources import fixtures as fx
from vanflow.sources import stores as st


def _tables(spark, folder):
    when = dt.datetime(2001, 6, 1)
    rows = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"C{k}", 0) for k in range(1, 9)], "c_custkey long, c_name string, c_nationkey int"),
        "part": ([(1, "Brand#1", "T"), (2, "Brand#2", "T")], "p_partkey long, p_brand string, p_type string"),
        "orders": ([(k, k, "O", when) for k in range(1, 9)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "lineitem": ([(k, p, 4.0, 40.0, 0.02, "N") for k in range(1, 9) for p in (1, 2)],
                     "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_small_pairs_are_not_sent_to_the_plan(spark, tmp_path):
    recs = fx.stored_recommendations(spark, _tables(spark, tmp_path))
    planned = sum(
        (k * 7 + (dt.date(2001, 7, 2) + dt.timedelta(d) - dt.date(1995, 1, 1)).days) % 10 < 3
        for k in range(1, 9) for d in range(fx.PLAN_DAYS))
    assert recs.count() == 2 * planned
    plan = recs.select("TrxDate", "CustomerCode", "ItemCode", "Tier")._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "ShuffledHashJoin" in join  # a broadcast of the pairs leaves every row to the tasks of the customer file


def test_number_cells_equal_the_formatter(spark):
    values = [None, 0.0, -0.0, -0.04, 0.04, 0.05, 0.25, 2.5, 7.0, 99.95, -3.25, 1234567.875, 1e17, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        scale = float(10**digits)
        old = F.format_string(f"%9s", F.format_string(f"%.{digits}f", F.rint(F.col("v") * scale) / scale))
        new = pt.right(pt.rounded_text(F.col("v"), digits), 9)
        assert df.filter(~new.eqNullSafe(old)).count() == 0
    texts = spark.createDataFrame([(None,), ("7",), ("1234567890",)], "t string")
    assert texts.filter(~pt.right(F.col("t"), 4).eqNullSafe(F.format_string("%4s", F.col("t")))).count() == 0


def _moved_by(spark, sf, df):
    """What the exchanges of a plan go by, where frames dealt by customer are run in place."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with rows_in_place(spark, fx._tasks(spark, sf)):
            plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line]


def _same_rows(a, b):
    assert a.columns == b.columns and a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_attribution_of_dealt_sides_moves_no_line(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    out = fb.build_attribution(loop.recs(spark, sf, fx.OF_CUSTOMER), loop.sessions(spark, sf, fx.OF_CUSTOMER), dealt=True)
    assert not [by for by in _moved_by(spark, sf, out) if "route_code#" in by]
    plain = fb.build_attribution(loop.recs(spark, sf), loop.sessions(spark, sf))
    _same_rows(fx.cut_in_place(spark, sf, out), plain)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_adoption_of_dealt_sides_moves_sold_lines_once(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    out = ad.merge_adoption(loop.recs(spark, sf, fx.OF_CUSTOMER), fx.visit_sales(spark, sf, fx.OF_CUSTOMER), dealt=True)
    assert not [by for by in _moved_by(spark, sf, out) if "route_code#" in by or "trx_date#" in by]
    _same_rows(fx.cut_in_place(spark, sf, out), ad.merge_adoption(loop.recs(spark, sf), fx.visit_sales(spark, sf)))


def test_visits_are_applied_where_the_items_lie(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    by = fx.OF_CUSTOMER
    out = sv.apply_visits(sp.opened(spark, sf, by), sp.visits(spark, sf, by), fx.visit_sales(spark, sf, by))
    assert not [e for e in _moved_by(spark, sf, out) if "item_code#" in e.lower() or "route_code#" in e]
    plain = sv.apply_visits(sp.opened(spark, sf), sp.visits(spark, sf), fx.visit_sales(spark, sf))
    _same_rows(fx.cut_in_place(spark, sf, out), plain)


def test_few_unsold_lines_are_sent_to_the_items(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    plan = sp._redistributed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sessions_are_read_once_for_all_answer_layouts(spark, tmp_path):
    plan = texts._all_parsed(spark, _tables(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "customer.parquet" not in plan and "ShuffledHashJoin" not in plan  # only the stored base is read


def test_customer_prompts_are_made_where_the_lines_lie(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    parts = lambda by: (
        sp.scores(spark, sf), pt.customer_history(texts.recs(spark, sf, by)), pt.current_visit(loop.sessions(spark, sf, by)))
    moved = _moved_by(spark, sf, pt.customer_prompts(*parts(fx.OF_CUSTOMER)))
    assert not [e for e in moved if "date#" in e.lower() or "session_id#" in e]
    _same_rows(texts._customer_prompts(spark, sf), pt.customer_prompts(*parts(fx.OF_ROUTE)))


def test_records_are_rebuilt_where_the_items_lie(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    parts = lambda by: (
        st.session_customer_rows(sp.scores(spark, sf)), st.session_item_rows(sp.items(spark, sf, by)))
    out = st.rebuild_records(*parts(fx.OF_CUSTOMER))
    assert not [e for e in _moved_by(spark, sf, out) if "session_id#" in e]
    with rows_in_place(spark, fx._tasks(spark, sf)):
        rows = out.localCheckpoint()
    _same_rows(rows, st.rebuild_records(*parts(fx.OF_ROUTE)))


def test_name_cells_equal_the_formatter(spark):
    names = spark.createDataFrame([(None,), ("",), ("seven",), ("é—ü", ), ("exactly 9",), ("more than nine",)], "t string")
    old = F.format_string("%-9s", F.col("t"))
    assert names.filter(~pt.left(F.col("t"), 9).eqNullSafe(old)).count() == 0
    plan = names.select(pt.name_cell("t", 9))._jdf.queryExecution().executedPlan().toString()
    assert "format_string" not in plan and "translate" not in plan
    broken = spark.createDataFrame([('5" Chef\'s\nbest\r\n',)], "t string")
    assert broken.select(prompt_safe(F.col("t"))).first()[0] == "5inch Chefs best  "


def test_sales_are_grouped_where_their_customer_lies(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    sales = fx.customer_data(spark, sf)
    assert sales.count() == 16
    assert not [by for by in _moved_by(spark, sf, sales) if "TrxDate" in by]


def test_scores_are_made_where_a_customer_lies(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path)
    moved, cut = [], fx.cut_dealt
    monkeypatch.setattr(fx, "cut_dealt", lambda df, tasks: moved.extend(_moved_by(spark, sf, df)) or cut(df, tasks))
    got = sc.scored(spark, sf)
    assert moved and not [by for by in moved if "ItemCode" in by or "TrxDate" in by]
    _same_rows(got, sg.score_pairs(sc.hist(spark, sf), sc.calibrated(spark, sf), fx.TARGET, sc.CLAMPS))


def test_days_written_again_are_read_from_the_store(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path)
    plans, write = [], st.write_session_records

    def watched(records, *args, **kw):
        plans.append(records._jdf.queryExecution().executedPlan().toString())
        write(records, *args, **kw)

    monkeypatch.setattr(st, "write_session_records", watched)
    got = sp._stored_records(spark, sf)
    assert len(plans) == 2 and "Join" in plans[0] and "Join" not in plans[1] and "Exchange" not in plans[1]
    once = st.session_records(sv.nest_customers(sp.items(spark, sf)), sp.scores(spark, sf))
    more = F.when(F.dayofmonth("date") > 15, 1).otherwise(0)
    _same_rows(got.select("session_id", "customer_code", "total_actual", "n_items"), once.select(
        "session_id", "customer_code", (F.col("total_actual") + more).alias("total_actual"), F.size("items").alias("n_items")))
