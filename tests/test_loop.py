import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanflow.config import CLAMPS, SUPERVISION
from vanflow.operators import feedback as fb
from vanflow.operators import prompts as pt
from vanflow.operators import supervision as sv
from vanflow.streaming import live

REC = ("RouteCode string, TrxDate date, CustomerCode string, ItemCode string, RecommendedQuantity int, "
       "Source string, Confidence double")
SES = ("route_code string, date date, customer_code string, item_code string, session_id string, "
       "visited boolean, actual_qty int, was_sold boolean")
PREV = "route string, source string, multiplier double, confidence double, n int"


def test_attribution_trims_codes_and_drops_no_shows(rows):
    recs = rows([("1 ", "2024-01-01", " a", "X", 4, "history", 0.5), ("1", "2024-01-01", "b", "X", 4, "peer", 0.5),
                 ("1", "2024-01-01", "a", "Y", 2, "peer", 0.5)], REC)
    ses = rows([("1", "2024-01-01", "a", "X ", "s", True, 3, True), ("1", "2024-01-01", "b", "", "s", False, 0, False)], SES)
    out = {r.item_code: (r.was_bought, r.qty_accuracy, r.session_id) for r in fb.build_attribution(recs, ses).collect()}
    assert out == {"X": (True, 0.75, "s"), "Y": (False, 0.0, "")}


def _attribution(spark, rates):
    data = []
    for route, sessions in rates.items():
        for i, rejected in enumerate(sessions):
            data += [(route, f"s{i}", j >= rejected, "history", 0.5) for j in range(10)]
    return spark.createDataFrame(data, "route_code string, session_id string, was_bought boolean, source string, qty_accuracy double")


def test_odd_session_is_dropped_only_with_enough_sessions(spark):
    att = _attribution(spark, {"1": [1] * 12 + [10], "2": [0, 10]})
    left = fb.drop_adversarial_sessions(att, CLAMPS).select("route_code", "session_id").distinct().collect()
    kept = {(r.route_code, r.session_id) for r in left}
    assert ("1", "s12") not in kept and ("2", "s1") in kept and len(kept) == 14


def test_cold_start_carries_previous_multipliers(spark):
    att = _attribution(spark, {"1": [1]}).filter("false")
    previous = spark.createDataFrame([("7", "peer", 1.2, 0.4, 9)], PREV)
    out = fb.smoothed_multipliers(fb.shrunk_multipliers(att, CLAMPS), previous, CLAMPS).collect()
    assert [(r.route, r.multiplier, r.confidence, r.n) for r in out] == [("7", 1.2, 0.4, 9)]


def test_multiplier_by_hand(spark):
    att = _attribution(spark, {"1": [2], "2": [6]})
    raw = {r.route: r.raw_multiplier for r in fb.shrunk_multipliers(att, CLAMPS).collect()}
    k = max(1, 10 / 4)
    assert raw["1"] == pytest.approx((10 * 0.8 + k * 0.6) / (10 + k) / 0.6)
    previous = spark.createDataFrame([("1", "history", 0.9, 0.1, 1)], PREV)
    out = {r.route: r for r in fb.smoothed_multipliers(fb.shrunk_multipliers(att, CLAMPS), previous, CLAMPS).collect()}
    assert out["1"].multiplier == pytest.approx(round(0.3 * raw["1"] + 0.7 * 0.9, 4))


@pytest.mark.parametrize("actual,rec,want", [
    (0, 0, 100.0), (1, 0, 0.0), (0, 5, 0.0), (3, 4, 100.0), (6, 5, 100.0), (1, 4, 33.3), (8, 5, 50.0), (10, 5, 0.0), (11, 5, 0.0)])
def test_item_accuracy(spark, actual, rec, want):
    assert spark.range(1).select(sv.item_accuracy(F.lit(actual), F.lit(rec))).first()[0] == want


def _session(rng, session, items=3, customers=9):
    data = []
    order = rng.sample(range(1, customers + 1), customers)
    for i in range(items):
        for c in range(customers):
            if rng.random() < 0.8:
                seq = order[c] if order[c] <= 6 else 0
                data.append((session, "1", "2024-01-01", f"c{c}", f"i{i}", rng.randint(1, 9), 0,
                             rng.randint(0, 9) if seq else 0, rng.choice(SUPERVISION.tier_order),
                             float(rng.randint(1, 4)), seq > 0, seq))
    return data


ITEMS = ("session_id string, route_code string, date date, customer_code string, item_code string, recommended_qty int, "
         "adjustment int, actual_qty int, tier string, priority_score double, visited boolean, visit_sequence int")


def _replayed(data):
    """The whole session replayed visit by visit."""
    lines = {(d[3], d[4]): {"rec": d[5], "act": d[7], "tier": d[8], "score": d[9], "seq": d[11], "adj": 0, "unsold": 0} for d in data}
    done = set()
    for seq in sorted({d[11] for d in data if d[11]}):
        customer = next(d[3] for d in data if d[11] == seq)
        done.add(customer)
        for (c, item), line in lines.items():
            if c != customer:
                continue
            left = line["unsold"] = max(0, line["rec"] + line["adj"] - line["act"])
            waiting = sorted(((k, v) for k, v in lines.items() if k[1] == item and k[0] not in done),
                             key=lambda kv: (SUPERVISION.tier_order.index(kv[1]["tier"]), -kv[1]["score"], kv[0][0]))
            for _, other in waiting[:5]:
                if left <= 0:
                    break
                give = min(left, max(1, int(other["rec"] * 0.5)))
                other["adj"] += give
                left -= give
    return {k: (v["adj"], v["unsold"]) for k, v in lines.items()}


def test_replay_and_stream_match_a_visit_by_visit_loop(spark, rows, tmp_path):
    rng = random.Random(7)
    sessions = {s: _session(rng, s) for s in ("s1", "s2")}
    want = {(s, *k): v for s, data in sessions.items() for k, v in _replayed(data).items()}
    items = rows([d for data in sessions.values() for d in data], ITEMS)
    got = {(r.session_id, r.customer_code, r.item_code): (r.adjustment, r.unsold) for r in sv.replay_sessions(items).collect()}
    assert got == want

    plan = items.select("session_id", "item_code", F.lit("plan").alias("kind"), "customer_code",
                        F.col("recommended_qty").alias("quantity"), "tier", "priority_score", F.lit(0).alias("visit_sequence"),
                        F.timestamp_millis(F.lit(10**12)).alias("ts"))
    visit = items.filter("visited").select("session_id", "item_code", F.lit("visit").alias("kind"), "customer_code",
                                           F.col("actual_qty").alias("quantity"), "tier", "priority_score", "visit_sequence",
                                           F.timestamp_millis(F.lit(10**12) + F.col("visit_sequence")).alias("ts"))
    first, rest = visit.filter("visit_sequence <= 3"), visit.filter("visit_sequence > 3")
    for label, parts in (("planned", (plan, first, rest)), ("early", (first, plan, rest))):
        path, out, cp = (str(tmp_path / label / x) for x in ("in", "out", "cp"))
        for part in parts:
            part.write.mode("append").parquet(path)
            stream = live.live_session_state(live.read_files(spark, path, T.StructType.fromDDL(live.SESSION_EVENT)))
            live.drain(stream, out, cp)
        final = live.latest_state(spark, out, stream.schema, ["session_id", "item_code", "customer_code"])
        assert {(r.session_id, r.customer_code, r.item_code): (r.adjustment, r.unsold) for r in final.collect()} == want, label


def test_session_state_ends_after_the_watermark(spark, rows, tmp_path):
    schema = live.SESSION_EVENT.replace("ts timestamp", "day int")
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def step(*events):
        timed = spark.createDataFrame(list(events), schema).withColumn("ts", F.timestamp_millis(F.col("day").cast("long") * 86_400_000))
        timed.drop("day").write.mode("append").parquet(path)
        stream = live.live_session_state(live.read_files(spark, path, T.StructType.fromDDL(live.SESSION_EVENT)))
        return live.drain(stream, out, cp)["stateOperators"][0]["numRowsTotal"]

    plan = [("s1", "i", "plan", f"c{n}", 4, "must", float(n), 0, 1) for n in range(9)]
    assert step(*plan) == 1
    assert step(("s1", "i", "visit", "c0", 4, "must", 0.0, 1, 1)) == 1
    emitted = spark.read.parquet(out).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in emitted if r["count"]] == [9, 1]  # a visit that sells all changes its own line only
    assert step(("s2", "i", "plan", "c0", 4, "must", 0.0, 0, 9)) == 1  # the first session has ended, the second is open
    assert step(("s1", "i", "visit", "c1", 0, "must", 0.0, 2, 1)) == 1  # older than the watermark: dropped


def test_redistribution_never_exceeds_what_was_unsold(rows):
    rng = random.Random(2)
    items = rows([d[:10] + (False, 0) for d in _session(rng, "s1")], ITEMS).withColumn("item_name", F.col("item_code"))
    unsold = items.filter("customer_code = 'c0'").select("session_id", "item_code", F.col("customer_code").alias("from_customer"),
                                                         F.lit(7).alias("unsold"))
    out = sv.redistribute(items, unsold).groupBy("item_code").agg(F.sum("quantity").alias("q"), F.count("*").alias("n")).collect()
    assert out and all(r.q <= 7 and r.n <= 5 for r in out)


def test_replay_item_without_visits_changes_nothing():
    rec = np.array([3, 4])
    adj, unsold = sv.replay_item(rec, np.zeros(2, dtype=np.int64), rec, np.full(2, sv.NOT_VISITED))
    assert adj.tolist() == [0, 0] and unsold.tolist() == [0, 0]


def test_answers_in_fences_and_malformed(spark):
    texts = [("a", '```json\n{"route_summary": "ok", "critical_issues": ["x"]}\n```'), ("b", "sorry, no"), ("c", '{"route_summary": "half'),
             ("d", "  {}  ")]
    out = {r.id: r for r in pt.parse_answers(spark.createDataFrame(texts, "id string, t string"), "t", "route_analysis").collect()}
    assert (out["a"].valid, out["a"].route_summary, out["a"].critical_issues) == (True, "ok", ["x"])
    assert not out["b"].valid and not out["c"].valid and out["d"].valid
    assert out["b"].route_summary == "" and out["d"].supervisor_priorities == []


def test_unknown_codes_are_scrubbed(spark):
    df = spark.createDataFrame([(1, "1", "Customer-12 beat Customer-99, then Customer-12"), (2, "1", "nobody")],
                               "id int, route_code string, t string")
    known = spark.createDataFrame([("1", "12"), ("2", "99")], "route_code string, customer_code string")
    out = {r.id: r.t for r in pt.scrub_codes(df, known, ["id"], "t").collect()}
    assert out == {1: "12 beat [customer], then 12", 2: "nobody"}


def test_template_formats(spark):
    out = spark.range(1).select(pt.render("{a}: {b:.1f}%", {"a": F.lit("x"), "b": F.lit(2.25)})).first()[0]
    assert out == "x: 2.2%"


def test_a_large_item_of_a_session_takes_time_in_proportion(spark, rows, tmp_path):
    """10,000 holders of one item, all visited: every visit used to sort all that still wait."""
    n = 10_000
    plan = spark.range(n).selectExpr(
        "'s' session_id", "'i' item_code", "'plan' kind", "lpad(id, 5, '0') customer_code", "10 quantity", "'CONSIDER' tier",
        f"double({n} - id) priority_score", "0 visit_sequence", "timestamp'2024-01-01 00:00:00' ts")
    visits = plan.selectExpr("session_id", "item_code", "'visit' kind", "customer_code", "0 quantity", "tier", "priority_score",
                             "int(customer_code) + 1 visit_sequence", "timestamp'2024-01-01 00:00:01' ts")
    path = str(tmp_path / "in")
    plan.unionByName(visits).select(*T.StructType.fromDDL(live.SESSION_EVENT).names).write.parquet(path)
    stream = live.live_session_state(live.read_files(spark, path, T.StructType.fromDDL(live.SESSION_EVENT)))
    began = time.monotonic()
    live.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert time.monotonic() - began < 20
    got = {r.customer_code: (r.adjustment, r.unsold) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # each visit leaves its units with the five that follow, at most five each: 10, then 15, 20, 25, 30, 35, 35 ...
    left, want = [], {}
    given = [0] * n
    for i in range(n):
        units = 10 + given[i]
        left.append(units)
        rest = units
        for j in range(i + 1, min(i + 6, n)):
            give = min(rest, 5)
            given[j] += give
            rest -= give
    want = {f"{i:05d}": (given[i], left[i]) for i in range(n)}
    assert got == want


def test_attribution_moves_each_side_once(spark, rows):
    """Recommended and sold lines meet by visit: one exchange a side."""
    r = rows([("1", "2024-01-01", "c", i, 2, "history", 0.5) for i in ("A", "B", "", None)], REC)
    s = rows([("1", "2024-01-01", "c", i, "s", True, q, q > 0) for i, q in (("A", 1), ("A", 2), ("", 5), (None, 7))], SES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fb.build_attribution(r, s)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert {(x.item_code, x.actual_qty, x.was_bought) for x in out.collect()} == {
            ("A", 3, True), ("B", 0, False), ("", 0, False), (None, 0, False)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
