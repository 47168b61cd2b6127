import datetime as dt
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanflow.config import CLAMPS, Splits
from vanflow.operators import allocate, calibration, lanes, pairs, scoring
from vanflow.plans.recommend import recommend

HIST = ("TrxDate date, RouteCode string, CustomerCode string, CustomerName string, ItemCode string, "
        "ItemName string, TotalQuantity double, AvgUnitPrice double")
TARGET = "2024-06-30"
TINY = Splits(hot_key_splits=3, similarity_block=3, item_block=2, customer_chunk=4)


def bought(customer, item, gaps, qty=5.0, last="2024-06-20", route="1"):
    """Lines ending at ``last`` with the given gaps between them."""
    day = dt.date.fromisoformat(last)
    days = [day]
    for gap in reversed(gaps):
        day -= dt.timedelta(days=gap)
        days.append(day)
    values = qty if isinstance(qty, list) else [qty] * len(days)
    return [(str(d), route, customer, f"n{customer}", item, f"name {item}", float(q), 1.0)
            for d, q in zip(reversed(days), values)]


def scored(rows, lines, half=14.0):
    cal = rows([("1", half, 0.02, 50.0)], "RouteCode string, recency_half_life_days double, "
               "frequency_floor double, qty_benchmark double")
    return scoring.score_pairs(rows(lines, HIST), cal, TARGET, CLAMPS)


def test_one_gap_is_a_weak_cycle(rows):
    row = scored(rows, bought("a", "A", [9])).first()
    assert (row.cycle_days, row.cycle_confidence, row.cycle_method) == (9, 0.3, "two_purchases")


def test_single_purchase_has_no_cycle(rows):
    row = scored(rows, bought("a", "A", [])).first()
    assert (row.cycle_days, row.cycle_confidence, row.cycle_method) == (30, 0.0, "insufficient")
    assert (row.pattern_type, row.consistency, row.trend_type) == ("unknown", 0.3, "INSUFFICIENT_DATA")


def test_two_modes_a_week_apart(rows):
    row = scored(rows, bought("a", "A", [7, 7, 30, 30, 7])).first()
    assert (row.cycle_days, row.cycle_method) == (7, "multi_pattern_2")


def test_bulk_line_is_winsorised(rows):
    row = scored(rows, bought("a", "A", [7, 7, 7], [8, 8, 8, 200])).first()
    ages = np.array([31, 24, 17, 10])
    w = 2.0 ** (-ages / 14.0)
    capped = np.minimum([8, 8, 8, 200], np.percentile([8, 8, 8, 200], 95))
    assert row.weighted_qty == pytest.approx((w * capped).sum() / w.sum())


def test_accelerating_buyer(rows):
    row = scored(rows, bought("a", "A", [20, 20, 20, 20, 10, 10, 10])).first()
    assert (row.trend_type, row.trend_factor) == ("ACCELERATING_FAST", 1.3)


def test_weighted_median_on_uneven_weights(spark):
    df = spark.sql("SELECT array(named_struct('value', 3.0D, 'weight', 0.2D), named_struct('value', 1.0D, 'weight', 0.2D), "
                   "named_struct('value', 9.0D, 'weight', 0.7D)) AS p")
    assert df.select(scoring.weighted_median(F.col("p"))).first()[0] == 9.0


def _random_purchases(rows, n_customers=17, n_items=9, seed=5):
    rng = random.Random(seed)
    data = []
    for r in ("1", "2"):
        for c in range(n_customers):
            for i in range(n_items):
                if rng.random() < 0.4:
                    data.append((r, f"c{c:02d}", f"i{i}", rng.random() + 0.1))
    return rows(data, "RouteCode string, CustomerCode string, ItemCode string, weight double"), data


def test_tiled_pair_counts_match_brute_force(rows):
    df, data = _random_purchases(rows)
    baskets = {}
    for r, c, i, _ in data:
        baskets.setdefault((r, i), set()).add(c)
    want = {}
    for (r, a), ca in baskets.items():
        for (r2, b), cb in baskets.items():
            if r == r2 and a != b and ca & cb:
                want[(r, a, b)] = (len(ca), len(ca & cb))
    for splits in (TINY, Splits()):
        got = pairs.item_pair_counts(df, splits=splits).collect()
        assert {(x.RouteCode, x.anchor, x.item): (x.buyers, x.both) for x in got} == want


def test_tiled_peers_match_brute_force(rows):
    df, data = _random_purchases(rows)
    vectors = {}
    for r, c, i, w in data:
        vectors.setdefault((r, c), {})[i] = w
    norm = {k: np.sqrt(sum(x * x for x in v.values())) for k, v in vectors.items()}
    targets = df.filter("CustomerCode < 'c06'")
    want = {}
    for (r, c), v in vectors.items():
        if c >= "c06":
            continue
        sims = []
        for (r2, p), u in vectors.items():
            if r2 == r and p != c:
                s = round(sum(v[i] * u[i] for i in v.keys() & u.keys()) / norm[(r, c)] / norm[(r2, p)], 9)
                if s > 0:
                    sims.append((-s, p))
        want[(r, c)] = [p for _, p in sorted(sims)[:4]]
    for splits in (TINY, Splits()):
        got = {}
        for x in pairs.nearest_peers(df, targets, 4, splits=splits).orderBy("peer_rank").collect():
            got.setdefault((x.RouteCode, x.CustomerCode), []).append(x.peer)
        assert got == want


def test_tiles_without_a_near_peer_are_not_met(rows):
    """Sixteen circles of customers with items of their own and one item that all buy."""
    rng = random.Random(5)
    data = []
    for circle in range(16):
        for n in range(24):
            for i in rng.sample(range(6), 5):
                data.append(("1", f"c{circle:02d}{n:02d}", f"i{circle:02d}{i}", float(rng.randint(5, 9))))
            data.append(("1", f"c{circle:02d}{n:02d}", "everywhere", 1.0))
    df = rows(data, "RouteCode string, CustomerCode string, ItemCode string, weight double")
    vectors = {}
    for _, c, i, w in data:
        vectors.setdefault(c, {})[i] = w
    norm = {c: np.sqrt(sum(x * x for x in v.values())) for c, v in vectors.items()}
    want = {
        c: [p for _, p in sorted(
            (-round(sum(v[i] * u[i] for i in v.keys() & u.keys()) / norm[c] / norm[p], 9), p)
            for p, u in vectors.items() if p != c)[:4]]
        for c, v in vectors.items()}
    splits = Splits(similarity_block=24)
    met = []
    compare = pairs._compare

    def counted(unit, asked, k, size):
        met.append((asked.count(), unit.select("tile").distinct().count()))
        return compare(unit, asked, k, size)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(pairs, "_compare", counted)
        got = {}
        for x in pairs.nearest_peers(df, df, 4, splits=splits).orderBy("peer_rank").collect():
            got.setdefault(x.CustomerCode, []).append(x.peer)
    assert got == want
    home, away = met
    assert home[0] == len(vectors) and home[1] >= 10
    assert away[0] < len(vectors) * home[1] / 2


def test_allocation_matches_the_greedy_loop(rows):
    rng = random.Random(11)
    data = []
    for item, van in (("A", 30), ("B", 1), ("C", 500), ("D", 12)):
        for c in range(40):
            data.append(("2024-06-30", "1", f"c{c:02d}", item, rng.randint(1, 9), van,
                         float(rng.choice([40.0, 55.5, 70.0])), "why"))
    schema = ("TrxDate date, RouteCode string, CustomerCode string, ItemCode string, RecommendedQuantity int, "
              "VanLoad int, PriorityScore double, WhyQuantity string")
    want = {}
    for item in "ABCD":
        left = next(r[5] for r in data if r[3] == item)
        for r in sorted((r for r in data if r[3] == item), key=lambda r: (-r[6], r[2])):
            give = min(left, r[4])
            if give > 0:
                want[(item, r[2])] = (give, "why" if give == r[4] else f"why [Van constrained: {give}/{r[4]}]")
            left -= give
    for splits in (1, 3, 32):
        out = allocate.allocate_van_load(rows(data, schema), splits).collect()
        assert {(r.ItemCode, r.CustomerCode): (r.RecommendedQuantity, r.WhyQuantity) for r in out} == want


@pytest.mark.parametrize("van,given", [(6, [4, 2]), (5, [4, 1]), (4, [4])])
def test_van_exactly_at_and_below_demand(rows, van, given):
    data = [("2024-06-30", "1", "a", "A", 4, van, 90.0, ""), ("2024-06-30", "1", "b", "A", 2, van, 50.0, "")]
    schema = ("TrxDate date, RouteCode string, CustomerCode string, ItemCode string, RecommendedQuantity int, "
              "VanLoad int, PriorityScore double, WhyQuantity string")
    out = allocate.allocate_van_load(rows(data, schema)).orderBy("CustomerCode").collect()
    assert [r.RecommendedQuantity for r in out] == given


def test_merge_keeps_the_stronger_lane_and_new_kinds(spark):
    signal = "array(named_struct('kind', '{k}', 'detail', '{k}', 'weight', 1.0D, 'evidence', map('a', 'b')))"
    parts = []
    for lane, source, score, kind in ((0, "history", 50.0, "due_now"), (1, "peer", 60.0, "lookalike_peer"),
                                      (3, "reactivation", 60.0, "due_now")):
        parts.append(f"SELECT '1' RouteCode, 'c' CustomerCode, 'A' ItemCode, '{source}' source, {lane} lane, "
                     f"{score}D priority, {signal.format(k=kind)} signals")
    merged = allocate.merge_and_rank(spark.sql(" UNION ALL ".join(parts))).first()
    assert (merged.source, [s.kind for s in merged.signals]) == ("peer", ["lookalike_peer", "due_now"])


def test_thin_window_falls_back_to_all_history(rows):
    old = bought("a", "A", [30] * 8, last="2023-06-01")
    windows = calibration.route_windows(rows(old + bought("b", "A", [1]), HIST), CLAMPS)
    assert windows.first().fallback is True


def test_outlying_route_is_pulled_to_the_corpus(spark):
    base = [(str(i), 0.1 + i / 1000, 40, 10.0, 0.5, 0.4, 30.0) for i in range(12)] + [("x", 0.1, 40, 400.0, 0.5, 0.4, 30.0)]
    cols = "RouteCode string, frequency_floor double, dormancy_days int, qty_benchmark double, completion_gate double, " \
           "basket_min_confidence double, recency_half_life_days double"
    df = spark.createDataFrame(base, cols)
    out = {r.RouteCode: r.qty_benchmark for r in calibration.sanity_clamp(df, df, CLAMPS).collect()}
    assert out["x"] == pytest.approx(np.percentile([10.0] * 12 + [400.0], 95)) and out["3"] == 10.0
    few = df.limit(4)
    assert calibration.sanity_clamp(few, few, CLAMPS).filter("qty_benchmark > 399").count() == few.filter("qty_benchmark > 399").count()


@pytest.fixture(scope="module")
def small_run(spark):
    lines = []
    for c, last in (("a", "2024-06-20"), ("b", "2024-06-18"), ("c", "2024-06-19"), ("d", "2024-06-27"), ("e", "2023-09-01")):
        for item in ("A", "B") if c != "d" else ("A", "B", "C"):
            lines += bought(c, item, [7] * 12, last=last)
    # two customers only: no peer lane on route 2
    lines += bought("p", "A", [7] * 12, route="2") + bought("q", "A", [7] * 12, route="2")
    hist = spark.createDataFrame(lines, HIST.replace("TrxDate date", "TrxDate string")).withColumn(
        "TrxDate", F.col("TrxDate").cast("date"))
    demand = spark.createDataFrame(
        [(r, i, f"name {i}", q, "Forecast") for r in "12" for i, q in (("A", 40.0), ("B", 9.0), ("C", 3.0), ("N", 5.0), ("Z", 0.0))],
        "RouteCode string, ItemCode string, ItemName string, Predicted double, DataSplit string").withColumn(
        "TrxDate", F.lit(TARGET).cast("date"))
    plan = spark.createDataFrame([("1", c) for c in "abcden"] + [("2", "p"), ("2", "q"), ("3", "x")],
                                 "RouteCode string, CustomerCode string").withColumn(
        "JourneyDate", F.lit(TARGET).cast("date"))
    return recommend(hist, demand, plan, TARGET, splits=TINY)


def test_new_customer_is_seeded_and_silent_one_reactivated(small_run):
    lanes_of = {}
    for r in small_run.candidates.collect():
        lanes_of.setdefault(r.CustomerCode, set()).add(r.source)
    assert lanes_of["n"] == {"seed"}
    assert "reactivation" in lanes_of["e"] and "reactivation" not in lanes_of["a"]
    assert "x" not in lanes_of  # a route without van items is skipped


def test_micro_route_has_no_peer_lane(small_run):
    sources = {r.source for r in small_run.candidates.filter("RouteCode = '2'").collect()}
    assert "peer" not in sources and "history" in sources


def test_never_bought_and_empty_items_stay_out_of_history_and_peers(small_run):
    bad = small_run.candidates.filter("source IN ('history', 'peer') AND ItemCode IN ('N', 'Z')")
    assert bad.count() == 0
    assert small_run.candidates.filter("ItemCode = 'Z'").count() == 0


def test_allocation_stays_within_the_van(small_run):
    over = small_run.allocated.groupBy("RouteCode", "ItemCode").agg(
        F.sum("RecommendedQuantity").alias("q"), F.max("VanLoad").alias("v")).filter("q > v")
    assert small_run.allocated.count() > 0 and over.count() == 0


def test_finished_routes_are_skipped(spark, rows):
    hist = rows(bought("a", "A", [7] * 12), HIST)
    demand = rows([(TARGET, "1", "A", "name A", 5.0, "Forecast")],
                  "TrxDate date, RouteCode string, ItemCode string, ItemName string, Predicted double, DataSplit string")
    plan = rows([(TARGET, "1", "a")], "JourneyDate date, RouteCode string, CustomerCode string")
    done = spark.createDataFrame([("1",)], "RouteCode string")
    assert recommend(hist, demand, plan, TARGET, done_routes=done, splits=TINY).allocated.count() == 0


def test_route_prefers_its_forecast_rows(rows):
    demand = rows([(TARGET, "1", "A", 5.0, "Forecast"), (TARGET, "1", "A", 90.0, "Test"), (TARGET, "2", "A", 7.4, "Test"),
                   (TARGET, "1", "B", -3.0, "Forecast")],
                  "TrxDate date, RouteCode string, ItemCode string, Predicted double, DataSplit string")
    assert {(r.RouteCode, r.ItemCode): r.van_qty for r in lanes.van_items(demand, TARGET).collect()} == {
        ("1", "A"): 5, ("2", "A"): 7}


def test_window_length_is_bounded(rows):
    hist = rows(bought("a", "A", [7] * 30), HIST)
    row = calibration.route_windows(hist, replace(CLAMPS, window_days=10)).first()
    assert (row.window_end - row.window_start).days == 60


def test_a_hot_item_lies_in_many_priority_ranges(spark):
    data = spark.range(4000).selectExpr(
        "date'2024-06-30' AS TrxDate", "'1' AS RouteCode", "concat('c', lpad(id, 5, '0')) AS CustomerCode",
        "if(id % 20 = 0, 'cold', 'hot') AS ItemCode", "2 AS RecommendedQuantity", "5001 AS VanLoad",
        "cast(id % 3 AS double) AS PriorityScore", "'why' AS WhyQuantity")
    sizes = allocate.priority_ranges(data, 16).groupBy("ItemCode", "_range").count().collect()
    assert sum(r["ItemCode"] == "hot" for r in sizes) >= 12
    assert max(r["count"] for r in sizes) <= 1000
    out = allocate.allocate_van_load(data, 16).filter("ItemCode = 'hot'")
    hot = sorted((-(n % 3), n) for n in range(4000) if n % 20)
    want = {f"c{n:05d}": min(2, 5001 - 2 * i) for i, (_, n) in enumerate(hot) if 2 * i < 5001}
    assert {r.CustomerCode: r.RecommendedQuantity for r in out.collect()} == want


def _brute_nearest(a, b, k, floor, own):
    want = []
    for i in range(len(a)):
        sims = [(-round(float(a[i] @ b[j]), 9), j) for j in range(len(b)) if j != own[i]]
        want += [(i, j, -s) for s, j in sorted(sims)[:k] if -s > 0 and -s >= floor[i]]
    return want


@pytest.mark.parametrize("n_items,ties", [(3, True), (9, False), (4000, False)])
def test_slices_of_a_tile_keep_the_nearest_and_the_lower_of_equals(n_items, ties):
    """Many equal baskets, floors met exactly and a wide catalogue, over several slices of customers."""
    rng = np.random.default_rng(n_items)

    def side(n):
        grid = np.zeros((n, n_items))
        for row in grid:
            picked = rng.choice(n_items, min(n_items, 3), replace=False)
            row[picked] = 1.0 if ties else rng.random(len(picked))
            row[picked[: rng.integers(0, 2)]] = 0.0
        grid /= np.linalg.norm(grid, axis=1, keepdims=True)
        rows, items = np.nonzero(grid)
        return grid, pairs._Vectors(np.bincount(rows, minlength=n), items, grid[rows, items])

    (a, left), (b, right) = side(11), side(60)
    own = np.array([-1, 0, 7, 59, 13, 14, -1, 20, 27, 28, 41])
    b[own[own >= 0]] = a[own >= 0]
    rows, items = np.nonzero(b)
    right = pairs._Vectors(np.bincount(rows, minlength=60), items, b[rows, items])
    sims = np.round(np.sort(a @ b.T, axis=1), 9)
    for floor in (np.zeros(11), sims[:, -6]):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(pairs, "_ROWS", 7)
            got = pairs._nearest(left, right, n_items, 4, floor, own)
        assert list(zip(*(x.tolist() for x in got))) == _brute_nearest(a, b, 4, floor, own)


def test_tiles_of_a_large_route_grow(rows):
    """A customer may meet every tile, so their number must not follow that of the customers."""
    data = [("1", f"c{n:04d}", n % 40, 1.0) for n in range(1600)]
    norms = rows(data, "route string, customer string, lead bigint, norm double")
    tiled = pairs._similarity_tiles(norms, 10)
    assert tiled.count() == 1600
    assert tiled.select("tile").distinct().count() <= 40


def test_tiles_parted_by_pivots_are_not_met(rows):
    """All buy the same items, so that no item's largest weight rules a tile out; the like ones lie about the same pivot."""
    rng = random.Random(3)
    data = []
    for kind in range(16):
        weights = [float(rng.randint(0, 3) ** 4 + 1) for _ in range(12)]
        for n in range(24):
            data += [("1", f"c{n:02d}{kind:02d}", f"i{i:02d}", w) for i, w in enumerate(weights)]
    df = rows(data, "RouteCode string, CustomerCode string, ItemCode string, weight double")
    met = []
    compare = pairs._compare
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pairs, "_compare", lambda unit, asked, k, size: met.append((asked.count(), unit.select("tile").distinct().count())) or compare(unit, asked, k, size))
        got = pairs.nearest_peers(df, df, 4, splits=Splits(similarity_block=24)).collect()
    assert len(got) == 4 * 384 and all(x.peer[3:] == x.CustomerCode[3:] and x.sim == 1 for x in got)
    home, away = met
    assert home[1] >= 8 and away[0] < 384 * home[1] / 4
