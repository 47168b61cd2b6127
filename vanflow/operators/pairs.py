"""Pairwise work inside a route, tiled so that no task sees a whole hot route.

Item co-occurrence and customer similarity are products of a sparse
customer x item table with itself. Emitting the joined pairs row by row would
grow with the square of the largest group; instead customers and items are cut
into bounded tiles, every tile product runs in one task on numpy arrays, and
only its aggregate (counts, or the k nearest peers) leaves the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.config import SPLITS, Splits
from vanflow.functions.numeric import first_ranked
from vanflow.session import cut_lineage, small_side


def _tiles(n: Column, size: int | Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")


def _per_route(sizes: DataFrame) -> DataFrame:
    """Sizes per route, stored once so that a hot route's rows need not move to meet them."""
    return small_side(cut_lineage(sizes))


def _tile_of(key: str, tiles: Column) -> Column:
    return F.pmod(F.xxhash64(key), tiles.cast("bigint")).cast("int")


def _count_tile(key, pdf: pd.DataFrame) -> pd.DataFrame:
    route, _, left, right = key
    customers, row = np.unique(pdf["customer"].to_numpy(), return_inverse=True)
    sides = []
    for tile in (left, right):
        mask = (pdf["tile"] == tile).to_numpy()
        items, col = np.unique(pdf["item"].to_numpy()[mask], return_inverse=True)
        grid = np.zeros((len(customers), len(items)), dtype=np.float32)
        grid[row[mask], col] = 1.0
        sides.append((items, grid))
    (a_items, a), (b_items, b) = sides
    both = a.T @ b
    if left == right:
        both = np.triu(both, k=1)
    i, j = np.nonzero(both)
    return pd.DataFrame(
        {"route": route, "a": a_items[i], "b": b_items[j], "both": both[i, j].astype(np.int64)}
    )


def item_pair_counts(
    purchases: DataFrame,
    route: str = "RouteCode",
    customer: str = "CustomerCode",
    item: str = "ItemCode",
    splits: Splits = SPLITS,
    min_both: int = 1,
) -> DataFrame:
    """Customers buying both items, per route and ordered item pair, with each item's buyers.

    Pairs with fewer than `min_both` common customers are left out; items with
    fewer buyers than that cannot reach it and are never tiled.
    """
    base = purchases.select(
        F.col(route).alias("route"), F.col(customer).alias("customer"), F.col(item).alias("item")
    ).distinct()
    buyers = base.groupBy("route", F.col("item").alias("a")).agg(
        F.count(F.lit(1)).alias("buyers")
    )
    if min_both > 1:
        often = buyers.filter(F.col("buyers") >= min_both).select("route", F.col("a").alias("item"))
        base = base.join(often, ["route", "item"], "left_semi")
    size = _per_route(base.groupBy("route").agg(
        F.countDistinct("customer").alias("_nc"), F.countDistinct("item").alias("_ni")
    ))
    tiles = _tiles(F.col("_ni"), splits.item_block)
    placed = (
        base.join(size, "route")
        .withColumn("tiles", tiles)
        .withColumn("chunk", _tile_of("customer", _tiles(F.col("_nc"), splits.customer_chunk)))
        .withColumn("tile", _tile_of("item", F.col("tiles")))
    )
    # one copy of a row per tile pair it takes part in
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("_other")
    copies = placed.select("route", "chunk", "customer", "item", "tile", other).select(
        "route", "chunk", F.least("tile", "_other").alias("left"),
        F.greatest("tile", "_other").alias("right"), "customer", "item", "tile",
    )
    counted = (
        copies.groupBy("route", "chunk", "left", "right")
        .applyInPandas(_count_tile, "route string, a string, b string, both bigint")
        .groupBy("route", "a", "b").agg(F.sum("both").alias("both"))
        .filter(F.col("both") >= min_both)
    )
    directed = counted.unionByName(
        counted.select("route", F.col("b").alias("a"), F.col("a").alias("b"), "both")
    )
    return directed.join(buyers, ["route", "a"]).select(
        F.col("route").alias(route), F.col("a").alias("anchor"), F.col("b").alias("item"),
        "buyers", "both",
    )


_SLACK = 1e-8  # similarities are rounded to nine decimals
_GROW = 16  # a route has up to that many tiles of the set size; then tiles grow, up to that many times the size
_ROWS = 2048  # customers of each side in one matrix product
_DENSE_ITEMS = 8192
_PIVOTS = 32  # customers of a route, at most, that the others are dealt to by similarity: where nothing is ruled out, a target moves to every tile


class _Vectors:
    """Sparse rows of a task: offsets, item numbers and values."""

    def __init__(self, lengths: np.ndarray, items: np.ndarray, values: np.ndarray):
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.items, self.values = items, values

    def __len__(self) -> int:
        return len(self.ends) - 1

    def part(self, first: int, last: int) -> _Vectors:
        cut = slice(self.ends[first], self.ends[last])
        return _Vectors(np.diff(self.ends[first:last + 1]), self.items[cut], self.values[cut])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def dense(self, n_items: int) -> np.ndarray:
        grid = np.zeros((len(self), n_items))
        grid[self.rows(), self.items] = self.values
        return grid


def _vectors(*tables: pa.Table) -> tuple[list[_Vectors], int]:
    """The tables' rows with items numbered alike, and the number of items."""
    lists = [t["items"].combine_chunks() for t in tables]
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    out, at = [], 0
    for table, items in zip(tables, lists):
        lengths = pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
        values = table["units"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out.append(_Vectors(lengths, numbers[at:at + len(values)], values))
        at += len(values)
    return out, len(coded.dictionary)


def _dots(left: _Vectors, right: _Vectors, n_items: int) -> np.ndarray:
    """Dot products of all rows: one matrix product, or item by item where baskets share little."""
    updates = np.bincount(left.items, minlength=n_items) @ np.bincount(right.items, minlength=n_items)
    if n_items <= _DENSE_ITEMS and n_items * len(left) * len(right) <= 30 * updates:
        return left.dense(n_items) @ right.dense(n_items).T
    out = np.zeros((len(left), len(right)))
    sides = []
    for side in (left, right):
        order = np.argsort(side.items, kind="stable")
        found, first = np.unique(side.items[order], return_index=True)
        groups = np.split(order, first[1:])
        sides.append((dict(zip(found.tolist(), groups)), side.rows(), side.values))
    (a, a_rows, a_values), (b, b_rows, b_values) = sides
    for item in sorted(a.keys() & b.keys()):
        i, j = a[item], b[item]
        out[np.ix_(a_rows[i], b_rows[j])] += np.outer(a_values[i], b_values[j])
    return out


def _nearest(left: _Vectors, right: _Vectors, n_items: int, k: int, floor: np.ndarray, own: np.ndarray):
    """Rows of the k largest similarities of each left row (left, right, similarity); ties go to the lower right row.

    `own` is the right row of the same customer, or -1. Right rows come in
    slices; a slice's products are looked at only where they beat the k-th
    similarity so far (a later row loses a tie) or reach the floor.
    """
    m = len(left)
    sims, cols = np.full((m, k), -1.0), np.full((m, k), len(right), dtype=np.int64)
    for first in range(0, len(right), _ROWS):
        last = min(first + _ROWS, len(right))
        dots = _dots(left, right.part(first, last), n_items)
        mine = np.flatnonzero((own >= first) & (own < last))
        dots[mine, own[mine] - first] = 0.0
        least = np.where(sims[:, -1] > 0, sims[:, -1] + 4e-10, floor - _SLACK)
        hits = dots > np.maximum(least, 4e-10)[:, None]
        if last - first > k and hits.sum() > 8 * k * m:
            at = last - first - k
            hits &= dots >= np.partition(dots, at, axis=1)[:, at][:, None] - 1e-9
        r, c = np.nonzero(hits)
        if not len(r):
            continue
        touched = np.flatnonzero(hits.any(axis=1))
        all_rows = np.concatenate([np.repeat(touched, k), r])
        all_sims = np.concatenate([sims[touched].ravel(), np.round(dots[r, c], 9)])
        all_cols = np.concatenate([cols[touched].ravel(), c + first])
        order = np.lexsort((all_cols, -all_sims, all_rows))
        sizes = np.bincount(all_rows, minlength=m)[touched]
        best = order[np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k].reshape(-1, k)
        sims[touched], cols[touched] = all_sims[best], all_cols[best]
    rows, place = np.nonzero((sims > 0) & (sims > floor[:, None] - _SLACK))
    return rows, cols[rows, place], sims[rows, place]


_PEERS = pa.schema([("route", pa.string()), ("customer", pa.string()), ("peer", pa.string()), ("sim", pa.float64())])


def _peer_tile(k: int):
    """Nearest peers of the left customers among one tile of right customers."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PEERS.empty_table()
        right = right.take(pc.sort_indices(right["customer"]))
        (a, b), n_items = _vectors(left, right)
        own = pc.index_in(left["customer"], right["customer"].combine_chunks()).fill_null(-1)
        own = own.combine_chunks().to_numpy(zero_copy_only=False)
        floor = left["floor"].to_numpy()
        found = []
        for first in range(0, len(a), _ROWS):
            last = min(first + _ROWS, len(a))
            rows, cols, sims = _nearest(a.part(first, last), b, n_items, k, floor[first:last], own[first:last])
            found.append((rows + first, cols, sims))
        rows, cols, sims = (np.concatenate(x) for x in zip(*found))
        customers = left["customer"].take(pa.array(rows))
        return pa.table([left["route"].take(pa.array(rows)), customers, right["customer"].take(pa.array(cols)), pa.array(sims)],
                        schema=_PEERS)

    return run


def _pivots(vectors: DataFrame, size: int) -> DataFrame:
    """Some customers of every route, by hash, about one for `size` of its customers: (route, lead, items, units)."""
    wanted = _per_route(vectors.groupBy("route").agg(F.least(_tiles(F.count(F.lit(1)), size), F.lit(_PIVOTS)).alias("_p")))
    ranked = first_ranked(vectors.select("route", "customer", "items", "units"), ["route"],
                          [F.xxhash64("customer").asc(), F.asc("customer")], _PIVOTS, "lead")
    return cut_lineage(ranked.join(wanted, "route").filter("lead <= _p").select("route", "lead", "items", "units"))


def _nearest_pivot(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The customers with the pivot they are most similar to and that similarity."""
    right = right.take(pc.sort_indices(right["lead"]))
    (a, b), n_items = _vectors(left, right)
    best, near = [np.zeros(0, np.int64)], [np.zeros(0)]
    for first in range(0, len(a), _ROWS):
        dots = _dots(a.part(first, min(first + _ROWS, len(a))), b, n_items)
        best.append(dots.argmax(axis=1))
        near.append(dots.max(axis=1))
    left = left.select(["route", "customer", "items", "units"])
    left = left.append_column("lead", right["lead"].take(pa.array(np.concatenate(best))))
    return left.append_column("near", pa.array(np.concatenate(near)))


def _dealt_to_pivots(vectors: DataFrame, pivots: DataFrame, size: int) -> DataFrame:
    """`vectors` with the number of their nearest pivot (lead) and the similarity to it (near)."""
    parts = _per_route(vectors.groupBy("route").agg(_tiles(F.count(F.lit(1)), _GROW * size).alias("_parts")))
    left = vectors.join(parts, "route").withColumn("part", _tile_of("customer", F.col("_parts"))).drop("_parts")
    right = pivots.join(parts, "route").select(
        *[F.col(c).alias(c) for c in pivots.columns], F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    kinds = dict(vectors.dtypes)
    return left.groupBy("route", "part").cogroup(right.groupBy("route", "part")).applyInArrow(
        _nearest_pivot, f"route string, customer string, items {kinds['items']}, units array<double>, lead int, near double")


def _similarity_tiles(norms: DataFrame, size: int) -> DataFrame:
    """Adds a tile of customers, like baskets together.

    Customers of the same nearest pivot (lead) form a tile; large groups are cut
    by hash. Group sizes are counted, so no tile holds a hot group whole. Tiles
    of a route with many customers are larger, as each customer may meet every tile.
    """
    groups = cut_lineage(norms.groupBy("route", "lead").agg(F.count(F.lit(1)).alias("_n")))
    per_tile = F.least(F.greatest(F.ceil(F.sum("_n") / F.lit(_GROW)), F.lit(size)), F.lit(_GROW * size))
    sizes = _per_route(groups.groupBy("route").agg(per_tile.alias("_size")))
    sized = _per_route(groups.join(sizes, "route"))
    part = _tile_of("customer", _tiles(F.col("_n"), F.col("_size")))
    own = F.concat_ws(":", F.col("lead").cast("string"), part.cast("string"))
    return norms.join(sized, ["route", "lead"]).withColumn("tile", own).drop("_n", "_size")


_ASKED = pa.schema([("route", pa.string()), ("customer", pa.string()), ("tile", pa.string()), ("floor", pa.float64())])


def _pivot_bounds(dots: np.ndarray, between: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest similarity that a customer (row) can have to any customer of a pivot (column).

    `dots` holds similarities to the pivots, `between` those among pivots and
    `least` each pivot's to the farthest of its own. A pivot's customers are no
    nearer to any other pivot: the plane halfway parts them from a customer that
    is. And they lie within an angle of their pivot.
    """
    top = dots.argmax(axis=1)
    lead = dots[np.arange(len(dots)), top][:, None] - dots
    beyond = np.clip(lead / np.sqrt(np.maximum(2 - 2 * between[top], 1e-12)) - 1e-9, 0, 1)
    angle = np.arccos(np.clip(dots, 0, 1)) - np.arccos(np.clip(least, 0, 1))
    return np.minimum(np.sqrt(1 - beyond * beyond), np.cos(np.maximum(angle - 1e-7, 0)))


def _tiles_in_reach(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Left customers with those tiles on the right whose largest weights and whose pivot let them reach their floor."""
    if not left.num_rows or not right.num_rows:
        return _ASKED.empty_table()
    (a, b, p), n_items = _vectors(left, right, right.select(["p_items", "p_units"]).rename_columns(["items", "units"]))
    between, least = _dots(p, p, n_items), right["least"].to_numpy()
    leads = right["lead"].to_numpy()
    between[leads[:, None] == leads] = 1.0
    floor = left["floor"].to_numpy()
    home = pc.index_in(left["home"], right["tile"].combine_chunks()).fill_null(-1)
    home = home.combine_chunks().to_numpy(zero_copy_only=False)
    found = []
    for first in range(0, len(a), _ROWS):
        part = a.part(first, min(first + _ROWS, len(a)))
        enough = floor[first:first + _ROWS, None] - _SLACK
        bound = _dots(part, b, n_items)
        near = (bound > 0) & (bound >= enough) & (_pivot_bounds(_dots(part, p, n_items), between, least) >= enough)
        near &= home[first:first + _ROWS, None] != np.arange(near.shape[1])
        rows, cols = np.nonzero(near)
        found.append((rows + first, cols))
    rows, cols = (pa.array(np.concatenate(x)) for x in zip(*found))
    return pa.table([left["route"].take(rows), left["customer"].take(rows), right["tile"].take(cols), left["floor"].take(rows)],
                    schema=_ASKED)


def candidate_tiles(unit: DataFrame, wanted: DataFrame, floors: DataFrame, pivots: DataFrame, size: int) -> DataFrame:
    """Tiles, other than its own, that may hold a peer at or over a target's floor: (route, customer, tile, floor).

    A tile's largest weight of each item bounds the similarity to any of its
    customers, and so does its pivot; targets and these bounds meet as matrices.
    """
    pairs = unit.select("route", "tile", F.explode(F.arrays_zip("items", "units")).alias("_p"))
    tops = (
        pairs.groupBy("route", "tile", F.col("_p.items").alias("item")).agg(F.max("_p.units").alias("top"))
        .groupBy("route", "tile").agg(F.collect_list(F.struct("item", "top")).alias("_v"))
        .select("route", "tile", F.col("_v.item").alias("items"), F.col("_v.top").alias("units"))
    )
    spread = unit.groupBy("route", "lead").agg(F.min("near").alias("least"))
    tiles = unit.select("route", "lead", "tile").distinct().join(spread, ["route", "lead"])
    centres = pivots.select("route", "lead", F.col("items").alias("p_items"), F.col("units").alias("p_units"))
    tops = cut_lineage(tops.join(tiles.join(centres, ["route", "lead"]), ["route", "tile"]))
    own = unit.join(wanted, ["route", "customer"], "left_semi").join(floors, ["route", "customer"], "left").withColumn(
        "floor", F.coalesce("floor", F.lit(0.0))).withColumnRenamed("tile", "home")
    parts = _per_route(wanted.groupBy("route").agg(_tiles(F.count(F.lit(1)), _GROW * size).alias("_parts")))
    left = own.join(parts, "route").withColumn("part", _tile_of("customer", F.col("_parts"))).select(
        "route", "part", "customer", "home", "floor", "items", "units")
    right = tops.join(parts, "route").select(
        "route", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "tile", "items", "units",
        "lead", "least", "p_items", "p_units")
    return left.groupBy("route", "part").cogroup(right.groupBy("route", "part")).applyInArrow(
        _tiles_in_reach, "route string, customer string, tile string, floor double")


def _compare(unit: DataFrame, asked: DataFrame, k: int, size: int) -> DataFrame:
    """Nearest peers of (route, customer) among the tile asked for; tiles asked for by many meet them in parts.

    A customer's vector travels as one row. With a `floor`, peers below it are left out.
    """
    if "floor" not in asked.columns:
        asked = asked.withColumn("floor", F.lit(0.0))
    counted = asked.groupBy("route", "tile").agg(_tiles(F.count(F.lit(1)), _GROW * size).alias("_parts"))
    parts = _per_route(counted)
    left = asked.join(parts, ["route", "tile"]).withColumn("part", _tile_of("customer", F.col("_parts"))).select(
        "route", "tile", "part", "customer", "floor").join(unit.select("route", "customer", "items", "units"), ["route", "customer"])
    # fresh aliases keep the two sides of the cogroup apart
    right = unit.join(parts, ["route", "tile"]).select(
        *[F.col(c).alias(c) for c in ("route", "customer", "items", "units", "tile")],
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"),
    )
    return (
        left.groupBy("route", "tile", "part").cogroup(right.groupBy("route", "tile", "part"))
        .applyInArrow(_peer_tile(k), "route string, customer string, peer string, sim double")
    )


def nearest_peers(
    weights: DataFrame,
    targets: DataFrame,
    k: int,
    route: str = "RouteCode",
    customer: str = "CustomerCode",
    item: str = "ItemCode",
    weight: str = "weight",
    splits: Splits = SPLITS,
) -> DataFrame:
    """The k most similar customers (cosine > 0) of every target customer on its route.

    Weights are not negative. Similarities are rounded to nine decimals; ties
    go to the lower code. Customers are dealt to the nearest of some pivots; a
    target first meets its own tile, the k-th similarity found there is its
    floor, and it then meets only the other tiles that may hold a peer at the
    floor. Nothing is left out by this.
    """
    size = splits.similarity_block
    base = weights.select(
        F.col(route).alias("route"), F.col(customer).alias("customer"),
        F.col(item).alias("item"), F.col(weight).alias("w"),
    )
    # one row a customer; items without a code count in the norm only
    pair = F.when((F.col("w") > 0) & F.col("item").isNotNull(), F.struct("item", "w"))
    norms = base.filter("route IS NOT NULL AND customer IS NOT NULL").groupBy("route", "customer").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(pair).alias("_v"),
    )
    vectors = cut_lineage(norms.filter("norm > 0").select(
        "route", "customer", F.col("_v.item").alias("items"), F.transform("_v", lambda x: x.w / F.col("norm")).alias("units")))
    pivots = _pivots(vectors, size)
    unit = cut_lineage(_similarity_tiles(cut_lineage(_dealt_to_pivots(vectors, pivots, size)), size))
    wanted = targets.select(F.col(route).alias("route"), F.col(customer).alias("customer")).distinct()
    own = unit.join(wanted, ["route", "customer"], "left_semi").select("route", "customer", "tile")
    at_home = cut_lineage(_compare(unit, cut_lineage(own), k, size))
    floors = at_home.groupBy("route", "customer").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("floor"))
    away = _compare(unit, cut_lineage(candidate_tiles(unit, wanted, floors, pivots, size)), k, size)
    return first_ranked(
        at_home.unionByName(away), ["route", "customer"], [F.desc("sim"), F.asc("peer")], k, "peer_rank"
    ).select(
        F.col("route").alias(route), F.col("customer").alias(customer), "peer", "sim", "peer_rank"
    )
