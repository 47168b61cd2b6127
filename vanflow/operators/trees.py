"""Histogram trees: forests, boosting and quantile models fitted one per task.

Features are cut into bins once, by quantiles of the training rows that Spark
aggregates; a row travels as one byte per feature. A fit is a group of an Arrow
function and sees all labelled rows of its class, some few bytes a feature each;
any number of fits (classes, models, trials, parts of a forest) runs side by
side. Scoring is a vectorised function over all rows.

Trees grow level by level or, for `leaves`, best leaf first with the larger
child's histogram by subtraction. Gains are second order with an L2 term; at
every split missing values take the side that gains more.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32  # the last one is for missing values
MISSING = BINS - 1
FLAT = 1e-3  # a forest has settled when more trees lower the held error by less than this share
WIDE = 1 << 21  # codes of more rows are added up feature by feature, without copies of them all
MOST_LEAVES = 4096  # leaves of a level-wise tree at most


@dataclass(frozen=True)
class TreeParams:
    """`loss` is 'squared' or a quantile in (0, 1).

    With held rows, boosting ends after `patience` rounds without a lower error
    and keeps the best prefix; a forest ends when as many trees changed little.
    0 trains every round.
    """

    rounds: int = 100
    step: float = 1.0
    depth: int = 30
    leaves: int = 0
    min_leaf: int = 1
    features: float = 1.0
    rows: float = 1.0
    l2: float = 0.0
    forest: bool = False
    keep_missing: bool = False
    patience: int = 0
    loss: str | float = "squared"
    seed: int = 42


@dataclass
class Trees:
    """Fitted trees, one after the other; right children follow left ones."""

    base: float
    average: bool
    keep_missing: bool
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    miss_left: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, codes: np.ndarray, tree: int) -> np.ndarray:
        node = np.full(len(codes), self.roots[tree])
        todo = np.arange(len(codes))
        while len(todo):
            at = node[todo]
            f = self.feature[at]
            todo, at, f = todo[f >= 0], at[f >= 0], f[f >= 0]
            c = codes[todo, f]
            goes_left = np.where(c == MISSING, self.miss_left[at], c <= self.cut[at])
            node[todo] = self.left[at] + ~goes_left
        return node

    def predict(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for tree in range(len(self.roots)):
            out += self.value[self.leaves(codes, tree)]
        return self.base + (out / max(1, len(self.roots)) if self.average else out)

    def prefix(self, rounds: int) -> Trees:
        return replace(self, roots=self.roots[:rounds])


class _Grower:
    """Node arrays of the trees grown so far."""

    def __init__(self):
        self.roots, self.feature, self.cut, self.miss_left, self.left, self.value = [], [], [], [], [], []

    def node(self, value: float) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0), (self.miss_left, False), (self.left, 0), (self.value, value)):
            column.append(v)
        return len(self.value) - 1

    def split(self, node: int, f: int, cut: int, miss_left: bool, values: Sequence[float]) -> int:
        left = self.node(values[0])
        self.node(values[1])
        self.feature[node], self.cut[node], self.miss_left[node], self.left[node] = f, cut, miss_left, left
        return left

    def done(self, base: float, p: TreeParams) -> Trees:
        return Trees(
            base, p.forest, p.keep_missing, np.array(self.roots, np.int64), np.array(self.feature, np.int16), np.array(self.cut, np.uint8),
            np.array(self.miss_left, bool), np.array(self.left, np.int32), np.array(self.value, np.float64),
        )


def _histograms(flat: np.ndarray, slot: np.ndarray | None, nodes: int, g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of gradient and weight per (node, feature, bin); `flat` numbers the bins of all features."""
    wide = flat.shape[1]
    even = len(w) and (w == w[0]).all()
    if flat.size > WIDE:
        sums = np.empty((2, nodes, wide, BINS), np.float32)
        base = None if slot is None else slot * BINS
        for f in range(wide):
            at = flat[:, f] - f * BINS if base is None else base + flat[:, f] - f * BINS
            sums[0, :, f] = np.bincount(at, g, nodes * BINS).reshape(nodes, BINS)
            sums[1, :, f] = (np.bincount(at, None, nodes * BINS) * w[0] if even else np.bincount(at, w, nodes * BINS)).reshape(nodes, BINS)
        return sums
    at = (flat if slot is None else flat + slot[:, None] * (wide * BINS)).ravel()
    size = nodes * wide * BINS
    sums = np.empty((2, size), np.float32)
    sums[0] = np.bincount(at, np.repeat(g, wide), size)
    sums[1] = np.bincount(at, None, size) * w[0] if even else np.bincount(at, np.repeat(w, wide), size)
    return sums.reshape(2, nodes, wide, BINS)


def _best(h: np.ndarray, p: TreeParams) -> tuple[np.ndarray, ...]:
    """Best split of each node: gain, feature, cut, side of missing values, sums on the left."""
    g, w = h
    total_g, total_w = g.sum(axis=2, keepdims=True), w.sum(axis=2, keepdims=True)
    left_g, left_w = g[:, :, :-1].cumsum(axis=2), w[:, :, :-1].cumsum(axis=2)
    if p.keep_missing:
        left_g = np.stack([left_g, left_g + g[:, :, -1:]], axis=3)
        left_w = np.stack([left_w, left_w + w[:, :, -1:]], axis=3)
    else:
        left_g, left_w = left_g[..., None], left_w[..., None]
    right_g, right_w = total_g[..., None] - left_g, total_w[..., None] - left_w
    fits = (left_w >= p.min_leaf) & (right_w >= p.min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g * left_g / (left_w + p.l2) + right_g * right_g / (right_w + p.l2)
        gain = np.where(fits, gain - (total_g * total_g / (total_w + p.l2))[..., None], -np.inf)
    nodes = len(gain)
    best = gain.reshape(nodes, -1).argmax(axis=1)
    f, cut, miss = np.unravel_index(best, gain.shape[1:])
    pick = (np.arange(nodes), f, cut, miss)
    return gain[pick], f, cut, miss == 1, left_g[pick], left_w[pick], total_g[:, 0, 0], total_w[:, 0, 0]


def _leaf(g, w, p: TreeParams):
    return -g / np.maximum(w + p.l2, 1e-12)


def _go(codes, rows, f, cut, miss):
    c = codes[rows, f]
    return np.where(c == MISSING, miss, c <= cut)


def grow_levels(out: _Grower, codes: np.ndarray, flat: np.ndarray, cols: np.ndarray, g: np.ndarray, w: np.ndarray, p: TreeParams) -> None:
    """One tree, all nodes of a level at a time."""
    rows, slot = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    open_nodes = [out.node(float(_leaf(g.sum(), w.sum(), p)))]
    out.roots.append(open_nodes[0])
    leaves = 1
    for _ in range(p.depth):
        following, keep = [], np.full((len(open_nodes), 2), -1)
        rules = np.zeros((3, len(open_nodes)), np.int64)
        for low in range(0, len(open_nodes), 256):
            part = (slot >= low) & (slot < low + 256)
            size = min(256, len(open_nodes) - low)
            own = rows[part]
            found = _best(_histograms(flat[own], slot[part] - low, size, g[own], w[own]), p)
            for i, (gain, f, cut, miss, lg, lw, tg, tw) in enumerate(zip(*found)):
                if gain > 1e-12 and leaves < MOST_LEAVES:
                    leaves += 1
                    left = out.split(open_nodes[low + i], int(cols[f]), int(cut), bool(miss), (_leaf(lg, lw, p), _leaf(tg - lg, tw - lw, p)))
                    rules[:, low + i] = f, cut, miss
                    for side, weight in enumerate((lw, tw - lw)):  # a child too light to split is done
                        if weight >= 2 * p.min_leaf:
                            keep[low + i, side] = len(following)
                            following.append(left + side)
        goes_left = _go(codes, rows, rules[0, slot], rules[1, slot], rules[2, slot] == 1)
        slot = keep[slot, np.where(goes_left, 0, 1)]
        rows, slot, open_nodes = rows[slot >= 0], slot[slot >= 0], following
        if not len(rows):
            return


def grow_leaves(out: _Grower, codes: np.ndarray, flat: np.ndarray, cols: np.ndarray, g: np.ndarray, w: np.ndarray, p: TreeParams) -> None:
    """One tree, always the leaf with the largest gain next."""
    root = out.node(float(_leaf(g.sum(), w.sum(), p)))
    out.roots.append(root)
    heap: list = []

    def offer(node: int, rows: np.ndarray, hist: np.ndarray, depth: int) -> None:
        if depth < p.depth and len(rows) >= 2 * p.min_leaf:
            best = [x[0] for x in _best(hist[:, None], p)]
            if best[0] > 1e-12:
                heapq.heappush(heap, (-best[0], node, rows, hist, depth, best))

    def summed(rows: np.ndarray) -> np.ndarray:
        return _histograms(flat[rows], None, 1, g[rows], w[rows])[:, 0]

    everything = np.arange(len(codes))
    offer(root, everything, summed(everything), 0)
    leaves = 1
    while heap and leaves < p.leaves:
        _, node, rows, hist, depth, (_, f, cut, miss, lg, lw, tg, tw) = heapq.heappop(heap)
        leaves += 1
        left = out.split(node, int(cols[f]), int(cut), bool(miss), (_leaf(lg, lw, p), _leaf(tg - lg, tw - lw, p)))
        goes_left = _go(codes, rows, f, cut, bool(miss))
        sides = rows[goes_left], rows[~goes_left]
        small = int(len(sides[1]) < len(sides[0]))
        mine = summed(sides[small])
        for side in (0, 1):
            offer(left + side, sides[side], mine if side == small else hist - mine, depth + 1)


def fit(codes: np.ndarray, y: np.ndarray, p: TreeParams, zero: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Trees, int, float]:
    """Trees, rounds kept and error on the held rows (root mean square or pinball loss)."""
    rng = np.random.default_rng(p.seed)
    codes = visible(codes, p.keep_missing, zero)
    out, n, wide = _Grower(), len(y), codes.shape[1]
    quantile = None if p.loss == "squared" else float(p.loss)
    base = 0.0 if p.forest else float(np.mean(y) if quantile is None else np.quantile(y, quantile))
    ahead = np.full(n, base)
    held_codes = visible(held[0], p.keep_missing, zero) if held else None
    held_ahead = np.full(len(held[1]), base) if held else None
    total = np.zeros(len(held[1])) if held else None  # of a forest's trees
    grow = grow_leaves if p.leaves else grow_levels
    best = _error(held[1] - held_ahead, quantile) if held and not p.forest else np.inf, 0
    for number in range(p.rounds):
        cols = np.sort(rng.choice(wide, max(1, round(p.features * wide)), replace=False)) if p.features < 1 else np.arange(wide)
        if p.forest:
            times = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
            rows, w = np.flatnonzero(times), times[times > 0]
            g = -y[rows] * w
        else:
            rows = np.sort(rng.choice(n, max(1, round(p.rows * n)), replace=False)) if p.rows < 1 else np.arange(n)
            w = np.ones(len(rows))
            miss = ahead[rows] - y[rows]
            g = miss if quantile is None else np.where(miss > 0, 1 - quantile, -quantile)
        part = codes[rows][:, cols]
        grow(out, part, part + np.arange(len(cols), dtype=np.int32) * BINS, cols, g, w, p)
        tree = _last(out, p)
        if p.forest:
            if held and p.patience:
                total += tree.value[tree.leaves(held_codes, 0)]
                error = _error(held[1] - total / (number + 1), None)
                if error < best[0] * (1 - FLAT):
                    best = error, number + 1
                elif number + 1 - best[1] >= p.patience:
                    break
            continue
        leaf = tree.leaves(codes, 0)
        if quantile is not None:
            _leaf_quantiles(tree, leaf[rows], (y - ahead)[rows], quantile)
        tree.value *= p.step
        out.value[out.roots[-1] :] = tree.value.tolist()
        ahead += tree.value[leaf]
        if held:
            held_ahead += tree.value[tree.leaves(held_codes, 0)]
            error = _error(held[1] - held_ahead, quantile)
            if error < best[0]:
                best = error, number + 1
            elif p.patience and number + 1 - best[1] >= p.patience:
                break
    trees = out.done(base, p)
    if p.forest:
        return trees, p.rounds, _error(held[1] - trees.predict(held_codes), None) if held else float("nan")
    if held and p.patience:
        return trees.prefix(best[1]), best[1], best[0]
    return trees, p.rounds, _error(held[1] - held_ahead, quantile) if held else float("nan")


def _last(out: _Grower, p: TreeParams) -> Trees:
    """The tree grown last, numbered from 0."""
    root = out.roots[-1]
    return Trees(
        0.0, False, p.keep_missing, np.zeros(1, np.int64), np.array(out.feature[root:], np.int16), np.array(out.cut[root:], np.uint8),
        np.array(out.miss_left[root:], bool), np.array(out.left[root:], np.int64) - root, np.array(out.value[root:]),
    )


def _leaf_quantiles(tree: Trees, leaf: np.ndarray, residual: np.ndarray, quantile: float) -> None:
    order = np.argsort(leaf, kind="stable")
    ends = np.flatnonzero(np.diff(leaf[order])) + 1
    for part in np.split(order, ends):
        tree.value[leaf[part[0]]] = np.quantile(residual[part], quantile)


def _error(residual: np.ndarray, quantile: float | None) -> float:
    if not len(residual):
        return float("nan")
    if quantile is None:
        return float(np.sqrt(np.mean(residual * residual)))
    return float(np.mean(np.maximum(quantile * residual, (quantile - 1) * residual)))


def visible(codes: np.ndarray, keep_missing: bool, zero: np.ndarray) -> np.ndarray:
    """Codes as a model sees them: one that does not tell missing values gets those of 0."""
    return codes if keep_missing else np.where(codes == MISSING, zero, codes)


# --- on Spark


@dataclass(frozen=True)
class Binning:
    """Cut points of every feature; a value's code is the number of cuts below it."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]

    def codes(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape, np.uint8)
        for i, cuts in enumerate(self.cuts):
            out[:, i] = np.searchsorted(np.array(cuts), values[:, i], side="left")
        out[np.isnan(values)] = MISSING
        return out

    @property
    def zero(self) -> np.ndarray:
        return np.array([np.searchsorted(np.array(c), 0.0, side="left") for c in self.cuts], np.uint8)


def binning(rows: DataFrame, features: Sequence[str]) -> Binning:
    """Cuts at BINS - 2 quantiles of each feature over all rows: one aggregation."""
    shares = F.array(*[F.lit((i + 1) / (BINS - 1)) for i in range(BINS - 2)])
    asked = [F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"c{i}") for i, c in enumerate(features)]
    found = rows.agg(*asked).first()
    return Binning(tuple(features), tuple(tuple(sorted(set(v or ()))) for v in found))


def _values(frame: pd.DataFrame) -> np.ndarray:
    return frame.to_numpy(np.float64, na_value=np.nan)


def coded(bins: Binning) -> Column:
    """The features as one binary value, a byte each."""

    @F.pandas_udf("binary")
    def encode(frame: pd.DataFrame) -> pd.Series:
        codes = bins.codes(_values(frame))
        return pd.Series([row.tobytes() for row in codes])

    return encode(F.struct(*[F.col(c).cast("double").alias(c) for c in bins.features]))


def predicted(trees: Trees, bins: Binning) -> Column:
    """Predictions of a model, whose size its leaves and rounds bound."""
    zero = bins.zero

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(trees.predict(visible(bins.codes(_values(frame)), trees.keep_missing, zero)))

    return score(F.struct(*[F.col(c).cast("double").alias(c) for c in bins.features]))


@dataclass(frozen=True)
class Job:
    """One fit: rows of `group`, parameters; with `cutoffs` the mean error of the folds that end there, else a model."""

    name: str
    group: str
    params: TreeParams
    cutoffs: tuple[int, ...] = ()


def run_jobs(rows: DataFrame, jobs: Sequence[Job], bins: Binning) -> dict[str, tuple[Trees | None, int, float]]:
    """Fit every job in a task of its own: (trees, rounds, error) by name.

    `rows` has group, y, held, day and codes; all rows of a job's group travel once to its task.
    """
    if not jobs:
        return {}
    zero, wanted = bins.zero, {j.name: j for j in jobs}
    wide = len(bins.features)
    names = rows.sparkSession.createDataFrame([(j.name, j.group) for j in jobs], "job string, group string")

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        job = wanted[key[0]]
        frame = frame.sort_values(["day", "y", "codes"])  # the same rows in whatever order they came
        codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(-1, wide)
        y, held, day = frame["y"].to_numpy(), frame["held"].to_numpy(bool), frame["day"].to_numpy()
        if job.cutoffs:
            parts = [fit(codes[day < c], y[day < c], job.params, zero, (codes[day == c], y[day == c])) for c in job.cutoffs if (day < c).any() and (day == c).any()]
            error = float(np.mean([e for _, _, e in parts])) if parts else float("inf")
            rounds, model = round(np.mean([r for _, r, _ in parts])) if parts else 0, None
        else:
            trees, rounds, error = fit(codes[~held], y[~held], job.params, zero, (codes[held], y[held]) if held.any() else None)
            model = pickle.dumps(trees)
        return pd.DataFrame({"job": [key[0]], "rounds": [int(rounds)], "error": [error], "model": [model]})

    spread = rows.join(F.broadcast(names), "group").repartition(len(jobs), "job")
    done = spread.groupBy("job").applyInPandas(work, "job string, rounds int, error double, model binary").collect()
    return {r.job: (pickle.loads(r.model) if r.model else None, r.rounds, r.error) for r in done}


def merged(parts: Sequence[Trees]) -> Trees:
    """One forest of several."""
    starts = np.cumsum([0, *(len(t.value) for t in parts[:-1])])
    return replace(
        parts[0], roots=np.concatenate([t.roots + s for t, s in zip(parts, starts)]),
        left=np.concatenate([t.left + np.int32(s) for t, s in zip(parts, starts)]),
        **{n: np.concatenate([getattr(t, n) for t in parts]) for n in ("feature", "cut", "miss_left", "value")},
    )
