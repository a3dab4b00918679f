"""Regression trees over binned features, boosted or as a forest, grown level by level.

Features are cut into bins at their quantiles, which one mergeable sketch a feature gives in one
pass. A level is one pass over the rows for many nodes, of many trees where they do not wait for
each other: every task adds up gradients and hessians by (node, feature, bin), the sums are grouped
by Spark, each node's best split is a running sum over its bins, and the driver gets a row a node.
There is no limit to the depth of a tree.

A split's gain is (GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)) / 2 - gamma, a node's
value -rate * G / (H + lambda). Boosting has G = prediction - target and H = 1 for a row; a forest
G = -target and H = 1, lambda and gamma 0, so that a gain is what the squares become less, and values
are means. Rows count as often as a draw says, which depends on the row's number, the tree and the
seed alone. Equal gains go to the first feature, the lowest bin, missing values to the left. Null and
NaN features go to the side where the gain is higher; rows without a target are left out. A forest looks at rows
of the same bins and target once: their draws add up to Poisson's distribution of their number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.sources.files import scratch

#: Bins of a feature at most; the one after them is for missing values.
BINS = 64
#: Quantiles are right to one part in so many.
ACCURACY = 10_000
#: Predictions of a growing ensemble are written with the rows after so many trees.
WRITE_EVERY = 10
#: Sums that a task holds at most, about: nodes of a level wait for the next pass beyond them.
CELLS = 1 << 22


@dataclass
class Tree:
    """Nodes as they were made: feature (-1: a leaf), bin and side of missing values of a split, the left child (the right one follows it), and values."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row of bins ends."""
        feature, cut, turn, left = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left))
        at = np.zeros(len(bins), np.int64)
        while len(going := np.flatnonzero(feature[at] >= 0)):
            node = at[going]
            own = bins[going, feature[node]]
            at[going] = left[node] + ~np.where(own == BINS, turn[node], own <= cut[node])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]

    def depth(self) -> int:
        deep = [0] * len(self.feature)
        for node, f in enumerate(self.feature):
            if f >= 0:
                deep[self.left[node]] = deep[self.left[node] + 1] = deep[node] + 1
        return max(deep)

    def split(self, node: int, feature: int, cut: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        child = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node] = feature, cut, missing_left, child
        for v in values:
            for column, x in zip((self.feature, self.bin, self.missing_left, self.left, self.value), (-1, 0, True, 0, v)):
                column.append(x)
        return child, child + 1


@dataclass
class Ensemble:
    """``start`` and the trees' values, added up. A value's bin is the number of ``cuts`` of its feature below it."""

    names: list[str]
    cuts: list[list[float]]
    start: float
    trees: list[Tree]

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.empty((batch.num_rows, len(self.names)), np.uint8)
        for k, (name, cuts) in enumerate(zip(self.names, self.cuts)):
            values = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, k] = np.where(np.isnan(values), BINS, np.searchsorted(cuts, values, "left"))
        return out

    def predict(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with one more column, in one Arrow pass."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = shared.value
                bins, total = own.bins(batch), np.full(batch.num_rows, own.start)
                for t in own.trees:
                    total += t.predict(bins)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, column])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())]))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        d = json.loads(text)
        return cls(d["names"], d["cuts"], d["start"], [Tree(**t) for t in d["trees"]])


def quantile_cuts(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Of each feature the different values at its quantiles that are below its greatest one."""
    shares = [k / bins for k in range(1, bins)]
    cuts = []
    for a in range(0, len(names), 32):  # a sketch for each feature; not too many in one row
        real = [F.when(~F.isnan(F.col(f"`{n}`").cast("double")), F.col(f"`{n}`").cast("double")) for n in names[a : a + 32]]
        found = rows.agg(*(F.struct(F.percentile_approx(c, shares, ACCURACY).alias("q"), F.max(c).alias("top")).alias(f"_{k}") for k, c in enumerate(real))).first()
        cuts += [sorted({q for q in (r["q"] or []) if q < r["top"]}) for r in found]
    return cuts


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def uniform(rows: np.ndarray, *keys: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the rows' numbers and the keys alone."""
    x = rows.astype(np.uint64)
    for key in keys:
        x = x * _STEP + np.uint64(key & 0xFFFFFFFF) + np.uint64(1)
        for shift, factor in zip((30, 27), _MIX):
            x = (x ^ (x >> np.uint64(shift))) * factor
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


#: How often a row is in a bootstrap sample of as many rows: Poisson's distribution of mean 1, summed up.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


@lru_cache(1 << 12)
def _poisson_sums(mean: int) -> tuple[int, np.ndarray]:
    """Poisson's distribution of a mean, summed up, from the first number within 12 deviations of it."""
    wide = 12 * int(np.ceil(np.sqrt(mean))) + 20
    least = max(0, mean - wide)
    k = np.arange(least + 1, mean + wide + 1)
    first = -mean + least * np.log(mean) - lgamma(least + 1)
    return least, np.cumsum(np.exp(first + np.concatenate([[0.0], np.cumsum(np.log(mean) - np.log(k))])))


def poisson(u: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often bootstrap samples draw ``times`` rows together: what ``u`` in [0, 1) says by Poisson's distribution of that mean."""
    out = np.searchsorted(_POISSON, u, "right").astype(float)
    order = np.argsort(times, kind="stable")
    values, begins = np.unique(times[order], return_index=True)
    for n, own in zip(values.tolist(), np.split(order, begins[1:]) if len(order) else []):
        if n > 1:
            least, sums = _poisson_sums(n)
            out[own] = least + np.searchsorted(sums, u[own], "right")
    return out


def drawn(n: int, k: int, *keys: int) -> np.ndarray:
    """Which k of n features a tree or a node may use."""
    order = np.argsort(uniform(np.arange(n), *keys), kind="stable")
    chosen = np.zeros(n, bool)
    chosen[order[: max(1, min(k, n))]] = True
    return chosen


@dataclass
class Growth:
    """How trees are grown. ``share``: rows of a tree, or None for a bootstrap sample; ``features``: how many each tree, or each node, may use."""

    depth: int | None = None
    rate: float = 1.0
    lambda_: float = 0.0
    gamma: float = 0.0
    least_split: float = 2.0
    least_leaf: float = 1.0
    share: float | None = 1.0
    features: int = 1 << 30
    by_node: bool = False
    boosted: bool = True
    seed: int = 13

    def weights(self, rows: np.ndarray, tree: int, times: np.ndarray | None = None) -> np.ndarray:
        """How often a tree counts each row; one that stands for several, ``times``, as often as all of them together (whole or bootstrap samples)."""
        u = uniform(rows, self.seed, tree)
        if times is not None:
            return poisson(u, times) if self.share is None else times.astype(float)
        return np.searchsorted(_POISSON, u, "right").astype(float) if self.share is None else (u < self.share).astype(float)

    def allowed(self, n: int, tree: int, node: int) -> np.ndarray:
        return drawn(n, self.features, self.seed, tree, node + 1 if self.by_node else 0)


def binned_rows(rows: DataFrame, made: Ensemble, target: str, folder: str) -> DataFrame:
    """``bins, target, margin, row``, written once: rows as bytes, with a number of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [b.tobytes() for b in made.bins(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("_target"), pa.array(np.full(batch.num_rows, made.start))], ["bins", "target", "margin"])

    asked = rows.select(*(F.col(f"`{n}`") for n in dict.fromkeys(made.names)), F.col(target).cast("double").alias("_target"))
    asked.mapInArrow(run, "bins binary, target double, margin double").withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def alike(state: DataFrame, folder: str) -> DataFrame:
    """The rows of ``binned_rows`` with equal ones as one, and how many ``times`` each is there; a row's number comes from what it holds."""
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = state.groupBy("bins", "target", "margin").agg(F.count("*").alias("times"))
    grouped.withColumn("row", F.xxhash64("bins", "target")).repartition(n).write.parquet(folder)  # they are few but looked at often
    return state.sparkSession.read.parquet(folder)


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def _advanced(state: DataFrame, trees: list[Tree], width: int, folder: str) -> DataFrame:
    """The rows with the predictions of more trees in ``margin``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margin = _unpacked(batch, width), batch.column("margin").to_numpy()
            for t in trees:
                margin = margin + t.predict(bins)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("target"), pa.array(margin), batch.column("row")], ["bins", "target", "margin", "row"])

    state.mapInArrow(run, "bins binary, target double, margin double, row long").write.parquet(folder)
    return state.sparkSession.read.parquet(folder)


def histograms(state: DataFrame, recent: list[Tree], trees: dict[int, Tree], nodes: list[tuple[int, int]], growth: Growth, width: int) -> DataFrame:
    """``tree, node, feature, bin, g, h``: sums over the rows of each (tree, node), added up in tasks before they are grouped."""
    shared = state.sparkSession.sparkContext.broadcast((recent, {t: trees[t] for t, _ in nodes}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent_, grown = shared.value
        cells, places = BINS + 1, {}
        allowed = np.stack([growth.allowed(width, t, n) for t, n in nodes])
        for k, (t, n) in enumerate(nodes):  # the nodes of a tree follow each other
            places.setdefault(t, []).append((k, n))
        size = width * cells
        g, h = np.zeros(len(nodes) * size), np.zeros(len(nodes) * size)
        columns = np.arange(width) * cells
        for batch in batches:
            bins, off = _unpacked(batch, width), -batch.column("target").to_numpy()
            if growth.boosted:
                off = off + batch.column("margin").to_numpy()
                for t in recent_:
                    off += t.predict(bins)
            number = batch.column("row").to_numpy()
            times = batch.column("times").to_numpy() if "times" in batch.schema.names else None
            for t, own in places.items():
                slot = np.full(len(grown[t].feature), -1)
                slot[[n for _, n in own]] = range(len(own))
                weight = growth.weights(number, t) if times is None else growth.weights(number, t, times)
                at = np.where(weight > 0, slot[grown[t].leaves(bins)], -1)
                inside = np.flatnonzero(at >= 0)
                begin, long_ = own[0][0] * size, len(own) * size
                for a in range(0, len(inside), 4096):
                    some = inside[a : a + 4096]
                    cell = (at[some, None] * size + columns + bins[some]).ravel()
                    w = np.repeat(weight[some], width)
                    h[begin : begin + long_] += np.bincount(cell, w, long_)
                    g[begin : begin + long_] += np.bincount(cell, w * np.repeat(off[some], width), long_)
        used = np.flatnonzero(h)
        used = used[allowed[used // size, used % size // cells]]
        names = np.array(nodes, np.int64).reshape(-1, 2)[used // size]
        columns_ = [names[:, 0], names[:, 1], used % size // cells, used % cells]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns_), pa.array(g[used]), pa.array(h[used])], ["tree", "node", "feature", "bin", "g", "h"])

    kind = "tree int, node int, feature int, bin int, g double, h double"
    return state.mapInArrow(run, kind).groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, growth: Growth) -> DataFrame:
    """``tree, node, g, h`` and, where a split gains, ``gain, feature, bin, missing_left, gl, hl``."""
    part = W.partitionBy("tree", "node", "feature")
    so_far = part.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    none = lambda c: F.coalesce(F.sum(F.when(F.col("bin") == BINS, F.col(c))).over(part), F.lit(0.0))
    run = sums.select(
        "tree", "node", "feature", "bin", F.sum("g").over(so_far).alias("sg"), F.sum("h").over(so_far).alias("sh"),
        F.sum("g").over(part).alias("g"), F.sum("h").over(part).alias("h"), none("g").alias("ng"), none("h").alias("nh"),
    )
    last = F.col("bin") == BINS  # its row parts the missing values from all others
    run = run.withColumns({"sg": F.col("sg") - F.when(last, F.col("ng")).otherwise(0.0), "sh": F.col("sh") - F.when(last, F.col("nh")).otherwise(0.0)})
    both, one = F.array(F.lit(True), F.lit(False)), F.array(F.lit(True))
    run = run.withColumn("missing_left", F.explode(F.when(F.col("nh") > 0, both).otherwise(one)))
    more = lambda c: F.when(F.col("missing_left"), F.col(c)).otherwise(0.0)
    run = run.withColumns({"gl": F.col("sg") + more("ng"), "hl": F.col("sh") + more("nh")})
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    square = lambda g, h: g * g / (h + growth.lambda_)
    gain = 0.5 * (square(F.col("gl"), F.col("hl")) + square(gr, hr) - square(F.col("g"), F.col("h"))) - growth.gamma
    least = max(growth.least_leaf, 1e-9)
    fits = (F.col("h") >= growth.least_split) & (F.col("hl") >= least) & (hr >= least)
    # sums in another order differ in their last digits, which must not choose among equal splits
    run = run.withColumn("gain", F.when(fits, F.round(gain, 7))).withColumn("gain", F.when(F.col("gain") > 0, F.col("gain")))
    order = F.struct((-F.coalesce("gain", F.lit(0.0))).alias("a"), "feature", "bin", (~F.col("missing_left")).alias("b"))
    best = F.min_by(F.struct("gain", "feature", "bin", "missing_left", "gl", "hl", "g", "h"), order)
    return run.groupBy("tree", "node").agg(best.alias("s")).select("tree", "node", "s.*")


def grow(state: DataFrame, recent: list[Tree], numbers: list[int], growth: Growth, width: int) -> list[Tree]:
    """Trees that do not wait for each other, by their numbers; nodes are split until none gains."""
    trees, waiting, level = {t: Tree() for t in numbers}, [(t, 0) for t in numbers], 0
    most = max(1, CELLS // (width * (BINS + 1)))
    while waiting and (growth.depth is None or level < growth.depth):
        after = []
        for a in range(0, len(waiting), most):
            sums = histograms(state, recent, trees, waiting[a : a + most], growth, width)
            for r in sorted(best_splits(sums, growth).collect()):  # a row a node
                value = lambda g, h: -growth.rate * g / (h + growth.lambda_)
                tree = trees[r["tree"]]
                tree.value[r["node"]] = value(r["g"], r["h"])
                if r["gain"] is not None:
                    sides = value(r["gl"], r["hl"]), value(r["g"] - r["gl"], r["h"] - r["hl"])
                    children = tree.split(r["node"], r["feature"], r["bin"], r["missing_left"], sides)
                    heavy = [n for n, h in zip(children, (r["hl"], r["h"] - r["hl"])) if h >= growth.least_split]
                    after += [(r["tree"], n) for n in heavy]
        waiting, level = sorted(after), level + 1
    return [trees[t] for t in numbers]


def _known(rows: DataFrame, target: str) -> DataFrame:
    return rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))


def boost(rows: DataFrame, names: list[str], target: str, trees: int = 400, growth: Growth | None = None) -> Ensemble:
    """A boosted ensemble. By default depth 10, rate 0.1, lambda 1, gamma 0, nine rows in ten and a fifth of the features a tree."""
    growth = growth or Growth(depth=10, rate=0.1, lambda_=1.0, share=0.9, features=round(0.2 * len(names)))
    known = _known(rows, target)
    mean = known.agg(F.avg(F.col(target).cast("double"))).first()[0]
    made = Ensemble(list(names), quantile_cuts(known, names), float(mean or 0.0), [])
    if mean is None:
        return made
    folder, width = scratch(rows.sparkSession, "boosting"), len(names)
    state = binned_rows(known, made, target, f"{folder}/0")
    for number in range(trees):
        recent = made.trees[number - number % WRITE_EVERY :]
        if number and not recent:  # what the last trees say goes into the rows
            state = _advanced(state, made.trees[-WRITE_EVERY:], width, f"{folder}/{number}")
        made.trees += grow(state, recent, [number], growth, width)
    return made


def forest(rows: DataFrame, names: list[str], target: str, trees: int = 180, growth: Growth | None = None) -> Ensemble:
    """A forest; its trees are grown together. By default 90 features a node, 100 rows to split and 80 in a leaf at least, no limit to the depth."""
    growth = growth or Growth(least_split=100, least_leaf=80, share=None, features=90, by_node=True, boosted=False)
    known = _known(rows, target)
    made = Ensemble(list(names), quantile_cuts(known, names), 0.0, [])
    if known.isEmpty():
        return made
    folder = scratch(rows.sparkSession, "forest")
    state = binned_rows(known, made, target, f"{folder}/0")
    if growth.share is None or growth.share >= 1:  # all rows, or bootstrap samples
        state = alike(state, f"{folder}/1")
    made.trees = grow(state, [], list(range(trees)), growth, len(names))
    for t in made.trees:  # their mean, as a sum
        t.value = [v / trees for v in t.value]
    return made
