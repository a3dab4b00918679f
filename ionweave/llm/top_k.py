"""Operator 13: exact search for the k highest inner products, by ball trees over shards.

Candidates are cut into shards as they are scanned, without a shuffle. A shard has a ball tree:
each node's rows lie within a radius of its centre, so no row of it has a higher product with q
than q . centre + |q| * radius. A search goes down to one leaf first, then prunes level by level
what is bounded below the query's current kth score, and visits the leaves that are left in the
order of their bounds. The kth score is shared: a few shards are searched first, and what all of
them give together is where every other shard starts from; a task hands it on from shard to shard.

Queries go out in blocks of ``BLOCK``, each broadcast by itself, whatever their number. Rows that
take part: see ``vectors``; rows without an id do not. Rows with the id of the query are not its
candidates. Repeated rows count each, as candidates and as queries. No query or no candidate: no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.llm.common import cut, fresh_folder, small_batches
from ionweave.llm.vectors import integers, kept

#: Rows of a shard, rows of a leaf, queries of a block, queries searched together in a shard.
SHARD, LEAF, BLOCK, TOGETHER = 1 << 14, 64, 1 << 16, 1 << 10
#: One shard of so many gives the scores that all others start from.
SEED = 64
NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


class Balls:
    """A ball tree over some vectors. Level d has 2 ** d nodes, each a range of the rows in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        points, order = vectors.astype(np.float64), np.arange(len(ids))
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        self.cuts = [np.array([0, len(ids)])]
        for _ in range(depth):
            cuts = [0]
            for a, b in zip(self.cuts[-1], self.cuts[-1][1:]):
                own = points[order[a:b]]
                middle = (b - a) // 2
                if b - a > 1:
                    one = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
                    other = own[np.argmax(((own - one) ** 2).sum(1))]
                    order[a:b] = order[a:b][np.argpartition(own @ (one - other), middle)]
                cuts += [a + middle, b]
            self.cuts.append(np.array(cuts))
        self.ids, self.vectors = ids[order], vectors[order]
        self.points = points[order]
        self.norm = float(np.sqrt((self.points**2).sum(1).max(initial=0)))
        #: Of each level, the centres of its nodes and their radii, a little wider than they need to be.
        self.levels = []
        for cuts in self.cuts:
            sizes = np.diff(cuts)
            node = np.repeat(np.arange(len(sizes)), sizes)
            centres = np.stack([np.bincount(node, p, len(sizes)) for p in self.points.T], 1) / np.maximum(sizes, 1)[:, None]
            radii = np.zeros(len(sizes))
            np.maximum.at(radii, node, np.sqrt(((self.points - centres[node]) ** 2).sum(1)))
            self.levels.append((centres, radii * (1 + 1e-9) + 1e-6, sizes))

    def bounds(self, level: int, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """What no product of a query with a row of a node is above."""
        centres, radii, sizes = self.levels[level]
        found = queries @ centres[nodes].T + norms[:, None] * (radii[nodes] + 1e-9 * self.norm)
        return np.where(sizes[nodes] > 0, found, -np.inf)


class Found:
    """The best candidates of each query so far, and what a candidate has to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.own, self.whole, self.k, self.floor = ids, vectors, k, floor
        self.queries = vectors.astype(np.float64)
        self.norms = np.sqrt((self.queries**2).sum(1))
        self.scores = np.full((len(ids), k), NONE)
        self.ids = np.full((len(ids), k), _LAST)

    def least(self, some) -> np.ndarray:
        """The score that a candidate of these queries must have at least."""
        return np.maximum(self.floor[some], self.scores[some, -1])

    def look(self, balls: Balls, leaf: int, some: np.ndarray) -> None:
        """Compare queries with all rows of a leaf."""
        a, b = balls.cuts[-1][leaf : leaf + 2]
        if self.norms[some].max() * balls.norm < 2**52:  # such products are exact in floating point
            scores = (self.queries[some] @ balls.points[a:b].T).astype(np.int64)
        else:
            scores = self.whole[some] @ balls.vectors[a:b].T
        ids = np.broadcast_to(balls.ids[a:b], scores.shape)
        scores = np.where(ids == self.own[some][:, None], NONE, scores)
        hit = ((scores >= self.least(some)[:, None]) & (scores > NONE)).any(1)
        some, scores, ids = some[hit], np.concatenate([self.scores[some[hit]], scores[hit]], 1), np.concatenate([self.ids[some[hit]], ids[hit]], 1)
        best = np.lexsort((ids, ~scores))[:, : self.k]  # ~ turns the order round, and NONE comes last
        self.scores[some], self.ids[some] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)

    def search(self, balls: Balls) -> None:
        """Take a shard's candidates in."""
        for a in range(0, len(self.own), TOGETHER):
            self._search(balls, np.arange(a, min(a + TOGETHER, len(self.own))))

    def _search(self, balls: Balls, all_: np.ndarray) -> None:
        queries, norms, depth = self.queries[all_], self.norms[all_], len(balls.levels) - 1
        node = np.zeros(len(all_), np.int64)
        for level in range(1, depth + 1):  # to the leaf that promises most at each step
            centres, radii, sizes = balls.levels[level]
            two = [np.where(sizes[n] > 0, np.einsum("qw,qw->q", queries, centres[n]) + norms * radii[n], -np.inf) for n in (2 * node, 2 * node + 1)]
            node = 2 * node + (two[1] > two[0])
        self._each(balls, all_, node)
        nodes, alive = np.zeros(1, np.int64), np.ones((len(all_), 1), bool)
        for level in range(depth + 1):
            if level:
                nodes, alive = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(alive, 2, 1)
            bounds = balls.bounds(level, queries, norms, nodes)
            alive &= bounds >= self.least(all_)[:, None]
            wanted = alive.any(0)
            nodes, alive, bounds = nodes[wanted], alive[:, wanted], bounds[:, wanted]
        alive &= nodes[None, :] != node[:, None]
        bounds[~alive] = -np.inf
        order = np.argsort(-bounds, axis=1, kind="stable")
        begin, width = 0, 1
        while begin < order.shape[1]:  # the best leaves first, twice as many each time
            next_ = order[:, begin : begin + width]
            open_ = np.take_along_axis(bounds, next_, 1) >= np.maximum(self.least(all_), NONE + 1)[:, None]
            open_ &= np.take_along_axis(alive, next_, 1)
            if not open_.any():
                break
            which, place = np.nonzero(open_)
            self._each(balls, all_[which], nodes[next_[which, place]])
            begin, width = begin + width, 2 * width

    def _each(self, balls: Balls, some: np.ndarray, leaves: np.ndarray) -> None:
        order = np.argsort(leaves, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1) if len(order) else []:
            self.look(balls, int(leaves[own[0]]), some[own])


def shards(df: DataFrame, column: str, length: int) -> DataFrame:
    """``shard long, ids binary, vectors binary``: the rows of each task, ``SHARD`` at a time."""

    def pack(ids: list, vectors: list, n: int) -> pa.RecordBatch:
        import pyspark

        shard = pyspark.TaskContext.get().partitionId() << 32 | n
        rows = np.concatenate(vectors)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int64()),
            "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
            "vectors": pa.array([rows.astype(np.int32).tobytes()], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held, n = [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, names = integers(batch.column(column), length), batch.column("vec_id").to_numpy()
            for a in range(0, len(rows), SHARD):
                ids.append(names[a : a + SHARD])
                vectors.append(rows[a : a + SHARD])
                held += len(ids[-1])
                if held >= SHARD:
                    yield pack(ids, vectors, n)
                    ids, vectors, held, n = [], [], 0, n + 1
        if held:
            yield pack(ids, vectors, n)

    return df.select("vec_id", column).mapInArrow(run, "shard long, ids binary, vectors binary")


def _searched(parts: DataFrame, length: int, asked, floor, k: int) -> DataFrame:
    """``number, vec_id, score``: the best candidates of each query in each task, none below the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = asked.value
        found = Found(ids, vectors, k, floor.value)
        for batch in batches:
            for own, rows in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                found.search(Balls(np.frombuffer(own, np.int64), np.frombuffer(rows, np.int32).reshape(-1, length).astype(np.int64)))
        real = (found.scores > NONE) & (found.scores >= found.floor[:, None])
        number, _ = np.nonzero(real)
        yield pa.RecordBatch.from_pydict({"number": pa.array(number, pa.int64()), "vec_id": pa.array(found.ids[real], pa.int64()), "score": pa.array(found.scores[real], pa.int64())})

    return parts.select("ids", "vectors").mapInArrow(run, "number long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query and their ranks; Spark drops what can't be among them before the shuffle too."""
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(spark: SparkSession, parts: DataFrame, length: int, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of a block of queries."""
    asked, open_floor = spark.sparkContext.broadcast((ids, vectors)), spark.sparkContext.broadcast(np.full(len(ids), NONE))
    some = F.xxhash64("shard") % SEED == 0
    if parts.where(some).limit(1).count() == 0:
        some = F.col("shard") == F.lit(parts.agg(F.min("shard")).first()[0])
    first = cut(_best(_searched(parts.where(some), length, asked, open_floor, k), k))
    floor = np.full(len(ids), NONE)
    for r in first.where(F.col("rank") == k).select("number", "score").toArrow().to_pylist():  # a row a query of the block
        floor[r["number"]] = r["score"]
    rest = _searched(parts.where(~some), length, asked, spark.sparkContext.broadcast(floor), k)
    named = spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(ids)), pa.int64()), "query_id": pa.array(ids, pa.int64())}))
    best = _best(first.drop("rank").unionByName(rest), k)
    return best.join(F.broadcast(named), "number").select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, queries: DataFrame, k: int, column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` the k rows of ``df`` with the highest products.

    Ties go to the smaller id. Both have ``vec_id`` and vectors of whole or broken numbers, which are
    rounded as in ``vectors``. Queries have to be as long as the vectors; others are left out.
    """
    spark = df.sparkSession
    small_batches(spark)
    as_long = lambda rows: rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), column)
    rows, length = kept(as_long(df), column)
    asked = kept(as_long(queries), column)[0].where(F.size(column) == length)
    folder, out = fresh_folder(spark, "queries"), fresh_folder(spark, "found")
    asked.withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    asked = spark.read.parquet(folder)
    n = asked.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = fresh_folder(spark, "shards")
    shards(rows, column, length).write.parquet(place)
    parts, blocks = spark.read.parquet(place), -(-n // BLOCK)
    for block in range(blocks):  # a hash deals out rows, so blocks are about equal
        own = asked.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == block).select("vec_id", column).toArrow()
        if own.num_rows:
            vectors = integers(own.column(column).combine_chunks(), length)
            found = _block(spark, parts, length, own.column("vec_id").to_numpy(), vectors, k)
            found.write.mode("append").parquet(out)
    return spark.read.parquet(out)
