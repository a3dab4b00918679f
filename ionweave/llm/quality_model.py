"""Quality classifier over random-indexing word vectors.

Every bucket of words has a sparse random index vector of a few +1 and -1. A word's vector is
the sum of the index vectors of the words around it, over all documents. Documents pool the
vectors of their words; a two-layer network in numpy learns the labels of all labelled rows from
the pooled vectors, and a temperature fitted on rows kept from training calibrates its probabilities.

Words share 2**14 buckets by crc32, so vectors have a fixed size (4 MiB) and may be broadcast.
Each task sums its own vectors and sends one row for each 64 buckets.

The labelled rows are dealt into parts by a hash of their id. In each round every part goes on from
the same network for some epochs over its own rows, and the networks' mean is where the next round starts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import alone, blocks, by_batch, cut, row_of, texts_of

BUCKETS, DIM, NONZERO, WINDOW, ROWS_EACH = 1 << 14, 64, 4, 2, 64
#: About how many labelled rows a part has; all parts together have all of them.
PART_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 40, 256, 3e-3, 1e-4, 7
#: After how many rounds of EPOCHS // ROUNDS epochs the parts' networks have become one.
ROUNDS = 8
#: Bits that tell tasks which ids may have a label.
SPOTS = 1 << 25
#: Temperatures that are tried.
TRIED = np.geomspace(0.25, 8, 41)
#: A score from here on predicts label 1.
THRESHOLD = 0.3

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return found


_known = _Buckets()


def buckets(text: str) -> list[int]:
    """The bucket of each word and each run of symbols."""
    return list(map(_known.__getitem__, _TOKENS(text)))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector; bucket BUCKETS stands between documents."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS + 1, DIM)), axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    signs[BUCKETS] = 0
    return places, signs


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM + 1): each bucket's vector, and how often it occurs, over all of ``docs``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("quality_model", _known.clear)
        places, signs = index_vectors()
        sums = np.zeros((BUCKETS + 1) * DIM)
        counts = np.zeros(BUCKETS + 1, np.int64)
        waiting: list[int] = []

        def flush() -> None:
            every = np.array(waiting, np.int64)
            waiting.clear()
            counts[:] += np.bincount(every, minlength=BUCKETS + 1)
            for a in range(0, len(every), 1 << 19):  # a very long text in pieces, each with the words around it
                x = every[max(0, a - WINDOW) : a + (1 << 19)]
                for away in range(1, WINDOW + 1):
                    first = x[max(0, min(a, WINDOW) - away) :]  # pairs whose later word is in this piece
                    for word, around in ((first[:-away], first[away:]), (first[away:], first[:-away])):
                        for k in range(NONZERO):
                            sums[:] += np.bincount(word * DIM + places[around, k], signs[around, k], len(sums))

        for batch in batches:
            for text in texts_of(batch):
                waiting += buckets(text)
                if len(waiting) > 1 << 19:
                    flush()
                waiting += [BUCKETS] * WINDOW
        if len(waiting):
            flush()
        table = np.column_stack([sums.reshape(-1, DIM)[:BUCKETS], counts[:BUCKETS]]).astype(np.int64)
        for chunk in range(0, BUCKETS, ROWS_EACH):
            if (part := table[chunk : chunk + ROWS_EACH]).any():
                yield _row(chunk, part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
                new = _part(part)
                sums[chunk] = sums[chunk] + new if chunk in sums else new
        for chunk, part in sums.items():
            yield _row(chunk, part)

    parts = docs.select("text").mapInArrow(gather, "chunk int, sums binary")
    found = np.zeros((BUCKETS, DIM + 1), np.int64)
    for row in parts.repartition(BUCKETS // ROWS_EACH // 8, "chunk").mapInArrow(add, "chunk int, sums binary").collect():
        found[row.chunk : row.chunk + ROWS_EACH] = _part(row.sums)
    return found


def _row(chunk: int, part: np.ndarray) -> pa.RecordBatch:
    """Small numbers travel as such: as int32 where all fit."""
    small = part.astype(np.int32)
    data = (small if (small == part).all() else part).tobytes()
    return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "sums": pa.array([data], pa.binary())})


def _part(data: bytes) -> np.ndarray:
    kind = np.int32 if len(data) == ROWS_EACH * (DIM + 1) * 4 else np.int64
    return np.frombuffer(data, kind).astype(np.int64).reshape(ROWS_EACH, DIM + 1)


def pooled_table(sums: np.ndarray) -> np.ndarray:
    """What a document adds up: each bucket's unit vector, and that vector weighted against
    frequent words, as float32 (BUCKETS, 2 * DIM)."""
    vectors, counts = sums[:, :DIM].astype(float), sums[:, DIM].astype(float)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    share = counts / max(1.0, counts.sum())
    weight = 1e-3 / (1e-3 + share)
    return np.hstack([unit, unit * weight[:, None]]).astype(np.float32)


def pool(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The mean of each text's table rows, the shares of words equal to the one before and of
    words met for the first time, and the logarithm of its length; zeros if it is empty."""
    out = np.zeros((len(texts), table.shape[1] + 3))
    width = table.shape[1]
    for i, text in enumerate(texts):
        ids = buckets(text)
        for a in range(0, len(ids), 1 << 15):
            out[i, :width] += table[ids[a : a + (1 << 15)]].sum(axis=0, dtype=np.float64)
        out[i, width] = sum(map(int.__eq__, ids, ids[1:]))
        out[i, width + 1] = len(set(ids))
        out[i, :-1] /= max(1, len(ids))
        out[i, -1] = np.log1p(len(ids)) / 10
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def by_part(dealt: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray | None:
    """The sum of ``work(x, y)`` over the parts of ``dealt``, added up in their order; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, bytes, bool]] = []
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "y")), strict=True))
        for r in chain(rows, [None]):
            if waiting and (r is None or r[0] != waiting[0][0]):
                x = np.frombuffer(b"".join(w[1] for w in waiting), np.float32).reshape(-1, width).astype(float)
                yield row_of(waiting[0][0], work(x, np.array([w[2] for w in waiting], float)))
                waiting.clear()
            if r is not None:
                waiting.append(r)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("sums").to_pylist():
                total = np.frombuffer(data) if total is None else total + np.frombuffer(data)
        if total is not None:
            yield row_of(0, total)

    ddl = "chunk int, sums binary"
    found = dealt.mapInArrow(run, ddl).repartition(1).sortWithinPartitions("chunk").mapInArrow(add, ddl).collect()
    return np.frombuffer(found[0].sums) if found else None


def start(width: int) -> tuple[np.random.Generator, list[np.ndarray]]:
    """The random numbers of every part, and the weights that the first round starts from."""
    rng = np.random.default_rng(SEED)
    return rng, [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]


def split(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n rows of a part those that are kept for the temperature, one of five, and those to train on."""
    order = rng.permutation(n)
    return order[: n // 5], order[n // 5 :]


def unpacked(state: np.ndarray, width: int) -> list[list[np.ndarray]]:
    """Views of the weights, of Adam's two moments, and the steps so far."""
    shapes = [(width, HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]
    parts = np.split(state, np.cumsum([int(np.prod(s)) for s in shapes * 3]))
    views = [p.reshape(s) for p, s in zip(parts, shapes * 3)]
    return [views[:4], views[4:8], views[8:], [parts[-1]]]


def train_part(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, state: np.ndarray, done: int) -> np.ndarray:
    """A round's epochs of Adam on a part after ``done`` rounds: the new state times the rows trained on, and their number."""
    rng, _ = start(x.shape[1])
    _, train = split(rng, len(x))
    z, own, each = (x - mean) / scale, state.copy(), EPOCHS // ROUNDS
    w, moment, second, (step,) = unpacked(own, x.shape[1])
    for _ in range(done * each):
        rng.shuffle(train)
    for _ in range(each):
        rng.shuffle(train)
        for i in range(0, len(train), BATCH):
            at = train[i : i + BATCH]
            h = np.tanh(z[at] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -500, 500))) - y[at]) / len(at)
            back = error[:, None] * w[2] * (1 - h * h)
            step += 1
            for p, g, m, v in zip(w, (z[at].T @ back, back.sum(0), h.T @ error, error.sum(keepdims=True)), moment, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * p)
    return np.append(own * len(train), len(train))


def losses(x: np.ndarray, y: np.ndarray, net: Network) -> np.ndarray:
    """The loss of a part's rows that were kept from training, at each temperature."""
    kept, _ = split(start(x.shape[1])[0], len(x))
    logits = net.logits(x[kept])
    return np.array([np.logaddexp(0, np.where(y[kept] > 0.5, -1, 1) * logits / t).sum() for t in TRIED])


def fit(dealt: DataFrame, width: int) -> Network:
    """Train by Adam on four of five rows of each part, then fit the temperature on the fifth.

    ``dealt`` has ``part int, x binary, y boolean``, rows of a part one after another in one
    partition. With labels of one kind, or none, every score is the smoothed share of label 1.
    """
    sums = by_part(dealt, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(axis=0), np.square(x).sum(axis=0)]), width)
    n, ones = (0, 0) if sums is None else sums[:2]
    mean, scale = np.zeros(width), np.ones(width)
    if n:
        mean = sums[2 : 2 + width] / n
        scale = np.sqrt(np.maximum(sums[2 + width :] / n - mean * mean, 0)) + 1e-6
    _, w = start(width)
    if ones in (0, n):
        prior = (ones + 1) / (n + 2)
        return Network(mean, scale, np.zeros_like(w[0]), w[1], np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
    first = np.concatenate([p.ravel() for p in w])
    state = np.concatenate([first, np.zeros(2 * len(first) + 1)])
    for done in range(ROUNDS):
        found = by_part(dealt, partial(train_part, mean=mean, scale=scale, state=state, done=done), width)
        state = found[:-1] / found[-1]
    w = unpacked(state, width)[0]
    net = Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))
    net.temperature = float(TRIED[int(np.argmin(by_part(dealt, partial(losses, net=net), width)))]) if n >= 5 else 1.0
    return net


def labelled_spots(labels: DataFrame) -> np.ndarray:
    """SPOTS bits, eight a byte, of which those at the hashes of the ids of ``labels`` are set."""
    at = spot_of() + 1  # bitmaps count from 1
    rows = labels.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    found = np.zeros(SPOTS // 8, np.uint8)
    for r in rows:
        found[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return found


def spot_of() -> Column:
    """The spot of an id."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SPOTS))


def train(docs: DataFrame, labels: DataFrame, part_rows: int = PART_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs`` and the network from all its rows with labels.

    ``labels`` has ``doc_id, quality``. Tasks know by a bitmap of fixed size which ids may have a
    label, pool those documents alone, and send their vectors to the labels; no text is shuffled.
    """
    table = pooled_table(word_vectors(docs))
    width = table.shape[1] + 3
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    shared = docs.sparkSession.sparkContext.broadcast((table, labelled_spots(named)))
    out = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])

    def make():
        alone("quality_model", _known.clear)
        vectors, bits = shared.value

        def apply(batch):
            at = batch.column("spot").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            texts = texts_of(batch)
            for a, b in blocks([len(t) + 2000 for t in texts]):
                x = [row.astype(np.float32).tobytes() for row in pool(texts[a:b], vectors)]
                yield [batch.column("doc_id").slice(a, b - a), x]

        return apply

    known = docs.where("doc_id IS NOT NULL").withColumn("spot", spot_of())
    pooled = by_batch(known, ["doc_id", "text", "spot"], out, "doc_id long, x binary", make)
    first = pooled.groupBy("doc_id").agg(F.min("x").alias("x"))  # repeated rows of an id: one
    rows = cut(first.join(named, "doc_id").select("doc_id", "x", (F.col("quality") >= 0.5).alias("y")))
    parts = max(1, -(-rows.count() // part_rows))
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(parts)).cast("int").alias("part")
    dealt = cut(rows.select(part, "doc_id", "x", "y").repartition(parts, "part").sortWithinPartitions("part", "doc_id"))
    return table, fit(dealt.drop("doc_id").coalesce(parts), width)


def score(docs: DataFrame, table: np.ndarray, network: Network) -> DataFrame:
    """``doc_id, score`` for every row of ``docs`` (``doc_id, text``).

    A null or empty text has pooled zeros and a score like any other; a null doc_id stays null;
    repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, network))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make():
        alone("quality_model", _known.clear)
        vectors, net = shared.value

        def apply(batch):
            texts = texts_of(batch)
            for a, b in blocks([len(t) + 2000 for t in texts]):
                yield [batch.column("doc_id").slice(a, b - a), net.score(pool(texts[a:b], vectors))]

        return apply

    return by_batch(docs, ["doc_id", "text"], out, "doc_id long, score double", make)


def keep_good(docs: DataFrame, table: np.ndarray, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``.

    Null and empty texts are scored like others; null ids, repeated rows and empty tables pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("quality_model", _known.clear)
        vectors, net = shared.value
        for batch in batches:
            yield batch.filter(pa.array(net.score(pool(texts_of(batch), vectors)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
