"""SimHash fingerprints, multi-index hashing over their segments, and classes of near copies.

A fingerprint of k words of 64 bits is the bitwise majority of its features' hashes. Pairs
within a small Hamming distance are found by segments: if two fingerprints differ in few bits,
some segment differs in fewer, so that one fingerprint's table entry lies in a small Hamming
ball around the other's segment. Of two segments that differ in one bit one has a 0 there and
the other a 1, so it is enough to enumerate the flips from 0 to 1.

``links`` is exact. ``near_groups`` uses them on fingerprints of five-word shingles, and verifies each
link by the shingles themselves; texts that are similar enough but further apart in their
fingerprints it finds by the rarest of their shingles, so that it is exact too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import blocks, by_batch, cut, release, row_of, small_batches, summed, texts_of, unused

SEED = 42
#: Features of a text whose bits are counted at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, A-Z lower-cased; fewer words make one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return np.empty(0, np.uint64)
    hash_ = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([hash_(joined, seed)], np.uint64)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = len(words) - size + 1
    spans = zip(starts[:n].tolist(), stops[size - 1 :].tolist())
    return np.fromiter((hash_(joined[a:b], seed) for a, b in spans), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) for every row of ``docs``, from shingles with repeats.

    A null or empty text has fingerprint 0; a null doc_id stays null; repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows.
    """
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make():
        def apply(batch):
            texts = texts_of(batch)
            for a, b in blocks([len(t) + 20 for t in texts]):
                found = np.array([majority(shingle_hashes(t, size)) for t in texts[a:b]], np.uint64)
                yield [batch.column("doc_id").slice(a, b - a), pa.array(found.view(np.int64))]

        return apply

    return by_batch(docs, ["doc_id", "text"], out, "doc_id long, fp long", make)


def _part(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(value: Column, bits: int) -> Column:
    """The values with one bit more than ``value``, as an array."""
    flips = F.array(*(F.lit(1 << i) for i in range(bits)))
    return F.transform(F.filter(flips, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m))


def _keys(fp: Column, tag: int) -> tuple[Column, list[Column]]:
    """The table entry of one half and one of the other half's halves, and arrays of probes for it."""
    first, rest = (32, 0) if tag < 2 else (0, 32)
    half, quarter = _part(fp, first, 32), _part(fp, rest + 16 * (tag % 2), 16)

    def key(half_: Column, quarter_: Column) -> Column:
        return F.struct(F.lit(tag).cast("byte").alias("tag"), F.shiftleft(half_, 16).bitwiseOR(quarter_).alias("key"))

    probes = [F.array(key(half, quarter)), F.transform(_ball(quarter, 16), lambda q: key(half, q))]
    if tag < 2:
        probes.append(F.transform(_ball(half, 32), lambda h: key(h, quarter)))
    return key(half, quarter), probes


def links(fps: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of different fingerprints of ``fps`` (column ``fp``, distinct) with 1 or 2 differing bits.

    The halves are the segments: one of them, H, differs in at most one bit. So that many
    fingerprints may share a half, a bucket is indexed again by the other half's halves:
    if H is equal, one of those differs in at most one bit; if H differs in one bit, one of them
    is equal. A bucket's key has 48 bits, so it holds a handful of different fingerprints
    however many there are, and complete distances are verified inside the join.
    """
    entries, probes = [], []
    for tag in range(4):
        entry, asked = _keys(F.col("fp"), tag)
        entries.append(entry)
        probes += asked
    table = fps.select(F.col("fp").alias("a"), F.inline(F.array(*entries)))
    asked = fps.select(F.col("fp").alias("b"), F.inline(F.concat(*probes)))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return (  # Spark sizes a row's entries and probes, some 70, as the row: it would broadcast what fits no driver
        table.join(asked.hint("merge"), (table.tag == asked.tag) & (table.key == asked.key) & (F.col("a") != F.col("b")) & (differ <= 2))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (columns ``a, b``): the smallest node reachable.

    Large-star and small-star steps alternate until no edge changes. Each step is a grouped
    minimum, which is combined before the shuffle, and an equi-join; each round is cut by a
    checkpoint, and the files of the round before go. Only a count and a sum come to the driver.
    """
    work, before = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    while True:  # a > b in every edge
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node go to the smallest of its neighbours and itself
        least = both.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = work.join(least, "b").select("a", F.col("m").alias("b"))
        # small star: smaller neighbours of a node, and it, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        work = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        del both, least, large, low, small
        release(work.sparkSession)
        now = work.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    out = work.groupBy("a").agg(F.min("b").alias("root"))
    return out.select(F.col("a").alias("node"), "root").unionByName(
        work.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def classes(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable over links of at most two bits.

    Exact copies of a fingerprint are merged first, so a large group of copies is one node.
    Rows whose doc_id is null take part: their component is the smallest id that is not null,
    or null if there is none.
    """
    marked = cut(fingerprints(docs, size))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = cut(links(nodes.select("fp")))
    rooted = components(pairs).withColumnRenamed("node", "fp")
    joined = nodes.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# --- near copies of texts ---------------------------------------------------------------

#: Words of a shingle and least Jaccard similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Cells in which shingles are counted to set their order. Any order gives the same pairs; with more cells there are fewer candidates.
ORDER_CELLS, ORDER_CHUNK = 1 << 20, 1 << 16
#: Longs of a text's parities: in each bit, whether an odd number of its shingles fall there.
PARITIES = 8
#: Longs that travel with every token: parities of two places of the above together.
FOLDED = PARITIES // 2
#: Bits of the filter of the texts whose shingles are asked for, 4 MiB.
FILTER_BITS = 1 << 25
#: Candidate pairs of an output batch.
PAIRS = 1 << 16


def shingle_set(text: str) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(text, SHINGLE))


def shingle_order(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each cell occur, over all texts."""

    def count(batches):
        sums = np.zeros(ORDER_CELLS, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                np.add.at(sums, (shingle_set(text) % ORDER_CELLS).astype(np.int64), 1)
        for chunk in range(0, ORDER_CELLS, ORDER_CHUNK):
            yield row_of(chunk, np.minimum(sums[chunk : chunk + ORDER_CHUNK], 1 << 30).astype(np.int32))

    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, "chunk int, sums binary")
    found = np.zeros(ORDER_CELLS, np.int32)
    for r in summed(parts, np.int32, ORDER_CELLS // ORDER_CHUNK).toLocalIterator():
        found[r.chunk : r.chunk + ORDER_CHUNK] = np.frombuffer(r.sums, np.int32)
    return found


def prefix(tokens: np.ndarray, order: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a text's shingles, so many that texts at ``similarity`` have one of them in common.

    Two sets that agree that well share at least similarity * n of the n shingles of either, so
    not all of the first n - ceil(similarity * n) + 1 of each, in one order, can be missing in the other.
    """
    n = len(tokens)
    size = n - int(np.ceil(similarity * n - 1e-9)) + 1
    return tokens[np.lexsort((tokens, order[(tokens % ORDER_CELLS).astype(np.int64)]))[:size]]


def parities(tokens: np.ndarray) -> np.ndarray:
    """The parities of a text. Two texts' differ in no more bits than there are shingles that only one of them has."""
    found = np.bincount((tokens >> np.uint64(32)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(found.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(n, m, similarity: float):
    """How many shingles only one of two texts may have, at most, if they are so similar."""
    return (n + m) * (1 - similarity) / (1 + similarity) + 1e-9


def _close(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be so similar."""
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9


def _columns(x: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], names)


def shared_tokens(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows (``token, h, place``) whose token another row has, with the ``first`` and the ``previous`` handle of it.

    ``place`` has the size of the row's set and the token's position. Where the sizes of the two
    sets are too different, the row's own handle stands there.
    """
    names = ["token", "h", "place", "first", "previous"]

    def run(batches):
        held = None  # the last row, not yet put out; the first of its token; whether it is not the first
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns])
            if not len(x):
                continue
            head = None
            if held is not None:
                x, head = np.vstack([held[0], x]), held
            same = np.concatenate([[False], x[1:, 0] == x[:-1, 0]])
            at = np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
            first, previous = x[at], np.vstack([x[:1], x[:-1]])
            if head is not None:
                first[at == 0] = head[1]
                same[0] = head[2]
                previous[0] = x[0]
                if head[2]:
                    previous[0] = head[3]
            held = x[-1], first[-1], bool(same[-1]), previous[-1]
            take = np.flatnonzero(same[:-1] | (x[1:, 0] == x[:-1, 0]))
            yield put(x[take], first[take], previous[take], same[take])
        if held is not None and held[2]:
            yield put(*(np.array([v]) for v in (held[0], held[1], held[3], held[2])))

    def put(x, first, previous, same):
        own, n = x[:, 1], x[:, 2] >> 32
        others = [np.where(same & _close(n, y[:, 2] >> 32, similarity), y[:, 1], own) for y in (first, previous)]
        return _columns(np.column_stack([x, *others]), names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("token", "h", "place").repartition(n, "token").sortWithinPartitions("token", "h")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def pairs_between(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a < b`` of handles of ``rows`` (``token, c, h, place`` and FOLDED longs of parities, ``b0`` and so on) with a token in common and different ``c``.

    Left out are pairs whose sizes, parities or places of the token show that they are less similar; the
    first token that a pair has in common shows that of no pair that is similar enough.
    """

    def cross(x):
        stops = np.flatnonzero(np.concatenate([x[1:, 0] != x[:-1, 0], [True]])) + 1
        end = stops[np.searchsorted(stops, np.arange(len(x)), "right")]
        runs = np.flatnonzero(np.concatenate([(x[1:, :2] != x[:-1, :2]).any(axis=1), [True]])) + 1
        to = runs[np.searchsorted(runs, np.arange(len(x)), "right")]  # the first row with another c
        i, j, found, total = np.arange(len(x)), to, [], 0
        while True:
            alive = j < end[i]
            i, j = i[alive], j[alive]
            if not len(i):
                break
            n, m = x[i, 3] >> 32, x[j, 3] >> 32
            least = similarity / (1 + similarity) * (n + m) - 1e-9
            ok = _close(n, m, similarity) & (np.minimum(n - (x[i, 3] & 0xFFFFFFFF), m - (x[j, 3] & 0xFFFFFFFF)) >= least)
            p, q = i[ok], j[ok]
            differ = np.bitwise_count((x[p, 4:] ^ x[q, 4:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            ok = differ <= _apart(n[ok], m[ok], similarity)
            found.append(np.sort(np.column_stack([x[p[ok], 2], x[q[ok], 2]]), axis=1))
            total += len(found[-1])
            if total > PAIRS:
                yield np.unique(np.vstack(found), axis=0)
                found, total = [], 0
            j = j + 1
        if total:
            yield np.unique(np.vstack(found), axis=0)

    def run(batches):
        held = []  # rows of the token that is not complete
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns])
            if not len(x):
                continue
            last = int(np.searchsorted(x[:, 0], x[-1, 0]))
            if last or (held and held[-1][-1, 0] != x[0, 0]):
                for pairs in cross(np.vstack([*held, x[:last]])):
                    yield _columns(pairs, ["a", "b"])
                held = []
            held.append(x[last:])
        if held:
            for pairs in cross(np.vstack(held)):
                yield _columns(pairs, ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("token", "c", "h", "place", *(f"b{k}" for k in range(FOLDED))).repartition(n, "token").sortWithinPartitions("token", "c")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _digest():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("digest")


def _prefixes(docs: DataFrame, similarity: float) -> DataFrame:
    """``digest, doc_id, n, tokens, bits, fp``: how many different shingles a text has, its prefix, parities and fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_order(docs))  # of fixed size
    longs = pa.list_(pa.int64())
    out = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", longs), ("bits", longs), ("fp", pa.int64())])

    def make():
        order = shared.value

        def apply(batch):
            texts = texts_of(batch)
            for a, b in blocks([2 * len(t) + 50 for t in texts]):
                hashes = [shingle_hashes(t, SHINGLE) for t in texts[a:b]]
                fps = np.array(list(map(majority, hashes)), np.uint64).view(np.int64)
                sets = list(map(np.unique, hashes))
                tokens = [prefix(s, order, similarity).view(np.int64) for s in sets]
                bits = [parities(s) for s in sets]
                yield [batch.column("digest").slice(a, b - a), batch.column("doc_id").slice(a, b - a), [len(s) for s in sets], tokens, bits, pa.array(fps)]

        return apply

    marked = docs.select("doc_id", "text", _digest())
    ddl = "digest binary, doc_id long, n long, tokens array<long>, bits array<long>, fp long"
    return by_batch(marked, ["digest", "doc_id", "text"], out, ddl, make)


def _filter_of(handles: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with one bit for each handle (column ``h``)."""
    spot = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    words = handles.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(one).alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    found = np.zeros(FILTER_BITS // 64, np.int64)
    found[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return found


def _shingle_sets(docs: DataFrame, handles: DataFrame) -> DataFrame:
    """``h, digest, shingles``: the different shingles of each text with one of the handles, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(handles))  # of fixed size
    out = pa.schema([("h", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary())])

    def make():
        def apply(batch):
            h = batch.column("h").to_numpy()
            spot = h & (FILTER_BITS - 1)
            batch = batch.filter(pa.array(shared.value[spot >> 6] >> (spot & 63) & 1 == 1))
            texts = texts_of(batch)
            for a, b in blocks([2 * len(t) + 50 for t in texts]):
                own = batch.slice(a, b - a)
                yield [own.column("h"), own.column("digest"), [shingle_set(t).tobytes() for t in texts[a:b]]]

        return apply

    marked = docs.select("text", _digest()).withColumn("h", F.xxhash64("digest"))
    made = by_batch(marked, ["h", "digest", "text"], out, "h long, digest binary, shingles binary", make)
    return made.repartition("h").dropDuplicates(["h", "digest"])  # dealt by h, as the joins need it


def similar(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the digests of those ``pairs`` of handles whose shingles are so similar."""
    sets = _shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("h")))
    left = sets.select(F.col("h").alias("a"), F.col("digest").alias("x"), F.col("shingles").alias("s"))
    right = sets.select(F.col("h").alias("b"), F.col("digest").alias("y"), F.col("shingles").alias("t"))

    def compare(batches):
        for batch in batches:
            x, y, s, t = (batch.column(c).to_pylist() for c in ("x", "y", "s", "t"))
            good = []
            for i, (p, q) in enumerate(zip(s, t, strict=True)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both and both >= similarity * (len(p) + len(q) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.binary()), pa.array([y[i] for i in good], pa.binary())], ["a", "b"])

    return cut(pairs.join(left, "a").join(right, "b").select("x", "y", "s", "t").mapInArrow(compare, "a binary, b binary"))


def possible(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` of handles that are not ruled out by their sizes and parities in ``found``."""
    for k in ("a", "b"):
        own = found.select(F.col("h").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
        pairs = pairs.join(own.hint("merge"), k)  # Spark sizes an array as one of its elements
    differ = sum(F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(PARITIES))
    return cut(pairs.where(differ <= _apart(F.col("n_a"), F.col("n_b"), similarity)).select("a", "b"))


def fingerprint_pairs(found: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of handles of ``found`` (``h, fp``) whose fingerprints are linked: a row for each text and for each link of fingerprints."""
    nodes = found.groupBy("fp").agg(F.min("h").alias("least"))
    same = found.join(nodes, "fp").select(F.col("least").alias("a"), F.col("h").alias("b")).where("a <> b")
    at = [nodes.select(F.col("fp").alias(k), F.col("least").alias(f"h_{k}")) for k in ("a", "b")]
    return same.unionByName(links(nodes.select("fp")).join(at[0], "a").join(at[1], "b").select(F.col("h_a").alias("a"), F.col("h_b").alias("b")))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``digest, doc_id, keep``: one row for each different text, with the least id that has it.

    ``keep`` is false for a text that is linked to one with a smaller id, over pairs whose
    five-word shingles have a Jaccard similarity of at least ``similarity``. Exact copies are
    one text. A null text counts as empty; an id that is null comes after all others.

    Fingerprints are linked first (``links``); then texts that have a shingle of their prefixes in
    common are candidates, each with the first and the previous one. All these are verified, and
    join a large group by few pairs. At last all pairs with a common shingle of their prefixes
    are looked at that these links have not joined, so that none is missed.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("r")
    same = [F.min(c).alias(c) for c in ("n", "tokens", "bits", "fp")]
    found = _prefixes(docs, similarity).groupBy("digest").agg(least, *same)
    found = cut(found.select("digest", "r.doc_id", "n", "tokens", "bits", "fp", F.xxhash64("digest").alias("h")))
    reps = found.select("digest", "doc_id", "h")
    place = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("pos").cast("long")).alias("place")
    rows = found.select("h", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "h", place)
    shared = cut(shared_tokens(rows, similarity))
    met = shared.select("h", F.explode(F.array("first", "previous")).alias("o")).where("h <> o").select(F.col("h").alias("a"), F.col("o").alias("b"))
    near = met.unionByName(fingerprint_pairs(found.select("h", "fp")))
    near = possible(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), found, similarity)
    release(docs.sparkSession)
    rooted = cut(components(similar(docs, near, similarity)))
    release(docs.sparkSession)
    joined = rooted.select(F.xxhash64("node").alias("h"), F.xxhash64("root").alias("c"))
    folded = [F.col("bits")[k].bitwiseXOR(F.col("bits")[k + FOLDED]).alias(f"b{k}") for k in range(FOLDED)]
    own = found.select("h", *folded).join(joined, "h", "left").withColumn("c", F.coalesce("c", "h"))
    # shared has a row for each token of a text and is sized as if it had one for each text
    rest = pairs_between(shared.select("token", "h", "place").join(own.hint("merge"), "h"), similarity).join(near, ["a", "b"], "left_anti")
    rest = possible(rest, found, similarity)
    release(docs.sparkSession)
    edges = similar(docs, rest, similarity)
    for k in ("a", "b"):  # between the components so far
        edges = edges.withColumnRenamed(k, "node").join(rooted, "node", "left").withColumn(k, F.coalesce("root", "node")).drop("node", "root")
    more = components(edges).select(F.col("node").alias("root"), F.col("root").alias("last"))
    named = reps.select("digest", "doc_id").join(rooted.withColumnRenamed("node", "digest"), "digest", "left")
    named = named.withColumn("root", F.coalesce("root", "digest")).join(more, "root", "left").withColumn("root", F.coalesce("last", "root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("r"))
    joined = named.join(first, "root")
    return joined.select("digest", "doc_id", (F.col("digest") == F.col("r.digest")).alias("keep"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group of near copies stays.

    The row with the least doc_id stays; of rows with its id and text, any one.
    """
    own, digest, id_ = unused(docs, 3)
    kept = near_groups(docs, similarity).where("keep").select(F.col("digest").alias(digest), F.col("doc_id").alias(id_))
    marked = docs.withColumn(own, _digest())
    match = (F.col(own) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(id_))
    left = marked.join(kept, match, "left_semi")
    ids = docs.select("doc_id", _digest())
    total, distinct = ids.agg(F.count("*"), F.count_distinct(F.xxhash64("doc_id", F.col("digest")))).first()
    if total != distinct:
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)
