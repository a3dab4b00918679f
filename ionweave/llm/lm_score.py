"""Cross-entropy difference between a target and a background language model.

Both models are word trigram models over one open vocabulary: every word of the corpus. The
background is counted over all documents, the target over those that are chosen. A trigram's
probability falls back on its bigram's, that on its word's, by a Dirichlet prior; the prior of
the background is larger by the ratio of the two corpora, so that smoothing weighs the same in
both. A document's own counts are left out of the models that it was counted in. Its score is
the mean over its tokens of the target's loss less the background's: lower means more like
the target.

Counting and scoring share one exchange. Documents are dealt into groups of a few MB by a hash
of id and text, compressed together as they go. A group makes its different n-grams, as hashes
with the group's counts, and sends them in ranges of hashes: one row for each range. Where a
range's rows meet, counts are added up over the corpus, and each row is answered with the sums
of its n-grams. The answers go back to the group, whose documents wait in the same exchange
that counted them. All this grows with the input and nothing of it passes the driver, which
sees five sums.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import ASCII_SPACE, WORD_PATTERN, by_batch, cut, word_hashes

#: Words that the smoothing of single words makes room for, and tokens that a prior weighs.
NOMINAL, PRIOR = 1 << 20, 5.0
#: Bytes of text of a group of documents, and of the text whose n-grams a range of hashes takes.
GROUP_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
#: Hashes of the document's begin and end, of what stands before its first word, and a multiplier.
END, BEGIN, BEFORE = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_MIX, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bits of a hash that are told apart within a range, and the most that a step from one hash to the next takes in four bytes.
BITS, STEP = 40, (1 << 32) - 1
#: Of every byte, whether it is part of a word, and its small letter.
_INSIDE = np.array([chr(b) not in ASCII_SPACE for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its history and its last word."""
    return (before ^ (before >> np.uint64(29))) * _MIX + word * _WORD


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(3, tokens): hashes of the word, bigram and trigram that end at each token, and how many tokens each text has.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Every text with words has an end token.
    """
    hashes, sizes = word_hashes(texts, lambda t: np.frombuffer(t, np.uint8), _INSIDE, _LOWER)
    sizes += sizes > 0
    stops = np.cumsum(sizes)
    words = np.full(sizes.sum(), END)
    at = np.ones(len(words), bool)
    at[stops[sizes > 0] - 1] = False
    words[at] = hashes
    firsts = (stops - sizes)[sizes > 0]
    two = _joined(_before(words, firsts, BEGIN), words)
    return np.stack([words, two, _joined(_before(two, firsts, BEFORE), words)]), sizes


def _before(x: np.ndarray, firsts: np.ndarray, start) -> np.ndarray:
    """Each token's predecessor, ``start`` for the first of a text."""
    out = np.concatenate([x[:1], x[:-1]])
    out[firsts] = start
    return out


def ranges(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted hashes lie in, and where each one's begin and end."""
    found, begins = np.unique((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), return_index=True)
    return found.astype(np.int64), np.append(begins, len(hashes))


def pack_hashes(hashes: np.ndarray, place: int, n: int) -> bytes:
    """The distance of sorted hashes from the begin of their range of ``n``, in BITS bits: steps of four bytes.

    Where a step is too long for that, eight bytes each, after a byte that says so.
    """
    low = np.uint64(-(-(place << 32) // n) << 32)
    steps = np.diff((hashes - low) >> np.uint64(max(0, 65 - BITS - (n.bit_length() - 1))), prepend=np.uint64(0))
    small = bool(len(steps) == 0 or steps.max() <= STEP)
    return bytes([small]) + steps.astype("<u4" if small else "<u8").tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4" if data[0] else "<u8", offset=1).astype(np.uint64))


def pack_pairs(one: np.ndarray, other: np.ndarray) -> bytes:
    """Pairs of counts: a byte where both are under 15, 255 where two two-byte numbers follow, in these 65,535 where four-byte ones do."""
    most = np.maximum(one, other)
    large, huge = most >= 15, most >= 65535
    head = np.where(large, 255, np.minimum(one, 15) << 4 | np.minimum(other, 15)).astype(np.uint8)
    pairs = np.stack([one, other], axis=1)
    middle = np.where(huge[:, None], 65535, pairs)[large].astype("<u2")
    return head.tobytes() + middle.tobytes() + pairs[huge].astype("<u4").tobytes()


def unpack_pairs(data: bytes, n: int) -> np.ndarray:
    """(2, n): what ``pack_pairs`` was given."""
    head = np.frombuffer(data, np.uint8, n)
    large = head == 255
    out = np.stack([head >> 4, head & 15]).astype(np.int64)
    middle = np.frombuffer(data, "<u2", 2 * int(large.sum()), n).reshape(-1, 2).astype(np.int64)
    huge = middle[:, 0] == 65535
    middle[huge] = np.frombuffer(data, "<u4", 2 * int(huge.sum()), n + 2 * middle.size).reshape(-1, 2)
    out[:, large] = middle.T
    return out


class Group:
    """The documents of one group, and which of them are chosen."""

    def __init__(self, table: pa.Table):
        packed = [x for x in table.column("docs").to_pylist() if x is not None]
        parts = [pickle.loads(zstandard.decompress(x)) for x in packed]
        self.ids = pa.array([i for ids, _ in parts for i in ids], pa.int64())
        chosen = set(table.column("chosen").to_pylist()) - {None}
        self.chosen = np.array([i in chosen for i in self.ids.to_pylist()], bool)
        self.grams, self.sizes = ngrams([t for _, texts in parts for t in texts])
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)


def counted(group: Group, n: int):
    """Rows of ``place, hashes, counts`` with the n-grams of a group: how often they are in all, and in the chosen."""
    hashes, counts = np.unique(group.grams, return_counts=True)
    chosen = np.zeros(len(hashes), np.int64)
    mine, times = np.unique(group.grams[:, group.chosen[group.owner]], return_counts=True)
    chosen[np.searchsorted(hashes, mine)] = times
    places, cuts_ = ranges(hashes, n)
    for place, a, b in zip(places.tolist(), cuts_, cuts_[1:]):
        yield place, pack_hashes(hashes[a:b], place, n), pack_pairs(counts[a:b], chosen[a:b])


def losses(group: Group, found: np.ndarray, totals: tuple[int, int, int, int]) -> np.ndarray:
    """(documents, 2): each one's mean loss under the target and under the background.

    ``found`` has two rows of sums over the corpus, of chosen and of all documents, for each
    different n-gram of the group in the order of the hashes; ``totals`` are tokens and
    documents of the chosen, and of all.
    """
    hashes, place = np.unique(group.grams, return_inverse=True)
    place = place.reshape(group.grams.shape)
    _, same, times = np.unique(group.owner * len(hashes) + place, return_inverse=True, return_counts=True)
    own = times[same].reshape(place.shape)
    firsts = (np.cumsum(group.sizes) - group.sizes)[group.sizes > 0]
    out = np.zeros((len(group.sizes), 2))
    priors = PRIOR, PRIOR * max(1.0, totals[2] / max(1, totals[0]))
    for m, prior in enumerate(priors):
        counted_in = group.chosen[group.owner] if m == 0 else np.ones(len(group.owner), bool)
        seen = np.maximum(found[m][place] - own * counted_in, 0)  # without the document's own
        tokens, docs = totals[2 * m] - group.sizes[group.owner] * counted_in, totals[2 * m + 1] - counted_in
        p = (seen[0] + 1) / (np.maximum(tokens, 0) + NOMINAL)
        for k in (1, 2):
            history = _before(seen[k - 1], firsts, 0)
            history[firsts] = np.maximum(docs[firsts], 0)
            p = (np.minimum(seen[k], history) + prior * p) / (history + prior)
        out[:, m] = np.bincount(group.owner, -np.log(p), len(group.sizes)) / np.maximum(group.sizes, 1)
    return out


def score(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` for every row of ``docs`` (``doc_id, text``).

    ``chosen`` has the ``doc_id`` of the target's documents. Losses are means over the words and
    an end token, in nats; ``n_tokens`` counts the words. A null or empty text, or one of white
    space, has no words and zeros, and is not counted; a null doc_id stays null and is never
    chosen; repeated rows give repeated rows and count each; other columns are ignored; an empty
    table gives no rows, and without chosen documents the target knows no word.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("words")
    known = chosen.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    # ids only are joined: by merging at any size, and texts stay where they are
    small = docs.select("doc_id", "h", words, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    marked = small.join(known.hint("merge"), F.col("doc_id") == F.col("_id"), "left").withColumn("chosen", F.col("_id").isNotNull())
    marked = cut(marked.select("doc_id", "h", "words", "size", "chosen"))
    full, mine = F.col("words") > 0, F.col("chosen")
    sums = (
        F.sum(F.when(full & mine, F.col("words") + 1)), F.count_if(full & mine), F.sum(F.when(full, F.col("words") + 1)), F.count_if(full),
        F.sum("size"),
    )
    *totals, size = (x or 0 for x in marked.agg(*sums).first())
    n_groups, n_ranges = (max(1, -(-size // most)) for most in (GROUP_BYTES, RANGE_BYTES))
    group = F.pmod("h", F.lit(n_groups)).alias("g")
    flags = marked.where("chosen").select(group, F.lit(None).cast("binary").alias("docs"), F.col("doc_id").alias("chosen"))
    dealt = _packed(docs.select(group, "doc_id", "text")).withColumn("chosen", F.lit(None).cast("long")).unionByName(flags)
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = [(key[0].as_py(), *r) for r in counted(Group(table), n_ranges)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, sent, strict=True)], schema=sent)

    def answer(table: pa.Table) -> pa.Table:
        hashes = [unpack_hashes(x) for x in table.column("hashes").to_pylist()]
        sizes = list(map(len, hashes))
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        each = np.hstack([unpack_pairs(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        whole = np.stack([np.bincount(place, x).astype(np.int64)[place] for x in each])
        packed = [pack_pairs(*x) for x in np.split(whole, np.cumsum(sizes)[:-1], axis=1)]
        return pa.Table.from_arrays([table.column("g"), table.column("place"), pa.array(packed, pa.binary())], schema=back)

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Group(table)
        hashes = np.unique(own.grams)
        places, cuts_ = ranges(hashes, n_ranges)
        got = dict(zip(answers.column("place").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        found = [unpack_pairs(got[p], b - a) for p, a, b in zip(places.tolist(), cuts_, cuts_[1:])]
        sums_ = np.hstack([np.zeros((2, 0), np.int64), *found])
        both = losses(own, sums_[::-1], tuple(totals))
        return pa.Table.from_arrays([own.ids, pa.array(np.maximum(own.sizes - 1, 0)), *map(pa.array, (*both.T, both[:, 0] - both[:, 1]))], schema=out)

    sent = pa.schema([("g", pa.int64()), ("place", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    back = pa.schema([("g", pa.int64()), ("place", pa.int64()), ("counts", pa.binary())])
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.float64()) for c in ("target_loss", "background_loss", "score"))])
    counts = dealt.groupBy("g").applyInArrow(count, "g long, place long, hashes binary, counts binary")
    answers = counts.groupBy("place").applyInArrow(answer, "g long, place long, counts binary")
    both = dealt.groupBy("g").cogroup(answers.groupBy("g"))
    return both.applyInArrow(judge, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def _packed(docs: DataFrame) -> DataFrame:
    """``g, docs``: the ids and texts of the rows of an Arrow batch that are of one group, compressed together."""
    out = pa.schema([("g", pa.int64()), ("docs", pa.binary())])

    def make():
        compress = zstandard.ZstdCompressor(level=1).compress

        def apply(batch):
            groups: dict[int, tuple[list, list]] = {}
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for g, i, text in zip(batch.column("g").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                ids, mine = groups.setdefault(g, ([], []))
                ids.append(i)
                mine.append(text or b"")
            yield [list(groups), [compress(pickle.dumps(x)) for x in groups.values()]]

        return apply

    return by_batch(docs, ["g", "doc_id", "text"], out, "g long, docs binary", make)
