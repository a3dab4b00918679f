"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words in three lengths. Their TF-IDF vectors over hashed words are
projected on the leading right singular vectors of the passages of all different texts and
items, found by a distributed randomised SVD (Nyström's form); document frequencies are counted
over all documents. Every window of every
document is compared with the passages of items of about its length by cosine; an item that is
longer than the longest window has several passages. Windows above a low threshold are
candidates; the longest common subsequence of the whole item's words decides, together with
a check whether the item's answer, its last sentence, is there where the wording is looser.

Tasks make the items ready in blocks of a fixed number and write them to the shared folder; a
worker that searches holds few of them at a time, however long the benchmark is.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import alone, by_batch, cut, fresh_folder, points_of, release, row_of, small_batches, summed, texts_of, word_hashes, word_points

FEATURES, RANK, OVERSAMPLE, POWER, SEED = 1 << 13, 96, 8, 1, 11
#: Leading directions that are left out: they hold the words that all passages share.
SKIP = 16
WINDOWS = (16, 32, 64)
#: Words of a passage that the projection is fitted on, passages of a row, and about how many a task takes.
PASSAGE, ROW_PASSAGES, TASK_PASSAGES = WINDOWS[1], 4096, 1 << 18
#: Cosine of a candidate; share of an item's words in order that is a leak, or that is one if
#: the answer's share is found as well.
CANDIDATE, LEAK, LOOSE, ANSWER = 0.6, 0.8, 0.5, 0.8
#: Items of a block, and blocks that a worker keeps.
BLOCK_ITEMS, BLOCKS = 5000, 2
#: Features whose sums travel in a row, so that many tasks share the adding up.
CHUNK = 512
#: Words that are searched together: their vectors' sums stay in the cache of a core.
TOGETHER = 1 << 13

def hashed(texts: list[str]) -> list[np.ndarray]:
    """The hash of each word of each text."""
    hashes, sizes = word_hashes(texts, points_of, *word_points())
    return np.split(hashes, np.cumsum(sizes)[:-1]) if len(texts) else []


def features(hashes: np.ndarray) -> np.ndarray:
    """The features of words."""
    return (hashes >> np.uint64(40) & np.uint64(FEATURES - 1)).astype(np.int64)  # FEATURES is a power of two


def quarter_sums(ids: np.ndarray, projected: np.ndarray) -> list[np.ndarray]:
    """Sums of words' vectors over the quarters of each window length, each length's from the one before.

    There are as many words as fill quarters of the longest window.
    """
    places = np.ascontiguousarray(ids.reshape(-1, WINDOWS[0] // 4).T)
    sums = [np.take(projected, places[0], axis=0, mode="clip")]
    one = np.empty_like(sums[0])
    for at in places[1:]:
        sums[0] += np.take(projected, at, axis=0, out=one, mode="clip")
    for shorter, longer in zip(WINDOWS, WINDOWS[1:]):
        times = longer // shorter
        sums.append(sums[-1][::times] + sums[-1][1::times])
        for k in range(2, times):
            sums[-1] += sums[-2][k::times]
    return sums


def window_sums(quarters: np.ndarray) -> np.ndarray:
    """The sums over the windows of a length that begin at each of its quarters but the last three."""
    halves = quarters[:-1] + quarters[1:]
    return halves[:-2] + halves[2:]


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def filled_up(ids: np.ndarray, sizes: np.ndarray, room: np.ndarray, kind: type) -> np.ndarray:
    """Texts with so many words in so much room each; what is left after each text is FEATURES."""
    out, own = np.full(int(room.sum()), FEATURES, kind), np.zeros(int(room.sum()) + 1, np.int8)
    ends = np.cumsum(room)
    np.add.at(own, ends - room, 1)
    np.add.at(own, ends - room + sizes, -1)
    out[np.cumsum(own[:-1], dtype=np.int8).view(bool)] = ids
    return out


def cut_up(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of PASSAGE words of texts with so many words; a text's last row is filled up with FEATURES."""
    return filled_up(ids, sizes, -(-sizes // PASSAGE) * PASSAGE, np.uint16).reshape(-1, PASSAGE)


def norms_of(ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The lengths of the passages' vectors, which have a feature's count times its weight."""
    ranked = np.sort(ids, axis=1)
    first = np.ones(ranked.shape, bool)
    first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    begins = np.flatnonzero(first)
    values = np.diff(begins, append=ids.size) * np.append(weight, 0)[ranked.ravel()[begins]]
    return np.sqrt(np.bincount(begins // PASSAGE, values * values, minlength=len(ids))).astype(np.float32)


def passages(texts: DataFrame) -> DataFrame:
    """The passages of ``texts`` (``text, copies``), some in a row, and document frequencies.

    ``texts int, passages int, ids binary`` are the texts that begin in a row, its passages and
    their features, two bytes a word; ``chunk int, sums binary`` are the rows of a task's
    document frequencies, each text counted ``copies`` times, and after them the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("texts", pa.int32()), ("passages", pa.int32()), ("ids", pa.binary()), ("chunk", pa.int32()), ("sums", pa.binary())])
        frequency = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            hashes, sizes = word_hashes(texts_of(batch), points_of, *word_points())
            ids, copies = features(hashes), batch.column("copies").to_numpy()
            for words, times in zip(np.split(ids, np.cumsum(sizes)[:-1]), copies.tolist(), strict=True):
                frequency[words] += times  # once a feature, however often it is there
            frequency[FEATURES] += copies.sum()
            rows, new = cut_up(ids, sizes), len(sizes) - batch.column("text").null_count
            for a in range(0, max(1, len(rows)), ROW_PASSAGES):
                part = rows[a : a + ROW_PASSAGES]
                yield pa.RecordBatch.from_pylist([{"texts": new, "passages": len(part), "ids": part.tobytes()}], schema)
                new = 0
        for chunk in range(0, FEATURES + 1, CHUNK):
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "sums": frequency[chunk : chunk + CHUNK].tobytes()}], schema)

    return texts.select("text", "copies").mapInArrow(run, "texts int, passages int, ids binary, chunk int, sums binary")


def document_frequency(fitted: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and how many documents there are, of ``passages``."""
    rows = summed(fitted.where("chunk IS NOT NULL").select("chunk", "sums"), "int64", FEATURES // CHUNK).collect()
    found = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        found[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.sums, np.int64)
    return found[:FEATURES], int(found[FEATURES])


def passage_rows(basis: np.ndarray, ids: np.ndarray, part: int = 512) -> np.ndarray:
    """The sum of the basis's rows over the words of each passage, some passages at a time, so that sums stay in the cache."""
    rows = np.zeros((len(ids), basis.shape[1]), np.float32)
    one = np.empty((part, basis.shape[1]), np.float32)
    for a in range(0, len(ids), part):
        here = rows[a : a + part]
        for words in np.ascontiguousarray(ids[a : a + part].T):
            here += np.take(basis, words, axis=0, out=one[: len(here)], mode="clip")
    return rows


def add_rows(total: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int = 48, part: int = 512) -> None:
    """Add to ``total``, for every word of every passage, the passage's row at the word's feature.

    Features with more than ``most`` words are summed one by one, the others together: the first word of each, the second, and so on.
    Rows are gathered in pieces that stay in the cache.
    """
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    ranked, of = flat[order], order // PASSAGE
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.diff(begins, append=len(flat))
    by = np.argsort(-counts, kind="stable")
    begins, counts = begins[by], counts[by]
    heavy = int(np.count_nonzero(counts > most))
    one, ones = np.empty((part, rows.shape[1]), rows.dtype), np.ones(part, rows.dtype)
    for begin, n in zip(begins[:heavy].tolist(), counts[:heavy].tolist()):
        if ranked[begin] != FEATURES:
            for at in range(begin, begin + n, part):
                these = of[at : min(at + part, begin + n)]
                total[ranked[begin]] += ones[: len(these)] @ np.take(rows, these, axis=0, out=one[: len(these)], mode="clip")
    begins, counts = begins[heavy:], counts[heavy:]
    for a in range(0, len(begins), part):
        first, many = begins[a : a + part], counts[a : a + part]
        sums = rows[of[first]]
        for k in range(1, int(many[0])):
            n = int(np.count_nonzero(many > k))
            sums[:n] += np.take(rows, of[first[:n] + k], axis=0, out=one[:n], mode="clip")
        total[ranked[first]] += sums


def projection(fitted: DataFrame, idf: np.ndarray) -> np.ndarray:
    """(FEATURES, RANK): right singular vectors of TF-IDF ``passages`` after the first SKIP, times idf.

    Of few texts fewer are left out, one for each 32: they have no more directions than passages.

    Each task multiplies its passages with the current basis and back; the partial products of
    FEATURES x (SKIP + RANK + OVERSAMPLE) are summed, and the driver orthogonalises. The last
    product gives the vectors by Nyström's approximation. There are fewer tasks than partitions
    where those are small, as each sends a product.
    """
    session = fitted.sparkSession
    texts, count = fitted.agg(F.sum("texts"), F.sum(F.col("passages").cast("long"))).first()
    skip = min(SKIP, (texts or 0) // 32)
    width = skip + RANK + OVERSAMPLE
    dealt = fitted.where("passages > 0").select("ids").coalesce(max(session.sparkContext.defaultParallelism, (count or 0) // TASK_PASSAGES))

    def product(basis: np.ndarray) -> np.ndarray:
        shared = session.sparkContext.broadcast(np.append(basis * idf[:, None], np.zeros((1, width)), axis=0).astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES + 1, width))
            for batch in batches:
                for row in batch.column("ids"):
                    ids = np.frombuffer(row.as_buffer(), np.uint16).reshape(-1, PASSAGE)
                    rows = passage_rows(shared.value, ids)
                    rows /= np.square(norms_of(ids, idf))[:, None]  # a passage's length counts both ways
                    add_rows(total, ids, rows)
            total = (total[:FEATURES] * idf[:, None]).astype(np.float32)  # enough for a subspace, and half to send
            for chunk in range(0, FEATURES, CHUNK):
                yield row_of(chunk, total[chunk : chunk + CHUNK])

        found = np.zeros((FEATURES, width))
        for r in summed(dealt.mapInArrow(run, "chunk int, sums binary"), "float32", FEATURES // CHUNK).collect():
            found[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.sums, np.float32).reshape(-1, width)
        shared.unpersist()
        return found

    basis = np.random.default_rng(SEED).normal(size=(FEATURES, width))
    for _ in range(POWER):
        basis = np.linalg.qr(product(basis))[0]
    last = product(basis)
    small = basis.T @ last
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    sure = values > max(1e-5 * values[-1], 0)  # others are rounding
    directions = np.linalg.svd(last @ (vectors[:, sure] / np.sqrt(values[sure])), full_matrices=False)[0][:, skip : skip + RANK]
    found = np.zeros((FEATURES, RANK))
    found[:, : directions.shape[1]] = directions
    return (found * idf[:, None]).astype(np.float32)


def with_zero(projected: np.ndarray) -> np.ndarray:
    """With a row of zeros for FEATURES, which stands where a text has no more words."""
    return np.append(projected, np.zeros_like(projected[:1]), axis=0)


@dataclass
class Items:
    """A block of benchmark items, ready to be searched for."""

    ids: list[int]
    #: How many words each item has, and for each word the bits of its places.
    sizes: list[int]
    masks: list[dict[int, int]]
    answers: list[set[int]]
    #: Of each window length that passages have: it, for each passage the item's place and the passage's first word, unit vectors as columns.
    by_length: list[tuple[int, np.ndarray, np.ndarray]]

    def __post_init__(self):
        self.longest = max(self.sizes, default=0)


def answer_of(text: str) -> set[int]:
    """The hashes of the words of the last sentence that has three or more; else of all words."""
    *parts, whole = hashed([*re.split(r"[.?!\n]+", text), text])
    return set(next((p for p in reversed(parts) if len(p) >= 3), whole).tolist())


def passages_of(n: int) -> list[tuple[int, int]]:
    """First word and length of the passages of an item of n words: one, or some of the longest window's length."""
    most = WINDOWS[-1]
    if n * 0.75 <= most:
        return [(0, n)]
    return [(a, most) for a in range(0, n - most, most)] + [(n - most, most)]


def places_of(words: list) -> dict:
    """For each different word, the places where it stands, as the bits of one number."""
    masks: dict = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def make_items(rows: list[tuple[int, str]], projected: np.ndarray) -> Items:
    words = hashed([t for _, t in rows])
    parts = [(i, a, n) for i, w in enumerate(words) for a, n in passages_of(len(w)) if n]
    vectors = np.array([projected[features(words[i][a : a + n])].sum(axis=0) for i, a, n in parts]).reshape(-1, projected.shape[1])
    fit = np.array([next((k for k in WINDOWS if k >= 0.75 * n), WINDOWS[-1]) for *_, n in parts])
    unit, spots = _unit(vectors), np.array([p[:2] for p in parts], np.int64).reshape(-1, 2)
    by_length = [(k, spots[at], np.ascontiguousarray(unit[at].T)) for k in WINDOWS for at in [np.flatnonzero(fit == k)] if len(at)]
    return Items([i for i, _ in rows], list(map(len, words)), [places_of(w.tolist()) for w in words], [answer_of(t) for _, t in rows], by_length)


def common_subsequence(masks: dict, n: int, words: list) -> int:
    """The length of the longest common subsequence of an item of n words (``places_of``) and others, by bits of one long number."""
    row = whole = (1 << n) - 1
    for w in words:
        if m := row & masks.get(w, 0):
            row = (row + m | row - m) & whole
    return n - row.bit_count()


def pieces(sizes: Iterable[int], over: int, part: int = 1 << 14) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of about TOGETHER words of texts of so many: (text, first word, words) of each piece.

    Long texts are searched in parts, which overlap by ``over`` words.
    """
    group, total = [], 0
    for t, n in enumerate(sizes):
        for a in range(0, n, part):
            size = min(n - a, part + over)
            if group and total + size > TOGETHER:
                yield group
                group, total = [], 0
            group.append((t, a, size))
            total += size
    if group:
        yield group


def close_windows(ids: np.ndarray, sizes: np.ndarray, blocks: list[Items], projected: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, ...]]:
    """Window length, block, and of each of its pairs of a window and a passage at CANDIDATE or above: piece, first word in it, passage, cosine.

    ``ids`` has the features of pieces of texts, one after another, ``sizes`` how many each has.
    """
    grid = WINDOWS[-1] // 4
    room = np.maximum(WINDOWS[-1], -(-sizes // grid) * grid)
    starts = np.cumsum(room) - room
    for length, quarters in zip(WINDOWS, quarter_sums(filled_up(ids, sizes, room, np.int64), projected), strict=True):
        wanted = [(b, vectors) for b, items in enumerate(blocks) for k, _, vectors in items.by_length if k == length]
        if not wanted:
            continue
        step = length // 4
        sums, firsts = window_sums(quarters), starts // step
        within = np.zeros(len(quarters) + 1, np.int8)  # windows begin before a piece's last three quarters, or with it
        within[firsts] = 1
        within[firsts + np.maximum(1, -(-sizes // step) - 3)] -= 1
        norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        norms[(norms == 0) | (np.cumsum(within[: len(norms)]) == 0)] = np.inf
        limits = CANDIDATE * norms
        for b, vectors in wanted:
            close = vectors.T @ sums.T  # cosine times the window's norm
            passage, window = np.divmod(np.flatnonzero(close >= limits), len(norms))
            order = np.lexsort((passage, window))
            passage, window = passage[order], window[order]
            piece = np.searchsorted(firsts, window, "right") - 1
            yield length, b, piece, (window - firsts[piece]) * step, passage, close[passage, window] / norms[window]


def leak_at(here: list, n: int, masks: dict, answers: set, best: tuple[float, float]) -> tuple[float, float] | None:
    """The shares of an item's n words in order and of its answer among words of it, if they show a leak and more than ``best`` does."""
    if len(here) < LOOSE * n:
        return None
    answer = len(answers.intersection(here)) / max(1, len(answers))
    least = LOOSE if answer >= ANSWER else LEAK
    there = 0  # the item's places whose word is here: no common subsequence is longer
    for w in set(here):
        there |= masks[w]
    most = min(there.bit_count(), len(here)) / n
    if most < least or (most, answer) <= best:
        return None
    share = common_subsequence(masks, n, here) / n
    return (share, answer) if share >= least and (share, answer) > best else None


def leaks_of(words: list[np.ndarray], blocks: list[Items], projected: np.ndarray) -> list[list[tuple[int, float, float, float]]]:
    """(item, cosine, share of its words in order, share of its answer) for each item found in each text's hashed words.

    ``projected`` has a row of zeros after its features.
    """
    best: list[dict[tuple[int, int], tuple[float, float, float]]] = [{} for _ in words]
    over = 3 * max((items.longest for items in blocks), default=0) + WINDOWS[-1]  # more than an item and what is looked at around it
    for group in pieces(map(len, words), over):
        ids = features(np.concatenate([words[t][a : a + n] for t, a, n in group]))
        for length, b, *found in close_windows(ids, np.array([n for *_, n in group]), blocks, projected):
            items, spots = blocks[b], next(spots for k, spots, _ in blocks[b].by_length if k == length)
            for piece, begin, passage, cosine in zip(*(x.tolist() for x in found), strict=True):
                item, first = spots[passage].tolist()
                t, a, _ = group[piece]
                n, masks = items.sizes[item], items.masks[item]
                at = a + begin - first  # where the item would begin
                here = list(filter(masks.__contains__, words[t][max(a, at - n) : at + length + 2 * n].tolist()))
                if shares := leak_at(here, n, masks, items.answers[item], best[t].get((b, item), (0, 0, 0))[1:]):
                    best[t][b, item] = (cosine, *shares)
    return [sorted((blocks[b].ids[i], *f) for (b, i), f in own.items()) for own in best]


@lru_cache(BLOCKS)
def block_of(uri: str) -> Items:
    """A block from the shared folder."""
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        return pickle.loads(f.read())


class Searcher:
    """The fitted index: the projection, and the benchmark's items in blocks in the shared folder."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame):
        small_batches(docs.sparkSession)
        items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
        # the passages of copies count once, however many there are: else they are among the directions that are left out
        texts = docs.select("text", F.lit(1).alias("copies")).unionByName(items.select("text", F.lit(0).alias("copies")))
        fitted = cut(passages(texts.groupBy("text").agg(F.sum("copies").alias("copies"))))
        release(docs.sparkSession)  # the texts as dealt
        df, n = document_frequency(fitted)
        idf = np.log((n + 1) / (df + 1)) + 0.1
        self.projected = docs.sparkSession.sparkContext.broadcast(with_zero(projection(fitted, idf)))  # of fixed size
        del fitted
        release(docs.sparkSession)
        self.uris = self._write(items, fresh_folder(docs.sparkSession, "items"))

    def _write(self, items: DataFrame, folder: str) -> list[str]:
        """Make the items ready in tasks; the driver gets one name a block."""
        shared = self.projected

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = pafs.FileSystem.from_uri(folder)
            files.create_dir(base, recursive=True)
            rows: list[tuple[int, str]] = []
            for batch in chain(batches, [None]):
                rows += zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()) if batch is not None else []
                while len(rows) >= BLOCK_ITEMS or rows and batch is None:
                    name = uuid.uuid4().hex
                    with files.open_output_stream(f"{base}/{name}") as f:
                        f.write(pickle.dumps(make_items(rows[:BLOCK_ITEMS], shared.value)))
                    rows = rows[BLOCK_ITEMS:]
                    yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"]})

        # rows of the same hash range lie together, so that a small benchmark is one block
        dealt = items.repartition(max(1, -(-items.count() // (4 * BLOCK_ITEMS))), F.xxhash64("item_id", "text"))
        return sorted(r.uri for r in dealt.mapInArrow(run, "uri string").collect())

    def search(self):
        """A function from texts to the leaks of each, for tasks: few blocks are in memory at a time."""
        uris, shared = self.uris, self.projected

        def leaks(texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
            alone("decontaminate", block_of.cache_clear)
            words, found = hashed(texts), [[] for _ in texts]
            for a in range(0, len(uris), BLOCKS):
                blocks = list(map(block_of, uris[a : a + BLOCKS]))
                for mine, leaks in zip(found, leaks_of(words, blocks, shared.value), strict=True):
                    mine += leaks
            return found

        return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share`` for each document with a leaked item.

    ``docs`` has ``doc_id, text``, ``benchmark`` ``item_id, text``. Null and empty texts, items
    without words and items with a null id have no leaks; a null doc_id stays null; repeated
    rows give repeated rows; other columns are ignored; empty tables give no rows.
    """
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.float64()) for c in ("cosine", "lcs_share", "answer_share"))])
    search = Searcher(docs, benchmark).search()

    def make():
        def apply(batch):
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, *leak) for i, leaks in zip(ids, search(texts_of(batch)), strict=True) for leak in leaks]
            yield [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5

        return apply

    return by_batch(docs, ["doc_id", "text"], out, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double", make)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no leaked item; see ``find_leaks``."""
    search = Searcher(docs, benchmark).search()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not leaks for leaks in search(texts_of(batch))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
