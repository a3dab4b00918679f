"""Operator 12: vectors as short codes, one index into a codebook for each part of a vector.

Every part position has a codebook, trained by k-means on whole numbers. A part's nearest entry
is found by exponion search: from the entry that the part had before, its list of all entries by
distance is scanned as far as an entry may be nearer. With d the distance from the part to its
entry, an entry that is as near or nearer lies within 2 d of that entry (triangle inequality), so
squares of whole numbers, gap <= 4 d * d, tell exactly where the scan may end.

Rows that take part: see ``vectors``. Null ids take part but start no codebook; repeated rows count
each; an empty table gives no rows. With fewer rows than entries the codebooks are as short. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import fresh_folder, small_batches
from ionweave.llm.vectors import integers, kept

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Sums of labels are broadcast if they are so many at most, and joined by a shuffle otherwise.
MOST_LABELS = 100_000


@dataclass
class Books:
    """The codebooks: ``entries[part, entry]`` are whole numbers."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        apart = self.entries[:, :, None] - self.entries[:, None]
        gaps = np.einsum("pabw,pabw->pab", apart, apart)
        #: Of each entry, all entries by distance (ties: the lower index), and the squares of the distances.
        self.lists = np.argsort(gaps, axis=2, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.lists, 2)
        #: Entries by the sum of their components, for parts that had no entry before.
        sums = self.entries.sum(2)
        self.by_sum = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.by_sum, 1)

    def start(self, part: int, points: np.ndarray) -> np.ndarray:
        """An entry for each point to start from: one with about the same sum."""
        at = np.searchsorted(self.sums[part], points.sum(1))
        return self.by_sum[part][np.minimum(at, self.by_sum.shape[1] - 1)]

    def nearest(self, part: int, points: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point, the nearest entry (ties: the lower index) and the square of its distance."""
        entries, lists, gaps = self.entries[part], self.lists[part], self.gaps[part]
        off = points - entries[before]
        radius = 4 * np.einsum("nw,nw->n", off, off)
        reach, groups = np.empty(len(points), np.int64), np.argsort(before, kind="stable")
        ends = np.cumsum(np.bincount(before, minlength=len(entries)))
        for entry, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
            reach[groups[a:b]] = np.searchsorted(gaps[entry], radius[groups[a:b]], "right")
        order = np.argsort(-reach, kind="stable")  # those that scan the most first: each step works on a prefix
        points, before = np.ascontiguousarray(points[order].T), before[order]
        left = np.searchsorted(-reach[order], -np.arange(reach.max(initial=0)), "left")
        best, least = np.full(len(order), len(entries)), np.full(len(order), np.iinfo(np.int64).max)
        for step, n in enumerate(left):
            found = lists[before[:n], step]
            far = sum((mine[:n] - theirs[found]) ** 2 for mine, theirs in zip(points, entries.T))
            better = (far < least[:n]) | ((far == least[:n]) & (found < best[:n]))
            best[:n] = np.where(better, found, best[:n])
            least[:n] = np.where(better, far, least[:n])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return best[back], least[back]

    def assign(self, vectors: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors, a row each, and the sums of their squared distances."""
        parts, _, width = self.entries.shape
        codes, error = np.empty((len(vectors), parts), np.int64), np.zeros(len(vectors), np.int64)
        for part in range(parts):
            points = vectors[:, part * width : (part + 1) * width]
            codes[:, part], far = self.nearest(part, points, self.start(part, points) if before is None else before[:, part])
            error += far
        return codes, error

    def digest(self) -> str:
        """SHA-256 of all components in order, as decimals with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("whole").flatten().to_numpy().astype(np.int64).reshape(-1, length)


def _codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(-1, parts).astype(np.int64)


def _assigned(df: DataFrame, column: str, length: int, books: Books, first: bool) -> DataFrame:
    """``vec_id, label, whole, code``: rows with the entries that are nearest to their parts now."""
    parts = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = integers(batch.column(column), length) if first else _vectors(batch, length)
            codes, _ = books.assign(vectors, None if first else _codes(batch, parts))
            ends = pa.array(np.arange(0, vectors.size + 1, length, dtype=np.int32))
            columns = [
                batch.column("vec_id"),
                batch.column("label"),
                pa.ListArray.from_arrays(ends, pa.array(vectors.ravel().astype(np.int32))),
                pa.array([c.tobytes() for c in codes.astype(np.uint16)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "whole", "code"])

    types = dict(df.dtypes)
    ddl = f"vec_id {types['vec_id']}, label {types['label']}, whole array<int>, code binary"
    return df.select("vec_id", "label", *([column] if first else ["whole", "code"])).mapInArrow(run, ddl)


def _moved(df: DataFrame, length: int, books: Books) -> Books:
    """The codebooks with each entry at the mean of its parts, rounded down; sums are added up before they are shuffled."""
    parts, entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            vectors, codes = _vectors(batch, length), _codes(batch, parts)
            for part in range(parts):
                counts[part] += np.bincount(codes[:, part], minlength=entries)
                for k in range(width):  # sums of a batch are far below 2 ** 53
                    sums[part, :, k] += np.bincount(codes[:, part], vectors[:, part * width + k], entries).astype(np.int64)
        part, entry, place = (x.ravel() for x in np.indices(sums.shape))
        used = counts[part, entry] > 0
        columns = [part, entry, place, counts[part, entry], sums.ravel()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c[used], k) for c, k in zip(columns, kinds)], ["part", "entry", "place", "n", "total"])

    moved = df.select("whole", "code").mapInArrow(add, "part int, entry int, place int, n long, total long")
    new = books.entries.copy()
    for r in moved.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row a component of the codebooks
        new[r.part, r.entry, r.place] = r.total // r.n
    return Books(new)


def encode(df: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """``vec_id, label, code, error`` of all rows that take part, and the codebooks that the codes point into.

    ``code`` has two hexadecimal digits a part. Codebooks start as the parts of the ``entries`` rows
    with the smallest ids (ties: the smaller vector) and are moved ``rounds`` times. Of what is between
    rounds, only the last is kept, in the shared folder. At most 256 entries.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows, length = kept(df.select("vec_id", "label", column), column, parts)
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", column).limit(entries).select(column).toArrow() if length else None
    kind = f"vec_id {dict(df.dtypes)['vec_id']}, label {dict(df.dtypes)['label']}, code string, error long"
    if not first:
        return spark.createDataFrame([], kind), None
    chosen = integers(first.column(column).combine_chunks(), length)
    books = Books(np.ascontiguousarray(chosen.reshape(len(chosen), parts, length // parts).transpose(1, 0, 2)))
    old = None
    for k in range(rounds):
        folder = fresh_folder(spark, "codes")
        _assigned(rows, column, length, books, k == 0).write.parquet(folder)
        rows = spark.read.parquet(folder)
        books = _moved(rows, length, books)
        if old:
            place = spark._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        old = folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch, length) if rounds else integers(batch.column(column), length)
            codes, error = books.assign(vectors, _codes(batch, parts) if rounds else None)
            shown = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), shown, pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, kind), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels, nulls together.

    Sums are broadcast where they are few; else a merge join, whose hot labels are split at run time.
    """
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, coded.label.eqNullSafe(sums["_label"])).drop("_label")
