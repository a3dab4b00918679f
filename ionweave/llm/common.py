"""What the operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII space and \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of an output batch hold about so many bytes at most.
BATCH_BYTES = 4 << 20


#: Bytes of an Arrow batch that Spark sends to Python: with long texts ten thousand rows would be too many.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, whatever the length of the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) != ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by any path that Spark can read."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (a local test session) one is made under the temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, from files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle and checkpoint files of finished steps.

    It removes them when the driver's garbage is collected, which a driver with little to do puts off
    while a long job fills the disks of all executors; call this where a step's files are no longer needed.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared folder, which is removed when the driver ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{folder}/data"


def unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [name for k in range(len(taken) + n) if (name := f"_own{k}") not in taken][:n]


def by_batch(
    df: DataFrame,
    columns: list[str],
    out: pa.Schema,
    ddl: str,
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[list]]],
) -> DataFrame:
    """Apply a function to the Arrow batches of some columns.

    ``make`` runs once a task and returns the function, which takes a batch and yields
    lists of arrays, one list an output batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for arrays in apply(batch):
                yield pa.RecordBatch.from_arrays(
                    [a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, out, strict=True)], schema=out
                )

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, ddl)


_forget: dict[str, Callable[[], None]] = {}


def alone(operator: str, forget: Callable[[], None]) -> None:
    """Say which operator a worker's task is of, and how to forget what it keeps for later tasks.

    A worker serves one operator after another; what the others have kept is forgotten first.
    """
    others = [_forget.pop(o) for o in list(_forget) if o != operator]
    for f in others:
        f()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _forget[operator] = forget


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def blocks(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes together; a longer row is alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def held_out(doc_id="doc_id"):
    """Whether a row is held out: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Unicode's White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(4)
def code_points(major: str) -> list[tuple[int, int]]:
    """Ranges of the code points of a major category such as L or N, ends included.

    The tokenizers library is asked, because its Unicode tables are newer than Python's.
    """
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(rf"\p{{{major}}}+"), "removed", invert=True)
    parts = [range(0xD800), range(0xE000, 0x110000)]
    return [
        (r[a], r[b - 1]) for r in parts for _, (a, b) in split.pre_tokenize_str("".join(map(chr, r)))
    ]


@lru_cache(4)
def char_set(major: str) -> str:
    """The inside of a character set of ``re`` that holds a major category."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in code_points(major))


def row_of(chunk: int, part) -> pa.RecordBatch:
    """A chunk of an array of numbers as a row: ``chunk int, sums binary``."""
    return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})


def summed(parts: DataFrame, kind: str, tasks: int) -> DataFrame:
    """Add up the rows of ``row_of``, a chunk in one place; a task keeps one array a chunk."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(data, kind)
                if chunk in sums:
                    sums[chunk] += part
                else:
                    sums[chunk] = part.copy()
        for chunk, part in sums.items():
            yield row_of(chunk, part)

    return parts.repartition(tasks, "chunk").mapInArrow(add, "chunk int, sums binary")


#: Places that are looked at together: few enough for the cache of a core.
LOOK = 1 << 16
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and those of its inverse."""
    return tuple(
        np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64))
    )


def run_hashes(values: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of places ``inside`` begin, and a 64-bit hash of the values of each; equal runs have equal hashes.

    A run's hash is a polynomial in its values, from differences of sums over all, so no run is looked at by itself.
    """
    within = np.zeros(len(inside) + 2, bool)
    within[1:-1] = inside
    edges = np.flatnonzero(within[1:] != within[:-1])
    begins, ends = edges[::2], edges[1::2]
    powers, back = _powers(1 << max(LOOK.bit_length(), len(values).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    sums[1:] = values
    sums[1:] += np.uint64(1)
    sums[1:] *= powers[: len(values)]
    np.cumsum(sums[1:], out=sums[1:])
    found = (sums[ends] - sums[begins]) * back[begins]
    found = (found ^ (found >> np.uint64(32))) * _SPREAD
    return begins, found ^ (found >> np.uint64(29))


def word_hashes(texts: list, codes: Callable, inside: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has.

    ``codes`` makes numbers of a text, as many as it is long; ``inside`` says which are part of a word, ``lower`` what
    they count as. Texts are joined, a line feed between them, and looked at a piece at a time.
    """
    found, sizes = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    end = "\n" if texts and isinstance(texts[0], str) else b"\n"
    for a, b in blocks([len(t) + 1 for t in texts], LOOK):
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        joined = codes(end.join([*texts[a:b], end[:0]])).astype(np.intp)
        within, at = inside[joined], 0
        while at < len(joined):  # a long text in pieces, cut between words
            to = min(at + LOOK, len(joined))
            outside = np.flatnonzero(~within[at:to])
            to = at + int(outside[-1]) + 1 if len(outside) else to + int(np.argmin(within[to:])) + 1
            begins, hashes = run_hashes(lower[joined[at:to]], within[at:to])
            sizes[a:b] += np.bincount(np.searchsorted(ends, begins + at, "right"), minlength=b - a)
            found.append(hashes)
            at = to
    return np.concatenate(found), sizes


def points_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def word_points() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether it is part of a word (``\\\\w``), and its small letter."""
    every = list(map(chr, range(0x110000)))
    small = [c.lower() for c in every]
    return np.array([c.isalnum() or c == "_" for c in every]), np.array([ord(s if len(s) == 1 else c) for c, s in zip(every, small)], np.uint32)
