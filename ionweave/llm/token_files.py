"""Token ids in Arrow files of equal-length sequences.

The documents' ids, an end id after each, form one stream in ascending order of doc_id. Every
shard holds a range of it in the Arrow IPC file format: record batches with two columns of
fixed-size lists, ``ids`` (unsigned, two bytes each if the vocabulary allows) and ``mask``
(one bit each, false where the shard's last sequence is filled up). Equal-length rows make
the place of every sequence known, so a memory-mapped file gives any of them without a copy.
A second Arrow file beside each shard says where its documents begin.

Shards are named by their place in the order and moved to their final name when complete, so
a task that runs again after an executor is lost writes the same file again.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.llm import token_counts
from ionweave.llm.common import alone, blocks, texts_of

#: Ids of a sequence, and sequences of a record batch.
SEQUENCE, ROWS = 2048, 64
#: Bytes of text that a shard takes at most, about, and rows that are worth a shard of their own.
SHARD_BYTES, SHARD_ROWS = 256 << 20, 512


class Encoder:
    """Ids by the tokenizers library, which is asked once for each pre-token that is new to it."""

    #: Words in each of the two generations that a worker remembers.
    MOST_WORDS = 300_000
    #: New words that are put to the library in one text.
    TOGETHER = 500

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.type = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = {2: "H", 4: "I"}[np.dtype(self.type).itemsize]
        self.splitter = token_counts.transducer(path)
        self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)  # bytes that an id stands for
        for i, piece in self.splitter.bytes_of.items():
            self.sizes[i] = len(piece)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        """Put words into the young generation, by the old one or by the library."""
        if len(self.words) > self.MOST_WORDS:
            self.older, self.words = self.words, {}
        old, young = self.older, self.words
        new = []
        for w in words:
            if (ids := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = ids
        asked = [w.decode("utf-8", "surrogatepass") for w in new]
        plain = [t[0] == " " and t[1:].isalpha() for t in asked]
        # blanks with letters after them are cut apart again by the library, so many are asked for in one text
        many, width = [w for w, p in zip(new, plain, strict=True) if p], np.dtype(self.type).itemsize
        texts = ["".join(group) for group in batched((t for t, p in zip(asked, plain, strict=True) if p), self.TOGETHER)]
        ids = np.array([i for e in self.library.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], self.type)
        data, stops = ids.tobytes(), np.cumsum(self.sizes[ids])
        to = (np.searchsorted(stops, np.cumsum(list(map(len, many)))) + 1) * width
        young.update(zip(many, (data[a:b] for a, b in pairwise([0, *to.tolist()])), strict=True))
        rest = [(w, t) for w, t, p in zip(new, asked, plain, strict=True) if not p]
        for (w, _), e in zip(rest, self.library.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            young[w] = array(self.code, e.ids).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """All ids one after the other, and how many each text has."""
        parts, totals = [np.empty(0, self.type)], np.zeros(len(texts), np.int64)
        for distinct, places, owners in self.splitter.pieces(texts):
            words = distinct.to_pylist()
            found = list(map(self.words.get, words))
            if None in found:
                self._learn([w for w, ids in zip(words, found, strict=True) if ids is None])
                # where the generation has just turned, words of this block may be in the old one
                young, old = self.words, self.older
                found = [ids if ids is not None else young.get(w) or old[w] for w, ids in zip(words, found, strict=True)]
            flat = np.frombuffer(b"".join(found), self.type)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.type).itemsize
            counts = sizes[places]
            # each word's ids lie together in flat: where they begin, less what has been put out before
            shift = (np.cumsum(sizes) - sizes)[places] - (np.cumsum(counts) - counts)
            parts.append(flat[np.arange(counts.sum()) + np.repeat(shift, counts)])
            totals += np.bincount(owners, counts, len(texts)).astype(np.int64)
        return np.concatenate(parts), totals.tolist()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(path)


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Shard:
    """Writes one shard under a name of its own until it is complete."""

    def __init__(self, folder: str, number: int, kind, sequence: int, rows: int):
        self.files, base = _place(folder)
        self.files.create_dir(base, recursive=True)
        self.final = f"{base}/shard-{number:06d}"
        self.name = f"{self.final}.{uuid.uuid4().hex}.tmp"
        self.kind, self.sequence, self.rows = kind, sequence, rows
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.files.open_output_stream(self.name)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.waiting = self.written = 0
        self.docs: list[pa.RecordBatch] = []

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        self.written += len(ids)
        step = self.sequence * self.rows
        if self.waiting >= step:
            joined = np.concatenate(self.rest)
            for i in range(0, len(joined) - step + 1, step):
                self._batch(joined[i : i + step], step)
            self.rest = [joined[len(joined) // step * step :].copy()]
            self.waiting = len(self.rest[0])

    def _batch(self, ids: np.ndarray, real: int) -> None:
        columns = (pa.array(ids), pa.array(np.arange(len(ids)) < real))
        arrays = [pa.FixedSizeListArray.from_arrays(c, self.sequence) for c in columns]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            last = np.concatenate(self.rest)
            self._batch(np.pad(last, (0, -len(last) % self.sequence)), len(last))
        self.writer.close()
        self.sink.close()
        with self.files.open_output_stream(f"{self.name}d") as sink, pa.ipc.new_file(sink, INDEX) as writer:
            for batch in self.docs:
                writer.write_batch(batch)
        self.files.move(f"{self.name}d", f"{self.final}.docs.arrow")
        self.files.move(self.name, f"{self.final}.arrow")


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceFile:
    """Random access to the sequences of a shard; memory-mapped where the file is local."""

    def __init__(self, uri: str, rows: int = ROWS):
        files, path = _place(uri)
        local = isinstance(files, pafs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))
        self.rows = rows
        self.sequence = self.reader.schema.field("ids").type.list_size

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i and its mask; the ids are a view of the file."""
        batch = self.reader.get_batch(i // self.rows)
        k = i % self.rows
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
        return ids[k * self.sequence : (k + 1) * self.sequence], batch.column("mask")[k].values

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, n of them, as views of the batches that hold them."""
        step = self.rows * self.sequence
        while n > 0:
            ids = self.reader.get_batch(start // step).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = ids[start % step : start % step + n]
            yield part
            start, n = start + len(part), n - len(part)


def shard_count(docs: DataFrame) -> int:
    """As many shards as the shuffle has partitions, more for a large table, fewer for a small one."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, size // SHARD_BYTES, min(rows // SHARD_ROWS, parallel))


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int, sequence: int = SEQUENCE, rows: int = ROWS) -> DataFrame:
    """Write the documents' ids under ``folder`` and return ``uri, shard, base, n_tokens`` of each shard.

    ``docs`` has ``doc_id, text``; a null or empty text gives the end id alone, a null doc_id
    sorts first, rows of the same id are in the order of a hash of their texts, repeated rows are all written, other columns are ignored, and an empty table
    gives no shards. ``folder`` is a URI that driver and executors share. Rows are dealt out
    and sorted by doc_id before they are encoded, so only texts are shuffled, once. ``base`` is
    the number of ids in the shards before; the driver sums one number a shard for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        alone("token_files", encoder.cache_clear)
        coder, number, shard = encoder(vocabulary), TaskContext.get().partitionId(), None
        for batch in batches:
            texts = texts_of(batch)
            for a, b in blocks([len(t) + 20 for t in texts]):
                shard = shard or _Shard(folder, number, coder.type, sequence, rows)
                ids, counts = coder.encode(texts[a:b])
                stops = np.cumsum(counts)
                start = shard.written + np.concatenate([[0], stops[:-1]]) + np.arange(b - a)
                index = [batch.column("doc_id").slice(a, b - a), pa.array(start), pa.array(np.array(counts) + 1)]
                shard.docs.append(pa.RecordBatch.from_arrays(index, schema=INDEX))
                shard.add(np.insert(ids, stops, coder.type(end_id)))
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "n_tokens": pa.array([shard.written], pa.int64())})

    # rows of one id, or without any, lie in the order of a hash of their texts, and may take many shards
    order = ["doc_id", "h"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("h")
    made = sorted(dealt.mapInArrow(run, "shard int, n_tokens long").collect())
    bases = accumulate([m.n_tokens for m in made], initial=0)
    rows_ = [(f"{folder}/shard-{m.shard:06d}", m.shard, base, m.n_tokens) for m, base in zip(made, bases)]
    schema = T.StructType.fromDDL("uri string, shard int, base long, n_tokens long")
    session = docs.sparkSession
    return session.createDataFrame(rows_, schema).repartition(max(1, len(rows_)), "shard") if rows_ else session.createDataFrame([], schema)


def read(shards: DataFrame, rows: int = ROWS) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of ``write``.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the unsigned crc32 of
    its ids as little-endian unsigned 32-bit integers. Null ids stay null, repeated rows are all
    read, and no shards give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                sequences = SequenceFile(f"{uri}.arrow", rows)
                files, path = _place(f"{uri}.docs.arrow")
                with files.open_input_file(path) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        docs = reader.get_batch(k)
                        crcs = []
                        for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                            crc = 0
                            for part in sequences.span(start, n):
                                crc = zlib.crc32(part.astype("<u4"), crc)
                            crcs.append(crc)
                        starts = pa.array(docs.column("start").to_numpy() + base)
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return shards.select("uri", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
