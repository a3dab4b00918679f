"""MGF files as a data source of Spark: ``spark.read.format("mgf").load(path)`` after ``register(spark)``.

Files are cut into byte ranges; a spectrum belongs to the range in which its ``BEGIN IONS`` line begins,
so ranges are read without each other and large files by many tasks. Equality and membership
tests on ``scan`` and ``charge`` are looked at while a block is read, before its peaks are. As a stream
(``spark.readStream``), offsets are how much of each file has been handed out; whole blocks only. Paths
are any that Arrow's file systems open; ``files.read_mgf`` takes all that Spark opens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "scan string, charge int, precursor_mz double, peptide string, original_score double, mzs array<double>, ints array<double>"
RANGE_BYTES = 16 << 20
_BATCH = 1_000
_BEGIN, _END = re.compile(rb"^[ \t]*BEGIN IONS", re.M), re.compile(rb"^[ \t]*END IONS[^\n]*(?:\n|\Z)", re.M)
_PEAK = re.compile(r"^\s*[0-9.]+([eE][-+]?\d+)?\s+[0-9.]", re.A)
_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\Z", re.A)
_ARROW = pa.schema([("scan", pa.string()), ("charge", pa.int32()), ("precursor_mz", pa.float64()), ("peptide", pa.string()), ("original_score", pa.float64()), ("mzs", pa.list_(pa.float64())), ("ints", pa.list_(pa.float64()))])


def number(text: str | None) -> float | None:
    return float(text) if text is not None and _NUMBER.match(text) else None


def spectrum(block: str, tests: dict) -> dict | None:
    """The columns of a block; None if its scan or charge is not among those asked for."""
    text = block.replace("\r", "")

    def field(key: str) -> str | None:
        found = re.search(rf"^{key}=(.*?)[ \t]*$", text, re.M)
        return found[1] or None if found else None

    charge = re.search(r"\d+", field("CHARGE") or "", re.A)
    row = {"scan": field("SCANS"), "charge": int(charge[0]) if charge and int(charge[0]) < 1 << 31 else None}
    if any(row[c] not in allowed for c, allowed in tests.items()):
        return None
    peaks = [line.split() for line in text.split("\n") if _PEAK.match(line)]
    mass = (field("PEPMASS") or "").split()
    return row | {
        "precursor_mz": number(mass[0]) if mass else None, "peptide": field("SEQ"), "original_score": number(field("SCORE")),
        "mzs": [number(p[0]) for p in peaks], "ints": [number(p[1]) for p in peaks],
    }


def opened(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """The files of a folder, or the one file, with their sizes."""
    from pyarrow import fs

    system, place = opened(path)
    info = system.get_file_info(place)
    found = system.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.Directory else [info]
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


@dataclass
class Span(InputPartition):
    """A byte range of a file."""

    file: str
    begin: int
    end: int


def blocks(system, span: Span, step: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """The blocks that begin in a range, and where each ends; some MB are held at a time."""
    with system.open_input_file(span.file) as f:
        size = f.size()
        at = max(0, span.begin - 1)  # a line may begin with the range
        held, done = b"", False
        if span.begin:
            held = f.read_at(min(step, size - at), at)
            cut = held.find(b"\n")
            while cut < 0 and at + len(held) < min(size, span.end):
                held += f.read_at(min(step, size - at - len(held)), at + len(held))
                cut = held.find(b"\n")
            if cut < 0:
                return
            at, held = at + cut + 1, held[cut + 1 :]
        while True:
            begin = _BEGIN.search(held)
            end = _END.search(held, begin.end()) if begin else None
            if begin and at + begin.start() >= span.end or not begin and at >= span.end:
                return
            # a block that reaches the end of what is held may go on behind it
            if end and (end[0].endswith(b"\n") or done):
                yield at + end.end(), held[begin.start() : end.start()].decode("utf-8", "replace")
                at, held = at + end.end(), held[end.end() :]
            elif done:
                return
            else:
                if not begin and (line := held.rfind(b"\n")) >= 0:
                    at, held = at + line + 1, held[line + 1 :]
                more = f.read_at(min(step, size - at - len(held)), at + len(held))
                held, done = held + more, not more


def batches(path: str, span: Span, tests: dict) -> Iterator[pa.RecordBatch]:
    system, _ = opened(path)
    rows: list[dict] = []
    for _, text in blocks(system, span):
        if (row := spectrum(text, tests)) is not None:
            rows.append(row)
        if len(rows) >= _BATCH:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


class MgfReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.tests = path, size, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("scan",), ("charge",)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.tests[name] = self.tests.get(name, wanted) & wanted - {None}
            else:
                yield f

    def partitions(self) -> list[Span]:
        return [Span(f, a, min(a + self.size, n)) for f, n in listed(self.path).items() for a in range(0, n, self.size)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition, self.tests)


class MgfStream(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """As far as whole blocks go; the end of a file is looked at for the last one."""
        system, _ = opened(self.path)
        found = {}
        for name, n in listed(self.path).items():
            with system.open_input_file(name) as f:
                reach = min(n, 1 << 16)
                while True:
                    tail = f.read_at(reach, n - reach)
                    ends = [m.end() for m in _END.finditer(tail)]
                    if ends or reach == n:
                        break
                    reach = min(n, 2 * reach)
            found[name] = n - reach + ends[-1] if ends else 0
        return found

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(f, a, min(a + self.size, n)) for f, n in end.items() for a in range(start.get(f, 0), n, self.size)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition, {})

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing is kept here: offsets lie with the query's checkpoint


class MgfSource(DataSource):
    """Options: ``path``, and ``rangeBytes``, how much of a file a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "mgf"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES))

    def reader(self, schema) -> MgfReader:
        return MgfReader(*self._options())

    def streamReader(self, schema) -> MgfStream:
        return MgfStream(*self._options())


def register(spark: SparkSession) -> None:
    """Make the source known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MgfSource)
