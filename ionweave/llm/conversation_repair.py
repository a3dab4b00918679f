"""Operator 11: the cheapest edits that give a conversation the shape ``(s?(ua)+)?``.

A conversation's turns are edited in order: Keep, Rerole to user or assistant, Delete, and Insert of
an empty turn anywhere. What is written down (the audit) are the initials of the edits; of the cheapest
audits the least in ASCII order is taken. A run of inserts and the edit of the turn after it make
one macro edit. The codes of macro edits (``K``, ``ID``, ``IIR``, ...) are prefix-free, so of two audits
of equally many turns the first macro edit in which they differ decides. A layer (a turn) therefore
needs no strings: its states are ordered by the rank of the state before and the macro edit's rank,
each keeps a pointer to the state before, and the audit is put together from these pointers afterwards.

The same holds for parts of a conversation. Turns are sorted over the whole cluster, so a long
conversation lies in many partitions. Each piece of it (``PIECE`` turns or ``PIECE_BYTES`` at most) is solved
from every state to every state, pieces are joined by cost and rank, and each is then edited by itself.
A conversation that lies inside one partition, as nearly all do, is edited where it is sorted.

Null roles and texts count as one space. Turns go by number, nulls first; equal numbers by role and
text. A conversation with a null id is one like any other. Repeated rows are duplicates, in any
number. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import ASCII_SPACE, BATCH_BYTES, fresh_folder, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns and bytes of texts in a piece, about, at most.
PIECE, PIECE_BYTES = 4096, 4 << 20

# States: what has been put out so far is empty, the system's turn alone, or ends with user or assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_SAID = {"u": "user", "a": "assistant"}
_AFTER = {(EMPTY, "s"): SYSTEM, (USER, "a"): ASSISTANT} | {(state, "u"): USER for state in (EMPTY, SYSTEM, ASSISTANT)}
#: Inserts that end a conversation in each state.
TAILS = ("", "II", "I", "")
#: Macro edits, by rank. More than two inserts in a row are never cheapest: without two of them the state is the same.
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
FINE, CUT_OFF, UNFIT = range(3)
_INITIALS = ("s", "u", "a", "")
_FAR = 1 << 62


def _next(state: int) -> str:
    """The role whose turn it is."""
    return "a" if state == USER else "u"


def _macros(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """Every cheapest macro edit of a turn as (state after, state before, cost, rank of its code)."""
    best: dict = {}
    for before in range(4):
        state = before
        for n in range(3):
            extra = TRUNCATED * (fault == CUT_OFF)
            ways = [("D", state, DELETE)]
            if fault != UNFIT:
                ways.append(("R", _AFTER[state, _next(state)], REROLE + extra))
                if (state, initial) in _AFTER:
                    ways.append(("K", _AFTER[state, initial], KEEP + extra))
            for edit, after, cost in ways:
                way = (cost + n * INSERT, CODES.index("I" * n + edit))
                best[after, before] = min(way, best.get((after, before), way))
            state = _AFTER[state, _next(state)]
    return [(after, before, *way) for (after, before), way in best.items()]


#: By the turn's class: three times the index of its initial, and its fault.
MACROS = [_macros(initial, fault) for initial in _INITIALS for fault in (FINE, CUT_OFF, UNFIT)]


def layers(classes: bytes, start: int) -> tuple[list[int], list[int], list[tuple]]:
    """Of each state after all turns, the cost and the rank; of each turn and state, the pointer back."""
    cost, rank, pointers = [_FAR] * 4, [0] * 4, []
    cost[start] = 0
    for c in classes:
        least, key, back = [_FAR] * 4, [0] * 4, [None] * 4
        for after, before, price, code in MACROS[c]:
            total = cost[before] + price
            if total <= least[after] and cost[before] < _FAR:
                order = rank[before] * len(CODES) + code
                if total < least[after] or order < key[after]:
                    least[after], key[after], back[after] = total, order, (before, code)
        cost = least
        pointers.append(back)
        places = sorted(key[s] for s in range(4) if least[s] < _FAR)
        rank = [places.index(key[s]) if least[s] < _FAR else 0 for s in range(4)]
    return cost, rank, pointers


def last_state(cost: list[int], rank: list[int]) -> int:
    """The state that a conversation had best end in."""
    return min(range(4), key=lambda s: (cost[s] + INSERT * len(TAILS[s]), rank[s]))


def walk_back(pointers: list[tuple], end: int) -> list[str]:
    """The codes of the macro edits that lead to a state."""
    codes = []
    for back in reversed(pointers):
        end, code = back[end]
        codes.append(CODES[code])
    return codes[::-1]


@lru_cache(1 << 14)
def _short(classes: bytes) -> tuple[tuple[str, ...], int, int]:
    cost, rank, pointers = layers(classes, EMPTY)
    end = last_state(cost, rank)
    return tuple(walk_back(pointers, end)), end, cost[end] + INSERT * len(TAILS[end])


def solve(classes: bytes) -> tuple[tuple[str, ...], int, int]:
    """Codes, last state and cost of a whole conversation; short ones are remembered."""
    return _short(classes) if len(classes) <= 64 else _short.__wrapped__(classes)


def rewrite(turns: list[dict], codes, state: int, last: bool) -> tuple[str, list[dict]]:
    """The audit and the turns that edits make; ``last``: no turns follow."""
    out = []

    def say(letter: str, text: str) -> int:
        out.append({"role": _SAID[letter], "text": text})
        return _AFTER[state, letter]

    for turn, code in zip(turns, codes, strict=True):
        for edit in code:
            if edit == "I":
                state = say(_next(state), "")
            elif edit == "R":
                state = say(_next(state), turn["text"])
            elif edit == "K":
                out.append(turn)
                state = _AFTER[state, turn["role"][:1]]
    tail = TAILS[state] if last else ""
    for _ in tail:
        state = say(_next(state), "")
    return "".join(codes) + tail, out


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped, copies``: turns after the damage of the contract.

    A dropped turn stays as a row without role and text, so that its conversation is not lost.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = lambda n: F.col("kind") == n
    text = F.when(kind(0) | kind(1), "").when(kind(2), F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind(0), "").when(kind(4), "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind(0).alias("dropped"), F.when(kind(3), 2).otherwise(1).cast("long").alias("copies"))


def turns(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped, copies`` of a table as it is."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(False).alias("dropped"), F.lit(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Different turns with how often they occur, whether they are blank or end well, and whether an earlier turn says the same."""
    key = ["conv_id", "turn", "role", "text", "dropped"]
    rows = rows.groupBy(*key).agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("said", F.when(~F.col("dropped"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    again = rows.where("NOT dropped").groupBy(F.col("conv_id").alias("conv"), F.col("said").alias("same"))
    again = again.agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(again, rows.conv_id.eqNullSafe(again.conv) & (rows.said == again.same), "left")
    end: Column = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    return joined.select(
        *key, "copies", (end == "").alias("blank"), F.right(end, F.lit(1)).isin(".", "!", "?").alias("ended"),
        (F.col("n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("later"),
    )


_FIGURES = ["blank", "duplicate", "truncated", "illegal", "cost", "places"]
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


class _Piece:
    """Turns of a conversation that follow each other, and what is known of them."""

    def __init__(self, conv) -> None:
        self.conv, self.classes, self.turns, self.bytes = conv, bytearray(), [], 0
        self.figures = dict.fromkeys(_FIGURES, 0)
        self.low = self.high = self.first = self.last = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.figures["illegal"] += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.figures["places"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            self.figures[fault] += 1
        unfit = fault in ("blank", "duplicate")
        at = _INITIALS.index(initial) if initial in ("s", "u", "a") else 3
        self.classes.append(3 * at + (UNFIT if unfit else CUT_OFF if fault else FINE))
        text = "" if unfit else text  # it is deleted
        self.turns.append({"role": role, "text": text})
        self.bytes += len(text)

    def row(self, name: int, whole: bool) -> dict:
        found = {"conv_id": self.conv, "piece": name, "whole": whole, "low": self.low, "high": self.high, "first": self.first, "last": self.last}
        classes = bytes(self.classes)
        if whole:
            codes, _, self.figures["cost"] = solve(classes)
            audit, said = rewrite(self.turns, codes, EMPTY, True)
            return found | self.figures | {"audit": audit, "turns": said, "classes": b"", "costs": [], "ranks": []}
        ways = [layers(classes, start)[:2] for start in range(4)]
        return found | self.figures | {"audit": None, "turns": self.turns, "classes": classes, "costs": [c for w in ways for c in w[0]], "ranks": [r for w in ways for r in w[1]]}


def _solved(rows: DataFrame) -> DataFrame:
    """The pieces of sorted turns. ``whole``: the piece is all of a conversation, and edited already."""
    kind = dict(rows.dtypes)["conv_id"]
    ddl = f"conv_id {kind}, piece long, whole boolean, low long, high long, first string, last string, {', '.join(f'{n} long' for n in _FIGURES)}, audit string, turns array<struct<role:string,text:string>>, classes binary, costs array<long>, ranks array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        task, count, piece, sure, ready, size, schema = pyspark.TaskContext.get().partitionId() << 32, 0, None, False, [], 0, None
        for batch in batches:
            if schema is None:
                fields = [("conv_id", batch.schema.field("conv_id").type), ("piece", pa.int64()), ("whole", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string())]
                fields += [(n, pa.int64()) for n in _FIGURES] + [("audit", pa.string()), ("turns", _TURNS), ("classes", pa.binary()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))]
                schema = pa.schema(fields)
            for conv, turn, role, text, dropped, copies, blank, ended, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "copies", "blank", "ended", "later"))):
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        ready.append(piece.row(task + count, sure))
                        size, count = size + piece.bytes + len(piece.turns), count + 1
                    sure = piece is not None  # the first one may begin in the partition before
                    piece = _Piece(conv)
                for k in range(0 if dropped else copies):
                    if len(piece.turns) >= PIECE or piece.turns and piece.bytes + len(text) > PIECE_BYTES:
                        ready.append(piece.row(task + count, False))
                        size, count = size + piece.bytes + len(piece.turns), count + 1
                        sure, piece = False, _Piece(conv)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(ready, schema)
                        ready, size = [], 0
                    piece.add(turn, role, text, "blank" if blank else "duplicate" if later or k else "" if ended else "truncated")
        if piece is not None:
            ready.append(piece.row(task + count, False))  # it may go on in the next partition
            yield pa.RecordBatch.from_pylist(ready, schema)

    return rows.mapInArrow(run, ddl)


def _joined(pieces: DataFrame) -> DataFrame:
    """``piece, start, end, final`` of pieces, and what the seams add to their figures.

    A task holds some numbers for each piece of a conversation, about a tenth of what its audit takes.
    """

    def choose(own: list[dict]) -> list[dict]:
        cost, rank, back = [0, _FAR, _FAR, _FAR], [0] * 4, []
        for p in own:
            ways = [
                min(((cost[b] + p["costs"][4 * b + a], rank[b], p["ranks"][4 * b + a], b) for b in range(4) if cost[b] < _FAR and p["costs"][4 * b + a] < _FAR), default=(_FAR, 0, 0, None))
                for a in range(4)
            ]
            places = sorted(w[1:3] for w in ways if w[0] < _FAR)
            cost, rank = [w[0] for w in ways], [places.index(w[1:3]) if w[0] < _FAR else 0 for w in ways]
            back.append([w[3] for w in ways])
        end, found, high, last = last_state(cost, rank), [], None, None
        tail = INSERT * len(TAILS[end])
        for p, b in zip(reversed(own), reversed(back)):
            price = p["costs"][4 * b[end] + end]
            found.append({"piece": p["piece"], "start": b[end], "end": end, "final": not found, "more_cost": price + (0 if found else tail)})
            end = b[end]
        found.reverse()
        for p, f in zip(own, found):
            f["more_illegal"] = int(None not in (last, p["first"]) and last + p["first"] not in ("su", "ua", "au"))
            f["more_places"] = -int(p["low"] is not None and p["low"] == high)
            last, high = p["last"] if p["last"] is not None else last, p["high"] if p["high"] is not None else high
        return found

    names = ["piece", "start", "end", "final", "more_cost", "more_illegal", "more_places"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            ready = []
            for p in batch.to_pylist():
                if own and own[-1]["conv_id"] != p["conv_id"]:
                    ready += choose(own)
                    own = []
                own.append(p)
            yield pa.RecordBatch.from_pylist(ready, pa.schema(zip(names, kinds)))
        if own:
            yield pa.RecordBatch.from_pylist(choose(own), pa.schema(zip(names, kinds)))

    rows = pieces.select("conv_id", "piece", "costs", "ranks", "first", "last", "low", "high")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return rows.mapInArrow(run, "piece long, start int, end int, final boolean, more_cost long, more_illegal long, more_places long")


def _edited(pieces: DataFrame) -> DataFrame:
    """``piece, audit, turns`` of pieces whose first and last states are known."""
    schema = pa.schema([("piece", pa.int64()), ("audit", pa.string()), ("said", _TURNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                codes = walk_back(layers(p["classes"], p["start"])[2], p["end"])
                audit, said = rewrite(p["turns"], codes, p["start"], p["final"])
                yield pa.RecordBatch.from_pylist([{"piece": p["piece"], "audit": audit, "said": said}], schema)

    return pieces.select("piece", "classes", "turns", "start", "end", "final").mapInArrow(run, "piece long, audit string, said array<struct<role:string,text:string>>")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations: ``conv_id, piece, whole, low, high, blank, duplicate, truncated, illegal, cost, places, audit, turns``.

    ``rows`` are those of ``turns`` or ``damage``. A conversation is one row (``whole``) or several, in
    the order of ``piece``; their audits and turns follow each other and their figures add up. ``low``
    and ``high`` are the least and the greatest turn, ``places`` how many different ones there are.
    """
    spark = rows.sparkSession
    small_batches(spark)
    order = ["conv_id", "turn", "role"]
    sorted_ = judged(rows).repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    folder, edits = fresh_folder(spark, "conversations"), fresh_folder(spark, "edits")
    _solved(sorted_).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    names = ["conv_id", "piece", "whole", "low", "high", *_FIGURES, "audit", "turns"]
    split = pieces.where("NOT whole").drop("audit")
    split = split.join(_joined(split), "piece")
    for n in ("cost", "illegal", "places"):
        split = split.withColumn(n, F.col(n) + F.col(f"more_{n}"))
    split.write.parquet(edits)
    split = spark.read.parquet(edits)
    split = split.drop("turns").join(_edited(split).withColumnRenamed("said", "turns"), "piece")
    return pieces.where("whole").select(*names).unionByName(split.select(*names))


def _gathered(pieces: DataFrame, ddl: str) -> DataFrame:
    """A row a conversation of those in several pieces; texts run through a digest, none is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, audit, digest, begun, schema = None, [], None, False, None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((n, pa.int64()) for n in ("low", "high", *_FIGURES)), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for p in batch.to_pylist():
                if row is None or row["conv_id"] != p["conv_id"]:
                    if row is not None:
                        yield ended()
                    row, audit, digest, begun = {n: p[n] for n in ("conv_id", "low", "high")} | dict.fromkeys(_FIGURES, 0), [], hashlib.sha256(), False
                for n in _FIGURES:
                    row[n] += p[n]
                row["low"], row["high"] = p["low"] if row["low"] is None else row["low"], row["high"] if p["high"] is None else p["high"]
                audit.append(p["audit"])
                for t in p["turns"]:
                    digest.update(f"{chr(10) * begun}{t['role']}:{t['text']}".encode())
                    begun = True
        if row is not None:
            yield ended()

    return pieces.mapInArrow(run, ddl)


def report(repaired: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: a row a conversation.

    A SHA-256 needs a conversation's texts one after the other, so those of one in several pieces
    run through one task; that task keeps none of them.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    names = ["conv_id", "low", "high", *_FIGURES, "audit"]
    whole = repaired.where("whole").select(*names, F.sha2(said, 256).alias("repaired_sha256"))
    ddl = ", ".join(f"{n} {k}" for n, k in whole.dtypes)
    parts = repaired.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("places"), F.lit(0)).cast("long").alias("gaps")
    return whole.unionByName(_gathered(parts, ddl)).select("conv_id", gaps, *_FIGURES[:-1], "audit", "repaired_sha256")
