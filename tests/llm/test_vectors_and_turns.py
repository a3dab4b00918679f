"""Operators 11 to 13 against brute force, their SQL twins and edge cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from ionweave.llm import conversation_repair, queries, top_k, twins, vector_codes, vectors

NAN, INF = float("nan"), float("inf")
TURNS = "conv_id long, turn long, role string, text string, piece string, cost double, first int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def best_repair(turns):
    """All edits of a few turns, cheapest first: the least cost and audit, and the repaired turns. No two ways are merged."""
    seen, unfit = set(), []
    for role, text in turns:
        unfit.append(not re.search(r"[^\x20\x09-\x0D]", text) or (role, text) in seen)
        seen.add((role, text))
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, k, out = heapq.heappop(heap)
        shape = "".join(r[:1] or "-" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", shape):
            continue
        if k == len(turns) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", k, (*out, (role, ""))))
        if k < len(turns):
            role, text = turns[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, out))
            if not unfit[k]:
                extra = 5 * (not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text))
                heapq.heappush(heap, (cost + extra, audit + "K", k + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", k + 1, (*out, (new, text))))


def brute(table):
    """The contract over a list of (conv_id, turn, role, text), as plainly as can be."""
    found = {}
    for conv, turn, role, text in table:
        own = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen = dict.fromkeys(["blank", "duplicate", "truncated"], 0), set()
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, text = best_repair([r[1:] for r in own])
        out.append((conv, gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(n=60, seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "cut off", "", " \n", None, "Fine! ", "One. Two", "é!", "a. "]
    roles = ["user", "assistant", "system", "tool", None, "", "unknown"]
    table = []
    for conv in [None, *range(n)]:
        size = rng.randint(1, 3)
        for k in range(size):
            turn = rng.choice([k, k, k, k + 2, None])
            table.append((conv, turn, rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts if rng.random() < 0.5 else texts[:3])))
        if rng.random() < 0.2:
            table.append(table[-1])
    return table


def repaired(spark, table):
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in table], TURNS).repartition(3)
    return conversation_repair.report(conversation_repair.repair(conversation_repair.damage(df)))


def test_macro_codes_are_prefix_free():
    assert not any(a != b and b.startswith(a) for a in conversation_repair.CODES for b in conversation_repair.CODES)


@pytest.mark.parametrize("piece", [4096, 2, 1])
def test_conversations_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    table = conversations()
    assert rows(repaired(spark, table)) == brute(table)


def test_no_conversations(spark):
    assert rows(repaired(spark, [])) == []
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert rows(repaired(spark, [(dropped, 0, "user", "Hi.")])) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_and_repeated_turns(spark):
    """One conversation of 20,000 turns among small ones, one row 9,000 times, and texts of some MB."""
    rng = random.Random(8)
    table = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Well.", "cut", f"No {k % 50}!", ""]) + f" {k % 999}.") for k in range(20_000)]
    table += [(9, None, "user", "Again.")] * 9_000 + [(11, 0, "user", "x" * 3_000_000 + "."), (11, 1, "assistant", "y " * 3_000_000)]
    got = {r[0]: r for r in rows(repaired(spark, table))}
    own = []
    for conv, turn, role, text in table[:20_000]:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            own += [("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    layer, seen = {0: (0, "")}, set()  # the same search with strings for audits
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    for role, text in own:
        last = text.rstrip(" \t\n\v\f\r")
        unfit, extra = not last or (role, text) in seen, 5 * (last[-1:] not in (".", "!", "?"))
        seen.add((role, text))
        new = {}
        for state, (cost, audit) in layer.items():
            for n in range(3):
                ways = [("D", state, 2)] + ([] if unfit else [("R", 3 if state == 2 else 2, 1 + extra)] + ([("K", after[state, role[0]], extra)] if (state, role[0]) in after else []))
                for edit, to, price in ways:
                    way = (cost + 5 * n + price, audit + "I" * n + edit)
                    new[to] = min(new.get(to, way), way)
                state = 3 if state == 2 else 2
        layer = new
    cost, audit = min((c + 5 * len(t), a + t) for s, t in enumerate(("", "II", "I", "")) if s in layer for c, a in [layer[s]])
    assert got[7][6:8] == (cost, audit)
    n = 9_000 * (2 if zlib.crc32(b"9: ") % 20 == 3 else 1)
    assert got[9][3] == n - 1 and got[9][7].count("D") >= n - 1
    assert len(got) == 3 and got[11][7]


def embeddings(n=300, width=32, seed=1):
    rng = np.random.default_rng(seed)
    table = [(i, rng.normal(0, 0.2, width).tolist(), int(rng.integers(0, 3)) if i % 7 else None) for i in range(n)]
    table += [(n, None, 1), (n + 1, [None] * width, 1), (n + 2, [NAN] * width, 1), (n + 3, [INF] * width, 1), (n + 4, [1.0], 1), (n + 5, [], 1), (n + 6, [0.5] * width, 5)]
    return table + [(5, table[5][1], 2), (8, table[9][1], 0)] + [(400 + i, table[3][1], 0) for i in range(80)]


def codes_by_hand(table, rounds=2):
    width = 32
    fine = sorted((r for r in table if r[1] is not None and len(r[1]) == width and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0], np.float32(r[1]).tolist()))
    whole = np.floor(256 * np.array([r[1] for r in fine], np.float32).astype(float)).astype(int).reshape(len(fine), 16, 2)
    books = whole[:64].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        far = ((whole[:, :, None] - books[None]) ** 2).sum(3)
        best = far.argmin(2)
        if k < rounds:
            for part, entry in itertools.product(range(16), range(books.shape[1])):
                own = whole[best[:, part] == entry, part]
                if len(own):
                    books[part, entry] = [int(c) // len(own) for c in own.sum(0)]
    error = far.min(2).sum(1)
    sums = {}
    for r, e in zip(fine, error):
        sums[r[2]] = sums.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in b), int(e), sums[r[2]], digest) for r, b, e in zip(fine, best, error)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, whole int"


@pytest.fixture
def tables(spark, tmp_path):
    def write(table, kind=VECTORS):
        folder = str(tmp_path / f"t{len(table)}")
        spark.createDataFrame([(*r, "x", "y", 1) for r in table], kind).repartition(5).write.parquet(f"{folder}/embeddings.parquet")
        return folder

    return write


def test_vector_codes_against_brute_force(spark, tables):
    assert rows(queries.op12_vector_codes(spark, tables(embeddings()))) == codes_by_hand(embeddings())
    few = embeddings(20)[:20]
    assert rows(queries.op12_vector_codes(spark, tables(few))) == codes_by_hand(few)
    assert rows(queries.op12_vector_codes(spark, tables([]))) == []


def test_exponion_search_equals_a_full_search():
    rng = np.random.default_rng(0)
    for spread in (2, 30, 1 << 20):
        books = vector_codes.Books(rng.integers(-spread, spread, (1, 64, 4)))
        points, start = rng.integers(-spread, spread, (3000, 4)), rng.integers(0, 64, 3000)
        far = ((points[:, None] - books.entries[0]) ** 2).sum(2)
        codes, least = books.nearest(0, points, start)
        assert (codes == far.argmin(1)).all() and (least == far.min(1)).all()


def test_label_errors_without_a_broadcast(spark, monkeypatch):
    coded = spark.createDataFrame([(1, 5, 2), (2, 5, 3), (3, None, 4), (4, None, 5), (5, 6, 6)], "vec_id int, label int, error long")
    want = [(1, 5, 2, 5), (2, 5, 3, 5), (3, None, 4, 9), (4, None, 5, 9), (5, 6, 6, 6)]
    assert rows(vector_codes.with_label_errors(coded)) == want
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 1)
    assert rows(vector_codes.with_label_errors(coded)) == want


def best_by_hand(table, every, k):
    fine = [(r[0], np.floor(256 * np.float32(r[1]).astype(float)).astype(int)) for r in table if r[0] is not None and r[1] is not None and len(r[1]) == 32 and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for name, q in fine:
        if name % every == 0:
            found = sorted((-int(q @ v), other) for other, v in fine if other != name)[:k]
            out += [(name, rank, other, -score) for rank, (score, other) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf,shard,block", [(64, 1 << 14, 1 << 16), (3, 40, 1 << 16), (1, 7, 3)])
def test_top_k_against_brute_force(spark, monkeypatch, leaf, shard, block):
    monkeypatch.setattr(top_k, "LEAF", leaf)
    monkeypatch.setattr(top_k, "SHARD", shard)
    monkeypatch.setattr(top_k, "BLOCK", block)
    table = embeddings() + [(None, embeddings()[0][1], 1), (1000, [9.0] * 32, 1)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in table], VECTORS).repartition(4)
    assert sorted(map(tuple, top_k.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())) == best_by_hand(table, 50, 5)


def test_balls_prune_and_bound():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 2000, (20, 16))
    points = np.floor(centres[rng.integers(0, 20, 5000)] + rng.normal(0, 20, (5000, 16))).astype(np.int64)
    balls, looked = top_k.Balls(np.arange(5000), points), []
    found = top_k.Found(np.arange(5000, 5050), points[:50], 5, np.full(50, top_k.NONE))
    for level in range(len(balls.levels)):
        nodes = np.arange(1 << level)
        bounds = balls.bounds(level, found.queries, found.norms, nodes)
        for node, (a, b) in enumerate(zip(balls.cuts[level], balls.cuts[level][1:])):
            assert (bounds[:, node, None] >= found.queries @ balls.points[a:b].T).all()
    look = found.look
    found.look = lambda b, leaf, some: looked.append(len(some)) or look(b, leaf, some)
    found.search(balls)
    assert sum(looked) < 0.2 * 50 * (len(balls.cuts[-1]) - 1)
    assert (found.scores == -np.sort(-(points[:50] @ points.T), axis=1)[:, :5]).all()


def test_large_products_are_exact(spark):
    rng = np.random.default_rng(4)
    table = [(i, (rng.integers(-(1 << 23), 1 << 23, 32) / 256).tolist(), 0) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in table], VECTORS)
    assert sorted(map(tuple, top_k.top_k(df, df.where("vec_id % 20 = 0"), 3).collect())) == best_by_hand(table, 20, 3)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0] * 4, 1, "x", "y", 1)], VECTORS)
    assert rows(top_k.top_k(df, df.where("vec_id = 0"), 5)) == rows(top_k.top_k(df, df, 5)) == rows(top_k.top_k(df.limit(0), df.limit(0), 5)) == []
    far = spark.createDataFrame([(1, [vectors.LARGEST * 2] * 4, 1, "x", "y", 1)], VECTORS)
    assert rows(top_k.top_k(df.union(far), df, 5)) == []


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_vector_codes", "op13_top_k"])
def test_twins(spark, tmp_path, name):
    folder, db = str(tmp_path), duckdb.connect()
    spark.createDataFrame([(*r, "x", 1.0, 2) for r in conversations(40, 9)], TURNS).write.parquet(f"{folder}/conversations.parquet")
    unique = {r[0]: r for r in reversed(embeddings())}.values()
    spark.createDataFrame([(*r, "x", "y", 1) for r in unique], VECTORS).write.parquet(f"{folder}/embeddings.parquet")
    for t in ("conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    quoted = ", ".join(f'"{c}"' for c in got.columns)
    want = db.execute(f"SELECT {quoted} FROM ({getattr(twins, name.split('_')[0].upper() + '_SQL')})").fetchall()
    assert rows(got) == sorted(want, key=repr)
