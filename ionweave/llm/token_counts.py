"""Token counts by compiled finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE vocabulary without
building them:

* The *splitter* reads character classes and marks where pre-tokens begin. It has 11 states,
  so any chunk of text is a map from 11 entry states to 11 exit states. Chunk maps compose
  associatively: the maps of all chunks of a batch are made side by side, a parallel prefix
  scan gives each chunk's entry state, and a last sweep emits the marks. Where a mark depends
  on the next character, the transition after it emits the mark of the position before.
* The *counter* reads a pre-token's bytes. Each transition is annotated with the change in the
  number of emitted tokens. A state holds the trie nodes of all tokens that may still be open,
  the token before each and how far its count lies behind; it is compiled when first reached
  and kept, so that a transition costs one lookup afterwards. It rests on the fact that a
  sequence of tokens is what the merges give exactly if every pair of neighbours is what the
  merges give for the pair's own bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ionweave.llm.common import WHITE_SPACE, alone, blocks, by_batch, code_points, texts_of

# --- the splitter ---------------------------------------------------------------------

#: Character classes: letters apart from those of contractions, then these.
LETTER, TAIL, R_OR_V, ELL, EE, NUMBER, OTHER, QUOTE, SPACE, BLANK, RESET = range(11)
#: States: what has been read since the last certain boundary.
START, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_RV, QUOTED_L, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK = range(11)
N_STATES = N_CLASSES = 11
HERE, BEFORE = 1, 2


def _fresh(c: int) -> tuple[int, int]:
    """The step on class c where a new pre-token begins."""
    if c <= EE:
        return LETTERS, HERE
    return {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED, SPACE: ONE_SPACE, BLANK: ONE_BLANK}[c], HERE


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state, and whether pre-tokens begin here and at the character before."""
    if c == RESET:
        return START, BEFORE if state in (QUOTED_RV, QUOTED_L) else 0
    if state == QUOTED:
        if c == TAIL:
            return START, 0
        if c == R_OR_V:
            return QUOTED_RV, 0
        if c == ELL:
            return QUOTED_L, 0
        return (OTHERS, 0) if c in (OTHER, QUOTE) else _fresh(c)
    if state in (QUOTED_RV, QUOTED_L):
        if c == (EE if state == QUOTED_RV else ELL):
            return START, 0
        after, mark = _step(LETTERS, c)
        return after, mark | BEFORE
    if c in (SPACE, BLANK) and state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
        return (RUN_SPACE if c == SPACE else RUN_BLANK), 0
    if state in (ONE_SPACE, RUN_SPACE):
        kind = LETTERS if c <= EE else NUMBERS if c == NUMBER else OTHERS
        return kind, 0 if state == ONE_SPACE else BEFORE
    if state == RUN_BLANK:
        after, mark = _fresh(c)
        return after, mark | BEFORE
    same = state == LETTERS and c <= EE or state == NUMBERS and c == NUMBER or state == OTHERS and c in (OTHER, QUOTE)
    return (state, 0) if same else _fresh(c)


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables by class * N_STATES + state: next state, marks."""
    steps = [_step(s, c) for c in range(N_CLASSES) for s in range(N_STATES)]
    return np.array([a for a, _ in steps], np.uint8), np.array([m for _, m in steps], np.uint8)


@lru_cache(1)
def twice() -> np.ndarray:
    """The next state but one, by (class * N_CLASSES + next class) * N_STATES + state."""
    after = splitter()[0].reshape(N_CLASSES, N_STATES)
    return np.array([after[d, after[c]] for c in range(N_CLASSES) for d in range(N_CLASSES)], np.uint8).reshape(-1)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for major, kind in (("L", LETTER), ("N", NUMBER)):
        for first, last in code_points(major):
            kinds[first : last + 1] = kind
    for c in range(0x3001):
        if re.match(f"[{WHITE_SPACE}]", chr(c)):
            kinds[c] = BLANK
    for letters, kind in (("stmd", TAIL), ("rv", R_OR_V), ("l", ELL), ("e", EE), ("'", QUOTE), (" ", SPACE)):
        kinds[[ord(x) for x in letters]] = kind
    return kinds


def marks(kinds: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Where pre-tokens begin, by chunk maps and a parallel prefix scan over them."""
    after, marked = splitter()
    n = len(kinds)
    rows = max(1, -(-n // chunk))
    grid = np.full(rows * chunk, RESET, np.uint8)
    grid[:n] = kinds
    base = grid.reshape(rows, chunk).T.astype(np.intp) * N_STATES  # a row for each place in a chunk
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    pairs = (base[0::2] * N_CLASSES + base[1::2])[:, :, None]
    for place in pairs:  # the maps take two characters a step
        maps = twice()[place + maps]
    far = 1
    while far < rows:  # after the step, a map spans twice as many chunks
        maps[far:] = np.take_along_axis(maps[far:], maps[:-far].astype(np.intp), axis=1)
        far *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.intp)
    out = np.empty((chunk, rows), np.uint8)
    for k, place in enumerate(base):
        at = place + state
        out[k] = marked[at]
        state = after[at].astype(np.intp)
    found = out.T.reshape(-1)
    begins = found & HERE
    begins[:-1] |= found[1:] >> 1 & 1
    return np.flatnonzero(begins[:n])


# --- the counter ----------------------------------------------------------------------


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class CountTransducer:
    """Counts the tokens of one pre-token, a transition for each byte."""

    #: Compiled transitions that a worker keeps before it begins anew, and words in each of its
    #: two generations: a word not met while a generation fills is forgotten.
    MOST_STEPS, MOST_WORDS = 2_000_000, 300_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = [t["content"] for t in model["added_tokens"]]
        as_byte = {c: b for b, c in enumerate(byte_letters())}
        pieces = {t: bytes(as_byte[c] for c in t) for t in model["model"]["vocab"]}
        self.bytes_of = {i: pieces[t] for t, i in model["model"]["vocab"].items()}
        vocab = {b: i for i, b in self.bytes_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> rank of the merge that makes it, its two parts
        for rank, (a, b) in enumerate(pairs):
            pair, token = (vocab[pieces[a]], vocab[pieces[b]]), vocab[pieces[a] + pieces[b]]
            self.merge.setdefault(pair, (rank, token))
            self.halves.setdefault(token, (rank, *pair))
        self.alone = [vocab[bytes([b])] for b in range(256)]
        # trie: node -> {byte: node}; token_at: node -> token
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        for piece, i in vocab.items():
            node = 0
            for b in piece:
                node = self.child[node].setdefault(b, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.token_at.append(None)
            self.token_at[node] = i
        self.fits: dict[tuple[int | None, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        first = ((0, None, 0),)
        self.states, self.number, self.step = [first], {first: 0}, {}
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.fits.clear()

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a few bytes, by the merges themselves."""
        out = [self.alone[b] for b in data]
        while len(out) > 1:
            best = min(((self.merge.get(p, (1 << 60,))[0], k) for k, p in enumerate(zip(out, out[1:]))))
            if best[0] == 1 << 60:
                break
            k = best[1]
            out[k : k + 2] = [self.merge[out[k], out[k + 1]][1]]
        return out

    def _fit(self, before: int | None, token: int) -> bool:
        found = self.fits.get((before, token))
        if found is None:
            found = self.merged(self.bytes_of[token]) == [token] if before is None else self._apart(before, token)
            self.fits[before, token] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens, each made by merges alone, stay apart side by side.

        Undoes the merges of both from the last one back. The two symbols at the seam exist
        together until one is merged away; a merge of the two of a lower rank comes first
        then. Of equal ranks the left one comes first.
        """
        atom = (-1, 0, 0)
        until, on_left = 1 << 60, True
        while True:
            rank = self.merge.get((left, right), (1 << 60,))[0]
            if rank < until or rank == until and not on_left and rank < 1 << 60:
                return False
            a, b = self.halves.get(left, atom), self.halves.get(right, atom)
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                until, on_left, left = a[0], True, a[2]
            else:
                until, on_left, right = b[0], False, b[1]

    def _compile(self, state: int, b: int) -> tuple[int, int]:
        kept, token, count = [], None, 0
        for node, before, behind in self.states[state]:
            child = self.child[node].get(b)
            if child is None:
                continue
            if self.child[child]:
                kept.append((child, before, behind))
            t = self.token_at[child]
            if token is None and t is not None and self._fit(before, t):
                token, count = t, behind + 1
        new = (*((child, before, behind - count) for child, before, behind in kept), (0, token, 0))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        found = self.step[state << 8 | b] = (number, count)
        return found

    def count(self, piece: str) -> int:
        """The number of tokens of a pre-token."""
        total = 1 if piece in self.specials else self.words.get(piece) or self.older.get(piece)
        if total is None:
            if len(self.step) > self.MOST_STEPS:
                self._clear()
            total = state = 0
            step = self.step
            for b in piece.encode("utf-8", "surrogatepass"):
                state, n = step.get(state << 8 | b) or self._compile(state, b)
                total += n
        if len(self.words) >= self.MOST_WORDS:
            self.older, self.words = self.words, {}
        self.words[piece] = total
        return total

    def pieces(self, texts: list[str]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """The pre-tokens of the texts in order, some at a time: the different ones as UTF-8, the
        place of each pre-token among them, and the text that each is of.

        A string of a special token is a piece of its own. Words are cut and made distinct in
        Arrow, so that Python sees each one once.
        """
        parts: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            rest = [text]
            for special in self.specials:
                if special in text:
                    rest = [p for x in rest for p in (x.split(special) if x not in self.specials else [x])]
                    rest = [p for x in rest for p in (special, x)][1:]
            parts += [(i, p) for p in rest if p]
        for a, b in blocks([len(p) for _, p in parts], 1 << 20):
            joined = "\0".join(p for _, p in parts[a:b])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum([len(p) + 1 for _, p in parts[a:b]]) - 1
            firsts = np.concatenate([[0], ends[:-1] + 1])
            kinds = classes()[codes]
            kinds[ends[:-1]] = RESET
            whole = [k for k in range(b - a) if parts[a + k][1] in self.specials]
            for k in whole:  # one letter after another has no boundary inside
                kinds[firsts[k] : ends[k]] = LETTER
            # the separators are cut out as words too, and left out of the places
            cuts = np.sort(np.concatenate([marks(kinds), ends[:-1]]))
            words = ~np.isin(cuts, ends[:-1], assume_unique=True)
            data = joined.encode("utf-8", "surrogatepass")
            at = np.append(cuts, len(codes))
            if len(data) != len(codes):
                at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])[at]
            coded = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
            owners = np.array([i for i, _ in parts[a:b]])[np.searchsorted(ends, cuts[words])]
            yield coded.dictionary, coded.indices.to_numpy()[words], owners

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; a string of a special token counts as one."""
        totals = np.zeros(len(texts), np.int64)
        for words, places, owners in self.pieces(texts):
            found = np.array([self.count(w.decode("utf-8", "surrogatepass")) for w in words.to_pylist()])
            totals += np.bincount(owners, found[places] if len(places) else None, len(texts)).astype(np.int64)
        return totals.tolist()


@lru_cache(2)
def transducer(path: str) -> CountTransducer:
    """One compiled transducer a worker."""
    return CountTransducer(path)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Bytes and tokens of every text: ``doc_id, n_bytes, n_tokens``.

    ``vocabulary`` is the path of a byte-level BPE tokenizer file that all machines have.
    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows
    give repeated rows; other columns are ignored; an empty table gives no rows.
    """

    def make():
        alone("token_counts", transducer.cache_clear)
        counter = transducer(vocabulary)

        def apply(batch):
            ids = batch.column("doc_id")
            texts = texts_of(batch)
            yield [ids, [len(t.encode("utf-8", "surrogatepass")) for t in texts], counter.counts(texts)]

        return apply

    return by_batch(docs, ["doc_id", "text"], OUT, "doc_id long, n_bytes long, n_tokens long", make)
