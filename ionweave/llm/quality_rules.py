"""Quality rules from repetition coverage.

A text's words become 64-bit codes; rolling hashes of several n-gram lengths run over them in
numpy, each length from the one before. Words inside an n-gram that occurs more than once are
covered, and the share of a text's word characters inside covered words is compared with a
limit for each length; so are the characters of lines that repeat an earlier line.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ionweave.llm.common import ASCII_SPACE, WORD_PATTERN, blocks, by_batch, texts_of

#: Most of the word characters that may lie in duplicated n-grams of each length.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of the word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.20
#: Most symbols of SYMBOLS for each word.
SYMBOL_LIMIT = 0.10
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20

_WORDS = re.compile(WORD_PATTERN).findall
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]").findall
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> np.ndarray:
    """A well mixed 64-bit code for each word; equal words have equal codes."""
    known: dict[str, int] = {}
    x = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.uint64, len(words))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def covered(codes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each n-gram length, which words lie in an n-gram that occurs twice or more.

    A longer n-gram can only repeat where a shorter one does, so the search ends with the
    first length without repeats.
    """
    found, rolled, done = {}, codes, 1
    for n in sorted(lengths):
        none = np.zeros(len(codes), bool)
        while done < n and len(rolled) > 1:
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(32))) * _ROLL + codes[done:]
            done += 1
        if done < n or not len(rolled) or found and not found[max(found)].any():
            found[n] = none
            continue
        order = np.argsort(rolled, kind="stable")
        same = rolled[order[1:]] == rolled[order[:-1]]
        repeated = np.zeros(len(rolled), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        steps = np.zeros(len(codes) + 1, np.int64)
        starts = np.flatnonzero(repeated)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + n, -1)
        found[n] = np.cumsum(steps[:-1]) > 0
    return found


def measure(text: str, limits: dict[int, float]) -> tuple:
    """The figures of one text, in the order of OUT after doc_id."""
    words = _WORDS(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    symbols = len(_SYMBOL(text))
    seen: set[str] = set()
    lines = line_chars = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(ASCII_SPACE):
                if line in seen:
                    lines += 1
                    line_chars += sum(map(len, _WORDS(line)))
                seen.add(line)
    cover = covered(_codes(words), sorted({REPEAT_WINDOW, *limits})) if n else {}
    repeats = int(cover[REPEAT_WINDOW].sum()) if n else 0
    shares = {k: float(lengths[cover[k]].sum()) / chars if n else 0.0 for k in limits}
    line_share = line_chars / chars if n else 0.0
    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
    good = line_share <= LINE_LIMIT and symbols <= SYMBOL_LIMIT * n and all(shares[k] <= most for k, most in limits.items())
    return n, chars, symbols, lines, repeats, failed, not failed and good, line_share, max(shares.values(), default=0.0)


OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_share", pa.float64()), ("dup_ngram_share", pa.float64())]
)
DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"
)


def repetition_rules(docs: DataFrame, limits: dict[int, float] | None = None) -> DataFrame:
    """One row of figures and a verdict for each row of ``docs`` (``doc_id, text``).

    A null or empty text has no words and fails; a null doc_id stays null; repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows. ``limits`` maps
    n-gram lengths to the largest covered share of the word characters.
    """
    limits = dict(NGRAM_LIMITS if limits is None else limits)

    def make():
        def apply(batch):
            texts = texts_of(batch)
            for a, b in blocks([len(t) + 200 for t in texts]):
                rows = map(measure, texts[a:b], repeat(limits))
                yield [batch.column("doc_id").slice(a, b - a), *map(list, zip(*rows, strict=True))]

        return apply

    return by_batch(docs, ["doc_id", "text"], OUT, DDL, make)
