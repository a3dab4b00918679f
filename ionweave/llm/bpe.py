"""Byte-pair encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the merge rank of each pair
of neighbours. The lowest rank, leftmost on ties, is merged first; an entry whose pair has
changed meanwhile is stale and skipped. Decoding concatenates vocabulary strings.

The tokenizer file gives vocabulary, merges, special tokens, the pattern of words, and whether
a word's end is marked. Text is put in NFC, white space becomes a blank and letters become
small where the file says so.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ionweave.llm.common import ASCII_SPACE, WHITE_SPACE, alone, blocks, by_batch, char_set, points_of, texts_of
from ionweave.llm.token_counts import byte_letters


#: A place in a word takes so many bits of an entry of the queue.
PLACE_BITS = 32
PLACE = (1 << PLACE_BITS) - 1


class Words(dict):
    """Of each word that was met, the bytes of its ids; a new one is merged, or taken from the older generation."""

    def __init__(self, merge: Callable[[str], list[int]], older: dict[str, bytes]):
        self.merge, self.older = merge, older

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = array("i", self.merge(word)).tobytes()
        self[word] = found
        return found


class Bpe:
    """Encoder and decoder of one tokenizer file whose pre-tokenizer keeps a pattern's matches."""

    #: Words in each of the two generations that a worker remembers.
    MOST_WORDS = 250_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        steps = file["normalizer"]["normalizers"] if file["normalizer"] else []
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.small = any(s["type"] == "Lowercase" for s in steps)
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("the pre-tokenizer has to keep the matches of its pattern and nothing else")
        # the same pattern for the standard library's engine, which is faster; and for ASCII texts
        # runs of letters go first: they are the most frequent, and no other alternative begins with a letter
        pattern = "|".join(sorted(split["pattern"]["Regex"].split("|"), key=lambda p: p != r"[\p{L}]+"))
        self.find = re.compile(self._spelled(pattern, char_set("L"), char_set("N"), WHITE_SPACE)).findall
        self.find_ascii = re.compile(self._spelled(pattern, "A-Za-z", "0-9", ASCII_SPACE)).findall
        # code points that Python doesn't know: the library, whose tables are newer, may
        self.unknown = np.array([unicodedata.category(c) == "Cn" for c in map(chr, range(0x110000))])
        self.path, self.library = path, None
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # a pair's rank, from 1, above the bits for a place: with a place it is an entry of the queue
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(pairs, 1):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), rank << PLACE_BITS)
        self.made = [-1, *(self.vocab[a + b] for a, b in pairs)]
        letters = byte_letters()
        self.inner, self.final = ([self.vocab.get(letters[b] + end) for b in range(256)] for end in ("", self.end))
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        strings = {i: s for s, i in [*self.vocab.items(), *self.specials.items()]}
        self.strings = pa.array([strings.get(i) for i in range(max(strings) + 1)])
        self.words = Words(self.merge, {})

    @staticmethod
    def _spelled(pattern: str, letters: str, numbers: str, space: str) -> str:
        return pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", space)

    def merge(self, word: str) -> list[int]:
        """The token ids of one word."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n = len(ids)
        ids.append(-1)  # stands after the last symbol and, as place -1, before the first; no pair has it
        after, before = list(range(1, n + 1)), list(range(-1, n))
        get, made, pop, push = self.merges.get, self.made, heapq.heappop, heapq.heappush
        queue = [m | i for i, p in enumerate(zip(ids, ids[1:])) if (m := get(p))]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & PLACE
            j = after[i]
            if get((ids[i], ids[j])) != entry - i:
                continue  # stale
            ids[i] = token = made[entry >> PLACE_BITS]
            ids[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if m := get((token, ids[k])):
                push(queue, m | i)
            k = before[i]
            if m := get((ids[k], token)):
                push(queue, m | k)
        return [i for i in ids if i >= 0]

    def newer(self, text: str) -> bool:
        """Whether a text has code points that Python does not know."""
        return bool(self.unknown[points_of(text)].any())

    def _normalized(self, text: str) -> str:
        """The library's normal form of a text."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).normalizer
        return self.library.normalize_str(text) if self.library else text

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = self.find_ascii(text.lower() if self.small else text)
        else:
            if self.newer(text):
                text = self._normalized(text)
            else:
                if self.nfc:
                    text = unicodedata.normalize("NFC", text)
                if self.small:  # letter by letter: no rule for a sigma at a word's end
                    text = text.replace("Σ", "σ").lower()
            words = self.find(text)
        if len(self.words) >= self.MOST_WORDS:
            self.words.older = {}  # the one before the last
            self.words = Words(self.merge, self.words)
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """The token ids of a text."""
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.int32(self.specials[m[0]]).tobytes()]
            at = m.end()
        parts.append(self._plain(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), np.int32)

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """The token ids of each text."""
        ids = list(map(self.encode, texts))
        offsets = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The vocabulary strings of each list of token ids, a blank between them."""
        flat = ids.flatten()
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.strings.take(flat)), " ")


@lru_cache(2)
def tokenizer(path: str) -> Bpe:
    """One tokenizer a worker."""
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` (array of int) for every row of ``docs`` (``doc_id, text``).

    ``vocabulary`` is the path of a tokenizer file that all machines have. A null or empty text
    has no ids; a null doc_id stays null; repeated rows give repeated rows; other columns are
    ignored; an empty table gives no rows.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make():
        alone("bpe", tokenizer.cache_clear)
        bpe = tokenizer(vocabulary)

        def apply(batch):
            texts = texts_of(batch)
            for a, b in blocks([2 * len(t) + 50 for t in texts]):
                yield [batch.column("doc_id").slice(a, b - a), bpe.encode_all(texts[a:b])]

        return apply

    return by_batch(docs, ["doc_id", "text"], out, "doc_id long, ids array<int>", make)


def code(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``decode`` of ``encode`` in one pass, so that ids don't travel between two workers: ``doc_id, ids, decoded``."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def make():
        alone("bpe", tokenizer.cache_clear)
        bpe = tokenizer(vocabulary)

        def apply(batch):
            texts = texts_of(batch)
            for a, b in blocks([5 * len(t) + 50 for t in texts]):
                ids = bpe.encode_all(texts[a:b])
                yield [batch.column("doc_id").slice(a, b - a), ids, bpe.decode(ids)]

        return apply

    return by_batch(docs, ["doc_id", "text"], out, "doc_id long, ids array<int>, decoded string", make)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded``: the rows of ``encode`` with the text that their ids stand for.

    Null or no ids give an empty text.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def make():
        alone("bpe", tokenizer.cache_clear)
        bpe = tokenizer(vocabulary)

        def apply(batch):
            column = batch.column("ids")
            sizes = [4 * (n or 0) + 50 for n in pc.list_value_length(column).to_pylist()]
            for a, b in blocks([3 * n for n in sizes]):
                part = column.slice(a, b - a)
                yield [batch.column("doc_id").slice(a, b - a), part, bpe.decode(part)]

        return apply

    return by_batch(encoded, ["doc_id", "ids"], out, "doc_id long, ids array<int>, decoded string", make)
