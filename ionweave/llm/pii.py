"""Surrogates for personal data and secrets.

Entities are found by patterns; each is replaced by a surrogate of the same type and format.
A surrogate comes from a keyed permutation of all values that share the entity's format, so
that the same entity has the same surrogate in every document (coreference), different
entities have different ones (distinctness), and none stays as it is, without any table that
grows with the corpus. Characters keep their class: digits stay digits, letters stay letters of
their script and case, marks stay in place.

Persons are found by a title, or by a listed given name, before a name; where one has been found,
its names are replaced in the rest of the text too. Listed given names become others of their gender. In
other names vowels become vowels and consonants become consonants, and a given name keeps its last
letter, which in many languages tells the gender.

The permutation is a Feistel network over 0..N-1, N the number of values of the format, with
cycle walking; a rotation between the network and its inverse leaves no value fixed. Values
with a rule (card checksums, octets of an address, names of a list) are numbered by it. Whoever
has the key can undo it, so the key comes from the caller, or is drawn anew for each run.

Before a corpus is rewritten, distinctness is checked over all its entities (``checked_key``).
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import blocks, by_batch, small_batches, texts_of

#: Given names by gender, and titles.
MALE = (
    "Adam", "Ahmed", "Alexander", "Andreas", "Antoine", "Antonio", "Carlos", "Daniel", "David", "Diego", "Erik", "Hans", "Ivan", "James", "Jean", "John", "José", "Juan",
    "Jürgen", "Luis", "Marc", "Michael", "Miguel", "Mohammed", "Nicolas", "Omar", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Robert", "Sergei", "Stefan", "Thomas", "William",
)
FEMALE = (
    "Aisha", "Ana", "Anna", "Camille", "Carmen", "Catherine", "Claire", "Elena", "Elizabeth", "Emma", "Fatima", "Hannah", "Ingrid", "Isabel", "Jennifer", "Julia", "Katharina", "Laura",
    "Lucia", "Maria", "Marie", "Mary", "Mei", "Natalia", "Nina", "Olga", "Petra", "Rosa", "Sabine", "Sara", "Sarah", "Sofia", "Susan", "Teresa", "Ursula", "Yuki",
)
TITLES = ("Dr", "Prof", "Mr", "Mrs", "Ms", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
#: Domains that are reserved for examples stay as they are.
RESERVED = ("example.com", "example.net", "example.org")

#: A capital letter and more of a word.
_NAME = r"[^\W\d_a-zß-öø-ÿ][\w'-]+"
#: Type and pattern of each entity; the first that matches at a place wins. Group 1, where there is one, is what is replaced.
PATTERNS = (
    ("email", r"[^\W_][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("secret", r"""(?i:password|passwd|token|secret|api_?key)["']?\s*[=:]\s*["']?([A-Za-z0-9_+/-]{8,})"""),
    ("aws_key", r"\bAKIA([A-Z0-9]{16})\b"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{4}(?![\w-])"),
    ("person", rf"\b(?=[A-ZÀ-ÖØ-Þ])(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ({_NAME}(?: {_NAME})?)"),
    ("person_2", rf"\b(?=[A-ZÀ-ÖØ-Þ])((?:{'|'.join(sorted((*MALE, *FEMALE), key=len, reverse=True))}) {_NAME})"),
)
_FIND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS))
#: No entity but a person's name begins without one of these, and no name without a word that is listed.
_HINT = re.compile(r"[\d@]|AKIA|(?i:passw|token|secret|api_?key)").search
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]\w+").findall
_LISTED = frozenset((*TITLES, *MALE, *FEMALE))
_INNER = {name: re.compile(pattern) for name, pattern in PATTERNS}

#: Alphabets whose letters are taken by preference: letters of one of them become letters of it.
_COMMON = ("abcdefghijklmnopqrstuvwxyz", "àâäáåãæçéèêëíìîïñóòôöõøúùûüýÿ", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя")


@lru_cache(4096)
def alphabet(c: str) -> str:
    """All characters that may stand for ``c``: its digits, or letters of its script and case.

    A letter outside the common alphabets stands for those of its Unicode block of 256 that have its
    script, by the first word of their names, and its case. Their lower and upper forms are one letter each.
    """
    if c.isascii() and c.isdigit():
        return "0123456789"
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return c
    low = c.lower()
    for letters in _COMMON:
        if low in letters:
            own = letters if c == low else letters.upper()
            return own if c in own else c
    return _block(c)


def _block(c: str) -> str:
    """The letters, or digits, of the same script, category and block as ``c``; ``c`` alone if there are no others."""
    script = lambda x: unicodedata.name(x, "").partition(" ")[0]
    first = ord(c) & ~0xFF
    same = (x for x in map(chr, range(first, min(first + 0x100, 0x110000))) if unicodedata.category(x) == unicodedata.category(c))
    return "".join(x for x in same if script(x) == script(c) and not any(x.lower() in letters for letters in _COMMON))


class Permutation:
    """Keyed permutations of 0..n-1 without fixed points."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, i: int, tweak: bytes, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            data = b"%d|%d|%d|" % (i, block, half) + tweak
            out += hmac.digest(self.key, data, "sha256")
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _mix(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        bits = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
        low = (1 << bits) - 1
        while True:
            a, b = x >> bits, x & low
            for i in range(8)[:: -1 if back else 1]:
                a, b = (b ^ self._round(i, tweak, a, bits), a) if back else (b, a ^ self._round(i, tweak, b, bits))
            x = a << bits | b
            if x < n:
                return x

    def apply(self, x: int, n: int, tweak: bytes) -> int:
        """The image of x; different from x if n > 1."""
        if n < 2:
            return x
        turn = 1 + int.from_bytes(hmac.digest(self.key, b"turn|" + tweak, "sha256"), "big") % (n - 1)
        return self._mix((self._mix(x, n, tweak, False) + turn) % n, n, tweak, True)


@lru_cache(4096)
def sound(c: str) -> str:
    """The letters of ``alphabet`` that are vowels if ``c`` is one, and consonants if not."""
    letters = alphabet(c)
    own = _vowel(c)
    return "".join(x for x in letters if _vowel(x) == own)


def _vowel(c: str) -> bool:
    return unicodedata.normalize("NFD", c.lower())[0] in "aeiouyαεηιουωаеиоуыэюяæø"


def _number(text: str, alphabet=alphabet) -> tuple[int, int]:
    """The number of a text among those of its format, and how many there are."""
    x, n = 0, 1
    for c in text:
        letters = alphabet(c)
        x, n = x * len(letters) + letters.index(c), n * len(letters)
    return x, n


def _spell(x: int, like: str, alphabet=alphabet) -> str:
    out = []
    for c in reversed(like):
        letters = alphabet(c)
        x, k = divmod(x, len(letters))
        out.append(letters[k])
    return "".join(reversed(out))


def _shape(text: str) -> str:
    return "".join(alphabet(c)[0] for c in text)


def luhn(digits: str) -> bool:
    """Whether a card number's checksum holds."""
    twice = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


class Surrogates:
    """Surrogates of one key."""

    def __init__(self, key: bytes):
        self.permutation = Permutation(hashlib.sha256(key).digest())
        self.of = lru_cache(100_000)(self._of)

    def like(self, kind: str, text: str) -> str:
        """A text of the same format."""
        x, n = _number(text)
        return _spell(self.permutation.apply(x, n, f"{kind}|{_shape(text)}".encode()), text)

    def name_like(self, kind: str, name: str, last: bool) -> str:
        """A name with vowels and consonants where the other has them; with ``last`` its last letter stays."""
        inner, end = (name[:-1], name[-1]) if last and len(name) > 2 else (name, "")
        x, n = _number(inner, sound)
        if n < 2:  # no letter has another that may stand for it
            return self.word(kind, name)
        shape = "".join(sound(c)[0] for c in inner)
        return _spell(self.permutation.apply(x, n, f"{kind}|{shape}|{end}".encode()), inner, sound) + end

    def word(self, kind: str, text: str) -> str:
        """A keyed word of ten letters, for what has no other value of its format."""
        found = int.from_bytes(hmac.digest(self.permutation.key, f"word|{kind}|{text}".encode("utf-8", "surrogatepass"), "sha256"), "big")
        out = ""
        for letters in ("bcdfghjklmnprstvz", "aeiou") * 5:
            found, k = divmod(found, len(letters))
            out += letters[k]
        return out.capitalize()

    def _of(self, kind: str, text: str) -> str:
        """The surrogate of an entity."""
        return getattr(self, f"_{kind}", lambda t: self.like(kind, t))(text)

    def _email(self, text: str) -> str:
        name, _, domain = text.rpartition("@")
        kept = next((r for r in RESERVED if domain == r or domain.endswith(f".{r}")), domain.rpartition(".")[2])
        rest = domain[: len(domain) - len(kept)]
        new = self.like(f"email|{kept}", f"{name}@{rest}")
        return new + kept

    def _ip(self, text: str) -> str:
        x = 0
        for part in text.split("."):
            x = x << 8 | int(part)
        x = self.permutation.apply(x, 1 << 32, b"ip")
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def _card(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        # numbers with a right checksum are mapped among themselves, the others among themselves
        while True:
            new = self.like(f"card|{luhn(digits)}", digits if not luhn(digits) else digits[:-1])
            if luhn(digits):
                new += next(d for d in "0123456789" if luhn(new + d))
                break
            if not luhn(new):
                break
            # a wrong number that turned right: walk on
            while luhn(new):
                new = self.like("card|False", new)
            break
        found = iter(new)
        return "".join(next(found) if c.isdigit() else c for c in text)

    def _person(self, text: str) -> str:
        first, _, last = text.partition(" ")
        return f"{self._given(first)} {self._family(last)}" if last else self._family(first)

    def _given(self, name: str) -> str:
        for own in (MALE, FEMALE):
            if name in own:
                return own[self.permutation.apply(own.index(name), len(own), b"|".join(n.encode() for n in own))]
        new = self.name_like("given", name, True)
        while new in MALE or new in FEMALE:  # walks on past names of the lists, which have images of their own
            new = self.name_like("given", new, True)
        return new

    def _family(self, name: str) -> str:
        return self.name_like("family", name, False)  # all in one domain, so one-to-one


def entities(text: str) -> list[tuple[str, int, int]]:
    """Type, begin and end of each entity of a text, in order.

    Single names of persons that are found elsewhere in the text are ``given`` or ``family``.
    """
    if not _HINT(text) and _LISTED.isdisjoint(_CAPITAL(text)):
        return []
    found, names = [], {}
    for m in _FIND.finditer(text):
        kind = m.lastgroup if m.lastgroup in _INNER else next(k for k in _INNER if m[k] is not None)
        inner = _INNER[kind].match(text, m.start())
        a, b = (inner.span(1) if inner.re.groups else inner.span()) if inner else m.span()
        if kind.startswith("person"):
            first, _, last = text[a:b].partition(" ")
            names.setdefault(last or first, "family")
            if last:
                names.setdefault(first, "given")
            found.append(("person", a, b))
        else:
            found.append((kind, a, b))
    if not names:
        return found
    again = re.compile(rf"(?<![\w'-])(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?![\w'-])")
    more, begins = [], [a for _, a, _ in found]
    for m in again.finditer(text):
        k = bisect_right(begins, m.start()) - 1
        if k < 0 or found[k][2] <= m.start():
            more.append((names[m[0]], m.start(), m.end()))
    return sorted(found + more, key=lambda e: e[1])


def rewrite(text: str, surrogates: Surrogates) -> tuple[str, list[dict]]:
    """The text with surrogates, and the entities: type, begin and end in the old text, surrogate."""
    out, at, found = [], 0, []
    for kind, a, b in entities(text):
        new = surrogates.of(kind, text[a:b])
        out += [text[at:a], new]
        at = b
        found.append({"type": kind, "begin": a, "end": b, "surrogate": new})
    return "".join(out) + text[at:], found


SPAN = pa.struct([("type", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])


def checked_key(docs: DataFrame, key: bytes | None = None, most: int = 8, of=Surrogates) -> bytes:
    """A key under which no two entities of ``docs`` share a surrogate.

    It is ``key``, or a new one for this run, and a number that is raised until ``collisions`` finds
    none; they are as good as impossible, and the check proves it for the corpus at hand.
    """
    key = secrets.token_bytes(32) if key is None else key
    for n in range(most):
        tried = hmac.digest(key, b"round %d" % n, "sha256")
        if collisions(docs, tried, of).isEmpty():
            return tried
    raise ValueError(f"{most} keys have left entities with the same surrogate")


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, entities`` for every row of ``docs`` (``doc_id, text``), with surrogates in the text.

    A null text stays null and has no entities; texts without entities stay as they are; a null
    doc_id stays null; repeated rows give repeated rows; other columns are ignored; an empty
    table gives no rows.
    """
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("entities", pa.list_(SPAN))])

    def make():
        surrogates = Surrogates(key)

        def apply(batch):
            nulls = batch.column("text").is_null().to_pylist()
            texts = texts_of(batch)
            for a, b in blocks([len(t) + 50 for t in texts]):
                rows = [rewrite(t, surrogates) for t in texts[a:b]]
                new = [None if gone else r[0] for gone, r in zip(nulls[a:b], rows, strict=True)]
                yield [batch.column("doc_id").slice(a, b - a), new, [r[1] for r in rows]]

        return apply

    ddl = "doc_id long, text string, entities array<struct<type:string,begin:int,end:int,surrogate:string>>"
    return by_batch(docs, ["doc_id", "text"], out, ddl, make)


def collisions(docs: DataFrame, key: bytes, of=Surrogates) -> DataFrame:
    """Surrogates that stand for more than one entity, or for themselves, with two entities: no rows if all is well.

    Least and greatest are compared in place of sets, combined before the shuffle, so frequent
    entities cost no more.
    """
    out = pa.schema([("type", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())])

    def make():
        surrogates = of(key)

        def apply(batch):
            rows = {(k, t[a:b], surrogates.of(k, t[a:b])) for t in texts_of(batch) for k, a, b in entities(t)}
            yield [list(c) for c in zip(*sorted(rows), strict=True)] if rows else [[], [], []]

        return apply

    found = by_batch(docs, ["text"], out, "type string, entity string, surrogate string", make)
    grouped = found.groupBy("type", "surrogate").agg(F.min("entity").alias("least"), F.max("entity").alias("greatest"))
    # an entity that stays as it is counts too, by itself
    return grouped.where("least <> greatest OR least = surrogate")


def replace_in(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of ``docs`` with all their columns; texts, and ``n_chars`` where it is there, are new.

    Null texts stay null; null ids, repeated rows and empty tables pass through.
    """
    small_batches(docs.sparkSession)
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts = [None if t is None else rewrite(t, surrogates)[0] for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if counted:  # null stays null; a count that is there is the new text's
                at = batch.schema.get_field_index("n_chars")
                field, old = batch.schema.field(at), batch.column("n_chars").to_pylist()
                new = [o if o is None or t is None else len(t) for o, t in zip(old, texts, strict=True)]
                batch = batch.set_column(at, field, pa.array(new, field.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
