"""Peptide strings as column expressions: normalising, tokens, masses, fragment ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave import constants as K


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


_OXIDISED = [(x, "M[UNIMOD:35]") for x in ("OxM", "M(O)", "M(ox)")]
_DEAMIDATED = [("N[UNIMOD:7]", "D"), ("Q[UNIMOD:7]", "E")]


def fix_cysteine(c: Column) -> Column:
    """Mark bare C as carbamidomethylated; marked ones stay as they are."""
    return F.regexp_replace(c, r"C(?!\[UNIMOD:4\])", "C[UNIMOD:4]")


def normalize(c: Column, style: str = "mgf", cysteine: bool = True) -> Column:
    """The common spelling of a peptide from an MGF file, a CSV file or a CSV file for the search."""
    if style == "csv":
        c = _swap(F.trim(c), ("L", "I"), ("C(Cam)", "C"), *_OXIDISED, ("Z", "M[UNIMOD:35]"), *_DEAMIDATED)
    elif style == "search":
        c = _swap(F.replace(c, F.lit(" "), F.lit("")), ("L", "I"), *_OXIDISED, ("Z", "M[UNIMOD:35]"))
    else:
        c = _swap(c, ("L", "I"), *_OXIDISED, *_DEAMIDATED, ("Z", "M[UNIMOD:35]"))
    return fix_cysteine(c) if cysteine else c


def tokens(peptide: Column) -> Column:
    """The residues of a peptide as strings."""
    return F.regexp_extract_all(F.replace(peptide, F.lit(" "), F.lit("")), F.lit(f"({K.TOKEN})"), F.lit(1))


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def codes(peptide: Column) -> Column:
    """Residue codes 1..21; null where the peptide has something else in it."""
    found = tokens(peptide)
    ints = F.transform(found, lambda t: F.element_at(_map(K.CODES), t))
    whole = F.array_join(found, "") == F.replace(peptide, F.lit(" "), F.lit(""))
    return F.when(whole & ~F.exists(ints, lambda x: x.isNull()), ints)


def spell(ints: Column) -> Column:
    """A peptide from residue codes; 0 and unknown codes give nothing."""
    names = _map({i: r for r, i in K.CODES.items()})
    return F.array_join(F.transform(F.filter(ints, lambda x: x > 0), lambda x: F.element_at(names, x)), "")


def residue_masses(peptide: Column) -> Column:
    return F.transform(tokens(peptide), lambda t: F.element_at(_map(K.RESIDUES), t))


def total(masses: Column) -> Column:
    return F.aggregate(masses, F.lit(0.0), lambda a, x: a + x)


def mass(peptide: Column) -> Column:
    """Neutral mass: residues and water."""
    return total(residue_masses(peptide)) + F.lit(K.WATER)


def precursor_mass(mz: Column, charge: Column) -> Column:
    return (mz - K.PROTON) * charge


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def prefixes(masses: Column) -> Column:
    """The running sums of residue masses, 0 first."""
    return F.aggregate(masses, F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def fragment_sums(prefix: Column, p: Column) -> tuple[Column, Column]:
    """Masses of the y and b fragments of the cleavage that leaves ``p`` residues, from the running sums."""
    return F.element_at(prefix, -1) - F.element_at(prefix, F.size(prefix) - p) + F.lit(K.WATER), F.element_at(prefix, p + 1)


def fragments_at(p: Column, y: Column, b: Column, charge: Column) -> Column:
    """The slots of one cleavage as an array of (slot, mz), one for each ion and fragment charge that exists."""
    made = [
        F.when(charge >= z, F.struct(((p - 1) * 6 + (ion + z - 1)).alias("slot"), ((m + z * K.PROTON) / z).alias("mz")))
        for ion, m in ((0, y), (3, b))
        for z in (1, 2, 3)
    ]
    return F.array_compact(F.array(*made))


def cleavages(prefix: Column) -> Column:
    """The places 1, 2, ... at which a peptide is cut, MAX_LENGTH - 1 at most."""
    n = F.size(prefix) - 1
    return F.when(n > 1, F.sequence(F.lit(1), F.least(n, F.lit(K.MAX_LENGTH)) - 1)).otherwise(F.array().cast("array<int>"))


def ladder(peptide: Column, charge: Column) -> Column:
    """The fragment ladder as an array of (slot, mz), only slots that exist.

    slot = 6 * (position - 1) + (3 for b, 0 for y) + (fragment charge - 1).
    """

    def of(prefix: Column) -> Column:
        return F.flatten(F.transform(cleavages(prefix), lambda p: fragments_at(p, *fragment_sums(prefix, p), charge)))

    return let(prefixes(residue_masses(peptide)), of)


def ladder_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``slot, mz``: a row for each slot of the ladder of each row (``peptide, charge``).

    The running sums are a column below the explosion, so they are made once a peptide, and what
    stands above it is arithmetic in generated code. A peptide with an unknown residue has no slots.
    """
    masses = residue_masses(F.col("peptide"))
    sums = rows.where(F.forall(masses, lambda m: m.isNotNull())).select(*keep, F.col("charge").alias("_z"), prefixes(masses).alias("_prefix"))
    cut = sums.select(*keep, "_z", "_prefix", F.explode(cleavages(F.col("_prefix"))).alias("_p"))
    y, b = fragment_sums(F.col("_prefix"), F.col("_p"))
    cut = cut.select(*keep, "_z", "_p", y.alias("_y"), b.alias("_b"))
    return cut.select(*keep, F.inline(fragments_at(F.col("_p"), F.col("_y"), F.col("_b"), F.col("_z"))))


def float_list(c: Column) -> Column:
    """``"[1.0, 2.0]"`` as an array of doubles; an empty list gives an empty array, what is not a number null."""
    bare = F.regexp_replace(c, r"[\[\] ]", "")
    return F.when(bare == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(bare, ","), lambda x: x.try_cast("double")))


def residue_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in residues: each residue becomes one letter first."""
    letters = _map({r: chr(64 + i) for r, i in K.CODES.items()})
    one = [F.array_join(F.transform(tokens(x), lambda t: F.element_at(letters, t)), "") for x in (a, b)]
    return F.levenshtein(*one)
