"""Validity rules; the engine's facade is in ``api``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave import constants as K
from ionweave.functions import peptide as P


def valid(n_residues: Column, charge: Column, style: str = "mgf") -> Column:
    """Whether a PSM can be scored: known residues, at most 30 of them and charge 6; from CSV two at least."""
    least = 2 if style != "mgf" else 0
    return F.coalesce((charge <= K.MAX_CHARGE) & (n_residues <= K.MAX_LENGTH) & (n_residues >= least), F.lit(False))


def flag(psms: DataFrame, style: str = "mgf") -> DataFrame:
    """Add ``peptide_norm, seq_len, is_valid`` in one pass; nothing is filtered. A spectrum with a peak that could not be read is not valid."""
    norm = P.normalize(F.col("peptide"), style)
    ints = P.codes(F.col("peptide_norm"))
    made = psms.withColumn("peptide_norm", norm).withColumn("seq_len", F.when(ints.isNotNull(), F.size(ints)))
    whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    known = F.col("precursor_mz").isNotNull() & whole("mzs") & whole("ints")
    return made.withColumn("is_valid", valid(F.col("seq_len"), F.col("charge"), style) & known)
