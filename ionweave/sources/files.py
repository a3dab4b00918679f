"""Readers and writers of spectra, predictions, mass tables, features and results."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave import constants as K
from ionweave.functions import peptide as P
from ionweave.functions.spectrum import prediction_floor
from ionweave.operators import features


def parse_mgf(blocks: DataFrame) -> DataFrame:
    """Spectra from text blocks that end before ``END IONS`` (column ``value``).

    A peak that is not two numbers becomes null, and its spectrum is not valid then.
    """
    text = F.regexp_replace("value", r"\r", "")
    field = lambda key: F.nullif(F.regexp_extract(text, rf"(?m)^{key}=(.*?)\s*$", 1), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[0-9.]+([eE][-+]?\d+)?\s+[0-9.]"))
    pairs = F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))
    return blocks.where(F.col("value").contains("BEGIN IONS")).select(
        field("SCANS").alias("scan"),
        F.regexp_extract(field("CHARGE"), r"(\d+)", 1).try_cast("int").alias("charge"),
        F.split(field("PEPMASS"), r"\s+")[0].try_cast("double").alias("precursor_mz"),
        field("SEQ").alias("peptide"),
        field("SCORE").try_cast("double").alias("original_score"),
        F.transform(pairs, lambda p: p[0].try_cast("double")).alias("mzs"),
        F.transform(pairs, lambda p: p[1].try_cast("double")).alias("ints"),
    )


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """MGF files, split at ``END IONS`` by the text source, so that large files are read in parts."""
    return parse_mgf(spark.read.option("lineSep", "END IONS").text(path))


def read_csv(spark: SparkSession, path: str, peptide: str, charge: str, mzs: str, ints: str, precursor_mz: str, scan: str | None = None, score: str | None = None, more: tuple[str, ...] = (), truth: str | None = None, distance: str | None = None, original: bool = False) -> DataFrame:
    """PSMs of a CSV file with column names of its own; spectra are strings like ``[1.0, 2.0]``.

    ``truth`` and ``distance`` name a column with the true peptide and one with its distance,
    which become ``peptide_true, distance``; with ``original`` the file's columns stay, as a
    struct of that name. A file without a column for ``scan`` gets a hash of the row.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    named = F.col(scan).cast("string") if scan else F.xxhash64(*raw.columns).cast("string")
    extra = [P.normalize(F.col(truth), "search").alias("peptide_true")] if truth else []
    extra += [F.col(distance).try_cast("double").alias("distance")] if distance else []
    extra += [F.struct(*raw.columns).alias("original")] if original else []
    return raw.select(
        named.alias("scan"), F.col(charge).try_cast("int").alias("charge"), F.col(precursor_mz).try_cast("double").alias("precursor_mz"),
        F.col(peptide).alias("peptide"), (F.col(score).try_cast("double") if score else F.lit(None).cast("double")).alias("original_score"),
        P.float_list(F.col(mzs)).alias("mzs"), P.float_list(F.col(ints)).alias("ints"), *more, *extra,
    )


def read_arrays(spark: SparkSession, path: str, peptide_int="peptide_int", charge="charge", precursor_mz="precursor_mz", mzs="exp_mzs_full", ints="exp_intensities_full", truth: str | None = None, scan: str | None = None) -> DataFrame:
    """PSMs of Parquet files with array columns and peptides as residue codes; negative values become 0."""
    rows = spark.read.parquet(path)
    clamp = lambda c: F.transform(c, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    out = [
        (F.col(scan).cast("string") if scan else F.xxhash64(F.to_json(F.struct(peptide_int, precursor_mz, mzs))).cast("string")).alias("scan"),
        F.col(charge).cast("int").alias("charge"), F.col(precursor_mz).cast("double").alias("precursor_mz"), P.spell(F.col(peptide_int)).alias("peptide"),
        F.lit(None).cast("double").alias("original_score"), clamp(mzs).alias("mzs"), clamp(ints).alias("ints"),
    ]
    return rows.select(*out, *([P.spell(F.col(truth)).alias("peptide_true")] if truth else []))


def read_lookup(spark: SparkSession, path: str, cysteine: bool = True) -> DataFrame:
    """A mass table without header (candidate, mass): residues in the common spelling and sorted by code, rows by mass."""
    raw = spark.read.schema("candidate string, mass double").csv(path)
    named = P.normalize(F.replace("candidate", F.lit("M(ox)"), F.lit("M[UNIMOD:35]")), "search", cysteine)
    return raw.select(P.spell(F.array_sort(P.codes(named))).alias("candidate"), "mass").where("candidate IS NOT NULL").orderBy("mass", "candidate")


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def uniform_predictions(rows: DataFrame) -> DataFrame:
    """A stand-in for predicted spectra: ``rows`` (``peptide, charge``) with ladder ``mz`` and ``intensities`` of 1; 174 slots, -1 where there is none.

    One Arrow pass; a peptide with an unknown residue, or none, has no slots.
    """
    kept = rows.drop("mz", "intensities")

    def run(batches):
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), features.ROWS):
                part = batch.slice(a, features.ROWS)
                peptides, charges = (part.column(c).to_pylist() for c in ("peptide", "charge"))
                mz = np.full((part.num_rows, K.SLOTS), -1.0)
                for own, p, c in zip(mz, peptides, charges, strict=True):
                    slot, at = features.known_slots(p, c)
                    own[slot] = at
                ends = pa.array(np.arange(len(mz) + 1) * K.SLOTS, pa.int32())
                made = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (mz, np.where(mz > 0, 1.0, -1.0))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "mz", "intensities"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mz", "intensities"))]))


def table_predictions(predictions: DataFrame, energy: float | None = None):
    """What adds the predicted spectra of a table (``peptide, charge, mz, intensities`` and maybe ``ce``) to rows.

    They are found by peptide, charge and, where the table has it, collision energy: the rows'
    own ``ce``, or ``energy``; 1 and below is a share of 100. Rows without a prediction stay, with nulls.
    """
    keys = ["peptide", "charge"] + ["ce"] * ("ce" in predictions.columns)
    percent = lambda c: F.round(F.when(c <= 1, c * 100).otherwise(c)).cast("int")
    keyed = predictions.withColumn("ce", percent(F.col("ce"))) if "ce" in keys else predictions
    keyed = keyed.dropDuplicates(keys).select(*(F.col(k).alias(f"_{k}") for k in keys), "mz", F.transform("intensities", prediction_floor).alias("intensities"))

    def add(rows: DataFrame) -> DataFrame:
        own = {k: F.col(k) for k in keys}
        if "ce" in keys:
            own["ce"] = percent(F.col("ce") if "ce" in rows.columns else F.lit(energy))
        match = [own[k] == F.col(f"_{k}") for k in keys]
        return rows.join(keyed, match, "left").drop(*(f"_{k}" for k in keys))

    return add


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the one that driver and executors share, ``spark.checkpoint.dir``; it goes when the driver ends.

    Only where that is unset, in a local session, one is made under the temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", shared)
    folder = f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by any path that Spark can read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def write_parquet(rows: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Features, bin probabilities or populations; ``by`` is a column to split the folder by."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)
