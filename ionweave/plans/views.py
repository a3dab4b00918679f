"""Spectrum-like views of the driver's tables, in Spark and as DuckDB CTEs of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave import constants as K
from ionweave.functions import peptide as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peak for each event: the user is the scan."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scan"), F.col("event_id").alias("pos"), (F.col("value") * 4).alias("mz"),
        F.get_json_object("props", "$.k").cast("double").alias("intensity"),
    )


def psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peptide for each part: the letters of its name and type that are residues."""
    letters = F.regexp_replace(F.upper(F.concat("p_name", "p_type")), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    # each row becomes some dozens further on, so they are dealt out while they are small
    dealt = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return dealt.select(
        F.col("p_partkey").alias("psm"), (F.col("p_partkey") % 150).alias("scan"), (F.col("p_size") % 3 + 1).cast("int").alias("charge"),
        P.normalize(letters).alias("peptide"), F.regexp_replace(F.upper(F.concat("p_name", "p_type")), "[^A-Z]", "").alias("raw"),
    )


def word_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different runs of 2 to 30 residue letters in all documents: longer runs are cut up, as no peptide is longer."""
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    runs = F.regexp_extract_all(upper, F.lit("([ADEFGHIKMNPQRSTVWY]{2,30})"), F.lit(1))
    return table(spark, sf_dir, "documents").select(F.explode(runs).alias("peptide")).distinct()


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a prediction with the next vector as what was observed; small values are 0."""
    values = F.transform("embedding", lambda x: F.greatest(F.abs(x.cast("double")) - 0.05, F.lit(0.0)))
    v = table(spark, sf_dir, "embeddings").select("vec_id", values.alias("x"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("observed"))
    return v.withColumnRenamed("x", "predicted").join(after, "vec_id")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every peptide with the peaks of its scan, in order, and predicted intensities: 1 for slots of even number."""
    p = peaks(spark, sf_dir).groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("pos", "mz", "intensity"))).alias("p"))
    arrays = p.select("scan", F.col("p.mz").alias("mzs"), F.col("p.intensity").alias("ints"))
    tints = F.transform(F.sequence(F.lit(0), F.lit(K.SLOTS - 1)), lambda i: F.when(i % 2 == 0, 1.0).otherwise(0.0))
    return psms(spark, sf_dir).join(arrays, "scan", "left").withColumn("tints", tints)


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladder slots of every peptide; slots of even number are predicted with intensity 1."""
    ladder = P.ladder_rows(psms(spark, sf_dir), ["scan", "psm"])
    return ladder.select("scan", "psm", "slot", F.col("mz").alias("tmz"), F.when(F.col("slot") % 2 == 0, 1.0).otherwise(0.0).alias("tint"))


_MASSES = ", ".join(f"('{r}', {i}, CAST({m!r} AS DOUBLE))" for (r, m), i in zip(K.RESIDUES.items(), K.CODES.values(), strict=True))
TOKEN_SQL = "M\\[UNIMOD:35\\]|C\\[UNIMOD:4\\]|[A-Z]"

CTE = rf"""
residues(residue, code, mass) AS (VALUES {_MASSES}),
peaks AS (SELECT user_id AS scan, event_id AS pos, value * 4 AS mz, CAST(json_extract(props, '$.k') AS DOUBLE) AS intensity FROM events),
psms AS (
    SELECT p_partkey AS psm, p_partkey % 150 AS scan, CAST(p_size % 3 + 1 AS INTEGER) AS charge,
        regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g') AS raw,
        replace(replace(regexp_replace(upper(p_name || p_type), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'), 'L', 'I'), 'C', 'C[UNIMOD:4]') AS peptide
    FROM part),
toks AS (
    SELECT psm, scan, charge, len(t) AS n, unnest(t) AS residue, unnest(range(1, len(t) + 1)) AS i
    FROM (SELECT *, regexp_extract_all(peptide, '{TOKEN_SQL}') AS t FROM psms)),
sums AS (
    SELECT psm, scan, charge, n, i, sum(mass) OVER (PARTITION BY psm ORDER BY i) AS prefix, sum(mass) OVER (PARTITION BY psm) AS whole
    FROM toks JOIN residues USING (residue)),
cuts AS (
    SELECT a.psm, a.scan, a.charge, a.i AS p, a.prefix AS b, a.whole - z.prefix + {K.WATER!r} AS y
    FROM sums a JOIN sums z ON a.psm = z.psm AND z.i = a.n - a.i WHERE a.i < a.n AND a.i < 30),
slots AS (
    SELECT scan, psm, CAST((p - 1) * 6 + ion + z - 1 AS INTEGER) AS slot, ((CASE ion WHEN 3 THEN b ELSE y END) + z * {K.PROTON!r}) / z AS tmz,
        CASE WHEN ((p - 1) * 6 + ion + z - 1) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tint
    FROM cuts, (VALUES (0), (3)) i(ion), (VALUES (1), (2), (3)) c(z) WHERE charge >= z),
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(abs(x::DOUBLE) - 0.05::DOUBLE, 0.0::DOUBLE)) AS x FROM embeddings),
vals AS (
    SELECT p.vec_id, unnest(range(0, len(p.x))) AS slot, unnest(o.x) AS raw_obs, unnest(p.x) AS raw_pred FROM vecs p JOIN vecs o ON o.vec_id = p.vec_id + 1),
units AS (
    SELECT *, raw_obs / coalesce(nullif(sqrt(sum(raw_obs ** 2) OVER (PARTITION BY vec_id)), 0), 1) AS obs,
        raw_pred / coalesce(nullif(sqrt(sum(raw_pred ** 2) OVER (PARTITION BY vec_id)), 0), 1) AS pred FROM vals),
cases AS (
    SELECT u.*, c.c AS "case" FROM units u JOIN (VALUES ('all'), ('b'), ('y')) c(c)
    ON raw_pred > 0 AND (c.c = 'all' OR (c.c = 'b') = (slot % 6 > 2)))
"""


def sql(body: str, more: str = "") -> str:
    """A query over the views."""
    return f"WITH RECURSIVE {CTE}{',' + more if more else ''}\n{body}"
