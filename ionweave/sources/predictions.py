"""Predicted spectra from a provider that is asked once for each peptide, charge and collision energy.

What it says is kept in a table of Spark's catalog, bucketed by that key, so that rows meet what is
known already without a shuffle of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions.spectrum import prediction_floor

KEY = ("peptide", "charge", "ce")
#: Peptides, charges and energies of a request; a spectrum (m/z, intensities) or None for each comes back.
Provider = Callable[[list, list, list], list]


class PredictionStore:
    """Adds ``mz, intensities`` to rows with ``peptide, charge`` and maybe ``ce``; rows without a prediction get nulls.

    Different keys that the table does not have yet are handed to ``provider`` in tasks, ``batch`` at
    a time, and what it gives is appended, None too, so that no key is asked for again. Energies are
    the rows' own or ``energy``, in hundredths; 1 and below is a share. A task that is lost asks again.
    """

    def __init__(self, spark: SparkSession, table: str, provider: Provider, energy: float | None = None, batch: int = 1000, buckets: int = 64):
        self.spark, self.table, self.provider, self.energy, self.batch, self.buckets = spark, table, provider, energy, batch, buckets

    def _energy(self, rows: DataFrame) -> Column:
        c = F.col("ce") if "ce" in rows.columns else F.lit(self.energy).cast("double")
        return F.coalesce(F.round(F.when(c <= 1, c * 100).otherwise(c)).cast("int"), F.lit(-1))

    def missing(self, rows: DataFrame) -> DataFrame:
        """The different keys of rows that the table does not have."""
        keys = rows.select("peptide", F.col("charge").cast("int").alias("charge"), self._energy(rows).alias("ce"))
        keys = keys.where("peptide IS NOT NULL AND charge IS NOT NULL").distinct()
        return keys.join(self.spark.table(self.table).select(*KEY), list(KEY), "left_anti") if self.spark.catalog.tableExists(self.table) else keys

    def fill(self, rows: DataFrame) -> None:
        """Ask for what is missing."""
        provider, most = self.provider, self.batch
        schema = pa.schema([("peptide", pa.string()), ("charge", pa.int32()), ("ce", pa.int32()), ("mz", pa.list_(pa.float64())), ("intensities", pa.list_(pa.float64()))])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def answers(some: list[tuple]) -> pa.RecordBatch:
                got = provider(*map(list, zip(*some)))
                if len(got) != len(some):
                    raise ValueError("a provider has to give a spectrum or None for each key")
                spectra = [g if g is not None else (None, None) for g in got]
                return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*k, *s))) for k, s in zip(some, spectra)], schema)

            for batch in batches:
                held += zip(*(batch.column(c).to_pylist() for c in KEY))
                while len(held) >= most:
                    yield answers(held[:most])
                    held = held[most:]
            if held:
                yield answers(held)

        found = self.missing(rows).mapInArrow(ask, "peptide string, charge int, ce int, mz array<double>, intensities array<double>")
        kept = found.withColumn("intensities", F.transform("intensities", prediction_floor))
        kept.write.bucketBy(self.buckets, *KEY).mode("append").saveAsTable(self.table)

    def __call__(self, rows: DataFrame) -> DataFrame:
        self.fill(rows)
        self.spark.catalog.refreshTable(self.table)
        held = self.spark.table(self.table).select(*(F.col(k).alias(f"_{k}") for k in KEY), "mz", "intensities")
        own = {"_p": F.col("peptide"), "_c": F.col("charge").cast("int"), "_e": self._energy(rows)}
        match = [F.col(a) == F.col(f"_{k}") for a, k in zip(own, KEY)]
        return rows.withColumns(own).join(held, match, "left").drop(*own, *(f"_{k}" for k in KEY))
