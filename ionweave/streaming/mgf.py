"""MGF files as a stream: each new file of a folder is parsed and flagged as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionweave.plans.rescoring import flag
from ionweave.sources.files import parse_mgf


def stream_mgf(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """Flagged spectra; every step is a narrow one, so no state is kept."""
    text = spark.readStream.option("lineSep", "END IONS").option("maxFilesPerTrigger", files_each).text(folder)
    return flag(parse_mgf(text))
