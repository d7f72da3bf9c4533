"""Names of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import kernels, pages

QUERIES: dict = kernels.QUERIES | pages.QUERIES
ORACLES: dict = kernels.ORACLES | pages.ORACLES  # pages adds to the queries of files and formats


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts set in pages, read back from the files."""
    return QUERIES["pdf_text"](spark, sf_dir)
