"""A folder of files as a stream of table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import pdf

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """New files of a folder, at most that many a batch."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", most).load(path)
    return found.select(F.col("path").alias("doc_id"), "modificationTime", "length", "content")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, tables: list[str] | None = None) -> StreamingQuery:
    """Parses new files into Parquet rows (doc_id, table, payload), partitioned by table; each file once, however often it is restarted."""
    records = pdf.parse_files(incoming(spark, path), tables)
    return records.writeStream.format("parquet").partitionBy("table").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def arrivals(files: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes that arrived in each window; what comes later than the watermark is left out."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", every)).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
