"""Documents that arrive as files: the same column expressions over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import detect

SCHEMA = "doc_id long, text string, arrived timestamp"


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def classified(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(doc_id, arrived, type, confidence, method), each document once while the watermark remembers it."""
    once = stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doc_id"])
    return once.select("doc_id", "arrived", detect.classify(F.col("text")).alias("c")).select("doc_id", "arrived", "c.*")


def counts(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Documents by type in tumbling windows; late ones beyond the watermark are left out."""
    rows = stream.withWatermark("arrived", late).select("arrived", detect.classify(F.col("text"))["type"].alias("type"))
    return rows.groupBy(F.window("arrived", width), "type").agg(F.count(F.lit(1)).alias("n"))
