"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks `[\x20\x09-\x0D]`: as characters, and as a Java regex class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and every executor can read the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, most: int) -> bool:
    """Has df (already materialised) at most `most` rows?  Guards every broadcast."""
    return df.limit(most + 1).count() <= most


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that no other column can clash with an operator's own; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key() -> Column:
    """Tells apart rows that share a doc_id but not a text; rows equal in both behave as one document."""
    return F.xxhash64(F.col("text"))


def bounded_sample(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """About `bound` rows at most, picked by a hash of the id: the same rows in every run, no sort, no single task."""
    n = df.count()
    if n <= bound:
        return df
    steps = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(steps)) < int(steps * bound / n))


def carry(df: DataFrame) -> DataFrame:
    """(_row, doc_id, text): all columns of df in one struct, so that their names clash with nothing."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col("doc_id"), F.col("text"))


def restore(df: DataFrame, columns: list[str], text: Column | None = None, changed: Column | None = None) -> DataFrame:
    """The carried columns; where changed is true, with a new text and, if there is one, n_chars to match."""

    if text is not None:  # named first: a lambda inside it must not see the columns that are selected beside it
        df = df.withColumn("_text", text).withColumn("_changed", changed)

    def column(c: str) -> Column:
        old = F.col("_row").getField(c)
        if text is None or c not in ("text", "n_chars"):
            return old.alias(c)
        return F.when(F.col("_changed"), F.col("_text") if c == "text" else F.length("_text").cast("long")).otherwise(old).alias(c)

    return df.select(*[column(c) for c in columns])
