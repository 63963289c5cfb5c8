"""Readers and writers.  Paths are anything that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the warehouse, which the cluster shares."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A scan whose rows expand into much work, over as many partitions as the session has cores.

    Small tables come in one file and one row group, so that one core would do all the work.  A scan that has partitions enough, as
    large tables have, isn't moved; the number is given, as a shuffle left to adaptive execution would be put together again.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """A folder of text files, a row each: (path, text)."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


RULE = "struct<label:string, aliases:array<string>, valuePattern:string, flags:string, section:string, required:boolean>"
TEMPLATE = f"struct<id:string, name:string, body:string, windowSize:int, required:array<string>, sections:map<string, struct<start:string, end:string, flags:string>>, fields:map<string, {RULE}>>"


def template_rules(rows: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Templates as JSON, a row each -> (rules, sections) as operators/templates.rules_by_template takes them.

    A field is required if it says so or its template lists it.  A template whose JSON doesn't parse has no rules.
    """
    t = rows.select(F.from_json(json_col, TEMPLATE).alias("t")).where(F.col("t.id").isNotNull()).select("t.*")
    fields = t.select(F.col("id").alias("template_id"), F.coalesce("windowSize", F.lit(120)).alias("window_size"), F.coalesce("required", F.array().cast("array<string>")).alias("listed"), F.explode("fields").alias("field", "rule"))
    labels = F.filter(F.concat(F.array("rule.label"), F.coalesce("rule.aliases", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    needed = F.coalesce("rule.required", F.lit(False)) | F.array_contains("listed", F.col("field"))
    rules = fields.select("template_id", "field", labels.alias("labels"), F.col("rule.valuePattern").alias("value_pattern"), F.col("rule.flags").alias("flags"), F.col("rule.section").alias("section"), needed.alias("required"), "window_size")
    sections = t.select(F.col("id").alias("template_id"), F.explode("sections").alias("section", "s")).select("template_id", "section", "s.start", "s.end", "s.flags")
    return rules, sections


def template_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of template files, a JSON object each, to (path, json)."""
    return text_tree(spark, path).select("path", F.col("text").alias("json"))


def long_truth(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Wide truth to (keys, field, expected)."""
    return df.unpivot(keys, fields, "field", "expected")


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One file set per value of `by`; rows of a value are spread by AQE, not sent to one task."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def template_upsert(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """A catalogue's next version and the changes that it rejects.

    changes: key, columns, op (create or update) and seq, their order.  A create of a key that is there, by the catalogue or an earlier
    change, is rejected (exists), an update of one that isn't too (missing); so is a key that isn't valid (bad_id) and an unknown op
    (bad_op).  Of the others each overrides the columns that it gives; a create may be followed by updates of the same key.
    Result: (key, columns, status: kept, created or updated) and (key, seq, op, violation).
    """
    there = old.select(F.col(key), F.lit(True).alias("_old"))
    rows = changes.join(there, key, "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    fit = F.coalesce(valid_template_id(F.col(key).cast("string")), F.lit(False))
    # of a key that isn't in the catalogue the first create makes it; what comes before it is too early
    made = F.min(F.when(fit & (F.col("op") == "create"), F.col("seq"))).over(Window.partitionBy(key))
    rows = rows.withColumn("_made", F.when(~F.col("_old"), made))
    exists = F.col("_old") | F.coalesce(F.col("seq") > F.col("_made"), F.lit(False))
    violation = F.when(~fit, "bad_id").when((F.col("op") == "create") & exists, "exists").when((F.col("op") == "update") & ~exists, "missing").when(~F.coalesce(F.col("op").isin("create", "update"), F.lit(False)), "bad_op")
    rows = rows.withColumn("violation", violation)
    good = rows.where(F.col("violation").isNull()).groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns], F.lit(True).alias("_changed"))
    merged = old.select(key, *columns, F.lit(True).alias("_old")).join(good, key, "full_outer")
    status = F.when(F.col("_changed").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("updated")
    return merged.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], status.alias("status")), rows.where(F.col("violation").isNotNull()).select(key, "seq", "op", "violation")


def publish(tables_: dict[str, DataFrame], root: str, version: str) -> str:
    """Write tables under root/version, then a manifest that names them: a version without its manifest isn't one.

    Nothing is overwritten; a reader of another version is not disturbed.  Returns the version's folder.
    """
    path = f"{root}/{version}"
    for name, df in tables_.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables_.values())).sparkSession
    listed = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables_]
    spark.createDataFrame([(version, name, n) for name, n in listed], "version string, name string, n_rows long").coalesce(1).write.json(f"{path}/manifest")
    return path


def published(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    """A table of a published version; its manifest must list it."""
    listed = spark.read.schema("version string, name string, n_rows long").json(f"{root}/{version}/manifest")
    if not listed.where(F.col("name") == name).limit(1).count():
        raise ValueError(f"version {version} has no table {name}")
    return spark.read.parquet(f"{root}/{version}/{name}")


def valid_template_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-zA-Z0-9][a-zA-Z0-9_-]*$"), F.lit(False))
