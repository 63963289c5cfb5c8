"""Documents of all types through one scan: a registry gives each type its extractor, and each document one typed result.

An extractor takes rows whose text is null where their type is another's, and adds a struct; all extractors work on the same rows
one after the other, so that nothing is scanned twice, joined or shuffled, however many types there are.  The results meet in one
variant column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import license_fields, passport, visa

#: (rows with doc_id, text and the columns named) -> the same rows with `result` instead of text.
Extractor = Callable[[DataFrame, list[str]], DataFrame]
#: Types that are known but not built: fixed values.
PLACEHOLDERS = ("cdc", "seamanbook", "invoice", "contract", "invitation", "loa")


def passports(rows: DataFrame, keep: list[str]) -> DataFrame:
    found = passport.records(rows, *keep)
    return found.select("doc_id", *keep, F.struct(*passport.FIELDS, "mrz_valid", "path").alias("result"))


def visas(rows: DataFrame, keep: list[str]) -> DataFrame:
    found = visa.records(rows, *keep)
    return found.select("doc_id", *keep, F.struct(*[F.col(f"record.{f}.value").alias(f) for f in visa.FIELDS], "mrzValid", "confidence", "detected").alias("result"))


def licences(rows: DataFrame, keep: list[str]) -> DataFrame:
    found = license_fields.results(rows, *keep)
    value = lambda f: F.get(F.filter("found", lambda x: x["field"] == f), 0)["value"].alias(f)
    return found.select("doc_id", *keep, F.struct(*[value(f) for f in license_fields.LABELS]).alias("result"))


REGISTRY: dict[str, Extractor] = {"passport": passports, "visa": visas, "chinese-business-license": licences}


def route(docs: DataFrame, registry: dict[str, Extractor] = REGISTRY, placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """(doc_id, type, text) -> (doc_id, type, action, result): action is extract, placeholder or error, result a variant.

    Types are compared without case and blanks at their ends.  A placeholder's result is a marker, an unknown or null type's is
    null.  A null text of a known type gives a result without fields.
    """
    rows, keep = docs.select("doc_id", F.lower(F.trim("type")).alias("type"), F.col("text").alias("_body")), ["type", "_body"]
    for i, (name, extract) in enumerate(registry.items()):
        rows = extract(rows.withColumn("text", F.when(F.col("type") == name, F.col("_body"))), keep).withColumnRenamed("result", f"_result{i}")
        keep = [*keep, f"_result{i}"]
    marker = F.to_variant_object(F.struct(F.lit("not implemented").alias("status"), F.col("type")))
    results = [F.when(F.col("type") == name, F.to_variant_object(f"_result{i}")) for i, name in enumerate(registry)]
    action = F.when(F.col("type").isin(*registry), "extract").when(F.col("type").isin(*placeholders), "placeholder").otherwise("error")
    return rows.select("doc_id", "type", action.alias("action"), F.coalesce(*results, F.when(F.col("type").isin(*placeholders), marker)).alias("result"))


def errors(routed: DataFrame) -> DataFrame:
    """(doc_id, type, error) of the documents that no extractor takes."""
    return routed.where(F.col("action") == "error").select("doc_id", "type", F.concat(F.lit("unknown type: "), F.coalesce("type", F.lit("(none)"))).alias("error"))
