"""Readings of a field that differ by characters OCR confuses, validated and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text

#: What OCR reads -> what it may stand for; suffixes and types of companies: fixed values.
CONFUSIONS = [("资", "责"), ("贡", "责"), ("贡", "任"), ("很", "有"), ("述", "金"), ("全", "金"), ("当", "雪"), ("医", "区"), ("匠", "区"), ("填", "镇"), ("信", "佰"), ("很", "限")]
SUFFIXES = ("股份有限公司", "集团有限公司", "有限责任公司", "有限公司")
TYPES = ("有限责任公司", "股份有限公司", "个人独资企业", "合伙企业", "外商投资企业", "全民所有制", "集体所有制")
DEPTH, MOST = 4, 48


def variants(rows: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """(doc_id, raw) -> (doc_id, raw, variant, edits): `depth` rounds of single replacements by a broadcast join; of a
    document's variants the `most` with the fewest edits stay (ties by text)."""
    pairs = F.broadcast(rows.sparkSession.createDataFrame(CONFUSIONS, "seen string, meant string"))
    level = rows.select("doc_id", "raw", F.col("raw").alias("variant"), F.lit(0).alias("edits"))
    out = level
    for _ in range(depth):
        places = level.select("doc_id", "raw", "variant", "edits", F.posexplode(F.split("variant", "")).alias("at", "seen")).join(pairs, "seen")
        changed = F.concat(F.substring(F.col("variant"), F.lit(1), F.col("at")), F.col("meant"), F.substring(F.col("variant"), F.col("at") + 2, F.length("variant")))
        level = places.select("doc_id", "raw", changed.alias("variant"), (F.col("edits") + 1).alias("edits")).dropDuplicates(["doc_id", "raw", "variant"])
        out = out.unionByName(level)
    least = out.groupBy("doc_id", "raw", "variant").agg(F.min("edits").alias("edits"))
    return least.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "raw").orderBy("edits", "variant"))).where(F.col("_n") <= most).drop("_n")


def best(found: DataFrame, score: Column) -> DataFrame:
    """The highest score of each document; of equals the fewest edits, then the text."""
    order = Window.partitionBy("doc_id", "raw").orderBy(F.desc("score"), "edits", "variant")
    return found.withColumn("score", score).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


EDITS = "array<struct<index:int,from:string,to:string>>"
#: What one replacement costs a reading.
PENALTY = 0.08


def readings(value: Column, depth: int = DEPTH, most: int = MOST) -> Column:
    """Array of (text, edits) of a value: itself, and what it may stand for after one to `depth` replacements.

    A search inside the row: each round replaces one character right of the last one replaced in the readings of the round before,
    so that a set of places is met once, and at most `most` readings of a round go on, in order of place.  No reading holds a
    character that could be replaced again, as nothing in the table is read as what it is read for.
    """
    meant: dict[str, list[str]] = {}
    for seen, to in CONFUSIONS:
        meant.setdefault(seen, []).append(to)
    table = F.expr("map(" + ", ".join(f"'{seen}', array({', '.join(map(repr, to))})" for seen, to in meant.items()) + ")")
    kind = f"array<struct<text:string,edits:{EDITS}>>"
    first = F.array(F.struct(value, F.array().cast(EDITS))).cast(kind)

    def further(r: Column) -> Column:
        last = F.coalesce(F.try_element_at(r["edits"], F.lit(-1))["index"], F.lit(-1))
        at = lambda i: F.substring(r["text"], i + 1, F.lit(1))
        places = F.filter(F.sequence(F.lit(0), F.length(r["text"])), lambda i: (i > last) & F.map_contains_key(table, at(i)))
        replaced = lambda i, to: F.concat(F.substring(r["text"], F.lit(1), i), to, F.substring(r["text"], i + 2, F.length(r["text"])))
        one = lambda i: F.transform(F.element_at(table, at(i)), lambda to: F.struct(replaced(i, to), F.array_append(r["edits"], F.struct(i.alias("index"), at(i).alias("from"), to.alias("to")))))
        return F.flatten(F.transform(places, one))

    def step(state: Column, _: Column) -> Column:
        new = F.slice(F.flatten(F.transform(state["last"], further)), 1, most).cast(kind)
        return F.struct(F.concat(state["found"], new).alias("found"), new.alias("last"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct(first.alias("found"), first.alias("last")), step, lambda s: F.slice(s["found"], 1, most))
    return F.when(value.rlike(f"[{''.join(meant)}]"), found).otherwise(first)


def best_reading(value: Column, score, depth: int = DEPTH, most: int = MOST) -> Column:
    """(loss, n, text, edits) of the best reading: the highest score of its text less PENALTY an edit; then fewest edits, then the text."""
    ranked = lambda r: F.struct(F.round(PENALTY * F.size(r["edits"]) - score(r["text"]), 6).alias("loss"), F.size(r["edits"]).alias("n"), r["text"].alias("text"), r["edits"].alias("edits"))
    return text.bound(value, lambda v: F.array_min(F.transform(readings(v, depth, most), ranked)))


def company_score(c: Column) -> Column:
    """0 for an empty name; else a sum for suffix, length and no Latin letters: fixed weights."""
    suffix = F.lit(False)
    for s in SUFFIXES:
        suffix = suffix | c.endswith(s)
    flag = lambda x, w: F.when(x, w).otherwise(0.0)
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).otherwise(F.round(0.3 + flag(suffix, 0.45) + flag(F.length(c).between(4, 80), 0.15) + flag(~c.rlike("[A-Za-z]"), 0.1), 6))
