"""Document fingerprints from closed syncmers (DataFrame operations only).

A text is read as tokens: runs of non-blanks of up to 16 code points; of a longer run, single code points up to its last 16.  What
a token is depends on nothing before it, also in text without blanks.  A k-mer of tokens is an anchor if the least hash among
its inner s-mers is the first or the last one; the choice looks at nothing outside the k-mer, so a passage has the same
anchors wherever it stands.  A fingerprint is all distinct anchor hashes, each with its first token position; likeness is the
Jaccard index of two such sets, exact at every length.  Only texts are shuffled; anchors are found where they are used.

Cases: a null text is empty; a text without any anchor (under K tokens, or by chance) has one anchor, the hash of all its tokens; equal texts have
equal fingerprints; the successor of a document is the next by (doc_id, text hash), the last one's is the first, a single
document's is itself; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common

K, S = 6, 2
BUCKET_DOCS, QUANTILES, BROADCAST_HEADS = 2_000, 1_000, 1_000_000
TOKEN = r"[^\x20\x09-\x0D]{1,16}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"


def anchors(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Adds out_col: array<struct<hash bigint, pos int>>, the closed syncmers of text_col in text order."""
    inner, step = K - S + 1, f"_{out_col}"
    df = df.withColumn(f"{step}_t", F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0)))
    t, h = F.col(f"{step}_t"), F.col(f"{step}_h")
    df = df.withColumn(f"{step}_h", F.slice(F.transform(t, lambda x, i: F.xxhash64(x, F.get(t, i + 1))), 1, F.greatest(F.size(t) - S + 1, F.lit(0))))

    def closed(x: Column, i: Column) -> Column:
        last = F.get(h, i + (inner - 1))
        rest = [F.get(h, i + j) for j in range(1, inner - 1)]
        least = F.least(*rest)
        # null beyond the end: not a full k-mer
        return F.when(last.isNotNull() & ((x <= F.least(least, last)) | (last <= F.least(least, x))), F.struct(F.xxhash64(x, *[F.get(h, i + j) for j in range(S, inner, S)]).alias("hash"), i.alias("pos")))

    found = F.array_compact(F.transform(h, closed))
    whole = F.array(F.struct(F.xxhash64(F.array_join(t, " ")).alias("hash"), F.lit(0).alias("pos")))
    df = df.withColumn(f"{step}_f", found)
    return df.withColumn(out_col, F.when(F.size(f"{step}_f") > 0, F.col(f"{step}_f")).otherwise(whole)).drop(f"{step}_t", f"{step}_h", f"{step}_f")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.round(both / (F.size(a) + F.size(b) - both), 6)


def with_fingerprint(df: DataFrame, text_col: str, hashes_col: str, print_col: str, sketch: int | None = None) -> DataFrame:
    """Adds hashes_col (sorted anchor hashes, the `sketch` least or all) and print_col (hash@position in hex, by hash)."""
    df = anchors(df, text_col, "_anchors").withColumn("_anchors", F.array_sort("_anchors"))
    # sorted by (hash, pos): the first of each run of equal hashes has the least position
    a = F.col("_anchors")
    first = F.filter(a, lambda x, i: (i == 0) | (x["hash"] != F.get(a, i - 1)["hash"]))
    df = df.withColumn("_least", F.slice(first, 1, sketch) if sketch else first)
    return (
        df.withColumn(hashes_col, F.transform("_least", lambda x: x["hash"]))
        .withColumn(print_col, F.array_join(F.transform("_least", lambda x: F.concat_ws("@", F.lower(F.hex(x["hash"])), F.lower(F.hex(x["pos"])))), " "))
        .drop("_anchors", "_least")
    )


def successors(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """docs (doc_id, text and others) with next_<c> for each of columns, from the next document by (doc_id, text hash).

    `derive` adds columns once the rows are dealt, so that these are not shuffled; `columns` may name them.

    Documents are dealt into id ranges of about BUCKET_DOCS: between quantiles of doc_id, of which there are QUANTILES at most, ids
    are cut evenly.  Each range is a window of its own; the first document of a range is also sent, as a sentinel, to the range
    before.  One shuffle of the texts, no window over the whole table; the first documents of ranges go out as a broadcast if
    there are at most BROADCAST_HEADS.
    """
    docs = docs.withColumn("_h", common.row_key())
    n = docs.count()
    want = max(1, min(QUANTILES, n // BUCKET_DOCS))
    ends = sorted(set(docs.stat.approxQuantile("doc_id", [i / want for i in range(want + 1)], 0.1 / want))) if n else []
    bucket = F.lit(0).cast("long")
    if len(ends) > 1:
        bounds = F.split(F.lit(",".join(str(int(c)) for c in ends)), ",").cast("array<bigint>")
        fine = max(1, n // (BUCKET_DOCS * (len(ends) - 1)))
        coarse = F.least(F.greatest(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(1)), F.lit(len(ends) - 1))
        low, high = F.get(bounds, coarse - 1), F.get(bounds, coarse)
        inside = F.floor((F.col("doc_id") - low) / (high - low) * fine)
        bucket = coarse * fine + F.least(F.greatest(inside, F.lit(0)), F.lit(fine - 1))
    docs = docs.withColumn("_b", F.coalesce(bucket, F.lit(0)).cast("long"))
    key = F.struct(F.col("doc_id").alias("i"), F.col("_h").alias("h"))
    heads = common.materialize(docs.groupBy("_b").agg(F.min(key).alias("k")), "heads")
    # the range before: in its thousand, else the last one of an earlier thousand, at the start the last of all
    group = F.floor(F.col("_b") / 1000).alias("g")
    last = Window.orderBy("g")
    before = heads.groupBy(group).agg(F.max("_b").alias("last"))
    before = before.select("g", F.coalesce(F.lag("last").over(last), F.max("last").over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("ahead"))
    target = heads.select("*", group).join(before, "g").withColumn("_to", F.coalesce(F.lag("_b").over(Window.partitionBy("g").orderBy("_b")), F.col("ahead")))
    target = target.select(F.col("k.i").alias("_i"), F.col("k.h").alias("_k"), "_to")
    target = F.broadcast(target) if common.is_small(heads, BROADCAST_HEADS) else target
    lone = docs.join(target, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_k")))
    lone = lone.withColumn("_b", F.col("_to")).drop("_i", "_k", "_to").dropDuplicates(["_b"]).withColumn("_end", F.lit(1))
    rows = docs.withColumn("_end", F.lit(0)).unionByName(lone)
    rows = derive(rows.repartition("_b"))
    w = Window.partitionBy("_b").orderBy("_end", "doc_id", "_h")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(w))
    return rows.where(F.col("_end") == 0).drop("_h", "_b", "_end")


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(common.read(spark, sf_dir, "documents"))
    rows = successors(docs, ["text", "hashes"], lambda x: with_fingerprint(x, "text", "hashes", "fingerprint", None))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = with_fingerprint(rows, "edited", "edited_hashes", "edited_fingerprint", None)
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
