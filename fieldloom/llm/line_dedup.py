"""Line dedup by range-partitioned hashes (DataFrame operations only).

Every non-blank line becomes a row of two hashes of its key, its document and its position: never its text.  The rows are
range-partitioned by the first hash and a salt taken from the document, so that a key that holds a large share of all rows is
split over many tasks.  Inside a range they are sorted by key, document and position, the first occurrence in each document is
streamed off, and per-salt counts are summed.  What comes back is a keep bitmap for each document that loses lines, compressed
to the 64-line words in which a line is lost: a word that isn't there keeps all its lines.

Two keys are taken as equal if their 96 hash bits agree.

Cases: null text is one empty line; blank lines are never dropped; a line counts once for each document; rows equal in
doc_id and text count as one document and get the same bitmap; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common

SALTS = 64
BROADCAST_KEYS, HOT_LINES = 200_000, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Blanks stripped, A-Z lower-cased; in an all-ASCII line lower() does just that, and faster."""
    key = F.btrim(line, F.lit(common.BLANKS))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def line_hashes(df: DataFrame) -> DataFrame:
    """documents -> (doc_id, row_key, pos, h1, h2), a row for each line whose key is not empty."""
    lines = df.select("doc_id", common.row_key().alias("row_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key")).where(F.col("key") != "")
    return keyed.select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def key_counts(hashes: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, n_lines, first): first is the earliest (doc_id, row_key, pos)."""
    ranged = hashes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(SALTS))).repartitionByRange("h1", "salt")
    in_doc = Window.partitionBy("h1", "salt", "h2", "doc_id", "row_key").orderBy("pos")
    firsts = ranged.withColumn("nth", F.row_number().over(in_doc))
    part = firsts.groupBy("h1", "salt", "h2").agg(
        F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).alias("n_docs"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min(F.struct("doc_id", "row_key", "pos")).alias("first"),
    )
    return part.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.min("first").alias("first"))


def keep_bitmaps(df: DataFrame, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """(doc_id, row_key, n_dropped, keep): for documents that lose lines, sorted 64-line words in which a set bit is a kept line.

    Lines whose key stands in at least min_docs documents are lost: all of them, or all but the corpus's first (keep_first).
    With min_docs=1 and keep_first, repeats within one document go as well.
    """
    hashes = common.materialize(line_hashes(df), "line-hashes")
    counts = key_counts(hashes)
    hit = F.col("n_docs") >= min_docs
    if keep_first:
        hit = hit & (F.col("n_lines") > 1)
    counts = counts.where(hit)
    columns = ["h1", "h2", "first"] if keep_first else ["h1", "h2"]
    keys = common.materialize(counts.select(*columns, "n_lines"), "line-keys")
    lost = lost_lines(hashes, keys, columns)
    if keep_first:
        lost = lost.where(~F.struct("doc_id", "row_key", "pos").eqNullSafe(F.col("first")))
    words = lost.groupBy("doc_id", "row_key", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    return words.groupBy("doc_id", "row_key").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
    )


def lost_lines(hashes: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of hashes whose key is in keys (columns and n_lines).

    Keys go out as a broadcast if there are few.  If there are many, only the hot ones do, those of more than HOT_LINES lines (or
    a tenfold of that, until they are few); the rows of all others are shuffled to their keys, HOT_LINES rows a key at most.
    """
    if common.is_small(keys, BROADCAST_KEYS):
        return hashes.join(F.broadcast(keys.select(*columns)), ["h1", "h2"])
    most = HOT_LINES
    while not common.is_small(hot := keys.where(F.col("n_lines") > most), BROADCAST_KEYS):
        most *= 10
    marked = hashes.join(F.broadcast(hot.select(*columns, F.lit(True).alias("hot"))), ["h1", "h2"], "left")
    wanted = [*hashes.columns, *columns[2:]]
    cold = marked.where(F.col("hot").isNull()).select(*hashes.columns).join(keys.where(F.col("n_lines") <= most).select(*columns), ["h1", "h2"])
    return marked.where("hot").select(*wanted).unionByName(cold.select(*wanted))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """df with row_key, n_lines, n_dropped and kept_text; df needs doc_id and text and may have other columns."""
    maps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("n_dropped").alias("_n"), F.col("keep").alias("_keep"))
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = df.withColumn("_row_key", F.xxhash64(text)).join(maps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key")), "left")
    k = F.col("_keep")
    # words between those that are there keep all lines
    gap = lambda x, i: (x["word"] - F.coalesce(F.get(k, i - 1)["word"], F.lit(-1)) - 1).cast("int")
    joined = joined.withColumn("_words", F.flatten(F.transform(k, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(x, i)), F.array(x["bits"])))))
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: F.coalesce(F.getbit(F.get(F.col("_words"), F.shiftright(i, 6)), F.expr("0") + i.bitwiseAND(F.lit(63))), F.lit(1)) == 1)
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce("_n", F.lit(0)).cast("long"))
        .withColumn("kept_text", F.when(F.col("_n").isNull(), text).otherwise(F.array_join(kept, "\n")))
        .drop("_row_key", "_id", "_key", "_n", "_keep", "_words")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(common.read(spark, sf_dir, "documents"))
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, keep_first=False))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), bad AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, bad.key IS NOT NULL AS gone FROM keyed LEFT JOIN bad ON keyed.key = bad.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
