"""Quality rules: base counts and a hashed n-gram log-likelihood ratio (DataFrame operations only).

Two multinomials over BUCKETS hash buckets of words and word pairs are fitted: a trusted target (documents with a label of
quality 1, all of them) and the raw corpus (every document).  A document's score is the mean
over its n-grams of log p_target - log p_raw.  The ratios are one array of BUCKETS numbers, computed by Spark and sent out as a
literal.

The target is mixed with the raw corpus in a fixed proportion (SHARE of the target's own n-grams), so a ratio's range doesn't
depend on how much the target has seen.  Its noise does: one trusted document in HELD takes no part in the fit, and a
document is kept if its score reaches the lesser of THRESHOLD and what a further trusted document would reach, the mean of these
scores less DEVIATIONS prediction deviations.  With many labels that is THRESHOLD; with few, a text is judged by their noise.

Cases: a null, empty or blank text has no words, fails the base rule (n_words < 50) and scores 0; without labels all ratios
are 0 and every document that passes the base rule stays, as where fewer than two trusted documents of 50 words are held out;
repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common

BUCKETS = 16_384
THRESHOLD = -0.03
SHARE = 0.25
HELD = 4
DEVIATIONS = 3.0
LEAST_WORDS = 50


def with_words(df: DataFrame) -> DataFrame:
    """Adds words, and word_hashes."""
    words = F.array_remove(F.split("text", common.BLANK_CLASS + "+"), "")
    return df.withColumn("words", words).withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))


def bucket(word_hash: Column) -> Column:
    """BUCKETS is a power of two."""
    return word_hash.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def buckets() -> Column:
    """Buckets of a document's words and word pairs; the last word's pair has one member only and is left out."""
    w = F.col("word_hashes")
    single = F.transform(w, bucket)
    pairs = F.transform(w, lambda x, i: bucket(F.xxhash64(x, F.get(w, i + 1))))
    return F.concat(single, F.slice(pairs, 1, F.greatest(F.size(w) - 1, F.lit(0))))


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, _held): the documents of docs with a label of quality 1, and whether they are kept from the fit.

    Labels grow with the documents, so that they are shuffled, at any size; the texts stream past them unsorted.
    """
    ids = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    return docs.join(ids.hint("shuffle_hash"), "doc_id").withColumn("_held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0)


def bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    return docs.select(F.explode(buckets()).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def ratios(docs: DataFrame, trusted: DataFrame, share: float = SHARE) -> DataFrame:
    """(bucket, ratio) for every bucket; docs and trusted (of trusted_documents) have word_hashes."""
    # every trusted document is one of docs, so that its buckets are among the raw ones
    counts = bucket_counts(docs, "raw").join(bucket_counts(trusted.where(~F.col("_held")), "target"), "bucket", "left")
    seen_once = common.materialize(counts, "quality-counts")  # BUCKETS rows at most; read three times
    full = docs.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket")).join(seen_once, "bucket", "left").fillna(0, ["raw", "target"])
    total = full.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    all_raw, all_target = total.select("raw").scalar(), total.select("target").scalar()
    p_raw = (F.col("raw") + 1) / (all_raw + BUCKETS)
    p_target = (F.col("target") / all_target + share * p_raw) / (1 + share)
    return full.select("bucket", F.when(all_target > 0, F.log(p_target) - F.log(p_raw)).otherwise(0.0).alias("ratio"))


def calibrated(trusted: DataFrame, scored: Column, threshold: float = THRESHOLD) -> float:
    """The least score that is kept: threshold, or less where held-out trusted documents scatter more widely."""
    held = trusted.where(F.col("_held") & (F.size("words") >= LEAST_WORDS))
    found = held.select(scored.alias("s")).agg(F.count("s").alias("n"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd")).first()
    if found["n"] < 2:
        return float("-inf")
    return min(threshold, round(found["mean"] - DEVIATIONS * found["sd"] * (1 + 1 / found["n"]) ** 0.5, 6))


def base_counts(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to a table with text and words."""
    text, words, w = F.col("text"), F.col("words"), F.col("word_hashes")
    # lines with a word: those that have a character that is not blank
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.BLANKS)) != ""))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    df = df.withColumn("_windows", F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))))
    h = F.col("_windows")
    # windows sorted by hash lie beside their equals; only texts with an equal pair are sorted
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    at = F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
    df = df.withColumn("_at", F.array_compact(at))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda p: F.array(p, p + 1, p + 2)))))
    return (
        df.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("_at").isNull(), 0).otherwise(covered).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_windows", "_sorted", "_at", "_lines")
    )


def score(ratio: DataFrame) -> Column:
    """Mean ratio of a document's n-grams, 0 for a document without words.

    The BUCKETS ratios (a fixed number) come to the driver and go out as one array literal.
    """
    table = [r["ratio"] for r in ratio.orderBy("bucket").collect()]
    literal = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    w = F.col("word_hashes")
    each = F.transform(w, lambda x, i: F.get(literal, bucket(x)) + F.when(i < F.size(w) - 1, F.get(literal, bucket(F.xxhash64(x, F.get(w, i + 1))))).otherwise(0.0))
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(w) > 0, F.round(total / (2 * F.size(w) - 1), 9)).otherwise(0.0)


def judge(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """(_row, doc_id, text, base counts, llr, kept) for every row of df; _row holds all its columns."""
    docs = common.documents(df)
    trusted = with_words(common.materialize(trusted_documents(docs, labels), "quality-trusted", "zstd"))  # counted, then scored
    scored = score(ratios(with_words(docs), trusted, share))
    least = calibrated(trusted, scored, threshold)
    rows = common.carry(df).withColumn("text", F.coalesce("text", F.lit("")))
    return base_counts(with_words(rows)).withColumn("llr", scored).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least)).drop("words", "word_hashes")


def keep(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """The rows of df that pass, unchanged.

    The row number keeps the optimizer from pushing the filter below the projections, which would copy each of their
    expressions into the condition as often as it is used.
    """
    judged = judge(df, labels, threshold, share).withColumn("_no", F.monotonically_increasing_id())
    return common.restore(judged.where(F.col("kept") & (F.col("_no") >= 0)), df.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = judge(common.read(spark, sf_dir, "documents"), labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
