"""Reduction of several OCR passes of a document (doc_id, pass_no, pass_id, text, score, ...) to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import detect


def score(t: Column, confidence: Column) -> Column:
    """Composite of MRZ content, labels, confidence and field signals: fixed weights."""
    up = F.upper(t)
    compact = F.regexp_replace(up, r"\s", "")
    # only lines with a filler, or of nothing but digits, letters and blanks, can count
    may = F.filter(F.split(up, "\r?\n"), lambda x: x.contains("<") | x.rlike(r"^[A-Z0-9\s\x{85}\x{2028}\x{2029}]{28,}$"))
    lines = F.transform(may, lambda x: F.regexp_replace(x, r"\s", ""))
    per_line = F.aggregate(
        lines,
        F.lit(0),
        lambda acc, x: acc + F.when((F.length(x) >= 28) & (x.contains("<<") | x.startswith("V<")), 12).otherwise(0) + F.when(x.rlike("^[A-Z0-9<]{28,}$") & x.rlike("[0-9]{6}"), 12).otherwise(0),
    )
    zone = F.when(compact.rlike("V<[A-Z]{3}"), 40).otherwise(0) + F.when(~compact.contains("P<") & compact.rlike("[A-Z]{3}[A-Z]{2,}<<"), 25).otherwise(0)
    mrz = F.least(F.lit(100), per_line + F.when(t.contains("<"), zone).otherwise(0))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(100.0), confidence)) / 100
    words = ("SURNAME", "NATIONALITY", "PASSPORT", "CONTROL", "GRANT")
    bonus = F.when(detect.shows(up, text.word("VISA"), "VISA"), 15).otherwise(0) + F.when(detect.shows(up, text.word("|".join(words)), *words), 10).otherwise(0)
    return F.round(mrz * 0.35 + detect.visa_label_count(t) * 10 + conf * 25 + detect.field_signals(t) * 8 + bonus, 6)


def best(passes: DataFrame) -> DataFrame:
    """The pass with the highest score of each document; of equals the earliest."""
    return passes.groupBy("doc_id").agg(F.max_by(F.struct("pass_id", "pass_no", "score"), F.struct("score", -F.col("pass_no"))).alias("b")).select("doc_id", "b.*")


def score_map(passes: DataFrame) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("pass_id", "score")))
    return passes.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("scores"))


def recovered(passes: DataFrame) -> DataFrame:
    """max(0, winner's signals - pass1's signals); a document without pass1 recovers nothing."""
    first = F.max(F.when(F.col("pass_id") == "pass1", F.col("signals")))
    win = F.max_by("signals", F.struct("score", -F.col("pass_no")))
    return passes.groupBy("doc_id").agg(F.greatest(F.lit(0), win - F.coalesce(first, win)).alias("recovered"))


def until(passes: DataFrame, good: Column) -> DataFrame:
    """Passes up to and including each document's first good one (early exit)."""
    before = Window.partitionBy("doc_id").orderBy("pass_no").rowsBetween(Window.unboundedPreceding, -1)
    return passes.withColumn("_done", F.coalesce(F.max(good.cast("int")).over(before), F.lit(0))).where(F.col("_done") == 0).drop("_done")


#: When the first pass looks blurred, and when a later one is good enough.
BLUR_MRZ, BLUR_LABELS, BLUR_LENGTH, GOOD_SCORE, GOOD_LABELS = 20, 3, 250, 48, 2


def blur_gate(passes: DataFrame) -> DataFrame:
    """The passes (pass_no, score, mrz_score, label_count, length) that are run: the first, and if it looks blurred the others up to a good one."""
    order = Window.partitionBy("doc_id").orderBy("pass_no")
    blurred = (F.col("mrz_score") < BLUR_MRZ) & (F.col("label_count") < BLUR_LABELS) & (F.col("length") < BLUR_LENGTH)
    rows = passes.withColumn("_nth", F.row_number().over(order)).withColumn("_blurred", F.first(blurred).over(order))
    good = (F.col("_nth") > 1) & (F.col("score") >= GOOD_SCORE) & (F.col("label_count") >= GOOD_LABELS)
    return until(rows.where((F.col("_nth") == 1) | F.col("_blurred")), good).drop("_nth", "_blurred")


def merge_lines(passes: DataFrame) -> DataFrame:
    """(doc_id, text): distinct trimmed lines of two characters or more, in order of first appearance over all passes."""
    lines = passes.select("doc_id", "pass_no", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).withColumn("line", text.full_trim(F.col("line"))).where(F.length("line") >= 2)
    first = lines.groupBy("doc_id", "line").agg(F.min(F.struct("pass_no", "pos")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def top_groups(passes: DataFrame, by: str, n: int) -> DataFrame:
    """The n values of `by` with the highest maximum score of each document."""
    g = passes.groupBy("doc_id", by).agg(F.max("score").alias("score"))
    return g.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), by))).where(F.col("nth") <= n)


#: Keywords with the patterns that show them: fixed values.
KEYWORDS = {
    "营业执照": (r"营业\s*执照", r"营\s*业\s*执\s*照", r"营业执照"),
    "统一社会信用代码": (r"统一\s*社会\s*信用\s*代码", r"社会\s*信用\s*代码", r"信用\s*代码"),
    "法定代表人": (r"法定\s*代表\s*人", r"法人\s*代表", r"法定代表"),
    "注册资本": (r"注册\s*资本", r"注册\s*资金"),
    "名称": (r"名\s*称\s*[:：]", r"(?m:^名\s*称)"),
    "成立日期": (r"成立\s*日期", r"成立\s*时间", r"设立\s*日期"),
}


def keyword_score(t: Column) -> tuple[Column, Column]:
    """(score, hits) of the licence keywords: fixed weights."""
    code = F.regexp_replace(t, r"\s", "").rlike("[0-9A-Z]{18}")
    shown = {k: t.rlike("|".join(patterns)) for k, patterns in KEYWORDS.items()}
    total = sum((F.when(c, 0.22 if k == "营业执照" else 0.14).otherwise(0.0) for k, c in shown.items()), F.when(code, 0.08).otherwise(0.0))
    hits = F.array_compact(F.array(*[F.when(c, k) for k, c in shown.items()]))
    return F.round(F.least(F.lit(1.0), total), 6), hits
