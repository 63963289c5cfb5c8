"""Comparison of extractions with truth and the metrics over it.  The unit is a row per (document, field)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import confusions, license, license_checks

#: Calibration bins, gate thresholds, stored baseline default.
BINS = [(0.0, 0.5, "0.0-0.5"), (0.5, 0.7, "0.5-0.7"), (0.7, 0.8, "0.7-0.8"), (0.8, 0.9, "0.8-0.9"), (0.9, 1.01, "0.9-1.0")]
GATES = [("creditCode", "business", 0.99), ("companyName", "extraction", 0.95), ("legalRepresentative", "business", 0.95), ("overall", "extraction", 0.92)]
BASELINE_OVERALL = 0.755
CATEGORIES = ["ocr_issue", "segmentation_issue", "validation_issue", "confusion_resolver_issue", "unknown"]


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def squeeze(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"\s+", ""), F.lit(""))


#: What extraction leaves as evidence of how it came to a value.
EVIDENCE = ("label_found", "fuzzy", "fallback", "rebuilt")


def faithful(field: Column, segment: Column, raw: Column, value: Column, actual: Column) -> Column:
    """Does a value say what its segment says?  Each field has its own ways of being equal; null counts as false."""
    squeezed = squeeze(segment)
    name = F.coalesce(text.miss_as_null(F.regexp_extract(segment, r"^[\u4e00-\u9fff·]{2,4}", 0)), squeezed)
    day = F.coalesce(text.miss_as_null(F.regexp_extract(segment, r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日?|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}", 0)), segment)
    scope = F.translate(squeezed, ";", "；")
    own = (
        F.when(field == "creditCode", text.norm_code_confusions(F.regexp_replace(segment, r"[·#!_:.-]", "")).contains(actual))
        .when(field == "companyType", squeeze(raw) == squeezed)
        .when(field == "legalRepresentative", squeeze(raw) == name)
        .when(field == "establishmentDate", text.cn_date_normalise(day) == value)
        .when(field == "businessTerm", squeeze(license.business_term(segment)) == actual)
        .when(field == "registeredCapital", license.capital(segment) == value)
        .when(field == "businessScope", scope.contains(actual) | actual.contains(scope))
    )
    return squeezed.eqNullSafe(actual) | F.coalesce(own, F.lit(False))


def folded(c: Column) -> Column:
    """A value as it is compared, by the row's field."""
    return F.when(F.col("field") == "creditCode", text.norm_code_confusions(c)).otherwise(F.translate(squeeze(c), ";", "；"))


def read(fields: DataFrame, *keep: str) -> DataFrame:
    """Extractions folded and held against their segments."""
    found = fields.withColumn("actual", folded(F.col("value")))
    found = found.withColumn("extraction_match", faithful(F.col("field"), F.col("raw_segment"), F.col("raw"), F.col("value"), F.col("actual")))
    return found.select("doc_id", "field", "style", "actual", "raw_segment", "extraction_match", "confidence", "requires_review", "checksum_valid", *EVIDENCE, *keep)


def judged(rows: DataFrame, *keep: str) -> DataFrame:
    """read() with the folded truth as expected: null-safe equality after squeezing blanks."""
    exp, act = F.col("expected"), F.col("actual")
    business = exp.eqNullSafe(act) | F.coalesce((F.col("field") == "businessTerm") & exp.contains("长期") & (act == "长期"), F.lit(False))
    unread = {"extraction_match": True, "confidence": 0.0, "requires_review": False} | dict.fromkeys(EVIDENCE, False)  # truth without a row of extraction
    return rows.select("doc_id", "style", "field", "expected", "actual", "raw_segment", business.alias("business_match"), "checksum_valid", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in unread.items()], *keep)


def compare(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """Extractions against truth (doc_id, field, expected) that is a table of its own: a full outer join.

    Both sides are folded, and extractions held against their segments, before the join, where rows lie as they were scanned.
    """
    return judged(read(fields).join(truth.select("doc_id", "field", folded(F.col("expected")).alias("expected")), ["doc_id", "field"], "full_outer"))


def compare_kept(fields: DataFrame, *keep: str) -> DataFrame:
    """The same where the truth went with the page: fields with a column truth (a map by field), which every row of a document has.

    No row moves.  A document has a row of extraction for each field, so that none of its truth is left over.
    """
    rows = fields.withColumn("expected", folded(F.try_element_at("truth", F.col("field"))))
    return judged(read(rows, "expected", *keep), *keep)


def documents(cmp: DataFrame) -> DataFrame:
    return cmp.groupBy("doc_id", "style").agg(F.count_if("business_match").alias("business_matches"), F.count_if("extraction_match").alias("extraction_matches"), F.count(F.lit(1)).alias("field_total"))


def field_prf(cmp: DataFrame, keys: list[str] = ["field"]) -> DataFrame:  # noqa: B006
    """TP, FP, FN, TN, precision, recall, F1 and match rates.  A mismatch counts as FP and FN; two nulls count as TP (tn_strict has them)."""
    m, e, a = F.col("business_match"), F.col("expected").isNotNull(), F.col("actual").isNotNull()
    out = cmp.groupBy(*keys).agg(
        F.count_if(m).alias("tp"),
        F.count_if(~m & a).alias("fp"),
        F.count_if(~m & e).alias("fn"),
        F.count_if(~m & ~e & ~a).alias("tn"),
        F.count_if(~e & ~a).alias("tn_strict"),
        F.count_if("extraction_match").alias("x"),
        F.count(F.lit(1)).alias("total"),
    )
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return out.select(*keys, "tp", "fp", "fn", "tn", "tn_strict", "total", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("tp"), F.col("total")).alias("business_match_rate"), ratio(F.col("x"), F.col("total")).alias("extraction_match_rate"))


def style_rates(cmp: DataFrame) -> DataFrame:
    g = cmp.groupBy("style").agg(F.count_if("business_match").alias("b"), F.count_if("extraction_match").alias("x"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))
    return g.select("style", "documents", ratio(F.col("b"), F.col("n")).alias("business_match_rate"), ratio(F.col("x"), F.col("n")).alias("extraction_match_rate"))


def overall(cmp: DataFrame) -> DataFrame:
    g = cmp.agg(F.count_distinct("doc_id").alias("documents"), F.count_if("business_match").alias("b"), F.count_if("extraction_match").alias("x"), F.count_if("requires_review").alias("v"), F.count(F.lit(1)).alias("n"), F.sum(F.col("confidence").cast("decimal(20,3)")).cast("double").alias("c"))
    n = F.col("n")
    return g.select("documents", ratio(F.col("b"), n).alias("business_match_rate"), ratio(F.col("x"), n).alias("extraction_match_rate"), ratio(F.col("v"), n).alias("review_trigger_rate"), ratio(F.col("c"), n).alias("avg_confidence"))


def match_rates(cmp: DataFrame, stored: Column | None = None) -> DataFrame:
    """(field, business_match_rate, extraction_match_rate, stored): each field and, as `overall`, all; one pass over the comparisons.

    stored is the business rate of the rows that meet a condition, null for fields without such rows and for the overall row.
    """
    chosen = F.lit(False) if stored is None else stored
    one = cmp.groupBy("field").agg(F.count_if("business_match").alias("b"), F.count_if("extraction_match").alias("x"), F.count(F.lit(1)).alias("n"), F.count_if(chosen).alias("m"), F.count_if(chosen & F.col("business_match")).alias("c"))
    g = one.rollup("field").agg(*[F.sum(c).alias(c) for c in ("b", "x", "n", "m", "c")], F.grouping("field").alias("all"))
    return g.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("field")).alias("field"), ratio(F.col("b"), F.col("n")).alias("business_match_rate"), ratio(F.col("x"), F.col("n")).alias("extraction_match_rate"), F.when((F.col("all") == 0) & (F.col("m") > 0), ratio(F.col("c"), F.col("m"))).alias("stored"))


def attribution(cmp: DataFrame) -> DataFrame:
    """Losses by field and in total: business wrong but extraction faithful is OCR's, extraction unfaithful is the logic's."""
    counts = cmp.groupBy("field").agg(F.count_if(~F.col("business_match") & F.col("extraction_match")).alias("ocr_failures"), F.count_if(~F.col("extraction_match")).alias("logic_failures"), F.count(F.lit(1)).alias("total"))
    g = counts.rollup("field").agg(*[F.sum(c).alias(c) for c in ("ocr_failures", "logic_failures", "total")])  # of one row a field
    return g.select(F.coalesce("field", F.lit("(all)")).alias("field"), "ocr_failures", "logic_failures", "total", ratio(F.col("ocr_failures"), F.col("total")).alias("ocr_share"), ratio(F.col("logic_failures"), F.col("total")).alias("logic_share"))


def calibration(cmp: DataFrame) -> DataFrame:
    """Five confidence bins, empty ones too; calibrated is false for the top bin under 98 % with five rows or more."""
    conf = F.col("confidence")
    label = F.when(conf < 0, None)
    for low, high, name in BINS:
        label = label.when((conf >= low) & (conf < high), name)
    counts = cmp.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("predicted"), F.count_if("business_match").alias("b"), F.count_if("extraction_match").alias("x"))
    bins = cmp.sparkSession.createDataFrame([(name, low) for low, _, name in BINS], "bin string, low double")
    rows = bins.join(counts, "bin", "left").fillna(0, ["predicted", "b", "x"])
    accuracy = ratio(F.col("b"), F.col("predicted"))
    return rows.select("bin", "predicted", accuracy.alias("business_accuracy"), ratio(F.col("x"), F.col("predicted")).alias("extraction_accuracy"), (~((F.col("low") >= 0.9) & (F.col("predicted") >= 5) & (accuracy < 0.98))).alias("calibrated"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, three decimals; 1 for two nulls, 0 for one."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 3))


def failures(cmp: DataFrame) -> DataFrame:
    """Rows whose business match fails, of comparisons with the document's text (ocr_text), with a category and a similarity."""
    rows = cmp.where(~F.col("business_match"))
    e, a, f = F.col("expected"), F.col("actual"), F.col("field")
    seen = F.coalesce(F.col("ocr_text").contains(F.substring(e, 1, 4)), F.lit(False))
    both = a.isNotNull() & e.isNotNull()
    category = (
        F.when(a.isNull() & e.isNotNull(), F.when(seen, "segmentation_issue").otherwise("ocr_issue"))
        .when(both & (f == "creditCode"), "validation_issue")
        .when(both & f.isin("companyType", "legalRepresentative", "registeredCapital"), "confusion_resolver_issue")
        .when(both & f.isin("companyName", "address", "businessScope"), "ocr_issue")
        .otherwise("unknown")
    )
    return rows.withColumn("category", category).withColumn("similarity", similarity(e, a))


def bucket(labels: dict[str, str]) -> Column:
    """Four-way failure bucket of a failures row."""
    e, a, f, t, seg, conf, rev = (F.col(c) for c in ("expected", "actual", "field", "ocr_text", "raw_segment", "confidence", "requires_review"))
    intact = F.lit(True)
    for field, label in labels.items():
        intact = F.when(f == field, F.coalesce(t.contains(label), F.lit(False))).otherwise(intact)
    in_text = F.coalesce(t.contains(e) | ((F.length(e) >= 2) & t.contains(F.substring(e, 1, 6))), F.lit(False))
    wrong, lost = a.isNotNull() & e.isNotNull() & (a != e), a.isNull() & e.isNotNull()
    code = f == "creditCode"
    return (
        F.when(code & lost, F.when(intact, "validation_failure").otherwise("segmentation_failure"))
        .when(code & (wrong | (a.isNotNull() & ~F.coalesce("checksum_valid", F.lit(False)))), "validation_failure")
        .when(~rev & (conf >= 0.8) & ~e.eqNullSafe(a), "confidence_failure")
        .when(lost, F.when(in_text, "segmentation_failure").otherwise("ocr_failure"))
        .when(wrong & ~in_text, "ocr_failure")
        .when(wrong & (~intact | ~F.coalesce(seg.contains(F.substring(e, 1, 4)), F.lit(True))), "segmentation_failure")
        .otherwise("ocr_failure")
    )


#: Failure buckets: fixed values.
BUCKETS = ("ocr_failure", "segmentation_failure", "validation_failure", "confidence_failure")
ALL = "(all)"


def grid_counts(rows: DataFrame, dimensions: dict[str, list[str]]) -> DataFrame:
    """(dimensions, n): counts of every combination of the dimensions' values, and every subtotal as ALL; zero where no row is.

    The grid is made of the dimensions, so that it is as large for no rows at all; rows are counted once, by the finest
    combination, and only these few counts are cubed.  A value that a dimension doesn't list (null is one) has no row of its own
    but is in all totals.
    """
    names = list(dimensions)
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.withColumns({c: F.when(F.col(c).isin(*dimensions[c]), F.col(c)).otherwise(F.lit("(other)")) for c in names})
    cubed = listed.cube(*names).agg(F.sum("n").alias("n")).select(*[F.coalesce(c, F.lit(ALL)).alias(c) for c in names], "n")
    grid = rows.sparkSession.range(1).select(*[F.array(*[F.lit(v) for v in (*values, ALL)]).alias(c) for c, values in dimensions.items()])
    for c in names:
        grid = grid.withColumn(c, F.explode(c))
    return grid.join(cubed, names, "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"))


def counts_with_zeros(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    have = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string").join(have, column, "left").fillna(0, ["n"])


#: Ids and the confidence of a sure reading: fixed values.
CAUSES = (
    "punctuation_in_credit_code", "label_corruption", "limited_company_ocr", "company_name_boundary", "credit_checksum_reject", "business_scope_label_break",
    "address_over_capture", "address_ocr_noise", "legal_rep_confusion", "high_confidence_wrong", "date_ocr_noise",
)
SURE = 0.85
#: Parts in which a cause's documents are ranked, so that no task holds a whole cause.
EXAMPLE_PARTS = 256


def causes() -> dict[str, Column]:
    """Id -> condition over a failures row; a failure may meet several.

    Causes are told by the evidence that extraction left in the row (how the label and the value were found) and by how the value
    differs, not by patterns over the page; so damage that is elsewhere on the page is not blamed.
    """
    of = lambda *names: F.col("field").isin(*names)
    want, got = F.col("expected"), F.col("actual")
    longer = F.length(got) - F.length(want)
    ends = lambda c: F.exists(F.array(*map(F.lit, confusions.SUFFIXES)), lambda s: c.endswith(s))
    odd = lambda allowed: F.coalesce(got, F.col("raw_segment")).rlike(f"[^{allowed}]")
    told = (
        of("creditCode") & F.col("rebuilt"),
        F.col("fuzzy") | ~F.col("label_found"),
        of("companyName", "companyType") & ends(want) & ~ends(got),
        of("companyName") & (longer < -2) & want.contains(got),
        of("creditCode") & ~F.coalesce("checksum_valid", F.lit(False)),
        of("businessScope") & ~F.col("label_found"),
        of("address") & (longer > 10) & got.startswith(want),
        of("address") & ~got.rlike(license_checks.ADDRESS),
        of("legalRepresentative") & F.col("similarity").between(0.5, 0.999),
        F.col("confidence") >= SURE,
        of("establishmentDate", "businessTerm") & odd(r"0-9年月日至到长期\s-"),
    )
    return dict(zip(CAUSES, told, strict=True))


def root_causes(fails: DataFrame) -> DataFrame:
    """(rank, cause, impact, affected_fields, examples): a failure may count for several causes; at most five example documents."""
    hits = fails.select("doc_id", "field", F.explode(F.array_compact(F.array(*[F.when(told, F.lit(c)) for c, told in causes().items()]))).alias("cause"))
    # in one pass: the least five ids of each of a cause's parts, of which the least five are the cause's; fields by a set of at most ten
    part = F.pmod(F.xxhash64("doc_id"), F.lit(EXAMPLE_PARTS))
    hits = hits.withColumn("nth", F.dense_rank().over(Window.partitionBy("cause", part).orderBy("doc_id")))
    least = F.slice(F.sort_array(F.collect_set(F.when(F.col("nth") <= 5, F.col("doc_id")))), 1, 5)
    g = hits.groupBy("cause").agg(F.count(F.lit(1)).alias("impact"), F.array_join(F.sort_array(F.collect_set("field")), ",").alias("affected_fields"), F.array_join(F.transform(least, lambda x: x.cast("string")), ",").alias("examples"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("impact"), "cause"))).select("rank", "cause", "impact", "affected_fields", "examples")


def gate(cmp: DataFrame) -> DataFrame:
    """(metric, value, threshold, passed) for each threshold."""
    rates = match_rates(cmp)
    gates = cmp.sparkSession.createDataFrame(GATES, "field string, kind string, threshold double")
    value = F.when(F.col("kind") == "business", F.col("business_match_rate")).otherwise(F.col("extraction_match_rate"))
    return gates.join(rates, "field", "left").select(F.concat_ws(" ", "field", "kind").alias("metric"), F.coalesce(value, F.lit(0.0)).alias("value"), "threshold", (F.coalesce(value, F.lit(0.0)) >= F.col("threshold")).alias("passed"))


def baseline_delta(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(field, current, baseline, delta): a field without a stored value counts from 0, the overall row from its default."""
    return delta(current.join(stored, "field", "left"))


def delta(rates: DataFrame) -> DataFrame:
    """baseline_delta of rows that hold both: (field, current, baseline)."""
    base = F.coalesce("baseline", F.when(F.col("field") == "overall", BASELINE_OVERALL).otherwise(0.0))
    return rates.select("field", "current", base.alias("baseline"), F.round(F.col("current") - base, 6).alias("delta"))
