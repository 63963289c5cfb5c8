"""Reports over comparisons read the table once; truth that goes with its page is compared as truth that is joined."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import evaluate, license
from fieldloom.plans import catalog, document_queries, license_queries
from fieldloom.sources import synth, tables

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["met_field_prf", "met_style", "met_overall", "met_attribution", "met_calibration", "err_counts", "err_root_causes", "gate_pass_fail", "cmp_baseline"])
def test_reads_once(spark, name):
    plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1


def test_visa_scores_read_once(spark):
    plan = document_queries.sheet_scores(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1 and "Join" not in plan


def test_kept_truth_equals_joined(spark):
    expected = tables.long_truth(license_queries.truth(spark, DIR), ["doc_id", "style"], list(synth.FIELDS))
    joined = evaluate.compare(license_queries.fields(spark, DIR), expected)
    kept = license_queries.comparisons(spark, DIR)
    assert kept.columns == joined.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert len(rows(kept)) == 1500 and rows(kept) == rows(joined)


def test_examples_are_least_ids(spark):
    blank = {c: F.lit(False) for c in ("fuzzy", "rebuilt", "checksum_valid")}
    fails = spark.range(5000, 0, -1).select(F.col("id").alias("doc_id"), F.lit("creditCode").alias("field"), F.lit("a").alias("expected"), F.lit("b").alias("actual"), F.lit("b").alias("raw_segment"), F.lit(True).alias("label_found"), F.lit(0.1).alias("confidence"), F.lit(0.0).alias("similarity"), *[c.alias(f) for f, c in blank.items()])
    row = evaluate.root_causes(fails.unionByName(fails.where("doc_id = 3"))).collect()
    assert [(r.cause, r.impact, r.affected_fields, r.examples) for r in row] == [("credit_checksum_reject", 5001, "creditCode", "1,2,3,4,5")]


@pytest.mark.parametrize(("page", "want"), [("注册责本100万元", "注册责本"), ("注册本100万元", "注册本"), ("注册资料本100万元", "注册资料本"), ("注责本100万元", None)])
def test_short_labels_by_one_edit(spark, page, want):
    """A label of four characters by one edit: a wrong, a missing, a further character."""
    docs = spark.createDataFrame([(1, f"营业执照\n{page}\n类型")], "doc_id long, text string")
    got = {r.field: r.matched for r in license.label_spans(docs).collect()}
    assert got.get("registeredCapital") == want
