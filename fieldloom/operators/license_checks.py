"""Validation of five licence fields: score, verdict, review and signals from flags of the value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import confusions

#: Characters of names and addresses, marks that are garbage, weights of flags.
HAN = "\u4e00-\u9fff"
MARKS = r"[#@$%^&*<>{}\[\]\\|`~]"
ADDRESS = rf"^[{HAN}0-9A-Za-z()（）\-—、,，.。;；\s]+$"
BASE = {"companyName": 0.3, "legalRepresentative": 0.2, "companyType": 0.25, "address": 0.35, "businessScope": 0.3}
WEIGHTS = {
    "companyName": {"suffix": 0.45, "sized": 0.15, "no_latin": 0.1},
    "legalRepresentative": {"person": 0.65, "no_latin": 0.1, "no_marks": 0.05},
    "companyType": {"template": 0.5, "company_word": 0.15, "sized": 0.1},
    "address": {"han": 0.25, "charset": 0.15, "clean": 0.1, "eight": 0.05, "place_word": 0.15},
    "businessScope": {"han": 0.35, "four": 0.2, "no_marks": 0.15},
}
VALID = {
    "companyName": ("suffix", "sized", "no_latin"),
    "legalRepresentative": ("person", "no_latin", "no_marks"),
    "companyType": ("template", "company_word"),
    "address": ("han", "charset", "two", "place_word"),
    "businessScope": ("han", "four"),
}
#: A value that lacks one of these goes to review.
CERTAIN = {
    "companyName": ("suffix", "no_latin"),
    "legalRepresentative": ("person", "no_latin", "no_marks"),
    "companyType": ("template",),
    "address": ("clean", "eight", "place_word"),
    "businessScope": ("no_marks", "four"),
}
#: (signal, flag, whether the flag must hold), in order.
SIGNALS = {
    "companyName": (("valid_suffix", "suffix", True), ("reasonable_length", "sized", True), ("contains_latin", "no_latin", False)),
    "legalRepresentative": (("chinese_name", "person", True), ("contains_latin", "no_latin", False), ("contains_symbols", "no_marks", False)),
    "companyType": (("template", "template", True), ("company_keyword", "company_word", True)),
    "address": (("has_chinese", "han", True), ("ocr_garbage", "clean", False), ("allowed_charset", "charset", True), ("admin_markers", "place_word", True)),
    "businessScope": (("has_chinese", "han", True), ("ocr_garbage", "no_marks", False), ("reasonable_length", "four", True)),
}


#: What the rules ask of a trimmed value.
FLAGS: dict[str, Callable[[Column], Column]] = {
    "suffix": lambda v: v.rlike(rf"(?:{'|'.join(confusions.SUFFIXES)})\z"),
    "template": lambda v: v.rlike("|".join(confusions.TYPES)),
    "company_word": lambda v: v.rlike("公司|企业|合伙"),
    "person": lambda v: v.rlike(f"^[{HAN}·]{{2,4}}$"),
    "han": lambda v: v.rlike(f"[{HAN}]"),
    "no_latin": lambda v: ~v.rlike("[A-Za-z]"),
    "no_marks": lambda v: ~v.rlike(MARKS),
    "charset": lambda v: v.rlike(ADDRESS),
    "clean": lambda v: v.rlike(ADDRESS),
    "place_word": lambda v: v.rlike("[省市区县镇乡村路街道号]"),
    "sized": lambda v: F.length(v).between(4, 80),
    "two": lambda v: F.length(v) >= 2,
    "four": lambda v: F.length(v) >= 4,
    "eight": lambda v: F.length(v) >= 8,
}


def checked(field: str, value: Column) -> Column:
    """(score, valid, review, signals) of a value of one of the fields of BASE, as `validate` gives them; signals is an array."""
    names = sorted({*WEIGHTS[field], *VALID[field], *CERTAIN[field], *(x for _, x, _ in SIGNALS[field])})

    def verdict(found: Column) -> Column:
        every = lambda these: reduce(and_, [found[x] for x in these])
        total = sum((F.when(found[x], w).otherwise(0.0) for x, w in WEIGHTS[field].items()), F.lit(BASE[field]))
        empty = found["empty"]
        return F.struct(
            F.when(empty, 0.0).otherwise(F.round(F.least(F.lit(1.0), total), 6)).alias("score"),
            (~empty & every(VALID[field])).alias("valid"),
            (empty | ~every(CERTAIN[field])).alias("review"),
            F.when(empty, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(found[x] == want, name) for name, x, want in SIGNALS[field]]))).alias("signals"),
        )

    # each flag is found once, however many rules ask for it
    flags = lambda v: F.struct((v == "").alias("empty"), *[FLAGS[x](v).alias(x) for x in names])
    return text.bound(text.bound(F.trim(F.coalesce(value, F.lit(""))), flags), verdict)


def validate(rows: DataFrame) -> DataFrame:
    """rows with field and value; adds score, valid, review and signals (comma-joined).

    Only the five fields of BASE are kept.  A null or blank value scores 0 and goes to review without signals.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    rows = rows.where(F.col("field").isin(*BASE)).withColumn("_flags", F.struct(*[flag(value).alias(name) for name, flag in FLAGS.items()]))
    holds = lambda name: F.col("_flags").getField(name)
    every = lambda names: F.forall(F.array(*[holds(x) for x in names]), lambda x: x)
    score, valid, certain, signals = (F.lit(None).cast(t) for t in ("double", "boolean", "boolean", "string"))
    for field in BASE:
        this = F.col("field") == field
        total = sum((F.when(holds(x), w).otherwise(0.0) for x, w in WEIGHTS[field].items()), F.lit(BASE[field]))
        score = F.when(this, F.round(F.least(F.lit(1.0), total), 6)).otherwise(score)
        valid, certain = F.when(this, every(VALID[field])).otherwise(valid), F.when(this, every(CERTAIN[field])).otherwise(certain)
        signals = F.when(this, F.concat_ws(",", *[F.when(holds(x) == want, name) for name, x, want in SIGNALS[field]])).otherwise(signals)
    empty = value == ""
    out = rows.withColumns({"score": F.when(empty, 0.0).otherwise(score), "valid": ~empty & valid, "review": empty | ~certain, "signals": F.when(empty, "").otherwise(signals)})
    return out.drop("_flags")
