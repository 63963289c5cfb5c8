"""Fields of a licence: a segment is normalised, read anew where OCR confuses characters, validated and scored.

Each of the ten fields has expressions of its own over the document's row; results are an array of RESULT, exploded once.  A
holder's name keeps what was read, another reading is only offered as candidate; a company's name is never corrected; a company's
type and capital take the best reading.  Every replacement is logged, and lowers the confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import confusions, license, license_checks
from fieldloom.operators.license import let
from fieldloom.sources.synth import LABELS

HAN, MARKS = license_checks.HAN, license_checks.MARKS
#: What may end a value, length caps, and characters that are common in licences.
TAIL = rf"[^{HAN}0-9A-Za-z()（）\-—、,，.。;；\s]+$"
CAPS = {"companyType": 80, "address": 200, "businessScope": 800, "registrationAuthority": 100}
COMMON = rf"[^{HAN}0-9A-Za-z_\s()（）\-—、,，.。:：;；/￥¥]"
#: A segment goes no further than the next field's label, found or not.
STOPS = {"legalRepresentative": ("住所", "注册资本"), "companyType": ("成立日期",), "address": ("经营范围",), "businessScope": ("登记机关",)}
#: Scores of fields without a validator of their own, as they have a value or not: fixed values.
PLAIN = {"registeredCapital": (0.85, 0.2), "establishmentDate": (0.95, 0.35), "businessTerm": (0.8, 0.2), "registrationAuthority": (0.75, 0.2)}
RESULT = f"struct<field:string,raw:string,value:string,candidate:string,corrections:{confusions.EDITS},validation_score:double,pattern_valid:boolean,checksum_valid:boolean,cleaned:boolean,rebuilt:boolean,doubtful:boolean,signals:array<string>>"
REVIEW_BELOW = 0.65


def without_artefacts(c: Column) -> Column:
    """Without marks, what may not end a value, and up to four Latin letters at its end."""
    for pattern in (f"{MARKS}+", TAIL, r"[A-Za-z]{1,4}$"):
        c = F.regexp_replace(c, pattern, "")
    return text.full_trim(c)


def punctuated(c: Column) -> Column:
    """Full-width colons, commas and semicolons, no white space."""
    return F.regexp_replace(F.translate(c, ":,;", "：，；"), r"\s+", "")


def normalise(field: str, segment: Column) -> Column:
    """(raw, value, cleaned) of a segment of one field: raw ends before another field's label; cleaned tells of artefacts removed."""
    raw = text.full_trim(F.coalesce(segment, F.lit("")))
    for stop in STOPS.get(field, ()):
        until = lambda c: text.full_trim(F.regexp_replace(c, f"{stop}[\\s\\S]*$", ""))  # noqa: B023, E731
        raw = until(raw) if field == "legalRepresentative" else let(raw, lambda r: let(until(r), lambda cut: F.when(cut == "", r).otherwise(cut)))  # noqa: B023
    artless = (lambda c: text.full_trim(F.regexp_replace(c, f"{MARKS}+", ""))) if field == "companyName" else without_artefacts
    shape = {"companyName": punctuated, "companyType": punctuated, "address": punctuated, "businessScope": lambda c: F.translate(F.regexp_replace(c, r"\s+", ""), ";", "；")}.get(field, lambda c: c)

    def result(r: Column, name: Column, clean: Column) -> Column:
        value = F.substring(shape(clean), 1, CAPS[field]) if field in CAPS else shape(clean)
        return F.struct(text.miss_as_null(r).alias("raw"), text.miss_as_null(value).alias("value"), (clean != name).alias("cleaned"))

    def named(r: Column) -> Column:
        if field != "legalRepresentative":
            return let(artless(r), lambda clean: result(r, r, clean))
        name = F.coalesce(text.miss_as_null(F.regexp_extract(r, f"^[{HAN}·]{{2,4}}", 0)), r)
        return let(name, lambda x: let(artless(x), lambda clean: result(r, x, clean)))

    return let(raw, named)


def capital_score(reading: Column) -> Column:
    """How well a reading of a capital parses: as numerals, else as an amount in 万 or 亿: fixed values."""
    core = text.full_trim(F.regexp_replace(reading, "(元|圆|圓|人民币|RMB|CNY).*$", ""))
    return F.when(license.numerals_to_yuan(core) > 0, 0.92).when(license.capital(reading).rlike("万元|亿元"), 0.45).otherwise(0.1)


def result(field: str, raw: Column, value: Column, score: Column, pattern: Column, doubtful: Column, **more: Column) -> Column:
    """A RESULT; what isn't given is empty or false."""
    none = {"candidate": F.lit(None), "corrections": F.array().cast(confusions.EDITS), "checksum_valid": F.lit(None), "cleaned": F.lit(False), "rebuilt": F.lit(False), "signals": F.array().cast("array<string>")} | more
    return F.struct(F.lit(field), raw, value, none["candidate"], none["corrections"], score, pattern, none["checksum_valid"], none["cleaned"], none["rebuilt"], doubtful, none["signals"]).cast(RESULT)


def validated(field: str, n: Column, v: Column, value: Column, **more: Column) -> Column:
    return result(field, n["raw"], value, v["score"], v["valid"], v["review"], cleaned=n["cleaned"], **({"signals": v["signals"]} | more))


def process(field: str, segment: Column, code: Column) -> Column:
    """RESULT of one field; code is the document's best credit code (license.best_code_of)."""
    if field in ("creditCode", "registeredCapital", "establishmentDate", "businessTerm"):
        return let(text.miss_as_null(text.full_trim(F.coalesce(segment, F.lit("")))), lambda raw: unnamed(field, raw, code))

    def checked(n: Column) -> Column:
        if field == "registrationAuthority":
            return let(n["value"], lambda x: plain(field, n["raw"], x, x.isNotNull(), pattern=F.lit(False), cleaned=n["cleaned"]))
        if field == "companyType":
            best = confusions.best_reading(F.coalesce(n["value"], F.lit("")), lambda c: license_checks.checked(field, c)["score"])
            return let(best, lambda b: let(license_checks.checked(field, b["text"]), lambda w: validated(field, n, w, text.miss_as_null(b["text"]), corrections=b["edits"])))
        v = license_checks.checked(field, n["value"])
        if field == "legalRepresentative":
            best = confusions.best_reading(F.coalesce(n["value"], F.lit("")), lambda c: license_checks.checked(field, c)["score"])
            return let(best, lambda b: let(v, lambda w: validated(field, n, w, n["value"], **offered(field, n["value"], b, w))))
        return let(v, lambda w: validated(field, n, w, n["value"]))

    return let(normalise(field, segment), checked)


def unnamed(field: str, raw: Column, code: Column) -> Column:
    """RESULT of a field that isn't normalised as text: the code, the capital, the date and the term."""
    if field == "creditCode":
        valid = F.coalesce(code["valid"], F.lit(False))
        return result(field, raw, code["code"], F.when(valid, 1.0).otherwise(0.2), valid, ~valid, checksum_valid=valid, rebuilt=F.coalesce(code["rebuilt"], F.lit(False)))
    if field == "registeredCapital":
        best = confusions.best_reading(F.coalesce(raw, F.lit("")), capital_score)
        return let(best, lambda b: let(license.capital(b["text"]), lambda v: plain(field, raw, v, v.isNotNull(), corrections=b["edits"])))
    if field == "establishmentDate":
        day = F.coalesce(text.miss_as_null(F.regexp_extract(raw, r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日?|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}", 0)), raw)
        return let(text.cn_date_normalise(day), lambda v: plain(field, raw, v, F.coalesce(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^long-term$"), F.lit(False))))
    return let(license.business_term(raw), lambda v: plain(field, raw, v, v.isNotNull()))


def offered(field: str, value: Column, best: Column, own: Column) -> dict[str, Column]:
    """A better reading of a value that is kept: candidate, its edits, and a signal if only the candidate is valid."""
    differs = best["n"] > 0  # only then, and only for a value that isn't valid, the other reading is validated
    better = differs & ~own["valid"] & license_checks.checked(field, best["text"])["valid"]
    return {
        "candidate": F.when(differs, best["text"]),
        "corrections": best["edits"],
        "signals": F.when(better, F.array_append(own["signals"], F.lit("candidate_available"))).otherwise(own["signals"]),
    }


def plain(field: str, raw: Column, value: Column, good: Column, pattern: Column | None = None, **more: Column) -> Column:
    """RESULT of a field that is good or not."""
    high, low = PLAIN[field]
    return result(field, raw, value, F.when(good, high).otherwise(low), good if pattern is None else pattern, ~good, **more)


def confidence() -> Column:
    """Additive score of a row of the long table, clamped to .05-.99, three decimals: fixed weights."""
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    ocr = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ocr_confidence") / 100))
    score = ocr * 0.28 + F.col("validation_score") * 0.35 + 0.2
    for holds, weight in (
        (F.col("bounded"), 0.1),
        (F.col("label_found"), 0.05),
        (F.coalesce("checksum_valid", F.lit(False)), 0.15),
        (F.col("pattern_valid"), 0.06),
        (F.col("fuzzy"), -0.06),
        (F.col("fuzzy"), -0.08),  # a label that had to be guessed also tells of a bad scan
        (F.col("rebuilt"), -0.05),
        (F.col("fallback"), -0.07),
        (F.col("uncommon"), -0.1),
        (F.col("cleaned"), -0.04),
        (~F.col("label_found") & ~F.col("fallback"), -0.12),
        (ocr < 0.75, -0.08),
    ):
        score = score + flag(holds, weight)
    score = score - F.least(F.lit(0.22), F.size("corrections") * 0.04)
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), score)) + 1e-9, 3)  # halves go up, whatever the last bit


def results(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text, keep) -> (doc_id, keep, parts, found): segments, and an array of RESULT, one a field; no shuffle.

    A null or empty text has ten results without values.
    """
    rows = license.with_codes(docs.select("doc_id", *keep, text.norm_cjk_ocr(F.coalesce("text", F.lit(""))).alias("text")))
    rows = rows.withColumn("code", license.best_code_of(F.col("code_candidates")))
    return rows.select("doc_id", *keep, "parts", F.array(*[process(f, license.part(f)["segment"], F.col("code")) for f in LABELS]).alias("found"))


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """First pages (doc_id, page, style, ocr_confidence, text, keep) -> the long table, ten rows a document.

    doc_id, style, ocr_confidence, keep, field, next_label, raw_segment, raw, value, candidate, corrections, signals, validation_score,
    pattern_valid, checksum_valid, label_found, bounded, fuzzy, fallback, rebuilt, cleaned, uncommon, confidence, requires_review.
    """
    keys = ["style", "ocr_confidence", *keep]
    rows = results(pages.where(F.col("page") == 1), *keys)
    own = lambda x: F.get(F.filter("parts", lambda p: p["field"] == x["field"]), 0)
    rows = rows.select("doc_id", *keys, F.transform("found", lambda x: F.struct(own(x).alias("part"), x.alias("found"))).alias("every"))
    rows = license.rows_of(rows, "every", "found", ["doc_id", *keys])
    rows = rows.select("doc_id", *keys, "found.*", F.col("part.next_label").alias("next_label"), F.col("part.segment").alias("raw_segment"), *[F.coalesce(f"part.{c}", F.lit(False)).alias(c) for c in ("bounded", "fuzzy", "fallback")], (F.col("part").isNotNull() & ~F.coalesce("part.fallback", F.lit(False))).alias("label_found"))
    rows = rows.withColumn("uncommon", F.coalesce(F.col("value").rlike(f"{MARKS}|{COMMON}"), F.lit(False))).withColumn("confidence", confidence())
    review = F.col("doubtful") | (F.col("confidence") < REVIEW_BELOW) | ~F.coalesce("checksum_valid", F.lit(True))
    return rows.withColumn("requires_review", review).drop("doubtful")


def corrections_text(corrections: Column) -> Column:
    """'2:a>b;...' of an edit log."""
    return F.array_join(F.transform(corrections, lambda e: F.concat(e["index"].cast("string"), F.lit(":"), e["from"], F.lit(">"), e["to"])), ";")
