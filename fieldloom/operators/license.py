"""Business-licence extraction over a table of OCR pages (doc_id, page, text, ...).

Label spans are found exactly (blanks allowed between characters) or, for labels that are missing, by edit distance around
intact two-character pieces; segments run from label to label; license_fields cleans, checks and scores each field.  All of it
happens inside a document's row, as arrays: no text is shuffled, and rows are exploded once, into fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import codes, text
from fieldloom.sources.synth import LABELS

KEY_FIELDS = ("companyName", "creditCode", "legalRepresentative")
MOST_CORRECTIONS = 3
#: Detection signals with their weights, and what marks an identity card: fixed values.
SIGNALS = {
    r"营业\s*执照": 0.35,
    r"统一\s*社会\s*信用\s*代码": 0.3,
    r"法定\s*代表\s*人": 0.2,
    r"注册\s*资本": 0.15,
    r"登记\s*机关": 0.1,
    r"经营\s*范围": 0.1,
}
ID_SIGNALS = ("居民身份", "公民身份", "身份号码", "身份证号", "身份证号码", "姓名", "签发")
SPAN = "struct<field:string,label:string,start:int,end:int,fuzzy:boolean,matched:string,score:double>"
SEGMENT = "struct<field:string,label:string,fuzzy:boolean,next_label:string,segment:string,bounded:boolean,fallback:boolean>"


def loose(label: str) -> str:
    return r"\s*".join(label)


def let(value: Column, f) -> Column:
    """f(value) with value worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def fuzzy_span(t: str, label: str) -> str:
    """SQL of the best window (score, first, fit, matched) for a misread label of four characters or more, else null; t is a column's name.

    Two edits leave a two-character piece intact in labels of six or more, one edit in shorter ones.  The text is cut in front of
    each such piece; windows start around where the label would start, and are as many characters shorter or longer as there may be edits.
    """
    n = len(label)
    if n < 4:
        return "CAST(NULL AS struct<score:double,first:int,fit:int,matched:string>)"
    pieces, characters = "|".join(label[i : i + 2] for i in range(n - 1)), ", ".join(f"'{c}'" for c in label)
    around = "array(-2, -1, 0, 1, 2)" if n >= 6 else "array(-1, 0, 1)"
    hits = f"""array_distinct(aggregate(split({t}, '(?={pieces})'), named_struct('at', 1, 'starts', CAST(array() AS array<int>)),
      (acc, part) -> named_struct('at', acc.at + length(part), 'starts', concat(acc.starts, transform(filter(array(CASE WHEN length(part) > 1 THEN instr('{label}', substring(part, 1, 2)) ELSE 0 END), o -> o > 0), o -> acc.at - o + 1))),
      acc -> acc.starts))"""
    starts = f"filter(array_distinct(flatten(transform({hits}, h -> transform({around}, j -> h + j)))), s -> s > 0)"
    windows = f"flatten(transform({starts}, s -> transform({around}, j -> named_struct('s', s, 'j', j, 'w', substring({t}, s, {n} + j)))))"
    whole = f"filter({windows}, v -> length(v.w) = {n} + v.j AND NOT contains(v.w, '\\n'))"
    good = f"filter(transform({whole}, v -> named_struct('v', v, 'd', levenshtein(v.w, '{label}', 2))), m -> m.d BETWEEN 0 AND {2 if n >= 6 else 1})"
    score = f"round(0.6D * (1 - m.d / {n}) + 0.4D * size(array_intersect(split(m.v.w, ''), array({characters}))) / {n}, 6)"
    return f"array_max(transform({good}, m -> named_struct('score', {score}, 'first', -m.v.s, 'fit', -abs(m.v.j), 'matched', m.v.w)))"


def spans_of(t: str) -> Column:
    """Array of at most one span a label (SPAN; 1-based, end exclusive): exact ones, and fuzzy ones of labels that are missing.

    t is the name of a column of text.  Each label has an expression of its own, so that its pattern is a literal and is compiled
    once; as SQL text it is also parsed at once, where columns would be built call by call.
    """

    def one(field: str, label: str) -> str:
        span = lambda start, matched, fuzzy, score: f"named_struct('field', '{field}', 'label', '{label}', 'start', {start}, 'end', {start} + length({matched}), 'fuzzy', {fuzzy}, 'matched', {matched}, 'score', {score})"
        exact = f"get(transform(array(regexp_extract({t}, r'{loose(label)}', 0)), e -> {span('at', 'e', 'false', '1.0D')}), 0)"
        missing = f"get(transform(array({fuzzy_span(t, label)}), b -> CASE WHEN b IS NOT NULL THEN {span('-b.first', 'b.matched', 'true', 'b.score')} END), 0)"
        return f"get(transform(array(regexp_instr({t}, r'{loose(label)}')), at -> CASE WHEN at > 0 THEN {exact} ELSE {missing} END), 0)"

    return F.expr(f"array_compact(array({', '.join(one(f, x) for f, x in LABELS.items())}))").cast(f"array<{SPAN}>")


def deduped(spans: Column) -> Column:
    """Of overlapping spans the longer label stays, then the exact one, then the earlier one."""
    rank = lambda s: F.struct(-F.length(s["label"]), s["fuzzy"], s["start"], s["label"])
    beats = lambda b, a: (a["start"] < b["end"]) & (b["start"] < a["end"]) & (rank(b) < rank(a))
    return F.filter(spans, lambda a: ~F.exists(spans, lambda b: beats(b, a)))


def trim_segment(c: Column) -> Column:
    """Without the white space and punctuation at both ends."""
    marks = r"[\s:：,，.。;；|/\\\-–—]+"
    return text.miss_as_null(F.regexp_replace(c, f"^{marks}|{marks}$", ""))


def segments_of(t: Column, spans: Column) -> Column:
    """Array of segments (SEGMENT): trimmed text from a label's end to the next label's start.

    bounded says whether another label follows.  If the scope's label is lost, its block in front of 登记机关 stands in (fallback).
    """
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x.alias("span"))))

    def one(x: Column, after: Column) -> Column:
        until, end = F.coalesce(after["start"], F.length(t) + 1), x["span"]["end"]
        cut = trim_segment(F.substring(t, end, F.greatest(until - end, F.lit(0))))
        return F.struct(x["span"]["field"], x["span"]["label"], x["span"]["fuzzy"], after["span"]["label"], cut, after.isNotNull(), F.lit(False)).cast(SEGMENT)

    # sorted once: inside the lambda the sort would be repeated for each span and each use
    cuts = let(order, lambda o: F.transform(o, lambda x, i: let(F.get(o, i + 1), lambda after: one(x, after))))
    lost = let(scope_block(t, spans), lambda block: F.when(block.isNotNull(), F.struct(F.lit("businessScope"), F.lit(LABELS["businessScope"]), F.lit(False), F.lit(LABELS["registrationAuthority"]), block, F.lit(True), F.lit(True)).cast(SEGMENT)))
    return F.concat(cuts, F.array_compact(F.array(lost)))


def scope_block(t: Column, spans: Column) -> Column:
    """The business scope of a text without a span for its label, else null.

    Interval logic over the spans: between the latest end of 住所 and 类型 and the start of 登记机关 lies a chunk; what follows a
    broken label in it is the scope; without one, what follows 营业期限.
    """
    place = lambda field: F.get(F.filter(spans, lambda x: x["field"] == field), 0)
    begin = F.array_max(F.transform(F.filter(spans, lambda x: x["field"].isin("address", "companyType")), lambda x: x["end"]))
    broken, until = r"经\s*营\s*[·.\s]*范\s*围", place("registrationAuthority")["start"]
    chunk = lambda start: F.substring(t, start, F.greatest(until - start, F.lit(0)))

    def scope(c: Column) -> Column:
        at = F.regexp_instr(c, F.lit(broken))
        after = F.substring(c, at + F.length(F.regexp_extract(c, broken, 0)), F.length(c))
        term_end = place("businessTerm")["end"]
        return F.when(at > 0, after).when(term_end.isNotNull(), F.regexp_replace(chunk(term_end), broken, "")).otherwise(c)

    lost = until.isNotNull() & place("businessScope").isNull()
    return F.when(lost, trim_segment(let(chunk(F.coalesce(begin, F.lit(1))), scope)))


def codes_of(segment: Column, t: Column) -> Column:
    """Array of (source, code, valid, rebuilt): distinct 18-character codes from the code segment and the whole text, look-alikes folded.

    rebuilt marks those that appear only when separators inside are dropped.
    """
    every = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(text.norm_code_confusions(c), F.lit("")), F.lit("[0-9A-Z]{18}"), F.lit(0)))

    def found(source: str, c: Column) -> Column:
        entry = lambda rebuilt: lambda x: F.struct(F.lit(source).alias("source"), x.alias("code"), codes.credit_code_problem(x).isNull().alias("valid"), F.lit(rebuilt).alias("rebuilt"))
        joined = every(F.regexp_replace(c, r"[·#!_:.-]", ""))
        return let(every(c), lambda plain: F.concat(F.transform(plain, entry(False)), F.transform(F.array_except(joined, plain), entry(True))))

    return F.concat(found("segment", segment), found("text", t))


def best_code_of(candidates: Column) -> Column:
    """The one of an array of candidates: valid before invalid, segment before text, more digits, then the code itself."""
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.array_min(F.transform(candidates, lambda x: F.struct((~x["valid"]).alias("a"), (x["source"] != "segment").alias("b"), (-digits(x["code"])).alias("c"), x["code"].alias("code"), x["source"].alias("source"), x["valid"].alias("valid"), x["rebuilt"].alias("rebuilt"))))


def rows_of(df: DataFrame, column: str, given: str, keys: list[str] = ["doc_id"]) -> DataFrame:
    """A row for each struct of an array; `given` is a field that is never null in one.

    The outer form, as for the inner one the optimizer puts a copy of the array's expression into a filter below.
    """
    return df.select(*keys, F.inline_outer(column)).where(F.col(given).isNotNull())


def label_spans(docs: DataFrame, dedupe: bool = False) -> DataFrame:
    """(doc_id, text) -> (doc_id, field, label, start, end, fuzzy, matched, score): a row for each span; no shuffle."""
    rows = docs.select("doc_id", spans_of("text").alias("s"))
    return rows_of(rows.withColumn("s", deduped(F.col("s"))) if dedupe else rows, "s", "label")


def with_segments(docs: DataFrame) -> DataFrame:
    """docs with parts, the segments of their deduplicated spans."""
    return docs.withColumn("spans", spans_of("text")).withColumn("spans", deduped(F.col("spans"))).withColumn("parts", segments_of(F.col("text"), F.col("spans"))).drop("spans")


def part(field: str) -> Column:
    return F.get(F.filter("parts", lambda x: x["field"] == field), 0)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, field, label, fuzzy, next_label, segment, bounded, fallback)."""
    return rows_of(with_segments(docs), "parts", "label")


def with_codes(docs: DataFrame) -> DataFrame:
    """docs with parts and code_candidates."""
    return with_segments(docs).withColumn("code_candidates", codes_of(part("creditCode")["segment"], F.col("text")))


def code_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, code, valid, rebuilt)."""
    return rows_of(with_codes(docs), "code_candidates", "code")


def best_code(docs: DataFrame) -> DataFrame:
    """(doc_id, source, code, valid) of the documents that have a candidate."""
    best = with_codes(docs).select("doc_id", F.array(best_code_of(F.col("code_candidates"))).alias("b"))
    return rows_of(best, "b", "code").select("doc_id", "source", "code", "valid")


DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "两": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
NUMERALS = "零〇壹贰叁肆伍陆柒捌玖拾佰仟万亿萬億两一二三四五六七八九十百千"


def numerals_to_yuan(c: Column) -> Column:
    """Chinese numerals with 万 and 亿 to a number; null if another character is among them."""
    table = lambda values: F.expr(f"map({', '.join(f'{k!r}, {v}' for k, v in values.items())})").cast("map<string,decimal(20,0)>")
    digit, unit = table(DIGITS), table(UNITS)
    zero = F.lit(0).cast("decimal(20,0)")
    money = lambda x: x.cast("decimal(20,0)")

    def step(s: Column, ch: Column) -> Column:
        def read(x: Column) -> Column:
            d, u = x["digit"], x["unit"]
            scale = F.when(ch.isin("万", "萬"), 10_000).when(ch.isin("亿", "億"), 100_000_000)
            section = F.when(u.isNotNull(), s["section"] + F.when(s["num"] == 0, 1).otherwise(s["num"]) * u).when(d.isNotNull(), s["section"]).otherwise(zero)
            total = F.when(scale.isNotNull(), s["total"] + (s["section"] + s["num"]) * scale).otherwise(s["total"])
            return F.struct(money(total).alias("total"), money(section).alias("section"), money(F.coalesce(d, zero)).alias("num"))

        return let(F.struct(F.try_element_at(digit, ch).alias("digit"), F.try_element_at(unit, ch).alias("unit")), read)

    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("num"))
    value = lambda v: F.aggregate(F.split(v, ""), start, step, lambda s: money(s["total"] + s["section"] + s["num"]))
    return let(c, lambda v: F.when(v.rlike(f"^[{NUMERALS}]+$"), value(v)))


def capital(c: Column) -> Column:
    """Capital text to its display string: arabic or Chinese amount with unit; a bare year is null."""
    arabic = r"^([0-9,.]+)\s*(万|亿)?"
    big, ten = F.lit(100_000_000), F.lit(10_000)

    def show(v: Column) -> Column:
        amount, unit = F.replace(F.regexp_extract(v, arabic, 1), F.lit(","), F.lit("")), F.regexp_extract(v, arabic, 2)
        plain = F.when(unit != "", F.concat(amount, unit, F.lit("元人民币"))).when(v.rlike("元"), F.concat(amount, F.lit("元人民币"))).otherwise(amount)
        core = F.regexp_extract(F.regexp_replace(v, "(元|圆|圓|人民币|RMB|CNY).*$", ""), f"^[{NUMERALS}]+", 0)
        shown = lambda yuan: F.when(yuan % big == 0, F.concat((yuan / big).cast("long"), F.lit("亿"))).when(yuan >= ten, F.concat(F.round(yuan / ten).cast("long"), F.lit("万"))).otherwise(yuan.cast("string"))
        read = let(numerals_to_yuan(core), lambda yuan: F.when(yuan > 0, F.concat(shown(yuan), F.lit("元人民币"))).otherwise(v))
        return F.when(v == "", None).when(v.rlike(r"^[0-9]{4}\s*年") & ~v.rlike("[万亿萬元圆圓]"), None).when(v.rlike(arabic), plain).otherwise(read)

    return let(text.full_trim(c), show)


def business_term(c: Column) -> Column:
    """长期, else the range of days in c, else c."""
    day = r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日"
    span = lambda v: text.miss_as_null(F.regexp_extract(v, rf"{day}\s*[至到—-]\s*{day}", 0))
    return let(c, lambda v: F.when(v.contains("长期"), "长期").otherwise(F.coalesce(F.regexp_replace(span(v), r"\s+", ""), text.miss_as_null(text.full_trim(v)))))


def review_queue(fields: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, n_values, credit_valid, reasons, requires_manual_review) from the long table of license_fields.extract.

    One aggregation by document; `more` names columns that a document's rows share.
    """
    value = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    per = fields.groupBy("doc_id", *more).agg(
        *[value(f, "value").alias(f) for f in KEY_FIELDS],
        F.count("value").alias("n_values"),
        value("creditCode", "checksum_valid").alias("credit_valid"),
        value("businessScope", "confidence").alias("scope"),
        F.bool_or("requires_review").alias("any_review"),
        F.sum(F.size("corrections")).alias("corrected"),
        F.max("ocr_confidence").alias("ocr"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("ocr") < 75, F.concat(F.lit("ocr_confidence_below_75:"), F.regexp_replace(F.col("ocr").cast("string"), r"\.0$", ""))),
            F.when(~F.col("credit_valid"), "credit_checksum_failed"),
            F.when(F.col("corrected") > MOST_CORRECTIONS, F.concat(F.lit("ocr_corrections_exceeded:"), F.col("corrected").cast("string"))),
            *[F.when(F.col(f).isNull(), f"missing_key_field:{f}") for f in KEY_FIELDS],
            F.when(F.col("scope") < 0.7, "business_scope_low_confidence"),
            F.when(F.col("any_review"), "field_requires_review"),
        )
    )
    return per.select("doc_id", *more, "n_values", "credit_valid", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("requires_manual_review"))


def capital_parse(shown: Column) -> Column:
    """A display string's (amount, unit, currency), null where it isn't one."""
    form = r"^([0-9,.]+)\s*(万|亿)?\s*元人民币?"
    amount = F.replace(F.regexp_extract(shown, form, 1), F.lit(","), F.lit("")).try_cast("double")
    return F.when(shown.rlike(form) & amount.isNotNull(), F.struct(amount.alias("amount"), text.miss_as_null(F.regexp_extract(shown, form, 2)).alias("unit"), F.lit("CNY").alias("currency")))


def validate_documents(fields: DataFrame) -> DataFrame:
    """(doc_id, required_present, credit_valid, valid, established, capital): parsed date and capital are null where they don't parse."""
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    per = fields.groupBy("doc_id").agg(*[value(f).alias(f) for f in (*KEY_FIELDS, "establishmentDate", "registeredCapital")], F.bool_or("checksum_valid").alias("credit_valid"))
    present = F.lit(True)
    for f in KEY_FIELDS:
        present = present & F.col(f).isNotNull()
    return per.select(
        "doc_id",
        present.alias("required_present"),
        "credit_valid",
        (present & F.col("credit_valid")).alias("valid"),
        F.try_to_date("establishmentDate", "yyyy-MM-dd").alias("established"),
        capital_parse(F.col("registeredCapital")).alias("capital"),
    )


def is_id_card(t: Column) -> Column:
    hits = sum((t.rlike(p).cast("int") for p in ID_SIGNALS), F.lit(0))
    number = F.regexp_replace(t, r"\s", "").rlike("[0-9]{15,18}")
    return (hits >= 2) | (number & t.rlike("身份|有效期|签发"))


def id_name(t: Column) -> Column:
    """Holder's name from an identity-card page, else null."""
    forms = (r"姓\s*名\s*[:：]?\s*([一-鿿]{2,4})", r"([一-鿿]{2,4})\s+性\s*别")
    return F.when(is_id_card(t), F.coalesce(*[text.miss_as_null(F.regexp_extract(t, p, 1)) for p in forms]))


def verify_representative(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, representative, id_name, verified): page 1's name against the first identity card on later pages: match, mismatch or unknown."""
    cards = pages.where(F.col("page") > 1).withColumn("name", id_name(text.norm_cjk_ocr(F.col("text")))).where(F.col("name").isNotNull())
    cards = cards.groupBy("doc_id").agg(F.min_by("name", "page").alias("id_name"))
    rep = fields.where(F.col("field") == "legalRepresentative").select("doc_id", F.col("value").alias("representative"))
    clean = lambda c: F.regexp_replace(c, r"[\s·•．.]", "")
    a, b = clean(F.col("representative")), clean(F.col("id_name"))
    return rep.join(cards, "doc_id", "left").select("doc_id", "representative", "id_name", F.when(F.col("id_name").isNull() | F.col("representative").isNull(), "unknown").when(a.contains(b) | b.contains(a), "match").otherwise("mismatch").alias("verified"))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, confidence, detected, matched) for every text: matched lists the signals in order, a bare code last."""
    docs = docs.select("doc_id", text.norm_cjk_ocr(F.col("text")).alias("t"))
    has_code = F.regexp_replace("t", r"\s", "").rlike("[0-9A-Z]{18}")
    shown = F.array(*[F.struct(F.lit(p.replace(r"\s*", "")).alias("label"), F.lit(w).alias("w"), F.col("t").rlike(p).alias("there")) for p, w in SIGNALS.items()])
    docs = docs.select("doc_id", F.filter(shown, lambda x: x["there"]).alias("hits"), has_code.alias("code"))
    score = F.aggregate("hits", F.when(F.col("code"), 0.08).otherwise(0.0), lambda a, x: a + x["w"])
    labels = F.transform("hits", lambda x: x["label"])
    matched = F.when(F.col("code") & ~F.array_contains(labels, "统一社会信用代码"), F.array_append(labels, F.lit("18-char code pattern"))).otherwise(labels)
    return docs.select("doc_id", F.round(F.least(score, F.lit(0.99)), 3).alias("confidence"), (F.round(score, 6) >= 0.45).alias("detected"), matched.alias("matched"))
