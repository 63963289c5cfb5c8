"""Further queries: confusions, cross-checks, letters in prose, sinks and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import confusions, detect, evaluate, letters, license_checks, license_fields, mrz, names, passes, passport, routing, visa
from fieldloom.plans import document_queries as dq
from fieldloom.plans import license_queries as lq
from fieldloom.plans.registry import registry
from fieldloom.sources import synth, tables

QUERIES, SQL, query = registry()

scratch = tables.scratch
_T = lq.TRUTH


@query(f"WITH {_T} SELECT doc_id, CASE WHEN s = 'h' THEN replace(\"companyName\", '有限', '有很') ELSE \"companyName\" END AS raw, \"companyName\" AS best, CASE WHEN s = 'h' THEN 1 ELSE 0 END AS edits FROM truth")
def lic_confusion_variants(spark, sf):
    rows = lq.truth(spark, sf).select("doc_id", F.when(F.substring("style", -1, 1) == "h", F.replace(F.col("companyName"), F.lit("有限"), F.lit("有很"))).otherwise(F.col("companyName")).alias("raw"))
    ranked = confusions.best(confusions.variants(rows), confusions.company_score(F.col("variant")))
    return ranked.select("doc_id", "raw", F.col("variant").alias("best"), "edits")


_SPOILED = f"WITH {_T}, v AS (SELECT doc_id, doc_id % 7 AS r, s FROM truth)"


@query(
    f"""{_SPOILED} SELECT doc_id, 'companyName' AS field, CASE WHEN r = 1 THEN 0.9 WHEN s = 'h' THEN 0.55 ELSE 1.0 END AS score, r <> 1 AND s <> 'h' AS valid, r = 1 OR s = 'h' AS review, CASE WHEN r = 1 THEN 'valid_suffix,reasonable_length,contains_latin' WHEN s = 'h' THEN 'reasonable_length' ELSE 'valid_suffix,reasonable_length' END AS signals FROM v WHERE r <> 1 OR s <> 'h'
UNION ALL SELECT doc_id, 'companyName', 0.45, false, true, 'reasonable_length,contains_latin' FROM v WHERE r = 1 AND s = 'h'
UNION ALL SELECT doc_id, 'legalRepresentative', CASE WHEN r = 2 THEN 0.3 ELSE 1.0 END, r <> 2, r = 2, CASE WHEN r = 2 THEN 'contains_symbols' ELSE 'chinese_name' END FROM v
UNION ALL SELECT doc_id, 'companyType', CASE WHEN r = 3 THEN 0.35 ELSE 1.0 END, r <> 3, r = 3, CASE WHEN r = 3 THEN '' ELSE 'template,company_keyword' END FROM v
UNION ALL SELECT doc_id, 'address', CASE WHEN s = 'g' THEN 0.0 WHEN r = 4 THEN 0.8 ELSE 1.0 END, s <> 'g' AND r <> 4, s = 'g' OR r = 4, CASE WHEN s = 'g' THEN '' WHEN r = 4 THEN 'has_chinese,ocr_garbage,admin_markers' ELSE 'has_chinese,allowed_charset,admin_markers' END FROM v
UNION ALL SELECT doc_id, 'businessScope', CASE WHEN r = 5 THEN 0.8 ELSE 1.0 END, r <> 5, r = 5, CASE WHEN r = 5 THEN 'has_chinese' ELSE 'has_chinese,reasonable_length' END FROM v"""
)
def lic_field_validate(spark, sf):
    """Five fields of every licence; beside the styles' damage one field of most licences is spoiled: a letter in the name, a mark in
    the holder's name or the address, a type or scope cut short."""
    r, style = F.col("doc_id") % 7, F.substring("style", -1, 1)
    name = F.concat(F.when(r == 1, "A").otherwise(""), F.when(style == "h", F.replace(F.col("companyName"), F.lit("有限"), F.lit("有很"))).otherwise(F.col("companyName")))
    values = {
        "companyName": name,
        "legalRepresentative": F.concat(F.col("legalRepresentative"), F.when(r == 2, "#").otherwise("")),
        "companyType": F.when(r == 3, F.lit("有限责任")).otherwise(F.col("companyType")),
        "address": F.when(style != "g", F.concat(F.col("address"), F.when(r == 4, "~").otherwise(""))),
        "businessScope": F.substring(F.col("businessScope"), F.lit(1), F.when(r == 5, 2).otherwise(99)),
    }
    rows = lq.truth(spark, sf).select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()])).alias("x")).select("doc_id", "x.*")
    return license_checks.validate(rows).select("doc_id", "field", "score", "valid", "review", "signals")


@query(
    f"""WITH {_T} SELECT doc_id, unnest(['companyName', 'legalRepresentative', 'companyType', 'address', 'businessScope', 'registrationAuthority']) AS field,
  unnest(["companyName", "legalRepresentative", "companyType", address || '：1，2', "businessScope" || '；甲', "registrationAuthority"]) AS value, unnest([doc_id % 3 = 0, false, doc_id % 3 = 1, doc_id % 3 = 2, true, doc_id % 2 = 0]) AS cleaned FROM truth"""
)
def lic_field_normalise(spark, sf):
    """Segments with marks, blanks, half-width punctuation, Latin ends and the next label run in, cleaned as their fields ask for."""
    k, col = F.col("doc_id"), F.col
    some = lambda when, what: F.when(when, what).otherwise("")
    segments = {
        "companyName": F.concat(F.lit(" "), F.substring("companyName", 1, 3), some(k % 3 == 0, "#|"), F.lit(" "), F.substring("companyName", 4, 80)),
        "legalRepresentative": F.concat("legalRepresentative", some(k % 2 == 0, " 住所广州市"), some(k % 2 == 1, "注册资本9万")),
        "companyType": F.concat("companyType", some(k % 3 == 1, " xy"), F.lit("\n成立日期2001年")),
        "address": F.concat("address", F.lit(":1 ,2"), some(k % 3 == 2, "~!"), F.lit("经营范围零售")),
        "businessScope": F.concat("businessScope", F.lit(" ;\n甲%登记机关 x")),
        "registrationAuthority": F.concat(F.lit("\n"), "registrationAuthority", some(k % 2 == 0, "AB")),
    }
    found = [F.struct(F.lit(f).alias("field"), license_fields.normalise(f, c).alias("n")) for f, c in segments.items()]
    rows = lq.truth(spark, sf).select("doc_id", F.explode(F.array(*found)).alias("x"))
    return rows.select("doc_id", "x.field", col("x.n.value").alias("value"), col("x.n.cleaned").alias("cleaned"))


@query(f"WITH {_T} SELECT doc_id, round(0.22 + 0.14 * CASE WHEN s = 'd' THEN 3 ELSE 4 END + 0.14 + CASE WHEN p = 1 THEN 0 ELSE 0.08 END, 6) AS keyword_score FROM truth")
def lic_keyword_score(spark, sf):
    score, _ = passes.keyword_score(F.col("text"))
    return lq.pages(spark, sf).where(F.col("page") == 1).select("doc_id", score.alias("keyword_score"))


@query(f"WITH {_T} SELECT doc_id, round(least(0.99, ocr_confidence / 100 * 0.35 + (0.22 + 0.14 * CASE WHEN s = 'd' THEN 3 ELSE 4 END + 0.14 + CASE WHEN p = 1 THEN 0 ELSE 0.08 END) * 0.55 + 0.05 + 0.05), 6) AS score FROM truth")
def lic_pass_score(spark, sf):
    score, _ = passes.keyword_score(F.col("text"))
    total = F.least(F.lit(1.0), F.col("ocr_confidence") / 100) * 0.35 + score * 0.55 + 0.05 + F.when(F.length("text") > 80, 0.05).otherwise(0.0)
    return lq.pages(spark, sf).where(F.col("page") == 1).select("doc_id", F.round(F.least(F.lit(0.99), total), 6).alias("score"))


_X = "regexp_replace(x, '\\s', '', 'g')"
_COMPACT = "regexp_replace(upper(text), '\\s', '', 'g')"
_SIGNALS = " + ".join(f"CAST(regexp_matches(upper(text), '{'|'.join(g)}') AS INT)" for g in detect.SIGNALS)
_ZONE_SCORE = f"""coalesce(list_sum(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: CASE WHEN length({_X}) >= 28 AND (contains({_X}, '<<') OR starts_with(upper({_X}), 'V<')) THEN 12 ELSE 0 END
  + CASE WHEN regexp_full_match(upper({_X}), '[A-Z0-9<]{{28,}}') AND regexp_matches({_X}, '[0-9]{{6}}') THEN 12 ELSE 0 END)), 0)
  + CASE WHEN regexp_matches({_COMPACT}, 'V<[A-Z]{{3}}') THEN 40 ELSE 0 END + CASE WHEN NOT contains({_COMPACT}, 'P<') AND regexp_matches({_COMPACT}, '[A-Z]{{3}}[A-Z]{{2,}}<<') THEN 25 ELSE 0 END"""


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, n_chars FROM documents), s AS (SELECT doc_id, least(100, {_ZONE_SCORE}) AS zone, greatest({dq._LITERALS}, {dq._GROUP_COUNTS}) AS labels, n_chars % 101 AS conf,
  {_SIGNALS} + CAST(regexp_matches(upper(text), '\\b[A-Z0-9]{{6,12}}\\b') AND regexp_matches(upper(text), '\\bVISA\\b') AS INT) AS signals,
  CASE WHEN regexp_matches(upper(text), '\\bVISA\\b') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(upper(text), '\\b(?:SURNAME|NATIONALITY|PASSPORT|CONTROL|GRANT)\\b') THEN 10 ELSE 0 END AS bonus FROM d)
SELECT doc_id, round(CAST(zone AS DOUBLE) * 0.35 + labels * 10 + CAST(conf AS DOUBLE) / 100 * 25 + signals * 8 + bonus, 6) AS score FROM s"""
)
def pass_score(spark, sf):
    """Composite pass score of every document's text, its length standing in for the engine's confidence."""
    d = dq.docs(spark, sf)
    return d.select("doc_id", passes.score(F.coalesce("text", F.lit("")), (F.col("n_chars") % 101).cast("double")).alias("score"))


@query(f"WITH {dq._ZONE} SELECT k AS doc_id, true AS first_found, true AS second_found, k % 4 <> 1 AS in_one_line FROM z")
def mrz_candidates(spark, sf):
    """In every fourth document the second line is broken in two: only the joined lines hold it whole."""
    z = dq.zones(spark, sf)
    broken = F.concat_ws("\n", "line1", F.substring("line2", 1, 21), F.substring("line2", 22, 23))
    pages = z.select("doc_id", F.when(F.col("doc_id") % 4 == 1, broken).otherwise(F.col("text")).alias("text"))
    found = mrz.candidates(pages).join(mrz.line2_candidates(mrz.lines(pages)).groupBy("doc_id").agg(F.collect_set("line2").alias("singles")), "doc_id", "left")
    rows = z.select("doc_id", "line1", "line2").join(found, "doc_id")
    has = lambda c, x: F.coalesce(F.array_contains(c, F.col(x)), F.lit(False))
    return rows.select("doc_id", has("firsts", "line1").alias("first_found"), has("seconds", "line2").alias("second_found"), has("singles", "line2").alias("in_one_line"))


@query(
    f"""WITH {dq._ZONE} SELECT k AS doc_id, CASE k % 12 WHEN 10 THEN rpad('P<' || country || surname || 'SSON<<' || replace(given, ' ', '<'), 44, '<')
  WHEN 11 THEN rpad('P<' || country || surname || 'COL<<' || replace(given, ' ', '<'), 44, '<') ELSE line1 END AS line1 FROM z"""
)
def mrz_sanitize(spark, sf):
    """First lines in which each kind of filler was misread, and names that look like misread fillers: -SSON, and three letters of runs."""
    k, line = F.col("doc_id") % 12, F.col("line1")
    z = dq.zones(spark, sf)
    apart = lambda sep: F.regexp_replace(line, "([A-Z])<<([A-Z])", f"$1{sep}$2")
    named = F.regexp_replace(line, "<+$", "")
    fill = lambda c: F.rpad(c, 44, "<")
    forms = [
        F.concat(F.lit("PL"), F.substring(named, 3, 44), F.regexp_replace(F.regexp_extract(line, "<+$", 0), "<", "L")),
        apart("SS"), apart("KL"), apart("KK"), apart("LK"), apart("<C"), apart("<K"),
        F.concat(F.substring(line, 1, 41), F.lit("LKL")),
        fill(F.concat(named, F.lit("<<CCLLOO"))),
        F.concat(F.substring(line, 1, 2), F.lit(' |"'), F.lower(F.substring(line, 3, 20)), F.lit(") "), F.substring(line, 23, 22)),
        F.substring(apart("SSON<<"), 1, 44),
        F.substring(apart("COL<<"), 1, 44),
    ]
    noisy = line
    for i, form in enumerate(forms):
        noisy = F.when(k == i, form).otherwise(noisy)
    return z.select("doc_id", mrz.sanitise(noisy).alias("line1"))


@query(f"WITH {dq._ZONE} SELECT k AS doc_id, line1 FROM z")
def mrz_line1_rebuild(spark, sf):
    """First lines that lost P<, that and the country, the country alone; with a misread separator, a run of digits at the
    end, country letters twice; and whole ones."""
    k, line = F.col("doc_id") % 8, F.col("line1")
    cut = lambda a, n: F.substring(line, a, n)
    damaged = F.when(k == 0, cut(3, 42)).when(k == 1, cut(6, 39)).when(k == 2, F.regexp_replace(line, "([A-Z])<<([A-Z])", "$1KK$2"))
    damaged = damaged.when(k == 3, F.concat(cut(1, 36), F.substring("line2", 2, 8))).when(k == 4, F.concat(cut(1, 5), cut(4, 41))).when(k == 5, F.concat(cut(1, 2), cut(6, 39)))
    damaged = damaged.when(k == 6, F.regexp_replace(line, "([A-Z])<<([A-Z])", "$1K<$2")).otherwise(line)
    return mrz.line1_rebuild(dq.zones(spark, sf).select("doc_id", "line2", damaged.alias("line"))).select("doc_id", "line1")


@query(f"WITH {dq._ZONE} SELECT k AS doc_id, 10 AS score, line1 FROM z")
def mrz_line1_optimise(spark, sf):
    """Lines with a digit slipped in, with a letter read as a digit (where one looks like it), and whole ones."""
    k = F.col("doc_id") % 3
    slipped = F.concat(F.substring("line1", 1, 8), F.lit("7"), F.substring("line1", 9, 35))
    misread = F.concat(F.substring("line1", 1, 5), F.translate(F.substring("line1", 6, 1), "BG", "86"), F.substring("line1", 7, 38))
    return mrz.line1_optimise(dq.zones(spark, sf).select("doc_id", "country", F.when(k == 0, slipped).when(k == 1, misread).otherwise(F.col("line1")).alias("line")))


@query(f"WITH {dq._MRZ}, s AS (SELECT *, k % 5 = 2 AND substr(expiry, 3, 1) = '0' AS spoiled FROM t) SELECT k AS doc_id, CASE WHEN k % 7 = 0 THEN 'lenient' ELSE 'strict' END AS source, k % 7 <> 0 AND NOT spoiled AS lenient_valid, k % 7 <> 0 AS mrz_valid, surname, {dq._DMY.format('expiry', '20')} AS expiry_date FROM s")
def mrz_strict_merge(spark, sf):
    """In every fifth document a nought of the expiry date reads as O: the lenient parse fails its digit, the strict one reads it."""
    z = dq.zones(spark, sf)
    bad = F.concat(F.substring("line2", 1, 23), F.translate(F.substring("line2", 24, 1), "0", "O"), F.substring("line2", 25, 20))
    pages = z.select("doc_id", F.when(F.col("doc_id") % 5 == 2, F.concat_ws("\n", "line1", bad)).otherwise(F.col("text")).alias("text"))
    return mrz.strict_merge(mrz.pairs(pages)).select("doc_id", "source", "lenient_valid", "mrz_valid", "surname", "expiry_date")


@query(f"WITH {dq._VISA} SELECT k AS doc_id, surname, number AS \"passportNumber\", k % 7 <> 0 AS mrz_valid, CASE WHEN k % 7 = 0 THEN 4 ELSE 14 END AS score FROM v WHERE variant <> 'missing_mrz'")
def mrz_visa_best(spark, sf):
    """The best-scoring pair of each document; of equals the first by number."""
    return dq.zone_of(dq.visas(spark, sf)).select("doc_id", "surname", "passportNumber", "mrz_valid", "score")


@query("SELECT c_custkey AS doc_id, kind, kind = 'visa' AS run FROM customer, (SELECT unnest(['visa', 'passport']) AS kind)")
def visa_label_gate(spark, sf):
    no = F.lit(False)
    a = dq.visas(spark, sf).select("doc_id", F.lit("visa").alias("kind"), detect.run_labels(F.col("text"), no).alias("run"))
    return a.unionByName(dq.zones(spark, sf).select("doc_id", F.lit("passport").alias("kind"), detect.run_labels(F.col("text"), no).alias("run")))


@query(
    f"""WITH {dq._MRZ} SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'B1/B2' WHEN 1 THEN 'VIGNETTE' WHEN 3 THEN 'eTA' END AS visa_type, CASE k % 4 WHEN 0 THEN 'B1/B2' WHEN 1 THEN 'C' END AS category, CASE WHEN k % 4 = 0 THEN CAST(200000000 + k AS STRING) END AS control_number,
CASE WHEN k % 4 = 2 THEN 'G' || CAST(10000000 + k AS STRING) END AS label_number, CASE k % 2 WHEN 0 THEN 'TOURISM' ELSE 'STUDY' END AS purpose, CAST(1 + k % 90 AS STRING) || ' days' AS stay, CASE k % 6 WHEN 4 THEN surname || ' LLC' WHEN 5 THEN surname || ' HOUSE' END AS sponsor,
CASE WHEN k % 5 = 3 THEN 'CAN' END AS issuing_country, CASE WHEN k % 5 = 3 THEN surname END AS surname, CASE WHEN k % 5 = 3 THEN given END AS given_names FROM t"""
)
def visa_country_rules(spark, sf):
    """Pages of four kinds; some name a sponsor or host, some hold a zone line without prefix, of a country's code or of none's."""
    k = F.col("doc_id")
    head = F.when(k % 4 == 0, F.concat(F.lit("B1 / B2 CONTROL NO. "), (200_000_000 + k).cast("string"))).when(k % 4 == 1, "UK VIGNETTE, VISA CATEGORY C").when(k % 4 == 2, F.concat(F.lit("GRANT NO: G"), (10_000_000 + k).cast("string"))).otherwise("electronic travel authority")
    host = F.when(k % 6 == 4, F.concat(F.lit("Sponsor: "), "surname", F.lit(" llc"))).when(k % 6 == 5, F.concat(F.lit("HOST: "), "surname", F.lit(" House")))
    zone = F.concat(F.when(k % 5 == 3, "CAN").when(k % 5 == 4, "QQQ"), F.col("surname"), F.lit("<<"), F.col("given"), F.lit("<<<<"))
    body = F.concat_ws("\n", head, F.when(k % 2 == 0, "Purpose tourism and work").otherwise("study"), F.concat((1 + k % 90).cast("string"), F.lit(" DAYS STAY")), host, zone)
    r = visa.country_rules(F.col("text"))
    names = {"visa_type": "visaType", "category": "visaCategory", "control_number": "controlNumber", "label_number": "visaLabelNumber", "purpose": "purposeOfTravel", "stay": "durationOfStay", "sponsor": "sponsor", "issuing_country": "issuingCountry", "surname": "surname", "given_names": "givenNames"}
    rows = synth.mrz_truth(spark, sf).select(k, body.alias("text"))
    return rows.select(k, *[r[v].alias(c) for c, v in names.items()])


@query(
    f"""WITH {dq._MRZ}, d AS (SELECT *, k % 4 AS form, {dq._DMY.format('birth', '19')} AS born, {dq._DMY.format('expiry', '20')} AS ends FROM t)
SELECT k AS doc_id, CASE WHEN form = 3 AND k % 8 = 3 THEN NULL ELSE number END AS passport_number, surname, given AS given_names, given || ' ' || surname AS full_name, CASE WHEN form = 3 THEN 'POLISH' ELSE country END AS nationality, sex, born AS date_of_birth,
CASE WHEN form = 3 THEN NULL ELSE '02/03/2019' END AS date_of_issue, ends AS expiry_date, CASE WHEN form = 3 THEN NULL ELSE 'PORT ' || surname END AS place_of_birth, CASE WHEN form = 3 THEN NULL ELSE 'OLD TOWN' END AS place_of_issue FROM d"""
)
def pp_fields(spark, sf):
    """Pages of four forms: values beside their labels, below them, beside Malay labels, and few labels with spelt dates.

    Implausible candidates stand first on some: a number without digits, a surname's label in another language, a 99th day.
    """
    k, form = F.col("doc_id"), F.col("doc_id") % 4
    dmy = lambda c, century: F.concat_ws("/", F.substring(c, 5, 2), F.substring(c, 3, 2), F.concat(F.lit(century), F.substring(c, 1, 2)))
    born, ends = dmy("birth", "19"), dmy("expiry", "20")
    spelt = lambda c, century: F.concat_ws(" ", F.substring(c, 5, 2), F.get(F.array(*map(F.lit, text.MONTHS)), F.substring(c, 3, 2).cast("int") - 1), F.concat(F.lit(century), F.substring(c, 1, 2)))
    row = lambda label, value, sep=": ": F.concat(F.lit(label + sep), value)
    port, town, issued = F.concat(F.lit("PORT "), "surname"), F.lit("OLD TOWN"), F.lit("02.03.2019")
    beside = F.concat_ws("\n", F.lit("PASSPORT"), row("Passport number", F.lit("UNKNOWN")), row("Passport no.", F.col("number"), " "), row("Surname", F.col("surname")), row("Given names", F.col("given")), row("Nationality", F.col("country")), row("Sex", F.col("sex")), row("Date of birth", born), row("Date of issue", issued), row("Date of expiry", ends), row("Place of birth", port), row("Authority", town))
    below = F.concat_ws("\n", F.lit("PASSPORT"), *[row(label, v, "\n") for label, v in (("Passport number", F.col("number")), ("Nom / Surname", F.col("surname")), ("Given names / Prenoms", F.col("given")), ("Nationality", F.col("country")), ("Sex", F.col("sex")), ("Date of birth", born), ("Date of issue", issued), ("Date of expiry", ends), ("Place of birth", port), ("Place of issue", town))])
    malay = F.concat_ws("\n", F.lit("PASPORT"), row("No. pengenalan", F.col("number")), row("Surname", F.col("surname")), row("Nama / Name", F.col("given")), row("Warganegara", F.col("country")), row("Jantina", F.col("sex")), row("Date of birth", F.lit("99/99/1999")), row("Tarikh lahir", born), row("Tarikh dikeluarkan", issued), row("Tarikh tamat", ends), row("Tempat lahir", port), row("Pejabat pengeluar", town))
    few = F.concat_ws("\n", F.concat(F.lit("Polish "), F.when(F.col("sex") == "M", "male").otherwise("female")), row("Name", F.concat_ws(" ", "given", "surname")), spelt(F.col("birth"), "19"), spelt(F.col("expiry"), "20"), F.when(k % 8 == 7, F.col("number")))
    pages = synth.mrz_truth(spark, sf).select(k, F.when(form == 0, beside).when(form == 1, below).when(form == 2, malay).otherwise(few).alias("text"))
    return pages.select(k, *[c.alias(f) for f, c in passport.page_fields(F.col("text")).items()])


@query(
    "SELECT p_partkey AS doc_id, regexp_full_match(t, '[A-Z0-9]{6,12}') AND regexp_matches(t, '[0-9]') AS id_ok, CASE WHEN p_partkey % 3 = 0 THEN false ELSE NOT regexp_matches(p_name, '[^A-Za-z .''-]') AND length(p_name) > 1 END AS name_ok, p_partkey % 4 IN (0, 1) AS date_ok FROM (SELECT *, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS t FROM part)"
)
def pp_plausible(spark, sf):
    """Brands as numbers, part names and label words as names, written dates that exist or do not."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.lit("Surname / Nom")).otherwise(F.col("p_name"))
    day = F.when(k % 4 == 0, "31/12/1999").when(k % 4 == 1, "on 1 feb 2001").when(k % 4 == 2, "45/13/1999").otherwise("no date")
    number = F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    return tables.table(spark, sf, "part").select(k.alias("doc_id"), passport.plausible_number(number).alias("id_ok"), passport.plausible_name(name).alias("name_ok"), passport.plausible_raw_date(day).alias("date_ok"))


_FORM = "CASE k % 10 {0} END"
_NAMES = _FORM.format("WHEN 1 THEN surname || 'S' WHEN 3 THEN surname || 'ZZ' WHEN 4 THEN surname || 'IE' WHEN 5 THEN surname || 'ESS' WHEN 7 THEN surname || ' ANNA' ELSE surname")


@query(f"WITH {dq._MRZ} SELECT k AS doc_id, {_NAMES} AS surname, CASE WHEN k % 10 = 8 THEN 'MARTINA' ELSE given END AS given_names FROM t")
def pp_name_crosscheck(spark, sf):
    """Ten forms of zone, page field and page: fillers at the end once and twice, ESS for IE and tails without sense, each beside a
    form in which the page speaks for the zone; a part after a blank; no zone; a page field only; given names only on the page."""
    form, name = F.col("doc_id") % 10, F.col("surname")
    def pick(table: dict, otherwise=None):
        out = F.lit(None).cast("string") if otherwise is None else otherwise
        for i, value in table.items():
            out = F.when(form == i, value).otherwise(out)
        return out

    end = lambda x: F.concat(name, F.lit(x))
    zone = pick({0: end("K"), 1: end("S"), 2: end("LL"), 3: end("ZZ"), 4: end("ESS"), 5: end("ESS"), 6: end("DRKC"), 7: end(" ANNA"), 8: F.lit(None).cast("string"), 9: end("CIO")})
    visual = pick({8: F.lower(name), 9: name})
    seen = lambda *words: F.concat_ws(" ", F.lit("HOLDER"), *words)
    page = pick({0: seen(name, name), 1: seen(end("S"), end("S"), name), 2: seen(name), 3: seen(F.lit("NOBODY")), 4: seen(end("IE")), 5: seen(end("ESS")), 6: seen(name), 7: seen(name), 8: F.concat(F.lit("PASSPORT\nSURNAME "), name, F.lit("\nREPUBLIC OF XYZ MARTINA 12\nBRRRTT")), 9: seen(F.lit("NOBODY"))})
    given = F.when(form != 8, F.col("given"))
    rows = synth.mrz_truth(spark, sf).select("doc_id", names.reconcile(zone, visual, page).alias("surname"), given.alias("_given"), page.alias("_page"))
    return rows.select("doc_id", "surname", F.coalesce(names.reconcile(F.col("_given"), F.lit(None).cast("string"), F.col("_page")), names.given_on_page(F.col("_page"), F.col("surname"))).alias("given_names"))


# --- letters in prose ------------------------------------------------------------------------------------------------------


def letters_of(spark, sf, *parts: str) -> DataFrame:
    """(doc_id, s_name, text): one letter a supplier; parts are SQL over its key k, null ones are left out."""
    body = F.concat_ws("", *[F.expr(p) for p in parts])
    return tables.table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey")).select(F.col("k").alias("doc_id"), "s_name", body.alias("text"))


_K = "(SELECT s_suppkey AS k, CAST(s_suppkey AS STRING) AS t, s_name FROM supplier)"


@query(
    f"""SELECT k AS doc_id, 'Port' || t AS "joinPortChina", '05 MAY 2024' AS "joiningDate", 'Star' || t AS "vesselName", CASE WHEN k % 3 <> 0 THEN 'Panama Flag' END AS "vesselFlag", CASE WHEN k % 5 <> 0 THEN CAST(9000000 + k AS STRING) END AS "imoNumber",
  'Line' || t || ' Ltd' AS "principalCompany", '3 Months validity' AS "visaValidityMonths", CASE WHEN k % 2 = 0 THEN 'single entry' END AS "entriesRequested", CAST(1 + k % 60 AS STRING) || ' days' AS "stayDays", CASE WHEN k % 4 = 0 THEN 'G Type Visa' END AS "visaType" FROM {_K}"""
)
def tpl_narrative(spark, sf):
    parts = [
        "'The crew will join the\n vessel at Port'", "k", "' on 05 MAY 2024 M.V. Star'", "k", "CASE WHEN k % 3 <> 0 THEN ', Panama  Flag' END", "','", "CASE WHEN k % 5 <> 0 THEN concat(' IMO No. ', 9000000 + k) END",
        "' for our Principal, Line'", "k", "' Ltd. We request '", "CASE WHEN k % 4 = 0 THEN 'G\" Type visa, ' END", "CASE WHEN k % 2 = 0 THEN 'single entry, ' ELSE 'double entry, ' END", "'3 Months validity, stay of '", "1 + k % 60", "' days.'",
    ]
    found = letters.narrative(F.col("text"))
    return letters_of(spark, sf, *parts).select("doc_id", *[c.alias(f) for f, c in found.items()])


@query(
    f"""SELECT k AS doc_id, 'agent' AS section, 'Agent' || t AS "chinaAgentName", 'Road ' || t AS "chinaAgentAddress", CAST(1000 + k AS STRING) AS "chinaAgentContact", NULL AS "signatoryName", NULL AS "signatoryDesignation",
  CAST(1000 + k AS STRING) || CASE WHEN k % 3 <> 0 THEN ' Authorised signature' ELSE '' END AS "signatoryContact", NULL AS "companyStamp" FROM {_K}
UNION ALL SELECT k, 'from', NULL, NULL, NULL, CASE WHEN k % 3 = 0 THEN 'Lee' ELSE 'Lee Chan' END, 'Master', CASE WHEN k % 2 = 0 THEN '+55 ' || t END, CASE WHEN k % 2 = 0 THEN 'Seal ' || t END FROM {_K}"""
)
def tpl_labeled_blocks(spark, sf):
    agent = letters_of(spark, sf, "'Name: Agent'", "k", "'\nAddress: Road '", "k", "'\nContact no: '", "1000 + k", "CASE WHEN k % 3 <> 0 THEN ' Authorised signature' END")
    sender = letters_of(spark, sf, "CASE WHEN k % 3 = 0 THEN 'Mr Lee\nDesignation' ELSE 'Mr. Lee ChanDesignation' END", "': Master Contact no.: +55 '", "k", "CASE WHEN k % 2 = 0 THEN concat(' Company stamp: Seal ', k) END")
    agents, senders = letters.labelled_blocks(F.col("text")), letters.sender_block(F.col("text"))
    rows = agent.select("doc_id", F.lit("agent").alias("section"), *[c.alias(f) for f, c in agents.items()])
    return rows.unionByName(sender.select("doc_id", F.lit("from").alias("section"), *[c.alias(f) for f, c in senders.items()]), allowMissingColumns=True)


@query(f"SELECT k AS doc_id, CASE WHEN k % 4 <> 0 THEN 'Capt Lee ' || t ELSE s_name END AS person, CASE WHEN k % 4 <> 0 THEN 0.88 END AS confidence, CASE WHEN k % 4 <> 0 THEN 'section_parse' END AS method FROM {_K}")
def tpl_authorised_person(spark, sf):
    """In every fourth letter the closing clause is missing, and another source's value stays."""
    rows = letters_of(spark, sf, "'Authorise person name - Designation: Capt Lee '", "k", "CASE k % 4 WHEN 1 THEN '\nThanking you' WHEN 2 THEN ' If the visa is being granted' WHEN 3 THEN ' Yours  sincerely' END")
    person = letters.authorised_person(F.col("text"), F.col("s_name"))
    return rows.select("doc_id", person["value"].alias("person"), person["confidence"].alias("confidence"), person["method"].alias("method"))


@query(
    f"""SELECT k AS doc_id, s_name AS "surnameName", 'CHIEF OFFICER' AS designation, CASE WHEN k % 5 <> 0 THEN 'INDIAN' END AS nationality, '01 FEB 1980 MUMBAI' AS "birthPlace", 'Z' || t AS "passportNumber", '01 FEB 1980' AS "birthDate",
  CASE k % 3 WHEN 0 THEN '05 MAY 2020' WHEN 1 THEN '2020/05/05' ELSE 'open' END AS "passportIssueDate", CASE k % 3 WHEN 0 THEN '04 MAY 2030' WHEN 2 THEN 'later' END AS "passportExpiryDate" FROM {_K}"""
)
def tpl_candidate_table(spark, sf):
    """Rows of labels and values run together, with two dates, one date, or none that can be read."""
    dates = "CASE k % 3 WHEN 0 THEN '05 MAY 2020/04 MAY 2030' WHEN 1 THEN '2020/05/05' ELSE 'open / later' END"
    rows = letters_of(spark, sf, "'SURNAME / NAME '", "s_name", "'DESIGNATIONCHIEF OFFICERNATIONALITY: '", "CASE WHEN k % 5 <> 0 THEN 'INDIAN' END", "'BIRTHDATE/PLACE: 01 FEB 1980 MUMBAIPASSPORT NO Z'", "k", "'PASSPORT ISS/EXP: '", dates, "'Please be advised'")
    return rows.select("doc_id", *[c.alias(f) for f, c in letters.candidate_table(F.col("text")).items()])


# --- sinks, catalogues, matrices --------------------------------------------------------------------------------------------


@query("SELECT 'passport' AS doc_type, count(*) AS n FROM customer UNION ALL SELECT 'license', count(*) FROM customer")
def snk_extractions(spark, sf):
    """Results written by document type and read back."""
    path = scratch(spark, "extractions")
    a = mrz.fields(mrz.pairs(dq.zones(spark, sf))).select("doc_id", F.lit("passport").alias("doc_type"), F.to_json(F.struct("surname", "passport_number")).alias("result"))
    b = lq.truth(spark, sf).select("doc_id", F.lit("license").alias("doc_type"), F.to_json(F.struct("companyName", "creditCode")).alias("result"))
    tables.write_partitioned(a.unionByName(b), path, "doc_type")
    return spark.read.parquet(path).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


_REPORTS = ("met_field_prf", "met_style", "met_overall", "met_attribution", "met_calibration", "err_root_causes", "err_counts", "gate_pass_fail")


def _checksum(df: DataFrame, name: str) -> DataFrame:
    """(report, n, checksum): rows and an order-free checksum of their columns, by name and rounded as texts."""
    cell = lambda c, t: F.format_string("%.6f", F.round(F.col(c).cast("double"), 6)) if t in ("double", "int", "bigint") else F.col(c).cast("string")
    row = F.concat_ws("|", *[F.coalesce(cell(c, t), F.lit("~")) for c, t in sorted(df.dtypes)])
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")).alias("checksum")).select(F.lit(name).alias("report"), "n", "checksum")


@query(
    f"""WITH {lq.CMP}, failed AS (SELECT count(*) AS n FROM cmp WHERE NOT business_match)
SELECT 'failures' AS report, n, true AS as_queried FROM failed UNION ALL {' UNION ALL '.join(f"SELECT '{r}', (SELECT count(*) FROM ({lq.SQL[r]})), true" for r in _REPORTS)}"""
)
def snk_reports(spark, sf):
    """All reports of a run made from one table of comparisons, published as a version with its manifest, and read back.

    Comparisons are written once; each report is computed from that file.  as_queried tells whether what was read back has the same
    rows as the report computed anew.
    """
    root = scratch(spark, "reports")
    told = lq.comparisons(spark, sf, "ocr_text")
    told = told.withColumn("ocr_text", F.when(~F.col("business_match"), F.col("ocr_text")))  # a failure's page goes with it
    comparisons = tables.publish({"comparisons": told}, root, "input")
    cmp = tables.published(spark, root, "comparisons", "input")
    fails = evaluate.failures(cmp)
    fails.write.parquet(f"{comparisons}/failures")
    fails = spark.read.parquet(f"{comparisons}/failures")
    bucketed = fails.select(evaluate.bucket(synth.LABELS).alias("bucket"), "field")
    made = {
        "failures": fails,
        "met_field_prf": evaluate.field_prf(cmp),
        "met_style": evaluate.style_rates(cmp),
        "met_overall": evaluate.overall(cmp),
        "met_attribution": evaluate.attribution(cmp),
        "met_calibration": evaluate.calibration(cmp),
        "err_root_causes": evaluate.root_causes(fails),
        "err_counts": evaluate.grid_counts(bucketed, {"bucket": list(evaluate.BUCKETS), "field": list(synth.FIELDS)}),
        "gate_pass_fail": evaluate.gate(cmp),
    }
    tables.publish(made, root, "v1")
    out = None
    for name, anew in made.items():
        kept, want = _checksum(tables.published(spark, root, name, "v1"), name), _checksum(anew, name)
        one = kept.join(want.select(F.col("n").alias("_n"), F.col("checksum").alias("_c")), (F.col("n") == F.col("_n")) & F.col("checksum").eqNullSafe(F.col("_c")), "left").select("report", "n", F.col("_n").isNotNull().alias("as_queried"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT s_name AS template_id, f AS field, f = 'a' OR f = 'b' AND s_suppkey % 2 = 0 AS required, CASE WHEN f = 'a' THEN 'A,AA' ELSE 'B' END AS labels, CASE WHEN f = 'b' THEN 's' END AS section FROM supplier, (SELECT unnest(['a', 'b']) AS f)")
def src_template_catalog(spark, sf):
    """Templates written as files, one JSON object each, read as a folder and as rules."""
    path = scratch(spark, "templates")
    s = tables.table(spark, sf, "supplier")
    a = F.struct(F.lit("A").alias("label"), F.array(F.lit("AA")).alias("aliases"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("required"))
    b = F.struct(F.lit("B").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit("s").alias("section"), (F.col("s_suppkey") % 2 == 0).alias("required"))
    body = F.to_json(F.struct(F.col("s_name").alias("id"), F.array(F.lit("a")).alias("required"), F.create_map(F.lit("a"), a, F.lit("b"), b).alias("fields")))
    s.repartition(8).select(body.alias("value")).write.option("lineSep", "\x1e").text(path)
    files = tables.template_files(spark, path).select(F.explode(F.split("json", "\x1e")).alias("json"))
    rules, _ = tables.template_rules(files)
    return rules.select("template_id", "field", "required", F.array_join("labels", ",").alias("labels"), "section")


_MATRIX = str([[v, d] for v, d in synth.VISA_VARIANTS])
_MATRIX_SQL = f"""WITH {dq._MRZ}, m AS (SELECT *, ({_MATRIX})[CAST(k % {len(synth.VISA_VARIANTS)} AS INT) + 1] AS v FROM t), x AS (SELECT k AS doc_id, country, v[1] AS variant, v[2] AS degradation,
  CASE v[1] WHEN 'multiple_surnames' THEN 'GARCIA LOPEZ' WHEN 'special_characters' THEN 'GARCIA' ELSE surname END AS surname, CASE v[1] WHEN 'long_names' THEN 'ALEXANDER CHRISTOPHER MONTGOMERY FITZGERALD' WHEN 'special_characters' THEN 'JOSE MARIA' ELSE given END AS given_names,
  CASE WHEN v[1] = 'expired' THEN '01/01/2020' ELSE {dq._DMY.format('expiry', '20')} END AS expiry_date, v[1] <> 'missing_mrz' AS has_zone, v[1] NOT IN ('missing_mrz', 'invalid_mrz') AND k % 7 <> 0 AS mrz_valid, v[1] = 'expired' AS expired FROM m)"""


@query(f"{_MATRIX_SQL} SELECT * FROM x")
def gen_visa_matrix(spark, sf):
    """One visa a customer in twenty variants; validity is read from the zone that is printed."""
    m = synth.visa_matrix(spark, sf)
    valid = mrz.checks(F.col("line2"))
    ok = F.coalesce(valid["number_ok"] & valid["birth_ok"] & valid["expiry_ok"], F.lit(False))
    return m.select("doc_id", "country", "variant", "degradation", synth.ascii_upper(F.col("surname")).alias("surname"), synth.ascii_upper(F.col("given")).alias("given_names"), mrz.full_date(F.col("expiry")).alias("expiry_date"), F.col("line2").isNotNull().alias("has_zone"), ok.alias("mrz_valid"), (F.col("expiry") < "260101").alias("expired"))


_KINDS = "[" + ", ".join(f"{{'i': {i}, 't': '{t}', 'k': '{k}'}}" for i, (t, k) in enumerate(synth.SAMPLES)) + "]"
_TRUTHS = ", ".join(f"{e} AS {c}" for c, e in synth.MRZ_TRUTH.items())


@query(
    f"""WITH b AS (SELECT n_nationkey * 100 + s.i AS k, n_nationkey AS n, n_name AS nation, s.t AS visa_type, s.k AS kind FROM (SELECT *, unnest({_KINDS}) AS s FROM nation)), t AS (SELECT k, nation, visa_type, kind, {_TRUTHS} FROM b)
SELECT k AS doc_id, nation, visa_type, kind, surname, given AS given_names, number AS passport_number, country AS nationality, CASE WHEN kind = 'expired' THEN '01/01/2020' ELSE {dq._DMY.format('expiry', '20')} END AS expiry_date,
  kind <> 'no_zone' AS has_zone, kind NOT IN ('no_zone', 'bad_digit') AND k % 7 <> 0 AS mrz_valid, kind = 'expired' AS expired, 1 AS read_as_made FROM t"""
)
def gen_visa_samples(spark, sf):
    """Sample visas of every country with their truth; read_as_made is 1 where reading the page gives all of it back."""
    t = synth.visa_samples(spark, sf)
    ends = mrz.full_date(F.col("expiry"))
    truth = {"surname": F.col("surname"), "givenNames": F.col("given"), "passportNumber": F.col("number"), "nationality": F.col("country"), "expiryDate": ends, "visaType": F.col("visa_type")}
    r = visa.records(t.withColumns({f"w_{f}": c for f, c in truth.items()}), "nation", "visa_type", "kind", *[f"w_{f}" for f in truth])
    same = F.lit(True)
    for f in truth:
        same = same & F.col(f"record.{f}.value").eqNullSafe(F.col(f"w_{f}"))
    zone = F.col("record.machineReadableZone.value").isNotNull()
    return r.select("doc_id", "nation", "visa_type", "kind", F.col("w_surname").alias("surname"), F.col("w_givenNames").alias("given_names"), F.col("w_passportNumber").alias("passport_number"), F.col("w_nationality").alias("nationality"), F.col("w_expiryDate").alias("expiry_date"), zone.alias("has_zone"), F.col("mrzValid").alias("mrz_valid"), visa.expired(F.col("record.expiryDate.value"), F.to_date(F.lit("2026-01-01"))).alias("expired"), same.cast("int").alias("read_as_made"))


@query(
    f"""WITH {dq._MRZ}, {lq.CMP}, l AS (SELECT doc_id, max(actual) FILTER (field = 'companyName') AS name, max(actual) FILTER (field = 'creditCode') AS number FROM cmp GROUP BY doc_id)
SELECT k AS doc_id, CASE k % 5 WHEN 0 THEN 'passport' WHEN 1 THEN 'visa' WHEN 2 THEN 'chinese-business-license' WHEN 3 THEN 'invoice' ELSE 'unregistered' END AS type, CASE k % 5 WHEN 3 THEN 'placeholder' WHEN 4 THEN 'error' ELSE 'extract' END AS action,
  CASE k % 5 WHEN 0 THEN surname WHEN 1 THEN surname WHEN 2 THEN l.name END AS name, CASE k % 5 WHEN 0 THEN t.number WHEN 1 THEN t.number WHEN 2 THEN l.number END AS number, CASE WHEN k % 5 < 2 THEN k % 7 <> 0 END AS zone_valid,
  CASE k % 5 WHEN 3 THEN 'not implemented' END AS status, CASE k % 5 WHEN 4 THEN 'unknown type: unregistered' END AS error FROM t JOIN l ON t.k = l.doc_id"""
)
def extractor_route(spark, sf):
    """Passports, visas, licences, placeholders and documents of an unknown type in one table, each to its typed result."""
    k, of = F.col("doc_id"), lambda df, i, kind: df.where(F.col("doc_id") % 5 == i).select("doc_id", F.lit(kind).alias("type"), "text")
    rest = synth.mrz_truth(spark, sf).where(k % 5 >= 3).select("doc_id", F.when(k % 5 == 3, " Invoice").otherwise("Unregistered").alias("type"), F.lit("TOTAL 12").alias("text"))
    zones = dq.zones(spark, sf)
    docs = of(zones, 0, "PASSPORT").unionByName(of(dq.visas(spark, sf), 1, "Visa")).unionByName(of(lq.pages(spark, sf).where(F.col("page") == 1), 2, "Chinese-Business-License")).unionByName(rest)
    routed = routing.route(docs)
    got = lambda kind, *paths: F.coalesce(*[F.try_variant_get("result", f"$.{p}", kind) for p in paths])
    error = F.when(F.col("action") == "error", F.concat(F.lit("unknown type: "), "type"))
    return routed.select("doc_id", "type", "action", got("string", "surname", "companyName").alias("name"), got("string", "passport_number", "passportNumber", "creditCode").alias("number"), got("boolean", "mrz_valid", "mrzValid").alias("zone_valid"), got("string", "status").alias("status"), error.alias("error"))
