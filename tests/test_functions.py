"""Column builders and operators on hand-typed rows."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import codes, text
from fieldloom.operators import detect, evaluate, license, mrz, passes, templates, visa
from fieldloom.sources import tables


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("value, want", [("15.3.96", "15/03/1996"), ("1-2-2031", "01/02/2031"), ("01JAN1990", "01/01/1990"), ("7 MAR 49", "07/03/2049"), ("no date", None)])
def test_date_normalise(spark, value, want):
    assert one(spark, value, text.date_normalise) == want


@pytest.mark.parametrize("value, want", [("2017年1月8日", "2017-01-08"), ("2017/10/8", "2017-10-08"), ("长期", "long-term"), ("x", "x"), ("", None)])
def test_cn_date(spark, value, want):
    assert one(spark, value, text.cn_date_normalise) == want


@pytest.mark.parametrize("value, want", [("740812", True), ("74O8I2", True), ("741332", False), ("", False), (None, False)])
def test_date_plausible(spark, value, want):
    assert one(spark, value, text.date_plausible) is want


def test_norm_text(spark):
    assert one(spark, "  a\t b\r\n\r\n\r\n\r\nc  ", text.norm_text) == "a b\n\nc"
    assert one(spark, "Ａ１：　（x）。", text.norm_cjk_ocr) == "A1: (x)."
    assert one(spark, "oIl Ｏ", text.norm_code_confusions) == "0110"


@pytest.mark.parametrize("data, digit", [("L898902C3", "6"), ("740812", "2"), ("120415", "9"), ("<<<", "0")])
def test_mrz_check_digit(spark, data, digit):
    assert one(spark, data, codes.mrz_check_digit) == digit


def own_code(body="91350211MA2XQ7K3P"):
    charset, weights = "0123456789ABCDEFGHJKLMNPQRTUWXY", [3**i % 31 for i in range(17)]
    return body + charset[-sum(charset.index(c) * w for c, w in zip(body, weights)) % 31]


@pytest.mark.parametrize("code, want", [(own_code(), None), (own_code()[:17] + ("0" if own_code()[-1] != "0" else "1"), "checksum"), ("91440", "size"), (None, "absent"), (own_code()[:17] + "I", "alphabet")])
def test_credit_code(spark, code, want):
    assert one(spark, code, codes.credit_code_problem) == want


@pytest.mark.parametrize("raw, want", [("贰仟壹佰万元整", "2100万元人民币"), ("壹亿元人民币", "1亿元人民币"), ("2,100万元", "2100万元人民币"), ("2005年", None), ("伍佰元", "500元人民币")])
def test_capital(spark, raw, want):
    assert one(spark, raw, license.capital) == want


ICAO = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]


def test_icao_sample(spark):
    docs = spark.createDataFrame([(1, "noise\n" + "\n".join(ICAO)), (2, "nothing here"), (3, None)], "doc_id long, text string")
    rows = mrz.fields(mrz.pairs(docs)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.surname, r.given_names, r.passport_number, r.nationality, r.date_of_birth, r.sex, r.expiry_date, r.mrz_valid) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "UTO", "12/08/1974", "F", "15/04/2012", True)


def test_mrz_repair(spark):
    bad = ICAO[1].replace("7408122", "74O8122")
    r = mrz.repair(spark.createDataFrame([(1, bad)], "doc_id long, line2 string")).first()
    assert r.line2 == ICAO[1] and r.score == 11


def test_label_spans(spark):
    docs = spark.createDataFrame([(1, "营业执照\n统一社会佰用代码 9144\n名 称广州公司注册责本100万"), (2, "")], "doc_id long, text string")
    got = {(r.field, r.fuzzy, r.matched) for r in license.label_spans(docs, dedupe=True).collect()}
    assert got == {("creditCode", True, "统一社会佰用代码"), ("companyName", False, "名 称"), ("registeredCapital", True, "注册责本")}


def test_visa_detection(spark):
    texts = ["VISA TYPE: B1", "my visa arrived", "SURNAME: A\nCONTROL NO 123", "V<USASMITH<<JOHN", "hello", ""]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r.d for r in df.select(detect.is_visa(F.col("x"), F.lit(False)).alias("d")).collect()] == [True, False, True, True, False, False]


def test_classify(spark):
    kinds = {"P<UTO": "PASSPORT", "I<UTO": "ID_CARD", "V<UTO": "VISA", "passport copy": "PASSPORT", "x": "UNKNOWN"}
    for value, want in kinds.items():
        assert one(spark, value, detect.classify).type == want


def test_visa_columns(spark):
    df = spark.createDataFrame([("SMITH", "", None)], "surname string, givenNames string, sex string")
    assert df.select(visa.confidence(df.columns, F.lit(True)).alias("c")).first().c == round(1.1 / 9.7 + 0.12, 3)
    assert one(spark, "u.k.", visa.country_code) == "GBR"
    rows = spark.createDataFrame([(("x", ""), ("y", "z", "v"), None), (None, ("", None, ""), ("w",))], "a struct<p:string,q:string>, b struct<p:string,q:string,r:string>, c struct<p:string>")
    found = visa.provenance({x: F.col(x) for x in "abc"}, ("p", "q", "r", "s"), {"a": {"p", "q"}, "b": {"p", "q", "r"}, "c": {"p"}}, {"p": ("b", "a", "c"), "q": ("a", "b"), "r": ("b",), "s": ("a", "b", "c")})
    got = [[None if x is None else tuple(x) for x in r] for r in rows.select(*[c.alias(f) for f, c in found.items()]).collect()]
    assert got == [[("y", "b"), ("z", "b"), ("v", "b"), None], [("w", "c"), None, None, None]]


def test_visa_records_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "INVOICE\nTOTAL 12", "k"), (4, "x " * 30000, "k")], "doc_id long, text string, country string")
    rows = visa.flat(visa.records(docs, "country"), "country").collect()
    assert len(rows) == 4 and len(rows[0]) == 32 and not any(r[f] for r in rows for f in visa.FIELDS) and not any(r.mrzValid for r in rows)


def test_passes(spark):
    rows = spark.createDataFrame([(1, 1, "pass1", "ab\nxy", 5.0, 1), (1, 2, "pass2", "xy\ncd\nc", 9.0, 4), (1, 3, "pass3", "q", 9.0, 2)], "doc_id long, pass_no long, pass_id string, text string, score double, signals int")
    assert passes.best(rows).first().pass_id == "pass2"
    assert passes.recovered(rows).first().recovered == 3
    assert passes.merge_lines(rows).first().text == "ab\nxy\ncd"
    assert passes.until(rows, F.col("score") > 8).count() == 2


def test_metrics(spark):
    cmp = spark.createDataFrame(
        [(1, "s", "f", "a", "a", True, True, 0.95), (2, "s", "f", "a", "b", False, True, 0.95), (3, "s", "f", "a", None, False, False, 0.1), (4, "s", "f", None, None, True, True, 0.1)],
        "doc_id long, style string, field string, expected string, actual string, business_match boolean, extraction_match boolean, confidence double",
    ).withColumn("requires_review", F.lit(False))
    r = evaluate.field_prf(cmp).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.tn_strict, r.precision, r.recall) == (2, 1, 2, 0, 1, 0.666667, 0.5)
    assert {x.bin: x.predicted for x in evaluate.calibration(cmp).collect()} == {"0.0-0.5": 2, "0.5-0.7": 0, "0.7-0.8": 0, "0.8-0.9": 0, "0.9-1.0": 2}


def test_templates(spark):
    docs = spark.createDataFrame([(1, "t", "Name: Jo  x\nCode\n77\nnone")], "doc_id long, template_id string, text string")
    rules = spark.createDataFrame([("t", "name", ["Name"], None), ("t", "code", ["Code"], "[0-9]+"), ("t", "lost", ["Zip"], None), ("t", "any", ["Zip"], "7+")], "template_id string, field string, labels array<string>, value_pattern string")
    rules = rules.selectExpr("*", "CAST(NULL AS STRING) AS flags", "CAST(NULL AS STRING) AS section", "false AS required", "120 AS window_size")
    cuts = spark.createDataFrame([], "template_id string, section string, start string, end string, flags string")
    got = {r.field: (r.value, r.method) for r in templates.fields(templates.read(docs, templates.rules_by_template(rules, cuts))).collect()}
    assert got == {"name": ("Jo", "same_line"), "code": ("77", "next_line"), "lost": (None, None), "any": ("77", "pattern_fallback")}
    assert one(spark, "v", lambda c: templates.render("a {{x}} b{{y}}", ["x"])) == "a v b"


def test_template_catalogue(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id": "t", "name": "T", "required": ["a"], "fields": {"a": {"label": "A"}, "b": {"label": "B", "aliases": ["BB"], "required": true}, "c": {"label": "C"}}}')
    (tmp_path / "bad.json").write_text("{not json")
    rules, sections = tables.template_rules(tables.template_files(spark, f"file://{tmp_path}"))
    rows = {r.field: r for r in rules.collect()}
    assert rows["a"].required and rows["b"].required and not rows["c"].required and rows["b"].labels == ["B", "BB"] and rows["a"].window_size == 120
    assert sections.count() == 0


@pytest.mark.parametrize("value, want", [("SURNAME", 10 + 12.5 + 8 + 10), ("", 12.5), ("V<USASMITH<<JOHN<<<<<<<<<<<<<<", (40 + 25 + 12) * 0.35 + 12.5), ("VISA\n12/03/2020", 12.5 + 8 + 15)])
def test_pass_score(spark, value, want):
    assert one(spark, value, lambda c: passes.score(c, F.lit(50.0))) == round(want, 6)


def test_zone_reasons_and_letters_of_nothing(spark):
    from pyspark.sql import functions as F

    from fieldloom.operators import letters, mrz

    ok = spark.createDataFrame([(True, True, True, True)], "number_ok boolean, birth_ok boolean, expiry_ok boolean, composite_ok boolean")
    no, yes = F.lit(False), F.lit(True)
    reason = ok.select(mrz.invalid_reason(no, yes, F.lit("V")).alias("a"), mrz.invalid_reason(no, yes, F.lit(None).cast("string")).alias("b"), mrz.invalid_reason(yes, yes, F.lit("P")).alias("c"), mrz.visa_invalid_reason(no, F.lit("V<UTO\nA1"), F.lit(None).cast("string")).alias("d")).first()
    assert tuple(reason) == (mrz.WRONG_PREFIX % "V", mrz.NOISE, None, mrz.VISA_UNPARSED)
    rows = spark.createDataFrame([(None,), ("",), ("no field here",)], "text string")
    for found in (letters.labelled_blocks(F.col("text")), letters.narrative(F.col("text")), letters.candidate_table(F.col("text"))):
        assert all(v is None for r in rows.select(*found.values()).collect() for v in r)


def test_mrz_repair_of_two_characters(spark):
    """Where no single replacement fits, two in one field do."""
    def digit(x):
        return str(sum((int(c, 36) if c != "<" else 0) * (7, 3, 1)[i % 3] for i, c in enumerate(x)) % 10)

    number, birth, expiry = "X20500731", "850412", "310905"
    tail = "<" * 14 + "0"
    whole = number + digit(number) + birth + digit(birth) + expiry + digit(expiry) + tail
    line = number + digit(number) + "NAX" + birth + digit(birth) + "F" + expiry + digit(expiry) + tail + digit(whole)
    for seen in (line[:13] + "B504I2" + line[19:], line[:21] + "3I" + "O" + line[24:]):
        r = mrz.repair(spark.createDataFrame([(1, seen)], "doc_id long, line2 string")).first()
        assert (r["line2"], r["score"]) == (line, 11)
    hopeless = "?" * 44
    assert mrz.repair(spark.createDataFrame([(1, hopeless)], "doc_id long, line2 string")).first()["line2"] == hopeless


def test_damage(spark):
    from fieldloom.sources import damage

    rows = spark.createDataFrame([(i, "有限责任公司经营信息\n批发零售技术咨询建筑材料", level, 17 + i) for i, level in enumerate([*damage.LEVELS, None])] + [(9, "", "extreme", 1), (10, None, "low", 1)], "doc_id long, text string, level string, seed long")
    found = {r["doc_id"]: r for r in damage.corrupt(rows).collect()}
    assert found[0]["text"] == rows.first()["text"] and found[0]["operations"] == []
    assert found[5]["operations"] == [] and found[10]["text"] is None
    assert all(0 < len(found[i]["operations"]) <= sum(damage.LEVELS[level]) for i, level in enumerate(damage.LEVELS) if i)
    assert set(found[9]["operations"]) == {"insert_noise"}


def test_licence_checks_of_empty_values(spark):
    from fieldloom.operators import license_checks

    rows = spark.createDataFrame([(1, "address", None), (1, "businessScope", "  "), (1, "creditCode", "X")], "doc_id long, field string, value string")
    found = license_checks.validate(rows).collect()
    assert sorted((r["field"], r["score"], r["valid"], r["review"], r["signals"]) for r in found) == [("address", 0.0, False, True, ""), ("businessScope", 0.0, False, True, "")]


def test_readings_of_confusable_characters(spark):
    from fieldloom.operators import confusions, license_checks

    df = spark.createDataFrame([("有很资任公司",), ("很很",), ("王全军",), ("",), ("贡" * 9,)], "v string")
    found = {r.v: r for r in df.select("v", confusions.readings(F.col("v")).alias("r"), confusions.best_reading(F.col("v"), lambda c: license_checks.checked("companyType", c)["score"]).alias("b")).collect()}
    assert {x.text for x in found["很很"].r} == {a + b for a in "很有限" for b in "很有限"}
    assert [(e["index"], e["from"], e["to"]) for e in found["有很资任公司"].b.edits] == [(1, "很", "限"), (2, "资", "责")]
    assert found["有很资任公司"].b.text == "有限责任公司" and found["王全军"].b.text == "王全军" and found[""].b.n == 0
    assert len(found["贡" * 9].r) == confusions.MOST and len({x.text for x in found["贡" * 9].r}) == confusions.MOST


def test_checks_of_one_field_equal_those_of_the_table(spark):
    from fieldloom.operators import license_checks

    values = ["广州A有限公司", "王伟", "有限责任公司", "广州市★路1号", "零售#", "", None]
    rows = spark.createDataFrame([(f, v) for f in license_checks.BASE for v in values], "field string, value string")
    want = sorted((r.field, str(r.value), r.score, r.valid, r.review, r.signals) for r in license_checks.validate(rows).collect())
    got = []
    for f in license_checks.BASE:
        for r in rows.where(F.col("field") == f).select("value", license_checks.checked(f, F.col("value")).alias("c")).collect():
            got.append((f, str(r.value), r.c.score, r.c.valid, r.c.review, ",".join(r.c.signals)))
    assert sorted(got) == want


def test_scope_without_its_label(spark):
    texts = ["类型甲\n住所乙\n营业期限长期\n经营···范围零售;\n登记机关丙", "住所乙\n营业期限长期\n零售\n登记机关丙", "住所乙\n零售\n登记机关丙", "住所乙\n零售", "经营范围零售\n登记机关丙", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.segment, r.fallback) for r in license.segments(docs).where(F.col("field") == "businessScope").collect()}
    assert got == {0: ("零售", True), 1: ("长期\n零售", True), 2: ("乙\n零售", True), 4: ("零售", False)}


def test_long_table_of_an_odd_page(spark):
    from fieldloom.operators import license_fields

    pages = spark.createDataFrame([(1, 1, "s", 60.0, ""), (2, 1, "s", 99.0, None), (3, 1, "s", 99.0, "法定代表人W王伟\n类型股份有很公司"), (4, 2, "s", 99.0, "名称甲")], "doc_id long, page int, style string, ocr_confidence double, text string")
    rows = license_fields.extract(pages).collect()
    assert len(rows) == 30 and {r.doc_id for r in rows} == {1, 2, 3}
    assert all(r.value is None and r.requires_review and not r.label_found for r in rows if r.doc_id < 3)
    third = {r.field: r for r in rows if r.doc_id == 3}
    assert third["companyType"].value == "股份有限公司" and len(third["companyType"].corrections) == 1
    assert third["legalRepresentative"].value == "W王伟" and third["legalRepresentative"].candidate is None and third["legalRepresentative"].requires_review
    queue = {r.doc_id: r.reasons for r in license.review_queue(license_fields.extract(pages)).collect()}
    assert queue[1].startswith("ocr_confidence_below_75:60,credit_checksum_failed,missing_key_field:companyName")


def test_grid_counts(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, "x")], "p string, q string")
    got = {(r.p, r.q): r.n for r in evaluate.grid_counts(rows, {"p": ["a", "b"], "q": ["x", "y"]}).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 0, ("a", "(all)"): 2, ("b", "(all)"): 1, ("(all)", "x"): 3, ("(all)", "y"): 0, ("(all)", "(all)"): 4}
    none = evaluate.grid_counts(rows.limit(0), {"p": ["a"], "q": ["x"]}).collect()
    assert [r.n for r in none] == [0] * 4


def test_names_against_the_page(spark):
    from fieldloom.operators import names

    rows = [
        ("OBAMAS", None, "seen OBAMA", "OBAMA"), ("OBAMAS", None, "OBAMAS obamas OBAMA", "OBAMAS"), ("JAMES", "JAMES", "JAME JAME", "JAMES"), ("LIS", None, "LI", "LIS"),
        ("ANNAKK", None, "ANNA", "ANNA"), ("CALLESS", None, "CALLIE", "CALLIE"), ("CALLESS", "callie", "", "CALLIE"), ("TAHARREANDRAK", None, "TAHAR", "TAHAR"),
        ("DANIEL FREDERICK", None, "DANIEL", "DANIEL FREDERICK"), ("MARIASKI", "MARIA", None, "MARIA"), (None, "doe", "x", "DOE"), (None, None, None, None), ("", "", "", None),
        ("DANIELAE", None, "DANIEL", "DANIELAE"), ("SMITHK", None, "BLACKSMITH SMITHSON", "SMITHK"), ("VAN DYKS", None, "VAN\nDYK", "VAN DYK"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, z string, v string, p string")
    got = {r.i: r.n for r in df.select("i", names.reconcile(F.col("z"), F.col("v"), F.col("p")).alias("n")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]


def test_passport_records_of_odd_texts(spark):
    from fieldloom.operators import passport

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n".join(ICAO) + "\nPLACE OF BIRTH: GAMLA STAN"), (4, "\n".join(ICAO * 2)), (4, "x")], "doc_id long, text string")
    rows = passport.records(docs).collect()
    assert len(rows) == 5 and {(r.path, r.mrz_valid) for r in rows if r.doc_id < 3} == {("ocr_only", False)}
    third = next(r for r in rows if r.doc_id == 3)
    assert (third.surname, third.given_names, third.place_of_birth, third.path, third.mrz_valid) == ("ERIKSSON", "ANNA MARIA", "GAMLA STAN", "mrz_only", True)
    assert mrz.pairs(docs).count() == 2


def test_sanitised_zone_lines(spark):
    want = {"pl uto eriksson<<anna<maria": "P<UTOERIKSSON<<ANNA<MARIA", "P<ROUMIHAELASSTEFANIA": "P<ROUMIHAELA<<TEFANIA", "P<UTOTAHAR<CARCANDRA": "P<UTOTAHAR<<ARCANDRA", "P<UTOMUELLER<<ANNA<KLL": "P<UTOMUELLER<<ANNA<<<<", "V<USADOE<CJO": "V<USADOE<CJO", "": "", "P<UTOABE<<ERNACCOORR<<<": "P<UTOABE<<ERNA<<<<<<<<<"}
    for raw, line in want.items():
        assert one(spark, raw, mrz.sanitise) == line


def test_templates_scope_and_ways(spark):
    rules = spark.createDataFrame(
        [("t", "a", ["Name", "Nom"], None, None, "s", True, 20), ("t", "b", ["No"], "[0-9]+", None, None, False, 20), ("t", "c", ["Zip"], "[0-9]{5}", None, "gone", False, 20), ("u", "a", ["Name"], "[a-z]+", "m", None, False, 20), ("t", "d", [], "[0-9]+", None, None, False, 20)],
        "template_id string, field string, labels array<string>, value_pattern string, flags string, section string, required boolean, window_size int",
    )
    sections = spark.createDataFrame([("t", "s", "BEGIN", "END", None), ("t", "gone", "NOWHERE", None, None)], "template_id string, section string, start string, end string, flags string")
    docs = spark.createDataFrame([(1, "t", "Name: outside\nbegin\nNOM - inside   tail\nEND\nNo\n\nx 77\n12345"), (2, "u", "Name XY\nabc"), (3, "none", "Name: x"), (4, "t", None), (5, "t", "begin\nname\nNAME TAG\nend No 5")], "doc_id long, template_id string, text string")
    read = templates.read(docs, templates.rules_by_template(rules, sections))
    got = {(r.doc_id, r.field): (r.value, r.method, r.confidence, r.label) for r in templates.fields(read).collect()}
    none = (None, None, 0.0, None)
    assert got[(1, "a")] == ("inside", "same_line", 0.88, "Nom") and got[(1, "b")] == ("77", "window", 0.78, "No") and got[(1, "c")] == ("12345", "pattern_fallback", 0.45, "Zip")
    assert got[(2, "a")] == ("abc", "next_line", 0.9, "Name") and got[(4, "a")] == none and got[(1, "d")] == none and (3, "a") not in got
    assert got[(5, "a")][:2] == ("NAME TAG", "window") and got[(5, "b")][0] == "5"
    assert {r.doc_id: (r.missing, r.valid) for r in templates.required(read).collect()} == {1: (None, True), 2: (None, True), 4: ("a", False), 5: (None, True)}


def test_changes_of_a_catalogue(spark):
    from fieldloom.sources import tables

    old = spark.createDataFrame([("a", "n", None), ("b", "m", "y")], "id string, name string, body string")
    changes = spark.createDataFrame([("a", "create", 1, "x", None), ("a", "update", 2, None, "z"), ("c", "update", 1, "early", None), ("c", "create", 2, "c1", "c2"), ("c", "update", 3, "c3", None), ("c", "create", 4, "no", None), ("d d", "create", 5, "x", "x"), (None, "create", 6, "x", "x"), ("b", "drop", 7, None, None)], "id string, op string, seq int, name string, body string")
    merged, rejected = tables.template_upsert(old, changes, "id", ["name", "body"])
    assert {tuple(r) for r in merged.collect()} == {("a", "n", "z", "updated"), ("b", "m", "y", "kept"), ("c", "c3", "c2", "created")}
    assert {(r.id, r.seq, r.violation) for r in rejected.collect()} == {("a", 1, "exists"), ("c", 1, "missing"), ("c", 4, "exists"), ("d d", 5, "bad_id"), (None, 6, "bad_id"), ("b", 7, "bad_op")}
    root = tables.scratch(spark, "test")
    tables.publish({"t": merged}, root, "1")
    assert tables.published(spark, root, "t", "1").count() == 3
    with pytest.raises(ValueError):
        tables.published(spark, root, "other", "1")


def test_routes_of_odd_documents(spark):
    from fieldloom.operators import routing

    docs = spark.createDataFrame([(1, " PASSPORT ", "\n".join(ICAO)), (2, "visa", None), (3, None, "x"), (4, "LOA", "x"), (5, "letter", "x"), (6, "passport", "")], "doc_id long, type string, text string")
    routed = routing.route(docs, {"passport": routing.passports, "visa": routing.visas})
    got = {r.doc_id: (r.action, r.s, r.status) for r in routed.select("doc_id", "action", F.try_variant_get("result", "$.surname", "string").alias("s"), F.try_variant_get("result", "$.status", "string").alias("status")).collect()}
    assert got == {1: ("extract", "ERIKSSON", None), 2: ("extract", None, None), 3: ("error", None, None), 4: ("placeholder", None, "not implemented"), 5: ("error", None, None), 6: ("extract", None, None)}
    assert {(r.doc_id, r.error) for r in routing.errors(routed).collect()} == {(3, "unknown type: (none)"), (5, "unknown type: letter")}
    assert routing.route(docs.limit(0), {"passport": routing.passports}).count() == 0


def test_visa_scores_and_leaks(spark):
    docs = spark.createDataFrame([(1, "VISA\nSURNAME: DOE\nCONTROL NO: 123456789\nNATIONALITY: USA\nENTRIES: M"), (2, "nothing"), (3, None)], "doc_id long, text string")
    truth = {f: F.lit(None).cast("string").alias(f"w_{f}") for f in visa.JUDGED} | {"surname": F.lit("Doe, J").alias("w_surname"), "controlNumber": F.lit("123456789").alias("w_controlNumber"), "nationality": F.lit("").alias("w_nationality")}
    rows = {r.doc_id: r for r in visa.scores(visa.records(docs.select("*", *truth.values()), *[f"w_{f}" for f in visa.JUDGED])).collect()}
    assert (rows[1].hits, rows[1].total, rows[1].char_accuracy, rows[1].detected) == (2, 2, 1.0, True)
    assert (rows[2].hits, rows[2].total, rows[2].char_accuracy, rows[2].detected) == (0, 2, 0.0, False) and rows[3].hits == 0
    let = {r.doc_id: r for r in visa.leaks(visa.records(docs)).collect()}
    assert let[1].number and let[1].flagged and let[1].filled and not let[2].number and not let[2].filled


def filters(df):
    """The lines of a physical plan that filter, or scan under a filter."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in x]


def test_template_filters_do_not_read_the_letter(spark):
    """A filter on what was found would hold a copy of the extraction."""
    docs = spark.createDataFrame([(1, "t", "Total: 5"), (2, "unknown", "x")], "doc_id long, template_id string, text string")
    rules = spark.createDataFrame([("t", "a", ["Total"], None, None, None, True, None)], "template_id string, field string, labels array<string>, value_pattern string, flags string, section string, required boolean, window_size int")
    cuts = spark.createDataFrame([], "template_id string, section string, start string, end string, flags string")
    read = templates.read(docs, templates.rules_by_template(rules, cuts))
    for rows in (templates.required(read), templates.assemble(read)):
        assert not any("regexp" in x for x in filters(rows))
        assert [r.doc_id for r in rows.select("doc_id").collect()] == [1]


def test_anchors_are_in_every_pattern_of_their_group(spark):
    for groups, anchors in ((detect.GROUPS, detect.GROUP_ANCHORS), (detect.SIGNALS, detect.SIGNAL_ANCHORS)):
        assert len(groups) == len(anchors)
        assert all(a is None or all(a in p for p in g) for g, a in zip(groups, anchors))
    texts = ["VISA\nFAMILY  NAME x", "xpiry date 1.2.2020", "NATIONALITY", "ssport no A1234567", "PACE OF ISSUE", "sa type", "NTRIES", "Sex", "", None, "SUE DATE", "ONTROL NO", "GRANT NO", "unsexed", "ATE OF BIRTH"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    up = F.upper("t")
    plain = lambda groups: sum((up.rlike("|".join(g).replace(r"\b", text.EDGE)).cast("int") for g in groups), F.lit(0))
    rows = df.select(detect.label_groups(F.col("t")).alias("a"), plain(detect.GROUPS).alias("b"), detect._count(up, detect.SIGNALS, detect.SIGNAL_ANCHORS).alias("c"), plain(detect.SIGNALS).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)


def test_zones_are_not_searched_in_filters(spark):
    """Neither a page's best pair nor a cleaned line is worked out a second time by a filter."""
    from fieldloom.plans import document_queries

    docs = spark.createDataFrame([(1, "VISA\nno zone"), (2, " p<utoeriksson<<anna |maria　¢<<<<\nshort\nßßßßßßßßßßß")], "doc_id long, text string")
    lines = mrz.lines(docs)
    assert not any("regexp" in x for x in filters(lines) + filters(document_queries.zone_of(docs)))
    assert [(r.doc_id, r.pos, r.line) for r in lines.orderBy("doc_id", "pos").collect()] == [(2, 0, "P<UTOERIKSSON<<ANNA<MARIA<<<<<"), (2, 2, "S" * 22)]
