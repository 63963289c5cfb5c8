"""Corpora derived from base tables, so that extraction has an answer that plain SQL can state.

Expressions here are valid in Spark SQL and in ANSI engines alike; k is the customer key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import codes
from fieldloom.sources import tables

FIELDS = ("companyName", "creditCode", "legalRepresentative", "companyType", "registeredCapital", "establishmentDate", "businessTerm", "address", "businessScope", "registrationAuthority")
LABELS = {
    "creditCode": "统一社会信用代码",
    "companyName": "名称",
    "registeredCapital": "注册资本",
    "companyType": "类型",
    "establishmentDate": "成立日期",
    "legalRepresentative": "法定代表人",
    "address": "住所",
    "businessTerm": "营业期限",
    "businessScope": "经营范围",
    "registrationAuthority": "登记机关",
}


def pick(pool: str, width: int, index: str) -> str:
    """The index-th entry of a pool of equally wide entries."""
    return f"substr('{pool}', CAST(({index}) % {len(pool) // width} AS INT) * {width} + 1, {width})"


def _floor(x: str, by: int) -> str:
    return f"CAST(floor({x} / {by}.0) AS BIGINT)"


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


CITY = pick("广州深圳上海北京杭州成都武汉重庆", 2, "k")
YEAR, MONTH, DAY = "CAST(1990 + k % 30 AS STRING)", _two("1 + k % 12"), _two("1 + k % 28")
#: field -> expression of its true value; the credit code is without its check character.
TRUTH = {
    "companyName": f"{CITY} || {pick('华信恒达瑞丰盛世中科天元宏图伟业', 2, _floor('k', 8))} || {pick('贸易科技建材食品', 2, _floor('k', 64))} || '有限公司'",
    "creditCode": f"'91' || {pick('110000310000440300440100330100510100420100320100', 6, 'k')} || lpad(CAST(k * 7919 % 1000000000 AS STRING), 9, '0')",
    "legalRepresentative": f"{pick('王李张刘陈杨赵黄', 1, 'k')} || {pick('伟芳娜敏静丽强', 1, _floor('k', 8))} || {pick('军洋勇艳杰', 1, _floor('k', 56))}",
    "companyType": f"{pick('有限责任公司股份有限公司个人独资企业', 6, 'k')}",
    "registeredCapital": "CAST(CASE k % 12 WHEN 7 THEN (1 + k % 9) * 100 WHEN 0 THEN (1 + k % 9) * 1000100 ELSE 100 + k % 900 END AS STRING) || '万元人民币'",
    "establishmentDate": f"{YEAR} || '-' || {MONTH} || '-' || {DAY}",
    "businessTerm": f"CASE WHEN k % 2 = 0 THEN '长期' ELSE {YEAR} || '年' || {MONTH} || '月' || {DAY} || '日至2050年01月01日' END",
    "address": f"{CITY} || '市中山路' || CAST(1 + k % 400 AS STRING) || '号'",
    "businessScope": f"{pick('批发零售技术咨询建筑材料食品销售', 4, _floor('k', 3))} || '；' || {pick('进出口业务物业管理服务信息技术服务', 6, _floor('k', 7))}",
    "registrationAuthority": f"{CITY} || '市市场监督管理局'",
}
STYLE = "'style-' || substr('abcdefghij', CAST(k % 10 AS INT) + 1, 1)"
LEVEL = "CASE WHEN k % 10 IN (0, 1) THEN 'none' WHEN k % 10 IN (2, 9) THEN 'low' WHEN k % 10 IN (6, 7) THEN 'high' ELSE 'medium' END"
OCR_CONFIDENCE = "70.0 + k % 30"
#: DuckDB's form of the check character of body.
CHECK_CHAR_SQL = (
    f"substr('{codes.CREDIT_CHARSET}', CAST((31 - list_sum([(instr('{codes.CREDIT_CHARSET}', substr(body, CAST(i AS INT), 1)) - 1) * ({codes.CREDIT_WEIGHTS})[CAST(i AS INT)] FOR i IN range(1, 18)]) % 31) % 31 + 1 AS INT), 1)"
)


def license_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, style, level, seed, ocr_confidence, ten fields); one licence for each customer."""
    base = tables.spread(tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    out = base.select(F.col("k").alias("doc_id"), F.expr(STYLE).alias("style"), F.expr(LEVEL).alias("level"), (F.col("k") * 101 + 4).alias("seed"), F.expr(OCR_CONFIDENCE).cast("double").alias("ocr_confidence"), *[F.expr(e).alias(f) for f, e in TRUTH.items()])
    return out.withColumn("creditCode", F.concat("creditCode", codes.credit_check_char(F.col("creditCode"))))


def truth_sql(extra: str = "") -> str:
    """The same table for DuckDB."""
    fields = ", ".join(f"{e} AS \"{f}\"" if f != "creditCode" else f"{e} AS body" for f, e in TRUTH.items())
    return f"SELECT doc_id, style, level, seed, ocr_confidence, * EXCLUDE (doc_id, style, level, seed, ocr_confidence, body), body || {CHECK_CHAR_SQL} AS \"creditCode\"{extra} FROM (SELECT k AS doc_id, {STYLE} AS style, {LEVEL} AS level, k * 101 + 4 AS seed, CAST({OCR_CONFIDENCE} AS DOUBLE) AS ocr_confidence, {fields} FROM (SELECT c_custkey AS k FROM customer))"


def license_text(truth: DataFrame, *keep: str) -> DataFrame:
    """Truth to (doc_id, page, style, level, ocr_confidence, text, keep): pages of OCR text with the damage of each style.

    d: a character of 注册资本 is wrong; e: a blank inside 成立日期; f: the code's check character is wrong; g: the address and its
    label are lost; h: 有限 reads 有很 in the name; i: zeros of the code read as O; j: a second page, the holder's identity card.

    Beside it, whatever the style, doc_id % 12 spoils a field.  0: two characters of the type, and both 佰 of a capital in numerals,
    are wrong; 1: a dot inside the code; 3, 4: one character of the type; 6: a letter in front of the holder's name; 7: the 佰 of a
    capital in numerals; 8: a star inside the address; 9: a mark inside the name; 10: the scope's label is lost; 11: it is broken.
    """
    style, spoil = F.substring("style", -1, 1), F.col("doc_id") % 12
    code = F.col("creditCode")
    wrong = F.concat(F.substring(code, 1, 17), F.translate(F.substring(code, 18, 1), codes.CREDIT_CHARSET, codes.CREDIT_CHARSET[1:] + codes.CREDIT_CHARSET[0]))
    code = F.when(style == "f", wrong).when(style == "i", F.translate(code, "0", "O")).otherwise(code)
    code = F.when(spoil == 1, F.concat(F.substring(code, 1, 6), F.lit("·"), F.substring(code, 7, 12))).otherwise(code)
    name = F.when(style == "h", F.replace(F.col("companyName"), F.lit("有限"), F.lit("有很"))).otherwise(F.col("companyName"))
    name = F.when(spoil == 9, F.concat(F.substring(name, 1, 2), F.lit("#"), F.substring(name, 3, 80))).otherwise(name)
    kind = F.col("companyType")
    kind = F.when(spoil == 0, F.replace(kind, F.lit("限责"), F.lit("很资"))).when(spoil == 3, F.replace(kind, F.lit("责"), F.lit("贡"))).when(spoil == 4, F.replace(kind, F.lit("限"), F.lit("很"))).otherwise(kind)
    digit = F.substring(F.lit("壹贰叁肆伍陆柒捌玖"), (F.col("doc_id") % 9 + 1).cast("int"), F.lit(1))
    capital = F.when(spoil == 7, F.concat(digit, F.lit("信万元整"))).when(spoil == 0, F.concat(digit, F.lit("信亿"), digit, F.lit("信万元整"))).otherwise(F.col("registeredCapital"))
    holder = F.concat(F.when(spoil == 6, "W").otherwise(""), "legalRepresentative")
    address = F.when(spoil == 8, F.replace(F.col("address"), F.lit("市"), F.lit("市★"))).otherwise(F.col("address"))
    date = F.split("establishmentDate", "-")
    lines = [
        F.lit("营业执照"),
        F.concat(F.lit("统一社会信用代码 "), code),
        F.concat(F.lit("名称"), name, F.when(style == "d", "注册责本").otherwise("注册资本"), capital),
        F.concat(F.lit("类型"), kind, F.when(style == "e", "成立 日期").otherwise("成立日期"), date[0], F.lit("年"), date[1], F.lit("月"), date[2], F.lit("日")),
        F.concat(F.lit("法定代表人"), holder, F.when(style == "g", "").otherwise(F.concat(F.lit("住所"), address))),
        F.concat(F.lit("营业期限"), F.col("businessTerm")),
        F.concat(F.when(spoil == 10, "").when(spoil == 11, "经营···范围").otherwise("经营范围"), F.col("businessScope")),
        F.concat(F.lit("登记机关"), F.col("registrationAuthority")),
    ]
    card = F.concat(F.lit("居民身份证\n姓名 "), F.when(F.col("doc_id") % 20 == 19, "欧阳明").otherwise(F.col("legalRepresentative")), F.lit("\n性别 男\n公民身份号码 440681198501011234\n签发机关 佛山市公安局"))
    pages = F.array(F.struct(F.lit(1).alias("page"), F.concat_ws("\n", *lines).alias("text")), F.struct(F.lit(2).alias("page"), F.when(style == "j", card).alias("text")))
    return truth.select("doc_id", "style", "level", "ocr_confidence", *keep, F.explode(pages).alias("p")).select("doc_id", "p.page", "style", "level", "ocr_confidence", "p.text", *keep).where(F.col("text").isNotNull())


SURNAME = " || ".join(f"substr('BADEFUGAHEMUNATEVUWA', CAST({_floor('k', 10**i)} % 10 AS INT) * 2 + 1, 2)" for i in range(4))
GIVEN = pick("OTTO ERNA IGOR UMA  ", 5, "k")


def mrz_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, surname, given, number, country, birth, sex, expiry): passport truth from customers; dates are YYMMDD."""
    base = tables.spread(tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")))
    return base.select(F.col("k").alias("doc_id"), *[F.expr(e).alias(c) for c, e in MRZ_TRUTH.items()])


MRZ_TRUTH = {
    "surname": SURNAME,
    "given": f"trim({GIVEN})",
    "number": "'P' || lpad(CAST(k * 7919 % 10000000 AS STRING), 7, '0') || '1'",
    "country": "'N' || substr('ABCDEFGHIJKLMNOPQRSTUVWXY', CAST(n AS INT) + 1, 1) || 'X'",
    "birth": f"{_two('50 + k % 50')} || {MONTH} || {DAY}",
    "sex": "CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END",
    "expiry": f"{_two('27 + k % 10')} || {_two('1 + k % 12')} || {_two('1 + k % 27')}",
}


def mrz_lines(truth: DataFrame, kind: str = "P") -> DataFrame:
    """Truth with line1 and line2 of a TD3 passport (P) or an MRV-A visa (V), check digits included.

    In every seventh document the digit of the birth date is one off.
    """
    line1 = F.rpad(F.concat(F.lit(f"{kind}<"), F.col("country"), F.col("surname"), F.lit("<<"), F.replace(F.col("given"), F.lit(" "), F.lit("<"))), 44, "<")
    digit = codes.mrz_check_digit
    birth_digit = F.when(F.col("doc_id") % 7 == 0, ((digit(F.col("birth")).cast("int") + 1) % 10).cast("string")).otherwise(digit(F.col("birth")))
    head = F.concat("number", digit(F.col("number")), "country", "birth", birth_digit, "sex", "expiry", digit(F.col("expiry")))
    if kind == "V":
        line2 = F.rpad(head, 44, "<")
    else:
        personal = F.lit("<" * 14)
        whole = F.concat("number", digit(F.col("number")), "birth", birth_digit, "expiry", digit(F.col("expiry")), personal, F.lit("0"))
        line2 = F.concat(head, personal, F.lit("0"), digit(whole))
    return truth.select("*", line1.alias("line1"), line2.alias("line2"))


#: Fixed values: (variant, degradation) of visa pages, in order.
VISA_VARIANTS = (
    ("clean", "none"), ("low_dpi", "low_dpi"), ("motion_blur", "motion_blur"), ("gaussian_blur", "gaussian_blur"), ("skewed", "skewed"),
    ("perspective", "perspective"), ("partial_crop", "partial_crop"), ("dark", "dark"), ("overexposed", "overexposed"), ("glare", "glare"),
    ("stamp", "stamp"), ("ocr_a_font", "font_ocr_a"), ("arial_font", "font_arial"), ("mixed_fonts", "font_mixed"), ("long_names", "content_long_names"),
    ("multiple_surnames", "content_multi_surname"), ("special_characters", "content_special_chars"), ("invalid_mrz", "content_invalid_mrz"),
    ("missing_mrz", "content_missing_mrz"), ("expired", "content_expired"),
)


def ascii_upper(c: Column) -> Column:
    return F.translate(F.upper(c), "ÁÉÍÓÚÑ", "AEIOUN")


def visa_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mrz_truth with variant, degradation and the visa's zone lines: twenty variants by turns, the last six of content.

    Names and dates differ first and the zone follows them; then the expiry digit of an invalid zone is one off, or no zone is printed.
    """
    listed = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(d).alias("degradation")) for v, d in VISA_VARIANTS])
    t = mrz_truth(spark, sf_dir).withColumn("_v", F.get(listed, (F.col("doc_id") % len(VISA_VARIANTS)).cast("int"))).select("*", "_v.*").drop("_v")
    variant = F.col("variant")
    t = t.withColumns(
        {
            "surname": F.when(variant == "multiple_surnames", "GARCIA LOPEZ").when(variant == "special_characters", "GARCÍA").otherwise(F.col("surname")),
            "given": F.when(variant == "long_names", "ALEXANDER CHRISTOPHER MONTGOMERY FITZGERALD").when(variant == "special_characters", "JOSÉ MARÍA").otherwise(F.col("given")),
            "expiry": F.when(variant == "expired", "200101").otherwise(F.col("expiry")),
        }
    )
    # the zone spells names in plain letters; the record keeps them as they are
    spelt = t.withColumns({f"_{c}": F.col(c) for c in ("surname", "given")}).withColumns({c: F.replace(ascii_upper(F.col(c)), F.lit(" "), F.lit("<")) for c in ("surname", "given")})
    t = mrz_lines(spelt, "V").withColumns({c: F.col(f"_{c}") for c in ("surname", "given")}).drop("_surname", "_given")
    off = F.concat(F.substring("line2", 1, 27), ((F.substring("line2", 28, 1).cast("int") + 1) % 10).cast("string"), F.substring("line2", 29, 16))
    shown = lambda c: F.when(variant != "missing_mrz", c)
    return t.withColumn("line1", shown(F.col("line1"))).withColumn("line2", shown(F.when(variant == "invalid_mrz", off).otherwise(F.col("line2"))))


#: Kinds of sample visas of a country: two labelled texts of each type, and edge cases of the first type.
SAMPLES = (("TOURIST", "labels"), ("TOURIST", "labels_fr"), ("BUSINESS", "labels"), ("BUSINESS", "labels_fr"), ("TOURIST", "no_zone"), ("TOURIST", "bad_digit"), ("TOURIST", "expired"))


def visa_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, nation, visa_type, kind, mrz_truth's fields, line1, line2, text): SAMPLES of each country, with zones and truth."""
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("visa_type"), F.lit(k).alias("kind")) for i, (t, k) in enumerate(SAMPLES)]))
    base = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("nation"), kinds.alias("s"))
    base = base.select((F.col("n") * 100 + F.col("s.i")).cast("bigint").alias("k"), "n", "nation", "s.visa_type", "s.kind")
    t = base.select(F.col("k").alias("doc_id"), "nation", "visa_type", "kind", *[F.expr(e).alias(c) for c, e in MRZ_TRUTH.items()])
    t = mrz_lines(t.withColumn("expiry", F.when(F.col("kind") == "expired", "200101").otherwise(F.col("expiry"))), "V")
    off = F.concat(F.substring("line2", 1, 27), ((F.substring("line2", 28, 1).cast("int") + 1) % 10).cast("string"), F.substring("line2", 29, 16))
    t = t.withColumn("line2", F.when(F.col("kind") == "bad_digit", off).otherwise(F.col("line2")))
    day = lambda c, century: F.concat_ws("/", F.substring(c, 5, 2), F.substring(c, 3, 2), F.concat(F.lit(century), F.substring(c, 1, 2)))
    born, ends = day("birth", "19"), day("expiry", "20")
    row = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    english = [row("VISA TYPE", F.col("visa_type")), row("SURNAME", F.col("surname")), row("GIVEN NAMES", F.col("given")), row("NATIONALITY", F.col("country")), row("PASSPORT NO", F.col("number")), row("DATE OF BIRTH", born), row("SEX", F.col("sex")), row("EXPIRY DATE", ends)]
    french = [row("TYPE DE VISA", F.col("visa_type")), row("NOM", F.col("surname")), row("PRENOM", F.col("given")), row("NATIONALITE", F.col("country")), row("DATE DE NAISSANCE", born), row("VALID UNTIL", ends)]
    zone = F.when(F.col("kind") != "no_zone", F.concat_ws("\n", "line1", "line2"))
    return t.withColumn("text", F.when(F.col("kind") == "labels_fr", F.concat_ws("\n", F.lit("VISA"), *french, zone)).otherwise(F.concat_ws("\n", F.lit("VISA"), *english, zone)))
