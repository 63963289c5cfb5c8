"""Column builders for text normalisation.  Each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware regex engines see it; Java's \s is ASCII only.
SPACE = r"[\s   -     　﻿]"
#: A word boundary of ASCII words.
EDGE_LEFT, EDGE_RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Either edge of an ASCII word.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def word(pattern: str) -> str:
    """pattern between ASCII word boundaries."""
    return f"{EDGE_LEFT}(?:{pattern}){EDGE_RIGHT}"


def miss_as_null(c: Column) -> Column:
    """regexp_extract gives '' for a miss; c is computed once."""
    return bound(c, lambda x: F.when(x != "", x))


def bound(c: Column, f) -> Column:
    """f of c, with c computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def full_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def norm_text(c: Column) -> Column:
    """CRLF to LF, runs of blanks to one, at most one empty line, ends trimmed."""
    for pattern, to in (("\r\n?", "\n"), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return full_trim(c)


def norm_cjk_ocr(c: Column) -> Column:
    """Blanks collapsed, full-width ASCII to half-width, CJK punctuation folded."""
    for pattern, to in (("\r\n?", "\n"), ("[ \t　]+", " "), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " "
    # fixed values: what the half-width step leaves
    c = F.translate(F.translate(c, wide, narrow), "。、﹒·﹣—–﹢", ".,..---+")
    return full_trim(c)


def norm_code_confusions(c: Column) -> Column:
    """Upper case, O and I and L look-alikes (full-width, Greek, Cyrillic) to digits, blanks dropped."""
    return F.regexp_replace(F.translate(F.upper(c), "OＯΟОIＩΙ|LＬ", "0000111111"), f"{SPACE}+", "")


def mrz_line_clean(c: Column) -> Column:
    """OCR glyphs of the filler to <, anything outside A-Z 0-9 <, blanks too, dropped."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"[\\|¢§°]", "<"), "[^A-Z0-9<]+", "")


def is_mrz_line(c: Column) -> Column:
    first = c.startswith("P<") | c.contains("<<")
    second = c.rlike("^[A-Z0-9<]{30,}$") & c.rlike("[0-9]{6}")
    return (F.length(c) >= 25) & (first | second)


MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def date_normalise(c: Column) -> Column:
    """D.M.Y, D MON Y and compact DDMONYYYY to DD/MM/YYYY; two-digit years from 50 on are 19xx; null if none fits."""
    c = F.upper(c)
    numeric = r"([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})"
    named = r"([0-9]{1,2})[ ./-]*(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*[ ./-]*([0-9]{4}|[0-9]{2})"
    month = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])

    def full(year: Column) -> Column:
        return F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year.try_cast("int") >= 50, "19").otherwise("20"), year))

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(c, pattern, i)

    by_number = F.concat_ws("/", F.lpad(part(numeric, 1), 2, "0"), F.lpad(part(numeric, 2), 2, "0"), full(part(numeric, 3)))
    by_name = F.concat_ws("/", F.lpad(part(named, 1), 2, "0"), F.try_element_at(month, part(named, 2)), full(part(named, 3)))
    return F.when(c.rlike(numeric), by_number).when(c.rlike(named), by_name)


def date_plausible(c: Column) -> Column:
    """YYMMDD after mapping letters that OCR takes digits for: month 1-12 and day 1-31."""
    return bound(F.translate(F.upper(c), "OQDILZSBG", "000112586"), lambda d: F.coalesce(d.rlike("^[0-9]{6}$") & F.substring(d, 3, 2).try_cast("int").between(1, 12) & F.substring(d, 5, 2).try_cast("int").between(1, 31), F.lit(False)))


def cn_date_normalise(c: Column) -> Column:
    """YYYY年M月D日 and YYYY-M-D to ISO, 长期 to long-term, else the trimmed value."""
    cn, plain = r"([0-9]{4}) *年 *([0-9]{1,2}) *月 *([0-9]{1,2})", r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"

    def iso(v: Column, p: str) -> Column:
        return F.concat_ws("-", F.regexp_extract(v, p, 1), F.lpad(F.regexp_extract(v, p, 2), 2, "0"), F.lpad(F.regexp_extract(v, p, 3), 2, "0"))

    return bound(full_trim(c), lambda v: F.when(v == "", None).when(v.contains("长期"), "long-term").when(v.rlike(cn), iso(v, cn)).when(v.rlike(plain), iso(v, plain)).otherwise(v))
