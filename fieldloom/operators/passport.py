"""Cleaning of passport fields, and the merge of a record read from the zone with one read from the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text

#: Words of printed labels, which are never values: fixed values.
LABEL_WORDS = (
    "PASSPORT", "PASSEPORT", "PASAPORTE", "SURNAME", "NOM", "APELLIDOS",
    "GIVEN", "NAMES", "PRENOMS", "PRENOM", "NOMBRES", "NATIONALITY", "NATIONALITE", "NACIONALIDAD",
    "SEX", "SEXE", "SEXO", "GENDER", "BIRTH", "NAISSANCE", "NACIMIENTO",
    "ISSUE", "DELIVRANCE", "EXPEDICION", "EXPIRY", "EXPIRATION", "DATE",
    "AUTHORITY", "AUTORITE", "AUTORIT", "AUTORIDAD", "PLACE", "LIEU", "LUGAR",
    "SIGNATURE", "HUSBAND", "WIFE", "FATHER", "MOTHER", "DOCUMENT", "NUMBER", "NO",
    "WARGANEGARA", "TARIKH", "LAHIR", "TEMPAT", "JANTINA", "DIKELUARKAN",
    "FECHA", "FACIMIENTO", "NAFSSAPCE",
)
ZONE_FIELDS = ("surname", "given_names", "passport_number", "nationality", "date_of_birth", "sex", "expiry_date")


def only_labels(c: Column) -> Column:
    """Is every word a label's, or a single character?"""
    words = F.filter(F.split(F.upper(c), r"[\s/.,-]+"), lambda w: w != "")
    return F.forall(words, lambda w: w.isin(*LABEL_WORDS) | (F.length(w) < 2))


def clean_name(c: Column) -> Column:
    """Upper-case words of letters; fillers (one letter for three quarters of a word of four or more) and label words go."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z\s.'-]", " "), r"\s+", " ")), " ")
    most = lambda w: F.array_max(F.transform(F.array_distinct(F.split(w, "")), lambda ch: F.length(w) - F.length(F.replace(w, ch, F.lit("")))))
    filler = lambda w: (F.length(w) >= 4) & (most(w) / F.length(w) >= 0.75)
    kept = F.filter(words, lambda w: w.rlike("^[A-Z]$") | ((F.length(w) >= 2) & ~filler(w) & ~w.isin(*LABEL_WORDS)))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def clean_number(c: Column) -> Column:
    """6 to 12 letters and digits; of nine and a digit the digit, a check digit that ran on, goes."""
    v = F.upper(F.regexp_replace(c, r"\s", ""))
    v = F.when(v.rlike("^[A-Z0-9]{9}[0-9]$"), F.substring(v, 1, 9)).otherwise(v)
    return F.when(v.rlike("^[A-Z0-9]{6,12}$") & ~v.isin(*LABEL_WORDS), v)


def clean_nationality(c: Column) -> Column:
    v = F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.when((F.length(v) == 3) & ~v.isin(*LABEL_WORDS), v)


def clean_date(c: Column) -> Column:
    v = F.trim(c)
    return F.when(v.rlike("^(0[1-9]|[12][0-9]|3[01])/(0[1-9]|1[0-2])/[0-9]{4}$"), v)


def clean_sex(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return F.when(v.isin("M", "MALE"), "M").when(v.isin("F", "FEMALE"), "F")


def clean_place(c: Column) -> Column:
    v = text.full_trim(F.regexp_replace(c, r"\s+", " "))
    return F.when((F.length(v) >= 3) & ~only_labels(v) & ~v.rlike("(?i)^(AUTORIT|AUTHORITY|PLACE|ISSUING)"), v)


CLEAN = {"surname": clean_name, "given_names": clean_name, "passport_number": clean_number, "nationality": clean_nationality, "date_of_birth": clean_date, "sex": clean_sex, "expiry_date": clean_date}


#: Fields that a page has and a zone has not.
PAGE_FIELDS = ("date_of_issue", "place_of_birth", "place_of_issue")
FIELDS = (*ZONE_FIELDS, *PAGE_FIELDS)
CLEAN |= {"date_of_issue": clean_date, "place_of_birth": clean_place, "place_of_issue": clean_place}


def merged(zone: Column, page: Column, body: Column) -> dict[str, Column]:
    """FIELDS and path from a zone's record (a struct of ZONE_FIELDS and mrz_valid, or null), a page's (of FIELDS) and the page's text.

    Names are reconciled with the page; of the other fields the zone's come first, and what only a page has comes from there.
    path: mrz_only (a valid zone with names and number), mrz_with_ocr_fallback (the page filled a gap), mrz_partial, ocr_only.
    """
    from fieldloom.operators import names

    z = {f: CLEAN[f](zone[f]) for f in ZONE_FIELDS}
    p = {f: CLEAN[f](page[f]) for f in FIELDS}
    out = {f: F.coalesce(z[f], p[f]) for f in ZONE_FIELDS} | {f: p[f] for f in PAGE_FIELDS}
    out["surname"] = names.reconcile(z["surname"], p["surname"], body)
    out["given_names"] = F.coalesce(names.reconcile(z["given_names"], p["given_names"], body), names.given_on_page(body, out["surname"]))
    full = z["surname"].isNotNull() & z["given_names"].isNotNull() & z["passport_number"].isNotNull()
    none = F.coalesce(*z.values()).isNull()
    filled = F.greatest(*[z[f].isNull() & p[f].isNotNull() for f in ZONE_FIELDS])
    path = F.when(none, "ocr_only").when(F.coalesce(zone["mrz_valid"], F.lit(False)) & full, "mrz_only").when(filled, "mrz_with_ocr_fallback").otherwise("mrz_partial")
    return out | {"path": path}


def records(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text, keep) -> (doc_id, keep, FIELDS, mrz_valid, path): zone, page fields, merge and cross-check in the document's row; no shuffle.

    A null or empty text has no field and path ocr_only.
    """
    from fieldloom.operators import mrz

    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *keep, body.alias("_t"), F.struct(*[c.alias(f) for f, c in page_fields(body).items()]).alias("_page"), mrz.best_pair(body).alias("_pair"))
    found = mrz.zone_fields(F.col("_pair.line1"), F.col("_pair.line2"), F.col("_pair.valid"))
    rows = rows.withColumn("_zone", F.struct(*[c.alias(f) for f, c in found.items()]))
    record = F.struct(*[c.alias(f) for f, c in merged(F.col("_zone"), F.col("_page"), F.col("_t")).items()])
    rows = rows.select("doc_id", *keep, record.alias("_r"), F.coalesce("_zone.mrz_valid", F.lit(False)).alias("mrz_valid"))
    return rows.select("doc_id", *keep, *[f"_r.{f}" for f in FIELDS], "mrz_valid", "_r.path")


#: Labels of page fields in order of trial (patterns, blanks stand for any), and adjectives of nationality.
PAGE_LABELS = {
    "passport_number": ("passport number", "passport no", "document no", "no\\.? pengenalan"),
    "surname": ("surname", "family name", "nazwisko"),
    "given_names": ("given names?", "first names?", "imiona?", "nama / name"),
    "nationality": ("nationality", "warganegara"),
    "sex": ("sex", "gender", "jantina"),
    "date_of_birth": ("date of birth", "tarikh lahir", "dob", "data urodzenia"),
    "date_of_issue": ("date of issue", "tarikh dikeluarkan", "issue date"),
    "expiry_date": ("date of expiry", "tarikh tamat", "expiry date", "valid until", "data waznosci"),
    "place_of_birth": ("place of birth", "tempat lahir"),
    "place_of_issue": ("place of issue", "authority", "pejabat pengeluar"),
}
NATIONALITIES = ("INDIAN", "AMERICAN", "BRITISH", "CANADIAN", "AUSTRALIAN", "MALAYSIAN", "FRENCH", "GERMAN", "POLISH", "ITALIAN", "SPANISH")
#: Labels at which a value ends.
NEXT_LABEL = r"(?i)\b(Tarikh|Date\s*of|Nationality|Warganegara|Sex|Passport|Place|Issuing|Control|Entries)\b.*$"
_NAME, _DAY, _PLACE = r"[A-Za-z][A-Za-z .'-]*", r"[0-9][0-9A-Za-z ./-]*", r"[A-Za-z][A-Za-z ,.-]*"
SHAPES = {"passport_number": "[A-Z0-9]{6,15}", "surname": _NAME, "given_names": _NAME, "nationality": "[A-Za-z]+", "sex": "(?:MALE|FEMALE|M|F)\\b", "place_of_birth": _PLACE, "place_of_issue": _PLACE}


def plausible_number(c: Column) -> Column:
    return c.rlike("^[A-Z0-9]{6,12}$") & c.rlike("[0-9]") & ~only_labels(c)


def plausible_name(c: Column) -> Column:
    return c.rlike("^[A-Za-z .'-]{2,}$") & ~only_labels(c)


def plausible_raw_date(c: Column) -> Column:
    """Does it hold a date with a day and month that exist?"""
    day = text.date_normalise(c)
    return F.coalesce(F.substring(day, 1, 2).try_cast("int").between(1, 31) & F.substring(day, 4, 2).try_cast("int").between(1, 12), F.lit(False))


def page_fields(t: Column) -> dict[str, Column]:
    """Eleven fields of a page's text: for each the first plausible candidate of an ordered list.

    Candidates follow a label on its line, then on the next line.  Then come, for the number, nine digits before a country and a date, and
    any token of seven to nine characters; for the nationality an adjective anywhere; for the sex a word anywhere; for the
    expiry the last one of two or more spelt dates.  Without surname and given names a name's last word is the surname.
    """
    t = F.regexp_replace(t, "\r\n?", "\n")
    up = F.upper(t)

    def shown(field: str) -> list[Column]:
        value = SHAPES.get(field, _DAY)
        labels = [label.replace(" ", r"\s*") for label in PAGE_LABELS[field]]
        same = [F.regexp_extract(t, rf"(?i)\b{label}\b\.?[ \t]*[:=./-]*[ \t]*({value})", 1) for label in labels]
        below = [F.regexp_extract(t, rf"(?i)\b{label}\b[^\n]*\n[ \t]*({value})", 1) for label in labels]
        return [F.trim(F.regexp_replace(c, NEXT_LABEL, "")) for c in [*same, *below]]

    def first(candidates: Column, plausible) -> Column:
        return F.get(F.filter(candidates, lambda c: (c != "") & F.coalesce(plausible(c), F.lit(False))), 0)

    ran_on = F.regexp_extract(t, r"\b([0-9]{9})[0-9]?[A-Z]{3}[0-9]{6}", 1)
    number = first(F.transform(F.concat(F.array(*shown("passport_number"), ran_on), F.regexp_extract_all(t, F.lit(r"\b[A-Z0-9]{7,9}\b"), F.lit(0))), F.upper), plausible_number)
    surname, given = (F.upper(first(F.array(*shown(f)), plausible_name)) for f in ("surname", "given_names"))
    name = F.upper(first(F.array(F.trim(F.regexp_extract(t, rf"(?i)(?<!sur|en |ly |st )\bname\b[ \t]*[:-]?[ \t]*({_NAME})", 1))), plausible_name))
    bare, words = surname.isNull() & given.isNull(), F.split(name, r"\s+")
    last = F.when(F.size(words) > 1, F.element_at(words, -1))
    before = F.when(F.size(words) > 1, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(name)
    adjectives = [F.when(up.contains(n), n) for n in NATIONALITIES]
    nationality = F.upper(first(F.array(*shown("nationality"), *adjectives), lambda c: (F.length(c) >= 3) & ~only_labels(c)))
    sex = F.coalesce(first(F.array(*shown("sex")), lambda c: F.lit(True)), F.when(up.rlike(r"\bMALE\b|\bM\b"), "M").when(up.rlike(r"\bFEMALE\b|\bF\b"), "F"))
    spelt = F.regexp_extract_all(up, F.lit(r"\b[0-9]{1,2}\s+[A-Z]{3}\s+[0-9]{4}\b"), F.lit(0))
    day = lambda f, *more: text.bound(first(F.array(*shown(f), *more), plausible_raw_date), text.date_normalise)
    place = lambda f: first(F.array(*shown(f)), lambda c: ~only_labels(c))
    surname_out, given_out = F.when(bare, last).otherwise(surname), F.when(bare, before).otherwise(given)
    return {
        "passport_number": number,
        "surname": surname_out,
        "given_names": given_out,
        "full_name": F.when(bare, name).otherwise(F.concat_ws(" ", given, surname)),
        "nationality": nationality,
        "sex": F.upper(F.substring(sex, 1, 1)),
        "date_of_birth": day("date_of_birth", F.regexp_extract(up, r"\n\s*([0-9]{1,2}\s+[A-Z]{3}\s+[0-9]{4})", 1)),
        "date_of_issue": day("date_of_issue"),
        "expiry_date": day("expiry_date", F.when(F.size(spelt) >= 2, F.element_at(spelt, -1)).otherwise("")),
        "place_of_birth": place("place_of_birth"),
        "place_of_issue": place("place_of_issue"),
    }
