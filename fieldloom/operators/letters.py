"""Fields of letters in prose: labelled blocks, the request's narrative, the authorised person, candidate tables.

Every rule is a row (field, pattern), applied to text whose white space is squeezed to single blanks; a miss is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import text

#: Field and the pattern whose first group is its value, case ignored; \b stands for an ASCII word's edge.
BLOCKS = (
    ("chinaAgentName", r"Name\s*[:：]\s*(.+?)(?=\s+Address\s*[:：]|$)"),
    ("chinaAgentAddress", r"Address\s*[:：]\s*(.+?)(?=\s+Contact\s*no|$)"),
    ("chinaAgentContact", r"Contact\s*no\.?\s*[:：]\s*(.+?)(?=\s+Authori[sz]e|$)"),
    ("signatoryName", r"\bMr\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?=Designation|Contact|$)"),
    ("signatoryDesignation", r"Designation\s*[:：]\s*(.+?)(?=\s+Contact\s*no|$)"),
    ("signatoryContact", r"Contact\s*no\.?\s*[:：]\s*(.+?)(?=\s+Company\s+stamp|$)"),
    ("companyStamp", r"Company\s+stamp\s*[:：]\s*(.+)$"),
)
#: Fields of the sender's block, which has rules of its own; a contact counts only in front of a stamp.
SENDER = (
    ("signatoryName", r"Mr\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*Designation"),
    ("signatoryDesignation", r"Designation\s*[:：]\s*(.+?)Contact\s*no"),
    ("signatoryContact", r"Contact\s*no\.?\s*[:：]\s*([+\d\s]+?)(?=Company\s+stamp)"),
    ("companyStamp", r"Company\s+stamp\s*[:：]\s*(.+)$"),
)
#: Fields of the request's narrative.
NARRATIVE = (
    ("joinPortChina", r"join\s+(?:the\s+)?vessel\s+at\s+(.+?)\s+on\s+"),
    ("joiningDate", r"\bon\s+(\d{1,2}\s+[A-Z]+\s+\d{4})\b"),
    ("vesselName", r"\bM\.V\.\s+([^,]+)"),
    ("vesselFlag", r",\s*([A-Za-z\s]+)\s+Flag"),
    ("imoNumber", r"IMO\s*No\.?\s*(\d{7})"),
    ("principalCompany", r"Principal,\s*(.+?)(?:\.|We\s+request)"),
    ("visaValidityMonths", r"(\d+\s+Months?\s+validity)"),
    ("entriesRequested", r"\b(Single\s+Entry)\b"),
    ("stayDays", r"stay\s+of\s+(\d+\s+days?)"),
)
#: A kind of visa, and the authorised person between its label and the closing clause.
G_TYPE = r"G[\"“]?\s*Type\s+visa"
AUTHORISED = r"Authori[sz]e\s+person\s+name\s*[–\-:]\s*Designation\s*[:：]?\s*(.+?)(?=\s+If\s+the\s+visa\s+is\s+being\s+granted|Thanking\s+you|Yours\s+sincerely)"
AUTHORISED_CONFIDENCE = 0.88
#: Field, its marker and the marker that ends it.
MARKERS = (
    ("surnameName", r"SURNAME\s*/\s*NAME\s*", "DESIGNATION"),
    ("designation", r"DESIGNATION\s*", "NATIONALITY"),
    ("nationality", r"NATIONALITY\s*[:：]?\s*", "BIRTHDATE"),
    ("birthPlace", r"BIRTHDATE\s*/\s*PLACE\s*[:：]?\s*", r"PASSPORT\s*NO"),
    ("passportNumber", r"PASSPORT\s*NO\s*[:：]?\s*", r"PASSPORT\s*ISS"),
    ("passportDates", r"PASSPORT\s*ISS\s*/\s*EXP\s*[:：]?\s*", r"Please\s+be\s+advised"),
)
#: Dates as they are written.
DAY = r"\d{1,2}\s+[A-Z]+\s+\d{4}"
NUMERIC_DAY = r"\d{4}[/-]\d{2}[/-]\d{2}"


def squeezed(t: Column) -> Column:
    return text.full_trim(F.regexp_replace(t, f"{text.SPACE}+", " "))


def first(t: Column, pattern: str) -> Column:
    """The trimmed first group of the first match, else null."""
    found = F.regexp_extract(t, "(?i)" + pattern.replace(r"\b", text.EDGE), 1)
    return text.miss_as_null(text.full_trim(found))


def sender_block(t: Column) -> dict[str, Column]:
    """Fields of the block below the signature."""
    body = squeezed(t)
    return {f: first(body, p) for f, p in SENDER}


def labelled_blocks(t: Column) -> dict[str, Column]:
    """Agent and signatory fields of one section."""
    return {field: first(squeezed(t), pattern) for field, pattern in BLOCKS}


def narrative(t: Column) -> dict[str, Column]:
    """Port, vessel, flag, principal and terms of the request."""
    out = {field: first(squeezed(t), pattern) for field, pattern in NARRATIVE}
    out["vesselFlag"] = F.concat(out["vesselFlag"], F.lit(" Flag"))
    out["visaType"] = F.when(squeezed(t).rlike("(?i)" + G_TYPE), "G Type Visa")
    return out


def authorised_person(t: Column, other: Column) -> Column:
    """struct<value, confidence, method>: what stands before the closing clause, else the value of the other source."""
    found = first(squeezed(t), AUTHORISED)
    row = lambda v, c, m: F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit(m).alias("method"))
    return F.when(found.isNotNull(), row(found, AUTHORISED_CONFIDENCE, "section_parse")).otherwise(row(other, None, None))


def candidate_table(t: Column) -> dict[str, Column]:
    """Values of a row in which labels and values run together: each ends at the next marker, or at the end."""
    line = squeezed(t)
    raw = {field: first(line, f"{start}(.*?)(?:{end}|$)") for field, start, end in MARKERS}
    span = raw.pop("passportDates")
    days = F.regexp_extract_all(span, F.lit(f"(?i)({DAY}|{NUMERIC_DAY})"), F.lit(1))
    parts = F.when(F.size(days) > 0, days).when(span.contains("/"), F.split(span, r"\s*/\s*"))
    value = lambda i: text.miss_as_null(text.full_trim(F.get(parts, i)))
    return raw | {"birthDate": first(raw["birthPlace"], f"({DAY})"), "passportIssueDate": value(0), "passportExpiryDate": value(1)}
