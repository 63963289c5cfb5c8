"""A zone's name held against the name read from the page and against the whole page's words, inside the row.

Fillers of a zone are often read as letters, so that a name ends in S, Z, K or L that nobody wrote.  What stands on the page tells:
an ending goes if the page has the shorter word, and stays if it has the longer one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators.passport import LABEL_WORDS

#: Letters that fillers are read as (single ones, and in tails of names), and words of passports that aren't names: fixed values.
FILLERS, TAIL = "SZKL", "[SLCKIOZ]{1,4}"
PAGE_WORDS = ("UNITED", "STATES", "AMERICA", "PASSPORT", "PASSEPORT", "REPUBLIC", "INDONESIA", "DEPARTMENT", "SIGNATURE")
NOT_NAMES = (*PAGE_WORDS, "NATIONALITY", "BIRTHDATE", "AUTHORITY", "EXPIRY", "ISSUE", "PLACE", "AUTORIT", "CONTROL", "ENTRIES", "ISSUING")


def plain(c: Column) -> Column:
    """Upper case, single blanks; an empty name is null."""
    return F.nullif(F.trim(F.regexp_replace(F.upper(c), r"\s+", " ")), F.lit(""))


def marked(page: Column) -> Column:
    """The page's words in upper case, each between blanks of its own, so that whole words can be counted without patterns."""
    return F.concat(F.lit(" "), F.regexp_replace(F.upper(F.coalesce(page, F.lit(""))), "[^A-Z]+", "  "), F.lit(" "))


def occurrences(words: Column, name: Column) -> Column:
    """How often a name of one or more words stands in marked words."""
    own = F.concat(F.lit(" "), F.regexp_replace(name, "[^A-Z]+", "  "), F.lit(" "))
    return F.coalesce((F.length(words) - F.length(F.replace(words, own, F.lit("")))) / F.length(own), F.lit(0))


def listed(words: Column, least: int, most: int, banned: tuple[str, ...]) -> Column:
    """Words of a length that are no label's and not banned, in order of the page."""
    each = F.filter(F.split(words, " "), lambda w: F.length(w).between(least, most))
    return F.filter(each, lambda w: ~w.isin(*LABEL_WORDS, *banned))


def given_on_page(page: Column, surname: Column) -> Column:
    """A given name from the lines below the surname, or on a line that labels given names, where nothing else has one.

    It has 5 to 12 letters, a vowel and at most one doubled letter.
    """
    lines = F.split(F.upper(page), "\n")
    below = F.array_position(F.transform(lines, lambda x: F.coalesce(x.contains(surname), F.lit(False))), True)
    near = F.filter(F.transform(lines, lambda x, i: F.when(((below > 0) & (i >= below)) | x.rlike(r"\b(GIVEN|PRENOMS?)\b"), x)), lambda x: x.isNotNull())
    doubled = lambda w: F.length(w) - F.length(F.regexp_replace(w, r"(.)\1", "1"))
    names = F.filter(listed(marked(F.array_join(near, "\n")), 5, 12, NOT_NAMES), lambda w: w.rlike("[AEIOU]") & (doubled(w) <= 1) & ~w.eqNullSafe(surname))
    return F.get(names, 0)


def reconcile(zone: Column, visual: Column, page: Column) -> Column:
    """The name of three sources: zone and page field (visual) where they agree or only one has it, else by the page's words.

    In this order: a single filler letter at the end, a doubled one, ESS for IE, a word of the page in front of a tail without
    sense, and a visual name that the zone only adds filler letters to.  A part after a blank is a name of its own, never a tail.
    """

    def judged(s: Column) -> Column:
        name, seen, words = s["name"], s["seen"], s["words"]
        without = lambda k: F.substring(name, F.lit(1), F.length(name) - k)
        on_page = lambda c: occurrences(words, c)
        short, stem, ie = without(1), without(2), F.concat(without(3), F.lit("IE"))
        single = (F.length(name) >= 4) & name.rlike(f"[{FILLERS}]$") & (((on_page(short) > 0) & (on_page(short) >= on_page(name))) | short.eqNullSafe(seen))
        double = (F.length(name) >= 5) & name.rlike(rf"([{FILLERS}])\1$") & (on_page(stem) > 0)
        ess = (F.length(name) >= 6) & name.endswith("ESS") & ((on_page(ie) > 0) | ie.eqNullSafe(seen))
        rest = lambda w: F.substring(name, F.length(w) + 1, F.length(name))
        heads = F.filter(listed(words, 4, 20, PAGE_WORDS), lambda w: name.startswith(w) & (F.length(rest(w)) >= 3) & rest(w).rlike("^[^ AEIOU]"))
        head = F.when(F.length(name) >= 8, F.get(heads, 0))
        cut = F.coalesce(name.startswith(seen) & rest(seen).rlike(f"^{TAIL}$"), F.lit(False))
        return F.when(name.isNull() | name.eqNullSafe(seen), seen).when(single, short).when(double, stem).when(ess, ie).when(head.isNotNull(), head).when(cut, seen).otherwise(name)

    return text.bound(F.struct(plain(zone).alias("name"), plain(visual).alias("seen"), marked(page).alias("words")), judged)
