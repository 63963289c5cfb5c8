"""Check digits and checksums as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by ICAO 9303: weights 7 3 1; by GB 32100: character set and weights of the 18-character credit code.
MRZ_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CREDIT_CHARSET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
CREDIT_WEIGHTS = [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28]


def mrz_check_digit(c: Column) -> Column:
    """ICAO 9303 check digit of a field, as a string; `<` and unknown characters count 0."""
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    value = F.transform(F.split(c, ""), lambda ch, i: F.greatest(F.instr(F.lit(MRZ_ALPHABET), ch) - 1, F.lit(0)) * F.get(weights, i % 3))
    return (F.aggregate(value, F.lit(0), lambda acc, x: acc + x) % 10).cast("string")


def mrz_check_ok(data: Column, digit: Column) -> Column:
    """Does digit fit data?  `<` fits only a field of fillers."""
    return F.when(digit == "<", F.regexp_replace(data, "<", "") == "").otherwise(mrz_check_digit(data) == digit)


def credit_check_char(body: Column) -> Column:
    """The 18th character of a credit code from its first 17."""
    weights = F.expr(f"array({', '.join(map(str, CREDIT_WEIGHTS))})")
    value = F.transform(F.split(F.substring(body, 1, 17), ""), lambda ch, i: (F.instr(F.lit(CREDIT_CHARSET), ch) - 1) * F.get(weights, i))
    total = F.aggregate(value, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.substring(F.lit(CREDIT_CHARSET), ((31 - total % 31) % 31 + 1).cast("int"), F.lit(1))


def credit_code_problem(code: Column) -> Column:
    """null for a valid code, else what is wrong with it."""
    return (
        F.when(F.coalesce(code, F.lit("")) == "", "absent")
        .when(F.length(code) != 18, "size")
        .when(~code.rlike(f"^[{CREDIT_CHARSET}]{{18}}$"), "alphabet")
        .when(credit_check_char(code) != F.substring(code, 18, 1), "checksum")
    )
