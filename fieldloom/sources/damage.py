"""Levelled damage of clean text, as OCR does it, from a seed: the same text, level and seed give the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs that OCR swaps, noise marks, and how often each level applies the four operations.
PAIRS = (
    ("资", "责"), ("责", "资"), ("当", "雪"), ("雪", "当"), ("述", "金"), ("金", "述"), ("信", "佰"), ("佰", "信"),
    ("很", "限"), ("限", "很"), ("贡", "任"), ("任", "贡"),
    ("有限", "有很"), ("有限公司", "有很公司"), ("有限责任公司", "有限资任公司"),
)
NOISE = ("#", "!", ":", " ", "·", "|", "_")
OPERATIONS = ("substitution", "drop_char", "insert_noise", "line_break")
LEVELS = {"none": (0, 0, 0, 0), "low": (2, 0, 1, 0), "medium": (4, 1, 2, 1), "high": (8, 2, 4, 2), "extreme": (14, 4, 8, 4)}


def schedule(level: str) -> list[str]:
    """The operations of a level in order."""
    return [op for op, n in zip(OPERATIONS, LEVELS[level]) for _ in range(n)]


def draw(seed: Column, step: Column, salt: int, n: Column) -> Column:
    """A number below n that depends on seed, step and salt."""
    return ((seed * 7919 + step * 104729 + salt * 1299709) % 1000003 % n).cast("int")


def corrupt(rows: DataFrame, text_col: str = "text", level_col: str = "level", seed_col: str = "seed") -> DataFrame:
    """rows with the damaged text and operations (an array of those that changed it); a null level damages nothing.

    Substitution swaps the first place of a pair, drop and noise spare the ends, a line of ten or more may break.
    """
    seed, text = F.col(seed_col).cast("long"), F.col(text_col)
    plan = F.create_map(*[x for level in LEVELS for x in (F.lit(level), F.array(*map(F.lit, schedule(level))).cast("array<string>"))])
    ops = F.coalesce(F.try_element_at(plan, F.col(level_col)), F.array().cast("array<string>"))
    steps = F.transform(ops, lambda op, i: F.struct(op.alias("op"), i.alias("step")))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS])
    noise = F.array(*map(F.lit, NOISE))

    def cut(t: Column, at: Column, gone: Column, put: Column) -> Column:
        return F.concat(F.substring(t, F.lit(1), at), put, F.substring(t, at + gone + 1, F.length(t)))

    def damaged(t: Column, s: Column) -> Column:
        n, step = F.length(t), s["step"].cast("long")
        pair = F.get(pairs, draw(seed, step, 1, F.lit(len(PAIRS))))
        found = F.position(pair["a"], t)
        swapped = F.when(found > 0, cut(t, found - 1, F.length(pair["a"]), pair["b"])).otherwise(t)
        dropped = F.when(n >= 9, cut(t, draw(seed, step, 2, n - 8) + 4, F.lit(1), F.lit(""))).otherwise(t)
        noisy = cut(t, F.least(n, draw(seed, step, 3, F.greatest(n - 4, F.lit(1))) + 2), F.lit(0), F.get(noise, draw(seed, step, 4, F.lit(len(NOISE)))))
        lines = F.split(t, "\n")
        chosen = draw(seed, step, 5, F.size(lines))
        broken = F.array_join(F.transform(lines, lambda x, i: F.when((i == chosen) & (F.length(x) >= 10), cut(x, draw(seed, step, 6, F.length(x) - 8) + 4, F.lit(0), F.lit("\n"))).otherwise(x)), "\n")
        return F.when(s["op"] == "substitution", swapped).when(s["op"] == "drop_char", dropped).when(s["op"] == "insert_noise", noisy).otherwise(broken)

    def apply(done: Column, s: Column) -> Column:
        new = damaged(done["text"], s)
        return F.struct(new.alias("text"), F.when(new != done["text"], F.array_append(done["ops"], s["op"])).otherwise(done["ops"]).alias("ops"))

    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("ops"))
    rows = rows.withColumn("_done", F.aggregate(steps, start, apply))
    return rows.withColumn(text_col, F.col("_done.text")).withColumn("operations", F.col("_done.ops")).drop("_done")
