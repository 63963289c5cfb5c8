"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most CAPACITY tokens (only longer documents are cut; the first piece takes the remainder).  The
histogram of piece lengths has at most CAPACITY entries however large the corpus, so the program is solved on the driver:
multiplicative weights hold a price for each length, an unbounded-knapsack dynamic program finds the configuration (multiset of
lengths that fit) of the highest price whatever it fills, and the sum of small steps along the configurations found is a
near-optimal fractional covering, with a lower bound from its prices.  It is rounded down.  What rounding leaves is served in
whole configurations at such prices, and the last pieces are packed best-fit-decreasing, all on counts.  With few pieces of
each length most steps are below one sequence and rounding leaves much; where plain best-fit-decreasing of the whole histogram
then needs fewer sequences, it is taken.

The result is a slot table (length, first rank, how many, first sequence, offset).  Pieces are ranked inside their length: a
length of many pieces is cut into buckets of about PIECES_IN_A_BUCKET, whose counts are added up first, so that a length shared
by a third of all pieces is still ranked in many tasks; a binary search in the slot table then places each piece.

Cases: a null or empty text is one piece of one token (the end id); pieces of equal length are interchangeable; repeated rows
are pieces of their own, and so are rows of null or equal doc_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common, tokens

CAPACITY, END_ID = 2048, 0
ROUNDS, STEP, RATE, SLACK = 60, 0.5, 0.2, 0.0005
LP_ROUNDS, LP_RATE, LP_STEP, LP_SLACK = 120, 40.0, 0.02, 0.002
PIECES_IN_A_BUCKET, BROADCAST_BUCKETS = 1_000, 100_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = tokens.table(path).encode
        for rows in tokens.runs(batches):
            ids, n = encode(rows.column(1), end_id)
            parts = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), parts)
            k = tokens.ranges(np.zeros(len(n), "i8"), parts)
            first = n - (parts - 1) * capacity
            start = np.where(k == 0, 0, first[owner] + (k - 1) * capacity)
            length = np.where(k == 0, first[owner], capacity)
            at = ((np.cumsum(n) - n)[owner] + start) * 4
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), pa.array(k.astype("i4")), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(df: DataFrame, tokenizer: str = tokens.TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    return common.documents(df).mapInArrow(_cut(tokenizer, end_id, capacity), PIECE_SCHEMA)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit-decreasing on a histogram: (how many, lengths of one sequence).  Sequences alike are handled together."""
    room: dict[int, dict[tuple[int, ...], int]] = {}

    def put(space: int, items: tuple[int, ...], k: int) -> None:
        if k:
            at = room.setdefault(space, {})
            at[items] = at.get(items, 0) + k

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in sorted(s for s in room if s >= length):
            each = space // length
            for items in list(room[space]):
                if left <= 0:
                    break
                k = min(room[space][items], left // each)
                if k:
                    room[space][items] -= k
                    put(space - each * length, items + (length,) * each, k)
                    left -= k * each
                if room[space].get(items, 0) and 0 < left < each:
                    room[space][items] -= 1
                    put(space - left * length, items + (length,) * left, 1)
                    left = 0
                if not room[space].get(items):
                    room[space].pop(items, None)
            if not room[space]:
                del room[space]
            if left <= 0:
                break
        each = capacity // length
        put(capacity - each * length, (length,) * each, left // each)
        if left % each:
            put(capacity - (left % each) * length, (length,) * (left % each), 1)
    return [(k, items) for at in room.values() for items, k in at.items()]


def knapsack(weights, lengths, capacity: int):
    """Unbounded-knapsack dynamic program: the best total weight for each room, and the item last taken there (-1: none)."""
    import numpy as np

    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            got = best[c - lengths[: fits[c]]] + weights[: fits[c]]
            k = got.argmax()
            if got[k] > best[c]:
                best[c], took[c] = got[k], k
    return best, took


def configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP, rate: float = RATE, slack: float = SLACK):
    """[(how many, lengths of one sequence)] of full configurations served in whole sequences, and what they leave.

    Multiplicative weights: a length's price starts at the room it takes and is multiplied
    by exp(-rate * coverage) against the average coverage.  One dynamic program a round prices, for every length, the best
    configuration that holds it; those within `slack` of the best are served, the least covered length first, each for `step`
    of what its scarcest length has left, rounded down to whole sequences (at least one).
    """
    import numpy as np

    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths])
    left, factor, chosen = need.copy(), np.ones(len(lengths)), {}
    for _ in range(rounds):
        at = np.flatnonzero(left)
        if not len(at):
            break
        weights = lengths[at] / capacity * factor[at]
        best, took = knapsack(weights, lengths[at], capacity)
        value = weights + best[capacity - lengths[at]]
        good = np.flatnonzero(value >= (1 - slack) * best[capacity])
        served = 0
        for i in good[np.argsort(-(left[at] / need[at])[good], kind="stable")]:
            use, c = {int(at[i]): 1}, capacity - int(lengths[at[i]])
            while c > 0:
                if took[c] < 0:
                    c -= 1
                else:
                    k = int(at[took[c]])
                    use[k] = use.get(k, 0) + 1
                    c -= int(lengths[k])
            most = min(left[k] // n for k, n in use.items())
            fill = sum(int(lengths[k]) * n for k, n in use.items())
            if most < 1 or fill < (1 - slack) * capacity:
                continue
            times = max(1, int(step * most))
            for k, n in use.items():
                left[k] -= times * n
            key = tuple(int(lengths[k]) for k in sorted(use, reverse=True) for _ in range(use[k]))
            chosen[key] = chosen.get(key, 0) + times
            served += times
        if not served:
            break
        covered = 1 - left / need
        factor = np.exp(-rate * (covered - covered.mean()))
    return [(k, items) for items, k in chosen.items()], {int(x): int(n) for x, n in zip(lengths, left) if n}


def fractional(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = LP_ROUNDS, rate: float = LP_RATE, step: float = LP_STEP, slack: float = LP_SLACK) -> tuple[dict[tuple[int, ...], float], float]:
    """({lengths of one sequence: how many}, bound): a fractional covering of the histogram, the configuration linear program.

    Multiplicative weights over all lengths: a length's price is the room it takes times exp(-rate * its coverage).  One dynamic
    program a round prices, for every length, the best configuration that holds it; all within `slack` of the best, whatever
    they fill, are raised so far that none covers a length by more than `step`.  It ends when every length is covered, or after
    `rounds`; the sum is then scaled to the volume of the histogram.  Each round's prices are also a feasible dual: all pieces'
    prices over the best configuration's is a lower bound on any packing, fractional ones included, and the best is returned.
    """
    import numpy as np

    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths], float)
    cover, x, bound = np.zeros(len(lengths)), {}, float((lengths * need).sum() / capacity)
    for _ in range(rounds):
        if cover.min() >= 1:
            break
        weights = lengths / capacity * np.exp(-rate * (cover - cover.min()))
        best, took = knapsack(weights, lengths, capacity)
        value = weights + best[capacity - lengths]
        bound = max(bound, float((weights * need).sum() / value.max()))
        found = set()
        for i in np.flatnonzero(value >= (1 - slack) * value.max()):
            items, c = [int(i)], capacity - int(lengths[i])
            while c > 0:
                if took[c] < 0:
                    c -= 1
                else:
                    items.append(int(took[c]))
                    c -= int(lengths[took[c]])
            found.add(tuple(sorted(items, reverse=True)))
        raised = [(items, *np.unique(items, return_counts=True)) for items in sorted(found)]
        raised = [(items, at, n, step * (need[at] / n).min()) for items, at, n in raised]
        gain = np.zeros(len(lengths))
        for _items, at, n, much in raised:
            gain[at] += much * n / need[at]
        scale = min(1.0, step / gain.max())
        for items, _at, _n, much in raised:
            x[items] = x.get(items, 0.0) + much * scale
        cover += gain * scale
    # coverage beyond need is not used, and what is short is left to best fit
    size = float((lengths * need).sum() / (lengths * need * cover).sum())
    return {tuple(int(lengths[i]) for i in items): much * size for items, much in x.items()}, bound


def rounded(x: dict[tuple[int, ...], float], counts: dict[int, int]) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """The fractional covering rounded down, never beyond the pieces there are, and what it leaves."""
    left, chosen = dict(counts), []
    for items, much in sorted(x.items(), key=lambda c: (-c[1], c[0])):
        n = {k: items.count(k) for k in set(items)}
        times = min(int(much + 1e-9), *(left[k] // n[k] for k in n))
        if times > 0:
            chosen.append((times, items))
            for k in n:
                left[k] -= times * n[k]
    return chosen, {k: n for k, n in left.items() if n}


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(how many, lengths of one sequence) that hold exactly the histogram, never more sequences than best fit alone needs.

    The fractional covering is rounded down; what it leaves, less than one sequence for each of its configurations, goes into
    whole sequences at the same kind of prices, and the last pieces are packed best-fit.
    """
    if not counts:
        return []
    size = lambda packing: sum(k for k, _ in packing)
    chosen, left = rounded(fractional(counts, capacity)[0], counts)
    whole, rest = configurations(left, capacity) if left else ([], {})
    return min(chosen + whole + best_fit(rest, capacity), chosen + best_fit(left, capacity), best_fit(counts, capacity), key=size)


def slots(packing: list[tuple[int, tuple[int, ...]]]):
    """Arrays by length: first rank, first sequence and offset of each run of interchangeable places."""
    import numpy as np

    table: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for k, items in packing:
        offset = 0
        for x in items:
            table.setdefault(x, []).append((rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + k
            offset += x
        sequence += k
    return {x: np.array(rows).T for x, rows in table.items()}


def _place(table):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        where = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, seq, off = where[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def ranks(cut: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """Adds rank, from 0 inside each length; counts is the histogram of cut's lengths.  Lengths of many pieces are ranked in many tasks."""
    buckets = ",".join(str(-(-counts.get(x, 0) // PIECES_IN_A_BUCKET) or 1) for x in range(max(counts, default=0) + 1))
    own = F.get(F.split(F.lit(buckets), ",").cast("array<bigint>"), F.col("length").cast("int"))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), own))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    if sum(counts.values()) // PIECES_IN_A_BUCKET + len(counts) <= BROADCAST_BUCKETS:  # no more rows than that
        sizes = F.broadcast(sizes)
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = dealt.withColumn("nth", F.row_number().over(inside)).join(sizes, ["length", "bucket"])
    return ranked.withColumn("rank", F.col("first") + F.col("nth") - 1).drop("bucket", "nth", "first")


def pack(df: DataFrame, tokenizer: str = tokens.TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    spark = df.sparkSession
    cut = common.materialize(pieces(df, tokenizer, end_id, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(solve(counts, capacity)))
    ranked = ranks(cut, counts, ["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_place(table), PIECE_SCHEMA + ", sequence_id long, offset long")


def op10_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
