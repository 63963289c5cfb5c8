"""Near-dedup by Order MinHash over five-word shingles, verified by banded alignment.

Sketches.  A text's shingles are labelled with how often they have occurred before; for each of BANDS hash functions the LEAST
smallest labelled shingles are taken and kept in text order, and their hash is one bucket key.  Two texts meet in a bucket
only if they share these shingles in the same order, so the chance follows edit similarity.

Similarity.  M / (n + m - M), where n and m count shingles and M is the longest common subsequence of the two shingle
sequences, by a bit-parallel alignment inside the band that similarity SIMILAR allows.  Pairs at SIMILAR = 0.8 or more link.

Pairs.  Exact copies are one row from the start.  In a bucket every text is paired with the bucket's hub (the text with the
most company in all its buckets, found by a map-side aggregate) and with its WINDOW predecessors in the order of its next
sketches; buckets of more than SPLIT texts are cut by a hash for that order.  A bucket of up to WINDOW + 1 texts thus gives
all its pairs, and no bucket gives a square.  Each text's best pair is aligned first; then all pairs that still stand between
different components are.

The rest of the big buckets.  Texts of buckets of more than WINDOW + 1 texts that still lie in different components are joined
by an exact prefix filter: similarity SIMILAR needs a share of SIMILAR of either text's labelled shingles, so that two such
texts have one in common among the first n - ceil(SIMILAR * n) + 1 of each, in any order all texts agree on.  The order puts
shingles common in a bounded sample last (this is for speed only), positions in it bound what can still be shared, a shingle
of more than BLOCK texts is joined block by block in tasks of their own, and the pairs left between different components are
aligned.  So no pair that meets in a bucket is lost.  The classes are the connected components.

Texts move once, for those that share a bucket; afterwards only 32-bit shingle sequences do.

Cases: null texts and texts without words are in classes of their own; a text of one to four words is one shingle; equal
texts share a class; repeated rows count as copies; texts are told apart by their hash, so different texts under one doc_id or
without one each have their own class and links; class_id is null only where no text of the class has a doc_id; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common, tokens

WORDS, BANDS, LEAST, SIMILAR = 5, 16, 3, 0.8
WINDOW, SPLIT = 3, 1024
BLOCK, RARITY_TEXTS, RARITY_LIST, HOT_LIST = 256, 10_000, 50_000, 100_000
RUN_CHARS = 1_000_000
MIX_A, MIX_B, PAD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def _mix(x):
    """The finisher of splitmix64, on uint64 arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], words: int = WORDS):
    """(hashes of all texts' shingles in text order, number of shingles of each text); words are lower-cased."""
    import numpy as np

    data = [b" " + (t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"".join(data) + b" ", "u1")
    ends = np.cumsum([len(d) for d in data])
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    gap = blank[raw]
    starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    if not len(starts):
        return np.zeros(0, "u8"), np.zeros(len(texts), "i8")
    stops = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int((stops - starts).max()) + 1, 0x100000001B3, "u8"))
        at = np.arange(len(raw)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(raw)]))
        value = np.where(gap, np.uint64(0), (raw.astype("u8") + np.uint64(1)) * power[np.minimum(at, len(power) - 1)])
        word = _mix(np.add.reduceat(value, starts))
        n_words = np.diff(np.r_[0, np.searchsorted(starts, ends)])
        count = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
        first = np.repeat(np.r_[0, np.cumsum(n_words)[:-1]] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        last = np.repeat(np.cumsum(n_words), count)
        out = np.zeros(len(first), "u8")
        for j in range(words):
            k = first + j
            out = _mix(out * np.uint64(0x2545F4914F6CDD1D) + np.where(k < last, word[np.minimum(k, len(word) - 1)], np.uint64(PAD)))
    return out, count


def order_minhash(hashes, count, bands: int = BANDS, least: int = LEAST):
    """uint64 [texts, bands]: for each band the hash of the `least` smallest occurrence-labelled shingles in text order."""
    import numpy as np

    owner = np.repeat(np.arange(len(count)), count)
    full = np.flatnonzero(count)
    begin = np.r_[0, np.cumsum(count)[:-1]][full]
    order = np.lexsort((hashes, owner))
    same = np.r_[False, (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])]
    step = np.arange(len(order))
    times = np.zeros(len(order), "u8")
    times[order] = step - np.maximum.accumulate(np.where(same, 0, step))
    out = np.zeros((len(count), bands), "u8")
    lens, most = count[full], np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        label = _mix(hashes + times * np.uint64(PAD))
        for band in range(bands):
            salt = _mix(np.array([band + 1], "u8") * np.uint64(PAD))[0]
            value = (label ^ salt) * (salt | np.uint64(1))
            value ^= value >> np.uint64(29)
            places = np.full((least, len(full)), len(label))
            for j in range(least):
                low = np.minimum.reduceat(value, begin)
                hit = np.flatnonzero((value == np.repeat(low, lens)) & (value != most))
                who = np.searchsorted(full, owner[hit])
                one = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
                places[j, who[one]] = hit[one]
                value[hit[one]] = most
            places.sort(axis=0)
            key = np.full(len(full), salt, "u8")
            padded = np.r_[label, np.uint64(PAD)]
            for j in range(least):
                key = _mix(key * np.uint64(MIX_B) + padded[places[j]])
            out[full, band] = key
    return out


def _sketches(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for rows in tokens.runs(batches, most=RUN_CHARS):
        hashes, count = shingle_hashes(rows.column("text").to_pylist())
        keys = order_minhash(hashes, count).view("i8") if len(hashes) else np.zeros((len(count), BANDS), "i8")
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype="i4") * BANDS), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("blob"), pa.array(count, pa.int64()), flat], ["doc_id", "blob", "n", "bands"])


def _sequences(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for rows in tokens.runs(batches, most=RUN_CHARS):
        hashes, count = shingle_hashes(rows.column("text").to_pylist())
        cut = np.r_[0, np.cumsum(count)]
        short = (hashes >> np.uint64(32)).astype("<u4")
        yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([short[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["node", "seq"])


def common_in_band(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence of a and b with positions at most `band` apart (bit-parallel)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    masks = {x: sum(1 << i for i in p) for x, p in places.items() if len(p) > 4}
    row, low, high, found = 0, 0, 0, 0
    for j, y in enumerate(b):
        to, top = min(max(0, j - band), len(a)), min(len(a), j + band + 1)
        if top > high:
            row |= ((1 << (top - high)) - 1) << (high - low)
            high = top
        if to > low:
            gone = row & ((1 << (to - low)) - 1)
            found += (to - low) - gone.bit_count()
            row >>= to - low
            low = to
        if y not in places:
            continue
        if y in masks:
            use = masks[y] >> low
        else:
            use = 0
            for i in places[y]:
                if low <= i < high:
                    use |= 1 << (i - low)
        use &= row
        if use:
            row = ((row + use) | (row - use)) & ((1 << (high - low)) - 1)
    return head + tail + found + (high - low) - row.bit_count()


def similarity(a: list[int], b: list[int], least: float = SIMILAR) -> float:
    """Ordered Jaccard index; exact where it reaches `least`, else no higher than it is."""
    n = len(a) + len(b)
    if not a or not b or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    m = common_in_band(a, b, int(n - 2 * least / (1 + least) * n) + 1)
    return m / (n - m)


def _verify(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        good = []
        for x, y in zip(batch.column("seq_a"), batch.column("seq_b")):
            a, b = (np.frombuffer(v.as_buffer(), "<u4").tolist() for v in (x, y))
            good.append(similarity(a, b) >= SIMILAR)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose alignment reaches SIMILAR."""
    left = sequences.select(F.col("node").alias("a"), F.col("seq").alias("seq_a"))
    right = sequences.select(F.col("node").alias("b"), F.col("seq").alias("seq_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "seq_a", "seq_b").mapInArrow(_verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for nodes with an edge.

    Labels go to neighbours and are then looked up once more (pointer jumping), until nothing changes; every round is written
    to the shared folder.
    """
    both = common.materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = common.materialize(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        done = new.where(F.col("old") != F.col("label")).limit(1).count() == 0
        labels = new.select("node", "label")
        if done:
            return labels


def labelled(seq: bytes):
    """uint64 array: the 32-bit shingles of a sequence labelled with how often they have occurred before, mixed."""
    import numpy as np

    v = np.frombuffer(seq, "<u4").astype("u8")
    order = np.argsort(v, kind="stable")
    step = np.arange(len(v))
    times = np.zeros(len(v), "u8")
    times[order] = step - np.maximum.accumulate(np.where(np.r_[False, v[order][1:] == v[order][:-1]], 0, step))
    with np.errstate(over="ignore"):
        return _mix(v | (times << np.uint64(32)))


def _labels(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for seq in batch.column("seq"):
            yield pa.RecordBatch.from_arrays([pa.array(labelled(seq.as_buffer()).view(np.int64))], ["token"])


def _prefixes(listed):
    """The first labelled shingles of each text, those in `listed` (tokens sorted, and their counts) last."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, counts = listed.value
        for batch in batches:
            for node, seq in zip(batch.column("node").to_pylist(), batch.column("seq")):
                token = labelled(seq.as_buffer()).view(np.int64)
                n, cost = len(token), np.zeros(len(token), "i8")
                if len(known):
                    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    cost = np.where(known[at] == token, counts[at], 0)
                head = token[np.lexsort((token, cost))][: n - int(np.ceil(SIMILAR * n - 1e-6)) + 1]
                k = len(head)
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(np.full(k, node)), pa.array(np.full(k, n)), pa.array(np.arange(k))], ["token", "node", "n", "pos"])

    return run


def rest_of_buckets(buckets: DataFrame, sequences: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): of the texts in big buckets that hold several components, all pairs between components that may reach SIMILAR.

    A superset of such pairs: each pair of similarity SIMILAR shares a shingle of both prefixes, at positions that leave enough.
    """
    import numpy as np

    big = buckets.where(F.col("size") > WINDOW + 1).select("band", "key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = big.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y"))
    still = common.materialize(big.join(mixed, ["band", "key"], "left_semi").select("node", "label").distinct(), "open")
    open_sequences = sequences.join(still, "node")
    seen = common.bounded_sample(still, "node", RARITY_TEXTS).select("node")
    often = sequences.join(seen, "node", "left_semi").select("seq").mapInArrow(_labels, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    often = sorted((r["token"], r["k"]) for r in often.where(F.col("k") > 2).orderBy(F.desc("k"), "token").limit(RARITY_LIST).collect())
    listed = buckets.sparkSession.sparkContext.broadcast((np.array([t for t, _ in often], "i8"), np.array([k for _, k in often], "i8")))
    heads = open_sequences.select("node", "seq").mapInArrow(_prefixes(listed), "token long, node long, n long, pos long")
    heads = common.materialize(heads.join(still, "node"), "prefixes")
    hot = common.materialize(heads.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK), "hot")
    heads = heads.join(F.broadcast(hot) if common.is_small(hot, HOT_LIST) else hot, "token", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int"))
    heads = heads.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda x, y, c: heads.select("token", F.col(x).alias("x"), F.col(y).alias("y"), F.col("node").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in ("n", "pos", "label")])
    pairs = side("own", "other", "a").join(side("other", "own", "b"), ["token", "x", "y"])
    enough = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= SIMILAR / (1 + SIMILAR) * (F.col("n_a") + F.col("n_b")) - 1e-6
    near = F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b") - 1e-6
    return pairs.where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & near & enough).select("a", "b").distinct()


def filled_buckets(sketches: DataFrame) -> DataFrame:
    """sketches (node, n, bands) -> (band, key, node, n, next1, next2, size) of the buckets of two texts or more."""
    index = F.posexplode("bands")
    rows = sketches.where(F.col("n") > 0).select("node", "n", "bands", index.alias("band", "key"))
    after = lambda j: F.get("bands", (F.col("band") + j) % BANDS)
    rows = rows.select("node", "n", "band", "key", after(1).alias("next1"), after(2).alias("next2"))
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return common.materialize(rows.join(sizes, ["band", "key"]), "buckets")


def candidates(rows: DataFrame) -> DataFrame:
    """filled_buckets -> (a, b, votes): pairs with a < b, and in how many places they met."""
    company = rows.groupBy("node").agg(F.sum(F.log2("size")).alias("company"))
    hubs = rows.join(company, "node").groupBy("band", "key").agg(F.max(F.struct(F.round("company", 6).alias("c"), (-F.col("node")).alias("x"), F.col("n").alias("n"))).alias("h"))
    hubs = hubs.select("band", "key", (-F.col("h.x")).alias("other"), F.col("h.n").alias("m"))
    to_hub = rows.join(hubs, ["band", "key"]).select("node", "n", "other", "m")
    rows = rows.withColumn("cut", F.when(F.col("size") <= SPLIT, 0).otherwise(F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("size") / SPLIT))))
    order = Window.partitionBy("band", "key", "cut").orderBy("next1", "next2", "node")
    before = F.array(*[F.struct(F.lag("node", j).over(order).alias("other"), F.lag("n", j).over(order).alias("m")) for j in range(1, WINDOW + 1)])
    chained = rows.select("node", "n", before.alias("before")).select("node", "n", F.explode("before").alias("p")).select("node", "n", "p.other", "p.m")
    pairs = to_hub.unionByName(chained).where(F.col("other").isNotNull() & (F.col("other") != F.col("node")))
    pairs = pairs.where(F.least("n", "m") >= SIMILAR * F.greatest("n", "m"))
    return pairs.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.count(F.lit(1)).alias("votes"))


def classed(df: DataFrame) -> DataFrame:
    """(doc_id, blob, class_id, chosen): blob is the hash of the text, class_id the least doc_id of its class of exact and near
    copies, and chosen is true for one text of each class under its least doc_id."""
    docs = common.documents(df).withColumn("blob", F.unhex(F.sha2("text", 256)))
    sketched = docs.mapInArrow(_sketches, "doc_id long, blob binary, n long, bands array<long>")
    # one row per distinct text; texts without words stay apart
    rows = common.materialize(sketched, "sketches")
    nodes = rows.where(F.col("n") > 0).groupBy("blob").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.min("bands").alias("bands"))
    nodes = common.materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = filled_buckets(nodes.select("node", "n", "bands"))
    pairs = common.materialize(candidates(buckets), "pairs")
    big = buckets.where(F.col("size") > WINDOW + 1).select("node")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(big).distinct().join(nodes.select("node", "first", F.col("blob").alias("_b")), "node")
    # copies spread by their doc_id; one of them is enough
    texts = docs.join(met, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("_b"))).select("node", "text")
    sequences = common.materialize(texts.mapInArrow(_sequences, "node long, seq binary").dropDuplicates(["node"]), "sequences")
    best = Window.partitionBy("b").orderBy(F.desc("votes"), "a")
    first = pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == 1)
    links = common.materialize(verified(first, sequences), "links")
    labels = components(links)
    side = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    rest = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti").join(side("a", "la"), "a", "left").join(side("b", "lb"), "b", "left")
    rest = rest.where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    links = common.materialize(links.unionByName(verified(rest, sequences)), "links")
    labels = components(links)
    last = common.materialize(verified(rest_of_buckets(buckets, sequences, labels), sequences), "links")
    if last.limit(1).count():
        labels = components(links.unionByName(last))
    members = nodes.select("blob", "node", "first").join(labels, "node", "left").select("blob", "first", F.coalesce("label", "node").alias("label"))
    named = members.groupBy("label").agg(F.min("first").alias("class_id"), F.min(F.struct(F.col("first").isNull(), "first", "blob")).getField("blob").alias("best"))
    classes = members.join(named, "label").select("blob", "first", "class_id", (F.col("blob") == F.col("best")).alias("best"))
    full = F.col("n") > 0
    return rows.select("doc_id", "blob", "n").join(classes, "blob", "left").select(
        "doc_id",
        "blob",
        F.when(full, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(full, F.col("best") & F.col("doc_id").eqNullSafe(F.col("first"))).otherwise(True).alias("chosen"),
    )


def near_classes(df: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row."""
    return classed(df).select("doc_id", "class_id")


def representatives(df: DataFrame) -> DataFrame:
    """Rows of df, one of each class: all its columns, and rows equal in doc_id and text once."""
    key = lambda text: F.concat_ws("/", text, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = classed(df).where(F.col("chosen")).select(key(F.lower(F.hex("blob"))).alias("_key")).distinct()
    rows = common.carry(df).withColumn("_key", key(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return common.restore(rows.join(chosen, "_key", "left_semi").dropDuplicates(["_key"]), df.columns)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(common.read(spark, sf_dir, "documents"))
