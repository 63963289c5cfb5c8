"""Ranked lexical search over bit-sliced Bloom signatures.

Index.  A document's signature is a Bloom filter of its terms; a term that occurs 2^j times or more is also entered at levels 1
to j (at most LEVELS - 1), so that a signature bounds how often a term occurs.  Documents are grouped into blocks by the size of
their signatures, a power of two that follows the number of entries, so that long documents are as selective as short ones.  A
block is stored bit-sliced: for each signature bit a bitmap over the block's documents.  The index also holds, for every term,
in how many documents it occurs.  It depends on the documents alone and is written once to the shared folder.

Search.  For a block the slices of a term's bits are ANDed to a bitmap of the documents that may hold it.  Each level's bitmaps
times the terms' weights, summed over an item's terms and multiplied by what that level can add to a score, give an upper bound
of every document's score, in exact integers.  First the SEEDS documents of the highest bounds of each item are scored exactly;
the top-th best of these scores (and its doc_id) is a floor.  Then every document whose bound isn't below the floor is scored
exactly.  Bloom filters have no false negatives, so no document of the result is ever excluded.

Items go through in slices of at most ITEMS_IN_A_SLICE, so that what is broadcast (their terms and weights) is bounded; the
documents to be scored are joined by broadcast where they are few, else by a shuffle.

Score.  As stated at `score`; integers only, but for the terms' weights, which are floors of a logarithm in doubles.

Cases: null texts and texts without terms are in no block and in no result; items without terms, or whose terms occur nowhere,
give no rows; rows of one item_id are one item with the terms of all of them; a null item_id or doc_id is an id like any other
(null documents rank first among equal scores); repeated rows of a document are ranked one by one; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common, tokens

TOP, SEEDS = 10, 20
LEVELS, HASHES, BITS_AN_ENTRY, LEAST_BITS = 4, 4, 8, 64
BLOCK_DOCS, BLOCK_CELLS, CELLS = 1024, 1 << 23, 1 << 24
VOCABULARY = 200_000
ITEMS_IN_A_SLICE, TERMS_IN_A_SLICE, FEW_DOCS = 500, 20_000, 20_000
MIX_A, MIX_B, MIX_C = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
#: Bytes of terms stay, A-Z as a-z; all others separate terms.
TERM_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX_SCHEMA = "bits int, doc_ids array<long>, keys array<long>, n array<long>, most array<long>, slices binary, term string, df long"


def _mix(x):
    """The finisher of splitmix64, on uint64 arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def term_hashes(terms: list[str]):
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t) for t in terms], "u8")


def places(hashes, level):
    """uint64 [entries, HASHES]: where an entry (hash of a term, level) sets bits, before the size of the signature is known."""
    import numpy as np

    with np.errstate(over="ignore"):
        entry = _mix(hashes + np.asarray(level, "u8") * np.uint64(MIX_C))
        return np.stack([_mix(entry + np.uint64(j + 1) * np.uint64(MIX_B)) for j in range(HASHES)], -1)


def counted(texts):
    """Arrow strings without nulls -> (distinct terms, document of each pair, term of each pair, how often): pairs by document, then term."""
    import numpy as np
    import pyarrow.compute as pc

    split = pc.split_pattern(tokens.translated(texts, TERM_BYTES), " ")
    coded = pc.dictionary_encode(split.flatten())
    terms = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy().astype("i8")
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    if "" in terms:
        real = code != terms.index("")
        code, owner = code[real], owner[real]
    pair, times = np.unique(owner * (len(terms) + 1) + code, return_counts=True)
    return terms, pair // (len(terms) + 1), pair % (len(terms) + 1), times


def levels(times):
    """The highest level that a term of so many occurrences enters."""
    import numpy as np

    return np.minimum(np.log2(np.maximum(times, 1)).astype("i8"), LEVELS - 1)


def signature_bits(entries):
    """A power of two of at least BITS_AN_ENTRY bits an entry."""
    import numpy as np

    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(entries, 1) * BITS_AN_ENTRY)).astype("i8"))


def sliced(bits: int, docs: list):
    """The slices of documents, each an array of bit numbers: packed [bits, documents / 8]."""
    import numpy as np

    cells = np.zeros((bits, -(-len(docs) // 8) * 8), bool)
    for i, at in enumerate(docs):
        cells[at, i] = True
    return np.packbits(cells, axis=1, bitorder="little")


def _index(batches: Iterator) -> Iterator:
    """Rows of two kinds: blocks, and (term, number of documents in this task, or in a part of it)."""
    import numpy as np
    import pyarrow as pa

    open_blocks: dict[int, list] = defaultdict(list)
    df: dict[str, int] = defaultdict(int)
    types = dict(zip([c.split()[0] for c in INDEX_SCHEMA.split(", ")], [pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.string(), pa.int64()]))

    def rows(how_many: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(how_many, t) for c, t in types.items()], list(types))

    def block(bits: int):
        docs = open_blocks.pop(bits)
        ids, keys, n, most, at = zip(*docs)
        return rows(1, bits=[bits], doc_ids=[ids], keys=[keys], n=[n], most=[most], slices=[sliced(bits, at).tobytes()])

    def vocabulary():
        out = rows(len(df), term=list(df), df=list(df.values()))
        df.clear()
        return out

    for batch in tokens.runs(batches, most=2_000_000):
        terms, owner, term, times = counted(batch.column("text"))
        in_docs = np.bincount(term, minlength=len(terms))
        for t, k in zip(terms, in_docs.tolist()):
            if k:
                df[t] += k
        if len(df) > VOCABULARY:
            yield vocabulary()
        hashes, level = term_hashes(terms), levels(times)
        entry = np.repeat(np.arange(len(term)), level + 1)
        number = tokens.ranges(np.zeros(len(level), "i8"), level + 1)
        at = places(hashes[term[entry]], number)
        doc, begin = np.unique(owner[entry], return_index=True)
        sizes = signature_bits(np.diff(np.r_[begin, len(entry)])).tolist()
        first = np.searchsorted(owner, doc)
        n, most = (np.add.reduceat(times, first), np.maximum.reduceat(times, first)) if len(doc) else (first, first)
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
        for i, bits, n_i, most_i, a, b in zip(doc.tolist(), sizes, n.tolist(), most.tolist(), begin.tolist(), [*begin[1:].tolist(), len(entry)]):
            where = np.unique(at[a:b].reshape(-1) & np.uint64(bits - 1)).astype("u4")
            open_blocks[bits].append((ids[i], keys[i], n_i, most_i, where))
            if len(open_blocks[bits]) >= max(8, min(BLOCK_DOCS, BLOCK_CELLS // bits)):
                yield block(bits)
    for bits in list(open_blocks):
        yield block(bits)
    if df:
        yield vocabulary()


def build_index(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, vocabulary: term, df), read from one table that is written to the shared folder."""
    docs = common.documents(df).withColumn("key", common.row_key())
    index = common.materialize(docs.mapInArrow(_index, INDEX_SCHEMA), "signatures")
    vocabulary = index.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    return index.where(F.col("bits").isNotNull()).drop("term", "df"), vocabulary


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term), distinct: item is a number for item_id.  Native: items are few beside documents."""
    found = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(f"({TERM})")), lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return items.select(F.col(id_col).alias("item_id"), F.explode(found).alias("term")).distinct()


def score(tf: int, w: int, m: int) -> int:
    """What a term of weight w adds: tf occurrences in a document whose length counts as m."""
    return w * (1_000_000_000 * tf // (1_000 * tf + 8 * m))


class Slice:
    """Items and the terms they share: weights, and the pairs of both by item."""

    def __init__(self, rows: list, documents: int, length: int):
        import numpy as np

        self.terms = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        weight = {r["term"]: r["w"] for r in rows}
        self.weights = np.array([weight[t] for t in self.terms], "i8")
        self.items = sorted({r["item"] for r in rows})
        place = {x: i for i, x in enumerate(self.items)}
        pairs = sorted((place[r["item"]], number[r["term"]]) for r in rows)
        self.pair_item, self.pair_term = (np.array(x, "i8") for x in zip(*pairs))
        self.heaviest = int(np.bincount(self.pair_item, self.weights[self.pair_term]).max())
        self.begin = np.searchsorted(self.pair_item, np.arange(len(self.items)))
        self.documents, self.length = documents, length
        self.places = np.stack([places(term_hashes(self.terms), j) for j in range(LEVELS)])  # [levels, terms, hashes]

    def m(self, n):
        return 10 + 90 * n * self.documents // self.length

    def bounds(self, bits: int, n, most, slices):
        """int64 [items, documents]: an upper bound of each document's score for each item."""
        import numpy as np

        table = np.frombuffer(slices, "u1").reshape(bits, -1)
        m, total, there = self.m(n), np.zeros((len(self.items), len(n)), "i8"), None
        before = np.zeros(len(n), "i8")
        for level in range(LEVELS):
            here = np.bitwise_and.reduce(table[(self.places[level] & np.uint64(bits - 1)).astype("i8")], axis=1)
            there = here if there is None else here & there
            pairs = np.flatnonzero(there.any(axis=1)[self.pair_term])
            if not len(pairs):
                break
            # a document whose signature has the term up to this level, but not the next one, has it less than 2^(level + 1) times
            tf = np.minimum(most, 2 ** (level + 1) - 1) if level < LEVELS - 1 else most
            gain = np.maximum(1_000_000_000 * tf // (1_000 * tf + 8 * m), before)
            items, begin = np.unique(self.pair_item[pairs], return_index=True)
            term, step = self.pair_term[pairs], max(1, CELLS // (8 * len(pairs)))
            weight = self.weights[term].astype("i4" if self.heaviest < 1 << 31 else "i8")[:, None]
            for at in range(0, there.shape[1], step):
                bitmap = np.unpackbits(there[:, at : at + step], axis=1, count=min(8 * step, len(n) - 8 * at), bitorder="little")
                docs = slice(8 * at, 8 * at + bitmap.shape[1])
                total[items, docs] += np.add.reduceat(bitmap[term] * weight, begin, axis=0) * (gain - before)[docs]
            before = gain
        return total


def _blocks(batches: Iterator, part) -> Iterator:
    """Each block of the batches with its bounds."""
    import numpy as np

    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i] for c in batch.schema.names}
            n, most = (r[c].values.to_numpy() for c in ("n", "most"))
            ids = r["doc_ids"].values
            yield ids, r["keys"].values.to_numpy(), part.bounds(r["bits"].as_py(), n, most, r["slices"].as_buffer())


def _seeds(sent, seeds: int):
    """The documents of the highest bounds of each item in this task."""

    def run(batches: Iterator) -> Iterator:
        import heapq

        import numpy as np
        import pyarrow as pa

        part, best = sent.value, defaultdict(list)
        for ids, keys, bounds in _blocks(batches, part):
            k = min(seeds, bounds.shape[1])
            top = np.argpartition(-bounds, k - 1, axis=1)[:, :k]
            names = ids.to_pylist()
            for item, row in enumerate(top):
                for d in row.tolist():
                    b = int(bounds[item, d])
                    if b > 0:
                        entry = (b, names[d] is not None, names[d] or 0, int(keys[d]))
                        (heapq.heappush if len(best[item]) < seeds else heapq.heappushpop)(best[item], entry)
        out = [(part.items[item], b, d if there else None, key) for item, heap in best.items() for b, there, d, key in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[]] * 4)], ["item", "bound", "doc_id", "key"])

    return run


def _standing(sent, floors):
    """(doc_id, key, items): the documents that the floors don't exclude."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part = sent.value
        least = np.array([max(1, floors.get(x, (1, None))[0]) for x in part.items], "i8")[:, None]
        last = np.array([floors[x][1] if x in floors and floors[x][1] is not None else np.iinfo("i8").max for x in part.items], "i8")[:, None]
        items = np.array(part.items, "i8")
        for ids, keys, bounds in _blocks(batches, part):
            named = ids.fill_null(np.iinfo("i8").min).to_numpy()
            stands = (bounds > least) | ((bounds == least) & (named <= last))
            doc = np.flatnonzero(stands.any(0))
            flat = [items[stands[:, d]] for d in doc]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in flat])].astype("i4")), pa.array(np.concatenate([*flat, np.zeros(0, "i8")])))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(keys[doc]), lists], ["doc_id", "key", "items"])

    return run


def _scores(sent, top: int):
    """(item, doc_id, score): exact scores of a document's listed items, from its text; the best of each item in this task."""

    def run(batches: Iterator) -> Iterator:
        import heapq

        import numpy as np
        import pyarrow as pa

        part, best = sent.value, defaultdict(list)
        number = {t: i for i, t in enumerate(part.terms)}
        own = {x: part.pair_term[a:b] for x, a, b in zip(part.items, part.begin.tolist(), [*part.begin[1:].tolist(), len(part.pair_term)])}
        for batch in tokens.runs(batches, most=2_000_000):
            terms, owner, term, times = counted(batch.column("text"))
            known = np.array([number.get(t, -1) for t in terms] + [-1], "i8")[term]
            begin, end = np.searchsorted(owner, np.arange(batch.num_rows)), np.searchsorted(owner, np.arange(batch.num_rows), "right")
            for i, (d, items) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("items").to_pylist())):
                tf = np.zeros(len(part.terms), "i8")
                here, often = known[begin[i] : end[i]], times[begin[i] : end[i]]
                tf[here[here >= 0]] = often[here >= 0]
                m = part.m(int(often.sum()))
                adds = part.weights * (1_000_000_000 * tf // (1_000 * tf + 8 * m))
                for x in items:
                    s = int(adds[own[x]].sum())
                    if s > 0:
                        entry = (s, d is None, -(d or 0))
                        (heapq.heappush if len(best[x]) < top else heapq.heappushpop)(best[x], entry)
        out = [(x, None if none else -d, s) for x, heap in best.items() for s, none, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[]] * 3)], ["item", "doc_id", "score"])

    return run


def exact(docs: DataFrame, wanted: DataFrame, sent, top: int) -> DataFrame:
    """(item, doc_id, score) of the best documents of `wanted` (doc_id, key, items); docs has doc_id, text and key."""
    wanted = common.materialize(wanted.dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "items"), "standing")
    side = F.broadcast(wanted) if common.is_small(wanted, FEW_DOCS) else wanted
    found = docs.join(side, F.col("key").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "text", "items")
    return found.mapInArrow(_scores(sent, top), "item long, doc_id long, score long")


def best_of(scored: DataFrame, top: int) -> DataFrame:
    """The rows of rank 1 to top of each item, with rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(df: DataFrame, items: DataFrame, top: int = TOP, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents; `index` is that of df, built here where none is given."""
    spark = df.sparkSession
    blocks, vocabulary = index or build_index(df)
    docs = common.documents(df).withColumn("key", common.row_key())
    wanted = item_terms(items)
    size = blocks.agg(F.sum(F.size("doc_ids")).alias("n"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("length")).first()
    empty = spark.createDataFrame([], f"item_id {dict(wanted.dtypes)['item_id']}, rank int, doc_id long, score long")
    if not size["n"]:
        return empty
    w = F.floor(1000 * F.log((2 * F.lit(size["n"]) + 2) / (2 * F.col("df") + 1)))
    # numbered by id: a slice holds items of neighbouring numbers
    numbers = wanted.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id())
    numbers = common.materialize(numbers, "items")
    weighed = common.materialize(wanted.join(vocabulary, "term").join(numbers.withColumnRenamed("item_id", "_i"), F.col("item_id").eqNullSafe(F.col("_i"))).select("item", "term", w.alias("w")), "weights")
    parts = []
    for rows in slices_of(weighed):
        sent = spark.sparkContext.broadcast(Slice(rows, size["n"], size["length"]))
        seeds = blocks.mapInArrow(_seeds(sent, SEEDS), "item long, bound long, doc_id long, key long")
        nth = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "key")
        seeds = seeds.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= SEEDS)
        seeds = seeds.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))  # at most SEEDS rows an item
        floors = best_of(exact(docs, seeds, sent, top), top).where(F.col("rank") == top)
        floors = {r["item"]: (r["score"], r["doc_id"]) for r in floors.collect()}  # one row for each item of the slice
        standing = blocks.mapInArrow(_standing(sent, floors), "doc_id long, key long, items array<long>")
        parts.append(common.materialize(best_of(exact(docs, standing, sent, top), top), "ranked"))
    if not parts:
        return empty
    ranked = parts[0]
    for x in parts[1:]:
        ranked = ranked.unionByName(x)
    return ranked.join(numbers, "item").select("item_id", "rank", "doc_id", "score")


def slices_of(weighed: DataFrame) -> Iterator[list]:
    """Rows of (item, term, w) by items: at most ITEMS_IN_A_SLICE of them at a time, fewer where they have more than TERMS_IN_A_SLICE terms.

    What comes to the driver at once is one slice; a single item of more terms is a slice of its own.
    """
    rows, items = [], set()
    for r in weighed.orderBy("item", "term").toLocalIterator():
        if r["item"] not in items:
            if rows and (len(items) >= ITEMS_IN_A_SLICE or len(rows) >= TERMS_IN_A_SLICE):
                yield rows
                rows, items = [], set()
            items.add(r["item"])
        rows.append(r)
    if rows:
        yield rows


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
w AS (SELECT q.item_id, q.term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term) CROSS JOIN c),
s AS (SELECT w.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * d.n * c.docs) // c.len))))::BIGINT AS score
  FROM w JOIN tf USING (term) JOIN d USING (doc_id) CROSS JOIN c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
