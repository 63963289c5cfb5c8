"""Clustering, best-fit-decreasing packing and ranked search against brute force, with the odd cases of each."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from fieldloom.llm import centroids, search, windows

# --- clustering ------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v string, apex string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)


def brute_clusters(rows, n, k, rounds):
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centre = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centre = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centre)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), centre


@pytest.mark.parametrize("seed", range(3))
def test_clusters_brute_force(spark, seed):
    random.seed(seed)
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    point = lambda: [f32(random.gauss(0, 0.3)) for _ in range(8)]
    rows = [(i, point()) for i in range(120)] + [(200 + i, [0.5] * 8) for i in range(60)] + [(300 + i, [f32(0.5 + random.gauss(0, 1e-3)) for _ in range(8)]) for i in range(30)]
    assigned, found = centroids.cluster(vectors(spark, rows), components=8, k=12, rounds=4, pivots=5)
    want, centre = brute_clusters(rows, 8, 12, 4)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in assigned.collect()) == want and found.tolist() == centre


def test_clusters_odd_vectors(spark):
    rows = [(1, None), (2, [1.0] * 7), (3, [1.0] * 7 + [None]), (4, [float("nan")] * 8), (5, [float("inf")] * 8), (6, [3e38] * 8), (7, [-3e38] * 8), (None, [0.1] * 8), (None, [0.1] * 8), (8, [0.0] * 8), (8, [0.25] * 8)]
    assigned, found = centroids.cluster(vectors(spark, rows), components=8, k=4, rounds=2)
    want, centre = brute_clusters(rows, 8, 4, 2)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in assigned.collect()) == want and found.tolist() == centre and len(want) == 6
    same, one = centroids.cluster(vectors(spark, [(i, [0.5] * 8) for i in range(9)]), components=8, k=4)
    assert {(r.cluster, r.distance) for r in same.collect()} == {(0, 0)} and len(one) == 4
    none, empty = centroids.cluster(vectors(spark, [(1, None)]), components=8)
    assert none.count() == 0 and len(empty) == 0


def test_simplex_bounds_hold_and_exclude():
    import numpy as np

    rng = np.random.default_rng(4)
    middle = rng.normal(0, 60, (20, 64))
    v = (middle[rng.integers(0, 20, 500)] + rng.normal(0, 10, (500, 64))).astype("i8")
    s = centroids.Simplex(middle.astype("i8"), 12)
    near = centroids.candidates(s.apexes(v), s.apexes(middle.astype("i8")))
    exact = ((v[:, None] - middle.astype("i8")[None]) ** 2).sum(2)
    assert near[np.arange(500), exact.argmin(1)].all() and near.sum() < 500 * 10


def test_op11_query(spark, tmp_path):
    rows = [(i, [random.Random(i).gauss(0, 0.2) for _ in range(64)]) for i in range(90)] + [(99, [1.0])]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op11_simplex_clusters(spark, str(tmp_path)).collect()
    assert len(got) == 90 and {r.inertia for r in got} == {sum(r.distance for r in got)}
    assert all(r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster) for r in got)
    assert all(len({r.centroid_sha256 for r in got if r.cluster == c}) == 1 for c in {r.cluster for r in got})
    vectors(spark, []).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert centroids.op11_simplex_clusters(spark, f"{tmp_path}/none").count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, length string, rank int"
ODD = [None, "", " ", "\n\n", "a", "a\n" * 3000 + "end", "x" * 40000, "word " * 9000, "Ünï\tcode　中文 text\r\nİI ŉ don't it's 12.5kg a.b,c!!", "same text here", "same text here", "<|endoftext|> x<|startoftext|>", "\x01 a\x01b", "é é ſK Å Ω ﬁ", "a.<b>;c"]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, "k", "l", 7) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def held(rows, capacity):
    """Fills of the sequences, which must be gapless."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        fills.append(end)
    return fills


def check_pieces(texts, ids, rows, capacity=windows.CAPACITY):
    tokenizer = Tokenizer.from_file(windows.TOKENIZER)
    whole = Counter()
    for t in texts:
        tokens = [*tokenizer.encode(t or "", add_special_tokens=False).ids, windows.END_ID]
        whole[tuple(tokens)] += 1
    for i, t in zip(ids, texts):
        if list(ids).count(i) == 1:
            tokens, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, windows.END_ID], 0
            for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(tokens) and r.ids_crc32 == crc(tokens[at : at + r.length])
                at += r.length
            assert at == len(tokens)
    assert sum(r.length for r in rows) == sum(len(t) * n for t, n in whole.items())
    padding = sum(0 if f & (f - 1) == 0 else capacity - f for f in held(rows, capacity))
    assert padding <= windows.SPARE * len(rows)


def test_windows_of_odd_texts(spark):
    rows = windows.pack(table(spark, ODD)).collect()
    check_pieces(ODD, range(len(ODD)), rows)


def test_windows_cut_anew(spark):
    random.seed(5)
    texts = [" ".join(random.choice("alpha beta gamma delta, 12 x-ray".split(" ")) for _ in range(random.choice([3, 40, 70, 90]))) for _ in range(80)]
    rows = windows.pack(table(spark, texts), capacity=128).collect()
    check_pieces(texts, range(80), rows, 128)
    fills = held(rows, 128)
    assert all(f >= 120 or f & (f - 1) == 0 for f in fills)


def test_windows_of_repeated_and_null_ids(spark):
    rows = windows.pack(table(spark, ["a b", "a b", "c", "d"], [None, None, 3, 3])).collect()
    check_pieces(["a b", "a b", "c", "d"], [None, None, 3, 3], rows)
    assert Counter(r.doc_id for r in rows) == Counter([None, None, 3, 3])
    assert windows.pack(table(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_decreasing_is_piece_by_piece(seed):
    random.seed(seed)
    capacity = random.choice([10, 64, 2048])
    lengths = [random.randint(1, capacity if random.random() < 0.5 else max(1, capacity // 4)) for _ in range(random.randint(0, 300))]
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit)[1]] -= x
        else:
            rooms.append(capacity - x)
    packed = windows.best_fit_decreasing(Counter(lengths), capacity)
    assert sorted(rooms) == sorted(capacity - sum(a * b for a, b in items) for k, items in packed for _ in range(k))
    assert Counter(lengths) == sum((Counter({a: k * b}) for k, items in packed for a, b in items), Counter())


def test_rooms():
    tree = windows.Rooms(12)
    for room in (0, 3, 12):
        tree.mark(room, True)
    assert [tree.tightest(x) for x in (0, 1, 3, 4, 12)] == [0, 3, 3, 12, 12]
    tree.mark(12, False)
    assert tree.tightest(4) is None


def test_op12_query(spark, tmp_path):
    texts = ["one two three"] * 30 + [None, "word " * 5000]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    check_pieces(texts, range(32), windows.op12_best_fit_decreasing(spark, str(tmp_path)).collect())


# --- search ----------------------------------------------------------------------------------------------------------------

TERM = re.compile(search.TERM)


def terms(t):
    return TERM.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_search(docs, items, top):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    full = [(d, c) for d, c in counts if c]
    n_docs, length = len(full), sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c in full:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(str(i), rank, str(d if there else None), -s) for rank, (s, there, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "item_id long, text string, term string, item string")


@pytest.mark.parametrize("seed", range(3))
def test_search_brute_force(spark, seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "中文", "A1", "a1"]
    text = lambda n: random.choice([" ", "-", "\n"]).join(random.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=n))
    docs = [(i, text(random.choice([1, 5, 30, 300]))) for i in range(150)] + [(200 + i, "w1 w2 W3 same") for i in range(40)] + [(None, "w1 w2"), (None, None), (7, "w5 w5"), (7, "w5 w5"), (300, ""), (301, "!!! ."), (302, "w9 " * 20000)]
    items = [(i, text(6)) for i in range(12)] + [(20, "same w3"), (21, None), (22, "nowhere"), (23, ""), (None, "w2"), (24, "w4"), (24, "w6")]
    got = search.search(table(spark, [t for _, t in docs], [i for i, _ in docs]), items_table(spark, items)).collect()
    assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got) == brute_search(docs, items, 10)


def test_search_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS_IN_A_SLICE", 2)
    monkeypatch.setattr(search, "BLOCK_DOCS", 8)
    monkeypatch.setattr(search, "FEW_DOCS", 1)
    monkeypatch.setattr(search, "SEEDS", 1)
    docs = [(i, f"a{i % 7} b{i % 5} c") for i in range(60)]
    items = [(i, f"a{i} b{i} c") for i in range(5)]
    got = search.search(table(spark, [t for _, t in docs]), items_table(spark, items), top=4).collect()
    assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got) == brute_search(docs, items, 4)


def test_search_of_nothing(spark):
    docs, items = table(spark, ["a b", None]), items_table(spark, [(1, "a")])
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(table(spark, [None, "--"]), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 0)]


def test_bounds_are_never_below_scores(spark):
    import numpy as np

    random.seed(9)
    docs = [" ".join(random.choices([f"t{i}" for i in range(40)], k=random.choice([3, 50, 400]))) for _ in range(70)]
    blocks, vocabulary = search.build_index(table(spark, docs))
    df = {r.term: r.df for r in vocabulary.collect()}
    assert df == Counter(t for d in docs for t in set(terms(d)))
    rows = [{"item": i, "term": f"t{j}", "w": 100 + j} for i in range(5) for j in range(i, 40, 5)]
    part = search.Slice(rows, len(docs), sum(len(terms(d)) for d in docs))
    seen = 0
    for b in blocks.collect():
        bound = part.bounds(b.bits, np.array(b.n), np.array(b.most), b.slices)
        for column, d in enumerate(b.doc_ids):
            c = Counter(terms(docs[d]))
            exact = [sum(search.score(c[r["term"]], r["w"], part.m(b.n[column])) for r in rows if r["item"] == i and c[r["term"]]) for i in range(5)]
            assert (bound[:, column] >= exact).all()
            seen += 1
    assert seen == 70


def test_op13_query(spark, tmp_path):
    docs, items = [(i, f"x{i % 3} y") for i in range(30)], [(0, "x1 y"), (1, "x2")]
    table(spark, [t for _, t in docs]).write.parquet(f"{tmp_path}/documents.parquet")
    items_table(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = search.op13_bit_sliced_search(spark, str(tmp_path))
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got.collect()) == brute_search(docs, items, 10)


def test_translated_slices():
    import pyarrow as pa

    from fieldloom.llm import tokens

    texts = pa.array(["A b", "", "Ünï\tX", "z"])
    assert tokens.translated(texts.slice(1, 2), search.TERM_BYTES).to_pylist() == ["", "Ünï x"]
    assert tokens.translated(texts.slice(0, 0), windows.BLANKED).to_pylist() == []
