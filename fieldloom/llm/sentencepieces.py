"""SentencePiece encoding and decoding by a max-plus parallel scan.

The public vocabulary is read as a unigram lattice: a segmentation's score is the sum of its pieces' scores, integers that fall
with the log of the piece's rank, and the best segmentation wins (of equals, the one whose last pieces are longest).  Integer
scores make max-plus products exactly associative.

A blank after a non-blank always starts a piece, so between two such places only distinct words have to be segmented.  Arrow
dictionary-encodes a batch's words, and those that a worker hasn't seen go through the lattice together, numpy moving words of
one length from place to place.

A document of up to CHUNK code points is segmented in place.  A longer one is cut into chunks dealt over all tasks.  The state at
a chunk's edge is how far the last piece hangs over it, 0 to LONGEST - 1; each chunk yields the matrix of best scores from
state to state, and the ids between its first and last place where a piece must start, which hold in any state.  Matrices are
multiplied in blocks of BLOCK, blocks of blocks, and so on; going back down, every chunk learns its entry scores.  Each chunk
then maps exit states to entry states, these maps are composed the same way from the end, and with its exit state known each
chunk's two rims are traced back on their own.

Scores come from ranks because the file is a BPE model whose stored scores are negated ranks, whose sums would favour single
letters; encoding thus equals the library's unigram mode under these scores, not its BPE merges.

Cases: a null or empty text has no ids; characters outside the vocabulary become byte pieces; U+2581 decodes to a blank, as in
the library; equal rows stay separate; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CHUNK, BLOCK, LONGEST = 16_384, 32, 16
NONE = -(1 << 60)
TABLE_WORDS, TOGETHER = 400_000, 48
CHUNK_ROWS, DECODE_IDS = 64, 2_000_000
SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
EDGE = re.compile(f"(?<=[^{SPACE}]){SPACE}")
#: Texts that a split at blanks doesn't cut into words.
ODD = f"^ |  |{SPACE}"
HASH, SLOT, SLOT_BITS = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 20


class PieceHashes:
    """Which piece a run of code points is, for arrays of runs given by their polynomial hashes."""

    def __init__(self, pieces: list[str]):
        import numpy as np

        key = np.zeros(len(pieces), "u8")
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = 0
                for c in p:
                    h = (h * HASH + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                key[i] = h
            slot = self.slot(key)
        self.key = np.r_[key, np.uint64(0)]  # a last row that nothing equals
        self.order = np.argsort(key)
        self.sorted = key[self.order]
        self.table = np.full(1 << SLOT_BITS, len(pieces), "i4")
        self.table[slot] = np.arange(len(pieces))
        count = np.bincount(slot, minlength=1 << SLOT_BITS)
        self.table[count > 1] = -1  # several pieces: looked up in the sorted keys

    @staticmethod
    def slot(key):
        import numpy as np

        return ((key ^ (key >> np.uint64(32))) * np.uint64(SLOT)) >> np.uint64(64 - SLOT_BITS)

    def find(self, key):
        """Index of the piece of each key, -1 where there is none."""
        import numpy as np

        at = self.table[self.slot(key)]
        many = np.flatnonzero(at < 0)
        if len(many):
            near = np.minimum(np.searchsorted(self.sorted, key[many]), len(self.sorted) - 1)
            at[many] = self.order[near]
        return np.where(self.key[at] == key, at, -1)


class Lattice(tokens.IdTable):
    """The unigram lattice; as a table it keeps the ids of words, named without the marker they start with."""

    def __init__(self, path: str = MODEL):
        import numpy as np
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(len(model))]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(len(model)) if model.is_byte(i)}
        self.bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        first = max(self.byte_ids.values(), default=2) + 1
        self.pieces = {p: (-round(1000 * math.log(i - first + 10)), i) for i, p in enumerate(self.names) if i >= first and not model.is_control(i)}
        self.lone = min(s for s, _ in self.pieces.values()) - 10_000
        short = {p: x for p, x in self.pieces.items() if 0 < len(p) <= LONGEST}
        self.hashes = PieceHashes(list(short))
        self.piece_score = np.array([*[x for x, _ in short.values()], self.lone], "i8")  # index -1: a character of its own
        self.piece_id = np.array([*[i for _, i in short.values()], -1], "i8")
        # a lone character's score is that of its first byte
        self.score_of = np.zeros(len(model), "i8")
        for score, i in self.pieces.values():
            self.score_of[i] = score
        for b, i in self.byte_ids.items():
            self.score_of[i] = 0 if 0x80 <= b < 0xC0 else self.lone
        raw = [self.bytes.get(i, n.replace(SPACE, " ").encode()) for i, n in enumerate(self.names)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), "u1"), np.array([len(x) for x in raw], "i8")
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        super().__init__(self.words, TABLE_WORDS)

    def forward(self, text: str, starts: int, entry: dict[int, int]) -> tuple[list[int], list[int]]:
        """Best score and first position of the last piece, for every place; pieces start at places below starts.

        entry: scores of places that are reached from before; their last piece starts at -1.
        """
        n = len(text)
        best, back = [NONE] * (n + 1), [-2] * (n + 1)
        for place, score in entry.items():
            if place <= n:
                best[place], back[place] = score, -1
        pieces, lone = self.pieces, self.lone
        for i in range(min(starts, n)):
            base = best[i]
            if base == NONE:
                continue
            for j in range(i + 1, min(i + LONGEST, n) + 1):
                hit = pieces.get(text[i:j])
                if hit is not None:
                    score = base + hit[0]
                elif j == i + 1:
                    score = base + lone
                else:
                    continue
                if score > best[j]:
                    best[j], back[j] = score, i
        return best, back

    def trace(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the path to end, and the place where it came in."""
        out: list[list[int]] = []
        while back[end] >= 0:
            piece = text[back[end] : end]
            hit = self.pieces.get(piece)
            out.append([hit[1]] if hit else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")])
            end = back[end]
        return [i for x in reversed(out) for i in x], end

    def matrix(self, text: str, starts: int):
        """forward() from each of the places 0 to LONGEST - 1: best scores [place where it came in, place]."""
        import numpy as np

        n, get = len(text), self.pieces.get
        best = np.full((n + 1, LONGEST), NONE)
        for r in range(min(LONGEST, n + 1)):
            best[r, r] = 0
        for i in range(min(starts, n)):
            for j in range(i + 1, min(i + LONGEST, n) + 1):
                hit = get(text[i:j])
                if hit is not None or j == i + 1:
                    np.maximum(best[j], best[i] + (hit[0] if hit else self.lone), out=best[j])
        best[best < NONE // 2] = NONE
        return best.T

    def word(self, text: str) -> list[int]:
        return self.trace(text, self.forward(text, len(text), {0: 0})[1], len(text))[0]

    def words(self, names):
        """Ids of distinct words (Arrow strings, each without its first marker), and the number of ids of each."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        full = pc.binary_join_element_wise(pa.scalar(SPACE, names.type), names, pa.scalar("", names.type))
        length = pc.utf8_length(full).to_numpy()
        order = np.argsort(length, kind="stable")
        length = length[order]
        codes = np.frombuffer("".join(full.take(pa.array(order)).to_pylist()).encode("utf-32-le"), "<u4").astype("u8")
        size, found, at = np.zeros(len(order), "i8"), [], 0
        alone = []
        for n in np.unique(length):
            rows = order[length == n]
            if n <= TOGETHER:
                one, ids, lost = self._same_length(codes[at : at + n * len(rows)].reshape(-1, n).T)
                size[rows] = one
                found.append((rows, ids))
                alone += rows[lost].tolist()
            else:
                alone += rows.tolist()
            at += n * len(rows)
        given = [self.word(full[i].as_py()) for i in alone]
        size[alone] = [len(x) for x in given]
        start, out = np.cumsum(size) - size, np.zeros(size.sum(), "<u4")
        gone = np.zeros(len(order), bool)
        gone[alone] = True
        for rows, ids in found:
            rows = rows[~gone[rows]]
            out[tokens.ranges(start[rows], size[rows])] = ids
        out[tokens.ranges(start[alone], size[alone])] = [i for x in given for i in x]
        return out, size

    def _same_length(self, codes):
        """Code points [place, word] -> (number of ids of each word, ids, words with a character outside the vocabulary, left out)."""
        import numpy as np

        length, n = codes.shape
        with np.errstate(over="ignore"):
            power, at = [np.uint64(1)], [np.zeros(n, "u8")]
            for c in codes:
                power.append(power[-1] * np.uint64(HASH))
                at.append(at[-1] * np.uint64(HASH) + c + np.uint64(1))
            best, size, last = np.zeros((length + 1, n), "i8"), np.zeros((length + 1, n), "i1"), np.zeros((length + 1, n), "i4")
            for j in range(1, length + 1):
                top = np.full(n, NONE)
                for k in range(min(LONGEST, j), 0, -1):
                    piece = self.hashes.find(at[j] - at[j - k] * power[k])
                    hit = np.flatnonzero(piece >= 0) if k > 1 else np.arange(n)
                    score = best[j - k][hit] + self.piece_score[piece[hit]]
                    up = score > top[hit]
                    hit = hit[up]
                    top[hit], size[j, hit], last[j, hit] = score[up], k, piece[hit]
                best[j] = top
        place, word, steps = np.full(n, length), np.arange(n), []
        lost = np.zeros(n, bool)
        count = np.zeros(n, "i8")
        while len(word):
            piece = last[place, word]
            lost[word[piece < 0]] = True
            count[word] += 1
            steps.append((word, self.piece_id[piece]))
            place = place - size[place, word]
            word, place = word[place > 0], place[place > 0]
        count[lost] = 0
        end = np.cumsum(count)
        out = np.zeros(count.sum(), "i8")
        for step, (word, ids) in enumerate(steps):
            good = ~lost[word]
            out[end[word[good]] - 1 - step] = ids[good]
        return count, out, lost

    def texts(self, texts, empty=None):
        """Arrow strings -> (ids of all texts, number of ids of each); `empty` says which have no ids, else those without a character."""
        import pyarrow as pa
        import pyarrow.compute as pc

        empty = pc.equal(pc.binary_length(texts), 0) if empty is None else empty
        odd = pc.or_(empty, pc.match_substring_regex(texts, ODD))
        cut = [[] if e else [w[1:] for w in WORD.findall(SPACE + t.replace(" ", SPACE))] for t, e in zip(texts.filter(odd).to_pylist(), empty.filter(odd).to_pylist())]
        return self.gather(merged(pc.split_pattern(texts, " "), odd, cut) if cut else pc.split_pattern(texts, " "))

    def encode(self, text: str | None) -> list[int]:
        import pyarrow as pa

        return self.texts(pa.array([text or ""]))[0].tolist()

    def decode(self, ids, size) -> list[str]:
        """The texts of lists of ids that lie in a row, size ids each."""
        import numpy as np

        n = self.raw_size[ids]
        data = self.raw[tokens.ranges(self.raw_start[ids], n)].tobytes()
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(size)]].tolist()
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip(ends, ends[1:])]


def merged(split, odd, cut: list[list[str]]):
    """Arrow lists, with those of `odd` rows put in from `cut`."""
    import numpy as np
    import pyarrow as pa

    odd = odd.to_numpy(zero_copy_only=False)
    both = pa.concat_arrays([split, pa.array(cut, split.type)])
    at = np.arange(len(split))
    at[odd] = len(split) + np.arange(len(cut))
    return both.take(pa.array(at))


_lattices: dict[str, Lattice] = {}


def lattice(path: str = MODEL) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def edges(text: str, size: int) -> tuple[int, int] | None:
    """The first and last place in the chunk where a piece must start."""
    found = [m.start() for m in EDGE.finditer(text, 0, size)]
    return (found[0], found[-1]) if found else None


def rims(text: str, size: int) -> tuple[str, str, str]:
    """A chunk before its first place where a piece must start, from there to the last one, and from there on; all before if there is none."""
    cut = edges(text, size)
    return (text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]) if cut else (text, "", "")


def over(best, place: int):
    """The last axis from place to place + LONGEST - 1, NONE beyond its end."""
    import numpy as np

    out = np.full(best.shape[:-1] + (LONGEST,), NONE)
    n = max(0, min(LONGEST, best.shape[-1] - place))
    out[..., :n] = best[..., place : place + n]
    return out


def transfer(lat: Lattice, head: str, middle: int, tail: str, size: int):
    """A chunk's matrix: best score from hanging over its start by r to hanging over its end by c.

    size counts the tail's characters that are the chunk's, or the head's if there is no tail; middle is a score.
    """
    import numpy as np

    if not tail:
        return over(lat.matrix(head, size), size)
    first = lat.matrix(head, len(head))[:, len(head)]
    last = over(np.array(lat.forward(tail, size, {0: 0})[0]), size)
    both = first[:, None] + middle + last[None, :]
    return np.where((first[:, None] > NONE) & (last[None, :] > NONE), both, NONE)


def came_from(lat: Lattice, head: str, whole: bool, size: int, entry: list[int]) -> list[int]:
    """The entry state for each exit state, -1 where there is none."""
    best, back = lat.forward(head, size if whole else len(head), {r: s for r, s in enumerate(entry) if s > NONE})
    if not whole:
        return [lat.trace(head, back, len(head))[1]] * LONGEST
    return [lat.trace(head, back, size + c)[1] if size + c < len(best) and best[size + c] > NONE else -1 for c in range(LONGEST)]


def rim_ids(lat: Lattice, head: str, tail: str, size: int, entry: list[int], leave: int) -> tuple[list[int], list[int]]:
    """Ids before and after the chunk's middle."""
    start = {r: s for r, s in enumerate(entry) if s > NONE}
    if not tail:
        return lat.trace(head, lat.forward(head, size, start)[1], size + leave)[0], []
    first = lat.trace(head, lat.forward(head, len(head), start)[1], len(head))[0]
    return first, lat.trace(tail, lat.forward(tail, size, {0: 0})[1], size + leave)[0]


def product(a, b):
    """Max-plus matrix product."""
    import numpy as np

    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def step(v, m):
    import numpy as np

    return np.maximum((v[:, None] + m).max(axis=0), NONE)


def follow(a, b):
    """First map a, then map b; -1 where there is no way."""
    import numpy as np

    return np.where(a >= 0, b[a], -1)


def _scan(nodes: DataFrame, levels: int, start: list[int], shape: tuple[int, ...], combine, move) -> DataFrame:
    """nodes (key, at, value array<long>) -> (key, at, state array<long>): the state before each node.

    Blocks of BLOCK neighbours are combined level by level, then states are handed down again; a group is never larger than a
    block.
    """
    import pandas as pd

    schema = "key long, at long, value array<long>"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        total = pdf["value"].iloc[0].reshape(shape)
        for x in pdf["value"].iloc[1:]:
            total = combine(total, x.reshape(shape))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "at": [pdf["at"].iloc[0] // BLOCK], "value": [total.reshape(-1)]})

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        state, out = pdf["before"].iloc[0], []
        for x in pdf["value"]:
            out.append(state)
            state = move(state, x.reshape(shape))
        return pd.DataFrame({"key": pdf["key"], "at": pdf["at"], "state": out})

    tree = [nodes]
    for _ in range(levels):
        up = tree[-1].groupBy("key", F.floor(F.col("at") / BLOCK).alias("block")).applyInPandas(fold, schema)
        tree.append(common.materialize(up, "scan"))
    states = tree[-1].select("key", "at", F.array(*[F.lit(x).cast("long") for x in start]).alias("state"))
    for level in reversed(tree[:-1]):
        before = states.select("key", F.col("at").alias("block"), F.col("state").alias("before"))
        down = level.withColumn("block", F.floor(F.col("at") / BLOCK)).join(before, ["key", "block"])
        states = down.groupBy("key", "block").applyInPandas(spread, "key long, at long, state array<long>")
    return states


def _lists(values, size, kind):
    """Arrow lists of size values each, from values in a row."""
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype("i4")), pa.array(values, kind))


def _short(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lat = lattice(path)
        for rows in tokens.runs(batches):
            ids, size = lat.texts(rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _lists(ids.astype("i4"), size, pa.int32())], ["doc_id", "ids"])

    return run


def _chunks(chunk: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, doc, text in zip(*(batch.column(c) for c in ("key", "doc_id", "text"))):
                text = SPACE + text.as_py().replace(" ", SPACE)
                n = -(-len(text) // chunk)
                parts = [text[i * chunk : (i + 1) * chunk + LONGEST - 1] for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n), pa.array([doc.as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([n] * n, pa.int64()), pa.array(parts, pa.string())], ["key", "doc_id", "at", "n", "part"])

    return run


def _summaries(path: str, chunk: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lat = lattice(path)
        for rows in tokens.runs(batches, column="part"):
            parts = rows.column("part").to_pylist()
            sizes = [min(chunk, len(p)) for p in parts]
            cut = [rims(p, n) for p, n in zip(parts, sizes)]
            middles = [m for _, m, _ in cut]
            ids, n = lat.texts(pa.array([m[1:].replace(SPACE, " ") for m in middles]), pa.array([not m for m in middles]))
            ends = np.r_[0, np.cumsum(n)]
            score = np.diff(np.r_[0, np.cumsum(lat.score_of[ids])][ends])
            size = [z - len(h) - len(m) if t else z for (h, m, t), z in zip(cut, sizes)]
            matrices = [transfer(lat, h, int(s), t, z) for (h, _, t), s, z in zip(cut, score, size)]
            data = ids.astype("<u4").tobytes()
            middle = [data[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in ("key", "doc_id", "at", "n")], pa.array(size, pa.int64()), pa.array([h for h, _, _ in cut]), pa.array(middle, pa.binary()), pa.array([t for _, _, t in cut]), pa.array([m.reshape(-1).tolist() for m in matrices], pa.list_(pa.int64()))],
                ["key", "doc_id", "at", "n", "size", "head", "middle", "tail", "value"],
            )

    return run


def _maps(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lat = lattice(path)
        for batch in batches:
            for r in batch.to_pylist():
                came = came_from(lat, r["head"], r["whole"], r["size"], r["state"])
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([r["n"] - 1 - r["at"]]), pa.array([came], pa.list_(pa.int64()))], ["key", "at", "value"])  # counted from the end

    return run


def _ids(path: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lat = lattice(path)
        for batch in batches:
            for r in (b for at in range(0, batch.num_rows, CHUNK_ROWS) for b in batch.slice(at, CHUNK_ROWS).to_pylist()):
                first, last = rim_ids(lat, r["head"], r["tail"], r["size"], r["state"], r["leave"])
                ids = np.r_[np.array(first, "i4"), np.frombuffer(r["middle"], "<i4"), np.array(last, "i4")]
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([r["doc_id"]], pa.int64()), pa.array([r["at"]]), _lists(ids, [len(ids)], pa.int32())], ["key", "doc_id", "at", "ids"])

    return run


def encode(df: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    texts = common.documents(df)
    # the marker in front counts as a character
    short = texts.where(F.length("text") < chunk).mapInArrow(_short(path), "doc_id long, ids array<int>")
    long = texts.where(F.length("text") >= chunk).withColumn("key", F.monotonically_increasing_id())
    dealt = long.mapInArrow(_chunks(chunk), "key long, doc_id long, at long, n long, part string").repartition("key", "at")
    columns = "key long, doc_id long, at long, n long, size long, head string, middle binary, tail string, value array<long>"
    parts = common.materialize(dealt.mapInArrow(_summaries(path, chunk), columns), "chunks")
    most = parts.agg(F.max("n")).first()[0] or 0
    levels = 0
    while BLOCK**levels < most:
        levels += 1
    entries = common.materialize(_scan(parts.select("key", "at", "value"), levels, [0] + [NONE] * (LONGEST - 1), (LONGEST, LONGEST), product, step), "entries")
    whole = (F.length("tail") == 0).alias("whole")
    maps = parts.select("key", "at", "n", "size", "head", whole).join(entries, ["key", "at"]).mapInArrow(_maps(path), "key long, at long, value array<long>")
    leaves = _scan(common.materialize(maps, "maps"), levels, [0], (LONGEST,), follow, follow)
    leaves = leaves.select("key", F.col("at").alias("from_end"), F.col("state")[0].cast("int").alias("leave"))
    states = parts.select("key", "at", (F.col("n") - 1 - F.col("at")).alias("from_end")).join(leaves, ["key", "from_end"]).join(entries, ["key", "at"]).select("key", "at", "leave", "state")
    traced = parts.drop("value", "n").join(states, ["key", "at"]).mapInArrow(_ids(path), "key long, doc_id long, at long, ids array<int>")
    done = traced.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(done.select("doc_id", "ids"))


def _decoded(path: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lat = lattice(path)
        for batch in batches:
            size = np.diff(batch.column("ids").offsets.to_numpy())
            ids = batch.column("ids").flatten().to_numpy().astype("<u4")
            ends, at = np.r_[0, np.cumsum(size)], 0
            while at < len(size):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODE_IDS, "right")) - 1)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, to - at) for c in batch.columns], pa.array(lat.decode(ids[ends[at] : ends[to]], size[at:to]), pa.string())], [*batch.schema.names, "decoded"])
                at = to

    return run


def decode(df: DataFrame, path: str = MODEL) -> DataFrame:
    """df (doc_id, ids) with the text that the ids decode to."""
    return df.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, ids array<int>, decoded string")


def _digests(path: str):
    def run(batches: Iterator) -> Iterator:
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        for rows in _decoded(path)(batches):
            data = memoryview(rows.column("ids").flatten().to_numpy().astype("<u4").tobytes())
            ends = np.r_[0, np.cumsum(np.diff(rows.column("ids").offsets.to_numpy()))].tolist()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in rows.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(sha)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    return run


def op2_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids) and the SHA-256 of the text that the ids decode to."""
    docs = common.read(spark, sf_dir, "documents")
    return encode(docs).mapInArrow(_digests(MODEL), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
