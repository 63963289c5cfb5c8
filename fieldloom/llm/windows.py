"""Best-fit-decreasing packing: a segment tree indexed by remaining capacity finds the tightest open window.

Overlong documents are first cut into full windows, and their rest is a piece like any shorter document.  Only the histogram of
piece lengths, at most CAPACITY numbers however large the corpus, comes to the driver.  There the lengths go in descending order;
for each, the tree gives the tightest room among open windows, and as many windows of that room and content as there are pieces
for are filled at once.  The result is the same as of placing piece by piece.

Windows left with more than SPARE tokens to spare, unless their fill is a power of two (which needs no padding), are strung
together and cut anew every CAPACITY tokens, the tail into powers of two.  So documents are cut further only where best fit
leaves room, and padding is at most SPARE in CAPACITY of what is packed.

Pieces are ranked inside their length; a binary search in the slot table places each one.  Ids are kept only with pieces shorter
than a window, and only pieces of open windows are joined with them.

Cases: a null or empty text is one piece of one token (the end id); repeated rows are pieces of their own, and so are rows of
null or equal doc_id; other columns are ignored; an empty table gives no rows.

Tokenisation.  This file's pre-tokenizer drops white space and never joins across it, so a text's ids are those of its words.
Arrow splits a batch into words and dictionary-encodes them; words of letters and common signs are cut where these meet; the
library encodes what a worker hasn't seen, plain parts in rows of many, whose ends the tokens with a word end tell.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common, packing, tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY, END_ID, SPARE = 2048, 1, 8
CUT = "\x01"
BLANKED = bytes(32 if chr(i) in common.BLANKS else i for i in range(256))
#: Letters that lower-casing and composition keep one letter, and signs; a word of these is cut where they meet.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{391}-\x{3A1}\x{3B1}-\x{3C9}\x{410}-\x{44F}\x{4E00}-\x{9FA5}"
SIGNS = ".,;:!?#$%&*"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class WordTable(tokens.IdTable):
    """Ids of words by a file of the tokenizers library with word ends."""

    def __init__(self, path: str, most: int = tokens.TABLE_PIECES):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.kind = "<u2" if len(self.closes) <= 1 << 16 else "<u4"
        super().__init__(self._new, most)

    def _whole(self, pieces: list[str]) -> list:
        import numpy as np

        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _new(self, pieces):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(pieces, f"^(?:[{LETTERS}]+|[{SIGNS}]+)$").to_numpy(zero_copy_only=False)
        names = pieces.to_pylist()
        found, some = [np.zeros(0, "<u4")] * len(names), np.flatnonzero(plain)
        rows = [some[at : at + tokens.ROW_PIECES] for at in range(0, len(some), tokens.ROW_PIECES)]
        odd = np.flatnonzero(~plain).tolist()
        for row, ids in zip(rows, self._whole([" ".join(names[i] for i in row) for row in rows])):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(row):
                for i, x in zip(row.tolist(), np.split(ids, ends[:-1])):
                    found[i] = x
            else:  # a part that the file cuts after all
                odd += row.tolist()
        for i, x in zip(odd, self._whole([names[i] for i in odd])):
            found[i] = x
        return np.concatenate([*found, np.zeros(0, "<u4")]), np.array([len(x) for x in found], "i8")

    def encode(self, texts, end: int):
        """Arrow strings without nulls -> (ids of all texts, each closed by `end`, number of ids of each)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = pc.match_substring(texts, CUT)
        plain = texts.filter(pc.invert(marked))
        split = pc.split_pattern(tokens.translated(plain, BLANKED), " ")
        coded = pc.dictionary_encode(split.flatten())
        words = coded.dictionary
        cut = pc.replace_substring_regex(words, f"([{SIGNS}]+)", rf"{CUT}\1{CUT}")
        ids, size = self.gather(pc.split_pattern(pc.if_else(pc.match_substring_regex(words, f"^[{LETTERS}{SIGNS}]+$"), cut, words), CUT))
        word = coded.indices.to_numpy()
        ids, n = tokens.joined(ids, (size.cumsum() - size)[word], size[word], split.offsets.to_numpy())
        closed = np.zeros(len(texts), "i8")
        own = marked.to_numpy(zero_copy_only=False)
        whole = self._whole(texts.filter(marked).to_pylist())
        closed[~own], closed[own] = n + 1, [len(x) + 1 for x in whole]
        start, out = np.cumsum(closed) - closed, np.full(closed.sum(), end, "<u4")
        out[tokens.ranges(start[~own], n)] = ids
        for at, x in zip(start[own].tolist(), whole):
            out[at : at + len(x)] = x
        return out, closed


_tables: dict[str, WordTable] = {}


def table(path: str = TOKENIZER) -> WordTable:
    """One table for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = table(path)
        for rows in tokens.runs(batches):
            ids, n = words.encode(rows.column(1), end_id)
            parts = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), parts)
            start = tokens.ranges(np.zeros(len(n), "i8"), parts) * capacity
            length = np.minimum(n[owner] - start, capacity)
            at = (np.cumsum(n) - n)[owner] + start
            data, short = memoryview(ids.tobytes()), memoryview(ids.astype(words.kind).tobytes())
            wide = np.dtype(words.kind).itemsize
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            kept = [bytes(short[wide * a : wide * b]) if b - a < capacity else None for a, b in zip(at.tolist(), (at + length).tolist())]
            columns = [rows.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[owner]), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


class Rooms:
    """A segment tree over the room that windows have left: is there any, and the least that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, room: int, there: bool) -> None:
        at = room + self.size
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of `length` or more."""
        at = length + self.size
        if self.any[at]:
            return length
        while at > 1 and (at % 2 or not self.any[at + 1]):  # up until something stands to the right
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at + (not self.any[2 * at])
        return at - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(how many windows, ((length, how many pieces), ...) of each)]: windows alike are filled together."""
    tree = Rooms(capacity)
    room: dict[int, list] = {}

    def put(space: int, k: int, items) -> None:
        if k:
            room.setdefault(space, []).append((k, items))
            tree.mark(space, True)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            space = tree.tightest(length)
            if space is None:
                k, items, space = left, (), capacity  # new windows, as many as are wanted
            else:
                k, items = room[space].pop()
                if not room[space]:
                    tree.mark(space, False)
            each = space // length
            full = min(k, left // each)
            left -= full * each
            put(space - each * length, full, (*items, (length, each)))
            k -= full
            if k and 0 < left < each:
                put(space - left * length, 1, (*items, (length, left)))
                k, left = k - 1, 0
            if items:
                put(space, k, items)
    return [(k, items) for at in room.values() for k, items in at]


def slots(packing_: list, capacity: int = CAPACITY, spare: int = SPARE):
    """({length: arrays of first rank, first place, step, offset, is it a sequence}, sequences, tokens strung together).

    A closed window's place is its sequence, and the next window of the same content is one further; an open window's place is
    where it begins in the string, and the next one is its fill further.
    """
    import numpy as np

    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = string = 0
    for k, items in packing_:
        fill = sum(length * n for length, n in items)
        closed = capacity - fill <= spare or fill & (fill - 1) == 0
        offset = 0
        for length, n in items:
            for _ in range(n):
                rows.setdefault(length, []).append((rank.get(length, 0), sequence if closed else string, 1 if closed else fill, offset, closed))
                rank[length] = rank.get(length, 0) + k
                offset += length
        if closed:
            sequence += k
        else:
            string += k * fill
    return {x: np.array(r, "i8").T for x, r in rows.items()}, sequence, string


def string_cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Where sequences begin in the tail of the string, the part beyond its full windows: at sums of falling powers of two; the last number is the end."""
    at, rest = total - total % capacity, total % capacity
    cuts = [at]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return cuts


def _place(table_, capacity: int):
    """Adds sequence_id and offset, or for pieces of open windows the place in the string (`at`)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        where = table_.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            place, offset, closed = (np.zeros(len(rank), "i8") for _ in range(3))
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, start, step, off, is_closed = where[int(x)]
                k = np.searchsorted(first, rank[own], "right") - 1
                place[own], offset[own], closed[own] = start[k] + (rank[own] - first[k]) * step[k], off[k], is_closed[k]
            shut = closed.astype(bool)
            columns = [batch.column(c) for c in ("key", "doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            columns += [pa.array(place, mask=~shut), pa.array(offset, mask=~shut), pa.array(place + offset, mask=shut)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "at"])

    return run


def _recut(capacity: int, cuts: list[int], sequences: int):
    """Pieces of open windows with their ids -> their parts between the cuts of the string."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, end = r["at"], r["at"] + r["length"]
                ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['length']}").astype("<u4")
                while a < end:
                    if a < cuts[0]:
                        begin, sequence, stop = a - a % capacity, sequences + a // capacity, a - a % capacity + capacity
                    else:
                        j = int(np.searchsorted(cuts, a, "right")) - 1
                        begin, sequence, stop = cuts[j], sequences + cuts[0] // capacity + j, cuts[j + 1]
                    stop = min(stop, end)
                    crc = zlib.crc32(ids[a - r["at"] : stop - r["at"]].tobytes())
                    out.append((r["doc_id"], r["start"] + a - r["at"], stop - a, crc, r["doc_tokens"], sequence, a - begin))
                    a = stop
            columns = list(zip(*out)) or [[]] * len(PLACED)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PLACED)

    return run


def pieces(df: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Full windows of overlong documents, and the rest of each document; ids only where a piece is shorter than a window."""
    return common.documents(df).mapInArrow(_cut(tokenizer, end_id, capacity), PIECE_SCHEMA)


def pack(df: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, spare: int = SPARE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = df.sparkSession
    cut = common.materialize(pieces(df, tokenizer, end_id, capacity).withColumn("key", F.monotonically_increasing_id()), "windows")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    where, sequences, string = slots(best_fit_decreasing(counts, capacity), capacity, spare)
    ranked = packing.ranks(cut.drop("ids"), counts, ["key"]).select("key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    placed = ranked.mapInArrow(_place(spark.sparkContext.broadcast(where), capacity), "key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, at long")
    if not string:
        return placed.select(*PLACED)
    placed, cuts = common.materialize(placed, "placed"), string_cuts(string, capacity)
    shut = placed.where(F.col("at").isNull()).select(*PLACED)
    # only pieces whose length stands in an open window can be among those cut anew
    open_lengths = sorted(x for x, (*_, closed) in where.items() if not closed.all())
    ids = cut.where(F.col("length").isin(open_lengths)).select("key", "ids")
    again = placed.where(F.col("at").isNotNull()).join(ids, "key").select("doc_id", "start", "length", "doc_tokens", "at", "ids")
    return shut.unionByName(again.mapInArrow(_recut(capacity, cuts, sequences), ", ".join(f"{c} long" for c in PLACED)))


def op12_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
