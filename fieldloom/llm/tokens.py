"""Byte-level BPE ids by the tokenizers library, batch-wise inside Spark tasks.

The pre-tokenizer always cuts where a blank follows a non-blank, so a text's ids are those of its words ("word", " word", ...)
one after another.  Arrow splits a batch of texts and dictionary-encodes the words, cuts the distinct ones again where letters
meet punctuation or a line's end, and dictionary-encodes these parts.  The library encodes the parts that a worker hasn't seen,
a bounded table keeps their ids, and numpy gathers the ids of all texts at once.  Texts in which a blank is followed by another
white-space character, or that hold the marks used here, go to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TABLE_PIECES = 600_000
ROW_PIECES = 500
BATCH_CHARS = 8_000_000
FIRST, CUT = "\x00", "\x01"
#: A blank before any other white space, the marks of special tokens, and the marks used here.
ODD = r" [\s\p{Z}\x0b\x1c-\x1f\x{85}]|<\||[\x00\x01]"
SIGNS = "[.,;:!?#$%&*]+"
#: Words that are cut between letters, signs and single line ends, as the pre-tokenizer does, and what they are cut into.
REGULAR = rf"^ ?\p{{L}}+(?:(?:{SIGNS}\n?|\n)\p{{L}}+)*(?:{SIGNS}\n?|\n)?$"
PART = rf"^(?: ?\p{{L}}+|{SIGNS}|\n)$"


def ranges(start, size):
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ...: one index array."""
    import numpy as np

    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def translated(texts, table: bytes):
    """Arrow strings without nulls, with each byte replaced as in bytes.translate (ASCII by ASCII)."""
    import numpy as np
    import pyarrow as pa

    wide = np.dtype("i8" if pa.types.is_large_string(texts.type) else "i4")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
    data = memoryview(data)[at[0] : at[-1]].tobytes() if data else b""
    return pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(data.translate(table))])


class IdTable:
    """piece -> row, and each row's ids in one flat array; forgets all pieces when it would hold more than `most`."""

    def __init__(self, encode_new: Callable, most: int = TABLE_PIECES):
        self.encode_new, self.most = encode_new, most
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.index: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, "i8"), np.zeros(1 << 16, "i8")
        self.used = 0

    def _append(self, name: str, at: int, values) -> None:
        import numpy as np

        old = getattr(self, name)
        if at + len(values) > len(old):
            old = np.concatenate([old[:at], np.zeros(max(len(old), len(values)), old.dtype)])
            setattr(self, name, old)
        old[at : at + len(values)] = values

    def rows(self, pieces):
        """Rows of distinct pieces (Arrow strings), which are encoded where they are new."""
        import numpy as np
        import pyarrow as pa

        names, get = pieces.to_pylist(), self.index.get
        out = np.array([get(p, -1) for p in names], "i8")
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        if self.index and len(self.index) + len(new) > self.most:
            self.clear()
            return self.rows(pieces)
        ids, size = self.encode_new(pieces.take(pa.array(new)))
        n = len(self.index)
        self._append("start", n, self.used + np.cumsum(size) - size)
        self._append("size", n, size)
        self._append("ids", self.used, ids)
        self.used += len(ids)
        out[new] = np.arange(n, n + len(new))
        self.index.update(zip([names[i] for i in new.tolist()], range(n, n + len(new))))
        return out

    def gather(self, split):
        """Arrow lists of pieces -> (ids of all lists, number of ids of each)."""
        import numpy as np
        import pyarrow.compute as pc

        coded = pc.dictionary_encode(split.flatten())
        row = self.rows(coded.dictionary)[coded.indices.to_numpy()]
        return joined(self.ids, self.start[row], self.size[row], split.offsets.to_numpy())


def joined(ids, start, size, cut):
    """(the ids of all pieces in a row, the number of ids between cuts): pieces are ranges of ids, lists of pieces lie between cuts."""
    import numpy as np

    ends = np.r_[0, np.cumsum(size)]
    return ids[ranges(start, size)], ends[cut[1:]] - ends[cut[:-1]]


def byte_alphabet() -> dict[str, str]:
    """Byte (as a Latin-1 character) -> its character in byte-level files: printable ones stand for themselves, others follow from 256 on."""
    shown = [c for c in map(chr, range(256)) if "!" <= c <= "~" or "\xa1" <= c <= "\xac" or c >= "\xae"]
    hidden = [c for c in map(chr, range(256)) if c not in shown]
    return {c: c for c in shown} | {c: chr(256 + i) for i, c in enumerate(hidden)}


class PieceTable(IdTable):
    """Ids by a file of the tokenizers library."""

    def __init__(self, path: str, most: int = TABLE_PIECES):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, "i8")
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)  # a byte-level token has a character for each byte
        self.parts = Tokenizer.from_file(path)
        self.parts.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.alphabet = {ord(a): b for a, b in byte_alphabet().items() if a != "\x00"}
        super().__init__(self._new, most)

    def _whole(self, texts: list[str]) -> list:
        import numpy as np

        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces):
        """Parts that the pre-tokenizer wouldn't cut are encoded in rows of many; the tokens' byte lengths tell where each one ends."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(pieces, PART).to_numpy(zero_copy_only=False)
        size = np.zeros(len(pieces), "i8")
        regular = pieces.filter(pa.array(plain))
        names = "\x00".join(regular.to_pylist()).encode().decode("latin1").translate(self.alphabet).split("\x00") if len(regular) else []
        rows = ["\n".join(names[at : at + ROW_PIECES]) for at in range(0, len(names), ROW_PIECES)]
        found = [np.array(e.ids, "<u4") for e in self.parts.encode_batch_fast(rows, add_special_tokens=False)]
        ids = np.concatenate([*found, np.zeros(0, "<u4")])
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(regular).to_numpy()), "right")
        size[plain] = np.diff(np.r_[0, ends])
        given = self._whole(pieces.filter(pa.array(~plain)).to_pylist())
        size[~plain] = [len(x) for x in given]
        start, out = np.cumsum(size) - size, np.zeros(size.sum(), "<u4")
        out[ranges(start[plain], size[plain])] = ids
        out[ranges(start[~plain], size[~plain])] = np.concatenate([*given, np.zeros(0, "<u4")])
        return out, size

    def texts(self, texts):
        """Arrow strings -> (ids of all texts, number of ids of each)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = lambda x: pa.scalar(x, texts.type)
        split = pc.split_pattern(pc.binary_join_element_wise(text(FIRST), texts, text("")), " ")
        coded = pc.dictionary_encode(split.flatten())
        words = pc.replace_substring(pc.binary_join_element_wise(text(" "), coded.dictionary, text("")), " " + FIRST, "")
        cut = pc.replace_substring_regex(words, f"({SIGNS}|\n)", rf"{CUT}\1{CUT}")
        ids, size = self.gather(pc.split_pattern(pc.if_else(pc.match_substring_regex(words, REGULAR), cut, words), CUT))
        word = coded.indices.to_numpy()
        return joined(ids, (size.cumsum() - size)[word], size[word], split.offsets.to_numpy())

    def encode(self, texts, end: int | None = None):
        """Arrow strings without nulls -> (ids of all texts, number of ids of each); `end` closes every text."""
        import numpy as np
        import pyarrow.compute as pc

        whole = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        ids, size = self.texts(texts.filter(pc.invert(pc.match_substring_regex(texts, ODD))) if whole.any() else texts)
        if whole.any():
            given = self._whole(texts.filter(pc.match_substring_regex(texts, ODD)).to_pylist())
            n = np.zeros(len(texts), "i8")
            n[~whole], n[whole] = size, [len(x) for x in given]
            start, merged = np.cumsum(n) - n, np.zeros(n.sum(), "<u4")
            merged[ranges(start[~whole], n[~whole])] = ids
            merged[ranges(start[whole], n[whole])] = np.concatenate(given)
            ids, size = merged, n
        if end is None:
            return ids, size
        closed = np.full(len(ids) + len(size), end, "<u4")
        closed[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
        return closed, size + 1


_tables: dict[str, PieceTable] = {}


def table(path: str = TOKENIZER) -> PieceTable:
    """One table for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def runs(batches: Iterator, column: str = "text", most: int = BATCH_CHARS) -> Iterator:
    """Slices of Arrow batches of about `most` bytes of text, so that a worker's memory doesn't follow its input."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False)
        if sizes.sum() <= most:
            yield batch
            continue
        at, ends = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
