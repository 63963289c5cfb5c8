"""Token-ID output in bit-plane shuffled chunks.

Documents are range-partitioned and sorted by doc_id, encoded, closed with an end id, and gathered into chunks of whole
documents with at least CHUNK_IDS ids.  Inside a chunk the ids are cut into blocks of BLOCK_IDS; each block is transposed into
bit planes (or byte planes), the same plane of all blocks is compressed with zstandard, and an index in front of the planes
gives each plane's length.  A chunk is one row of a Parquet data set in the shared folder, beside its place and its documents'
lengths: that is the chunk index, which readers scan without touching the planes, and Spark's commit protocol makes lost tasks
harmless.

Cases: a null or empty text is the end id alone; equal doc_ids are ordered by text hash; a null doc_id sorts first; other columns
are ignored; an empty table writes no chunk and reads back as no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common, tokens

END_ID = 2
CHUNK_IDS, BLOCK_IDS = 1 << 17, 1 << 12
MAGIC = b"BPL1"
BROADCAST_PARTS = 100_000
CHUNK_SCHEMA = "part int, part_at long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, planes binary"
CHUNK_NAMES = ["part", "part_at", "n_ids", "doc_ids", "lengths", "planes"]


def pack_ids(ids, bits: bool = True, level: int = 3) -> bytes:
    """uint32 ids -> header, plane index and compressed planes."""
    import numpy as np
    import zstandard

    n = len(ids)
    blocks = np.zeros(-(-n // BLOCK_IDS) * BLOCK_IDS, "<u4")
    blocks[:n] = ids
    raw = blocks.view("u1").reshape(-1, BLOCK_IDS, 4)
    planes = []
    for byte in range(4):
        column = np.ascontiguousarray(raw[:, :, byte])
        if not bits:
            planes.append(column.tobytes())
            continue
        for bit in range(8):
            if not column.any():
                planes.append(b"")
                continue
            planes.append(np.packbits((column >> bit) & 1, axis=1, bitorder="little").tobytes())
    press = zstandard.ZstdCompressor(level=level)
    packed = [press.compress(p) if any(p) else b"" for p in planes]  # an empty entry is a plane of zeros
    head = MAGIC + struct.pack("<BIQ", bits, BLOCK_IDS, n) + struct.pack(f"<{len(packed)}I", *map(len, packed))
    return head + b"".join(packed)


def unpack_ids(data: bytes):
    """The ids of pack_ids."""
    import numpy as np
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a bit-plane chunk")
    bits, block, n = struct.unpack_from("<BIQ", data, 4)
    count = 32 if bits else 4
    sizes = struct.unpack_from(f"<{count}I", data, 17)
    at, blocks = 17 + 4 * count, -(-n // block)
    out = np.zeros((blocks, block, 4), "u1")
    press = zstandard.ZstdDecompressor()
    for k, size in enumerate(sizes):
        if not size:
            continue
        plane = np.frombuffer(press.decompress(data[at : at + size]), "u1")
        at += size
        if bits:
            out[:, :, k // 8] |= np.unpackbits(plane.reshape(blocks, block // 8), axis=1, bitorder="little") << (k % 8)
        else:
            out[:, :, k] = plane.reshape(blocks, block)
    return out.reshape(-1).view("<u4")[:n]


def _chunks(path: str, end_id: int, bits: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), tokens.table(path).encode
        at, held, docs, lengths, ids = 0, 0, [], [], []

        def close():
            nonlocal at, held, docs, lengths, ids
            every = np.concatenate(ids)
            columns = [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(every)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack_ids(every, bits)], pa.binary())]
            at, held, docs, lengths, ids = at + len(every), 0, [], [], []
            return pa.RecordBatch.from_arrays(columns, CHUNK_NAMES)

        for rows in tokens.runs(batches):
            found, size = encode(rows.column(1), end_id)
            done = 0
            for doc, n in zip(rows.column(0).to_pylist(), size.tolist()):
                docs.append(doc)
                lengths.append(n)
                ids.append(found[done : done + n])
                done, held = done + n, held + n
                if held >= CHUNK_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(df: DataFrame, path: str, tokenizer: str = tokens.TOKENIZER, end_id: int = END_ID, bits: bool = True) -> None:
    """Ranges of (doc_id, text hash), as many as Spark's shuffle partitions; part is a range's number and part_at a chunk's place in it."""
    docs = common.documents(df).withColumn("_h", common.row_key())
    ordered = docs.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    ordered.mapInArrow(_chunks(tokenizer, end_id, bits), CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files; ids are little-endian unsigned 32-bit integers.

    start adds up parts (a row for each write task), a chunk's place in its part and the documents before it in the chunk; the
    planes are read once and never shuffled.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
    side = F.broadcast(parts) if common.is_small(parts, BROADCAST_PARTS) else parts
    placed = chunks.join(side, "part").select((F.col("part_start") + F.col("part_at")).alias("start"), "doc_ids", "lengths", "planes")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def _documents(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row in range(batch.num_rows):
            start, doc_ids, lengths, planes = (batch.column(c)[row].as_py() for c in range(4))
            ids = unpack_ids(planes)
            ends = np.cumsum(lengths)
            cuts = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(cuts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def op6_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
    write_tokens(common.read(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
