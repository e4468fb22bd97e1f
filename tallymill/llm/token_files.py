"""Fixed-width token files: ids in the fewest bits of the vocabulary, in blocks.

A shard holds consecutive documents::

    b"TMIDS1\\0\\0" | u4 width, u4 ids a block, u8 documents, u8 ids, u8 blocks
    | i8 doc_id ... | u1 doc_id is null ... | u4 ids of the document ... | u8 offset of each block ... and end
    | blocks, each padded to whole bytes

All numbers are little-endian.  A block holds its ids bit after bit, lowest first, so numpy
unpacks any range of ids after reading only the blocks that it touches.  Shards are binary
values of a Parquet table in the shared folder: the table's commit makes a lost executor harmless.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.llm import batches, scratch, tokens

MAGIC = b"TMIDS1\0\0"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 4096
SHARD_IDS = 2 << 20

SHARDS = "part int, seq int, part_start long, n_docs long, n_ids long, shard binary"


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4").view(np.uint8).reshape(-1, 4, 1) >> np.arange(8, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(-1, 32)[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what :func:`pack` made."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def build(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    """One shard."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    blocks = [pack(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join(
        [
            HEAD.pack(MAGIC, width, block, len(doc_ids), len(ids), len(blocks)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], "u1").tobytes(),
            counts.astype("<u4").tobytes(),
            offsets.tobytes(),
            *blocks,
        ]
    )


class Shard:
    """Random access to the documents and ids of a shard's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.width, self.block, n, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        ids = np.frombuffer(data, "<i8", n, at)
        null = np.frombuffer(data, "u1", n, at + 8 * n)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        at += 13 * n
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.base = at + 8 * (n_blocks + 1)

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo .. hi, from the blocks that hold them."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.data[self.base + self.offsets[b] : self.base + self.offsets[b + 1]], self.width, n))
        return np.concatenate(parts)[lo - first * self.block : hi - first * self.block]

    def doc(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.read(int(self.ends[k] - self.counts[k]), int(self.ends[k]))


def write(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int) -> tuple[DataFrame, str]:
    """Encode ``text`` of every row, append ``end_id``, and write shards in ascending ``doc_id`` order.

    Null text is empty (it has the end id alone); a null ``doc_id`` comes first; rows that share
    a ``doc_id`` follow each other by text.  An empty table gives no shard.  Other columns are ignored.
    Returns the table of shards and its path.
    """
    width = max(1, (vocabulary - 1).bit_length())

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, start = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def shard():
            nonlocal held, seq, start
            doc_ids = [x for h in held for x in h[0]]
            ids, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            row = [part, seq, start, len(doc_ids), len(ids), build(doc_ids, counts, ids, width)]
            held, seq, start = [], seq + 1, start + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "part_start", "n_docs", "n_ids", "shard"])

        for batch in it:
            for run in batches.runs(batch):
                ids, counts = tokens.with_end(*enc.spans(*batches.spans(run.column("text"))), end_id)
                held.append((run.column("doc_id").to_pylist(), ids, counts))
                if sum(len(h[1]) for h in held) >= SHARD_IDS:
                    yield shard()
        if held:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return scratch.store(rows.mapInArrow(encode, SHARDS), "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The offsets of the parts join as a broadcast: a row for each task that wrote, so their number
    is bounded by the partitions of the writing stage, not by documents.
    """

    def unpacked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, at, data in zip(batch.column("part").to_pylist(), batch.column("part_start").to_pylist(), batch.column("shard")):
                s = Shard(data.as_buffer().to_pybytes())
                ids, starts = s.read(0, s.n_ids), s.ends - s.counts
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), s.ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(crc), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(starts + at), pa.array(s.counts), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "in_part", "n_tokens", "ids_crc32"],
                )

    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    rows = shards.select("part", "part_start", "shard").mapInArrow(unpacked, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
