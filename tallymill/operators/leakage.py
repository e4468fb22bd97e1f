"""Passages that occur in documents, word for word after white space is collapsed.

Passages are told to all tasks as a bit filter of the hashes of their first words, whose size is fixed between bounds:
with many passages it lets more windows through and stays as large.  Each document is read once; the windows that pass are handed on with
as many words as the longest passage has, meet the passages of their hash in a join, and are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions import rolling, text

#: Words of a passage by which it is found (shorter ones: all of them), and the least and largest number of the filter's bits.
HEAD, FEWEST, MOST = 8, 16, 26
#: Rows of a batch that are worked on at once.
ROWS = 256


def _heads(batches):
    """item, passage, size (its words), k (of its head), h."""
    for b in batches:
        data, offs = rolling.joined(b.column(1))
        starts, ends, cuts = rolling.word_spans(data, offs)
        size = np.diff(cuts)
        some = np.flatnonzero(size)
        k = np.minimum(size[some], HEAD)
        h = rolling.windows(rolling.prefixes(rolling.word_hashes(data, starts, ends)), cuts[:-1][some], k)
        cells = [b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), pa.array(size[some].astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(h.view(np.int64))]
        yield pa.RecordBatch.from_arrays(cells, names=["item", "passage", "size", "k", "h"])


def _bit(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def bit_filter(heads: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of all heads' hashes, 32 a head between 2^FEWEST and 2^MOST; the driver sees the set bytes, 8 MB at most."""
    n = heads.select("h").distinct().count()
    bits = min(MOST, max(FEWEST, (32 * n).bit_length()))
    mask = (1 << bits) - 1
    both = F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))).alias("bit")
    set_bytes = heads.select(both).groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, int(bit & 7))")).alias("v"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    found = set_bytes.toArrow()
    out[found.column("byte").to_numpy()] = found.column("v").to_numpy()
    return np.unpackbits(out, bitorder="little").astype(bool) if bits < 20 else out, bits


def _hit(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return filter_[at] if filter_.dtype == bool else (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _screened(told, sizes: list[int], bits: int, longest: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                data, offs = rolling.joined(b.column(1))
                starts, ends, cuts = rolling.word_spans(data, offs)
                prefix = rolling.prefixes(rolling.word_hashes(data, starts, ends))
                row, k_of, h_of, part = [], [], [], []
                for k in sizes:
                    last = np.repeat(cuts[1:], np.diff(cuts))
                    at = np.arange(len(starts))
                    at = at[at + k <= last]
                    h = rolling.windows(prefix, at, k)
                    one, two = _bit(h, bits)
                    live = np.flatnonzero(_hit(told.value, one))
                    live = live[_hit(told.value, two[live])]
                    at, h = at[live], h[live]
                    rows = np.searchsorted(cuts, at, "right") - 1
                    upto = np.minimum(at + longest, cuts[rows + 1])
                    row.append(rows)
                    k_of.append(np.full(len(at), k, np.int32))
                    h_of.append(h.view(np.int64))
                    part += [" ".join(filter(None, data[a:z].tobytes().decode().translate(_SPACES).split(" "))) for a, z in zip(starts[at].tolist(), ends[upto - 1].tolist())]
                if part:
                    cells = [b.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(k_of)), pa.array(np.concatenate(h_of)), pa.array(part, pa.string())]
                    yield pa.RecordBatch.from_arrays(cells, names=["doc", "k", "h", "part"])

    return run


_SPACES = {c: " " for c in (9, 10, 11, 12, 13)}


def contained(docs: DataFrame, doc: str, doc_text: str, passages: DataFrame, item: str, passage: str) -> DataFrame:
    """doc and item of every document and every passage that it holds at word boundaries, white space collapsed on both sides; once each.

    A passage without words is in no document; null texts are empty; repeated passages and documents count by their numbers.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc], dict(passages.dtypes)[item]
    heads = passages.select(item, passage).mapInArrow(_heads, f"item {kinds[1]}, passage string, size int, k int, h long")
    longest = heads.agg(F.max("size").alias("n"), F.array_sort(F.collect_set("k")).alias("k")).first()
    if not longest.n:
        return docs.select(F.col(doc).alias(doc)).crossJoin(passages.select(item).limit(0)).limit(0)
    found, bits = bit_filter(heads)
    told = spark.sparkContext.broadcast(found)
    met = docs.select(doc, doc_text).mapInArrow(_screened(told, list(longest.k), bits, longest.n), f"doc {kinds[0]}, k int, h long, part string")
    gold = heads.select("item", "k", "h", text.collapse(F.col("passage")).alias("passage"))
    padded = lambda c: F.concat(F.col(c), F.lit(" "))
    same = met.join(gold, ["k", "h"]).where(padded("part").startswith(padded("passage")))
    return same.select(F.col("doc").alias(doc), F.col("item").alias(item)).distinct()


def equal_texts(docs: DataFrame, doc: str, doc_text: str, passages: DataFrame, item: str, passage: str) -> DataFrame:
    """doc and item of equal texts, white space collapsed: digests meet, not texts."""
    digest = lambda c: F.sha2(text.collapse(F.col(c)), 256).alias("_digest")
    return docs.select(doc, digest(doc_text)).join(passages.select(item, digest(passage)), "_digest").select(doc, item)


def by_group(docs: DataFrame, doc: str, group: str, hits: DataFrame) -> DataFrame:
    """group, documents, leaked (documents with a hit), hits (pairs)."""
    per = hits.groupBy(doc).agg(F.count("*").alias("hits"))
    both = docs.select(doc, group).join(per, doc, "left")
    return both.groupBy(group).agg(F.count("*").alias("documents"), F.count("hits").alias("leaked"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
