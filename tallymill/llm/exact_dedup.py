"""Exact deduplication with counting quotient filters.

A fingerprint's high bits (the quotient) name a slot and its low bits (the remainder) are kept
there in sorted order with a count, so a filter holds every fingerprint whole and two filters
merge without loss.  Every partition of the corpus builds a filter of its rows; filters travel in ranges of
slots, as sorted remainders and counts, and a task merges the filters of a range by their sorted
remainders.  Texts whose fingerprint has a count above one are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.llm import scratch

#: Runs of white space that are more than one plain space.
SPACES = r"[\t-\r][ \t-\r]*| [ \t-\r]+"
#: A column name that no table has.
SPARE = "__tallymill_spare__"
#: Entries that a partition's filter holds before it hands them on; entries of a range of slots on average, at most.
CAPACITY, RANGE = 1 << 20, 1 << 19
#: Rows that are told to every task instead of being joined through a shuffle, at most.
TOLD = 1 << 19
#: Logarithm of the bits that stand for more fingerprints: a million rows of 64 bits.
FILTER = 26


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class QuotientFilter:
    """Counting quotient filter of fingerprints of ``width`` bits: sorted remainders and counts by slot.

    ``ends[q]`` is where the run of slot q ends; runs stand in slot order, so the arrays are the
    filter's table without its empty slots.
    """

    def __init__(self, bits: int, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray, width: int = 64):
        self.bits, self.ends, self.remainders, self.counts, self.width = bits, ends, remainders, counts, width
        self.low = np.uint64(width - bits)  # bits of a remainder

    @classmethod
    def build(cls, prints: np.ndarray, bits: int = 12) -> QuotientFilter:
        """The filter of 64-bit fingerprints."""
        return cls.of_sorted(*np.unique(prints, return_counts=True), bits, 64)

    @classmethod
    def of_sorted(cls, prints: np.ndarray, counts: np.ndarray, bits: int, width: int) -> QuotientFilter:
        """The filter of distinct fingerprints in order."""
        low = np.uint64(width - bits)
        ends = np.searchsorted(prints >> low, np.arange(1 << bits, dtype=np.uint64), "right")
        return cls(bits, ends, prints & ((np.uint64(1) << low) - np.uint64(1)), counts, width)

    def prints(self) -> np.ndarray:
        """The fingerprints, from slots and remainders."""
        slots = np.repeat(np.arange(1 << self.bits, dtype=np.uint64), np.diff(self.ends, prepend=0))
        return (slots << self.low) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' entries in one pass over sorted remainders; equal fingerprints add their counts."""
        mine, theirs = self.prints(), other.prints()
        at = np.searchsorted(mine, theirs)
        near = np.minimum(at, max(0, len(mine) - 1))
        same = mine[near] == theirs if len(mine) else np.zeros(len(theirs), bool)
        counts = self.counts.copy()
        counts[near[same]] += other.counts[same]
        at, new = at[~same], ~same
        place = at + np.arange(len(at))  # where their own entries come to stand
        prints, total = np.empty(len(mine) + len(at), np.uint64), np.empty(len(mine) + len(at), np.int64)
        old = np.ones(len(prints), bool)
        old[place] = False
        prints[place], prints[old] = theirs[new], mine
        total[place], total[old] = other.counts[new], counts
        return QuotientFilter.of_sorted(prints, total, self.bits, self.width)

    def ranges(self, bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """The filter in 2 ** bits ranges of slots: number, entries of each slot, remainders, counts."""
        slots = 1 << (self.bits - bits)
        size = np.diff(self.ends, prepend=0).astype("<u4")
        cuts = np.concatenate([[0], self.ends[slots - 1 :: slots]]).tolist()
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if hi > lo:
                yield k, size[k * slots : (k + 1) * slots].tobytes(), self.remainders[lo:hi].tobytes(), self.counts[lo:hi].tobytes()

    @classmethod
    def of_range(cls, bits: int, size: bytes, remainders: bytes, counts: bytes) -> QuotientFilter:
        """The filter of one of 2 ** bits ranges: its fingerprints lack the range's number in front."""
        size = np.frombuffer(size, "<u4")
        return cls((len(size) - 1).bit_length(), np.cumsum(size, dtype=np.int64), np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64), 64 - bits)

    def count(self, print_: int) -> int:
        """How often a fingerprint was put in."""
        low = self.width - self.bits
        q, r = print_ >> low, np.uint64(print_ & ((1 << low) - 1))
        lo, hi = (int(self.ends[q - 1]) if q else 0), int(self.ends[q])
        at = lo + int(np.searchsorted(self.remainders[lo:hi], r))
        return int(self.counts[at]) if at < hi and self.remainders[at] == r else 0


class Merger:
    """Merges filters as they come, like with like by size, so that an entry is moved log(filters) times."""

    def __init__(self):
        self.held: list[QuotientFilter] = []

    def add(self, f: QuotientFilter) -> None:
        self.held.append(f)
        while len(self.held) > 1 and 2 * len(self.held[-1].counts) >= len(self.held[-2].counts):
            last = self.held.pop()
            self.held[-1] = self.held[-1].merge(last)

    def whole(self) -> QuotientFilter | None:
        while len(self.held) > 1:
            last = self.held.pop()
            self.held[-1] = self.held[-1].merge(last)
        return self.held.pop() if self.held else None


def repeated(prints: DataFrame, column: str = "fp") -> DataFrame:
    """Fingerprints (bigint ``fp``) that occur more than once, with their count ``n``.

    A fingerprint that a third of all rows share arrives once from each filter.  The number of ranges
    grows with the rows, so what a task merges at once does not.
    """
    rows = prints.count()
    bits = max(0, (rows // RANGE).bit_length())

    def filters(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Merger()

        def out() -> pa.RecordBatch:
            k, size, remainders, counts = zip(*held.whole().ranges(bits))
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *(pa.array(x, pa.binary()) for x in (size, remainders, counts))], ["range", "size", "remainders", "counts"])

        for batch in it:
            if batch.num_rows:
                held.add(QuotientFilter.build(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), max(12, bits + 2)))
            if sum(len(f.counts) for f in held.held) >= CAPACITY:
                yield out()
        if held.held:
            yield out()

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = Merger(), None

        def out() -> pa.RecordBatch:
            f = held.whole()
            more = f.counts > 1
            prints = f.prints()[more] | np.uint64(at << f.width if bits else 0)
            return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(f.counts[more])], ["fp", "n"])

        for batch in it:
            for k, *parts in zip(batch.column("range").to_pylist(), *(batch.column(c) for c in ("size", "remainders", "counts"))):
                if k != at and held.held:
                    yield out()
                at = k
                held.add(QuotientFilter.of_range(bits, *(x.as_buffer() for x in parts)))
        if held.held:
            yield out()

    ranges = prints.select(column).mapInArrow(filters, "range int, size binary, remainders binary, counts binary")
    return ranges.repartition("range").sortWithinPartitions("range").mapInArrow(merged, "fp long, n long")


def without(docs: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """The rows of ``docs`` for which no row of ``gone`` (a stored table) meets the condition.

    Up to TOLD rows are sent to every task, so that texts stay where they are; more are joined through a shuffle.
    """
    return docs.join(F.broadcast(gone) if gone.limit(TOLD + 1).count() <= TOLD else gone, on, "left_anti")


def candidates(texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """The rows of ``texts`` (norm, ...) whose fingerprint ``flagged`` (a stored table) holds, with it as ``fp``; all others are dropped where they are read.

    Up to TOLD fingerprints are sent to every task.  More are sent as a table of 2^FILTER bits, of one size whatever the corpus, and what it lets through meets
    the fingerprints in a join: of n fingerprints it lets through n / 2^FILTER of the other texts.
    """
    rows, prints = texts.withColumn("fp", F.xxhash64("norm")), flagged.select("fp")
    if flagged.limit(TOLD + 1).count() <= TOLD:
        return rows.join(F.broadcast(prints), "fp")
    word = F.shiftrightunsigned("fp", 6).bitwiseAND(F.lit((1 << (FILTER - 6)) - 1))
    bit = F.expr("shiftleft(1L, CAST(fp & 63 AS INT))")
    bits = prints.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    through = rows.withColumn("_bit", bit).withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word")).where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return through.drop("_bit", "_at", "_word", "_bits").join(prints, "fp")


def groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after :func:`normalised`; of equal ones the smallest doc_id stays
    (a null doc_id counts as the largest, and stays only where no other does).  Null text equals
    empty text.  Rows that share doc_id and text count singly and are kept or dropped alike.  An empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    hashed = texts.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"))
    ids, _ = scratch.store(hashed, "dedup-prints")
    flagged, _ = scratch.store(repeated(ids), "dedup-repeated")

    same = (
        candidates(texts, flagged).groupBy(F.sha2("norm", 256).alias("sha"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("sha", F.xxhash64("norm").alias("fp"), "keep_id", "group_size", F.when(F.count("*").over(W.partitionBy("sha")) > 1, F.col("norm")).alias("norm"))
    )
    verified, _ = scratch.store(same, "dedup-groups")
    plain = ids.join(verified.where("norm IS NULL").drop("norm", "fp"), "sha", "left")
    if not verified.where("norm IS NOT NULL").isEmpty():  # texts that differ under one digest
        clash = verified.where("norm IS NOT NULL")
        own = texts.withColumn("sha", F.sha2("norm", 256)).join(clash.drop("fp"), ["sha", "norm"]).select("sha", "doc_id", "keep_id", "group_size")
        plain = plain.join(clash.select("sha").distinct(), "sha", "left_anti").select("sha", "doc_id", "keep_id", "group_size").unionByName(own)
    return plain.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of :func:`groups`, with all its columns.

    Where rows with the kept doc_id repeat the kept text, any one of them stays.
    """
    found, _ = scratch.store(groups(docs).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "dedup-rows")
    rows = found.groupBy("_id", "_sha").agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_n"))
    gone, _ = scratch.store(rows.where("NOT _kept OR _n > 1"), "dedup-gone")
    sha = F.sha2(normalised(docs["text"]), 256)
    on = lambda t: docs["doc_id"].eqNullSafe(t["_id"]) & (sha == t["_sha"])
    left = without(docs, gone.drop("_kept", "_n"), on(gone))
    again = gone.where("_kept").drop("_kept", "_n")
    if again.isEmpty():
        return left
    again = docs.join(again, on(again), "left_semi").withColumn(SPARE, F.sha2(normalised(F.col("text")), 256)).dropDuplicates(["doc_id", SPARE]).drop(SPARE)
    return left.unionByName(again)
