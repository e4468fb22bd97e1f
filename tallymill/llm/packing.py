"""Packing of documents into training windows by lexical retrieval.

Terms are token ids and, hashed into PAIRS numbers, pairs of neighbouring ids: a vocabulary of bounded
size, so that the corpus-wide document frequencies of all terms are one vector and exact at any scale.  Documents are put in the order of their heaviest terms, so that neighbours come
together wherever they stood, and cut into shards; each shard has a BM25 inverted index with every
posting.  Documents of a window or more fill windows by themselves; what is left of them, and all
shorter documents, seed windows from the longest on, and a seed's window takes its best neighbours
that no window has used.  What remains of a window is filled by cutting the best neighbour left, whose
rest seeds the next window, so that all windows of a shard but the last are full; the last is cut at
powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import batches, scratch, tokens

WINDOW = 1024
#: Documents, and ids, that a shard of the index holds at most (one longer document is a shard).
SHARD_DOCS, SHARD_IDS = 1024, 1 << 21
#: Numbers of token ids, and of hashed pairs of ids: the vocabulary of the index.
IDS, PAIRS = 1 << 18, 1 << 20
#: Parts in which frequencies are added up.
PARTS = 64
#: Terms of the greatest weight by which a document is placed.
HEAVY = 3
#: Documents of a shard that hold a term from which on its postings are a row of a matrix; and rows of such a matrix.
DENSE, BLOCK = 48, 1024
#: BM25's constants.
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, str]:
    """doc_id, n, and the n ids of the text and ``end_id`` in 16 bits each where the vocabulary admits, else 32, as a stored table; and its path."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        kind = np.dtype("<u2" if max(len(enc.bytes) - 1, end_id) < 1 << 16 else "<u4")
        for batch in it:
            for part in batches.runs(batch):
                ids, counts = tokens.with_end(*enc.spans(*batches.spans(part.column("text"))), end_id)
                raw, ends = ids.astype(kind).tobytes(), kind.itemsize * np.cumsum(counts)
                each = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(each, pa.binary())], ["doc_id", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.store(rows.mapInArrow(run, "doc_id long, n long, ids binary"), "packing-ids")


def blocks(it: Iterator[pa.RecordBatch], most_docs: int = SHARD_DOCS, most_ids: int = SHARD_IDS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows with their ids end to end and counts: ``most_docs`` rows and ``most_ids`` ids (or one row) at most; batches are joined."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    rows = size = 0

    def out() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()[0]
        return whole, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    for batch in it:
        if not batch.num_rows:
            continue
        column = batch.column("ids").cast(pa.large_binary())
        _, offs, data = column.buffers()
        offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
        ends = np.cumsum(batch.column("n").to_numpy())
        ids = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(f"<u{(offs[-1] - offs[0]) // ends[-1]}")
        lo, bare = 0, batch.drop_columns(["ids"])
        while lo < batch.num_rows:
            base = int(ends[lo - 1]) if lo else 0
            room = int(np.searchsorted(ends, base + most_ids - size, "right")) - lo
            hi = min(batch.num_rows, lo + most_docs - rows, lo + max(room, 0 if rows else 1))
            if hi > lo:
                held.append((bare.slice(lo, hi - lo), ids[base : int(ends[hi - 1])], np.diff(ends[lo:hi], prepend=base)))
                rows, size = rows + hi - lo, size + int(ends[hi - 1]) - base
            if hi < batch.num_rows or rows == most_docs:
                yield out()
                held, rows, size = [], 0, 0
            lo = hi
        batches.settle(batch.nbytes)
    if held:
        yield out()


def terms_of(ids: np.ndarray, counts: np.ndarray, by_doc: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each of SHARD_DOCS documents at most, in order of the terms or of the documents: term, document, occurrences.

    The end id is none.
    """
    ends = np.cumsum(counts)
    own = np.ones(len(ids), bool)
    own[ends - 1] = False
    pair = own[:-1] & own[1:]
    doc = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
    wide = ids.astype(np.uint32)
    with np.errstate(over="ignore"):
        mixed = (wide[:-1][pair] * np.uint32(0x9E3779B1) ^ wide[1:][pair]) * np.uint32(0x85EBCA77)
    term, doc = np.concatenate([wide[own], np.uint32(IDS) + (mixed >> np.uint32(12))]), np.concatenate([doc[own], doc[:-1][pair]])
    key = doc << np.uint32(21) | term if by_doc else term << np.uint32(10) | doc
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    one = key[at].astype(np.int64)
    term, doc = (one & (1 << 21) - 1, one >> 21) if by_doc else (one >> 10, one & 1023)
    return term, doc, np.diff(at, append=len(key))


def lengths(counts: np.ndarray) -> np.ndarray:
    """Terms of documents of so many ids, the end id among them."""
    return np.maximum(0, 2 * counts - 3)


def frequencies(stored: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, over every row of ``stored``; the number of documents, and of all terms.

    Tasks hand on vectors of the vocabulary in PARTS parts, which are added up part by part; the driver
    gets one number a term.
    """
    size = (IDS + PAIRS) // PARTS

    def rows(df: np.ndarray, n_docs: int, n_terms: int, parts: list[int]) -> pa.RecordBatch:
        raw = [x.tobytes() for x in df.reshape(-1, size)]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(raw, pa.binary()), pa.array([n_docs, *[0] * (len(raw) - 1)]), pa.array([n_terms, *[0] * (len(raw) - 1)])], ["part", "df", "n", "m"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(IDS + PAIRS, np.int64), 0, 0
        for _, ids, counts in blocks(it):
            term, _, tf = terms_of(ids, counts)
            df += np.bincount(term, minlength=len(df))
            n_docs, n_terms = n_docs + len(counts), n_terms + int(tf.sum())
        if n_docs:
            yield rows(df, n_docs, n_terms, list(range(PARTS)))

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in it:
            for part, raw, n, m in zip(*(batch.column(c) for c in ("part", "df", "n", "m"))):
                own = total.setdefault(part.as_py(), [np.zeros(size, np.int64), 0, 0])
                own[0] += np.frombuffer(raw.as_buffer(), np.int64)
                own[1], own[2] = own[1] + n.as_py(), own[2] + m.as_py()
        for part, (df, n, m) in total.items():
            yield rows(df, n, m, [part])

    schema = "part int, df binary, n long, m long"
    found = stored.select("n", "ids").mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()
    df = np.zeros(IDS + PAIRS, np.int64)
    for r in found:
        df[r.part * size : (r.part + 1) * size] = np.frombuffer(r.df, np.int64)
    return df, sum(r.n for r in found), sum(r.m for r in found)


class Corpus:
    """Document frequencies of the terms, the number of documents, and of all their terms."""

    def __init__(self, df: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs, self.mean = n_docs, max(1.0, n_terms / max(1, n_docs))
        self.shared = df > 1
        self.idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)

    def weights(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BM25 weights of terms that occur ``tf`` times in documents of ``size`` terms."""
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


def places(ids: np.ndarray, counts: np.ndarray, corpus: Corpus) -> np.ndarray:
    """The place of each document in the order: of the terms that another document holds the HEAVY ones of the greatest weight, as one number."""
    term, doc, tf = terms_of(ids, counts, by_doc=True)
    weight = corpus.weights(term, tf, lengths(counts)[doc]) / max(1e-9, float(corpus.idf.max(initial=0)) * (K1 + 1))
    key = np.where(corpus.shared[term], ((1 << 20) * weight).astype(np.int64) << 21 | (1 << 21) - 1 - term, 0)
    out = np.full((len(counts), HEAVY), (1 << 21) - 1)
    own = np.bincount(doc, minlength=len(counts))
    some = np.flatnonzero(own)
    heads = np.cumsum(own)[some] - own[some]
    for k in range(HEAVY if len(some) else 0):
        best = np.maximum.reduceat(key, heads)
        out[some, k] = np.where(best > 0, (1 << 21) - 1 - (best & (1 << 21) - 1), out[some, k])
        key[key == np.repeat(best, own[some])] = 0
    return (out << 21 * np.arange(HEAVY - 1, -1, -1)).sum(1)


def placed(stored: DataFrame, corpus: Broadcast) -> tuple[DataFrame, str]:
    """The rows of ``stored`` in the order of their :func:`places`; and the path of a table it reads.

    Documents of one place (copies of one text, say) are dealt over partitions at random.
    """
    spark = stored.sparkSession
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows, ids, counts in blocks(iter([batch])):
                raw, ends = ids.tobytes(), ids.itemsize * np.cumsum(counts)
                each = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(each, pa.binary()), pa.array(places(ids, counts, corpus.value))], ["doc_id", "n", "ids", "place"])

    keyed = stored.mapInArrow(run, "doc_id long, n long, ids binary, place long").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    keyed, path = scratch.store(keyed, "packing-places")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-corpus.value.n_docs // (4 * SHARD_DOCS)) or 1)
    return keyed.repartitionByRange(parts, "place", "salt").sortWithinPartitions("place", "salt").select("doc_id", "n", "ids"), path


class Index:
    """BM25 inverted index of one shard, with every posting.

    Postings of terms that many documents of the shard hold are rows of a matrix, whose product with the
    documents' terms scores all pairs of documents at once; the others are lists.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, corpus: Corpus):
        """``ids``: of all documents end to end, each with its end id."""
        self.n = n = len(counts)
        term, doc, tf = terms_of(ids, counts)
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        size = np.diff(np.flatnonzero(new), append=len(term))
        keep = np.repeat(size > 1, size)  # a term of one document has no neighbour
        term, doc, tf, size = term[keep], doc[keep], tf[keep], size[size > 1]
        weight = corpus.weights(term, tf, lengths(counts)[doc]).astype(np.float32)

        many = size >= DENSE
        dense = np.repeat(many, size)
        self.base = np.zeros((n, n), np.float32)
        row, at, own = np.repeat(np.arange(int(many.sum())), size[many]), doc[dense], weight[dense]
        for lo in range(0, int(many.sum()), BLOCK):
            some = slice(*np.searchsorted(row, [lo, lo + BLOCK]))
            w = np.zeros((BLOCK, n), np.float32)
            w[row[some] - lo, at[some]] = own[some]
            self.base += (w > 0).astype(np.float32).T @ w

        size = size[~many]
        number = np.repeat(np.arange(len(size)), size)
        self.doc, self.weight, doc = doc[~dense], weight[~dense], doc[~dense]
        self.len, self.ptr = size, np.cumsum(size) - size
        self.terms, n_own = number[np.argsort(doc.astype(np.uint16), kind="stable")], np.bincount(doc, minlength=n)
        self.ends = np.cumsum(n_own)
        self.starts = self.ends - n_own

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's distinct terms."""
        terms = self.terms[self.starts[seed] : self.ends[seed]]
        at = batches.gather(self.ptr[terms], self.len[terms])
        return self.base[seed] + np.bincount(self.doc[at], self.weight[at], self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share terms with the seed, best first; of scores equal to 1/1024 the one that stands first."""
        score = self.scores(seed)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-np.rint(score[found] * 1024), kind="stable")]


def fill(counts: np.ndarray, index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each id of a shard once."""
    out, seq = [], 0
    at, left = (counts // window * window).astype(np.int64), (counts % window).astype(np.int64)
    for d in np.flatnonzero(at):
        for s in range(0, int(at[d]), window):
            out.append((int(d), s, window, seq, 0))
            seq += 1
    unused = left > 0
    for first in np.argsort(-left, kind="stable").tolist():
        seed = first
        while unused[seed] or unused[first]:  # what a cut leaves of a document seeds the next window
            seed = seed if unused[seed] else first
            n, offset = int(left[seed]), int(left[seed])
            own, cut = [(seed, int(at[seed]), n, 0)], first
            unused[seed] = False
            near = index.neighbours(seed, unused)
            fits = near[left[near] <= window - offset]
            for d in fits:
                n = int(left[d])
                if n <= window - offset:
                    own.append((int(d), int(at[d]), n, offset))
                    offset += n
                    unused[d] = False
                    if offset == window:
                        break
            if offset < window:
                rest = near[unused[near]]
                while offset < window:
                    d = int(rest[0]) if len(rest) else int(np.argmax(unused)) if unused.any() else -1
                    if d < 0:
                        break
                    n = min(int(left[d]), window - offset)
                    own.append((d, int(at[d]), n, offset))
                    at[d] += n
                    left[d] -= n
                    offset += n
                    unused[d] = left[d] > 0
                    cut = d
                    rest = rest[1:] if len(rest) else rest
            if offset == window:
                out += [(d, s, n, seq, o) for d, s, n, o in own]
                seq, seed = seq + 1, cut
                continue
            size = 1 << offset.bit_length() - 1  # the shard's last one: cut at powers of two
            end, room = 0, size
            for d, s, n, _ in own:
                while n:
                    if end == size:
                        offset -= size
                        size = 1 << offset.bit_length() - 1
                        seq, end = seq + 1, 0
                    room = min(n, size - end)
                    out.append((d, s, room, seq, end))
                    s, n, end = s + room, n - room, end + room
            seq += 1
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pieces of all rows' ids (text's ids, then ``end_id``), packed into windows.

    Null text is empty: its piece is the end id.  A null doc_id is packed as any other; repeated
    rows are packed each.  Of equally good neighbours the one that stands first in the shard's order is
    taken.  A text of any length is packed whole.  An empty table gives no piece; other columns are ignored.
    Sequence ids are unique, not consecutive.
    """
    spark = docs.sparkSession
    stored, path = encoded(docs, tokenizer, end_id)
    corpus = spark.sparkContext.broadcast(Corpus(*frequencies(stored)))  # a few numbers a term of the vocabulary
    rows, _ = placed(stored, corpus)
    scratch.drop(spark, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        for shard, ids, counts in blocks(it):
            pieces = fill(counts, Index(ids, counts, corpus.value))
            begin = (np.cumsum(counts) - counts).tolist()
            raw = memoryview(ids.astype("<u4").tobytes())
            d, start, length, seq, offset = np.array(pieces, np.int64).T
            crc = [zlib.crc32(raw[4 * (begin[k] + s) : 4 * (begin[k] + s + n)]) for k, s, n in zip(d.tolist(), start.tolist(), length.tolist())]
            out = [shard.column("doc_id").take(pa.array(d)), *(pa.array(x, pa.int64()) for x in (start, length, crc, counts[d], base + seq, offset))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base += int(seq[-1]) + 1

    return rows.mapInArrow(run, PIECES)
