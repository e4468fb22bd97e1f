"""Cross-tokenizer alignment: two tokenizers' tokens of the same bytes, the groups and links between them, and corpus-wide pair counts.

A run of an Arrow batch is one string of bytes with the documents' offsets in it.  The ends of all its A
tokens and of all its B tokens are counted once per byte (``bincount``): bytes where both end close a group, and every byte where
either ends closes one link, that of the A and the B token that cover it, whose numbers are prefix
sums of the counts.  Differences of prefix sums at the documents' offsets give each document its own figures.

What a document holds of a pair of ids is written once, with each task's own counts of pairs as more rows of the same table, so texts are
encoded once.  Of the corpus-wide counts, pairs that make up at least 1 / ``HEAVY`` of all links are told to all
tasks (there are ``HEAVY`` of them at most, whatever the corpus); the rest, of which none is hot by
that very bound, meet their counts in a join.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import batches, scratch, tokens, trie_bpe, words
from tallymill.llm.batches import gather, sums

#: The most pairs of ids that tasks are told; each counts for at least so large a share of all links.
HEAVY = 1 << 18
#: Distinct chunks a worker remembers for a tokenizer, and the most ids of them.
KEEP, KEEP_IDS = 400_000, 8_000_000
#: Bytes whose token ends are counted at once, tokens whose ids are written out at once, pairs a task gathers before it hands on their counts.
WINDOW, SLICE, GATHER = 4 << 20, 1 << 20, 1 << 20


class Table:
    """Bytes of all tokens of a vocabulary, and the decimal digits of their ids."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[gather(self.start[ids], self.size[ids])]


class ByteLevel(tokens.Encoder):
    """Encoder of a byte-level tokenizer file for which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, KEEP)
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = True
        byte, vocab = trie_bpe.alphabet(), self.lib.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            entries[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.table = Table(entries)

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > KEEP_IDS:
            self._clear()
        return super().spans(data, offs)


class Pieces(tokens.Encoder):
    """Encoder of a sentencepiece BPE model, given texts with the space in front that the model would add.

    No piece of a plain model spans a place where a space follows another character, so texts are cut before
    each run of spaces and each distinct chunk is encoded once; texts of other models go to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp, self.keep = sentencepiece.SentencePieceProcessor(model_file=path), KEEP
        names = [self.sp.id_to_piece(k) for k in range(self.sp.get_piece_size())]
        self.table = Table([bytes([int(x[3:5], 16)]) if self.sp.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)])
        self.whole = not _plain(path, names)
        self.space = self.sp.piece_to_id("▁")
        self._clear()

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.whole:
            raw = data.tobytes()
            return self._flatten([raw[a + 1 : b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
        if len(self.known) > self.keep or self.used > KEEP_IDS:
            self._clear()
        begin = data == 32
        begin[1:] &= data[:-1] != 32
        begin[offs[:-1]] = True
        starts = np.flatnonzero(begin)
        size, counts = np.diff(starts, append=len(data)), np.diff(np.searchsorted(starts, offs))
        a, b = words.names(data, starts, size)
        at = self.known.find(a, b)
        new = np.flatnonzero(at < 0)
        if len(new):
            order = new[np.lexsort((b[new], a[new]))]
            head = np.ones(len(order), bool)
            head[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            one = order[head]
            self._learn([data[s : s + n].tobytes().decode() for s, n in zip(starts[one].tolist(), size[one].tolist())])
            self.known.put(a[one], b[one])
            at[order] = len(self.known) - len(one) - 1 + np.cumsum(head)
        lens = self.len[at]
        return self.ids[gather(self.start[at], lens)], sums(lens, counts)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flatten([x[1:] for x in chunks], [k for k, x in enumerate(chunks) if x == " "])

    def _flatten(self, texts: list[str], blank: list[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """``blank``: numbers of texts that are the added space alone, for which the library returns nothing."""
        got = self.sp.encode(texts, num_threads=1)
        for k in blank:
            got[k] = [self.space]
        lens = np.array([len(x) for x in got], np.int64)
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens


def _plain(path: str, names: list[str]) -> bool:
    """Whether a model leaves characters alone, adds one space in front, and has no piece with a space after another character."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # then nothing is known of the model
        return False
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n, own = model.normalizer_spec, {1, 2, 3, 6}  # normal, unknown, control and byte pieces
    same = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
    bpe = model.trainer_spec.model_type == 2
    inside = any("▁" in x.lstrip("▁") for x in names)
    return bool(same and bpe and not inside and all(p.type in own for p in model.pieces))


@lru_cache(None)
def encoders(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """The worker's two encoders."""
    return ByteLevel(a), Pieces(b)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends at which both kinds of tokens end; and of every link its end, its A token and its B token.

    Both kinds cover the same ``total`` bytes; ends are sorted.
    """
    both, links, first, second = [], [], [], []
    for lo in range(0, total, WINDOW):
        n = min(WINDOW, total - lo)
        i, j = (int(np.searchsorted(e, lo, "right")) for e in (ends_a, ends_b))
        a, b = (np.bincount(e[k : np.searchsorted(e, lo + n, "right")] - lo - 1, minlength=n) for e, k in ((ends_a, i), (ends_b, j)))
        at = np.flatnonzero(a | b)
        both.append(np.flatnonzero(a & b) + lo + 1)
        links.append(at + lo + 1)
        first.append(i + np.cumsum(a)[at] - a[at])
        second.append(j + np.cumsum(b)[at] - b[at])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (both, links, first, second))


def _digits(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal ids, each followed by its mark; and where each one's text ends."""
    width = np.searchsorted(10 ** np.arange(1, 19), ids, "right") + 1
    ends = np.cumsum(width + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = marks
    rest, at = ids.astype(np.int64), ends - 2
    while len(rest):
        out[at] = 48 + rest % 10
        more = rest >= 10
        rest, at = rest[more] // 10, at[more] - 1
    return out.tobytes(), ends


def group_digests(ids_a, ends_a, ids_b, ends_b, both, cuts) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2`` of each document; ``cuts``: numbers of groups before each document, and of all."""
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    upto_a, upto_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(both)))]) for g in (group_a, group_b))
    n = upto_a + upto_b
    out, lo, digest, doc = [], 0, hashlib.sha256(), 0
    while lo < len(both):
        hi = max(lo + 1, int(np.searchsorted(n, n[lo] + SLICE, "right")) - 1)
        i, j = np.arange(upto_a[lo], upto_a[hi]), np.arange(upto_b[lo], upto_b[hi])
        at_a, at_b = i + upto_b[group_a[i]] - n[lo], j + upto_a[group_b[j] + 1] - n[lo]
        ids, marks = np.empty(n[hi] - n[lo], np.int64), np.empty(n[hi] - n[lo], np.uint8)
        ids[at_a], ids[at_b] = ids_a[i], ids_b[j]
        marks[at_a] = np.where(i + 1 == upto_a[group_a[i] + 1], ord("|"), ord(","))
        marks[at_b] = np.where(j + 1 == upto_b[group_b[j] + 1], ord(";"), ord(","))
        raw, ends = _digits(ids, marks)
        at, begin = ends[n[lo + 1 : hi + 1] - n[lo] - 1], 0  # where each group's text ends
        while doc < len(cuts) - 1 and cuts[doc + 1] <= hi:
            end = int(at[cuts[doc + 1] - lo - 1])
            digest.update(raw[begin : end - 1])
            out.append(digest.hexdigest())
            digest, begin, doc = hashlib.sha256(), end, doc + 1
        digest.update(raw[begin:])
        lo = hi
    return out


def align(data: np.ndarray, offs: np.ndarray, a: ByteLevel, b: Pieces) -> dict:
    """n_a, n_b, n_groups, n_links, groups_sha256 of each text, and its distinct pairs of ids with their times.

    Texts whose tokens do not spell them out, and empty ones, have none.
    """
    n = len(offs) - 1
    live = np.flatnonzero(np.diff(offs) > 0)
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")} | {"groups_sha256": [""] * n, "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int32)}
    text, cuts = np.insert(data, offs[:-1][live], 32), np.concatenate([[0], np.cumsum(np.diff(offs)[live] + 1)])
    found = []
    good = np.ones(len(live), bool)
    for e in (a, b):
        ids, counts = e.spans(text, cuts)
        ids = ids.astype(np.int64)
        same = sums(e.table.size[ids], counts) == np.diff(cuts)
        spelt = e.table.spell(ids[np.repeat(same, counts)])
        wanted = text if same.all() else text[np.repeat(same, np.diff(cuts))]
        inner = np.concatenate([[0], np.cumsum(np.diff(cuts)[same])])
        wrong = np.flatnonzero(spelt != wanted)
        same[np.flatnonzero(same)[np.searchsorted(inner, wrong, "right") - 1]] = False
        good &= same
        found.append((ids, counts))
    if not good.all():
        cuts, live = np.concatenate([[0], np.cumsum(np.diff(cuts)[good])]), live[good]
        found = [(ids[np.repeat(good, counts)], counts[good]) for ids, counts in found]
    if not len(live):
        return out
    (ids_a, n_a), (ids_b, n_b) = found
    ends_a, ends_b = np.cumsum(a.table.size[ids_a]), np.cumsum(b.table.size[ids_b])
    both, links, first, second = overlaps(ends_a, ends_b, int(cuts[-1]))
    groups = np.searchsorted(both, cuts, "right")
    upto = np.searchsorted(links, cuts, "right")
    bits = (len(a.table.size) * len(b.table.size)).bit_length()
    key = (np.repeat(np.arange(len(live)) << bits, np.diff(upto))) | (ids_a[first] * len(b.table.size) + ids_b[second])
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    out["pairs"], out["times"] = key[at] & ((1 << bits) - 1), np.diff(at, append=len(key)).astype(np.int32)
    out["n_pairs"][live] = np.bincount(key[at] >> bits, minlength=len(live))
    out["n_a"][live], out["n_b"][live], out["n_groups"][live], out["n_links"][live] = n_a, n_b, np.diff(groups), np.diff(upto)
    for k, digest in zip(live.tolist(), group_digests(ids_a, ends_a, ids_b, ends_b, both, groups)):
        out["groups_sha256"][k] = digest
    return out


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.diff(k, prepend=-1))
    return k[at], np.add.reduceat(n, at) if len(at) else n


def _encode(a: str, b: str):
    def run(rows):
        first, second = encoders(a, b)
        part, row, keys, counts, held = TaskContext.get().partitionId() << 33, 0, [], [], 0
        long, text, none = pa.int64(), pa.string(), lambda k, kind: pa.nulls(k, kind)

        def handed_on():
            k, n = _summed(keys, counts)
            for lo in range(0, len(k), 1 << 16):  # a row holds so many pairs
                one = k[lo : lo + (1 << 16)]
                cells = [none(1, long)] * 6 + [none(1, text), none(1, pa.list_(long)), none(1, pa.list_(pa.int32())), _lists(one, np.array([len(one)]), long), _lists(n[lo : lo + (1 << 16)], np.array([len(one)]), long)]
                yield pa.RecordBatch.from_arrays(cells, names=_NAMES)
            keys.clear()
            counts.clear()

        for batch in rows:
            for r in batches.runs(batch):
                got = align(*batches.spans(r.column("text")), first, second)
                k = r.num_rows
                cells = [pa.array(part + row + np.arange(k)), r.column("doc_id").cast(long), *(pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(got["groups_sha256"], text)]
                cells += [_lists(got["pairs"], got["n_pairs"], long), _lists(got["times"], got["n_pairs"], pa.int32()), none(k, pa.list_(long)), none(k, pa.list_(long))]
                row += k
                yield pa.RecordBatch.from_arrays(cells, names=_NAMES)
                if len(got["pairs"]):
                    one, n = _summed([got["pairs"]], [got["times"].astype(np.int64)])
                    keys.append(one)
                    counts.append(n)
                    held += len(one)
                if held > GATHER:
                    yield from handed_on()
                    held = 0
        if keys:
            yield from handed_on()

    return run


_NAMES = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "keys", "counts"]
_ENCODED = f"uid long, {_DOC}, pairs array<long>, times array<int>, keys array<long>, counts array<long>"


def _known(heavy, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a column, their numbers in the table of heavy ones, whether they are there, and each row's number of pairs."""
    pairs = column.flatten().to_numpy()
    at = np.minimum(np.searchsorted(heavy[0], pairs), max(len(heavy[0]) - 1, 0))
    hit = heavy[0][at] == pairs if len(heavy[0]) else np.zeros(len(pairs), bool)
    return pairs, at, hit, np.diff(column.offsets.to_numpy())


def _weighed(told):
    def run(rows):
        heavy = told.value
        for b in rows:
            _, at, hit, n = _known(heavy, b.column("pairs"))
            times = b.column("times").flatten().to_numpy().astype(np.int64) * hit
            if len(heavy[0]) and float(times.sum()) * float(heavy[1].max()) > 2.0**62 and (times * heavy[1][at].astype(float)).sum() > 2.0**62:
                raise OverflowError("a document's sum of counts does not fit 64 bits")
            total, best = (sums(times * v[at], n) if len(heavy[0]) else np.zeros(len(n), np.int64) for v in heavy[1:])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _NAMES[:7]), pa.array(best), pa.array(total)], names=[*_NAMES[:7], "best", "total"])

    return run


def _light(told):
    def run(rows):
        for b in rows:
            pairs, _, hit, n = _known(told.value, b.column("pairs"))
            uid = np.repeat(b.column("uid").to_numpy(), n)[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(pairs[~hit]), pa.array(b.column("times").flatten().to_numpy()[~hit])], names=["uid", "key", "times"])

    return run


def pair_counts(encoded: DataFrame, width: int) -> DataFrame:
    """key, n, best: links of each pair of ids over the corpus, and whether no pair of its B id has more."""
    rows = encoded.where("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    counts = rows.groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("n")).withColumn("b", F.col("key") % width)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(df: DataFrame, a: str, b: str, heavy: int = HEAVY) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a``: file of a byte-level tokenizer, ``b``: of a sentencepiece BPE model.  Null and empty texts, and those that either tokenizer does not
    spell out byte for byte, have zeros and an empty digest; repeated rows and null doc_ids are documents
    of their own; ties for the highest count of a B id all count; an empty table gives no row.  Columns other than doc_id and text are not read.
    A very long text is one run: some 100 bytes of memory a byte of it.  A sum of counts beyond 62 bits is an error.
    """
    spark = df.sparkSession
    width = _vocabulary(b)
    encoded, _ = scratch.store(df.select("doc_id", "text").mapInArrow(_encode(a, b), _ENCODED), "aligned")
    counts, _ = scratch.store(pair_counts(encoded, width), "pair-counts")
    least = (counts.agg(F.sum("n").alias("n")).first().n or 0) // heavy + 1  # fewer than ``heavy`` pairs are as frequent
    top = counts.where(F.col("n") >= least).toArrow().sort_by("key")
    told = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "best")))
    docs = encoded.where("uid IS NOT NULL")
    sure = docs.select(*_NAMES[:9]).mapInArrow(_weighed(told), f"uid long, {_DOC}, best long, total long")
    rare = docs.select("uid", "pairs", "times").mapInArrow(_light(told), "uid long, key long, times int")
    rare = rare.join(counts.where(F.col("n") < least), "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("n")).alias("_total"), F.sum(F.col("times") * F.col("best").cast("int")).alias("_best"))
    more = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long")
    return sure.join(rare, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("best", "_best").alias("n_best"), more("total", "_total").alias("count_sum"), "groups_sha256")


@lru_cache(None)
def _vocabulary(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
