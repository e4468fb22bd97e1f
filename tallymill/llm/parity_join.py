"""Jaccard join of word n-gram sets by parity sketches.

A sketch XORs every shingle of a set into the block and bit that its hash names; what two sets
share cancels out, so the Hamming distance of two sketches is at most the size of the symmetric
difference.  Sets a <= b with Jaccard similarity J or more differ in at most
(1 - J) / (1 + J) * (a + b) shingles, and each differing shingle changes one block.  Among the
first d + 1 blocks of a set that hold anything (d: that bound for its largest partner) at least one
is therefore equal in both sets (pigeonhole); equal blocks are found by an equi-join on their XOR
within bands of sizes.  Sets that meet are screened by the Hamming distance of bit sketches, then
verified exactly on their shingles.

Where a set fills no more blocks than that bound, the argument fails for its band; every set of such a
band is then found by single shingles, of which the first d + 1 of two similar sets always share one.

Equal sets are one class throughout.  Of the classes that meet in a block each is first compared
with the smallest; in groups that this leaves in several components, each row outside the largest one
with the row of another component whose sketch is closest.  What still has a close row in another
component is compared exactly where the group is at hand: a task tells only links that join two of
its components.  So no step tells more pairs than its groups have rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import batches, components, scratch, words
from tallymill.llm.exact_dedup import SPARE, without
from tallymill.llm.words import mix

WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4  # shingle length; similarity 3/4
#: Up to this size a block is a single hash value; beyond, a band of sizes below hi has hi / PER_BLOCK blocks.
SMALL, PER_BLOCK = 64, 2.4
#: Keys that a partition of the block join gets on average; rows, and shingles, of a chunk of a group.
KEYS, CHUNK, CHUNK_SHINGLES = 500_000, 2048, 1 << 20
#: Documents of one task with a block in common from which on the block counts as hot there.
HOT = 64
#: Blocks that a task follows from one run of text to the next.
FOLLOWED = 1 << 18
LOW = np.uint64(0xFFFFFFFF)

_TURN = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 | 1 for k in range(1, WORDS + 1)], np.uint64)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and how many each text has.

    A text of fewer words has one shingle, of all of them; a text without words none.
    """
    hashed, n = words.hashes(data, offs)
    total = len(hashed)
    size = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    if not total:
        return np.zeros(0, np.uint64), size
    first = batches.gather(np.cumsum(n) - n, size)
    left = np.repeat(n, size)
    padded = np.concatenate([hashed, np.zeros(WORDS, np.uint64)])
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), np.uint64)
        for k in range(WORDS):
            term = mix(padded[first + k] * _TURN[k] + np.uint64(k))
            h += np.where(left > k, term, np.uint64(0)) if (n < WORDS).any() else term
        h = mix(h)
    ends = np.cumsum(size)
    for lo, hi in zip((ends - size).tolist(), ends.tolist()):
        h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(ends - size)[size > 0]] = True
    return h[new], batches.sums(new, size)


def digests(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
            ends = np.cumsum(n)
            out.append(mix(total[ends] - total[ends - n] + np.uint64(salt) * n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def bits_of(n: np.ndarray) -> np.ndarray:
    """Bits of a set's sketch: a power of two, 2 a shingle or more."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(1, 2 * n))).astype(np.int64))


def sketches(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Bit sketches: the parity of the shingles at each bit; halves of one fold by XOR."""
    bits = bits_of(n)
    begin = np.cumsum(bits) - bits
    at = np.repeat(begin, n) + (h & np.repeat((bits - 1).astype(np.uint64), n)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : (a + b) // 8] for a, b in zip(begin.tolist(), bits.tolist())]


def block_keys(h: np.ndarray, n: np.ndarray, fine: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Set number and key of each block by which a set is found, over all its size bands; and the bands (as
    bits) in which a set fills too few blocks for the pigeonhole argument.

    A set belongs to the band of its size, and to the next one if a partner there is possible.  In the bands
    of ``fine`` every shingle is a block of its own, as in those of small sets.
    """
    who, keys, short = [], [], 0
    band = np.floor(np.log2(np.maximum(1, n))).astype(np.int64)
    set_of = np.repeat(np.arange(len(n)), n)
    for step in (0, 1):
        top = 2 << (band + step)  # sizes of the band are below
        reach = np.minimum(n * DENOMINATOR // NUMERATOR, top - 1)
        member = (n > 0) & (reach >= top // 2)
        single = (top <= SMALL) | ((fine >> (band + step)) & 1 > 0)
        blocks = np.round(top / PER_BLOCK).astype(np.int64)
        most = (DENOMINATOR - NUMERATOR) * (n + reach) // (DENOMINATOR + NUMERATOR)  # differing shingles
        use = np.flatnonzero(member[set_of])
        if not len(use):
            continue
        s, own = set_of[use], h[use]
        at = np.where(single[s], own, ((own >> np.uint64(32)) * blocks[s].astype(np.uint64)) >> np.uint64(32))
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 0) | (at[1:] != at[:-1])]))
        owner = s[heads]
        rank = np.arange(len(heads)) - np.searchsorted(owner, owner)
        kept = rank <= most[owner]
        few = member & (np.bincount(owner, minlength=len(n)) <= most)
        short |= int(np.bitwise_or.reduce(np.left_shift(1, (band + step)[few]), initial=0))
        with np.errstate(over="ignore"):
            value = mix(np.bitwise_xor.reduceat(own, heads) + mix(at[heads] * np.uint64(64) + (band + step)[owner].astype(np.uint64)))
        who.append(owner[kept])
        keys.append(value[kept])
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    return np.concatenate(who), np.concatenate(keys), short


def _sets(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*batches.spans(run.column("text")))


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), n, d1, d2, sketch of each document's set."""

    def run_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in batches.runs(batch):
                h, n = _sets(run)
                d1, d2 = digests(h, n)
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), run.column("row"), pa.array(n), pa.array(d1), pa.array(d2), pa.array(sketches(h, n), pa.binary())], ["doc_id", "row", "n", "d1", "d2", "sketch"])

    return docs.mapInArrow(run_, "doc_id long, row long, n long, d1 long, d2 long, sketch binary")


class Followed:
    """Keys that occurred more than once in a run, with their counts over a task's runs (the rarest go beyond FOLLOWED)."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Counts so far of the distinct sorted ``keys``."""
        total = counts.copy()
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            total += np.where(self.keys[at] == keys, self.counts[at], 0)
        again = total > 1
        both = np.concatenate([keys[again], self.keys])
        self.keys, first = np.unique(both, return_index=True)
        self.counts = np.concatenate([total[again], self.counts])[first]
        if len(self.keys) > FOLLOWED:
            stay = self.counts > np.partition(self.counts, -FOLLOWED)[-FOLLOWED]
            self.keys, self.counts = self.keys[stay], self.counts[stay]
        return total


def meetings(docs: DataFrame, parts: int, hot: int = HOT, fine: int = 0) -> DataFrame:
    """Groups of classes (by d1) that share a block: sid, members (sorted 64-bit numbers), portion.

    Keys are dealt out by their hash.  A key is dealt out by key and class instead from the run on in which
    ``hot`` documents of a task have had it, so no task gathers it; its home partition gets a mark, and what
    came there becomes one more portion of the same group.  All other groups are whole and told once.
    A row without ``portion`` names, as bits of sid, bands in which some set is short of blocks.
    """

    def rows(kind: int, part: np.ndarray, keys: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        keys, sets = keys[order], sets[order]
        some, begin = np.unique(part[order], return_index=True)
        ends = np.append(begin[1:], len(order))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([kind] * len(some), pa.int32()), cut(keys), cut(sets)], ["part", "kind", "keys", "sets"])

    def home(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(4 * parts) >> np.uint64(32)).astype(np.int64)

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        followed = Followed()
        for batch in it:
            for run in batches.runs(batch):
                h, n = _sets(run)
                who, keys, short = block_keys(h, n, fine)
                if short & ~fine:
                    yield rows(3, np.zeros(1, np.int64), np.array([short & ~fine], np.uint64), np.zeros(1, np.int64))
                if not len(keys):
                    continue
                d1 = digests(h, n)[0][who]
                one, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
                many = followed.add(one, counts)[at] >= hot
                few = ~many
                yield rows(0, home(keys[few]), (keys[few] & LOW).astype("<u4"), d1[few])
                if many.any():
                    with np.errstate(over="ignore"):
                        yield rows(1, home(mix(keys[many] + mix(d1[many].view(np.uint64)))), keys[many], d1[many])
                    marked = np.unique(keys[many])
                    yield rows(2, home(marked), marked, np.zeros(len(marked), np.int64))

    def told(sid: np.ndarray, sets: np.ndarray, heads: np.ndarray, ends: np.ndarray, portion: bool) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(sid), 20_000):
            some = slice(lo, lo + 20_000)
            members = [sets[x:y].tobytes() for x, y in zip(heads[some], ends[some])]
            yield pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(members, pa.binary()), pa.array([portion] * len(members))], ["sid", "members", "portion"])

    def grouped(key: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, distinct members, and where each key's begin and end."""
        order = np.lexsort((sets, key))
        key, sets = key[order], sets[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])])[: len(key)]
        key, sets = key[new], sets[new]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        return key, sets, heads, np.append(heads[1:], len(key)).astype(np.int64)[: len(heads)]

    def name(keys: np.ndarray) -> np.ndarray:
        return mix(keys ^ np.uint64(0xA54FF53A5F1D36F1)).view(np.int64)

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[tuple[int, int], list] = {}
        for batch in it:
            for p, kind, k, s in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("keys"), batch.column("sets")):
                by_part.setdefault((p, kind), []).append((np.frombuffer(k.as_buffer(), "<u8" if kind else "<u4").copy(), np.frombuffer(s.as_buffer(), "<i8").copy()))
        whole = lambda p, kind: [np.concatenate(x) for x in zip(*by_part.pop((p, kind), [(np.zeros(0, "<u8" if kind else "<u4"), np.zeros(0, "<i8"))]))]
        for p in sorted({p for p, _ in by_part}):
            if len(short := whole(p, 3)[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.bitwise_or.reduce(short, keepdims=True).view(np.int64)), pa.array([b""], pa.binary()), pa.nulls(1, pa.bool_())], ["sid", "members", "portion"])
            key, sets, heads, ends = grouped(*whole(p, 1))
            yield from told(name(key[heads]), sets, heads, ends, True)
            key, sets = whole(p, 0)
            marks = np.unique(whole(p, 2)[0])
            if len(marks) and len(key):
                at = np.minimum(np.searchsorted(low := np.sort((marks & LOW).astype("<u4")), key), len(marks) - 1)
                here = low[at] == key
                full = marks[np.argsort((marks & LOW).astype("<u4"), kind="stable")][at[here]]
                own, own_sets, heads, ends = grouped(full, sets[here])
                yield from told(name(own[heads]), own_sets, heads, ends, True)
                key, sets = key[~here], sets[~here]
            order = np.argsort(key, kind="stable")
            key, sets = key[order], sets[order]
            same = key[1:] == key[:-1]
            multi = np.concatenate([same, [False]])[: len(key)] | np.concatenate([[False], same])[: len(key)]
            key, sets, heads, ends = grouped(key[multi], sets[multi])
            if not len(key):
                continue
            with np.errstate(over="ignore"):
                sid = mix(np.add.reduceat(mix(sets.view(np.uint64)), heads)).view(np.int64)
            use = np.flatnonzero(ends - heads > 1)
            use = use[np.unique(sid[use], return_index=True)[1]]
            yield from told(sid[use], sets, heads[use], ends[use], False)

    blobs = docs.select("text").mapInArrow(keyed, "part int, kind int, keys binary, sets binary")
    found = blobs.repartition(parts, "part").mapInArrow(meet, "sid long, members binary, portion boolean")
    return found.groupBy("sid", "portion", F.when(F.col("portion"), F.xxhash64("members")).alias("which")).agg(F.any_value("members").alias("members")).drop("which")


def stars(met: DataFrame) -> DataFrame:
    """Each member of a group with the smallest one: distinct pairs a, b."""
    whole = met.where("NOT portion").mapInArrow(_stars, "a long, b long")
    split = met.where("portion").select("sid", "members").mapInArrow(_members, "sid long, id long")
    least = split.groupBy("sid").agg(F.min("id").alias("b"))
    spread = split.join(least, "sid").where("id <> b").select(F.col("id").alias("a"), "b")
    return whole.unionByName(spread).distinct()


def _close(na, nb, apart) -> np.ndarray:
    """Whether sizes and a lower bound of the symmetric difference admit the similarity."""
    return (np.minimum(na, nb) * DENOMINATOR >= np.maximum(na, nb) * NUMERATOR) & (apart * (DENOMINATOR + NUMERATOR) <= (na + nb) * (DENOMINATOR - NUMERATOR))


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a, b whose sketches' Hamming distance admits the similarity."""

    def run_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                keep[k] = _close(na[k], nb[k], int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = (F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR)
    joined = pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(run_, "a long, b long")


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, str]:
    """The sorted shingles of the classes ``ids`` (distinct), from one text of each: id, set; and the table's path."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in batches.runs(batch):
                h, n = _sets(run)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([run.column("id"), pa.array([h[a:b].tobytes() for a, b in zip(ends - n, ends)], pa.binary())], ["id", "set"])

    wanted = classes.join(ids, "id", "left_semi").select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["row"] == wanted["row"])).select("id", "text").dropDuplicates(["id"])
    return scratch.store(texts.mapInArrow(make, "id long, set binary"), "near-sets")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs a, b those whose sets have the similarity, from the shingles of the texts."""

    def run_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common * DENOMINATOR >= NUMERATOR * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets, path = sets_of(ids, classes, docs)
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
    out, _ = scratch.store(joined.select("a", "b", "xa", "xb").mapInArrow(run_, "a long, b long"), "near-links")
    scratch.drop(pairs.sparkSession, path)
    return out


def _stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        a, b = [], []
        for m in batch.column("members"):
            m = np.frombuffer(m.as_buffer(), np.int64)
            a.append(m[1:])
            b.append(np.full(len(m) - 1, m[0]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for sid, m in zip(batch.column("sid").to_pylist(), batch.column("members")):
            m = np.frombuffer(m.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), sid)), pa.array(m)], ["sid", "id"])


def _whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (sid, deal), which come together."""
    held: list[pa.RecordBatch] = []

    def parts(t: pa.Table, sid: np.ndarray, deal: np.ndarray) -> Iterator[pa.Table]:
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(sid) != 0) | (np.diff(deal) != 0)]))
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(sid)]):
            yield t.slice(lo, hi - lo)

    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        sid, deal = batch.column("sid").to_numpy(), batch.column("deal").to_numpy()
        if held[0].column("sid")[0].as_py() == sid[-1] and held[0].column("deal")[0].as_py() == deal[-1]:
            continue  # one group so far
        t = pa.Table.from_batches(held)
        sid, deal = t.column("sid").to_numpy(), t.column("deal").to_numpy()
        cut = int(np.flatnonzero((sid != sid[-1]) | (deal != deal[-1]))[-1]) + 1
        yield from parts(t.slice(0, cut), sid[:cut], deal[:cut])
        held = t.slice(cut).to_batches()
        batches.settle(t.nbytes)
    if held:
        t = pa.Table.from_batches(held)
        yield from parts(t, t.column("sid").to_numpy(), t.column("deal").to_numpy())


def _outside(comp: np.ndarray) -> np.ndarray:
    """Rows outside the largest component: every pair of two components has one."""
    names, at, counts = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(at != counts.argmax()) if len(names) > 1 else np.zeros(0, np.int64)


def _close_pairs(t: pa.Table, told: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows p, q of two components of a group whose sketches are close, and their distances; pairs of rows ``told`` may be left out."""
    comp, n, side, deal = (t.column(c).to_numpy() for c in ("comp", "n", "side", "deal"))
    rest = _outside(comp)
    if not len(rest):
        return
    rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("sketch").combine_chunks()]
    size = min(map(len, rows))
    x = np.stack([_folded(r, size) for r in rows])
    step, block = max(1, (1 << 19) // len(x)), max(1, (1 << 22) // size)
    for s in range(0, len(rest), step):
        r = rest[s : s + step]
        hit = (comp[r, None] != comp[None]) & (np.minimum(n[r, None], n[None]) * DENOMINATOR >= np.maximum(n[r, None], n[None]) * NUMERATOR)
        if deal[0] > 0:
            hit &= side[r, None] != side[None]
        if told is not None:
            hit &= ~(told[r, None] & told[None])
        p, q = np.nonzero(hit)
        p = r[p]
        for k in range(0, len(p), block):
            pk, qk = p[k : k + block], q[k : k + block]
            apart = np.bitwise_count(x[pk] ^ x[qk]).sum(1, dtype=np.int64)
            good = _close(n[pk], n[qk], apart)
            if good.any():
                yield pk[good], qk[good], apart[good]


def _closest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a (sid, deal) outside its largest component the closest row of another one, as a > b."""
    told: list[np.ndarray] = []  # groups overlap: pairs are told once for the groups at hand
    for t in _whole(it):
        ids = t.column("id").to_numpy()
        best = np.full((2, len(ids)), np.iinfo(np.int64).max)
        for p, q, apart in _close_pairs(t):
            order = np.lexsort((ids[q], apart, p))
            order = order[np.flatnonzero(np.diff(p[order], prepend=-1))]
            p, q, apart = p[order], q[order], apart[order]
            better = apart < best[0, p]
            best[0, p[better]], best[1, p[better]] = apart[better], q[better]
        p = np.flatnonzero(best[0] < np.iinfo(np.int64).max)
        if len(p):
            q = best[1, p]
            told.append(np.stack([np.maximum(ids[p], ids[q]), np.minimum(ids[p], ids[q])], 1))
        if sum(map(len, told)) > 1 << 18:
            yield _pairs(np.concatenate(told))
            told = []
    if told:
        yield _pairs(np.concatenate(told))


def _near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (sid, deal) the rows that have a row of another component there whose sketch is close: members (ids in order) and comps."""
    for t in _whole(it):
        told = np.zeros(len(t), bool)
        for p, q, _ in _close_pairs(t, told):
            told[p] = told[q] = True
        if told.any():
            ids, comp = t.column("id").to_numpy()[told], t.column("comp").to_numpy()[told]
            order = np.argsort(ids)
            yield pa.RecordBatch.from_arrays([pa.array([x[order].tobytes()], pa.binary()) for x in (ids, comp)], ["members", "comps"])


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for sid, m, c in zip(batch.column("sid").to_pylist(), batch.column("members"), batch.column("comps")):
            m, c = (np.frombuffer(x.as_buffer(), np.int64) for x in (m, c))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), sid)), pa.array(np.zeros(len(m), np.int64)), pa.array(m), pa.array(c)], ["sid", "deal", "id", "comp"])


def _joining(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b within each sid that join two components there: fewer than rows, whatever the group.

    A row's intersections with all rows come from an inverted index of the group's shingles.
    """
    told: list[tuple[int, int]] = []
    for t in _whole(it):
        ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
        rest = _outside(comp)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set").combine_chunks()]
        n = np.array([len(x) for x in sets])
        ends = np.cumsum(n)
        _, term, size = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        posting = np.repeat(np.arange(len(n)), n)[np.argsort(term, kind="stable")]
        begin = np.cumsum(size) - size
        label = np.unique(comp, return_inverse=True)[1]
        for r in rest.tolist():
            other = label != label[r]
            if not other.any():
                break  # one component by now
            own = term[ends[r] - n[r] : ends[r]]
            common = np.bincount(posting[batches.gather(begin[own], size[own])], minlength=len(n))
            linked = np.flatnonzero(other & (common * DENOMINATOR >= NUMERATOR * (n[r] + n - common)))
            if len(linked):
                names, first = np.unique(label[linked], return_index=True)
                told += [(max(ids[r], ids[q]), min(ids[r], ids[q])) for q in linked[first]]
                label[np.isin(label, names)] = label[r]
        if len(told) > 1 << 16:
            yield _pairs(np.array(told))
            told = []
    if told:
        yield _pairs(np.array(told))


def _pairs(told: np.ndarray) -> pa.RecordBatch:
    a, b = np.unique(told, axis=0).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def mixed(met: DataFrame, classes: DataFrame, found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of the groups that hold several components of ``found``: sid, deal, side, id, comp, n, sketch; and the tables it reads.

    Groups of more than CHUNK rows or CHUNK_SHINGLES shingles are dealt out as pairs of chunks, so no task gathers a hot one.
    """
    node = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("comp"), "sketch")
    node, node_path = scratch.store(node, "near-nodes")
    member = met.where("portion IS NOT NULL").select("sid", "members").mapInArrow(_members, "sid long, id long").join(node.select("id", "n", "comp"), "id")
    member, member_path = scratch.store(member, "near-members")
    size = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("long")
    several = member.groupBy("sid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), size.alias("chunks")).where("lo <> hi")
    several, path = scratch.store(several.select("sid", "chunks"), "near-mixed")
    rows = member.join(several, "sid").join(node.select("id", "sketch"), "id")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("id"), "chunks"))
    deals = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
        lambda k: F.when(k == F.col("side"), -F.col("side")).otherwise(1 + F.least(k, F.col("side")) * (1 << 31) + F.greatest(k, F.col("side"))),
    )
    dealt = rows.withColumn("deal", F.explode(deals)).select("sid", "deal", "side", "id", "comp", "n", "sketch")
    return dealt.repartition("sid", "deal").sortWithinPartitions("sid", "deal"), [node_path, member_path, path]


def closest(met: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of rows that meet, of different components of ``found``: each row outside a group's largest one with the closest."""
    rows, paths = mixed(met, classes, found)
    told, _ = scratch.store(rows.mapInArrow(_closest, "a long, b long").distinct(), "near-closest")
    scratch.drop(met.sparkSession, *paths)
    return told


def across(met: DataFrame, classes: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """Links that join components of ``found``: with them all links within the groups are in one component."""
    rows, paths = mixed(met, classes, found)
    near = rows.mapInArrow(_near, "members binary, comps binary").groupBy("members").agg(F.any_value("comps").alias("comps"))  # the same rows meet in many groups
    near = near.withColumn("sid", F.xxhash64("members")).mapInArrow(_rows, "sid long, deal long, id long, comp long")
    near, near_path = scratch.store(near, "near-close")
    scratch.drop(met.sparkSession, *paths)
    sets, sets_path = sets_of(near.select("id").distinct(), classes, docs)
    told = near.join(sets, "id").repartition("sid").sortWithinPartitions("sid").mapInArrow(_joining, "a long, b long").distinct()
    told, _ = scratch.store(told, "near-joining")
    scratch.drop(met.sparkSession, near_path, sets_path)
    return told


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), n, and the first (doc_id, row) of the component of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    seen, _ = scratch.store(profile(rows), "near-profiles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    classes = seen.where("n > 0").groupBy(F.col("d1").alias("id"), "n", "d2").agg(first, F.any_value("sketch").alias("sketch"))
    classes, _ = scratch.store(classes, "near-classes")
    keys = int(seen.agg(F.sum(F.col("n") * 0.5 + 2)).first()[0] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys // KEYS + 1)
    fine, short = 0, 1
    while short:  # practically once: hashing fills blocks enough
        met, met_path = scratch.store(meetings(rows, parts, fine=fine), "near-meetings")
        short = met.where("portion IS NULL").agg(F.bit_or("sid")).first()[0] or 0
        fine |= short
    scratch.release(spark)

    tried, tried_path = scratch.store(screened(stars(met), classes), "near-stars")
    some = components.components(verified(tried, classes, rows))
    scratch.release(spark)
    for exact in (False, True):  # the first round merges most of what is left at little cost
        if exact:
            fresh = across(met, classes, rows, some)
        else:
            fresh = verified(closest(met, classes, some).join(tried, ["a", "b"], "left_anti"), classes, rows)
            scratch.drop(spark, tried_path)
        if not fresh.isEmpty():  # the components so far stand in for their links
            some = components.components(some.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh))
        scratch.release(spark)
    scratch.drop(spark, met_path)

    named = classes.join(some.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("d1"), "n", "d2", F.coalesce("component", "id").alias("comp"), "first")
    least = named.groupBy("comp").agg(F.min("first").alias("least"))
    named, _ = scratch.store(named.join(least, "comp").select("d1", "n", "d2", "least"), "near-components")
    return seen.select("doc_id", "row", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left").select("doc_id", "row", "n", "least")


def groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Null text is empty; a text without words has an empty set, links with nothing, and is its own
    component.  Rows with equal sets are one class.  A null doc_id stands behind all others: it is
    the component only of rows that reach no other.  Repeated rows give repeated results; an empty
    table gives no row; columns other than doc_id and text are ignored.
    """
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of :func:`groups`, with all its columns.

    The row of the smallest doc_id stays (of rows that share it, one text; of repeats, any one).
    All texts without words stay.
    """
    stays = F.col("least").isNull() | F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.row") == F.col("row"))
    rows = _grouped(docs).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    rows = rows.agg(F.bool_or(stays).alias("_kept"), ((F.count("*") > 1) & (F.max("n") > 0)).alias("_repeats"))
    gone, _ = scratch.store(rows.where("NOT _kept OR _repeats"), "near-gone")
    on = lambda t: docs["doc_id"].eqNullSafe(t["_id"]) & (F.xxhash64(docs["text"]) == t["_row"])
    left, again = without(docs, gone.select("_id", "_row"), on(gone)), gone.where("_kept").select("_id", "_row")
    if again.isEmpty():
        return left
    again = docs.join(again, on(again), "left_semi").withColumn(SPARE, F.xxhash64("text")).dropDuplicates(["doc_id", SPARE]).drop(SPARE)
    return left.unionByName(again)
