"""Near-duplicate embeddings by lattice hashing.

Random projections of a unit vector into 8-dimensional blocks are decoded to points of
the E8 lattice; a table's cell is the tuple of its blocks' points.  A vector stands in its own cell of every
table and also asks the cells around it that lie closest.  What stands in a cell is its number and a 64-bit
sketch; only rows whose sketch comes near another one's of the cell fetch their vectors, which are compared by
cosine in double precision.  Whether two vectors are compared is decided by the two and the :class:`Setting` alone, never by the number of rows of the
table, of a label or of a cell.  A task tells only links that join what it has not joined yet, so fewer than
it has rows.  Links are counted afterwards, where all links lie: within components, each pair of
chunks of a component once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import batches, components, scratch
from tallymill.llm.words import mix



class Setting(NamedTuple):
    """Tables, blocks of a cell, the deviation of a projected coordinate (a Gaussian projection of a unit vector has unit variance
    whatever its length, so one scale serves all dimensions), and cells of a table that a vector asks, its own one among them."""

    tables: int
    blocks: int
    scale: float
    asked: int


#: Settings that a caller may choose, by the number of different vectors of a label up to which a vector meets a few dozen unlike ones: in all, vectors meet at a cosine of 0.93 with probability 0.998 or more.
SETTINGS = [(100_000, Setting(12, 2, 0.62, 12)), (1_000_000, Setting(16, 2, 0.7, 20)), (None, Setting(22, 3, 0.6, 32))]
#: The setting of all tables, whatever their size, unless a caller names another one.
SETTING = SETTINGS[0][1]
#: Closest neighbours of a block's point that asked cells are made of.
NEIGHBOURS = 6
#: Sketch bits in which rows of a cell may differ to be compared: at the threshold 7.7 of 64 differ, with a deviation of 2.6.
APART = 24
#: Rows of a cell or component beyond which it is dealt out in pairs of chunks, of half as many rows each.
CHUNK = 2048
COSINE = 0.93


@lru_cache(None)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for k in range(256):
        signs = np.array([1 - 2 * (k >> i & 1) for i in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(-1) % 2)
    if len(odd):
        off = x[odd] - f[odd]
        at = np.abs(off).argmax(-1)
        f[odd, at] += np.where(off[np.arange(len(odd)), at] < 0, -1, 1)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: in D8, or in D8 moved by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


def setting_of(rows: int) -> Setting:
    """The setting that a caller may choose for so many vectors of one label; none is chosen by the rows at hand."""
    return next(s for most, s in SETTINGS if most is None or rows <= most)


@lru_cache(None)
def projections(dim: int, setting: Setting) -> np.ndarray:
    rng = np.random.default_rng([81, dim])
    return rng.standard_normal((setting.tables, setting.blocks, dim, 8)) * setting.scale


@lru_cache(None)
def _choices(blocks: int) -> np.ndarray:
    """Which of its point (0) and that point's closest neighbours (from 1) each block of a cell takes; the own cell comes first."""
    return np.array([c for c in product(range(NEIGHBOURS + 1), repeat=blocks) if sum(k > 0 for k in c) <= 2])


def cells(unit: np.ndarray, setting: Setting = SETTING) -> np.ndarray:
    """Keys of the cells of each unit vector: [vector, table, 0] its own, the others those it asks."""
    n, dim = unit.shape
    out, choices = np.zeros((n, setting.tables, setting.asked), np.uint64), _choices(setting.blocks)
    for t in range(setting.tables):
        costs, keys = np.zeros((n, len(choices))), np.zeros((n, len(choices)), np.uint64)
        for b in range(setting.blocks):
            x = unit @ projections(dim, setting)[t, b]
            v = decode(x)
            lean = (x - v) @ roots().T  # a neighbour's squared distance is larger by 2 - 2 lean
            near = np.argpartition(-lean, NEIGHBOURS - 1, 1)[:, :NEIGHBOURS]
            cost = np.concatenate([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(lean, near, 1)], 1)
            key = np.stack([_key(v, t * setting.blocks + b), *(_key(v + roots()[near[:, k]], t * setting.blocks + b) for k in range(NEIGHBOURS))], 1)
            costs += cost[:, choices[:, b]]
            with np.errstate(over="ignore"):
                keys = keys * np.uint64(3) + key[:, choices[:, b]]
        least = 1 + np.argpartition(costs[:, 1:], setting.asked - 2, 1)[:, : setting.asked - 1]
        out[:, t] = mix(np.take_along_axis(keys, np.concatenate([np.zeros((n, 1), np.int64), least], 1), 1))
    return out


def sketches(unit: np.ndarray) -> np.ndarray:
    """The signs of 64 random projections."""
    signs = unit @ np.random.default_rng([82, unit.shape[1]]).standard_normal((unit.shape[1], 64)) > 0
    return np.packbits(signs, axis=1).view(np.uint64)[:, 0]


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    whole = (2 * points).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(points), np.uint64(salt + 1), np.uint64)
        for k in range(8):
            h = mix(h + whole[:, k] + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
    return h


def _units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, of finite vectors that are not zero; the largest and smallest numbers are scaled first."""
    x = raw.astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        norm = np.sqrt((x * x).sum(1))
    odd = ~np.isfinite(norm) | (norm < 1e-150)
    if odd.any():
        x[odd] /= np.abs(x[odd]).max(1, keepdims=True)
        norm[odd] = np.sqrt((x[odd] * x[odd]).sum(1))
    return x / norm[:, None]


def _stacked(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def celled(reps: DataFrame, kind: str, setting: Setting) -> DataFrame:
    """id, label, sketch, the keys of all cells of each vector (per table its own, then those it asks), and its numbers, of ``reps`` (id, label, embedding)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lists = part.column("embedding")
                size = np.diff(lists.offsets.to_numpy())
                for dim in np.unique(size).tolist():
                    own = part.filter(pa.array(size == dim))
                    raw = own.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    unit = _units(raw)
                    salt = mix(own.column("label").to_numpy().view(np.uint64) + np.uint64(dim << 40))
                    keys = mix(cells(unit, setting) ^ salt[:, None, None]).reshape(len(raw), -1)
                    columns = [own.column("id"), own.column("label"), pa.array(sketches(unit).view(np.int64)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([v.tobytes() for v in raw], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "label", "sketch", "cells", "vector"])

    return reps.select("id", "label", "embedding").mapInArrow(run, "id long, label long, sketch long, cells binary, vector binary")


def _standing(it: Iterator[pa.RecordBatch], asked: int, more: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """A row for each cell of each vector."""
    for batch in it:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            if not part.num_rows:
                continue
            keys = _stacked(part.column("cells"), "<i8")
            at = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
            own = pa.array(np.tile(np.arange(keys.shape[1]) % asked == 0, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), own, *(part.column(c).take(at) for c in more)], ["key", "own", *more])


def near(key: np.ndarray, own: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Numbers of the rows, sorted by key, whose sketch comes near that of another vector of the cell, one of the two standing in its own cell."""
    head = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
    size = np.diff(head, append=len(key))
    two = head[size == 2]
    hit = (own[two] | own[two + 1]) & (ids[two] != ids[two + 1]) & (np.bitwise_count(sketch[two] ^ sketch[two + 1]) <= APART)
    found = [two[hit], two[hit] + 1]
    for lo, n in zip(head[size > 2].tolist(), size[size > 2].tolist()):
        hi = lo + n
        if own[lo:hi].any():
            found.append(lo + np.flatnonzero(_live(own[lo:hi], ids[lo:hi], sketch[lo:hi], ids[lo:hi], APART)))
    return np.sort(np.concatenate(found))


def _live(own: np.ndarray, ids: np.ndarray, sketch: np.ndarray, side: np.ndarray, apart: int) -> np.ndarray:
    """Which rows of a cell come near another vector of another side, one of the two standing in its own cell."""
    live = np.zeros(len(ids), bool)
    for s in range(0, len(ids), 512):
        at = slice(s, s + 512)
        close = np.bitwise_count(sketch[at, None] ^ sketch[None, :]) <= apart
        live[at] = (close & (own[at, None] | own[None, :]) & (ids[at, None] != ids[None, :]) & (side[at, None] != side[None, :])).any(1)
    return live


def _screened(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, own, id of the rows of :func:`near`; the rows of a key come together."""

    def out(t: pa.Table) -> pa.RecordBatch:
        key, own, ids, sketch = (t.column(c).to_numpy() for c in ("key", "own", "id", "sketch"))
        at = near(key, own, ids, sketch.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(own[at]), pa.array(ids[at])], ["key", "own", "id"])

    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column("key")[batch.num_rows - 1].as_py()
        t = pa.Table.from_batches(held)
        before = np.flatnonzero(t.column("key").to_numpy() != last)
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut:
            yield out(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        batches.settle(batch.nbytes)
    if held:
        yield out(pa.Table.from_batches(held))


def _whole(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each (key, deal), which come together."""
    held: list[pa.RecordBatch] = []

    def parts(t: pa.Table) -> Iterator[pa.Table]:
        k, deal = t.column(key).to_numpy(), t.column("deal").to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 0) | (np.diff(deal) != 0)]))
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(k)]):
            yield t.slice(lo, hi - lo)

    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        k, deal = t.column(key).to_numpy(), t.column("deal").to_numpy()
        before = np.flatnonzero((k != k[-1]) | (deal != deal[-1]))
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut:
            yield from parts(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        batches.settle(batch.nbytes)
    if held:
        yield from parts(pa.Table.from_batches(held))


def dealt(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """``rows`` of each key with side and deal: those of a key in ``sizes`` (key, chunks) stand in every pair of chunks that has theirs.

    deal: 0 or less for a chunk by itself, above 0 for two chunks.
    """
    chunks = F.coalesce(F.col("chunks"), F.lit(1).cast("long"))
    rows = rows.join(sizes, key, "left").withColumn("side", F.pmod(F.xxhash64("id"), chunks))
    deals = F.transform(
        F.sequence(F.lit(0).cast("long"), chunks - 1),
        lambda k: F.when(k == F.col("side"), -F.col("side")).otherwise(1 + F.least(k, F.col("side")) * (1 << 31) + F.greatest(k, F.col("side"))),
    )
    return rows.withColumn("deal", F.explode(deals)).drop("chunks").repartition(key, "deal").sortWithinPartitions(key, "deal")


def joining(reps: DataFrame, kind: str, setting: Setting = SETTING) -> DataFrame:
    """Links a, b of ``reps`` (id, label, embedding; no null label) that join all vectors that meet, with sketches near and cosine >= COSINE.

    Cells of more than CHUNK rows are dealt out as pairs of chunks, so no task gathers a hot cell; its rows are screened by the same sketches.
    """
    apart = APART

    def screen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "own", "id", "side", "deal"]
        for t in _whole(it, "key"):
            own, ids, sketch, side, deal = (t.column(c).to_numpy() for c in ("own", "id", "sketch", "side", "deal"))
            live = _live(own, ids, sketch.view(np.uint64), side if deal[0] > 0 else ids, apart)
            if live.any():  # of two chunks only rows of different ones meet
                yield from t.select(names).filter(pa.array(live)).combine_chunks().to_batches()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in _whole(it, "key"):
            own, n = t.column("own").to_numpy(), len(t)
            if n < 2 or not own.any():
                continue
            ids, label, side, deal = (t.column(c).to_numpy() for c in ("id", "label", "side", "deal"))
            sketch = t.column("sketch").to_numpy().view(np.uint64)
            x, root = _units(_stacked(t.column("vector").combine_chunks(), kind)), np.arange(n)
            for s in range(0, n, 512):
                e = min(n, s + 512)
                hit = x[s:e] @ x.T >= COSINE
                hit &= np.bitwise_count(sketch[s:e, None] ^ sketch[None, :]) <= apart
                hit &= (own[s:e, None] | own[None, :]) & (label[s:e, None] == label[None, :]) & (ids[s:e, None] != ids[None, :])
                if deal[0] > 0:  # of two chunks only rows of different ones meet
                    hit &= side[s:e, None] != side[None, :]
                for r in np.flatnonzero(hit.any(1)).tolist():
                    linked = np.flatnonzero(hit[r] & (root != root[s + r]))
                    if len(linked):
                        names, first = np.unique(root[linked], return_index=True)
                        a += [ids[s + r]] * len(first)
                        b += ids[linked[first]].tolist()
                        root[np.isin(root, names)] = root[s + r]
            if len(a) > 1 << 16:
                yield _pairs(a, b)
                a, b = [], []
        if a:
            yield _pairs(a, b)

    codes, _ = scratch.store(celled(reps, kind, setting), "vector-cells")
    sizes = codes.select("cells").mapInArrow(partial(_standing, asked=setting.asked), "key long, own boolean").groupBy("key").agg(F.count("*").alias("n"), F.bool_or("own").alias("some"))
    hot, _ = scratch.store(sizes.where((F.col("n") > CHUNK) & F.col("some")).select("key", F.ceil(F.col("n") / (CHUNK // 2)).cast("long").alias("chunks")), "hot-cells")
    rows = codes.select("cells", "id", "sketch").mapInArrow(partial(_standing, asked=setting.asked, more=("id", "sketch")), "key long, own boolean, id long, sketch long")
    cool = rows.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_screened, "key long, own boolean, id long")
    one = F.lit(0).cast("long")
    warm = dealt(rows.join(hot, "key", "left_semi"), hot, "key").mapInArrow(screen, "key long, own boolean, id long, side long, deal long")
    met = cool.select("*", one.alias("side"), one.alias("deal")).unionByName(warm)
    rows = met.join(codes.select("id", "label", "sketch", "vector"), "id").repartition("key", "deal").sortWithinPartitions("key", "deal")
    return rows.mapInArrow(meet, "a long, b long").distinct()


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    x, y = np.unique(np.sort(np.array([a, b], np.int64), 0).T, axis=0).T
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def linked(rows: DataFrame, kind: str) -> DataFrame:
    """Rows that each vector of a component links with: id, linked; ``rows``: comp, id, size, vector.

    Components of more than CHUNK vectors are dealt out as pairs of chunks; every pair is compared once.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(it, "comp"):
            ids, size, side, deal = (t.column(c).to_numpy() for c in ("id", "size", "side", "deal"))
            x, total = _units(_stacked(t.column("vector").combine_chunks(), kind)), np.zeros(len(t), np.int64)
            for s in range(0, len(t), 512):
                hit = x[s : s + 512] @ x.T >= COSINE
                hit &= side[s : s + 512, None] != side[None, :] if deal[0] > 0 else ids[s : s + 512, None] != ids[None, :]
                total[s : s + 512] = hit @ size
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "linked"])

    sizes = rows.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    hot, _ = scratch.store(sizes.select("comp", F.ceil(F.col("n") / (CHUNK // 2)).cast("long").alias("chunks")), "hot-components")
    return dealt(rows, hot, "comp").mapInArrow(count, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def _numbers(it: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in it:
        vectors = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in batch.column("embedding")]
        yield pa.RecordBatch.from_arrays([batch.column("comp"), batch.column("id"), batch.column("size"), pa.array(vectors, pa.binary())], ["comp", "id", "size", "vector"])


def groups(vectors: DataFrame, setting: Setting = SETTING) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are compared when labels are equal and not null and vectors have one length; vectors that
    are null, empty, zero or hold a null or non-finite component link with nothing.  Rows with
    equal vectors are one class: they link with each other (a row is no link of itself).  A null
    vec_id links as any other row, stands behind all numbers, and is the component only of rows that
    reach no number.  Rows of one vec_id and different vectors count singly.  An empty table gives no row; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    real = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    content = F.when(real & F.col("label").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.to_json("embedding")), 256))
    hashed = rows.withColumn("content", content)
    classes = hashed.where("content IS NOT NULL").groupBy("content").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("size"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding")
    )
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    classes, _ = scratch.store(classes.withColumn("id", F.xxhash64("content")), "vector-classes")
    pairs, _ = scratch.store(joining(classes, kind, setting), "vector-links")
    whole, _ = scratch.store(components.components(pairs).withColumnRenamed("node", "id").withColumnRenamed("component", "comp"), "vector-components")
    members = classes.join(whole, "id").mapInArrow(partial(_numbers, kind=kind), "comp long, id long, size long, vector binary")
    more = linked(members, kind)
    named = classes.select("content", "id", "first", "size").join(more, "id", "left").join(whole, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = named.groupBy("comp").agg(F.min("first").alias("least"))
    found = named.join(least, "comp").select("content", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), "least")
    out = hashed.select("vec_id", "content").join(found, "content", "left")
    component = F.when(F.col("content").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
