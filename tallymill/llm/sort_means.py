"""Centroid clustering in exact integers: Lloyd's rounds, each scanned in the order of sorted centroid distances.

A round orders, for each centroid, the others by their distance from it.  A vector begins at the
centroid of its previous assignment, at distance d, and tries the others in that order until one lies
strictly farther than 2 d from the starting one: by the triangle inequality that one and all after it are
farther from the vector than d, so none of them can win or tie.

The table of vectors is written once a round with its new assignment, and the same tasks write the sums
of their vectors as a few more rows of it; a round's sums are read back by those columns alone.
The table of the round before is dropped, so at most two stand at a time and a lost executor costs a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import scratch

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components below this size: squared distances, and four times them, stay within 63 bits up to ``WIDE`` components.
LIMIT, WIDE = 1 << 26, 64
_STATE = "vec_id long, v array<int>, cluster int, distance long, part int, sums array<long>, n long"


def kept(df: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v: vectors of ``dim`` components, none null or non-finite, as integers floor(scale * x)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.where((F.size("embedding") == dim) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    small = F.forall("x", lambda e: F.abs(e * scale) < LIMIT)
    message = F.concat(F.lit("components too large for exact 64-bit distances in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    ints = F.when(small, F.transform("x", lambda e: F.floor(e * scale).cast("int"))).otherwise(F.raise_error(message).cast("array<int>"))
    return rows.select("vec_id", ints.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; a null vec_id comes last, equal ones by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def scan(v: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number of equals) and squared distance of each row; how many distances were taken."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    best = previous.copy()
    start = ((v - centroids[previous]) ** 2).sum(axis=1)
    least, taken = start.copy(), len(v)
    for c in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == c)
        rows = rows[np.argsort(-start[rows], kind="stable")]  # the farthest scan longest
        reach = -4 * start[rows]
        for other in np.argsort(apart[c], kind="stable").tolist():
            if other == c:
                continue
            n = int(np.searchsorted(reach, -apart[c, other], "right"))  # rows with apart <= 4 * start
            if not n:
                break
            live = rows[:n]
            taken += n
            d = ((v[live] - centroids[other]) ** 2).sum(axis=1)
            wins = (d < least[live]) | ((d == least[live]) & (other < best[live]))
            best[live[wins]], least[live[wins]] = other, d[wins]
    return best, least, taken


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _round(centroids: np.ndarray, dim: int):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("part", pa.int32()), ("sums", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches):
        k = len(centroids)
        sums, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), dim)
            best, least, _ = scan(v, b.column("cluster").to_numpy().astype(np.int64), centroids)
            n += np.bincount(best, minlength=k)
            for c in np.unique(best).tolist():
                sums[c] += v[best == c].sum(axis=0)
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(best, pa.int32()), pa.array(least), none.cast(pa.int32()), none.cast(pa.list_(pa.int64())), none.cast(pa.int64())], schema=schema
            )
        own = np.flatnonzero(n)
        if len(own):
            none = pa.nulls(len(own))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.list_(pa.int32())), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(own, pa.int32()), pa.array(sums[own].tolist(), pa.list_(pa.int64())), pa.array(n[own])], schema=schema
            )

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' means: one row a task and cluster is read, k rows a component reach the driver."""
    out = centroids.copy()
    parts = state.where("part IS NOT NULL").select("part", "n", F.posexplode("sums").alias("j", "s"))
    for r in parts.groupBy("part", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r.part, r.j] = int(r.s) // r.n
    return out


def clusters(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold null or non-finite components have no row; a null
    vec_id and repeated rows count as vectors of their own (null ids seed no centroid while others are there).  Fewer kept
    vectors than k make as many centroids; an empty table gives no row.  Ties go to the smaller centroid number; an empty centroid stays
    where it is.  Components of 65,536 or more (times 1,024), and more than 64 of them, are an error, never a wrapped number.  Columns other than vec_id and
    embedding are not read.  Rounds after one that moved no centroid would repeat it and are not run.
    """
    if dim > WIDE:
        raise ValueError(f"exact distances need {WIDE} components at most")
    spark = df.sparkSession
    vectors = kept(df, dim, scale)
    none = lambda kind: F.lit(None).cast(kind)
    state, path = scratch.store(vectors.select("vec_id", "v", F.lit(0).alias("cluster"), none("long").alias("distance"), none("int").alias("part"), none("array<long>").alias("sums"), none("long").alias("n")), "vectors")
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return state.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for step in range(rounds + 1):
        rows = state.where("part IS NULL").select("vec_id", "v", "cluster")
        old = path
        state, path = scratch.store(rows.mapInArrow(_round(centroids, dim), _STATE), "vectors")
        scratch.drop(spark, old)
        if step == rounds:
            break
        new = _moved(state, centroids)
        if (new == centroids).all():
            break
        centroids = new
    found = state.where("part IS NULL").select("vec_id", "cluster", "distance")
    sizes = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    inertia = {r.cluster: r.s for r in sizes}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", pick([inertia.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), pick(digests).alias("centroid_sha256"),
    )
