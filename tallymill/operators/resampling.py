"""Bootstrap intervals whose replicates add up: Poisson weights by digest, sums as arrays, no draw table.

Every row has a weight in every replicate, a Poisson(1) number that depends on its key and the replicate
alone.  A task adds up weights and weighted values of its rows, an array a cell; arrays of
all tasks are summed by cell and replicate.  So a cell of any size is resampled in one pass, by any number of tasks, in any order, and paired values
of a row share its weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.statistics import interval

#: Replicates whose 16-bit numbers one sha256 holds.
BLOCK = 16
#: Cells a task holds before it hands on their sums.
CELLS = 4096
REPLICATES = 208


def poisson_limits() -> list[int]:
    """16-bit numbers u with weight(u) = how many limits are at most u: the distribution function of Poisson(1)."""
    limits, total = [], 0.0
    for k in range(9):
        total += exp(-1) / factorial(k)
        limits.append(round(65536 * total))
    return [x for x in limits if x < 65536]


def weights(keys: Sequence[str], replicates: int = REPLICATES) -> np.ndarray:
    """A row of weights for each key: 16 bits a replicate of sha256("key:block"), block = replicate div 16."""
    blocks = [f":{b}".encode() for b in range(-(-replicates // BLOCK))]
    raw = b"".join(hashlib.sha256(k + b).digest() for k in (x.encode() for x in keys) for b in blocks)
    u = np.frombuffer(raw, ">u2").reshape(len(keys), -1)[:, :replicates]
    return np.searchsorted(np.array(poisson_limits()), u, "right").astype(np.int64)


def _partial(n_keys: int, n_values: int, replicates: int, names: list[str]):
    def run(batches):
        sums: dict[tuple, list] = {}

        def out():
            cells = list(sums)
            columns = [pa.array([c[k] for c in cells], kinds[k]) for k in range(n_keys)]
            columns += [pa.array([sums[c][0].tolist() for c in cells], pa.list_(pa.int64()))]
            columns += [pa.array([sums[c][1][v].tolist() for c in cells], pa.list_(pa.float64())) for v in range(n_values)]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            kinds = [batch.column(k).type for k in range(n_keys)]
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                w = weights(b.column(n_keys).to_pylist(), replicates)
                values = [b.column(n_keys + 1 + v).to_numpy(zero_copy_only=False) for v in range(n_values)]
                rows: dict[tuple, list[int]] = {}
                for k, cell in enumerate(zip(*(b.column(k).to_pylist() for k in range(n_keys)))):
                    rows.setdefault(cell, []).append(k)
                for cell, at in rows.items():
                    mine = sums.setdefault(cell, [np.zeros(replicates, np.int64), np.zeros((n_values, replicates))])
                    mine[0] += w[at].sum(axis=0)
                    for v in range(n_values):
                        mine[1][v] += values[v][at] @ w[at]
                if len(sums) > CELLS:
                    yield out()
        if sums:
            yield out()

    return run


def poisson_bootstrap(df: DataFrame, keys: Sequence[str], values: Sequence[str | tuple[str, Column]], row: str, replicates: int = REPLICATES) -> DataFrame:
    """keys, b, weight, mean_<value>: the weighted mean of each value in each replicate.

    ``row`` names a row across the table (repeated keys share their weights).  Rows without all of the values or without a key count in no
    replicate.  A replicate that draws no row of a cell has a null mean.  Key columns may be null; no rows, no result.
    """
    if not keys:
        raise ValueError("name at least one key column; a constant one makes the whole table a cell")
    named = [(v, F.col(v)) if isinstance(v, str) else v for v in values]
    rows = df.select(*keys, F.col(row).cast("string").alias("_row"), *(c.cast("double").alias(f"_{v}") for v, c in named)).dropna(subset=["_row", *(f"_{v}" for v, _ in named)])
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "_w array<long>", *(f"`_{v}` array<double>" for v, _ in named)])
    names = [*keys, "_w", *(f"_{v}" for v, _ in named)]
    parts = rows.mapInArrow(_partial(len(keys), len(named), replicates, names), schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("_w", *(F.col(f"_{v}") for v, _ in named))).alias("b", "x"))
    total = each.groupBy(*keys, "b").agg(F.sum("x._w").alias("weight"), *(F.sum(F.col(f"x._{v}")).alias(f"_{v}") for v, _ in named))
    return total.select(*keys, "b", "weight", *((F.col(f"_{v}") / F.nullif("weight", F.lit(0))).alias(f"mean_{v}") for v, _ in named))


def cell_intervals(df: DataFrame, keys: Sequence[str], value: str, row: str, replicates: int = REPLICATES, alpha: float = 0.05) -> DataFrame:
    """keys, point, ci_low, ci_high, n of the mean of each cell."""
    point = df.where(F.col(value).isNotNull() & F.col(row).isNotNull()).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("point"), F.count(value).alias("n"))
    ci = interval(poisson_bootstrap(df, keys, [value], row, replicates), keys, F.col(f"mean_{value}"), alpha).drop("p_value")
    return point.join(ci, list(keys)).select(*keys, "point", "ci_low", "ci_high", "n")


def paired_intervals(pairs: DataFrame, keys: Sequence[str], a: str, b: str, row: str, replicates: int = REPLICATES, alpha: float = 0.05) -> DataFrame:
    """keys, point, ci_low, ci_high, p_value, n of mean(a) - mean(b): a pair's two values share its weights; rows that lack one do not count."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(row).isNotNull())
    point = both.groupBy(*keys).agg((F.avg(F.col(a).cast("double")) - F.avg(F.col(b).cast("double"))).alias("point"), F.count("*").alias("n"))
    ci = interval(poisson_bootstrap(both, keys, [a, b], row, replicates), keys, F.col(f"mean_{a}") - F.col(f"mean_{b}"), alpha)
    return point.join(ci, list(keys)).select(*keys, "point", "ci_low", "ci_high", "p_value", "n")
