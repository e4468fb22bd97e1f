"""Bootstrap intervals, paired differences, detectable effects and checks of posted numbers."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.numbering import read_in_order, write_in_order
from tallymill.session import shared_folder

RESAMPLES, ALPHA = 10_000, 0.05
CHUNK = 1 << 22
#: Draws of one replicate that a task makes at a time, and draws of all replicates that meet a chunk of rows (in the mean).
BLOCK, MEET = 1 << 17, 1 << 20


def _quantiles(values: np.ndarray, alpha: float) -> tuple[float, float]:
    low, high = np.quantile(values, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def bootstrap(values: np.ndarray, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0) -> tuple[float, float, float, int]:
    """Point, low, high and n of the percentile bootstrap of a mean; NaN for no value.

    Draws come in rows of one generator, so working in chunks gives the same numbers.
    """
    x = np.asarray(values, float)
    if not len(x):
        return float("nan"), float("nan"), float("nan"), 0
    rng, means = np.random.default_rng(seed), []
    step = max(1, CHUNK // len(x))
    for lo in range(0, resamples, step):
        means.append(rng.choice(x, size=(min(step, resamples - lo), len(x)), replace=True).mean(axis=1))
    return float(x.mean()), *_quantiles(np.concatenate(means), alpha), len(x)


def paired_bootstrap(a: np.ndarray, b: np.ndarray, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0) -> tuple[float, float, float, float, int]:
    """Point, low, high, one-sided p (share of differences <= 0) and n of rate(a) - rate(b), rows drawn once for both."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape:
        raise ValueError(f"{a.shape} values against {b.shape}")
    if not len(a):
        return (float("nan"),) * 4 + (0,)
    rng, diffs = np.random.default_rng(seed), []
    step = max(1, CHUNK // len(a))
    for lo in range(0, resamples, step):
        rows = rng.integers(0, len(a), size=(min(step, resamples - lo), len(a)))
        diffs.append(a[rows].mean(axis=1) - b[rows].mean(axis=1))
    d = np.concatenate(diffs)
    return float(a.mean() - b.mean()), *_quantiles(d, alpha), float((d <= 0).mean()), len(a)


def bootstrap_cells(df: DataFrame, keys: Sequence[str], flag: str, order: str, **how) -> DataFrame:
    """:func:`bootstrap` of the 0/1 flags of each cell, in the order of ``order``.

    A cell comes to one worker: cells are evaluation sets.  For large cells use :func:`binomial_cells`.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        point, low, high, n = bootstrap(pdf[flag].to_numpy(), **how)
        return pd.DataFrame([[*pdf[list(keys)].iloc[0], point, low, high, n]], columns=[*keys, "point", "ci_low", "ci_high", "n"])

    rows = df.select(*keys, order, F.col(flag).cast("int").alias(flag))
    types = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "point double, ci_low double, ci_high double, n long"]))


def paired_cells(pairs: DataFrame, keys: Sequence[str], a: str, b: str, order: str, **how) -> DataFrame:
    """:func:`paired_bootstrap` of each cell of aligned flags."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame([[*pdf[list(keys)].iloc[0], *paired_bootstrap(pdf[a].to_numpy(), pdf[b].to_numpy(), **how)]], columns=[*keys, "point", "ci_low", "ci_high", "p_value", "n"])

    rows = pairs.select(*keys, order, F.col(a).cast("int").alias(a), F.col(b).cast("int").alias(b))
    types = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "point double, ci_low double, ci_high double, p_value double, n long"]))


def paired_strict(a: DataFrame, b: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Flags of both sides under shared keys; a repeated key on either side fails the query."""
    sides = []
    for df, name in ((a, "flag_a"), (b, "flag_b")):
        n = F.count("*")
        one = F.when(n == 1, F.any_value(flag)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("repeated key"), *[F.col(k).cast("string") for k in keys])))
        sides.append(df.groupBy(*keys).agg(one.cast(dict(df.dtypes)[flag]).alias(name)))
    return sides[0].join(sides[1], list(keys))


def binomial_cells(df: DataFrame, keys: Sequence[str], flag: str, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """As :func:`bootstrap_cells` from counts alone: a resampled mean of n flags is Binomial(n, k/n)/n."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, n in zip(pdf["k"], pdf["n"]):
                out.append(_quantiles(np.random.default_rng(seed).binomial(n, k / n, resamples) / n, alpha))
            pdf["point"] = pdf["k"] / pdf["n"]
            pdf["ci_low"], pdf["ci_high"] = zip(*out) if out else ((), ())
            yield pdf[[*keys, "point", "ci_low", "ci_high", "n"]]

    counts = df.groupBy(*keys).agg(F.count_if(F.col(flag)).alias("k"), F.count("*").alias("n"))
    types = dict(counts.dtypes)
    return counts.mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "point double, ci_low double, ci_high double, n long"]))


def _digests(b: int, first: int, count: int) -> np.ndarray:
    """The first 32 bits of md5("b:j") for ``count`` draws j from ``first``."""
    return np.frombuffer(b"".join(hashlib.md5(b"%d:%d" % (b, j), usedforsecurity=False).digest()[:4] for j in range(first, first + count)), ">u4")


def _drawn(n_keys: int, size: int, chunk: int, names: list[str]):
    """Places in each chunk of a cell that a block of a replicate's draws falls on, of batches (keys, n, block, b) in the order of b, block and falling n."""

    def run(batches):
        held, digests = None, np.zeros(0, np.uint32)
        for batch in batches:
            for i, (n, block, b) in enumerate(zip(*(batch.column(n_keys + k).to_pylist() for k in range(3)))):
                count = min(size, n - block * size)
                if held != (b, block) or len(digests) < count:
                    held, digests = (b, block), _digests(b, block * size, count)
                r = np.sort(digests[:count].astype(np.int64) % n)
                found, heads = np.unique(r // chunk, return_index=True)
                at = [(r[lo:hi] - c * chunk).astype("<u2").tobytes() for c, lo, hi in zip(found.tolist(), heads.tolist(), [*heads[1:].tolist(), count])]
                row = pa.array([i] * len(at))
                keys = [batch.column(k).take(row) for k in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found), pa.array([b] * len(at), pa.int32()), pa.array(at, pa.binary())], names=names)

    return run


def _pack(places: bytes) -> bytes:
    """Sorted places of two bytes as a byte that tells a gap's width, and the gaps in a Huffman code: some three bits a draw."""
    gaps = np.diff(np.frombuffer(places, "<u2"), prepend=np.uint16(0))
    width = 1 if gaps.max(initial=0) < 256 else 2
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return bytes([width]) + coder.compress(gaps.astype(f"<u{width}").tobytes()) + coder.flush()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw[1:], -15), f"<u{raw[0]}"), dtype=np.int64)


def _packed(drawn):
    """The batches of :func:`_drawn` with their places packed."""

    def run(batches):
        for batch in drawn(batches):
            columns = [pa.array(map(_pack, c.to_pylist()), pa.binary()) if name == "_places" else c for name, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _met(n_keys: int, whole: list[bool], chunk: int, resamples: int, names: list[str]):
    """Sums and counts of each value over the draws of each replicate that fall into a chunk; null values count in neither."""

    def run(key, rows: pa.Table, draws: pa.Table) -> pa.Table:
        place = rows.column("_place").to_numpy()
        values, there = [], []
        for v, is_whole in enumerate(whole):
            column = rows.column(f"_{v}")
            x, ok = np.zeros(chunk, np.int64 if is_whole else np.float64), np.zeros(chunk, bool)
            ok[place] = column.is_valid().to_numpy()
            x[place] = column.fill_null(0).to_numpy()
            values.append(x)
            there.append(ok)
        sums = [np.zeros(resamples, x.dtype) for x in values]
        counts = [np.zeros(resamples, np.int64) for _ in values]
        for b, raw in zip(draws.column("b").to_pylist(), draws.column("_places")):
            at = _unpack(raw.as_py())
            for v in range(len(values)):
                sums[v][b] += values[v][at].sum()
                counts[v][b] += np.count_nonzero(there[v][at])
        keys = [pa.array([k.as_py()] * resamples, k.type) for k in key[:n_keys]]
        return pa.Table.from_arrays([*keys, pa.array(np.arange(resamples, dtype=np.int32)), *map(pa.array, sums), *map(pa.array, counts)], names=names)

    return run


def hash_bootstrap(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str, resamples: int = 200) -> DataFrame:
    """Replicate means of each value column by a bootstrap whose draws any SQL engine repeats: keys, b, mean_<value>.

    Draw j of replicate b is the row of number md5("b:j") (its first 32 bits) modulo the cell's rows.  Rows are numbered over ranges of a sort and cut into
    chunks; draws are made in blocks, by as many tasks as there is work for, and travel as gaps of some three bits each to the chunk they fall on.  So a task
    holds a chunk's values and the draws on it, some ``MEET``, whatever the cell's size.  Chunks are dealt out by number, a few a task, where adaptive
    execution would bring 64 MB of draws into each.  Cells with a null key have no result; a null value is not counted.
    """
    spark, n_keys = df.sparkSession, len(keys)
    chunk = max(1, min(1 << 16, MEET // resamples))
    types = dict(df.dtypes)
    whole = [types[v] in ("boolean", "tinyint", "smallint", "int", "bigint") for v in values]
    path = shared_folder(spark, "ranked")
    cast = [F.col(v).cast("long" if w else "double").alias(f"_{k}") for k, (v, w) in enumerate(zip(values, whole))]
    write_in_order(df.select(*keys, F.col(order).alias("_order"), *cast).dropna(subset=list(keys)), path, [*keys, "_order"])
    rows = read_in_order(spark, path, "_number")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_number").alias("_first"))
    r = F.col("_number") - F.col("_first")
    placed = rows.join(sizes, list(keys)).select(*keys, F.floor(r / chunk).alias("_chunk"), (r % chunk).cast("int").alias("_place"), *(f"_{k}" for k in range(len(values))))

    total = sizes.agg(F.sum("n")).first()[0] or 0
    work = total * resamples // MEET
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), work)
    meetings = max(spark.sparkContext.defaultParallelism, work // 4)
    blocks = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("_block"))
    blocks = blocks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).repartition(tasks, "b", "_block").sortWithinPartitions("b", "_block", F.col("n").desc())
    key_types = [f"`{k}` {types[k]}" for k in keys]
    names = [*keys, "_chunk", "b", "_places"]
    draws = blocks.mapInArrow(_packed(_drawn(n_keys, BLOCK, chunk, names)), ", ".join([*key_types, "_chunk long, b int, _places binary"]))

    names = [*keys, "b", *(f"_sum{k}" for k in range(len(values))), *(f"_n{k}" for k in range(len(values)))]
    kinds = [*key_types, "b int", *(f"_sum{k} {'long' if w else 'double'}" for k, w in enumerate(whole)), *(f"_n{k} long" for k in range(len(values)))]
    placed, draws = (side.repartition(meetings, *keys, "_chunk").groupBy(*keys, "_chunk") for side in (placed, draws))
    parts = placed.cogroup(draws).applyInArrow(_met(n_keys, whole, chunk, resamples, names), ", ".join(kinds))
    means = [(F.sum(f"_sum{k}").cast("double") / F.nullif(F.sum(f"_n{k}"), F.lit(0))).alias(f"mean_{v}") for k, v in enumerate(values)]
    return parts.groupBy(*keys, "b").agg(*means)


def interval(means: DataFrame, keys: Sequence[str], value: Column, alpha: float = ALPHA) -> DataFrame:
    """Interpolated percentiles of replicate values, and the share of them that are 0 or less."""
    return means.groupBy(*keys).agg(
        F.percentile(value, F.lit(alpha / 2)).alias("ci_low"), F.percentile(value, F.lit(1 - alpha / 2)).alias("ci_high"), F.avg((value <= 0).cast("double")).alias("p_value")
    )


def order_interval(means: DataFrame, keys: Sequence[str], value: Column, alpha: float = ALPHA) -> DataFrame:
    """The sorted replicate values at int(q * B), without interpolation."""
    at = lambda q: F.element_at("_v", (F.floor(F.lit(q) * F.size("_v")) + 1).cast("int"))
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v")).select(*keys, at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


def detectable_effect(n: Column, alpha: float = ALPHA, power: float = 0.8, base: float = 0.5) -> Column:
    """Smallest difference of two rates that n rows an arm show; infinite without rows."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(n > 0, F.lit(z) * F.sqrt(F.lit(2 * base * (1 - base)) / n)).otherwise(F.lit(float("inf")))


def decisions(df: DataFrame, point: str = "point", low: str = "ci_low", gain: float = 0.10, margin: float = 0.03) -> DataFrame:
    """Gate decisions over paired differences: a clear gain, within the margin, halt."""
    clear = (F.col(point) >= gain) & (F.col(low) > 0)
    return df.withColumn("clear_gain", clear).withColumn("within_margin", F.abs(F.col(point)) <= margin).withColumn("halt", F.col(point) < 0)


def reversal(rates: DataFrame, keys: Sequence[str], none: str, first: str, second: str) -> DataFrame:
    """Whether the first constraint lowers the rate and the second makes up for it."""
    return rates.withColumn("reversal", (F.col(first) - F.col(none) < 0) & (F.col(second) >= F.col(none)))


def posted(computed: DataFrame, claims: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """Computed against posted numbers: key, computed, posted, agree (both null agree)."""
    both = computed.select(key, F.col(value).alias("computed")).join(claims.select(key, F.col(value).alias("posted")), key, "full")
    return both.withColumn("agree", F.round("computed", digits).eqNullSafe(F.round("posted", digits)))


def order_paired_cells(pairs: DataFrame, keys: Sequence[str], a: str, b: str, order: str, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = 42) -> DataFrame:
    """Mean of a - b of each cell, and the sorted replicate means at int(q * resamples); one draw of the rows a replicate.

    A cell comes to one worker, as in :func:`bootstrap_cells`.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = (pdf[a] - pdf[b])[pdf[order].argsort()].to_numpy()
        rng = np.random.default_rng(seed)
        means = np.sort([d[rng.integers(0, len(d), size=len(d))].mean() for _ in range(resamples)])
        return pd.DataFrame([[*pdf[list(keys)].iloc[0], d.mean(), means[int(alpha / 2 * resamples)], means[int((1 - alpha / 2) * resamples)], len(d)]], columns=[*keys, "delta", "low", "high", "n"])

    rows = pairs.select(*keys, order, F.col(a).cast("int").alias(a), F.col(b).cast("int").alias(b))
    types = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "delta double, low double, high double, n long"]))


def to_even(value: Column, digits: int) -> Column:
    """Rounded to digits, halves to the even digit, of the double's exact value (0.125 to 0.12, 2.675, which lies below, to 2.67).

    The product with 10^digits is taken with its rounding error (splitting both factors), which decides what looks like a half.  Null, NaN,
    infinities and numbers beyond 1e12 stay.
    """
    value, scale, split = value.cast("double"), float(10**digits), 134217729.0  # 2^27 + 1
    product = value * scale
    high = value * split - (value * split - value)
    scale_high = scale * split - (scale * split - scale)
    low, scale_low = value - high, scale - scale_high
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product).cast("double")
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
    return F.when(F.isnan(value) | (F.abs(value) > 1e12), value).otherwise((whole + F.when(up, 1.0).otherwise(0.0)) / scale)


def asserted_counts(found: DataFrame, expected: dict, key: str, count: str) -> DataFrame:
    """``found`` as it is; the query fails where a key's count is not the expected one, a key is missing, or one is not expected."""
    spark = found.sparkSession
    kind = dict(found.dtypes)[key]
    wanted = spark.createDataFrame([(k, int(n)) for k, n in expected.items()], f"_key {kind}, _wanted long")
    both = found.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("_key")), "full")
    message = F.concat_ws(" ", F.lit("count of"), F.coalesce(F.col(key).cast("string"), F.col("_key").cast("string"), F.lit("null")), F.lit("is"), F.coalesce(F.col(count).cast("string"), F.lit("none")), F.lit("and not"), F.coalesce(F.col("_wanted").cast("string"), F.lit("expected")))
    right = F.col(count).cast("long").eqNullSafe(F.col("_wanted"))
    return both.withColumn(count, F.when(right, F.col(count)).otherwise(F.raise_error(message).cast(dict(found.dtypes)[count]))).select(*found.columns)
