"""Filters, joins, windows, sampling and set operations over rows with explicit order columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.operators.selection import bottom_each


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def where_equal(df: DataFrame, **eq) -> DataFrame:
    """Rows whose columns equal all values; None is a value."""
    return df.where(_all([F.col(k).eqNullSafe(F.lit(v)) for k, v in eq.items()]))


def where_given(df: DataFrame, **eq) -> DataFrame:
    """As :func:`where_equal`, but None asks nothing."""
    return where_equal(df, **{k: v for k, v in eq.items() if v is not None})


def where_present(df: DataFrame, **eq) -> DataFrame:
    """Rows that equal the values wherever they have one; absent columns ask nothing."""
    return df.where(_all([F.col(k).isNull() | (F.col(k) == F.lit(v)) for k, v in eq.items() if k in df.columns]))


def canonical(df: DataFrame, rename: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Columns renamed, defaults for absent columns and nulls."""
    df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order (a total one, for a fixed result)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], flag: str, order: Sequence[str] = ()) -> DataFrame:
    """Flags of both sides under shared keys as flag_a and flag_b; of repeated keys the last row counts."""
    sides = []
    for df, name in ((a, "flag_a"), (b, "flag_b")):
        df = keep_last(df, keys, order) if order else df
        sides.append(df.select(*keys, F.col(flag).alias(name)))
    return sides[0].join(sides[1], list(keys))


def paired_first(a: DataFrame, b: DataFrame, keys: Sequence[str], flag: str, order: Sequence[Column | str]) -> DataFrame:
    """As :func:`paired`, but every row of ``a`` meets the first row of ``b`` with its keys; null keys meet none."""
    first = keep_first(b, keys, order).select(*keys, F.col(flag).alias("flag_b"))
    return a.withColumn("flag_a", F.col(flag)).drop(flag).join(first, list(keys))


def shared_and_only(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``b`` with ``side``: ``shared`` (the first row of a key that ``a`` has, too) or ``only`` (all rows of other keys)."""
    keys = a.select(key).distinct()
    shared = keep_first(b, [key], [order]).join(keys, key, "left_semi").withColumn("side", F.lit("shared"))
    return shared.unionByName(b.join(keys, key, "left_anti").withColumn("side", F.lit("only")))


def key_mismatch(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with ``side`` a or b."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("b")))


def grid(axes: Sequence[DataFrame], unsupported: Column | None = None) -> DataFrame:
    """All combinations of small axis tables, without the unsupported ones."""
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)
    return out if unsupported is None else out.where(~unsupported)


def provenance(df: DataFrame, cell: Sequence[str], text: str, order: str) -> DataFrame:
    """``unique_group``: the first order value with the text in the cell; ``is_first_occurrence``."""
    first = F.min(order).over(W.partitionBy(*cell, text))
    return df.withColumn("unique_group", first).withColumn("is_first_occurrence", F.col(order) == F.col("unique_group"))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], width: int = 3, name: str = "number") -> DataFrame:
    """Zero-padded numbers from 1 within each group."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0")))


def head_each(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def step_deltas(df: DataFrame, by: Sequence[str], step: str, value: str) -> DataFrame:
    """``delta``: the value less that of the step before."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(step)))


def seeded(key: Column | str, seed: int) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(seeded(key, seed), key).limit(n)


def pool(fixed: DataFrame, padding: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The fixed rows in key order (source ``spec``), then sampled padding (``pad``) up to n rows; ``ord`` from 0."""
    head = fixed.withColumn("source", F.lit("spec")).withColumn("_o", F.lpad(F.col(key).cast("string"), 20, "0"))
    tail = padding.join(fixed.select(key), key, "left_anti").withColumn("source", F.lit("pad")).withColumn("_o", seeded(key, seed))
    rows = head.unionByName(tail).orderBy(F.col("source").desc(), "_o", key).limit(n)
    return rows.withColumn("ord", F.row_number().over(W.orderBy(F.col("source").desc(), "_o", key)) - 1).drop("_o")  # n rows


def _digested(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_digest", seeded(key, seed))


def stratified_share(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """A sample of n rows at most: of each stratum its share of n, one row at least.

    No stratum's share exceeds n, so tasks hand on the n smallest digests of each.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_all"))
    quota = sizes.crossJoin(F.broadcast(total)).select(F.col(stratum).alias("_s"), F.greatest(F.lit(1), F.round(F.lit(n) * F.col("_size") / F.col("_all"))).alias("_quota"))
    ranked = bottom_each(_digested(df, key, seed), stratum, ["_digest", key], n)
    return ranked.join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).where("rank <= _quota").orderBy("_digest", key).limit(n).select(*df.columns)


def stratified_equal(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """A sample of n rows: as many of each stratum, topped up from the rest; n smallest digests of a stratum are all that can be in it."""
    strata = df.agg(F.countDistinct(stratum).alias("_strata"))
    ranked = bottom_each(_digested(df, key, seed), stratum, ["_digest", key], n)
    ranked = ranked.crossJoin(F.broadcast(strata)).withColumn("_top", F.col("rank") > F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_strata"))))
    return ranked.orderBy("_top", "_digest", key).limit(n).select(*df.columns)


def first_passing(df: DataFrame, passes: Column, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows that pass; their order is part of the meaning."""
    return df.where(passes).orderBy(*order).limit(n)


def layered(base: DataFrame, override: DataFrame, defaults: DataFrame, cell: Sequence[str], seed: str, value: str) -> DataFrame:
    """Values by (cell, seed): the override, else the base, else a default for known cells only."""
    keys = [*cell, seed]
    both = base.select(*keys, F.col(value).alias("_b")).join(override.select(*keys, F.col(value).alias("_o")), keys, "full")
    known = both.select(*cell).distinct()
    filled = defaults.join(known, list(cell), "left_semi").select(*keys, F.col(value).alias("_d"))
    return both.join(filled, keys, "full").select(*keys, F.coalesce("_o", "_b", "_d").alias(value))


def precedence(layers: Sequence[DataFrame], keys: Sequence[str], value: str, cell: Sequence[str] = (), defaults: int = 0) -> DataFrame:
    """keys and value of any number of layers, the first that has one winning.

    A null value gives way to later layers; a key that has nothing else keeps it.  The last ``defaults`` layers fill only cells (the ``cell``
    columns, some of the keys) that another layer knows.  All layers are one union, brought together once, by cell.
    """
    if defaults and not cell:
        raise ValueError("defaults need the columns of a cell")
    sure = len(layers) - defaults
    rows = union_all(*(df.select(*keys, F.col(value).alias("_v"), F.lit(k).alias("_layer")) for k, df in enumerate(layers)))
    if defaults:
        known = F.min("_layer").over(W.partitionBy(*cell)) < sure
        rows = rows.repartition(*cell).withColumn("_known", known).where("_known")
    return rows.groupBy(*keys).agg(F.min_by("_v", F.struct(F.col("_v").isNull(), F.col("_layer"))).alias(value))


def first_with_rows(*dfs: DataFrame) -> DataFrame:
    """The first frame that has a row, else the last one."""
    return next((df for df in dfs[:-1] if not df.isEmpty()), dfs[-1])


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def positions_agree(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """One row: whether both frames hold equal values at equal positions, and no position alone."""
    both = a.select(position, F.col(value).alias("_a")).join(b.select(position, F.col(value).alias("_b")), position, "full")
    return both.agg(F.coalesce(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))), F.lit(True)).alias("agree"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differences"))
