"""Samples and first rows that hand on no more than they may keep, and scans that stop early."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.operators.numbering import write_in_order
from tallymill.session import shared_folder


def _smallest(table: pa.Table, stratum: str, order: Sequence[str], n: int) -> pa.Table:
    """The n first rows of each stratum in ``order``."""
    codes = table.column(stratum).combine_chunks().dictionary_encode()
    codes = codes.indices.fill_null(-1) if isinstance(codes, pa.DictionaryArray) else pa.concat_arrays([c.indices for c in codes.chunks]).fill_null(-1)
    ranked = table.append_column("_code", codes).sort_by([("_code", "ascending"), *((c, "ascending") for c in order)])
    code = ranked.column("_code").to_numpy()
    first = np.flatnonzero(np.diff(code, prepend=code[0] - 1 if len(code) else 0))
    place = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))
    return ranked.drop_columns(["_code"]).filter(pa.array(place < n))


def bottom_each(df: DataFrame, stratum: str, order: Sequence[str], n: int) -> DataFrame:
    """The n first rows of each stratum by the ascending, not null ``order`` columns, with their ``rank`` from 1.

    Tasks keep n rows a stratum while they read and hand on those alone, so what is shuffled
    grows with tasks and strata and not with their rows; a null stratum is one of its own.
    """

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > 4 * least[0]:
                kept = _smallest(pa.Table.from_batches(held), stratum, order, n)
                held, size = kept.to_batches(), kept.num_rows
                least[0] = max(least[0], size)
        if held:
            yield from _smallest(pa.Table.from_batches(held), stratum, order, n).to_batches()

    least = [max(n, 4096)]
    kept = df.mapInArrow(run, df.schema)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).where(F.col("rank") <= n)


def scan_in_order(df: DataFrame, passes: Column | Callable[[DataFrame], DataFrame], order: Sequence[str], n: int, ranges: int | None = None) -> tuple[DataFrame, int]:
    """The first n rows in ``order`` that pass a dear predicate, and how many rows it was asked about.

    The order columns alone are sorted, into ranges; then the rows of growing prefixes of
    ranges are evaluated, as many at a time as the share that passed so far suggests, until n have passed.  Rows of equal
    order values are evaluated together, and those that pass come in any order among themselves: make the order total.  ``passes``: a column, or a function
    from rows to the rows that pass.  Null order values come first.
    """
    spark = df.sparkSession
    keys, found = shared_folder(spark, "keys"), shared_folder(spark, "passed")
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_in_order(df.select(*order), keys, order, ranges)
    key = F.struct(*order)
    ends = spark.read.parquet(keys).groupBy("_part").agg(F.max(key).alias("end"), F.count("*").alias("rows")).orderBy("_part").collect()  # one row a range
    types = {f.name: f.dataType for f in df.select(*order).schema}
    literal = lambda end: F.struct(*(F.lit(end[c]).cast(types[c]).alias(c) for c in order))
    at, asked, passed, step = 0, 0, 0, 1
    df.limit(0).write.parquet(found)
    while at < len(ends) and passed < n:
        to = min(len(ends), at + step)
        inside = key <= literal(ends[to - 1].end)
        if at:
            inside &= key > literal(ends[at - 1].end)
        rows = df.where(inside)
        (passes(rows) if callable(passes) and not isinstance(passes, Column) else rows.where(passes)).write.mode("append").parquet(found)
        asked += sum(r.rows for r in ends[at:to])
        at, passed = to, spark.read.schema(df.schema).parquet(found).count()
        step = max(1, min(2 * at, -(-(n - passed) * at // passed) if passed else 2 * at))
    return spark.read.schema(df.schema).parquet(found).orderBy(*order).limit(n), asked
