"""Numbers over all rows, or within groups of any size, without a task that sees them all.

Rows are spread over partitions or buckets, each is numbered by itself, and the numbers of rows
before it, a table of one row a partition or bucket, are added in a second pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.session import shared_folder

#: Rows of a bucket that :func:`bucket_count` aims at.
BUCKET_ROWS = 1 << 15
_INDEX = (1 << 33) - 1


def literal_rows(spark: SparkSession, rows: Sequence[Sequence[int]], columns: Sequence[str]) -> DataFrame:
    """A small table of whole numbers that stands in the plan itself."""
    if not rows:
        return spark.range(0).select(*(F.lit(0).cast("long").alias(c) for c in columns))
    values = ", ".join("(" + ", ".join(f"{int(v)}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def bucket_count(rows: int, groups: int = 1) -> int:
    """Buckets a group so that each holds about ``BUCKET_ROWS`` rows of an even group."""
    return max(1, -(-rows // (BUCKET_ROWS * groups)))


def numbered_in_buckets(df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """Gapless numbers from 0 within each ``by`` group, in the order of ``bucket``, then of ``order``.

    A task ranks one bucket; a group's buckets are counted and summed up by themselves.  ``df`` is read twice: pass a written table.
    """
    counts = df.groupBy(*by, bucket).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, bucket, before.alias("_before"))
    own = F.row_number().over(W.partitionBy(*by, bucket).orderBy(*order)) - 1
    return df.withColumn("_own", own).join(starts, [*by, bucket]).withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own")


def _ties(df: DataFrame) -> list[Column]:
    """A digest of the row, by which rows of equal order values are spread and put in a fixed order."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return [F.xxhash64(*plain)] if plain else []


def write_in_order(df: DataFrame, path: str, order: Sequence[Column | str], partitions: int | None = None) -> None:
    """Write rows as Parquet, range by range: ``_part`` and ``_index`` hold each row's range and its place there.

    Rows of equal order values follow the digest of the whole row, so a value that holds a large share of the
    rows is spread over ranges; only rows equal in every column stand together.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ties = _ties(df)
    keyed = df.withColumn("_tie", ties[0]) if ties else df.withColumn("_tie", F.lit(0))
    keys = [*order, "_tie"]
    ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
    ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX)).alias("_index")).write.mode("overwrite").parquet(path)


def read_in_order(spark: SparkSession, path: str, name: str = "number", start: int = 0) -> DataFrame:
    """The rows of :func:`write_in_order` with their number over the whole table.

    Counts a range (as many as the write had partitions) are read by their one column and stand in the plan as literals.
    """
    rows = spark.read.parquet(path)
    counts = sorted((r._part, r.n) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=start)
    starts = literal_rows(spark, [(p, b) for (p, _), b in zip(counts, before)], ["_part", "_before"])
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_index")).drop("_part", "_index", "_before")


def global_number(df: DataFrame, order: Sequence[Column | str], name: str = "number", start: int = 0, partitions: int | None = None) -> DataFrame:
    """All rows numbered from ``start`` in ``order``, by way of a table in the shared folder.

    Rows with equal order values are numbered by a digest of the row; null sorts as Spark sorts it.
    """
    path = shared_folder(df.sparkSession, "ordered")
    write_in_order(df, path, order, partitions)
    return read_in_order(df.sparkSession, path, name, start)
