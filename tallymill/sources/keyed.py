"""Tables of unique keys that are changed in place, bucket by bucket.

Keys are hashed to a fixed number of buckets, each a folder.  An upsert reads and rewrites the buckets
of the new keys alone; files of the others are not touched, which :func:`fingerprints` shows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.session import shared_folder

BUCKET = "_bucket"


def _bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Equal keys have equal buckets; null is a key."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str) -> None:
    rows = df.repartition(BUCKET)  # a bucket is written by one task: choose buckets so that one fits
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a new table of ``buckets`` buckets; a repeated key is an error."""
    _unique(df, keys, "rows")
    _write(_bucketed(df, keys, buckets), path)


def _unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys).first()
    if twice is not None:
        raise ValueError(f"a key stands in two {what}: {tuple(twice)}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert(new: DataFrame, path: str, keys: Sequence[str], buckets: int) -> list[int]:
    """Put ``new`` in the place of rows of equal keys, or beside the others; the buckets that were rewritten.

    The new state of the touched buckets is written beside the table before any of it is replaced, and
    buckets are replaced as whole folders when all of them are done; run the same upsert again after a crash, it ends in the same table.  Columns have
    to be the table's.
    """
    spark = new.sparkSession
    _unique(new, keys, "new rows")
    names = [c for c in spark.read.parquet(path).columns if c != BUCKET]
    if sorted(names) != sorted(new.columns):
        raise ValueError(f"the table has {names}, the new rows have {new.columns}")
    staged = shared_folder(spark, "upsert")
    _bucketed(new.select(*names), keys, buckets).write.parquet(f"{staged}/new")
    new = spark.read.parquet(f"{staged}/new")
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # as many numbers as buckets at most
    if not touched:
        return []
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    mine, theirs = old.alias("o"), new.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(BUCKET).alias("_b"))
    same = (F.col(BUCKET) == F.col("_b")) & F.expr(" AND ".join(f"`{k}` <=> `_{k}`" for k in keys))
    mine.join(theirs, same, "left_anti").select(*names, BUCKET).unionByName(new.select(*names, BUCKET)).write.parquet(f"{staged}/out")
    _write(spark.read.parquet(f"{staged}/out"), path)
    return touched


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """bucket, file, digest: sha256 of the bytes of each data file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", f"{BUCKET}=([0-9]+)", 1).cast("int").alias("bucket"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))


def altered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Buckets some file of which came, went or changed."""
    names = ["bucket", "file", "digest"]
    one = before.select(*names).exceptAll(after.select(*names)).unionByName(after.select(*names).exceptAll(before.select(*names)))
    return one.select("bucket").distinct()
