"""Sinks: appends that resume, upserts, keyed documents and training exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators.numbering import global_number
from tallymill.sources.records import write_records


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def pending(new: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return new.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resume(new: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """Append the rows whose keys the table at ``path`` lacks; it may not exist yet."""
    spark = new.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = pending(new, spark.read.format(fmt).load(path), keys)
    append(new, path, fmt)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows replaced by new ones of equal key; keys are unique on either side."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def untouched(old: DataFrame, out: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys outside ``changed`` that an update altered; none if it kept them."""
    rest = lambda df: df.join(changed.select(*keys), list(keys), "left_anti")
    return rest(old).exceptAll(rest(out)).unionByName(rest(out).exceptAll(rest(old)))


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the old table, put the new one in its place, then delete the old one.

    A failed write leaves the old table; a crash between the renames leaves it beside as ``<path>.old``, never nothing.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark._jvm.org.apache.hadoop.fs
    target, new = jvm.Path(path), jvm.Path(f"{path}.new")
    fs, old = target.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path(f"{path}.old")
    if fs.exists(old) and not fs.exists(target):  # an earlier crash between the renames
        fs.rename(old, target)
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(new, target):
        raise OSError(f"{path}.new can't be moved to {path}")
    fs.delete(old, True)


def document(df: DataFrame) -> DataFrame:
    """One JSON text of all rows (a summary's few rows), sorted."""
    return df.select(F.to_json(F.struct("*")).alias("row")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("row")), ","), F.lit("]")).alias("document"))


def numbered_records(df: DataFrame, path: str, order: Sequence[str], name: str, width: int = 3) -> None:
    """A file for each record, ``001_name.json`` and so on in ``order``, in place of what the folder held.

    The record's ``id`` is the file's name without its ending.  Numbers come from ranges of the sorted rows, not from one task.
    """
    n = F.col("number").cast("string")
    rows = global_number(df, order, "number", start=1)
    rows = rows.withColumn("id", F.concat_ws("_", F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n), F.col(name).cast("string"))).drop("number")
    write_records(rows.select(F.concat("id", F.lit(".json")).alias("file_name"), F.to_json(F.struct(*rows.columns)).alias("record")), path, "file_name", "record")


def by_dialect(df: DataFrame, path: str) -> None:
    """``<dialect>.json`` for each dialect: its entries by full_name, sorted."""
    entry = F.struct("full_name", F.struct(*[c for c in df.columns if c != "dialect"]))
    one = df.groupBy("dialect").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("record"))
    write_records(one.withColumn("file_name", F.concat("dialect", F.lit(".json"))), path, "file_name", "record")


def metadata(df: DataFrame) -> str:
    """The schema as JSON."""
    return df.schema.json()


def training_pairs(rows: DataFrame) -> DataFrame:
    """prompt and completion, without rows that lack either."""
    from tallymill.functions.text import or_blank

    have = lambda *names: [F.col(n) for n in names if n in rows.columns]
    pairs = rows.select(or_blank(*have("nl", "docstring", "weak_nl")).alias("prompt"), or_blank(*have("mlir", "code")).alias("completion"))
    return pairs.where("prompt <> '' AND completion <> ''")
