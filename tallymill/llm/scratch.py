"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables written so far in this driver and not dropped.
made: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only where the setting is absent in a local session (a test) a new local folder serves; on a cluster, where
    each executor would write to its own disk, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallymill.scratch", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("tallymill.scratch", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder; the table read back, and its path.

    The written table cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    for path in paths:
        if path in made:
            made.remove(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
