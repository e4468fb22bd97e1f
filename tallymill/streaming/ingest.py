"""Files that arrive in a folder, each taken into a table once, whatever crashes in between."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "_batch"


def ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, fmt: str = "json", keys: Sequence[str] = (), files: int = 1000, after: Callable[[int], None] | None = None
) -> None:
    """Take all files that are new in ``source`` into the Parquet table at ``target``; returns when none is left.

    The stream's checkpoint names the files of each batch before it runs, and a batch owns one folder of the target, which a
    repeated run of it overwrites: a crash at any point, between write and commit too, leaves each row in the table once.  With ``keys``, a row
    whose key an earlier batch holds is left out (the batches' key columns alone are read for that), as is all but one of a key's rows within a
    batch.  A file has to be complete when it appears.  ``after`` is called with a batch's number when its folder is written.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        if keys:
            rows = rows.dropDuplicates(list(keys))
            if _exists(spark, target):
                done = spark.read.parquet(target).where(F.col(BATCH) < batch).select(*keys).distinct()
                same = F.expr(" AND ".join(f"n.`{k}` <=> d.`{k}`" for k in keys))
                rows = rows.alias("n").join(done.alias("d"), same, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch}")
        if after is not None:
            after(batch)

    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(source)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(target).drop(BATCH)
