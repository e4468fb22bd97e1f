"""Session defaults and the table loader."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallymill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; only a local session without one gets a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='tallymill-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch between the JVM and Python: rows hold whole texts, and both sides hold several batches.
BATCH_ROWS, DEFAULT_ROWS = 1500, "10000"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once for each application.

    Arrow batches are made smaller where the session has Spark's own number of rows.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_tallymill_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tallymill-")) / "tallymill_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"tallymill/{f.relative_to(home)}")
    context.addPyFile(str(path))
    context._tallymill_shipped = True
