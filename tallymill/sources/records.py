"""Folders that hold one record a file, for folders that every worker reaches by path.

Nothing about the single files passes the driver.  Writing has two phases: tasks write into folders of their own beside the target
and tell these folders; only when all are done do further tasks move their files into a new folder, which is put in the target's place by one
renaming.  A failed task, or a repeated one, leaves the old folder as it was.  Reading lists the names into a table, numbers it over
ranges of a sort, and opens the files in as many tasks as there are bundles.
"""

from __future__ import annotations

import fnmatch
import os
import time
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.numbering import global_number
from tallymill.session import shared_folder

#: Files of a reading task, and the most reading tasks (with more files each has more).
BUNDLE, READERS = 256, 4096
#: Files of a folder that a task writes before it begins another one.
FOLDER = 4096
#: Bytes of files, and files, that a reading task holds at once.
HELD_BYTES, HELD = 4 << 20, 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.rstrip("/"))


def _found(store: fs.FileSystem, root: str, deep: bool) -> Iterator[str]:
    """Paths of all files of a folder: as the system tells them where it is a local one or mounted, else folder by folder."""
    folders = [root]
    while folders:
        here = folders.pop()
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(here) as entries:
                for e in entries:
                    if e.is_dir():
                        folders.append(e.path)
                    elif e.is_file():
                        yield e.path
        else:
            for x in store.get_file_info(fs.FileSelector(here)):
                if x.type == fs.FileType.Directory:
                    folders.append(x.path)
                elif x.is_file:
                    yield x.path
        if not deep:
            return


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``most`` rows, or of HELD_BYTES in their last column if it is binary."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= most or size > HELD_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _listed(it: Iterator[pa.RecordBatch], path: str, pattern: str, deep: bool) -> Iterator[pa.RecordBatch]:
    store, root = opened(path)
    for _ in it:
        names = ((p[len(root) :].lstrip("/"),) for p in _found(store, root, deep) if fnmatch.fnmatch(p.rsplit("/", 1)[-1], pattern))
        yield from _batches(names, ["file_name"], [pa.string()])


def _read(it: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    store, root = opened(path)

    def rows() -> Iterator[tuple]:
        for batch in it:
            for idx, name in zip(batch.column("idx").to_pylist(), batch.column("file_name").to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as f:
                    yield idx, name, f.read()

    return _batches(rows(), ["idx", "file_name", "content"], [pa.int64(), pa.string(), pa.binary()], HELD)


def read_records(spark: SparkSession, path: str, schema: str | None = None, pattern: str = "*.json", recursive: bool = False, bundle: int = BUNDLE, numbered: bool = False) -> DataFrame:
    """idx (of the file in the order of paths, from 0), file_name (below the folder), text, and with a ``schema`` the record's fields.

    ``numbered``: files follow the number that their names begin with (2 before 10, whatever the width), then their names; those without one come last.
    A text that is no UTF-8 or does not parse has null fields; an empty folder has no rows.
    """
    names = shared_folder(spark, "names")
    spark.range(0, 1, 1, 1).mapInArrow(partial(_listed, path=path, pattern=pattern, deep=recursive), "file_name string").write.parquet(names)
    listed = spark.read.schema("file_name string").parquet(names)
    number = F.expr("try_cast(nullif(regexp_extract(file_name, '^[0-9]+', 0), '') AS decimal(38, 0))")
    listed = global_number(listed, [number.asc_nulls_last(), "file_name"] if numbered else ["file_name"], "idx")
    tasks = max(1, min(READERS, -(-listed.count() // bundle)))
    rows = listed.repartition(tasks, F.floor(F.col("idx") / bundle)).select("idx", "file_name").mapInArrow(partial(_read, path=path), "idx long, file_name string, content binary")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = rows.select("idx", "file_name", text.alias("text"))
    return rows if schema is None else rows.select("*", F.from_json("text", schema).alias("r")).select("idx", "file_name", "text", "r.*")


def _written(it: Iterator[pa.RecordBatch], stage: str) -> Iterator[pa.RecordBatch]:
    """Write each row's file below ``stage``; the folders."""
    store, root = opened(stage)
    own, k, names = f"{root}/{uuid.uuid4().hex}", 0, None
    for batch in it:
        for name, record in zip(batch.column("file_name").to_pylist(), batch.column("record").to_pylist()):
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"not a file name: {name!r}")
            if names is None or len(names) >= FOLDER:
                k, names = k + 1, set()
                store.create_dir(f"{own}/{k}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{own}/{k}"])], names=["folder"])
            if name in names:
                raise ValueError(f"two records have one file name: {name!r}")
            names.add(name)
            with store.open_output_stream(f"{own}/{k}/{name}") as f:
                f.write((record or "").encode())


def _names(it: Iterator[pa.RecordBatch], stage: str) -> Iterator[pa.RecordBatch]:
    store, _ = opened(stage)
    names = ((p.rsplit("/", 1)[-1],) for batch in it for folder in batch.column("folder").to_pylist() for p in _found(store, folder, False))
    yield from _batches(names, ["file_name"], [pa.string()])


def _moved(it: Iterator[pa.RecordBatch], stage: str, into: str) -> Iterator[pa.RecordBatch]:
    """Move the files of each folder; a repeated task finds those that are left.  How many were moved."""
    store, _ = opened(stage)
    for batch in it:
        for folder in batch.column("folder").to_pylist():
            paths = list(_found(store, folder, False))  # FOLDER at most
            for p in paths:
                store.move(p, f"{into}/{p.rsplit('/', 1)[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)])], names=["n"])


def _cleared(store: fs.FileSystem, root: str) -> None:
    """Delete a folder, without a list of its files where it is a local one or mounted."""
    if store.get_file_info(root).type == fs.FileType.NotFound:
        return
    if not isinstance(store, fs.LocalFileSystem):
        store.delete_dir(root)
        return
    with os.scandir(root) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                _cleared(store, e.path)
            else:
                os.unlink(e.path)
    os.rmdir(root)


def write_records(df: DataFrame, path: str, file_name: str, record: str, mode: str = "overwrite") -> None:
    """A file for each row: its name and its text are columns; ``overwrite`` clears the folder in the same step that puts the new one in place."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"no such mode: {mode}")
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    store, root = opened(stage)
    target = opened(path)[1]
    try:
        told = shared_folder(spark, "written")
        rows = df.select(F.col(file_name).cast("string").alias("file_name"), F.col(record).cast("string").alias("record"))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(tasks).mapInArrow(partial(_written, stage=stage), "folder string").write.parquet(told)  # a file costs more than its way to another task
        folders = spark.read.schema("folder string").parquet(told).repartition(tasks)
        twice = folders.mapInArrow(partial(_names, stage=stage), "file_name string").groupBy("file_name").agg(F.count("*").alias("n")).where("n > 1").first()
        if twice:
            raise ValueError(f"two records have one file name: {twice.file_name!r}")
        there = store.get_file_info(target).type == fs.FileType.Directory
        into = target if there and mode == "append" else f"{root}/new"  # append: a folder's other files stay
        store.create_dir(into)
        folders.mapInArrow(partial(_moved, stage=stage, into=into), "n long").agg(F.sum("n")).collect()
        if into != target:
            if there:
                store.move(target, f"{root}/old")
            store.move(into, target)
    finally:
        for wait in (0.2, 1, 5, None):  # tasks of a failed job may still be writing for a moment
            try:
                _cleared(store, root)
                break
            except OSError:
                if wait is None:
                    raise
                time.sleep(wait)
