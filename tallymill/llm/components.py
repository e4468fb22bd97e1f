"""Connected components by alternating large and small stars, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import scratch


def _large(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours attach to its smallest neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours attach to the smallest of them (all edges have u > v)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: bigint a and b, no nulls.  Every node that has an edge to another one: node, component
    (the smallest node reachable).

    Minima are partial aggregates and the joins are plain equi-joins, whose hot keys adaptive
    execution splits; a round's edges are written to the shared folder, and the driver sees two numbers.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, path = scratch.store(e, "edges")
    state = None
    while True:
        found = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (found.n, found.h) == state or not found.n:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state, old = (found.n, found.h), path
        mid, mid_path = scratch.store(_large(e), "edges")
        e, path = scratch.store(_small(mid), "edges")
        scratch.drop(spark, old, mid_path)
