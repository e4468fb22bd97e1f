"""Numbers over all rows and within groups, without a task that sees them all."""

import random

import pytest

from tallymill.operators import numbering as N


def test_global_number_agrees_with_a_sort(spark):
    """Ties, nulls, both directions, one value that holds a third of the rows, and repeated rows."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, rng.choice([None, "a", "b", "hot", "hot", "hot"])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(5)
    out = N.global_number(df, [F.col("k").desc(), "id"], start=1, partitions=7)
    wanted = sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""] + [0], r[0]))
    assert [(r.id, r.k) for r in out.orderBy("number").collect()] == wanted and sorted(r.number for r in out.collect()) == list(range(1, 901))
    same = N.global_number(spark.createDataFrame([(1, "x")] * 50 + [(2, None)] * 3, "id long, k string"), ["k"], partitions=4)
    assert sorted(r.number for r in same.collect()) == list(range(53))
    assert N.global_number(df.limit(0), ["id"]).count() == 0


def test_global_number_has_no_single_task(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS k")
    out = N.global_number(df, ["k"], partitions=6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert out.select("number").distinct().count() == 1000


@pytest.mark.parametrize("buckets", [1, 7])
def test_numbered_in_buckets(spark, buckets):
    from pyspark.sql import functions as F

    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("b"))
    rows = N.numbered_in_buckets(df, ["g"], "b", ["id"], "n").collect()
    for g in range(3):
        own = sorted((r.n, r.b, r.id) for r in rows if r.g == g)
        assert [n for n, _, _ in own] == list(range(len(own))) and [(b, i) for _, b, i in own] == sorted((b, i) for _, b, i in own)


def test_literal_rows(spark):
    assert N.literal_rows(spark, [], ["a", "b"]).count() == 0
    assert [tuple(r) for r in N.literal_rows(spark, [(1, -2)], ["a", "b"]).collect()] == [(1, -2)]
