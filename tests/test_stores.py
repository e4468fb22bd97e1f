"""Sources and sinks that replace parts, resume, and number what they write."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill.operators import validation
from tallymill.plans import stores
from tallymill.sources import keyed, records, sinks
from tallymill.streaming import ingest


def test_records_in_bundles(spark, tmp_path):
    for k in range(23):
        (tmp_path / f"r{k:02d}.json").write_text(json.dumps({"id": f"r{k}", "n": k}))
    (tmp_path / "note.txt").write_text("no record")
    (tmp_path / "r05.json").write_bytes(b"\xff\xfe")
    (tmp_path / "r06.json").write_text("not json")
    deep = tmp_path / "below"
    deep.mkdir()
    (deep / "s.json").write_text('{"id": "s"}')
    rows = records.read_records(spark, str(tmp_path), "id string, n int", bundle=5)
    assert rows.rdd.getNumPartitions() == 5
    got = rows.orderBy("idx").collect()
    assert [(r.idx, r.file_name) for r in got] == [(k, f"r{k:02d}.json") for k in range(23)]
    assert [r.n for r in got] == [None if k in (5, 6) else k for k in range(23)] and got[5].text is None and got[6].text == "not json"
    assert records.read_records(spark, str(tmp_path), recursive=True).count() == 24
    assert [r.file_name for r in records.read_records(spark, str(tmp_path), recursive=True, pattern="s.*").collect()] == ["below/s.json"]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert records.read_records(spark, str(empty), "id string").count() == 0


def test_failed_write_leaves_the_old_folder(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).repartition(4).select(F.concat(F.col("id").cast("string"), F.lit(".json")).alias("f"), F.col("id").cast("string").alias("r"))
    records.write_records(rows, path, "f", "r")
    held = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert held == {f"{k}.json": str(k) for k in range(40)}
    broken = rows.withColumn("r", F.when(F.col("r") == "31", F.raise_error(F.lit("broken"))).otherwise("new"))
    twice = rows.withColumn("f", F.lit("one.json"))
    for bad in (broken, twice, rows.withColumn("f", F.lit("../x"))):
        with pytest.raises(Exception):
            records.write_records(bad, path, "f", "r")
        assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == held and [p.name for p in tmp_path.iterdir()] == ["out"]
    records.write_records(rows.limit(0), path, "f", "r", mode="append")
    records.write_records(spark.createDataFrame([("x.json", "x")], "f string, r string"), path, "f", "r", mode="append")
    assert len(list((tmp_path / "out").iterdir())) == 41
    records.write_records(spark.createDataFrame([("y.json", None)], "f string, r string"), path, "f", "r")
    assert [(p.name, p.read_text()) for p in (tmp_path / "out").iterdir()] == [("y.json", "")]


def test_numbered_records_are_replaced(spark, tmp_path):
    """Ties, more records than the width, and an earlier folder's files gone."""
    path = str(tmp_path / "n")
    rows = spark.createDataFrame([(k % 3, f"v{k}") for k in range(12)], "g int, v string")
    sinks.numbered_records(rows, path, ["g", "v"], "v", width=1)
    names = sorted(p.name for p in (tmp_path / "n").iterdir())
    assert len(names) == 12 and "10_v2.json" in names and "1_v0.json" in names
    sinks.numbered_records(rows.where("g = 0"), path, ["v"], "v")
    assert sorted(p.name for p in (tmp_path / "n").iterdir()) == ["001_v0.json", "002_v3.json", "003_v6.json", "004_v9.json"]


def test_replaced_table_recovers_from_a_crash(spark, tmp_path):
    """A crash between the renames left only ``.old``: a failing write afterwards does not lose it."""
    path = tmp_path / "t"
    spark.range(3).write.parquet(f"{path}.old")
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(3).select(F.raise_error(F.lit("no"))), str(path))
    sinks.replace_table(spark.range(5), str(path))
    assert spark.read.parquet(str(path)).count() == 5 and not (tmp_path / "t.old").exists()


# ---- keyed tables ----


def test_upsert_rewrites_its_buckets_alone(spark, tmp_path):
    """Null and composite keys, replaced and new rows; files of other buckets keep their bytes, and a repeated upsert changes nothing."""
    path = str(tmp_path / "k")
    rows = [(k, "a" if k % 2 else None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    keyed.create(df, path, ["k", "g"], 16)
    before = keyed.fingerprints(spark, path).collect()
    assert len({r.bucket for r in before}) == 16
    new = spark.createDataFrame([(4, None, -4), (4, "a", -5), (None, "z", 1)], "k long, g string, v long")
    for _ in range(2):
        touched = keyed.upsert(new.select("v", "k", "g"), path, ["k", "g"], 16)
        assert 1 <= len(touched) <= 3
        now = keyed.fingerprints(spark, path).collect()
        assert {tuple(r) for r in before if r.bucket not in touched} == {tuple(r) for r in now if r.bucket not in touched}
        changed = keyed.altered(spark.createDataFrame(before), keyed.fingerprints(spark, path))
        assert {r.bucket for r in changed.collect()} == set(touched)
        got = sorted(map(tuple, keyed.read(spark, path).select("k", "g", "v").collect()), key=repr)
        assert got == sorted([r for r in rows if r[:2] != (4, None)] + [(4, None, -4), (4, "a", -5), (None, "z", 1)], key=repr)
    assert keyed.upsert(new.limit(0), path, ["k", "g"], 16) == []


def test_upsert_refuses(spark, tmp_path):
    path = str(tmp_path / "k")
    df = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    with pytest.raises(ValueError, match="key"):
        keyed.create(df.unionByName(df), path, ["k"], 4)
    keyed.create(df, path, ["k"], 4)
    with pytest.raises(ValueError, match="key"):
        keyed.upsert(df.unionByName(df), path, ["k"], 4)
    with pytest.raises(ValueError, match="table has"):
        keyed.upsert(df.withColumn("w", F.lit(1)), path, ["k"], 4)
    broken = df.withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        keyed.upsert(broken, path, ["k"], 4)
    assert sorted(map(tuple, keyed.read(spark, path).collect())) == [(1, 1), (2, 2)]


# ---- streams into tables ----


@pytest.mark.parametrize("at", [0, 1, 2])
def test_ingest_after_a_crash(spark, tmp_path, at):
    """Stopped after batch ``at`` was written and not committed, then started twice, with a file that came in between."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("source", "target", "checkpoint"))
    (tmp_path / "source").mkdir()
    for k in range(5):
        (tmp_path / "source" / f"{k}.json").write_text("\n".join(json.dumps({"id": 10 * k + j}) for j in range(10)))
    wrote = []

    def crash(batch):
        wrote.append(batch)
        if batch == at:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        ingest.ingest(spark, source, target, checkpoint, "id long", files=2, after=crash)
    assert wrote == list(range(at + 1))
    for _ in range(2):
        ingest.ingest(spark, source, target, checkpoint, "id long", files=2)
        (tmp_path / "source" / "late.json").write_text('{"id": 50}')
    ingest.ingest(spark, source, target, checkpoint, "id long", files=2)
    assert sorted(r.id for r in ingest.ingested(spark, target).collect()) == list(range(51))


def test_ingest_by_key(spark, tmp_path):
    """Repeats within a batch, in later batches and after a repeated batch, null keys included."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("source", "target", "checkpoint"))
    (tmp_path / "source").mkdir()
    for k in range(4):
        (tmp_path / "source" / f"{k}.json").write_text("\n".join(json.dumps({"a": j % 3 or None, "b": j + k}) for j in range(6)))

    def crash(batch):
        if batch == 2:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        ingest.ingest(spark, source, target, checkpoint, "a int, b int", keys=["a", "b"], files=1, after=crash)
    ingest.ingest(spark, source, target, checkpoint, "a int, b int", keys=["a", "b"], files=1)
    got = [tuple(r) for r in ingest.ingested(spark, target).collect()]
    assert len(got) == len(set(got)) and set(got) == {(j % 3 or None, j + k) for k in range(4) for j in range(6)}


# ---- rules ----


def test_rules_by_definition(spark):
    """Each kind, with null fields, and missing fields first."""
    rows = spark.createDataFrame(
        [("a", "x+y", "x.op y.op", 5, "f/a.json"), ("b", " x + q ", "q.op", 50, "f/c.json"), ("c", None, "none", None, "f/c.json"), ("", "x", None, 1, ".json"), (None, "x", "x.a", 1, "f/d.json")],
        "id string, dialect string, body string, n int, file string",
    )
    rules = [
        validation.Rule("id", "required"), validation.Rule("dialect", "known", ("x", "y"), "unknown"), validation.Rule("dialect", "mentioned", ("body",), "silent"), validation.Rule("n", "number", ("2", "20")),
        validation.Rule("id", "file"), validation.Rule("id", "length", ("1", ""), "blank"), validation.Rule("body", "pattern", (r"\.op",), "no op"), validation.Rule("id", "equals", ("id",)), validation.Rule("id", "enum", ("a", "b", "c", "")),
    ]
    got = {r.key: [tuple(e) for e in r.e] for r in rows.select(F.coalesce("id", F.lit("none")).alias("key"), validation.errors(rules, F.col("file")).alias("e")).collect()}
    assert got == {
        "a": [],
        "b": [("dialect", "unknown"), ("n", "number"), ("id", "file")],
        "c": [("body", "no op")],
        "": [("n", "number"), ("id", "blank")],
        "none": [("id", "required")],
    }
    assert validation.validated(rows.limit(0), rules, ["id"], F.col("file")).count() == 0
    found = validation.summary(validation.validated(rows, rules, ["file"], F.col("file")))
    assert {(r.field, r.detail): (r.errors, r.records) for r in found.collect()}["n", "number"] == (2, 2)
    for bad in (validation.Rule("id", "strange"), validation.Rule("id", "file")):
        with pytest.raises(ValueError):
            validation.errors([bad])


def test_rules_make_one_pass(spark):
    """All rules are one projection: nothing is shuffled or joined."""
    plan = validation.validated(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), [validation.Rule(*r[:2], tuple(r[2] or ()), r[3]) for r in stores.DOCUMENT_RULES], ["doc_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_folder_of_records(spark, tmp_path):
    for name, body in {"a": '{"id": "a", "dialect": "arith", "difficulty": "easy", "mlir": "arith.addi"}', "b": "[1]", "c": "", "d": '{"id": "d"}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    found = validation.validate_folder(spark, str(tmp_path), "id string, dialect string, difficulty string, mlir string", stores.RECORD_RULES)
    assert sorted(map(tuple, found.collect())) == [("b.json", "json", "not a record"), ("c.json", "json", "not a record"), ("d.json", "dialect", "missing")]


def test_numbered_files_are_read_in_the_order_of_their_numbers(spark, tmp_path):
    """Numbers wider than the width: 2 before 10; names without a number last."""
    path = str(tmp_path / "n")
    sinks.numbered_records(spark.range(120).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v")), path, ["id"], "v", width=1)
    (tmp_path / "n" / "x.json").write_text('{"id": "x"}')
    found = records.read_records(spark, path, "id string", numbered=True)
    assert [(r.idx, r.id) for r in found.orderBy("idx").collect()] == [*((k, f"{k + 1}_v{k}") for k in range(120)), (120, "x")]
    by_name = records.read_records(spark, path, "id string").orderBy("idx").collect()
    assert [r.file_name for r in by_name] == sorted(p.name for p in (tmp_path / "n").iterdir())


def test_reading_a_folder_of_many_files(spark, tmp_path):
    """The plan of a read holds no paths, and no task a file: with more files tasks have more of them."""
    for k in range(records.READERS + 104):
        (tmp_path / f"{k:05d}.json").write_text(f'{{"n": {k}}}')
    rows = records.read_records(spark, str(tmp_path), "n int", bundle=1)
    assert rows.rdd.getNumPartitions() == records.READERS
    assert "00007.json" not in rows._jdf.queryExecution().toString()
    found = records.read_records(spark, str(tmp_path), "n int", bundle=300).agg(F.count("*").alias("rows"), F.sum((F.col("n") == F.col("idx")).cast("int")).alias("right"), F.countDistinct("n").alias("n")).first()
    assert tuple(found) == (records.READERS + 104,) * 3


def test_writing_tells_folders_alone(spark, tmp_path, monkeypatch):
    """A task tells a folder for ``FOLDER`` files; a move that is repeated moves what is left; equal names are found within a folder and between tasks."""
    monkeypatch.setattr(records, "FOLDER", 4)
    stage, into = str(tmp_path / "stage"), str(tmp_path / "into")
    (tmp_path / "into").mkdir()
    batch = pa.RecordBatch.from_pydict({"file_name": [f"{k}.json" for k in range(10)], "record": [f"r{k}" for k in range(10)]})
    told = list(records._written(iter([batch.slice(0, 7), batch.slice(7)]), stage))
    assert sum(b.num_rows for b in told) == 3
    assert sorted(n for b in records._names(iter(told), stage) for n in b.column(0).to_pylist()) == sorted(f"{k}.json" for k in range(10))
    assert [b.column(0).to_pylist() for b in records._moved(iter(told[:1]), stage, into)] == [[4]]
    assert [b.column(0).to_pylist() for b in records._moved(iter(told), stage, into)] == [[0], [4], [2]]
    assert {p.name: p.read_text() for p in (tmp_path / "into").iterdir()} == {f"{k}.json": f"r{k}" for k in range(10)}
    rows = spark.range(0, 6, 1, 3).select(F.lit("one.json").alias("f"), F.lit("r").alias("r"))
    with pytest.raises(Exception, match="one file name"):  # from a task, or from the names of all
        records.write_records(rows.where("id % 2 = 0"), str(tmp_path / "out"), "f", "r")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["into", "stage"]
    records.write_records(rows.limit(1), str(tmp_path / "out"), "f", "r")
    assert [p.read_text() for p in (tmp_path / "out").iterdir()] == ["r"]
