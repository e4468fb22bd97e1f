"""Functions against small cases with known answers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill.functions import grammar, lattice, programs, text
from tallymill.operators import relational, statistics, workflow
from tallymill.sources import readers, sinks
from tallymill.streaming import counts


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first()


@pytest.mark.parametrize(
    ("message", "category"),
    [
        ("use of value '%x' expects different type than prior uses", "type_ssa"),
        ("operand type 'i32' does not match", "type"),
        ("op has 3 operands but expected 2", "arity"),
        ("Unregistered Operation 'foo'", "dialect_misuse"),
        ("error: expected ')'", "syntax"),
        ("", "other"),
        ("  \n", "other"),
        ("something else", "other"),
        ("expected 2 operands but got 3", "type"),
    ],
)
def test_error_category(spark, message, category):
    assert one(spark, message, text.error_category(F.col("x")))[0] == category


@pytest.mark.parametrize(
    ("program", "kinds"),
    [
        ("func.func @f(%a : i32) -> i32 {\n return %a : i32 }", []),
        ("func.func @f(%a : i32) -> i32 {\n return %b : i32 }", ["undef_use"]),
        ("func.func @f(%a : f32) -> i32 {\n %0 = arith.addi %a, %a : i32\n return %0 : i32 }", ["type_mismatch"]),
        ("func.func @f(%a : i32) {\n return }\nfunc.func @g() {\n return %a : i32 }", ["undef_use"]),
        ("func.func @f(%a : i32, %b : i32) {\n %c = arith.cmpi slt, %a, %b : i32\n %d = arith.select %c, %a, %b : i32\n return %d : i32 }", []),
        ("func.func @f(%a : i32) {\n %0 = arith.extsi %a : i32 to i64\n return %0 : i64 }", []),
        ("func.func @f(%m : memref<?xf32>, %i : i32) {\n %0 = memref.load %m[%i] : memref<?xf32>\n return %0 : f32 }", ["type_mismatch"]),
        ("func.func @f(%v : i32, %m : memref<4xf32>) {\n linalg.fill ins(%v : i32) outs(%m : memref<4xf32>)\n return }", ["type_mismatch"]),
        ("func.func @f(%a : tensor<2xf32>) -> tensor<2xf16> {\n %0 = stablehlo.convert %a : (tensor<2xf32>) -> tensor<2xf16>\n return %0 : tensor<2xf16> }", []),
        ("func.func @f(%a : i32) {\n %0 = arith.addi %a,\n   %z : i32\n return %0 : i32 }", ["undef_use"]),
        ("no function", []),
        ("func.func @f(%a : i32) {\n return %q : i32", []),
    ],
)
def test_scope(program, kinds):
    assert [v["kind"] for v in programs.scope_report(program)["violations"]] == kinds


def test_program_structure():
    assert programs.inner_body("module { a { b } }") == "a { b }"
    assert programs.inner_body("module { a") == "module { a"
    assert programs.split_top("a<b,c>, (d, e), f") == ["a<b,c>", " (d, e)", " f"]
    assert programs.clause("x ins(%a : memref<?xi32>) outs(%b)", "ins") == "%a : memref<?xi32>"
    assert programs.trailing_type("arith.addi %a, %b : i32") == "i32"
    assert programs.trailing_type("a %a:i32") is None
    assert programs.element_type("memref<4x?xvector<2xf32>>") == "vector<2xf32>"
    assert programs.element_type("tensor<4xf32>") is None
    assert programs.refs("%a %b %a") == ["a", "b"]


def test_grammar(spark):
    good = "module {\n func.func @f(%a : i32) -> i32 {\n %0 = arith.addi %a , %a : i32\n return %0 : i32\n } }"
    for program, ok in [(good, True), (good.replace("i32\n", "f32\n"), False), (good.replace("module", "mod"), False), ("", False), (None, False)]:
        assert one(spark, program, grammar.accepts(F.col("x")))[0] is ok


def test_schema_and_lattice(spark):
    ops = programs.schema_records('def A_B : Arith_Op<"add", [Pure, SameOperandsAndResultType]> {\n  let summary = "s";\n  let arguments = (ins I32:$a, Variadic<F32>:$b, I32Attr:$c);\n  let results = (outs I32:$r);\n}\n')
    assert ops[0]["full_name"] == "arith.add" and [a["variadic"] for a in ops[0]["arguments"]] == [False, True, False]
    e = lattice.entries(spark.createDataFrame(ops, programs.RECORD)).first()
    assert e.operand_types == [["i32"], ["f32"]] and e.operand_arity == [1, 10**6] and e.attributes == ["I32Attr"] and e.same_type_classes == [[0, 1, 2]]


def test_tolerance(spark):
    inf, nan = float("inf"), float("nan")
    for a, b, parity, strict in [(1.0, 1.00001, True, True), (1.0, 1.1, False, False), (nan, nan, True, True), (nan, 1.0, False, False), (inf, inf, False, True), (1.0, inf, True, False)]:
        r = spark.createDataFrame([(a, b)], "a double, b double").select(text.near(F.col("a"), F.col("b")), text.near(F.col("a"), F.col("b"), strict=True)).first()
        assert tuple(r) == (parity, strict), (a, b)


def test_bootstrap_equals_one_draw():
    x = np.array([0, 1, 1, 0, 1, 1, 1.0])
    means = np.random.default_rng(0).choice(x, size=(10_000, len(x)), replace=True).mean(axis=1)
    assert statistics.bootstrap(x)[1:3] == tuple(np.quantile(means, [0.025, 0.975]))
    old, statistics.CHUNK = statistics.CHUNK, 70
    try:
        assert statistics.bootstrap(x)[1:3] == tuple(np.quantile(means, [0.025, 0.975]))
    finally:
        statistics.CHUNK = old
    y = np.zeros(7)
    assert statistics.paired_bootstrap(x, y)[3] < 0.05
    with pytest.raises(ValueError):
        statistics.paired_bootstrap(x, y[:3])
    assert np.isnan(statistics.bootstrap(np.array([]))[0])


def test_effect(spark):
    r = spark.createDataFrame([(100,), (1000,), (0,)], "n int").select(statistics.detectable_effect(F.col("n")).alias("e")).collect()
    assert 0.19 < r[0].e < 0.2 and r[1].e < r[0].e and r[2].e == float("inf")


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"model": "m", "passed": true}\n\nnot json\n{"model": "n"}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), tolerant=True).count() == 2
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), missing_ok=True).count() == 0
    records = tmp_path / "records"
    records.mkdir()
    for n in ("002_b", "001_a"):
        (records / f"{n}.json").write_text(f'{{\n "id": "{n}", "dialect": "arith"\n}}')
    assert [(r.idx, r.id) for r in readers.record_directory(spark, str(records)).orderBy("idx").collect()] == [(0, "001_a"), (1, "002_b")]
    tree = tmp_path / "tree" / "deep"
    tree.mkdir(parents=True)
    (tree / "x.mlir").write_text("ok")
    (tree / "x-invalid.mlir").write_text("no")
    (tree / "y.mlir").write_bytes(b"\xff\xfe")
    assert [r.text for r in readers.text_tree(spark, str(tmp_path / "tree")).collect()] == ["ok"]
    (tmp_path / "p.txt").write_text('{"prompt": "one"}\n two \n')
    assert sorted(r.prompt for r in readers.prompts(spark, str(tmp_path / "p.txt")).collect()) == ["one", "two"]
    (tmp_path / "c.jsonl").write_text('{"docstring": "", "comment": "c", "code": "x"}\n{"docstring": "d", "code": "y"}\n')
    assert sorted(r.docstring for r in readers.documented_code(spark, str(tmp_path / "c.jsonl")).collect()) == ["c", "d"]
    (tmp_path / "refs.json").write_text('{"references": [{"id": "r1", "expected_output": 3, "inputs": [{"type": "i32", "value": 1}]}]}')
    assert readers.references(spark, str(tmp_path / "refs.json")).first().expected_output == 3.0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    sinks.resume(rows.where("k = 1"), path, ["k"])
    sinks.resume(rows, path, ["k"])
    sinks.resume(rows, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    new = spark.createDataFrame([(2, "c")], "k int, v string")
    out = sinks.upserted(rows, new, ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c")] and sinks.untouched(rows, out, new, ["k"]).isEmpty()
    sinks.replace_table(new, path)
    assert spark.read.parquet(path).count() == 1
    sinks.numbered_records(rows, str(tmp_path / "n"), ["k"], "v")
    assert {p.name: p.read_text() for p in (tmp_path / "n").iterdir()} == {"001_a.json": '{"k":1,"v":"a","id":"001_a"}', "002_b.json": '{"k":2,"v":"b","id":"002_b"}'}
    assert sinks.document(rows).first().document == '[{"k":1,"v":"a"},{"k":2,"v":"b"}]'


def test_same_under_other_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source")
    old, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(r.doc_id for r in relational.stratified_share(docs, "source", "doc_id", 40).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1]


def test_memo_computes_once(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    memo = spark.createDataFrame([("b", 5)], "key string, r int")
    out, fresh = workflow.with_memo(rows, memo, "key", lambda d: d.withColumn("r", F.lit(1)), "r")
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("a", 1), ("b", 5)] and fresh.count() == 1


def test_stream_counts(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = counts.windowed(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True)
    q.start().awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == source.count()


def test_signatures(spark):
    from tallymill.plans.catalogue import SIGS

    rows = spark.createDataFrame(list(enumerate(SIGS)), "id int, m string").withColumn("s", text.signature(F.col("m")))
    got = {r.id: (r.name, r.arg_types, r.ret, r.why) for r in rows.select("id", "s.*", text.exclusion(F.col("s")).alias("why")).collect()}
    assert got[0] == ("f", ["i32", "memref<?x4xf32>"], "i32", None)
    assert got[1] == ("h", ["memref<8x4xf32>"], "", None)
    assert got[2] == ("main", [], "", "fn_named_main")
    assert got[3] == got[4] == (None, None, None, "no_public_fn")
    assert got[5][3] == "multi_result" and got[6][3] == "unprintable_memref_dtype"


def test_trials(spark):
    from tallymill.functions import trials

    a = trials.trial_inputs(["memref<?x2xf32>", "index", "f64", "i1", "memref<3xi32>"], "k", 1)
    assert a == trials.trial_inputs(["memref<?x2xf32>", "index", "f64", "i1", "memref<3xi32>"], "k", 1) != trials.trial_inputs(["memref<?x2xf32>"] * 5, "k", 2)
    assert [len(x) for x in a] == [8, 1, 1, 1, 3] and 0 <= a[1][0] < 2 and all(x * 4 == int(x * 4) for x in a[0])
    assert trials.outputs("1.5\nUnranked Memref sizes = [2] data = [1, nan]\n7") ["memrefs"][0]["sizes"] == [2]
    assert trials.outputs("x = -2e1, inf")["scalars"] == [-20.0, float("inf")]


def test_strict_pairs_refuse_repeats(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, True)], "k int, flag boolean")
    with pytest.raises(Exception, match="repeated key 1"):
        statistics.paired_strict(rows, rows.where("k = 2"), ["k"], "flag").unionByName(statistics.paired_strict(rows, rows, ["k"], "flag")).collect()


def test_case_splitting(spark):
    source = "// RUN: tool %s\n\n// CHECK-LABEL: first\nop.a x\n// -----\n\n// CHECK: second\n// -----\n  arith.b y\n"
    r = one(spark, source, text.cases(F.col("x")), text.check_hints(F.col("x")))
    assert r[0] == ["op.a x\n", "arith.b y\n"] and r[1] == ["LABEL: first", "second"]


def test_lattice_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("arith", "arith.b"), ("arith", "arith.a"), ("func", "func.call")], "dialect string, full_name string")
    sinks.by_dialect(rows, str(tmp_path / "l"))
    assert sorted(p.name for p in (tmp_path / "l").iterdir()) == ["arith.json", "func.json"]
    assert (tmp_path / "l" / "arith.json").read_text() == '{"arith.a":{"full_name":"arith.a"},"arith.b":{"full_name":"arith.b"}}'
    assert '"full_name"' in sinks.metadata(rows)


def test_hash_bootstrap_by_definition(spark, monkeypatch):
    """Cells of several chunks and blocks, null values, null keys: the draws by hand; no window ranks a cell in one task."""
    import hashlib

    monkeypatch.setattr(statistics, "BLOCK", 64)
    monkeypatch.setattr(statistics, "MEET", 500)
    cells = {"a": 333, "b": 1, None: 5, "c": 64}
    rows = [(c, (k * 7919) % 1009, None if k % 5 == 2 else k % 3, None if k % 4 == 1 else k / 8) for c, n in cells.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, p int, q double").repartition(3)
    means = statistics.hash_bootstrap(df, ["g"], ["p", "q"], "k", resamples=10)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "REPARTITION_BY_NUM" in plan
    wanted = {}
    for c in ("a", "b", "c"):
        mine = sorted(r for r in rows if r[0] == c) if c else []
        for b in range(10):
            drawn = [mine[int(hashlib.md5(f"{b}:{j}".encode()).hexdigest()[:8], 16) % len(mine)] for j in range(len(mine))]
            wanted[c, b] = [sum(v) / len(v) if v else None for v in ([r[i] for r in drawn if r[i] is not None] for i in (2, 3))]
    assert {(r.g, r.b): [r.mean_p, r.mean_q] for r in means.collect()} == wanted
    assert statistics.hash_bootstrap(df.limit(0), ["g"], ["p"], "k").count() == 0


def test_hash_bootstrap_interval_of_a_large_cell(spark):
    """Draws travel by chunk and number two bytes each, at most as many to a group as a chunk is due, and the interval is that of the draws by hand."""
    n, resamples = 30_000, 200
    draw = statistics._drawn(1, statistics.BLOCK, statistics.MEET // resamples, ["g", "_chunk", "b", "_places"])
    blocks = pa.RecordBatch.from_pydict({"g": ["a"] * resamples, "n": [n] * resamples, "block": [0] * resamples, "b": list(range(resamples))})
    sizes = {}
    for batch in draw(iter([blocks])):
        for chunk, places in zip(batch.column("_chunk").to_pylist(), batch.column("_places").to_pylist()):
            sizes[chunk] = sizes.get(chunk, 0) + len(places) // 2
    assert sum(sizes.values()) == n * resamples and len(sizes) == 6 and max(sizes.values()) < 1.01 * statistics.MEET
    flags = np.arange(n) % 7 == 0
    means = [flags[statistics._digests(b, 0, n).astype(np.int64) % n].mean() for b in range(resamples)]
    df = spark.range(n).select(F.lit("a").alias("g"), "id", (F.col("id") % 7 == 0).cast("int").alias("p"))
    got = statistics.interval(statistics.hash_bootstrap(df, ["g"], ["p"], "id"), ["g"], F.col("mean_p")).first()
    assert np.allclose([got.ci_low, got.ci_high, got.p_value], [*np.quantile(means, [0.025, 0.975]), 0])


def test_hash_bootstrap_deals_out_chunks(spark, monkeypatch, tmp_path):
    """Chunks meet their draws in as many tasks as the draws ask for, not in the few that adaptive execution would make, and a draw travels in less than a byte."""
    from pyspark import TaskContext

    n, resamples, met, to = 20_000, 200, statistics._met, str(tmp_path)
    monkeypatch.setattr(statistics, "MEET", 1 << 16)

    def watched(*args):
        run = met(*args)

        def told(key, rows, draws):
            with open(f"{to}/{TaskContext.get().partitionId()}", "a") as f:
                f.write(f"{sum(map(len, draws.column('_places').to_pylist()))}\n")
            return run(key, rows, draws)

        return told

    monkeypatch.setattr(statistics, "_met", watched)
    df = spark.range(n).select(F.lit("a").alias("g"), "id", (F.col("id") % 7 == 0).cast("int").alias("p"))
    got = {r.b: r.mean_p for r in statistics.hash_bootstrap(df, ["g"], ["p"], "id", resamples).collect()}
    flags = np.arange(n) % 7 == 0
    assert got == {b: flags[statistics._digests(b, 0, n).astype(np.int64) % n].mean() for b in range(resamples)}
    tasks = [[int(x) for x in p.read_text().split()] for p in tmp_path.iterdir()]
    assert len(tasks) > 8 and sum(map(len, tasks)) == -(-n // ((1 << 16) // resamples)) and sum(map(sum, tasks)) < n * resamples
    for places in ([], [0], [7, 7, 7], [0, 255, 256, 511], [255, 511, 65_535]):
        assert statistics._unpack(statistics._pack(np.array(places, "<u2").tobytes())).tolist() == places


def test_order_interval_of_hash_bootstrap(spark):
    """Null values do not lower the replicates, whose sorted values are taken as they are."""
    n = 400
    values = [None if k % 3 == 0 else k % 2 for k in range(n)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "g string, k long, p int")
    found = []
    for b in range(200):
        drawn = [values[int(d) % n] for d in statistics._digests(b, 0, n)]
        found.append(np.mean([v for v in drawn if v is not None]))
    got = statistics.order_interval(statistics.hash_bootstrap(df, ["g"], ["p"], "k"), ["g"], F.col("mean_p")).first()
    assert (got.low, got.high) == (sorted(found)[5], sorted(found)[195])
