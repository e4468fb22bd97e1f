"""Operators whose groups may be of any size: results by definition, and what they hand on or ask."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.functions import rolling
from tallymill.operators import leakage, relational, resampling, selection, statistics
from tallymill.operators import vocabulary as vocabulary_module
from tallymill.plans import catalogue, registry


def written(df):
    """Rows that each shuffle of a collected plan wrote."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            walk(inner)
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def poisson(u):
    """Poisson(1) number of a 16-bit draw, from the distribution function."""
    from math import exp, factorial

    k, total = 0, exp(-1)
    while u >= round(65536 * total):
        k += 1
        total += exp(-1) / factorial(k)
    return k


def test_weights_by_definition():
    w = resampling.weights(["7", "x"], 40)
    for i, key in enumerate(("7", "x")):
        for b in range(40):
            digest = hashlib.sha256(f"{key}:{b // 16}".encode()).hexdigest()
            assert w[i, b] == poisson(int(digest[4 * (b % 16) : 4 * (b % 16) + 4], 16))
    many = resampling.weights([str(k) for k in range(3000)], 208)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02 and many.max() <= 9


def test_poisson_bootstrap_by_definition(spark):
    """Null keys are a cell, null values and rows without a name do not count, and the number of tasks does not matter."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), k % 90, rng.choice([0.0, 1.0, 2.5, None]), rng.random()) for k in range(120)] + [("a", None, 1.0, 1.0), ("c", 5, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "cell string, id long, p double, q double")
    got = {(r.cell, r.b): (r.weight, r.mean_p, r.mean_q) for r in resampling.poisson_bootstrap(df.repartition(5), ["cell"], ["p", "q"], "id", 20).collect()}
    for cell in ("a", None, "b", "c"):
        own = [r for r in rows if r[0] == cell and r[1] is not None and r[2] is not None]
        w = resampling.weights([str(r[1]) for r in own], 20)
        for b in range(20):
            n = int(w[:, b].sum())
            weight, p, q = got.pop((cell, b))
            assert weight == n and ((p is None and q is None) if not n else (p == pytest.approx(sum(w[:, b] * [r[2] for r in own]) / n) and q == pytest.approx(sum(w[:, b] * [r[3] for r in own]) / n)))
    assert not got
    assert resampling.poisson_bootstrap(df.limit(0), ["cell"], ["p"], "id").count() == 0
    with pytest.raises(ValueError):
        resampling.poisson_bootstrap(df, [], ["p"], "id")


def test_poisson_bootstrap_agrees_with_draws(spark):
    """Intervals of the drawn bootstrap and of Poisson weights are alike, and a clear paired effect is found."""
    rng = np.random.default_rng(42)
    p = (rng.random(500) < 0.6).astype(int)
    q = np.where(rng.random(500) < 0.15, 0, p)
    df = spark.createDataFrame([("x", k, int(a), int(b)) for k, (a, b) in enumerate(zip(p, q))], "cell string, id long, p int, q int")
    r = resampling.cell_intervals(df, ["cell"], "p", "id", replicates=2000).first()
    point, low, high, n = statistics.bootstrap(p, 2000)
    assert r.point == pytest.approx(point) and r.n == n and abs(r.ci_low - low) < 0.01 and abs(r.ci_high - high) < 0.01 and r.ci_low < r.point < r.ci_high
    d = resampling.paired_intervals(df, ["cell"], "p", "q", "id", replicates=2000).first()
    wanted = statistics.paired_bootstrap(p, q, 2000)
    assert d.point == pytest.approx(wanted[0]) and abs(d.ci_low - wanted[1]) < 0.01 and abs(d.ci_high - wanted[2]) < 0.01 and d.p_value < 0.05


def test_poisson_bootstrap_shuffles_an_array_a_cell_and_task(spark):
    df = spark.range(6000).repartition(3).select("id", F.lit("x").alias("cell"), (F.col("id") % 2).alias("p"))
    out = resampling.poisson_bootstrap(df, ["cell"], ["p"], "id", 32)
    out.collect()
    assert max(n for n in written(out) if n != 6000) <= 3 * 32


def test_bottom_each(spark):
    """Ties in every column, a null stratum, one that holds nearly all rows, and an empty table; tasks hand on n rows a stratum."""
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", *["hot"] * 20]), rng.randrange(40), k % 700) for k in range(9000)]
    df = spark.createDataFrame(rows, "s string, d int, k int").repartition(4)
    got = selection.bottom_each(df, "s", ["d", "k"], 6)
    for s in (None, "a", "hot"):
        assert sorted((r.d, r.k) for r in got.collect() if r.s == s) == sorted((d, k) for t, d, k in rows if t == s)[:6]
        assert sorted(r["rank"] for r in got.collect() if r.s == s) == [1, 2, 3, 4, 5, 6]
    got.collect()
    assert min(written(got)) <= 4 * 3 * 6
    assert selection.bottom_each(df.limit(0), "s", ["d"], 3).count() == 0


def test_stratified_samples_shuffle_no_strata(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 3).cast("string").alias("source")).repartition(4)
    for sample in (relational.stratified_share, relational.stratified_equal):
        out = sample(docs.where("source IS NOT NULL"), "source", "doc_id", 30)
        assert out.count() == 30 and out.columns == docs.columns
        out.collect()
        assert all(n <= 4 * 3 * 30 or n == 2_000 for n in written(out))  # 2,000: the test's own repartition
    shares = relational.stratified_share(docs, "source", "doc_id", 100).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in shares}[None] >= 85


@pytest.mark.parametrize("share", [1.0, 0.3, 0.02])
def test_scan_in_order_stops_early(spark, share):
    """The rows of a sort, and not many more than needed are asked about; a callable predicate and a column agree."""
    from pyspark.sql import Column

    df = spark.range(8000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("o"), "id", F.lit("text").alias("t")).repartition(3)
    passes = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) < int(1000 * share)
    assert isinstance(passes, Column)
    wanted = df.where(passes).orderBy("o", "id").limit(40).collect()
    got, asked = selection.scan_in_order(df, passes, ["o", "id"], 40, ranges=64)
    assert got.collect() == wanted
    needed = df.where((F.col("o") < wanted[-1].o) | ((F.col("o") == wanted[-1].o) & (F.col("id") <= wanted[-1].id))).count()
    assert asked <= 4 * needed + 2 * 8000 // 64 * 2
    again, _ = selection.scan_in_order(df, lambda rows: rows.where(passes), ["o", "id"], 40, ranges=64)
    assert again.collect() == wanted


def test_scan_in_order_of_awkward_rows(spark):
    """Null and tied order values, fewer passing rows than asked for, and an empty table."""
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "o string, id int")
    got, asked = selection.scan_in_order(df, F.col("id") != 3, ["o", "id"], 10, ranges=3)
    assert [(r.o, r.id) for r in got.collect()] == [(None, 1), (None, 2), ("a", 4), ("b", 5)] and asked == 5
    got, asked = selection.scan_in_order(df.limit(0), F.lit(True), ["o"], 2)
    assert got.count() == 0 and asked == 0


# ---- leakage ----


def test_contained_by_definition(spark, monkeypatch):
    """Other white space, passages at both ends, shorter than a head, nested, repeated, blank, null; words cut short are no hits."""
    rng = random.Random(8)
    some = ["a", "b", "été", "日本", "long-word", "x" * 300]
    passages = [(k, " ".join(rng.choice(some) for _ in range(rng.choice([1, 2, 3, 9, 12, 30])))) for k in range(60)] + [(60, None), (61, "  \n"), (62, " a\tb  a "), (63, "a b a")]
    spaces = [" ", "  ", "\n", "\t ", "\r\n", "\x0b"]
    glue = lambda words: "".join(w + rng.choice(spaces) for w in words)
    docs = [(k, glue([rng.choice(some) for _ in range(rng.randrange(50))] + (rng.choice(passages)[1] or "").split() + [rng.choice(some) for _ in range(rng.randrange(3))])) for k in range(150)]
    docs += [(150, None), (151, ""), (152, passages[0][1]), (152, passages[1][1]), (153, (passages[5][1] or "") + "x"), (154, "a b a")]
    collapsed = lambda t: " " + " ".join((t or "").split()) + " "
    wanted = {(d, i) for d, t in docs for i, p in passages if p and p.split() and collapsed(p) in collapsed(t)}
    df, gold = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id int, passage string")
    found = leakage.contained(df.repartition(3), "doc_id", "text", gold, "item_id", "passage")
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    monkeypatch.setattr(leakage, "FEWEST", 4)
    monkeypatch.setattr(leakage, "MOST", 6)  # a filter that lets nearly all windows through
    assert sorted(map(tuple, leakage.contained(df, "doc_id", "text", gold, "item_id", "passage").collect())) == sorted(wanted)
    assert leakage.contained(df, "doc_id", "text", gold.where("item_id > 70"), "item_id", "passage").count() == 0
    assert leakage.contained(df.limit(0), "doc_id", "text", gold, "item_id", "passage").count() == 0


def test_contained_reads_documents_once(spark):
    docs, gold = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    plan = leakage.contained(docs, "doc_id", "text", gold, "item_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert sum("documents.parquet" in line for line in plan.splitlines() if "FileScan" in line) == 1


def test_windows_hash_alike_wherever_they_stand():
    rng = random.Random(3)
    words = [rng.choice(["the", "a", "Wort", "été", "w" * 2000]) for _ in range(400)]
    data = np.frombuffer("  ".join(words).encode(), np.uint8)
    starts, ends, cuts = rolling.word_spans(data, np.array([0, len(data)]))
    assert len(starts) == 400 and cuts.tolist() == [0, 400]
    prefix = rolling.prefixes(rolling.word_hashes(data, starts, ends))
    by_words = {}
    for at, h in enumerate(rolling.windows(prefix, np.arange(398), 3).tolist()):
        assert by_words.setdefault(tuple(words[at : at + 3]), h) == h
    assert len(set(by_words.values())) == len(by_words)


def test_equal_texts_and_unique_rates_shuffle_digests(spark):
    df = spark.createDataFrame([("x", "long text " * 50, True), ("x", "long  text " * 50, False), ("x", None, True)], "cell string, text string, ok boolean")
    rows = spark.range(1).select(F.lit(1).alias("item"), F.lit("long text " * 50).alias("p"))
    assert leakage.equal_texts(df, "cell", "text", rows, "item", "p").count() == 2
    from tallymill.operators import aggregates

    r = aggregates.unique_rate(df, ["cell"], "text", "ok").first()
    assert r.texts == 3 and r.unique_rate == pytest.approx(2 / 3)


# ---- layers and vocabularies ----


def test_precedence(spark):
    """Nulls give way, a null that nothing else fills stays, unknown cells get no default, and there is one shuffle."""
    frame = lambda rows: spark.createDataFrame(rows, "c string, s int, v double")
    a, b, d = frame([("x", 1, None), ("x", 2, 2.0)]), frame([("x", 1, 10.0), ("x", 2, 20.0), ("y", 1, None), (None, 1, 5.0)]), frame([("x", 1, -1.0), ("x", 3, -1.0), ("y", 2, -1.0), ("z", 1, -1.0), (None, 2, -1.0)])
    out = relational.precedence([a, b, d], ["c", "s"], "v", ["c"], defaults=1)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("x", 1, 10.0), ("x", 2, 2.0), ("y", 1, None), (None, 1, 5.0), ("x", 3, -1.0), ("y", 2, -1.0), (None, 2, -1.0)], key=repr)
    assert len(written(out)) == 1
    assert relational.precedence([a.limit(0), b.limit(0)], ["c", "s"], "v").count() == 0
    with pytest.raises(ValueError):
        relational.precedence([a, d], ["c", "s"], "v", defaults=1)
    assert relational.first_with_rows(a.limit(0), b, d) is b and relational.first_with_rows(a.limit(0), b.limit(0)).count() == 0


def test_longest_match(spark):
    tokens = ["a", "ab", "abc", "bc", "c", "é", "日本", "x"]
    words = ["abc", "abab", "abcbc", "q", "aq日本c", "é" * 40, "x", "qq"]
    vocabulary = spark.createDataFrame([(t, k) for k, t in enumerate(tokens)], "token string, rank long")

    def greedy(w):
        n = 0
        while w:
            w = w[max((len(t) for t in tokens if w.startswith(t)), default=1) :]
            n += 1
        return n

    df = spark.createDataFrame([(w,) for w in [*words, "abc", "", None]], "word string")
    assert {r.word: r.tokens for r in vocabulary_module.encoded_lengths(df, vocabulary).collect()} == {w: greedy(w) for w in words}
    assert {r.tokens for r in vocabulary_module.encoded_lengths(df, vocabulary.limit(0)).where("word = 'abc'").collect()} == {3}


def test_vocabulary_files(spark, tmp_path):
    """A written file, and a public one with tokens that are no text by themselves."""
    tokens = spark.createDataFrame([("a b", 0), ("é", 1), ("日本", 2)], "token string, rank long")
    vocabulary_module.write_vocabulary(tokens, str(tmp_path / "v"))
    assert sorted(map(tuple, vocabulary_module.read_vocabulary(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, tokens.collect()))
    public = pytest.importorskip("public_tokenizers")
    read = vocabulary_module.read_vocabulary(spark, public.path("byte_bpe_50k.tiktoken"))
    assert 45_000 < read.count() < 50_256
    counts = vocabulary_module.word_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ["lang"], "text")
    rows = vocabulary_module.vocabulary_metrics(counts, ["lang"], {"one": read, "letters": read.where("length(token) = 1")}).collect()
    assert {(r.lang, r.vocabulary): r.place for r in rows} == {(lang, v): p for lang in ("en", "de", "fr", "es") for v, p in (("one", 1), ("letters", 2))}
    assert all(r.tokens == r.chars for r in rows if r.vocabulary == "letters")


# ---- drawn bootstraps over the tables, roundings, assertions ----


def test_drawn_bootstraps_by_the_generator(spark):
    """The registered queries against the generator's own calls, cell by cell."""
    sf = "/root/testdata/sf0.001"
    rows = catalogue.flags(spark, sf).orderBy("dialect", "doc_id").collect()
    got = {name: {r.dialect: r for r in registry.QUERIES[name](spark, sf).collect()} for name in ("numpy_bootstrap_ci", "numpy_bootstrap_paired", "binomial_bootstrap_ci", "order_stat_paired")}
    for cell in {r.dialect for r in rows}:
        p, q = (np.array([r[c] for r in rows if r.dialect == cell], float) for c in "pq")
        means = np.random.default_rng(0).choice(p, size=(1000, len(p)), replace=True).mean(axis=1)
        r = got["numpy_bootstrap_ci"][cell]
        assert (r.point, r.n) == (pytest.approx(p.mean()), len(p)) and [r.ci_low, r.ci_high] == pytest.approx(np.quantile(means, [0.025, 0.975]))
        at = np.random.default_rng(0).integers(0, len(p), size=(1000, len(p)))
        d = p[at].mean(axis=1) - q[at].mean(axis=1)
        r = got["numpy_bootstrap_paired"][cell]
        assert r.point == pytest.approx(p.mean() - q.mean()) and [r.ci_low, r.ci_high] == pytest.approx(np.quantile(d, [0.025, 0.975])) and r.p_value == pytest.approx((d <= 0).mean())
        drawn = np.random.default_rng(0).binomial(len(p), p.mean(), 10_000) / len(p)
        r = got["binomial_bootstrap_ci"][cell]
        assert [r.ci_low, r.ci_high] == pytest.approx(np.quantile(drawn, [0.025, 0.975]))
        rng, diff = np.random.default_rng(42), p - q
        sums = np.sort([diff[rng.integers(0, len(p), size=len(p))].mean() for _ in range(1000)])
        r = got["order_stat_paired"][cell]
        assert (r.low, r.high, r.delta) == (pytest.approx(sums[25]), pytest.approx(sums[975]), pytest.approx(diff.mean()))


@pytest.mark.parametrize("name", ["hash_bootstrap_ci", "order_stat_bootstrap"])
def test_drawn_bootstrap_broadcasts_no_table(spark, monkeypatch, name):
    """The rows that a query numbers are joined by shuffles: no table of the input passes the driver, however small its file."""
    plans, write = [], statistics.write_in_order

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *args)

    monkeypatch.setattr(statistics, "write_in_order", watched)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 4
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_trial_inputs_of_parts(spark):
    """The query's inputs against the rule, argument by argument."""
    from tallymill.functions import text, trials

    sf = "/root/testdata/sf0.001"
    types = {r.p_partkey: r.t for r in catalogue.part_signatures(spark, sf).select("p_partkey", "sig.arg_types", text.exclusion(F.col("sig")).alias("e")).where("e IS NULL").withColumnRenamed("arg_types", "t").collect()}
    rows = registry.QUERIES["trial_inputs"](spark, sf).collect()
    assert {(r.p_partkey, r.trial): [list(x) for x in r.inputs] for r in rows} == {(k, n): trials.trial_inputs(list(t), str(k), n) for k, t in types.items() for n in (0, 1)}
    for r in rows:
        for t, values in zip(types[r.p_partkey], r.inputs):
            assert all(0.5 <= v <= 8 and v * 4 == int(v * 4) for v in values) if "f32" in t else all(0 <= v <= 7 for v in values)


def test_to_even(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.125, 0.5, 1.5, 2.5, None, float("nan"), float("inf"), 1e18]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", statistics.to_even(F.col("v"), 2).alias("two"), statistics.to_even(F.col("v"), 0).alias("none")).collect()
    for r in rows:
        for got, digits in ((r.two, 2), (r.none, 0)):
            wanted = r.v if r.v is None or r.v != r.v or abs(r.v) > 1e15 else round(r.v, digits)
            assert got == wanted or (got != got and wanted != wanted)


def test_asserted_counts(spark):
    found = spark.createDataFrame([("a", 2), (None, 1)], "k string, n long")
    assert statistics.asserted_counts(found, {"a": 2, None: 1}, "k", "n").count() == 2
    for wrong in ({"a": 3, None: 1}, {"a": 2}, {"a": 2, None: 1, "b": 1}):
        with pytest.raises(Exception, match="count of"):
            statistics.asserted_counts(found, wrong, "k", "n").collect()


def test_paired_first(spark):
    a = spark.createDataFrame([("x", True, 1), ("x", False, 2), (None, True, 3)], "k string, f boolean, id int")
    b = spark.createDataFrame([("x", 2, False), ("x", 1, True), ("y", 1, True), (None, 1, True)], "k string, o int, f boolean")
    assert sorted((r.id, r.flag_a, r.flag_b) for r in relational.paired_first(a, b, ["k"], "f", ["o"]).collect()) == [(1, True, True), (2, False, True)]
