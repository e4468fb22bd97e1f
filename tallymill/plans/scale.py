"""Queries of operators whose groups may be of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import programs, text
from tallymill.operators import relational as R
from tallymill.operators import resampling, selection
from tallymill.operators import statistics as S
from tallymill.operators import vocabulary as V
from tallymill.operators.numbering import global_number
from tallymill.plans.registry import EVAL, eval_rows, query
from tallymill.session import shared_folder, table
from tallymill.sources import readers, records

# ---- bootstrap by Poisson weights ----

_LIMITS = " + ".join(f"(u >= {x})::INT" for x in resampling.poisson_limits())


def replicates(rows: str, keys: str, values: str, n: int = resampling.REPLICATES) -> str:
    """Replicate means m of ``rows`` (doc_id, the keys, the values): weights are limits passed by 16 bits of a digest."""
    means = ", ".join(f"sum(w * {v}) / nullif(sum(w), 0)::DOUBLE AS {v}" for v in values.split())
    return f"""r AS ({rows}), u AS (SELECT r.*, b, ('0x' || substr(sha256(doc_id || ':' || (b // 16)), 1 + 4 * (b % 16), 4))::BIGINT AS u FROM r, range({n}) t(b)),
    w AS (SELECT *, {_LIMITS} AS w FROM u), m AS (SELECT {keys}, b, {means} FROM w GROUP BY {keys}, b)"""


_LONG = "SELECT doc_id, lang, source, (n_chars > 1500)::INT AS p FROM documents"


@query(
    "poisson_bootstrap_ci",
    f"""WITH {replicates(_LONG, "lang", "p")}, c AS (SELECT lang, quantile_cont(p, 0.025) AS ci_low, quantile_cont(p, 0.975) AS ci_high FROM m GROUP BY lang)
    SELECT lang, point, ci_low, ci_high, n FROM (SELECT lang, avg(p::DOUBLE) AS point, count(*) AS n FROM r GROUP BY lang) JOIN c USING (lang)""",
)
def poisson_bootstrap_ci(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("p"))
    return resampling.cell_intervals(docs, ["lang"], "p", "doc_id")


@query(
    "poisson_bootstrap_cells",
    f"""WITH {replicates(_LONG, "source, lang", "p")}, c AS (SELECT source, lang, quantile_cont(p, 0.05) AS ci_low, quantile_cont(p, 0.95) AS ci_high FROM m GROUP BY ALL)
    SELECT source, lang, point, ci_low, ci_high, n FROM (SELECT source, lang, avg(p::DOUBLE) AS point, count(*) AS n FROM r GROUP BY ALL) JOIN c USING (source, lang)""",
)
def poisson_bootstrap_cells(spark, sf_dir):
    """Many small cells at once, some of a few rows, of which some replicates draw none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("n_chars") > 1500).cast("int").alias("p"))
    return resampling.cell_intervals(docs, ["source", "lang"], "p", "doc_id", alpha=0.1)


_FLAGS = f"SELECT dialect, doc_id, passed::INT AS p, (n_chars > 700)::INT AS q FROM ({EVAL})"


def _flags(spark, sf_dir):
    return eval_rows(spark, sf_dir).select("dialect", "doc_id", F.col("passed").cast("int").alias("p"), (F.col("n_chars") > 700).cast("int").alias("q"))


@query(
    "poisson_bootstrap_paired",
    f"""WITH {replicates(_FLAGS, "dialect", "p q")},
    c AS (SELECT dialect, quantile_cont(p - q, 0.025) AS ci_low, quantile_cont(p - q, 0.975) AS ci_high, avg((p - q <= 0)::INT::DOUBLE) AS p_value FROM m GROUP BY dialect),
    o AS (SELECT dialect, avg(p::DOUBLE) - avg(q::DOUBLE) AS point, count(*) AS n FROM r GROUP BY dialect)
    SELECT dialect, point, ci_low, ci_high, p_value, n, point >= 0.10 AND ci_low > 0 AS clear_gain, abs(point) <= 0.03 AS within_margin, point < 0 AS halt FROM o JOIN c USING (dialect)""",
)
def poisson_bootstrap_paired(spark, sf_dir):
    return S.decisions(resampling.paired_intervals(_flags(spark, sf_dir), ["dialect"], "p", "q", "doc_id"))


@query(
    "poisson_order_stat",
    f"""WITH {replicates(_FLAGS, "dialect", "p")}, s AS (SELECT dialect, list_sort(list(p)) AS v FROM m GROUP BY dialect)
    SELECT dialect, v[floor(0.025 * len(v))::INT + 1] AS low, v[floor(0.975 * len(v))::INT + 1] AS high FROM s""",
)
def poisson_order_stat(spark, sf_dir):
    return S.order_interval(resampling.poisson_bootstrap(_flags(spark, sf_dir), ["dialect"], ["p"], "doc_id"), ["dialect"], F.col("mean_p"))


@query(
    "poisson_order_paired",
    f"""WITH {replicates(_FLAGS, "dialect", "p q")}, s AS (SELECT dialect, list_sort(list(p - q)) AS v FROM m GROUP BY dialect)
    SELECT dialect, delta, v[floor(0.025 * len(v))::INT + 1] AS low, v[floor(0.975 * len(v))::INT + 1] AS high, n FROM s JOIN (SELECT dialect, avg((p - q)::DOUBLE) AS delta, count(*) AS n FROM r GROUP BY dialect) USING (dialect)""",
)
def poisson_order_paired(spark, sf_dir):
    rows = _flags(spark, sf_dir)
    point = rows.groupBy("dialect").agg(F.avg((F.col("p") - F.col("q")).cast("double")).alias("delta"), F.count("*").alias("n"))
    return point.join(S.order_interval(resampling.poisson_bootstrap(rows, ["dialect"], ["p", "q"], "doc_id"), ["dialect"], F.col("mean_p") - F.col("mean_q")), "dialect")


# ---- samples and early stop ----


@query(
    "smallest_digests_each",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY d, event_id)::INT AS rank FROM (SELECT user_id, event_id, md5('3:' || event_id) AS d FROM events)
    QUALIFY rank <= 2""",
)
def smallest_digests_each(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", R.seeded("event_id", 3).alias("d"))
    return selection.bottom_each(events, "user_id", ["d", "event_id"], 2).select("user_id", "event_id", "rank")


@query(
    "first_passing_scan",
    r"SELECT doc_id, lang FROM documents WHERE len(regexp_extract_all(text, ' (?:the|der|la) ')) > 20 AND length(text) % 2 = 0 ORDER BY n_chars DESC, doc_id LIMIT 25",
)
def first_passing_scan(spark, sf_dir):
    """The longest documents that pass a pattern count; shorter ones are never asked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", (-F.col("n_chars")).alias("least"))
    passes = (F.regexp_count("text", F.lit(" (?:the|der|la) ")) > 20) & (F.length("text") % 2 == 0)
    return selection.scan_in_order(docs, passes, ["least", "doc_id"], 25)[0].select("doc_id", "lang")


# ---- layers by precedence ----


@query(
    "precedence_layers",
    """WITH o AS (SELECT *, o_custkey % 5 AS seed FROM orders), u AS (
      SELECT o_orderpriority, o_orderstatus, seed, CASE WHEN max(o_orderkey) % 2 = 0 THEN max(o_totalprice) END AS v, 0 AS layer FROM o WHERE o_orderkey % 97 = 0 GROUP BY ALL
      UNION ALL SELECT o_orderpriority, o_orderstatus, seed, min(o_totalprice), 1 FROM o WHERE o_orderkey % 11 = 0 AND seed = 1 GROUP BY ALL
      UNION ALL SELECT o_orderpriority, o_orderstatus, seed, max(o_totalprice), 2 FROM o WHERE seed < 3 AND o_orderstatus <> 'P' GROUP BY ALL
      UNION ALL SELECT p, s, k, -1.0, 3 FROM (SELECT DISTINCT o_orderpriority AS p FROM o), (SELECT DISTINCT o_orderstatus AS s FROM o UNION ALL SELECT 'X'), range(6) r(k)),
    c AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM u WHERE layer < 3)
    SELECT o_orderpriority, o_orderstatus, seed, arg_min(v, layer) AS v FROM u JOIN c USING (o_orderpriority, o_orderstatus) WHERE v IS NOT NULL GROUP BY ALL""",
)
def precedence_layers(spark, sf_dir):
    """Fixed values, overrides, a base that stands in for an empty one, and defaults for known cells."""
    orders = table(spark, sf_dir, "orders").withColumn("seed", F.col("o_custkey") % 5)
    keys = ["o_orderpriority", "o_orderstatus", "seed"]
    top = F.max("o_totalprice")
    fixed = orders.where("o_orderkey % 97 = 0").groupBy(*keys).agg(F.when(F.max("o_orderkey") % 2 == 0, top).alias("v"))
    override = orders.where("o_orderkey % 11 = 0 AND seed = 1").groupBy(*keys).agg(F.min("o_totalprice").alias("v"))
    base = R.first_with_rows(*(orders.where(w).groupBy(*keys).agg(top.alias("v")) for w in ("o_orderkey < 0", "seed < 3 AND o_orderstatus <> 'P'")))
    status = orders.select("o_orderstatus").distinct().unionByName(spark.range(1).select(F.lit("X").alias("o_orderstatus")))
    seeds = spark.range(6).select(F.col("id").alias("seed"))
    defaults = R.grid([orders.select("o_orderpriority").distinct(), status, seeds]).withColumn("v", F.lit(-1.0))
    return R.precedence([fixed, override, base, defaults], keys, "v", keys[:2], defaults=1)


# ---- vocabularies ----

_WORDS = r"SELECT lang, word, count(*) AS times FROM (SELECT lang, unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL"


@query(
    "vocabulary_metrics",
    f"""WITH c AS MATERIALIZED ({_WORDS}), g AS MATERIALIZED (SELECT word, sum(times) AS times FROM c GROUP BY word),
    s AS (SELECT DISTINCT unnest(string_split(word, '')) AS token FROM g),
    voc AS MATERIALIZED (SELECT 'common words' AS vocabulary, token FROM s UNION SELECT 'common words', word FROM g WHERE times >= 20
      UNION SELECT 'short parts', token FROM s UNION SELECT 'short parts', p FROM (SELECT substr(word, a, n) AS p, sum(times) AS t FROM g, range(1, 9) x(a), range(2, 5) y(n) WHERE a + n - 1 <= length(word) GROUP BY p) WHERE t >= 50),
    m AS (SELECT vocabulary, max(length(token)) AS m FROM voc GROUP BY vocabulary),
    places AS (SELECT word, unnest(range(1, length(word) + 1)) AS a FROM g), tries AS (SELECT vocabulary, word, a, unnest(range(1, least(m, length(word) - a + 1) + 1)) AS k FROM places, m),
    step AS MATERIALIZED (SELECT vocabulary, word, a, max(k) AS n FROM (SELECT *, substr(word, a, k) AS token FROM tries) SEMI JOIN voc USING (vocabulary, token) GROUP BY ALL),
    folded AS (SELECT vocabulary, word, list_reduce(list_prepend({{'a': 0::BIGINT, 'n': 0::BIGINT, 'next': 1::BIGINT, 'tokens': 0::BIGINT}}, list({{'a': a, 'n': n, 'next': 0::BIGINT, 'tokens': 0::BIGINT}} ORDER BY a)),
      lambda s, x: {{'a': x.a, 'n': x.n, 'next': CASE WHEN s.next = x.a THEN x.a + x.n ELSE s.next END, 'tokens': s.tokens + (s.next = x.a)::BIGINT}}) AS f FROM step GROUP BY ALL),
    e AS (SELECT vocabulary, word, f.tokens AS tokens FROM folded),
    t AS (SELECT lang, vocabulary, sum(times)::BIGINT AS words, sum(times * tokens)::BIGINT AS tokens, sum(times * length(word))::BIGINT AS chars,
      sum(times * tokens)::DOUBLE / sum(times * length(word)) AS tokens_per_char, sum(CASE WHEN tokens = 1 THEN times ELSE 0 END)::DOUBLE / sum(times) AS single_share FROM c JOIN e USING (word) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tokens_per_char, vocabulary)::INT AS place FROM t""",
)
def vocabulary_metrics(spark, sf_dir):
    """Two vocabularies made of the corpus, written as files and read back: characters with its common words, and with its common short parts."""
    counts = V.word_counts(table(spark, sf_dir, "documents"), ["lang"], "text")
    words = counts.groupBy("word").agg(F.sum("times").alias("times"))
    letters = words.select(F.explode(F.split("word", "")).alias("token")).where("token <> ''").distinct()
    starts = words.select("word", "times", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("a"))
    parts = starts.select("times", F.col("a"), "word", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("n")).where("a + n - 1 <= length(word)")
    common = parts.groupBy(F.expr("substring(word, a, n)").alias("token")).agg(F.sum("times").alias("t")).where("t >= 50").select("token")
    made = {"common words": letters.unionByName(words.where("times >= 20").select(F.col("word").alias("token"))), "short parts": letters.unionByName(common)}
    files = {}
    for name, tokens in made.items():
        path = shared_folder(spark, "vocabulary")
        V.write_vocabulary(tokens.distinct().withColumn("rank", F.length("token")), path)
        files[name] = V.read_vocabulary(spark, path)
    return V.vocabulary_metrics(counts, ["lang"], files)


# ---- alignments, roundings and assertions ----


@query(
    "paired_first_match",
    f"""WITH b AS (SELECT model, dialect, arg_min(passed, doc_id) AS flag_b FROM ({EVAL}) GROUP BY ALL) SELECT a.doc_id, a.passed AS flag_a, b.flag_b FROM ({EVAL}) a JOIN b USING (model, dialect)""",
)
def paired_first_match(spark, sf_dir):
    """Each result beside the first of its cell."""
    rows = eval_rows(spark, sf_dir).select("doc_id", "model", "dialect", "passed")
    return R.paired_first(rows, rows.select("model", "dialect", "doc_id", "passed"), ["model", "dialect"], "passed", ["doc_id"]).select("doc_id", "flag_a", "flag_b")


@query(
    "prefix_join",
    """WITH c AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_suppkey FROM supplier), r AS (SELECT p_partkey, p_partkey % (SELECT 2 + count(*) FROM supplier) - 1 AS idx FROM part)
    SELECT p_partkey, r.idx AS idx, s_suppkey FROM r LEFT JOIN c ON r.idx = c.idx""",
)
def prefix_join(spark, sf_dir):
    """References named ``012_name`` meet the candidate of that place, if there is one."""
    candidates = global_number(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], "idx")
    names = table(spark, sf_dir, "part").crossJoin(F.broadcast(table(spark, sf_dir, "supplier").agg((2 + F.count("*")).alias("n"))))  # one row
    names = names.select("p_partkey", F.concat(F.lpad((F.col("p_partkey") % F.col("n")).cast("string"), 7, "0"), F.lit("_"), "p_name").alias("source_id"))
    return names.select("p_partkey", text.prefix_index(F.col("source_id")).cast("long").alias("idx")).join(candidates, "idx", "left").select("p_partkey", "idx", "s_suppkey")


@query("nested_references", "SELECT p_partkey::VARCHAR AS id, p_brand AS dialect, p_retailprice AS expected_output, [p_size::DOUBLE, p_size / 2.0::DOUBLE] AS inputs FROM part")
def nested_references(spark, sf_dir):
    """A document that nests a list of references, read back as rows."""
    path = shared_folder(spark, "references")
    value = lambda v: F.struct(F.lit("f64").alias("type"), v.cast("double").alias("value"))
    one = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("dialect"), F.col("p_retailprice").alias("expected_output"), F.array(value(F.col("p_size")), value(F.col("p_size") / 2)).alias("inputs"))
    nested = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(one).alias("references"))).alias("record"))
    records.write_records(nested.select(F.concat("p_brand", F.lit(".json")).alias("f"), "record"), path, "f", "record")
    return readers.references(spark, path).select("id", "dialect", "expected_output", F.transform("inputs", lambda x: x["value"]).alias("inputs"))


@query(
    "eligible_programs",
    """SELECT p_partkey, k IN (0, 4) AS eligible FROM (SELECT p_partkey, p_partkey % 6 AS k FROM part)""",
)
def eligible_programs(spark, sf_dir):
    """Allowed namespaces only, some, with a function, without the barred word, not blank."""
    cases = ["func.func @f() { arith.addi }", "func.func @f() { math.sin }", "no namespace", "arith.addi", "func.func @g() { memref.load arith.addi }", "func.func @f() { arith.addi } // scf"]
    program = F.replace(F.element_at(F.array(*map(F.lit, cases)), (F.col("p_partkey") % len(cases) + 1).cast("int")), F.lit("@f"), F.concat(F.lit("@f"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", text.eligible(program, ["arith", "func", "memref"], "func.func", "scf").alias("eligible"))


@query(
    "top_level_parts",
    """SELECT p_partkey, parts, ending, element FROM part JOIN (VALUES (0, ['a<b,c>', ' (d, e)', ' f'], 'i32', 'f32'), (1, ['x'], 'memref<2x3xf32>', NULL), (2, ['[1, 2]', ' {a, b}'], NULL, 'vector<4xf32>')) t(id, parts, ending, element) ON id = p_partkey % 3""",
)
def top_level_parts(spark, sf_dir):
    """Parts between commas outside brackets, the type at a line's end, and the element type of a memref type."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", pick("a<b,c>, (d, e), f", "x", "[1, 2], {a, b}").alias("x"), pick("%0 = arith.addi %a, %b : i32", "memref.store %0, %m[%i, %j] : memref<2x3xf32>", "return").alias("y"), pick("memref<?x4xf32>", "tensor<8xi32>", "memref<?xvector<4xf32>>").alias("z"))
    return rows.select("p_partkey", programs.top_parts(F.col("x")).alias("parts"), programs.type_at_end(F.col("y")).alias("ending"), programs.element_of(F.col("z")).alias("element"))


@query("rounded_to_even", "SELECT o_orderkey, round_even((o_orderkey % 4000) / 8.0, 2)::DOUBLE AS price, round_even((o_custkey % 2001) / 2.0, 0)::DOUBLE AS half FROM orders")
def rounded_to_even(spark, sf_dir):
    eighth, half = (F.col("o_orderkey") % 4000) / 8, (F.col("o_custkey") % 2001) / 2
    return table(spark, sf_dir, "orders").select("o_orderkey", S.to_even(eighth, 2).alias("price"), S.to_even(half, 0).alias("half"))


@query("asserted_counts", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def asserted_counts(spark, sf_dir):
    """Five nations a region, or the query fails."""
    found = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return S.asserted_counts(found, {k: 5 for k in range(5)}, "n_regionkey", "n")
