"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import grammar, lattice, programs, text, trials
from tallymill.operators import aggregates as A
from tallymill.operators import leakage
from tallymill.operators import relational as R
from tallymill.operators import statistics as S
from tallymill.operators import workflow as X
from tallymill.plans.cases import SCOPES
from tallymill.plans.registry import EVAL, ORACLES, QUERIES, eval_rows, query
from tallymill.session import shared_folder, table
from tallymill.sources import readers, records, sinks
from tallymill.streaming import counts

# ---- rates and tables ----


@query(
    "cell_pass_rate",
    f"SELECT dialect, count(*) AS n, count_if(passed) AS passes, avg(passed::INT::DOUBLE) AS rate FROM ({EVAL}) GROUP BY dialect",
)
def cell_pass_rate(spark, sf_dir):
    return A.cell_rates(eval_rows(spark, sf_dir), ["dialect"], "passed")


@query(
    "cell_counts_pivot",
    f"""SELECT dialect, count_if(c = 'clean') AS clean, count_if(c = 'toxic') AS toxic, count_if(c = 'low') AS low, count_if(c = 'absent') AS absent, count(*) AS n
    FROM (SELECT dialect, CASE WHEN flagged THEN 'toxic' WHEN passed THEN 'clean' ELSE 'low' END AS c FROM ({EVAL})) GROUP BY dialect""",
)
def cell_counts_pivot(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("c", F.when(F.col("flagged"), "toxic").when(F.col("passed"), "clean").otherwise("low"))
    return A.category_table(rows, ["dialect"], "c", ["clean", "toxic", "low", "absent"])


@query(
    "cell_summary",
    f"""SELECT model, count(*) AS n, avg((n_chars > 500)::INT::DOUBLE) AS parse_rate, avg(passed::INT::DOUBLE) AS verify_rate,
    avg(coalesce(nullif(doc_id % 4, 0), 1)::DOUBLE) AS mean_attempts, avg(coalesce(CASE WHEN doc_id % 7 > 0 THEN n_chars / 8.0 END, 0)::DOUBLE) AS mean_dt
    FROM ({EVAL}) GROUP BY model""",
)
def cell_summary(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).select(
        "model", (F.col("n_chars") > 500).alias("parse_valid"), F.col("passed").alias("verify_valid"),
        F.nullif(F.col("doc_id") % 4, F.lit(0)).alias("attempts"), F.when(F.col("doc_id") % 7 > 0, F.col("n_chars") / 8).alias("dt"),
    )
    return A.cell_summary(rows, ["model"])


@query(
    "three_seed_cell",
    f"""WITH e AS (SELECT dialect, seed, avg(passed::INT::DOUBLE) AS r, count(*) AS n FROM ({EVAL}) GROUP BY ALL)
    SELECT dialect, count(*) AS seeds, avg(r) AS mean_rate, (max(r) - min(r)) / 2 AS half_range, min(r) AS low, max(r) AS high, min(n) = max(n) AS equal_n
    FROM e GROUP BY dialect""",
)
def three_seed_cell(spark, sf_dir):
    return A.seed_summary(eval_rows(spark, sf_dir), ["dialect"], "seed", "passed")


@query(
    "unique_text_rate",
    f"""WITH e AS (SELECT dialect, text, avg(passed::INT::DOUBLE) AS r FROM ({EVAL}) GROUP BY ALL)
    SELECT dialect, count(*) AS texts, avg(r) AS unique_rate FROM e GROUP BY dialect""",
)
def unique_text_rate(spark, sf_dir):
    return A.unique_rate(eval_rows(spark, sf_dir), ["dialect"], "text", "passed")


NORM = r"trim(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+', ' ', 'g'))".replace('\\"', '"')


@query(
    "distinct_raw_vs_normalised",
    f"SELECT lang, count(*) AS n, count(DISTINCT text) AS raw, count(DISTINCT {NORM.format('text')}) AS normalised FROM documents GROUP BY lang",
)
def distinct_raw_vs_normalised(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    sha = lambda c: F.sha2(c, 256)  # noqa: E731  digests keep the shuffle of distinct texts small
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct(sha(F.col("text"))).alias("raw"), F.countDistinct(sha(text.normalise(F.col("text")))).alias("normalised"))


@query(
    "truncation_stats",
    """SELECT lang, count(*) AS n, count_if(t) AS truncated, count_if(t AND v) AS truncated_valid, (count_if(v) + count_if(t)) / count(*) AS worst_case_credit
    FROM (SELECT lang, NOT regexp_matches(text, '[.!?|]\\s*$') AS t, n_chars > 800 AS v FROM documents) GROUP BY lang""",
)
def truncation_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", (~F.col("text").rlike(r"[.!?|]\s*\z")).alias("t"), (F.col("n_chars") > 800).alias("v"))
    return A.truncation(docs, ["lang"], F.col("t"), F.col("v"))


@query(
    "open_brace_pages",
    "SELECT page_id, len(regexp_extract_all(html, '<')) AS opened, len(regexp_extract_all(html, '>')) AS closed, len(regexp_extract_all(html, '\\{')) > len(regexp_extract_all(html, '\\}')) AS cut FROM pages",
)
def open_brace_pages(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<").alias("opened"), n(">").alias("closed"), text.truncated(F.col("html")).alias("cut"))


@query(
    "leakage_exact",
    r"""SELECT b.item_id, d.doc_id FROM benchmark b JOIN (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, '  ' || replace(text, ' ', chr(10) || ' ') FROM benchmark) d
    ON trim(regexp_replace(b.text, '\s+', ' ', 'g')) = trim(regexp_replace(d.text, '\s+', ' ', 'g'))""",
)
def leakage_exact(spark, sf_dir):
    """Among the documents and copies of the passages with other white space."""
    gold = table(spark, sf_dir, "benchmark").select("item_id", "text")
    planted = gold.select((-1 - F.col("item_id")).alias("doc_id"), F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\n "))).alias("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(planted)
    return leakage.equal_texts(docs, "doc_id", "text", gold, "item_id", "text").select("item_id", "doc_id")


@query(
    "leakage_contains",
    r"""SELECT b.item_id, d.doc_id FROM benchmark b, documents d
    WHERE contains(' ' || trim(regexp_replace(d.text, '\s+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(b.text, '\s+', ' ', 'g')) || ' ')""",
)
def leakage_contains(spark, sf_dir):
    return leakage.contained(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "doc_id")


@query(
    "leakage_by_source",
    r"""WITH h AS (SELECT d.doc_id, count(*) AS hits FROM benchmark b, documents d
      WHERE contains(' ' || trim(regexp_replace(d.text, '\s+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(b.text, '\s+', ' ', 'g')) || ' ') GROUP BY d.doc_id)
    SELECT source, count(*) AS documents, count(hits) AS leaked, coalesce(sum(hits), 0)::BIGINT AS hits FROM documents LEFT JOIN h USING (doc_id) GROUP BY source""",
)
def leakage_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = leakage.contained(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return leakage.by_group(docs, "doc_id", "source", found)


@query(
    "confusion_2x2",
    f"""SELECT dialect, count_if(g AND passed) AS accept_pass, count_if(g AND NOT passed) AS accept_fail, count_if(NOT g AND passed) AS reject_pass,
    count_if(NOT g AND NOT passed) AS reject_fail, count_if(NOT g AND passed)::DOUBLE / nullif(count_if(passed), 0) AS false_reject_rate
    FROM (SELECT *, n_chars > 700 AS g FROM ({EVAL})) GROUP BY dialect""",
)
def confusion_2x2(spark, sf_dir):
    return A.confusion(eval_rows(spark, sf_dir), ["dialect"], F.col("n_chars") > 700, F.col("passed"))


@query(
    "concordance_by_family",
    f"""SELECT dialect, count(*) AS n, avg((passed = g)::INT::DOUBLE) AS agreement, count_if(passed AND NOT g) AS only_a, count_if(NOT passed AND g) AS only_b
    FROM (SELECT *, n_chars > 700 AS g FROM ({EVAL})) GROUP BY GROUPING SETS ((dialect), ())""",
)
def concordance_by_family(spark, sf_dir):
    return A.concordance(eval_rows(spark, sf_dir).withColumn("g", F.col("n_chars") > 700), "dialect", "passed", "g")


@query(
    "verdict_drift",
    f"""WITH r AS (SELECT doc_id, passed AS p, n_chars > 300 AS q FROM ({EVAL})), a AS (SELECT avg((p IS NOT DISTINCT FROM q)::INT::DOUBLE) AS agreement, count(*) AS n FROM r)
    SELECT doc_id, p, q, agreement, n FROM r, a WHERE p IS DISTINCT FROM q""",
)
def verdict_drift(spark, sf_dir):
    """The disagreements of two verdicts, each with the overall rate."""
    rows = eval_rows(spark, sf_dir).select("doc_id", F.col("passed").alias("p"), (F.col("n_chars") > 300).alias("q"))
    same = F.col("p").eqNullSafe(F.col("q"))
    overall = rows.agg(A.rate(same).alias("agreement"), F.count("*").alias("n"))
    return rows.where(~same).crossJoin(F.broadcast(overall))  # one row


@query(
    "cascade_rates",
    """SELECT o_orderpriority, avg(v::INT::DOUBLE) AS v, avg((v AND l)::INT::DOUBLE) AS l, avg((v AND l AND e)::INT::DOUBLE) AS e, avg((v AND l AND e AND m)::INT::DOUBLE) AS m
    FROM (SELECT o_orderpriority, o_totalprice > 50000 AS v, o_orderstatus <> 'P' AS l, o_custkey % 3 > 0 AS e, o_totalprice < 250000 AS m FROM orders)
    GROUP BY GROUPING SETS ((o_orderpriority), ())""",
)
def cascade_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", (F.col("o_totalprice") > 50000).alias("v"), (F.col("o_orderstatus") != "P").alias("l"), (F.col("o_custkey") % 3 > 0).alias("e"), (F.col("o_totalprice") < 250000).alias("m")
    )
    stages = ["v", "l", "e", "m"]
    return A.with_total(X.cascade(rows, stages), "o_orderpriority", *[A.rate(F.col(s)).alias(s) for s in stages])


GATE = """SELECT doc_id, dialect, CASE doc_id % 5 WHEN 0 THEN 'excluded' WHEN 1 THEN 'fail' ELSE 'pass' END AS gate,
  CASE WHEN doc_id % 5 < 2 THEN 'skipped' WHEN n_chars < 300 THEN 'no_candidate' WHEN passed THEN 'match' ELSE 'mismatch' END AS status"""


@query(
    "gate_two_denominators",
    f"""SELECT dialect, count_if(gate = 'pass') AS gate_pass, count_if(gate = 'fail') AS gate_fail, count_if(status IN ('match', 'mismatch')) AS scored,
    count_if(status = 'match')::DOUBLE / nullif(count_if(status IN ('match', 'mismatch')), 0) AS match_of_scored,
    count_if(status = 'match')::DOUBLE / nullif(count_if(gate = 'pass'), 0) AS match_of_passed FROM ({GATE} FROM ({EVAL})) GROUP BY dialect""",
)
def gate_two_denominators(spark, sf_dir):
    m = F.col("doc_id") % 5
    rows = eval_rows(spark, sf_dir).select(
        "dialect", F.when(m == 0, "excluded").when(m == 1, "fail").otherwise("pass").alias("gate"),
        F.when(m < 2, "skipped").when(F.col("n_chars") < 300, "no_candidate").when(F.col("passed"), "match").otherwise("mismatch").alias("status"),
    )
    return A.gate_table(rows, ["dialect"], "gate", "status")


@query(
    "first_divergence",
    """SELECT conv_id, count(*) AS trials, count_if(m) AS matched, bool_and(m) AS all_match, arg_min(role, turn) FILTER (NOT m) AS first_divergence
    FROM (SELECT *, length(text) < 600 AS m FROM conversations) GROUP BY conv_id""",
)
def first_divergence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return A.trial_table(rows, ["conv_id"], "turn", F.length("text") < 600, "role")


@query(
    "gate_status_join",
    """WITH g AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'excluded' WHEN 1 THEN 'fail' ELSE 'pass' END AS gate, text AS gate_nl FROM documents),
    c AS (SELECT doc_id, text AS nl, source AS generated, quality = 1 AS verify_valid, quality = 1 OR doc_id % 6 = 2 AS compatible FROM documents JOIN labels USING (doc_id)),
    t AS (SELECT conv_id AS doc_id, count(*) AS trials, bool_and(length(text) > 20) AS all_match FROM conversations GROUP BY conv_id)
    SELECT doc_id, CASE WHEN gate = 'excluded' THEN 'excluded' WHEN gate = 'fail' THEN 'gate_fail' WHEN generated IS NULL THEN 'no_candidate' WHEN nl <> gate_nl THEN 'nl_mismatch'
      WHEN NOT coalesce(verify_valid, false) THEN 'not_valid' WHEN NOT coalesce(compatible, false) THEN 'incompatible' WHEN trials IS NULL THEN 'no_trials'
      WHEN all_match THEN 'match' ELSE 'mismatch' END AS status
    FROM g LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def gate_status_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    m = F.col("doc_id") % 4
    gates = docs.select("doc_id", F.when(m == 0, "excluded").when(m == 1, "fail").otherwise("pass").alias("gate"), F.col("text").alias("gate_nl"))
    ok = F.col("quality") == 1
    cand = docs.join(labels, "doc_id").select("doc_id", F.col("text").alias("nl"), F.col("source").alias("generated"), ok.alias("verify_valid"), (ok | (F.col("doc_id") % 6 == 2)).alias("compatible"))
    trials = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("trial"), (F.length("text") > 20).alias("match"), F.col("role").alias("err"))
    return X.gate_status(gates, cand, trials, ["doc_id"]).select("doc_id", "status")


@query("ragged_mean", "SELECT avg(x::DOUBLE) AS mean, count(*) AS n FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def ragged_mean(spark, sf_dir):
    return A.ragged_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")[0]


@query(
    "ragged_curve",
    "SELECT (p - 1)::INT AS position, avg(x::DOUBLE) AS mean, count(*) AS n FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY p",
)
def ragged_curve(spark, sf_dir):
    return A.ragged_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")[1]


@query("ragged_by_row", "SELECT vec_id, avg(x::DOUBLE) AS mean, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def ragged_by_row(spark, sf_dir):
    return A.ragged_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")[2]


@query(
    "entropy_bits",
    """SELECT user_id % 50 AS cell, -sum(p * log2(p)) AS bits FROM (
      SELECT user_id % 50 AS user_id, event_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id % 50) AS p FROM events GROUP BY user_id % 50, event_type) GROUP BY user_id""",
)
def entropy_bits(spark, sf_dir):
    counts_ = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("cell"), "event_type").agg(F.count("*").alias("n"))
    shares = counts_.groupBy("cell").agg(F.collect_list("n").alias("ns"))  # a number for each event type
    total = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)
    return shares.withColumn("total", total).select("cell", text.entropy_bits(F.transform("ns", lambda x: x / F.col("total"))).alias("bits"))


@query(
    "best_of_baseline",
    f"""WITH r AS (SELECT dialect, model, avg(passed::INT::DOUBLE) AS rate FROM ({EVAL}) GROUP BY ALL),
    b AS (SELECT dialect, model, rate, row_number() OVER (PARTITION BY dialect ORDER BY rate DESC, model) AS k FROM r WHERE model <> 'src1'),
    o AS (SELECT dialect, max(rate) FILTER (model = 'src1') AS ours FROM r GROUP BY dialect)
    SELECT o.dialect, ours, b.model AS best_other, b.rate AS best_value, ours - b.rate AS delta, ours - b.rate >= -0.03 AS within_margin, ours - b.rate > 0 AS beats
    FROM o JOIN b ON o.dialect = b.dialect AND k = 1""",
)
def best_of_baseline(spark, sf_dir):
    rates = A.cell_rates(eval_rows(spark, sf_dir), ["dialect", "model"], "passed")
    return A.best_of(rates, ["dialect"], "model", "rate", "src1")


@query(
    "new_flip",
    f"""SELECT c.doc_id, CASE WHEN c.flagged AND NOT coalesce(r.ref, false) THEN 'new_flip' WHEN c.flagged THEN 'pre_existing' WHEN coalesce(r.ref, false) THEN 'fixed' ELSE 'stable' END AS flip
    FROM ({EVAL}) c LEFT JOIN (SELECT doc_id, doc_id % 4 = 0 AS ref FROM documents WHERE doc_id % 3 > 0) r USING (doc_id)""",
)
def new_flip(spark, sf_dir):
    cells = eval_rows(spark, sf_dir).select("doc_id", "flagged")
    reference = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", (F.col("doc_id") % 4 == 0).alias("flagged"))
    return A.flips(cells, reference, "doc_id", "flagged").select("doc_id", "flip")


@query(
    "error_reduction",
    """SELECT event_type, a AS before, b AS after, a - b AS decrease, (a - b) / greatest(a, 1) AS decrease_share FROM (
      SELECT event_type, count_if(user_id % 2 = 0) AS a, count_if(user_id % 3 = 0) AS b FROM events GROUP BY event_type)""",
)
def error_reduction(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("before"), F.count_if(F.col("user_id") % 3 == 0).alias("after"))
    return A.reduction(n, F.col("before"), F.col("after"))


@query(
    "rate_by_first_word",
    f"""SELECT coalesce(s.op, regexp_extract(lower(e.text), '([a-z]+)', 1)) AS op, avg(passed::INT::DOUBLE) AS rate, count(*) AS n
    FROM ({EVAL}) e LEFT JOIN (SELECT doc_id, 'seed' AS op FROM documents WHERE doc_id % 10 = 0) s USING (doc_id) GROUP BY 1""",
)
def rate_by_first_word(spark, sf_dir):
    rows = eval_rows(spark, sf_dir)
    seeds = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select("doc_id", F.lit("seed").alias("known"))
    op = F.coalesce("known", F.regexp_extract(F.lower("text"), "([a-z]+)", 1))
    return rows.join(seeds, "doc_id", "left").groupBy(op.alias("op")).agg(A.rate(F.col("passed")).alias("rate"), F.count("*").alias("n"))


@query(
    "rescore",
    f"""SELECT model, count(*) AS n, sum((n_chars > 500)::INT)::BIGINT AS pv, sum(passed::INT)::BIGINT AS vv, count_if(trim(text) = '') AS empty FROM ({EVAL}) GROUP BY model""",
)
def rescore(spark, sf_dir):
    return eval_rows(spark, sf_dir).groupBy("model").agg(
        F.count("*").alias("n"), F.sum(text.truthy(F.col("n_chars") > 500)).alias("pv"), F.sum(text.truthy(F.col("passed"))).alias("vv"), F.count_if(F.trim("text") == "").alias("empty")
    )


@query("speed_up", "SELECT l_returnflag, sum(l_extendedprice) / nullif(sum(l_extendedprice * (1 - l_discount)), 0) AS ratio FROM lineitem GROUP BY l_returnflag")
def speed_up(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(A.ratio_of_sums(F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ratio"))


@query(
    "token_metrics",
    r"""SELECT lang, sum(len(regexp_extract_all(text, '\w+|[^\w\s]')))::BIGINT AS tokens, sum(length(text))::BIGINT AS chars,
    sum(len(regexp_extract_all(text, '\w+|[^\w\s]'))) / sum(length(text))::DOUBLE AS tokens_per_char FROM (SELECT lang, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS text FROM documents) GROUP BY lang""",
)
def token_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))
    n, chars = F.regexp_count("text", F.lit(r"\w+|[^\w\s]")), F.length("text")
    return docs.groupBy("lang").agg(F.sum(n).alias("tokens"), F.sum(chars).alias("chars"), (F.sum(n) / F.sum(chars)).alias("tokens_per_char"))


@query("id_uniqueness", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT doc_id) AS unique_ids, count(DISTINCT lang) AS groups FROM documents")
def id_uniqueness(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), (F.count("*") == F.countDistinct("doc_id")).alias("unique_ids"), F.countDistinct("lang").alias("groups")
    )


# ---- filters and projections ----


@query("equal_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'")
def equal_filter(spark, sf_dir):
    return R.where_equal(table(spark, sf_dir, "documents"), lang="en", source="src3").select("doc_id")


@query("optional_filter", "SELECT doc_id FROM documents WHERE lang = 'de'")
def optional_filter(spark, sf_dir):
    return R.where_given(table(spark, sf_dir, "documents"), lang="de", source=None).select("doc_id")


@query("presence_filter", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL OR quality = 1")
def presence_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.where_present(rows, quality=1, absent_column=5).select("doc_id", "quality")


@query(
    "canonical_matrix",
    "SELECT doc_id AS prompt_id, source AS model, coalesce(quality = 1, false) AS verify_valid, 0 AS seed, 1 AS attempts FROM documents LEFT JOIN labels USING (doc_id)",
)
def canonical_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("passed", F.col("quality") == 1)
    out = R.canonical(rows, {"passed": "verify_valid", "doc_id": "prompt_id", "source": "model"}, {"verify_valid": False, "seed": 0, "attempts": 1})
    return out.select("prompt_id", "model", "verify_valid", "seed", "attempts")


@query(
    "prompt_coalesce",
    """SELECT page_id, 'Task: ' || coalesce(nullif(a, ''), nullif(b, ''), '') AS prompt FROM (
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS a, url AS b FROM pages)""",
)
def prompt_coalesce(spark, sf_dir):
    a = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Task: "), text.or_blank(a, F.col("url"))).alias("prompt"))


@query(
    "backend_routing",
    """SELECT p_partkey, CASE WHEN regexp_matches(lower(m), 'phi|smollm|gemma') THEN 'mlx' WHEN regexp_matches(lower(m), 'codellama|granite') THEN 'ollama' ELSE 'mock' END AS backend
    FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'SmolLM2-1.7B' WHEN 1 THEN 'granite-34b' WHEN 2 THEN 'CodeLlama' WHEN 3 THEN 'starcoder2' ELSE p_brand END AS m FROM part)""",
)
def backend_routing(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "SmolLM2-1.7B").when(k == 1, "granite-34b").when(k == 2, "CodeLlama").when(k == 3, "starcoder2").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.backend(name).alias("backend"))


@query("log_truncation", "SELECT doc_id, substr(text, 1, 120) AS head, nullif(substr(text, 1, doc_id % 3), '') AS short FROM documents")
def log_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 120).alias("head"), F.nullif(F.col("text").substr(F.lit(1), (F.col("doc_id") % 3).cast("int")), F.lit("")).alias("short"))


@query(
    "eligibility_filter",
    r"""WITH n AS (SELECT page_id, html, list_distinct(regexp_extract_all(html, '([a-z_][a-z_0-9]*)\.[a-z_]', 1)) AS ns FROM pages)
    SELECT page_id FROM n WHERE len(list_filter(ns, lambda x: NOT list_contains(['www', 'blog', 'm', 'example'], x))) <= 3 AND len(ns) > 0 AND contains(html, '<article>') AND NOT contains(html, '.org') AND trim(html) <> ''""",
)
def eligibility_filter(spark, sf_dir):
    html = F.col("html")
    found = text.namespaces(html)
    few = F.size(F.array_except(found, F.array(*map(F.lit, ["www", "blog", "m", "example"])))) <= 3
    return table(spark, sf_dir, "pages").where(few & (F.size(found) > 0) & html.contains("<article>") & ~html.contains(".org") & (F.trim(html) != "")).select("page_id")


@query("short_prompts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 30 AS short FROM documents")
def short_prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (text.word_count(F.col("text")) <= 30).alias("short"))


@query(
    "record_validation",
    """SELECT doc_id, unnest(e) AS error FROM (SELECT doc_id, list_filter([
      CASE WHEN lang NOT IN ('en', 'de') THEN 'lang: unknown' END, CASE WHEN n_chars < 100 THEN 'text: short' END,
      CASE WHEN source <> 'src' || (doc_id % 20) THEN 'source: not its number' END], lambda x: x IS NOT NULL) AS e FROM documents)""",
)
def record_validation(spark, sf_dir):
    errors = F.array_compact(
        F.array(
            F.when(~F.col("lang").isin("en", "de"), "lang: unknown"),
            F.when(F.col("n_chars") < 100, "text: short"),
            F.when(F.col("source") != F.concat(F.lit("src"), F.col("doc_id") % 20), "source: not its number"),
        )
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(errors).alias("error"))


# ---- joins, windows, sets ----


@query(
    "paired_alignment",
    f"""SELECT a.doc_id, a.seed, a.passed AS flag_a, b.g AS flag_b FROM ({EVAL}) a JOIN (SELECT doc_id, doc_id % 3 AS seed, n_chars > 900 AS g FROM documents WHERE doc_id % 4 > 0) b USING (doc_id, seed)""",
)
def paired_alignment(spark, sf_dir):
    a = eval_rows(spark, sf_dir).select("doc_id", "seed", F.col("passed").alias("flag"), F.lit(0).alias("line"))
    b = table(spark, sf_dir, "documents").where("doc_id % 4 > 0").select("doc_id", (F.col("doc_id") % 3).alias("seed"), (F.col("n_chars") > 900).alias("flag"), F.lit(0).alias("line"))
    return R.paired(a, b, ["doc_id", "seed"], "flag", ["line"])


@query(
    "shared_vs_only",
    """WITH a AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1)
    SELECT min(doc_id) AS doc_id, 'shared' AS side FROM b WHERE text IN (FROM a) GROUP BY text
    UNION ALL SELECT doc_id, 'only' FROM b WHERE text NOT IN (FROM a)""",
)
def shared_vs_only(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text"))
    return R.shared_and_only(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text", "doc_id").select("doc_id", "side")


@query(
    "key_mismatch",
    "SELECT doc_id, 'a' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
)
def key_mismatch(spark, sf_dir):
    return R.key_mismatch(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "positions_agree",
    """SELECT bool_and(a.lang IS NOT DISTINCT FROM b.lang) AS agree, count_if(a.lang IS DISTINCT FROM b.lang) AS differences
    FROM documents a FULL JOIN (SELECT doc_id, lang FROM documents WHERE doc_id % 100 > 0) b USING (doc_id)""",
)
def positions_agree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.positions_agree(docs, docs.where("doc_id % 100 > 0"), "doc_id", "lang")


@query("experiment_grid", "SELECT r_name, n_name, s.s AS seed FROM region, nation, (VALUES (0), (1), (2)) s(s) WHERE NOT (r_name = 'ASIA' AND n_nationkey < 5)")
def experiment_grid(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    seeds = spark.createDataFrame([(0,), (1,), (2,)], "seed int")
    return R.grid([nation, region, seeds], (F.col("r_name") == "ASIA") & (F.col("n_nationkey") < 5)).select("r_name", "n_name", "seed")


@query("keep_first_text", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_first_text(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("t")), ["t"], ["doc_id"]).select("doc_id")


@query("keep_last_key", "SELECT user_id, event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def keep_last_key(spark, sf_dir):
    return R.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "provenance_groups",
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS unique_group, doc_id = min(doc_id) OVER (PARTITION BY lang, text) AS is_first_occurrence FROM documents",
)
def provenance_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("t"))
    return R.provenance(docs, ["lang"], "t", "doc_id").select("doc_id", "unique_group", "is_first_occurrence")


@query("numbered_families", "SELECT p_partkey, p_brand || '_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def numbered_families(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"]).select("p_partkey", F.concat_ws("_", "p_brand", "number").alias("id"))


@query(
    "head_each_cell",
    f"SELECT dialect, avg(passed::INT::DOUBLE) AS rate, count(*) AS n FROM (SELECT * FROM ({EVAL}) QUALIFY row_number() OVER (PARTITION BY dialect ORDER BY doc_id) <= 25) GROUP BY dialect",
)
def head_each_cell(spark, sf_dir):
    rows = R.head_each(eval_rows(spark, sf_dir).select("dialect", "doc_id", "passed"), ["dialect"], ["doc_id"], 25)
    return rows.groupBy("dialect").agg(A.rate(F.col("passed")).alias("rate"), F.count("*").alias("n"))


@query(
    "step_deltas",
    f"SELECT dialect, seed, r AS rate, r - lag(r) OVER (PARTITION BY dialect ORDER BY seed) AS delta FROM (SELECT dialect, seed, avg(passed::INT::DOUBLE) AS r FROM ({EVAL}) GROUP BY ALL)",
)
def step_deltas(spark, sf_dir):
    rates = A.cell_rates(eval_rows(spark, sf_dir), ["dialect", "seed"], "passed").select("dialect", "seed", "rate")
    return R.step_deltas(rates, ["dialect"], "seed", "rate")


@query(
    "layered_merge",
    """WITH b AS (SELECT source, doc_id % 4 AS seed, avg(n_chars) AS v FROM documents WHERE doc_id % 4 < 2 GROUP BY ALL), o AS (SELECT source, doc_id % 4 AS seed, max(n_chars)::DOUBLE AS v FROM documents WHERE doc_id % 4 = 1 AND lang = 'en' GROUP BY ALL),
    d AS (SELECT 'src' || (k % 25) AS source, k % 4 AS seed, -1.0::DOUBLE AS v FROM range(100) r(k)), m AS (SELECT source, seed, coalesce(o.v, b.v) AS v FROM b FULL JOIN o USING (source, seed))
    SELECT source, seed, coalesce(m.v, d.v) AS v FROM m FULL JOIN (SELECT * FROM d WHERE source IN (SELECT source FROM m)) d USING (source, seed)""",
)
def layered_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("seed", F.col("doc_id") % 4)
    base = docs.where("seed < 2").groupBy("source", "seed").agg(F.avg("n_chars").alias("v"))
    override = docs.where("seed = 1 AND lang = 'en'").groupBy("source", "seed").agg(F.max("n_chars").cast("double").alias("v"))
    defaults = spark.range(100).select(F.concat(F.lit("src"), F.col("id") % 25).alias("source"), (F.col("id") % 4).alias("seed"), F.lit(-1.0).alias("v"))
    return R.layered(base, override, defaults, ["source"], "seed", "v")


@query("union_by_name", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return R.union_all(a, b)


@query("set_algebra", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS common, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT vec_id FROM embeddings INTERSECT SELECT -1 - doc_id FROM documents)) = 0 AS disjoint")
def set_algebra(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    none = table(spark, sf_dir, "embeddings").select("vec_id").intersect(a.select((-1 - F.col("doc_id")).alias("vec_id")))
    return n(a.intersect(b), "common").crossJoin(n(a.exceptAll(b).distinct(), "only_left")).crossJoin(none.agg((F.count("*") == 0).alias("disjoint")))  # one row each


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return R.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 7)


@query(
    "seeded_sample_pool",
    """WITH f AS (SELECT doc_id FROM documents WHERE doc_id < 30), p AS (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (FROM f)),
    u AS (SELECT doc_id, 'spec' AS source, lpad(doc_id::VARCHAR, 20, '0') AS o FROM f UNION ALL SELECT doc_id, 'pad', md5('0:' || doc_id) FROM p)
    SELECT doc_id, source, row_number() OVER (ORDER BY source DESC, o, doc_id)::INT - 1 AS ord FROM u QUALIFY ord < 80""",
)
def seeded_sample_pool(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.pool(docs.where("doc_id < 30").select("doc_id"), docs.where("lang = 'en'").select("doc_id"), "doc_id", 80)


@query(
    "stratified_sample_prop",
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS n,
      count(*) OVER (PARTITION BY source) AS c, count(*) OVER () AS a FROM documents)
    SELECT doc_id, source FROM r WHERE n <= greatest(1, round(60 * c / a)) ORDER BY md5('0:' || doc_id), doc_id LIMIT 60""",
)
def stratified_sample_prop(spark, sf_dir):
    return R.stratified_share(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 60)


@query(
    "stratified_sample_equal",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS n FROM documents),
    k AS (SELECT count(DISTINCT lang) AS k FROM documents) SELECT doc_id, lang FROM r, k ORDER BY n > greatest(1, floor(50 / k)), md5('0:' || doc_id), doc_id LIMIT 50""",
)
def stratified_sample_equal(spark, sf_dir):
    return R.stratified_equal(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query("first_passing", "SELECT doc_id FROM documents WHERE n_chars > 1000 AND lang <> 'en' ORDER BY doc_id LIMIT 40")
def first_passing(spark, sf_dir):
    return R.first_passing(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), (F.col("n_chars") > 1000) & (F.col("lang") != "en"), ["doc_id"], 40).select("doc_id")


# ---- memo and resume ----


@query(
    "memo_join",
    """WITH d AS (SELECT doc_id, sha256(text || chr(0) || '--verify' || chr(0) || lang) AS key FROM documents), m AS (SELECT DISTINCT key, 0 AS returncode FROM d WHERE doc_id % 2 = 0)
    SELECT doc_id, key, coalesce(returncode, 1) AS returncode, returncode IS NULL AS missed FROM d LEFT JOIN m USING (key)""",
)
def memo_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.memo_key(F.col("text"), F.lit("--verify"), F.col("lang")).alias("key"))
    memo = docs.where("doc_id % 2 = 0").select("key", F.lit(0).alias("returncode")).distinct()
    out, _ = X.with_memo(docs, memo.withColumn("hit", F.lit(True)).select("key", "returncode"), "key", lambda d: d.withColumn("returncode", F.lit(1)), "returncode")
    return out.select("doc_id", "key", "returncode", (F.col("returncode") == 1).alias("missed"))


@query("resume_anti_join", "SELECT event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 10 = 0)")
def resume_anti_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sinks.pending(events, events.where("event_id % 10 = 0"), ["user_id", "event_type"]).select("event_id")


@query("upsert_rows", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sinks.upserted(old, old.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("untouched_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE false")
def untouched_rows(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0))
    return sinks.untouched(old, sinks.upserted(old, new, ["c_custkey"]), new, ["c_custkey"])


@query("training_pairs", "SELECT text AS prompt, lang AS completion FROM documents WHERE text <> ''")
def training_pairs(spark, sf_dir):
    return sinks.training_pairs(table(spark, sf_dir, "documents").select(F.lit("").alias("nl"), F.col("text").alias("docstring"), F.col("lang").alias("mlir")))


@query(
    "accepted_attempts",
    """WITH t AS (SELECT conv_id, turn, text, length(text) > 400 AS ok FROM conversations WHERE turn < 5)
    SELECT conv_id, coalesce(arg_min(text, turn) FILTER (ok), arg_max(text, turn)) AS text, coalesce(min(turn) FILTER (ok), max(turn)) + 1 AS attempts, bool_or(ok) AS accepted FROM t GROUP BY conv_id""",
)
def accepted_attempts(spark, sf_dir):
    return X.accepted_attempts(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length("text") > 400, "text")


@query("reproduced_texts", "SELECT count(*) AS n, count_if(a.text IS NOT DISTINCT FROM b.t) AS identical FROM documents a JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN lower(text) ELSE text END AS t FROM documents) b USING (doc_id)")
def reproduced_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.reproduced(docs, docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.lower("text")).otherwise(F.col("text"))), "doc_id", "text")


@query(
    "captured_errors",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN 100.0 / (s_suppkey % 5) END AS share, CASE WHEN s_suppkey % 5 = 0 THEN 'ZeroDivisionError: division by zero' END AS error FROM supplier",
)
def captured_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    return X.captured(rows, lambda r: {"share": 100 / (r["s_suppkey"] % 5)}, "share double", ["s_suppkey"])


# ---- text ----

CONV = "SELECT conv_id, turn, text FROM conversations"
MESSAGES = [
    "use of value '%0' expects different type than prior uses", "error: type mismatch for operand", "op has 3 operands but expected 2",
    "unregistered operation 'foo.bar' found", "error: expected ':' here", "block argument 0 has different type", "expected 2 operands", "", "all fine", "Parse Error near x",
]


@query(
    "error_category",
    "WITH m AS (SELECT conv_id, turn, ["
    + ", ".join("'" + m.replace("'", "''") + "'" for m in MESSAGES)
    + """][(conv_id + turn) % 10 + 1] AS s FROM conversations)
    SELECT category, count(*) AS n FROM (SELECT CASE WHEN turn = 0 THEN 'passed' WHEN trim(s) = '' THEN 'other' """
    + " ".join(f"WHEN regexp_matches(s, '(?i)(?:{p.replace(chr(39), chr(39) * 2)})') THEN '{c}'" for c, p in text.ERROR_PATTERNS.items())
    + " ELSE 'other' END AS category FROM m) GROUP BY category",
)
def error_category(spark, sf_dir):
    messages = F.array(*map(F.lit, MESSAGES))
    s = F.element_at(messages, ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(text.row_category(F.col("turn") == 0, s).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


@query(
    "file_family",
    "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(f), '{x}') THEN '{x}'" for x in text.FAMILIES)
    + " ELSE 'other' END AS family FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '001_EW_BIN_add' WHEN 1 THEN '002_dot_general_x' WHEN 2 THEN '003_slice' ELSE p_name END AS f FROM part)",
)
def file_family(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "001_EW_BIN_add").when(k == 1, "002_dot_general_x").when(k == 2, "003_slice").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.family(name).alias("family"))


@query(
    "split_cases",
    r"""WITH d AS (SELECT doc_id, '// RUN: tool' || chr(10) || replace(text, '. ', '.' || chr(10) || '// -----' || chr(10) || '// CHECK-NEXT: x' || chr(10)) AS t FROM documents),
    s AS (SELECT doc_id, regexp_split_to_array(t, '(?m)^\s*//\s*-----\s*$') AS parts FROM d),
    c AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: regexp_replace(array_to_string(list_filter(string_split(p, chr(10)),
      lambda l: NOT regexp_matches(l, '//\s*RUN:') AND NOT regexp_matches(trim(l), '^//\s*(?:CHECK|CHECK-LABEL|CHECK-NEXT|CHECK-SAME)[-:]')), chr(10)), '^\s+|\s+$', '', 'g') || chr(10)), lambda x: trim(x, chr(10) || ' ') <> '') AS cs FROM s)
    SELECT doc_id, len(cs) AS n, coalesce(cs[1], '') AS first_case, coalesce(cs[-1], '') AS last_case FROM c""",
)
def split_cases(spark, sf_dir):
    t = F.concat(F.lit("// RUN: tool\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n// -----\n// CHECK-NEXT: x\n")))
    found = table(spark, sf_dir, "documents").select("doc_id", text.cases(t).alias("c"))
    return found.select("doc_id", F.size("c").cast("long").alias("n"), F.coalesce(F.get("c", F.lit(0)), F.lit("")).alias("first_case"), F.coalesce(F.get("c", F.size("c") - 1), F.lit("")).alias("last_case"))


@query(
    "check_hints",
    r"""SELECT doc_id, [trim(regexp_extract(l, '^//\s*(?:CHECK|CHECK-LABEL|CHECK-NEXT|CHECK-SAME)[-:](.*)', 1)) for l in
      list_transform(string_split('// CHECK-LABEL: ' || lang || chr(10) || 'x' || chr(10) || '  // CHECK:   ' || source, chr(10)), lambda y: trim(y)) if regexp_matches(l, '^//\s*CHECK')] AS hints FROM documents""",
)
def check_hints(spark, sf_dir):
    t = F.concat(F.lit("// CHECK-LABEL: "), "lang", F.lit("\nx\n  // CHECK:   "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", text.check_hints(t).alias("hints"))


@query("namespaces_mentioned", r"SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '([a-z_][a-z_0-9]*)\.[a-z_]', 1))) AS names FROM pages")
def namespaces_mentioned(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.namespaces(F.col("html")).alias("names"))


@query("target_namespaces", r"SELECT page_id FROM pages WHERE list_has_any(regexp_extract_all(html, '([a-z_][a-z_0-9]*)\.[a-z_]', 1), ['blog', 'm'])")
def target_namespaces(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.arrays_overlap(text.namespaces(F.col("html")), F.array(F.lit("blog"), F.lit("m")))).select("page_id")


@query(
    "path_description",
    r"""SELECT page_id, array_to_string(list_concat(list_filter(string_split(lower(p), '/'), lambda x: x IN ('arith', 'func', 'linalg', 'memref', 'scf', 'affine')),
      [translate(regexp_replace(string_split(p, '/')[-1], '(.)\.[^.]*$', '\1'), '_-', '  ')]), ' ') AS description
    FROM (SELECT page_id, 'test/' || CASE page_id % 3 WHEN 0 THEN 'Arith' WHEN 1 THEN 'Linalg/Func' ELSE 'Other' END || '/fold_' || page_id || '-ops.mlir' AS p FROM pages)""",
)
def path_description(spark, sf_dir):
    k = F.col("page_id") % 3
    p = F.concat(F.lit("test/"), F.when(k == 0, "Arith").when(k == 1, "Linalg/Func").otherwise("Other"), F.lit("/fold_"), "page_id", F.lit("-ops.mlir"))
    return table(spark, sf_dir, "pages").select("page_id", text.path_description(p).alias("description"))


@query(
    "fence_extract",
    r"""SELECT conv_id, turn, CASE WHEN contains(t, '```') THEN regexp_replace(regexp_extract(t, '(?s)```(?:mlir|llvm|c)?\n?(.*?)(?:```|\z)', 1), '^\s+|\s+$', '', 'g')
      WHEN instr(t, 'module {') > 0 THEN substr(t, instr(t, 'module {')) ELSE t END AS body
    FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Sure: ```mlir' || chr(10) || text || chr(10) || '``` done' WHEN 1 THEN 'Here module { ' || text || ' }' WHEN 2 THEN '```' || text ELSE text END AS t FROM conversations)""",
)
def fence_extract(spark, sf_dir):
    k = F.col("turn") % 4
    t = (
        F.when(k == 0, F.concat(F.lit("Sure: ```mlir\n"), "text", F.lit("\n``` done"))).when(k == 1, F.concat(F.lit("Here module { "), "text", F.lit(" }")))
        .when(k == 2, F.concat(F.lit("```"), "text")).otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fence_body(t).alias("body"))


@query("operator_counts", r"SELECT page_id, regexp_extract(html, '<([a-z0-9]+)', 1) AS first_op, len(regexp_extract_all(html, '<([a-z0-9]+)')) AS ops, list_sort(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))) AS names FROM pages")
def operator_counts(spark, sf_dir):
    p = F.lit("<([a-z0-9]+)")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<([a-z0-9]+)", 1).alias("first_op"), F.regexp_count("html", p).cast("long").alias("ops"), F.array_sort(F.array_distinct(F.regexp_extract_all("html", p, F.lit(1)))).alias("names")
    )


SIGS = [
    "func.func @f(%a: i32, %b: memref<?x4xf32>) -> i32 {\n return %a : i32 }", "func.func private @g(%x: i32) {\n}\nfunc.func @h(%m: memref<8x4xf32>) {\n return }",
    "func.func @main() {\n return }", "func.func @k(%a) {\n}", "no function", "func.func @t(%a: tensor<4xf32>) -> (i32, i32) {\n}", "func.func @u(%m: memref<?x?xi8>) {\n}",
    "func.func @v(%m: memref<?x4xf32>) {\n return }",
]


def case_of(key, cases):
    """The number of the case that a row stands for."""
    return (F.col(key) % len(cases)).cast("int")


def part_cases(spark, sf_dir, cases, columns, key="p_partkey"):
    """Each part with one of the given cases, by its number."""
    rows = spark.createDataFrame([(k, *(c if isinstance(c, tuple) else (c,))) for k, c in enumerate(cases)], f"id int, {columns}")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", case_of(key, cases).alias("id")).join(F.broadcast(rows), "id")  # a literal of a few rows


def own_names(mlir, pattern=r"%([A-Za-z0-9_]+)", sign="%"):
    """Names of a program with the part's number at their ends."""
    return F.regexp_replace(mlir, F.lit(pattern), F.concat(F.lit(f"{sign}$1_"), F.col("p_partkey").cast("string")))


def part_signatures(spark, sf_dir, key="p_partkey"):
    rows = part_cases(spark, sf_dir, SIGS, "mlir string", key)
    return rows.withColumn("sig", text.signature(own_names(F.col("mlir"), r"@([a-z])(?=\()", "@")))


SIG_VALUES = """(VALUES (0, 'f', ['i32', 'memref<?x4xf32>'], 'i32', NULL), (1, 'h', ['memref<8x4xf32>'], '', NULL), (2, 'main', [], '', 'fn_named_main'), (3, NULL, NULL, NULL, 'no_public_fn'),
      (4, NULL, NULL, NULL, 'no_public_fn'), (5, 't', ['tensor<4xf32>'], '(i32,i32)', 'multi_result'), (6, 'u', ['memref<?x?xi8>'], '', 'unprintable_memref_dtype'), (7, 'v', ['memref<?x4xf32>'], '', NULL)) t(id, name, arg_types, ret, reason)"""


@query(
    "signatures",
    f"SELECT p_partkey, CASE WHEN name = 'main' THEN name ELSE name || '_' || p_partkey END AS name, arg_types, ret, reason FROM part JOIN {SIG_VALUES} ON id = p_partkey % 8",
)
def signatures(spark, sf_dir):
    return part_signatures(spark, sf_dir).select("p_partkey", "sig.name", "sig.arg_types", "sig.ret", text.exclusion(F.col("sig")).alias("reason"))


@query(
    "sig_compatible",  # of different ones only a candidate with an open dimension fits
    """SELECT p_partkey, g = c OR (g = 1 AND c = 7) AS compatible, g = 1 AND c = 7 AS relaxed FROM (SELECT p_partkey, p_partkey % 8 AS g, p_size % 8 AS c FROM part) WHERE g NOT IN (3, 4) AND c NOT IN (3, 4)""",
)
def sig_compatible(spark, sf_dir):
    gold = part_signatures(spark, sf_dir).select("p_partkey", F.col("sig").alias("g"))
    candidate = part_signatures(spark, sf_dir, "p_size").select("p_partkey", F.col("sig").alias("c"))
    both = gold.join(candidate, "p_partkey").where("g IS NOT NULL AND c IS NOT NULL")
    return both.withColumn("r", text.compatible(F.col("g"), F.col("c"))).select("p_partkey", "r.compatible", "r.relaxed")


@query(
    "tolerant_equal",
    """SELECT vec_id, bool_and(abs(x - y) <= 1e-5 + 1e-4 * greatest(abs(x), abs(y))) AS equal FROM (
      SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(embedding)::DOUBLE + (vec_id % 3) * 0.00004 AS y FROM embeddings) GROUP BY vec_id""",
)
def tolerant_equal(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    y = F.transform("embedding", lambda v: v.cast("double") + (F.col("vec_id") % 3) * 0.00004)
    return table(spark, sf_dir, "embeddings").select("vec_id", text.arrays_near(x, y).alias("equal"))


@query("derived_seeds", "SELECT doc_id, ('0x' || substr(sha256('e12c:' || source || ':' || doc_id), 1, 12))::BIGINT AS seed FROM documents")
def derived_seeds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.derived_seed(F.col("source"), F.col("doc_id")).alias("seed"))


@query("prefix_index", "SELECT p_partkey, try_cast(string_split(n, '_')[1] AS INT) - 1 AS idx FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE lpad(p_partkey::VARCHAR, 5, '0') || '_' || p_name END AS n FROM part)")
def prefix_index(spark, sf_dir):
    n = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("_"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.prefix_index(n).alias("idx"))


@query("parsed_numbers", r"SELECT event_id, [x::DOUBLE for x in regexp_extract_all(props, '-?\d+\.?\d*')] AS numbers FROM events")
def parsed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.numbers(F.col("props")).alias("numbers"))


@query("expected_output", "SELECT conv_id, turn, regexp_matches(text, '(?ms)^' || left(role, 1) || '|\\bthe\\b.*\\bof\\b') AS ok FROM conversations")
def expected_output(spark, sf_dir):
    rx = F.concat(F.lit("^"), F.left(F.col("role"), F.lit(1)), F.lit(r"|\bthe\b.*\bof\b"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.matches(F.col("text"), rx).alias("ok"))


@query("ssa_references", r"SELECT doc_id, regexp_extract_all(t, '%([A-Za-z0-9_]+)', 1) AS refs FROM (SELECT doc_id, '%a = op %b' || doc_id || ', %c : i32' AS t FROM documents)")
def ssa_references(spark, sf_dir):
    t = F.concat(F.lit("%a = op %b"), "doc_id", F.lit(", %c : i32"))
    return table(spark, sf_dir, "documents").select("doc_id", text.ssa_refs(t).alias("refs"))


# ---- programs ----

PROGRAMS = [
    "module {\n func.func @f(%a : i32, %b : i32) -> i32 {\n %0 = arith.addi %a , %b : i32\n return %0 : i32\n } }",
    "module {\n func.func @f(%a : i32) -> i32 {\n %0 = arith.addi %a , %z : i32\n return %0 : i32\n } }",
    "module {\n func.func @f(%a : f32) -> i32 {\n %0 = arith.addi %a , %a : i32\n return %0 : i32\n } }",
    "func.func @f(%m : memref<4xf32>, %i : index) {\n %0 = memref.load %m[%i] : memref<4xf32>\n memref.store %0, %m[%i] : memref<4xf32>\n return }",
    "func.func @f(%v : i32, %m : memref<4xf32>) {\n linalg.fill ins(%v : i32) outs(%m : memref<4xf32>)\n return }",
    "func.func @f(%a : tensor<2xf32>) -> tensor<2xf32> {\n %0 = stablehlo.add %a,\n  %a : tensor<2xf32>\n return %0 : tensor<2xf32> }",
    "no function at all",
]


EXPECTED = ", ".join(f"({k}, '{family}', '{kinds}')" for k, (family, _, kinds) in enumerate(SCOPES))
SCOPED = f"(SELECT p_partkey, family, kinds FROM part JOIN (VALUES {EXPECTED}) t(id, family, kinds) ON id = p_partkey % {len(SCOPES)})"


def scoped(spark, sf_dir):
    """A program of each part, with names of its own, and its report."""
    rows = part_cases(spark, sf_dir, [(family, mlir) for family, mlir, _ in SCOPES], "family string, mlir string")
    return rows.withColumn("r", programs.scope_validate(own_names(F.col("mlir"))))


@query(
    "scope_validate",
    f"SELECT p_partkey, family, kinds = '' AS passed, CASE WHEN kinds = '' THEN 0 ELSE 1 + length(kinds) - length(replace(kinds, ',', '')) END::INT AS violations, kinds FROM {SCOPED}",
)
def scope_validate(spark, sf_dir):
    rows = scoped(spark, sf_dir)
    return rows.select("p_partkey", "family", "r.passed", F.size("r.violations").alias("violations"), F.array_join(F.transform("r.violations", lambda v: v["kind"]), ",").alias("kinds"))


@query(
    "scope_corpus",  # a program for each document, of which one in seven uses an undefined name and one in five a wrong type
    """WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'i32' WHEN 'de' THEN 'i64' ELSE 'index' END AS t FROM documents)
    SELECT t AS type, count(*) AS n, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 <> 0) AS passed, count(*) FILTER (doc_id % 7 = 0) AS undefined, count(*) FILTER (doc_id % 5 = 0) AS mismatched FROM d GROUP BY t""",
)
def scope_corpus(spark, sf_dir):
    t = F.when(F.col("lang") == "en", "i32").when(F.col("lang") == "de", "i64").otherwise("index")
    name, other = F.when(F.col("doc_id") % 7 == 0, "%nowhere").otherwise("%b"), F.when(F.col("doc_id") % 5 == 0, "f32").otherwise(t)
    made = F.format_string("func.func @f(%%a : %s, %%b : %s) -> %s {\n %%0 = arith.addi %%a, %s : %s\n return %%0 : %s }", other, t, t, name, t, t)
    rows = table(spark, sf_dir, "documents").select(t.alias("type"), programs.scope_validate(made).alias("r"))
    found = lambda kind: F.count_if(F.exists("r.violations", lambda v: v["kind"] == kind))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if("r.passed").alias("passed"), found("undef_use").alias("undefined"), found("type_mismatch").alias("mismatched"))


@query("violation_histogram", f"SELECT kind, count(*) AS n FROM (SELECT unnest(string_split(kinds, ',')) AS kind FROM {SCOPED} WHERE kinds <> '') GROUP BY kind")
def violation_histogram(spark, sf_dir):
    return A.histogram(scoped(spark, sf_dir).select("r.violations"), "violations", F.col("item.kind"))


#: Programs, and whether the generation grammar, which has spaces around its commas, accepts them.
ACCEPTED = [
    (PROGRAMS[1], True), (PROGRAMS[2], True), (PROGRAMS[0], False), (PROGRAMS[0].replace("i32, %b", "i32 , %b"), True), (PROGRAMS[3], False), (PROGRAMS[6], False), ("", False),
    (PROGRAMS[1].replace("addi", "addq"), False), (PROGRAMS[1].replace(" }", "", 1), False), (PROGRAMS[1].replace(": i32\n return", ": f32\n return"), False),
]


@query("grammar_accepts", "SELECT p_partkey, accepted FROM part JOIN (VALUES " + ", ".join(f"({k}, {str(ok).lower()})" for k, (_, ok) in enumerate(ACCEPTED)) + f") t(id, accepted) ON id = p_partkey % {len(ACCEPTED)}")
def grammar_accepts(spark, sf_dir):
    rows = part_cases(spark, sf_dir, [x for x, _ in ACCEPTED], "mlir string")
    return rows.select("p_partkey", grammar.accepts(own_names(F.col("mlir"), r"%([a-z])", "%")).alias("accepted"))


@query(
    "program_parts",
    r"""SELECT p_partkey, replace(replace(body, '\n', chr(10)), '@f(', '@f_' || p_partkey || '(') AS body, functions, lines FROM part JOIN (VALUES
      (0, 'func.func @f(%a : i32, %b : i32) -> i32 {\n %0 = arith.addi %a , %b : i32\n return %0 : i32\n }', 1, 2), (1, 'func.func @f(%a : i32) -> i32 {\n %0 = arith.addi %a , %z : i32\n return %0 : i32\n }', 1, 2),
      (2, 'func.func @f(%a : f32) -> i32 {\n %0 = arith.addi %a , %a : i32\n return %0 : i32\n }', 1, 2),
      (3, 'func.func @f(%m : memref<4xf32>, %i : index) {\n %0 = memref.load %m[%i] : memref<4xf32>\n memref.store %0, %m[%i] : memref<4xf32>\n return }', 1, 3),
      (4, 'func.func @f(%v : i32, %m : memref<4xf32>) {\n linalg.fill ins(%v : i32) outs(%m : memref<4xf32>)\n return }', 1, 2),
      (5, 'func.func @f(%a : tensor<2xf32>) -> tensor<2xf32> {\n %0 = stablehlo.add %a,\n  %a : tensor<2xf32>\n return %0 : tensor<2xf32> }', 1, 2), (6, 'no function at all', 0, 0)) t(id, body, functions, lines) ON id = p_partkey % 7""",
)
def program_parts(spark, sf_dir):
    mlir = own_names(F.col("mlir"), r"@(f)(?=\()", "@")
    rows = part_cases(spark, sf_dir, PROGRAMS, "mlir string").select("p_partkey", programs.body_of(mlir).alias("body"), programs.function_bodies(mlir).alias("functions"))
    return rows.select("p_partkey", "body", F.size("functions").alias("functions"), F.size(programs.lines_of(F.coalesce(F.get("functions", F.lit(0))["body"], F.lit("")))).alias("lines"))


SCHEMA = """def Arith_AddIOp : Arith_IntBinaryOp<"addi", [Commutative, SameOperandsAndResultType]> {
  let summary = "integer addition"; // note
  let arguments = (ins SignlessIntegerLike:$lhs, SignlessIntegerLike:$rhs, I32Attr:$flags);
  let results = (outs SignlessIntegerLike:$result);
}
def Func_CallOp : Func_Op<"call"> {
  let description = [{ calls a function }];
  let arguments = (ins FlatSymbolRefAttr:$callee, Variadic<AnyType>:$operands);
  let results = (outs Variadic<AnyType>:$results);
}
def MemRef_LoadOp : MemRef_Op<"load", [SameOperandsType]> {
  let arguments = (ins MemRefOf<[AnyType]>:$memref, Variadic<Index>:$indices);
  let results = (outs AnyType:$result);
}
"""


def schema_ops(spark, sf_dir):
    """Operators of a schema text for each supplier, which its number names."""
    body = F.regexp_replace(F.lit(SCHEMA), F.lit('_Op<"([a-z]+)"|BinaryOp<"([a-z]+)"'), F.concat(F.lit('_Op<"$1$2_'), F.col("s_suppkey").cast("string"), F.lit('"')))
    return readers.schema_texts(table(spark, sf_dir, "supplier").select(F.format_string("ops-%d.td", "s_suppkey").alias("path"), body.alias("text")))


@query(
    "schema_records",
    """SELECT full_name || '_' || s_suppkey AS full_name, 'ops-' || s_suppkey || '.td' AS source_file, summary, description, signature, traits FROM supplier, (VALUES
      ('arith.addi', 'integer addition', '', 'SignlessIntegerLike:$lhs, SignlessIntegerLike:$rhs, I32Attr:$flags', ['Commutative', 'SameOperandsAndResultType']),
      ('func.call', '', 'calls a function', 'FlatSymbolRefAttr:$callee, AnyType:$operands', []), ('memref.load', '', '', 'MemRefOf<[AnyType]>:$memref, Index:$indices', ['SameOperandsType'])) t(full_name, summary, description, signature, traits)""",
)
def schema_records(spark, sf_dir):
    return schema_ops(spark, sf_dir).select("full_name", "source_file", "summary", "description", text.pretty_signature(F.col("arguments")).alias("signature"), "traits")


ENTRIES = """(WITH i AS (SELECT ['i1', 'i8', 'i16', 'i32', 'i64', 'i128', 'index'] AS i)
    SELECT 'arith.addi' AS full_name, 'arith' AS dialect, [i, i] AS operand_types, [i] AS result_types, [2, 2] AS operand_arity, [1, 1] AS result_arity, ['I32Attr'] AS attributes, [[0, 1, 2]] AS same_type_classes FROM i
    UNION ALL SELECT 'func.call', 'func', [['ANY']], [['ANY']], [0, 1000000], [0, 1000000], ['FlatSymbolRefAttr'], []::INT[][]
    UNION ALL SELECT 'memref.load', 'memref', [['memref'], ['index']], [['ANY']], [1, 1000000], [1, 1], []::VARCHAR[], [[0, 1]])"""


@query("lattice_entries", f"SELECT e.* REPLACE (full_name || '_' || s_suppkey AS full_name) FROM supplier, {ENTRIES} e")
def lattice_entries(spark, sf_dir):
    return lattice.entries(schema_ops(spark, sf_dir))


@query(
    "type_arity_check",
    """SELECT p_partkey, full_name, ok, after_i, CASE WHEN full_name <> 'x.y' THEN true END AS more_operands, CASE WHEN full_name <> 'x.y' THEN true END AS separators, CASE WHEN full_name <> 'x.y' THEN full_name LIKE 'func.call%' END AS may_end
    FROM (SELECT p_partkey, CASE WHEN f = 'x.y' THEN f ELSE f || '_' || (p_size % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier)) END AS full_name, ok, after_i FROM part JOIN (VALUES
      (0, 'arith.addi', true, ['1', '3', '6', '8', 'n']), (1, 'arith.addi', false, ['1', '3', '6', '8', 'n']), (2, 'arith.addi', false, ['1', '3', '6', '8', 'n']),
      (3, 'x.y', true, NULL), (4, 'func.call', true, ['1', '3', '6', '8', 'n'])) t(id, f, ok, after_i) ON id = p_partkey % 5)""",
)
def type_arity_check(spark, sf_dir):
    cases = [("arith.addi", "%0 = arith.addi %a, %b : i32"), ("arith.addi", "%0 = arith.addi %a, %b : f32"), ("arith.addi", "no colon"), ("x.y", "%0 = x.y"), ("func.call", "call : anything")]
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*").alias("suppliers"), F.min("s_suppkey").alias("least"))
    own = F.concat("name", F.lit("_"), (F.col("least") + F.col("p_size") % F.col("suppliers")).cast("string"))
    texts = part_cases(spark, sf_dir, cases, "name string, text string").crossJoin(F.broadcast(suppliers)).withColumn("full_name", F.when(F.col("name") == "x.y", "x.y").otherwise(own))  # one row
    entry = lattice.entries(schema_ops(spark, sf_dir)).select("full_name", "operand_types", "result_types", "operand_arity")
    rows = texts.join(entry, "full_name", "left")
    state = lattice.arity_state(F.lit(1), F.col("operand_arity"))
    return rows.select(
        "p_partkey", "full_name", lattice.admits(F.col("text"), F.col("operand_types"), F.col("result_types")).alias("ok"),
        lattice.next_characters(F.get("operand_types", F.lit(0)), F.lit("i")).alias("after_i"),
        state["operand"].alias("more_operands"), state["separator"].alias("separators"), state["end"].alias("may_end"),
    )


@query(
    "schema_dump",
    """SELECT 'arith' AS dialect, 'addi' || s_suppkey AS mnemonic, 'arith.addi' || s_suppkey AS full_name, s_name AS summary, '' AS description,
      ['I32 lhs false false', 'I32 rest false true', 'I32Attr flag true false'] AS arguments, ['I32 result false false'] AS results, ['Pure'] AS traits FROM supplier""",
)
def schema_dump(spark, sf_dir):
    """One dump, as the dumping tool writes it, with an operator for each supplier."""
    kinds = """"!instanceof": {}, "__x": 1, "Arith_Dialect": {"name": "arith", "!superclasses": ["Dialect"]}, "I32": {"!superclasses": ["Type"]}, "I32Attr": {"!superclasses": ["Attr"]},
      "anonymous_1": {"!superclasses": ["Variadic"], "baseType": {"def": "I32"}}"""
    op = F.format_string(
        """"Arith_AddIOp%d": {"!superclasses": ["Op", "Arith_Op"], "opName": "addi%d", "opDialect": {"def": "Arith_Dialect"}, "summary": "%s", "description": null,
        "arguments": {"args": [[{"def": "I32"}, "lhs"], [{"def": "anonymous_1"}, "rest"], [{"def": "I32Attr"}, "flag"]]}, "results": {"args": [[{"def": "I32"}, "result"]]}, "traits": [{"def": "Pure"}]}""",
        "s_suppkey", "s_suppkey", "s_name",
    )
    dump = table(spark, sf_dir, "supplier").agg(F.concat(F.lit("{" + kinds + ", "), F.array_join(F.array_sort(F.collect_list(op)), ", "), F.lit("}")).alias("value"))  # a dump is one text
    slot = lambda x: F.concat_ws(" ", x["type_constraint"], x["name"], x["is_attribute"].cast("string"), x["variadic"].cast("string"))
    return readers.schema_dump(dump).withColumns({c: F.transform(c, slot) for c in ("arguments", "results")})


@query(
    "generated_corpus",
    r"""WITH o AS (SELECT DISTINCT lower(replace(p_brand, 'Brand#', 'op')) AS op, 1 + replace(p_brand, 'Brand#', '')::INT % 2 AS arity, replace(p_brand, 'Brand#', '')::INT % 3 = 0 AS float_only FROM part),
    t AS (SELECT ['f32', 'i32', 'f16', 'i64', 'bf16'][1 + r_regionkey] AS dtype FROM region), s AS (SELECT (n_nationkey + 1) || 'x8' AS shape FROM nation)
    SELECT op || '_' || dtype || '_' || shape AS id, 'module {' || chr(10) || '  func.func @f(%a: ' || y || CASE WHEN arity = 2 THEN ', %b: ' || y ELSE '' END || ') -> ' || y || ' {' || chr(10) || '    %0 = stablehlo.' || op || ' ' ||
      CASE WHEN arity = 2 THEN '%a, %b' ELSE '%a' END || ' : ' || y || chr(10) || '    return %0 : ' || y || chr(10) || '  }' || chr(10) || '}' AS mlir
    FROM (SELECT *, 'tensor<' || shape || 'x' || dtype || '>' AS y FROM o, t, s WHERE NOT float_only OR dtype LIKE 'f%')""",
)
def generated_corpus(spark, sf_dir):
    number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    ops = table(spark, sf_dir, "part").select(F.lower(F.replace("p_brand", F.lit("Brand#"), F.lit("op"))).alias("op"), (1 + number % 2).alias("arity"), (number % 3 == 0).alias("float_only")).distinct()
    types = table(spark, sf_dir, "region").select(F.element_at(F.array(*map(F.lit, ["f32", "i32", "f16", "i64", "bf16"])), F.col("r_regionkey") + 1).alias("dtype"))
    shapes = table(spark, sf_dir, "nation").select(F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit("x8")).alias("shape"))
    return X.corpus(ops, types, shapes).select("id", "mlir")


@query("trial_inputs")
def trial_inputs(spark, sf_dir):
    rows = part_signatures(spark, sf_dir).where("sig IS NOT NULL").where(text.exclusion(F.col("sig")).isNull()).withColumn("trial", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select("p_partkey", "trial", trials.inputs_of(F.col("sig.arg_types"), F.col("p_partkey").cast("string"), F.col("trial")).alias("inputs"))


PRINTED = ["3.5\nUnranked Memref base@ = 0x0 sizes = [2, 2] data = \n[[1, 2], \n [3, 4.00001]]\n0", "3.5\nUnranked Memref base@ = 0x0 sizes = [2, 2] data = [[1, 2], [3, 4]]", "nan", "2 inf"]


def printed(spark, sf_dir, key):
    """What each part's program printed: its size, then buffers, or no number at all."""
    rows = part_cases(spark, sf_dir, PRINTED, "printed string", key)
    return rows.select("p_partkey", trials.parsed_outputs(F.regexp_replace("printed", F.lit("^3.5"), F.concat(F.col("p_size").cast("string"), F.lit(".5")))).alias("out"))


@query(
    "printed_outputs",  # the first two print the same numbers but for 1e-5 in one; NaN equals itself, an infinity only without tolerance
    "SELECT p_partkey, (a < 2 AND b < 2) OR (a = 2 AND b = 2) AS equal, a = b AS identical FROM (SELECT p_partkey, p_partkey % 4 AS a, p_size % 4 AS b FROM part)",
)
def printed_outputs(spark, sf_dir):
    pairs = printed(spark, sf_dir, "p_partkey").withColumnRenamed("out", "x").join(printed(spark, sf_dir, "p_size").withColumnRenamed("out", "y"), "p_partkey")
    return pairs.select("p_partkey", trials.outputs_equal(F.col("x"), F.col("y")).alias("equal"), trials.outputs_equal(F.col("x"), F.col("y"), exact=True).alias("identical"))


TENSORS = ["4x8xf32", "4x?xf32", "f32"]


@query(
    "tensor_compatible",
    """SELECT p_partkey, compatible, relaxed FROM part JOIN (VALUES (0, 0, true, false), (0, 1, true, true), (0, 2, false, false), (1, 0, false, false), (1, 1, true, false), (1, 2, false, false),
      (2, 0, false, false), (2, 1, false, false), (2, 2, true, false)) t(gold, candidate, compatible, relaxed) ON gold = p_partkey % 3 AND candidate = p_size % 3""",
)
def tensor_compatible(spark, sf_dir):
    def sig(key):
        t = F.element_at(F.array(*map(F.lit, TENSORS)), case_of(key, TENSORS) + 1)
        return text.signature(F.format_string("func.func @f%d(%%a: tensor<%s>) -> tensor<%s> {", "p_partkey", t, t))

    rows = table(spark, sf_dir, "part").withColumn("r", text.compatible(sig("p_partkey"), sig("p_size"), text.tensor, relax_result=True))
    return rows.select("p_partkey", "r.compatible", "r.relaxed")


@query(
    "paired_strict",
    f"SELECT a.doc_id, a.passed AS flag_a, a.flagged AS flag_b FROM ({EVAL}) a WHERE a.doc_id % 2 = 0",
)
def paired_strict(spark, sf_dir):
    rows = eval_rows(spark, sf_dir)
    return S.paired_strict(rows.select("doc_id", F.col("passed").alias("flag")), rows.where("doc_id % 2 = 0").select("doc_id", F.col("flagged").alias("flag")), ["doc_id"], "flag")


# ---- statistics ----

DRAWS = """r AS (SELECT *, row_number() OVER (PARTITION BY dialect ORDER BY doc_id) - 1 AS r FROM e), n AS (SELECT dialect, count(*) AS n FROM e GROUP BY dialect),
  g AS (SELECT dialect, n, b, unnest(range(n)) AS j FROM n, range(200) t(b)),
  w AS (SELECT dialect, b, ('0x' || substr(md5(b || ':' || j), 1, 8))::BIGINT % n AS r FROM g),
  m AS (SELECT dialect, b, avg(p::DOUBLE) AS p, avg(q::DOUBLE) AS q FROM w JOIN r USING (dialect, r) GROUP BY dialect, b)"""
FLAGS = f"e AS (SELECT dialect, doc_id, passed::INT AS p, (n_chars > 700)::INT AS q FROM ({EVAL}))"


def flags(spark, sf_dir):
    """Both sides of the join are shuffled: labels, a few bytes a row in their file, are else broadcast from the driver by the million."""
    return eval_rows(spark, sf_dir, "merge").select("dialect", "doc_id", F.col("passed").cast("int").alias("p"), (F.col("n_chars") > 700).cast("int").alias("q"))


@query("hash_bootstrap_ci", f"WITH {FLAGS}, {DRAWS} SELECT dialect, quantile_cont(p, 0.025) AS ci_low, quantile_cont(p, 0.975) AS ci_high, avg((p <= 0)::INT::DOUBLE) AS p_value FROM m GROUP BY dialect")
def hash_bootstrap_ci(spark, sf_dir):
    return S.interval(S.hash_bootstrap(flags(spark, sf_dir), ["dialect"], ["p"], "doc_id"), ["dialect"], F.col("mean_p"))


@query(
    "hash_bootstrap_paired",
    f"""WITH {FLAGS}, {DRAWS}, c AS (SELECT dialect, quantile_cont(p - q, 0.025) AS ci_low, quantile_cont(p - q, 0.975) AS ci_high, avg((p - q <= 0)::INT::DOUBLE) AS p_value FROM m GROUP BY dialect),
    o AS (SELECT dialect, avg(p::DOUBLE) - avg(q::DOUBLE) AS point FROM e GROUP BY dialect)
    SELECT dialect, point, ci_low, ci_high, p_value, point >= 0.10 AND ci_low > 0 AS clear_gain, abs(point) <= 0.03 AS within_margin, point < 0 AS halt FROM o JOIN c USING (dialect)""",
)
def hash_bootstrap_paired(spark, sf_dir):
    rows = flags(spark, sf_dir)
    means = S.hash_bootstrap(rows, ["dialect"], ["p", "q"], "doc_id")
    point = rows.groupBy("dialect").agg((F.avg(F.col("p").cast("double")) - F.avg(F.col("q").cast("double"))).alias("point"))
    return S.decisions(point.join(S.interval(means, ["dialect"], F.col("mean_p") - F.col("mean_q")), "dialect"))


@query("order_stat_bootstrap", f"WITH {FLAGS}, {DRAWS}, s AS (SELECT dialect, list_sort(list(p)) AS v FROM m GROUP BY dialect) SELECT dialect, v[floor(0.025 * len(v))::INT + 1] AS low, v[floor(0.975 * len(v))::INT + 1] AS high FROM s")
def order_stat_bootstrap(spark, sf_dir):
    return S.order_interval(S.hash_bootstrap(flags(spark, sf_dir), ["dialect"], ["p"], "doc_id"), ["dialect"], F.col("mean_p"))


# numpy's draws are nothing SQL can express: tests compare these with the generator's own calls.
@query("numpy_bootstrap_ci")
def numpy_bootstrap_ci(spark, sf_dir):
    return S.bootstrap_cells(flags(spark, sf_dir), ["dialect"], "p", "doc_id", resamples=1000)


@query("numpy_bootstrap_paired")
def numpy_bootstrap_paired(spark, sf_dir):
    return S.paired_cells(flags(spark, sf_dir), ["dialect"], "p", "q", "doc_id", resamples=1000)


@query("binomial_bootstrap_ci")
def binomial_bootstrap_ci(spark, sf_dir):
    return S.binomial_cells(flags(spark, sf_dir).withColumn("p", F.col("p") == 1), ["dialect"], "p")


@query("mde", "SELECT n, CASE WHEN n > 0 THEN (1.9599639845400536 + 0.8416212335729144) * sqrt(0.5 / n) ELSE 'inf'::DOUBLE END AS effect FROM (SELECT count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 0)")
def mde(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("n").unionByName(spark.createDataFrame([(0,)], "n long"))
    return sizes.select("n", S.detectable_effect(F.col("n")).alias("effect"))


@query(
    "reversal_decision",
    f"""SELECT *, first - none < 0 AND second >= none AS reversal FROM (SELECT dialect, avg(passed::INT::DOUBLE) FILTER (seed = 0) AS none, avg(passed::INT::DOUBLE) FILTER (seed = 1) AS first,
    avg(passed::INT::DOUBLE) FILTER (seed = 2) AS second FROM ({EVAL}) GROUP BY dialect)""",
)
def reversal_decision(spark, sf_dir):
    at = lambda k, name: A.rate(F.when(F.col("seed") == k, F.col("passed"))).alias(name)
    rates = eval_rows(spark, sf_dir).groupBy("dialect").agg(at(0, "none"), at(1, "first"), at(2, "second"))
    return S.reversal(rates, ["dialect"], "none", "first", "second")


@query(
    "posted_vs_computed",
    "WITH p(lang, posted) AS (VALUES ('en', 1.0), ('xx', 2.0)) SELECT lang, computed, posted, round(computed, 6) IS NOT DISTINCT FROM round(posted, 6) AS agree FROM (SELECT lang, count(DISTINCT lang)::DOUBLE AS computed FROM documents GROUP BY lang) FULL JOIN p USING (lang)",
)
def posted_vs_computed(spark, sf_dir):
    computed = table(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct("lang").cast("double").alias("v"))
    return S.posted(computed, spark.createDataFrame([("en", 1.0), ("xx", 2.0)], "lang string, v double"), "lang", "v")


@query(
    "count_conservation",
    f"SELECT dialect, count(*) AS n, count_if(flagged) + count_if(NOT flagged AND passed) + count_if(NOT flagged AND NOT passed) = count(*) AS conserved FROM ({EVAL}) GROUP BY dialect",
)
def count_conservation(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("c", F.when(F.col("flagged"), "toxic").when(F.col("passed"), "clean").otherwise("low"))
    t = A.category_table(rows, ["dialect"], "c", ["clean", "toxic", "low"])
    return t.select("dialect", "n", (F.col("clean") + F.col("toxic") + F.col("low") == F.col("n")).alias("conserved"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return counts.windowed(table(spark, sf_dir, "events"), "ts", "event_type")


@query("running_totals", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM events")
def running_totals(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.sum("value").over(w).alias("running"))


# ---- guards, fallbacks, envelopes ----


@query(
    "non_trivial_guard",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE -3 END::INT AS returncode, CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'phase-F non-triviality check: no func.func definition in input' END AS stderr FROM documents""",
)
def non_trivial_guard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    program = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("module {\n func.func @f() {\n return } } // "), "lang")).when(F.col("doc_id") % 3 == 1, "module {}")
    return docs.select("doc_id", text.guarded(program, F.lit(0), F.lit("ok")).alias("v")).select("doc_id", "v.returncode", "v.stderr")


@query(
    "fallback_backend",
    """SELECT doc_id, coalesce(a, b) AS value, CASE WHEN a IS NOT NULL THEN 'first' ELSE 'second' END AS backend
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS a, CASE WHEN doc_id % 3 = 0 THEN lang END AS b FROM documents) WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def fallback_backend(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("value"))
    return X.with_fallback(first, docs.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("value")), ["doc_id"], "value", ("first", "second"))


@query(
    "interval_envelope",
    f"""WITH s AS (SELECT dialect, seed, avg(passed::INT::DOUBLE) AS p, count(*) AS n FROM ({EVAL}) GROUP BY dialect, seed), i AS (SELECT *, p - 1.96 * sqrt(p * (1 - p) / n) AS lo, p + 1.96 * sqrt(p * (1 - p) / n) AS hi FROM s)
    SELECT dialect, count(*) AS seeds, avg(p) AS mean, (max(p) - min(p)) / 2 AS half_range, min(lo) AS low, max(hi) AS high FROM i GROUP BY dialect""",
)
def interval_envelope(spark, sf_dir):
    each = eval_rows(spark, sf_dir).groupBy("dialect", "seed").agg(A.rate(F.col("passed")).alias("p"), F.count("*").alias("n"))
    spread = F.lit(1.96) * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return A.interval_envelope(each.withColumns({"ci_low": F.col("p") - spread, "ci_high": F.col("p") + spread}), ["dialect"], "p")


@query(
    "gate_failures",
    f"""WITH g AS (SELECT dialect, doc_id, CASE WHEN NOT passed AND flagged THEN 'both' WHEN NOT passed THEN 'quality' WHEN flagged THEN 'toxic' END AS reason FROM ({EVAL}))
    SELECT dialect, reason, count(*) AS n, list_slice(list_sort(list(doc_id)), 1, 10) AS first FROM g WHERE reason IS NOT NULL GROUP BY dialect, reason""",
)
def gate_failures(spark, sf_dir):
    reason = F.when(~F.col("passed") & F.col("flagged"), "both").when(~F.col("passed"), "quality").when(F.col("flagged"), "toxic")
    rows = eval_rows(spark, sf_dir).withColumn("reason", reason).withColumn("gate", F.when(F.col("reason").isNull(), "pass").otherwise("fail"))
    return A.gate_failures(rows, ["dialect"], "gate", "reason", "doc_id")


@query(
    "joined_concordance",
    """WITH a AS (SELECT doc_id, quality = 1 AS x FROM labels), b AS (SELECT doc_id, n_chars > 700 AS y, lang FROM documents WHERE doc_id % 4 <> 0), j AS (SELECT lang, x, y FROM a JOIN b USING (doc_id))
    SELECT lang, count(*) AS n, avg((x = y)::INT::DOUBLE) AS agreement, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b FROM j GROUP BY GROUPING SETS ((lang), ())""",
)
def joined_concordance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0")
    a = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("flag"))
    pairs = S.paired_strict(a, docs.select("doc_id", (F.col("n_chars") > 700).alias("flag")), ["doc_id"], "flag")
    return A.concordance(pairs.join(docs.select("doc_id", "lang"), "doc_id"), "lang", "flag_a", "flag_b")


@query("order_stat_paired")
def order_stat_paired(spark, sf_dir):
    return S.order_paired_cells(flags(spark, sf_dir), ["dialect"], "p", "q", "doc_id", resamples=1000)


# ---- sources and sinks: written into the shared folder, then read back ----


@query("json_lines_scan", "SELECT doc_id, quality, toxic FROM labels")
def json_lines_scan(spark, sf_dir):
    path = shared_folder(spark, "json-lines")
    table(spark, sf_dir, "labels").write.json(path)
    return readers.json_lines(spark, path, "doc_id long, quality int, toxic int")


@query("json_lines_tolerant", "SELECT doc_id, quality, toxic FROM labels")
def json_lines_tolerant(spark, sf_dir):
    path = shared_folder(spark, "json-broken")
    line = table(spark, sf_dir, "labels").select(F.to_json(F.struct("doc_id", "quality", "toxic")).alias("value"), "doc_id")
    broken = line.where("doc_id % 5 = 0").select(F.expr("left(value, length(value) - 3)").alias("value"))
    line.select("value").unionByName(broken).unionByName(spark.createDataFrame([("",), ("not json",)], "value string")).write.text(path)
    return readers.json_lines(spark, path, "doc_id long, quality int, toxic int", tolerant=True)


@query("append_rows", "SELECT doc_id, quality FROM labels")
def append_rows(spark, sf_dir):
    path, rows = shared_folder(spark, "appended"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    for part in (0, 1):
        sinks.append(rows.where(F.col("doc_id") % 2 == part), path)
    return readers.json_lines(spark, path, "doc_id long, quality int")


@query("prompt_lines", "SELECT n_name AS prompt FROM nation")
def prompt_lines(spark, sf_dir):
    path = shared_folder(spark, "prompts")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.col("n_name").alias("prompt")))).otherwise(F.concat(F.lit("  "), "n_name"))
    table(spark, sf_dir, "nation").select(line.alias("value")).write.text(path)
    return readers.prompts(spark, path)


@query("documented_code", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'note ' || turn END AS docstring, 'x' AS code FROM conversations")
def documented_code(spark, sf_dir):
    path = shared_folder(spark, "code")
    docstring = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    rows = table(spark, sf_dir, "conversations")
    rows.select(F.concat_ws(":", "conv_id", "turn").alias("source"), docstring.alias("docstring"), F.concat(F.lit("note "), "turn").alias("comment"), F.lit("x").alias("code"), F.lit("u").alias("source_url")).write.json(path)
    return readers.documented_code(spark, path).select(*(F.split("source", ":")[k].cast("long").alias(n) for k, n in enumerate(("conv_id", "turn"))), "docstring", "code")


@query("text_tree", "SELECT n_nationkey AS k, n_name || chr(10) AS text FROM nation WHERE n_nationkey % 5 <> 0")
def text_tree(spark, sf_dir):
    path = shared_folder(spark, "tree")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).where("k % 5 <> 0").write.partitionBy("k").text(path)
    return readers.text_tree(spark, path, "*.txt").select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("int").alias("k"), "text")


@query("json_document", """SELECT '[' || string_agg('{"region":' || n_regionkey || ',"n":' || n || '}', ',' ORDER BY n_regionkey) || ']' AS document FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey)""")
def json_document(spark, sf_dir):
    return sinks.document(table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n")))


@query("lattice_by_dialect", f"SELECT dialect, full_name || '_' || s_suppkey AS full_name, len(operand_types)::INT AS operands FROM supplier, {ENTRIES}")
def lattice_by_dialect(spark, sf_dir):
    path = shared_folder(spark, "lattices")
    sinks.by_dialect(lattice.entries(schema_ops(spark, sf_dir)), path)
    entries = records.read_records(spark, path).select("file_name", F.explode(F.from_json("text", "map<string,struct<operand_types:array<array<string>>>>")).alias("full_name", "e"))
    return entries.select(F.regexp_replace("file_name", r"\.json$", "").alias("dialect"), "full_name", F.size("e.operand_types").alias("operands"))
