"""The registered queries of the training-data operators."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import functions as F

from tallymill.llm import chat_format, e8_neardup, exact_dedup, hd_language, packing, parity_join, sharding, site_tree, sort_means, token_align, token_files, trie_bpe, weak_quality
from tallymill.session import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def put(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_files")
def op1_token_files(spark, sf_dir):
    shards, _ = token_files.write(read(spark, sf_dir, "documents"), WORD_BPE, vocabulary=49_408, end_id=2)
    return token_files.read(shards)


@query("op10_trie_bpe")
def op10_trie_bpe(spark, sf_dir):
    return trie_bpe.digests(read(spark, sf_dir, "documents"), BYTE_BPE)


@query(
    "op4_exact_dedup",
    r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)""",
)
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(read(spark, sf_dir, "documents"))


@query("op6_retrieval_packing")
def op6_retrieval_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)


@query(
    "op2_chat_format",
    r"""WITH c AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    g AS (SELECT conv_id, count(*) AS n_turns,
      string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
      sum(20 + length(role) + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
      sha256(loss) AS loss_sha256, formatted_chars FROM g""",
)
def op2_chat_format(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nasty = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", nasty), (-7, 1, "assistant", nasty)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_chats(rows.unionByName(more)))


@query("op3_site_style_tree")
def op3_site_style_tree(spark, sf_dir):
    return site_tree.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_hd_language")
def op7_hd_language(spark, sf_dir):
    return hd_language.identify(read(spark, sf_dir, "documents"))


@query("op8_weak_quality")
def op8_weak_quality(spark, sf_dir):
    return weak_quality.score(read(spark, sf_dir, "documents"))


@query("op9_e8_neardup")
def op9_e8_neardup(spark, sf_dir):
    return e8_neardup.groups(read(spark, sf_dir, "embeddings"))


@query("op5_parity_join")
def op5_parity_join(spark, sf_dir):
    return parity_join.groups(read(spark, sf_dir, "documents"))


def _sort_means_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The rounds unrolled: every vector against every centroid by definition."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, [floor(1024 * x::DOUBLE)::HUGEINT for x in embedding] AS v FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.r, c.c,
        list_sum([(v.v[j] - c.v[j]) * (v.v[j] - c.v[j]) for j in range(1, {dim} + 1)])::HUGEINT AS d FROM v, c{i} c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (SELECT a.best.c AS c, j, sum(v.v[j])::HUGEINT AS s, count(*)::HUGEINT AS n
            FROM v JOIN a{i} a USING (r), range(1, {dim} + 1) t(j) GROUP BY ALL) GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
    sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.c = best.c"""


@query("op11_sort_means", _sort_means_sql())
def op11_sort_means(spark, sf_dir):
    return sort_means.clusters(read(spark, sf_dir, "embeddings"))


@query("op12_token_align")
def op12_token_align(spark, sf_dir):
    return token_align.alignments(read(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


@query("op13_label_shards")
def op13_label_shards(spark, sf_dir):
    return sharding.shards(read(spark, sf_dir, "documents"))
