"""The registered queries, their SQL, and the result rows that many of them share."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tallymill.session import ship, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir), with equivalent SQL where there is one."""

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


#: Result rows made of the tables at hand: a document is a prompt, its source a model, its language
#: a dialect, its number modulo 3 a seed, and its quality the verdict.
EVAL = """SELECT d.doc_id, d.text, d.lang AS dialect, d.source AS model, d.n_chars, d.doc_id % 3 AS seed,
  quality = 1 AS passed, toxic = 1 AS flagged FROM documents d JOIN labels l USING (doc_id)"""


def eval_rows(spark, sf_dir, hint=None):
    """The rows of ``EVAL``; a hint names the join, which else may send all labels through the driver."""
    flags = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("flagged"))
    flags = flags.hint(hint) if hint else flags
    docs = table(spark, sf_dir, "documents")
    return docs.join(flags, "doc_id").select("doc_id", "text", F.col("lang").alias("dialect"), F.col("source").alias("model"), "n_chars", (F.col("doc_id") % 3).alias("seed"), "passed", "flagged")
