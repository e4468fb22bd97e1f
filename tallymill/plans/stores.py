"""Queries of sources and sinks: tables are written into the shared folder, and what is read back is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import validation
from tallymill.operators.numbering import global_number
from tallymill.plans.registry import query
from tallymill.session import shared_folder, table
from tallymill.sources import keyed, readers, records, sinks
from tallymill.streaming import ingest

# ---- numbers over whole tables, one record a file ----


@query("numbered_documents", "SELECT doc_id, row_number() OVER (ORDER BY lang, n_chars DESC, doc_id) AS number FROM documents")
def numbered_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return global_number(docs, ["lang", F.col("n_chars").desc(), "doc_id"], start=1).select("doc_id", "number")


@query(
    "numbered_record_files",
    """SELECT row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS idx, n || '_' || p_brand || '.json' AS file_name, n || '_' || p_brand AS id, p_partkey, p_size
    FROM (SELECT *, CASE WHEN k < 100000 THEN lpad(k::VARCHAR, 5, '0') ELSE k::VARCHAR END AS n FROM (SELECT *, row_number() OVER (ORDER BY p_size, p_partkey) AS k FROM part))""",
)
def numbered_record_files(spark, sf_dir):
    path = shared_folder(spark, "numbered")
    sinks.numbered_records(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), path, ["p_size", "p_partkey"], "p_brand", width=5)
    found = records.read_records(spark, path, "id string, p_partkey long, p_size int", numbered=True)
    return found.select("idx", "file_name", "id", "p_partkey", "p_size")


@query("record_directory", "SELECT row_number() OVER (ORDER BY 'n' || lpad(n_nationkey::VARCHAR, 3, '0')) - 1 AS idx, n_name AS id, n_regionkey::VARCHAR AS dialect FROM nation")
def record_directory(spark, sf_dir):
    path = shared_folder(spark, "records")
    rows = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(".json"))
    text = F.to_json(F.struct(F.col("n_name").alias("id"), F.col("n_regionkey").cast("string").alias("dialect")))
    records.write_records(rows.select(name.alias("f"), text.alias("r")), path, "f", "r")
    return readers.record_directory(spark, path).select("idx", "id", "dialect")


@query("entries_by_group", "SELECT p_brand, p_partkey::VARCHAR AS full_name, p_type, p_size FROM part")
def entries_by_group(spark, sf_dir):
    """A document of entries for each brand, read back entry by entry."""
    path = shared_folder(spark, "entries")
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dialect"), F.col("p_partkey").cast("string").alias("full_name"), "p_type", "p_size")
    sinks.by_dialect(parts, path)
    entries = records.read_records(spark, path).select("file_name", F.explode(F.from_json("text", "map<string,struct<p_type:string,p_size:int>>")).alias("full_name", "e"))
    return entries.select(F.regexp_replace("file_name", r"\.json$", "").alias("p_brand"), "full_name", "e.p_type", "e.p_size")


# ---- tables changed in place, files taken in once ----


def _keyed_documents(spark, sf_dir):
    """A keyed table of documents, changed by labels: labelled documents of every seventh number, and as many new keys."""
    path = shared_folder(spark, "keyed")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    keyed.create(docs, path, ["doc_id"], 64)
    labels = table(spark, sf_dir, "labels").where("doc_id % 7 = 0")
    new = labels.select("doc_id", F.lit("xx").alias("lang"), F.col("quality").cast("long").alias("n_chars"))
    new = new.unionByName(labels.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("new").alias("lang"), F.col("toxic").cast("long").alias("n_chars")))
    return path, new


@query(
    "upsert_buckets",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'xx' END AS lang, CASE WHEN l.doc_id IS NULL THEN n_chars ELSE quality END AS n_chars
    FROM documents d LEFT JOIN (SELECT * FROM labels WHERE doc_id % 7 = 0) l USING (doc_id) UNION ALL SELECT -1 - doc_id, 'new', toxic FROM labels WHERE doc_id % 7 = 0""",
)
def upsert_buckets(spark, sf_dir):
    path, new = _keyed_documents(spark, sf_dir)
    keyed.upsert(new, path, ["doc_id"], 64)
    return keyed.read(spark, path)


@query(
    "upsert_one_bucket",
    """SELECT doc_id, CASE WHEN doc_id = k THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id = k THEN 0 ELSE n_chars END AS n_chars, 1 AS rewritten, 1 AS altered
    FROM documents, (SELECT max(doc_id) AS k FROM labels)""",
)
def upsert_one_bucket(spark, sf_dir):
    """One changed key rewrites the files of one bucket of 64."""
    path, _ = _keyed_documents(spark, sf_dir)
    before = spark.createDataFrame(keyed.fingerprints(spark, path).collect(), "bucket int, file string, digest string")  # 64 files
    key = table(spark, sf_dir, "labels").agg(F.max("doc_id").alias("doc_id"))
    touched = keyed.upsert(key.select("doc_id", F.lit("xx").alias("lang"), F.lit(0).cast("long").alias("n_chars")), path, ["doc_id"], 64)
    changed = keyed.altered(before, keyed.fingerprints(spark, path)).count()
    return keyed.read(spark, path).withColumn("rewritten", F.lit(len(touched))).withColumn("altered", F.lit(changed))


class Stopped(Exception):
    """An injected crash."""


@query("ingested_events", "SELECT event_id, user_id, event_type, value FROM events")
def ingested_events(spark, sf_dir):
    """Files of events taken in by a stream that is stopped after it wrote a batch and before that batch was committed, then started again."""
    folder = shared_folder(spark, "ingest")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events.repartition(6).write.json(f"{folder}/source")
    schema = events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def crash(batch: int) -> None:
        if batch == 1:
            raise Stopped

    for after in (crash, None):
        try:
            ingest.ingest(spark, f"{folder}/source", f"{folder}/target", f"{folder}/checkpoint", schema, files=2, after=after)
        except Exception as e:
            if after is None or "Stopped" not in str(e):
                raise
    return ingest.ingested(spark, f"{folder}/target")


@query("ingested_keys", "SELECT user_id, event_type FROM events GROUP BY ALL")
def ingested_keys(spark, sf_dir):
    """Two runs over a growing folder; of repeated keys the first batch's row stays."""
    folder = shared_folder(spark, "ingest")
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    for part in (0, 1):
        events.where(F.col("user_id") % 2 <= part).coalesce(3).write.mode("append").json(f"{folder}/source")
        ingest.ingest(spark, f"{folder}/source", f"{folder}/target", f"{folder}/checkpoint", "user_id long, event_type string", keys=["user_id", "event_type"], files=2)
    return ingest.ingested(spark, f"{folder}/target")


# ---- rules as data ----

#: Rules of a document: field, kind, values, detail.
DOCUMENT_RULES = [
    ("text", "required", None, "missing"), ("lang", "required", None, "missing"), ("lang", "enum", ["en", "de", "fr"], "unknown language"),
    ("text", "length", ["100", "4000"], "too short or too long"), ("text", "pattern", [r"^[A-Z]"], "no capital in front"), ("n_chars", "number", ["", "3000"], "too many"), ("source", "pattern", ["^src[0-9]+$"], "no source"),
]


@query(
    "rule_errors",
    """SELECT doc_id, e.field AS field, e.detail AS detail FROM (SELECT doc_id, unnest(CASE WHEN text IS NULL OR lang IS NULL THEN list_filter([
      CASE WHEN lang IS NULL THEN {'field': 'lang', 'detail': 'missing'} END, CASE WHEN text IS NULL THEN {'field': 'text', 'detail': 'missing'} END], lambda x: x IS NOT NULL) ELSE list_filter([
      CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN {'field': 'lang', 'detail': 'unknown language'} END, CASE WHEN n_chars > 3000 THEN {'field': 'n_chars', 'detail': 'too many'} END,
      CASE WHEN NOT regexp_matches(source, '^src[0-9]+$') THEN {'field': 'source', 'detail': 'no source'} END,
      CASE WHEN length(text) NOT BETWEEN 100 AND 4000 THEN {'field': 'text', 'detail': 'too short or too long'} END,
      CASE WHEN NOT regexp_matches(text, '^[A-Z]') THEN {'field': 'text', 'detail': 'no capital in front'} END], lambda x: x IS NOT NULL) END) AS e
      FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text, lang, source, n_chars FROM documents))""",
)
def rule_errors(spark, sf_dir):
    """Rules from a table; every thirteenth document lacks its text and is asked nothing else."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 13 > 0, F.col("text")))
    rules = validation.rules_of(spark.createDataFrame(DOCUMENT_RULES, "field string, kind string, values array<string>, detail string"))
    return validation.validated(docs, rules, ["doc_id"])


RECORD_RULES = [
    validation.Rule("id", "required", (), "missing"), validation.Rule("dialect", "required", (), "missing"), validation.Rule("difficulty", "enum", ("easy", "hard"), "unknown"),
    validation.Rule("id", "file", (), "not the file's name"), validation.Rule("dialect", "known", ("arith", "func"), "unknown dialect"), validation.Rule("dialect", "mentioned", ("mlir",), "not in the text"),
]


@query(
    "folder_errors",
    """SELECT file_name, e.field AS field, e.detail AS detail FROM (SELECT p_partkey || '.json' AS file_name, unnest(CASE
      WHEN p_partkey % 11 = 0 THEN [{'field': 'json', 'detail': 'not a record'}] WHEN p_partkey % 7 = 0 THEN [{'field': 'dialect', 'detail': 'missing'}] ELSE list_filter([
      CASE WHEN p_size > 20 AND p_size <= 40 THEN {'field': 'difficulty', 'detail': 'unknown'} END, CASE WHEN p_size % 5 = 0 THEN {'field': 'id', 'detail': 'not the file''s name'} END,
      CASE WHEN p_size % 3 = 0 THEN {'field': 'dialect', 'detail': 'unknown dialect'} END, CASE WHEN p_size % 4 = 0 THEN {'field': 'dialect', 'detail': 'not in the text'} END], lambda x: x IS NOT NULL) END) AS e FROM part)""",
)
def folder_errors(spark, sf_dir):
    """A written folder of records: broken ones, ones without a field, and all kinds of errors."""
    path, size, key = shared_folder(spark, "checked"), F.col("p_size"), F.col("p_partkey")
    record = F.struct(
        F.when(size % 5 == 0, F.lit("other")).otherwise(key.cast("string")).alias("id"),
        F.when(key % 7 > 0, F.when(size % 3 == 0, F.lit("arith + odd")).otherwise(F.lit("arith+func"))).alias("dialect"),
        F.when(size <= 20, F.lit("easy")).when(size <= 40, F.lit("strange")).when(size <= 45, F.lit("hard")).alias("difficulty"),
        F.when(size % 4 == 0, F.lit("%0 = math.sin %x")).otherwise(F.lit("%0 = arith.addi %x, %y")).alias("mlir"),
    )
    line = F.when(key % 11 == 0, F.lit('{"id": ')).otherwise(F.to_json(record))
    records.write_records(table(spark, sf_dir, "part").select(F.concat(key.cast("string"), F.lit(".json")).alias("f"), line.alias("r")), path, "f", "r")
    return validation.validate_folder(spark, path, "id string, dialect string, difficulty string, mlir string", RECORD_RULES)
