"""Sources: JSON lines, record directories, nested documents, text trees and schema dumps, under explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.numbering import global_number

EVAL_ROW = (
    "model string, backend string, constraint string, dialect string, seed int, sample_idx int, prompt_id string, nl string, "
    "generated string, num_tokens int, parse_valid boolean, verify_valid boolean, passed boolean, verify_stderr string, "
    "verify_cached boolean, attempts int, scope_passed_per_try array<boolean>, dt double, pool string, source string, error string"
)
BENCHMARK = "id string, dialect string, difficulty string, nl string, mlir string, notes string, source string, op string"
_VALUE = "struct<type:string,value:double>"
_BUFFER = "name:string,shape:array<int>,dtype:string"
REFERENCE = (
    "references array<struct<id:string,dialect:string,source_benchmark:string,source_id:string,nl:string,canonical_fn_name:string,"
    f"canonical_signature:string,inputs:array<{_VALUE}>,result_type:string,expected_output:double,expected_stdout_regex:string,"
    f"scalar_inputs:array<{_VALUE}>,memref_inputs:array<struct<{_BUFFER},init:string,fill_value:double,static:boolean>>,"
    f"memref_print:array<struct<{_BUFFER}>>,iree_inputs:array<string>,expected_output_pattern:string>>"
)


def json_lines(spark: SparkSession, path: str, schema: str = EVAL_ROW, tolerant: bool = False, missing_ok: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are no rows.

    A bad line fails the read, or is left out if ``tolerant``.  ``missing_ok``: an absent path has no rows.
    """
    if missing_ok:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def record_directory(spark: SparkSession, path: str, schema: str = BENCHMARK) -> DataFrame:
    """One record a file, from any store that Spark reads; ``idx`` counts files in order of their names, from 0, whatever their number."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    return global_number(rows, ["file_name"], "idx")


def references(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the ``references`` of one nested document."""
    return spark.read.schema(REFERENCE).option("multiLine", True).json(path).select(F.explode("references").alias("r")).select("r.*")


def text_tree(spark: SparkSession, root: str, pattern: str = "*.mlir", barred: str = "invalid") -> DataFrame:
    """Path and text of all files below ``root`` by pattern, without names that hold ``barred`` and without texts that are not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(~F.lower(name).contains(barred)) if barred else files
    return kept.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"))


def documented_code(spark: SparkSession, path: str) -> DataFrame:
    """code and docstring of JSON lines, where ``comment`` stands in for an empty docstring."""
    rows = json_lines(spark, path, "source string, docstring string, comment string, code string, source_url string")
    text = F.coalesce(F.nullif("docstring", F.lit("")), "comment", F.lit(""))
    return rows.select("source", text.alias("docstring"), "code", "source_url")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts, one a line: JSON objects with ``prompt``, or the text itself."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line != "")
    return rows.select(F.when(line.startswith("{"), F.get_json_object(line, "$.prompt")).otherwise(line).alias("prompt"))


def record_objects(json: DataFrame, column: str = "value") -> DataFrame:
    """name and record (as JSON text) of an object of records, without names that start with ``!`` or ``__``."""
    rows = json.select(F.explode(F.from_json(column, "map<string,string>")).alias("name", "record"))
    return rows.where(~F.col("name").startswith("!") & ~F.col("name").startswith("__"))


def schema_dump(json: DataFrame, column: str = "value") -> DataFrame:
    """Operators of a schema dump: dialect, mnemonic, full_name, summary, description, arguments, results, traits.

    Constraints that name a variadic record or an attribute are found by joins on the record name.
    """
    rows = record_objects(json, column)
    field = lambda p: F.get_json_object("record", p)
    supers = F.coalesce(F.from_json(field("$['!superclasses']"), "array<string>"), F.expr("cast(array() AS array<string>)"))
    rows = rows.withColumn("supers", supers)
    is_op = F.exists("supers", lambda s: (s == "Op") | s.startswith("Op<"))
    ops = rows.where(is_op & (F.coalesce(field("$.opName"), F.lit("")) != ""))
    base = field("$.baseType.def")
    kinds = rows.select(
        F.col("name").alias("constraint"), F.exists("supers", lambda s: s.contains("Attr")).alias("is_attr"),
        (F.exists("supers", lambda s: s.contains("Variadic")) & base.isNotNull()).alias("is_variadic"), base.alias("base"),
    )
    slots = []
    for part in ("arguments", "results"):
        args = F.from_json(field(f"$.{part}.args"), "array<array<string>>")
        one = ops.select("name", F.lit(part).alias("part"), F.posexplode(args).alias("pos", "arg"))
        one = one.withColumn("constraint", F.coalesce(F.get_json_object(F.col("arg")[0], "$.def"), F.col("arg")[0])).withColumn("slot", F.col("arg")[1])
        slots.append(one.select("name", "part", "pos", "constraint", "slot"))
    found = slots[0].unionByName(slots[1]).join(kinds, "constraint", "left")
    real = F.when(F.col("is_variadic"), F.col("base")).otherwise(F.col("constraint"))
    inner = kinds.select(F.col("constraint").alias("real"), F.col("is_attr").alias("real_attr"))
    found = found.withColumn("real", real).join(inner, "real", "left")
    one = F.struct("pos", F.struct(F.col("real").alias("type_constraint"), F.col("slot").alias("name"), F.coalesce("real_attr", F.lit(False)).alias("is_attribute"), F.coalesce("is_variadic", F.lit(False)).alias("variadic")).alias("s"))
    each = found.groupBy("name").pivot("part", ["arguments", "results"]).agg(F.array_sort(F.collect_list(one)))
    dialects = rows.select(F.col("name").alias("dialect_def"), field("$.name").alias("dialect_name"))
    traits = F.from_json(field("$.traits"), "array<struct<def:string>>")
    head = ops.select(
        "name", field("$.opName").alias("mnemonic"), field("$.opDialect.def").alias("dialect_def"), F.trim(F.coalesce(field("$.summary"), F.lit(""))).alias("summary"),
        F.trim(F.coalesce(field("$.description"), F.lit(""))).alias("description"), F.transform(traits, lambda t: t["def"]).alias("traits"),
    )
    joined = head.join(dialects, "dialect_def", "left").join(each, "name", "left")
    fallback = F.regexp_replace(F.regexp_replace(F.lower("dialect_def"), "_dialect$", ""), "_", "")
    none = F.from_json(F.lit("[]"), "array<struct<pos:int,s:struct<type_constraint:string,name:string,is_attribute:boolean,variadic:boolean>>>")
    slots_of = lambda c: F.transform(F.coalesce(F.col(c), none), lambda x: x["s"]).alias(c)
    out = joined.withColumn("dialect", F.coalesce(F.nullif("dialect_name", F.lit("")), fallback)).where("dialect <> ''")
    return out.select("dialect", "mnemonic", F.concat_ws(".", "dialect", "mnemonic").alias("full_name"), "summary", "description", slots_of("arguments"), slots_of("results"), "traits")


def schema_texts(texts: DataFrame) -> DataFrame:
    """Operator records of schema source texts (path, text)."""
    from tallymill.functions import programs

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([r for p, t in zip(pdf["path"], pdf["text"]) for r in programs.schema_records(t or "", p or "")], columns=[x.split()[0] for x in programs.RECORD.split(", ")])

    return texts.select("path", "text").mapInPandas(run, programs.RECORD)
