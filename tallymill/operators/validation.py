"""Rules as data: a table of rules becomes one expression that lists a record's errors."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import text
from tallymill.sources.records import read_records


class Rule(NamedTuple):
    """One rule of a field.

    ``required``: the field is there.  ``enum``: one of the values.  ``pattern``: the regular expression of the first value
    matches somewhere.  ``length``: least and largest number of characters (an empty one: no bound).  ``number``: least and largest value.
    ``equals``: equal to another field.  ``file``: the record's file name without its ending.
    ``known``: the parts between ``+`` are all among the values.  ``mentioned``: a part between ``+`` is a namespace that the
    text of the field named by the first value mentions.
    """

    field: str
    kind: str
    values: tuple[str, ...] = ()
    detail: str = ""


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules of a table (field, kind, values, detail), a few rows, in a fixed order."""
    rows = table.select("field", "kind", "values", "detail").collect()
    return sorted(Rule(r.field, r.kind, tuple(r["values"] or ()), r.detail or "") for r in rows)


def _parts(c: Column) -> Column:
    return F.transform(F.split(c, r"\+"), lambda x: F.trim(x))


def _between(c: Column, values: tuple[str, ...]) -> Column:
    low, high = (*values, "", "")[:2]
    bounds = ([c >= float(low)] if low else []) + ([c <= float(high)] if high else [])
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def holds(rule: Rule, file_name: Column | None = None) -> Column:
    """Whether a present field keeps the rule; null where the field or what it is compared with is absent."""
    c, one = F.col(rule.field), (rule.values or ("",))[0]
    strings = F.array(*map(F.lit, rule.values)) if rule.values else F.array().cast("array<string>")
    if rule.kind == "required":
        return c.isNotNull()
    if rule.kind == "enum":
        return c.cast("string").isin(*rule.values)
    if rule.kind == "pattern":
        return c.cast("string").rlike(one)
    if rule.kind == "length":
        return _between(F.length(c.cast("string")), rule.values)
    if rule.kind == "number":
        return _between(c.cast("double"), rule.values)
    if rule.kind == "equals":
        return c.cast("string") == F.col(one).cast("string")
    if rule.kind == "file":
        if file_name is None:
            raise ValueError("a rule on the file's name needs the column of file names")
        return c.cast("string") == F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")
    if rule.kind == "known":
        return F.size(F.array_except(_parts(c), strings)) == 0
    if rule.kind == "mentioned":
        return F.arrays_overlap(_parts(c), text.namespaces(F.col(one)))
    raise ValueError(f"no such kind of rule: {rule.kind}")


def errors(rules: Iterable[Rule], file_name: Column | None = None, parsed: Column | None = None) -> Column:
    """field and detail of a record's errors, by the rules' order.

    A record that does not parse has that error alone; one that lacks a required field has the errors of its missing fields alone; else all other
    rules are asked.  A rule on an absent field, which no rule requires, is kept.
    """
    rules = list(rules)
    one = lambda r, c: F.when(~F.coalesce(c, F.lit(True)), F.struct(F.lit(r.field).alias("field"), F.lit(r.detail or r.kind).alias("detail")))
    listed = lambda rs: F.array_compact(F.array(*(one(r, holds(r, file_name)) for r in rs))) if rs else F.array().cast("array<struct<field:string,detail:string>>")
    missing, others = listed([r for r in rules if r.kind == "required"]), listed([r for r in rules if r.kind != "required"])
    found = F.when(F.size(missing) > 0, missing).otherwise(others)
    if parsed is None:
        return found
    return F.when(~F.coalesce(parsed, F.lit(False)), F.array(F.struct(F.lit("json").alias("field"), F.lit("not a record").alias("detail")))).otherwise(found)


def validated(df: DataFrame, rules: Iterable[Rule], keys: list[str], file_name: Column | None = None, parsed: Column | None = None) -> DataFrame:
    """keys, field, detail: a row an error."""
    return df.select(*keys, F.explode(errors(rules, file_name, parsed)).alias("e")).select(*keys, "e.field", "e.detail")


def validate_folder(spark: SparkSession, path: str, schema: str, rules: Iterable[Rule], pattern: str = "*.json") -> DataFrame:
    """file_name, field, detail of all errors of a folder of records, one a file."""
    rows = read_records(spark, path, schema, pattern)
    parsed = F.get_json_object("text", "$").startswith("{")
    return validated(rows, rules, ["file_name"], F.col("file_name"), parsed)


def summary(found: DataFrame) -> DataFrame:
    """field, detail, errors, records."""
    key = [c for c in found.columns if c not in ("field", "detail")]
    return found.groupBy("field", "detail").agg(F.count("*").alias("errors"), F.countDistinct(*key).alias("records"))
