"""Evaluation workflows over recorded outputs: attempts, cascades, memos, gates and generated corpora."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted_attempts(attempts: DataFrame, keys: Sequence[str], attempt: str, accepted: Column, value: str, most: int = 5) -> DataFrame:
    """Of recorded attempts the first accepted, else the last one: value, attempts used, whether accepted."""
    used = attempts.where(F.col(attempt) < most)
    first = F.min(F.when(accepted, F.struct(F.col(attempt).alias("a"), F.col(value).alias("v"))))
    last = F.max(F.struct(F.col(attempt).alias("a"), F.col(value).alias("v")))
    found = used.groupBy(*keys).agg(first.alias("_f"), last.alias("_l"))
    pick = F.coalesce("_f", "_l")
    return found.select(*keys, pick["v"].alias(value), (pick["a"] + 1).alias("attempts"), F.col("_f").isNotNull().alias("accepted"))


def cascade(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Each stage holds only if all before it do (null: it doesn't)."""
    ok: Column = F.lit(True)
    out = {}
    for s in stages:
        ok = ok & F.coalesce(F.col(s), F.lit(False))
        out[s] = ok
    return df.withColumns(out)


def with_memo(rows: DataFrame, memo: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], result: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``result`` from the memo, or computed once for each distinct missing key; and the new memo rows."""
    missing = rows.join(memo.select(key), key, "left_anti").dropDuplicates([key])
    fresh = compute(missing).select(key, result)
    return rows.join(memo.select(key, result).unionByName(fresh), key, "left"), fresh


def captured(df: DataFrame, f: Callable[[dict], dict], schema: str, inputs: Sequence[str]) -> DataFrame:
    """``f`` of each row; where it raises, its columns are null and ``error`` says why."""
    names = [x.strip().split()[0].strip("`") for x in schema.split(",")]
    kinds = dict(df.dtypes)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({**row, **f(row), "error": None})
                except Exception as e:  # noqa: BLE001  a failing row is a result
                    out.append({**row, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*inputs, *names, "error"])

    return df.select(*inputs).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in inputs), schema, "error string"]))


def gate_status(gates: DataFrame, candidates: DataFrame, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a gate: ``status``, matched trials and the first divergence.

    The first reason that holds: excluded, gate_fail, no_candidate, nl_mismatch, not_valid,
    incompatible, no_trials, match (all trials), mismatch.
    """
    from tallymill.operators.aggregates import trial_table

    done = trial_table(trials, keys, "trial", F.coalesce("match", F.lit(False)), "err")
    rows = gates.join(candidates, list(keys), "left").join(done, list(keys), "left")
    status = (
        F.when(F.col("gate") == "excluded", "excluded")
        .when(F.col("gate") == "fail", "gate_fail")
        .when(F.col("generated").isNull(), "no_candidate")
        .when(F.col("nl") != F.col("gate_nl"), "nl_mismatch")
        .when(~F.coalesce("verify_valid", F.lit(False)), "not_valid")
        .when(~F.coalesce("compatible", F.lit(False)), "incompatible")
        .when(F.col("trials").isNull(), "no_trials")
        .when(F.col("all_match"), "match")
        .otherwise("mismatch")
    )
    return rows.withColumn("status", status)


def reproduced(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """One row: shared keys, and how many have identical texts (null equals null)."""
    both = a.select(key, F.col(text).alias("_a")).join(b.select(key, F.col(text).alias("_b")), key)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("_a").eqNullSafe(F.col("_b"))).alias("identical"))


def corpus(operations: DataFrame, types: DataFrame, shapes: DataFrame, dialect: str = "stablehlo") -> DataFrame:
    """Programs of a sweep: op and arity times dtype times shape, without integers for ``float_only`` operations."""
    rows = operations.crossJoin(F.broadcast(types)).crossJoin(F.broadcast(shapes)).where(~F.col("float_only") | F.col("dtype").startswith("f"))
    t = F.concat(F.lit("tensor<"), F.col("shape"), F.lit("x"), F.col("dtype"), F.lit(">"))
    params = F.when(F.col("arity") == 2, F.concat(F.lit("%a: "), t, F.lit(", %b: "), t)).otherwise(F.concat(F.lit("%a: "), t))
    args = F.when(F.col("arity") == 2, "%a, %b").otherwise("%a")
    body = F.concat(
        F.lit("module {\n  func.func @f("), params, F.lit(") -> "), t, F.lit(f" {{\n    %0 = {dialect}."), F.col("op"), F.lit(" "), args, F.lit(" : "), t,
        F.lit("\n    return %0 : "), t, F.lit("\n  }\n}"),
    )
    return rows.withColumn("id", F.concat_ws("_", "op", "dtype", "shape")).withColumn("mlir", body)


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str], value: str, names: tuple[str, str], tag: str = "backend") -> DataFrame:
    """Each key's value of the first source, or where that has none of the second, with the name of the source; keys of neither value go."""
    one = primary.select(*keys, F.col(value).alias("_one"))
    both = one.join(fallback.select(*keys, F.col(value).alias("_two")), keys, "full")
    came = F.when(F.col("_one").isNotNull(), names[0]).when(F.col("_two").isNotNull(), names[1])
    return both.select(*keys, F.coalesce("_one", "_two").alias(value), came.alias(tag)).where(F.col(tag).isNotNull())
