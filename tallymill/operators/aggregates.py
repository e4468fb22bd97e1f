"""Rates, counts and tables over cells of result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(c: Column) -> Column:
    """Mean of a 0/1 or boolean column, null for none."""
    return F.avg(c.cast("int").cast("double"))


def cell_rates(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("passes"), rate(F.col(flag)).alias("rate"))


def category_table(df: DataFrame, keys: Sequence[str], category: str, names: Sequence[str]) -> DataFrame:
    """Counts of each named category and of all rows; names that don't occur count 0."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(category) == c).alias(c) for c in names], F.count("*").alias("n"))


def cell_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parse and verify rates, mean attempts (null: 1) and seconds (null: 0)."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate(F.coalesce("parse_valid", F.lit(False))).alias("parse_rate"),
        rate(F.coalesce("verify_valid", F.lit(False))).alias("verify_rate"),
        F.avg(F.coalesce("attempts", F.lit(1)).cast("double")).alias("mean_attempts"),
        F.avg(F.coalesce("dt", F.lit(0.0))).alias("mean_dt"),
    )


def seed_summary(df: DataFrame, cell: Sequence[str], seed: str, flag: str) -> DataFrame:
    """Mean of the seeds' rates, half their range, their envelope, and whether all seeds have equal n."""
    each = df.groupBy(*cell, seed).agg(rate(F.col(flag)).alias("_r"), F.count("*").alias("_n"))
    return each.groupBy(*cell).agg(
        F.count("*").alias("seeds"),
        F.avg("_r").alias("mean_rate"),
        ((F.max("_r") - F.min("_r")) / 2).alias("half_range"),
        F.min("_r").alias("low"),
        F.max("_r").alias("high"),
        (F.min("_n") == F.max("_n")).alias("equal_n"),
    )


def unique_rate(df: DataFrame, cell: Sequence[str], text: str, flag: str) -> DataFrame:
    """Mean over distinct texts of the mean over each text's rows; digests of texts are shuffled, not texts."""
    each = df.groupBy(*cell, F.sha2(text, 256).alias("_digest")).agg(rate(F.col(flag)).alias("_r"))
    return each.groupBy(*cell).agg(F.count("*").alias("texts"), F.avg("_r").alias("unique_rate"))


def truncation(df: DataFrame, keys: Sequence[str], truncated: Column, valid: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(truncated).alias("truncated"),
        F.count_if(truncated & valid).alias("truncated_valid"),
        ((F.count_if(valid) + F.count_if(truncated)) / F.count("*")).alias("worst_case_credit"),
    )


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """The 2x2 table of accept and pass, with the rate of rejects among passes, null without any."""
    fr, tp = F.count_if(~predicted & actual), F.count_if(predicted & actual)
    return df.groupBy(*keys).agg(
        tp.alias("accept_pass"), F.count_if(predicted & ~actual).alias("accept_fail"), fr.alias("reject_pass"),
        F.count_if(~predicted & ~actual).alias("reject_fail"), F.try_divide(fr.cast("double"), (fr + tp).cast("double")).alias("false_reject_rate"),
    )


def histogram(df: DataFrame, items: str, kind: Column) -> DataFrame:
    """Counts of the kinds of the items of an array column."""
    return df.select(F.explode(items).alias("item")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def with_total(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates of each group and, with a null key, of all rows."""
    return df.groupingSets([[F.col(key)], []], F.col(key)).agg(*aggregates)


def concordance(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Agreement of two verdicts by group and over all, and the disagreements of either direction."""
    x, y = F.col(a), F.col(b)
    return with_total(
        df, key, F.count("*").alias("n"), rate(x == y).alias("agreement"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b")
    )


def gate_table(df: DataFrame, keys: Sequence[str], gate: str, status: str) -> DataFrame:
    """Passed and failed gates, and the match rate over scored rows as well as over passed gates."""
    scored = F.col(status).isin("match", "mismatch")
    matched = F.count_if(F.col(status) == "match").cast("double")
    return df.groupBy(*keys).agg(
        F.count_if(F.col(gate) == "pass").alias("gate_pass"),
        F.count_if(F.col(gate) == "fail").alias("gate_fail"),
        F.count_if(scored).alias("scored"),
        F.try_divide(matched, F.count_if(scored).cast("double")).alias("match_of_scored"),
        F.try_divide(matched, F.count_if(F.col(gate) == "pass").cast("double")).alias("match_of_passed"),
    )


def trial_table(df: DataFrame, keys: Sequence[str], trial: str, match: Column, label: str) -> DataFrame:
    """Trials, matches, whether all match, and the label of the first trial that doesn't."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("trials"),
        F.count_if(match).alias("matched"),
        F.bool_and(match).alias("all_match"),
        F.min_by(F.col(label), F.when(~match, F.col(trial))).alias("first_divergence"),
    )


def ragged_means(df: DataFrame, key: str, series: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Means of ragged series without NaN: over all elements, by position, and by row."""
    flat = df.select(key, F.posexplode(series).alias("position", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    mean = F.avg(F.col("x").cast("double")).alias("mean")
    return flat.agg(mean, F.count("*").alias("n")), flat.groupBy("position").agg(mean, F.count("*").alias("n")), flat.groupBy(key).agg(mean, F.count("*").alias("n"))


def best_of(df: DataFrame, keys: Sequence[str], name: str, value: str, ours: str, margin: float = 0.03) -> DataFrame:
    """Our value against the best other one (ties: the smallest name)."""
    least = F.when(F.col(name) != ours, F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    found = df.groupBy(*keys).agg(F.min(least).alias("_b"), F.max(F.when(F.col(name) == ours, F.col(value))).alias("ours"))
    delta = F.col("ours") + F.col("_b.v")
    return found.select(*keys, "ours", F.col("_b.n").alias("best_other"), (-F.col("_b.v")).alias("best_value"), delta.alias("delta"), (delta >= -margin).alias("within_margin"), (delta > 0).alias("beats"))


def flips(cells: DataFrame, reference: DataFrame, key: str, flag: str) -> DataFrame:
    """Each cell flag against the reference's: new_flip, pre_existing, fixed or stable."""
    both = cells.join(reference.select(key, F.col(flag).alias("_ref")), key, "left")
    return both.withColumn(
        "flip",
        F.when(F.col(flag) & ~F.coalesce("_ref", F.lit(False)), "new_flip").when(F.col(flag), "pre_existing").when(F.coalesce("_ref", F.lit(False)), "fixed").otherwise("stable"),
    ).drop("_ref")


def reduction(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Absolute and relative decrease, relative to one at least."""
    return df.withColumn("decrease", before - after).withColumn("decrease_share", (before - after) / F.greatest(before, F.lit(1)))


def ratio_of_sums(a: Column, b: Column) -> Column:
    return F.try_divide(F.sum(a), F.sum(b))


def interval_envelope(df: DataFrame, keys: Sequence[str], point: str, low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """Over the seeds of each cell: mean and half range of the points, and the envelope of their intervals."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("seeds"), F.avg(point).alias("mean"), ((F.max(point) - F.min(point)) / 2).alias("half_range"), F.min(low).alias("low"), F.max(high).alias("high")
    )


def gate_failures(df: DataFrame, keys: Sequence[str], gate: str, reason: str, item: str) -> DataFrame:
    """For each reason of a gate that did not pass: how many, and the smallest failed items (ten at most, a report's list)."""
    missed = df.where(F.col(gate) != "pass")
    counts = missed.groupBy(*keys, reason).agg(F.count("*").alias("n"))
    heads = missed.withColumn("_nth", F.row_number().over(W.partitionBy(*keys, reason).orderBy(item))).where("_nth <= 10")  # cut before the shuffle
    first = heads.groupBy(*keys, reason).agg(F.array_sort(F.collect_list(item)).alias("first"))
    return counts.join(first, [*keys, reason])
