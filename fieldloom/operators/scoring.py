"""Scoring of extracted values against known ones, as multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.stats import share


def f1(hit: Column, predicted: Column, true: Column) -> list[Column]:
    """Precision, recall and their harmonic mean; 0 where a denominator is 0."""
    p, r = share(hit, predicted), share(hit, true)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1")]


def matched(pred: DataFrame, truth: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, hit, predicted, true: sums of least counts and of counts, over present values.

    Both sides are counted before they meet, so a common value is one row on each side.
    """
    count = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(name))
    both = count(pred, "p").join(count(truth, "t"), [*keys, value], "full")
    return both.groupBy(*keys).agg(F.coalesce(F.sum(F.least("p", "t") * (F.col("p").isNotNull() & F.col("t").isNotNull()).cast("int")), F.lit(0)).alias("hit"), F.coalesce(F.sum("p"), F.lit(0)).alias("predicted"), F.coalesce(F.sum("t"), F.lit(0)).alias("true"))


def field_scores(pred: DataFrame, truth: DataFrame, keys: list[str], field: str = "field", value: str = "value_key") -> DataFrame:
    """keys, field, precision, recall, f1."""
    m = matched(pred, truth, [*keys, field], value)
    return m.select(*keys, field, *f1(F.col("hit"), F.col("predicted"), F.col("true")))


def exact_records(pred: DataFrame, truth: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, matched, true, record_em: whole rows in common over rows of truth; nulls are equal."""
    count = lambda df, name: df.groupBy(*keys, *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")).alias(f) for f in fields)).agg(F.count("*").alias(name))
    both = count(truth, "t").join(count(pred, "p"), [*keys, *fields], "left")
    out = both.groupBy(*keys).agg(F.sum(F.coalesce(F.least("p", "t"), F.lit(0)) * F.col("p").isNotNull().cast("int")).alias("m"), F.sum("t").alias("true"))
    return out.select(*keys, F.coalesce("m", F.lit(0)).alias("matched"), "true", share(F.coalesce("m", F.lit(0)), F.col("true")).alias("record_em"))


def silent(fill: Column, macro_f1: Column) -> Column:
    """Full output that is wrong: average fill of 0.9 at least and F1 below 0.9."""
    return (fill >= 0.9) & (macro_f1 < 0.9)
