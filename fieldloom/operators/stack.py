"""The ordered fallback stack and related choices, on long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve(hits: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """The winning tier of each key.

    ``hits`` has a row for each key and tier: tier, value, fail (the validator that the value fails, or
    null).  The first tier with a value and no failure wins; where none does, ``failed_validator`` is that
    of the last failing tier.  One aggregate, so Spark combines it before the shuffle.
    """
    ok = F.col("value").isNotNull() & F.col("fail").isNull()
    best = F.min(F.when(ok, F.struct("tier", "value", *carry)))
    last = F.max(F.when(F.col("value").isNotNull() & F.col("fail").isNotNull(), F.struct("tier", "fail")))
    out = hits.groupBy(*keys).agg(best.alias("best"), last.alias("last"))
    return out.select(*keys, "best.tier", "best.value", *(f"best.{c}" for c in carry), F.when(F.col("best").isNull(), F.col("last.fail")).alias("failed_validator"))


def modal_only(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Rows of each key's most frequent kind (ties: the first in order) if it occurs twice at least, else all rows."""
    counts = df.groupBy(*keys, kind).agg(F.count("*").alias("c"))
    top = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("less"), F.col(kind).alias("kind"))).alias("m"))
    joined = df.join(top, keys)
    return joined.where((F.col("m.less") > -2) | (F.col(kind) == F.col("m.kind"))).drop("m")


def modal(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """The most frequent value of each key, ties to the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("less"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(alias), (-F.col("m.less")).alias("times"))


def first_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
