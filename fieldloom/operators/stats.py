"""Statistics over groups: all exact, all with a total order where order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def fill_rate(value: Column) -> Column:
    return share(F.count(value), F.count(F.lit(1)))


def distinct_rate(value: Column) -> Column:
    """Distinct over present; 1 where nothing is present."""
    return F.when(F.count(value) > 0, F.count_distinct(value) / F.count(value)).otherwise(F.lit(1.0)).cast("double")


def floor_quantile(sorted_values: Column, p: float) -> Column:
    """Element at floor(p * (n - 1)) of a sorted array, without interpolation."""
    return F.try_element_at(sorted_values, (F.floor(F.lit(p) * (F.size(sorted_values) - 1)) + 1).cast("int"))


def floor_iqr(value: Column) -> Column:
    """Spread between the floor-index quartiles; 0 for fewer than four values.

    It gathers a group's values; groups are a field of a site's run, which a page bounds.
    For unbounded groups use ``ranked_iqr``.
    """
    values = F.array_sort(F.collect_list(value))
    return F.when(F.size(values) >= 4, floor_quantile(values, 0.75) - floor_quantile(values, 0.25)).otherwise(F.lit(0.0)).cast("double")


def ranked_iqr(df: DataFrame, keys: list[str], value: str, alias: str = "iqr") -> DataFrame:
    """``floor_iqr`` for groups of any size: cumulative counts of distinct values, never a whole group in one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    n = Window.partitionBy(*keys)
    upto = F.sum("c").over(n.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("hi", upto).withColumn("n", F.sum("c").over(n)).withColumn("lo", F.col("hi") - F.col("c"))
    at = lambda p: F.floor(F.lit(p) * (F.col("n") - 1))
    hit = lambda p: F.max(F.when((F.col("lo") <= at(p)) & (at(p) < F.col("hi")), F.col(value)))
    return placed.groupBy(*keys).agg(F.when(F.max("n") >= 4, hit(0.75) - hit(0.25)).otherwise(F.lit(0.0)).cast("double").alias(alias))


def ks_statistic(df: DataFrame, keys: list[str], value: str, side: str, alias: str = "ks") -> DataFrame:
    """Largest gap between the distribution functions of side 0 and side 1 in each group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    part = lambda c: F.try_divide(F.sum(c).over(upto), F.sum(c).over(whole))  # noqa: E731 - null, so a gap of 0, if a side is empty
    gap = F.abs(part("a") - part("b"))
    return counts.withColumn("gap", gap).groupBy(*keys).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias(alias))


def total_variation(df: DataFrame, keys: list[str], value: str, side: str, alias: str = "tvd") -> DataFrame:
    """Half the sum of |p - q| over values, between side 0 and side 1."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    whole = Window.partitionBy(*keys)
    gap = F.abs(share(F.col("a"), F.sum("a").over(whole)) - share(F.col("b"), F.sum("b").over(whole)))
    return counts.withColumn("gap", gap).groupBy(*keys).agg((F.sum("gap") / 2).alias(alias))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def entropy(df: DataFrame, keys: list[str], value: str, alias: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of the values in each group; null values are a value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg((F.sum(-F.col("p") * F.log2("p")) + 0.0).alias(alias))


def noisy_or(parts: Column) -> Column:
    """1 - product of (1 - magnitude * weight) over array<struct<ord, magnitude, weight>>, in order of ord."""
    return 1.0 - F.aggregate(F.array_sort(parts), F.lit(1.0), lambda acc, s: acc * (1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["magnitude"])) * s["weight"]))


def ewma(points: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average over array<struct<ord, value>>, in order of ord; the first value starts it."""
    ordered = F.transform(F.array_sort(points), lambda s: s["value"].cast("double"))
    rest = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.aggregate(rest, F.try_element_at(ordered, F.lit(1)), lambda acc, v: (1 - alpha) * acc + alpha * v)


def first_values(df: DataFrame, keys: list[str], order: list[str], value: str, cap: int = 400) -> DataFrame:
    """The first ``cap`` present values of each group in order, with their place."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.where(F.col(value).isNotNull()).withColumn("place", place.cast("bigint")).where(F.col("place") <= cap)


def kendall(df: DataFrame, keys: list[str], a: str, b: str, alias: str = "concordance") -> DataFrame:
    """Share of concordant pairs of rows in each group; bounded groups only (rank them first)."""
    left = df.select(*keys, F.col(a).alias("a1"), F.col(b).alias("b1"))
    right = df.select(*keys, F.col(a).alias("a2"), F.col(b).alias("b2"))
    pairs = left.join(right, keys).where("a1 < a2")
    return pairs.groupBy(*keys).agg(share(F.count_if(F.col("b1") < F.col("b2")), F.count(F.lit(1))).alias(alias))
