"""The episode memory: fingerprints of breakages, and recall of what healed the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.stats import jaccard

FLOOR, TOP = 0.55, 3
EPISODE = "ts double, site string, field string, spec_version int, signals array<string>, diff_class string, transform string, locator_kind string, strategy string, strategy_class string, locator string, outcome string, cycles int, f1_before double, f1_after double, gates map<string,boolean>, note string, tokens int, used_memory boolean"


def fingerprints(signals: DataFrame, classes: DataFrame, stacks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, signals, diff_class, transform, locator_kind) of every field with a signal.

    ``signals``: keys, field, signal; ``classes``: keys, diff_class; ``stacks``: keys, field, transform, locator_kind (of the first locator).
    """
    fired = signals.groupBy(*keys, "field").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    return fired.join(classes.select(*keys, "diff_class"), keys, "left").join(stacks, [*keys, "field"], "left").withColumn("diff_class", F.coalesce("diff_class", F.lit("UNKNOWN")))


def fingerprint_key() -> Column:
    """A fingerprint as one text."""
    return F.concat_ws("|", F.array_join("signals", ","), "diff_class", "transform", "locator_kind")


def apply_recall(found: DataFrame, recalls: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate that memory decides on, for each key: of the recalled episodes in order, the first healed one that has a
    live candidate of its strategy class with a recovery of .99 at least; of such candidates the best placed."""
    healed = recalls.where("outcome = 'healed'").select(*keys, "strategy_class", F.col("place").alias("recalled"))
    fit = found.where("recovery >= 0.99").join(healed, [*keys, "strategy_class"])
    order = Window.partitionBy(*keys).orderBy("recalled", "place")
    return fit.withColumn("first", F.row_number().over(order)).where("first = 1").drop("first", "recalled")


def remember(choices: DataFrame, prints: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """One episode for each diagnosed patch.

    ``choices``: keys, field, locator, strategy_class, used_memory; ``verdicts``: keys, spec_version, cycles, f1_before, f1_broken, g1, g2, g3, passed.
    """
    rows = choices.join(prints, [*keys, "field"], "left").join(verdicts, keys)
    gates = F.create_map(F.lit("G1"), F.col("g1"), F.lit("G2"), F.col("g2"), F.lit("G3"), F.col("g3"))
    return rows.select(
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("ts"), "site", "field", "spec_version", F.coalesce("signals", F.array().cast("array<string>")).alias("signals"), F.coalesce("diff_class", F.lit("UNKNOWN")).alias("diff_class"), "transform", "locator_kind",
        F.col("strategy_class").alias("strategy"), "strategy_class", "locator", F.when(F.col("passed"), "healed").otherwise("failed").alias("outcome"), F.col("cycles").cast("int").alias("cycles"), "f1_before", F.col("f1_broken").alias("f1_after"), gates.alias("gates"), F.lit("").alias("note"), F.lit(0).alias("tokens"), "used_memory",
    )


def similarity(signals_a: Column, class_a: Column, signals_b: Column, class_b: Column) -> Column:
    """Shared signals weigh .65, the same class of difference .35; two episodes without signals share all of none."""
    return F.round(0.65 * jaccard(signals_a, signals_b) + 0.35 * F.coalesce(class_a == class_b, F.lit(False)).cast("double"), 4)


def recall(queries: DataFrame, episodes: DataFrame, keys: list[str], exclude_site: bool = False, floor: float = FLOOR, top: int = TOP) -> DataFrame:
    """The most similar episodes of each query, healed ones first.

    A pair at the floor shares a signal, or neither has any; so partners come from equi-joins.
    """
    q = queries.select(*keys, F.col("site").alias("q_site"), F.col("signals").alias("q_signals"), F.col("diff_class").alias("q_class"))
    e = episodes.withColumn("e_id", F.xxhash64(F.struct(*[c for c in episodes.columns if c != "gates"])))
    by_signal = q.select(*keys, F.explode("q_signals").alias("signal")).join(e.select("e_id", F.explode("signals").alias("signal")), "signal").select(*keys, "e_id")
    empty = q.where("size(q_signals) = 0").select(*keys, F.lit(1).alias("one")).join(e.where("size(signals) = 0").select("e_id", F.lit(1).alias("one")), "one").select(*keys, "e_id")
    pairs = by_signal.unionByName(empty).distinct()
    found = pairs.join(q, keys).join(e, "e_id").withColumn("similarity", similarity(F.col("q_signals"), F.col("q_class"), F.col("signals"), F.col("diff_class"))).where(F.col("similarity") >= floor)
    if exclude_site:
        found = found.where("site <> q_site")
    order = [F.col("similarity").desc(), (F.col("outcome") == "healed").desc(), F.col("f1_after").desc_nulls_last(), "e_id"]
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= top).drop("q_site", "q_signals", "q_class")


def failed_strategies(episodes: DataFrame) -> DataFrame:
    """(site, field, spec_version, strategies) that did not heal."""
    return episodes.where("outcome <> 'healed'").groupBy("site", "field", "spec_version").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"))
