"""The ten health signals of an extraction run against its baseline, and the score they give.

Inputs are long tables.  ``results``: keys, record, field, value, number, tier, n_hits, failed_validator.
``baseline``: keys, field, fill, modal_tier, distinct_rate, numeric, median, iqr, len_mean,
all_positive, match_mean, sample (array of texts).  ``headers``: keys, n_records, root_tier, shape_entropy,
errors; ``site_baseline``: keys, n_records, root_tier, shape_entropy.  The baseline side is kept in
every join, so a run without records still reports what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.values import ISO_DATE, clamp, tokens
from fieldloom.operators import stack, stats

#: How much each signal counts, and the marks of warning and of a break.
WEIGHTS = {"fill_drop": 1.00, "tier_shift": 0.85, "record_count": 1.00, "validator_fail": 0.80, "value_drift": 0.55, "constant_collapse": 0.90, "invariant": 1.00, "novel_values": 0.25, "shape_entropy": 0.50, "match_count": 0.85}
WARN, CRITICAL = 0.30, 0.60
RECORD = "<record>"
SAMPLE_CAP = 400
#: Order in which a field's signals count.
ORDER = {name: i for i, name in enumerate(("record_count", "tier_shift", "shape_entropy", "fill_drop", "match_count", "validator_fail", "value_drift", "constant_collapse", "invariant", "novel_values"))}


def fill_drop(fill: Column, base: Column, floor: Column) -> Column:
    """Magnitude, null if quiet: fill fell by over .02 or below the floor."""
    drop = base - fill
    quiet = (drop <= 0.02) & (fill >= F.least(floor, base))
    return F.when(~quiet, clamp(F.greatest(drop / F.greatest(base, F.lit(0.01)), (floor - fill) / F.greatest(floor, F.lit(0.01)))))


def tier_shift(modal: Column, base_modal: Column, moved: Column) -> Column:
    depth = modal - base_modal
    height = F.when(depth > 0, clamp(0.45 + 0.2 * depth)).otherwise(F.lit(0.30))
    return F.when(modal.isNotNull() & base_modal.isNotNull() & ((modal != base_modal) | (moved >= 0.10)), clamp(height * (0.5 + 0.5 * moved)))


def root_tier_shift(now: Column, base: Column) -> Column:
    return F.when(~now.eqNullSafe(base), F.when(now.isNull(), F.lit(1.0)).otherwise(clamp(0.5 + 0.25 * F.abs(now - F.coalesce(base, F.lit(0))))))


def record_count(n: Column, base: Column) -> Column:
    change = F.abs(n - base) / base
    return F.when(base <= 0, F.when(n > 0, F.lit(1.0))).otherwise(F.when(change > 0.05, clamp(change / 0.5)))


def validator_fail(failed: Column, n: Column) -> Column:
    return F.when(failed > 0, clamp(stats.share(failed, n) / 0.5))


def numeric_drift(ks: Column, median: Column, base_median: Column, iqr: Column) -> Column:
    scale = F.when(iqr > 0, iqr).when(base_median != 0, F.abs(base_median)).otherwise(F.lit(1.0))
    size = F.greatest((ks - 0.4) / 0.6, F.abs(median - base_median) / scale - 0.25)
    return F.when(size > 0, clamp(size))


def category_drift(tvd: Column) -> Column:
    return F.when(tvd > 0.35, clamp((tvd - 0.35) / 0.65))


def text_drift(jaccard: Column, length: Column, base_length: Column) -> Column:
    ratio = F.when((length > 0) & (base_length > 0), F.abs(F.log2(length / base_length))).otherwise(F.lit(0.0))
    size = F.greatest((0.5 - jaccard) / 0.5, (ratio - 1) / 2)
    return F.when(size > 0, clamp(size))


def constant_collapse(n: Column, now: Column, base: Column) -> Column:
    return F.when((n >= 3) & (base >= 0.35) & (now < base / 2), clamp((base - now) / F.greatest(base, F.lit(0.01))))


def novel_values(share: Column) -> Column:
    return F.when(share >= 0.5, clamp((share - 0.5) / 0.5))


def shape_entropy(now: Column, base: Column) -> Column:
    return F.when(now > base + 0.15, clamp(now - base))


def match_count(now: Column, base: Column) -> Column:
    return F.when((now > 0) & (now > base + 0.15), clamp(now - base))


def field_stats(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys and field; scalar statistics in one aggregate."""
    by = [*keys, "field"]
    text = F.col("value")
    agg = results.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("value").alias("present"), stats.fill_rate(text).alias("fill"), stats.distinct_rate(text).alias("distinct_rate"), ((F.count("number") == F.count("value")) & (F.count("value") > 0)).alias("numeric"),
        F.coalesce(F.median("number"), F.lit(0.0)).alias("median"), F.coalesce(F.avg(F.char_length("value")), F.lit(0.0)).alias("len_mean"), F.coalesce(F.bool_and(F.col("number") > 0), F.lit(False)).alias("all_positive"),
        F.coalesce(F.avg(F.nullif(F.col("n_hits"), F.lit(0))), F.lit(0.0)).alias("match_mean"), F.count("failed_validator").alias("failed"), F.mode("tier", True).alias("modal_tier"),
        F.count_if(F.col("number") <= 0).alias("not_positive"), F.max(F.when(text.rlike(f"^{ISO_DATE}$"), text)).alias("latest"),
    )
    return agg.join(stats.ranked_iqr(results, by, "number"), by, "left").withColumn("iqr", F.coalesce("iqr", F.lit(0.0)))


def baseline_of(results: DataFrame, keys: list[str]) -> DataFrame:
    """The baseline that one run gives: field statistics and the first 400 present values in record order."""
    by = [*keys, "field"]
    first = stats.first_values(results, by, ["record"], "value", SAMPLE_CAP).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "value", "number"))).alias("sample"))
    passed = 1 - stats.share(F.coalesce("failed", F.lit(0)), F.col("n"))
    return field_stats(results, keys).withColumn("validator_pass", passed).join(tier_shares(results, keys), by, "left").join(first, by, "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<struct<place:bigint,value:string,number:double>>")))


def signals(results: DataFrame, baseline: DataFrame, keys: list[str], as_of: str, floors: DataFrame | None = None) -> DataFrame:
    """(keys, field, signal, magnitude) of every field signal that fires; ``floors``: keys, field, floor (else .95)."""
    by = [*keys, "field"]
    now = field_stats(results, keys)
    base = baseline.select(*by, *(F.col(c).alias(f"b_{c}") for c in ("fill", "distinct_rate", "numeric", "median", "iqr", "len_mean", "all_positive", "match_mean", "modal_tier")), "sample")
    known = base.select(*by, F.explode("sample").alias("s")).select(*by, F.col("s.value").alias("value"), F.col("s.number").alias("number"))
    present = results.where("value is not null").select(*by, "value", "number")
    moved = results.where("tier is not null").join(base.select(*by, "b_modal_tier"), by).groupBy(*by).agg((F.count_if(F.col("tier") != F.col("b_modal_tier")) / F.count("*")).alias("moved"))
    sides = present.withColumn("side", F.lit(1)).unionByName(known.withColumn("side", F.lit(0)))
    ks = stats.ks_statistic(sides, by, "number", "side")
    tvd = stats.total_variation(sides, by, "value", "side")
    words = sides.select(*by, "side", F.explode(tokens(F.col("value"))).alias("word")).groupBy(*by, "word").agg(F.max((F.col("side") == 0).cast("int")).alias("b"), F.max((F.col("side") == 1).cast("int")).alias("a"))
    words = words.groupBy(*by).agg((F.sum(F.col("a") * F.col("b")) / F.count("*")).alias("jaccard"))
    unseen = present.join(known.select(*by, "value").distinct().withColumn("seen", F.lit(1)), [*by, "value"], "left").groupBy(*by).agg(F.avg(F.col("seen").isNull().cast("int")).alias("novel"))
    own = present.select(*by, "value").distinct()
    other = known.select(*keys, F.col("field").alias("other"), "value").distinct()
    sizes = own.groupBy(*by).agg(F.count("*").alias("d"))
    overlap = own.join(other, [*keys, "value"]).groupBy(*by, "other").agg(F.count("*").alias("o")).join(sizes, by).withColumn("part", F.col("o") / F.col("d"))
    overlap = overlap.groupBy(*by).agg(F.max(F.when(F.col("other") != F.col("field"), F.col("part"))).alias("elsewhere"), F.coalesce(F.max(F.when(F.col("other") == F.col("field"), F.col("part"))), F.lit(0.0)).alias("at_home"))
    dated = present.where(F.col("value").rlike(f"^{ISO_DATE}$")).groupBy(*by).agg((F.count_if(F.col("value") > as_of) / F.count("*")).alias("future"))
    distinct_base = known.groupBy(*by).agg(F.count_distinct("value").alias("b_values"))
    joined = base
    for part in (now, moved, ks, tvd, words, unseen, overlap, dated, distinct_base):
        joined = joined.join(part, by, "left")
    c = F.col
    if floors is not None:
        joined = joined.join(floors.select(*by, "floor"), by, "left")
    floor = F.coalesce(c("floor"), F.lit(0.95)) if floors is not None else F.lit(0.95)
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    numeric = zero("present") > 0
    category = (c("b_distinct_rate") < 0.35) & (c("b_values") <= 12)
    drift = F.when(numeric & c("b_numeric"), numeric_drift(c("ks"), c("median"), c("b_median"), c("b_iqr"))).when(numeric & category, category_drift(c("tvd"))).when(numeric & (c("b_len_mean") > 0), text_drift(F.coalesce(c("jaccard"), F.lit(1.0)), c("len_mean"), c("b_len_mean")))
    broken_rule = F.greatest(F.when(c("b_all_positive") & (c("not_positive") > 0), clamp(c("not_positive") / F.greatest(c("present"), F.lit(1)))), F.when(c("future") > 0, clamp(c("future"))), F.when((c("elsewhere") > 0.5) & (c("at_home") < 0.5), F.lit(0.8)))
    found = {
        "fill_drop": fill_drop(zero("fill").cast("double"), c("b_fill"), floor), "tier_shift": tier_shift(c("modal_tier"), c("b_modal_tier"), F.coalesce(c("moved"), F.lit(0.0))), "match_count": match_count(c("match_mean"), c("b_match_mean")),
        "validator_fail": validator_fail(zero("failed"), zero("n")), "value_drift": drift, "constant_collapse": constant_collapse(zero("present"), c("distinct_rate"), c("b_distinct_rate")), "invariant": broken_rule, "novel_values": novel_values(F.coalesce(c("novel"), F.lit(0.0))),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("signal"), m.cast("double").alias("magnitude")) for name, m in found.items()))
    return joined.select(*by, F.explode(rows).alias("s")).select(*by, "s.signal", "s.magnitude").where("magnitude is not null")


def record_signals(headers: DataFrame, site_baseline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field = <record>, signal, magnitude) of the site-level signals; a runtime error is an invariant of .6 each."""
    base = site_baseline.select(*keys, F.col("n_records").alias("b_n"), F.col("root_tier").alias("b_root"), F.col("shape_entropy").alias("b_shape"))
    both = base.join(headers, keys, "left")
    found = {"record_count": record_count(F.coalesce("n_records", F.lit(0)), F.col("b_n")), "tier_shift": root_tier_shift(F.col("root_tier"), F.col("b_root")), "shape_entropy": shape_entropy(F.coalesce("shape_entropy", F.lit(0.0)), F.col("b_shape"))}
    rows = F.array(*(F.struct(F.lit(name).alias("signal"), m.cast("double").alias("magnitude")) for name, m in found.items()))
    errors = F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda e: F.struct(F.lit("invariant").alias("signal"), F.lit(0.6).alias("magnitude")))
    return both.select(*keys, F.lit(RECORD).alias("field"), F.explode(F.concat(rows, errors)).alias("s")).select(*keys, "field", "s.signal", "s.magnitude").where("magnitude is not null")


def severity(score: Column) -> Column:
    return F.when(score >= CRITICAL, "critical").when(score >= WARN, "warn").otherwise("ok")


def health(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, score, severity, n_signals): signals combined in a fixed order."""
    weight, order = F.lit(0.0), F.lit(99)
    for name in WEIGHTS:
        weight = F.when(F.col("signal") == name, F.lit(WEIGHTS[name])).otherwise(weight)
        order = F.when(F.col("signal") == name, F.lit(ORDER[name])).otherwise(order)
    parts = F.collect_list(F.struct(order.alias("ord"), F.col("magnitude"), weight.alias("weight")))
    scored = found.groupBy(*keys, "field").agg(stats.noisy_or(parts).alias("score"), F.count("*").alias("n_signals"))
    return scored.withColumn("severity", severity(F.col("score")))


def report(found: DataFrame, keys: list[str]) -> DataFrame:
    """``health`` with the rank of each broken field (worst first) and whether the run fires."""
    h = health(found, keys)
    w = Window.partitionBy(*keys)
    return h.withColumn("fired", F.max((F.col("severity") == "critical").cast("int")).over(w) == 1).withColumn("place", F.row_number().over(w.orderBy(F.col("score").desc(), "field")))


def _moved(was: Column, now: Column, alpha: float) -> Column:
    """One step of the moving average."""
    return stats.ewma(F.array(F.struct(F.lit(0).alias("ord"), was.cast("double").alias("value")), F.struct(F.lit(1).alias("ord"), now.cast("double").alias("value"))), alpha)


def fold_baseline(old: DataFrame, new: DataFrame, keys: list[str], alpha: float = 0.3) -> DataFrame:
    """The baseline after one more run: averages move by alpha, the rest is the newest run's; samples unite.

    A field that the new run lacks keeps its old row.
    """
    by = [*keys, "field"]
    smooth = ("fill", "distinct_rate", "match_mean", "validator_pass")
    a = old.select(*by, *(F.col(c).alias(f"o_{c}") for c in old.columns if c not in by))
    both = a.join(new, by, "full")
    out = []
    for c in old.columns:
        if c in by:
            out.append(F.col(c))
        elif c in smooth:
            out.append(F.when(F.col(c).isNull(), F.col(f"o_{c}")).when(F.col(f"o_{c}").isNull(), F.col(c)).otherwise(_moved(F.col(f"o_{c}"), F.col(c), alpha)).alias(c))
        elif c == "all_positive":
            out.append((F.coalesce(F.col(f"o_{c}"), F.lit(True)) & F.coalesce(F.col(c), F.lit(True))).alias(c))
        elif c == "sample":
            was = F.coalesce(F.col("o_sample"), F.array().cast("array<struct<place:bigint,value:string,number:double>>"))
            seen = F.transform(was, lambda s: s["value"])
            fresh = F.filter(F.coalesce(F.col("sample"), F.array().cast("array<struct<place:bigint,value:string,number:double>>")), lambda s: ~F.array_contains(seen, s["value"]))
            out.append(F.slice(F.concat(was, fresh), 1, SAMPLE_CAP).alias("sample"))
        else:
            out.append(F.coalesce(F.col(c), F.col(f"o_{c}")).alias(c))
    return both.select(*out)


def fold_site(old: DataFrame, new: DataFrame, keys: list[str], alpha: float = 0.3) -> DataFrame:
    """The site's baseline after one more run: record count and shape entropy move by alpha, the root's tier is the newest run's."""
    both = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("n_records", "root_tier", "shape_entropy"))).join(new.select(*keys, "n_records", "root_tier", "shape_entropy"), keys, "full")
    moved = lambda c: _moved(F.coalesce(f"o_{c}", c), F.coalesce(c, f"o_{c}"), alpha).alias(c)
    return both.select(*keys, moved("n_records"), F.coalesce("root_tier", "o_root_tier").alias("root_tier"), moved("shape_entropy"))


def tier_shares(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, tier_share: map of tier to its share of the values that have one)."""
    by = [*keys, "field"]
    n = results.where("tier is not null").groupBy(*by, "tier").agg(F.count("*").alias("n"))
    shares = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    return shares.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "share")))).alias("tier_share"))


def baseline_summary(baseline: DataFrame, keys: list[str]) -> DataFrame:
    """One text for each field of a baseline."""
    text = F.format_string("fill %.2f, tier %s, distinct %.2f, %s", "fill", F.coalesce(F.col("modal_tier").cast("string"), F.lit("none")), "distinct_rate", F.when(F.col("numeric"), F.format_string("median %.2f iqr %.2f", "median", "iqr")).otherwise(F.format_string("length %.1f", F.coalesce("len_mean", F.lit(0.0)))))
    return baseline.select(*keys, "field", text.alias("summary"))


def detection_summary(cases: DataFrame) -> DataFrame:
    """One row from (degraded, silent, fired, warned): degraded and silent cases caught, and alarms on healthy ones."""
    c = F.col
    healthy = ~c("degraded")
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(c("degraded")).alias("degraded"), F.count_if(c("degraded") & c("fired")).alias("detected"), F.count_if(c("silent")).alias("silent"), F.count_if(c("silent") & c("fired")).alias("silent_caught"),
        F.count_if(healthy).alias("healthy"), F.count_if(healthy & c("fired")).alias("false_alarms"), F.count_if(healthy & c("warned") & ~c("fired")).alias("false_warnings"),
    )
