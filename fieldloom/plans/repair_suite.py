"""Queries of health signals, repair candidates, memory, patches, gates and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators import candidates, diff, health, memory, patch, stats
from fieldloom.plans.stats_suite import HALF, halves, r6
from fieldloom.plans.values_suite import table

LOCATORS = [
    ("jsonld", "offers.price", None), ("css", "article", "data-sku"), ("css", "a", "href"), ("css", ".price", None), ("css", "p", None), ("css", ".css-1ab2cd3", None), ("css", ".col-3.price", None),
    ("css", "[itemprop=\"name\"]", None), ("css", ".price:not(.old)", None), ("text_anchor", "Price", None), ("regex", "(\\d+)", None), ("structural", "./*[1]", None), ("xpath", "./div[2]", None), ("css", "time", "datetime"),
]
LOCATORS_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in LOCATORS) + ") l(kind, q, attr)"
NAMES_SQL = r"regexp_extract_all(q, '[.#\[]([A-Za-z0-9_-]+)', 1)"
#: The class patterns of ``values`` in the syntax of the SQL engine, which has no look-ahead.
HASHED_SQL, LAYOUT_SQL = "^((css-|sc-|jsx-|_)[a-z0-9]{4,}|[a-z]{1,3}[-_]?[0-9a-f]{6,})$", "^(col|row|grid|flex|container|wrapper|inner|outer|layout|mt|mb|ml|mr|px|py|p|m)[-_]?[0-9]*$"
SEMANTIC_SQL = "regexp_matches(q, 'itemprop|data-testid|data-qa|role|aria-label')"


def _locators(spark, sf_dir):
    rows = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(row, ("kind", "q", "attr"), strict=True))) for row in LOCATORS))
    return table(spark, sf_dir, "region").select("r_name", F.explode(rows).alias("l")).select("r_name", "l.*")


def q_prior(spark, sf_dir):
    return _locators(spark, sf_dir).withColumn("prior", candidates.prior(F.col("kind"), F.col("q"), F.col("attr")).cast("double"))


Q_PRIOR = f"""
SELECT r_name, kind, q, attr, (CASE WHEN kind = 'jsonld' THEN 0.9 ELSE greatest(CASE kind WHEN 'css' THEN CASE WHEN {SEMANTIC_SQL} THEN 0.88 WHEN len(n) = 0 THEN 0.4 WHEN len(list_filter(n, lambda t: NOT regexp_matches(t, '{HASHED_SQL}'))) = 0 THEN 0.22
  WHEN len(list_filter(n, lambda t: regexp_matches(t, '{LAYOUT_SQL}'))) > 0 THEN 0.35 ELSE 0.75 END WHEN 'text_anchor' THEN 0.72 WHEN 'structural' THEN 0.45 WHEN 'regex' THEN 0.5 ELSE 0.4 END,
  CASE WHEN attr LIKE 'data-%' OR attr IN ('itemprop', 'content', 'datetime') THEN 0.9 WHEN attr IN ('href', 'src') THEN 0.7 ELSE 0 END) END)::DOUBLE AS prior
FROM (SELECT *, {NAMES_SQL} AS n FROM region, {LOCATORS_SQL})
"""


def q_strategy(spark, sf_dir):
    return _locators(spark, sf_dir).withColumn("strategy_class", candidates.strategy(F.col("kind"), F.col("q"), F.col("attr")))


Q_STRATEGY = f"""
SELECT r_name, kind, q, attr, CASE WHEN kind = 'jsonld' THEN 'structured_data' WHEN attr LIKE 'data-%' OR attr IN ('itemprop', 'content', 'datetime') THEN 'semantic_attr'
  WHEN kind = 'css' THEN CASE WHEN contains(q, ':not(') THEN 'exclusion' WHEN {SEMANTIC_SQL} THEN 'semantic_attr' WHEN len(n) = 0 THEN 'bare_tag' WHEN len(list_filter(n, lambda t: NOT regexp_matches(t, '{HASHED_SQL}'))) = 0 THEN 'hashed_class'
    WHEN len(list_filter(n, lambda t: regexp_matches(t, '{LAYOUT_SQL}'))) > 0 THEN 'layout_class' ELSE 'stable_class' END WHEN kind = 'text_anchor' THEN 'text_anchor' WHEN kind = 'regex' THEN 'regex_shape' ELSE 'positional' END AS strategy_class
FROM (SELECT *, {NAMES_SQL} AS n FROM region, {LOCATORS_SQL})
"""


def _candidates(spark, sf_dir):
    """Nine columns of line items as candidates for the known-good set of first quantities."""
    items = table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_linenumber", "l_tax", "l_discount", "l_suppkey", "l_partkey", "l_extendedprice", "l_orderkey", "l_quantity_or_tax"]
    value = {n: F.col(n).cast("double") for n in names[:-1]} | {"l_quantity_or_tax": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).otherwise(F.col("l_quantity"))}
    rows = items.select("l_returnflag", F.explode(F.array(*(F.struct(F.lit(n).alias("signature"), value[n].alias("value"), (F.col("l_linenumber") % 3).alias("n_hits")) for n in names))).alias("c")).select("l_returnflag", "c.*")
    known = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("value")).distinct().withColumn("known", F.lit(True))
    found = candidates.evaluate(rows.join(known, "value", "left"), ["l_returnflag", "signature"])
    return candidates.ranked(found.withColumns({"prior": F.char_length("signature") / 20, "survives": F.contains("signature", F.lit("tax"))}), ["l_returnflag"])


CANDIDATES_SQL = """
WITH i AS (SELECT * FROM lineitem),
h AS (SELECT l_returnflag, l_linenumber % 3 AS n_hits, unnest([{'s': 'l_quantity', 'v': l_quantity::DOUBLE}, {'s': 'l_linenumber', 'v': l_linenumber::DOUBLE}, {'s': 'l_tax', 'v': l_tax}, {'s': 'l_discount', 'v': l_discount}, {'s': 'l_suppkey', 'v': l_suppkey::DOUBLE}, {'s': 'l_partkey', 'v': l_partkey::DOUBLE},
  {'s': 'l_extendedprice', 'v': l_extendedprice}, {'s': 'l_orderkey', 'v': l_orderkey::DOUBLE}, {'s': 'l_quantity_or_tax', 'v': CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE l_quantity END}]) AS c FROM i),
k AS (SELECT DISTINCT l_quantity AS v FROM i), e AS (SELECT l_returnflag, c.s AS signature, avg((k.v IS NOT NULL)::INT) AS recovery, avg((c.v IS NOT NULL)::INT) AS coverage, avg(n_hits) AS n_hits_mean FROM h LEFT JOIN k ON c.v = k.v GROUP BY 1, 2),
s AS (SELECT *, 0.5::DOUBLE * recovery + 0.18::DOUBLE * coverage + 0.2::DOUBLE * (length(signature) / 20) + 0.12::DOUBLE * contains(signature, 'tax')::INT - 0.15::DOUBLE * greatest(0, least(1, n_hits_mean - 1)) AS score FROM e WHERE coverage > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, recovery DESC, length(signature) DESC, signature) AS place FROM s)
"""


def q_candidate_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("l_returnflag", "signature", r6(F.col("recovery"), "recovery"), r6(F.col("score"), "score"), F.col("place").cast("long").alias("place"))


Q_CANDIDATE_SCORE = CANDIDATES_SQL + "SELECT l_returnflag, signature, round(recovery, 6) AS recovery, round(score, 6) AS score, place FROM r WHERE place <= 8"


def q_ambiguity(spark, sf_dir):
    return candidates.ambiguous(_candidates(spark, sf_dir), ["l_returnflag"])


Q_AMBIGUITY = CANDIDATES_SQL + ", n AS (SELECT *, lead(score) OVER (PARTITION BY l_returnflag ORDER BY place) AS nx FROM r WHERE place <= 8) SELECT l_returnflag, coalesce(nx IS NOT NULL AND (score - nx < 0.08 OR recovery < 0.99), false) AS ambiguous FROM n WHERE place = 1"


def _episodes(spark, sf_dir):
    """One episode for each user and day: signals are the event types seen, the class the first of them."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("signals"), F.count("*").alias("n"), F.round(F.avg("value") / 100, 4).alias("f1_after"))
    return days.select(F.concat(F.lit("u"), F.col("user_id")).alias("site"), F.col("day").cast("string").alias("field"), "signals", F.element_at("signals", 1).alias("diff_class"), F.when(F.col("n") > 1, "healed").otherwise("failed").alias("outcome"), "f1_after")


EPISODES_SQL = """
WITH e AS (SELECT 'u' || user_id AS site, day::VARCHAR AS field, signals, signals[1] AS diff_class, CASE WHEN n > 1 THEN 'healed' ELSE 'failed' END AS outcome, f1_after
  FROM (SELECT user_id, ts::DATE AS day, list_sort(list(DISTINCT event_type)) AS signals, count(*) AS n, avg(value) AS f1_after FROM events GROUP BY 1, 2))
"""


def q_recall(spark, sf_dir):
    """For each set of signals of the first week: how many of the best three episodes of other weeks are alike, and how many healed."""
    episodes = _episodes(spark, sf_dir)
    asked = episodes.where("field < '2024-01-08'").select("signals", "diff_class").distinct().select(F.concat_ws("+", "signals").alias("query"), F.lit("-").alias("site"), "signals", "diff_class")
    found = memory.recall(asked, episodes.where("field >= '2024-01-08'"), ["query"])
    return found.groupBy("query").agg(F.count("*").alias("n"), r6(F.max("similarity"), "best"), r6(F.min("similarity"), "least"), F.count_if(F.col("outcome") == "healed").alias("healed"))


Q_RECALL = (
    EPISODES_SQL
    + """, q AS (SELECT DISTINCT array_to_string(signals, '+') AS query, signals, diff_class FROM e WHERE field < '2024-01-08'),
s AS (SELECT query, e.outcome, round(0.65::DOUBLE * len(list_intersect(q.signals, e.signals)) / len(list_distinct(list_concat(q.signals, e.signals))) + 0.35::DOUBLE * (q.diff_class = e.diff_class)::INT, 4) AS sim FROM q, e WHERE e.field >= '2024-01-08'),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, outcome = 'healed' DESC) AS place FROM s WHERE sim >= 0.55)
SELECT query, count(*) AS n, round(max(sim), 6) AS best, round(min(sim), 6) AS least, count(*) FILTER (outcome = 'healed') AS healed FROM r WHERE place <= 3 GROUP BY 1
"""
)


def q_promote(spark, sf_dir):
    """Each customer's locator stack after one more is promoted: six entries at most."""
    n = (F.col("c_custkey") % 7).cast("int")
    stack = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("sig"), F.when((F.col("c_custkey") + i) % 3 == 0, i.cast("long")).alias("hit")))
    new = F.struct(F.concat(F.lit("s"), ((F.col("c_custkey") % 9) + 2).cast("string")).alias("sig"), F.lit(None).cast("long").alias("hit"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(patch.promoted(stack, new), lambda x: x["sig"]), ",").alias("stack"))


Q_PROMOTE = """
WITH b AS (SELECT c_custkey, 's' || (c_custkey % 9 + 2) AS new, list_transform(range(0, c_custkey % 7 + 1), lambda i: {'sig': 's' || i, 'idle': (c_custkey + i) % 3 <> 0}) AS s FROM customer),
j AS (SELECT c_custkey, list_concat([{'sig': new, 'idle': true}], list_filter(s, lambda x: x.sig <> new)) AS j FROM b),
a AS (SELECT *, coalesce(list_max(list_filter(range(2, len(j) + 1), lambda i: j[i].idle)), len(j)) AS cut FROM j)
SELECT c_custkey, array_to_string(list_transform(CASE WHEN len(j) > 6 THEN list_concat(j[:cut - 1], j[cut + 1:]) ELSE j END, lambda x: x.sig), ',') AS stack FROM a
"""


def q_spec_lineage(spark, sf_dir):
    """Orders of a customer as versions of a spec: each with its parent and depth."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    specs = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.lag("o_orderkey").over(w).alias("parent"), F.row_number().over(w).cast("long").alias("depth"))
    return specs.join(specs.select("o_custkey", F.col("version").alias("parent"), F.col("depth").alias("parent_depth")), ["o_custkey", "parent"], "left").select("o_custkey", "version", "parent", "depth", "parent_depth")


Q_SPEC_LINEAGE = "SELECT o_custkey, version, parent, depth, CASE WHEN depth > 1 THEN depth - 1 END AS parent_depth FROM (SELECT o_custkey, o_orderkey AS version, lag(o_orderkey) OVER w AS parent, row_number() OVER w AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def q_gates(spark, sf_dir):
    """Suppliers as sites: two scores, and severities of their nation's parts before and after."""
    s = table(spark, sf_dir, "supplier")
    scores = s.select("s_suppkey", (1 - (F.col("s_suppkey") % 10) / 50).alias("f1_broken"), (1 - (F.col("s_suppkey") % 7) / 50).alias("f1_old"))
    fields = s.select("s_suppkey", F.explode(F.array(*map(F.lit, ("<record>", "a", "b")))).alias("field"))
    level = lambda k: F.when((F.col("s_suppkey") + F.char_length("field")) % k == 0, "critical").otherwise("ok")
    return patch.gates(scores, fields.withColumn("severity", level(3)), fields.withColumn("severity", level(4)), ["s_suppkey"])


Q_GATES = """
WITH f AS (SELECT s_suppkey, unnest(['<record>', 'a', 'b']) AS field FROM supplier), x AS (SELECT *, (s_suppkey + length(field)) % 3 = 0 AS was, (s_suppkey + length(field)) % 4 = 0 AS now FROM f),
b AS (SELECT s_suppkey, count(*) FILTER (now AND (was OR field <> '<record>')) AS bad FROM x GROUP BY 1)
SELECT s_suppkey, g1, g2, bad = 0 AS g3, g1 AND g2 AND bad = 0 AS passed FROM (SELECT s_suppkey, bad, 1 - (s_suppkey % 10) / 50 >= 0.9 AS g1, 1 - (s_suppkey % 7) / 50 >= 0.9 AS g2 FROM supplier JOIN b USING (s_suppkey))
"""


def q_truth_unique(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"))


Q_TRUTH_UNIQUE = "SELECT count(*) AS keys, count(*) FILTER (n > 1) AS repeated FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)"


def q_truth_descent(spark, sf_dir):
    """Users whose values, in order of time, never rise."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rises = table(spark, sf_dir, "events").where("value is not null").select("user_id", (F.col("value") >= F.lag("value").over(w)).alias("rise"))
    return rises.groupBy("user_id").agg(F.count_if("rise").alias("rises"), (F.count_if("rise") == 0).alias("descends"))


Q_TRUTH_DESCENT = "SELECT user_id, count(*) FILTER (rise) AS rises, count(*) FILTER (rise) = 0 AS descends FROM (SELECT user_id, value >= lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rise FROM events WHERE value IS NOT NULL) GROUP BY 1"


def q_truth_leak(spark, sf_dir):
    """Pages whose host shows up in their own title."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("url", "//([^./]*)", 1).alias("host"))
    return pages.select("page_id", F.contains("title", F.col("host")).alias("leaks"))


Q_TRUTH_LEAK = "SELECT page_id, contains(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), regexp_extract(url, '//([^./]*)', 1)) AS leaks FROM pages"


def q_eval_summary(spark, sf_dir):
    """Orders as healing cases: every metric has its own denominator."""
    cases = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3 == 0).alias("degraded"), (F.col("o_orderstatus") == "F").alias("healed"), (F.col("o_orderstatus") == "P").alias("quarantined"), (F.month("o_orderdate") % 4 + 1).alias("cycles"), (F.col("o_totalprice") / 1e6).alias("f1"))
    d = F.col("degraded")
    return cases.agg(F.count("*").alias("cases"), F.count_if(d).alias("n_degraded"), r6(stats.share(F.count_if(d & F.col("healed")), F.count_if(d)), "recovery"), r6(stats.share(F.count_if(d & F.col("quarantined")), F.count_if(d)), "quarantine"), F.count_if(~d & F.col("healed")).alias("healthy_damage"), r6(F.avg(F.when(d & F.col("healed"), F.col("cycles"))), "mean_cycles"), r6(F.avg(F.when(d, F.col("f1"))), "mean_f1"))


Q_EVAL_SUMMARY = """
WITH c AS (SELECT o_orderkey % 3 = 0 AS d, o_orderstatus = 'F' AS h, o_orderstatus = 'P' AS q, month(o_orderdate) % 4 + 1 AS cycles, o_totalprice / 1e6 AS f1 FROM orders)
SELECT count(*) AS cases, count(*) FILTER (d) AS n_degraded, round(count(*) FILTER (d AND h) / count(*) FILTER (d), 6) AS recovery, round(count(*) FILTER (d AND q) / count(*) FILTER (d), 6) AS quarantine, count(*) FILTER (NOT d AND h) AS healthy_damage, round(avg(cycles) FILTER (d AND h), 6) AS mean_cycles, round(avg(f1) FILTER (d), 6) AS mean_f1 FROM c
"""


# --- the ten signals: events of the first half of January are the baseline, of the second a broken run -------------


def _run(spark, sf_dir):
    """(base, now): event types as fields; the second half has lost, moved, constant, negative and future values."""
    e = halves(spark, sf_dir).select("side", F.col("event_type").alias("field"), F.col("event_id").alias("record"), "value", F.to_date("ts").cast("string").alias("day"))
    k, v = F.col("record") % 10, F.col("value")
    now = (F.col("side") == 1)
    broken = F.when(~now, v).when((F.col("field") == "view") & (k < 4), None).when(F.col("field") == "click", F.lit(7.0)).when((F.col("field") == "purchase") & (k < 2), -v).when(F.col("field") == "signup", v * 3 + 100).otherwise(v)
    number = F.round(broken, 2)
    tier = F.when(number.isNull(), None).when(now & (F.col("field") == "signup"), 1).when(now & (k == 0), 2).otherwise(0)
    fail = F.when(now & number.isNull() & (k < 3), "number")
    return e.select("side", F.lit("events").alias("site"), "field", "record", number.alias("number"), F.round(number * 100).cast("bigint").cast("string").alias("value"), tier.alias("tier"), F.when(number.isNull(), 0).when(now & (F.col("field") == "error"), 2).otherwise(1).alias("n_hits"), fail.alias("failed_validator"))


RUN_SQL = f"""
e AS (SELECT (ts >= TIMESTAMP '{HALF}')::INT AS side, event_type AS field, event_id AS record, value AS v, event_id % 10 AS k FROM events),
b AS (SELECT side, field, record, k, round(CASE WHEN side = 0 THEN v WHEN field = 'view' AND k < 4 THEN NULL WHEN field = 'click' THEN 7.0::DOUBLE WHEN field = 'purchase' AND k < 2 THEN -v WHEN field = 'signup' THEN v * 3 + 100 ELSE v END, 2) AS number FROM e),
r AS (SELECT side, field, record, number, round(number * 100)::BIGINT::VARCHAR AS value, CASE WHEN number IS NULL THEN NULL WHEN side = 1 AND field = 'signup' THEN 1 WHEN side = 1 AND k = 0 THEN 2 ELSE 0 END AS tier,
  CASE WHEN number IS NULL THEN 0 WHEN side = 1 AND field = 'error' THEN 2 ELSE 1 END AS n_hits, CASE WHEN side = 1 AND number IS NULL AND k < 3 THEN 'number' END AS failed FROM b),
modal AS (SELECT side, field, tier FROM (SELECT side, field, tier, row_number() OVER (PARTITION BY side, field ORDER BY c DESC, tier) AS p FROM (SELECT side, field, tier, count(*) AS c FROM r WHERE tier IS NOT NULL GROUP BY ALL)) WHERE p = 1),
st AS (SELECT side, field, count(*) AS n, count(value) AS present, count(value) / count(*) AS fill, CASE WHEN count(value) > 0 THEN count(DISTINCT value) / count(value) ELSE 1 END AS dr, coalesce(median(number), 0) AS med, list_sort(list(number) FILTER (number IS NOT NULL)) AS s,
  coalesce(bool_and(number > 0), false) AS pos, coalesce(avg(nullif(n_hits, 0)), 0) AS mm, count(failed) AS failed, count(*) FILTER (number <= 0) AS neg FROM r GROUP BY 1, 2),
sample AS (SELECT field, number, value FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY record) AS p FROM r WHERE side = 0 AND value IS NOT NULL) WHERE p <= 400),
both_sides AS (SELECT field, number, 1 AS side FROM r WHERE side = 1 AND value IS NOT NULL UNION ALL SELECT field, number, 0 FROM sample),
nn AS (SELECT field, sum(1 - side) AS na, sum(side) AS nb FROM both_sides GROUP BY 1),
gap AS (SELECT field, number, sum(sum(1 - side)) OVER w AS a, sum(sum(side)) OVER w AS b FROM both_sides GROUP BY field, number WINDOW w AS (PARTITION BY field ORDER BY number)),
ks AS (SELECT field, coalesce(max(abs(a / na - b / nb)), 0) AS ks FROM gap JOIN nn USING (field) GROUP BY 1),
mv AS (SELECT r.field, count(*) FILTER (r.tier <> mb.tier) / count(*) AS moved FROM r JOIN modal mb ON mb.field = r.field AND mb.side = 0 WHERE r.side = 1 AND r.tier IS NOT NULL GROUP BY 1),
nv AS (SELECT r.field, avg((s.value IS NULL)::INT) AS novel FROM r LEFT JOIN (SELECT DISTINCT field, value FROM sample) s ON s.field = r.field AND s.value = r.value WHERE r.side = 1 AND r.value IS NOT NULL GROUP BY 1),
x AS (SELECT b.field, a.n, a.present, coalesce(a.fill, 0) AS fill, b.fill AS bfill, a.dr, b.dr AS bdr, a.med, b.med AS bmed, CASE WHEN len(b.s) < 4 THEN 0 ELSE b.s[floor(0.75 * (len(b.s) - 1))::BIGINT + 1] - b.s[floor(0.25 * (len(b.s) - 1))::BIGINT + 1] END AS biqr, b.pos AS bpos, a.mm, b.mm AS bmm, a.failed, a.neg,
    ma.tier AS modal, mb.tier AS bmodal, ks.ks, mv.moved, nv.novel
  FROM st b JOIN st a ON a.field = b.field AND a.side = 1 AND b.side = 0 JOIN modal ma ON ma.field = b.field AND ma.side = 1 JOIN modal mb ON mb.field = b.field AND mb.side = 0 JOIN ks ON ks.field = b.field JOIN mv ON mv.field = b.field JOIN nv ON nv.field = b.field),
own AS (SELECT DISTINCT field, value FROM r WHERE side = 1 AND value IS NOT NULL), oth AS (SELECT DISTINCT field AS other, value FROM sample),
ov AS (SELECT field, other, count(*) AS o FROM own JOIN oth USING (value) GROUP BY 1, 2), sz AS (SELECT field, count(*) AS d FROM own GROUP BY 1),
wrong AS (SELECT field, max(o / d) FILTER (other <> field) AS away, coalesce(max(o / d) FILTER (other = field), 0) AS home FROM ov JOIN sz USING (field) GROUP BY 1),
c AS (SELECT x.*, w.away, w.home, greatest((ks - 0.4) / 0.6, abs(med - bmed) / CASE WHEN biqr > 0 THEN biqr WHEN bmed <> 0 THEN abs(bmed) ELSE 1 END - 0.25) AS drift FROM x LEFT JOIN wrong w ON w.field = x.field),
sig AS (
  SELECT field, 'fill_drop' AS signal, 3 AS ord, 1.0::DOUBLE AS weight, CASE WHEN NOT (bfill - fill <= 0.02 AND fill >= least(0.95, bfill)) THEN greatest(0, least(1, greatest((bfill - fill) / greatest(bfill, 0.01), (0.95 - fill) / 0.95))) END AS m FROM c
  UNION ALL SELECT field, 'tier_shift', 1, 0.85, CASE WHEN modal <> bmodal OR moved >= 0.1 THEN greatest(0, least(1, CASE WHEN modal > bmodal THEN greatest(0, least(1, 0.45 + 0.2 * (modal - bmodal))) ELSE 0.3 END * (0.5 + 0.5 * moved))) END FROM c
  UNION ALL SELECT field, 'match_count', 4, 0.85, CASE WHEN mm > 0 AND mm > bmm + 0.15 THEN greatest(0, least(1, mm - bmm)) END FROM c
  UNION ALL SELECT field, 'validator_fail', 5, 0.8, CASE WHEN failed > 0 THEN least(1, failed / n / 0.5) END FROM c
  UNION ALL SELECT field, 'value_drift', 6, 0.55, CASE WHEN drift > 0 THEN least(1, drift) END FROM c
  UNION ALL SELECT field, 'constant_collapse', 7, 0.9, CASE WHEN present >= 3 AND bdr >= 0.35 AND dr < bdr / 2 THEN greatest(0, least(1, (bdr - dr) / greatest(bdr, 0.01))) END FROM c
  UNION ALL SELECT field, 'invariant', 8, 1.0, greatest(CASE WHEN bpos AND neg > 0 THEN least(1, neg / greatest(present, 1)) END, CASE WHEN away > 0.5 AND home < 0.5 THEN 0.8 END) FROM c
  UNION ALL SELECT field, 'novel_values', 9, 0.25, CASE WHEN novel >= 0.5 THEN least(1, (novel - 0.5) / 0.5) END FROM c)
"""


def _signals(spark, sf_dir):
    r = _run(spark, sf_dir)
    return health.signals(r.where("side = 1"), health.baseline_of(r.where("side = 0"), ["site"]), ["site"], "2024-12-31")


def _signal_query(name):
    def query(spark, sf_dir):
        return _signals(spark, sf_dir).where(F.col("signal") == name).select("field", r6(F.col("magnitude"), "magnitude"))

    query.__name__ = f"q_sig_{name}"
    return query


FIELD_SIGNALS = ("fill_drop", "tier_shift", "match_count", "validator_fail", "value_drift", "constant_collapse", "invariant", "novel_values")


def _headers(spark, sf_dir):
    """Sources of documents as sites: records are documents, their shape the label pattern; two snapshots by id."""
    side = (F.floor(F.col("doc_id") / 20) % 2).cast("int")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("source", side.alias("side"), F.concat_ws(",", F.when(F.col("quality") == 1, "quality"), F.when((F.col("toxic") == 1) | (side == 1) & (F.col("doc_id") % 7 < 2), "toxic")).alias("shape"), "doc_id").where("side = 0 or doc_id % 9 < 7")
    n = d.groupBy("source", "side").agg(F.count("*").alias("n_records"), (F.max(F.col("doc_id") % 3) - F.col("side")).cast("int").alias("root_tier"))
    n = n.join(stats.entropy(d.select("source", "side", "shape"), ["source", "side"], "shape", "shape_entropy"), ["source", "side"])
    return n.where("side = 0").drop("side"), n.where("side = 1").drop("side").withColumn("errors", F.when(F.col("n_records") % 2 == 0, F.array(F.lit("counts differ"))).otherwise(F.array().cast("array<string>")))


HEADERS_SQL = """
d AS (SELECT source, doc_id, doc_id // 20 % 2 AS side, concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 OR doc_id // 20 % 2 = 1 AND doc_id % 7 < 2 THEN 'toxic' END) AS shape FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id // 20 % 2 = 0 OR doc_id % 9 < 7),
h AS (SELECT source, side, count(*) AS n, max(doc_id % 3) - side AS root, entropy(shape) AS shape FROM d GROUP BY 1, 2),
hx AS (SELECT a.source, a.n, b.n AS bn, a.root, b.root AS broot, a.shape, b.shape AS bshape FROM h a JOIN h b ON a.source = b.source AND a.side = 1 AND b.side = 0),
hs AS (SELECT source, 'record_count' AS signal, 0 AS ord, 1.0::DOUBLE AS weight, CASE WHEN abs(n - bn) / bn > 0.05 THEN least(1, abs(n - bn) / bn / 0.5) END AS m FROM hx
  UNION ALL SELECT source, 'tier_shift', 1, 0.85, CASE WHEN root <> broot THEN greatest(0, least(1, 0.5 + 0.25 * abs(root - broot))) END FROM hx
  UNION ALL SELECT source, 'shape_entropy', 2, 0.5, CASE WHEN shape > bshape + 0.15 THEN greatest(0, least(1, shape - bshape)) END FROM hx
  UNION ALL SELECT source, 'invariant', 8, 1.0, CASE WHEN n % 2 = 0 THEN 0.6 END FROM hx)
"""


def q_sig_record(spark, sf_dir):
    """Record count, root tier, shape entropy and runtime errors: the signals of the record pseudo-field."""
    base, now = _headers(spark, sf_dir)
    return health.record_signals(now, base, ["source"]).select("source", "field", "signal", r6(F.col("magnitude"), "magnitude"))


Q_SIG_RECORD = f"WITH {HEADERS_SQL} SELECT source, '<record>' AS field, signal, round(m::DOUBLE, 6) AS magnitude FROM hs WHERE m IS NOT NULL"


def q_health(spark, sf_dir):
    found = health.report(_signals(spark, sf_dir), ["site"])
    return found.select("field", r6(F.col("score"), "score"), "severity", "n_signals", "fired", F.col("place").cast("long").alias("place"))


Q_HEALTH = f"""
WITH {RUN_SQL}, p AS (SELECT field, 1 - product(1 - m * weight) AS score, count(*) AS n_signals FROM sig WHERE m IS NOT NULL GROUP BY 1)
SELECT field, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN 'critical' WHEN score >= 0.3 THEN 'warn' ELSE 'ok' END AS severity, n_signals, (max(score) OVER ()) >= 0.6 AS fired, row_number() OVER (ORDER BY score DESC, field) AS place FROM p
"""


def q_health_record(spark, sf_dir):
    base, now = _headers(spark, sf_dir)
    return health.health(health.record_signals(now, base, ["source"]), ["source"]).select("source", r6(F.col("score"), "score"), "severity", "n_signals")


Q_HEALTH_RECORD = f"WITH {HEADERS_SQL}, p AS (SELECT source, 1 - product(1 - m * weight) AS score, count(*) AS n_signals FROM hs WHERE m IS NOT NULL GROUP BY 1) SELECT source, round(score, 6) AS score, CASE WHEN score >= 0.6 - 1e-12 THEN 'critical' WHEN score >= 0.3 THEN 'warn' ELSE 'ok' END AS severity, n_signals FROM p"

QUERIES = {f.__name__: f for f in (q_prior, q_strategy, q_candidate_score, q_ambiguity, q_recall, q_promote, q_spec_lineage, q_gates, q_truth_unique, q_truth_descent, q_truth_leak, q_eval_summary, q_sig_record, q_health, q_health_record, *map(_signal_query, FIELD_SIGNALS))}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
SQL |= {f"q_sig_{s}": f"WITH {RUN_SQL} SELECT field, round(m::DOUBLE, 6) AS magnitude FROM sig WHERE signal = '{s}' AND m IS NOT NULL" for s in FIELD_SIGNALS}
