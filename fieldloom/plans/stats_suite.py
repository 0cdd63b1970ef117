"""Queries of the statistics layer and of scoring."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.values import tokens
from fieldloom.operators import scoring, stack, stats
from fieldloom.plans.values_suite import table

HALF = "2024-01-16"


def r6(c, name):
    return F.round(c, 6).alias(name)


def halves(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("side", (F.col("ts") >= F.lit(HALF).cast("timestamp_ntz")).cast("int"))


def q_fill_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(r6(stats.fill_rate(F.col("quality")), "fill"), F.count("*").alias("n")).withColumn("below_floor", F.col("fill") < 0.4)


Q_FILL_RATE = "SELECT source, round(count(quality) / count(*), 6) AS fill, count(*) AS n, round(count(quality) / count(*), 6) < 0.4::DOUBLE AS below_floor FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def q_distinct_rate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(r6(stats.distinct_rate(F.col("text")), "distinct_rate"))


Q_DISTINCT_RATE = "SELECT lang, round(count(DISTINCT text) / count(text), 6) AS distinct_rate FROM documents GROUP BY lang"


def q_modal_tier(spark, sf_dir):
    return stack.modal(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), ["l_returnflag"], "l_linenumber", "modal_tier").withColumn("modal_tier", F.col("modal_tier").cast("bigint"))


Q_MODAL_TIER = "SELECT l_returnflag, l_linenumber::BIGINT AS modal_tier, c AS times FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY c DESC, l_linenumber) AS r FROM (SELECT l_returnflag, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)) WHERE r = 1"


def q_median_iqr(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"), "l_extendedprice")
    return rows.groupBy("year").agg(r6(F.median("l_extendedprice"), "median")).join(stats.ranked_iqr(rows, ["year"], "l_extendedprice"), "year").select("year", "median", r6(F.col("iqr"), "iqr"))


Q_MEDIAN_IQR = """
SELECT year, round(m, 6) AS median, round(CASE WHEN n < 4 THEN 0 ELSE s[floor(0.75 * (n - 1))::BIGINT + 1] - s[floor(0.25 * (n - 1))::BIGINT + 1] END, 6) AS iqr
FROM (SELECT year(l_shipdate) AS year, median(l_extendedprice) AS m, list_sort(list(l_extendedprice)) AS s, count(*) AS n FROM lineitem GROUP BY 1)
"""


def q_ks(spark, sf_dir):
    return stats.ks_statistic(halves(spark, sf_dir), ["event_type"], "value", "side").select("event_type", r6(F.col("ks"), "ks"))


Q_KS = f"""
WITH e AS (SELECT event_type, value, (ts >= TIMESTAMP '{HALF}')::INT AS side FROM events WHERE value IS NOT NULL), n AS (SELECT event_type, sum(1 - side) AS na, sum(side) AS nb FROM e GROUP BY 1),
g AS (SELECT event_type, value, sum(sum(1 - side)) OVER w AS a, sum(sum(side)) OVER w AS b FROM e GROUP BY event_type, value WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_type, round(max(abs(a / na - b / nb)), 6) AS ks FROM g JOIN n USING (event_type) GROUP BY 1
"""


def q_tvd(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    mid = orders.select("o_orderpriority", F.lit("all").alias("k"), (F.month("o_orderdate") > 6).cast("int").alias("side"))
    return stats.total_variation(mid, ["k"], "o_orderpriority", "side").select("k", r6(F.col("tvd"), "tvd"))


Q_TVD = """
WITH o AS (SELECT o_orderpriority, (month(o_orderdate) > 6)::INT AS side FROM orders), c AS (SELECT o_orderpriority, sum(1 - side) AS a, sum(side) AS b FROM o GROUP BY 1)
SELECT 'all' AS k, round(sum(abs(a / (SELECT sum(a) FROM c) - b / (SELECT sum(b) FROM c))) / 2, 6) AS tvd FROM c
"""


def q_token_jaccard(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select("role", F.explode(tokens(F.col("text"))).alias("word"))
    words = rows.groupBy("word").agg(F.max((F.col("role") == "user").cast("int")).alias("a"), F.max((F.col("role") == "assistant").cast("int")).alias("b"))
    return words.agg(F.sum(F.col("a") * F.col("b")).cast("bigint").alias("shared"), F.count("*").alias("either"), r6(F.sum(F.col("a") * F.col("b")) / F.count("*"), "jaccard"))


Q_TOKEN_JACCARD = """
WITH w AS (SELECT DISTINCT role, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM conversations WHERE role IN ('user', 'assistant')), g AS (SELECT word, count(*) AS k FROM w GROUP BY 1)
SELECT sum((k = 2)::INT)::BIGINT AS shared, count(*) AS either, round(sum((k = 2)::INT) / count(*), 6) AS jaccard FROM g
"""


def q_entropy(spark, sf_dir):
    return stats.entropy(table(spark, sf_dir, "documents").select("source", "lang"), ["source"], "lang").select("source", r6(F.col("entropy"), "entropy"))


Q_ENTROPY = "SELECT source, round(coalesce(entropy(lang), 0), 6) AS entropy FROM documents GROUP BY source"


def q_shape_entropy(spark, sf_dir):
    """Entropy over which fields a record has, by source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    shape = F.concat_ws(",", F.when(F.col("n_chars") > 1000, "body"), F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    return stats.entropy(rows.select("source", shape.alias("shape")), ["source"], "shape").select("source", r6(F.col("entropy"), "shape_entropy"))


Q_SHAPE_ENTROPY = "SELECT source, round(entropy(concat_ws(',', CASE WHEN n_chars > 1000 THEN 'body' END, CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END)), 6) AS shape_entropy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def q_len_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.char_length("text").alias("n"))
    whole = docs.agg(F.avg("n").alias("mean"))
    return docs.groupBy("source").agg(F.avg("n").alias("own")).join(F.broadcast(whole)).select("source", r6(F.log2(F.col("own") / F.col("mean")), "log_ratio"))


Q_LEN_RATIO = "SELECT source, round(log2(avg(length(text)) / (SELECT avg(length(text)) FROM documents)), 6) AS log_ratio FROM documents GROUP BY source"


def q_ewma_fold(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("ord")).agg(F.avg("value").alias("value")).where("value is not null")
    return daily.groupBy("event_type").agg(r6(stats.ewma(F.collect_list(F.struct("ord", "value"))), "level"))


Q_EWMA_FOLD = """
SELECT event_type, round(list_reduce(list(v ORDER BY d), lambda a, b: 0.7::DOUBLE * a + 0.3::DOUBLE * b), 6) AS level
FROM (SELECT event_type, ts::DATE AS d, avg(value) AS v FROM events GROUP BY ALL HAVING avg(value) IS NOT NULL) GROUP BY 1
"""


def q_sample_cap(spark, sf_dir):
    first = stats.first_values(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], "value")
    return first.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), r6(F.sum("value"), "total"))


Q_SAMPLE_CAP = "SELECT event_type, count(*) AS n, max(event_id) AS last_event, round(sum(value), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r <= 400 GROUP BY 1"


def _two_runs(spark, sf_dir):
    """Line items as predicted and known values of one field, by return flag; a tenth of the prediction is off."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    pred = items.where("l_orderkey % 11 <> 0").select("l_returnflag", (F.col("q") + (F.col("l_orderkey") % 10 == 0).cast("int") * 50).cast("string").alias("value"))
    truth = items.where("l_linenumber <= 4").select("l_returnflag", F.col("q").cast("string").alias("value"))
    return pred, truth


TWO_RUNS = """
p AS (SELECT l_returnflag, (l_quantity::BIGINT + CASE WHEN l_orderkey % 10 = 0 THEN 50 ELSE 0 END)::VARCHAR AS value FROM lineitem WHERE l_orderkey % 11 <> 0),
t AS (SELECT l_returnflag, l_quantity::BIGINT::VARCHAR AS value FROM lineitem WHERE l_linenumber <= 4),
c AS (SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(p, 0) AS p, coalesce(t, 0) AS t FROM (SELECT l_returnflag, value, count(*) AS p FROM p GROUP BY ALL) a FULL JOIN (SELECT l_returnflag, value, count(*) AS t FROM t GROUP BY ALL) b ON a.l_returnflag = b.l_returnflag AND a.value = b.value),
s AS (SELECT l_returnflag, sum(least(p, t)) / sum(p) AS pr, sum(least(p, t)) / sum(t) AS re FROM c GROUP BY 1)
"""


def q_multiset_f1(spark, sf_dir):
    pred, truth = _two_runs(spark, sf_dir)
    m = scoring.matched(pred, truth, ["l_returnflag"], "value")
    p, r, f = scoring.f1(F.col("hit"), F.col("predicted"), F.col("true"))
    return m.select("l_returnflag", p, r, f).select("l_returnflag", *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


Q_MULTISET_F1 = f"WITH {TWO_RUNS} SELECT l_returnflag, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM s"


def q_record_em(spark, sf_dir):
    """Line items against themselves with another quantity on every third line of an order."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"))
    fields = ["l_linenumber", "l_linestatus", "q"]
    changed = items.withColumn("q", F.col("q") + (F.col("l_linenumber") % 3 == 0).cast("bigint"))
    return scoring.exact_records(changed, items, ["l_returnflag"], fields).select("l_returnflag", "matched", "true", r6(F.col("record_em"), "record_em"))


Q_RECORD_EM = """
WITH t AS (SELECT l_returnflag, l_linenumber, l_linestatus, l_quantity::BIGINT AS q, count(*) AS t FROM lineitem GROUP BY ALL), p AS (SELECT l_returnflag, l_linenumber, l_linestatus, l_quantity::BIGINT + (l_linenumber % 3 = 0)::BIGINT AS q, count(*) AS p FROM lineitem GROUP BY ALL)
SELECT l_returnflag, sum(least(t, coalesce(p, 0)))::BIGINT AS matched, sum(t)::BIGINT AS true, round(sum(least(t, coalesce(p, 0))) / sum(t), 6) AS record_em FROM t LEFT JOIN p USING (l_returnflag, l_linenumber, l_linestatus, q) GROUP BY 1
"""


def q_silent(spark, sf_dir):
    """Sources whose labels look complete and disagree with a rule on length: full output that is wrong."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", "doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("quality").cast("string")).alias("value"), (F.col("n_chars") > 400).cast("int").cast("string").alias("truth"))
    m = scoring.matched(rows.select("source", "value"), rows.select("source", F.col("truth").alias("value")), ["source"], "value")
    fill = rows.groupBy("source").agg(stats.fill_rate(F.col("value")).alias("fill"))
    p, r, f = scoring.f1(F.col("hit"), F.col("predicted"), F.col("true"))
    return m.select("source", f).join(fill, "source").select("source", r6(F.col("fill"), "fill"), r6(F.col("f1"), "f1"), scoring.silent(F.round("fill", 6), F.round("f1", 6)).alias("silent"))


Q_SILENT = """
WITH x AS (SELECT source, CASE WHEN doc_id % 13 <> 0 THEN quality::VARCHAR END AS v, (n_chars > 400)::INT::VARCHAR AS t FROM documents JOIN labels USING (doc_id)),
k AS (SELECT source, sum((v = '1')::INT) AS p1, sum((v = '0')::INT) AS p0, sum((t = '1')::INT) AS t1, sum((t = '0')::INT) AS t0, count(v) / count(*) AS fill FROM x GROUP BY 1),
f AS (SELECT source, round(fill, 6) AS fill, round(2 * (least(p1, t1) + least(p0, t0)) / (p1 + p0 + t1 + t0), 6) AS f1 FROM k)
SELECT *, fill >= 0.9 AND f1 < 0.9 AS silent FROM f
"""


def q_wrong_node(spark, sf_dir):
    """Values of one column that belong to another: nations' names against regions' and themselves."""
    own = table(spark, sf_dir, "supplier").select(F.regexp_extract("s_name", "[0-9]+", 0).cast("bigint").alias("v")).distinct()
    known = table(spark, sf_dir, "customer").select(F.lit("customer").alias("other"), F.regexp_extract("c_name", "[0-9]+", 0).cast("bigint").alias("v")).union(table(spark, sf_dir, "nation").select(F.lit("nation"), F.col("n_nationkey").cast("bigint"))).distinct()
    return own.crossJoin(F.broadcast(own.agg(F.count("*").alias("d")))).join(known, "v").groupBy("other").agg(F.count("*").alias("overlap"), r6(F.count("*") / F.max("d"), "part"))


Q_WRONG_NODE = """
WITH o AS (SELECT DISTINCT regexp_extract(s_name, '[0-9]+')::BIGINT AS v FROM supplier), k AS (SELECT DISTINCT 'customer' AS other, regexp_extract(c_name, '[0-9]+')::BIGINT AS v FROM customer UNION SELECT 'nation', n_nationkey::BIGINT FROM nation)
SELECT other, count(*) AS overlap, round(count(*) / (SELECT count(*) FROM o), 6) AS part FROM o JOIN k USING (v) GROUP BY 1
"""


def q_kendall(spark, sf_dir):
    """Concordance of date order and price order over each status's 250 first orders (the operator's own bound)."""
    w = Window.partitionBy("o_orderstatus")
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_orderdate", "o_totalprice").withColumn("a", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))).where("a <= 250")
    ranked = orders.withColumn("b", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")))
    return stats.kendall(ranked, ["o_orderstatus"], "a", "b").select("o_orderstatus", r6(F.col("concordance"), "concordance"))


Q_KENDALL = """
WITH a AS (SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS a FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS b FROM a WHERE a <= 250)
SELECT x.o_orderstatus, round(sum((x.b < y.b)::INT) / count(*), 6) AS concordance FROM b x JOIN b y ON x.o_orderstatus = y.o_orderstatus AND x.a < y.a GROUP BY 1
"""

QUERIES = {f.__name__: f for f in (q_fill_rate, q_distinct_rate, q_modal_tier, q_median_iqr, q_ks, q_tvd, q_token_jaccard, q_entropy, q_shape_entropy, q_len_ratio, q_ewma_fold, q_sample_cap, q_multiset_f1, q_record_em, q_silent, q_wrong_node, q_kendall)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
