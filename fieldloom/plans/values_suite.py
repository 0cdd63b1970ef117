"""Queries of the value layer: transforms, validators, JSON paths, the fallback stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import validators, values
from fieldloom.operators import stack


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money_text():
    """Order totals rendered in six ways, by key: one unreadable, one so from a thousand on."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, rest = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    low = F.lpad((whole % 1000).cast("string"), 3, "0")
    high = F.floor(whole / 1000).cast("bigint").cast("string")
    k = F.col("o_orderkey") % 6
    grouped = lambda s: F.when(whole >= 1000, F.concat(high, F.lit(s), low)).otherwise(whole.cast("string"))
    return (
        F.when(k == 0, F.concat(F.lit("$"), grouped(","), F.lit("."), rest)).when(k == 1, F.concat(F.lit("EUR "), grouped("."), F.lit(","), rest)).when(k == 2, F.concat(grouped(" "), F.lit(","), rest))
        .when(k == 3, F.concat(F.lit("USD "), whole.cast("string"), F.lit(","), rest)).when(k == 4, F.lit("1e5")).otherwise(F.concat(grouped(","), F.lit(","), rest))
    )


MONEY_TEXT_SQL = """
  SELECT o_orderkey, k, CASE k WHEN 0 THEN '$' || replace(g, '_', ',') || '.' || r WHEN 1 THEN 'EUR ' || replace(g, '_', '.') || ',' || r
    WHEN 2 THEN replace(g, '_', ' ') || ',' || r WHEN 3 THEN 'USD ' || w || ',' || r WHEN 4 THEN '1e5' ELSE replace(g, '_', ',') || ',' || r END AS t
  FROM (SELECT o_orderkey, o_orderkey % 6 AS k, w, lpad((c % 100)::VARCHAR, 2, '0') AS r,
      CASE WHEN w >= 1000 THEN (w // 1000)::VARCHAR || '_' || lpad((w % 1000)::VARCHAR, 3, '0') ELSE w::VARCHAR END AS g
    FROM (SELECT o_orderkey, c, c // 100 AS w FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)))
"""


def q_t_money(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", money_text().alias("t")).select("o_orderkey", F.col("t").alias("rendered"), values.money(F.col("t")).alias("amount"))


Q_T_MONEY = f"""
WITH x AS ({MONEY_TEXT_SQL}), j AS (SELECT *, regexp_extract(CASE WHEN k = 2 THEN replace(t, ' ', '') ELSE t END, '-?[0-9][0-9.,]*') AS n FROM x)
SELECT o_orderkey, t AS rendered, CASE WHEN regexp_matches(t, '[0-9][eE][+-]?[0-9]') THEN NULL
  WHEN contains(n, ',') AND contains(n, '.') THEN CASE WHEN length(n) - instr(reverse(n), ',') > length(n) - instr(reverse(n), '.') THEN TRY_CAST(replace(replace(n, '.', ''), ',', '.') AS DOUBLE) ELSE TRY_CAST(replace(n, ',', '') AS DOUBLE) END
  WHEN contains(n, ',') THEN CASE WHEN regexp_matches(n, ',[0-9][0-9]$') THEN TRY_CAST(replace(n, ',', '.') AS DOUBLE) ELSE TRY_CAST(replace(n, ',', '') AS DOUBLE) END
  ELSE TRY_CAST(n AS DOUBLE) END AS amount FROM j
"""


def q_t_int(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", values.int_value(F.col("c_name")).alias("number"), values.digits(F.col("c_name")).alias("digits"))


Q_T_INT = "SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '-?[0-9]+') AS BIGINT) AS number, nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS digits FROM customer"


def q_t_digits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.digits(F.col("props")).alias("digits"), values.int_value(F.col("props")).alias("number"))


Q_T_DIGITS = "SELECT event_id, nullif(regexp_replace(props, '[^0-9]', '', 'g'), '') AS digits, TRY_CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS number FROM events"


def q_t_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    talks = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    text = values.normal_text(F.col("text"))
    return docs.unionByName(talks).select("kind", "id", "turn", F.md5(text).alias("text_md5"), F.char_length(text).cast("long").alias("n"))


Q_T_TEXT = r"""
SELECT kind, id, turn, md5(t) AS text_md5, length(t) AS n FROM (
  SELECT kind, id, turn, nullif(trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '') AS t
  FROM (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS turn, text FROM documents UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations))
"""


def q_t_iso_date(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    t = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d MMMM yyyy")).when(k == 2, F.date_format(d, "MMMM d, yyyy")).when(k == 3, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" at noon"))).otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("-13-45")))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("rendered")).select("o_orderkey", "rendered", values.iso_date(F.col("rendered")).alias("day"))


Q_T_ISO_DATE = """
SELECT o_orderkey, t AS rendered, strftime(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d %B %Y'), try_strptime(t, '%B %d, %Y'), try_strptime(nullif(regexp_extract(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), ''), '%Y-%m-%d')), '%Y-%m-%d') AS day
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y')
  WHEN 3 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') || ' at noon' ELSE strftime(o_orderdate, '%Y') || '-13-45' END AS t FROM orders)
"""


def q_url_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    links = F.array(*(F.lit(x) for x in ("/about", "next", "../up?x=1", "#top", "?q=2", "https://other.example/x", "//cdn.example/y")))
    return pages.select("page_id", "url", F.explode(links).alias("link")).select("page_id", "link", values.url_join(F.col("url"), F.col("link")).alias("joined"))


Q_URL_JOIN = r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+):', 1) AS scheme, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS auth, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') AS folder FROM p),
l AS (SELECT *, unnest(['/about', 'next', '../up?x=1', '#top', '?q=2', 'https://other.example/x', '//cdn.example/y']) AS link FROM q)
SELECT page_id, link, CASE link WHEN '/about' THEN auth || '/about' WHEN 'next' THEN auth || folder || 'next' WHEN '../up?x=1' THEN auth || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]*/$', '') END || 'up?x=1'
  WHEN '#top' THEN regexp_replace(url, '#.*$', '') || '#top' WHEN '?q=2' THEN auth || path || '?q=2' WHEN '//cdn.example/y' THEN scheme || ':' || link ELSE link END AS joined FROM l
"""


def q_validators(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("value"), F.lit(None).cast("double").alias("number"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page"), F.col("page_id"), F.col("url"), F.lit(None).cast("double"))
    events = table(spark, sf_dir, "events").select(F.lit("event"), F.col("event_id"), F.col("event_type"), F.col("value"))
    v, n = F.col("value"), F.col("number")
    rules = {
        "number_ok": {"type": "number", "min": 10, "max": 100}, "nonempty_ok": {"type": "nonempty"}, "regex_ok": {"type": "regex", "pattern": "[0-9]{3}"},
        "enum_ok": {"type": "enum", "values": ["view", "click"]}, "max_len_ok": {"type": "max_len", "max_len": 200}, "url_ok": {"type": "url"},
    }
    rows = docs.union(pages).union(events)
    return rows.select("kind", "id", *(validators.check(r, v, n).alias(k) for k, r in rules.items()), validators.first_failing([rules["nonempty_ok"], rules["max_len_ok"], rules["number_ok"]], v, n).alias("first_failing"))


Q_VALIDATORS = """
WITH x AS (SELECT 'document' AS kind, doc_id AS id, text AS value, NULL::DOUBLE AS number FROM documents UNION ALL SELECT 'page', page_id, url, NULL FROM pages UNION ALL SELECT 'event', event_id, event_type, value FROM events),
y AS (SELECT kind, id, value IS NOT NULL AND coalesce(number BETWEEN 10 AND 100, false) AS number_ok, coalesce(length(trim(value)) > 0, false) AS nonempty_ok, coalesce(regexp_matches(value, '[0-9]{3}'), false) AS regex_ok,
  coalesce(value IN ('view', 'click'), false) AS enum_ok, coalesce(length(value) <= 200, false) AS max_len_ok, coalesce(regexp_matches(value, '^(https?://|/)'), false) AS url_ok FROM x)
SELECT *, CASE WHEN NOT nonempty_ok THEN 'nonempty' WHEN NOT max_len_ok THEN 'max_len' WHEN NOT number_ok THEN 'number' END AS first_failing FROM y
"""


def q_json_path(spark, sf_dir):
    parsed = F.try_parse_json(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(parsed, "$.k", "string").alias("k"), F.try_variant_get(parsed, "$.missing", "string").alias("missing"))


Q_JSON_PATH = "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events"


def q_json_modal_type(spark, sf_dir):
    """Rows of each user's most frequent event type (ties: first in order); all rows where it occurs once."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return stack.modal_only(events, ["user_id"], "event_type").select("user_id", "event_id", "event_type")


Q_JSON_MODAL_TYPE = """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1)
SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN m USING (user_id) WHERE m.n < 2 OR e.event_type = m.event_type
"""


def q_locator_stack(spark, sf_dir):
    """Three tiers for one field (JSON path, value, id), validated; the first valid tier wins."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    tiers = [(k, F.when(k <= 20, F.lit(None)).otherwise(F.lit("number"))), (F.col("value"), F.when(F.col("value") <= 50, F.lit(None)).otherwise(F.lit("number"))), ((F.col("event_id") % 7).cast("double"), F.when(F.col("event_id") % 7 > 0, F.lit(None)).otherwise(F.lit("number")))]
    hits = events.select("event_id", F.explode(F.array(*(F.struct(F.lit(i).alias("tier"), v.alias("value"), f.cast("string").alias("fail")) for i, (v, f) in enumerate(tiers)))).alias("h")).select("event_id", "h.*")
    return stack.resolve(hits, ["event_id"]).select("event_id", F.col("tier").cast("long").alias("tier"), "value", "failed_validator")


Q_LOCATOR_STACK = """
WITH x AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS a, value AS b, (event_id % 7)::DOUBLE AS c FROM events)
SELECT event_id, CASE WHEN a <= 20 THEN 0 WHEN b <= 50 THEN 1 WHEN c > 0 THEN 2 END::BIGINT AS tier, CASE WHEN a <= 20 THEN a WHEN b <= 50 THEN b WHEN c > 0 THEN c END AS value,
  CASE WHEN coalesce(a <= 20, false) OR coalesce(b <= 50, false) OR c > 0 THEN NULL ELSE 'number' END AS failed_validator FROM x
"""

QUERIES = {f.__name__: f for f in (q_t_money, q_t_int, q_t_digits, q_t_text, q_t_iso_date, q_url_join, q_validators, q_json_path, q_json_modal_type, q_locator_stack)}
SQL = {"q_t_money": Q_T_MONEY, "q_t_int": Q_T_INT, "q_t_digits": Q_T_DIGITS, "q_t_text": Q_T_TEXT, "q_t_iso_date": Q_T_ISO_DATE, "q_url_join": Q_URL_JOIN, "q_validators": Q_VALIDATORS, "q_json_path": Q_JSON_PATH, "q_json_modal_type": Q_JSON_MODAL_TYPE, "q_locator_stack": Q_LOCATOR_STACK}
