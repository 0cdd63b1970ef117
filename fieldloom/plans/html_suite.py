"""Queries that read pages: extraction by a spec, node tables, structural differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import diff, dom
from fieldloom.plans.values_suite import table
from fieldloom.sources import extract
from fieldloom.sources.store import stored

SPEC = {
    "site": "pages", "version": 1, "record_selector": [{"kind": "css", "q": "article"}],
    "fields": {
        "title": {"stack": [{"kind": "css", "q": "h1"}, {"kind": "regex", "q": r"^(\S+)"}], "transform": "text", "validators": [{"type": "nonempty"}]},
        "items": {"stack": [{"kind": "xpath", "q": ".//p"}, {"kind": "text_anchor", "q": "the", "rel": "self_text"}], "transform": "text"},
    },
}
DECODE = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
SPACES = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def q_html_title(spark, sf_dir):
    """The flagship: pages through a spec, value and provenance of the title."""
    found = extract.hits(table(spark, sf_dir, "pages"), SPEC, ["page_id"])
    res = extract.results(found, SPEC, ["page_id"])
    return res.where("field = 'title'").select("page_id", "record", F.col("value").alias("title"), F.col("tier").cast("long").alias("tier"), F.col("n_hits").cast("long").alias("n_hits"))


Q_HTML_TITLE = f"SELECT page_id, 0::BIGINT AS record, {SPACES.format(DECODE.format('t'))} AS title, 0::BIGINT AS tier, 1::BIGINT AS n_hits FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t FROM pages)"


def q_html_links(spark, sf_dir):
    nodes = dom.dom_nodes(table(spark, sf_dir, "pages"), ["page_id"]).where("tag in ('nav', 'a')").select("page_id", "node_id", "last_desc", "tag", F.col("attrs")["href"].alias("href"))
    nodes = stored(nodes)  # parsed once for both sides
    inside = dom.descendants(nodes.where("tag = 'nav'"), nodes.where("tag = 'a'"), ["page_id"], carry=["href"]).dropDuplicates(["page_id", "d_id"])
    return inside.groupBy("page_id").agg(F.count("*").alias("n_hits"), F.min(F.struct("d_id", "href"))["href"].alias("first_href"))


Q_HTML_LINKS = f"SELECT page_id, len(h) AS n_hits, {DECODE.format('h[1]')} AS first_href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href=\"([^\"]*)\"', 1) AS h FROM pages) WHERE len(h) > 0"


def q_html_counts(spark, sf_dir):
    nodes = dom.dom_nodes(table(spark, sf_dir, "pages"), ["page_id"])
    return nodes.groupBy("page_id").agg(*(F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("li", "p", "br", "h1", "nav")))


Q_HTML_COUNTS = "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}>'))::BIGINT AS n_{t}" for t in ("li", "p", "br", "h1", "nav")) + " FROM (SELECT page_id, regexp_replace(html, '<script>.*?</script>', '', 's') AS html FROM pages)"


def q_sibling_groups(spark, sf_dir):
    groups = dom.sibling_groups(dom.dom_nodes(table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])
    return groups.groupBy("page_id", "tag").agg(F.sum("n").alias("members"), F.count("*").alias("groups"))


Q_SIBLING_GROUPS = """
WITH t AS (SELECT page_id, unnest(['li', 'p']) AS tag, unnest([len(regexp_extract_all(html, '<li>')), len(regexp_extract_all(a, '<p>'))]) AS n
  FROM (SELECT page_id, html, regexp_extract(html, '<article>.*', 0, 's') AS a FROM pages))
SELECT page_id, tag, n::BIGINT AS members, 1::BIGINT AS groups FROM t WHERE n >= 3
"""


def _tag_sets(spark, sf_dir):
    """Tags as class tokens: pages of even id are the old side, those of odd id the new."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("all").alias("site"), "html")
    nodes = dom.dom_nodes(pages, ["site", "page_id"]).withColumn("classes", F.when(F.size("classes") > 0, F.col("classes")).otherwise(F.array("tag")))
    return nodes.where("page_id % 2 = 0"), nodes.where("page_id % 2 = 1")


def q_diff_class_census(spark, sf_dir):
    old, new = _tag_sets(spark, sf_dir)
    return diff.class_census(old, new, ["site"]).select("token", "old_n", "new_n")


Q_DIFF_CLASS_CENSUS = """
WITH t AS (SELECT page_id % 2 AS side, unnest(regexp_extract_all(regexp_replace(html, '(<script[^>]*>).*?</script>', '\\1', 'sg'), '<[a-z][a-z0-9]*(?: class="ad")?', 0)) AS tag FROM pages)
SELECT CASE WHEN tag LIKE '%"ad"' THEN 'ad' ELSE tag[2:] END AS token, count(*) FILTER (side = 0) AS old_n, count(*) FILTER (side = 1) AS new_n FROM t GROUP BY 1
"""


def q_diff_anchor(spark, sf_dir):
    """Advert texts that two sets of pages share, with the first page of each side."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("all").alias("site"), "html")
    nodes = dom.dom_nodes(pages, ["site", "page_id"]).where("array_contains(classes, 'ad')").withColumn("node_id", F.col("page_id"))
    pairs = diff.anchors(nodes.where("page_id % 14 < 7"), nodes.where("page_id % 14 >= 7"), ["site"])
    return pairs.select("text", F.col("o_node_id").alias("old_page"), F.col("n_node_id").alias("new_page"))


Q_DIFF_ANCHOR = f"""
WITH a AS (SELECT page_id, {SPACES.format(DECODE.format("regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1, 's')"))} AS text FROM pages), s AS (SELECT (page_id % 14 >= 7)::INT AS side, text, min(page_id) AS page FROM a WHERE length(text) > 1 GROUP BY ALL)
SELECT x.text, x.page AS old_page, y.page AS new_page FROM s x JOIN s y ON x.text = y.text AND x.side = 0 AND y.side = 1
"""

QUERIES = {f.__name__: f for f in (q_html_title, q_html_links, q_html_counts, q_sibling_groups, q_diff_class_census, q_diff_anchor)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
