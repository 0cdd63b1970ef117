"""Queries of the structural difference: each rule on pages whose edits are known by how they are made.

A page lists up to fifty customers, each with a name and a place; the new side of a query has one change
on every record or on the page as a whole, so the counts of all edits follow from the number of records.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.operators import diff, dom
from fieldloom.plans.values_suite import table
from fieldloom.sources.store import stored

SCRIPT = '<script type="application/ld+json">{}</script>'


def _swap(*pairs: tuple[str, str]):
    """A change of the page as text."""

    def change(page: Column, records: Column) -> Column:
        for old, new in pairs:
            page = F.replace(page, F.lit(old), F.lit(new))
        return page

    return change


def _page(records: Column, script: Column) -> Column:
    body = F.array_join(F.transform(records, lambda r: F.concat(F.lit('<div class="rec"><h2 class="name" title="t">'), r["name"], F.lit('</h2><b class="tel">'), r["place"], F.lit("</b></div>"))), "")
    return F.concat(F.lit("<html><head>"), script, F.lit('</head><body><div class="list">'), body, F.lit("</div></body></html>"))


def _deferred(page: Column, records: Column) -> Column:
    return F.concat(F.lit('<html><head><script type="application/json">'), F.to_json(records), F.lit("</script></head><body><p>Wait</p></body></html>"))


def _reordered(page: Column, records: Column) -> Column:
    return _page(F.reverse(records), F.lit(SCRIPT))


#: For each rule the change of the page, and the expected edits in order: kind, count by the number of records n, condition.
RULES = {
    "class_rename": (_swap(('class="name"', 'class="head"')), [("CLASS_RENAME", "n", "true")]),
    "tag_swap": (_swap(("<h2 ", "<h4 "), ("</h2>", "</h4>")), [("TAG_SWAP", "n", "true"), ("SUBTREE_MOVED", "n", "true")]),
    "wrapper_inserted": (_swap(("<b ", "<i><b "), ("</b>", "</b></i>")), [("WRAPPER_INSERTED", "n", "true")]),
    "subtree_moved": (_swap(('<div class="list">', '<section class="list">'), ("</div></body>", "</section></body>")), [("SUBTREE_MOVED", "2 * n", "true")]),
    "attr_dropped": (_swap((' title="t"', "")), [("ATTR_DROPPED", "n", "true")]),
    "structured_data_dropped": (_swap((SCRIPT, "")), [("STRUCTURED_DATA_DROPPED", "1", "true")]),
    "content_deferred": (_deferred, [("CONTENT_DEFERRED", "2 * n", "n >= 2"), ("CONTENT_CHANGED", "2 * n", "n < 2")]),
    "content_changed": (_swap((" place<", " spot<")), [("CONTENT_CHANGED", "n", "true")]),
    "decoy_injected": (_swap(("</b>", '</b><b class="tel">decoy</b>')), [("DECOY_INJECTED", "1", "n >= 2")]),
    "records_reordered": (_reordered, [("RECORDS_REORDERED", "1", "n >= 5")]),
}


def _query(name: str):
    change = RULES[name][0]

    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).cast("long").alias("page"), F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.concat(F.col("c_custkey").cast("string"), F.lit(" place")).alias("place")).alias("r"))
        made = rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("records"))  # fifty records at most
        pages = stored(made.withColumn("old", _page(F.col("records"), F.lit(SCRIPT))).withColumn("new", change(F.col("old"), F.col("records"))).select("page", "old", "new"))
        nodes = lambda c: stored(dom.dom_nodes(pages.select("page", F.col(c).alias("html")), ["page"]))
        found = diff.edits(nodes("old"), nodes("new"), ["page"], diff.json_strings(pages, ["page"], "new"))
        return found.select("page", "kind", "n", F.col("place").cast("long").alias("place"))

    query.__name__ = f"q_edit_{name}"
    return query


def _sql(name: str) -> str:
    parts = " UNION ALL ".join(f"SELECT page, '{kind}' AS kind, ({n})::BIGINT AS n, {1 if name == 'content_deferred' else i}::BIGINT AS place FROM c WHERE {when}" for i, (kind, n, when) in enumerate(RULES[name][1], 1))
    return f"WITH c AS (SELECT c_custkey // 50 AS page, count(*) AS n FROM customer GROUP BY 1) {parts}"


QUERIES = {f"q_edit_{name}": _query(name) for name in RULES}
SQL = {f"q_edit_{name}": _sql(name) for name in RULES}
