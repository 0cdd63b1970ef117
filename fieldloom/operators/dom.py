"""Pages as rows: one row for each element, with preorder intervals.

An element ``d`` is inside ``a`` of the same page if ``d.node_id`` lies between ``a.node_id + 1`` and ``a.last_desc``;
joins on that always carry the page key, so they are sort-merge joins with a residual condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.sources.html_tree import parse

NODES = "node_id int, last_desc int, parent_id int, depth int, tag string, classes array<string>, attrs map<string,string>, sib_idx int, tag_idx int, is_leaf boolean, text string, tag_path array<string>"


def page_nodes(html: str | None) -> list[tuple]:
    root = parse(html)
    out: list[list] = []
    held = [(root, -1, 0, 1, 1, [root.tag])]
    while held:
        node, parent, depth, sib, nth, path = held.pop()
        kids, counts, below = node.children, {}, []
        out.append([node.order, node.order, parent, depth, node.tag, node.classes, {k: v for k, v in node.attrs.items() if k != "class"}, sib, nth, not kids, node.text, path])
        for i, k in enumerate(kids, 1):
            counts[k.tag] = counts.get(k.tag, 0) + 1
            below.append((k, node.order, depth + 1, i, counts[k.tag], [*path, k.tag]))
        held += reversed(below)
    place = {row[0]: row for row in out}
    for row in reversed(out):
        if row[2] in place:
            place[row[2]][1] = max(place[row[2]][1], row[1])
    return [tuple(r) for r in out]


def dom_nodes(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)
    columns = [x.split()[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, *node) for key, html in zip(batch[keys].itertuples(index=False, name=None), batch[html_col], strict=True) for node in page_nodes(html)]
            yield pd.DataFrame(rows, columns=[*keys, *columns])

    return pages.select(*keys, html_col).mapInPandas(run, f"{kinds}, {NODES}")


def descendants(above: DataFrame, below: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """(keys, a_id, d_id): containment pairs of two sets of nodes; ``carry``: further columns of the inner ones."""
    a = above.select(*keys, F.col("node_id").alias("a_id"), F.col("last_desc").alias("a_last"))
    d = below.select(*keys, F.col("node_id").alias("d_id"), *(carry or []))
    return a.join(d, keys).where((F.col("d_id") > F.col("a_id")) & (F.col("d_id") <= F.col("a_last"))).select(*keys, "a_id", "d_id", *(carry or []))


def sibling_groups(nodes: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Groups of like siblings (parent, tag, class set), best first: many members with much text."""
    core = F.char_length(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""))
    groups = nodes.where("parent_id >= 0").groupBy(*keys, "parent_id", "tag", F.array_join(F.array_sort("classes"), " ").alias("class_set")).agg(F.count("*").alias("n"), F.avg(core).alias("mean_core"), F.min("node_id").alias("first"))
    groups = groups.where(F.col("n") >= least).withColumn("weight", F.col("n") * F.least("mean_core", F.lit(200.0)))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "first")))


def labels(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, label): the previous sibling's text (2 to 40 characters), else the text before a colon (30 at most)."""
    w = Window.partitionBy(*keys, "parent_id").orderBy("sib_idx")
    before = F.lag("text").over(w)
    own = F.nullif(F.trim(F.regexp_extract("text", r"^([^:]{1,30}):", 1)), F.lit(""))
    return nodes.select(*keys, "node_id", F.coalesce(F.when(F.char_length(before).between(2, 40), before), own).alias("label"))
