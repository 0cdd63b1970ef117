"""Structural difference of two snapshots of a page, as ranked edits.

``old`` and ``new`` are node tables (see ``dom``) with the same keys.  Each rule is an aggregate or a join on
the page key; counts of all rules meet in one long table that is ranked by weight, count and the
order in which the rules stand below.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.values import core_key
from fieldloom.operators import stack
from fieldloom.sources.html_tree import parse

#: Rules in the order they are emitted, with their weights.
WEIGHTS = {
    "CLASS_RENAME": 3, "TAG_SWAP": 3, "WRAPPER_INSERTED": 2, "SUBTREE_MOVED": 2, "ATTR_DROPPED": 1, "STRUCTURED_DATA_DROPPED": 4,
    "CONTENT_DEFERRED": 5, "CONTENT_CHANGED": 0, "DECOY_INJECTED": 6, "RECORDS_REORDERED": 1,
}
ANCHORS = 250


def leaves(nodes: DataFrame) -> DataFrame:
    """Text leaves: elements without children whose text is longer than one character, outside script and style."""
    return nodes.where("is_leaf and char_length(text) > 1 and tag not in ('script', 'style')")


def anchors(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First old and first new leaf of every shared text."""
    first = lambda df: stack.first_per_group(leaves(df), [*keys, "text"], ["node_id"])
    a, b = first(old), first(new)
    side = lambda df, p: df.select(*keys, "text", *(F.col(c).alias(f"{p}_{c}") for c in ("node_id", "tag", "classes", "attrs", "tag_path")))
    return side(a, "o").join(side(b, "n"), [*keys, "text"])


def class_census(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, old_n, new_n): nodes that carry each class token."""
    count = lambda df, name: df.select(*keys, F.explode(F.array_distinct("classes")).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(name))
    return count(old, "old_n").join(count(new, "new_n"), [*keys, "token"], "full").fillna(0, ["old_n", "new_n"])


def page_strings(html: str | None) -> list[str]:
    """Every scalar of the page's JSON scripts as normal text, each once, sorted."""
    found: set[str] = set()
    for node in parse(html).walk():
        if node.tag == "script" and "json" in node.attrs.get("type", "").lower():
            try:
                held = [json.loads(node.raw_text())]
            except (ValueError, RecursionError):
                continue
            while held:
                x = held.pop()
                if isinstance(x, dict | list):
                    held += x.values() if isinstance(x, dict) else x
                elif x is not None:
                    found.add(" ".join(str(x).split()))
    return sorted(found)


def json_strings(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """(keys, text) of each string in the JSON scripts of the pages: the blobs of ``edits``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, text) for key, html in zip(batch[keys].itertuples(index=False, name=None), batch[html_col], strict=True) for text in page_strings(html)]
            yield pd.DataFrame(rows, columns=[*keys, "text"])

    return pages.select(*keys, html_col).mapInPandas(run, f"{kinds}, text string")


def edits(old: DataFrame, new: DataFrame, keys: list[str], blobs: DataFrame | None = None) -> DataFrame:
    """(keys, kind, n, weight, place): what changed, worst first; ``blobs``: keys, text of each string in the new page's JSON.

    Lost texts are looked up in the blobs by core key: "$105.24" in the markup is "105.24" in JSON.
    """
    shared = anchors(old, new, keys)
    c = F.col
    both = shared.groupBy(*keys).agg(
        F.count("*").alias("shared"),
        F.count_if((F.size(F.array_except("o_classes", "n_classes")) > 0) & (F.size(F.array_except("n_classes", "o_classes")) > 0)).alias("renamed"),
        F.count_if(c("o_tag") != c("n_tag")).alias("swapped"),
        F.count_if(F.size("n_tag_path") > F.size("o_tag_path")).alias("wrapped"),
        F.count_if((F.size("n_tag_path") <= F.size("o_tag_path")) & (c("n_tag_path") != c("o_tag_path"))).alias("moved"),
        F.sum(F.size(F.array_except(F.map_keys("o_attrs"), F.map_keys("n_attrs")))).alias("dropped"),
    )
    census = class_census(old, new, keys)
    gone = census.groupBy(*keys).agg(F.count_if((c("old_n") > 0) & (c("new_n") == 0)).alias("gone"), F.count_if((c("old_n") == 0) & (c("new_n") > 0)).alias("came"))
    scripts, marked = (c("tag") == "script") & F.coalesce(c("attrs")["type"], F.lit("")).contains("json"), F.array_contains(F.map_keys("attrs"), "itemprop")
    page = lambda df, p: df.groupBy(*keys).agg(F.count_if(scripts).alias(f"{p}_scripts"), F.count_if(marked).alias(f"{p}_marked"), F.max(F.when(c("tag") == "body", F.char_length("text"))).alias(f"{p}_chars"))
    texts = lambda df: leaves(df).select(*keys, "text").distinct()
    lost = texts(old).join(texts(new), [*keys, "text"], "left_anti")
    old_texts = texts(old).groupBy(*keys).agg(F.count("*").alias("texts"))
    hidden = lost.withColumn("core", core_key(F.col("text"))).join(blobs.select(*keys, core_key(F.col("text")).alias("core")).distinct(), [*keys, "core"], "left_semi").groupBy(*keys).agg(F.count("*").alias("hidden")) if blobs is not None else None
    lost_n = lost.groupBy(*keys).agg(F.count("*").alias("lost"))
    fresh = leaves(new).select(*keys, "text", F.explode("classes").alias("token")).join(texts(old), [*keys, "text"], "left_anti").select(*keys, "token").distinct()
    decoys = census.where((c("old_n") >= 2) & (c("new_n") >= 1.6 * c("old_n"))).join(fresh, [*keys, "token"], "left_semi").groupBy(*keys).agg(F.count("*").alias("decoys"))
    w = Window.partitionBy(*keys)
    ranked = shared.select(*keys, "o_node_id", "n_node_id").withColumn("a", F.row_number().over(w.orderBy("o_node_id"))).where(c("a") <= ANCHORS)
    pairs = ranked.alias("x").join(ranked.alias("y"), keys).where("x.a < y.a").groupBy(*keys).agg((F.count_if(c("x.n_node_id") < c("y.n_node_id")) / F.count("*")).alias("order"), F.max("y.a").alias("anchored"))
    table = page(old, "o").join(page(new, "n"), keys)
    for part in (both, gone, old_texts, lost_n, decoys, pairs, *([hidden] if hidden is not None else [])):
        table = table.join(part, keys, "left")
    z = lambda name: F.coalesce(c(name), F.lit(0)) if name in table.columns else F.lit(0)
    deferred = (z("n_chars") < 0.6 * z("o_chars")) & (z("hidden") >= F.greatest(F.lit(3.0), 0.3 * z("lost")))
    gone_data = (z("o_scripts") > 0) & (z("n_scripts") == 0) | (z("o_marked") > 0) & (z("n_marked") == 0)
    counts = {
        "CLASS_RENAME": F.when((z("renamed") > 0) | (z("gone") > 0) & (z("came") > 0), F.greatest(z("renamed"), z("gone"))),
        "TAG_SWAP": z("swapped"), "WRAPPER_INSERTED": z("wrapped"), "SUBTREE_MOVED": z("moved"), "ATTR_DROPPED": z("dropped"),
        "STRUCTURED_DATA_DROPPED": F.when(gone_data, F.greatest(z("o_scripts") - z("n_scripts") + z("o_marked") - z("n_marked"), F.lit(1))), "CONTENT_DEFERRED": F.when(deferred, z("hidden")),
        "CONTENT_CHANGED": F.when(~deferred & (z("lost") > 0.3 * z("texts")), z("lost")), "DECOY_INJECTED": z("decoys"),
        "RECORDS_REORDERED": F.when((z("anchored") >= 10) & (z("shared") >= 0.65 * z("texts")) & (z("order") < 0.95), F.lit(1)),
    }
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("kind"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.lit(WEIGHTS[k]).alias("weight")) for i, (k, n) in enumerate(counts.items())))
    found = table.select(*keys, F.explode(rows).alias("e")).select(*keys, "e.*").where("n > 0")
    return found.withColumn("place", F.row_number().over(w.orderBy(c("weight").desc(), c("n").desc(), "ord")))


def primary(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind) of the first edit; pages without one do not occur (their class is UNKNOWN)."""
    return found.where("place = 1").select(*keys, F.col("kind").alias("diff_class"))
