"""Queries of the mutators (over the pages table) and of the repair loop (over the synthetic sites).  SQL expresses neither."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fieldloom.operators import dom, heal, mutators
from fieldloom.plans import sites
from fieldloom.plans.values_suite import table


def _mutator_query(name: str):
    def query(spark, sf_dir):
        pages = mutators.mutated(table(spark, sf_dir, "pages"), ["page_id"], {name: ((name,), 2)})
        return pages.select("page_id", "recipe", "changed", F.md5("new_html").alias("page_md5"))

    query.__name__ = f"q_mutate_{name}"
    return query


def q_dom_nodes(spark, sf_dir):
    """Nodes, leaves and depth of every page: the size of its tree."""
    nodes = dom.dom_nodes(table(spark, sf_dir, "pages"), ["page_id"])
    return nodes.groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.max("depth").cast("long").alias("depth"))


def q_labels(spark, sf_dir):
    """How many nodes of a page have a label beside or before them."""
    found = dom.labels(dom.dom_nodes(table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])
    return found.groupBy("page_id").agg(F.count("label").alias("labelled"))


def cases(spark, recipes: dict | None = None, seed: int = 0):
    """The evaluation matrix: every synthetic site under every recipe that changes it."""
    pages = spark.createDataFrame([(s, sites.page(s)) for s in sites.SPECS], "site string, html string")
    specs = spark.createDataFrame([(s, json.dumps(x)) for s, x in sites.SPECS.items()], "site string, spec string")
    made = mutators.mutated(pages, ["site"], recipes or mutators.RECIPES, seed).where("changed > 0 or recipe = 'clean'")
    return made.join(pages.withColumnRenamed("html", "old_html"), "site").join(specs, "site").select(F.concat_ws("/", "site", "recipe").alias("case_id"), "site", "old_html", "new_html", "spec")


def q_heal(spark, sf_dir):
    """The whole evaluation matrix, all recipes on three sites: status, cycles and F1 before and after."""
    found = heal.heal(cases(spark).coalesce(4))
    return found.select("case_id", "status", F.col("cycles").cast("long").alias("cycles"), "diff_class", *(F.round(c, 6).alias(c) for c in ("f1_before", "f1_after")))


QUERIES = {f.__name__: f for f in (q_dom_nodes, q_labels, q_heal, *map(_mutator_query, mutators.MUTATORS))}
SQL: dict[str, str] = {}
