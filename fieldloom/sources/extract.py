"""Extraction of records from pages by a spec.

A spec is a dict: site, version, record_selector (list of locators), fields: name to {stack, transform,
validators, min_fill}.  A locator is {kind, q, rel, attr} of kind css, xpath, structural, jsonld,
text_anchor or regex.  Pages are parsed once, in one Arrow crossing that gives long rows (record,
field, tier, raw, n_hits); transforms, validators and the choice of the tier are Catalyst
expressions after it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import values
from fieldloom.functions.validators import first_failing
from fieldloom.operators import stack
from fieldloom.sources import selectors
from fieldloom.sources.html_tree import Node, parse

DOM_KINDS = ("css", "xpath", "structural")
ANCHORS = ("after_colon", "next_sibling_text", "parent_sibling_text", "self_text")


def signature(locator: dict) -> str:
    return ":".join(str(locator.get(k) or "") for k in ("kind", "q", "rel", "attr"))


def json_objects(document: Node) -> list[dict]:
    """Objects of all JSON scripts in document order, lists and graph or item-list wrappers opened."""
    found: list[dict] = []

    def open_up(x) -> None:
        if isinstance(x, list):
            for y in x:
                open_up(y)
        elif isinstance(x, dict):
            inner = x.get("@graph", x.get("itemListElement"))
            if isinstance(inner, list):
                for y in inner:
                    open_up(y.get("item", y) if isinstance(y, dict) and isinstance(y.get("item"), dict) else y)
            else:
                found.append(x)

    for node in document.walk():
        if node.tag == "script" and "json" in node.attrs.get("type", "").lower():
            try:
                open_up(json.loads(node.raw_text()))
            except (ValueError, RecursionError):
                continue
    return found


def aligned(objects: list[dict]) -> list[dict]:
    """Objects of the most frequent type (ties: first in order) if it occurs twice at least, else all."""
    kinds = Counter(_kind(o) for o in objects if _kind(o))
    if not kinds:
        return objects
    top = min(kinds, key=lambda k: (-kinds[k], k))
    return [o for o in objects if _kind(o) == top] if kinds[top] >= 2 else objects


def _kind(o: dict) -> str | None:
    kind = o.get("@type")
    return str(kind[0]) if isinstance(kind, list) and kind else str(kind) if kind else None


def json_value(o, path: str) -> str | None:
    """Text at a dotted path; a list at any step stands for its first element."""
    for step in path.split("."):
        while isinstance(o, list):
            o = o[0] if o else None
        if not isinstance(o, dict):
            return None
        o = o.get(step)
    while isinstance(o, list):
        o = o[0] if o else None
    if o is None:
        return None
    return " ".join((o if isinstance(o, str) else json.dumps(o, ensure_ascii=False)).split()) or None


@dataclass
class Page:
    """A parsed page: its tree and the JSON objects aligned to records."""

    document: Node
    objects: list[dict]

    @staticmethod
    def of(html: str | None) -> Page:
        document = parse(html)
        return Page(document, aligned(json_objects(document)))


def nodes_of(root: Node, locator: dict) -> list:
    """Elements (or texts, of an XPath) that a DOM locator finds; unsupported queries find nothing."""
    try:
        return selectors.css(root, locator["q"]) if locator["kind"] == "css" else selectors.xpath(root, locator["q"])
    except selectors.Unsupported:
        return []


def _stepped(node: Node, rel: str | None) -> str | None:
    if rel == "after_colon":
        return node.text.partition(":")[2] or None
    if rel == "next_sibling_text":
        after = node.following()
        return after.text if after is not None else None
    if rel == "parent_sibling_text":
        after = node.parent.following() if node.parent is not None else None
        return after.text if after is not None else None
    return node.text


def resolve_all(root, locator: dict, page: Page, index: int) -> list[str]:
    """Every non-empty string that a locator finds under a root, in document order."""
    kind, q = locator["kind"], locator.get("q") or ""
    if kind == "jsonld":
        found = [json_value(root if isinstance(root, dict) else page.objects[index], q)] if isinstance(root, dict) or index < len(page.objects) else []
    elif not isinstance(root, Node):
        return []
    elif kind in DOM_KINDS:
        attr = locator.get("attr")
        found = [x if isinstance(x, str) else (x.attrs.get(attr) if attr else x.text) for x in nodes_of(root, locator)]
    elif kind == "text_anchor":
        needle = " ".join(q.lower().split())
        found = [_stepped(n, locator.get("rel")) for n in root.walk() if needle and needle in n.text.lower()[: len(needle) + 24]]
    elif kind == "regex":
        try:
            found = [m[1] if m.re.groups else m[0] for m in re.finditer(q, root.text)]
        except re.error:
            found = []
    else:
        found = []
    return [t for t in (" ".join(x.split()) for x in found if x) if t]


def roots_of(page: Page, record_selector: list[dict]) -> tuple[list, int | None]:
    """Record roots from the first tier that finds any, and the tier."""
    for tier, locator in enumerate(record_selector):
        if locator["kind"] == "jsonld":
            found: list = page.objects if not locator.get("q") else [o for o in page.objects if _kind(o) == locator["q"] or locator["q"] == "*"]
        elif locator["kind"] in DOM_KINDS:
            found = [n for n in nodes_of(page.document, locator) if isinstance(n, Node)]
        else:
            continue
        if found:
            return found, tier
    return [], None


HITS = "record long, field string, tier int, raw string, n_hits int, root_tier int, n_roots long, n_objects long"


def page_hits(html: str | None, spec: dict) -> list[tuple]:
    """Rows (record, field, tier, raw, n_hits, root_tier, n_roots, n_objects); one row with null record if there are no roots."""
    page = Page.of(html)
    roots, root_tier = roots_of(page, spec["record_selector"])
    end = (root_tier, len(roots), len(page.objects))
    out = []
    for i, root in enumerate(roots):
        for name, field in spec["fields"].items():
            for tier, locator in enumerate(field["stack"]):
                hits = resolve_all(root, locator, page, i)
                out.append((i, name, tier, hits[0] if hits else None, len(hits), *end))
    return out or [(None, None, None, None, None, *end)]


def hits(pages: DataFrame, spec: dict, keys: list[str], html_col: str = "html") -> DataFrame:
    """Long hits of every page under one spec; pages stay where they are, nothing is shuffled."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in HITS.split(", ")]
        for batch in batches:
            rows = [(*key, *hit) for key, html in zip(batch[keys].itertuples(index=False, name=None), batch[html_col], strict=True) for hit in page_hits(html, spec)]
            yield pd.DataFrame(rows, columns=[*keys, *columns]).astype({"record": "Int64", "tier": "Int32", "n_hits": "Int32", "root_tier": "Int32"})

    return pages.select(*keys, html_col).mapInPandas(run, f"{kinds}, {HITS}")


def results(found: DataFrame, spec: dict, keys: list[str], base_url: str | None = None) -> DataFrame:
    """(keys, record, field, value, number, tier, n_hits, failed_validator): the fallback stack over hits."""
    rows = found.where("record is not null")
    text, number, fail = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, field in spec["fields"].items():
        kind = field.get("transform") or "text"
        value = values.transformed(F.col("raw"), kind)
        if kind == "url" and base_url:
            value = values.url_join(F.col(base_url), value)
        own = value.cast("double") if kind in values.NUMERIC else F.lit(None).cast("double")
        shown = values.value_key(value.cast("string"), own) if kind in values.NUMERIC else value.cast("string")
        is_field = F.col("field") == name
        text, number = F.when(is_field, shown).otherwise(text), F.when(is_field, own).otherwise(number)
        fail = F.when(is_field, first_failing(field.get("validators") or [], F.col("value"), F.col("number"))).otherwise(fail)
    rows = rows.withColumns({"value": text, "number": number}).withColumn("fail", fail)
    return stack.resolve(rows, [*keys, "record", "field"], ("number", "n_hits")).select(*keys, "record", "field", "value", "number", "tier", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "failed_validator")


def headers(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_records, root_tier, errors): one row for each page."""
    out = found.groupBy(*keys).agg(F.max("n_roots").alias("n_records"), F.max("root_tier").alias("root_tier"), F.max("n_objects").alias("n_objects"))
    odd = (F.col("n_objects") > 0) & (F.col("n_objects") != F.col("n_records"))
    text = F.format_string("%d objects for %d records", F.col("n_objects"), F.col("n_records"))
    return out.select(*keys, "n_records", "root_tier", F.when(odd, F.array(text)).otherwise(F.array().cast("array<string>")).alias("errors"))


def shapes(res: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shape_entropy): entropy over which fields the records have."""
    from fieldloom.operators.stats import entropy

    shape = res.groupBy(*keys, "record").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.col("field"))))).alias("shape"))
    return entropy(shape, keys, "shape", "shape_entropy")
