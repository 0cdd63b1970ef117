"""Seeded page mutators: the workload generator of the healing evaluation.

Each takes a parsed page, a generator and a severity of 1 to 3 and changes the tree in place; it
returns how many nodes it changed (0: it did nothing).  The same seed gives the same page.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from fieldloom.sources.html_tree import Node, parse, render

#: Recipes: mutators in order, and severity.
RECIPES: dict[str, tuple[tuple[str, ...], int]] = {
    "clean": ((), 1), "class_rename": (("class_rename",), 2), "tag_swap": (("tag_swap",), 2), "reparent": (("reparent",), 2), "attr_migration": (("attr_migration",), 3), "decoy_injection": (("decoy_injection",), 2), "content_deferred": (("content_deferred",), 2),
    "jsonld_drop": (("jsonld_drop",), 2), "record_reorder": (("record_reorder",), 1), "rename_and_wrap": (("class_rename", "reparent"), 2), "redesign": (("class_rename", "tag_swap", "reparent"), 3), "rename_and_drop": (("jsonld_drop", "class_rename"), 3),
}


def records_of(page: Node) -> list[Node]:
    """Members of the largest group of like siblings, by number times text length."""
    groups: dict[tuple, list[Node]] = {}
    for n in page.walk():
        if n.parent is not None and n.parent.tag not in ("head", "nav", "html"):
            groups.setdefault((n.parent.order, n.tag, " ".join(sorted(n.classes))), []).append(n)
    large = [g for g in groups.values() if len(g) >= 3]
    return max(large, key=lambda g: (len(g) * min(sum(len(n.text) for n in g) / len(g), 200), -g[0].order), default=[])


def field_tokens(records: list[Node]) -> list[str]:
    """Classes on exactly one node with text in every record, sorted."""
    out: set[str] | None = None
    for r in records:
        count = Counter(c for n in r.walk() if n is not r and n.text for c in n.classes)
        here = {c for c, k in count.items() if k == 1}
        out = here if out is None else out & here
    return sorted(out or ())


def _replace_class(page: Node, old: str, new: str) -> int:
    n = 0
    for node in page.walk():
        if old in node.classes:
            node.attrs["class"] = " ".join(new if c == old else c for c in node.classes)
            n += 1
    return n


def class_rename(page: Node, rng: random.Random, severity: int) -> int:
    first = field_tokens(records_of(page))
    count = Counter(c for n in page.walk() for c in n.classes)
    # Tokens of 2 to 400 uses, and 3, 8 or 25 of them by severity
    rest = sorted((c for c, k in count.items() if 2 <= k <= 400 and c not in first), key=lambda c: (-count[c], c))
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    return sum(_replace_class(page, c, "css-" + "".join(rng.choice(letters) for _ in range(7))) for c in [*first, *rest][: (3, 8, 25)[severity - 1]])


def tag_swap(page: Node, rng: random.Random, severity: int) -> int:
    swaps = {"table": "div", "tr": "div", "td": "div", "th": "div"} if severity == 1 else {"table": "div", "tr": "div", "td": "div", "th": "div", "ul": "div", "ol": "div", "li": "section", **({"article": "section", "h1": "div", "h2": "div", "h3": "div", "p": "div", "span": "b"} if severity > 2 else {})}
    n = 0
    for node in list(page.walk()):
        if node.tag in swaps:
            node.attrs["role"] = node.tag
            node.attrs["class"] = " ".join([*node.classes, f"x-{node.tag}"])
            node.tag = swaps[node.tag]
            n += 1
    return n


def reparent(page: Node, rng: random.Random, severity: int) -> int:
    records = records_of(page)
    for r in records:
        for _ in range(severity):
            box = Node("div", {"class": "wrap"}, r)
            box.items = r.items
            for c in box.children:
                c.parent = box
            r.items = [box]
    return len(records)


def attr_migration(page: Node, rng: random.Random, severity: int) -> int:
    n = 0
    for node in page.walk():
        new = {}
        for k, v in node.attrs.items():
            if k.startswith("data-") and not k.startswith("data-qa-"):
                k, n = "data-qa-" + k[5:], n + 1
            elif severity >= 2 and k == "itemprop":
                k, n = "data-prop", n + 1
            elif severity >= 3 and node.tag == "a" and k == "title":
                n += 1
                continue
            new[k] = v
        node.attrs = new
    return n


def _perturbed(text: str) -> str:
    if re.search(r"\d", text):
        # The factor of decoy numbers, and below the mark of decoy texts
        return re.sub(r"\d+(?:\.\d+)?", lambda m: f"{float(m[0]) * 1.35:.2f}" if "." in m[0] else str(int(int(m[0]) * 1.35) + 1), text)
    return "Sponsored: " + text


def _copy(node: Node, parent: Node) -> Node:
    new = Node(node.tag, dict(node.attrs), parent)
    new.items = [_copy(x, new) if isinstance(x, Node) else _perturbed(x) if x.strip() else x for x in node.items]
    return new


def decoy_injection(page: Node, rng: random.Random, severity: int) -> int:
    mark = rng.choice(["promo", "featured", "was", "alt", "partner", "upsell"]) + str(rng.randint(2, 99))
    n = 0
    records = records_of(page)
    for token in field_tokens(records)[:severity]:
        for r in records:
            node = next((x for x in r.walk() if token in x.classes), None)
            if node is not None and node.parent is not None:
                decoy = _copy(node, node.parent)
                decoy.attrs["class"] = f"{' '.join(decoy.classes)} {mark}"
                node.parent.items.insert(next(i for i, x in enumerate(node.parent.items) if x is node), decoy)
                n += 1
    return n


def content_deferred(page: Node, rng: random.Random, severity: int) -> int:
    n = 0
    for r in records_of(page):
        for node in r.walk():
            if node.tag != "script":
                n += any(isinstance(x, str) and x.strip() for x in node.items)
                node.items = [x for x in node.items if isinstance(x, Node)]
    return n


def jsonld_drop(page: Node, rng: random.Random, severity: int) -> int:
    n = 0
    for node in list(page.walk()):
        if node.tag == "script" and "json" in node.attrs.get("type", "") and node.parent is not None:
            node.parent.items = [x for x in node.parent.items if x is not node]
            n += 1
        elif severity >= 2:
            for k in [k for k in node.attrs if k in ("itemprop", "itemscope", "itemtype")]:
                del node.attrs[k]
                n += 1
    return n


def record_reorder(page: Node, rng: random.Random, severity: int) -> int:
    records = records_of(page)
    if not records:
        return 0
    above = records[0].parent
    places = [i for i, x in enumerate(above.items) if any(x is r for r in records)]
    mixed = records[:]
    rng.shuffle(mixed)
    for i, r in zip(places, mixed, strict=True):
        above.items[i] = r
    return len(records)


def content_churn(page: Node, rng: random.Random, severity: int) -> int:
    """Negative control: new numbers within six percent; strings that three records share stay."""
    records = records_of(page)
    count = Counter(x.strip() for r in records for n in r.walk() for x in n.items if isinstance(x, str))
    changed = 0
    for r in records:
        for n in r.walk():
            for i, x in enumerate(n.items):
                if isinstance(x, str) and x.strip() and count[x.strip()] < 3 and re.search(r"\d", x) and not re.search(r"\d{4}-\d{2}-\d{2}", x):
                    n.items[i] = re.sub(r"\d+\.\d+", lambda m: f"{float(m[0]) * rng.uniform(0.94, 1.06):.2f}", x)
                    changed += n.items[i] != x
    return changed


MUTATORS: dict[str, Callable[[Node, random.Random, int], int]] = {f.__name__: f for f in (class_rename, tag_swap, reparent, attr_migration, decoy_injection, content_deferred, jsonld_drop, record_reorder, content_churn)}


def mutate(html: str, names: tuple[str, ...], severity: int, seed: int) -> tuple[str, int]:
    """The mutated page and the number of changed nodes; one generator serves all mutators in order."""
    if not names:
        return html, 0
    page, rng, changed = parse(html), random.Random(seed), 0
    for name in names:
        for i, node in enumerate(page.walk()):
            node.order = i
        changed += MUTATORS[name](page, rng, severity)
    return "<!DOCTYPE html>" + render(page), changed


def mutated(pages: DataFrame, keys: list[str], recipes: dict[str, tuple[tuple[str, ...], int]], seed: int = 0, html_col: str = "html") -> DataFrame:
    """(keys, recipe, new_html, changed): every page under every recipe, in one pass."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, name, *mutate(html or "", steps, severity, seed * 1_000_003 + sum(map(ord, f"{key}{name}")))) for key, html in zip(batch[keys].itertuples(index=False, name=None), batch[html_col], strict=True) for name, (steps, severity) in recipes.items()]
            yield pd.DataFrame(rows, columns=[*keys, "recipe", "new_html", "changed"])

    return pages.select(*keys, html_col).mapInPandas(run, f"{kinds}, recipe string, new_html string, changed long")
