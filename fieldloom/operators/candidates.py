"""Repair candidates: what a locator is worth before and after it is measured.

Locators are rows (kind, q, rel, attr).  Priors and strategy classes are CASE expressions; evaluation
is one aggregate over (candidate, root) hits; ranking is a window with a total order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import values
from fieldloom.operators.stats import share
from fieldloom.sources import extract
from fieldloom.sources.html_tree import Node

#: Attributes that carry meaning, and the bounds of the search.
SEMANTIC = ("itemprop", "data-testid", "data-qa", "role", "aria-label")
ROOTS, HITS_PER_ROOT, KEPT, GROUPS = 4, 3, 8, 6
BLIND_PER_ROOT, BLIND = 25, 240
FLOOR = 0.55
#: Weights of recovery, coverage, prior and survival, and the cost of each extra match.
SCORE = (0.50, 0.18, 0.20, 0.12, 0.15)
BLIND_SCORE = (0.0, 0.36, 0.40, 0.24, 0.15)


def _names(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit(r"[.#\[]([A-Za-z0-9_-]+)"), F.lit(1))


def _semantic(q: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SEMANTIC)), lambda a: F.contains(q, a))


def _data_attr(attr: Column) -> Column:
    return F.coalesce(attr.startswith("data-") | attr.isin("itemprop", "content", "datetime"), F.lit(False))


def strategy(kind: Column, q: Column, attr: Column) -> Column:
    """The kind of idea a locator stands for, whatever the site."""
    names = _names(q)
    css = (
        F.when(F.contains(q, F.lit(":not(")), "exclusion").when(_semantic(q), "semantic_attr").when(F.size(names) == 0, "bare_tag")
        .when(F.forall(names, lambda t: t.rlike(values.HASHED_CLASS)), "hashed_class").when(F.exists(names, lambda t: t.rlike(values.LAYOUT_CLASS)), "layout_class").otherwise("stable_class")
    )
    return F.when(kind == "jsonld", "structured_data").when(_data_attr(attr), "semantic_attr").when(kind == "css", css).when(kind == "text_anchor", "text_anchor").when(kind == "regex", "regex_shape").otherwise("positional")


def prior(kind: Column, q: Column, attr: Column) -> Column:
    """How likely such an address is to outlive a redesign.  Fixed values: the priors."""
    names = _names(q)
    css = F.when(_semantic(q), 0.88).when(F.size(names) == 0, 0.40).when(F.forall(names, lambda t: t.rlike(values.HASHED_CLASS)), 0.22).when(F.exists(names, lambda t: t.rlike(values.LAYOUT_CLASS)), 0.35).otherwise(0.75)
    own = F.when(kind == "css", css).when(kind == "text_anchor", 0.72).when(kind == "structural", 0.45).when(kind == "regex", 0.50).otherwise(0.40)
    by_attr = F.when(_data_attr(attr), 0.90).when(attr.isin("href", "src"), 0.70).otherwise(0.0)
    return F.when(kind == "jsonld", F.lit(0.90)).otherwise(F.greatest(own, by_attr))


def evaluate(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, recovery, coverage, n_hits_mean) over all roots; ``hits``: by, value, n_hits, known (in the known-good set)."""
    return hits.groupBy(*by).agg(F.avg(F.coalesce(F.col("known"), F.lit(False)).cast("int")).alias("recovery"), F.avg(F.col("value").isNotNull().cast("int")).alias("coverage"), F.avg(F.coalesce("n_hits", F.lit(0))).alias("n_hits_mean")).where("coverage > 0")


def score(recovery: Column, coverage: Column, prior_: Column, survives: Column, n_hits_mean: Column, blind: bool = False) -> Column:
    a, b, c, d, e = BLIND_SCORE if blind else SCORE
    return a * recovery + b * coverage + c * prior_ + d * survives.cast("double") - e * values.clamp(n_hits_mean - 1)


def ranked(found: DataFrame, keys: list[str], blind: bool = False, kept: int = KEPT) -> DataFrame:
    """The best candidates of each key with their place; columns recovery, coverage, prior, survives, n_hits_mean, signature."""
    scored = found.withColumn("score", score(*(F.col(c) for c in ("recovery", "coverage", "prior", "survives", "n_hits_mean")), blind))
    order = [F.col("score").desc(), *([] if blind else [F.col("recovery").desc()]), F.col("prior").desc(), F.col("signature")]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= kept)


def ambiguous(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ambiguous): several candidates with a small gap at the top, or a top that recovers less than nearly all."""
    w = Window.partitionBy(*keys).orderBy("place")
    return found.withColumn("next", F.lead("score").over(w)).where("place = 1").select(*keys, F.coalesce((F.col("next").isNotNull()) & ((F.col("score") - F.col("next") < 0.08) | (F.col("recovery") < 0.99)), F.lit(False)).alias("ambiguous"))


def evaluate_locator(hits: DataFrame, old_hits: DataFrame, by: list[str], blind: bool = False) -> DataFrame:
    """The measures and the score of proposed locators by the same arithmetic as candidates; one that covers nothing has no row.

    ``by`` ends with the locator's signature and has kind, q and attr; both sides as for ``evaluate``.
    """
    then = evaluate(old_hits, by).select(*by, (F.col("recovery") >= 0.9).alias("survives"))
    found = evaluate(hits, by).join(then, by, "left").withColumn("survives", F.coalesce("survives", F.lit(False))).withColumn("prior", prior(F.col("kind"), F.col("q"), F.col("attr")))
    return found.withColumn("score", score(*(F.col(c) for c in ("recovery", "coverage", "prior", "survives", "n_hits_mean")), blind)).withColumn("strategy_class", strategy(F.col("kind"), F.col("q"), F.col("attr")))


# --- generation inside a page: driver-sized, bounded by the constants above --------------------------------


def locators_for(node: Node, root: Node, attr: str | None = None) -> Iterator[dict]:
    """Addresses of a node under a root, from the most to the least meaningful."""
    def css(q: str) -> dict:
        return {"kind": "css", "q": q, "attr": attr}

    for name in SEMANTIC:
        if node.attrs.get(name):
            yield css(f'[{name}="{node.attrs[name]}"]')
    for name in node.attrs:
        if name.startswith("data-") and name not in SEMANTIC:
            yield css(f"{node.tag}[{name}]")
    if node.attrs.get("id"):
        yield css(f"#{node.attrs['id']}") if re.fullmatch(r"[\w-]+", node.attrs["id"]) else css(node.tag)
    for c in node.classes:
        if re.fullmatch(r"[\w-]+", c):
            yield css(f"{node.tag}.{c}")
            yield css(f".{c}")
    if attr:
        yield css(f"{node.tag}[{attr}]")
    if node is not root:
        steps, tags, at = [], [], node
        while at is not root and at.parent is not None:
            around = at.parent.children
            steps.append(f"*[{next(i for i, x in enumerate(around, 1) if x is at)}]")
            tags.append(f"{at.tag}[{[x for x in around if x.tag == at.tag].index(at) + 1}]")
            at = at.parent
        if at is root:
            yield {"kind": "structural", "q": "./" + "/".join(reversed(steps)), "attr": attr}
            yield {"kind": "xpath", "q": "./" + "/".join(reversed(tags)), "attr": attr}
    if not attr and (label := label_of(node)):
        text, rel = label
        yield {"kind": "text_anchor", "q": text, "rel": rel}


def label_of(node: Node) -> tuple[str, str] | None:
    before = node.preceding()
    if before is not None and 2 <= len(before.text) <= 40:
        return before.text, "next_sibling_text"
    above = node.parent.preceding() if node.parent is not None else None
    if above is not None and 2 <= len(above.text) <= 40:
        return above.text, "parent_sibling_text"
    head, colon, _ = node.text.partition(":")
    return (head, "after_colon") if colon and 0 < len(head) <= 30 else None


def exclusions(node: Node, root: Node, locator: dict) -> Iterator[dict]:
    """The locator without its first wrong match: by that match's own token, or by one of an ancestor's."""
    if locator["kind"] != "css":
        return
    found = extract.nodes_of(root, locator)
    if len(found) < 2 or found[0] is node:
        return
    first = found[0]
    for token in islice((t for t in first.classes if t not in node.classes), 2):
        yield locator | {"q": f"{locator['q']}:not(.{token})"}
    for a, b in zip(islice(first.ancestors(), 4), islice(node.ancestors(), 4), strict=False):
        shared = [t for t in a.classes if t in b.classes]
        marks = [t for t in a.classes if t not in b.classes]
        if shared and marks:
            for token in marks[:2]:
                yield locator | {"q": f".{shared[0]}:not(.{token}) {locator['q']}"}
            return


def generate(page: extract.Page, roots: list, known: set[str], cores: set[str], stack: list[dict], read, blind: bool = False) -> list[dict]:
    """Distinct candidate locators for one field.

    ``read(text)``: the key of the transformed text; a node is worth addressing if it carries a known value.
    """
    out: dict[str, dict] = {}

    def add(locator: dict) -> None:
        locator = {k: v for k, v in locator.items() if v}
        out.setdefault(extract.signature(locator), locator)

    for locator in stack:
        add({k: locator.get(k) for k in ("kind", "q", "rel", "attr")})
    carries = lambda text: bool(text) and (re.sub("[^a-z0-9]", "", text.lower()) in cores or read(text) in known)
    for index, root in enumerate(roots[:ROOTS]):
        if isinstance(root, Node):
            taken = 0
            for node in root.walk():
                attrs = [a for a in node.attrs if a not in ("class", "style") and (blind or carries(node.attrs[a]))]
                own = not node.children and bool(node.text) if blind else carries(node.text) and not any(carries(c.text) for c in node.children)
                for attr in [*([None] if own else []), *(a for a in attrs if a.startswith("data-") or a in ("href", "src", "title", "content", "datetime", "value"))]:
                    if taken >= (BLIND_PER_ROOT if blind else HITS_PER_ROOT * 4):
                        break
                    taken += 1
                    for locator in locators_for(node, root, attr):
                        add(locator)
                        for other in exclusions(node, root, locator):
                            add(other)
        if index < len(page.objects):
            held = [("", page.objects[index])]
            while held:
                path, o = held.pop()
                for k, v in o.items() if isinstance(o, dict) else ():
                    if isinstance(v, list) and v:
                        v = v[0]
                    here = f"{path}.{k}" if path else k
                    if isinstance(v, dict):
                        held.append((here, v))
                    elif not k.startswith("@") and (blind or carries(str(v))):
                        add({"kind": "jsonld", "q": here})
    if any(re.match(r"^[$€£]|\d", k) for k in known) and not blind:
        add({"kind": "regex", "q": r"[$€£]\s?(\d[\d.,]*)"})
        add({"kind": "regex", "q": r"(\d+)"})
    sample = sorted(known)[:20]
    if not blind and sample:
        heads = {}
        for v in sample:
            heads[v[:6]] = heads.get(v[:6], 0) + 1
        head, n = max(heads.items(), key=lambda x: (x[1], x[0]))
        if n >= max(3, 0.6 * len(sample)) and len(head) == 6:
            add({"kind": "regex", "q": f"({re.escape(head)}\\S*)"})
    return list(out.values())[: BLIND if blind else None]


def root_candidates(page: extract.Page, spec: dict, known: set[str]) -> list[dict]:
    """Locators of repeated siblings, best groups first."""
    groups: dict[tuple, list[Node]] = {}
    for node in page.document.walk():
        if node.parent is not None:
            groups.setdefault((node.parent.order, node.tag, " ".join(sorted(node.classes))), []).append(node)
    core = lambda n: len(re.sub("[^a-z0-9]", "", n.text.lower()))
    large = sorted((g for g in groups.values() if len(g) >= 3), key=lambda g: (-len(g) * min(sum(map(core, g)) / len(g), 200), g[0].order))[:GROUPS]
    out: dict[str, dict] = {}
    for g in large:
        first, above = g[0], g[0].parent
        for c in first.classes:
            if re.fullmatch(r"[\w-]+", c) and not re.match(values.LAYOUT_CLASS, c):
                out.setdefault(f"{first.tag}.{c}", {"kind": "css", "q": f"{first.tag}.{c}"})
                break
        named = next((c for c in above.classes if re.fullmatch(r"[\w-]+", c)), None)
        q = f"{above.tag}{'.' + named if named else ''} > {first.tag}"
        out.setdefault(q, {"kind": "css", "q": q})
        inside = set.intersection(*({x.tag for x in n.walk() if x is not n} for n in g))
        outside = [{x.tag for x in n.walk() if x is not n} for n in above.children if n.tag == first.tag and n not in g]
        for tag in sorted(t for t in inside if not any(t in o for o in outside))[:2]:
            q = f"//{above.tag}/{first.tag}[.//{tag}]"
            out.setdefault(q, {"kind": "xpath", "q": q})
    return list(out.values())
