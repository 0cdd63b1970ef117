"""The CSS and XPath subsets that extractor specs use.  Unsupported syntax finds nothing.

CSS: tag, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr=v]`` with ``~= ^= $= *= |=``, ``:not(simple)``,
``:first-child``, ``:nth-child(n)``, descendant, ``>``, ``+``, ``~`` and comma lists; a query from a node matches the node
itself too.  XPath: ``/``, ``//``, ``.``, ``..``, names, ``*``, ``[n]``, ``[last()]``, ``[path]``, ``[@a]``, ``[@a="v"]``,
``[contains(@a, "v")]``, ``[text()="v"]``, and a last step ``@a`` or ``text()``; a leading ``/`` starts from the document.
"""

from __future__ import annotations

import functools
import re

from fieldloom.sources.html_tree import Node

_SIMPLE = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]|:not\((?P<neg>[^()]*)\)|:(?P<pseudo>first-child|last-child)|:nth-child\((?P<nth>\d+)\)""")


class Unsupported(ValueError):
    """A query beyond the subset; callers treat it as a miss."""


def _compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or m.end() == at or (m["tag"] and at):
            raise Unsupported(text)
        at = m.end()
        tests.append(_test(m))
    if not tests:
        raise Unsupported(text)
    return lambda n: all(t(n) for t in tests)


def _test(m: re.Match):
    if m["tag"]:
        tag = m["tag"].lower()
        return (lambda n: True) if tag == "*" else (lambda n: n.tag == tag)
    if m["cls"]:
        return lambda n, c=m["cls"]: c in n.classes
    if m["id"]:
        return lambda n, c=m["id"]: n.attrs.get("id") == c
    if m["attr"]:
        name, op = m["attr"].lower(), m["op"]
        value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
        compare = {
            None: lambda v: True, "=": lambda v: v == value, "~=": lambda v: value in v.split(), "^=": lambda v: bool(value) and v.startswith(value),
            "$=": lambda v: bool(value) and v.endswith(value), "*=": lambda v: bool(value) and value in v, "|=": lambda v: v == value or v.startswith(value + "-"),
        }[op]
        return lambda n: name in n.attrs and compare(n.attrs[name])
    if m["neg"] is not None:
        inner = [_compound(x.strip()) for x in m["neg"].split(",")]
        return lambda n: not any(t(n) for t in inner)
    if m["nth"]:
        return lambda n, k=int(m["nth"]): n.parent is not None and len(n.parent.children) >= k and n.parent.children[k - 1] is n
    at = 0 if m["pseudo"] == "first-child" else -1
    return lambda n: n.parent is not None and n.parent.children[at] is n


@functools.lru_cache(4096)
def _css(query: str):
    """Alternatives, each a list of (combinator, test) from the last compound back."""
    out = []
    for part in re.split(r",(?![^\[(]*[\])])", query):
        bits = re.findall(r"\s*([>+~])\s*|(\s+)|((?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+)", part.strip())
        chain, joiner = [], " "
        for mark, blank, compound in bits:
            if compound:
                chain.append((joiner, _compound(compound)))
                joiner = " "
            elif mark:
                joiner = mark
        if not chain:
            raise Unsupported(query)
        out.append(chain)
    return out


def _matches(node: Node, chain: list, at: int) -> bool:
    if not chain[at][1](node):
        return False
    if not at:
        return True
    joiner = chain[at][0]
    if joiner == ">":
        return node.parent is not None and _matches(node.parent, chain, at - 1)
    if joiner == "+":
        before = node.preceding()
        return before is not None and _matches(before, chain, at - 1)
    if joiner == "~":
        around = node.parent.children if node.parent is not None else []
        return any(_matches(x, chain, at - 1) for x in around if x.order < node.order)
    return any(_matches(a, chain, at - 1) for a in node.ancestors())


def css(root: Node, query: str) -> list[Node]:
    chains = _css(query)
    return [n for n in root.walk() if any(_matches(n, c, len(c) - 1) for c in chains)]


_STEP = re.compile(r"(//?)?((?:\[[^\]]*(?:\[[^\]]*\][^\]]*)*\]|[^/\[])+)")


def _predicate(text: str):
    text = text.strip()
    if text.isdigit():
        return "n", int(text)
    if text == "last()":
        return "n", -1
    if m := re.fullmatch(r"contains\(\s*(@[\w:-]+|text\(\)|\.)\s*,\s*(\"[^\"]*\"|'[^']*')\s*\)", text):
        return "t", lambda n, k=m[1], v=m[2][1:-1]: v in (n.attrs.get(k[1:].lower(), "") if k[0] == "@" else n.text)
    if m := re.fullmatch(r"(@[\w:-]+|text\(\)|\.)\s*=\s*(\"[^\"]*\"|'[^']*')", text):
        return "t", lambda n, k=m[1], v=m[2][1:-1]: (n.attrs.get(k[1:].lower()) if k[0] == "@" else n.text) == v
    if m := re.fullmatch(r"@([\w:-]+)", text):
        return "t", lambda n, k=m[1].lower(): k in n.attrs
    if re.fullmatch(r"[.\w*/\[\]@\"'=()-]+", text):
        _xpath(text)
        return "t", lambda n: bool(xpath(n, text))
    raise Unsupported(text)


@functools.lru_cache(4096)
def _xpath(query: str):
    steps, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _STEP.match(query, at)
        if not m or m.end() == at:
            raise Unsupported(query)
        at = m.end()
        body = re.fullmatch(r"(\.\.?|\*|[A-Za-z][\w-]*|@[\w:*-]+|text\(\))((?:\[.*\])?)", m[2].strip(), re.S)
        if not body:
            raise Unsupported(query)
        predicates, depth, start = [], 0, 0
        for i, c in enumerate(body[2]):
            depth += (c == "[") - (c == "]")
            if c == "[" and depth == 1:
                start = i + 1
            if c == "]" and not depth:
                predicates.append(_predicate(body[2][start:i]))
        steps.append((m[1] or "", body[1], predicates))
    if not steps:
        raise Unsupported(query)
    return steps


def xpath(root: Node, query: str) -> list[Node | str]:
    steps = _xpath(query)
    nodes: list = [root]
    first = True
    for slash, name, predicates in steps:
        if first and slash:
            top = root
            while top.parent is not None:
                top = top.parent
            document = Node("#document")
            document.items = [top]
            nodes = [document]
        first = False
        out, seen = [], set()
        for node in nodes:
            if name.startswith("@") or name == "text()":
                for n in [x for x in node.walk() if x.tag != "#document"] if slash == "//" else [node]:
                    if name == "text()":
                        out += [x for x in n.items if isinstance(x, str)]
                    elif name[1:].lower() in n.attrs:
                        out.append(n.attrs[name[1:].lower()])
                continue
            parents = list(node.walk()) if slash == "//" else [node]
            for p in parents:
                found = [p] if name == "." else ([p.parent] if p.parent is not None else []) if name == ".." else [c for c in p.children if name in ("*", c.tag)]
                for kind, test in predicates:
                    found = (found[test - 1 : test] if test > 0 else found[-1:]) if kind == "n" else [c for c in found if test(c)]
                for c in found:
                    if id(c) not in seen and c.tag != "#document":
                        seen.add(id(c))
                        out.append(c)
        if out and isinstance(out[0], Node):
            out.sort(key=lambda n: n.order)
        nodes = out
    return nodes
