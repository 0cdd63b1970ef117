"""The tree, the selectors and extraction by a spec."""

import pytest

from fieldloom.sources import extract, selectors
from fieldloom.sources.html_tree import parse

ROWS = "<ul><li class=row><span class='price x'>$5</span><h4>A</h4><em>Qty: 3</em><li class=row><span class=price>n/a</span><h4>B</h4><em>Qty: 4</em></ul>"
LD = '<script type="application/ld+json">[{"@type":"WebSite"},{"@graph":[{"@type":"Product","offers":[{"price":"1"}]},{"@type":"Product","offers":{"price":"2"}}]}]</script><div class=p>x</div><div class=p>y</div>'


@pytest.mark.parametrize("html", [None, "", " \n", "not html", "<p>unclosed <b>x", "<table><tr><td>1<td>2<tr><td>3</table>", "&eacute;&#0;&bogus;", "<div id=a><div id=a>", "<script type='application/ld+json'>{bad</script>", "\x00\x01", "<a b='" + "x" * 100_000 + "'>", "<i>" * 3000, "<![CDATA[x]]>", "<!--", "</b></p>"])
def test_hostile_pages(html):
    root = parse(html)
    assert root.tag == "html" and any(n.tag == "body" for n in root.walk())
    extract.page_hits(html, {"record_selector": [{"kind": "css", "q": "p"}], "fields": {"a": {"stack": [{"kind": "xpath", "q": "."}]}}})


def test_implied_ends():
    root = parse("<ul><li>a<li>b</ul><p>c<p>d<dl><dt>e<dd>f<dt>g</dl><table><tr><td>1<td>2<tr><td>3</table>")
    count = lambda q: len(selectors.css(root, q))
    assert [count(q) for q in ("ul > li", "body > p", "dl > dt", "dl > dd", "tr", "tr > td")] == [2, 2, 2, 1, 2, 3]


@pytest.mark.parametrize(
    ("html", "text"),
    [("R&amp;D &copy; &quot;x&quot; &eacute;&#39;&#x41;", "R&D © \"x\" é'A"), ("a &amp; b &amp", "a & b &amp"), ("&quot &copy &ampx; &bogus; &am &", "&quot &copy &ampx; &bogus; &am &"), ("&amp;amp &amp;quot;", "&amp &quot;"), ("\ufdd0 &amp \ufdd1", "\ufdd0 &amp \ufdd1")],
)
def test_references_end_in_semicolons(html, text):
    node = selectors.css(parse(f"<a&amp href='?a=1&amp;b=2&copy=3' x>{html}</a&amp><script>a &&amp b; &amp;</script>"), "body > *")
    assert [n.tag for n in node] == ["a&amp", "script"]
    assert node[0].text == text and node[0].attrs == {"href": "?a=1&b=2&copy=3", "x": ""}
    assert node[1].text == "a &&amp b; &amp;"


@pytest.mark.parametrize(
    ("query", "n"),
    [("li", 2), (".row", 2), ("li.row .price", 2), ("span.price.x", 1), ("span.price:not(.x)", 1), ("ul > li > h4", 2), ("h4, em", 4), ('[class="price"]', 1), ("[class^=pri]", 2), ("li:nth-child(2) h4", 1), ("h4 + em", 2), ("span ~ em", 2), ("*", 11), ("#none", 0)],
)
def test_css(query, n):
    assert len(selectors.css(parse(ROWS), query)) == n


@pytest.mark.parametrize(("query", "n"), [("//li", 2), (".//h4", 2), ("//li[2]/h4", 1), ("//li[.//em]", 2), ("//span[@class]", 2), ('//span[contains(@class, "x")]', 1), ("//ul/*[1]", 1), ("//h4/text()", 2), ("//span/@class", 2), (".", 1), ('//h4[text()="B"]', 1), ("//li[last()]", 1)])
def test_xpath(query, n):
    assert len(selectors.xpath(parse(ROWS), query)) == n


@pytest.mark.parametrize("query", ["li::before", "a[", ">", "li:hover", "//li[position()>1]", "count(//a)", ""])
def test_unsupported_queries_are_misses(query):
    for kind in ("css", "xpath"):
        assert extract.nodes_of(parse(ROWS), {"kind": kind, "q": query}) in ([],) or kind == "xpath"


def test_css_matches_the_root_itself():
    article = selectors.css(parse("<article data-sku=1><b>x</b></article>"), "article")[0]
    assert selectors.css(article, "article") == [article]


def resolve(html, locator, root="body"):
    page = extract.Page.of(html)
    return extract.resolve_all(selectors.css(page.document, root)[0], locator, page, 0)


def test_locators():
    assert resolve(ROWS, {"kind": "css", "q": ".price"}) == ["$5", "n/a"]
    assert resolve(ROWS, {"kind": "regex", "q": r"Qty: (\d+)"}) == ["3", "4"]
    assert resolve(ROWS, {"kind": "regex", "q": "("}) == []
    assert resolve(ROWS, {"kind": "text_anchor", "q": "Qty", "rel": "after_colon"}, "em") == ["3"]
    pair = "<dl><dt>City</dt><dd>Oslo</dd></dl>"
    assert resolve(pair, {"kind": "text_anchor", "q": "city", "rel": "next_sibling_text"}, "dt") == ["Oslo"]
    assert resolve("<p><b>City</b></p><p>Oslo</p>", {"kind": "text_anchor", "q": "city", "rel": "parent_sibling_text"}, "b") == ["Oslo"]
    assert resolve(LD, {"kind": "jsonld", "q": "offers.price"}) == ["1"]
    assert resolve(LD, {"kind": "jsonld", "q": "offers.none"}) == []


def test_json_roots_and_alignment():
    page = extract.Page.of(LD)
    assert len(page.objects) == 2
    roots, tier = extract.roots_of(page, [{"kind": "css", "q": ".none"}, {"kind": "regex", "q": "x"}, {"kind": "jsonld", "q": "Product"}])
    assert tier == 2 and [extract.resolve_all(r, {"kind": "jsonld", "q": "offers.price"}, page, i) for i, r in enumerate(roots)] == [["1"], ["2"]]
    assert extract.resolve_all(roots[0], {"kind": "css", "q": "p"}, page, 0) == []
    assert extract.aligned([{"@type": "B"}, {"@type": "A"}]) == [{"@type": "B"}, {"@type": "A"}]


SPEC = {"site": "s", "version": 1, "record_selector": [{"kind": "css", "q": "li.row"}], "fields": {"price": {"stack": [{"kind": "css", "q": ".price"}, {"kind": "regex", "q": r"Qty: (\d+)"}], "transform": "money", "validators": [{"type": "number", "max": 100}]}, "name": {"stack": [{"kind": "css", "q": "h4"}], "validators": [{"type": "regex", "pattern": "A"}]}}}


def test_stack_and_provenance(spark):
    pages = spark.createDataFrame([(1, ROWS), (2, None)], "page_id long, html string")
    found = extract.hits(pages, SPEC, ["page_id"])
    rows = {(r["page_id"], r["record"], r["field"]): (r["value"], r["number"], r["tier"], r["n_hits"], r["failed_validator"]) for r in extract.results(found, SPEC, ["page_id"]).collect()}
    assert rows == {(1, 0, "price"): ("5", 5.0, 0, 1, None), (1, 1, "price"): ("4", 4.0, 1, 1, None), (1, 0, "name"): ("A", None, 0, 1, None), (1, 1, "name"): (None, None, None, 0, "regex")}
    heads = {r["page_id"]: (r["n_records"], r["root_tier"]) for r in extract.headers(found, ["page_id"]).collect()}
    assert heads == {1: (2, 0), 2: (0, None)}
