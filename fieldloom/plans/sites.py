"""Three synthetic sites with known records: product cards, postings with a definition list, a prose listing."""

from __future__ import annotations

import json
import random

WORDS = "amber birch cedar delta ember fjord grove heron isle juniper kelp larch maple nectar ocean pine quartz river slate tundra umber violet willow yarrow zephyr".split()
CITIES = ["Lisbon", "Oslo", "Kraków", "Turin", "Ghent", "Malmö"]


def _css(q: str, attr: str | None = None) -> dict:
    return {"kind": "css", "q": q} | ({"attr": attr} if attr else {})


def _field(stack: list[dict], transform: str = "text", *validators: dict) -> dict:
    return {"stack": stack, "transform": transform, "validators": list(validators), "min_fill": 0.95}


POSITIVE = {"type": "number", "min": 0.01}
SPECS = {
    "shop": {
        "site": "shop", "version": 1, "record_selector": [_css("article.card"), _css(".grid article")],
        "fields": {
            "sku": _field([_css("article", "data-sku"), {"kind": "jsonld", "q": "sku"}]), "name": _field([_css(".name"), {"kind": "jsonld", "q": "name"}], "text", {"type": "nonempty"}), "price": _field([_css(".price"), {"kind": "regex", "q": r"[$](\d[\d.,]*)"}], "money", POSITIVE),
            "stock": _field([_css(".stock")], "text", {"type": "enum", "values": ["In stock", "Sold out", "Few left"]}),
        },
    },
    "jobs": {
        "site": "jobs", "version": 1, "record_selector": [_css("section.posting"), {"kind": "xpath", "q": "//section[.//dl]"}],
        "fields": {
            "title": _field([_css("h3"), _css('[itemprop="title"]')]), "company": _field([_css('[itemprop="hiringOrganization"]'), {"kind": "text_anchor", "q": "Company", "rel": "next_sibling_text"}]), "location": _field([{"kind": "text_anchor", "q": "Location", "rel": "next_sibling_text"}]),
            "salary": _field([{"kind": "text_anchor", "q": "Salary", "rel": "next_sibling_text"}, {"kind": "jsonld", "q": "baseSalary.value"}], "money", POSITIVE), "posted": _field([_css("time", "datetime")], "iso_date"),
        },
    },
    "news": {
        "site": "news", "version": 1, "record_selector": [_css("li.story"), _css("ol > li")],
        "fields": {"title": _field([_css("a.headline")]), "url": _field([_css("a.headline", "href")], "url", {"type": "url"}), "points": _field([_css(".score"), {"kind": "regex", "q": r"(\d+) points"}], "int"), "author": _field([_css(".by")])},
    },
}


def _name(r: random.Random, n: int = 2) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).title()


def page(site: str, seed: int = 1, n: int = 24) -> str:
    r = random.Random(f"{site}{seed}")
    body, objects = [], []
    for i in range(n):
        if site == "shop":
            name, price, stock, sku = f"{_name(r)} {i}", f"{r.uniform(5, 400):.2f}", r.choice(["In stock", "Sold out", "Few left"]), f"SK-{1000 + i * 7}"
            body.append(f'<article class="card" data-sku="{sku}"><h4 class="name">{name}</h4><span class="price">${price}</span><em class="stock">{stock}</em></article>')
            objects.append({"@type": "Product", "sku": sku, "name": name, "offers": {"price": price}})
        elif site == "jobs":
            title, firm, city, pay, day = f"{_name(r, 1)} engineer {i}", f"{_name(r)} Ltd", r.choice(CITIES), r.randint(30, 120) * 1000, f"2024-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
            body.append(f'<section class="posting"><h3 itemprop="title">{title}</h3><dl><dt>Company</dt><dd itemprop="hiringOrganization">{firm}</dd><dt>Location</dt><dd>{city}</dd><dt>Salary</dt><dd>€{pay:,}</dd></dl><time datetime="{day}">{day}</time></section>')
            objects.append({"@type": "JobPosting", "title": title, "baseSalary": {"value": str(pay)}, "datePosted": day})
        else:
            title, points, by = f"{_name(r, 4)} {i}", r.randint(1, 900), r.choice(WORDS) + str(r.randint(1, 99))
            body.append(f'<li class="story"><a class="headline" href="/item/{i}">{title}</a><p class="meta"><span class="score">{points} points</span> by <span class="by">{by}</span></p></li>')
    script = f'<script type="application/ld+json">{json.dumps({"@graph": objects})}</script>' if objects else ""
    inner = f"<ol>{''.join(body)}</ol>" if site == "news" else f'<div class="grid">{"".join(body)}</div>'
    nav = '<nav><ul><li class="menu">Home</li><li class="menu">About</li></ul></nav>'
    return f"<!DOCTYPE html><html><head><title>{site}</title>{script}</head><body>{nav}<main>{inner}</main><footer>© {site} by someone</footer></body></html>"
