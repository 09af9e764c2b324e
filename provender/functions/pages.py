"""Fields of catalogue and shop pages. A page is read as a flat list of tags and texts with their depth;
each extractor looks for its marks in that list and gives typed structs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd

from .arrow import arrow
from .keys import folded

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Marks of the pages that are read.
BRAND_LINK = re.compile(r"/?brands-(?!\d+\.html)[^?#]+\.html\Z", re.I)
RECORD_FIELDS = ("goodsBarcode", "goodsShowName", "goodsSpec", "details")


class Item(NamedTuple):
    """A start tag (attrs) or a text, and how many tags are open around it."""

    tag: str
    attrs: dict
    text: str
    depth: int

    def has(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[Item] = []
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.items.append(Item(tag, {k: v or "" for k, v in attrs}, "", len(self.open)))
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.items.append(Item(tag, {k: v or "" for k, v in attrs}, "", len(self.open)))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        self.items.append(Item("", {}, data, len(self.open)))


def read(html: str | None) -> list[Item]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.items


def inside(items: list[Item], at: int) -> list[Item]:
    """What stands within the tag at a place."""
    end = at + 1
    while end < len(items) and items[end].depth > items[at].depth:
        end += 1
    return items[at + 1 : end]


def text_of(items: list[Item]) -> str:
    """The text of items with one space for white space; scripts and styles are no text."""
    parts, skip = [], None
    for x in items:
        if skip is not None and x.depth > skip:
            continue
        skip = x.depth if x.tag in ("script", "style") else None
        if not x.tag:
            parts.append(x.text)
    return " ".join(" ".join(parts).split())


def first(items: list[Item], test: Callable[[Item], bool]) -> int | None:
    return next((i for i, x in enumerate(items) if test(x)), None)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def brand_cards(html: str | None) -> list[tuple[str, str, str]]:
    """(name, href, category) of the brand list's cards: a card's class names the category's link."""
    items = read(html)
    categories: dict[str, str] = {}
    for i, x in enumerate(items):
        if x.tag == "a" and x.attrs.get("data-rel", "").startswith("cate-") and (name := text_of(inside(items, i))):
            categories.setdefault(x.attrs["data-rel"], name)
    out = []
    for i, x in enumerate(items):
        if x.tag != "div" or not x.has("item"):
            continue
        card = inside(items, i)
        link = first(card, lambda y: y.tag == "a")
        if link is None or not BRAND_LINK.match(card[link].attrs.get("href", "")):
            continue
        body = inside(card, link)
        image = first(body, lambda y: y.tag == "img")
        name = squeezed((body[image].attrs.get("alt", "") if image is not None else "") or text_of(body))
        category = next((c for c in x.attrs["class"].split() if c.startswith("cate-")), "")
        if name:
            out.append((name, card[link].attrs["href"], categories.get(category, "")))
    return out


def sitemap_links(html: str | None) -> list[tuple[str, str, str]]:
    items = read(html)
    found = ((text_of(inside(items, i)), x.attrs.get("href", "")) for i, x in enumerate(items) if x.tag == "a")
    return [(name, href, "") for name, href in found if name and BRAND_LINK.match(href)]


def brand_page(html: str | None) -> tuple[str, str, list, list] | None:
    """(name, description, products (name, image), links (name, href)) of a brand's page; null without its introduction."""
    items = read(html)
    at = first(items, lambda x: x.tag == "div" and x.has("product-introduction"))
    if at is None:
        return None
    intro = inside(items, at)
    heading = first(intro, lambda x: x.tag == "h2")
    body = first(intro, lambda x: x.tag == "div" and x.has("bd"))
    said: list[Item] = []
    if body is not None:
        inner = inside(intro, body)
        end = first(inner, lambda x: x.depth == intro[body].depth + 1 and x.has("box"))
        said = inner[:end]
    products, met = [], set()
    for i, x in enumerate(intro):
        if x.tag != "div" or not x.has("product-box"):
            continue
        box = inside(intro, i)
        named = first(box, lambda y: bool(y.attrs.get("data-name")))
        name = squeezed(box[named].attrs["data-name"]) if named is not None else ""
        if not name and (d := first(box, lambda y: y.tag == "div" and y.has("description"))) is not None:
            name = text_of(inside(box, d))
        image = first(box, lambda y: y.tag == "img")
        if name and name.casefold() not in met:
            met.add(name.casefold())
            products.append((name, box[image].attrs.get("src", "") if image is not None else ""))
    links: list[tuple[str, str]] = []
    quick = first(intro, lambda x: x.tag == "div" and x.has("qlink"))
    if quick is not None:
        box = inside(intro, quick)
        links = [(text_of(inside(box, i)), x.attrs["href"]) for i, x in enumerate(box) if x.tag == "a" and x.attrs.get("href")]
    return text_of(inside(intro, heading)) if heading is not None else "", text_of(said), products, links


class _Anchors(HTMLParser):
    """Keeps the links to products alone: a list page can hold very many of them, and other tags beside each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[tuple[str, str], None] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            own = {k: v or "" for k, v in attrs}
            pair = own.get("data-rel", "").strip(), squeezed(own.get("data-name", ""))
            if pair[0].isdigit() and pair[1]:
                self.found[pair] = None


def product_anchors(html: str | None) -> list[tuple[str, str]]:
    """(product_id, name) of links to products, each pair once."""
    reader = _Anchors()
    reader.feed(html or "")
    reader.close()
    return list(reader.found)


def product_heading(html: str | None) -> tuple[str, str]:
    """(name, serving): the heading's text without, and with nothing but, its grey part."""
    items, name, serving = read(html), [], []
    for i, x in enumerate(items):
        if x.tag == "h1":
            grey: set[int] = set()
            body = inside(items, i)
            for j, y in enumerate(body):
                if y.tag == "span" and y.has("gray"):
                    grey.update(range(j, j + 1 + len(inside(body, j))))
            name += [y.text for j, y in enumerate(body) if not y.tag and j not in grey]
            serving += [y.text for j, y in enumerate(body) if not y.tag and j in grey]
    return squeezed(" ".join(name)), squeezed(" ".join(serving))


def _scripts(html: str | None, test: Callable[[dict], bool]) -> list[str]:
    items = read(html)
    return ["".join(y.text for y in inside(items, i)) for i, x in enumerate(items) if x.tag == "script" and test(x.attrs)]


def json_ld_products(html: str | None) -> list[tuple[str, str]]:
    """(name, url) of the Product objects embedded in a page."""
    out = []
    for text in _scripts(html, lambda a: a.get("type") == "application/ld+json"):
        try:
            data = json.loads(text)
        except ValueError:
            continue
        if isinstance(data, dict) and data.get("@type") == "Product":
            name, url = (str(data.get(k) or "").strip() for k in ("name", "url"))
            if name and url:
                out.append((name, url))
    return out


def embedded_record(html: str | None) -> tuple[str | None, ...]:
    """(barcode, name, specification, details) of the product in a page's data, whose values are places in one array."""
    try:
        nodes = json.loads("".join(_scripts(html, lambda a: a.get("id") == "__NUXT_DATA__")))
    except ValueError:
        return (None,) * 4
    record = next((n for n in nodes if isinstance(n, dict) and all(f in n for f in RECORD_FIELDS)), None) if isinstance(nodes, list) else None
    if record is None:
        return (None,) * 4
    values = []
    for f in RECORD_FIELDS:
        v = record[f]
        v = nodes[v] if isinstance(v, int) and 0 <= v < len(nodes) else v
        values.append(v if isinstance(v, str) or v is None else str(v))
    return tuple(values)


def table_rows(html: str | None) -> list[tuple[str, str]]:
    """(label, text) of table rows with two cells or more; line breaks stay."""
    items, out = read(html), []
    for i, x in enumerate(items):
        if x.tag == "tr":
            row = inside(items, i)
            cells = ["".join("\n" if y.tag == "br" else y.text for y in inside(row, j)).strip() for j, z in enumerate(row) if z.tag == "td"]
            if len(cells) >= 2:
                out.append((squeezed(cells[0]), cells[1]))
    return out


def search_links(html: str | None) -> list[tuple[str, str]]:
    """(href, title) of a search page's results: links of the class result-link."""
    items = read(html)
    found = ((x.attrs.get("href", ""), text_of(inside(items, i))) for i, x in enumerate(items) if x.tag == "a" and (x.has("result-link") or x.has("result__a")))
    return [(h, t) for h, t in found if h and t]


def summary(html: str | None) -> tuple[str | None, str | None, int]:
    """(title, first heading, links) of any page."""
    items = read(html)
    t, h = first(items, lambda x: x.tag == "title"), first(items, lambda x: x.tag == "h1")
    return text_of(inside(items, t)) if t is not None else None, text_of(inside(items, h)) if h is not None else None, sum(x.tag == "a" for x in items)


def listed(f: Callable, *names: str):
    """An extractor that gives a list of structs of texts."""
    kind = f"array<struct<{','.join(f'{n}:string' for n in names)}>>"

    @arrow(kind)
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, row)) for row in f(p)] for p in pages], dtype=object)

    return extract


brand_cards_of = listed(brand_cards, "name", "href", "category")
sitemap_links_of = listed(sitemap_links, "name", "href", "category")
product_anchors_of = listed(product_anchors, "product_id", "name")
json_ld_products_of = listed(json_ld_products, "name", "url")
# with the keys of names, which would be a second Python worker beside every task
anchor_keys_of = listed(lambda html: [(*a, folded(a[1])) for a in product_anchors(html)], "product_id", "name", "key")
json_ld_keys_of = listed(lambda html: [(*p, folded(p[0])) for p in json_ld_products(html)], "name", "url", "key")
table_rows_of = listed(table_rows, "label", "text")
search_links_of = listed(search_links, "href", "title")


@arrow("barcode string, name string, specification string, details string")
def embedded_record_of(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([embedded_record(p) for p in pages], columns=["barcode", "name", "specification", "details"], dtype=object)


@arrow("barcode string, name string, specification string, details string, rows array<struct<label:string,text:string>>")
def shop_record_of(pages: pd.Series) -> pd.DataFrame:
    """``embedded_record_of`` a page, with ``table_rows_of`` its details."""
    records = [embedded_record(p) for p in pages]
    rows = [(*r, [dict(zip(("label", "text"), x)) for x in table_rows(r[3])]) for r in records]
    return pd.DataFrame(rows, columns=["barcode", "name", "specification", "details", "rows"], dtype=object)


@arrow("name string, serving string")
def product_heading_of(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([product_heading(p) for p in pages], columns=["name", "serving"], dtype=object)


@arrow("name string, description string, products array<struct<name:string,src:string>>, links array<struct<name:string,href:string>>")
def brand_page_of(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for p in pages:
        name, said, products, links = brand_page(p) or (None, None, None, None)
        rows.append((name, said, products and [{"name": n, "src": s} for n, s in products], links and [{"name": n, "href": h} for n, h in links]))
    return pd.DataFrame(rows, columns=["name", "description", "products", "links"], dtype=object)


@arrow("title string, h1 string, links long")
def summary_of(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([summary(p) for p in pages], columns=["title", "h1", "links"]).astype({"links": "int64"})
