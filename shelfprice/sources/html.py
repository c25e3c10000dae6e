"""HTML pages as rows: cards, attribute tables and text, in column expressions.

A page becomes an array of tokens, tags and the text between them, in the order of the page; comments,
declarations, scripts and styles are none. An element is the run of tokens from its opening tag to the
closing tag of its own depth, or to the end where it has none, so pages that are not well-formed are read as
far as they go. Cards are rows only from where they are exploded on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SELECTOR = re.compile(r"(?P<tag>[a-z][a-z0-9]*)?(?P<classes>(?:\.[\w-]+)*)(?:\[(?P<attr>[\w-]+)\])?")
#: Elements without content.
_VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
_SKIPPED = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[!?][^>]*>"
_TOKEN = r"(</?[A-Za-z][^>]*>|[^<]+|<)"


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def unescaped(text: Column) -> Column:
    """Text with its character references, named or by number, as characters; unknown ones stay."""
    named = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])

    def char(piece: Column) -> Column:
        body = F.regexp_extract(piece, "^&([^;]+);$", 1)
        code = F.when(body.rlike("^#[0-9]{1,7}$"), F.substring(body, 2, 9).cast("int")).when(body.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substring(body, 3, 9), 16, 10).cast("int"))
        wide = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.coalesce(F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), wide), F.try_element_at(named, body), piece)

    pieces = F.regexp_extract_all(text, F.lit("(&#?[0-9A-Za-z]+;|[^&]+|&)"), 1)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^&.+;$"), char(p)).otherwise(p)), "")).otherwise(text)


def tokens(html: Column) -> Column:
    """A page's tags and texts; none of a null page. What is skipped leaves a closing tag of nothing, so that texts around it stay apart."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), _SKIPPED, "</z>"), F.lit(_TOKEN), 1)


def _is_tag(token: Column) -> Column:
    return token.rlike("^</?[A-Za-z]")


def attribute(token: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; null where it has none."""
    of = lambda i: F.regexp_extract(token, rf"(?is)^<[^>]*?\s{re.escape(name)}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", i)
    has = token.rlike(rf"(?is)^<[A-Za-z][^>]*?\s{re.escape(name)}(?=[\s=/>])")
    return F.when(has, unescaped(F.concat(of(1), of(2), of(3))))


def _matches(token: Column, selector: str) -> Column:
    """Whether a token is the opening tag of an element that matches tag.class[attribute]."""
    m = _SELECTOR.fullmatch(selector)
    if not m or not selector:
        raise ValueError(f"no selector: {selector!r}")
    out = token.rlike(rf"(?i)^<{m['tag']}(?=[\s/>])" if m["tag"] else "^<[A-Za-z]")
    if m["classes"]:
        own = F.split(F.coalesce(attribute(token, "class"), F.lit("")), r"\s+")
        for c in filter(None, m["classes"].split(".")):
            out = out & F.array_contains(own, c)
    return out & attribute(token, m["attr"]).isNotNull() if m["attr"] else out


def _element_at(page: Column, start: Column) -> Column:
    """The tokens of the element that opens at a place (from 1)."""
    opening = F.element_at(page, start)
    tag = F.lower(F.regexp_extract(opening, "^<([A-Za-z][A-Za-z0-9]*)", 1))
    rest = F.slice(page, start + 1, F.size(page))

    def step(state: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
        change = F.when(name != tag, 0).when(token.startswith("</"), -1).when(token.rlike("/>$"), 0).otherwise(1)
        depth = F.when(state["depth"] > 0, state["depth"] + change).otherwise(0)
        return F.struct(depth.alias("depth"), (state["n"] + (state["depth"] > 0).cast("int")).alias("n"))

    size = F.aggregate(rest, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)["n"]
    return F.when(tag.rlike(f"^(?:{_VOID})$") | opening.rlike("/>$"), F.slice(page, start, F.lit(1))).otherwise(F.slice(page, start, size + 1))


def elements(page: Column, selector: str) -> Column:
    """All elements that match, each as its tokens, in the order of the page; those within others too."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(page), F.lit(1))), lambda i: F.coalesce(_matches(F.get(page, i - 1), selector), F.lit(False)))
    return F.transform(places, lambda i: _element_at(page, i))


def first_element(page: Column, selector: str) -> Column:
    """The first element that matches; null where none does."""
    place = F.filter(F.sequence(F.lit(1), F.greatest(F.size(page), F.lit(1))), lambda i: F.coalesce(_matches(F.get(page, i - 1), selector), F.lit(False)))
    return _let(F.get(place, F.lit(0)), lambda i: F.when(i.isNotNull(), _element_at(page, i)))


def _texts(page: Column) -> Column:
    return F.transform(F.filter(page, lambda t: ~_is_tag(t)), unescaped)


def stripped_text(page: Column) -> Column:
    """Text nodes, each trimmed, one after the other."""
    return F.array_join(F.transform(_texts(page), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), "")


def rich_text(page: Column) -> Column:
    """All text with a blank after each element; white space as single blanks."""
    return F.trim(F.regexp_replace(F.array_join(_texts(page), " "), r"(?U)\s+", " "))


def first_text(page: Column, selector: str) -> Column:
    """The stripped text of the first element that matches; null where there is none, or no text in it."""
    return F.nullif(stripped_text(first_element(page, selector)), F.lit(""))


def first_attribute(page: Column, selector: str, name: str) -> Column:
    """The first value that is not empty of an attribute among the elements that match."""
    values = F.transform(F.filter(page, lambda t: _matches(t, selector)), lambda t: attribute(t, name))
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def attribute_table(page: Column) -> Column:
    """Rows of th and td as a map of label (lower case) to value; the last of equal labels counts."""
    pair = lambda row: F.struct(F.lower(F.regexp_replace(first_text(row, "th"), ":+$", "")).alias("key"), first_text(row, "td").alias("value"))
    known = F.filter(F.transform(elements(page, "tr"), pair), lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(_let(known, last))


def labelled(lines: Column, labels: dict[str, str]) -> Column:
    """Of "label: value" lines a struct of the first value of each field, by the beginning of its label."""

    def first(name: str) -> Column:
        starts = [p for p, field in labels.items() if field == name]
        hit = lambda line: F.contains(line, F.lit(":")) & (F.trim(F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1)) != "")
        label = lambda line: F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1)))
        begins = lambda line: F.lit(False) if not starts else F.greatest(*[label(line).startswith(p) for p in starts], F.lit(False))
        return F.get(F.transform(F.filter(lines, lambda x: hit(x) & begins(x)), lambda x: F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1))), F.lit(0)).alias(name)

    return F.struct(*[first(name) for name in dict.fromkeys(labels.values())])


@dataclass(frozen=True)
class CardSpec:
    """Where a listing's cards keep their fields: selectors, and classes that mark sold out and sale."""

    card: str
    title: str
    link: str = "a[href]"
    sku_attr: str = "data-product_id"
    price: str = ".price"
    sale: str = "ins"
    struck: str = "del"
    sold_out: str = "outofstock"
    promo: str = "sale"


def cards(pages: DataFrame, spec: CardSpec, *, id_col="page_id", html_col="html") -> DataFrame:
    """A row for each card of each page with its position (from 0): sku, name, url, price and old price as text, in_stock, promo.

    Without a sku or a title a card is none; pages without cards, null and empty ones have none. The sale
    price goes before the price, and only then what was struck is an old price.
    """
    found = pages.select(F.col(id_col), tokens(F.col(html_col)).alias("__page")).select(id_col, F.posexplode(elements(F.col("__page"), spec.card)).alias("position", "__card"))
    card = F.col("__card")
    own = F.split(F.coalesce(attribute(card[0], "class"), F.lit("")), r"\s+")
    sale, struck = first_text(card, spec.sale), first_text(card, spec.struck)
    rows = found.select(
        id_col, first_attribute(card, f"[{spec.sku_attr}]", spec.sku_attr).alias("sku"), first_text(card, spec.title).alias("name"), first_attribute(card, spec.link, "href").alias("url"),
        F.coalesce(sale, first_text(card, spec.price)).alias("price_text"), F.when(sale.isNotNull(), struck).alias("old_price_text"), (~F.array_contains(own, spec.sold_out)).alias("in_stock"),
        (F.array_contains(own, spec.promo) | (sale.isNotNull() & struck.isNotNull())).alias("promo"), "position",
    )
    return rows.where("sku is not null and name is not null")


def first_seen(listing: DataFrame, *, store_col="store_id", page_col="page") -> DataFrame:
    """Cards of a walk over pages, each sku of a store where it first stands: by page, then by position."""
    rest = [c for c in listing.columns if c not in (store_col, "sku")]
    first = listing.groupBy(store_col, "sku").agg(F.min_by(F.struct(*rest), F.struct(page_col, "position")).alias("__first"))
    return first.select(*[F.col(c) if c in (store_col, "sku") else F.col(f"__first.{c}").alias(c) for c in listing.columns])


def page_text(pages: DataFrame, *, id_col="page_id", html_col="html") -> DataFrame:
    """Each page's title, stripped text, rich text, number of links and attribute table."""
    page = F.col("__page")
    links = F.size(F.filter(page, lambda t: _matches(t, "a[href]"))).cast("long")
    return pages.select(F.col(id_col), tokens(F.col(html_col)).alias("__page")).select(
        id_col, first_text(page, "title").alias("title"), stripped_text(page).alias("stripped"), rich_text(page).alias("rich"), links.alias("links"), attribute_table(page).alias("attributes")
    )
