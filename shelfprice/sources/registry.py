"""Which reader a store's landed bodies are for: one of its own, else the one for its kind of site."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import html, items

#: What every reader gives for each item.
COLUMNS = ("slug", "page", "sku", "name", "url", "price", "old_price", "in_stock", "promo")
#: (slug, page, body) of some stores to COLUMNS.
Reader = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class StoreSpec:
    """What is known of a store's site: chain and category mean a JSON listing of that chain, a base url alone pages of cards."""

    slug: str
    chain: str | None = None
    category: str | None = None
    base_url: str | None = None


def json_reader(landed: DataFrame) -> DataFrame:
    """Bodies of one JSON item each."""
    return items.json_items(landed.select("slug", "page", "body")).select(*COLUMNS)


def card_reader(spec: html.CardSpec) -> Reader:
    """Bodies that are pages of cards; a card without a price is none."""

    def read(landed: DataFrame) -> DataFrame:
        found = html.cards(landed.select(F.struct("slug", "page").alias("at"), "body"), spec, id_col="at", html_col="body")
        rows = found.withColumns({"slug": F.col("at.slug"), "page": F.col("at.page"), "price": text.parse_price(F.col("price_text")), "old_price": text.parse_price(F.col("old_price_text"))})
        return rows.where("price is not null").select(*COLUMNS)

    return read


@dataclass
class Registry:
    """Readers by slug, and those for sites of a kind."""

    chain: Reader = json_reader
    pages: Reader = field(default_factory=lambda: card_reader(html.CardSpec("li.product", "h2")))
    special: dict[str, Reader] = field(default_factory=dict)

    def reader_of(self, spec: StoreSpec) -> Reader:
        """The reader of a store: its own, else the chain's, else that of pages; a store with none of these is an error."""
        if spec.slug in self.special:
            return self.special[spec.slug]
        if spec.chain or spec.category:
            return self.chain
        if spec.base_url:
            return self.pages
        raise ValueError(f"no reader for the store {spec.slug!r}")

    def read(self, landed: DataFrame, specs: list[StoreSpec]) -> DataFrame:
        """Items of all stores given, from landed bodies (slug, page, body); bodies of other stores are not read.

        Stores of one reader are read together, so the plan has a branch a reader, however many stores there are.
        """
        stores: dict[Reader, list[str]] = {}
        for spec in specs:
            stores.setdefault(self.reader_of(spec), []).append(spec.slug)
        if not stores:
            raise ValueError("no stores to read")
        out = None
        for reader, slugs in stores.items():
            rows = reader(landed.where(F.col("slug").isin(slugs)))
            out = rows if out is None else out.unionByName(rows)
        return out
