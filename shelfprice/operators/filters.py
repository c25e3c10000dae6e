"""Report filters: optional predicates over current offers; what is not asked for adds no predicate."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
_TRAILING_AGE = re.compile(r"(.*\S)\s+([0-9]{1,2})", re.DOTALL)


def split_age(term: str | None) -> tuple[str, int] | None:
    """A search that ends in a number of one or two digits: the name before it, and the number as an age."""
    m = _TRAILING_AGE.fullmatch((term or "").strip())
    return (m[1], int(m[2])) if m else None


@dataclass(frozen=True)
class OfferFilter:
    """Constraints on current offers; None and empty lists constrain nothing."""

    stores: Sequence[str] | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_volume: int | None = None
    max_volume: int | None = None
    countries: Sequence[str] | None = None
    name: str | None = None
    types: Sequence[str] | None = None
    flavors: Sequence[str] | None = None
    exclude_flavors: Sequence[str] | None = None
    favorites_only: bool = False
    in_stock_only: bool = True


def filter_offers(
    offers: DataFrame, wanted: OfferFilter, *, blacklist_products: DataFrame | None = None, blacklist_brands: DataFrame | None = None, favorites: DataFrame | None = None,
) -> DataFrame:
    """Offers that meet all constraints.

    Ranges are inclusive and a null volume fails them. The type "unknown" asks for offers without a type.
    A name also matches as name plus age where it ends in a number. Blacklists are frames of product_id
    and brand; rows without a brand survive a brand blacklist. favorites is a frame of product_id.
    """
    out = offers.where("in_stock") if wanted.in_stock_only else offers
    if wanted.stores:
        out = out.where(F.col("slug").isin(list(wanted.stores)))
    for column, low, high in (("price", wanted.min_price, wanted.max_price), ("volume_ml", wanted.min_volume, wanted.max_volume)):
        out = out.where(F.col(column) >= low) if low is not None else out
        out = out.where(F.col(column) <= high) if high is not None else out
    if wanted.countries:
        out = out.where(F.lower("country").isin([c.lower() for c in wanted.countries]))
    if wanted.name and wanted.name.strip():
        hit = F.col("name").ilike(f"%{wanted.name.strip()}%")
        if split := split_age(wanted.name):
            hit = hit | (F.col("name").ilike(f"%{split[0]}%") & (F.col("age") == split[1]))
        out = out.where(hit)
    if wanted.types:
        known = [t for t in wanted.types if t != UNKNOWN]
        hit = F.col("type").isin(known) if known else F.lit(False)
        out = out.where(hit | F.col("type").isNull() if UNKNOWN in wanted.types else hit)
    if wanted.flavors:
        out = out.where(F.arrays_overlap("flavors", F.array(*map(F.lit, wanted.flavors))))
    if wanted.exclude_flavors:
        out = out.where(~F.arrays_overlap("flavors", F.array(*map(F.lit, wanted.exclude_flavors))))
    if blacklist_products is not None:
        out = out.join(blacklist_products.select("product_id").distinct(), "product_id", "left_anti")
    if blacklist_brands is not None:
        out = out.join(blacklist_brands.select("brand").where("brand is not null").distinct(), "brand", "left_anti").select(*offers.columns)
    if wanted.favorites_only:
        out = out.where(F.lit(False)) if favorites is None else out.join(favorites.select("product_id").distinct(), "product_id", "left_semi").select(*offers.columns)
    return out
