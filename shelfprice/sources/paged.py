"""Listing pages as a data source: each store's landed pages are walked in order, and the walk ends by its own rules.

A page is a row (store_id, page, skus, last_page, total_pages) of Parquet files under store_id=... folders,
as a fetcher lands them. Whether a page brings anything new depends on all pages before it, so a store is
one partition, read from its first page on and never further than the walk goes; stores are read side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

ITEMS = "store_id string, page int, position int, sku string"
LISTINGS = "store_id string, pages int, received int, stated int, n_items int, stop string"

#: Why a walk ends.
EXHAUSTED, PAGE_CAP, PAGE_FAILED, AMBIGUOUS = "exhausted", "page_cap", "page_failed", "ambiguous"


@dataclass
class Walk:
    """What a walk over a store's pages has found: items (page, position, sku), pages read, items received, pages stated, and why it ended."""

    items: list = field(default_factory=list)
    pages: int = 0
    received: int = 0
    stated: int | None = None
    stop: str | None = None


def walk(landed: dict[int, dict], *, empty_pages: int, most_pages: int, until: int | None = None) -> Walk:
    """Reads pages 1, 2, ... of one store.

    The walk is exhausted after empty_pages pages in a row without a new sku, after a page that says it is
    the last, or after as many pages as the first one that states a number states; it is cut by most_pages,
    fails where a page is missing (an error if it is the first), and is ambiguous where a page has no items
    at all, unless one such page is the rule's end. A sku counts where it first stands. until: no page
    beyond it is wanted, the walk need not go on.
    """
    out, seen, streak, page = Walk(), set(), 0, 1
    while True:
        if page > min(most_pages, out.stated or most_pages):
            out.stop = EXHAUSTED if out.stated is not None and page > out.stated else PAGE_CAP
            return out
        if until is not None and page > until:
            return out
        one = landed.get(page)
        if one is None:
            if page == 1:
                raise ValueError("the first page is missing")
            out.stop = PAGE_FAILED
            return out
        out.pages, out.stated = page, out.stated if out.stated is not None else one.get("total_pages")
        skus = one.get("skus") or []
        out.received += len(skus)
        if not skus:
            out.stop = EXHAUSTED if empty_pages == 1 else AMBIGUOUS
            return out
        fresh = 0
        for position, sku in enumerate(skus):
            if sku is not None and sku not in seen:
                seen.add(sku)
                out.items.append((page, position, sku))
                fresh += 1
        streak = 0 if fresh else streak + 1
        if one.get("last_page") or streak >= empty_pages:
            out.stop = EXHAUSTED
            return out
        page += 1


@dataclass
class Store(InputPartition):
    """One store's folder."""

    store_id: str
    path: str


class PageReader(DataSourceReader):
    """A partition a store; stores and pages may be bounded."""

    def __init__(self, options: dict, listings: bool):
        self.options, self.listings = options, listings
        self.stores: set[str] | None = None
        self.first, self.last = 1, None

    def partitions(self) -> list[InputPartition]:
        files, root = pafs.FileSystem.from_uri(self.options["path"])
        found = []
        for info in files.get_file_info(pafs.FileSelector(root)):
            name = unquote(info.base_name)
            if info.type == pafs.FileType.Directory and name.startswith("store_id="):
                store = name.removeprefix("store_id=")
                if self.stores is None or store in self.stores:
                    found.append(Store(store, info.path))
        return sorted(found, key=lambda s: s.store_id) or [Store("", "")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        most = int(self.options.get("most_pages", 500))
        wanted = ds.field("page") <= (most if self.last is None else min(most, self.last))
        files, _ = pafs.FileSystem.from_uri(self.options["path"])
        landed = {r["page"]: r for r in ds.dataset(partition.path, filesystem=files, format="parquet").to_table(filter=wanted).to_pylist()}
        if self.last is not None and self.last < 1:
            return
        got = walk(landed, empty_pages=int(self.options.get("empty_pages", 2)), most_pages=most, until=self.last)
        if self.listings:
            yield partition.store_id, got.pages, got.received, got.stated, len(got.items), got.stop
        else:
            yield from ((partition.store_id, page, position, sku) for page, position, sku in got.items if page >= self.first)


class BoundedPageReader(PageReader):
    """Stores are pruned and pages bounded by pushed filters: no page after the last one wanted is read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("store_id",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.stores = wanted if self.stores is None else self.stores & wanted
            elif column == ("page",) and not self.listings and isinstance(f, EqualTo | LessThan | LessThanOrEqual | GreaterThan | GreaterThanOrEqual):
                low = f.value + 1 if isinstance(f, GreaterThan) else f.value if isinstance(f, EqualTo | GreaterThanOrEqual) else 1
                high = f.value - 1 if isinstance(f, LessThan) else f.value if isinstance(f, EqualTo | LessThanOrEqual) else None
                self.first = max(self.first, low)
                self.last = high if self.last is None else self.last if high is None else min(self.last, high)
            else:
                yield f


class ListingPages(DataSource):
    """listing_pages: options path, rows (items or listings), empty_pages (2), most_pages (500), push (true where the session pushes filters to Python sources)."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return LISTINGS if self.options.get("rows") == "listings" else ITEMS

    def reader(self, schema) -> PageReader:
        kind = BoundedPageReader if self.options.get("push") == "true" else PageReader
        return kind(dict(self.options), self.options.get("rows") == "listings")


def land_pages(pages: DataFrame, path: str) -> None:
    """Pages (store_id, page, skus, and where known last_page, total_pages) as the source reads them: a folder a store."""
    pages.repartition("store_id").write.partitionBy("store_id").parquet(path)


def read_listing(spark: SparkSession, path: str, *, rows: str = "items", empty_pages: int = 2, most_pages: int = 500) -> DataFrame:
    """What walks over the landed pages have found: items (store_id, page, position, sku), each sku of a store once, or listings (store_id, pages, received, stated, n_items, stop).

    Where spark.sql.python.filterPushdown.enabled is on, filters on store_id prune stores and those on page
    end the walks early.
    """
    spark.dataSource.register(ListingPages)
    push = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format("listing_pages").options(path=path, rows=rows, empty_pages=str(empty_pages), most_pages=str(most_pages), push=push).load()
