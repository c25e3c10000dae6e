"""User-facing reports over current offers: catalogue, drops, lows, new listings, best offers, history.

A report is a frame with one row a group: group_id (its first offer's id), the first offer's fields and
``offers``, an array that is never empty, cheapest first. ``flat`` gives one row an offer instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.star import Star
from ..sources.stored import since_day
from .offers import discount_percent, price_extremes, price_since

#: Fixed values of the reports.
NEW_DAYS = 7
WINDOW_DAYS = {"today": 1, "yesterday": 2, "week": 7, "month": 30, "year": 365}
BEST_GUARD = 0.5
BEST_STORES = 2
PAGE_SIZES = (50, 100, 150, 200)
SORT_FIELDS = ("price", "reference", "discount", "name", "brand", "type", "country", "store_name", "age", "volume_ml", "days")

_FIELDS = ("price", "store_name", "offer_id", "slug", "product_id", "name", "brand", "type", "country", "age", "volume_ml", "captured_on", "first_seen", "reference", "discount", "days")


def _enriched(offers: DataFrame, reference: Column, days: Column | None = None) -> DataFrame:
    out = offers.withColumn("reference", reference)
    return out.withColumns({"discount": discount_percent(F.col("price"), F.col("reference")), "days": F.lit(None).cast("int") if days is None else days.cast("int")})


def group_offers(rows: DataFrame, by: str = "product_id") -> DataFrame:
    """Groups with their offers by (price, store name, id); the group's fields are those of its first offer."""
    grouped = rows.groupBy(F.col(by).alias("group_key")).agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("offers"))
    first = F.col("offers")[0]
    return grouped.select(first["offer_id"].alias("group_id"), *[first[f].alias(f) for f in _FIELDS], "offers")


def flat(groups: DataFrame) -> DataFrame:
    """One row an offer: group_id, offer_rank (from 0, cheapest first), offer_id, product_id, price, reference, discount, days."""
    rows = groups.select("group_id", F.posexplode("offers").alias("offer_rank", "o"))
    return rows.select("group_id", "offer_rank", *[F.col(f"o.{f}").alias(f) for f in ("offer_id", "product_id", "slug", "price", "reference", "discount", "days")])


def _previous_drop() -> Column:
    return F.when(F.col("previous_price") > F.col("price"), F.col("previous_price"))


def day_window(rows: DataFrame, window: str | None) -> DataFrame:
    """today: days is 0, yesterday: 1, else all; null days match no narrowing window."""
    want = {"today": 0, "yesterday": 1}.get(window or "")
    return rows if want is None else rows.where(F.col("days") == want)


def min_discount(rows: DataFrame, least: int | None) -> DataFrame:
    """Rows with at least so many percent off; 0 and None ask for nothing."""
    return rows.where(F.coalesce("discount", F.lit(0)) >= least) if least else rows


def catalog(offers: DataFrame) -> DataFrame:
    """All offers grouped by product, each against its own previous price if that was higher."""
    return group_offers(_enriched(offers, _previous_drop()))


def _extremes(offers: DataFrame, snapshot: DataFrame | Star, window: str, days: DataFrame | None) -> DataFrame:
    """Extremes from the first day of the window before the newest day among these offers on; that day is a subquery, known before snapshots are read."""
    newest = (offers if days is None else days).agg(F.max("captured_on").alias("newest"))
    cutoff = newest.select(F.date_sub("newest", WINDOW_DAYS[window]).alias("cutoff")).scalar()
    return price_extremes(since_day(snapshot, cutoff) if isinstance(snapshot, Star) else snapshot, cutoff)


def drops(offers: DataFrame, snapshot: DataFrame | Star, as_of: str, *, window: str = "week", discount_window: str | None = None, least: int | None = None, days: DataFrame | None = None) -> DataFrame:
    """Offers below their highest price of the window, with the days since the price took hold, grouped by product.

    days: captured_on of these offers, where it is stored, so that the newest day needs no second look at them.
    Of a star that is stored by day, only the window's months are read for the highest price.
    """
    since = price_since(snapshot.snapshot if isinstance(snapshot, Star) else snapshot)
    rows = offers.join(_extremes(offers, snapshot, window, days), "offer_id", "left").join(since, "offer_id", "left")
    rows = _enriched(rows, F.when(F.col("max_price") > F.col("price"), F.col("max_price")), F.date_diff(F.lit(as_of).cast("date"), F.col("since")))
    return group_offers(min_discount(day_window(rows.where("discount is not null"), discount_window), least))


def lows(offers: DataFrame, snapshot: DataFrame | Star, *, window: str = "week", least: int | None = None, days: DataFrame | None = None) -> DataFrame:
    """Offers at their lowest price of the window that dropped against their previous price; each is a group of its own. days: as for drops."""
    rows = offers.join(_extremes(offers, snapshot, window, days), "offer_id").where(F.col("price") <= F.col("min_price") + 1e-9)
    rows = _enriched(rows, F.col("previous_price")).where("discount is not null")
    return group_offers(min_discount(rows, least), "offer_id")


def new_listings(offers: DataFrame, as_of: str, *, window: str | None = None) -> DataFrame:
    """Offers first seen within seven days, as_of counted, grouped by product."""
    today = F.lit(as_of).cast("date")
    rows = offers.where(F.col("first_seen") >= F.date_sub(today, NEW_DAYS - 1))
    return group_offers(day_window(_enriched(rows, F.lit(None).cast("double"), F.date_diff(today, F.col("first_seen"))), window))


def best(offers: DataFrame, *, min_price: float | None = None, max_price: float | None = None, least: int | None = None) -> DataFrame:
    """Products that two stores or more offer, where the cheapest is no less than half of the next.

    The winner is compared with the runner-up, the others with their own previous price. Price bounds hold
    for the winner alone, so they must not be among the filters of ``offers``.
    """
    order = W.partitionBy("product_id").orderBy("price", "store_name", "offer_id")
    rows = offers.withColumns({"place": F.row_number().over(order), "next_price": F.lead("price").over(order)})
    stores = offers.groupBy("product_id").agg(F.countDistinct("slug").alias("stores")).where(F.col("stores") >= BEST_STORES)
    winner = rows.where("place = 1").join(stores, "product_id", "left_semi").where(F.col("price") >= F.col("next_price") * BEST_GUARD)
    winner = winner.where(F.col("price") >= min_price) if min_price is not None else winner
    winner = winner.where(F.col("price") <= max_price) if max_price is not None else winner
    if least:
        winner = winner.where(F.coalesce(discount_percent(F.col("price"), F.col("next_price")), F.lit(0)) >= least)
    rows = rows.join(winner.select("product_id"), "product_id", "left_semi")
    return group_offers(_enriched(rows, F.when(F.col("place") == 1, F.col("next_price")).otherwise(_previous_drop())))


def ordered(groups: DataFrame, kind: str, sort: str | None = None, descending: bool = False) -> DataFrame:
    """A report's own order, or one field's: nulls last either way, text without case, ties by id."""
    if sort:
        if sort not in SORT_FIELDS:
            raise ValueError(f"no such sort field: {sort}")
        key = F.lower(sort) if groups.schema[sort].dataType.simpleString() == "string" else F.col(sort)
        return groups.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "group_id")
    natural = {"catalog": [F.lower("name").asc_nulls_last(), "price"], "new": ["days", "price"]}
    return groups.orderBy(*natural.get(kind, [F.coalesce("discount", F.lit(0)).desc()]), "group_id")


def page(groups: DataFrame, kind: str, *, number: int = 1, size: int = 50, sort: str | None = None, descending: bool = False) -> DataFrame:
    """One page of a report, from number 1; the number of groups is groups.count()."""
    if number < 1 or size not in PAGE_SIZES:
        raise ValueError(f"pages count from 1 and hold one of {PAGE_SIZES} groups")
    return ordered(groups, kind, sort, descending).offset((number - 1) * size).limit(size)


def paged(groups: DataFrame, kind: str, **asked) -> DataFrame:
    """A page as page() gives it, each row with total, the number of groups of all pages; a page beyond the last is one row with the total alone."""
    total = groups.agg(F.count("*").alias("total"))
    return total.join(page(groups, kind, **asked), F.lit(True), "left")
