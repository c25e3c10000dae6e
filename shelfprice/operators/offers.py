"""Offers and their prices over time: current state, previous price, window extremes, price-since, history, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.star import Star


def discount_percent(price: Column, reference: Column) -> Column:
    """By how many percent price is below reference, rounded half up; null without a positive, higher reference."""
    off = F.floor((reference - price) / reference * 100 + 0.5).cast("int")
    return F.when((reference > 0) & (price < reference), off)


def latest_prices(snapshot: DataFrame) -> DataFrame:
    """offer_id, price, previous_price, promo, captured_on: the newest snapshot of each offer and the price before it.

    The limit on the row number is applied in each task before the shuffle, so each sends two rows an offer
    at most; the aggregate then finds them together.
    """
    newest = W.partitionBy("offer_id").orderBy(F.desc("captured_on"))
    two = snapshot.select("offer_id", "captured_on", "price", "promo").withColumn("rn", F.row_number().over(newest)).where("rn <= 2")
    return (
        two.groupBy("offer_id").agg(F.max(F.when(F.col("rn") == 1, F.struct("captured_on", "price", "promo"))).alias("n"), F.max(F.when(F.col("rn") == 2, F.col("price"))).alias("previous_price"))
        .select("offer_id", "n.price", "previous_price", "n.promo", "n.captured_on")
    )


def flavors_by_product(star: Star) -> DataFrame:
    """product_id and its flavors, sorted."""
    return star.product_flavor.groupBy("product_id").agg(F.array_sort(F.collect_set("flavor")).alias("flavors"))


def current_offers(star: Star) -> DataFrame:
    """One row an offer: its newest price and the one before, with store, product, type, country and flavors.

    Flavors are an array, empty where there are none. Stores, countries and products are dimensions that
    the optimizer broadcasts if they are small.
    """
    return (
        latest_prices(star.snapshot)
        .join(star.offer, "offer_id")
        .join(star.product, "product_id")
        .join(star.store, "store_id")
        .join(star.country, "country_id", "left")
        .join(flavors_by_product(star), "product_id", "left")
        .withColumn("flavors", F.coalesce("flavors", F.array().cast("array<string>")))
        .select(
            "offer_id", "product_id", "store_id", "slug", "store_name", "name", "brand", "type", F.col("code").alias("country"), "age", "volume_ml", "flavors",
            "price", "previous_price", "promo", "captured_on", "first_seen", "last_seen", "in_stock",
        )
    )


def latest_date(snapshot: DataFrame) -> DataFrame:
    """The newest day with data, one row."""
    return snapshot.agg(F.max("captured_on").alias("latest_date"))


def price_extremes(snapshot: DataFrame, cutoff: Column) -> DataFrame:
    """offer_id with the least and greatest price from cutoff (inclusive) on."""
    return snapshot.where(F.col("captured_on") >= cutoff).groupBy("offer_id").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def price_since(snapshot: DataFrame) -> DataFrame:
    """offer_id, since: the first day after the last one on which the price was higher than it is now, else the first day of all.

    From the newest day back, these are the days up to which no price was above the newest: one shuffle by offer.
    """
    back = W.partitionBy("offer_id").orderBy(F.desc("captured_on")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = snapshot.select("offer_id", "captured_on", F.max("price").over(back).alias("top"), F.first("price").over(back).alias("now"))
    return rows.where("top <= now").groupBy("offer_id").agg(F.min("captured_on").alias("since"))


def price_history(snapshot: DataFrame, limit: int = 60) -> DataFrame:
    """The newest ``limit`` prices of each offer (the feature's limit), numbered from the oldest of them."""
    w = W.partitionBy("offer_id")
    tail = snapshot.withColumn("back", F.row_number().over(w.orderBy(F.desc("captured_on")))).where(F.col("back") <= limit)
    return tail.withColumn("point", F.row_number().over(w.orderBy("captured_on"))).select("offer_id", "point", "captured_on", "price")


def resolve_offer(offer: DataFrame, wanted: str) -> DataFrame:
    """The offer that an id stands for: the offer of that id, else the best offer of the product of that id."""
    mine = offer.where(F.col("offer_id") == wanted).withColumn("rank", F.lit(0))
    product = offer.where(F.col("product_id").cast("string") == wanted).withColumn("rank", F.lit(1))
    order = ["rank", F.desc("in_stock"), F.desc("last_seen"), "offer_id"]
    return mine.unionByName(product).orderBy(*order).limit(1).select("offer_id", "product_id", "store_id")


def named(rows: DataFrame, term: str) -> DataFrame:
    """Rows whose name holds the term in any case."""
    return rows.where(F.col("name").ilike(f"%{term}%"))


def _best(offers: DataFrame, term: str) -> DataFrame:
    return named(offers, term).orderBy(F.desc("in_stock"), F.desc("last_seen"), "offer_id").limit(1)


def resolve_term(offers: DataFrame, term: str) -> DataFrame:
    """The best current offer whose name holds the term in any case: in stock first, then the one seen last."""
    return _best(offers, term).select("offer_id", "name", "in_stock", "last_seen")


def term_history(star: Star, term: str, limit: int = 60) -> DataFrame:
    """The price history of the offer that a term stands for.

    Which offer that is follows from offers, products and stores, without their prices. It is a subquery, known
    before snapshots are read, so that its product and id reach the scan.
    """
    offers = star.offer.join(star.product, "product_id").join(star.store, "store_id", "left_semi")
    one = _best(offers, term).select(F.struct("product_id", "offer_id")).scalar()
    return price_history(star.snapshot.where((F.col("product_id") == one["product_id"]) & (F.col("offer_id") == one["offer_id"])), limit)
