"""Corrections of the catalogue by hand, for many bottlings at once: merge, split, move, re-key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import kept

#: What a survivor takes from those merged into it where it has nothing itself. Age and volume are part of its key and stay.
FILLED = ("name", "abv", "brand", "type", "country_id")


@dataclass(frozen=True)
class Catalogue:
    """product (product_id, match_key, the filled fields, classified_at, ...), offer (offer_id, product_id, ...), links (product_id, flavor, source)."""

    product: DataFrame
    offer: DataFrame
    links: DataFrame


def merge_roots(merges: DataFrame) -> DataFrame:
    """(from_id, into_id) to from_id, root and steps: where each chain of merges ends, and how far away that is.

    By pointer jumping: in a round each pointer goes where its end points, so chains halve and their number
    of rounds is the logarithm of the longest. Repeated pairs count once. A product that goes into two, or a
    chain that comes back to itself, is an error. A round is written before the next begins.
    """
    pairs = merges.select("from_id", "into_id").distinct()
    now = kept(pairs.select("from_id", F.col("into_id").alias("root"), F.lit(1).cast("long").alias("steps")), "merge-roots")
    size = now.agg(F.count("*").alias("rows"), F.countDistinct("from_id").alias("ids")).first()
    if size["rows"] != size["ids"]:
        raise ValueError(f"{size['rows'] - size['ids']} merges send one product into several")
    left = size["rows"] + 1
    while True:
        on = now.select(F.col("from_id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        open_ = now.join(on.select("root"), "root", "left_semi").count()
        if not open_:
            return now
        if open_ >= left:
            # Of a chain without a circle, a round brings at least one product to the end.
            raise ValueError(f"{open_} merges go in a circle or lead into one")
        left = open_
        now = kept(now.join(on, "root", "left").select("from_id", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "merge-roots")


def merge(catalogue: Catalogue, merges: DataFrame) -> Catalogue:
    """The catalogue after merges (from_id, into_id), chains of any length included.

    A survivor's null fields are filled from what was merged into it, nearest first, then by id; its
    classification is the latest of all. Its flavors are those of all; where several have one, the source is
    that of the first in that order, but scrape gives way to llm. Offers follow, with their history. What
    was merged is gone. A survivor that the catalogue lacks is an error; merges of unknown products do
    nothing. Merging the outcome again changes nothing.
    """
    known = merges.join(catalogue.product.select(F.col("product_id").alias("from_id")), "from_id", "left_semi")
    roots = merge_roots(known)
    lost = roots.select(F.col("root").alias("product_id")).distinct().join(catalogue.product, "product_id", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} products to merge into are not there")
    order = F.struct("__steps", "product_id")

    def led(rows: DataFrame) -> DataFrame:
        """Rows with the product that theirs became, and how far it was away."""
        to = roots.select(F.col("from_id").alias("product_id"), F.col("root").alias("__root"), F.col("steps").alias("__steps"))
        return rows.join(to, "product_id", "left").withColumns({"__root": F.coalesce("__root", "product_id"), "__steps": F.coalesce("__steps", F.lit(0).cast("long"))})

    fields = [c for c in FILLED if c in catalogue.product.columns]
    folded = led(catalogue.product).groupBy("__root").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"__{c}") for c in fields], F.max("classified_at").alias("__classified_at")
    )
    instead = {c: F.col(f"__{c}") for c in (*fields, "classified_at")}
    product = catalogue.product.join(roots.select(F.col("from_id").alias("product_id")), "product_id", "left_anti").join(folded, F.col("product_id") == F.col("__root"))
    product = product.select(*[instead.get(c, F.col(c)).alias(c) for c in catalogue.product.columns])

    first = F.min_by("source", order)
    source = F.when((first == "scrape") & F.bool_or(F.col("source") == "llm"), "llm").otherwise(first)
    links = led(catalogue.links).groupBy(F.col("__root"), "flavor").agg(source.alias("source")).select(F.col("__root").alias("product_id"), "flavor", "source")
    offer = led(catalogue.offer).withColumn("product_id", F.col("__root")).select(*catalogue.offer.columns)
    return Catalogue(product, offer, links)


def split(catalogue: Catalogue, splits: DataFrame, moves: DataFrame) -> Catalogue:
    """The catalogue with bottlings taken out of others: splits (from_id, new_id, name, abv), moves (offer_id, new_id).

    A new bottling has the fields of the one it came from but for the name and strength given, no key, so
    that nothing is matched to it by itself, and was never classified. It has the other's flavors, and the
    offers moved to it. An offer that is moved from another bottling, a new id that is there already, or a
    bottling to split that is not, is an error when the outcome is read.
    """
    came = splits.select(F.col("from_id").alias("product_id"), F.col("new_id").alias("__new"), F.col("name").alias("__name"), F.col("abv").alias("__abv"))
    taken = catalogue.product.select(F.col("product_id").alias("__new"), F.lit(True).alias("__taken"))
    there = catalogue.product.withColumn("__there", F.lit(True))
    new = came.join(there, "product_id", "left").join(taken, "__new", "left")
    wrong = F.when(F.col("__there").isNull(), F.raise_error(F.format_string("no bottling to split: %s", F.col("product_id").cast("string"))))
    wrong = wrong.when(F.col("__taken"), F.raise_error(F.format_string("there is a bottling of that id already: %s", F.col("__new").cast("string"))))
    changed = {"product_id": wrong.otherwise(F.col("__new")), "name": F.coalesce("__name", "name"), "abv": F.coalesce("__abv", "abv")}
    never = {c: F.lit(None).cast(catalogue.product.schema[c].dataType) for c in ("match_key", "classified_at") if c in catalogue.product.columns}
    product = catalogue.product.unionByName(new.select(*[(changed | never).get(c, F.col(c)).alias(c) for c in catalogue.product.columns]))

    copies = catalogue.links.join(came.select("product_id", "__new"), "product_id").select(F.col("__new").alias("product_id"), "flavor", "source")
    links = catalogue.links.unionByName(copies.join(catalogue.links, ["product_id", "flavor"], "left_anti"))

    to = moves.select("offer_id", F.col("new_id").alias("__new")).join(splits.select(F.col("new_id").alias("__new"), F.col("from_id").alias("__from")), "__new", "left")
    offer = catalogue.offer.join(to, "offer_id", "left")
    other = F.when(~F.col("product_id").eqNullSafe(F.col("__from")), F.raise_error(F.format_string("offer %s is not of the bottling that is split", F.col("offer_id").cast("string"))))
    moved = F.when(F.col("__new").isNotNull(), other.otherwise(F.col("__new"))).otherwise(F.col("product_id"))
    offer = offer.select(*[moved.alias(c) if c == "product_id" else F.col(c) for c in catalogue.offer.columns])
    return Catalogue(product, offer, links)


def move_offers(offer: DataFrame, product: DataFrame, moves: DataFrame) -> DataFrame:
    """Offers with those of moves (offer_id, product_id) linked to another bottling; their history hangs off the offer and stays. An unknown bottling is an error when the outcome is read."""
    there = product.select(F.col("product_id").alias("__to"), F.lit(True).alias("__there"))
    to = moves.select("offer_id", F.col("product_id").alias("__to")).join(there, "__to", "left")
    known = F.when(F.col("__there"), F.col("__to")).otherwise(F.raise_error(F.format_string("no bottling %s", F.col("__to").cast("string"))).cast(offer.schema["product_id"].dataType))
    rows = offer.join(to, "offer_id", "left").withColumn("__now", F.when(F.col("__to").isNotNull(), known).otherwise(F.col("product_id")))
    return rows.select(*[F.col("__now").alias(c) if c == "product_id" else F.col(c) for c in offer.columns])


def rekey(product: DataFrame, keys: DataFrame) -> DataFrame:
    """Products with new match keys (product_id, match_key; null: none). A key that two bottlings would then have is an error when the outcome is read: those are to be merged."""
    new = keys.select("product_id", F.col("match_key").alias("__key"), F.lit(True).alias("__new"))
    rows = product.join(new, "product_id", "left").withColumn("match_key", F.when(F.col("__new"), F.col("__key")).otherwise(F.col("match_key"))).drop("__key", "__new")
    # One row a key: what is counted is aggregated before it is joined, and keyless rows meet nothing.
    twice = rows.where("match_key is not null").groupBy("match_key").agg(F.count("*").alias("__n")).where("__n > 1")
    checked = F.when(F.col("__n").isNull(), F.col("match_key")).otherwise(F.raise_error(F.concat(F.lit("two bottlings would have the key "), F.col("match_key"))))
    return rows.join(twice, "match_key", "left").select(*[checked.alias(c) if c == "match_key" else F.col(c) for c in product.columns])
