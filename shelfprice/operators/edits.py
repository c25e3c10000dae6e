"""Edits of bottlings by hand, checked against the lookup tables inside the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that an edit may set as they are; country, type and flavors are looked up.
PLAIN = ("name", "age", "abv", "volume_ml")


def _unknown(what: str, value: Column, kind) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value.cast("string"), F.lit("")))).cast(kind)


def resolved(edits: DataFrame, offer: DataFrame, product: DataFrame) -> DataFrame:
    """Edits with the product_id that their id stands for: an offer's id its product, else a product's own; one join for both. An id of neither is an error when the outcome is read."""
    ids = offer.select(F.col("offer_id").cast("string").alias("id"), F.lit(0).alias("rank"), "product_id").unionByName(
        product.select(F.col("product_id").cast("string").alias("id"), F.lit(1).alias("rank"), "product_id")
    )
    ids = ids.join(edits.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("product_id", "rank").alias("product_id"))
    found = edits.join(ids, "id", "left")
    return found.withColumn("product_id", F.when(F.col("product_id").isNotNull(), F.col("product_id")).otherwise(_unknown("product", F.col("id"), product.schema["product_id"].dataType)))


def edit_products(product: DataFrame, offer: DataFrame, links: DataFrame, country: DataFrame, types: DataFrame, flavors: DataFrame, edits: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Products and flavor links after edits: id, given (names of the fields that it sets), name, age, abv, volume_ml, country, type, flavors, seq.

    Only given fields change, a null one is cleared. country is a code, type and flavors are names of the
    lookup tables country (country_id, code), types (type) and flavors (flavor); what those lack is an
    error when the outcome is read, never a new entry; empty text clears a country or type. Given flavors
    replace all links of the product, as manual ones, and set curated_at: an empty list means no flavors.
    Of several edits of a product the last by seq counts for each field. Other products stay.
    """
    found = resolved(edits, offer, product)
    last = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains("given", c), F.col("seq"))).alias(f"e_{c}")
    one = found.groupBy("product_id").agg(*[last(c) for c in (*PLAIN, "country", "type", "flavors")])
    codes = country.select(F.col("code").alias("__code"), F.col("country_id").alias("__country"))
    kinds = types.where("type is not null").select(F.col("type").alias("__kind")).distinct()
    rows = product.join(one, "product_id", "left").join(codes, F.col("e_country.v") == F.col("__code"), "left").join(kinds, F.col("e_type.v") == F.col("__kind"), "left")
    given = lambda c: F.col(f"e_{c}").isNotNull()
    new = {c: F.when(given(c), F.col(f"e_{c}.v")).otherwise(F.col(c)) for c in PLAIN if c in product.columns}

    def looked_up(field: str, asked: str, hit: str) -> Column:
        value, kind = F.col(f"e_{asked}.v"), product.schema[field].dataType
        cleared = F.coalesce(value, F.lit("")) == ""
        return F.when(~given(asked), F.col(field)).when(cleared, F.lit(None).cast(kind)).when(F.col(hit).isNull(), _unknown(asked, value, kind)).otherwise(F.col(hit))

    new |= {"country_id": looked_up("country_id", "country", "__country"), "type": looked_up("type", "type", "__kind"), "curated_at": F.when(given("flavors"), at).otherwise(F.col("curated_at"))}
    edited = rows.select(*[new.get(c, F.col(c)).alias(c) for c in product.columns])

    wanted = one.where("e_flavors is not null").select("product_id", F.coalesce("e_flavors.v", F.array().cast("array<string>")).alias("flavors"))
    known = flavors.select("flavor", F.lit(True).alias("__known")).distinct()
    chosen = wanted.select("product_id", F.explode(F.array_distinct(F.transform("flavors", lambda f: F.trim(f)))).alias("flavor")).join(known, "flavor", "left")
    chosen = chosen.select("product_id", F.when(F.col("__known"), F.col("flavor")).otherwise(_unknown("flavor", F.col("flavor"), "string")).alias("flavor"), F.lit("manual").alias("source"))
    return edited, links.join(wanted.select("product_id"), "product_id", "left_anti").unionByName(chosen)


def link_actions(stored: DataFrame, wanted: DataFrame, key: list[str], by: str) -> DataFrame:
    """What turns stored links into the wanted ones, one row for each value of by: actions, a sorted array of (action, rest of the key); values that need none are left out."""
    rest = [c for c in key if c != by]
    old, new = stored.select(*key).distinct().withColumn("__old", F.lit(True)), wanted.select(*key).distinct().withColumn("__new", F.lit(True))
    both = old.join(new, key, "full_outer").where("__old is null or __new is null")
    action = F.struct(F.when(F.col("__old").isNull(), "add").otherwise("remove").alias("action"), *rest)
    return both.groupBy(by).agg(F.array_sort(F.collect_list(action)).alias("actions"))
