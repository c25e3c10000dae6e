"""Which scraped items a run asks detail pages and the model about, whom of equal bottlings it asks, and who gets the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields without which a stored product is incomplete.
WANTED = ("abv", "volume_ml", "type", "country_id")
ASKS = ("ask_detail", "ask_fields", "ask_name", "ask_flavors")


def _lacks(fields: tuple, *sides: str) -> Column:
    """Of any field no side has a value."""
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(*[F.col(f"{side}{f}") for side in sides]).isNull()
    return out


def enrichment_plan(items: DataFrame, offers: DataFrame, products: DataFrame, *, backfill: bool = False) -> DataFrame:
    """The items in stock that are asked about: store_id, sku, match_key, place, known, ask_detail, ask_fields, ask_name, ask_flavors, head_store_id, head_sku.

    items: store_id, sku, match_key, in_stock, place (the order of the listing) and abv, volume_ml, type,
    country_id as scraped; offers: store_id, sku; products: match_key, those fields as stored, classified_at,
    curated_at. A SKU that the store has stored is known and asked about only by a backfill run.

    * detail: what is stored under the key lacks strength, volume, type or country, or was never classified
      nor curated; or nothing is stored.
    * fields: neither the item nor what is stored has strength and volume; a backfill asks for type and country too.
    * name: a SKU not known whose key stores nothing.
    * flavors: never classified and not curated. One item of a key, the first of the listing, is the head
      that is asked; items without a key are heads of their own. Others have no head.

    Items of a run that is no backfill lose the known SKUs by an anti-join before anything else is joined.
    """
    known = offers.select("store_id", "sku").distinct()
    rows = items.where("in_stock")
    if backfill:
        rows = rows.join(known.withColumn("known", F.lit(True)), ["store_id", "sku"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    else:
        rows = rows.join(known, ["store_id", "sku"], "left_anti").withColumn("known", F.lit(False))
    stored = products.where("match_key is not null").select("match_key", F.lit(True).alias("s_there"), *[F.col(c).alias(f"s_{c}") for c in (*WANTED, "classified_at", "curated_at")])
    rows = rows.join(stored, "match_key", "left")
    open_ = F.col("s_classified_at").isNull() & F.col("s_curated_at").isNull()
    rows = rows.withColumns({
        "ask_detail": _lacks(WANTED, "s_") | open_,
        "ask_fields": _lacks(WANTED if backfill else WANTED[:2], "", "s_"),
        "ask_name": ~F.col("known") & F.col("s_there").isNull(),
        "ask_flavors": open_,
    }).where(" or ".join(ASKS))
    # One row a key, aggregated before the join: a key that very many items have can be split.
    first = rows.where("ask_flavors and match_key is not null").groupBy("match_key").agg(F.min(F.struct("place", "store_id", "sku")).alias("head"))
    rows = rows.join(first, "match_key", "left")
    head = lambda c: F.when(F.col("ask_flavors"), F.coalesce(F.col(f"head.{c}"), F.col(c))).alias(f"head_{c}")
    return rows.select("store_id", "sku", "match_key", "place", "known", *ASKS, head("store_id"), head("sku"))


def heads(plan: DataFrame) -> DataFrame:
    """Of a plan the items whose flavors the model is asked for: one a key."""
    return plan.where("ask_flavors and store_id = head_store_id and sku = head_sku")


def fan_out(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """The plan's items asked for flavors with the answer that their head got (answers: store_id, sku and whatever the model said); null where it got none."""
    said = [c for c in answers.columns if c not in ("store_id", "sku")]
    to = answers.select(F.col("store_id").alias("head_store_id"), F.col("sku").alias("head_sku"), *said)
    return plan.where("ask_flavors").join(to, ["head_store_id", "head_sku"], "left").select("store_id", "sku", "match_key", *said)


def fill_census(stored: DataFrame, incoming: DataFrame, fields: list[str], *by: str, key: tuple = ("store_id", "sku"), order: str = "place") -> DataFrame:
    """For each value of by and each field: rows, how many are null, and how many of those the incoming items have a value for.

    Of several items of one key the last by order counts. Fields become rows, so that all are counted in one pass.
    """
    last = incoming.groupBy(*key).agg(F.max_by(F.struct(*fields), order).alias("__new"))
    rows = stored.join(last, list(key), "left")
    parts = [x for f in fields for x in (F.lit(f), F.col(f).isNull(), F.col(f).isNull() & F.col(f"__new.{f}").isNotNull())]
    long = rows.select(*by, F.stack(F.lit(len(fields)), *parts).alias("field", "missing", "fillable"))
    return long.groupBy(*by, "field").agg(F.count("*").alias("n"), F.count_if("missing").alias("nulls"), F.count_if("fillable").alias("fillable"))
