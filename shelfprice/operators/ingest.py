"""Writes as pure functions, (stored, incoming) to the table to store: applying a batch twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.star import last_write_wins

#: Fixed value: a run that leaves less than this share of a store's listings in stock is worth an alert.
BASELINE_SHARE = 0.5


def upsert_snapshots(stored: DataFrame, incoming: DataFrame, order: str = "written_at") -> DataFrame:
    """One row for each (offer_id, captured_on): the one written last; incoming wins ties. An aggregate, so rows combine before the shuffle.

    created_at, where the table has it, stays that of the first write.
    """
    both = stored.withColumn("__at", F.struct(order, F.lit(0))).unionByName(incoming.withColumn("__at", F.struct(order, F.lit(1))))
    key = ["offer_id", "captured_on"]
    rest = [c for c in stored.columns if c not in key]
    first = [F.min_by("created_at", F.struct(~F.col("__stored"), "__at")).alias("__created")] if "created_at" in rest else []
    newest = both.withColumn("__stored", F.col("__at")["col2"] == 0).groupBy(*key).agg(F.max_by(F.struct(*rest), "__at").alias("__last"), *first)
    return newest.select(*[F.col("__created").alias(c) if first and c == "created_at" else F.col(c) if c in key else F.col(f"__last.{c}").alias(c) for c in stored.columns])


def stock_alerts(before: DataFrame, after: DataFrame) -> DataFrame:
    """store_id, was, left of the stores that a sweep leaves with less than BASELINE_SHARE of their listings in stock."""
    count = lambda df, name: df.where("in_stock").groupBy("store_id").agg(F.count("*").alias(name))
    both = count(before, "was").join(count(after, "left"), "store_id", "left").withColumn("left", F.coalesce("left", F.lit(0)))
    return both.where(F.col("left") < F.col("was") * BASELINE_SHARE)


def run_outcomes(results: DataFrame) -> DataFrame:
    """Counters and outcome of each run: store_id, added, removed, updated, total, success, error.

    results: store_id, added, removed, stored, found, stated, stop, complete. An incomplete listing is a
    failed run whose counters stay; its error says what stopped it and how much was collected.
    """
    stated = F.coalesce(F.col("stated").cast("string"), F.lit("an unknown number of"))
    error = F.format_string("listing not complete (%s): %d of %s items; stock was not swept", "stop", "found", stated)
    return results.select(
        "store_id", "added", "removed", (F.col("stored") - F.col("added")).alias("updated"), F.col("found").alias("total"), F.col("complete").alias("success"), F.when(~F.col("complete"), error).alias("error")
    )


def upsert_offers(stored: DataFrame, seen: DataFrame, day: Column) -> DataFrame:
    """On (store_id, sku): url, raw name, stock and last_seen follow what was seen; first_seen and product_id never change.

    seen: store_id, sku, product_id, url, name_orig, in_stock; its first row for a key by url counts.
    """
    key = ["store_id", "sku"]
    fields = ["url", "name_orig", "in_stock", "product_id"]
    one = seen.groupBy(*key).agg(F.min(F.struct(*fields)).alias("n"))
    joined = stored.join(one, key, "full_outer")
    there, new = F.col("first_seen").isNotNull(), F.col("n").isNotNull()
    now = {f: F.when(new, F.col(f"n.{f}")).otherwise(F.col(f)) for f in fields[:3]}
    return joined.select(
        *key, F.when(there, F.col("product_id")).otherwise(F.col("n.product_id")).alias("product_id"), *[c.alias(f) for f, c in now.items()],
        F.when(there, F.col("first_seen")).otherwise(day).alias("first_seen"), F.when(new, day).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def touch_offers(stored: DataFrame, seen: DataFrame, day: Column) -> DataFrame:
    """Known offers only: seen ones take the listing's url and raw name, are in stock and last seen on the day; their product stays.

    seen: store_id, sku, url, name_orig; its first row for a key by url counts. What is not stored adds nothing.
    """
    key, fields = ["store_id", "sku"], ["url", "name_orig"]
    one = seen.groupBy(*key).agg(F.min(F.struct(*fields)).alias("__n"))
    hit = F.col("__n").isNotNull()
    now = {f: F.when(hit, F.col(f"__n.{f}")).otherwise(F.col(f)) for f in fields} | {"in_stock": F.when(hit, True).otherwise(F.col("in_stock")), "last_seen": F.when(hit, day).otherwise(F.col("last_seen"))}
    return stored.join(one, key, "left").select(*[now.get(c, F.col(c)).alias(c) for c in stored.columns])


def find_or_create(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """product_id and is_new of each match_key; new ids are digests of the key, keyless rows get one of their own by sku."""
    named = wanted.where("match_key is not null").select("match_key").distinct()
    known = named.join(stored.select("match_key", "product_id"), "match_key", "left")
    return known.select("match_key", F.coalesce("product_id", F.md5("match_key")).alias("product_id"), F.col("product_id").isNull().alias("is_new"))


def unmatched(wanted: DataFrame) -> DataFrame:
    """Rows without a key: each is a product of its own, by store and sku."""
    return wanted.where("match_key is null").select("store_id", "sku", F.md5(F.concat_ws("/", F.lit("sku"), "store_id", "sku")).alias("product_id"), F.lit(True).alias("is_new"))


def fill_missing(stored: DataFrame, incoming: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Stored values stay; where null, the first contributor's (by order) values come in. Other rows are as they were."""
    first = incoming.groupBy("product_id").agg(F.min_by(F.struct(*fields), order).alias("n"))
    joined = stored.join(first, "product_id", "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"n.{c}")).alias(c) if c in fields else F.col(c) for c in stored.columns])


def add_keyword_flavors(stored: DataFrame, incoming: DataFrame, curated: DataFrame) -> DataFrame:
    """New (product_id, flavor) links with source scrape; links that are there keep theirs, curated products gain none."""
    key = ["product_id", "flavor"]
    fresh = incoming.select(*key).distinct().join(stored, key, "left_anti").join(curated.select("product_id"), "product_id", "left_anti")
    return stored.unionByName(fresh.withColumn("source", F.lit("scrape")))


def replace_llm_flavors(stored: DataFrame, answers: DataFrame, curated: DataFrame) -> DataFrame:
    """Classified products lose their old llm links and gain the new ones, scrape links that are named again become llm ones."""
    key = ["product_id", "flavor"]
    free = answers.join(curated.select("product_id"), "product_id", "left_anti")
    asked = free.select("product_id").distinct()
    named = free.where("flavor is not null").select(*key).distinct()
    kept = stored.join(asked.withColumn("__asked", F.lit(True)), "product_id", "left").where(F.col("__asked").isNull() | (F.col("source") != "llm")).drop("__asked")
    rest = kept.join(named, key, "left_anti").unionByName(kept.join(named, key, "left_semi").where("source = 'manual'"))
    return rest.unionByName(named.join(rest, key, "left_anti").withColumn("source", F.lit("llm")))


def replace_manual_flavors(stored: DataFrame, wanted: DataFrame, products: DataFrame) -> DataFrame:
    """The products' links are what is wanted, by hand, and nothing else."""
    return stored.join(products.select("product_id"), "product_id", "left_anti").unionByName(wanted.select("product_id", "flavor").distinct().withColumn("source", F.lit("manual")))


def stamped(products: DataFrame, done: DataFrame, column: str, at: Column) -> DataFrame:
    """Products with the stamp set for those of done (product_id): classified_at after a model's answer, also for curated ones, so that it is not asked again; curated_at after a choice by hand."""
    hit = done.select("product_id").distinct().withColumn("__hit", F.lit(True))
    return products.join(hit, "product_id", "left").select(*[F.when(F.col("__hit"), at).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in products.columns])


def listing_verdict(listings: DataFrame) -> DataFrame:
    """verdict: incomplete unless it stopped exhausted; exhausted without a stated count; short below it; else counted."""
    verdict = (
        F.when(F.col("stop") != "exhausted", "incomplete").when(F.col("stated").isNull(), "exhausted").when(F.col("received") < F.col("stated"), "short").otherwise("counted")
    )
    return listings.withColumn("verdict", verdict)


def first_in_listing(items: DataFrame) -> DataFrame:
    """Of items with one sku the first by (page, position)."""
    rest = [c for c in items.columns if c not in ("store_id", "sku")]
    return items.groupBy("store_id", "sku").agg(F.min_by(F.struct(*rest), F.struct("page", "position")).alias("f")).select("store_id", "sku", *[F.col(f"f.{c}").alias(c) for c in rest])


def sweep(offers: DataFrame, seen: DataFrame, gone: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Offers out of stock after a run: of complete listings all that were not seen, of others those said to be gone.

    verdicts: store_id, complete. Offers of stores without a verdict stay as they are.
    """
    key = ["store_id", "sku"]
    rows = offers.join(verdicts.select("store_id", "complete"), "store_id", "left")
    rows = rows.join(seen.select(*key).distinct().withColumn("__seen", F.lit(True)), key, "left").join(gone.select(*key).distinct().withColumn("__gone", F.lit(True)), key, "left")
    out = (F.col("complete") & F.col("__seen").isNull()) | (F.col("complete").isNotNull() & F.col("__gone").isNotNull())
    return rows.withColumn("in_stock", F.when(F.coalesce(out, F.lit(False)), False).otherwise(F.col("in_stock"))).select(*offers.columns)


def needs_enrichment(products: DataFrame) -> DataFrame:
    """Products that lack abv, volume, type or country, or were never classified and not curated."""
    lacking = F.lit(False)
    for c in ("abv", "volume_ml", "type", "country_id"):
        lacking = lacking | F.col(c).isNull()
    return products.where(lacking | (F.col("classified_at").isNull() & F.col("curated_at").isNull()))


def diff_snapshots(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Two captures by sku: how many are shared or only on one side, and for each field how many shared rows differ."""
    a = left.select("sku", F.struct(*fields).alias("l"))
    b = right.select("sku", F.struct(*fields).alias("r"))
    both = a.join(b, "sku", "full_outer")
    shared = F.col("l").isNotNull() & F.col("r").isNotNull()
    counts = [F.count_if(shared).alias("shared"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right")]
    counts += [F.count_if(shared & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))).alias(f"differ_{f}") for f in fields]
    return both.agg(*counts)


def null_census(table: DataFrame, fields: list[str], *by: str) -> DataFrame:
    """Rows, and how many are null in each field, for each value of by."""
    return table.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in fields])


def vote_spelling(names: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """For each key the spelling most rows have; ties go to the longer, then to the lower."""
    counts = names.groupBy(key, name).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max("n").alias("n"))
    top = counts.join(best, [key, "n"]).withColumn("size", F.length(name))
    longest = top.groupBy(key).agg(F.max("size").alias("size"))
    return top.join(longest, [key, "size"]).groupBy(key).agg(F.min(name).alias(name), F.first("n").alias("votes"))
