"""Ingest runs: activity per day, last success, running and recent runs, store lists. success null: still running."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def activity(runs: DataFrame, first: str, last: str) -> DataFrame:
    """Per day of created_at, last included: runs by outcome, sums of counters, mean and longest duration in ms of ended runs."""
    day = F.col("created_at").cast("date")
    rows = runs.where((F.col("created_at") >= F.lit(first).cast("timestamp_ntz")) & (F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))
    ms = F.col("seconds") * 1000
    return rows.groupBy(day.alias("day")).agg(
        F.count("*").alias("runs"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count_if(F.col("success").isNull()).alias("running"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("added", "removed", "updated")],
        F.floor(F.round(F.avg(ms), 4) + 0.5).cast("long").alias("avg_ms"), F.floor(F.max(ms) + 0.5).cast("long").alias("max_ms"),
    )


def last_success(runs: DataFrame) -> DataFrame:
    """store_id and when its last successful run began."""
    return runs.where("success").groupBy("store_id").agg(F.max("created_at").alias("last_success"))


def running(runs: DataFrame) -> DataFrame:
    return runs.where("success is null").select("run_id", "store_id", "created_at")


def recent(runs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest runs of each store, as many as the list shows."""
    w = W.partitionBy("store_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("store_id", "place", "run_id", "created_at", "success")


def set_active(store: DataFrame, slug: str, active: bool) -> DataFrame:
    """The stores with one switched on or off; others stay."""
    return store.withColumn("active", F.when(F.col("slug") == slug, F.lit(active)).otherwise(F.col("active")))


def meta(store: DataFrame, country: DataFrame, product: DataFrame, offer: DataFrame, product_flavor: DataFrame) -> DataFrame:
    """What filters can offer, one row a value: kind (store, type, flavor, country in stock, any country), key and label."""
    sold = product.join(offer.where("in_stock"), "product_id", "left_semi")
    kind = lambda df, name, key, label: df.select(F.lit(name).alias("kind"), F.col(key).cast("string").alias("key"), F.col(label).alias("label")).where("key is not null").distinct()
    return (
        kind(store, "store", "slug", "store_name").unionByName(kind(product, "type", "type", "type")).unionByName(kind(product_flavor, "flavor", "flavor", "flavor"))
        .unionByName(kind(country.join(sold, "country_id", "left_semi"), "country", "code", "country_name")).unionByName(kind(country, "any_country", "code", "country_name"))
    )


def store_list(store: DataFrame, offer: DataFrame, runs: DataFrame) -> DataFrame:
    """Each store with its listings in stock and its last successful run."""
    stock = offer.where("in_stock").groupBy("store_id").agg(F.count("*").alias("in_stock"))
    return store.join(stock, "store_id", "left").join(last_success(runs), "store_id", "left").select("slug", "store_name", F.coalesce("in_stock", F.lit(0)).alias("in_stock"), "last_success")
