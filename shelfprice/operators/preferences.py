"""User preferences as sets: favorites and blacklists, added to and taken from without effect when repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["user_id", "target_id"]


def add(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored links and those of incoming that are not there yet."""
    return stored.unionByName(incoming.dropDuplicates(_KEY).join(stored, _KEY, "left_anti"))


def remove(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select(*_KEY).distinct(), _KEY, "left_anti")


def blacklist_products(favorites: DataFrame, blacklist: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Favorites and product blacklist after blacklisting: what is blacklisted is no favorite any more."""
    return remove(favorites, incoming), add(blacklist, incoming)


def bundle(users: DataFrame, favorites: DataFrame, products: DataFrame, brands: DataFrame) -> DataFrame:
    """Each user with three arrays, never null, newest first."""
    out = users.select("user_id").distinct()
    for name, table in (("favorites", favorites), ("blacklist_products", products), ("blacklist_brands", brands)):
        listed = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "target_id")))), lambda x: x["target_id"])
        out = out.join(table.groupBy("user_id").agg(listed.alias(name)), "user_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
