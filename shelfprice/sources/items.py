"""Landed listings as rows: JSON items of several shapes, paged walks, tag lists and price rules, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text
from ..functions.vocab import FLAVOR_KEYWORDS
from ..operators.curation import brand_facts, brand_from_name, brand_index

ITEM = (
    "ean string, sku string, title string, price double, discount struct<status: boolean, old_price: double, value: double>, volume double, "
    "producer struct<trademark: string, name: string>, country string, web_url string, in_stock boolean"
)
PLACEHOLDER_PRICE = 1


def json_items(landed: DataFrame, column: str = "body") -> DataFrame:
    """Items with prices in hundredths: the bar code before the sku, an old price only under a discount, stock true unless said.

    Malformed JSON gives an item of nulls, which is dropped for want of a sku, and no error.
    """
    i = F.from_json(column, ITEM)
    rows = landed.withColumn("i", i)
    discounted = F.coalesce(F.col("i.discount.status"), F.lit(False))
    return rows.select(
        *[c for c in landed.columns if c != column],
        F.coalesce(F.nullif("i.ean", F.lit("")), F.nullif("i.sku", F.lit(""))).alias("sku"), F.col("i.title").alias("name"), F.col("i.web_url").alias("url"), (F.col("i.price") / 100).alias("price"),
        F.when(discounted, F.col("i.discount.old_price") / 100).alias("old_price"), F.coalesce("i.in_stock", F.lit(True)).alias("in_stock"), discounted.alias("promo"),
        F.col("i.volume").cast("int").alias("volume_ml"), F.coalesce("i.producer.trademark", "i.producer.name").alias("brand"), F.col("i.country").alias("country"),
    ).where("sku is not null")


def characteristics(column: str | Column) -> Column:
    """array<struct<path, values>> to a map of path to its first value; of equal paths the first counts."""
    full = F.filter(column, lambda c: c["path"].isNotNull() & (F.size(c["values"]) > 0))
    return _first_wins(F.transform(full, lambda c: F.struct(c["path"].alias("key"), c["values"][0].alias("value"))))


def attribute_groups(column: str | Column) -> Column:
    """array<struct<attributes: array<struct<key, value>>>> to a map; the first value of a key that is not empty counts."""
    flat = F.flatten(F.transform(column, lambda g: g["attributes"]))
    return _first_wins(F.filter(flat, lambda a: a["key"].isNotNull() & (F.coalesce(F.trim(a["value"]), F.lit("")) != "")))


def _first_wins(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(pairs, lambda p: p["key"] == k)[0]["value"]))


def first_value(attributes: str | Column, keys: list[str]) -> Column:
    """The first of the keys that has a value."""
    return F.coalesce(*[F.try_element_at(attributes if isinstance(attributes, Column) else F.col(attributes), F.lit(k)) for k in keys])


def lower_bound(value: Column) -> Column:
    """The first number of a range."""
    return F.nullif(F.regexp_extract(value, "([0-9]+)", 1), F.lit("")).cast("int")


def walk_pages(pages: DataFrame, items: str = "skus", last_page: str = "last_page") -> DataFrame:
    """Pages of each store that a walk reads: it ends after two pages in a row without a new sku, or after the last page.

    pages: store_id, page, skus (array), last_page (boolean, null: not said). Adds fresh, the number of new skus.
    """
    rows = pages.select("store_id", "page", F.explode_outer(items).alias("sku"), last_page)
    first = rows.where("sku is not null").groupBy("store_id", "sku").agg(F.min("page").alias("page")).groupBy("store_id", "page").agg(F.count("*").alias("fresh"))
    w = W.partitionBy("store_id").orderBy("page")
    counted = pages.join(first, ["store_id", "page"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)).cast("int"))
    ends = F.coalesce(F.col(last_page), F.lit(False)) | ((F.col("fresh") == 0) & (F.lag("fresh", 1).over(w) == 0))
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    walked = counted.withColumn("ends", F.coalesce(ends, F.lit(False)).cast("int")).withColumn("ended", F.coalesce(F.max("ends").over(earlier), F.lit(0)))
    return walked.where("ended = 0").drop("ends", "ended")


def promotion_price(kind: Column, price: Column, secondary: Column) -> Column:
    """The secondary price is an old price only for promotions, and only if it is higher."""
    return F.when((kind == "promotion") & (secondary > price), secondary)


def tiered_price(sale: Column, struck: Column, tier: Column, regular: Column) -> Column:
    """struct(price, old_price): the sale price with what it struck, else the single-unit tier's, else the regular one."""
    return F.struct(F.coalesce(sale, tier, regular).alias("price"), F.when(sale.isNotNull(), struck).alias("old_price"))


def labelled_stock(rows: DataFrame, label: str, price: str, known: dict[str, bool]) -> DataFrame:
    """in_stock by label; rows of an unknown label, and rows in stock at a placeholder price, are none of the listing."""
    stock = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(F.trim(label)))
    return rows.withColumn("in_stock", stock).where(F.col("in_stock").isNotNull() & ~(F.col("in_stock") & (F.col(price) <= PLACEHOLDER_PRICE)))


def checked_stock(label: Column, known: dict[str, bool]) -> Column:
    """in_stock by label; an unknown label fails the run rather than passing for one or the other."""
    value = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), label)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("unknown stock label: "), F.coalesce(label, F.lit("null")))))


def fill_from_labels(rows: DataFrame, attributes: str, fields: dict[str, tuple[list[str], Callable[[Column], Column]]]) -> DataFrame:
    """Fields that are null take what the first labelled value says, read by the field's parser."""
    return rows.withColumns({name: F.coalesce(F.col(name), parse(first_value(attributes, labels))) for name, (labels, parse) in fields.items()})


def read_tag_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of id, name, tags parted by |: rows of three fields, tags of the known vocabulary, each once; a header is no row."""
    rows = spark.read.schema("product_id string, name string, tags string, more string").csv(path, mode="PERMISSIVE")
    rows = rows.where("product_id is not null and name is not null and more is null and lower(product_id) <> 'product_id'")
    tags = F.transform(F.split(F.coalesce("tags", F.lit("")), r"\|"), lambda t: F.lower(F.trim(t)))
    return rows.select("product_id", "name", F.array_sort(F.array_intersect(tags, F.array(*map(F.lit, FLAVOR_KEYWORDS)))).alias("tags"))


def embedded(body: str | Column, schema: str) -> Column:
    """The JSON that a card's attribute holds, as a struct of the schema; null where it is absent or malformed."""
    return F.from_json(F.nullif(F.col(body) if isinstance(body, str) else body, F.lit("")), schema)


def split_list(value: Column) -> Column:
    """A parameter's values parted by commas: trimmed, empty ones dropped; null for nothing."""
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def normalise(items: DataFrame, attributes: str = "attributes", brands: DataFrame | None = None, brand_info: DataFrame | None = None) -> DataFrame:
    """Fields that an item lacks, read from its name and attributes; what the site gave stays.

    Age and type are read from the name alone; volume, strength and country also from the attributes. A
    brand that is not stated is the longest of ``brands`` (name) in the name; what then has no country or
    type takes those of ``brand_info`` (brand, country, type).
    """
    columns = list(dict.fromkeys([*items.columns, "brand", "volume_ml", "abv", "age", "type", "country", "flavors"]))
    items = items.withColumn("brand", text.brand(F.col("brand")))
    if brands is not None:
        items = brand_from_name(items, brand_index(brands)).withColumn("brand", F.coalesce("brand", "found_brand"))
    items = _derived(items, attributes)
    if brand_info is not None:
        items = brand_facts(items, brand_info).withColumns({"country": F.coalesce("country", "brand_country"), "type": F.coalesce("type", "brand_type")})
    return items.select(*columns)


def _derived(items: DataFrame, attributes: str) -> DataFrame:
    hay = F.concat_ws(" ", F.col("name"), F.array_join(F.map_values(attributes), " "))
    return items.withColumns({
        "volume_ml": F.coalesce("volume_ml", text.volume_ml(hay)), "abv": F.coalesce("abv", text.abv(hay)), "age": F.coalesce("age", text.age_years(F.col("name"))),
        "type": F.coalesce("type", text.product_type(F.col("name"))), "country": F.coalesce(text.canonical_country(F.col("country")), text.country(hay)),
        "flavors": F.array_sort(F.array_union(F.coalesce("flavors", F.array().cast("array<string>")), text.flavor_tags(hay))),
    })
