"""The star schema of the price engine: explicit table schemas, and the same tables derived from the test data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "store_id string, slug string, name string, base_url string, color string, active boolean"
PRODUCT = (
    "product_id string, match_key string, name string, age int, abv float, volume_ml int, brand_id string, type_id string, country_id string, "
    "last_llm_flavor_at timestamp_ntz, flavors_curated_at timestamp_ntz"
)
OFFER = "offer_id string, store_id string, product_id string, sku string, url string, name_orig string, in_stock boolean, first_seen date, last_seen date"
SNAPSHOT = "offer_id string, captured_on date, price decimal(12,2), old_price decimal(12,2), currency string, in_stock boolean, promo boolean"
RUN_LOG = "run_id string, store_id string, success boolean, added int, removed int, updated int, total int, error string, created_at timestamp_ntz, finished_at timestamp_ntz"
PRODUCT_FLAVOR = "product_id string, flavor_id string, source string"
PREFERENCE = "user_id string, target_id string, created_at timestamp_ntz"

#: An offer not seen for so many days before the newest day of the data is out of stock.
STOCK_DAYS = 365


@dataclass(frozen=True)
class Star:
    """store, country, product, product_flavor, offer, snapshot, run_log; products carry brand and type by name.

    by_day, where it is stored, has the rows of snapshot and their month, a partition column.
    """

    store: DataFrame
    country: DataFrame
    product: DataFrame
    product_flavor: DataFrame
    offer: DataFrame
    snapshot: DataFrame
    run_log: DataFrame
    by_day: DataFrame | None = None


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table by its schema: nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("store_id"), F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))).alias("slug"), F.col("r_name").alias("store_name")
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("country_id"), F.lower("n_name").alias("code"), F.col("n_name").alias("country_name"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        key.alias("product_id"), F.col("p_name").alias("name"),
        F.when(key % 11 != 0, F.col("p_brand")).alias("brand"), F.when(key % 13 != 0, F.col("p_type")).alias("type"),
        F.when(key % 7 != 0, (key % 25).cast("int")).alias("country_id"),
        (F.col("p_size") % 30).alias("age"), (F.col("p_size") * 25).alias("volume_ml"),
    )


def product_flavors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.explode(F.array_distinct(F.array(words[0], F.get(words, F.lit(1))))).alias("flavor"))


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("event_type") == "error", False).when(F.col("event_type") != "signup", True)
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), (F.col("user_id") % 5).cast("int").alias("store_id"), F.col("ts").alias("created_at"), done.alias("success"),
        F.floor("value").cast("int").alias("added"), F.floor(F.col("value") / 2).cast("int").alias("removed"), F.floor(F.col("value") / 3).cast("int").alias("updated"),
        F.when(done.isNotNull(), F.col("value")).alias("seconds"),
    )


def writes(spark: SparkSession, sf_dir: str, as_of: str | None = None, product: DataFrame | None = None) -> DataFrame:
    """One row a line, or a line of these products: its offer, product, store and day, and w, what it writes of them.

    Suppliers and nations are joined one after the other: the size of either is known, that of their join is only
    guessed, and too high, so all writes would be shuffled for it.
    """
    lines = _table(spark, sf_dir, "lineitem").withColumn("captured_on", F.col("l_shipdate").cast("date"))
    lines = lines if as_of is None else lines.where(F.col("captured_on") <= F.lit(as_of).cast("date"))
    lines = lines if product is None else lines.join(product, F.col("l_partkey") == F.col("product_id"), "left_semi")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("store_id"))
    lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("store_id").cast("string")).alias("offer_id"),
        F.col("l_partkey").alias("product_id"), "store_id", "captured_on",
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag").alias("w"),
    )


def snapshots_of(lines: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row an offer and day, the last write's; with buckets, dealt to so many tasks by offer, in the one shuffle that also brings an offer's writes together.

    Price and promo follow from the write that is kept.
    """
    key = ["offer_id", "product_id", "store_id", "captured_on"]
    kept = (lines if buckets is None else lines.repartition(buckets, "offer_id")).groupBy(*key).agg(F.max("w").alias("w"))
    return kept.select(*key, (F.floor(F.col("w.l_extendedprice") / F.col("w.l_quantity") * 100 + 0.5) / 100).alias("price"), (F.col("w.l_returnflag") == "R").alias("promo"))


def snapshots(spark: SparkSession, sf_dir: str, as_of: str | None = None, buckets: int | None = None) -> DataFrame:
    """The snapshots of all writes, or of those up to as_of."""
    return snapshots_of(writes(spark, sf_dir, as_of), buckets)


def star_views(spark: SparkSession, sf_dir: str, as_of: str | None = None) -> Star:
    """The domain tables as views of region, nation, supplier, part, lineitem and events: all days, or those up to as_of, as the tables stood then."""
    snapshot = snapshots(spark, sf_dir, as_of)
    return Star(*[f(spark, sf_dir) for f in (stores, countries, products, product_flavors)], offers_of(snapshot, as_of), snapshot, run_logs(spark, sf_dir))


def offers_of(snapshot: DataFrame, as_of: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """Offers with their first and last day; in stock are those seen within a year before as_of, or the newest day of all.

    days: captured_on of all, where snapshot has some offers alone.
    """
    offer = snapshot.groupBy("offer_id", "product_id", "store_id").agg(F.min("captured_on").alias("first_seen"), F.max("captured_on").alias("last_seen"))
    newest = (snapshot if days is None else days).agg(F.max("captured_on").alias("newest")).scalar() if as_of is None else F.lit(as_of).cast("date")
    return offer.withColumn("in_stock", F.col("last_seen") >= F.date_sub(newest, STOCK_DAYS))


def last_write_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the one of the greatest order value. An aggregate, so rows combine before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return newest.select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def star_sql(as_of: str | None = None) -> str:
    """The same views in SQL, for other engines: a block of common table expressions to put before a query."""
    newest = "(select max(captured_on) from snapshot)" if as_of is None else f"date '{as_of}'"
    return f"""with store as (
  select r_regionkey as store_id, lower(replace(r_name,' ','-')) as slug, r_name as store_name from region),
country as (select cast(n_nationkey as int) as country_id, lower(n_name) as code, n_name as country_name from nation),
product as (
  select p_partkey as product_id, p_name as name,
    case when p_partkey % 11 = 0 then null else p_brand end as brand,
    case when p_partkey % 13 = 0 then null else p_type end as type,
    case when p_partkey % 7 = 0 then null else cast(p_partkey % 25 as int) end as country_id,
    p_size % 30 as age, p_size * 25 as volume_ml from part),
product_flavor as (
  select p_partkey as product_id, split_part(p_name,' ',1) as flavor from part
  union
  select p_partkey, split_part(p_name,' ',2) from part),
raw_line as (
  select l_partkey as product_id, n_regionkey as store_id,
    concat(cast(l_partkey as varchar(20)), '-', cast(n_regionkey as varchar(20))) as offer_id,
    cast(l_shipdate as date) as captured_on,
    floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 as price,
    l_returnflag = 'R' as promo,
    row_number() over (partition by l_partkey, n_regionkey, cast(l_shipdate as date)
      order by l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_quantity desc, l_returnflag desc) as rn
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
snapshot as (
  select offer_id, product_id, store_id, captured_on, price, promo from raw_line
  where rn = 1{'' if as_of is None else f" and captured_on <= date '{as_of}'"}),
offer as (
  select offer_id, product_id, store_id, min(captured_on) as first_seen, max(captured_on) as last_seen,
    max(captured_on) >= {newest} - {STOCK_DAYS} as in_stock
  from snapshot group by offer_id, product_id, store_id),
run_log as (
  select event_id as run_id, cast(user_id % 5 as int) as store_id, ts as created_at,
    case event_type when 'signup' then null when 'error' then false else true end as success,
    cast(floor(value) as int) as added, cast(floor(value / 2) as int) as removed, cast(floor(value / 3) as int) as updated,
    case when event_type <> 'signup' then value end as seconds from events)
"""


STAR_SQL = star_sql()
