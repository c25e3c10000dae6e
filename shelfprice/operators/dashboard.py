"""Dashboard series: daily metrics, listing lifecycle, merged series, weeks, breakdowns, movers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.star import Star
from ..sources.stored import between

#: Where price buckets begin.
BUCKETS = (500, 1000, 2000, 3000, 5000, 10000)
MAX_SPAN_DAYS = 732
AUTO_WEEK_DAYS = 120


def listings(star: Star, first: str | None = None, last: str | None = None) -> DataFrame:
    """Snapshots with what the dashboard groups by: product, brand, type, country, store; of all days, or of a range, which is checked as in within()."""
    return _described(star, star.snapshot if first is None else between(star, *(F.lit(x) for x in _checked(first, last))))


def _described(star: Star, rows: DataFrame) -> DataFrame:
    dims = star.product.join(star.country, "country_id", "left").select("product_id", "brand", "type", F.col("code").alias("country"))
    return rows.join(dims, "product_id").join(star.store, "store_id")


def _checked(first: str, last: str) -> tuple[date, date]:
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    if a > b or (b - a).days + 1 > MAX_SPAN_DAYS:
        raise ValueError(f"a range of 1 to {MAX_SPAN_DAYS} days is needed")
    return a, b


def within(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of the days first to last, both included. A span over 732 days, or one that ends before it begins, is an error."""
    a, b = _checked(first, last)
    return rows.where(F.col("captured_on").between(F.lit(a), F.lit(b)))


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def price_quartiles(rows: DataFrame, *by: str, wanted: dict[str, float] | None = None) -> DataFrame:
    """Per group: listings, promotions, and exact continuous percentiles of the price, rounded to 4 places.

    Rows are counted by price first, where tasks add up before the shuffle; a running sum of those counts
    says at which price each rank lies, and a percentile is the point between two ranks' prices. So a group
    is sorted, and may spill, but is never one value in memory.
    """
    wanted = QUARTILES if wanted is None else wanted
    price = F.col("price").cast("double")
    counts = rows.groupBy(*by, price.alias("__price")).agg(F.count("*").alias("__n"), F.count_if("promo").alias("__promo"))
    whole = W.partitionBy(*by)
    priced = F.when(F.col("__price").isNotNull(), F.col("__n")).otherwise(F.lit(0))
    running = F.sum(priced).over(whole.orderBy("__price").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranks = counts.withColumn("__upto", running).withColumn("__all", F.sum(priced).over(whole))
    at = lambda rank: F.min(F.when((rank >= F.col("__upto") - priced) & (rank < F.col("__upto")), F.col("__price")))
    place = {name: (F.col("__all") - 1) * F.lit(q) for name, q in wanted.items()}
    found = [F.struct(at(F.floor(r)).alias("low"), at(F.ceil(r)).alias("high"), F.max(r - F.floor(r)).alias("part")).alias(f"__{name}") for name, r in place.items()]
    out = ranks.groupBy(*by).agg(F.sum("__n").alias("in_stock"), F.sum("__promo").alias("promo"), *found)
    between_ = lambda c: F.round(c["low"] + c["part"] * (c["high"] - c["low"]), 4)
    return out.withColumns({name: between_(F.col(f"__{name}")) for name in wanted}).drop(*[f"__{name}" for name in wanted])


def distinct_members(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: distinct products, brands and stores. Pairs of group and product are made once; their brands and then the group are counted from them."""
    pairs = rows.groupBy(*by, "product_id").agg(F.first("brand").alias("brand"))
    brands = pairs.groupBy(*by, "brand").agg(F.count("*").alias("products"))
    counted = brands.groupBy(*by).agg(F.sum("products").alias("products"), F.count("brand").alias("brands"))
    stores = rows.groupBy(*by, "store_id").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count("store_id").alias("stores"))
    return counted.join(stores, list(by))


def daily(rows: DataFrame, *by: str) -> DataFrame:
    """Per day (and store or country): listings, distinct products, brands and stores, price quartiles, promotions.

    Days without data give no row. Distinct counts and medians of parts don't add up to the whole's, so
    totals are always aggregated from the rows. A product has one brand.
    """
    keyed = rows.withColumn("country", F.coalesce("country", F.lit("unknown"))) if "country" in by else rows
    both = price_quartiles(keyed, "captured_on", *by).join(distinct_members(keyed, "captured_on", *by), ["captured_on", *by])
    return both.select("captured_on", *by, "in_stock", "products", "brands", "stores", "promo", *QUARTILES)


def edge_days(rows: DataFrame) -> DataFrame:
    """The first and the last day that have data: 0, 1 or 2 rows."""
    edges = rows.agg(F.min("captured_on").alias("low"), F.max("captured_on").alias("high"))
    return edges.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("captured_on")).where("captured_on is not null")


def boundary(rows: DataFrame) -> DataFrame:
    """daily() of only the first and the last day that have data: 0, 1 or 2 rows."""
    return daily(rows.join(F.broadcast(edge_days(rows)), "captured_on"))


def bounds(snapshot: DataFrame) -> DataFrame:
    """First and last day with data and the number of such days."""
    return snapshot.agg(F.min("captured_on").alias("first_day"), F.max("captured_on").alias("last_day"), F.countDistinct("captured_on").alias("days"))


def clamped_range(snapshot: DataFrame, first: str, last: str) -> DataFrame:
    """One row, first, last and empty: the range cut to the days that have data; as it was asked for, and empty, where it meets none. A span that is wrong is an error, as in within()."""
    a, b = (F.lit(x) for x in _checked(first, last))
    cut = snapshot.agg(F.min("captured_on").alias("low"), F.max("captured_on").alias("high")).select(F.greatest(a, "low").alias("from"), F.least(b, "high").alias("to"), F.col("low").isNull().alias("none"))
    empty = F.col("none") | (F.col("from") > F.col("to"))
    return cut.select(F.when(empty, a).otherwise(F.col("from")).alias("first"), F.when(empty, b).otherwise(F.col("to")).alias("last"), empty.alias("empty"))


def daily_in_range(star: Star, first: str, last: str, *by: str) -> DataFrame:
    """daily() of a clamped range with first, last and empty on each row; one row without a day where the range is empty.

    Its ends are subqueries, known before snapshots are read: no job runs while this is planned, and months beside the range are skipped.
    """
    cut = clamped_range(star.snapshot, first, last)
    rows = _described(star, between(star, cut.select("first").scalar(), cut.select("last").scalar()))
    return cut.join(daily(rows, *by), ~F.col("empty"), "left")


def meta(star: Star) -> DataFrame:
    """The dashboard's context: each store's coverage, with the first, the last and the number of days of all."""
    return coverage(star).crossJoin(F.broadcast(bounds(star.snapshot).select(F.col("first_day").alias("floor"), F.col("last_day").alias("latest"), F.col("days").alias("day_count"))))


def coverage(star: Star) -> DataFrame:
    """Each store, empty ones too: listings, those in stock, first and last day with data."""
    counts = star.offer.groupBy("store_id").agg(F.count("*").alias("listings"), F.count_if("in_stock").alias("in_stock"))
    days = star.snapshot.groupBy("store_id").agg(F.min("captured_on").alias("first_day"), F.max("captured_on").alias("last_day"))
    return star.store.join(counts, "store_id", "left").join(days, "store_id", "left").select(
        "slug", F.coalesce("listings", F.lit(0)).alias("listings"), F.coalesce("in_stock", F.lit(0)).alias("in_stock"), "first_day", "last_day"
    )


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("listings"), F.countDistinct("product_id").alias("products"))


def breakdown(rows: DataFrame, by: str) -> DataFrame:
    """Listings, products and median price of each value; null is "unknown"."""
    keyed = rows.withColumn("key", F.coalesce(by, F.lit("unknown")))
    products = keyed.groupBy("key", "product_id").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("product_id").alias("products"))
    return price_quartiles(keyed, "key", wanted={"median": 0.5}).join(products, "key").select("key", F.col("in_stock").alias("listings"), "products", "median")


def breakdown_flavors(rows: DataFrame, flavors: DataFrame) -> DataFrame:
    """The same by flavor: a listing counts in each of its flavors, one without any in none."""
    return breakdown(rows.join(flavors, "product_id"), "flavor")


def breakdown_prices(rows: DataFrame, edges: tuple = BUCKETS) -> DataFrame:
    """Listings and products by price bucket: bucket is the number of edges at or below the price; empty ones give no row."""
    bucket = sum(((F.col("price") >= e).cast("int") for e in edges[1:]), (F.col("price") >= edges[0]).cast("int"))
    low = F.get(F.array(F.lit(None).cast("int"), *map(F.lit, edges)), F.col("bucket"))
    high = F.get(F.array(*map(F.lit, edges)), F.col("bucket"))
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("listings"), F.countDistinct("product_id").alias("products"))
    return counted.select("bucket", low.alias("low"), high.alias("high"), "listings", "products")


def lifecycle(offers: DataFrame, first: str, last: str, *by: str) -> DataFrame:
    """Per day of the range (and key), days without data too: tracked, new and departed listings.

    tracked counts all listings that came up to the day, also before the range: the running sum is over
    all days of arrival, and only then cut to the range.
    """
    arrivals = offers.groupBy(*by, F.col("first_seen").alias("day")).agg(F.count("*").alias("came"))
    departures = offers.where(~F.col("in_stock")).groupBy(*by, F.col("last_seen").alias("day")).agg(F.count("*").alias("departed"))
    # The axis is as long as the range; arrivals before it become one row a key, on its first day.
    axis = offers.sparkSession.sql(f"select explode(sequence(date '{first}', date '{last}')) as day")
    keys = offers.select(*by).distinct() if by else None
    dense = keys.crossJoin(axis) if by else axis
    early = arrivals.where(F.col("day") < F.lit(first).cast("date")).groupBy(*by).agg(F.sum("came").alias("before"))
    here = dense.join(arrivals, [*by, "day"], "left").join(departures, [*by, "day"], "left")
    here = here.join(early, list(by), "left") if by else here.crossJoin(early)
    running = W.partitionBy(*by).orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    zero = F.lit(0).cast("long")
    return here.select(
        *by, "day", (F.coalesce("before", zero) + F.sum(F.coalesce("came", zero)).over(running)).alias("tracked"),
        F.coalesce("came", zero).alias("new"), F.coalesce("departed", zero).alias("departed"),
    )


COUNTS = ("in_stock", "products", "brands", "stores", "promo", "tracked", "new", "departed")


def series(day_rows: DataFrame, life_rows: DataFrame, *by: str) -> DataFrame:
    """Days of either side, counts 0 and prices null where a side has none; out_of_stock = what is tracked and not there."""
    joined = day_rows.withColumnRenamed("captured_on", "day").join(life_rows, [*by, "day"], "full_outer")
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in COUNTS})
    return joined.select(*by, "day", *COUNTS, F.greatest(F.lit(0), F.col("tracked") - F.col("in_stock")).alias("out_of_stock"), "p25", "median", "p75")


def weekly(points: DataFrame, *by: str) -> DataFrame:
    """Weeks from Monday: states are those of the week's last day, arrivals and departures add up."""
    flows = ("new", "departed")
    levels = [c for c in points.columns if c not in (*flows, *by, "day")]
    weeks = points.groupBy(*by, F.date_trunc("week", "day").cast("date").alias("week")).agg(
        F.max_by(F.struct(*levels), "day").alias("last"), *[F.sum(c).alias(c) for c in flows]
    )
    return weeks.select(*by, "week", *[F.col(f"last.{c}").alias(c) for c in levels], *flows)


def granularity(first: str, last: str, pinned: str | None = None) -> str:
    """day, or week where the span is over 120 days, unless pinned."""
    return pinned or ("week" if (date.fromisoformat(last) - date.fromisoformat(first)).days + 1 > AUTO_WEEK_DAYS else "day")


def summary(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """One row a metric: latest day's and first day's value, their difference, and that in percent of the first (null at 0)."""
    edges = boundary(rows)
    # Two rows at most are broadcast, so each offer is looked at once.
    tracked = offers.crossJoin(F.broadcast(edge_days(rows))).where(F.col("first_seen") <= F.col("captured_on")).groupBy("captured_on").agg(F.count("*").alias("tracked"))
    facts = edges.join(tracked, "captured_on", "left").withColumn("tracked", F.coalesce("tracked", F.lit(0)))
    facts = facts.withColumn("out_of_stock", F.greatest(F.lit(0), F.col("tracked") - F.col("in_stock")))
    facts = facts.withColumn("promo_share", F.round(F.try_divide(F.col("promo").cast("double"), F.col("in_stock")), 6))
    names = ["in_stock", "tracked", "out_of_stock", "products", "brands", "stores", "median", "promo_share"]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    long = facts.select("captured_on", F.explode(pairs).alias("m")).select("captured_on", "m.metric", "m.value")
    both = long.groupBy("metric").agg(F.max_by("value", "captured_on").alias("latest"), F.min_by("value", "captured_on").alias("baseline"))
    delta = F.col("latest") - F.col("baseline")
    percent = F.when(F.col("baseline") != 0, F.round(delta / F.col("baseline") * 100, 4))
    return both.select("metric", "latest", "baseline", F.round(delta, 6).alias("delta"), percent.alias("delta_pct"))


def movers(snapshot: DataFrame, *, rises: bool, limit: int = 10, store_id: int | None = None, min_price: float | None = None) -> DataFrame:
    """Offers whose price changed most in percent between their first and last day; limit is the report's length, at most 50.

    An offer needs two days and a first price above 0. Scope and min_price (on the first price) come after that.
    """
    edges = snapshot.groupBy("offer_id", "store_id").agg(
        F.min("captured_on").alias("first_day"), F.max("captured_on").alias("last_day"), F.min_by("price", "captured_on").alias("first_price"), F.max_by("price", "captured_on").alias("last_price")
    )
    moved = edges.where((F.col("first_day") < F.col("last_day")) & (F.col("first_price") > 0) & (F.col("first_price") != F.col("last_price")))
    moved = moved.where(F.col("store_id") == store_id) if store_id is not None else moved
    moved = moved.where(F.col("first_price") >= min_price) if min_price is not None else moved
    change = F.col("last_price") - F.col("first_price")
    moved = moved.withColumns({"change": F.round(change, 2), "change_pct": F.round(change / F.col("first_price") * 100, 4)})
    moved = moved.where(F.col("change") > 0 if rises else F.col("change") < 0)
    order = F.desc("change_pct") if rises else F.asc("change_pct")
    return moved.orderBy(order, "offer_id").limit(min(limit, 50)).select("offer_id", "store_id", "first_day", "last_day", "first_price", "last_price", "change", "change_pct")
