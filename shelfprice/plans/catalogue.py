"""All queries of the price engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import dashboard as dash
from ..operators import curation, ingest, offers, preferences, reports, runs
from ..operators.filters import OfferFilter, filter_offers
from ..sources import html
from ..sources.star import STAR_SQL, Star, last_write_wins, star_sql, star_views
from ..sources.stored import between, stored_star

#: The dashboard's range, a day of it, the first day of its second year; the day of a report on what was new then; today, for reports and runs over all days.
FIRST, LAST = "1997-01-01", "1998-12-31"
DAY, YEAR = "1998-05-15", "1998-01-01"
NEW_ON = "1996-06-30"
TODAY = "2001-12-31"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LISTING_SQL = STAR_SQL + """, listing as (
  select s.*, p.brand, p.type, c.code as country, st.slug
  from snapshot s join product p using (product_id) join store st using (store_id) left join country c on p.country_id = c.country_id
  where captured_on between date 'FIRST' and date 'LAST')
""".replace("FIRST", FIRST).replace("LAST", LAST)
_NOW_SQL = """, newest as (
  select offer_id, price, promo, captured_on, lead(price) over w as previous_price, row_number() over w as rn
  from snapshot window w as (partition by offer_id order by captured_on desc)),
flavors as (select product_id, list_sort(list(distinct flavor)) as flavors from product_flavor group by product_id),
cur as (
  select offer_id, o.product_id, o.store_id, slug, store_name, p.name, brand, type, c.code as country, age, volume_ml, coalesce(flavors, []) as flavors,
    price, previous_price, promo, captured_on, first_seen, last_seen, in_stock
  from newest n join offer o using (offer_id) join product p on p.product_id = o.product_id join store st on st.store_id = o.store_id
    left join country c on c.country_id = p.country_id left join flavors f on f.product_id = o.product_id where rn = 1),
stocked as (select * from cur where in_stock)
"""
_CURRENT_SQL = STAR_SQL + _NOW_SQL
_DISCOUNT = "case when {r} > 0 and {p} < {r} then cast(floor(({r} - {p}) / {r} * 100 + 0.5) as int) end"


def _query(name: str, sql: str | None = None):
    """Registers a function of the star (or of the session and folder, where it asks for them)."""

    def add(f):
        QUERIES[name] = f if f.__code__.co_varnames[0] == "spark" else lambda spark, sf_dir: f(stored_star(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _current(star: Star) -> DataFrame:
    return offers.current_offers(star)


def _stocked(star: Star) -> DataFrame:
    return _current(star).where("in_stock")


def _seen(star: Star) -> DataFrame:
    """The newest days of the offers in stock, as stored with them."""
    return star.offer.where("in_stock").select(F.col("last_seen").alias("captured_on"))


def _listings(star: Star) -> DataFrame:
    return dash.listings(star, FIRST, LAST)


_FLAT = ["offer_id", "product_id", "slug", "price", "previous_price", "captured_on"]


# Current offers and prices over time

@_query("current_offers", _CURRENT_SQL + "select * replace (array_to_string(flavors, ',') as flavors) from cur")
def _(star):
    return _current(star).withColumn("flavors", F.concat_ws(",", "flavors"))


@_query("latest_date", STAR_SQL + "select max(captured_on) as latest_date from snapshot")
def _(star):
    return offers.latest_date(star.snapshot)


@_query("price_extremes", STAR_SQL + "select offer_id, min(price) as min_price, max(price) as max_price from snapshot where captured_on >= date '1998-01-01' group by offer_id")
def _(star):
    return offers.price_extremes(star.snapshot, F.lit(YEAR).cast("date"))


_SINCE_SQL = """, now as (select offer_id, arg_max(price, captured_on) as now from snapshot group by offer_id),
higher as (select offer_id, max(captured_on) as higher_on from snapshot join now using (offer_id) where price > now group by offer_id),
since as (
  select s.offer_id, min(captured_on) as since from snapshot s left join higher h using (offer_id)
  where higher_on is null or captured_on > higher_on group by s.offer_id)
"""


@_query("price_since", STAR_SQL + _SINCE_SQL + "select * from since")
def _(star):
    return offers.price_since(star.snapshot)


@_query("price_history", STAR_SQL + """, tail as (select *, row_number() over (partition by offer_id order by captured_on desc) as back from snapshot)
select offer_id, row_number() over (partition by offer_id order by captured_on)::int as point, captured_on, price from tail where back <= 60""")
def _(star):
    return offers.price_history(star.snapshot)


@_query("resolve_offer", STAR_SQL + "select offer_id, product_id, store_id from offer where product_id = 7 order by in_stock desc, last_seen desc, offer_id limit 1")
def _(star):
    return offers.resolve_offer(star.offer, "7")


@_query("resolve_term", _CURRENT_SQL + "select offer_id, name, in_stock, last_seen from cur where name ilike '%red%' order by in_stock desc, last_seen desc, offer_id limit 1")
def _(star):
    return offers.resolve_term(_current(star), "RED")


# Dashboard

@_query("dash_bounds", STAR_SQL + "select min(captured_on) as first_day, max(captured_on) as last_day, count(distinct captured_on) as days from snapshot")
def _(star):
    return dash.bounds(star.snapshot)


@_query("dash_coverage", STAR_SQL + """, o as (select store_id, count(*) as listings, count(*) filter (where in_stock) as in_stock from offer group by store_id),
s as (select store_id, min(captured_on) as first_day, max(captured_on) as last_day from snapshot group by store_id)
select slug, coalesce(listings, 0) as listings, coalesce(in_stock, 0) as in_stock, first_day, last_day from store left join o using (store_id) left join s using (store_id)""")
def _(star):
    return dash.coverage(star)


_METRICS = """count(*) as in_stock, count(distinct product_id) as products, count(distinct brand) as brands, count(distinct store_id) as stores,
  count(*) filter (where promo) as promo, round(quantile_cont(price::double, 0.25), 4) as p25, round(quantile_cont(price::double, 0.5), 4) as median,
  round(quantile_cont(price::double, 0.75), 4) as p75"""


@_query("dash_daily", _LISTING_SQL + f"select captured_on, {_METRICS} from listing group by captured_on")
def _(star):
    return dash.daily(_listings(star))


@_query("dash_daily_store", _LISTING_SQL + f"select captured_on, slug, {_METRICS} from listing group by captured_on, slug")
def _(star):
    return dash.daily(_listings(star), "slug")


@_query("dash_daily_country", _LISTING_SQL + f"select captured_on, coalesce(country, 'unknown') as country, {_METRICS} from listing group by 1, 2")
def _(star):
    return dash.daily(_listings(star), "country")


_EDGE_SQL = "(select min(captured_on) from listing union select max(captured_on) from listing)"


@_query("dash_boundary", _LISTING_SQL + f"select captured_on, {_METRICS} from listing where captured_on in {_EDGE_SQL} group by captured_on")
def _(star):
    return dash.boundary(_listings(star))


@_query("brk_totals", _LISTING_SQL + f"select count(*) as listings, count(distinct product_id) as products from listing where captured_on = date '{DAY}'")
def _(star):
    return dash.totals(dash.listings(star, DAY, DAY))


def _brk_sql(by: str, source: str = "listing") -> str:
    return f"select coalesce({by}, 'unknown') as key, count(*) as listings, count(distinct product_id) as products, round(quantile_cont(price::double, 0.5), 4) as median from {source} group by 1"


for _name, _column in (("type", "type"), ("country", "country"), ("store", "slug")):
    _query(f"brk_{_name}", _LISTING_SQL + _brk_sql(_column))(lambda star, c=_column: dash.breakdown(_listings(star), c))


@_query("brk_flavor", _LISTING_SQL + _brk_sql("flavor", "listing join product_flavor using (product_id)"))
def _(star):
    return dash.breakdown_flavors(_listings(star), star.product_flavor)


_BUCKET = " + ".join(f"(price >= {e})::int" for e in dash.BUCKETS)


@_query("brk_price_bucket", _LISTING_SQL + f"""select bucket, [null, {', '.join(map(str, dash.BUCKETS))}][bucket + 1] as low, [{', '.join(map(str, dash.BUCKETS))}, null][bucket + 1] as high,
  count(*) as listings, count(distinct product_id) as products from (select *, {_BUCKET} as bucket from listing) group by bucket""")
def _(star):
    return dash.breakdown_prices(_listings(star))


def _life_sql(by: str = "", source: str = "offer") -> str:
    keys, on = (f"{by}, ", f"and x.{by} = k.{by}") if by else ("", "")
    axis = f"(select distinct {by} from {source}) k, range(date '{FIRST}', date '{LAST}' + interval 1 day, interval 1 day) d(day)" if by else f"(select 1) k, range(date '{FIRST}', date '{LAST}' + interval 1 day, interval 1 day) d(day)"
    return f"""select {'k.' + by + ',' if by else ''} d.day::date as day,
  (select count(*) from {source} x where x.first_seen <= d.day::date {on}) as tracked,
  (select count(*) from {source} x where x.first_seen = d.day::date {on}) as new,
  (select count(*) from {source} x where x.last_seen = d.day::date and not x.in_stock {on}) as departed
from {axis}"""


_KEYED_SQL = """, keyed as (select o.*, slug, coalesce(code, 'unknown') as country from offer o join store using (store_id) join product using (product_id) left join country using (country_id))
"""


def _keyed(star: Star) -> DataFrame:
    return star.offer.join(star.store, "store_id").join(star.product, "product_id").join(star.country, "country_id", "left").withColumn("country", F.coalesce("code", F.lit("unknown")))


@_query("lifecycle_daily", STAR_SQL + _life_sql())
def _(star):
    return dash.lifecycle(star.offer, FIRST, LAST)


@_query("lifecycle_store", STAR_SQL + _KEYED_SQL + _life_sql("slug", "keyed"))
def _(star):
    return dash.lifecycle(_keyed(star), FIRST, LAST, "slug")


@_query("lifecycle_country", STAR_SQL + _KEYED_SQL + _life_sql("country", "keyed"))
def _(star):
    return dash.lifecycle(_keyed(star), FIRST, LAST, "country")


def _series_sql(by: str = "") -> str:
    k = f"{by}, " if by else ""
    value = "coalesce(country, 'unknown') as country" if by == "country" else by
    zeros = ", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in dash.COUNTS)
    return f""", d as (select {value + ',' if by else ''} captured_on as day, {_METRICS} from listing group by all), l as ({_life_sql(by, 'keyed')}),
points as (select {k}day, {zeros}, greatest(0, coalesce(tracked, 0) - coalesce(in_stock, 0))::bigint as out_of_stock, p25, median, p75 from d full join l using ({k}day))
"""


def _series(star: Star, *by: str) -> DataFrame:
    return dash.series(dash.daily(_listings(star), *by), dash.lifecycle(_keyed(star), FIRST, LAST, *by), *by)


_query("dash_series", _LISTING_SQL + _KEYED_SQL + _series_sql() + "select * from points")(lambda star: _series(star))
_query("dash_series_store", _LISTING_SQL + _KEYED_SQL + _series_sql("slug") + "select * from points")(lambda star: _series(star, "slug"))
_query("dash_series_country", _LISTING_SQL + _KEYED_SQL + _series_sql("country") + "select * from points")(lambda star: _series(star, "country"))
_LEVELS = ["in_stock", "products", "brands", "stores", "promo", "tracked", "out_of_stock", "p25", "median", "p75"]


@_query("dash_weekly", _LISTING_SQL + _KEYED_SQL + _series_sql() + f"""select date_trunc('week', day)::date as week, {', '.join(f'arg_max_null({c}, day) as {c}' for c in _LEVELS)},
  sum(new)::bigint as new, sum(departed)::bigint as departed from points group by 1""")
def _(star):
    return dash.weekly(_series(star))


@_query("dash_summary", _LISTING_SQL + f""", edges as (select captured_on, {_METRICS} from listing where captured_on in {_EDGE_SQL} group by captured_on),
facts as (
  select *, greatest(0, tracked - in_stock) as out_of_stock, round(promo::double / in_stock, 6) as promo_share
  from (select e.*, (select count(*) from offer o where o.first_seen <= e.captured_on) as tracked from edges e)),
long as (unpivot (select captured_on, in_stock::double as in_stock, tracked::double as tracked, out_of_stock::double as out_of_stock, products::double as products, brands::double as brands,
  stores::double as stores, median, promo_share from facts) on in_stock, tracked, out_of_stock, products, brands, stores, median, promo_share into name metric value value),
paired as (select metric, arg_max(value, captured_on) as latest, arg_min(value, captured_on) as baseline from long group by metric)
select metric, latest, baseline, round(latest - baseline, 6) as delta, case when baseline <> 0 then round((latest - baseline) / baseline * 100, 4) end as delta_pct from paired""")
def _(star):
    return dash.summary(_listings(star), star.offer)


def _mover_sql(rises: bool) -> str:
    sign, order = (">", "desc") if rises else ("<", "asc")
    return STAR_SQL + f""", edges as (
  select offer_id, store_id, min(captured_on) as first_day, max(captured_on) as last_day, arg_min(price, captured_on) as first_price, arg_max(price, captured_on) as last_price
  from snapshot where captured_on between date '{FIRST}' and date '{LAST}' group by offer_id, store_id)
select offer_id, store_id, first_day, last_day, first_price, last_price, round(last_price - first_price, 2) as change, round((last_price - first_price) / first_price * 100, 4) as change_pct
from edges where first_day < last_day and first_price > 0 and last_price {sign} first_price order by change_pct {order}, offer_id limit 10"""


_query("movers_drops", _mover_sql(False))(lambda star: dash.movers(dash.within(star.snapshot, FIRST, LAST), rises=False))
_query("movers_rises", _mover_sql(True))(lambda star: dash.movers(dash.within(star.snapshot, FIRST, LAST), rises=True))


# Reports

_GROUP_SQL = """, ranked as (select *, row_number() over (partition by group_key order by price, store_name, offer_id) - 1 as offer_rank from enriched)
select first_value(offer_id) over (partition by group_key order by offer_rank) as group_id, offer_rank::int as offer_rank, offer_id, product_id, slug, price, reference, discount, days from ranked"""


def _enriched_sql(reference: str, source: str, days: str = "null::int", key: str = "product_id", where: str = "true") -> str:
    return f", enriched as (select * from (select *, {_DISCOUNT.format(p='price', r='reference')} as discount from (select *, {reference} as reference, {days} as days, {key} as group_key from {source})) where {where})"


_PREVIOUS = "case when previous_price > price then previous_price end"


@_query("rep_catalog", _CURRENT_SQL + _enriched_sql(_PREVIOUS, "stocked") + _GROUP_SQL)
def _(star):
    return reports.flat(reports.catalog(_stocked(star)))


@_query("rep_catalog_page", _CURRENT_SQL + """select arg_min(offer_id, (price, store_name, offer_id)) as group_id, any_value(name) as name, min(price) as price, count(*) as n_offers
from stocked group by product_id order by lower(any_value(name)), min(price), group_id limit 50 offset 50""")
def _(star):
    shown = reports.page(reports.catalog(_stocked(star)), "catalog", number=2)
    return shown.select("group_id", "name", "price", F.size("offers").cast("long").alias("n_offers"))


_RECENT_SQL = """, cutoff as (select max(captured_on) - 365 as cutoff from stocked),
extremes as (select offer_id, min(price) as min_price, max(price) as max_price from snapshot, cutoff where captured_on >= cutoff group by offer_id)
"""


@_query("rep_drops", _CURRENT_SQL + _SINCE_SQL + _RECENT_SQL + ", rows as (select s.*, max_price, since from stocked s left join extremes using (offer_id) left join since using (offer_id))"
        + _enriched_sql("case when max_price > price then max_price end", "rows", f"date_diff('day', since, date '{TODAY}')::int", where="discount is not null and discount >= 5") + _GROUP_SQL)
def _(star):
    return reports.flat(reports.drops(_stocked(star), star, TODAY, window="year", least=5, days=_seen(star)))


@_query("rep_low", _CURRENT_SQL + _RECENT_SQL + ", rows as (select s.* from stocked s join extremes using (offer_id) where price <= min_price + 1e-9)"
        + _enriched_sql("previous_price", "rows", key="offer_id", where="discount is not null") + _GROUP_SQL)
def _(star):
    return reports.flat(reports.lows(_stocked(star), star, window="year", days=_seen(star)))


@_query("rep_new", star_sql(NEW_ON) + _NOW_SQL + f", rows as (select * from stocked where first_seen >= date '{NEW_ON}' - 6)" + _enriched_sql("null::double", "rows", f"date_diff('day', first_seen, date '{NEW_ON}')::int") + _GROUP_SQL)
def _(spark, sf_dir):
    # A report of a past day: the tables as they stood then.
    return reports.flat(reports.new_listings(_stocked(star_views(spark, sf_dir, NEW_ON)), NEW_ON))


@_query("rep_best", _CURRENT_SQL + """, placed as (select *, row_number() over w as place, lead(price) over w as next_price from stocked window w as (partition by product_id order by price, store_name, offer_id)),
won as (select product_id from placed where place = 1 and price >= next_price * 0.5 and price >= 1000 and product_id in (select product_id from stocked group by 1 having count(distinct slug) >= 2)),
rows as (select * from placed where product_id in (select product_id from won))""" + _enriched_sql(f"case when place = 1 then next_price else {_PREVIOUS} end", "rows") + _GROUP_SQL)
def _(star):
    return reports.flat(reports.best(_stocked(star), min_price=1000))


@_query("rep_history", _CURRENT_SQL + """, one as (select offer_id from cur where name ilike '%red%' order by in_stock desc, last_seen desc, offer_id limit 1),
tail as (select *, row_number() over (partition by offer_id order by captured_on desc) as back from snapshot join one using (offer_id))
select offer_id, row_number() over (partition by offer_id order by captured_on)::int as point, captured_on, price from tail where back <= 60""")
def _(star):
    return offers.term_history(star.of_products(offers.named(star.product, "red")), "red")


@_query("fn_discount", _CURRENT_SQL + f"select offer_id, {_DISCOUNT.format(p='price', r='previous_price')} as discount from cur")
def _(star):
    return _current(star).select("offer_id", offers.discount_percent(F.col("price"), F.col("previous_price")).alias("discount"))


# Filters

def _flt(name: str, where: str, wanted: OfferFilter, **lists):
    columns = ", ".join(_FLAT)
    frames = lambda star: {k: f(star) for k, f in lists.items()}
    _query(name, _CURRENT_SQL + f"select {columns} from cur where {where}")(lambda star: filter_offers(_current(star), wanted, **frames(star)).select(*_FLAT))


_flt("flt_stores", "in_stock and slug in ('asia', 'europe')", OfferFilter(stores=["asia", "europe"]))
_flt("flt_ranges", "in_stock and price between 1000 and 1500 and volume_ml between 500 and 900", OfferFilter(min_price=1000, max_price=1500, min_volume=500, max_volume=900))
_flt("flt_countries", "in_stock and lower(country) in ('nation_3', 'nation_11')", OfferFilter(countries=["NATION_3", "Nation_11"]))
_flt("flt_name", "in_stock and name ilike '%RED%'", OfferFilter(name="red"))
_flt("flt_name_age", "in_stock and (name ilike '%red 12%' or (name ilike '%red%' and age = 12))", OfferFilter(name="red 12"))
_flt("flt_types", "in_stock and (type in ('ECONOMY', 'PROMO') or type is null)", OfferFilter(types=["ECONOMY", "PROMO", "unknown"]))
_flt("flt_unknown_type", "in_stock and type is null", OfferFilter(types=["unknown"]))
_flt("flt_any_stock", "price >= 1800", OfferFilter(in_stock_only=False, min_price=1800))
_flt("flt_flavors", "in_stock and product_id in (select product_id from product_flavor where flavor in ('red', 'ring')) and product_id not in (select product_id from product_flavor where flavor = 'bolt')",
     OfferFilter(flavors=["red", "ring"], exclude_flavors=["bolt"]))
_flt("flt_blacklists", "in_stock and product_id % 10 <> 0 and (brand is null or brand not in (select brand from product where product_id % 17 = 0 and brand is not null))", OfferFilter(),
     blacklist_products=lambda s: s.product.where("product_id % 10 = 0"), blacklist_brands=lambda s: s.product.where("product_id % 17 = 0"))
_flt("flt_favorites", "in_stock and product_id % 5 = 0", OfferFilter(favorites_only=True), favorites=lambda s: s.product.where("product_id % 5 = 0"))


# Runs and lookups

@_query("sync_activity", STAR_SQL + """select created_at::date as day, count(*) as runs, count(*) filter (where success) as succeeded, count(*) filter (where not success) as failed,
  count(*) filter (where success is null) as running, coalesce(sum(added), 0)::bigint as added, coalesce(sum(removed), 0)::bigint as removed, coalesce(sum(updated), 0)::bigint as updated,
  floor(round(avg(seconds * 1000), 4) + 0.5)::bigint as avg_ms, floor(max(seconds * 1000) + 0.5)::bigint as max_ms
from run_log where created_at >= timestamp '2024-01-01' and created_at < timestamp '2024-02-01' group by 1""")
def _(star):
    return runs.activity(star.run_log, "2024-01-01", "2024-01-31")


@_query("sync_last_success", STAR_SQL + "select store_id, max(created_at) as last_success from run_log where success group by store_id")
def _(star):
    return runs.last_success(star.run_log)


@_query("sync_running", STAR_SQL + "select run_id, store_id, created_at from run_log where success is null")
def _(star):
    return runs.running(star.run_log)


@_query("sync_recent", STAR_SQL + """select store_id, place::int as place, run_id, created_at, success
from (select *, row_number() over (partition by store_id order by created_at desc, run_id desc) as place from run_log) where place <= 10""")
def _(star):
    return runs.recent(star.run_log)


@_query("store_instock_count", STAR_SQL + "select store_id, count(*) as in_stock from offer where in_stock group by store_id")
def _(star):
    return star.offer.where("in_stock").groupBy("store_id").agg(F.count("*").alias("in_stock"))


@_query("store_list", STAR_SQL + """, s as (select store_id, count(*) as in_stock from offer where in_stock group by store_id),
r as (select store_id, max(created_at) as last_success from run_log where success group by store_id)
select slug, store_name, coalesce(in_stock, 0) as in_stock, last_success from store left join s using (store_id) left join r using (store_id)""")
def _(star):
    return runs.store_list(star.store, star.offer, star.run_log)


@_query("meta_countries", STAR_SQL + """select code, country_name from country where country_id in (select country_id from product where product_id in (select product_id from offer where in_stock))""")
def _(star):
    sold = star.product.join(star.offer.where("in_stock"), "product_id", "left_semi")
    return star.country.join(sold, "country_id", "left_semi").select("code", "country_name")


# Ingest

_WRITES_SQL = """with w as (
  select concat(cast(l_partkey as varchar), '-', cast(l_suppkey as varchar)) as offer_id, cast(l_shipdate as date) as captured_on, l_orderkey, l_linenumber, l_extendedprice, l_quantity
  from lineitem)
select offer_id, captured_on, l_extendedprice as price from (
  select *, row_number() over (partition by offer_id, captured_on order by l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_quantity desc) as rn from w) where rn = 1"""


@_query("dedup_daily", _WRITES_SQL)
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("offer_id"), F.col("l_shipdate").cast("date").alias("captured_on"),
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
    )
    written = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    newest = last_write_wins(rows.select("offer_id", "captured_on", F.col("l_extendedprice").alias("price"), written.alias("written")), ["offer_id", "captured_on"], "written")
    return newest.drop("written")


@_query("fill_missing", STAR_SQL + """, given as (select product_id, arg_min(slug, offer_id) as brand, arg_min(offer_id, offer_id) as type from offer join store using (store_id) group by product_id)
select p.product_id, name, coalesce(p.brand, g.brand) as brand, coalesce(p.type, g.type) as type from product p left join given g using (product_id)""")
def _(star):
    given = star.offer.join(star.store, "store_id").select("product_id", "offer_id", F.col("slug").alias("brand"), F.col("offer_id").alias("type"))
    return ingest.fill_missing(star.product.select("product_id", "name", "brand", "type"), given, ["brand", "type"], "offer_id")


@_query("oos_sweep", STAR_SQL + f""", day as (select * from snapshot where captured_on between date '2001-03-01' and date '{TODAY}')
select store_id, offer_id as sku, case when store_id = 0 then in_stock when store_id < 3 then in_stock and offer_id in (select offer_id from day)
  else in_stock and not (product_id % 10 = 0) end as in_stock from offer""")
def _(star):
    sku = F.col("offer_id").alias("sku")
    stored = star.offer.select("store_id", sku, "in_stock")
    seen = between(star, F.lit("2001-03-01").cast("date"), F.lit(TODAY).cast("date")).select("store_id", sku)
    gone = star.offer.where("product_id % 10 = 0 and store_id >= 3").select("store_id", sku)
    verdicts = star.store.where("store_id > 0").select("store_id", (F.col("store_id") < 3).alias("complete"))
    return ingest.sweep(stored, seen, gone, verdicts)


@_query("diff_snapshots", STAR_SQL + f""", a as (select offer_id as sku, max(price) as price, bool_or(promo) as promo from snapshot where captured_on < date '1997-01-01' group by 1),
b as (select offer_id as sku, max(price) as price, bool_or(promo) as promo from snapshot where captured_on >= date '1997-01-01' group by 1)
select count(*) filter (where a.sku is not null and b.sku is not null) as shared, count(*) filter (where b.sku is null) as only_left, count(*) filter (where a.sku is null) as only_right,
  count(*) filter (where a.sku is not null and b.sku is not null and a.price is distinct from b.price) as differ_price,
  count(*) filter (where a.sku is not null and b.sku is not null and a.promo is distinct from b.promo) as differ_promo from a full join b on a.sku = b.sku""")
def _(star):
    half = lambda test: star.snapshot.where(test).groupBy(F.col("offer_id").alias("sku")).agg(F.max("price").alias("price"), F.bool_or("promo").alias("promo"))
    return ingest.diff_snapshots(half("captured_on < date '1997-01-01'"), half("captured_on >= date '1997-01-01'"), ["price", "promo"])


@_query("null_census", STAR_SQL + """select slug, count(*) as n, count(*) filter (where brand is null) as null_brand, count(*) filter (where type is null) as null_type,
  count(*) filter (where country_id is null) as null_country_id from offer join product using (product_id) join store using (store_id) group by slug""")
def _(star):
    return ingest.null_census(star.offer.join(star.product, "product_id").join(star.store, "store_id"), ["brand", "type", "country_id"], "slug")


@_query("listing_verdict", STAR_SQL + """, l as (select store_id, captured_on, count(*) as received, case when day(captured_on) % 3 = 0 then null else 4 end as stated,
  case when day(captured_on) % 7 = 0 then 'blocked' else 'exhausted' end as stop from snapshot group by store_id, captured_on)
select *, case when stop <> 'exhausted' then 'incomplete' when stated is null then 'exhausted' when received < stated then 'short' else 'counted' end as verdict from l""")
def _(star):
    day = F.day("captured_on")
    rows = star.snapshot.groupBy("store_id", "captured_on").agg(F.count("*").alias("received"))
    return ingest.listing_verdict(rows.withColumns({"stated": F.when(day % 3 != 0, 4), "stop": F.when(day % 7 == 0, "blocked").otherwise("exhausted")}))


@_query("enrich_candidates", STAR_SQL + "select product_id from product where brand is null or type is null or country_id is null or product_id % 50 = 0")
def _(star):
    never = F.col("product_id") % 50 == 0
    rows = star.product.select(
        "product_id", F.col("brand").alias("abv"), "volume_ml", "type", "country_id", F.when(~never, F.lit(1)).alias("classified_at"), F.lit(None).cast("int").alias("curated_at")
    )
    return ingest.needs_enrichment(rows).select("product_id")


@_query("vote_spelling", STAR_SQL + """, n as (select type as key, name, count(*) as n from product where type is not null group by 1, 2),
r as (select *, row_number() over (partition by key order by n desc, length(name) desc, name) as rn from n) select key, name, n as votes from r where rn = 1""")
def _(star):
    return ingest.vote_spelling(star.product.where("type is not null").select(F.col("type").alias("key"), "name"))


@_query("curation_dupes", STAR_SQL + """select product_id, count(*) as n, string_agg(distinct slug, ', ' order by slug) as stores from offer join store using (store_id) group by product_id having count(*) > 1""")
def _(star):
    rows = star.offer.join(star.store, "store_id").groupBy("product_id").agg(F.count("*").alias("n"), F.concat_ws(", ", F.array_sort(F.collect_set("slug"))).alias("stores"))
    return rows.where("n > 1")


_CANDIDATE_SQL = """, titled as (select o.*, name || ' ' || slug as name_orig from offer o join product using (product_id) join store using (store_id))
"""


def _titled(star: Star) -> DataFrame:
    return star.offer.join(star.product.select("product_id", "name"), "product_id").join(star.store, "store_id").withColumn("name_orig", F.concat_ws(" ", "name", "slug"))


@_query("flavor_candidates", STAR_SQL + _CANDIDATE_SQL + """select product_id, name_orig from (
  select *, row_number() over (partition by product_id order by length(name_orig) desc, last_seen desc, offer_id desc) as rn from titled where product_id % 3 = 0) where rn = 1""")
def _(star):
    never = F.when(F.col("product_id") % 3 != 0, F.lit(1))
    return curation.flavor_candidates(star.product.select("product_id", never.alias("classified_at"), F.lit(None).cast("int").alias("curated_at")), _titled(star))


@_query("name_candidates", STAR_SQL + _CANDIDATE_SQL + """, r as (select product_id, name_orig from (select *, row_number() over (partition by product_id order by last_seen desc, offer_id desc) as rn from titled) where rn = 1)
select p.product_id, r.name_orig, r.name_orig is not null as carried from product p left join r using (product_id)""")
def _(star):
    return curation.name_candidates(star.product.select("product_id"), _titled(star))


_BRANDS_SQL = """, brands as (select name from product where product_id % 3 = 0 union select split_part(name, ' ', 1) from product where product_id % 7 = 0),
idx as (select lower(name) as key, min(name) as brand from brands group by 1),
found as (select product_id, idx.brand, row_number() over (partition by product_id order by length(key) desc, key desc) as rn
  from product p join idx on contains(' ' || lower(p.name) || ' ', ' ' || key || ' '))
"""


def _brands(star: Star) -> DataFrame:
    """Whole names of some products and first words of others, as a table of brands."""
    return star.product.where("product_id % 3 = 0").select("name").union(star.product.where("product_id % 7 = 0").select(F.split("name", " ")[0])).distinct()


@_query("fn_brand_from_name", STAR_SQL + _BRANDS_SQL + "select product_id, f.brand as found_brand from product left join (select product_id, brand from found where rn = 1) f using (product_id)")
def _(star):
    return curation.brand_from_name(star.product.select("product_id", "name"), curation.brand_index(_brands(star))).select("product_id", "found_brand")


@_query("brand_facts", STAR_SQL + _BRANDS_SQL + """select product_id, 'C' || length(f.brand) as country, case when f.brand like '% %' then 'single malt' end as type
from product left join (select product_id, brand from found where rn = 1) f using (product_id)""")
def _(star):
    info = _brands(star).select(F.col("name").alias("brand"), F.concat(F.lit("C"), F.length("name").cast("string")).alias("country"), F.when(F.contains("name", F.lit(" ")), "single malt").alias("type"))
    items = curation.brand_facts(star.product.select("product_id", "name", F.lit(None).cast("string").alias("brand")), info)
    return items.select("product_id", F.col("brand_country").alias("country"), F.col("brand_type").alias("type"))


# Writes

@_query("upsert_snapshots", STAR_SQL + """select offer_id, captured_on, case when captured_on >= date '1997-01-01' then price + 1 else price end as price,
  case when captured_on < date '1998-01-01' then 1 else 2 end as created_at from snapshot""")
def _(star):
    rows = star.snapshot.select("offer_id", "captured_on", "price")
    late = rows.where("captured_on >= date '1997-01-01'")
    stored = rows.where("captured_on < date '1998-01-01'").withColumns({"created_at": F.lit(1), "written_at": F.lit(1)})
    incoming = late.withColumn("price", F.col("price") + 1).withColumns({"created_at": F.lit(3), "written_at": F.lit(2)}).unionByName(late.withColumns({"created_at": F.lit(2), "written_at": F.lit(0)}))
    return ingest.upsert_snapshots(stored, incoming).select("offer_id", "captured_on", "price", "created_at")


def _stored_offers(star: Star) -> DataFrame:
    return star.offer.where("product_id % 2 = 0").select("store_id", F.col("offer_id").alias("sku"), "product_id", F.lit("u").alias("url"), F.lit("n").alias("name_orig"), "in_stock", "first_seen", "last_seen")


@_query("upsert_offers", STAR_SQL + f"""select store_id, offer_id as sku, case when product_id % 2 = 0 then product_id else product_id + 1 end as product_id, case when product_id % 3 = 0 then 'v' else 'u' end as url,
  product_id % 3 = 0 or in_stock as in_stock, case when product_id % 2 = 0 then first_seen else date '{TODAY}' end as first_seen, case when product_id % 3 = 0 then date '{TODAY}' else last_seen end as last_seen
from offer where product_id % 2 = 0 or product_id % 3 = 0""")
def _(star):
    seen = star.offer.where("product_id % 3 = 0").select("store_id", F.col("offer_id").alias("sku"), (F.col("product_id") + 1).alias("product_id"), F.lit("v").alias("url"), F.lit("m").alias("name_orig"), F.lit(True).alias("in_stock"))
    return ingest.upsert_offers(_stored_offers(star), seen, F.lit(TODAY).cast("date")).select("store_id", "sku", "product_id", "url", "in_stock", "first_seen", "last_seen")


@_query("touch_offers", STAR_SQL + f"""select offer_id as sku, product_id, case when product_id % 3 = 0 then 'v' else 'u' end as url, case when product_id % 3 = 0 then 'm' else 'n' end as name_orig,
  product_id % 3 = 0 or in_stock as in_stock, case when product_id % 3 = 0 then date '{TODAY}' else last_seen end as last_seen from offer where product_id % 2 = 0""")
def _(star):
    seen = star.offer.where("product_id % 3 = 0").select("store_id", F.col("offer_id").alias("sku"), F.lit("v").alias("url"), F.lit("m").alias("name_orig"))
    return ingest.touch_offers(_stored_offers(star), seen, F.lit(TODAY).cast("date")).select("sku", "product_id", "url", "name_orig", "in_stock", "last_seen")


@_query("find_or_create", STAR_SQL + """select name as match_key, case when min(product_id) % 2 = 0 then min(product_id)::varchar else md5(name) end as product_id, min(product_id) % 2 <> 0 as is_new from product group by name""")
def _(star):
    known = star.product.groupBy(F.col("name").alias("match_key")).agg(F.min("product_id").alias("product_id")).where("product_id % 2 = 0").select("match_key", F.col("product_id").cast("string").alias("product_id"))
    return ingest.find_or_create(known, star.product.select(F.col("name").alias("match_key")))


@_query("keyword_flavors", STAR_SQL + "select product_id, flavor, case when product_id % 2 = 0 then 'manual' else 'scrape' end as source from product_flavor where product_id % 2 = 0 or product_id % 5 <> 0")
def _(star):
    stored = star.product_flavor.where("product_id % 2 = 0").withColumn("source", F.lit("manual"))
    return ingest.add_keyword_flavors(stored, star.product_flavor, star.product.where("product_id % 5 = 0"))


_LINKS_SQL = """, links as (select product_id, flavor, case product_id % 3 when 0 then 'llm' when 1 then 'scrape' else 'manual' end as source from product_flavor),
named as (select product_id, arg_min(flavor, flavor) as flavor from product_flavor where product_id % 2 = 0 and product_id % 5 <> 0 group by product_id)
"""


@_query("model_flavors", STAR_SQL + _LINKS_SQL + """select l.product_id, l.flavor, case when n.flavor is not null and source <> 'manual' then 'llm' else source end as source from links l left join named n on n.product_id = l.product_id and n.flavor = l.flavor
where n.flavor is not null or source <> 'llm' or l.product_id % 2 <> 0 or l.product_id % 5 = 0""")
def _(star):
    key = F.col("product_id") % 3
    stored = star.product_flavor.withColumn("source", F.when(key == 0, "llm").when(key == 1, "scrape").otherwise("manual"))
    answers = star.product_flavor.where("product_id % 2 = 0").groupBy("product_id").agg(F.min("flavor").alias("flavor"))
    return ingest.replace_llm_flavors(stored, answers, star.product.where("product_id % 5 = 0"))


@_query("reconcile_links", STAR_SQL + "select product_id, flavor, case when product_id % 3 = 0 then 'add' else 'remove' end as action from product_flavor where (product_id % 2 = 0) <> (product_id % 3 = 0)")
def _(star):
    return curation.reconcile(star.product_flavor.where("product_id % 2 = 0"), star.product_flavor.where("product_id % 3 = 0"), ["product_id", "flavor"])


@_query("merge_products", STAR_SQL + "select distinct case when product_id % 10 = 3 then product_id - 1 else product_id end as product_id, flavor from product_flavor")
def _(star):
    merges = star.product.where("product_id % 10 = 3").select(F.col("product_id").alias("from_id"), (F.col("product_id") - 1).alias("into_id"))
    return curation.merge_products(star.product_flavor, merges)


@_query("get_or_create", STAR_SQL + """, t as (select distinct type from product where type is not null)
select type as name from t where type like 'S%' union all select upper(type) from t where type not like 'S%'""")
def _(star):
    types = star.product.where("type is not null").select(F.col("type").alias("name")).distinct()
    stored = types.where("name like 'S%'").select(F.md5("name").alias("id"), "name")
    wanted = types.select(F.concat(F.lit(" "), F.lower("name"), F.lit(" ")).alias("name")).union(types.select(F.upper("name")))
    return curation.get_or_create(stored, wanted).select("name")


@_query("stock_alerts", STAR_SQL + """, left_ as (select * from offer where in_stock and (store_id > 1 or product_id % 3 = 0))
select store_id, was, coalesce(l.n, 0) as left from (select store_id, count(*) as was from offer where in_stock group by 1) left join (select store_id, count(*) as n from left_ group by 1) l using (store_id) where coalesce(l.n, 0) < was * 0.5""")
def _(star):
    after = star.offer.withColumn("in_stock", F.col("in_stock") & ((F.col("store_id") > 1) | (F.col("product_id") % 3 == 0)))
    return ingest.stock_alerts(star.offer, after)


@_query("run_outcomes", STAR_SQL + """select run_id, added, removed, updated - added as updated, updated as total, success, case when not success then 'listing not complete (blocked): ' || updated || ' of '
  || coalesce(case when run_id % 2 = 0 then added::varchar end, 'an unknown number of') || ' items; stock was not swept' end as error from run_log where success is not null""")
def _(star):
    done = star.run_log.where("success is not null").select(
        "run_id", F.col("run_id").alias("store_id"), "added", "removed", F.col("updated").alias("stored"), F.col("updated").alias("found"), F.when(F.col("run_id") % 2 == 0, F.col("added")).alias("stated"),
        F.lit("blocked").alias("stop"), F.col("success").alias("complete"),
    )
    return ingest.run_outcomes(done).withColumnRenamed("store_id", "run_id")


@_query("collapse_tags", STAR_SQL + """, n as (select name from product union select name || ' Malt' from product where product_id % 2 = 0 union select name || ' Malt Islay' from product where product_id % 3 = 0)
select name, case when name like '% Malt' then name[:-6] when name like '% Malt Islay' and name[:-7] in (select name from n) then name[:-12] else name end as collapsed from n""")
def _(star):
    names_ = star.product.select("product_id", "name")
    more = names_.where("product_id % 2 = 0").select(F.concat("name", F.lit(" Malt"))).union(names_.where("product_id % 3 = 0").select(F.concat("name", F.lit(" Malt Islay"))))
    return curation.collapse_tags(names_.select("name").union(more))


@_query("spelling_votes", STAR_SQL + """, s as (select replace(name, ' ', '') as key, case store_id % 3 when 0 then name when 1 then upper(name) else 'the ' || name end as name from offer join product using (product_id)),
c as (select key, name, count(*) as votes from s group by 1, 2), r as (select *, row_number() over (partition by key order by votes desc, length(name) desc, name) as rn from c) select key, name, votes from r where rn = 1""")
def _(star):
    rows = star.offer.join(star.product.select("product_id", "name"), "product_id")
    spelled = F.when(F.col("store_id") % 3 == 0, F.col("name")).when(F.col("store_id") % 3 == 1, F.upper("name")).otherwise(F.concat(F.lit("the "), F.col("name")))
    return ingest.vote_spelling(curation.spelling_votes(rows.select(spelled.alias("name"))))


@_query("answer_tally", STAR_SQL + """select count(*) filter (where store_id = 0) as high, count(*) filter (where store_id = 1) as low, count(*) filter (where store_id = 2) as unknown,
  count(*) filter (where store_id > 2) as unanswered, count(*) filter (where product_id % 3 = 0) as tagged from offer""")
def _(star):
    confidence = F.when(F.col("store_id") == 0, "high").when(F.col("store_id") == 1, "low").when(F.col("store_id") == 2, "odd")
    tags = F.when(F.col("product_id") % 3 == 0, F.array(F.lit("oak"))).otherwise(F.array().cast("array<string>"))
    return curation.outcome_tally(star.offer.select(confidence.alias("confidence"), tags.alias("tags")))


@_query("preference_bundle", STAR_SQL + """, liked as (select store_id::varchar as user_id, offer_id, last_seen from offer where product_id % 50 = 0)
select user_id, string_agg(offer_id, ',' order by last_seen desc, offer_id desc) as favorites, count(*) as n, 0::bigint as blacklisted from liked group by user_id""")
def _(star):
    liked = star.offer.where("product_id % 50 = 0").select(F.col("store_id").cast("string").alias("user_id"), F.col("offer_id").alias("target_id"), F.col("last_seen").cast("timestamp").alias("created_at"))
    rows = preferences.bundle(liked, liked, liked.limit(0), liked.limit(0))
    return rows.select("user_id", F.concat_ws(",", "favorites").alias("favorites"), F.size("favorites").cast("long").alias("n"), F.size(F.array_union("blacklist_products", "blacklist_brands")).cast("long").alias("blacklisted"))


@_query("meta_values", STAR_SQL + """select 'store' as kind, slug as key, store_name as label from store union select 'type', type, type from product where type is not null union select 'flavor', flavor, flavor from product_flavor
union select 'country', code, country_name from country where country_id in (select country_id from product where product_id in (select product_id from offer where in_stock)) union select 'any_country', code, country_name from country""")
def _(star):
    return runs.meta(star.store, star.country, star.product, star.offer, star.product_flavor)


@_query("rep_sorted_page", _CURRENT_SQL + """, g as (select *, row_number() over (partition by product_id order by price, store_name, offer_id) as rn from stocked)
select offer_id as group_id, country, age from g where rn = 1 order by lower(country) desc nulls last, group_id limit 100""")
def _(star):
    return reports.page(reports.catalog(_stocked(star)), "catalog", number=1, size=100, sort="country", descending=True).select("group_id", "country", "age")


# Pages and text functions

_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&nbsp;": "\u00a0", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&euro;": "€"}


def _plain_sql(text: str) -> str:
    """Character references that the pages have; the ampersand last, as it begins others."""
    for name, char in reversed(_ENTITIES.items()):
        text = f"replace({text}, '{name}', '{char}')"
    return text


@_query("html_pages", r"""with bare as (select page_id, regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>', '</z>', 'gis') as h from pages),
parts as (select page_id, h, list_transform(regexp_split_to_array(h, '</?[A-Za-z][^>]*>'), lambda t: PLAIN) as texts from bare)
select page_id, nullif(trim(TITLE), '') as title,
  length(array_to_string(list_transform(texts, lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), ''))::int as n_stripped, md5(trim(regexp_replace(array_to_string(texts, ' '), '\s+', ' ', 'g'))) as rich_md5,
  length(trim(regexp_replace(array_to_string(texts, ' '), '\s+', ' ', 'g')))::int as n_rich, len(regexp_extract_all(h, '<a\s[^>]*href'))::bigint as links, 0::int as n_attributes from parts"""
        .replace("PLAIN", _plain_sql("t")).replace("TITLE", _plain_sql("regexp_extract(h, '<title>(.*?)</title>', 1, 's')")))
def _(spark, sf_dir):
    pages = html.page_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "title", "links", F.length("stripped").alias("n_stripped"), F.length("rich").alias("n_rich"), F.md5("rich").alias("rich_md5"), F.size("attributes").alias("n_attributes"))


@_query("html_cards", r"""with bare as (select page_id, regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>', '</z>', 'gis') as h from pages),
cards as (select page_id, unnest(regexp_extract_all(h, '<li>.*?</li>', 0, 's')) as card, generate_subscripts(regexp_extract_all(h, '<li>.*?</li>', 0, 's'), 1) - 1 as position from bare)
select page_id, PLAIN1 as sku, PLAIN2 as name, position::int as position from cards where regexp_extract(card, 'href="([^"]*)"', 1) <> '' and regexp_extract(card, '<a [^>]*>([^<]*)</a>', 1) <> ''"""
        .replace("PLAIN1", _plain_sql("""regexp_extract(card, 'href="([^"]*)"', 1)""")).replace("PLAIN2", _plain_sql("regexp_extract(card, '<a [^>]*>([^<]*)</a>', 1)")))
def _(spark, sf_dir):
    # The navigation's entries as cards: the pages have no other list.
    spec = html.CardSpec("li", "a", sku_attr="href")
    return html.cards(spark.read.parquet(f"{sf_dir}/pages.parquet"), spec).select("page_id", "sku", "name", "position")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("fn_parse_price", r"""with f as (select doc_id, regexp_replace(nullif(regexp_extract(text, '[0-9][0-9\s\x{00A0}\x{2009}\x{202F}]*(?:[.,][0-9]{1,2})?', 0), ''), '[\s\x{00A0}\x{2009}\x{202F}]', '', 'g') as raw from documents)
select doc_id, try_cast(case when contains(raw, ',') and not contains(raw, '.') then replace(raw, ',', '.') else replace(raw, ',', '') end as double) as price from f""")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.parse_price(F.col("text")).alias("price"))


def _any_sql(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@_query("fn_type", "select doc_id, case " + " ".join(f"when {_any_sql('low', w)} then '{t}'" for t, w in text.vocab.TYPE_KEYWORDS.items())
        + " end as type from (select doc_id, ' ' || lower(text) || ' ' as low from documents)")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.product_type(F.col("text")).alias("type"))


@_query("fn_country", "select doc_id, case " + " ".join(f"when {_any_sql('low', w)} then '{t}'" for t, w in text.vocab.COUNTRY_KEYWORDS.items()) + " end as country from (select doc_id, lower(text) as low from documents)")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.country(F.col("text")).alias("country"))


@_query("fn_tags", "select doc_id, concat_ws(',', " + ", ".join(f"case when {_any_sql('low', text.vocab.FLAVOR_KEYWORDS[t])} then '{t}' end" for t in sorted(text.vocab.FLAVOR_KEYWORDS)) + ") as tags from (select doc_id, lower(text) as low from documents)")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.concat_ws(",", text.flavor_tags(F.col("text"))).alias("tags"))


def _titles(star: Star) -> DataFrame:
    """Titles as stores write them: category, name, age, strength, volume and packaging."""
    words = (F.lit("Віскі"), F.initcap("name"), F.col("age").cast("string"), F.lit("років 40%"), (F.col("volume_ml") / 1000).cast("string"), F.lit("л, в коробці"))
    return star.product.select("product_id", F.initcap("name").alias("name"), F.concat_ws(" ", *words).alias("title"))


@_query("fn_clean_name", STAR_SQL + "select product_id, upper(name[1]) || lower(split_part(name, ' ', 1)[2:]) || ' ' || upper(split_part(name, ' ', 2)[1]) || lower(split_part(name, ' ', 2)[2:]) as clean from product")
def _(star):
    titles = _titles(star)
    return titles.join(names.cleaned_names(titles, "title"), F.col("title") == F.col("raw")).select("product_id", "clean")


@_query("fn_specs", STAR_SQL + "select product_id, volume_ml::int as volume, 40.0::double as abv, case when age between 1 and 60 then age end::int as age from product")
def _(star):
    name = F.concat_ws(" ", F.col("name"), F.col("age").cast("string"), F.lit("y.o."), (F.col("volume_ml") / 1000).cast("string"), F.lit("л 40%"))
    return star.product.select("product_id", text.volume_ml(name).alias("volume"), text.abv(name).alias("abv"), text.age_years(name).alias("age"))


@_query("fn_brand", STAR_SQL + """select product_id, upper(brand[1]) || replace(lower(brand[2:]), '#', '#') as brand from product""")
def _(star):
    return star.product.select("product_id", text.brand(F.col("brand")).alias("brand"))


@_query("fn_match_key", STAR_SQL + r"""select product_id, array_to_string(list_sort(list_distinct(list_concat(
    list_filter(regexp_split_to_array(trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 and w not in ('box', 'set', 'the', 'of', 'and', 'single', 'malt', 'gift')),
    list_filter([replace(trim(regexp_replace(lower(brand), '[^0-9a-z]+', ' ', 'g')), ' ', '')], lambda w: w is not null)))), '') || '|v' || volume_ml || '|a' || age as match_key from product""")
def _(star):
    return star.product.select("product_id", text.match_key(F.col("name"), F.col("brand"), F.col("volume_ml"), F.col("age")).alias("match_key"))
