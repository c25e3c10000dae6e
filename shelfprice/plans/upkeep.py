"""Queries of the catalogue's upkeep: merges, splits, keys, enrichment, edits, clamped ranges, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard as dash
from ..functions import text
from ..operators import curation, edits, enrichment, ingest, merging, offers, reports
from ..sources import html, items, paged, registry, sink
from ..sources.star import STAR_SQL, Star
from ..sources.stored import shared_folder, stored_star
from .catalogue import _CURRENT_SQL, _METRICS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = lambda spark, sf_dir: f(stored_star(spark, sf_dir)), sql
        return f

    return add


# Merges, splits, keys

_BOTTLES_SQL = STAR_SQL.replace("with store", "with recursive store", 1) + """, bottle as (
  select product_id, 'k' || product_id as match_key, case when product_id % 4 <> 1 then name end as name, case when product_id % 3 = 0 then 40.0 + age end::double as abv, age, brand, type, country_id,
    case when product_id % 2 = 0 then product_id % 100 end::int as classified_at from product),
link as (select product_id, flavor, case product_id % 3 when 0 then 'scrape' when 1 then 'llm' else 'manual' end as source from product_flavor)
"""
#: Chains of five merges, each into the bottling before it.
_WALK_SQL = """, edge as (select product_id as f, product_id - 1 as t from bottle where product_id % 7 between 2 and 6),
walk(f, goal, steps) as (select f, t, 1 from edge union all select w.f, e.t, w.steps + 1 from walk w join edge e on w.goal = e.f),
led as (
  select b.product_id, coalesce(r.goal, b.product_id) as root, coalesce(r.steps, 0) as steps
  from bottle b left join (select f, arg_max(goal, steps) as goal, max(steps) as steps from walk group by f) r on r.f = b.product_id)
"""


def _bottles(star: Star) -> merging.Catalogue:
    key = F.col("product_id")
    product = star.product.select(
        "product_id", F.concat(F.lit("k"), key.cast("string")).alias("match_key"), F.when(key % 4 != 1, F.col("name")).alias("name"), F.when(key % 3 == 0, F.lit(40.0) + F.col("age")).alias("abv"),
        "age", "brand", "type", "country_id", F.when(key % 2 == 0, (key % 100).cast("int")).alias("classified_at"),
    )
    links = star.product_flavor.withColumn("source", F.when(key % 3 == 0, "scrape").when(key % 3 == 1, "llm").otherwise("manual"))
    return merging.Catalogue(product, star.offer.select("offer_id", "product_id", "store_id"), links)


def _merged(star: Star) -> merging.Catalogue:
    edges = star.product.where("product_id % 7 between 2 and 6").select(F.col("product_id").alias("from_id"), (F.col("product_id") - 1).alias("into_id"))
    return merging.merge(_bottles(star), edges)


_FOLD = lambda c: f"arg_min({c}, (steps, product_id)) filter (where {c} is not null) as {c}"


@_query("curation_merge", _BOTTLES_SQL + _WALK_SQL + f""", folded as (
  select root, {', '.join(_FOLD(c) for c in merging.FILLED)}, max(classified_at) as classified_at from led join bottle using (product_id) group by root)
select root as product_id, b.match_key, f.name, f.abv, b.age, f.brand, f.type, f.country_id, f.classified_at from folded f join bottle b on b.product_id = root""")
def _(star):
    return _merged(star).product


@_query("curation_merge_links", _BOTTLES_SQL + _WALK_SQL + """select root as product_id, flavor,
  case when arg_min(source, (steps, product_id)) = 'scrape' and bool_or(source = 'llm') then 'llm' else arg_min(source, (steps, product_id)) end as source
from led join link using (product_id) group by root, flavor""")
def _(star):
    return _merged(star).links


@_query("curation_merge_offers", _BOTTLES_SQL + _WALK_SQL + "select offer_id, root as product_id from offer join led using (product_id)")
def _(star):
    return _merged(star).offer.select("offer_id", "product_id")


def _split(star: Star) -> merging.Catalogue:
    wrong = star.product.where("product_id % 50 = 7")
    new = (F.col("product_id") + 100_000_000).alias("new_id")
    splits = wrong.select(F.col("product_id").alias("from_id"), new, F.concat("name", F.lit(" Rye")).alias("name"), F.lit(43.0).alias("abv"))
    return merging.split(_bottles(star), splits, star.offer.where("product_id % 50 = 7 and store_id > 2").select("offer_id", new))


@_query("curation_split", _BOTTLES_SQL + """select product_id, match_key, name, abv, age, brand, classified_at, (select count(*) from link l where l.product_id = b.product_id) as n_links from bottle b
union all select b.product_id + 100000000, null, p.name || ' Rye', 43.0, b.age, b.brand, null, (select count(*) from link l where l.product_id = b.product_id) from bottle b join product p using (product_id) where product_id % 50 = 7""")
def _(star):
    out = _split(star)
    rows = out.product.join(out.links.groupBy("product_id").agg(F.count("*").alias("n_links")), "product_id", "left")
    return rows.select("product_id", "match_key", "name", "abv", "age", "brand", "classified_at", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@_query("curation_split_offers", STAR_SQL + "select offer_id, product_id + case when product_id % 50 = 7 and store_id > 2 then 100000000 else 0 end as product_id from offer")
def _(star):
    return _split(star).offer.select("offer_id", "product_id")


@_query("curation_move", STAR_SQL + "select offer_id, case when store_id = 1 and product_id % 9 = 0 and product_id > 0 then product_id - 1 else product_id end as product_id from offer")
def _(star):
    moves = star.offer.where("store_id = 1 and product_id % 9 = 0 and product_id > 0").select("offer_id", (F.col("product_id") - 1).alias("product_id"))
    return merging.move_offers(star.offer, star.product, moves).select("offer_id", "product_id")


@_query("curation_rekey", _BOTTLES_SQL + "select product_id, case product_id % 20 when 0 then 'moved ' || product_id when 10 then null else match_key end as match_key from bottle")
def _(star):
    keys = star.product.where("product_id % 10 = 0").select("product_id", F.when(F.col("product_id") % 20 == 0, F.concat(F.lit("moved "), F.col("product_id").cast("string"))).alias("match_key"))
    return merging.rekey(_bottles(star).product, keys).select("product_id", "match_key")


# Enrichment

_ITEMS_SQL = STAR_SQL + """, item as (
  select store_id, offer_id as sku, case when product_id % 9 <> 0 then 'k' || (product_id // 2) end as match_key, in_stock, product_id as place, case when store_id % 2 = 0 then 40.0 end as abv,
    case when product_id % 3 <> 0 then volume_ml end as volume_ml, case when store_id > 2 then type end as type, case when store_id = 1 then country_id end as country_id, product_id % 4 = 0 as known
  from offer join product using (product_id)),
kept as (
  select 'k' || product_id as match_key, case when product_id % 6 <> 0 then 40.0 end as abv, case when product_id % 8 <> 0 then volume_ml end as volume_ml, type, country_id,
    case when product_id % 2 = 0 then 1 end as classified_at, case when product_id % 10 = 1 then 1 end as curated_at from product where product_id % 5 <> 0)
"""


def _plan_sql(backfill: bool) -> str:
    more = "or (i.type is null and k.type is null) or (i.country_id is null and k.country_id is null)" if backfill else ""
    return _ITEMS_SQL + f""", asked as (
  select store_id, sku, i.match_key, place, known, k.match_key is null or k.abv is null or k.volume_ml is null or k.type is null or k.country_id is null or (classified_at is null and curated_at is null) as ask_detail,
    (i.abv is null and k.abv is null) or (i.volume_ml is null and k.volume_ml is null) {more} as ask_fields, not known and k.match_key is null as ask_name, classified_at is null and curated_at is null as ask_flavors
  from item i left join kept k on i.match_key = k.match_key where in_stock and {'true' if backfill else 'not known'}),
plan as (
  select *, case when ask_flavors then case when match_key is null then sku else first_value(sku) over (partition by match_key, ask_flavors order by place, store_id, sku) end end as head_sku
  from asked where ask_detail or ask_fields or ask_name or ask_flavors)
"""


def _plan(star: Star, backfill: bool) -> DataFrame:
    key, rows = F.col("product_id"), star.offer.join(star.product, "product_id")
    items = rows.select(
        "store_id", F.col("offer_id").alias("sku"), F.when(key % 9 != 0, F.concat(F.lit("k"), F.floor(key / 2).cast("string"))).alias("match_key"), "in_stock", key.alias("place"),
        F.when(F.col("store_id") % 2 == 0, 40.0).alias("abv"), F.when(key % 3 != 0, F.col("volume_ml")).alias("volume_ml"), F.when(F.col("store_id") > 2, F.col("type")).alias("type"),
        F.when(F.col("store_id") == 1, F.col("country_id")).alias("country_id"),
    )
    stored = star.product.where("product_id % 5 <> 0").select(
        F.concat(F.lit("k"), key.cast("string")).alias("match_key"), F.when(key % 6 != 0, 40.0).alias("abv"), F.when(key % 8 != 0, F.col("volume_ml")).alias("volume_ml"), "type", "country_id",
        F.when(key % 2 == 0, 1).alias("classified_at"), F.when(key % 10 == 1, 1).alias("curated_at"),
    )
    known = star.offer.where("product_id % 4 = 0").select("store_id", F.col("offer_id").alias("sku"))
    return enrichment.enrichment_plan(items, known, stored, backfill=backfill)


_PLAN = ["store_id", "sku", "match_key", "known", "ask_detail", "ask_fields", "ask_name", "ask_flavors", "head_sku"]
_query("enrich_plan", _plan_sql(False) + f"select {', '.join(_PLAN)} from plan")(lambda star: _plan(star, False).select(*_PLAN))
_query("enrich_plan_backfill", _plan_sql(True) + f"select {', '.join(_PLAN)} from plan")(lambda star: _plan(star, True).select(*_PLAN))


@_query("enrich_fan_out", _plan_sql(True) + "select store_id, sku, case when head_sku not like '%7-%' then 'from ' || head_sku end as tags from plan where ask_flavors")
def _(star):
    plan = _plan(star, True)
    answers = enrichment.heads(plan).where("sku not like '%7-%'").select("store_id", "sku", F.concat(F.lit("from "), F.col("sku")).alias("tags"))
    return enrichment.fan_out(plan, answers).select("store_id", "sku", "tags")


@_query("fill_census", STAR_SQL + """, joined as (
  select slug, brand, type, country_id, case when store_id % 2 = 0 then slug end as new_brand, case when product_id % 3 = 0 then slug end as new_type, case when product_id % 4 = 0 then 1 end as new_country_id
  from offer join product using (product_id) join store using (store_id)),
long as (select slug, 'brand' as field, brand is null as missing, new_brand is not null as given from joined union all select slug, 'type', type is null, new_type is not null from joined
  union all select slug, 'country_id', country_id is null, new_country_id is not null from joined)
select slug, field, count(*) as n, count(*) filter (where missing) as nulls, count(*) filter (where missing and given) as fillable from long group by slug, field""")
def _(star):
    rows = star.offer.join(star.product, "product_id").join(star.store, "store_id").withColumn("sku", F.col("offer_id"))
    new = lambda test, value: F.when(F.expr(test), value)
    incoming = rows.select(
        "store_id", "sku", F.lit(1).alias("place"), new("store_id % 2 = 0", F.col("slug")).alias("brand"), new("product_id % 3 = 0", F.col("slug")).alias("type"), new("product_id % 4 = 0", F.lit(1)).alias("country_id")
    )
    earlier = incoming.select("store_id", "sku", F.lit(0).alias("place"), F.lit("x").alias("brand"), F.lit("x").alias("type"), F.lit(2).alias("country_id"))
    return enrichment.fill_census(rows, incoming.unionByName(earlier), ["brand", "type", "country_id"], "slug")


# Edits

def _edited(star: Star) -> tuple[DataFrame, DataFrame]:
    schema = "id string, given array<string>, name string, age int, country string, type string, flavors array<string>, seq int, abv double, volume_ml int"
    some = lambda rows, key, given, seq, **values: rows.select(
        F.col(key).cast("string").alias("id"), F.array(*map(F.lit, given)).alias("given"), *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("name", "string"), ("age", "int"), ("country", "string"), ("type", "string"), ("flavors", "array<string>"))],
        F.lit(seq).alias("seq"), F.lit(None).cast("double").alias("abv"), F.lit(None).cast("int").alias("volume_ml"),
    )
    first = some(star.product.where("product_id % 40 = 3"), "product_id", ["name", "country", "age"], 1, name=F.lit("Edited"), country=F.lit("nation_5"))
    again = some(star.product.where("product_id % 80 = 3"), "product_id", ["name"], 2, name=F.lit("Again"))
    by_offer = some(star.offer.where("product_id % 40 = 9 and store_id = 0"), "offer_id", ["type", "flavors"], 1, type=F.lit(""), flavors=F.array(F.lit("red"), F.lit(" ring "), F.lit("red")))
    wanted = first.unionByName(again).unionByName(by_offer)
    assert wanted.columns == [f.split()[0] for f in schema.split(", ")]
    product = star.product.withColumn("curated_at", F.lit(None).cast("int"))
    links = star.product_flavor.withColumn("source", F.lit("scrape"))
    return edits.edit_products(product, star.offer, links, star.country, star.product.select("type"), star.product_flavor.select("flavor"), wanted, F.lit(7))


_CHOSEN = "product_id % 40 = 9 and product_id in (select product_id from offer where store_id = 0)"


@_query("edit_products", STAR_SQL + f"""select product_id, case when product_id % 80 = 3 then 'Again' when product_id % 40 = 3 then 'Edited' else name end as name, case when product_id % 40 <> 3 then age end as age,
  case when {_CHOSEN} then null else type end as type, case when product_id % 40 = 3 then (select country_id from country where code = 'nation_5') else country_id end as country_id,
  case when {_CHOSEN} then 7 end as curated_at from product""")
def _(star):
    return _edited(star)[0].select("product_id", "name", "age", "type", "country_id", "curated_at")


@_query("edit_links", STAR_SQL + f"""select product_id, flavor, 'scrape' as source from product_flavor where not ({_CHOSEN})
union all select product_id, unnest(['red', 'ring']), 'manual' from product where {_CHOSEN}""")
def _(star):
    return _edited(star)[1]


@_query("link_actions", STAR_SQL + """, changed as (select flavor, product_id, case when product_id % 3 = 0 then 'add' else 'remove' end as action from product_flavor where (product_id % 2 = 0) <> (product_id % 3 = 0))
select flavor, string_agg(action || ':' || product_id, ',' order by action, product_id) as actions from changed group by flavor""")
def _(star):
    out = edits.link_actions(star.product_flavor.where("product_id % 2 = 0"), star.product_flavor.where("product_id % 3 = 0"), ["product_id", "flavor"], "flavor")
    spelled = F.transform("actions", lambda a: F.concat_ws(":", a["action"], a["product_id"].cast("string")))
    return out.select("flavor", F.array_join(spelled, ",").alias("actions"))


@_query("flavor_stamps", STAR_SQL + "select product_id, case when product_id % 3 = 0 then 5 when product_id % 2 = 0 then 1 end as classified_at, case when product_id % 5 = 0 then 6 end as curated_at from product")
def _(star):
    rows = star.product.select("product_id", F.when(F.col("product_id") % 2 == 0, 1).alias("classified_at"), F.lit(None).cast("int").alias("curated_at"))
    asked = ingest.stamped(rows, star.product_flavor.where("product_id % 3 = 0"), "classified_at", F.lit(5))
    return ingest.stamped(asked, star.product.where("product_id % 5 = 0"), "curated_at", F.lit(6))


# Ranges and pages

_ASKED = {"early": ("1991-06-01", "1992-03-31"), "late": ("1998-11-01", "2000-01-31"), "never": ("2005-01-01", "2005-02-01")}


@_query("dash_clamped", STAR_SQL + f""", bounds as (select min(captured_on) as low, max(captured_on) as high from snapshot),
asked(asked, a, b) as (values {', '.join(f"('{k}', date '{a}', date '{b}')" for k, (a, b) in _ASKED.items())}),
cut as (select asked, low is null or greatest(a, low) > least(b, high) as empty, case when low is null or greatest(a, low) > least(b, high) then a else greatest(a, low) end as first,
  case when low is null or greatest(a, low) > least(b, high) then b else least(b, high) end as last from asked, bounds),
listing as (select s.*, brand from snapshot s join product using (product_id)),
days as (select asked, captured_on, {_METRICS} from listing join cut on not empty and captured_on between first and last group by asked, captured_on)
select c.*, d.captured_on, in_stock, products, brands, stores, promo, p25, median, p75 from cut c left join days d on c.asked = d.asked""")
def _(star):
    parts = [dash.daily_in_range(star, a, b).select(F.lit(k).alias("asked"), "*") for k, (a, b) in _ASKED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("dash_meta", STAR_SQL + """, o as (select store_id, count(*) as listings, count(*) filter (where in_stock) as in_stock from offer group by store_id),
s as (select store_id, min(captured_on) as first_day, max(captured_on) as last_day from snapshot group by store_id),
b as (select min(captured_on) as floor, max(captured_on) as latest, count(distinct captured_on) as day_count from snapshot)
select slug, coalesce(listings, 0) as listings, coalesce(in_stock, 0) as in_stock, first_day, last_day, floor, latest, day_count from store left join o using (store_id) left join s using (store_id), b""")
def _(star):
    return dash.meta(star)


@_query("rep_page_total", _CURRENT_SQL + """, g as (select arg_min(offer_id, (price, store_name, offer_id)) as group_id, any_value(name) as name, min(price) as price from stocked group by product_id),
t as (select count(*) as total from g), pages as (select group_id, name, price from g order by lower(name), price, group_id limit 50 offset 50)
select total, group_id, name from t left join pages on true union all select total, null, null from t""")
def _(star):
    groups = reports.catalog(offers.current_offers(star).where("in_stock"))
    # A group is a product, so this page is beyond the last however many there are; counting products reads file footers.
    beyond = star.product.count() // 50 + 2
    shown = reports.paged(groups, "catalog", number=2).unionByName(reports.paged(groups, "catalog", number=beyond))
    return shown.select("total", "group_id", "name")


# Sources and sinks

_PAGES_SQL = """with recursive item as (
  select (doc_id % 5)::varchar as store_id, (doc_id // 50 + 1)::int as page, doc_id, (row_number() over (partition by doc_id % 5, doc_id // 50 order by doc_id) - 1)::int as position,
    (length(coalesce(text, '')) % (20 + doc_id % 5 * 12))::varchar as sku from documents),
stood as (select store_id, sku, min((page, position)) as first from item group by store_id, sku),
landed as (select store_id, page, count(*) as n from item group by store_id, page),
news as (
  select l.store_id, l.page, l.n, (select count(*) from stood s where s.store_id = l.store_id and s.first[1] = l.page) as fresh from landed l),
ends as (
  select store_id, page, n, fresh, fresh = 0 and lag(fresh) over (partition by store_id order by page) = 0 as ended, lead(page) over (partition by store_id order by page) as next_page from news),
stops as (
  select store_id, min(page) filter (where ended) as ended_at, min(page) filter (where next_page is distinct from page + 1) as broken_at from ends group by store_id),
walked as (select store_id, least(coalesce(ended_at, 500), broken_at, 500)::int as pages,
  case when ended_at <= least(broken_at, 500) then 'exhausted' when broken_at < 500 then 'page_failed' else 'page_cap' end as stop from stops)
"""


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Documents as the items of five stores, ten a page, landed in the shared folder: the source reads folders."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sku = (F.length(F.coalesce("text", F.lit(""))) % (20 + F.col("doc_id") % 5 * 12)).cast("string")
    rows = docs.select((F.col("doc_id") % 5).cast("string").alias("store_id"), (F.floor(F.col("doc_id") / 50) + 1).cast("int").alias("page"), F.struct("doc_id", sku.alias("sku")).alias("item"))
    pages = rows.groupBy("store_id", "page").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["sku"]).alias("skus"))
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    paged.land_pages(pages.withColumns({"last_page": F.lit(None).cast("boolean"), "total_pages": F.lit(None).cast("int")}), path)
    return path


QUERIES["paged_items"] = lambda spark, sf_dir: paged.read_listing(spark, _landed(spark, sf_dir))
ORACLES["paged_items"] = _PAGES_SQL + """select s.store_id, s.first[1] as page, s.first[2] as position, s.sku from stood s join walked w using (store_id) where s.first[1] <= pages"""
QUERIES["paged_listings"] = lambda spark, sf_dir: paged.read_listing(spark, _landed(spark, sf_dir), rows="listings")
ORACLES["paged_listings"] = _PAGES_SQL + """select store_id, pages, sum(n)::int as received, null::int as stated, sum(fresh)::int as n_items, any_value(stop) as stop
from walked join ends using (store_id) where page <= pages group by store_id, pages"""


@_query("sink_batches", STAR_SQL + """select offer_id, captured_on, case when product_id % 10 = 0 and captured_on >= date '2000-01-01' then price + 1 else price end as price,
  case when product_id % 7 = 0 and captured_on >= date '2000-01-01' and product_id % 10 = 0 then 3 when product_id % 7 = 0 then null else 1 end as created_at
from snapshot where product_id % 7 <> 0 or (product_id % 10 = 0 and captured_on >= date '2000-01-01')""")
def _(star):
    folder = f"{shared_folder(star.snapshot.sparkSession)}/sink-{uuid.uuid4().hex}"
    put = lambda rows, name: sink.write_batch(rows.select("offer_id", "captured_on", "price", "created_at", "written_at"), f"{folder}/table", f"{folder}/work", name)
    put(star.snapshot.where("product_id % 7 <> 0").withColumns({"created_at": F.lit(1), "written_at": F.lit(1)}), "first")
    late = star.snapshot.where("product_id % 10 = 0 and captured_on >= date '2000-01-01'")
    for _ in range(2):  # the same batch comes twice
        put(late.withColumns({"price": F.col("price") + 1, "created_at": F.lit(3), "written_at": F.lit(2)}), "late")
    return sink.read_snapshots(star.snapshot.sparkSession, f"{folder}/table", "offer_id string, captured_on date, price double, created_at int, written_at int").drop("written_at")


_BODIES_SQL = STAR_SQL + """, item as (
  select offer_id as sku, name, 'u/' || offer_id as url, (product_id * 100 + 99) / 100.0::double as price, case when product_id % 3 = 0 then (product_id * 100 + 199) / 100.0::double end as old_price,
    case when product_id % 5 = 0 then false else true end as in_stock, product_id % 3 = 0 as promo, volume_ml::int as volume_ml, brand, case when product_id % 4 = 0 then 'ua' end as country, store_id, product_id
  from offer join product using (product_id))
"""


def _bodies(star: Star) -> DataFrame:
    """Offers as a chain's listing has them: prices in hundredths, an old price also where no discount is."""
    key, rows = F.col("product_id"), star.offer.join(star.product, "product_id")
    even = key % 2 == 0
    body = F.to_json(F.struct(
        F.when(even, F.col("offer_id")).otherwise("").alias("ean"), F.when(even, "other").otherwise(F.col("offer_id")).alias("sku"), F.col("name").alias("title"), (key * 100 + 99).alias("price"),
        F.struct((key % 3 == 0).alias("status"), (key * 100 + 199).alias("old_price")).alias("discount"), (F.col("volume_ml") + F.lit(0.5)).alias("volume"),
        F.struct(F.when(even, F.col("brand")).alias("trademark"), F.col("brand").alias("name")).alias("producer"), F.when(key % 4 == 0, "ua").alias("country"), F.concat(F.lit("u/"), "offer_id").alias("web_url"),
        F.when(key % 5 == 0, F.lit(False)).alias("in_stock"),
    ))
    return rows.select("store_id", "product_id", "offer_id", body.alias("body"))


@_query("src_json_items", _BODIES_SQL + "select sku, name, url, price, old_price, in_stock, promo, volume_ml, brand, country from item where product_id % 11 <> 0")
def _(star):
    # A body in eleven is cut off and gives no item.
    broken = F.when(F.col("product_id") % 11 == 0, F.substring("body", 1, 30)).otherwise(F.col("body"))
    return items.json_items(_bodies(star).select(broken.alias("body")))


@_query("src_registry", _BODIES_SQL + """select case when store_id % 2 = 0 then 'chain-' || store_id else 'shop-' || store_id end as slug, sku, case when store_id % 2 = 0 then name else trim(name) end as name, url, price,
  case when store_id % 2 = 0 or promo then old_price end as old_price, in_stock, promo from item""")
def _(star):
    rows = _bodies(star).join(star.product.select("product_id", "name"), "product_id")
    shop = F.col("store_id") % 2 == 1
    key, cents = F.col("product_id"), lambda c: F.format_string("%d,%02d", F.floor(c / 100), (c % 100).cast("int"))
    price, old = cents(key * 100 + 99), cents(key * 100 + 199)
    card = F.format_string(
        '<ul><li class="product%s%s" data-product_id="%s"><a href="u/%s"><h2> %s</h2></a><span class="price">%s</span></li></ul>', F.when(key % 5 == 0, " outofstock").otherwise(""),
        F.when(key % 3 == 0, " sale").otherwise(""), "offer_id", "offer_id", "name", F.when(key % 3 == 0, F.format_string("<del>%s</del><ins>%s</ins>", old, price)).otherwise(price),
    )
    slug = F.concat(F.when(shop, "shop-").otherwise("chain-"), F.col("store_id").cast("string"))
    landed = rows.select(slug.alias("slug"), F.lit(1).alias("page"), F.when(shop, card).otherwise(F.col("body")).alias("body"))
    own = {"shop-3": registry.card_reader(html.CardSpec("li", "a", link="a"))}
    specs = [registry.StoreSpec(f"chain-{i}", chain="c") for i in (0, 2, 4)] + [registry.StoreSpec(f"shop-{i}", base_url="b") for i in (1, 3)]
    return registry.Registry(special=own).read(landed, specs).drop("page")


@_query("first_in_listing", STAR_SQL + """, seen as (select store_id, product_id // 3 as sku, product_id % 7 as page, product_id as position, offer_id as name from offer)
select store_id, sku::varchar as sku, name from (select *, row_number() over (partition by store_id, sku order by page, position) as rn from seen) where rn = 1""")
def _(star):
    key = F.col("product_id")
    seen = star.offer.select("store_id", F.floor(key / 3).cast("string").alias("sku"), (key % 7).alias("page"), key.alias("position"), F.col("offer_id").alias("name"))
    return ingest.first_in_listing(seen).select("store_id", "sku", "name")


@_query("unmatched_items", STAR_SQL + "select store_id, offer_id as sku, md5('sku/' || store_id || '/' || offer_id) as product_id, true as is_new from offer where product_id % 6 = 0")
def _(star):
    wanted = star.offer.select("store_id", F.col("offer_id").alias("sku"), F.when(F.col("product_id") % 6 != 0, F.lit("k")).alias("match_key"))
    return ingest.unmatched(wanted)


@_query("bulk_duplicates", STAR_SQL + """, batch as (select name as name, product_id::varchar as code from product where product_id % 4 = 0 union all select 'new ' || product_id, product_id::varchar from product where product_id % 8 = 0),
kept as (select name, product_id::varchar as code from product where product_id % 20 = 0),
long as (select 'name' as field, name as value from batch union all select 'code', code from batch), old as (select 'name' as field, name as value from kept union all select 'code', code from kept)
select distinct field, value from (select field, value from long group by field, value having count(*) > 1 union all select l.field, l.value from long l join old o on l.field = o.field and l.value = o.value)""")
def _(star):
    rows = lambda test, name: star.product.where(test).select(name.alias("name"), F.col("product_id").cast("string").alias("code"))
    batch = rows("product_id % 4 = 0", F.col("name")).union(rows("product_id % 8 = 0", F.concat(F.lit("new "), F.col("product_id").cast("string"))))
    return curation.duplicates(rows("product_id % 20 = 0", F.col("name")), batch, ["name", "code"])


@_query("model_answers", STAR_SQL + """select product_id::varchar as id, case product_id % 3 when 0 then 'high' when 1 then 'low' else 'sure' end as confidence, case when product_id % 3 = 2 then '' when product_id % 2 = 0 then 'oak,smoky' else 'smoky' end as tags
from product where product_id % 5 <> 0""")
def _(star):
    key = F.col("product_id")
    one = F.struct(key.cast("string").alias("id"), F.when(key % 3 == 0, "HIGH").when(key % 3 == 1, "low").otherwise("sure").alias("confidence"),
                   F.when(key % 2 == 0, F.array(F.lit(" Smoky"), F.lit("oak"), F.lit("nothing known"))).otherwise(F.array(F.lit("smoky"))).alias("tags"))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.array(one)), F.lit("\n```"))
    bodies = star.product.select(F.when(key % 5 == 0, F.lit("I do not know.")).otherwise(fenced).alias("body"))
    return curation.model_answers(bodies).select("id", "confidence", F.concat_ws(",", "tags").alias("tags"))


@_query("fn_values", STAR_SQL + """select product_id, case when age between 1 and 60 then age end::int as age, case when volume_ml // 100 < 20 then (volume_ml // 100) * 1000 else volume_ml // 100 end::int as volume, (40 + age / 2.0)::double as abv from product""")
def _(star):
    return star.product.select(
        "product_id", text.age_value(F.col("age").cast("string")).alias("age"), text.volume_value(F.floor(F.col("volume_ml") / 100).cast("string")).alias("volume"),
        text.abv_value((F.lit(40) + F.col("age") / 2).cast("string")).alias("abv"),
    )
