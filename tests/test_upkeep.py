"""Enrichment, edits, ranges and guards on few rows, bad cases included."""

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfprice.operators import dashboard as dash
from shelfprice.operators import edits, enrichment, ingest, reports
from shelfprice.sources.star import Star

from .test_reports import SCHEMA as OFFER_SCHEMA
from shelfprice.plans import upkeep
from shelfprice.sources import stored
from .conftest import SF

ITEM = "store_id string, sku string, match_key string, in_stock boolean, place int, abv double, volume_ml int, type string, country_id int"
STORED = "match_key string, abv double, volume_ml int, type string, country_id int, classified_at int, curated_at int"


@pytest.fixture(scope="module")
def run(spark):
    items = [
        ("s", "new", "k1", True, 2, None, 700, None, None), ("s", "twin", "k1", True, 1, 40.0, 700, "malt", 1), ("s", "known", "k1", True, 3, None, None, None, None), ("s", "gone", "k9", False, 4, None, None, None, None),
        ("s", "full", "k2", True, 5, None, None, None, None), ("s", "lone", None, True, 6, None, 700, None, None), ("s", "alone", None, True, 7, 40.0, 700, None, None), ("s", "hand", "k3", True, 8, 40.0, 700, None, None),
    ]
    stored = [("k2", 40.0, 700, "malt", 1, 5, None), ("k3", 43.0, 500, None, 2, None, 6), (None, 1.0, 1, "x", 1, 1, 1)]
    known = spark.createDataFrame([("s", "known"), ("s", "known"), ("t", "new")], "store_id string, sku string")
    return lambda backfill: enrichment.enrichment_plan(spark.createDataFrame(items, ITEM), known, spark.createDataFrame(stored, STORED), backfill=backfill)


def asks(plan):
    return {r["sku"]: ("".join(a for a, c in zip("dfnt", enrichment.ASKS, strict=True) if r[c]), r["head_sku"]) for r in plan.collect()}


def test_a_run_asks_about_new_items(run):
    assert asks(run(False)) == {"new": ("dfnt", "twin"), "twin": ("dnt", "twin"), "lone": ("dfnt", "lone"), "alone": ("dnt", "alone"), "hand": ("d", None)}


def test_a_backfill_asks_about_all(run, spark):
    plan = run(True)
    assert asks(plan) == {
        "new": ("dfnt", "twin"), "twin": ("dnt", "twin"), "known": ("dft", "twin"), "lone": ("dfnt", "lone"), "alone": ("dfnt", "alone"), "hand": ("df", None)
    }
    assert sorted(r["sku"] for r in enrichment.heads(plan).collect()) == ["alone", "lone", "twin"]
    answers = spark.createDataFrame([("s", "twin", ["oak"], "high"), ("s", "lone", [], "low")], "store_id string, sku string, tags array<string>, confidence string")
    got = {r["sku"]: (r["tags"], r["confidence"]) for r in enrichment.fan_out(plan, answers).collect()}
    assert got == {"new": (["oak"], "high"), "twin": (["oak"], "high"), "known": (["oak"], "high"), "lone": ([], "low"), "alone": (None, None)}


def test_census_counts_what_can_be_filled(spark):
    schema = "store_id string, sku string, abv double, type string"
    stored = spark.createDataFrame([("s", "1", None, None), ("s", "2", None, "x"), ("s", "3", 1.0, None), ("t", "1", None, None)], schema)
    items = spark.createDataFrame([("s", "1", 40.0, None, 1), ("s", "1", None, "late", 2), ("s", "2", 40.0, "y", 1), ("u", "9", 1.0, "z", 1)], schema + ", place int")
    got = {(r["store_id"], r["field"]): (r["n"], r["nulls"], r["fillable"]) for r in enrichment.fill_census(stored, items, ["abv", "type"], "store_id").collect()}
    assert got == {("s", "abv"): (3, 2, 1), ("s", "type"): (3, 2, 1), ("t", "abv"): (1, 1, 0), ("t", "type"): (1, 1, 0)}


EDIT = "id string, given array<string>, name string, age int, abv double, volume_ml int, country string, type string, flavors array<string>, seq int"


@pytest.fixture(scope="module")
def edit(spark):
    product = spark.createDataFrame([("p", "P", 10, 40.0, 700, 1, "malt", None), ("q", "Q", 12, 43.0, 500, 2, "rye", 3)], "product_id string, name string, age int, abv double, volume_ml int, country_id int, type string, curated_at int")
    offer, links = spark.createDataFrame([("o1", "p"), ("o2", "q")], "offer_id string, product_id string"), spark.createDataFrame([("p", "oak", "scrape"), ("q", "oak", "llm")], "product_id string, flavor string, source string")
    lookups = (spark.createDataFrame([(1, "gb"), (2, "ua")], "country_id int, code string"), spark.createDataFrame([("malt",), ("rye",), ("rye",), (None,)], "type string"), spark.createDataFrame([("oak",), ("smoky",), ("smoky",)], "flavor string"))
    return lambda *r: edits.edit_products(product, offer, links, *lookups, spark.createDataFrame(list(r), EDIT), F.lit(9))


def change(i, seq=1, **values):
    return i, list(values), *[values.get(c) for c in ("name", "age", "abv", "volume_ml", "country", "type", "flavors")], seq


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edits(edit):
    product, links = edit(change("o1", name="New", age=None, country="ua"), change("p", 2, name="Newer", type="", flavors=[" smoky ", "smoky"]), change("q", flavors=[]))
    assert rows(product) == [("p", "Newer", None, 40.0, 700, 2, None, 9), ("q", "Q", 12, 43.0, 500, 2, "rye", 9)] and rows(links) == [("p", "smoky", "manual")]
    product, links = edit()
    assert rows(product) == [("p", "P", 10, 40.0, 700, 1, "malt", None), ("q", "Q", 12, 43.0, 500, 2, "rye", 3)] and len(rows(links)) == 2


@pytest.mark.parametrize(("bad", "said"), [
    (change("nobody", name="x"), "unknown product: nobody"), (change("p", country="xx"), "unknown country: xx"), (change("o1", type="gin"), "unknown type: gin"), (change("q", flavors=["oak", "tar"]), "unknown flavor: tar"),
])
def test_bad_edits_raise(edit, bad, said):
    product, links = edit(bad)
    with pytest.raises(PySparkException, match=said):
        product.collect(), links.collect()


def test_actions_by_group(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "role string, permission string")
    out = edits.link_actions(frame(("a", "x"), ("a", "y"), ("a", "y"), ("b", "x")), frame(("a", "z"), ("a", "y"), ("b", "x"), ("c", "x")), ["role", "permission"], "role")
    assert {r["role"]: [tuple(x) for x in r["actions"]] for r in out.collect()} == {"a": [("add", "z"), ("remove", "x")], "c": [("add", "x")]}


def small_star(spark, snapshot):
    snap = spark.createDataFrame(snapshot, "offer_id string, product_id string, store_id string, captured_on date, price double, promo boolean")
    product = spark.createDataFrame([("p", "P", "b", None, 1)], "product_id string, name string, brand string, type string, country_id int")
    return Star(spark.createDataFrame([("s", "s", "S")], "store_id string, slug string, store_name string"), spark.createDataFrame([(1, "gb", "GB")], "country_id int, code string, country_name string"), product, None, None, snap, None)


def test_ranges_are_clamped(spark):
    star = small_star(spark, [("o", "p", "s", date(2026, 7, d), 10.0 * d, False) for d in (3, 5, 9)])
    answer = lambda *asked: rows(dash.daily_in_range(star, *asked).select("first", "last", "empty", "captured_on", "median"))
    d = lambda n: date(2026, 7, n)
    assert answer("2026-06-01", "2026-07-05") == [(d(3), d(5), False, d(3), 30.0), (d(3), d(5), False, d(5), 50.0)]
    assert answer("2026-07-06", "2026-08-01") == [(d(6), d(9), False, d(9), 90.0)]
    assert answer("2026-07-10", "2026-08-01") == [(d(10), date(2026, 8, 1), True, None, None)] and answer("2026-06-01", "2026-06-02") == [(date(2026, 6, 1), date(2026, 6, 2), True, None, None)]
    assert answer("2026-07-06", "2026-07-08") == [(d(6), d(8), False, None, None)]
    star = small_star(spark, [])
    assert answer("2026-07-06", "2026-07-08") == [(d(6), d(8), True, None, None)]
    for bad in (("2026-07-05", "2026-07-01"), ("2020-01-01", "2026-07-01")):
        with pytest.raises(ValueError, match="range"):
            dash.daily_in_range(star, *bad)


def test_quartiles_of_odd_groups(spark):
    prices = [("a", None, True), ("a", None, False), ("b", 1.0, False), ("b", None, False), ("c", 1.0, True), ("c", 2.0, True), ("c", 2.0, False), ("c", 10.0, False)]
    out = dash.price_quartiles(spark.createDataFrame(prices, "k string, price double, promo boolean"), "k")
    assert rows(out.select("k", "in_stock", "promo", "p25", "median", "p75")) == [("a", 2, 1, None, None, None), ("b", 2, 0, 1.0, 1.0, 1.0), ("c", 4, 2, 1.75, 2.0, 4.0)]


def test_reports_of_nothing_are_empty(spark):
    none = spark.createDataFrame([], OFFER_SCHEMA)
    snapshot = spark.createDataFrame([], "offer_id string, captured_on date, price double")
    for groups in (reports.catalog(none), reports.drops(none, snapshot, "2026-07-21"), reports.lows(none, snapshot), reports.new_listings(none, "2026-07-21"), reports.best(none)):
        assert groups.count() == 0
        assert [tuple(r) for r in reports.paged(groups, "catalog").select("total", "group_id").collect()] == [(0, None)]


def test_first_writes_keep_their_time(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "offer_id string, captured_on date, price double, created_at int, written_at int")
    day = date(2026, 7, 1)
    out = ingest.upsert_snapshots(frame(("a", day, 1.0, 5, 9)), frame(("a", day, 2.0, 1, 10), ("b", day, 3.0, 8, 2), ("b", day, 4.0, 7, 3)))
    assert rows(out.select("offer_id", "price", "created_at")) == [("a", 2.0, 5), ("b", 4.0, 8)]


def test_the_page_beyond_the_last_is_beyond_it_at_any_size(spark, monkeypatch):
    star = stored.stored_star(spark, SF)
    vars(star)["product"] = star.product.crossJoin(spark.range(10_000).select("id")).drop("id")
    asked, paged = [], upkeep.reports.paged
    monkeypatch.setattr(upkeep, "stored_star", lambda *_: star)
    monkeypatch.setattr(upkeep.reports, "paged", lambda *a, **k: asked.append(k["number"]) or paged(*a, **k))
    upkeep.QUERIES["rep_page_total"](spark, SF)
    assert asked[0] == 2 and (asked[1] - 1) * 50 > star.product.count() > 500_000
