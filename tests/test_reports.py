"""Reports and filters over few offers."""

from datetime import date

import pytest

from shelfprice.operators import preferences, reports
from shelfprice.operators.filters import OfferFilter, filter_offers, split_age

SCHEMA = (
    "offer_id string, product_id string, store_id string, slug string, store_name string, name string, brand string, type string, country string, age int, volume_ml int, flavors array<string>, "
    "price double, previous_price double, promo boolean, captured_on date, first_seen date, last_seen date, in_stock boolean"
)
TODAY = date(2026, 7, 21)


def offer(i, product, store, price, previous=None, *, name="Sample", brand=None, kind=None, age=None, flavors=(), first=date(2026, 6, 15), stock=True):
    return i, product, store, store, f"Store {store}", name, brand, kind, "gb", age, 700, list(flavors), float(price), previous, False, TODAY, first, TODAY, stock


@pytest.fixture(scope="module")
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def by_group(groups):
    return {r["group_id"]: [o["price"] for o in r["offers"]] for r in groups.collect()}


@pytest.fixture(scope="module")
def catalogue(frame):
    return frame(
        offer("1", "sample", "a", 1000), offer("2", "sample", "b", 1200, 1500.0), offer("3", "other", "a", 900, name="Other", brand="B", kind="malt", flavors=["oak"]),
        offer("4", "aged", "a", 1500, name="Aged Cask", age=12, brand="C", flavors=["oak", "smoky"]), offer("5", "gone", "a", 10, stock=False),
    )


def test_catalog(catalogue):
    groups = reports.catalog(filter_offers(catalogue, OfferFilter()))
    assert by_group(groups) == {"1": [1000, 1200], "3": [900], "4": [1500]}
    first = groups.where("group_id = '1'").first()
    assert first["price"] == first["offers"][0]["price"] and first["slug"] == "a" and first["offers"][1]["discount"] == 20
    shown = reports.page(groups, "catalog", size=50).collect()
    assert [r["group_id"] for r in shown] == ["4", "3", "1"] and reports.page(groups, "catalog", number=2).count() == 0
    assert [r["group_id"] for r in reports.ordered(groups, "catalog", "age").collect()] == ["4", "1", "3"]
    assert [r["group_id"] for r in reports.ordered(groups, "catalog", "brand", descending=True).collect()] == ["4", "3", "1"]
    for bad in ({"number": 0}, {"size": 7}, {"sort": "nothing"}):
        with pytest.raises(ValueError, match="pages|sort"):
            reports.page(groups, "catalog", **bad)


@pytest.mark.parametrize(("wanted", "ids"), [
    (OfferFilter(stores=["b"]), "2"), (OfferFilter(min_price=1100, max_price=1200), "2"), (OfferFilter(name="cask 12"), "4"), (OfferFilter(name="cask 15"), ""), (OfferFilter(name="CASK"), "4"),
    (OfferFilter(types=["unknown"]), "124"), (OfferFilter(types=["malt"]), "3"), (OfferFilter(types=["malt", "unknown"]), "1234"), (OfferFilter(flavors=["oak"], exclude_flavors=["smoky"]), "3"),
    (OfferFilter(in_stock_only=False, max_price=50), "5"), (OfferFilter(countries=["GB"]), "1234"), (OfferFilter(min_volume=701), ""), (OfferFilter(stores=[]), "1234"), (OfferFilter(favorites_only=True), ""),
])
def test_filters(catalogue, wanted, ids):
    assert "".join(sorted(r["offer_id"] for r in filter_offers(catalogue, wanted).collect())) == ids


def test_blacklists_and_favorites(catalogue, spark):
    brands, products = spark.createDataFrame([("B",), (None,)], "brand string"), spark.createDataFrame([("sample",)], "product_id string")
    ids = lambda df: "".join(sorted(r["offer_id"] for r in df.collect()))
    assert ids(filter_offers(catalogue, OfferFilter(), blacklist_brands=brands)) == "124"
    assert ids(filter_offers(catalogue, OfferFilter(), blacklist_products=products)) == "34"
    assert ids(filter_offers(catalogue, OfferFilter(favorites_only=True), favorites=products)) == "12"


@pytest.mark.parametrize(("prices", "winner"), [
    ([("a", 1200), ("b", 1000), ("c", 1500)], (1000, 1200)), ([("a", 1000), ("a", 1400)], None), ([("a", 400), ("b", 1000)], None), ([("a", 500), ("b", 1000)], (500, 1000)), ([("a", 5)], None),
])
def test_best(frame, prices, winner):
    rows = reports.best(frame(*[offer(str(i), "p", s, x) for i, (s, x) in enumerate(prices)])).collect()
    assert [(r["price"], r["reference"]) for r in rows] == ([winner] if winner else [])
    if winner:
        assert [o["price"] for o in rows[0]["offers"]] == sorted(x for _, x in prices)


def test_best_bounds_hold_for_the_winner(frame):
    rows = frame(offer("1", "p", "a", 800), offer("2", "p", "b", 1000))
    assert reports.best(rows, min_price=900).count() == 0 and reports.best(rows, max_price=900).count() == 1 and reports.best(rows, least=20).count() == 1 and reports.best(rows, least=21).count() == 0


def test_drops_lows_and_new(frame, spark):
    rows = frame(offer("1", "p", "a", 800, 1000.0), offer("2", "p", "b", 900, 900.0), offer("3", "q", "a", 700, 900.0, first=date(2026, 7, 15)), offer("4", "r", "a", 5, first=date(2026, 7, 14)))
    history = [("1", date(2026, 7, 10), 5000.0), ("1", date(2026, 7, 14), 1000.0), ("1", date(2026, 7, 20), 800.0), ("2", date(2026, 7, 20), 900.0), ("3", date(2026, 7, 20), 900.0), ("3", date(2026, 7, 21), 700.0), ("4", TODAY, 5.0)]
    snapshot = spark.createDataFrame(history, "offer_id string, captured_on date, price double")
    drops = {r["group_id"]: r for r in reports.drops(rows, snapshot, "2026-07-21").collect()}
    assert {k: (r["reference"], r["discount"], r["days"]) for k, r in drops.items()} == {"1": (1000, 20, 1), "3": (900, 22, 0)}
    assert {r["group_id"] for r in reports.drops(rows, snapshot, "2026-07-21", discount_window="yesterday").collect()} == {"1"}
    assert {r["group_id"] for r in reports.drops(rows, snapshot, "2026-07-21", least=21).collect()} == {"3"}
    assert {r["group_id"] for r in reports.lows(rows, snapshot).collect()} == {"1", "3"}
    assert {r["group_id"]: r["days"] for r in reports.new_listings(rows, "2026-07-21").collect()} == {"3": 6}
    assert reports.drops(rows.limit(0), snapshot, "2026-07-21").count() == 0


def test_split_age():
    assert split_age(" Glen Test 12 ") == ("Glen Test", 12) and split_age("Glen 123") is None and split_age("12") is None and split_age(None) is None and split_age("A 7") == ("A", 7)


def test_preferences(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "user_id string, target_id string, created_at int")
    stored, more = frame(("u", "a", 1), ("u", "b", 2)), frame(("u", "a", 9), ("u", "c", 9), ("v", "a", 9))
    both = preferences.add(stored, more)
    assert both.count() == 4 and preferences.add(both, more).count() == 4 and both.where("target_id = 'a' and user_id = 'u'").first()["created_at"] == 1
    favorites, blacklist = preferences.blacklist_products(both, stored.limit(0), frame(("u", "a", 1)))
    assert favorites.count() == 3 and blacklist.count() == 1
    users = spark.createDataFrame([("u",), ("w",)], "user_id string")
    got = {r["user_id"]: r for r in preferences.bundle(users, both, blacklist, stored.limit(0)).collect()}
    assert got["u"]["favorites"] == ["c", "b", "a"] and got["w"]["favorites"] == [] and got["u"]["blacklist_products"] == ["a"] and got["u"]["blacklist_brands"] == []
