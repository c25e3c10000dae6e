"""Five days, five offers: the numbers of the dashboard."""

from datetime import date

import pytest

from shelfprice.operators import dashboard as dash
from shelfprice.operators import offers as prices
from shelfprice.operators import runs
from shelfprice.sources.star import Star


def day(n: int) -> date:
    return date(2026, 7, n)


@pytest.fixture(scope="module")
def star(spark):
    seen = {
        "a": ("A", "a", [1000, 1000, 1000, 1000, 1000], 1, 5, True), "b": ("A", "b", [2000, 2000, None, 2000, 2000], 1, 5, True), "c": ("A", "c", [None, None, 3000, 3000, 3000], 3, 5, True),
        "d": ("A", "d", [1000, 700, 400, None, None], 1, 3, False), "e": ("B", "a", [1000, 1100, 1100, 1100, 1180], 1, 5, True),
    }
    snapshot = [(o, p, s, day(i + 1), float(x), False) for o, (s, p, xs, *_) in seen.items() for i, x in enumerate(xs) if x]
    offer = [(o, p, s, day(f), day(last), stock) for o, (s, p, _, f, last, stock) in seen.items()]
    return Star(
        spark.createDataFrame([("A", "a", "Store A"), ("B", "b", "Store B"), ("C", "c", "Empty")], "store_id string, slug string, store_name string"),
        spark.createDataFrame([(1, "xx", "X")], "country_id int, code string, country_name string"),
        spark.createDataFrame([(p, p, None, None, None, 1, 700) for p in "abcd"], "product_id string, name string, brand string, type string, country_id int, age int, volume_ml int"),
        spark.createDataFrame([("a", "oak"), ("a", "smoky"), ("b", "oak")], "product_id string, flavor string"),
        spark.createDataFrame(offer, "offer_id string, product_id string, store_id string, first_seen date, last_seen date, in_stock boolean"),
        spark.createDataFrame(snapshot, "offer_id string, product_id string, store_id string, captured_on date, price double, promo boolean"),
        spark.createDataFrame([("r", "A", True, 4, 1, 10, 300.0)], "run_id string, store_id string, success boolean, added int, removed int, updated int, seconds double").selectExpr(
            "*", "timestamp_ntz '2026-07-05 23:50:00' as created_at"
        ),
    )


@pytest.fixture(scope="module")
def points(star):
    rows = dash.daily(dash.listings(star))
    return {r["day"]: r for r in dash.series(rows, dash.lifecycle(star.offer, "2026-07-01", "2026-07-05")).collect()}


def test_series(points):
    assert len(points) == 5
    pick = lambda n, *names: tuple(points[day(n)][x] for x in names)
    assert pick(1, "in_stock", "tracked", "out_of_stock", "new", "products", "median") == (4, 4, 0, 4, 3, 1000)
    assert pick(3, "in_stock", "tracked", "out_of_stock", "new", "departed") == (4, 5, 1, 1, 1)
    assert pick(4, "in_stock", "tracked", "out_of_stock", "departed") == (4, 5, 1, 0)
    assert pick(5, "in_stock", "out_of_stock", "products", "median") == (4, 1, 3, 1590)


def test_a_later_range_counts_what_came_before(star):
    rows = {r["day"]: r for r in dash.lifecycle(star.offer, "2026-07-04", "2026-07-07").collect()}
    assert [rows[day(n)]["tracked"] for n in (4, 5, 6, 7)] == [5, 5, 5, 5] and rows[day(4)]["new"] == 0
    by = {(r["store_id"], r["day"]): r["tracked"] for r in dash.lifecycle(star.offer, "2026-07-02", "2026-07-03", "store_id").collect()}
    assert by == {("A", day(2)): 3, ("A", day(3)): 4, ("B", day(2)): 1, ("B", day(3)): 1}


def test_per_store_adds_up_only_for_listings(star):
    rows = [r for r in dash.daily(dash.listings(star), "slug").collect() if r["captured_on"] == day(5)]
    assert sum(r["in_stock"] for r in rows) == 4 and sum(r["products"] for r in rows) == 4


def test_summary(star):
    got = {r["metric"]: r for r in dash.summary(dash.listings(star), star.offer).collect()}
    assert tuple(got["tracked"])[1:4] == (5.0, 4.0, 1.0) and got["tracked"]["delta_pct"] == 25
    assert got["in_stock"]["latest"] == 4 and got["out_of_stock"]["latest"] == 1 and got["out_of_stock"]["delta_pct"] is None
    assert got["median"]["latest"] == 1590 and got["stores"]["latest"] == 2


def test_price_buckets(star):
    rows = {r["bucket"]: tuple(r)[1:] for r in dash.breakdown_prices(dash.within(dash.listings(star), "2026-07-05", "2026-07-05")).collect()}
    assert rows == {2: (1000, 2000, 2, 1), 3: (2000, 3000, 1, 1), 4: (3000, 5000, 1, 1)}


def test_movers(star):
    drop, rise = (dash.movers(star.snapshot, rises=r).collect() for r in (False, True))
    assert [(r["offer_id"], r["first_price"], r["last_price"], r["change_pct"]) for r in drop] == [("d", 1000, 400, -60)]
    assert [(r["offer_id"], r["change_pct"]) for r in rise] == [("e", 18)]
    assert dash.movers(star.snapshot, rises=True, store_id="A").count() == 0 and dash.movers(star.snapshot, rises=False, min_price=1001).count() == 0


def test_runs(star):
    row = runs.activity(star.run_log, "2026-07-05", "2026-07-05").first()
    assert tuple(row)[1:] == (1, 1, 0, 0, 4, 1, 10, 300_000, 300_000)
    assert runs.activity(star.run_log, "2026-07-01", "2026-07-04").count() == 0


def test_coverage_keeps_empty_stores(star):
    assert {r["slug"]: (r["listings"], r["in_stock"]) for r in dash.coverage(star).collect()} == {"a": (4, 3), "b": (1, 1), "c": (0, 0)}


def test_flavors_overlap_and_skip_the_untagged(star):
    rows = dash.breakdown_flavors(dash.within(dash.listings(star), "2026-07-05", "2026-07-05"), star.product_flavor)
    assert {r["key"]: r["listings"] for r in rows.collect()} == {"oak": 3, "smoky": 2}


def test_price_since(star):
    got = {r["offer_id"]: r["since"] for r in prices.price_since(star.snapshot).collect()}
    assert got == {"a": day(1), "b": day(1), "c": day(3), "d": day(3), "e": day(1)}


def test_ranges_and_weeks(star, spark):
    for bad in (("2026-07-05", "2026-07-01"), ("2024-01-01", "2026-07-01")):
        with pytest.raises(ValueError, match="range"):
            dash.within(star.snapshot, *bad)
    assert dash.granularity("2026-01-01", "2026-07-01") == "week" and dash.granularity("2026-06-01", "2026-07-01") == "day"
    assert dash.granularity("2026-01-01", "2026-07-01", "day") == "day"
    rows = spark.createDataFrame([(date(2026, 8, d), level, new, 0) for d, level, new in ((18, 90, 1), (19, 95, 2), (21, 100, 4), (16, 1, 1))], "day date, in_stock long, new long, departed long")
    assert {r["week"]: (r["in_stock"], r["new"]) for r in dash.weekly(rows).collect()} == {date(2026, 8, 17): (100, 7), date(2026, 8, 10): (1, 1)}
