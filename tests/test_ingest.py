"""Writes: applying a batch twice changes nothing, and each rule of precedence."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfprice.operators import ingest

D = [date(2026, 7, d) for d in range(1, 9)]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_snapshots(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "offer_id string, captured_on date, price double, written_at int")
    stored, batch = frame(("a", D[0], 1.0, 1), ("a", D[1], 2.0, 1)), frame(("a", D[1], 3.0, 1), ("b", D[1], 4.0, 2), ("b", D[1], 5.0, 3))
    once = ingest.upsert_snapshots(stored, batch)
    assert rows(once, "offer_id", "price") == [("a", 1.0), ("a", 3.0), ("b", 5.0)] == rows(ingest.upsert_snapshots(once, batch), "offer_id", "price")


def test_offers(spark):
    stored = spark.createDataFrame([("s", "1", "p1", "u", "n", False, D[0], D[1]), ("s", "2", "p2", "u", "n", True, D[0], D[1])], "store_id string, sku string, product_id string, url string, name_orig string, in_stock boolean, first_seen date, last_seen date")
    seen = spark.createDataFrame([("s", "1", "other", "u2", "n2", True), ("s", "3", "p3", "u3", "n3", True)], "store_id string, sku string, product_id string, url string, name_orig string, in_stock boolean")
    once = ingest.upsert_offers(stored, seen, F.lit(D[4]))
    expected = [("1", "p1", "u2", True, D[0], D[4]), ("2", "p2", "u", True, D[0], D[1]), ("3", "p3", "u3", True, D[4], D[4])]
    columns = ("sku", "product_id", "url", "in_stock", "first_seen", "last_seen")
    assert rows(once, *columns) == expected == rows(ingest.upsert_offers(once, seen, F.lit(D[4])), *columns)
    touched = ingest.touch_offers(stored, seen, F.lit(D[5]))
    assert rows(touched, "sku", "product_id", "in_stock", "last_seen") == [("1", "p1", True, D[5]), ("2", "p2", True, D[1])]


def test_products_and_fields(spark):
    stored = spark.createDataFrame([("k1", "p1", None, "x"), (None, "p2", None, None)], "match_key string, product_id string, abv double, type string")
    found = ingest.find_or_create(stored, spark.createDataFrame([("k1",), ("k2",), ("k2",), (None,)], "match_key string"))
    assert rows(found, "match_key", "is_new") == [("k1", False), ("k2", True)]
    given = spark.createDataFrame([("p1", 40.0, "y", 2), ("p1", 50.0, None, 1), ("p3", 1.0, "z", 1)], "product_id string, abv double, type string, at int")
    once = ingest.fill_missing(stored, given, ["abv", "type"], "at")
    assert rows(once, "product_id", "abv", "type") == [("p1", 50.0, "x"), ("p2", None, None)] == rows(ingest.fill_missing(once, given, ["abv", "type"], "at"), "product_id", "abv", "type")
    alone = ingest.unmatched(spark.createDataFrame([("s", "1", None), ("s", "2", None), ("s", "3", "k")], "store_id string, sku string, match_key string"))
    assert alone.select("product_id").distinct().count() == 2


def test_flavors(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "product_id string, flavor string, source string")
    stored, curated = frame(("p", "oak", "llm"), ("p", "smoky", "scrape"), ("p", "honey", "manual"), ("c", "oak", "manual")), spark.createDataFrame([("c",)], "product_id string")
    added = ingest.add_keyword_flavors(stored, frame(("p", "oak", ""), ("p", "spicy", ""), ("c", "spicy", "")), curated)
    assert rows(added, "product_id", "flavor", "source")[-1] == ("p", "spicy", "scrape") and added.count() == 5
    answers = spark.createDataFrame([("p", "smoky"), ("p", "honey"), ("c", "smoky")], "product_id string, flavor string")
    once = ingest.replace_llm_flavors(stored, answers, curated)
    expected = [("c", "oak", "manual"), ("p", "honey", "manual"), ("p", "smoky", "llm")]
    assert rows(once, "product_id", "flavor", "source") == expected == rows(ingest.replace_llm_flavors(once, answers, curated), "product_id", "flavor", "source")
    manual = ingest.replace_manual_flavors(stored, answers.where("product_id = 'p'"), answers.select("product_id").distinct().where("product_id = 'p'"))
    assert rows(manual, "product_id", "flavor", "source") == [("c", "oak", "manual"), ("p", "honey", "manual"), ("p", "smoky", "manual")]


def test_sweep_and_verdicts(spark):
    offers = spark.createDataFrame([(s, k, True) for s in "abc" for k in "123"], "store_id string, sku string, in_stock boolean")
    seen, gone = spark.createDataFrame([("a", "1"), ("b", "1")], "store_id string, sku string"), spark.createDataFrame([("b", "2"), ("c", "2")], "store_id string, sku string")
    verdicts = spark.createDataFrame([("a", True), ("b", False)], "store_id string, complete boolean")
    out = ingest.sweep(offers, seen, gone, verdicts)
    assert {(r["store_id"], r["sku"]) for r in out.where("not in_stock").collect()} == {("a", "2"), ("a", "3"), ("b", "2")}
    listed = spark.createDataFrame([("exhausted", None, 5), ("exhausted", 6, 5), ("exhausted", 5, 5), ("blocked", 5, 5)], "stop string, stated int, received int")
    assert [r["verdict"] for r in ingest.listing_verdict(listed).collect()] == ["exhausted", "short", "counted", "incomplete"]
    items = spark.createDataFrame([("s", "1", 2, 0, "late"), ("s", "1", 1, 5, "first"), ("s", "2", 1, 0, "x")], "store_id string, sku string, page int, position int, name string")
    assert rows(ingest.first_in_listing(items), "sku", "name") == [("1", "first"), ("2", "x")]


def test_votes_and_differences(spark):
    names = spark.createDataFrame([("k", "AB"), ("k", "AB"), ("k", "A B"), ("k", "A B"), ("k", "x"), ("l", "b"), ("l", "a")], "key string, name string")
    assert rows(ingest.vote_spelling(names), "key", "name", "votes") == [("k", "A B", 2), ("l", "a", 1)]
    a, b = spark.createDataFrame([("1", 1.0), ("2", None), ("3", 3.0)], "sku string, price double"), spark.createDataFrame([("1", 2.0), ("2", None), ("4", 4.0)], "sku string, price double")
    assert tuple(ingest.diff_snapshots(a, b, ["price"]).first()) == (2, 1, 1, 1)
    lacking = spark.createDataFrame([(1, None, 1, "t", 1, 1, None), (2, 1.0, 1, "t", 1, None, None), (3, 1.0, 1, "t", 1, None, 1), (4, 1.0, 1, "t", 1, 1, None)], "product_id int, abv double, volume_ml int, type string, country_id int, classified_at int, curated_at int")
    assert [r["product_id"] for r in ingest.needs_enrichment(lacking).collect()] == [1, 2]
    assert tuple(ingest.null_census(a, ["price"]).first()) == (3, 1)


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    offers = spark.createDataFrame([], "store_id string, sku string, in_stock boolean")
    assert ingest.sweep(offers, offers, offers, spark.createDataFrame([], "store_id string, complete boolean")).count() == 0
