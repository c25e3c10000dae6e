import pytest

from shelfprice.operators import curation


def test_brands_from_names(spark):
    index = curation.brand_index(spark.createDataFrame([("Glen",), ("Glen Test",), ("GLEN-TEST",), ("O'Neil",), ("",)], "name string"))
    items = spark.createDataFrame([("The Glen Test 12",), ("Glenn",), ("oneil's glen",), (None,), ("ONEIL",)], "name string")
    long = curation.brand_index(spark.createDataFrame([("one two three four five six seven eight",), ("two",)], "name string"))
    found = curation.brand_from_name(spark.createDataFrame([("The One-Two Three four five six, seven eight!",), ("two",)], "name string"), long).collect()
    assert {r["found_brand"] for r in found} == {"one two three four five six seven eight", "two"}
    assert {r["name"]: r["found_brand"] for r in curation.brand_from_name(items, index).collect()} == {"The Glen Test 12": "GLEN-TEST", "Glenn": None, "oneil's glen": "Glen", None: None, "ONEIL": "O'Neil"}


def test_answers(spark):
    bodies = ['```json\n[{"id":"1","confidence":"High","tags":["oak","Smoky","new"]},{"id":"2","confidence":"sure","tags":["oak"]}]\n```', "no answer", '{"id":"3"}', None]
    rows = curation.model_answers(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "high", ["oak", "smoky"]), ("2", "sure", [])]
    assert tuple(curation.outcome_tally(rows).first()) == (1, 0, 1, 0, 1)
    items = spark.createDataFrame([("1", None, "x"), ("2", 5, None)], "id string, abv int, type string")
    merged = curation.merge_answers(items, spark.createDataFrame([("1", 7, "y"), ("2", 9, "z")], "id string, abv int, type string"), ["abv", "type"])
    assert sorted(tuple(r) for r in merged.collect()) == [("1", 7, "x"), ("2", 5, "z")]


def test_tags_collapse_while_attested(spark):
    names = spark.createDataFrame([("Glen",), ("Glen Islay",), ("Glen Islay Malt",), ("Oban Single Malt",), ("Oban",), ("Malt",), ("Big Pure Rye",), ("Big Pure",)], "name string")
    got = {r["name"]: r["collapsed"] for r in curation.collapse_tags(names).collect()}
    assert got == {"Glen": "Glen", "Glen Islay": "Glen", "Glen Islay Malt": "Glen", "Oban Single Malt": "Oban Single Malt", "Oban": "Oban", "Malt": "Malt", "Big Pure Rye": "Big Pure", "Big Pure": "Big Pure"}


def test_edits_and_lookups(spark):
    products = spark.createDataFrame([("1", "a", 40.0), ("2", "b", None)], "product_id string, name string, abv double")
    assert sorted(tuple(r) for r in curation.edit_product(products, "2", {"abv": 46, "name": None}).collect()) == [("1", "a", 40.0), ("2", None, 46.0)]
    with pytest.raises(ValueError, match="fields"):
        curation.edit_product(products, "2", {"colour": 1})
    repeated = curation.duplicates(products, spark.createDataFrame([("9", "a"), ("8", "x"), ("7", "x")], "product_id string, name string"), ["name", "product_id"])
    assert sorted(tuple(r) for r in repeated.collect()) == [("name", "a"), ("name", "x")]
    lookup = spark.createDataFrame([("i", "oak")], "id string, name string")
    once = curation.get_or_create(lookup, spark.createDataFrame([("oak",), (" new ",), ("",), ("new",)], "name string"))
    cased = curation.get_or_create(lookup, spark.createDataFrame([("OAK ",), ("New",), ("new",)], "name string"))
    assert sorted(r["name"] for r in cased.collect()) == ["New", "oak"]
    assert once.count() == 2 and curation.get_or_create(once, once.select("name")).count() == 2
    heads = curation.heads(spark.createDataFrame([("k", "2", "b"), ("k", "1", "a"), (None, "3", "c")], "match_key string, sku string, name string"))
    assert [tuple(r) for r in heads.collect()] == [("k", "1", "a")]
    links = spark.createDataFrame([("p", "oak"), ("p", "invented")], "product_id string, flavor string")
    assert curation.known_flavors(links).count() == 1


def test_planning_runs_no_job(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    for action in ("first", "collect", "count", "head", "take", "toPandas"):
        monkeypatch.setattr(DataFrame, action, lambda *_, **__: (_ for _ in ()).throw(AssertionError("a job ran while this was planned")))
    index = curation.brand_index(spark.createDataFrame([("Glen",)], "name string"))
    curation.brand_from_name(spark.createDataFrame([("Glen 12",)], "name string"), index)
    curation.brand_facts(spark.createDataFrame([("Glen 12", None)], "name string, brand string"), spark.createDataFrame([("Glen", "x", None)], "brand string, country string, type string"))
