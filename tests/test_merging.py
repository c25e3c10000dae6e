"""Corrections of the catalogue: chains of merges, circles, precedence of fields and flavors, splits, keys."""

import pytest
from pyspark.errors import PySparkException

from shelfprice.operators import merging

PRODUCT = "product_id string, match_key string, name string, age int, abv double, brand string, classified_at int"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def catalogue(spark):
    product = [("a", "ka", None, 12, None, None, 1), ("b", "kb", "B", 10, 43.0, None, 5), ("c", "kc", "C", 9, 40.0, "brand c", None), ("d", "kd", "D", 8, 50.0, "brand d", 3), ("e", None, "E", 7, None, None, None)]
    links = [("a", "oak", "scrape"), ("b", "oak", "llm"), ("b", "honey", "manual"), ("c", "honey", "llm"), ("d", "smoky", "scrape"), ("e", "smoky", "manual"), ("e", "oak", "scrape")]
    offer = [(f"{p}{k}", p, p * 2) for p in "abcde" for k in "12"]
    return merging.Catalogue(
        spark.createDataFrame(product, PRODUCT), spark.createDataFrame(offer, "offer_id string, product_id string, sku string"), spark.createDataFrame(links, "product_id string, flavor string, source string")
    )


@pytest.fixture
def edges(spark):
    return lambda *pairs: spark.createDataFrame(list(pairs), "from_id string, into_id string")


def test_roots_of_chains(edges):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(1, 12)]
    found = {r["from_id"]: (r["root"], r["steps"]) for r in merging.merge_roots(edges(*chain, ("x", "n3"), ("x", "n3"), ("y", "z"))).collect()}
    assert found == {f"n{i}": ("n12", 12 - i) for i in range(1, 12)} | {"x": ("n12", 10), "y": ("z", 1)}
    assert merging.merge_roots(edges()).count() == 0


@pytest.mark.parametrize("bad", [[("a", "a")], [("a", "b"), ("b", "a")], [("x", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("p", "q")], [(f"n{i}", f"n{(i + 1) % 5}") for i in range(5)]])
def test_a_circle_is_an_error(edges, bad):
    with pytest.raises(ValueError, match="circle"):
        merging.merge_roots(edges(*bad))


def test_two_targets_are_an_error(edges):
    with pytest.raises(ValueError, match="several"):
        merging.merge_roots(edges(("a", "b"), ("a", "c")))


def test_merge(catalogue, edges):
    merges = edges(("d", "c"), ("c", "b"), ("b", "a"), ("nobody", "a"))
    out = merging.merge(catalogue, merges)
    assert rows(out.product, "product_id", "match_key", "name", "age", "abv", "brand", "classified_at") == [("a", "ka", "B", 12, 43.0, "brand c", 5), ("e", None, "E", 7, None, None, None)]
    assert rows(out.links, "product_id", "flavor", "source") == [("a", "honey", "manual"), ("a", "oak", "llm"), ("a", "smoky", "scrape"), ("e", "oak", "scrape"), ("e", "smoky", "manual")]
    assert rows(out.offer, "offer_id", "product_id") == [(f"{p}{k}", "e" if p == "e" else "a") for p in "abcde" for k in "12"] and out.offer.columns == catalogue.offer.columns
    again = merging.merge(out, merges)
    assert rows(again.product, *again.product.columns) == rows(out.product, *out.product.columns) and rows(again.links, "product_id", "flavor", "source") == rows(out.links, "product_id", "flavor", "source")
    with pytest.raises(ValueError, match="not there"):
        merging.merge(catalogue, edges(("a", "nobody")))
    same = merging.merge(catalogue, edges())
    assert rows(same.product, *same.product.columns) == rows(catalogue.product, *catalogue.product.columns)


def test_siblings_fill_by_steps_and_id(catalogue, edges):
    out = merging.merge(catalogue, edges(("b", "e"), ("c", "b"), ("d", "e")))
    assert ("e", "E", 43.0, "brand d") in rows(out.product, "product_id", "name", "abv", "brand")


def test_split(catalogue, spark):
    splits = spark.createDataFrame([("c", "new", "C Rye", 43.0)], "from_id string, new_id string, name string, abv double")
    out = merging.split(catalogue, splits, spark.createDataFrame([("c2", "new")], "offer_id string, new_id string"))
    assert ("new", None, "C Rye", 9, 43.0, "brand c", None) in rows(out.product, *out.product.columns) and out.product.count() == 6
    assert ("new", "honey", "llm") in rows(out.links, "product_id", "flavor", "source") and ("c2", "new") in rows(out.offer, "offer_id", "product_id") and ("c1", "c") in rows(out.offer, "offer_id", "product_id")
    bad = [(splits, [("a1", "new")], "not of the bottling"), (spark.createDataFrame([("c", "a", None, None)], splits.schema), [], "already"), (spark.createDataFrame([("zz", "new", None, None)], splits.schema), [], "no bottling")]
    for wrong, moves, said in bad:
        out = merging.split(catalogue, wrong, spark.createDataFrame(moves, "offer_id string, new_id string"))
        with pytest.raises(PySparkException, match=said):
            out.product.collect(), out.offer.collect()


def test_moves_and_keys(catalogue, spark):
    moves = lambda *r: spark.createDataFrame(list(r), "offer_id string, product_id string")
    assert ("a1", "e") in rows(merging.move_offers(catalogue.offer, catalogue.product, moves(("a1", "e"))), "offer_id", "product_id")
    with pytest.raises(PySparkException, match="no bottling zz"):
        merging.move_offers(catalogue.offer, catalogue.product, moves(("a1", "zz"))).collect()
    keys = lambda *r: spark.createDataFrame(list(r), "product_id string, match_key string")
    assert rows(merging.rekey(catalogue.product, keys(("a", "kb"), ("b", "ka"), ("e", "ke"), ("d", None))), "product_id", "match_key") == [("a", "kb"), ("b", "ka"), ("c", "kc"), ("d", None), ("e", "ke")]
    with pytest.raises(PySparkException, match="two bottlings"):
        merging.rekey(catalogue.product, keys(("a", "kb"))).collect()
