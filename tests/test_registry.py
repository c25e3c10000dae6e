"""Which reader reads which store."""

import pytest
from pyspark.sql import functions as F

from shelfprice.sources import html, registry
from shelfprice.sources.registry import Registry, StoreSpec


def test_a_store_of_its_own_goes_before_its_kind():
    own = registry.card_reader(html.CardSpec("div.x", "h1"))
    known = Registry(special={"a": own})
    assert known.reader_of(StoreSpec("a", chain="c")) is own and known.reader_of(StoreSpec("b", category="c", base_url="u")) is registry.json_reader
    assert known.reader_of(StoreSpec("b", base_url="u")) is known.pages
    with pytest.raises(ValueError, match="no reader for the store 'z'"):
        known.reader_of(StoreSpec("z"))
    with pytest.raises(ValueError, match="no stores"):
        known.read(None, [])


def test_stores_of_one_reader_are_read_together(spark):
    card = '<li class="product sale" data-product_id="7"><h2>A</h2><a href="/7">x</a><span class="price"><del>9</del><ins>5,5</ins></span></li><li class="product" data-product_id="8"><h2>B</h2></li>'
    landed = [("one", 1, '{"sku":"1","title":"T","price":250}'), ("two", 1, '{"ean":"2","sku":"x","price":100}'), ("shop", 3, card), ("other", 1, card), ("one", 2, "{broken"), ("shop", 4, None)]
    frame = spark.createDataFrame(landed, "slug string, page int, body string")
    out = Registry().read(frame, [StoreSpec("one", chain="c"), StoreSpec("two", category="k"), StoreSpec("shop", base_url="u"), StoreSpec("nothing landed", base_url="u")])
    assert out.columns == list(registry.COLUMNS)
    rows = sorted(tuple(r) for r in out.select("slug", "page", "sku", "name", "price", "old_price", "promo").collect())
    assert rows == [("one", 1, "1", "T", 2.5, None, False), ("shop", 3, "7", "A", 5.5, 9.0, True), ("two", 1, "2", None, 1.0, None, False)]
    assert out.where(F.col("slug") == "other").count() == 0
