"""Sources on literal pages, items and files, and the stream of writes."""

from datetime import date, datetime

from pyspark.sql import functions as F

from shelfprice.sources import html, items
from shelfprice.streaming import snapshots

PAGE = """<html><head><title> Shop </title><style>x{}</style></head><body>
<li class="product sale" data-product_id="7"><a href="/p/7"><h2>Glen <b>Test</b> 0.7 л</h2></a><span class="price"><del>1 200</del> <ins>999,50</ins></span></li>
<li class="product outofstock" data-product_id="8"><a href="/p/8"><h2>Other</h2></a><span class="price">500</span><br></li>
<li class="product"><h2>No sku</h2></li>
<table><tr><th>Volume:</th><td>0.7</td></tr><tr><th>Volume</th><td>1.0</td></tr><tr><th>ABV</th><td> 40 % </td></tr></table></body>"""


def test_cards(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>unclosed <b>x"), (4, "")], "page_id long, html string")
    rows = [tuple(r) for r in html.cards(pages, html.CardSpec("li.product", "h2")).collect()]
    assert rows == [(1, "7", "GlenTest0.7 л", "/p/7", "999,50", "1 200", True, True, 0), (1, "8", "Other", "/p/8", "500", None, False, False, 1)]
    text = {r["page_id"]: r for r in html.page_text(pages).collect()}
    assert text[1]["title"] == "Shop" and text[1]["links"] == 2 and text[1]["attributes"] == {"volume": "1.0", "abv": "40 %"} and "Glen Test 0.7 л" in text[1]["rich"]
    assert text[3]["rich"] == "unclosed x" and text[2]["stripped"] == ""
    lines = F.array(*map(F.lit, ["Country: Japan", "country of origin: X", "ABV 5", "Age :  12 ", "Type:"]))
    assert spark.range(1).select(html.labelled(lines, {"country": "country", "age": "age", "type": "type"}).alias("v")).first()["v"].asDict() == {"country": "Japan", "age": "12", "type": None}


def test_tokens_and_references(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(html.unescaped(F.lit("a &amp; b &lt;&#233;&#x416;&nosuch; & &copy;&#0;&#x1F600;"))) == "a & b <éЖ&nosuch; & ©&#0;\U0001f600"
    page = html.tokens(F.lit("<!DOCTYPE html><!-- <p>no</p> --><script>var t='<p>';</script><DIV class='a  b' id=x><div>in<br/>ner</div> out</div> 1 < 2<p>last"))
    assert one(html.stripped_text(page)) == "innerout1<2last" and one(html.rich_text(page)) == "in ner out 1 < 2 last"
    assert one(html.first_text(page, "div.b")) == "innerout" and one(html.first_text(page, "p")) == "last" and one(html.first_text(page, "h1")) is None and one(F.size(html.elements(page, "div"))) == 2
    assert one(html.first_attribute(page, "[id]", "id")) == "x" and one(html.attribute(F.lit("<a data-x href>"), "href")) == "" and one(html.attribute(F.lit("<a data-href='q'>"), "href")) is None


def test_cards_of_a_walk(spark):
    rows = spark.createDataFrame([("s", 2, 0, "a", "late"), ("s", 1, 3, "a", "first"), ("s", 1, 4, "b", "x"), ("t", 9, 0, "a", "own")], "store_id string, page int, position int, sku string, name string")
    assert sorted((r["store_id"], r["sku"], r["name"]) for r in html.first_seen(rows).collect()) == [("s", "a", "first"), ("s", "b", "x"), ("t", "a", "own")]


def test_json_items(spark):
    bodies = ['{"ean":"1","sku":"s","title":"A","price":12345,"discount":{"status":true,"old_price":20000},"volume":700.9,"producer":{"trademark":"T"},"web_url":"u","in_stock":false}',
              '{"ean":"","sku":"2","title":"B","price":100,"discount":{"status":false,"old_price":5},"producer":{"name":"N"}}', "{broken", None]
    rows = [tuple(r) for r in items.json_items(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()]
    assert rows == [("1", "A", "u", 123.45, 200.0, False, True, 700, "T", None), ("2", "B", None, 1.0, None, True, False, None, "N", None)]


def test_attributes(spark):
    frame = spark.sql("""select array(named_struct('path','a','values',array('1','2')), named_struct('path','b','values',cast(array() as array<string>)), named_struct('path','a','values',array('3'))) as c,
      array(named_struct('attributes', array(named_struct('key','x','value',' '), named_struct('key','x','value','8-12'))), named_struct('attributes', array(named_struct('key','x','value','9')))) as g""")
    row = frame.select(items.characteristics("c").alias("m"), items.attribute_groups("g").alias("n"), items.first_value(items.attribute_groups("g"), ["no", "x"]).alias("f")).first()
    assert row["m"] == {"a": "1"} and row["n"] == {"x": "8-12"} and row["f"] == "8-12"
    assert frame.select(items.lower_bound(F.lit("8-12 years")).alias("v")).first()["v"] == 8


def test_walks(spark):
    pages = [("s", 1, ["a", "b"], None), ("s", 2, ["a"], None), ("s", 3, ["c"], None), ("s", 4, [], None), ("s", 5, ["a"], None), ("s", 6, ["z"], None), ("t", 1, ["a"], True), ("t", 2, ["b"], None)]
    walked = items.walk_pages(spark.createDataFrame(pages, "store_id string, page int, skus array<string>, last_page boolean"))
    assert sorted((r["store_id"], r["page"], r["fresh"]) for r in walked.collect()) == [("s", 1, 2), ("s", 2, 0), ("s", 3, 1), ("s", 4, 0), ("s", 5, 0), ("t", 1, 1)]


def test_price_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    n = lambda x: F.lit(x).cast("double")
    assert one(items.promotion_price(F.lit("promotion"), n(5), n(9))) == 9 and one(items.promotion_price(F.lit("regular"), n(5), n(9))) is None and one(items.promotion_price(F.lit("promotion"), n(9), n(5))) is None
    assert tuple(one(items.tiered_price(n(None), n(7), n(4), n(6)))) == (4, None) and tuple(one(items.tiered_price(n(3), n(7), n(4), n(6)))) == (3, 7)
    rows = spark.createDataFrame([("In Stock", 50.0), ("in stock", 1.0), ("sold out", 1.0), ("soon", 9.0)], "label string, price double")
    assert [tuple(r) for r in items.labelled_stock(rows, "label", "price", {"in stock": True, "sold out": False}).collect()] == [("In Stock", 50.0, True), ("sold out", 1.0, False)]


def test_normalise_and_tags(spark, tmp_path):
    row = spark.createDataFrame([("Glen Односолодовий 12 років 0.7 л", "GLEN-TEST", None, None, None, None, "uk", None, {"a": "43% Scotland, smoky"})],
                                "name string, brand string, volume_ml int, abv double, age int, type string, country string, flavors array<string>, attributes map<string,string>")
    got = items.normalise(row).first()
    assert (got["brand"], got["volume_ml"], got["abv"], got["age"], got["type"], got["country"], got["flavors"]) == ("Glen Test", 700, 43.0, 12, "single malt", "Шотландія", ["smoky"])
    bare = spark.createDataFrame([("Quill Fern 12 років", None, None, None, None, None, None, None, {"a": "b"}), ("Віскі quill 0.5 л", "", None, None, None, "rye", None, None, {})],
                                 "name string, brand string, volume_ml int, abv double, age int, type string, country string, flavors array<string>, attributes map<string,string>")
    known = spark.createDataFrame([("Quill",), ("Quill Fern",), ("a b c d e f g h",)], "name string")
    facts = spark.createDataFrame([("quill", "A", "grain"), ("quill fern", "B", None)], "brand string, country string, type string")
    full = {r["name"]: (r["brand"], r["country"], r["type"]) for r in items.normalise(bare, brands=known, brand_info=facts).collect()}
    assert full == {"Quill Fern 12 років": ("Quill Fern", "B", None), "Віскі quill 0.5 л": ("Quill", "A", "rye")}
    card = spark.createDataFrame([('{"sku": "7", "price": 12.5}',), ("not json",), ("",), (None,)], "info string").select(items.embedded("info", "sku string, price double").alias("i"), items.split_list(F.col("info")).alias("l"))
    assert [r["i"] and r["i"]["sku"] for r in card.collect()] == ["7", None, None, None]
    lists = spark.createDataFrame([(" a, b ,,c",), (" , ",), (None,)], "v string").select(items.split_list(F.col("v")).alias("l"))
    assert [r["l"] for r in lists.collect()] == [["a", "b", "c"], None, None]
    path = tmp_path / "tags.csv"
    path.write_text("product_id,name,tags\n1,A,oak|Smoky|nonsense|oak\n2,B,\n3,C,oak,extra\n")
    assert [tuple(r) for r in items.read_tag_list(spark, str(path)).orderBy("product_id").collect()] == [("1", "A", ["oak", "smoky"]), ("2", "B", [])]


def test_stream_of_writes(spark, tmp_path):
    schema = "offer_id string, captured_on date, price double, written_at timestamp"
    t = lambda h: datetime(2026, 7, 1, h)
    spark.sql("drop table if exists kept_snapshots")
    for batch in ([("a", date(2026, 7, 1), 1.0, t(1)), ("b", date(2026, 7, 1), 2.0, t(1)), ("a", date(2026, 7, 1), 3.0, t(2))], [("a", date(2026, 7, 1), 4.0, t(3)), ("a", date(2026, 7, 2), 5.0, t(3))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = snapshots.keep_snapshots(snapshots.read_writes(spark, str(tmp_path / "in"), schema), "kept_snapshots", str(tmp_path / "state"))
        query.awaitTermination()
    rows = sorted((r["offer_id"], str(r["captured_on"]), r["price"]) for r in spark.table("kept_snapshots").collect())
    spark.sql("drop table kept_snapshots")
    assert rows == [("a", "2026-07-01", 4.0), ("a", "2026-07-02", 5.0), ("b", "2026-07-01", 2.0)]
