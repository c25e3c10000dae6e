"""The paged source against the walk over frames, and its rules one by one."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan, LessThanOrEqual

from shelfprice.sources import items, paged

from .conftest import SF


def page(*skus, last=None, total=None):
    return {"skus": list(skus), "last_page": last, "total_pages": total}


def walked(*pages, **options):
    got = paged.walk(dict(enumerate(pages, 1)), **({"empty_pages": 2, "most_pages": 9} | options))
    return [s for _, _, s in got.items], got.pages, got.received, got.stop


def test_rules():
    a, b = page("1", "2"), page("2", "1")
    assert walked(a, b, b, page("3")) == (["1", "2"], 3, 6, "exhausted")
    assert walked(a, b, page("3"), b, b) == (["1", "2", "3"], 5, 9, "exhausted")
    assert walked(a, b, page("3"), empty_pages=1) == (["1", "2"], 2, 4, "exhausted")
    assert walked(a, page("3", last=True), page("4")) == (["1", "2", "3"], 2, 3, "exhausted")
    assert walked(page("1", total=2), page("2", total=9), page("3")) == (["1", "2"], 2, 2, "exhausted")
    assert walked(a, page("3"), page("4"), most_pages=2) == (["1", "2", "3"], 2, 3, "page_cap")
    assert walked(page("1", total=5), page("2"), page("3"), most_pages=2) == (["1", "2"], 2, 2, "page_cap")
    assert walked(a, page("3")) == (["1", "2", "3"], 2, 3, "page_failed")
    assert walked(a, page()) == (["1", "2"], 2, 2, "ambiguous") and walked(a, page(), empty_pages=1) == (["1", "2"], 2, 2, "exhausted")
    assert walked(a, b, page("3"), until=2) == (["1", "2"], 2, 4, None)
    with pytest.raises(ValueError, match="first page"):
        walked()


@pytest.fixture(scope="module")
def pages(spark):
    """Pages of ten items from the given documents: five stores, whose items come again and again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select((F.col("doc_id") % 5).cast("string").alias("store_id"), (F.floor(F.col("doc_id") / 50) + 1).cast("int").alias("page"), "doc_id", (F.length("text") % (10 + F.col("doc_id") % 5 * 6)).cast("string").alias("sku"))
    skus = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "sku"))), lambda x: x["sku"])
    return rows.groupBy("store_id", "page").agg(skus.alias("skus")).withColumns({"last_page": F.lit(None).cast("boolean"), "total_pages": F.lit(None).cast("int")})


@pytest.fixture(scope="module")
def landed(pages, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('landed')}/pages"
    paged.land_pages(pages, path)
    return path


def test_the_source_reads_what_the_walk_over_frames_reads(spark, pages, landed):
    listing = {r["store_id"]: r for r in paged.read_listing(spark, landed, rows="listings").collect()}
    frames = items.walk_pages(pages).groupBy("store_id").agg(F.max("page").alias("pages"), F.sum(F.size("skus")).alias("received"), F.sum("fresh").alias("n_items"))
    for r in frames.collect():
        assert (listing[r["store_id"]]["pages"], listing[r["store_id"]]["received"], listing[r["store_id"]]["n_items"]) == (r["pages"], r["received"], r["n_items"])
    found = paged.read_listing(spark, landed)
    assert found.groupBy("store_id", "sku").count().where("count > 1").count() == 0 and found.count() == sum(r["n_items"] for r in listing.values())


def test_filters_are_pushed(spark, landed):
    reader = paged.BoundedPageReader({"path": landed}, listings=False)
    left = list(reader.pushFilters([In(("store_id",), ("1", "3")), LessThanOrEqual(("page",), 3), GreaterThan(("page",), 1), LessThan(("position",), 2), IsNotNull(("sku",))]))
    assert left == [LessThan(("position",), 2), IsNotNull(("sku",))] and [p.store_id for p in reader.partitions()] == ["1", "3"]
    assert {r[1] for p in reader.partitions() for r in reader.read(p)} <= {2, 3}
    list(reader.pushFilters([EqualTo(("store_id",), "2")]))
    assert [list(reader.read(p)) for p in reader.partitions()] == [[]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = paged.read_listing(spark, landed).where("store_id = '4' and page <= 2")
        found, parts = sorted(map(tuple, some.collect())), some.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert parts == 1 and found == sorted(tuple(r) for r in paged.read_listing(spark, landed).collect() if r["store_id"] == "4" and r["page"] <= 2)
