"""Batches into a stored table: whatever breaks off half-way, the same batch again brings the table to the same state."""

import os
from datetime import date

import pytest

from shelfprice.sources import sink

SCHEMA = "offer_id string, captured_on date, price double, created_at int, written_at int"


def files(path: str) -> dict[str, tuple]:
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, os.path.getsize(os.path.join(d, f))) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    path, work = f"file://{tmp_path}/table", f"file://{tmp_path}/work"
    batch = lambda *r: spark.createDataFrame([(o, date(2026, m, d), p, c, w) for o, m, d, p, c, w in r], SCHEMA)
    put = lambda name, *r: sink.write_batch(batch(*r), path, work, name)
    read = lambda: sorted((r["offer_id"], r["captured_on"].month, r["captured_on"].day, r["price"], r["created_at"]) for r in sink.read_snapshots(spark, path, SCHEMA).collect())
    put("first", ("a", 5, 1, 1.0, 1, 1), ("a", 6, 1, 2.0, 1, 1), ("b", 6, 2, 3.0, 1, 1), ("b", 7, 1, 4.0, 1, 1))
    return put, read, str(tmp_path / "table"), batch


NEXT = (("a", 6, 1, 20.0, 2, 2), ("a", 6, 1, 30.0, 3, 3), ("c", 6, 3, 5.0, 2, 2))
AFTER = [("a", 5, 1, 1.0, 1), ("a", 6, 1, 30.0, 1), ("b", 6, 2, 3.0, 1), ("b", 7, 1, 4.0, 1), ("c", 6, 3, 5.0, 2)]


def test_only_touched_partitions_change(table):
    put, read, path, _ = table
    before = files(path)
    put("next", *NEXT)
    after = files(path)
    assert read() == AFTER
    assert {f: s for f, s in before.items() if "part=2026-06" not in f} == {f: s for f, s in after.items() if "part=2026-06" not in f}
    put("next", ("a", 5, 1, 99.0, 9, 9))  # a batch of that name is done
    assert read() == AFTER and files(path) == after
    put("empty")
    assert read() == AFTER and files(path) == after


@pytest.mark.parametrize("broken", ["stage", "before the swap", "after the swap"])
def test_a_write_that_breaks_off_goes_on(table, monkeypatch, broken):
    put, read, _, _ = table
    stage, swap = sink.stage, sink.swap

    def half_staged(stored, batch, folder, *rest):
        batch.limit(1).write.parquet(f"{folder}/_temporary/0")  # a writer's files before it commits
        raise RuntimeError("killed")

    def killed(*args):
        if broken == "after the swap":
            swap(*args)
        raise RuntimeError("killed")

    monkeypatch.setattr(sink, "stage", half_staged if broken == "stage" else stage)
    monkeypatch.setattr(sink, "swap", killed)
    with pytest.raises(RuntimeError, match="killed"):
        put("next", *NEXT)
    monkeypatch.undo()
    put("next", *NEXT)
    assert read() == AFTER


def test_a_later_write_of_an_earlier_time_does_not_win(table):
    put, read, _, _ = table
    put("late", ("a", 6, 1, 7.0, 0, 0))
    assert ("a", 6, 1, 2.0, 1) in read()


def test_a_large_month_is_written_by_several_tasks(spark, tmp_path):
    path = f"file://{tmp_path}"
    schema = spark.createDataFrame([], SCHEMA).schema.add("part", "date")
    rows = spark.range(0, 200_000, 1, 8).selectExpr("sha2(cast(id as string), 256) as offer_id", "date '2026-05-01' as captured_on", "rand(1) as price", "1 as created_at", "1 as written_at", "date '2026-05-01' as part")
    rows.write.parquet(f"{path}/staged")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sink.swap(spark, f"{path}/staged", f"{path}/table", schema)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(files(str(tmp_path / "table"))) > 1 and spark.read.parquet(f"{path}/table").count() == 200_000
