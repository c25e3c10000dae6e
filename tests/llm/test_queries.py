"""The operators' queries over whole small tables, against SQL where there is SQL, and the stages of the pipeline on odd tables."""

import os
from collections import Counter

import duckdb
import pytest

from shelfprice.llm.queries import ORACLES, QUERIES

from ..conftest import SF
from .conftest import odd_texts
from ..test_queries import plain


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    table = "embeddings" if "vec_id" in columns else "documents"
    if name != "op5_repeats":
        assert len(got) == db.sql(f"select count(*) from {table}").fetchall()[0][0]
    if name in ORACLES:
        sql = db.sql(ORACLES[name])
        assert sorted(sql.columns) == columns
        assert got == sorted((tuple(map(plain, r)) for r in sql.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "personal_data", "mixing", "pieces"])
def test_stages_on_odd_tables(odd, nothing, stages, stage):
    spark = odd.sparkSession
    out = stages[stage](spark, odd, SF)
    rows = out.collect()
    assert stages[stage](spark, nothing, SF).count() == 0
    if stage == "pieces":
        assert len(rows) == len(odd_texts()) and out.columns[0] == "doc_id"
        return
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    at = odd.columns.index("text")
    if stage in ("toxicity", "personal_data"):
        assert Counter((r[0], r[at]) for r in rows) == Counter((i, t) for i, t, _ in odd_texts())
        assert all(r[odd.columns.index("n_chars")] == (None if r[at] is None else len(r[at])) for r in rows)
    if stage == "near_duplicates":
        assert len(rows) == 12
