"""The pipeline, the registered corpus queries and their SQL."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_queries import compare  # noqa: E402

from tidemark.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert compare(QUERIES[name](spark, small).toPandas(), con.execute(SQL[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_read_whole_tables(spark, small, name):
    rows = QUERIES[name](spark, small)
    table, key = {"op5": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    if name.startswith("op4"):
        rows = rows.selectExpr("explode(doc_ids) AS doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in rows.select(key).collect()} == ids


def test_stages_follow_one_another(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before and ids, name
        before = set(ids)
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before


def test_entry_lists_the_corpus_queries():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_long_hosts_and_paths_equal_their_sql(spark, tmp_path):
    """Nine labels, one label, six segments: the SQL takes every domain and path prefix, as the operator does."""
    hosts = ["a.b.c.d.e.f.g.example.com", "localhost", "www.example.com", "x.co.uk", "b.c.d.e.f.g.example.com"]
    paths = ["", "/", "/a/b/c/d/e/f", "/a/b/c/d/e/f/g?x=1", "/a"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no url"]
    rows = [(i, urls[i % len(urls)], "") for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, expected = QUERIES["op5_lists_blocked"](spark, str(tmp_path)).toPandas(), con.execute(SQL["op5_lists_blocked"]).df()
    assert compare(got, expected) == "ok" and got.blocked.sum() > 20
