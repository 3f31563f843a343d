"""Every query of the catalogue against its SQL on the smallest tables."""

import collections
import datetime
import decimal
import os

import duckdb
import pytest

from tidewatch.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = oracle.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stream_equals_batch(spark):
    got = {tuple(r) for r in catalogue.queries()["stream_upsert"](spark, DATA).select("id", "version", "value").collect()}
    want = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id % 1000 AS id", "event_id AS version", "value").groupBy("id").agg({"version": "max"}).count()
    assert len(got) == want and len({i for i, _, _ in got}) == want


def test_community_slice_has_every_article_of_its_category(spark, tmp_path):
    rows = [(i, "t", "es" if i % 3 else "en", "s", 1) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.shown for r in catalogue.queries()["community_slice"](spark, str(tmp_path)).collect()}
    assert set(got) == {str(i) for i in range(240) if i % 3} and sum(got.values()) == 50
