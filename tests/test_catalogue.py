"""Every registered query against its SQL, over the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from entloom import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(sf_dir + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert ours == theirs


def test_whole_texts_are_spread(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["count"] for r in catalogue.QUERIES["broadcast_explode"](spark, sf_dir).groupBy("doc_id").count().collect()}
    assert got == {r["doc_id"]: len(r["text"].split(" ")) for r in docs if r["text"] is not None} and any(len(r["text"] or "") > 200 for r in docs)


def test_seen_inputs_grow_with_the_table(spark, sf_dir, tmp_path):
    """Ten times the rows, all of other users: ten times as many are seen and left out."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    left = []
    for times in (1, 10):
        at = str(tmp_path / str(times))
        rows = spark.range(1, times * n + 1).selectExpr("id AS event_id", "'e' AS event_type", "id AS user_id")
        rows.write.parquet(f"{at}/events.parquet")
        left.append(times * n - catalogue.QUERIES["repeat_antijoin"](spark, at).count())
    assert left == [(n - 1) // 10, (10 * n - 1) // 10]
