"""Python extracts, databases over JDBC (Derby, which Spark brings) and listings."""

import datetime as dt
from collections.abc import Iterator

import pytest
from pyspark.sql import functions as F

from entloom.entity import entity
from entloom.plans.model import Load, Out, Pipeline, Step
from entloom.plans.runner import Runner
from entloom.sources.files import Connection, database, database_partitioned, extract, listed, listed_contents, masked, optional, write_database
from entloom.sources.store import Store


@extract(["n", "text"])
def simple(n: int = 10) -> tuple[int, str]:
    for i in range(n):
        yield i, str(i)


@extract
def of_settings(settings) -> Iterator[tuple[int, str | None, list[float]]]:
    for i in range(settings["n_value"]):
        yield i, None, [i / 2]


@extract("n long, part string", parts=["a", "b", "c"])
def in_parts(start: int, part: str):
    yield from ((start + k, part) for k in range(4))


def test_outputs_follow_from_annotations(spark):
    assert simple.outputs.simpleString() == "struct<n:bigint,text:string>"
    assert of_settings.outputs.simpleString() == "struct<out0:bigint,out1:string,out2:array<double>>"
    assert sorted(map(tuple, simple()(spark).collect())) == sorted((i, str(i)) for i in range(10))
    assert simple(100)(spark).count() == 100
    assert of_settings()(spark, {"n_value": 3}).collect()[2]["out2"] == [1.0]
    with pytest.raises(ValueError, match="settings"):
        of_settings()(spark)
    with pytest.raises(ValueError, match="names"):
        extract(["one"])(simple.function)
    with pytest.raises(ValueError, match="annotation"):
        extract(lambda: iter(()))


def test_the_number_of_arguments_is_checked_when_bound(spark):
    with pytest.raises(TypeError):
        simple(1, 2)
    with pytest.raises(TypeError):
        in_parts()
    with pytest.raises(ValueError, match="part"):
        extract("n long", parts=[1])(lambda: iter(()))
    with pytest.raises(ValueError, match="part"):
        extract("n long")(lambda part: iter(()))


def test_parts_are_tasks(spark):
    df = in_parts(5)(spark)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == sorted((5 + k, p) for p in "abc" for k in range(4))


def test_an_extract_in_a_pipeline(spark, tmp_path):
    e = entity("number", {"n": "int8", "text": "text"}, ["n"], registry={})
    runner = Runner(spark, Store(spark, "file://" + str(tmp_path)))
    for size in (10, 10, 20):
        p = Pipeline("numbers", [Step("take", simple(size), loads=[Load(e, {"n": Out("n"), "text": Out("text")}, insert=True)])])
        result = runner.run(p)["take"]
        assert result.status == "completed" and result.counts["inputs_extracted"] == size
    assert runner.table(e).count() == 20
    # What is bound belongs to the version.
    assert Step("s", simple(1)).version != Step("s", simple(2)).version and Step("s", simple(1)).version == Step("s", simple(1)).version
    with_settings = Pipeline("set", [Step("s", of_settings(), loads=[Load(e, {"n": Out("out0")}, insert=True)])], {"n_value": 30})
    assert runner.run(with_settings)["s"].counts["rows_inserted"] == 10


def test_addresses(spark):
    c = Connection.parse("postgresql://admin:p%40ss@address:9999/test_db?sslmode=require")
    assert (c.scheme, c.user, c.password, c.host, c.port, c.database) == ("postgresql", "admin", "p@ss", "address", 9999, "test_db")
    assert c.url == "jdbc:postgresql://address:9999/test_db?sslmode=require" and c.properties == {"user": "admin", "password": "p@ss"}
    assert str(c) == "postgresql://admin:***@address:9999/test_db" and "p@ss" not in repr(c)
    assert c == Connection.parse("postgresql://admin:other@address:9999/test_db?sslmode=require")
    assert Connection.parse("postgres:///db").port == 5432 and Connection.parse("postgresql+driver://h/db").host == "h"
    assert Connection.parse("sqlserver://h/db").url == "jdbc:sqlserver://h:1433;databaseName=db"
    for bad in ("postgresql://u:secret@h", "nothing", "jdbc:derby:x"):
        with pytest.raises(ValueError) as said:
            Connection.parse(bad)
        assert "secret" not in str(said.value)
    assert masked("mysql://u:p@h/d") == "mysql://u:***@h/d"


def test_a_database_is_written_checked_and_read_in_parts(spark):
    db = Connection.parse("derby:///memory:shop?create=true")
    assert db.check(spark) is None
    assert "none" in Connection.parse("derby:///memory:none").check(spark)
    rows = spark.range(1000).select(F.col("id").cast("int").alias("K"), F.concat(F.lit("v"), F.col("id") % 7).alias("V"), F.when(F.col("id") % 2 == 0, F.col("id") * 1.5).alias("X"))
    write_database(rows, db, "THINGS")
    whole = database(spark, db, "SELECT * FROM THINGS")
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows.collect()))
    parted = database_partitioned(spark, db, "SELECT K, V FROM THINGS WHERE X IS NOT NULL", "K", 4)
    assert parted.rdd.getNumPartitions() == 4 and parted.count() == 500
    assert database_partitioned(spark, db, "SELECT K FROM THINGS WHERE K < 0", "K", 4).count() == 0
    pushed = whole.where("K > 990").select("V")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(K,990)" in pushed
    with pytest.raises(Exception, match="(?i)exist"):
        write_database(rows, db, "THINGS")


def test_ten_thousand_names_are_listed_unopened(spark, tmp_path):
    for d in range(10):
        (tmp_path / f"in/d{d}").mkdir(parents=True)
        for i in range(1000):
            (tmp_path / f"in/d{d}/f{i:03d}.txt").touch()
    (tmp_path / "in/d3/deep").mkdir()
    (tmp_path / "in/d3/deep/f001.txt").write_text("deep")
    (tmp_path / "in/d3/f001.txt").write_text("not empty")
    root = "file://" + str(tmp_path / "in")
    assert listed(spark, root, page=999).count() == 10_001
    (tmp_path / "in/d3/f001.txt").chmod(0)
    got = listed(spark, root, "d3/f0", r"[02468]\.txt$", page=17).collect()
    assert sorted(r["key"] for r in got) == [f"d3/f{i:03d}.txt" for i in range(0, 100, 2)]
    one = listed(spark, root, "d3/", r"f001").orderBy("key").collect()
    assert [(r["key"], r["size"]) for r in one] == [("d3/deep/f001.txt", 4), ("d3/f001.txt", 9)]
    assert abs(one[0]["modified"] - dt.datetime.now()) < dt.timedelta(minutes=5)
    assert listed(spark, root, "d3/", r"f001", recursive=False).count() == 1
    assert listed(spark, root, "none/").count() == 0
    (tmp_path / "in/d3/f001.txt").chmod(0o600)
    assert {r["key"]: bytes(r["contents"]) for r in listed_contents(spark, root, "d3/", "f001").collect()} == {"d3/deep/f001.txt": b"deep", "d3/f001.txt": b"not empty"}


def test_a_missing_package_is_told():
    with pytest.raises(ImportError, match="listing needs the package nowhere_to_be_found"):
        optional("nowhere_to_be_found.sub", "listing")
    assert optional("json", "anything").dumps(1) == "1"
