import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entloom.functions.texts import as_text, escaped, flat
from entloom.operators.relational import project


def test_lists_of_any_depth_become_flat(spark):
    rows = [([[[1, 2], [3]], [[], None], None, [[None, 4]]],), (None,), ([],)]
    df = spark.createDataFrame(rows, "x array<array<array<int>>>")
    assert [r[0] for r in df.select(flat(F.col("x"), df.schema["x"].dataType)).collect()] == [[1, 2, 3, None, 4], None, []]
    one = spark.createDataFrame([([1],)], "x array<int>")
    assert one.select(flat(F.col("x"), one.schema["x"].dataType)).first()[0] == [1]
    with pytest.raises(TypeError):
        flat(F.col("x"), T.IntegerType())


def test_texts_are_escaped(spark):
    df = spark.createDataFrame([("a\\b\nc\rd\te",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(escaped(F.col("x"))).collect()] == ["a\\\\b\\nc\\rd\\te", "", None]


def test_values_as_text(spark):
    row = ("a\tb", b"x\n", dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.timedelta(days=1, microseconds=5), decimal.Decimal("1.50"), 2.5, True, ["p\n", None], (1, None))
    schema = "s string, b binary, d date, n timestamp_ntz, i interval day to second, q decimal(5,2), f double, t boolean, l array<string>, r struct<a:int,b:string>"
    df = spark.createDataFrame([row, (None,) * 10], schema)
    got = df.select(*(as_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).collect()
    assert tuple(got[0]) == ("a\\tb", "x\\n", "2024-02-29", "2024-01-02T03:04:05.000006", "86400.000005", "1.50", "2.5", "true", '["p\\\\n",null]', '{"a":"1","b":null}')
    assert tuple(got[1]) == (None,) * 10
    at = spark.sql("SELECT timestamp_seconds(1600000000) AS t")
    was, texts = spark.conf.get("spark.sql.session.timeZone"), set()
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        texts.add(at.select(as_text(F.col("t"), T.TimestampType())).first()[0])
    spark.conf.set("spark.sql.session.timeZone", was)
    assert texts == {"2020-09-13T12:26:40.000000+00:00"}


def test_names_are_asked_for_and_brackets_allowed(spark):
    df = spark.createDataFrame([(1, (2,))], "a int, s struct<b:int>")
    assert project(df, "a", F.col("a").alias("total (net)"), F.col("s.b"), F.col("s")["b"].alias("c"), F.expr("a + 1 AS d")).columns == ["a", "total (net)", "b", "c", "d"]
    for odd in (F.upper("a"), F.col("a") + 1, F.lit(1), F.expr("a + 1")):
        with pytest.raises(ValueError, match="alias"):
            project(df, odd)
