import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from entloom.entity import Rule, entity
from entloom.functions.keys import content_id
from entloom.functions.typenames import spark_type
from entloom.operators.loading import keep_last, merged, orphans, spread, unseen, update, upsert, validate
from entloom.operators.relational import join_reference, project


@pytest.mark.parametrize(
    "lists, rows",
    [
        (([1], [1, 2], ["t"]), [(1, 1, "t"), (1, 2, "t")]),
        (([1], [1, 2], ["a", "b"]), [(1, 1, "a"), (1, 2, "b")]),
        (([1, 2], [1, 2], ["x"]), [(1, 1, "x"), (2, 2, "x")]),
        (([], [1, 2, 3], ["x"]), []),
    ],
)
def test_spread(spark, lists, rows):
    df = spark.createDataFrame([lists], "a array<int>, b array<int>, c array<string>")
    assert sorted(map(tuple, spread(df, ["a", "b", "c"]).collect())) == rows


def test_spread_refuses_other_lengths(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2])], "a array<int>, b array<int>")
    with pytest.raises(PySparkException, match="different lengths"):
        spread(df, ["a", "b"]).collect()


def test_null_empty_and_none_have_different_ids(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("None", "x"), ("N", "x"), ("a|V1:b", "c"), ("a", "b|V1:c")], "a string, b string")
    ids = [r[0] for r in df.select(content_id(F.col("a"), F.col("b"))).collect()]
    assert len(set(ids)) == 6 and all(len(i) == 36 for i in ids)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(max_size=5)), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=20))
def test_equal_values_equal_ids(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b int")
    ids = {r["i"]: r["id"] for r in df.select("i", content_id(F.col("a"), F.col("b")).alias("id")).collect()}
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            assert (ids[i] == ids[j]) == (x == y)


def test_upsert_keeps_what_is_not_supplied(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, x string")
    assert sorted(map(tuple, upsert(old, new, ["x"]).collect())) == [(1, "a", 10), (2, None, 20), (3, "c", None)]
    assert sorted(map(tuple, update(old, new, ["x"]).collect())) == [(1, "a", 10), (2, None, 20)]


def test_merged_columns_of_any_name(spark):
    old = spark.createDataFrame([(1, "a", 1, 0)], "id int, key string, new int, old int")
    new = spark.createDataFrame([(1, "b", 2, 3), (2, "c", 4, 5)], "id int, key string, new int, old int")
    assert sorted(map(tuple, upsert(old, new, ["key", "new", "old"]).collect())) == [(1, "b", 2, 3), (2, "c", 4, 5)]
    assert sorted(tuple(r) for r in merged(old, new, ["key"]).select("id", "key", "__state").collect()) == [(1, "b", "updated"), (2, "c", "inserted")]


def test_keep_last_breaks_ties_alike(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (2, 1, None)]
    one, two = (keep_last(spark.createDataFrame(r, "k int, t int, v string"), ["k"], ["t"]).collect() for r in (rows, rows[::-1]))
    assert sorted(one) == sorted(two) and len(one) == 2


def test_validation_modes(spark):
    e = entity("v", {"n": "int4", "s": "text", "f": "float8"}, ["n"], rules={"s": Rule(required=True), "f": Rule(ge=0, le=1)}, registry={})
    df = spark.createDataFrame([("1", "x", 0.5), ("asdf", None, 2.0), (None, "y", None)], "n string, s string, f double")
    found = {tuple(r["__errors"]) for r in validate(df, e).collect()}
    assert found == {(), ("n", "s", "f")}
    with pytest.raises(TypeError):
        validate(df, e, "strict")
    assert all(r["__errors"] == [] for r in validate(df, e, "off").collect())
    with pytest.raises(ValueError):
        validate(df.drop("s"), e)
    assert validate(df.drop("s"), e, insert=False).count() == 3


def test_rules(spark):
    r = Rule(gt=0, lt=10, multiple_of=2, one_of=(2, 4, 8))
    df = spark.createDataFrame([(0,), (2,), (3,), (6,), (8,), (10,), (None,)], "v int")
    assert [x[0] for x in df.select(r.broken(F.col("v"))).collect()] == [True, False, True, True, False, True, False]
    s = Rule(min_length=2, max_length=3, pattern="^a")
    df = spark.createDataFrame([("a",), ("ab",), ("abcd",), ("bb",), (None,)], "v string")
    assert [x[0] for x in df.select(s.broken(F.col("v"))).collect()] == [True, False, True, True, False]


def test_entity_declarations():
    reg: dict = {}
    parent = entity("parent", {"label": "text", "kind": str}, ["label"], registry=reg)
    child = entity("child", {"n": int}, ["p", "n"], {"p": parent}, registry=reg)
    assert [f.name for f in child.struct] == ["id", "n", "p", "step_id", "created_at"]
    more = entity("more", {"z": "numeric"}, ["z"], base=parent, registry=reg)
    assert more.identifying == ("label", "z") and "kind" in more.columns
    for bad in (dict(name="parent", columns={"a": "text"}), dict(name="x", columns={"_a": "text"}), dict(name="x", columns={"id": "text"}), dict(name="x", columns={"a": "text"}, identifying=["b"])):
        with pytest.raises(ValueError):
            entity(registry=reg, **bad)
    with pytest.raises(KeyError):
        spark_type("nothing")
    assert spark_type("int4[]").simpleString() == "array<int>"


def test_references(spark):
    reg: dict = {}
    a = entity("a", {"x": "text"}, ["x"], registry=reg)
    b = entity("b", {"y": "text"}, ["y"], {"a_id": a}, registry=reg)
    parents = spark.createDataFrame([("1", "p")], "id string, x string")
    kids = spark.createDataFrame([("k", "1"), ("l", "9"), ("m", None)], "y string, a_id string")
    assert [r["y"] for r in join_reference(kids, b, parents, a).collect()] == ["k"]
    assert [r["y"] for r in orphans(kids, "a_id", parents).collect()] == ["l"]
    with pytest.raises(ValueError):
        join_reference(kids, a, parents, b)
    with pytest.raises(ValueError, match="ambiguous"):
        project(kids, "y", F.col("a_id").alias("y"))
    with pytest.raises(ValueError, match="alias"):
        project(kids, F.upper("y"))


def test_unseen_is_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "input_hash string")
    assert [r[0] for r in unseen(df, spark.createDataFrame([("b",)], "input_hash string")).collect()] == ["a"]
