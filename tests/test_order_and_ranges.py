"""Row numbers, running sums, as-of and range joins, and tables in buckets, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from entloom.entity import entity
from entloom.operators.intervals import asof_join, overlap_join, range_join, range_totals
from entloom.operators.loading import merged, upsert
from entloom.operators.numbering import number_rows, running_sum
from entloom.sources.store import Store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_with_ties_nulls_and_equal_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3])) for _ in range(500)] + [("hot", 1)] * 700
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = number_rows(df, ["v"], ["g"], total="n", parts=9).collect()
    for g in {r["g"] for r in got}:
        mine = sorted((r["number"], r["v"] is not None, r["v"] or 0, r["n"]) for r in got if r["g"] == g)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and {m[3] for m in mine} == {len(mine)}
        assert [m[1:3] for m in mine] == sorted(m[1:3] for m in mine)
    again = number_rows(df.repartition(3), ["v"], ["g"], total="n").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # whatever the dealing
    assert number_rows(df.limit(0), ["v"]).count() == 0
    with_desc = number_rows(df, [F.desc("v")]).where("number = 1").first()
    assert with_desc["v"] == 3


def test_a_hot_group_is_dealt_into_ranges(spark):
    """Of 10,000 equal rows no range has more than a few."""
    out = number_rows(spark.range(10_000, numPartitions=6).select(F.lit(1).alias("v")), ["v"], parts=16)
    assert "Window" not in plan_of(out)
    assert out.groupBy(((F.col("number") - 1) / 1000).cast("int")).count().count() == 10
    from entloom.operators.numbering import ranged

    sizes = [r["count"] for r in ranged(spark.range(10_000, numPartitions=6).select(F.lit(1).alias("v")), [], ["v"], 16).groupBy("__range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2500


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    got = {(r["g"], r["i"]): r["running"] for r in running_sum(spark.createDataFrame(rows, "g string, i int, v int"), "v", ["i"], ["g"], parts=5).collect()}
    total = {"a": 0, "b": 0}
    for g, i, v in rows:
        total[g] += v or 0
        assert got[g, i] == total[g]


@pytest.mark.parametrize("equal, forward", [(True, False), (False, False), (True, True), (False, True)])
def test_asof_join_equals_a_plain_loop(spark, equal, forward):
    rng = random.Random(3)
    left = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([None, rng.randrange(60)])) for i in range(300)]
    right = [(1000 + i, rng.choice(["hot", "b", "c", None]), rng.choice([None, rng.randrange(60)])) for i in range(150)]
    got = asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "j int, rk string, rt int"), ("t", "rt"), [("k", "rk")], ties=["j"], equal=equal, forward=forward, parts=8).collect()
    assert len(got) == len(left)
    for r in got:
        def fits(x):
            gap = (x - r["t"]) if forward else (r["t"] - x)
            return gap > 0 or equal and gap == 0

        found = [(rt, j) for j, k, rt in right if r["t"] is not None and rt is not None and k == r["k"] and k is not None and fits(rt)]
        want = (min if forward else max)(found, key=lambda x: (x[0], -x[1] if forward else x[1]), default=(None, None))
        assert (r["rt"], r["j"]) == want


def test_asof_join_within_a_distance_and_without_a_side(spark):
    left = spark.createDataFrame([(1, 10), (2, 30)], "i int, t int")
    right = spark.createDataFrame([(7, 9), (8, 12)], "j int, rt int")
    near = asof_join(left, right, ("t", "rt"), within=F.col("t") - F.col("rt") < 5)
    assert sorted(map(tuple, near.collect()), key=str) == [(1, 10, 7, 9), (2, 30, None, None)]
    assert asof_join(left, right.limit(0), ("t", "rt")).where("j is null").count() == 2
    assert asof_join(left.limit(0), right, ("t", "rt")).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left, left, ("t", "t"))


def test_range_join_equals_a_plain_loop(spark):
    """Intervals from empty to a million times the least; cells never make a nested loop."""
    rng = random.Random(4)
    points = [(i, rng.choice([None, rng.uniform(-1e6, 1e6), float(rng.randrange(-50, 50))]), rng.choice("ab")) for i in range(400)]
    spans = [(i, *(lambda a, w: (a, a + w))(rng.uniform(-1e6, 1e6) if i % 2 else float(rng.randrange(-50, 50)), rng.choice([0.0, 1.0, 30.0, 1e3, 1e6])), rng.choice("ab")) for i in range(200)] + [(900, 5.0, 1.0, "a"), (901, None, 3.0, "a")]
    p, s = spark.createDataFrame(points, "i int, at double, k string"), spark.createDataFrame(spans, "j int, lo double, hi double, kk string")
    for by in ([], [("k", "kk")]):
        out = range_join(p, s, "at", "lo", "hi", by)
        assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
        want = sorted((i, j) for i, at, k in points for j, lo, hi, kk in spans if at is not None and lo is not None and lo <= at <= hi and (not by or k == kk))
        assert sorted((r["i"], r["j"]) for r in out.collect()) == want
    cells = range_join(p, s, "at", "lo", "hi", width=1.0)  # of a poor width too, no interval has many cells
    assert sorted((r["i"], r["j"]) for r in cells.collect()) == sorted((i, j) for i, at, _ in points for j, lo, hi, _ in spans if at is not None and lo is not None and lo <= at <= hi)


def test_range_totals_equal_a_plain_loop(spark):
    rng = random.Random(7)
    points = [(i, rng.choice([None, -0.0, 0.0, float("inf"), round(rng.uniform(-9, 9), 1)])) for i in range(300)] + [(None, 1.0), (None, 20.5)]
    spans = [(j % 60, a, a + rng.choice([0.0, 0.1, 3.0, 50.0, -1.0])) for j in range(90) for a in [rng.choice([0.0, -0.0, round(rng.uniform(-12, 12), 1)])]] + [(61, None, 1.0), (62, 20.0, 21.0), (63, 0.0, float("inf"))]
    p, s = spark.createDataFrame(points, "v long, at double"), spark.createDataFrame(spans, "k long, lo double, hi double")
    pairs = [(k, v) for k, lo, hi in spans if lo is not None for v, x in points if x is not None and lo <= x <= hi]
    want = {k: (sum(x == k for x, _ in pairs), None if all(v is None for x, v in pairs if x == k) else sum(v or 0 for x, v in pairs if x == k)) for k, _ in pairs}
    assert {r["k"]: (r["n"], r["total"]) for r in range_totals(p, s, "at", "lo", "hi", "k", "v").collect()} == want
    assert range_totals(p.limit(0), s, "at", "lo", "hi", "k", "v").count() == 0


def test_range_totals_make_no_pairs(spark):
    """Ten billion pairs of points and intervals."""
    p, s = spark.range(100_000).select(F.col("id").alias("v"), (F.col("id") % 5).cast("double").alias("at")), spark.range(100_000).select(F.col("id").alias("k"), F.lit(0.0).alias("lo"), F.lit(4.0).alias("hi"))
    got = range_totals(p, s, "at", "lo", "hi", "k", "v").agg(F.count(F.lit(1)), F.min("n"), F.max("total")).first()
    assert tuple(got) == (100_000, 100_000, 99_999 * 50_000)


def test_range_join_of_instants_and_dates(spark):
    days = [dt.datetime(2024, 3, 30, h) + dt.timedelta(days=d) for d in range(3) for h in (0, 1, 2, 3, 23)]
    rows = [(i, d, d, d.date()) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "i int, t timestamp, n timestamp_ntz, d date")
    for c in "tnd":
        spans = df.where("i % 4 = 0").select(F.col("i").alias("j"), F.col(c).alias("lo"), (F.col(c) + F.expr("interval 1 day")).cast(df.schema[c].dataType).alias("hi"))
        got = range_join(df.select("i", c), spans, c, "lo", "hi").select("i", "j").collect()
        want = df.select("i", c).join(spans, F.col(c).between(F.col("lo"), F.col("hi"))).select("i", "j").collect()
        assert sorted(got) == sorted(want) and got
    with pytest.raises(TypeError):
        range_join(spark.sql("SELECT 'a' AS x"), spark.sql("SELECT 'a' AS lo, 'b' AS hi"), "x", "lo", "hi", width=1.0)


def test_overlaps_equal_a_plain_loop(spark):
    rng = random.Random(5)
    one = [(i, a, a + rng.randrange(20)) for i in range(80) for a in [rng.randrange(300)]] + [(900, 9, 3)]
    two = [(i, a, a + rng.choice([0, 3, 200])) for i in range(60) for a in [rng.randrange(300)]]
    got = overlap_join(spark.createDataFrame(one, "i int, a int, b int"), spark.createDataFrame(two, "j int, c int, d int"), ("a", "b"), ("c", "d")).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted((i, j) for i, a, b in one for j, c, d in two if a <= b and a <= d and c <= b)


# -- tables in buckets --------------------------------------------------------------------------


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def people():
    return entity("person", {"n": "int8", "v": "text"}, ["n"], registry={})


def keyed_rows(df, e):
    return df.withColumn("id", e.key({"n": F.col("n")})).cache()


def test_an_upsert_leaves_untouched_buckets_in_place(spark, tmp_path):
    e, store = people(), Store(spark, "file://" + str(tmp_path), bucket_rows=100)

    def load(df, *supplied):
        return store.merge(e.full_name, e.struct, keyed_rows(df, e), lambda old, new: merged(old, new, supplied))

    n = 2000
    assert load(spark.range(n).select(F.col("id").alias("n"), F.lit("old").alias("v")), "n", "v") == {"kept": 0, "updated": 0, "inserted": n}
    assert store.manifest(e.full_name).buckets == 64 and store.manifest(e.full_name).rows == n  # split as it grew
    before = files(tmp_path)
    found = load(spark.range(n // 100).select((F.col("id") * 97 % n).alias("n"), F.lit("new").alias("v")), "n", "v")
    assert found["updated"] == 20 and found["inserted"] == 0
    after, manifest = files(tmp_path), store.manifest(e.full_name)
    at = store.version(e.full_name)
    touched = [b for b, v in manifest.written.items() if v == at]
    assert 1 <= len(touched) <= 20 < len(manifest.written)
    current = {p for p in after if any(f"/v{v}/bucket={b}/" in p for b, v in manifest.written.items())}
    kept = {p for p in current if f"/v{at}/" not in p}
    assert len({p.split("bucket=")[1].split("/")[0] for p in kept}) == len(manifest.written) - len(touched)
    assert all(before[p] == after[p] for p in kept)
    rows = {r["n"]: r["v"] for r in store.read(e.full_name, e.struct).collect()}
    assert rows == {i: "new" if i % 97 == 0 and i // 97 < 20 or any(k * 97 % n == i for k in range(20)) else "old" for i in range(n)}


def test_merges_equal_whole_upserts_and_old_files_go(spark, tmp_path):
    rng = random.Random(7)
    e, store = people(), Store(spark, "file://" + str(tmp_path), bucket_rows=30)
    want = spark.createDataFrame([], e.struct)
    for k in range(5):
        new = keyed_rows(spark.createDataFrame([(i, rng.choice([None, f"v{k}"])) for i in rng.sample(range(300), 60)], "n long, v string"), e)
        want = spark.createDataFrame(upsert(want, new, ["n", "v"]).collect(), e.struct)
        store.merge(e.full_name, e.struct, new, lambda old, fresh: merged(old, fresh, ["n", "v"]))
        assert sorted(map(tuple, store.read(e.full_name, e.struct).collect())) == sorted(map(tuple, want.collect()))
    assert len(list((tmp_path / "public.person" / "_versions").glob("[0-9]*"))) == 2
    used = {(b, v) for at in (store.version(e.full_name), store.version(e.full_name) - 1) for b, v in store.manifest(e.full_name, at).written.items()}
    there = {(int(p.name.split("=")[1]), int(p.parent.name[1:])) for p in tmp_path.rglob("bucket=*")}
    assert there == used
    assert store.merge(e.full_name, e.struct, keyed_rows(spark.createDataFrame([], "n long, v string"), e), lambda old, fresh: merged(old, fresh, ["n", "v"]))["inserted"] == 0


def test_a_merge_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    e, store = people(), Store(spark, "file://" + str(tmp_path))

    def load(v):
        return store.merge(e.full_name, e.struct, keyed_rows(spark.range(50).select(F.col("id").alias("n"), F.lit(v).alias("v")), e), lambda old, new: merged(old, new, ["n", "v"]))

    load("one")
    monkeypatch.setattr(store, "_complete", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        load("two")
    monkeypatch.undo()
    assert {r["v"] for r in store.read(e.full_name, e.struct).collect()} == {"one"}
    assert load("three")["updated"] == 50
    assert {r["v"] for r in store.read(e.full_name, e.struct).collect()} == {"three"}


def test_a_version_of_many_buckets_is_one_path(spark, tmp_path):
    e = entity("e", {"k": "int8"}, ["k"], registry={})
    store = Store(spark, str(tmp_path))
    rows = spark.range(500).select(e.key({"k": F.col("id")}).alias("id"), F.col("id").alias("k"))
    store.create("t")
    assert store.is_empty("t")
    assert store.merge("t", e.struct, rows, lambda old, new: merged(old, new, ["k"]))["inserted"] == 500
    read = store.read("t", e.struct)
    assert "(1 paths)" in plan_of(read) and read.columns == e.struct.names and read.count() == 500
    one = rows.where("k = 7").withColumn("k", F.lit(-7).cast("long"))
    assert store.merge("t", e.struct, one, lambda old, new: merged(old, new, ["k"]))["updated"] == 1
    read = store.read("t", e.struct)
    assert (read.count(), read.agg(F.sum("k")).first()[0]) == (500, sum(range(500)) - 14) and plan_of(read).count("(1 paths)") == 2


def test_a_first_load_without_transforms_stores_its_rows_once(spark, tmp_path, monkeypatch):
    from entloom.plans.model import Load, Out, Pipeline, Step
    from entloom.plans.runner import Runner

    written, write = [], Store.write
    monkeypatch.setattr(Store, "write", lambda self, path, *more: written.append(path) or write(self, path, *more))
    e = entity("e", {"k": "int8"}, ["k"], registry={})
    step = Step("s", lambda s: s.range(20).select(F.col("id") % 10), loads=[Load(e, {"k": Out("(id % 10)")}, insert=True)])
    result = Runner(spark, Store(spark, str(tmp_path))).run(Pipeline("p", [step]))["s"]
    assert result.status == "completed", result.error
    assert [result.counts[n] for n in ("inputs_extracted", "inputs_unique", "inputs_processed", "rows_inserted")] == [20, 10, 10, 10]
    assert len(written) == 1
