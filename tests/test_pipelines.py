import json

import pytest
from pyspark.sql import functions as F

from entloom.__main__ import main
from entloom.functions.keys import content_id, input_hash
from entloom.entity import Rule, entity
from entloom.functions import transforms as tr
from entloom.plans.model import Dependency, Load, Out, Pipeline, Query, Selection, Step, sort_steps, tagged
from entloom.plans.runner import Options, Runner
from entloom.sources.store import Store
from entloom.streaming.incremental import load_stream


def suffix(label, settings):
    if label == "string-0":
        raise tr.SkipRow("first")
    return label + settings["suffix"]


def broken(label):
    raise RuntimeError("never")


def strings(spark):
    return spark.range(100).select(F.concat(F.lit("string-"), F.col("id").cast("string")).alias("label"))


def family():
    reg: dict = {}
    parent = entity("parent", {"label": "text", "note": "text"}, ["label"], registry=reg)
    child = entity("child", {"label": "text"}, ["label", "parent_id"], {"parent_id": parent}, registry=reg)
    p = Pipeline("family", settings={"suffix": "-child"})

    def parents(read):
        return read(parent).select(F.col("id").alias("pid"), "label")

    p.add(Step("c children", Query(parents, {parent: ["label"]}), [tr.python(suffix, ["label"], "kid string")], [Load(child, {"label": Out("kid"), "parent_id": Out("pid")}, insert=True)], tags=("kids",)))
    p.add(Step("b parents", strings, loads=[Load(parent, {"label": Out("label")}, insert=True), Load(parent, {"label": "constant"}, insert=True)]))
    p.add(Step("d notes", Query(parents, {parent: ["label"]}), [tr.native(note=F.upper("label"))], [Load(parent, {"note": Out("note")}, id=Out("pid"))], also=Dependency(tables_needed=frozenset({child.full_name}))))
    return p, parent, child


@pytest.fixture
def runner(spark, tmp_path):
    return Runner(spark, Store(spark, "file://" + str(tmp_path / "store")))


def test_run_and_rerun(runner):
    p, parent, child = family()
    assert [s.name for s in p.sorted()] == ["b parents", "c children", "d notes"]
    first = runner.run(p)
    assert {r.status for r in first.values()} == {"completed"}, first
    assert runner.table(parent).count() == 101 and runner.table(child).count() == 100
    assert first["c children"].counts["inputs_skipped"] == 1
    assert runner.table(parent).where("note = upper(label)").count() == 101
    created = {r["id"]: r["created_at"] for r in runner.table(parent).collect()}
    second = runner.run(p)
    assert second["b parents"].counts["inputs_unique"] == 0 and second["b parents"].counts.get("rows_inserted", 0) == 0
    assert second["c children"].counts["inputs_unique"] == 0  # the skipped row was seen
    assert first["c children"].counts["inputs_extracted"] == second["c children"].counts["inputs_extracted"] == 101
    again = runner.run(p, Options(retry=True))
    assert again["b parents"].counts["rows_updated"] == 101 and again["b parents"].counts["rows_inserted"] == 0
    assert {r["id"]: r["created_at"] for r in runner.table(parent).collect()} == created
    ids = {r["id"] for r in runner.table(parent).collect()}
    assert {r["parent_id"] for r in runner.table(child).collect()} <= ids


def test_failure_policies(runner):
    p, *_ = family()
    p.steps[1] = Step("b parents", strings, [tr.python(broken, ["label"], "x string")], p.steps[1].loads)
    r = runner.run(p)
    assert [r[n].status for n in ("b parents", "c children", "d notes")] == ["failed", "completed", "completed"]
    assert "never" in r["b parents"].error
    r = runner.run(p, Options(fail_downstream=True))
    assert [r[n].status for n in ("b parents", "c children", "d notes")] == ["failed", "upstream_failed", "upstream_failed"]
    r = runner.run(p, Options(fast_fail=True, selection=Selection(exclude=frozenset({"kids"}))))
    assert [r[n].status for n in ("b parents", "c children", "d notes")] == ["failed", "excluded", "upstream_failed"]
    r = runner.run(p, Options(rerun_failed=True))
    assert r["b parents"].status == "failed"
    runner.log.views()
    assert runner.spark.table("run").count() == 4
    assert runner.spark.table("failed_run").count() == 1


def test_skip_on_error(spark):
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    t = tr.python(lambda a: int(a), ["a"], "n int", on_error="skip")
    assert [r["n"] for r in t.apply(df, {}).collect()] == [1]
    with pytest.raises(ValueError):
        tr.python(suffix, ["a", "b"], "x string")
    one, two = (tr.python(f, ["a"], "n int").version for f in (lambda a: 1, lambda a: 2))
    assert one != two


def test_invalid_rows_fail_the_step(runner):
    e = entity("strict", {"n": "int4"}, ["n"], rules={"n": Rule(lt=50)}, registry={})

    def numbers(spark):
        return spark.range(100).select(F.col("id").alias("n"))

    p = Pipeline("numbers", [Step("n", numbers, loads=[Load(e, {"n": Out("n")}, insert=True)])])
    r = runner.run(p)["n"]
    assert r.status == "failed" and "no valid n" in r.error and runner.table(e).count() == 0


def test_order_selection_and_tags(spark):
    def source(s):
        return s.range(1)

    def step(n, need=(), gives=(), **k):
        return Step(n, source, also=Dependency(tables_needed=frozenset(need), tables_yielded=frozenset(gives)), **k)

    with tagged("x"), tagged("y"):
        a = step("a", gives=["t"])
    b, c = step("b", ["t"], ["u"]), step("c", ["u"])
    assert a.tags == ("x", "y")
    steps = sort_steps([c, b, a])
    assert [s.name for s in steps] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="need each other"):
        sort_steps([step("p", ["q"], ["r"]), step("o", ["r"], ["q"])])
    assert Selection(include=frozenset({"x"})).chosen(steps) == {"a"}
    assert Selection(include=frozenset({"x"}), exclude=frozenset({"a"})).chosen(steps) == set()
    assert Selection(start="b").chosen(steps) == {"b", "c"}
    assert Selection(until="b").chosen(steps) == {"a", "b"}
    with pytest.raises(ValueError):
        Selection(include=frozenset({"nobody"})).chosen(steps)
    p, *_ = family()
    with pytest.raises(ValueError, match="two steps"):
        p.add(p.steps[0])


def test_declaration_errors(spark):
    _, parent, child = family()
    with pytest.raises(ValueError, match="no columns"):
        Load(parent, {"nope": 1})
    with pytest.raises(ValueError, match="identifying"):
        Load(child, {"label": "x"}, insert=True)
    with pytest.raises(ValueError, match="follows from"):
        Load(parent, {"label": "x"}, insert=True, id=Out("pid"))


def test_version_follows_the_code(spark):
    p, *_ = family()
    q, *_ = family()
    assert p.version == q.version
    q.settings = {"suffix": "other"}
    q.steps[1] = Step("b parents", lambda spark: strings(spark), loads=q.steps[1].loads)
    assert p.version != q.version
    assert [s["name"] for s in json.loads(p.described())["steps"]] == ["b parents", "c children", "d notes"]


def test_dry_run(runner):
    p, parent, _ = family()
    assert runner.dry_run(p.steps[1], p) == {parent.full_name: 1}


def test_stream_loads_each_input_once(spark, runner, tmp_path):
    e = entity("seen", {"k": "int8", "v": "text"}, ["k"], registry={})
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(src)
    load = Load(e, {"k": Out("k"), "v": Out("v")}, insert=True)

    def go():
        load_stream(runner, spark.readStream.schema("k long, v string").parquet(src), "s", [load], str(tmp_path / "cp")).awaitTermination()

    go()
    spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string").write.mode("append").parquet(src)
    go()
    assert sorted((r["k"], r["v"]) for r in runner.table(e).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def demo():
    return family()[0]


def test_command_line(spark, capsys):
    assert main(["list", "tests.test_pipelines:demo"]) == 0
    assert capsys.readouterr().out.split()[:2] == ["b", "parents"]
    assert main(["validate", "tests.test_pipelines:demo"]) == 0
    assert main(["describe", "tests.test_pipelines:demo"]) == 0
    with pytest.raises(ValueError):
        main(["validate", "tests.test_pipelines:demo", "--include", "nobody"])


def test_skipped_rows_can_be_tried_again(runner):
    p, *_ = family()
    runner.run(p, Options(retry_skipped=True))
    assert runner.run(p, Options(retry_skipped=True))["c children"].counts["inputs_unique"] == 1


def test_a_driver_lost_while_writing_leaves_the_version_before(runner, monkeypatch):
    store, rows = runner.store, runner.spark.range(5)
    store.write("t", rows)

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_complete", lost)
    with pytest.raises(KeyboardInterrupt):
        store.write("t", runner.spark.range(7))
    monkeypatch.undo()
    assert store.version("t") == 1 and store.read("t", rows.schema).count() == 5
    assert store.write("t", runner.spark.range(7)) == 2 and store.read("t", rows.schema).count() == 7
    with pytest.raises(Exception, match="(?i)exist"):
        store._complete("t", 2)  # a second writer


def test_a_step_that_breaks_in_its_third_batch_goes_on_there(runner, monkeypatch):
    e = entity("many", {"n": "int8"}, ["n"], registry={})

    def numbers(spark):
        return spark.range(100).select(F.col("id").alias("n"))

    p = Pipeline("batched", [Step("take", numbers, loads=[Load(e, {"n": Out("n")}, insert=True)], batches=5)])
    whole, calls = runner._run_batch, []

    def breaking(batch, *rest):
        calls.append(batch.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        whole(batch, *rest)

    monkeypatch.setattr(runner, "_run_batch", breaking)
    first = runner.run(p)["take"]
    assert first.status == "failed" and "lost" in first.error
    done = sum(calls[:2])
    assert runner.table(e).count() == done == first.counts["inputs_processed"] and 0 < done < 100
    assert runner.log.seen(p.steps[0].version).count() == done
    again = runner.run(p, Options(rerun_failed=True))["take"]
    assert again.status == "completed" and again.counts["inputs_unique"] == 100 - done == sum(calls[3:])
    assert calls[3] == calls[4] == 0 and calls[5] == calls[2]  # the third batch is the first with work left
    assert runner.table(e).count() == 100 and runner.log.seen(p.steps[0].version).distinct().count() == 100
    with pytest.raises(ValueError, match="batches"):
        Step("x", numbers, order_by=("n",), batches=2)


def test_sketches_of_two_runs_are_merged(runner):
    e = entity("seen", {"n": "int8"}, ["n"], registry={})
    for upto in (3000, 9000):
        def numbers(spark, upto=upto):
            return spark.range(upto).select(F.col("id").alias("n"), (F.col("id") % 1000).alias("m"), F.lit(None).cast("int").alias("none"))

        step = Step("take", numbers, loads=[Load(e, {"n": Out("n")}, insert=True)], sketches=("n", "m", "none"))
        assert runner.run(Pipeline("sketched", [step]))["take"].status == "completed"
    got = {r["column"]: r for r in runner.log.distinct().collect()}
    assert abs(got["n"]["distinct"] - 9000) < 270 and abs(got["m"]["distinct"] - 1000) < 30 and got["none"]["distinct"] == 0
    assert runner.log.table("sketch").count() == 6


def test_failed_steps_leave_no_temporary_tables(runner, tmp_path):
    p, *_ = family()
    p.steps[1] = Step("b parents", strings, [tr.python(broken, ["label"], "x string")], p.steps[1].loads)
    assert runner.run(p)["b parents"].status == "failed"
    assert not list((tmp_path / "store").glob("_tmp/*"))


def test_reads_are_found_in_the_plan(spark):
    p, parent, child = family()
    found = Query(lambda read: read(child).alias("c").join(read(parent).alias("p"), F.expr("c.parent_id = p.id")).where("p.note <> ''").select(F.col("c.label"))).dependency
    assert found.tables_needed == {parent.full_name, child.full_name}
    assert found.columns_needed == {f"{parent.full_name}.id", f"{parent.full_name}.note", f"{child.full_name}.label", f"{child.full_name}.parent_id"}
    step = Step("d", Query(lambda read: read(parent).groupBy("label").agg(F.count(F.lit(1)).alias("n"))))
    assert step.dependency.columns_needed == {f"{parent.full_name}.label"}


def test_reads_of_equal_layouts_and_self_joins(spark):
    """Two entities with the same columns are told apart; so are a table's copies in a self-join, and subqueries are looked into."""
    reg: dict = {}
    a, b = (entity(n, {"x": "int4", "y": "int4"}, ["x"], registry=reg) for n in "ab")
    of = Query(lambda read: read(a).select("x").crossJoin(read(b).select("y"))).dependency
    assert of.columns_needed == {"public.a.x", "public.b.y"}

    def joined(read):
        one = read(a)
        return one.alias("l").join(one.alias("r"), F.expr("l.x = r.y")).select("l.id")

    assert Query(joined).dependency.columns_needed == {"public.a.id", "public.a.x", "public.a.y"}

    def nested(read):
        return spark.sql("SELECT id FROM {a} o WHERE x > (SELECT max(y) FROM {b}) AND EXISTS (SELECT 1 FROM {c} c WHERE c.y = o.x)", a=read(a), b=read(b), c=read(b))

    assert Query(nested).dependency.columns_needed == {"public.a.id", "public.a.x", "public.b.y"}
    other = entity("a", {"z": "int4"}, ["z"], registry={})
    with pytest.raises(ValueError, match="two entities"):
        Query(lambda read: read(a).crossJoin(read(other)))
    first = Step("first", Query(lambda read: read(a).select("x")), loads=[Load(b, {"x": Out("x"), "y": 1}, insert=True)])
    second = Step("second", Query(lambda read: read(b).select("y")))
    assert [s.name for s in sort_steps([second, first])] == ["first", "second"]  # no false cycle


@tr.transform("total int, text string")
def added(a: int | None, b: str) -> tuple:
    return (None if a is None else a + 1), f"{type(a).__name__} {b}"


def test_decorated_functions(spark):
    df = spark.createDataFrame([(1, "x", [1, None], ["p"]), (None, "y", [], ["q"])], "a int, b string, xs array<int>, ys array<string>")
    assert added(1, "z") == (2, "int z")
    assert [tuple(r) for r in added.on("a", "b").apply(df, {}).select("total", "text").collect()] == [(2, "int x"), (None, "NoneType y")]
    assert [tuple(r) for r in added.map("xs", "ys").apply(df, {}).select("total", "text").collect()] == [([2, None], ["int p", "NoneType p"]), ([], [])]


def test_ids_of_instants_are_the_same_in_every_zone(spark):
    df = spark.sql("SELECT timestamp_seconds(1600000000) AS t")
    was, got = spark.conf.get("spark.sql.session.timeZone"), set()
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got.add(df.select(content_id(F.col("t")).alias("i"), input_hash("v", {"t": F.col("t")}).alias("h")).first())
    spark.conf.set("spark.sql.session.timeZone", was)
    assert len(got) == 1
