"""Pipelines written and read again; expressions as SQL."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from entloom.entity import Rule, entity
from entloom.functions import transforms as tr
from entloom.functions.sqltext import sql_of
from entloom.plans import codec
from entloom.plans.model import Load, Out, Pipeline, Query, Step
from entloom.plans.runner import Runner
from entloom.sources.store import Store

ROWS = "a int, b struct<c:string,`odd name`:int>, xs array<int>, s string, t timestamp"


@pytest.mark.parametrize(
    "make",
    [
        lambda: F.upper("s"),
        lambda: (F.col("a") + 1) * 2 - F.col("b.odd name"),
        lambda: ~((F.col("a") > 1) & F.col("s").rlike("^\\w'x")) | F.col("a").isNull(),
        lambda: F.when(F.col("a").isin(1, 2), "it's").when(F.col("a") == 3, F.lit(None)).otherwise(F.concat("s", F.lit("\\ \n"))),
        lambda: F.transform("xs", lambda x: x + F.col("a")),
        lambda: F.aggregate("xs", F.lit(0), lambda acc, x: acc + x),
        lambda: F.col("s").try_cast("int"),
        lambda: F.col("a").cast("decimal(10,2)"),
        lambda: F.struct("a", F.lit(1.5).alias("k")),
        lambda: F.col("xs")[0] + F.element_at("xs", -1),
        lambda: F.lit(True) & F.lit(1 << 40).isNotNull(),
        lambda: F.expr("a + 1"),
        lambda: F.date_format("t", "yyyy") == F.lit("2024"),
        lambda: F.coalesce(F.col("b")["c"], F.lit("x")),
    ],
)
def test_sql_means_the_same(spark, make):
    df = spark.createDataFrame([(1, ("c", 2), [1, 2], "1", None), (3, (None, None), [5], "w'x", None), (None, None, [7], None, None)], ROWS)
    text = sql_of(make())
    got = df.select(make().alias("x"), F.expr(text).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in got)
    assert sql_of(F.expr(text)) == text


def test_what_has_no_sql_is_told(spark):
    with pytest.raises(ValueError, match="no SQL"):
        sql_of(F.udf(lambda x: x)("a"))
    with pytest.raises(ValueError, match="no SQL"):
        sql_of(F.sum("a").over(Window.partitionBy("b")))


SUFFIX = "-kid"


def helper(label):
    return label + SUFFIX


def named(label, settings):
    if label.endswith("3"):
        raise tr.SkipRow(label)
    return helper(label) + settings["mark"], len(label)


def family():
    reg: dict = {}
    parent = entity("parent", {"label": "text", "note": "text", "size": "numeric"}, ["label"], rules={"label": Rule(required=True, one_of=(), max_length=20)}, registry=reg)
    child = entity("child", {"label": "text", "n": "int4", "codes": "int4[]"}, ["label", "parent_id"], {"parent_id": parent}, registry=reg)

    def labels(spark):
        return spark.range(30).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("label"), F.sequence(F.lit(1), F.lit(3)).alias("xs"))

    def parents(read):
        return read(parent).where("label <> 's9'").select(F.col("id").alias("pid"), "label")

    codes = tr.map_lists("codes", lambda x: x * 2, "xs")
    p = Pipeline("family", settings={"mark": "!"})
    p.add(Step("parents", labels, [tr.keep(F.col("label") != "s8")], [Load(parent, {"label": Out("label"), "note": F.upper("label")}, insert=True)], tags=("first",)))
    kid = tr.python(named, ["label"], "kid string, n int")
    p.add(Step("children", Query(parents), [kid, tr.native(xs=F.array(F.col("n"))), codes], [Load(child, {"label": Out("kid"), "n": Out("n"), "codes": Out("codes"), "parent_id": Load(parent, {"label": Out("label")})}, insert=True)]))
    return p, parent, child


def contents(runner, entities):
    return [sorted(map(str, runner.table(e).drop("created_at").collect())) for e in entities]


def test_a_pipeline_read_in_a_fresh_process_gives_the_same_tables(spark, tmp_path):
    p, *entities = family()
    text = codec.dumps(p)
    assert codec.loads(codec.dumps(codec.loads(text))).version == p.version
    runner = Runner(spark, Store(spark, "file://" + str(tmp_path / "here")))
    assert {r.status for r in runner.run(p).values()} == {"completed"}
    at = tmp_path / "family.json"
    at.write_text(text)
    code = """
import sys
from pyspark.sql import SparkSession
from entloom.__main__ import main
SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
sys.exit(main(["run", sys.argv[1], "--store", sys.argv[2]]))
"""
    there = "file://" + str(tmp_path / "there")
    here = os.path.dirname(os.path.dirname(os.path.abspath(codec.__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": os.path.dirname(here)}
    done = subprocess.run([sys.executable, "-c", code, str(at), there], capture_output=True, text=True, cwd=str(tmp_path), env=env, timeout=300)
    assert done.returncode == 0, done.stdout[-2000:] + done.stderr[-2000:]
    assert "children: completed" in done.stdout
    other = Runner(spark, Store(spark, there))
    assert contents(other, entities) == contents(runner, entities)
    assert len(contents(other, entities)[1]) == 25  # 30 labels without s8, s9, and those that end in 3
    assert other.run(p)["children"].counts["inputs_unique"] == 0  # the same versions, so all inputs were seen


def test_a_changed_file_is_refused(spark):
    said = json.loads(codec.dumps(family()[0]))
    said["steps"][0]["loads"][0]["columns"]["note"]["sql"] = "lower(label)"
    with pytest.raises(ValueError, match="version"):
        codec.loads(json.dumps(said))
    with pytest.raises(ValueError, match="format"):
        codec.loads("{}")
    odd = tr.Transform(lambda df, _: df, "v", ())
    with pytest.raises(ValueError, match="can't be written"):
        codec.dumps(Pipeline("p", [Step("s", helper, [odd])]))
