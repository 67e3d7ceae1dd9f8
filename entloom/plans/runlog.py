"""The run log: runs, steps' runs and seen inputs, and views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entloom.sources.store import Store

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "binary": T.BinaryType()}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(c, _TYPES[t]) for c, t in columns.items()])


RUN = _struct(run_id="long", pipeline="string", version="string", status="string", started="timestamp", seconds="double", errors="long", include="strings", exclude="strings", start="string", until="string", retry="boolean")
STEP_RUN = _struct(
    run_id="long", step="string", version="string", ordering="int", tags="strings", status="string", seconds="double",
    inputs_extracted="long", inputs_unique="long", inputs_skipped="long", inputs_processed="long", rows_inserted="long", rows_updated="long", error="string",
    tables_needed="strings", columns_needed="strings", tables_yielded="strings", columns_yielded="strings",
)
SEEN = _struct(version="string", input_hash="string")
SKETCH = _struct(step="string", column="string", inputs="long", sketch="binary")

#: The step runs of the latest run; those of them that failed or were left out by a failure; what a rerun has to do: of the latest run's
#: steps that didn't complete those that never have, or that have failed since they first did.
VIEWS = {
    "current_run": "SELECT s.* FROM step_run s JOIN (SELECT max(run_id) AS run_id FROM run) r ON s.run_id = r.run_id",
    "failed_run": "SELECT * FROM current_run WHERE status IN ('failed', 'upstream_failed')",
    "steps_to_run": """
        SELECT c.step, CASE WHEN h.failed IS NULL THEN 'never run' ELSE 'failed' END AS status
        FROM current_run c
        JOIN (
            SELECT step, max(CASE WHEN status = 'failed' THEN run_id END) AS failed, min(CASE WHEN status = 'completed' THEN run_id END) AS done
            FROM step_run GROUP BY step
        ) h ON h.step = c.step
        WHERE c.status <> 'completed' AND (h.done IS NULL OR h.failed > h.done)
    """,
}


def totals(runs: DataFrame, step_runs: DataFrame, last: int) -> DataFrame:
    """Of each of the last runs: its steps, failures and the sums of its counters."""
    recent = runs.select("run_id").orderBy(F.desc("run_id")).limit(last)
    counters = ("inputs_extracted", "inputs_unique", "inputs_skipped", "inputs_processed", "rows_inserted", "rows_updated")
    sums = [F.sum(c).alias(c) for c in counters if c in step_runs.columns]
    return step_runs.join(F.broadcast(recent), "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "failed").alias("failures"), *sums)


class RunLog:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def table(self, name: str) -> DataFrame:
        return self.store.read_log(f"_log/{name}", {"run": RUN, "step_run": STEP_RUN, "seen": SEEN, "sketch": SKETCH}[name])

    def next_id(self) -> int:
        return (self.table("run").agg({"run_id": "max"}).first()[0] or 0) + 1

    def add(self, name: str, rows: list[tuple]) -> None:
        schema = {"run": RUN, "step_run": STEP_RUN}[name]
        self.store.append(f"_log/{name}", self.spark.createDataFrame(rows, schema).coalesce(1))

    def mark_seen(self, version: str, hashes: DataFrame) -> None:
        self.store.append("_log/seen", hashes.select(F.lit(version).alias("version"), "input_hash"), ("version",))

    def seen(self, version: str) -> DataFrame:
        return self.table("seen").where(F.col("version") == version).select("input_hash")

    def add_sketches(self, step: str, columns: tuple[str, ...], rows: DataFrame) -> None:
        """A row for each column: a sketch of its values in these inputs. Sketches of runs, batches and machines are merged by `distinct`."""
        made = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(14)).alias(f"s{i}") for i, c in enumerate(columns)]
        one = rows.agg(F.count(F.lit(1)).alias("n"), *made)
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)))).alias("x")
        self.store.append("_log/sketch", one.select("n", each).select(F.lit(step).alias("step"), "x.column", F.col("n").alias("inputs"), "x.sketch"))

    def distinct(self) -> DataFrame:
        """step, column, inputs and the estimated number of distinct values over all runs, within one per cent or so; nulls don't count."""
        merged = self.table("sketch").groupBy("step", "column").agg(F.sum("inputs").alias("inputs"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
        return merged

    def last(self, n: int = 1) -> DataFrame:
        """`totals` of the last n runs."""
        return totals(self.table("run"), self.table("step_run"), n)

    def views(self) -> None:
        """Register the log's tables and views as temporary views."""
        for name in ("run", "step_run"):
            self.table(name).createOrReplaceTempView(name)
        register_views(self.spark)


def register_views(spark: SparkSession) -> None:
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
