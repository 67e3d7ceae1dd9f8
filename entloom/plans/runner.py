"""Running a pipeline: steps in order, each one lazy lineage from its source to its entities.

A step's inputs that this version of it has done before are left out by an anti join on their
hashes. The rest passes the transforms once and is written to the shared folder, as every load reads it; then
each load merges into a new version of its entity, of which it rewrites the buckets that it touches. Data are written before the inputs are marked as seen, so a
run that breaks off is done again, and keyed merges make that harmless.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import inspect
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from entloom.entity import Entity
from entloom.functions.keys import input_hash
from entloom.operators.loading import keep_last, merged, orphans, spread, unseen, validate
from entloom.plans.model import Load, Pipeline, Query, Selection, Step
from entloom.plans.runlog import RunLog
from entloom.sources.store import Store


@dataclass
class Options:
    selection: Selection = Selection()
    retry: bool = False  # inputs that were seen before are done again
    retry_skipped: bool = False  # inputs that a transform left out are not marked as seen
    fail_downstream: bool = False  # steps that need a failed one's yield are left out
    fast_fail: bool = False  # all later steps are left out
    rerun_failed: bool = False  # only what the last run left undone
    build: bool = False  # drop all tables first
    check_references: bool = False  # a reference without a parent is an error


@dataclass
class StepResult:
    status: str = "completed"
    seconds: float = 0.0
    error: str | None = None
    counts: dict[str, int] = field(default_factory=dict)


class InvalidRows(ValueError):
    pass


class Runner:
    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store, self.log = spark, store, RunLog(store)

    def table(self, entity: Entity) -> DataFrame:
        return self.store.read(entity.full_name, entity.struct)

    def sync(self, pipeline: Pipeline, build: bool = False) -> None:
        """Create the tables that don't exist; with `build` drop all first."""
        for name, e in pipeline.entities.items():
            if build:
                self.store.drop(name)
            if not self.store.version(name):
                self.store.create(name)

    # -- a step ---------------------------------------------------------------------

    def extract(self, step: Step, settings: Mapping | None = None) -> DataFrame:
        """The rows of a step's source; a function with a parameter `settings` gets the pipeline's."""
        if not isinstance(step.source, Query):
            wants = "settings" in inspect.signature(step.source).parameters
            return step.source(self.spark, settings=settings or {}) if wants else step.source(self.spark)
        allowed = set(step.source.dependency.tables_needed)

        def read(entity: Entity) -> DataFrame:
            if entity.full_name not in allowed:
                raise ValueError(f"{step.name} reads {entity.full_name} but doesn't declare it")
            return self.table(entity)

        return step.source.build(read)

    def rows_of(self, df: DataFrame, load: Load, step: Step) -> DataFrame:
        """The rows that a load writes: spread, validated, keyed, the last of each id."""
        seq = [f"__seq{i}" for i in range(len(step.order_by))]
        plain = df.select(*(F.col(c).alias(s) for c, s in zip(step.order_by, seq, strict=True)), *(v.alias(c) for c, v in load.values().items()), *([load.value(load.id).alias("__id")] if load.id is not None else []))
        plain = spread(plain, load.lists) if load.lists else plain
        checked = validate(plain, load.entity, load.validation, load.insert)
        key = F.col("__id") if load.id is not None else load.entity.key({c: F.col(c) for c in load.columns})
        told = F.when(F.size("__errors") > 0, F.raise_error(F.concat(F.lit(f"{load.entity.name}: no valid "), F.array_join("__errors", ", "))).cast("string"))
        keyed = checked.withColumn("id", F.coalesce(told, key)).drop("__errors", "__id")
        return keep_last(keyed.select("id", *seq, *load.columns), ["id"], [*seq]).drop(*seq)

    def nested(self, load: Load):
        for v in load.columns.values():
            if isinstance(v, Load):
                yield from self.nested(v)
                yield v

    def reads(self, step: Step) -> int:
        """How many of a step's loads read its rows: those that write."""
        return sum(bool(x.insert or x.supplied) for load in step.loads for x in (load, *self.nested(load)))

    def merge(self, df: DataFrame, load: Load, step: Step, counts: dict, options: Options) -> None:
        e, supplied = load.entity, load.supplied
        if not load.insert and not supplied:
            return  # a lookup: its id is computed, nothing is written
        new = self.rows_of(df, load, step)
        if not options.check_references and self.store.is_empty(e.full_name):
            self._merge(new, load, step, counts, options)  # read once, so not stored
            return
        path = f"_tmp/{uuid.uuid4().hex}"
        self.store.write(path, new)
        try:
            self._merge(self.store.read(path, new.schema), load, step, counts, options)
        finally:
            self.store.drop(path)

    def _merge(self, new: DataFrame, load: Load, step: Step, counts: dict, options: Options) -> None:
        e, supplied = load.entity, load.supplied
        if options.check_references:
            for c, parent in e.references.items():
                if c in supplied and (lost := orphans(new, c, self.table(parent)).limit(1).count()):
                    raise InvalidRows(f"{e.name}.{c}: {lost} or more rows refer to no {parent.name}")
        new = new.withColumn("step_id", F.lit(step.version))

        def combine(old: DataFrame, fresh: DataFrame) -> DataFrame:
            rows = merged(old, fresh, [*supplied, "step_id"], insert=load.insert)
            return rows.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))

        found = self.store.merge(e.full_name, e.struct, new, combine)
        counts["rows_updated"] = counts.get("rows_updated", 0) + found["updated"]
        counts["rows_inserted"] = counts.get("rows_inserted", 0) + found["inserted"]

    def run_step(self, step: Step, pipeline: Pipeline, options: Options) -> StepResult:
        began, counts, temporary = time.time(), {}, []
        try:
            read = Observation()
            raw = self.extract(step, pipeline.settings)
            raw = raw.observe(read, F.count(F.lit(1)).alias("n"))
            hashed = raw.withColumn("input_hash", input_hash(step.version, {c: F.to_json(F.struct(c)) if not isinstance_simple(raw, c) else F.col(c) for c in raw.columns}))
            # Hashes are shuffled as bytes, half as long as their text.
            packed = hashed.withColumn("input_hash", F.unhex("input_hash"))
            fresh = packed.dropDuplicates(["input_hash"]) if options.retry else unseen(packed, self.log.seen(step.version).select(F.unhex("input_hash").alias("input_hash")))
            fresh = fresh.withColumn("input_hash", F.lower(F.hex("input_hash")))
            temporary.append(path := f"_tmp/{uuid.uuid4().hex}")
            unique = Observation()
            dealt = fresh.withColumn("__batch", F.pmod(F.xxhash64("input_hash"), F.lit(step.batches)).cast("int"))
            with whole_plans(self.spark):
                self.store.write(path, dealt.observe(unique, F.count(F.lit(1)).alias("n")), ("__batch",))
            stored = self.store.read(path, dealt.schema)
            counts["inputs_extracted"], counts["inputs_unique"] = observed(read), observed(unique)
            counts["inputs_processed"] = 0
            for k in range(step.batches if counts["inputs_unique"] else 0):
                batch = stored.where(F.col("__batch") == k).drop("__batch")
                temporary.append(after := f"_tmp/{uuid.uuid4().hex}")
                self._run_batch(batch, after, step, pipeline, options, counts)
            counts["inputs_skipped"] = counts["inputs_unique"] - counts["inputs_processed"]
            if step.sketches and counts["inputs_unique"]:
                self.log.add_sketches(step.name, step.sketches, stored)
            return StepResult("completed", time.time() - began, None, counts)
        except Exception as e:  # a step that fails doesn't end the run
            return StepResult("failed", time.time() - began, f"{type(e).__name__}: {e}"[:2000], counts)
        finally:
            for path in temporary:
                self.store.drop(path)

    def _run_batch(self, fresh: DataFrame, after: str, step: Step, pipeline: Pipeline, options: Options, counts: dict) -> None:
        """Transform and load some of a step's inputs, then mark them as seen."""
        done = fresh
        for transform in step.transforms:
            done = transform.apply(done, pipeline.settings)
        if all(t.spec is not None and t.spec[0] == "native" for t in step.transforms) and (not step.transforms or self.reads(step) <= 1):
            processed = fresh.select("input_hash")  # column expressions that one load reads once keep all rows; the inputs are unique
        else:
            self.store.write(after, done)
            done = self.store.read(after, done.schema)
            processed = done.select("input_hash").distinct() if "input_hash" in done.columns else fresh.select("input_hash")
        n = processed.count()
        counts["inputs_processed"] += n
        if n:
            for load in step.loads:
                for inner in self.nested(load):
                    self.merge(done, inner, step, counts, options)
                self.merge(done, load, step, counts, options)
        finished = processed if options.retry_skipped else fresh.select("input_hash")
        self.log.mark_seen(step.version, finished if options.retry is False else unseen(finished, self.log.seen(step.version)))

    # -- a run ----------------------------------------------------------------------

    def run(self, pipeline: Pipeline, options: Options | None = None) -> dict[str, StepResult]:
        options = options or Options()
        steps = pipeline.sorted()
        if not steps:
            raise ValueError(f"{pipeline.name} has no steps")
        chosen = options.selection.chosen(steps)
        if options.rerun_failed:
            self.log.views()
            chosen &= {r["step"] for r in self.spark.table("steps_to_run").collect()}
        self.sync(pipeline, options.build)
        run_id, began = self.log.next_id(), time.time()
        results: dict[str, StepResult] = {}
        failed: list[Step] = []
        for k, step in enumerate(steps):
            below = [f for f in failed if step.dependency.after(f.dependency)]
            if step.name not in chosen:
                result = StepResult("excluded")
            elif failed and options.fast_fail or below and options.fail_downstream:
                result = StepResult("upstream_failed")
            else:
                result = self.run_step(step, pipeline, options)
            results[step.name] = result
            if result.status == "failed" or result.status == "upstream_failed" and below:
                failed.append(step)
            c, d = result.counts, step.dependency
            numbers = [c.get(n, 0) for n in ("inputs_extracted", "inputs_unique", "inputs_skipped", "inputs_processed", "rows_inserted", "rows_updated")]
            self.log.add("step_run", [(run_id, step.name, step.version, k, list(step.tags), result.status, result.seconds, *numbers, result.error, *(sorted(getattr(d, f)) for f in d.__dataclass_fields__))])
        s = options.selection
        errors = sum(r.status == "failed" for r in results.values())
        started = dt.datetime.fromtimestamp(began)
        self.log.add("run", [(run_id, pipeline.name, pipeline.version, "completed", started, time.time() - began, errors, sorted(s.include), sorted(s.exclude), s.start, s.until, options.retry)])
        return results

    def dry_run(self, step: Step, pipeline: Pipeline) -> dict[str, int]:
        """Run a step's lineage without writing entities: rows for each load."""
        done = self.extract(step, pipeline.settings).withColumn("input_hash", F.lit(""))
        for transform in step.transforms:
            done = transform.apply(done, pipeline.settings)
        return {load.entity.full_name: self.rows_of(done, load, step).count() for load in step.loads}


@contextlib.contextmanager
def whole_plans(spark: SparkSession):
    """Within, a plan that turns out to be empty while it runs keeps its parts, and with them what they have observed."""
    name, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    before = spark.conf.get(name, None)
    spark.conf.set(name, f"{before},{rule}" if before else rule)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def observed(read: Observation) -> int:
    """The rows that passed; a table that the planner knows to be empty is never run, so nothing was observed."""
    try:
        return read.get["n"]
    except Py4JJavaError:
        return 0


def isinstance_simple(df: DataFrame, column: str) -> bool:
    """Whether a column's type casts to text."""
    return df.schema[column].dataType.typeName() not in ("array", "map", "struct", "variant", "binary")
