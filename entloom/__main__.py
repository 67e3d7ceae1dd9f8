"""Command line: list, describe, check, export and run a pipeline given as `module:attribute` or as an exported file."""

from __future__ import annotations

import argparse
import importlib
import sys

from entloom.config import Config
from entloom.plans import codec
from entloom.plans.model import Pipeline, Selection


def load_pipeline(spec: str) -> Pipeline:
    if spec.endswith(".json"):
        with open(spec) as f:
            return codec.loads(f.read())
    module, _, attribute = spec.partition(":")
    if not attribute:
        raise SystemExit("a pipeline is given as module:attribute")
    found = getattr(importlib.import_module(module), attribute)
    found = found() if callable(found) and not isinstance(found, Pipeline) else found
    if not isinstance(found, Pipeline):
        raise SystemExit(f"{spec} is no pipeline")
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="entloom")
    parser.add_argument("command", choices=["list", "describe", "validate", "export", "run", "status"])
    parser.add_argument("pipeline")
    parser.add_argument("--store", default=Config.from_env().store)
    parser.add_argument("--include", nargs="*", default=[])
    parser.add_argument("--exclude", nargs="*", default=[])
    parser.add_argument("--start")
    parser.add_argument("--until")
    for flag in ("retry", "fail-downstream", "fast-fail", "rerun-failed", "build"):
        parser.add_argument(f"--{flag}", action="store_true")
    a = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"entloom {a.pipeline}").getOrCreate()  # declarations may hold column expressions
    pipeline = load_pipeline(a.pipeline)
    selection = Selection(frozenset(a.include), frozenset(a.exclude), a.start, a.until)
    steps = pipeline.sorted()
    if a.command == "list":
        for s in steps:
            print(s.name, *s.tags)
        return 0
    if a.command == "describe":
        print(pipeline.described())
        return 0
    if a.command == "export":
        print(codec.dumps(pipeline))
        return 0
    selection.check(steps)
    if a.command == "validate":
        print(f"{len(steps)} steps, {len(pipeline.entities)} entities")
        return 0
    from entloom.plans.runner import Options, Runner
    from entloom.sources.store import Store

    runner = Runner(spark, Store(spark, a.store))
    if a.command == "status":
        runner.log.views()
        spark.table("current_run").select("run_id", "step", "status", "seconds", "rows_inserted", "rows_updated").orderBy("run_id", "step").show(1000, False)
        return 0
    results = runner.run(pipeline, Options(selection, a.retry, a.fail_downstream, a.fast_fail, a.rerun_failed, a.build))
    for name, r in results.items():
        print(f"{name}: {r.status}, {r.seconds:.1f} s, {r.counts}{': ' + r.error if r.error else ''}")
    return int(any(r.status == "failed" for r in results.values()))


if __name__ == "__main__":
    sys.exit(main())
