"""A step over a stream: each micro-batch is an incremental load.

Repeated batches are harmless: inputs seen before are left out and loads are keyed merges, so
the sink is idempotent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from entloom.functions.transforms import Transform
from entloom.plans.model import Load, Pipeline, Step
from entloom.plans.runner import Options, Runner


def load_stream(runner: Runner, stream: DataFrame, name: str, loads: Sequence[Load], checkpoint: str, transforms: Sequence[Transform] = (), order_by: tuple[str, ...] = (), trigger: dict | None = None) -> StreamingQuery:
    """Load a stream's rows into entities. The step's version doesn't depend on the batch, so repeats are known across batches."""

    def source(spark):
        return source.batch

    step = Step(name, source, transforms, loads, order_by=order_by)
    pipeline = Pipeline(name, [step])
    runner.sync(pipeline)

    def each(batch: DataFrame, _: int) -> None:
        source.batch = batch
        result = runner.run_step(step, pipeline, Options())
        if result.status != "completed":
            raise RuntimeError(result.error)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
