"""Transforms: Python functions and column expressions over the rows of a step.

A Python function runs in an Arrow-batched UDF that returns its outputs beside a status, so
a row that is skipped or fails is a value, not a dead job. Prefer `native`, which stays in the JVM.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from entloom.functions.sqltext import described


class SkipRow(Exception):
    """Raised by a transform to leave its row out."""


def _code_of(code) -> str:
    consts = [_code_of(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts]
    return "|".join([code.co_code.hex(), *consts, *code.co_names])


def remember_source(function: Callable, source: str) -> None:
    """Give a function the source that `source_of` shall tell."""
    function.__entloom_source__ = source


def source_of(function: Callable) -> str:
    """What a function's version follows from: its source, or its code where there is none or several share a line."""
    if known := getattr(function, "__entloom_source__", None):
        return known
    code = getattr(function, "__code__", None)
    if code is None:
        raise ValueError(f"{function!r} has no source: wrap it in a function")
    try:
        return inspect.getsource(function) + (_code_of(code) if function.__name__ == "<lambda>" else "")
    except (OSError, TypeError):
        return _code_of(code)


def check_arity(function: Callable, n: int, injected: Sequence[str] = ()) -> None:
    params = [p for p in inspect.signature(function).parameters.values() if p.name not in injected]
    if any(p.kind is p.VAR_POSITIONAL for p in params):
        return
    spots = [p for p in params if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    least = sum(p.default is p.empty for p in spots)
    if not least <= n <= len(spots):
        raise ValueError(f"{function.__name__} takes {least} to {len(spots)} inputs, not {n}")


@dataclass(frozen=True)
class Transform:
    """Adds the outputs to a table; `version` changes when the code does. spec: which of MAKERS made it, and of what."""

    apply: Callable[[DataFrame, Mapping], DataFrame]
    version: str
    outputs: tuple[str, ...]
    spec: tuple[str, dict] | None = None


def _outputs(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def python(function: Callable, inputs: Sequence[str | Column], outputs: str | T.StructType, on_error: str = "fail") -> Transform:
    """A row function. With several outputs it returns a tuple of as many; `settings`, if it has such a parameter, is injected.

    SkipRow leaves the row out. Errors fail the step, or with on_error="skip" leave the row out too.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError(f"no error policy {on_error!r}")
    fields = _outputs(outputs)
    names = [f.name for f in fields]
    check_arity(function, len(inputs), ("settings",))
    wants = "settings" in inspect.signature(function).parameters
    returned = T.StructType([*fields, T.StructField("_status", T.StringType()), T.StructField("_error", T.StringType())])

    def apply(df: DataFrame, settings: Mapping) -> DataFrame:
        extra = {"settings": dict(settings)} if wants else {}

        arrow = to_arrow_type(returned)

        @F.arrow_udf(returned)
        def run(*cols: pa.Array) -> pa.Array:
            rows = []
            for args in zip(*(c.to_pylist() for c in cols), strict=True):  # Python values: null is None, an integer an int
                try:
                    got = function(*args, **extra)
                    got = got if isinstance(got, tuple) and len(names) != 1 else (got,)
                    if len(got) != len(names):
                        raise ValueError(f"{len(got)} values for {len(names)} outputs")
                    rows.append((*got, "ok", None))
                except SkipRow as e:
                    rows.append((*(None,) * len(names), "skip", str(e)))
                except Exception as e:
                    rows.append((*(None,) * len(names), "error", f"{type(e).__name__}: {e}"))
            return pa.array([dict(zip([*names, "_status", "_error"], r, strict=True)) for r in rows], arrow)

        args = [F.col(i) if isinstance(i, str) else i for i in inputs] or [F.lit(0)]
        done = df.withColumn("__out", run(*args))
        if on_error == "fail":
            error = F.when(F.col("__out._status") == "error", F.raise_error(F.col("__out._error")).cast("string"))
            done = done.where(F.coalesce(error, F.col("__out._status")) == "ok")
        else:
            done = done.where(F.col("__out._status") == "ok")
        return done.select(*[c for c in df.columns if c not in names], *(F.col(f"__out.{n}").alias(n) for n in names))

    spec = ("python", {"function": function, "inputs": tuple(inputs), "outputs": fields, "on_error": on_error})
    return Transform(apply, hashlib.md5(source_of(function).encode()).hexdigest(), tuple(names), spec)


class RowFunction:
    """A Python function with declared outputs; `on` makes it a transform of a step's columns, `map` one of its lists, element by element."""

    def __init__(self, function: Callable, outputs: str | T.StructType, on_error: str):
        self.function, self.outputs, self.on_error = function, outputs, on_error
        self.__name__, self.__doc__ = function.__name__, function.__doc__

    def __call__(self, *args, **kwargs):
        return self.function(*args, **kwargs)

    def on(self, *inputs: str | Column) -> Transform:
        return python(self.function, inputs, self.outputs, self.on_error)

    def map(self, *lists: str | Column) -> Transform:
        """Over lists side by side; one of a single value serves all. Each output is a list."""
        function, fields = self.function, _outputs(self.outputs)
        check_arity(function, len(lists), ("settings",))

        def over(*given):
            n = max(map(len, given))
            if any(len(g) not in (1, n) for g in given) and min(map(len, given)):
                raise ValueError("lists of different lengths")
            n = n if all(given) else 0
            rows = [function(*(g[i if len(g) > 1 else 0] for g in given)) for i in range(n)]
            return tuple(map(list, zip(*rows, strict=True))) if rows and len(fields) > 1 else rows if len(fields) == 1 else ([],) * len(fields)

        lists_of = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])
        made = python(over, lists, lists_of, self.on_error)
        spec = ("map", {"function": function, "lists": tuple(lists), "outputs": fields, "on_error": self.on_error})
        return Transform(made.apply, hashlib.md5(("map" + source_of(function)).encode()).hexdigest(), made.outputs, spec)


def transform(outputs: str | T.StructType, on_error: str = "fail") -> Callable[[Callable], RowFunction]:
    """Decorator: a Python function of one row's values, with the columns that it returns."""
    return lambda function: RowFunction(function, outputs, on_error)


def native(**columns: Column) -> Transform:
    """Column expressions."""
    text = ";".join(f"{k}={described(v)}" for k, v in sorted(columns.items()))
    return Transform(lambda df, _: df.withColumns(columns), hashlib.md5(text.encode()).hexdigest(), tuple(columns), ("native", {"columns": dict(columns)}))


def keep(condition: Column) -> Transform:
    """Rows that fulfil a condition."""
    return Transform(lambda df, _: df.where(condition), hashlib.md5(described(condition).encode()).hexdigest(), (), ("keep", {"condition": condition}))


def map_lists(output: str, function: Callable[..., Column], *lists: str) -> Transform:
    """A list made by a column function over lists, side by side; a list of one value serves all. Empty lists give an empty list."""

    def apply(df: DataFrame, _: Mapping) -> DataFrame:
        sizes = [F.size(c) for c in lists]
        n = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
        some = F.least(*sizes) if len(sizes) > 1 else sizes[0]
        even = [F.when(s == 1, F.array_repeat(F.element_at(c, 1), n)).when(s == n, F.col(c)).otherwise(F.raise_error(F.lit(f"lists of different lengths: {c}"))) for c, s in zip(lists, sizes, strict=True)]
        made = F.transform(F.arrays_zip(*(e.alias(c) for e, c in zip(even, lists, strict=True))), lambda r: function(*(r[c] for c in lists)))
        # arrays_zip pads, so mismatches must be told before; with an empty list there is nothing to map.
        nothing = F.filter(F.transform(F.arrays_zip(*(F.col(c) for c in lists)), lambda r: function(*(r[c] for c in lists))), lambda _: F.lit(False))
        return df.withColumn(output, F.when(some > 0, made).otherwise(nothing))

    spec = ("map_lists", {"output": output, "function": function, "lists": tuple(lists)})
    return Transform(apply, hashlib.md5((output + source_of(function) + "".join(lists)).encode()).hexdigest(), (output,), spec)


#: How a transform is made again of its spec.
MAKERS: dict[str, Callable[..., Transform]] = {
    "python": python,
    "map": lambda function, lists, outputs, on_error: RowFunction(function, outputs, on_error).map(*lists),
    "native": lambda columns: native(**columns),
    "keep": keep,
    "map_lists": lambda output, function, lists: map_lists(output, function, *lists),
}
