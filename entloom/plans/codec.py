"""Pipelines as JSON text, and back: declarations as values, column expressions as SQL, Python functions as code.

What is read must have the version that was written, step by step, so a file that doesn't say all that a step does is refused.
Functions are unpickled when a pipeline is read: read only files that you would run.
"""

from __future__ import annotations

import base64
import contextlib
import dataclasses
import json
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entloom.entity import Entity, Rule
from entloom.functions import transforms as tr
from entloom.functions.sqltext import sql_of
from entloom.plans.model import Dependency, Load, Out, Pipeline, Query, Step

FORMAT = 1


@contextlib.contextmanager
def _by_value(function: Callable):
    """Within, the function's own module is shipped as code too; installed packages are referred to by name."""
    module = sys.modules.get(getattr(function, "__module__", None) or "")
    inside = module is not None and module.__name__.split(".")[0] not in (*sys.stdlib_module_names, "entloom", "pyspark") and module.__name__ != "__main__"
    if inside:
        cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        if inside:
            cloudpickle.unregister_pickle_by_value(module)


def _code(function: Callable) -> dict:
    with _by_value(function):
        raw = cloudpickle.dumps(function)
    return {"code": base64.b64encode(raw).decode(), "source": tr.source_of(function), "name": getattr(function, "__name__", "")}


def _function(said: dict) -> Callable:
    function = cloudpickle.loads(base64.b64decode(said["code"]))
    # The version follows from the source as it was, also where the file it was in is missing or has changed.
    tr.remember_source(function, said["source"])
    return function


class _Writer:
    def __init__(self):
        self.entities: dict[str, Entity] = {}

    def name(self, e: Entity) -> str:
        if e.full_name not in self.entities:
            self.entities[e.full_name] = e
            for parent in e.references.values():
                self.name(parent)
        return e.full_name

    def value(self, of: object) -> dict:
        if isinstance(of, Load):
            return {"load": self.load(of)}
        if isinstance(of, Out):
            return {"out": of.name}
        if isinstance(of, Column):
            return {"sql": sql_of(of)}
        try:
            if json.loads(json.dumps(of)) == of:
                return {"constant": of}
        except (TypeError, ValueError):
            pass
        return {"sql": sql_of(F.lit(of))}

    def load(self, load: Load) -> dict:
        columns = {c: self.value(v) for c, v in load.columns.items()}
        return {"entity": self.name(load.entity), "columns": columns, "insert": load.insert, "id": None if load.id is None else self.value(load.id), "lists": list(load.lists), "validation": load.validation}

    def transform(self, t: tr.Transform) -> dict:
        if t.spec is None:
            raise ValueError("a transform that wasn't made by this library's functions can't be written")
        kind, args = t.spec
        return {"kind": kind, **{k: self.argument(v) for k, v in args.items()}}

    def argument(self, of: object) -> object:
        if isinstance(of, Column):
            return {"sql": sql_of(of)}
        if isinstance(of, T.StructType):
            return {"schema": of.jsonValue()}
        if isinstance(of, tuple | list):
            return {"list": [self.argument(x) for x in of]}
        if isinstance(of, dict):
            return {"dict": {k: self.argument(v) for k, v in of.items()}}
        return _code(of) if callable(of) else {"constant": of}

    def step(self, s: Step) -> dict:
        if isinstance(s.source, Query):
            reads = s.source.reads.items() if isinstance(s.source.reads, dict) else [(e, e.all_columns) for e in s.source.reads]
            source = {"query": _code(s.source.build), "reads": {self.name(e): list(c) for e, c in reads}}
        else:
            source = {"function": _code(s.source)}
        also = {f: sorted(getattr(s.also, f)) for f in Dependency.__dataclass_fields__}
        return {"name": s.name, "version": s.version, "source": source, "transforms": [self.transform(t) for t in s.transforms], "loads": [self.load(x) for x in s.loads], "tags": list(s.tags), "also": also, "order_by": list(s.order_by), "batches": s.batches, "sketches": list(s.sketches)}

    def entity(self, e: Entity) -> dict:
        return {
            "name": e.name, "schema": e.schema, "identifying": list(e.identifying), "references": {c: p.full_name for c, p in e.references.items()},
            "columns": {c: t.jsonValue() for c, t in e.columns.items()}, "rules": {c: dataclasses.asdict(r) for c, r in e.rules.items()},
        }


def dumps(pipeline: Pipeline) -> str:
    """The pipeline as JSON. Settings must be JSON values."""
    writer = _Writer()
    steps = [writer.step(s) for s in pipeline.steps]
    return json.dumps({"format": FORMAT, "name": pipeline.name, "version": pipeline.version, "settings": dict(pipeline.settings), "entities": {n: writer.entity(e) for n, e in writer.entities.items()}, "steps": steps}, indent=1)


class _Reader:
    def __init__(self, said: dict):
        self.said, self.entities = said, {}

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            e = self.said[name]
            columns = {c: T._parse_datatype_json_value(t) for c, t in e["columns"].items()}
            rules = {c: Rule(**{k: tuple(v) if k == "one_of" else v for k, v in r.items()}) for c, r in e["rules"].items()}
            self.entities[name] = Entity(e["name"], columns, tuple(e["identifying"]), {c: self.entity(p) for c, p in e["references"].items()}, rules, e["schema"])
        return self.entities[name]

    def value(self, said: dict) -> object:
        (kind, of), = said.items()
        return {"load": lambda: self.load(of), "out": lambda: Out(of), "sql": lambda: F.expr(of), "constant": lambda: of}[kind]()

    def load(self, said: dict) -> Load:
        columns = {c: self.value(v) for c, v in said["columns"].items()}
        return Load(self.entity(said["entity"]), columns, said["insert"], None if said["id"] is None else self.value(said["id"]), tuple(said["lists"]), said["validation"])

    def argument(self, said: dict) -> object:
        if "code" in said:
            return _function(said)
        (kind, of), = said.items()
        return {
            "sql": lambda: F.expr(of), "schema": lambda: T.StructType.fromJson(of), "list": lambda: tuple(map(self.argument, of)),
            "dict": lambda: {k: self.argument(v) for k, v in of.items()}, "constant": lambda: of,
        }[kind]()

    def step(self, said: dict) -> Step:
        source = said["source"]
        if "query" in source:
            origin = Query(_function(source["query"]), {self.entity(n): c for n, c in source["reads"].items()})
        else:
            origin = _function(source["function"])
        transforms = [tr.MAKERS[t["kind"]](**{k: self.argument(v) for k, v in t.items() if k != "kind"}) for t in said["transforms"]]
        also = Dependency(**{f: frozenset(v) for f, v in said["also"].items()})
        made = Step(said["name"], origin, transforms, [self.load(x) for x in said["loads"]], tuple(said["tags"]), also, tuple(said["order_by"]), said["batches"], tuple(said["sketches"]))
        if made.version != said["version"]:
            raise ValueError(f"step {made.name!r} was written as version {said['version']} and read as {made.version}")
        return made


def loads(text: str) -> Pipeline:
    """A pipeline that `dumps` wrote; a session must be active."""
    said = json.loads(text)
    if said.get("format") != FORMAT:
        raise ValueError(f"no pipeline of format {FORMAT}")
    reader = _Reader(said["entities"])
    made = Pipeline(said["name"], [reader.step(s) for s in said["steps"]], said["settings"])
    if made.version != said["version"]:
        raise ValueError(f"{made.name} was written as version {said['version']} and read as {made.version}")
    return made
