"""Entities: typed tables whose primary key follows from identifying columns."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entloom.functions.keys import content_id
from entloom.functions.typenames import spark_type

#: Columns that every entity has besides its own.
IMPLICIT = ("id", "step_id", "created_at")


@dataclass(frozen=True)
class Rule:
    """What a column's values must satisfy; null passes unless the column is required."""

    required: bool = False
    gt: float | None = None
    ge: float | None = None
    lt: float | None = None
    le: float | None = None
    multiple_of: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    one_of: tuple = ()

    def broken(self, col: Column) -> Column:
        found = F.lit(False)
        for limit, test in ((self.gt, col.__le__), (self.ge, col.__lt__), (self.lt, col.__ge__), (self.le, col.__gt__)):
            if limit is not None:
                found = found | test(F.lit(limit))
        if self.multiple_of is not None:
            found = found | (col % self.multiple_of != 0)
        if self.min_length is not None:
            found = found | (F.length(col) < self.min_length)
        if self.max_length is not None:
            found = found | (F.length(col) > self.max_length)
        if self.pattern is not None:
            found = found | ~col.rlike(self.pattern)
        if self.one_of:
            found = found | ~col.isin(*self.one_of)
        return F.coalesce(found, F.lit(False)) | (col.isNull() if self.required else F.lit(False))


@dataclass(frozen=True, eq=False)
class Entity:
    """A table: columns by name, which of them identify a row, and which refer to another entity's id."""

    name: str
    columns: Mapping[str, T.DataType]
    identifying: tuple[str, ...] = ()
    references: Mapping[str, "Entity"] = field(default_factory=dict)
    rules: Mapping[str, Rule] = field(default_factory=dict)
    schema: str = "public"

    registry: ClassVar[dict[str, "Entity"]] = {}

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def struct(self) -> T.StructType:
        own = [T.StructField(c, t) for c, t in self.columns.items()]
        refs = [T.StructField(c, T.StringType()) for c in self.references]
        return T.StructType([T.StructField("id", T.StringType(), False), *own, *refs, T.StructField("step_id", T.StringType()), T.StructField("created_at", T.TimestampType())])

    @property
    def all_columns(self) -> list[str]:
        return [*self.columns, *self.references]

    def key(self, values: Mapping[str, Column]) -> Column:
        """The id from the identifying values: own columns by name, then references by name."""
        missing = [c for c in self.identifying if c not in values]
        if missing:
            raise ValueError(f"{self.name}: identifying columns without a value: {missing}")
        own = sorted(c for c in self.identifying if c in self.columns)
        refs = sorted(c for c in self.identifying if c in self.references)
        return content_id(*(values[c].cast(self.columns[c]) for c in own), *(values[c] for c in refs))


def entity(name: str, columns: Mapping, identifying=(), references: Mapping[str, Entity] | None = None, *, rules: Mapping[str, Rule] | None = None, schema: str = "public", base: Entity | None = None, registry: dict | None = None) -> Entity:
    """Declare an entity. Mistakes are told here, before anything runs.

    `base` passes on its columns, references, rules and identifying columns.
    """
    registry = Entity.registry if registry is None else registry
    own = {c: spark_type(t) for c, t in columns.items()}
    refs = dict(references or {})
    if base is not None:
        own, refs = {**base.columns, **own}, {**base.references, **refs}
        identifying, rules = (*base.identifying, *(c for c in identifying if c not in base.identifying)), {**base.rules, **(rules or {})}
    for c in (*own, *refs):
        if c in IMPLICIT or c.startswith("_") or not re.fullmatch(r"[A-Za-z]\w*", c):
            raise ValueError(f"{name}: {c!r} is no column name")
    if both := set(own) & set(refs):
        raise ValueError(f"{name}: {sorted(both)} are columns and references")
    if unknown := [c for c in (*identifying, *(rules or {})) if c not in own and c not in refs]:
        raise ValueError(f"{name}: unknown columns {unknown}")
    made = Entity(name, own, tuple(identifying), refs, dict(rules or {}), schema)
    if made.full_name in registry:
        raise ValueError(f"{made.full_name} is declared already")
    registry[made.full_name] = made
    return made
