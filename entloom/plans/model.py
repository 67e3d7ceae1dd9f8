"""Steps and pipelines: what a step reads and writes, and the order that follows."""

from __future__ import annotations

import contextlib
import contextvars
import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entloom.entity import Entity
from entloom.functions.sqltext import described
from entloom.functions.transforms import Transform, source_of

_tags: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("tags", default=())


@contextlib.contextmanager
def tagged(*tags: str):
    """Steps declared within get these tags, besides those of enclosing blocks."""
    token = _tags.set((*_tags.get(), *tags))
    try:
        yield
    finally:
        _tags.reset(token)


@dataclass(frozen=True)
class Dependency:
    """Tables and columns that something needs and yields, by full name."""

    tables_needed: frozenset[str] = frozenset()
    columns_needed: frozenset[str] = frozenset()
    tables_yielded: frozenset[str] = frozenset()
    columns_yielded: frozenset[str] = frozenset()

    def __or__(self, other: Dependency) -> Dependency:
        return Dependency(*(getattr(self, f) | getattr(other, f) for f in self.__dataclass_fields__))

    def after(self, other: Dependency) -> bool:
        """Whether this needs something that the other yields."""
        return bool(self.tables_needed & other.tables_yielded or self.columns_needed & other.columns_yielded)


#: Key of a column's metadata that names the entity it is read from. It stays with the column where the planner copies a table, as in self-joins.
_READ_FROM = "entloom.entity"


def read_by(build: Callable[[Callable[[Entity], DataFrame]], DataFrame]) -> dict[Entity, list[str]]:
    """The entities that a query reads and the columns that are left of them in its optimized plan, subqueries included. No data are read; a session must be active."""
    spark = SparkSession.active()
    asked: dict[str, Entity] = {}

    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def read(e: Entity) -> DataFrame:
        if asked.setdefault(e.full_name, e) is not e:
            raise ValueError(f"two entities are named {e.full_name}")
        marked = T.StructType([T.StructField(f.name, f.dataType, f.nullable, {_READ_FROM: e.full_name}) for f in e.struct])
        # A table without statistics, which the planner can't fold away.
        return spark.createDataFrame(spark.sparkContext.emptyRDD(), marked)

    read_columns: dict[int, tuple[str, str]] = {}
    used: set[int] = set()

    def walk(node) -> None:
        used.update(a.exprId().id() for a in items(node.references().toSeq()))
        children = items(node.children())
        for a in items(node.output()) if not children else ():
            if of := json.loads(a.metadata().json()).get(_READ_FROM):
                read_columns[a.exprId().id()] = (of, a.name())
        for child in children:
            walk(child)
        for inner in items(node.subqueries()):
            plan_used(inner)

    def plan_used(plan) -> None:
        used.update(a.exprId().id() for a in items(plan.output()))
        walk(plan)

    plan_used(build(read)._jdf.queryExecution().optimizedPlan())
    left = {read_columns[i] for i in used & read_columns.keys()}
    return {e: [c for c in e.struct.names if (name, c) in left] for name, e in asked.items()}


@dataclass(frozen=True)
class Query:
    """A source over entity tables. Which tables and columns it reads is found in its optimized plan (`read_by`), or declared
    beside it; it is checked when it runs, as the function gets a reader that knows these tables only.
    """

    build: Callable[[Callable[[Entity], DataFrame]], DataFrame]
    reads: Mapping[Entity, Sequence[str]] | Sequence[Entity] | None = None

    def __post_init__(self):
        if self.reads is None:
            object.__setattr__(self, "reads", read_by(self.build))

    @property
    def dependency(self) -> Dependency:
        listed = self.reads.items() if isinstance(self.reads, Mapping) else [(e, e.all_columns) for e in self.reads]
        listed = list(listed)
        return Dependency(frozenset(e.full_name for e, _ in listed), frozenset(f"{e.full_name}.{c}" for e, cols in listed for c in cols))


@dataclass(frozen=True, eq=False)
class Load:
    """Rows of a step into an entity.

    columns: names of the step's columns, expressions, constants, or another Load, whose id is then the value (no join).
    insert: rows are upserted; else known ids are updated and others ignored. id: an expression for the id, instead of identifying values.
    lists: columns that hold lists to be spread side by side.
    """

    entity: Entity
    columns: Mapping[str, object]
    insert: bool = False
    id: object = None
    lists: tuple[str, ...] = ()
    validation: str = "coerce"

    def __post_init__(self):
        e = self.entity
        if unknown := [c for c in self.columns if c not in e.all_columns]:
            raise ValueError(f"{e.name} has no columns {unknown}")
        if self.insert and self.id is not None:
            raise ValueError("an inserted row's id follows from its identifying values")
        missing = [c for c in e.identifying if c not in self.columns]
        if self.id is None and missing:
            raise ValueError(f"{e.name}: identifying columns without a value: {missing}")
        required = [c for c, r in e.rules.items() if r.required and c not in self.columns]
        if self.insert and required:
            raise ValueError(f"{e.name}: required columns without a value: {required}")

    def value(self, of: object) -> Column:
        if isinstance(of, Load):
            return of.key()
        if isinstance(of, Column):
            return of
        return F.col(of.name) if isinstance(of, Out) else F.lit(of)

    def values(self) -> dict[str, Column]:
        return {c: self.value(v) for c, v in self.columns.items()}

    def key(self) -> Column:
        return self.value(self.id) if self.id is not None else self.entity.key(self.values())

    @property
    def supplied(self) -> list[str]:
        """Columns that the load writes: of an update all but the identifying ones, unless the id is given."""
        fixed = set(self.entity.identifying) if not self.insert and self.id is None else set()
        return [c for c in self.columns if c not in fixed]

    @property
    def dependency(self) -> Dependency:
        name = self.entity.full_name
        nested = Dependency()
        for v in self.columns.values():
            if isinstance(v, Load):
                nested |= v.dependency
        if self.insert:
            return nested | Dependency(tables_yielded=frozenset({name}), columns_yielded=frozenset(f"{name}.{c}" for c in self.entity.all_columns))
        need = Dependency(tables_needed=frozenset({name}), columns_needed=frozenset(f"{name}.{c}" for c in self.entity.identifying))
        return nested | need | Dependency(columns_yielded=frozenset(f"{name}.{c}" for c in self.supplied))

    def described(self) -> object:
        def told(v: object) -> object:
            return v.described() if isinstance(v, Load) else described(v) if isinstance(v, Column) else str(v)

        return [self.entity.full_name, self.insert, self.validation, list(self.lists), told(self.id), {c: told(v) for c, v in self.columns.items()}]


@dataclass(frozen=True)
class Out:
    """A column of the step, as a load's value."""

    name: str


@dataclass(frozen=True, eq=False)
class Step:
    """A source, transforms in order, and loads. `source` is a Query or a function of the session.

    batches: the inputs are dealt into as many parts by hash; each is loaded and marked as seen before the next, so a run that breaks off goes on where it was. Of rows of one
    key in several parts the last part's stays, so an order can't be asked for. sketches: columns of the source whose distinct values the run log estimates.
    """

    name: str
    source: Query | Callable[..., DataFrame]
    transforms: Sequence[Transform] = ()
    loads: Sequence[Load] = ()
    tags: tuple[str, ...] = ()
    also: Dependency = Dependency()
    order_by: tuple[str, ...] = ()
    batches: int = 1
    sketches: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "tags", (*_tags.get(), *self.tags))
        if self.batches < 1 or self.batches > 1 and self.order_by:
            raise ValueError(f"{self.name}: batches are one or more, and one where rows have an order")

    @property
    def dependency(self) -> Dependency:
        found = self.also | (self.source.dependency if isinstance(self.source, Query) else Dependency())
        for load in self.loads:
            found |= load.dependency
        return found

    @property
    def version(self) -> str:
        """Changes with anything that changes what the step does: its name, code, loads and tags."""
        source = self.source.build if isinstance(self.source, Query) else self.source
        whole = [self.name, source_of(source), [t.version for t in self.transforms], [x.described() for x in self.loads], list(self.tags), list(self.order_by)]
        return hashlib.md5(json.dumps(whole, sort_keys=True).encode()).hexdigest()


def sort_steps(steps: Iterable[Step]) -> list[Step]:
    """Steps after those whose yield they need, by name otherwise. A cycle is an error."""
    steps = {s.name: s for s in steps}
    before = {n: {m for m, o in steps.items() if m != n and s.dependency.after(o.dependency)} for n, s in steps.items()}
    out, ready = [], [n for n, b in before.items() if not b]
    heapq.heapify(ready)
    left = {n: set(b) for n, b in before.items()}
    while ready:
        n = heapq.heappop(ready)
        out.append(steps[n])
        for m, b in left.items():
            if n in b:
                b.remove(n)
                if not b:
                    heapq.heappush(ready, m)
    if len(out) < len(steps):
        raise ValueError(f"steps that need each other: {sorted(set(steps) - {s.name for s in out})}")
    return out


@dataclass(eq=False)
class Pipeline:
    """Named steps, with settings that transforms may ask for."""

    name: str
    steps: list[Step] = field(default_factory=list)
    settings: Mapping = field(default_factory=dict)

    def add(self, step: Step) -> Step:
        if any(s.name == step.name for s in self.steps):
            raise ValueError(f"two steps are named {step.name!r}")
        self.steps.append(step)
        return step

    def sorted(self) -> list[Step]:
        return sort_steps(self.steps)

    @property
    def entities(self) -> dict[str, Entity]:
        found: dict[str, Entity] = {}

        def walk(load: Load):
            found[load.entity.full_name] = load.entity
            for v in load.columns.values():
                if isinstance(v, Load):
                    walk(v)

        for s in self.steps:
            for load in s.loads:
                walk(load)
            if isinstance(s.source, Query):
                found |= {e.full_name: e for e in s.source.reads}
        return found

    @property
    def version(self) -> str:
        return hashlib.md5(json.dumps([self.name, *(s.version for s in self.sorted())]).encode()).hexdigest()

    def described(self) -> str:
        """The pipeline as JSON: steps in order with versions and dependencies."""
        steps = [{"name": s.name, "version": s.version, "tags": list(s.tags)} | {f: sorted(getattr(s.dependency, f)) for f in Dependency.__dataclass_fields__} for s in self.sorted()]
        return json.dumps({"name": self.name, "version": self.version, "steps": steps}, indent=2)


@dataclass(frozen=True)
class Selection:
    """Which steps run. Names or tags, matched whole; exclude beats include; start and until are included."""

    include: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()
    start: str | None = None
    until: str | None = None

    def check(self, steps: Sequence[Step]) -> None:
        known = {s.name for s in steps} | {t for s in steps for t in s.tags}
        names = {s.name for s in steps}
        wrong = [m for m in (*self.include, *self.exclude) if m not in known] + [m for m in (self.start, self.until) if m and m not in names]
        if wrong:
            raise ValueError(f"no step or tag: {sorted(wrong)}")

    def chosen(self, steps: Sequence[Step]) -> set[str]:
        """Names of the steps to run, of steps in order."""
        self.check(steps)
        order = [s.name for s in steps]
        include = set(self.include)
        if self.start or self.until:
            lo = order.index(self.start) if self.start else 0
            hi = order.index(self.until) + 1 if self.until else len(order)
            include |= set(order[lo:hi])
        marks = {s.name: {s.name, *s.tags} for s in steps}
        return {n for n in order if not marks[n] & self.exclude and (not include or marks[n] & include)}
