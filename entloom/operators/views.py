"""Views over entity tables, computed when read or kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from entloom.entity import Entity
from entloom.operators.loading import keep_last, merged
from entloom.sources.scratch import released, stored
from entloom.sources.store import Store


def create_view(df: DataFrame, name: str, replace: bool = True) -> None:
    """A view of that name in the session."""
    if replace:
        df.createOrReplaceTempView(name)
    else:
        df.createTempView(name)


def register_entities(spark: SparkSession, store: Store, entities: list[Entity]) -> None:
    """Entity tables as views, for SQL: `schema_name`."""
    for e in entities:
        create_view(store.read(e.full_name, e.struct), f"{e.schema}_{e.name}")


class KeptView:
    """A query whose result is kept as a table; `refresh` computes it anew, readers see the old one until then."""

    def __init__(self, store: Store, name: str, query: Callable[[], DataFrame]):
        self.store, self.name, self.query = store, f"_views/{name}", query

    def refresh(self) -> int:
        return self.store.write(self.name, self.query())

    def read(self) -> DataFrame:
        if not self.store.version(self.name):
            self.refresh()
        return self.store.read(self.name, self.query().schema)


def load_keyed(store: Store, entity: Entity, rows: DataFrame) -> dict[str, int]:
    """Upsert rows that carry their ids already; of an id that repeats the last by content stays. Returns the numbers of rows kept (in the buckets touched), updated and inserted."""
    supplied = [c for c in rows.columns if c != "id"]
    if unknown := [c for c in supplied if c not in entity.struct.names]:
        raise ValueError(f"{entity.name} has no columns {unknown}")
    new = stored(keep_last(rows, ["id"], []), "keyed")
    try:
        return store.merge(entity.full_name, entity.struct, new, lambda old, fresh: merged(old, fresh, supplied))
    finally:
        released(new)
