"""Operators of a load: spreading lists, validating, keying, keeping the last, merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entloom.entity import Entity


def spread(df: DataFrame, lists: Sequence[str], others: Sequence[str] | None = None) -> DataFrame:
    """One row for each position of the list columns, taken side by side.

    A list of one value is repeated to the longest; an empty list leaves no row; other lengths that differ are an error.
    A null list counts as a single null.
    """
    if not lists:
        return df if others is None else df.select(*others)
    others = [c for c in df.columns if c not in lists] if others is None else list(others)
    whole = [F.when(F.col(c).isNull(), F.array(F.lit(None))).otherwise(F.col(c)) for c in lists]
    named = df.select(*others, *(w.alias(f"__{c}") for w, c in zip(whole, lists, strict=True)))
    sizes = [F.size(f"__{c}") for c in lists]
    n = sizes[0] if len(sizes) == 1 else F.greatest(*sizes)
    least = sizes[0] if len(sizes) == 1 else F.least(*sizes)
    even = [F.when(s == 1, F.array_repeat(F.element_at(f"__{c}", 1), n)).when(s == n, F.col(f"__{c}")).otherwise(F.raise_error(F.lit(f"lists of different lengths: {c}"))) for c, s in zip(lists, sizes, strict=True)]
    rows = named.where(least > 0).select(*others, F.inline(F.arrays_zip(*(e.alias(c) for e, c in zip(even, lists, strict=True)))))
    return rows.toDF(*others, *lists)


def coerced(col: Column, to: T.DataType) -> tuple[Column, Column]:
    """The value as the type, and whether it can't be."""
    value = col.try_cast(to)
    return value, col.isNotNull() & value.isNull()


def validate(df: DataFrame, entity: Entity, mode: str = "coerce", insert: bool = True) -> DataFrame:
    """`df` with __errors: the columns of `entity` whose values don't fit, by name.

    coerce: a value must be convertible, and is converted. strict: the column's type must be the entity's, which is
    settled on the plan. off: nothing is checked. Required columns count when rows are inserted.
    """
    if mode not in ("coerce", "strict", "off"):
        raise ValueError(f"no validation mode {mode!r}")
    if mode == "off":
        return df.withColumn("__errors", F.array().cast("array<string>"))
    have, errors, values = {f.name: f.dataType for f in df.schema}, [], {}
    for c, t in entity.columns.items():
        rule = entity.rules.get(c)
        if c not in have:
            if insert and rule is not None and rule.required:
                raise ValueError(f"{entity.name}: required column {c} has no value")
            continue
        if mode == "strict" and have[c] != t:
            raise TypeError(f"{entity.name}.{c}: {have[c].simpleString()} is not {t.simpleString()}")
        value, bad = coerced(F.col(c), t)
        if rule is not None:
            bad = bad | rule.broken(value)
        values[c] = value
        errors.append(F.when(bad, F.lit(c)))
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return df.withColumns({"__errors": found}).withColumns(values)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`; ties go to the greatest values, so the result doesn't depend on the dealing.

    An aggregate with partial sums: of a hot key only one row for each task is shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.*")


def merged(old: DataFrame, new: DataFrame, supplied: Sequence[str], key: str = "id", insert: bool = True) -> DataFrame:
    """`old` with the rows of `new` (unique keys) put in, and __state: 'kept', 'updated' or 'inserted'.

    Supplied columns overwrite, also with null; others stay as they are, and are null in inserted rows. Without `insert` keys that `old` lacks are ignored.
    """
    fresh = new.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__new_{c}") for c in supplied), F.lit(True).alias("__new"))
    known = old.withColumn("__old", F.lit(True))
    joined = known.join(fresh, known[key] == fresh["__key"], "full_outer" if insert else "left")
    state = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "inserted").otherwise("updated")
    cols = [F.coalesce(F.col(key), F.col("__key")).alias(key) if c == key else F.when(F.col("__new"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c) for c in old.columns]
    return joined.select(*cols, state.alias("__state"))


def upsert(old: DataFrame, new: DataFrame, supplied: Sequence[str], key: str = "id") -> DataFrame:
    """`merged`, without the state."""
    return merged(old, new, supplied, key).drop("__state")


def update(old: DataFrame, new: DataFrame, supplied: Sequence[str], key: str = "id") -> DataFrame:
    """`old` with the supplied columns of matching rows replaced; keys that `old` lacks are ignored."""
    return merged(old, new, supplied, key, insert=False).drop("__state")


def unseen(df: DataFrame, seen: DataFrame, key: str = "input_hash") -> DataFrame:
    """Rows whose hash isn't among `seen`, each hash once."""
    return df.join(seen.select(key), key, "left_anti").dropDuplicates([key])


def orphans(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col("id").alias(column)), column, "left_anti")


def keyed(df: DataFrame, entity: Entity, values: Mapping[str, Column]) -> DataFrame:
    """`df` with the entity's id, from expressions over `df`."""
    return df.withColumn("id", entity.key(values))
