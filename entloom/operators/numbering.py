"""Row numbers and running sums over whole tables without a window that one task computes.

Rows are dealt into ranges of the order, sorted within them and stored with a place that names range and position.
Each range's size is one small row; sums of the sizes before a range are its offset. So an order over all rows,
or over one group that holds most of them, is spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entloom.sources.scratch import stored

_RANGE, _PLACE = "__range", "__place"
#: `monotonically_increasing_id` has the number of the partition above these bits.
_BITS = 33


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """`df` stored in ranges of (by, order), with __range and __place, which ascends over all rows in that order.

    Ties go by the row's content; rows that are equal are told apart by where they were read, so they can be dealt into several ranges.
    """
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    keys = [*map(F.col, by), *(F.col(o) if isinstance(o, str) else o for o in order)]
    marked = df.withColumns({"__content": F.xxhash64(*plain), "__read": F.monotonically_increasing_id()})
    keys += [F.col("__content"), F.col("__read")]
    dealt = marked.repartitionByRange(parts, *keys) if parts else marked.repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).drop("__content", "__read").withColumn(_PLACE, F.monotonically_increasing_id())
    return stored(placed.withColumn(_RANGE, F.shiftright(_PLACE, _BITS)), "ranged")


def offsets(sums: DataFrame, by: Sequence[str], of: Sequence[str]) -> DataFrame:
    """`sums` (a row for each group and range) with __before_<c>: the sum of c over the group's earlier ranges, and __all_<c>: over all its ranges."""
    if by:
        whole = Window.partitionBy(*by)
        before = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumns({f"__before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in of} | {f"__all_{c}": F.sum(c).over(whole) for c in of})
    # A row for each range: as many as the exchange has partitions.
    rows = sorted(sums.collect(), key=lambda r: r[_RANGE])
    schema = sums.schema
    for c in of:
        schema = schema.add(f"__before_{c}", sums.schema[c].dataType).add(f"__all_{c}", sums.schema[c].dataType)
    totals = {c: sum(r[c] or 0 for r in rows) for c in of}
    run, out = dict.fromkeys(of, 0), []
    for r in rows:
        out.append((*r, *(x for c in of for x in (run[c], totals[c]))))
        run = {c: run[c] + (r[c] or 0) for c in of}
    return F.broadcast(sums.sparkSession.createDataFrame(out, schema))


def _with_offsets(rows: DataFrame, sums: DataFrame, by: Sequence[str], of: Sequence[str]) -> DataFrame:
    """Each row beside its range's offsets."""
    named = {c: f"__at{i}" for i, c in enumerate((_RANGE, *by))}
    at = offsets(sums, by, of).withColumnsRenamed(named)
    same = F.col(_RANGE) == F.col(named[_RANGE])
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(named[c]))
    return rows.join(at, same)


def number_rows(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "number", total: str | None = None, parts: int | None = None) -> DataFrame:
    """`df` with the rows' numbers from 1, in `order`, of all rows or within each group of `by`; `total`: a column for the group's size.

    Nulls come first in ascending order and null is a group. Ties are broken by content, so equal tables get equal numbers.
    """
    rows = ranged(df, by, order, parts)
    sums = rows.groupBy(*by, _RANGE).agg(F.count(F.lit(1)).alias("__n"), F.min(_PLACE).alias("__least"))
    joined = _with_offsets(rows, sums, by, ["__n"])
    number = F.col(_PLACE) - F.col("__least") + F.col("__before___n") + 1
    return joined.select(*df.columns, number.alias(name), *([F.col("__all___n").alias(total)] if total else []))


def running_sum(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "running", parts: int | None = None) -> DataFrame:
    """`df` with the sum of `value` over the rows up to this one; rows that tie come one after the other. Nulls count as nothing."""
    rows = ranged(df, by, order, parts)
    sums = rows.groupBy(*by, _RANGE).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    within = rows.withColumn("__within", F.coalesce(F.sum(value).over(Window.partitionBy(*by, _RANGE).orderBy(_PLACE)), F.lit(0)))
    joined = _with_offsets(within, sums, by, ["__sum"])
    return joined.select(*df.columns, (F.col("__within") + F.col("__before___sum")).alias(name))
