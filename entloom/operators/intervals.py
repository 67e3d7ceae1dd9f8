"""Joins by order: the latest row before another (as-of), points in intervals, intervals that overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entloom.operators.numbering import _PLACE, _RANGE, _with_offsets, ranged


def _pairs(by: Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    return [(b, b) if isinstance(b, str) else b for b in by]


def _clashes(left: DataFrame, right: DataFrame) -> None:
    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"columns of both sides: {sorted(both)}; rename them")


def asof_join(left: DataFrame, right: DataFrame, on: tuple[str, str], by: Sequence[str | tuple[str, str]] = (), *, ties: Sequence[str] = (), equal: bool = True, forward: bool = False, within: Column | None = None, parts: int | None = None) -> DataFrame:
    """Each row of `left` beside the row of `right` of equal `by` whose time is the latest one up to its own; without one the right side is null.

    on: the times' columns. equal: whether equal times meet. forward: the earliest one from its own on, instead. within: a condition over both rows, such as a greatest
    distance; where it fails there is no match. ties: columns of `right` that order rows of equal time, the greatest is taken, beyond these by content.
    Rows whose time or `by` is null match nothing. Columns of both sides must differ in name.

    Both sides are united and dealt into ranges of key and time. A range's rows see the last right row before them within it; what a range passes on to the next ones of
    its key is one row. So a key that holds most rows is spread over many tasks, and no row meets more than one other.
    """
    _clashes(left, right)
    keys = _pairs(by)
    names = [f"__k{i}" for i in range(len(keys))]
    lt, rt = on
    one = F.lit(0)
    known = F.col(rt).isNotNull()
    for _, r in keys:
        known = known & F.col(r).isNotNull()
    row, match = F.struct(*left.columns), F.struct(*right.columns)
    first = 1 if equal else 0
    ours = left.select(one.alias("__one"), *(F.col(a).alias(n) for (a, _), n in zip(keys, names, strict=True)), F.col(lt).alias("__t"), F.lit(first).alias("__side"), row.alias("__left"))
    tie = F.struct(*ties) if ties else F.lit(0)
    theirs = right.where(known).select(one.alias("__one"), *(F.col(b).alias(n) for (_, b), n in zip(keys, names, strict=True)), F.col(rt).alias("__t"), F.lit(1 - first).alias("__side"), match.alias("__right"), tie.alias("__tie"))
    every = ours.unionByName(theirs, allowMissingColumns=True)
    time = F.col("__t").desc_nulls_first() if forward else F.col("__t").asc_nulls_first()
    group = [*names, "__one"]
    rows = ranged(every, group, [time, "__side", "__tie"], parts)
    here = Window.partitionBy(*group, _RANGE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("__here", F.last("__right", ignorenulls=True).over(here))
    # A row for each key and range it reaches into.
    passed = rows.groupBy(*group, _RANGE).agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.col(_PLACE))).alias("__passed"))
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = passed.select(*(F.col(g).alias(f"{g}_at") for g in group), F.col(_RANGE).alias("__range_at"), F.last("__passed", ignorenulls=True).over(before).alias("__before"))
    same = F.col(_RANGE) == F.col("__range_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_at"))
    joined = seen.where(F.col("__left").isNotNull()).join(carried, same).withColumn("__right", F.when(F.col("__t").isNotNull(), F.coalesce("__here", "__before")))
    out = joined.select("__left.*", *(F.col(f"__right.{c}").alias(c) for c in right.columns))
    if within is None:
        return out
    return out.withColumn("__ok", F.coalesce(within, F.lit(False))).select(*left.columns, *(F.when(F.col("__ok"), F.col(c)).alias(c) for c in right.columns))


def as_number(col: Column, kind: T.DataType) -> Column:
    """A value as a number in the same order: instants in microseconds, dates in days."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        since = col - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, T.NumericType):
        return col if isinstance(kind, T.IntegralType) else col.cast("double")
    raise TypeError(f"no order of {kind.simpleString()} in numbers")


def range_join(points: DataFrame, intervals: DataFrame, at: str, lo: str, hi: str, by: Sequence[str | tuple[str, str]] = (), *, open_low: bool = False, width: float | None = None) -> DataFrame:
    """Pairs of a point and an interval that holds it (lo <= at <= hi; open_low: lo < at), of equal `by`. Nulls, and intervals whose end is before their start, match nothing.

    Each interval belongs to a level, whose cells are at least as wide as the interval and twice those of the level below, so it lies in two or three cells, however long it is.
    A point looks into its cell of each level that occurs (64 at most). Points and intervals meet by an equi-join on level, cell and `by`. width: of the cells of
    level 0; by default the intervals' mean length.
    """
    _clashes(points, intervals)
    keys = _pairs(by)
    kinds = {f.name: f.dataType for f in (*points.schema, *intervals.schema)}
    p, low, high = (as_number(F.col(c), kinds[c]) for c in (at, lo, hi))
    good = intervals.where(F.col(lo) <= F.col(hi))
    length = (high - low).cast("double")
    if width is None:
        width = good.agg(F.avg(length)).first()[0] or 1.0
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length / width, F.lit(1.0)))).cast("int"))
    levels = sorted(r[0] for r in good.select(level.alias("l")).distinct().collect())

    def cell(number: Column, of: Column) -> Column:
        return F.floor(number / (F.lit(float(width)) * F.pow(F.lit(2.0), of))).cast("long")

    placed = good.withColumn("__level", level)
    placed = placed.withColumn("__cell", F.explode(F.sequence(cell(low, F.col("__level")), cell(high, F.col("__level")))))
    looking = points.where(F.col(at).isNotNull()).withColumn("__level_at", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__cell_at", cell(p, F.col("__level_at")))
    same = (F.col("__level_at") == F.col("__level")) & (F.col("__cell_at") == F.col("__cell"))
    for a, b in keys:
        same = same & (F.col(a) == F.col(b)) if a != b else same
    holds = (F.col(lo) < F.col(at) if open_low else F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi))
    return looking.join(placed, same).where(holds).select(*points.columns, *intervals.columns)


def range_totals(points: DataFrame, intervals: DataFrame, at: str, lo: str, hi: str, key: str, value: str) -> DataFrame:
    """key, n and total: for each key of the intervals the pairs of `range_join` (closed intervals) and the sum of the points' `value`, a whole number. Keys without a pair are left out.

    No pair is made: n and total of an interval are those of the points up to its end without those before its start. Points and ends are
    dealt into ranges of one order and summed there; a range passes on one row. So the work grows with points and intervals, not with their pairs.
    """
    kinds = {f.name: f.dataType for f in (*points.schema, *intervals.schema)}
    sums = ["__n", "__known", "__total"]

    def place(c: str) -> Column:
        # The sort of -0.0 must be that of 0.0.
        return F.col(c) + F.lit(0).cast(kinds[c]) if isinstance(kinds[c], T.FractionalType) and not isinstance(kinds[c], T.DecimalType) else F.col(c)

    here = points.where(F.col(at).isNotNull()).groupBy(place(at).alias("__t")).agg(F.count(F.lit(1)).alias("__n"), F.count(value).alias("__known"), F.coalesce(F.sum(value), F.lit(0)).alias("__total"))
    good = intervals.where(F.col(lo) <= F.col(hi))
    # At one place: starts, points, ends.
    ends = [good.select(F.col(key).alias("__key"), place(c).alias("__t"), F.lit(side).alias("__side")) for c, side in ((lo, -1), (hi, 1))]
    every = here.withColumn("__side", F.lit(0)).unionByName(ends[0].unionByName(ends[1]), allowMissingColumns=True)
    rows = ranged(every, [], ["__t", "__side"])
    upto = Window.partitionBy(_RANGE).orderBy(_PLACE)
    within = rows.withColumns({f"__upto{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums})
    per_range = rows.groupBy(_RANGE).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
    reached = _with_offsets(within.drop(*sums), per_range, [], sums).where("__side <> 0")
    n, known, total = (F.sum(F.col("__side") * (F.col(f"__upto{c}") + F.col(f"__before_{c}"))) for c in sums)
    found = reached.groupBy("__key").agg(n.alias("n"), known.alias("__some"), total.alias("total")).where("n > 0")
    return found.select(F.col("__key").alias(key), "n", F.when(F.col("__some") > 0, F.col("total")).alias("total"))


def overlap_join(left: DataFrame, right: DataFrame, ours: tuple[str, str], theirs: tuple[str, str], by: Sequence[tuple[str, str]] = (), width: float | None = None) -> DataFrame:
    """Pairs of intervals (closed) that overlap: the later of their starts lies in the other one."""
    swapped = [(b, a) for a, b in by]
    whole = left.where(F.col(ours[0]) <= F.col(ours[1]))
    one = range_join(whole, right, ours[0], *theirs, by, width=width)
    two = range_join(right.where(F.col(theirs[0]) <= F.col(theirs[1])), whole, theirs[0], *ours, swapped, open_low=True, width=width)
    return one.unionByName(two)
