"""Query helpers over entities: joins along references, guarded projections, ordered lists."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entloom.entity import Entity


def project(df: DataFrame, *cols: str | Column) -> DataFrame:
    """A selection whose output names must differ and be given: expressions need an alias."""
    out = df.select(*cols)
    if twice := [c for c, n in Counter(out.columns).items() if n > 1]:
        raise ValueError(f"ambiguous columns {twice}: give them aliases")
    if odd := [str(c) for c in cols if isinstance(c, Column) and not _named(c)]:
        raise ValueError(f"unnamed expressions {odd}: give them aliases")
    return out


def _named(col: Column) -> bool:
    """Whether an expression says what its output is called: a column, a field of one, all of a table's, or an alias. The text of `expr` is asked for its outermost part."""
    node = col._jc.node()
    kind = node.getClass().getSimpleName()
    if kind == "SqlExpression":
        parsed = SparkSession.active()._jsparkSession.sessionState().sqlParser().parseExpression(node.expression())
        return parsed.getClass().getSimpleName() in ("UnresolvedAttribute", "Alias", "UnresolvedStar", "UnresolvedExtractValue")
    if kind == "UnresolvedExtractValue":
        return node.extraction().getClass().getSimpleName() == "Literal"
    return kind in ("UnresolvedAttribute", "Alias", "UnresolvedStar", "UnresolvedRegex")


def join_reference(left: DataFrame, child: Entity, right: DataFrame, parent: Entity, how: str = "inner") -> DataFrame:
    """Join a child table with its parent on the one reference between them."""
    refs = [c for c, e in child.references.items() if e.full_name == parent.full_name]
    if len(refs) != 1:
        raise ValueError(f"{child.name} has {len(refs)} references to {parent.name}; name one")
    return left.join(right, left[refs[0]] == right["id"], how)


@dataclass(frozen=True)
class Desc:
    """A key of `ordered_list` that goes from the greatest to the least, nulls last."""

    by: Column


def ordered_list(value: str, *order: Column | Desc) -> Column:
    """The values of a group in the order of `order`; ascending keys have nulls first."""
    plain = [o.by if isinstance(o, Desc) else o for o in order]
    keys = [f"k{i}" for i in range(len(order))]
    rows = F.collect_list(F.struct(*(o.alias(k) for o, k in zip(plain, keys, strict=True)), F.col(value).alias("v")))
    if not any(isinstance(o, Desc) for o in order):
        return F.transform(F.array_sort(rows), lambda r: r["v"])

    def compare(a: Column, b: Column) -> Column:
        found = F.lit(0)
        for o, k in reversed([*zip(order, keys, strict=True)]):
            x, y = a[k], b[k]
            sign = F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)
            sign = -sign if isinstance(o, Desc) else sign
            found = F.when(sign != 0, sign).otherwise(found)
        return found.cast("int")

    return F.transform(F.array_sort(rows, compare), lambda r: r["v"])


def join_many(left: DataFrame, left_entity: Entity, link: DataFrame, link_entity: Entity, right: DataFrame, right_entity: Entity, how: str = "inner") -> DataFrame:
    """Two tables joined through a link table that refers to both."""
    near, far = ([c for c, e in link_entity.references.items() if e.full_name == x.full_name] for x in (left_entity, right_entity))
    if len(near) != 1 or len(far) != 1:
        raise ValueError(f"{link_entity.name} must refer once to {left_entity.name} and once to {right_entity.name}")
    return left.join(link, left["id"] == link[near[0]], how).join(right, link[far[0]] == right["id"], how)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))
