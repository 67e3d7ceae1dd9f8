"""Content keys: ids that follow from a row's identifying values, as plain column expressions.

A key needs no lookup: a child computes its parent's id from the parent's identifying
values, so a foreign key costs no join. Values are encoded with their lengths and null has a code of its own, so null,
the empty text and 'None' are three different values and no separator can be forged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Instants as text in one zone, whatever the session's is.
_UTC = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def _text(col: Column) -> Column:
    """A value as text that no session setting changes. The type is known to the planner, so one branch is left of it."""
    instant = F.get_json_object(F.to_json(F.struct(col.alias("v")), _UTC), "$.v")
    return F.when(F.typeof(col) == "timestamp", instant).otherwise(col.cast("string"))


def encoded(col: Column, is_array: bool = False) -> Column:
    text = F.to_json(col, _UTC) if is_array else _text(col)
    return F.when(col.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text))


def as_uuid(digest: Column) -> Column:
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def content_id(*cols: Column) -> Column:
    """The id of identifying values, in the order given."""
    return as_uuid(F.md5(F.concat_ws("|", *(encoded(c) for c in cols)) if cols else F.lit("")))


def input_hash(version: str, cols: dict[str, Column]) -> Column:
    """What an input row is known by to a version of a step."""
    return F.md5(F.concat_ws("|", F.lit(version), *(encoded(cols[k]) for k in sorted(cols))))
