"""Values as text for logs and loaders, and nested lists made flat, by their types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(col: Column, kind: T.DataType) -> Column:
    """All elements of a list of lists of any depth, in order, as one list. Null lists within have no elements, null elements stay; a null list is null."""
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{kind.simpleString()} is no list")
    if not isinstance(kind.elementType, T.ArrayType):
        return col
    inner = kind.elementType
    return F.flatten(F.transform(col, lambda x: F.coalesce(flat(x, inner), F.array().cast(T.ArrayType(_leaf(inner))))))


def _leaf(kind: T.DataType) -> T.DataType:
    return _leaf(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def escaped(col: Column) -> Column:
    """A text in one line: backslash, line feed, carriage return and tabulator by their escapes."""
    for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def as_text(col: Column, kind: T.DataType) -> Column:
    """A value as text: texts and bytes (UTF-8) escaped, instants and dates in ISO form, spans of time in seconds, lists and structs as JSON of such texts."""
    if isinstance(kind, T.StringType):
        return escaped(col)
    if isinstance(kind, T.BinaryType):
        return escaped(F.decode(col, "UTF-8"))
    if isinstance(kind, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    if isinstance(kind, T.DayTimeIntervalType):
        return col.cast("interval second").cast("decimal(20,6)").cast("string")
    if isinstance(kind, T.ArrayType):
        return F.when(col.isNotNull(), F.to_json(F.transform(col, lambda x: as_text(x, kind.elementType))))
    if isinstance(kind, T.StructType):
        fields = [as_text(col[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(col.isNotNull(), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    return col.cast("string")
