"""Column types by name: what an entity's declaration may use and what Spark stores."""

from __future__ import annotations

import datetime as dt
import decimal
import enum
import uuid
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class NamedType:
    name: str
    python: type
    spark: T.DataType


#: In order of precedence: the first type of a Python class is its default.
TYPES = [
    NamedType("text", str, T.StringType()),
    NamedType("varchar", str, T.StringType()),
    NamedType("bool", bool, T.BooleanType()),
    NamedType("int4", int, T.IntegerType()),
    NamedType("int8", int, T.LongType()),
    NamedType("float8", float, T.DoubleType()),
    NamedType("timestamptz", dt.datetime, T.TimestampType()),
    NamedType("timestamp", dt.datetime, T.TimestampNTZType()),
    NamedType("date", dt.date, T.DateType()),
    NamedType("interval", dt.timedelta, T.DayTimeIntervalType()),
    NamedType("bytea", bytes, T.BinaryType()),
    NamedType("uuid", uuid.UUID, T.StringType()),
    NamedType("json", dict, T.StringType()),
    NamedType("jsonb", dict, T.VariantType()),
    NamedType("numeric", decimal.Decimal, T.DecimalType(38, 18)),
    NamedType("enum", enum.Enum, T.StringType()),
]


def spark_type(of: str | type | T.DataType) -> T.DataType:
    """The Spark type of a name (`int8`, `text[]`), a Python class or a Spark type."""
    if isinstance(of, T.DataType):
        return of
    if isinstance(of, str):
        if of.endswith("[]"):
            return T.ArrayType(spark_type(of[:-2]))
        for known in TYPES:
            if known.name == of:
                return known.spark
        raise KeyError(f"no column type is named {of!r}")
    for base in of.__mro__:
        for known in TYPES:
            if known.python is base:
                return known.spark
    raise KeyError(f"no column type for {of!r}")
