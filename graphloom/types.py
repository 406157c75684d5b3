"""Property types, and the coercion of incoming columns to them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import GraphError

_SPARK: dict[str, T.DataType] = {
    "BOOL": T.BooleanType(),
    "INT8": T.ByteType(),
    "INT16": T.ShortType(),
    "INT32": T.IntegerType(),
    "INT64": T.LongType(),
    "VID": T.StringType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "FIXED_STRING": T.StringType(),
    "TIMESTAMP": T.LongType(),
    "DATE": T.DateType(),
    "TIME": T.DayTimeIntervalType(T.DayTimeIntervalType.HOUR, T.DayTimeIntervalType.SECOND),  # since midnight: Spark's TIME is off by default
    "DATETIME": T.TimestampNTZType(),
}
INTS = {"INT8": 8, "INT16": 16, "INT32": 32, "INT64": 64}
#: Epoch seconds that a TIMESTAMP may hold.
MAX_SECONDS = 9_223_372_036


@dataclass(frozen=True)
class PropertyType:
    """One of the property types; length only for FIXED_STRING."""

    name: str
    length: int = 0

    @staticmethod
    def parse(text: str) -> PropertyType:
        m = re.fullmatch(r"([A-Z0-9_]+)(?:\((\d+)\))?", text.strip().upper())
        if not m or m[1] not in _SPARK or (m[1] == "FIXED_STRING") != bool(m[2] and int(m[2])):
            raise GraphError("INVALID_PARM", f"unknown property type {text}")
        return PropertyType(m[1], int(m[2] or 0))

    def __str__(self) -> str:
        return f"{self.name}({self.length})" if self.length else self.name

    @property
    def stored(self) -> T.DataType:
        """As kept in Parquet."""
        return _SPARK[self.name]

    @property
    def surfaced(self) -> T.DataType:
        """As queries see it: integers are 64-bit, floats are doubles."""
        return T.LongType() if self.name in INTS else T.DoubleType() if self.name == "FLOAT" else self.stored


def _kind(data_type: T.DataType) -> str:
    for kind, types in {
        "bool": (T.BooleanType,),
        "int": (T.ByteType, T.ShortType, T.IntegerType),
        "int64": (T.LongType,),
        "float": (T.FloatType, T.DoubleType),
        "string": (T.StringType,),
        "date": (T.DateType,),
        "time": (T.TimeType, T.DayTimeIntervalType),
        "datetime": (T.TimestampNTZType, T.TimestampType),
        "null": (T.NullType,),
    }.items():
        if isinstance(data_type, types):
            return kind
    return "other"


_NUMBERS = {"BOOL", *INTS, "FLOAT", "DOUBLE", "TIMESTAMP"}
#: What each kind of incoming value may become.
ACCEPTS: dict[str, set[str]] = {
    "bool": {"BOOL", *INTS},
    "int": _NUMBERS,
    "int64": _NUMBERS,
    "float": {*INTS, "FLOAT", "DOUBLE"},
    "string": {"STRING", "FIXED_STRING", "VID"},
    "date": {"DATE", "DATETIME"},
    "time": {"TIME"},
    "datetime": {"DATE", "DATETIME"},
    "null": set(_SPARK),
    "other": set(),
}


def truncated(value: Column, length: int) -> Column:
    """At most `length` UTF-8 bytes of a string, cut between characters."""
    raw = F.encode(value, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(length, max(length - 4, -1), -1)]
    return F.when(F.octet_length(value) <= length, value).otherwise(F.coalesce(*cuts))


def coerce(value: Column, incoming: T.DataType, target: PropertyType) -> tuple[Column, Column]:
    """The value as the target's stored type, and an error code (null if it fits).

    A type that the target does not accept is TYPE_MISMATCH for every row; a number beyond the target's range is
    OUT_OF_RANGE, an invalid epoch second INCORRECT_VALUE. Floats are cut towards zero when they become integers.
    """
    kind = _kind(incoming)
    if target.name not in ACCEPTS[kind]:
        return F.lit(None).cast(target.stored), F.when(value.isNotNull(), F.lit("TYPE_MISMATCH"))
    if target.name == "FIXED_STRING":
        return truncated(value, target.length), F.lit(None).cast("string")
    if target.name == "TIMESTAMP":
        whole = value.cast("long")
        return whole, F.when(~whole.between(0, MAX_SECONDS), F.lit("INCORRECT_VALUE"))
    if target.name == "BOOL" and kind in ("int", "int64"):
        return value != 0, F.lit(None).cast("string")
    if target.name == "TIME" and isinstance(incoming, T.TimeType):
        value = value - F.expr("TIME'00:00:00'")
    got = value.try_cast(target.stored)
    if target.name == "FLOAT" and kind == "float":
        return got, F.when(F.abs(value.cast("double")) > F.lit(3.4028234663852886e38), F.lit("OUT_OF_RANGE"))
    return got, F.when(value.isNotNull() & got.isNull(), F.lit("OUT_OF_RANGE"))


def vid_type(text: str) -> PropertyType:
    """INT64 or FIXED_STRING(n)."""
    t = PropertyType.parse(text)
    if t.name not in ("INT64", "FIXED_STRING"):
        raise GraphError("INVALID_PARM", f"{text} cannot identify a vertex")
    return t
