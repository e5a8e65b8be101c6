"""Kinds of values: which Spark types hold them, which literals have them, and how text becomes one."""

from __future__ import annotations

import re
import struct
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

from ..errors import InvalidQuery

KINDS = ("bool", "int", "float", "str", "bytes", "timestamp", "uuid", "list", "map")
KEYABLE = ("int", "str", "timestamp", "uuid")
NUMBERS = ("int", "float")
SPARK_TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bytes": T.BinaryType(), "timestamp": T.TimestampNTZType(), "uuid": T.StringType(), "list": T.VariantType(), "map": T.VariantType()}
# Names of column types in SQL by the kind they mean.
SQL_TYPES = {name: kind for kind, names in {"int": "INT INTEGER BIGINT SMALLINT", "float": "FLOAT REAL DOUBLE NUMERIC DECIMAL", "str": "TEXT STRING VARCHAR CHAR", "bool": "BOOL BOOLEAN", "bytes": "BYTES BLOB BYTEA", "timestamp": "TIMESTAMP DATETIME TIMESTAMPTZ", "uuid": "UUID", "list": "LIST ARRAY", "map": "MAP JSON JSONB"}.items() for name in names.split()}


def kind_of_type(t: T.DataType) -> str:
    """The kind that columns of a Spark type hold; 'any' of a variant, whose values tell."""
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, (T.MapType, T.StructType)):
        return "map"
    return "null" if isinstance(t, T.NullType) else "any"


def kind_of_value(v) -> str:
    if v is None:
        return "null"
    for types, kind in ((bool, "bool"), (int, "int"), (float, "float"), (str, "str"), ((bytes, bytearray), "bytes"), (datetime, "timestamp"), (uuid.UUID, "uuid"), ((list, tuple), "list"), (dict, "map")):
        if isinstance(v, types):
            return kind
    raise InvalidQuery(f"no kind holds a {type(v).__name__}")


def comparable(a: str, b: str) -> bool:
    """Whether values of two kinds can be ordered or equal; a variant may hold any."""
    return a == b or (a in NUMBERS and b in NUMBERS) or "any" in (a, b)


def like_pattern(pattern: str) -> str:
    """LIKE as a whole-string regular expression: % any run, _ one character, everything else itself; no escapes."""
    return r"(?s)\A" + "".join(".*" if c == "%" else "." if c == "_" else "\\" + c if not c.isalnum() and c.isascii() else c for c in pattern) + r"\z"


_STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?\s*(Z|z|[+-]\d\d:?\d\d)?)?")


def parse_timestamp(text: str) -> datetime:
    """An ISO date, or date and time with an optional offset; UTC without one; fractions are cut to microseconds."""
    m = _STAMP.fullmatch(text.strip())
    if not m:
        raise InvalidQuery(f"invalid timestamp {text!r}")
    try:
        at = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), int(((m[7] or "") + "000000")[:6]))
    except ValueError as e:
        raise InvalidQuery(f"invalid timestamp {text!r}: {e}") from None
    if m[8] and m[8] not in "Zz":
        sign = -1 if m[8][0] == "-" else 1
        at -= sign * timedelta(hours=int(m[8][1:3]), minutes=int(m[8][-2:]))
    return at


def parse_uuid(text: str) -> uuid.UUID:
    try:
        return uuid.UUID(text)
    except ValueError:
        raise InvalidQuery(f"invalid uuid {text!r}") from None


def to_column_value(v, kind: str):
    """What a Spark column of that kind stores for v; lists and maps as JSON text for parse_json."""
    if v is None:
        return None
    if kind == "uuid":
        return str(v)
    if kind == "timestamp" and v.tzinfo:
        return v.astimezone(timezone.utc).replace(tzinfo=None)
    if kind in ("list", "map"):
        import json

        return json.dumps(v, default=_json)
    return v


def _json(v):
    if isinstance(v, (bytes, bytearray)):
        return {"$bytes": v.hex()}
    if isinstance(v, datetime):
        return {"$datetime": v.isoformat()}
    return {"$uuid": str(v)}


def pack_vector(values) -> bytes:
    """Numbers as little-endian 32-bit floats, one after the other; searches take such bytes as a vector."""
    return struct.pack(f"<{len(values)}f", *values)
