"""Small results on the driver: rows as dicts, one value, one column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..errors import InvalidQuery


def dicts(df: DataFrame) -> list[dict[str, Any]]:
    """All rows, each as a dict by column name."""
    return [r.asDict(recursive=True) for r in df.collect()]


def scalar(df: DataFrame) -> Any:
    """The first column of the first row; None if there is no row."""
    r = df.first()
    return None if r is None else r[0]


def column(df: DataFrame, which: str | int) -> list[Any]:
    """One column, by its name or place, of all rows."""
    name = df.columns[which] if isinstance(which, int) and which < len(df.columns) else which
    if name not in df.columns:
        raise InvalidQuery(f"no column {which!r}")
    return [r[name] for r in df.collect()]
