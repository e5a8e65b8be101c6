"""Table schemas: fixed, validated columns with one primary key."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T

from .errors import ConstraintViolation, SchemaMismatch
from .functions.values import KEYABLE, KINDS, SPARK_TYPES, kind_of_value

RESERVED = frozenset(("nodes", "edges", "kv"))  # the names of a database's own tables
_NAME = re.compile(r"[A-Za-z0-9_]{1,100}")


def check_name(name: str, reserved=RESERVED) -> str:
    if not _NAME.fullmatch(name) or "__" in name or name in reserved:
        raise SchemaMismatch(f"invalid name {name!r}")
    return name


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = True
    unique: bool = False
    indexed: bool = False
    default: Any = None


@dataclass(frozen=True)
class TableSchema:
    name: str
    pk: str
    fields: tuple[Field, ...]
    auto_increment: bool = False

    @property
    def key(self) -> Field:
        return next(f for f in self.fields if f.name == self.pk)

    @property
    def names(self) -> list[str]:
        """The primary key first, then the other columns in declared order."""
        return [self.pk, *(f.name for f in self.fields if f.name != self.pk)]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaMismatch(f"table {self.name!r} has no column {name!r}")

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[self.field(n).kind]) for n in self.names])

    def complete(self, row: dict) -> dict:
        """The row with defaults for absent columns, checked against columns, kinds and NOT NULL; a null pk is left out."""
        for name, v in row.items():
            f = self.field(name)
            if v is not None and kind_of_value(v) != f.kind:
                raise SchemaMismatch(f"column {name!r} holds {f.kind}, not {kind_of_value(v)}")
        out = {f.name: row.get(f.name, f.default) for f in self.fields}
        for f in self.fields:
            if f.name != self.pk and not f.nullable and out[f.name] is None:
                raise ConstraintViolation(f"column {f.name!r} may not be null")
        if out[self.pk] is None and not self.auto_increment:
            raise SchemaMismatch(f"primary key {self.pk!r} is null")
        return out

    def with_field(self, f: Field) -> TableSchema:
        return replace(self, fields=(*(x for x in self.fields if x.name != f.name), f)).checked()

    def without(self, name: str) -> TableSchema:
        self.field(name)
        if name == self.pk:
            raise SchemaMismatch("the primary key can't be dropped")
        return replace(self, fields=tuple(f for f in self.fields if f.name != name))

    def checked(self) -> TableSchema:
        check_name(self.name)
        if self.pk not in [f.name for f in self.fields]:
            raise SchemaMismatch(f"table {self.name!r} has no primary key column")
        out = []
        for f in self.fields:
            check_name(f.name, ())
            if f.kind not in KINDS:
                raise SchemaMismatch(f"column {f.name!r} has no kind {f.kind!r}")
            if f.name == self.pk:
                if f.kind not in KEYABLE or (self.auto_increment and f.kind != "int"):
                    raise SchemaMismatch(f"{f.kind} can't be this primary key")
                f = replace(f, nullable=False, unique=False, default=None, indexed=False)
            elif (f.unique or f.indexed) and f.kind not in KEYABLE:
                raise SchemaMismatch(f"column {f.name!r} of {f.kind} can't be indexed")
            elif f.default is not None and kind_of_value(f.default) != f.kind:
                raise SchemaMismatch(f"the default of {f.name!r} isn't {f.kind}")
            out.append(replace(f, indexed=f.indexed or f.unique))
        return replace(self, fields=tuple(out))


class SchemaBuilder:
    """Declares a table; a column declared again replaces the first and goes to the end."""

    def __init__(self, name: str):
        self._name, self._fields, self._pk, self._auto = name, {}, None, False

    def primary_key(self, name: str, kind: str, auto_increment: bool = False) -> SchemaBuilder:
        self._pk, self._auto = name, auto_increment
        return self.column(name, kind)

    def column(self, name: str, kind: str, **options) -> SchemaBuilder:
        self._fields.pop(name, None)
        self._fields[name] = Field(name, kind, **options)
        return self

    def build(self) -> TableSchema:
        if self._pk is None:
            raise SchemaMismatch(f"table {self._name!r} has no primary key")
        return TableSchema(self._name, self._pk, tuple(self._fields.values()), self._auto).checked()
