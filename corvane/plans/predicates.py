"""Predicates as a tree, and their compilation to two-valued Spark columns.

An atom whose operand is null, missing or of another kind is false, and NOT makes it true; so each atom is settled to
true or false before anything is negated, and kinds are compared when the plan is made, not by casts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaMismatch
from ..functions.values import NUMBERS, comparable, kind_of_type, kind_of_value, like_pattern

FLIP = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


class Pred:
    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True, eq=False)
class Cmp(Pred):
    path: str
    op: str
    value: Any


@dataclass(frozen=True, eq=False)
class In(Pred):
    path: str
    values: tuple


@dataclass(frozen=True, eq=False)
class IsNull(Pred):
    path: str


@dataclass(frozen=True, eq=False)
class Prefix(Pred):
    path: str
    value: str


@dataclass(frozen=True, eq=False)
class Like(Pred):
    path: str
    pattern: Any
    fold: bool = False


@dataclass(frozen=True, eq=False)
class Contains(Pred):
    path: str
    value: Any


@dataclass(frozen=True, eq=False)
class And(Pred):
    parts: tuple


@dataclass(frozen=True, eq=False)
class Or(Pred):
    parts: tuple


@dataclass(frozen=True, eq=False)
class Not(Pred):
    part: Pred


class col:
    """A path in a predicate: col("age").ge(20) & ~col("meta.team").like("w%")."""

    def __init__(self, path: str):
        self.path = path

    def eq(self, v):
        return Cmp(self.path, "=", v)

    def ne(self, v):
        return Cmp(self.path, "<>", v)

    def lt(self, v):
        return Cmp(self.path, "<", v)

    def le(self, v):
        return Cmp(self.path, "<=", v)

    def gt(self, v):
        return Cmp(self.path, ">", v)

    def ge(self, v):
        return Cmp(self.path, ">=", v)

    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = eq, ne, lt, le, gt, ge
    __hash__ = None

    def is_in(self, values):
        return In(self.path, tuple(values))

    def is_null(self):
        return IsNull(self.path)

    def is_not_null(self):
        return Not(IsNull(self.path))

    def between(self, low, high):
        return And((Cmp(self.path, ">=", low), Cmp(self.path, "<=", high)))

    def starts_with(self, v):
        return Prefix(self.path, v)

    def like(self, pattern):
        return Like(self.path, pattern)

    def ilike(self, pattern):
        return Like(self.path, pattern, True)

    def contains(self, v):
        return Contains(self.path, v)


def where(equal: dict) -> Pred:
    """All columns equal to the given values."""
    return And(tuple(Cmp(k, "=", v) for k, v in equal.items()))


def paths(p: Pred) -> set[str]:
    if isinstance(p, (And, Or)):
        return set().union(*map(paths, p.parts)) if p.parts else set()
    return paths(p.part) if isinstance(p, Not) else {p.path}


@dataclass(frozen=True)
class Term:
    """A column with the kind of what it holds."""

    column: Column
    kind: str
    type: T.DataType | None = None


def lit(v) -> Column:
    import uuid

    if isinstance(v, uuid.UUID):
        return F.lit(str(v))
    if isinstance(v, (list, tuple)):
        return F.array(*map(lit, v))
    return F.lit(v)


def step(t: Term, name: str) -> Term:
    """One step of a path into t: a map's key, or a list's element by its number."""
    if isinstance(t.type, T.StructType):
        inner = next((f for f in t.type.fields if f.name == name), None)
        return Term(t.column.getField(name), kind_of_type(inner.dataType), inner.dataType) if inner else Term(F.lit(None), "null")
    if isinstance(t.type, T.MapType):
        return Term(F.try_element_at(t.column, F.lit(name)), kind_of_type(t.type.valueType), t.type.valueType)
    if isinstance(t.type, T.ArrayType):
        return Term(F.get(t.column, F.lit(int(name))), kind_of_type(t.type.elementType), t.type.elementType) if name.isdigit() else Term(F.lit(None), "null")
    if isinstance(t.type, T.VariantType):
        key = name.replace("'", "\\'")
        at = F.try_variant_get(t.column, f"$['{key}']", "variant")
        if name.isdigit():
            at = F.coalesce(F.try_variant_get(t.column, f"$[{int(name)}]", "variant"), at)
        return Term(at, "any", t.type)
    return Term(F.lit(None), "null")


def resolver(df: DataFrame, kinds: dict[str, str] | None = None):
    """path -> Term over df; a column's own name wins over a path into another column."""
    fields = {f.name: f.dataType for f in df.schema.fields}

    def resolve(path: str) -> Term:
        if path in fields:
            return Term(F.col(f"`{path}`"), (kinds or {}).get(path) if (kinds or {}).get(path) == "uuid" else kind_of_type(fields[path]), fields[path])
        head, *rest = path.split(".")
        if head not in fields or not rest:
            raise SchemaMismatch(f"no column {path!r}")
        return reduce(step, rest, Term(F.col(f"`{head}`"), kind_of_type(fields[head]), fields[head]))

    return resolve


# What schema_of_variant says of each kind, as the start of its answer, and the type to read it as.
VARIANT_KINDS = {"bool": (("BOOLEAN",), "boolean"), "int": (("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "double"), "float": (("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "double"), "str": (("STRING",), "string"), "timestamp": (("TIMESTAMP",), "timestamp_ntz"), "bytes": (("BINARY",), "binary")}


def typed(t: Term, kind: str) -> Column:
    """t's value where it is of the kind, else null."""
    if t.kind == "null":
        return F.lit(None)
    if t.kind != "any":
        return t.column if comparable(t.kind, kind) else F.lit(None)
    if kind not in VARIANT_KINDS:
        return F.lit(None)
    names, read = VARIANT_KINDS[kind]
    said = F.schema_of_variant(t.column)
    return F.when(reduce(lambda a, b: a | b, [said.startswith(n) for n in names]), F.try_variant_get(t.column, "$", read))


def settle(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)


def is_null(t: Term) -> Column:
    if t.kind == "null":
        return F.lit(True)
    return settle(F.is_variant_null(t.column)) | t.column.isNull() if t.kind == "any" else t.column.isNull()


def compile_cmp(t: Term, op: str, v: Any, strict: bool = True) -> Column:
    kind = kind_of_value(v)
    if kind == "null":
        return is_null(t) if op == "=" else ~is_null(t) if op == "<>" else F.lit(False)
    if not comparable(t.kind, kind) or t.kind == "null" or (kind == "float" and math.isnan(v)) or kind == "map":
        return F.lit(False)
    if kind == "list" and t.kind == "any":
        return F.lit(False)
    c, right = typed(t, kind), lit(v)
    if {t.kind, kind} == {"int", "float"} or (t.kind == "any" and kind in NUMBERS):
        c, right = c.cast("double"), right.cast("double")
    out = compare(c, op, right)
    if t.kind in ("float", "any") and kind in NUMBERS:
        out = out & ~F.isnan(c.cast("double"))
    return settle(out) if strict else out


def compile_contains(t: Term, v: Any) -> Column:
    if t.kind == "str" or (t.kind == "any" and isinstance(v, str)):
        inside = settle(typed(t, "str").contains(lit(v))) if isinstance(v, str) else F.lit(False)
        if t.kind == "str":
            return inside
        as_list = F.try_variant_get(t.column, "$", "array<variant>")
        key = v.replace("'", "\\'")
        return inside | settle(F.exists(as_list, lambda x: settle(F.schema_of_variant(x) == "STRING") & settle(F.try_variant_get(x, "$", "string") == v))) | F.try_variant_get(t.column, f"$['{key}']", "variant").isNotNull()
    if t.kind == "any":
        as_list = F.try_variant_get(t.column, "$", "array<variant>")
        return settle(F.exists(as_list, lambda x: compile_cmp(Term(x, "any", T.VariantType()), "=", v)))
    if t.kind == "list":
        inner = kind_of_type(t.type.elementType)
        return settle(F.exists(t.column, lambda x: compile_cmp(Term(x, inner, t.type.elementType), "=", v)))
    if t.kind == "map" and isinstance(v, str):
        if isinstance(t.type, T.StructType):
            return t.column.isNotNull() & F.lit(v in t.type.fieldNames())
        return settle(F.map_contains_key(t.column, F.lit(v)))
    return F.lit(False)


def compile(p: Pred, resolve, strict: bool = True) -> Column:
    """The predicate as a column that is true or false. If not strict, as in a filter, null may stand for false, which
    lets scans take the plain comparisons; below NOT it never does."""
    final = settle if strict else lambda c: c
    if isinstance(p, (And, Or)):
        parts = [compile(x, resolve, strict) for x in p.parts]
        if not parts:
            return F.lit(isinstance(p, And))
        return reduce((lambda a, b: a & b) if isinstance(p, And) else (lambda a, b: a | b), parts)
    if isinstance(p, Not):
        return ~compile(p.part, resolve)
    t = resolve(p.path)
    if isinstance(p, Cmp):
        return compile_cmp(t, p.op, p.value, strict)
    if isinstance(p, In):
        plain = [v for v in p.values if v is not None]
        if plain and t.kind != "any" and all(kind_of_value(v) == t.kind and t.kind not in ("float", "list", "map") for v in plain):
            return final(t.column.isin([str(v) if t.kind == "uuid" else v for v in plain]))
        return reduce(lambda a, b: a | b, [compile_cmp(t, "=", v, strict) for v in plain], F.lit(False))
    if isinstance(p, IsNull):
        return is_null(t)
    if isinstance(p, Prefix):
        return final(typed(t, "str").startswith(F.lit(p.value))) if t.kind in ("str", "any") else F.lit(False)
    if isinstance(p, Like):
        if t.kind not in ("str", "any") or not isinstance(p.pattern, str):
            return F.lit(False)
        c, pattern = typed(t, "str"), p.pattern
        if p.fold:
            return final(F.lower(c).rlike(like_pattern(pattern.lower())))
        head = pattern[:-1]
        if pattern.endswith("%") and not set(head) & set("%_"):
            return final(c.startswith(F.lit(head)))
        return final(c.rlike(like_pattern(pattern)))
    return compile_contains(t, p.value)
