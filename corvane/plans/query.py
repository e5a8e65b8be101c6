"""The relational query: filter, order, paging, projection and aggregation over one table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQuery, SchemaMismatch
from . import predicates as P


@dataclass(frozen=True)
class Agg:
    """An aggregate: Agg.count(), Agg.count("x"), Agg.sum("x") and so on; as_ names its column."""

    fn: str
    column: str | None = None
    name: str | None = None

    def as_(self, name: str) -> Agg:
        return replace(self, name=name)

    @property
    def label(self) -> str:
        return self.name or f"{self.fn}({self.column or '*'})"


for _fn in ("count", "sum", "avg", "min", "max"):
    setattr(Agg, _fn, staticmethod(lambda column=None, _fn=_fn: Agg(_fn, column)))


def sort_keys(t: P.Term, desc: bool) -> list[Column]:
    """Ascending puts nulls first and descending last; variants sort by kind, then value."""
    if t.kind == "any":
        said = F.schema_of_variant(t.column)
        rank = F.when(P.is_null(t), 0).when(said.startswith("BOOLEAN"), 1).when(said.startswith("STRING"), 3).when(said.startswith("ARRAY"), 8).when(said.startswith("OBJECT"), 9).otherwise(2)
        keys = [rank, P.typed(t, "bool"), P.typed(t, "float"), P.typed(t, "str")]
    elif t.kind == "map":
        keys = [F.to_json(t.column)]
    else:
        keys = [t.column]
    return [k.desc_nulls_last() if desc else k.asc_nulls_first() for k in keys]


def group_value(t: P.Term) -> Column:
    """What groups by t: itself, or JSON text for what Spark can't group by; a variant's scalar as its text."""
    return F.try_variant_get(t.column, "$", "string") if t.kind == "any" else F.to_json(t.column) if t.kind == "map" else t.column


@dataclass(frozen=True)
class Query:
    """A lazy query over df whose rows have the unique key pk; every method returns a new query."""

    df: DataFrame
    pk: str | None = None
    kinds: dict = field(default_factory=dict)
    pred: P.Pred | None = None
    order: tuple[tuple[str, bool], ...] = ()
    take: int | None = None
    skip: int = 0
    kept: tuple[str, ...] | None = None

    def filter(self, pred: P.Pred | dict) -> Query:
        pred = P.where(pred) if isinstance(pred, dict) else pred
        return replace(self, pred=pred if self.pred is None else P.And((self.pred, pred)))

    def order_by(self, path: str) -> Query:
        return replace(self, order=(*self.order, (path, False)))

    def order_by_desc(self, path: str) -> Query:
        return replace(self, order=(*self.order, (path, True)))

    def limit(self, n: int | None) -> Query:
        return replace(self, take=_natural(n, "LIMIT"))

    def offset(self, n: int) -> Query:
        return replace(self, skip=_natural(n, "OFFSET") or 0)

    def columns(self, names) -> Query:
        return replace(self, kept=tuple(names))

    @property
    def resolve(self):
        return P.resolver(self.df, self.kinds)

    def matching(self) -> DataFrame:
        """All rows that pass the filter, unordered."""
        return self.df if self.pred is None else self.df.where(P.compile(self.pred, self.resolve, strict=False))

    def rows(self) -> DataFrame:
        """Rows in order and cut to the page. Without an order a page is taken by pk."""
        out = self.matching()
        if self.order or self.take is not None or self.skip:
            keys = [k for path, desc in self.order for k in sort_keys(self.resolve(path), desc)]
            if self.pk:
                keys.append(F.col(f"`{self.pk}`").asc_nulls_first())
            out = out.orderBy(*keys) if keys else out
        if self.skip:
            out = out.offset(self.skip)
        return out if self.take is None else out.limit(self.take)

    def run(self) -> DataFrame:
        if self.kept is None:
            return self.rows()
        for c in self.kept:
            if c not in self.df.columns:
                raise SchemaMismatch(f"no column {c!r}")
        names = [*([self.pk] if self.pk and self.pk not in self.kept else []), *self.kept]
        return self.rows().select(*[F.col(f"`{c}`") for c in names])

    def project(self, items: list[tuple[str, str]]) -> DataFrame:
        """Paths with names, over rows()."""
        return self.rows().select(*[self.resolve(path).column.alias(name) for path, name in items])

    def count(self) -> int:
        return self.matching().count()

    def aggregate(self, aggs: list[Agg], by: tuple[str, ...] = (), names: dict[str, str] | None = None) -> DataFrame:
        """One row a group, in order of the keys (null is a key); one row in all without keys."""
        resolve = self.resolve
        keys = {path: (names or {}).get(path, path) for path in by}
        for path, agg in [(a.column, a) for a in aggs if a.column is not None]:
            if path not in self.df.columns:
                raise SchemaMismatch(f"no column {path!r}")
            if agg.fn in ("sum", "avg") and resolve(path).kind not in P.NUMBERS:
                raise SchemaMismatch(f"{agg.fn} needs numbers; {path!r} holds {resolve(path).kind}")
        cols = [self._agg(a, resolve).alias(a.label) for a in aggs]
        base = self.matching()
        if not by:
            return base.agg(*cols)
        flat = base.select("*", *[group_value(resolve(p)).alias(f"__k{i}") for i, p in enumerate(by)])
        out = flat.groupBy(*[f"__k{i}" for i in range(len(by))]).agg(*cols).orderBy(*[F.col(f"__k{i}").asc_nulls_first() for i in range(len(by))])
        return out.select(*[F.col(f"__k{i}").alias(keys[p]) for i, p in enumerate(by)], *[F.col(f"`{a.label}`") for a in aggs])

    @staticmethod
    def _agg(a: Agg, resolve) -> Column:
        if a.column is None:
            if a.fn != "count":
                raise InvalidQuery(f"{a.fn} needs a column")
            return F.count(F.lit(1))
        t = resolve(a.column)
        if a.fn == "sum":  # fails only if the sum itself leaves 64 bits
            return F.sum(t.column.cast(T.DecimalType(38, 0))).cast("bigint") if t.kind == "int" else F.sum(t.column)
        if a.fn == "avg":
            return F.avg(t.column.cast("double"))
        return {"count": F.count, "min": F.min, "max": F.max}[a.fn](t.column)


def _natural(n, what: str):
    if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
        raise InvalidQuery(f"{what} must be a whole number from 0")
    return n


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
