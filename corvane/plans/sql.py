"""The SQL dialect: one table a statement, literals and paths only, two-valued conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..errors import InvalidQuery, SchemaMismatch
from ..functions.values import SQL_TYPES
from ..schema import Field, SchemaBuilder
from . import predicates as P
from .lexer import Cursor
from .query import Agg, Query, sort_keys

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
COMPARE = {"=": "=", "==": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


@dataclass
class Select:
    items: list = field(default_factory=list)  # "*", (path, name) or Agg
    table: str = ""
    pred: P.Pred | None = None
    by: list[str] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, text: str, params=None):
        self.c = Cursor(text, params)

    # ------------------------------------------------------------ conditions

    def condition(self) -> P.Pred:
        parts = [self._and()]
        while self.c.word("OR"):
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else P.Or(tuple(parts))

    def _and(self) -> P.Pred:
        parts = [self._not()]
        while self.c.word("AND"):
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else P.And(tuple(parts))

    def _not(self) -> P.Pred:
        if self.c.word("NOT"):
            return P.Not(self._not())
        if self.c.op("("):
            inner = self.condition()
            self.c.need_op(")")
            return inner
        return self._atom()

    def _operator(self) -> str:
        t = self.c.next()
        if t.kind != "op" or t.text not in COMPARE:
            self.c.fail("expected a comparison", t.at)
        return COMPARE[t.text]

    def _atom(self) -> P.Pred:
        c = self.c
        if c.is_literal():
            v = c.literal()
            op = P.FLIP[self._operator()]
            if c.is_literal():
                c.fail("one side of a comparison must be a column")
            return P.Cmp(c.path(), op, v)
        path = c.path()
        if c.word("IS"):
            negated = c.word("NOT")
            c.need("NULL")
            return P.Not(P.IsNull(path)) if negated else P.IsNull(path)
        negated = c.word("NOT")
        out = None
        if c.word("IN"):
            c.need_op("(")
            values = []
            while not c.op(")"):
                values.append(c.literal())
                if not c.op(","):
                    c.need_op(")")
                    break
            out = P.In(path, tuple(values))
        elif c.word("BETWEEN"):
            low = c.literal()
            c.need("AND")
            out = P.And((P.Cmp(path, ">=", low), P.Cmp(path, "<=", c.literal())))
        elif c.word("LIKE"):
            out = P.Like(path, c.literal())
        elif c.word("ILIKE"):
            out = P.Like(path, c.literal(), True)
        elif c.word("CONTAINS"):
            out = P.Contains(path, c.literal())
        if out is not None:
            return P.Not(out) if negated else out
        if negated:
            c.fail("expected IN, BETWEEN, LIKE, ILIKE or CONTAINS")
        op = self._operator()
        if not c.is_literal():
            c.fail("columns can only be compared with literals")
        return P.Cmp(path, op, c.literal())

    # ------------------------------------------------------------ SELECT

    def _item(self):
        c = self.c
        if c.op("*"):
            return "*"
        if c.is_word(*AGGREGATES) and c.peek(1).text == "(":
            fn = c.next().text.lower()
            c.need_op("(")
            column = None if c.op("*") else c.name()
            c.need_op(")")
            if column is None and fn != "count":
                c.fail(f"{fn}(*) isn't known")
            return Agg(fn, column, c.name() if c.word("AS") else None)
        path = c.path()
        if c.peek().text == "(":
            c.fail(f"unknown function {path!r}")
        return path, c.name() if c.word("AS") else path

    def select(self) -> Select:
        c, s = self.c, Select()
        s.items.append(self._item())
        while c.op(","):
            s.items.append(self._item())
        c.need("FROM")
        s.table = c.name()
        if c.word("WHERE"):
            s.pred = self.condition()
        if c.word("GROUP", "BY"):
            s.by.append(c.path())
            while c.op(","):
                s.by.append(c.path())
        if c.word("ORDER", "BY"):
            while True:
                if c.is_word(*AGGREGATES) and c.peek(1).text == "(":
                    path = self._item().label
                else:
                    path = c.path()
                s.order.append((path, c.word("DESC") or (c.word("ASC") and False)))
                if not c.op(","):
                    break
        for _ in range(2):
            if c.word("LIMIT"):
                s.limit = self._count("LIMIT")
            elif c.word("OFFSET"):
                s.offset = self._count("OFFSET")
        c.end()
        return s

    def _count(self, what: str) -> int:
        v = self.c.literal()
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise InvalidQuery(f"{what} must be a whole number from 0")
        return v

    # ------------------------------------------------------------ definitions

    def _type(self) -> str:
        name = self.c.name().upper()
        if name == "DOUBLE":
            self.c.word("PRECISION")
        if name not in SQL_TYPES:
            self.c.fail(f"unknown type {name}")
        if self.c.op("("):
            while not self.c.op(")"):
                self.c.next()
        return SQL_TYPES[name]

    def column(self) -> tuple[Field, bool, bool]:
        """(column, whether it's the primary key, whether it counts up)."""
        c = self.c
        name, kind = c.name(), self._type()
        options: dict = {}
        pk = auto = False
        while True:
            if c.word("PRIMARY", "KEY"):
                pk = True
            elif c.word("AUTOINCREMENT") or c.word("AUTO_INCREMENT"):
                auto = True
            elif c.word("NOT", "NULL"):
                options["nullable"] = False
            elif c.word("NULL"):
                pass
            elif c.word("UNIQUE"):
                options["unique"] = True
            elif c.word("INDEX") or c.word("INDEXED"):
                options["indexed"] = True
            elif c.word("DEFAULT"):
                options["default"] = c.literal()
            else:
                return Field(name, kind, **options), pk, auto


def plan_select(db, s: Select):
    """(DataFrame, None) of a SELECT."""
    q: Query = db.table(s.table).select()
    if s.pred is not None:
        q = q.filter(s.pred)
    aggregated = s.by or any(isinstance(i, Agg) for i in s.items)
    if not aggregated:
        for path, desc in s.order:
            q = q.order_by_desc(path) if desc else q.order_by(path)
        q = q.limit(s.limit).offset(s.offset)
        if s.items == ["*"]:
            return q.run()
        items = []
        for i in s.items:
            items += [(c, c) for c in q.df.columns] if i == "*" else [i]
        return q.project(items)
    if "*" in s.items:
        raise InvalidQuery("* can't stand beside aggregates")
    names = {}
    for i in s.items:
        if not isinstance(i, Agg):
            if i[0] not in s.by:
                raise InvalidQuery(f"{i[0]!r} must be in GROUP BY")
            names[i[0]] = i[1]
    aggs = [i for i in s.items if isinstance(i, Agg)]
    out = q.aggregate(aggs or [Agg("count").as_("__n")], tuple(s.by), names)
    if s.order:
        keys = []
        for path, desc in s.order:
            name = names.get(path, path)
            if name not in out.columns or name == "__n":
                raise InvalidQuery(f"ORDER BY {path!r} must name an output column")
            keys += sort_keys(P.resolver(out)(name), desc)
        out = out.orderBy(*keys)
    if s.offset:
        out = out.offset(s.offset)
    if s.limit is not None:
        out = out.limit(s.limit)
    return out.select(*[F.col(f"`{i.label if isinstance(i, Agg) else i[1]}`") for i in s.items])


def execute(db, text: str, params=None):
    """A DataFrame for SELECT, a list of keys for INSERT, a count for UPDATE and DELETE, a flag for definitions."""
    p = Parser(text, params)
    c = p.c
    if c.word("SELECT"):
        return plan_select(db, p.select())
    if c.is_word("INSERT", "UPSERT"):
        replace_rows = c.next().text.upper() == "UPSERT" or c.word("OR", "REPLACE")
        c.need("INTO")
        table = db.table(c.name())
        names = None
        if c.op("("):
            names = [c.name()]
            while c.op(","):
                names.append(c.name())
            c.need_op(")")
        names = names or table.schema.names
        c.need("VALUES")
        rows = []
        while True:
            c.need_op("(")
            values = [c.literal()]
            while c.op(","):
                values.append(c.literal())
            c.need_op(")")
            if len(values) != len(names):
                raise InvalidQuery(f"{len(values)} values for {len(names)} columns")
            rows.append(dict(zip(names, values)))
            if not c.op(","):
                break
        c.end()
        return table.upsert(rows) if replace_rows else table.insert(rows)
    if c.word("UPDATE"):
        table = db.table(c.name())
        c.need("SET")
        values = {}
        while True:
            name = c.name()
            c.need_op("=")
            values[name] = c.literal()
            if not c.op(","):
                break
        pred = p.condition() if c.word("WHERE") else None
        c.end()
        return table.update(values, pred)
    if c.word("DELETE"):
        c.need("FROM")
        table = db.table(c.name())
        pred = p.condition() if c.word("WHERE") else None
        c.end()
        return table.delete(pred)
    if c.word("CREATE", "TABLE"):
        return _create_table(db, p)
    if c.word("DROP", "TABLE"):
        quiet = c.word("IF", "EXISTS")
        name = c.name()
        c.end()
        if quiet and name not in db.tables():
            return False
        db.drop_table(name)
        return True
    if c.is_word("CREATE", "DROP") and c.is_word("INDEX", ahead=1):
        making = c.next().text.upper() == "CREATE"
        c.need("INDEX")
        if not c.is_word("ON"):
            c.name()
        c.need("ON")
        name = c.name()
        c.need_op("(")
        column = c.name()
        c.need_op(")")
        c.end()
        schema = db.table(name).schema
        f = schema.field(column)
        changed = Field(f.name, f.kind, f.nullable, f.unique if making else False, making, f.default)
        db.ensure_table(type(schema)(schema.name, schema.pk, tuple(changed if x.name == column else x for x in schema.fields), schema.auto_increment).checked())
        return True
    if c.word("ALTER", "TABLE"):
        schema = db.table(c.name()).schema
        if c.word("ADD"):
            c.word("COLUMN")
            f, pk, _ = p.column()
            if pk or f.name in [x.name for x in schema.fields]:
                raise SchemaMismatch(f"column {f.name!r} can't be added")
            new = schema.with_field(f)
        else:
            c.need("DROP")
            c.word("COLUMN")
            new = schema.without(c.name())
        c.end()
        db.ensure_table(new)
        return True
    c.fail("expected a statement")


def _create_table(db, p: Parser) -> bool:
    c = p.c
    quiet = c.word("IF", "NOT", "EXISTS")
    b = SchemaBuilder(c.name())
    c.need_op("(")
    key = None
    while True:
        if c.word("PRIMARY", "KEY"):
            c.need_op("(")
            key = (c.name(), False)
            c.need_op(")")
        else:
            f, pk, auto = p.column()
            b._fields[f.name] = f
            if pk:
                key = (f.name, auto)
        if not c.op(","):
            break
    c.need_op(")")
    c.end()
    if key is None:
        raise SchemaMismatch(f"table {b._name!r} has no primary key")
    b._pk, b._auto = key
    schema = b.build()
    if quiet and schema.name in db.tables():
        return False
    return db.create_table(schema)
