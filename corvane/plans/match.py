"""MATCH: read-only patterns over the graph, compiled to one join a hop.

MATCH (a:Label {p: v})-[r:T1|T2 *1..3 {p: v}]->(b) WHERE ... RETURN [DISTINCT] items [ORDER BY ...] [SKIP n] [LIMIT n]
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQuery
from ..functions.values import comparable, kind_of_type, kind_of_value, like_pattern
from ..storage import settle
from . import predicates as P
from .lexer import Cursor
from .query import sort_keys

#: Edges of a variable-length hop at most; a longer or open bound means this.
MAX_HOPS = 16
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT")


@dataclass
class Node:
    var: str | None
    label: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Rel:
    var: str | None
    types: list[str] = field(default_factory=list)
    direction: str = "out"
    low: int | None = None  # set for a variable length
    high: int | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Item:
    expr: Any
    name: str


# expressions: ("lit", v) | ("var", v) | ("prop", v, [steps]) | ("id"|"label"|"type", v) | ("agg", fn, expr or None)


class Parser:
    def __init__(self, text: str, params=None):
        self.c = Cursor(text, params, comment="//", named_colon=False)
        self.nodes: list[Node] = []
        self.rels: list[Rel] = []
        self.where = None
        self.items: list[Item] | None = None
        self.distinct = False
        self.order: list[tuple[Any, str, bool]] = []
        self.skip = self.limit = None
        self._query()

    def _query(self):
        c = self.c
        c.need("MATCH")
        self._pattern()
        if c.word("WHERE"):
            self.where = self._or()
        c.need("RETURN")
        self.distinct = c.word("DISTINCT")
        if not c.op("*"):
            self.items = [self._item()]
            while c.op(","):
                self.items.append(self._item())
        if c.word("ORDER", "BY"):
            while True:
                at = c.i
                e = self._expr()
                text = self._text(at)
                desc = c.word("DESC") or c.word("DESCENDING")
                if not desc:
                    c.word("ASC") or c.word("ASCENDING")
                self.order.append((e, text, desc))
                if not c.op(","):
                    break
        for _ in range(2):
            if c.word("SKIP"):
                self.skip = self._count()
            elif c.word("LIMIT"):
                self.limit = self._count()
        c.end()

    def _count(self) -> int:
        v = self.c.literal()
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise InvalidQuery("SKIP and LIMIT must be whole numbers from 0")
        return v

    def _text(self, at: int) -> str:
        start, end = self.c.tokens[at].at, self.c.peek(-1)
        return self.c.source[start : end.at + len(end.text)]

    def _props(self) -> dict:
        return self.c.literal() if self.c.peek().text == "{" else {}

    def _node(self) -> Node:
        c = self.c
        c.need_op("(")
        var = c.name() if c.peek().kind in ("name", "quoted") else None
        label = c.name() if c.op(":") else None
        out = Node(var, label, self._props())
        c.need_op(")")
        return out

    def _rel(self) -> Rel | None:
        c = self.c
        if c.op("<-"):
            back = True
        elif c.op("-"):
            back = False
        elif c.op("->"):
            return Rel(None)
        else:
            return None
        r = Rel(None)
        if c.op("["):
            r.var = c.name() if c.peek().kind in ("name", "quoted") else None
            if c.op(":"):
                r.types.append(c.name())
                while c.op("|"):
                    c.op(":")
                    r.types.append(c.name())
            if c.op("*"):
                r.low, r.high = 1, MAX_HOPS
                if c.peek().kind == "num":
                    low = self._bound(c.next().text)
                    r.low, r.high = low, low
                    if c.op(".."):
                        r.high = self._bound(c.next().text) if c.peek().kind == "num" else MAX_HOPS
                elif c.op(".."):
                    r.high = self._bound(c.next().text) if c.peek().kind == "num" else MAX_HOPS
                if r.low > r.high or r.high > MAX_HOPS:
                    c.fail(f"a path's least length can't be above its greatest, nor that above {MAX_HOPS}")
            r.props = self._props()
            c.need_op("]")
        ahead = c.op("->") or (c.op("-") and False)
        if back and ahead:
            c.fail("an edge can't point both ways")
        r.direction = "in" if back else "out" if ahead else "both"
        return r

    def _bound(self, text: str) -> int:
        if not text.isdigit():
            self.c.fail("expected a whole number")
        return int(text)

    def _pattern(self):
        self.nodes.append(self._node())
        while r := self._rel():
            self.rels.append(r)
            self.nodes.append(self._node())
        if self.c.op(","):
            self.c.fail("one pattern a query")

    # ------------------------------------------------------------ expressions

    def _item(self) -> Item:
        at = self.c.i
        e = self._expr()
        text = self._text(at)
        return Item(e, self.c.name() if self.c.word("AS") else text)

    def _expr(self):
        c = self.c
        if c.is_literal():
            return ("lit", c.literal())
        if c.is_word(*AGGREGATES) and c.peek(1).text == "(":
            fn = c.next().text.lower()
            c.need_op("(")
            inner = None if c.op("*") else self._expr()
            if inner is None and fn != "count":
                c.fail(f"{fn}(*) isn't known")
            if inner and inner[0] == "agg":
                c.fail("aggregates can't be nested")
            c.need_op(")")
            return ("agg", fn, inner)
        name = c.name()
        if c.op("("):
            fn = {"ID": "id", "LABEL": "label", "LABELS": "label", "TYPE": "type"}.get(name.upper())
            if not fn:
                c.fail(f"unknown function {name!r}")
            var = c.name()
            c.need_op(")")
            return (fn, var)
        steps = []
        while c.op("."):
            steps.append(c.next().text if c.peek().kind == "num" else c.name())
        return ("prop", name, [s for x in steps for s in x.split(".")]) if steps else ("var", name)

    def _or(self):
        parts = [self._and()]
        while self.c.word("OR"):
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def _and(self):
        parts = [self._not()]
        while self.c.word("AND"):
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def _not(self):
        c = self.c
        if c.word("NOT"):
            return ("not", self._not())
        if c.op("("):
            inner = self._or()
            c.need_op(")")
            return inner
        if c.peek().kind == "name" and c.peek(1).text == ":" and not c.is_literal():
            var = c.name()
            c.next()
            return ("is", var, c.name())
        left = self._expr()
        if c.word("IS"):
            negated = c.word("NOT")
            c.need("NULL")
            return ("not", ("null", left)) if negated else ("null", left)
        negated = c.word("NOT")
        if c.word("IN"):
            out = ("in", left, self._expr())
            return ("not", out) if negated else out
        for word, fold in (("LIKE", False), ("ILIKE", True)):
            if c.word(word):
                return ("like", left, self._expr(), fold, negated)
        if c.word("CONTAINS"):
            out = ("contains", left, self._expr())
            return ("not", out) if negated else out
        if negated:
            c.fail("expected IN, LIKE, ILIKE or CONTAINS")
        if c.word("STARTS", "WITH"):
            return ("starts", left, self._expr())
        if c.word("ENDS", "WITH"):
            return ("ends", left, self._expr())
        if c.op("<-"):  # x <-1 is x < -1
            v = c.literal()
            return ("cmp", "<", left, ("lit", -v))
        t = c.next()
        ops = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
        if t.text not in ops:
            c.fail("expected a comparison", t.at)
        return ("cmp", ops[t.text], left, self._expr())


@dataclass
class Factor:
    """A relation over the ids v0, v1, ... of some nodes; m counts the bindings that a row stands for, if they count."""

    df: DataFrame
    over: frozenset[int]
    unique: bool = False  # one row for the ids
    rows: int | None = None
    distinct: dict[int, int] = field(default_factory=dict)

    def measure(self) -> None:
        """Settles it, for its number of rows and about how many ids each node has."""
        if self.rows is None:
            self.df = settle(self.df)
            at = sorted(self.over)
            self.rows, *counts = self.df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(f"v{v}") for v in at]).first()
            self.distinct = dict(zip(at, counts))

    def join(self, other: Factor, counted: bool) -> Factor:
        """Both on what they share; rows and ids as they would be if ids were independent."""
        shared = sorted(self.over & other.over)
        on = [f"v{v}" for v in shared]
        over = self.over | other.over
        if not counted:
            df = self.df.join(other.df, on) if on else self.df.crossJoin(other.df)
        else:
            right = other.df.withColumnRenamed("m", "times")
            df = (self.df.join(right, on) if on else self.df.crossJoin(right)).withColumn("m", F.col("m") * F.col("times")).drop("times")
        if self.rows is None or other.rows is None:
            return Factor(df, over)
        same = reduce(lambda n, v: n * max(self.distinct[v], other.distinct[v], 1), shared, 1)
        ids = {v: min([f.distinct[v] for f in (self, other) if v in f.over]) for v in over}
        return Factor(df, over, rows=self.rows * other.rows // same, distinct=ids)

    def without(self, gone: set[int], counted: bool) -> Factor:
        left = self.over - gone
        names = [f"v{v}" for v in sorted(left)]
        return Factor(self.df.groupBy(*names).agg(F.sum("m").alias("m")) if counted else self.df.select(*names).distinct(), left, True)


class Compiler:
    def __init__(self, p: Parser, nodes: DataFrame, edges: DataFrame):
        self.p, self.nodes, self.edges = p, nodes, edges
        self.nprops, self.eprops = nodes.schema["properties"].dataType, edges.schema["properties"].dataType
        self.vars: dict[str, tuple[str, int]] = {}
        self.counted = False  # whether rows stand for m bindings each
        for i, n in enumerate(p.nodes):
            if n.var:
                if self.vars.get(n.var, ("node",))[0] != "node":
                    raise InvalidQuery(f"{n.var!r} is a node and an edge")
                self.vars.setdefault(n.var, ("node", i))
        for i, r in enumerate(p.rels):
            if r.var:
                if r.var in self.vars:
                    raise InvalidQuery(f"{r.var!r} is named twice")
                self.vars[r.var] = ("path" if r.low is not None else "edge", i)

    # ------------------------------------------------------------ joins

    def _inline(self, props: dict, t: P.Term) -> list[Column]:
        return [P.compile_cmp(P.step(t, k), "=", v, strict=False) if v is not None else F.lit(False) for k, v in props.items()]

    def _fitting(self, df: DataFrame, n: Node) -> DataFrame:
        if n.label:
            df = df.where(F.col("label") == n.label)
        for c in self._inline(n.props, P.Term(F.col("properties"), kind_of_type(self.nprops), self.nprops)):
            df = df.where(c)
        return df

    def _node(self, i: int) -> DataFrame:
        return self._fitting(self.nodes, self.p.nodes[i]).select(F.struct("id", "label", "properties").alias(f"n{i}"))

    def _first(self, i: int) -> int:
        """Where the i-th node's variable stands first."""
        var = self.p.nodes[i].var
        return self.vars[var][1] if var else i

    def _conjuncts(self) -> list:
        w = self.p.where
        return [] if w is None else w[1] if w[0] == "and" else [w]

    def _read(self, e) -> set[str]:
        """The variables in an expression or a condition."""
        if e is None or e[0] == "lit":
            return set()
        if e[0] in ("var", "prop", "id", "label", "type", "is"):
            return {e[1]}
        return set().union(*map(self._read, e[1] if e[0] in ("and", "or") else [x for x in e[1:] if isinstance(x, tuple)]))

    def _asked(self, i: int) -> bool:
        """Whether the pattern or its WHERE asks more of the i-th node than its being there."""
        n = self.p.nodes[i]
        return bool(n.label or n.props or any(n.var in self._read(c) for c in self._conjuncts()))

    def _apart(self, i: int, k: int) -> bool:
        """Whether no edge can be in both hops, by their types or by the labels of one of their ends."""
        a, b = self.p.rels[i], self.p.rels[k]
        if a.types and b.types and not set(a.types) & set(b.types):
            return True
        if "both" in (a.direction, b.direction) or a.low is not None or b.low is not None:
            return False

        def ends(j: int, r: Rel) -> list[str | None]:
            labels = [next((n.label for x, n in enumerate(self.p.nodes) if n.label and self._first(x) == self._first(at)), None) for at in (j, j + 1)]
            return labels if r.direction == "out" else labels[::-1]

        return any(x and y and x != y for x, y in zip(ends(i, a), ends(k, b)))

    def _hop_edges(self, r: Rel) -> DataFrame:
        df = self.edges
        if r.types:
            df = df.where(F.col("type").isin(r.types))
        for c in self._inline(r.props, P.Term(F.col("properties"), kind_of_type(self.eprops), self.eprops)):
            df = df.where(c)
        e = F.struct("id", "type", F.col("src").alias("from"), F.col("dst").alias("to"), "properties").alias("e")
        out = df.select(F.col("src").alias("s"), F.col("dst").alias("d"), e)
        back = df.select(F.col("dst").alias("s"), F.col("src").alias("d"), e)
        return out if r.direction == "out" else back if r.direction == "in" else out.unionByName(back.where("s <> d"))

    def bindings(self) -> DataFrame:
        p = self.p
        df = self._node(0)
        found: list[tuple[str, bool]] = []  # (column, whether it's an array)
        for i, r in enumerate(p.rels):
            hop = self._hop_edges(r)
            used = [u for k, u in enumerate(found) if not self._apart(k, i)]
            target = self._node(i + 1)
            j = next((k for k in range(i + 1) if p.nodes[i + 1].var and p.nodes[k].var == p.nodes[i + 1].var), None)
            closes = F.lit(True) if j is None else F.col(f"n{j}.id") == F.col(f"n{i + 1}.id")
            if r.low is None:
                hop = hop.select("s", "d", F.col("e").alias(f"r{i}"))
                if self._asked(i + 1):
                    # What is asked of the target goes first, so that no hub's edges meet only to be dropped.
                    hop = hop.join(target, F.col("d") == F.col(f"n{i + 1}.id"))
                    df = df.join(hop, (F.col(f"n{i}.id") == F.col("s")) & closes).drop("s", "d")
                else:
                    df = df.join(hop, F.col(f"n{i}.id") == F.col("s")).drop("s")
                    df = df.join(target, (F.col("d") == F.col(f"n{i + 1}.id")) & closes).drop("d")
                for name, many in used:
                    df = df.where(~F.exists(name, lambda x: x["id"] == F.col(f"r{i}.id")) if many else F.col(f"{name}.id") != F.col(f"r{i}.id"))
            else:
                df = self._trails(df, i, r, hop, used).join(target, (F.col("d") == F.col(f"n{i + 1}.id")) & closes).drop("d")
            found.append((f"r{i}", r.low is not None))
        return df if p.where is None else df.where(self.cond(p.where))

    def _reduced(self) -> DataFrame | None:
        """Bindings of the nodes that results read only: distinct ones, or with their numbers as m if results are counts.

        Hops and nodes are factors. Nodes that nothing reads are summed out one by one: those in one factor first, then
        those whose factors' join is least by the factors' measured rows, so that a cycle isn't walked through its hubs.
        None where this can't serve: edges or their order are read, an edge could stand in two hops, or all is read.
        """
        p = self.p
        if not p.rels or p.items is None or any(r.low is not None for r in p.rels):
            return None
        aggs = [i.expr[1] for i in p.items if i.expr[0] == "agg"]
        if not (p.distinct or aggs) or set(aggs) - {"count", "min", "max"} or any(text not in [i.name for i in p.items] for _, text, _ in p.order):
            return None
        conjuncts = self._conjuncts()
        reads = set().union(*(self._read(x) for x in [*conjuncts, *(i.expr for i in p.items)]))
        if any(self.vars.get(v, ("",))[0] != "node" for v in reads) or not all(self._apart(i, k) for i in range(len(p.rels)) for k in range(i)):
            return None
        ids = lambda e: {self.vars[v][1] for v in self._read(e)}
        across = [c for c in conjuncts if len(ids(c)) != 1]
        need = set().union(*map(ids, [*across, *(i.expr for i in p.items)]))
        spare = {self._first(i) for i in range(len(p.nodes))} - need
        if not spare or not (need or aggs):
            return None
        counted = self.counted = bool(aggs)

        def fitting(v: int) -> tuple[DataFrame, bool]:
            """Nodes that can be v, and whether anything but their being there is asked."""
            same = [n for i, n in enumerate(p.nodes) if self._first(i) == v]
            own = [c for c in conjuncts if ids(c) == {v}]
            df = reduce(self._fitting, same, self.nodes).select(F.struct("id", "label", "properties").alias(f"n{v}"))
            return reduce(DataFrame.where, map(self.cond, own), df), bool(own or any(n.label or n.props for n in same))

        factors, checked = [], set()
        for i, r in enumerate(p.rels):
            a, b = self._first(i), self._first(i + 1)
            hop = self._hop_edges(r) if a != b else self._hop_edges(r).where("s = d")
            hop = hop.select(F.col("s").alias(f"v{a}"), *([F.col("d").alias(f"v{b}")] if a != b else []), *([F.lit(1).cast("long").alias("m")] if counted else []))
            for v in sorted({a, b} - checked):
                nodes, asked = fitting(v)
                if v in spare or asked:
                    hop = hop.join(nodes.select(F.col(f"n{v}.id").alias(f"v{v}")), f"v{v}", "left_semi")
                    checked.add(v)
            factors.append(Factor(hop, frozenset({a, b})))
        while True:
            inside = next(((f, g) for f in factors for g in factors if f is not g and f.unique and f.over <= g.over), None)
            if inside:
                f, g = inside
                joined = g.join(f, counted)
                factors = [Factor(joined.df, g.over, g.unique), *(x for x in factors if x is not f and x is not g)]
                continue
            left = spare & frozenset().union(*(f.over for f in factors))
            if not left:
                break
            of = {v: [f for f in factors if v in f.over] for v in left}
            if once := {v for v in left if len(of[v]) == 1}:
                f = of[min(once)][0]
                factors = [f.without(once & f.over, counted), *(x for x in factors if x is not f)]
                continue
            for f in factors:
                f.measure()
            v = min(sorted(left), key=lambda v: reduce(lambda f, g: f.join(g, counted), of[v]).rows)
            joined = reduce(lambda f, g: f.join(g, counted), of[v]).without({v}, counted)
            factors = [joined, *(x for x in factors if v not in x.over)]
        out = factors.pop(0)
        while factors:
            f = next((f for f in factors if f.over & out.over), factors[0])
            factors.remove(f)
            out = out.join(f, counted)
        df = out.df
        for v in sorted(need):
            df = df.join(fitting(v)[0], F.col(f"v{v}") == F.col(f"n{v}.id")).drop(f"v{v}")
        return reduce(DataFrame.where, map(self.cond, across), df)

    def _trails(self, df: DataFrame, i: int, r: Rel, hop: DataFrame, used) -> DataFrame:
        """Trails of low to high edges, none of them used twice: one join for each length."""
        cast = T.ArrayType(hop.schema["e"].dataType)
        at = df.withColumns({"d": F.col(f"n{i}.id"), f"r{i}": F.array().cast(cast)})
        found = [at] if r.low == 0 else []
        for depth in range(1, r.high + 1):
            step = at.withColumnRenamed("d", "at").join(hop, F.col("at") == F.col("s")).drop("s", "at")
            fresh = ~F.exists(f"r{i}", lambda x: x["id"] == F.col("e.id"))
            for name, many in used:
                fresh = fresh & (~F.exists(name, lambda x: x["id"] == F.col("e.id")) if many else F.col(f"{name}.id") != F.col("e.id"))
            at = step.where(fresh).withColumn(f"r{i}", F.concat(f"r{i}", F.array("e"))).drop("e")
            if depth >= r.low:
                found.append(at)
        return reduce(DataFrame.unionByName, found)

    # ------------------------------------------------------------ values

    def term(self, e) -> P.Term:
        kind = e[0]
        if kind == "lit":
            return P.Term(P.lit(e[1]), kind_of_value(e[1])) if not isinstance(e[1], dict) else P.Term(F.parse_json(F.lit(__import__("json").dumps(e[1]))), "any", T.VariantType())
        if kind == "agg":
            raise InvalidQuery("an aggregate can't stand here")
        if e[1] not in self.vars:
            raise InvalidQuery(f"no variable {e[1]!r}")
        what, i = self.vars[e[1]]
        c = F.col(f"{'n' if what == 'node' else 'r'}{i}")
        if kind == "var":
            return P.Term(c, "map")
        if kind == "id" and what != "path":
            return P.Term(c["id"], "int", T.LongType())
        if kind == "label" and what == "node":
            return P.Term(c["label"], "str", T.StringType())
        if kind == "type" and what == "edge":
            return P.Term(c["type"], "str", T.StringType())
        if kind == "prop" and what != "path":
            t = self.nprops if what == "node" else self.eprops
            return reduce(P.step, e[2], P.Term(c["properties"], kind_of_type(t), t))
        raise InvalidQuery(f"{kind} doesn't apply to {e[1]!r}")

    def compare(self, op: str, left, right) -> Column:
        a, b = self.term(left), self.term(right)
        if right[0] == "lit" and a.kind == "any" and right[1] is not None:
            b = P.Term(b.column, b.kind)
            a = P.Term(P.typed(a, b.kind), "float" if b.kind in P.NUMBERS else b.kind, None) if b.kind in P.VARIANT_KINDS else a
            missing = P.is_null(self.term(left))
        elif left[0] == "lit" and b.kind == "any" and left[1] is not None:
            return self.compare(P.FLIP[op], right, left)
        else:
            missing = P.is_null(a)
        empty = P.is_null(self.term(right))
        if a.kind == b.kind == "any":  # numbers with numbers, texts with texts
            same = P.settle(F.coalesce(*[P.compare(P.typed(a, k), op, P.typed(b, k)) for k in ("float", "str", "bool")]))
        elif a.kind == "null" or b.kind == "null" or not comparable(a.kind, b.kind):
            same = F.lit(False)
        else:
            x, y = a.column, b.column
            if a.kind != b.kind:
                x, y = x.cast("double"), y.cast("double")
            same = P.settle(P.compare(x, op, y))
            if a.kind == "float":
                same = same & ~P.settle(F.isnan(x.cast("double")))
        if op == "=":
            return (missing & empty) | (~missing & ~empty & same)
        if op == "<>":
            return (missing != empty) | (~missing & ~empty & same)
        return ~missing & ~empty & same

    def _text(self, e) -> tuple[Column, Column]:
        """(the string, whether it is one)."""
        t = self.term(e)
        c = P.typed(t, "str") if t.kind in ("str", "any") else F.lit(None)
        return c.cast("string"), c.isNotNull()

    def cond(self, e) -> Column:
        kind = e[0]
        if kind in ("and", "or"):
            return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), map(self.cond, e[1]))
        if kind == "not":
            return ~self.cond(e[1])
        if kind == "is":
            what, i = self.vars.get(e[1], (None, 0))
            if what != "node":
                raise InvalidQuery(f"{e[1]!r} has no label")
            return P.settle(F.col(f"n{i}.label") == e[2])
        if kind == "null":
            return P.is_null(self.term(e[1]))
        if kind == "cmp":
            return self.compare(e[1], e[2], e[3])
        if kind == "in":
            t = self.term(e[1])
            if e[2][0] == "lit":
                if not isinstance(e[2][1], (list, tuple)):
                    raise InvalidQuery("IN needs a list")
                return reduce(lambda a, b: a | b, [P.compile_cmp(t, "=", v) for v in e[2][1] if v is not None], F.lit(False))
            if e[1][0] != "lit":
                raise InvalidQuery("IN needs a list or a literal")
            return P.compile_contains(self.term(e[2]), e[1][1])
        if kind == "like":
            c, ok = self._text(e[1])
            if e[2][0] != "lit":
                pattern, known = self._text(e[2])
                hit = (F.ilike if e[3] else F.like)(c, pattern)
                return P.settle(ok & known & (~hit if e[4] else hit))
            if not isinstance(e[2][1], str):
                return F.lit(False)
            hit = F.lower(c).rlike(like_pattern(e[2][1].lower())) if e[3] else c.rlike(like_pattern(e[2][1]))
            return P.settle(ok & (~hit if e[4] else hit))
        if kind == "contains":
            if e[2][0] == "lit":
                return P.compile_contains(self.term(e[1]), e[2][1])
            (a, _), (b, _) = self._text(e[1]), self._text(e[2])
            return P.settle(a.contains(b))
        a, b = self._text(e[1])[0], self._text(e[2])[0]
        return P.settle(a.startswith(b) if kind == "starts" else a.endswith(b))

    # ------------------------------------------------------------ results

    def aggregate(self, e) -> Column:
        _, fn, inner = e
        total = (lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0).cast("long"))) if self.counted else (lambda c: F.count(F.when(c, F.lit(1))))
        if inner is None:
            return total(F.lit(True))
        t = self.term(inner)
        if fn == "count":
            return total(~P.is_null(t))
        if fn == "collect":
            return F.collect_list(t.column)
        if fn in ("sum", "avg"):
            if t.kind == "any":
                number = P.typed(t, "float")
                wrong = F.raise_error(F.lit(f"{fn} needs numbers")).cast("double")
                t = P.Term(F.when(number.isNull() & ~P.is_null(t), wrong).otherwise(number), "float")
            if t.kind not in P.NUMBERS:
                raise InvalidQuery(f"{fn} needs numbers")
            if fn == "avg":
                return F.avg(t.column.cast("double"))
            return F.sum(t.column.cast(T.DecimalType(38, 0))).cast("bigint") if t.kind == "int" else F.sum(t.column)
        if t.kind == "any":  # by kind, then value
            order = F.struct(F.when(F.schema_of_variant(t.column) == "STRING", 1).otherwise(0), P.typed(t, "float"), P.typed(t, "str"))
            return (F.min_by if fn == "min" else F.max_by)(t.column, F.when(~P.is_null(t), order))
        return (F.min if fn == "min" else F.max)(t.column)

    @staticmethod
    def group_key(name: str, type: T.DataType) -> Column:
        """What groups by a result: nodes and edges by id, variants by their JSON text."""
        if isinstance(type, T.StructType):
            return F.col(f"{name}.id")
        return F.to_json(F.struct(name)) if isinstance(type, (T.VariantType, T.MapType, T.ArrayType)) else F.col(name)

    def run(self) -> DataFrame:
        p = self.p
        base = self._reduced()
        if base is None:
            base = self.bindings()
        items = p.items if p.items is not None else [Item(("var", v), v) for v in sorted(self.vars)]
        names = [i.name for i in items]
        if len(set(names)) < len(names):
            raise InvalidQuery("two results have one name")
        grouped = any(i.expr[0] == "agg" for i in items)
        keys: list[tuple[Any, bool]] = []
        if grouped:
            plain = [i for i in items if i.expr[0] != "agg"]
            flat = base.withColumns({f"k{j}": self.term(i.expr).column for j, i in enumerate(plain)}) if plain else base
            by = [self.group_key(f"k{j}", flat.schema[f"k{j}"].dataType) for j in range(len(plain))]
            shown = {i.name: f"k{j}" for j, i in enumerate(plain)}
            aggs = [self.aggregate(i.expr).alias(f"a{j}") for j, i in enumerate(items) if i.expr[0] == "agg"]
            firsts = [F.first(f"k{j}").alias(f"f{j}") for j in range(len(plain))]
            out = (flat.groupBy(*[b.alias(f"g{j}") for j, b in enumerate(by)]) if plain else flat).agg(*aggs, *firsts)
            out = out.select(*[F.col(f"f{shown[i.name][1:]}" if i.name in shown else f"a{j}").alias(i.name) for j, i in enumerate(items)])
            for e, text, desc in p.order:
                if text not in names:
                    raise InvalidQuery(f"ORDER BY {text!r} must name a result")
                keys.append((text, desc))
        else:
            cols = [self.term(i.expr).column.alias(i.name) for i in items]
            extra = {}
            for j, (e, text, desc) in enumerate(p.order):
                if text in names:
                    keys.append((text, desc))
                else:
                    extra[f"__o{j}"] = self.term(e).column
                    keys.append((f"__o{j}", desc))
            out = base.select(*cols, *[c.alias(n) for n, c in extra.items()])
        if p.distinct:
            hard = [n for n in names if isinstance(out.schema[n].dataType, (T.StructType, T.VariantType, T.MapType, T.ArrayType))]
            tagged = out.withColumns({f"__d{k}": F.to_json(F.struct(F.col(f"`{n}`"))) for k, n in enumerate(hard)})
            out = tagged.dropDuplicates([*(f"__d{k}" for k in range(len(hard))), *(n for n in names if n not in hard)]).drop(*[f"__d{k}" for k in range(len(hard))])
        if keys:
            resolve = P.resolver(out)
            out = out.orderBy(*[k for name, desc in keys for k in sort_keys(resolve(name), desc)])
        if p.skip:
            out = out.offset(p.skip)
        if p.limit is not None:
            out = out.limit(p.limit)
        return out.select(*[F.col(f"`{n}`") for n in names])


def run(nodes: DataFrame, edges: DataFrame, text: str, params=None) -> DataFrame:
    return Compiler(Parser(text, params), nodes, edges).run()
