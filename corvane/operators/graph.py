"""Graph operators over nodes (id, label, properties) and edges (id, src, type, dst, properties)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery, NotFound
from ..plans import predicates as P
from ..storage import settle, shares, spread

#: Frontiers that are kept apart before they are merged.
FRAMES = 16


@dataclass(frozen=True)
class Step:
    """A node of a path, with the edge that led to it."""

    node: int
    edge: int | None = None
    type: str | None = None
    cost: float = 0.0


class Graph:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    # ------------------------------------------------------------ lookups

    def count_nodes(self, label: str | None = None) -> int:
        return (self.nodes if label is None else self.nodes.where(F.col("label") == label)).count()

    def by_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label).orderBy("id")

    def by_property(self, label: str, name: str, value) -> DataFrame:
        t = P.step(P.resolver(self.nodes)("properties"), name)
        return self.nodes.where((F.col("label") == label) & P.compile_cmp(t, "=", value)).orderBy("id")

    def directed(self, direction: str = "out", types: list[str] | None = None, **also: Column) -> DataFrame:
        """from, to, dir, edge, type and what else is asked of edges, seen from one end; both lists a self-loop twice."""
        e = self.edges if not types else self.edges.where(F.col("type").isin(types))
        out = e.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(0).alias("dir"), F.col("id").alias("edge"), "type", *[c.alias(k) for k, c in also.items()])
        into = e.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(1).alias("dir"), F.col("id").alias("edge"), "type", *[c.alias(k) for k, c in also.items()])
        if direction not in ("out", "in", "both"):
            raise InvalidQuery(f"no direction {direction!r}")
        return out if direction == "out" else into if direction == "in" else out.unionByName(into)

    def neighbors(self, node: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
        """to, edge, type in order of the type's length, the type, the neighbour and the edge."""
        return self.directed(direction, types).where(F.col("from") == node).orderBy("dir", F.octet_length("type"), "type", "to", "edge").select("to", "edge", "type")

    def degrees(self, direction: str = "out", label: str | None = None) -> DataFrame:
        """id, degree of all nodes, or of those with a label; a self-loop counts twice in both directions together."""
        nodes, ends = self.nodes.select("id", "label"), self.directed(direction).select("from")
        n = shares(ends)
        if label is not None:  # others' edges aren't grouped
            nodes = nodes.where(F.col("label") == label)
            ends = ends.join(nodes.select(F.col("id").alias("from")), "from", "left_semi")
        else:
            nodes, ends = spread(nodes, n, "id"), spread(ends, n, "from")
        d = ends.groupBy("from").agg(F.count(F.lit(1)).alias("degree"))
        return nodes.join(d, F.col("id") == F.col("from"), "left").select("id", "label", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def degree(self, node: int, direction: str = "out") -> int:
        return self.directed(direction).where(F.col("from") == node).count()

    def top_hubs(self, k: int, direction: str = "both", label: str | None = None) -> DataFrame:
        """The k nodes of most edges, with the most first and ties by id; nodes without edges come last."""
        return self.degrees(direction, label).orderBy(F.desc("degree"), "id").limit(k).select("id", "degree")

    # ------------------------------------------------------------ breadth first

    def bfs(self, start: int, direction: str = "out", types: list[str] | None = None, max_depth: int | None = 10, labels: list[str] | None = None, until: int | None = None, by_key: bool = False) -> DataFrame:
        """id, label, depth, parent, edge, type, rank of all nodes reached, each by its first discovery.

        Discovery goes by the parent's rank, direction, type (in the list's order, or by its key) and neighbour; ranks
        rise in that order, with gaps. A label filter hides nodes but is walked through. Each level is one join with the
        edges, range-sorted for its ranks, and is settled; no level meets in one task.
        """
        e = self.directed(direction, types)
        kind = F.lit(0) if not types or by_key else F.array_position(F.array(*map(F.lit, types)), F.col("type")).cast("int")
        spark = self.nodes.sparkSession
        begin = spark.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("edge"), F.lit(None).cast("string").alias("type"), F.lit(0).cast("long").alias("rank"))
        seen = level = begin
        depth = 0
        while max_depth is None or depth < max_depth:
            depth += 1
            # The start is a literal, so that its edges are found by a filter of the scan.
            met = e.where(F.col("from") == start).withColumn("prank", F.lit(0).cast("long")) if depth == 1 else e.join(level.select(F.col("id").alias("from"), F.col("rank").alias("prank")), "from")
            found = met.join(seen.select(F.col("id").alias("to")), "to", "left_anti")
            way = F.struct("prank", "dir", kind.alias("kind"), F.octet_length("type").alias("width"), "type", F.col("to").alias("id"), "edge", F.col("from").alias("parent"))
            first = found.groupBy("to").agg(F.min(way).alias("x")).select("x.*").orderBy("prank", "dir", "kind", "width", "type", "id", "edge")
            level = settle(first.select("id", F.lit(depth).alias("depth"), "parent", "edge", "type", F.monotonically_increasing_id().alias("rank")))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
            if until is not None and not level.where(F.col("id") == until).isEmpty():
                break
        out = seen.join(self.nodes.select("id", "label"), "id", "left").select("id", "label", "depth", "parent", "edge", "type", "rank")
        return out if labels is None else out.where(F.col("label").isin(labels))

    @staticmethod
    def to_tree(rows) -> dict | None:
        """Rows of bfs() nested under their parents: {id, depth, children}."""
        made = {}
        root = None
        for r in sorted(rows, key=lambda r: (r["depth"], r["rank"])):
            made[r["id"]] = node = {"id": r["id"], "label": r["label"], "depth": r["depth"], "children": []}
            if r["parent"] in made:
                made[r["parent"]]["children"].append(node)
            elif root is None:
                root = node
        return root

    def subgraph(self, start: int, direction: str = "both", max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
        """Nodes within reach and all edges among them."""
        ids = settle(self.bfs(start, direction, max_depth=max_depth).select("id"))
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return self.nodes.join(ids, "id", "left_semi"), edges

    def to_networkx(self, start: int, direction: str = "both", max_depth: int = 10):
        try:
            import networkx
        except ImportError:
            raise InvalidQuery("networkx isn't installed") from None
        nodes, edges = self.subgraph(start, direction, max_depth)
        g = networkx.MultiDiGraph()
        for r in nodes.select("id", "label", F.to_json("properties").alias("p")).toLocalIterator():
            g.add_node(r["id"], label=r["label"], properties=r["p"])
        for r in edges.toLocalIterator():
            g.add_edge(r["src"], r["dst"], key=r["id"], type=r["type"])
        return g

    # ------------------------------------------------------------ paths

    def shortest_path(self, start: int, end: int, direction: str = "out", types: list[str] | None = None) -> list[Step] | None:
        """Steps of a path of fewest edges, from start to end; None if there is none."""
        if start == end:
            return None if self.nodes.where(F.col("id") == start).isEmpty() else [Step(start)]
        seen = self.bfs(start, direction, types, None, until=end, by_key=True)
        return self._back(seen.select("id", "parent", "edge", "type", F.lit(0.0).alias("cost")), start, end)

    @staticmethod
    def _back(seen: DataFrame, start: int, end: int) -> list[Step] | None:
        steps, at = [], end
        while True:
            r = seen.where(F.col("id") == at).first()
            if r is None:
                return None
            steps.append(Step(at, r["edge"], r["type"], r["cost"]))
            if at == start:
                return steps[::-1]
            at = r["parent"]

    def distances(self, start: int, weight: str | None, default: float = 1.0, direction: str = "out", types: list[str] | None = None, until: int | None = None) -> DataFrame:
        """id, cost, parent, edge, type of all nodes reached at least cost; weights are numbers under `weight`, else default.

        Frontiers are relaxed until none improves, and each is kept as it was found: a round writes its improvements only.
        With `until`, ways that already cost as much as that node's are dropped, so that only its own row is sure to be
        least. A weight that is negative or not finite is an error.
        """
        w = F.lit(float(default)) if weight is None else F.coalesce(P.typed(P.step(P.resolver(self.edges)("properties"), weight), "float").cast("double"), F.lit(float(default)))
        e = settle(self.directed(direction, types, w=w).drop("dir"))
        bad = (F.col("w") < 0) | F.isnan("w") | (F.abs("w") == float("inf"))
        others = self.edges.where(~F.coalesce(F.col("type").isin(types), F.lit(False))).select(w.alias("w")) if types else None
        if not e.where(bad).isEmpty() or (others is not None and not others.where(bad).isEmpty()):
            raise InvalidQuery("a weight is negative or not finite")
        front = e.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("edge"), F.lit(None).cast("string").alias("type"))
        log, frames, bound = front, 1, None
        while True:
            step = e.join(front.select(F.col("id").alias("from"), "cost"), "from").select(F.col("to").alias("id"), F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("from").alias("parent"), "edge", "type").alias("x")).groupBy("id").agg(F.min("x").alias("x"))
            if bound is not None:
                step = step.where(F.col("x.cost") < bound)
            known = log.groupBy("id").agg(F.min("cost").alias("old"))
            better = step.join(known, "id", "left").where(F.col("old").isNull() | (F.col("x.cost") < F.col("old")))
            front = settle(better.select("id", "x.cost", "x.parent", "x.edge", "x.type"))
            if front.isEmpty():
                return self._least(log)
            log, frames = log.unionByName(front), frames + 1
            if frames > FRAMES:  # many small frames become one
                log, frames = settle(self._least(log)), 1
            if until is not None:
                met = front.where(F.col("id") == until).agg(F.min("cost")).first()[0]
                bound = met if met is not None else bound

    @staticmethod
    def _least(log: DataFrame) -> DataFrame:
        return log.groupBy("id").agg(F.min(F.struct("cost", "parent", "edge", "type")).alias("x")).select("id", "x.*")

    def weighted_path(self, start: int, end: int, weight: str | None, default: float = 1.0, direction: str = "out", types: list[str] | None = None) -> tuple[float, list[Step]] | None:
        """(cost, steps) of a path of least cost; None if there is none."""
        best = settle(self.distances(start, weight, default, direction, types, until=end))
        steps = self._back(best, start, end)
        return steps and (steps[-1].cost, steps)


__all__ = ["Graph", "NotFound", "Step"]
