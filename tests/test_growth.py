"""Patterns and graphs whose hubs or sizes must not make work grow faster than the input."""

import random

import pytest

from corvane import storage
from corvane.errors import InvalidQuery
from corvane.operators import graph
from corvane.operators.graph import Graph
from corvane.plans.match import Compiler, run

LABELS = {0: "Town", 1: "Town", **{i: "Mill" for i in range(2, 8)}, **{i: "Shop" for i in range(8, 16)}, **{i: "Sack" for i in range(16, 30)}}


@pytest.fixture(scope="module")
def trade(spark):
    """Mills and shops in two towns; shops buy sacks, which mills fill; some edges are double, and one leads nowhere."""
    draw = random.Random(5)
    mills, shops, sacks = ([i for i, x in LABELS.items() if x == label] for label in ("Mill", "Shop", "Sack"))
    edges = [(x, "IN", draw.randrange(2)) for x in mills + shops] + [(draw.choice(shops), "BUYS", draw.choice(sacks)) for _ in range(60)] + [(draw.choice(sacks), "FROM", draw.choice(mills)) for _ in range(50)] + [(8, "BUYS", 99), (99, "FROM", 2)]
    nodes = spark.createDataFrame([(i, label, (f"{label}{i % 5}", float(i))) for i, label in LABELS.items()], "id long, label string, properties struct<name string, size double>")
    return nodes, spark.createDataFrame([(i, a, t, b, (None,)) for i, (a, t, b) in enumerate(edges)], "id long, src long, type string, dst long, properties struct<w double>"), edges


def _cycles(edges):
    of = lambda kind: [(a, b) for a, t, b in edges if t == kind and a in LABELS and b in LABELS]
    return [(m, t, s, k) for m, t in of("IN") if LABELS[m] == "Mill" for s, u in of("IN") if LABELS[s] == "Shop" and u == t for x, k in of("BUYS") if x == s for y, z in of("FROM") if y == k and z == m]


CYCLE = "MATCH (m:Mill)-[:IN]->(t)<-[:IN]-(s:Shop)-[:BUYS]->(k)-[:FROM]->(m) "


@pytest.mark.parametrize("text,expected", [
    (CYCLE + "RETURN count(*) AS n", lambda c: [(len(c),)]),
    (CYCLE + "WHERE s.size > 11 RETURN m.name AS m, count(*) AS n, max(s.size) AS x", lambda c: [(f"Mill{m}", sum(a % 5 == m for a, _, s, _ in c if s > 11), max(float(s) for a, _, s, _ in c if s > 11 and a % 5 == m)) for m in {a % 5 for a, _, s, _ in c if s > 11}]),
    (CYCLE + "WHERE s.size > m.size RETURN count(*) AS n", lambda c: [(sum(s > m for m, _, s, _ in c),)]),
    (CYCLE + "WHERE t.size > 5 RETURN count(*) AS n, count(m.size) AS k", lambda c: [(0, 0)]),
    (CYCLE + "RETURN DISTINCT t.name AS t", lambda c: [(t,) for t in {f"Town{t % 5}" for _, t, _, _ in c}]),
])
def test_unread_nodes_are_summed_out(trade, monkeypatch, text, expected):
    nodes, edges, given = trade

    def never(self):
        raise AssertionError("all bindings are made")

    monkeypatch.setattr(Compiler, "bindings", never)
    assert sorted(map(tuple, run(nodes, edges, text).collect())) == sorted(expected(_cycles(given)))


def test_distinct_ends(trade, monkeypatch):
    nodes, edges, given = trade
    monkeypatch.setattr(Compiler, "bindings", None)
    found = {(f"Mill{m % 5}",) for s, t, k in given if t == "BUYS" and s % 5 == 3 and k in LABELS for x, u, m in given if u == "FROM" and x == k}
    assert sorted(map(tuple, run(nodes, edges, "MATCH (s:Shop {name: 'Shop3'})-[:BUYS]->(k)-[:FROM]->(m) RETURN DISTINCT m.name AS m").collect())) == sorted(found)


@pytest.mark.parametrize("text", ["MATCH (a)-[:IN]->(t)<-[:IN]-(b) RETURN count(*) AS n", "MATCH (a)-[r:IN]->(t) RETURN r.w AS w, count(*) AS n"])
def test_bindings_are_made_where_edges_matter(trade, text):
    """An edge isn't used twice, which sums can't tell."""
    nodes, edges, given = trade
    towns = [b for _, t, b in given if t == "IN"]
    assert run(nodes, edges, text).select("n").first()[0] == (len(towns) if "r.w" in text else sum(towns.count(t) * (towns.count(t) - 1) for t in set(towns)))


def join_rows(df) -> int:
    """Rows of the largest join of df as it ran."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            most = max(most, node.metrics().get("numOutputRows").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
    return most


def test_pairs_of_a_hub_are_only_those_asked_for(spark):
    """300 shops and 300 mills in one town: 90,000 pairs, of which one mill is wanted."""
    nodes = spark.createDataFrame([(i, "Town" if i < 2 else "Shop" if i <= 300 else "Mill", (float(i),)) for i in range(601)], "id long, label string, properties struct<size double>")
    edges = spark.createDataFrame([(i, i, "IN", 0 if i > 2 else 1, (None,)) for i in range(2, 601)], "id long, src long, type string, dst long, properties struct<w double>")
    df = run(nodes, edges, "MATCH (s:Shop)-[:IN]->(t)<-[:IN]-(m:Mill) WHERE s.size < m.size AND m.size > 599 RETURN id(s) AS s, id(m) AS m")
    assert join_rows(df) <= 600
    assert sorted(map(tuple, df.collect())) == [(s, 600) for s in range(3, 301)]


def test_large_tables_are_dealt_by_their_size(trade, monkeypatch):
    """Degrees are grouped in as many tasks as the edges' size asks for, whatever the number of shuffle partitions."""
    nodes, edges, given = trade
    assert storage.shares(edges) is None  # of rows that Spark can't size
    nodes, edges = storage.settle(nodes), storage.settle(edges)
    monkeypatch.setattr(storage, "SMALL", 0)
    monkeypatch.setattr(storage, "SHARE", 512)
    df = Graph(nodes, edges).degrees("both")
    n = storage.shares(Graph(nodes, edges).directed("both").select("from"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and plan.count(f", {n}), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "")
    assert {r["id"]: r["degree"] for r in df.collect()} == {i: sum((a == i) + (b == i) for a, _, b in given) for i in LABELS}


def test_edges_are_weighed_in_place(trade, monkeypatch):
    """Weights come with the edges, not by a join of all edges with themselves; bad ones of other types still are errors."""
    nodes, edges, given = trade
    plans = []
    monkeypatch.setattr(graph, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or storage.settle(df))
    got = {r["id"]: r["cost"] for r in Graph(nodes, edges).distances(8, "w", 2.0, types=["BUYS", "FROM"]).collect()}
    sacks = {b for a, t, b in given if (a, t) == (8, "BUYS")}
    assert got == {8: 0.0, **dict.fromkeys(sacks, 2.0), **{b: 4.0 for a, t, b in given if t == "FROM" and a in sacks}}
    assert "Join" not in plans[0]
    bad = edges.unionByName(edges.limit(1).selectExpr("1000L AS id", "0L AS src", "'ODD' AS type", "1L AS dst", "named_struct('w', -1.0D) AS properties"))
    with pytest.raises(InvalidQuery):
        Graph(nodes, bad).distances(8, "w", types=["BUYS"])


def test_hubs_of_a_label_group_its_edges_only(trade, monkeypatch):
    nodes, edges, given = trade
    top = Graph(nodes, edges).top_hubs(3, "both", "Mill")
    assert "LeftSemi" in top._jdf.queryExecution().optimizedPlan().toString()
    degree = {m: sum((a == m) + (b == m) for a, _, b in given) for m, label in LABELS.items() if label == "Mill"}
    assert [tuple(r) for r in top.collect()] == sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:3]
