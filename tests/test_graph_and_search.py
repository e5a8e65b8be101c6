"""Patterns, traversals, paths, full-text and vector search."""

import pytest

from corvane.database import Database
from corvane.errors import InvalidQuery, NotFound, SchemaMismatch
from corvane.operators.graph import Graph
from corvane.operators.search import query_terms
from corvane.functions.results import column, dicts, scalar
from corvane.functions.values import pack_vector
from corvane.plans.predicates import col
from corvane.schema import SchemaBuilder


@pytest.fixture(scope="module")
def coast(spark):
    """Ports 1 to 4 with lanes among them (2 and 3 by one without a length, 3 to itself), ships 5 and 6, a yard 7."""
    db = Database(spark)
    ports = [("Orla", 12, "west"), ("Tarn", 4, None), ("Quay", 7, "east"), ("Ness", 4, "west")]
    db.create_nodes([("Port", {"name": n, "berths": b} | ({"coast": c} if c else {})) for n, b, c in ports])
    db.create_nodes([("Ship", {"name": "Heron", "tons": 300}), ("Ship", {"name": "Gull", "tons": 90}), ("Yard", {"name": "Keel"})])
    lanes = [(1, 2, 40), (2, 4, 15), (4, 1, 22), (2, 3, None), (3, 3, 1)]
    db.create_edges([(a, b, "LANE", {} if m is None else {"miles": m}) for a, b, m in lanes])
    db.create_edges([(5, 1, "CALLS", {"day": "mon"}), (5, 3, "CALLS", {"day": "tue"}), (6, 3, "CALLS", {"day": "tue"}), (7, 6, "BUILT", {})])
    return db


def texts(df):
    import pyspark.sql.functions as F
    from pyspark.sql.types import VariantType

    plain = df.select(*[F.try_variant_get(F.col(f"`{f.name}`"), "$", "string").alias(f.name) if isinstance(f.dataType, VariantType) else F.col(f"`{f.name}`") for f in df.schema])
    return [tuple(r) if len(r) > 1 else r[0] for r in plain.collect()]


#: (pattern, rows, whether their order is asked for).
MATCHES = [
    ("MATCH (s:Ship)-[:CALLS]->(p) WHERE p.berths < 10 RETURN s.name AS ship ORDER BY ship", ["Gull", "Heron"], True),
    ("MATCH (p:Port {name: 'Tarn'})-[:LANE]-(q) RETURN q.name AS q ORDER BY q DESC", ["Quay", "Orla", "Ness"], True),
    ("MATCH (p {name: 'Quay'})-[r:LANE]-(q) RETURN id(r) AS r ORDER BY r", [4, 5], True),
    ("MATCH (p:Port {coast: 'west'})<-[:LANE]-(q) RETURN p.name AS p, q.name AS q ORDER BY p", [("Ness", "Tarn"), ("Orla", "Ness")], True),
    ("MATCH (x)-[:LANE]->(y)-[:LANE]->(z)-[:LANE]->(x) RETURN id(x) AS x ORDER BY x", [1, 2, 4], True),
    ("MATCH (p {name: 'Orla'})-[:LANE*2..3]->(q) RETURN q.name AS q ORDER BY q", ["Ness", "Orla", "Quay", "Quay"], True),
    ("MATCH (p {name: 'Ness'})-[:LANE*0..1]->(q) RETURN q.name AS q ORDER BY q", ["Ness", "Orla"], True),
    ("MATCH (p {name: 'Orla'})-[r:LANE*]->(q) RETURN count(*) AS n", [5], True),
    ("MATCH (a)-[r:LANE]->(b) WHERE r.miles > 20 RETURN id(r) AS r ORDER BY r DESC", [3, 1], True),
    ("MATCH (a)-[r:LANE]->(b) WHERE NOT r.miles > 20 RETURN id(r) AS r ORDER BY r", [2, 4, 5], True),
    ("MATCH (a)-[r:LANE]->(b) WHERE r.miles <> 15 RETURN id(r) AS r ORDER BY r", [1, 3, 4, 5], True),
    ("MATCH (a:Port)-[:LANE]->(b) WHERE a.berths > b.berths RETURN a.name AS a, b.name AS b", [("Orla", "Tarn")], False),
    ("MATCH (s)-[:CALLS]->(p:Port) RETURN p.name AS p, count(*) AS n, avg(s.tons) AS t ORDER BY n DESC", [("Quay", 2, 195.0), ("Orla", 1, 300.0)], True),
    ("MATCH (n) WHERE n:Yard OR n.berths = 4 RETURN n.name AS n", ["Keel", "Ness", "Tarn"], False),
    ("MATCH (n:Port) RETURN n.name AS who ORDER BY n.berths DESC, who SKIP 1 LIMIT 2", ["Quay", "Ness"], True),
    ("MATCH (n) RETURN DISTINCT label(n) AS l ORDER BY l", ["Port", "Ship", "Yard"], True),
    ("MATCH (n) WHERE n.name IN ['Gull', 5, 'Keel'] RETURN id(n) AS i ORDER BY i", [6, 7], True),
    ("MATCH (n) WHERE n.name STARTS WITH 'T' OR n.name ENDS WITH 'ss' RETURN id(n) AS i ORDER BY i", [2, 4], True),
    ("MATCH (n) WHERE n.berths NOT LIKE '%' RETURN n.name AS n", [], True),
    ("MATCH (n) WHERE n.coast IS NULL AND n.name ILIKE '%E%' RETURN id(n) AS i ORDER BY i", [5, 7], True),
    ("MATCH (a)-[:CALLS]->(b) WHERE a.name LIKE b.name RETURN count(*) AS n", [0], True),
    ("MATCH (n) WHERE n.name LIKE n.name RETURN count(*) AS n", [7], True),
    ("MATCH (n) WHERE n.berths = '4' RETURN n.name AS n", [], True),
    ("MATCH (n) WHERE n.berths = 7.0 RETURN n.name AS n", ["Quay"], True),
    ("MATCH (n) WHERE n.tons <-1 RETURN count(*) AS n", [0], True),
    ("MATCH (n:Lighthouse) RETURN count(*) AS n", [0], True),
    ("MATCH (x)-[r]->(y:Ship) RETURN type(r) AS t, min(x.name) AS f, sum(y.tons) AS s", [("BUILT", "Keel", 90.0)], True),
]


@pytest.mark.parametrize("text,expected,ordered", MATCHES)
def test_match(coast, text, expected, ordered):
    got = [tuple(map(str, r)) if isinstance(r, tuple) else str(r) for r in texts(coast.match(text))]
    rows = [tuple(map(str, e)) if isinstance(e, tuple) else str(e) for e in expected]
    assert got == rows if ordered else sorted(got) == sorted(rows)


def test_match_params_star_and_collect(coast):
    assert texts(coast.match("MATCH (n) WHERE n.tons >= $t RETURN n.name AS n ORDER BY n", {"t": 90})) == ["Gull", "Heron"]
    row = coast.match("MATCH (q)<-[r:LANE]-(p {name: 'Ness'}) RETURN *").first()
    assert list(row.asDict()) == ["p", "q", "r"] and row["r"]["from"] == 4 and row["q"]["id"] == 1
    assert len(coast.match("MATCH (p {name: 'Tarn'})-[:LANE]->(q) RETURN collect(q.name) AS c").first()[0]) == 2


def test_sum_needs_numbers(coast):
    with pytest.raises(Exception, match="needs numbers"):
        coast.match("MATCH (n) RETURN sum(n.name) AS s").collect()


def test_hop_bound(coast):
    coast.match("MATCH (a)-[:BUILT*1..16]->(b) RETURN a")
    for hops in ("*1..17", "*17", "*..99"):
        with pytest.raises(InvalidQuery):
            coast.match(f"MATCH (a)-[:BUILT{hops}]->(b) RETURN a")


@pytest.mark.parametrize("text", ["MATCH (a) RETURN b", "MATCH (a), (b) RETURN a", "MATCH (a)-[a]->(b) RETURN a", "MATCH (a) RETURN sum(a.name, 1)", "MATCH (a) RETURN upper(a.name)", "MATCH (a)-[r*3..1]->(b) RETURN a", "MATCH (a) WHERE a.name IN 3 RETURN a", "MATCH (a) RETURN count(*) AS n ORDER BY a.age", "MATCH (a) RETURN a LIMIT -1"])
def test_match_errors(coast, text):
    with pytest.raises(InvalidQuery):
        coast.match(text).collect()


@pytest.fixture(scope="module")
def mill(spark):
    """Belts 1-2-4-6 with a detour 2-3-4 and a slow chute 1-4; 5 feeds itself; 7 stands alone."""
    db = Database(spark)
    db.create_nodes([("Bin", {}), ("Sieve", {}), ("Fan", {}), ("Bin", {}), ("Fan", {}), ("Sack", {}), ("Sack", {})])
    db.create_edges([(1, 2, "belt", {"secs": 2}), (2, 4, "belt", {"secs": 2.25}), (2, 3, "belt", {"secs": 0.5}), (3, 4, "belt", {"secs": 0.25}), (1, 4, "chute", {"secs": 9}), (4, 6, "belt", {}), (5, 5, "belt", {})])
    return db


def test_traversal(mill):
    g: Graph = mill.graph
    rows = {r["id"]: (r["depth"], r["parent"], r["edge"]) for r in g.bfs(1).collect()}
    assert rows == {1: (0, None, None), 2: (1, 1, 1), 4: (1, 1, 5), 3: (2, 2, 3), 6: (2, 4, 6)}
    rows = {r["id"]: (r["depth"], r["parent"]) for r in g.bfs(1, types=["belt"]).collect()}
    assert rows == {1: (0, None), 2: (1, 1), 3: (2, 2), 4: (2, 2), 6: (3, 4)}
    assert {r["id"] for r in g.bfs(4, "in", max_depth=1).collect()} == {1, 2, 3, 4}
    assert {r["id"]: r["depth"] for r in g.bfs(3, "both", max_depth=1).collect()} == {3: 0, 2: 1, 4: 1}
    assert {r["id"] for r in g.bfs(1, labels=["Sack"]).collect()} == {6}
    assert [r["id"] for r in g.bfs(50).collect()] == [50]
    tree = g.to_tree(g.bfs(1, types=["belt"]).collect())
    assert [c["id"] for c in tree["children"]] == [2] and [c["id"] for c in tree["children"][0]["children"]] == [3, 4]
    assert [(r["to"], r["type"]) for r in g.neighbors(1).collect()] == [(2, "belt"), (4, "chute")]
    assert g.degree(5, "both") == 2 and g.degree(5) == 1 and g.degree(7, "both") == 0
    assert [tuple(r) for r in g.top_hubs(2, "out").collect()] == [(1, 2), (2, 2)]
    assert [tuple(r) for r in g.top_hubs(9, "both", "Sack").collect()] == [(6, 1), (7, 0)]
    nodes, edges = g.subgraph(2, "out", 1)
    assert sorted(r["id"] for r in nodes.collect()) == [2, 3, 4] and sorted(r["id"] for r in edges.collect()) == [2, 3, 4]


def test_paths(mill):
    g = mill.graph
    assert [s.node for s in g.shortest_path(1, 6)] == [1, 4, 6]
    assert [s.node for s in g.shortest_path(1, 6, types=["belt"])] == [1, 2, 4, 6]
    assert g.shortest_path(1, 5) is None and [s.node for s in g.shortest_path(7, 7)] == [7] and g.shortest_path(50, 50) is None
    cost, steps = g.weighted_path(1, 6, "secs")
    assert cost == 3.75 and [s.node for s in steps] == [1, 2, 3, 4, 6] and [s.edge for s in steps[1:]] == [1, 3, 4, 6]
    assert g.weighted_path(1, 7, "secs") is None
    broken = mill.snapshot()
    broken.create_edge(6, 7, "belt", {"secs": -3})
    with pytest.raises(InvalidQuery):
        broken.graph.weighted_path(1, 7, "secs")


def test_graph_writes(mill):
    db = mill.snapshot()
    db.update_node(3, {"worn": True})
    assert db.match("MATCH (n {worn: true}) RETURN id(n) AS i").first()[0] == 3
    db.update_edge(2, {"secs": 0})
    assert db.graph.weighted_path(1, 6, "secs")[0] == 3.0
    db.delete_edge(5)
    assert [s.node for s in db.graph.shortest_path(1, 4)] == [1, 2, 4]
    assert db.cascade_delete(3, "belt") == [3, 4, 6] and sorted(r["id"] for r in db.state.edges.collect()) == [1, 7]
    db.delete_node(5)
    assert db.state.edges.count() == 1
    for wrong in (lambda: db.delete_node(5), lambda: db.create_edge(1, 5, "x"), lambda: db.update_edge(77, {}), lambda: db.cascade_delete(5, "x")):
        with pytest.raises(NotFound):
            wrong()


@pytest.fixture(scope="module")
def notes(spark):
    db = Database(spark)
    db.create_table(SchemaBuilder("notes").primary_key("id", "int").column("head", "str").column("body", "str").column("tongue", "str").column("emb", "list").column("packed", "bytes").build())
    rows = [
        (1, "Tides", "tide tide pool and moon", "en", [3.0, 0.0, 0.0]),
        (2, "Moon", "the moon pulls a tide", "en", [0.0, 2.0, 0.0]),
        (3, "Salz", "Salz und Meer, Moos", "de", [0.0, 1.5, 0.5]),
        (4, "Nichts", None, "de", [1.0, 1.0, 0.0]),
        (5, "Hindi", "यह हिन्दी है", "hi", [0.0, 0.0, -1.0]),
    ]
    db.table("notes").insert([{"id": i, "head": h, "body": b, "tongue": g, "emb": e, "packed": pack_vector(e)} for i, h, b, g, e in rows])
    db.search.create_text_index("notes", "body")
    return db


def test_text_search(notes):
    find = lambda q, **o: [r["id"] for r in notes.search.text("notes", "body", q, **o).collect()]
    assert find("tide") == [1, 2] and find("tide salz") == [3, 1, 2]
    assert find("MOON the", match_all=True) == [2] and find("mee*") == [3] and sorted(find("mo* ti*")) == [1, 2, 3]
    assert find("tide", where=col("id").gt(1)) == [2] and find("tide", limit=1) == [1] and find("  ") == [] and find("nothing") == []
    assert find("हिन्दी") == [5]  # a query splits as a text does, vowel signs included
    assert query_terms("ebb-Flow* ebb x*") == [("ebb", False), ("flow", True), ("x", True)]
    with pytest.raises(InvalidQuery):
        notes.search.text("notes", "head", "x")
    with pytest.raises(SchemaMismatch):
        notes.search.create_text_index("notes", "emb")


def test_vector_search(notes):
    for column in ("emb", "packed"):
        find = lambda q, c=column, **o: [r["id"] for r in notes.search.vector("notes", c, q, **o).collect()]
        assert find([1, 0, 0], k=2) == [1, 4] and find([0, 1.4, 0.5], k=2, metric="euclidean") == [3, 2]
        assert find([0, 1, 0], metric="dot", where=col("tongue").eq("de")) == [3, 4]
        assert find([0, 0, 0]) == []
    with pytest.raises(Exception):
        notes.search.vector("notes", "emb", [1.0]).collect()
    with pytest.raises(InvalidQuery):
        notes.search.vector("notes", "emb", [])
    notes.search.create_vector_index("notes", "emb", "cosine", m=8)
    assert notes.search.vector_indexes() == [("notes", "emb", "cosine", 8, 200)]
    with pytest.raises(InvalidQuery):
        notes.search.create_vector_index("notes", "emb", m=1)


def test_result_helpers(notes):
    df = notes.sql("SELECT id, tongue FROM notes WHERE id < 3 ORDER BY id")
    assert dicts(df) == [{"id": 1, "tongue": "en"}, {"id": 2, "tongue": "en"}] and column(df, "id") == [1, 2] and scalar(df) == 1
    assert scalar(df.limit(0)) is None and column(df, 1) == ["en", "en"]
    with pytest.raises(InvalidQuery):
        column(df, "nope")
