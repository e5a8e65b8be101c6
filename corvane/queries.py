"""The registered queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .database import Database
from .operators import hybrid, search
from .operators.graph import Graph
from .plans import predicates as P
from .plans.match import run as match
from .plans.predicates import col
from .plans.query import Agg, Query
from .storage import shares, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q(spark, d: str, name: str, pk: str | None = None) -> Query:
    return Query(t(spark, d, name), pk)


def db(spark, d: str) -> Database:
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "nation": "n_nationkey", "documents": "doc_id"}
    out = Database(spark)
    for name, pk in keys.items():
        df = t(spark, d, name)
        if name == "events":
            df = df.withColumn("props", F.parse_json("props"))
        out.register(name, df, pk)
    return out


def add(name: str, sql: str | None, fn) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
C = "coalesce({}, false)".format


def over(name: str, table: str, pk: str, pred, where: str, columns: str) -> None:
    add(name, f"SELECT {columns} FROM {table} WHERE {where}", lambda s, d: q(s, d, table, pk).filter(pred()).columns(columns.split(", ")).run())


# ---------------------------------------------------------------- scans and predicates
add("scan_full", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part", lambda s, d: q(s, d, "part", "p_partkey").run())
over("scan_pk_get", "orders", "o_orderkey", lambda: col("o_orderkey").eq(42), "o_orderkey = 42", ORDERS)
over("scan_pk_in", "orders", "o_orderkey", lambda: col("o_orderkey").is_in([7, 3, 7, 11, -1]), "o_orderkey IN (7, 3, 11, -1)", ORDERS)
over("scan_pk_range", "orders", "o_orderkey", lambda: (col("o_orderkey") >= 100) & (col("o_orderkey") < 200), "o_orderkey >= 100 AND o_orderkey < 200", ORDERS)
over("scan_prefix", "part", "p_partkey", lambda: col("p_type").starts_with("S"), "starts_with(p_type, 'S')", "p_partkey, p_type")
over("scan_index_eq", "customer", "c_custkey", lambda: P.where({"c_nationkey": 3}), "c_nationkey = 3", "c_custkey, c_name, c_nationkey")
over("scan_index_range", "customer", "c_custkey", lambda: col("c_acctbal").between(0.0, 500.5), "c_acctbal BETWEEN 0 AND 500.5", "c_custkey, c_acctbal")
over("pred_cmp", "lineitem", "l_orderkey", lambda: (col("l_quantity") > 45) & (col("l_discount") <= 0.02), "l_quantity > 45 AND l_discount <= 0.02", "l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount")
over("pred_kinds", "orders", "o_orderkey", lambda: col("o_orderstatus").ne(3) | col("o_totalprice").lt(50000), "o_totalprice < 50000", "o_orderkey, o_totalprice")
over("pred_not_like", "part", "p_partkey", lambda: ~col("p_type").like("%E_%"), "NOT coalesce(regexp_full_match(p_type, '.*E..*', 's'), false)", "p_partkey, p_type")
over("pred_like", "customer", "c_custkey", lambda: col("c_mktsegment").like("%U_L%"), "regexp_full_match(c_mktsegment, '.*U.L.*', 's')", "c_custkey, c_mktsegment")
over("pred_ilike", "customer", "c_custkey", lambda: col("c_mktsegment").ilike("%buil%"), "contains(lower(c_mktsegment), 'buil')", "c_custkey, c_mktsegment")
over("pred_contains_str", "documents", "doc_id", lambda: col("text").contains("License"), "contains(text, 'License')", "doc_id, lang")
over("pred_contains_list", "embeddings", "vec_id", lambda: ~col("embedding").contains(2.5), "NOT list_contains(embedding, 2.5)", "vec_id, label")
over("pred_in_strings", "orders", "o_orderkey", lambda: ~col("o_orderpriority").is_in(["1-URGENT", None, "5-LOW"]), "NOT coalesce(o_orderpriority IN ('1-URGENT', '5-LOW'), false)", "o_orderkey, o_orderpriority")
over("pred_and_or_not", "orders", "o_orderkey", lambda: ~((col("o_orderstatus") == "F") | ((col("o_totalprice") > 100000) & (col("o_custkey") < 500))), "NOT (o_orderstatus = 'F' OR (o_totalprice > 100000 AND o_custkey < 500))", "o_orderkey, o_orderstatus, o_totalprice, o_custkey")

LABELLED = "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def labelled(s, d) -> Query:
    """Documents with labels that most lack: natural nulls."""
    return Query(t(s, d, "documents").select("doc_id").join(t(s, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic"), "doc_id")


for _name, _pred, _where in (
    ("pred_null_eq", lambda: col("quality").eq(None), "quality IS NULL"),
    ("pred_null_ne", lambda: col("quality").ne(None), "quality IS NOT NULL"),
    ("pred_ne_null_operand", lambda: col("quality").ne(1), C("quality <> 1")),
    ("pred_not_of_null", lambda: ~col("quality").eq(1), f"NOT {C('quality = 1')}"),
    ("pred_not_in_null", lambda: ~col("quality").is_in([0, None]), f"NOT {C('quality IN (0)')}"),
    ("pred_not_between_null", lambda: ~col("quality").between(1, 5), f"NOT {C('quality BETWEEN 1 AND 5')}"),
    ("pred_is_null", lambda: col("toxic").is_not_null() & ~col("quality").is_null(), "toxic IS NOT NULL AND quality IS NOT NULL"),
):
    add(_name, f"SELECT * FROM ({LABELLED}) WHERE {_where}", lambda s, d, p=_pred: labelled(s, d).filter(p()).run())


def events(s, d) -> Query:
    return Query(t(s, d, "events").withColumn("props", F.parse_json("props")), "event_id")


add("pred_path", "SELECT event_id, event_type FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50", lambda s, d: events(s, d).filter(col("props.k").ge(50)).columns(["event_type"]).run())
add("pred_contains_key", "SELECT event_id FROM events WHERE json_exists(props, '$.k')", lambda s, d: events(s, d).filter(col("props").contains("k") & ~col("props").contains("zz")).columns(["event_id"]).run())
add("pred_path_missing", "SELECT event_id FROM events", lambda s, d: events(s, d).filter(~col("props.none.deeper").eq(1)).columns(["event_id"]).run())
add("proj_alias_path", "SELECT event_id AS id, event_type AS what, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events", lambda s, d: events(s, d).project([("event_id", "id"), ("event_type", "what"), ("props.k", "k")]).withColumn("k", F.try_variant_get("k", "$", "string")))

# ---------------------------------------------------------------- order and paging
add("order_multi", f"SELECT {ORDERS} FROM orders ORDER BY o_orderpriority ASC NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100", lambda s, d: q(s, d, "orders", "o_orderkey").order_by("o_orderpriority").order_by_desc("o_totalprice").limit(100).run())
add("order_nulls", f"SELECT * FROM ({LABELLED}) ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 700", lambda s, d: labelled(s, d).order_by("quality").limit(700).run())
add("order_nulls_desc", f"SELECT * FROM ({LABELLED}) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 500", lambda s, d: labelled(s, d).order_by_desc("quality").limit(500).run())
add("limit_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50", lambda s, d: q(s, d, "part", "p_partkey").columns(["p_name"]).offset(50).limit(25).run())
add("keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 99 ORDER BY c_custkey LIMIT 50", lambda s, d: q(s, d, "customer", "c_custkey").filter(col("c_custkey").gt(99)).order_by("c_custkey").limit(50).columns(["c_name"]).run())

# ---------------------------------------------------------------- aggregation
add("agg_global", "SELECT count(*) AS n, count(quality) AS labelled, CAST(sum(quality) AS BIGINT) AS good, round(avg(quality), 9) AS share, min(toxic) AS lo, max(toxic) AS hi FROM (" + LABELLED + ")", lambda s, d: labelled(s, d).aggregate([Agg.count().as_("n"), Agg.count("quality").as_("labelled"), Agg.sum("quality").as_("good"), Agg.avg("quality").as_("share"), Agg.min("toxic").as_("lo"), Agg.max("toxic").as_("hi")]).withColumn("share", F.round("share", 9)))
add("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 9) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", lambda s, d: q(s, d, "lineitem").filter(col("l_shipdate").le(_at("1998-09-02"))).aggregate([Agg.count().as_("n"), Agg.sum("l_quantity").as_("qty"), Agg.sum("l_extendedprice").as_("price"), Agg.avg("l_discount").as_("disc")], ("l_returnflag", "l_linestatus")).withColumns({"qty": F.round("qty", 4), "price": F.round("price", 2), "disc": F.round("disc", 9)}))
add("agg_group_null_key", f"SELECT quality, count(*) AS n FROM ({LABELLED}) GROUP BY 1", lambda s, d: labelled(s, d).aggregate([Agg.count().as_("n")], ("quality",)))
add("agg_group_path", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1", lambda s, d: events(s, d).aggregate([Agg.count().as_("n"), Agg.sum("value").as_("v")], ("props.k",), {"props.k": "k"}).withColumn("v", F.round("v", 4)))
add("agg_empty", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0", lambda s, d: q(s, d, "orders", "o_orderkey").filter(col("o_orderkey").lt(0)).aggregate([Agg.count().as_("n"), Agg.sum("o_custkey").as_("s"), Agg.avg("o_totalprice").as_("a")]))


def _at(text: str):
    from .functions.values import parse_timestamp

    return parse_timestamp(text)


# ---------------------------------------------------------------- SQL dialect
def sql(name: str, text: str, oracle: str | None = None, params=None, fix=lambda df: df) -> None:
    add(name, oracle or text, lambda s, d: fix(db(s, d).sql(text, params)))


sql("sql_select_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus IN ('O', 'P')")
sql("sql_select_flip", "SELECT p_partkey, p_size FROM part WHERE 10 >= p_size AND NOT p_brand LIKE '%1%'")
sql("sql_select_params", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN ? AND ? AND c_mktsegment <> $3", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 100.0 AND 900.0 AND c_mktsegment <> 'BUILDING'", [100.0, 900.0, "BUILDING"])
sql("sql_select_named_params", "SELECT s_suppkey FROM supplier WHERE s_nationkey = :n OR s_acctbal < :b", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 OR s_acctbal < 100", {"n": 3, "b": 100})
sql("sql_select_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01T00:00:00Z'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
sql("sql_select_star_order", "SELECT * FROM supplier ORDER BY s_acctbal DESC LIMIT 10 OFFSET 5", "SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10 OFFSET 5")
sql("sql_group_order", "SELECT o_orderpriority AS p, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY n DESC LIMIT 3", "SELECT o_orderpriority AS p, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC LIMIT 3")
sql("sql_default_names", "SELECT c_mktsegment, count(*), min(c_acctbal) FROM customer GROUP BY c_mktsegment", 'SELECT c_mktsegment, count(*) AS "count(*)", min(c_acctbal) AS "min(c_acctbal)" FROM customer GROUP BY 1')
sql("sql_path", "SELECT event_id, value FROM events WHERE props.k < 10 AND event_type CONTAINS 'c'", "SELECT event_id, value FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 10 AND contains(event_type, 'c')")


# ---------------------------------------------------------------- writes: images after them
def customers(s, d) -> Database:
    from .schema import SchemaBuilder

    out = Database(s)
    schema = SchemaBuilder("cust").primary_key("c_custkey", "int", True).column("c_name", "str", nullable=False).column("c_acctbal", "float", default=1.5).column("c_mktsegment", "str", indexed=True).build()
    out.create_table(schema)
    out.table("cust").upsert_frame(t(s, d, "customer"))
    out._set(counters={**out.state.counters, "cust": 1_000_000_000})
    return out


CUST = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def after(name: str, oracle: str, *statements: str) -> None:
    def fn(s, d):
        base = customers(s, d)
        for text in statements:
            base.sql(text)
        return base.table("cust").df

    add(name, oracle, fn)


after("dml_insert", f"{CUST} UNION ALL VALUES (1000000000, 'new', 1.5, NULL), (1000000001, 'two', NULL, 'X')", "INSERT INTO cust (c_name) VALUES ('new')", "INSERT INTO cust (c_name, c_acctbal, c_mktsegment) VALUES ('two', NULL, 'X')")
after("dml_upsert", f"{CUST} WHERE c_custkey <> 5 UNION ALL VALUES (5, 'five', 1.5, NULL)", "UPSERT INTO cust (c_custkey, c_name) VALUES (5, 'first'), (5, 'five')")
after("dml_update", "SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.25 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer", "UPDATE cust SET c_acctbal = 0.25, c_mktsegment = 'B' WHERE c_mktsegment = 'BUILDING'")
after("dml_delete", f"{CUST} WHERE NOT (c_custkey < 100 OR coalesce(c_acctbal > 5000, false))", "DELETE FROM cust WHERE c_custkey < 100 OR c_acctbal > 5000")
after("dml_add_column", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, CAST(7 AS BIGINT) AS tier FROM customer", "ALTER TABLE cust ADD COLUMN tier INT DEFAULT 7")
after("dml_drop_column", "SELECT c_custkey, c_name, c_acctbal FROM customer", "ALTER TABLE cust DROP COLUMN c_mktsegment")

# ---------------------------------------------------------------- graph
BASES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6}
G = 10_000_000_000


def graph(s, d) -> tuple[DataFrame, DataFrame]:
    """The tables as a graph: ids offset by label; properties are a struct, null where a label has none."""
    specs = [("Region", "region", "r_regionkey", "r_name", None), ("Nation", "nation", "n_nationkey", "n_name", None), ("Customer", "customer", "c_custkey", "c_name", "c_acctbal"), ("Supplier", "supplier", "s_suppkey", "s_name", "s_acctbal"), ("Part", "part", "p_partkey", "p_name", "p_retailprice"), ("Order", "orders", "o_orderkey", "o_orderpriority", "o_totalprice")]
    nodes = None
    for label, table, key, name, amount in specs:
        df = t(s, d, table).select((F.col(key).cast("long") + BASES[label] * G).alias("id"), F.lit(label).alias("label"), F.struct(F.col(name).alias("name"), (F.col(amount) if amount else F.lit(None)).cast("double").alias("amount")).alias("properties"))
        nodes = df if nodes is None else nodes.unionByName(df)
    items = t(s, d, "lineitem")
    parts = [
        ("IN_REGION", t(s, d, "nation"), "Nation", "n_nationkey", "Region", "n_regionkey"),
        ("IN_NATION", t(s, d, "customer"), "Customer", "c_custkey", "Nation", "c_nationkey"),
        ("IN_NATION", t(s, d, "supplier"), "Supplier", "s_suppkey", "Nation", "s_nationkey"),
        ("PLACED", t(s, d, "orders"), "Customer", "o_custkey", "Order", "o_orderkey"),
        ("CONTAINS", items, "Order", "l_orderkey", "Part", "l_partkey"),
        ("SUPPLIED_BY", items, "Part", "l_partkey", "Supplier", "l_suppkey"),
    ]
    edges = None
    for kind, df, a, ka, b, kb in parts:
        pair = df.select((F.col(ka).cast("long") + BASES[a] * G).alias("src"), (F.col(kb).cast("long") + BASES[b] * G).alias("dst"), (F.col("l_quantity") if "l_quantity" in df.columns else F.lit(None)).cast("double").alias("w"))
        e = spread(pair, shares(df), "src").groupBy("src", "dst").agg(F.sum("w").alias("w")).select("src", F.lit(kind).alias("type"), "dst", F.struct(F.col("w").alias("weight")).alias("properties"))
        edges = e if edges is None else edges.unionByName(e)
    # ids are a hash of type and ends, made without an order over all edges
    text = F.concat_ws("/", "type", F.col("src").cast("string"), F.col("dst").cast("string"))
    return nodes, edges.withColumn("id", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")).select("id", "src", "type", "dst", "properties")


NODES = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) + {BASES[label] * G} AS id, '{label}' AS label, {n} AS name, CAST({a} AS DOUBLE) AS amount FROM {tb}" for label, tb, k, n, a in (("Region", "region", "r_regionkey", "r_name", "NULL"), ("Nation", "nation", "n_nationkey", "n_name", "NULL"), ("Customer", "customer", "c_custkey", "c_name", "c_acctbal"), ("Supplier", "supplier", "s_suppkey", "s_name", "s_acctbal"), ("Part", "part", "p_partkey", "p_name", "p_retailprice"), ("Order", "orders", "o_orderkey", "o_orderpriority", "o_totalprice")))
EDGES = " UNION ALL ".join(f"SELECT CAST({ka} AS BIGINT) + {BASES[a] * G} AS src, '{ty}' AS type, CAST({kb} AS BIGINT) + {BASES[b] * G} AS dst, {'sum(l_quantity)' if tb == 'lineitem' else 'CAST(NULL AS DOUBLE)'} AS w FROM {tb} GROUP BY {ka}, {kb}" for ty, tb, a, ka, b, kb in (("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"), ("IN_NATION", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"), ("IN_NATION", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"), ("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey"), ("CONTAINS", "lineitem", "Order", "l_orderkey", "Part", "l_partkey"), ("SUPPLIED_BY", "lineitem", "Part", "l_partkey", "Supplier", "l_suppkey")))
WITH = f"WITH RECURSIVE nodes AS ({NODES}), e0 AS ({EDGES}), edges AS (SELECT CAST('0x' || substr(md5(type || '/' || src || '/' || dst), 1, 15) AS BIGINT) AS id, * FROM e0) "


def pattern(name: str, text: str, oracle: str | None, params=None, fix=lambda df: df) -> None:
    add(name, oracle and WITH + oracle, lambda s, d: fix(match(*graph(s, d), text, params)))


pattern("match_hop_out", "MATCH (n:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) RETURN n.name AS nation, r.name AS region", "SELECT n.name AS nation, r.name AS region FROM edges e JOIN nodes n ON n.id = src JOIN nodes r ON r.id = dst WHERE type = 'IN_REGION' AND r.name = 'ASIA'")
pattern("match_hop_in", "MATCH (r:Region)<-[e:IN_REGION]-(n) RETURN id(r) AS r, count(*) AS n, type(e) AS kind", "SELECT dst AS r, count(*) AS n, type AS kind FROM edges WHERE type = 'IN_REGION' GROUP BY 1, 3")
pattern("match_hop_both", "MATCH (n:Nation)-[:IN_REGION|IN_NATION]-(x) WHERE n.name = $n RETURN label(x) AS label, count(x) AS n", "SELECT x.label, count(*) AS n FROM (SELECT src AS a, dst AS b, type FROM edges UNION ALL SELECT dst, src, type FROM edges WHERE src <> dst) e JOIN nodes n ON n.id = a JOIN nodes x ON x.id = b WHERE n.label = 'Nation' AND n.name = (SELECT min(n_name) FROM nation) AND type IN ('IN_REGION', 'IN_NATION') GROUP BY 1", {"n": None})
QUERIES["match_hop_both"] = lambda s, d: match(*graph(s, d), "MATCH (n:Nation)-[:IN_REGION|IN_NATION]-(x) WHERE n.name = $n RETURN label(x) AS label, count(x) AS n", {"n": t(s, d, "nation").agg(F.min("n_name")).first()[0]})
pattern("match_two_hop", "MATCH (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) WHERE c.amount > 9000 RETURN c.name AS c, n.name AS n, r.name AS r", "SELECT c.name AS c, n.name AS n, r.name AS r FROM edges a JOIN edges b ON a.dst = b.src JOIN nodes c ON c.id = a.src JOIN nodes n ON n.id = a.dst JOIN nodes r ON r.id = b.dst WHERE a.type = 'IN_NATION' AND b.type = 'IN_REGION' AND c.label = 'Customer' AND c.amount > 9000")
pattern("match_cycle", "MATCH (a:Supplier)-[:IN_NATION]->(n)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p)-[:SUPPLIED_BY]->(a) RETURN count(*) AS n", "SELECT count(*) AS n FROM edges e1 JOIN edges e2 ON e1.dst = e2.dst JOIN edges e3 ON e3.src = e2.src JOIN edges e4 ON e4.src = e3.dst JOIN edges e5 ON e5.src = e4.dst AND e5.dst = e1.src WHERE e1.type = 'IN_NATION' AND e1.src BETWEEN 40000000000 AND 49999999999 AND e2.type = 'IN_NATION' AND e2.src BETWEEN 30000000000 AND 39999999999 AND e3.type = 'PLACED' AND e4.type = 'CONTAINS' AND e5.type = 'SUPPLIED_BY'")
pattern("match_varlen", "MATCH (c:Customer)-[p:IN_NATION|IN_REGION*1..3]->(x) WHERE c.amount < 100 RETURN id(c) AS c, id(x) AS x", ", p(c, x, n) AS (SELECT src, dst, 1 FROM edges WHERE type IN ('IN_NATION', 'IN_REGION') UNION ALL SELECT c, dst, n + 1 FROM p JOIN edges ON src = x WHERE type IN ('IN_NATION', 'IN_REGION') AND n < 3) SELECT c, x FROM p JOIN nodes ON id = c WHERE label = 'Customer' AND amount < 100")
pattern("match_varlen_zero", "MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN id(n) AS n, label(x) AS x", "SELECT id AS n, 'Nation' AS x FROM nodes WHERE label = 'Nation' UNION ALL SELECT src, 'Region' FROM edges WHERE type = 'IN_REGION'")
pattern("match_where_cross", "MATCH (c:Customer)-[:IN_NATION]->(n)<-[:IN_NATION]-(s:Supplier) WHERE c.amount > s.amount AND s.amount > 8000 RETURN id(c) AS c, id(s) AS s", "SELECT c.id AS c, s.id AS s FROM edges a JOIN edges b USING (dst) JOIN nodes c ON c.id = a.src JOIN nodes s ON s.id = b.src WHERE a.type = 'IN_NATION' AND b.type = 'IN_NATION' AND c.label = 'Customer' AND s.label = 'Supplier' AND c.amount > s.amount AND s.amount > 8000")
pattern("match_ne_null", "MATCH (n)-[:IN_NATION|IN_REGION]->(m) WHERE n.amount <> 1 AND NOT n.name LIKE 'Customer%' RETURN id(n) AS n", "SELECT n.id AS n FROM edges JOIN nodes n ON n.id = src WHERE type IN ('IN_NATION', 'IN_REGION') AND (n.amount IS NULL OR n.amount <> 1) AND NOT starts_with(n.name, 'Customer')")
pattern("match_agg", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) RETURN n.name AS nation, count(*) AS n, sum(c.amount) AS total, avg(c.amount) AS mean, min(c.name) AS first ORDER BY n DESC, nation LIMIT 5", "SELECT n.name AS nation, count(*) AS n, round(sum(c.amount), 2) AS total, round(avg(c.amount), 6) AS mean, min(c.name) AS first FROM edges JOIN nodes n ON n.id = dst JOIN nodes c ON c.id = src WHERE type = 'IN_NATION' AND c.label = 'Customer' GROUP BY 1 ORDER BY n DESC, nation LIMIT 5", fix=lambda df: df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)}))
pattern("match_collect", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS r, collect(n.name) AS nations", "SELECT r.name AS r, string_agg(n.name, ',' ORDER BY n.name) AS nations FROM edges JOIN nodes n ON n.id = src JOIN nodes r ON r.id = dst WHERE type = 'IN_REGION' GROUP BY 1", fix=lambda df: df.withColumn("nations", F.array_join(F.array_sort("nations"), ",")))
pattern("match_distinct", "MATCH (o:Order)-[:CONTAINS]->(p)-[:SUPPLIED_BY]->(s) WHERE o.amount > 240000 RETURN DISTINCT s.name AS s", "SELECT DISTINCT s.name AS s FROM edges a JOIN edges b ON a.dst = b.src JOIN nodes o ON o.id = a.src JOIN nodes s ON s.id = b.dst WHERE a.type = 'CONTAINS' AND b.type = 'SUPPLIED_BY' AND o.amount > 240000")
pattern("match_order_skip_limit", "MATCH (c:Customer)-[:PLACED]->(o) RETURN o.amount AS amount, id(o) AS o ORDER BY amount DESC, o SKIP 3 LIMIT 7", "SELECT amount, id AS o FROM nodes WHERE label = 'Order' ORDER BY amount DESC, id LIMIT 7 OFFSET 3")
pattern("match_edge_prop", "MATCH (o:Order)-[e:CONTAINS {weight: 50.0}]->(p:Part) RETURN id(o) AS o, id(p) AS p, e.weight AS w", "SELECT src AS o, dst AS p, w FROM edges WHERE type = 'CONTAINS' AND w = 50")
pattern("match_star", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN *", "SELECT n.id AS n, r.id AS r FROM edges JOIN nodes n ON n.id = src JOIN nodes r ON r.id = dst WHERE type = 'IN_REGION'", fix=lambda df: df.select(F.col("n.id").alias("n"), F.col("r.id").alias("r")))

HOP = "FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst"
pattern("match_in_list", "MATCH (n) WHERE n.name IN ['ASIA', 3, 'EUROPE'] OR n.amount IN [1, 2] RETURN id(n) AS n", "SELECT id AS n FROM nodes WHERE name IN ('ASIA', 'EUROPE') OR amount IN (1, 2)")
pattern("match_is_null", "MATCH (n) WHERE n.amount IS NULL AND n.name IS NOT NULL RETURN label(n) AS label, count(*) AS n", "SELECT label, count(*) AS n FROM nodes WHERE amount IS NULL AND name IS NOT NULL GROUP BY 1")
pattern("match_starts_ends", "MATCH (n) WHERE n.name STARTS WITH 'A' OR n.name ENDS WITH 'IA' RETURN id(n) AS n, n.name AS name", "SELECT id AS n, name FROM nodes WHERE starts_with(name, 'A') OR ends_with(name, 'IA')")
pattern("match_contains", "MATCH (n:Customer) WHERE n.name CONTAINS '77' RETURN id(n) AS n", "SELECT id AS n FROM nodes WHERE label = 'Customer' AND contains(name, '77')")
pattern("match_below_minus_one", "MATCH (n) WHERE n.amount <-1 RETURN id(n) AS n, n.amount AS amount", "SELECT id AS n, amount FROM nodes WHERE amount < -1")
pattern("match_no_match", "MATCH (n:Nothing)-[:PLACED]->(m) RETURN count(*) AS n, sum(m.amount) AS total", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS total")
pattern("match_like_of_property", "MATCH (a:Nation)-[:IN_REGION]->(b) WHERE a.name NOT LIKE b.name RETURN a.name AS a, b.name AS b", f"SELECT a.name AS a, b.name AS b {HOP} WHERE type = 'IN_REGION' AND a.name NOT LIKE b.name")
pattern("match_node_scan", "MATCH (n:Supplier) RETURN id(n) AS n, label(n) AS label, n.name AS name", "SELECT id AS n, label, name FROM nodes WHERE label = 'Supplier'")
add("query_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 1000", lambda s, d: s.createDataFrame([(q(s, d, "orders", "o_orderkey").filter(col("o_totalprice").gt(1000)).limit(1).count(),)], "n long"))

ASIA = 1 * G + 2
add("graph_neighbors", WITH + f"SELECT src AS \"to\", type FROM edges WHERE dst = {ASIA}", lambda s, d: Graph(*graph(s, d)).neighbors(ASIA, "in").select("to", "type"))
add("graph_degree", WITH + "SELECT n.id, n.label, CAST(count(e.src) AS BIGINT) AS degree FROM nodes n LEFT JOIN edges e ON n.id = e.src GROUP BY 1, 2", lambda s, d: Graph(*graph(s, d)).degrees("out"))
add("graph_hubs", WITH + "SELECT n.id, CAST(count(*) AS BIGINT) AS degree FROM nodes n JOIN (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) ON n.id = x WHERE n.label = 'Supplier' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", lambda s, d: Graph(*graph(s, d)).top_hubs(10, "both", "Supplier"))
REACH = ", b(id, depth) AS (SELECT {0}, 0 UNION SELECT src, depth + 1 FROM b JOIN edges ON dst = b.id WHERE depth < 3), f AS (SELECT id, min(depth) AS depth FROM b GROUP BY 1) SELECT f.id, f.depth FROM f"
add("graph_bfs", WITH + REACH.format(ASIA), lambda s, d: Graph(*graph(s, d)).bfs(ASIA, "in", max_depth=3).select("id", "depth"))
add("graph_bfs_parents", WITH + f"""SELECT src AS id, 1 AS depth, dst AS parent FROM edges WHERE dst = {ASIA} UNION ALL SELECT b.src, 2, b.dst FROM edges a JOIN edges b ON b.dst = a.src WHERE a.dst = {ASIA}
    UNION ALL SELECT c.src, 3, first(c.dst ORDER BY a.src, b.src) FROM edges a JOIN edges b ON b.dst = a.src JOIN edges c ON c.dst = b.src WHERE a.dst = {ASIA} GROUP BY 1""",
    lambda s, d: Graph(*graph(s, d)).bfs(ASIA, "in", max_depth=3).where("depth > 0").select("id", "depth", "parent"))
add("graph_bfs_label", WITH + REACH.format(ASIA) + " JOIN nodes n ON n.id = f.id WHERE label = 'Customer'", lambda s, d: Graph(*graph(s, d)).bfs(ASIA, "in", max_depth=3, labels=["Customer"]).select("id", "depth"))
add("graph_subgraph", WITH + f"SELECT id FROM edges WHERE type = 'IN_REGION' AND dst = {ASIA}", lambda s, d: Graph(*graph(s, d)).subgraph(ASIA, "in", 1)[1].select("id"))


add("graph_shortest", WITH + f", b(id, depth) AS (SELECT {3 * G + 1}, 0 UNION SELECT CASE WHEN src = b.id THEN dst ELSE src END, depth + 1 FROM b JOIN edges ON (src = b.id OR dst = b.id) AND type IN ('IN_NATION', 'IN_REGION') WHERE depth < 6) SELECT coalesce(CAST(min(depth) AS INTEGER), -1) AS hops FROM b WHERE id = {ASIA}", lambda s, d: s.createDataFrame([(len(Graph(*graph(s, d)).shortest_path(3 * G + 1, ASIA, "both", ["IN_NATION", "IN_REGION"]) or []) - 1,)], "hops int"))
add("graph_dijkstra", WITH + f"SELECT id, round(cost, 6) AS cost FROM (SELECT {6 * G} AS id, 0.0::DOUBLE AS cost UNION ALL SELECT dst, w FROM edges WHERE src = {6 * G} AND type = 'CONTAINS' UNION ALL SELECT b.dst, min(a.w + b.w) FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = {6 * G} AND a.type = 'CONTAINS' AND b.type = 'SUPPLIED_BY' GROUP BY 1)", lambda s, d: Graph(*graph(s, d)).distances(6 * G, "weight", 1.0, types=["CONTAINS", "SUPPLIED_BY"]).select("id", F.round("cost", 6).alias("cost")))


def _cascade(s, d) -> DataFrame:
    base = Database(s)
    base.use_graph(*graph(s, d))
    base.cascade_delete(3 * G + 1, "PLACED")
    return base.state.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


add("graph_cascade", WITH + f"SELECT label, count(*) AS n FROM nodes WHERE id <> {3 * G + 1} AND id NOT IN (SELECT dst FROM edges WHERE type = 'PLACED' AND src = {3 * G + 1}) GROUP BY 1", _cascade)

# ---------------------------------------------------------------- search
def fts_oracle(terms: list[tuple[str, bool]], match_all: bool = False, where: str = "true") -> str:
    hit = " OR ".join(f"starts_with(term, '{w}')" if p else f"term = '{w}'" for w, p in terms)
    asked = " UNION ALL ".join(f"SELECT doc_id, part, {i} AS q FROM s WHERE " + (f"starts_with(term, '{w}')" if p else f"term = '{w}'") for i, (w, p) in enumerate(terms))
    having = f"HAVING count(DISTINCT q) = {len(terms)}" if match_all else ""
    return f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS ws FROM documents WHERE text IS NOT NULL),
a AS (SELECT count(*) AS n, greatest(sum(len(ws)) / count(*), 1) AS m FROM w),
p AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w),
tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM p WHERE {hit} GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m)) AS part FROM tf JOIN df USING (term), a)
SELECT doc_id, round(sum(part), 6) AS score FROM ({asked}) JOIN (SELECT doc_id AS id FROM documents WHERE {where}) ON id = doc_id GROUP BY 1 {having} ORDER BY sum(part) DESC, doc_id LIMIT 20"""


def fts(name: str, query: str, where: str = "true", pred=None, match_all: bool = False) -> None:
    add(name, fts_oracle(search.query_terms(query), match_all, where), lambda s, d: search.bm25(t(s, d, "documents"), "doc_id", "text", query, 20, match_all, pred and pred()).select("doc_id", F.round("score", 6).alias("score")))


fts("fts_bm25", "license apache the")
fts("fts_prefix", "lice* vers*")
fts("fts_match_all", "licensed version the", match_all=True)
fts("fts_filter", "und der license", "lang = 'de'", lambda: col("lang").eq("de"))
add("fts_terms", r"SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x))) AS term FROM documents) GROUP BY 1", lambda s, d: t(s, d, "documents").select(F.explode(search.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))

V = [((i * 37) % 17 - 8) / 8 for i in range(64)]
VL = "[" + ", ".join(map(str, V)) + "]::DOUBLE[]"
VECS = {"cosine": f"list_cosine_similarity(embedding::DOUBLE[], {VL})", "dot": f"list_dot_product(embedding::DOUBLE[], {VL})", "euclidean": f"list_distance(embedding::DOUBLE[], {VL})"}
for _metric, _sql in VECS.items():
    add(f"vec_{_metric}", f"SELECT vec_id, round({_sql}, 6) AS score FROM embeddings ORDER BY {_sql} {'ASC' if _metric == 'euclidean' else 'DESC'}, vec_id LIMIT 15", lambda s, d, m=_metric: search.nearest(t(s, d, "embeddings"), "vec_id", "embedding", V, 15, m).select("vec_id", F.round("score", 6).alias("score")))
add("vec_filtered", f"SELECT vec_id, label, round({VECS['cosine']}, 6) AS score FROM embeddings WHERE label < 3 ORDER BY {VECS['cosine']} DESC, vec_id LIMIT 10", lambda s, d: search.nearest(t(s, d, "embeddings"), "vec_id", "embedding", V, 10, "cosine", col("label").lt(3)).select("vec_id", "label", F.round("score", 6).alias("score")))

# ---------------------------------------------------------------- hybrid
def _ids(s, *ids: int) -> DataFrame:
    return s.createDataFrame(list(enumerate(ids)), "pos long, id long")


def _plain_nodes(s, d, segment: str | None = None) -> DataFrame:
    """Customers, or those of a market segment, as nodes under their own keys."""
    customers = t(s, d, "customer")
    return (customers if segment is None else customers.where(F.col("c_mktsegment") == segment)).select(F.col("c_custkey").alias("id"), F.lit("Customer").alias("label"), F.struct("c_name").alias("properties"))


GIVEN = "(VALUES (0, 3), (1, 1), (2, 3), (3, -7), (4, 900000)) AS g(pos, id)"
add("hybrid_pk", f"SELECT CAST(g.pos AS BIGINT) AS pos, CAST(g.id AS BIGINT) AS id, c.c_name AS node, o.o_totalprice AS price FROM {GIVEN} LEFT JOIN customer c ON c.c_custkey = g.id LEFT JOIN orders o ON o.o_orderkey = g.id", lambda s, d: hybrid.nodes_with_rows(_ids(s, 3, 1, 3, -7, 900000), _plain_nodes(s, d), t(s, d, "orders"), "o_orderkey").select("pos", "id", F.col("node.properties.c_name").alias("node"), F.col("row.o_totalprice").alias("price")))
add("hybrid_fk", f"SELECT CAST(g.pos AS BIGINT) AS pos, CAST(g.id AS BIGINT) AS id, coalesce(n, 0) AS n, coalesce(keys, '') AS keys FROM {GIVEN} LEFT JOIN (SELECT o_custkey, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1) ON o_custkey = g.id", lambda s, d: hybrid.nodes_with_groups(_ids(s, 3, 1, 3, -7, 900000), _plain_nodes(s, d), t(s, d, "orders"), "o_custkey", "o_orderkey").select("pos", "id", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys")))
add("hybrid_reverse", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'", lambda s, d: hybrid.rows_with_nodes(t(s, d, "orders"), _plain_nodes(s, d, "BUILDING"), "o_custkey").select("o_orderkey", F.col("node.properties.c_name").alias("c_name")))
add("hybrid_query", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) LEFT JOIN customer ON o_custkey = c_custkey", lambda s, d: hybrid.query_rows_with_nodes(q(s, d, "orders", "o_orderkey").filter(col("o_totalprice").gt(200000)).order_by_desc("o_totalprice").limit(30), _plain_nodes(s, d), "o_custkey").select("o_orderkey", F.col("node.properties.c_name").alias("c_name")))

# ---------------------------------------------------------------- upkeep
def _kv(s, d) -> DataFrame:
    base = Database(s)
    base._set(kv={"names": t(s, d, "nation").select(F.encode("n_name", "utf-8").alias("key"), F.encode(F.col("n_nationkey").cast("string"), "utf-8").alias("value"))})
    base.put("names", b"CHINA", b"x")
    base.delete_key("names", b"CANADA")
    return base.range("names", b"C", b"J").select(F.decode("key", "utf-8").alias("key"), F.decode("value", "utf-8").alias("value"))


add("kv_range", "SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_name >= 'C' AND n_name < 'J' AND n_name NOT IN ('CANADA', 'CHINA') UNION ALL SELECT 'CHINA', 'x'", _kv)
add("stats_counts", "SELECT '(nodes)' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT '(edges)', 0 UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', count(*) FROM {n}" for n in ("customer", "documents", "events", "nation", "orders", "part", "supplier")), lambda s, d: db(s, d).stats())


def _round_trip(kind: str):
    def fn(s, d):
        import uuid

        from .sources import files
        from .storage import shared_dir

        base, path = customers(s, d), f"{shared_dir(s)}/export-{uuid.uuid4().hex}"
        getattr(files, f"export_{kind}")(base.table("cust"), path)
        return getattr(files, f"read_{kind}")(s, path, base.table("cust").schema)

    return fn


add("io_csv_roundtrip", CUST, _round_trip("csv"))
add("io_jsonl_roundtrip", CUST, _round_trip("jsonl"))


def _sync(s, d) -> DataFrame:
    from .database import New

    base = customers(s, d)
    base.sync([("File", {"path": "a"}), ("Symbol", {"name": "f"})], [(New(0), New(1), "DEFINES", {})], {"cust": [{"c_custkey": 1, "c_name": "one"}]})
    n, e = base.state.nodes.count(), base.state.edges.count()
    return base.table("cust").df.select("c_custkey", "c_name", F.lit(n).alias("nodes"), F.lit(e).alias("edges"))


add("sync_batch", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'one' ELSE c_name END AS c_name, 2 AS nodes, 1 AS edges FROM customer", _sync)
