"""Every graph query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.coercion import typed_match
from graphloom.model import Direction, DuplicateId, PropertyGraph, edge_table
from graphloom.operators import adjacency as adj
from graphloom.operators import components, criteria, indexing, mutate, ordering, scan, structure, traversal
from graphloom.operators import properties as prop
from graphloom.operators.criteria import all_of, any_of, between, contains, contains_element, exact, exists, negated, not_exists, query_vertices, regex
from graphloom.sources import graphson, tables
from graphloom.streaming import degrees as streams
from graphloom.walk import gt, walk

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# The graphs in SQL.

_COLUMNS = {"name": "VARCHAR", "balance": "DOUBLE", "segment": "VARCHAR", "price": "DOUBLE", "size": "INTEGER", "brand": "VARCHAR", "status": "VARCHAR", "priority": "VARCHAR", "total": "DOUBLE"}
_VERTICES = {
    "region": ("r_regionkey", {"name": "r_name"}),
    "nation": ("n_nationkey", {"name": "n_name"}),
    "customer": ("c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
    "supplier": ("s_suppkey", {"name": "s_name", "balance": "s_acctbal"}),
    "part": ("p_partkey", {"name": "p_name", "price": "p_retailprice", "size": "p_size", "brand": "p_brand"}),
    "orders": ("o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice"}),
}
_LINE = "(SELECT *, l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || l_quantity::BIGINT AS eid FROM lineitem)"
_EDGES = {
    "in_region": "SELECT 'in_region:' || n_nationkey AS id, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'in_region' AS label, 1.0::DOUBLE AS weight, NULL::DOUBLE AS discount FROM nation",
    "lives_in": "SELECT 'lives_in:' || c_custkey AS id, 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'lives_in' AS label, 1.0::DOUBLE AS weight, NULL::DOUBLE AS discount FROM customer",
    "based_in": "SELECT 'based_in:' || s_suppkey AS id, 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst, 'based_in' AS label, 1.0::DOUBLE AS weight, NULL::DOUBLE AS discount FROM supplier",
    "placed": "SELECT 'placed:' || o_orderkey AS id, 'customer:' || o_custkey AS src, 'orders:' || o_orderkey AS dst, 'placed' AS label, 1.0::DOUBLE AS weight, NULL::DOUBLE AS discount FROM orders",
    "contains": f"SELECT 'contains:' || eid AS id, 'orders:' || l_orderkey AS src, 'part:' || l_partkey AS dst, 'contains' AS label, l_quantity::DOUBLE AS weight, l_discount::DOUBLE AS discount FROM {_LINE}",
    "supplies": f"SELECT 'supplies:' || eid AS id, 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'supplies' AS label, l_quantity::DOUBLE AS weight, l_discount::DOUBLE AS discount FROM {_LINE}",
}


def v_sql(*labels: str) -> str:
    parts = []
    for x in labels or _VERTICES:
        pk, own = _VERTICES[x]
        columns = ", ".join(f"CAST({own.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _COLUMNS.items())
        parts.append(f"SELECT '{x}:' || {pk} AS id, '{x}' AS label, {columns} FROM {x}")
    return "v AS (" + " UNION ALL ".join(parts) + ")"


def e_sql(*labels: str) -> str:
    return "e AS (" + " UNION ALL ".join(_EDGES[x] for x in labels or _EDGES) + ")"


def p_sql(*labels: str) -> str:
    """Needs v."""
    kinds = {"VARCHAR": "string", "DOUBLE": "double", "INTEGER": "long"}
    parts = [f"SELECT id AS vertex_id, '{c}' AS key, CAST({c} AS VARCHAR) AS value, '{kinds[t]}' AS type, 'SINGLE' AS cardinality, 0::BIGINT AS ord, NULL AS status FROM v WHERE {c} IS NOT NULL" for c, t in _COLUMNS.items()]
    if not labels or "customer" in labels:
        parts.append("SELECT 'customer:' || o_custkey, 'priorities', o_orderpriority, 'string', 'LIST', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, o_orderstatus FROM orders")
    return "p AS (" + " UNION ALL ".join(parts) + ")"


V, E = "WITH " + v_sql(), "WITH " + e_sql()
VE = f"WITH {v_sql()}, {e_sql()}"
VP = f"WITH {v_sql('customer')}, {p_sql('customer')}"
_TRADE = """flow AS (SELECT s_nationkey AS a, c_nationkey AS b, sum(l_quantity)::DOUBLE AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
e AS (SELECT 'trades:' || a || '>' || b AS id, 'nation:' || a AS src, 'nation:' || b AS dst, q AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY q DESC, b) AS r FROM flow) WHERE r <= 2),
v AS (SELECT 'nation:' || n_nationkey AS id FROM nation),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""
_TOP_TWO, _TOP_ONE = "WHERE r <= 2", "WHERE r <= 1"
T = f"WITH RECURSIVE {_TRADE}"
_GEO = f"{v_sql('region', 'nation', 'supplier')}, {e_sql('in_region', 'based_in')}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
G = f"WITH RECURSIVE {_GEO}"


def commerce(spark: SparkSession, sf: str, vertices: list[str] = tables.VERTEX_LABELS, edges: list[str] = tables.EDGE_LABELS) -> PropertyGraph:
    return tables.commerce(spark, sf, vertices, edges)


def people(spark: SparkSession, sf: str) -> PropertyGraph:
    """Customers only."""
    return tables.commerce(spark, sf, ["customer"], ["placed"])


# Scans.

IDS = ["customer:1", "part:7", "nowhere:1", "customer:1"]
ELEMENT = "id, label"


@query(f"{V} SELECT {ELEMENT} FROM v")
def v_all(spark, sf):
    return commerce(spark, sf).vertices.select("id", "label")


@query(f"{V} SELECT v.id, label FROM v JOIN (VALUES ('customer:1'), ('part:7'), ('nowhere:1'), ('customer:1')) w(id) ON v.id = w.id")
def v_by_ids(spark, sf):
    return scan.vertices_by_ids(commerce(spark, sf), IDS).select("id", "label")


@query(f"{E} SELECT id, src, dst, label FROM e")
def e_all(spark, sf):
    return commerce(spark, sf).edges.select("id", "src", "dst", "label")


@query(f"{E} SELECT e.id, src, dst FROM e JOIN (VALUES ('placed:1'), ('placed:1'), ('in_region:3'), ('x')) w(id) ON e.id = w.id")
def e_by_ids(spark, sf):
    return scan.edges_by_ids(commerce(spark, sf), ["placed:1", "placed:1", "in_region:3", "x"]).select("id", "src", "dst")


@query(f"{V} SELECT id, label FROM v WHERE label IN ('region', 'supplier')")
def v_by_label(spark, sf):
    return scan.by_label(commerce(spark, sf).vertices, "region", "supplier").select("id", "label")


@query(f"{E} SELECT id, src, dst FROM e WHERE label = 'lives_in'")
def e_by_label(spark, sf):
    return scan.by_label(commerce(spark, sf).edges, "lives_in").select("id", "src", "dst")


@query(f"{V} SELECT id FROM v WHERE segment = 'BUILDING'")
def v_by_property(spark, sf):
    return scan.by_property(commerce(spark, sf).vertices, "segment", "BUILDING").select("id")


@query(f"{V} SELECT id FROM v WHERE status = 'F' AND priority = '1-URGENT' AND segment IS NULL")
def v_by_properties(spark, sf):
    return scan.by_properties(commerce(spark, sf).vertices, {"status": "F", "priority": "1-URGENT", "segment": None}).select("id")


@query(f"{E} SELECT id FROM e WHERE weight = 17.0")
def e_by_property(spark, sf):
    return scan.by_property(commerce(spark, sf).edges, "weight", 17.0).select("id")


@query(f"{E} SELECT id FROM e WHERE weight = 17.0 AND label = 'contains'")
def e_by_properties(spark, sf):
    return scan.by_properties(commerce(spark, sf).edges, {"weight": 17.0, "label": "contains"}).select("id")


@query(f"{E} SELECT id, label FROM e WHERE src = 'nation:3' AND dst = (SELECT 'region:' || n_regionkey FROM nation WHERE n_nationkey = 3)")
def e_between(spark, sf):
    region = tables.table(spark, sf, "nation").where("n_nationkey = 3").first()["n_regionkey"]
    return scan.between(commerce(spark, sf), "nation:3", f"region:{region}").select("id", "label")


# Properties and criteria.


@query(f"{VP} SELECT vertex_id, ord, value FROM p WHERE key = 'priorities'")
def vp_values(spark, sf):
    return prop.values(people(spark, sf).vprops, "priorities")


@query(f"{VP} SELECT vertex_id, key, ord, value FROM p WHERE key IN ('segment', 'priorities')")
def vp_properties(spark, sf):
    return prop.properties(people(spark, sf).vprops, "segment", "priorities").select("vertex_id", "key", "ord", "value")


@query(f"{VP} SELECT vertex_id AS id, string_agg(key || '=' || value, ';' ORDER BY key) AS properties FROM p WHERE ord = 0 AND key IN ('name', 'segment', 'priorities') GROUP BY vertex_id")
def v_value_map(spark, sf):
    return prop.value_map(prop.properties(people(spark, sf).vprops, "name", "segment", "priorities"))


@query(f"{VP} SELECT vertex_id, key, ord, 'status' AS meta_key, status AS meta_value FROM p WHERE status IS NOT NULL")
def meta_values(spark, sf):
    return prop.meta_values(people(spark, sf).vprops, "status")


def _criteria(name: str, *tests: criteria.Criterion, sql: str, multi: bool = False) -> None:
    def f(spark, sf):
        return query_vertices(people(spark, sf) if multi else commerce(spark, sf), *tests).select("id")

    f.__name__ = name
    query((f"{VP} SELECT id FROM v WHERE " if multi else f"{V} SELECT id FROM v WHERE ") + sql)(f)


_MINE = "EXISTS (SELECT 1 FROM p WHERE p.vertex_id = v.id AND p.key = 'priorities' AND "
_criteria("q_exact", exact("size", "15"), sql="size = 15")
_criteria("q_exact_multi", exact("priorities", "1-URGENT"), sql=_MINE + "value = '1-URGENT')", multi=True)


def urgent(spark: SparkSession, sf: str) -> PropertyGraph:
    """Customers; of their orders' priorities only the urgent ones."""
    g = people(spark, sf)
    return g.replace(vprops=g.vprops.where("key <> 'priorities' OR value = '1-URGENT'"), multi=g.multi)


@query(f"{VP} SELECT id FROM v WHERE NOT {_MINE} value = '1-URGENT')")
def q_exact_null(spark, sf):
    return query_vertices(urgent(spark, sf), exact("priorities", None)).select("id")


@query(f"{VP} SELECT id FROM v WHERE {_MINE} value = '2-HIGH') AND NOT {_MINE} ord = 0 AND value = '2-HIGH')")
def q_exact_list(spark, sf):
    """A key with a typed column for first values: later values match, too."""
    g = people(spark, sf)
    first = prop.first_value(g.vprops, "priorities").select(F.col("vertex_id").alias("id"), F.col("value").alias("priorities"))
    g = g.replace(vertices=g.vertices.join(first, "id", "left"))
    return query_vertices(g, exact("priorities", "2-HIGH")).where("NOT coalesce(priorities = '2-HIGH', false)").select("id")


@query(f"{V} SELECT id FROM v WHERE label = 'part'")
def q_bad_bound(spark, sf):
    """A bound that isn't a number and a pattern that isn't one match nothing."""
    return query_vertices(commerce(spark, sf), exists("price"), negated(between("price", "cheap", 10**6)), negated(regex("brand", "Brand#["))).select("id")


_criteria("q_range", between("balance", 1000, 2000), sql="balance >= 1000 AND balance < 2000")
_criteria("q_exists", exists("price"), sql="price IS NOT NULL")
_criteria("q_not_exists", not_exists("name"), sql="name IS NULL")
_criteria("q_contains", contains("name", "1"), sql="contains(name, '1')")
_criteria("q_contains_ci", contains("segment", "build", ignore_case=True), sql="contains(lower(segment), 'build')")
_criteria("q_contains_element", contains_element("priorities", "5-LOW"), sql=_MINE + "value = '5-LOW')", multi=True)
_criteria("q_regex", regex("brand", "Brand#[1-3][0-9]*"), sql="regexp_full_match(brand, 'Brand#[1-3][0-9]*')")
_criteria("q_and", exact("segment", "BUILDING"), between("balance", 5000, None), sql="segment = 'BUILDING' AND balance >= 5000")
_criteria("q_or", any_of(exact("segment", "MACHINERY"), between("balance", None, 0)), sql="segment = 'MACHINERY' OR balance < 0")
_criteria("q_not", negated(exact("segment", "BUILDING")), sql="NOT coalesce(segment = 'BUILDING', false)")
_criteria(
    "q_complex", all_of(any_of(exact("priorities", "1-URGENT"), exact("priorities", "2-HIGH")), negated(contains("segment", "AUTO")), between("balance", 0, 9000, True, True)),
    sql=_MINE + "value IN ('1-URGENT', '2-HIGH')) AND NOT coalesce(contains(segment, 'AUTO'), false) AND balance >= 0 AND balance <= 9000", multi=True,
)


@query(f"{VP} SELECT vertex_id, key, ord FROM p WHERE key = 'priorities' AND value = '3-MEDIUM' OR key = 'balance' AND TRY_CAST(value AS DOUBLE) >= 9000")
def q_vertex_properties(spark, sf):
    rows = criteria.query_properties(people(spark, sf).vprops, exact("priorities", "3-MEDIUM"), between("balance", 9000, None))
    return rows.select("vertex_id", "key", "ord")


@query(f"{V} SELECT id FROM v WHERE price >= 905 AND price <= 912")
def q_by_range(spark, sf):
    return criteria.query_range(commerce(spark, sf), "price", 905, 912).select("id")


@query(f"{VP} SELECT id FROM v WHERE " + _MINE + "status = 'P')")
def q_by_meta(spark, sf):
    return criteria.query_by_meta(people(spark, sf), "priorities", "status", "P").select("id")


@query(f"{VP} SELECT id FROM v WHERE NOT {_MINE} value = '1-URGENT')")
def q_by_cardinality(spark, sf):
    """A customer without an urgent order has the key as SINGLE."""
    return criteria.query_by_cardinality(urgent(spark, sf), "priorities", "SINGLE").select("id")


# Adjacency.

_GEO_E = "WITH " + e_sql("in_region", "based_in", "lives_in")
_BOTH = "SELECT src AS source, id AS edge, dst AS target FROM e UNION ALL SELECT dst, id, src FROM e WHERE src <> dst"


def near(spark: SparkSession, sf: str) -> PropertyGraph:
    return tables.commerce(spark, sf, ["region", "nation", "supplier", "customer"], ["in_region", "based_in", "lives_in"])


def _start(g: PropertyGraph, label: str = "nation") -> DataFrame:
    return scan.by_label(g.vertices, label)


def _adjacent(name: str, direction: Direction, rows: str) -> None:
    def edges(spark, sf):
        g = near(spark, sf)
        return adj.incident_edges(g, _start(g), direction)

    def vertices(spark, sf):
        g = near(spark, sf)
        return adj.neighbours(g, _start(g), direction)

    edges.__name__, vertices.__name__ = f"adj_edges_{name}", f"adj_vertices_{name}"
    query(f"{_GEO_E} SELECT * FROM ({rows}) WHERE starts_with(source, 'nation:')")(edges)
    query(f"{_GEO_E} SELECT DISTINCT source, target FROM ({rows}) WHERE starts_with(source, 'nation:')")(vertices)


_adjacent("out", Direction.OUT, "SELECT src AS source, id AS edge, dst AS target FROM e")
_adjacent("in", Direction.IN, "SELECT dst AS source, id AS edge, src AS target FROM e")
_adjacent("both", Direction.BOTH, _BOTH)


@query(f"{VE} SELECT e.id, e.label, a.label AS src_label, b.label AS dst_label FROM e JOIN v a ON e.src = a.id JOIN v b ON e.dst = b.id WHERE e.label IN ('placed', 'based_in')")
def edge_endpoints(spark, sf):
    g = commerce(spark, sf)
    return adj.endpoints(g, scan.by_label(g.edges, "placed", "based_in")).select("id", "label", "src_label", "dst_label")


_LOOPS = "(VALUES ('a', '1', '1'), ('b', '1', '2'), ('c', '2', '2')) e(id, src, dst)"


@query(f"SELECT id FROM {_LOOPS} WHERE src = dst")
def e_self_loops(spark, sf):
    return adj.self_loops(edge_table(spark, [{"id": "a", "src": 1, "dst": 1}, {"id": "b", "src": 1, "dst": 2}, {"id": "c", "src": 2, "dst": 2}])).select("id")


@query(f"{E} SELECT DISTINCT a.src AS source, b.dst AS target FROM e a JOIN e b ON a.dst = b.src WHERE a.label = 'placed' AND b.label = 'contains' AND a.src <> b.dst AND a.src IN ('customer:1', 'customer:2', 'customer:3', 'customer:4')")
def two_hop(spark, sf):
    g = commerce(spark, sf)
    start = g.vertices.where(F.col("id").isin([f"customer:{k}" for k in range(1, 5)]))
    return adj.two_hop(g, start, (Direction.OUT, "placed"), (Direction.OUT, "contains"))


@query(f"{E} , d AS (SELECT DISTINCT src, dst FROM e WHERE label = 'based_in') SELECT a.src AS a, b.src AS b, count(*) AS shared FROM d a JOIN d b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2")
def co_neighbors(spark, sf):
    return adj.co_neighbours(commerce(spark, sf), "based_in")


def _degree(name: str, direction: Direction, ends: str) -> None:
    def f(spark, sf):
        return adj.degrees(near(spark, sf), direction)

    f.__name__ = name
    v = v_sql("region", "nation", "supplier", "customer")
    query(f"WITH {v}, {e_sql('in_region', 'based_in', 'lives_in')}, n AS ({ends}) SELECT v.id, count(n.id) AS degree FROM v LEFT JOIN n ON v.id = n.id GROUP BY v.id")(f)


_degree("degree_in", Direction.IN, "SELECT dst AS id FROM e")
_degree("degree_both", Direction.BOTH, "SELECT src AS id FROM e UNION ALL SELECT dst FROM e")


@query(f"WITH {v_sql('customer')}, {e_sql('placed')} SELECT v.id, count(e.id) AS degree FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id")
def degree_out(spark, sf):
    return adj.degrees(tables.commerce(spark, sf, ["customer"], ["placed"]), Direction.OUT)


@query(f"WITH {v_sql('supplier')}, {e_sql('supplies')} SELECT v.id, count(DISTINCT e.dst) AS neighbours FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id")
def distinct_degree(spark, sf):
    return adj.distinct_degrees(tables.commerce(spark, sf, ["supplier"], ["supplies"]), Direction.OUT)


@query(f"{_GEO_E} SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT src AS id, label FROM e UNION ALL SELECT dst, label FROM e) GROUP BY id")
def edge_labels(spark, sf):
    return adj.edge_labels(near(spark, sf), Direction.BOTH)


# Aggregates.


def _aggregate(name: str, key: str, select: str) -> None:
    def f(spark, sf):
        return prop.aggregate(people(spark, sf).vprops, key, name)

    f.__name__ = f"agg_{name}"
    if name in ("sum", "avg", "variance"):
        g = f

        def f(spark, sf):
            return g(spark, sf).select(F.round(name, 3).alias(name))

        f.__name__ = g.__name__
    query(f"{VP} SELECT {select} AS {name} FROM p WHERE key = '{key}'")(f)


_NUMBER = "CASE WHEN type IN ('long', 'double') THEN TRY_CAST(value AS DOUBLE) END"
_aggregate("count", "priorities", "count(value)")
_aggregate("distinct", "priorities", "count(DISTINCT value)")
_aggregate("min", "balance", f"coalesce(min({_NUMBER}), 0.0)")
_aggregate("max", "balance", f"coalesce(max({_NUMBER}), 0.0)")
_aggregate("sum", "balance", f"round(coalesce(sum({_NUMBER}), 0.0), 3)")
_aggregate("avg", "balance", f"round(coalesce(sum({_NUMBER}) / count(value), 0.0), 3)")
_aggregate("variance", "balance", f"round(coalesce(var_samp({_NUMBER}), 0.0), 3)")


@query(
    f"{VP}, n AS (SELECT key, vertex_id, count(*) AS n, bool_or(status IS NOT NULL) AS m, max(cardinality) AS c FROM p GROUP BY 1, 2) "
    "SELECT key, sum(n)::BIGINT AS properties, count(*) AS vertices, bool_or(m) AS has_meta, (SELECT count(*) FROM v) - sum((c = 'LIST')::INT)::BIGINT - sum((c = 'SET')::INT)::BIGINT AS single, "
    "sum((c = 'LIST')::INT)::BIGINT AS list, sum((c = 'SET')::INT)::BIGINT AS set FROM n GROUP BY key"
)
def graph_property_stats(spark, sf):
    return prop.statistics(people(spark, sf))


@query(f"{VP} SELECT vertex_id, key, CASE WHEN count(value) <= 1 THEN 'SINGLE' WHEN count(value) = count(DISTINCT value) THEN 'LIST' ELSE 'SET' END AS cardinality FROM p GROUP BY 1, 2")
def cardinality_analysis(spark, sf):
    return prop.cardinality_analysis(people(spark, sf).vprops)


@query(
    f"{VP} SELECT vertex_id, key, 'repeated values' AS problem FROM p WHERE key = 'priorities' GROUP BY 1, 2 HAVING min(status) <> 'F' AND count(value) > count(DISTINCT value) "
    "UNION ALL SELECT vertex_id, key, 'several values' FROM p WHERE key = 'priorities' GROUP BY 1, 2 HAVING min(status) = 'F' AND count(value) > 1"
)
def constraint_violations(spark, sf):
    """The priorities taken for a SET, and for SINGLE where an order is finished."""
    rows = people(spark, sf).vprops
    finished = rows.where("key = 'priorities' AND meta['status'] = 'F'").select("vertex_id", F.lit(True).alias("f")).distinct()
    kind = F.when(F.col("key") != "priorities", F.col("cardinality")).when(F.col("f"), "SINGLE").otherwise("SET")
    return prop.violations(rows.join(finished, "vertex_id", "left").withColumn("cardinality", kind))


@query(f"{V} SELECT segment AS value, count(*) AS elements FROM v GROUP BY segment")
def group_v_by_prop(spark, sf):
    return prop.group_by(commerce(spark, sf).vertices, "segment")


@query(f"{E} SELECT discount AS value, count(*) AS elements FROM e GROUP BY discount")
def group_e_by_prop(spark, sf):
    return prop.group_by(commerce(spark, sf).edges, "discount")


@query(f"{VP} SELECT value, count(DISTINCT vertex_id) AS vertices, string_agg(DISTINCT vertex_id, ',' ORDER BY vertex_id) AS ids FROM p WHERE key = 'segment' GROUP BY value")
def prop_index(spark, sf):
    return prop.inverted(people(spark, sf).vprops, "segment").withColumn("ids", F.array_join("ids", ","))


@query(f"{VE} SELECT a.n AS vertices, b.n AS edges, 2.0::DOUBLE * b.n / a.n AS avg_degree, round(2.0::DOUBLE * b.n / (a.n::DOUBLE * (a.n - 1)), 9) AS density FROM (SELECT count(*) AS n FROM v) a, (SELECT count(*) AS n FROM e) b")
def graph_stats(spark, sf):
    return prop.summary(commerce(spark, sf)).withColumn("density", F.round("density", 9))


@query(
    f"{V}, n AS (SELECT 'brand' AS key, count(DISTINCT brand) AS values, count(brand) AS elements FROM v UNION ALL SELECT 'size', count(DISTINCT size), count(size) FROM v) "
    "SELECT key, values, elements, elements::DOUBLE / values AS mean FROM n"
)
def index_stats(spark, sf):
    return indexing.statistics(commerce(spark, sf).vertices, "brand", "size")


@query(f"{E} SELECT id, label, src, dst, ((weight IS NOT NULL)::INT + (discount IS NOT NULL)::INT) AS properties, src = dst AS self_loop, coalesce(weight, 1.0) AS weight FROM e WHERE label IN ('placed', 'supplies')")
def edge_statistics(spark, sf):
    return prop.edge_statistics(scan.by_label(commerce(spark, sf).edges, "placed", "supplies"))


@query(f"{VP} SELECT vertex_id, key, count(*) AS values, bool_or(status IS NOT NULL) AS has_meta, max(cardinality) AS cardinality FROM p GROUP BY 1, 2")
def vertex_statistics(spark, sf):
    return prop.vertex_statistics(people(spark, sf).vprops)


_COERCED = "(VALUES ('1', 'long'), ('1.0', 'double'), ('true', 'boolean'), ('yes', 'string'), ('1', 'string'), ('on', 'string'), ('x', 'string'), ('0', 'long'), ('false', 'boolean')) t(value, type)"


@query(
    f"SELECT value, type, (type <> 'boolean' AND TRY_CAST(value AS DOUBLE) = 1.0) IS TRUE AS one, (type IN ('boolean', 'string') AND lower(value) IN ('true', '1', 'yes', 'on')) AS yes, "
    f"(type = 'string' AND value = '1' OR type IN ('long', 'double') AND TRY_CAST(value AS DOUBLE) = 1.0 OR type = 'boolean' AND value = 'true') IS TRUE AS text FROM {_COERCED}"
)
def coercion(spark, sf):
    """Which values equal the number 1, true, and the text 1."""
    rows = spark.createDataFrame([("1", "long"), ("1.0", "double"), ("true", "boolean"), ("yes", "string"), ("1", "string"), ("on", "string"), ("x", "string"), ("0", "long"), ("false", "boolean")], "value string, type string")
    same = lambda x: typed_match(F.col("value"), F.col("type"), x)
    return rows.select("value", "type", same(1).alias("one"), same(True).alias("yes"), same("1").alias("text"))


@query(f"{VP} SELECT vertex_id, key, value, type, cardinality, ord FROM p UNION ALL SELECT id, 'edge', src || '>' || dst, 'string', label, 0 FROM (WITH {e_sql('placed')} SELECT * FROM e)")
def graphson_round_trip(spark, sf):
    """Customers and what they placed, as typed graph JSON lines and back."""
    g = people(spark, sf)
    lines = lambda x: x.select("line")
    back = graphson.parse(lines(graphson.vertex_lines(g)), lines(graphson.edge_lines(g)))
    # a LIST of one value reads as SINGLE
    rows = back.vprops.withColumn("cardinality", F.when(F.col("key") == "priorities", "LIST").otherwise(F.col("cardinality"))).select("vertex_id", "key", "value", "type", "cardinality", "ord")
    edges = back.edges.select(F.col("id").alias("vertex_id"), F.lit("edge").alias("key"), F.concat_ws(">", "src", "dst").alias("value"), F.lit("string").alias("type"), F.col("label").alias("cardinality"), F.lit(0).cast("long").alias("ord"))
    return rows.unionByName(edges)


# Order.


@query("WITH " + v_sql("nation", "customer") + " SELECT id, balance, row_number() OVER (ORDER BY balance NULLS FIRST, id) AS place FROM v ORDER BY place LIMIT 40")
def order_v_by_prop(spark, sf):
    rows = ordering.by_property(tables.vertices_of(spark, sf, ["nation", "customer"]), "balance").select("id", "balance").limit(40)
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("balance").asc_nulls_first(), "id")).cast("long"))


@query("WITH " + e_sql("contains", "placed") + " SELECT id, discount FROM e ORDER BY discount DESC NULLS LAST, id LIMIT 50")
def order_e_by_prop(spark, sf):
    return ordering.by_property(tables.edges_of(spark, sf, ["contains", "placed"]), "discount", ascending=False).select("id", "discount").limit(50)


@query(f"{V} SELECT DISTINCT size AS value FROM v WHERE size IS NOT NULL ORDER BY value")
def range_sorted_values(spark, sf):
    return indexing.sorted_values(commerce(spark, sf).vertices, "size")


@query(f"{V} SELECT min(size) AS least, max(size) AS greatest FROM v")
def range_min_max(spark, sf):
    return indexing.min_max(commerce(spark, sf).vertices, "size")


@query("WITH " + v_sql("part") + ", n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 300 AS batch FROM v) SELECT batch::BIGINT AS batch, count(*) AS elements, min(id) AS first, max(id) AS last FROM n GROUP BY batch")
def batches(spark, sf):
    return ordering.batches(tables.vertices_of(spark, sf, ["part"]), 300)


# Indexes.


@query(f"{V} SELECT id FROM v WHERE size IN (1, 5, 49)")
def index_in_list(spark, sf):
    return indexing.in_list(commerce(spark, sf).vertices, "size", [1, 5, 49]).select("id")


@query(f"{V} SELECT id FROM v WHERE brand = 'Brand#1' AND size = 5")
def composite_get(spark, sf):
    return indexing.composite(commerce(spark, sf).vertices, ["brand", "size"], ["Brand#1", 5]).select("id")


@query(f"{V} SELECT id FROM v WHERE status = 'O'")
def composite_partial(spark, sf):
    return indexing.composite(commerce(spark, sf).vertices, ["status", "priority"], ["O"]).select("id")


@query(f"{V} SELECT id, size FROM v WHERE size BETWEEN 10 AND 20")
def range_query(spark, sf):
    return indexing.in_range(commerce(spark, sf).vertices, "size", 10, 20).select("id", "size")


@query(f"{V} SELECT id FROM v WHERE total > 200000")
def range_gt(spark, sf):
    return indexing.greater(commerce(spark, sf).vertices, "total", 200000).select("id")


@query(f"{V} SELECT id FROM v WHERE balance < -500")
def range_lt(spark, sf):
    return indexing.less(commerce(spark, sf).vertices, "balance", -500).select("id")


@query(f"{V} SELECT count(*) AS elements FROM v WHERE size BETWEEN 3 AND 30")
def range_count(spark, sf):
    return indexing.range_count(commerce(spark, sf).vertices, "size", 3, 30)


@query("SELECT * FROM (VALUES ('single', 'age', 7::BIGINT), ('composite', 'city,name', 6::BIGINT)) r(kind, keys, times)")
def index_recommendations(spark, sf):
    a = indexing.Advisor(indexed=("name",))
    for keys, n in ((("age",), 7), (("name", "city"), 6), (("name",), 9), (("city",), 5)):
        for _ in range(n):
            a.saw(*keys)
    return spark.createDataFrame(a.recommendations(), "kind string, keys string, times long")


# Algorithms.

_BFS = "b(id, depth) AS (SELECT 'nation:0', 0 UNION SELECT u.dst, b.depth + 1 FROM b JOIN u ON b.id = u.src WHERE b.depth < 12), d AS (SELECT id, min(depth) AS depth FROM b GROUP BY id)"
_REACH = "r(src, dst) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"
_LINK = "k(a, b) AS (SELECT id, id FROM v UNION SELECT k.a, u.dst FROM k JOIN u ON k.b = u.src)"


@query(f"{T}, {_BFS} SELECT id, depth FROM d")
def bfs_depth(spark, sf):
    return traversal.bfs(tables.trade(spark, sf), "nation:0")


@query(
    "WITH RECURSIVE n AS (SELECT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey), one AS (SELECT DISTINCT p FROM n WHERE c = 1), "
    "two AS (SELECT DISTINCT n.c FROM n JOIN one USING (p) WHERE n.c <> 1), three AS (SELECT DISTINCT n.p FROM n JOIN two USING (c) WHERE n.p NOT IN (SELECT p FROM one)) "
    "SELECT 'customer:1' AS id, 0 AS depth UNION ALL SELECT 'part:' || p, 1 FROM one UNION ALL SELECT 'customer:' || c, 2 FROM two UNION ALL SELECT 'part:' || p, 3 FROM three"
)
def bfs_customers(spark, sf):
    """Three steps over who ordered what: a graph that grows with the tables."""
    return traversal.bounded_both(tables.purchases(spark, sf), "customer:1", 3)


@query(
    "WITH b AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey) "
    "SELECT 'customer:' || c AS id, 'customer:' || (SELECT min(c::VARCHAR) FROM b) AS component FROM b UNION SELECT 'part:' || p, 'customer:' || (SELECT min(c::VARCHAR) FROM b) FROM b"
)
def components_customers(spark, sf):
    """One component holds all who ordered; others aren't in this graph."""
    return components.connected(tables.purchases(spark, sf))


@query(f"{T}, {_BFS} SELECT id FROM d")
def dfs_reach(spark, sf):
    return traversal.dfs_order(tables.trade(spark, sf), "nation:0").select("id")


@query(f"{T}, {_BFS} SELECT id FROM d WHERE depth = 2")
def at_distance(spark, sf):
    return traversal.at_distance(tables.trade(spark, sf), "nation:0", 2)


@query(
    f"{T}, {_BFS}, far AS (SELECT id FROM d ORDER BY depth DESC, id LIMIT 1), up(id, depth, path) AS (SELECT d.id, d.depth, d.id FROM d JOIN far ON d.id = far.id UNION ALL "
    "SELECT s.id, up.depth - 1, s.id || '>' || up.path FROM up JOIN LATERAL (SELECT min(d.id) AS id FROM d JOIN u ON d.id = u.src WHERE u.dst = up.id AND d.depth = up.depth - 1) s ON true WHERE up.depth > 0) "
    "SELECT path, (length(path) - length(replace(path, '>', '')))::INTEGER AS hops FROM up WHERE depth = 0"
)
def shortest_path(spark, sf):
    g = tables.trade(spark, sf)
    far = traversal.bfs(g, "nation:0").orderBy(F.desc("depth"), "id").first()["id"]
    return traversal.path_frame(g, traversal.shortest_path(g, "nation:0", far))


@query(f"{G}, {_LINK} SELECT a AS id, min(b) AS component FROM k GROUP BY a")
def connected_components(spark, sf):
    return components.connected(tables.geo(spark, sf))


@query(f"{G}, {_LINK} SELECT count(DISTINCT c) <= 1 AS connected FROM (SELECT min(b) AS c FROM k GROUP BY a)")
def is_connected(spark, sf):
    return components.is_connected(tables.geo(spark, sf))


@query(f"{T}, {_LINK} SELECT (SELECT count(*) FROM e) > (SELECT count(*) FROM v) - (SELECT count(DISTINCT c) FROM (SELECT min(b) AS c FROM k GROUP BY a)) AS has_cycle")
def has_cycle(spark, sf):
    return components.has_cycle(tables.trade(spark, sf))


@query(f"{G}, {_LINK} SELECT (SELECT count(*) FROM e) > (SELECT count(*) FROM v) - (SELECT count(DISTINCT c) FROM (SELECT min(b) AS c FROM k GROUP BY a)) AS has_cycle")
def has_cycle_forest(spark, sf):
    return components.has_cycle(tables.geo(spark, sf))


@query(f"{T}, b(s, t, depth) AS (SELECT id, id, 0 FROM v UNION SELECT b.s, u.dst, b.depth + 1 FROM b JOIN u ON b.t = u.src WHERE b.depth < 12) SELECT CASE WHEN count(*) < (SELECT count(*) * count(*) FROM v) THEN -1 ELSE max(m) END::INTEGER AS diameter FROM (SELECT min(depth) AS m FROM b GROUP BY s, t)")
def diameter(spark, sf):
    return traversal.diameter(tables.trade(spark, sf))


@query(
    f"{T}, s(id, k, dist) AS (SELECT 'nation:0', 0, 0.0::DOUBLE UNION ALL SELECT e.dst, s.k + 1, min(s.dist + e.weight) FROM s JOIN e ON s.id = e.src WHERE s.k < 24 GROUP BY e.dst, s.k + 1) "
    "SELECT id, min(dist) AS distance FROM s GROUP BY id"
)
def dijkstra(spark, sf):
    return traversal.dijkstra(tables.trade(spark, sf), "nation:0").select("id", "distance")


@query("SELECT 'orders:' || o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INTEGER AS level FROM orders")
def topo_level(spark, sf):
    return structure.topological(tables.order_chain(spark, sf))


@query(f"{T}, {_REACH}, m AS (SELECT a.src AS id, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src UNION SELECT id, id FROM v) SELECT id, min(other) AS component FROM m GROUP BY id")
def scc(spark, sf):
    return structure.strong(tables.trade(spark, sf))


_MST = (
    f"{T}, w AS (SELECT id, src, dst, weight, row_number() OVER (ORDER BY weight, id) AS n FROM e WHERE src <> dst), "
    "x(n, a, b) AS (SELECT w.n, w.src, y.dst FROM w JOIN (SELECT n, src, dst FROM w UNION ALL SELECT n, dst, src FROM w) y ON y.n < w.n AND y.src = w.src "
    "UNION SELECT x.n, x.a, y.dst FROM x JOIN (SELECT n, src, dst FROM w UNION ALL SELECT n, dst, src FROM w) y ON y.n < x.n AND y.src = x.b), "
    "mst AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.n = w.n AND x.b = w.dst))"
)


@query(f"{_MST} SELECT id, weight FROM mst")
def mst_edges(spark, sf):
    return structure.spanning_forest(tables.trade(spark, sf)).select("id", "weight")


@query(f"{_MST} SELECT sum(weight)::DOUBLE AS weight FROM mst")
def mst_weight(spark, sf):
    return structure.spanning_forest(tables.trade(spark, sf)).agg(F.sum("weight").alias("weight"))


_CUT = (
    f"{T}, {_LINK}, c AS (SELECT a AS id, min(b) AS c FROM k GROUP BY a), "
    "q(x, a, b) AS (SELECT z.id, v.id, v.id FROM v z, v WHERE v.id <> z.id UNION SELECT q.x, q.a, u.dst FROM q JOIN u ON q.b = u.src WHERE u.dst <> q.x), "
    "after AS (SELECT x, count(DISTINCT m) AS n FROM (SELECT x, a, min(b) AS m FROM q GROUP BY x, a) GROUP BY x)"
)


@query("SELECT 'region:' || n_regionkey AS id FROM nation GROUP BY n_regionkey HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'nation:' || s_nationkey FROM supplier")
def articulation_points(spark, sf):
    """Of the forest of regions, nations and suppliers: every vertex with two neighbours."""
    return structure.articulation_points(tables.geo(spark, sf))


@query(f"{_CUT.replace(_TOP_TWO, _TOP_ONE)} SELECT after.x AS id FROM after WHERE after.n > (SELECT count(DISTINCT c.c) FROM c WHERE c.id <> after.x)")
def articulation_points_trade(spark, sf):
    return structure.articulation_points(tables.trade(spark, sf, 1))


_BRIDGE = (
    f"{T}, f AS (SELECT id, src, dst FROM e UNION ALL SELECT id, dst, src FROM e), q(x, a, b) AS (SELECT e.id, e.src, e.src FROM e UNION SELECT q.x, q.a, f.dst FROM q JOIN f ON q.b = f.src WHERE f.id <> q.x)"
)


@query(f"{_BRIDGE.replace(_TOP_TWO, _TOP_ONE)} SELECT e.id FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM q WHERE q.x = e.id AND q.b = e.dst)")
def bridges(spark, sf):
    """Of each nation's trade with its best customer only."""
    return structure.bridges(tables.trade(spark, sf, 1))


@query("SELECT e.id FROM (SELECT 'in_region:' || n_nationkey AS id FROM nation UNION ALL SELECT 'based_in:' || s_suppkey FROM supplier) e")
def bridges_forest(spark, sf):
    """Every edge of a forest is one."""
    return structure.bridges(tables.geo(spark, sf))


_COVER = "k(a, b, s) AS (SELECT id, id, 0 FROM v UNION SELECT k.a, u.dst, 1 - k.s FROM k JOIN u ON k.b = u.src)"


@query(f"{T}, {_COVER} SELECT NOT EXISTS (SELECT 1 FROM k WHERE a = b AND s = 1) AS bipartite")
def is_bipartite(spark, sf):
    return components.is_bipartite(tables.trade(spark, sf))


@query(f"{G}, {_COVER}, c AS (SELECT a AS id, min(b) AS component FROM k GROUP BY a) SELECT c.id, component, true AS bipartite, k.s AS color FROM c JOIN k ON k.a = c.component AND k.b = c.id")
def bipartite_color(spark, sf):
    return components.bipartite(tables.geo(spark, sf))


@query(f"{T}, r(id) AS (SELECT 'nation:0' UNION SELECT e.dst FROM r JOIN e ON r.id = e.src) SELECT id FROM r")
def reachable(spark, sf):
    return traversal.reachable(tables.trade(spark, sf), "nation:0")


@query(f"{T}, {_REACH} SELECT src, dst FROM r WHERE src <> dst")
def transitive_closure(spark, sf):
    return traversal.closure(tables.trade(spark, sf))


@query(f"{T}, b(id, depth) AS (SELECT * FROM (VALUES ('nation:0', 0), ('nation:7', 0)) s(id, depth) UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.id = e.src WHERE b.depth < 3) SELECT id, min(depth) AS depth FROM b GROUP BY id")
def bounded_traversal(spark, sf):
    return traversal.bounded(tables.trade(spark, sf), ["nation:0", "nation:7"], 3)


# Walks.


@query(f"{E}, v AS (SELECT 'part:' || p_partkey AS id, p_brand AS brand, p_size AS size FROM part) SELECT v.brand AS value, count(*) AS count FROM e a JOIN e b ON a.dst = b.src JOIN v ON b.dst = v.id WHERE a.label = 'placed' AND b.label = 'contains' AND v.size > 10 GROUP BY v.brand")
def walk_group_count(spark, sf):
    """Brands of larger parts in all orders, as often as ordered."""
    return walk(commerce(spark, sf)).V().has_label("customer").out("placed").out("contains").has("size", gt(10)).group_count("brand")


@query(f"{E}, b AS (SELECT DISTINCT src FROM e WHERE label = 'based_in') SELECT e.dst AS id FROM b JOIN e ON e.src = b.src AND e.label = 'based_in' UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE 'nation:' || n_nationkey NOT IN (SELECT dst FROM e WHERE label = 'based_in')")
def walk_choose(spark, sf):
    """Suppliers give their nations; nations without suppliers stay."""
    g = tables.geo(spark, sf)
    from_ = walk(g).V().has_label("supplier", "nation").choose(lambda w: w.has_label("supplier"), lambda w: w.out("based_in"), lambda w: w.not_(lambda x: x.in_("based_in")))
    return from_.ids()


@query(f"{T} SELECT c.dst AS id FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src = 'nation:0'")
def walk_repeat(spark, sf):
    return walk(tables.trade(spark, sf)).V("nation:0").repeat(lambda w: w.out(), 3).ids()


@query(f"{T} SELECT DISTINCT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = y.dst AND z.dst = x.src")
def walk_match(spark, sf):
    """Circles of three."""
    return walk(tables.trade(spark, sf)).match(("a", "out", "trades", "b"), ("b", "out", "trades", "c"), ("c", "out", "trades", "a"))


@query(f"{T} SELECT a.src || '>' || a.dst || '>' || b.dst AS path FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'nation:0'")
def walk_paths(spark, sf):
    return walk(tables.trade(spark, sf)).V("nation:0").out().out().paths().select(F.array_join("path", ">").alias("path"))


# Mutations.

_NEAR = f"{v_sql('region', 'nation', 'supplier')}, {e_sql('in_region', 'based_in')}"


@query(f"WITH {_NEAR} SELECT id FROM v WHERE id <> 'nation:3' UNION ALL SELECT id FROM e WHERE src <> 'nation:3' AND dst <> 'nation:3'")
def remove_vertex(spark, sf):
    g = tables.geo(spark, sf)
    g = mutate.remove_vertices(g, g.vertices.where("id = 'nation:3'"))
    return g.vertices.select("id").unionByName(g.edges.select("id"))


@query(f"WITH {_NEAR} SELECT id FROM e WHERE NOT starts_with(id, 'based_in:1')")
def remove_edge(spark, sf):
    g = tables.geo(spark, sf)
    return mutate.remove_edges(g, g.edges.where(F.col("id").startswith("based_in:1"))).edges.select("id")


@query(f"{E} SELECT id, dst AS src, src AS dst FROM e WHERE label = 'placed'")
def reverse_edges(spark, sf):
    return mutate.reversed_edges(scan.by_label(commerce(spark, sf).edges, "placed")).select("id", "src", "dst")


@query(f"{VP} SELECT vertex_id, ord, value FROM p WHERE key = 'priorities' UNION ALL SELECT id, (SELECT count(*) FROM p WHERE p.vertex_id = v.id AND key = 'priorities'), '0-NOW' FROM v WHERE segment = 'BUILDING'")
def set_property_list(spark, sf):
    """A value more at the end of a LIST."""
    g = mutate.set_property(people(spark, sf), F.col("segment") == "BUILDING", "priorities", "0-NOW", "LIST")
    return prop.values(g.vprops, "priorities")


@query(f"{V} SELECT id, CASE WHEN segment = 'BUILDING' THEN 'HOUSING' ELSE segment END AS segment FROM v WHERE label = 'customer'")
def update_property(spark, sf):
    """Column and property rows agree."""
    g = mutate.update_property(people(spark, sf), F.lit(True), "segment", "BUILDING", "HOUSING")
    rows = prop.first_value(g.vprops, "segment").select(F.col("vertex_id").alias("id"), F.col("value").alias("__row"))
    return g.vertices.join(rows, "id").where("segment = __row").select("id", "segment")


@query(f"{VP} SELECT vertex_id, ord FROM p WHERE key = 'priorities' AND value <> '1-URGENT'")
def remove_property_value(spark, sf):
    g = mutate.remove_property(people(spark, sf), "priorities", "1-URGENT")
    return prop.values(g.vprops, "priorities").select("vertex_id", "ord")


@query(f"{VP} SELECT vertex_id FROM p WHERE key = 'name'")
def remove_property_after_merge(spark, sf):
    """Customers merged with themselves get new ids; taking the names of the new ones away leaves the old ones'."""
    g = people(spark, sf)
    both = mutate.merge(g, g)
    return mutate.remove_property(both, "name", where=F.col("id").endswith("~1")).vprops.where("key = 'name'").select("vertex_id")


@query(f"WITH {v_sql('customer')} SELECT id FROM v WHERE balance < 0 UNION ALL SELECT 'refused' FROM v GROUP BY 1")
def merge_strict(spark, sf):
    """Refused with taken ids, carried out with others."""
    g = tables.commerce(spark, sf, ["customer"], ["placed"])
    debtors, rest = g.vertices.where("balance < 0"), g.vertices.where("NOT balance < 0")
    none = g.edges.limit(0)
    try:
        mutate.merge(PropertyGraph.of(debtors, none), PropertyGraph.of(debtors, none), "STRICT")
        said = []
    except DuplicateId:
        said = [("refused",)]
    joined = mutate.merge(PropertyGraph.of(rest, none), PropertyGraph.of(debtors, none), "STRICT").vertices.where("balance < 0").select("id")
    return joined.unionByName(spark.createDataFrame(said, "id string"))


def _other(spark: SparkSession) -> PropertyGraph:
    return PropertyGraph.literal(
        spark, [{"id": "nation:1", "label": "land", "name": "new name", "size": 3}, {"id": "nation:999", "label": "land", "name": "far"}], [{"id": "x", "src": "nation:1", "dst": "nation:999", "label": "borders"}]
    )


_MERGE = f"WITH {_NEAR}"


@query(f"{_MERGE} SELECT id, name FROM v UNION ALL SELECT 'nation:1~1', 'new name' UNION ALL SELECT 'nation:999', 'far' UNION ALL SELECT id, src || '>' || dst FROM e UNION ALL SELECT 'x', 'nation:1~1>nation:999'")
def merge_generate_new_id(spark, sf):
    return _listed(mutate.merge(tables.geo(spark, sf), _other(spark)))


@query(f"{_MERGE} SELECT id, CASE WHEN id = 'nation:1' THEN 'new name' ELSE name END AS name FROM v UNION ALL SELECT 'nation:999', 'far' UNION ALL SELECT id, src || '>' || dst FROM e UNION ALL SELECT 'x', 'nation:1>nation:999'")
def merge_properties(spark, sf):
    return _listed(mutate.merge(tables.geo(spark, sf), _other(spark), "MERGE_PROPERTIES"))


@query(
    f"{_MERGE} SELECT id, name FROM v WHERE id <> 'nation:1' UNION ALL SELECT 'nation:1', 'new name' UNION ALL SELECT 'nation:999', 'far' "
    "UNION ALL SELECT id, src || '>' || dst FROM e WHERE src <> 'nation:1' AND dst <> 'nation:1' UNION ALL SELECT 'x', 'nation:1>nation:999'"
)
def merge_replace(spark, sf):
    return _listed(mutate.merge(tables.geo(spark, sf), _other(spark), "REPLACE_ELEMENT"))


def _listed(g: PropertyGraph) -> DataFrame:
    return g.vertices.select("id", "name").unionByName(g.edges.select("id", F.concat_ws(">", "src", "dst").alias("name")))


# Streams.


@query("SELECT event_type AS target, count(*) AS degree FROM events GROUP BY event_type")
def stream_degrees(spark, sf):
    """In-degrees of event types in the graph of users and what they do, kept up by a stream."""
    return streams.in_degrees(spark, sf)
