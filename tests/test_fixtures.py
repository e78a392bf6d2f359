"""The operators on small graphs whose answers are known."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.model import Cardinality, Direction, DuplicateId, GraphError, InvalidProperty, MissingElement, PropertyGraph
from graphloom.operators import adjacency, components, criteria, indexing, mutate, ordering, properties, scan, structure, traversal
from graphloom.operators.criteria import all_of, any_of, between, contains, contains_element, exact, exists, negated, not_exists, query_properties, query_vertices, regex
from graphloom.variables import Variables


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def modern(spark):
    names = [(1, "marko", 29, None), (2, "vadas", 27, None), (3, "lop", None, "java"), (4, "josh", 32, None), (5, "ripple", None, "java"), (6, "peter", 35, None)]
    edges = [(1, "knows", 2, 0.5), (1, "knows", 4, 1.0), (1, "created", 3, 0.4), (4, "created", 5, 1.0), (4, "created", 3, 0.4), (6, "created", 3, 0.2)]
    return PropertyGraph.literal(spark, [{"id": i, "name": n, "age": a, "lang": x} for i, n, a, x in names], [{"src": s, "dst": d, "label": x, "weight": w} for s, x, d, w in edges])


@pytest.fixture(scope="module")
def people(spark):
    return PropertyGraph.literal(
        spark,
        [
            {"id": "alice", "name": "Alice", "type": "person", "age": 25, "skill": ["Java", "Kotlin"], "email": ("alice@example.com", {"verified": True, "type": "primary"})},
            {"id": "bob", "name": "Bob", "type": "person", "age": 30, "skill": ["Python", "JavaScript"], "email": ("bob@example.com", {"verified": False, "type": "primary"})},
            {"id": "charlie", "name": "Charlie", "type": "person", "age": 35, "skill": ["C++", "Rust"]},
            {"id": "acme", "name": "ACME Corp", "type": "company", "employees": 500, "industry": "Technology"},
            {"id": "globodyne", "name": "Globodyne", "type": "company", "employees": 150, "industry": "Consulting"},
        ],
    )


def graph(spark, edges, vertices=()):
    v = sorted({str(x) for e in edges for x in e[:2]} | {str(x) for x in vertices})
    rows = [{"id": f"e{k}", "src": e[0], "dst": e[1], **({"weight": float(e[2])} if len(e) > 2 else {})} for k, e in enumerate(edges)]
    return PropertyGraph.literal(spark, [{"id": x} for x in v], rows)


@pytest.mark.parametrize(
    "test,want",
    [
        (exact("type", "person"), {"alice", "bob", "charlie"}), (exists("industry"), {"acme", "globodyne"}), (not_exists("industry"), {"alice", "bob", "charlie"}),
        (between("age", 25, 30, True, True), {"alice", "bob"}), (between("age", 25, 35, False, False), {"bob"}), (between("employees", 200, None), {"acme"}), (between("employees", None, 200), {"globodyne"}),
        (between("age"), set()), (contains("name", "e"), {"alice", "charlie", "globodyne"}), (contains("name", "ACME".lower(), True), {"acme"}), (regex("name", "^[A-C].*"), {"acme", "alice", "bob", "charlie"}),
        (regex("name", "[A-C]"), set()), (all_of(exact("type", "person"), between("age", 30, None)), {"bob", "charlie"}), (any_of(exact("name", "Alice"), exact("name", "ACME Corp")), {"acme", "alice"}),
        (negated(exact("type", "person")), {"acme", "globodyne"}), (exact("age", "30"), {"bob"}), (exact("age", 30.0), {"bob"}), (exact("age", True), set()), (exact("age", None), {"acme", "globodyne"}),
        (exact("age", "thirty"), set()),
    ],
)
def test_criteria(people, test, want):
    assert set(ids(query_vertices(people, test))) == want
    only_rows = people.replace(vertices=people.vertices.select("id", "label"))
    assert set(ids(query_vertices(only_rows, test))) == want


def test_multiple_values(people):
    unknown = people.replace(vprops=people.vprops)
    assert people.multi == {"skill"} and unknown.multi is None
    for g in (people, unknown, people.replace(vertices=people.vertices.drop("skill"))):
        assert ids(query_vertices(g, exact("skill", "Kotlin"))) == ["alice"]
        assert ids(query_vertices(g, contains_element("skill", "Rust"))) == ["charlie"]
        assert ids(query_vertices(g, exact("skill", None))) == ids(query_vertices(g, not_exists("skill"))) == ["acme", "globodyne"]
        assert ids(query_vertices(g, negated(exact("skill", "Kotlin")), exact("type", "person"))) == ["bob", "charlie"]
    assert ids(criteria.query_by_meta(people, "email", "verified", "true")) == ["alice"]
    assert ids(criteria.query_by_meta(people, "email", "verified")) == ["alice", "bob"]
    assert ids(criteria.query_by_cardinality(people, "skill", "LIST")) == ["alice", "bob", "charlie"]
    assert ids(criteria.query_by_cardinality(people, "skill", Cardinality.SINGLE)) == ["acme", "globodyne"]
    assert ids(query_properties(people.vprops, exact("skill", "Java"), between("age")), "value") == ["25", "30", "35", "Java"]


def test_aggregates(people):
    one = lambda key, *names: tuple(properties.aggregate(people.vprops, key, *names).first())
    assert one("age", "count", "min", "max", "sum") == (3, 25.0, 35.0, 90.0)
    assert one("type", "distinct") == (2,) and one("employees", "avg") == (325.0,)
    assert one("name", "min", "sum", "avg", "count") == (0.0, 0.0, 0.0, 5) and one("nothing", "count", "avg", "variance") == (0, 0.0, 0.0)
    assert one("age", "variance") == (25.0,)
    stats = {r["key"]: r for r in properties.statistics(people).collect()}
    assert [(stats[k]["properties"], stats[k]["vertices"]) for k in ("type", "age", "skill")] == [(5, 5), (3, 3), (6, 3)]
    assert stats["email"]["has_meta"] and not stats["age"]["has_meta"] and (stats["skill"]["single"], stats["skill"]["list"]) == (2, 3)
    assert tuple(properties.column_aggregate(people.vertices, "age", "count", "avg").first()) == (3, 30.0)


def test_coercion_of_booleans(spark):
    g = PropertyGraph.literal(spark, [{"id": 1, "flag": "Yes", "on": True}, {"id": 2, "flag": "0", "on": False}, {"id": 3, "flag": "other"}])
    for h in (g, g.replace(vertices=g.vertices.select("id", "label"))):
        assert ids(query_vertices(h, exact("flag", True))) == ["1"] and ids(query_vertices(h, exact("flag", False))) == ["2"]
        assert ids(query_vertices(h, exact("on", "yes"))) == ["1"] and ids(query_vertices(h, exact("flag", 0))) == ["2"]


def test_adjacency(spark, modern):
    start = modern.vertices.where("id in ('1', '4')")
    pairs = lambda d, *labels: sorted((r["source"], r["target"]) for r in adjacency.neighbours(modern, start, d, *labels).collect())
    assert pairs("OUT") == [("1", "2"), ("1", "3"), ("1", "4"), ("4", "3"), ("4", "5")]
    assert pairs("IN") == [("4", "1")] and pairs("OUT", "knows") == [("1", "2"), ("1", "4")]
    loops = graph(spark, [(1, 1), (1, 2), (1, 2), (2, 1)])
    one = loops.vertices.where("id = '1'")
    assert adjacency.incident_edges(loops, one, "BOTH").count() == 4 and scan.incident(loops, "1").count() == 4
    assert {r["id"]: r["degree"] for r in adjacency.degrees(loops, "BOTH").collect()} == {"1": 5, "2": 3}
    assert {r["id"]: r["neighbours"] for r in adjacency.distinct_degrees(loops, "BOTH").collect()} == {"1": 2, "2": 1}
    friends = adjacency.two_hop(modern, modern.vertices.where("id = '1'"), (Direction.OUT, "knows"), (Direction.OUT, "created"))
    assert ids(friends, "target") == ["3", "5"]
    assert sorted(tuple(r) for r in adjacency.co_neighbours(modern, "created").collect()) == [("1", "4", 1), ("1", "6", 1), ("4", "6", 1)]
    other = modern.edges.where("id = 'e0'").select(adjacency.other_end("1").alias("a"), adjacency.other_end("9").alias("b"), adjacency.direction_from("2").alias("c"), adjacency.connects("2", "1").alias("d")).first()
    assert tuple(other) == ("2", None, "IN", True)


def test_scans(modern):
    assert ids(scan.by_ids(modern.vertices, ["2", "2", "x"])) == ["2", "2"] and scan.by_ids(modern.vertices, []).count() == 0
    assert ids(scan.by_properties(modern.vertices, {"lang": "java", "age": None})) == ["3", "5"] and scan.by_properties(modern.vertices, {}).count() == 6
    assert scan.by_property(modern.vertices, "nothing", 1).count() == 0
    assert ids(scan.between(modern, "1", "2")) == ["e0"] and scan.between(modern, "1", "2", "created").count() == 0
    assert scan.first_by_name(modern, "josh").first()["id"] == "4"
    assert [r["id"] for r in ordering.by_property(modern.vertices, "age").collect()] == ["3", "5", "2", "1", "4", "6"]


@pytest.mark.parametrize("edges,want", [([(1, 2), (1, 3), (2, 4), (2, 5), (3, 6)], {"1": 0, "2": 1, "3": 1, "4": 2, "5": 2, "6": 2})])
def test_bfs(spark, edges, want):
    g = graph(spark, edges)
    assert {r["id"]: r["depth"] for r in traversal.bfs(g, "1").collect()} == want
    assert ids(traversal.at_distance(g, "1", 2)) == ["4", "5", "6"] and ids(traversal.at_distance(g, "1", 0)) == ["1"] and ids(traversal.at_distance(g, "1", -1)) == []
    assert ids(traversal.dfs_order(g, "1")) == sorted(want)
    with pytest.raises(MissingElement):
        traversal.dfs_order(g, "x")


def test_paths(spark):
    diamond = graph(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (5, 6)])
    assert traversal.shortest_path(diamond, "1", "4") == ["1", "2", "4"] and traversal.shortest_path(diamond, "1", "1") == ["1"] and traversal.shortest_path(diamond, "1", "6") is None
    weighted = graph(spark, [(1, 2, 1), (1, 3, 4), (2, 4, 2), (3, 4, 1)])
    assert traversal.weighted_path(weighted, "1", "4") == (["1", "2", "4"], 3.0) and traversal.weighted_path(weighted, "4", "1") is None and traversal.weighted_path(weighted, "1", "1") == (["1"], 0.0)
    with pytest.raises(GraphError):
        traversal.dijkstra(graph(spark, [(1, 2, -1)]), "1")
    assert [traversal.diameter(g).first()[0] for g in (graph(spark, [(1, 2), (2, 3), (3, 4)]), graph(spark, [(0, 1), (0, 2), (0, 3), (0, 4)]), diamond, graph(spark, [], [1]))] == [3, 2, -1, 0]


def test_components_and_cycles(spark):
    g = graph(spark, [(1, 2), (3, 4)], [5])
    assert {r["id"]: r["component"] for r in components.connected(g).collect()} == {"1": "1", "2": "1", "3": "3", "4": "3", "5": "5"}
    assert not components.is_connected(g).first()[0] and components.is_connected(PropertyGraph.empty(spark)).first()[0]
    cyclic = lambda *e: components.has_cycle(graph(spark, e)).first()[0]
    assert cyclic((1, 1)) and cyclic((1, 2), (2, 1)) and cyclic((1, 2), (2, 3), (3, 1)) and not cyclic((1, 2), (2, 3))
    assert not components.is_bipartite(graph(spark, [(1, 2), (2, 3), (3, 1)])).first()[0] and components.is_bipartite(graph(spark, [(1, 2), (2, 3), (3, 4), (4, 1)])).first()[0]
    assert not components.is_bipartite(graph(spark, [(1, 1)])).first()[0]


def test_structure(spark):
    level = lambda *e: structure.topological(graph(spark, e))
    assert {r["id"]: r["level"] for r in level((1, 2), (1, 3), (2, 4), (3, 4)).collect()} == {"1": 0, "2": 1, "3": 1, "4": 2}
    assert level((1, 2), (2, 3), (3, 1)) is None
    assert {r["id"]: r["component"] for r in structure.strong(graph(spark, [(1, 2), (2, 3), (3, 2), (2, 4)])).collect()} == {"1": "1", "2": "2", "3": "2", "4": "4"}
    assert sorted(r["weight"] for r in structure.spanning_forest(graph(spark, [(1, 2, 1), (1, 3, 4), (2, 3, 2), (2, 4, 5), (3, 4, 3)])).collect()) == [1, 2, 3]
    assert ids(structure.articulation_points(graph(spark, [(0, 1), (0, 2), (0, 3)]))) == ["0"]
    assert ids(structure.bridges(graph(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5)]))) == ["e2", "e3", "e4"]
    assert len(traversal.closure(graph(spark, [(1, 2), (2, 3), (3, 1)])).collect()) == 6


def test_random_graphs_against_plain_python(spark):
    r = random.Random(9)
    for _ in range(2):
        n = r.randint(4, 8)
        edges = [(r.randrange(n), r.randrange(n), r.randint(1, 5)) for _ in range(r.randint(3, 11))]
        g = graph(spark, edges, range(n))
        near = {v: set() for v in range(n)}
        for a, b, _ in edges:
            near[a].add(b)
            near[b].add(a)

        def reach(start, without_vertex=None, skip=None):
            seen, todo = {start}, [start]
            while todo:
                v = todo.pop()
                for k, (a, b, _) in enumerate(edges):
                    for x, y in ((a, b), (b, a)):
                        if x == v and k != skip and y not in seen and y != without_vertex:
                            seen.add(y)
                            todo.append(y)
            return seen

        def pieces(without_vertex=None, skip=None):
            return len({min(reach(v, without_vertex, skip)) for v in range(n) if v != without_vertex})

        assert {r["id"]: r["component"] for r in components.connected(g).collect()} == {str(v): str(min(reach(v))) for v in range(n)}
        low = structure.low_links(g).collect()
        assert sorted(x["id"] for x in low if x["kind"] == "bridge") == sorted(f"e{k}" for k in range(len(edges)) if pieces(skip=k) > pieces())
        assert {x["id"] for x in low if x["kind"] == "vertex"} == {str(v) for v in range(n) if pieces(v) > len({frozenset(reach(u)) for u in range(n) if u != v})}
        best = {0: 0.0}
        for _ in range(n):
            for a, b, w in edges:
                if a in best:
                    best[b] = min(best.get(b, 1e9), best[a] + w)
        assert {x["id"]: x["distance"] for x in traversal.dijkstra(g, "0").collect()} == {str(k): v for k, v in best.items()}
        into = {v: {v} for v in range(n)}
        for _ in range(n):
            for a, b, _ in edges:
                into[b] |= into[a]
        assert {x["id"]: x["component"] for x in structure.strong(g).collect()} == {str(v): str(min(u for u in range(n) if u in into[v] and v in into[u])) for v in range(n)}
        parts = {v: v for v in range(n)}

        def find(v):
            while parts[v] != v:
                v = parts[v]
            return v

        total = 0
        for a, b, w in sorted(edges, key=lambda e: e[2]):
            if find(a) != find(b):
                parts[find(a)] = find(b)
                total += w
        assert sum(x["weight"] for x in structure.spanning_forest(g).collect()) == total


def test_mutations(spark, modern):
    g = mutate.remove_vertices(modern, modern.vertices.where("id = '1'"))
    assert g.vertices.count() == 5 and ids(g.edges) == ["e3", "e4", "e5"] and g.vprops.where("vertex_id = '1'").isEmpty()
    more = PropertyGraph.literal(spark, [{"id": 1, "label": "person", "name": "Alice Updated", "city": "New York"}], [])
    with pytest.raises(DuplicateId):
        mutate.add_vertices(modern, more.vertices)
    with pytest.raises(DuplicateId):
        mutate.merge(modern, more, "STRICT")
    with pytest.raises(MissingElement):
        mutate.add_edges(modern, graph(spark, [(1, 99)]).edges.withColumn("id", F.lit("new")))
    assert mutate.merge(modern, more).vertices.count() == 7
    both = mutate.merge(modern, more, "MERGE_PROPERTIES")
    row = both.vertices.where("id = '1'").first()
    assert (row["label"], row["name"], row["age"], row["city"]) == ("vertex", "Alice Updated", 29, "New York") and both.edges.count() == 6
    swapped = mutate.merge(modern, more, "REPLACE_ELEMENT")
    assert swapped.vertices.count() == 6 and swapped.edges.count() == 3
    h = mutate.set_property(modern, F.col("id") == "1", "age", 30)
    assert h.vertices.where("age = 30").count() == 1 and h.vprops.where("key = 'age' and value = '30'").count() == 1 and h.vprops.where("key = 'age'").count() == 4
    h = mutate.set_property(mutate.set_property(modern, F.col("id") == "1", "tag", "a", "LIST"), F.col("id") == "1", "tag", "a", "LIST", {"by": "x"})
    assert [tuple(r) for r in properties.values(h.vprops, "tag").orderBy("ord").collect()] == [("1", 0, "a"), ("1", 1, "a")]
    assert properties.meta_values(h.vprops).count() == 1
    with pytest.raises(InvalidProperty):
        mutate.set_property(h, F.col("id") == "1", "tag", "a", "SET")
    with pytest.raises(InvalidProperty):
        mutate.set_property(h, F.col("id") == "1", "id", 3)
    assert mutate.remove_property(h, "tag").vprops.where("key = 'tag'").isEmpty() and mutate.remove_property(modern, "age", 29).vertices.where("age is null").count() == 3
    assert mutate.update_property(modern, F.col("id") == "1", "age", 29, 31).vprops.where("value = '31'").count() == 1


def test_changes_show_in_criteria(spark, modern):
    one = F.col("id") == "1"
    older = mutate.update_property(modern, one, "age", 29, 31)
    assert ids(query_vertices(older, exact("age", 31))) == ["1"] and ids(query_vertices(older, exact("age", 29))) == []
    text = mutate.update_property(modern, one, "age", 29, "old")
    assert ids(query_vertices(text, exact("age", "old"))) == ["1"] and ids(query_vertices(text, exact("age", 27))) == ["2"]
    half = mutate.set_property(modern, one, "age", 29.5)
    assert ids(query_vertices(half, exact("age", 29.5))) == ["1"]
    g = mutate.set_property(modern, one, "age", 40, "LIST")
    assert ids(query_vertices(g, exact("age", 40))) == ["1"] and ids(query_vertices(g, exact("age", 29))) == ["1"]
    g = mutate.remove_property(g, "age", 29)
    assert ids(query_vertices(g, exact("age", 29))) == [] and g.vertices.where("age = 40").count() == 1
    assert ids(query_vertices(modern, between("age", "x", 40))) == [] and ids(query_vertices(modern, between("age", "20", "28"))) == ["2"]
    assert ids(query_vertices(modern, regex("name", "jo("))) == [] and ids(query_vertices(modern.replace(vertices=modern.vertices.select("id", "label")), regex("name", "jo("))) == []
    both = mutate.merge(modern, modern)
    assert both.vprops.groupBy("prop_id").count().where("count > 1").isEmpty()
    left = mutate.remove_property(both, "name", where=F.col("id").endswith("~1"))
    assert left.vprops.where("key = 'name'").count() == 6 and ids(left.vprops.where("key = 'name'"), "vertex_id") == ["1", "2", "3", "4", "5", "6"]


def test_finding_and_copying_properties(people):
    skills = mutate.find_properties(people, "skill", "Kotlin")
    assert ids(skills, "vertex_id") == ["alice"] and ids(mutate.find_properties(people, id=skills.first()["prop_id"]), "value") == ["Kotlin"]
    assert mutate.find_properties(people, "email", has_meta=True).count() == 2 and mutate.find_properties(people, "email", has_meta=False).count() == people.vprops.where("key = 'email'").count() - 2
    n = people.vprops.where("vertex_id = 'alice' and key = 'email'").count()
    g = mutate.copied_properties(people, "alice", "acme", "email", "skill")
    assert properties.meta_values(g.vprops.where("vertex_id = 'acme'")).count() >= 1 and g.vprops.where("vertex_id = 'acme' and key = 'email'").count() == n
    twice = mutate.copied_properties(g, "alice", "acme", "skill").vprops.where("vertex_id = 'acme' and key = 'skill'")
    assert twice.count() == 2 * people.vprops.where("vertex_id = 'alice' and key = 'skill'").count() == twice.select("prop_id").distinct().count()


def test_indexes(spark):
    rows = [("Alice", 25, "New York", 75000, "Engineering"), ("Bob", 30, "San Francisco", 95000, "Engineering"), ("Charlie", 35, "New York", 85000, "Marketing"), ("Diana", 28, "Chicago", 70000, "Marketing"), ("Eve", 32, "San Francisco", 105000, "Engineering")]
    v = PropertyGraph.literal(spark, [dict(zip(("id", "age", "city", "salary", "department"), r, strict=True)) for r in rows]).vertices
    assert ids(indexing.composite(v, ["department", "city"], ["Engineering", "San Francisco"])) == ["Bob", "Eve"] and ids(indexing.composite(v, ["department", "city", "age"], ["Marketing"])) == ["Charlie", "Diana"]
    assert ids(indexing.in_range(v, "age", 28, 32)) == ["Bob", "Diana", "Eve"] and ids(indexing.greater(v, "salary", 95000)) == ["Eve"] and ids(indexing.in_range(v, "age", "x")) == []
    with pytest.raises(InvalidProperty):
        indexing.composite(v, ["city"], ["x"])
    assert indexing.best_composite([["a", "b"], ["a", "b", "c"], ["d", "e"]], {"a", "b", "c"}) == ["a", "b", "c"]
    assert [tuple(r) for r in indexing.statistics(v, "city").collect()] == [("city", 3, 5, 5 / 3)]
    assert ordering.batches(v, 2).count() == 3 and [r["elements"] for r in ordering.batches(v, 2).orderBy("batch").collect()] == [2, 2, 1]


def test_property_rows_by_condition(people):
    assert properties.properties(people.vprops, cardinality="list").count() == 6 and properties.properties(people.vprops, "email", has_meta=True).count() == 2
    assert ids(properties.properties(people.vprops, "age", where=F.col("value") > "28"), "value") == ["30", "35"]
    counts = {r["id"]: r["properties"] for r in properties.property_counts(people, "skill").collect()}
    assert sum(counts.values()) == 6 and counts["acme"] == 0
    assert "skill" in {r["vertex_id"]: r["keys"] for r in properties.keys(people.vprops).collect()}["alice"]


def test_parallel_edges(spark):
    g = graph(spark, [(1, 2), (1, 2), (2, 1), (3, 3)])
    assert [tuple(r) for r in adjacency.parallel_edges(g.edges).collect()] == [("e0", "e1")]
    assert sorted(tuple(r) for r in adjacency.parallel_edges(g.edges, opposite=True).collect()) == [("e0", "e2"), ("e1", "e2")]


def test_vector_arithmetic(spark):
    d = spark.createDataFrame([([1.0, 3.0], [2.0, 4.0], 1.0, 2.0)], "a array<double>, b array<double>, x double, y double")
    row = d.select(vector.above(F.col("a"), 2.0, True), vector.fused(F.col("a"), F.col("b"), 0.5, True), vector.above(F.col("x"), 2.0), vector.fused(F.col("x"), F.col("y"), 3.0)).first()
    assert tuple(row) == ([False, True], [2.0, 5.0], False, 7.0)


def test_variables():
    v = Variables({"a.x": 1, "b": 2})
    assert v.set("c", 3)["c"] == 3 and "c" not in v and v.set_if_absent("b", 9)["b"] == 2 and v.compute_if_absent("n", len)["n"] == 1
    assert v.replace("z", 1) is v and v.replace("b", 5)["b"] == 5 and v.compare_and_set("b", 2, 7)[0]["b"] == 7 and v.compare_and_set("b", 1, 7) == (v, False)
    assert v.merge("b", 3, int.__add__)["b"] == 5 and v.merge("n", 3, int.__add__)["n"] == 3 and "b" not in v.merge("b", 0, lambda a, b: None)
    assert dict(v.with_prefix("a.")) == {"a.x": 1} and dict(v.without_prefix("a.")) == {"b": 2} and v.get("q", 4) == 4 and dict(v.update({"b": 0}).remove("a.x")) == {"b": 0}
    with pytest.raises(InvalidProperty):
        v.set(" ", 1)


def test_kept_indexes(spark, modern, tmp_path):
    i = indexing.Indexes(spark, f"{tmp_path}/i")
    assert i.list("vertex") == [] and ids(i.get(modern.vertices, "vertex", age=29)) == ["1"]
    i.create(modern.vertices, "vertex", "age")
    i.create(modern.vertices, "vertex", "lang", "name")
    assert i.list("vertex") == [("age",), ("lang", "name")] and i.list("edge") == []
    for _ in range(6):
        i.get(modern.vertices, "vertex", lang="java")
    assert ids(i.get(modern.vertices, "vertex", lang="java", name="lop")) == ["3"] and ids(i.get(modern.vertices, "vertex", age=32)) == ["4"]
    assert i.report("vertex")["recommended"] == [("single", "lang", 6)]
    assert i.drop("vertex", "age") and not i.drop("vertex", "age") and i.list("vertex") == [("lang", "name")]
    with pytest.raises(InvalidProperty):
        i.create(modern.vertices, "vertex", "nothing")


def test_listeners(modern):
    told = []
    m = mutate.Manager(modern, lambda *what: told.append(what))
    m.add(F.col("id") == "1", "city", "x").update(F.col("id") == "1", "city", "x", "y").remove("city", "y")
    assert told == [("add", "city", None, "x"), ("update", "city", "x", "y"), ("remove", "city", "y", None)] and m.g.vprops.where("key = 'city'").isEmpty()
    assert mutate.key_values("id", 1, "a", 2) == {"id": 1, "a": 2}
    for wrong in (("a",), (1, 2), ("a", None)):
        with pytest.raises(InvalidProperty):
            mutate.key_values(*wrong)
