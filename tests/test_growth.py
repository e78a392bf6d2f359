"""Steps whose cost once grew faster than their input, against plain Python."""

import random
from itertools import combinations

from graphloom.model import PropertyGraph
from graphloom.operators import adjacency, components, structure, traversal


def graph(spark, edges, vertices=()):
    v = sorted({str(x) for e in edges for x in e[:2]} | {str(x) for x in vertices})
    return PropertyGraph.literal(spark, [{"id": x} for x in v], [{"id": f"e{k}", "src": a, "dst": b} for k, (a, b) in enumerate(edges)])


def test_pairs_with_shared_targets_are_not_grouped(spark, monkeypatch):
    r = random.Random(3)
    edges = [(f"s{k}", "hub") for k in range(30)] + [(f"s{k}", f"t{r.randrange(3)}") for k in range(20, 40) for _ in range(2)] + [(f"s{k}", "far") for k in range(5)] + [("hub", "hub"), ("s1", "hub")]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    want = sorted((a, b, len(near[a] & near[b])) for a, b in combinations(sorted(near), 2) if near[a] & near[b])
    g = graph(spark, edges)
    plan = adjacency.co_neighbours(g)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(idsb" in plan and plan.index("explode(idsb") < plan.index("Aggregate")
    for size in (1024, 4):
        monkeypatch.setattr(adjacency, "BLOCK", size)
        assert sorted(tuple(x) for x in adjacency.co_neighbours(g).collect()) == want
    assert adjacency.co_neighbours(g, "none").collect() == []


def test_layers_of_chains_take_few_rounds(spark, monkeypatch):
    times = []
    cut = structure.cut
    monkeypatch.setattr(structure, "cut", lambda df: times.append(1) or cut(df))
    chain = structure.topological(graph(spark, [(k, k + 1) for k in range(40)]))
    assert {x["id"]: x["level"] for x in chain.collect()} == {str(k): k for k in range(41)} and len(times) < 20
    assert dict(chain.dtypes)["level"] == "int"


def test_layers_of_random_graphs(spark):
    r = random.Random(5)
    for n, m in ((12, 14), (14, 11)):
        edges = [tuple(sorted(r.sample(range(n), 2))) for _ in range(m)] + [(0, n), (n, n + 1), (n + 1, n + 2), (0, n)]
        level = dict.fromkeys(range(n + 3), 0)
        for _ in range(n + 3):
            for a, b in edges:
                level[b] = max(level[b], level[a] + 1)
        g = graph(spark, edges, range(n + 3))
        assert {x["id"]: x["level"] for x in structure.topological(g).collect()} == {str(k): x for k, x in level.items()}
        assert structure.topological(graph(spark, [*edges, (n + 2, n)])) is None and structure.topological(graph(spark, [*edges, (n + 2, n + 2)])) is None
        back = dict.fromkeys(range(n + 3), 0)
        for _ in range(n + 3):
            for a, b in edges:
                back[a] = max(back[a], back[b] + 1)
        assert {x["id"]: x["level"] for x in structure.topological(g, "IN").collect()} == {str(k): x for k, x in back.items()}
    assert structure.topological(graph(spark, [(0, 1)]), "BOTH") is None and structure.topological(graph(spark, [], [7])).collect()[0]["level"] == 0
    assert structure.topological(PropertyGraph.empty(spark)).collect() == []


def test_components_read_dense_graphs_once(spark, monkeypatch):
    r = random.Random(7)
    rows = []
    least = components._least
    monkeypatch.setattr(components, "_least", lambda e: rows.append(e.count()) or least(e))
    edges = [(f"a{x}", f"a{y}") for x, y in combinations(range(30), 2)] + [("b1", "b2"), ("b2", "b2"), ("a29", "b9"), ("b9", "c0")] + [(f"c{k}", f"c{k + 1}") for k in range(9)]
    found = {x["id"]: x["component"] for x in components.connected(graph(spark, edges, ["d"])).collect()}
    assert found == {v: "b1" if v in ("b1", "b2") else "d" if v == "d" else "a0" for v in found} and len(found) == 44
    assert max(rows) < 250  # both ways, of 448 edges
    monkeypatch.undo()
    edges = [(str(r.randrange(30)), str(r.randrange(30))) for _ in range(22)]
    parts = {str(k): str(k) for k in range(30)}
    for _ in range(30):
        for a, b in edges:
            parts[a] = parts[b] = min(parts[a], parts[b])
    assert {x["id"]: x["component"] for x in components.connected(graph(spark, edges, range(30))).collect()} == parts


def test_levels_do_not_group_all_edges(spark, monkeypatch):
    plans = []
    cut = traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    g = graph(spark, [(1, 2), (1, 2), (2, 1), (3, 1), (3, 3), (3, 4)], [5])
    found = lambda d: sorted((x["id"], x["depth"], x["parent"]) for x in traversal.levels(g, g.vertices.where("id = '1'"), d).collect())
    assert found("BOTH") == [("1", 0, None), ("2", 1, "1"), ("3", 1, "1"), ("4", 2, "3")] and "Aggregate" not in plans[0]
    assert found("OUT") == [("1", 0, None), ("2", 1, "1")] and found("in") == [("1", 0, None), ("2", 1, "1"), ("3", 1, "1")]
