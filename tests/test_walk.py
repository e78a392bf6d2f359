"""Walks over a small graph whose answers are known."""

import pytest

from graphloom.model import GraphError, PropertyGraph
from graphloom.walk import between, eq, gt, gte, lt, lte, neq, search, walk, within, without


@pytest.fixture(scope="module")
def g(spark):
    names = [(1, "marko", 29, None), (2, "vadas", 27, None), (3, "lop", None, "java"), (4, "josh", 32, None), (5, "ripple", None, "java"), (6, "peter", 35, None)]
    edges = [(1, "knows", 2, 0.5), (1, "knows", 4, 1.0), (1, "created", 3, 0.4), (4, "created", 5, 1.0), (4, "created", 3, 0.4), (6, "created", 3, 0.2)]
    vertices = [{"id": i, "label": "software" if x else "person", "name": n, "age": a, "lang": x, "tag": ["x", n[0]]} for i, n, a, x in names]
    return PropertyGraph.literal(spark, vertices, [{"src": s, "dst": d, "label": x, "weight": w} for s, x, d, w in edges])


def at(w):
    return sorted(r["id"] for r in w.ids().collect())


def test_filters(g):
    v = walk(g).V()
    assert at(v) == list("123456") and at(walk(g).V("1", "1", "x")) == ["1", "1"] and at(walk(g).E("e0")) == ["e0"]
    for test, want in ((eq(29), "1"), (neq(29), "246"), (gt(29), "46"), (gte(29), "146"), (lt(29), "2"), (lte(29), "12"), (between(27, 32), "12"), (within(27, 35), "26"), (without(27, 35), "14"), (29, "1"), ("29", "1"), (None, "1246")):
        assert at(v.has("age", test)) == list(want), want
    assert at(v.has("tag", "m")) == ["1"] and at(v.has("tag", within("m", "v"))) == ["1", "2"] and at(v.has("nothing")) == []
    assert at(v.has_label("software")) == ["3", "5"] and at(walk(g).E().has("weight", gt(0.4))) == ["e0", "e1", "e3"]
    assert at(v.where(lambda w: w.out("created").has("name", "ripple"))) == ["4"] and at(v.not_(lambda w: w.out())) == ["2", "3", "5"]


def test_moves(g):
    one = walk(g).V("1")
    assert at(one.out("knows")) == ["2", "4"] and at(walk(g).V("3").in_()) == ["1", "4", "6"] and at(walk(g).V("4").both()) == ["1", "3", "5"]
    assert at(one.out().out()) == ["3", "5"] and at(one.out_e("knows").in_v()) == ["2", "4"] and at(one.out_e().out_v().dedup()) == ["1"]
    assert at(walk(g).V("4").both_e().other_v()) == ["1", "3", "5"] and at(walk(g).V("3").in_e("created")) == ["e2", "e4", "e5"]
    assert at(one.out("knows").values("name")) == ["josh", "vadas"] and at(one.values("tag")) == ["m", "x"] and at(walk(g).E("e0").values("weight")) == ["0.5"]
    assert at(one.repeat(lambda w: w.out(), 2)) == ["3", "5"] and at(one.repeat(lambda w: w.out(), 2, emit=True)) == ["2", "3", "3", "4", "5"]
    assert sorted(map(tuple, (r["path"] for r in one.out("knows").out().paths().collect()))) == [("1", "4", "3"), ("1", "4", "5")]
    assert at(walk(g).V().choose(lambda w: w.has_label("software"), lambda w: w.in_("created"), lambda w: w.out("knows")).dedup()) == ["1", "2", "4", "6"]
    assert at(one.union(lambda w: w.out("knows"), lambda w: w.out("created"))) == ["2", "3", "4"] and at(walk(g).V().limit(2)) == ["1", "2"]


def test_results(g):
    v = walk(g).V()
    assert v.out().count().first()["count"] == 6 and v.has_label("software").fold().first()["list"] == ["3", "5"]
    assert {r["value"]: r["count"] for r in v.group_count("label").collect()} == {"person": 4, "software": 2} and {r["value"]: r["count"] for r in v.out("created").group_count().collect()} == {"3": 3, "5": 1}
    assert {r["value"]: r["list"] for r in v.group("lang").collect()} == {None: ["1", "2", "4", "6"], "java": ["3", "5"]}
    assert [r["id"] for r in v.has("age").order("age", ascending=False).collect()] == ["6", "4", "1", "2"]
    assert sorted(tuple(r) for r in v.as_("a").out("knows").as_("b").out("created").select("a", "b").collect()) == [("1", "4"), ("1", "4")]
    assert sorted(r["name"] for r in v.out("created").elements().collect()) == ["lop", "lop", "lop", "ripple"]
    found = walk(g).match(("a", "out", "created", "b"), ("b", "in", "created", "c"), ("a", "out", "knows", "c"))
    assert [(r["a"], r["b"], r["c"]) for r in found.collect()] == [("1", "3", "4")]
    assert sorted(r["id"] for r in search(g, "O").where("key = 'name'").collect()) == ["1", "3", "4"] and search(g, "0.5", "edge").count() == 1
    for wrong in (lambda: v.values("name").out(), lambda: v.out_v(), lambda: walk(g).match(), lambda: v.group_count("x"), lambda: v.union(lambda w: w, lambda w: w.values("name"))):
        with pytest.raises(GraphError):
            wrong()
