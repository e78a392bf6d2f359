"""Round trips of every format, backups, conflicts on import."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.model import DuplicateId, GraphError, PropertyGraph
from graphloom.operators import properties
from graphloom.sources import datasource, graphml, graphson, store


@pytest.fixture(scope="module")
def g(spark):
    v = [{"id": 1, "label": "person", "name": 'A "quoted" näme', "age": 30, "tags": ["x", "y"], "mail": ("a@b", {"ok": True})}, {"id": "two", "name": "B", "score": 1.5, "on": True}, {"id": 3}]
    return PropertyGraph.literal(spark, v, [{"src": 1, "dst": "two", "label": "knows", "weight": 0.5, "since": 2020}, {"src": 3, "dst": 3}]).replace(variables={"title": "t", "n": 3})


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "xml"])
def test_round_trip(spark, g, tmp_path, format):
    store.save(g, f"{tmp_path}/g", format, compress="gzip" if format == "json" else None)
    h = store.load(spark, f"{tmp_path}/g")
    assert rows(h.vertices) == rows(g.vertices) and rows(h.edges) == rows(g.edges) and h.variables == g.variables
    assert rows(h.vprops) == rows(g.vprops)


def test_graphson(spark, g, tmp_path):
    store.save(g, f"{tmp_path}/g", "graphson")
    h = store.load(spark, f"{tmp_path}/g")
    assert h.variables == g.variables and rows(h.vertices) == rows(g.vertices.select("id", "label"))
    assert rows(h.vprops.drop("prop_id", "meta")) == rows(g.vprops.drop("prop_id", "meta"))
    assert properties.meta_values(h.vprops).first()["meta_value"] == "true"
    t = graphson.typed(h, {"age": "long", "score": "double", "name": "string"}, {"weight": "double", "since": "long"})
    assert rows(t.edges) == rows(g.edges.select("id", "src", "dst", "label", "weight", "since"))
    assert t.vertices.where("id = '1'").first()["age"] == 30
    datasource.register(spark)
    (at,) = tmp_path.glob("g/v*")
    read = lambda x, p: spark.read.format("graphson").option("element", x).load(f"{at}/{p}")
    (tmp_path / "none").mkdir()
    assert spark.read.format("graphson").load(f"{tmp_path}/none").count() == 0
    assert read("vertex", "vertices").where("id = '1'").first()["properties"]["tags"] == ["x", "y"]
    assert read("edge", "edges").where("id = 'e0'").first()["properties"] == {"weight": "0.5", "since": "2020"}


def test_documents_and_conflicts(spark, g, tmp_path):
    text = graphson.document(g)
    assert json.loads(text)["version"] == "3.0" and graphson.is_graphson(text) and not graphson.is_graphson("[1]") and not graphson.is_graphson("x")
    (tmp_path / "d.json").write_text(text)
    h = graphson.read_document(spark, f"{tmp_path}/d.json")
    assert h.variables == g.variables and h.vertices.count() == 3 and rows(h.vprops.drop("prop_id", "meta")) == rows(g.vprops.drop("prop_id", "meta"))
    assert graphson.read_into(g, f"{tmp_path}/d.json").vertices.count() == 6
    assert graphson.read_into(g, f"{tmp_path}/d.json", "merge_properties").vertices.count() == 3
    again = graphson.read_into(g, f"{tmp_path}/d.json", "REPLACE_ELEMENT")
    assert again.vertices.count() == 3 and again.edges.count() == 2
    with pytest.raises(DuplicateId):
        graphson.read_into(g, f"{tmp_path}/d.json", "STRICT")
    other = {"vertices": [{"@type": "g:Vertex", "@value": {"id": {"@type": "g:Int32", "@value": 7}, "properties": {"age": [{"@type": "g:VertexProperty", "@value": {"id": 1, "value": {"@type": "g:Int32", "@value": 4}}}], "name": "plain"}}}], "edges": []}
    (tmp_path / "e.json").write_text(json.dumps(other))
    one = graphson.read_document(spark, f"{tmp_path}/e.json")
    assert [tuple(r) for r in one.vertices.collect()] == [("7", "vertex")] and sorted((r["key"], r["value"], r["type"]) for r in one.vprops.collect()) == [("age", "4", "long"), ("name", "plain", "string")]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(GraphError):
        graphson.read_document(spark, f"{tmp_path}/bad.json")


def test_backups(spark, g, tmp_path):
    folder = f"{tmp_path}/b"
    assert store.backups(spark, folder) == []
    for k in range(3):
        store.backup(g.replace(variables={"k": k}), folder, keep=2)
    assert len(store.backups(spark, folder)) == 2 and store.restore(spark, folder).variables == {"k": 2} and store.restore(spark, folder, 1).variables == {"k": 1}
    with pytest.raises(GraphError):
        store.restore(spark, folder, 2)
    store.compact(spark, store.backups(spark, folder)[0], f"{tmp_path}/c", 1)
    assert store.load(spark, f"{tmp_path}/c").vertices.count() == 3
    with pytest.raises(GraphError):
        store.save(g, f"{tmp_path}/x", "yaml")
    assert g.vertices.where(F.col("id") == "3").count() == 1


def test_a_failed_save_leaves_the_old_graph(spark, g, tmp_path):
    path = f"{tmp_path}/s"
    store.save(g, path)
    bad = g.replace(variables={"k": 9}, edges=g.edges.withColumn("label", F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        store.save(bad, path)
    assert store.load(spark, path).variables == g.variables and rows(store.load(spark, path).edges) == rows(g.edges)
    assert [x["what"] for x in store.transactions(spark, path)] == ["begin", "end", "begin"]
    assert store.recover(spark, path).startswith("1 unfinished") and store.recover(spark, path).startswith("0 unfinished")
    old = store.load(spark, path)
    store.save(g.replace(variables={"k": 1}), path, "orc")
    assert old.vertices.count() == 3 and store.load(spark, path).variables == {"k": 1}
    store.save(old, path)
    assert store.load(spark, path).multi == g.multi and len(store.transactions(spark, path)) == 6
    store.clean_log(spark, path, keep=1)
    assert len(store.transactions(spark, path)) == 2


def test_catalog_of_graphs(spark, g, tmp_path):
    c = store.Catalog(spark, f"{tmp_path}/c")
    assert c.list() == [] and not c.exists("a")
    c.save("a", g)
    c.save("b", g, "graphson")
    assert c.list() == ["a", "b"] and c.load("b").vertices.count() == 3 and c.info("a")["format"] == "parquet" and c.info("a")["bytes"] > 0
    assert c.delete("a") and not c.delete("a") and c.list() == ["b"]
    c.clear()
    with pytest.raises(GraphError):
        c.load("b")
    with pytest.raises(GraphError):
        c.exists("../x")


def test_typed_values(spark, g):
    for value in (None, "x", "list", True, 3, 1.5, [1, "a", [True]], {1, 2}, {"k": [1], 2: "v"}):
        assert graphson.read_value(graphson.write_value(value)) == value
    assert json.loads(graphson.write_value("single"))["@type"] == "g:Cardinality"
    for bad in ("{", '{"@type": "g:UUID", "@value": "x"}'):
        with pytest.raises(graphson.InvalidGraphSON):
            graphson.read_value(bad)
    with pytest.raises(graphson.InvalidGraphSON):
        graphson.typed_value(object())


def test_single_elements_and_collections(spark, g):
    vertex, edge = graphson.write_vertex(g, "1"), graphson.write_edge(g, "e0")
    assert graphson.write_vertex(g, "nobody") is None
    h = graphson.read_elements(spark, [vertex], [edge])
    assert rows(h.vprops.drop("prop_id", "meta")) == rows(g.vprops.where("vertex_id = '1'").drop("prop_id", "meta")) and h.edges.first()["src"] == "1"
    value = graphson.write_value([1, "a"])
    line = '{"@type":"g:Vertex","@value":{"id":"v","label":"l","properties":{"k":[{"@type":"g:VertexProperty","@value":{"id":"p","value":%s,"label":"k"}}],"c":[{"@type":"g:VertexProperty","@value":{"id":"q","value":"single","label":"c"}}]}}}' % value
    for _ in range(2):
        h = graphson.read_elements(spark, [line])
        k = {r["key"]: (r["type"], r["value"]) for r in h.vprops.collect()}
        assert k["k"][0] == "list" and graphson.plain_value(json.loads(k["k"][1])) == [1, "a"] and k["c"] == ("string", "single")
        line = graphson.write_vertex(h, "v")


def test_graphml(spark, g, tmp_path):
    (tmp_path / "g.xml").write_text(graphml.document(g))
    h = graphml.read(spark, f"{tmp_path}/g.xml")
    assert rows(h.vertices) == rows(g.vertices) and rows(h.edges) == rows(g.edges) and dict(h.vertices.dtypes) == dict(g.vertices.dtypes)
    (tmp_path / "x.xml").write_text("<a/>")
    with pytest.raises(GraphError):
        graphml.read(spark, f"{tmp_path}/x.xml")
