"""Import, saving, snapshots, rendering, the store handle, the command line and settings."""

import io
import json

import pytest

from graphloom import cli, config
from graphloom.errors import GraphError, InvalidOperation, NotFound
from graphloom.model import Graph
from graphloom.operators import mutate
from graphloom.sources import importer, render, store
from graphloom.store import GraphStore

NODES = "id,labels,name,age,city\nn1,Person,Alice,30,NYC\nn2,Person;Admin,Bob,25,SF\nn3,Company,Acme,,Boston\n"
EDGES = "from,to,type,since\nn1,n2,KNOWS,2020\nn1,n3,WORKS_AT,2019\n"


@pytest.fixture
def files(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return put


def test_csv(spark, files):
    r = importer.import_csv_nodes(Graph(spark), files("nodes.csv", NODES))
    e = importer.import_csv_edges(r.graph, files("edges.csv", EDGES))
    assert (r.nodes_imported, e.edges_imported, e.errors) == (3, 2, [])
    g = e.graph
    assert g.cypher("MATCH (a)-[r]->(b) RETURN a.name AS a, type(r) AS t, r.since AS s, b.name AS b ORDER BY b").collect() == [("Alice", "WORKS_AT", 2019, "Acme"), ("Alice", "KNOWS", 2020, "Bob")]
    assert g.cypher("MATCH (n:Admin) RETURN n.name AS n, n.age AS a").collect() == [("Bob", 25)]
    assert g.cypher("MATCH (n:Company) WHERE n.age IS NULL RETURN n").count() == 1
    assert importer.id_map(g).count() == 3


def test_csv_types(spark, files):
    text = "id,labels,name,age,salary,active,rating\n1,P,A,30,75000.50,true,4.5\n2,P,B,25,60000,FALSE,3.8\n"
    g = importer.import_csv_nodes(Graph(spark), files("types.csv", text)).graph
    (t,) = g.nodes.values()
    kinds = {p: t.type_of(p).simpleString() for p in t.props}
    assert kinds == {"name": "string", "age": "bigint", "salary": "double", "active": "boolean", "rating": "double"}
    assert g.cypher("MATCH (n) RETURN n.salary AS s, n.active AS a ORDER BY s").collect() == [(60000.0, False), (75000.5, True)]


def test_csv_odd(spark, files):
    o = importer.ImportOptions(delimiter="|", label_separator="/")
    text = 'ID|Labels|note\nx|  A / B  / A|"a | b\nsecond"\nx|C|last\n|||\n'
    r = importer.import_csv_nodes(Graph(spark), files("odd.csv", text.replace("|||", "|")), o)
    assert r.nodes_imported == 2
    assert r.graph.cypher("MATCH (n:C) RETURN n.note AS n").collect() == [("last",)]
    assert r.graph.cypher("MATCH (n:Node) RETURN id(n) AS i").count() == 1
    r = importer.import_csv_nodes(Graph(spark), files("bare.csv", "1,2\n3,4\n"), importer.ImportOptions(header=False))
    assert r.graph.cypher("MATCH (n:Node) RETURN n.col0 + n.col1 AS s ORDER BY s").collect() == [(3,), (7,)]
    with pytest.raises(InvalidOperation):
        importer.import_csv_edges(r.graph, files("noedges.csv", "from,x\n1,2\n"))


def test_csv_lines_are_split_unless_cells_hold_line_ends(spark, files):
    plain, quoted = files("plain.csv", 'id,x\na,"1, ""2"""\na,3\n'), files("quoted.csv", 'id,x\na,"1\n2"\n')
    o = importer.ImportOptions()
    assert not importer._open_quotes(spark, plain) and importer._open_quotes(spark, quoted)
    assert [r.x for r in importer.read_csv(spark, plain, o).collect()] == ['1, "2"', "3"]
    assert [r.x for r in importer.read_csv(spark, quoted, o).collect()] == ["1\n2"]
    g = importer.import_csv_nodes(Graph(spark), plain).graph
    assert g.cypher("MATCH (n) RETURN n.x AS x").collect() == [("3",)]
    whole = files("large.csv", "id,x\n" + "".join(f"n{i},{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        r = importer.import_csv_nodes(Graph(spark), whole)
        assert importer.read_csv(spark, whole, o).rdd.getNumPartitions() > 2 and r.nodes_imported == 3000
        assert r.graph.cypher("MATCH (n) RETURN sum(n.x) AS s").collect() == [(sum(range(3000)),)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_lines(spark, files):
    path = files("n.jsonl", '\n{"id": "a", "properties": {"x": 1}}\n not json\n  {"id": "a", "properties": {"x": 2}}\n')
    r = importer.import_json_nodes(Graph(spark), path)
    assert r.nodes_imported == 1 and r.graph.cypher("MATCH (n) RETURN n.x AS x").collect() == [(2,)]
    assert importer.import_json_nodes(Graph(spark), files("none.json", " ")).nodes_imported == 0
    assert importer.import_json_nodes(Graph(spark), files("empty.json", "[]")).nodes_imported == 0


def test_rejects(spark, files):
    g = importer.import_csv_nodes(Graph(spark), files("nodes.csv", NODES)).graph
    path = files("edges.csv", "Source,Target,Relationship\nn1,n2,A\nn1,zz,A\nqq,n2,A\nn1,,A\nn2,n3,\n")
    r = importer.import_csv_edges(g, path)
    assert r.edges_imported == 1 and r.rejects.count() == 4 and any("zz" in e for e in r.errors)
    for bad in (importer.ImportOptions(skip_invalid=False), importer.ImportOptions(max_errors=3)):
        with pytest.raises(InvalidOperation):
            importer.import_csv_edges(g, path, bad)


def test_json(spark, files):
    nodes = [{"id": "a", "labels": ["Person"], "properties": {"name": "Ann", "age": 3, "tags": ["x", 1], "mixed": 1}}, {"id": "b", "labels": "Dog", "properties": {"name": "Rex", "weight": 1.5, "mixed": "two", "none": None}}, {"properties": {"name": "anon"}}]
    edges = [{"from": "a", "to": "b", "type": "OWNS", "properties": {"since": 2001}}, {"from": 1, "to": "b", "type": "OWNS"}, {"from": "a", "to": "zz", "type": "OWNS"}]
    r = importer.import_json_nodes(Graph(spark), files("n.json", json.dumps(nodes)))
    e = importer.import_json_edges(r.graph, files("e.json", json.dumps(edges, indent=1)))
    assert (r.nodes_imported, e.edges_imported, e.rejects.count()) == (3, 1, 2)
    assert e.graph.cypher("MATCH (p)-[o:OWNS]->(d:Dog) RETURN p.name AS p, p.tags AS t, d.weight AS w, d.mixed AS m, o.since AS s").collect() == [("Ann", '["x",1]', 1.5, "two", 2001)]
    assert e.graph.cypher("MATCH (n:Node) RETURN n.name AS n").collect() == [("anon",)]


def graph(spark):
    g, ids = mutate.add_nodes(Graph(spark), [(("P", "Q"), {"name": "a", "list": [1, "x"], "map": {"k": None}}), (("P",), {"name": "b", "flag": True})])
    return mutate.add_edges(g, [(ids[0], ids[1], "T", {"w": 1.5})])[0]


def test_save_and_snapshots(spark, tmp_path):
    g = graph(spark)
    path = str(tmp_path / "db")
    store.save(g, path)
    back = store.open_graph(spark, path)
    assert sorted(map(repr, back.all_nodes().collect())) == sorted(map(repr, g.all_nodes().collect()))
    assert back.cypher("MATCH (a:Q)-[r:T]->(b) RETURN r.w AS w, b.flag AS f").collect() == [(1.5, True)]
    s = store.stats(back, path)
    assert (s["node_count"], s["edge_count"]) == (2, 1) and s["size_on_disk_bytes"] > 0
    with pytest.raises(NotFound):
        store.open_graph(spark, path + "x")
    snaps = store.Snapshots(spark, str(tmp_path / "snaps"))
    assert snaps.list().count() == 0
    names = [snaps.create(g) for _ in range(3)]
    assert [r.id for r in snaps.list().collect()] == names[::-1]
    assert snaps.cleanup(2) == 1 and [r.id for r in snaps.list().collect()] == names[:0:-1]
    assert snaps.get(names[2]).node_count() == 2
    with pytest.raises(NotFound):
        snaps.get(names[0])
    store.write_parquet(g.all_edges(), str(tmp_path / "e"))
    assert store.parquet_metadata(spark, str(tmp_path / "e"))["num_rows"] == 1


def test_render():
    r = {"columns": ["a", "b"], "rows": [{"a": 1, "b": 2.345}, {"a": None, "b": float("inf")}, {"a": "x,y", "b": True}], "row_count": 3, "execution_time_ms": 5}
    assert render.as_table(r).splitlines()[2:] == ["1    | 2.35", "NULL | inf", "x,y  | true", "3 row(s) (5 ms)"]
    assert json.loads(render.as_json(r))[1] == {"a": None, "b": 0}
    assert render.as_csv(r) == 'a,b\n1,2.345\n,inf\n"x,y",true'
    assert render.as_table({"columns": ["a"], "rows": [], "row_count": 0, "execution_time_ms": 1}) == "(no results)\n0 row(s) (1 ms)"


def test_store(spark):
    s = GraphStore(spark)
    a, b, c = s.add_node(["Person"], {"name": "Alice", "age": 30}), s.add_node(["Person"], {"name": "Bob", "ok": True}), s.add_node([], {})
    e1, e2, e3 = s.add_edge(a, b, "KNOWS", {"since": 2020}), s.add_edge(a, c, "KNOWS"), s.add_edge(b, c, "LIKES")
    assert (s.node_count(), s.edge_count()) == (3, 3)
    assert s.get_node(a) == {"_node_id": a, "_labels": ["Person"], "name": "Alice", "age": 30}
    assert s.get_edge(e1)["since"] == 2020 and s.get_edge(e1)["_src"] == a
    assert {x["_dst"] for x in s.get_outgoing_edges(a)} == {b, c} and len(s.get_incoming_edges(c)) == 2
    assert s.get_node("nobody") is None and s.get_edge("nothing") is None
    assert [n["_node_id"] for n in s.find_nodes_by_property("age", 30)] == [a] and s.find_nodes_by_property("age", 30.0) == [] and s.find_nodes_by_property("age", "30") == []
    s.update_node(a, {"age": 31, "city": "Rome"})
    assert s.get_node(a)["age"] == 31 and s.get_node(a)["name"] == "Alice" and s.get_node(a)["city"] == "Rome"
    s.update_edge(e1, {"w": 2.5})
    assert s.get_edge(e1)["w"] == 2.5 and s.get_edge(e1)["since"] == 2020
    assert len(s.find_edges_by_type("KNOWS")) == 2 and len(s.get_all_edges()) == 3 and len(s.get_all_nodes()) == 3
    r = s.execute_cypher("MATCH (n:Person) WHERE n.age > 30 RETURN n")
    assert r["row_count"] == 1 and r["rows"][0]["name"] == "Alice" and "_node_id" in r["columns"]
    s.delete_edge(e3)
    assert s.edge_count() == 2
    s.delete_node(a)
    assert (s.node_count(), s.edge_count()) == (2, 0)
    with pytest.raises(NotFound):
        s.delete_node(a)
    with pytest.raises(NotFound):
        s.add_edge(b, a, "KNOWS")
    s.execute_cypher("CREATE (x:New {v: 1})")
    assert len(s.find_nodes_by_label("New")) == 1
    s.clear()
    assert s.node_count() == 0 and s.get_all_nodes() == []


def test_labels(spark):
    g = graph(spark)
    name = next(n for n, t in g.nodes.items() if t.labels == ("P",))
    g = mutate.add_label(g, name, "Extra")
    g = mutate.add_label(g, name, "Flagged", "p_flag")
    assert g.nodes_by_label("Extra").count() == 1 and g.nodes_by_label("Flagged", "P").count() == 1
    g = mutate.remove_label(mutate.remove_label(g, name, "Extra"), name, "Flagged")
    assert g.labels() == ["P", "Q"] and mutate.clear(g).node_count() == 0


def test_cli(spark, tmp_path, files, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    db = str(tmp_path / "db")
    assert cli.main(["-d", db, "--import-csv-nodes", files("nodes.csv", NODES), "--import-csv-edges", files("edges.csv", EDGES)]) == 0
    assert "3 nodes" in capsys.readouterr().out
    assert cli.main(["-d", db, "-q", "MATCH (n:Person) RETURN n.name AS name ORDER BY name", "--output", "csv"]) == 0
    assert capsys.readouterr().out.split() == ["name", "Alice", "Bob"]
    assert cli.main(["-d", db, "-f", files("s.cypher", "CREATE (x:Person {name: 'Z;z'}); // done\nMATCH (n:Person) RETURN count(n) AS n;"), "--output", "json"]) == 0
    assert '"n": 3' in capsys.readouterr().out
    assert cli.main(["-q", "nonsense"]) == 1 and "Parse error" in capsys.readouterr().out
    out = io.StringIO()
    cli.repl(GraphStore.open(spark, db), "table", [":help\n", ":stats\n", ":what\n", "MATCH (n:Person) RETURN count(n) AS n\n", "\n", ":quit\n", "never\n"], out)
    assert "Nodes: 4" in out.getvalue() and "Unknown command" in out.getvalue() and "1 row(s)" in out.getvalue()


def test_config(files):
    assert config.load(environ={}).algorithms.pagerank_damping == 0.85
    path = files("c.toml", "[storage]\npath = '/x'\n[imports]\nskip_invalid = false\n[spark]\n'spark.a' = 1\n")
    c = config.load(path, {"GRAPHLOOM_IMPORTS_MAX_ERRORS": "7", "GRAPHLOOM_IMPORTS_SKIP_INVALID": "yes"})
    assert (c.storage.path, c.imports.max_errors, c.imports.skip_invalid, c.spark) == ("/x", 7, True, {"spark.a": "1"})
    for bad in ("[nosuch]\na = 1\n", "[storage]\nnosuch = 1\n"):
        with pytest.raises(ValueError):
            config.load(files("bad.toml", bad), {})
    with pytest.raises(ValueError):
        config.load(None, {"GRAPHLOOM_IMPORTS_SKIP_INVALID": "perhaps"})
    assert issubclass(NotFound, GraphError)
