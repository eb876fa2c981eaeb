"""Every registered graph query against its SQL, and fixed rules of the language."""

import pytest

from graphloom import queries as Q
from graphloom.errors import GraphError, InvalidOperation, QuerySyntaxError
from graphloom.model import Graph
from graphloom.operators import mutate
from graphloom.plans import parser

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.views(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, con, name):
    assert oracle.compare(spark, con, SF, name, Q.queries()[name], Q.oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def people(spark):
    nodes = [(("Person",), {"name": "Alice", "age": 30, "city": "NYC"}), (("Person",), {"name": "Bob", "age": 25, "city": "SF"}), (("Person",), {"name": "Charlie", "age": 35, "city": "NYC"}), (("Company",), {"name": "Acme Corp", "founded": 2010})]
    g, ids = mutate.add_nodes(Graph(spark), nodes)
    return mutate.add_edges(g, [(ids[0], ids[1], "KNOWS", {"since": 2020}), (ids[0], ids[1], "KNOWS", {"since": 2021}), (ids[2], ids[2], "LIKES", {}), (ids[1], ids[3], "WORKS_AT", {"since": 2019.5})])[0]


COUNTS = {
    "MATCH (n) RETURN n": 4, "MATCH (n:Person) RETURN n": 3, "MATCH (n:Company) RETURN n.name": 1, "MATCH (n:Nobody) RETURN n": 0,
    "MATCH (n:Person) WHERE n.age > 25 RETURN n.name": 2, "MATCH (n:Person) WHERE n.name = \"Alice\" RETURN n": 1,
    "MATCH (n:Person) WHERE n.age > 25 AND n.city = 'NYC' RETURN n": 2, "MATCH (n:Person) WHERE n.age <= 30 RETURN n": 2,
    "MATCH (n:Person) WHERE n.city != 'NYC' RETURN n": 1, "MATCH (n:Person) WHERE n.age > 100 RETURN n": 0,
    "MATCH (n) WHERE n.founded = 2010 OR n.age = 25 RETURN n": 2, "MATCH (n) WHERE NOT n.age = 25 RETURN n": 2,
    "MATCH (n) WHERE n.age = null RETURN n": 0, "MATCH (n) WHERE n.age IS NULL RETURN n": 1, "MATCH (n) WHERE n.age = 30.0 RETURN n": 1,
    "MATCH (n) WHERE n.name > 5 RETURN n": 0, "MATCH (n) WHERE n.name <> 5 RETURN n": 4, "MATCH (n) WHERE n.name RETURN n": 4,
    "MATCH (n) WHERE n.age = -(-30) RETURN n": 1, "MATCH (n:Person) WHERE n.age + 1 = 26 XOR n.city = 'NYC' RETURN n": 3,
    "MATCH (a)-[r:KNOWS]->(b) RETURN a.name, r.since": 2, "MATCH (a)-[r]-(b) RETURN a": 7, "MATCH (a)<-[r:KNOWS]-(b) RETURN a": 2,
    "MATCH (a)-[x:KNOWS]->(b)<-[y:KNOWS]-(a) RETURN x, y": 2, "MATCH (a)-[:LIKES]->(a) RETURN a": 1, "MATCH (a)-[]->(b)-[]->(c) RETURN c.name": 2,
    "MATCH (a:Person), (b:Company) RETURN a, b": 3, "MATCH (n:Person) RETURN DISTINCT n.city": 2, "MATCH (n) RETURN n.name LIMIT 2": 2, "MATCH (n) RETURN n LIMIT 0": 0,
    "MATCH (a)-[r {since: 2019.5}]->(b) RETURN a": 1, "match (n:Person) // comment\n return n.name as distinctive;": 3,
}


@pytest.mark.parametrize("text", COUNTS)
def test_counts(people, text):
    assert people.cypher(text).count() == COUNTS[text]


def test_values(people):
    one = lambda q, **p: [tuple(r) for r in people.cypher(q, p).collect()]
    assert one("MATCH (n:Person) RETURN n.name ORDER BY n.age DESC") == [("Charlie",), ("Alice",), ("Bob",)]
    assert one("MATCH (n) RETURN n.name AS name, n.age AS age ORDER BY age, name") == [("Bob", 25), ("Alice", 30), ("Charlie", 35), ("Acme Corp", None)]
    assert one("MATCH (n) RETURN n.age AS age ORDER BY age DESC LIMIT 1") == [(None,)]
    assert one("MATCH (n:Person) RETURN count(*) AS n, sum(n.age) AS s, avg(n.age) AS a, min(n.name) AS lo, max(n.age) AS hi, count(n.nosuch) AS z") == [(3, 90, 30.0, "Alice", 35, 0)]
    assert one("MATCH (n:Person) RETURN n.city AS c, count(n) AS n ORDER BY n DESC, c") == [("NYC", 2), ("SF", 1)]
    assert one("MATCH (n:Person) WHERE n.age > $least RETURN n.name AS n ORDER BY n", least=26) == [("Alice",), ("Charlie",)]
    assert one("MATCH (n:Company) RETURN 7 / 2 AS a, -7 / 2 AS b, 7.0 / 2 AS c, 7 % 0 AS d, 1 / 0 AS e, 'a' + 'b' AS f, 2 + 3 * 4 - 1 AS g, 9223372036854775807 + 1 AS h, 1 + 'a' AS i") == [(3, -3, 3.5, None, None, "ab", 13, None, None)]
    assert one("MATCH (n:Nobody) RETURN count(*) AS n, sum(n.x) AS s") == [(0, 0.0)]
    assert one("MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, collect(r.since) AS s")[0][0] == "Alice"
    assert people.cypher("MATCH (n:Company) RETURN n").columns == ["n"]


@pytest.mark.parametrize("text", ["", "SELECT 1", "MATCH (n RETURN n", "MATCH (n) RETURN", "MATCH (n) RETURN n extra", "MATCH (n) WHERE RETURN n", "MATCH (n)-[:A|B]->(m) RETURN n", "MATCH (n) RETURN n LIMIT -1", "MATCH (n) RETURN n LIMIT x", "MATCH (n) RETURN 'open", "MATCH (n) RETURN n.a AS x, n.b AS x", "SET n.a = 1 RETURN n"])
def test_syntax_errors(people, text):
    assert not parser.validate(text)
    with pytest.raises(QuerySyntaxError, match="Parse error"):
        people.cypher(text)


@pytest.mark.parametrize("text", ["MATCH (n) RETURN m", "MATCH (n) RETURN nosuch(n)", "MATCH (n) WHERE n.a = $p RETURN n", "MATCH (n)-[n]->(m) RETURN n", "CREATE (n)", "MATCH (n) RETURN count(count(n))", "MATCH (n) WHERE count(n) > 1 RETURN n"])
def test_invalid(people, text):
    with pytest.raises(InvalidOperation):
        people.cypher(text)


def test_writes(people):
    g = people.apply("CREATE (d:Person {name: 'Dan', age: 41})-[:KNOWS {since: 2024}]->(e:Person {name: 'Eve'})")
    assert (g.node_count(), g.edge_count(), people.node_count()) == (6, 5, 4)
    assert g.cypher("MATCH (a {name: 'Dan'})-[r:KNOWS]->(b) RETURN b.name AS n, r.since AS s").collect() == [("Eve", 2024)]
    assert g.apply("MERGE (x:Person {name: 'Eve'})").node_count() == 6 and g.apply("MERGE (x:Person {name: 'Fay'})").node_count() == 7
    g = g.apply("MATCH (a:Person {name: 'Dan'}), (b:Company) MERGE (a)-[:WORKS_AT]->(b)")
    g = g.apply("MATCH (a:Person {name: 'Dan'}), (b:Company) MERGE (a)-[:WORKS_AT]->(b)")
    assert g.cypher("MATCH (a)-[:WORKS_AT]->(b) RETURN a.name AS n ORDER BY n").collect() == [("Bob",), ("Dan",)]
    g = g.apply("MATCH (p:Person)-[:WORKS_AT]->(c) SET p.job = c.name, p.age = p.age + 1")
    assert g.cypher("MATCH (p:Person) WHERE p.job = 'Acme Corp' RETURN p.name AS n, p.age AS a ORDER BY n").collect() == [("Bob", 26), ("Dan", 42)]
    g = g.apply("MATCH (p:Person {name: 'Alice'}) CREATE (p)-[:OWNS]->(c:Cat {name: 'Tom', of: p.name})")
    assert g.cypher("MATCH (p)-[:OWNS]->(c:Cat) RETURN p.name AS p, c.of AS o").collect() == [("Alice", "Alice")]
    g = g.apply("MATCH (a)-[r:KNOWS]->(b) WHERE r.since < 2021 DELETE r")
    assert g.cypher("MATCH (a)-[r:KNOWS]->(b) RETURN r.since AS s ORDER BY s").collect() == [(2021,), (2024,)]
    g = g.apply("MATCH (a:Person {name: 'Bob'}) DETACH DELETE a")
    assert g.cypher("MATCH (a)-[r]->(b) RETURN type(r) AS t ORDER BY t").collect() == [("KNOWS",), ("LIKES",), ("OWNS",), ("WORKS_AT",)]
    for bad in ("SET n.x = 1", "DELETE n", "CREATE (a)-[:T]-(b)", "MATCH (n) DELETE n.name", "MATCH (n) RETURN n"):
        with pytest.raises(GraphError):
            people.apply(bad)


def test_plans(spark):
    """Filters and columns reach the files, and a node that only its key names is not joined."""
    from graphloom.sources.tables import shop_graph

    g = shop_graph(spark, SF)
    plan = g.explain("MATCH (c:Customer) WHERE c.acctbal > 9000 AND c.mktsegment = 'BUILDING' RETURN c.custkey AS k")
    assert "GreaterThan(c_acctbal,9000" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan and "ReadSchema: struct<c_custkey:bigint,c_acctbal:double,c_mktsegment:string>" in plan
    plan = g.explain("MATCH (c:Customer)-[:PLACED]->(o:Order)-[i:CONTAINS]->(p) WHERE c.nationkey = 1 RETURN sum(i.quantity) AS q")
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "part.parquet" not in plan and plan.count("ReadSchema") == 3


def test_louvain_and_walks_use_whole_graphs(spark):
    from graphloom import queries as Q
    from graphloom.sources import tables

    sf = "/root/testdata/sf0.001"
    parts = {f"Part:{r[0]}" for r in tables.read(spark, sf, "part").select("p_partkey").collect()}
    for q in (Q.q_louvain, Q.q_louvain_parallel):
        assert {r.id for r in q(spark, sf).collect()} == parts
    linked = {(f"Nation:{r.src}", f"Nation:{r.dst}") for r in tables.trades_with(spark, sf).collect()}
    kept = {(f"Nation:{r.src}", f"Nation:{r.dst}") for r in tables.trades_with(spark, sf, tables.TOP_PARTNERS).collect()}
    at = {(r.start, r.walk, r.step): r.id for r in Q.q_node2vec(spark, sf).collect()}
    used = {(at[s, w, i], b) for (s, w, i1), b in at.items() if i1 for i in [i1 - 1]}
    assert used <= linked and used - kept


def test_louvain_has_one_default():
    import inspect

    from graphloom.operators import louvain

    assert inspect.signature(louvain.louvain).parameters["exact"].default is True
