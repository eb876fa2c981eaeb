"""The registered queries over the benchmark tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .model import Graph, NodeTable
from .operators import components, index, louvain, mutate, mutation_log, mvcc, node2vec, pagerank, paths, traversal, triangles
from .session import shared_dir, stage
from .sources import importer, store, tables

FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order)-[i:CONTAINS]->(p:Part) WHERE p.size > 10 RETURN c.mktsegment AS seg, count(DISTINCT o) AS orders, round(sum(i.extendedprice), 2) AS revenue"

#: name: (statement, SQL[, parameters])
STATEMENTS: dict[str, tuple] = {
    "scan_label": ("MATCH (n:Customer) RETURN n.custkey AS custkey, n.name AS name, n.acctbal AS acctbal", "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer"),
    "scan_all_counts": (
        "MATCH (n) RETURN head(labels(n)) AS label, count(*) AS n",
        "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'EventType', count(DISTINCT event_type) FROM events",
    ),
    "where_eq": ("MATCH (p:Part) WHERE p.brand = 'Brand#13' RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE p_brand = 'Brand#13'"),
    "where_ne": ("MATCH (c:Customer) WHERE c.mktsegment != 'BUILDING' RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "where_lt": ("MATCH (c:Customer) WHERE c.acctbal < 100 RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal < 100"),
    "where_le": ("MATCH (p:Part) WHERE p.size <= 5 RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE p_size <= 5"),
    "where_gt": ("MATCH (c:Customer) WHERE c.acctbal > 9000 RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 9000"),
    "where_ge": ("MATCH (p:Part) WHERE p.size >= 45 RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE p_size >= 45"),
    "where_and": ("MATCH (c:Customer) WHERE c.acctbal > 5000 AND c.mktsegment = 'MACHINERY' AND c.nationkey < 10 RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'MACHINERY' AND c_nationkey < 10"),
    "where_or": ("MATCH (c:Customer) WHERE c.acctbal < 0 OR c.acctbal > 9900 OR c.nationkey = 3 RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9900 OR c_nationkey = 3"),
    "where_not": ("MATCH (c:Customer) WHERE NOT (c.nationkey > 2 OR c.acctbal < 1000) RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE NOT (c_nationkey > 2 OR c_acctbal < 1000)"),
    "where_precedence": ("MATCH (p:Part) WHERE p.size = 1 OR p.size = 2 AND NOT p.brand = 'Brand#11' RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE p_size = 1 OR (p_size = 2 AND NOT p_brand = 'Brand#11')"),
    "where_arith": ("MATCH (p:Part) WHERE p.size * 2 + 1 > 90 - p.size RETURN p.partkey AS partkey, p.size / 7 AS sevenths, -p.size AS neg", "SELECT p_partkey AS partkey, CAST(p_size // 7 AS BIGINT) AS sevenths, CAST(-p_size AS BIGINT) AS neg FROM part WHERE p_size * 2 + 1 > 90 - p_size"),
    "where_mod": ("MATCH (o:Order) WHERE o.orderkey % 97 = 5 RETURN o.orderkey AS orderkey", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey % 97 = 5"),
    "where_string_concat": ("MATCH (c:Customer) WHERE c.mktsegment + '!' = 'BUILDING!' RETURN c.custkey AS custkey, c.mktsegment + '-' + c.name AS tag", "SELECT c_custkey AS custkey, c_mktsegment || '-' || c_name AS tag FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "where_cross_type": ("MATCH (c:Customer) WHERE c.custkey = 'x' OR c.custkey <> 'x' AND c.custkey < 10 RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey < 10"),
    "where_division_by_zero": ("MATCH (c:Customer) WHERE 1 / (c.nationkey - 3) > 0 RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_nationkey = 4"),
    "where_time": ("MATCH (o:Order) WHERE o.orderdate >= '1997-01-01' RETURN o.orderkey AS orderkey", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"),
    "missing_property": ("MATCH (n) WHERE n.acctbal > 9500 OR NOT n.nosuch = 1 RETURN id(n) AS id", "SELECT 'Customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT 'Supplier:' || s_suppkey FROM supplier WHERE s_acctbal > 9500"),
    "multi_label": ("MATCH (c:Customer:Debtor) RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal < 0"),
    "inline_props": ("MATCH (c:Customer {mktsegment: 'HOUSEHOLD', nationkey: 7}) RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_nationkey = 7"),
    "params": ("MATCH (c:Customer) WHERE c.acctbal > $least AND c.mktsegment = $seg RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 8000 AND c_mktsegment = 'FURNITURE'", {"least": 8000, "seg": "FURNITURE"}),
    "string_predicates": ("MATCH (p:Part) WHERE p.brand STARTS WITH 'Brand#2' AND p.name CONTAINS 'a' AND p.size IN [1, 2, 3, 5, 8] RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE starts_with(p_brand, 'Brand#2') AND contains(p_name, 'a') AND p_size IN (1, 2, 3, 5, 8)"),
    "functions": ("MATCH (c:Customer) RETURN c.custkey AS custkey, toLower(c.mktsegment) AS seg, size(c.name) AS n, substring(c.name, 0, 8) AS s, abs(c.acctbal) AS a, coalesce(c.nosuch, c.nationkey) AS k, toString(c.custkey) AS t, c.nosuch IS NULL AS u", "SELECT c_custkey AS custkey, lower(c_mktsegment) AS seg, length(c_name) AS n, substr(c_name, 1, 8) AS s, abs(c_acctbal) AS a, c_nationkey AS k, CAST(c_custkey AS VARCHAR) AS t, true AS u FROM customer"),
    "return_alias": ("MATCH (n:Nation) RETURN n.name AS country, n.regionkey AS region", "SELECT n_name AS country, n_regionkey AS region FROM nation"),
    "return_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.mktsegment AS seg, c.nationkey AS nation", "SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS nation FROM customer"),
    "order_desc": ("MATCH (n:Nation) RETURN n.name AS name, n.nationkey AS k ORDER BY n.regionkey DESC, name", "SELECT n_name AS name, n_nationkey AS k FROM nation"),
    "order_limit": ("MATCH (c:Customer) RETURN c.custkey AS custkey, c.acctbal AS acctbal ORDER BY acctbal DESC, custkey LIMIT 10", "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 10"),
    "order_skip_limit": ("MATCH (c:Customer) RETURN c.custkey AS custkey ORDER BY custkey SKIP 5 LIMIT 5", "SELECT c_custkey AS custkey FROM customer ORDER BY 1 LIMIT 5 OFFSET 5"),
    "minimum_slice": ("MATCH (c:Customer) WHERE c.acctbal > 9000 AND c.mktsegment = 'BUILDING' RETURN c.custkey AS custkey, c.acctbal AS acctbal ORDER BY acctbal DESC, custkey LIMIT 20", "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING' ORDER BY 2 DESC, 1 LIMIT 20"),
    "hop_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.nationkey = 4 RETURN c.custkey AS custkey, o.orderkey AS orderkey", "SELECT c_custkey AS custkey, o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 4"),
    "hop_in": ("MATCH (n:Nation)<-[:FROM_NATION]-(x) WHERE n.name = 'CHINA' OR n.nationkey = 6 RETURN id(x) AS id, n.nationkey AS k", "SELECT 'Customer:' || c_custkey AS id, n_nationkey AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name = 'CHINA' OR n_nationkey = 6 UNION ALL SELECT 'Supplier:' || s_suppkey, n_nationkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_name = 'CHINA' OR n_nationkey = 6"),
    "hop_undirected": ("MATCH (n:Nation {nationkey: 3})-[r]-(x) RETURN type(r) AS t, id(x) AS id", "SELECT 'IN_REGION' AS t, 'Region:' || n_regionkey AS id FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'FROM_NATION', 'Customer:' || c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'FROM_NATION', 'Supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 3"),
    "two_hop": ("MATCH (c:Customer)-[:FROM_NATION]->(n)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS customers", "SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "three_hop": (FLAGSHIP, "SELECT c_mktsegment AS seg, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1"),
    "comma_join": ("MATCH (c:Customer)-[:PLACED]->(o), (o)-[i:CONTAINS]->(p:Part {size: 7}) RETURN c.custkey AS custkey, p.partkey AS partkey, i.quantity AS q", "SELECT c_custkey AS custkey, p_partkey AS partkey, l_quantity AS q FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = 7"),
    "cartesian": ("MATCH (a:Region), (b:Nation) RETURN a.name AS a, b.name AS b", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "theta_pair": ("MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey AND a.regionkey = b.regionkey RETURN a.nationkey AS a, b.nationkey AS b", "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x, nation y WHERE x.n_nationkey < y.n_nationkey AND x.n_regionkey = y.n_regionkey"),
    "edge_props_filter": ("MATCH (o:Order)-[i:CONTAINS {returnflag: 'R'}]->(p) WHERE i.quantity > 45 RETURN o.orderkey AS orderkey, i.quantity AS q, i.discount AS d", "SELECT l_orderkey AS orderkey, l_quantity AS q, l_discount AS d FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"),
    "relationship_uniqueness": ("MATCH (a:Part)<-[x:CONTAINS]-(o:Order)-[y:CONTAINS]->(b:Part) WHERE a.size = 1 RETURN count(*) AS n", "SELECT (SELECT count(*) FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey JOIN part ON x.l_partkey = p_partkey WHERE p_size = 1) - (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1) AS n"),
    "same_variable_twice": ("MATCH (o:Order)-[a:CONTAINS]->(p:Part)<-[b:CONTAINS]-(o) RETURN count(*) AS n", "SELECT count(*) - (SELECT count(*) FROM lineitem) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey = y.l_partkey"),
    "count_nodes": ("MATCH (n) RETURN count(n) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(DISTINCT event_type) FROM events) AS n"),
    "count_edges": ("MATCH ()-[r]->() RETURN type(r) AS t, count(*) AS n", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'FROM_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'DID', count(*) FROM events"),
    "count_distinct": ("MATCH (o:Order)-[:CONTAINS]->(p) RETURN o.orderpriority AS pri, count(DISTINCT p.brand) AS brands, count(DISTINCT p) AS parts", "SELECT o_orderpriority AS pri, count(DISTINCT p_brand) AS brands, count(DISTINCT p_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "sum_avg_min_max": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, round(sum(c.acctbal), 4) AS s, round(avg(c.acctbal), 6) AS a, min(c.acctbal) AS lo, max(c.acctbal) AS hi, sum(c.nationkey) AS k", "SELECT c_mktsegment AS seg, round(sum(c_acctbal), 4) AS s, round(avg(c_acctbal), 6) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, CAST(sum(c_nationkey) AS BIGINT) AS k FROM customer GROUP BY 1"),
    "aggregate_expression": ("MATCH (p:Part) RETURN p.brand AS brand, count(*) * 2 + 1 AS n ORDER BY n DESC, brand LIMIT 5", "SELECT p_brand AS brand, count(*) * 2 + 1 AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "user_events": ("MATCH (u:User)-[d:DID]->(e:EventType) RETURN e.name AS kind, count(DISTINCT u) AS users, count(*) AS n, round(sum(d.value), 3) AS v", "SELECT event_type AS kind, count(DISTINCT user_id) AS users, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY 1"),
}

_CO = "SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2"
_TRADE = "SELECT c_nationkey AS src, s_nationkey AS dst, count(DISTINCT l_orderkey) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
_THIN = f"SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM ({_TRADE}) WHERE src <> dst) WHERE r <= {tables.TOP_PARTNERS}"
_WHOLE = f"SELECT src, dst, weight FROM ({_TRADE}) WHERE src <> dst"
_BFS = f"WITH RECURSIVE e AS MATERIALIZED ({_THIN}), w(id, d) AS (SELECT 0, 0 UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.id WHERE w.d < {{depth}}) SELECT 'Nation:' || id AS id, min(d) AS distance FROM w GROUP BY 1"


def _thin(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = tables.trade_graph(spark, sf, tables.TOP_PARTNERS)
    return g.vertex_frame(), stage(g.edge_frame(weight="weight"), "trade")


def _trade(spark: SparkSession, sf: str, loops: bool = True) -> tuple[DataFrame, DataFrame]:
    g = tables.trade_graph(spark, sf)
    edges = g.edge_frame(weight="weight")
    return g.vertex_frame(), stage(edges if loops else edges.where("src <> dst"), "trade")


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = tables.part_graph(spark, sf)
    return g.vertex_frame(), stage(g.edge_frame(weight="weight"), "parts")


def q_bfs(spark, sf):
    return traversal.bfs(*_thin(spark, sf), "Nation:0").select("id", "distance")


def q_bfs_max_depth(spark, sf):
    return traversal.bfs(*_thin(spark, sf), "Nation:0", 2).select("id", "distance")


def q_dijkstra(spark, sf):
    return paths.shortest_paths(*_thin(spark, sf), "Nation:0").select("id", "distance")


def q_dfs_tree(spark, sf):
    """Depth-first numbers on the tree region, nation, customer, below one region."""
    g = tables.shop_graph(spark, sf)
    nodes = g.vertex_frame("Region", "Nation", "Customer")
    n = tables.read(spark, sf, "nation").select(F.format_string("Region:%d", "n_regionkey").alias("src"), F.format_string("Nation:%d", "n_nationkey").alias("dst"))
    c = tables.read(spark, sf, "customer").select(F.format_string("Nation:%d", "c_nationkey").alias("src"), F.format_string("Customer:%d", "c_custkey").alias("dst"))
    edges = n.unionByName(c).withColumn("eid", F.concat_ws(">", "src", "dst"))
    return traversal.dfs(nodes, edges, "Region:1").select("id", "discovery", "finish", "parent")


_DFS = """WITH n AS (SELECT 'Nation:' || n_nationkey AS id, 'Region:' || n_regionkey AS parent FROM nation WHERE n_regionkey = 1),
c AS (SELECT 'Customer:' || c_custkey AS id, 'Nation:' || c_nationkey AS parent FROM customer WHERE 'Nation:' || c_nationkey IN (SELECT id FROM n)),
t AS (SELECT 'Region:1' AS id, NULL AS parent, 0 AS depth, '' AS a, '' AS b, 1 + (SELECT count(*) FROM n) + (SELECT count(*) FROM c) AS s
UNION ALL SELECT id, parent, 1, id, '', 1 + (SELECT count(*) FROM c WHERE c.parent = n.id) FROM n
UNION ALL SELECT id, parent, 2, parent, id, 1 FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY a, b) AS pre FROM t)
SELECT id, 2 * (pre - 1) - depth + 1 AS discovery, 2 * (pre - 1) - depth + 1 + 2 * s - 1 AS finish, parent FROM r"""


def q_components(spark, sf):
    return components.roots(*_parts(spark, sf))


_COMPONENTS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT 'Part:' || src AS a, 'Part:' || dst AS b FROM ({_CO})), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(id, root) AS (SELECT 'Part:' || p_partkey, 'Part:' || p_partkey FROM part UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.id AND w.root < u.b)
SELECT id, min(root) AS root FROM w GROUP BY 1"""


def q_component_sizes(spark, sf):
    """How many components have each size."""
    sizes = components.component_sizes(components.connected_components(*_parts(spark, sf)))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


_SIZES = f"SELECT size, count(*) AS n FROM (SELECT root, count(*) AS size FROM ({_COMPONENTS}) GROUP BY 1) GROUP BY 1"


def q_pagerank(spark, sf):
    return pagerank.pagerank(*_trade(spark, sf, loops=False), 0.85, 10, 0.0).scores.select("id", F.round("score", 9).alias("score"))


def q_pagerank_top(spark, sf):
    return pagerank.pagerank(*_trade(spark, sf, loops=False), 0.85, 10, 0.0).top_nodes(5).select("id", F.round("score", 9).alias("score"))


def _pagerank_sql(k: int, n: str = "(SELECT count(*) FROM nation)") -> str:
    steps = [f"e AS MATERIALIZED ({_WHOLE}), d AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY 1)", f"r0 AS (SELECT n_nationkey AS id, 1.0::DOUBLE / {n} AS s FROM nation)"]
    steps += [f"r{i} AS MATERIALIZED (SELECT r.id, 0.15::DOUBLE / {n} + 0.85::DOUBLE * coalesce(x.t, 0) AS s FROM r{i - 1} r LEFT JOIN (SELECT e.dst, sum(p.s / d.deg) AS t FROM e JOIN r{i - 1} p ON p.id = e.src JOIN d ON d.src = e.src GROUP BY 1) x ON x.dst = r.id)" for i in range(1, k + 1)]
    return f"WITH {', '.join(steps)} SELECT 'Nation:' || id AS id, round(s, 9) AS score FROM r{k}"


def q_triangles(spark, sf):
    return triangles.triangle_summary(triangles.triangle_counts(*_parts(spark, sf))).select("total", F.round("mean_coefficient", 9).alias("mean_coefficient"))


def q_clustering(spark, sf):
    return triangles.triangle_counts(*_parts(spark, sf)).select("id", "triangles", "degree", F.round("coefficient", 9).alias("coefficient"))


_TRI = f"""WITH e AS MATERIALIZED ({_CO}), t AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst),
k AS (SELECT v, count(*) AS n FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1),
d AS (SELECT v, count(*) AS n FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
f AS (SELECT 'Part:' || p_partkey AS id, coalesce(k.n, 0) AS triangles, coalesce(d.n, 0) AS degree, CASE WHEN coalesce(d.n, 0) >= 2 THEN coalesce(k.n, 0) / (d.n * (d.n - 1) / 2) ELSE 0.0 END AS coefficient FROM part LEFT JOIN k ON k.v = p_partkey LEFT JOIN d ON d.v = p_partkey)"""


def q_modularity(spark, sf):
    """Of the assignment by region."""
    nodes, edges = _trade(spark, sf, loops=False)
    given = tables.read(spark, sf, "nation").select(F.format_string("Nation:%d", "n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))
    return spark.createDataFrame([(round(louvain.modularity(given, edges), 9),)], "modularity double")


_MOD = f"""WITH e AS MATERIALIZED ({_WHOLE}), m AS (SELECT count(*) AS m FROM e), d AS (SELECT src, count(*) AS d FROM e GROUP BY 1)
SELECT round(sum((1 - coalesce(x.d, 0) * coalesce(y.d, 0) / (2.0::DOUBLE * m)) / (2.0::DOUBLE * m)), 9) AS modularity FROM e JOIN m ON true JOIN nation a ON a.n_nationkey = e.src JOIN nation b ON b.n_nationkey = e.dst LEFT JOIN d x ON x.src = e.src LEFT JOIN d y ON y.src = e.dst WHERE a.n_regionkey = b.n_regionkey"""


def q_louvain(spark, sf):
    return louvain.louvain(*_parts(spark, sf)).assignment


def q_louvain_parallel(spark, sf):
    return louvain.louvain(*_parts(spark, sf), max_iterations=10, exact=False).assignment


def q_node2vec(spark, sf):
    return node2vec.node2vec(*_trade(spark, sf), walk_length=6, walks_per_node=4, p=0.5, q=2.0, seed=7)


def q_node2vec_counts(spark, sf):
    return q_node2vec(spark, sf).where("step = 0").groupBy("id").agg(F.count("*").alias("walks"))


def q_degree_out(spark, sf):
    g = tables.shop_graph(spark, sf)
    return triangles.out_degrees(g.vertex_frame("Customer"), g.edge_frame("PLACED"))


def q_degree_undirected(spark, sf):
    return triangles.undirected_degrees(*_parts(spark, sf))


# --- lookups
def q_lookup_property(spark, sf):
    return tables.shop_graph(spark, sf).nodes_by_property("nationkey", 7).select("_node_id", "name")


def q_lookup_label(spark, sf):
    m = index.IndexManager(tables.shop_graph(spark, sf))
    m.create_hash_index("debtors", label="Debtor")
    return m.lookup_label("Debtor")


def q_range_property(spark, sf):
    m = index.IndexManager(tables.shop_graph(spark, sf))
    m.create_btree_index("sizes", property="size")
    return m.range_property("size", 10, 13)


def q_index_stats(spark, sf):
    return index.entry_stats(index.property_entries(tables.shop_graph(spark, sf), "mktsegment")).withColumn("avg_values_per_key", F.round("avg_values_per_key", 6))


def q_out_edges(spark, sf):
    return tables.shop_graph(spark, sf).out_edges("Order:7").select("_src", "_dst", "_type", "quantity")


def q_in_edges(spark, sf):
    return tables.shop_graph(spark, sf).in_edges("Nation:5").select("_src", "_dst", "_type")


def q_edges_by_type(spark, sf):
    return tables.shop_graph(spark, sf).edges_by_type("FROM_NATION").select("_edge_id", "_src", "_dst")


def q_point_lookup(spark, sf):
    return tables.shop_graph(spark, sf).node("Customer:42").select("_node_id", "name", "acctbal")


def q_label_counts(spark, sf):
    return tables.shop_graph(spark, sf).label_counts()


# --- mutations
def q_create(spark, sf):
    g = tables.shop_graph(spark, sf).apply("MATCH (n:Nation), (r:Region {regionkey: 0}) CREATE (n)-[:LIKES {w: n.nationkey * 2}]->(r)")
    return g.cypher("MATCH (n)-[l:LIKES]->(r) RETURN n.name AS n, r.name AS r, l.w AS w")


def q_merge(spark, sf):
    g = tables.shop_graph(spark, sf).apply("MATCH (n:Nation {nationkey: 3}), (r:Region) MERGE (n)-[:IN_REGION]->(r)")
    return g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.nationkey AS n, r.regionkey AS r")


def q_set(spark, sf):
    g = tables.shop_graph(spark, sf).apply("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation {nationkey: 2}) SET c.mktsegment = 'X' + n.name, c.flag = true")
    return g.cypher("MATCH (c:Customer) RETURN c.custkey AS custkey, c.mktsegment AS seg, c.flag AS flag")


def q_delete_edges(spark, sf):
    g = tables.shop_graph(spark, sf).apply("MATCH (o:Order)-[i:CONTAINS]->(p) WHERE i.quantity > 10 DELETE i")
    return g.cypher("MATCH (o)-[i:CONTAINS]->(p) RETURN count(*) AS n, round(sum(i.extendedprice), 2) AS s")


def q_cascade_delete(spark, sf):
    g = tables.shop_graph(spark, sf).apply("MATCH (n:Nation {regionkey: 2}) DELETE n")
    return g.cypher("MATCH (a)-[r]->(b) RETURN type(r) AS t, count(*) AS n")


# --- versions and logs, with the orders as history
def _versions(spark, sf):
    o = tables.read(spark, sf, "orders")
    day = F.datediff("o_orderdate", F.lit("1992-01-01"))
    return o.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") % 50).alias("xmin"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 50 + 10).alias("xmax"), day.alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, day + 100).alias("deleted_at"))


_VERSIONS = "SELECT o_custkey AS entity, o_orderkey AS version, o_orderkey % 50 AS xmin, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 + 10 END AS xmax, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 100 END AS deleted_at FROM orders"


def q_mvcc_visible_at(spark, sf):
    return mvcc.visible_at(_versions(spark, sf), 2000).select("entity", "version")


def q_mvcc_visible_to(spark, sf):
    return mvcc.visible_to(_versions(spark, sf), mvcc.Snapshot(30, frozenset({5, 11}))).select("entity", "version")


def q_version_latest(spark, sf):
    return mvcc.latest(mvcc.visible_at(_versions(spark, sf), 1500)).select("entity", "version")


def q_version_gc(spark, sf):
    return mvcc.collect_garbage(_versions(spark, sf), 1200).groupBy().agg(F.count("*").alias("n"))


def _log(spark, sf):
    """Customers inserted, some updated by their orders, some deleted; a transaction per customer, every fifth open."""
    c, o = tables.read(spark, sf, "customer"), tables.read(spark, sf, "orders")
    none = F.lit(None).cast("string")

    def rows(df, lsn, txn, op, entity, labels=F.lit(None).cast("array<string>"), src=none, dst=none, type_=none, props=none):
        return df.select(lsn.cast("long").alias("lsn"), txn.cast("long").alias("txn_id"), F.lit(op).alias("op"), entity.alias("entity"), labels.alias("labels"), src.alias("src"), dst.alias("dst"), type_.alias("type"), props.alias("props"))

    k, ok = F.col("c_custkey"), F.col("o_orderkey")
    who = F.concat(F.lit("c"), k.cast("string"))
    parts = [
        rows(c, k, k, "insert_node", who, F.array(F.lit("Customer")), props=F.lit("{}")),
        rows(o, ok + 10**8, F.col("o_custkey"), "update_node", F.concat(F.lit("c"), F.col("o_custkey").cast("string")), props=F.concat(F.lit('{"o":'), ok.cast("string"), F.lit("}"))),
        rows(o, ok + 2 * 10**8, F.col("o_custkey"), "insert_edge", F.concat(F.lit("e"), ok.cast("string")), src=F.concat(F.lit("c"), F.col("o_custkey").cast("string")), dst=F.lit("c0"), type_=F.lit("T")),
        rows(c.where("c_custkey % 7 = 3"), k + 3 * 10**8, k, "delete_node", who),
        rows(c.where("c_custkey % 5 <> 0"), k + 4 * 10**8, k, "commit", none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def q_wal_replay_nodes(spark, sf):
    return mutation_log.replay(_log(spark, sf))[0].select("entity", "props")


def q_wal_replay_edges(spark, sf):
    return mutation_log.replay(_log(spark, sf))[1].select("entity", "src")


def q_wal_replayed_count(spark, sf):
    return spark.createDataFrame([(mutation_log.replayed_count(_log(spark, sf)),)], "n long")


def q_deadlock_reach(spark, sf):
    """What nation 0 waits for when each nation waits for its heaviest partners."""
    return traversal.bfs(*_thin(spark, sf), "Nation:0").where("distance > 0").select("id")


def q_deadlock_cycles(spark, sf):
    """Nations that are on, or between, cycles of their single heaviest partner."""
    e = tables.trades_with(spark, sf, 1).select("src", "dst")
    return mvcc.wait_cycles(e)


_CYCLES = f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM ({_TRADE}) WHERE src <> dst) WHERE r = 1), w(s, id) AS (SELECT src, dst FROM e UNION SELECT w.s, e.dst FROM w JOIN e ON e.src = w.id) SELECT s AS id FROM w WHERE s = id"


def q_snapshot_keep_n(spark, sf):
    """The newest three orders of each customer."""
    o = tables.read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return store.newest(o, 3, "o_orderkey", "o_custkey")


# --- files
def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/io-{name}-{uuid.uuid4().hex}"


def q_csv_roundtrip(spark, sf):
    path = _scratch(spark, "csv")
    c = tables.read(spark, sf, "customer")
    c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_acctbal") < 0, F.lit("Customer; Debtor")).otherwise(F.lit("Customer")).alias("labels"), "c_name", "c_nationkey", "c_acctbal", (F.col("c_acctbal") > 0).alias("active")).write.csv(path, header=True)
    g = importer.import_csv_nodes(Graph(spark), path).graph
    return g.cypher("MATCH (n:Customer) RETURN id(n) IS NOT NULL AS known, n.c_name AS name, n.c_nationkey + 1 AS k, n.c_acctbal AS bal, n.active AS active, size(labels(n)) AS labels")


def q_csv_import_edges(spark, sf):
    """Orders as edges of customers, a tenth of whom are not there: rejects by reason, and the imported ones."""
    nodes, edges = _scratch(spark, "csv"), _scratch(spark, "csv")
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    tables.read(spark, sf, "customer").where("c_custkey % 10 <> 0").select(name("c_custkey").alias("id")).write.csv(nodes, header=True)
    tables.read(spark, sf, "orders").select(name("o_custkey").alias("from"), name("o_custkey").alias("to"), F.lit("ORDERED").alias("type"), F.col("o_orderkey").alias("key")).write.csv(edges, header=True)
    r = importer.import_csv_edges(importer.import_csv_nodes(Graph(spark), nodes).graph, edges, importer.ImportOptions(max_errors=0))
    good = r.graph.cypher("MATCH (a)-[o:ORDERED]->(b) RETURN 'imported' AS reason, count(o.key) AS n")
    return r.rejects.groupBy("reason").agg(F.count("*").alias("n")).unionByName(good)


def q_json_roundtrip(spark, sf):
    path = _scratch(spark, "json")
    n = tables.read(spark, sf, "nation")
    n.select(F.format_string("n%d", "n_nationkey").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.array("n_nationkey").alias("list")).alias("properties")).write.json(path)
    edges = _scratch(spark, "json")
    n.select(F.format_string("n%d", "n_nationkey").alias("from"), F.format_string("n%d", "n_regionkey").alias("to"), F.lit("NEXT").alias("type"), F.struct(F.col("n_nationkey").alias("w")).alias("properties")).write.json(edges)
    g = importer.import_json_nodes(Graph(spark), path).graph
    g = importer.import_json_edges(g, edges).graph
    return g.cypher("MATCH (a:Nation)-[r:NEXT]->(b) RETURN a.name AS a, b.name AS b, r.w AS w, a.list AS list")


def q_csv_infer_types(spark, sf):
    texts = ["true", "TRUE", "false", "42", "-100", "3.14", "-2.5", "hello", "123abc", " 7 ", "", "1e5", "inf", "1.5d", "9223372036854775808"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return df.select("i", importer.infer_value(F.col("t")).alias("kind"))


_INFER = "SELECT CAST(i AS INTEGER) AS i, kind FROM (VALUES (0,'bool'),(1,'bool'),(2,'bool'),(3,'int'),(4,'int'),(5,'float'),(6,'float'),(7,'str'),(8,'str'),(9,'int'),(10,NULL),(11,'float'),(12,'float'),(13,'str'),(14,'float')) v(i, kind)"


def q_edge_reject_antijoin(spark, sf):
    """Orders whose customer is missing once some customers are left out."""
    g = tables.shop_graph(spark, sf)
    t = g.nodes["Customer"]
    g = g.with_node_table(NodeTable("Customer", t.df.where("c_custkey % 10 <> 0"), t.key, t.labels, t.props, t.extra))
    return mutate.dangling(g, "PLACED").select("o_orderkey")


def q_parquet_roundtrip(spark, sf):
    path = _scratch(spark, "graph")
    g = tables.shop_graph(spark, sf)
    small = Graph(spark, {k: g.nodes[k] for k in ("Nation", "Region", "Supplier")}, {k: g.edges[k] for k in ("IN_REGION", "SUPPLIER_FROM")})
    store.save(small, path)
    return store.open_graph(spark, path).cypher("MATCH (s:Supplier)-[:FROM_NATION]->(n)-[:IN_REGION]->(r) RETURN r.name AS region, count(*) AS n, round(sum(s.acctbal), 2) AS bal")


FUNCTIONS: dict[str, tuple[Callable, str | None]] = {
    "bfs": (q_bfs, _BFS.format(depth=30)),
    "bfs_max_depth": (q_bfs_max_depth, _BFS.format(depth=2)),
    "dfs_tree": (q_dfs_tree, _DFS),
    "dijkstra": (q_dijkstra, f"WITH RECURSIVE e AS MATERIALIZED ({_THIN}), w(id, c, d) AS (SELECT 0, 0, 0.0::DOUBLE UNION SELECT e.dst, w.c + 1, w.d + e.weight FROM w JOIN e ON e.src = w.id WHERE w.c < 8) SELECT 'Nation:' || id AS id, min(d) AS distance FROM w GROUP BY 1"),
    "components": (q_components, _COMPONENTS),
    "component_sizes": (q_component_sizes, _SIZES),
    "pagerank_k10": (q_pagerank, _pagerank_sql(10)),
    "pagerank_top": (q_pagerank_top, f"SELECT * FROM ({_pagerank_sql(10)}) ORDER BY score DESC, id LIMIT 5"),
    "triangles": (q_triangles, f"{_TRI} SELECT (SELECT count(*) FROM t) AS total, round(coalesce(avg(coefficient) FILTER (degree >= 2), 0), 9) AS mean_coefficient FROM f"),
    "clustering": (q_clustering, f"{_TRI} SELECT id, triangles, degree, round(coefficient, 9) AS coefficient FROM f"),
    "modularity": (q_modularity, _MOD),
    "louvain": (q_louvain, None),
    "louvain_parallel": (q_louvain_parallel, None),
    "node2vec": (q_node2vec, None),
    "node2vec_counts": (q_node2vec_counts, "SELECT 'Nation:' || n_nationkey AS id, CAST(4 AS BIGINT) AS walks FROM nation"),
    "degree_out": (q_degree_out, "SELECT 'Customer:' || c_custkey AS id, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "degree_undirected": (q_degree_undirected, f"{_TRI} SELECT id, degree FROM f"),
    "lookup_property": (q_lookup_property, "SELECT 'Customer:' || c_custkey AS _node_id, c_name AS name FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'Supplier:' || s_suppkey, s_name FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT 'Nation:' || n_nationkey, n_name FROM nation WHERE n_nationkey = 7"),
    "lookup_label": (q_lookup_label, "SELECT 'Customer:' || c_custkey AS id FROM customer WHERE c_acctbal < 0"),
    "range_property": (q_range_property, "SELECT 'Part:' || p_partkey AS id FROM part WHERE p_size >= 10 AND p_size < 13"),
    "index_stats": (q_index_stats, "SELECT count(*) AS total_keys, CAST(sum(n) AS BIGINT) AS total_values, max(n) AS max_values_per_key, round(avg(n), 6) AS avg_values_per_key FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)"),
    "out_edges": (q_out_edges, "SELECT 'Order:' || l_orderkey AS _src, 'Part:' || l_partkey AS _dst, 'CONTAINS' AS _type, l_quantity AS quantity FROM lineitem WHERE l_orderkey = 7 UNION ALL SELECT 'Order:' || l_orderkey, 'Supplier:' || l_suppkey, 'SUPPLIED_BY', l_quantity FROM lineitem WHERE l_orderkey = 7"),
    "in_edges": (q_in_edges, "SELECT 'Customer:' || c_custkey AS _src, 'Nation:5' AS _dst, 'FROM_NATION' AS _type FROM customer WHERE c_nationkey = 5 UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:5', 'FROM_NATION' FROM supplier WHERE s_nationkey = 5"),
    "edges_by_type": (q_edges_by_type, "SELECT 'CUSTOMER_FROM:' || c_custkey AS _edge_id, 'Customer:' || c_custkey AS _src, 'Nation:' || c_nationkey AS _dst FROM customer UNION ALL SELECT 'SUPPLIER_FROM:' || s_suppkey, 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey FROM supplier"),
    "point_lookup": (q_point_lookup, "SELECT 'Customer:42' AS _node_id, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey = 42"),
    "label_counts": (q_label_counts, STATEMENTS["scan_all_counts"][1].replace("AS n FROM region", "AS nodes FROM region", 1) + " UNION ALL SELECT 'Debtor', count(*) FROM customer WHERE c_acctbal < 0"),
    "create": (q_create, "SELECT n_name AS n, r_name AS r, CAST(n_nationkey * 2 AS BIGINT) AS w FROM nation, region WHERE r_regionkey = 0"),
    "merge": (q_merge, "SELECT n_nationkey AS n, n_regionkey AS r FROM nation UNION SELECT 3, r_regionkey FROM region"),
    "set": (q_set, "SELECT c_custkey AS custkey, CASE WHEN c_nationkey = 2 THEN 'X' || n_name ELSE c_mktsegment END AS seg, CASE WHEN c_nationkey = 2 THEN true END AS flag FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "delete_edges": (q_delete_edges, "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity <= 10"),
    "cascade_delete": (q_cascade_delete, "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'FROM_NATION', (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'DID', count(*) FROM events"),
    "mvcc_visible_at": (q_mvcc_visible_at, f"SELECT entity, version FROM ({_VERSIONS}) WHERE created_at <= 2000 AND (deleted_at IS NULL OR deleted_at > 2000)"),
    "mvcc_visible_to": (q_mvcc_visible_to, f"SELECT entity, version FROM ({_VERSIONS}) WHERE xmin < 30 AND xmin NOT IN (5, 11) AND (xmax IS NULL OR NOT (xmax < 30 AND xmax NOT IN (5, 11)))"),
    "version_latest": (q_version_latest, f"SELECT entity, max(version) AS version FROM ({_VERSIONS}) WHERE created_at <= 1500 AND (deleted_at IS NULL OR deleted_at > 1500) GROUP BY 1"),
    "version_gc": (q_version_gc, f"SELECT count(*) AS n FROM ({_VERSIONS}) WHERE deleted_at IS NULL OR deleted_at >= 1200"),
    "wal_replay_nodes": (q_wal_replay_nodes, "SELECT 'c' || c_custkey AS entity, coalesce('{\"o\":' || max(o_orderkey) || '}', '{}') AS props FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 3 GROUP BY c_custkey"),
    "wal_replay_edges": (q_wal_replay_edges, "SELECT 'e' || o_orderkey AS entity, 'c' || o_custkey AS src FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 7 <> 3"),
    "wal_replayed_count": (q_wal_replayed_count, "SELECT (SELECT 2 * count(*) + count(*) FILTER (c_custkey % 7 = 3) FROM customer WHERE c_custkey % 5 <> 0) + (SELECT 2 * count(*) FROM orders WHERE o_custkey % 5 <> 0) AS n"),
    "deadlock_reach": (q_deadlock_reach, f"SELECT id FROM ({_BFS.format(depth=30)}) WHERE distance > 0"),
    "deadlock_cycles": (q_deadlock_cycles, _CYCLES),
    "snapshot_keep_n": (q_snapshot_keep_n, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3"),
    "csv_roundtrip": (q_csv_roundtrip, "SELECT true AS known, c_name AS name, CAST(c_nationkey + 1 AS BIGINT) AS k, c_acctbal AS bal, c_acctbal > 0 AS active, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS BIGINT) AS labels FROM customer"),
    "csv_import_edges": (q_csv_import_edges, "SELECT 'source not found: c' || o_custkey AS reason, count(*) AS n FROM orders WHERE o_custkey % 10 = 0 GROUP BY 1 UNION ALL SELECT 'imported', count(*) FROM orders WHERE o_custkey % 10 <> 0"),
    "json_roundtrip": (q_json_roundtrip, "SELECT a.n_name AS a, b.n_name AS b, CAST(a.n_nationkey AS BIGINT) AS w, '[' || a.n_nationkey || ']' AS list FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey"),
    "csv_infer_types": (q_csv_infer_types, _INFER),
    "edge_reject_antijoin": (q_edge_reject_antijoin, "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0"),
    "parquet_roundtrip": (q_parquet_roundtrip, "SELECT r_name AS region, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
}


def _statement(text: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: tables.shop_graph(spark, sf).cypher(text, params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _statement(s[0], s[2] if len(s) > 2 else {}) for n, s in STATEMENTS.items()} | {n: f for n, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s[1] for n, s in STATEMENTS.items()} | {n: sql for n, (_, sql) in FUNCTIONS.items() if sql}
