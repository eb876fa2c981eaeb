"""Headline queries, timed.  Prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.  Every query runs once to warm up and then
``$BENCH_RUNS`` times (default 3); the median counts.  Rates that the published figures use (rows or edges a second) are in
``rates``, settings in ``config``.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession, functions as F

from graphloom import queries as Q
from graphloom.model import Graph
from graphloom.operators import components, pagerank, paths, traversal, triangles
from graphloom.session import shared_dir, stage
from graphloom.sources import importer, tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ITERATIONS = 5


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shop = tables.shop_graph(spark, FOLDER)
    nodes = stage(shop.vertex_frame("Order", "Part"), "bench")
    edges = stage(shop.edge_frame("CONTAINS"), "bench")
    n_edges = edges.count()
    parts = tables.part_graph(spark, FOLDER, least=1)
    pair_nodes, pair_edges = parts.vertex_frame(), stage(parts.edge_frame(), "bench")
    csv_nodes, csv_edges = f"{shared_dir(spark)}/bench-nodes", f"{shared_dir(spark)}/bench-edges"
    orders = tables.read(spark, FOLDER, "orders")
    orders.select(F.col("o_orderkey").alias("id"), F.lit("Order").alias("labels"), "o_custkey", "o_totalprice", "o_orderpriority").write.mode("overwrite").csv(csv_nodes, header=True)
    orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("from"), (F.col("o_orderkey") - 1).alias("to"), F.lit("NEXT").alias("type"), "o_totalprice").write.mode("overwrite").csv(csv_edges, header=True)
    json_nodes = f"{shared_dir(spark)}/bench-json"
    orders.select(F.col("o_orderkey").cast("string").alias("id"), F.array(F.lit("Order")).alias("labels"), F.struct("o_custkey", "o_totalprice", "o_orderpriority").alias("properties")).write.mode("overwrite").json(json_nodes)
    n_orders = orders.count()
    imported = importer.import_csv_nodes(Graph(spark), csv_nodes).graph

    def rows(text: str):
        return lambda: shop.cypher(text).write.format("noop").mode("overwrite").save()

    work = {
        "label_scan": rows("MATCH (c:Customer) RETURN c.custkey AS k, c.name AS n, c.acctbal AS b"),
        "where_filter": rows("MATCH (c:Customer) WHERE c.acctbal > 9000 AND c.mktsegment = 'BUILDING' RETURN c.custkey AS k"),
        "order_limit": rows(Q.STATEMENTS["order_limit"][0]),
        "hop_1": rows("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS s, count(*) AS n"),
        "hop_2": rows("MATCH (o:Order)-[i:CONTAINS]->(p:Part) WHERE p.size > 10 RETURN o.orderpriority AS pri, sum(i.quantity) AS q"),
        "hop_3": rows(Q.FLAGSHIP),
        "point_lookup": lambda: shop.node("Customer:42").collect(),
        "range_lookup": lambda: shop.cypher("MATCH (p:Part) WHERE p.size >= 10 AND p.size < 13 RETURN p.partkey AS k").count(),
        "import_csv_nodes": lambda: importer.import_csv_nodes(Graph(spark), csv_nodes).graph.node_count(),
        "import_csv_edges": lambda: importer.import_csv_edges(imported, csv_edges).edges_imported,
        "import_json_nodes": lambda: importer.import_json_nodes(Graph(spark), json_nodes).graph.node_count(),
        "pagerank": lambda: pagerank.pagerank(nodes, edges, 0.85, ITERATIONS, 0.0),
        "components": lambda: components.roots(nodes, edges).count(),
        "triangles": lambda: triangles.triangle_summary(triangles.triangle_counts(pair_nodes, pair_edges)).collect(),
        "bfs": lambda: traversal.bfs(*Q._thin(spark, FOLDER), "Nation:0").count(),
        "dijkstra": lambda: paths.shortest_paths(*Q._thin(spark, FOLDER), "Nation:0").count(),
    }
    seconds = {}
    for name, run in work.items():
        run()
        taken = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            run()
            taken.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(taken), 4)
    rates = {
        "import_nodes_per_s": round(n_orders / seconds["import_csv_nodes"]),
        "import_edges_per_s": round((n_orders - 1) / seconds["import_csv_edges"]),
        "import_json_per_s": round(n_orders / seconds["import_json_nodes"]),
        "pagerank_edges_per_s": round(n_edges * ITERATIONS / seconds["pagerank"]),
        "hop_3_edges_per_s": round(n_edges / seconds["hop_3"]),
        "triangle_edges_per_s": round(pair_edges.count() / seconds["triangles"]),
    }
    config = {"cores": int(CPUS), "shuffle_partitions": int(CPUS), "runs": RUNS, "pagerank_iterations": ITERATIONS, "edges": n_edges}
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "rates": rates, "config": config}))
    spark.stop()


if __name__ == "__main__":
    main()
