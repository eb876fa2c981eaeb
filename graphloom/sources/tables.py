"""The benchmark tables as a property graph."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import EdgeTable, Graph, NodeTable

#: Heaviest trading partners that each nation keeps in the thinned trade graph.
TOP_PARTNERS = 3


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _props(df: DataFrame, prefix: str, skip: tuple[str, ...] = ()) -> dict[str, str]:
    return {c.removeprefix(prefix): c for c in df.columns if c not in skip}


def shop_graph(spark: SparkSession, folder: str) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, users and event types, and how they connect."""
    t = {n: read(spark, folder, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    g = Graph(spark)
    for label, name, prefix, key in (("Region", "region", "r_", "r_regionkey"), ("Nation", "nation", "n_", "n_nationkey"), ("Customer", "customer", "c_", "c_custkey"), ("Supplier", "supplier", "s_", "s_suppkey"), ("Part", "part", "p_", "p_partkey"), ("Order", "orders", "o_", "o_orderkey")):
        extra = {"Debtor": "c_acctbal < 0"} if label == "Customer" else {}
        g = g.with_node_table(NodeTable(label, t[name], key, (label,), _props(t[name], prefix), extra))
    users = t["events"].select("user_id").where("user_id is not null").distinct()
    kinds = t["events"].select(F.col("event_type").alias("name")).where("name is not null").distinct()
    g = g.with_node_table(NodeTable("User", users, "user_id", ("User",), {"userid": "user_id"}))
    g = g.with_node_table(NodeTable("EventType", kinds, "name", ("EventType",), {"name": "name"}))
    line = {p: f"l_{p}" for p in ("linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")}
    for e in (
        EdgeTable("IN_REGION", "IN_REGION", t["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey"), {}, "n_nationkey"),
        EdgeTable("CUSTOMER_FROM", "FROM_NATION", t["customer"], ("Customer", "c_custkey"), ("Nation", "c_nationkey"), {}, "c_custkey"),
        EdgeTable("SUPPLIER_FROM", "FROM_NATION", t["supplier"], ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), {}, "s_suppkey"),
        EdgeTable("PLACED", "PLACED", t["orders"], ("Customer", "o_custkey"), ("Order", "o_orderkey"), {"orderdate": "o_orderdate"}, "o_orderkey"),
        EdgeTable("CONTAINS", "CONTAINS", t["lineitem"], ("Order", "l_orderkey"), ("Part", "l_partkey"), line),
        EdgeTable("SUPPLIED_BY", "SUPPLIED_BY", t["lineitem"], ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), {"quantity": "l_quantity"}),
        EdgeTable("DID", "DID", t["events"].where("user_id is not null and event_type is not null"), ("User", "user_id"), ("EventType", "event_type"), {"ts": "ts", "value": "value"}, "event_id"),
    ):
        g = g.with_edge_table(e)
    return g


def co_ordered(spark: SparkSession, folder: str, least: int = 2) -> DataFrame:
    """(src, dst, weight): parts that share at least that many orders, the smaller key first."""
    items = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = items.select("l_orderkey", F.col("l_partkey").alias("src")), items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def trades_with(spark: SparkSession, folder: str, top: int | None = None) -> DataFrame:
    """(src, dst, weight): customer nation to supplier nation by distinct orders; ``top`` keeps each nation's heaviest targets."""
    orders, lines = read(spark, folder, "orders").select("o_orderkey", "o_custkey"), read(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    customer, supplier = read(spark, folder, "customer").select("c_custkey", "c_nationkey"), read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).select("l_orderkey", "s_nationkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count_distinct("l_orderkey").alias("weight"))
    if top is None:
        return out
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return out.where("src <> dst").withColumn("r", rank).where(F.col("r") <= top).drop("r")


def trade_graph(spark: SparkSession, folder: str, top: int | None = None) -> Graph:
    """Nations and TRADES_WITH."""
    nation = read(spark, folder, "nation")
    edges = trades_with(spark, folder, top).withColumn("ekey", F.concat_ws("-", "src", "dst"))
    g = Graph(spark).with_node_table(NodeTable("Nation", nation, "n_nationkey", ("Nation",), _props(nation, "n_")))
    return g.with_edge_table(EdgeTable("TRADES_WITH", "TRADES_WITH", edges, ("Nation", "src"), ("Nation", "dst"), {"weight": "weight"}, "ekey"))


def part_graph(spark: SparkSession, folder: str, least: int = 2) -> Graph:
    """Parts and CO_ORDERED."""
    part = read(spark, folder, "part")
    edges = co_ordered(spark, folder, least).withColumn("ekey", F.concat_ws("-", "src", "dst"))
    g = Graph(spark).with_node_table(NodeTable("Part", part, "p_partkey", ("Part",), _props(part, "p_")))
    return g.with_edge_table(EdgeTable("CO_ORDERED", "CO_ORDERED", edges, ("Part", "src"), ("Part", "dst"), {"weight": "weight"}, "ekey"))
