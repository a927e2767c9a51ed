"""The graph over the star-schema tables: customers, orders, parts, suppliers, nations, users, documents, vectors.

Node ids are label ordinal * 2^40 + key, so they are made row by row. Relationships with a key of their own get ids
the same way; those without (order lines, supplies, hand-offs) get a 63-bit hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph

LABELS = ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Document", "Vector", "User")
SHIFT = 1 << 40


def node_id(label: str, key: str) -> Column:
    return (F.lit(LABELS.index(label) * SHIFT).cast("long") + F.col(key)).cast("long")


def row_hash(*cols: str) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))


def star_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph of a folder of <table>.parquet."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")

    def nodes(label: str, table: DataFrame, key: str, **props: str) -> DataFrame:
        return table.select(node_id(label, key).alias("_id"), *(F.col(c).alias(n) for n, c in props.items()))

    region, nation, customer, supplier, part, orders, lines = map(read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    events, documents, vectors = map(read, ("events", "documents", "embeddings"))
    tables = {
        "Region": nodes("Region", region, "r_regionkey", regionkey="r_regionkey", name="r_name"),
        "Nation": nodes("Nation", nation, "n_nationkey", nationkey="n_nationkey", name="n_name", regionkey="n_regionkey"),
        "Customer": nodes("Customer", customer, "c_custkey", custkey="c_custkey", name="c_name", nationkey="c_nationkey", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        "Supplier": nodes("Supplier", supplier, "s_suppkey", suppkey="s_suppkey", name="s_name", nationkey="s_nationkey", acctbal="s_acctbal"),
        "Part": nodes("Part", part, "p_partkey", partkey="p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", retailprice="p_retailprice"),
        "Order": nodes("Order", orders, "o_orderkey", orderkey="o_orderkey", custkey="o_custkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"),
        "Document": nodes("Document", documents, "doc_id", doc_id="doc_id", text="text", lang="lang", source="source", n_chars="n_chars"),
        "Vector": nodes("Vector", vectors, "vec_id", vec_id="vec_id", embedding="embedding", cluster="label"),
        "User": nodes("User", events.select("user_id").distinct(), "user_id", user_id="user_id"),
    }

    def rels(table: DataFrame, ident: Column, src: Column, dst: Column, **props: str) -> DataFrame:
        return table.select(ident.alias("_id"), src.alias("_src"), dst.alias("_dst"), *(F.col(c).alias(n) for n, c in props.items()))

    keyed = lambda ordinal, key: (F.lit(ordinal * SHIFT).cast("long") + F.col(key)).cast("long")
    line = row_hash("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    day = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    handoff = events.select("event_type", "user_id", F.lead("user_id").over(day).alias("next")).filter("next IS NOT NULL AND next <> user_id").distinct()
    links = [
        ("IN_REGION", "Nation", "Region", rels(nation, keyed(1, "n_nationkey"), node_id("Nation", "n_nationkey"), node_id("Region", "n_regionkey"))),
        ("IN_NATION", "Customer", "Nation", rels(customer, keyed(2, "c_custkey"), node_id("Customer", "c_custkey"), node_id("Nation", "c_nationkey"))),
        ("IN_NATION", "Supplier", "Nation", rels(supplier, keyed(3, "s_suppkey"), node_id("Supplier", "s_suppkey"), node_id("Nation", "s_nationkey"))),
        ("PLACED", "Customer", "Order", rels(orders, keyed(4, "o_orderkey"), node_id("Customer", "o_custkey"), node_id("Order", "o_orderkey"))),
        ("CONTAINS", "Order", "Part", rels(lines, line, node_id("Order", "l_orderkey"), node_id("Part", "l_partkey"), quantity="l_quantity", price="l_extendedprice", discount="l_discount", tax="l_tax", linenumber="l_linenumber", returnflag="l_returnflag", linestatus="l_linestatus", shipdate="l_shipdate")),
        ("SUPPLIED_BY", "Order", "Supplier", rels(lines, line, node_id("Order", "l_orderkey"), node_id("Supplier", "l_suppkey"), quantity="l_quantity")),
        ("SUPPLIES", "Supplier", "Part", rels(lines.select("l_suppkey", "l_partkey").distinct(), row_hash("l_suppkey", "l_partkey"), node_id("Supplier", "l_suppkey"), node_id("Part", "l_partkey"))),
        ("HANDOFF", "User", "User", rels(handoff, row_hash("event_type", "user_id", "next"), node_id("User", "user_id"), node_id("User", "next"), kind="event_type")),
    ]
    return PropertyGraph.of(spark, tables, links)
