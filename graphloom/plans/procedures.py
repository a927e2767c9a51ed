"""CALL procedures and SHOW: catalog tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph
from . import ast as A
from .parser import QueryError

VERSION = "1.0.0"


def type_name(t: T.DataType) -> str:
    names = {T.LongType: "INTEGER", T.DoubleType: "FLOAT", T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.ArrayType: "LIST", T.DateType: "DATE", T.TimestampType: "DATE_TIME", T.TimestampNTZType: "LOCAL_DATE_TIME"}
    return next((n for k, n in names.items() if isinstance(t, k)), "ANY")


def procedure(graph: PropertyGraph, k: A.Procedure, known: Callable) -> DataFrame:
    spark, name = graph.spark, k.name
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    node_props = {label: graph.node_props([label]) for label in graph.nodes}
    rel_props = {t: graph.rel_props(graph.segments_of([t])) for t in graph.types}
    if k.show:
        return show(graph, name)
    if name == "db.labels":
        return make([(x,) for x in sorted(graph.nodes) if x], "label string")
    if name == "db.relationshiptypes":
        return make([(x,) for x in sorted(graph.types)], "relationshipType string")
    if name == "db.propertykeys":
        return make([(x,) for x in sorted({p for ps in (*node_props.values(), *rel_props.values()) for p in ps})], "propertyKey string")
    if name == "apoc.meta.data":
        rows = [(label, [], "node", type_name(t), p) for label, ps in node_props.items() for p, t in ps.items()]
        rows += [(s.src, [s.dst], "node", "RELATIONSHIP", s.type) for s in graph.segments]
        rows += [(x, [], "relationship", type_name(t), p) for x, ps in rel_props.items() for p, t in ps.items()]
        return make(rows, "label string, other array<string>, elementType string, type string, property string")
    if name == "apoc.schema.nodes":
        rows = [(i["label"], [i["prop"]], "VECTOR" if i["vector"] else "RANGE") for i in graph.indexes]
        own = make(rows, "label string, properties array<string>, type string")
        return own.select("*", F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("valuesSelectivity"))
    if name == "db.schema.visualization":
        return make([(sorted(x for x in graph.nodes if x), sorted({f"{s.src}-{s.type}->{s.dst}" for s in graph.segments}))], "nodes array<string>, relationships array<string>")
    if name == "dbms.components":
        return make([("graphloom", [VERSION], "community")], "name string, versions array<string>, edition string")
    if name == "db.index.vector.querynodes":
        from ..operators.vector import top_k

        if len(k.args) != 3:
            raise QueryError("db.index.vector.queryNodes takes an index, k and a vector")
        index, n, query = (known(a) for a in k.args)
        found = next((i for i in graph.indexes if i["name"] == index and i["vector"]), None)
        if found is None:
            raise QueryError(f"no vector index {index}")
        if not isinstance(n, int) or isinstance(n, bool) or not isinstance(query, list | tuple):
            raise QueryError("k must be an integer and the query a list of numbers")
        return top_k(graph.scan([found["label"]], [found["prop"]]), "_id", found["prop"], [float(x) for x in query], n, found["metric"]).withColumnRenamed("_id", "node")
    raise QueryError(f"unknown procedure {name}")


def show(graph: PropertyGraph, what: str) -> DataFrame:
    spark = graph.spark
    if what == "constraints":
        return spark.createDataFrame([], "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>")
    if what == "databases":
        return spark.createDataFrame([("graph", "online", True)], "name string, currentStatus string, default boolean")
    rows = [(i["name"], "VECTOR" if i["vector"] else "RANGE", "NODE", [i["label"]], [i["prop"]]) for i in graph.indexes if i["vector"] or what == "indexes"]
    return spark.createDataFrame(rows, "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>")
