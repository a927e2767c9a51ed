"""Idempotent ingest: batches of nodes, relationships and grants, keyed by external_id.

Batches are tables: nodes (external_id, label, properties), relationships (external_id, from_external_id,
to_external_id, rel_type, properties) with properties as JSON text, grants (external_id, principal). The store keeps
external ids and internal ids; ids of new nodes are hashes of external ids, so a rerun gives the same ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph

NODES = "external_id string, label string, properties string"
RELS = "external_id string, from_external_id string, to_external_id string, rel_type string, properties string"
GRANTS = "external_id string, principal string"


def hashed(external: Column) -> Column:
    return F.xxhash64(external).bitwiseAND(F.lit((1 << 63) - 1))


@dataclass(frozen=True)
class Store:
    """Everything ingested so far, as tables."""

    nodes: DataFrame
    rels: DataFrame
    grants: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], RELS), spark.createDataFrame([], GRANTS))

    def graph(self) -> PropertyGraph:
        """Typed tables: the properties of each label and type are inferred from their JSON."""
        spark = self.nodes.sparkSession
        labels = [r[0] for r in self.nodes.select("label").distinct().orderBy("label").collect()]
        nodes = {x or "": typed(self.nodes.filter(F.col("label").eqNullSafe(F.lit(x))), [hashed(F.col("external_id")).alias("_id"), F.col("external_id")]) for x in labels}
        of = self.nodes.select(F.col("external_id").alias("_e"), F.col("label").alias("_l"))
        ends = self.rels.join(of.withColumnRenamed("_l", "_sl"), F.col("from_external_id") == F.col("_e")).drop("_e").join(of.withColumnRenamed("_l", "_dl"), F.col("to_external_id") == F.col("_e")).drop("_e")
        kinds = [tuple(r) for r in ends.select("rel_type", "_sl", "_dl").distinct().orderBy("rel_type", "_sl", "_dl").collect()]
        head = [hashed(F.concat(F.lit("rel:"), F.col("external_id"))).alias("_id"), hashed(F.col("from_external_id")).alias("_src"), hashed(F.col("to_external_id")).alias("_dst")]
        rels = [(t, a, b, typed(ends.filter((F.col("rel_type") == t) & (F.col("_sl") == a) & (F.col("_dl") == b)), head)) for t, a, b in kinds]
        acl = self.grants.select(hashed(F.col("external_id")).alias("node_id"), "principal")
        return PropertyGraph.of(spark, nodes, rels, acl=acl)


def typed(rows: DataFrame, head: list[Column]) -> DataFrame:
    st = _schema(rows)
    if st is None:
        return rows.select(*head)
    out = rows.select(*head, F.from_json("properties", st).alias("_p"))
    return out.select(*[n for n in out.columns if n != "_p"], *(F.col("_p").getField(f.name).alias(f.name) for f in st.fields if f.name not in out.columns))


def _schema(rows: DataFrame) -> T.StructType | None:
    """The union of all rows' keys and types, aggregated in the JVM. Mixed kinds become text."""
    text = rows.agg(F.schema_of_variant_agg(F.parse_json(F.coalesce("properties", F.lit("{}"))))).first()[0]
    if not text or not text.startswith("OBJECT<") or text == "OBJECT<>":
        return None
    text = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", text.replace("OBJECT<>", "STRING").replace("OBJECT<", "STRUCT<"))
    return T._parse_datatype_string(re.sub(r"\b(VOID|VARIANT)\b", "STRING", text))


def ingest(store: Store, nodes: DataFrame | None = None, rels: DataFrame | None = None, grants: DataFrame | None = None) -> tuple[Store, DataFrame]:
    """The store after a batch, and an outcome for each record: created, unchanged, conflict or missing_endpoint.

    A record with a known external_id changes nothing: the same content is 'unchanged', other content a 'conflict'.
    Records that repeat an id inside a batch count once if equal; of different ones the least content stands, the rest conflict.
    """
    outcomes = None

    def add(part: DataFrame) -> None:
        nonlocal outcomes
        outcomes = part if outcomes is None else outcomes.unionByName(part)

    def content(names: list[str]) -> Column:
        return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})

    def merged(old: DataFrame, batch: DataFrame, kind: str, names: list[str]) -> DataFrame:
        batch = batch.select("external_id", *names).withColumn("_c", content(names)).distinct()
        known = old.select("external_id", content(names).alias("_k"))
        first = batch.groupBy("external_id").agg(F.min("_c").alias("_f"))
        found = batch.join(first, "external_id").join(known, "external_id", "left")
        state = F.when(F.col("_k").isNull(), F.when(F.col("_c") == F.col("_f"), "created").otherwise("conflict")).when(F.col("_k") == F.col("_c"), "unchanged").otherwise("conflict")
        found = found.withColumn("outcome", state)
        add(found.select(F.lit(kind).alias("kind"), "external_id", "outcome"))
        return old.unionByName(found.filter("outcome = 'created'").select("external_id", *names))

    out = store
    if nodes is not None:
        out = replace(out, nodes=merged(out.nodes, nodes, "node", ["label", "properties"]))
    if rels is not None:
        ids = out.nodes.select("external_id").distinct()
        names = ["from_external_id", "to_external_id", "rel_type", "properties"]
        has = lambda side: ids.select(F.col("external_id").alias(f"{side}_external_id"), F.lit(True).alias(f"_{side}"))
        checked = rels.join(has("from"), "from_external_id", "left").join(has("to"), "to_external_id", "left")
        ok = F.col("_from").isNotNull() & F.col("_to").isNotNull()
        add(checked.filter(~ok).select(F.lit("relationship").alias("kind"), "external_id", F.lit("missing_endpoint").alias("outcome")))
        out = replace(out, rels=merged(out.rels, checked.filter(ok).select("external_id", *names), "relationship", names))
    if grants is not None:
        known = out.grants
        out = replace(out, grants=known.unionByName(grants.select("external_id", "principal").distinct().join(known, ["external_id", "principal"], "left_anti")))
    if outcomes is None:
        outcomes = store.nodes.sparkSession.createDataFrame([], "kind string, external_id string, outcome string")
    return out, outcomes
