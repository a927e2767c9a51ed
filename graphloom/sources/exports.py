"""Readers of graph exports: native NDJSON, CSV pairs, CREATE scripts. Each gives node and relationship tables in
one shape (ingest.batch), which ingest() turns into a graph."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans.parser import QueryError, parse_many

NDJSON = "kind string, external_id string, label_or_type long, float_bits string, opaque string, source_id string, target_id string"


def ieee754(bits: Column) -> Column:
    """The double of 16 hex digits, computed from sign, exponent and fraction."""
    high, low = F.conv(F.substring(bits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(bits, 9, 8), 16, 10).cast("long")
    sign = F.when(high >= 0x80000000, F.lit(-1.0)).otherwise(1.0)
    exponent = F.shiftright(high, 20).bitwiseAND(0x7FF)
    fraction = (high.bitwiseAND(0xFFFFF).cast("double") * float(1 << 32) + low.cast("double")) / float(1 << 52)
    return (
        F.when((exponent == 0x7FF) & (fraction > 0), F.lit(float("nan"))).when(exponent == 0x7FF, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))
    )


def native_ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (external_id, label, weight, opaque) and relationships (external_id, from, to, type, weight, opaque).

    A malformed record, or an end that is no node of the input, is an error when the tables are read.
    """
    rows = spark.read.schema(NDJSON + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    is_hex = lambda c: F.col(c).rlike(r"^([0-9a-fA-F]{2})*$")
    good = F.col("_corrupt").isNull() & F.col("kind").isin("node", "relationship") & is_hex("external_id") & is_hex("opaque") & F.col("float_bits").rlike(r"^[0-9a-fA-F]{16}$")
    good = good & ((F.col("kind") == "node") | is_hex("source_id") & is_hex("target_id"))
    rows = rows.withColumn("external_id", F.when(F.coalesce(good, F.lit(False)), F.lower("external_id")).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), F.coalesce("_corrupt", F.to_json(F.struct("kind", "external_id")))))))
    own = [F.col("external_id"), F.col("label_or_type"), ieee754(F.col("float_bits")).alias("weight"), F.unhex("opaque").alias("opaque")]
    nodes = rows.filter("kind = 'node'").select(*own).withColumnRenamed("label_or_type", "label")
    rels = rows.filter("kind = 'relationship'").select(*own, F.lower("source_id").alias("from"), F.lower("target_id").alias("to")).withColumnRenamed("label_or_type", "type")
    ids = nodes.select(F.col("external_id").alias("_n")).distinct()
    for end in ("from", "to"):
        rels = rels.join(ids, F.col(end) == F.col("_n"), "left")
        rels = rels.withColumn(end, F.when(F.col("_n").isNotNull(), F.col(end)).otherwise(F.raise_error(F.concat(F.lit(f"no node for {end} "), F.col(end))))).drop("_n")
    return nodes, rels


def _typed(text: Column) -> Column:
    """A CSV cell as JSON: numbers and Booleans as such, other text quoted, an empty cell as nothing."""
    t = F.trim(text)
    return F.when(t == "", None).when(t.rlike(r"^(true|false|-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?)$"), t).otherwise(F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2))


def _bag(df: DataFrame, skip: set[str]) -> Column:
    names = [n for n in df.columns if n not in skip]
    if not names:
        return F.lit("{}")
    parts = [F.when(_typed(F.col(f"`{n}`")).isNotNull(), F.concat(F.lit(json.dumps(n.split(":")[0]) + ":"), _typed(F.col(f"`{n}`")))) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def csv_export(spark: SparkSession, nodes_path: str, rels_path: str) -> tuple[DataFrame, DataFrame]:
    """A pair of CSV files (headers :ID, :LABEL and :START_ID, :END_ID, :TYPE; RFC 4180 quoting) as an ingest batch."""
    read = lambda p: spark.read.csv(p, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    n, r = read(nodes_path), read(rels_path)
    for df, need in ((n, {":ID", ":LABEL"}), (r, {":START_ID", ":END_ID", ":TYPE"})):
        if missing := need - set(df.columns):
            raise QueryError(f"missing columns {sorted(missing)}")
    key = lambda c: F.concat(F.lit("csv:node:"), F.col(f"`{c}`"))
    nodes = n.select(key(":ID").alias("external_id"), F.col("`:LABEL`").alias("label"), _bag(n, {":ID", ":LABEL"}).alias("properties"))
    ends = [key(":START_ID").alias("from_external_id"), key(":END_ID").alias("to_external_id")]
    rels = r.select(F.concat_ws(":", F.lit("csv:rel"), "`:START_ID`", "`:TYPE`", "`:END_ID`").alias("external_id"), *ends, F.col("`:TYPE`").alias("rel_type"), _bag(r, {":START_ID", ":END_ID", ":TYPE"}).alias("properties"))
    return nodes, rels


def create_script(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """A script of CREATE statements as an ingest batch. Variables are known in the whole script. Parsed on the driver."""
    nodes: list[tuple] = []
    rels: list[tuple] = []
    names: dict[str, str] = {}

    def value(e):
        if isinstance(e, A.Lit):
            return e.value
        if isinstance(e, A.ListLit):
            return [value(x) for x in e.items]
        if isinstance(e, A.MapLit):
            return {k: value(v) for k, v in e.items}
        raise QueryError("a CREATE script holds literals only")

    def bag(props) -> str:
        return json.dumps({k: value(v) for k, v in props}, sort_keys=True)

    for statement in parse_many(text):
        for k in statement.query.bodies[0]:
            if not isinstance(k, A.Create):
                raise QueryError("a CREATE script holds CREATE only")
            for p in k.items:
                for n in p.nodes:
                    if n.var not in names:
                        names[n.var] = f"script:node:{len(nodes)}"
                        nodes.append((names[n.var], n.labels[0] if n.labels else "", bag(n.props)))
                for i, r in enumerate(p.rels):
                    a, b = (p.nodes[i + 1], p.nodes[i]) if r.direction == "in" else (p.nodes[i], p.nodes[i + 1])
                    rels.append((f"script:rel:{len(rels)}", names[a.var], names[b.var], r.types[0], bag(r.props)))
    return (
        spark.createDataFrame(nodes, "external_id string, label string, properties string"),
        spark.createDataFrame(rels, "external_id string, from_external_id string, to_external_id string, rel_type string, properties string"),
    )
