"""The property graph: one DataFrame for each node label, one for each relationship segment.

A segment is a relationship type between two labels, so a pattern's labels choose the tables that are read
at all. Node tables have `_id` (unique over the graph) and properties; segments have `_id`, `_src`, `_dst` and
properties. A graph is immutable; writes give a new one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_COLUMNS, REL_COLUMNS = ("_id",), ("_id", "_src", "_dst")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(quoted(name))


def widened(kind: T.DataType) -> T.DataType:
    """Integers are 64-bit and floats double; the rest stays."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return T.LongType()
    if isinstance(kind, T.FloatType | T.DoubleType):
        return T.DoubleType()
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.FloatType):
        return T.ArrayType(widened(kind.elementType), kind.containsNull)
    return kind


def unified(kinds: Iterable[T.DataType]) -> T.DataType:
    """One type for a property in several tables: integer with float is float, any other mix is JSON text."""
    found = list(dict.fromkeys(kinds))
    if len(found) == 1:
        return found[0]
    if {type(k) for k in found} <= {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return T.StringType()


def as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return col
    if isinstance(want, T.StringType):
        return F.to_json(col) if isinstance(have, T.ArrayType | T.MapType | T.StructType) else col.cast("string")
    return col.cast(want)


def normal(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The ids first, all columns in their wide types."""
    names = [*first, *(n for n in df.columns if n not in first)]
    return df.select(*(as_type(c(n), df.schema[n].dataType, w).alias(n) if (w := widened(df.schema[n].dataType)) != df.schema[n].dataType else c(n) for n in names))


@dataclass(frozen=True)
class Segment:
    type: str
    src: str
    dst: str
    df: DataFrame

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in REL_COLUMNS}


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: dict[str, DataFrame]
    segments: tuple[Segment, ...]
    indexes: tuple = ()
    acl: DataFrame | None = None  # node_id, principal
    membership: DataFrame | None = None  # node_id, level, community_id
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, nodes: dict[str, DataFrame], rels: Iterable[tuple[str, str, str, DataFrame]], **more) -> PropertyGraph:
        """rels are (type, source label, target label, table)."""
        return cls(spark, {k: normal(df, NODE_COLUMNS) for k, df in nodes.items()}, tuple(Segment(t, a, b, normal(df, REL_COLUMNS)) for t, a, b, df in rels), **more)

    def with_(self, **changes) -> PropertyGraph:
        return replace(self, **changes)

    # -- catalog
    @property
    def types(self) -> list[str]:
        return list(dict.fromkeys(s.type for s in self.segments))

    def node_props(self, labels: Iterable[str]) -> dict[str, T.DataType]:
        kinds: dict[str, list] = {}
        for label in labels:
            if label in self.nodes:
                for f in self.nodes[label].schema:
                    if f.name not in NODE_COLUMNS:
                        kinds.setdefault(f.name, []).append(f.dataType)
        return {n: unified(k) for n, k in kinds.items()}

    @staticmethod
    def rel_props(segments: Iterable[Segment]) -> dict[str, T.DataType]:
        kinds: dict[str, list] = {}
        for s in segments:
            for n, k in s.props.items():
                kinds.setdefault(n, []).append(k)
        return {n: unified(k) for n, k in kinds.items()}

    # -- scans
    def scan(self, labels: Iterable[str], props: Iterable[str] | None = None, with_label: bool = False) -> DataFrame:
        """Nodes of the labels: `_id`, `_label` if asked for, and the properties (None: all)."""
        labels = [x for x in labels if x in self.nodes]
        kinds = self.node_props(labels)
        names = list(kinds) if props is None else [p for p in kinds if p in set(props)]
        out = None
        for label in labels:
            df = self.nodes[label]
            have = {f.name: f.dataType for f in df.schema}
            cols = [c("_id"), *([F.lit(label or None).cast("string").alias("_label")] if with_label else [])]
            cols += [(as_type(c(n), have[n], kinds[n]) if n in have else F.lit(None).cast(kinds[n])).alias(n) for n in names]
            part = df.select(*cols)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], "_id long" + (", _label string" if with_label else ""))
        return out

    def edges(self, segments: Sequence[Segment], props: Iterable[str] | None = None, ends: bool = False) -> DataFrame:
        """`_id`, `_type`, `_src`, `_dst` (with ends: `_sl` and `_dl`, the labels) and properties of segments."""
        kinds = self.rel_props(segments)
        names = list(kinds) if props is None else [p for p in kinds if p in set(props)]
        out = None
        for s in segments:
            have = s.props
            cols = [c("_id"), F.lit(s.type).alias("_type"), c("_src"), c("_dst")]
            if ends:
                cols += [F.lit(s.src or None).cast("string").alias("_sl"), F.lit(s.dst or None).cast("string").alias("_dl")]
            cols += [(as_type(c(n), have[n], kinds[n]) if n in have else F.lit(None).cast(kinds[n])).alias(n) for n in names]
            part = s.df.select(*cols)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], "_id long, _type string, _src long, _dst long" + (", _sl string, _dl string" if ends else ""))
        return out

    def segments_of(self, types: Iterable[str] = (), src: Iterable[str] | None = None, dst: Iterable[str] | None = None) -> list[Segment]:
        types, src, dst = set(types), None if src is None else set(src), None if dst is None else set(dst)
        return [s for s in self.segments if (not types or s.type in types) and (src is None or s.src in src) and (dst is None or s.dst in dst)]

    # -- tools
    def query(self, text: str, params: dict | None = None, **options) -> DataFrame:
        """Runs one reading statement and gives its rows."""
        from .plans.translate import execute

        return execute(self, text, params, **options).df

    def execute(self, text: str, params: dict | None = None, **options):
        """Runs one statement: rows, the graph after it, and counters of what was written."""
        from .plans.translate import execute

        return execute(self, text, params, **options)

    def run(self, text: str, params: dict | None = None, **options) -> list:
        """Runs statements separated by ';', each on the graph that the one before left."""
        from .plans.translate import run_many

        return run_many(self, text, params, **options)

    def schema(self) -> DataFrame:
        """kind, name, n and properties of every label and relationship type, with index flags. Counts are jobs
        over ids alone."""
        indexed = {(i["label"], i["prop"]) for i in self.indexes}
        rows = None
        entries = [("label", label, df, self.node_props([label])) for label, df in self.nodes.items()]
        entries += [("type", t, self.edges(self.segments_of([t]), []), self.rel_props(self.segments_of([t]))) for t in self.types]
        for kind, name, df, props in entries:
            flags = sorted(p for p in props if (name, p) in indexed)
            own = df.agg(F.count("*").alias("n")).select(
                F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n",
                F.array(*map(F.lit, sorted(props))).cast("array<string>").alias("properties"), F.array(*map(F.lit, flags)).cast("array<string>").alias("indexed"),
            )
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def visible(self, principals: Iterable[str]) -> DataFrame:
        """`_id` of nodes that one of the principals (or everyone) may see."""
        return self.acl.filter(F.col("principal").isin(*principals, "public")).select(F.col("node_id").alias("_id")).distinct()

    def restricted(self, principals: Iterable[str]) -> PropertyGraph:
        """The graph of the nodes that the principals may see, and the relationships between them: semi-joins."""
        if self.acl is None:
            return self
        seen = self.visible(principals)
        end = lambda side: seen.withColumnRenamed("_id", side)
        return self.with_(
            nodes={k: df.join(seen, "_id", "left_semi") for k, df in self.nodes.items()},
            segments=tuple(replace(s, df=s.df.join(end("_src"), "_src", "left_semi").join(end("_dst"), "_dst", "left_semi").select(*s.df.columns)) for s in self.segments),
        )

    def inspect(self, node_id: int) -> DataFrame:
        """A node's neighbours: direction, type, relationship and neighbour ids; the node itself has direction 'self'."""
        e = self.edges(self.segments, [])
        own = self.scan(self.nodes, [], True).filter(F.col("_id") == node_id).select(F.lit("self").alias("direction"), F.col("_label").alias("type"), F.lit(None).cast("long").alias("rel_id"), F.col("_id").alias("node_id"))
        out = e.filter(F.col("_src") == node_id).select(F.lit("out").alias("direction"), F.col("_type").alias("type"), F.col("_id").alias("rel_id"), F.col("_dst").alias("node_id"))
        into = e.filter((F.col("_dst") == node_id) & (F.col("_src") != node_id)).select(F.lit("in").alias("direction"), F.col("_type").alias("type"), F.col("_id").alias("rel_id"), F.col("_src").alias("node_id"))
        return own.unionByName(out).unionByName(into)
