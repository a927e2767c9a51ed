"""Writing clauses: each gives a new immutable graph, made by unions, left joins and anti-joins.

The driving rows are written first, so that what is created keeps its ids. New ids go up from the largest id there is.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as X
from ..functions.values import V
from ..graph import NODE_COLUMNS, REL_COLUMNS, PropertyGraph, Segment, as_type, c, unified
from ..operators.tables import written
from . import ast as A
from .expressions import Bound, col
from .parser import QueryError


def union_tables(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows of both; a property that only one has is NULL in the other, types are unified."""
    if old is None:
        return new
    kinds: dict[str, list] = {}
    for df in (old, new):
        for f in df.schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    want = {n: unified([k for k in ks if not isinstance(k, T.NullType)] or ks) for n, ks in kinds.items()}

    def shaped(df: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema}
        return df.select(*((as_type(c(n), have[n], t) if n in have and not isinstance(have[n], T.NullType) else F.lit(None).cast(t)).alias(n) for n, t in want.items()))

    return shaped(old).unionByName(shaped(new))


def next_id(tables: list[DataFrame]) -> int:
    top = 0
    for df in tables:
        top = max(top, df.agg(F.max("_id")).first()[0] or 0)
    return top + 1


def next_node(graph: PropertyGraph) -> int:
    return next_id(list(graph.nodes.values()))


def next_rel(graph: PropertyGraph) -> int:
    return next_id([s.df for s in graph.segments])


def add_nodes(graph: PropertyGraph, label: str, rows: DataFrame) -> PropertyGraph:
    return graph.with_(nodes={**graph.nodes, label: union_tables(graph.nodes.get(label), rows)})


def add_rels(graph: PropertyGraph, type_: str, src: str, dst: str, rows: DataFrame) -> PropertyGraph:
    found, out = False, []
    for s in graph.segments:
        if (s.type, s.src, s.dst) == (type_, src, dst):
            s, found = replace(s, df=union_tables(s.df, rows)), True
        out.append(s)
    if not found:
        out.append(Segment(type_, src, dst, rows))
    return graph.with_(segments=tuple(out))


def count(t, name: str, n: int) -> None:
    t.counters[name] = t.counters.get(name, 0) + n


def clause(t, frame, k: A.Clause):
    if isinstance(k, A.Create):
        for p in k.items:
            frame = create(t, frame, p)
        return frame
    if isinstance(k, A.Merge):
        return merge(t, frame, k)
    if isinstance(k, A.SetClause):
        for s in k.items:
            frame = set_item(t, frame, s)
        return frame
    if isinstance(k, A.Remove):
        for s in k.items:
            frame = set_item(t, frame, replace(s, kind="unlabel") if s.kind == "label" else replace(s, value=A.Lit(None)))
        return frame
    if isinstance(k, A.Delete):
        return delete(t, frame, k)
    raise QueryError(f"{type(k).__name__} can't be used here")


def fixed(t, frame, name: str):
    """The driving rows, written, with a number each."""
    df = t.rows(frame)
    single = frame.df is None
    df = written(df.withColumn("#row", F.lit(0).cast("long") if single else F.monotonically_increasing_id()), name)
    return replace(frame, df=df), "#row"


def props_of(t, frame, items: tuple) -> list[tuple[str, V]]:
    compile = t.compiler(frame.vars)
    return [(n, compile(e)) for n, e in items]


def create(t, frame, p: A.PathPat):
    if p.kind != "plain" or any(r.variable or r.direction == "both" or len(r.types) != 1 for r in p.rels):
        raise QueryError("CREATE needs a direction and one type for every relationship")
    frame, row = fixed(t, frame, "create")
    made = 0
    fresh = [n for i, n in enumerate(p.nodes) if n.var not in frame.vars and n.var not in {m.var for m in p.nodes[:i]}]
    first = next_node(t.graph) if fresh else 0
    n_rows = frame.df.count()
    for n in fresh:
        if len(n.labels) > 1:
            raise QueryError("a node has one label")
        label = n.labels[0] if n.labels else ""
        values = [(x, v) for x, v in props_of(t, frame, n.props) if not isinstance(v.t, T.NullType)]
        ident = (F.lit(first + made) + c(row) * len(fresh)).cast("long")
        made += 1
        df = written(frame.df.select("*", ident.alias(col(n.var, "_id")), *(v.col.alias(col(n.var, x)) for x, v in values)), "create")
        t.graph = add_nodes(t.graph, label, df.select(c(col(n.var, "_id")).alias("_id"), *(c(col(n.var, x)).alias(x) for x, _ in values)))
        b = Bound("node", labels=(label,), props={x: v.t for x, v in values}, fields=("_id", *(x for x, _ in values)))
        frame = replace(frame, df=df, vars={**frame.vars, n.var: b})
        count(t, "nodes_created", n_rows)
        count(t, "properties_set", n_rows * len(values))
    first = next_rel(t.graph) if p.rels else 0
    for i, r in enumerate(p.rels):
        a, b = (p.nodes[i + 1], p.nodes[i]) if r.direction == "in" else (p.nodes[i], p.nodes[i + 1])
        values = [(x, v) for x, v in props_of(t, frame, r.props) if not isinstance(v.t, T.NullType)]
        ident = (F.lit(first + i) + c(row) * len(p.rels)).cast("long")
        ends = [c(col(a.var, "_id")).alias(col(r.var, "_src")), c(col(b.var, "_id")).alias(col(r.var, "_dst"))]
        df = written(frame.df.select("*", ident.alias(col(r.var, "_id")), *ends, *(v.col.alias(col(r.var, x)) for x, v in values)), "create")
        segments = []
        for la in frame.vars[a.var].labels:
            for lb in frame.vars[b.var].labels:
                rows = df
                for n, label in ((a, la), (b, lb)):
                    if len(frame.vars[n.var].labels) > 1:
                        rows = rows.join(t.graph.scan([label], []).select(c("_id").alias("#x")), c(col(n.var, "_id")) == c("#x"), "left_semi")
                rows = rows.select(*(c(col(r.var, x)).alias(x) for x in REL_COLUMNS), *(c(col(r.var, x)).alias(x) for x, _ in values))
                if len(frame.vars[a.var].labels) * len(frame.vars[b.var].labels) > 1 and rows.isEmpty():
                    continue
                t.graph = add_rels(t.graph, r.types[0], la, lb, rows)
                segments.append(Segment(r.types[0], la, lb, rows))
        bound = Bound("rel", segments=tuple(segments), props={x: v.t for x, v in values}, fields=("_id", "_src", "_dst", *(x for x, _ in values)))
        frame = replace(frame, df=df, vars={**frame.vars, r.var: bound})
        count(t, "relationships_created", n_rows)
        count(t, "properties_set", n_rows * len(values))
    t.note("Create")
    return replace(frame, df=frame.df.drop(row))


def merge(t, frame, k: A.Merge):
    """Matches the pattern for every driving row; distinct rows that find nothing create it once."""
    p = k.pattern
    if len(p.rels) > 1 or any(r.variable for r in p.rels):
        raise QueryError("MERGE takes a node or one relationship")
    driving, row = fixed(t, frame, "merge")
    for x in (*p.nodes, *p.rels):
        for name, _ in x.props:
            t.usage.props[x.var].add(name)
        for s in (*k.on_create, *k.on_match):
            if s.var == x.var and s.name:
                t.usage.props[x.var].add(s.name)
    # what the pattern compares with is computed for the driving rows, so that rows with equal values create once
    keys, cols, swapped = [], [], []
    compile = t.compiler(driving.vars)
    new_nodes, new_rels = [], []
    for group, out in ((p.nodes, new_nodes), (p.rels, new_rels)):
        for x in group:
            props = []
            for name, e in x.props:
                v = compile(e)
                if isinstance(v.t, T.NullType):
                    raise QueryError("MERGE can't compare with NULL")
                key = t.temp("m")
                keys.append(key)
                cols.append(v.col.alias(col(key)))
                swapped.append((key, v.t))
                props.append((name, A.Var(key)))
            out.append(replace(x, props=tuple(props)))
    bound_ids = [col(n.var, "_id") for n in p.nodes if n.var in driving.vars]
    df = driving.df.select("*", *cols)
    vars = {**driving.vars, **{key: Bound("value", kind, fields=("",)) for key, kind in swapped}}
    pattern = replace(p, nodes=tuple(new_nodes), rels=tuple(new_rels))
    distinct_by = [*(col(key) for key in keys), *bound_ids]
    base = df.select(*dict.fromkeys([*distinct_by, *(col(v, f) for v, b in driving.vars.items() if col(v, "_id") in bound_ids for f in b.fields)]))
    base = written(base.dropDuplicates(distinct_by) if distinct_by else base.limit(1), "merge-keys")
    base_vars = {**{v: b for v, b in driving.vars.items() if col(v, "_id") in bound_ids}, **{key: vars[key] for key in keys}}
    start = replace(driving, df=base, vars=base_vars, carry=(), sorted_by=())
    probe = A.Match((pattern,), None, True)
    known = [n for n in pattern.nodes if n.labels and n.labels[0] not in t.graph.nodes]
    fresh = [x.var for x in (*pattern.nodes, *pattern.rels) if x.var not in driving.vars]
    lead = col(pattern.rels[0].var if pattern.rels else pattern.nodes[0].var, "_id")
    if not known and (not pattern.rels or t.graph.segments_of(pattern.rels[0].types)):
        where = None
        for x in (*pattern.nodes, *pattern.rels):  # equality with computed keys is a condition of the join
            for name, e in x.props:
                test = A.Binary("=", A.Prop(A.Var(x.var), name), e)
                where = test if where is None else A.Binary("and", where, test)
        bare = replace(pattern, nodes=tuple(replace(n, props=()) for n in pattern.nodes), rels=tuple(replace(r, props=()) for r in pattern.rels))
        found = t.optional(start, replace(probe, patterns=(bare,), where=where))
        found = replace(found, df=written(found.df, "merge-found"))
        matched = replace(found, df=found.df.filter(c(lead).isNotNull()))
        missing = replace(start, df=found.df.filter(c(lead).isNull()).select(*base.columns))
    else:
        matched, missing = None, start
    missing = replace(missing, df=written(missing.df, "merge-missing"))
    parts = []
    if matched is not None and not matched.df.isEmpty():
        for s in k.on_match:
            matched = set_item(t, matched, s)
        parts.append(matched)
    if not missing.df.isEmpty():
        made = create(t, missing, pattern if not pattern.rels or pattern.rels[0].direction != "both" else replace(pattern, rels=(replace(pattern.rels[0], direction="out"),)))
        for s in k.on_create:
            made = set_item(t, made, s)
        parts.append(made)
    if not parts:
        parts = [matched or missing]
    merged = parts[0].df if len(parts) == 1 else union_tables(parts[0].df, parts[1].df)
    new_vars = {}
    for v in fresh:
        bs = [x.vars[v] for x in parts if v in x.vars]
        labels = tuple(dict.fromkeys(y for b in bs for y in b.labels))
        segments = tuple(s for b in bs for s in b.segments)
        fields = tuple(dict.fromkeys(f for b in bs for f in b.fields if col(v, f) in merged.columns))
        new_vars[v] = Bound(bs[0].kind, labels=labels, segments=segments, props={f: merged.schema[col(v, f)].dataType for f in fields if not f.startswith("_")}, fields=fields)
    keep = [*distinct_by, *(col(v, f) for v, b in new_vars.items() for f in b.fields)]
    side = merged.select(*(c(x).alias(f"#k{i}") if i < len(distinct_by) else c(x) for i, x in enumerate(keep)))
    on = F.lit(True)
    for i, x in enumerate(distinct_by):
        on = on & c(x).eqNullSafe(c(f"#k{i}"))
    out = (df.join(side, on) if distinct_by else df.crossJoin(side)).drop(*(f"#k{i}" for i in range(len(distinct_by))), *(col(key) for key in keys), row)
    t.note("Merge")
    return replace(frame, df=out, vars={**frame.vars, **new_vars})


def set_item(t, frame, s: A.SetItem):
    if s.var not in frame.vars or frame.vars[s.var].kind not in ("node", "rel"):
        raise QueryError(f"{s.var} is no node or relationship")
    b = frame.vars[s.var]
    df = written(t.rows(frame), "set")
    frame = replace(frame, df=df)
    ident = col(s.var, "_id")
    if s.kind in ("label", "unlabel"):
        return relabel(t, frame, s, b)
    if s.kind == "prop":
        new = [(s.name, t.compiler(frame.vars)(s.value))]
    else:
        new = props_of(t, frame, s.value)
    updates = df.filter(c(ident).isNotNull()).select(c(ident).alias("#id"), *(v.col.alias(f"#{n}") for n, v in new)).dropDuplicates(["#id"])
    updates = written(updates, "set-values")
    clear = s.kind == "replace"

    def changed(table: DataFrame, own: tuple) -> DataFrame:
        joined = table.join(updates, c("_id") == c("#id"), "left")
        hit = c("#id").isNotNull()
        cols = [c(n) for n in own]
        kinds = {f.name: f.dataType for f in table.schema if f.name not in own}
        for n, old in kinds.items():
            v = next((v for m, v in new if m == n), None)
            if v is None:
                cols.append(F.when(~hit, c(n)).alias(n) if clear else c(n))
            else:
                kind = old if isinstance(v.t, T.NullType) else v.t if isinstance(old, T.NullType) else unified([old, v.t])
                value = F.lit(None).cast(kind) if isinstance(v.t, T.NullType) else as_type(c(f"#{n}"), v.t, kind)
                cols.append(F.when(hit, value).otherwise(as_type(c(n), old, kind)).alias(n))
        cols += [c(f"#{n}").alias(n) for n, v in new if n not in kinds and not isinstance(v.t, T.NullType)]
        return joined.select(*cols)

    if b.kind == "node":
        nodes = dict(t.graph.nodes)
        for label in b.labels:
            nodes[label] = written(changed(nodes[label], NODE_COLUMNS), "set-nodes")
        t.graph = t.graph.with_(nodes=nodes)
    else:
        of = {(x.type, x.src, x.dst) for x in b.segments}
        t.graph = t.graph.with_(segments=tuple(replace(x, df=written(changed(x.df, REL_COLUMNS), "set-rels")) if (x.type, x.src, x.dst) in of else x for x in t.graph.segments))
    count(t, "properties_set", updates.count() * len(new))
    props, fields = dict(b.props), list(b.fields)
    for n, v in new:  # later clauses see the new values
        df = df.withColumn(col(s.var, n), F.when(c(ident).isNotNull(), v.col) if not isinstance(v.t, T.NullType) else F.lit(None).cast(props.get(n, X.STR)))
        props[n] = props.get(n, X.STR) if isinstance(v.t, T.NullType) else v.t
        if n not in fields:
            fields.append(n)
    if clear:
        for n in [n for n in props if n not in {m for m, _ in new}]:
            if n in fields:
                df = df.withColumn(col(s.var, n), F.lit(None).cast(props[n]))
    t.note("Set", s.var)
    return replace(frame, df=df, vars={**frame.vars, s.var: replace(b, props=props, fields=tuple(fields))})


def relabel(t, frame, s: A.SetItem, b: Bound):
    """A node has one label: a new one replaces it, and removing it leaves none."""
    if b.kind != "node":
        raise QueryError("only nodes have labels")
    to = s.name if s.kind == "label" else ""
    ids = written(frame.df.select(c(col(s.var, "_id")).alias("#id")).filter(c("#id").isNotNull()).distinct(), "relabel")
    nodes, moved = dict(t.graph.nodes), 0
    ends: dict[str, DataFrame] = {}
    for label in b.labels:
        if label == to or (s.kind == "unlabel" and label != s.name):
            continue
        rows = written(nodes[label].join(ids, c("_id") == c("#id"), "left_semi"), "relabel-rows")
        n = rows.count()
        if not n:
            continue
        moved += n
        nodes[label] = nodes[label].join(ids, c("_id") == c("#id"), "left_anti")
        nodes[to] = union_tables(nodes.get(to), rows)
        ends[label] = rows.select("_id")
    segments = []
    for x in t.graph.segments:  # relationships follow their ends' labels
        parts = [(x.src, x.dst, x.df)]
        for i, side in ((0, "_src"), (1, "_dst")):
            split = []
            for a, d, df in parts:
                label = (a, d)[i]
                if label in ends:
                    on = df[side] == ends[label]["_id"]
                    hit = df.join(ends[label], on, "left_semi")
                    if not hit.isEmpty():
                        split.append((to if i == 0 else a, to if i == 1 else d, hit))
                        df = df.join(ends[label], on, "left_anti")
                split.append((a, d, df))
            parts = split
        segments += [Segment(x.type, a, d, df) for a, d, df in parts]
    out = t.graph.with_(nodes=nodes, segments=())
    for x in segments:
        out = add_rels(out, x.type, x.src, x.dst, x.df)
    t.graph = out
    count(t, "labels_added" if s.kind == "label" else "labels_removed", moved)
    labels = tuple(dict.fromkeys([to if s.kind == "label" or y == s.name else y for y in b.labels]))
    bound = replace(b, labels=labels)
    df = frame.df
    if "_label" in b.fields:
        new = F.lit(to or None).cast("string") if s.kind == "label" else F.when(c(col(s.var, "_label")) != s.name, c(col(s.var, "_label")))
        df = df.withColumn(col(s.var, "_label"), new)
    t.note("Set", f"{s.var}:{to}")
    return replace(frame, df=df, vars={**frame.vars, s.var: bound})


def delete(t, frame, k: A.Delete):
    frame, row = fixed(t, frame, "delete")
    graph = t.graph
    rel_ids, node_ids, labels = [], [], set()
    for name in k.names:
        if name not in frame.vars or frame.vars[name].kind not in ("node", "rel", "rels"):
            raise QueryError(f"{name} can't be deleted")
        b = frame.vars[name]
        if b.kind == "rels":
            rel_ids.append(frame.df.select(F.explode(c(col(name, "ids"))).alias("#id")))
        else:
            (node_ids if b.kind == "node" else rel_ids).append(frame.df.select(c(col(name, "_id")).alias("#id")).filter(c("#id").isNotNull()))
            labels |= set(b.labels) if b.kind == "node" else set()

    def all_of(parts: list[DataFrame]) -> DataFrame | None:
        out = None
        for x in parts:
            out = x if out is None else out.unionByName(x)
        return None if out is None else written(out.distinct(), "delete-ids")

    rels, nodes = all_of(rel_ids), all_of(node_ids)
    segments, gone = list(graph.segments), 0
    if rels is not None:
        gone += rels.count()
        segments = [replace(s, df=s.df.join(rels, c("_id") == c("#id"), "left_anti")) for s in segments]
    tables = dict(graph.nodes)
    if nodes is not None:
        out = []
        for s in segments:
            if s.src in labels or s.dst in labels:
                src = nodes.select(c("#id").alias("_src"))
                dst = nodes.select(c("#id").alias("_dst"))
                if not k.detach:
                    if not s.df.join(src, "_src", "left_semi").isEmpty() or not s.df.join(dst, "_dst", "left_semi").isEmpty():
                        raise QueryError("a node with relationships needs DETACH DELETE")
                else:
                    rest = written(s.df.join(src, "_src", "left_anti").join(dst, "_dst", "left_anti").select(*s.df.columns), "delete-rels")
                    gone += s.df.count() - rest.count()
                    s = replace(s, df=rest)
            out.append(s)
        segments = out
        for label in labels:
            tables[label] = tables[label].join(nodes, c("_id") == c("#id"), "left_anti")
        count(t, "nodes_deleted", nodes.count())
    count(t, "relationships_deleted", gone)
    t.graph = graph.with_(nodes=tables, segments=tuple(segments))
    t.note("Delete", ", ".join(k.names))
    return replace(frame, df=frame.df.drop(row))


def ddl(graph: PropertyGraph, k: A.Clause):
    from .translate import Result

    empty = graph.spark.range(0).select()
    if isinstance(k, A.DropIndex):
        raise NotImplementedError("DROP INDEX is not supported")
    name = k.name or f"index_{k.label}_{k.prop}".lower()
    if any(i["name"] == name for i in graph.indexes):
        if k.if_not_exists:
            return Result(empty, graph, {"indexes_added": 0})
        raise QueryError(f"index {name} exists")
    options: dict = {}

    def flat(items) -> None:
        for n, v in items:
            if isinstance(v, A.MapLit):
                flat(v.items)
            elif isinstance(v, A.Lit):
                options[n] = v.value

    flat(k.options)
    metric = {"euclidean": "l2", "l2": "l2", "cosine": "cosine", "ip": "ip", "hamming": "hamming"}.get(str(options.get("vector.similarity_function", "euclidean")).lower())
    if metric is None:
        raise QueryError("unknown vector.similarity_function")
    dims = options.get("vector.dimensions")
    if k.vector and dims is not None and (not isinstance(dims, int) or dims <= 0):
        raise QueryError("vector.dimensions must be a positive integer")
    entry = {"name": name, "label": k.label, "prop": k.prop, "vector": k.vector, "metric": metric, "dimensions": dims}
    return Result(empty, graph.with_(indexes=(*graph.indexes, entry)), {"indexes_added": 1})
