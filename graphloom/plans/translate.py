"""Query statements -> DataFrames. Everything stays lazy; Catalyst orders, prunes and executes.

A variable is a set of flat columns ("n$_id", "n$name"), so filters and column selection reach the scans. Nodes
are joined to their tables only if the query needs their properties or if the relationship tables don't
already imply their label.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as X
from ..functions.values import INT, STR, V
from ..graph import PropertyGraph, Segment, as_type, c
from . import ast as A
from .expressions import Bound, Compiler, bound_value, col, has_aggregate, is_aggregate, label_of, replaced, type_of, walk
from .parser import QueryError, parse, parse_many
from .usage import Usage

#: Depth to which an unbounded pattern is followed; anything deeper is an error, never cut off.
UNBOUNDED_DEPTH = 5
#: k of NEAR conditions, which have no place for it.
DEFAULT_K = 10


@dataclass(frozen=True)
class Frame:
    """The rows so far. df None: one row without columns. carry: hidden columns that every step keeps."""

    df: DataFrame | None = None
    vars: Mapping[str, Bound] = field(default_factory=dict)
    carry: tuple[str, ...] = ()
    sorted_by: tuple[tuple[str, bool], ...] = ()  # hidden columns of the last ORDER BY, for collect()

    def columns(self) -> list[str]:
        return [*(col(v, f) for v, b in self.vars.items() for f in b.fields), *self.carry, *(s for s, _ in self.sorted_by)]


@dataclass
class Result:
    df: DataFrame
    graph: PropertyGraph
    counters: dict = field(default_factory=dict)


def null_order(x: Column, descending: bool) -> Column:
    """NULL stands last in ascending and first in descending order."""
    return x.desc_nulls_first() if descending else x.asc_nulls_last()


class Translator:
    def __init__(self, graph: PropertyGraph, params: Mapping[str, object], usage: Usage, unique_relationships: bool = False, strict: bool = False, undirected_shortest: bool = False, near_k: int = DEFAULT_K) -> None:
        self.graph, self.params, self.usage = graph, params, usage
        self.unique, self.strict, self.undirected_shortest, self.near_k = unique_relationships, strict, undirected_shortest, near_k
        self.counters: dict[str, int] = {}
        self.steps: list[tuple[str, str]] = []
        self.fresh = 0

    def compiler(self, vars: Mapping[str, Bound]) -> Compiler:
        return Compiler(vars, self.params)

    def note(self, operator: str, details: str = "") -> None:
        self.steps.append((operator, details))

    def temp(self, what: str) -> str:
        self.fresh += 1
        return f"#{what}{self.fresh}"

    def rows(self, frame: Frame) -> DataFrame:
        return self.graph.spark.range(1).select() if frame.df is None else frame.df

    def known(self, e: A.Expr) -> object:
        """The value of an expression without variables."""
        v = self.compiler({})(e)
        return v.lit if v.lit is not X.MISSING else self.graph.spark.range(1).select(v.col).first()[0]

    def count(self, e: A.Expr | None, what: str) -> int | None:
        if e is None:
            return None
        n = self.known(e)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise QueryError(f"{what} needs a non-negative integer")
        return n

    # -- queries
    def query(self, q: A.Query, start: Frame = Frame()) -> Frame:
        arms = [self.body(b, start) for b in q.bodies]
        if len(arms) == 1:
            return arms[0]
        names = list(arms[0].vars)
        for arm in arms[1:]:
            if set(arm.vars) != set(names):
                raise QueryError("the parts of a UNION have different columns")
        kinds = {n: X.common([arm.vars[n].t for arm in arms]) for n in names}
        for n, t in kinds.items():
            if t is None:
                raise QueryError(f"column {n} has different kinds in the parts of a UNION")
        carry = arms[0].carry
        parts = [self.rows(arm).select(*((X.cast(V(c(col(n)), arm.vars[n].t), kinds[n])).alias(col(n)) for n in names), *map(c, carry)) for arm in arms]
        df = parts[0]
        for part, all_ in zip(parts[1:], q.alls):
            df = df.unionByName(part, allowMissingColumns=True)
            self.note("Union")
            if not all_:
                df = df.distinct()
                self.note("Distinct")
        vars = {n: Bound("value", t, fields=("",)) for n, t in kinds.items()}
        frame = Frame(df, vars, carry)
        if q.order or q.skip is not None or q.limit is not None:
            compile = self.compiler(vars)
            keys = [(self.temp("o"), compile(e).col, d) for e, d in q.order]
            frame = self.tail(replace(frame, df=df.select("*", *(x.alias(n) for n, x, _ in keys))), [(n, d) for n, _, d in keys], q.skip, q.limit)
            frame = replace(frame, df=frame.df.select(*map(c, frame.columns())), sorted_by=())
        return frame

    def body(self, clauses: tuple, frame: Frame) -> Frame:
        from . import write

        done = False
        for i, k in enumerate(clauses):
            if done:
                raise QueryError("nothing can follow RETURN")
            if isinstance(k, A.Match):
                after = clauses[i + 1] if i + 1 < len(clauses) else None
                frame = self.optional(frame, k) if k.optional else self.factored(frame, k, after) or self.match(frame, k)
            elif isinstance(k, A.Projection):
                frame = self.projection(frame, k)
                done = k.final
            elif isinstance(k, A.Unwind):
                frame = self.unwind(frame, k)
            elif isinstance(k, A.SubQuery):
                frame = self.subquery(frame, k.body)
            elif isinstance(k, A.Procedure):
                frame = self.procedure(frame, k, i == len(clauses) - 1)
            elif isinstance(k, A.RankBy):
                frame = self.rank(frame, k)
            else:
                frame = write.clause(self, frame, k)
        if not done and not isinstance(clauses[-1], A.Procedure):
            frame = Frame(self.rows(frame).limit(0).select(), {})
        return frame

    # -- patterns
    def resolve(self, patterns: tuple, vars: Mapping[str, Bound]) -> tuple[dict[str, tuple], dict[str, list[Segment]]]:
        """Candidate labels of nodes and segments of relationships, narrowed along the patterns."""
        labels: dict[str, tuple | None] = {}
        for p in patterns:
            for n in p.nodes:
                if len(n.labels) > 1:
                    raise QueryError("a node has one label; a pattern with several matches nothing")
                if n.var in vars:
                    if vars[n.var].kind != "node":
                        raise QueryError(f"{n.var} is no node")
                    labels.setdefault(n.var, vars[n.var].labels)
                if n.labels:
                    have = labels.get(n.var)
                    labels[n.var] = n.labels if have is None else tuple(x for x in have if x in n.labels)
                labels.setdefault(n.var, None)
        segments: dict[str, list[Segment]] = {}
        hops = [(a, r, b) for p in patterns for a, r, b in zip(p.nodes, p.rels, p.nodes[1:])]
        for _ in range(len(hops) + 1):
            for a, r, b in hops:
                if self.strict and len(r.types) > 1:
                    raise QueryError("several relationship types in one pattern")
                la, lb = labels[a.var], labels[b.var]
                if r.variable:
                    segments[r.var] = self.graph.segments_of(r.types)
                    continue
                fits = lambda s, x, y: (x is None or s.src in x) and (y is None or s.dst in y)
                out = [s for s in segments.get(r.var, self.graph.segments_of(r.types)) if (r.direction != "in" and fits(s, la, lb)) or (r.direction != "out" and fits(s, lb, la))]
                segments[r.var] = out
                reach_a, reach_b = set(), set()
                for s in out:
                    if r.direction != "in" and fits(s, la, lb):
                        reach_a.add(s.src)
                        reach_b.add(s.dst)
                    if r.direction != "out" and fits(s, lb, la):
                        reach_a.add(s.dst)
                        reach_b.add(s.src)
                labels[a.var] = tuple(x for x in (la if la is not None else self.graph.nodes) if x in reach_a)
                labels[b.var] = tuple(x for x in (lb if lb is not None else self.graph.nodes) if x in reach_b)
        everything = tuple(self.graph.nodes)
        return {n: everything if x is None else x for n, x in labels.items()}, segments

    def match(self, frame: Frame, k: A.Match) -> Frame:
        where, searches = self.searches(k.where)
        labels, segments = self.resolve(k.patterns, frame.vars)
        for p in k.patterns:
            if p.kind != "plain":
                frame = self.shortest(frame, p, labels)
            else:
                frame = self.pattern(frame, p, labels, segments)
        frame = self.unique_filter(frame, k.patterns)
        if where is not None:
            self.note("Filter", repr(where)[:200])
            frame = replace(frame, df=self.rows(frame).filter(X.truth(self.compiler(frame.vars)(where))))
        for s in sorted(searches, key=lambda s: s.kind == "near"):  # the nearest are ranked among what all else leaves
            frame = self.search(frame, s)
        return frame

    def factored(self, frame: Frame, k: A.Match, after: A.Clause | None) -> Frame | None:
        """The match in parts that meet only in grouping keys, if what follows asks each part for its distinct values alone.

        Rows of different parts are then not paired: each part keeps the rows whose keys all others have, and the parts
        are united, with NULL for the variables of the others. count(DISTINCT), sum(DISTINCT), avg(DISTINCT), min and max
        of them are those of the join, whose rows grow as the product of the parts. None: the form is another one.
        """
        if not isinstance(after, A.Projection) or after.star or frame.df is not None or frame.carry or self.unique:
            return None
        if any(p.kind != "plain" or p.var is not None or any(r.variable for r in p.rels) for p in k.patterns):
            return None
        known = {n.var for p in k.patterns for n in p.nodes}
        names = lambda e: {x.name for x in walk(e) if isinstance(x, A.Var)}
        keys: set[str] = set()
        for i in after.items:
            if not has_aggregate(i.expr):
                keys |= names(i.expr)
        if not keys or not keys <= known:
            return None
        for e in [i.expr for i in after.items] + [e for e, _ in after.order]:
            for x in walk(e):
                if is_aggregate(x):
                    arg = x.args[0] if len(x.args) == 1 else None
                    arg = arg.of if isinstance(arg, A.Prop) else arg
                    if not isinstance(arg, A.Var) or not (x.distinct and x.name in ("count", "sum", "avg") or x.name in ("min", "max")):
                        return None
        parts: list[tuple[list, set[str]]] = []  # patterns, their variables without the keys
        for p in k.patterns:
            cuts = [0, *(i for i in range(1, len(p.rels)) if p.nodes[i].var in keys), len(p.rels)]
            for a, b in zip(cuts, cuts[1:]) if p.rels else [(0, 0)]:
                piece = A.PathPat(p.nodes[a : b + 1], p.rels[a:b])
                vars = {x.var for x in (*piece.nodes, *piece.rels)} - keys
                near = [q for q in parts if q[1] & vars]
                parts = [q for q in parts if not q[1] & vars] + [(sum((q[0] for q in near), []) + [piece], vars.union(*(q[1] for q in near)))]
        if len(parts) < 2 or any(not keys <= {n.var for p in ps for n in p.nodes} for ps, _ in parts):
            return None
        where, searches = self.searches(k.where)
        conditions: list[list[A.Expr]] = [[] for _ in parts]
        rest = [where] if where is not None else []
        while rest:
            e = rest.pop(0)
            if isinstance(e, A.Binary) and e.op == "and":
                rest = [e.left, e.right, *rest]
                continue
            fits = [n for n, (_, vars) in enumerate(parts) if names(e) <= vars | keys]
            if not fits:
                return None
            conditions[fits[0]].append(e)
        if searches:
            return None
        labels, segments = self.resolve(k.patterns, {})
        frames = []
        for (patterns, _), wheres in zip(parts, conditions):
            f = Frame()
            for p in patterns:
                f = self.pattern(f, p, labels, segments)
            for e in wheres:
                self.note("Filter", repr(e)[:200])
                f = replace(f, df=f.df.filter(X.truth(self.compiler(f.vars)(e))))
            frames.append(f)
        ids = sorted(col(n, "_id") for n in keys)
        keyed = [f.df.select(*map(c, ids)).distinct() for f in frames]
        vars: dict[str, Bound] = {}
        df = None
        for n, f in enumerate(frames):
            for v, b in f.vars.items():
                if vars.setdefault(v, b) != b:  # a key has more columns in one part than in another
                    return None
            own = f.df
            for other in keyed[:n] + keyed[n + 1 :]:
                own = own.join(other, ids, "left_semi")
            df = own if df is None else df.unionByName(own, allowMissingColumns=True)
        self.note("SemiJoin", f"{len(frames)} parts, distinct values only")
        return Frame(df, vars)

    def unique_filter(self, frame: Frame, patterns: tuple) -> Frame:
        """Optional: no relationship twice in one MATCH, across its hops."""
        if not self.unique:
            return frame
        rels = [r for p in patterns for r in p.rels if r.var in frame.vars]
        df = frame.df
        for i, a in enumerate(rels):
            for b in rels[i + 1 :]:
                if a.variable and b.variable:
                    df = df.filter(~F.arrays_overlap(c(col(a.var, "ids")), c(col(b.var, "ids"))))
                elif a.variable or b.variable:
                    many, one = (a, b) if a.variable else (b, a)
                    df = df.filter(~F.array_contains(c(col(many.var, "ids")), c(col(one.var, "_id"))))
                else:
                    df = df.filter(c(col(a.var, "_id")) != c(col(b.var, "_id")))
        return replace(frame, df=df)

    def node_need(self, n: str) -> set[str] | None:
        return self.usage.of(n)

    def scan(self, n: str, labels: tuple, props: set[str] | None) -> tuple[DataFrame, Bound]:
        """The node table of a variable, its columns named for it."""
        kinds = self.graph.node_props(labels)
        kinds = {p: t for p, t in kinds.items() if props is None or p in props}
        df = self.graph.scan(labels, kinds, len(labels) > 1)
        names = ["_id", *(["_label"] if len(labels) > 1 else []), *kinds]
        self.note("Scan", f"({n}:{'|'.join(labels)})" + (f" {sorted(kinds)}" if kinds else ""))
        return df.select(*(c(x).alias(col(n, x)) for x in names)), Bound("node", labels=labels, props=kinds, fields=tuple(names))

    def hydrate(self, frame: Frame, n: A.NodePat, labels: tuple, has_label: bool = False, check: bool = False) -> Frame:
        """Gives a node that is only an id so far the properties that the query needs."""
        props = self.node_need(n.var)
        kinds = {p for p in self.graph.node_props(labels) if props is None or p in props}
        if not kinds and not check:
            fields = ("_id", "_label") if has_label else ("_id",)
            return replace(frame, vars={**frame.vars, n.var: Bound("node", labels=labels, fields=fields)})
        table, b = self.scan(n.var, labels, props)
        key = self.temp("h")
        df = frame.df.drop(col(n.var, "_label")) if has_label else frame.df
        df = df.join(table.withColumnRenamed(col(n.var, "_id"), key), c(col(n.var, "_id")) == c(key)).drop(key)
        return replace(frame, df=df, vars={**frame.vars, n.var: b})

    def inline(self, frame: Frame, var: str, props: tuple) -> Frame:
        """Equality with a pattern's property map."""
        df = frame.df
        for name, value in props:
            compile = self.compiler(frame.vars)
            df = df.filter(X.equal(compile(A.Prop(A.Var(var), name)), compile(value)).col)
        return replace(frame, df=df)

    def cross(self, a: Frame, b: Frame) -> Frame:
        if a.df is None:
            return replace(b, carry=a.carry, sorted_by=())
        self.note("CrossJoin")
        return Frame(a.df.crossJoin(b.df), {**a.vars, **b.vars}, a.carry)

    def pattern(self, frame: Frame, p: A.PathPat, labels: dict, segments: dict) -> Frame:
        if self.path_parts(p) & {"nodes"}:
            for n in p.nodes:
                self.usage.props[n.var] |= self.usage.mentioned
        for r in p.rels:
            if r.var in frame.vars:
                raise QueryError(f"relationship variable {r.var} is bound already")
        start = next((i for i, n in enumerate(p.nodes) if n.var in frame.vars), None)
        if start is None:
            outer, frame, start = frame, Frame(), 0
            first = p.nodes[0]
            props = self.node_need(first.var)
            needed = props is None or props & set(self.graph.node_props(labels[first.var]))
            if needed or not p.rels or p.rels[0].variable or not labels[first.var]:
                df, b = self.scan(first.var, labels[first.var], props)
                frame = self.inline(Frame(df, {first.var: b}), first.var, first.props)
            # otherwise the first relationship table stands for the node
            lone = True
        else:
            outer, lone = None, False
            n = p.nodes[start]
            bound = frame.vars[n.var]
            if n.labels and not set(bound.labels) <= set(n.labels):
                frame = replace(frame, df=frame.df.filter(label_of(n.var, bound).isin(*n.labels)))
            frame = self.need_bound(frame, n, labels)
        for i in range(start, len(p.rels)):
            frame = self.hop(frame, p, i, False, labels, segments)
        for i in range(start - 1, -1, -1):
            frame = self.hop(frame, p, i, True, labels, segments)
        if p.var is not None:
            frame = self.named_path(frame, p)
        return self.cross(outer, frame) if lone else frame

    def need_bound(self, frame: Frame, n: A.NodePat, labels: dict) -> Frame:
        """Properties that this pattern wants of a node bound before without them."""
        missing = {k for k, _ in n.props} - set(frame.vars[n.var].props)
        if missing & set(self.graph.node_props(labels[n.var])):
            b = frame.vars[n.var]
            frame = self.hydrate(replace(frame, df=frame.df.drop(*(col(n.var, x) for x in b.fields if x != "_id"))), n, labels[n.var], check=True)
        return self.inline(frame, n.var, n.props)

    def path_parts(self, p: A.PathPat) -> set[str]:
        return self.usage.paths[p.var] if p.var else set()

    def oriented(self, segments: list[Segment], direction: str, props: set[str] | None, ends: bool, la=None, lb=None) -> DataFrame:
        """Edges with f (from) and t (to) along the traversal; with ends also fl and tl, their labels."""
        fits = lambda s, x, y: (x is None or s.src in x) and (y is None or s.dst in y)
        parts = []
        if direction != "in":
            e = self.graph.edges([s for s in segments if fits(s, la, lb)], props, ends)
            parts.append(e.select("*", c("_src").alias("f"), c("_dst").alias("t"), *([c("_sl").alias("fl"), c("_dl").alias("tl")] if ends else [])))
        if direction != "out":
            e = self.graph.edges([s for s in segments if fits(s, lb, la)], props, ends)
            if direction == "both":
                e = e.filter("_src <> _dst")  # a loop counts once
            parts.append(e.select("*", c("_dst").alias("f"), c("_src").alias("t"), *([c("_dl").alias("fl"), c("_sl").alias("tl")] if ends else [])))
        if len(parts) == 1:
            return parts[0]
        return parts[0].unionByName(parts[1], allowMissingColumns=True)

    def hop(self, frame: Frame, p: A.PathPat, i: int, backward: bool, labels: dict, segments: dict) -> Frame:
        r = p.rels[i]
        a, b = (p.nodes[i + 1], p.nodes[i]) if backward else (p.nodes[i], p.nodes[i + 1])
        direction = {"out": "in", "in": "out"}.get(r.direction, "both") if backward else r.direction
        if r.variable:
            return self.var_hop(frame, p, r, a, b, direction, backward, labels, segments[r.var])
        segs = segments[r.var]
        props = self.usage.of(r.var)
        la, lb = labels[a.var], labels[b.var]
        ends = len(la) > 1 or len(lb) > 1
        e = self.oriented(segs, direction, props, ends, la, lb)
        kinds = {n: t for n, t in self.graph.rel_props(segs).items() if n in e.columns}
        key, to = self.temp("f"), self.temp("t")
        names = ["_id", "_src", "_dst", *(["_type"] if len({s.type for s in segs}) != 1 else []), *kinds]
        cols = [c(n).alias(col(r.var, n)) for n in names] + [c("f").alias(key), c("t").alias(to)]
        self.note("Expand", f"({a.var})-[{r.var}:{'|'.join(dict.fromkeys(s.type for s in segs))}]-({b.var}) {direction}")
        rel = Bound("rel", segments=tuple(segs), props=kinds, fields=tuple(names))
        bound = b.var in frame.vars or a.var == b.var
        if ends:
            cols += [c("tl").alias(self_tl := self.temp("l")), c("fl").alias(self_fl := self.temp("l"))]
        e = e.select(*cols)
        if frame.df is None:  # the edges stand for the first node
            multi = len(la) > 1
            df = e.withColumnRenamed(key, col(a.var, "_id"))
            if multi:
                df = df.withColumnRenamed(self_fl, col(a.var, "_label"))
            frame = Frame(df, {a.var: Bound("node", labels=la, fields=("_id", "_label") if multi else ("_id",)), r.var: rel})
            if a.var == b.var:
                df = df.filter(c(col(a.var, "_id")) == c(to))
        else:
            on = c(col(a.var, "_id")) == c(key)
            if bound:
                on = on & (c(col(b.var, "_id")) == c(to))
            df = frame.df.join(e, on).drop(key)
            frame = replace(frame, vars={**frame.vars, r.var: rel})
        if bound:
            df = df.drop(to)
        else:
            df = df.withColumnRenamed(to, col(b.var, "_id"))
            if len(lb) > 1:
                df = df.withColumnRenamed(self_tl, col(b.var, "_label"))
        if ends:
            df = df.drop(self_tl, self_fl)
        frame = self.inline(replace(frame, df=df), r.var, r.props)
        if not bound:
            frame = self.hydrate(frame, b, lb, has_label=len(lb) > 1)
            return self.inline(frame, b.var, b.props)
        return self.need_bound(frame, b, labels) if b.props else frame

    def node_struct(self, label: Column, ident: Column, kinds: Mapping[str, T.DataType], get) -> tuple[Column, T.DataType]:
        fields = sorted(kinds.items())
        made = F.struct(ident.alias("_id"), label.alias("_label"), *(get(n, t).alias(n) for n, t in fields))
        return made, X.NodeType([T.StructField("_id", INT), T.StructField("_label", STR), *(T.StructField(n, t) for n, t in fields)])

    def path_kinds(self) -> dict[str, T.DataType]:
        """Properties that nodes of a path carry: those that the query mentions anywhere, or all."""
        return {n: t for n, t in self.graph.node_props(self.graph.nodes).items() if self.usage.everything or n in self.usage.mentioned}

    def rel_struct(self, segs: list[Segment], needed: set[str] | None) -> tuple[Column, T.DataType]:
        kinds = sorted((n, t) for n, t in self.graph.rel_props(segs).items() if needed is None or n in needed)
        made = F.struct("_id", "_type", "_src", "_dst", *(c(n) for n, _ in kinds))
        return made, X.RelType([T.StructField("_id", INT), T.StructField("_type", STR), T.StructField("_src", INT), T.StructField("_dst", INT), *(T.StructField(n, t) for n, t in kinds)])

    def var_hop(self, frame: Frame, p: A.PathPat, r: A.RelPat, a: A.NodePat, b: A.NodePat, direction: str, backward: bool, labels: dict, segs: list[Segment]) -> Frame:
        """One row for each distinct path of lo to hi relationships, none twice in a path. Unrolled joins."""
        parts = self.path_parts(p)
        props = self.usage.of(r.var)
        wants_rels = r.named and (props is None or bool(props - {k for k, _ in r.props})) or "rels" in parts
        needed = None if props is None and r.named else (props | self.usage.mentioned)
        e = self.oriented(segs, direction, needed, True)
        if r.props:
            compile = self.compiler({r.var: Bound("rel", segments=tuple(segs), props=self.graph.rel_props(segs))})
            for name, value in r.props:
                t = self.graph.rel_props(segs).get(name)
                e = e.filter(X.equal(V(c(name), t) if t else X.lit(None), compile(value)).col)
        made, rel_type = self.rel_struct(segs, needed)
        cols = [c("f").alias("#f"), c("t").alias("#t"), c("_id").alias("#e"), c("tl").alias("#tl"), *([made.alias("#r")] if wants_rels else [])]
        e = e.select(*cols)
        node_type = None
        if "nodes" in parts:
            kinds = self.path_kinds()
            table = self.graph.scan(self.graph.nodes, kinds, True)
            st, node_type = self.node_struct(c("_label"), c("_id"), kinds, lambda n, t: c(n))
            e = e.join(table.select(c("_id").alias("#n"), st.alias("#s")), c("#t") == c("#n")).drop("#n")
        self.note("ExpandVarLength", f"({a.var})-[{r.var}*{r.lo}..{'' if r.hi is None else r.hi}]-({b.var}) {direction}")
        la = frame.vars[a.var]
        empty = F.array().cast("array<bigint>")
        level = frame.df.select(
            "*", c(col(a.var, "_id")).alias("#at"), label_of(a.var, la).alias("#lab"), empty.alias("#ids"), empty.alias("#after"),
            *([F.array().cast(T.ArrayType(T.StructType(rel_type.fields))).alias("#rels")] if wants_rels else []),
            *([F.array().cast(T.ArrayType(T.StructType(node_type.fields))).alias("#nodes")] if node_type else []),
        )
        keep = frame.df.columns

        def grow(level: DataFrame) -> DataFrame:
            on = (c("#at") == c("#f")) & ~F.array_contains("#ids", c("#e"))
            return level.join(e, on).select(
                *map(c, keep), c("#t").alias("#at"), c("#tl").alias("#lab"), F.array_append("#ids", c("#e")).alias("#ids"), F.array_append("#after", c("#t")).alias("#after"),
                *([F.array_append("#rels", c("#r")).alias("#rels")] if wants_rels else []), *([F.array_append("#nodes", c("#s")).alias("#nodes")] if node_type else []),
            )

        last = max(UNBOUNDED_DEPTH, r.lo) if r.hi is None else r.hi
        out = None
        for depth in range(last + 1):
            if depth:
                level = grow(level)
            if depth >= r.lo:
                out = level if out is None else out.unionByName(level)
        if out is None:
            out = level.limit(0)
        if r.hi is None:  # a live frontier is an error, so that no path is ever left out in silence
            # in a CASE over the path itself, so that no rule can evaluate the error before the join has found a row
            error = F.raise_error(F.concat(F.lit("unbounded pattern is still growing at depth "), F.size("#ids").cast("string")))
            deeper = grow(level).filter(F.when(F.size(F.array_distinct("#ids")) == F.size("#ids"), error).isNotNull())
            out = out.unionByName(deeper)
        lb = labels[b.var]
        if len(lb) < len(self.graph.nodes):
            out = out.filter(F.coalesce(c("#lab"), F.lit("")).isin(*lb)) if lb else out.limit(0)
        if backward:  # arrays in the pattern's order: the nodes after the first one, and the relationships
            back = F.slice(F.reverse(F.concat(F.array(c(col(a.var, "_id"))), c("#after"))), F.lit(2), F.greatest(F.size("#after"), F.lit(0)))
            out = out.withColumn("#after", back).withColumn("#ids", F.reverse("#ids"))
            if wants_rels:
                out = out.withColumn("#rels", F.reverse("#rels"))
            if node_type:
                kinds = self.path_kinds()
                own, _ = self.node_struct(label_of(a.var, la), c(col(a.var, "_id")), kinds, lambda n, t: as_type(c(col(a.var, n)), la.props[n], t) if n in la.props else F.lit(None).cast(t))
                out = out.withColumn("#nodes", F.slice(F.reverse(F.concat(F.array(own), c("#nodes"))), F.lit(2), F.greatest(F.size("#nodes"), F.lit(0))))
        fields, extra = ["ids", "after"], {}
        renames = [("#ids", col(r.var, "ids")), ("#after", col(r.var, "after"))]
        if wants_rels:
            renames.append(("#rels", col(r.var)))
            fields.append("")
        if node_type:
            renames.append(("#nodes", col(r.var, "nodes")))
            fields.append("nodes")
            extra["nodes"] = T.ArrayType(node_type)
        for old, new in renames:
            out = out.withColumnRenamed(old, new)
        rel = Bound("rels", T.ArrayType(rel_type), segments=tuple(segs), props=extra, fields=tuple(fields))
        bound = b.var in frame.vars
        if bound:
            out = out.filter(c("#at") == c(col(b.var, "_id"))).drop("#at", "#lab")
            return self.inline(replace(frame, df=out, vars={**frame.vars, r.var: rel}), b.var, b.props)
        multi = len(lb) != 1
        out = out.withColumnRenamed("#at", col(b.var, "_id"))
        out = out.withColumnRenamed("#lab", col(b.var, "_label")) if multi else out.drop("#lab")
        frame = self.hydrate(replace(frame, df=out, vars={**frame.vars, r.var: rel}), b, lb, has_label=multi)
        return self.inline(frame, b.var, b.props)

    def named_path(self, frame: Frame, p: A.PathPat) -> Frame:
        first = p.nodes[0]
        nodes, ids = [F.array(c(col(first.var, "_id")))], []
        for r, n in zip(p.rels, p.nodes[1:]):
            if r.variable:
                nodes.append(c(col(r.var, "after")))
                ids.append(c(col(r.var, "ids")))
            else:
                nodes.append(F.array(c(col(n.var, "_id"))))
                ids.append(F.array(c(col(r.var, "_id"))))
        join = lambda xs: F.concat(*xs) if len(xs) > 1 else xs[0]
        cols = {"node_ids": join(nodes), "rel_ids": join(ids) if ids else F.array().cast("array<bigint>")}
        parts, kinds = self.path_parts(p), {}
        if "nodes" in parts:
            want = self.path_kinds()
            structs, node_type = [], None
            for i, n in enumerate(p.nodes):
                if i and p.rels[i - 1].variable:
                    structs.append(c(col(p.rels[i - 1].var, "nodes")))
                    node_type = frame.vars[p.rels[i - 1].var].props["nodes"].elementType
                    continue
                b = frame.vars[n.var]
                made, node_type = self.node_struct(label_of(n.var, b), c(col(n.var, "_id")), want, lambda x, t, n=n, b=b: as_type(c(col(n.var, x)), b.props[x], t) if x in b.props else F.lit(None).cast(t))
                structs.append(F.array(made))
            cols["nodes"] = join(structs)
            kinds["nodes"] = T.ArrayType(node_type)
        if "rels" in parts:
            segs = [s for r in p.rels for s in frame.vars[r.var].segments]
            want = sorted((n, t) for n, t in self.graph.rel_props(segs).items() if self.usage.everything or n in self.usage.mentioned)
            shape = X.RelType([T.StructField("_id", INT), T.StructField("_type", STR), T.StructField("_src", INT), T.StructField("_dst", INT), *(T.StructField(n, t) for n, t in want)])
            structs = []
            for r in p.rels:
                b = frame.vars[r.var]
                if r.variable:
                    have = {f.name: f.dataType for f in b.t.elementType.fields}
                    structs.append(F.transform(c(col(r.var)), lambda x, have=have: F.struct(*(x.getField(k).alias(k) for k in ("_id", "_type", "_src", "_dst")), *((as_type(x.getField(n), have[n], t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in want))))
                else:
                    structs.append(F.array(F.struct(c(col(r.var, "_id")).alias("_id"), type_of(r.var, b).alias("_type"), c(col(r.var, "_src")).alias("_src"), c(col(r.var, "_dst")).alias("_dst"), *((as_type(c(col(r.var, n)), b.props[n], t) if n in b.props else F.lit(None).cast(t)).alias(n) for n, t in want))))
            cols["rels"] = join(structs) if structs else F.array().cast(T.ArrayType(T.StructType(shape.fields)))
            kinds["rels"] = T.ArrayType(shape)
        self.note("Path", p.var)
        df = frame.df.select("*", *(x.alias(col(p.var, n)) for n, x in cols.items()))
        return replace(frame, df=df, vars={**frame.vars, p.var: Bound("path", X.PATH, props=kinds, fields=tuple(cols))})

    def shortest(self, frame: Frame, p: A.PathPat, labels: dict) -> Frame:
        from ..operators.traversal import bfs_paths

        if len(p.rels) != 1:
            raise QueryError("a shortest path has one relationship pattern")
        (a, b), r = p.nodes, p.rels[0]
        for n in (a, b):
            if n.var not in frame.vars and (n is a or n.labels or n.props or n.named and p.kind == "all"):
                df, bound = self.scan(n.var, labels[n.var], self.node_need(n.var))
                own = self.inline(Frame(df, {n.var: bound}), n.var, n.props)
                if n is a:
                    frame = self.cross(frame, own)
                else:  # found nodes are joined to it; no product of both ends
                    tail = own
        bound_tail = b.var in frame.vars
        if p.kind == "all" and not bound_tail and not b.named:
            raise QueryError("allShortestPaths needs a bound end")
        segs = self.graph.segments_of(r.types)
        direction = "both" if self.undirected_shortest else r.direction
        if self.undirected_shortest:
            segs = list(self.graph.segments)
        e = self.oriented(segs, direction, {k for k, _ in r.props}, True)
        for name, value in r.props:
            e = e.filter(X.equal(V(c(name), self.graph.rel_props(segs).get(name, X.NULL)), self.compiler({})(value)).col)
        lo = 0 if r.lo == 0 else 1
        hi = 1 if r.lo is None else min(64, r.hi) if r.hi is not None else 64
        self.note("ShortestPath" if p.kind == "shortest" else "AllShortestPaths", f"({a.var})-({b.var}) {direction}, at most {hi}")
        pairs = frame.df.select(c(col(a.var, "_id")).alias("src"), c(col(b.var, "_id")).alias("dst")).distinct() if bound_tail else None
        sources = frame.df.select(c(col(a.var, "_id")).alias("src")).distinct()
        ends = None if bound_tail or "tail" not in locals() else tail.df.select(c(col(b.var, "_id")).alias("dst")).distinct()
        found = bfs_paths(sources, e.select(c("_id").alias("rel"), "f", "t", c("tl").alias("label")), hi, pairs=pairs, ends=ends, all_paths=p.kind == "all", lo=lo)
        found = found.select(c("src").alias("#src"), c("dst").alias("#dst"), c("label").alias("#lab"), c("node_ids").alias(col(p.var, "node_ids")), c("rel_ids").alias(col(p.var, "rel_ids"))) if p.var else found.select(c("src").alias("#src"), c("dst").alias("#dst"), c("label").alias("#lab"))
        on = c(col(a.var, "_id")) == c("#src")
        vars = dict(frame.vars)
        if bound_tail:
            df = frame.df.join(found, on & (c(col(b.var, "_id")) == c("#dst"))).drop("#src", "#dst", "#lab")
        else:
            df = frame.df.join(found, on).drop("#src")
            if ends is not None:
                df = df.join(tail.df, c("#dst") == c(col(b.var, "_id"))).drop("#dst", "#lab")
                vars[b.var] = tail.vars[b.var]
            else:
                df = df.withColumnRenamed("#dst", col(b.var, "_id")).withColumnRenamed("#lab", col(b.var, "_label"))
                frame = self.hydrate(Frame(df, {**vars, b.var: Bound("node", labels=labels[b.var], fields=("_id", "_label"))}, frame.carry), b, labels[b.var], has_label=True)
                df, vars = frame.df, dict(frame.vars)
        if p.var:
            vars[p.var] = Bound("path", X.PATH, fields=("node_ids", "rel_ids"))
            frame = Frame(df, vars, frame.carry)
            return self.path_members(frame, p, segs)
        return Frame(df, vars, frame.carry)

    def path_members(self, frame: Frame, p: A.PathPat, segs: list[Segment]) -> Frame:
        """nodes(p) and relationships(p) of a path that was found as ids: its members are joined to their tables."""
        df, b = frame.df, frame.vars[p.var]
        for part in sorted(self.path_parts(p)):
            ids = "node_ids" if part == "nodes" else "rel_ids"
            if part == "nodes":
                kinds = self.path_kinds()
                made, kind = self.node_struct(c("_label"), c("_id"), kinds, lambda n, t: c(n))
                table = self.graph.scan(self.graph.nodes, kinds, True).select(c("_id").alias("#id"), made.alias("#s"))
            else:
                made, kind = self.rel_struct(segs, None if self.usage.everything else self.usage.mentioned)
                table = self.graph.edges(segs, None if self.usage.everything else self.usage.mentioned).select(c("_id").alias("#id"), made.alias("#s"))
            key = c(col(p.var, ids))
            members = df.select(key.alias("#key")).distinct().select("#key", F.posexplode("#key").alias("#pos", "#id"))
            lists = members.join(table, "#id").groupBy("#key").agg(F.transform(F.array_sort(F.collect_list(F.struct("#pos", "#s"))), lambda x: x.getField("#s")).alias(col(p.var, part)))
            df = df.join(lists, key == c("#key"), "left").drop("#key")
            empty = F.array().cast(T.ArrayType(T.StructType(kind.fields)))
            df = df.withColumn(col(p.var, part), F.coalesce(c(col(p.var, part)), F.when(F.size(key) == 0, empty)))
            b = replace(b, props={**b.props, part: T.ArrayType(kind)}, fields=(*b.fields, part))
        return replace(frame, df=df, vars={**frame.vars, p.var: b})

    def optional(self, frame: Frame, k: A.Match) -> Frame:
        """A left join; WHERE belongs to the pattern, so it is part of the join condition."""
        where, searches = self.searches(k.where)
        labels, segments = self.resolve(k.patterns, frame.vars)
        shared = [n for n in dict.fromkeys(n.var for p in k.patterns for n in p.nodes) if n in frame.vars]
        used = {x: self.usage.of(x) for x in shared}
        patterns, on = [], F.lit(True)
        for p in k.patterns:  # shared nodes are only ids on the right; what is asked of them is asked on the left
            nodes = []
            for n in p.nodes:
                if n.var in frame.vars:
                    b = frame.vars[n.var]
                    if n.labels and not set(b.labels) <= set(n.labels):
                        on = on & label_of(n.var, b).isin(*n.labels)
                    compile = self.compiler(frame.vars)
                    for name, value in n.props:
                        on = on & X.equal(compile(A.Prop(A.Var(n.var), name)), compile(value)).col
                    n = replace(n, props=())
                nodes.append(n)
            patterns.append(replace(p, nodes=tuple(nodes)))
        right = Frame()
        props, whole, everything = self.usage.props, self.usage.whole, self.usage.everything
        self.usage.props = type(props)(set, {n: s for n, s in props.items() if n not in shared})
        self.usage.whole = whole - set(shared)
        if everything:
            self.usage.everything, self.usage.whole = False, self.usage.whole | {x.var for p in patterns for x in (*p.nodes, *p.rels) if x.var not in shared}
        try:
            for p in patterns:
                if p.kind == "plain":
                    right = self.pattern(right, p, labels, segments)
                else:
                    ends = self.rows(frame).select(*(c(col(n.var, "_id")) for n in p.nodes if n.var in frame.vars)).distinct()
                    right = self.shortest(Frame(ends, {n.var: Bound("node", labels=labels[n.var], fields=("_id",)) for n in p.nodes if n.var in frame.vars}), p, labels)
        finally:
            self.usage.props, self.usage.whole, self.usage.everything = props, whole, everything
            for x, u in used.items():
                if u is not None:
                    self.usage.props[x] |= u
        right = self.unique_filter(right, tuple(patterns))
        for s in searches:
            if s.args["var"] in frame.vars and s.args["var"] not in right.vars:
                raise QueryError("a search condition must be on a variable of its own pattern")
            right = self.search(right, s)
        df = right.df
        for n in shared:
            key = self.temp("r")
            df = df.drop(*(col(n, x) for x in right.vars[n].fields if x != "_id")).withColumnRenamed(col(n, "_id"), key)
            on = on & (c(col(n, "_id")) == c(key))
        new = {n: b for n, b in right.vars.items() if n not in shared}
        # a relationship type or label that is a constant must be NULL where nothing matched: label_of and type_of see to it
        vars = {**frame.vars, **new}
        if where is not None:
            on = on & X.truth(self.compiler(vars)(where))
        self.note("OptionalJoin", ", ".join(shared))
        df = self.rows(frame).join(df, on, "left")
        return Frame(df.select(*map(c, Frame(df, vars, frame.carry, frame.sorted_by).columns())), vars, frame.carry, frame.sorted_by)

    # -- search conditions
    def searches(self, where: A.Expr | None):
        """Splits the search conditions off a conjunction."""
        if where is None:
            return None, []
        parts, found, rest = [where], [], []
        while parts:
            e = parts.pop(0)
            if isinstance(e, A.Binary) and e.op == "and":
                parts = [e.left, e.right, *parts]
            elif (s := Search.of(e)) is not None:
                found.append(s)
            else:
                rest.append(e)
        out = None
        for e in rest:
            out = e if out is None else A.Binary("and", out, e)
        return out, found

    def search(self, frame: Frame, s: Search) -> Frame:
        """A semi-join with the ids that the search gives."""
        var = s.args["var"]
        if var not in frame.vars or frame.vars[var].kind != "node":
            raise QueryError(f"{var} is no node")
        labels = frame.vars[var].labels
        self.note("Search", s.kind)
        if s.kind == "community":
            if self.graph.membership is None:
                raise QueryError("the graph has no communities; add them with with_(membership=...)")
            m = self.graph.membership
            level = m.filter(F.col("level") == 0) if "level" in m.columns else m
            ids = level.filter(F.col("community_id") == F.lit(self.known(s.args["value"]))).select(F.col("node_id").alias("#id"))
        elif s.kind == "vector_within":
            ids = self.within(labels, s).select(c("_id").alias("#id"))
        else:
            # a text condition holds for every node with a match; a vector one for the k nearest of the rows so far
            leg = A.RankLeg(s.kind, var, s.args["prop"], s.args["value"], s.args.get("k") or (self.near_k if s.kind in ("near", "vector") else None))
            searched = self
            if leg.k is not None and frame.df is not None:
                candidates = frame.df.select(c(col(var, "_id")).alias("_id")).distinct()
                searched = replace_graph(self, PropertyGraph(self.graph.spark, {x: self.graph.nodes[x].join(candidates, "_id", "left_semi") for x in labels}, ()))
            ids = searched.leg(labels, leg).select(c("_id").alias("#id"))
        return replace(frame, df=frame.df.join(ids, c(col(var, "_id")) == c("#id"), "left_semi"))

    def within(self, labels: tuple, s: Search) -> DataFrame:
        from ..operators.vector import distance

        table = self.graph.scan(labels, [s.args["prop"]])
        query = [float(x) for x in self.known(s.args["value"])]
        d = distance(c(s.args["prop"]), query, "l2")
        limit = float(self.known(s.args["limit"]))
        return table.filter({"<": d < limit, "<=": d <= limit, ">": d > limit, ">=": d >= limit}[s.args["op"]]).select("_id")

    def leg(self, labels: tuple, leg: A.RankLeg) -> DataFrame:
        """_id, score: the k best nodes of one search."""
        from ..operators import text, vector

        if leg.prop not in self.graph.node_props(labels):
            raise QueryError(f"no property {leg.prop} to search in")
        table = self.graph.scan(labels, [leg.prop])
        q = self.known(leg.query)
        if leg.kind in ("vector", "near"):
            if not isinstance(q, list | tuple):
                raise QueryError("a vector search needs a list of numbers")
            return vector.top_k(table, "_id", leg.prop, [float(x) for x in q], leg.k)
        if not isinstance(q, str):
            raise QueryError("a text search needs a string")
        return text.bm25(table.select("_id", c(leg.prop).alias("body")), q, leg.k)

    def rank(self, frame: Frame, k: A.RankBy) -> Frame:
        from ..operators.fusion import rrf

        var = k.legs[0].var
        if {leg.kind for leg in k.legs} != {"vector", "text"} or len({leg.var for leg in k.legs}) != 1:
            raise QueryError("HYBRID needs a VECTOR and a TEXT part on one variable")
        if any(leg.k is None for leg in k.legs):
            raise QueryError("both parts of HYBRID need K")
        if var not in frame.vars or frame.vars[var].kind != "node":
            raise QueryError(f"{var} is no node")
        self.note("RankByHybrid", f"RRF(k={k.rrf_k})")
        candidates = frame.df.select(c(col(var, "_id")).alias("_id")).distinct()
        found = []
        for leg in k.legs:  # filters come first: only candidates of MATCH are ranked
            whole = self.graph.nodes
            b = frame.vars[var]
            sub = PropertyGraph(self.graph.spark, {x: whole[x].join(candidates, "_id", "left_semi") for x in b.labels}, ())
            found.append(replace_graph(self, sub).leg(b.labels, leg))
        score = rrf([f.select("_id", "score") for f in found], "_id", k.rrf_k).select(c("_id").alias("#id"), c("score").alias("#score"))
        df = frame.df.join(score, c(col(var, "_id")) == c("#id")).drop("#id")
        vars = dict(frame.vars)
        if k.alias:
            df = df.withColumnRenamed("#score", col(k.alias))
            vars[k.alias] = Bound("value", X.FLOAT, fields=("",))
        else:
            df = df.drop("#score")
        return replace(frame, df=df, vars=vars)

    # -- projection
    def items(self, frame: Frame, k: A.Projection) -> list[A.Item]:
        star = [A.Item(A.Var(n), n) for n in frame.vars if not n.startswith("_anon")] if k.star else []
        return star + list(k.items)

    def projection(self, frame: Frame, k: A.Projection) -> Frame:
        items = self.items(frame, k)
        if not items:
            raise QueryError("nothing to project")
        by_alias = {i.name: i.expr for i in items}
        order = [(replaced(e, lambda x: by_alias.get(x.name) if isinstance(x, A.Var) else None), d) for e, d in k.order]
        if any(has_aggregate(i.expr) for i in items) or any(has_aggregate(e) for e, _ in order):
            frame, items, order = self.aggregated(frame, items, order)
        self.note("Project", ", ".join(i.name for i in items))
        compile = self.compiler(frame.vars)
        cols: list[Column] = []
        vars: dict[str, Bound] = {}
        for i in items:
            b = frame.vars.get(i.expr.name) if isinstance(i.expr, A.Var) else None
            if isinstance(i.expr, A.Var) and b is None:
                raise QueryError(f"unknown variable {i.expr.name}")
            if b is not None and b.kind != "value" and not k.final:
                fields = b.fields
                cols += [c(col(i.expr.name, f)).alias(col(i.name, f)) for f in fields]
                vars[i.name] = b
            else:
                v = compile(i.expr) if b is None else bound_value(i.expr.name, b)
                cols.append(v.col.alias(col(i.name)))
                vars[i.name] = Bound("value", v.t, fields=("",))
        keys = [(self.temp("o"), compile(e).col, d) for e, d in order]
        df = self.rows(frame).select(*cols, *(x.alias(n) for n, x, _ in keys), *map(c, frame.carry))
        out = Frame(df, vars, frame.carry)
        if k.distinct:
            self.note("Distinct")
            out = replace(out, df=self.distinct(out))
        if keys or k.skip is not None or k.limit is not None:
            out = self.tail(out, [(n, d) for n, _, d in keys], k.skip, k.limit)
        if k.final or not keys:
            out = replace(out, df=out.df.select(*map(c, replace(out, sorted_by=()).columns())), sorted_by=())
        if k.where is not None:
            self.note("Filter", repr(k.where)[:200])
            out = replace(out, df=out.df.filter(X.truth(self.compiler(out.vars)(k.where))))
        return out

    def distinct(self, frame: Frame) -> DataFrame:
        """Rows that differ in values; nodes and relationships are told apart by id."""
        keys = list(frame.carry)
        for v, b in frame.vars.items():
            keys += [col(v, "_id")] if b.kind in ("node", "rel") else [col(v, "ids")] if b.kind == "rels" else [col(v, "node_ids"), col(v, "rel_ids")] if b.kind == "path" else [col(v)]
        if all(b.kind == "value" for b in frame.vars.values()):
            struct = [v for v, b in frame.vars.items() if isinstance(b.t, T.MapType)]
            if struct:
                raise QueryError("DISTINCT over maps without fixed fields")
            if len(frame.df.columns) == len(keys):
                return frame.df.distinct()
        return frame.df.dropDuplicates(keys)

    def tail(self, frame: Frame, keys: list[tuple[str, bool]], skip: A.Expr | None, limit: A.Expr | None) -> Frame:
        n_skip, n_limit = self.count(skip, "SKIP"), self.count(limit, "LIMIT")
        order = [null_order(c(n), d) for n, d in keys]
        df = frame.df
        if keys:
            self.note("Sort")
        if frame.carry and (n_skip or n_limit is not None):  # inside CALL: for each driving row
            rank = F.row_number().over(Window.partitionBy(*map(c, frame.carry)).orderBy(*(order or [F.lit(1)])))
            df = df.withColumn("#rank", rank).filter(c("#rank") > (n_skip or 0))
            if n_limit is not None:
                df = df.filter(c("#rank") <= (n_skip or 0) + n_limit)
            df = df.drop("#rank")
        else:
            if order:
                df = df.orderBy(*order)
            if n_skip:
                self.note("Skip", str(n_skip))
                df = df.offset(n_skip)
            if n_limit is not None:
                self.note("Limit", str(n_limit))
                df = df.limit(n_limit)
        return replace(frame, df=df, sorted_by=tuple(keys))

    def aggregated(self, frame: Frame, items: list[A.Item], order: list) -> tuple[Frame, list[A.Item], list]:
        """Groups by the items without aggregates. Gives a frame of keys and aggregates, and the items in terms of them."""
        compile = self.compiler(frame.vars)
        keys = [i for i in items if not has_aggregate(i.expr)]
        cols, carried, vars = [], [], {}
        swap: dict[A.Expr, A.Expr] = {}
        for i in keys:
            b = frame.vars.get(i.expr.name) if isinstance(i.expr, A.Var) else None
            name = f"#key{len(swap)}"
            if b is not None and b.kind in ("node", "rel"):  # grouped by id alone; the rest follows from it
                cols.append(c(col(i.expr.name, "_id")).alias(col(name, "_id")))
                carried += [F.first(c(col(i.expr.name, f))).alias(col(name, f)) for f in b.fields if f != "_id"]
                vars[name] = b
            elif b is not None and b.kind in ("path", "rels"):
                lead = ("node_ids", "rel_ids") if b.kind == "path" else ("ids",)
                cols += [c(col(i.expr.name, f)).alias(col(name, f)) for f in lead]
                carried += [F.first(c(col(i.expr.name, f))).alias(col(name, f)) for f in b.fields if f not in lead]
                vars[name] = b
            else:
                v = compile(i.expr)
                cols.append(v.col.alias(col(name)))
                vars[name] = Bound("value", v.t, fields=("",))
            swap[i.expr] = A.Var(name)
        aggs: list[Column] = []

        def lift(e: A.Expr) -> A.Expr | None:
            if e in swap:
                return swap[e]
            if is_aggregate(e):
                name = f"#agg{len(swap)}"
                v = self.aggregate(frame, compile, e)
                aggs.append(v.col.alias(col(name)))
                vars[name] = Bound("value", v.t, fields=("",))
                swap[e] = A.Var(name)
                return swap[e]
            if isinstance(e, A.Prop) and isinstance(e.of, A.Var) and e.of in swap:
                return A.Prop(swap[e.of], e.name)
            return None

        new_items = [A.Item(replaced(i.expr, lift), i.name) for i in items]
        new_order = [(replaced(e, lift), d) for e, d in order]
        for e in [i.expr for i in new_items] + [e for e, _ in new_order]:
            for x in walk(e):
                if isinstance(x, A.Var) and x.name in frame.vars and x.name not in vars and not any(isinstance(y, A.Quantifier | A.Comprehension | A.Reduce) for y in walk(e)):
                    raise QueryError(f"{x.name} is used beside an aggregate but is no grouping key")
        self.note("Aggregate", f"{len(cols)} keys, {len(aggs)} aggregates")
        group = [*cols, *(c(x).alias(x) for x in frame.carry)]
        aggs = [*aggs, *carried] or [F.count("*").alias("#n")]
        df = self.rows(frame)
        df = df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
        return Frame(df, vars, frame.carry), new_items, new_order

    def aggregate(self, frame: Frame, compile: Compiler, e: A.Call) -> V:
        if e.star:
            return V(F.count(F.lit(1)), INT)
        if len(e.args) != 1 or has_aggregate(e.args[0]):
            raise QueryError(f"{e.name}() takes one argument without aggregates")
        arg = e.args[0]
        if e.name == "count" and isinstance(arg, A.Var) and frame.vars.get(arg.name) and frame.vars[arg.name].kind in ("node", "rel", "rels"):
            x = c(col(arg.name, "ids" if frame.vars[arg.name].kind == "rels" else "_id"))
            return V(F.count_distinct(x) if e.distinct else F.count(x), INT)
        v = compile(arg)
        x = v.col
        if e.name == "count":
            if e.distinct and X.kind(v.t) in ("node", "rel"):
                x = x.getField("_id")
            return V(F.count_distinct(x) if e.distinct else F.count(x), INT)
        if e.name == "collect":
            if e.distinct:
                return V(F.array_distinct(self.collected(frame, x) if frame.sorted_by else F.collect_list(x)), T.ArrayType(v.t))
            if frame.sorted_by:
                return V(self.collected(frame, x), T.ArrayType(v.t))
            return V(F.collect_list(x), T.ArrayType(v.t))
        if e.name in ("min", "max"):
            if isinstance(v.t, T.NullType):
                return V(F.max(x), v.t)
            return V(F.min(x) if e.name == "min" else F.max(x), v.t)
        if X.kind(v.t) not in ("num", "null"):
            raise QueryError(f"{e.name}() needs numbers")
        if isinstance(v.t, T.NullType):
            x = x.cast("long")
        if e.name == "sum":
            return V(F.sum_distinct(x) if e.distinct else F.sum(x), v.t if X.kind(v.t) == "num" else INT)
        y = x.cast("double")
        return V(F.call_function("avg", y) if not e.distinct else F.sum_distinct(y) / F.nullif(F.count_distinct(y), F.lit(0)), X.FLOAT)

    @staticmethod
    def collected(frame: Frame, x: Column) -> Column:
        """collect() after ORDER BY: the elements in that order."""
        keys = frame.sorted_by
        rows = F.collect_list(F.when(x.isNotNull(), F.struct(*(c(n).alias(f"k{i}") for i, (n, _) in enumerate(keys)), x.alias("x"))))

        def compare(a: Column, b: Column) -> Column:
            out = None
            for i, (_, d) in enumerate(keys):
                p, q = a.getField(f"k{i}"), b.getField(f"k{i}")
                sign = -1 if d else 1
                for test, value in ((p.isNull() & q.isNotNull(), sign), (p.isNotNull() & q.isNull(), -sign), (p < q, -sign), (p > q, sign)):
                    out = F.when(test, value) if out is None else out.when(test, value)
            return out.otherwise(0)

        return F.transform(F.array_sort(rows, compare), lambda r: r.getField("x"))

    # -- other clauses
    def unwind(self, frame: Frame, k: A.Unwind) -> Frame:
        v = self.compiler(frame.vars)(k.source)
        if X.kind(v.t) == "null":
            v = V(F.lit(None).cast("array<string>"), T.ArrayType(STR))
        if not isinstance(v.t, T.ArrayType):
            raise QueryError("UNWIND needs a list")
        self.note("Unwind", k.var)
        df = self.rows(frame).select("*", F.explode(v.col).alias(col(k.var)))
        return replace(frame, df=df, vars={**frame.vars, k.var: Bound("value", v.t.elementType, fields=("",))})

    def subquery(self, frame: Frame, q: A.Query) -> Frame:
        """CALL { … }: the body runs once over the distinct imported values and is joined back."""
        first = q.bodies[0][0]
        imports = [i.expr.name for i in first.items] if isinstance(first, A.Projection) and not first.final and all(isinstance(i.expr, A.Var) and i.name == i.expr.name and i.expr.name in frame.vars for i in first.items) and not first.star else []
        if not imports:
            body = self.query(q)
            self.note("Call")
            return self.joined(frame, Frame(self.rows(body), body.vars), [])
        keys = []
        for n in imports:
            b = frame.vars[n]
            keys += [(col(n, f), self.temp("in")) for f in (["_id"] if b.kind in ("node", "rel") else [x for x in b.fields])]
        outer = frame.df.select(*(c(col(n, f)) for n in imports for f in frame.vars[n].fields), *(c(a).alias(x) for a, x in keys))
        outer = outer.dropDuplicates([x for _, x in keys])
        carry = tuple(x for _, x in keys)
        bodies = []
        for b in q.bodies:
            own = b[0]
            names = {i.expr.name for i in own.items if isinstance(i.expr, A.Var)} if isinstance(own, A.Projection) and not own.final else set()
            bodies.append(b[1:] if names == set(imports) else b)
        start = Frame(outer, {n: frame.vars[n] for n in imports}, carry)
        body = self.query(replace(q, bodies=tuple(bodies)), start)
        # an aggregate without grouping keys gives a row for each driving row, also where nothing was found
        fill: dict[str, Column] = {}
        last = bodies[0][-1] if bodies[0] else None
        if len(bodies) == 1 and isinstance(last, A.Projection) and last.items and all(has_aggregate(i.expr) for i in last.items):
            for i in last.items:
                if isinstance(i.expr, A.Call) and i.expr.name == "count":
                    fill[i.name] = F.lit(0).cast("long")
                elif isinstance(i.expr, A.Call) and i.expr.name == "collect":
                    fill[i.name] = F.array().cast(body.vars[i.name].t if not isinstance(body.vars[i.name].t.elementType, T.StructType) else T.ArrayType(T.StructType(body.vars[i.name].t.elementType.fields)))
                else:
                    fill[i.name] = F.lit(None)
        self.note("Call", ", ".join(imports))
        return self.joined(frame, body, keys, fill)

    def joined(self, frame: Frame, body: Frame, keys: list[tuple[str, str]], fill: dict | None = None) -> Frame:
        clash = set(frame.vars) & set(body.vars)
        if clash:
            raise QueryError(f"CALL returns {sorted(clash)}, which is bound already")
        if not keys:
            df = body.df if frame.df is None else frame.df.crossJoin(body.df)
        else:
            on = F.lit(True)
            for a, x in keys:
                on = on & c(a).eqNullSafe(c(x))
            df = frame.df.join(body.df, on, "left" if fill else "inner").drop(*(x for _, x in keys))
            for n, x in (fill or {}).items():
                df = df.withColumn(col(n), F.coalesce(c(col(n)), x))
        return replace(frame, df=df, vars={**frame.vars, **body.vars})

    def procedure(self, frame: Frame, k: A.Procedure, last: bool) -> Frame:
        from .procedures import procedure

        df = procedure(self.graph, k, lambda e: self.known(e))
        vars, cols = {}, []
        kinds = {f.name: f.dataType for f in df.schema}
        yields = k.yields or tuple((n, n) for n in df.columns)
        for column, alias in yields:
            if column not in kinds:
                raise QueryError(f"{k.name} gives no {column}")
            if column == "node":  # a node of any label: hydrated like one
                n = A.NodePat(alias, (), (), True)
                own = Frame(df.select(c("node").alias(col(alias, "_id")), *(c(x) for x in df.columns if x != "node")), {})
                labels = tuple(self.graph.nodes)
                own = self.hydrate(own, n, labels, check=True)
                df = own.df
                vars[alias] = own.vars[alias]
                cols += [c(col(alias, f)) for f in own.vars[alias].fields]
            else:
                cols.append(c(column).alias(col(alias)))
                vars[alias] = Bound("value", kinds[column], fields=("",))
        self.note("ProcedureCall", k.name)
        body = Frame(df.select(*cols), vars)
        out = self.joined(frame, body, [])
        if k.where is not None:
            out = replace(out, df=out.df.filter(X.truth(self.compiler(out.vars)(k.where))))
        if last:  # a call that ends a query returns its columns
            return Frame(out.df.select(*(bound_value(n, b).col.alias(col(n)) for n, b in out.vars.items())), {n: Bound("value", bound_value(n, b).t, fields=("",)) for n, b in out.vars.items()})
        return out


@dataclass(frozen=True)
class Search:
    kind: str  # near, text, community, vector_within
    args: dict

    @staticmethod
    def of(e: A.Expr) -> Search | None:
        if isinstance(e, A.Binary) and e.op in ("near", "match") and isinstance(e.left, A.Prop) and isinstance(e.left.of, A.Var):
            return Search("near" if e.op == "near" else "text", {"var": e.left.of.name, "prop": e.left.name, "value": e.right})
        if isinstance(e, A.InCommunity) and isinstance(e.arg, A.Var):
            return Search("community", {"var": e.arg.name, "value": e.community})
        if isinstance(e, A.Binary) and e.op == "=":
            for x, y in ((e.left, e.right), (e.right, e.left)):
                if isinstance(x, A.Call) and x.name == "community" and len(x.args) == 1 and isinstance(x.args[0], A.Var):
                    return Search("community", {"var": x.args[0].name, "value": y})
        if isinstance(e, A.Call) and e.name == "text_match" and len(e.args) == 2 and isinstance(e.args[0], A.Prop):
            return Search("text", {"var": e.args[0].of.name, "prop": e.args[0].name, "value": e.args[1]})
        if isinstance(e, A.Binary) and e.op in ("<", "<=", ">", ">=") and isinstance(e.left, A.Call) and e.left.name == "vector_distance" and len(e.left.args) == 2 and isinstance(e.left.args[0], A.Prop):
            x = e.left.args[0]
            return Search("vector_within", {"var": x.of.name, "prop": x.name, "value": e.left.args[1], "op": e.op, "limit": e.right})
        return None


def replace_graph(t: Translator, graph: PropertyGraph) -> Translator:
    return Translator(graph, t.params, t.usage)


def output(frame: Frame) -> DataFrame:
    df = frame.df
    return df.select(*(c(col(n)).alias(n) for n in frame.vars)) if frame.vars else df


def execute(graph: PropertyGraph, text: str | A.Statement, params: Mapping[str, object] | None = None, **options) -> Result:
    from . import write

    statement = parse(text) if isinstance(text, str) else text
    q = statement.query
    if isinstance(q.bodies[0][0], A.CreateIndex | A.DropIndex):
        return write.ddl(graph, q.bodies[0][0])
    if statement.mode == "explain" and (outline := eager(q)):
        from .explain import outlined

        return Result(outlined(graph.spark, outline), graph)
    t = Translator(graph, params or {}, Usage().query(q), **options)
    frame = t.query(q)
    df = output(frame)
    if statement.mode != "run":
        from .explain import explained

        return Result(explained(graph.spark, t.steps, df, statement.mode == "profile"), t.graph, t.counters)
    return Result(df, t.graph, t.counters)


def eager(q: A.Query) -> list[A.Clause] | None:
    """The clauses, if building their plan would run jobs or write: all but plain reads do."""
    clauses = [k for body in q.bodies for k in body]
    lazy = lambda k: isinstance(k, A.Projection | A.Unwind) or isinstance(k, A.Match) and all(p.kind == "plain" for p in k.patterns) and not any(
        isinstance(e, A.Binary) and (e.op in ("near", "match") or isinstance(e.left, A.Call) or isinstance(e.right, A.Call)) or isinstance(e, A.InCommunity) for e in walk(k.where)
    )
    return None if all(map(lazy, clauses)) else clauses


def run_many(graph: PropertyGraph, text: str, params: Mapping[str, object] | None = None, **options) -> list[Result]:
    found = []
    for s in parse_many(text):
        found.append(execute(graph, s, params, **options))
        graph = found[-1].graph
    return found
