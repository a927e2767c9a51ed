"""Expressions of the query language -> typed Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions import values as X
from ..functions.values import BOOL, INT, STR, V
from ..graph import Segment, c
from . import ast as A
from .parser import QueryError

AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")


@dataclass(frozen=True)
class Bound:
    """What a variable stands for. Its columns are named col(variable, field)."""

    kind: str  # node, rel, rels (variable length), path, value
    t: T.DataType = field(default_factory=T.NullType)
    labels: tuple[str, ...] = ()  # candidates of a node
    segments: tuple[Segment, ...] = ()  # candidates of a relationship
    props: Mapping[str, T.DataType] = field(default_factory=dict)
    fields: tuple[str, ...] = ()  # all columns' fields


def col(var: str, name: str = "") -> str:
    return f"{var}${name}"


def bound_value(var: str, b: Bound) -> V:
    """A variable as one value: nodes and relationships become structs, NULL if their id is."""
    if b.kind in ("value", "rels"):
        return V(c(col(var)), b.t)
    if b.kind == "path":
        return V(F.when(c(col(var, "rel_ids")).isNotNull(), F.struct(c(col(var, "node_ids")).alias("node_ids"), c(col(var, "rel_ids")).alias("rel_ids"))), X.PATH)
    ident = c(col(var, "_id"))
    if b.kind == "node":
        head = [("_id", ident, INT), ("_label", label_of(var, b), STR)]
    else:
        head = [("_id", ident, INT), ("_type", type_of(var, b), STR), ("_src", c(col(var, "_src")), INT), ("_dst", c(col(var, "_dst")), INT)]
    rest = [(n, c(col(var, n)), t) for n, t in sorted(b.props.items()) if n in b.fields]
    kind = X.NodeType if b.kind == "node" else X.RelType
    return V(F.when(ident.isNotNull(), F.struct(*(x.alias(n) for n, x, _ in head + rest))), kind([T.StructField(n, t) for n, _, t in head + rest]))


def label_of(var: str, b: Bound):
    if "_label" in b.fields:
        return c(col(var, "_label"))
    return F.when(c(col(var, "_id")).isNotNull(), F.lit((b.labels[0] if b.labels else None) or None).cast("string"))


def type_of(var: str, b: Bound):
    if "_type" in b.fields:
        return c(col(var, "_type"))
    return F.when(c(col(var, "_id")).isNotNull(), F.lit(b.segments[0].type if b.segments else None).cast("string"))


def walk(e: A.Expr):
    yield e
    for x in A.children(e):
        yield from walk(x)


def is_aggregate(e: A.Expr) -> bool:
    return isinstance(e, A.Call) and e.name in AGGREGATES


def has_aggregate(e: A.Expr) -> bool:
    return any(is_aggregate(x) for x in walk(e))


def replaced(e: A.Expr, f: Callable[[A.Expr], A.Expr | None]) -> A.Expr:
    """e with every subexpression for which f gives something replaced by that."""
    if (new := f(e)) is not None:
        return new
    again = lambda x: x if x is None else replaced(x, f)
    if isinstance(e, A.Prop):
        return A.Prop(again(e.of), e.name)
    if isinstance(e, A.Index):
        return A.Index(again(e.of), again(e.at))
    if isinstance(e, A.Slice):
        return A.Slice(again(e.of), again(e.lo), again(e.hi))
    if isinstance(e, A.Unary):
        return A.Unary(e.op, again(e.arg))
    if isinstance(e, A.IsNull):
        return A.IsNull(again(e.arg), e.negated)
    if isinstance(e, A.InCommunity):
        return A.InCommunity(again(e.arg), again(e.community))
    if isinstance(e, A.Binary):
        return A.Binary(e.op, again(e.left), again(e.right))
    if isinstance(e, A.Call):
        return A.Call(e.name, tuple(map(again, e.args)), e.distinct, e.star)
    if isinstance(e, A.Case):
        return A.Case(again(e.subject), tuple((again(a), again(b)) for a, b in e.whens), again(e.default))
    if isinstance(e, A.ListLit):
        return A.ListLit(tuple(map(again, e.items)))
    if isinstance(e, A.MapLit):
        return A.MapLit(tuple((k, again(v)) for k, v in e.items))
    if isinstance(e, A.Quantifier):
        return A.Quantifier(e.kind, e.var, again(e.source), again(e.where))
    if isinstance(e, A.Reduce):
        return A.Reduce(e.acc, again(e.init), e.var, again(e.source), again(e.body))
    if isinstance(e, A.Comprehension):
        return A.Comprehension(e.var, again(e.source), again(e.where), again(e.body))
    if isinstance(e, A.MapProjection):
        return A.MapProjection(e.of, tuple((k, again(v)) for k, v in e.items))
    return e


def typed_literal(e: A.Typed) -> V:
    s = e.text.strip()
    try:
        if e.kind == "date":
            return V(F.lit(s).cast("date"), T.DateType())
        if e.kind == "datetime":
            return V(F.lit(s).cast("timestamp"), T.TimestampType())
        if e.kind == "localdatetime":
            return V(F.lit(s).cast("timestamp_ntz"), T.TimestampNTZType())
        if e.kind == "decimal":
            if not re.fullmatch(r"[-+]?\d+(\.\d+)?", s):
                raise QueryError(f"{s!r} is no decimal")
            kind = T.DecimalType(38, len(s.partition(".")[2]))
            return V(F.lit(s).cast(kind), kind)
    except ValueError as x:
        raise QueryError(str(x)) from x
    m = re.fullmatch(r"(-)?P(?:([\d.]+)Y)?(?:([\d.]+)M)?(?:([\d.]+)W)?(?:([\d.]+)D)?(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?", s)
    if not m or s.endswith(("P", "T")):
        raise QueryError(f"{s!r} is no duration")
    sign = -1 if m[1] else 1
    y, mo, w, d, h, mi, sec = (float(x or 0) for x in m.groups()[1:])
    months, nanos = int(y * 12 + mo), round((((w * 7 + d) * 24 + h) * 3600 + mi * 60 + sec) * 1e9)
    return V(F.struct(F.lit(sign * months).cast("long").alias("months"), F.lit(sign * nanos).cast("long").alias("nanos")), X.DURATION)


class Compiler:
    """Compiles expressions over bound variables; inner holds variables of lists being iterated."""

    def __init__(self, bound: Mapping[str, Bound], params: Mapping[str, object], paths: Mapping[str, object] | None = None) -> None:
        self.bound, self.params, self.paths = bound, params, paths or {}

    def __call__(self, e: A.Expr, inner: Mapping[str, V] | None = None) -> V:
        inner = inner or {}
        f = getattr(self, f"do_{type(e).__name__.lower()}", None)
        if f is None:
            raise QueryError(f"{type(e).__name__} can't be used here")
        return f(e, inner)

    def do_lit(self, e: A.Lit, inner) -> V:
        return X.lit(e.value)

    def do_typed(self, e: A.Typed, inner) -> V:
        return typed_literal(e)

    def do_param(self, e: A.Param, inner) -> V:
        if e.name not in self.params:
            raise QueryError(f"parameter ${e.name} is missing")
        return X.lit(self.params[e.name])

    def do_var(self, e: A.Var, inner) -> V:
        if e.name in inner:
            return inner[e.name]
        if e.name not in self.bound:
            raise QueryError(f"unknown variable {e.name}")
        return bound_value(e.name, self.bound[e.name])

    def entity(self, e: A.Expr, inner, *kinds: str) -> Bound | None:
        """The binding if e is a variable of a node or relationship, whose columns can then be used directly."""
        if isinstance(e, A.Var) and e.name not in inner and e.name in self.bound and self.bound[e.name].kind in kinds:
            return self.bound[e.name]
        return None

    def do_prop(self, e: A.Prop, inner) -> V:
        if b := self.entity(e.of, inner, "node", "rel"):
            if e.name not in b.props:
                return X.lit(None)
            return V(c(col(e.of.name, e.name)), b.props[e.name])
        return X.prop(self(e.of, inner), e.name)

    def do_index(self, e: A.Index, inner) -> V:
        return X.index(self(e.of, inner), self(e.at, inner))

    def do_slice(self, e: A.Slice, inner) -> V:
        return X.sliced(self(e.of, inner), e.lo and self(e.lo, inner), e.hi and self(e.hi, inner))

    def do_unary(self, e: A.Unary, inner) -> V:
        v = self(e.arg, inner)
        if e.op == "not":
            return V(~X.truth(v), BOOL)
        return X.negative(v) if e.op == "-" else v

    def do_isnull(self, e: A.IsNull, inner) -> V:
        if self.entity(e.arg, inner, "node", "rel"):
            x = c(col(e.arg.name, "_id"))
        else:
            x = self(e.arg, inner).col
        return V(x.isNotNull() if e.negated else x.isNull(), BOOL)

    def do_binary(self, e: A.Binary, inner) -> V:
        op = e.op
        if op in ("=", "<>") and self.entity(e.left, inner, "node", "rel") and self.entity(e.right, inner, "node", "rel"):
            same = c(col(e.left.name, "_id")) == c(col(e.right.name, "_id"))
            return V(same if op == "=" else ~same, BOOL)
        if op in ("<", "<=", ">", ">=") and isinstance(e.left, A.Binary) and e.left.op in ("=", "<>", "<", "<=", ">", ">="):
            raise QueryError("a chained comparison compares a Boolean; write a AND between the parts")
        a, b = self(e.left, inner), self(e.right, inner)
        if op == "and":
            return V(X.truth(a) & X.truth(b), BOOL)
        if op == "or":
            return V(X.truth(a) | X.truth(b), BOOL)
        if op == "xor":
            return V(X.truth(a) != X.truth(b), BOOL)
        if op == "=":
            return X.equal(a, b)
        if op == "<>":
            return V(~X.equal(a, b).col, BOOL)
        if op in ("<", "<=", ">", ">="):
            return X.ordered(op, a, b)
        if op in ("starts", "ends", "contains"):
            if X.kind(a.t) != "str" or X.kind(b.t) != "str":
                return X.nothing()
            return V({"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[op](a.col, b.col), BOOL)
        if op == "in":
            return X.contains_value(a, b)
        if op == "+":
            return X.add(a, b)
        if op in ("-", "*", "/", "%", "^"):
            return X.numeric(op, a, b)
        raise QueryError(f"{op.upper()} is only possible as a condition of MATCH … WHERE, joined by AND")

    def do_call(self, e: A.Call, inner) -> V:
        if e.name in AGGREGATES:
            raise QueryError(f"{e.name}() is an aggregate and can't stand here")
        if len(e.args) == 1:
            if b := self.entity(e.args[0], inner, "node", "rel"):
                var = e.args[0].name
                if e.name == "id":
                    return V(c(col(var, "_id")), INT)
                if e.name == "type" and b.kind == "rel":
                    return V(type_of(var, b), STR)
                if e.name == "labels" and b.kind == "node":
                    label = label_of(var, b)
                    out = F.when(label.isNull(), F.array().cast("array<string>")).otherwise(F.array(label))
                    return V(F.when(c(col(var, "_id")).isNotNull(), out), T.ArrayType(STR))
                if e.name == "exists":
                    return V(c(col(var, "_id")).isNotNull(), BOOL)
            if e.name in ("nodes", "relationships") and self.entity(e.args[0], inner, "path"):
                var = e.args[0].name
                name = "nodes" if e.name == "nodes" else "rels"
                b = self.bound[var]
                if name in b.fields:
                    return V(c(col(var, name)), b.props[name])
        if e.name == "community":
            raise QueryError("community() is only possible as community(n) = x, as a condition of MATCH … WHERE")
        return scalar.call(e.name, [self(a, inner) for a in e.args])

    def do_case(self, e: A.Case, inner) -> V:
        subject = None if e.subject is None else self(e.subject, inner)
        results = [self(b, inner) for _, b in e.whens] + ([self(e.default, inner)] if e.default is not None else [])
        t = X.common([r.t for r in results])
        if t is None:
            raise QueryError("the results of CASE have different kinds")
        out = None
        for (condition, _), r in zip(e.whens, results):
            v = self(condition, inner)
            test = X.truth(v) if subject is None else X.equal(subject, v).col
            out = F.when(test, X.cast(r, t)) if out is None else out.when(test, X.cast(r, t))
        if e.default is not None:
            out = out.otherwise(X.cast(results[-1], t))
        return V(out, t)

    def do_listlit(self, e: A.ListLit, inner) -> V:
        items = [self(i, inner) for i in e.items]
        out = X.make_list(items)
        if items and all(i.lit is not X.MISSING for i in items):
            return V(out.col, out.t, [i.lit for i in items])
        return out

    def do_maplit(self, e: A.MapLit, inner) -> V:
        return X.make_map([(k, self(v, inner)) for k, v in e.items])

    def source(self, e: A.Expr, inner) -> V:
        v = self(e, inner)
        if X.kind(v.t) == "null":
            return V(F.lit(None).cast("array<string>"), T.ArrayType(STR))
        if not isinstance(v.t, T.ArrayType):
            raise QueryError(f"a list is expected, not a {v.t.simpleString()}")
        return v

    def do_quantifier(self, e: A.Quantifier, inner) -> V:
        src = self.source(e.source, inner)
        item = lambda x: inner | {e.var: V(x, src.t.elementType)}
        test = lambda x: X.truth(self(e.where, item(x))) if e.where is not None else X.truth(V(x, src.t.elementType))
        if e.kind == "all":
            return V(F.forall(src.col, test), BOOL)
        if e.kind == "any":
            return V(F.exists(src.col, test), BOOL)
        if e.kind == "none":
            return V(~F.exists(src.col, test), BOOL)
        hits = F.transform(src.col, test)
        yes, unknown = F.size(F.filter(hits, lambda h: h)), F.size(F.filter(hits, lambda h: h.isNull()))
        # one hit wins over unknown ones, more are a definite no
        return V(F.when(src.col.isNull(), F.lit(None).cast("boolean")).when(yes == 1, True).when(yes > 1, False).when(unknown > 0, F.lit(None).cast("boolean")).otherwise(False), BOOL)

    def do_reduce(self, e: A.Reduce, inner) -> V:
        src, init = self.source(e.source, inner), self(e.init, inner)
        t = init.t
        for _ in range(3):  # the accumulator's type may widen
            again = X.common([t, self(e.body, inner | {e.acc: V(F.lit(None).cast(t), t), e.var: V(F.lit(None).cast(src.t.elementType), src.t.elementType)}).t])
            if again is None:
                raise QueryError("reduce() changes its accumulator's kind")
            if again == t:
                break
            t = again
        step = lambda acc, x: X.cast(self(e.body, inner | {e.acc: V(acc, t), e.var: V(x, src.t.elementType)}), t)
        return V(F.aggregate(src.col, X.cast(init, t), step), t)

    def do_comprehension(self, e: A.Comprehension, inner) -> V:
        src = self.source(e.source, inner)
        item = lambda x: inner | {e.var: V(x, src.t.elementType)}
        out = src.col
        if e.where is not None:
            out = F.filter(out, lambda x: X.truth(self(e.where, item(x))))
        if e.body is None:
            return V(out, src.t)
        kind = self(e.body, item(F.lit(None).cast(src.t.elementType) if not isinstance(src.t.elementType, T.StructType) else F.lit(None))).t
        return V(F.transform(out, lambda x: self(e.body, item(x)).col), T.ArrayType(kind))

    def do_mapprojection(self, e: A.MapProjection, inner) -> V:
        items: dict[str, V] = {}
        whole = self(A.Var(e.of), inner)
        for key, expr in e.items:
            if key == "*" and expr is None:
                if not isinstance(whole.t, T.StructType):
                    raise QueryError(f"{e.of} has no properties")
                for f in whole.t.fields:
                    if not f.name.startswith("_"):
                        items[f.name] = V(whole.col.getField(f.name), f.dataType)
            else:
                items[key] = self(A.Prop(A.Var(e.of), key) if expr is None else expr, inner)
        out = X.make_map(list(items.items()))
        return V(F.when(whole.col.isNotNull(), out.col), out.t)
