"""The syntax tree of the graph query language. Nodes are frozen, so equal expressions compare equal."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    __slots__ = ()


@dataclass(frozen=True)
class Lit(Expr):
    value: object  # None, bool, int, float or str


@dataclass(frozen=True)
class Typed(Expr):
    kind: str  # datetime, localdatetime, date, duration, decimal
    text: str


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    name: str


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    lo: Expr | None
    hi: Expr | None


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # not, -, +
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # or xor and = <> < <= > >= + - * / % ^ in starts ends contains near match
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class InCommunity(Expr):
    arg: Expr
    community: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str  # lower case
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple  # of (condition, result)
    default: Expr | None


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple


@dataclass(frozen=True)
class MapLit(Expr):
    items: tuple  # of (name, expression)


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str  # all any none single
    var: str
    source: Expr
    where: Expr | None


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    init: Expr
    var: str
    source: Expr
    body: Expr


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    body: Expr | None


@dataclass(frozen=True)
class MapProjection(Expr):
    of: str
    items: tuple  # of ("*", None), (name, None) for .name, (name, expression)


@dataclass(frozen=True)
class NodePat:
    var: str
    labels: tuple
    props: tuple
    named: bool  # False if the name is made up


@dataclass(frozen=True)
class RelPat:
    var: str
    types: tuple
    props: tuple
    direction: str  # out, in, both
    lo: int | None = None  # None: a single hop
    hi: int | None = None  # None with lo set: unbounded
    named: bool = True

    @property
    def variable(self) -> bool:
        return self.lo is not None


@dataclass(frozen=True)
class PathPat:
    nodes: tuple
    rels: tuple
    var: str | None = None
    kind: str = "plain"  # plain, shortest, all


class Clause:
    __slots__ = ()


@dataclass(frozen=True)
class Match(Clause):
    patterns: tuple
    where: Expr | None
    optional: bool = False


@dataclass(frozen=True)
class Item:
    expr: Expr
    name: str


@dataclass(frozen=True)
class Projection(Clause):
    items: tuple
    star: bool
    distinct: bool
    final: bool  # RETURN
    where: Expr | None = None
    order: tuple = ()  # of (expression, descending)
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass(frozen=True)
class Unwind(Clause):
    source: Expr
    var: str


@dataclass(frozen=True)
class SubQuery(Clause):
    body: "Query"


@dataclass(frozen=True)
class Procedure(Clause):
    name: str
    args: tuple
    yields: tuple  # of (column, alias)
    where: Expr | None
    show: bool = False


@dataclass(frozen=True)
class RankLeg:
    kind: str  # vector, text
    var: str
    prop: str
    query: Expr
    k: int | None


@dataclass(frozen=True)
class RankBy(Clause):
    legs: tuple
    alias: str | None
    rrf_k: int = 60


@dataclass(frozen=True)
class Create(Clause):
    items: tuple  # of PathPat


@dataclass(frozen=True)
class SetItem:
    kind: str  # prop, merge, replace, label
    var: str
    name: str | None = None
    value: object = None


@dataclass(frozen=True)
class SetClause(Clause):
    items: tuple


@dataclass(frozen=True)
class Remove(Clause):
    items: tuple  # SetItem of kind prop or label


@dataclass(frozen=True)
class Delete(Clause):
    names: tuple
    detach: bool


@dataclass(frozen=True)
class Merge(Clause):
    pattern: PathPat
    on_create: tuple
    on_match: tuple


@dataclass(frozen=True)
class CreateIndex(Clause):
    name: str | None
    label: str
    prop: str
    vector: bool
    if_not_exists: bool
    options: tuple = ()


@dataclass(frozen=True)
class DropIndex(Clause):
    name: str


@dataclass(frozen=True)
class Query:
    """Bodies joined by UNION; one body is the usual case."""

    bodies: tuple
    alls: tuple = ()  # for each UNION: ALL?
    order: tuple = ()
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass(frozen=True)
class Statement:
    query: Query
    mode: str = "run"  # run, explain, profile
    text: str = field(default="", compare=False)


def children(e: object):
    """The direct subexpressions."""
    if isinstance(e, Prop):
        yield e.of
    elif isinstance(e, Index):
        yield from (e.of, e.at)
    elif isinstance(e, Slice):
        yield from (x for x in (e.of, e.lo, e.hi) if x is not None)
    elif isinstance(e, Unary | IsNull):
        yield e.arg
    elif isinstance(e, InCommunity):
        yield from (e.arg, e.community)
    elif isinstance(e, Binary):
        yield from (e.left, e.right)
    elif isinstance(e, Call):
        yield from e.args
    elif isinstance(e, Case):
        yield from (x for x in (e.subject, e.default) if x is not None)
        for a, b in e.whens:
            yield from (a, b)
    elif isinstance(e, ListLit):
        yield from e.items
    elif isinstance(e, MapLit):
        yield from (v for _, v in e.items)
    elif isinstance(e, Quantifier):
        yield from (x for x in (e.source, e.where) if x is not None)
    elif isinstance(e, Reduce):
        yield from (e.init, e.source, e.body)
    elif isinstance(e, Comprehension):
        yield from (x for x in (e.source, e.where, e.body) if x is not None)
    elif isinstance(e, MapProjection):
        yield Var(e.of)
        yield from (v for _, v in e.items if v is not None)
