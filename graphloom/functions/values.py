"""Typed columns and the value semantics: comparison, arithmetic, lists. All built from Spark's own functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import QueryError

MISSING = object()


class NodeType(T.StructType):
    """A struct with _id, _label and properties."""


class RelType(T.StructType):
    """A struct with _id, _type, _src, _dst and properties."""


class PathType(T.StructType):
    """A struct with node_ids and rel_ids."""


class DurationType(T.StructType):
    """A struct of months and nanos."""


PATH = PathType([T.StructField("node_ids", T.ArrayType(T.LongType())), T.StructField("rel_ids", T.ArrayType(T.LongType()))])
DURATION = DurationType([T.StructField("months", T.LongType()), T.StructField("nanos", T.LongType())])
INT, FLOAT, STR, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()


@dataclass(frozen=True)
class V:
    """A column with its type; lit is the value if it is known."""

    col: Column
    t: T.DataType
    lit: object = MISSING


def lit(value: object) -> V:
    """A Python value (also lists and dicts, as parameters) as a literal."""
    if value is None:
        return V(F.lit(None), NULL, None)
    if isinstance(value, bool):
        return V(F.lit(value), BOOL, value)
    if isinstance(value, int):
        return V(F.lit(value).cast("long"), INT, value)
    if isinstance(value, float):
        return V(F.lit(value), FLOAT, value)
    if isinstance(value, str):
        return V(F.lit(value), STR, value)
    if isinstance(value, list | tuple):
        out = make_list([lit(v) for v in value])
        return V(out.col, out.t, list(value))
    if isinstance(value, dict):
        out = make_map([(k, lit(v)) for k, v in value.items()])
        return V(out.col, out.t, value)
    import datetime
    import decimal

    if isinstance(value, datetime.datetime):
        return V(F.lit(value), T.TimestampType(), value)
    if isinstance(value, datetime.date):
        return V(F.lit(value), T.DateType(), value)
    if isinstance(value, decimal.Decimal):
        return V(F.lit(value), T.DecimalType(38, max(0, -value.as_tuple().exponent)), value)
    raise QueryError(f"a {type(value).__name__} can't be a value")


def kind(t: T.DataType) -> str:
    for name, types in (
        ("node", NodeType), ("rel", RelType), ("path", PathType), ("duration", DurationType), ("null", T.NullType), ("bool", T.BooleanType), ("str", T.StringType),
        ("num", (T.LongType, T.DoubleType, T.DecimalType, T.IntegerType, T.FloatType, T.ShortType, T.ByteType)), ("list", T.ArrayType), ("map", (T.StructType, T.MapType)),
        ("time", (T.DateType, T.TimestampType, T.TimestampNTZType)),
    ):
        if isinstance(t, types):
            return name
    return "any"


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.LongType | T.IntegerType | T.ShortType | T.ByteType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, T.DoubleType | T.FloatType)


def common(types: list[T.DataType]) -> T.DataType | None:
    """The one type that all values can take; None if there is none."""
    found = [t for t in types if not isinstance(t, T.NullType)]
    if not found:
        return NULL
    if all(t == found[0] and type(t) is type(found[0]) for t in found):
        return found[0]
    kinds = {kind(t) for t in found}
    if kinds == {"num"}:
        if any(is_float(t) for t in found):
            return FLOAT
        scales = [t.scale for t in found if isinstance(t, T.DecimalType)]
        return T.DecimalType(38, max(scales)) if scales else INT
    if kinds == {"list"}:
        inner = common([t.elementType for t in found])
        return None if inner is None else T.ArrayType(inner)
    if kinds == {"time"}:
        return T.TimestampType()
    return None


def cast(v: V, t: T.DataType) -> Column:
    if v.t == t or isinstance(t, T.NullType):
        return v.col
    if kind(t) in ("node", "rel", "path", "map") and not isinstance(v.t, T.NullType):
        return v.col
    return v.col.cast(T.StructType(t.fields) if isinstance(t, T.StructType) else t)


def make_list(items: list[V]) -> V:
    if not items:
        return V(F.array(), T.ArrayType(NULL))
    t = common([i.t for i in items])
    if t is None:  # mixed kinds
        return V(F.array(*(i.col.cast("variant") for i in items)), T.ArrayType(T.VariantType()))
    return V(F.array(*(cast(i, t) for i in items)), T.ArrayType(t))


def make_map(items: list[tuple[str, V]]) -> V:
    if not items:
        return V(F.create_map().cast("map<string,string>"), T.MapType(STR, STR))
    return V(F.struct(*(v.col.alias(k) for k, v in items)), T.StructType([T.StructField(k, v.t) for k, v in items]))


# -- comparison


def nothing(*vs: V) -> V:
    return V(F.lit(None).cast("boolean"), BOOL, None)


def equal(a: V, b: V) -> V:
    ka, kb = kind(a.t), kind(b.t)
    if "null" in (ka, kb):
        return nothing()
    if ka != kb:
        return V(F.when(a.col.isNotNull() & b.col.isNotNull(), False), BOOL)
    if ka in ("node", "rel"):
        return V(a.col.getField("_id") == b.col.getField("_id"), BOOL)
    if ka == "list":
        ea, eb = a.t.elementType, b.t.elementType
        if isinstance(ea, T.NullType) and isinstance(eb, T.NullType):
            return V(F.when(F.size(a.col) != F.size(b.col), False).when(F.size(a.col) == 0, True).otherwise(F.lit(None).cast("boolean")), BOOL)
        if isinstance(ea, T.NullType):
            return V(F.when(F.size(a.col) != F.size(b.col), False).when(F.size(a.col) == 0, True).otherwise(F.lit(None).cast("boolean")), BOOL)
        if isinstance(eb, T.NullType):
            return equal(b, a)
        pairs = F.zip_with(a.col, b.col, lambda x, y: equal(V(x, ea), V(y, eb)).col)
        # a definite mismatch beats an unknown, which forall's three values express
        return V(F.when(F.size(a.col) != F.size(b.col), False).otherwise(F.forall(pairs, lambda p: p)), BOOL)
    if ka == "map":
        return equal_maps(a, b)
    out = a.col == b.col
    if is_float(a.t) and is_float(b.t) and a.lit is MISSING and b.lit is MISSING:
        out = out & ~F.isnan(a.col)
    return V(out, BOOL)


def equal_maps(a: V, b: V) -> V:
    if isinstance(a.t, T.StructType) and isinstance(b.t, T.StructType):
        fa, fb = {f.name: f.dataType for f in a.t.fields}, {f.name: f.dataType for f in b.t.fields}
        if set(fa) != set(fb):
            return V(F.when(a.col.isNotNull() & b.col.isNotNull(), False), BOOL)
        out = F.lit(True)
        for name in fa:
            out = out & equal(V(a.col.getField(name), fa[name]), V(b.col.getField(name), fb[name])).col
        return V(F.when(a.col.isNotNull() & b.col.isNotNull(), out), BOOL)
    entries = lambda v: F.array_sort(F.map_entries(v.col))
    if isinstance(a.t, T.MapType) and isinstance(b.t, T.MapType):
        return V(entries(a) == entries(b), BOOL)
    raise QueryError("maps of different shapes can't be compared")


def ordered(op: str, a: V, b: V) -> V:
    ka, kb = kind(a.t), kind(b.t)
    if ka != kb or ka in ("null", "map", "node", "rel", "path", "duration", "any"):
        return nothing()
    x, y = a.col, b.col
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    # Spark puts NaN above all numbers; here no comparison with NaN is true
    for v, other in ((a, b), (b, a)):
        if is_float(v.t) and v.lit is MISSING and not (other.lit is not MISSING and ((op[0] == "<") == (v is a))):
            out = out & ~F.isnan(v.col)
    return V(out, BOOL)


def truth(v: V) -> Column:
    """A Boolean; what is no Boolean counts as unknown."""
    return v.col if isinstance(v.t, T.BooleanType) else F.lit(None).cast("boolean")


def contains_value(needle: V, hay: V) -> V:
    """needle IN hay."""
    if isinstance(hay.t, T.NullType):
        return nothing()
    if not isinstance(hay.t, T.ArrayType):
        raise QueryError("IN needs a list")
    e = hay.t.elementType
    if isinstance(needle.t, T.NullType):
        return nothing()
    if isinstance(e, T.NullType):
        return V(F.when(F.size(hay.col) == 0, F.when(needle.col.isNotNull(), False)).otherwise(F.lit(None).cast("boolean")), BOOL)
    if isinstance(hay.lit, list) and kind(e) == kind(needle.t) and kind(e) in ("num", "str", "bool"):
        return V(needle.col.isin(*hay.lit), BOOL)  # reaches the scan
    if kind(e) != kind(needle.t):
        return V(F.when(needle.col.isNotNull() & hay.col.isNotNull(), F.when(F.exists(hay.col, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(False)), BOOL)
    if kind(e) in ("num", "str", "bool", "time"):
        both = common([e, needle.t])
        return V(F.array_contains(cast(hay, T.ArrayType(both)), cast(needle, both)), BOOL)
    return V(F.when(needle.col.isNotNull(), F.exists(hay.col, lambda x: equal(V(x, e), needle).col)), BOOL)


# -- arithmetic


def add(a: V, b: V) -> V:
    ka, kb = kind(a.t), kind(b.t)
    if ka == "list" or kb == "list":
        if "null" in (ka, kb) and not (ka == "list" and kb == "list"):
            other = b if kb == "null" else a
            if other.lit is None:
                return V(F.lit(None).cast(a.t if ka == "list" else b.t), a.t if ka == "list" else b.t)
        if ka == "list" and kb == "list":
            t = common([a.t, b.t])
            if t is None:
                raise QueryError("lists of different kinds can't be joined")
            return V(F.concat(cast(a, t), cast(b, t)), t)
        lst, item = (a, b) if ka == "list" else (b, a)
        e = common([lst.t.elementType, item.t])
        if e is None:
            raise QueryError("an element of another kind can't be added to a list")
        one = F.when(item.col.isNotNull(), F.array(cast(item, e)))
        parts = [cast(lst, T.ArrayType(e)), one] if lst is a else [one, cast(lst, T.ArrayType(e))]
        return V(F.concat(*parts), T.ArrayType(e))
    if ka == "str" and kb == "str":
        return V(F.concat(a.col, b.col), STR)
    if "str" in (ka, kb) and {ka, kb} <= {"str", "num", "bool"}:
        from .scalar import to_string

        return V(F.concat(to_string(a).col, to_string(b).col), STR)
    if ka == "time" and kb == "duration":
        return shifted(a, b, 1)
    if ka == "duration" and kb == "time":
        return shifted(b, a, 1)
    return numeric("+", a, b)


def shifted(a: V, d: V, sign: int) -> V:
    months, micros = (d.col.getField("months") * sign).cast("int"), F.call_function("div", d.col.getField("nanos") * sign, F.lit(1000).cast("long"))
    at = a.col.cast("timestamp_ntz") if isinstance(a.t, T.DateType) else a.col
    moved = at + F.make_ym_interval(F.lit(0), months) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(24,6)") / 1_000_000).cast("decimal(18,6)"))
    return V(moved.cast("date"), a.t) if isinstance(a.t, T.DateType) else V(moved, a.t)


def numeric(op: str, a: V, b: V) -> V:
    ka, kb = kind(a.t), kind(b.t)
    if ka == "time" and kb == "duration" and op == "-":
        return shifted(a, b, -1)
    if "null" in (ka, kb) and {ka, kb} <= {"null", "num"}:
        t = a.t if ka == "num" else b.t if kb == "num" else INT
        return V(F.lit(None).cast(t), t, None)
    if ka != "num" or kb != "num":
        raise QueryError(f"{op} needs numbers, not {a.t.simpleString()} and {b.t.simpleString()}")
    t = common([a.t, b.t])
    if op == "^":
        return V(F.pow(a.col.cast("double"), b.col.cast("double")), FLOAT)
    if op == "/":
        if is_int(a.t) and is_int(b.t):
            return V(F.call_function("div", a.col, b.col), INT)
        if (is_float(a.t) or is_float(b.t)) and (is_int(a.t) or is_int(b.t) or is_float(a.t) and is_float(b.t)):
            x, y = a.col.cast("double"), b.col.cast("double")
            if b.lit not in (MISSING, 0, None):
                return V(x / y, FLOAT)
            by_zero = F.when((x == 0) | F.isnan(x), math.nan).when(x > 0, math.inf).otherwise(-math.inf)
            return V(F.when(y == 0, F.when(x.isNotNull(), by_zero)).otherwise(x / y), FLOAT)
        return V(a.col / b.col, t)
    x, y = cast(a, t), cast(b, t)
    return V({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], t)


def negative(a: V) -> V:
    if kind(a.t) == "null":
        return a
    if kind(a.t) != "num":
        raise QueryError("- needs a number")
    return V(-a.col, a.t)


# -- lists and maps


def index(of: V, at: V) -> V:
    k = kind(of.t)
    if k == "null":
        return of
    if k == "list":
        if kind(at.t) == "null":
            return V(F.lit(None).cast(of.t.elementType), of.t.elementType)
        if not is_int(at.t):
            raise QueryError("a list's index is an integer")
        i = at.col.cast("int")
        return V(F.get(of.col, F.when(i < 0, F.size(of.col) + i).otherwise(i)), of.t.elementType)
    if kind(at.t) != "str":
        raise QueryError("a map's key is a string")
    if isinstance(of.t, T.MapType):
        return V(F.try_element_at(of.col, at.col), of.t.valueType)
    if isinstance(at.lit, str):
        return prop(of, at.lit)
    raise QueryError("a key of a map with fixed fields must be known")


def prop(of: V, name: str) -> V:
    k = kind(of.t)
    if k == "null":
        return of
    if isinstance(of.t, T.StructType) and k in ("node", "rel", "map", "duration"):
        for f in of.t.fields:
            if f.name == name:
                return V(of.col.getField(name), f.dataType)
        return lit(None)
    if isinstance(of.t, T.MapType):
        return V(F.try_element_at(of.col, F.lit(name)), of.t.valueType)
    if k == "any":
        return V(F.try_variant_get(of.col, f"$.{name}", "string"), STR)
    raise QueryError(f"a {of.t.simpleString()} has no property {name}")


def sliced(of: V, lo: V | None, hi: V | None) -> V:
    if kind(of.t) == "null":
        return of
    if kind(of.t) != "list":
        raise QueryError("only lists can be sliced")
    n = F.size(of.col)
    place = lambda v: F.greatest(F.lit(0), F.least(n, F.when(v.col < 0, n + v.col.cast("int")).otherwise(v.col.cast("int"))))
    if any(v is not None and kind(v.t) == "null" for v in (lo, hi)):
        return V(F.lit(None).cast(of.t), of.t)
    a = F.lit(0) if lo is None else place(lo)
    b = n if hi is None else place(hi)
    known = F.lit(True)
    for v in (lo, hi):
        if v is not None:
            known = known & v.col.isNotNull()
    return V(F.when(known, F.slice(of.col, a + 1, F.greatest(F.lit(0), b - a))), of.t)
