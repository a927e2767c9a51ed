"""The scalar functions of the query language, by lower-case name: typed columns in, a typed column out."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import QueryError
from .values import BOOL, FLOAT, INT, STR, NodeType, PathType, RelType, V, cast, common, is_float, is_int, kind, lit

MAX_RANGE = 1_000_000
SPACE = r"[\s\x85\p{Z}]+"


def _need(name: str, v: V, *kinds: str) -> bool:
    """False if the value is NULL by type; an error if it has another kind."""
    if kind(v.t) == "null":
        return False
    if kind(v.t) not in kinds:
        raise QueryError(f"{name}() can't take a {v.t.simpleString()}")
    return True


def _null(t: T.DataType) -> V:
    return V(F.lit(None).cast(t), t, None)


def _text(name: str, f: Callable) -> Callable:
    def run(v: V) -> V:
        return V(f(v.col), STR) if _need(name, v, "str") else _null(STR)

    return run


def _number(name: str, f: Callable) -> Callable:
    def run(v: V) -> V:
        return V(f(v.col.cast("double")), FLOAT) if _need(name, v, "num") else _null(FLOAT)

    return run


def _log(f: Callable) -> Callable:
    return lambda x: F.when(x == 0, -math.inf).when(x < 0, math.nan).when(F.isnan(x), math.nan).otherwise(f(x))


def fn_id(v: V) -> V:
    return V(v.col.getField("_id"), INT) if _need("id", v, "node", "rel") else _null(INT)


def fn_labels(v: V) -> V:
    if not _need("labels", v, "node"):
        return _null(T.ArrayType(STR))
    label = v.col.getField("_label")
    return V(F.when(v.col.isNotNull(), F.when(label.isNull(), F.array().cast("array<string>")).otherwise(F.array(label))), T.ArrayType(STR))


def fn_type(v: V) -> V:
    return V(v.col.getField("_type"), STR) if _need("type", v, "rel") else _null(STR)


def _bag(v: V) -> list[T.StructField]:
    return [f for f in v.t.fields if not (isinstance(v.t, NodeType | RelType) and f.name.startswith("_"))]


def fn_keys(v: V) -> V:
    if not _need("keys", v, "node", "rel", "map"):
        return _null(T.ArrayType(STR))
    if isinstance(v.t, T.MapType):
        return V(F.array_sort(F.map_keys(v.col)), T.ArrayType(STR))
    bag = isinstance(v.t, NodeType | RelType)  # a bag has no NULLs; a literal map keeps its keys
    names = [F.when(v.col.getField(f.name).isNotNull(), F.lit(f.name)) if bag else F.lit(f.name) for f in sorted(_bag(v), key=lambda f: f.name)]
    return V(F.when(v.col.isNotNull(), F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")), T.ArrayType(STR))


def fn_properties(v: V) -> V:
    if not _need("properties", v, "node", "rel", "map"):
        return v
    if kind(v.t) == "map":
        return v
    fields = sorted(_bag(v), key=lambda f: f.name)
    if not fields:
        return V(F.create_map().cast("map<string,string>"), T.MapType(STR, STR))
    return V(F.when(v.col.isNotNull(), F.struct(*(v.col.getField(f.name).alias(f.name) for f in fields))), T.StructType(fields))


def fn_exists(v: V) -> V:
    return V(v.col.isNotNull(), BOOL)


def fn_length(v: V) -> V:
    if kind(v.t) in ("str", "list"):
        return fn_size(v)
    return V(F.size(v.col.getField("rel_ids")).cast("long"), INT) if _need("length", v, "path") else _null(INT)


def fn_size(v: V) -> V:
    if not _need("size", v, "str", "list"):
        return _null(INT)
    return V((F.char_length(v.col) if kind(v.t) == "str" else F.size(v.col)).cast("long"), INT)


def fn_head(v: V) -> V:
    return V(F.get(v.col, F.lit(0)), v.t.elementType) if _need("head", v, "list") else v


def fn_last(v: V) -> V:
    return V(F.try_element_at(v.col, F.lit(-1)), v.t.elementType) if _need("last", v, "list") else v


def fn_tail(v: V) -> V:
    return V(F.slice(v.col, F.lit(2), F.greatest(F.size(v.col) - 1, F.lit(0))), v.t) if _need("tail", v, "list") else v


def fn_nodes(v: V) -> V:
    return V(v.col.getField("node_ids"), T.ArrayType(INT)) if _need("nodes", v, "path") else _null(T.ArrayType(INT))


def fn_relationships(v: V) -> V:
    return V(v.col.getField("rel_ids"), T.ArrayType(INT)) if _need("relationships", v, "path") else _null(T.ArrayType(INT))


def _guarded(bad, message: str, good):
    """good, or an error at run time where bad holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("string")).otherwise(good)


def fn_substring(s: V, start: V, n: V | None = None) -> V:
    if not (_need("substring", s, "str") and _need("substring", start, "num") and (n is None or _need("substring", n, "num"))):
        return _null(STR)
    bad = start.col < 0 if n is None else (start.col < 0) | (n.col < 0)
    size = F.char_length(s.col) if n is None else n.col.cast("int")
    # a place past the end gives the empty string
    return V(_guarded(bad, "substring() of a negative place or length", F.substring(s.col, (F.least(start.col, F.lit(1 << 30)) + 1).cast("int"), F.greatest(size, F.lit(0)))), STR)


def fn_replace(s: V, a: V, b: V) -> V:
    if not all([_need("replace", x, "str") for x in (s, a, b)]):
        return _null(STR)
    return V(F.when(a.col == "", s.col).otherwise(F.replace(s.col, a.col, b.col)), STR)


def fn_split(s: V, by: V) -> V:
    if not all([_need("split", x, "str") for x in (s, by)]):
        return _null(T.ArrayType(STR))
    literal = F.concat(F.lit(r"\Q"), F.replace(by.col, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return V(F.when(by.col == "", F.array(s.col)).otherwise(F.split(s.col, literal, -1)), T.ArrayType(STR))


def _side(name: str, f: Callable) -> Callable:
    def run(s: V, n: V) -> V:
        if not (_need(name, s, "str") and _need(name, n, "num")):
            return _null(STR)
        k = F.least(n.col, F.char_length(s.col).cast("long")).cast("int")
        return V(_guarded(n.col < 0, f"{name}() of a negative length", f(s.col, k)), STR)

    return run


def fn_reverse(v: V) -> V:
    return V(F.reverse(v.col), v.t) if _need("reverse", v, "str", "list") else v


def fn_abs(v: V) -> V:
    return V(F.abs(v.col), v.t) if _need("abs", v, "num") else v


def fn_sign(v: V) -> V:
    return V(F.signum(v.col.cast("double")).cast("long"), INT) if _need("sign", v, "num") else _null(INT)


def fn_to_integer(v: V) -> V:
    if not _need("toInteger", v, "num", "str"):
        return _null(INT)
    if is_int(v.t):
        return v
    whole = lambda x: F.when((x >= -(2.0**63)) & (x < 2.0**63), F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).try_cast("long"))
    if kind(v.t) == "num":
        return V(whole(v.col.cast("double")), INT)
    t = F.trim(v.col)
    return V(F.coalesce(t.try_cast("long"), whole(F.when(t.rlike(r"^[-+0-9.eE]+$"), t.try_cast("double")))), INT)


def fn_to_float(v: V) -> V:
    if not _need("toFloat", v, "num", "str"):
        return _null(FLOAT)
    return V(v.col.cast("double") if kind(v.t) == "num" else F.trim(v.col).try_cast("double"), FLOAT)


def fn_to_boolean(v: V) -> V:
    if not _need("toBoolean", v, "bool", "str"):
        return _null(BOOL)
    if kind(v.t) == "bool":
        return v
    t = F.lower(F.trim(v.col))
    return V(F.when(t == "true", True).when(t == "false", False), BOOL)


def plain_decimal(x):
    """A float without exponent: whole numbers below 1e15 with ".0", the shortest digits otherwise."""
    text, whole = x.cast("string"), (x == F.round(x, 0))
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0$|\.", "")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(x < 0, "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))
    huge = F.concat(sign, F.rpad(digits, exponent + 1, F.lit("0")))
    return (
        F.when(F.isnan(x), "NaN").when(F.abs(x) == math.inf, F.when(x > 0, "Infinity").otherwise("-Infinity"))
        .when(whole & (F.abs(x) < 1e15), F.when(F.abs(x) < 1e7, text).otherwise(F.concat(x.try_cast("bigint").cast("string"), F.lit(".0"))))
        .when(exponent.isNull(), text).when(exponent < 0, small).when(whole, huge).otherwise(large)
    )


def to_string(v: V) -> V:
    if not _need("toString", v, "num", "str", "bool", "time"):
        return _null(STR)
    if is_float(v.t):
        return V(plain_decimal(v.col), STR)
    return V(v.col.cast("string"), STR)


def fn_coalesce(*vs: V) -> V:
    t = common([v.t for v in vs])
    if t is None:
        raise QueryError("coalesce() of values of different kinds")
    return V(F.coalesce(*(cast(v, t) for v in vs)), t)


def fn_range(a: V, b: V, step: V | None = None) -> V:
    step = step or lit(1)
    for v in (a, b, step):
        if not _need("range", v, "num"):
            return _null(T.ArrayType(INT))
    if step.lit == 0:
        raise QueryError("range() with step 0")
    n = F.when(step.col == 0, F.raise_error(F.lit("range() with step 0")).cast("long")).otherwise(F.call_function("div", b.col - a.col, step.col))
    wrong = (step.col > 0) & (a.col > b.col) | (step.col < 0) & (a.col < b.col)
    out = F.when(wrong, F.array().cast("array<bigint>")).when(n >= MAX_RANGE, F.raise_error(F.lit("range() of over 1000000 elements")).cast("array<bigint>")).otherwise(F.sequence(a.col, b.col, step.col))
    return V(out, T.ArrayType(INT))


def fn_start(v: V) -> V:
    return V(v.col.getField("_src"), INT) if _need("startNode", v, "rel") else _null(INT)


def fn_end(v: V) -> V:
    return V(v.col.getField("_dst"), INT) if _need("endNode", v, "rel") else _null(INT)


FUNCTIONS: dict[str, tuple[Callable, int, int]] = {
    "id": (fn_id, 1, 1), "labels": (fn_labels, 1, 1), "type": (fn_type, 1, 1), "keys": (fn_keys, 1, 1), "properties": (fn_properties, 1, 1), "exists": (fn_exists, 1, 1),
    "length": (fn_length, 1, 1), "size": (fn_size, 1, 1), "head": (fn_head, 1, 1), "last": (fn_last, 1, 1), "tail": (fn_tail, 1, 1),
    "nodes": (fn_nodes, 1, 1), "relationships": (fn_relationships, 1, 1), "startnode": (fn_start, 1, 1), "endnode": (fn_end, 1, 1),
    "toupper": (_text("toUpper", F.upper), 1, 1), "tolower": (_text("toLower", F.lower), 1, 1),
    "trim": (_text("trim", lambda x: F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")), 1, 1),
    "ltrim": (_text("lTrim", lambda x: F.regexp_replace(x, f"^{SPACE}", "")), 1, 1), "rtrim": (_text("rTrim", lambda x: F.regexp_replace(x, f"{SPACE}$", "")), 1, 1),
    "substring": (fn_substring, 2, 3), "replace": (fn_replace, 3, 3), "split": (fn_split, 2, 2), "left": (_side("left", F.left), 2, 2), "right": (_side("right", F.right), 2, 2),
    "reverse": (fn_reverse, 1, 1), "abs": (fn_abs, 1, 1), "sign": (fn_sign, 1, 1),
    "ceil": (_number("ceil", lambda x: F.ceil(x).cast("double")), 1, 1), "floor": (_number("floor", lambda x: F.floor(x).cast("double")), 1, 1), "round": (_number("round", lambda x: F.round(x, 0)), 1, 1),
    "sqrt": (_number("sqrt", F.sqrt), 1, 1), "exp": (_number("exp", F.exp), 1, 1), "log": (_number("log", _log(F.ln)), 1, 1), "log10": (_number("log10", _log(F.log10)), 1, 1),
    "sin": (_number("sin", F.sin), 1, 1), "cos": (_number("cos", F.cos), 1, 1), "tan": (_number("tan", F.tan), 1, 1),
    "e": (lambda: V(F.e(), FLOAT), 0, 0), "pi": (lambda: V(F.pi(), FLOAT), 0, 0), "rand": (lambda: V(F.rand(), FLOAT), 0, 0),
    "tointeger": (fn_to_integer, 1, 1), "tofloat": (fn_to_float, 1, 1), "toboolean": (fn_to_boolean, 1, 1), "tostring": (to_string, 1, 1),
    "coalesce": (fn_coalesce, 1, 255), "range": (fn_range, 2, 3),
}


def call(name: str, args: list[V]) -> V:
    if name not in FUNCTIONS:
        raise QueryError(f"unknown function {name}()")
    f, least, most = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise QueryError(f"{name}() takes {least}{f' to {most}' if most != least else ''} arguments")
    return f(*args)
