"""Sinks: result rows as JSON, YAML or TOON text, Parquet, Arrow, and a cursor of batches."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

#: Rows of a result that is rendered as text.
MAX_ROWS, BATCH_ROWS = 10_000, 2048


def plain(value: object) -> object:
    """A row's value as JSON's kinds."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, bytes | bytearray):
        return value.hex()
    return value


def rows(df: DataFrame, limit: int = 1000) -> tuple[list[dict], bool]:
    """At most `limit` rows and whether there are more."""
    limit = min(limit, MAX_ROWS)
    found = df.limit(limit + 1).collect()
    return [plain(r) for r in found[:limit]], len(found) > limit


def to_json(df: DataFrame, limit: int = 1000) -> str:
    found, more = rows(df, limit)
    return json.dumps({"rows": found, "truncated": more}, ensure_ascii=False)


def to_yaml(df: DataFrame, limit: int = 1000) -> str:
    found, more = rows(df, limit)
    return _yaml({"rows": found, "truncated": more}, 0)


def _yaml_scalar(v: object) -> str:
    if v is None or isinstance(v, bool | int | float):
        return json.dumps(v)
    s = str(v)
    bare = re.fullmatch(r"[A-Za-z_][\w ./-]*", s) and s == s.strip() and s.lower() not in ("true", "false", "null", "yes", "no", "on", "off", "y", "n")
    return s if bare else json.dumps(s, ensure_ascii=False)


def _yaml(v: object, depth: int) -> str:
    pad = "  " * depth
    if isinstance(v, dict) and v:
        return "".join(f"{pad}{_yaml_scalar(k)}:" + (f"\n{_yaml(x, depth + 1)}" if isinstance(x, dict | list) and x else f" {_yaml_scalar(x) if not isinstance(x, dict | list) else '{}' if isinstance(x, dict) else '[]'}\n") for k, x in v.items())
    if isinstance(v, list) and v:
        out = ""
        for x in v:
            if isinstance(x, dict | list) and x:
                body = _yaml(x, depth + 1)
                out += f"{pad}- " + body[len(pad) + 2 :]
            else:
                out += f"{pad}- {_yaml_scalar(x) if not isinstance(x, dict | list) else '{}' if isinstance(x, dict) else '[]'}\n"
        return out
    return pad + (_yaml_scalar(v) if not isinstance(v, dict | list) else "{}" if isinstance(v, dict) else "[]") + "\n"


def to_toon(df: DataFrame, limit: int = 1000) -> str:
    """Token-oriented notation: a header with the columns once, then a line of cells for each row. A line says so where rows were cut off."""
    found, cut = rows(df, limit)
    return toon({"rows": found} | ({"truncated": True} if cut else {}))


def _toon_number(x: float) -> str:
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    return format(decimal.Decimal(repr(x)), "f")


def _toon_scalar(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        return _toon_number(v)
    s = str(v)
    quote = not s or s != s.strip() or s in ("true", "false", "null") or s.startswith("-") or re.fullmatch(r"-?\d+(\.\d+)?([eE][-+]?\d+)?", s) or re.search(r'[\\":,\[\]{}\n\r\t]', s)
    if not quote:
        return s
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _is_scalar(v: object) -> bool:
    return not isinstance(v, dict | list)


def toon(v: object, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(v, dict):
        return "\n".join(pad + _toon_field(k, x, depth) for k, x in v.items())
    if isinstance(v, list):
        return pad + _toon_field("", v, depth)
    return pad + _toon_scalar(v)


def _toon_field(key: str, v: object, depth: int) -> str:
    pad = "  " * (depth + 1)
    if isinstance(v, dict):
        return f"{key}:" + (f"\n{toon(v, depth + 1)}" if v else "")
    if not isinstance(v, list):
        return f"{key}: {_toon_scalar(v)}"
    if all(map(_is_scalar, v)):
        return f"{key}[{len(v)}]:" + (" " + ",".join(map(_toon_scalar, v)) if v else "")
    first = v[0]
    if isinstance(first, dict) and first and all(isinstance(x, dict) and list(x) == list(first) and all(map(_is_scalar, x.values())) for x in v):
        return f"{key}[{len(v)}]{{{','.join(first)}}}:\n" + "\n".join(pad + ",".join(map(_toon_scalar, x.values())) for x in v)
    items = []
    for x in v:
        if isinstance(x, dict) and x:
            body = toon(x, depth + 2)
            items.append(f"{pad}- {body[len(pad) + 2 :]}")
        elif isinstance(x, list):
            items.append(f"{pad}- {_toon_field('', x, depth + 1)}")
        else:
            items.append(f"{pad}- {_toon_scalar(x)}" if not isinstance(x, dict) else f"{pad}-")
    return f"{key}[{len(v)}]:\n" + "\n".join(items)


def cursor(df: DataFrame, batch: int = BATCH_ROWS) -> Iterator[list[Row]]:
    """Batches of rows, one partition at a time on the driver; closing the generator ends the job."""
    part: list[Row] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        part.append(r)
        if len(part) == batch:
            yield part
            part = []
    if part:
        yield part


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("error").parquet(path)


def dump(graph, folder: str) -> None:
    """The whole graph as Parquet: nodes/<label> and rels/<type>-<source>-<target>."""
    for label, df in graph.nodes.items():
        df.write.mode("error").parquet(f"{folder}/nodes/{label or '_'}")
    for s in graph.segments:
        s.df.write.mode("error").parquet(f"{folder}/rels/{s.type}-{s.src or '_'}-{s.dst or '_'}")
