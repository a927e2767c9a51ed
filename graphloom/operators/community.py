"""Communities: modularity, Leiden (static and incremental), memberships, seed ranking.

Edges are undirected tables u, v, weight. Leiden is sequential by nature: up to MAX_EDGES edges run inside one task for
each `graph` value, from the published algorithm (local moving, refinement, aggregation). A larger graph is first made
smaller by rounds of distributed merging, as joins, until it fits a task; no task ever holds more than MAX_EDGES edges.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, written

GAMMA, MAX_PASSES, MAX_ROUNDS, EPSILON, LEAST_GAIN = 1.0, 32, 20, 1e-4, 1e-12
#: Edges that one task takes at most.
MAX_EDGES = 1 << 20


def undirected(edges: DataFrame) -> DataFrame:
    """u < v, weight: each pair once, weights of parallel edges added, loops dropped."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), w.cast("double").alias("weight")).filter("u <> v").groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """One row, modularity: (1/2m) sum over communities of (inside weight - gamma * degree² / 2m). edges as from undirected()."""
    m = membership.select(F.col("node_id"), F.col("community_id"))
    side = lambda c: m.select(F.col("node_id").alias(c), F.col("community_id").alias(f"c_{c}"))
    inside = edges.join(side("u"), "u").join(side("v"), "v").filter("c_u = c_v").groupBy(F.col("c_u").alias("c")).agg((2 * F.sum("weight")).alias("inside"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("u"), "weight")
    degree = ends.join(side("u"), "u").groupBy(F.col("c_u").alias("c")).agg(F.sum("weight").alias("degree"))
    total = edges.agg((2 * F.sum("weight")).alias("m2"))
    parts = degree.join(inside, "c", "left").crossJoin(F.broadcast(total))
    q = F.coalesce("inside", F.lit(0.0)) / F.col("m2") - gamma * (F.col("degree") / F.col("m2")) * (F.col("degree") / F.col("m2"))
    return parts.agg(F.coalesce(F.sum(q), F.lit(0.0)).alias("modularity"))


class _Level:
    """A weighted graph in compressed rows: starts, neighbours, weights, loops and degrees."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, loops: np.ndarray, total: float | None = None) -> None:
        order = np.argsort(np.concatenate([u, v]), kind="stable")
        self.n, self.loops = n, loops
        self.to = np.concatenate([v, u])[order]
        self.w = np.concatenate([w, w])[order]
        counts = np.bincount(np.concatenate([u, v]), minlength=n)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.degree = np.bincount(np.concatenate([u, v]), np.concatenate([w, w]), n) + 2 * loops
        self.total = self.degree.sum() if total is None else total  # given where isolated vertices are left out

    def near(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[x], self.start[x + 1]
        return self.to[a:b], self.w[a:b]


def _gain_moves(g: _Level, community: np.ndarray, gamma: float, queue: list[int] | None = None) -> bool:
    """Local moving in ascending order of vertices until no move gains; ties go to the lower community."""
    weight = np.bincount(community, g.degree, g.n)
    moved = False
    pending = list(range(g.n)) if queue is None else sorted(queue)
    for _ in range(MAX_ROUNDS):
        wake: set[int] = set()
        gained = 0.0
        for x in pending:
            to, w = g.near(x)
            if not len(to):
                continue
            own = community[x]
            links: dict[int, float] = {own: 0.0}
            for c, y in zip(community[to].tolist(), w.tolist()):
                links[c] = links.get(c, 0.0) + y
            weight[own] -= g.degree[x]
            score = lambda c: links[c] - gamma * g.degree[x] * weight[c] / g.total  # noqa: E731,B023
            best, most = own, score(own)
            for c in sorted(links):
                if (s := score(c)) > most + 1e-12:
                    best, most = c, s
            gained += most - score(own)
            weight[best] += g.degree[x]
            if best != own:
                community[x] = best
                moved = True
                wake.update(to.tolist())
        if not wake or gained / g.total < EPSILON:
            break
        pending = sorted(wake)
    return moved


def _refine(g: _Level, community: np.ndarray, gamma: float) -> np.ndarray:
    """Splits communities into well-connected parts: singletons merge inside their community where that gains."""
    part = np.arange(g.n)
    part_weight, size = g.degree.copy(), np.ones(g.n, np.int64)
    whole = np.bincount(community, g.degree, g.n)
    for x in range(g.n):
        if size[part[x]] != 1:
            continue
        to, w = g.near(x)
        same = community[to] == community[x]
        inside = w[same].sum()
        rest = whole[community[x]] - g.degree[x]
        if inside < gamma * g.degree[x] * rest / g.total:
            continue
        links: dict[int, float] = {}
        for p, y in zip(part[to[same]].tolist(), w[same].tolist()):
            links[p] = links.get(p, 0.0) + y
        best, most = part[x], 0.0
        for p in sorted(links):
            if p != part[x] and (s := links[p] - gamma * g.degree[x] * part_weight[p] / g.total) > most + 1e-12:
                best, most = p, s
        if best != part[x]:
            old = part[x]
            part_weight[old] -= g.degree[x]
            size[old] -= 1
            part[x] = best
            part_weight[best] += g.degree[x]
            size[best] += 1
    return part


def leiden_levels(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, gamma: float = GAMMA, start: np.ndarray | None = None, queue: list[int] | None = None, loops: np.ndarray | None = None, total: float | None = None) -> list[np.ndarray]:
    """Community of every vertex at each level, the finest first. start and queue: go on from an older partition."""
    g = _Level(n, u, v, w, np.zeros(n) if loops is None else loops, total)
    flat = np.arange(n)
    community = np.arange(n) if start is None else np.unique(start, return_inverse=True)[1]
    levels = []
    for step in range(MAX_PASSES):
        moved = _gain_moves(g, community, gamma, queue if step == 0 else None)
        levels.append(np.unique(community[flat], return_inverse=True)[1])
        if not moved and step:
            break
        part = np.unique(_refine(g, community, gamma), return_inverse=True)[1]
        if len(part) == 0 or part.max() + 1 == g.n:
            break
        m = int(part.max()) + 1
        loops = np.bincount(part, g.loops, m)
        src = np.repeat(np.arange(g.n), np.diff(g.start))
        keep = src < g.to
        a, b, y = part[src[keep]], part[g.to[keep]], g.w[keep]
        loops += np.bincount(a[a == b], y[a == b], m)
        a, b, y = a[a != b], b[a != b], y[a != b]
        code, inverse = np.unique(np.minimum(a, b) * m + np.maximum(a, b), return_inverse=True)
        seen = np.zeros(m, np.int64)
        seen[part] = community
        g = _Level(m, code // m, code % m, np.bincount(inverse, y, len(code)), loops, total)
        flat = part[flat]
        community = np.unique(seen, return_inverse=True)[1]
    out = [levels[0]]
    for x in levels[1:]:
        if not np.array_equal(x, out[-1]):
            out.append(x)
    return out


MEMBERS = "node_id long, level int, community_id long"


def leiden(edges: DataFrame, graph: str | None = None, gamma: float = GAMMA) -> DataFrame:
    """node_id, level (0: finest), community_id: the least node of each community names it. Deterministic.

    graph is a column whose values are separate graphs (tenants), each one task; without it all edges are one.
    A graph of more than MAX_EDGES edges is merged in rounds first (see _merged), and its levels begin there.
    """
    g = graph or "_g"
    e = edges if graph else edges.withColumn("_g", F.lit(0))
    e = written(e.select(g, "u", "v", F.col("weight").cast("double").alias("weight")), "leiden-edges")
    large = [r[0] for r in e.groupBy(g).count().filter(F.col("count") > MAX_EDGES).select(g).collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([pdf.u, pdf.v]), return_inverse=True)
        u, v = at[: len(pdf)], at[len(pdf) :]
        rows = [(level, c) for level, c in enumerate(leiden_levels(u, v, pdf.weight.to_numpy(float), len(nodes), gamma))]
        return pd.concat([_named(nodes, c, level) for level, c in rows])

    out = None
    for value in large:
        found = _large(e.filter(F.col(g).eqNullSafe(value)).select("u", "v", "weight"), gamma, MAX_EDGES)
        out = found if out is None else out.unionByName(found)
    if out is not None and not graph:
        return out
    for value in large:
        e = e.filter(~F.col(g).eqNullSafe(value))
    small = e.groupBy(g).applyInPandas(run, MEMBERS)
    return small if out is None else out.unionByName(small)


def _merged(e: DataFrame, gamma: float, limit: int, rounds: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Merges communities until at most `limit` edges are left between them or no merge gains.

    Gives the edges between communities (u, v, weight), the communities (x, k: degree), members (node_id, c) and the
    total degree. In a round a hash with its number makes every community a head or a tail. Each tail proposes to the
    head of the greatest gain, ties to the lower id; a head takes its proposals in order of gain, as long as each gains
    with all before it counted as taken. Other stars share no community with it, so the modularity rises with every
    merge, and as merges follow edges, communities are connected. Only joins, aggregates and windows over single rows.
    """
    e = written(e.select("u", "v", F.col("weight").cast("double").alias("weight")), "merge-edges")
    nodes = written(e.select(F.explode(F.array("u", "v")).alias("x"), "weight").groupBy("x").agg(F.sum("weight").alias("k")), "merge-nodes")
    m2 = nodes.agg(F.sum("k")).first()[0] or 1.0
    members = nodes.select(F.col("x").alias("node_id"), F.col("x").alias("c"))
    r = 0
    while e.count() > limit:
        tail = lambda x: F.pmod(F.xxhash64(x, F.lit(r)), F.lit(2)) == 0  # noqa: E731,B023
        degree = lambda x, k: nodes.select(F.col("x").alias(x), F.col("k").alias(k))  # noqa: E731,B023
        if rounds is not None and r >= rounds:
            left = e.join(degree("u", "ku"), "u").join(degree("v", "kv"), "v").filter(F.col("weight") - gamma * F.col("ku") * F.col("kv") / m2 > LEAST_GAIN).count()
            if left:
                warnings.warn(f"communities: {left} pairs would still merge after round {rounds}, the last one", RuntimeWarning, stacklevel=2)
            break
        cut = e.filter(tail("u") != tail("v")).select(F.when(tail("u"), F.col("u")).otherwise(F.col("v")).alias("x"), F.when(tail("u"), F.col("v")).otherwise(F.col("u")).alias("head"), "weight")
        gain = F.col("weight") - gamma * F.col("k") * F.col("hk") / m2
        best = cut.join(degree("head", "hk"), "head").join(nodes, "x").groupBy("x", "k").agg(F.max(F.struct(gain.alias("gain"), (-F.col("head")).alias("neg"), "weight", "hk")).alias("b")).filter(F.col("b.gain") > LEAST_GAIN)
        best = best.select("x", "k", (-F.col("b.neg")).alias("head"), "b.gain", "b.weight", "b.hk")
        before = Window.partitionBy("head").orderBy(F.desc("gain"), "x").rowsBetween(Window.unboundedPreceding, -1)
        taken = best.withColumn("prior", F.coalesce(F.sum("k").over(before), F.lit(0.0))).filter(F.col("weight") - gamma * F.col("k") * (F.col("hk") + F.col("prior")) / m2 > LEAST_GAIN)
        merges = written(taken.select("x", "head"), "merge")
        r += 1
        if merges.isEmpty():
            if e.join(degree("u", "ku"), "u").join(degree("v", "kv"), "v").filter(F.col("weight") - gamma * F.col("ku") * F.col("kv") / m2 > LEAST_GAIN).isEmpty():
                break
            continue  # the pairs that gain were of one kind in this round
        to = lambda x, h: merges.select(F.col("x").alias(x), F.col("head").alias(h))  # noqa: E731,B023
        a, b = F.coalesce("hu", "u"), F.coalesce("hv", "v")
        new = e.join(to("u", "hu"), "u", "left").join(to("v", "hv"), "v", "left").filter(a != b).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.sum("weight").alias("weight"))
        old, e = e, written(new, "merge-edges")
        drop(old)
        nodes = written(nodes.join(merges, "x", "left").groupBy(F.coalesce("head", "x").alias("x")).agg(F.sum("k").alias("k")), "merge-nodes")
        members = written(members.join(to("c", "h"), "c", "left").select("node_id", F.coalesce("h", "c").alias("c")), "merge-members")
    return e, nodes, members, m2


def _large(edges: DataFrame, gamma: float, limit: int, rounds: int | None = None) -> DataFrame:
    """leiden() of one graph of any size: merging in rounds, then Leiden over what is left, if that fits one task."""
    e, nodes, members, m2 = _merged(edges, gamma, limit, rounds)
    if e.count() > limit:  # no merge gains any more
        found, levels = members.select("c", F.lit(0).alias("level"), F.col("c").alias("community")).distinct(), 1
    else:
        near = nodes.join(e.select(F.explode(F.array("u", "v")).alias("x")).distinct(), "x", "left_semi")

        def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("x")
            x, k, w = own.x.to_numpy(), own.k.to_numpy(float), pdf.weight.to_numpy(float)
            u, v = np.searchsorted(x, pdf.u), np.searchsorted(x, pdf.v)
            loops = (k - np.bincount(np.concatenate([u, v]), np.concatenate([w, w]), len(x))) / 2
            parts = [pd.DataFrame({"c": x, "level": np.int32(i), "community": x[np.unique(c, return_index=True)[1]][c]}) for i, c in enumerate(leiden_levels(u, v, w, len(x), gamma, loops=loops, total=m2))]
            return pd.concat(parts)

        one = F.lit(0).alias("one")
        found = written(e.select(one, "u", "v", "weight").groupBy("one").cogroup(near.select(one, "x", "k").groupBy("one")).applyInPandas(run, "c long, level int, community long"), "leiden-levels")
        levels = (found.agg(F.max("level")).first()[0] or 0) + 1
        alone = nodes.join(near.select("x"), "x", "left_anti").select(F.col("x").alias("c"), F.explode(F.array(*map(F.lit, range(levels)))).alias("level"), F.col("x").alias("community"))
        found = found.unionByName(alone)
    flat = members.join(found, "c").select("node_id", "level", "community")
    name = flat.groupBy("level", "community").agg(F.min("node_id").alias("community_id"))
    return flat.join(name, ["level", "community"]).select("node_id", "level", "community_id")


def _named(nodes: np.ndarray, community: np.ndarray, level: int) -> pd.DataFrame:
    first = np.full(community.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, community, nodes)
    return pd.DataFrame({"node_id": nodes, "level": np.int32(level), "community_id": first[community]})


def leiden_incremental(edges: DataFrame, membership: DataFrame, changed: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """The finest level after edge changes: edges is the new graph, changed (u, v) the updates. The ends of changed
    edges start anew, each alone; only they, and what their moves wake, are looked at again. A vertex without edges
    stays alone. No changes: the membership as it was. Over MAX_EDGES edges or nodes, see _swept: the same moves."""
    finest = membership.filter("level = 0").select("node_id", "community_id")
    if changed.isEmpty():
        return membership
    edges = written(edges.select("u", "v", F.col("weight").cast("double").alias("weight")), "leiden-edges")
    if edges.count() > MAX_EDGES or finest.count() > MAX_EDGES:
        return _swept(edges, finest, changed, gamma, MAX_EDGES)
    rows = edges.select(F.lit(0).alias("k"), "u", "v", F.col("weight").cast("double").alias("weight"))
    known = finest.select(F.lit(0).alias("k"), F.col("node_id"), F.col("community_id"))
    touched = changed.select(F.explode(F.array("u", "v")).alias("node_id")).distinct().withColumn("touched", F.lit(True))
    known = known.join(touched, "node_id", "outer").select(F.lit(0).alias("k"), "node_id", "community_id", F.coalesce("touched", F.lit(False)).alias("touched"))

    def run(e: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([e.u, e.v, old.node_id]))
        u, v = np.searchsorted(nodes, e.u), np.searchsorted(nodes, e.v)
        before = dict(zip(old.node_id[~old.touched], old.community_id[~old.touched]))
        # (0, c): in community c as before; (1, n): alone
        start = [(1, n) if pd.isna(c := before.get(n)) else (0, c) for n in nodes.tolist()]
        number = {c: i for i, c in enumerate(dict.fromkeys(start))}
        community = np.array([number[c] for c in start], np.int64)
        queue = np.flatnonzero(np.isin(nodes, old.node_id[old.touched].to_numpy())).tolist()
        g = _Level(len(nodes), u, v, e.weight.to_numpy(float), np.zeros(len(nodes)))
        _gain_moves(g, community, gamma, queue)
        return _named(nodes, np.unique(community, return_inverse=True)[1], 0)

    return rows.groupBy("k").cogroup(known.groupBy("k")).applyInPandas(run, MEMBERS)


def _swept(edges: DataFrame, finest: DataFrame, changed: DataFrame, gamma: float, limit: int) -> DataFrame:
    """leiden_incremental() of a graph of any size. A task gets only the links of the vertices that are looked at,
    added up by community, in blocks of about `limit` links in the order of ids; so moves and ties are those of one task.
    """
    e = edges.select("u", "v", F.col("weight").cast("double").alias("weight"))
    e = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")), "sweep-edges")
    degree = e.groupBy(F.col("u").alias("node_id")).agg(F.sum("weight").alias("k"))
    touched = written(changed.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), "sweep-touched")
    start = degree.join(finest, "node_id", "outer").join(touched.withColumn("new", F.lit(True)), "node_id", "outer").fillna(0.0, ["k"])
    alone = F.col("new").isNotNull() | F.col("community_id").isNull()
    start = start.select("node_id", "k", F.when(alone, F.struct(F.lit(1).alias("a"), F.col("node_id").alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.col("community_id").alias("b"))).alias("key"))
    least = start.groupBy("key").agg(F.min("node_id").alias("c"))
    state = written(start.join(least, "key").select("node_id", "k", "c"), "sweep")
    m2 = state.agg(F.sum("k")).first()[0] or 1.0
    pending = touched.select(F.col("node_id").alias("u"))

    def run(links: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        weight = dict(zip(links.to.tolist(), links.tw.tolist())) | dict(zip(own.c.tolist(), own.tw.tolist()))
        label = dict(zip(own.u.tolist(), own.c.tolist()))
        near: dict[int, list] = {}
        for x, to, pend, w in zip(links.u.tolist(), links.to.tolist(), links.v.tolist(), links.w.tolist()):
            near.setdefault(x, []).append((to, pend, w))
        out = []
        for x, k in sorted(zip(own.u.tolist(), own.k.tolist())):
            if x not in near:
                continue
            at = label[x]
            score_of: dict[int, float] = {at: 0.0}
            for to, pend, w in near[x]:
                c = label[int(pend)] if pend == pend else to
                score_of[c] = score_of.get(c, 0.0) + w
            weight[at] -= k
            score = {c: w - gamma * k * weight[c] / m2 for c, w in score_of.items()}
            best = at
            for c in sorted(score):
                if score[c] > score[best] + LEAST_GAIN:
                    best = c
            weight[best] += k
            label[x] = best
            if best != at:
                out.append((x, best, score[best] - score[at]))
        return pd.DataFrame(out, columns=["node_id", "new", "gain"]).astype({"node_id": "int64", "new": "int64", "gain": "float64"})

    for _ in range(MAX_ROUNDS):
        # each block's vertices and links by the state that the block before has left
        count = e.join(pending, "u", "left_semi").count()
        blocks = max(1, -(-count // limit))
        bounds = [None, *(pending.approxQuantile("u", [i / blocks for i in range(1, blocks)], 0.001) if blocks > 1 else []), None]
        gained, wake = 0.0, None
        for lo, hi in zip(bounds, bounds[1:]):
            block = pending
            if lo is not None:
                block = block.filter(F.col("u").cast("double") > lo)
            if hi is not None:
                block = block.filter(F.col("u").cast("double") <= hi)
            inside = block.select(F.col("u").alias("v"), F.lit(True).alias("inside"))
            to = state.select(F.col("node_id").alias("v"), F.col("c").alias("to"))
            links = e.join(block, "u", "left_semi").join(to, "v").join(inside, "v", "left").groupBy("u", "to", F.when(F.col("inside"), F.col("v")).alias("v")).agg(F.sum("weight").alias("w"))
            totals = state.groupBy("c").agg(F.sum("k").alias("tw"))
            links = written(links.join(totals.withColumnRenamed("c", "to"), "to").select(F.lit(0).alias("one"), "u", "to", "v", "w", "tw"), "sweep-links")
            own = written(state.withColumnRenamed("node_id", "u").join(block, "u", "left_semi").join(totals, "c").select(F.lit(0).alias("one"), "u", "k", "c", "tw"), "sweep-own")
            moved = written(links.groupBy("one").cogroup(own.groupBy("one")).applyInPandas(run, "node_id long, new long, gain double"), "sweep-moved")
            gained += moved.agg(F.sum("gain")).first()[0] or 0.0
            state = written(state.join(moved.select("node_id", "new"), "node_id", "left").select("node_id", "k", F.coalesce("new", "c").alias("c")), "sweep")
            near = e.join(moved.select(F.col("node_id").alias("u")), "u", "left_semi").select(F.col("v").alias("u"))
            wake = near if wake is None else wake.unionByName(near)
        if gained / m2 < EPSILON:
            break
        pending = written(wake.distinct(), "sweep-pending")
        if pending.isEmpty():
            break
    name = state.groupBy("c").agg(F.min("node_id").alias("community_id"))
    return state.join(name, "c").select("node_id", F.lit(0).alias("level"), "community_id")


def communities(edges: DataFrame, gamma: float = GAMMA, rounds: int | None = None, limit: int = MAX_EDGES) -> DataFrame:
    """node_id, level, community_id for graphs of any size: one level, the coarsest that leiden() would give.

    Rounds of distributed merging (see _merged) until at most `limit` edges are left, which one task finishes, or until
    no merge gains. rounds: stop after so many; a RuntimeWarning then says how many pairs would still merge.
    """
    found = _large(edges, gamma, limit, rounds)
    top = found.agg(F.max("level")).first()[0] or 0
    return found.filter(F.col("level") == top).select("node_id", F.lit(0).alias("level"), "community_id")


def members(membership: DataFrame, community: int, level: int = 0) -> DataFrame:
    return membership.filter((F.col("level") == level) & (F.col("community_id") == community)).select("node_id").orderBy("node_id")


def lookup(membership: DataFrame, nodes: DataFrame, level: int = 0) -> DataFrame:
    """node_id, community_id of a table of node ids."""
    return nodes.select("node_id").join(membership.filter(F.col("level") == level), "node_id").select("node_id", "community_id")


def rank_by_seeds(membership: DataFrame, seeds: list[int], level: int = 0) -> DataFrame:
    """community_id, score: seeds in the community divided by its size, best first."""
    if not seeds:
        raise ValueError("no seeds")
    m = membership.filter(F.col("level") == level).groupBy("community_id").agg(F.count("*").alias("size"), F.sum(F.col("node_id").isin(*seeds).cast("long")).alias("hits"))
    return m.filter("hits > 0").select("community_id", (F.col("hits") / F.col("size")).alias("score")).orderBy(F.desc("score"), "community_id")


def refresh(edges: DataFrame, snapshot: int, graph: str | None = None) -> DataFrame:
    """A membership snapshot: leiden() with the version of the graph it was made from."""
    return leiden(edges, graph).withColumn("snapshot", F.lit(snapshot).cast("long"))


def latest(snapshots: DataFrame, at: int) -> DataFrame:
    """Of snapshots, the newest that is not after `at`."""
    w = Window.partitionBy()
    return snapshots.filter(F.col("snapshot") <= at).withColumn("_m", F.max("snapshot").over(w)).filter("snapshot = _m").drop("_m")
