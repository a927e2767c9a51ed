"""Distributed union-find, and links from bucket keys without all pairs of a bucket. DataFrame functions only, but for what the
caller verifies with.

Nothing about documents reaches the driver. Rounds are cut with written tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, save


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (v, root): the smallest vertex reachable, for every vertex that is not its own root.

    Each round hooks a vertex to its smallest smaller neighbour, follows the hooks to their ends by pointer
    jumping, and contracts the edges. A star, however large, is done in one round.
    """
    edge = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc-edges")
    total: DataFrame | None = None
    while not edge.df.isEmpty():
        hook = save(edge.df.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("root")), "cc-hooks")
        while True:
            onward = hook.df.select(F.col("v").alias("root"), F.col("root").alias("next"))
            longer = save(hook.df.join(onward, "root", "left").select("v", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "cc-hooks")
            hook.drop()
            hook = longer
            if hook.df.filter("moved").isEmpty():
                break
        to = lambda c: hook.df.select(F.col("v").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731,B023
        contracted = edge.df.join(to("a"), "a", "left").join(to("b"), "b").select(F.coalesce("a_root", "a").alias("x"), F.col("b_root").alias("y"))
        rest = save(contracted.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        edge.drop()
        edge = rest
        own = hook.df.select("v", "root")
        total = own if total is None else composed(total, own)
    return total if total is not None else edge.df.select(F.col("a").alias("v"), F.col("b").alias("root"))


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(v, root) of first, then of second, whose vertices are roots of first."""
    onward = second.select(F.col("v").alias("root"), F.col("root").alias("next"))
    return save(first.join(onward, "root", "left").select("v", F.coalesce("next", "root").alias("root")).unionByName(second), "cc-total").df


#: Members of a group that are compared in one cell.
CELL = 2048


def linked(keys: Saved, features: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column], verify) -> DataFrame:
    """(key, id, lead) -> (v, root): components of the links between ids that share a key; lead is a key's least id.

    A group is a lead with all ids of its keys. As alike ids share many keys and so a lead, groups have far fewer rows than keys, and ids that
    share a key are in one. A group of two is a pair, for which near decides whether its texts are read. Larger ones are cells, and rows
    (cell, id) are joined, not pairs. A group of more than CELL is cut into several cells, each with the lead; where it then has several components,
    all that are outside of the main one ask the others, in cells of CELL of either. So a pair that shares a key and fulfils near
    and verify is either found or already connected.

    features(ids) gives (id, f) for a table of ids, and is asked once; near compares two f; verify(pairs) keeps the (a, b) that are links, and
    verify.within(cells, parts) gives links (a, b) that join the linked rows of (cell, id, root, asks) in a cell of which one asks.
    """
    member = save(keys.df.filter("lead <> id").select("lead", "id").distinct(), "link-members")
    own = features(member.df.select(F.explode(F.array("lead", "id")).alias("id")).distinct())
    sized = member.df.groupBy("lead").agg(F.count("*").alias("n"))
    sized = save(sized.withColumn("cells", F.ceil(F.col("n") / CELL)), "link-groups").df
    pairs = member.df.join(sized.filter("n = 1"), "lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    found = save(verify(_near_pairs(pairs, own, near)), "links").df
    if not (larger := sized.filter("n > 1")).isEmpty():
        salt = F.pmod(F.xxhash64("id"), F.col("cells")).alias("salt")
        salts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        rows = member.df.join(larger, "lead").select("lead", salt, "id").unionByName(larger.select("lead", salts("cells").alias("salt"), F.col("lead").alias("id")))
        rows = save(rows.select(F.xxhash64("lead", "salt").alias("cell"), "id", F.col("id").alias("root"), F.lit(True).alias("asks")), "link-cells").df
        found = found.unionByName(save(verify.within(rows, _parts(rows)), "links").df)
    roots = components(found)
    many = larger.filter("cells > 1")
    if many.isEmpty():
        return roots
    rows = member.df.join(many, "lead").select("lead", "cells", "id").unionByName(many.select("lead", "cells", F.col("lead").alias("id")))
    rows = save(rows.join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "link-rest").df
    main = rows.groupBy("lead").agg(F.mode("root").alias("main"))
    out = rows.join(main, "lead").withColumn("asks", F.col("root") != F.col("main"))
    chunks = out.filter("asks").groupBy("lead").agg(F.ceil(F.count("*") / CELL).alias("chunks"))
    out = save(out.join(chunks, "lead"), "link-rest").df
    turned = F.pmod(F.xxhash64("id"), F.col("chunks"))
    asking = out.filter("asks").select("lead", salts("cells").alias("salt"), turned.alias("chunk"), "id", "root", F.lit(0).alias("order"))
    asked = out.select("lead", salt, salts("chunks").alias("chunk"), "id", "root", F.lit(1).alias("order"))
    cells = asking.unionByName(asked).groupBy(F.xxhash64("lead", "salt", "chunk").alias("cell"), "id", "root").agg((F.min("order") == 0).alias("asks"))
    cells = save(cells, "link-cells").df
    return components(found.unionByName(save(verify.within(cells, _parts(cells)), "links").df))


def _parts(rows: DataFrame) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // 16384)


def _near_pairs(pairs: DataFrame, f: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    side = lambda c: f.select(F.col("id").alias(c), F.col("f").alias(f"f_{c}"))
    return save(pairs.join(side("a"), "a").join(side("b"), "b").filter(near(F.col("f_a"), F.col("f_b"))).select("a", "b"), "link-near").df
