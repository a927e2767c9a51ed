"""Queries over the graph API: traversal, search, communities, sources, sinks, writes, streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, fusion, text, traversal, vector
from ..operators.tables import shared_dir, written
from ..sources import exports
from ..sources.ingest import Store, ingest
from ..sources.star import node_id, star_graph
from .language import HANDOFF

API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
SHIFT = 1 << 40
USER, SUPPLIER, PART = 8 * SHIFT, 3 * SHIFT, 4 * SHIFT


def api(sql: str | None = None):
    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        API[f.__name__] = (f, sql)
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def handoff(spark: SparkSession, sf_dir: str, kind: str = "purchase") -> DataFrame:
    g = star_graph(spark, sf_dir)
    return g.edges(g.segments_of(["HANDOFF"]), ["kind"]).filter(F.col("kind") == kind)


def users(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(USER + i,) for i in ids], "src long")


# -- traversal
EDGES = f"{HANDOFF}, e AS (SELECT DISTINCT u, v FROM handoff WHERE event_type = 'purchase')"


@api(f"WITH RECURSIVE {EDGES}, w(s, v, d) AS (SELECT x, x, 0 FROM (VALUES (1::BIGINT), (2::BIGINT)) t(x) UNION SELECT s, e.v, d + 1 FROM w JOIN e ON e.u = w.v WHERE d < 2) SELECT s AS src, v AS node, CAST(min(d) AS INTEGER) AS depth FROM w GROUP BY 1, 2")
def k_hop(spark, sf_dir):
    nodes, _ = traversal.k_hop(traversal.orient(handoff(spark, sf_dir)), users(spark, 1, 2), 2)
    return nodes.select((F.col("src") - USER).alias("src"), (F.col("node") - USER).alias("node"), "depth")


@api(f"WITH RECURSIVE {EDGES}, both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e), w(v, d) AS (SELECT 1::BIGINT, 0 UNION SELECT b.v, d + 1 FROM w JOIN both_ways b ON b.u = w.v WHERE d < 4) SELECT v AS dst, CAST(min(d) AS INTEGER) AS hops FROM w WHERE v < 30 GROUP BY 1")
def bidirectional_shortest(spark, sf_dir):
    pairs = spark.range(30).select(F.lit(USER + 1).alias("src"), (F.col("id") + USER).alias("dst"))
    found = traversal.shortest(traversal.orient(handoff(spark, sf_dir), "both"), pairs, 4)
    return found.select((F.col("dst") - USER).alias("dst"), "hops")


@api(f"""WITH RECURSIVE {EDGES}, w(v, path) AS (SELECT 1::BIGINT, [1::BIGINT] UNION ALL SELECT e.v, list_append(path, e.v) FROM w JOIN e ON e.u = w.v WHERE len(path) < 5 AND NOT list_contains(path, e.v) AND w.v <> 7)
SELECT CAST(rank AS INTEGER) AS rank, CAST(len(path) - 1 AS INTEGER) AS hops, path AS nodes FROM (SELECT path, row_number() OVER (ORDER BY len(path), path) AS rank FROM w WHERE v = 7) WHERE rank <= 6""")
def yen_k_shortest(spark, sf_dir):
    pairs = spark.createDataFrame([(USER + 1, USER + 7)], "src long, dst long")
    found = traversal.yen(traversal.orient(handoff(spark, sf_dir)), pairs, 6, 4)
    return found.select("rank", "hops", F.transform("node_ids", lambda x: x - USER).alias("nodes"))


@api(f"WITH RECURSIVE {EDGES}, w(s, v, d) AS (SELECT x, x, 0 FROM (VALUES (1::BIGINT), (2::BIGINT)) t(x) UNION SELECT s, e.v, d + 1 FROM w JOIN e ON e.u = w.v WHERE d < 2) SELECT v AS node, CAST(min(d) AS INTEGER) AS depth FROM w GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def merge_top_k(spark, sf_dir):
    e = traversal.orient(handoff(spark, sf_dir))
    parts = [traversal.k_hop(e, users(spark, i), 2)[0] for i in (1, 2)]
    return traversal.merge_top_k(parts, 10).select((F.col("node") - USER).alias("node"), "depth")


@api("SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1")
def degree(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return traversal.degree(traversal.orient(g.edges(g.segments_of(["SUPPLIES"]), []))).select((F.col("node") - SUPPLIER).alias("supplier"), "degree")


@api()
def k_hop_sampled(spark, sf_dir):
    e = traversal.orient(handoff(spark, sf_dir))
    return traversal.k_hop(e, users(spark, 1, 2, 3), 3, per_hop=5, weight=traversal.degree(e).select("node", F.col("degree").cast("double").alias("weight")), seed=11)[0]


@api("SELECT CAST(3 AS BIGINT) AS seeds, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS early")
def k_hop_sampled_within(spark, sf_dir):
    """Of the sample: seeds; nodes that the whole k-hop doesn't have; nodes nearer than there."""
    whole = traversal.k_hop(traversal.orient(handoff(spark, sf_dir)), users(spark, 1, 2, 3), 3)[0]
    both = k_hop_sampled(spark, sf_dir).join(whole.select("src", "node", F.col("depth").alias("least")), ["src", "node"], "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(n(F.col("depth") == 0).alias("seeds"), n(F.col("least").isNull()).alias("outside"), n(F.col("depth") < F.col("least")).alias("early"))


@api("SELECT 'Nation' AS label, CAST(0 AS INTEGER) AS depth, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'Customer', 1, (SELECT count(*) FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'Supplier', 1, (SELECT count(*) FROM supplier WHERE s_nationkey = 3) UNION ALL SELECT 'Region', 1, 1")
def explore(spark, sf_dir):
    nodes, _, _ = traversal.explore(star_graph(spark, sf_dir), SHIFT + 3, 1)
    return nodes.groupBy("label", "depth").agg(F.count("*").alias("n")).filter("n > 0")


@api("SELECT 'self' AS direction, 'Region' AS type, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'in', 'IN_REGION', count(*) FROM nation WHERE n_regionkey = 2")
def inspect(spark, sf_dir):
    return star_graph(spark, sf_dir).inspect(2).groupBy("direction", "type").agg(F.count("*").alias("n"))


@api("SELECT 'label' AS kind, 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'label', 'Part', count(*) FROM part UNION ALL SELECT 'type', 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'type', 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
def schema(spark, sf_dir):
    return star_graph(spark, sf_dir).schema().filter(F.col("name").isin("Customer", "Part", "CONTAINS", "IN_NATION")).select("kind", "name", "n")


# -- search
QUERY = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]
SQL_QUERY = "[" + ", ".join(map(str, QUERY)) + "]"
L2 = f"list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(CAST(embedding AS DOUBLE[]), CAST({SQL_QUERY} AS DOUBLE[]))])"
DOT = f"list_sum([x[1] * x[2] for x in list_zip(CAST(embedding AS DOUBLE[]), CAST({SQL_QUERY} AS DOUBLE[]))])"
NORM = "sqrt(list_sum([x * x for x in CAST(embedding AS DOUBLE[])]))"


def ranked(spark, sf_dir, metric, where=None):
    out = vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 20, metric, where)
    return out.select("vec_id", F.round("score", 6).alias("score"))


@api(f"SELECT vec_id, round(1 / (1 + d), 6) AS score FROM (SELECT vec_id, {L2} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 20")
def vector_l2(spark, sf_dir):
    return ranked(spark, sf_dir, "l2")


@api(f"SELECT vec_id, round(d, 6) AS score FROM (SELECT vec_id, {DOT} AS d FROM embeddings) ORDER BY d DESC, vec_id LIMIT 20")
def vector_ip(spark, sf_dir):
    return ranked(spark, sf_dir, "ip")


@api(f"SELECT vec_id, round(d, 6) AS score FROM (SELECT vec_id, {DOT} / {NORM} / {sum(x * x for x in QUERY) ** 0.5!r} AS d FROM embeddings) ORDER BY d DESC, vec_id LIMIT 20")
def vector_cosine(spark, sf_dir):
    return ranked(spark, sf_dir, "cosine")


@api(f"SELECT vec_id, round(1 / (1 + d), 6) AS score FROM (SELECT vec_id, CAST(list_sum([CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END for x in list_zip(CAST(embedding AS DOUBLE[]), CAST({SQL_QUERY} AS DOUBLE[]))]) AS DOUBLE) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 20")
def vector_hamming(spark, sf_dir):
    return ranked(spark, sf_dir, "hamming")


@api(f"SELECT vec_id, round(1 / (1 + d), 6) AS score FROM (SELECT vec_id, {L2} AS d FROM embeddings WHERE label = 3 OR (label IN (1, 2) AND vec_id < 250)) ORDER BY d, vec_id LIMIT 20")
def vector_filtered(spark, sf_dir):
    return ranked(spark, sf_dir, "l2", vector.predicate(("or", ("eq", "label", 3), ("and", ("in", "label", [1, 2]), ("and", ("any",),)))) & ((F.col("label") == 3) | (F.col("vec_id") < 250)))


@api(f"SELECT vec_id, round(1 / (1 + d), 6) AS score FROM (SELECT vec_id, {L2} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def vector_sq8_rescored(spark, sf_dir):
    return vector.sq8_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 10).select("vec_id", F.round("score", 6).alias("score"))


@api()
def vector_binary_rescored(spark, sf_dir):
    return vector.binary_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 10)


@api()
def vector_rabitq_rescored(spark, sf_dir):
    return vector.rabitq_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 10)


def recalled(found, exact):
    """One row: how many of the exact ten are found."""
    return exact.join(found, "vec_id", "left_semi").agg(F.count("*").alias("found"))


def exact_ten(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return vector.top_k(t, "vec_id", "embedding", QUERY, 10)


@api()
def vector_binary_recall(spark, sf_dir):
    return recalled(vector_binary_rescored(spark, sf_dir), exact_ten(spark, sf_dir))


@api()
def vector_rabitq_recall(spark, sf_dir):
    return recalled(vector_rabitq_rescored(spark, sf_dir), exact_ten(spark, sf_dir))


@api("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 5), s AS (SELECT query_id, vec_id, 1 / (1 + list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(CAST(embedding AS DOUBLE[]), q)])) AS s FROM embeddings, q)
SELECT query_id, vec_id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def vector_many_queries(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    out = vector.top_k_many(t, "vec_id", "embedding", t.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)
    return out.select("query_id", "vec_id", F.round("score", 5).alias("score"))


@api(f"SELECT vec_id FROM (SELECT vec_id, {L2} AS d FROM embeddings WHERE label = 3) ORDER BY d, vec_id LIMIT 10")
def near_condition(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    g = g.with_(nodes={**g.nodes, "Vector": g.nodes["Vector"].filter("cluster = 3")})
    return g.query("MATCH (v:Vector) WHERE v.embedding NEAR $q RETURN v.vec_id AS vec_id", {"q": QUERY})


@api(f"SELECT vec_id FROM (SELECT vec_id, {L2} AS d FROM embeddings) WHERE d < 6.5")
def vector_distance_condition(spark, sf_dir):
    return star_graph(spark, sf_dir).query("MATCH (v:Vector) WHERE vector_distance(v.embedding, $q) < 6.5 RETURN v.vec_id AS vec_id", {"q": QUERY})


@api(f"SELECT vec_id, round(1 / (1 + d), 6) AS score FROM (SELECT vec_id, {L2} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 7")
def vector_index_procedure(spark, sf_dir):
    g = star_graph(spark, sf_dir).execute("CREATE VECTOR INDEX vectors FOR (v:Vector) ON (v.embedding) OPTIONS {indexConfig: {`vector.dimensions`: 64}}").graph
    return g.query("CALL db.index.vector.queryNodes('vectors', 7, $q) YIELD node, score RETURN node.vec_id AS vec_id, round(score * 1000000) / 1000000.0 AS score", {"q": QUERY})


TOKENS = r"[x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') if x <> '' AND strlen(x) < 40]"


def bm25_sql(words: list[str], where: str = "true", k: int = 10) -> str:
    parts = [f"len([x for x in ts if x = '{w}']) AS f{i}" for i, w in enumerate(words)]
    stats = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return f"""SELECT doc_id, score FROM (WITH t AS (SELECT doc_id, {TOKENS} AS ts FROM documents WHERE text IS NOT NULL AND {where}), f AS (SELECT doc_id, CAST(len(ts) AS DOUBLE) AS dl, {", ".join(parts)} FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {stats} FROM f) SELECT doc_id, {score} AS score FROM f, s WHERE {hit}) ORDER BY score DESC, doc_id LIMIT {k}"""


@api("SELECT doc_id, round(score, 6) AS score FROM (" + bm25_sql(["license", "software", "the"]) + ")")
def bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("body"))
    return text.bm25(docs, "license Software, the", 10).select(F.col("_id").alias("doc_id"), F.round("score", 6).alias("score"))


PHRASE = f"""SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS ts FROM documents WHERE text IS NOT NULL) WHERE contains(' ' || array_to_string(ts, ' ') || ' ', ' mit license ') OR list_contains(ts, 'apache')"""


@api(PHRASE)
def bm25_phrase(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("body"))
    return text.bm25(docs, "mit-license apache").select(F.col("_id").alias("doc_id"))


@api(f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({bm25_sql(["the", "and"], k=15)})),
b AS (SELECT doc_id, row_number() OVER (ORDER BY d, doc_id) AS r FROM (SELECT vec_id AS doc_id, {L2} AS d FROM embeddings JOIN documents ON doc_id = vec_id ORDER BY d, vec_id LIMIT 15))
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def hybrid_rank(spark, sf_dir):
    """Documents that carry a vector, ranked by both."""
    g = star_graph(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left").select(node_id("Document", "doc_id").alias("_id"), "doc_id", "text", "embedding")
    g = g.with_(nodes={**g.nodes, "Document": docs})
    found = g.query("MATCH (d:Document) RANK BY HYBRID(VECTOR(d.embedding, $q, K=15), TEXT(d.text, 'the and', K=15)) AS s WITH FUSION = RRF(k=60) RETURN d.doc_id AS doc_id, s", {"q": QUERY})
    return found.select("doc_id", F.round("s", 9).alias("score"))


@api("SELECT doc_id, round(score, 6) AS score FROM (" + bm25_sql(["license", "the"], "doc_id % 3 = 0") + ")")
def search_with_acl(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    docs = g.nodes["Document"]
    acl = docs.filter("doc_id % 3 = 0").select(F.col("_id").alias("node_id"), F.when(F.col("doc_id") % 2 == 0, "ann").otherwise("public").alias("principal"))
    found = fusion.hybrid_search(g.with_(acl=acl), ["Document"], text="license the", k=10, principals=["ann"])
    return found.select((F.col("_id") - 6 * SHIFT).alias("doc_id"), F.round("score", 6).alias("score"))


# -- communities
def supplies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return community.undirected(lines.select((F.col("l_suppkey") + SUPPLIER).alias("u"), (F.col("l_partkey") + PART).alias("v")))


def regions(spark, sf_dir):
    """A membership that SQL can state: suppliers by key modulo 5, parts by size modulo 5."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("node_id"), (F.col("s_suppkey") % 5).alias("community_id"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + PART).alias("node_id"), (F.col("p_size") % 5).cast("long").alias("community_id"))
    return s.unionByName(p).select("node_id", F.lit(0).alias("level"), "community_id")


@api("""WITH e AS (SELECT s_suppkey % 5 AS a, p_size % 5 AS b, count(*) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), m AS (SELECT 2.0 * sum(w) AS m2 FROM e),
d AS (SELECT c, sum(w) AS k FROM (SELECT a AS c, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY 1), i AS (SELECT a AS c, 2 * sum(w) AS w FROM e WHERE a = b GROUP BY 1)
SELECT round(sum(coalesce(i.w, 0) / m2 - (k / m2) * (k / m2)), 9) AS modularity FROM d LEFT JOIN i USING (c), m""")
def modularity(spark, sf_dir):
    return community.modularity(supplies(spark, sf_dir), regions(spark, sf_dir)).select(F.round("modularity", 9).alias("modularity"))


@api()
def leiden(spark, sf_dir):
    return community.leiden(supplies(spark, sf_dir))


@api()
def leiden_incremental(spark, sf_dir):
    e = supplies(spark, sf_dir)
    before = written(community.leiden(e), "leiden-before")
    changed = spark.createDataFrame([(SUPPLIER + 1, PART + i, 5.0) for i in range(5)], "u long, v long, weight double")
    return community.leiden_incremental(community.undirected(e.unionByName(changed)), before, changed)


@api()
def communities_distributed(spark, sf_dir):
    return community.communities(supplies(spark, sf_dir))


NODES = "SELECT count(*) AS nodes, count(*) AS once, true AS better FROM (SELECT l_suppkey AS k, 's' AS t FROM lineitem UNION SELECT l_partkey, 'p' FROM lineitem)"


def quality(edges, membership, least):
    """One row: nodes at the finest level, those that are in one community only, and whether the modularity is `least` or more."""
    once = membership.filter("level = 0").groupBy("node_id").agg(F.count("*").alias("n"))
    counts = once.agg(F.count("*").alias("nodes"), F.sum((F.col("n") == 1).cast("long")).alias("once"))
    found = community.modularity(edges, membership.filter("level = 0"))
    return counts.crossJoin(found).crossJoin(least.select(F.col("modularity").alias("least"))).select("nodes", "once", (F.col("modularity") >= F.col("least")).alias("better"))


@api(NODES)
def leiden_quality(spark, sf_dir):
    """Against the partition by keys, whose modularity SQL checks."""
    e = written(supplies(spark, sf_dir), "supplies")
    return quality(e, community.leiden(e), community.modularity(e, regions(spark, sf_dir)))


@api(NODES)
def communities_distributed_quality(spark, sf_dir):
    """Against the partition by keys."""
    e = written(supplies(spark, sf_dir), "supplies")
    return quality(e, community.communities(e), community.modularity(e, regions(spark, sf_dir)))


@api(NODES)
def leiden_incremental_quality(spark, sf_dir):
    """After five edges more: at least nine tenths of the modularity of a run from scratch."""
    e = written(supplies(spark, sf_dir), "supplies")
    changed = e.filter(F.col("u") == SUPPLIER + 1).orderBy("v").limit(5).select("u", "v", F.lit(5.0).alias("weight"))
    after = written(community.undirected(e.unionByName(changed)), "supplies-after")
    scratch = community.modularity(after, community.leiden(after).filter("level = 0"))
    return quality(after, community.leiden_incremental(after, written(community.leiden(e), "leiden-before"), changed), scratch.select((0.9 * F.col("modularity")).alias("modularity")))


@api("SELECT c AS community_id, count(*) FILTER (WHERE hit) / count(*) AS score FROM (SELECT s_suppkey % 5 AS c, s_suppkey IN (1, 2, 6, 8) AS hit FROM supplier UNION ALL SELECT p_size % 5, false FROM part) GROUP BY 1 HAVING count(*) FILTER (WHERE hit) > 0")
def rank_by_seeds(spark, sf_dir):
    return community.rank_by_seeds(regions(spark, sf_dir), [SUPPLIER + i for i in (1, 2, 6, 8)])


@api(f"SELECT s_suppkey + {SUPPLIER} AS node_id FROM supplier WHERE s_suppkey % 5 = 2 UNION ALL SELECT p_partkey + {PART} FROM part WHERE p_size % 5 = 2")
def community_members(spark, sf_dir):
    return community.members(regions(spark, sf_dir), 2)


@api("SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 = 2")
def community_condition(spark, sf_dir):
    g = star_graph(spark, sf_dir).with_(membership=regions(spark, sf_dir))
    return g.query("MATCH (s:Supplier) WHERE s IN COMMUNITY(2) AND community(s) = 2 RETURN s.suppkey AS k")


@api("SELECT s_suppkey % 5 AS community_id, count(*) AS n FROM supplier GROUP BY 1")
def community_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("node_id"))
    return community.lookup(regions(spark, sf_dir), ids).groupBy("community_id").agg(F.count("*").alias("n"))


# -- sources and sinks
def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"


@api("SELECT printf('%04x', n_nationkey) AS external_id, CAST(n_nationkey % 3 AS BIGINT) AS label, CAST(1.0 AS DOUBLE) AS weight FROM nation")
def source_ndjson(spark, sf_dir):
    hexed = F.lower(F.lpad(F.hex("n_nationkey"), 4, "0"))
    rows = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.lit("node").alias("kind"), hexed.alias("external_id"), (F.col("n_nationkey") % 3).alias("label_or_type"), F.lit("3ff0000000000000").alias("float_bits"), F.lit("6164").alias("opaque"))).alias("value"))
    rows.write.text(path := folder(spark))
    return exports.native_ndjson(spark, path)[0].select("external_id", "label", "weight")


@api("SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def source_csv_export(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias(":ID"), F.lit("Nation").alias(":LABEL"), F.col("n_name").alias("name:string")).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias(":ID"), F.lit("Region").alias(":LABEL"), F.col("r_name").alias("name:string")))
    rels = n.select(F.concat(F.lit("n"), "n_nationkey").alias(":START_ID"), F.concat(F.lit("r"), "n_regionkey").alias(":END_ID"), F.lit("IN_REGION").alias(":TYPE"), (F.col("n_nationkey") * 2).alias("w:int"))
    a, b = folder(spark), folder(spark)
    nodes.coalesce(1).write.csv(a, header=True, quote='"', escape='"')
    rels.coalesce(1).write.csv(b, header=True, quote='"', escape='"')
    store, _ = ingest(Store.empty(spark), *exports.csv_export(spark, a, b))
    return store.graph().query("MATCH (n:Nation)-[x:IN_REGION]->(r:Region) RETURN r.name AS region, count(x.w) AS n")


@api("SELECT 'Ada' AS a, CAST(1952 AS BIGINT) AS since, 'Grace' AS b")
def source_create_script(spark, sf_dir):
    script = "CREATE (a:Person {name: 'Ada', tags: ['x']}), (b:Person {name: 'Grace'}); CREATE (a)-[:KNOWS {since: 1952}]->(b);"
    store, _ = ingest(Store.empty(spark), *exports.create_script(spark, script))
    return store.graph().query("MATCH (a:Person)-[k:KNOWS]->(b:Person) RETURN a.name AS a, k.since AS since, b.name AS b")


@api("SELECT 'created' AS outcome, 'node' AS kind, count(*) AS n FROM customer WHERE c_custkey >= 10 UNION ALL SELECT 'unchanged', 'node', 5 UNION ALL SELECT 'conflict', 'node', 5 UNION ALL SELECT 'missing_endpoint', 'relationship', 1")
def source_ingest(spark, sf_dir):
    """A second batch of which five records are known, five differ, and one relationship has no end."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("c"), "c_custkey").alias("external_id"), F.lit("Customer").alias("label"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("properties"), "c_custkey")
    store, _ = ingest(Store.empty(spark), rows.filter("c_custkey < 10"))
    changed = rows.withColumn("properties", F.when(F.col("c_custkey").between(5, 9), F.lit("{}")).otherwise(F.col("properties")))
    lost = spark.createDataFrame([("x", "c1", "nobody", "KNOWS", "{}")], "external_id string, from_external_id string, to_external_id string, rel_type string, properties string")
    return ingest(store, changed, lost)[1].groupBy("outcome", "kind").agg(F.count("*").alias("n"))


@api("SELECT n_name AS name FROM nation")
def sink_parquet_round_trip(spark, sf_dir):
    from ..sources.sinks import to_parquet

    to_parquet(star_graph(spark, sf_dir).query("MATCH (n:Nation) RETURN n.name AS name"), path := folder(spark))
    return spark.read.parquet(path)


@api("SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS k FROM region")
def sink_json(spark, sf_dir):
    from ..sources.sinks import to_json

    rows = json.loads(to_json(star_graph(spark, sf_dir).query("MATCH (r:Region) RETURN r.name AS name, r.regionkey AS k")))["rows"]
    return spark.createDataFrame([(r["name"], r["k"]) for r in rows], "name string, k long")


@api("SELECT r_name AS name FROM region")
def sink_cursor(spark, sf_dir):
    from ..sources.sinks import cursor

    found = [r for part in cursor(star_graph(spark, sf_dir).query("MATCH (r:Region) RETURN r.name AS name"), 2) for r in part]
    return spark.createDataFrame(found, "name string")


# -- writes, as the graph after them
@api("SELECT count(*) - 1 AS customers, (SELECT count(*) FROM orders WHERE o_custkey <> 7) AS placed FROM customer")
def detach_delete(spark, sf_dir):
    g = star_graph(spark, sf_dir).execute("MATCH (c:Customer {custkey: 7}) DETACH DELETE c").graph
    return g.query("MATCH (c:Customer) WITH count(*) AS customers MATCH ()-[p:PLACED]->() RETURN customers, count(p) AS placed")


@api("SELECT count(*) AS n FROM orders WHERE o_custkey <> 7")
def delete_relationships(spark, sf_dir):
    g = star_graph(spark, sf_dir).execute("MATCH (c:Customer {custkey: 7})-[r:PLACED]->() DELETE r").graph
    return g.query("MATCH ()-[p:PLACED]->() RETURN count(p) AS n")


@api("SELECT n_name AS nation, CAST(n_nationkey * 10 AS BIGINT) AS v FROM nation")
def write_then_read(spark, sf_dir):
    steps = star_graph(spark, sf_dir).run("MATCH (n:Nation) CREATE (n)-[:HAS {w: n.nationkey}]->(:Tag {v: n.nationkey * 10}); MATCH (n:Nation)-[:HAS]->(t:Tag) RETURN n.name AS nation, t.v AS v")
    return steps[-1].df


@api("SELECT 'by_name' AS name, 'RANGE' AS type, 'Customer' AS label")
def show_indexes(spark, sf_dir):
    g = star_graph(spark, sf_dir).execute("CREATE INDEX by_name FOR (c:Customer) ON (c.name)").graph
    return g.query("SHOW INDEXES YIELD name, type, labelsOrTypes RETURN name, type, labelsOrTypes[0] AS label")


# -- streaming
@api("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windows(spark, sf_dir):
    from ..streaming.upsert import windowed_counts

    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = folder(spark)
    job = windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").option("checkpointLocation", folder(spark)).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@api("SELECT user_id AS external_id, count(*) > 0 AS seen FROM events GROUP BY 1")
def streaming_upsert(spark, sf_dir):
    from ..streaming.upsert import upsert_into

    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/event[s].parquet").select(F.col("user_id").alias("external_id"))
    out = folder(spark)
    stream.writeStream.option("checkpointLocation", folder(spark)).foreachBatch(upsert_into(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("external_id", F.lit(True).alias("seen"))
