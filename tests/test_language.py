import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import community, fusion, text, traversal, vector
from graphloom.operators.tables import written
from graphloom.plans import ast as A
from graphloom.plans.parser import QueryError, parse
from graphloom.sources.sinks import toon


@pytest.fixture(scope="module")
def people(spark):
    nodes = spark.createDataFrame([(1, "Ada Lovelace", "Analytical Engine", "Analytical Engine algorithm notes", [1.0, 0.0, 0.0]), (2, "Grace Hopper", "COBOL", "COBOL compiler systems", [0.0, 1.0, 0.0]), (3, "Katherine Johnson", "FORTRAN", "orbital flight trajectory calculations", [0.0, 0.0, 1.0])], "_id long, name string, language string, text string, embedding array<double>")
    return PropertyGraph.of(spark, {"Person": nodes}, [("KNOWS", "Person", "Person", spark.createDataFrame([(10, 1, 2, 1952)], "_id long, _src long, _dst long, since long"))])


def test_quickstart(people):
    assert [tuple(r) for r in people.query("MATCH (a:Person)-[k:KNOWS]->(b) RETURN a.name, k.since, b.name").collect()] == [("Ada Lovelace", 1952, "Grace Hopper")]
    from pyspark.sql import functions as F

    body = people.nodes["Person"].select("_id", F.concat_ws("\n", "language", "name", "text").alias("body"))
    (hit,) = text.bm25(body, "compiler", 5).collect()
    assert hit["_id"] == 2 and abs(hit.score - 1.04170823097229) < 1e-6
    found = vector.top_k(people.nodes["Person"], "_id", "embedding", [1.0, 0.0, 0.0], 2).collect()
    assert [(r["_id"], round(r.score, 3)) for r in found] == [(1, 1.0), (2, 0.333)]


def test_fusion_order(spark):
    lists = [spark.createDataFrame([(n, float(-i)) for i, n in enumerate(order)], "id long, score double") for order in ([1, 2, 3], [2, 3, 1])]
    assert [r.id for r in fusion.rrf(lists, "id").collect()] == [2, 1, 3]


def test_seed_ranking(spark):
    m = spark.createDataFrame([(n, 0, c) for n, c in ((0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 1))], "node_id long, level int, community_id long")
    assert [tuple(r) for r in community.rank_by_seeds(m, [0, 1, 2, 3]).collect()] == [(0, 1.0), (1, 0.5)]


def test_leiden_incremental_starts_changed_vertices_anew(spark):
    """A vertex whose edges moved to the other clique leaves its community; one that lost all edges stays, alone."""
    clique = lambda ns: [(a, b, 1.0) for a in ns for b in ns if a < b]
    schema = "u long, v long, weight double"
    before = spark.createDataFrame(clique(range(5)) + clique(range(5, 10)) + [(4, 5, 1.0)], schema)
    left = [e for e in clique(range(4)) if 3 not in e] + clique(range(5, 10)) + [(4, n, 1.0) for n in range(5, 10)]
    gone = [(n, 3, 1.0) for n in range(3)] + [(n, 4, 1.0) for n in range(4)]
    changed = spark.createDataFrame(gone + [(4, n, 1.0) for n in range(6, 10)], schema)
    got = {r.node_id: r.community_id for r in community.leiden_incremental(spark.createDataFrame(left, schema), community.leiden(before), changed).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3} | dict.fromkeys(range(4, 10), 4)


def test_leiden_finds_two_cliques(spark):
    edges = [(a, b) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(0, 5)]
    e = community.undirected(spark.createDataFrame(edges, "u long, v long"))
    top = community.leiden(e).filter("level = 0").collect()
    assert {r.community_id for r in top if r.node_id < 5} == {0} and {r.community_id for r in top if r.node_id >= 5} == {5}
    spread = {r.node_id: r.community_id for r in community.communities(e).collect()}
    q = community.modularity(e, spark.createDataFrame(list(spread.items()), "node_id long, community_id long")).first()[0]
    assert q > 0.3
    again = community.leiden_incremental(e, community.leiden(e), spark.createDataFrame([(0, 5)], "u long, v long")).collect()
    assert {r.community_id for r in again} == {0, 5}


@pytest.mark.parametrize("query", ["MATCH (a) RETURN", "RETURN 1 +", "MATCH (a)-[r]->(b){1,2} RETURN a", "RETURN 'x", "MATCH (n) RETURN n n", "RETURN 1 AS a, 2 AS a", "RETURN 99999999999999999999", "RETURN " + "(" * 200 + "1" + ")" * 200])
def test_syntax_errors(query):
    with pytest.raises(QueryError):
        parse(query)


@pytest.mark.parametrize("query", ["RETURN x", "RETURN 1 < 2 < 3", "RETURN 'a' - 1", "MATCH (n:Person) RETURN n.name, count(*) + n.name.x", "RETURN $p", "RETURN foo(1)", "MATCH (n:Person:Other) RETURN n", "UNWIND 5 AS x RETURN x", "RETURN toBoolean(1)", "MATCH (n:Person) RETURN n.name LIMIT -1", "MATCH (n:Person) RETURN n.name AS a UNION MATCH (n:Person) RETURN n.text AS b"])
def test_rejected(people, query):
    with pytest.raises(QueryError):
        people.query(query).collect()


def test_precedence():
    assert parse("RETURN 2 * 3 ^ 2").query.bodies[0][0].items[0].expr == A.Binary("*", A.Lit(2), A.Binary("^", A.Lit(3), A.Lit(2)))


def test_unbounded_pattern_never_cuts_off(spark):
    n = spark.createDataFrame([(i,) for i in range(9)], "_id long")
    chain = lambda k: PropertyGraph.of(spark, {"N": n}, [("R", "N", "N", spark.createDataFrame([(100 + i, i, i + 1) for i in range(k)], "_id long, _src long, _dst long"))])
    assert chain(5).query("MATCH (a:N)-[:R*]->(b) RETURN count(*) AS n").first().n == 15
    with pytest.raises(Exception, match="still growing"):
        chain(7).query("MATCH (a:N)-[:R*]->(b) RETURN count(*) AS n").collect()


def test_writes_leave_the_old_graph(people):
    new = people.execute("MATCH (a:Person {name: 'Ada Lovelace'}) SET a.born = 1815 RETURN a.born").graph
    assert new.query("MATCH (a:Person) WHERE a.born = 1815 RETURN count(*) AS n").first().n == 1
    assert "born" not in people.node_props(["Person"])
    with pytest.raises(QueryError):
        people.execute("MATCH (a:Person {name: 'Ada Lovelace'}) DELETE a")
    with pytest.raises(NotImplementedError):
        people.execute("DROP INDEX x")


def test_toon():
    assert toon({"rows": [{"a": 1, "b": "x,y"}, {"a": 2.0, "b": None}]}) == 'rows[2]{a,b}:\n  1,"x,y"\n  2,null'


def test_power_values_and_first_seen_order(people):
    row = people.query("RETURN 2 * 3 ^ 2 AS a, 4 ^ 3 * 2 AS b, 2 ^ 3 ^ 2 AS c, -3 ^ 2 AS d, 8 / 2 ^ 2 AS e").first()
    assert tuple(row) == (18.0, 128.0, 64.0, 9.0, 2.0)
    assert people.query("UNWIND [3, 1, 3, 2] AS x WITH x ORDER BY x RETURN collect(DISTINCT x) AS xs").first().xs == [1, 2, 3]
    assert people.query("UNWIND [3, 1, 3, 2] AS x RETURN collect(DISTINCT x) AS xs").first().xs == [3, 1, 2]


def test_explain_runs_nothing_and_profile_keeps_the_write(people):
    before = people.query("MATCH (a:Person) RETURN count(*) AS n").first().n
    plan = people.execute("EXPLAIN CREATE (a:Person {name: 'New'})")
    assert plan.graph is people and [r.operator for r in plan.df.collect()] == ["Create"]
    done = people.execute("PROFILE CREATE (a:Person {name: 'New'})")
    assert "rows" in done.df.columns and done.counters
    assert done.graph.query("MATCH (a:Person) RETURN count(*) AS n").first().n == before + 1
    assert people.query("MATCH (a:Person) RETURN count(*) AS n").first().n == before


def test_toon_says_that_rows_were_cut_off(spark):
    from graphloom.sources.sinks import to_toon

    assert "truncated: true" in to_toon(spark.range(5), 3) and "truncated" not in to_toon(spark.range(3), 3)


def test_explore_shows_everything_unless_capped(spark):
    """A node with 1200 neighbours: all are shown, and a cap cuts only where it is asked for."""
    nodes = spark.range(1201).select(F.col("id").alias("_id"))
    edges = spark.range(1, 1201).select(F.col("id").alias("_id"), F.lit(0).cast("long").alias("_src"), F.col("id").alias("_dst"))
    g = PropertyGraph.of(spark, {"N": nodes}, [("R", "N", "N", edges)])
    found, links, cut = traversal.explore(g, 0, 1)
    assert (found.count(), links.count(), cut) == (1201, 1200, False)
    found, links, cut = traversal.explore(g, 0, 1, node_cap=11, edge_cap=4)
    assert ([r.node for r in found.collect()], [r.rel for r in links.collect()], cut) == (list(range(11)), [1, 2, 3, 4], True)


def test_distinct_counts_of_parts_that_meet_in_a_key(spark):
    """2000 x 3000 pairs meet in one node; they are not made, and the counts are those of the join."""
    ids = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("_id"), (F.col("id") % 7).alias("x"))
    to = lambda lo, hi, at: spark.range(lo, hi).select(F.col("id").alias("_id"), F.col("id").alias("_src"), at.alias("_dst"))
    nodes = {"N": ids(0, 3), "A": ids(10_000, 12_002), "B": ids(20_000, 23_000)}
    near = F.when(F.col("id") < 12_000, 0).otherwise(F.col("id") - 11_999).cast("long")
    g = PropertyGraph.of(spark, nodes, [("IN", "A", "N", to(10_000, 12_002, near)), ("IN", "B", "N", to(20_000, 23_000, F.lit(0).cast("long")))])
    for text in ("MATCH (a:A)-[:IN]->(n:N), (b:B)-[:IN]->(n)", "MATCH (a:A)-[:IN]->(n:N)<-[:IN]-(b:B)"):
        result = g.execute(text + " WHERE a.x > 2 AND b.x > 3 RETURN n.x AS k, count(DISTINCT a) AS a, count(DISTINCT b.x) AS b, max(b.x) AS m")
        a = sum(i % 7 > 2 for i in range(10_000, 12_000))
        assert [tuple(r) for r in result.df.collect()] == [(0, a, 3, 6)]
        plan = result.df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan
        both = g.query(text + " WHERE a.x + b.x > 11 AND a.x = 6 RETURN n.x AS k, count(DISTINCT a) AS a, count(*) AS n").collect()
        assert len(both) == 1 and both[0].a == sum(i % 7 == 6 for i in range(10_000, 12_000))


def planted(spark):
    """Eight groups of 40 vertices: dense inside, a few edges between them."""
    rng = np.random.default_rng(5)
    edges = {(a, b) for a in range(320) for b in range(a) if rng.random() < (0.3 if a // 40 == b // 40 else 0.005)}
    return written(community.undirected(spark.createDataFrame(sorted(edges), "u long, v long")), "planted")


def partition(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.community_id, set()).add(r.node_id)
    assert all(c == min(ns) for c, ns in groups.items())
    return sorted(map(sorted, groups.values()))


def test_large_graphs_are_merged_before_one_task_takes_them(spark, monkeypatch):
    """No task gets more than MAX_EDGES edges, every node is in one community a level, and the groups are found."""
    e = planted(spark)
    most = spark.sparkContext.accumulator(0)
    levels = community.leiden_levels

    def counted(u, *args, **options):
        most.add(int(len(u) > 100))
        return levels(u, *args, **options)

    monkeypatch.setattr(community, "leiden_levels", counted)
    monkeypatch.setattr(community, "MAX_EDGES", 100)
    found = community.leiden(e)
    assert e.count() > 2000 and found.groupBy("node_id", "level").count().filter("count > 1").isEmpty()
    finest = found.filter("level = 0").select("node_id", "community_id")
    assert finest.count() == 320 and most.value == 0
    exact = community.modularity(e, spark.range(320).select(F.col("id").alias("node_id"), F.floor(F.col("id") / 40).alias("community_id"))).first()[0]
    assert community.modularity(e, finest).first()[0] > 0.8 * exact
    for limit in (0, 100):  # to the end in joins, and with a task at the end
        assert community.modularity(e, community.communities(e, limit=limit)).first()[0] > 0.8 * exact
    with pytest.warns(RuntimeWarning):
        community.communities(e, rounds=1, limit=0)


def test_incremental_sweeps_move_as_one_task_does(spark, monkeypatch):
    e = planted(spark)
    before = written(community.leiden(e), "before")
    new = [(n, 40 * ((n // 40 + 3) % 8) + i, 1.0) for n in (3, 90, 200) for i in range(30)]
    changed = spark.createDataFrame(new + [(7, 1000, 1.0), (2000, 2001, 0.0)], "u long, v long, weight double")
    after = written(community.undirected(e.unionByName(changed.filter("weight > 0").select(e.columns))), "after")
    one = partition(community.leiden_incremental(after, before, changed))
    finest = before.filter("level = 0").select("node_id", "community_id")
    assert one != partition(finest)
    monkeypatch.setattr(community, "MAX_EDGES", 1200)  # fewer than the edges
    assert partition(community.leiden_incremental(after, before, changed)) == one
