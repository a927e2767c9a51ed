"""Queries in the graph language over the star graph, each with its SQL twin."""

from __future__ import annotations

#: name: (text, SQL, parameters)
LANGUAGE: dict[str, tuple[str, str | None, dict]] = {}

ORDER, PART, SUPPLIER, NATION, CUSTOMER = 5 << 40, 4 << 40, 3 << 40, 1 << 40, 2 << 40
#: HANDOFF edges: consecutive users of one event type on one day.
HANDOFF = """handoff AS (SELECT DISTINCT event_type, user_id AS u, nxt AS v FROM (
  SELECT event_type, user_id, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> user_id)"""


def q(name: str, text: str, sql: str | None = None, **params) -> None:
    LANGUAGE[name] = (text, sql, params)


# -- scans and filters
q("flagship", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 100000 RETURN c.name AS name, count(*) AS n, toInteger(round(sum(o.totalprice))) AS s ORDER BY s DESC, name LIMIT 10",
  "SELECT c_name AS name, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS s FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_custkey, c_name ORDER BY s DESC, name LIMIT 10")
q("scan_label", "MATCH (c:Customer) RETURN c.custkey AS custkey, c.name AS name, c.acctbal AS acctbal", "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer")
q("scan_unlabelled", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n",
  "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Vector', count(*) FROM embeddings UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events")
q("count_nodes", "MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders")
q("count_rels", "MATCH ()-[r:CONTAINS]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem")
q("property_lookup", "MATCH (c:Customer {custkey: $k}) RETURN c.name AS name, c.mktsegment AS segment", "SELECT c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey = 42", k=42)
q("filter_conjunction", "MATCH (o:Order) WHERE o.totalprice > 250000 AND o.status <> 'F' AND NOT o.priority STARTS WITH '1' RETURN o.orderkey AS k, o.totalprice AS p",
  "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'F' AND NOT starts_with(o_orderpriority, '1')")
q("filter_three_valued", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 450000 WITH c, o WHERE o.totalprice > 460000 OR c.acctbal > 9000 XOR o.status = 'F' RETURN c.custkey AS k, o.orderkey AS ok",
  "SELECT c_custkey AS k, o_orderkey AS ok FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON o_custkey = c_custkey WHERE o_totalprice > 460000 OR ((c_acctbal > 9000) <> (o_orderstatus = 'F'))")
q("filter_in_list", "MATCH (p:Part) WHERE p.size IN [1, 7, 49] AND p.brand CONTAINS '1' RETURN p.partkey AS k, p.size AS size, p.brand AS brand", "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS size, p_brand AS brand FROM part WHERE p_size IN (1, 7, 49) AND contains(p_brand, '1')")
q("project_expressions", "MATCH (s:Supplier) RETURN s.suppkey AS k, s.suppkey % 3 AS m, s.suppkey / 2 AS h, s.acctbal * 2 AS d, s.name + '!' AS name", "SELECT s_suppkey AS k, s_suppkey % 3 AS m, s_suppkey // 2 AS h, s_acctbal * 2 AS d, s_name || '!' AS name FROM supplier")
q("project_wildcard", "MATCH (r:Region) WITH r.regionkey AS k, r.name AS name RETURN *", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region")
q("with_pipeline", "MATCH (c:Customer) WITH c.nationkey AS nation, avg(c.acctbal) AS a, count(*) AS n WHERE n > 5 RETURN nation, n, toInteger(round(a)) AS a",
  "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS n, CAST(round(avg(c_acctbal)) AS BIGINT) AS a FROM customer GROUP BY 1 HAVING count(*) > 5")
q("parameters", "MATCH (o:Order) WHERE o.status IN $states AND o.totalprice < $most RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice < 5000.0", states=["F", "P"], most=5000.0)

# -- expansion and joins
q("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS name, o.orderkey AS k", "SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey")
q("expand_in", "MATCH (n:Nation)<-[:IN_NATION]-(x) RETURN n.name AS nation, labels(x)[0] AS label, count(*) AS n",
  "SELECT n_name AS nation, label, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k, 'Customer' AS label FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier) ON k = n_nationkey GROUP BY 1, 2")
q("expand_undirected", "MATCH (a:User)-[r:HANDOFF {kind: 'click'}]-(b:User) RETURN a.user_id AS a, b.user_id AS b", f"WITH {HANDOFF} SELECT u AS a, v AS b FROM handoff WHERE event_type = 'click' UNION ALL SELECT v, u FROM handoff WHERE event_type = 'click'")
q("expand_any_type", "MATCH (a:Supplier)-[r]-(b) RETURN type(r) AS type, labels(b)[0] AS label, count(*) AS n",
  "SELECT 'IN_NATION' AS type, 'Nation' AS label, count(*) AS n FROM supplier UNION ALL SELECT 'SUPPLIED_BY', 'Order', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', 'Part', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
q("expand_two_hops", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(c) AS n, toInteger(round(sum(c.acctbal))) AS s",
  "SELECT r_name AS region, count(*) AS n, CAST(round(sum(c_acctbal)) AS BIGINT) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("expand_bound_end", "MATCH (o:Order)-[c:CONTAINS]->(p:Part)<-[:SUPPLIES]-(s:Supplier)<-[:SUPPLIED_BY]-(o) WHERE o.totalprice > 480000 RETURN o.orderkey AS k, p.partkey AS p, s.suppkey AS s, count(*) AS n",
  "SELECT o_orderkey AS k, a.l_partkey AS p, x.l_suppkey AS s, count(*) AS n FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x ON x.l_partkey = a.l_partkey JOIN lineitem b ON b.l_orderkey = o_orderkey AND b.l_suppkey = x.l_suppkey WHERE o_totalprice > 480000 GROUP BY 1, 2, 3")
q("relationship_properties", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity >= 49 AND p.size < 5 RETURN o.orderkey AS o, p.partkey AS p, r.quantity AS q, toInteger(round(r.price * (1 - r.discount))) AS net",
  "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q, CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) AS net FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49 AND p_size < 5")
q("multi_pattern_join", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(DISTINCT c) AS customers, count(DISTINCT s) AS suppliers",
  "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
q("cartesian_theta", "MATCH (a:Region), (b:Region) WHERE a.regionkey < b.regionkey RETURN a.name AS a, b.name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
q("shared_neighbour", "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE a <> b RETURN a.name AS a, count(DISTINCT b) AS n", "SELECT a.n_name AS a, count(DISTINCT b.n_nationkey) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1")
q("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN c.custkey AS k, count(o) AS n, max(o.totalprice) AS most",
  "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1")
q("optional_two_hops", "MATCH (s:Supplier) OPTIONAL MATCH (s)<-[:SUPPLIED_BY]-(o:Order)<-[:PLACED]-(c:Customer {mktsegment: 'BUILDING'}) WHERE o.totalprice > 400000 RETURN s.suppkey AS s, count(DISTINCT c) AS n",
  "SELECT s_suppkey AS s, count(DISTINCT c_custkey) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, c_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 400000) ON l_suppkey = s_suppkey GROUP BY 1")
q("optional_leading", "OPTIONAL MATCH (n:Nation {name: 'nowhere'}) RETURN n.name AS name, count(n) AS n", "SELECT CAST(NULL AS VARCHAR) AS name, CAST(0 AS BIGINT) AS n")
q("optional_both_bound", "MATCH (s:Supplier), (p:Part) WHERE s.suppkey < 3 AND p.partkey < 20 OPTIONAL MATCH (s)-[r:SUPPLIES]->(p) RETURN s.suppkey AS s, p.partkey AS p, r IS NOT NULL AS supplies",
  "SELECT s_suppkey AS s, p_partkey AS p, x.l_suppkey IS NOT NULL AS supplies FROM supplier CROSS JOIN part LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x ON l_suppkey = s_suppkey AND l_partkey = p_partkey WHERE s_suppkey < 3 AND p_partkey < 20")
q("anti_join", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'P' WITH c, o WHERE o IS NULL RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
q("semi_join", "MATCH (p:Part)<-[r:CONTAINS]-() WHERE r.quantity = 50 RETURN DISTINCT p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)")
q("call_aggregate", "MATCH (c:Customer) WHERE c.custkey < 50 CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 RETURN count(o) AS n, max(o.totalprice) AS most } RETURN c.custkey AS k, n, most",
  "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE c_custkey < 50 GROUP BY 1")
q("call_top_per_row", "MATCH (c:Customer) WHERE c.custkey < 50 CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) RETURN o.orderkey AS ok, o.totalprice AS p ORDER BY p DESC, ok LIMIT 2 } RETURN c.custkey AS k, ok, p",
  "SELECT k, ok, p FROM (SELECT o_custkey AS k, o_orderkey AS ok, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_custkey < 50) WHERE r <= 2")
q("call_union", "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.name AS name UNION WITH n MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN s.name AS name } RETURN n.name AS nation, count(*) AS n",
  "SELECT n_name AS nation, count(*) AS n FROM nation JOIN (SELECT DISTINCT c_nationkey AS k, c_name AS name FROM customer UNION SELECT s_nationkey, s_name FROM supplier) ON k = n_nationkey GROUP BY 1")
q("call_uncorrelated", "CALL { MATCH (r:Region) RETURN count(*) AS regions } MATCH (n:Nation) RETURN n.name AS name, regions", "SELECT n_name AS name, (SELECT count(*) FROM region) AS regions FROM nation")

# -- variable length and paths
q("var_length_1_2", "MATCH (c:Customer)-[r:IN_NATION|IN_REGION*1..2]->(x) RETURN labels(x)[0] AS label, size(r) AS hops, count(*) AS n",
  "SELECT 'Nation' AS label, CAST(1 AS BIGINT) AS hops, count(*) AS n FROM customer UNION ALL SELECT 'Region', 2, count(*) FROM customer")
q("var_length_zero", "MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN labels(x)[0] AS label, x.name AS name, count(*) AS n", "SELECT 'Nation' AS label, n_name AS name, count(*) AS n FROM nation GROUP BY 2 UNION ALL SELECT 'Region', r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 2")
q("var_length_cycle", "MATCH (u:User)-[r:HANDOFF*1..2]->(v:User) WHERE u.user_id < 3 RETURN u.user_id AS u, v.user_id AS v, size(r) AS hops, count(*) AS n",
  f"WITH {HANDOFF} SELECT u, v, CAST(1 AS BIGINT) AS hops, count(*) AS n FROM handoff WHERE u < 3 GROUP BY 1, 2 UNION ALL SELECT a.u, b.v, 2, count(*) FROM handoff a JOIN handoff b ON a.v = b.u WHERE a.u < 3 AND NOT (a.event_type = b.event_type AND a.u = b.u AND a.v = b.v) GROUP BY 1, 2")
q("var_length_undirected", "MATCH (s:Supplier {suppkey: 1})-[:SUPPLIES*2..2]-(t:Supplier) RETURN t.suppkey AS t, count(*) AS n", "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT b.s AS t, count(*) AS n FROM e a JOIN e b ON a.p = b.p AND a.s <> b.s WHERE a.s = 1 GROUP BY 1")
q("var_length_recursive", "MATCH (u:User {user_id: 1})-[:HANDOFF*1..3 {kind: 'purchase'}]->(v:User) RETURN v.user_id AS v, count(*) AS n",
  f"WITH RECURSIVE {HANDOFF}, e AS (SELECT * FROM handoff WHERE event_type = 'purchase'), w(v, path, d) AS (SELECT v, [u || '-' || v], 1 FROM e WHERE u = 1 UNION ALL SELECT e.v, list_append(path, e.u || '-' || e.v), d + 1 FROM w JOIN e ON e.u = w.v WHERE d < 3 AND NOT list_contains(path, e.u || '-' || e.v)) SELECT v, count(*) AS n FROM w GROUP BY 1")
q("unbounded", "MATCH (c:Customer)-[:IN_NATION|IN_REGION*]->(x) WHERE c.custkey < 100 RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM customer WHERE c_custkey < 100 UNION ALL SELECT 'Region', count(*) FROM customer WHERE c_custkey < 100")
q("named_path", "MATCH p = (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN length(p) AS hops, [x IN nodes(p) | x.name] AS names, [x IN relationships(p) | type(x)] AS types",
  "SELECT CAST(2 AS BIGINT) AS hops, [r_name, n_name, s_name] AS names, ['IN_REGION', 'IN_NATION'] AS types FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
q("named_var_path", "MATCH p = (s:Supplier)-[:IN_NATION|IN_REGION*1..2]->(x) RETURN s.suppkey AS s, length(p) AS hops, [n IN nodes(p) | n.name] AS names",
  "SELECT s_suppkey AS s, CAST(1 AS BIGINT) AS hops, [s_name, n_name] AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, 2, [s_name, n_name, r_name] FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
BFS = f"""WITH RECURSIVE {HANDOFF}, e AS (SELECT DISTINCT u, v FROM handoff WHERE event_type = 'purchase'),
w(s, v, d) AS (SELECT 1::BIGINT, 1::BIGINT, 0 UNION SELECT w.s, e.v, d + 1 FROM w JOIN e ON e.u = w.v WHERE d < 5),
best AS (SELECT s, v, min(d) AS d FROM w WHERE v <> s GROUP BY 1, 2)"""
q("shortest_path", "MATCH (a:User {user_id: 1}), (b:User) WHERE b.user_id < 40 AND b.user_id <> 1 MATCH p = shortestPath((a)-[:HANDOFF*..5 {kind: 'purchase'}]->(b)) RETURN b.user_id AS b, length(p) AS hops, size(nodes(p)) AS n",
  BFS + " SELECT v AS b, CAST(d AS BIGINT) AS hops, CAST(d + 1 AS BIGINT) AS n FROM best WHERE v < 40")
q("shortest_path_open", "MATCH p = SHORTEST_PATH((a:User {user_id: 1})-[:HANDOFF*..5 {kind: 'purchase'}]->(b)) RETURN b.user_id AS b, length(p) AS hops", BFS + " SELECT v AS b, CAST(d AS BIGINT) AS hops FROM best")
q("all_shortest_paths", "MATCH (a:User {user_id: 1}), (b:User) WHERE b.user_id < 40 AND b.user_id <> 1 MATCH p = allShortestPaths((a)-[:HANDOFF*..3 {kind: 'purchase'}]->(b)) RETURN b.user_id AS b, length(p) AS hops, count(*) AS n",
  f"""WITH RECURSIVE {HANDOFF}, e AS (SELECT DISTINCT u, v FROM handoff WHERE event_type = 'purchase'),
w(v, d, path) AS (SELECT 1::BIGINT, 0, [1::BIGINT] UNION ALL SELECT e.v, d + 1, list_append(path, e.v) FROM w JOIN e ON e.u = w.v WHERE d < 3 AND NOT list_contains(path, e.v)),
best AS (SELECT v, min(d) AS d FROM w GROUP BY 1) SELECT w.v AS b, CAST(w.d AS BIGINT) AS hops, count(*) AS n FROM w JOIN best USING (v, d) WHERE w.v < 40 AND w.v <> 1 GROUP BY 1, 2""")

# -- aggregation, sets, order
q("aggregate_all", "MATCH (c:Customer) RETURN c.mktsegment AS segment, count(*) AS n, toInteger(round(sum(c.acctbal))) AS s, toInteger(round(avg(c.acctbal))) AS a, min(c.acctbal) AS lo, max(c.acctbal) AS hi, count(DISTINCT c.nationkey) AS nations",
  "SELECT c_mktsegment AS segment, count(*) AS n, CAST(round(sum(c_acctbal)) AS BIGINT) AS s, CAST(round(avg(c_acctbal)) AS BIGINT) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
q("aggregate_empty", "MATCH (c:Customer {custkey: -1}) RETURN count(*) AS n, sum(c.custkey) AS s, avg(c.acctbal) AS a, size(collect(c.name)) AS k", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a, CAST(0 AS BIGINT) AS k")
q("aggregate_grouped_empty", "MATCH (c:Customer {custkey: -1}) RETURN c.name AS name, count(*) AS n", "SELECT c_name AS name, count(*) AS n FROM customer WHERE c_custkey = -1 GROUP BY 1")
q("aggregate_nested", "MATCH (o:Order)-[:CONTAINS]->(p:Part) WITH o, count(p) AS parts RETURN parts, count(*) AS orders, toInteger(round(100.0 * count(*) / sum(parts))) AS ratio",
  "SELECT parts, count(*) AS orders, CAST(round(100.0 * count(*) / sum(parts)) AS BIGINT) AS ratio FROM (SELECT l_orderkey, count(*) AS parts FROM lineitem GROUP BY 1) GROUP BY 1")
q("aggregate_distinct", "MATCH (o:Order) RETURN sum(DISTINCT toInteger(o.totalprice) % 100) AS s, count(DISTINCT o.status) AS c, avg(DISTINCT o.custkey) AS a", "SELECT CAST(sum(DISTINCT CAST(trunc(o_totalprice) AS BIGINT) % 100) AS BIGINT) AS s, count(DISTINCT o_orderstatus) AS c, avg(DISTINCT o_custkey) AS a FROM orders")
q("collect_sorted", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.name DESC RETURN r.name AS region, collect(n.name) AS nations", "SELECT r_name AS region, list(n_name ORDER BY n_name DESC) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
q("collect_distinct", "MATCH (o:Order) WITH o ORDER BY o.orderkey RETURN o.status AS status, collect(DISTINCT o.priority) AS priorities", "SELECT s AS status, list(p ORDER BY k) AS priorities FROM (SELECT o_orderstatus AS s, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
q("power_precedence", "MATCH (r:Region) RETURN r.name AS name, 2 * 3 ^ 2 AS a, 4 ^ 3 * 2 AS b, 2 ^ 3 ^ 2 AS c, -3 ^ 2 AS d, 8 / r.regionkey ^ 2 AS e", "SELECT r_name AS name, 2 * power(3, 2) AS a, power(4, 3) * 2 AS b, power(power(2, 3), 2) AS c, power(-3, 2) AS d, CASE WHEN r_regionkey = 0 THEN 'Infinity'::DOUBLE ELSE 8 / power(r_regionkey, 2) END AS e FROM region")
q("distinct_rows", "MATCH (o:Order) RETURN DISTINCT o.status AS status, o.priority AS priority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
q("union_distinct", "MATCH (c:Customer) RETURN c.nationkey AS k, 'x' AS t UNION MATCH (s:Supplier) RETURN 'x' AS t, s.nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k, 'x' AS t FROM customer UNION SELECT s_nationkey, 'x' FROM supplier")
q("union_all", "MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name ORDER BY name LIMIT 12", "SELECT * FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region) ORDER BY name LIMIT 12")
q("order_nulls", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 480000 WITH c.custkey AS k, max(o.totalprice) AS m ORDER BY m DESC, k LIMIT 60 RETURN k, m",
  "SELECT c_custkey AS k, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 480000 GROUP BY 1 ORDER BY m DESC NULLS FIRST, k LIMIT 60")
q("order_not_projected", "MATCH (o:Order) RETURN o.orderkey AS k ORDER BY o.totalprice DESC, o.orderkey LIMIT 20", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
q("skip_limit", "MATCH (p:Part) RETURN p.partkey AS k, p.name AS name ORDER BY p.retailprice, k SKIP $s LIMIT 5 + 5", "SELECT p_partkey AS k, p_name AS name FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 7", s=7)
q("unwind_list", "UNWIND [3, 1, null, 2] AS x WITH x WHERE x IS NULL OR x > 1 RETURN x, x * 2 AS y", "SELECT CAST(x AS BIGINT) AS x, CAST(x * 2 AS BIGINT) AS y FROM (VALUES (3), (NULL), (2)) t(x)")
q("unwind_collected", "MATCH (n:Nation) WITH n.regionkey AS r, collect(n.name) AS names UNWIND names AS name RETURN r, name", "SELECT CAST(n_regionkey AS BIGINT) AS r, n_name AS name FROM nation")
q("unwind_empty", "UNWIND [] AS x RETURN count(*) AS n", "SELECT CAST(0 AS BIGINT) AS n")
q("with_limit_then_match", "MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 5 MATCH (c)-[:PLACED]->(o:Order) RETURN c.name AS name, count(*) AS n", "SELECT c_name AS name, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) JOIN orders ON o_custkey = c_custkey GROUP BY 1")

# -- functions and expressions
q("fn_entity", "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN id(n) AS n, labels(g) AS labels, type(r) AS type, keys(g) AS keys, properties(g).name AS name, exists(n.name) AS has, exists(n.nothing) AS none, id(r) AS r",
  "SELECT CAST(1099511627776 + n_nationkey AS BIGINT) AS n, ['Region'] AS labels, 'IN_REGION' AS type, ['name', 'regionkey'] AS keys, r_name AS name, true AS has, false AS none, CAST(1099511627776 + n_nationkey AS BIGINT) AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
q("fn_strings", "MATCH (p:Part) RETURN p.partkey AS k, toUpper(p.name) AS u, toLower(p.brand) AS l, substring(p.name, 2, 3) AS s, substring(p.name, 3) AS rest, left(p.type, 4) AS a, right(p.type, 3) AS b, replace(p.brand, '#', '-') AS r, split(p.type, ' ')[0] AS w, reverse(p.brand) AS rev, size(p.name) AS n, trim('  x ') AS t, lTrim(' y ') AS lt, rTrim(' z ') AS rt",
  "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_brand) AS l, substring(p_name, 3, 3) AS s, substring(p_name, 4) AS rest, left(p_type, 4) AS a, right(p_type, 3) AS b, replace(p_brand, '#', '-') AS r, split_part(p_type, ' ', 1) AS w, reverse(p_brand) AS rev, CAST(length(p_name) AS BIGINT) AS n, 'x' AS t, 'y ' AS lt, ' z' AS rt FROM part")
q("fn_math", "MATCH (s:Supplier) WITH s.suppkey AS k, s.acctbal AS x RETURN k, abs(x) AS a, ceil(x) AS c, floor(x) AS f, round(x) AS r, sign(x) AS sg, round(sqrt(abs(x)) * 1000) AS q, round(exp(0) * 10) AS e, round(log(k + 1) * 1000) AS l, round(log10(k + 1) * 1000) AS l10, round(sin(k) * 1000) AS sn, round(cos(k) * 1000) AS cs, round(tan(0.5) * 1000) AS t, round(e() * 1000) AS ee, round(pi() * 1000) AS p, 2 ^ 3 AS pw, -7 / 2 AS d, -7 % 3 AS m, rand() < 1.0 AS rnd",
  "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(s_acctbal) AS r, CAST(sign(s_acctbal) AS BIGINT) AS sg, round(sqrt(abs(s_acctbal)) * 1000) AS q, CAST(10 AS DOUBLE) AS e, round(ln(s_suppkey + 1) * 1000) AS l, round(log10(s_suppkey + 1) * 1000) AS l10, round(sin(s_suppkey) * 1000) AS sn, round(cos(s_suppkey) * 1000) AS cs, round(tan(0.5) * 1000) AS t, round(exp(1) * 1000) AS ee, round(pi() * 1000) AS p, CAST(8 AS DOUBLE) AS pw, CAST(-3 AS BIGINT) AS d, CAST(-1 AS BIGINT) AS m, true AS rnd FROM supplier")
q("fn_float_edges", "UNWIND [0.0, -1.0, 4.0] AS x RETURN x, 1.0 / x AS d, toString(log(x)) AS l, toString(sqrt(x)) AS s, x / 2.0 AS h", "SELECT * FROM (VALUES (CAST(0.0 AS DOUBLE), CAST('Infinity' AS DOUBLE), '-Infinity', '0.0', CAST(0.0 AS DOUBLE)), (CAST(-1.0 AS DOUBLE), CAST(-1.0 AS DOUBLE), 'NaN', 'NaN', CAST(-0.5 AS DOUBLE)), (CAST(4.0 AS DOUBLE), CAST(0.25 AS DOUBLE), '1.3862943611198906', '2.0', CAST(2.0 AS DOUBLE))) t(x, d, l, s, h)")
q("fn_conversion", "UNWIND ['12', '3.9', 'abc', ' true ', '-7', '1e3'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(12) AS t, toString(1.0) AS u, toString(123456789.5) AS v, toString(1e20) AS w, toString(0.00001) AS y, toInteger(-3.9) AS n",
  "SELECT s, i, f, b, '12' AS t, '1.0' AS u, '123456789.5' AS v, '100000000000000000000' AS w, '0.00001' AS y, CAST(-3 AS BIGINT) AS n FROM (VALUES ('12', CAST(12 AS BIGINT), CAST(12 AS DOUBLE), CAST(NULL AS BOOLEAN)), ('3.9', 3, 3.9, NULL), ('abc', NULL, NULL, NULL), (' true ', NULL, NULL, true), ('-7', -7, -7, NULL), ('1e3', 1000, 1000, NULL)) x(s, i, f, b)")
q("fn_lists", "WITH [5, 3, 8] AS l RETURN head(l) AS h, last(l) AS e, tail(l) AS t, size(l) AS n, l[1] AS i, l[-1] AS j, l[9] AS k, l[0..2] AS s, l[-2..] AS u, reverse(l) AS r, l + 1 AS p, [0] + l AS q, range(1, 7, 3) AS g, range(3, 1) AS z, range(3, 1, -1) AS y, coalesce(null, l[7], 4) AS c, 3 IN l AS m, null IN [] AS o, 9 IN [1, null] AS v",
  "SELECT CAST(5 AS BIGINT) AS h, CAST(8 AS BIGINT) AS e, CAST([3, 8] AS BIGINT[]) AS t, CAST(3 AS BIGINT) AS n, CAST(3 AS BIGINT) AS i, CAST(8 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS k, CAST([5, 3] AS BIGINT[]) AS s, CAST([3, 8] AS BIGINT[]) AS u, CAST([8, 3, 5] AS BIGINT[]) AS r, CAST([5, 3, 8, 1] AS BIGINT[]) AS p, CAST([0, 5, 3, 8] AS BIGINT[]) AS q, CAST([1, 4, 7] AS BIGINT[]) AS g, CAST([] AS BIGINT[]) AS z, CAST([3, 2, 1] AS BIGINT[]) AS y, CAST(4 AS BIGINT) AS c, true AS m, CAST(NULL AS BOOLEAN) AS o, CAST(NULL AS BOOLEAN) AS v")
q("list_predicates", "UNWIND [[1, 2], [2, 2], [], [null, 2], [1]] AS l RETURN l, all(x IN l WHERE x > 1) AS a, any(x IN l WHERE x > 1) AS b, none(x IN l WHERE x > 1) AS c, single(x IN l WHERE x > 1) AS d",
  "SELECT CAST(l AS BIGINT[]) AS l, a, b, c, d FROM (VALUES ([1, 2], false, true, false, true), ([2, 2], true, true, false, false), ([], true, false, true, false), ([NULL, 2], NULL, true, false, true), ([1], false, false, true, false)) t(l, a, b, c, d)")
q("list_comprehension", "MATCH (o:Order)-[r:CONTAINS]->(:Part) WHERE o.orderkey < 40 WITH o, r.quantity AS qty ORDER BY qty, r.price WITH o.orderkey AS k, collect(qty) AS qs RETURN k, [x IN qs WHERE x > 10 | x * 2] AS big, reduce(s = 0.0, x IN qs | s + x) AS total, size([x IN qs WHERE x <= 10]) AS small",
  "SELECT l_orderkey AS k, coalesce(list(l_quantity * 2 ORDER BY l_quantity) FILTER (l_quantity > 10), []) AS big, sum(l_quantity) AS total, CAST(count(*) FILTER (l_quantity <= 10) AS BIGINT) AS small FROM lineitem WHERE l_orderkey < 40 GROUP BY 1")
q("case_forms", "MATCH (p:Part) RETURN p.partkey AS k, CASE WHEN p.size > 40 THEN 'large' WHEN p.size > 10 THEN 'middle' ELSE 'small' END AS c, CASE p.brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 END AS b",
  "SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS c, CAST(CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 END AS BIGINT) AS b FROM part")
q("map_projection", "MATCH (n:Nation) WITH n{.name, .nationkey, twice: n.nationkey * 2} AS m RETURN m.name AS name, m['nationkey'] AS k, m.twice AS twice, {a: 1, b: 'x'} = {b: 'x', a: 1} AS same", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * 2 AS BIGINT) AS twice, true AS same FROM nation")
q("value_equality", "RETURN [1, null] = [1, 2] AS a, [1, null] = [2, null] AS b, [1] = [1, 2] AS c, 1 = 1.0 AS d, 'a' = 1 AS e, 'a' < 1 AS f, null = null AS g, [1, 2] < [1, 3] AS h, 1 <> null AS i, NOT null AS j, true XOR null AS k, false AND null AS l, true OR null AS m",
  "SELECT CAST(NULL AS BOOLEAN) AS a, false AS b, false AS c, true AS d, false AS e, CAST(NULL AS BOOLEAN) AS f, CAST(NULL AS BOOLEAN) AS g, true AS h, CAST(NULL AS BOOLEAN) AS i, CAST(NULL AS BOOLEAN) AS j, CAST(NULL AS BOOLEAN) AS k, false AS l, true AS m")
q("string_predicates", "MATCH (c:Customer) WHERE c.name ENDS WITH '7' AND c.name CONTAINS '00' AND c.mktsegment STARTS WITH 'B' RETURN c.name AS name, c.name STARTS WITH null AS n", "SELECT c_name AS name, CAST(NULL AS BOOLEAN) AS n FROM customer WHERE c_name LIKE '%7' AND c_name LIKE '%00%' AND c_mktsegment LIKE 'B%'")
q("temporal", "MATCH (o:Order) WHERE o.orderdate >= localdatetime('1995-01-01T00:00:00') AND o.orderdate < localdatetime('1995-01-01T00:00:00') + duration('P1M') RETURN o.orderkey AS k, date('2020-01-31') + duration('P1M') AS d, date('2020-01-01') < date('2020-01-02') AS lt, decimal('1.50') + decimal('2.25') = decimal('3.75') AS dec",
  "SELECT o_orderkey AS k, DATE '2020-02-29' AS d, true AS lt, true AS dec FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
q("literals", "RETURN 0x1F AS a, 1.5e3 AS b, 'a\\u0041\\n' AS c, 0o17 AS d, [1, 2.5] AS e, {x: [1], y: {z: true}}.y.z AS f // comment", "SELECT CAST(31 AS BIGINT) AS a, CAST(1500 AS DOUBLE) AS b, 'aA' || chr(10) AS c, CAST(15 AS BIGINT) AS d, CAST([1, 2.5] AS DOUBLE[]) AS e, true AS f")

# -- writes: the rows that a statement returns
q("create_node", "CREATE (a:Tag {name: 'x', n: 1}) RETURN a.name AS name, a.n AS n", "SELECT 'x' AS name, CAST(1 AS BIGINT) AS n")
q("create_path", "CREATE (a:Tag {n: 1})-[r:LINK {w: 2.5}]->(b:Tag {n: 2}) RETURN a.n AS a, b.n AS b, r.w AS w, type(r) AS t", "SELECT CAST(1 AS BIGINT) AS a, CAST(2 AS BIGINT) AS b, CAST(2.5 AS DOUBLE) AS w, 'LINK' AS t")
q("create_spine", "MATCH (n:Nation) CREATE (n)-[r:HAS]->(t:Tag {name: n.name}) RETURN n.nationkey AS k, t.name AS name", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
q("set_properties", "MATCH (s:Supplier) WHERE s.suppkey < 5 SET s.acctbal = 0.5, s += {rank: s.suppkey * 2} RETURN s.suppkey AS k, s.acctbal AS a, s.rank AS r", "SELECT s_suppkey AS k, CAST(0.5 AS DOUBLE) AS a, s_suppkey * 2 AS r FROM supplier WHERE s_suppkey < 5")
q("remove_property", "MATCH (r:Region) REMOVE r.name RETURN r.regionkey AS k, r.name AS name", "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS name FROM region")
q("set_label", "MATCH (r:Region {regionkey: 1}) SET r:Area RETURN labels(r) AS l, r.name AS name", "SELECT ['Area'] AS l, r_name AS name FROM region WHERE r_regionkey = 1")
q("merge_node", "UNWIND ['EUROPE', 'ATLANTIS', 'ATLANTIS'] AS x MERGE (r:Region {name: x}) ON CREATE SET r.made = true ON MATCH SET r.made = false RETURN r.name AS name, r.made AS made", "SELECT 'EUROPE' AS name, false AS made UNION ALL SELECT 'ATLANTIS', true UNION ALL SELECT 'ATLANTIS', true")
q("merge_relationship", "MATCH (a:Nation {nationkey: 1}), (r:Region) MERGE (a)-[x:IN_REGION]->(r) ON CREATE SET x.made = true RETURN r.name AS name, x.made AS made", "SELECT r_name AS name, CASE WHEN n_nationkey IS NULL THEN true END AS made FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey = 1")

# -- search conditions
q("match_text_condition", "MATCH (d:Document) WHERE d.text MATCH $words AND d.lang = 'en' RETURN d.doc_id AS id", "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])(license|software)([^\\p{L}\\p{N}]|$)')", words="license software")
q("procedures_labels", "CALL db.labels() YIELD label AS l WHERE l STARTS WITH 'S' OR l STARTS WITH 'N' RETURN l", "SELECT * FROM (VALUES ('Nation'), ('Supplier')) t(l)")
q("procedures_types", "CALL db.relationshipTypes()", "SELECT * FROM (VALUES ('IN_REGION'), ('IN_NATION'), ('PLACED'), ('CONTAINS'), ('SUPPLIED_BY'), ('SUPPLIES'), ('HANDOFF')) t(\"relationshipType\")")
q("procedures_keys", "CALL db.propertyKeys() YIELD propertyKey AS k WHERE k STARTS WITH 's' RETURN k", "SELECT * FROM (VALUES ('shipdate'), ('size'), ('source'), ('status'), ('suppkey')) t(k)")
q("procedures_meta", "CALL apoc.meta.data() YIELD label, property, type WHERE label = 'Nation' AND type <> 'RELATIONSHIP' RETURN property, type", "SELECT * FROM (VALUES ('nationkey', 'INTEGER'), ('name', 'STRING'), ('regionkey', 'INTEGER')) t(property, type)")
q("procedures_schema_nodes", "CALL apoc.schema.nodes() YIELD label RETURN count(*) AS n", "SELECT CAST(0 AS BIGINT) AS n")
q("procedures_visualization", "CALL db.schema.visualization() YIELD nodes, relationships RETURN size(nodes) AS n, size(relationships) AS r", "SELECT CAST(9 AS BIGINT) AS n, CAST(8 AS BIGINT) AS r")
q("procedures_components", "CALL dbms.components() YIELD edition RETURN edition", "SELECT 'community' AS edition")
q("show_databases", "SHOW DATABASES YIELD name RETURN name", "SELECT 'graph' AS name")
q("explain", "EXPLAIN MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(n) AS n")
q("profile", "PROFILE MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(n) AS n")


# -- the same queries without the bounds on ids: every row is compared
def whole(name: str, *bounds: str) -> None:
    text, sql, params = LANGUAGE[name]
    for bound in bounds:
        assert bound in text + sql, bound
        text, sql = text.replace(bound, ""), sql.replace(bound, "")
    q(f"{name}_whole", text, sql, **params)


whole("call_aggregate", " WHERE c.custkey < 50", " WHERE c_custkey < 50")
whole("call_top_per_row", " WHERE c.custkey < 50", " WHERE o_custkey < 50")
whole("unbounded", " WHERE c.custkey < 100", " WHERE c_custkey < 100")
whole("list_comprehension", " WHERE o.orderkey < 40", " WHERE l_orderkey < 40")
whole("set_properties", " WHERE s.suppkey < 5", " WHERE s_suppkey < 5")
whole("optional_both_bound", " WHERE s.suppkey < 3 AND p.partkey < 20", " WHERE s_suppkey < 3 AND p_partkey < 20")
whole("shortest_path", "b.user_id < 40 AND ", " WHERE v < 40")
