"""Queries of the nested-record and hierarchy operators, with their SQL."""

from pyspark.sql import functions as F

from ..operators import hierarchy, nested
from ..session import load


def _fut(spark, sf_dir):
    return load(spark, sf_dir, "functions_under_test")


def _graphs(spark, sf_dir):
    return load(spark, sf_dir, "call_graphs")


def p7_hierarchy(spark, sf_dir):
    out = hierarchy.map_hierarchy(_graphs(spark, sf_dir), "graph_no", "graph", "id2type")
    return out.withColumn("path", F.array_join("path", " > ")).withColumn("descendants", F.array_join("descendants", ","))


def p7_edge_hierarchy(spark, sf_dir):
    """The stored graphs as one edge table, each node named with its graph."""
    g = _graphs(spark, sf_dir).select("graph_no", F.explode("graph").alias("u", "vs")).select("graph_no", "u", F.explode("vs").alias("v")).where("v is not null")
    name = lambda c: F.concat_ws(":", F.col("graph_no").cast("string"), c)
    out = hierarchy.edge_hierarchy(g.select(name("u").alias("parent"), name("v").alias("child")))
    return out.withColumn("path", F.array_join("path", " > ")).withColumn("descendants", F.array_join("descendants", ","))


QUERIES = {
    "p7_edge_hierarchy": p7_edge_hierarchy,
    "p7_cycle_links": lambda s, d: hierarchy.map_cycle_links(_graphs(s, d), "graph_no", "graph"),
    "p3_found": lambda s, d: nested.errors(_fut(s, d)).select("fut_no", "round_no", "test_id", "error_no").distinct(),
    "p3_records": lambda s, d: nested.records(_fut(s, d)),
    "p3_rounds": lambda s, d: nested.rounds(_fut(s, d)),
    "p3_tests": lambda s, d: nested.tests(_fut(s, d)),
    "p3_messages": lambda s, d: nested.messages(_fut(s, d)),
    "p3_errors": lambda s, d: nested.errors(_fut(s, d)),
    "p3_test_logs": lambda s, d: nested.test_logs(_fut(s, d)),
    "p3_coverage": lambda s, d: nested.coverage(_fut(s, d)).drop("unexecuted_lines"),
    "p3_captured_calls": lambda s, d: nested.captured_calls(_fut(s, d)).select("fut_no", "round_no", "call_no", "func_name"),
    "p7_found": lambda s, d: hierarchy.map_cycle_nodes(_graphs(s, d), "graph_no", "graph"),
    "p7_hierarchy": p7_hierarchy,
}

_ROUNDS = """
WITH h AS (SELECT fut_no, test_history.history AS h FROM functions_under_test),
n AS (SELECT fut_no, h, unnest(range(len(h))) AS round_no FROM h),
r AS (SELECT DISTINCT fut_no, round_no, h[round_no + 1] AS r FROM n)"""

_STATS = _ROUNDS + """,
j0 AS (SELECT fut_no, round_no, CASE WHEN json_valid(r.exec_stats) THEN r.exec_stats END AS j FROM r),
j1 AS (SELECT fut_no, round_no, CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' ELSE j END AS j FROM j0),
j2 AS (SELECT fut_no, round_no, CASE WHEN json_valid(j) THEN j::JSON -> '$.{member}' END AS j FROM j1),
j3 AS (SELECT fut_no, round_no, CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' ELSE j::VARCHAR END AS j FROM j2),
j4 AS (SELECT fut_no, round_no, j FROM j3 WHERE json_valid(j) AND json_type(j) = '{kind}')"""

_KEYED = _STATS.replace("{kind}", "OBJECT") + """,
k AS (SELECT fut_no, round_no, unnest(map_entries(j::JSON::MAP(VARCHAR, JSON))) AS e FROM j4),
v AS (SELECT fut_no, round_no, e.key AS test_id, CASE WHEN json_type(e.value) = 'OBJECT' THEN [e.value] ELSE TRY_CAST(e.value AS JSON[]) END AS l FROM k),
o AS (SELECT fut_no, round_no, test_id, unnest(l) AS o, unnest(range(len(l))) AS n FROM v)"""

_LISTED = _STATS.replace("{kind}", "ARRAY") + """,
l AS (SELECT fut_no, round_no, j::JSON::JSON[] AS l FROM j4),
o AS (SELECT fut_no, round_no, unnest(l) AS o, unnest(range(len(l))) AS n FROM l)"""

_ERRORS = _KEYED.replace("{member}", "run_tests_errors")

_REACH = """
WITH RECURSIVE g AS (SELECT DISTINCT graph_no, graph FROM call_graphs),
e0 AS (SELECT graph_no, unnest(map_entries(graph)) AS e FROM g),
e AS (SELECT DISTINCT graph_no, u, v FROM (SELECT graph_no, e.key AS u, unnest(e.value) AS v FROM e0) WHERE v IS NOT NULL),
nodes AS (SELECT graph_no, u AS x FROM e UNION SELECT graph_no, v FROM e UNION SELECT graph_no, e.key FROM e0),
reach AS (SELECT graph_no, u, v FROM e UNION SELECT r.graph_no, r.u, e.v FROM reach r JOIN e ON e.graph_no = r.graph_no AND e.u = r.v)"""

_ROOTED = """,
entered AS (SELECT DISTINCT e.graph_no, e.v AS x FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.graph_no = e.graph_no AND r.u = e.v AND r.v = e.u)),
entered_cycle AS (SELECT DISTINCT r.graph_no, r.v AS x FROM entered n JOIN reach r ON r.graph_no = n.graph_no AND r.u = n.x JOIN reach b ON b.graph_no = r.graph_no AND b.u = r.v AND b.v = r.u),
open AS (SELECT * FROM nodes EXCEPT SELECT * FROM entered EXCEPT SELECT * FROM entered_cycle),
roots AS (SELECT o.graph_no, o.x FROM open o WHERE NOT EXISTS (SELECT 1 FROM reach a JOIN reach b ON b.graph_no = a.graph_no AND b.u = a.v AND b.v = a.u WHERE a.graph_no = o.graph_no AND a.u = o.x AND a.v < o.x)),
p AS (SELECT graph_no, x AS root, x AS node_id, [x] AS path FROM roots UNION ALL
 SELECT p.graph_no, p.root, e.v, list_append(p.path, e.v) FROM p JOIN e ON e.graph_no = p.graph_no AND e.u = p.node_id WHERE NOT list_contains(p.path, e.v)),
d AS (SELECT graph_no, u, string_agg(v, ',' ORDER BY v) AS descendants FROM reach GROUP BY graph_no, u),
c AS (SELECT graph_no, u FROM reach WHERE u = v)"""

_NAMED = _REACH.replace("SELECT DISTINCT graph_no, u, v FROM (SELECT graph_no, e.key AS u, unnest(e.value) AS v FROM e0)", "SELECT DISTINCT graph_no, graph_no || ':' || u AS u, graph_no || ':' || v AS v FROM (SELECT graph_no, e.key AS u, unnest(e.value) AS v FROM e0)").replace(" UNION SELECT graph_no, e.key FROM e0", "")

SQL = {
    "p7_edge_hierarchy": _NAMED + """,
b AS (SELECT graph_no, u, v FROM e UNION SELECT graph_no, v, u FROM e),
w AS (SELECT graph_no, x AS u, x AS v FROM nodes UNION SELECT w.graph_no, w.u, b.v FROM w JOIN b ON b.graph_no = w.graph_no AND b.u = w.v),
m AS (SELECT graph_no, u, min(v) AS component FROM w GROUP BY graph_no, u)""" + _ROOTED + """
SELECT m.component, p.root, p.node_id, len(p.path) - 1 AS depth, array_to_string(p.path, ' > ') AS path, c.u IS NOT NULL AS on_cycle, coalesce(d.descendants, '') AS descendants
FROM p JOIN m ON m.graph_no = p.graph_no AND m.u = p.node_id LEFT JOIN d ON d.graph_no = p.graph_no AND d.u = p.node_id LEFT JOIN c ON c.graph_no = p.graph_no AND c.u = p.node_id""",
    "p7_cycle_links": _REACH + """,
mutual AS (SELECT a.graph_no, a.u, min(least(a.u, a.v)) AS cycle FROM reach a JOIN reach b ON b.graph_no = a.graph_no AND b.u = a.v AND b.v = a.u GROUP BY a.graph_no, a.u)
SELECT DISTINCT e.graph_no, m.cycle, e.u AS parent, e.v AS child FROM e JOIN reach r ON r.graph_no = e.graph_no AND r.u = e.v AND r.v = e.u JOIN mutual m ON m.graph_no = e.graph_no AND m.u = e.u""",
    "p3_found": _ERRORS + " SELECT DISTINCT fut_no, round_no, test_id, n AS error_no FROM o WHERE json_type(o) = 'OBJECT'",
    "p3_records": """SELECT DISTINCT fut_no, unit_no, function_id.identifier AS function_id, file.file_module.module_id.identifier AS module_id, file.file_module.module_type AS module_type,
 file.file_module.repo.repo_org AS repo_org, file.file_module.repo.repo_name AS repo_name, file.file_module.repo.repo_id AS repo_id, file.file_module.repo.local_repo_path AS local_repo_path,
 coalesce(len(test_history.history), 0) AS n_rounds FROM functions_under_test""",
    "p3_rounds": _ROUNDS + " SELECT DISTINCT fut_no, round_no, r.operation AS operation, r.gen_model AS gen_model, r.gen_date AS gen_date, r.exec_stats AS exec_stats FROM r",
    "p3_tests": _ROUNDS + ", t AS (SELECT fut_no, round_no, unnest(map_entries(r.tests)) AS t FROM r) SELECT DISTINCT fut_no, round_no, t.key AS test_id, t.value AS code FROM t",
    "p3_messages": _ROUNDS + """, m AS (SELECT fut_no, round_no, unnest(r.chat_messages) AS m, unnest(range(len(r.chat_messages))) AS message_no FROM r)
 SELECT DISTINCT fut_no, round_no, message_no, m.role AS role, m.content AS content FROM m""",
    "p3_errors": _ERRORS + " SELECT DISTINCT fut_no, round_no, test_id, n AS error_no, o ->> '$.type' AS \"type\", o ->> '$.test' AS test, o ->> '$.message' AS message FROM o WHERE json_type(o) = 'OBJECT'",
    "p3_test_logs": _KEYED.replace("{member}", "run_tests_logs") + """ SELECT DISTINCT fut_no, round_no, test_id, (o -> '$.valid')::BOOLEAN AS valid, (o -> '$.passed_count')::BIGINT AS passed_count,
 (o -> '$.failed_count')::BIGINT AS failed_count, (o -> '$.errored_count')::BIGINT AS errored_count FROM o WHERE json_type(o) = 'OBJECT'""",
    "p3_coverage": _LISTED.replace("{member}", "coverage_logs") + """ SELECT DISTINCT fut_no, round_no, n AS coverage_no, (o -> '$.num_executable_lines')::BIGINT AS num_executable_lines, (o -> '$.num_unexecuted_lines')::BIGINT AS num_unexecuted_lines,
 (o -> '$.line_coverage_percentage')::DOUBLE AS line_coverage_percentage, (o -> '$.branch_coverage_percentage')::DOUBLE AS branch_coverage_percentage FROM o WHERE json_type(o) = 'OBJECT'""",
    "p3_captured_calls": _LISTED.replace("{member}", "captured_arg_logs") + " SELECT DISTINCT fut_no, round_no, n AS call_no, o ->> '$.func_name' AS func_name FROM o WHERE json_type(o) = 'OBJECT'",
    "p7_found": _REACH + " SELECT DISTINCT graph_no, u AS node_id FROM reach WHERE u = v",
    "p7_hierarchy": _REACH + _ROOTED + """,
t0 AS (SELECT DISTINCT graph_no, unnest(map_entries(id2type)) AS t FROM call_graphs)
SELECT p.graph_no, p.root, p.node_id, t0.t.value AS node_type, len(p.path) - 1 AS depth, array_to_string(p.path, ' > ') AS path, c.u IS NOT NULL AS on_cycle, coalesce(d.descendants, '') AS descendants
FROM p LEFT JOIN d ON d.graph_no = p.graph_no AND d.u = p.node_id LEFT JOIN c ON c.graph_no = p.graph_no AND c.u = p.node_id LEFT JOIN t0 ON t0.graph_no = p.graph_no AND t0.t.key = p.node_id""",
}
