"""Queries of the evaluation, history, feedback and completion operators, with their SQL."""

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import completions, evaluate, execution, feedback, nested
from ..session import load


def _fut(s, d):
    return load(s, d, "functions_under_test")


def history_latest(s, d):
    last = evaluate.latest(_fut(s, d))
    return last.select("fut_no", "round_no", "operation", "gen_model", "n_tests", F.date_format(ids.gen_time("gen_date"), "yyyy-MM-dd HH:mm:ss").alias("gen_time"))


def eval_units(s, d):
    return evaluate.scored(_fut(s, d)).select("fut_no", "runnable", "valid", "passed", "failed", "errored", F.round("pass_ratio", 6).alias("pass_ratio"), "all_failed", "all_errored", "executed_lines")


def eval_pass_ratio(s, d):
    return evaluate.summary(evaluate.scored(_fut(s, d)).withColumn("percent", F.col("pass_ratio") * 100), "percent")


def eval_coverage(s, d):
    return evaluate.summary(evaluate.scored(_fut(s, d)), "branch_coverage")


def eval_error_types(s, d):
    r = evaluate.rounds(_fut(s, d))
    return evaluate.error_types(r.select(F.explode(F.array("error", "output")).alias("text")).where("text is not null"), "text")


def history_errors(s, d):
    return evaluate.latest_errors(_fut(s, d), nested.errors(_fut(s, d)))


def history_passing(s, d):
    return evaluate.latest(_fut(s, d)).where("logs is not null").select("fut_no", evaluate.is_passing(F.col("logs")).alias("passing"))


def genexec_status(s, d):
    return feedback.classified(evaluate.rounds(_fut(s, d))).select("fut_no", "round_no", "status")


def genexec_progress(s, d):
    return feedback.progress(evaluate.rounds(_fut(s, d)))


def genexec_worklist(s, d):
    return feedback.worklist(evaluate.rounds(_fut(s, d)))


def oversample_snapshots(s, d):
    """Three rounds of further tests: each is the first test that the stored history has for the round."""
    codes = nested.tests(_fut(s, d)).where("code is not null").groupBy(F.col("fut_no").alias("unit_id"), "round_no").agg(F.min_by("code", "test_id").alias("code"))
    seeds = codes.where("round_no = 0").select("unit_id", F.create_map(F.lit("test_0"), F.col("code")).alias("tests"))
    out = feedback.oversample(seeds, lambda state, number: codes.where(F.col("round_no") == number).select("unit_id", "code"), 3)
    return out.select("unit_id", "round_no", F.size("tests").cast("long").alias("n_tests"), F.aggregate(F.map_values("tests"), F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"))


def _tasks(s, d):
    return load(s, d, "spec_tasks")


def code_blocks(s, d):
    return _tasks(s, d).select("task_no", ids.code_block("generated_test").alias("first_block"), ids.code_block("generated_test", last=True).alias("last_block")).distinct()


def chat_turns(s, d):
    return _tasks(s, d).select("task_no", F.posexplode("chat_messages").alias("turn", "m")).select("task_no", F.col("turn").cast("long").alias("turn"), "m.role", "m.content").distinct()


def chat_update(s, d):
    new = feedback.update_chat(F.col("chat_messages"), F.col("generated_test"), completions.feedback_text(F.lit("fix_error"), F.lit("f"), F.lit("KeyError")))
    t = _tasks(s, d).where("generated_test is not null").select("task_no", new.alias("m")).select("task_no", F.size("m").cast("long").alias("n_messages"), F.element_at("m", -2)["content"].alias("answer"), F.element_at("m", -1)["content"].alias("feedback"), F.element_at("m", -1)["role"].alias("last_role"))
    return t.distinct()


def cache_misses(s, d):
    """Prompts of model-b and model-c that model-a wasn't asked."""
    t = _tasks(s, d).where("chat_messages is not null").select(F.col("task_no").alias("unit_id"), "gen_model", "chat_messages").distinct()
    settings = completions.ModelSettings()
    cache = t.where("gen_model = 'model-a'").select(ids.prompt_key("chat_messages", settings.key()).alias("key"))
    return completions.misses(t.where("gen_model <> 'model-a'"), cache, settings).select("unit_id", "gen_model").distinct()


def captured_types(s, d):
    calls = nested.captured_calls(_fut(s, d))
    return completions.captured_types(calls)


def example_calls(s, d):
    return completions.example_calls(nested.captured_calls(_fut(s, d)))


def exec_payloads(s, d):
    f = _fut(s, d).select(F.col("file.file_module.repo.repo_id").alias("repo_id"), F.col("file.file_module.module_id.identifier").alias("module"), F.col("function_id.identifier").alias("unit_id"), F.try_element_at("test_history.history", F.lit(-1))["tests"].alias("tests"))
    f = f.where("repo_id is not null and module is not null and tests is not null").select("repo_id", ids.path_from_identifier("module").alias("path"), "unit_id", F.lit(None).cast("string").alias("function_name"), "tests")
    p = execution.payloads(f).withColumn("p", F.from_json("payload", "names array<string>, tests map<string,string>"))
    chars = F.aggregate(F.map_values("p.tests"), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))
    return p.select("repo_id", "path", F.array_join("p.names", ",").alias("names"), F.array_join(F.array_sort(F.map_keys("p.tests")), ",").alias("test_ids"), chars.alias("n_chars"))


def init_errors(s, d):
    return evaluate.rounds(_fut(s, d)).where(execution.worth_counting()).select("fut_no", "round_no", "error")


def coverage_marks(s, d):
    cov = nested.coverage(_fut(s, d)).where("unexecuted_lines is not null").groupBy("fut_no").agg(F.max_by("unexecuted_lines", F.struct("round_no", "coverage_no")).alias("unexecuted_lines"))
    code = load(s, d, "code_functions").where("function_code is not null").select("unit_no", F.col("function_code").alias("code")).distinct()
    f = _fut(s, d).select("fut_no", "unit_no").distinct().join(cov, "fut_no").join(code, "unit_no").select("fut_no", "code", F.lit(1).cast("long").alias("start_line"), "unexecuted_lines")
    return completions.annotated(f)


def branch_marks(s, d):
    """Lines 2 to 6 of each function, the first three lines of even number marked as branches not taken."""
    f = load(s, d, "code_functions").where("function_code is not null").select(F.col("unit_no").alias("fut_no"), F.col("function_code").alias("code")).distinct()
    f = f.select("*", F.lit(1).cast("long").alias("start_line"), F.array(*(F.lit(k).cast("long") for k in (2, 4, 6))).alias("branches"), F.lit(2).alias("first_line"), F.lit(6).alias("last_line"))
    return completions.annotated(f, "# not taken", "branches")


def eval_lines(s, d):
    return evaluate.scored(_fut(s, d)).where("executed_lines is not null").select("fut_no", "executed_lines", F.round("line_coverage", 6).alias("line_coverage"))


def tests_without_failures(s, d):
    return feedback.without_failures(nested.tests(_fut(s, d)), nested.errors(_fut(s, d)))


QUERIES = {
    "tests_without_failures": tests_without_failures, "eval_overall": lambda s, d: evaluate.report(_fut(s, d)), "eval_units": eval_units, "eval_pass_ratio": eval_pass_ratio, "eval_coverage": eval_coverage, "eval_error_types": eval_error_types,
    "history_latest": history_latest, "history_errors": history_errors, "history_passing": history_passing, "genexec_status": genexec_status, "genexec_progress": genexec_progress, "genexec_worklist": genexec_worklist,
    "oversample_snapshots": oversample_snapshots, "code_blocks": code_blocks, "chat_turns": chat_turns, "chat_update": chat_update, "cache_misses": cache_misses, "captured_types": captured_types, "example_calls": example_calls,
    "exec_payloads": exec_payloads, "init_errors": init_errors, "coverage_marks": coverage_marks, "branch_marks": branch_marks, "eval_labelled": lambda s, d: evaluate.labelled_report(_fut(s, d)), "eval_lines": eval_lines,
}

_ROUNDS = """
WITH h AS (SELECT DISTINCT fut_no, file.file_module.repo.repo_id AS repo_id, test_history.history AS h FROM functions_under_test),
n AS (SELECT fut_no, repo_id, h, unnest(range(len(h))) AS round_no FROM h),
r AS (SELECT DISTINCT fut_no, repo_id, round_no, h[round_no + 1] AS r FROM n),
r0 AS (SELECT *, CASE WHEN json_valid(r.exec_stats) THEN r.exec_stats END AS j0 FROM r),
r1 AS (SELECT *, CASE WHEN json_type(j0) = 'VARCHAR' THEN j0 ->> '$' ELSE j0 END AS j1 FROM r0),
r2 AS (SELECT *, CASE WHEN json_valid(j1) THEN j1::JSON END AS j FROM r1),
r3 AS (SELECT fut_no, repo_id, round_no, r, j IS NOT NULL AS has_stats, j ->> '$.error' AS error, j ->> '$.output' AS output, j -> '$.coverage_logs' AS cov,
 CASE WHEN json_type(j -> '$.run_tests_logs') = 'VARCHAR' THEN j ->> '$.run_tests_logs' ELSE (j -> '$.run_tests_logs')::VARCHAR END AS logs FROM r2),
rounds AS (SELECT fut_no, repo_id, round_no, r, has_stats, error, output, TRY_CAST(cov AS JSON[]) AS cov, map_values(TRY_CAST(logs::JSON AS MAP(VARCHAR, JSON))) AS logs FROM r3)"""

_STATUS = _ROUNDS + """,
p AS (SELECT *, CASE WHEN logs IS NOT NULL THEN coalesce(list_bool_and(list_transform(logs, lambda x: coalesce((x ->> '$.valid')::BOOLEAN, false))), true) END AS passing,
 (cov[-1] ->> '$.branch_coverage_percentage')::DOUBLE AS branch FROM rounds),
st AS (SELECT *, CASE WHEN NOT has_stats THEN NULL WHEN coalesce(passing, false) THEN CASE WHEN coalesce(branch / 100 < 0.8, false) THEN 'improve_coverage' ELSE 'good' END ELSE 'fix_error' END AS status FROM p)"""

_SCORED = _STATUS + """,
l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY fut_no ORDER BY round_no DESC) = 1),
k AS (SELECT *, logs IS NOT NULL AS runnable, coalesce(passing, false) AS valid, list_sum(list_transform(logs, lambda x: (x ->> '$.passed_count')::BIGINT))::BIGINT AS passed0,
 list_sum(list_transform(logs, lambda x: (x ->> '$.failed_count')::BIGINT))::BIGINT AS failed0, list_sum(list_transform(logs, lambda x: (x ->> '$.errored_count')::BIGINT))::BIGINT AS errored0 FROM l),
k2 AS (SELECT *, CASE WHEN runnable THEN coalesce(passed0, 0) END AS passed, CASE WHEN runnable THEN coalesce(failed0, 0) END AS failed, CASE WHEN runnable THEN coalesce(errored0, 0) END AS errored FROM k),
sc AS (SELECT *, CASE WHEN runnable THEN CASE WHEN passed + failed + errored = 0 THEN 0 ELSE passed::DOUBLE / (passed + failed + errored) END END AS pass_ratio,
 runnable AND passed + errored = 0 AS all_failed, runnable AND passed + failed = 0 AS all_errored, CASE WHEN valid THEN branch END AS branch_coverage, CASE WHEN valid THEN (cov[-1] ->> '$.line_coverage_percentage')::DOUBLE END AS line_coverage,
 CASE WHEN valid THEN (cov[-1] ->> '$.num_executable_lines')::BIGINT - coalesce((cov[-1] ->> '$.num_excluded_lines')::BIGINT, 0) - (cov[-1] ->> '$.num_unexecuted_lines')::BIGINT END AS executed_lines FROM k2)"""

_SUMMARY = "SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) FILTER (x > 80) AS above_80, count(*) FILTER (x > 90) AS above_90, count(*) FILTER (x = 100) AS at_100 FROM (SELECT {} AS x FROM sc)"

_TESTS = _ROUNDS + ", t0 AS (SELECT fut_no, round_no, unnest(map_entries(r.tests)) AS t FROM r), t AS (SELECT DISTINCT fut_no, round_no, t.key AS test_id, t.value AS code FROM t0)"

_CALLS = _ROUNDS + """,
c0 AS (SELECT fut_no, round_no, CASE WHEN json_type(j -> '$.captured_arg_logs') = 'VARCHAR' THEN TRY_CAST(j ->> '$.captured_arg_logs' AS JSON[]) ELSE TRY_CAST(j -> '$.captured_arg_logs' AS JSON[]) END AS l FROM r2),
c1 AS (SELECT DISTINCT fut_no, round_no, unnest(l) AS o, unnest(range(len(l))) AS call_no FROM c0),
c AS (SELECT * FROM c1 WHERE json_type(o) = 'OBJECT')"""

_TYPE = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'NULL' THEN 'VOID' ELSE json_type({0}) END"

_BLOCK = """CASE WHEN generated_test IS NULL THEN NULL WHEN len(f) < 2 THEN '' ELSE array_to_string(l[f[{a}] + 1 : f[{b}] - 1], chr(10)) END"""

SQL = {
    "eval_overall": _SCORED + """ SELECT count(*) AS total, count(DISTINCT fut_no) FILTER (runnable) AS runnable, count(DISTINCT fut_no) FILTER (valid) AS valid, count(DISTINCT repo_id) AS repos,
 count(DISTINCT repo_id) FILTER (runnable) AS repos_runnable, count(DISTINCT repo_id) FILTER (valid) AS repos_valid, round(avg(line_coverage), 6) AS line_coverage, round(avg(branch_coverage), 6) AS branch_coverage,
 round(avg(pass_ratio), 6) AS pass_ratio, count(*) FILTER (all_failed) AS all_failed, count(*) FILTER (all_errored) AS all_errored, count(*) - count(DISTINCT fut_no) FILTER (runnable) AS errored,
 round(100.0 * count(DISTINCT fut_no) FILTER (valid) / nullif(count(DISTINCT fut_no) FILTER (runnable), 0), 6) AS validity FROM sc""",
    "eval_units": _SCORED + " SELECT fut_no, runnable, valid, passed, failed, errored, round(pass_ratio, 6) AS pass_ratio, all_failed, all_errored, executed_lines FROM sc",
    "eval_pass_ratio": _SCORED + " " + _SUMMARY.format("100 * pass_ratio"),
    "eval_lines": _SCORED + " SELECT fut_no, executed_lines, round(line_coverage, 6) AS line_coverage FROM sc WHERE executed_lines IS NOT NULL",
    "eval_labelled": _SCORED + ", v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS label, {x}::DOUBLE AS x FROM sc" for n, x in (("line_coverage", "line_coverage"), ("branch_coverage", "branch_coverage"), ("pass_percent", "100 * pass_ratio"), ("executed_lines", "executed_lines"))) + ") "
    + " UNION ALL ".join(
        f"SELECT label, '{m}' AS measure, round(({a})::DOUBLE, 6) AS value FROM v WHERE {w} GROUP BY label"
        for m, a, w in [
            ("n", "count(x)", "true"), ("mean", "avg(x)", "true"), ("std", "stddev_pop(x)", "true"), ("above_80", "count(*) FILTER (x > 80)", "label <> 'executed_lines'"), ("above_90", "count(*) FILTER (x > 90)", "label <> 'executed_lines'"), ("at_100", "count(*) FILTER (x = 100)", "label <> 'executed_lines'"),
            ("at_1", "count(*) FILTER (x = 1)", "label = 'executed_lines'"), ("at_2", "count(*) FILTER (x = 2)", "label = 'executed_lines'"), ("above_5", "count(*) FILTER (x > 5)", "label = 'executed_lines'"), ("above_10", "count(*) FILTER (x > 10)", "label = 'executed_lines'"),
        ]
    ),
    "branch_marks": """WITH f AS (SELECT DISTINCT unit_no AS fut_no, string_split(function_code, chr(10)) AS l FROM code_functions WHERE function_code IS NOT NULL), g AS (SELECT fut_no, list_slice(l, 2, 6) AS l FROM f WHERE len(l) >= 2)
 SELECT fut_no, array_to_string(list_transform(l, lambda s, i: CASE WHEN i % 2 = 1 THEN regexp_extract(s, '^(\\s*)', 1) || '# not taken' || chr(10) || s ELSE s END), chr(10)) AS annotated FROM g""",
    "eval_coverage": _SCORED + " " + _SUMMARY.format("branch_coverage"),
    "eval_error_types": _ROUNDS + """, t AS (SELECT unnest([error, output]) AS t FROM rounds), l AS (SELECT unnest(string_split(t, chr(10))) AS l FROM t WHERE t IS NOT NULL),
 e AS (SELECT regexp_extract(l, '^(\\w+Error|Exception): (.+)', 1) AS error_type FROM l) SELECT error_type, count(*) AS n FROM e WHERE error_type <> '' GROUP BY 1""",
    "history_latest": _ROUNDS + """ SELECT fut_no, round_no, r.operation AS operation, r.gen_model AS gen_model, coalesce(cardinality(r.tests), 0)::BIGINT AS n_tests,
 strftime(try_strptime(r.gen_date, '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS gen_time FROM r QUALIFY row_number() OVER (PARTITION BY fut_no ORDER BY round_no DESC) = 1""",
    "history_errors": _ROUNDS + """, l AS (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY fut_no ORDER BY round_no DESC) = 1),
 e0 AS (SELECT fut_no, CASE WHEN json_type(j -> '$.run_tests_errors') = 'VARCHAR' THEN j ->> '$.run_tests_errors' ELSE (j -> '$.run_tests_errors')::VARCHAR END AS e FROM l),
 e1 AS (SELECT fut_no, unnest(map_entries(TRY_CAST(e::JSON AS MAP(VARCHAR, JSON)))) AS e FROM e0),
 e2 AS (SELECT fut_no, e.key AS test_id, CASE WHEN json_type(e.value) = 'OBJECT' THEN [e.value] ELSE TRY_CAST(e.value AS JSON[]) END AS l FROM e1),
 e3 AS (SELECT fut_no, test_id, unnest(l) AS o, unnest(range(len(l))) AS n FROM e2),
 e4 AS (SELECT fut_no, string_agg(coalesce(o ->> '$.type', '') || ': ' || coalesce(o ->> '$.test', '') || ':' || chr(10) || coalesce(o ->> '$.message', ''), chr(10) ORDER BY test_id, n) AS lines FROM e3 WHERE json_type(o) = 'OBJECT' GROUP BY fut_no)
 SELECT l.fut_no, coalesce(l.j ->> '$.error', e4.lines, '') AS message FROM l LEFT JOIN e4 ON e4.fut_no = l.fut_no""",
    "history_passing": _STATUS + " SELECT fut_no, passing FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY fut_no ORDER BY round_no DESC) = 1) WHERE logs IS NOT NULL",
    "genexec_status": _STATUS + " SELECT fut_no, round_no, status FROM st",
    "genexec_progress": _STATUS + """, c AS (SELECT * FROM st WHERE status IS NOT NULL), f AS (SELECT fut_no, min(round_no) FILTER (status = 'good') AS good_at FROM c GROUP BY 1),
 pr AS (SELECT round_no, count(DISTINCT fut_no) AS n_units, count(DISTINCT fut_no) FILTER (status = 'good') AS n_good FROM c GROUP BY 1)
 SELECT pr.round_no, n_units, n_good, round(n_good::DOUBLE / n_units, 6) AS good_ratio, round((SELECT count(*) FROM f WHERE good_at <= pr.round_no)::DOUBLE / (SELECT count(*) FROM f), 6) AS good_so_far FROM pr""",
    "genexec_worklist": _STATUS + ", c AS (SELECT * FROM st WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fut_no ORDER BY round_no DESC) = 1) SELECT fut_no, round_no, status FROM c WHERE status <> 'good'",
    "oversample_snapshots": _TESTS + """, f AS (SELECT fut_no AS unit_id, round_no, arg_min(code, test_id) AS code FROM t WHERE code IS NOT NULL GROUP BY 1, 2), k AS (SELECT unnest(range(0, 4)) AS round_no)
 SELECT z.unit_id, k.round_no, count(*) AS n_tests, sum(length(f.code))::BIGINT AS n_chars FROM f z CROSS JOIN k JOIN f ON f.unit_id = z.unit_id AND f.round_no <= k.round_no WHERE z.round_no = 0 GROUP BY 1, 2""",
    "code_blocks": "WITH a AS (SELECT DISTINCT task_no, generated_test, string_split(generated_test, chr(10)) AS l FROM spec_tasks), b AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: contains(l[i], '```')) AS f FROM a) SELECT task_no, "
    + _BLOCK.format(a=1, b=2) + " AS first_block, " + _BLOCK.format(a=-2, b=-1) + " AS last_block FROM b",
    "chat_turns": "WITH a AS (SELECT task_no, unnest(chat_messages) AS m, unnest(range(len(chat_messages))) AS turn FROM spec_tasks) SELECT DISTINCT task_no, turn, m.role AS role, m.content AS content FROM a",
    "chat_update": """SELECT DISTINCT task_no, (coalesce(len(chat_messages), 0) - CASE WHEN chat_messages[-1].role = 'assistant' THEN 1 ELSE 0 END + 2)::BIGINT AS n_messages, generated_test AS answer,
 'The last test failed:' || chr(10) || 'KeyError' || chr(10) || 'Please correct the test of `f`.' AS feedback, 'user' AS last_role FROM spec_tasks WHERE generated_test IS NOT NULL""",
    "cache_misses": """WITH t AS (SELECT DISTINCT task_no AS unit_id, gen_model, chat_messages::VARCHAR AS chat FROM spec_tasks WHERE chat_messages IS NOT NULL)
 SELECT DISTINCT unit_id, gen_model FROM t WHERE gen_model <> 'model-a' AND chat NOT IN (SELECT chat FROM t WHERE gen_model = 'model-a')""",
    "exec_payloads": """WITH f AS (SELECT DISTINCT file.file_module.repo.repo_id AS repo_id, replace(file.file_module.module_id.identifier, '.', '/') || '.py' AS path, function_id.identifier AS unit_id, test_history.history[-1].tests AS tests FROM functions_under_test),
 t AS (SELECT repo_id, path, unit_id, unnest(map_entries(tests)) AS e FROM f WHERE repo_id IS NOT NULL AND path IS NOT NULL), g AS (SELECT repo_id, path, e.key AS test_id, arg_min(coalesce(length(e.value), 0), coalesce(unit_id, '~')) AS n FROM t GROUP BY 1, 2, 3),
 n AS (SELECT repo_id, path, string_agg(DISTINCT string_split(unit_id, '.')[-1], ',' ORDER BY string_split(unit_id, '.')[-1]) AS names FROM t GROUP BY 1, 2), s AS (SELECT repo_id, path, string_agg(test_id, ',' ORDER BY test_id) AS test_ids, sum(n)::BIGINT AS n_chars FROM g GROUP BY 1, 2)
 SELECT s.repo_id, s.path, coalesce(n.names, '') AS names, s.test_ids, s.n_chars FROM s JOIN n ON n.repo_id = s.repo_id AND n.path = s.path""",
    "example_calls": _CALLS + """, v AS (SELECT fut_no, round_no, call_no, map_entries(TRY_CAST(o -> '$.inputs' AS MAP(VARCHAR, JSON))) AS es, o -> '$.output' AS out FROM c),
 w AS (SELECT *, array_to_string(list_transform(list_sort(es), lambda e: e.key || '=' || CASE json_type(e.value) WHEN 'VARCHAR' THEN e.value ->> '$' WHEN 'NULL' THEN 'null' ELSE e.value::VARCHAR END), chr(10)) AS lines FROM v)
 SELECT fut_no, arg_min(coalesce(lines, '') || chr(10) || 'output=' || CASE WHEN out IS NULL OR json_type(out) = 'NULL' THEN 'null' WHEN json_type(out) = 'VARCHAR' THEN out ->> '$' ELSE out::VARCHAR END, md5('0:' || fut_no || ':' || round_no || ':' || call_no)) AS example FROM w GROUP BY 1""",
    "captured_types": _CALLS + ", a0 AS (SELECT fut_no, unnest(map_entries(TRY_CAST(o -> '$.inputs' AS MAP(VARCHAR, JSON)))) AS e FROM c), a1 AS (SELECT DISTINCT fut_no, e.key AS arg, " + _TYPE.format("e.value") + " AS t FROM a0), "
    + "a2 AS (SELECT fut_no, arg, string_agg(t, ', ' ORDER BY t) AS types FROM a1 GROUP BY 1, 2), a AS (SELECT fut_no, string_agg(arg || ': ' || types, '; ' ORDER BY arg) AS argument_types FROM a2 GROUP BY 1), "
    + "o1 AS (SELECT DISTINCT fut_no, " + _TYPE.format("o -> '$.output'") + " AS t FROM c), o2 AS (SELECT fut_no, string_agg(coalesce(t, 'VOID'), ', ' ORDER BY t) AS output_types FROM o1 GROUP BY 1) "
    + "SELECT o2.fut_no, argument_types, output_types FROM o2 LEFT JOIN a ON a.fut_no = o2.fut_no",
    "init_errors": _ROUNDS + " SELECT fut_no, round_no, error FROM rounds WHERE error IS NOT NULL AND NOT contains(error, 'SyntaxWarning: invalid escape sequence') AND NOT contains(error, 'NameError: ')",
    "coverage_marks": _ROUNDS + """, v0 AS (SELECT fut_no, round_no, unnest(cov) AS o, unnest(range(len(cov))) AS n FROM rounds), v AS (SELECT fut_no, TRY_CAST(o -> '$.unexecuted_lines' AS BIGINT[]) AS u FROM v0 WHERE json_type(o -> '$.unexecuted_lines') = 'ARRAY'
 QUALIFY row_number() OVER (PARTITION BY fut_no ORDER BY round_no DESC, n DESC) = 1), k AS (SELECT DISTINCT unit_no, function_code AS code FROM code_functions WHERE function_code IS NOT NULL),
 f AS (SELECT DISTINCT fut_no, unit_no FROM functions_under_test), x AS (SELECT f.fut_no, v.u, string_split(k.code, chr(10)) AS l FROM f JOIN v ON v.fut_no = f.fut_no JOIN k ON k.unit_no = f.unit_no)
 SELECT fut_no, array_to_string(list_transform(l, lambda s, i: CASE WHEN list_contains(u, i) THEN regexp_extract(s, '^(\\s*)', 1) || '# not reached' || chr(10) || s ELSE s END), chr(10)) AS annotated FROM x""",
}
