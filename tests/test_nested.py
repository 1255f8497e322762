import json
import random

from codequarry.operators import nested as N

TESTS = "struct<tests:map<string,string>,operation:string,gen_model:string,gen_date:string,exec_stats:string,chat_messages:array<struct<role:string,content:string>>>"
FILE = "struct<file_module:struct<module_id:struct<identifier:string>,module_type:string,repo:struct<repo_org:string,repo_name:string,repo_id:string,local_repo_path:string>>>"
SCHEMA = f"fut_no long, unit_no long, function_id struct<identifier:string>, file {FILE}, test_history struct<history:array<{TESTS}>>, pos string, t string"


def frame(spark, stats, histories=()):
    rows = [(k, 1, None, None, ([(None, "generate", None, None, s, None) for s in ss],), "p", "t") for k, ss in enumerate(stats)]
    return spark.createDataFrame(rows + [(100 + k, None, None, None, h, None, None) for k, h in enumerate(histories)], SCHEMA)


def brute_errors(stats):
    out = set()
    for k, ss in enumerate(stats):
        for n, s in enumerate(ss):
            try:
                v = json.loads(s)
                while isinstance(v, str):
                    v = json.loads(v)
                e = v.get("run_tests_errors") if isinstance(v, dict) else None
                while isinstance(e, str):
                    e = json.loads(e)
            except (TypeError, ValueError):
                continue
            for test, items in (e or {}).items() if isinstance(e, dict) else ():
                while isinstance(items, str):
                    try:
                        items = json.loads(items)
                    except ValueError:
                        items = None
                for i, o in enumerate([items] if isinstance(items, dict) else items or [] if isinstance(items, list) else []):
                    if isinstance(o, dict):
                        out.add((k, n, test, i, o.get("message")))
    return out


def test_errors_against_json(spark):
    rng = random.Random(5)
    texts = ['a "quoted" {brace', "back\\slash\\", "tab\t", "", "ü🚀", "[1, 2", 'x\\"']

    def value(depth):
        return rng.choice([lambda: rng.choice(texts), lambda: rng.randint(0, 9), lambda: None, lambda: True, lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))] if depth else 1, lambda: {rng.choice(texts): value(depth - 1) for _ in range(2)} if depth else 2])()

    def one():
        errors = {rng.choice(texts): rng.choice([[{"type": "FAIL", "message": rng.choice(texts)}, value(2), {"message": "m"}], {"message": "lone"}, None, [], json.dumps([{"message": "inner"}])]) for _ in range(rng.randint(0, 3))}
        top = {"x": value(3), "run_tests_errors": rng.choice([errors, json.dumps(errors), None]), "y": value(3)}
        text = json.dumps(top, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        return rng.choice([text, text, json.dumps(text), text[: rng.randint(0, len(text))], None, "[]", "5", '"plain"'])

    stats = [[one() for _ in range(rng.randint(0, 3))] for _ in range(150)]
    got = {(r.fut_no, r.round_no, r.test_id, r.error_no, r.message) for r in N.errors(frame(spark, stats, [None, (None,), ([None],)])).collect()}
    want = brute_errors(stats)
    assert {x[:4] for x in got} == {x[:4] for x in want}
    assert {x for x in got if isinstance(x[4], str)} >= {x for x in want if isinstance(x[4], str)}


def is_json(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_grammar_against_json():
    rng = random.Random(3)

    def value(depth):
        return rng.choice([lambda: rng.choice(["a", '"q"', "\\", "\t", "ü🚀", "{", "[1", 'x\\"', ",", ":"]), lambda: rng.randint(-9, 9), rng.random, lambda: None, lambda: True, lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))] if depth else 1, lambda: {rng.choice('abc"'): value(depth - 1) for _ in range(2)} if depth else 2])()

    texts = ["", " ", "[,]", '{"a":1,}', '{"a"}', "1 2", '"a" "b"', "}", "[}", '"', "\\", "01", "-", "1.", "NaN", "{[]:1}", '{"a":1:2}', "tru", '"\\u12g4"', '"\\x"', "1,2", ":", '[":"]', '1"a"', "{}{}", "truefalse", "[1,2],3", '"a":1', "[[]", "\x00"]
    for _ in range(4000):
        t = json.dumps(value(4), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        for _ in range(rng.randint(0, 2)):
            i = rng.randint(0, len(t))
            t = rng.choice([t[:i], t[:i] + rng.choice('{}[],:"\\ \n1eE.-+tNIu0\x01') + t[i:], t[:i] + t[i + 1 :]])
        texts.append(t)
    for size in (1, 50, len(texts)):
        for k in range(0, len(texts) if size > 1 else 500, size):
            part = [t.encode() for t in texts[k : k + size]]
            assert N.StructuralIndex(part).valid.tolist() == [is_json(t) for t in part]


def test_depth_loses_nothing(spark):
    deep = "[" * 60_000 + "]" * 60_000
    texts = ['{"run_tests_errors": {"t": [{"message": ' + deep + ', "type": "T"}, {"message": "m"}]}}', '{"x": ' + deep + ', "run_tests_errors": {"t": {"message": "n"}}}', '{"run_tests_errors": {"t": {"message": ' + deep[:-1] + "}}}"]
    got = {(r.round_no, r.error_no, r.type, r.message) for r in N.errors(frame(spark, [texts])).collect()}
    assert got == {(0, 0, "T", deep), (0, 1, None, "m"), (1, 0, None, "n")}
    assert list(N.chunks(["a" * 5, None, "b" * 6, "c" * 30, "d"], 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_levels_keep_keys(spark):
    log = json.dumps({
        "run_tests_logs": json.dumps({"t0": {"valid": True, "passed_count": 2}}), "coverage_logs": [{"num_executable_lines": 3, "line_coverage_percentage": 50, "unexecuted_lines": [1, None, 2]}, None],
        "captured_arg_logs": [{"func_name": "f", "inputs": {"a": [1]}, "output": None}],
    })
    df = frame(spark, [[log, log], []], [([("t",)] and None)])
    assert [(r.fut_no, r.round_no, r.test_id, r.valid, r.passed_count, r.failed_count) for r in N.test_logs(df).orderBy("round_no").collect()] == [(0, 0, "t0", True, 2, None), (0, 1, "t0", True, 2, None)]
    cov = N.coverage(df).orderBy("round_no").first()
    assert (cov.coverage_no, cov.num_executable_lines, cov.line_coverage_percentage, cov.unexecuted_lines) == (0, 3, 50.0, [1, 2])
    call = N.captured_calls(df).first()
    assert (call.func_name, call.inputs, call.output) == ("f", '{"a": [1]}', None)
    assert {(r.fut_no, r.n_rounds) for r in N.records(df).collect()} == {(0, 2), (1, 0), (100, 0)}
    for level in (N.records, N.rounds, N.tests, N.messages, N.errors, N.test_logs, N.coverage, N.captured_calls):
        assert level(df.limit(0)).count() == 0


def test_repeated_rows_count_once_and_long_texts(spark):
    big = json.dumps({"output": "x" * 2_000_000, "run_tests_errors": {"t": {"message": "m" * 100_000}}})
    df = frame(spark, [[big]])
    got = N.errors(df.union(df)).collect()
    assert len(got) == 1 and len(got[0].message) == 100_000
