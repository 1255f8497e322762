import json

from pyspark.sql import functions as F

from codequarry import pipeline
from codequarry.operators import completions, extract
from codequarry.sources import tables
from codequarry.streaming import exec_logs


def test_repo_tree(spark, tmp_path):
    for path, text in {"o___a/x.py": "a = 1\n", "o___a/p/y.py": "é", "o___a/.git/z.py": "", "b/x.txt": "no"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = {(r.repo_id, r.rel_path, r.file_content) for r in pipeline.setup(spark, str(tmp_path)).collect()}
    assert {(a, b, c) for a, b, c in got} == {("o___a", "x.py", "a = 1\n"), ("o___a", "p/y.py", "é")}


def test_units_json(spark, tmp_path):
    repo = {"repo_org": "o", "repo_name": "n", "repo_id": "o___n", "local_repo_path": None}
    rows = [{"function_id": {"identifier": "m.f"}, "function_code": "def f(): pass", "file": {"file_module": {"module_id": {"identifier": "m"}, "module_type": "file", "repo": repo}}, "extra": 1}, {"method_id": {"identifier": "m.A.g"}}]
    (tmp_path / "u.json").write_text(json.dumps(rows, indent=4))
    got = tables.read_units(spark, str(tmp_path / "u.json"), compat=True)
    assert {(r.unit_kind, r.unit_id) for r in got.collect()} == {("function", "m.f"), ("method", "m.A.g")}
    assert got.where("unit_kind = 'function'").first().file.file_module.repo.repo_name == "o___n"
    tables.write_units(got, str(tmp_path / "out"))
    tables.write_units(got.limit(0), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.json").write_text("[{}]")
    try:
        tables.read_units(spark, str(tmp_path / "bad.json")).collect()
        raise AssertionError("a row of neither kind must fail")
    except Exception as e:
        assert "neither function nor method" in str(e)
    assert json.loads(tables.as_json_array(spark.range(2)).first().text) == [{"id": 0}, {"id": 1}]


def test_large_tables_make_no_array(spark):
    import pytest

    with pytest.raises(ValueError):
        tables.as_json_array(spark.range(100), limit=10)


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    units = spark.createDataFrame([(f"u{k}",) for k in range(20)], "unit_id string")
    asked = []

    def run(part):
        asked.append(part.count())
        if len(asked) == 3:
            raise RuntimeError("stopped")
        return part.withColumn("n", F.length("unit_id"))

    try:
        tables.in_batches(units, str(tmp_path / "b"), run, 4)
        raise AssertionError("the third batch fails")
    except RuntimeError:
        pass
    got = tables.in_batches(units, str(tmp_path / "b"), run, 4)
    assert len(asked) == 5 and got.count() == 20 and got.columns == ["unit_id", "n"] and sum(asked) - asked[2] == 20


def test_replayed_and_checked_code(spark):
    class Runner:
        def run(self, unit, tests):
            return {"run_tests_logs": {k: {"valid": unit["code"] == "good"} for k in tests}}

    made = spark.createDataFrame([("a", "good", {"t": "x"}), ("b", "bad", {"t": "x"})], "unit_id string, code string, tests map<string,string>")
    assert {r.unit_id: r.valid for r in pipeline.check(made, Runner()).collect()} == {"a": True, "b": False}
    logs = spark.createDataFrame([("a", True, True, 90.0, None)], "unit_id string, has_stats boolean, passing boolean, coverage double, error string")
    assert {r.unit_id: (r.has_stats, r.passing) for r in pipeline.replay(made, logs).collect()} == {"a": (True, True), "b": (False, None)}


def test_repositories_and_recipe(spark):
    urls = spark.createDataFrame([("https://h/u/r.git",), ("https://h/u/r/",), (None,)], "url string")
    assert [(r.repo_id, r.repo_org, r.repo_name) for r in tables.repos_from_urls(urls).collect()] == [("u___r", "u", "r")]
    assert tables.repos_from_paths(spark.createDataFrame([("/x/y/",)], "path string")).first().repo_id == "LOCAL___y"
    text = pipeline.build(25, spark).first().recipe
    assert text.count("RUN") == 3 and text.endswith("--start 20 --end 25") and pipeline.build(0, spark).first().recipe.count("RUN") == 0


def test_generate(spark):
    files = spark.createDataFrame([(1, "r", "a.py", "def run(a):\n    '''Adds.'''\n    b = a\n    c = b\n    return c\n")], "file_no long, repo_id string, rel_path string, file_content string")
    units = extract.extract_units(files)
    r = pipeline.generate(files, units, completions.StubProvider()).first()
    assert r.status == "ok" and r.tests["test_0"].startswith("# Write") and [m.role for m in r.chat_messages] == ["system", "user", "user"]
    assert pipeline.generate(files, units, completions.StubProvider(), function="none").count() == 0
    assert pipeline.list_units(units).first().unit_id == "a.run"


def test_stream_keeps_the_latest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, *rows):
        (src / name).write_text("\n".join(json.dumps(dict(zip(("unit_id", "round_no", "ts", "passing", "coverage", "error"), r))) for r in rows))

    put("1.json", ("a", 0, "2024-01-01T00:00:00", False, 1.0, None), ("b", 2, "2024-01-01T00:00:00", True, 2.0, None))
    run = lambda: exec_logs.keep_latest(exec_logs.read_logs(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    put("2.json", ("a", 1, "2024-01-01T00:10:00", True, 9.0, None), ("b", 1, "2024-01-01T00:20:00", False, 3.0, None))
    run()
    got = {r.unit_id: (r.round_no, r.passing) for r in spark.read.parquet(str(tmp_path / "t" / "version=1")).collect()}
    assert got == {"a": (1, True), "b": (2, True)}
    q = exec_logs.pass_rates(exec_logs.first_reports(exec_logs.read_logs(spark, str(src))), late=None).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # the last window is still open, earlier ones have come out
    assert (spark.table("rates").agg(F.sum("n_rounds")).first()[0] or 0) <= 4
