"""The verbs: set up, build, extract, generate, execute, generate-execute, specs, list and show.

Each verb is a function from tables to tables; `python -m codequarry.pipeline VERB` reads
and writes them as Parquet folders.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identifiers import last_segment
from .operators import callgraph, completions, context, evaluate, execution, extract, feedback, imports, nested
from .session import cut_lineage, ship
from .sources import tables


def setup(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """The files table of checked-out repositories below root; cloning is outside the engine."""
    return tables.with_file_no(tables.repo_tree(spark, root, glob))


def build_graphs(files: DataFrame) -> DataFrame:
    """repo_id, caller, callee, resolved of each repository's files, by name resolution."""
    return imports.file_calls(files)


def build(n_repos: int, spark: SparkSession, batch: int = 10) -> DataFrame:
    """One row with the text of an image recipe."""
    return spark.range(1).select(tables.image_recipe(n_repos, batch).alias("recipe"))


def extract_units(files: DataFrame, graphs: DataFrame | None = None, filters: extract.Filters = extract.Filters()) -> DataFrame:
    return extract.extract_units(files, graphs, filters)


def qualified(df: DataFrame) -> DataFrame:
    """df with unit_id led by its repository, as ids repeat in other repositories."""
    return df.withColumn("unit_id", F.concat_ws(":", F.when(F.col("repo_id") != "", F.col("repo_id")), "unit_id"))


def generate(files: DataFrame, units: DataFrame, provider: completions.CompletionProvider, kind: str = "sliced", budget: int = 6000, settings: completions.ModelSettings = completions.ModelSettings(), cache: DataFrame | None = None, function: str | None = None) -> DataFrame:
    """unit_id (repository:id), tests, chat_messages, status, error of a first test for each unit;
    failures are rows."""
    if function is not None:
        units = units.where(F.col("name") == function)
    units = units.dropDuplicates(["repo_id", "unit_id"])
    prompts = completions.test_prompts(qualified(units), qualified(context.contexts(files, units, kind, budget)))
    done = completions.completed(prompts, provider, settings, cache)
    tests = completions.tests_of(done)
    return prompts.join(done.select("unit_id", "status", "error"), "unit_id", "left").join(tests, "unit_id", "left")


def execute(units_with_tests: DataFrame, provider: execution.ExecutionProvider) -> DataFrame:
    return execution.executed(units_with_tests, provider)


def generate_execute(files: DataFrame, units: DataFrame, provider: completions.CompletionProvider, runner: execution.ExecutionProvider, rounds: int = feedback.ROUNDS, min_coverage: float = feedback.MIN_COVERAGE, min_valid: float = feedback.MIN_VALID, kind: str = "naive", budget: int = 6000, settings: completions.ModelSettings = completions.ModelSettings()) -> DataFrame:
    """Final state of every unit after the loop, with its chat: each round's prompt is the last
    one, the test that was given, and the feedback on it."""
    units = units.dropDuplicates(["repo_id", "unit_id"]).select("unit_id", "file_no", "repo_id", "rel_path", "module_id", "class_id", "name", "code")
    named = qualified(units)
    base = cut_lineage(completions.test_prompts(named, qualified(context.contexts(files, units, kind, budget))).join(named.select("unit_id", "name"), "unit_id"))

    def make(todo: DataFrame, number: int) -> DataFrame:
        # the last answer, by its test: the only value of last_tests
        answer = F.concat(F.lit("```python\n"), F.array_join(F.map_values("last_tests"), "\n"), F.lit("\n```"))
        again = feedback.update_chat(F.col("last_chat"), answer, completions.feedback_text(F.col("last_status"), F.col("name"), F.col("last_error")))
        prompts = todo.select("unit_id", F.when(F.col("last_status").isNotNull(), again).otherwise(F.col("last_chat")).alias("chat_messages"))
        tests = completions.tests_of(completions.completed(prompts, provider, settings), f"test_{number}")
        return tests.join(prompts, "unit_id")

    return feedback.loop(base, make, lambda u: execution.executed(u, runner), rounds, min_valid, min_coverage)


def specs(files: DataFrame, units: DataFrame, futs: DataFrame, provider: completions.CompletionProvider, settings: completions.ModelSettings = completions.ModelSettings(), cache: DataFrame | None = None) -> DataFrame:
    """unit_id (repository:id), name, code, spec: each unit with a description by the provider, asked for with the
    argument types and an example call that were captured when its tests ran; null where the
    provider gave none."""
    units = units.dropDuplicates(["repo_id", "unit_id"]).select("repo_id", "unit_id", "name", "code")
    calls = nested.captured_calls(futs)
    of_unit = qualified(futs.select("fut_no", F.col("file.file_module.repo.repo_id").alias("repo_id"), F.col("function_id.identifier").alias("unit_id"))).select("fut_no", "unit_id").distinct()
    types = completions.captured_types(calls).join(of_unit, "fut_no").groupBy("unit_id").agg(F.min_by("argument_types", "fut_no").alias("argument_types"), F.min_by("output_types", "fut_no").alias("output_types"))
    examples = completions.example_calls(calls).join(of_unit, "fut_no").groupBy("unit_id").agg(F.min_by("example", "fut_no").alias("example"))
    units = qualified(units).drop("repo_id")
    done = completions.completed(completions.spec_prompts(units, types, examples), provider, settings, cache)
    return completions.problems(units, completions.specs_of(done))


def replay(units_with_tests: DataFrame, logs: DataFrame) -> DataFrame:
    """execute from stored logs (unit_id, has_stats, passing, coverage, error): nothing runs."""
    return execution.replayed(units_with_tests, logs)


def check(candidates: DataFrame, runner: execution.ExecutionProvider) -> DataFrame:
    """unit_id, valid, error: whether code (candidates: unit_id, code, tests) passes its unit's tests."""
    return execution.equivalent(candidates, lambda c: execution.executed(c, runner))


def list_units(units: DataFrame, limit: int = 10, detailed: bool = False) -> DataFrame:
    """The first units by id; detailed adds file, lines and docstring."""
    cols = ["unit_id", "unit_kind", "name", *(["rel_path", "n_code_lines", "docstring"] if detailed else [])]
    return units.select(*cols).orderBy("unit_id").limit(limit)


def show(futs: DataFrame, what: str = "summary", unit: str | None = None, units: DataFrame | None = None) -> DataFrame:
    """summary: the report; code, test, result or chat of the units with an id (or last segment);
    code comes from the units table."""
    if what == "summary":
        return evaluate.report(futs)
    last = F.try_element_at("test_history.history", F.lit(-1))
    mine = futs.where((F.col("function_id.identifier") == unit) | (last_segment("function_id.identifier") == unit)) if unit is not None else futs
    if what == "code":
        if units is None:
            raise ValueError("show code needs the units table (unit_id, code)")
        ids = mine.select("fut_no", F.col("function_id.identifier").alias("unit_id")).distinct()
        return ids.join(units.select("unit_id", "code").dropDuplicates(["unit_id"]), "unit_id", "left").select("fut_no", "unit_id", "code").orderBy("unit_id", "fut_no")
    pick = {"test": last["tests"], "result": last["exec_stats"], "chat": last["chat_messages"]}[what]
    return mine.select("fut_no", F.col("function_id.identifier").alias("unit_id"), pick.alias(what)).orderBy("unit_id", "fut_no")


def errors(futs: DataFrame) -> DataFrame:
    return evaluate.latest_errors(futs, nested.errors(futs))


#: Groups of filters that extract can leave out, as --no-GROUP.
FILTER_GROUPS = ("dunder", "docstring", "arguments", "returns", "docstring_words", "body_tokens", "names", "decorators", "size", "lines")
VERBS = ("setup", "graphs", "build", "extract", "generate", "execute", "generate-execute", "specs", "list", "show", "rewrite-graph", "rewrite-imports")


def load_provider(name: str):
    """"stub", or MODULE:NAME of a class that can be called without arguments."""
    import importlib

    if name == "stub":
        return completions.StubProvider()
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codequarry")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("source", help="folder of repositories, number of repositories (build), or a Parquet table: files, units (list), tests (execute), histories (show)")
    p.add_argument("target", nargs="?", help="Parquet folder to write; without it the rows are shown")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--overwrite", action="store_true")
    g = p.add_argument_group("extraction")
    g.add_argument("--disable-all-filters", action="store_true")
    for name in FILTER_GROUPS:
        g.add_argument(f"--no-{name.replace('_', '-')}", action="store_true")
    g.add_argument("--graphs", help="table of call graphs (repo_id, graph)")
    g = p.add_argument_group("completions")
    g.add_argument("--units", help="table of extracted units")
    g.add_argument("--histories", help="table of test histories, for specs")
    g.add_argument("--function", help="only units of this name")
    g.add_argument("--provider", default="stub", help="stub or MODULE:CLASS of a completion provider")
    g.add_argument("--context", default="sliced", choices=("naive", "full", "sliced"))
    g.add_argument("--max-context", type=int, default=6000)
    for name, kind in (("model", str), ("n", int), ("top-p", float), ("max-tokens", int), ("temperature", float), ("timeout", int)):
        g.add_argument(f"--{name}", type=kind, default=getattr(completions.ModelSettings(), name.replace("-", "_")))
    g = p.add_argument_group("execution")
    g.add_argument("--runner", help="MODULE:CLASS of an execution provider")
    g.add_argument("--rounds", type=int, default=feedback.ROUNDS)
    g.add_argument("--min-cov", type=float, default=feedback.MIN_COVERAGE)
    g.add_argument("--min-valid", type=float, default=feedback.MIN_VALID)
    g = p.add_argument_group("show")
    g.add_argument("--unit")
    g.add_argument("--what", default="summary", choices=("summary", "code", "test", "result", "chat"))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("codequarry").getOrCreate()
    ship(spark)
    table = spark.read.parquet
    settings = completions.ModelSettings(model=a.model, n=a.n, top_p=a.top_p, max_tokens=a.max_tokens, temperature=a.temperature, timeout=a.timeout)
    filters = extract.Filters(**{g: False for g in FILTER_GROUPS if a.disable_all_filters or getattr(a, f"no_{g}")})

    def runner() -> execution.ExecutionProvider:
        if a.runner is None:
            raise SystemExit(f"{a.verb} needs --runner: nothing is executed inside the engine")
        return load_provider(a.runner)

    def units() -> DataFrame:
        found = table(a.units) if a.units else extract_units(table(a.source), table(a.graphs) if a.graphs else None, filters)
        return found.where(F.col("name") == a.function) if a.function else found

    out = {
        "setup": lambda: setup(spark, a.source), "build": lambda: build(int(a.source), spark), "graphs": lambda: build_graphs(table(a.source)),
        "extract": lambda: extract_units(table(a.source), table(a.graphs) if a.graphs else None, filters),
        "generate": lambda: generate(table(a.source), units(), load_provider(a.provider), a.context, a.max_context, settings),
        "execute": lambda: execute(table(a.source), runner()),
        "generate-execute": lambda: generate_execute(table(a.source), units(), load_provider(a.provider), runner(), a.rounds, a.min_cov, a.min_valid, a.context, a.max_context, settings),
        "specs": lambda: specs(table(a.source), units(), table(a.histories), load_provider(a.provider), settings),
        "list": lambda: list_units(table(a.source), a.limit, True), "show": lambda: show(table(a.source), a.what, a.unit, table(a.units) if a.units else None),
        "rewrite-graph": lambda: callgraph.to_maps(callgraph.edges(table(a.source))), "rewrite-imports": lambda: imports.rewritten(table(a.source)),
    }[a.verb]()
    if a.target:
        out.write.mode("overwrite" if a.overwrite else "ignore").parquet(a.target)
    else:
        out.show(a.limit, truncate=False)


if __name__ == "__main__":
    main()
