"""The generate-execute-refine loop over worklists.

A round classifies every unit by its last log; units that don't pass well enough go on.
State between rounds is a table cut by a checkpoint, so the plan doesn't grow and lost
executors cost one round at most. Completions and executions come from providers.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewrite import without_tests
from ..session import cut_lineage
from . import evaluate

#: Least coverage and share of good units (fractions), and rounds.
MIN_COVERAGE, MIN_VALID, ROUNDS = 0.8, 0.8, 3


def status(has_stats: Column, passing: Column, coverage: Column, min_coverage: float = MIN_COVERAGE) -> Column:
    """good, improve_coverage, fix_error, or null where nothing was executed."""
    short = F.coalesce(coverage / 100 < min_coverage, F.lit(False))
    return F.when(~has_stats, F.lit(None).cast("string")).when(F.coalesce(passing, F.lit(False)), F.when(short, "improve_coverage").otherwise("good")).otherwise("fix_error")


def classified(rounds: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """rounds with status; coverage is the last log's branch coverage."""
    cov = F.try_element_at("coverage", F.lit(-1))["branch_coverage_percentage"]
    return rounds.withColumn("status", status(F.col("has_stats"), evaluate.is_passing(F.col("logs")), cov, min_coverage))


def progress(rounds: DataFrame) -> DataFrame:
    """Per round: units, good ones, their share, and the share of all units good so far."""
    c = classified(rounds).where("status is not null")
    first = c.groupBy("fut_no").agg(F.min(F.when(F.col("status") == "good", F.col("round_no"))).alias("good_at"))
    per = c.groupBy("round_no").agg(F.countDistinct("fut_no").alias("n_units"), F.countDistinct(F.when(F.col("status") == "good", F.col("fut_no"))).alias("n_good"))
    done = first.where("good_at is not null").groupBy(F.col("good_at").alias("round_no")).agg(F.count("*").alias("new_good"))
    # a handful of rounds: the running sum is over one row a round
    run = per.join(done, "round_no", "left").select("*", F.sum(F.coalesce("new_good", F.lit(0))).over(_by_round()).alias("sum_good"))
    run = run.join(F.broadcast(first.agg(F.count("*").alias("total"))))  # one row
    return run.select("round_no", "n_units", "n_good", F.round(F.try_divide("n_good", "n_units"), 6).alias("good_ratio"), F.round(F.try_divide("sum_good", "total"), 6).alias("good_so_far"))


def _by_round():
    from pyspark.sql import Window

    return Window.orderBy("round_no").rowsBetween(Window.unboundedPreceding, 0)


def worklist(rounds: DataFrame) -> DataFrame:
    """Units whose last executed round isn't good: (fut_no, round_no, status)."""
    c = classified(rounds).where("status is not null")
    last = c.groupBy("fut_no").agg(F.max_by(F.struct("round_no", "status"), "round_no").alias("r")).select("fut_no", "r.*")
    return last.where("status <> 'good'")


def update_chat(messages: Column, completion: Column, feedback: Column) -> Column:
    """The next prompt: a trailing assistant turn goes, the completion and the feedback come."""
    kind = "array<struct<role:string,content:string>>"
    base = F.when(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)
    turn = F.array(F.struct(F.lit("assistant").alias("role"), completion.alias("content")), F.struct(F.lit("user").alias("role"), feedback.alias("content")))
    return F.concat(F.coalesce(base, F.array().cast(kind)), turn.cast(kind))


def loop(units: DataFrame, generate: Callable[[DataFrame, int], DataFrame], execute: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS, min_valid: float = MIN_VALID, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Final state of every unit after at most `rounds` rounds: unit_id, round_no, status, tests,
    error, chat_messages.

    units: unit_id, chat_messages where prompts are to grow, and anything the providers need.
    generate(open units, round) returns unit_id, tests and, if the chat is to be kept,
    chat_messages (the prompt that was sent); it gets last_status, last_error, last_tests and
    last_chat. execute(units with tests) returns unit_id, has_stats, passing, coverage, error.
    Each provider is called once a unit and round: what it gave is written before it is
    used. Units the providers leave out keep their status; no unit is lost. Stops early once
    min_valid of the round's units are good.
    """
    chat = "array<struct<role:string,content:string>>"
    first = units.dropDuplicates(["unit_id"]).select("unit_id", (F.col("chat_messages") if "chat_messages" in units.columns else F.lit(None)).cast(chat).alias("chat_messages"))
    state = cut_lineage(first.select("unit_id", F.lit(-1).cast("long").alias("round_no"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("map<string,string>").alias("tests"), F.lit(None).cast("string").alias("error"), "chat_messages"))
    for number in range(rounds):
        todo = state.where("status is null or status <> 'good'").select("unit_id", *(F.col(c).alias(f"last_{c}") for c in ("status", "error", "tests")), F.col("chat_messages").alias("last_chat"))
        if todo.isEmpty():
            break
        made = generate(units.join(todo, "unit_id"), number)
        made = cut_lineage(made.select("unit_id", "tests", (F.col("chat_messages") if "chat_messages" in made.columns else F.lit(None)).cast(chat).alias("sent")))
        ran = cut_lineage(execute(units.join(made.select("unit_id", "tests"), "unit_id")).select("unit_id", "has_stats", "passing", "coverage", F.col("error").alias("new_error")))
        new = made.join(ran, "unit_id", "left").join(state.select("unit_id", F.col("chat_messages").alias("old")), "unit_id", "left")
        new = new.select("unit_id", F.lit(number).cast("long").alias("round_no"), status(F.coalesce("has_stats", F.lit(False)), F.col("passing"), F.col("coverage"), min_coverage).alias("status"), "tests", F.col("new_error").alias("error"), F.coalesce("sent", "old").alias("chat_messages"))
        state = cut_lineage(state.join(new.select("unit_id"), "unit_id", "left_anti").unionByName(new))
        good, n = state.where(F.col("round_no") == number).agg(F.count_if(F.col("status") == "good"), F.count("*")).first()
        if n and good / n >= min_valid:
            break
    return state


def with_round(futs: DataFrame, results: DataFrame, operation: str, model: str, when: str) -> DataFrame:
    """futs with one more round at the end of test_history.history of each record that results (fut_no,
    tests, exec_stats, chat_messages) has; a null history begins with it. when: its gen_date."""
    new = results.select("fut_no", F.struct("tests", F.lit(operation).alias("operation"), F.lit(model).alias("gen_model"), F.lit(when).alias("gen_date"), "exec_stats", "chat_messages").alias("_round"))
    kind = futs.schema["test_history"].dataType["history"].dataType.simpleString()
    joined = futs.join(new, "fut_no", "left")
    longer = F.struct(F.concat(F.coalesce("test_history.history", F.array().cast(kind)), F.array("_round").cast(kind)).alias("history"))
    return joined.select(*(F.when(F.col("_round").isNull(), F.col(c)).otherwise(longer).alias(c) if c == "test_history" else F.col(c) for c in futs.columns))


def oversample(seeds: DataFrame, generate: Callable[[DataFrame, int], DataFrame], rounds: int) -> DataFrame:
    """(unit_id, round_no, tests): each round's snapshot holds all tests so far.

    seeds: unit_id and tests (test_0); generate(state, round) returns unit_id and code, which
    becomes test_<round>; without code a snapshot repeats the last one.
    """
    state = seeds.select("unit_id", F.lit(0).cast("long").alias("round_no"), "tests")
    out = state
    for number in range(1, rounds + 1):
        made = generate(state, number).select("unit_id", "code")
        one = F.when(F.col("code").isNotNull(), F.create_map(F.lit(f"test_{number}"), F.col("code"))).otherwise(F.create_map().cast("map<string,string>"))
        state = cut_lineage(state.join(made, "unit_id", "left").select("unit_id", F.lit(number).cast("long").alias("round_no"), F.map_concat("tests", one).alias("tests")))
        out = out.unionByName(state)
    return out


def without_failures(tests: DataFrame, failures: DataFrame) -> DataFrame:
    """tests (fut_no, round_no, test_id, code) without the test methods that failed.

    failures: fut_no, round_no, test_id, test (the method). Codes that don't parse stay as they are.
    """
    gone = failures.where("test is not null").groupBy("fut_no", "round_no", "test_id").agg(F.array_sort(F.collect_set("test")).alias("failed"))

    @F.pandas_udf("string")
    def cut(code: pd.Series, failed: pd.Series) -> pd.Series:
        return pd.Series([c if c is None or f is None else without_tests(c, list(f)) for c, f in zip(code, failed)])

    joined = tests.join(gone, ["fut_no", "round_no", "test_id"], "left")
    return joined.select("fut_no", "round_no", "test_id", F.when(F.col("failed").isNull(), F.col("code")).otherwise(cut("code", "failed")).alias("code"))
