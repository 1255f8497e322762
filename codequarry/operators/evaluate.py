"""Evaluation of execution logs: the normal form of a round, and the report over units.

Logs are JSON text; a text or member that was encoded once more as text is read through
get_json_object, which hands out strings without their quotes. A text that isn't JSON
counts as absent. Everything runs in whole-stage code generation and two-level aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOGS = "map<string,struct<valid:boolean,passed_count:bigint,failed_count:bigint,errored_count:bigint>>"
ERRORS = "map<string,array<struct<type:string,test:string,message:string>>>"
COVERAGE = "array<struct<num_executable_lines:bigint,num_excluded_lines:bigint,num_unexecuted_lines:bigint,num_executed_branches:bigint,line_coverage_percentage:double,branch_coverage_percentage:double,unexecuted_lines:array<bigint>,start_line:bigint,end_line:bigint>>"
# Substrings of set-up errors that say nothing about the unit.
IGNORED_ERRORS = ("SyntaxWarning: invalid escape sequence", "NameError: ")
ERROR_LINE = r"^(\w+Error|Exception): (.+)"


def stats_text(exec_stats: Column) -> Column:
    """exec_stats as JSON text, decoded where the whole was encoded twice; null where it isn't JSON."""
    once = F.when(F.try_parse_json(exec_stats).isNotNull(), exec_stats)
    text = F.when(F.ltrim(once).startswith('"'), F.get_json_object(once, "$")).otherwise(once)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def rounds(futs: DataFrame) -> DataFrame:
    """fut_no, repo_id, round_no, operation, gen_model, gen_date, n_tests, has_stats, error, output, logs,
    coverage of every round; repeated rows once. Null histories give no row."""
    r = futs.select("fut_no", F.col("file.file_module.repo.repo_id").alias("repo_id"), F.posexplode("test_history.history").alias("round_no", "h"))
    r = r.select("fut_no", "repo_id", F.col("round_no").cast("long").alias("round_no"), *(F.col(f"h.{c}").alias(c) for c in ("operation", "gen_model", "gen_date")), F.coalesce(F.size("h.tests"), F.lit(0)).alias("n_tests"), F.col("h.exec_stats").alias("raw")).distinct()
    r = r.withColumn("n_tests", F.greatest("n_tests", F.lit(0)).cast("long")).withColumn("stats", stats_text(F.col("raw")))
    member = lambda name: F.get_json_object("stats", f"$.{name}")
    return r.select(
        "fut_no", "repo_id", "round_no", "operation", "gen_model", "gen_date", "n_tests", F.col("stats").isNotNull().alias("has_stats"), member("error").alias("error"), member("output").alias("output"),
        F.from_json(member("run_tests_logs"), LOGS).alias("logs"), F.from_json(member("coverage_logs"), COVERAGE).alias("coverage"),
    )


def latest(futs: DataFrame) -> DataFrame:
    """The last round of each record: the greatest round_no."""
    r = rounds(futs)
    last = r.groupBy("fut_no").agg(F.max_by(F.struct(*[c for c in r.columns if c != "fut_no"]), "round_no").alias("r"))
    return last.select("fut_no", "r.*")


def is_passing(logs: Column) -> Column:
    """All tests valid; true for no tests, null without logs."""
    return F.forall(F.map_values(logs), lambda x: F.coalesce(x["valid"], F.lit(False)))


def _sum(logs: Column, field: str) -> Column:
    return F.aggregate(F.map_values(logs), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[field], F.lit(0)))


def scored(futs: DataFrame) -> DataFrame:
    """latest with runnable, valid, passed, failed, errored, pass_ratio, branch and line coverage."""
    f = latest(futs)
    f = f.select("*", (F.col("logs").isNotNull()).alias("runnable"), F.coalesce(is_passing(F.col("logs")), F.lit(False)).alias("valid"), *(_sum(F.col("logs"), f"{k}_count").alias(k) for k in ("passed", "failed", "errored")))
    total = F.col("passed") + F.col("failed") + F.col("errored")
    cov = F.try_element_at("coverage", F.lit(-1))
    return f.select(
        "*", F.when(F.col("runnable"), F.coalesce(F.try_divide("passed", total), F.lit(0.0))).alias("pass_ratio"), (F.col("runnable") & (F.col("passed") + F.col("errored") == 0)).alias("all_failed"),
        (F.col("runnable") & (F.col("passed") + F.col("failed") == 0)).alias("all_errored"),
        F.when(F.col("valid"), cov["branch_coverage_percentage"]).alias("branch_coverage"), F.when(F.col("valid"), cov["line_coverage_percentage"]).alias("line_coverage"),
        F.when(F.col("valid"), cov["num_executable_lines"] - F.coalesce(cov["num_excluded_lines"], F.lit(0)) - cov["num_unexecuted_lines"]).alias("executed_lines"),
    )


def report(futs: DataFrame) -> DataFrame:
    """One row: totals, distinct runnable and valid units and repositories, validity and coverage.
    Percentages of nothing are null."""
    s = scored(futs)
    when = lambda cond, col: F.countDistinct(F.when(F.col(cond), F.col(col)))
    out = s.agg(
        F.count("*").alias("total"), when("runnable", "fut_no").alias("runnable"), when("valid", "fut_no").alias("valid"), F.countDistinct("repo_id").alias("repos"), when("runnable", "repo_id").alias("repos_runnable"),
        when("valid", "repo_id").alias("repos_valid"), F.round(F.avg("line_coverage"), 6).alias("line_coverage"), F.round(F.avg("branch_coverage"), 6).alias("branch_coverage"),
        F.round(F.avg("pass_ratio"), 6).alias("pass_ratio"), F.count_if("all_failed").alias("all_failed"), F.count_if("all_errored").alias("all_errored"),
    )
    return out.select("*", (F.col("total") - F.col("runnable")).alias("errored"), F.round(F.try_divide(100.0 * F.col("valid"), F.col("runnable")), 6).alias("validity"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and counts above 80, above 90 and at 100 of a column."""
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.count_if(c > 80).alias("above_80"), F.count_if(c > 90).alias("above_90"), F.count_if(c == 100).alias("at_100"))


def labelled_report(futs: DataFrame) -> DataFrame:
    """(label, measure, value): the printed report in long form. Percentages (line and branch coverage,
    pass ratios times 100) count values above 80, above 90 and at 100; whole numbers (executed
    lines) those at 1, at 2, above 5 and above 10. Means and deviations of nothing are null."""
    s = scored(futs).withColumn("pass_percent", F.col("pass_ratio") * 100)
    percent = [("above_80", lambda c: c > 80), ("above_90", lambda c: c > 90), ("at_100", lambda c: c == 100)]
    number = [("at_1", lambda c: c == 1), ("at_2", lambda c: c == 2), ("above_5", lambda c: c > 5), ("above_10", lambda c: c > 10)]
    cells, aggs = [], []
    for label, steps in (("line_coverage", percent), ("branch_coverage", percent), ("pass_percent", percent), ("executed_lines", number)):
        c = F.col(label)
        for measure, value in [("n", F.count(c)), ("mean", F.avg(c)), ("std", F.stddev_pop(c)), *((m, F.count_if(f(c))) for m, f in steps)]:
            name = f"{label}:{measure}"
            aggs.append(F.round(value.cast("double"), 6).alias(name))
            cells.append(F.struct(F.lit(label).alias("label"), F.lit(measure).alias("measure"), F.col(f"`{name}`").alias("value")))
    return s.agg(*aggs).select(F.inline(F.array(*cells)))


def error_types(texts: DataFrame, column: str) -> DataFrame:
    """(error_type, n) of the lines that begin with an error's plain name."""
    lines = texts.select(F.explode(F.split(column, "\n")).alias("line"))
    return lines.select(F.regexp_extract("line", ERROR_LINE, 1).alias("error_type")).where("error_type <> ''").groupBy("error_type").agg(F.count("*").alias("n"))


def latest_errors(futs: DataFrame, error_rows: DataFrame) -> DataFrame:
    """(fut_no, message) of the last round: the set-up error, else "type: test: message" lines in
    stored order, else an empty text. error_rows: the error level of the nested records."""
    last = latest(futs).select("fut_no", "round_no", "error")
    line = F.concat(F.coalesce("type", F.lit("")), F.lit(": "), F.coalesce("test", F.lit("")), F.lit(":\n"), F.coalesce("message", F.lit("")))
    texts = error_rows.groupBy("fut_no", "round_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("test_id", "error_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return last.join(texts, ["fut_no", "round_no"], "left").select("fut_no", F.coalesce("error", "lines", F.lit("")).alias("message"))
