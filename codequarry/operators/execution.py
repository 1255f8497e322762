"""Execution providers: replaying stored logs, or a sandbox behind an interface.

Nothing runs generated or repository code inside Spark workers by default. A provider's
failure is a row with its error, never a lost unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "unit_id string, has_stats boolean, passing boolean, coverage double, error string, logs string, status string"
#: Seconds that a unit's tests may take.
TIMEOUT = 300


class ExecutionProvider(Protocol):
    """Runs one unit's tests elsewhere and gives its log as a dict."""

    def run(self, unit: dict, tests: dict[str, str]) -> dict: ...


class CommandProvider:
    """Hands each unit and its tests, as JSON on standard input, to an external command (the client
    of a container or a remote sandbox) and reads the log, as JSON, from its output. One
    process serves one unit and is stopped after `timeout` seconds."""

    def __init__(self, command: list[str], timeout: float = TIMEOUT):
        self.command, self.timeout = command, timeout

    def run(self, unit: dict, tests: dict[str, str]) -> dict:
        import json
        import subprocess

        plain = {k: v for k, v in unit.items() if isinstance(v, (str, int, float, bool)) or v is None}
        try:
            done = subprocess.run(self.command, input=json.dumps({"unit": plain, "tests": tests}), capture_output=True, text=True, timeout=self.timeout, check=True)
        except subprocess.TimeoutExpired:
            raise TimeoutError(f"no log within {self.timeout} s") from None
        except subprocess.CalledProcessError as e:
            raise RuntimeError(f"exit {e.returncode}: {e.stderr.strip()[-500:]}") from None
        return json.loads(done.stdout)


def executed(units: DataFrame, provider: ExecutionProvider, timeout: float = TIMEOUT) -> DataFrame:
    """RESULT of every unit (unit_id, tests and what the provider reads). status: ok, timeout after
    some seconds, or error; either of those is a row whose error says why."""
    import json

    from .completions import within

    names = units.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for values in pdf.itertuples(index=False):
                unit = dict(zip(names, values))
                tests = dict(unit.pop("tests") or {})
                try:
                    log = within(timeout, provider.run, unit, tests)
                    valid = [bool(v.get("valid")) for v in (log.get("run_tests_logs") or {}).values()]
                    cov = (log.get("coverage_logs") or [{}])[-1].get("branch_coverage_percentage")
                    out.append((unit["unit_id"], True, "error" not in log and all(valid), cov, log.get("error"), json.dumps(log), "ok"))
                except Exception as e:
                    out.append((unit["unit_id"], True, False, None, f"{type(e).__name__}: {e}", None, "timeout" if isinstance(e, TimeoutError) else "error"))
            yield pd.DataFrame(out, columns=["unit_id", "has_stats", "passing", "coverage", "error", "logs", "status"])

    return units.mapInPandas(run, RESULT)


def replayed(units: DataFrame, logs: DataFrame) -> DataFrame:
    """RESULT from stored logs (unit_id, has_stats, passing, coverage, error): a join, no execution."""
    return units.select("unit_id").join(logs, "unit_id", "left").select("unit_id", F.coalesce("has_stats", F.lit(False)).alias("has_stats"), "passing", "coverage", "error")


def payloads(futs: DataFrame) -> DataFrame:
    """repo_id, path, payload: per repository and file, the JSON a sandbox needs: names and merged
    tests; of repeated test ids the first unit's test stays."""
    name = F.coalesce("function_name", F.element_at(F.split("unit_id", r"\."), -1))
    t = futs.select("repo_id", "path", "unit_id", name.alias("name"), F.explode("tests").alias("test_id", "code"))
    first = t.groupBy("repo_id", "path", "test_id").agg(F.min_by("code", "unit_id").alias("code"))
    tests = first.groupBy("repo_id", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("test_id", "code")))).alias("tests"))
    names = t.groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return tests.join(names, ["repo_id", "path"]).select("repo_id", "path", F.to_json(F.struct("names", "tests")).alias("payload"))


def equivalent(candidates: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """unit_id, valid, error: whether candidate code passes a unit's tests; run gives RESULT."""
    return run(candidates).select("unit_id", F.coalesce("passing", F.lit(False)).alias("valid"), "error")


def worth_counting(error: str = "error"):
    """Set-up errors that say something about a unit."""
    from .evaluate import IGNORED_ERRORS

    c = F.col(error)
    bad = F.lit(False)
    for p in IGNORED_ERRORS:
        bad = bad | c.contains(p)
    return c.isNotNull() & ~bad
