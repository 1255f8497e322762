"""Prompts, completion providers with a cache, and what is read from completions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import code_block, prompt_key

CHAT = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class ModelSettings:
    """Completion settings; they are part of the cache key."""

    model: str = "stub"
    n: int = 1
    top_p: float = 0.95
    max_tokens: int = 1024
    temperature: float = 0.2
    timeout: int = 60

    def key(self) -> str:
        return repr(sorted(asdict(self).items()))


#: Known models and the interface they are served by; a dimension table, to be extended by callers.
MODELS = (("stub", "stub"), ("replay", "replay"))


def models(spark: SparkSession, rows: tuple[tuple[str, str], ...] = MODELS) -> DataFrame:
    return spark.createDataFrame(list(rows), "model string, style string")


class CompletionProvider(Protocol):
    """Gives completions for prompts; runs inside workers, so it must be picklable."""

    def complete(self, messages: list[dict], settings: ModelSettings) -> list[str]: ...


class StubProvider:
    """Deterministic completions without a network: a fenced echo of the last message's first word."""

    def complete(self, messages, settings):
        last = (messages[-1]["content"] or "").split() if messages else []
        return [f"```python\n# {last[0] if last else ''}\n```"] * settings.n


class EndpointProvider:
    """Completions from a server that speaks the widespread chat-completions protocol (hosted models
    and local inference servers alike). The key is read, in the worker, from an environment
    variable; nothing is sent without a call."""

    def __init__(self, url: str, key_variable: str | None = None):
        self.url, self.key_variable = url, key_variable

    def complete(self, messages, settings):
        import json
        import os
        from urllib.request import Request, urlopen

        head = {"Content-Type": "application/json"}
        if self.key_variable and os.environ.get(self.key_variable):
            head["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        body = {"model": settings.model, "messages": messages, "n": settings.n, "top_p": settings.top_p, "max_tokens": settings.max_tokens, "temperature": settings.temperature}
        with urlopen(Request(self.url, json.dumps(body).encode(), head), timeout=settings.timeout) as answer:
            return [c["message"]["content"] for c in json.load(answer)["choices"]]


def within(seconds: float, call: Callable, *args):
    """call(*args), or TimeoutError after some seconds; the call then ends by itself, unheard."""
    from threading import Thread

    got: list = []

    def run():
        try:
            got.append((True, call(*args)))
        except Exception as e:  # handed on to the caller
            got.append((False, e))

    thread = Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise TimeoutError(f"no answer within {seconds} s")
    good, value = got[0]
    if not good:
        raise value
    return value


# ---------------------------------------------------------------- prompts

SYSTEM = "You write unit tests for Python code. Answer with one fenced block of code."
TASK = "Write a unittest test case for the function `{name}` of the code above. Compare it with `reference_{name}`."
METHOD_TASK = "Write a unittest test case for the method `{name}` of the class `{cls}` of the code above. Compare it with `reference_{cls}`."
FEEDBACK = {
    "fix_error": "The last test failed:\n{feedback}\nPlease correct the test of `{name}`.",
    "improve_coverage": "The marked lines of `{name}` aren't reached yet:\n{feedback}\nPlease add cases that reach them.",
    "oversample": "Please write another test of `{name}` with other inputs.{feedback}",
}
SPEC_SYSTEM = "You write docstrings for Python functions. Answer with the function and its docstring in one fenced block."
SPEC_TASK = "Describe `{name}` so that it can be written again from the description. Argument types: {argument_types}. Result: {output_type}.{example}"


def _fill(template: str, **slots: Column) -> Column:
    """A template with its slots replaced by columns; braces of other names stay."""
    out: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find("{" + k + "}"), k) for k in slots if "{" + k + "}" in rest) if any("{" + k + "}" in rest for k in slots) else None
        if at is None:
            out.append(F.lit(rest))
            break
        head, key = rest[: at[0]], at[1]
        if head:
            out.append(F.lit(head))
        out.append(F.coalesce(slots[key].cast("string"), F.lit("")))
        rest = rest[at[0] + len(key) + 2 :]
    return F.concat(*out)


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def test_prompts(units: DataFrame, contexts: DataFrame) -> DataFrame:
    """unit_id, chat_messages: system, context and task of each unit that has a context."""
    u = units.join(contexts.select("unit_id", "context"), "unit_id")
    cls = F.element_at(F.split("class_id", r"\."), -1)
    task = F.when(F.col("class_id").isNull(), _fill(TASK, name=F.col("name"))).otherwise(_fill(METHOD_TASK, name=F.col("name"), cls=cls))
    return u.select("unit_id", F.array(message("system", SYSTEM), message("user", F.col("context")), message("user", task)).cast(CHAT).alias("chat_messages"))


def feedback_text(kind: Column, name: Column, feedback: Column) -> Column:
    """The user turn for a unit that goes another round."""
    expr = F.when(F.lit(False), F.lit(None))
    for k, template in FEEDBACK.items():
        expr = expr.when(kind == k, _fill(template, name=name, feedback=feedback))
    return expr


def spec_prompts(units: DataFrame, types: DataFrame, examples: DataFrame) -> DataFrame:
    """unit_id, chat_messages asking for a description, with captured types and one example call."""
    u = units.join(types, "unit_id", "left").join(examples, "unit_id", "left")
    text = _fill(SPEC_TASK, name=F.col("name"), argument_types=F.coalesce("argument_types", F.lit("unknown")), output_type=F.coalesce("output_types", F.lit("unknown")), example=F.when(F.col("example") != "", F.concat(F.lit(" Example:\n"), F.col("example"))))
    return u.select("unit_id", F.array(message("system", SPEC_SYSTEM), message("user", F.concat(F.col("code"), F.lit("\n\n"), text))).cast(CHAT).alias("chat_messages"))


# ---------------------------------------------------------------- completion


def misses(prompts: DataFrame, cache: DataFrame, settings: ModelSettings) -> DataFrame:
    """prompts with their key, of those that the cache (key, completions) doesn't hold."""
    return prompts.withColumn("key", prompt_key("chat_messages", settings.key())).join(cache.select("key"), "key", "left_anti")


def completed(prompts: DataFrame, provider: CompletionProvider, settings: ModelSettings = ModelSettings(), cache: DataFrame | None = None, retries: int = 2) -> DataFrame:
    """unit_id, key, completions, status (ok, timeout, error), error. Hits come from the cache; a
    failing call is tried again `retries` times and then is a row with status error, or timeout
    where it took longer than settings.timeout seconds. Rows leave the provider in Arrow
    batches, repeated prompts are asked once."""
    keyed = prompts.withColumn("key", prompt_key("chat_messages", settings.key()))
    asked = (misses(prompts, cache, settings) if cache is not None else keyed).select("key", "chat_messages").dropDuplicates(["key"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, messages in zip(pdf["key"], pdf["chat_messages"]):
                chat = [dict(m) if isinstance(m, dict) else m.asDict() for m in messages]
                for attempt in range(retries + 1):
                    try:
                        out.append((key, list(within(settings.timeout, provider.complete, chat, settings)), "ok", None))
                        break
                    except Exception as e:  # a provider's failure is data
                        if attempt == retries:
                            out.append((key, None, "timeout" if isinstance(e, TimeoutError) else "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["key", "completions", "status", "error"])

    new = asked.mapInPandas(run, "key string, completions array<string>, status string, error string")
    if cache is not None:
        new = new.unionByName(cache.select("key", "completions", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")))
    return keyed.select("unit_id", "key").join(new, "key").select("unit_id", "key", "completions", "status", "error")


def status_counts(done: DataFrame) -> DataFrame:
    """One row: total, ok, timeouts and errors of what completed or executed gave."""
    return done.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "ok"), ("timeout", "timeouts"), ("error", "errors"))))


def cache_rows(done: DataFrame) -> DataFrame:
    """What may enter the cache: successes only."""
    return done.where("status = 'ok'").select("key", "completions").dropDuplicates(["key"])


def tests_of(done: DataFrame, test_id: str = "test_0") -> DataFrame:
    """unit_id, tests: the first code block of the first completion, as one test."""
    code = code_block(F.try_element_at("completions", F.lit(1)))
    return done.where("status = 'ok'").select("unit_id", F.create_map(F.lit(test_id), F.coalesce(code, F.lit(""))).alias("tests"))


def specs_of(done: DataFrame) -> DataFrame:
    """unit_id, spec: the docstring of the last definition in the last code block."""
    from ..functions.rewrite import last_docstring

    @F.pandas_udf("string")
    def doc(code: pd.Series) -> pd.Series:
        return code.map(lambda c: last_docstring(c or ""))

    return done.where("status = 'ok'").select("unit_id", doc(code_block(F.try_element_at("completions", F.lit(1)), last=True)).alias("spec"))


def problems(units: DataFrame, specs: DataFrame) -> DataFrame:
    """units with the spec column of those that have one."""
    return units.join(specs, "unit_id", "left")


# ---------------------------------------------------------------- captured calls


def captured_types(calls: DataFrame) -> DataFrame:
    """fut_no, argument_types ("a: int, str; b: list"), output_types: distinct JSON types of the
    captured inputs and outputs, sorted. calls: fut_no, inputs, output as JSON text; other text is
    a STRING."""
    kind = lambda c: F.when(F.try_parse_json(c).isNull(), "STRING").otherwise(F.schema_of_variant(F.try_parse_json(c)))
    named = calls.select("fut_no", F.explode(F.from_json("inputs", "map<string,string>")).alias("arg", "value"))
    typed = named.select("fut_no", "arg", kind(F.coalesce("value", F.lit("null"))).alias("t"))
    per = typed.groupBy("fut_no", "arg").agg(F.array_join(F.array_sort(F.collect_set("t")), ", ").alias("types"))
    args = per.groupBy("fut_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arg", "types"))), lambda x: F.concat(x["arg"], F.lit(": "), x["types"])), "; ").alias("argument_types"))
    outs = calls.select("fut_no", kind(F.coalesce("output", F.lit("null"))).alias("t")).groupBy("fut_no").agg(F.array_join(F.array_sort(F.collect_set("t")), ", ").alias("output_types"))
    return outs.join(args, "fut_no", "left").select("fut_no", "argument_types", "output_types")


def example_calls(calls: DataFrame, seed: int = 0) -> DataFrame:
    """fut_no, example: one captured call of each, chosen by hash, as "k=v" lines and the output."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json("inputs", "map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "\n")
    text = F.concat(F.coalesce(lines, F.lit("")), F.lit("\noutput="), F.coalesce("output", F.lit("null")))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "fut_no", "round_no", "call_no"))
    return calls.groupBy("fut_no").agg(F.min_by(text, order).alias("example"))


def annotated(code_rows: DataFrame, mark: str = "# not reached", lines: str = "unexecuted_lines") -> DataFrame:
    """fut_no, annotated: the code with a mark, of the line's indent, before each line whose number
    `lines` (an array) holds: unexecuted lines, or branches that weren't taken. code_rows:
    fut_no, code, lines, start_line (number of the code's first line) and, to give a part of
    a file only, first_line and last_line (null: no bound)."""
    bounds = [c for c in ("first_line", "last_line") if c in code_rows.columns]
    rows = code_rows.select("fut_no", "start_line", lines, *bounds, F.posexplode(F.split("code", "\n")).alias("pos", "line"))
    number = F.col("pos").cast("long") + F.col("start_line")
    if bounds:
        rows = rows.where((F.coalesce(number >= F.col("first_line"), F.lit(True)) if "first_line" in bounds else F.lit(True)) & (F.coalesce(number <= F.col("last_line"), F.lit(True)) if "last_line" in bounds else F.lit(True)))
    hit = F.coalesce(F.array_contains(lines, number), F.lit(False))
    text = F.when(hit, F.concat(F.regexp_extract("line", r"^(\s*)", 1), F.lit(f"{mark}\n"), F.col("line"))).otherwise(F.col("line"))
    return rows.groupBy("fut_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "\n").alias("annotated"))
