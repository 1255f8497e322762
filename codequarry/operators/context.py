"""Contexts for prompts: naive, full and sliced, within a token budget.

Budgets are kept by prefix sums: pieces have a removal order, and a window sum of their
token counts tells which stay. Counting tokens is a pluggable expression; the default
counts words and marks natively.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import rewrite
from ..session import cut_lineage
from . import extract, imports, slicing

MARK = "# ..."


def token_count(text: Column | str) -> Column:
    """Words, numbers and single marks of a text: a native stand-in for a BPE count."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long")


#: What tells a unit: ids repeat in other repositories.
UNIT = ["repo_id", "unit_id"]


def naive(units: DataFrame, style: str = "markdown") -> DataFrame:
    """repo_id, unit_id, context: the unit's own code under its file's path; of a method its class
    with that method alone, where class_code (the class's source) is there."""
    code = F.col("code")
    if "class_code" in units.columns:
        code = F.when(F.col("class_code").isNull(), code).otherwise(_only_method("class_code", F.element_at(F.split("class_id", r"\."), -1), "name"))
    return units.select(*UNIT, slicing.formatted(F.col("rel_path"), code, style).alias("context"))


@F.pandas_udf(StringType())
def _only_method(code: pd.Series, cls: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else rewrite.only_method(c, k, n) for c, k, n in zip(code, cls, name)], dtype=object)


@F.pandas_udf(StringType())
def _method_last(code: pd.Series, cls: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([c if k is None else rewrite.method_last(c, k, n) for c, k, n in zip(code, cls, name)], dtype=object)


def _targets(files: DataFrame, units: DataFrame) -> DataFrame:
    """units with cls (the class's name or null), top (the top-level name that the unit is or stands
    in), top_ord and top_code of its last such statement, null where the file has none."""
    u = units.select(*UNIT, "rel_path", "class_id", "name", "code").dropDuplicates(UNIT)
    cls = F.element_at(F.split("class_id", r"\."), -1)
    u = u.withColumn("cls", cls).withColumn("top", F.coalesce(cls, "name"))
    last = extract.blocks(files).where("name is not null").groupBy("repo_id", "rel_path", F.col("name").alias("top")).agg(F.max("ord").alias("top_ord"), F.max_by("code", "ord").alias("top_code"))
    return u.join(last, ["repo_id", "rel_path", "top"], "left")


PIECE = [*UNIT, "is_own", "is_target", "path", "ord", "piece"]


def _target_pieces(targets: DataFrame) -> DataFrame:
    """The piece of each unit that always stays: its function, or its class with the method moved
    to the end; the unit's own code where its file doesn't show it."""
    code = F.coalesce(_method_last("top_code", "cls", "name"), F.col("code"))
    return targets.select(*UNIT, F.lit(True).alias("is_own"), F.lit(True).alias("is_target"), F.col("rel_path").alias("path"), F.lit(1 << 40).cast("long").alias("ord"), code.alias("piece"))


def full_pieces(files: DataFrame, units: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """PIECE: the top-level statements of the files that the unit's file imports and of those that hold
    what it calls (calls: repo_id, caller, callee), of the unit's own file without the unit,
    and last the unit."""
    files = extract.parse_once(files, "blocks", "imports")
    targets = cut_lineage(_targets(files, units))
    other = targets.join(imports.resolved(files).where("target is not null").select("repo_id", "rel_path", "target").distinct(), ["repo_id", "rel_path"]).select(*UNIT, "rel_path", F.col("target").alias("path"))
    if calls is not None:
        called = targets.select(*UNIT, "rel_path").join(calls.select("repo_id", F.col("caller").alias("unit_id"), "callee").distinct(), UNIT)
        where = imports.local_paths(files, called, "callee").where("path is not null")
        other = other.unionByName(called.join(where.select("repo_id", F.col("identifier").alias("callee"), "path"), ["repo_id", "callee"]).select(*UNIT, "rel_path", "path"))
    other = other.where("path <> rel_path").select(*UNIT, "path").distinct()
    b = extract.blocks(files).select("repo_id", F.col("rel_path").alias("path"), "ord", "name", "code")
    outside = other.join(b, ["repo_id", "path"]).select(*UNIT, F.lit(False).alias("is_own"), F.lit(False).alias("is_target"), "path", "ord", F.col("code").alias("piece"))
    # of a definition that is repeated in the file only the last one counts
    own = targets.select(*UNIT, F.col("rel_path").alias("path"), "top").join(b, ["repo_id", "path"]).where("name is null or name <> top")
    own = own.select(*UNIT, F.lit(True).alias("is_own"), F.lit(False).alias("is_target"), "path", "ord", F.col("code").alias("piece"))
    return outside.unionByName(own).unionByName(_target_pieces(targets)).select(*PIECE)


def sliced_pieces(files: DataFrame, units: DataFrame, depth: int | None = None, calls: DataFrame | None = None) -> DataFrame:
    """PIECE: the statements a unit depends on, each original statement once, and last the unit."""
    files = extract.parse_once(files, "blocks", "imports", "statements")
    targets = cut_lineage(_targets(files, units))
    s = extract.statements(files).select("repo_id", F.col("rel_path").alias("path"), "idx", "orig_idx", "code", F.get("defines", F.lit(0)).alias("top"), F.col("kind").isin("FunctionDef", "AsyncFunctionDef", "ClassDef").alias("is_def"))
    roots = targets.select("repo_id", F.col("rel_path").alias("path"), "top").distinct()
    # units of one class share its slice
    seeds = s.where("is_def").join(roots, ["repo_id", "path", "top"]).select(F.concat_ws("\x1f", "path", "top").alias("root_id"), "repo_id", "path", "idx")
    rows = slicing.slices(slicing.edges(files, calls), seeds, depth)
    one = rows.join(s, ["repo_id", "path", "idx"]).groupBy("root_id", "repo_id", "path", "orig_idx").agg(F.min_by("code", "idx").alias("piece"), F.max(F.when(F.col("is_def"), F.col("top"))).alias("name"))
    out = targets.select(*UNIT, "rel_path", "top", F.concat_ws("\x1f", "rel_path", "top").alias("root_id")).join(one, ["repo_id", "root_id"])
    out = out.where("not (path = rel_path and coalesce(name, '') = top)")
    out = out.select(*UNIT, (F.col("path") == F.col("rel_path")).alias("is_own"), F.lit(False).alias("is_target"), "path", F.col("orig_idx").alias("ord"), "piece")
    return out.unionByName(_target_pieces(targets)).select(*PIECE)


def within_budget(pieces: DataFrame, budget: int, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """pieces that stay, with over_budget. The target always stays; files lose their last pieces
    first: external ones in path order, then the own file."""
    p = pieces.withColumn("tokens", count(F.col("piece")))
    keep_first = Window.partitionBy(*UNIT).orderBy(F.col("is_target").desc(), F.col("is_own").desc(), F.col("path").desc(), "ord").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("running", F.sum("tokens").over(keep_first))
    return p.where((F.col("running") <= budget) | F.col("is_target")).withColumn("over_budget", F.col("running") > budget).drop("running")


def assembled(kept: DataFrame, all_pieces: DataFrame, style: str = "markdown") -> DataFrame:
    """repo_id, unit_id, context, n_tokens, over_budget: kept pieces by file, the own file last and in
    it the target; a cut file has a mark where its last pieces were."""
    n = all_pieces.where("not is_target").groupBy(*UNIT, "path").agg(F.count("*").alias("n_all"))
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "piece")))), lambda x: x["piece"]), "\n\n")
    per = kept.groupBy(*UNIT, "is_own", "path").agg(part(~F.col("is_target")).alias("text"), part(F.col("is_target")).alias("target"), F.count_if(~F.col("is_target")).alias("n_kept"), F.sum("tokens").alias("tokens"), F.max("over_budget").alias("over"))
    per = per.join(n, [*UNIT, "path"], "left")
    cut = F.when((F.col("n_kept") > 0) & (F.col("n_kept") < F.col("n_all")), F.lit(MARK))
    text = F.concat_ws("\n\n", F.when(F.col("text") != "", F.col("text")), cut, F.when(F.col("target") != "", F.col("target")))
    body = slicing.formatted(F.col("path"), text, style)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("is_own", "path", body.alias("text")))), lambda x: x["text"]), "\n\n")
    return per.groupBy(*UNIT).agg(joined.alias("context"), F.sum("tokens").alias("n_tokens"), F.max("over").alias("over_budget"))


def contexts(files: DataFrame, units: DataFrame, kind: str = "sliced", budget: int = 6000, style: str = "markdown", count: Callable[[Column], Column] = token_count, calls: DataFrame | None = None) -> DataFrame:
    """repo_id, unit_id, context_type, context of each unit: kind naive, full or sliced. calls adds
    what a unit calls (repo_id, caller, callee) to full and sliced contexts. The unit itself
    is in its context at any budget; a null repo_id has no context of other files."""
    if kind not in ("naive", "full", "sliced"):
        raise ValueError(f"unknown context {kind!r}")
    units = units.withColumn("repo_id", F.coalesce("repo_id", F.lit("")))
    if kind == "naive":
        if units.where("class_id is not null").isEmpty():
            return naive(units.dropDuplicates(UNIT), style).select(*UNIT, F.lit(kind).alias("context_type"), "context")
        classes = _targets(extract.parse_once(files, "blocks"), units).select(*UNIT, "rel_path", "class_id", "name", "code", F.when(F.col("cls").isNotNull(), F.col("top_code")).alias("class_code"))
        return naive(classes, style).select(*UNIT, F.lit(kind).alias("context_type"), "context")
    pieces = full_pieces(files, units, calls) if kind == "full" else sliced_pieces(files, units, None, calls)
    pieces = cut_lineage(pieces)
    return assembled(within_budget(pieces, budget, count), pieces, style).select(*UNIT, F.lit(kind).alias("context_type"), "context")
