"""Extraction of functions and methods from source files, and the filters on them.

One Arrow pass parses each file; every filter is then a native predicate on its features,
so Catalyst fuses them. Python stands after the cheap path filters, which don't pass a
mapInArrow by themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source
from ..functions.identifiers import identifier_from_path, is_hidden
from ..session import cut_lineage, spread

# Words of a docstring, tokens of a body, starts of a name and substrings of a
# code with which a unit is left out.
DOCSTRING_WORDS = ("test", "transformer", "training", "https", "http", "todo")
BODY_TOKENS = ("demo", "gcp", "s3", "openai", "aws", "cuda", "tensorflow", "triton", "gpu", "nvidia", "scheduler", "async", "job", "do_not_import", "do_not_run", "do_not_call", "plt", "plot", "matplotlib", "seaborn", "plotly", "argparse", "main", "cuda_visible_devices", "multiprocess", "multiprocessing", "pool", "processpool", "threadpool", "joblib", "pebble")
NAME_PREFIXES = ("test", "train_", "main", "demo", "example", "render_pep", "_init")
CODE_SUBSTRINGS = ("cuda", "gpu", "nvidia", "triton", "tensorflow", "multiprocess", "pool", "processpool", "threadpool", "joblib", "mp.")
METHOD_DECORATORS = ("staticmethod", "classmethod")
#: Code lines below which a function or a method is kept.
FUNCTION_LINES, METHOD_LINES = 25, 20

FEATURES = [
    ("unit_kind", "string", pa.string()), ("unit_id", "string", pa.string()), ("class_id", "string", pa.string()), ("name", "string", pa.string()), ("def_ord", "long", pa.int64()),
    ("code", "string", pa.string()), ("docstring", "string", pa.string()), ("doc_tokens", "array<string>", pa.list_(pa.string())), ("body_tokens", "array<string>", pa.list_(pa.string())),
    ("n_args", "long", pa.int64()), ("n_body", "long", pa.int64()), ("n_code_lines", "long", pa.int64()), ("n_top_returns", "long", pa.int64()), ("n_const_returns", "long", pa.int64()),
    ("decorators", "array<string>", pa.list_(pa.string())), ("is_wrapper", "boolean", pa.bool_()),
]
KEYS = [("file_no", "long", pa.int64()), ("repo_id", "string", pa.string()), ("rel_path", "string", pa.string()), ("module_id", "string", pa.string())]


def python_files(files: DataFrame, content: str = "file_content") -> DataFrame:
    """file_no, repo_id, rel_path, module_id, text of the Python files outside hidden directories."""
    f = files.where(F.col("rel_path").endswith(".py") & ~is_hidden("rel_path"))
    return f.select(F.col("file_no").cast("long").alias("file_no"), "repo_id", "rel_path", identifier_from_path("rel_path").alias("module_id"), F.col(content).alias("text"))


_TEXT, _LONG = ("string", pa.string()), ("long", pa.int64())
_NAMES = ("array<string>", pa.list_(pa.string()))
_OUTLINE = [("idx", *_LONG), ("orig_idx", *_LONG), ("kind", *_TEXT), ("defines", *_NAMES), ("uses", *_NAMES), ("late", "boolean", pa.bool_()), ("is_wildcard", "boolean", pa.bool_())]
#: What one parse gives: level to the fields of its rows, and the rows of a tree, module and text.
LEVELS = {
    "units": (FEATURES, lambda tree, module, text: source.units(tree, module)),
    "members": ([("ord", *_LONG), ("name", *_TEXT)], lambda tree, module, text: [{"ord": k, "name": n} for k, n in enumerate(source.members(tree))]),
    "imports": ([("level", *_LONG), ("module", *_TEXT), ("name", *_TEXT), ("alias", *_TEXT), ("is_top", "boolean", pa.bool_()), ("orig_idx", *_LONG)], lambda tree, module, text: source.imports(tree)),
    "calls": ([("caller", *_TEXT), ("callee", *_TEXT)], lambda tree, module, text: source.calls(tree, module)),
    "statements": (
        [*_OUTLINE[:3], ("code", *_TEXT), *_OUTLINE[3:]],
        lambda tree, module, text: source.statements(tree, text),
    ),
    # the statements without their code, for what is written but reads none
    "outline": (_OUTLINE, lambda tree, module, text: source.statements(tree, None)),
    "blocks": ([("ord", *_LONG), ("name", *_TEXT), ("code", *_TEXT)], lambda tree, module, text: source.blocks(tree, text)),
}
#: Column of the parsed levels in what parse_once gives.
PARSED = "parsed"


def parse_once(files: DataFrame, *levels: str) -> DataFrame:
    """file_no, repo_id, rel_path, module_id and the rows of some levels of every file, as arrays.

    The operators take such a table in place of files, so that one that needs several levels,
    or one level twice, parses each text once: the result is written to the checkpoint
    folder. Exact repeats of a file are read once; files that aren't Python, are hidden or
    don't parse stay, with null levels. A table that was parsed already passes through.
    """
    if PARSED in files.columns:
        lacking = [n for n in levels if n not in _held(files) and not (n == "outline" and "statements" in _held(files))]
        if lacking:
            raise ValueError(f"parse {lacking} too")
        return files
    return cut_lineage(_parsed(files, levels))


def _held(files: DataFrame) -> list[str]:
    return files.schema[PARSED].dataType.names if PARSED in files.columns else []


def _parsed(files: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    kinds = [pa.list_(pa.struct([(n, t) for n, _, t in LEVELS[x][0]])) for x in levels]
    whole = pa.struct(list(zip(levels, kinds)))
    schema = pa.schema([*((n, t) for n, _, t in KEYS), (PARSED, whole)])

    def run(batches):
        for batch in batches:
            out = []
            for module, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                tree = source.tree_of(text)[0] if text is not None else None
                out.append(None if tree is None else {x: LEVELS[x][1](tree, module, text) for x in levels})
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, whole)], schema=schema)

    python = F.col("rel_path").endswith(".py") & ~is_hidden("rel_path")
    texts = files.select(F.col("file_no").cast("long").alias("file_no"), "repo_id", "rel_path", identifier_from_path("rel_path").alias("module_id"), F.when(python, F.col("file_content")).alias("text"))
    ddl = ", ".join(f"{n} {t}" for n, t, _ in KEYS) + f", {PARSED} struct<" + ", ".join(f"{x}:array<struct<" + ",".join(f"{n}:{t}" for n, t, _ in LEVELS[x][0]) + ">>" for x in levels) + ">"
    return spread(texts.dropDuplicates(["file_no"])).mapInArrow(run, ddl)


def level(files: DataFrame, name: str) -> DataFrame:
    """KEYS and the fields of the rows of one level, from files or what parse_once gave."""
    parsed = files if PARSED in files.columns else _parsed(files, (name,))
    return parsed.select(*(n for n, *_ in KEYS), F.explode(f"{PARSED}.{name}").alias("x")).select(*(n for n, *_ in KEYS), "x.*")


def parse_status(files: DataFrame) -> DataFrame:
    """file_no, parse_ok, parse_error of every Python file; a file that doesn't parse is a row, not a failure."""
    schema = pa.schema([("file_no", pa.int64()), ("parse_ok", pa.bool_()), ("parse_error", pa.string())])

    def run(batches):
        for batch in batches:
            errors = [source.tree_of(t)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e is None for e in errors]), pa.array(errors, pa.string())], schema=schema)

    return spread(python_files(files).select("file_no", "text")).mapInArrow(run, "file_no long, parse_ok boolean, parse_error string").distinct()


def all_units(files: DataFrame) -> DataFrame:
    """Every top-level function and method with its features."""
    return level(files, "units")


def members(files: DataFrame) -> DataFrame:
    """KEYS, ord, name: what each module offers, in order."""
    return level(files, "members")


def imports(files: DataFrame) -> DataFrame:
    """KEYS, level, module, name, alias, is_top, orig_idx: one row per imported name."""
    return level(files, "imports")


def calls(files: DataFrame) -> DataFrame:
    """KEYS, caller, callee (as written)."""
    return level(files, "calls")


def statements(files: DataFrame) -> DataFrame:
    """KEYS, idx, orig_idx, kind, code, defines, uses, late, is_wildcard of the flattened modules."""
    return level(files, "statements")


def outline(files: DataFrame) -> DataFrame:
    """statements without code."""
    return level(files, "statements").drop("code") if "statements" in _held(files) else level(files, "outline")


def blocks(files: DataFrame) -> DataFrame:
    """KEYS, ord, name, code of the top-level statements."""
    return level(files, "blocks")


# ---------------------------------------------------------------- filters


@dataclass(frozen=True)
class Filters:
    """Which groups of filters apply; off() names groups to leave out."""

    dunder: bool = True
    docstring: bool = True
    arguments: bool = True
    returns: bool = True
    docstring_words: bool = True
    body_tokens: bool = True
    names: bool = True
    decorators: bool = True
    size: bool = True
    lines: bool = True
    substrings: bool = False
    docstring_word_list: tuple[str, ...] = field(default=DOCSTRING_WORDS)
    body_token_list: tuple[str, ...] = field(default=BODY_TOKENS)


def _disjoint(tokens: str, words: tuple[str, ...]) -> Column:
    return ~F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def no_dunder(name: str = "name") -> Column:
    return ~F.col(name).startswith("__")


def good_name(name: str = "name") -> Column:
    return ~reduce(lambda a, b: a | b, (F.lower(name).startswith(p) for p in NAME_PREFIXES))


def not_literal_returns() -> Column:
    """At most two thirds of the top-level returns are constants."""
    return ~(3 * F.col("n_const_returns") > 2 * F.col("n_top_returns"))


def allowed_decorators(allowed: tuple[str, ...]) -> Column:
    extra = F.array_except("decorators", F.array(*map(F.lit, allowed)).cast("array<string>"))
    return F.size(extra) == 0


def keep(f: Filters = Filters()) -> Column:
    """The conjunction of the enabled filters, for functions and methods."""
    is_function = F.col("unit_kind") == "function"
    tests = [
        (f.dunder, no_dunder()), (f.docstring, F.col("docstring").isNotNull()), (f.arguments, ~is_function | (F.col("n_args") > 0)), (f.returns, ~is_function | (F.col("n_top_returns") > 0)),
        (f.returns, not_literal_returns()), (f.docstring_words, _disjoint("doc_tokens", f.docstring_word_list)), (f.body_tokens, _disjoint("body_tokens", f.body_token_list)), (f.names, good_name()),
        (f.decorators, F.when(is_function, F.size("decorators") == 0).otherwise(allowed_decorators(METHOD_DECORATORS))), (f.size, F.when(is_function, F.col("n_body") > 2).otherwise(~F.col("is_wrapper"))),
        (f.lines, F.col("n_code_lines") < F.when(is_function, FUNCTION_LINES).otherwise(METHOD_LINES)),
        (f.substrings, ~reduce(lambda a, b: a | b, (F.lower("code").contains(s) for s in CODE_SUBSTRINGS))),
    ]
    return reduce(lambda a, b: a & b, (c for on, c in tests if on), F.lit(True))


def extract_units(files: DataFrame, graphs: DataFrame | None = None, filters: Filters = Filters()) -> DataFrame:
    """Units that pass the filters. With graphs (repo_id, graph), units of a repository that has a
    graph need a callee there; without a graph for the repository they stay."""
    units = all_units(files).where(keep(filters))
    if graphs is None:
        return units
    links = graphs.select("repo_id", F.explode("graph").alias("unit_id", "callees"))
    counts = links.groupBy("repo_id", "unit_id").agg(F.sum(F.greatest(F.size("callees"), F.lit(0))).alias("n_callees"))
    has = graphs.select("repo_id").distinct().withColumn("has_graph", F.lit(True))
    out = units.join(counts, ["repo_id", "unit_id"], "left").join(has, "repo_id", "left")
    return out.where("has_graph is null or coalesce(n_callees, 0) > 0").drop("has_graph", "n_callees")
