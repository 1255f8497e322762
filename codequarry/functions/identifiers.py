"""Identifier, path and small text expressions. All are Catalyst expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def identifier_from_path(path: Column | str) -> Column:
    """Dotted identifier of a repository-relative path: one .py suffix off, slashes to dots."""
    return F.replace(F.regexp_replace(_c(path), r"\.py$", ""), F.lit("/"), F.lit("."))


def identifier_from_absolute(path: Column | str, repo_path: Column | str) -> Column:
    """The same for an absolute path below repo_path, without a leading dot."""
    return identifier_from_path(F.regexp_replace(F.replace(_c(path), _c(repo_path), F.lit("")), "^/+", ""))


def path_from_identifier(identifier: Column | str, module_type: Column | str | None = None) -> Column:
    """Repository-relative path of a module: dots to slashes, .py unless it is a directory."""
    kind = F.lit("file") if module_type is None else F.coalesce(_c(module_type), F.lit("file"))
    return F.concat(F.replace(_c(identifier), F.lit("."), F.lit("/")), F.when(kind == "file", ".py").otherwise(""))


def parent_identifier(identifier: Column | str, levels: int = 1) -> Column:
    """The identifier without its last segments: the module of a function or class (1) or method (2).
    An identifier of too few segments gives an empty one."""
    parts = F.split(_c(identifier), r"\.")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(0))), ".")


def last_segment(identifier: Column | str) -> Column:
    return F.element_at(F.split(_c(identifier), r"\."), -1)


def repo_id_from_url(url: Column | str) -> Column:
    """user___name of the last two parts of a URL, without a trailing slash or .git."""
    parts = F.split(F.regexp_replace(F.regexp_replace(_c(url), "/+$", ""), r"\.git$", ""), "/")
    return F.concat_ws("___", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))


def repo_id_from_local(path: Column | str) -> Column:
    """LOCAL___basename of a local directory."""
    return F.concat(F.lit("LOCAL___"), F.element_at(F.split(F.regexp_replace(_c(path), "/+$", ""), "/"), -1))


def repo_part(repo_id: Column | str, part: str) -> Column:
    """org or name of a repo_id; an id that isn't exactly org___name stands for both."""
    parts = F.split(_c(repo_id), "___")
    return F.when(F.size(parts) == 2, F.element_at(parts, 1 if part == "org" else 2)).otherwise(_c(repo_id))


def repo_path(repo_id: Column | str, repos_dir: str) -> Column:
    return F.concat_ws("/", F.lit(repos_dir), _c(repo_id))


def callgraph_path(repo_id: Column | str, graphs_dir: str) -> Column:
    return F.concat(F.lit(graphs_dir), F.lit("/"), _c(repo_id), F.lit("_cgraph.json"))


def is_hidden(path: Column | str) -> Column:
    """Whether a part of a repository-relative path starts with a dot."""
    return _c(path).rlike(r"(^|/)\.")


def gen_time(gen_date: Column | str) -> Column:
    """Time of a yyyyMMdd_HHmmss text, null where it is none."""
    return F.try_to_timestamp(_c(gen_date), F.lit("yyyyMMdd_HHmmss"))


def gen_date(time: Column | str | None = None) -> Column:
    """yyyyMMdd_HHmmss text of a time, of now by default."""
    return F.date_format(F.current_timestamp() if time is None else _c(time), "yyyyMMdd_HHmmss")


def elide(text: Column | str, head: int = 90, tail: int = 90) -> Column:
    """Head and tail of a text longer than both together."""
    c = _c(text)
    return F.when(F.length(c) > head + tail, F.concat(F.left(c, F.lit(head)), F.lit("  ......  "), F.right(c, F.lit(tail)))).otherwise(c)


def shorten(text: Column | str, width: int, mark: str = "...") -> Column:
    """Text with white space collapsed, cut at a word so that it fits width with the mark."""
    c = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    cut = F.regexp_replace(F.substring(c, 1, width - len(mark) + 1), r"\s?\S*$", "")
    return F.when(F.length(c) <= width, c).otherwise(F.concat(cut, F.lit(mark)))


def code_block(text: Column | str, last: bool = False) -> Column:
    """Lines between the first (or last) two lines that hold a fence; empty with fewer than two."""
    lines = F.split(_c(text), "\n")
    fences = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("```"), i).otherwise(-1)), lambda i: i >= 0)
    a, b = (F.try_element_at(fences, F.lit(-2)), F.try_element_at(fences, F.lit(-1))) if last else (F.try_element_at(fences, F.lit(1)), F.try_element_at(fences, F.lit(2)))
    return F.when(F.size(fences) >= 2, F.array_join(F.slice(lines, a + 2, b - a - 1), "\n")).otherwise(F.when(_c(text).isNotNull(), F.lit("")))


def prompt_key(messages: Column | str, config: str = "") -> Column:
    """Cache key of a chat prompt and the completion settings."""
    return F.sha2(F.concat_ws("|", F.to_json(F.struct(_c(messages).alias("m"))), F.lit(config)), 256)
