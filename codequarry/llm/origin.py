"""Generated, minified, vendored and data files among the sources.

Layout statistics of the whole text (share of text in very long lines, mean line length,
white space, letters and digits, number literals, long encoded runs, lines alike but for
their numbers, delimited rows) against thresholds tuned per language, with the notices
that generators and vendoring tools leave in the first or last comment lines, and
directories that hold only third-party code. All of it is Catalyst expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Thresholds per language (extension): characters of a very long line, share of text in
#: such lines, share of encoded runs, share of lines alike but for numbers, least lines for
#: that, share of delimited rows, share of digits in data; mean line from which and white
#: space up to which code is minified. None: the statistic says nothing for this language.
THRESHOLDS = {
    "py": {"long_line": 800, "long_share": 0.4, "encoded_share": 0.6, "alike_share": 0.55, "alike_lines": 12, "row_share": 0.9, "digit_share": 0.2, "dense_line": 200, "dense_space": 0.1},
    "js": {"long_line": 800, "long_share": 0.4, "encoded_share": 0.6, "alike_share": 0.6, "alike_lines": 12, "row_share": 0.9, "digit_share": 0.2, "dense_line": 140, "dense_space": 0.1},
    "toml": {"long_line": 2000, "long_share": 0.6, "encoded_share": 0.6, "alike_share": 0.7, "alike_lines": 30, "row_share": None, "digit_share": 0.2, "dense_line": None, "dense_space": None},
    "json": {"long_line": 2000, "long_share": 0.6, "encoded_share": 0.6, "alike_share": 0.7, "alike_lines": 60, "row_share": None, "digit_share": 0.2, "dense_line": 300, "dense_space": 0.06},
    "yml": {"long_line": 2000, "long_share": 0.6, "encoded_share": 0.6, "alike_share": 0.7, "alike_lines": 30, "row_share": None, "digit_share": 0.2, "dense_line": None, "dense_space": None},
    "ini": {"long_line": 2000, "long_share": 0.6, "encoded_share": 0.6, "alike_share": 0.7, "alike_lines": 30, "row_share": None, "digit_share": 0.2, "dense_line": None, "dense_space": None},
    "env": {"long_line": 2000, "long_share": 0.6, "encoded_share": 0.6, "alike_share": 0.7, "alike_lines": 30, "row_share": None, "digit_share": 0.2, "dense_line": None, "dense_space": None},
}
#: Letters and digits that dense code has at least and at most; a long text or a run of codes has more.
DENSE_ALNUM = (0.3, 0.85)
#: Mean line from which a name that minifiers give decides, where white space is rare too.
NAMED_LINE, NAMED_SPACE = 80, 0.12

#: Lines at either end of a file in which a notice counts, comment or not; beyond them it
#: counts in the whole comment block at that end.
HEAD_LINES, TAIL_LINES = 12, 4
_START = r"(?im)^[ \t]*(?:#+|//+|/?\*+|;+|<!--|--|\x22//\x22\s*:\s*\x22)?[ \t]*"
# Notices of generators, as the start of a comment or docstring line without placeholders.
GENERATED = (
    _START + r"(?:@generated\b|auto-?generated\b|automatically (?:generated|created)\b"
    r"|(?:this|the|diese|dieser|ce|este) (?:file|code|module|datei|fichier|archivo|arquivo)\b[^\n{}]{0,30}\b(?:generated|created|produced|erzeugt|generiert|généré|generado|gerado)\b"
    r"|(?:code |file )?(?:generated|produced|created|compiled|written) (?:automatically )?(?:by|from|with)\b[^\n{}]*\b(?:do not (?:edit|modify|change)|change the template|build rules|overwritten|will be lost)"
    r"|do not (?:edit|modify)\b[^\n{}]*\bgenerated)[^\n{}]*$"
)
# Notices of copies of third-party code.
VENDORED = (
    _START + r"(?:(?:copied|taken|imported|adapted) (?:unchanged |verbatim |unmodified )?from \S+ v?\d+(?:\.\d+)+|bundled (?:copy|version) of\b|vendored (?:from|copy|version)\b|third[- ]party code\b"
    r"|licensed by the \S+ authors, not by this project|do not change here, report issues upstream|upstream: https?://)"
)
# Directories that package managers and vendoring conventions keep for third-party code.
DIRECTORIES = r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|_vendor|vendored|_vendored|third[_-]?party|extern|externals?|site-packages|deps/bundled|bundled)/"
# Names that minifiers and code generators give their output.
MINIFIED_NAME = r"[.-]min\.(?:js|css)$"
ENCODED = r"[A-Za-z0-9+/_-]{60,}={0,2}"
ROW = r"^[\w .+-]*(?:[;\t|][\w .+-]*){2,}$"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _block(lines: Column, leading: bool) -> Column:
    """The whole comment block (or docstring) at one end of the lines, as text; null if it ends
    within HEAD_LINES or TAIL_LINES."""
    quotes = ('"""', "'''")

    def step(state: Column, line: Column) -> Column:
        x = F.trim(line)
        of = lambda kind: F.struct(F.lit(kind).alias("kind"), (state["n"] + 1).alias("n"))
        if leading:
            out = F.when(state["kind"] == 1, F.when(x.contains("*/"), of(0)).otherwise(of(1)))
            for k, q in enumerate(quotes, 2):
                out = out.when(state["kind"] == k, F.when(x.contains(q), of(0)).otherwise(of(k)))
            out = out.when(state["kind"] == 9, state).when(x.rlike(r"^(?:#|//|;|--|<!--|\{$|\x22(?://|_?comment)\x22)"), of(0))
            out = out.when(x.startswith("/*"), F.when(x.contains("*/"), of(0)).otherwise(of(1)))
            for k, q in enumerate(quotes, 2):
                out = out.when(x.rlike("^[rRuU]?" + q), F.when(x.rlike(q + "[\\s\\S]*" + q), of(0)).otherwise(of(k)))
        else:
            out = F.when(state["kind"] == 9, state).when((state["kind"] == 1) | x.endswith("*/"), F.when(x.startswith("/*"), of(0)).otherwise(of(1)))
            out = out.when(x.rlike(r"^(?:#|//|;|--|<!--)"), of(0))
        return out.otherwise(F.struct(F.lit(9).alias("kind"), state["n"].alias("n")))

    ordered = lines if leading else F.reverse(lines)
    start = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("n"))
    near = HEAD_LINES if leading else TAIL_LINES
    # the lines near the end count anyway; most blocks end within them
    beyond = F.aggregate(F.slice(ordered, 1, near), start, step, lambda s: s["kind"] != 9)
    return F.when((F.size(ordered) > near) & beyond, F.array_join(F.slice(ordered, 1, F.aggregate(ordered, start, step, lambda s: s["n"])), "\n"))


def layout(files: DataFrame) -> DataFrame:
    """files with language and layout statistics; all are null or 0 for null or blank content."""
    text = F.replace(F.col("file_content"), F.lit("\r"), F.lit("\n"))
    size = F.length("file_content")
    share = lambda n: F.coalesce(F.try_divide(n, size), F.lit(0.0))
    out = files.withColumn("language", F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))
    out = out.withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x)) > 0))
    out = out.withColumn("n_lines", F.greatest(F.size("lines"), F.lit(0)))
    limit = _threshold("long_line")
    long_chars = F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(F.length(x) > limit, F.length(x)).otherwise(0))
    alike = F.array_distinct(F.transform("lines", lambda x: F.regexp_replace(F.trim(x), r"-?[0-9]+(?:\.[0-9]+)?", "0")))
    rows = F.size(F.filter("lines", lambda x: x.rlike(ROW)))
    per_line = lambda n: F.coalesce(F.try_divide(n, F.col("n_lines")), F.lit(0.0))
    return out.select(
        *files.columns, "language", "n_lines",
        F.coalesce(F.array_max(F.transform("lines", lambda x: F.length(x))), F.lit(0)).alias("max_line"),
        per_line(size).alias("mean_line"),
        share(size - _without(F.col("file_content"), " \t\r\n")).alias("space_share"),
        share(size - _without(F.col("file_content"), "0123456789")).alias("digit_share"),
        # only asked of text in long lines
        F.when(size >= NAMED_LINE * F.col("n_lines"), share(size - F.length(F.regexp_replace("file_content", r"[\p{L}\p{N}]+", "")))).alias("alnum_share"),
        share(long_chars).alias("long_share"),
        share(size - F.length(F.regexp_replace("file_content", ENCODED, ""))).alias("encoded_share"),
        F.when(F.col("n_lines") > 0, 1 - F.size(alike) / F.col("n_lines")).otherwise(0.0).alias("alike_share"),
        per_line(rows).alias("row_share"),
        F.concat_ws("\n", F.slice("lines", 1, HEAD_LINES), F.slice("lines", F.greatest(F.lit(1), F.col("n_lines") - TAIL_LINES + 1), TAIL_LINES), _block(F.col("lines"), True), _block(F.col("lines"), False)).alias("ends"),
    )


def _threshold(name: str) -> Column:
    return reduce(lambda c, x: c.when(F.col("language") == x[0], F.lit(x[1][name])), THRESHOLDS.items(), F.when(F.lit(False), F.lit(None)))


def origin(files: DataFrame) -> DataFrame:
    """(file_no, repo_id, rel_path, language, origin) of every file; origin is vendored, generated,
    minified, data or hand_written.

    Null and blank contents are hand_written unless their directory says otherwise; a null
    path has a null language, for which only notices count. Repeated rows come out once.
    """
    f = layout(spread(files.select("file_no", "repo_id", "rel_path", "file_content")))
    over = lambda name: F.coalesce(F.col(name) >= _threshold(name), F.lit(False))
    dense = over("encoded_share") | over("row_share") & (F.col("n_lines") >= 5)
    alike = over("alike_share") & F.coalesce(F.col("n_lines") >= _threshold("alike_lines"), F.lit(False))
    numbers = F.coalesce(F.col("digit_share") > _threshold("digit_share"), F.lit(False))
    long_named = F.coalesce(F.col("rel_path").rlike(MINIFIED_NAME), F.lit(False)) & (F.col("mean_line") >= NAMED_LINE) & (F.col("space_share") <= NAMED_SPACE)
    tight = F.coalesce((F.col("mean_line") >= _threshold("dense_line")) & (F.col("space_share") <= _threshold("dense_space")), F.lit(False)) & F.coalesce(F.col("alnum_share").between(*DENSE_ALNUM), F.lit(False))
    packed = over("long_share") | tight | long_named
    data = F.col("file_content").rlike(r"(?s)^\s*[\[{]\s*[\[{\x22].*[\]}]\s*;?\s*$") & (F.col("language") != "json")
    kind = (
        F.when(F.coalesce(F.col("rel_path").rlike(DIRECTORIES), F.lit(False)) | F.coalesce(F.col("ends").rlike(VENDORED), F.lit(False)), "vendored")
        .when(F.coalesce(F.col("ends").rlike(GENERATED), F.lit(False)), "generated")
        .when(dense | packed & (numbers | F.coalesce(data, F.lit(False))), "data")
        .when(packed, "minified")
        .when(alike, "generated")
        .otherwise("hand_written")
    )
    return f.select("file_no", "repo_id", "rel_path", "language", kind.alias("origin")).distinct()


def hand_written(files: DataFrame) -> DataFrame:
    """file_no, repo_id, module_id and file_content of the files that somebody wrote by hand."""
    kept = origin(files).where("origin = 'hand_written'").select("file_no").distinct()
    return files.select("file_no", "repo_id", F.col("module_id.identifier").alias("module_id"), "file_content").distinct().join(kept, "file_no", "left_semi")
