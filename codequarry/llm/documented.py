"""Functions and methods paired with their documentation.

Candidate comments (docstrings, comment blocks) are matched to the definitions of a code
slice by a minimum-cost bipartite assignment over distance, parameter tags and names;
links that are implausible (a block that isn't next to the definition, tags of other
parameters) are rejected. What is left of a description after directives, parameter
lists without text, stand-ins, disabled code and the unit's own name decides whether it
says something.
"""

from __future__ import annotations

import ast
import inspect
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Cost above which a link is implausible.
PLAUSIBLE = 10.0

DIRECTIVE = re.compile(r"(?i)^\W*(?:type:\s*ignore|noqa\b|nosec\b|pylint\s*:|pyright\s*:|mypy\s*:|flake8\s*:|ruff\s*:|fmt\s*:|isort\s*:|yapf\s*:|black\s*:|pragma\s*:|coverage\s*:|eslint|jshint|tslint|prettier-ignore|@ts-|nolint|#?(?:end)?region\b|-\*-|vim?:|cspell|codespell|sonar|lint:|!\s*/)")
FIELD = re.compile(r"^\s*[:@](?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|return|returns|rtype|yields?|ytype|var|ivar|cvar|vartype)\b\s*(?:\{[^}]*\}\s*)?([^:\n]*?)\s*:?(?:\s+(.*))?$")
SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|other parameters|keyword args|keyword arguments|returns?|yields?|raises|attributes|examples?|notes?)\s*:?\s*$")
ENTRY = re.compile(r"^\s*\*{0,2}[A-Za-z_]\w*\s*(?:\([^)]*\))?\s*:\s*(.*)$")
NUMPY_ENTRY = re.compile(r"^\s*\*{0,2}[A-Za-z_][\w, ]*\s*:\s*\S.*$")
RULE = re.compile(r"^[\W_]*$")
WORD = re.compile(r"[^\W\d_]+")
# Words that stand-ins consist of, and those of them that make one.
STAND_IN = frozenset("todo fixme xxx tbd wip hack docstring docstrings description descriptions describe described document documentation documented undocumented missing no none write written add added here goes placeholder docs doc summary me later it this the a an to be done do fill in insert function method class not yet needed required available provided comment comments short long line please need needs text empty stub n by something some your".split())
MARKERS = frozenset("todo fixme xxx tbd wip docstring docstrings description describe documented undocumented documentation docs doc placeholder summary missing document comment stub".split())
# Words that may accompany a unit's own name without saying more.
ARTICLES = frozenset("a an the this that these those function method routine helper of der die das den ein eine le la les un une el los las o os".split())


def stem(word: str) -> str:
    word = word.lower()
    for end in ("ies", "ing", "es", "ed", "er", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 2:
            return word[: -len(end)]
    return word


def same(a: str, b: str) -> bool:
    """Whether two words are inflections of one."""
    if a == b or stem(a) == stem(b) or stem(stem(a)) == stem(stem(b)):
        return True
    k = min(len(a), len(b))
    return k >= 4 and a[: k - 1] == b[: k - 1] and abs(len(a) - len(b)) <= 3


def name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name or "")]


def is_code(text: str) -> bool:
    """Whether the text is source code rather than prose."""
    body = inspect.cleandoc(text)
    if not re.search(r"[()=\[\]{}]|^\s*(?:return|pass|raise|import|from|del)\b", body):
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return bool(tree.body) and not all(isinstance(n, ast.Expr) and isinstance(n.value, (ast.Name, ast.Constant, ast.Tuple)) for n in tree.body)


def said(text: str) -> str:
    """The part of a description that is neither directive, separator, example nor parameter
    list without description."""
    out: list[str] = []
    lines = inspect.cleandoc(text).split("\n")
    section, ruled, example = False, False, False
    for k, line in enumerate(lines):
        if not line.strip():
            example = False
            continue
        if DIRECTIVE.match(line) or RULE.match(line):
            continue
        if line.lstrip().startswith(">>>"):
            example = True
            continue
        if example:
            continue
        field = FIELD.match(line)
        if field:
            out.append(field[2] or "")
            continue
        if SECTION.match(line):
            section = True
            ruled = k + 1 < len(lines) and bool(re.fullmatch(r"\s*[-=]{3,}\s*", lines[k + 1]))
            continue
        if section and ruled:
            if NUMPY_ENTRY.match(line) and not line.startswith(" ") or re.fullmatch(r"\s*[\w.\[\]]+\s*", line):
                continue  # a name or a type
        elif section and (entry := ENTRY.match(line)):
            out.append(entry[1])
            continue
        out.append(line)
    return "\n".join(x for x in out if x.strip())


def is_trivial(text: str | None, name: str | None) -> bool:
    """No words, or only those of stand-ins, of the unit's own name, or of disabled code."""
    if not text or not WORD.search(text):
        return True
    rest = said(text)
    words = [w.lower() for w in WORD.findall(re.sub(r"(?m)[<>`*_=~-]", " ", rest))]
    if not words:
        return True
    if all(w in STAND_IN for w in words) and any(w in MARKERS for w in words):
        return True
    if is_code(rest):
        return True
    own = name_words(name or "")
    return bool(own) and all(w in ARTICLES or any(same(w, o) for o in own) for w in words)


# ---------------------------------------------------------------- candidates and assignment


class Definition:
    """lines: the code's lines, from 1 in numbering; inside: numbers of lines within literals."""

    def __init__(self, node: ast.AST, lines: list[str], inside: set[int]):
        self.node = node
        self.name = node.name
        self.first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        self.line = node.lineno
        a = node.args
        self.params = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]}
        # nothing but blank and comment lines lies between this line and the definition
        self.above = self.first
        while self.above > 1 and self.above - 1 not in inside and lines[self.above - 2].lstrip()[:1] in ("", "#"):
            self.above -= 1


class Comment:
    def __init__(self, first: int, last: int, text: str, inside: int | None = None):
        self.first, self.last, self.text, self.inside = first, last, text, inside


def inside_literals(tree: ast.AST) -> set[int]:
    """Lines that begin within a literal."""
    return {n for x in ast.walk(tree) if isinstance(x, (ast.Constant, ast.JoinedStr)) and x.end_lineno > x.lineno for n in range(x.lineno + 1, x.end_lineno + 1)}


def comment_blocks(code: str, inside: set[int] = frozenset()) -> list[Comment]:
    """Runs of whole-line comments, without their marks; lines within literals are none."""
    out: list[Comment] = []
    run: list[str] = []
    for n, line in enumerate([*code.split("\n"), ""], 1):
        m = re.match(r"\s*#+[:!]?\s?(.*)$", line) if n not in inside else None
        if m:
            run.append(m[1])
        elif run:
            out.append(Comment(n - len(run), n - 1, "\n".join(run)))
            run = []
    return out


def tags(text: str) -> set[str]:
    """Names that a description documents as parameters."""
    return set(re.findall(r"(?m)^\s*[:@](?:param|arg|type)\s+(?:\w+\s+)?\*{0,2}(\w+)", text)) | set(re.findall(r"(?m)^\s+\*{0,2}(\w+)\s*(?:\([^)]*\))?\s*:", text))


def cost(d: Definition, c: Comment) -> float:
    """Distance in lines, with less for tags of its parameters and mentions of its name, more for tags of others."""
    if c.inside is not None:
        base = 0.0 if c.inside == d.line else PLAUSIBLE + 1
    elif c.last < d.first:
        # a block that blank lines or other comments part from the definition is the dearer the farther
        base = 1.0 if c.last + 1 == d.first else 2.0 + 2.0 * (d.first - c.last) if c.first >= d.above else PLAUSIBLE + 1
    elif d.first < c.first and c.last < d.line:
        base = 1.0 if c.last + 1 == d.line else 2.0
    else:
        base = PLAUSIBLE + 1
    named = tags(c.text)
    own = len(named & d.params)
    return base - 0.5 * bool(own) - 0.25 * (d.name in c.text) + (2.0 if named and not own and d.params else 0.0) * (c.inside is None)


def assign(costs: list[list[float]]) -> list[int]:
    """Column of each row in the cheapest assignment (shortest augmenting paths); rows <= columns."""
    n, m = len(costs), len(costs[0]) if costs else 0
    u, v, way, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = costs[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def pair(definitions: list[Definition], comments: list[Comment], name: str | None) -> dict[int, Comment]:
    """Definition number to its comment. A comment serves one definition; comments that say
    nothing of a definition, or stand implausibly, aren't linked."""
    if not definitions or not comments:
        return {}
    never = 1e6
    costs = []
    for k, d in enumerate(definitions):
        row = [cost(d, c) for c in comments]
        row = [x if x < PLAUSIBLE and not is_trivial(c.text, name if k == 0 and name else d.name) else never for x, c in zip(row, comments)]
        costs.append(row + [never / 2 if j == k else never for j in range(len(definitions))])  # unlinked
    return {k: comments[j] for k, j in enumerate(assign(costs)) if j < len(comments) and costs[k][j] < PLAUSIBLE}


def direct(d: Definition, c: Comment) -> bool:
    """Whether a comment is the definition's docstring, or touches its head."""
    return c.inside is not None or c.last + 1 == d.first or d.first < c.first and c.last < d.line


#: A line that begins as a comment, and what literals of several lines hold.
MARKED = re.compile(r"(?m)^[ \t]*#")
LONG_LITERAL = re.compile(r"\"\"\"|'''|\\\n")
LOOSE = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:async\s+)?(?:def|function)\s*\*?\s*(\w+)")


def description(code: str | None, name: str | None = None) -> str | None:
    """What the documentation of the slice's own definition says, None if nothing."""
    if not code:
        return None
    code = code.replace("\r\n", "\n").replace("\r", "\n")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return loose_description(code, name)
    own = next((n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), None)
    if own is None:
        return loose_description(code, name)
    nodes = [own]
    if code.count("def") > 1:
        nodes += [n for n in ast.walk(own) if n is not own and isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    marked = bool(MARKED.search(code))
    inside = inside_literals(tree) if marked and LONG_LITERAL.search(code) else set()
    lines = code.split("\n")
    definitions = [Definition(n, lines, inside) for n in nodes]
    comments = [c for c in comment_blocks(code, inside) if c.first < definitions[0].line or len(nodes) > 1] if marked else []
    for d in definitions:
        text = ast.get_docstring(d.node, clean=False)
        if text is not None:
            expr = d.node.body[0]
            comments.append(Comment(expr.lineno, expr.end_lineno, text, d.line))
    found = pair(definitions, comments, name).get(0)
    return inspect.cleandoc(found.text).strip() if found is not None and direct(definitions[0], found) else None


def loose_description(code: str, name: str | None) -> str | None:
    """The same for slices that don't parse: the comment block right above the definition."""
    m = LOOSE.search(code)
    if not m:
        return None
    above = code[: m.start()].split("\n")[:-1]
    block: list[str] = []
    while above and re.match(r"\s*(?:#|//|/?\*|@)", above[-1]):
        line = above.pop()
        if not line.lstrip().startswith("@"):
            block.insert(0, re.sub(r"^\s*(?:#+[:!]?|//+|/?\*+/?)\s?|\*/\s*$", "", line))
    text = "\n".join(block)
    return None if is_trivial(text, name or m[1]) else inspect.cleandoc(text).strip()


def documented(functions: DataFrame | None, methods: DataFrame | None = None) -> DataFrame:
    """Distinct (unit_no, name, code, description) of the units whose documentation says something.

    A null name is the last part of the identifier. Null and empty codes, and codes
    without a definition, give nothing; repeated rows count once. Units don't meet, so
    only the pairs are shuffled.
    """
    parts = []
    if functions is not None:
        parts.append(functions.select("unit_no", F.col("function_name").alias("name"), F.col("function_id.identifier").alias("id"), F.col("function_code").alias("code")))
    if methods is not None:
        parts.append(methods.select("unit_no", F.col("method_name").alias("name"), F.col("method_id.identifier").alias("id"), F.col("method_code").alias("code")))
    units = parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
    units = units.where("code is not null").select(F.col("unit_no").cast("long").alias("unit_no"), F.coalesce("name", F.try_element_at(F.split("id", r"\."), F.lit(-1))).alias("name"), "code")
    schema = pa.schema([("unit_no", pa.int64()), ("name", pa.string()), ("code", pa.string()), ("description", pa.string())])

    def run(batches):
        for batch in batches:
            found = [(n, name, code, d) for n, name, code in zip(*(c.to_pylist() for c in batch.columns)) if (d := description(code, name))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return spread(units).mapInArrow(run, "unit_no long, name string, code string, description string").distinct()
