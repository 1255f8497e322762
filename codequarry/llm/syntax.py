"""Source files that do not parse.

A file's repair cost is the least number of edits that make it a sentence of its
language. Cost 0 is decided by full recognisers (for Python the interpreter's memoising
chart parser, for the others parsers over whole texts); they also give the place where
the chart has no item left. Only rejected files are repaired: their tokens are reduced
to brackets, open literals, conflict marks and broken statements, balanced stretches
cancel, and an error-correcting chart over the rest finds the cheapest insertions and
deletions. The places of the edits tell truncation (at the end), merge conflict (marks)
and foreign content (most statements) apart.
"""

from __future__ import annotations

import ast
import configparser
import io
import json
import re
import sys
import threading
import tokenize
import tomllib
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import ecmascript

#: Extension to language.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "json": "json", "toml": "toml", "yml": "yaml", "yaml": "yaml", "ini": "ini", "env": "env"}
PAIRS = {")": "(", "]": "[", "}": "{"}
MARK = re.compile(r"^(?:<{7}(?: .*)?|={7}|\|{7}(?: .*)?|>{7}(?: .*)?)\r?$", re.M)


class Rejected(ValueError):
    """at: line of the first token that can't stand where it is, from 1."""

    def __init__(self, at: int):
        super().__init__(f"line {at}")
        self.at = at


def _python(text: str) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as e:
        raise Rejected(e.lineno or 1) from None
    except ValueError:
        raise Rejected(1) from None
    except (MemoryError, RecursionError):
        _python_statements(text)  # too deep for the interpreter's parser


def _python_statements(text: str) -> None:
    """For texts that exhaust the interpreter's parser: the tokens of the whole text, its brackets,
    and each logical line that the parser can take by itself."""
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (tokenize.TokenError, SyntaxError) as e:
        at = e.args[1][0] if isinstance(e, tokenize.TokenError) else e.lineno
        raise Rejected(at or 1) from None
    stack: list[str] = []
    line: list[str] = []
    start = 1
    for t in tokens:
        if t.type == tokenize.OP and t.string in "([{":
            stack.append(t.string)
        elif t.type == tokenize.OP and t.string in PAIRS and (not stack or stack.pop() != PAIRS[t.string]):
            raise Rejected(t.start[0])
        if t.type == tokenize.NEWLINE:
            code = " ".join(line)
            code = re.sub(r"^(?:elif|else|except|finally|case)\b.*", "pass", code) + (" pass" if code.endswith(":") and not re.match(r"(?:elif|else|except|finally|case|match)\b", code) else "")
            try:
                ast.parse(code if not code.startswith(("match ", "@")) else "pass")
            except (MemoryError, RecursionError):
                pass  # its tokens and brackets are all that is known
            except (SyntaxError, ValueError):
                raise Rejected(start) from None
            line = []
        elif t.type not in (tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            if not line:
                start = t.start[0]
            line.append(t.string)
    if stack:
        raise Rejected(text.count("\n") + 1)


def _deep(check: Callable[[str], object], text: str) -> None:
    """check(text) with room for as many calls as the text can nest."""
    raised: list[BaseException] = []

    def run():
        try:
            check(text)
        except BaseException as e:  # noqa: BLE001
            raised.append(e)

    limit, size = sys.getrecursionlimit(), threading.stack_size(1 << 28)
    sys.setrecursionlimit(max(limit, 64 * len(text) + 10_000))
    try:
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        sys.setrecursionlimit(limit)
        threading.stack_size(size)
    if raised:
        raise raised[0]


def _javascript(text: str) -> None:
    try:
        try:
            ecmascript.check(text)
        except RecursionError:
            _deep(ecmascript.check, text)
    except ecmascript.JsError as e:
        raise Rejected(text.count("\n", 0, e.at) + 1) from None


def _constant(name: str):
    raise ValueError(name)


def _json(text: str) -> None:
    try:
        json.loads(text, parse_constant=_constant)
    except json.JSONDecodeError as e:
        raise Rejected(e.lineno) from None
    except ValueError:
        raise Rejected(1) from None
    except RecursionError:
        _json_tokens(text)


JSON_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![\w.])|true\b|false\b|null\b)|$)')


def _json_tokens(text: str) -> None:
    """JSON of any depth, with a stack of its own. want: value, item (a value or the end of an
    empty array), key, name (a key or the end of an empty object), colon, next (what ends a value)."""
    stack: list[str] = []
    want, at = "value", 0
    while True:
        m = JSON_TOKEN.match(text, at)
        here = m[1] or ("s" if m[2] else "v" if m[3] else "") if m else None
        if here == "" and m.end() == len(text) and want == "next" and not stack:
            return
        at = m.end() if m else at
        if want in ("value", "item") and here in ("s", "v"):
            want = "next"
        elif want in ("value", "item") and here in ("[", "{"):
            stack.append(here)
            want = "item" if here == "[" else "name"
        elif want in ("key", "name") and here == "s":
            want = "colon"
        elif want == "colon" and here == ":":
            want = "value"
        elif want == "next" and here == "," and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif here and here in "]}" and stack and stack[-1] == PAIRS[here] and want in ("next", "item" if here == "]" else "name"):
            stack.pop()
            want = "next"
        else:
            raise Rejected(text.count("\n", 0, at) + 1)


def _toml(text: str) -> None:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        try:
            tomllib.loads(text)
        except RecursionError:
            _deep(tomllib.loads, text)
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"at line (\d+)", str(e))
        raise Rejected(int(m[1]) if m else text.count("\n") + 1) from None


def _ini(text: str) -> None:
    parser = configparser.RawConfigParser(strict=False, delimiters=("=", ":"))
    if m := MARK.search(text):
        raise Rejected(text.count("\n", 0, m.start()) + 1)
    try:
        parser.read_string(text)
    except configparser.ParsingError as e:
        raise Rejected(e.errors[0][0] if getattr(e, "errors", None) else getattr(e, "lineno", 1)) from None
    except configparser.Error as e:
        raise Rejected(getattr(e, "lineno", 1) or 1) from None


ENV_LINE = re.compile(r"^\s*(?:#.*|(?:export\s+)?[A-Za-z_][\w.-]*\s*=\s*(?:'[^']*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|(?![\"'`])[^\n]*)\s*(?:#.*)?|export\s+[A-Za-z_]\w*)?\s*$")
ENV_OPEN = re.compile(r"^\s*(?:export\s+)?[A-Za-z_][\w.-]*\s*=\s*([\"'`])")


def _env(text: str) -> None:
    lines = re.split(r"\r\n|\r|\n", text)
    n = 0
    while n < len(lines):
        if not ENV_LINE.match(lines[n]):
            m = ENV_OPEN.match(lines[n])
            # a quoted value may go on in the next lines
            end = next((k for k in range(n + 1, len(lines)) if m and re.search(rf"(?<!\\){m[1]}\s*(?:#.*)?$", lines[k])), None)
            if end is None:
                raise Rejected(n + 1)
            n = end
        n += 1


YAML_KEY = re.compile(r"(?:'(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"|[^\s\[\]{},#&*!|>'\"%@`?-](?:[^:#\n]|:(?=\S)|(?<=\S)#)*?|[?-](?=\S)(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?)\s*:(?=\s|$)")
YAML_PLAIN_START = re.compile(r"[^\s,\[\]{}#&*!|>'\"%@`:?-]|[:?-](?=\S)")


def _yaml_flow(lines: list[str], n: int, col: int) -> tuple[int, int]:
    """End of a flow collection that begins at lines[n][col].

    Of each open collection: its bracket and what its last entry has so far, "" (nothing), "node"
    (a complete scalar or collection), "plain" (a plain scalar, which may go on), ":" (a
    key and its colon), "pair" and "pair plain" (a key with its value)."""
    stack: list[list[str]] = []
    while n < len(lines):
        line = lines[n]
        if stack and (MARK.match(line) or re.match(r"(?:---|\.\.\.)(?:\s|$)", line)):
            raise Rejected(n + 1)
        while col < len(line):
            c = line[col]
            if c in " \t":
                col += 1
                continue
            if c == "#" and (col == 0 or line[col - 1] in " \t"):
                break
            top = stack[-1] if stack else None
            if c in "]}":
                if not stack or stack.pop()[0] + c not in ("[]", "{}"):
                    raise Rejected(n + 1)
                col += 1
                if not stack:
                    return n, col
                stack[-1][1] = "pair" if stack[-1][1] == "in pair" else "node"
            elif c == ",":
                if top[1] == "":
                    raise Rejected(n + 1)
                top[1] = ""
                col += 1
            elif c == ":" and (top[1] == "node" or col + 1 >= len(line) or line[col + 1] in " \t,[]{}"):
                if top[1] not in ("", "node", "plain"):
                    raise Rejected(n + 1)
                top[1] = ":"
                col += 1
            elif c in "[{":
                if top is not None:
                    if top[1] not in ("", ":"):
                        raise Rejected(n + 1)
                    top[1] = "in" if top[1] == "" else "in pair"
                stack.append([c, ""])
                col += 1
            elif c in "\"'" and top[1] in ("", ":"):
                n, col = _yaml_quoted(lines, n, col)
                line = lines[n]
                top[1] = "node" if top[1] == "" else "pair"
            elif c in "&!" and top[1] in ("", ":") and (m := re.compile(r"[&!][^\s,\[\]{}]*(?=[\s,\[\]{}]|$)").match(line, col)):
                col = m.end()
            elif c == "*" and top[1] in ("", ":") and (m := re.compile(r"\*[^\s,\[\]{}]+").match(line, col)):
                col = m.end()
                top[1] = "node" if top[1] == "" else "pair"
            elif c == "?" and top[1] == "" and (col + 1 >= len(line) or line[col + 1] in " \t"):
                col += 1
            elif top[1] in ("", ":", "plain", "pair plain"):
                if top[1] in ("", ":") and not re.compile(r"[^\s,\[\]{}#&*!|>'\"%@`:?-]|[:?-](?=[^\s,\[\]{}])").match(line, col):
                    raise Rejected(n + 1)
                col = re.compile(r"(?:[^,\[\]{}:#\s]|:(?=[^\s,\[\]{}])|(?<=\S)#)+|.").match(line, col).end()
                top[1] = {"": "plain", ":": "pair plain"}.get(top[1], top[1])
            else:
                raise Rejected(n + 1)
        n, col = n + 1, 0
    raise Rejected(len(lines))


#: What may follow a backslash between double quotes (at the end of a line: a joined line).
YAML_ESCAPE = re.compile(r"\\(?:[0abt\tnvfre \"/\\N_LP]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|$)")


def _yaml_quoted(lines: list[str], n: int, col: int) -> tuple[int, int]:
    """End of a quoted scalar that begins at lines[n][col]."""
    quote, start = lines[n][col], n
    col += 1
    while n < len(lines):
        line = lines[n]
        if n > start and (MARK.match(line) or line[:3] in ("---", "...") and not line[3:].strip()):
            raise Rejected(n + 1)
        while col < len(line):
            if line[col] == "\\" and quote == '"':
                if not (m := YAML_ESCAPE.match(line, col)):
                    raise Rejected(n + 1)
                col = m.end()
                continue
            if line[col] == quote:
                if quote == "'" and line[col + 1 : col + 2] == "'":
                    col += 2
                    continue
                return n, col + 1
            col += 1
        n, col = n + 1, 0
    raise Rejected(len(lines))


def _yaml(text: str) -> None:
    """Block structure, scalars and flow collections of YAML streams."""
    lines = re.split(r"\r\n|\r|\n", text)
    blocks: list[tuple[int, str]] = []  # indent and kind of the open blocks
    pending = True  # the last entry has no value yet, so a deeper block may follow
    plain: int | None = None  # lines deeper than this go on with a plain scalar
    root_ended = False
    n = 0
    while n < len(lines):
        line = lines[n]
        body = line.strip()
        if not body or body.startswith("#"):
            n += 1
            continue
        if MARK.match(line):
            raise Rejected(n + 1)
        if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
            blocks, pending, plain, root_ended = [], True, None, False
            if line[3:].strip() and not line[3:].strip().startswith("#"):
                lines[n] = "   " + line[3:]
            else:
                n += 1
            continue
        if line.startswith("%") and not blocks and not root_ended:
            n += 1
            continue
        col = len(line) - len(line.lstrip(" "))
        if line[col] == "\t":
            raise Rejected(n + 1)
        if plain is not None and col > plain:
            if YAML_KEY.match(line, col) or re.search(r":(?:\s|$)", re.split(r"\s#", line[col:])[0]):
                raise Rejected(n + 1)
            n += 1
            continue
        plain = None
        if root_ended:
            raise Rejected(n + 1)
        while blocks and blocks[-1][0] > col:
            blocks.pop()
        nested = False
        while True:
            kind = "seq" if re.match(r"-(?:\s|$)", line[col:]) else "map" if re.match(r"\?(?:\s|$)", line[col:]) or YAML_KEY.match(line, col) else "scalar"
            if nested or not blocks:
                blocks.append((col, kind))
            elif blocks[-1][0] == col:
                if blocks[-1][1] != kind:
                    if kind == "seq" and blocks[-1][1] == "map" and pending:
                        blocks.append((col, "seq"))  # may stand at its key's indent
                    elif kind == "map" and len(blocks) > 1 and blocks[-2] == (col, "map"):
                        blocks.pop()
                    else:
                        raise Rejected(n + 1)
                elif kind == "scalar":
                    raise Rejected(n + 1)
            elif pending:
                blocks.append((col, kind))
            else:
                raise Rejected(n + 1)
            if kind != "seq":
                break
            col += 1
            while line[col : col + 1] == " ":
                col += 1
            if not line[col:].strip() or line[col] == "#":
                break
            nested = True
        if kind == "seq" or kind == "map" and line[col] == "?":
            pending = True
            n += 1
            continue
        entry = blocks[-1][0]
        if kind == "map":
            col = YAML_KEY.match(line, col).end()
        while m := re.match(r"\s*(?:&[^\s,\[\]{}]+|![^\s,\[\]{}]*)(?=\s|$)|\s+(?=\S)", line[col:]):
            col += m.end()
        rest = line[col:]
        if not rest.strip() or rest.startswith("#") and line[col - 1] in " \t":
            pending = True
            n += 1
            continue
        pending = False
        root_ended = kind == "scalar" and len(blocks) == 1
        if rest[0] in "|>":
            if not re.match(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)\s*(?:\s#.*)?$", rest):
                raise Rejected(n + 1)
            floor = entry if kind == "map" else blocks[-2][0] if len(blocks) > 1 else -1
            n += 1
            while n < len(lines) and (not lines[n].strip() or len(lines[n]) - len(lines[n].lstrip(" ")) > floor):
                n += 1
            continue
        if rest[0] in "[{\"'":
            n, col = (_yaml_flow if rest[0] in "[{" else _yaml_quoted)(lines, n, col)
            after = lines[n][col:]
            if after.strip() and not re.match(r"\s+#", after):
                raise Rejected(n + 1)
        elif rest[0] == "*":
            if not re.match(r"\*[^\s,\[\]{}]+\s*(?:\s#.*)?$", rest):
                raise Rejected(n + 1)
        else:
            value = re.split(r"\s#", rest)[0].rstrip()
            if not YAML_PLAIN_START.match(rest) or re.search(r":(?:\s|$)", value):
                raise Rejected(n + 1)
            plain = entry if kind == "map" else blocks[-2][0] if len(blocks) > 1 else -1
            root_ended = False if plain == -1 else root_ended
        n += 1


RECOGNISERS = {"python": _python, "javascript": _javascript, "json": _json, "toml": _toml, "yaml": _yaml, "ini": _ini, "env": _env}


def recognise(language: str, text: str) -> int:
    """0 for a sentence of the language, else the line where it fails, from 1."""
    try:
        RECOGNISERS[language](text.removeprefix("﻿"))
    except Rejected as e:
        return max(1, e.at)
    return 0


# ---------------------------------------------------------------- repair

QUOTES = {"python": ('"""', "'''", '"', "'"), "javascript": ("`", '"', "'"), "json": ('"',), "toml": ('"""', "'''", '"', "'"), "yaml": ('"', "'"), "ini": (), "env": ('"', "'")}
COMMENT = {"python": "#", "javascript": "//", "toml": "#", "yaml": "#", "ini": ";", "env": "#"}


def skeleton(language: str, text: str) -> tuple[list[tuple[str, int]], int | None]:
    """(brackets with their lines, line of a literal that is still open at the end or None)."""
    out: list[tuple[str, int]] = []
    quotes, comment = QUOTES[language], COMMENT.get(language)
    i, line, size = 0, 1, len(text)
    while i < size:
        c = text[i]
        if c == "\n":
            line += 1
            i += 1
            continue
        quote = next((q for q in quotes if text.startswith(q, i)), None)
        if quote:
            j = i + len(quote)
            while j < size and not text.startswith(quote, j):
                if len(quote) == 1 and quote != "`" and text[j] == "\n":
                    break
                j += 2 if text[j] == "\\" else 1
            if j >= size:
                return out, line
            line += text.count("\n", i, j)
            i = j + (len(quote) if text.startswith(quote, j) else 0)
            continue
        if comment and text.startswith(comment, i):
            j = text.find("\n", i)
            i = size if j < 0 else j
            continue
        if language == "javascript" and text.startswith("/*", i):
            j = text.find("*/", i)
            if j < 0:
                return out, line
            line += text.count("\n", i, j)
            i = j + 2
            continue
        if c in "([{" or c in ")]}":
            out.append((c, line))
        i += 1
    return out, None


def balance(brackets: list[tuple[str, int]], last: int) -> list[int]:
    """Lines of the cheapest insertions and deletions that balance the brackets.

    Matching neighbours cancel and what has no partner is an edit, which keeps the least cost.
    The rest goes through a chart, whatever its length: cost[i, j] is the least number of
    edits that balance items i..j; an item is deleted (or its partner inserted) for 1, or
    joined with a matching one. Along j the cost goes up or down by 1 at each item, so a row
    is kept as the places where it turns, and takes time and memory by their number."""
    rest, edits = unpaired(brackets, last)
    n = len(rest)
    closers = {PAIRS[c]: np.flatnonzero(np.array([b[0] == c for b in rest], bool)) for c in PAIRS}
    rows: list[np.ndarray] = [np.empty(0, np.uint8)] * n + [np.array([n], np.int32)]
    joins: list[list[tuple[int, int]]] = [[]] * n
    x, y = np.array([n]), np.array([0])
    for i in range(n - 1, -1, -1):
        below = x, y
        x, y = (np.concatenate([[i], x[1:]]), np.concatenate([[0], y[1:] + 1])) if i < n - 1 else (np.array([i, n]), np.array([0, 1]))
        if rest[i][0] in closers:
            join = join_items if 16 * len(x) > n - i else join_turns
            x, y, joins[i] = join(i, below, x, y, closers[rest[i][0]], rows)
        rows[i] = packed(x, n)
    todo = [(0, n)]
    while todo:
        i, j = todo.pop()
        if i >= j:
            continue
        least = height(rows[i], i, j)
        if least == height(rows[i + 1], i + 1, j) + 1:
            edits.append(edit_line(rest[i], last))
            todo.append((i + 1, j))
            continue
        k = next(k for k, cost in joins[i] if k < j and least == cost + height(rows[k + 1], k + 1, j))
        todo += [(i + 1, k), (k + 1, j)]
    return sorted(edits)


def edit_line(bracket: tuple[str, int], last: int) -> int:
    """The line of a bracket's edit: an opener is closed at the end."""
    return last if bracket[0] in "([{" else bracket[1]


def unpaired(brackets: list[tuple[str, int]], last: int) -> tuple[list[tuple[str, int]], list[int]]:
    """(what is left without matching neighbours and brackets that no other can match, lines of the
    latter), in rounds for as long as each takes more than a hundredth."""
    rest, edits, size = brackets, [], 0
    while size == 0 or len(rest) < 0.99 * size:
        size = len(rest)
        stack: list[tuple[str, int]] = []
        for b in rest:
            if stack and b[0] in PAIRS and stack[-1][0] == PAIRS[b[0]]:
                stack.pop()
            else:
                stack.append(b)
        first: dict[str, int] = {}
        final: dict[str, int] = {}
        for k, b in enumerate(stack):
            if b[0] in PAIRS:
                final[PAIRS[b[0]]] = k
            else:
                first.setdefault(b[0], k)
        rest = []
        for k, b in enumerate(stack):
            if k < final.get(b[0], -1) if b[0] not in PAIRS else first.get(PAIRS[b[0]], k) < k:
                rest.append(b)
            else:
                edits.append(edit_line(b, last))
        if not rest:
            break
    return rest, edits


def packed(x: np.ndarray, n: int) -> np.ndarray:
    """A row of the chart by its turns, or by one bit an item, set where the cost goes up, if that is less."""
    return x.astype(np.int32) if 32 * len(x) < n - x[0] else np.packbits(steps_between(x))


def steps_between(x: np.ndarray) -> np.ndarray:
    """Whether a row with such turns goes up at each item."""
    return np.repeat(np.arange(len(x) - 1) % 2 == 0, np.diff(x))


def steps_of(row: np.ndarray, i: int, n: int) -> np.ndarray:
    """Whether row i goes up at each item from i to n."""
    return steps_between(row) if row.dtype == np.int32 else np.unpackbits(row, count=n - i)


def turns(row: np.ndarray, i: int, n: int) -> np.ndarray:
    """Where row i turns, its ends among them."""
    if row.dtype == np.int32:
        return row.astype(np.int64)
    steps = steps_of(row, i, n)
    return np.concatenate([[i], np.flatnonzero(steps[1:] != steps[:-1]) + i + 1, [n]])


def heights(x: np.ndarray) -> np.ndarray:
    """Costs at the turns: 0 at the first, then up and down in turn."""
    steps = np.diff(x)
    steps[1::2] *= -1
    return np.concatenate([[0], np.cumsum(steps)])


def height(row: np.ndarray, i: int, j: int) -> int:
    """cost[i, j] of row i."""
    if row.dtype == np.int32:
        return int(np.interp(j, row, heights(row)))
    return 2 * int(np.unpackbits(row, count=j - i).sum(dtype=np.int64)) - (j - i)


def costs(row: np.ndarray, i: int, n: int, first: int = 0) -> np.ndarray:
    """Row i from i to n, first at i."""
    out = np.empty(n - i + 1, np.int32)
    out[0] = first
    np.multiply(steps_of(row, i, n), 2, out=out[1:], dtype=np.int32, casting="unsafe")
    out[1:] -= 1
    return np.cumsum(out, dtype=np.int32, out=out)


def join_items(i: int, below: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, closers: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The turns of row i with its joins, item by item; the same as join_turns, for rows that turn often.
    below: row i + 1; x, y: row i with its item deleted; rows: those after i."""
    n, found = len(rows) - 1, []
    under = costs(rows[i + 1], i + 1, n)
    row = np.concatenate([[0], under + 1]).astype(np.int32)
    near = closers[np.searchsorted(closers, i + 1) :]
    while len(near := near[row[near + 1 - i] == under[near - i - 1] + 2]):
        k = int(near[0])
        found.append((k, int(under[k - i - 1])))
        np.minimum(row[k + 1 - i :], costs(rows[k + 1], k + 1, n, found[-1][1]), out=row[k + 1 - i :])
        near = near[1:]
    up = row[1:] > row[:-1]
    at = np.concatenate([[0], np.flatnonzero(up[1:] != up[:-1]) + 1, [n - i]])
    return at + i, row[at].astype(np.int64), found


def join_turns(i: int, below: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, closers: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The turns of row i with its joins, from those of the rows below, and the joins that lower it, as
    (closer, cost between). below: row i + 1; x, y: row i with its item deleted; rows: those after i."""
    n, found, k = len(rows) - 1, [], i
    while (k := next_join(below, (x, y), closers, k + 1)) is not None:
        cost = int(np.interp(k, *below))
        found.append((k, cost))
        after = turns(rows[k + 1], k + 1, n)
        x, y = lower(x, y, after, heights(after) + cost)
    return x, y, found


def next_join(below: tuple[np.ndarray, np.ndarray], row: tuple[np.ndarray, np.ndarray], closers: np.ndarray, start: int) -> int | None:
    """The first closer k from start with which joining the row's item costs less than what the row
    has at k + 1; no other can be the first cheapest anywhere.

    row(k + 1) - below(k) is 2 there and never more, so it is 2 between two turns if it is at both."""
    n = int(below[0][-1])
    if not len(closers) or closers[-1] < start:
        return None
    places = np.concatenate([[start, n - 1], below[0], row[0] - 1])
    places = np.unique(places[(places >= start) & (places < n)])
    less = np.interp(places + 1, *row) - np.interp(places, *below) == 2
    at = np.flatnonzero(less)
    until = np.where(less[np.minimum(at + 1, len(places) - 1)], places[np.minimum(at + 1, len(places) - 1)], places[at])
    found = np.searchsorted(closers, places[at])
    near = closers[np.minimum(found, len(closers) - 1)]
    good = np.flatnonzero((near >= places[at]) & (near <= until))
    return int(near[good[0]]) if len(good) else None


def lower(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns of the lesser of a row and another that begins within it."""
    k = x2[0] - 1
    head = x[x < k]
    both = np.union1d(x[x > k], x2)
    gap = np.interp(both, x, y) - np.interp(both, x2, y2)
    # even, and 2 a step at most, so that rows meet at an item
    cross = np.flatnonzero(gap[:-1] * gap[1:] < 0)
    both = np.sort(np.concatenate([both, both[cross] + (np.abs(gap[cross]) // 2).astype(np.int64)]))
    xs = np.concatenate([head, [k], both])
    ys = np.concatenate([np.interp(np.append(head, k), x, y), np.minimum(np.interp(both, x, y), np.interp(both, x2, y2))]).astype(np.int64)
    slope = np.diff(ys) // np.diff(xs)
    keep = np.concatenate([[True], slope[1:] != slope[:-1], [True]])
    return xs[keep], ys[keep]


def broken_lines(language: str, text: str, first: int) -> list[int]:
    """Lines that can't be part of the language by themselves, the failing one at least."""
    bad = []
    for n, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if not s:
            continue
        if language == "python":
            piece = s + (" pass" if s.endswith(":") else "")
            piece = re.sub(r"^(?:elif|else|except|finally)\b", lambda m: {"elif": "if"}.get(m[0], "if x"), piece) if not piece.startswith("except") else "pass"
            ok = s[0] in "#)]}\"'" or s[-1] in ",([{\\" or recognise("python", piece) == 0
        elif language == "javascript":
            ok = s[0] in "*/)]}" or s[-1] in ",([{" or recognise("javascript", s) == 0
        elif language == "json":
            ok = bool(re.fullmatch(r'[\[\]{},]+|(?:"(?:[^"\\]|\\.)*"\s*:\s*)?(?:"(?:[^"\\]|\\.)*"|[-\d.eE+]+|true|false|null|[\[{][\]}]?)\s*,?', s))
        else:
            ok = recognise(language, ("[x]\n" if language == "ini" and not s.startswith("[") else "") + s) == 0 or s[0] in "]}\"'" or s[-1] in ",[{("
        if not ok:
            bad.append(n)
    return bad or [first]


def repair(language: str | None, text: str | None) -> tuple[int, str | None, list[int]]:
    """(edit cost, kind, lines of the edits). Kinds: truncation, conflict, mismatch, syntax."""
    if language is None or text is None:
        return 0, None, []
    failed = recognise(language, text)
    if not failed:
        return 0, None, []
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    last = max((n for n, x in enumerate(lines, 1) if x.strip()), default=1)
    marks = [text.count("\n", 0, m.start()) + 1 for m in MARK.finditer(text)]
    if marks and any(lines[n - 1].startswith(("<<<<<<<", ">>>>>>>")) for n in marks) | (len(marks) == 1):
        return len(marks), "conflict", marks
    # what nearly any text satisfies tells nothing
    others = [x for x in RECOGNISERS if x not in (language, "env", "ini", "yaml") and not (x == "javascript" and len(lines) < 3)]
    if any(recognise(x, text) == 0 for x in others):
        bad = broken_lines(language, text, failed)
        return len(bad), "mismatch", bad
    brackets, open_at = skeleton(language, text)
    edits = balance(brackets, last) + [last] * (open_at is not None)
    bad = broken_lines(language, text, failed)
    share = len(bad) / max(1, sum(bool(x.strip()) for x in lines))
    if share > 0.5:
        return len(edits) + len(bad), "mismatch", sorted({*edits, *bad})
    at_end = failed >= last or open_at is not None or edits and all(n >= last for n in edits)
    if not edits:
        edits = [failed]
    return len(edits), "truncation" if at_end else "syntax", sorted(set(edits))


# ---------------------------------------------------------------- tables


def _languages(files: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return files.select(F.col("file_no").cast("long").alias("file_no"), "repo_id", F.try_element_at(table, extension).alias("language"), F.col("file_content").alias("text"))


def syntax_errors(files: DataFrame) -> DataFrame:
    """Distinct (file_no, repo_id, language, cost, kind, lines) of the files whose content is
    not valid for the language of their extension, so that cost is above 0.

    Null contents and unknown extensions are never cases, an empty text is one where the
    language needs a value (JSON); repeated rows count once. Files are judged where they
    are read, only the cases are shuffled.
    """
    schema = pa.schema([("file_no", pa.int64()), ("repo_id", pa.string()), ("language", pa.string()), ("cost", pa.int64()), ("kind", pa.string()), ("lines", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            found = []
            for no, repo, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                cost, kind, lines = repair(language, text)
                if cost:
                    found.append((no, repo, language, cost, kind, lines))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    texts = spread(_languages(files)).where("language is not null and text is not null")
    return texts.mapInArrow(run, "file_no long, repo_id string, language string, cost long, kind string, lines array<long>").distinct()


def error_rates(files: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_broken, share) over the files with content, null repo_id too."""
    all_files = _languages(files).where("language is not null and text is not null").select("file_no", "repo_id", "language").distinct()
    total = all_files.groupBy("repo_id", "language").agg(F.count("*").alias("n_files"))
    broken = syntax_errors(files).select("file_no", "repo_id", "language").distinct().groupBy("repo_id", "language").agg(F.count("*").alias("n_broken"))
    both = total.join(broken.select(F.col("repo_id").alias("r"), F.col("language").alias("x"), "n_broken"), F.expr("repo_id <=> r and language = x"), "left")
    return both.select("repo_id", "language", "n_files", F.coalesce("n_broken", F.lit(0)).alias("n_broken"), (F.coalesce("n_broken", F.lit(0)) / F.col("n_files")).alias("share"))
