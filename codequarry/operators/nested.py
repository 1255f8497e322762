"""Deeply nested records to related flat tables with parent-child links.

Structs, arrays and maps are flattened by Catalyst's generators; their ordinals become
the link columns. JSON text inside them is flattened by a structural index built for a
whole Arrow batch at once: bitmaps of quotes, brackets and delimiters, strings found by
the parity of unescaped quotes, nesting depth by prefix sums, member spans by binary
search among the delimiters of one depth. The same index says which texts are JSON: every
token is looked up in a table by its kind, the token before it and the container around
it, so depth costs nothing and no text is parsed as a whole. Texts and members that were
encoded once more as text are decoded and indexed again, all of a batch together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

QUOTE, BACKSLASH, COMMA, COLON = b'"\\,:'
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32]] = True
OPEN, CLOSE = np.zeros(256, bool), np.zeros(256, bool)
OPEN[list(b"[{")] = True
CLOSE[list(b"]}")] = True


#: Bytes of text that are indexed at once (one longer text is indexed by itself).
INDEX_BYTES = 1 << 20
#: Levels below a member from which it is given as its stored text.
DEEP = 200

# What follows what. Kinds of tokens: { [ } ] , : string other; a string that is a name is NAME,
# START is before the first one. Containers: root, object, array.
START, NAME = 0, 9
KINDS = {c: k for k, c in enumerate("{[}],:\"", 1)}
KIND = np.full(256, 8, np.uint8)
KIND[[ord(c) for c in KINDS]] = list(KINDS.values())
FOLLOWS = np.zeros((10, 3, 9), bool)
_VALUES = [1, 2, 7, 8]
FOLLOWS[START, 0, _VALUES] = FOLLOWS[2, 2, _VALUES] = FOLLOWS[5, 2, _VALUES] = FOLLOWS[6, 1, _VALUES] = True
FOLLOWS[1, 1, [7, 3]] = FOLLOWS[5, 1, 7] = FOLLOWS[NAME, 1, 6] = FOLLOWS[2, 2, 4] = True
for _k in (3, 4, 7, 8):  # what ends a value
    FOLLOWS[_k, 1, [5, 3]] = FOLLOWS[_k, 2, [5, 4]] = True
ESCAPED, HEX = np.zeros(256, bool), np.zeros(256, bool)
ESCAPED[list(b'"\\/bfnrtu')] = True
HEX[list(b"0123456789abcdefABCDEF")] = True
PLAIN = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")


class StructuralIndex:
    """Structure of many JSON texts in one buffer; a node is (text number, start, end)."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8) if texts else np.zeros(0, np.uint8)
        place = np.arange(len(buf), dtype=np.int32 if len(buf) < 1 << 31 else np.int64)
        slash = buf == BACKSLASH
        # length of the run of backslashes that ends right before each byte
        last = np.maximum.accumulate(np.where(slash, place.dtype.type(-1), place)) if len(buf) else place
        before = np.zeros_like(place)
        before[1:] = (place - last)[:-1]
        escape = slash & (before % 2 == 0)
        quote = (buf == QUOTE) & (before % 2 == 0)
        inside = self._since_start(np.cumsum(quote, dtype=place.dtype)) & 1
        free = (inside == 0) & ~quote
        opened, closed = OPEN[buf] & free, CLOSE[buf] & free
        # depth of a bracket is the depth of what it encloses
        deep = self._since_start(np.cumsum(opened.view(np.int8) - closed.view(np.int8), dtype=place.dtype))
        self.buf = buf
        self.commas = self._by_depth((buf == COMMA) & free, deep)
        self.colons = self._by_depth((buf == COLON) & free, deep)
        self.deep = deep
        self.valid = self._grammar(free, quote & (inside == 1), opened, closed, escape & (inside == 1), inside)

    def _grammar(self, free, strings, opened, closed, escape, inside) -> np.ndarray:
        """Whether each text is one JSON value."""
        buf, bad = self.buf, np.zeros(len(self.starts), bool)
        if not len(buf):
            return ~bad
        other = free & ~BLANK[buf] & (KIND[buf] == 8)
        begin = other.copy()
        begin[1:] &= ~other[:-1]
        begin[self.starts] = other[self.starts]
        at = np.flatnonzero(free & (KIND[buf] < 7) | strings | begin)
        text = np.searchsorted(self.ends, at, "right")
        kind = KIND[buf[at]].copy()
        # the container of a token is the last opened bracket of its depth
        depth = self.deep[at] - opened[at] + closed[at]
        opens = np.flatnonzero(opened[at])
        order = np.lexsort((np.concatenate([at[opens], at]), np.concatenate([self.deep[at[opens]], depth])))
        source = np.where(order < len(opens), order, -1)
        level = np.concatenate([self.deep[at[opens]], depth])[order]
        latest = np.maximum.accumulate(np.where(source >= 0, np.arange(len(order)), -1))
        around = np.zeros(len(at), np.uint8)
        ask = np.flatnonzero((order >= len(opens)) & (level > 0))
        known = ask[(latest[ask] >= 0) & (level[np.maximum(latest[ask], 0)] == level[ask])]
        around[order[known] - len(opens)] = kind[opens[source[latest[known]]]]
        first = np.ones(len(at), bool)
        first[1:] = text[1:] != text[:-1]
        state = kind.copy()
        before = np.where(first, START, np.concatenate([[START], kind[:-1]]))
        state[(kind == 7) & (around == 1) & ((before == 1) | (before == 5))] = NAME
        before = np.where(first, START, np.concatenate([[START], state[:-1]]))
        bad[text[~FOLLOWS[before, around, kind]]] = True
        last = np.flatnonzero(np.concatenate([first[1:], [True]])) if len(at) else at
        bad[text[last[~np.isin(state[last], (3, 4, 7, 8))]]] = True
        some = np.zeros(len(bad), bool)
        some[text] = True
        # what is still open at the end, control characters and wrong escapes in strings
        bad |= ~some | (self.deep[self.ends - 1] != 0) | (inside[self.ends - 1] != 0)
        wrong = (inside == 1) & (buf < 32)
        e = np.flatnonzero(escape)
        after = np.concatenate([buf, np.zeros(5, np.uint8)])
        wrong[e] |= ~ESCAPED[after[e + 1]]
        u = e[after[e + 1] == ord("u")]
        for k in range(2, 6):
            wrong[u] |= ~HEX[after[u + k]]
        bad[np.searchsorted(self.ends, np.flatnonzero(wrong), "right")] = True
        # numbers and words
        stop = np.flatnonzero(other & ~np.concatenate([other[1:], [False]]) | other & (np.isin(np.arange(len(buf)), self.ends - 1))) + 1
        good: dict[bytes, bool] = {}
        for n, a, b in zip(text[kind == 8].tolist(), at[kind == 8].tolist(), stop.tolist()):
            word = self.raw[a:b]
            if word not in good:
                good[word] = PLAIN.fullmatch(word) is not None
            if not good[word]:
                bad[n] = True
        return ~bad

    def _since_start(self, total: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return total
        base = np.where(self.starts > 0, total[np.maximum(self.starts - 1, 0)], 0).astype(total.dtype)
        return total - np.repeat(base, self.ends - self.starts)

    @staticmethod
    def _by_depth(mask: np.ndarray, deep: np.ndarray) -> dict[int, np.ndarray]:
        at = np.flatnonzero(mask)
        depth = deep[at]
        order = np.argsort(depth, kind="stable")
        at, depth = at[order], depth[order]
        edges = np.flatnonzero(np.diff(depth)) + 1
        return {int(d[0]): a for a, d in zip(np.split(at, edges), np.split(depth, edges)) if len(a)}

    def trim(self, start: int, end: int) -> tuple[int, int]:
        while start < end and BLANK[self.buf[start]]:
            start += 1
        while end > start and BLANK[self.buf[end - 1]]:
            end -= 1
        return start, end

    def node(self, n: int) -> tuple[int, int]:
        return self.trim(int(self.starts[n]), int(self.ends[n]))

    def kind(self, span: tuple[int, int]) -> str:
        """{ [ " or another first byte; empty for nothing."""
        return chr(self.buf[span[0]]) if span[0] < span[1] else ""

    def text(self, span: tuple[int, int]) -> bytes:
        return self.raw[span[0] : span[1]]

    def _between(self, table: dict[int, np.ndarray], depth: int, start: int, end: int) -> list[int]:
        at = table.get(depth)
        return [] if at is None else at[np.searchsorted(at, start) : np.searchsorted(at, end)].tolist()

    def items(self, span: tuple[int, int]) -> list[tuple[int, int]]:
        """Spans of an array's or object's parts, in stored order."""
        start, end = span
        inner = self.trim(start + 1, end - 1)
        if inner[0] >= inner[1]:
            return []
        cuts = self._between(self.commas, int(self.deep[start]), start, end)
        return [self.trim(a, b) for a, b in zip([start + 1, *(c + 1 for c in cuts)], [*cuts, end - 1])]

    def members(self, span: tuple[int, int]) -> dict[str, tuple[int, int]]:
        """Name to value span of an object; of a repeated name the last."""
        depth, out = int(self.deep[span[0]]), {}
        for a, b in self.items(span):
            colon = self._between(self.colons, depth, a, b)
            if colon:
                out[json.loads(self.raw[slice(*self.trim(a, colon[0]))])] = self.trim(colon[0] + 1, b)
        return out


Node = tuple[StructuralIndex, tuple[int, int]]


def decode_nested(nodes: list[Node | None]) -> list[Node | None]:
    """The nodes, with each that is text holding JSON replaced by what it holds; text that
    holds none becomes None. All texts of one round are indexed together."""
    while True:
        again = [(i, json.loads(x[0].text(x[1])).encode("utf-8", "surrogatepass")) for i, x in enumerate(nodes) if x and x[0].kind(x[1]) == '"']
        if not again:
            return nodes
        nodes = list(nodes)
        fresh = StructuralIndex([t for _, t in again])
        for k, (i, _) in enumerate(again):
            nodes[i] = (fresh, fresh.node(k)) if fresh.valid[k] else None


def roots(texts: list[str | None]) -> list[Node | None]:
    """A node for each text that can be read as JSON, decoded where it was encoded twice."""
    keep = [i for i, t in enumerate(texts) if t is not None]
    index = StructuralIndex([texts[i].removeprefix("\ufeff").encode("utf-8", "surrogatepass") for i in keep])
    out: list[Node | None] = [None] * len(texts)
    for k, i in enumerate(keep):
        if index.valid[k]:
            out[i] = (index, index.node(k))
    return decode_nested(out)


def chunks(texts: list[str | None], size: int = INDEX_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most size characters together, or of one text."""
    start = total = 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total > size and k > start:
            yield start, k
            start, total = k, len(t or "")
    if start < len(texts):
        yield start, len(texts)


def member(nodes: list[Node | None], name: str) -> list[Node | None]:
    """The named member of each object, decoded; None where there is none."""
    got = []
    for x in nodes:
        span = x[0].members(x[1]).get(name) if x and x[0].kind(x[1]) == "{" else None
        got.append((x[0], span) if span else None)
    return decode_nested(got)


def value(x: Node | None):
    """What a node holds; members nested deeper than DEEP levels as their stored text."""
    if x is None:
        return None
    index, (a, b) = x
    if int(index.deep[a:b].max()) - int(index.deep[a]) <= DEEP:
        return _loads(index.raw[a:b])
    if index.kind((a, b)) != "{":
        return index.raw[a:b].decode("utf-8", "surrogatepass")
    return {name: value((index, span)) if index.deep[slice(*span)].max() - index.deep[a] <= DEEP else index.raw[slice(*span)].decode("utf-8", "surrogatepass") for name, span in index.members((a, b)).items()}


def _loads(raw: bytes):
    try:
        return json.loads(raw)
    except ValueError:  # a whole number of more digits than the interpreter converts
        return json.loads(raw, parse_int=float)


def children(nodes: list[Node | None], name: str) -> Iterator[tuple[int, str | None, int, dict]]:
    """(row, key, ordinal, object) below the named member of each row's root.

    A list of objects gives key None; an object of lists gives its keys, and a lone
    object in place of a list counts as item 0. Items that are no objects are passed
    over, but count.
    """
    tops = member(nodes, name)
    flat: list[tuple[int, str | None, Node]] = []
    for row, x in enumerate(tops):
        if x is None:
            continue
        kind = x[0].kind(x[1])
        if kind == "{":
            flat += [(row, key, (x[0], span)) for key, span in x[0].members(x[1]).items()]
        elif kind == "[":
            flat.append((row, None, x))
    for (row, key, _), x in zip(flat, decode_nested([n for *_, n in flat])):
        if x is None:
            continue
        kind = x[0].kind(x[1])
        if kind == "{":
            yield row, key, 0, value(x)
        elif kind == "[":
            for k, item in enumerate(decode_nested([(x[0], s) for s in x[0].items(x[1])])):
                if item is not None and item[0].kind(item[1]) == "{":
                    yield row, key, k, value(item)


def text_of(x) -> str | None:
    """A scalar as text, anything deeper as JSON text, null as null."""
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def whole(x) -> int | None:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 2**63 else None


def real(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


# ---------------------------------------------------------------- the levels of test histories


def records(df: DataFrame) -> DataFrame:
    """Level 0, one row per fut_no. Null structs give null columns; a null history counts 0 rounds."""
    m = "file.file_module"
    return df.select(
        "fut_no", "unit_no", F.col("function_id.identifier").alias("function_id"), F.col(f"{m}.module_id.identifier").alias("module_id"),
        F.col(f"{m}.module_type").alias("module_type"), *(F.col(f"{m}.repo.{c}").alias(c) for c in ("repo_org", "repo_name", "repo_id", "local_repo_path")),
        F.coalesce(F.size("test_history.history"), F.lit(0)).cast("long").alias("n_rounds"),
    ).withColumn("n_rounds", F.greatest("n_rounds", F.lit(0).cast("long"))).distinct()


def _rounds(df: DataFrame) -> DataFrame:
    return df.select("fut_no", F.posexplode("test_history.history").alias("pos", "r")).select("fut_no", F.col("pos").cast("long").alias("round_no"), "r")


def rounds(df: DataFrame) -> DataFrame:
    """Level 1, one row per round of a record, null rounds too. Link: fut_no."""
    return _rounds(df).select("fut_no", "round_no", *(F.col(f"r.{c}").alias(c) for c in ("operation", "gen_model", "gen_date", "exec_stats"))).distinct()


def tests(df: DataFrame) -> DataFrame:
    """Level 2, one row per test of a round. Link: fut_no, round_no."""
    return _rounds(df).select("fut_no", "round_no", F.explode("r.tests").alias("test_id", "code")).distinct()


def messages(df: DataFrame) -> DataFrame:
    """Level 2, one row per chat message of a round. Link: fut_no, round_no."""
    out = _rounds(df).select("fut_no", "round_no", F.posexplode("r.chat_messages").alias("pos", "m"))
    return out.select("fut_no", "round_no", F.col("pos").cast("long").alias("message_no"), F.col("m.role").alias("role"), F.col("m.content").alias("content")).distinct()


def _json_level(df: DataFrame, name: str, fields: list[tuple[str, str, pa.DataType, Callable]], keys: tuple[str, str | None]) -> DataFrame:
    """Rows of one member of exec_stats. keys: names of the key column and of the ordinal (None: leave out)."""
    key, ordinal = keys
    cols = [("fut_no", "long", pa.int64()), ("round_no", "long", pa.int64())]
    cols += [(key, "string", pa.string())] * bool(key) + [(ordinal, "long", pa.int64())] * bool(ordinal)
    schema = pa.schema([(n, t) for n, _, t in cols] + [(n, t) for n, _, t, _ in fields])

    def run(batches):
        for batch in batches:
            fut, rnd, text = (batch.column(i).to_pylist() for i in range(3))
            for start, end in chunks(text):
                out = []
                for row, k, n, obj in children(roots(text[start:end]), name):
                    if bool(key) == (k is None):
                        continue
                    out.append((fut[start + row], rnd[start + row], *[k] * bool(key), *[n] * bool(ordinal), *(f(obj) for *_, f in fields)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    text = spread(df.select("fut_no", "test_history")).select("fut_no", F.posexplode("test_history.history").alias("pos", "r"))
    text = text.select("fut_no", F.col("pos").cast("long").alias("round_no"), F.col("r.exec_stats").alias("t")).where("t is not null")
    ddl = ", ".join(f"{n} {t}" for n, t, *_ in [*cols, *fields])
    return text.mapInArrow(run, ddl).distinct()


def errors(df: DataFrame) -> DataFrame:
    """Level 3, one row per error object of run_tests_errors. Link: fut_no, round_no, test_id.

    A lone object counts as error 0, items that are no objects are passed over but
    count, texts that cannot be read as JSON give nothing, repeated rows count once.
    """
    return _json_level(df, "run_tests_errors", [(c, "string", pa.string(), lambda o, c=c: text_of(o.get(c))) for c in ("type", "test", "message")], ("test_id", "error_no"))


def test_logs(df: DataFrame) -> DataFrame:
    """Level 3, one row per test of run_tests_logs. Link: fut_no, round_no, test_id."""
    counts = [(c, "long", pa.int64(), lambda o, c=c: whole(o.get(c))) for c in ("passed_count", "failed_count", "errored_count")]
    return _json_level(df, "run_tests_logs", [("valid", "boolean", pa.bool_(), lambda o: o["valid"] if isinstance(o.get("valid"), bool) else None), *counts], ("test_id", None))


def coverage(df: DataFrame) -> DataFrame:
    """Level 2, one row per coverage log. Link: fut_no, round_no."""
    fields = [(c, "long", pa.int64(), lambda o, c=c: whole(o.get(c))) for c in ("num_executable_lines", "num_unexecuted_lines")]
    fields += [(c, "double", pa.float64(), lambda o, c=c: real(o.get(c))) for c in ("line_coverage_percentage", "branch_coverage_percentage")]
    lines = ("unexecuted_lines", "array<long>", pa.list_(pa.int64()), lambda o: [n for n in map(whole, o["unexecuted_lines"]) if n is not None] if isinstance(o.get("unexecuted_lines"), list) else None)
    return _json_level(df, "coverage_logs", [*fields, lines], ("", "coverage_no"))


def captured_calls(df: DataFrame) -> DataFrame:
    """Level 2, one row per captured call; inputs and output as JSON text. Link: fut_no, round_no."""
    return _json_level(df, "captured_arg_logs", [(c, "string", pa.string(), lambda o, c=c: text_of(o.get(c))) for c in ("func_name", "inputs", "output", "caller_info")], ("", "call_no"))
