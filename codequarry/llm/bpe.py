"""Encoding of a corpus with a public byte-level BPE tokenizer.

The merges are compiled into a finite-state transducer that is determinised as texts
ask for its states. After i bytes of a piece the transducer knows the last token of the
encoding of each prefix that some vocabulary entry could still continue: a state is the
set of (trie node, token before it) pairs that are alive. A byte moves each pair down
the trie; of the tokens that end here exactly one follows the token before it in a way
the merges would keep, and that is the last token of the longer prefix. States and
transitions are interned, so a byte costs one lookup once its state has been seen. The
lookahead is bounded by the longest vocabulary entry; tokens are read back from the
last tokens. Decoding streams through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Folder of the public tokenizer files.
TOKENIZERS = "/opt/tokenizers"
#: Vocabulary as ranks: a line has the base64 of the token's bytes and its id.
RANKS = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges (fixed value of this vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's caches; a full cache is emptied, which changes no result.
CACHE = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Transducer:
    """Lazily determinised transducer of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.names = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for name, rank in ranks.items():
            if len(name) > 1 and not self.reachable(name, rank):
                continue
            node = 0
            for byte in name:
                to = self.child[node].get(byte)
                if to is None:
                    to = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = rank
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        self.follows: dict[tuple[int, int], bool] = {}
        start = ((0, -1),)
        self.states: list[tuple[tuple[int, int], ...]] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, name: bytes) -> list[int]:
        """Ids of a short byte string by its merges, lowest rank first."""
        parts = [name[i : i + 1] for i in range(len(name))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, name: bytes, rank: int) -> bool:
        """Whether the merges can produce the entry; the last merge splits it in two entries of lower rank."""
        return any(self.ranks.get(name[:i], rank) < rank or i == 1 for i in range(1, len(name)) if name[:i] in self.ranks and name[i:] in self.ranks)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes leave the two tokens apart and whole."""
        key = (a, b)
        known = self.follows.get(key)
        if known is None:
            known = self.follows[key] = self.merged(self.names[a] + self.names[b]) == [a, b]
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, last token) after a byte, made when first asked for."""
        alive, last = [], -1
        for node, before in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            token = self.token[to]
            if token >= 0 and last < 0 and (before < 0 or self.may_follow(before, token)):
                last = token
            if self.child[to]:
                alive.append((to, before))
        alive.append((0, last))
        key = tuple(alive)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        out = self.moves[state][byte] = (number, last)
        return out

    def piece(self, name: bytes) -> tuple[int, ...]:
        if len(self.states) > CACHE or len(self.follows) > 4 * CACHE:
            self.reset()
        state, lasts = 0, []
        moves = self.moves
        for byte in name:
            to = moves[state].get(byte)
            state, last = self.move(state, byte) if to is None else to
            lasts.append(last)
        out, end = [], len(name)
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= self.size[token]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for word in self.split(text):
            ids = pieces.get(word)
            if ids is None:
                if len(pieces) > CACHE:
                    pieces.clear()
                ids = self.piece(word.encode("utf-8"))
                if len(word) <= 64:
                    pieces[word] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        machine = Utf8Machine()
        return "".join([*(machine.feed(self.names[i]) for i in ids), machine.close()])


class Utf8Machine:
    """Incremental UTF-8 decoder: states are the bytes still due and their allowed range."""

    def __init__(self):
        self.due, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode("ascii")
        out = []
        for byte in data:
            if self.due:
                if self.low <= byte <= self.high:
                    self.value = self.value << 6 | byte & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.due, self.value = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.due, self.value = 2, byte & 0x0F
                self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.due, self.value = 3, byte & 0x07
                self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        cut, self.due = self.due, 0
        return "�" if cut else ""


_MADE: dict[tuple[str, str], Transducer] = {}


def transducer(path: str, pattern: str = PATTERN) -> Transducer:
    """The transducer of a rank file, one for a worker."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Transducer(read_ranks(path), pattern)
    return _MADE[path, pattern]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{RANKS}", pattern: str = PATTERN) -> DataFrame:
    """(key, ids): every row's text as token ids, without special tokens.

    Null and empty texts give an empty list, strings of special tokens are ordinary
    text, every row gives one row (repeated rows too). No row leaves its partition, so
    nothing is shuffled. path: the rank file, at the same place on every machine.
    """
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        machine = transducer(path, pattern)
        for batch in batches:
            rows = [machine.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return spread(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = f"{TOKENIZERS}/{RANKS}", pattern: str = PATTERN) -> DataFrame:
    """(key, text): the texts of lists of ids; null lists give null, empty ones an empty text."""
    schema = pa.schema([("key", pa.int64()), ("text", pa.string())])

    def run(batches):
        machine = transducer(path, pattern)
        for batch in batches:
            texts = [None if r is None else machine.decode(r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)
