"""Evaluation texts leaking into training text.

Greedy string tiling with running Karp-Rabin hashes. Runs of SEED words shared by a
document and an item are found by one rolling hash over each document and joined to
their diagonals. A match is a stretch of a diagonal that begins and ends with an equal
word and has at most one in nine words replaced. The longest match is marked as a tile,
its words of document and item are taken, and so on until no match of TILE words is
left. A pair is a leak if its longest tile has PASSAGE words, or if its tiles cover
COVERAGE of the item in whatever order they stand.

The first tile is the longest match of all, so no passage is lost to marking; and a
passage of 18 words with at most one in nine replaced has an unbroken run of six (for k
replaced words the longest run has at least ceil(8k / (k + 1)) words, and 9 for k = 1),
so seeds of six words lose none.

Items are a bounded set: they go to the workers in blocks of at most BLOCK_CHARS.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Words of a passage, and words of which one may be replaced.
PASSAGE, PER_REPLACED = 18, 9
SEED = 6
#: Least words of a tile, and the share of an item's words that tiles cover in a reordered copy.
TILE, COVERAGE = 6, 0.5
#: Characters of the items that one pass over the corpus compares; more items take more passes.
BLOCK_CHARS = 32 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

WORD = re.compile(r"[^\W_]+(?:[_'’][^\W_]+)*")
UNICODE_ESCAPE = re.compile(r"\\+u([0-9a-fA-F]{4})")
CONTROL_ESCAPE = re.compile(r"\\+[nrtfv]")
MARK_ESCAPE = re.compile(r"\\+(?=[^\w\s])")
PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
HIDDEN = re.compile("[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Words of a text, whatever its case, spacing, line prefixes, punctuation and escapes."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = MARK_ESCAPE.sub("", CONTROL_ESCAPE.sub(" ", UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)))
    if "%" in text and PERCENT.search(text):
        text = unquote(text, errors="replace")
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each run of width ids, modulo 2**64."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * BASE + ids[k : k + len(out)]
    return out


def longest_match(doc: np.ndarray, item: np.ndarray, offset: int, free_doc: np.ndarray | None = None, free_item: np.ndarray | None = None) -> tuple[int, int, int]:
    """(words, start in the item, replaced words) of the longest match on a diagonal among the
    words that are free: it begins and ends with an equal word, has at most one in
    PER_REPLACED words replaced and passes over no word that is taken."""
    low, high = max(0, -offset), min(len(item), len(doc) - offset)
    same = item[low:high] == doc[low + offset : high + offset]
    wall = np.zeros(len(same), np.int64)
    if free_doc is not None:
        taken = ~(free_item[low:high] & free_doc[low + offset : high + offset])
        same &= ~taken
        wall = taken.astype(np.int64) * (PER_REPLACED * len(same) + 1)  # more than any match can make up for
    hits = np.flatnonzero(same)
    if not len(hits):
        return 0, 0, 0
    missed = np.concatenate([[0], np.cumsum(~same)])
    weight = np.concatenate([[0], np.cumsum(np.where(same, 0, PER_REPLACED) + wall)])
    # of the match a..e: weight[e+1] - weight[a] <= e - a + 1
    left, right = hits - weight[hits], hits + 1 - weight[hits + 1]
    lowest = np.minimum.accumulate(left)
    best = (0, 0, 0)
    for k, e in enumerate(hits):
        if right[k] >= lowest[k]:
            a = hits[int(np.argmax(left[: k + 1] <= right[k]))]
            if e - a + 1 > best[0]:
                best = (int(e - a + 1), int(a + low), int(missed[e + 1] - missed[a]))
    return best


def tiling(doc: np.ndarray, item: np.ndarray, offsets, least: int = TILE) -> list[tuple[int, int, int, int]]:
    """Tiles (words, start in the item, start in the document, replaced words), longest first: the
    longest match is marked again and again, without overlap, until none has `least` words.
    Of matches of one length the first in the item, then in the document, is taken."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    best = {o: longest_match(doc, item, o) for o in offsets}
    tiles: list[tuple[int, int, int, int]] = []
    while best:
        offset = min(best, key=lambda o: (-best[o][0], best[o][1], o))
        size, at, replaced = best[offset]
        if size < least:
            break
        tiles.append((size, at, at + offset, replaced))
        free_item[at : at + size] = False
        free_doc[at + offset : at + offset + size] = False
        for o, (n, i, _) in list(best.items()):
            # only matches that the tile touches change
            if i < at + size and at < i + n or i + o < at + offset + size and at + offset < i + o + n:
                best[o] = longest_match(doc, item, o, free_doc, free_item)
    return tiles


class ItemIndex:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, owners = [], []
        for item_id, text in items:
            found = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if len(found) < PASSAGE:
                continue
            array = np.array(found, np.uint64)
            seeds = rolling(array, SEED)
            hashes.append(seeds)
            owners += [(len(self.items), q) for q in range(len(seeds))]
            self.items.append((item_id, array))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owners = flat[order], [owners[i] for i in order]

    def leaks(self, texts: list[str | None]):
        """(text number, item id, words and replaced words of the longest tile, tiles, covered words, item words)"""
        known = self.ids.get
        docs = [np.array([known(w, 0) for w in words(t)], np.uint64) for t in texts]
        gap = np.zeros(SEED, np.uint64)
        starts = np.cumsum([0, *(len(d) + SEED for d in docs)])
        seeds = rolling(np.concatenate([x for d in docs for x in (d, gap)] or [gap]), SEED)
        if not len(self.hashes):
            return
        at = np.searchsorted(self.hashes, seeds)
        at[at == len(self.hashes)] = 0
        lines: dict[tuple[int, int], set[int]] = {}
        for p in np.flatnonzero(self.hashes[at] == seeds).tolist():
            n = int(np.searchsorted(starts, p, "right")) - 1
            k = int(at[p])
            while k < len(self.hashes) and self.hashes[k] == seeds[p]:
                item, q = self.owners[k]
                lines.setdefault((n, item), set()).add(p - int(starts[n]) - q)
                k += 1
        for (n, item), offsets in lines.items():
            item_id, array = self.items[item]
            tiles = tiling(docs[n], array, sorted(offsets))
            if not tiles:
                continue
            covered = sum(size - replaced for size, _, _, replaced in tiles)
            if tiles[0][0] >= PASSAGE or covered >= max(PASSAGE, COVERAGE * len(array)):
                yield n, item_id, tiles[0][0], tiles[0][3], len(tiles), covered, len(array)


#: The index of the block of items that a worker compares last, so that its next task has it.
_KEPT: dict[str, ItemIndex] = {}


def _index(token: str, sent: Broadcast) -> ItemIndex:
    if token not in _KEPT:
        _KEPT.clear()
        _KEPT[token] = ItemIndex(sent.value)
    return _KEPT[token]


def leaked_items(docs: DataFrame, items: DataFrame, block: int = BLOCK_CHARS) -> DataFrame:
    """Distinct (doc_id, item_id, passage_words, replaced_words, tiles, covered_words, coverage)
    of the documents that leak an item, as a passage or as tiles in any order.

    passage_words and replaced_words are those of the longest tile, covered_words the equal
    words of all tiles. Null and empty texts hold none, items of fewer than 18 words have
    none, repeated rows count once. The corpus is read once for each block of items (of
    about block characters) and not shuffled; one document's words are the largest unit
    of work.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("text") + 16)).first()[0] or 0) // block))
    fields = [("doc_id", "long"), ("item_id", "long"), ("passage_words", "long"), ("replaced_words", "long"), ("tiles", "long"), ("covered_words", "long"), ("coverage", "double")]
    schema = pa.schema([(n, pa.float64() if t == "double" else pa.int64()) for n, t in fields])
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''"))

    def one(number: int) -> DataFrame:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about block characters
        token = uuid.uuid4().hex

        def run(batches):
            index = _index(token, sent)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[n], i, size, replaced, tiles, covered, covered / whole) for n, i, size, replaced, tiles, covered, whole in index.leaks(batch.column(1).to_pylist())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        return texts.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))

    return reduce(DataFrame.union, map(one, range(blocks))).distinct()


def passages(docs: DataFrame, items: DataFrame, block: int = BLOCK_CHARS) -> DataFrame:
    """Distinct (doc_id, item_id) of the leaks whose longest tile is a passage of PASSAGE words.
    Tables and cases as for leaked_items."""
    return leaked_items(docs, items, block).where(F.col("passage_words") >= PASSAGE).select("doc_id", "item_id").distinct()
