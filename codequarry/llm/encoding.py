"""Garbled text from wrong character encodings.

A smoothed character trigram model is counted over all clean documents, in tables of a
fixed number of buckets (so what is broadcast never grows). Text is judged sentence by
sentence: every chain that encodes a stretch back to bytes and decodes it as what it
probably was gives a candidate; the candidate whose changed stretches the model finds
likeliest is taken if it beats the text as it stands by more than a margin. The margin
is validated: the clean sentences of all records are garbled by every chain, and the
margin is put between their gains and those of the clean sentences.

Marks that no chain can undo (replacement characters, C1 controls) make a document a
case too, without restored text there. Sequences quoted on purpose are none: those
that stand alone between quotes or backticks, and replacement characters in a sentence
that names them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Sizes of the count tables; counts of code points, of hashed pairs and of hashed triples.
ONES, TWOS, THREES = 1 << 16, 1 << 18, 1 << 20
#: Margin in nats a character where the corpus has too few foreign letters to validate one.
MARGIN = 2.0
#: Nats that a sentence must gain as a whole before it counts as written in another single-
#: or double-byte encoding; well-formed UTF-8 is evidence by itself and needs no more.
PRIOR = 15.0
#: Least log probability of a character, so that one unseen mark doesn't decide.
FLOOR = -12.0
#: Sentences that are scored at once where the margin is validated.
CHUNK = 256
#: Entries of a worker's memo of sentences that stay as they are.
MEMO = 1 << 16
#: Chains in a row that are tried.
TURNS = 3

# Encodings that text is wrongly read in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "cp866")
# Encodings that such text was really written in, besides UTF-8.
WRITTEN_IN = ("cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp850", "iso8859-5", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr")

FFFD = "�"
C1 = re.compile("[\x80-\x84\x86-\x9f]")
NAMED = re.compile(r"(?i)\\+u\{?fffd|u\+fffd|&#(?:xfffd|65533);|replacement char|ef\s?bf\s?bd")
QUOTES = {"`": "`", '"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“", "(": ")"}
RUN = re.compile("[^\x00-\x7f]{2,}")
UNIT = re.compile(r"[^\n]*?(?:[.!?:;](?=\s)|[。！？]|\n|$)")


def code_table(name: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; undefined bytes stand for C1 controls."""
    out = {}
    for byte in range(128, 256):
        try:
            char = bytes([byte]).decode(name)
        except UnicodeDecodeError:
            char = chr(byte)
        out.setdefault(char, byte)
    return out


TABLES = {name: code_table(name) for name in READ_AS}


def _sequence(table: dict[str, int]) -> re.Pattern:
    """Runs of characters whose bytes are well-formed multi-byte UTF-8 (apart from rare overlong forms)."""

    def group(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    tail = group(0x80, 0xBF)
    two, three, four = group(0xC2, 0xDF), group(0xE0, 0xEF), group(0xF0, 0xF4)
    return re.compile(f"(?:{two}{tail}|{three}{tail}{tail}|{four}{tail}{tail}{tail})+")


SEQUENCES = {name: _sequence(table) for name, table in TABLES.items()}
STRETCHES = {name: re.compile("[\x00-\x7f" + "".join(re.escape(c) for c in table) + "]*[" + "".join(re.escape(c) for c in table) + "][\x00-\x7f" + "".join(re.escape(c) for c in table) + "]*") for name, table in TABLES.items()}


def back(text: str, name: str) -> bytes:
    table = TABLES[name]
    return bytes(b if (b := ord(c)) < 128 else table[c] for c in text)


# ---------------------------------------------------------------- model

_LOWER = np.arange(ONES, dtype=np.uint32)
for _i in range(ONES):
    _c = chr(_i).lower() if not 0xD800 <= _i < 0xE000 else chr(_i)
    if len(_c) == 1:
        _LOWER[_i] = ord(_c)
_LOWER[ord("0") : ord("9") + 1] = ord("0")
_LOWER[[9, 10, 13]] = 32


def symbols(text: str) -> np.ndarray:
    """Lower-case code points, digits as 0; those beyond the first plane share a range."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points
    return np.where(points < ONES, _LOWER[np.minimum(points, ONES - 1)], 0xE000 + (points & 0xFFF)).astype(np.uint32)


def buckets(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs that end at 1.. and of the triples that end at 2.. ."""
    a = s.astype(np.uint64)
    with np.errstate(over="ignore"):
        two = (a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(46)
        three = (a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(44)
    return two.astype(np.int64), three.astype(np.int64)


@dataclass
class Model:
    """Interpolated trigram model over hashed counts."""

    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    memo: dict[tuple, dict[str, float]] = field(default_factory=dict)
    reach: dict[tuple, bool | None] = field(default_factory=dict)

    def __post_init__(self):
        self.total = max(1.0, float(self.one.sum()))

    def logs(self, text: str) -> np.ndarray:
        """Log probability of each character after the two before it; the text is taken to stand between blanks."""
        s = symbols(f"  {text}")
        two, three = buckets(s)
        return self.weigh(s[1:-1], s[2:], two[:-1], two[1:], three)

    def weigh(self, last: np.ndarray, char: np.ndarray, before: np.ndarray, after: np.ndarray, three: np.ndarray) -> np.ndarray:
        """Log probabilities from the symbols, the pairs before and at each character, and the triples."""
        p1 = (self.one[char] + 0.01) / (self.total + 0.01 * ONES)
        p2 = np.minimum(1.0, self.two[after] / np.maximum(1.0, self.one[last]))
        p3 = np.minimum(1.0, self.three[three] / np.maximum(1.0, self.two[before]))
        return np.maximum(np.log(0.6 * p3 + 0.3 * p2 + 0.1 * p1), FLOOR)

    def logs_at(self, text: str, at: np.ndarray) -> np.ndarray:
        """logs at the given characters only."""
        s = symbols(f"  {text}")
        near = np.stack([s[at], s[at + 1], s[at + 2]], axis=1)
        before, _ = buckets(near[:, :2].reshape(-1))
        after, three = buckets(near.reshape(-1))
        return self.weigh(near[:, 1], near[:, 2], before[::2], after[1::3], three[::3])

    def mean(self, text: str, mask: np.ndarray) -> float:
        return float(self.logs(text)[mask].mean()) if mask.any() else 0.0


def near(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Characters of the spans and the two after each."""
    mask = np.zeros(len(text), bool)
    for a, b in spans:
        mask[a : b + 2] = True
    return mask


# ---------------------------------------------------------------- candidates


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the run of foreign characters around a stretch stands alone between quotes."""
    while start > 0 and text[start - 1] > "\x7f" and text[start - 1] not in QUOTES:
        start -= 1
    while end < len(text) and text[end] > "\x7f" and (start == 0 or text[end] != QUOTES.get(text[start - 1])):
        end += 1
    return start > 0 and end < len(text) and QUOTES.get(text[start - 1]) == text[end]


def utf8_candidate(text: str, name: str):
    """(repaired, spans before, spans after) of text that was UTF-8 read as name; None if it has no such run."""
    out, before, after, last, size = [], [], [], 0, 0
    for m in SEQUENCES[name].finditer(text):
        if quoted(text, *m.span()):
            continue
        try:
            good = back(m[0], name).decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [text[last : m.start()], good]
        size += m.start() - last
        before.append(m.span())
        after.append((size, size + len(good)))
        size += len(good)
        last = m.end()
    return ("".join([*out, text[last:]]), before, after) if before else None


def bytes_candidates(text: str, name: str, chains: str):
    """(chain, candidate) for text written in another encoding than UTF-8 and read as name."""
    stretches = []
    for m in STRETCHES[name].finditer(text):
        marks = [(a, b) for a, b in foreign(m[0]) if not quoted(text, m.start() + a, m.start() + b)]
        if marks:
            stretches.append((m.start(), m.end(), m[0], back(m[0], name), marks))
    for written in WRITTEN_IN if stretches else ():
        if written == name or chains not in ("all", f"{written}>{name}"):
            continue
        out, before, after, last, size = [], [], [], 0, 0
        for start, end, was, data, marks in stretches:
            try:
                good = data.decode(written)
            except UnicodeDecodeError:
                continue
            if good == was:
                continue
            out += [text[last:start], good]
            size += start - last
            before += [(start + a, start + b) for a, b in marks]
            after += [(size + a, size + b) for a, b in foreign(good)] or [(size, size + len(good))]
            size += len(good)
            last = end
        if before:
            yield f"{written}>{name}", ("".join([*out, text[last:]]), before, after)


DIGITS = str.maketrans("123456789", "000000000")
CJK = re.compile("[\u3040-\u30ff\u4e00-\u9fff\uff00-\uffef]")
FOREIGN = re.compile("[^\x00-\x7f]+")


def foreign(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in FOREIGN.finditer(text)]


def candidates(text: str, chains: str):
    """(chain, needed nats, candidate) of every chain that changes the text; chains: which to
    try, "utf-8", "all" or the name of one."""
    for name in READ_AS:
        chain = f"utf-8>{name}"
        if chains in ("all", "utf-8", chain) and (found := utf8_candidate(text, name)):
            yield chain, 0.0, found
            # read wrongly twice: the marks of the first reading are no likely text by themselves
            for again in READ_AS[:2]:
                twice = utf8_candidate(found[0], again)
                if twice and any(a < d and c < b for a, b in twice[1] for c, d in found[2]):
                    yield f"utf-8>{again} {chain}", 0.0, (twice[0], found[1], twice[2])
        if not chains.startswith("utf-8"):
            for chain, found in bytes_candidates(text, name, chains):
                yield chain, PRIOR, found


def best_step(model: Model, text: str, margin: float, chains: str = "all", pool: dict[str, float] | None = None, prior: float = 1.0):
    """(gain, chain, repaired) of the candidate that makes the text likeliest as a whole, among
    those that gain more than the margin a character and in all prior times what their chain
    needs. pool: takes, by chain, what the candidates gain in all."""
    found, seen = [], set()
    for chain, need, (good, before, after) in candidates(text, chains):
        if need and good in seen or FFFD in good or C1.search(good) and not C1.search(text):
            continue
        seen.add(good)
        found.append((chain, need, good, before, after))
    top, most = (0.0, "", text), 0.0
    if not found:
        return top
    # all candidates are scored at once, each between blanks
    sums = [0.0, *np.cumsum(model.logs("  ".join([text, *(x[2] for x in found)])), dtype=np.float64).tolist()]
    at = len(text) + 2
    for chain, need, good, before, after in found:
        was, n = window_sum(sums, 0, len(text), before)
        now, m = window_sum(sums, at, len(good), after)
        at += len(good) + 2
        gain = now / m - was / n
        # counted for as many characters of either text, or the shorter one would seem likelier
        whole = gain * n
        if pool is not None and gain > margin and need:
            pool[chain] = pool.get(chain, 0.0) + whole
        whole -= need * prior
        if gain > margin * min(1.0, prior) and whole > most + 1e-6:  # of equal ones the first
            top, most = (gain, chain, good), whole
    return top


def window_sum(sums: list[float], start: int, size: int, spans: list[tuple[int, int]]) -> tuple[float, int]:
    """(sum, number) of what sums adds up over the spans of a text of some size that begins at start,
    and over the two characters after each."""
    total, n, end = 0.0, 0, 0
    for a, b in spans:
        a, b = max(a, end), min(b + 2, size)
        if b > a:
            total += sums[start + b] - sums[start + a]
            n += b - a
            end = b
    return total, max(1, n)


AROUND = re.compile("[\x00-\x7f]{0,2}[^\x00-\x7f]+(?=([\x00-\x7f]{0,2}))")


def context_key(text: str, margin: float) -> tuple:
    """All that the scores of a sentence depend on: its foreign runs and two characters around
    them, digits alike."""
    return margin, "\0".join([m[0] + "\0" + m[1] for m in AROUND.finditer(text)]).translate(DIGITS)


def within_reach(unit: str, start: int, sums: list[float], margin: float) -> bool | None:
    """Whether chains of any kind (True), those from UTF-8 only (False) or none (None) can gain more
    than the margin in a sentence. sums: of the log probabilities up to each character of a text
    in which the sentence begins at start, between blanks; only foreign runs and two characters after each count.

    Exact: the spans that a chain changes are looked at themselves, and no text is likelier than
    a log probability of 0. Of several spans the windows may share two characters, so that the
    mean over all is no less than the least sum of one over its size without those."""
    size = len(unit)

    def low(spans: list[tuple[int, int]], several: bool) -> bool:
        total = n = end = 0
        for a, b in spans:
            a, b = max(a, end), min(b + 2, size)
            total += sums[start + b] - sums[start + a]
            n += b - a
            end = b
        return total < -margin * (max(0, n - 2) if several else n)

    runs = foreign(unit)
    marks = [(a, b) for a, b in runs if not quoted(unit, a, b)]
    letters = set().union(*(unit[a:b] for a, b in runs))
    known = [name for name, table in TABLES.items() if not letters.isdisjoint(table)]
    if known and marks and low(marks, False) and any(letters <= TABLES[name].keys() for name in known):
        return True
    for name in known:
        if letters <= TABLES[name].keys():
            continue
        stretches = list(STRETCHES[name].finditer(unit))
        for m in stretches:
            inner = [(m.start() + a, m.start() + b) for a, b in foreign(m[0]) if not quoted(unit, m.start() + a, m.start() + b)]
            if inner and low(inner, len(stretches) > 1):
                return True
    for name in known:
        spans = [m.span() for m in SEQUENCES[name].finditer(unit)] if any(b - a > 1 for a, b in runs) else []
        if any(low([span], len(spans) > 1) for span in spans):
            return False
    return None


def repair(model: Model, text: str, margin: float) -> tuple[str, str]:
    """(text with each garbled sentence restored, chains used, in order, joined by blanks).

    A first pass takes sentences that decide by themselves, each with the chain that decided
    last before it comes to all, and pools what chains gain in the others; a chain that
    decided anywhere, or whose pooled gain makes up for what it needs, is then tried on the
    other sentences without more evidence."""
    if text.isascii():
        return text, ""
    parts = UNIT.findall(text)
    keys = [None if unit.isascii() else context_key(unit, margin) for unit in parts]
    fresh = {key: unit for key, unit in zip(keys, parts) if key is not None and key not in model.reach}
    if fresh:
        if len(model.reach) + len(fresh) > MEMO:
            model.reach.clear()
            fresh = {key: unit for key, unit in zip(keys, parts) if key is not None}
        padded = "  ".join(fresh.values())  # so that each sentence stands between blanks, as best_step takes it
        mask = near(padded, foreign(padded))
        sums = np.zeros(len(padded) + 1)
        sums[1:][mask] = model.logs_at(padded, np.flatnonzero(mask))
        sums, at = np.cumsum(sums).tolist(), 0
        for key, unit in fresh.items():
            model.reach[key] = within_reach(unit, at, sums, margin)
            at += len(unit) + 2
    units, used, left, pool = [], [], [], {}
    for unit, key in zip(parts, keys):
        units.append(unit)
        dark = model.reach[key] if key is not None else None
        if dark is None:
            continue
        known = model.memo.get(key := (dark, *key))
        if known is None and used:
            _, chain, good = best_step(model, unit, margin, used[-1])
            if chain:
                unit = good
                used.append(chain)
                known = model.memo.get(key := (dark, *context_key(unit, margin)))
        for _ in range(TURNS):
            if known is not None:
                break
            gains: dict[str, float] = {}
            _, chain, good = best_step(model, unit, margin, "all" if dark else "utf-8", gains)
            if chain:
                unit = good
                used.append(chain)
                known = model.memo.get(key := (dark, *context_key(unit, margin)))
            else:
                if len(model.memo) >= MEMO:
                    model.memo.clear()
                known = model.memo[key] = gains
        units[-1] = unit
        for chain, gain in (known or {}).items():
            pool[chain] = pool.get(chain, 0.0) + gain
        left.append(len(units) - 1)
    chains = list(dict.fromkeys(c for chain in used for c in chain.split()))
    if pool and not chains:
        best = max(pool, key=lambda c: (pool[c], c))
        if pool[best] > PRIOR:
            chains = [best]
    changed = bool(used)
    for k in left if chains else ():
        for chain in chains:
            new = best_step(model, units[k], margin, chain, None, 0.0)[2]
            changed |= new != units[k]
            units[k] = new
    return "".join(units), " ".join(chains) if changed else ""


def lost(text: str) -> bool:
    """Whether the text has marks of wrong decoding that can't be undone."""
    for m in UNIT.finditer(text):
        unit = m[0]
        if FFFD in unit and not NAMED.search(unit) and any(not quoted(unit, *x.span()) for x in re.finditer(FFFD + "+", unit)):
            return True
        if any(not quoted(unit, *x.span()) for x in C1.finditer(unit)):
            return True
    return False


@lru_cache(MEMO)
def explained(run: str) -> bool:
    """Whether a run of foreign characters holds well-formed UTF-8 read in a Latin encoding, or two
    such sequences in a Cyrillic one, where single ones are ordinary letters. (Of the encodings
    with letters in the range of three-byte sequences, cp866 and koi8-r, nothing follows.)"""
    return any((m := p.search(run)) and (name != "cp1251" or m.end() - m.start() >= 4) for name, p in SEQUENCES.items() if name not in ("cp866", "koi8-r"))


def is_clean(text: str) -> bool:
    """Whether a text has no marks of wrong decoding and no run that UTF-8 explains."""
    return text.isascii() or FFFD not in text and not C1.search(text) and not any(explained(m[0]) for m in RUN.finditer(text))


#: A foreign capital after a small letter, or a foreign mark between letters.
MIXED = re.compile(r"(?<=[a-zß-öø-ÿа-яё])[À-ÖØ-ÞА-ЯЁЂ-Џ]|(?<=[^\W\d_])(?![’‘‑–—…])[^\x00-\x7f\w\s](?=[^\W\d_])")


@lru_cache(MEMO)
def mixed(window: str) -> bool:
    return MIXED.search(window) is not None


def clean_parts(text: str) -> str:
    """The text with a break, for the model, in place of each mark, each run that UTF-8 explains
    and each word of mixed case or with a mark inside: such words are rare in clean text, and
    the sentences of records read in a wrong single-byte encoding are full of them."""
    if text.isascii():
        return text
    # what makes a word mixed lies within a foreign run and the characters beside it
    if any(mixed(text[max(0, a - 1) : b + 1]) for a, b in foreign(text)):
        text = re.sub(r"\S+", lambda m: "\0\0" if MIXED.search(m[0]) and not CJK.search(m[0]) else m[0], text)
    out = RUN.sub(lambda m: "\0\0" if explained(m[0]) else m[0], text)
    return C1.sub("\0\0", out).replace(FFFD, "\0\0")


# ---------------------------------------------------------------- corpus


def count_model(docs: DataFrame, text: str = "text") -> Model:
    """The model of what is clean in all records (clean_parts). Each partition sends at most one row
    for each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts = np.zeros(ONES + TWOS + THREES, np.int64)
        for batch in batches:
            good = [clean_parts(t) for t in batch.column(0).to_pylist() if t]
            for k in range(0, len(good), 2048):
                s = symbols("  " + "  ".join(good[k : k + 2048]))
                if len(s) < 3:
                    continue
                two, three = buckets(s)
                counts[:ONES] += np.bincount(s, minlength=ONES)
                counts[ONES : ONES + TWOS] += np.bincount(two, minlength=TWOS)
                counts[ONES + TWOS :] += np.bincount(three, minlength=THREES)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], schema=schema)

    sums = spread(docs.select(text)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most ONES + TWOS + THREES rows
    counts = np.zeros(ONES + TWOS + THREES, np.float32)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return Model(counts[:ONES], counts[ONES : ONES + TWOS], counts[ONES + TWOS :])


def sample_units(texts: list[str]) -> list[str]:
    """The foreign sentences of the texts; those alike but for names and numbers count once."""
    return list({re.sub(r"[0-9A-Za-z_]+", "a", m[0]): m[0] for text in texts for m in UNIT.finditer(text) if not m[0].isascii()}.values())


#: What lies farther than two characters from the foreign runs of a sentence.
BEYOND = re.compile("(?:(?<=[^\x00-\x7f][\x00-\x7f]{2})|^)[\x00-\x7f]+?(?=[\x00-\x7f]{2}[^\x00-\x7f]|\\Z)")


def context(unit: str) -> str:
    """A sentence cut down to what its scores depend on, as context_key has it: the foreign runs and
    two characters around them, digits alike. Its gains are those of the sentence."""
    return BEYOND.sub("", unit).translate(DIGITS)


def clean_units(texts: list[str]) -> Iterator[str]:
    """The distinct foreign sentences of the clean texts."""
    yield from dict.fromkeys(m[0] for text in texts if is_clean(text) for m in UNIT.finditer(text) if not m[0].isascii())


def unit_gains(model: Model, units: list[str]) -> Iterator[tuple[float, list[float]]]:
    """For each clean sentence its best gain, and the gains of undoing UTF-8 read as each encoding in it."""
    for k in range(0, len(units), CHUNK):
        part, texts, windows, at = units[k : k + CHUNK], [], [], 0
        for unit in part:
            own, raw = at, unit.encode("utf-8").decode("latin-1")
            texts.append(unit)
            at += len(unit) + 2
            pairs = []
            for name in READ_AS:
                bad = raw.translate(_CHARS[name])
                found = utf8_candidate(bad, name)
                if found and found[0] == unit:
                    pairs.append(((own, len(unit), found[2]), (at, len(bad), found[1])))
                    texts.append(bad)
                    at += len(bad) + 2
            windows.append(pairs)
        # all are scored at once, each between blanks, and only where it counts
        padded = "  ".join(texts)
        mask = near(padded, foreign(padded))
        sums = np.zeros(len(padded) + 1)
        sums[1:][mask] = model.logs_at(padded, np.flatnonzero(mask))
        sums = np.cumsum(sums).tolist()
        for unit, pairs in zip(part, windows):
            means = [[total / n for total, n in (window_sum(sums, *x) for x in pair)] for pair in pairs]
            yield best_step(model, unit, 0.0)[0], [good - bad for good, bad in means]


def sample_gains(model: Model, units: list[str]) -> tuple[list[float], list[float]]:
    """unit_gains of all sentences in two lists."""
    gains = list(unit_gains(model, units))
    return [clean for clean, _ in gains], [x for _, broken in gains for x in broken]


def validated_margin(clean: list[float], broken: list[float]) -> float:
    """Margin between the best gains of clean sentences and the gains of broken ones (of either but a
    hundredth, as some of the sentences taken as clean may not be), nine tenths up the gap,
    as clean text is by far the commoner; MARGIN where there is no gap."""
    return margin_between(float(np.quantile([0.0, *clean], 0.99)), float(np.quantile(broken, 0.01)) if broken else 0.0)


def margin_between(low: float, high: float) -> float:
    return 0.1 * low + 0.9 * high if high > low else MARGIN


_CHARS = {name: {b: c for c, b in table.items()} for name, table in TABLES.items()}


def fit(docs: DataFrame, sample: int | None = None) -> tuple[Model, float]:
    """Model over all clean records and the margin, validated on every foreign sentence of the clean
    ones, of which repeated ones count once. sample: for trials, at most so many distinct
    texts, those of least hash, instead."""
    model = count_model(docs)
    if sample is None:
        return model, corpus_margin(docs, model)
    hashed = docs.where(F.col("text").rlike("[^\\x00-\\x7f]")).select("text", F.xxhash64("text").alias("h"))
    # only hashes below a bound can be among the least: the bound grows until enough texts are under it
    share = min(1.0, 4 * sample / max(1, docs.count()))
    while True:
        below = hashed if share >= 1 else hashed.where(F.col("h") < int(-(2**63) + share * 2**64))
        texts = [t for t, _ in below.distinct().orderBy("h", "text").limit(sample).collect()]
        if len(texts) >= sample or share >= 1:
            break
        share *= 16
    return model, validated_margin(*_gains(docs.sparkSession, model, sample_units([t for t in texts if is_clean(t)])))


def _gains(spark, model: Model, units: list[str]) -> tuple[list[float], list[float]]:
    """sample_gains of the sample's sentences, by all workers."""
    if not units:
        return [], []
    sent = spark.sparkContext.broadcast((model.one, model.two, model.three))
    schema = pa.schema([("broken", pa.bool_()), ("gain", pa.float64())])

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            clean, broken = sample_gains(own, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(clean) + [True] * len(broken), pa.bool_()), pa.array(clean + broken, pa.float64())], schema=schema)

    rows = spark.createDataFrame(pa.table({"unit": units})).repartition(spark.sparkContext.defaultParallelism)
    gains = rows.mapInArrow(run, "broken boolean, gain double").toArrow()  # at most ten rows a sentence of the sample
    broken, gain = gains["broken"].to_numpy(zero_copy_only=False), gains["gain"].to_numpy()
    return gain[~broken].tolist(), gain[broken].tolist()


def clean_contexts(docs: DataFrame) -> DataFrame:
    """(context, n): the contexts of the foreign sentences of all clean texts and how many distinct
    sentences have each. Sentences are told apart by 128 bits of a digest."""
    schema = pa.schema([("digest", pa.binary()), ("context", pa.string())])

    def run(batches):
        for batch in batches:
            units = list(clean_units(batch.column(0).to_pylist()))
            if units:
                yield pa.RecordBatch.from_arrays([pa.array([blake2b(u.encode("utf-8"), digest_size=16).digest() for u in units], pa.binary()), pa.array([context(u) for u in units], pa.string())], schema=schema)

    texts = spread(docs.select("text").where(F.col("text").rlike("[^\\x00-\\x7f]")))
    return texts.mapInArrow(run, "digest binary, context string").distinct().groupBy("context").agg(F.count("*").alias("n"))


def corpus_margin(docs: DataFrame, model: Model) -> float:
    """validated_margin over the foreign sentences of all clean texts: each context is scored once, by
    the workers, and counts as often as it has sentences. The quantiles are exact."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.one, model.two, model.three))
    schema = pa.schema([("broken", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            flags, gains, counts = [], [], []
            for n, (clean, broken) in zip(batch.column(1).to_pylist(), unit_gains(own, batch.column(0).to_pylist())):
                flags += [False, *[True] * len(broken)]
                gains += [clean, *broken]
                counts += [n] * (len(broken) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(flags, pa.bool_()), pa.array(order_keys(np.array(gains, np.float64))), pa.array(counts, pa.int64())], schema=schema)

    rows = spread(clean_contexts(docs)).mapInArrow(run, "broken boolean, key long, n long")
    zero = spark.range(1).select(F.lit(False).alias("broken"), F.lit(0).cast("long").alias("key"), F.lit(1).cast("long").alias("n"))
    rows = rows.union(zero).persist(StorageLevel.DISK_ONLY)
    try:
        found = quantiles(rows, {False: 0.99, True: 0.01})
    finally:
        rows.unpersist()
        sent.destroy()
    return margin_between(found[False], found.get(True, 0.0))


def order_keys(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    return _flip((values + 0.0).view(np.int64))


def _flip(bits: np.ndarray) -> np.ndarray:
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def quantiles(keyed: DataFrame, wanted: dict[bool, float]) -> dict[bool, float]:
    """The exact quantile of the values of each group, as np.quantile has it, from rows (broken, key,
    n): the group, a value's order_keys and how often it counts. Groups without rows are left out.

    The two values around each quantile are found sixteen bits at a time, from counts of the
    keys that share the bits before, so that at most 2 ** 18 counts come to the driver."""
    targets: list[tuple[bool, int, int]] = []  # group, bits so far, rank among the values that have them
    parts: dict[bool, float] = {}
    for shift in (48, 32, 16, 0):
        rows = keyed
        if shift < 48:
            rows = rows.where(" or ".join(f"broken = {b} and shiftright(key, {shift + 16}) = {bits}" for b, bits in {t[:2] for t in targets}) or "false")
        counts: dict[tuple[bool, int], list[tuple[int, int]]] = {}
        for b, bits, n in rows.groupBy("broken", F.shiftright("key", shift).alias("bits")).agg(F.sum("n")).collect():
            counts.setdefault((b, bits >> 16 if shift < 48 else 0), []).append((bits, n))
        if shift == 48:
            for (b, _), bins in counts.items():
                size = sum(n for _, n in bins)
                at = (size - 1) * wanted[b]
                parts[b] = at - int(at)
                targets += [(b, 0, int(at)), (b, 0, min(int(at) + 1, size - 1))]
        new = []
        for b, bits, rank in targets:
            for k, n in sorted(counts[b, bits]):
                if rank < n:
                    new.append((b, k, rank))
                    break
                rank -= n
        targets = new
    pairs = zip(targets[::2], targets[1::2])
    return {b: float(np.quantile(_flip(np.array([low, high], np.int64)).view(np.float64), parts[b])) for (b, low, _), (_, high, _) in pairs}


def garbled_texts(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """(doc_id, restored, chains, complete) of every document that was decoded wrongly.

    restored: the text with each garbled sentence restored where a chain does it; chains:
    the encodings, written>read; complete: false where marks are left that nothing can
    undo. Null, empty and ASCII texts are never cases, repeated rows count once. The
    corpus is read to count the model, to validate the margin and to judge; nothing is
    shuffled but the counts, the contexts of the clean sentences and the cases. sample: as
    of fit.
    """
    model, margin = fit(docs, sample)
    sent = docs.sparkSession.sparkContext.broadcast((model.one, model.two, model.three))
    schema = pa.schema([("doc_id", pa.int64()), ("restored", pa.string()), ("chains", pa.string()), ("complete", pa.bool_())])

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            found = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                restored, chains = repair(own, text, margin)
                left = lost(restored)
                if chains or left:
                    found.append((key, restored, chains, not left))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike("[^\\x00-\\x7f]")))
    return texts.mapInArrow(run, "doc_id long, restored string, chains string, complete boolean").distinct()
