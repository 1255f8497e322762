"""Credentials embedded in source code.

Quoted strings, bare values and long tokens are extracted with the name they are given
to (lines that hold no word of such a name are passed over, which loses none). Shannon
entropy over the smallest alphabet that holds a value is compared with a threshold
adjusted to its length; formats of well-known keys and names that promise a secret lower
it. Tokens and quoted strings without such a name are judged anywhere in the text, against
a stricter threshold. Digests, commit and run ids, public keys, embedded data, identifiers, names of
secrets, lookups and stand-ins are excluded. Redaction replaces the value alone, so
quotes, names and line structure stay and what parsed before parses after.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Bits a character that a value in a well-known format must have at least.
KNOWN_BITS = 2.8
#: Bits a character that words, a symbol and digits under the name of a password have at least.
NAMED_BITS = 2.2
#: Bits a character that a random value may fall short of what its length and alphabet lead to
#: expect: none of some ten thousand values read on test tables falls shorter.
SLACK = 1.3
#: The same for a value that no name makes a secret, and the least share of its characters
#: that follow one of another class (a random value of letters and digits shows about 0.62,
#: identifiers in camel case about a third).
UNNAMED_SLACK, UNNAMED_CHANGES = 0.7, 0.42
#: Least and most characters of a value that no name makes a secret; longer ones are data.
UNNAMED_SIZE = (20, 100)
#: Characters of a list or mapping under a name that promises secrets that are read.
CONTAINER_SIZE = 4_000
#: What stands in for a redacted value.
MASK = "REDACTED"

# Words at the end of a name that promise a secret.
SECRET_WORDS = ("password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "secrets", "token", "apikey", "key", "cred", "creds", "credential", "credentials", "auth", "authorization", "bot", "jwt", "pat", "sas")
# Of those the words under which passwords made of words and digits are usual.
PASSWORD_WORDS = ("password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "secrets", "apikey", "token", "cred", "creds", "credential", "credentials", "auth")
# Words before "key" that promise a secret.
KEY_WORDS = ("api", "access", "secret", "private", "signing", "service", "encryption", "auth", "client", "account", "master", "deploy", "webhook", "ssh", "aws", "license")
# What well-known keys start with, and the characters that follow.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_/+.-])(?:gh[opsur]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{16,}|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|AIza[\w-]{30,}|xox[abpors]-[A-Za-z0-9-]{20,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|dop_v1_[0-9a-f]{60,}|hf_[A-Za-z0-9]{30,}|ya29\.[\w-]{20,}|sq0[a-z]{3}-[\w-]{20,}|AC[0-9a-f]{32}(?=\W|$))"
)
PREFIX = re.compile(r"^(?:gh[opsur]_|github_pat_|glpat-|AKIA|ASIA|AIza|xox[abpors]-|[srp]k_(?:live|test)_|eyJ[\w-]+\.|npm_|pypi-|hf_|ya29\.)")
#: What a line must hold, in lower case, for a name, header, command or note of in_line or below_name
#: to apply: one of the words, no letter after it (but an s), or one of the marks. Exact, not a choice.
LINE_WORDS = (*SECRET_WORDS, "bearer", "basic", "login")
LINE_MARKS = ("://", "curl", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "akia", "asia", "aiza", "xox", "k_live_", "k_test_", "eyj", "npm_", "pypi-", "hf_", "ya29.")
# What stand-ins hold.
STAND_IN = re.compile(
    r"(?i)\$\{|\$\(|\{\{|\}\}|%\(|<[^<>]*>|^\$\w|^%[^%]+%$|^\{[^{}]*\}$|^(.)\1+$|x{5,}|\*{3,}|\.{3}|…|process\.env|os\.environ|getenv|secrets\.|^[\w.]+\(|12345678|abcdefgh"
    r"|(?<![a-z])(?:your|example|change[_-]?me|placeholder|dummy|sample|fake|mock|redacted|insert|replace|todo|fill[_ ]?in|undefined|not[_-]?set|vault|my[_-](?:secret|token|password|key)|(?:secret|token|password|key)[_-]here)(?![a-z])"
    r"|^(?:none|null|nil|test|testing|default|secret|password|token)$|^env[:.]"
)
PATH = re.compile(r"^(?:~|\.{1,2})?(?:/[A-Za-z.][a-z_.-]*\d{0,3})+/?$")
HEX = re.compile(r"^(?:0x)?[0-9a-f]+$|^(?:0x)?[0-9A-F]+$")
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
PUBLIC = re.compile(r"^(?:ssh-(?:rsa|ed25519|dss)|ecdsa-sha2-\S+)\s|^(?:sha\d+|md5)[:-]|^data:|^W/|^AAAA[BCE]3Nza|^-----BEGIN (?:PUBLIC|CERT)")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?=\s*(?:\\n|\\r)*\s*[#*/\"'+ ]*\s*[A-Za-z0-9+/=:-]{16})")
PEM_BODY = re.compile(r"[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^\s:/@'\"<>{}$]*):([^\s@/'\"]+)@[\w.\[-]")
CURL = re.compile(r"(?:^|\s)(?:-u|--user)[ =]?['\"]?([^\s:'\"]+):([^\s'\"]+)")
HEADER = re.compile(r"(?i)\b(bearer|basic|token|apikey)[ :=]+([A-Za-z0-9+/_.~=-]{12,})")
#: name, operator, then a lookup with a default or string prefixes, and the first quoted part.
QUOTED = re.compile(r"([A-Za-z_][\w.-]*)['\"]?\]?\s*(?::\s*[A-Za-z_][\w.\[\]]*\s*)?(?:=>|[:=])\s*(?:[\w.]+\(\s*(?:['\"][^'\"\n]*['\"]\s*,\s*)?)?[bBrRuUfF]{0,2}(\"\"\"|'''|[\"'`])((?:(?!\2)[^\\\n]|\\.)*)\2")
MORE = re.compile(r"\s*(?:\+|\\\n|\.)?\s*[bBrRuUfF]{0,2}([\"'])((?:(?!\1)[^\\\n]|\\.)*)\1")
BARE = re.compile(r"^\s*(?:export\s+|-\s+)?([A-Za-z_][\w.-]*)\s*[:=]\s*([^\s'\"#;,(){}\[\]][^\s'\"]*)\s*(?:[#;].*)?$")
NOTE = re.compile(r"(?i)\b(pass(?:word|phrase|wd)?|pwd|secret|token|(?:api |old |new |access |deploy |private )?key|cred(?:ential)?s?|login|auth)\b[^\n:=]{0,40}[:=]\s*(?:[\w.@-]{1,40}\s+/\s+)?[`'\"]?([^\s'\"`]{8,})")
NOTE_MARK = re.compile(r"#|//|--|\*|;|\"\"\"")
LOOSE = re.compile(r"(?<![\w/+.-])[A-Za-z0-9+/_.-]{20,}={0,2}(?![\w(])")
#: Quoted strings without blanks or escapes.
SOLID = re.compile(r"([\"'`])([^\s\"'`\\]{20,})\1")
STRING = re.compile(r"[bBrRuUfF]{0,2}([\"'])((?:(?!\1)[^\\\n]|\\.)*)\1")
#: name and operator before a value, as far as they stand on its line.
NAME_BEFORE = re.compile(r"([A-Za-z_][\w.-]*)['\"]?\]?\s*(?::\s*[A-Za-z_][\w.\[\]]*\s*)?(?:=>|[:=])\s*[bBrRuUfF]{0,2}['\"`]?$")
# Words of names that say that a random value is no secret.
HARMLESS_WORDS = frozenset("digest hash hashes sha sha1 sha256 sha512 md5 crc checksum checksums integrity etag commit rev revision ref run build id ids uuid guid fingerprint nonce pub public pubkey data pixel image img icon logo blob chunk payload font base64 b64 signature version url uri href src path file cert certificate salt seed fixture expected".split())
#: A name whose value begins in a later line, and a name of a list or mapping.
CONTINUED = re.compile(r"([A-Za-z_][\w.-]*)['\"]?\]?[ \t]*(?:=>|[:=])[ \t]*(?:[\w.]*\(|\\)?[ \t]*(?:#[^\n]*)?$")
CONTAINER = re.compile(r"([A-Za-z_][\w.-]*)['\"]?\]?\s*(?:=>|[:=])\s*[\[{(]")
WORD_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def entropy(value: str) -> float:
    """Shannon entropy of a value in bits a character."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def alphabet(value: str) -> float:
    """Bits a character of the smallest usual alphabet that holds the value."""
    if value.isdigit():
        return math.log2(10)
    if HEX.match(value):
        return 4.0
    if value.islower() or value.isupper():
        return math.log2(36)
    return 6.0


def random_looking(value: str, strict: float = 1.0) -> bool:
    """Entropy above the threshold for the value's length and alphabet. n characters drawn from
    an alphabet of a bits show about min(a, log2(n)) bits, less a little for repeats."""
    expected = min(alphabet(value), math.log2(max(2, len(value))))
    return entropy(value) >= strict * (expected - SLACK)


def name_kind(name: str) -> str | None:
    """"password", "secret" or None: what a name promises of its value, by its last words."""
    words = [w.lower() for w in WORD_PART.findall(name) if not w.isdigit()]
    if not words or words[-1] not in SECRET_WORDS:
        return None
    if words[-1] == "key":
        return "secret" if len(words) > 1 and words[-2] in KEY_WORDS else "key"
    return "password" if words[-1] in PASSWORD_WORDS else "secret"


def is_secret(name: str, value: str) -> bool:
    """Whether value, given to name, is a usable secret."""
    if len(value) < 8 or " " in value or STAND_IN.search(value) or PUBLIC.match(value):
        return False
    kind = name_kind(name)
    if PREFIX.match(value):
        return len(value) >= 16 and entropy(value) > KNOWN_BITS
    if kind is None or UUID.match(value) and kind == "key":
        return False
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    if "://" in value or PATH.match(value):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:[_-][A-Z0-9]+)+|[a-z]+(?:[/_.-][a-z]+)+|[A-Z][a-z]*(?:-[A-Z][a-z]*)+|[a-z_]+\(.*\)?", value):
        return False  # the name of a secret, a header, a lookup
    symbols = any(c in "!#$%&*+=?@^~" for c in value)
    if kind == "key":
        return letters and digits and (symbols or len(value) >= 16 and random_looking(value))
    if HEX.match(value):
        return len(value) >= 16 and letters and digits and random_looking(value)
    if kind == "password" and letters and (digits or symbols):
        # words, a symbol and digits count as a password; a lone identifier with a number doesn't
        return entropy(value) > NAMED_BITS and (symbols or len(value) >= 12) or random_looking(value)
    return letters and digits and len(value) >= 12 and random_looking(value)


def unnamed_secret(value: str) -> bool:
    """Whether a value is random enough to be a secret whatever it is called."""
    if not UNNAMED_SIZE[0] <= len(value) <= UNNAMED_SIZE[1] or HEX.match(value) or "://" in value:
        return False
    kinds = ["U" if c.isupper() else "l" if c.islower() else "0" if c.isdigit() else "-" for c in value]
    if not {"U", "l", "0"} <= set(kinds) or sum(a != b for a, b in zip(kinds, kinds[1:])) < UNNAMED_CHANGES * (len(value) - 1):
        return False
    if entropy(value) < min(alphabet(value), math.log2(len(value))) - UNNAMED_SLACK:
        return False
    parts = [x for x in re.split(r"[^A-Za-z0-9]+", value) if x]
    if max(map(len, parts)) < 8 and not any(c in "!#$%&*?@^~" for c in value):
        return False  # words, dates and numbers joined by marks
    return not (UUID.match(value) or STAND_IN.search(value) or PUBLIC.match(value) or PATH.match(value))


def unnamed(text: str):
    """Spans of random values that no name makes a secret, over the whole text."""
    judged: list[tuple[int, int]] = []
    tokens = [m.span() for m in LOOSE.finditer(text)]
    solid = [m.span(2) for m in SOLID.finditer(text)]
    if not tokens and not solid:
        return
    for a, b in sorted([*solid, *((a, b) for a, b in tokens)], key=lambda x: (x[0], -x[1])):
        if judged and a < judged[-1][1]:
            continue
        if not unnamed_secret(text[a:b].rstrip(".")):
            # a string that fails is judged whole, so that what it holds doesn't pass by itself
            if (a, b) in solid:
                judged.append((a, b))
            continue
        judged.append((a, b))
        start = text.rfind("\n", 0, a) + 1
        lead = text[start:a]
        if m := NAME_BEFORE.search(lead):
            words = {w.lower() for w in WORD_PART.findall(m[1])} | {w.lower() for w in re.split(r"[_.-]", m[1])}
            if words & HARMLESS_WORDS or name_kind(m[1]) is not None:
                continue  # a name that promises a secret has been asked already
        if re.search(r"(?:\b[bB][rR]?['\"]|W/\\?['\"]|[;,]base64,\s*|sha\d+[-:]|ssh-\S+\s+|://\S*)$", lead):
            continue  # bytes, tags, embedded data, digests, public keys, addresses
        yield a, a + len(text[a:b].rstrip("."))


def below_name(text: str, start: int, end: int):
    """Spans of the values that a name in the line text[start:end] is given in later lines, or in a
    list or mapping."""
    line = text[start:end]
    if (m := CONTINUED.search(line)) and (v := STRING.match(text, end + len(re.match(r"\s*", text[end:end + 200])[0]))):
        value, spans, at = v[2], [v.span(2)], v.end()
        while (more := MORE.match(text, at)) and text[at : more.start(1)].strip(" bBrRuUfF\t\r\n\\") in ("+", "", ".") and (line.rstrip().endswith("(") or "+" in text[at : more.start(1)] or "\\" in text[at : more.start(1)]):
            value += more[2]
            spans.append(more.span(2))
            at = more.end()
        if text[at : at + 40].lstrip()[:1] != ":" and is_secret(m[1], value):
            yield spans
    for m in CONTAINER.finditer(line):
        single = re.sub(r"(?i)(?<=\w)s$", "", m[1])
        if single == m[1] or name_kind(single) not in ("password", "secret"):
            continue
        at, depth, stop = start + m.end(), 1, min(len(text), start + m.end() + CONTAINER_SIZE)
        while at < stop and depth:
            if text[at] in "'\"" and (v := STRING.match(text, at)):
                at = v.end()
                if text[at : at + 40].lstrip()[:1] != ":" and is_secret(single, v[2]):
                    yield [v.span(2)]
                continue
            depth += (text[at] in "[{(") - (text[at] in "]})")
            at += 1


def header_secret(kind: str, value: str) -> bool:
    if STAND_IN.search(value) or len(value) < 12:
        return False
    if kind.lower() == "basic":
        try:
            return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
        except ValueError:
            return False
    return bool(PREFIX.match(value)) or any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(value) >= 16 and random_looking(value)


def in_line(text: str, start: int, end: int):
    """Spans [(start, end), ...] of the secret values of a line; parts joined by + are one."""
    line = text[start:end]
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    for m in URL.finditer(line):
        if not STAND_IN.search(m[2]) and "{" not in m[2] and len(m[2]) >= 6 and m[2].lower() not in ("password", "passwd", "secret", "token") and free(*m.span(2)):
            taken.append(m.span(2))
            yield [m.span(2)]
    for m in CURL.finditer(line):
        if not STAND_IN.search(m[2]) and len(m[2]) >= 6 and "curl" in line.lower() and free(*m.span(2)):
            taken.append(m.span(2))
            yield [m.span(2)]
    for m in HEADER.finditer(line):
        if header_secret(m[1], m[2]) and free(*m.span(2)):
            taken.append(m.span(2))
            yield [m.span(2)]
    at, some = 0, False
    while m := QUOTED.search(line, at):
        some = True
        value, spans, at = m[3], [m.span(3)], m.end()
        while (more := MORE.match(line, at)) and line[at : more.start(1)].strip(" bBrRuUfF\t") in ("+", "", "."):
            value += more[2]
            spans.append(more.span(2))
            at = more.end()
        if not free(spans[0][0], spans[-1][1]):
            continue
        if is_secret(m[1], value):
            taken += spans
            yield spans
        else:
            at = min(at, m.end(2)) if value and QUOTED.search(line, m.start(3), m.end(3)) else at
    if (m := BARE.match(line)) and free(*m.span(2)) and is_secret(m[1], m[2]):
        taken.append(m.span(2))
        yield [m.span(2)]
    for m in FORMATS.finditer(line):
        if free(*m.span()) and not STAND_IN.search(m[0]) and entropy(m[0]) > KNOWN_BITS:
            taken.append(m.span())
            yield [m.span()]
    after = -1
    for m in () if some else NOTE.finditer(line):
        if after >= 0 and not NOTE_MARK.search(line, after, m.start(1)):
            continue  # a second note needs a mark of its own
        after = m.end()
        value = m[2].rstrip(".,;)")
        a = m.start(2)
        if free(a, a + len(value)) and is_secret(f"{m[1]}_token", value):
            taken.append((a, a + len(value)))
            yield [(a, a + len(value))]


def candidate_lines(text: str, lower: str) -> set[int]:
    """Starts of the lines that hold one of LINE_WORDS or LINE_MARKS."""
    starts: set[int] = set()
    for mark in LINE_MARKS:
        at = lower.find(mark)
        while at >= 0:
            starts.add(text.rfind("\n", 0, at) + 1)
            end = text.find("\n", at)
            at = lower.find(mark, end) if end >= 0 else -1
    for word in LINE_WORDS:
        size = len(word)
        at = lower.find(word)
        while at >= 0:
            after = lower[at + size : at + size + 2]
            if not after[:1].isalpha() or after[0] == "s" and not after[1:].isalpha():
                starts.add(text.rfind("\n", 0, at) + 1)
                end = text.find("\n", at)
                at = lower.find(word, end) if end >= 0 else -1
            else:
                at = lower.find(word, at + 1)
    return starts


def find(text: str | None):
    """(line number from 1, spans of the value) of every credential, in order."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c if len(x := c.lower()) > 1 else x for c in text)  # offsets stay
    starts = candidate_lines(text, lower)
    for m in FORMATS.finditer(text):
        starts.add(text.rfind("\n", 0, m.start()) + 1)
    out = []
    keys = []
    for m in PEM.finditer(text) if "PRIVATE KEY" in text else ():
        body = PEM_BODY.match(text, m.end())
        keys.append((m.start(), m.end(), body.end() if body else len(text)))
        stop = text.rfind("-----END", m.end(), body.end()) if body else len(text)
        out.append((text.count("\n", 0, m.start()) + 1, [(m.end(), stop)]))
    found = []
    for start in sorted(starts):
        if any(a <= start < c for a, _, c in keys):
            continue
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        found += [[(start + a, start + b) for a, b in spans] for spans in in_line(text, start, end)]
        # the credential is where its value begins
        found += below_name(text, start, end)
    found += [[span] for span in unnamed(text)]
    taken: list[tuple[int, int]] = [(a, c) for a, _, c in keys]
    for spans in found:
        if all(b <= x or a >= y for a, b in spans for x, y in taken):
            taken += spans
            out.append((text.count("\n", 0, spans[0][0]) + 1, spans))
    return sorted(out)


def redact(text: str | None) -> str | None:
    """The text with each value replaced. A key's body keeps its line breaks and what leads its lines."""
    found = find(text)
    if not found:
        return text
    out, last = [], 0
    for a, b, first in sorted((a, b, k == 0) for _, spans in found for k, (a, b) in enumerate(spans)):
        if a < last:
            continue
        out.append(text[last:a])
        body = text[a:b]
        out.append(re.sub(r"[A-Za-z0-9+/=]{16,}", MASK, body) if "\n" in body or "\\n" in body else MASK if first else "")
        last = b
    return "".join([*out, text[last:]])


# ---------------------------------------------------------------- tables

SCHEMA = pa.schema([("field", pa.string()), ("row_no", pa.int64()), ("line_no", pa.int64())])


def _texts(files: DataFrame | None, functions: DataFrame | None, methods: DataFrame | None) -> DataFrame:
    parts = []
    if files is not None:
        parts.append(files.select(F.lit("file_content").alias("field"), F.col("file_no").alias("row_no"), F.col("file_content").alias("text")))
    if functions is not None:
        both = F.array(F.struct(F.lit("function_code").alias("field"), F.col("function_code").alias("text")), F.struct(F.lit("context").alias("field"), F.col("context.context").alias("text")))
        parts.append(functions.select(F.col("unit_no").alias("row_no"), F.explode(both).alias("x")).select("x.field", "row_no", "x.text"))
    if methods is not None:
        parts.append(methods.select(F.lit("method_context").alias("field"), F.col("unit_no").alias("row_no"), F.col("context.context").alias("text")))
    return reduce(DataFrame.union, parts).where("text is not null")


def credentials(files: DataFrame | None = None, functions: DataFrame | None = None, methods: DataFrame | None = None) -> DataFrame:
    """Distinct (field, row_no, line_no) of the lines on which a credential begins.

    Null and empty texts have none, repeated rows count once. Each text is read whole by
    the task that scans it; only the found places are shuffled.
    """

    def run(batches):
        for batch in batches:
            found = [(f, n, line) for f, n, t in zip(*(c.to_pylist() for c in batch.columns)) for line, _ in find(t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), SCHEMA.types)], schema=SCHEMA)

    return spread(_texts(files, functions, methods)).mapInArrow(run, "field string, row_no long, line_no long").distinct()


def redacted(files: DataFrame | None = None, functions: DataFrame | None = None, methods: DataFrame | None = None) -> DataFrame:
    """Distinct (field, row_no, text) of every text, its credentials replaced by REDACTED."""
    schema = pa.schema([("field", pa.string()), ("row_no", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([redact(t) for t in batch.column(2).to_pylist()], pa.string())], schema=schema)

    return spread(_texts(files, functions, methods)).mapInArrow(run, "field string, row_no long, text string").distinct()
