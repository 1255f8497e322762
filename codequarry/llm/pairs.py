"""Broken prompt and response pairs.

Each response is judged against the last user message. The instruction becomes a suffix
automaton over its words; what of the response lies on it is copied. Refusals are found
by an automaton of phrase parts, cut responses by stacks of fences, brackets, quotes
and blocks, foreign remarks by votes of stopwords. One defect is given per task, the
first of: empty, copy, refusal, truncated, other_language.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .stopwords import vote

# Lines that stand in for an answer.
STAND_INS = ("your code here", "your test here", "your tests here", "add your code here", "write your code here", "insert code here", "code goes here", "test goes here", "tests go here", "todo", "fixme", "tbd", "xxx", "pass", "n a", "na", "none", "null", "nil", "empty", "no output", "no response", "no answer", "placeholder", "to be done", "to be written", "to do", "write test here", "write tests here", "todo write test", "todo write tests", "todo add test", "todo add tests", "todo implement", "not implemented", "notimplemented", "insert test here", "lorem ipsum", "answer", "response", "code", "test", "coming soon", "work in progress", "wip")

#: What a word or phrase says in a sentence. A sentence declines if it says so as a whole, or
#: denies (NEGATION) of the speaker (SELF) an ability, a permission or a will (MODAL).
SELF, MODAL, NEGATION, DECLINES = 1, 2, 4, 8
REFUSALS = {
    SELF: "i|i'm|i'll|i'd|me|my|we|our|ich|mir|mich|meine|meinen|meiner|wir|uns|je|j'ai|moi|mes|nous|yo|mi|mis|eu|mim|meu|minha|minhas|я|мне|меня|мои|мы|нам|我|私|当方|弊",
    MODAL: "can|could|may|will|would|shall|should|able|let|allow|allows|allowed|permitted|possible|going to|want to|feel comfortable|kann|können|darf|dürfen|möchte|will|werde|werden|möglich|lassen|erlauben|erlaubt|imstande|lage|peut|possible|permet|permettent|autorisé|autorisée|mesure|posible|permiten|permite|capaz|possível|permitem|можно|возможно|позволяют|вправе|能|可|会|便",
    NEGATION: "not|no|never|nicht|kein|keine|keinen|keinem|keiner|nie|ne|n'|pas|non|ni|nunca|não|nem|не|ни|нет|不|无|未",
    SELF | MODAL: "puedo|debo|quiero|podré|podemos|voy a|posso|devo|quero|vou|podemos|могу|можем|смогу|буду|хочу|peux|puis|veux|dois|vais|pouvons",
    MODAL | NEGATION: "can't|cannot|couldn't|won't|wouldn't|shan't|mustn't|нельзя|невозможно",
    NEGATION | SELF: "i don't|i'm not|i am not|i do not|n'ai|n'aimerais",
    DECLINES: "unable|not possible|nicht möglich|pas possible|no es posible|não é possível|не возможно|refuse|decline|must pass on|rather not|as a language model|as an ai|against my policy|against my guidelines|my guidelines do not|not enough information|ablehnen|lehne|verweigern|verweigere|weigere|absehen|refuser|je refuse|refusons|décliner|décline|rechazar|rechazo|me niego|declino|recusar|recuso|me nego|отказать|отказаться|отказываюсь|отказываемся|无法|不能|不会|不便|不可以|不允许|拒绝|恕|できません|できかね|しかね|ません|お断り|できない|控え",
}

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿ﾠ\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
FENCE = re.compile(r"^\s*(?:>\s*)*(?:```+|~~~+)\s*[\w+#.-]*\s*$")
WORDS = re.compile(r"[^\W_]+")
PHRASE = re.compile(r"[぀-ヿ一-鿿]|(?:(?![぀-ヿ一-鿿])[^\W\d_])+(?:['’][^\W\d_]+)*")
SENTENCE = re.compile(r"[.!?。！？]+(?=\s|$)|[。！？]|\n\s*\n")
CODE_LINE = re.compile(r"^(?:\s+\S.*|(?:import|from|class|def|async|await|with|for|while|if|elif|else|try|except|finally|return|raise|assert|global|lambda|pass|del)\b.*|@\w.*|#.*|[\w.]+\s*(?:[-+*/%|&^]|//|\*\*)?=(?!=).*|[\w.]+\(.*|[)\]}]+.*|[\"']{3}.*)$")
PROSE_END = tuple(".!?:;…。！？：；」』）)]}`'\"”’»*")
TEST_CODE = re.compile(r"^\s*(?:async\s+def|def|class)\s+\w|^\s*(?:self\.)?assert\w*\b|\.assert\w+\(|^\s*(?:import|from)\s+\w+", re.M)


# ---------------------------------------------------------------- automata


class SuffixAutomaton:
    """All runs of words of one text."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in words:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][word]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(word) == q:
                        self.next[p][word] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, words: list[str], least: int) -> int:
        """How many of the words lie in runs of at least `least` words on the automaton."""
        state = run = covered = end = 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                run += 1
            else:
                run = 0
            if run >= least:
                start = max(end, at + 1 - run)
                covered += at + 1 - start
                end = at + 1
        return covered


class PhraseAutomaton:
    """Aho-Corasick automaton over words; phrases bring marks that are joined."""

    def __init__(self, phrases, marks=None):
        self.next: list[dict[str, int]] = [{}]
        self.mark = [0]
        for phrase, mark in zip(phrases, marks or [1] * len(phrases)):
            state = 0
            for word in phrase:
                if word not in self.next[state]:
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.mark.append(0)
                state = self.next[state][word]
            self.mark[state] |= mark
        self.fail = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            for word, to in self.next[state].items():
                f = self.fail[state]
                while f and word not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(word, 0) if self.next[f].get(word, 0) != to else 0
                self.mark[to] |= self.mark[self.fail[to]]
                todo.append(to)

    def marks(self, words) -> int:
        """The marks of all phrases that the words hold."""
        state = got = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(word, 0)
            got |= self.mark[state]
        return got

    def accepts(self, words) -> bool:
        return self.marks(words) != 0


REFUSAL_AUTOMATON = PhraseAutomaton(*zip(*((PHRASE.findall(p), mark) for mark, some in REFUSALS.items() for p in some.split("|"))))


# ---------------------------------------------------------------- parts of a response


def parts(text: str) -> tuple[list[str], list[str], bool]:
    """(code pieces, prose pieces in order, whether a fence is left open) of a response."""
    code: list[str] = []
    prose: list[str] = []
    fenced: list[str] | None = None
    loose: list[str] = []

    def flush():
        run: list[str] = []
        kind = None
        for line in loose:
            now = kind if not line.strip() else bool(CODE_LINE.match(line)) and (line[:1] in " \t" and kind is True or line[:1] not in " \t")
            if now != kind and run and kind is not None:
                (code if kind else prose).append("\n".join(run))
                run = []
            kind = now
            run.append(line)
        if any(x.strip() for x in run):
            (code if kind else prose).append("\n".join(run))
        loose.clear()

    for line in text.split("\n"):
        if FENCE.match(line):
            if fenced is None:
                flush()
                fenced = []
            else:
                code.append("\n".join(fenced))
                fenced = None
        elif fenced is None:
            loose.append(line)
        else:
            fenced.append(line)
    flush()
    if fenced is not None:
        code.append("\n".join(fenced))
    return code, prose, fenced is not None


def blank(text: str) -> str:
    return INVISIBLE.sub("", text).strip()


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, invisible characters, fences or one stand-in line."""
    if text is None:
        return True
    left: list[str] = []
    for line in INVISIBLE.sub("", text).split("\n"):
        if line.strip() and not FENCE.match(line):
            left.append(line.strip())
            if len(left) > 1 and any(WORDS.search(x) for x in left):
                return False
    if not left:
        return True
    words = " ".join(w for x in left for w in WORDS.findall(x.lower()))
    return not words or len(left) == 1 and words in STAND_INS


def is_copy(instruction: str | None, text: str, least: int = 3, share: float = 0.9) -> bool:
    """At least `share` of the response's words lie in runs of `least` words of the instruction."""
    if not instruction:
        return False
    words, whole = WORDS.findall(text.lower()), instruction.lower()
    allowed = len(words) - share * len(words)
    for word in words:
        if word not in whole:  # not even as part of a word
            allowed -= 1
            if allowed < 0:
                return False  # coverage can't reach the share
    source = WORDS.findall(whole)
    if not words or not source:
        return False
    return SuffixAutomaton(source).covered(words, min(least, len(words), len(source))) >= share * len(words)


def has_test(text: str) -> bool:
    return bool(TEST_CODE.search(text))


def declines(text: str) -> bool:
    """Whether a sentence of the text declines."""
    return any((m := REFUSAL_AUTOMATON.marks(PHRASE.findall(x))) & DECLINES or m & 7 == 7 for x in SENTENCE.split(text.lower().replace("’", "'")))


def is_refusal(text: str) -> bool:
    """Declines and gives no test."""
    return not has_test(text) and declines(text)


def open_delimiters(code: str) -> bool:
    """Whether the stack of brackets and quotes isn't empty at the end of the code."""
    stack: list[str] = []
    quote = ""
    i, n = 0, len(code)
    pairs = {")": "(", "]": "[", "}": "{"}
    while i < n:
        c = code[i]
        if quote:
            if c == "\\":
                i += 1
            elif code.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
            elif c == "\n" and len(quote) == 1:
                return i == n - 1
        elif c in "\"'":
            quote = c * 3 if code.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c == "#":
            while i < n and code[i] != "\n":
                i += 1
        elif c in "([{":
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
        i += 1
    return bool(quote or stack)


def code_cut(code: str) -> bool:
    """Whether Python code ends before it is complete."""
    body = code.strip("\n")
    if not body.strip() or not has_test(body):
        return False
    last = max(i for i, x in enumerate(body.split("\n")) if x.strip()) + 1
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(body)
    except (SyntaxError, ValueError) as e:
        # only code that doesn't parse can have an open delimiter
        return open_delimiters(body) or getattr(e, "lineno", None) is None or e.lineno >= last
    except (RecursionError, MemoryError):
        return open_delimiters(body)
    node: ast.AST = tree
    while isinstance(getattr(node, "body", None), list) and node.body:
        node = node.body[-1]
    if isinstance(node, ast.Expr) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return True
    if isinstance(node, ast.Assign):  # a value that nothing reads: the check is missing
        names = {t.id for t in node.targets if isinstance(t, ast.Name)}
        return bool(names) and not any(isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and x.id in names for x in ast.walk(tree)) and any(isinstance(x, ast.FunctionDef) for x in ast.walk(tree))
    return False


def is_truncated(text: str, split: tuple[list[str], list[str], bool] | None = None) -> bool:
    """Ends before its code or its last sentence is complete; split: the text's parts."""
    code, prose, is_open = split or parts(text)
    if is_open:
        return True
    if any(code_cut(c) for c in code):
        return True
    tail = blank(text).split("\n")[-1].rstrip()
    if prose and tail and blank(prose[-1]).split("\n")[-1].rstrip() == tail and not tail.endswith(PROSE_END):
        return True
    return not code and not has_test(text) and not is_refusal(text)


def remarks(text: str, instruction: str = "", split: tuple[list[str], list[str], bool] | None = None) -> str:
    """The prose and the comments of a response, without lines that the instruction has too."""
    code, prose, _ = split or parts(text)
    given = {x.strip() for x in instruction.split("\n")}
    lines = [x for p in prose for x in p.split("\n")]
    own = [x for c in code for x in c.split("\n") if x.strip() not in given]
    notes = [m for m in re.findall(r"(?m)#\s?(.*)$|\"{3}(.*?)\"{3}", "\n".join(own))]
    plain = [re.sub(r"`[^`]*`", " ", x) for x in lines if x.strip() not in given]
    return "\n".join(plain + [a or b for a, b in notes])


def request(instruction: str) -> str:
    """The instruction without code blocks and quoted code."""
    out, fenced = [], False
    for line in instruction.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            out.append(re.sub(r"`[^`]*`", " ", line))
    return "\n".join(out)


def is_foreign(instruction: str | None, text: str, split: tuple[list[str], list[str], bool] | None = None) -> bool:
    """The remarks are in another natural language than the instruction."""
    if not instruction or (given := vote(remarks(text, instruction, split))) is None:
        return False
    asked = vote(request(instruction))
    return asked is not None and asked != given


def defect(instruction: str | None, response: str | None) -> str | None:
    """The pair's defect, None for a usable pair."""
    if is_empty(response):
        return "empty"
    if is_copy(instruction, response):
        return "copy"
    if is_refusal(response):
        return "refusal"
    split = parts(response)
    if is_truncated(response, split):
        return "truncated"
    if is_foreign(instruction, response, split):
        return "other_language"
    return None


def broken_pairs(tasks: DataFrame) -> DataFrame:
    """Distinct (task_no, defect) of the tasks whose response is defective.

    The instruction is the last message of role user; without one, copying and foreign
    remarks can't be judged. The response is generated_test, or else the values of tests
    in the order of their keys, a null value as an empty text; without either it is
    empty. Repeated rows count once; other columns are not read.
    """
    users = F.filter("chat_messages", lambda m: m["role"] == "user")
    values = F.transform(F.array_sort(F.map_entries("tests")), lambda e: F.coalesce(e["value"], F.lit("")))
    pairs = spread(tasks.select("task_no", "chat_messages", "generated_test", "tests")).select(
        F.col("task_no").cast("long").alias("task_no"), F.try_element_at(users, F.lit(-1))["content"].alias("instruction"), F.coalesce("generated_test", F.array_join(values, "\n")).alias("response")
    )
    schema = pa.schema([("task_no", pa.int64()), ("defect", pa.string())])

    def run(batches):
        for batch in batches:
            found = [(n, d) for n, i, r in zip(*(c.to_pylist() for c in batch.columns)) if (d := defect(i, r))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return pairs.mapInArrow(run, "task_no long, defect string").distinct()
