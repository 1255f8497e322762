"""Recogniser of ECMAScript, script or module: a tokenizer and a predictive parser.

Ambiguities that need lookahead are decided on the token list: brackets are matched
first, so an arrow function is a parenthesis whose partner stands before =>. Patterns
are read as literals with defaults, as the standard's cover grammars do.
"""

from __future__ import annotations

import re

# Reserved words and punctuators of the language.
RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
PUNCTUATORS = (">>>=", "...", "===", "!==", "**=", "<<=", ">>=", ">>>", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "**", "{", "}", "(", ")", "[", "]", ";", ",", "<", ">", "+", "-", "*", "/", "%", "&", "|", "^", "!", "~", "?", ":", "=", ".", "@")
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PREFIX = frozenset("! ~ + - typeof void delete ++ --".split())

NAME = re.compile(r"#?(?:[A-Za-z_$\x80-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\x80-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|0[0-7]+|(?:0|[1-9](?:_?\d)*|0\d*[89]\d*)n|(?:(?:\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$])")
STRING = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'")
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
SPACE = re.compile(r"(?:[ \t\v\f\xa0﻿]|//[^\n\r]*|/\*[\s\S]*?\*/|[\n\r  ])+")
PUNCTUATOR = re.compile("|".join(map(re.escape, PUNCTUATORS)))
#: Words after which a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
PARTNER = {")": "(", "]": "[", "}": "{"}


class JsError(ValueError):
    """Not a program; at: offset of the first token that can't stand where it is."""

    def __init__(self, at: int, what: str):
        super().__init__(f"{what} at {at}")
        self.at, self.what = at, what


class Tokens:
    """Kinds, texts, offsets and line-break flags of the tokens, and partners of brackets."""

    def __init__(self, text: str, start: int = 0, inner: bool = False):
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self.broken: list[bool] = []
        self.partner: dict[int, int] = {}
        self.end = self._scan(text, start, inner)

    def _scan(self, src: str, pos: int, inner: bool) -> int:
        kind, text, at, broken, stack = self.kind, self.text, self.at, self.broken, []
        size = len(src)
        if pos == 0 and src.startswith("#!"):
            pos = (src.find("\n") + 1) or size
        name, number, string, space, punctuator = NAME.match, NUMBER.match, STRING.match, SPACE.match, PUNCTUATOR.match
        line = False
        while pos < size:
            c = src[pos]
            if c in " \t\n\r\v\f\xa0﻿  " or c == "/" and src[pos + 1 : pos + 2] in ("/", "*"):
                m = space(src, pos)
                if not m:
                    raise JsError(pos, "open comment")
                line = line or "\n" in m[0] or "\r" in m[0]
                pos = m.end()
                continue
            if c.isalpha() or c in "_$#\\" or c > "\x7f":
                m = name(src, pos)
                k = "n"
                if m and m[0] in RESERVED:
                    k = "k"
                if m and c > "\x7f" and not m[0][0].isidentifier():
                    m = None
            elif c.isdigit() or c == "." and src[pos + 1 : pos + 2].isdigit():
                m, k = number(src, pos), "d"
            elif c in "\"'":
                m, k = string(src, pos), "s"
            elif c == "`":
                end = self._template(src, pos)
                kind.append("t")
                text.append("`")
                at.append(pos)
                broken.append(line)
                line, pos = False, end
                continue
            elif c == "/" and self._regex_may_start():
                m, k = REGEX.match(src, pos), "r"
            else:
                m, k = punctuator(src, pos), "p"
                if m and m[0] == "?." and src[pos + 2 : pos + 3].isdigit():
                    m = re.compile(r"\?").match(src, pos)
                if m and c in "([{":
                    stack.append(len(kind))
                elif m and c in ")]}":
                    if not stack:
                        if inner and c == "}":
                            break
                        raise JsError(pos, "bracket never opened")
                    opener = stack.pop()
                    if text[opener] != PARTNER[c]:
                        raise JsError(pos, "brackets don't match")
                    self.partner[opener] = len(kind)
                    self.partner[len(kind)] = opener
            if not m:
                raise JsError(pos, "no token")
            kind.append(k)
            text.append(m[0])
            at.append(pos)
            broken.append(line)
            line, pos = False, m.end()
        if stack:
            raise JsError(size, "bracket never closed")
        kind.append("e")
        text.append("")
        at.append(pos)
        broken.append(True)
        return pos

    def _regex_may_start(self) -> bool:
        if not self.kind:
            return True
        k, t = self.kind[-1], self.text[-1]
        if k == "p":
            if t == ")":
                # after the head of if, for, while or with
                o = self.partner[len(self.kind) - 1]
                return o > 0 and self.text[o - 1] in ("if", "while", "for", "with") and self.text[o - 2 : o - 1] != ["."]
            return t not in ("]", "}", "++", "--")
        return k in "nk" and t in BEFORE_REGEX

    def _template(self, src: str, pos: int) -> int:
        start, pos = pos, pos + 1
        while pos < len(src):
            c = src[pos]
            if c == "\\":
                pos += 2
            elif c == "`":
                return pos + 1
            elif c == "$" and src[pos + 1 : pos + 2] == "{":
                inner = Tokens(src, pos + 2, True)
                if src[inner.end : inner.end + 1] != "}":
                    break
                p = Parser(inner)
                p.expression()
                if p.k != "e":
                    raise JsError(p.tokens.at[p.i], "unexpected token in a template")
                pos = inner.end + 1
            else:
                pos += 1
        raise JsError(len(src), f"open template from {start}")


class Parser:
    """Predictive parser. Expressions return 1 for a name or member, 2 for an array or object, else 0."""

    def __init__(self, tokens: Tokens):
        self.tokens, self.i = tokens, 0
        self.text, self.kind, self.broken = tokens.text, tokens.kind, tokens.broken

    @property
    def t(self) -> str:
        i = self.i
        return self.text[i] if self.kind[i] in "pnk" else ""

    @property
    def k(self) -> str:
        return self.kind[self.i]

    def fail(self, what: str = "unexpected token"):
        raise JsError(self.tokens.at[self.i], what)

    def take(self, text: str) -> None:
        if self.text[self.i] != text or self.kind[self.i] not in "pnk":
            self.fail(f"no {text}")
        self.i += 1

    def ahead(self, n: int = 1) -> str:
        j = min(self.i + n, len(self.text) - 1)
        return self.text[j] if self.kind[j] in "pnk" else ""

    def semicolon(self) -> None:
        if self.t == ";":
            self.i += 1
        elif self.t != "}" and self.k != "e" and not self.broken[self.i]:
            self.fail()

    def identifier(self) -> None:
        if self.k != "n" or self.text[self.i].startswith("#"):
            self.fail("no identifier")
        self.i += 1

    # -------------------------------------------------- statements

    def program(self) -> None:
        while self.k != "e":
            self.statement()

    def block(self) -> None:
        self.take("{")
        while self.t != "}":
            if self.k == "e":
                self.fail()
            self.statement()
        self.i += 1

    def parenthesized(self) -> None:
        self.take("(")
        self.expression()
        self.take(")")

    def statement(self) -> None:
        t, k = self.t, self.k
        if k == "p":
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return None
            if t == "@":
                self.decorators()
                return self.statement()
        elif k == "k":
            method = getattr(self, f"s_{t}", None)
            if method is not None and not (t == "import" and self.ahead() in ("(", ".")):
                self.i += 1
                return method()
            if t in ("else", "catch", "finally", "case", "default", "extends", "in", "instanceof", "enum"):
                self.fail()
        elif k == "n":
            n = self.ahead()
            if n == ":" and t:
                self.i += 2
                return self.statement()
            if t == "async" and n == "function" and not self.broken[self.i + 1]:
                self.i += 2
                return self.function(True)
            if t == "let" and (self.kind[self.i + 1] == "n" or n in ("[", "{")):
                self.i += 1
                return self.declarations(True)
        self.expression()
        return self.semicolon()

    def declarations(self, end: bool, no_in: bool = False) -> bool:
        """Bindings after var, let or const; whether there was one binding without a value."""
        bare, n = False, 0
        while True:
            self.binding()
            n += 1
            bare = True
            if self.t == "=":
                self.i += 1
                self.assignment(no_in)
                bare = False
            if self.t != ",":
                break
            self.i += 1
        if end:
            self.semicolon()
        return n == 1

    def binding(self) -> None:
        if self.t in ("{", "["):
            self.primary()
        else:
            self.identifier()

    def s_var(self):
        self.declarations(True)

    s_const = s_var

    def s_if(self):
        self.parenthesized()
        self.statement()
        if self.t == "else":
            self.i += 1
            self.statement()

    def s_while(self):
        self.parenthesized()
        self.statement()

    s_with = s_while

    def s_do(self):
        self.statement()
        self.take("while")
        self.parenthesized()
        if self.t == ";":
            self.i += 1

    def s_for(self):
        if self.t == "await":
            self.i += 1
        self.take("(")
        if self.t in ("var", "const") or self.t == "let" and self.ahead() not in ("in", "of", ";", "=", "."):
            self.i += 1
            one = self.declarations(False, True)
        elif self.t == ";":
            one = False
        else:
            one = self.expression(True) > 0
        if self.t in ("in", "of") and one:
            of = self.t == "of"
            self.i += 1
            self.assignment() if of else self.expression()
        else:
            self.take(";")
            if self.t != ";":
                self.expression()
            self.take(";")
            if self.t != ")":
                self.expression()
        self.take(")")
        self.statement()

    def s_return(self):
        if self.t not in (";", "}") and self.k != "e" and not self.broken[self.i]:
            self.expression()
        self.semicolon()

    def s_throw(self):
        if self.broken[self.i]:
            self.fail()
        self.expression()
        self.semicolon()

    def s_break(self):
        if self.k == "n" and not self.broken[self.i]:
            self.i += 1
        self.semicolon()

    s_continue = s_break

    def s_debugger(self):
        self.semicolon()

    def s_switch(self):
        self.parenthesized()
        self.take("{")
        while self.t != "}":
            if self.t == "case":
                self.i += 1
                self.expression()
            else:
                self.take("default")
            self.take(":")
            while self.t not in ("case", "default", "}"):
                if self.k == "e":
                    self.fail()
                self.statement()
        self.i += 1

    def s_try(self):
        self.block()
        caught = self.t == "catch"
        if caught:
            self.i += 1
            if self.t == "(":
                self.i += 1
                self.binding()
                self.take(")")
            self.block()
        if self.t == "finally":
            self.i += 1
            self.block()
        elif not caught:
            self.fail()

    def s_function(self):
        self.function(True)

    def s_class(self):
        self.class_body(True)

    def decorators(self) -> None:
        while self.t == "@":
            self.i += 1
            self.unary_tail(self.primary())

    def s_import(self):
        if self.k == "s":
            self.i += 1
        else:
            if self.k == "n" and self.t:
                self.i += 1
                if self.t == ",":
                    self.i += 1
                    if self.t not in ("{", "*"):
                        self.fail()
            if self.t == "*":
                self.i += 1
                self.take("as")
                self.identifier()
            elif self.t == "{":
                self.specifiers()
            self.take("from")
            self.module_name()
        self.attributes()
        self.semicolon()

    def module_name(self) -> None:
        if self.k != "s":
            self.fail("no module name")
        self.i += 1

    def attributes(self) -> None:
        if self.t in ("with", "assert") and self.ahead() == "{" and not (self.t == "assert" and self.broken[self.i]):
            self.i += 1
            self.primary()

    def specifiers(self) -> None:
        self.take("{")
        while self.t != "}":
            for part in (0, 1):
                if self.k not in "nks":
                    self.fail()
                self.i += 1
                if part == 0 and self.t != "as":
                    break
                if part == 0:
                    self.i += 1
            if self.t != "}":
                self.take(",")
        self.i += 1

    def s_export(self):
        if self.t == "default":
            self.i += 1
            if self.t == "function":
                self.i += 1
                return self.function(False)
            if self.t == "async" and self.ahead() == "function":
                self.i += 2
                return self.function(False)
            if self.t == "class":
                self.i += 1
                return self.class_body(False)
            self.assignment()
            return self.semicolon()
        if self.t == "*":
            self.i += 1
            if self.t == "as":
                self.i += 1
                if self.k not in "nks":
                    self.fail()
                self.i += 1
            self.take("from")
            self.module_name()
            self.attributes()
            return self.semicolon()
        if self.t == "{":
            self.specifiers()
            if self.t == "from":
                self.i += 1
                self.module_name()
                self.attributes()
            return self.semicolon()
        if self.t in ("var", "const", "function", "class", "let", "@") or self.t == "async" and self.ahead() == "function":
            return self.statement()
        return self.fail()

    # -------------------------------------------------- functions and classes

    def function(self, named: bool) -> None:
        if self.t == "*":
            self.i += 1
        if self.k == "n":
            self.i += 1
        elif named:
            self.fail("no name")
        self.parameters()
        self.block()

    def parameters(self) -> None:
        self.take("(")
        while self.t != ")":
            if self.t == "...":
                self.i += 1
            self.binding()
            if self.t == "=":
                self.i += 1
                self.assignment()
            if self.t != ")":
                self.take(",")
        self.i += 1

    def class_body(self, named: bool) -> None:
        if self.k == "n":
            self.i += 1
        elif named:
            self.fail("no name")
        if self.t == "extends":
            self.i += 1
            self.unary_tail(self.primary())
        self.take("{")
        while self.t != "}":
            if self.t == ";":
                self.i += 1
                continue
            if self.k == "e":
                self.fail()
            self.decorators()
            if self.t == "static" and self.ahead() == "{":
                self.i += 1
                self.block()
                continue
            self.member(True)
        self.i += 1

    def key(self) -> None:
        if self.t == "[":
            self.i += 1
            self.assignment()
            self.take("]")
        elif self.k in "nksd":
            self.i += 1
        else:
            self.fail("no key")

    def member(self, in_class: bool) -> None:
        """A member of a class or an object literal."""
        end = ("(", "=", ";", "}", ",", ":")
        while self.t in ("static", "async", "get", "set") and self.ahead() not in end and not (self.t == "static" and not in_class):
            if in_class and self.broken[self.i + 1] and self.t != "static":
                break
            self.i += 1
        if self.t == "*":
            self.i += 1
        simple = self.k == "n"
        self.key()
        if self.t == "(":
            self.parameters()
            self.block()
        elif in_class:
            if self.t == "=":
                self.i += 1
                self.assignment()
            self.semicolon()
        elif self.t == ":":
            self.i += 1
            self.assignment()
        elif simple:
            if self.t == "=":
                self.i += 1
                self.assignment()
        else:
            self.fail()

    # -------------------------------------------------- expressions

    def expression(self, no_in: bool = False) -> int:
        kind = self.assignment(no_in)
        while self.t == ",":
            self.i += 1
            kind = self.assignment(no_in) * 0
        return kind

    def arrow_body(self, no_in: bool) -> int:
        if self.broken[self.i]:
            self.fail()
        self.take("=>")
        if self.t == "{":
            self.block()
        else:
            self.assignment(no_in)
        return 0

    def assignment(self, no_in: bool = False) -> int:
        t, k = self.t, self.k
        if k == "n":
            if self.ahead() == "=>":
                self.i += 1
                return self.arrow_body(no_in)
            if t == "async" and not self.broken[self.i + 1]:
                if self.kind[self.i + 1] == "n" and self.ahead(2) == "=>":
                    self.i += 2
                    return self.arrow_body(no_in)
                if self.ahead() == "(" and self.text[self.tokens.partner[self.i + 1] + 1] == "=>":
                    self.i += 1
                    self.parameters()
                    return self.arrow_body(no_in)
            if t == "yield" and (self.ahead() == "*" or self.ahead() not in (")", "]", "}", ",", ";", ":", "=", ".", "(", "[") and self.kind[self.i + 1] != "e" and not self.broken[self.i + 1]):
                self.i += 1
                if self.t == "*":
                    self.i += 1
                return self.assignment(no_in) * 0
        elif t == "(":
            j = self.tokens.partner[self.i] + 1
            if self.text[j] == "=>" and self.kind[j] == "p":
                self.parameters()
                return self.arrow_body(no_in)
        kind = self.binary(0, no_in)
        if self.t == "?":
            self.i += 1
            self.assignment()
            self.take(":")
            return self.assignment(no_in) * 0
        if self.k == "p" and self.t in ASSIGN:
            if not kind or kind == 2 and self.t != "=":
                self.fail("no target")
            self.i += 1
            return self.assignment(no_in) * 0
        return kind

    def binary(self, least: int, no_in: bool) -> int:
        kind = self.unary()
        while True:
            op = self.t
            power = BINARY.get(op, 0) if self.k in "pk" else 0
            if power <= least or no_in and op == "in":
                return kind
            self.i += 1
            self.binary(power - (op == "**"), no_in)
            kind = 0

    def unary(self) -> int:
        t, k = self.t, self.k
        if k in "pk" and t in PREFIX:
            self.i += 1
            kind = self.unary()
            if t in ("++", "--") and kind != 1:
                self.fail("no target")
            return 0
        if t == "await" and k == "n" and (self.kind[self.i + 1] in "nkdstr" and self.ahead() not in ("in", "instanceof", "of") or self.ahead() in ("(", "[", "{", "!", "+", "-")) and not self.broken[self.i + 1]:
            self.i += 1
            self.unary()
            return 0
        if k == "n" and t.startswith("#") and self.ahead() == "in":
            self.i += 1
            return 0
        kind = self.unary_tail(self.primary())
        if self.t in ("++", "--") and not self.broken[self.i]:
            if kind != 1:
                self.fail("no target")
            self.i += 1
            return 0
        return kind

    def unary_tail(self, kind: int, calls: bool = True) -> int:
        while True:
            t = self.t
            if t == ".":
                self.i += 1
                if self.k not in "nk":
                    self.fail()
                self.i += 1
                kind = 1
            elif t == "?." and calls:
                self.i += 1
                if self.k in "nk":
                    self.i += 1
                elif self.t == "[":
                    self.i += 1
                    self.expression()
                    self.take("]")
                elif self.t == "(":
                    self.arguments()
                else:
                    self.fail()
                kind = 0
            elif t == "[":
                self.i += 1
                self.expression()
                self.take("]")
                kind = 1
            elif t == "(" and calls:
                self.arguments()
                kind = 0
            elif self.k == "t":
                self.i += 1
                kind = 0
            else:
                return kind

    def arguments(self) -> None:
        self.take("(")
        while self.t != ")":
            if self.t == "...":
                self.i += 1
            self.assignment()
            if self.t != ")":
                self.take(",")
        self.i += 1

    def primary(self) -> int:
        t, k = self.t, self.k
        if k == "n":
            if t == "async" and self.ahead() == "function" and not self.broken[self.i + 1]:
                self.i += 2
                self.function(False)
                return 0
            if t.startswith("#"):
                self.fail()
            self.i += 1
            return 1
        if k in "dstr":
            self.i += 1
            return 0
        if t == "(":
            self.i += 1
            kind = self.expression()
            self.take(")")
            return 1 if kind == 1 else 0
        if t == "[":
            self.i += 1
            while self.t != "]":
                if self.t == ",":
                    self.i += 1
                    continue
                if self.t == "...":
                    self.i += 1
                self.assignment()
                if self.t != "]":
                    self.take(",")
            self.i += 1
            return 2
        if t == "{":
            self.i += 1
            while self.t != "}":
                if self.t == "...":
                    self.i += 1
                    self.assignment()
                else:
                    self.member(False)
                if self.t != "}":
                    self.take(",")
            self.i += 1
            return 2
        if t in ("this", "null", "true", "false", "super"):
            self.i += 1
            return 0
        if t == "function":
            self.i += 1
            self.function(False)
            return 0
        if t in ("class", "@"):
            self.decorators()
            self.take("class")
            self.class_body(False)
            return 0
        if t == "new":
            self.i += 1
            if self.t == ".":
                self.i += 1
                self.take("target")
                return 0
            self.unary_tail(self.primary(), False)
            if self.t == "(":
                self.arguments()
            return 0
        if t == "import":
            self.i += 1
            if self.t == ".":
                self.i += 1
                self.take("meta")
                return 0
            self.arguments()
            return 0
        self.fail()
        return 0


def check(text: str) -> None:
    """Raises JsError where the text is no script and no module."""
    Parser(Tokens(text)).program()
