import ast

import pytest

from codequarry.functions import freevars as V
from codequarry.functions import identifiers as I
from codequarry.functions import instrument, rewrite, source


@pytest.mark.parametrize("code, names", [
    ("y[a:b:x[c]]", "y a b x c"), ("lambda x: x+1+z", "z"), ("{a:b for a,b in c if a+d >= 0}", "c d"), ("(a := b)", "b"), ("f(a, k=v)", "f a"), ("f'{a+b} {c!r:>{w}}'", "a b c"), ("[x+a for a in b for b in c if len(b)+y]", "c x y len"), ("1", ""), ("a.b.c", "a"), ("{**k, 1: v}", "k v"),
])
def test_expression_names(code, names):
    assert set(V.expression_names(ast.parse(code).body[0].value)) == set(names.split())


@pytest.mark.parametrize("code, names", [
    ("a = b + c", "b c"), ("a += 1", "a"), ("a : int = b + c", "b c"), ("while i < 9:\n i = i - 1\n j = j + 1", "i j"), ("for i in range(n):\n t : T = a[i]\n a[i] = t", "n T a"),
    ("def f(a: str, b=c.d):\n import os\n global e\n e += g(a, k=h)\n return f() + os.x", "c e g h"), ("class A(B):\n x = y\n def m(self):\n  return A.x + x + self.z", "B y x"),
    ("def f():\n def g():\n  return later\n later = 1\n return g", ""), ("def f():\n x = [u for v in w for u in v]\n return {k: s for k in x}", "w s"), ("try:\n a()\nexcept E as e:\n print(e)", "a E"),
    ("def f(p: 'Thing', q: Literal['no']) -> Optional[None]: pass", "Thing Literal Optional"), ("@deco(arg)\ndef f(): pass", "deco arg"), ("match s:\n case K(x=1): r = x2\n case [h, *t]: r = h", "s K x2"),
])
def test_dependency_names(code, names):
    assert V.dependency_names(ast.parse(code).body[0]) == sorted(names.split())


def test_statement_and_annotation_rules():
    one = lambda c: ast.parse(c).body[0]
    assert set(V.statement_names(one("a = b + c(a)"))) == {"a", "b", "c"}
    assert V.statement_names(one("a : int = b")) == ["int", "b"]
    assert V.annotations(one("def f(a: Literal['x', 'y'], b: int | None): pass")) == ["Literal", "int", "None"]
    assert set(V.default_names(one("def f(a=c.d, b=bar(x=y)): pass"))) == {"c", "bar"}
    assert V.decorator_names(one("@p.setter\n@functools.wraps(f)\n@q(r)\ndef f(): pass")) == ["q", "r"]


def test_units_and_features():
    tree, error = source.tree_of('import os\ndef f(a, *, b=1, **k):\n    """Doc."""\n    x = a\n    return 1\n\nclass C:\n    @staticmethod\n    def m(q):\n        return q\n    def m(self):\n        return 2\nasync def g(): pass\n')
    assert error is None
    u = source.units(tree, "p.q")
    assert [(x["unit_id"], x["def_ord"], x["n_args"], x["n_code_lines"], x["n_top_returns"], x["n_const_returns"]) for x in u] == [("p.q.f", 0, 3, 2, 1, 1), ("p.q.C.m", 0, 1, 1, 1, 0), ("p.q.C.m", 1, 1, 1, 1, 1)]
    assert u[1]["decorators"] == ["staticmethod"] and u[0]["docstring"] == "Doc."
    assert source.members(tree) == ["os", "f", "C", "g"]
    assert source.tree_of("def (")[1].startswith("SyntaxError") and source.tree_of(None) == (None, "no content") and source.tree_of("x\0")[0] is None
    assert source.signature_and_doc("def f(a, b=2):\n '''One two three.'''\n", 9) == ("f(a, b=2)", "One...")


def test_statements_flatten():
    text = "import a, b as c\nif x:\n    y = 1\nelse:\n    z = y\nfor i in y:\n    pass\nwith o() as p:\n    q = p\n"
    rows = source.statements(source.tree_of(text)[0], text)
    assert [(r["idx"], r["orig_idx"], r["kind"], r["defines"]) for r in rows] == [(0, 0, "Import", ["a"]), (1, 0, "Import", ["c"]), (2, 1, "Expr", []), (3, 1, "Assign", ["y"]), (4, 1, "Assign", ["z"]), (5, 2, "Assign", ["i"]), (6, 2, "Pass", []), (7, 3, "Assign", ["p"]), (8, 3, "Assign", ["q"])]


def test_rewrites():
    text = "from m import f as g\ng()\nclass A:\n    'doc'\n    def a(self): return 1\n    def b(self): return 2\n"
    assert "def a" not in rewrite.without_methods(text, ["a"]) and rewrite.without_class(text, "A")[1].startswith("class A")
    assert rewrite.method_last(text, "A", "a").index("def b") < rewrite.method_last(text, "A", "a").index("def a")
    assert rewrite.unaliased(text, rewrite.aliases(text, ["f"])).startswith("from m import f\nf()")
    assert "# ..." in rewrite.only_method(text, "A", "b") and "def a" not in rewrite.only_method(text, "A", "b")
    assert "def b" not in rewrite.without_last(text) and rewrite.without_last("x = 1\n") == ""
    assert [rewrite.absolute_import("s", n, "p.q") for n in (0, 1, 2, 3)] == ["s", "p.q.s", "p.s", "s"]
    assert rewrite.last_docstring("x = 1") == rewrite.last_docstring("def (") == "" and rewrite.without_function(text, "none") == (ast.unparse(ast.parse(text)), None)


def test_identifiers(spark):
    df = spark.createDataFrame([("a/b.py.py", "https://h/u/r.git/", "o___n", "20240102_030405", "x" * 200), (None, None, "LOCAL", "bad", None)], "p string, url string, rid string, d string, t string")
    r = df.select(I.identifier_from_path("p").alias("i"), I.repo_id_from_url("url").alias("u"), I.repo_part("rid", "org").alias("o"), I.gen_time("d").alias("g"), I.elide("t").alias("e"), I.parent_identifier(I.identifier_from_path("p"), 9).alias("q")).collect()
    assert (r[0].i, r[0].u, r[0].o, str(r[0].g), len(r[0].e), r[0].q) == ("a.b.py", "u___r", "o", "2024-01-02 03:04:05", 190, "")
    assert (r[1].i, r[1].o, r[1].g, r[1].e) == (None, "LOCAL", None, None)


def test_code_blocks(spark):
    f = "```"
    cases = [(f"x\n{f}\na\n{f}\ny", "a", "a"), (f"{f}\na\n{f}\n{f}\nb\n{f}", "a", "b"), (f"{f}\na", "", ""), (f"{f}\na\n{f}\nmid\n{f}", "a", "mid"), ("no fence", "", ""), ("", "", ""), (None, None, None)]
    got = spark.createDataFrame([(c,) for c, *_ in cases], "t string").select(I.code_block("t"), I.code_block("t", True)).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_instrument():
    import datetime
    import decimal

    import numpy as np

    rec = instrument.CallRecorder()
    assert rec.wrap(lambda a, b=2: a + b)(1) == 3
    assert rec.logs[0]["inputs"] == {"a": "1", "b": "2"} and rec.logs[0]["output"] == "3" and rec.logs[0]["caller_info"]["func_name"] == "test_instrument"
    s = instrument.serialized
    assert s(datetime.date(2024, 1, 2)) == "2024-01-02" and s(decimal.Decimal("1.5")) == "1.5" and s(np.zeros(30)) == "shape=(30,) dtype=float64" and s(np.array([1.234])) == "[1.23]" and len(s("x" * 999)) == 190
    assert s(object()).startswith("<object")


def test_bodies_are_cut():
    from codequarry.functions import rewrite

    assert rewrite.without_body('def f(a):\n    """Doc."""\n    return a\n') == 'def f(a):\n    """Doc."""\n    pass' and rewrite.without_body("def (") == "def ("
    assert rewrite.imports_rewritten("from . import é; from .b import *\nx = 1\n", "p", {(1, "b"): ["u", "v"]}) == "from p import é; from p.b import u, v\nx = 1\n"
