import itertools
import json
import random

import pytest

from codequarry.llm import ecmascript as J
from codequarry.llm import syntax as S

GOOD_JS = """a=1;b=a++
let {x, y: [z=1,,...w], ...r} = o, q; for (const [k,v] of m) { if (k) continue; else break }
x = a ? b : c => d; f(async (a,{b}={})=>{ await g() }, ...rest)
class A extends B { static #p = 1; get x(){return this.#p} static { init() } async *gen(){ yield* a } [k](){} 'q'=2; constructor(a,b=2){super(a)} }
`a${b+`c${d}`}e`; a?.b?.[c]?.(d); a ??= b || c; x = /[/]\\/(a)/gi.test(y) / 2; label: for(;;){break label}
export default function(){}; export {a as b}; import d, {e as f} from 'g'; import * as h from "i"; export * from 'j'
var re = a / b / c; if (a) /re/.test(b); do x++; while(x<5) y(); switch(a){case 1: default: b()} try{}catch{}finally{}
!function(){}(); new Foo; new a.b.C(1)(2); (a,b); ({a,b:c}=d); [a,b]=[b,a]; x=>({}); async x=>x; typeof void 0; a**b; 0x1F+1e5+.5+1_000n
export const guide = `\\n<<<<<<< ours\\n=======\\n`""".split("\n")
BAD_JS = ["a b", "let 1", "function (", "if (a {", "foo(", "{", "a = = b", "def f(x):", "<<<<<<< HEAD", "`abc", '"abc', "x = 1 y = 2", "for (const ", "a => => b", "1 = 2", "class A { x y }", "import x", "{a:1,b:2}", "=======", "a(b", "/* x", "}", "try {}", "const {a = 1"]


@pytest.mark.parametrize("text", GOOD_JS)
def test_javascript(text):
    J.check(text)


@pytest.mark.parametrize("text", BAD_JS)
def test_not_javascript(text):
    with pytest.raises(J.JsError):
        J.check(text)


GOOD = {
    "yaml": ["a: 1\nb:\n  - x\n  - y: 2\n    z: 3\nc:\n- 1\n- 2\nd: {a: [1, \"x\"], b: c}\n", "# c\n---\na: |\n  text: here\n  <<<<<<< x\n\nb: >-\n  folded\n", "- a\n- b: c\n  d: e\n-\n  - f\n", "key: \"multi\n  line\"\nk2: plain\n  goes on\nk3: x # c\n", "a: &x 1\nb: *x\n\"q k\": v\nurl: http://a.b:80/c\n", "", "hello\n"],
    "json": ['{"a": [1, null, true, "x"]}', "1"], "toml": ['a = 1\n[b]\nc = """\n<<<<<<< x\n"""\n', ""], "ini": ["[x]\na=1\na: 2\n c\n", ""], "env": ["A=1\nB=\"x y\"\nexport C='d'\n# x\nD=<fill in>\n", ""], "python": ["", "\ufeffx = 1\n", "x = '''\n<<<<<<< a\n'''\n"], "javascript": [""],
}
BAD = {
    "yaml": ["a: 1\nfoo\n", "a: \"x\n", "a: [1, 2\n", "a: b: c\n", "<<<<<<< HEAD\na: 1\n=======\na: 2\n>>>>>>> x\n", "a: 1\n\tb: 2\n", "a: @x\n", "a: 1\n  b: 2\n", "a:\n  b: 1\n c: 2\n", "import os\nfrom x import y\n\ndef f(a):\n    pass\n", "a: 'x' y\n", "- a\nb: c\n", "a: }\n"],
    "json": ["", "NaN", '{"a":1,}', "{'a': 1}", '{"a": 1'], "toml": ["a: 1\n", "a = \n", "[x\n"], "ini": ["a: b\n", "[x]\n<<<<<<< a\n", "[x]\nfoo\n"], "env": ["A=1\nNORTH\n", "A=\"x\n", "<<<<<<< a\n"], "python": ["print 'x'\n", "def f(:\n", "if x:\n", "\0"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_accepted(language, text):
    assert S.repair(language, text) == (0, None, [])


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_rejected(language, text):
    cost, kind, lines = S.repair(language, text)
    assert cost > 0 and kind in ("truncation", "conflict", "mismatch", "syntax") and lines and all(1 <= n <= text.count("\n") + 1 for n in lines)


def test_every_prefix_of_json_agrees_with_the_parser():
    text = json.dumps({"a": [1, {"b": "x]}"}], "c": None})
    for k in range(len(text) + 1):
        assert (S.repair("json", text[:k])[0] > 0) == (k < len(text))


def brute_edits(seq):
    """Least insertions and deletions that balance a short bracket sequence."""

    def balanced(s):
        stack = []
        for c in s:
            if c in "([{":
                stack.append(c)
            elif not stack or stack.pop() != S.PAIRS[c]:
                return False
        return not stack

    # every insertion can be a deletion of the partner, so deletions alone give the least cost
    return min(len(seq) - k for k in range(len(seq), -1, -1) for keep in itertools.combinations(seq, k) if balanced(keep))


def test_depth_changes_no_verdict():
    n = 60_000
    for language, good, bad in [
        ("json", "[" * n + "]" * n, "[" * n), ("json", '{"a":' * n + "1" + "}" * n, '{"a":' * n + "1," + "}" * n), ("python", "x = " + "-" * n + "1\ny = 2\n", "x = " + "-" * n + "1\ny = = 2\n"),
        ("javascript", "if (a) { b(); }" + " else if (a) { b(); }" * 2000, "if (a) { b(); }" + " else if (a) { b(); }" * 2000 + " else }"), ("toml", "a = " + "[" * 2000 + "]" * 2000, "a = " + "[" * 2000 + "]" * 1999),
    ]:
        assert S.recognise(language, good) == 0 and S.recognise(language, bad) > 0, language


YAML_FLOW = ["x: {a: 1, b: 2}", 'x: ["a", "b",]', 'x: "\\n\\u00e9\\x41"', 'x: [a b, c: d, "k":1, {z}]', 'x: {a, b: , "c": [1, {d: e}], f: http://x.y:80/z#q}', "x: [\n  a, # c\n  b\n  c\n]", "x: {a: &b 1, c: *b, !!str d: e}", "x: [-1, :a, ?b]", "x: {[a]: b, {c: d}: e}", 'x: "a\n  b\\\n  c"']
NO_YAML_FLOW = ["x: {a: 1 b: 2}", 'x: ["a" "b"]', 'x: "\\q"', "x: [a, , b]", "x: [,]", "x: {,}", "x: [a: b: c]", 'x: {"a" b}', "x: [[a] [b]]", "x: {a: [1] 2}", 'x: "\\x4"', "x: [a\n---\n]"]


@pytest.mark.parametrize("text, good", [(t, True) for t in YAML_FLOW] + [(t, False) for t in NO_YAML_FLOW])
def test_yaml_flow(text, good):
    assert (S.recognise("yaml", text) == 0) == good


def test_long_remainders_get_the_full_chart():
    assert len(S.balance([(c, 1) for c in "([)]" * 300], 9)) == 600 and len(S.balance([(c, 1) for c in ")" * 5000 + "[" * 5000], 9)) == 10_000


def test_no_length_changes_the_cost():
    assert len(S.balance([(c, 1) for c in "([)]" * 1100], 9)) == 2200
    deep = "[" * 3000 + "(" + "]" * 3000 + ")"
    assert S.balance([(c, k + 1) for k, c in enumerate(deep)], 7000) == [6002, 7000]
    assert S.repair("json", "\n".join(deep))[0] == 2


def test_rows_by_turns_and_by_items_are_the_same(monkeypatch):
    rng = random.Random(7)
    seqs = [rng.choices(rng.choice(["()[]{}", "([)]", "(()[]]"]), k=rng.randint(0, 70)) for _ in range(80)] + [list("[" * 60 + "(" + "]" * 50 + "{" + "]" * 10 + ")" + "}")]
    by_size = [S.balance([(c, k) for k, c in enumerate(seq)], 99) for seq in seqs]
    for one, other in (("join_items", "join_turns"), ("join_turns", "join_items")):
        with monkeypatch.context() as m:
            m.setattr(S, one, getattr(S, other))
            assert [S.balance([(c, k) for k, c in enumerate(seq)], 99) for seq in seqs] == by_size


def test_chart_gives_the_least_cost():
    rng = random.Random(4)
    for _ in range(150):
        seq = rng.choices("()[]{}", k=rng.randint(0, 9))
        assert len(S.balance([(c, 1) for c in seq], 9)) == brute_edits(seq)


def test_kinds():
    assert S.repair("python", "import os\nx = 1\ny = 2)\nz = 3\nw = 4\n")[:2] == (1, "syntax")
    assert S.repair("python", "x = 1\n<<<<<<< ours\ny = 1\n=======\ny = 2\n>>>>>>> theirs\n")[:2] == (3, "conflict")
    assert S.repair("python", "def f():\n    return (1,\n")[1] == "truncation"
    assert S.repair("toml", "import os\n\ndef f(x):\n    return x\n")[1] == "mismatch" and S.repair(None, "x") == (0, None, [])


def test_rows(spark):
    rows = [(1, "r", "a.py", "def (", "x", "y"), (1, "r", "a.py", "def (", "x", "y"), (2, "r", "b.py", "x = 1", None, None), (3, None, "c.json", "", None, None), (4, "r", "d.js", None, None, None), (5, "r", None, "def (", None, None), (6, "r", "README", "def (", None, None), (7, "r", "big.py", "x = [\n" + "1,\n" * 200_000 + "]\n", None, None), (8, None, "e.json", "[]", None, None)]
    df = spark.createDataFrame(rows, "file_no long, repo_id string, rel_path string, file_content string, text string, language string")
    assert sorted(r.file_no for r in S.syntax_errors(df).collect()) == [1, 3]
    rates = {(r.repo_id, r.language): (r.n_files, r.n_broken, r.share) for r in S.error_rates(df).collect()}
    assert rates == {("r", "python"): (3, 1, 1 / 3), (None, "json"): (2, 1, 0.5)}
    assert S.syntax_errors(df.limit(0)).count() == 0 and S.error_rates(df.limit(0)).count() == 0
