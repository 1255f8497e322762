import pytest

from codequarry.llm import origin as O

HAND = "import os\n\n\ndef run(rows):\n    # keep the order\n    out = []\n    for row in rows:\n        out.append(row * 2)\n    return out\n"
CASES = [
    ("a/b.py", HAND, "hand_written"), ("a/b.py", "# Generated by formc. DO NOT EDIT!\n" + HAND, "generated"), ("a/b.py", '"""Bindings.\n\nDiese Datei wurde von formc erzeugt. Nicht von Hand bearbeiten.\n"""\n' + HAND, "generated"), ("a/b.py", HAND + "\n# @generated by schemagen from a.idl\n", "generated"),
    ("a/b.py", HAND + 'TEMPLATE = """# Generated by {tool}. DO NOT EDIT.\n{body}\n"""\n\n\ndef emit(tool, body):\n    return TEMPLATE.format(tool=tool, body=body)\n', "hand_written"), ("a/generated_report.py", HAND, "hand_written"), ("web/minify_x.js", "export function f(a) {\n  return a;\n}\n", "hand_written"), ("vendors/x.py", HAND, "hand_written"),
    ("a/node_modules/lib/x.js", "f();\n", "vendored"), ("a/lib/x.py", "# Copied from zanlib 1.2.3\n# upstream: https://z.example/src\n" + HAND, "vendored"), ("a/b.py", "# copied from the wiki by hand\n" + HAND, "hand_written"), ("a/x.min.js", "!function(){" + "var a=function(b){return b+1};" * 60 + "}();", "minified"),
    ("a/b.py", "\n".join(f"CHUNK_{k} = {k}" for k in range(60)), "generated"), ("a/b.py", HAND + "SCALE = [1, 2, 3, 4, 5, 6, 7, 8]\n", "hand_written"), ("a/b.py", "DATA = (\n" + '    b"XEA3C1vu3cx+pecaA6bUFXlyYkJvsoS1f6KwVWC1ubtZG0D1UDni7/onuHW8mRbBEiuHaR6DypJu"\n' * 20 + ")\n", "data"),
    ("a/b.py", "id;name;qty\n" + "\n".join(f"{k};some name;{k * 7}" for k in range(40)), "data"), ("a/b.py", "TABLE = [" + ", ".join(str(k * 977 % 65536) for k in range(900)) + "]\n", "data"), ("a/b.json", '{"a": ' + "[1, 2]" * 1 + "}", "hand_written"), ("a/b.json", '{\n  "//": "Created from x.def by formc, see the build rules.",\n  "a": 1\n}', "generated"),
    ("a/b.py", None, "hand_written"), ("a/b.py", "", "hand_written"), ("a/b.py", "   \n\n", "hand_written"), (None, HAND, "hand_written"), (None, None, "hand_written"), ("a/b.py", "x = 1\r\n" + HAND.replace("\n", "\r\n"), "hand_written"),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(k, "r", p, t, None if k else ("m",), "x", "y") for k, (p, t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:2], "file_no long, repo_id string, rel_path string, file_content string, module_id struct<identifier:string>, language string, lines string")
    return df, {r.file_no: r.origin for r in O.origin(df).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_origin(got, k):
    assert got[1][k] == CASES[k][2]


def test_tables(got):
    df, kinds = got
    assert len(O.origin(df).collect()) == len(CASES)
    kept = O.hand_written(df).collect()
    assert sorted(r.file_no for r in kept) == sorted(k for k, v in kinds.items() if v == "hand_written")
    assert O.origin(df.limit(0)).count() == 0


MIN = "!function(){" + "var a=function(b,c){return b+c},d=a(e,f);if(d>g)h.push(d);" * 40 + "}();"
NOTICE = "# Generated by formc. DO NOT EDIT!\n"
LICENCE = "".join(f"# Clause {'abcdefghijklmnopqrstuvwxyz'[k]} of the licence holds for all copies of it.\n" for k in range(24))
IMPORTS = "".join(f"from pkg import {c * 3}\n" for c in "abcdefghijklmnop")
PACKED = [
    ("a/x.js", "\n".join(MIN[k : k + 500] for k in range(0, len(MIN), 500)), "minified"), ("a/x.js", MIN[:600], "minified"), ("a/x.min.js", MIN[:100] + "\n" + MIN[100:200], "minified"), ("a/x.json", '{"a":[' + ",".join('{"name":"some","kind":"other"}' for _ in range(100)) + "]}", "minified"),
    ("a/x.min.js", "export function f(a) {\n  return a;\n}\n", "hand_written"), ("a/x.js", "// " + "a long remark in plain words that nobody wrapped " * 12 + "\nf();\n", "hand_written"),
    ("a/b.py", LICENCE + NOTICE + HAND, "generated"), ("a/b.js", "/*\n" + LICENCE.replace("#", " *") + " * Copied from zanlib 1.2.3\n */\nf();\n", "vendored"), ("a/b.py", '"""' + LICENCE.replace("# ", "") + 'This file is generated by formc.\n"""\n' + HAND, "generated"), ("a/b.py", HAND + "\n" + NOTICE + LICENCE, "generated"),
    ("a/b.py", IMPORTS + "T = (\n" + NOTICE + ")\n" + HAND, "hand_written"),
]


def test_packed_code_and_notices_in_long_blocks(spark):
    df = spark.createDataFrame([(k, "r", p, t) for k, (p, t, _) in enumerate(PACKED)], "file_no long, repo_id string, rel_path string, file_content string")
    kinds = {r.file_no: r.origin for r in O.origin(df).collect()}
    assert [kinds[k] for k in range(len(PACKED))] == [x for _, _, x in PACKED]
