import itertools
import random

import pytest

from codequarry.llm import documented as D

BODY = "    return rows\n"


@pytest.mark.parametrize("code, name, text", [
    ('def f(rows):\n    """Drops what is stale."""\n' + BODY, "f", "Drops what is stale."), ("# Drops what is stale.\n#\n# Twice.\n@deco\ndef f(rows):\n" + BODY, "f", "Drops what is stale.\n\nTwice."), ("@deco\n#: Drops stale rows.\ndef f(rows):\n" + BODY, "f", "Drops stale rows."),
    ("# Drops stale rows.\n\ndef f(rows):\n" + BODY, "f", None), ("def f(rows):\n    # Drops stale rows.\n" + BODY, "f", None), ('def f(rows):\n    f"""Drops {rows}."""\n' + BODY, "f", None), ('def f(rows):\n    ("Drops "\n     "stale rows.")\n' + BODY, "f", "Drops stale rows."),
    ('def f(rows):\n    def g():\n        """Real words of the inner one."""\n' + BODY, "f", None), ('def f(rows):\n    """TODO"""\n' + BODY, "f", None), ('def f(rows):\n    """   """\n' + BODY, "f", None), ('def f(rows):\n    """-----"""\n' + BODY, "f", None),
    ('def render_cached_rows(rows):\n    """Renders the cached rows."""\n' + BODY, None, None), ('def render_rows(rows):\n    """render_rows()"""\n' + BODY, None, None), ('def f(rows):\n    """\n    Args:\n        rows:\n\n    Returns:\n    """\n' + BODY, "f", None),
    ('def f(rows):\n    """\n    :param rows:\n    :return:\n    """\n' + BODY, "f", None), ('def f(rows):\n    """\n    :param rows: everything read so far\n    """\n' + BODY, "f", ":param rows: everything read so far"), ("# noqa\ndef f(rows):\n" + BODY, "f", None), ("# rows = sort(rows, 6)\n# return rows\ndef f(rows):\n" + BODY, "f", None),
    ("# type: ignore\n# Keeps the order of equal rows.\ndef f(rows):\n" + BODY, "f", "type: ignore\nKeeps the order of equal rows."), ('async def f():\n    """Liefert alle Einträge."""\n', "f", "Liefert alle Einträge."), ("# Keeps order.\ndef f(rows:\n  broken", "f", "Keeps order."), ("x = 1\n", "f", None), ("", "f", None), (None, "f", None),
    ("def f(rows):\n    '''Missing docstring.'''\n" + BODY, "f", None), ("def f(rows):\n    '''Description here'''\n" + BODY, "f", None),
])
def test_descriptions(code, name, text):
    assert D.description(code, name or (code or "").partition("(")[0].split(" ")[-1]) == text


def test_a_comment_goes_to_the_definition_it_fits_best():
    import ast

    code = "# Sorts rows by age.\n# :param rows: what is sorted\n\n# Keeps the newest.\ndef f(rows):\n    # Reads one row.\n\n    def g(x):\n        return x\n\n    # Writes one row.\n    def h(y):\n        return y\n"
    tree = ast.parse(code)
    nodes = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]
    definitions = [D.Definition(n, code.split("\n"), set()) for n in nodes]
    found = {definitions[k].name: c.text for k, c in D.pair(definitions, D.comment_blocks(code), None).items()}
    assert found == {"f": "Keeps the newest.", "g": "Reads one row.", "h": "Writes one row."}
    assert D.description(code) == "Keeps the newest."


def test_marks_within_literals_are_no_comments():
    assert D.description('def f(\n    x="""\n# Sorts rows by age.\n""",\n):\n    return x\n', "f") is None
    assert [c.text for c in D.comment_blocks('x = """\n# a\n"""\n# b\n', {2, 3})] == ["b"]


def test_assignment_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        c = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = D.assign(c)
        assert len(set(got)) == n
        assert sum(c[i][j] for i, j in enumerate(got)) == min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_rows(spark):
    f = "unit_no long, function_id struct<identifier:string>, function_name string, function_code string, name string, code string, id string"
    m = f.replace("function", "method")
    doc = 'def g(x):\n    """Says how x is kept."""\n    return x\n'
    rows = [(1, ("m.g",), None, doc, "n", "c", "i"), (1, ("m.g",), None, doc, "n", "c", "i"), (2, None, None, doc.replace("Says how x is kept.", "G."), None, None, None), (3, None, "g", None, None, None, None), (4, None, "g", "", None, None, None), (5, None, "g", doc + "# x\n" * 100_000, None, None, None)]
    got = D.documented(spark.createDataFrame(rows, f), spark.createDataFrame([(9, ("a.b.h",), None, doc, None, None, None)], m)).collect()
    assert sorted((r.unit_no, r.name, r.description) for r in got) == [(1, "g", "Says how x is kept."), (5, "g", "Says how x is kept."), (9, "h", "Says how x is kept.")]
    assert D.documented(spark.createDataFrame([], f), None).count() == 0
