"""Rewrites of source texts: each takes a text and gives a text, unchanged where it doesn't parse."""

from __future__ import annotations

import ast
import re

from .source import FUNCTIONS, tree_of


def _rewritten(text: str, change) -> str:
    tree, _ = tree_of(text)
    if tree is None:
        return text
    change(tree)
    return ast.unparse(ast.fix_missing_locations(tree))


def _bodies(tree: ast.AST):
    for node in ast.walk(tree):
        if isinstance(getattr(node, "body", None), list):
            yield node


def without_function(text: str, name: str) -> tuple[str, str | None]:
    """(text without the functions of a name at module or class level, the last one's code)."""
    gone: list[ast.AST] = []

    def change(tree):
        for owner in [tree, *(n for n in ast.walk(tree) if isinstance(n, ast.ClassDef))]:
            hit = [s for s in owner.body if isinstance(s, FUNCTIONS) and s.name == name]
            gone.extend(hit)
            owner.body = [s for s in owner.body if s not in hit] or ([ast.Pass()] if isinstance(owner, ast.ClassDef) else [])

    out = _rewritten(text, change)
    return out, ast.unparse(gone[-1]) if gone else None


def without_class(text: str, name: str) -> tuple[str, str | None]:
    """(text without the top-level classes of a name, the last one's code)."""
    gone: list[ast.AST] = []

    def change(tree):
        gone.extend(s for s in tree.body if isinstance(s, ast.ClassDef) and s.name == name)
        tree.body = [s for s in tree.body if s not in gone]

    out = _rewritten(text, change)
    return out, ast.unparse(gone[-1]) if gone else None


def method_last(text: str, class_name: str, method: str) -> str:
    """A class's method moved to the end of the class."""

    def change(tree):
        for c in tree.body:
            if isinstance(c, ast.ClassDef) and c.name == class_name:
                hit = [s for s in c.body if isinstance(s, FUNCTIONS) and s.name == method]
                c.body = [s for s in c.body if s not in hit] + hit

    return _rewritten(text, change)


def without_methods(text: str, names: list[str]) -> str:
    """Every class without the named methods; a class left empty gets a pass."""

    def change(tree):
        for c in ast.walk(tree):
            if isinstance(c, ast.ClassDef):
                c.body = [s for s in c.body if not (isinstance(s, FUNCTIONS) and s.name in names)] or [ast.Pass()]

    return _rewritten(text, change)


def only_method(text: str, class_name: str, method: str) -> str:
    """A class reduced to its docstring and one method, with a mark for the rest."""
    tree, _ = tree_of(text)
    node = next((c for c in tree.body if isinstance(c, ast.ClassDef) and c.name == class_name), None) if tree else None
    if node is None:
        return text
    keep = [s for k, s in enumerate(node.body) if k == 0 and ast.get_docstring(node) is not None or isinstance(s, FUNCTIONS) and s.name == method]
    cut = len(keep) < len(node.body)
    node.body = keep or [ast.Pass()]
    code = ast.unparse(node)
    return re.sub(r"(\n    (?:@|(?:async )?def ))", r"\n    # ...\1", code, count=1) if cut else code


def without_last(text: str) -> str:
    """A module without its last statement, or without the last member of a class that ends it."""

    def change(tree):
        if not tree.body:
            return
        last = tree.body[-1]
        if isinstance(last, ast.ClassDef) and len(last.body) > 1:
            last.body.pop()
        else:
            tree.body.pop()

    return _rewritten(text, change)


def unaliased(text: str, names: dict[str, str]) -> str:
    """Uses of aliases renamed to what they stand for, and the imports with them."""

    class Rename(ast.NodeTransformer):
        def visit_Name(self, node):
            node.id = names.get(node.id, node.id)
            return node

        def visit_alias(self, node):
            if node.asname in names:
                node.asname = None
            return node

    return _rewritten(text, lambda tree: Rename().visit(tree))


def aliases(text: str, wanted: list[str]) -> dict[str, str]:
    """Alias to imported name, for the top-level imports of the wanted names."""
    tree, _ = tree_of(text)
    return {a.asname: a.name for s in (tree.body if tree else ()) if isinstance(s, (ast.Import, ast.ImportFrom)) for a in s.names if a.asname and a.name in wanted}


def absolute_import(module: str | None, level: int, package: str) -> str | None:
    """Absolute module of a relative import found in a package (dotted); level 1 is the package itself."""
    if level == 0:
        return module
    parts = package.split(".") if package else []
    base = parts[: len(parts) - (level - 1)] if level > 1 else parts
    return ".".join([*base, *([module] if module else [])])


def imports_rewritten(text: str, package: str, stars: dict[tuple[int, str | None], list[str]]) -> str:
    """Relative imports made absolute from a package (dotted), and each * that stars, by level and
    module, explains replaced by its names. A text without such an import stays as it is."""
    tree, _ = tree_of(text)
    hit = [n for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and (n.level or n.names[0].name == "*" and stars.get((n.level, n.module)))] if tree else []
    if not hit:
        return text
    lines = text.removeprefix("\ufeff").splitlines(keepends=True)
    for node in sorted(hit, key=lambda n: (n.lineno, n.col_offset), reverse=True):
        names = stars.get((node.level, node.module)) if node.names[0].name == "*" else None
        aliases = [ast.alias(n) for n in names] if names else node.names
        module = absolute_import(node.module, node.level, package)
        new = ast.ImportFrom(module, aliases, 0) if module else ast.ImportFrom(node.module, aliases, node.level)
        # columns count bytes
        first, last = lines[node.lineno - 1].encode(), lines[node.end_lineno - 1].encode()
        joined = first[: node.col_offset] + ast.unparse(new).encode() + last[node.end_col_offset :]
        lines[node.lineno - 1 : node.end_lineno] = [joined.decode()]
    return "".join(lines)


def without_body(code: str) -> str:
    """A function's signature and docstring with pass for the rest."""

    def change(tree):
        for n in tree.body:
            if isinstance(n, FUNCTIONS):
                n.body = [*(n.body[:1] if ast.get_docstring(n) is not None else []), ast.Pass()]

    return _rewritten(code, change)


def without_tests(test: str, failed: list[str]) -> str:
    """A test module without the named test methods."""
    return without_methods(test, failed)


def last_docstring(text: str) -> str:
    """Docstring of the last statement; empty where there is none or the text doesn't parse."""
    tree, _ = tree_of(text)
    node = tree.body[-1] if tree and tree.body else None
    return (ast.get_docstring(node) or "") if isinstance(node, (*FUNCTIONS, ast.ClassDef)) else ""
