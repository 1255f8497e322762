"""The one Python pass over source files: a file's text to flat rows.

A file is parsed once for all levels (units, members, imports, statements, calls). A text
that doesn't parse gives a row with its error and no other rows; nothing is executed.
"""

from __future__ import annotations

import ast
import re
import textwrap
import warnings

from . import freevars

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
WORDS = re.compile(r"\w+|[^\w\s]")


def tree_of(text: str | None) -> tuple[ast.Module | None, str | None]:
    """(tree, error) of a source text."""
    if text is None:
        return None, "no content"
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text.removeprefix("﻿")), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, f"{type(e).__name__}: {e}"


# ---------------------------------------------------------------- units


def code_lines(node: ast.AST) -> int:
    """Lines of the unparsed body without a leading docstring."""
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    return sum(ast.unparse(s).count("\n") + 1 for s in body)


def body_tokens(node: ast.AST) -> list[str]:
    """Lower-case names and constants below a definition."""
    return sorted({x.id.lower() if isinstance(x, ast.Name) else str(x.value).lower() for x in ast.walk(node) if isinstance(x, (ast.Name, ast.Constant))})


def features(node: ast.FunctionDef) -> dict:
    """What the extraction filters ask of a definition."""
    a, body = node.args, node.body
    doc = ast.get_docstring(node)
    returns = [s for s in body if isinstance(s, ast.Return)]
    text = [ast.unparse(s) for s in body[:3]]
    return {
        "code": ast.unparse(node), "docstring": doc, "doc_tokens": sorted(set(w.lower() for w in WORDS.findall(doc))) if doc is not None else [], "body_tokens": body_tokens(node),
        "n_args": len(a.args) + len(a.kwonlyargs) + len(a.posonlyargs) + bool(a.kwarg) + bool(a.vararg), "n_body": len(body), "n_code_lines": code_lines(node),
        "n_top_returns": len(returns), "n_const_returns": sum(isinstance(r.value, ast.Constant) for r in returns), "decorators": [ast.unparse(d) for d in node.decorator_list],
        "is_wrapper": len(body) == 1 or len(body) == 2 and "self." in text[1] or len(body) == 3 and "self." in text[1] and "return" in text[2],
    }


def units(tree: ast.Module, module_id: str) -> list[dict]:
    """Top-level functions and the methods of top-level classes, no async ones, in file order."""
    out, seen = [], {}

    def add(kind: str, unit_id: str, class_id: str | None, node: ast.FunctionDef) -> None:
        seen[unit_id] = seen.get(unit_id, -1) + 1
        out.append({"unit_kind": kind, "unit_id": unit_id, "class_id": class_id, "name": node.name, "def_ord": seen[unit_id]} | features(node))

    for node in tree.body:
        if isinstance(node, ast.FunctionDef):
            add("function", f"{module_id}.{node.name}", None, node)
        elif isinstance(node, ast.ClassDef):
            for m in node.body:
                if isinstance(m, ast.FunctionDef):
                    add("method", f"{module_id}.{node.name}.{m.name}", f"{module_id}.{node.name}", m)
    return out


def signature_and_doc(code: str | None, width: int = 100) -> tuple[str | None, str | None]:
    """(signature with defaults, docstring shortened to width) of the first definition of a code."""
    tree, _ = tree_of(code)
    node = next((n for n in tree.body if isinstance(n, FUNCTIONS)), None) if tree else None
    if node is None:
        return None, None
    doc = ast.get_docstring(node)
    return f"{node.name}({ast.unparse(node.args)})", None if doc is None else textwrap.shorten(doc, width, placeholder="...")


# ---------------------------------------------------------------- members, imports, calls


def members(tree: ast.Module) -> list[str]:
    """Names a module offers, in order, repeated ones too: definitions, imports, plain assignments."""
    out: list[str] = []
    for node in tree.body:
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            out.append(node.name)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            out += [a.asname or a.name.split(".")[0] for a in node.names if a.name != "*"]
        elif isinstance(node, ast.Assign):
            out += [t.id for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            out.append(node.target.id)
    return out


def imports(tree: ast.Module) -> list[dict]:
    """One row per imported name: level, module, name (null for import a.b), alias (the bound name),
    is_top, and orig_idx of the top-level statement it stands in."""
    out = []
    for k, top in enumerate(tree.body):
        for node in freevars.outside_expressions(top):
            where = {"is_top": node is top, "orig_idx": k}
            if isinstance(node, ast.Import):
                out += [{"level": 0, "module": a.name, "name": None, "alias": a.asname or a.name.split(".")[0]} | where for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out += [{"level": node.level, "module": node.module, "name": a.name, "alias": a.asname or a.name} | where for a in node.names]
    return out


def calls(tree: ast.Module, module_id: str) -> list[dict]:
    """(caller, callee text) of every call: the caller is the unit, class or module it stands in;
    self.x in a method stands for the class's x."""
    out: list[dict] = []

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return None if base is None else f"{base}.{node.attr}"
        return None

    def walk(node: ast.AST, caller: str, cls: str | None) -> None:
        if isinstance(node, ast.Call):
            name = dotted(node.func)
            if name:
                if cls and name.startswith(("self.", "cls.")):
                    name = f"{cls}.{name.split('.', 1)[1]}"
                out.append({"caller": caller, "callee": name})
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                own = f"{caller}.{child.name}"
                walk(child, own, own)
            elif isinstance(child, FUNCTIONS):
                for d in child.decorator_list:
                    walk(d, caller, cls)
                walk(child, f"{caller}.{child.name}", cls)
            else:
                walk(child, caller, cls)

    walk(tree, module_id, None)
    return out


# ---------------------------------------------------------------- statements


def flat(body: list[ast.stmt]) -> list[tuple[int, ast.stmt]]:
    """(index of the top-level statement, statement): If, Try, For, With and Match dissolve into
    their conditions and bodies, While stays whole."""
    out: list[tuple[int, ast.stmt]] = []

    def expr(e: ast.expr) -> ast.Expr:
        return ast.copy_location(ast.Expr(e), e)

    def add(k: int, s: ast.stmt) -> None:
        if isinstance(s, ast.If):
            out.append((k, expr(s.test)))
            nested = [*s.body, *s.orelse]
        elif isinstance(s, (ast.Try, ast.TryStar)):
            nested = [*s.body, *(x for h in s.handlers for x in h.body), *s.orelse, *s.finalbody]
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            out.append((k, ast.copy_location(ast.Assign([s.target], s.iter), s)))
            nested = [*s.body, *s.orelse]
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for i in s.items:
                out.append((k, ast.copy_location(ast.Assign([i.optional_vars], i.context_expr), s) if i.optional_vars is not None else expr(i.context_expr)))
            nested = s.body
        elif isinstance(s, ast.Match):
            out.append((k, expr(s.subject)))
            nested = [x for c in s.cases for x in c.body]
        elif isinstance(s, (ast.Import, ast.ImportFrom)) and len(s.names) > 1:
            for a in s.names:
                one = ast.Import([a]) if isinstance(s, ast.Import) else ast.ImportFrom(s.module, [a], s.level)
                out.append((k, ast.copy_location(one, s)))
            return
        else:
            out.append((k, s))
            return
        for x in nested:
            add(k, x)

    for k, s in enumerate(body):
        add(k, s)
    return out


def targets(node: ast.AST) -> list[str]:
    """Base names that an assignment target binds or changes."""
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, (ast.Attribute, ast.Subscript, ast.Starred)):
        return targets(node.value)
    if isinstance(node, (ast.Tuple, ast.List)):
        return [n for e in node.elts for n in targets(e)]
    return []


def defined(s: ast.stmt) -> list[str]:
    """Names a statement defines."""
    if isinstance(s, (*FUNCTIONS, ast.ClassDef)):
        return [s.name]
    if isinstance(s, ast.Assign):
        return sorted({n for t in s.targets for n in targets(t)})
    if isinstance(s, (ast.AugAssign, ast.AnnAssign)):
        return targets(s.target)
    if isinstance(s, (ast.Import, ast.ImportFrom)):
        return [a.asname or a.name.split(".")[0] for a in s.names if a.name != "*"]
    return []


def source_slice(lines: list[str], s: ast.stmt) -> str:
    """The source of a statement with its decorators, by whole lines."""
    first = min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", ()))])
    return "".join(lines[first - 1 : s.end_lineno]).rstrip("\n")


def blocks(tree: ast.Module, text: str) -> list[dict]:
    """The top-level statements: ord, name (of a function or class) and code (source slice)."""
    lines = text.removeprefix("\ufeff").splitlines(keepends=True)
    return [{"ord": k, "name": s.name if isinstance(s, (*FUNCTIONS, ast.ClassDef)) else None, "code": source_slice(lines, s)} for k, s in enumerate(tree.body)]


def statements(tree: ast.Module, text: str | None) -> list[dict]:
    """idx, orig_idx, kind, code (source slice, not without text), defines, uses, late (names resolve at the file's end)."""
    lines = None if text is None else text.removeprefix("﻿").splitlines(keepends=True)
    out = []
    for idx, (orig, s) in enumerate(flat(tree.body)):
        code = {} if lines is None else {"code": source_slice(lines, s) if hasattr(s, "end_lineno") and s.end_lineno else ast.unparse(s)}
        kind = type(s).__name__
        out.append({
            "idx": idx, "orig_idx": orig, "kind": kind, **code, "defines": defined(s), "uses": freevars.dependency_names(s),
            "late": isinstance(s, (*FUNCTIONS, ast.ClassDef)), "is_wildcard": isinstance(s, ast.ImportFrom) and s.names[0].name == "*",
        })
    return out
