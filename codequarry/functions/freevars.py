"""Names that a piece of Python refers to outside itself.

``expression_names`` and ``annotation_names`` list names by node rules, duplicates kept.
``outer_names`` resolves scopes: reads before the first binding of a scope, reads that no
enclosing function binds, and explicit globals. ``dependency_names`` joins both, without
builtins and dunder names, sorted: what a statement needs to be defined before it.
"""

from __future__ import annotations

import ast
import builtins
from collections import deque
from collections.abc import Iterator

BUILTINS = frozenset(dir(builtins))
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)
#: Attributes under which a property decorates itself (fixed values).
SELF_DECORATORS = frozenset(("setter", "getter", "deleter", "wraps"))


# ---------------------------------------------------------------- by node rules


def expression_names(node: ast.AST | None) -> list[str]:
    """Names an expression reads: base names of attributes, no keyword arguments, no targets of
    comprehensions and lambdas, no target of a named expression."""
    if node is None or isinstance(node, ast.Constant):
        return []
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.Attribute):
        return expression_names(node.value)
    if isinstance(node, ast.Call):
        return [n for x in (node.func, *node.args) for n in expression_names(x)]
    if isinstance(node, ast.Lambda):
        own = {a.arg for a in node.args.args}
        return [n for n in expression_names(node.body) if n not in own]
    if isinstance(node, COMPREHENSIONS):
        parts = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
        out = [n for p in parts for n in expression_names(p)]
        for g in node.generators:
            out += [n for x in (g.iter, *g.ifs) for n in expression_names(x)]
        bound = {n for g in node.generators for n in expression_names(g.target)}
        # an iterable that is read before its own target is bound stays outside
        outer = expression_names(node.generators[0].iter)
        return [n for n in out if n not in bound] + [n for n in outer if n in bound and n not in {t for g in node.generators[1:] for t in expression_names(g.target)}]
    if isinstance(node, ast.FormattedValue):
        return expression_names(node.value)
    if isinstance(node, ast.NamedExpr):
        return expression_names(node.value)
    return [n for child in ast.iter_child_nodes(node) if isinstance(child, (ast.expr, ast.keyword)) for n in expression_names(child)]


def annotation_names(node: ast.AST | None) -> list[str]:
    """Names of one annotation: texts that are a bare name count, Literal's contents don't, None is a name."""
    if node is None:
        return []
    if isinstance(node, ast.Constant):
        if node.value is None:
            return ["None"]
        if isinstance(node.value, str):
            try:
                inner = ast.parse(node.value, mode="eval").body
            except (SyntaxError, ValueError):
                return []
            return [inner.id] if isinstance(inner, ast.Name) else []
        return []
    if isinstance(node, ast.Subscript):
        base = annotation_names(node.value)
        return base if base[-1:] == ["Literal"] or getattr(node.value, "attr", "") == "Literal" else base + annotation_names(node.slice)
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.Attribute):
        return annotation_names(node.value)
    return [n for child in ast.iter_child_nodes(node) if isinstance(child, ast.expr) for n in annotation_names(child)]


def outside_expressions(tree: ast.AST) -> Iterator[ast.AST]:
    """The nodes of ast.walk in its order, without expressions below the first node: no statement and
    no annotated argument stands in one."""
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        todo.extend(c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr))
        yield node


def annotations(tree: ast.AST) -> list[str]:
    """Names of all annotations and class bases below a node."""
    out: list[str] = []
    for node in outside_expressions(tree):
        if isinstance(node, (ast.AnnAssign, ast.arg)):
            out += annotation_names(node.annotation)
        elif isinstance(node, FUNCTIONS):
            out += annotation_names(node.returns)
        elif isinstance(node, ast.ClassDef):
            out += [n for b in node.bases for n in annotation_names(b)]
    return out


def default_names(tree: ast.AST) -> list[str]:
    """Names in the defaults of all signatures below a node."""
    return [n for node in ast.walk(tree) if isinstance(node, ast.arguments) for d in (*node.defaults, *node.kw_defaults) for n in expression_names(d)]


def decorator_names(node: ast.AST) -> list[str]:
    """Names in the decorators of a definition, but for those of properties and wraps."""
    out: list[str] = []
    for d in getattr(node, "decorator_list", ()):
        head = d.func if isinstance(d, ast.Call) else d
        if not (isinstance(head, ast.Attribute) and head.attr in SELF_DECORATORS):
            out += expression_names(d)
    return out


# ---------------------------------------------------------------- by scopes


class Scope:
    """Reads and bindings of one scope in the order they happen."""

    def __init__(self, parent: Scope | None, kind: str):
        self.parent, self.kind = parent, kind
        self.bound: set[str] = set()
        self.early: set[str] = set()  # read before any binding
        self.late: set[str] = set()  # read in inner functions
        self.declared: set[str] = set()  # global or nonlocal

    def read(self, name: str) -> None:
        if name not in self.bound or name in self.declared:
            self.early.add(name)

    def bind(self, name: str) -> None:
        if name in self.declared:
            self.early.add(name)
        self.bound.add(name)

    def close(self) -> set[str]:
        """What this scope needs from outside, all told."""
        own = set() if self.kind == "class" else self.bound - self.declared
        return self.early | (self.late - own)


class Resolver(ast.NodeVisitor):
    """Walks statements in evaluation order."""

    def __init__(self):
        self.scope = Scope(None, "function")

    def inner(self, kind: str, walk, late: bool) -> None:
        outer, self.scope = self.scope, Scope(self.scope, kind)
        walk()
        needs = self.scope.close()
        self.scope = outer
        if late:
            outer.late |= needs
        else:
            for name in needs:
                outer.read(name)

    def many(self, nodes) -> None:
        for n in nodes:
            if n is not None:
                self.visit(n)

    def visit_Constant(self, node):
        pass

    def visit_Attribute(self, node):
        self.visit(node.value)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self.scope.read(node.id)
        else:
            if isinstance(node.ctx, ast.Del):
                self.scope.read(node.id)
            self.scope.bind(node.id)

    def visit_Global(self, node):
        self.scope.declared.update(node.names)

    visit_Nonlocal = visit_Global

    def visit_Assign(self, node):
        self.many([node.value, *node.targets])

    def visit_AugAssign(self, node):
        if isinstance(node.target, ast.Name):
            self.scope.read(node.target.id)
        self.many([node.value, node.target])

    def visit_AnnAssign(self, node):
        self.many([node.value])
        if not isinstance(node.target, ast.Name) or node.value is not None:
            self.visit(node.target)

    def visit_NamedExpr(self, node):
        self.visit(node.value)
        scope = self.scope
        while scope.kind == "comprehension":
            scope = scope.parent
        scope.bind(node.target.id)

    def visit_For(self, node):
        self.many([node.iter, node.target, *node.body, *node.orelse])

    visit_AsyncFor = visit_For

    def visit_withitem(self, node):
        self.many([node.context_expr, node.optional_vars])

    def visit_ExceptHandler(self, node):
        self.many([node.type])
        if node.name:
            self.scope.bind(node.name)
        self.many(node.body)

    def visit_Import(self, node):
        for a in node.names:
            self.scope.bind(a.asname or a.name.split(".")[0])

    def visit_ImportFrom(self, node):
        for a in node.names:
            self.scope.bind(a.asname or a.name)

    def visit_MatchAs(self, node):
        self.many([node.pattern])
        if node.name:
            self.scope.bind(node.name)

    def visit_MatchStar(self, node):
        if node.name:
            self.scope.bind(node.name)

    def visit_MatchMapping(self, node):
        self.many([*node.keys, *node.patterns])
        if node.rest:
            self.scope.bind(node.rest)

    def signature(self, args: ast.arguments) -> None:
        for a in (*args.posonlyargs, *args.args, args.vararg, *args.kwonlyargs, args.kwarg):
            if a is not None:
                self.scope.bind(a.arg)

    def visit_FunctionDef(self, node):
        self.many([*node.decorator_list, *node.args.defaults, *node.args.kw_defaults])
        self.scope.bind(node.name)

        def walk():
            self.signature(node.args)
            self.many(node.body)

        self.inner("function", walk, True)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node):
        self.many([*node.args.defaults, *node.args.kw_defaults])

        def walk():
            self.signature(node.args)
            self.visit(node.body)

        self.inner("function", walk, True)

    def visit_ClassDef(self, node):
        self.many([*node.decorator_list, *node.bases, *(k.value for k in node.keywords)])
        # methods may name their class, which is bound when they run
        late = node.name in self.scope.bound
        self.scope.bound.add(node.name)
        self.inner("class", lambda: self.many(node.body), False)
        if not late:
            self.scope.bind(node.name)

    def comprehension(self, node):
        self.visit(node.generators[0].iter)

        def walk():
            for k, g in enumerate(node.generators):
                self.many([*([g.iter] if k else []), g.target, *g.ifs])
            self.many([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])

        self.inner("comprehension", walk, False)

    visit_ListComp = visit_SetComp = visit_GeneratorExp = visit_DictComp = comprehension


def outer_names(stmt: ast.AST) -> set[str]:
    """Names that running a statement, and later what it defines, reads from outside."""
    r = Resolver()
    r.visit(stmt.value if isinstance(stmt, ast.Expr) else stmt)
    return r.scope.close()


def statement_names(stmt: ast.AST) -> list[str]:
    """Names of a statement by the statement rules, with builtins; assignment targets count."""
    extra = annotations(stmt)
    if isinstance(stmt, ast.Expr):
        return expression_names(stmt.value) + extra
    if isinstance(stmt, (*FUNCTIONS, ast.ClassDef)):
        own = {stmt.name}
        return sorted((outer_names(stmt) | set(extra) | set(default_names(stmt)) | set(decorator_names(stmt))) - own)
    if isinstance(stmt, ast.AnnAssign):
        return annotation_names(stmt.annotation) + expression_names(stmt.value)
    if isinstance(stmt, (ast.Assign, ast.AugAssign)):
        targets = stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target]
        return [n for x in (*targets, stmt.value) for n in expression_names(x)] + extra
    if isinstance(stmt, (ast.While, ast.If)):
        return expression_names(stmt.test) + [n for s in (*stmt.body, *stmt.orelse) for n in statement_names(s)] + extra
    if isinstance(stmt, (ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try, ast.TryStar)):
        return sorted(outer_names(stmt) | set(extra))
    if isinstance(stmt, ast.Match):
        return [n for c in stmt.cases for n in (*pattern_names(c.pattern), *expression_names(c.guard), *(m for s in c.body for m in statement_names(s)))]
    if isinstance(stmt, (ast.Global, ast.Nonlocal)):
        return list(stmt.names)
    return [n for child in ast.iter_child_nodes(stmt) if isinstance(child, ast.expr) for n in expression_names(child)] + extra


def pattern_names(node: ast.AST) -> list[str]:
    """Names that a pattern reads: values and classes, not captures."""
    if isinstance(node, ast.MatchValue):
        return expression_names(node.value)
    if isinstance(node, ast.MatchClass):
        return expression_names(node.cls) + [n for p in (*node.patterns, *node.kwd_patterns) for n in pattern_names(p)]
    if isinstance(node, ast.MatchMapping):
        return [n for k in node.keys for n in expression_names(k)] + [n for p in node.patterns for n in pattern_names(p)]
    return [n for child in ast.iter_child_nodes(node) if isinstance(child, ast.pattern) for n in pattern_names(child)]


def dependency_names(stmt: ast.AST) -> list[str]:
    """Sorted names a statement depends on, without builtins and dunder names."""
    found = outer_names(stmt) | set(annotations(stmt))
    if isinstance(stmt, (*FUNCTIONS, ast.ClassDef)):
        found.discard(stmt.name)
    return sorted(n for n in found if n not in BUILTINS and not (n.startswith("__") and n.endswith("__")))
