"""Python source to symbols, imports, calls and comments, with the standard library's parser."""

from __future__ import annotations

import ast
import io
import tokenize

from fathomix.sources.script_parser import chained


def _doc(node) -> str | None:
    return ast.get_docstring(node)


def _signature(node) -> str:
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{node.name}({ast.unparse(node.args)}){returns}"


def _called(node: ast.expr) -> tuple[str | None, str | None]:
    """(name, receiver) of what a call calls."""
    if isinstance(node, ast.Name):
        return node.id, None
    if isinstance(node, ast.Attribute):
        return node.attr, ast.unparse(node.value)
    return None, None


class Visitor(ast.NodeVisitor):
    def __init__(self):
        self.symbols, self.imports, self.calls = [], [], []
        self.classes: list[str] = []
        self.functions: list[str] = []
        self.seen: set[int] = set()

    def symbol(self, node, name, kind, **more):
        self.symbols.append({"name": name, "kind": kind, "line": node.lineno, "end_line": node.end_lineno, "exported": not name.split(".")[-1].startswith("_") and not self.functions, "modifiers": [], "extends": [], "implements": [], **more})

    def function(self, node, is_async: bool):
        method = bool(self.classes) and not self.functions
        name = f"{self.classes[-1]}.{node.name}" if method else node.name
        marks = [ast.unparse(d) for d in node.decorator_list] + (["async"] if is_async else [])
        marks += ["private"] if node.name.startswith("_") and not node.name.endswith("__") else []
        self.symbol(node, name, "method" if method else "function", signature=_signature(node), doc=_doc(node), modifiers=marks, parent=self.classes[-1] if method else None)
        for d in node.decorator_list:
            self.visit(d)
        self.functions.append(name)
        outer, self.classes = self.classes, []
        for x in node.body:
            self.visit(x)
        self.classes = outer
        self.functions.pop()

    def visit_FunctionDef(self, node):
        self.function(node, False)

    def visit_AsyncFunctionDef(self, node):
        self.function(node, True)

    def visit_ClassDef(self, node):
        self.symbol(node, node.name, "class", doc=_doc(node), extends=[ast.unparse(b) for b in node.bases], modifiers=[ast.unparse(d) for d in node.decorator_list])
        self.classes.append(node.name)
        outer, self.functions = self.functions, []
        for x in node.body:
            self.visit(x)
        self.functions = outer
        self.classes.pop()

    def visit_Assign(self, node):
        if not self.functions:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    kind = "property" if self.classes else "constant"
                    self.symbol(node, f"{self.classes[-1]}.{t.id}" if self.classes else t.id, kind, value=ast.unparse(node.value), parent=self.classes[-1] if self.classes else None)
        self.generic_visit(node)

    def visit_Import(self, node):
        self.imports += [{"source": a.name, "kind": "namespace", "imported": "*", "local": a.asname or a.name.split(".")[0], "line": node.lineno} for a in node.names]

    def visit_ImportFrom(self, node):
        source = "." * node.level + (node.module or "")
        self.imports += [{"source": source, "kind": "namespace" if a.name == "*" else "named", "imported": a.name, "local": a.asname or a.name, "line": node.lineno} for a in node.names]

    def visit_Call(self, node):
        if id(node) not in self.seen:
            links, inner = [], node
            while isinstance(inner, ast.Call):  # a chain is met at its last call
                self.seen.add(id(inner))
                links.append(self.call(inner))
                f = inner.func
                while isinstance(f, (ast.Attribute, ast.Subscript)):
                    f = f.value
                inner = f
            self.calls += chained([x for x in links[::-1] if x])
        self.generic_visit(node)

    def call(self, node) -> dict | None:
        name, receiver = _called(node.func)
        if not name:
            name, receiver = "<dynamic>", ast.unparse(node.func)
        kind = "dynamic" if name == "<dynamic>" else "method" if receiver else "constructor" if name[:1].isupper() else "function"
        caller = self.functions[-1] if self.functions else self.classes[-1] if self.classes else None
        return {"caller": caller, "callee": name, "receiver": receiver, "n_args": len(node.args) + len(node.keywords), "line": node.lineno, "kind": kind}


def comments_of(text: str) -> list[dict]:
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.append({"kind": "line", "text": t.string.lstrip("#").strip(), "line": t.start[0], "end_line": t.end[0]})
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def parse(text: str) -> dict:
    errors, visitor = [], Visitor()
    lines, tree = text.split("\n"), None
    end = len(lines)
    while tree is None:
        try:
            tree = ast.parse("\n".join(lines[:end]))
        except (SyntaxError, ValueError, RecursionError) as e:
            line = getattr(e, "lineno", None) or end
            if not errors:
                errors.append({"message": str(getattr(e, "msg", e)), "line": line})
            end = min(line - 1, end - 1)  # what stands before the error is still read
            if end <= 0:
                tree = ast.Module([], [])
    visitor.visit(tree)
    docs = [{"kind": "docstring", "text": s["doc"], "line": s["line"] + 1, "end_line": s["line"] + 1 + s["doc"].count("\n")} for s in visitor.symbols if s.get("doc")]
    return {"symbols": visitor.symbols, "imports": visitor.imports, "exports": [], "calls": visitor.calls, "comments": comments_of(text) + docs, "errors": errors}
