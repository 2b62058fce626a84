"""JavaScript and TypeScript source to symbols, imports, exports, calls and comments.

A tokenizer and one pass over the tokens with a stack of open braces; no grammar.  Broken code loses the
statement it stands in, and the rest is read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?)|(?P<template>`(?:\\[\s\S]|[^`\\])*`?)|(?P<number>\d[\w.]*)|(?P<name>[#@]?[A-Za-z_$][\w$]*)|(?P<punct>=>|\?\.|\.\.\.|[{}()\[\];,.<>=:?!&|+*/%^~@#-])|(?P<space>\s+)|(?P<other>.)"""
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => return typeof case in of + - * %".split())
NOT_CALLED = frozenset("if for while switch catch function return typeof await async new delete void in of instanceof do else throw super case yield class import export with constructor".split())
MODIFIERS = frozenset("public private protected static async readonly abstract override get set declare accessor export default const".split())


def chained(links: list[dict]) -> list[dict]:
    """The calls of one chain with their place in it and their neighbours; a single call has none."""
    many = len(links) > 1
    for i, x in enumerate(links):
        x["chain_position"] = i if many else None
        x["chain_previous"] = links[i - 1]["callee"] if i else None
        x["chain_next"] = links[i + 1]["callee"] if i + 1 < len(links) else None
    return links


class Token:
    __slots__ = ("end", "kind", "line", "start", "text")

    def __init__(self, kind, text, line, start):
        self.kind, self.text, self.line, self.start, self.end = kind, text, line, start, start + len(text)


def tokens_of(text: str) -> tuple[list[Token], list[dict]]:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out, comments, at = [], [], 0
    while at < len(text):
        if text[at] == "/" and (not out or out[-1].text in BEFORE_REGEX) and (r := REGEX.match(text, at)):
            out.append(Token("regex", r.group(), bisect_right(starts, at), at))
            at = r.end()
            continue
        m = TOKEN.match(text, at)
        kind, line = m.lastgroup, bisect_right(starts, at)
        if kind == "comment":
            comments.append(_comment(m.group(), line))
        elif kind != "space":
            out.append(Token(kind, m.group(), line, at))
        at = m.end()
    return out, comments


def _comment(raw: str, line: int) -> dict:
    end = line + raw.count("\n")
    if raw.startswith("//"):
        return {"kind": "line", "text": raw[2:].strip(), "line": line, "end_line": end}
    kind = "jsdoc" if raw.startswith("/**") else "block"
    body = raw[3 if kind == "jsdoc" else 2 :].removesuffix("*/")
    return {"kind": kind, "text": "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in body.split("\n")).strip(), "line": line, "end_line": end}


class Parser:
    def __init__(self, text: str):
        self.source = text
        self.t, self.comments = tokens_of(text)
        self.i = 0
        self.symbols, self.imports, self.exports, self.calls, self.errors = [], [], [], [], []
        self.scopes: list[tuple[str, dict | None]] = []  # (kind, symbol) of each open brace
        self.docs = {c["end_line"]: c for c in self.comments if c["kind"] == "jsdoc"}

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k].text if 0 <= self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if 0 <= self.i + k < len(self.t) else ""

    def line(self) -> int:
        return self.t[min(self.i, len(self.t) - 1)].line if self.t else 1

    def text(self, a: int, b: int) -> str:
        """Source from token a to the one before b."""
        return re.sub(r"\s+", " ", self.source[self.t[a].start : self.t[b - 1].end]) if a < b <= len(self.t) else ""

    def closing(self, k: int) -> int:
        """The token after the bracket that closes the one at k."""
        pairs = {"(": ")", "[": "]", "{": "}", "<": ">"}
        a, b = self.t[k].text, pairs[self.t[k].text]
        depth = 0
        for j in range(k, len(self.t)):
            x = self.t[j].text
            depth += (x == a) - (x == b)
            if depth == 0:
                return j + 1
        return len(self.t)

    def owner(self) -> str | None:
        return next((s["name"] for _, s in reversed(self.scopes) if s and s["kind"] in ("function", "method")), None)

    def symbol(self, name, kind, line, exported=False, **more):
        doc = next((self.docs[x]["text"] for x in range(line - 1, line - 3, -1) if x in self.docs), None)
        s = {"name": name, "kind": kind, "line": line, "end_line": line, "signature": None, "doc": doc, "parent": None, "modifiers": [], "extends": [], "implements": [], "value": None, "exported": exported, **more}
        self.symbols.append(s)
        if exported:
            local = name.split(".")[-1]
            self.exports.append({"source": None, "kind": "default" if "default" in s["modifiers"] else "named", "local": local, "exported": "default" if "default" in s["modifiers"] else local, "line": line})
        return s

    def run(self) -> dict:
        while self.i < len(self.t):
            before = self.i
            self.step()
            if self.i <= before:
                self.i = before + 1
        if self.scopes:
            self.errors.append({"message": "unclosed brace", "line": self.line()})
        return {"symbols": self.symbols, "imports": self.imports, "exports": self.exports, "calls": self.calls, "comments": self.comments, "errors": self.errors}

    def step(self):
        x = self.at()
        if x == "{":
            self.scopes.append(("block", None))
            self.i += 1
        elif x == "}":
            if not self.scopes:
                self.errors.append({"message": "brace without an opening one", "line": self.line()})
            else:
                _, s = self.scopes.pop()
                if s:
                    s["end_line"] = self.line()
            self.i += 1
        elif self.kind() == "name" and self.at(-1) not in (".", "?."):
            if self.scopes and self.scopes[-1][0] == "class" and self.member():
                return
            self.statement(x)
        else:
            self.i += 1

    def statement(self, x: str):
        first, mods, exported = self.i, [], False
        line = self.line()
        if x == "import" and self.at(1) not in ("(", "."):
            return self.import_()
        if x == "export":
            if self.at(1) in ("{", "*") or self.at(1) == "type" and self.at(2) in ("{", "*"):
                return self.export_list()
            exported = True
        while self.at() in ("export", "default", "declare", "abstract", "async") and (self.kind(1) == "name" or self.at(1) in ("[", "{", "(", "<")):
            if self.at() == "async" and self.at(1) in ("(", "<"):
                break
            mods.append(self.at())
            self.i += 1
        x = self.at()
        marks = [m for m in mods if m != "export"]
        if x == "function":
            self.i += 1 + (self.at(1) == "*")
            name = self.at() if self.kind() == "name" else ("default" if "default" in mods else None)
            if self.kind() == "name":
                self.i += 1
            return self.function(name, "function", line, exported, marks) if name else None
        if x == "class" and (self.kind(1) == "name" or "default" in mods):
            return self.class_(line, exported, marks)
        if x == "interface" and self.kind(1) == "name":
            return self.interface(line, exported, marks)
        if x == "enum" and self.kind(1) == "name" or x == "const" and self.at(1) == "enum":
            return self.enum(line, exported, marks)
        if x == "type" and self.kind(1) == "name" and self.at(2) in ("=", "<"):
            return self.alias(line, exported, marks)
        if x in ("namespace", "module") and self.kind(1) in ("name", "string") and (brace := self.brace(3)):
            s = self.symbol(self.at(1).strip("\"'"), "namespace", line, exported, modifiers=marks)
            self.i = brace + 1
            self.scopes.append(("block", s))
            return None
        if x in ("const", "let", "var") and self.kind(1) == "name":
            return self.variable(line, exported, marks)
        if exported and "default" in mods:
            self.exports.append({"source": None, "kind": "default", "local": x if self.kind() == "name" else None, "exported": "default", "line": line})
        if self.i == first:
            self.reference()
        return None

    def brace(self, most: int) -> int | None:
        return next((self.i + k for k in range(most) if self.at(k) == "{"), None)

    def reference(self):
        """A name that may be called."""
        name = self.at()
        self.chain(self.i)
        self.i += 1
        if name == "require" and self.at() == "(" and self.kind(1) == "string":
            self.imports.append({"source": self.at(1).strip("\"'"), "kind": "require", "imported": "*", "local": self.t[self.i - 3].text if self.i >= 3 and self.t[self.i - 2].text == "=" else None, "line": self.line()})

    def arguments(self, opening: int) -> tuple[int, int]:
        """(number of arguments, the token after the closing bracket) of a call whose bracket is given."""
        end = self.closing(opening)
        inner = self.t[opening + 1 : end - 1]
        depth, commas = 0, 0
        for x in inner:
            depth += (x.text in "([{") - (x.text in ")]}")
            commas += x.text == "," and depth == 0
        return commas + 1 if inner else 0, end

    def chain(self, k: int):
        """Notes the calls of a chain of names that starts at k; what is called without a name is <dynamic>."""
        receiver: list[str] = []
        links: list[dict] = []
        before = self.t[k - 1].text if k else ""
        j = k
        while j < len(self.t):
            name = self.t[j].text
            after = j + 1
            if after < len(self.t) and self.t[after].text == "<" and (m := re.match(r"<[\w\s,.\[\]|]*>\(", self.source[self.t[after].start :])):
                end = self.t[after].start + len(m.group()) - 1
                after = next((n for n in range(after, len(self.t)) if self.t[n].start >= end), after)
            called = after < len(self.t) and self.t[after].text == "("
            nxt = self.closing(after) if called else j + 1
            if called and name not in NOT_CALLED and name != "require":
                kind = "constructor" if before == "new" and not links else "method" if receiver else "function"
                links.append({"caller": self.owner(), "callee": name.lstrip("#"), "receiver": ".".join(receiver) or None, "n_args": self.arguments(after)[0], "line": self.t[j].line, "kind": kind})
            receiver.append(name)
            while nxt < len(self.t) and self.t[nxt].text in ("[", "("):
                if self.t[nxt].text == "(" and not (called or self.t[nxt - 1].text == "]"):
                    break
                if self.t[nxt].text == "(":
                    links.append({"caller": self.owner(), "callee": "<dynamic>", "receiver": ".".join(receiver), "n_args": self.arguments(nxt)[0], "line": self.t[nxt].line, "kind": "dynamic"})
                called = True
                nxt = self.closing(nxt)
            if nxt < len(self.t) - 1 and self.t[nxt].text in (".", "?.") and self.t[nxt + 1].kind == "name":
                j = nxt + 1
            else:
                break
        self.calls += chained(links)

    def function(self, name, kind, line, exported, marks, parent=None):
        """From the parameters on; the body's brace is left open."""
        a = self.i
        if self.at() == "<":
            self.i = self.closing(self.i)
        if self.at() != "(":
            return
        end = self.closing(self.i)
        j = end
        if j < len(self.t) and self.t[j].text == ":":
            while j < len(self.t) and self.t[j].text not in (";", "=>") and not (self.t[j].text == "{" and self.t[j - 1].text not in (":", "|", "&", "<", ",")):
                j = self.closing(j) if self.t[j].text in ("(", "[", "{") else j + 1
        s = self.symbol(name, kind, line, exported, signature=name.split(".")[-1] + self.text(a, j), modifiers=marks, parent=parent)
        self.i = j
        if self.at() == "{":
            self.scopes.append(("function", s))
            self.i += 1

    def names_until(self, stops: tuple[str, ...]) -> list[str]:
        a, out = self.i, []
        while self.i < len(self.t) and self.at() not in stops:
            if self.at() == ",":
                out.append(self.text(a, self.i))
                a = self.i + 1
            self.i = self.closing(self.i) if self.at() in ("<", "(") else self.i + 1
        out.append(self.text(a, self.i))
        return [x for x in out if x]

    def class_(self, line, exported, marks):
        self.i += 1
        name = self.at() if self.kind() == "name" and self.at() not in ("extends", "implements") else "default"
        self.i += name != "default"
        if self.at() == "<":
            self.i = self.closing(self.i)
        extends, implements = [], []
        if self.at() == "extends":
            self.i += 1
            extends = self.names_until(("implements", "{", ";"))
        if self.at() == "implements":
            self.i += 1
            implements = self.names_until(("{", ";"))
        s = self.symbol(name, "class", line, exported, extends=extends, implements=implements, modifiers=marks)
        if self.at() == "{":
            self.scopes.append(("class", s))
            self.i += 1

    def interface(self, line, exported, marks):
        self.i += 1
        name = self.at()
        self.i += 1
        if self.at() == "<":
            self.i = self.closing(self.i)
        extends = []
        if self.at() == "extends":
            self.i += 1
            extends = self.names_until(("{", ";"))
        s = self.symbol(name, "interface", line, exported, extends=extends, modifiers=marks)
        if self.at() == "{":
            self.i = self.closing(self.i)
            s["end_line"] = self.t[self.i - 1].line

    def enum(self, line, exported, marks):
        self.i += 1 + (self.at() == "const")
        s = self.symbol(self.at(), "enum", line, exported, modifiers=marks)
        self.i += 1
        if self.at() == "{":
            end = self.closing(self.i)
            self.i += 1
            values = []
            while self.i < end - 1:
                if self.kind() in ("name", "string"):
                    values.append(self.at().strip("\"'"))
                while self.i < end - 1 and self.at() != ",":
                    self.i += 1
                self.i += 1
            self.i = end
            s["value"] = ", ".join(values)
            s["end_line"] = self.t[end - 1].line

    def alias(self, line, exported, marks):
        name = self.at(1)
        while self.i < len(self.t) and self.at() != "=":
            self.i += 1
        self.i += 1
        a = self.i
        while self.i < len(self.t) and self.at() != ";" and not (self.i > a and self.t[self.i].line > self.t[self.i - 1].line and self.at() not in ("|", "&", "}", ")", "=>") and self.t[self.i - 1].text not in ("|", "&", "=", "=>", ",")):
            self.i = self.closing(self.i) if self.at() in ("{", "(", "[") else self.i + 1
        value = self.text(a, self.i)
        s = self.symbol(name, "type", line, exported, signature=value if len(value) <= 200 else value[:200] + "...", modifiers=marks)
        s["end_line"] = self.t[self.i - 1].line

    def variable(self, line, exported, marks):
        const = self.at() == "const"
        name = self.at(1)
        self.i += 2
        if self.at() == ":":
            while self.i < len(self.t) and self.at() not in ("=", ";"):
                self.i = self.closing(self.i) if self.at() in ("{", "(", "[", "<") else self.i + 1
        if self.at() != "=":
            return
        self.i += 1
        a = self.i
        is_async = self.at() == "async"
        self.i += is_async
        marks = [*marks, *(["async"] if is_async else [])]
        if self.at() == "function":
            self.i += 1 + (self.at(1) == "*")
            self.i += self.kind() == "name"
            return self.function(name, "function", line, exported, marks)
        if self.arrow():
            if self.at() == "<":
                self.i = self.closing(self.i)
            b = self.i
            if self.at() == "(":
                self.i = self.closing(self.i)
            while self.i < len(self.t) and self.at() != "=>":
                self.i += 1
            s = self.symbol(name, "function", line, exported, signature=name + self.text(b, self.i), modifiers=marks)
            self.i += 1
            if self.at() == "{":
                self.scopes.append(("function", s))
                self.i += 1
            else:
                self.scopes.append(("arrow", s))
                self.expression()
                self.scopes.pop()
                s["end_line"] = self.t[min(self.i, len(self.t)) - 1].line
            return None
        self.i = a
        if const and not self.owner():
            end = a
            while end < len(self.t) and self.t[end].text not in (";",) and not (end > a and self.t[end].line > self.t[end - 1].line and self.t[end].kind == "name"):
                end = self.closing(end) if self.t[end].text in ("{", "(", "[") else end + 1
            s = self.symbol(name, "constant", line, exported, value=self.text(a, end), modifiers=marks)
            s["end_line"] = self.t[min(end, len(self.t)) - 1].line
        elif exported:
            self.exports.append({"source": None, "kind": "named", "local": name, "exported": name, "line": line})
        return None

    def arrow(self) -> bool:
        """Whether an arrow function starts here."""
        if self.kind() == "name" and self.at(1) == "=>":
            return True
        j = self.closing(self.i) if self.at() == "<" else self.i
        if j >= len(self.t) or self.t[j].text != "(":
            return False
        j = self.closing(j)
        if j < len(self.t) and self.t[j].text == ":":
            while j < len(self.t) and self.t[j].text not in ("=>", ";", "{"):
                j += 1
        return j < len(self.t) and self.t[j].text == "=>"

    def expression(self):
        """One expression without a body; its calls are noted."""
        depth, first = 0, self.i
        while self.i < len(self.t):
            x = self.at()
            if depth == 0 and (x in (";", "}") or x == "," or self.i > first and self.t[self.i].line > self.t[self.i - 1].line and x not in (".", "?.", ")", "&", "|", "?", ":")):
                return
            depth += (x in "([{" and len(x) == 1) - (x in ")]}" and len(x) == 1)
            if depth < 0:
                return
            if self.kind() == "name" and self.at(-1) not in (".", "?."):
                self.chain(self.i)
            self.i += 1

    def member(self) -> bool:
        """A method or property of the class whose body this is."""
        cls = self.scopes[-1][1]
        line, marks = self.line(), []
        while self.at() in MODIFIERS and (self.kind(1) == "name" or self.at(1) in ("*", "[")) or self.at().startswith("@"):
            marks.append(self.at())
            self.i += 1
            if marks[-1].startswith("@") and self.at() == "(":
                self.i = self.closing(self.i)
        if self.at() == "*":
            marks.append("generator")
            self.i += 1
        if self.kind() != "name":
            self.i += 1
            return True
        name = f"{cls['name']}.{self.at().lstrip('#')}"
        if self.at().startswith("#") and "private" not in marks:
            marks.append("private")
        self.i += 1
        if self.at() in ("(", "<"):
            self.function(name, "method", line, False, marks, cls["name"])
            return True
        while self.at() in ("?", "!"):
            self.i += 1
        if self.at() in (":", "=", ";", "}") or self.line() > line:
            s = self.symbol(name, "property", line, False, modifiers=marks, parent=cls["name"])
            if self.at() == ":":
                while self.i < len(self.t) and self.at() not in ("=", ";", "}") and not (self.line() > line and self.at(-1) not in (":", "|", "&")):
                    self.i = self.closing(self.i) if self.at() in ("{", "(", "[", "<") else self.i + 1
            if self.at() == "=":
                self.i += 1
                if self.at() == "async" or self.arrow():
                    while self.i < len(self.t) and self.at() != "=>":
                        self.i += 1
                    self.i += 1
                    s["kind"] = "method"
                    if self.at() == "{":
                        self.scopes.append(("function", s))
                        self.i += 1
                        return True
                self.scopes.append(("arrow", s if s["kind"] == "method" else None))
                self.expression()
                self.scopes.pop()
        return True

    def import_(self):
        line = self.line()
        self.i += 1
        found, kind = [], "side_effect"
        if self.at() == "type" and self.at(1) != "from":
            self.i += 1
        while self.i < len(self.t) and self.kind() != "string" and self.at() != ";":
            if self.at() == "{":
                end, self.i, kind = self.closing(self.i), self.i + 1, "named"
                while self.i < end - 1:
                    if self.at() == "type" and self.kind(1) == "name" and self.at(1) != "as":
                        self.i += 1
                    name = self.at()
                    alias = self.at(2) if self.at(1) == "as" else name
                    found.append((name, alias, "named"))
                    while self.i < end - 1 and self.at() != ",":
                        self.i += 1
                    self.i += 1
                self.i = end
            elif self.at() == "*":
                found.append(("*", self.at(2), "namespace"))
                self.i += 3
            elif self.kind() == "name" and self.at() != "from":
                found.append(("default", self.at(), "default"))
                self.i += 1
            else:
                self.i += 1
        source = self.at().strip("\"'") if self.kind() == "string" else None
        self.i += 1
        if source is not None:
            rows = found or [(None, None, kind)]
            self.imports += [{"source": source, "kind": k, "imported": a, "local": b, "line": line} for a, b, k in rows]

    def export_list(self):
        line = self.line()
        self.i += 1 + (self.at(1) == "type")
        found = []
        if self.at() == "*":
            found.append(("*", self.at(2) if self.at(1) == "as" else "*", "namespace"))
            self.i += 3 if self.at(1) == "as" else 1
        else:
            end = self.closing(self.i)
            self.i += 1
            while self.i < end - 1:
                name = self.at()
                found.append((name, self.at(2) if self.at(1) == "as" else name, "named"))
                while self.i < end - 1 and self.at() != ",":
                    self.i += 1
                self.i += 1
            self.i = end
        source = None
        if self.at() == "from" and self.kind(1) == "string":
            source = self.at(1).strip("\"'")
            self.i += 2
        self.exports += [{"source": source, "kind": k, "local": a, "exported": b, "line": line} for a, b, k in found]


def parse(text: str) -> dict:
    return Parser(text).run()
