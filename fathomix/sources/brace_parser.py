"""Java, C#, Kotlin, Scala, Go, Rust, Swift, C, C++, PHP and Ruby source to symbols, imports, calls and comments.

Comments and strings are blanked out first, so that what stands in them is no code; then patterns of a
language find the heads of its declarations, brackets or the indentation of ``end`` tell where they
stop, and what lies within another is named by it.  No grammar: a declaration that a pattern doesn't know is lost, and the rest is read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from fathomix.sources.script_parser import chained

#: A declaration begins a line, or follows a bracket or the end of a statement; annotations may precede it.
START = r"(?:^|(?<=[{};]))[ \t]*(?:@\w+(?:\([^()\n]*\))?[ \t]+)*"
MODS = r"(?P<mods>(?:(?:public|private|protected|internal|fileprivate|static|final|abstract|sealed|virtual|override|async|readonly|open|data|inline|extern|unsafe|const|pub(?:\([^)]*\))?|export|default|synchronized|native|partial|suspend|operator|case|implicit|lazy|mutating|required|convenience)\s+)*)"
PARAMS = r"(?P<params>\((?:[^(){};]|\([^(){};]*\))*\))"
GENERIC = r"(?:<[^<>{};]*(?:<[^<>{};]*>[^<>{};]*)*>)?"
#: Words before a bracket that call nothing.
NOT_CALLED = frozenset("if for while switch catch return new else do try when match loop sizeof typeof func fn fun def function class struct enum interface trait impl elsif elif unless until case and or not in throw throws using lock foreach guard defer defined super self this where yield super assert".split())


@dataclass(frozen=True)
class Language:
    """Patterns: kinds and heads of declarations, imports as (pattern, kind), comments, strings."""

    heads: tuple[tuple[str, str], ...]
    imports: tuple[str, ...]
    comments: str = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
    strings: str = r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])\''
    by_end: bool = False
    #: Whether a name is visible elsewhere, by its modifiers and itself.
    exported: object = field(default=lambda mods, name: "private" not in mods)


_JAVA_LIKE = (
    ("class", rf"{START}{MODS}(?:class|record|struct)\s+(?P<name>\w+){GENERIC}(?P<base>[^{{;]*)(?=[{{;])"),
    ("interface", rf"{START}{MODS}@?interface\s+(?P<name>\w+){GENERIC}(?P<base>[^{{;]*)(?=\{{)"),
    ("enum", rf"{START}{MODS}enum\s+(?P<name>\w+)(?P<base>[^{{;]*)(?=\{{)"),
    ("constant", rf"{START}(?=[^\n=;({{}}]*\b(?:final|const|readonly)\b){MODS}[\w<>\[\],.? ]+?\s+(?P<name>[A-Z][A-Z0-9_]*)\s*=\s*(?P<value>[^;]+);"),
    ("function", rf"{START}{MODS}(?:{GENERIC}[ \t]*(?!(?:return|new|else|throw|package|import|case|goto|using|public|private|protected|internal|static|final|abstract|override|async|virtual)\b)(?P<type>[\w.]+{GENERIC}(?:\[\])*\??)\s+)?(?P<name>\w+)\s*{GENERIC}{PARAMS}\s*(?:throws\s+[\w.,\s]+?)?\s*(?=\{{|=>)"),
)
_C = (
    ("class", r"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)(?P<base>[^{;()]*)(?=\{)"),
    ("enum", r"^[ \t]*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)(?P<base>[^{;()]*)(?=\{)"),
    ("constant", r"^[ \t]*#[ \t]*define[ \t]+(?P<name>\w+)[ \t]+(?P<value>[^\n]+)"),
    ("type", r"^[ \t]*typedef\s+(?P<value>[^;{}()]+?)\s+\**(?P<name>\w+)\s*;"),
    ("function", rf"^(?P<mods>(?:(?:static|inline|extern|virtual|explicit|constexpr)\s+)*)(?!(?:return|else|typedef|new|delete|using|if|while|for|switch|public|private|protected)\b)(?P<type>[A-Za-z_][\w:<>,]*(?:\s+[A-Za-z_][\w:<>,]*)*[\s*&]+)(?:(?P<owner>\w+)::)?(?P<name>~?\w+)\s*{PARAMS}\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?=\{{)"),
)
LANGUAGES = {
    "java": Language(_JAVA_LIKE, (r"^[ \t]*import\s+(?:static\s+)?(?P<source>[\w.]+?)\.(?P<name>\w+|\*)\s*;",)),
    "csharp": Language(_JAVA_LIKE, (r"^[ \t]*using\s+(?:static\s+)?(?:(?P<local>\w+)\s*=\s*)?(?P<source>[\w.]+)\s*;",)),
    "kotlin": Language(
        (
            ("interface", rf"{START}{MODS}interface\s+(?P<name>\w+){GENERIC}(?P<base>[^{{\n]*)"),
            ("enum", rf"{START}{MODS}enum\s+class\s+(?P<name>\w+)(?P<base>[^{{\n]*)"),
            ("class", rf"{START}{MODS}(?:class|object)\s+(?P<name>\w+){GENERIC}(?P<base>[^{{\n]*)"),
            ("type", rf"{START}{MODS}typealias\s+(?P<name>\w+)\s*=\s*(?P<value>[^\n]+)"),
            ("constant", rf"^(?:const\s+)?{MODS}val\s+(?P<name>\w+)[^=\n]*=\s*(?P<value>[^\n]+)"),
            ("function", rf"{START}{MODS}fun\s+{GENERIC}\s*(?:\w+\.)?(?P<name>\w+)\s*{PARAMS}(?P<type>\s*:\s*[^={{\n]+)?"),
        ),
        (r"^[ \t]*import\s+(?P<source>[\w.]+?)\.(?P<name>\w+|\*)(?:\s+as\s+(?P<local>\w+))?[ \t]*$",),
    ),
    "scala": Language(
        (
            ("interface", rf"{START}{MODS}trait\s+(?P<name>\w+)(?P<base>[^{{\n]*)"),
            ("class", rf"{START}{MODS}(?:class|object)\s+(?P<name>\w+)(?P<base>[^{{\n]*)"),
            ("type", rf"{START}{MODS}type\s+(?P<name>\w+)[^=\n]*=\s*(?P<value>[^\n]+)"),
            ("constant", rf"{START}{MODS}val\s+(?P<name>[A-Z]\w*)[^=\n]*=\s*(?P<value>[^\n]+)"),
            ("function", rf"{START}{MODS}def\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?(?:{PARAMS})?(?P<type>\s*:\s*[^={{\n]+)?"),
        ),
        (r"^[ \t]*import\s+(?P<source>[\w.]+?)\.(?P<name>\w+|_|\{[^}]*\})[ \t]*$",),
    ),
    "go": Language(
        (
            ("class", r"^[ \t]*type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
            ("interface", r"^[ \t]*type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
            ("type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)=?\s*(?P<value>[^\n{]+)"),
            ("constant", r"^const\s+(?P<name>\w+)[^=\n]*=\s*(?P<value>[^\n]+)"),
            ("function", rf"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)(?:\[[^\]]*\])?{PARAMS}(?P<type>[^{{\n]*)"),
        ),
        (r'^[ \t]*import\s+(?:(?P<local>[\w.]+)\s+)?"(?P<source>[^"]+)"', r'(?<=[\n(;])[ \t]*(?:(?P<local>[\w.]+)[ \t]+)?"(?P<source>[^"\n]+)"[ \t]*(?=\n)'),
        strings=r'"(?:\\.|[^"\\\n])*"?|`[^`]*`?|\'(?:\\.|[^\'\\\n])+\'',
        exported=lambda mods, name: name[:1].isupper(),
    ),
    "rust": Language(
        (
            ("class", rf"{START}{MODS}(?:struct|union)\s+(?P<name>\w+){GENERIC}"),
            ("enum", rf"{START}{MODS}enum\s+(?P<name>\w+){GENERIC}"),
            ("interface", rf"{START}{MODS}trait\s+(?P<name>\w+){GENERIC}(?P<base>[^{{;]*)"),
            ("type", rf"{START}{MODS}type\s+(?P<name>\w+){GENERIC}\s*=\s*(?P<value>[^;]+);"),
            ("constant", rf"{START}(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z][A-Z0-9_]*)\s*:[^=;]*=\s*(?P<value>[^;]+);"),
            ("impl", rf"{START}(?:unsafe\s+)?impl{GENERIC}\s+(?:(?P<trait>[\w:]+){GENERIC}\s+for\s+)?(?P<name>\w+)[^{{;]*(?=\{{)"),
            ("function", rf"{START}{MODS}fn\s+(?P<name>\w+)\s*{GENERIC}{PARAMS}(?P<type>\s*->\s*[^{{;]+?)?\s*(?=\{{|;|where\b)"),
        ),
        (r"^[ \t]*(?:pub\s+)?use\s+(?P<source>[\w:]+?)::(?P<name>\w+|\*|\{[^}]*\})(?:\s+as\s+(?P<local>\w+))?\s*;",),
        strings=r'"(?:\\[\s\S]|[^"\\])*"?|\'(?:\\.|[^\'\\\n])\'',
        exported=lambda mods, name: any(m.startswith("pub") for m in mods),
    ),
    "swift": Language(
        (
            ("class", rf"{START}{MODS}(?:class|struct|actor|extension)\s+(?!func\b|var\b)(?P<name>\w+){GENERIC}(?P<base>[^{{\n]*)(?=\{{)"),
            ("interface", rf"{START}{MODS}protocol\s+(?P<name>\w+)(?P<base>[^{{\n]*)(?=\{{)"),
            ("enum", rf"{START}{MODS}enum\s+(?P<name>\w+)(?P<base>[^{{\n]*)(?=\{{)"),
            ("type", rf"{START}{MODS}typealias\s+(?P<name>\w+)\s*=\s*(?P<value>[^\n]+)"),
            ("constant", rf"^{MODS}let\s+(?P<name>\w+)[^=\n]*=\s*(?P<value>[^\n]+)"),
            ("function", rf"{START}{MODS}(?:class\s+)?func\s+(?P<name>\w+)\s*{GENERIC}{PARAMS}(?P<type>[^{{\n]*)"),
        ),
        (r"^[ \t]*import\s+(?:class\s+|struct\s+|func\s+)?(?P<source>[\w.]+)[ \t]*$",),
    ),
    "c": Language(_C, (r"^[ \t]*#[ \t]*include[ \t]+[<\"](?P<source>[^>\"\n]+)[>\"]",), exported=lambda mods, name: "static" not in mods),
    "cpp": Language(
        (("class", rf"^[ \t]*(?:template\s*{GENERIC}\s*)?class\s+(?P<name>\w+)(?P<base>[^{{;()]*)(?=\{{)"), ("method", rf"{START}(?P<mods>(?:(?:static|inline|virtual|explicit|constexpr)\s+)*)(?!(?:return|else|new|delete|throw|if|while|for|switch|catch|public|private|protected)\b)(?:(?P<type>[A-Za-z_][\w:<>,]*(?:\s+[A-Za-z_][\w:<>,]*)*[\s*&]+))?(?P<name>~?\w+)\s*{PARAMS}\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?=\{{)"), *_C),
        (r"^[ \t]*#[ \t]*include[ \t]+[<\"](?P<source>[^>\"\n]+)[>\"]", r"^[ \t]*using\s+namespace\s+(?P<source>[\w:]+)\s*;"),
        exported=lambda mods, name: "static" not in mods,
    ),
    "php": Language(
        (
            ("class", rf"{START}{MODS}(?:class|trait)\s+(?P<name>\w+)(?P<base>[^{{;]*)(?=\{{)"),
            ("interface", rf"{START}{MODS}interface\s+(?P<name>\w+)(?P<base>[^{{;]*)(?=\{{)"),
            ("enum", rf"{START}{MODS}enum\s+(?P<name>\w+)(?P<base>[^{{;]*)(?=\{{)"),
            ("constant", rf"{START}(?P<mods>(?:(?:public|private|protected|final)\s+)*)const\s+(?P<name>\w+)\s*=\s*(?P<value>[^;]+);"),
            ("function", rf"{START}{MODS}function\s+&?(?P<name>\w+)\s*{PARAMS}(?P<type>\s*:\s*[^{{;]+)?"),
        ),
        (r"^use\s+(?P<source>[\w\\]+?)\\(?P<name>\w+)(?:\s+as\s+(?P<local>\w+))?\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<source>[^'\"]+)['\"]"),
        comments=r"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)",
        strings=r'"(?:\\[\s\S]|[^"\\])*"?|\'(?:\\[\s\S]|[^\'\\])*\'?',
    ),
    "ruby": Language(
        (
            ("class", r"^[ \t]*(?:class|module)\s+(?P<name>[A-Z]\w*)(?P<base>[ \t]*<[ \t]*[\w:]+)?"),
            ("constant", r"^[ \t]*(?P<name>[A-Z][A-Z0-9_]*)[ \t]*=[ \t]*(?P<value>[^=\n][^\n]*)"),
            ("function", r"^[ \t]*(?P<mods>(?:private\s+|protected\s+)?)def\s+(?:self\.)?(?P<name>\w+[?!=]?)(?P<params>\([^)\n]*\))?"),
        ),
        (r"^[ \t]*require(?:_relative)?[ \t]*\(?[ \t]*['\"](?P<source>[^'\"]+)['\"]",),
        comments=r"#[^\n]*|^=begin[\s\S]*?(?:^=end|\Z)",
        strings=r'"(?:\\[\s\S]|[^"\\])*"?|\'(?:\\[\s\S]|[^\'\\])*\'?',
        by_end=True,
    ),
}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _comment(raw: str, line: int) -> dict:
    kind = "jsdoc" if raw.startswith("/**") else "block" if raw.startswith(("/*", "=begin")) else "line"
    body = re.sub(r"^(?:/\*\*?|//[/!]?|#|=begin)|(?:\*/|=end)$", "", raw.strip())
    return {"kind": kind, "text": "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in body.split("\n")).strip(), "line": line, "end_line": line + raw.count("\n")}


def _brackets(code: str) -> tuple[dict[int, int], list[tuple[int, str]]]:
    """The place after the bracket that closes each one, the end of the text if none does; and which have no other."""
    ends, stack, wrong = {}, [], []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
        else:
            wrong.append((m.start(), "bracket that opens nothing"))
    wrong += [(at, "bracket that is never closed") for at in stack]
    return ends | dict.fromkeys(stack, len(code)), sorted(wrong)


def _end_keyword(code: str, start: int) -> int:
    """The place after the ``end`` of the same indentation as the line of ``start``."""
    begin = code.rfind("\n", 0, start) + 1
    indent = re.match(r"[ \t]*", code[begin:]).group()
    m = re.compile(rf"^{indent}end\b", re.M).search(code, start)
    return m.end() if m else len(code)


def _bases(base: str | None) -> tuple[list[str], list[str]]:
    """(extends, implements) of what follows a name in a head."""
    text = re.sub(r"\([^()]*\)", "", re.sub(r"<[^<>]*>", "", base or "")).strip()
    names = lambda x: [n for n in re.findall(r"[A-Za-z_][\w.:\\]*", x or "") if n not in ("public", "private", "protected", "with", "extends", "implements", "virtual", "where")]
    m = re.match(r"(?:extends\s+(?P<e>[^{]*?))?(?:\s*implements\s+(?P<i>.*))?$", text, re.S)
    if m and (m["e"] or m["i"]):
        return names(m["e"]), names(m["i"])
    return names(text.lstrip(":<( ")) if text[:1] in (":", "<") else [], []


def parse(text: str, language: str) -> dict:
    lang = LANGUAGES[language]
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(starts, at)
    comments: list[dict] = []
    literal = re.compile(f"(?P<comment>{lang.comments})|(?P<string>{lang.strings})", re.M)

    def cut(m: re.Match) -> str:
        if m["comment"] is not None:
            comments.append(_comment(m.group(), line_of(m.start())))
        return _blank(m.group())

    code = literal.sub(cut, text)
    quoted = literal.sub(lambda m: _blank(m.group()) if m["comment"] is not None else m.group(), text)
    ends, wrong = _brackets(code)
    errors = [] if lang.by_end else [{"message": text, "line": line_of(at)} for at, text in wrong]
    found: list[tuple[int, int, str, re.Match]] = []
    taken: set[int] = set()
    for kind, head in lang.heads:
        for m in re.compile(head, re.M).finditer(code):
            name = m["name"]
            if m.start("name") in taken or name in NOT_CALLED:
                continue
            taken.add(m.start("name"))
            if kind in ("constant", "type") and "value" in m.re.groupindex:
                end = m.end()
            elif lang.by_end:
                end = _end_keyword(code, m.end())
            else:
                opening = re.compile(r"[{;\n]" if language in ("kotlin", "scala") else r"[{;]").search(code, m.end())
                end = ends[opening.start()] if opening and opening.group() == "{" else (opening.start() if opening else len(code))
            found.append((m.start("name"), end, kind, m))
    found.sort(key=lambda x: x[0])
    docs = {c["end_line"]: c for c in comments}
    symbols: list[dict] = []
    owners: list[tuple[int, str]] = []  # (end, name) of open classes
    bodies: list[tuple[int, int, str]] = []
    for at, end, kind, m in found:
        while owners and owners[-1][0] <= at:
            owners.pop()
        group = m.groupdict()
        mods = (group.get("mods") or "").split()
        owner = group.get("owner") or (owners[-1][1] if owners else None)
        if kind == "impl":
            owners.append((end, m["name"]))
            if group.get("trait"):
                for s in symbols:
                    if s["kind"] == "class" and s["name"] == m["name"]:
                        s["implements"] = [*s["implements"], group["trait"]]
            continue
        if kind == "method" and not owner:
            continue
        is_function = kind in ("function", "method")
        if is_function and language in ("java", "csharp") and not group.get("type") and owner != m["name"]:
            continue  # a call before a block, not a constructor
        line = line_of(at)
        first = line_of(m.start() + len(m.group()) - len(m.group().lstrip()))
        doc, above = [], first - 1
        while above in docs and (docs[above]["kind"] != "line" or not doc or docs[above]["kind"] == "line"):
            doc.insert(0, docs[above]["text"])
            if docs[above]["kind"] != "line":
                break
            above = docs[above]["line"] - 1
        extends, implements = _bases(group.get("base"))
        params = re.sub(r"\s+", " ", group.get("params") or "()") if is_function else None
        returns = re.sub(r"\s+", " ", (group.get("type") or "").strip())
        signature = None
        if is_function:
            before = language in ("java", "csharp", "c", "cpp")
            signature = f"{m['name']}{params}" + (f": {returns}" if returns and before else f" {returns}" if returns else "")
        value = group.get("value")
        symbols.append({
            "name": f"{owner}.{m['name']}" if owner and is_function else m["name"], "kind": "method" if owner and is_function else kind, "line": line, "end_line": line_of(max(at, end - 1)),
            "signature": signature, "doc": "\n".join(doc) or None, "parent": owner if is_function else None, "modifiers": mods, "extends": extends, "implements": implements,
            "value": text[m.start("value") : m.end("value")].strip() if value else None, "exported": bool(lang.exported(mods, m["name"])),
        })
        if kind in ("class", "interface", "enum"):
            owners.append((end, m["name"]))
        elif is_function:
            bodies.append((m.end(), end, symbols[-1]["name"]))
    return {"symbols": symbols, "imports": _imports(quoted, lang, line_of), "exports": [], "calls": _calls(code, bodies, taken, line_of), "comments": comments, "errors": errors}


def _imports(quoted: str, lang: Language, line_of) -> list[dict]:
    out: dict[int, dict] = {}
    block = re.compile(r"^import\s*\(([\s\S]*?)\)", re.M)
    for i, pattern in enumerate(lang.imports):
        areas = [(0, len(quoted))] if not (i and pattern.startswith("(?<=[\\n(;])")) else [m.span(1) for m in block.finditer(quoted)]
        for a, b in areas:
            for m in re.compile(pattern, re.M).finditer(quoted, max(0, a - 1), b + 1):
                g = m.groupdict()
                names = re.findall(r"\w+", g["name"]) if (g.get("name") or "").startswith("{") else [g.get("name")]
                for k, name in enumerate(names):
                    all_ = name in (None, "*", "_")
                    local = g.get("local") or (None if name in ("*", "_") else name or re.split(r"[./\\:]", g["source"])[-1])
                    out[m.start("source") * 100 + k] = {"source": g["source"], "kind": "namespace" if all_ else "named", "imported": "*" if all_ else name, "local": local, "line": line_of(m.start("source"))}
    return [out[k] for k in sorted(out)]


CALL = re.compile(r"(?<![\w$@#])(?P<receiver>(?:[A-Za-z_$]\w*(?:\.|->|::|\?\.))*)(?P<name>[A-Za-z_]\w*[!?]?)\s*\(")


def _calls(code: str, bodies: list[tuple[int, int, str]], heads: set[int], line_of) -> list[dict]:
    links = []
    open_: list[tuple[int, str]] = []
    waiting = sorted(bodies, reverse=True)
    for m in CALL.finditer(code):
        at, name = m.start("name"), m["name"]
        while waiting and waiting[-1][0] <= at:
            _, end, owner = waiting.pop()
            open_.append((end, owner))
        while open_ and open_[-1][0] <= at:
            open_.pop()
        if name in NOT_CALLED and not m["receiver"] or at in heads or not open_:
            continue
        depth, commas, some, j = 1, 0, False, m.end()
        while j < len(code) and depth:
            c = code[j]
            depth += (c in "([{") - (c in ")]}")
            commas += c == "," and depth == 1
            some = some or not c.isspace() and depth > 0
            j += 1
        receiver = re.sub(r"(?:\.|->|::|\?\.)$", "", m["receiver"]) or None
        new = code[: m.start()].rstrip().endswith("new")
        links += chained([{"caller": open_[-1][1], "callee": name, "receiver": receiver, "n_args": commas + 1 if some or commas else 0, "line": line_of(at), "kind": "constructor" if new else "method" if receiver else "function"}])
    return links
