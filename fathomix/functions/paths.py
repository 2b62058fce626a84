"""Column functions on paths: parts, languages, patterns, priorities, similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r",
    ".m": "objective-c", ".mm": "objective-c", ".pl": "perl", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".fish": "shell", ".ps1": "powershell", ".lua": "lua", ".vim": "vim",
    ".md": "markdown", ".mdx": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".xml": "xml", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass",
    ".less": "less", ".sql": "sql", ".graphql": "graphql", ".gql": "graphql", ".vue": "vue", ".svelte": "svelte", ".dockerfile": "dockerfile",
}

#: Extensions of binary files.
BINARY_EXTENSIONS = (
    ".exe", ".dll", ".so", ".dylib", ".a", ".lib", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico", ".webp",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".ttf", ".woff", ".woff2", ".eot", ".otf",
    ".pyc", ".pyo", ".class", ".o", ".obj", ".db", ".sqlite", ".sqlite3",
)

#: The first pattern that matches a path gives its priority; 0.5 if none does.
PATH_PRIORITIES = (("^src/", 1.0), ("^lib/", 0.9), ("^packages/", 0.85), ("^test/", 0.6), ("^tests/", 0.6), (r"\.test\.", 0.6), (r"\.spec\.", 0.6), ("^examples?/", 0.5), ("^docs?/", 0.4))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last extension with its dot, lower-cased; empty if there is none or the name starts with it."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1))


def any_extension(path: Column) -> Column:
    """The last extension with its dot, even at the name's start."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def is_hidden(path: Column) -> Column:
    return basename(path).startswith(".") & (basename(path) != ".")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def normalise(path: Column) -> Column:
    """Slashes forward and single, no ./ parts, no slash at the end."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"(?<=^|/)\./", "")
    return F.when(F.length(out) > 1, F.regexp_replace(out, "/$", "")).otherwise(out)


def is_within(path: Column, base: Column) -> Column:
    return (path == base) | path.startswith(F.concat(base, F.lit("/")))


def is_valid(path: Column) -> Column:
    return ~path.contains("\0") & ~F.array_contains(F.split(path, "/"), "..")


def encode_document_path(path: Column) -> Column:
    """A flat file name for a path; not invertible, so never a key."""
    return F.regexp_replace(F.regexp_replace(path, r"\.\.", "__"), r"[/\\:]", "_")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def language(path: Column) -> Column:
    """The language of a file name, or null."""
    return F.when(F.lower(basename(path)) == "dockerfile", F.lit("dockerfile")).otherwise(_lookup(LANGUAGES, any_extension(path)))


def has_binary_extension(path: Column) -> Column:
    return any_extension(path).isin(*BINARY_EXTENSIONS)


def glob_regex(pattern: str) -> str:
    """A pattern of * (anything, slashes too) and ? (one character) as a regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | normalise(path).rlike(glob_regex(p))
    return out


def priority(path: Column) -> Column:
    out = None
    for pattern, value in PATH_PRIORITIES:
        hit = path.rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(0.5)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length; 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


class IgnoreRules:
    """Ordered ignore patterns in the manner of .gitignore: the last that matches decides."""

    #: Always ignored.
    ALWAYS = (".codeindex/", ".git/", "node_modules/", ".DS_Store", "Thumbs.db", "*.log", "*.tmp", "*.swp")

    def __init__(self, lines: list[str] | None = None):
        self.rules: list[tuple[str, bool]] = []
        self.add([*self.ALWAYS, *(lines or ())])

    def add(self, patterns: list[str]) -> None:
        for line in patterns:
            p = line.strip()
            if not p or p.startswith("#"):
                continue
            keep = p.startswith("!")
            self.rules.append((self._regex(p[1:] if keep else p), keep))

    @staticmethod
    def _regex(pattern: str) -> str:
        folder = pattern.endswith("/")
        body = pattern.strip("/")
        rooted = pattern.startswith("/") or "/" in body
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            else:
                out, i = out + re.escape(body[i]), i + 1
        return f"^{'' if rooted else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"

    def ignored(self, path: Column) -> Column:
        """Whether a relative file path is ignored; later rules override earlier ones."""
        out = F.lit(False)
        path = F.regexp_replace(path, r"\\", "/")
        for regex, keep in self.rules:
            out = F.when(path.rlike(regex), F.lit(not keep)).otherwise(out)
        return out

    def prunes(self, folder: str) -> bool:
        """Whether a folder, given relative to the root, need not be descended into: all below it is ignored,
        and no later rule takes a file back."""
        out = False
        for regex, keep in self.rules:
            if keep:
                out = False  # it may bring back what lies below
            elif re.match(regex, folder + "/x") and re.match(regex, folder + "/.y"):
                out = True
        return out
