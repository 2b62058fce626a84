"""HTML to a tree of block elements and runs of text, with features for a graphical model."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

#: A value in quotes may hold ">"; a quote elsewhere is a character like others.  What is open at the end of a page ends there.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|(\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Element names by their role in HTML.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DEAD = frozenset("head template svg select button canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo ms mspace mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening element closes an open one of these, looked for up to one of those.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
TAGS = tuple("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset address menu details dialog".split())
#: The names of classes, ids and roles are features by a hash of each of their words, so that their weights are learnt.
NAME_BUCKETS = 4096
#: Deeper elements become children of the deepest, as browsers do it.
MAX_DEPTH = 512

FEATURES = {name: i for i, name in enumerate([*(f"tag {t}" for t in TAGS), "tag other", "hidden", "run", *(f"run words {k}" for k in range(5)), *(f"run links {k}" for k in range(3)), "run ends", "run first letter", *(f"links {k}" for k in range(3)), *(f"words {k}" for k in range(5)), "root"])}
N_FEATURES = len(FEATURES) + NAME_BUCKETS


@dataclass
class Tree:
    """Nodes in page order; parents come before their children."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    features: list[list[int]] = field(default_factory=lambda: [[FEATURES["root"]]])
    words: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str]] = field(default_factory=list)
    dead: list[bool] = field(default_factory=lambda: [False])
    marks: list[str | None] = field(default_factory=lambda: [None])

    def add(self, parent: int, features: list[int], dead: bool) -> int:
        if self.depth[parent] >= MAX_DEPTH:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.features.append(features)
        self.words.append(0)
        self.linked.append(0)
        self.dead.append(dead or self.dead[parent])
        self.marks.append(None)
        return len(self.parent) - 1


def level(n: int, limits: tuple[int, ...] = (3, 6, 12, 30)) -> int:
    return sum(n >= x for x in limits)


def link_level(linked: int, words: int) -> int:
    return 0 if not linked else 1 if 2 * linked < words else 2


def element_features(tag: str, attributes: str) -> list[int]:
    out = [FEATURES.get(f"tag {tag}", FEATURES["tag other"])]
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            out += (len(FEATURES) + zlib.crc32(x.lower().encode()) % NAME_BUCKETS for x in NAME.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append(FEATURES["hidden"])
    return list(dict.fromkeys(out))


def parse(page: str | None, mark: str | None = None) -> Tree:
    """The tree of a page.  Unclosed, unopened and wrongly nested elements are read leniently.

    ``mark``: an attribute of training pages whose value is noted for each element.  The places of open
    elements are kept by name, so that the time is in proportion to the page, whatever stays open.
    """
    tree = Tree()
    if not page:
        return tree
    stack: list[tuple[str, int]] = [("", 0)]
    open_: dict[str, list[int]] = {}
    pieces: list[tuple[str, bool]] = []

    def linked() -> bool:
        return bool(open_.get("a"))

    def push(tag: str, node: int) -> None:
        open_.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def highest(names: frozenset[str]) -> int:
        return max((open_[t][-1] for t in names if open_.get(t)), default=0)

    def flush() -> None:
        nonlocal pieces
        if not pieces:
            return
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            node = stack[-1][1]
            words = text.count(" ") + 1
            linked = sum(len(p.split()) for p, a in pieces if a)
            run = tree.add(node, [FEATURES["run"], FEATURES[f"run words {level(words)}"], FEATURES[f"run links {link_level(linked, words)}"]], False)
            if text[-1] in ".!?:;…\"”»)":
                tree.features[run].append(FEATURES["run ends"])
            if text[0].isupper():
                tree.features[run].append(FEATURES["run first letter"])
            tree.words[run], tree.linked[run] = words, min(linked, words)
            tree.runs.append((run, text))
        pieces = []

    def close(names: frozenset[str], up_to: frozenset[str] = frozenset()) -> None:
        k = highest(names)
        if not k or k < highest(up_to):
            return
        if any(t not in INLINE for t, _ in stack[k:]):
            flush()
        while len(stack) > k:
            open_[stack.pop()[0]].pop()

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            pieces.append((html.unescape(page[at:end]), linked()))
        if not m:
            break
        at = m.end()
        closing, tag, attributes, cut = m.groups()
        if tag is None:
            if m.group().startswith("<![CDATA["):
                pieces.append((m.group()[9:].removesuffix("]]>"), linked()))
            continue
        if cut is not None:
            break
        tag = tag.lower()
        if closing:
            if tag == "p" and not open_.get("p"):
                flush()
            close(frozenset([tag]))
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else n
        elif tag == "br":
            pieces.append((" ", False))
        elif tag in VOID:
            if tag == "hr":
                close(frozenset(["p"]), frozenset("td th table".split()))
                flush()
        elif tag in INLINE:
            if tag == "a":
                close(frozenset(["a"]), frozenset("td th table div p li".split()))
            push(tag, stack[-1][1])
        else:
            flush()
            if tag in CLOSES_P:
                close(frozenset(["p"]), frozenset("td th table button".split()))
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            node = tree.add(stack[-1][1], element_features(tag, attributes), tag in DEAD)
            if mark and (found := re.search(rf'{mark}="([^"]*)"', attributes)):
                tree.marks[node] = found[1]
            push(tag, node)
    flush()
    for i in range(len(tree.parent) - 1, 0, -1):
        tree.words[tree.parent[i]] += tree.words[i]
        tree.linked[tree.parent[i]] += tree.linked[i]
    runs = {i for i, _ in tree.runs}
    for i in range(1, len(tree.parent)):
        if i not in runs:
            tree.features[i] += [FEATURES[f"links {link_level(tree.linked[i], tree.words[i])}"], FEATURES[f"words {level(tree.words[i], (5, 20, 60, 200))}"]]
    return tree
