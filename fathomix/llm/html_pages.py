"""Labelled training pages: varied layouts whose elements are marked as content or not."""

from __future__ import annotations

import random

#: The attribute that holds an element's label, 1 for main text; the nearest marked ancestor decides.
MARK = "data-label"
SYLLABLES = "an be co da el fi go ha in ko la me no or pe re sa ti un ve".split()


def _words(r: random.Random, n: int) -> str:
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    out[0] = out[0].capitalize()
    return " ".join(out)


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(3, 25)) + r.choice(".....!?") for _ in range(n))


def _list(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>' for i in range(n)) + "</ul>"


#: Names that pages give to parts beside the main text, by kind, and to the main text.
NAMES = {
    "advert": "ad ads adv advert adverts advertisement advertising ad-slot sponsor sponsored sponsored-box promo promoted promotion banner dfp",
    "sidebar": "sidebar side-bar side related related-posts widget widgets rail recommended more-stories rss trending popular complementary",
    "comments": "comment comments comment-list commentlist reader-comments replies reply respond discuss disqus discussion reactions reviews",
    "notice": "notice cookie cookies cookie-notice consent gdpr newsletter subscribe subscription popup modal alert dialog disclaimer signup paywall",
    "form": "search search-form login register contact form signin feedback",
    "share": "share sharing social tags breadcrumb breadcrumbs meta-links skip toolbar pagination pager links tools",
    "header": "header masthead top-banner site-header topbar top branding banner",
    "menu": "menu nav navbar navigation main-menu breadcrumb toolbar links sitemap",
    "footer": "footer copyright legal site-footer bottom contentinfo credits imprint",
    "main": "article post content article-body articlebody entry entry-content story main main-content body text page news",
}


def _name(r: random.Random, kind: str, telling: bool) -> str:
    return r.choice(NAMES[kind].split()) if telling else _words(r, 1).lower()


def _element(r: random.Random, tag: str, inner: str, name: str, label: int) -> str:
    named = f' {r.choice(["class", "class", "id", "role"])}="{name}"' if name else ""
    return f'<{tag}{named} {MARK}="{label}">{inner}</{tag}>'


def _prose(r: random.Random) -> str:
    return r.choice([lambda: _sentences(r, r.randint(1, 3)), lambda: f"<p>{_sentences(r, r.randint(1, 4))}</p>" * r.randint(1, 2), lambda: _list(r, r.randint(2, 8)), lambda: f"<h3>{_words(r, 2)}</h3>{_list(r, 4)}"])()


def _aside(r: random.Random, telling: bool) -> str:
    """Something beside the main text, within it or next to it; without a telling name, its elements or links show it."""
    each = r.choice([lambda: f"<div><h4>{_words(r, 1)}</h4><p>{_sentences(r, r.randint(1, 5))}</p></div>", lambda: f"<li><p>{_sentences(r, r.randint(1, 3))}</p></li>", lambda: f"<p>{_sentences(r, r.randint(1, 3))}</p>"])
    comments = "".join(each() for _ in range(r.randint(1, 6)))
    kinds = [
        lambda: _element(r, "aside", _prose(r), r.choice(["", _name(r, "sidebar", telling)]), 0),
        lambda: _element(r, "form", f"<label>{_words(r, 2)}</label><input name=q><p>{_sentences(r, 1)}</p>", r.choice(["", _name(r, "form", telling)]), 0),
        lambda: _element(r, r.choice(["div", "ul", "section"]), _list(r, r.randint(2, 9)), _name(r, "share", telling), 0),
        lambda: _element(r, "nav", _list(r, r.randint(2, 6)), r.choice(["", _name(r, "menu", telling)]), 0),
        lambda: _element(r, "dialog", _sentences(r, r.randint(1, 2)), r.choice(["", _name(r, "notice", telling)]), 0),
    ]
    if telling:
        kinds += 2 * [
            lambda: _element(r, r.choice(["div", "p", "section"]), _sentences(r, r.randint(1, 3)) if r.random() < 0.5 else _prose(r), _name(r, "advert", True), 0),
            lambda: _element(r, "div", _prose(r), _name(r, "sidebar", True), 0),
            lambda: _element(r, r.choice(["section", "div", "ol"]), comments, _name(r, "comments", True), 0),
            lambda: _element(r, "div", _prose(r), _name(r, "notice", True), 0),
        ]
    return r.choice(kinds)()


def _block(r: random.Random) -> str:
    close = r.choice(["</p>", "</p>", "</p>", ""])
    link = f' <a href="/x">{_words(r, 2)}</a> '
    kinds = [lambda: f"<p>{_sentences(r, r.randint(1, 8))}{close}"] * 6 + [
        lambda: f"<p>{_words(r, 1)}.{close}",
        lambda: f"<p><b>{_sentences(r, 1)}</b>{r.choice(['', link])}{_sentences(r, 2)}{close}",
        lambda: f"<h2>{_words(r, r.randint(1, 6))}</h2>",
        lambda: f"<blockquote>{_sentences(r, 2)}</blockquote>",
        lambda: "<ul>" + "".join(f"<li>{_sentences(r, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
        lambda: "<table>" + "".join(f"<tr><td>{_words(r, 2)}</td><td>{_words(r, 3)}</td></tr>" for _ in range(3)) + "</table>",
        lambda: f"<div>{_sentences(r, 3)}</div>",
        lambda: f"<pre>{_words(r, 8)}</pre>",
    ]
    return r.choice(kinds)()


def labelled_page(r: random.Random) -> str:
    """One page; some have no header, menu, footer or aside, some lose their last tags, half have no telling names."""
    telling = r.random() < 0.5
    blocks = [f"<h1>{_words(r, r.randint(1, 9))}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice([1, 1, 2, 4, 8, 16])):
        blocks.append(_block(r))
        if r.random() < (0.3 if telling else 0.1):
            blocks.append(_aside(r, telling))
    tag = r.choice(["article"] * 4 + ["main", "div", "div", "section"])
    inner = "".join(blocks)
    for _ in range(r.choice([0, 0, 0, 1, 2, 4])):
        inner = f"<div>{inner}</div>" if r.random() < 0.7 else f"<section>{inner}</section>"
    main = _element(r, tag, inner, r.choice(["", "", _name(r, "main", telling)]), 1)
    if r.random() < 0.1:  # a fragment without a page around it
        return main
    if r.random() < 0.3:
        main = f"<div>{main}{_aside(r, telling) if r.random() < 0.5 else ''}</div>"
    top = [f"<title>{_words(r, 4)}</title><style>p{{margin:0}}</style>"]
    name = lambda kind: r.choice(["", _name(r, kind, telling)])
    parts = []
    if r.random() < 0.4:
        inner = f"<h1>{_words(r, 2)}</h1><p>{_sentences(r, 1)}</p>" if r.random() < 0.5 else _words(r, 3)
        parts.append(_element(r, "header", inner, name("header"), 0) if not telling or r.random() < 0.5 else _element(r, "div", inner, _name(r, "header", True), 0))
    if r.random() < 0.8:
        parts.append(_element(r, r.choice(["nav", "nav", "div", "ul"]), _list(r, r.randint(2, 8)), name("menu"), 0))
    parts += [_aside(r, telling) for _ in range(r.randint(0, 2))] + [main] + [_aside(r, telling) for _ in range(r.randint(0, 2))]
    if r.random() < 0.8:
        inner = f"&copy; {_words(r, 2)} &middot; {_sentences(r, r.randint(1, 2))}" if r.random() < 0.6 else f"<p>{_sentences(r, 1)}</p>{_list(r, 3)}"
        parts.append(_element(r, "footer", inner, name("footer"), 0) if not telling or r.random() < 0.6 else _element(r, "div", inner, _name(r, "footer", True), 0))
    page = f'<!DOCTYPE html><html><head>{"".join(top)}</head><body {MARK}="0">{"".join(parts)}'
    return page + ("</body></html>" if r.random() < 0.8 else "")


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]
