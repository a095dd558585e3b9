"""Main text of web pages by tree scoring: paragraphs pass points to what holds them, and the best container is kept.

A page becomes a tree once, by a scan for tags (scripts, styles and comments are skipped as the browser would). Each
paragraph has points for its length and its commas, less its share of links; they go in full to what holds it, and
halved for each level above. A container's points are discounted by its own share of links. The best one, an article
around or within it if there is one, and those siblings that belong to it, are the main text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A tag (its slash, name and attributes), a comment, or another declaration. 
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*>)""", re.S)
_OPENED = re.compile("<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
# Marks letters only: such elements aren't in the tree.
_LETTERS = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small strike strong sub sup time tt u var".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol"
    " optgroup option p pre search section select summary table tbody tfoot thead title tr ul".split()
)
_CLOSED_BY = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
# Never text of an article.
_NEVER = frozenset("head title script style noscript template svg canvas audio video object iframe noembed noframes select option optgroup textarea button input datalist dialog applet map nav menu footer aside search xmp".split())
_MAIN = frozenset(("article", "main"))
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Parts of class names and ids: those of the first kind are never the article's; those of the second are unless a part of the third stands beside them.
_ASIDE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist disqus cookie cookies consent gdpr sidebar nav navbar navigation menu menubar"
    " breadcrumb breadcrumbs footer popup modal newsletter subscribe subscription signup login pagination pager".split()
)
_OFTEN = frozenset("header masthead banner notice notices alert warning disclaimer related recommended recommendations share sharing social toolbar widget widgets tags skip reply replies respond paywall outbrain taboola".split())
_TEXTUAL = frozenset("article articlebody body content entry main post story text".split())
_NOT = frozenset(("has", "with", "no", "without", "hide"))


@dataclass
class _Tree:
    """Nodes in page order: tag, parent and what the attributes say; chunks of text: node, text, in a link, number of the block."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    chunks: list[tuple[int, str, bool, int]] = field(default_factory=list)


def _parse(html: str) -> _Tree:
    """The tree of a page. Tags left open end with what holds them; end tags of nothing are skipped."""
    tree, stack, opened, at, block, end = _Tree(), [0], {"html": 1}, 0, 0, len(html)

    def close(upto: int) -> None:
        for i in stack[upto:]:
            opened[tree.tag[i]] -= 1
        del stack[upto:]

    def nearest(tags, until) -> int:
        """Where in the stack the innermost of `tags` is that no `until` parts from here, or 0."""
        if any(opened.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[k]] in tags:
                    return k
                if tree.tag[stack[k]] in until:
                    break
        return 0

    def say(text: str) -> None:
        if text:
            tree.chunks.append((stack[-1], text, opened.get("a", 0) > 0, block))

    last = html.rfind(">")  # nothing opened beyond it has an end
    while at < end:
        found = _TAG.search(html, at) if at <= last else None
        begin = found.start() if found else end
        if not found:  # a tag or comment without an end is no text
            begin = m.start() if (m := _OPENED.search(html, at)) else end
        if begin > at:
            say(html[at:begin])
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name or name in _LETTERS:
            continue
        is_block = name in _BLOCK
        if found[1] or found[4]:
            if is_block or name in ("td", "th"):
                k = nearest((name,), ())
                block += is_block
            else:
                k = nearest((name,), _BLOCK)
            if k:
                close(k)
            if name in ("td", "th"):
                say(" ")
            continue
        if name in ("html", "body") and opened.get("body", 0):
            continue
        if is_block:
            block += 1
            k = nearest(("p",), ("td", "th", "table"))
            if k:
                close(k)
        if name in _CLOSED_BY:
            k = nearest(_SAME.get(name, (name,)), _CLOSED_BY[name])
            if k:
                close(k)
        elif name == "a":  # a link within a link ends it
            k = nearest(("a",), _BLOCK)
            if k:
                close(k)
        elif name == "body" and opened.get("head"):
            close(nearest(("head",), ()))
        if name in ("br", "img", "td", "th", "hr", "wbr"):
            say("" if name == "wbr" else " ")
        if name in _VOID:
            continue
        tree.tag.append(name)
        tree.parent.append(stack[-1])
        tree.attributes.append(found[3] or found[6] or "")
        if name in _RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        stack.append(len(tree.tag) - 1)
        opened[name] = opened.get(name, 0) + 1
    return tree


def _aside(tag: str, attributes: str, in_article: bool) -> int:
    """2: never the main text; 1: not unless it holds it; 0: may be."""
    if tag in _NEVER:
        return 1 if tag in ("nav", "menu", "footer", "aside", "dialog", "object") else 2
    if tag == "form" or (tag == "header" and not in_article):
        return 1
    if not attributes:
        return 0
    said = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", ""), re.I):
        return 1
    if said.get("role", "").lower() in _NEVER_ROLES and not (in_article and said["role"].lower() == "banner"):
        return 1
    if tag in ("html", "body"):
        return 0
    often = textual = False
    for name in f"{said.get('class', '')} {said.get('id', '')}".split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        for before, p in zip(["", *parts], parts, strict=False):
            if before in _NOT:
                continue
            if p in _ASIDE and not (tag in _MAIN and p not in ("comment", "comments")):
                return 1
            often, textual = often or p in _OFTEN, textual or p in _TEXTUAL
    return int(often and not textual and tag not in _MAIN and not (in_article and tag == "header"))


def _main_nodes(tree: _Tree) -> list[bool]:
    """Which nodes are out: those that are no article's text whatever the points."""
    n = len(tree.tag)
    within = [False] * n
    for i in range(1, n):
        within[i] = within[tree.parent[i]] or tree.tag[i] in _MAIN
    kind = [_aside(t, a, within[p]) if p >= 0 else 0 for t, a, p in zip(tree.tag, tree.attributes, tree.parent, strict=True)]
    holds = [t in _MAIN and not k for t, k in zip(tree.tag, kind, strict=True)]
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] = holds[tree.parent[i]] or holds[i]
    out = [False] * n
    for i in range(1, n):
        out[i] = out[tree.parent[i]] or kind[i] == 2 or (kind[i] == 1 and not holds[i])
    return out


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, two line ends between; empty if there is none."""
    tree = _parse(html or "")
    n, parent = len(tree.tag), tree.parent
    out = _main_nodes(tree)
    blocks: list[tuple[int, str, int]] = []  # node, text, letters in links
    holder, before, pieces, linked = 0, -1, [], 0

    def finish() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            blocks.append((holder, text, linked))

    for i, text, link, block in tree.chunks:
        if out[i]:
            continue
        if block != before:
            finish()
            while parent[i] >= 0 and tree.tag[i] not in _BLOCK and tree.tag[i] not in ("td", "th"):
                i = parent[i]
            holder, before, pieces, linked = i, block, [], 0
        pieces.append(text)
        linked += len(text) if link else 0
    finish()
    if not blocks:
        return ""

    letters, links, points, n_links = [0] * n, [0] * n, [0.0] * n, [0] * n
    for i, text, of_links in blocks:
        letters[i] += len(text)
        links[i] += min(of_links, len(text))
    for i in range(n - 1, 0, -1):
        letters[parent[i]] += letters[i]
        links[parent[i]] += links[i]
        n_links[i] += tree.tag[i] == "a" and not out[i]
        n_links[parent[i]] += n_links[i]
    share = lambda i: links[i] / letters[i] if letters[i] else 0.0
    # Lists and boxes of little but links are menus, whatever they are called.
    menu = [False] * n
    for i in range(1, n):
        menu[i] = menu[parent[i]] or (tree.tag[i] in ("ul", "ol", "dl", "div", "section", "table", "p") and n_links[i] >= 3 and share(i) > 0.75)
    for i, text, of_links in blocks:
        if menu[i]:
            continue
        given = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - min(of_links, len(text)) / len(text))
        up = i if tree.tag[i] in ("div", "section", "article", "main", "td", "body", "html") else parent[i]
        for _ in range(8):
            if up < 0:
                break
            points[up] += given
            up, given = parent[up], given / 2
    scored = [p * (1 - share(i)) for i, p in enumerate(points)]
    best = max(range(n), key=lambda i: (scored[i], -i))
    if scored[best] <= 0:
        best = next((i for i in range(n) if tree.tag[i] in _MAIN and letters[i] and not out[i]), -1)
        if best < 0:
            return ""
    around = best
    while around > 0 and tree.tag[around] != "article":
        around = parent[around]
    if around > 0:
        best = around
    else:  # the one article that has most of it
        inner = [i for i in range(best + 1, n) if tree.tag[i] == "article" and not out[i] and letters[i] * 2 > letters[best]]
        best = inner[0] if inner else best
    kept = [False] * n
    kept[best] = True
    if best > 0:
        least = max(2.0, scored[best] * 0.2)
        named = re.search(r"""class\s*=\s*["']?([^"'>]+)""", tree.attributes[best])
        for i in range(1, n):
            if parent[i] != parent[best] or i == best or out[i] or menu[i] or not letters[i]:
                continue
            alike = tree.tag[i] == tree.tag[best] and tree.tag[best] != "article" and named is not None and tree.attributes[i] == tree.attributes[best]
            title = re.fullmatch("h[1-6]|hgroup", tree.tag[i]) and i < best
            prose = tree.tag[i] in ("p", "blockquote", "pre") and share(i) < 0.25 and (letters[i] > 80 or tree.tag[best] != "article")
            kept[i] = bool(title or alike or prose or (tree.tag[best] != "article" and scored[i] >= least and share(i) < 0.25))
    for i in range(1, n):
        kept[i] = kept[i] or kept[parent[i]]
    return "\n\n".join(text for i, text, _ in blocks if kept[i] and not menu[i])


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The rows with the main text of their `html` as one more column, and n_chars, its code points.

    Pages stay where they are; a task holds a batch of them. A null or empty page, or one without main text, has an
    empty text. Repeated rows and null ids or urls stay rows of their own; an empty table gives no rows; columns named
    like `text` or n_chars are replaced, others come along. Whole pages are read, whatever their length.
    """
    rest = [c for c in pages.columns if c.lower() not in (text.lower(), "n_chars") or c == html]

    @F.pandas_udf("string")
    def extracted(s: pd.Series) -> pd.Series:
        return s.map(lambda h: main_text(h if isinstance(h, str) else None)).astype(object)

    made = pages.withColumn("_main_", extracted(F.col(html).cast("string")))
    return made.select(*rest, F.col("_main_").alias(text), F.char_length("_main_").cast("long").alias("n_chars"))
