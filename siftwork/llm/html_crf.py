"""Main text of web pages by a tree-structured model of the DOM.

Every block element is a node with a state, content or not. A node has a potential from its tag,
attributes and own text, an edge one from the states of parent and child and the child's kind.
Sum-product messages upward and downward give exact marginals; weights are fitted by the gradient
of the likelihood on labelled pages, which labelled_pages() makes from a grammar of layouts.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common

#: Kinds of tags that share weights.
KINDS = {
    "root": "html", "head": "head title meta link base", "body": "body", "article": "article", "main": "main",
    "section": "section", "div": "div center", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu",
    "item": "li dt dd", "table": "table tbody thead tfoot tr caption", "cell": "td th", "quote": "blockquote pre figure figcaption details summary",
    "nav": "nav", "header": "header", "footer": "footer address", "aside": "aside", "form": "form fieldset legend label", "control": "button select option datalist input textarea",
    "dialog": "dialog", "lead": "header-in-article",
}
KIND_OF = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
LEAD, PARAGRAPH = KIND_OF["header-in-article"], KIND_OF["p"]
_ARTICLES = {KIND_OF["article"], KIND_OF["main"]}
#: Words in class, id and role, by what they say.
HINTS = [
    r"\b(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner)\b",
    r"\b(?:nav\w*|menu\w*|breadcrumbs?|crumbs|toc|tabs?|pagination|pager|skip)\b",
    r"\b(?:comments?|commentlist|replies|reply|respond|disqus|discussion|responses)\b",
    r"\b(?:cookies?|consent|notice|alert|gdpr|popup|modal|overlay|dialog|warning|announcement)\b",
    r"\b(?:foot\w*|copyright|colophon|legal|bottom|contentinfo)\b",
    r"\b(?:head|header|masthead|logo|topbar|top|branding|site-header|banner)\b",
    r"\b(?:side\w*|aside|widgets?|related|recommend\w*|complementary|rail|more|popular|trending)\b",
    r"\b(?:share|sharing|social|follow|newsletter|subscribe|signup|login|search\w*|form|tags|meta|byline|author)\b",
    r"\b(?:hidden|sr-only|visually-hidden|d-none)\b",
    r"\b(?:article\w*|content|post|entry|story|main|text|page-content|post-content|entry-content|prose|copy|articlebody)\b",
    r"\b(?:content|article|post|entry|story|text)[-_ ](?:foot|head)\w*\b",
]
_HINTS = [re.compile(x) for x in HINTS]
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
#: Elements without an end tag, and those whose content is not text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas audio video title textarea".split())
#: Tags whose start closes an open element of these tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS = frozenset({"br", "hr"})
_FEATURES_TEXT = 5
N_FEATURES = len(KINDS) + 1 + len(HINTS) + _FEATURES_TEXT + 4 + 1 + 4
#: Bits of the hints with a use of their own: what comments, hides, or names the content.
COMMENTS, HIDDEN, CONTENT, EDGE = 2, 8, 9, 10
#: Hints of page footers and headers, which the head or foot of a content is not.
_PAGE_EDGES = 1 << 4 | 1 << 5 | 1 << CONTENT
_GOLD = re.compile(r'data-gold="([01])"')
_MARKS = re.compile(r"©|\bcookies\b|\bsign up\b|\blog ?in\b|\bnewsletter\b", re.I)


class Page:
    """Nodes of one page: parent, kind, hints; blocks of text with the node that each belongs to.

    Only block elements are nodes. Inline ones, whatever their class, are text of the block around
    them, but for hidden ones, which are no text.
    """

    __slots__ = ("parent", "kind", "hints", "chars", "linked", "marks", "blocks", "gold", "depth", "within")

    def __init__(self, source: str):
        self.parent, self.kind, self.hints, self.chars, self.linked, self.marks, self.gold, self.depth, self.within = [-1], [0], [0], [0], [0], [0], [-1], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _node(self, parent: int, kind: int, hints: int, gold: int) -> int:
        for field, value in zip((self.parent, self.kind, self.hints, self.chars, self.linked, self.marks, self.gold, self.depth), (parent, kind, hints, 0, 0, 0, gold, self.depth[parent] + 1), strict=True):
            field.append(value)
        # Whether an element above is an article, or is named as the content.
        self.within.append(int(self.within[parent] or self.kind[parent] in _ARTICLES or self.hints[parent] >> CONTENT & 1))
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, node, hidden inline, comments
        parts: list[str] = []
        state = [0, 0, 0, 0]  # node of the open block; links, hidden inline elements and comments open
        many: dict[str, int] = {}  # open elements by tag
        unending: set[str] = set()  # tags of which no end follows
        last = source.rfind(">")  # what begins after it is no tag

        def cut(k: int) -> None:
            for tag, _, hidden, comments in stack[k:]:
                many[tag] -= 1
                state[1] -= tag == "a"
                state[2] -= hidden
                state[3] -= comments
            del stack[k:]

        def close() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    node = state[0]
                    self.blocks.append((node, text))
                    self.chars[node] += len(text)
                    if len(text) < 400 and _MARKS.search(text):
                        self.marks[node] = 1

        def add(raw: str) -> None:
            if not raw or state[2]:
                return
            if stack[-1][1] != state[0]:
                close()
                state[0] = stack[-1][1]
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state[1]:
                self.linked[state[0]] += len(text)

        at, size = 0, len(source)
        while at < size:
            m = _TAG.search(source, at) if at <= last or "<!--" in source[at:] else None
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag, ends, attrs = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if ends:
                for k in range(len(stack) - 1, 0, -1) if many.get(tag) else ():
                    if stack[k][0] == tag:
                        if stack[k][1] != stack[k - 1][1] or tag in KIND_OF:
                            close()
                        cut(k)
                        break
                continue
            if tag in RAW:
                ends_itself = attrs.endswith("/") and tag not in ("script", "style", "title", "textarea")
                end = None if ends_itself or tag in unending else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at, last + 1)
                if end:
                    at = end.end()
                elif not ends_itself:
                    unending.add(tag)
                elif tag in ("script", "style", "title", "textarea"):
                    at = size
                if tag in ("textarea", "title", "iframe", "object"):
                    close()
                continue
            if tag in BREAKS:
                close()
                continue
            if tag in VOID:
                continue
            block = tag in KIND_OF
            if block:
                close()
                wanted = CLOSES.get(tag) or ({"p"} if tag != "label" and stack[-1][0] != "button" else set())
                for k in range(len(stack) - 1, 0, -1) if any(many.get(t) for t in wanted) else ():
                    if stack[k][0] in wanted:
                        cut(k)
                        break
                    if stack[k][0] in ("div", "td", "th", "table", "ul", "ol", "section", "article", "body", "button", "blockquote", "li") and stack[k][0] not in wanted:
                        break
            hints, gold = 0, -1
            if attrs.strip():
                words = []
                for name, value in _ATTR.findall(attrs):
                    name, value = name.lower(), value.strip("\"'").lower()
                    if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                        hints |= 1 << HIDDEN
                    elif name in ("class", "id", "role"):
                        words.append(value)
                if words:
                    said = " ".join(words)
                    said += " " + re.sub(r"[-_]", " ", said)
                    for b, pattern in enumerate(_HINTS):
                        if pattern.search(said):
                            hints |= 1 << b
                    if hints >> EDGE & 1:
                        hints &= ~_PAGE_EDGES
                if "data-gold" in attrs and (mark := _GOLD.search(attrs)):
                    gold = int(mark[1])
            node = stack[-1][1]
            if block:
                kind = LEAD if tag == "header" and many.get("article") and not state[3] else KIND_OF[tag]
                node = self._node(node, kind, hints, gold)
            if not attrs.endswith("/"):
                hidden, comments = not block and bool(hints >> HIDDEN & 1), bool(hints >> COMMENTS & 1)
                stack.append((tag, node, hidden, comments))
                many[tag] = many.get(tag, 0) + 1
                state[1] += tag == "a"
                state[2] += hidden
                state[3] += comments
        close()


def encode(pages: list[Page]) -> dict[str, np.ndarray]:
    """Nodes of all pages end to end: parents, kinds, depths and feature rows."""
    start = np.cumsum([0] + [len(p.parent) for p in pages])
    cat = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    parent = cat("parent")
    offset = np.repeat(start[:-1], np.diff(start))
    parent = np.where(parent >= 0, parent + offset, -1)
    kind, hints, chars, linked, marks = cat("kind"), cat("hints"), cat("chars"), cat("linked"), cat("marks")
    x = np.zeros((len(parent), N_FEATURES), np.float32)
    rows = np.arange(len(parent))
    x[rows, kind] = 1
    at = len(KINDS) + 1
    for b in range(len(HINTS)):
        x[:, at + b] = hints >> b & 1
    at += len(HINTS)
    x[rows, at + np.searchsorted([1, 20, 80, 200], chars, side="right")] = 1
    at += _FEATURES_TEXT
    share = linked / np.maximum(chars, 1)
    # Prose beside a node: plain text of paragraphs with the same parent. Links there are part of it.
    prose = np.where((kind == PARAGRAPH) & (share < 0.5), chars, 0)
    beside = np.zeros(len(parent))
    child = parent >= 0
    np.add.at(beside, parent[child], prose[child])
    beside = np.where(child, beside[parent] - prose, 0)
    x[rows, at + np.where(chars == 0, 0, np.where(share < 0.5, 1, np.where(beside < 200, 2, 3)))] = 1
    x[:, at + 4] = marks
    at += 5
    x[rows, at + np.searchsorted([1, 200], beside, side="right")] = 1
    x[:, at + 3] = cat("within")
    return {"parent": parent, "kind": kind, "depth": cat("depth"), "x": x, "start": start, "gold": cat("gold")}


def _lse(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1)
    return top + np.log(np.exp(a - top[..., None]).sum(axis=-1))


def marginals(nodes: dict[str, np.ndarray], weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(content) of each node, joint P(parent, child) of each edge, log of the partition function.

    Upward, level by level from the leaves, then downward from the roots; edges: [kind, parent, child].
    """
    parent, depth, kind = nodes["parent"], nodes["depth"], nodes["kind"]
    below = np.zeros((len(parent), 2))
    below[:, 1] = nodes["x"] @ weights
    up = np.zeros((len(parent), 2))
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 1)))
    for level in levels[:0:-1]:
        up[level] = _lse(edges[kind[level]] + below[level][:, None, :])
        np.add.at(below, parent[level], up[level])
    belief = below.copy()
    joint = np.zeros((len(parent), 2, 2))
    for level in levels[1:]:
        above = belief[parent[level]] - up[level]
        both = edges[kind[level]] + above[:, :, None] + below[level][:, None, :]
        belief[level] = _lse(np.swapaxes(both, 1, 2))
        flat = both.reshape(-1, 4)
        joint[level] = np.exp(both - _lse(flat)[:, None, None])
    roots = levels[0]
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint, float(_lse(belief[roots]).sum())


def fit(pages: list[Page], steps: int = 220, rate: float = 0.2, decay: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights by Adam on the exact gradient of the log-likelihood."""
    nodes = encode(pages)
    gold, parent, kind = nodes["gold"].copy(), nodes["parent"], nodes["kind"]
    gold[nodes["start"][:-1]] = 1
    for level in range(1, int(nodes["depth"].max()) + 1):  # a node without a label takes its parent's
        at = np.flatnonzero((nodes["depth"] == level) & (gold < 0))
        gold[at] = gold[parent[at]]
    weights, edges = np.zeros(N_FEATURES), np.zeros((len(KINDS) + 1, 2, 2))
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros_like(edges)
    np.add.at(seen, (kind[child], gold[parent[child]], gold[child]), 1)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(edges), np.zeros_like(edges)]
    n = len(pages)
    for t in range(1, steps + 1):
        p, joint, _ = marginals(nodes, weights, edges)
        slope_w = nodes["x"].T @ (gold - p) / n - decay * weights
        expected = np.zeros_like(edges)
        np.add.at(expected, kind[child], joint[child])
        slope_e = (seen - expected) / n - decay * edges
        for k, (value, slope) in enumerate(((weights, slope_w), (edges, slope_e))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights, edges


def labelled_pages(count: int = 600, seed: int = 11) -> list[str]:
    """Pages from a grammar of layouts; data-gold="1" marks content, "0" what is not.

    Nodes without a mark go with their parent, and the root with the content: it holds it.
    """
    r = random.Random(seed)
    syllables = "ba de ki lo mu ra se ti no pa ve zu an er in os".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(1, 16).capitalize() + r.choice("...!?") for _ in range(r.randint(low, high)))

    def tag(name: str, body: str, gold: str = "", **attrs: str) -> str:
        said = "".join(f' {"class" if k == "cls" else k}="{v}"' for k, v in attrs.items() if v)
        return f"<{name}{said}{f' data-gold={chr(34)}{gold}{chr(34)}' if gold else ''}>{body}</{name}>"

    def links(n: int, low: int = 1, high: int = 2) -> str:
        return "".join(tag("li", tag("a", words(low, high), href="/x")) for _ in range(n))

    def paragraph() -> str:
        body = sentences(1, 1) if r.random() < 0.3 else sentences(1, 9)
        if r.random() < 0.2:
            body += " " + tag("a", words(1, 4), href="/y") + " " + words(1, 8) + "."
        if r.random() < 0.15:
            body = "<b>" + body + r.choice(["</b>", "<br>", ""]) + sentences(1, 2)
        return body

    def comment(gold: str = "", *classes: str) -> str:
        by = r.choice(["", "", tag("header", r.choice([words(1, 2), tag("h4", words(1, 2))])), tag("h4", words(1, 2)), tag("footer", words(1, 3)), tag("p", tag("a", words(1, 2), href="/u"))])
        return tag(r.choice(["div", "li", "article"]), by + tag("p", sentences(1, 5)), gold, cls=r.choice(classes or ["comment", "reply", "", "comment-body"]))

    def article() -> str:
        out = [tag(r.choice(["h1", "h1", "h2"]), words(2, 12))] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14) if r.random() < 0.7 else 1):
            x = r.random() if r.random() < 0.9 else 0.0
            if x < 0.62:
                out.append("<p>" + paragraph() + r.choice(["</p>", "</p>", ""]))
            elif x < 0.7:
                out.append(tag(r.choice(["h2", "h3"]), words(1, 7)))
            elif x < 0.75:
                out.append(tag(r.choice(["ul", "ol"]), "".join(tag("li", words(1, 20)) for _ in range(r.randint(2, 5)))))
            elif x < 0.79:
                out.append(tag("blockquote", tag("p", sentences(1, 3))))
            elif x < 0.81:
                out.append(tag("pre", words(3, 20)))
            elif x < 0.84:
                out.append(tag("table", "".join(tag("tr", "".join(tag("td", words(1, 4)) for _ in range(3))) for _ in range(3))))
            elif x < 0.87:
                out.append(tag("div", r.choice([paragraph(), tag("p", paragraph())]), cls=r.choice(["", "content-footer", "content-header", "article-footer", "note", "more", "text-block"])))
            elif x < 0.97:  # links that are part of the text, and forms that are not
                y = r.randrange(7)
                if y == 0:
                    out.append(tag("p", words(1, 4) + " " + tag("a", words(1, 4), href="/w") + ".", cls=r.choice(["", "", "more"])))
                elif y == 1:
                    out.append(tag("p", tag("a", words(1, 9), href="/w"), cls=r.choice(["", "", "more"])))
                elif y == 2:
                    out.append(tag(r.choice(["ul", "ol"]), links(r.randint(2, 6), 1, 6)))
                elif y == 3:
                    out.append(tag("button", words(1, 3), "0"))
                elif y == 4:
                    out.append("<p>" + sentences(1, 3) + " " + tag("button", words(1, 2), "0") + " " + sentences(1, 2) + "</p>")
                elif y == 5:
                    out.append(tag("form", tag("label", words(1, 3)) + tag(r.choice(["button", "select", "textarea"]), words(1, 2)), "0"))
                else:
                    out.append(tag("p", sentences(1, 1), cls=r.choice(["more", "first", "byline-text", "top"])))
            else:
                out.append(tag(r.choice(["div", "aside", "p"]), sentences(1, 2), "0", cls=r.choice(["ad", "ads", "advert", "sponsored", "promo", "related", "newsletter-signup", "share"])))
        if r.random() < 0.25:
            out.insert(r.randint(0, len(out)), tag(r.choice(["button", "button", "select", "textarea"]), words(1, 3), "0"))
        if r.random() < 0.12:
            out.insert(r.randint(1, len(out)) if out else 0, comment("0", "comment", "reply", "reader-comment"))
        body = "".join(out)
        if r.random() < 0.15:
            body = tag("section", body)
        if r.random() < 0.12:
            body += tag(r.choice(["div", "footer"]), tag("ul", links(r.randint(1, 4))) if r.random() < 0.5 else "".join(tag("a", words(1, 2), href="/t") + " " for _ in range(3)), "0", cls=r.choice(["entry-footer", "post-footer", "article-footer", "tags"]))
        if r.random() < 0.15:
            body = tag("header", tag("h1", words(2, 12)) + (tag("p", words(2, 14)) if r.random() < 0.4 else "")) + body
        return body

    def noise() -> str:
        x = r.randrange(13)
        if x == 0:
            return tag("nav", tag("ul", links(r.randint(2, 8))), "0")
        if x == 1:
            return tag("header", tag(r.choice(["h1", "div", "p", "a"]), words(1, 6)) + (tag("p", words(2, 9)) if r.random() < 0.5 else ""), "0")
        if x == 2:
            return tag("aside", tag("h3", words(1, 3)) + (tag("ul", links(4, 2, 8)) if r.random() < 0.5 else tag("p", sentences(1, 5))), "0")
        if x == 3:
            return tag(r.choice(["div", "section", "p"]), r.choice([sentences(1, 3), tag("p", sentences(1, 3))]), "0", cls=r.choice(["ad", "ads", "advert", "advertisement", "ad-slot", "sponsor", "promo", "banner"]))
        if x == 4:
            return tag(r.choice(["div", "section", "ol"]), (tag("h2", words(1, 3)) if r.random() < 0.5 else "") + "".join(comment() for _ in range(r.randint(1, 5))), "0", **{r.choice(["cls", "id"]): r.choice(["comments", "comment-list", "commentlist", "responses", "disqus_thread", "discussion", "reader-comments"])})
        if x == 5:
            return tag(r.choice(["div", "section", "p"]), sentences(1, 3) + tag("button", word()), "0", **{r.choice(["cls", "id"]): r.choice(["cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup", "modal"])})
        if x == 6:
            return tag("form", tag("label", words(1, 3)) + "<input type=text>" + tag("button", word()) + (tag("p", sentences(1, 2)) if r.random() < 0.4 else ""), "0")
        if x == 7:
            return tag(r.choice(["div", "section"]), tag("h3", words(1, 3)) + r.choice([tag("ul", links(5, 2, 9)), tag("p", sentences(1, 4))]), "0", **{r.choice(["cls", "id"]): r.choice(["sidebar", "widget", "related", "side-bar", "recommended", "right-rail", "popular", "side"])})
        if x == 8:
            return tag("div", r.choice([tag("ul", links(6)), "".join(tag("a", words(1, 2), href="/z") + " " for _ in range(5))]), "0", **{r.choice(["cls", "id"]): r.choice(["nav", "menu", "navbar", "main-menu", "breadcrumb", "topnav", "pagination"])})
        if x == 9:
            return tag("ul", links(r.randint(3, 9)), "0")
        if x == 10:
            return tag("div", words(1, 9), "0", **{r.choice(["cls", "id"]): r.choice(["header", "masthead", "site-header", "logo", "topbar"])})
        if x == 11:
            return tag("div", "© " + words(1, 4) + r.choice(["", " All rights reserved"]), "0", **{r.choice(["cls", "id"]): r.choice(["footer", "site-footer", "copyright", "legal"])})
        return tag("p", tag("a", words(1, 5), href="/q"), "0")

    def footer() -> str:
        return tag("footer", r.choice(["&copy; " + words(1, 4), tag("p", sentences(1, 3)), tag("ul", links(4)), words(2, 8)]), "0")

    out = []
    for _ in range(count):
        name, attrs = r.choice([("article", {}), ("article", {}), ("main", {}), ("div", {"cls": "content"}), ("div", {"id": "content"}), ("div", {"cls": "post"}), ("div", {"cls": "entry-content"}), ("div", {"cls": "article-body"}), ("section", {"cls": "story"}), ("td", {"cls": "text"}), ("div", {}), ("div", {"role": "main"})])
        core = tag(name, article(), "1", **attrs)
        if name != "article":  # a header stands for the page there
            core = re.sub(r"<header>(.*?)</header>", r"\1", core)
        if name == "td":
            core = tag("table", tag("tr", (tag("td", tag("ul", links(4)), "0") if r.random() < 0.6 else "") + core))
        if r.random() < 0.3:
            core = tag(r.choice(["main", "div"]), (noise() if r.random() < 0.3 else "") + core + (noise() if r.random() < 0.4 else ""), "1", cls=r.choice(["", "wrapper", "container", "page", "layout"]))
        before = "".join(noise() for _ in range(r.randint(0, 4)))
        after = "".join(noise() for _ in range(r.randint(0, 4)))
        if r.random() < 0.08:  # a fragment
            out.append(before + core + after)
            continue
        if r.random() < 0.03:  # text without markup
            out.append(sentences(1, 5))
            continue
        head = tag("head", "<meta charset=utf-8>" + tag("title", words(2, 9)) + "<script>var a = '<p>';</script>", "0")
        end = r.choice(["</body></html>", "</body></html>", ""])
        out.append(f"<!DOCTYPE html><html>{head}<body>{before}<!-- x -->{core}{after}{footer() if r.random() < 0.9 else ''}{end}")
    return out


@functools.lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """Weights trained on labelled_pages(): a few hundred numbers, the same in every session."""
    return fit([Page(x) for x in labelled_pages()])


def extract(sources: list[str], weights: np.ndarray, edges: np.ndarray) -> list[str]:
    """The main text of each page: its content blocks in page order, joined by one space."""
    pages = [Page(x) for x in sources]
    if not pages:
        return []
    nodes = encode(pages)
    content = marginals(nodes, weights, edges)[0] > 0.5
    out = []
    for page, start in zip(pages, nodes["start"][:-1].tolist(), strict=True):
        out.append(" ".join([text for node, text in page.blocks if content[start + node]]))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; null or empty html gives an empty text.

    A page is taken whole and by itself, so repeated rows and empty tables need no rule. A page in
    which no node is likelier content than not has no text.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    weights, edges = model()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_html"):
                text = extract(common.texts_of(part.column(2)), weights, edges)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("_html"))
    return common.arrow_map(rows, kernel, "page_id long, url string, text string, n_chars long")
