"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

A page's elements are nodes with features: tag group, tokens of class, id and role, depth, place and share among
siblings, text of the subtree, its density of links and tags, commas and stops. Inline elements (links, emphasis, spans)
are no nodes: their text belongs to the element around them, so no link is cut out of a sentence. Text directly in a
wrapper is a node by itself, with the inline elements in it. Boosted trees give each node the log odds that it belongs to the article. Decoding is hierarchical: a
dropped node drops all below it, and among the consistent choices the one of greatest total likelihood is taken, by
dynamic programming from the leaves up. So a menu inside an article goes and no paragraph of a dropped sidebar stays. If
that leaves no text though the page has an article or main element with text, or one named so, the likeliest choice with text of it is taken.

There are no labels for pages: the trees are boosted, on the driver, on pages made by a fixed rule (`made_page`) in
which the answer is known; their number is a parameter and doesn't depend on any table.

Text is cut into blocks at block-level tags; white space inside a block, a lone one between two elements and line
breaks too, becomes one space; blocks are joined by an empty line. Text below the root itself counts as text of the
page. Null html, or html without text, gives the empty string. Broken markup is tolerated (see `Page`). Repeated rows
give repeated results, an empty table an empty result; only the named columns are read, so others may have any name.
A page takes time and memory in proportion to its length.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .boosting import Trees, boost

NAMED = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[a-z]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag's attributes up to its end, quoted values whole; possessive, so it never steps back.
ATTRIBUTES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Their content is markup that is never part of the text.
HIDING = frozenset("svg math object canvas template noscript".split())
FOREIGN = frozenset(["svg", "math"])
#: Their text is that of the element around them, unless they are hidden.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADED = frozenset("html head base link meta title style script noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: HTML elements that end an svg or math element left open.
BREAKOUT = BLOCK | frozenset("b big br code em embed hr i img nobr ruby s small span strike strong sub sup tt u var".split())
P_SCOPE = frozenset("article aside body blockquote div footer form header html li main nav section table td th ul ol".split())
#: A start tag of the first closes an open one of the second, if no one of the third is open within it.
CLOSES = [("p", "", "p", P_SCOPE), ("li", "li", "li p", frozenset("ul ol menu".split())), ("dt", "dt dd", "dt dd p", frozenset(["dl"])), ("tr", "tr", "tr td th", frozenset(["table"])), ("td", "td th", "td th", frozenset(["tr", "table"])), ("option", "option", "option", frozenset(["select"]))]
RULE_OF = {t: k for k, (_, starts, _, _) in enumerate(CLOSES) for t in starts.split()}
CLOSED = [frozenset(c.split()) for _, _, c, _ in CLOSES]
WATCHED = {t: tuple(k for k, (_, _, _, scope) in enumerate(CLOSES) if t in CLOSED[k] or t in scope) for t in {t for k, (_, _, _, scope) in enumerate(CLOSES) for t in scope | CLOSED[k]}}
#: Text directly in these is a node by itself: a wrapper can be kept and the text beside the article in it dropped.
WRAPPERS = frozenset("html body div section main article center td".split())
TEXT = "#text"
GROUPS = ["article main", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "nav menu", "header", "footer", "aside", "form button select label fieldset input dialog", "ul ol dl", "li dd dt", "table tr td th tbody thead", "div section center", "a", "b i em strong span code u small font sub sup mark q cite", TEXT, "figure figcaption"]
GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags.split()}
CUES = ["nav menu navbar breadcrumb breadcrumbs toc pagination pager skip topnav", "header masthead topbar banner hero logo brand", "footer copyright legal colophon bottom imprint", "sidebar side aside related recommended popular trending widget rail more links tags author bio", "ad ads advert advertisement sponsor sponsored promo promotion adsense adslot", "comment comments reply replies respond disqus discussion reader responses feedback thread", "notice cookie cookies consent gdpr alert popup modal overlay subscribe newsletter signup paywall message warning", "share social follow facebook twitter form search login", "article main content post entry story body text articlebody page prose", "hidden"]
CUE = {word: i for i, words in enumerate(CUES) for word in words.split()}
N = len(GROUPS) + 2 * len(CUES) + 20
#: Characters of pages whose nodes are scored together.
TOGETHER = 4_000_000


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    cues: int = 0
    own: int = 0
    stops: int = 0
    linked: int = 0
    tags: int = 1
    hiding: bool = False
    mark: str = ""
    children: list[int] = field(default_factory=list)


class Page:
    """The elements of a page in page order, the root first, and its texts as (node, block number, text).

    Never fails, and takes time in proportion to the page: tags left open, stray end tags, quotes left open, comments
    without an end and a head without an end are all tolerated.
    """

    def __init__(self, page: str, mark: str = ""):
        self.page, self.marked = page, re.compile(mark + r"=\"(\d)\"") if mark else None
        self.nodes, self.texts = [Node("html", -1, 0)], []
        #: tags of the open elements, and the node that text in each belongs to
        self.stack, self.at, self.open = ["html"], [0], Counter()
        self.nearest: list[list[int]] = [[] for _ in CLOSES]
        self.block, self.head, self.unquoted = 0, False, -1
        self.ends: dict[str, int] = {}
        self.loose: dict[int, tuple[int, int]] = {}
        self.parse()

    def text(self, piece: str) -> None:
        if not piece:
            return
        blank = piece.isspace()
        if self.head:
            if blank:
                return
            self.head = False
        at = self.at[-1]
        if not blank and self.nodes[at].tag in WRAPPERS:
            block, node = self.loose.get(at, (-1, 0))
            if block != self.block:
                node = self.add(Node(TEXT, at, len(self.stack)))
                self.loose[at] = self.block, node
            at = node
        if not blank and self.open["a"] > 0:
            self.nodes[at].linked += len(piece)
        self.texts.append((at, self.block, html.unescape(piece) if "&" in piece else piece))

    def add(self, node: Node) -> int:
        self.nodes[node.parent].children.append(len(self.nodes))
        self.nodes.append(node)
        return len(self.nodes) - 1

    def pop_to(self, size: int) -> None:
        """Close elements until so many are open."""
        while len(self.stack) > size:
            tag = self.stack.pop()
            self.at.pop()
            self.open[tag] -= 1
            for k in WATCHED.get(tag, ()):
                self.nearest[k].pop()

    def close(self, tag: str) -> None:
        """Close the innermost open element of that tag and what is open in it; nothing if there is none."""
        if self.open[tag] > 0:
            size = len(self.stack) - 1
            while self.stack[size] != tag:
                size -= 1
            self.pop_to(size)

    def tag_end(self, at: int) -> int:
        """Where the attributes that start here end. A tag with a quote that nothing closes ends at its first >, and so do those after it up to that quote."""
        page, n = self.page, len(self.page)
        if at >= self.unquoted:
            end = ATTRIBUTES.match(page, at).end()
            if end == n or page[end] == ">":
                return end
            self.unquoted = end
        end = page.find(">", at)
        return n if end < 0 else end

    def closes_later(self, tag: str, at: int) -> bool:
        """Whether an end tag of that name comes after this place."""
        if tag not in self.ends:
            self.ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", self.page, re.I)), default=-1)
        return self.ends[tag] >= at

    def parse(self) -> None:
        page, n, at = self.page, len(self.page), 0
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                return
            self.text(page[at:lt])
            kind = page[lt + 1 : lt + 2]
            if kind.isascii() and kind.isalpha():
                at = self.start(lt)
            elif kind == "/":
                at = self.finish(lt)
            elif kind == "!" or kind == "?":
                at = self.aside(lt)
            else:
                self.text("<")
                at = lt + 1

    def aside(self, lt: int) -> int:
        """Comments, declarations and CDATA sections; the latter are text."""
        page, n = self.page, len(self.page)
        if page.startswith("<!--", lt):
            if page.startswith(("<!-->", "<!--->"), lt):
                return page.find(">", lt) + 1
            end = page.find("-->", lt + 4)
            return n if end < 0 else end + 3
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            self.text(page[lt + 9 : n if end < 0 else end].replace("&", "&amp;"))
            return n if end < 0 else end + 3
        end = page.find(">", lt)
        return n if end < 0 else end + 1

    def finish(self, lt: int) -> int:
        page, n = self.page, len(self.page)
        name = NAME.match(page, lt + 2)
        if not name:
            end = page.find(">", lt)
            return n if end < 0 else end + 1
        tag, end = name[0].lower(), self.tag_end(name.end())
        if tag == "head":
            self.head = False
        elif tag == "br":
            self.text(" ")
        else:
            if tag in BLOCK:
                self.block += 1
            self.close(tag)
        return min(n, end + 1)

    def start(self, lt: int) -> int:
        page, n = self.page, len(self.page)
        name = NAME.match(page, lt + 1)
        tag, end = name[0].lower(), self.tag_end(name.end())
        named, at = page[name.end() : end], min(n, end + 1)
        closed = named.endswith("/")
        if tag == "head":
            self.head = True
            return at
        if self.head and tag not in HEADED:
            self.head = False
        if tag == "html":
            return at
        if tag in BREAKOUT and (self.open["svg"] > 0 or self.open["math"] > 0) and not self.open["foreignobject"] > 0:
            size = len(self.stack) - 1
            while self.open["svg"] > 0 or self.open["math"] > 0:
                self.pop_to(size)
                size -= 1
        if tag in RAW:
            if closed and self.open["svg"] > 0:
                return at
            if self.closes_later(tag, at):
                return re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at).start()
            # without an end a script or style takes the rest; of others only the text up to the next tag is theirs
            following = n if tag in ("script", "style") else page.find("<", at)
            return n if following < 0 else following
        if tag in VOID:
            if tag == "hr":
                self.block += 1
            elif tag == "br":
                self.text(" ")
            return at
        if self.head and tag not in HIDING:
            return at
        hiding = tag in HIDING
        if hiding and (closed or tag not in FOREIGN and not self.closes_later(tag, at)):
            return at
        if tag in BLOCK:
            self.block += 1
        k = RULE_OF.get(tag, 0 if tag in BLOCK else -1)
        while k >= 0 and self.nearest[k] and self.stack[self.nearest[k][-1]] in CLOSED[k]:
            self.pop_to(self.nearest[k][-1])
        if tag in INLINE and not (named and HIDDEN.search(named)):
            self.nodes[self.at[-1]].tags += 1
            if not closed:
                self.enter(tag, self.at[-1])
            return at
        node = Node(tag, self.at[-1], len(self.stack), hiding=hiding)
        if named:
            for found in NAMED.finditer(named):
                for word in WORD.findall((found[1] or found[2] or found[3] or "").lower()):
                    if word in CUE:
                        node.cues |= 1 << CUE[word]
            if HIDDEN.search(named):
                node.cues |= 1 << CUE["hidden"]
            if self.marked and (m := self.marked.search(named)):
                node.mark = m[1]
        number = self.add(node)
        if not closed:
            self.enter(tag, number)
        return at

    def enter(self, tag: str, number: int) -> None:
        for rule in WATCHED.get(tag, ()):
            self.nearest[rule].append(len(self.stack))
        self.stack.append(tag)
        self.at.append(number)
        self.open[tag] += 1


def parse(page: str, mark: str = "") -> tuple[list[Node], list[tuple[int, int, str]]]:
    """The elements in page order, the root first, and texts as (node, block number, text); blank texts stay."""
    found = Page(page, mark)
    return found.nodes, found.texts


def features(nodes: list[Node], texts: list[tuple[int, int, str]]) -> np.ndarray:
    """A row of N numbers for each node."""
    for i, _, piece in texts:
        if not piece.isspace():
            nodes[i].own += len(piece)
            nodes[i].stops += piece.count(".") + piece.count(",")
    n = len(nodes)
    x = np.zeros((n, N), np.float32)
    total, tags, links, stops, paras, articles, heads = ([0] * n for _ in range(7))
    for i in range(n - 1, -1, -1):  # children come after their parents
        node = nodes[i]
        total[i] += node.own
        stops[i] += node.stops
        tags[i] += node.tags
        links[i] += node.linked
        paras[i] += node.tag == "p"
        articles[i] += node.tag in ("article", "main")
        heads[i] += node.tag == "h1"
        if node.parent >= 0:
            for a in (total, tags, links, stops, paras, articles, heads):
                a[node.parent] += a[i]
    above = [0] * n  # cues and groups of ancestors, as bits
    rank = [0] * n
    base, c = len(GROUPS), len(CUES)
    whole = max(1, total[0])
    for i, node in enumerate(nodes):
        row = x[i]
        g = GROUP.get(node.tag, -1)
        if g >= 0:
            row[g] = 1
        up = node.parent
        if up >= 0:
            above[i] = above[up] | nodes[up].cues | (1 << 20 + max(0, GROUP.get(nodes[up].tag, 19)))
        bits, over = node.cues, above[i]
        while bits:
            row[base + (bits & -bits).bit_length() - 1] = 1
            bits &= bits - 1
        bits = over & ((1 << c) - 1)
        while bits:
            row[base + c + (bits & -bits).bit_length() - 1] = 1
            bits &= bits - 1
        for k, child in enumerate(node.children):
            rank[child] = k
        t = max(1, total[i])
        kin = len(nodes[up].children) if up >= 0 else 1
        row[base + 2 * c :] = (
            node.depth, rank[i], kin, rank[i] / kin, total[i] / max(1, total[up] if up >= 0 else t), np.log1p(total[i]), np.log1p(node.own), links[i] / t,
            tags[i] / t * 100, stops[i] / t * 100, paras[i], total[i] / whole, over >> 20 & 1, articles[i], over >> 23 & 0b1111, tags[i],
            articles[0], paras[0], heads[i], node.own / t,
        )
    return x


@functools.cache
def made_words(count: int = 5_000) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(count)]


def made_page(rng: random.Random) -> tuple[str, str]:
    """A page by the rule, and the mark of its root. Marks, in data-y: 1 keep the element and its own text, 2 the element alone; none: drop."""
    known = made_words()
    word = lambda: rng.choice(known)

    def words(a: int, b: int) -> str:
        at = rng.randrange(len(known) - b)
        return " ".join(known[at : at + rng.randint(a, b)])

    sentence = lambda: (words(4, 18) + rng.choice([".", ".", ",", "?"])).capitalize()
    some = lambda *x: rng.choice(x)
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"
    para = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    y, wrap = ' data-y="1"', ' data-y="2"'

    def junk(kinds: int = 13) -> str:
        kind = rng.randrange(kinds)
        if kind == 0:
            return some(f"<nav>{menu()}</nav>", f'<div class="{some("nav", "menu", "navbar menu", "breadcrumb")}">{menu()}</div>', f'<ul class="menu">{"".join(f"<li>{link()}" for _ in range(5))}</ul>', f'<div id="nav">{link()} | {link()} | {link()}</div>')
        if kind == 1:
            return some(f"<header>{words(1, 5)} {link()}</header>", f"<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", f'<div class="{some("header", "masthead", "site-header")}"><h2>{words(1, 4)}</h2>{link()}</div>')
        if kind == 2:
            return some(f"<footer>&copy; {words(1, 8)} {para(0, 3)}</footer>", f'<div id="footer"><p>{words(2, 6)}</p>{link()}</div>', f'<footer class="site-footer"><p>{para(1, 2)}</p></footer>')
        if kind == 3:
            return some(f"<aside>{some(menu(), f'<h3>{words(1, 3)}</h3><p>{para(1, 3)}</p>')}</aside>", f'<div class="{some("sidebar", "related", "widget", "popular-posts", "author-bio")}"><h3>{words(1, 3)}</h3>{some(menu(), f"<p>{para(1, 3)}</p>")}</div>')
        if kind == 4:
            return f'<{(t := some("div", "section", "p"))} class="{some("ad", "ads", "advert", "sponsored", "promo ad-slot", "advertisement")}">{para(1, 3)}</{t}>'
        if kind in (5, 6):
            one = lambda: some(f'<div class="comment"><p>{para(1, 3)}</p></div>', f"<li><b>{word()}</b><p>{para(1, 2)}</p></li>", f'<p class="comment">{para(1, 3)}</p>', f"<article><p>{para(1, 2)}</p></article>", f"<div><span>{word()}</span> {para(1, 3)}</div>")
            return f'<{(t := some("div", "section", "ul", "ol"))} {some("id", "class")}="{some("comments", "comment-list", "reader-comments", "discussion", "responses", "replies")}">{some(f"<h3>{words(1, 2)}</h3>", "")}{"".join(one() for _ in range(rng.randint(1, 6)))}</{t}>'
        if kind == 7:
            return f'<div {some("class", "id", "role")}="{some("cookie-notice", "notice", "alert", "newsletter", "subscribe", "popup", "cookie banner", "warning")}">{some(f"<p>{para(1, 2)}</p>", para(1, 2))}{some("", f"<button>{word()}</button>")}</div>'
        if kind == 8:
            return f'<form action="/{word()}"><label>{words(1, 3)}</label><input type="text">{some("", f"<p>{para(1, 2)}</p>")}<button>{word()}</button></form>'
        if kind == 9:
            return f'<div class="{some("share", "social", "follow")}">{link()}{link()}{link()}</div>'
        if kind == 10:
            return some(f"<p hidden>{para(1, 2)}</p>", f'<div style="display:none">{para(1, 2)}</div>', f"<button>{words(1, 2)}</button>", f"<select><option>{word()}<option>{word()}</select>")
        if kind == 11:
            return some(f"<div>{link()} {link()} {link()}</div>", f"<p>{link()}</p>", f"<div><h4>{words(1, 3)}</h4>{menu()}</div>")
        return some(words(1, 4) + " ", f"{words(1, 2)} | ", f"{link()} ", f"<span>{words(1, 3)}</span> ")

    def body_block() -> str:
        kind = rng.randrange(17)
        if kind == 14:  # links that belong to the text
            return some(f"<h{(k := some(2, 3, 4))}{y}>{link()}</h{k}>", f"<p{y}>{link()}</p>", f"<p{y}>{words(1, 6)} {link()}, {words(1, 4)}.</p>", f"<ul{y}>" + "".join(f"<li{y}>{link()}</li>" for _ in range(rng.randint(1, 6))) + "</ul>", f"<ol{y}>" + "".join(f"<li{y}>{words(1, 3)} {link()} {words(0, 3)}.</li>" for _ in range(rng.randint(1, 5))) + "</ol>")
        if kind == 15:
            return some(f"<p{y}><b>{words(1, 2)}</b> <i>{words(1, 2)}</i></p>", f"<p{y}>{link()} {link()} {words(0, 2)}</p>", f"<p{y}><span>{words(1, 3)}</span></p>", f"<p{y}>{word()}.</p>", f"<h3{y}>{word()}</h3>", f"<blockquote{y}><p{y}>{link()}</p></blockquote>", f"<table{y}><tr{y}><td{y}>{link()}</td><td{y}>{word()}</td></tr></table>")
        if kind == 16:
            return f"<dl{y}><dt{y}>{words(1, 2)}</dt><dd{y}>{some(para(1, 1), link())}</dd></dl>"
        if kind < 7:
            inner = para()
            if rng.random() < 0.3:
                inner += f"{some(f' <a href=x>{words(1, 12)}</a>', f' <b>{words(1, 5)}</b>', f' <em>{word()}</em>')} {para(0, 2)}"
            return some(f"<p{y}>{inner}</p>", f"<p{y}>{inner}</p>", f"<p{y}>{inner}", f"<p{y}><b>{inner}<br>")
        if kind == 7:
            return f"<h2{y}>{words(1, 6)}</h2>"
        if kind == 8:
            return f"<ul{y}>" + "".join(f"<li{y}>{para(1, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind == 9:
            return f"<blockquote{y}>{some(para(1, 2), f'<p{y}>{para(1, 2)}</p>')}</blockquote>"
        if kind == 10:
            return f"<table{y}><tr{y}><td{y}>{words(1, 4)}</td><td{y}>{words(1, 4)}</td></tr></table>"
        if kind == 11:
            return f"<figure{y}><img src=x><figcaption{y}>{words(2, 9)}</figcaption></figure>"
        if kind == 12:
            return f"{para(1, 4)}<br><br>{para(1, 3)}{some('', f' <a href=x>{words(1, 2)}</a> ')}"
        return some(f"<div{y}>{para(1, 3)}</div>", f"<p{y}>{words(1, 3)}.</p>", f"<pre{y}>{para(1, 2)}</pre>")

    if rng.random() < 0.06:  # nothing but text
        text = "\n\n".join(para() for _ in range(rng.randint(1, 5)))
        return some((text, "1"), (f"<html><body{y}>{text}</body></html>", "2"), (f"<body{y}>{text} <b>{words(1, 3)}</b> {para()}", "2"))
    parts = []
    if rng.random() < 0.8:
        parts.append(some(f"<h1{y}>{words(2, 9)}</h1>", f"<h1{y}>{words(2, 9)}</h1>", f"<header{y}><h1{y}>{words(2, 9)}</h1></header>"))
    for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8, 12])):
        parts.append(some(f"<p{y}>{words(1, 4)}.</p>", f"<p{y}>{words(1, 2)}.</p>") if rng.random() < 0.15 else body_block())
        if rng.random() < 0.25:
            parts.append(junk(11))  # what has no name and no tag of its own belongs to an article
    inside = "".join(parts)
    before, after = [junk() for _ in range(rng.randint(1, 4))], [junk() for _ in range(rng.randint(1, 4))]
    if rng.random() < 0.1 and "<br><br>" not in inside:  # no element of its own
        return f"<html><body{wrap}>" + "".join(before) + inside + "".join(after) + "</body></html>", "2"
    tag, named = some(("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="post"'), ("section", ' class="article-body"'), ("div", ' class="entry-content"'), ("div", ""), ("article", ' class="post"'))
    article = f"<{tag}{named}{y}>{inside}</{tag}>"
    for _ in range(rng.choice([0, 0, 1, 2])):
        if rng.random() < 0.5:
            article = f"<{(t := some('div', 'main', 'section', 'div class=page', 'div id=wrapper'))}{wrap}>{article if rng.random() < 0.6 else junk() + article}</{t.split()[0]}>"
    if rng.random() < 0.08:
        article = f"<table{wrap}><tr{wrap}><td>{menu()}</td><td{wrap}>{article}</td></tr></table>"
    return f"<html><body{wrap}>" + "".join(before) + article + "".join(after) + "</body></html>", "2"


def labels_of(nodes: list[Node], root: str) -> np.ndarray:
    """What the marks say of each node: whether it is kept."""
    nodes[0].mark = root
    return np.array([float(bool(nodes[n.parent].mark == "1" if n.tag == TEXT else n.mark)) for n in nodes])


@functools.lru_cache(maxsize=2)
def fit(pages: int = 700, seed: int = 11) -> Trees:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, root = made_page(rng)
        nodes, texts = parse(page, "data-y")
        xs.append(features(nodes, texts)[1:])
        ys.append(labels_of(nodes, root)[1:])
    return boost(np.concatenate(xs), np.concatenate(ys), depth=4, rounds=70)


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The consistent choice of greatest likelihood: whether each node is kept; below a dropped one all are."""
    chosen = consistent(nodes, margin)
    if not any(c and n.own for c, n in zip(chosen, nodes)):
        path = likeliest(nodes, margin)
        if path:
            forced = margin.copy()
            forced[path] = 1e9
            chosen = consistent(nodes, forced)
    return chosen


def consistent(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    n = len(nodes)
    keep, lose = [0.0] * n, [0.0] * n
    log1p = np.logaddexp(0, margin).tolist()
    log0 = np.logaddexp(0, -margin).tolist()
    for i in range(n - 1, -1, -1):
        keep[i] -= log0[i]
        lose[i] -= log1p[i]
        up = nodes[i].parent
        if nodes[i].hiding:
            keep[i] = -np.inf
        if up >= 0:
            keep[up] += max(keep[i], lose[i])
            lose[up] += lose[i]
    chosen = [False] * n
    for i, node in enumerate(nodes):
        chosen[i] = i == 0 or (chosen[node.parent] and keep[i] >= lose[i])
    return chosen


def likeliest(nodes: list[Node], margin: np.ndarray) -> list[int]:
    """The nodes from the root down to the one with text, in an article or main element or one named so, that are most likely
    kept together; none without such text. Ties go to the first.
    """
    said = 1 << CUE["article"]
    inside, odds = [False] * len(nodes), [0.0] * len(nodes)
    best, found = -np.inf, -1
    for i, node in enumerate(nodes):
        up = node.parent
        inside[i] = node.tag in ("article", "main") or bool(node.cues & said) or (up >= 0 and inside[up])
        odds[i] = -np.inf if node.hiding else float(margin[i]) + odds[up] if up >= 0 else 0.0
        if inside[i] and node.own and odds[i] > best:
            best, found = odds[i], i
    path = []
    while found >= 0:
        path.append(found)
        found = nodes[found].parent
    return path


def joined(nodes: list[Node], texts: list[tuple[int, int, str]], chosen: list[bool]) -> str:
    blocks: list[list[str]] = []
    last = -1
    for i, block, piece in texts:
        if chosen[i]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(piece)
    return "\n\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def extract_all(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page; the nodes of pages of up to TOGETHER characters are scored together."""
    out: list[str] = []
    first, size = 0, 0
    for k, page in enumerate(pages):
        size += len(page)
        if size < TOGETHER and k + 1 < len(pages):
            continue
        parsed = [parse(p) for p in pages[first : k + 1]]
        xs = [features(*p) for p in parsed]
        margin, at = trees.margin(np.concatenate(xs)), 0
        for (nodes, texts), x in zip(parsed, xs):
            out.append(joined(nodes, texts, decode(nodes, margin[at : at + len(x)])))
            at += len(x)
        first, size = k + 1, 0
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the url, the main text and its code points."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    trees = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = extract_all([h or "" for h in batch.column(2).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
