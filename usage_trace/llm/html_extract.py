"""Main text of web pages, by a tree-structured graphical model over the DOM.

Nodes are the block-level elements of a page and its runs of text; each is content or not. A node has a
potential of its own features and one with its parent, and sum-product messages, from the leaves up and from
the root down, give each node's marginal. Runs of text with a marginal of a half or more are the main text.
Both kinds of weights are fitted by gradient ascent on the likelihood of labelled pages, which `labelled_pages`
writes: articles in many layouts among menus, notices, adverts, forms, side bars, footers and reader comments.

Pages are read one at a time, whole, in time proportional to their length, whatever is left open or unclosed in
them; nothing is shuffled. What a browser never shows as text (scripts, styles, controls of forms, embedded media)
is passed over by the parser; all else, hidden and noscript elements too, is the model's to decide.

Edge cases: a null, empty or textless page gives an empty text; broken markup is read as far as it goes
(open elements end with the page, a tag that is cut off is dropped with what follows it); an attribute data-label
counts on training pages alone; repeated rows each give a row; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by the way they are laid out.
BLOCKS = frozenset("html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary dialog center hr menu hgroup search noscript".split())
UNSEEN = frozenset("script style template head iframe object svg canvas audio video select button textarea option datalist title".split())
RAW = frozenset("script style textarea title iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"caption", "thead", "tbody", "tfoot", "tr", "td", "th", "html", "body", "li", "dt", "dd"} | {"li", "dt", "dd"}
#: An element that ends open ones of the second list, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Words in class, id and role that speak for or against content.
CUES = {
    "for": {"article", "content", "main", "post", "entry", "story", "body", "text", "prose", "page"},
    "menu": {"nav", "navigation", "menu", "navbar", "breadcrumb", "breadcrumbs", "tabs", "pagination", "pager", "toc", "links"},
    "edge": {"header", "masthead", "banner", "footer", "foot", "copyright", "legal", "top", "bottom", "colophon", "contentinfo", "logo"},
    "side": {"sidebar", "side", "aside", "widget", "related", "recommended", "popular", "more", "trending", "complementary", "rail", "tags", "author", "byline", "meta"},
    "ad": {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "promoted"},
    "notice": {"cookie", "cookies", "consent", "notice", "popup", "modal", "alert", "gdpr", "newsletter", "subscribe", "signup", "overlay", "paywall"},
    "share": {"share", "social", "sharing", "follow", "toolbar", "buttons", "print", "skip", "hidden"},
    "talk": {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "commentlist", "review", "reviews"},
    "form": {"form", "search", "login", "contact", "input", "searchbox"},
}
_CUE = {word: name for name, words in CUES.items() for word in words}
#: Words of short runs of text that speak for a kind of notice.
SAYS = {
    "notice": "cookie cookies consent javascript browser newsletter subscribe".split(),
    "legal": "copyright rights reserved terms privacy policy imprint ©".split(),
    "ad": "advertisement sponsored promoted".split(),
    "share": "share tweet facebook".split(),
    "talk": "reply replies comments".split(),
}
_SAYS = {word: name for name, words in SAYS.items() for word in words}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What a tag's end is looked for by: the end itself, or a quoted value, in which it doesn't count.
_END = re.compile(r"""[>]|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSING = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
_HEADING = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: End tags that reach beyond the cell or table that they stand in.
_WIDE = frozenset({"table", "tr", "tbody", "thead", "tfoot", "body", "html"})
_WALLS = frozenset({"td", "th", "table"})


class Node:
    __slots__ = ("tag", "parent", "cues", "text", "words", "linked", "inside", "label")

    def __init__(self, tag: str, parent: int, cues: tuple[str, ...] = (), label: int | None = None):
        self.tag, self.parent, self.cues, self.label = tag, parent, cues, label
        self.text, self.words, self.linked, self.inside = "", 0, 0, 0


def _cues(attributes: str, labelled: bool) -> tuple[tuple[str, ...], int | None]:
    """Cues of class, id and role, and whether the element is hidden; its label, if it is on a labelled page."""
    found, label = set(), None
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            found |= {_CUE[w] for w in map(str.lower, _PARTS.findall(value)) if w in _CUE}
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add("unseen")
        elif labelled and name == "data-label":
            label = int(value)
    return tuple(sorted(found)), label


def _tag_end(html: str, at: int) -> int:
    """Where the tag that is open at a position ends (the place of its ">"); -1 if it is cut off."""
    while m := _END.search(html, at):
        if not m[1]:
            return m.start()
        at = html.find(m[1], m.end()) + 1
        if not at:
            break
    return -1


class _Open:
    """The open elements, with what is needed to look one up without passing all others."""

    def __init__(self):
        self.tags, self.nodes, self.unseen = ["#root"], [0], [False]
        self.blocks: list[int] = []  # places of blocks and buttons
        self.number: Counter = Counter()
        self.walls: list[Counter] = [Counter()]  # elements open within each wall

    def push(self, tag: str, node: int, unseen: bool) -> None:
        if tag in BLOCKS or tag == "button":
            self.blocks.append(len(self.tags))
        self.number[tag] += 1
        if tag in _WALLS:
            self.walls.append(Counter())
        self.walls[-1][tag] += 1  # a wall is counted within itself: it can be closed from there
        self.tags.append(tag)
        self.nodes.append(node)
        self.unseen.append(unseen)

    def pop(self) -> str:
        tag = self.tags.pop()
        self.nodes.pop()
        self.unseen.pop()
        if self.blocks and self.blocks[-1] == len(self.tags):
            self.blocks.pop()
        self.number[tag] -= 1
        self.walls[-1][tag] -= 1
        if tag in _WALLS:
            self.walls.pop()
        return tag

    def place(self, tag: str) -> int:
        """Of the innermost open element that an end tag ends; 0 if there is none. Costs as much as ending it does."""
        if not (self.number if tag in _WIDE else self.walls[-1])[tag]:
            return 0
        return next(k for k in range(len(self.tags) - 1, 0, -1) if self.tags[k] == tag)


def parse(html: str, labelled: bool = False) -> list[Node]:
    """Blocks and runs of text ("#text") of a page, parents before children. Each character is passed a bounded number of times."""
    nodes = [Node("#root", -1)]
    open_ = _Open()
    run: list[str] = []
    links, linked = 0, 0

    def end_run():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                node = Node("#text", open_.nodes[-1])
                node.text, node.words, node.linked = text, text.count(" ") + 1, min(linked, text.count(" ") + 1)
                nodes.append(node)
            linked = 0

    def say(data: str):
        nonlocal linked
        if data and not open_.unseen[-1]:
            data = unescape(data) if "&" in data else data
            run.append(data)
            if links:
                linked += len(data.split())

    def close(to: int):
        nonlocal links
        if to:
            if any(t in BLOCKS for t in open_.tags[to:]):
                end_run()
            while len(open_.tags) > to:
                links -= open_.pop() == "a"

    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            say(html[at:])
            break
        if html.startswith("<!--", start):
            say(html[at:start])
            at = html.find("-->", start + 4) + 3
            if at < 3:
                break
            continue
        ends = html.startswith("/", start + 1)
        m = _NAME.match(html, start + 1 + ends)
        if not m:
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                say(html[at:start])
                at = html.find(">", start + 1) + 1
                if not at:
                    break
            else:
                say(html[at : start + 1])
                at = start + 1
            continue
        say(html[at:start])
        end = _tag_end(html, m.end())
        if end < 0:
            break
        tag, attributes, at = m[0].lower(), html[m.end() : end], end + 1
        if ends:
            close(open_.place(tag))
            continue
        if tag in ("html", "body"):
            if open_.number[tag]:
                continue
            while open_.tags[-1] == "head":
                close(len(open_.tags) - 1)
        if tag in BLOCKS:
            if open_.tags[-1] == "head":
                close(len(open_.tags) - 1)
            closing, upto = CLOSES.get(tag, (frozenset(), frozenset()))
            if tag in ENDS_P:
                closing = closing | {"p"}
                upto = upto | {"td", "th", "table", "caption", "button"}
            if tag in _HEADING and open_.tags[-1] in _HEADING:
                close(len(open_.tags) - 1)
            cut = 0
            for k in reversed(open_.blocks):
                own = open_.tags[k]
                if own in closing:
                    cut = k
                if own in upto or own in BLOCKS and own not in closing:
                    break
            close(cut)
        if tag == "a" and links:
            close(open_.place(tag))
        parent, unseen = open_.nodes[-1], open_.unseen[-1]
        if tag in BLOCKS:
            end_run()
            if not unseen:
                nodes.append(Node(tag, parent, *(_cues(attributes, labelled) if attributes else ())))
                parent = len(nodes) - 1
        elif tag in ("br", "img", "input"):
            say(" ")
        if tag in RAW:
            m = _CLOSING[tag].search(html, at)
            if tag in UNSEEN:
                at = html.find(">", m.start()) + 1 if m else 0
                if not at:
                    break
                continue
        if tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
            links += tag == "a"
            open_.push(tag, parent, unseen or tag in UNSEEN)
    close(1)
    end_run()
    return nodes


def describe(nodes: list[Node]) -> list[list[str]]:
    """Names of each node's features."""
    words, linked, stops = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.tag == "#text":
            words[i], linked[i], stops[i] = n.words, n.linked, n.text.count(". ") + n.text.endswith((".", "!", "?", "。"))
        if n.parent >= 0:
            for x in (words, linked, stops):
                x[n.parent] += x[i]
    above: list[frozenset] = []
    out = []
    for i, n in enumerate(nodes):
        mark = {n.tag} & {"article", "main", "nav", "aside", "footer", "header", "form"} | {f".{c}" for c in n.cues}
        own = above[n.parent] if n.parent >= 0 else frozenset()
        above.append(own | mark)
        size = min(6, int(math.log2(words[i] + 1)))
        share = "no" if not linked[i] else "all" if linked[i] >= 0.9 * words[i] else "some"
        f = ["1", f"words {size}", f"linked {share}", "stops" if stops[i] else "no stop"]
        if n.tag == "#text":
            f += [f"in {nodes[n.parent].tag}"] + (["long, unlinked"] if size >= 4 and share == "no" else [])
            if size < 5:
                f += [f"says {x}" for x in sorted({_SAYS[w] for w in n.text.lower().replace(".", " ").replace(",", " ").split() if w in _SAYS})]
        else:
            f += [f"<{n.tag}>"]
        f += [f"{'text' if n.tag == '#text' else 'block'} under {x}" for x in above[i]]
        out.append(f)
    return out


def marginals(nodes: list[Node], own: list[float], pair: dict[str, list[float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(content) of each node, and the joint distribution of (parent, node) for each; by sum-product.

    own: log-odds of each node by itself. pair: log-potentials of (parent, child) states 00, 01, 10, 11 by kind.
    """
    n = len(nodes)
    exp, log = math.exp, math.log
    kinds = [pair["text" if x.tag == "#text" else "block"] for x in nodes]
    up = list(own)  # log-odds of a node from its own potential and its children's messages
    message = [0.0] * n  # to the parent, as log-odds
    for i in range(n - 1, 0, -1):
        p00, p01, p10, p11 = kinds[i]
        u = up[i] if up[i] < 60 else 60.0
        message[i] = log(exp(p10) + exp(p11 + u)) - log(exp(p00) + exp(p01 + u))
        up[nodes[i].parent] += message[i]
    full = list(up)
    joint = [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(1, n):
        p00, p01, p10, p11 = kinds[i]
        parent = full[nodes[i].parent] - message[i]
        a, u = min(60.0, max(-60.0, parent)), min(60.0, max(-60.0, up[i]))
        w = (exp(p00), exp(p01 + u), exp(a + p10), exp(a + p11 + u))
        z = sum(w)
        joint[i] = tuple(x / z for x in w)
        full[i] = log(w[1] + w[3]) - log(w[0] + w[2])
    return [1 / (1 + exp(-min(60.0, max(-60.0, x)))) for x in full], joint


class Model:
    def __init__(self, pages: list[str], steps: int = 60, rate: float = 2.0, l2: float = 2e-3):
        """pages: with data-label="1" on elements of content and "0" on others; a node takes the label of the nearest."""
        self.weights: dict[str, float] = {}
        self.pair = {"text": [0.0] * 4, "block": [0.0] * 4}
        made = []
        for html in pages:
            nodes = parse(html, labelled=True)
            labels = []
            for x in nodes:
                labels.append(x.label if x.label is not None else labels[x.parent] if x.parent >= 0 else 0)
            made.append((nodes, describe(nodes), labels))
        total = sum(len(x[0]) for x in made)
        speed: dict[str, float] = {}
        for _ in range(steps):
            gradient: dict[str, float] = {}
            pairs = {k: [0.0] * 4 for k in self.pair}
            for nodes, features, labels in made:
                p, joint = marginals(nodes, self.scores(features), self.pair)
                for i, f in enumerate(features):
                    error = labels[i] - p[i]
                    for name in f:
                        gradient[name] = gradient.get(name, 0.0) + error
                    if i:
                        g = pairs["text" if nodes[i].tag == "#text" else "block"]
                        g[2 * labels[nodes[i].parent] + labels[i]] += 1
                        for s in range(4):
                            g[s] -= joint[i][s]
            for name, g in gradient.items():
                w = self.weights.get(name, 0.0)
                speed[name] = speed.get(name, 1e-9) + (g / total) ** 2
                self.weights[name] = w + rate * 0.1 * g / total / math.sqrt(speed[name]) - l2 * w
            for k, g in pairs.items():
                for s in range(4):
                    name = f"{k}{s}"
                    speed[name] = speed.get(name, 1e-9) + (g[s] / total) ** 2
                    self.pair[k][s] += rate * 0.05 * g[s] / total / math.sqrt(speed[name]) - l2 * self.pair[k][s]

    def scores(self, features: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(name, 0.0) for name in f) for f in features]

    def content(self, html: str | None) -> list[tuple[str, float]]:
        """Each run of text with its marginal."""
        if not html:
            return []
        nodes = parse(html)
        p, _ = marginals(nodes, self.scores(describe(nodes)), self.pair)
        return [(n.text, p[i]) for i, n in enumerate(nodes) if n.tag == "#text"]

    def extract(self, html: str | None) -> str:
        return "\n".join(text for text, p in self.content(html) if p >= 0.5)


def labelled_pages(n: int = 360, seed: int = 11) -> list[str]:
    """Pages in many layouts; data-label says what is content. Written here, so that the labels are right."""
    r = random.Random(seed)
    syllables = "ka lo mi ter san vel dor in es que ra tion ber lum os the an ve ri do".split()

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def say(a: int, b: int, stop: bool = True):
        x = [word() for _ in range(r.randint(a, b))]
        for k in range(6, len(x), r.randint(6, 14)):
            if stop:
                x[k] += "."
        return (" ".join(x)).capitalize() + ("." if stop and r.random() < 0.92 else "")

    def links(a: int, b: int):
        items = [f'<a href="/{word()}">{say(1, 4, False)}</a>' for _ in range(r.randint(a, b))]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()

    def remark(*kinds: str):
        """A short text with words of a kind, as notices have them."""
        x = [word() for _ in range(r.randint(1, 9))]
        for kind in kinds:
            for w in r.sample(SAYS[kind], 2):
                x.insert(r.randint(0, len(x)), w)
        return " ".join(x).capitalize() + r.choice([".", ""])

    def plain(kind: str):
        """Noise without a name."""
        text = remark(kind)
        return r.choice([lambda: f'<div data-label="0">{text}</div>', lambda: f'<div data-label="0"><p>{text}</p></div>', lambda: f'<p data-label="0">{text}</p>', lambda: f'<div data-label="0"><p>{text}</p>{links(1, 4)}</div>'])()

    def named(tag: str, names: list[str], body: str, label: int = 0):
        name = r.choice(names)
        attribute = "" if not name else f' {r.choice(["class", "id"])}="{name}"'
        return f'<{tag}{attribute} data-label="{label}">{body}</{tag}>'

    def noise(where: str):
        kinds = {
            "top": [
                lambda: named("nav", ["", "main-nav", "menu"], links(3, 8)),
                lambda: named("div", ["nav", "navbar", "menu top"], links(3, 8)),
                lambda: named("header", ["", "site-header", "masthead"], r.choice([f"<h1>{say(1, 3, False)}</h1>", f"<p>{say(2, 8, False)}</p>", ""]) + links(2, 6)),
                lambda: named("div", ["ad", "ads banner", "advert", "sponsored"], r.choice([say(4, 14), f"<p>{say(5, 25)}</p>"])),
                lambda: named("div", ["cookie-notice", "cookies", "notice", "consent"], f"<p>{say(8, 25)}</p>" + r.choice(["", f'<a href="#">{say(1, 2, False)}</a>'])),
                lambda: named("div", ["breadcrumbs", "breadcrumb"], links(2, 4)),
                lambda: named("div", [""], links(3, 8)),
                lambda: plain("notice"),
                lambda: f'<noscript data-label="0">{r.choice([remark("notice"), f"<p>{remark('notice')}</p>"])}</noscript>',
                lambda: f'<div {r.choice(["hidden", "style=display:none", 'aria-hidden="true"'])} data-label="0"><p>{say(3, 40)}</p></div>',
                lambda: named("form", ["", "search", "login"], f"<label>{say(1, 3, False)}</label><input name=q><button>{word()}</button>"),
            ],
            "in": [
                lambda: named("div", ["ad", "advert", "promo", "ad inline"], r.choice([say(4, 18), f"<p>{say(5, 20)}</p>"])),
                lambda: named("aside", ["", "related", "pullout"], f"<p>{say(4, 30)}</p>" + r.choice(["", links(1, 4)])),
                lambda: named("div", ["share", "social share"], links(2, 5)),
                lambda: plain(r.choice(["ad", "share"])),
                lambda: f'<div {r.choice(["hidden", "style=\'display: none\'"])} data-label="0">{say(3, 30)}</div>',
                lambda: named("div", ["newsletter", "subscribe"], f"<p>{say(6, 16)}</p><form><input></form>"),
            ],
            "end": [
                lambda: named("footer", ["", "site-footer"], r.choice([f"&copy; {word()}.example &middot; {say(5, 25)}", f"<p>{say(5, 25)}</p>{links(2, 6)}", say(3, 30)])),
                lambda: named("div", ["footer", "copyright", "legal"], f"<p>{say(5, 25)}</p>"),
                lambda: named("section", ["comments", "comment-list", "discussion"], f"<h3>{say(1, 3, False)}</h3>" + "".join(f'<div class="comment"><p>{say(5, 40)}</p></div>' for _ in range(r.randint(1, 4)))),
                lambda: named("div", ["comments", "replies", "reviews"], "".join(f"<p>{say(4, 40)}</p>" for _ in range(r.randint(1, 4)))),
                lambda: named("aside", ["", "sidebar", "widget"], f"<h3>{say(1, 4, False)}</h3>" + r.choice([links(2, 6), f"<p>{say(8, 40)}</p>"])),
                lambda: named("div", ["sidebar", "related", "popular posts"], f"<h4>{say(1, 4, False)}</h4>" + r.choice([links(2, 6), f"<p>{say(8, 30)}</p>"])),
                lambda: named("div", [""], links(3, 8)),
                lambda: plain("legal"),
                lambda: f'<div data-label="0"><h3>{remark("talk")}</h3>' + "".join(f"<div><p><b>{word()}</b> {say(3, 9)}</p></div>" for _ in range(r.randint(1, 3))) + "</div>",
                lambda: named("form", ["contact", "", "subscribe"], f"<p>{say(4, 14)}</p><label>{word()}</label><input>"),
            ],
        }[where]
        return r.choice(kinds)()

    def block():
        return r.choice(
            [lambda: f"<p>{say(1, 90)}</p>"] * 9
            + [
                lambda: f"<p>{say(1, 3)}</p>",
                lambda: f"<p><b>{say(10, 60)}<br>",
                lambda: f"<h{r.randint(2, 4)}>{say(1, 7, False)}</h{0}>".replace("h0", "h2"),
                lambda: "<ul>" + "".join(f"<li>{say(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                lambda: f"<blockquote><p>{say(6, 40)}</p></blockquote>",
                lambda: f"<p>{say(6, 30)} <a href='/x'>{say(1, 3, False)}</a> {say(4, 30)}</p>",
                lambda: f"<pre>{say(4, 30)}</pre>",
                lambda: f"<p>{say(4, 20)} <math><mi>{word()}</mi><mo>=</mo><mn>2</mn></math> {say(4, 20)}</p>",
                lambda: f"<noscript><p>{say(6, 30)}</p></noscript>",
                lambda: "<table>" + "".join(f"<tr><td>{say(1, 4, False)}</td><td>{say(1, 8)}</td></tr>" for _ in range(2)) + "</table>",
                lambda: f"<figure><img src=x><figcaption>{say(3, 14)}</figcaption></figure>",
            ]
        )()

    pages = []
    for _ in range(n):
        title = say(1, 10, r.random() < 0.3) if r.random() < 0.9 else remark(r.choice(sorted(SAYS)))
        head = r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>", ""])
        parts = [head] + [block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12]))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(1, len(parts)), noise("in"))
        inner = "".join(parts)
        body = r.choice(
            [lambda: f'<article data-label="1">{inner}</article>'] * 4
            + [
                lambda: f'<main data-label="1"><article>{inner}</article></main>',
                lambda: f'<main data-label="1">{inner}</main>',
                lambda: named("div", ["content", "post-body", "main-content", "article", "entry"], inner, 1),
                lambda: f'<div id="page" data-label="0"><div class="{r.choice(["content", "story", "text"])}" data-label="1">{inner}</div>{noise("end")}</div>',
                lambda: f'<section data-label="1">{inner}</section>',
                lambda: f'<div data-label="1">{inner}</div>',
                lambda: f'<div data-label="1"><div>{inner}</div></div>',
                lambda: f'<div data-label="0"><div data-label="1">{inner}</div>{noise("end")}</div>',
                lambda: f'<table data-label="0"><tr><td>{links(3, 7)}</td><td data-label="1">{inner}</td></tr></table>',
            ]
        )()
        top = "".join(noise("top") for _ in range(r.randint(0, 3)))
        end = "".join(noise("end") for _ in range(r.randint(0, 3)))
        pages.append(f'<!DOCTYPE html><html><head><title>{title}</title></head><body data-label="0">{top}{body}{end}</body></html>')
    return pages


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return Model(labelled_pages())


def _extractor(shared):
    def extract(batches):
        model = shared.value
        for batch in batches:
            texts = [model.extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return extract


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars. The model is a few hundred numbers, whatever the pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    return pages.select("page_id", "url", "html").mapInArrow(_extractor(shared), "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
