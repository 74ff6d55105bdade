"""Main text of web pages by a tree-structured graphical model.

A tolerant parser turns a page into a tree of block elements whose leaves are blocks of text. Every node is content or
not. A node's own potential comes from its tag, its class and id words and how much text, links and marks are below it;
parent and child share a potential that favours equal states. Sum-product messages, upward and then downward, give each
block's marginal probability, and blocks of one half or more are the page's text. Both potentials are fitted on
labelled pages: HTML in which `data-content="1"` or `"0"` on an element labels all below it. Where the caller gives
none, `labelled_pages` composes a set from common layouts.

Null or empty html: empty text. Unclosed tags, comments and quotes end as a browser ends them, or with the page; a
slash closes svg and math, whose elements may be nested. Formulas are text, drawings are not; noscript is an element as
others. The parser's work grows in proportion with the page, whatever is nested or left open in it: in a page of many tags
that never end, quotes that hide a `>` stop counting once the search for ends has cost SEARCHES times the page.
Rows with equal ids are extracted one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellgrid.llm.common import pick

# Element names of HTML.
RAW = frozenset("script style textarea title template svg iframe object select canvas audio video noembed noframes xmp".split())
VOID = frozenset("br img input hr meta link area base col embed source track wbr param".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul caption button label option".split())
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption li dd dt button label option html head body".split()) | {"li", "dd", "dt"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

#: Parts of math that repeat the formula in another notation.
NOTES = frozenset("annotation annotation-xml".split())
#: A slash in their tag closes these.
FOREIGN = NOTES | {"svg"}

#: Every page has these, so their state tells nothing: each of their children is the root of a tree.
ROOTS = frozenset(("#page", "html", "body", "head"))

_TOKEN = re.compile(r"""<(?:!--(?P<comment>)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*+>)""")
#: The same without regard to quotes.
_PLAIN = re.compile(r"<(?:!--(?P<comment>)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>|[!?/][^>]*+>)")
_BROKEN = re.compile(r"</?[a-zA-Z!?][^>]*+(>|$)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-zA-Z]+")
#: Tags of HTML that end svg and math which were not closed.
_LEAVES = re.compile(r"</math(?=[\s/>]|$)|</?(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var|article|section|main)(?=[\s/>]|$)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: How often a page may be searched, in all, for the ends of tags that have none.
SEARCHES = 16


@dataclass(slots=True)
class Node:
    parent: int
    tag: str
    #: Words of class, id and role; for a leaf its text.
    words: tuple[str, ...] = ()
    text: str = ""
    linked: int = 0
    label: int | None = None
    #: What is below it: characters, those in links, marks, and blocks of text.
    size: int = 0
    links: int = 0
    marks: int = 0
    blocks: int = 0


class Open:
    """The open elements, from the page inward, and where those of each name are."""

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes
        self.stack = [0]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int) -> None:
        self.places.setdefault(self.nodes[node].tag, []).append(len(self.stack))
        self.stack.append(node)

    def innermost(self, names) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def close(self, names, until=()) -> None:
        """Closes the innermost element of one of the names, with all in it, unless one of `until` lies between."""
        at = self.innermost(names)
        if at and at > self.innermost(until):
            for node in reversed(self.stack[at:]):
                self.places[self.nodes[node].tag].pop()
            del self.stack[at:]


class Ends:
    """Where elements that are skipped as a whole end, from one pass over the page for each name."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[str, tuple[dict[int, int], list[int]]] = {}

    def after(self, name: str, tag_end: int) -> int | None:
        """Where the element ends whose tag ends at `tag_end`; svg may be nested. None if it has no end."""
        if name not in self.known:
            self.known[name] = self._pass(name)
        paired, closes = self.known[name]
        if name == "svg":
            return paired.get(tag_end)
        k = bisect_left(closes, tag_end)
        return self._past(closes[k]) if k < len(closes) else None

    def _past(self, close: int) -> int:
        stop = self.page.find(">", close + 2)
        return len(self.page) if stop < 0 else stop + 1

    def _pass(self, name: str) -> tuple[dict[int, int], list[int]]:
        paired, closes, open_ = {}, [], []
        for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|$)", re.I).finditer(self.page):
            if m[1]:
                closes.append(m.start())
                if open_:
                    paired[open_.pop()] = self._past(m.start())
            elif name == "svg" and (whole := _TOKEN.match(self.page, m.start())) and not whole["rest"].endswith("/"):
                open_.append(whole.end())
        return paired, closes


def _attributes(rest: str) -> tuple[tuple[str, ...], str | None]:
    if "=" not in rest and "hidden" not in rest.lower():
        return (), None
    words, label = [], None
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            words += [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            words.append("hidden")
        elif name == "data-content":
            label = int(value == "1")
    return tuple(dict.fromkeys(words)), label


def parse(page: str) -> list[Node]:
    """Nodes in page order, a parent before its children; leaves have the tag `#text`."""
    nodes = [Node(-1, "#page")]
    opened = Open(nodes)
    stack = opened.stack
    ends = Ends(page)
    text: list[str] = []
    searched = 0
    linked = 0
    in_link = -1  # how deep the stack was when a link began
    in_math = False
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                nodes.append(Node(stack[-1], "#text", text=whole, linked=linked, label=nodes[stack[-1]].label))
            text.clear()
        linked = 0

    def say(s: str) -> None:
        nonlocal linked
        if s:
            text.append(s)
            if in_link >= 0:
                linked += len(s)

    def past(name: str) -> int:
        """Where the element that began before `at` ends. One without an end takes the rest of the page, but svg and the
        notes of math end before the next tag of HTML."""
        end = ends.after(name, at)
        if end is not None:
            return end
        leaves = _LEAVES.search(page, at) if name in FOREIGN else None
        return leaves.start() if leaves else n

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        m = (_TOKEN if searched <= SEARCHES * n else _PLAIN).match(page, lt)
        if m is None:
            m = _BROKEN.match(page, lt)
            searched += n - lt if m is not None else 0
            if m is None:
                say("<")
                at = lt + 1
            else:
                at = m.end()
            continue
        at = m.end()
        if m["comment"] is not None:
            if page.startswith(">", at) or page.startswith("->", at):
                at = page.index(">", at) + 1
                continue
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "a":
                in_link = -1
            elif name == "math":
                in_math = False
            elif name in BLOCK:
                flush()
                opened.close((name,))
                if len(stack) < in_link:
                    in_link = -1
            continue
        if name == "math":
            in_math = not m["rest"].endswith("/")
            continue
        if name in RAW or in_math and name in NOTES:
            if not (name in FOREIGN and m["rest"].endswith("/")):
                at = past(name)
            continue
        if name in ("br", "wbr", "img"):
            say(" " if name == "br" else "")
            continue
        if name == "a":
            in_link = len(stack)
            continue
        if name not in BLOCK:
            continue
        flush()
        if name in ENDS_P:
            opened.close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "main", "aside", "form", "body"})
        if name in IMPLIED:
            opened.close(*IMPLIED[name])
        if name == "hr" or name in ("html", "head", "body") and opened.places.get(name):
            continue
        if name == "body":
            opened.close({"head"})
        words, label = _attributes(m["rest"])
        nodes.append(Node(stack[-1], name, words, label=nodes[stack[-1]].label if label is None else label))
        opened.push(len(nodes) - 1)
    flush()
    return measured(nodes)


def measured(nodes: list[Node]) -> list[Node]:
    """Counts what is below each node."""
    for x in reversed(nodes):
        if x.tag == "#text":
            x.size, x.links, x.marks, x.blocks = len(x.text), x.linked, sum(map(x.text.count, ".!?,;")), 1
        if x.parent >= 0:
            up = nodes[x.parent]
            up.size += x.size
            up.links += x.links
            up.marks += x.marks
            up.blocks += x.blocks
    return nodes


def node_features(node: Node, nodes: list[Node]) -> list[str]:
    size = node.size
    if node.tag != "#text":
        return [
            f"t:{node.tag}",
            *(f"w:{w}" for w in node.words),
            f"L:{min(7, int(math.log2(size + 1)) // 2)}",
            f"K:{min(4, node.links * 4 // max(size, 1))}",
            f"M:{min(4, node.marks * 100 // max(size, 1))}",
            f"B:{min(4, int(math.log2(node.blocks + 1)))}",
        ]
    return [
        "leaf",
        f"l:{min(7, int(math.log2(size + 1)))}",
        f"k:{min(4, node.links * 4 // max(size, 1))}",
        f"m:{min(3, node.marks)}",
        f"in:{nodes[node.parent].tag}",
        *(["copyright"] if "©" in node.text else []),
        *(["bars"] if node.text.count("|") + node.text.count("»") + node.text.count("·") > 1 else []),
    ]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    #: edge[parent][child], the shared potential.
    edge: tuple[tuple[float, float], tuple[float, float]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Log-odds of content of every node, by messages up and down the tree."""
        (e00, e01), (e10, e11) = self.edge
        get = self.weights.get
        own = [sum(get(f, 0.0) for f in node_features(x, nodes)) for x in nodes]
        up = [0.0] * len(nodes)
        belief = own[:]
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[nodes[i].parent].tag in ROOTS:
                continue
            b = math.exp(max(-30.0, min(30.0, belief[i])))
            up[i] = math.log((e11 * b + e10) / (e01 * b + e00))
            belief[nodes[i].parent] += up[i]
        for i in range(1, len(nodes)):
            if nodes[nodes[i].parent].tag in ROOTS:
                continue
            b = math.exp(max(-30.0, min(30.0, belief[nodes[i].parent] - up[i])))
            belief[i] += math.log((e11 * b + e01) / (e10 * b + e00))
        return belief

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        belief = self.marginals(nodes)
        return "\n".join(x.text for x, b in zip(nodes, belief) if x.tag == "#text" and b >= 0)


def fit(pages: list[str], rounds: int = 250) -> Model:
    """From labelled pages, by maximum likelihood of all labels of a page given its features. The gradient is the
    difference of the labels and their marginals, which the same messages give, for all pages level by level."""
    parent, depth, label, of_node, feature = [], [], [], [], []
    at: dict[str, int] = {}
    for page in pages:
        nodes = parse(page)
        place = {}
        for i, x in enumerate(nodes):
            if x.tag in ROOTS:
                continue
            up = place.get(x.parent, -1)
            place[i] = len(parent)
            for f in node_features(x, nodes):
                of_node.append(len(parent))
                feature.append(at.setdefault(f, len(at)))
            parent.append(up)
            depth.append(depth[up] + 1 if up >= 0 else 0)
            label.append(x.label or 0)
    n = len(parent)
    parent, depth, label, of_node, feature = (np.array(x, np.int64) for x in (parent, depth, label, of_node, feature))
    levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
    child = np.flatnonzero(parent >= 0)
    seen = np.bincount(feature, minlength=len(at))
    met = np.bincount(2 * label[parent[child]] + label[child], minlength=4)
    w = np.zeros(len(at) + 3)  # the weights, then the logarithms of edge[0][1], [1][0] and [1][1]
    w[-3:] = -1, -1, 1
    first = second = np.zeros_like(w)
    for t in range(1, rounds + 1):  # Adam
        e01, e10, e11 = np.exp(w[-3:])
        below = np.bincount(of_node, weights=w[feature], minlength=n)
        sent = np.zeros(n)
        for rows in reversed(levels):
            odds = np.exp(np.clip(below[rows], -30, 30))
            sent[rows] = np.log((e11 * odds + e10) / (e01 * odds + 1))
            below += np.bincount(parent[rows], weights=sent[rows], minlength=n)
        belief = below.copy()
        for rows in levels:
            odds = np.exp(np.clip(belief[parent[rows]] - sent[rows], -30, 30))
            belief[rows] += np.log((e11 * odds + e01) / (e10 * odds + 1))
        marginal = 1 / (1 + np.exp(-np.clip(belief, -30, 30)))
        a, b = (np.exp(np.clip(x, -30, 30)) for x in (belief[parent[child]] - sent[child], below[child]))
        pairs = np.stack((np.ones(len(child)), e01 * b, e10 * a, e11 * a * b))
        pairs = (pairs / pairs.sum(axis=0)).sum(axis=1)
        grad = np.concatenate((np.bincount(feature, weights=(marginal - label)[of_node], minlength=len(at)), pairs[1:] - met[1:])) / max(n, 1) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - 0.08 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    e01, e10, e11 = (float(x) for x in np.exp(w[-3:]))
    return Model({f: float(w[i]) for f, i in at.items() if seen[i] >= 3}, ((1.0, e01), (e10, e11)))


# --- labelled pages ------------------------------------------------------------------------------------------------

# Class and id words that sites use, by what they mark.
CHROME_WORDS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc sitemap topnav subnav skip links".split(),
    "header": "header masthead banner topbar logo branding top head".split(),
    "footer": "footer copyright legal bottom colophon foot credits".split(),
    "aside": "sidebar aside widget related recommended trending popular rail more teaser archive tags tag share social sharing follow author-box".replace("-", " ").split(),
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner commercial dfp outbrain taboola".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall toast message disclaimer warning".split(),
    "form": "form search login subscribe contact field".split(),
    "comments": "comment comments respond reply replies discussion disqus commentlist thread".split(),
}
CONTENT_WORDS = "content article post entry story body main text maincontent articlebody postcontent page single prose hentry blog".split()


def labelled_pages(n: int = 800, seed: int = 11, unknown: float = 0.25) -> list[str]:
    """Pages of random words in common layouts, each part labelled. unknown: the share of elements whose class words are
    made up, so that a model also learns to tell content by its shape."""
    rng = random.Random(seed)
    syllables = [c + v for c in "bcdfglmnprstv" for v in "aeiou"] + "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(most: int = 22) -> str:
        words = [word() for _ in range(rng.randint(1, most))]
        body = " ".join(w + ("," if rng.random() < 0.08 else "") for w in words).capitalize()
        return body + rng.choice([".", ".", ".", "?", "!", ""] if rng.random() < 0.2 else ["."])

    def prose(most: int = 6) -> str:
        parts = [sentence() for _ in range(rng.randint(1, most))]
        if rng.random() < 0.15:
            parts.insert(rng.randrange(len(parts) + 1), f'<a href="/{word()}">{word()} {word()}</a>')
        if rng.random() < 0.1:
            parts.append(f"<b>{word()}</b> <em>{word()}</em>")
        if rng.random() < 0.08:
            parts = [p.replace(" ", rng.choice([" &amp; ", " | ", " %%% ", " *** "]), 3) for p in parts]
        return " ".join(parts)

    def link() -> str:
        return f'<a href="/{word()}">{" ".join(word().capitalize() for _ in range(rng.randint(1, 4)))}</a>'

    def named(tag: str, words: list[str], inner: str, label: int) -> str:
        attrs = ""
        if words and rng.random() < 0.85:
            chosen = rng.sample(words, rng.randint(1, min(2, len(words)))) + ([word()] if rng.random() < 0.3 else [])
            if rng.random() < unknown:  # a site's own words, which tell nothing
                chosen = [word() for _ in chosen]
            attrs = f' {rng.choice(["class", "class", "id"])}="{rng.choice([" ", "-", "_"]).join(chosen)}"'
        return f'<{tag}{attrs} data-content="{label}">{inner}</{tag}>'

    def short() -> str:
        return rng.choice([sentence(10), sentence(16), prose(2), " ".join(word() for _ in range(rng.randint(1, 5)))])

    def chrome(kind: str) -> str:
        words = CHROME_WORDS[kind]
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "ad": "div", "notice": "div", "form": "form", "comments": "section"}[kind]
        tag = plain if rng.random() < 0.6 else rng.choice(["div", "section", "div", "ul" if kind == "nav" else "div"])
        if kind == "nav":
            items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9)))
            inner = items if tag == "ul" else rng.choice([f"<ul>{items}</ul>", " ".join(link() for _ in range(rng.randint(2, 7))), f"<ol>{items}</ol>"])
        elif kind == "header":
            inner = rng.choice([link(), f"<h1>{word()}</h1><p>{short()}</p>", f"<div>{link()}</div><p>{sentence(8)}</p>", f"<div>{short()}</div>"]) + (chrome("nav") if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "&copy; 2020 ", "Copyright ", ""]) + rng.choice([f"{word()}.example.com &middot; {sentence()}", prose(2), f"<p>{prose(3)}</p>", f"<p>{sentence()}</p><ul><li>{link()}</li><li>{link()}</li></ul>"])
        elif kind == "aside":
            inner = rng.choice([f"<h3>{word()}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<h2>{word()}</h2><p>{prose(3)}</p>", f"<p>{short()}</p>", "".join(f"<div>{link()}<p>{sentence()}</p></div>" for _ in range(3))])
        elif kind == "form":
            inner = f'<label>{word()}</label><input name="q"><p>{short()}</p><button>{word()}</button>'
        elif kind == "comments":
            inner = f"<h3>{word()}</h3>" + "".join(rng.choice(["<div><p>{}</p></div>", "<li><p>{}</p></li>", "<article><h4>{}</h4><p>{}</p></article>", '<div class="comment"><b>{}</b><p>{}</p></div>']).format(prose(4), prose(3)) for _ in range(rng.randint(1, 5)))
        else:
            inner = rng.choice([short(), f"<p>{prose(3)}</p>", f"{short()} {link()}", f"<h4>{word()}</h4><p>{sentence()}</p><button>{word()}</button>"])
            words = words if rng.random() < 0.95 else []
            if not words:
                words = [kind]
        if tag in ("div", "section", "ul") and not words:
            tag = plain
        made = named(tag, words, inner, 0)
        if tag in ("div", "section", "ul") and "class=" not in made.split(">")[0] and "id=" not in made.split(">")[0]:
            made = made.replace(f"<{tag}", f'<{tag} class="{rng.choice(words)}"', 1)
        return made

    def block() -> str:
        r = rng.random()
        if r < 0.06:
            return rng.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}"]).format(rng.choice([word(), f"{word()} {word()}", word() + ".", "&amp; " + word(), f'{word()} <a href="/x">{word()}</a> {word()}.']))
        if r < 0.62:
            return f"<p>{prose()}" + ("</p>" if rng.random() < 0.9 else "")
        if r < 0.72:
            return f"<p><b>{sentence(5)}<br>"
        if r < 0.8:
            return "<h{0}>{1}</h{0}>".format(rng.randint(2, 4), sentence(7).rstrip("."))
        if r < 0.87:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{rng.choice([sentence(), prose(2), word()])}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        if r < 0.91:
            return f"<blockquote>{rng.choice([prose(), f'<p>{prose()}</p>'])}</blockquote>"
        if r < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{word()}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if r < 0.96:
            return f"<pre>{prose(3)}</pre>"
        if r < 0.98:
            return f'<figure><img src="x.png"><figcaption>{sentence()}</figcaption></figure>'
        return f"<div>{prose()}</div>"

    pages = []
    for _ in range(n):
        title = sentence(12).rstrip(".")
        body = [f"<h1>{title}</h1>"] if rng.random() < 0.9 else []
        if body and rng.random() < 0.1:
            body = [f"<header>{body[0]}</header>"]
        body += [block() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12]) + (not body))]
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            body.insert(rng.randint(1, len(body)), chrome(rng.choice(["ad", "notice", "aside", "form", "nav"])))
        if rng.random() < 0.2:
            body = [named("div", CONTENT_WORDS, "".join(body), 1)]
        if rng.random() < 0.25:
            body.append(chrome(rng.choice(["comments", "comments", "aside", "form"])))
        r = rng.random()
        if r < 0.5:
            main = f'<article data-content="1">{"".join(body)}</article>'
        elif r < 0.65:
            main = f'<main data-content="1">{"".join(body)}</main>'
        elif r < 0.92:
            main = named(rng.choice(["div", "section", "article"]), CONTENT_WORDS, "".join(body), 1)
        elif r < 0.96:
            main = f'<div data-content="1">{"".join(body)}</div>'
        else:  # no element around the text
            main = "".join(b if "data-content" in b else b.replace(">", ' data-content="1">', 1) for b in body)
        before = [chrome(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.45]
        after = [chrome(k) for k in ("aside", "comments", "ad", "form", "notice", "footer") if rng.random() < 0.4]
        rng.shuffle(before)
        inner = "".join(before) + main + "".join(after)
        if rng.random() < 0.2:
            inner = f'<div id="{rng.choice(["page", "wrapper", "container", "site"])}">{inner}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{title}</title></head><body data-content=\"0\">{inner}</body></html>")
    return pages


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages: (id, url, html). Returns (id, url, text, n_chars), a row for each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pick(pages, "id", "url", "html")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
