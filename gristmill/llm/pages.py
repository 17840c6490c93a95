"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block of text and every element is a node with a hidden state: content or
boilerplate.  Node potentials come from log-linear features (kind of element,
words of class and id, link density, length, punctuation, share of the page's
text); parent-child potentials couple a node with its parent.  Two passes of sum-product messages,
from the leaves up and from the root down, give each node's exact marginal.
Both kinds of potentials are learned from labelled pages by following the
gradient of the likelihood, which the same messages yield.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements without content, elements whose content is no text, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option datalist head".split())
RAWTEXT = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button caption label".split()
)
#: What a start tag closes when open (optional end tags).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Block elements that close an open paragraph.
ENDS_P = BLOCK - {"button", "label", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
#: Words of class, id or role that speak for boilerplate, by kind.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip toc sitemap", "top": "header masthead banner logo hero-nav branding", "foot": "footer foot colophon copyright legal imprint bottom",
    "side": "sidebar aside rail widget widgets related recommended trending", "notice": "cookie cookies consent notice gdpr alert popup modal overlay toast paywall subscribe newsletter signup promo banner-notice disclaimer warning",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promoted promotion adbox adsense outbrain taboola commercial", "form": "form login searchbox contact-form subscribe-form", "comment": "comment comments discussion respond reply replies disqus reader-comments",
    "share": "share sharing social follow buttons", "main": "content article post entry main story body text prose article-body post-content entry-content",
    "vague": "more side popular tags review reviews thread feedback print search",
}
_CUE = {w: kind for kind, words in CUES.items() for w in words.split()}

#: A start or end tag up to its name; a piece of a tag: its end, or an attribute with the start of its value; other markup; text.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)(>?)")
_PART = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(["'])|([^\s>"'][^\s>]*+)|(?=>)))?+)""")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_TEXT = re.compile(r"(?:[^<]++|<(?![a-zA-Z!?/]))++")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Elements that a slash in the start tag closes.
SELF_CLOSED = frozenset({"svg", "math"})
#: End tags of elements that are skipped; ASCII, as only there case makes no difference.
_END = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.I | re.A) for tag in RAW}


#: Elements around everything.
FRAME = frozenset({"html", "body"})


class Node:
    __slots__ = ("tag", "cues", "parent", "children", "parts", "link", "chars", "order", "label", "hidden", "below", "below_link")

    def __init__(self, tag: str, parent: Node | None, cues: frozenset, hidden: bool = False):
        self.tag, self.parent, self.cues, self.hidden = tag, parent, cues, hidden
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.link = self.chars = self.below = self.below_link = 0
        self.order, self.label = -1, None
        if parent is not None:
            parent.children.append(self)


def _attributes(pairs: list[tuple[str, str]]) -> tuple[frozenset, bool, bool | None]:
    """Cue kinds, whether hidden, and the data-content mark of labelled pages; of a repeated attribute the first counts."""
    cues, hidden, mark, seen = set(), False, None, set()
    for name, value in pairs:
        name = name.lower()
        if name in seen:
            continue
        seen.add(name)
        if name in ("class", "id", "role"):
            cues.update(_CUE[w] for w in map(str.lower, _WORD.findall(value)) if w in _CUE)
        elif name == "hidden" or (name == "style" and _UNSEEN.search(value.lower())):
            hidden = True
        elif name == "data-content":
            mark = value == "1"
    return frozenset(cues), hidden, mark


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of block elements, and the text blocks ("#text" nodes) in page order.

    Inline elements add to the block around them; elements without text have no
    node.  Broken markup never fails: unknown end tags are ignored, open elements
    end with the page, a quote that nothing closes is a letter.  Time is linear
    in the length of the page, at any depth.
    """
    root = Node("#root", None, frozenset())
    #: Open elements: tag, attributes, node (made when there is text).
    stack: list[list] = [["#root", (), root]]
    blocks: list[Node] = []
    text: Node | None = None
    links = 0
    pos, n = 0, len(page)
    #: Places on the stack of each open tag, and what is not found any more: end tags, quotes.
    at: defaultdict[str, list[int]] = defaultdict(list)
    endless: set[str] = set()

    def top(tags: set[str]) -> int:
        return max((at[t][-1] for t in tags if at[t]), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            at[stack.pop()[0]].pop()

    def end_of(tag: str) -> int:
        m = None if tag in endless else _END[tag].search(page, pos)
        if m is None:
            endless.add(tag)
            return -1
        return m.start()

    def owner() -> Node:
        k = len(stack) - 1
        while stack[k][2] is None:
            k -= 1
        for k in range(k + 1, len(stack)):
            tag, pairs, _ = stack[k]
            up = stack[k - 1][2]
            cues, hidden, mark = _attributes(pairs) if pairs else (frozenset(), False, None)
            node = stack[k][2] = Node(tag, up, cues, hidden or up.hidden)
            node.label = up.label if mark is None else mark
        return stack[-1][2]

    def say(s: str) -> None:
        nonlocal text
        if text is None:
            if s.isspace():
                return
            text = Node("#text", owner(), frozenset())
            text.order = len(blocks)
            blocks.append(text)
        text.parts.append(s)
        k = len(s)
        text.chars += k
        if links:
            text.link += k

    def attributes() -> tuple[list[tuple[str, str]], bool]:
        """The attributes of the tag at pos, which moves behind it, and whether a slash ends the tag."""
        nonlocal pos
        pairs = []
        while True:
            m = _PART.match(page, pos)
            if m is None:
                pos = n
                return pairs, False
            if m[1]:
                pos, closed = m.end(), page[m.end() - 2] == "/"
                # A slash that ends an unquoted value is part of the value.
                return pairs, closed and m.end() - m.start() > 1
            pos, value = m.end(), m[4] or ""
            if m[3]:
                end = -1 if m[3] in endless else page.find(m[3], pos)
                if end < 0:
                    endless.add(m[3])
                    end = page.find(">", pos)
                    end = n if end < 0 else end
                    value, pos = page[pos:end], end
                else:
                    value, pos = page[pos:end], end + 1
            pairs.append((m[2], value))

    while pos < n:
        if page[pos] != "<" or (m := _TAG.match(page, pos)) is None:
            m = _OTHER.match(page, pos)
            if m is None:
                m = _TEXT.match(page, pos)
                s = m[0]
                say(html.unescape(s) if "&" in s else s)
            pos = m.end()
            continue
        pos, tag = m.end(), m[2].lower()
        pairs, closed = ([], False) if m[3] else attributes()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                say(" ")
            elif tag == "p" and not at["p"]:
                text = None
            elif tag in BLOCK:
                if at[tag]:
                    close(at[tag][-1])
                text, links = None, 0 if tag != "li" else links
            continue
        if tag in RAW:
            if tag in RAWTEXT:
                # Raw text runs to its end tag, or to the end of the page.
                end = end_of(tag)
                pos = n if end < 0 else end
            elif tag != "head" and not (tag in SELF_CLOSED and closed):
                # Without an end tag its content is read as any other.
                end = end_of(tag)
                pos = pos if end < 0 else end
        elif tag == "br":
            if text is not None:
                say(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            text = None
            if tag == "hr":
                continue
            if tag in ENDS_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in CLOSES:
                shut, stop = CLOSES[tag]
                k = top(shut)
                if k > top(stop):
                    close(k)
            at[tag].append(len(stack))
            stack.append([tag, pairs, None])
    for b in blocks:
        b.label, b.hidden = b.parent.label, b.parent.hidden
    return root, blocks


def words(block: Node) -> str:
    """A block's text with white space runs as one space, trimmed."""
    return _SPACE.sub(" ", "".join(block.parts)).strip()


def _step(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def node_features(node: Node, text: str | None = None, total: int = 0) -> list[str]:
    """Features of a node; text: a block's words; total: characters of the page outside links."""
    if node.tag == "#text":
        s = text if text is not None else words(node)
        link, size, tag = _step(node.link / max(1, node.chars), 0.05, 0.5), _step(len(s), 25, 80, 240), node.parent.tag
        return ["text", f"in:{tag}", f"link:{link}", f"link:{link} in:{tag}", f"size:{size}", f"stop:{int(s[-1:] in '.!?…\"”»')}"]
    plain = node.below - node.below_link
    out = [
        f"tag:{node.tag}", f"links:{_step(node.below_link / max(1, node.below), 0.1, 0.6)}", f"part:{_step(plain / max(1, total), 0.05, 0.25, 0.6)}",
        f"long:{_step(plain, 100, 600)}",
    ]
    return out + [f"cue:{c}" for c in node.cues] + ["hidden"] * node.hidden


def compiled(root: Node, texts: dict[int, str] | None = None) -> tuple[list[Node], list[int], list[list[str]]]:
    """Nodes in page order, the place of each one's parent (-1: none), and their features.

    The elements of FRAME hold every page's all: they are no nodes of the model.
    """
    nodes, parents = [], []
    stack = [(c, -1) for c in reversed(root.children)]
    while stack:
        node, up = stack.pop()
        if node.tag in FRAME:
            stack += [(c, up) for c in reversed(node.children)]
            continue
        i = len(nodes)
        nodes.append(node)
        parents.append(up)
        node.below, node.below_link = node.chars, node.link
        stack += [(c, i) for c in reversed(node.children)]
    for i in range(len(nodes) - 1, -1, -1):
        if parents[i] >= 0:
            up = nodes[parents[i]]
            up.below += nodes[i].below
            up.below_link += nodes[i].below_link
    total = sum(x.below - x.below_link for x, up in zip(nodes, parents, strict=True) if up < 0)
    return nodes, parents, [node_features(x, texts.get(x.order) if texts and x.tag == "#text" else None, total) for x in nodes]


class Model:
    """weights: feature -> log-odds for content; edge: potentials [parent state][child state] on a log scale, for text and for element children."""

    def __init__(self, weights: dict[str, float] | None = None, edge: dict[str, list[list[float]]] | None = None):
        self.weights = weights or {}
        self.edge = edge or {k: [[0.5, 0.0], [0.0, 0.5]] for k in ("text", "element")}

    def beliefs(self, root: Node, texts: dict[int, str] | None = None) -> tuple[list[Node], list[float], list[list[float]], list[list[str]]]:
        """Nodes below the root in page order, their marginals of content, the joint with the parent, and their features."""
        nodes, parents, feats = compiled(root, texts)
        return nodes, *self.messages(nodes, parents, feats), feats

    def messages(self, nodes: list[Node], parents: list[int], feats: list[list[str]]) -> tuple[list[float], list[list[float]]]:
        """Marginals of content, and the joint of each node with its parent."""
        get = self.weights.get
        own = [sum(get(f, 0.0) for f in fs) for fs in feats]  # log potential of content; boilerplate: 0
        et = {k: [[math.exp(v) for v in row] for row in e] for k, e in self.edge.items()}
        tables = [et["text"] if x.tag == "#text" else et["element"] for x in nodes]
        n = len(nodes)
        # Upward: (product of own potential and children's messages), kept normalised.
        b0, b1 = [1.0] * n, [1.0] * n
        for i in range(n):
            v = max(-30.0, min(30.0, own[i]))
            b1[i] = math.exp(v)
        m0, m1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, -1, -1):
            s = b0[i] + b1[i]
            b0[i] /= s
            b1[i] /= s
            t = tables[i]
            a, b = t[0][0] * b0[i] + t[0][1] * b1[i], t[1][0] * b0[i] + t[1][1] * b1[i]
            s = a + b
            m0[i], m1[i] = a / s, b / s
            p = parents[i]
            if p >= 0:
                b0[p] *= m0[i]
                b1[p] *= m1[i]
                s = b0[p] + b1[p]
                if s < 1e-100:
                    b0[p] /= s
                    b1[p] /= s
        # Downward: parent's belief without this child's message.  A node at the top has a virtual boilerplate-neutral parent.
        out, joint = [0.0] * n, []
        f0, f1 = [0.0] * n, [0.0] * n
        for i in range(n):
            p, t = parents[i], tables[i]
            if p < 0:
                c0 = c1 = 0.5
            else:
                c0, c1 = f0[p] / max(m0[i], 1e-300), f1[p] / max(m1[i], 1e-300)
            j = [c0 * t[0][0] * b0[i], c0 * t[0][1] * b1[i], c1 * t[1][0] * b0[i], c1 * t[1][1] * b1[i]]
            s = sum(j) or 1.0
            j = [x / s for x in j]
            f0[i], f1[i] = j[0] + j[2], j[1] + j[3]
            out[i] = f1[i]
            joint.append(j)
        return out, joint

    def extract(self, page: str | None) -> list[str]:
        """Texts of the page's content blocks, in page order."""
        if not page:
            return []
        root, blocks = parse(page)
        texts = {b.order: words(b) for b in blocks}
        nodes, content, _, _ = self.beliefs(root, texts)
        return [texts[x.order] for x, p in zip(nodes, content, strict=True) if x.tag == "#text" and p > 0.5 and not x.hidden and texts[x.order]]


def fit(pages: list[str], rounds: int = 120, rate: float = 0.4, ridge: float = 0.0005) -> Model:
    """Potentials from labelled pages: blocks carry data-content="1" or "0" on themselves or on an element around them.

    An element's state is content if most of the text below it is.  All pages'
    trees are one forest here, whose levels exchange messages at once.
    """
    up, kind, state, level, feature, place, known = [], [], [], [], [], [], {}
    for page in pages:
        root, blocks = parse(page)
        texts = {b.order: words(b) for b in blocks}
        share: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for b in blocks:
            x = b
            while x is not None:
                share[id(x)][int(bool(b.label))] += len(texts[b.order])
                x = x.parent
        first = len(up)
        for x, p, fs in zip(*compiled(root, texts), strict=True):
            feature += [known.setdefault(f, len(known)) for f in fs]
            place += [len(up)] * len(fs)
            level.append(0 if p < 0 else level[first + p] + 1)
            up.append(-1 if p < 0 else first + p)
            kind.append(int(x.tag != "#text"))
            state.append(share[id(x)][1] > share[id(x)][0])
    model, kinds = Model(), ("text", "element")
    up, kind, state, level, feature, place = map(np.array, (up, kind, state, level, feature, place))
    n, size = len(up), len(known)
    levels = [np.nonzero(level == d)[0] for d in range(level.max(initial=0) + 1)]
    edge = np.array([model.edge[k] for k in kinds])
    weight, speed_w, speed_e = np.zeros(size), np.zeros(size), np.zeros_like(edge)
    below, truth = np.nonzero(up >= 0)[0], np.zeros((n, 2, 2))
    truth[below, state[up[below]].astype(int), state[below].astype(int)] = 1
    for _ in range(rounds):
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(place, weight[feature], n)
        message = np.empty((n, 2))
        for at in reversed(levels):
            own[at] -= own[at].max(axis=1, keepdims=True)
            message[at] = np.logaddexp.reduce(edge[kind[at]] + own[at][:, None, :], axis=2)
            if up[at[0]] >= 0:
                for k in (0, 1):
                    own[:, k] += np.bincount(up[at], message[at, k], n)
        joint, belief = np.empty((n, 2, 2)), np.empty((n, 2))
        for at in levels:
            above = belief[up[at]] - message[at] if up[at[0]] >= 0 else np.zeros((len(at), 2))
            j = above[:, :, None] + edge[kind[at]] + own[at][:, None, :]
            j = np.exp(j - j.max(axis=(1, 2), keepdims=True))
            joint[at] = j / j.sum(axis=(1, 2), keepdims=True)
            belief[at] = np.log(np.maximum(joint[at].sum(axis=1), 1e-300))
        g = np.bincount(feature, (state - joint[:, :, 1].sum(axis=1))[place], size) / len(pages) - ridge * weight
        speed_w += g * g
        weight += rate * g / (np.sqrt(speed_w) + 1e-8)
        for k in (0, 1):
            mine = below[kind[below] == k]
            g = (truth[mine] - joint[mine]).sum(axis=0) / len(pages) - ridge * edge[k]
            speed_e[k] += g * g
            edge[k] += rate * g / (np.sqrt(speed_e[k]) + 1e-8)
    return Model({f: float(weight[i]) for f, i in known.items()}, {k: edge[i].tolist() for i, k in enumerate(kinds)})


#: Names that training pages give to parts of a page, as sites write them; "plain" and "odd" ones say nothing.
NAMES = {
    "menu": "main-nav primaryMenu navbar-nav site-navigation breadcrumb-trail pagination-links menu__list tab-toolbar", "top": "site-header pageHeader masthead top-bar branding-area",
    "foot": "site-footer pageFooter colophon copyright-line footer-widgets", "side": "sidebar-right left-rail widget-area related-posts recommendedItems trending-now",
    "notice": "cookie-bar consentBox newsletter-signup alert-box subscribe-panel paywall-prompt gdpr-note", "advert": "ad ad-slot advert-box sponsored-links promotion-unit ads",
    "form": "form-inline login-box contact-form", "comment": "comment-list commentsArea discussion-box reader-replies", "share": "share-bar social-links follow-us",
    "main": "post-content entryContent article-body story-text main-column content-area", "plain": "box row col-8 wrap inner container grid card block-2 u-flex clearfix panel item unit x1 section-3",
    "odd": "review more side-story print-view feature popular tags thread-7 search-result warning-signs",
}


def labelled_pages(n: int = 300, seed: int = 7, names: dict[str, str] = NAMES) -> list[str]:
    """Labelled training pages, made by rule: an article among menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

    Everything may be wrapped in bare or neutrally named elements; articles may
    carry names that elsewhere mark boilerplate, paragraphs and items that are
    links, and boilerplate of their own.
    """
    rnd = random.Random(seed)
    syllables = "ka lo mi ren tas ver dol ume pir san tek ora bel cho nim".split()

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))

    def prose(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(a, b))).capitalize() + rnd.choice([".", ".", "!", "?", ""])

    def name(kind: str) -> str:
        return rnd.choice(names[kind].split())

    def plain() -> str:
        return rnd.choice(["", "", f' class="{name("plain")}"', f' id="{name("plain")}"', ' data-id="7"'])

    def wrapped(inner: str, most: int) -> str:
        for _ in range(rnd.randint(0, most)):
            inner = rnd.choice([f"<div{plain()}>{inner}</div>", f"<div{plain()}>{inner}</div>", f"<section{plain()}>{inner}</section>"])
        return inner

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{prose(1, 5)}</a></{tag}>' for _ in range(k))

    def boiler(kind: str) -> str:
        c = name(kind) if kind in names else ""
        mark = rnd.choice([f'class="{c}"', f'id="{c}"', f'class="{name("plain")} {c}"'])
        if kind == "menu":
            inner = rnd.choice([f"<ul>{links(rnd.randint(3, 8))}</ul>", " | ".join(f"<a href='/x'>{word()}</a>" for _ in range(5))])
            return rnd.choice([f"<nav>{inner}</nav>", f"<nav {mark}>{inner}</nav>", f"<div {mark}>{inner}</div>", f"<div{plain()}>{inner}</div>", f'<ul {mark}>{links(4)}</ul>', f"<menu>{links(4)}</menu>"])
        if kind == "top":
            return rnd.choice([f"<header{plain()}><h1>{prose(1, 4)}</h1><p>{prose(2, 8)}</p></header>", f"<div {mark}><a href='/'>{prose(1, 3)}</a><p>{prose(1, 7)}</p></div>"])
        if kind == "foot":
            inner = f"<p>&copy; {prose(3, 14)}</p>" + rnd.choice(["", f"<ul>{links(3)}</ul>"])
            return rnd.choice([f"<footer>{inner}</footer>", f"<footer>&copy; {word()}.example &middot; {prose(6, 30)}</footer>", f"<div {mark}>{inner}</div>"])
        if kind == "side":
            inner = rnd.choice([f"<h3>{prose(1, 3)}</h3><ul>{links(5)}</ul>", f"<h2>{prose(1, 3)}</h2><p>{prose(8, 40)}</p>"])
            return rnd.choice([f"<aside{plain()}>{inner}</aside>", f"<div {mark}>{inner}</div>", f"<section {mark}>{inner}</section>"])
        if kind == "form":
            inner = f"<label>{prose(1, 3)}</label><input name='q'><button>{prose(1, 2)}</button><p>{prose(3, 14)}</p>"
            return rnd.choice([f"<form>{inner}</form>", f"<form {mark}><fieldset>{inner}</fieldset></form>", f"<div {mark}><form>{inner}</form></div>"])
        if kind == "comment":
            inner = "".join(rnd.choice([f"<div class='{name('comment')}'><p>{{}}</p></div>", "<li><p>{}</p></li>", f"<article class='{name('comment')}'><p>{{}}</p></article>", "<article><p>{}</p></article>", "<div><div><p>{}</p></div></div>", "<p>{}</p>"]).format(prose(5, 50)) for _ in range(rnd.randint(1, 5)))
            return rnd.choice([f"<section {mark}><h2>{prose(1, 3)}</h2>{inner}</section>", f"<div {mark}>{inner}</div>", f"<ol {mark}>{inner}</ol>"])
        inner = rnd.choice([prose(5, 30), f"<p>{prose(5, 40)}</p>", f"<p>{prose(4, 10)}</p><button>{prose(1, 2)}</button>"])
        return rnd.choice([f"<div {mark}>{inner}</div>", f"<section {mark}>{inner}</section>", f"<aside {mark}>{inner}</aside>"])

    def piece() -> str:
        kind = rnd.random()
        if kind < 0.62:
            p = prose(1, 3) if rnd.random() < 0.15 else prose(6, 120)
            if rnd.random() < 0.2:
                p = f"<b>{p}" if rnd.random() < 0.5 else p.replace(" ", f' <a href="/y">{word()}</a> ', 1)
            return f"<p>{p}" + ("</p>" if rnd.random() < 0.8 else "<br>")
        if kind < 0.68:
            return f"<p><a href='/y'>{prose(1, 12)}</a></p>"
        if kind < 0.72:
            return rnd.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format(links(rnd.randint(1, 4)))
        if kind < 0.78:
            return f"<h{rnd.choice('234')}>{prose(1, 6)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{prose(2, 20)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{prose(6, 40)}</p></blockquote>"
        if kind < 0.9:
            return f"<section><h2>{prose(1, 5)}</h2><p>{prose(8, 60)}</p></section>"
        if kind < 0.92:
            return "<ol>" + "".join(f"<li>{prose(3, 25)}</li>" for _ in range(3)) + f"</ol><figure><img src='a'><figcaption>{prose(3, 9)}</figcaption></figure>"
        if kind < 0.95:
            return "<table><tr>" + "".join(f"<td>{prose(1, 8)}</td>" for _ in range(3)) + "</tr></table>"
        return rnd.choice([f"<pre>{prose(4, 20)}</pre>", f"{prose(8, 40)}<br><br>{prose(8, 40)}"])

    def body() -> str:
        head = rnd.choice([f"<h1>{prose(3, 12)}</h1>", f"<h1>{prose(1, 4)}</h1>", f"<h2>{prose(2, 9)}</h2>", f"<header><h1>{prose(2, 9)}</h1></header>", ""])
        pieces = [piece() for _ in range(rnd.randint(1, 8))]
        inner = head + rnd.choice(["".join(pieces), wrapped("".join(pieces), 4), "".join(wrapped(x, 2) for x in pieces)])
        if rnd.random() < 0.3:  # boilerplate inside the article too
            extra = f'<div data-content="0">{boiler(rnd.choice(["advert", "share", "notice", "side", "form", "comment", "comment"]))}</div>'
            inner = rnd.choice([inner + extra, head + extra + "".join(pieces)])
        kind, odd = rnd.random(), f' class="{name("odd")}"' if rnd.random() < 0.2 else plain()
        if kind < 0.5:
            return f'<article{odd} data-content="1">{inner}</article>'
        if kind < 0.65:
            return f'<main{odd} data-content="1">{wrapped(inner, 3)}</main>'
        if kind < 0.75:
            return f'<div data-content="1">{wrapped(inner, 2)}</div>'
        return f'<div class="{name("main")}" data-content="1">{inner}</div>'

    pages = []
    for _ in range(n):
        before = [wrapped(boiler(k), 2) for k in rnd.sample(["menu", "top", "notice", "advert", "form", "side"], rnd.randint(1, 4))]
        after = [wrapped(boiler(k), 2) for k in rnd.sample(["foot", "side", "advert", "comment", "form", "share", "menu", "notice"], rnd.randint(1, 5))]
        core = wrapped("".join(before) + wrapped(body(), 3) + "".join(after), 3)
        pages.append(f"<!DOCTYPE html><html><head><title>{prose(2, 6)}</title></head><body data-content=\"0\">{core}</body></html>")
    return pages


_TRAINED: dict[tuple[int, int], Model] = {}


def trained(n: int = 300, seed: int = 7) -> Model:
    """The model of labelled_pages(n, seed)."""
    if (n, seed) not in _TRAINED:
        _TRAINED[n, seed] = fit(labelled_pages(n, seed))
    return _TRAINED[n, seed]


def main_text(df: DataFrame, model: Model | None = None, source: str = "html", out: str = "text") -> DataFrame:
    """df without column source, with column out: the page's content blocks joined by one line end ("" for none).

    Null and empty pages, and pages without content, give "".  Repeated rows are
    rows of their own.  A page of any length is read whole, in time linear in its
    length.  A column of df with the name of out is replaced; an empty table
    gives no rows.
    """
    model = model or trained()
    weights, edge = model.weights, model.edge
    df = df.drop(out) if out in df.columns and out != source else df
    at = df.columns.index(source)
    rest = [f for f in df.schema.fields if f.name != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, edge)
        for batch in batches:
            texts = ["\n".join(own.extract(p.as_py())) for p in batch.column(at)]
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], names=[*(batch.schema.names[i] for i in keep), out])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.StringType())]))


def accuracy(model: Model, pages: list[str]) -> float:
    """Share of characters of labelled pages that get the right state."""
    right: Counter = Counter()
    for page in pages:
        root, blocks = parse(page)
        texts = {b.order: words(b) for b in blocks}
        nodes, content, _, _ = model.beliefs(root, texts)
        for x, p in zip(nodes, content, strict=True):
            if x.tag == "#text":
                right[(p > 0.5) == bool(x.label)] += len(texts[x.order])
    return right[True] / max(1, sum(right.values()))
