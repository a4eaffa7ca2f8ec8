"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements.  Every node is described by its tag, the
words in its id, class and role, its depth, the density of text and links in its
subtree and how it compares with its siblings.  Boosted regression trees, trained here
on made-up pages whose parts are known, give the log-odds that a node is boilerplate.

Decoding is hierarchical: going down from the root, a node's evidence is added to what
its ancestors passed on, and a text is kept or dropped with the closest decision above
it.  Once a node is dropped all that it holds is dropped, so no descendant can
contradict an ancestor.

What is never text (scripts, styles, comments, forms' controls) is left out by the
parser, and kept text is decoded, squeezed and joined in page order.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.llm.base import arrow_ready

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select svg math object audio video canvas".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
#: An opening tag that ends an open element of these, as in HTML's optional end tags.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of id, class and role that the trees may look at, one feature for each line.
WORD_GROUPS = (
    "article post entry story content main body text prose",
    "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs",
    "header head masthead banner topbar top hero branding logo",
    "footer foot bottom copyright legal colophon",
    "sidebar side aside rail widget related recommended more popular trending promo teaser",
    "ad ads advert advertisement adverts sponsor sponsored promotion dfp adsense",
    "comment comments disqus reply replies respond discussion reader reviews feedback",
    "cookie cookies consent gdpr notice notices alert popup modal overlay banner message toast",
    "share social sharing follow newsletter subscribe signup login search form subscription",
    "meta byline author date tags tag category caption credit",
)
_GROUPS = [frozenset(g.split()) for g in WORD_GROUPS]
_TAGS = ("article", "main", "section", "div", "p", "ul", "li", "table", "td", "nav", "header", "footer", "aside", "form", "h1", "h2", "h3", "blockquote", "pre", "figure", "dialog", "details", "address", "search")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|[^<]++|<", re.S)
#: A whole attribute, so that nothing inside a value or a longer name counts as one.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: What an open paragraph around does not reach into, and the end tags of raw elements.
_CELLS = frozenset("table td th".split())
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_NAMED = frozenset("id class role itemprop aria-label".split())
_NAME = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset = frozenset()
    hidden: bool = False
    children: list = field(default_factory=list)


class _Open:
    """The open elements, with counts, so that no question about them takes a walk that does not end in closing them."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#", 0)]
        self.tags: Counter = Counter()
        #: open paragraphs in each table or cell around
        self.paragraphs = [0]

    @property
    def node(self) -> int:
        return self.stack[-1][1]

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.tags[tag] += 1
        if tag in _CELLS:
            self.paragraphs.append(0)
        self.paragraphs[-1] += tag == "p"

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.tags[tag] -= 1
        self.paragraphs[-1] -= tag == "p"
        if tag in _CELLS:
            self.paragraphs.pop()
        return tag

    def close(self, tag: str) -> bool:
        """Closes the innermost ``tag`` and all in it, if one is open."""
        if not self.tags[tag]:
            return False
        while self.pop() != tag:
            pass
        return True

    def close_within(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Closes the innermost of ``tags`` unless a ``scope`` lies between."""
        if not any(self.tags[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in tags:
                while len(self.stack) > i:
                    self.pop()
            if tag in tags or tag in scope:
                return


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None, bool]]]:
    """Block nodes in page order, and the texts ``(node, text, in a link)`` with None texts at breaks.

    A tag ends at the first ``>`` outside of quotes, or where quotes are not closed at the
    first one; what looks like a tag and has no end is text.  Time is linear in the page.
    """
    nodes = [Node("#", -1, 0)]
    texts: list[tuple[int, str | None, bool]] = []
    stack = _Open()
    in_link = False
    at, end, last = 0, len(page), page.rfind(">")
    unclosed: set[str] = set()
    while at < end:
        if page[at] == "<" and at > last and not page.startswith("<!--", at):
            texts.append((stack.node, "<", in_link))
            at += 1
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                texts.append((stack.node, piece, in_link))
            continue
        name = name.lower()
        if slash:
            if name == "a":
                in_link = False
            elif name == "p" and not stack.tags["p"]:
                texts.append((stack.node, None, False))
            elif name in BLOCK and stack.close(name):
                in_link = False
            continue
        if name in RAW:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            close = None if name in unclosed else _CLOSE[name].search(page, at)
            if close is not None:
                at = close.end()
            else:
                unclosed.add(name)  # none further on either
                if name in ("script", "style", "title", "textarea", "noscript", "iframe"):
                    at = end
            continue
        if name == "br" or name == "hr":
            texts.append((stack.node, " ", in_link))
            continue
        if name == "a":
            in_link = True
            continue
        if name in VOID or name not in BLOCK:
            continue
        if stack.paragraphs[-1] and name != "caption":
            stack.close("p")
        if name in _ENDS:
            stack.close_within(_ENDS[name], _SCOPE[name])
        words, hidden = frozenset(), False
        if attributes:
            found = set()
            for attribute in _ATTRIBUTE.finditer(attributes):
                key = attribute[1].lower()
                value = attribute[2] or attribute[3] or attribute[4] or ""
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    hidden = True
                elif key in _NAMED:
                    found.update(_NAME.findall(re.sub("([a-z])([A-Z])", r"\1 \2", value).lower()))
            words = frozenset(found)
        top = stack.node
        node = Node(name, top, nodes[top].depth + 1, words, hidden)
        nodes[top].children.append(len(nodes))
        stack.push(name, len(nodes))
        nodes.append(node)
        in_link = False
    return nodes, texts


def features(nodes: list[Node], texts: list[tuple[int, str | None, bool]]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    chars, links, words, stops, paragraphs = (np.zeros(n) for _ in range(5))
    for node, text, linked in texts:
        if text:
            size = len(text.strip())
            chars[node] += size
            links[node] += size * linked
            words[node] += text.count(" ") + 1 if size else 0
            stops[node] += text.count(".") + text.count(",")
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        paragraphs[i] += nodes[i].tag == "p" and chars[i] > 40
        for a in (chars, links, words, stops, paragraphs):
            a[p] += a[i]
    size = np.ones(n)
    for i in range(n - 1, 0, -1):
        size[nodes[i].parent] += size[i]
    total = max(1.0, chars[0])
    rows = np.zeros((n, 12 + len(_GROUPS) + len(_TAGS)), np.float32)
    alike = Counter((node.parent, node.tag) for node in nodes)
    for i, node in enumerate(nodes):
        siblings = nodes[node.parent].children if i else [0]
        above = max(1.0, chars[node.parent]) if i else total
        rows[i, :12] = (
            node.depth, np.log1p(chars[i]), links[i] / max(1.0, chars[i]), chars[i] / total, chars[i] / above, np.log1p(chars[i] / size[i]),
            stops[i] / max(1.0, words[i]), np.log1p(paragraphs[i]), np.log1p(len(node.children)), np.log1p(len(siblings)), alike[node.parent, node.tag] / len(siblings), i / n,
        )
        if node.words:
            rows[i, 12 : 12 + len(_GROUPS)] = [bool(node.words & g) for g in _GROUPS]
        if node.tag in _TAGS:
            rows[i, 12 + len(_GROUPS) + _TAGS.index(node.tag)] = 1
    return rows


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 24, least: int = 12):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            which, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(len(y), int)
            for node in range(size):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * gs / (hs + 1)
                if node >= 2**self.depth - 1 or len(rows) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = binned[rows, f]
                    gl = np.cumsum(np.bincount(k, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(k, h[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (gain[i], f, i)
                if best[1] >= 0:
                    _, f, i = best
                    which[node], cut[node] = f, cuts[f][i]
                    at[rows] = 2 * node + 1 + (binned[rows, f] > i)
            self.trees.append((which, cut, value))
            score += self._tree(self.trees[-1], x)
        return self

    def _tree(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        which, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = which[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))


def made_up_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page of random layout, and the marker words of its boilerplate."""
    syllables = ["ta", "ren", "mo", "li", "ver", "so", "chen", "qui", "ado", "ing", "é", "ß"]
    marks: set[str] = set()
    count = [0]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))

    def sentence(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ".", "!", "?", ""])

    tiny = rng.random() < 0.2

    def prose(low: int, high: int) -> str:
        if tiny:
            return sentence(rng.randrange(1, 9))
        return " ".join(sentence(rng.randrange(4, 16)) for _ in range(rng.randrange(low, high)))

    def junk(text: str) -> str:
        count[0] += 1
        mark = f"zz{count[0]}zz"
        marks.add(mark)
        return f"{text} {mark}"

    def named(*names: str) -> str:
        if rng.random() < 0.15:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "", "-box", "_area", " wide", " clearfix", "-1"])}"'

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link(junk(word()))}</li>" for _ in range(n)) + "</ul>"

    def menu() -> str:
        tag = rng.choice(["nav", "nav", "div", "ul"])
        if tag == "ul":
            return f"<ul{named('menu', 'nav', 'navigation')}>" + "".join(f"<li>{link(junk(word()))}</li>" for _ in range(rng.randrange(3, 9))) + "</ul>"
        return f"<{tag}{named('menu', 'nav', 'navbar', 'breadcrumb', 'main-navigation')}>{links(rng.randrange(2, 10))}</{tag}>"

    def head() -> str:
        tag = rng.choice(["header", "div"])
        names = named("header", "masthead", "site-header", "topbar", "branding")
        return f"<{tag}{names or ' class=site-header'}>{rng.choice(['<h2>', '<div>', '<p>'])}{junk(sentence(rng.randrange(1, 6)))}{menu() if rng.random() < 0.5 else ''}</{tag}>"

    def foot() -> str:
        tag = rng.choice(["footer", "footer", "div"])
        names = named("footer", "site-footer", "copyright", "legal", "bottom")
        return f"<{tag}{names or ' id=footer'}>{rng.choice(['', '&copy; '])}{junk(prose(1, 4))}{links(3) if rng.random() < 0.4 else ''}</{tag}>"

    def side() -> str:
        tag = rng.choice(["aside", "aside", "div"])
        names = named("sidebar", "side", "widget", "related", "recommended", "popular", "rail")
        body = rng.choice([lambda: f"<h3>{junk(word())}</h3>{links(rng.randrange(2, 7))}", lambda: f"<p>{junk(prose(1, 4))}</p>", lambda: "".join(f"<p>{junk(prose(1, 3))}</p>" for _ in range(3))])()
        return f"<{tag}{names or ' class=sidebar'}>{body}</{tag}>"

    def advert() -> str:
        return f'<div class="{rng.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "advertisement", "promo"])}">{rng.choice(["", "<p>"])}{junk(prose(1, 4))}</div>'

    def notice() -> str:
        tag = rng.choice(["div", "div", "section", "dialog", "p"])
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["cookie", "cookie-banner", "notice", "consent", "gdpr-notice", "alert", "popup", "newsletter", "subscribe"])}">{junk(prose(1, 4))}</{tag}>'

    def form() -> str:
        return f"<form{named('search', 'login', 'signup', 'newsletter')}><label>{junk(sentence(3))}</label><input name=q><button>{junk(word())}</button></form>"

    def comments() -> str:
        tag = rng.choice(["section", "div", "div", "ol"])
        inner = "li" if tag == "ol" else rng.choice(["div", "article", "p"])
        one = lambda: f"<{inner}{named('comment', 'reply', 'comment-body')}>{rng.choice(['', '<b>' + junk(word()) + '</b> '])}{'<p>' if inner != 'p' and rng.random() < 0.6 else ''}{junk(prose(1, 5))}</{inner}>"
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "responses reader-comments", "disqus_thread", "reviews"])}">{rng.choice(["", "<h3>" + junk("Comments") + "</h3>"])}{"".join(one() for _ in range(rng.randrange(1, 7)))}</{tag}>'

    def share() -> str:
        return f'<div class="{rng.choice(["share", "social", "sharing-buttons"])}">{links(3)}</div>'

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            return rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br><p>", "<p>{}</p>"]).format(prose(1, 9))
        if kind < 0.78:
            return f"<h{(k := rng.choice('23'))}>{sentence(rng.randrange(1, 7))}</h{k}>"
        if kind < 0.85:
            return rng.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{prose(1, 3)}</li>" for _ in range(rng.randrange(2, 6))))
        if kind < 0.9:
            return f"<blockquote>{rng.choice(['', '<p>'])}{prose(1, 4)}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{sentence(2)}</td><td>{sentence(2)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<pre>{prose(1, 3)}</pre>"
        return f"<div>{prose(1, 6)}</div>"

    blocks = [block() for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20]))]
    for extra in (advert, share, form, notice, side):
        if rng.random() < 0.12:
            blocks.insert(rng.randrange(len(blocks) + 1), extra())
    body = "".join(blocks)
    if rng.random() < 0.75:
        body = f"<h1>{sentence(rng.randrange(2, 12))}</h1>" + body
    if rng.random() < 0.2:
        body = f"<div>{body}</div>"
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    names = named("article", "content", "post", "entry-content", "story", "main", "post-body", "text")
    if tag in ("div", "section") and not names:
        names = rng.choice(['', ' id="content"', ' class="page"'])
    main = f"<{tag}{names}>{body}{comments() if rng.random() < 0.15 else ''}</{tag}>"
    if rng.random() < 0.3:
        main = f"<{rng.choice(['div', 'main'])}{named('main', 'container', 'wrapper', 'page', 'content')}>{main}{side() if rng.random() < 0.4 else ''}</div>"
    before = [f() for f in (notice, head, menu, advert, form, side) if rng.random() < 0.4]
    after = [f() for f in (comments, side, advert, share, form, notice, menu) if rng.random() < 0.35]
    if rng.random() < 0.85:
        after.append(foot())
    if rng.random() < 0.4:
        before.insert(0, menu())
    end = rng.choice(["</body></html>", ""])
    return f"<!DOCTYPE html><html><head><title>{sentence(4)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{main}{''.join(after)}{end}", marks


#: Made-up pages the trees are trained on.
TRAINING_PAGES = 1_000


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> Boosted:
    """Trees that tell nodes all of whose text is boilerplate from the others."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, _ = made_up_page(rng)
        nodes, texts = parse(page)
        x = features(nodes, texts)
        good, bad = np.zeros(len(nodes)), np.zeros(len(nodes))
        for node, text, _ in texts:
            if text and text.strip():
                (bad if "zz" in text else good)[node] += 1
        for i in range(len(nodes) - 1, 0, -1):
            good[nodes[i].parent] += good[i]
            bad[nodes[i].parent] += bad[i]
        some = (good + bad) > 0
        xs.append(x[some])
        ys.append(((bad > 0) & (good == 0))[some])
    return Boosted().fit(np.vstack(xs), np.concatenate(ys).astype(float))


_PAGES_AT_ONCE = 256

#: Share of an ancestor's evidence that reaches its children, and of log-odds at which a node goes.
INHERIT, CUT = 0.5, 0.0


def dropped(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes go: top down, so that all below a dropped node is dropped too."""
    gone = np.zeros(len(nodes), bool)
    evidence = np.zeros(len(nodes))
    for i, node in enumerate(nodes):
        if i == 0:
            continue
        up = node.parent
        evidence[i] = odds[i] + INHERIT * evidence[up] * (nodes[up].tag not in ("#", "html", "body"))
        gone[i] = gone[up] or ((node.hidden or evidence[i] > CUT) and node.tag not in ("html", "body"))
    return gone


def _joined(nodes: list[Node], texts: list[tuple[int, str | None, bool]], odds: np.ndarray) -> str:
    gone = dropped(nodes, odds)
    pieces, last = [], None
    for node, text, _ in texts:
        if node != last:
            pieces.append(" ")
            last = node
        pieces.append(" " if text is None or gone[node] else text)
    return " ".join(html.unescape("".join(pieces)).split())


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """The kept blocks of each page, in order, joined by single spaces; the trees run once over all pages."""
    out = []
    for start in range(0, len(pages), _PAGES_AT_ONCE):
        parsed = [parse(p or "") for p in pages[start : start + _PAGES_AT_ONCE]]
        odds = model.log_odds(np.vstack([features(*p) for p in parsed]))
        at = np.cumsum([0] + [len(nodes) for nodes, _ in parsed])
        out += [_joined(nodes, texts, odds[a:b]) for (nodes, texts), a, b in zip(parsed, at[:-1], at[1:])]
    return out


def main_text(page: str | None, model: Boosted) -> str:
    return main_texts([page], model)[0]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per input row.

    A null page is empty and gives an empty text; n_chars counts code points.  Repeated
    rows and null ids pass through; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained(training_pages))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = main_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return arrow_ready(base).mapInArrow(rows, "page_id long, url string, text string, n_chars long")
