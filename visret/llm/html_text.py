"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements and, as leaves, runs of text. Every node has features of
its tag, attribute words, depth, ancestors, subtree density and siblings. Gradient-boosted trees
say how likely it holds main text. Decoding keeps the set of nodes with the largest sum of
log-odds in which a kept node has a kept parent, so no choice contradicts one above or below it.
"""

import html
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML elements by what they do to the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())  # only their own closing tag ends them
GONE = frozenset("template svg math iframe noscript object canvas audio video".split())  # elements without main text
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label ruby rt rp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag closes an open element of its group, unless one of the named containers is between.
GROUPS = {**dict.fromkeys(["li"], ({"li"}, {"ul", "ol", "menu"})), **dict.fromkeys(["dt", "dd"], ({"dt", "dd"}, {"dl"})),
          **dict.fromkeys(["tr"], ({"tr", "td", "th"}, {"table"})), **dict.fromkeys(["td", "th"], ({"td", "th"}, {"tr", "table"})),
          **dict.fromkeys(["option"], ({"option"}, {"select"}))}
# Words in tags, classes, ids and roles, by what they tell.
WORDS = {
    "main": "article main content post entry body story text articlebody maincontent hentry blogpost prose page",
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip sitemap",
    "head": "header masthead banner top topbar logo branding site hero",
    "foot": "footer foot copyright colophon contentinfo bottom legal credits",
    "side": "aside sidebar side rail secondary complementary widget widgets related recommended popular trending more teaser",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted dfp adsense commercial outbrain taboola",
    "note": "cookie cookies consent notice gdpr popup modal overlay alert privacy dialog paywall message toast disclaimer warning",
    "form": "form newsletter subscribe subscription signup login search input button select fieldset contact register",
    "talk": "comment comments commentlist disqus reply replies respond discussion thread feedback reviews review responses",
    "share": "share sharing social follow facebook twitter tweet print email tags tagged meta byline author",
}
KINDS = list(WORDS)
BIT = {w: 1 << k for k, ws in enumerate(WORDS.values()) for w in ws.split()}
TAGS = ["html", "body", "main", "article", "section", "div", "p", "headings", "lists", "li", "table", "quote", "nav", "header", "footer", "aside", "form", "figure", "other"]
TAG = {**{t: TAGS.index(t) for t in TAGS if t not in ("headings", "lists", "quote", "other")},
       **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), TAGS.index("headings")), **dict.fromkeys(("ul", "ol", "dl", "menu"), TAGS.index("lists")),
       **dict.fromkeys(("dt", "dd"), TAGS.index("li")), **dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), TAGS.index("table")),
       **dict.fromkeys(("blockquote", "pre", "q"), TAGS.index("quote")), "figcaption": TAGS.index("figure"), "picture": TAGS.index("figure"),
       **dict.fromkeys(("button", "select", "option", "fieldset", "search"), TAGS.index("form"))}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
VALUE_OR_END = re.compile(r"=\s*([\"'])|>")
ATTR = re.compile(r"(?<![^\s/\"'])([^\s=/\"'>]++)\s*+=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
HINTS = frozenset(("class", "id", "role", "itemprop", "aria-label", "data-component"))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Nodes in page order: parent, tag group, own word bits, depth; text and link characters of
    leaves. ``texts`` has the text of each leaf, else None."""

    def __init__(self):
        self.parent, self.tag, self.bits, self.depth, self.chars, self.linked, self.texts, self.mark = [], [], [], [], [], [], [], []

    def add(self, parent: int, tag: int, bits: int, depth: int, chars: int = 0, linked: int = 0, text=None, mark=None) -> int:
        for column, x in zip((self.parent, self.tag, self.bits, self.depth, self.chars, self.linked, self.texts, self.mark),
                             (parent, tag, bits, depth, chars, linked, text, mark), strict=True):
            column.append(x)
        return len(self.parent) - 1


def hints(tag: str, attrs: str, marks: bool) -> tuple[int, bool, str | None]:
    """Word bits of an element, whether it is hidden, and with ``marks`` its data-main."""
    bits, hidden, mark = BIT.get(tag, 0), False, None
    for name, value in ATTR.findall(attrs) if "=" in attrs else ():
        name = name.lower()
        if name in HINTS:
            for w in WORD.findall(value):
                bits |= BIT.get(w.lower(), 0)
        elif name == "style":
            hidden = bool(HIDDEN.search(value))
        elif marks and name == "data-main":
            mark = value.strip("\"'")
    return bits, hidden, mark


def tokens(source: str):
    """(text, tag, closes, attributes) of each piece of a page; either text or tag is empty.

    Every search goes on from where the one before ended, and one that has found nothing is not
    made again, so any page takes time in proportion to its length. A quoted value that nothing
    closes ends with its tag, a tag that nothing closes is text, a comment or script that nothing
    closes reaches to the end."""
    at, n, quotes, tags = 0, len(source), {'"': True, "'": True}, True
    while at < n:
        lt = source.find("<", at) if tags else -1
        if lt < 0:
            yield source[at:], "", False, ""
            return
        if lt > at:
            yield source[at:lt], "", False, ""
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        closes = source.startswith("</", lt)
        name = NAME.match(source, lt + 1 + closes)
        if not name:
            end = source.find(">", lt) if source[lt + 1:lt + 2] in ("!", "?", "/") else -2
            if end >= 0:
                at = end + 1
                continue
            tags = end == -2
            yield "<", "", False, ""
            at = lt + 1
            continue
        stop = name.end()
        while m := VALUE_OR_END.search(source, stop):
            stop = m.end()
            if not m[1]:
                break
            close = source.find(m[1], stop) if quotes[m[1]] else -1
            if close < 0:
                quotes[m[1]] = False
            else:
                stop = close + 1
        if not m:  # quotes swallow all to the end: from here on they don't count
            quotes = dict.fromkeys(quotes, False)
            stop = source.find(">", name.end()) + 1
            if not stop:
                tags = False
                yield "<", "", False, ""
                at = lt + 1
                continue
        tag, at = name[0].lower(), stop
        yield "", tag, closes, source[name.end():stop - 1]
        if tag in RAW and not closes:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = (source.find(">", end.end()) + 1 or n) if end else n


def parse(source: str, *, marks: bool = False) -> Page:
    """The tree of a page; with ``marks`` (training pages only) data-main tells what is main."""
    page = Page()
    stack = [("#root", page.add(-1, TAG["html"], 0, 0))]  # (tag, node) of open elements; inline ones share their block's node
    places: dict[str, list[int]] = {}  # tag -> where in the stack it is open
    blocks = [0]  # where in the stack elements are open that part texts
    run: list[str] = []
    links = linked = gone = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            node = stack[-1][1]
            page.add(node, page.tag[node], 0, page.depth[node] + 1, len(text), min(linked, len(text)), text)
        run.clear()
        linked = 0

    def close(to: int):
        nonlocal links, gone
        if blocks[-1] >= to:
            flush()
        while len(stack) > to:
            tag = stack.pop()[0]
            places[tag].pop()
            links -= tag == "a"
            gone -= tag in GONE
        while blocks[-1] >= to:
            blocks.pop()

    def start(tag: str, node: int, block: bool = True):
        nonlocal links, gone
        links += tag == "a"
        gone += tag in GONE
        if block:
            blocks.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
    for text, tag, closes, attrs in tokens(source):
        if text:
            if not gone:
                piece = html.unescape(text) if "&" in text else text
                run.append(piece)
                if links:
                    linked += len(piece)
        elif closes:
            at = last((tag,))
            if at and (tag not in INLINE or at >= blocks[-1]):
                close(at)
            if tag == "br" and not gone:
                run.append(" ")
        elif tag in VOID:
            if tag in ("br", "hr") and not gone:
                run.append(" ")
            if tag == "hr":
                flush()
        elif tag not in RAW:
            if tag in ENDS_P and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if tag in GROUPS:
                same, walls = GROUPS[tag]
                wall, at = last(walls), last(same)
                if at > wall:
                    above = [x[bisect_right(x, wall)] for t in same if (x := places.get(t)) and x[-1] > wall]
                    close(min(above) if tag == "tr" else at)
            bits, hidden, mark = hints(tag, attrs, marks)
            node = stack[-1][1]
            if gone or tag in GONE:  # open elements without nodes, which end with their parent at the latest
                flush()
                start(tag, node)
            elif tag in INLINE and not hidden and mark is None:
                start(tag, node, False)
            else:
                flush()
                start(tag, page.add(node, TAG.get(tag, TAGS.index("other")), bits | (hidden and BIT["popup"]), page.depth[node] + 1, mark=mark))
            if attrs.endswith("/") and tag not in TAG:
                close(len(stack) - 1)
    flush()
    return page


def stacked(columns: list) -> np.ndarray:
    out = np.empty((len(columns[0]), len(columns)), np.float32)
    for i, c in enumerate(columns):
        out[:, i] = c
    return out


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each node of the pages, one page after another, and each node's parent."""
    base, rows, parents = 0, [], []
    for p in pages:
        n = len(p.parent)
        parent, chars, linked = p.parent, p.chars[:], p.linked[:]
        count, leaves, kids = [1] * n, [int(t is not None) for t in p.texts], [0] * n
        above, alike, before, own = [0] * n, {}, [0] * n, p.chars
        for i in range(1, n):
            q = parent[i]
            above[i] = above[q] | p.bits[q]
            before[i] = kids[q]
            kids[q] += 1
            key = (q, p.tag[i], own[i] > 0)
            alike[key] = alike.get(key, 0) + 1
        for i in range(n - 1, 0, -1):
            q = parent[i]
            chars[q] += chars[i]
            linked[q] += linked[i]
            count[q] += count[i]
            leaves[q] += leaves[i]
        prior, after, last = [0] * n, [0] * n, {}
        for i in range(1, n):
            if (j := last.get(parent[i])) is not None:
                prior[i], after[j] = chars[j], chars[i]
            last[parent[i]] = i
        total, q = max(1, chars[0]), np.array(parent)
        up = np.maximum(q, 0)
        c, k, pos = np.array(chars, float), np.array(kids), np.array(before)
        same = np.array([alike.get((parent[i], p.tag[i], own[i] > 0), 1) for i in range(n)])
        marks = np.array([sum(map(t.count, ".,;:!?")) if t else 0 for t in p.texts], float)
        rows.append(stacked([
            p.depth, [t is not None for t in p.texts], np.log1p(c), np.array(linked) / np.maximum(c, 1), c / np.array(count),
            np.log1p(leaves), k, same, pos, (pos + 1) / np.maximum(k[up], 1), c / np.maximum(c[up], 1), c / total,
            np.log1p(prior), np.log1p(after), marks / np.maximum(c, 1), np.arange(n) / n, p.tag, np.array(p.tag)[up],
            *[(np.array(x)[:, None] >> np.arange(len(KINDS)) & 1).T[j] for x in (p.bits, above) for j in range(len(KINDS))],
            *[np.array(p.tag) == t for t in range(len(TAGS))]]))
        parents.append(np.where(q >= 0, q + base, -1))
        base += n
    return np.concatenate(rows), np.concatenate(parents)


class Trees:
    """Gradient-boosted regression trees on log-loss, over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Trees":
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self.binned(x)
        self.start = float(np.log((y @ weight + 1) / ((1 - y) @ weight + 1)))
        score, self.made = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node, split = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                width, size = 1 << level, self.bins
                best, chosen = np.zeros(width), np.full((width, 2), -1)
                for f, b in enumerate(binned):
                    slot = node * size + b
                    sg = np.bincount(slot, g, width * size).reshape(width, size).cumsum(1)
                    sh = np.bincount(slot, h, width * size).reshape(width, size).cumsum(1)
                    ag, ah = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.ridge) + (ag - sg)**2 / (ah - sh + self.ridge) - ag**2 / (ah + self.ridge)
                    at = gain[:, :-1].argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-9
                    best[better], chosen[better] = top[better], np.c_[np.full(width, f), at][better]
                split.append(chosen)
                f, t = chosen[node].T
                node = 2 * node + ((f >= 0) & (binned[np.maximum(f, 0), np.arange(len(y))] > t))
            leaf = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge)
            score += leaf[node]
            self.made.append((split, leaf))
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left").astype(np.uint8) for f, c in enumerate(self.cuts)])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        out, every = np.full(len(x), self.start), np.arange(len(x))
        for split, leaf in self.made:
            node = np.zeros(len(x), np.int64)
            for chosen in split:
                f, t = chosen[node].T
                node = 2 * node + ((f >= 0) & (binned[np.maximum(f, 0), every] > t))
            out += leaf[node]
        return out


def kept(page: Page, odds: np.ndarray) -> list[bool]:
    """The set of nodes with the largest sum of log-odds in which a kept node has a kept parent."""
    gain = [float(o) * (1 + np.log1p(c)) for o, c in zip(odds, page.chars, strict=True)]
    parent = page.parent
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = [True] * len(gain)
    for i in range(1, len(gain)):
        keep[i] = keep[parent[i]] and gain[i] > 0
    return keep


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """Texts of the kept leaves, in page order."""
    return [t for t, k in zip(page.texts, kept(page, odds), strict=True) if t is not None and k]


def labels_of(page: Page) -> np.ndarray:
    """1 for leaves under a main element and not under a marked or known side element, and for all
    elements above such leaves. The nearest element that tells decides."""
    main = {TAGS.index("article"), TAGS.index("main")}
    side = {TAGS.index(t) for t in ("nav", "footer", "aside", "form")}
    inside, y = [False] * len(page.parent), np.zeros(len(page.parent))
    for i in range(1, len(y)):
        q = page.parent[i]
        if page.texts[i] is not None:
            inside[i] = inside[q]
        elif page.mark[i] is not None:
            inside[i] = page.mark[i] == "1"
        else:
            inside[i] = page.tag[i] in main or inside[q] and page.tag[i] not in side and not page.bits[i] & BIT["ads"]
        if inside[i] and page.texts[i] is not None:
            while i >= 0 and not y[i]:
                y[i], i = 1, page.parent[i]
    return y


# Openings of page parts in common layouts; {} is the part.
LAYOUTS = {
    "main": ["<article data-main=1>{}</article>", "<main data-main=1>{}</main>", "<main><article data-main=1>{}</article></main>",
             '<div class="post-content" data-main=1>{}</div>', '<div id="content" data-main=1>{}</div>', '<div role="main" data-main=1>{}</div>',
             '<section class="entry" data-main=1>{}</section>', '<div class="article-body" data-main=1>{}</div>', '<div data-main=1>{}</div>',
             '<div id="main"><div class="story" data-main=1>{}</div></div>', "<div><div data-main=1>{}</div></div>"],
    "nav": ["<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<ul class="navbar">{}</ul>', '<div role="navigation">{}</div>', '<div class="breadcrumbs">{}</div>', "<div>{}</div>"],
    "head": ["<header>{}</header>", '<div class="site-header">{}</div>', '<div id="masthead">{}</div>', '<div role="banner">{}</div>'],
    "foot": ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<div role="contentinfo">{}</div>'],
    "side": ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar" class="widget">{}</div>', '<section class="related">{}</section>', '<aside class="related-posts">{}</aside>', '<div role="complementary">{}</div>'],
    "ad": ['<div class="ad">{}</div>', '<div class="advert">{}</div>', '<div id="ads">{}</div>', '<section class="sponsored">{}</section>', '<div class="promo">{}</div>', '<aside class="advertisement">{}</aside>', '<p class="ad">{}</p>'],
    "note": ['<div class="cookie-notice">{}</div>', '<div id="cookie-consent" role="dialog">{}</div>', '<div class="notice">{}</div>', '<div class="gdpr popup">{}</div>', '<p class="notice">{}</p>', '<div role="alert">{}</div>'],
    "form": ["<form>{}</form>", '<form class="newsletter">{}</form>', '<div class="subscribe">{}</div>', '<form id="search">{}</form>'],
    "talk": ['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div class="comment-list">{}</div>', '<section id="comments">{}</section>', '<div id="disqus_thread">{}</div>', '<div class="comments">{}</div>'],
    "share": ['<div class="share">{}</div>', '<ul class="social">{}</ul>', '<div class="tags">{}</div>'],
}
SIDE = [k for k in LAYOUTS if k != "main"]


def layout(rng: np.random.Generator, pool: list[str]) -> str:
    """A page of a random layout with texts from ``pool``; its main part carries data-main=1 and
    side parts inside it data-main=0."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    text = lambda: html.escape(pick(pool), quote=False)
    short = lambda: " ".join(text().split()[: rng.integers(1, 9)])
    item = lambda: f'<li><a href="/x">{short()}</a></li>'

    def part(kind: str, inside: bool) -> str:
        if kind in ("nav", "share") or kind == "side" and rng.random() < 0.5:
            body = "<ul>" + "".join(item() for _ in range(rng.integers(2, 8))) + "</ul>"
        elif kind == "talk":
            how = pick(["<p>{}</p>", '<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', "<div><b>{}</b></div>"])
            body = ("<h3>" + short() + "</h3>") * int(rng.random() < 0.5) + "".join(how.format(text()) for _ in range(rng.integers(1, 6)))
        elif kind == "form":
            body = f"<label>{short()}</label><input><button>{short()}</button>" + f"<p>{short()}</p>" * int(rng.random() < 0.5)
        else:
            body = pick(["{}", "<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>"]).format(text() if rng.random() < 0.5 else short())
        out = pick([x for x in LAYOUTS[kind] if not inside or x != "<div>{}</div>"]).format(body)
        return re.sub(r"^<(\w+)", r"<\1 data-main=0", out) if inside else out

    def paragraph() -> str:
        r = rng.random()
        if r < 0.76:
            return f"<p>{text()}" + "</p>" * int(rng.random() < 0.8)
        if r < 0.82:
            return f"<h2>{short()}</h2>"
        if r < 0.88:
            how = pick(["<li>{}</li>", "<li>{}", '<li><a href="/x">{}</a></li>'])
            return "<ul>" + "".join(how.format(short() if rng.random() < 0.5 else text()) for _ in range(rng.integers(2, 5))) + "</ul>"
        if r < 0.92:
            return f"<blockquote><p>{text()}</p></blockquote>"
        if r < 0.94:
            return f"<table><tr><td>{short()}</td><td>{short()}</td></tr></table>"
        if r < 0.96:
            return f"<figure><figcaption>{short()}</figcaption></figure>"
        return pick(["<pre>{}</pre>", "<pre><code>{}</code></pre>", "<div>{}</div>"]).format(text() if rng.random() < 0.5 else short())

    core = [f"<h1>{short()}</h1>"] * int(rng.random() < 0.8) + [paragraph() for _ in range(pick([rng.integers(1, 10)] * 34 + [rng.integers(10, 60)] * 5 + [rng.integers(60, 300)]))]
    for kind in SIDE:
        if rng.random() < 0.12:
            core.insert(int(rng.integers(1, len(core) + 1)), part(kind, True))
    if rng.random() < 0.15:
        core.append(part("talk", True))
    parts = [part(k, False) for k in ("nav", "head", "note", "ad", "side") if rng.random() < 0.45] + [pick(LAYOUTS["main"]).format("".join(core))]
    parts += [part(k, False) for k in ("share", "side", "ad", "talk", "form", "note", "nav", "foot") if rng.random() < 0.45]
    body = "".join(parts)
    if rng.random() < 0.4:
        body = pick(['<div id="page">{}</div>', '<div class="wrapper">{}</div>', '<div class="site-content">{}</div>', "<div>{}</div>"]).format(body)
    return f"<html><body>{body}</body></html>"


#: The model is fitted on so many pages at most, those of the smallest hash that together have no more
#: than so many characters (a page of more than a quarter of that is passed over); and on so many
#: made layouts.
SAMPLE, SAMPLE_CHARS, MADE = 200, 8 << 20, 900
#: Characters of pages whose nodes are scored at a time (one page at least).
AT_ONCE = 1 << 20


def fit(pages: DataFrame, *, source: str = "html") -> Trees:
    """Trees fitted on a bounded sample of ``pages``, labelled by their own article and main
    elements where they have any, and on made layouts that carry the texts of all sampled pages.
    Without any text in the sample the layouts carry letters."""
    share = min(1.0, 2 * SAMPLE / max(1, pages.count()))  # so that tasks send the driver a few rows, not SAMPLE each
    draw = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30))
    few = pages.where(draw < share * (1 << 30)).select(draw.alias("h"), F.coalesce(source, F.lit("")).alias("html"))
    few, taken, total = few.where(F.length("html") <= SAMPLE_CHARS // 4), [], 0
    for h, n in few.select("h", F.length("html").alias("n")).orderBy("h", "n").limit(SAMPLE).collect():
        if total + n <= SAMPLE_CHARS:
            taken.append(h)
            total += n
    rows = few.where(F.col("h").isin(taken)).orderBy("h", F.length("html"), "html").limit(len(taken)).collect() if taken else []
    every = [parse(r["html"]) for r in rows]
    real = [p for p in every if labels_of(p).any()]
    pool = [t for p in every for t in p.texts if t] or ["A b c.", "D e f, g h i j k.", "l m"]
    rng = np.random.default_rng(11)
    made = [parse(layout(rng, pool), marks=True) for _ in range(MADE)]
    x, _ = features(real + made)
    y = np.concatenate([labels_of(p) for p in real + made])
    size = np.concatenate([[len(p.parent)] * len(p.parent) for p in real + made])
    return Trees().fit(x, y, np.sqrt(30 / size) * (0.5 + np.expm1(x[:, 2]).clip(0, 200) / 200))


def extractor(spark, model: Trees):
    """A column function: html -> main text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StringType())
    def extract(source: pa.Array) -> pa.Array:
        out, some, size = [], [], 0

        def done():
            if some:
                x, _ = features(some)
                odds, at = shared.value.log_odds(x), 0
                for p in some:
                    out.append(" ".join(decode(p, odds[at:at + len(p.parent)])))
                    at += len(p.parent)
                some.clear()

        for s in source.to_pylist():
            if size + len(s or "") > AT_ONCE:
                done()
                size = 0
            some.append(parse(s or ""))
            size += len(s or "")
        done()
        return pa.array(out, pa.string())

    return extract.asNondeterministic()


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; null and empty pages have an empty text.
    Repeated rows and null ids are read each; nothing of a kept block is dropped or cut. Pages of
    any length are read whole, in time in proportion to it; other columns are not read."""
    f = extractor(pages.sparkSession, fit(pages))
    return (pages.select("page_id", "url", f(F.col("html")).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
