"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into blocks, the runs of text between block-level tags, each with the path of tags,
classes and ids above it. A bidirectional LSTM in numpy reads the whole sequence of a page's blocks,
as sums of hashed path tokens, hashed words and a few numbers, and labels every block main text or
not, with the rest of the page as context. It is trained on made pages of many layouts, whose labels
are known, and on a bounded sample of the table's own pages that mark their article plainly.
Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm import lstm
from trafficwarden.llm.common import absent, hash_sample, slices
from trafficwarden.llm.neardup import run_hashes

#: Bound of the sample of the table's pages: rows, and characters of each.
SAMPLE_ROWS, SAMPLE_LONGEST = 200, 60_000
HIDDEN, EPOCHS, MADE = 16, 6, 400
#: Steps times pages that are labelled at once (a longer page is alone), and slots that are summed at once.
CELLS, SUMMED = 1 << 16, 1 << 20
PATH_SLOTS, PATH_SIZE, WORD_SLOTS, WORD_SIZE, NUMBERS = 2048, 16, 1024, 6, 6

# Element classes of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "iframe", "noembed", "noframes"}
UNSHOWN = {"noscript", "template"}
#: Elements of other vocabularies, what in them is never shown, and the start tags that end them where they weren't closed.
FOREIGN = {"svg", "math"}
FOREIGN_UNSHOWN = {"title", "desc", "metadata", "annotation", "annotation-xml"}
ENDS_FOREIGN = set("article aside b big blockquote body br center code dd div dl dt em embed figure footer form h1 h2 h3 h4 h5 h6 head header hr i img li listing main menu meta nav nobr ol p pre ruby s section small span strong strike sub sup table tt u ul var".split())
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "object", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A start tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in classes, ids or roles that mark what isn't the article, for the labels of sampled pages.
ASIDE = re.compile(r"\b(nav|menu|footer|header|sidebar|aside|ad|ads|advert|advertisement|banner|cookie|consent|notice|promo|comment|comments|reply|respond|share|social|related|recommended|newsletter|subscribe|signup|login|breadcrumb|breadcrumbs|pagination|widget|popup|modal|hidden)\b")

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
MARK = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN_MARK = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


@lru_cache(maxsize=1 << 16)
def _slots_of(marks: str) -> tuple[frozenset[int], frozenset[int]]:
    """Slots of the words of an element, as one above a block and as the nearest one."""
    words = [w for w in re.split(r"[^a-z0-9]+", marks) if w]
    return frozenset(_slot(f"in:{w}", PATH_SLOTS) for w in words), frozenset(_slot(f"leaf:{w}", PATH_SLOTS) for w in words)


class Node:
    """An open element: its name, and slots of all elements from the root to it. Slots that add nothing are shared, so depth costs no memory."""

    __slots__ = ("inside", "leaf", "main", "name")

    def __init__(self, name: str = "", marks: str = "", parent: Node | None = None):
        self.name = name
        new, self.leaf = _slots_of(marks)
        above = parent.inside if parent else frozenset()
        self.inside = above if new <= above else above | new
        # 0 outside the article, 1 in it, 2 in what isn't part of it
        self.main = parent.main if parent else 0
        if self.main == 0:
            self.main = int(name in ("article", "main"))
        elif self.main == 1 and (name in ("form", "button", "select", "label") or ASIDE.search(marks)):
            self.main = 2


class Block:
    """Text of a block, the element it is in, and how many of its characters are links."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


@lru_cache(maxsize=32)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order; references decoded, white space single.

    Scripts, styles and what a browser never shows are left out, to their end tag (raw ones to the
    end of the page where it is missing). Formulas and drawings are text of the block they stand in;
    one that isn't closed ends at the next HTML tag that can't be in it.
    """
    out: list[Block] = []
    stack, opened = [Node()], Counter()
    parts: list[str] = []
    links, linked, at, end, foreign = 0, 0, 0, len(page), ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1], linked))
            parts.clear()
        linked = 0

    def leave() -> None:
        opened[stack.pop().name] -= 1

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if links else 0

    closable = True  # a > is still ahead
    while at < end:
        lt = page.find("<", at)
        if lt < 0 or not closable:
            say(page[at:])
            break
        say(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        m = TAG.match(page, lt)
        if not m:
            gt = page.find(">", lt)
            closable = gt >= 0
            if closable and page[lt + 1 : lt + 2] in "!?/" or closable and page[lt + 1 : lt + 2].isalpha():
                at = gt + 1
            else:
                say("<")
                at = lt + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = 0
            if foreign and (name == foreign or opened[name]):
                foreign = ""
            if foreign or name in INLINE or name in FOREIGN:
                if foreign == "svg":
                    say(" ")
                continue
            flush()
            if opened[name]:
                while stack[-1].name != name:
                    leave()
                leave()
            continue
        if not m[3].endswith("/") and (name in RAW or name in UNSHOWN or name == "xmp" or foreign and name in FOREIGN_UNSHOWN):
            close = _end_tag(name).search(page, at)
            if name == "xmp":  # its text as it stands
                flush()
                stack.append(Node(name, name, stack[-1]))
                say(html.escape(page[at : close.start() if close else end], quote=False))
                flush()
                stack.pop()
            if close or name in RAW or name == "xmp":
                at = close.end() if close else end
                continue
        if foreign and name not in ENDS_FOREIGN:
            if foreign == "svg":
                say(" ")
            continue
        foreign = ""
        if name in FOREIGN:
            foreign = "" if m[3].endswith("/") else name
            continue
        if name == "br":
            say(" ")
        elif name == "a":
            links = 1
        if name in INLINE or name in ("br", "wbr", "img", "input"):
            continue
        flush()
        if stack[-1].name == "p":
            leave()
        while stack[-1].name in CLOSES.get(name, ()):
            leave()
        if name not in VOID and not m[3].endswith("/"):
            marks = " ".join(a or b or c for a, b, c in MARK.findall(m[3])) if m[3] else ""
            marks = f"{name} {marks.lower()}" + (" hidden" if m[3] and HIDDEN_MARK.search(m[3]) else "")
            stack.append(Node(name, marks, stack[-1]))
            opened[name] += 1
    flush()
    return out


def _path_slots(node: Node, cache: dict) -> np.ndarray:
    """Slots of the elements around a block: of all, and of the nearest as such."""
    key = node.inside, node.leaf
    found = cache.get(key)
    if found is None:
        found = np.array(sorted(node.inside | node.leaf) or [0], np.int16)
        if len(found) <= 256:
            if len(cache) > 20_000:
                cache.clear()
            cache[key] = found
    return found


class Features:
    """Inputs of the blocks of some pages, page after page."""

    def __init__(self, pages: list[list[Block]], cache: dict):
        flat = [b for p in pages for b in p]
        self.sizes = np.array([len(p) for p in pages])
        self.paths = [_path_slots(b.node, cache) for b in flat]
        self.path_count = np.array([len(p) for p in self.paths], np.int64)
        hashes, self.word_count, *_ = run_hashes(pa.array([b.text for b in flat], pa.string()), 1) if flat else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.word = (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
        place = np.concatenate([np.arange(n) / max(n - 1, 1) for n in self.sizes]) if flat else np.empty(0)
        chars = np.array([len(b.text) for b in flat], float)
        share = np.array([min(1, b.linked / max(1, len(b.text))) for b in flat], float)
        ends = np.array([b.text[-1] in ".!?…:\"'" for b in flat], float)
        self.numbers = np.stack([np.log1p(chars) / 4, np.log1p(self.word_count) / 3, share, ends, place, np.ones(len(flat))], axis=1).astype(np.float32) if flat else np.empty((0, NUMBERS), np.float32)

    def sums(self, table: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over the slots of each block, over the root of their number."""
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.stack([np.bincount(owner, c[slots], len(counts)) for c in table.T], axis=1)
        return (out / np.sqrt(np.maximum(counts, 1))[:, None]).astype(np.float32)

    def spread(self, d: np.ndarray, slots: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        """Gradient of the table whose sums() have gradient d."""
        owner = np.repeat(np.arange(len(counts)), counts)
        d = d / np.sqrt(np.maximum(counts, 1))[:, None]
        return np.stack([np.bincount(slots, c[owner], size) for c in d.T], axis=1).astype(np.float32)

    @property
    def path(self) -> np.ndarray:
        return np.concatenate(self.paths).astype(np.int64) if self.paths else np.empty(0, np.int64)

    def inputs(self, p: lstm.Params) -> np.ndarray:
        """Vectors of the blocks: path, words, numbers. Paths are summed for some blocks at a time."""
        ends, path, begin = np.cumsum(self.path_count), [np.empty((0, PATH_SIZE), np.float32)], 0
        while begin < len(self.paths):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SUMMED, "right")))
            path.append(self.sums(p["path"], np.concatenate(self.paths[begin:stop]), self.path_count[begin:stop]))
            begin = stop
        return np.concatenate([np.concatenate(path), self.sums(p["word"], self.word, self.word_count), self.numbers], axis=1)


def _padded(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages, ...) with zeros after the end, mask, and the step and page of each block."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    steps = int(sizes.max(initial=1))
    out = np.zeros((steps, len(sizes), *flat.shape[1:]), np.float32)
    out[step, page] = flat
    mask = np.zeros((steps, len(sizes)), np.float32)
    mask[step, page] = 1
    return out, mask, step, page


def _states(p: lstm.Params, f: Features, keep: bool = False):
    x = f.inputs(p)
    ahead, mask, step, page = _padded(x @ p["ahead_in"], f.sizes)
    back, *_ = _padded(x @ p["back_in"], f.sizes)
    states, kept = lstm.forward(p, ahead, back, mask, keep)
    return states, kept, mask, step, page, x


def main_scores(p: lstm.Params, pages: list[list[Block]], cache: dict) -> list[np.ndarray]:
    """Probability of being main text for the blocks of each page; pages of like length run side by side."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
    j = 0
    while j < len(order):
        # side by side they take as many steps as the longest: bounded by steps times pages
        most = min(256, len(order) - j)
        many = next((n for n in range(1, most) if (n + 1) * len(pages[order[j + n]]) > CELLS), most)
        some = order[j : j + many]
        j += many
        f = Features([pages[i] for i in some], cache)
        states, _, _, step, page, _ = _states(p, f)
        score = lstm.sigmoid(states[step, page] @ p["out_w"] + p["out_b"])
        for i, part in zip(some, np.split(score, np.cumsum(f.sizes)[:-1])):
            out[i] = part
    return out


def _gradients(p: lstm.Params, f: Features, y: np.ndarray) -> lstm.Params:
    states, kept, mask, step, page, x = _states(p, f, True)
    own = states[step, page]
    error = ((lstm.sigmoid(own @ p["out_w"] + p["out_b"]) - y) / len(y)).astype(np.float32)
    dstates = np.zeros_like(states)
    dstates[step, page] = error[:, None] * p["out_w"]
    grads, dahead, dback = lstm.backward(p, dstates, kept, mask)
    grads |= {"out_w": own.T @ error, "out_b": error.sum(keepdims=True)}
    dx = 0
    for way, dz in (("ahead_in", dahead), ("back_in", dback)):
        d = dz[step, page]
        grads[way] = x.T @ d
        dx = dx + d @ p[way].T
    grads["path"] = f.spread(dx[:, :PATH_SIZE], f.path, f.path_count, PATH_SLOTS)
    grads["word"] = f.spread(dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE], f.word, f.word_count, WORD_SLOTS)
    return grads


def train(labelled: list[tuple[list[Block], list[int]]], seed: int = 5, epochs: int = EPOCHS) -> lstm.Params:
    """Parameters fitted on pages' blocks and their labels (1 main text)."""
    rng = np.random.default_rng(seed)
    p = lstm.new_params(HIDDEN, rng)
    for name, shape in (("path", (PATH_SLOTS, PATH_SIZE)), ("word", (WORD_SLOTS, WORD_SIZE)), ("ahead_in", (PATH_SIZE + WORD_SIZE + NUMBERS, 4 * HIDDEN)), ("back_in", (PATH_SIZE + WORD_SIZE + NUMBERS, 4 * HIDDEN))):
        p[name] = (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p["out_w"], p["out_b"] = (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32), np.zeros(1, np.float32)
    adam, cache = lstm.Adam(p, 0.02), {}
    labelled = [x for x in labelled if x[0]]
    for epoch in range(epochs):
        adam.rate = 0.02 * (1 - epoch / epochs)
        for some in np.array_split(rng.permutation(len(labelled)), max(1, len(labelled) // 24)):
            if len(some):
                f = Features([labelled[i][0] for i in some], cache)
                adam.update(_gradients(p, f, np.concatenate([labelled[i][1] for i in some]).astype(np.float32)))
    return p


class _Maker:
    """Made pages. Main text stands between the private marks \\ue000 and \\ue001."""

    def __init__(self, rng: np.random.Generator, words: list[str]):
        self.rng, self.words = rng, words

    def pick(self, *x):
        return x[self.rng.integers(0, len(x))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def say(self, low: int, high: int, stop: bool = False) -> str:
        n = int(self.rng.integers(low, high))
        if self.words and self.chance(0.6):
            out = [self.words[i] for i in self.rng.integers(0, len(self.words), n)]
        else:
            out = ["".join(chr(97 + c) for c in self.rng.integers(0, 26, self.rng.integers(1, 9))) for _ in range(n)]
        return " ".join(out).capitalize() + ("." if stop else "")

    def mark(self, *names: str) -> str:
        return self.pick("", f' class="{self.pick(*names)}"', f' id="{self.pick(*names)}"', f' class="{self.pick(*names)} x{self.rng.integers(0, 99)}"')

    def sure(self, *names: str) -> str:
        return self.pick(f' class="{self.pick(*names)}"', f' id="{self.pick(*names)}"', f' class="c{self.rng.integers(0, 9)} {self.pick(*names)}"')

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.say(1, 3)}</a></li>' for i in range(n))

    def nav(self) -> str:
        ul = f"<ul>{self.links(int(self.rng.integers(2, 8)))}</ul>"
        return self.pick(f"<nav{self.mark('menu', 'nav', 'main-nav')}>{ul}</nav>", f"<div{self.sure('menu', 'nav', 'navbar', 'navigation')}>{ul}</div>")

    def header(self) -> str:
        inner = self.pick(f"<div>{self.say(1, 4)}</div>", f"<h1>{self.say(1, 3)}</h1><p>{self.say(2, 8)}</p>", "") + (self.nav() if self.chance(0.5) else "")
        return self.pick(f"<header{self.mark('header', 'site-header')}>{inner}</header>", f"<div{self.sure('header', 'masthead', 'site-header', 'top-bar')}>{inner}</div>")

    def footer(self) -> str:
        inner = self.pick(f"&copy; {self.say(1, 3)} &middot; {self.say(3, 12, True)}", f"<p>{self.pick('Copyright', '©', 'All rights reserved')} {self.say(1, 9)}</p>", f"<ul>{self.links(3)}</ul><p>{self.say(2, 9, True)}</p>")
        return self.pick(f"<footer{self.mark('footer')}>{inner}</footer>", f"<div{self.sure('footer', 'site-footer', 'bottom')}>{inner}</div>")

    def aside(self) -> str:
        inner = f"<h3>{self.say(1, 4)}</h3>" + self.pick(f"<ul>{self.links(4)}</ul>", f"<p>{self.say(5, 40, True)}</p>")
        return self.pick(f"<aside{self.mark('sidebar', 'related')}>{inner}</aside>", f"<div{self.sure('sidebar', 'related', 'widget', 'recommended', 'share', 'social')}>{inner}</div>")

    def advert(self) -> str:
        return f"<{(t := self.pick('div', 'div', 'section', 'aside', 'p'))}{self.sure('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'banner', 'promo')}>{self.say(2, 30, True)}</{t}>"

    def notice(self) -> str:
        inner = self.pick(f"<p>{self.say(5, 30, True)}</p><button>{self.say(1, 2)}</button>", self.pick("We use cookies.", "This site uses cookies.", "") + self.say(4, 20, True))
        return f"<div{self.sure('cookie', 'cookies', 'consent', 'notice', 'cookie-notice', 'alert', 'gdpr', 'popup')}>{inner}</div>"

    def form(self) -> str:
        return f"<form{self.mark('search', 'newsletter', 'subscribe', 'login')}><label>{self.say(1, 5)}</label><input name=q><select><option>{self.say(1, 2)}<option>{self.say(1, 2)}</select><button>{self.say(1, 2)}</button></form>"

    def comments(self) -> str:
        each = "".join(f"<{(t := self.pick('div', 'li', 'article'))}{self.sure('comment', 'comment-body', 'reply')}><p>{self.say(1, 3)}</p><p>{self.say(3, 50, True)}</p></{t}>" for _ in range(self.rng.integers(1, 5)))
        return f"<{(t := self.pick('div', 'section'))}{self.sure('comments', 'comment-list', 'responses', 'discussion')}><h3>{self.say(1, 3)}</h3>{each}</{t}>"

    def article(self) -> str:
        body = []
        for _ in range(self.rng.integers(0, 14)):
            text = self.say(1, int(self.rng.integers(2, 120)), True)
            body.append(self.pick(*[f"<p>{text}</p>"] * 7, f"<p><b>{text}<br>", f"<p>{text} <a href='#'>{self.say(1, 3)}</a> {self.say(1, 5)}.</p>", f"<h2>{self.say(1, 6)}</h2>", f"<ul><li>{self.say(2, 20)}</li><li>{self.say(2, 20)}</li></ul>", f"<blockquote>{text}</blockquote>", f"<table><tr><td>{self.say(1, 4)}<td>{self.say(1, 4)}</table>", f"<pre>{text}</pre>", f"<div>{text}</div>", f"<figure><figcaption>{self.say(2, 9)}</figcaption></figure>"))
            if self.chance(0.06):
                body.append("\ue001" + self.pick(self.advert, self.aside, self.form)() + "\ue000")
        title = f"<{(h := self.pick('h1', 'h1', 'h1', 'h2'))}>{self.say(2, 12)}</{h}>" if self.chance(0.85) else ""
        inner = f"\ue000{title}{''.join(body)}\ue001"
        inner += self.comments() if self.chance(0.1) else ""
        return self.pick(f"<article{self.mark('post', 'article', 'entry')}>{inner}</article>", f"<article>{inner}</article>", f"<main{self.mark('content', 'main')}>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{self.sure('content', 'article', 'post', 'entry-content', 'main', 'article-body', 'story', 'post-content', 'text')}>{inner}</div>", f"<section{self.sure('content', 'article', 'story', 'body')}>{inner}</section>")

    def page(self) -> str:
        before = [f() for f in (self.notice, self.header, self.nav, self.advert, self.aside, self.form) if self.chance(0.4)]
        after = [f() for f in (self.aside, self.advert, self.comments, self.form, self.nav, self.notice) if self.chance(0.35)]
        self.rng.shuffle(before)
        self.rng.shuffle(after)
        body = "".join(before) + self.article() + "".join(after) + (self.footer() if self.chance(0.85) else "")
        body = f"<div{self.mark('page', 'wrapper', 'container')}>{body}</div>" if self.chance(0.4) else body
        return f"<!DOCTYPE html><html><head><title>{self.say(2, 9)}</title></head><body>{body}</body></html>"


def made_pages(count: int, words: list[str], seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of made pages."""
    maker = _Maker(np.random.default_rng(seed), words)
    out = []
    for _ in range(count):
        page = maker.page()
        found, inside, labels, kept = blocks(re.sub("([\ue000\ue001])", r"<hr>\1<hr>", page)), 0, [], []
        for b in found:
            if b.text in ("\ue000", "\ue001"):
                inside = int(b.text == "\ue000")
            else:
                kept.append(b)
                labels.append(inside)
        out.append((kept, labels))
    return out


def plain_labels(found: list[Block]) -> list[int] | None:
    """Labels of a page with one plain article or main element; null if it has none."""
    labels = [int(b.node.main == 1) for b in found]
    return labels if any(labels) else None


def fit(pages: DataFrame, page_id: str = "page_id", source: str = "html", rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> lstm.Params:
    """The labeller, fitted on made pages and at most ``rows`` of the table's pages of at most ``longest`` characters, by the hash of the id."""
    some = pages.select(F.col(page_id).alias("id"), F.col(source).alias("html")).filter(F.length("html") <= longest)
    own = [blocks(r.html) for r in hash_sample(some, ["id", "html"], rows)]
    words = sorted({w for p in own for b in p for w in b.text.split()[:60]})
    plain = [(p, y) for p in own if (y := plain_labels(p))]
    return train(made_pages(MADE, words) + plain)


def extract(pages: DataFrame, model: lstm.Params, source: str = "html", found: str = "main_text") -> DataFrame:
    """All columns of pages and ``found``: the text of the blocks labelled main, in page order, joined by one space.

    A null or empty page, or one without main text, gives the empty string. Text outside any tag is a
    block too. Each row is read whole and by itself, so repeated rows give equal texts. ``found`` must
    not be a column of pages (ValueError).
    """
    absent(pages, found)
    columns = list(pages.columns)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in slices(batch, 1):
                cut = [blocks(t or "") for t in part.column(1).to_pylist()]
                texts = [" ".join(b.text for b, s in zip(page, score) if s >= 0.5) for page, score in zip(cut, main_scores(shared.value, cut, cache))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "found"])

    raw = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{source}`").alias("html"))
    out = raw.mapInArrow(run, f"row {raw.schema['row'].dataType.simpleString()}, found string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("found").alias(found))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
