"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags, each
with its block-level ancestors. Features are ancestor tags and the words of
their class and id attributes, the block's tag, link density, length, and where
it lies. Two labels (main text or not) are chained; weights are learned by
gradient ascent on the likelihood of labelled pages, and a page is decoded by
Viterbi. Kept blocks are joined by line breaks.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Scanning goes forward only: repeats are possessive, and what can fail is tried no more once it has failed.
_TEXT = re.compile(r"[^<]++")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_SKIPPED = "script style noscript template svg iframe textarea select title".split()
_OPEN = {t: re.compile(rf"<{t}(?=[\s/>])", re.I) for t in _SKIPPED}
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SKIPPED}
#: Of the skipped elements, those that run to the end of the page if they are not closed, and those that hold their like.
_RAW, _NESTS = frozenset(("script", "style", "textarea")), frozenset(("svg", "template"))
_FOREIGN = re.compile(r"<foreignobject(?=[\s/>])", re.I)
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+")
#: Elements whose text flows with its surroundings; every other one begins and ends a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these closes an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: Tags at which a skipped element that is not closed ends.
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(_ENDS_P))}|html|head|body|li|dt|dd|caption|thead|tbody|tfoot|tr|td|th)(?=[\s/>])", re.I)
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass
class Block:
    text: str
    tag: str  # the innermost block-level ancestor; "-" if there is none
    tags: frozenset[str]  # block-level ancestors
    names: frozenset[str]  # words of their class, id and role attributes
    linked: int  # characters inside links


def _skip(page: str, tag: str, attrs: str, at: int, closes: dict[str, re.Match[str] | None]) -> int:
    """Where a skipped element ends whose start tag ends at ``at``. closes: the last end tag found of each name."""
    if tag == "svg" and attrs.endswith("/"):
        return at
    if tag not in closes or (closes[tag] is not None and closes[tag].start() < at):
        closes[tag] = _CLOSE[tag].search(page, at)
    close = closes[tag]
    if tag in _RAW:
        return close.end() if close else len(page)
    if close is not None:
        inside = (at, close.start())
        if tag == "svg":  # only foreign objects hold blocks
            block = _NEXT_BLOCK.search(page, *inside)
            closed = block is None or _FOREIGN.search(page, at, block.start()) is not None
        else:
            closed = tag in _NESTS or _OPEN[tag].search(page, *inside) is None
        if closed:
            return close.end()
    if attrs.endswith("/"):
        return at
    block = _NEXT_BLOCK.search(page, at)
    return block.start() if block else len(page)


#: Elements that an open one of inside doesn't end with those around.
_SCOPES = frozenset(("ul", "ol", "dl", "table"))


class _Open:
    """The open block-level elements. Each holds what is open up to it, so that a block of any depth costs the same."""

    def __init__(self, known: frozenset[str] | None) -> None:
        self.known = known
        self.stack: list[tuple[str, frozenset[str], frozenset[str]]] = []
        self.count: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]

    def top(self) -> tuple[str, frozenset[str], frozenset[str]]:
        return self.stack[-1] if self.stack else ("-", frozenset(), frozenset())

    def push(self, tag: str, names: set[str]) -> None:
        _, tags, above = self.top()
        new = {tag} if self.known is None or f"in={tag}" in self.known or tag in ("article", "main") else set()
        names = names if self.known is None else {n for n in names if f"name={n}" in self.known}
        self.stack.append((tag, tags if new <= tags else tags | new, above if names <= above else above | names))
        self.count[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in _SCOPES:
            self.scopes.append(Counter())

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        if tag in _SCOPES:
            self.scopes.pop()
        self.count[tag] -= 1
        self.scopes[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def end(self, tags: tuple[str, ...]) -> None:
        """Close up to the innermost of ``tags`` that is open since the last list or table began."""
        if any(self.scopes[-1][t] for t in tags):
            while self.pop() not in tags:
                pass


def leaf_blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Non-empty leaf blocks in page order; white space inside one is a single blank.

    With ``known`` (feature names) only ancestors and names among them are kept.
    Time and memory are in proportion to the page: quotes count only around a
    value, a tag whose values hide every later ``>`` ends at the next one whatever
    the quotes, and so do all tags after it.
    """
    out: list[Block] = []
    at_open = _Open(known)
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal text, linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, *at_open.top(), linked))
        text, linked = [], 0

    page, at = page or "", 0
    closes: dict[str, re.Match[str] | None] = {}
    last, pattern = page.rfind(">"), _TAG
    while at < len(page):
        m = _TEXT.match(page, at)
        if m is None and at < last:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = len(page) if end < 0 else end + 3
                continue
            if page[at + 1] in "!?":
                at = page.index(">", at) + 1
                continue
            m = pattern.match(page, at)
            if m is None and pattern is _TAG and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                pattern = _LOOSE_TAG
                m = pattern.match(page, at)
        elif m is None and page.startswith("<!--", at):
            break
        if m is None or m.re is _TEXT:
            raw = m[0] if m else "<"
            at += len(raw)
            text.append(raw)
            if links:
                linked += len(raw.strip())
            continue
        at = m.end()
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3]
        if tag in _OPEN:
            if not closing:
                at = _skip(page, tag, attrs, at, closes)
            continue
        if tag in _INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        links = 0
        if closing:
            at_open.close(tag)
            continue
        if tag in _ENDS_P and at_open.top()[0] == "p":
            at_open.pop()
        if tag in _ENDS_SAME:
            at_open.end(_ENDS_SAME[tag])
        if tag not in _VOID and not attrs.endswith("/"):
            at_open.push(tag, {w.lower() for a in _ATTR.findall(attrs) for w in _NAME.findall(a[0] or a[1] or a[2])} if attrs else set())
    flush()
    return out


_STOP = re.compile(r"[.!?…]$")


def features(blocks: list[Block]) -> list[tuple[str, ...]]:
    """Names of the active features of each block."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        size = len(b.text)
        density = b.linked / size
        f = ["bias", f"tag={b.tag}"]
        f += sorted(f"in={t}" for t in b.tags)
        f += sorted(f"name={w}" for w in b.names)
        f.append(f"len={min(size.bit_length(), 10)}")
        f.append("links=" + ("none" if not b.linked else "some" if density < 0.5 else "most"))
        f.append(f"stop={bool(_STOP.search(b.text))}")
        f.append("at=first" if i == 0 else "at=last" if i == n - 1 else "at=inner")
        if "article" not in b.tags and "main" not in b.tags:
            f.append("outside")
        out.append(tuple(f))
    return out


class CRF:
    """Two labels in a chain; label 1 is main text."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pair: np.ndarray) -> None:
        self.index, self.unary, self.pair = index, unary, pair
        self.known = frozenset(index)

    def emit(self, feats: list[tuple[str, ...]]) -> np.ndarray:
        get = self.index.get
        out = np.zeros((len(feats), 2))
        for i, f in enumerate(feats):
            ids = [x for x in map(get, f) if x is not None]
            out[i] = self.unary[ids].sum(axis=0)
        return out

    def decode(self, feats: list[tuple[str, ...]]) -> list[int]:
        """Viterbi; of equal paths label 0 wins."""
        if not feats:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        emit = self.emit(feats).tolist()
        a, b = emit[0]
        back = []
        for x, y in emit[1:]:
            a0, b0, a1, b1 = a + p00, b + p10, a + p01, b + p11
            back.append((int(b0 > a0), int(b1 > a1)))
            a, b = max(a0, b0) + x, max(a1, b1) + y
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 30, rate: float = 0.3, decay: float = 1e-3) -> CRF:
    """Maximum likelihood by adaptive gradient steps over (features, labels) of each page."""
    index: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for x in f:
                index.setdefault(x, len(index))
    unary, pair = np.zeros((len(index), 2)), np.zeros((2, 2))
    su, sp = np.full_like(unary, 1e-6), np.full_like(pair, 1e-6)
    data = [([[index[x] for x in f] for f in feats], labels) for feats, labels in pages if feats]
    for _ in range(rounds):
        for ids, labels in data:
            n = len(ids)
            e = np.stack([unary[i].sum(axis=0) for i in ids])
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = e[0]
            for i in range(1, n):
                fwd[i] = np.logaddexp(fwd[i - 1, 0] + pair[0], fwd[i - 1, 1] + pair[1]) + e[i]
            for i in range(n - 2, -1, -1):
                z = bwd[i + 1] + e[i + 1]
                bwd[i] = np.logaddexp(pair[:, 0] + z[0], pair[:, 1] + z[1])
            total = np.logaddexp(fwd[-1, 0], fwd[-1, 1])
            g = -np.exp(fwd + bwd - total)
            g[np.arange(n), labels] += 1
            gp = np.zeros((2, 2))
            for i in range(1, n):
                gp -= np.exp(fwd[i - 1][:, None] + pair + (e[i] + bwd[i])[None, :] - total)
                gp[labels[i - 1], labels[i]] += 1
            gu = np.zeros_like(unary)
            for i, f in enumerate(ids):
                np.add.at(gu, f, g[i])
            gu -= decay * unary
            gp -= decay * pair
            su += gu * gu
            sp += gp * gp
            unary += rate * gu / np.sqrt(su)
            pair += rate * gp / np.sqrt(sp)
    return CRF(index, unary, pair)


def labelled_pages(count: int = 240, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, main blocks): made-up pages in several layouts, as labelled examples."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choice("aeiou") + rng.choice("bcdlmnrst") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice("...!?")
    links = lambda n: "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(n))
    noise = {
        "nav": lambda: f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>",
        "menu": lambda: f'<div class="menu"><ul>{links(rng.randint(3, 9))}</ul></div>',
        "header": lambda: f'<header class="site-header"><h2>{words(1, 4)}</h2><p>{sentence(2, 8)}</p></header>',
        "ad": lambda: f'<div class="{rng.choice(("ad", "ads", "advert", "sponsored", "promo", "banner"))}"><p>{sentence(3, 20)}</p></div>',
        "ad_bare": lambda: f'<div class="{rng.choice(("ad", "advert", "advertisement"))}">{sentence(2, 25)}</div>',
        "aside": lambda: f"<aside><h3>{words(1, 3)}</h3><p>{sentence(4, 30)}</p></aside>",
        "sidebar": lambda: f'<div class="sidebar" id="sidebar"><h3>{words(1, 3)}</h3><ul>{links(4)}</ul><p>{sentence(4, 20)}</p></div>',
        "notice": lambda: f'<div class="{rng.choice(("cookie-notice", "notice", "cookie-banner", "consent", "alert"))}"><p>{sentence(5, 25)}</p><button>{words(1, 2)}</button></div>',
        "form": lambda: f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 1)}</button><p>{sentence(3, 9)}</p></form>',
        "comments": lambda: f'<{(t := rng.choice(("section", "div")))} class="comments" id="comments"><h3>{words(1, 2)}</h3>'
        + "".join(f'<div class="comment"><p>{sentence(4, 40)}</p></div>' for _ in range(rng.randint(1, 4)))
        + f"</{t}>",
        "share": lambda: f'<div class="{rng.choice(("share", "social", "related", "breadcrumb", "newsletter", "subscribe"))}"><p>{sentence(2, 12)}</p><a href="#">{words(1, 3)}</a></div>',
    }
    footers = (
        lambda: f"<footer>&copy; {words(1, 2)}.example &middot; {sentence(3, 15)}</footer>",
        lambda: f'<div class="footer" id="footer"><p>&copy; {words(2, 6)}</p></div>',
        lambda: f"<footer><p>{sentence(2, 20)}</p><ul>{links(3)}</ul></footer>",
    )
    out = []
    for _ in range(count):
        main, body = [], []
        for k in range(rng.randint(1, 12)):
            kind = "h1" if k == 0 and rng.random() < 0.85 else rng.choices(("p", "h2", "li", "blockquote"), (10, 1, 1, 1))[0]
            text = words(1, 9) if kind in ("h1", "h2") else sentence(1, 60) if rng.random() < 0.9 else words(1, 200)
            if kind not in ("h1", "h2") and rng.random() < 0.35:  # text that doesn't end like a sentence
                text = text.rstrip(".!?") + rng.choice(("", ":", "***", " |", "%", ";", " and"))
            main.append(text)
            if rng.random() < 0.15:
                text = text.replace(" ", ' <a href="/x">', 1) + "</a>" if " " in text else text
            body.append(f"<ul><li>{text}</li></ul>" if kind == "li" else f"<p><b>{text}<br>" if kind == "p" and rng.random() < 0.1 else f"<{kind}>{text}</{kind}>")
            if rng.random() < 0.08:
                body.append(noise[rng.choice(("ad", "ad_bare", "aside", "share", "notice", "form"))]())
        if rng.random() < 0.3:
            body.append(noise["comments"]())
        wrap = rng.choices(
            (
                "<article>{}</article>",
                "<main><article>{}</article></main>",
                '<div class="content"><article>{}</article></div>',
                "<main>{}</main>",
                '<div class="{c}">{}</div>',
                "<table><tr><td>{}</td></tr></table>",
                '<table class="layout" width="100%"><tr><td class="menu"><ul>{menu}</ul></td><td class="{c}">{}</td></tr></table>',
                "<table><tr><td><ul>{menu}</ul></td><td>{}</td></tr></table>",
            ),
            (8, 3, 2, 2, 3, 1.5, 1, 1.5),
        )[0]
        article = wrap.format("".join(body), c=rng.choice(("content", "article", "post", "entry-content", "article-body", "main-content")), menu=links(3))
        before = [noise[k]() for k in rng.sample(("nav", "menu", "header", "ad", "ad_bare", "notice", "form", "share"), rng.randint(1, 4))]
        after = [noise[k]() for k in rng.sample(("aside", "sidebar", "comments", "ad", "ad_bare", "share", "form", "notice"), rng.randint(0, 3))]
        end = rng.choice(footers)() if rng.random() < 0.95 else ""
        out.append((f"<!DOCTYPE html><html><head><title>{main[0]}</title></head><body>{''.join(before)}{article}{''.join(after)}{end}</body></html>", main))
    return out


def label_blocks(blocks: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks whose texts are ``main``, matched in order."""
    out, at = [], 0
    for b in blocks:
        hit = at < len(main) and b.text == main[at]
        out.append(int(hit))
        at += hit
    return out


@lru_cache(maxsize=4)
def default_model(count: int = 240, seed: int = 11) -> CRF:
    return train([(features(b), label_blocks(b, main)) for page, main in labelled_pages(count, seed) for b in [leaf_blocks(page)]])


def main_text(page: str | None, model: CRF) -> str:
    """The kept blocks of a page, one a line; "" if there are none."""
    blocks = leaf_blocks(page, model.known)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks)), strict=True) if y)


def extract_main_text(pages: DataFrame, model: CRF | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of ``pages``: the ``keep`` columns, text and n_chars (code points).

    Null and empty html, and html without main text, give "" and 0. A page of any
    size is read whole, in time and memory in proportion to it. Rows with null or
    repeated ids are kept as they are; repeated rows stay repeated; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), model) for x in b.column(len(keep))]
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    types = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html_col).mapInArrow(run, f"{types}, text string, n_chars bigint")


def op8_html(pages: DataFrame) -> DataFrame:
    return extract_main_text(pages)
