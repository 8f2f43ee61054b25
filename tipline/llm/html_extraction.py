"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page's element tree.

A page is cut into leaf blocks: runs of text with no block element inside. Each has features from its ancestors' tags and attribute
words, from the shape of its text (length, links, stops) and from its place in the page. The field has a weight for each feature
and label and for each pair of neighbouring labels (apart for neighbours under one parent); it is trained by maximum likelihood
on labelled pages, on the driver, over a bounded set drawn from a seed, and decoded by Viterbi in Spark tasks, page by page.

Defined results: null html is empty; a page without blocks, or none of them main, gives an empty text; white space is what
str.split() splits at; a closed-at-once or unclosed svg, iframe, title or template hides nothing after it, and a block element ends an
open svg or title; a tag whose quotes do not balance ends at its first ">"; elements deeper than DEEPEST are read as if at that depth;
repeated rows give equal results; other columns are ignored. Time grows with a page's length, broken pages included.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import slices
from tipline.llm.labelled_pages import labelled_pages

#: Labelled pages to train on, their seed, passes, step and penalty.
PAGES, SEED, PASSES, STEP, PENALTY = 700, 11, 14, 0.25, 1e-4
SLICE_BYTES = 4 << 20
#: Open elements that a page can have at once.
DEEPEST = 256

# Elements whose content is never text of the page (code runs on to the page's end if it isn't closed, the others don't), elements
# within a line, and elements without content.
CODE, UNSEEN = "script|style", "title|template|svg|iframe"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BOXES = frozenset("ul ol dl table tbody thead tfoot div section article aside main nav header footer form body td".split())

BLOCK = "p|div|article|section|main|header|footer|nav|aside|body|form|ul|ol|dl|table|blockquote|pre|h[1-6]"

#: Comments and code with content; tags, with quoted values where the quotes are balanced, else up to the first ">"; declarations.
_VALUES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_SKIPPED = rf"<!--.*?(?:-->|\Z)|<({CODE})\b[^>]*>.*?(?:</\1\s*>|\Z)"
_TOKEN = re.compile(rf"{_SKIPPED}|<(/?)([a-zA-Z][^\s/>]*)({_VALUES})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
#: A title as far as it is text without blocks; else what opens and closes unseen elements, and the blocks that end some of them.
_UNSEEN = re.compile(rf"<title\b[^>]*>(?:[^<]|<(?!/?title\b|/?(?:{BLOCK})\b)){{0,2000}}?</title\s*>|{_SKIPPED}|<(/?)({UNSEEN}|{BLOCK})\b({_VALUES})>", re.S | re.I)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("linked", "parent", "path", "text")

    def __init__(self, text: str, linked: int, path: tuple, parent: int):
        self.text, self.linked, self.path, self.parent = text, linked, path, parent


@lru_cache(maxsize=4096)
def _attribute_words(attrs: str) -> tuple[str, ...]:
    found = []
    for m in _ATTR.finditer(attrs):
        found += _NAME.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(dict.fromkeys(found))


def unseen(page: str) -> dict[int, int]:
    """Where unseen elements begin and, after their closing tags, end. An element without a closing tag of its own is none of them."""
    names, found = frozenset(UNSEEN.split("|")), {}
    open_: dict[str, list[int]] = {n: [] for n in names}
    for m in _UNSEEN.finditer(page):
        if not m[3]:
            if m[0][:6].lower() == "<title":
                found[m.start()] = m.end()
            continue
        tag = m[3].lower()
        if tag not in names:
            if not m[2]:
                open_["svg"].clear()
                open_["title"].clear()
        elif m[2]:
            if open_[tag]:
                found[open_[tag].pop()] = m.end()
        elif not m[4].endswith("/"):
            open_[tag].append(m.start())
    return found


def _tokens(page: str) -> Iterator[re.Match]:
    """The page's tokens outside of unseen elements."""
    hidden, at = unseen(page) if "<" in page else {}, 0
    while m := _TOKEN.search(page, at):
        at = hidden.get(m.start(), m.end())
        yield m, at


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: their text with single spaces, characters of it in links, and (tag, attribute words) of their ancestors."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    unclosed = frozenset(UNSEEN.split("|"))
    parts: list[str] = []
    linked, links, serial, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), tuple((t, a) for t, a, _ in stack), next((k for t, _, k in reversed(stack) if t in BOXES), -1)))
        parts.clear()
        linked = 0

    for m, end in _tokens(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if links:
                linked += len(text)
        at = end
        closing, name, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name or end > m.end():
            continue
        tag = name.lower()
        if tag in unclosed:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag == "a":
            links += 1
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag not in INLINE:
            links = 0
            while stack and stack[-1][0] in INLINE:
                stack.pop()
        for k in range(len(stack) - 1, -1, -1) if tag in CLOSES else ():
            if stack[k][0] in CLOSES[tag]:
                del stack[k:]
                break
            if stack[k][0] in BOXES:
                break
        serial += 1
        if tag != "a" and len(stack) < DEEPEST:
            stack.append((tag, _attribute_words(attrs), serial))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _bucket(n: float, edges: tuple) -> int:
    return sum(n >= e for e in edges)


def features(found: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    seen_h1 = False
    for b in found:
        words = b.text.count(" ") + 1
        density = _bucket(b.linked / len(b.text), (0.01, 0.3, 0.7, 0.95))
        own = b.path[-1][0] if b.path else "none"
        size = _bucket(words, (2, 4, 8, 15, 30, 60))
        f = ["any", f"tag={own}", f"size={size}", f"links={density}", f"size={size},links={density}", f"stop={b.text[-1] in '.?!…。'}", f"comma={',' in b.text}", f"depth={_bucket(len(b.path), (2, 3, 4, 6))}"]
        if "©" in b.text:
            f.append("copyright")
        names = set()
        for tag, attrs in b.path:
            names.add(f"in={tag}")
            names.update(f"word={a}" for a in attrs)
            if tag in ("div", "section", "td", "li", "p", "ul", "aside"):
                names.update(f"nearword={a}" for a in (b.path[-1][1] if tag == own else ()))
        for tag, attrs in b.path[-2:-1]:
            f.append(f"parent={tag}")
        f.append(f"h1before={seen_h1}")
        seen_h1 |= own == "h1"
        out.append(f + sorted(names))
    return out


class Field:
    """Two labels (0: other, 1: main). weights: feature x label; moves: same parent x label x label."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels (Viterbi)."""
        if not found:
            return []
        get, w, back, score = self.index.get, self.table, [], None
        before = None
        for b, names in zip(found, features(found), strict=True):
            e0 = e1 = 0.0
            for name in names:
                if (i := get(name)) is not None:
                    e0 += w[i][0]
                    e1 += w[i][1]
            if score is None:
                score = (e0, e1)
            else:
                (a, b0), (c, d) = self.steps[b.parent == before]
                x0, x1, y0, y1 = score[0] + a, score[1] + c, score[0] + b0, score[1] + d
                back.append((x1 > x0, y1 > y0))
                score = (max(x0, x1) + e0, max(y0, y1) + e1)
            before = b.parent
        label = int(score[1] > score[0])
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return [bool(x) for x in reversed(labels)]

    def __getattr__(self, name: str):
        if name == "table":
            self.table = self.weights.tolist()
            return self.table
        if name == "steps":
            self.steps = self.moves.tolist()
            return self.steps
        raise AttributeError(name)


def train(pages: list[tuple[str, list[bool]]], passes: int = PASSES, step: float = STEP, penalty: float = PENALTY) -> Field:
    """Maximum likelihood by adaptive gradient steps, page by page."""
    data, index = [], {}
    for page, labels in pages:
        found = blocks(page)
        if not found or len(found) != len(labels):
            continue
        ids = [np.array([index.setdefault(n, len(index)) for n in names]) for names in features(found)]
        same = np.array([int(a.parent == b.parent) for a, b in zip(found, found[1:], strict=False)], int)
        data.append((ids, same, np.array(labels, int)))
    weights, moves = np.zeros((len(index), 2)), np.zeros((2, 2, 2))
    square_w, square_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    order = np.random.default_rng(SEED)
    for _ in range(passes):
        for k in order.permutation(len(data)):
            ids, same, labels = data[k]
            n = len(ids)
            e = np.array([weights[i].sum(0) for i in ids])
            m = moves[same]
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = e[0]
            for t in range(1, n):
                forward[t] = np.logaddexp(forward[t - 1][0] + m[t - 1][0], forward[t - 1][1] + m[t - 1][1]) + e[t]
            for t in range(n - 2, -1, -1):
                backward[t] = np.logaddexp(m[t][:, 0] + e[t + 1][0] + backward[t + 1][0], m[t][:, 1] + e[t + 1][1] + backward[t + 1][1])
            total = np.logaddexp(*forward[-1])
            wrong = np.exp(forward + backward - total)
            wrong[np.arange(n), labels] -= 1
            all_ids = np.concatenate(ids)
            grad = np.repeat(wrong, [len(i) for i in ids], axis=0)
            rows, where = np.unique(all_ids, return_inverse=True)
            g = np.zeros((len(rows), 2))
            np.add.at(g, where, grad)
            g += penalty * weights[rows]
            square_w[rows] += g * g
            weights[rows] -= step * g / np.sqrt(square_w[rows])
            if n > 1:
                pair = np.exp(forward[:-1, :, None] + m + (e[1:] + backward[1:])[:, None, :] - total)
                pair[np.arange(n - 1), labels[:-1], labels[1:]] -= 1
                gm = np.zeros_like(moves)
                np.add.at(gm, same, pair)
                square_m += gm * gm
                moves -= step * gm / np.sqrt(square_m)
    return Field(index, weights, moves)


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Field:
    return train(labelled_pages(pages, seed))


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return " ".join(b.text for b, main in zip(found, field.decode(found), strict=True) if main)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SLICE_BYTES):
                texts = [main_text(t or "", field) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
