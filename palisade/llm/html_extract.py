"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text without a block-level tag in between. Each block has a vector of its tag path (the
tags above it, the hashed words of their classes and ids, and families of such words), of its hashed words, and of its form
(length, links, punctuation). A bidirectional LSTM reads all blocks of a page in order, so each is judged in the light of the
whole page, and says which belong to the article. html_train.py makes its weights from generated pages.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import chunks

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements that break a line of text, that have no end, whose text is never shown or is no text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg object audio video canvas".split())
#: An element whose start ends an open one of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where looking for such an element stops.
SCOPE = frozenset("ul ol dl table menu select html body".split())

#: Families of words in tags, classes, ids and roles.
FAMILIES = tuple(re.compile(p) for p in (
    r"^nav|menu|^breadcrumb|^toc|^tabs?$|pagination|pager", r"^header|masthead|topbar|^top$|^logo|site-?title", r"^foot|copyright|colophon|legal|imprint",
    r"^aside|sidebar|side-?bar|^right$|^left$|rail|widget|related|recommend|popular|trending|teaser", r"^ads?$|^ad-|advert|sponsor|promo|banner|commercial|outbrain|taboola",
    r"cookie|consent|notice|alert|gdpr|privacy|popup|modal|overlay|dialog|warning|message", r"comment|reply|replies|discuss|disqus|respond|thread",
    r"form|search|subscri|newsletter|login|sign-?up|signin|register|contact|button|option|label|select|fieldset|legend", r"share|social|follow|tweet|facebook",
    r"^article|^main|content|^post|entry|story|^body-?text|prose|^text$",
))
TAGS = ("html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "p", "li", "ul", "ol", "td", "table", "h1", "h2", "h3", "blockquote", "pre", "figcaption", "dd", "a")
PATH_HASH, WORD_HASH, SHAPE = 16, 16, 10
WIDTH = len(FAMILIES) + len(TAGS) + PATH_HASH + WORD_HASH + SHAPE


class Block:
    """A leaf block: its text, its path's vector, and how many of its characters are in links."""

    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text: str, path: np.ndarray, linked: int, tag: str) -> None:
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


def path_vector(above: np.ndarray, tag: str, names: str, depth: int) -> np.ndarray:
    """The vector of a path with one more element: a family or tag counts more the nearer it is."""
    out = above * 0.9
    words = [tag, *re.split(r"[\s_]+", names.lower())]
    for k, family in enumerate(FAMILIES):
        if any(family.search(w) for w in words if w):
            out[k] = 1
    at = len(FAMILIES)
    if tag in TAGS:
        out[at + TAGS.index(tag)] = 1
    for w in words[1:]:
        if w:
            out[at + len(TAGS) + zlib.crc32(w.encode()) % PATH_HASH] = 1
    return out


def blocks(page: str, known: dict, most_paths: int = 20_000) -> list[Block]:
    """The leaf blocks of a page in order; known: keeps the vectors of whole paths met before.

    Text outside any tag counts; what scripts, styles, titles and comments hold doesn't. Unclosed and stray tags are
    mended roughly as browsers do; a page cut off in the middle is read to its end.
    """
    # Each path has a number of its own, which isn't given again when the paths are cleared.
    known.setdefault("last", 0)
    stack: list[tuple[str, int, np.ndarray]] = [("", 0, np.zeros(WIDTH - WORD_HASH - SHAPE, np.float32))]
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)
    # Open elements by tag: a search of the stack is made only for what it holds, so deep pages take linear time.
    opened: Counter[str] = Counter()

    def leave(k: int) -> None:
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1][2], linked, stack[-1][0]))
        parts.clear()
        linked = 0

    def text(start: int, stop: int) -> None:
        nonlocal linked
        if stop > start:
            s = page[start:stop]
            s = html.unescape(s) if "&" in s else s
            parts.append(s)
            if in_link:
                linked += len(s.strip())

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1] or m[4])
        if tag in RAW:
            if not closing and not page.startswith("/>", m.end() - 2):
                close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
                parts.append(" ")
            continue
        if tag == "head":
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br" or tag in VOID and tag != "hr":
            if tag == "br":
                parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        end()
        if tag == "hr":
            continue
        in_link = False
        if closing:
            if opened[tag]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if stack[-1][0] == "p":
            leave(len(stack) - 1)
        for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ENDS.get(tag, ())) else ():
            if stack[k][0] in ENDS[tag]:
                leave(k)
                break
            if stack[k][0] in SCOPE:
                break
        names = " ".join(a or b or c for a, b, c in NAMES.findall(m[3] or m[6] or ""))
        key = (stack[-1][1], tag, names)
        path = known.get(key)
        if path is None:
            last = known["last"] + 1
            if len(known) > most_paths:
                known.clear()
            known["last"] = last
            path = known[key] = (last, path_vector(stack[-1][2], tag, names, len(stack)).astype(np.float32))
        stack.append((tag, *path))
        opened[tag] += 1
    end()
    return out


def features(page: list[Block]) -> np.ndarray:
    """Blocks x WIDTH."""
    m = len(page)
    out = np.zeros((m, WIDTH), np.float32)
    if not m:
        return out
    base = WIDTH - WORD_HASH - SHAPE
    length = np.array([len(b.text) for b in page], np.float32)
    for k, b in enumerate(page):
        out[k, :base] = b.path
        words = b.text.lower().encode().split(b" ")
        out[k, base : base + WORD_HASH] = np.bincount([zlib.crc32(w) % WORD_HASH for w in words], minlength=WORD_HASH) / len(words)
    s = base + WORD_HASH
    out[:, s] = np.log1p(length) / 8
    out[:, s + 1] = [b.linked / max(len(b.text), 1) for b in page]
    out[:, s + 2] = [b.text[-1] in ".!?:\"”»…" for b in page]
    out[:, s + 3] = [b.text.count(",") / max(1, len(b.text) / 80) / 4 for b in page]
    out[:, s + 4] = length > 80
    out[:, s + 5] = length > 250
    out[:, s + 6] = [b.tag in ("h1", "h2", "h3", "h4") for b in page]
    out[:, s + 7] = [b.text[0] == "©" or b.text[:3] == "(c)" for b in page]
    out[:, s + 8] = np.arange(m) / max(m - 1, 1)
    out[:, s + 9] = 1
    return out


# ---------------------------------------------------------------- the network
def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """States of a batch (pages x blocks x width), all pages starting at block 0. Gates: in, forget, out, new."""
    pages, steps, _ = x.shape
    size = u.shape[0]
    gates = x @ w + b
    h, c = np.zeros((pages, size), np.float32), np.zeros((pages, size), np.float32)
    out = np.zeros((pages, steps, size), np.float32)
    for t in range(steps):
        z = gates[:, t] + h @ u
        i, f, o = (sigmoid(z[:, k * size : (k + 1) * size]) for k in range(3))
        c = f * c + i * np.tanh(z[:, 3 * size :])
        h = o * np.tanh(c)
        out[:, t] = h
    return out


def reversed_each(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse order, with the padding left behind them."""
    at = np.arange(x.shape[1])[None, :]
    index = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, index[:, :, None], 1)


def scores(pages: list[np.ndarray], weights: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page, its blocks' log-odds of being part of the article. Pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(len(p), np.float32) for p in pages]
    order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        # Padding at most doubles a batch; a batch has 64k blocks at most, or one page.
        end, most = at, max(2 * len(pages[order[at]]), 16)
        while end < len(order) and len(pages[order[end]]) <= most and (end - at + 1) * len(pages[order[end]]) <= 1 << 16:
            end += 1
        end = max(end, at + 1)
        own = order[at:end]
        lengths = np.array([len(pages[k]) for k in own])
        x = np.zeros((len(own), lengths.max(), WIDTH), np.float32)
        for row, k in enumerate(own):
            x[row, : lengths[row]] = pages[k]
        ahead = lstm(x, weights["wf"], weights["uf"], weights["bf"], lengths)
        back = reversed_each(lstm(reversed_each(x, lengths), weights["wb"], weights["ub"], weights["bb"], lengths), lengths)
        z = np.concatenate([ahead, back], 2) @ weights["v"] + weights["c"]
        for row, k in enumerate(own):
            out[k] = z[row, : lengths[row], 0]
        at = end
    return out


def load_weights(path: str | None = None) -> dict[str, np.ndarray]:
    found = json.loads(Path(path or Path(__file__).with_name("html_weights.json")).read_text())
    return {k: np.array(v, np.float32) for k, v in found.items()}


def main_texts(pages: list[str | None], weights: dict[str, np.ndarray], known: dict) -> list[str]:
    cut = [blocks(p or "", known) for p in pages]
    found = scores([features(b) for b in cut], weights)
    return ["\n\n".join(b.text for b, s in zip(own, z, strict=True) if s > 0) for own, z in zip(cut, found, strict=True)]


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row for each page, in one pass without a shuffle.

    Null and empty pages, and pages without an article, give an empty text. References are decoded, white space within a block
    becomes one space, blocks are joined by two line feeds. Pages are read whole, cut off or not. Repeated rows each give a
    row; other columns are ignored; no rows give no rows.
    """
    weights = weights or load_weights()
    known = pages.sparkSession.sparkContext.broadcast(weights)
    rows = pages.selectExpr(f"try_cast(`{id_col}` as long) AS page_id", f"cast(`{url_col}` as string) AS url", f"cast(`{html_col}` as string) AS html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, paths = known.value, {}
        for batch in chunks(batches, "html", 1 << 20):
            found = main_texts(batch.column(2).to_pylist(), weights, paths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
