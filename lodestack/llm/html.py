"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with their tag path. Each block
becomes a vector of hashed tag-path marks, hashed words and a few shape measures; a bidirectional LSTM
reads the page's blocks in order and labels every one as article or not, so a block is judged by the whole
page. Weights are trained by html_train.py and kept beside this file.
"""

from __future__ import annotations

import html
import io
import math
import pkgutil
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 128, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS
HIDDEN = 16

#: Content is never text of the page. What is not a tag in there reads to its end tag, or else to the end of the page.
_RAW = frozenset("script style iframe title textarea".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
#: Left out as well, but only up to an end tag of their own.
_LEFT_OUT = frozenset("noscript template svg math object select canvas audio video".split())
_FOREIGN = frozenset({"svg", "math"})
#: Tags that do not end a head.
_IN_HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())
_HEAD_END = re.compile(r"</head\s*>", re.I)
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*>",
    re.I | re.S,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the left closes an open tag of the right.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_OPTIONS = frozenset({"option", "optgroup"})
#: Tags that end an unclosed drawing or formula.
_HTML_ONLY = _BREAKS_P | frozenset("b big body br center code dd dt em embed i img li menu nobr ruby s small span strike strong sub sup tr td th tbody thead tt u var html figure figcaption label button".split())
_MARK = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


def _marks(tag: str, attrs: str) -> list[int]:
    """Hashed marks of an element: its tag and the letter runs of its class, id and role."""
    found = [crc32(tag.encode()) % PATH_DIMS]
    if attrs and "=" in attrs:
        for m in _MARK.finditer(attrs):
            for name in _NAME.findall((m[1] or m[2] or m[3] or "").lower()):
                found.append(crc32(b"." + name.encode()) % PATH_DIMS)
    return found


def _tokens(src: str) -> list[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or None, is an end tag, attributes) of the page's tags; what is left out is one token without a tag.

    An element of _LEFT_OUT that lacks an end tag of its own: a foreign one ends at the first tag that HTML does
    not allow in it, a select at the first tag but an option's, of others only the tag is left out.
    """
    found: list[tuple[int, int, str | None, bool, str]] = []
    opened: dict[str, list[int]] = {}
    closes: dict[int, int] = {}
    at = 0
    while m := _TOKEN.search(src, at):
        a, at = m.span()
        tag = m["tag"]
        if tag is None:
            found.append((a, at, None, False, ""))
            continue
        tag, ends, attrs = tag.lower(), bool(m["end"]), m["attrs"]
        empty = attrs.endswith("/")
        if tag in _RAW and not ends:
            if not (empty and any(opened.get(f) for f in _FOREIGN)):
                stop = _RAW_END[tag].search(src, at)
                at = stop.end() if stop else len(src)
            found.append((a, at, None, False, ""))
            continue
        if tag in _LEFT_OUT:
            if ends:
                if opened.get(tag):
                    closes[opened[tag].pop()] = len(found)
            elif not (empty and tag in _FOREIGN and (len(attrs) < 2 or attrs[-2] in " \t\r\n\f\"'")):
                opened.setdefault(tag, []).append(len(found))
        found.append((a, at, tag, ends, attrs))
    out = []
    i = 0
    while i < len(found):
        a, at, tag, ends, attrs = found[i]
        if tag in _LEFT_OUT:
            j = i + 1
            if ends:
                pass
            elif i in closes:
                at, j = found[closes[i]][1], closes[i] + 1
            elif tag == "select" or (tag in _FOREIGN and not attrs.endswith("/")):
                inside = (lambda t: t is None or t in _OPTIONS) if tag == "select" else (lambda t: t is None or t not in _HTML_ONLY)
                while j < len(found) and inside(found[j][2]):
                    j += 1
                at = found[j][0] if j < len(found) else found[j - 1][1]
            out.append((a, at, None, False, ""))
            i = j
            continue
        out.append(found[i])
        i += 1
    return out


class Block:
    __slots__ = ("linked", "marks", "tag", "text")

    def __init__(self, text: str, linked: int, marks: tuple[int, ...], tag: str):
        self.text, self.linked, self.marks, self.tag = text, linked, marks, tag


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order. References are decoded, white space is one space; empty blocks are left out.

    A page that breaks off is read to its end; an unclosed element ends with its parent.
    """
    out: list[Block] = []
    stack: list[tuple[str, list[int]]] = []
    held: list[str] = []
    linked = 0
    anchors = 0
    at = 0
    src = page or ""
    head = shut = False
    last_end = None

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                marks = tuple({m for _, ms in stack for m in ms})
                out.append(Block(text, min(linked, len(text)), marks, stack[-1][0] if stack else ""))
        linked = 0

    for a, stop, tag, ends, attrs in _tokens(src):
        if a > at:
            piece = src[at:a]
            # Text ends a head that lacks its end tag.
            head = head and (shut or piece.isspace())
            if not head:
                held.append(piece)
                if anchors:
                    linked += len(piece)
        at = stop
        if tag is None:
            continue
        if tag == "head":
            flush()
            head = not ends
            if last_end is None:
                last_end = max((m.start() for m in _HEAD_END.finditer(src)), default=-1)
            shut = head and last_end >= at
            continue
        if head and tag not in _IN_HEAD:
            head = False
        if tag in _INLINE:
            if tag == "br" or tag in {"td", "th"}:
                held.append(" ")
            if tag == "a":
                anchors = 0 if ends else 1
            continue
        flush()
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in _VOID:
            continue
        if stack and (stack[-1][0] in _CLOSES.get(tag, ()) or (stack[-1][0] == "p" and tag in _BREAKS_P)):
            stack.pop()
        stack.append((tag, _marks(tag, attrs)))
    if at < len(src) and not (head and shut):
        held.append(src[at:])
    flush()
    return out


_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def vectors(page: list[Block]) -> np.ndarray:
    n = len(page)
    x = np.zeros((n, DIMS), dtype=np.float32)
    for i, b in enumerate(page):
        x[i, list(b.marks)] = 1.0
        words = b.text.encode("utf-8", "replace").lower().split()
        counts = np.bincount([crc32(w) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / max(1.0, math.sqrt(float((counts * counts).sum())))
        k, length = len(words), len(b.text)
        x[i, PATH_DIMS + WORD_DIMS :] = (math.log1p(k) / 5, b.linked / length, b.tag in _HEADINGS, b.tag == "p", b.tag == "li", b.text[-1] in ".!?", i / n, min(n, 100) / 100)
    return x


class Labeller:
    """Bidirectional LSTM over many pages at once; pages of equal rank step together."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def load(cls) -> Labeller:
        data = np.load(io.BytesIO(pkgutil.get_data("lodestack.llm", "html_weights.npz")))
        return cls({k: data[k] for k in data.files})

    def _run(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, way: str) -> np.ndarray:
        """Hidden states per block; ``lengths`` must not grow, so that active pages are always the first ones."""
        wx, wh, b = self.w[f"{way}x"], self.w[f"{way}h"], self.w[f"{way}b"]
        given = x @ wx + b
        hidden = np.zeros((len(x), HIDDEN), dtype=np.float32)
        h, c = np.zeros((len(starts), HIDDEN), dtype=np.float32), np.zeros((len(starts), HIDDEN), dtype=np.float32)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            k = int(np.searchsorted(-lengths, -t, side="left"))
            rows = starts[:k] + t if way == "f" else starts[:k] + lengths[:k] - 1 - t
            z = given[rows] + h[:k] @ wh
            gates = 1.0 / (1.0 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            c[:k] = f * c[:k] + i * np.tanh(z[:, 3 * HIDDEN :])
            h[:k] = o * np.tanh(c[:k])
            hidden[rows] = h[:k]
        return hidden

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        lengths = np.array([len(pages[i]) for i in order], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if order else np.zeros(0, dtype=np.int64)
        x = np.concatenate([pages[i] for i in order]) if order else np.zeros((0, DIMS), dtype=np.float32)
        both = np.concatenate([self._run(x, starts, lengths, "f"), self._run(x, starts, lengths, "r")], axis=1)
        p = 1.0 / (1.0 + np.exp(-(both @ self.w["o"] + self.w["ob"])))[:, 0]
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        for j, i in enumerate(order):
            out[i] = p[starts[j] : starts[j] + lengths[j]]
        return out


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The blocks labelled as article, joined by two newlines; empty if there are none."""
    cut = [blocks(p) for p in pages]
    probs = labeller.probabilities([vectors(b) for b in cut])
    return ["\n\n".join(b.text for b, p in zip(bs, ps, strict=True) if p > 0.5) for bs, ps in zip(cut, probs, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages(page_id, url, html)``.

    Null or empty html gives an empty text; repeated rows give equal texts; long pages are read whole; other
    columns are not read; no rows, no result.
    """
    import pyarrow as pa

    def run(batches):
        labeller = Labeller.load()
        for batch in batches:
            n = len(batch)
            at = 0
            while at < n:
                # Bounded groups: many short pages or few long ones.
                end, size = at, 0
                held = []
                while end < n and len(held) < 1024 and size < 8 << 20:
                    v = batch.column(2)[end].as_py()
                    held.append(v)
                    size += len(v or "")
                    end += 1
                texts = main_texts(held, labeller)
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at = end

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
