"""Main text of web pages by the maximum-scoring subsequence.

A page is read as tags and runs of text. Words of likely content score positive, words below unlikely elements and
all tags score negative, and one linear scan finds the contiguous region with the highest sum: what lies
outside it is dropped, however good it looks by itself. Runs inside the region that score negative (an advert in
the middle of an article) are left out. Of equal regions the first one counts.

Scores come from labelled pages: a page is labelled if its address ends in the number of a known document, whose
text tells which blocks are content. For every kind of element (name and class; an element without a class
also by the nearest one that has one or divides the page) the words below it are counted inside and outside the
truth. Its weight is the log-odds of content, less those of all blocks. A word scores one plus the lowest
weight around it, between ``OUTSIDE`` and 1; a tag costs the more the less its element belongs to articles. Elements
that no labelled page shows get a prior from their name, role, class and id (menus, headers, footers,
sidebars, notices, adverts, forms, comments).

Weights are fitted on at most ``LABELLED`` labelled pages (those with the smallest page ids), so the
table of weights is bounded and goes to the tasks as plain values. Reading is linear in the page, whatever is in it:
quotes that never close are skipped once, open elements are found by name.

Character references are decoded; white space (space, \\t-\\r) inside a block becomes one space; the text is
trimmed of it and blocks are joined in page order by one space. Inline tags separate nothing. Other space (a decoded
no-break space) is text.

Defined results: NULL or empty html gives an empty text; a page without tags is all text; repeated rows
are extracted each; without any labelled page the priors decide; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 2000
#: Words that a block needs before it says anything about its elements.
TELLING = 4
PRIOR = 3.0
TEXTS = "page_id long, url string, text string, n_chars long"

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are not shown, and elements and words in roles, classes and ids that stand beside articles.
_NEVER = {"script", "style", "head", "title", "template", "svg", "noscript", "iframe", "object", "select", "option", "button", "textarea", "input", "canvas"}
_BESIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_HINTS = set("ad ads banner cookie cookies consent gdpr notice notification alert popup modal breadcrumb breadcrumbs header masthead footer sidebar aside widget related share sharing social comment comments "
             "commentlist replies disqus respond newsletter subscribe signup login search form toolbar pagination navigation complementary contentinfo".split())
_HINT_STARTS = ("advert", "sponsor", "promo", "nav", "menu", "recommend")
#: Elements that divide a page: those without a class inside them are told apart by them.
_LANDMARKS = _BESIDE | {"article", "section", "main", "table", "blockquote", "figure"}
#: What a word scores at least, and a tag costs at least and per point of a negative weight.
OUTSIDE, TAG, TAG_MORE, LOWEST = -0.3, 0.05, 0.1, 5.0


def _hinted(value: str) -> bool:
    words = re.split(r"[-_\s]+", value.lower())
    return any(w in _HINTS or w.startswith(_HINT_STARTS) for w in words) or any(a + b == "sidebar" for a, b in zip(words, words[1:]))


def _read_element(name: str, attributes: str) -> tuple[str, float]:
    """Name with its first class, and the prior: -PRIOR for what stands beside an article."""
    found = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    beside = name in _NEVER or name in _BESIDE or any(map(_hinted, found.values()))
    return name + "." + "".join(found.get("class", "").split()[:1]), -PRIOR if beside else 0.0


class _Page:
    """Cuts a page into markup and text."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.unclosed = {'"': self.n, "'": self.n}  # from here on there is no such quote

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag (or the page's end); quoted ones do not."""
        while m := _STOP.search(self.page, at):
            c = m[0]
            if c == ">":
                return m.start()
            at = m.end()
            if at <= self.unclosed[c]:
                close = self.page.find(c, at)
                if close < 0:
                    self.unclosed[c] = m.start()
                else:
                    at = close + 1
        return self.n

    def parts(self) -> Iterator[tuple]:
        """``(text before, closing, name, attributes, end)`` of each piece of markup; the name is None for
        comments and the like, and at the end of the page."""
        at = done = 0
        while (lt := self.page.find("<", at)) >= 0:
            nxt = self.page[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                if self.page.startswith("<!--", lt):
                    end = self.page.find("-->", lt + 4)
                    end = self.n if end < 0 else end + 3
                else:
                    end = self.page.find(">", lt)
                    end = self.n if end < 0 else end + 1
                at = yield self.page[done:lt], False, None, "", end
            else:
                closing = nxt == "/"
                m = _NAME.match(self.page, lt + 1 + closing)
                if not m:
                    at = lt + 1  # a lone sign is text
                    continue
                stop = self.tag_end(m.end())
                at = yield self.page[done:lt], closing, m[0].lower(), self.page[m.end() : stop], stop + 1
            done = at
        yield self.page[done:], False, None, "", self.n


class _Open:
    """The open elements, with the weight of the least likely one around each."""

    def __init__(self, weights: dict[str, float] | None):
        self.weights, self.stack, self.places, self.kinds = weights, [], {}, {}

    def push(self, name: str, attributes: str) -> str:
        kind, prior = _read_element(name, attributes)
        mark = kind if name in _LANDMARKS or not kind.endswith(".") else self.stack[-1][2] if self.stack else ""
        if mark != kind:
            kind += "<" + mark
        low = self.stack[-1][3] if self.stack else 0.0
        if self.weights is not None:
            low = min(low, prior if name in _NEVER else self.weights.get(kind, prior))  # what is not shown is no text, whatever it says
        self.places.setdefault(name, []).append(len(self.stack))
        self.kinds[kind] = self.kinds.get(kind, 0) + 1
        self.stack.append((name, kind, mark, low))
        return kind

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            name, kind, *_ = self.stack.pop()
            self.places[name].pop()
            self.kinds[kind] -= 1
            if not self.kinds[kind]:
                del self.kinds[kind]

    def last(self, name: str) -> int:
        own = self.places.get(name)
        return own[-1] if own else -1

    @property
    def lowest(self) -> float:
        return self.stack[-1][3] if self.stack else 0.0


_CELLS = ("li", "tr", "td", "th", "dt", "dd", "option")
_HOLDERS = ("ul", "ol", "table", "article", "section", "div", "blockquote")


def tokens(page: str, weights: dict[str, float] | None = None) -> Iterator[tuple]:
    """``("tag", opens or ends a block, kind)`` and ``("text", raw text, lowest weight around it, kinds around it)``; kinds are given
    without ``weights`` only, when weights are fitted."""
    open_, source = _Open(weights), _Page(page)
    parts = source.parts()
    at = None
    while True:
        try:
            before, closing, name, attributes, end = parts.send(at)
        except StopIteration:
            return
        at = end
        if before:
            yield "text", before, open_.lowest, list(open_.kinds) if weights is None else None
        if name is None:
            continue
        block, kind = name not in _INLINE, ""
        if closing:
            place = open_.last(name)
            if place >= 0:
                kind = open_.stack[place][1]
                open_.cut(place)
        elif name not in _VOID and not attributes.endswith("/"):
            if block and name != "p" and open_.stack and open_.stack[-1][0] == "p" or name == "p" or name in _CELLS:
                same = open_.last(name if name in _CELLS else "p")
                if same >= 0 and all(open_.last(h) <= same for h in _HOLDERS):
                    open_.cut(same)
            kind = open_.push(name, attributes)
        yield "tag", block, kind
        if not closing and name in _RAW and open_.stack and open_.stack[-1][0] == name:
            close = re.compile(rf"</{name}\b", re.I).search(page, at)
            stop = close.start() if close else source.n
            if name in ("textarea", "title") and stop > at:
                yield "text", page[at:stop], open_.lowest, list(open_.kinds) if weights is None else None
            open_.cut(len(open_.stack) - 1)
            at = source.tag_end(stop) + 1 if close else source.n
            yield "tag", True, kind


def _plain(raw: str) -> str:
    return entities.unescape(raw)


def _trim(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def _blocks(page: str) -> Iterator[tuple[str, list]]:
    """Text of each block (white space collapsed) with the kinds of elements around its start."""
    parts, around = [], []
    for t in tokens(page):
        if t[0] == "text":
            if not parts:
                around = t[3]
            parts.append(t[1])
        elif t[1]:
            if text := _trim(_plain("".join(parts))):
                yield text, around
            parts = []
    if text := _trim(_plain("".join(parts))):
        yield text, around


def count_labelled(labelled: DataFrame) -> DataFrame:
    """``labelled``: ``html, truth``. Words below each kind of element, inside and outside the truth; those of all blocks under an empty name."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for b in batches:
            for page, truth in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known = _SPACE.sub(" ", truth or "")
                for text, around in _blocks(page or ""):
                    words = text.count(" ") + 1
                    if words >= TELLING:
                        for kind in ("", *around):
                            sums.setdefault(kind, [0, 0])[text not in known] += words
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), *(pa.array([v[k] for v in sums.values()], pa.int64()) for k in (0, 1))], names=["kind", "inside", "outside"]
        )

    counts = labelled.select("html", "truth").mapInArrow(task, "kind string, inside long, outside long")
    return counts.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def fit(pages: DataFrame, documents: DataFrame) -> dict[str, float]:
    """Log-odds per kind of element from at most ``LABELLED`` pages whose address names a document."""
    number = F.regexp_extract(F.col("url"), r"/(\d{1,18})/?(?:[?#].*)?$", 1)
    named = pages.select("page_id", number.alias("n")).filter("n != '' AND page_id IS NOT NULL")
    # numbers alone are put in order: at most LABELLED of them, so they can go to every task
    some = named.select("page_id", F.expr("try_cast(n AS long)").alias("doc_id")).orderBy("page_id", "doc_id").limit(LABELLED)
    truth = documents.select("doc_id", F.col("text").alias("truth")).join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    labelled = pages.select("page_id", "html").join(F.broadcast(some), "page_id").join(truth, "doc_id")
    rows = {r["kind"]: math.log((r["inside"] + 1) / (r["outside"] + 1)) for r in count_labelled(labelled).collect()}
    usual = rows.pop("", 0.0)
    return {k: v - usual for k, v in rows.items()}


def region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous run with the highest sum; empty if no sum is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def scored(page: str, weights: dict[str, float]) -> tuple[list[str], list[float]]:
    """Runs of a page (a block's edge is a blank) and their scores."""
    runs, scores = [], []
    for t in tokens(page, weights):
        if t[0] == "tag":
            runs.append(" " if t[1] else "")
            scores.append(-TAG - TAG_MORE * min(LOWEST, max(0.0, -weights.get(t[2], 0.0))))
        else:
            words = len(_trim(t[1]).split(" ")) if t[1].strip(" \t\n\x0b\x0c\r") else 0
            runs.append(t[1])
            scores.append(words * max(OUTSIDE, min(1.0, 1.0 + t[2])))
    return runs, scores


def main_text(page: str, weights: dict[str, float]) -> str:
    """Text of the best region."""
    runs, scores = scored(page, weights)
    a, b = region(scores)
    parts = [r for r, s in zip(runs[a:b], scores[a:b]) if s > 0 or not r.strip()]
    # references are decoded after the blocks are told apart: a decoded space is text, too
    return _trim(_plain("".join(parts)))


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "", weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(task, TEXTS)
