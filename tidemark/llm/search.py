"""Ranked lexical search: accumulators from short lists inside document-at-a-time skipping.

``build`` packs neighbouring documents into blocks of about ``BLOCK`` bytes of text and writes one inverted index
per block: terms, and for each term the documents (numbered inside the block) with their counts. A
list of more than ``SHORT`` entries also has, for each range of ``RANGE`` documents, the highest count and the
shortest document, from which an upper bound of its scores follows whatever the global statistics
are. Building has no shuffle; a term of a third of all words is a long list in each block, not a hot key.

``search`` adds up the global statistics (two numbers of each block, and the blocks' document
frequencies of the items' terms), then each task goes through its blocks with the best ``k`` of each item so far:

* Term at a time: the short lists of an item are scored whole and summed into one sorted list of
  accumulators, with the highest sum of each range as its bound.
* Document at a time, range by range: the accumulators are one more bounded iterator beside the long lists. A
  range whose bounds do not add up to the ``k``-th best score is skipped. In others the iterators are
  split: those with the lowest bounds, which together stay below that score, are not read for
  candidates; the rest give the candidates, and the weak ones are only looked up for candidates that
  can still get in.

A score equal to the ``k``-th best is kept until ids decide, so results are exact. A task returns at
most ``k`` rows per item; the best of them are taken in two steps (salted, then by item).

Items are taken in batches of about ``TERMS`` (item, term) pairs; a batch is what the driver and each
task hold. Defined results: a text that is NULL, empty or without a term matches nothing; rows of one
item id (NULL too) are one item with the terms of all; each row of documents is a document of its
own, repeated or NULL ids too (NULL comes last among equal scores); empty tables give no rows; extra
columns are left out. Terms that are in all documents weigh nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import LAST, squeeze, to_arrow, unsqueeze
from tidemark.session import written

BLOCK, SHORT, RANGE = 8 << 20, 128, 256
TERMS, SALTS, SLICE = 200_000, 32, 1 << 20
#: What is not part of a term.
OUTSIDE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Fixed values of the score: tf saturation and length normalisation.
K_TF, K_LENGTH, BASE, SLOPE, UNIT = 1000, 12, 75, 25, 1_000_000_000

INDEX = "docs long, words long, ids binary, lengths binary, terms binary, df binary, postings binary, counts binary, bounds binary"
FOUND = "item_id long, doc_id long, score long"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in order, a slice at a time."""
    t = text.translate(_FOLD)
    at = 0
    while at < len(t):
        end = t.find(b" ", at + SLICE)
        end = len(t) if end < 0 else end
        yield t[at:end].split()
        at = end


def pack(x: np.ndarray) -> bytes:
    """32-bit values as compressed byte planes."""
    return squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def index_block(ids: list[int], texts: list[bytes]) -> dict:
    """One row of ``INDEX``."""
    number, parts, lengths = _Numbers(), [], np.zeros(len(ids), np.int64)
    for d, text in enumerate(texts):
        own = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in terms_of(text)]
        lengths[d] = sum(map(len, own))
        parts += [(x << 32) | d for x in own]
    keys, tf = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
    term, doc = keys >> 32, keys & 0xFFFFFFFF
    df = np.bincount(term, minlength=len(number))
    far = np.repeat(df > SHORT, df)  # postings of long lists
    place, n, c = (term[far] << 32) | (doc[far] // RANGE), lengths[doc[far]], tf[far]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(place)))
    top, least = (np.maximum.reduceat(c, first), np.minimum.reduceat(n, first)) if len(first) else (first, first)
    return {
        "docs": int((lengths > 0).sum()), "words": int(lengths.sum()),
        "ids": squeeze(np.array(ids, "<i8").tobytes()), "lengths": squeeze(lengths.astype("<i8").tobytes()),
        "terms": squeeze(b"".join(t + b"\n" for t in number)), "df": pack(df),
        "postings": pack(np.diff(doc, prepend=0) & 0xFFFFFFFF), "counts": pack(tf),
        "bounds": squeeze(np.stack([place[first] & 0xFFFFFFFF, size, top, least]).astype("<i8").tobytes()),
    }


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bytes: int = BLOCK) -> DataFrame:
    """The index: a row per block. Every row of ``docs`` is in it; write it to search more than once."""
    schema = to_arrow(INDEX)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                ids.append(i)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= most_bytes:
                    yield pa.RecordBatch.from_pylist([index_block(ids, texts)], schema=schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([index_block(ids, texts)], schema=schema)

    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("text")).mapInArrow(task, INDEX)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term, times``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate(F.col(text), upper, lower), F.lit(f"[^{OUTSIDE}]+"), F.lit(0))
    return items.select(F.col(item_id).cast("long").alias("item_id"), F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _term_array(raw: bytes) -> pa.Array:
    """Terms with the line feed that ends each."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b == 10) + 1
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(raw)])


def _wanted(terms: list[str]) -> pa.Array:
    return pa.array([t.encode() + b"\n" for t in terms], pa.large_binary())


def frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of the terms is."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = _wanted(terms), np.zeros(len(terms), np.int64)
        for b in batches:
            for raw, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = pc.index_in(wanted, value_set=_term_array(unsqueeze(raw))).fill_null(-1).to_numpy(zero_copy_only=False)
                total[at >= 0] += unpack(df)[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    rows = index.select("terms", "df").mapInArrow(task, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {terms[r["term"]]: r["df"] for r in rows}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (K_TF * tf + K_LENGTH * m)


class Best:
    """The best ``k`` (score, id) of one item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach; equal scores may still win by their ids."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


class Block:
    """An index block under global statistics (``n`` documents, ``words`` in all)."""

    def __init__(self, row: dict, n: int, words: int):
        self.ids = np.frombuffer(unsqueeze(row["ids"]), "<i8")
        lengths = np.frombuffer(unsqueeze(row["lengths"]), "<i8")
        self.m = BASE + SLOPE * lengths * n // words
        self.df = unpack(row["df"]).astype(np.int64)
        self.begin = np.cumsum(self.df) - self.df
        self.doc = np.cumsum(unpack(row["postings"]), dtype=np.uint32).astype(np.int64)
        self.tf = unpack(row["counts"]).astype(np.int64)
        self.terms = _term_array(unsqueeze(row["terms"]))
        place, size, top, least = np.frombuffer(unsqueeze(row["bounds"]), "<i8").reshape(4, -1)
        self.place, self.bound = place, saturated(top, BASE + SLOPE * least * n // words)
        # the long lists lie end to end in ``bounds``: groups of list i are those whose postings are its own
        long = self.df > SHORT
        ends = np.cumsum(self.df[long])
        cut = np.append(0, np.searchsorted(np.cumsum(size), ends, side="left") + 1)
        self.groups = {int(t): (int(a), int(b)) for t, a, b in zip(np.flatnonzero(long), cut, cut[1:])}
        self.group_begin = np.zeros(len(size), np.int64)
        for t, (a, b) in self.groups.items():
            self.group_begin[a:b] = self.begin[t] + np.cumsum(size[a:b]) - size[a:b]
        self.group_end = self.group_begin + size

    def accumulate(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: summed scores of whole lists, by document."""
        df = self.df[terms]
        at = np.repeat(self.begin[terms] - (np.cumsum(df) - df), df) + np.arange(int(df.sum()))
        doc = self.doc[at]
        score = np.repeat(weights, df) * saturated(self.tf[at], self.m[doc])
        order = np.argsort(doc, kind="stable")
        doc, score = doc[order], score[order]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        return doc[first], np.add.reduceat(score, first) if len(first) else score

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Document at a time over the accumulators of the short lists and the long lists."""
        far = self.df[terms] > SHORT
        doc, score = self.accumulate(terms[~far], weights[~far])
        ranges = 1 + (len(self.ids) - 1) // RANGE
        long, w = terms[far], weights[far]
        bounds = np.zeros((1 + len(long), ranges), np.int64)
        edges = np.searchsorted(doc, np.arange(ranges + 1) * RANGE)
        some = np.flatnonzero(edges[1:] > edges[:-1])
        if len(some):
            bounds[0, some] = np.maximum.reduceat(score, edges[some])
        group = np.full((1 + len(long), ranges), -1)
        for i, (t, x) in enumerate(zip(long.tolist(), w.tolist()), 1):
            a, b = self.groups[t]
            bounds[i, self.place[a:b]] = x * self.bound[a:b]
            group[i, self.place[a:b]] = np.arange(a, b)
        total = bounds.sum(axis=0)
        for r in np.flatnonzero(total >= best.least).tolist():
            least = best.least
            if total[r] < least:
                continue
            here = bounds[:, r]
            order = [i for i in np.argsort(here, kind="stable").tolist() if here[i]]
            below = np.cumsum(here[order])
            weak = int(np.searchsorted(below, least, side="left"))  # these alone stay below the least score
            sums, base = np.zeros(RANGE, np.int64), r * RANGE
            for i in order[weak:]:
                self._score(i, r, sums, base, None, group, w, doc, score, edges)
            open_ = sums > 0
            for j in range(weak - 1, -1, -1):
                open_ &= sums + below[j] >= least
                if not open_.any():
                    break
                self._score(order[j], r, sums, base, open_, group, w, doc, score, edges)
            got = np.flatnonzero(open_ & (sums >= least))
            if len(got):
                best.add(sums[got], self.ids[base + got])

    def _score(self, i: int, r: int, sums, base, only, group, w, doc, score, edges) -> None:
        """Add what iterator ``i`` gives in range ``r``, for the documents in ``only``."""
        if i == 0:
            at, add = doc[edges[r] : edges[r + 1]] - base, score[edges[r] : edges[r + 1]]
            if only is not None:
                at, add = at[only[at]], add[only[at]]
        else:
            g = group[i, r]
            s = slice(self.group_begin[g], self.group_end[g])
            at, tf = self.doc[s] - base, self.tf[s]
            if only is not None:
                hit = only[at]
                at, tf = at[hit], tf[hit]
            add = w[i - 1] * saturated(tf, self.m[base + at])
        sums[at] += add


def _search_batch(index: DataFrame, rows: list, n: int, words: int, k: int) -> DataFrame:
    """The best ``k`` of each task and item of a batch (rows of item, term, times)."""
    terms = sorted({r["term"] for r in rows})
    df = frequencies(index, terms)
    number = {t: i for i, t in enumerate(terms)}
    by_item: dict = {}
    for r in rows:
        if r["term"] in df and (w := weight(n, df[r["term"]])):
            by_item.setdefault(r["item_id"], []).append((number[r["term"]], w * r["times"]))
    schema = to_arrow(FOUND)
    items = [(item, np.array([t for t, _ in x]), np.array([w for _, w in x], np.int64)) for item, x in by_item.items()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, best = _wanted(terms), [Best(k) for _ in items]
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if not row["docs"]:
                    continue
                block = Block(row, n, words)
                at = pc.index_in(wanted, value_set=block.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                for (_, own, weights), x in zip(items, best):
                    there = at[own] >= 0
                    if there.any():
                        block.search(at[own[there]], weights[there], x)
        out = [(item, d if d != LAST else None, s) for (item, _, _), x in zip(items, best) for d, s in zip(x.id.tolist(), x.score.tolist())]
        yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "doc_id", "score"), r)) for r in out], schema=schema)

    return index.mapInArrow(task, FOUND)


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    total = index.agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    n, words = total["n"] or 0, total["words"] or 0
    asked = written(item_terms(items), "item-terms")
    batches = 1 + asked.count() // TERMS
    found = None
    for i in range(batches):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == i).collect()
        part = _search_batch(index, rows, n, words, k)
        found = part if found is None else found.unionByName(part)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    some = top(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "item_id", "salt")
    return top(some.drop("rank", "salt"), "item_id").select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index all of ``docs`` (written to the shared folder) and search it."""
    return search(written(build(docs), "lexical-index"), items, k)
