"""Substring dedup with fixed-block anchors.

Reference blocks are the non-overlapping runs of ``b`` words at word 0, b, 2b, ... of every
document, with ``2b - 1 = WINDOW`` words: every window of that length holds one whole reference
block. The blocks' hashes are indexed by shard, and every rolling run of ``b`` words of every
document probes the index (packed, see ``blocks``). A probe that hits a block elsewhere is a seed.
Seeds are found by 32 bits of the hash and the shard's number, so some are false; they only choose what
is compared next. The windows around seeds are then compared by 128-bit hashes, sent whole,
which extends the true seeds to maximal exact repeats: a maximal repeat is a chain of windows that each
occur twice or more, and all of its words go.

Three passes over the blocks: probe, extend, cut. Both exchanges carry packed values.

Defined results: NULL and blank texts have no words and nothing is removed; repeated rows are
documents of their own, so they remove each other; a NULL id stays NULL; an empty table gives
an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import blocks as bl
from tidemark.llm import wordhash as wh
from tidemark.session import written

WINDOW = 35
BLOCK_BYTES = 6 << 20
SHARD_BYTES = 6 << 20
#: The second half of the windows' hashes starts from another word hash.
SEED = 0x5851F42D4C957F2D

RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, length: long>>, kept_sha256 string, kept_text string"


class _Words:
    """Words of a block and the hashes of their runs; ``fits[n]`` marks the starts of runs of
    ``n`` words inside one document."""

    def __init__(self, b: bl.Block, window: int):
        self.starts, self.ends, self.doc = wh.find_words(b.data, b.offsets)
        self.data = b.data
        self.h = wh.hash_words(b.data, self.starts, self.ends)
        self.count = np.bincount(self.doc, minlength=len(b.ids))
        self.first = np.cumsum(self.count) - self.count
        self.place = np.arange(len(self.doc)) - self.first[self.doc]
        self.anchor = (window + 1) // 2

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of ``n`` words inside one document, and their hashes."""
        h = wh.rolling(self.h, n)
        at = self.inside(len(h), n)
        return at, h[at]

    def inside(self, size: int, n: int) -> np.ndarray:
        return np.flatnonzero(self.doc[:size] == self.doc[n - 1 :]) if size else np.zeros(0, int)


def _seeds(w: _Words, shards: int) -> tuple[np.ndarray, bl.Values]:
    at, h = w.runs(w.anchor)
    return at, bl.Values(h, shards)


def _windows(w: _Words, at: np.ndarray, seed: np.ndarray, shards: int, window: int) -> tuple[np.ndarray, bl.WideValues]:
    """Windows that hold a reference block which is a seed."""
    block = at[seed & (w.place[at] % w.anchor == 0)]
    near = np.zeros(len(w.doc), bool)
    for back in range(w.anchor):
        near[block[w.place[block] >= back] - back] = True
    h = wh.rolling(w.h, window)
    start = w.inside(len(h), window)
    start = start[near[start]]
    other = wh.rolling(wh.hash_words(w.data, w.starts, w.ends, SEED), window)
    return start, bl.WideValues(np.stack([h[start], other[start]], axis=1), shards)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per document: words, removed words, removed spans (in words), the kept words
    joined by one space (``with_text``) and their SHA-256."""
    size = bl.text_bytes(docs, text)
    shards = max(1, size // SHARD_BYTES)
    table = bl.bucketed(bl.make_blocks(docs, doc_id, text, BLOCK_BYTES), max(1, min(size // (2 * BLOCK_BYTES), 100_000)), "words")

    def probe(b: bl.Block) -> pa.Table:
        w = _Words(b, window)
        at, v = _seeds(w, shards)
        anchored = np.zeros(len(v.keys), bool)
        anchored[v.inverse[w.place[at] % w.anchor == 0]] = True
        return v.runs(b.block, v.counts > 1, anchored)

    first = written(bl.ask_repeated(bl.each_block(table, probe, bl.RUNS)), "seeds")

    def by_shard(rows: list[dict]) -> dict[int, bytes]:
        return {r["shard"]: r["run"] for r in rows}

    def extend(b: bl.Block, rows: list[dict]) -> pa.Table:
        w = _Words(b, window)
        at, v = _seeds(w, shards)
        _, win = _windows(w, at, v.answered(by_shard(rows))[v.inverse], shards, window)
        return win.runs(b.block, win.counts > 1)

    second = bl.ask_repeated(bl.each_answered(table, first, extend, bl.RUNS), wide=True)
    # the second round's shards are numbered below zero, so that one co-group brings both answers
    both = first.unionByName(second.selectExpr("block", "-1 - shard AS shard", "run"))

    def cut(b: bl.Block, rows: list[dict]) -> pa.Table:
        w = _Words(b, window)
        at, v = _seeds(w, shards)
        start, win = _windows(w, at, v.answered(by_shard(r for r in rows if r["shard"] >= 0))[v.inverse], shards, window)
        twice = win.answered({-1 - r["shard"]: r["run"] for r in rows if r["shard"] < 0})[win.inverse]
        gone = bl.spread(start[twice], window, len(w.doc))
        data, out = b.data.tobytes(), []
        for i, (s, n) in enumerate(zip(w.first.tolist(), w.count.tolist())):
            g = gone[s : s + n]
            edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
            kept = b" ".join([data[x:y] for x, y in zip(w.starts[s : s + n][~g].tolist(), w.ends[s : s + n][~g].tolist())])
            doc = int(b.ids[i])
            out.append(
                {
                    "doc_id": None if doc == bl.LAST else doc,
                    "n_words": n,
                    "n_removed": int(g.sum()),
                    "spans": [{"start": int(x), "length": int(y - x)} for x, y in zip(edge[::2], edge[1::2])],
                    "kept_sha256": hashlib.sha256(kept).hexdigest(),
                    "kept_text": kept.decode() if with_text else None,
                }
            )
        return pa.Table.from_pylist(out, schema=schema)

    schema = bl.to_arrow(RESULT)
    return bl.each_answered(table, both, cut, RESULT)
