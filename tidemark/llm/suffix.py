"""Suffix-array dedup with a logarithmic index family.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
id. Documents are put in order of ids and packed into blocks; a shard of the index takes the blocks
as batches, in that order. A batch's suffixes (cut off at ``LENGTH`` bytes) are sorted into a suffix
array, which is merge-scanned against the sorted arrays of all levels for matches of full length,
and then becomes a level itself; two levels of equal size merge into one of twice the size. So
after ``n`` batches there are at most log2(n) + 1 levels, and a suffix is merged as many times.

Not every suffix is worth indexing. In every window of ``LENGTH`` bytes one run of ``GRAM`` bytes is
picked by its content (the one with the smallest hash): two equal windows pick the same run. A
first, packed exchange finds the picked runs that occur in two documents or more; only windows
around these are sent, as contexts, to the shard of their run. No match is lost by it: it is a
necessary condition. Strings are compared byte by byte in the arrays; inside a block, by hash.

Defined results: NULL text is empty; documents with a NULL id come last and, like rows that share
an id, remove nothing from each other; an empty table gives an empty result; extra columns are left
out. ``kept_text`` leaves out characters of which only a part remains.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import blocks as bl
from tidemark.session import written

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
#: Batches that a shard's family takes.
BATCHES = 16

RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept_sha256 string, kept_text string"


class Family:
    """Levels of sorted distinct suffixes. Level ``k`` holds 2^k batches."""

    def __init__(self):
        self.levels: dict[int, np.ndarray] = {}

    def seen(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the sorted suffixes are in some level: both sides are sorted, so a scan of the
        merged order finds equal neighbours."""
        found = np.zeros(len(suffixes), bool)
        for level in self.levels.values():
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            found |= level[at] == suffixes
        return found

    def add(self, suffixes: np.ndarray) -> None:
        """Take in a sorted array of distinct suffixes that are in no level yet."""
        k = 0
        while k in self.levels:
            suffixes = np.sort(np.concatenate([self.levels.pop(k), suffixes]), kind="stable")
            k += 1
        if len(suffixes):
            self.levels[k] = suffixes


def _loads(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on, as one number each."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def _hash_runs(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from every place on."""
    e, m = _loads(data), max(0, len(data) - n + 1)
    h = np.full(m, n, np.uint64)
    for at in [*range(0, n - 8, 8), n - 8]:
        h = (h ^ e[at : at + m]) * bl.M1
        h ^= h >> np.uint64(29)
    return bl.mix(h)


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    size = 1
    while size < n:
        step = min(size, n - size)
        x = best(x[:-step], x[step:])
        size += step
    return x


class _Picks:
    """Stretches of neighbouring windows that pick the same run: ``h`` (its hash), ``lo`` and ``hi``
    (first and last start of the windows), ``doc`` (number in the block)."""

    def __init__(self, b: bl.Block):
        spread = LENGTH - GRAM + 1
        self.lo = self.hi = np.zeros(0, np.int64)
        self.h = np.zeros(0, np.uint64)
        if len(b.data) >= LENGTH:
            low = _slide(_hash_runs(b.data, GRAM) | np.uint64(1), spread, np.minimum)
            # windows that would leave their document pick nothing
            out = (b.offsets[1:, None] - np.arange(1, LENGTH)).ravel()
            low[out[(out >= 0) & (out < len(low))]] = 0
            edge = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]])
            lo, hi = edge[:-1], edge[1:] - 1
            lo, hi = lo[low[lo] > 0], hi[low[lo] > 0]
            # equal hashes side by side (runs of one character) make long stretches: cut them up
            n = (hi - lo) // spread + 1
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            self.lo = np.repeat(lo, n) + j * spread
            self.hi = np.minimum(np.repeat(hi, n), self.lo + spread - 1)
            self.h = low[self.lo]
        self.doc = np.searchsorted(b.offsets, self.lo, side="right") - 1


def _rank(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1]


def _several(v: bl.Values, doc: np.ndarray) -> np.ndarray:
    """Values that occur in two documents of the block."""
    lo, hi = np.full(len(v.keys), 2**62), np.full(len(v.keys), -1)
    np.minimum.at(lo, v.inverse, doc)
    np.maximum.at(hi, v.inverse, doc)
    return lo < hi


class _Contexts:
    """Distinct contexts of the stretches that passed: the bytes of all their windows."""

    WIDE = 2 * LENGTH - GRAM

    def __init__(self, b: bl.Block, p: _Picks, passed: np.ndarray, shards: int):
        self.lo, self.hi, self.h, self.doc = p.lo[passed], p.hi[passed], p.h[passed], p.doc[passed]
        size = self.hi + LENGTH - self.lo
        shard = ((self.h >> np.uint64(32)) % np.uint64(shards)).astype(np.uint32)
        padded = np.append(b.data, np.zeros(self.WIDE, np.uint8))
        # shard and size in front: one sort gives the order by shard and tells equal contexts
        whole = np.zeros((len(size), 5 + self.WIDE), np.uint8)
        whole[:, :4] = shard.astype(">u4").view(np.uint8).reshape(-1, 4)
        whole[:, 4] = size
        if len(size):
            whole[:, 5:] = np.lib.stride_tricks.sliding_window_view(padded, self.WIDE)[self.lo]
            whole[:, 5:][np.arange(self.WIDE) >= size[:, None]] = 0
        _, first, self.number = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.shard, self.size, self.rows = shard[first].astype(np.int64), size[first], whole[first, 5:]
        self.used, at = np.unique(self.shard, return_index=True)
        self.edges = [*at.tolist(), len(first)]

    def runs(self, block: int) -> pa.Table:
        out = [bl.frame(self.size[s:e].astype(np.uint8).tobytes(), bl.squeeze(self.rows[s:e].tobytes())) for s, e in zip(self.edges, self.edges[1:])]
        return pa.table({"shard": pa.array(self.used, pa.int32()), "block": pa.array([block] * len(out), pa.int64()), "run": pa.array(out, pa.binary())})

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """Per distinct context, bit ``j`` set if its window ``j`` occurs in an earlier block."""
        bits = np.zeros(len(self.size), np.uint32)
        for k, s, e in zip(self.used.tolist(), self.edges, self.edges[1:]):
            if k in answers:
                bits[s:e] = np.frombuffer(bl.unsqueeze(answers[k]), "<u4")
        return bits


def _windows(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``n`` windows of each row as byte strings; their row and their number in it."""
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    if not len(row):
        return np.zeros(0, f"S{LENGTH}"), row, j
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(rows, LENGTH, axis=1)[row, j]).view(f"S{LENGTH}").ravel(), row, j


def _ask_levels(t: pa.Table) -> pa.Table:
    """One shard: batches of blocks in order of ids through the family of levels. A context that an
    earlier batch had as a whole needs no look at its windows; a second family knows these."""
    order = np.argsort(t["block"].to_numpy(), kind="stable")
    runs = t["run"].to_pylist()
    family, wholes, out = Family(), Family(), [b""] * len(runs)
    for batch in np.array_split(order, min(BATCHES, len(order))):
        parts = [bl.unframe(runs[i]) for i in batch]
        sizes = [np.frombuffer(p[0], np.uint8) for p in parts]
        rows = np.concatenate([np.frombuffer(bl.unsqueeze(p[1]), np.uint8).reshape(-1, _Contexts.WIDE) for p in parts])
        size = np.concatenate(sizes)
        n = size.astype(np.int64) - LENGTH + 1
        full = ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        member = np.repeat(np.arange(len(parts)), [len(s) for s in sizes])
        key = np.concatenate([size[:, None], rows], axis=1).view(f"S{_Contexts.WIDE + 1}").ravel()
        distinct, first, number = np.unique(key, return_index=True, return_inverse=True)
        known = wholes.seen(distinct)
        wholes.add(distinct[~known])
        fresh = np.flatnonzero(~known)
        fresh = fresh[np.argsort(first[fresh])]  # so that of equal suffixes the earliest block's comes first
        own = first[fresh]
        suffix, row, j = _windows(rows[own], n[own])
        array = np.argsort(suffix, kind="stable")
        s = suffix[array]
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        group, firsts = np.cumsum(new) - 1, s[new]
        seen = family.seen(firsts)
        family.add(firsts[~seen])
        early = member[own][row[array]]
        hit = np.empty(len(row), bool)
        hit[array] = seen[group] | (early > early[new][group])
        bits = full[first].copy()
        if len(own):
            bits[fresh] = np.bitwise_or.reduceat(np.where(hit, np.uint32(1) << j.astype(np.uint32), np.uint32(0)), np.cumsum(n[own]) - n[own])
        answer = np.where(member > member[first][number], full, bits[number]).astype("<u4")
        at = 0
        for i, z in zip(batch.tolist(), sizes):
            out[i] = bl.squeeze(answer[at : at + len(z)].tobytes())
            at += len(z)
    return pa.table({"block": t["block"], "shard": t["shard"], "run": pa.array(out, pa.binary())})


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of stretches, and the number of their stretch."""
    k = np.repeat(np.arange(len(n)), n)
    return lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n), k


def _local(b: bl.Block, starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows also start in a document of the same block with a smaller id."""
    if not len(starts):
        return np.zeros(0, bool)
    e = _loads(b.data)
    h = np.zeros(len(starts), np.uint64)
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        h = bl.mix((h ^ e[starts + at]) * bl.M1)
    order = np.lexsort((rank, h))
    hs, rs = h[order], rank[order]
    new = np.append(True, hs[1:] != hs[:-1])
    out = np.empty(len(starts), bool)
    out[order] = rs > rs[new][np.cumsum(new) - 1]
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, carry=None) -> DataFrame:
    """One row per document: bytes, removed bytes, removed spans (in bytes), SHA-256 of the
    remaining bytes and, ``with_text``, the remaining text; ``carry`` comes along as ``carried``, as it is."""
    carry = F.lit(None).cast("string") if carry is None else carry
    carried = docs.select(carry.alias("carried")).schema
    size = bl.text_bytes(docs, text)
    shards = max(1, size // SHARD_BYTES)
    parts = max(1, min(size // (2 * BLOCK_BYTES), 100_000))
    table = bl.bucketed(bl.make_blocks(docs, doc_id, text, BLOCK_BYTES, ordered_parts=parts, carry=carry), parts, "bytes")

    def probe(b: bl.Block) -> pa.Table:
        p = _Picks(b)
        v = bl.Values(p.h, shards)
        return v.runs(b.block, _several(v, _rank(b.ids)[p.doc]))

    first = written(bl.ask_repeated(bl.each_block(table, probe, bl.RUNS)), "picks")

    def contexts(b: bl.Block, rows: list[dict]) -> tuple[_Contexts, np.ndarray]:
        """The contexts, and which of their stretches have a run that two documents of the block share."""
        p = _Picks(b)
        v = bl.Values(p.h, shards)
        passed = v.answered({r["shard"]: r["run"] for r in rows if r["shard"] >= 0})[v.inverse]
        return _Contexts(b, p, passed, shards), _several(v, _rank(b.ids)[p.doc])[v.inverse][passed]

    def send(b: bl.Block, rows: list[dict]) -> pa.Table:
        return contexts(b, rows)[0].runs(b.block)

    second = bl.each_answered(table, first, send, bl.RUNS).groupBy("shard").applyInArrow(_ask_levels, bl.ANSWERS)
    both = first.unionByName(second.selectExpr("block", "-1 - shard AS shard", "run"))

    def cut(b: bl.Block, rows: list[dict]) -> pa.Table:
        c, shared = contexts(b, rows)
        bits = c.answered({-1 - r["shard"]: r["run"] for r in rows if r["shard"] < 0})[c.number]
        n = c.hi - c.lo + 1
        cover = np.zeros(len(b.data) + 1, np.int32)

        def mark(start: np.ndarray, end: np.ndarray) -> None:
            cover[:] += np.bincount(start, minlength=len(cover)).astype(np.int32) - np.bincount(end, minlength=len(cover)).astype(np.int32)

        whole = bits == ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        mark(c.lo[whole], c.hi[whole] + LENGTH)
        some = ~whole & (bits > 0)
        at, k = _expand(c.lo[some], n[some])
        at = at[(bits[some][k] >> (at - c.lo[some][k]).astype(np.uint32)) & 1 > 0]
        mark(at, at + LENGTH)
        near = ~whole & shared
        at, k = _expand(c.lo[near], n[near])
        at = at[_local(b, at, _rank(b.ids)[c.doc[near]][k])]
        mark(at, at + LENGTH)
        gone = np.cumsum(cover[:-1]) > 0
        out, off = [], b.offsets.tolist()
        for i, (s, e) in enumerate(zip(off, off[1:])):
            g = gone[s:e]
            edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
            kept = b.data[s:e][~g].tobytes()
            doc = int(b.ids[i])
            out.append(
                {
                    "doc_id": None if doc == bl.LAST else doc,
                    "n_bytes": e - s,
                    "n_removed": int(g.sum()),
                    "spans": [{"start": int(x), "length": int(y - x)} for x, y in zip(edge[::2], edge[1::2])],
                    "kept_sha256": hashlib.sha256(kept).hexdigest(),
                    "kept_text": kept.decode(errors="ignore") if with_text else None,
                }
            )
        return pa.Table.from_pylist(out, schema=own).append_column(last, b.carried.cast(last.type))

    result = StructType([*StructType.fromDDL(RESULT).fields, *carried.fields])
    own, last = bl.to_arrow(RESULT), bl.to_arrow(result).field("carried")
    return bl.each_answered(table, both, cut, result)
