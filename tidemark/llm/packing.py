"""Order-preserving packing: dynamic programming over window cuts.

Documents are tokenised (byte-level BPE, then one end id) and laid end to end in input order. A
sequence is a window of at most ``LENGTH`` ids of that stream. Cuts may fall after a document
(free), after a sentence (``SENTENCE`` ids' worth of padding), or on a grid every ``GRID`` ids
(``HARD``). A window shorter than ``LENGTH`` costs its padding, except that a power of two needs
none. The best cuts of a run of ids follow from

    best(i) = penalty(i) + min over j in [i - LENGTH, i) of best(j) + padding(i - j)

where padding is LENGTH - (i - j): so the minimum of ``best(j) + j`` over a sliding window is
needed, which a monotone queue gives in constant time per candidate; windows of 2^k ids are
looked up beside it. Best sums are kept as floats of small integers, so nothing is rounded.

Each task packs the stream of its own input partition, in chunks of at most ``CHUNK`` ids; the
last window of a chunk is carried over to the next one. So memory does not grow with the
partition, and at most one short sequence ends each partition. No shuffle.

Tokenisation: a text is cut before each blank that follows a visible character (the pretokeniser
never joins across such a place), every distinct piece of a batch is encoded once, and the ids
are gathered by number (a worker remembers a bounded number of pieces). Texts that hold a special token's string go through the tokenizer itself.

Defined results: NULL text is empty (its only id is the end id); a NULL id is kept as NULL; repeated
rows are packed each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.known import Known, bytes_of

LENGTH = 2048
END_ID = 1
CHUNK = 1 << 21
SENTENCE, HARD, GRID = 6, 96, 128

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL = "<|"
#: Documents encoded at once.
STEP = 2048


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _library(path: str):
    """The tokenizer and, for whole words, the same vocabulary as ranks."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model["added_tokens"]}
    # byte-level vocabularies spell bytes as printable characters: printable ones stand for themselves, the rest follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = max(max(ranks.values()), *(x["id"] for x in model["added_tokens"])) + 1
    n_bytes, ends = np.zeros(size, np.int64), np.zeros(size, bool)
    for k, v in ranks.items():
        n_bytes[v], ends[v] = len(k), k[-1:] in (b".", b"!", b"?", b"\n")
    return t, fast, n_bytes, ends


def _cuts(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where a text may be cut without changing its ids: before a blank that follows a
    visible character (characters that could be white space in Unicode are left together)."""
    inner = np.flatnonzero(b[1:] == 0x20) + 1
    last, lead = b[inner - 1], b[np.maximum(inner - 2, 0)]
    wide = (last >= 0x80) & ((lead == 0x9A) | (lead == 0x80) | (lead == 0x81) | (lead == 0xC2))
    inner = inner[(last > 0x20) & (last != 0x7F) & ~wide]
    nxt = np.append(b, 0x20)[inner + 1]
    inner = inner[(nxt > 0x20) & (nxt < 0x7F) | (nxt >= 0xC3)]
    cut = np.zeros(len(b) + 1, bool)
    cut[inner] = True
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


def _encode_new(db: np.ndarray, doff: np.ndarray, new: np.ndarray, fast, n_bytes: np.ndarray):
    """Ids of the new pieces, and where each begins among them and how many it has. Pieces that
    start with a blank are encoded as one text: every such blank is a cut there, too."""
    size = np.diff(doff)
    blank = new & (db[np.minimum(doff[:-1], max(0, len(db) - 1))] == 0x20) if len(size) else new
    ids = np.asarray(fast.encode_ordinary(db[np.repeat(blank, size)].tobytes().decode()), np.int64)
    at = np.searchsorted(np.cumsum(size[blank]), np.cumsum(n_bytes[ids]) - n_bytes[ids], side="right")
    per, begin = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    per[blank] = np.bincount(at, minlength=int(blank.sum()))
    begin[blank] = np.cumsum(per[blank]) - per[blank]
    other = new & ~blank
    rest = [np.asarray(fast.encode_ordinary(db[doff[i] : doff[i + 1]].tobytes().decode()), np.int64) for i in np.flatnonzero(other)]
    per[other] = [len(x) for x in rest]
    begin[other] = len(ids) + np.cumsum(per[other]) - per[other]
    return np.concatenate([ids, *rest]), begin[new], per[new]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and ``n + 1`` offsets; the same ids as the tokenizer's."""
    full, fast, n_bytes, _ = _library(path)
    texts = pc.fill_null(texts, "")
    own = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
    odd = [np.asarray(e.ids, np.int64) for e in full.encode_batch([texts[int(i)].as_py() for i in np.flatnonzero(own)], add_special_tokens=False)]
    texts = pc.if_else(pa.array(own), "", texts)
    b, off = bytes_of(texts)
    starts = _cuts(b, off)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(b)).astype(np.int64)), pa.py_buffer(b.tobytes()))
    known = Known.shared(path, lambda db, doff, new: _encode_new(db, doff, new, fast, n_bytes))
    out, n = known.ids_of(pieces)
    doc = np.searchsorted(off, starts, side="right") - 1
    count = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64) if len(starts) else np.zeros(len(texts), np.int64)
    if odd:
        parts = np.split(out, np.cumsum(count)[:-1])
        for i, x in zip(np.flatnonzero(own), odd):
            parts[i], count[i] = x, len(x)
        out = np.concatenate(parts)
    return out, np.concatenate([[0], np.cumsum(count)])


def padding(n: int, length: int = LENGTH) -> int:
    return 0 if n & (n - 1) == 0 else length - n


def best_cuts(at: list[int], penalty: list[float], length: int = LENGTH) -> list[int]:
    """Numbers of the chosen candidates. ``at`` rises from 0, steps are at most ``length``; the
    last candidate is always chosen. The cheapest sum of paddings and penalties, where windows of
    ``length / 8``, ``/ 4`` and ``/ 2`` need no padding (shorter ones are not sought)."""
    place = np.full(at[-1] + 1, -1)
    place[at] = np.arange(len(at))
    exact: dict[int, list[int]] = {}
    for w in (length // 8, length // 4, length // 2):
        there = np.asarray(at)[np.asarray(at) >= w]
        at_w = place[there - w]
        for i, k in zip(place[there[at_w >= 0]].tolist(), at_w[at_w >= 0].tolist()):
            exact.setdefault(i, []).append(k)
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # best + place, place, number: both rise
    for i, (p, fine) in enumerate(zip(at, penalty)):
        if not i:
            continue
        while queue[0][1] < p - length:
            queue.popleft()
        cost, _, j = queue[0]
        cost += length - p
        if i in exact:
            for k in exact[i]:
                if best[k] < cost:
                    j, cost = k, best[k]
        best[i] = cost = cost + fine
        back[i] = j
        cost += p
        while queue and queue[-1][0] >= cost:
            queue.pop()
        queue.append((cost, p, i))
    chosen = [len(at) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts (0 and the end included) and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[::GRID] = HARD
    penalty[np.flatnonzero(ends[ids]) + 1] = SENTENCE
    penalty[doc_ends] = 0
    penalty[[0, n]] = 0
    at = np.flatnonzero(penalty < np.inf)
    return at, penalty[at]


class Packer:
    """Packs a stream of documents; ``add`` returns finished pieces, ``finish`` the rest."""

    def __init__(self, task: int, ends: np.ndarray, length: int = LENGTH):
        self.length, self.ends, self.next = length, ends, task << 36
        self.docs: list[list] = []  # doc_id, tokens in all, ids before what is pending, pending ids
        self.pending = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.docs.append([doc_id, len(ids), 0, ids])
        self.pending += len(ids)
        return self._pack(False) if self.pending >= CHUNK else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.pending else []

    def _pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate([d[3] for d in self.docs])
        doc_ends = np.cumsum([len(d[3]) for d in self.docs])
        at, penalty = candidates(ids, doc_ends, self.ends)
        cuts = at[best_cuts(at.tolist(), penalty.tolist(), self.length)]
        if not last and len(cuts) > 2:
            cuts = cuts[:-1]
        edges = np.union1d(cuts, doc_ends[doc_ends < cuts[-1]])
        raw, out, sequence = ids.astype("<u4"), [], np.searchsorted(cuts, edges[:-1], side="right") - 1
        doc = np.searchsorted(doc_ends, edges[:-1], side="right")
        for s, e, q, k in zip(edges[:-1].tolist(), edges[1:].tolist(), sequence.tolist(), doc.tolist()):
            d = self.docs[k]
            start = d[2] + s - (int(doc_ends[k]) - len(d[3]))
            out.append((d[0], start, e - s, zlib.crc32(raw[s:e].tobytes()), d[1], self.next + q, s - int(cuts[q])))
        self.next += len(cuts) - 1
        done, keep = int(cuts[-1]), []
        for d, end in zip(self.docs, doc_ends.tolist()):
            if end > done:
                cut = max(0, done - (end - len(d[3])))
                keep.append([d[0], d[1], d[2] + cut, d[3][cut:]])
        self.docs, self.pending = keep, len(ids) - done
        return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    ``path`` names the tokenizer's file on every executor."""
    path = path or tokenizer_path()
    names = [x.split()[0] for x in PIECES.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), _library(path)[3], length)
        for batch in batches:
            names_, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(names_), STEP):
                ids, off = encode(texts.slice(lo, STEP), path)
                rows = []
                for i, d in enumerate(names_[lo : lo + STEP]):
                    rows += packer.add(d, np.append(ids[off[i] : off[i + 1]], END_ID))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
        if rows := packer.finish():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, PIECES)
