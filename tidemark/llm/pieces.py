"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The model file gives pieces, scores and kinds; nothing is trained. The trie holds all normal and
user-defined pieces as bytes in two arrays: from state ``s`` byte ``c`` leads to ``base[s] + c`` if
``check`` there says ``s``. A text's best segmentation has the highest sum of log scores; a
character that no single piece covers may be taken as unknown and is written as its byte pieces.

Blanks are written as ``\u2581`` and one is put in front. No piece has a blank after another character, so
the best path splits at every blank that follows one: such chunks are solved once each, all new
chunks of a batch side by side (one step of the trie for all of them at a time).

Among equal sums the path whose last piece starts earliest wins. ``\u2581`` in a text is read as a
blank. Defined results: NULL and empty texts have no ids and decode to the empty text; repeated rows
are encoded each; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.known import Known, bytes_of

BLANK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Chunks of more bytes are solved one by one, not side by side.
WIDE = 128
STEP = 1024
IDS = "doc_id long, ids array<int>"
TEXTS = "doc_id long, n_ids long, ids_crc32 long, text string"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Trie:
    """Double array over byte strings; ``value[state]`` is the id of the piece that ends there, or -1."""

    def __init__(self, pieces: dict[bytes, int]):
        keys = sorted(pieces)
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        used = np.zeros(size, bool)
        self._from = {True: 257, False: 257}  # below this no slot is worth trying, for single edges and for several
        todo = [(0, 0, len(keys), 0)]  # state, first and last key below it, depth
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[lo]) == depth:
                self.value[state] = pieces[keys[lo]]
                lo += 1
            edges = []
            while lo < hi:
                c, start = keys[lo][depth], lo
                while lo < hi and keys[lo][depth] == c:
                    lo += 1
                edges.append((c, start, lo))
            if not edges:
                continue
            codes = np.array([e[0] for e in edges])
            base = self._room(used, codes)
            while base + 512 >= len(used):
                used = np.append(used, np.zeros(len(used), bool))
                self.base, self.check, self.value = (np.append(x, np.full(len(x), fill)) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
            self.base[state] = base
            used[base + codes] = True
            self.check[base + codes] = state
            todo += [(base + c, s, e, depth + 1) for c, s, e in edges]


    def _room(self, used: np.ndarray, codes: np.ndarray) -> int:
        """A base under which all codes are free: any free slot will do for one code; for several,
        the free slots of a window are tried at once."""
        single = len(codes) == 1
        at = self._from[single]
        while True:
            free = at + np.flatnonzero(~used[at : at + (64 if single else 1024)])
            if at + 2048 >= len(used):
                return len(used)  # fresh room; the caller makes the arrays longer
            if len(free):
                base = free - int(codes[0])
                ok = np.flatnonzero(~used[base[:, None] + codes].any(axis=1))
                if len(ok):
                    self._from[single] = int(free[0]) if single or ok[0] < 64 else int(free[ok[0] // 2])
                    return int(base[ok[0]])
            at += 64 if single else 1024
            self._from[single] = at


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = _kinds(path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if kinds[i] == 1]
        score = np.array([sp.get_score(i) for i in range(n)])
        low, high = score[normal].min(), score[normal].max()
        for i in range(n):
            if kinds[i] == 4:
                score[i] = len(text[i].encode()) * high - 0.1
        self.score, self.unknown = score, low - UNKNOWN_PENALTY
        self.unk = next(i for i in range(n) if kinds[i] == 2)
        self.byte = np.full(256, self.unk)
        for i in range(n):
            if kinds[i] == 6:
                self.byte[int(text[i][3:5], 16)] = i
        self.trie = Trie({text[i].encode(): i for i in range(n) if kinds[i] in (1, 4)})
        as_bytes = [bytes([int(t[3:5], 16)]) if k == 6 else b"" if k == 3 else t.replace(BLANK, " ").encode() for t, k in zip(text, kinds)]
        self.out = np.frombuffer(b"".join(as_bytes), np.uint8)
        self.out_size = np.array([len(x) for x in as_bytes])
        self.out_at = np.cumsum(self.out_size) - self.out_size

    def solve(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of chunks side by side (``rows``: bytes, padded; ``size``: real lengths): the
        ids of all, end to end, and how many each has."""
        n, width = rows.shape
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        step = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10)
        for i in range(width):
            row = np.flatnonzero((best[:, i] > -np.inf) & (i < size))
            if not len(row):
                continue
            one = i + step[rows[row, i]]
            alone = np.zeros(n, bool)
            everyone, state, at = row, np.zeros(len(row), np.int64), i
            while True:
                keep = at < size[row]
                row, state = row[keep], state[keep]
                if not len(row):
                    break
                nxt = base[state] + rows[row, at]
                ok = (check[nxt] == state) & (base[state] > 0)
                row, state, at = row[ok], nxt[ok], at + 1
                if not len(row):
                    break
                ends = value[state]
                hit = row[ends >= 0]
                self._better(best, start, piece, hit, i, at, ends[ends >= 0], self.score)
                alone[hit[at == i + step[rows[hit, i]]]] = True
            lost = ~alone[everyone]
            for to in np.unique(one[lost]).tolist():
                hit = everyone[lost & (one == to)]
                self._better(best, start, piece, hit, i, min(to, width), np.full(len(hit), self.unk), None)
        found, row, at = [], np.flatnonzero(size), size[size > 0].copy()
        while len(row):
            p, s = piece[row, at], start[row, at]
            found.append((row, at, s, p))
            row, at = row[s > 0], s[s > 0].astype(np.int64)
        if not found:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        row, at, s, p = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((at, row))
        row, at, s, p = row[order], at[order], s[order], p[order].astype(np.int64)
        many = np.where(p == self.unk, at - s, 1)
        ids, place = np.repeat(p, many), np.repeat(s, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        lost = ids == self.unk
        ids[lost] = self.byte[rows[np.repeat(row, many)[lost], place[lost]]]
        return ids, np.bincount(row, weights=many, minlength=n).astype(np.int64)

    def _better(self, best, start, piece, rows, i, to, ids, score) -> None:
        new = best[rows, i] + (self.unknown if score is None else score[ids])
        up = new > best[rows, to]
        best[rows[up], to], start[rows[up], to], piece[rows[up], to] = new[up], i, ids[up]

    def solve_one(self, b: bytes) -> list[int]:
        """Best path of one chunk of any length."""
        base, check, value, n = self.trie.base, self.trie.check, self.trie.value, len(b)
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            c = b[i]
            one, alone, state = i + (1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4), False, 0
            for at in range(i, n):
                nxt = base[state] + b[at]
                if not base[state] or check[nxt] != state:
                    break
                state = nxt
                if value[state] >= 0:
                    alone |= at + 1 == one
                    if best[i] + self.score[value[state]] > best[at + 1]:
                        best[at + 1], back[at + 1] = best[i] + self.score[value[state]], (i, int(value[state]))
            if not alone and best[i] + self.unknown > best[one]:
                best[one], back[one] = best[i] + self.unknown, (i, self.unk)
        out, at = [], n
        while at:
            s, p = back[at]
            out.append([p] if p != self.unk else [int(self.byte[x]) for x in b[s:at]])
            at = s
        return [x for part in reversed(out) for x in part]

    def encode_new(self, db: np.ndarray, doff: np.ndarray, new: np.ndarray):
        """For ``Known``: new chunks, each written with blanks as ``BLANK``."""
        which = np.flatnonzero(new)
        text = db.tobytes()
        chunks = [text[doff[i] : doff[i + 1]].replace(b" ", BLANK.encode()) for i in which]
        size = np.array([len(c) for c in chunks], np.int64)
        per, parts = np.zeros(len(chunks), np.int64), []
        begin, done = np.zeros(len(chunks), np.int64), 0
        edges = [0, 8, 12, 16, 24, 40, 64, WIDE]
        for lo, hi in zip(edges, edges[1:]):
            own = np.flatnonzero((size > lo) & (size <= hi))
            for some in np.array_split(own, 1 + len(own) // 50_000):
                if not len(some):
                    continue
                rows = np.frombuffer(b"".join(chunks[i].ljust(hi, b"\0") for i in some), np.uint8).reshape(-1, hi)
                ids, per[some] = self.solve(rows, size[some])
                begin[some] = done + np.cumsum(per[some]) - per[some]
                parts.append(ids)
                done += len(ids)
        for i in np.flatnonzero(size > WIDE):
            ids = self.solve_one(chunks[i])
            per[i], begin[i] = len(ids), done
            parts.append(np.array(ids, np.int64))
            done += len(ids)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), begin, per

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and ``n + 1`` offsets."""
        t = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), BLANK, " ")
        some = pc.greater(pc.binary_length(t), 0)
        t = pc.if_else(some, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), t, pa.scalar(" ", pa.large_string())), t)
        b, off = bytes_of(t)
        cut = np.zeros(len(b) + 1, bool)
        if len(b):
            cut[1:-1] = (b[1:] == 0x20) & (b[:-1] != 0x20)
        cut[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(cut)
        edges = np.append(starts, len(b)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(b.tobytes()))
        ids, per = Known.shared(f"pieces {id(self)}", self.encode_new).ids_of(chunks)
        doc = np.searchsorted(off, starts, side="right") - 1
        count = np.bincount(doc, weights=per, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(count)])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of runs of ids. Bytes that are no text become U+FFFD."""
        n = self.out_size[ids]
        data = self.out[np.repeat(self.out_at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[off].tolist()
        texts = [data[s:e] for s, e in zip(ends, ends[1:])]
        return [(x[1:] if x[:1] == b" " else x).decode(errors="replace") for x in texts]


def _kinds(path: str) -> list[int]:
    """Kind of each piece in a model file (1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte)."""

    def fields(b: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            v = shift = 0
            while True:
                x = b[at]
                at += 1
                v |= (x & 127) << shift
                shift += 7
                if x < 128:
                    return v

        while at < len(b):
            key = number()
            wire = key & 7
            if wire == 0:
                yield key >> 3, number()
            else:
                n = number() if wire == 2 else 4 if wire == 5 else 8
                yield key >> 3, b[at : at + n]
                at += n

    with open(path, "rb") as f:
        return [dict(fields(v)).get(3, 1) for k, v in fields(f.read()) if k == 1]


@cache
def model(path: str) -> Model:
    return Model(path)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids``. ``path`` names the model file on every executor; a worker reads it once."""
    path = path or model_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                b = whole.slice(lo, STEP)
                ids, off = model(path).encode(b.column(1))
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(task, IDS)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_ids, ids_crc32`` (of little-endian 32-bit ids) and the decoded ``text``."""
    path = path or model_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                b = whole.slice(lo, STEP)
                ids = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                off = np.concatenate([[0], np.cumsum(n)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(off.tolist(), off[1:].tolist())]
                texts = model(path).decode(ids, off)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(crc, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_ids", "ids_crc32", "text"])

    return encoded.mapInArrow(task, TEXTS)
