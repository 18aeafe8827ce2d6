"""Byte-level BPE encoding and decoding by longest matches with backtracking.

A text is cut by the vocabulary's pattern; every match is encoded by itself. The merges of byte-pair
encoding are not replayed. A row of tokens is what the merges would leave exactly if each two
neighbours would stay apart, merged from their bytes alone; so a piece is encoded from left to right:

* All tokens that occur in the piece are found in one pass of an Aho-Corasick automaton. It holds
  text, so bytes are written as the 256 characters of Latin-1.
* At each place the longest token that is compatible with the token before is taken. If none is,
  the place is marked dead and the token before is replaced by the next shorter one. A place
  dies at most once, so the work is linear in the piece.
* Whether two tokens may stand side by side follows from undoing their merges towards the common
  edge, the later merge first: a pair that would have merged earlier than one of its sides came to be
  is not compatible. Answers are remembered (at most ``PAIRS`` of them).

Natural text repeats its pieces: a worker remembers the ids of short pieces, at most ``STORE`` bytes
of them. Long texts are cut lazily, so a text needs little besides its ids. Partitions are
independent; there is no shuffle.

Tokens that no merges lead to are only given for pieces that equal them. A rank file without all 256
single bytes, or with a token that merges only from halves of higher rank, is refused. Defined results: NULL and empty texts have no ids and decode to no bytes; bytes
that are not UTF-8 are read as U+FFFD; NULL or repeated ids of documents are kept, each row is encoded by
itself; NULL lists of ids decode to no bytes, an id outside the vocabulary (or NULL) is an error; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDS = "doc_id long, ids array<int>"
DATA = "doc_id long, data binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bounds of what a worker remembers: pairs of tokens, bytes of pieces, characters of one piece.
PAIRS, STORE, SHORT = 1 << 20, 96 << 20, 128
#: Texts of more characters are cut lazily, this many pieces at once.
LONG, AT_ONCE = 1 << 20, 1 << 16
#: A batch of results is given on at this many bytes.
GIVE = 8 << 20


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Tokens with ranks (which are their ids): lower ranks merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.word = {i: t for t, i in ranks.items()}
        self.size = [0] * (max(self.word) + 1)
        for i, t in self.word.items():
            self.size[i] = len(t)
        self.halves: dict[int, tuple[int, int]] = {}  # how a token was merged; a byte is its own half
        self.merged: dict[tuple[int, int], int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        for i in sorted(self.word):
            t = self.word[i]
            if len(t) == 1:
                self.halves[i] = (i, i)
                continue
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut], i), ranks.get(t[cut:], i)
                if a < i and b < i and a in self.halves and b in self.halves and self._apart(a, b):
                    self.halves[i], self.merged[a, b] = (a, b), i
                    break
            else:
                if any(t[:cut] in ranks and t[cut:] in ranks and max(ranks[t[:cut]], ranks[t[cut:]]) > i for cut in range(1, len(t))):
                    raise ValueError(f"token {i} ranks before its halves")
        self._pairs.clear()
        automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.size)
        for i in self.halves:
            t = self.word[i]
            automaton.add_word(t.decode("latin-1"), i)
            for cut in range(len(t) - 1, 0, -1):
                if (p := ranks.get(t[:cut])) in self.halves:
                    self.shorter[i] = p
                    break
        automaton.make_automaton()
        self.automaton = automaton

    def _apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b``, side by side, stay two tokens when their bytes are merged."""
        before = len(self.size)  # only merges of lower rank than this come before what has been undone
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b:  # the left token was made last: undo it, its right half touches the edge
                before, half = a, self.halves[a][1]
                if half == a:
                    return True
                a = half
            else:  # of equal ranks the left one is merged first
                before, half = b + 1, self.halves[b][0]
                if half == b:
                    return True
                b = half

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, n = self.size, self.shorter, len(piece)
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends rise: the last one is the longest
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while at < n:
            while token >= 0 and (dead[at + size[token]] or out and not self.compatible(out[-1], token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out


class Pieces(dict):
    """Ids of pieces, as little-endian 32-bit numbers; bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, 0

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= SHORT:
            cost = 250 + 4 * len(piece) + len(ids)
            if self.held + cost > STORE:
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += cost
        return ids


class Encoding:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = Pieces(self.vocabulary)
        self.pattern = regex.compile(pattern)
        words = [self.vocabulary.word.get(i, b"") for i in range(len(self.vocabulary.size))]
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.array(self.vocabulary.size, np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if len(text) <= LONG:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while some := list(islice(found, AT_ONCE)):
            parts.append(b"".join(map(self.pieces.__getitem__, some)))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.size[ids]
        return self.data[np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}


@cache
def encoding(path: str, pattern: str | None = None) -> Encoding:
    """Read once per worker. ``path`` names the rank file on every executor."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    return Encoding(read_ranks(path), pattern)


def _texts(column: pa.Array) -> Iterator[str]:
    for t in column.cast(pa.binary()):
        yield (t.as_py() or b"").decode("utf-8", "replace")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield flat[s:e]


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids``: one row per document."""
    path = path or ranks_path()

    def batch(names: list, parts: list[bytes]) -> pa.RecordBatch:
        off = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
        ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for b in batches:
            names, parts, size = [], [], 0
            for name, t in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                names.append(name)
                parts.append(own.encode(t))
                size += len(parts[-1])
                if size >= GIVE:
                    yield batch(names, parts)
                    names, parts, size = [], [], 0
            if names:
                yield batch(names, parts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, IDS)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, data``: the bytes that the ids of each row stand for."""
    path = path or ranks_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x) for x in _lists(b.column(1))], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(task, DATA)


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens``, the SHA-256 of the ids (little-endian, 32 bits) and of the bytes decoded from them."""
    path = path or ranks_path()
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for b in batches:
            n, ids, data = [], [], []
            for x in _lists(b.column(1)):
                n.append(len(x))
                ids.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                data.append(hashlib.sha256(own.decode(x)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], names=names)

    return encoded.select("doc_id", "ids").mapInArrow(task, DIGESTS)
