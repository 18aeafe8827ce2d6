"""Ids of text pieces, encoded once per worker: natural text repeats its words."""

from __future__ import annotations

from collections.abc import Callable
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of texts without NULLs."""
    a = texts.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


class Known:
    """Pieces met before by this worker and their ids. New pieces of a batch are encoded together by
    ``encode(bytes, offsets, new) -> ids, begin, count``. The store is emptied when it would hold more
    than ``MOST`` pieces, so a worker's memory stays bounded."""

    MOST = 400_000
    _all: ClassVar[dict[str, Known]] = {}

    def __init__(self, encode: Callable):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.pieces = pa.array([], pa.large_string())
        self.pool, self.begin, self.per = (np.zeros(0, np.int64) for _ in range(3))

    @classmethod
    def shared(cls, name: str, encode: Callable) -> Known:
        return cls._all.setdefault(name, cls(encode))

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and how many each has."""
        d = pieces.dictionary_encode()
        wanted, number = d.dictionary, d.indices.to_numpy()
        db, doff = bytes_of(wanted)
        at = pc.fill_null(pc.index_in(wanted, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        new = at < 0
        ids, begin_new, per_new = self.encode(db, doff, new)
        begin, per = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begin[~new], per[~new] = self.begin[at[~new]], self.per[at[~new]]
        begin[new], per[new] = begin_new + len(self.pool), per_new
        pool = np.concatenate([self.pool, ids])
        if len(self.pieces) + len(begin_new) > self.MOST:
            self._empty()
        else:
            self.pieces = pa.concat_arrays([self.pieces, wanted.filter(pa.array(new))])
            self.begin, self.per, self.pool = np.concatenate([self.begin, begin[new]]), np.concatenate([self.per, per_new]), pool
        n = per[number]
        return pool[np.repeat(begin[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n
