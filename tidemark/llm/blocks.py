"""Blocks of documents, and the exchange that asks a sharded index about packed values.

Operators that must compare every window of every text with all others would shuffle one row per
window. Here a task packs neighbouring documents into a block of a few MB (one row), sorts the
64-bit hashes of its windows, and sends each shard one packed run of them. The shard answers with
one bit per value; the block unpacks the answer and goes on. A run has at least one value, so the
exchange never has more rows than the plain shuffle it replaces, and about a tenth of its bytes.

* A value that occurs in a third of all rows is sent once per block, not once per row.
* Shards are picked by hash bits; their number follows the bytes of the input, so a shard's
  share stays a few MB.
* Blocks are written once to a table bucketed by block number in the warehouse, so later passes
  over them shuffle only the answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = "block long, ids binary, offsets binary, data binary, carried binary"
RUNS = "shard int, block long, run binary"
ANSWERS = "block long, shard int, run binary"
LAST = 2**63 - 1

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * M2
    h ^= h >> np.uint64(27)
    h *= M3
    h ^= h >> np.uint64(31)
    return h


def squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def unsqueeze(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def pack_ints(sorted_values: np.ndarray) -> bytes:
    """Rising uint32 values: differences, split into byte planes, compressed."""
    d = np.diff(sorted_values.astype(np.int64), prepend=0).astype("<u4")
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(b), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)).astype(np.uint32)


def pack_bits(x: np.ndarray) -> bytes:
    return squeeze(np.packbits(x).tobytes())


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unsqueeze(b), np.uint8))[:n].astype(bool)


def frame(*parts: bytes) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts])


def unframe(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(b, "<i8", n, 8)) + 8 * (n + 1)
    return [b[s:e] for s, e in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


class Block:
    """Decoded block: ids (NULL as LAST), offsets of the documents in ``data`` (bytes)."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.data = np.frombuffer(unsqueeze(row["data"]), np.uint8)
        self._carried = row["carried"]

    @property
    def carried(self) -> pa.Array:
        """What came along with each document."""
        return pa.ipc.open_stream(unsqueeze(self._carried)).read_all().column(0).combine_chunks()


def arrow_bytes(values: pa.Array) -> bytes:
    """Values of any type, without loss."""
    out = pa.BufferOutputStream()
    batch = pa.record_batch([values], names=["carried"])
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return squeeze(out.getvalue().to_pybytes())


def make_blocks(docs: DataFrame, doc_id: str, text: str, most_bytes: int, ordered_parts: int = 0, carry: Column | None = None) -> DataFrame:
    """Pack documents into blocks of about ``most_bytes`` (one document is never split). With
    ``ordered_parts``, documents are first dealt into that many ranges of ids: then blocks have
    disjoint, rising id ranges, rows of one id share a block, and a block's number is its first id.
    ``carry`` goes along with each document, whatever its type (it travels as Arrow data)."""
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.lit("") if carry is None else carry).alias("carry"))
    if ordered_parts:
        d = d.repartitionByRange(ordered_parts, "id").sortWithinPartitions("id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, along, size, n = [], [], [], 0, TaskContext.get().partitionId() << 24

        def row() -> pa.RecordBatch:
            whole = pa.concat_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in along])
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
            number = ids[0] if ordered_parts else n
            out = {"block": [number], "ids": [np.array(ids, "<i8").tobytes()], "offsets": [off.tobytes()], "data": [squeeze(b"".join(texts))], "carried": [arrow_bytes(whole)]}
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            first, carried = 0, batch.column(2)  # rows of this batch from ``first`` on belong to the open block
            for at, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()))):
                if size >= most_bytes and not (ordered_parts and i == ids[-1]):
                    along.append(carried.slice(first, at - first))
                    yield row()
                    ids, texts, along, size, n, first = [], [], [], 0, n + 1, at
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
            along.append(carried.slice(first))
        if ids:
            yield row()

    schema = to_arrow(BLOCK)
    return d.mapInArrow(task, BLOCK)


def bucketed(df: DataFrame, parts: int, name: str) -> DataFrame:
    """``df`` as a table in the warehouse, bucketed by ``block``: passes that group by block read
    it in place. Lost executors cost a re-read."""
    t = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, "block").saveAsTable(t)
    return df.sparkSession.table(t)


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


class Values:
    """Distinct hashes of a block, ready to be sent: ordered by shard, then by the 32 bits sent."""

    def __init__(self, hashes: np.ndarray, shards: int):
        shard = (hashes >> np.uint64(32)) % np.uint64(shards)
        key = (shard << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        self.keys, self.inverse, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        self.shard = (self.keys >> np.uint64(32)).astype(np.int64)
        self.used, first = np.unique(self.shard, return_index=True)
        self.edges = [*first.tolist(), len(self.keys)]

    def packed(self, s: int, e: int) -> bytes:
        """The distinct values ``s`` to ``e`` as they are sent."""
        return pack_ints((self.keys[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    def runs(self, block: int, *flags: np.ndarray) -> pa.Table:
        """One packed run per shard that has values; ``flags`` are bits per distinct value."""
        out = [frame(self.packed(s, e), *(pack_bits(f[s:e]) for f in flags)) for s, e in zip(self.edges, self.edges[1:])]
        return pa.table({"shard": pa.array(self.used, pa.int32()), "block": pa.array([block] * len(out), pa.int64()), "run": pa.array(out, pa.binary())})

    def counted_runs(self, block: int) -> pa.Table:
        """One packed run per shard, with how often each value occurs in the block."""
        sub = (self.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = [frame(pack_ints(sub[s:e]), squeeze(self.counts[s:e].astype("<u4").tobytes())) for s, e in zip(self.edges, self.edges[1:])]
        return pa.table({"shard": pa.array(self.used, pa.int32()), "block": pa.array([block] * len(out), pa.int64()), "run": pa.array(out, pa.binary())})

    def counted(self, answers: dict[int, bytes]) -> np.ndarray:
        """Counts per distinct value from the shards' answers."""
        parts = [np.frombuffer(unsqueeze(answers[k]), "<u4") for k in self.used.tolist()]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """Bits per distinct value from the shards' answers."""
        bits = np.zeros(len(self.keys), bool)
        for k, s, e in zip(self.used.tolist(), self.edges, self.edges[1:]):
            if k in answers:
                bits[s:e] = unpack_bits(answers[k], e - s)
        return bits


class WideValues(Values):
    """Distinct 128-bit hashes of a block (rows of two words), sent whole: where ``Values`` is a filter,
    as different values can look alike to a shard, these can decide."""

    def __init__(self, hashes: np.ndarray, shards: int):
        shard = (hashes[:, 0] >> np.uint64(32)) % np.uint64(shards)
        order = np.lexsort((hashes[:, 1], hashes[:, 0], shard))
        s = hashes[order]
        new = np.append(True, (s[1:] != s[:-1]).any(axis=1)) if len(s) else np.zeros(0, bool)
        self.keys = s[new]
        self.inverse = np.empty(len(s), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.counts = np.diff(np.append(np.flatnonzero(new), len(s)))
        self.shard = shard[order][new].astype(np.int64)
        self.used, first = np.unique(self.shard, return_index=True)
        self.edges = [*first.tolist(), len(self.keys)]

    def packed(self, s: int, e: int) -> bytes:
        return squeeze(self.keys[s:e].astype("<u8").tobytes())


def unpack_wide(b: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(b), "<u8").reshape(-1, 2)


def each_block(blocks: DataFrame, work: Callable[[Block], pa.Table], schema: str | StructType) -> DataFrame:
    """``work`` on each block; rows are small in number (one per block), so they go one by one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = work(Block(batch.slice(i, 1).to_pylist()[0]))
                if out.num_rows:
                    yield from out.combine_chunks().to_batches()

    return blocks.mapInArrow(task, schema)


def each_answered(blocks: DataFrame, answers: DataFrame, work: Callable[[Block, list[dict]], pa.Table], schema: str | StructType) -> DataFrame:
    """``work`` on each block together with its answers (all rounds so far)."""

    def task(b: pa.Table, a: pa.Table) -> pa.Table:
        found = a.to_pylist()
        outs = [work(Block(r), found) for r in b.to_pylist()]
        return pa.concat_tables(outs) if outs else none

    none = pa.Table.from_batches([], schema=to_arrow(schema))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(task, schema)


def to_arrow(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def ask_repeated(runs: DataFrame, wide: bool = False) -> DataFrame:
    """Answer each run: which of its values are repeated (sent by two blocks or more, or flagged
    by flag 0 as repeated inside the block) and, if runs have a flag 1, are flagged so by some block.
    ``wide``: the runs are of ``WideValues``."""

    def task(t: pa.Table) -> pa.Table:
        parts = [unframe(x) for x in t["run"].to_pylist()]
        values = [unpack_wide(p[0]) if wide else unpack_ints(p[0]) for p in parts]
        v = np.concatenate(values)
        flags = [np.concatenate([unpack_bits(p[k], len(x)) for p, x in zip(parts, values)]) for k in range(1, len(parts[0]))]
        order = np.lexsort(v.T) if wide else np.argsort(v, kind="stable")
        s = v[order]
        other = (s[1:] != s[:-1]).any(axis=1) if wide else s[1:] != s[:-1]
        first = np.flatnonzero(np.append(True, other)) if len(s) else np.zeros(0, int)
        size = np.diff(np.append(first, len(s)))
        any_of = lambda f: np.logical_or.reduceat(f[order], first)
        hit = (size > 1) | any_of(flags[0])
        if len(flags) > 1:
            hit &= any_of(flags[1])
        bits = np.empty(len(v), bool)
        bits[order] = np.repeat(hit, size)
        ends = np.cumsum([len(x) for x in values]).tolist()
        out = [pack_bits(bits[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        return pa.table({"block": t["block"], "shard": t["shard"], "run": pa.array(out, pa.binary())})

    return runs.groupBy("shard").applyInArrow(task, ANSWERS)


def ask_counts(runs: DataFrame) -> DataFrame:
    """Runs of values with a count each (uint32 behind the values); answered by the counts summed over
    all blocks, in the run's order."""

    def task(t: pa.Table) -> pa.Table:
        parts = [unframe(x) for x in t["run"].to_pylist()]
        values = [unpack_ints(p[0]) for p in parts]
        counts = np.concatenate([np.frombuffer(unsqueeze(p[1]), "<u4") for p in parts])
        _, inverse = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype("<u4")[inverse]
        ends = np.cumsum([len(x) for x in values]).tolist()
        out = [squeeze(total[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends)]
        return pa.table({"block": t["block"], "shard": t["shard"], "run": pa.array(out, pa.binary())})

    return runs.groupBy("shard").applyInArrow(task, ANSWERS)


def spread(positions: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of ``n`` places covered by ``[p, p + width)``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, positions, 1)
    np.add.at(d, np.minimum(positions + width, n), -1)
    return np.cumsum(d[:-1]) > 0
