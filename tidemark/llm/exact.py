"""Exact dedup against a minimal perfect hash over the distinct digests of a history.

The index is a table with one row per shard of the digest space. A shard holds a cascade of
bit arrays (each digest takes the first level on which no other digest shares its bit; the rank
of that bit is its slot, so ``n`` digests use slots ``0 .. n-1``), and per slot the full 32-byte
digest and the winner's id. A lookup answers "member" only if all 32 bytes agree, so a digest
outside the history can never be taken for a member. Nonmembers are grouped on their own.

Work is done on distinct digests: rows are counted map-side first, so a text that makes up a
third of all rows costs one lookup. Shards are sized by ``SHARD_KEYS`` and the shuffle key is a
hash, so no shard grows with a hot text.

Defined results: NULL text counts as empty; a NULL id sorts after all others; rows that repeat
both id and text: one of them is kept; an empty table gives an empty result; extra columns of
the input stay (``deduplicate``) or are left out (``decide``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, private
from tidemark.session import written

#: Distinct digests per shard of the index: 40 bytes each while a task works on it.
SHARD_KEYS = 500_000
LAST = 2**63 - 1

INDEX = "shard int, n long, sizes array<long>, bits array<binary>, slots binary, winners binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """32 bytes; ``F.hex`` of it in lower case is the SHA-256 of the normalised text."""
    return F.unhex(F.sha2(normalised(text), 256))


def shard_of(col: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(shards)).cast("int")


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = np.ascontiguousarray(digests).view("<u8")
    return q[:, 0] ^ q[:, 2], q[:, 1] | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    h = a + b * np.uint64(2 * level + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(11)) % np.uint64(size)


class PerfectHash:
    """Built from distinct digests (``n x 32`` bytes); slots and winners follow the rank order."""

    def __init__(self, sizes, bits, slots, winners):
        self.sizes, self.bits, self.slots, self.winners = sizes, bits, slots, winners

    @classmethod
    def build(cls, digests: np.ndarray, winners: np.ndarray) -> PerfectHash:
        a, b = _halves(digests)
        left, sizes, bits, order = np.arange(len(digests)), [], [], []
        while len(left):
            size = 2 * len(left) + 1
            at = _place(a[left], b[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, bool)
            level[at[alone]] = True
            order.append(left[alone][np.argsort(at[alone])])
            sizes.append(size)
            bits.append(level)
            left = left[~alone]
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        return cls(sizes, bits, digests[order], winners[order])

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest, or -1; decided by the full digest in the slot."""
        a, b = _halves(digests)
        slot, left, base = np.full(len(digests), -1), np.arange(len(digests)), 0
        for level, (size, bits) in enumerate(zip(self.sizes, self.bits)):
            at = _place(a[left], b[left], level, size)
            hit, rank = bits[at], np.cumsum(bits)
            slot[left[hit]] = base + rank[at[hit]] - 1
            base += int(rank[-1])
            left = left[~hit]
        found = np.flatnonzero(slot >= 0)
        same = (self.slots[slot[found]] == digests[found]).all(axis=1)
        slot[found[~same]] = -1
        return slot

    def row(self, shard: int) -> dict:
        packed = [np.packbits(x).tobytes() for x in self.bits]
        return {"shard": shard, "n": len(self.slots), "sizes": self.sizes, "bits": packed, "slots": self.slots.tobytes(), "winners": self.winners.tobytes()}

    @classmethod
    def of(cls, row: dict) -> PerfectHash:
        bits = [np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for x, n in zip(row["bits"], row["sizes"])]
        return cls(row["sizes"], bits, np.frombuffer(row["slots"], np.uint8).reshape(-1, 32), np.frombuffer(row["winners"], np.int64))


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """``history``: distinct ``digest``, ``winner``. One index row per shard that has digests."""

    def build(t: pa.Table) -> pa.Table:
        p = PerfectHash.build(_digests(t["digest"]), t["winner"].to_numpy())
        return pa.Table.from_pylist([p.row(t["shard"][0].as_py())], schema=to_arrow)

    to_arrow = pa.schema(
        [("shard", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.list_(pa.binary())), ("slots", pa.binary()), ("winners", pa.binary())]
    )
    return history.withColumn("shard", shard_of("digest", shards)).groupBy("shard").applyInArrow(build, INDEX)


def probe(index: DataFrame, fresh: DataFrame, shards: int) -> DataFrame:
    """``fresh``: distinct ``digest``. Adds ``winner``: the id in the index, NULL for nonmembers.
    An index row meets the digests of its shard once (co-group), it is never copied per row."""

    def look(ix: pa.Table, t: pa.Table) -> pa.Table:
        winner = np.zeros(t.num_rows, np.int64)
        slot = np.full(t.num_rows, -1)
        if ix.num_rows and t.num_rows:
            p = PerfectHash.of(ix.slice(0, 1).to_pylist()[0])
            slot = p.lookup(_digests(t["digest"]))
            winner[slot >= 0] = p.winners[slot[slot >= 0]]
        return pa.table({"digest": t["digest"].cast(pa.binary()), "winner": pa.array(winner, mask=slot < 0)})

    keyed = fresh.select("digest", shard_of("digest", shards).alias("shard"))
    return index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(look, "digest binary, winner long")


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The history is the lower half of the id range, as if it had arrived first; the upper half
    is looked up in its index, and what is new there is grouped by itself.
    """
    d = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("digest")), "digests")
    half = d.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    cut = LAST if half["a"] is None else (half["a"] + half["b"]) // 2
    old = F.coalesce(F.col("doc_id") <= cut, F.lit(False))
    counted = lambda x: x.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("winner"), F.count("*").alias("n"))
    history, fresh = counted(d.filter(old)), counted(d.filter(~old))
    shards = 1 + d.count() // SHARD_KEYS
    index = written(build_index(history.select("digest", "winner"), shards), "digest-index")
    members = probe(index, fresh, shards)
    groups = written(
        fresh.withColumnRenamed("winner", "own")
        .join(members, "digest")
        .select("digest", F.coalesce("winner", "own").alias("keep_id"), "n")
        .unionByName(history.select("digest", F.col("winner").alias("keep_id"), "n"))
        .groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")),
        "digest-groups",  # a table of its own: the join below can then split a digest that many rows have
    )
    again = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("doc_id"))
    return (
        d.withColumn("_again", again)
        .join(groups, "digest")
        .select(
            "doc_id",
            F.when(F.col("keep_id") < LAST, F.col("keep_id")).alias("keep_id"),
            "group_size",
            ((F.coalesce("doc_id", F.lit(LAST)) == F.col("keep_id")) & (F.col("_again") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are."""
    own, name, of = (private(x, docs) for x in ("_digest", "_id", "_of"))
    stay = written(decide(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias(name), F.unhex("text_sha256").alias(of)), "winners")
    keyed = docs.withColumn(own, digest(F.col(text)))
    kept = keyed.join(stay, F.col(doc_id).cast("long").eqNullSafe(F.col(name)) & (F.col(own) == F.col(of)), "left_semi")
    return kept.dropDuplicates([doc_id, own]).drop(own) if _repeats(docs, doc_id) else kept.drop(own)


def _repeats(docs: DataFrame, doc_id: str) -> bool:
    """Whether some id stands in more than one row (asked of the id column alone)."""
    return bool(docs.groupBy(doc_id).count().filter("count > 1").limit(1).count())
