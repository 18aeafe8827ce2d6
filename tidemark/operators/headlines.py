"""Near-duplicate headlines. Two are alike if they share more than 60 % of the smaller one's
words; in order, a headline is kept unless it is alike to a kept one.

Equal word sets are one entry. A first part of the entries (bounded, in order) is settled by itself; whatever is alike to
a kept one of it goes in one pass over the others, which leaves few of the pairs that short headlines of frequent words make.
Pairs among those left come from an inverted index, rarest words first: a pair with over 60 % in common shares at
least one of the smaller set's ``n - floor(0.6 n)`` rarest words, so frequent words are seldom keys.
An index row carries the words that come after its own, so a pair is judged where it is found and only
pairs that are alike leave that place. The keep-first rule is decided in rounds: who has no
earlier one alike to it is kept, those alike to it go, and pairs of the settled are left out of the
next round; there are as many rounds as the longest chain of such decisions.

Shared words are counted exactly, a block of headlines by a block at a time (``_counts``). Pairs tried still grow with the
square of a word's frequency, at some nanoseconds each. A task holds the rows of one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written

#: Entries of the first part, and words in it at most.
FIRST, FIRST_WORDS = 8192, 1 << 20
#: Columns of a block, words of its rows, and bytes gathered at a time.
WIDE, DEEP, GATHER = 1024, 1 << 16, 1 << 20
#: Index rows that a task looks at together (a word's rows are never parted).
ROWS = 1 << 17


def word_sets(rows: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """``key, words, n``: distinct words of the normalised headline; shorter ones are left out."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    words = F.sort_array(F.array_distinct(F.array_remove(F.split(plain, r"\s+"), "")))
    one = rows.select(key, F.explode(F.array(words)).alias("words"))  # of one element: what follows reads it and does not compute it again
    return one.select(key, "words", F.size("words").alias("n")).where(F.col("n") >= least)


def numbered(sets: DataFrame, key: str) -> DataFrame:
    """``key, n, need, ids``: the words that other sets have too, as numbers that rise with their frequency (as int: up to 2^31 such
    words), and how many of them at least a larger set must share beyond the rarest shared one. Sets without such words are left out."""
    long = sets.select(key, "n", F.explode("words").alias("w"))
    often = long.groupBy("w").agg(F.count("*").alias("often")).where("often > 1")
    order = written(often.orderBy("often", "w").select("w", F.monotonically_increasing_id().alias("m")), "headline-words")
    part = F.shiftright("m", 33).alias("part")
    ends = order.groupBy(part).agg(F.count("*").alias("c"))  # one row per task of the sort
    start = ends.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("start"))
    words = order.select("w", "m", part).join(F.broadcast(start), "part").select("w", (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"))
    sets = long.join(words, "w").groupBy(key, "n").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return sets.select(key, "n", F.floor(F.col("n") * 6 / 10).cast("int").alias("need"), "ids")


def coded(sets: DataFrame, key: str) -> DataFrame:
    """``numbered`` sets with the numbers as a 128-bit map, ``lo, hi``."""
    bits = {c: F.expr(f"aggregate(filter(ids, x -> x % 128 div 64 = {i}), 0L, (a, x) -> a | shiftleft(1L, x % 64))").alias(c) for i, c in enumerate(("lo", "hi"))}
    return written(numbered(sets, key).select("*", *bits.values()), "headline-codes")


def alike(sets: DataFrame, key: str) -> DataFrame:
    """``a, b`` with a < b: pairs of different entries that are alike.

    At the rarest word a pair shares, all others that it shares come after that word in both sets. The map bounds
    from above how many are shared, so the words themselves are compared for few pairs that are not alike."""
    d = coded(sets, key)
    rest = F.expr("slice(ids, i + 2, size(ids))")
    few = d.select("*", F.posexplode(F.slice("ids", 1, F.greatest(F.lit(0), F.size("ids") - F.col("need")))).alias("i", "id"))
    few = few.select("id", F.col(key).alias("s"), F.col("n").alias("sn"), "need", F.size("ids").alias("most"), rest.alias("sr"), F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    every = d.select("*", F.posexplode("ids").alias("i", "id")).where(F.col("i") + 1 < F.size("ids"))  # any pair shares two words
    every = every.select("id", F.col(key).alias("l"), F.col("n").alias("ln"), rest.alias("lr"), F.col("lo").alias("llo"), F.col("hi").alias("lhi"))
    apart = F.bit_count(F.col("slo").bitwiseAND(F.bitwise_not("llo"))) + F.bit_count(F.col("shi").bitwiseAND(F.bitwise_not("lhi")))
    near = few.join(every, (few["id"] == every["id"]) & (F.col("s") != F.col("l")) & (F.col("sn") <= F.col("ln")) & (F.size("lr") >= F.col("need"))
                    & (F.col("most") - apart > F.col("need")) & (F.size(F.array_intersect("sr", "lr")) >= F.col("need")))
    return near.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start to stop, one range after another."""
    size = stop - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an Arrow column of lists without NULLs."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.offsets.to_numpy().astype(np.int64), c.values.to_numpy()


class _Find:
    """Places of words in a sorted array of distinct ones, -1 if absent; by a table while word numbers are small."""

    def __init__(self) -> None:
        self.place = np.empty(0, np.int32)

    def __call__(self, names: np.ndarray, words: np.ndarray) -> np.ndarray:
        most = max(int(names[-1]), int(words.max(initial=0)))
        if most >= 1 << 24:
            at = np.minimum(np.searchsorted(names, words), len(names) - 1)
            return np.where(names[at] == words, at, -1)
        if most >= len(self.place):
            self.place = np.full(2 * most + 1, -1, np.int32)
        self.place[names] = np.arange(len(names), dtype=np.int32)
        at = self.place[words]
        self.place[names] = -1
        return at


def _table(rows: int, place: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """A byte per row (word) and column (headline), 1 where the headline has the word; place -1 is skipped."""
    t, has = np.zeros((rows, -(-width // 8) * 8), np.uint8), place >= 0
    t[place[has], column[has]] = 1
    return t


def _counts(table: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``first, counts``: for slices of the runs (of ``size`` > 0 rows ``at`` of the table each), the sums of their rows. Bytes are
    summed eight at a time, in pieces of 255 rows at most."""
    packed, end = table.view(np.uint64), np.cumsum(size)
    begin, lo, room = end - size, 0, max(1, GATHER // table.shape[1])
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + room, "right")))
        pieces = -(-size[lo:hi] // 255)
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(begin[lo:hi] - begin[lo], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        c = np.add.reduceat(packed.take(at[begin[lo] : end[hi - 1]], axis=0), starts, axis=0).view(np.uint8)
        yield lo, c if len(starts) == hi - lo else np.add.reduceat(c.astype(np.int32), first, axis=0)
        lo = hi


def _reached(counts: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the counts that reach their row's need."""
    need = need.astype(np.uint8) if counts.dtype == np.uint8 and need.max() <= 255 else need
    return np.divmod(np.flatnonzero(counts >= need[:, None]), counts.shape[1])


def _near_in_words(word: np.ndarray, few: np.ndarray, need: np.ndarray, off: np.ndarray, val: np.ndarray, find: _Find) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one word that share at least the first's need of the words ``val[off]`` after it; the first is one of
    the ``few``. Rows are sorted by word, the few of each word before the others."""
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    stop, mid = np.r_[start[1:], len(word)], start + np.add.reduceat(few.astype(np.int64), start)
    use = (mid > start) & (stop - start > 1)
    start, mid, stop = start[use], mid[use], stop[use]
    wide, out = stop - start, []

    def keep(s: np.ndarray, other: np.ndarray) -> None:
        out.append((s[s != other], other[s != other]))

    for lo, hi in ((1, 8), (8, 64)):  # many words side by side
        some = np.flatnonzero((wide > lo) & (wide <= hi))
        words = np.cumsum(off[mid[some]] - off[start[some]])
        for cells in np.split(some, np.flatnonzero(np.diff(words // (4 * DEEP // hi))) + 1) if len(some) else ():
            a, m, z = start[cells], mid[cells], stop[cells]
            number = np.arange(len(cells)) << 32
            row, col = _spans(a, m), _spans(a, z)
            has = np.repeat(number, off[m] - off[a]) + val[_spans(off[a], off[m])]
            names, at = np.unique(has, return_inverse=True)
            other = np.repeat(number, off[z] - off[a]) + val[_spans(off[a], off[z])]
            place = np.minimum(np.searchsorted(names, other), len(names) - 1)
            place[names[place] != other] = -1
            t = _table(len(names), place, np.repeat(col - np.repeat(a, z - a), off[col + 1] - off[col]), hi)
            base = np.repeat(a, m - a)
            for k, c in _counts(t, at, off[row + 1] - off[row]):
                i, j = _reached(c, need[row[k : k + len(c)]])
                keep(row[k + i], base[k + i] + j)
    for top, m, z in zip(*(x[wide > 64].tolist() for x in (start, mid, stop))):
        a = top
        while a < m:  # the few in blocks, each against all rows of the word in blocks
            b = min(m, max(a + 1, int(np.searchsorted(off, off[a] + DEEP, "right")) - 1))
            names, size = np.unique(val[off[a] : off[b]]), off[a + 1 : b + 1] - off[a:b]
            at = find(names, val[off[a] : off[b]])
            for x in range(top, z, WIDE):
                y = min(z, x + WIDE)
                t = _table(len(names), find(names, val[off[x] : off[y]]), np.repeat(np.arange(y - x), off[x + 1 : y + 1] - off[x:y]), y - x)
                for k, c in _counts(t, at, size):
                    i, j = _reached(c, need[a + k : a + k + len(c)])
                    keep(a + k + i, x + j)
            a = b
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def near(sets: DataFrame, key: str) -> DataFrame:
    """``a, b`` with a < b of ``numbered`` sets: the pairs that ``alike`` finds, judged by words in Arrow batches."""
    rest = F.expr("slice(ids, i + 2, size(ids))").alias("rest")  # a pair shares two words, so the last word is no key
    rows = sets.select(key, "need", "ids", F.posexplode("ids").alias("i", "id")).where(F.col("i") + 1 < F.size("ids")).select("id", key, "need", rest)
    rows = rows.withColumn("few", F.size("rest") >= F.col("need"))  # its word is among the n - need rarest
    # a fixed number: work grows faster than bytes, by which partitions would be merged
    rows = rows.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", F.desc("few"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, count, limit = _Find(), [], 0, ROWS

        def judged(t: pa.Table) -> Iterator[pa.RecordBatch]:
            off, val = _lists(t["rest"])
            s, other = _near_in_words(t["id"].to_numpy(), t["few"].to_numpy(), t["need"].to_numpy(), off, val, find)
            yield from pa.table({"s": t[key].take(s), "l": t[key].take(other)}).to_batches()

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= limit:
                t = pa.Table.from_batches(held).combine_chunks()
                word = t["id"].to_numpy()
                done = int(np.searchsorted(word, word[-1]))
                if done:
                    yield from judged(t.slice(0, done))
                held, count = t.slice(done).to_batches(), len(t) - done
                limit = max(ROWS, 2 * count)
        if count:
            yield from judged(pa.Table.from_batches(held).combine_chunks())

    kind = sets.schema[key].dataType.simpleString()
    found = rows.mapInArrow(run, f"s {kind}, l {kind}").where("s != l")
    return found.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()


def struck(sets: DataFrame, key: str, first: pa.Table) -> DataFrame:
    """``key, need, ids, gone`` of ``numbered`` sets: gone are those alike to one of ``first`` (its ``need, ids``; it goes to every task)."""
    need, (off, val) = first["need"].to_numpy(), _lists(first["ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, blocks = _Find(), []
        for x in range(0, len(need), WIDE):
            y = min(len(need), x + WIDE)
            words = val[off[x] : off[y]]
            names = np.unique(words)
            # row 0 stays empty, for the words that the block does not have
            t = _table(len(names) + 1, find(names, words) + 1, np.repeat(np.arange(y - x), off[x + 1 : y + 1] - off[x:y]), y - x)
            blocks.append((names, t, np.pad(need[x:y], (0, t.shape[1] - (y - x)))))
        for b in batches:
            start, words = _lists(b["ids"])
            least, left = b["need"].to_numpy(), np.arange(b.num_rows)
            for names, t, needed in blocks:
                at, alike = find(names, words[_spans(start[left], start[left + 1])]) + 1, np.zeros(len(left), bool)
                for k, c in _counts(t, at, start[left + 1] - start[left]):
                    # shared words are more than 60 % of the smaller set's if they are more than its need
                    alike[k : k + len(c)] = (c > np.minimum(least[left[k : k + len(c)], None], needed)).any(1)
                left = left[~alike]
                if not len(left):
                    break
            gone = np.ones(b.num_rows, bool)
            gone[left] = False
            yield pa.RecordBatch.from_arrays([b[key], b["need"], b["ids"], pa.array(gone)], names=[key, "need", "ids", "gone"])

    # many rows are few bytes, by which tasks would be cut; each task builds its tables anew
    parts = max(1, min(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), sets.count() // FIRST))
    d = sets.select(key, "need", "ids").repartition(parts, key)
    return d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField("gone", T.BooleanType())]))


def settled(edges: DataFrame, key: str) -> DataFrame:
    """``key`` of those that go, of pairs ``a, b`` that are alike, in rounds."""
    edges = written(edges, "headline-pairs")
    gone = edges.select(F.col("a").alias(key)).limit(0)
    while edges.limit(1).count():
        kept = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        hit = written(edges.join(kept, "a", "left_semi").select(F.col("b").alias("_k")).distinct(), "headline-gone")
        gone = gone.unionByName(hit.select(F.col("_k").alias(key)))
        edges = written(edges.join(hit, F.col("a") == F.col("_k"), "left_anti").join(hit, F.col("b") == F.col("_k"), "left_anti"), "headline-pairs")
    return gone


def keep_first(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kept`` of the headlines that have enough words; order is that of ``key``."""
    every = written(word_sets(rows, key, text), "headlines")
    sets = written(every.groupBy("words", "n").agg(F.min(key).alias(key)), "headline-sets")
    top = sets.where(F.col(key).isNotNull()).select(key, "n").orderBy(key).limit(FIRST + 1).collect()
    size = max(1, int(np.searchsorted(np.cumsum([r["n"] for r in top[:FIRST]]), FIRST_WORDS, "right")))
    if size >= len(top):
        gone = settled(alike(sets, key), key)
    else:
        part = F.col(key) <= F.lit(top[size - 1][key])
        gone = settled(alike(sets.where(part), key), key)
        codes = written(numbered(sets, key), "headline-codes")
        kept = codes.where(part).join(gone, key, "left_anti").select("need", "ids").toArrow()
        others = written(struck(codes.where(~part), key, kept), "headline-others")
        gone = gone.unionByName(others.where("gone").select(key)).unionByName(settled(near(others.where("not gone"), key), key))
    firsts = sets.select(key).join(gone, key, "left_anti").select(key, F.lit(True).alias("kept"))
    return every.select(key, "n").join(firsts, key, "left").select(key, F.col("n").cast("long").alias("n_words"), F.coalesce("kept", F.lit(False)).alias("kept"))
