"""Near-duplicates by MinHash with tensored banding.

Instead of ``T`` independent bands there are two small collections of ``side`` half keys of
``HALF`` minhashes each; a table key is one half key from either collection, so ``side ** 2`` tables
of ``2 * HALF`` minhashes need ``2 * side * HALF`` of them: their number grows with the square root.
Two documents are candidates if some left and some right half key agree. At similarity s a pair is
missed with probability at most 2 * (1 - s ** HALF) ** side; ``side_of`` keeps that under ``MISSED`` at
the similarity asked for: 12 at 85 %, 16 at 80 %.

Steps
1. sketch: one row per document with set size, set fingerprint and half keys; documents with equal
   shingle sets become one class at once (counted map-side, so thousands of copies are one row). Classes
   are numbered in the order of their first document's id and text digest, and the id comes back at the end;
2. table keys of the classes are packed and exchanged; only keys that two classes share go on;
3. each bucket links its members to one centre (its smallest class). Links are confirmed on the full
   shingle sets; confirmed links give components;
4. members of buckets that are still in several components meet further centres, in a few rounds; what
   stays open is worked through: small buckets by the pairs across components, the others by an exact
   join on rare shingles (prefix filter: similar sets share one of their ``n - ceil(s n) + 1`` rarest).
   No candidate is dropped, no bucket is capped;
5. components of all confirmed links; members take their class's component.

Defined results: NULL and blank texts have no shingles and link with nothing; rows that share an id and
a text are one document, each keeps its row; rows that share an id (or have none) and differ in text are
documents of their own, in the order of their texts' digests; a NULL id is kept as NULL and stands
last; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks as bl
from tidemark.llm import wordhash as wh
from tidemark.session import written

SHINGLE = 5
SHARE = 85  # per cent of the union, if a caller gives no other
HALF, MISSED = 3, 3e-5
#: Members of a bucket whose pairs are compared one by one; larger ones take the exact join.
SMALL = 40
#: Rounds in which members that are not linked to their bucket's centre meet other centres.
ROUNDS = 2
SKETCH = "doc_id long, tx binary, n long, fp binary, half_keys binary"
PAIRS = "a long, b long"
BLOCK_BYTES = 4 << 20


def side_of(share: int) -> int:
    """Half keys in a collection."""
    side = 1
    while 2 * (1 - (share / 100) ** HALF) ** side > MISSED:
        side += 1
    return side


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, end to end, and ``n + 1`` offsets."""
    data = wh.lower(np.frombuffer(b"".join(texts), np.uint8))
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, doc = wh.find_words(data, off)
    h = wh.hash_words(data, starts, ends)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    rolled = wh.rolling(h, SHINGLE)
    inside = np.flatnonzero(doc[: len(rolled)] == doc[SHINGLE - 1 :]) if len(rolled) else np.zeros(0, int)
    values, owner = [rolled[inside]], [doc[inside]]
    for n in range(1, SHINGLE):  # shorter texts: the whole sequence
        short = np.flatnonzero(count == n)
        if len(short):
            values.append(wh.rolling(h, n)[first[short]] ^ np.uint64(n))
            owner.append(short)
    v, o = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    new = np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])) if len(v) else np.zeros(0, bool)
    v, o = v[new], o[new]
    return v, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(texts)))]).astype(np.int64)


def half_keys(values: np.ndarray, offsets: np.ndarray, side: int) -> np.ndarray:
    """``documents x (2 * side)`` half keys: the left collection, then the right one."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, 2 * side), np.uint64)
    if not len(some):
        return out
    mult, add = (bl.mix(np.arange(1, side * HALF * 2 + 1, dtype=np.uint64) * k) for k in (bl.M1, bl.M3))
    for k in range(2 * side):
        key = np.full(len(some), k, np.uint64)
        for m in range(k * HALF, (k + 1) * HALF):
            x = values * (mult[m] | np.uint64(1)) + add[m]
            x ^= x >> np.uint64(32)
            x *= bl.M2
            key = wh.join(key, np.minimum.reduceat(x, offsets[:-1][some]))
        out[some, k] = key
    return out


def table_keys(half: np.ndarray) -> np.ndarray:
    """``documents x side ** 2``: every left half key joined with every right one."""
    side = half.shape[1] // 2
    n = np.arange(side * side, dtype=np.uint64)
    return wh.join((half[:, :side, None] + half[:, None, side:] * bl.M2).reshape(len(half), -1), n)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def digest(text: str) -> Column:
    """What tells apart documents that share an id, or have none."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def sketches(docs: DataFrame, doc_id: str, text: str, share: int = SHARE) -> DataFrame:
    schema, side = bl.to_arrow(SKETCH), side_of(share)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                v, off = shingle_sets(_texts(batch, 2))
                half, n = half_keys(v, off, side), np.diff(off)
                some = np.flatnonzero(n)
                fp = np.zeros((len(n), 2), np.uint64)
                if len(some):
                    fp[some, 0] = np.add.reduceat(bl.mix(v ^ bl.M1), off[:-1][some])
                    fp[some, 1] = np.bitwise_xor.reduceat(bl.mix(v + bl.M3), off[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array([x.tobytes() for x in half], pa.binary())],
                    schema=schema,
                )

    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(bl.LAST)), digest(text), F.col(text)).mapInArrow(task, SKETCH)


def shared_keys(classes: DataFrame, shards: int) -> DataFrame:
    """Rows ``key, rep`` for the table keys that two classes or more have."""
    packed = "block long, reps binary, half_keys binary"
    to = bl.to_arrow(packed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                reps = b.column(0).to_numpy()
                row = [[int(reps[0])], [reps.astype("<i8").tobytes()], [b"".join(b.column(1).to_pylist())]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(r, pa.binary()) for r in row[1:])], schema=to)

    # a block is named by its first class, which no other block has
    table = bl.bucketed(classes.select("rep", "half_keys").mapInArrow(pack, packed), max(1, shards // 2), "keys")

    def keys(row: dict) -> tuple[np.ndarray, np.ndarray, bl.Values]:
        reps = np.frombuffer(row["reps"], "<i8")
        k = table_keys(np.frombuffer(row["half_keys"], "<u8").reshape(len(reps), -1))
        return reps, k, bl.Values(k.ravel(), shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                v = keys(row)[2]
                yield from v.runs(row["block"], v.counts > 1).to_batches()

    answers = bl.ask_repeated(table.mapInArrow(send, bl.RUNS))

    def take(b: pa.Table, a: pa.Table) -> pa.Table:
        got, out = {r["shard"]: r["run"] for r in a.to_pylist()}, []
        for row in b.to_pylist():
            reps, k, v = keys(row)
            hit = v.answered(got)[v.inverse]
            out.append(pa.table({"key": k.ravel()[hit].view(np.int64), "rep": np.repeat(reps, k.shape[1])[hit]}))
        return pa.concat_tables(out) if out else pa.table({"key": pa.array([], pa.int64()), "rep": pa.array([], pa.int64())})

    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(take, "key long, rep long")


def confirm(pairs: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough. Sets are made from the texts
    where a pair is compared; a text that stands in neighbouring rows is worked on once."""
    to = bl.to_arrow(PAIRS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                ids = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
                every, first, at = np.unique(ids.ravel(), return_index=True, return_inverse=True)
                both = _texts(batch, 2) + _texts(batch, 3)
                v, off = shingle_sets([both[i] for i in first])
                at = at.reshape(2, -1)
                keep = []
                for x, y in at.T.tolist():
                    m, n = off[x + 1] - off[x], off[y + 1] - off[y]
                    if 100 * min(m, n) < share * max(m, n):
                        keep.append(False)
                        continue
                    s = np.sort(np.concatenate([v[off[x] : off[x + 1]], v[off[y] : off[y + 1]]]), kind="stable")
                    common = int((s[1:] == s[:-1]).sum())
                    keep.append(100 * common >= share * (m + n - common))
                yield pa.RecordBatch.from_arrays([pa.array(c[np.array(keep, bool)]) for c in ids], schema=to)

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(task, PAIRS)


def components(links: DataFrame) -> DataFrame:
    """``rep, comp`` of every class that has a link ``a, b``: the smallest class that it can reach. Every
    round a class takes the smallest label among its neighbours', and then that label's own label, so chains
    shrink by doubling. Each round is a written table (lineage stays short, a lost executor costs one round)."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("low")).select("rep", F.least("rep", "low").alias("comp")), "labels")
    while True:
        low = both.join(label, both["b"] == label["rep"]).groupBy("a").agg(F.min("comp").alias("low"))
        step = label.join(low, F.col("rep") == F.col("a")).select("rep", F.col("comp").alias("was"), F.least("comp", "low").alias("at"))
        further = label.select(F.col("rep").alias("at"), F.col("comp").alias("next"))
        new = written(step.join(further, "at").select("rep", F.least("at", "next").alias("comp"), (F.least("at", "next") < F.col("was")).alias("moved")), "labels")
        label = new.select("rep", "comp")
        if not new.filter("moved").limit(1).count():
            return label


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` with the components joined that ``links`` connect: only these take part."""
    end = lambda c: comp.select(F.col("rep").alias(c), F.col("comp").alias(f"c{c}"))
    pairs = links.join(end("a"), "a").join(end("b"), "b").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    new = components(pairs).select(F.col("rep").alias("comp"), F.col("comp").alias("new"))
    return written(comp.join(new, "comp", "left").select("rep", F.coalesce("new", "comp").alias("comp")), "components")


def rare_pairs(members: DataFrame, texts: DataFrame, comp: DataFrame, share: int) -> DataFrame:
    """Exact candidates among ``members`` (one column, ``rep``): pairs in different components
    that share one of their rarest shingles. Order: how many members have a shingle, then its hash. The
    counts travel packed; only the rarest shingles of a member become rows."""
    docs = written(texts.join(members, "rep", "left_semi").select("rep", "text"), "crowd-texts")
    shards = 1 + bl.text_bytes(docs, "text") // BLOCK_BYTES
    table = bl.bucketed(bl.make_blocks(docs, "rep", "text", BLOCK_BYTES), shards, "crowd")

    def sets(b: bl.Block) -> tuple[np.ndarray, np.ndarray]:
        data, off = b.data.tobytes(), b.offsets.tolist()
        return shingle_sets([data[s:e] for s, e in zip(off, off[1:])])

    def send(b: bl.Block) -> pa.Table:
        return bl.Values(sets(b)[0], shards).counted_runs(b.block)

    def rarest(b: bl.Block, rows: list[dict]) -> pa.Table:
        v, off = sets(b)
        known = bl.Values(v, shards)
        often = known.counted({r["shard"]: r["run"] for r in rows})[known.inverse]
        n = np.diff(off)
        own = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((v, often, own))
        place = np.arange(len(v)) - off[own]
        keep = (place < (n - (n * share + 99) // 100 + 1)[own]) & (often[order] > 1)
        at = order[keep]
        columns = v[at].view(np.int64), b.ids[own[at]], n[own[at]].astype(np.int32), (place[keep] + 1).astype(np.int32)
        return pa.table(dict(zip(("shingle", "rep", "n", "r"), columns)))

    answers = bl.ask_counts(bl.each_block(table, send, bl.RUNS))
    prefix = bl.each_answered(table, answers, rarest, "shingle long, rep long, n int, r int").join(comp, "rep")
    prefix = written(prefix, "prefix")
    other = prefix.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "r", "comp")])
    near = (F.col("comp") != F.col("comp2")) & (F.col("rep") < F.col("rep2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * share)
    # the first shingle that two similar sets share leaves enough behind it for the overlap
    needed = F.ceil((F.col("n") + F.col("n2")) * share / (100 + share))
    near &= F.least(F.col("n") - F.col("r"), F.col("n2") - F.col("r2")) + 1 >= needed
    return prefix.join(other, "shingle").filter(near).select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()


def mixed_keys(k: DataFrame, comp: DataFrame) -> DataFrame:
    """``key, rep, comp, m`` (members) of the buckets whose members are in several components."""
    rows = k.join(comp, "rep")
    keys = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return rows.join(keys.select("key", "m"), "key")


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE, with_digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``. Documents link if they share
    ``share`` per cent of the union of their shingles. ``with_digest`` adds ``tx``, which names a
    document together with its id."""
    d = written(sketches(docs, doc_id, text, share), "sketches")
    some = d.filter("n > 0")
    of = some.groupBy("fp", "n").agg(F.min(F.struct("doc_id", "tx")).alias("head")).select("fp", "n", F.col("head.doc_id").alias("id"), F.col("head.tx").alias("head"))
    # rising over the ranges and inside them: the order of the numbers is that of (id, head)
    of = written(of.repartitionByRange("id", "head").sortWithinPartitions("id", "head").withColumn("rep", F.monotonically_increasing_id()), "class-numbers")
    classes = written(some.join(of, ["fp", "n"]).filter("doc_id = id and tx = head").dropDuplicates(["rep"]).select("rep", "half_keys"), "classes")
    shards = max(1, classes.count() // 10_000)
    k = written(shared_keys(classes, shards), "shared-keys")
    nodes = k.select("rep").distinct()
    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(bl.LAST)).alias("id"), digest(text).alias("head"), F.col(text).alias("text"))
    texts = written(given.join(of.join(nodes, "rep", "left_semi").select("rep", "id", "head"), ["id", "head"]).select("rep", "text").dropDuplicates(["rep"]), "texts")
    centre = k.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("key", "a")
    tried = written(k.join(centre, "key").filter("rep > a").select("a", F.col("rep").alias("b")).distinct(), "tried")
    links = written(confirm(tried, texts, share), "confirmed")
    comp = components(links)
    comp = written(nodes.join(comp, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp")), "components")
    for turn in range(ROUNDS):
        # members in other components than their centre meet further centres, picked by chance
        rest = written(mixed_keys(k, comp), "open")
        if not rest.limit(1).count():
            break
        lot = F.struct(F.xxhash64("rep", F.pmod("key", F.lit(4)), F.lit(turn)).alias("lot"), "rep", "comp")
        centre = rest.groupBy("key").agg(F.min(lot).alias("c")).select("key", F.col("c.rep").alias("c_rep"), F.col("c.comp").alias("c_comp"))
        ends = [f("rep", "c_rep").alias(n) for f, n in ((F.least, "a"), (F.greatest, "b"))]
        pairs = rest.join(centre, "key").filter("comp != c_comp").select(*ends).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = written(confirm(pairs, texts, share), "confirmed")
        tried = tried.union(pairs)
        if more.limit(1).count():
            comp = merged(comp, more)
    rest = written(mixed_keys(k, comp), "open")
    if rest.limit(1).count():
        small = rest.filter(F.col("m") <= SMALL).select("key", "rep", "comp")
        other = small.select("key", F.col("rep").alias("rep2"), F.col("comp").alias("comp2"))
        pairs = small.join(other, "key").filter("rep < rep2 and comp != comp2").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
        crowd = written(rest.filter(F.col("m") > SMALL).select("rep").distinct(), "crowd")
        if crowd.limit(1).count():
            pairs = pairs.union(rare_pairs(crowd, texts, comp, share))
        pairs = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        more = written(confirm(pairs, texts, share), "confirmed")
        if more.limit(1).count():
            comp = merged(comp, more)
    first = of.select(F.col("rep").alias("comp"), F.col("id").alias("c_id"), F.col("head").alias("c_head"))
    moved = comp.filter("comp != rep").join(first, "comp").select("rep", "c_id", "c_head")
    found = of.join(moved, "rep", "left").select("fp", "n", F.coalesce("c_id", "id").alias("c_id"), F.coalesce("c_head", "head").alias("c_head"))
    nulls = lambda c: F.when(F.col(c) < bl.LAST, F.col(c)).alias(c)
    out = d.select("doc_id", "tx", "n", "fp").join(found, ["fp", "n"], "left")
    out = out.select("doc_id", "tx", F.col("n").alias("n_shingles"), F.coalesce("c_id", "doc_id").alias("component_id"), F.coalesce("c_head", "tx").alias("c_head"))
    kept = (F.col("doc_id") == F.col("component_id")) & (F.col("tx") == F.col("c_head"))
    return out.select(nulls("doc_id"), "n_shingles", nulls("component_id"), kept.alias("kept"), *(["tx"] if with_digest else []))
