"""Quality by language model: interpolated modified Kneser-Ney over character n-grams.

The model is counted on the whole texts of trusted documents (label ``quality`` 1); one of ``HELD`` of them, by a
checksum of the text, so that copies stay together, is held out of the counts. Every text is read as ``ORDER - 1`` start marks, its characters, and an end mark. With c the count of a gram (at
the highest order) or the number of characters seen before it (below), and three discounts D per
order from the numbers of grams seen once to four times,

    P(w | h) = max(c(hw) - D(c(hw)), 0) / c(h.) + gamma(h) * P(w | h without its first character)

down to the uniform distribution. Tables of grams are Spark tables: counting, continuation counts,
contexts and interpolation are group-bys and joins on the gram. They are then sharded by the gram's
hash; a block of documents sends each shard its distinct grams (packed), and gets log P and log gamma
back: a count join that moves each gram once per block and no text. Perplexity is two to the mean
of -log2 P over the characters and the end mark.

A document is kept if its perplexity is at most the limit of its language: the ``HIGH`` quantile of the
held-out trusted documents there, which the model has not seen, just like the documents it judges. Quantiles are
exact over log2 perplexities rounded to 1/1000. Languages without held-out documents take the
limit over all held-out ones; without any all are kept.

A shard of the model meets runs of all blocks; beyond ``SALT_BLOCKS`` blocks each shard is copied once per as many
blocks, so a task's share stays the same while the corpus grows.

Defined results: NULL and empty texts are scored by their end mark; NULL ids stay NULL (and cannot be
trusted); a NULL language is a language of its own; rows that share an id are scored each; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import blocks as bl
from tidemark.llm import wordhash as wh
from tidemark.session import written

ORDER = 4
BLOCK_BYTES = 4 << 20
#: Grams per shard of the model.
SHARD_GRAMS = 50_000
HIGH, HELD = 0.99, 4
#: Blocks that one copy of a shard answers.
SALT_BLOCKS = 4096
#: No discount is smaller, so that every context leaves something for what it has not seen.
LEAST = 0.05
START, STOP = 2, 3  # control characters that stand for the marks

SCORES = "doc_id long, n_chars long, log2_loss double, held boolean, carried string"


class _Chars:
    """Characters of a block with marks: ``code``; ``doc`` of each; ``real`` marks what is predicted."""

    def __init__(self, b: bl.Block):
        lead = (b.data & 0xC0) != 0x80
        before = np.append(0, np.cumsum(lead))[b.offsets]
        code = np.frombuffer(b.data.tobytes().decode().encode("utf-32-le"), "<u4")
        self.n = np.diff(before)
        size, pad = self.n + ORDER, ORDER - 1
        first = np.cumsum(size) - size
        self.code = np.full(int(size.sum()), START, np.uint32)
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = np.arange(len(self.code)) - first[self.doc]
        self.real = place >= pad
        self.code[self.real & (place < pad + self.n[self.doc])] = code
        self.code[first + size - 1] = STOP

    def grams(self):
        """For each order: the number of the gram that ends at every place, and the hash of each number.
        A gram's number comes from the number of its rest and its first character through a table, so
        no place is sorted. Grams that would begin before the first place have hash 0."""
        alphabet, ids = _numbered(self.code.astype(np.int64), 0x110000)
        number, kinds = ids, len(alphabet)
        for k in range(1, ORDER + 1):
            if k > 1:
                front = np.concatenate([np.full(min(k - 1, len(ids)), len(alphabet)), ids[: len(ids) - k + 1]])
                first, number = _numbered(number.astype(np.int64) * (len(alphabet) + 1) + front, kinds * (len(alphabet) + 1))
                kinds = len(first)
            place = np.zeros(kinds, np.int64)
            place[number] = np.arange(len(number))
            whole = place >= k - 1
            h = np.zeros(kinds, np.uint64)
            h[whole] = gram_hash([self.code[place[whole] - (k - 1) + j] for j in range(k)])
            yield k, number, h, place


def _numbered(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the number of each key among them; ``size`` is above all keys."""
    if size > 1 << 26:
        return np.unique(keys, return_inverse=True)
    there = np.zeros(size, bool)
    there[keys] = True
    number = np.cumsum(there, dtype=np.int32) - 1
    return np.flatnonzero(there), number[keys]


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = wh.join(h, c.astype(np.uint64))
    return h


def _pack(values: np.ndarray) -> bytes:
    """Rising 64-bit values: differences in byte planes, compressed."""
    d = np.diff(values, prepend=np.uint64(0))
    return bl.squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(bl.unsqueeze(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _by_shard(hashes: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Distinct hashes by shard, rising."""
    u = np.unique(hashes)
    s = (u % np.uint64(shards)).astype(np.int64)
    order = np.argsort(s, kind="stable")
    used, at = np.unique(s[order], return_index=True)
    return list(zip(used.tolist(), np.split(u[order], at[1:])))


def held_out(b: bl.Block) -> np.ndarray:
    """Which documents of a block are never counted, should they be trusted."""
    raw, off = b.data.tobytes(), b.offsets.tolist()
    return np.array([zlib.crc32(raw[s:e]) % HELD == 0 for s, e in zip(off, off[1:])], bool)


def _trusted_places(table: DataFrame, trusted: DataFrame) -> DataFrame:
    """``block, place``: which documents of each block are trusted."""

    def places(b: bl.Block) -> pa.Table:
        return pa.table({"id": b.ids, "block": np.full(len(b.ids), b.block), "place": np.arange(len(b.ids))})

    at = bl.each_block(table, places, "id long, block long, place long")
    return at.filter(F.col("id") < bl.LAST).join(trusted.distinct(), "id", "left_semi").select("block", "place")


def count_grams(table: DataFrame, trusted: DataFrame) -> DataFrame:
    """``gram, c``: all grams of the highest order in trusted documents that are not held out, counted per block first."""

    def count(b: pa.Table, t: pa.Table) -> pa.Table:
        grams, counts = [], []
        for row in b.to_pylist():
            b = bl.Block(row)
            x = _Chars(b)
            own = np.zeros(len(x.n), bool)
            own[t["place"].to_numpy()] = True
            own &= ~held_out(b)
            at = np.flatnonzero(x.real & own[x.doc])
            *_, (_, number, h, place) = x.grams()
            n = np.bincount(number[at], minlength=len(h))
            n, place = n[n > 0], place[n > 0]
            rows = np.lib.stride_tricks.sliding_window_view(x.code, ORDER)[place - (ORDER - 1)] if len(n) else np.zeros((0, ORDER), "<u4")
            text = np.ascontiguousarray(rows).astype("<u4").tobytes().decode("utf-32-le")
            grams += [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
            counts.append(n)
        return pa.table({"gram": pa.array(grams, pa.string()), "c": pa.array(np.concatenate(counts) if counts else [], pa.int64())})

    places = _trusted_places(table, trusted)
    return table.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(types: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many grams are seen once to four times (one row to the driver)."""
    n = types.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(k, max(LEAST, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


def model(top: DataFrame) -> tuple[DataFrame, float]:
    """``gram, p, gamma``: log2 P of every gram of every order, and log2 gamma of every gram that is
    a context; and log2 P of a character that was never seen."""
    types = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        types[k] = types[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
    lower, out, floor, unseen = None, None, 0.0, 0.0
    for k in range(1, ORDER + 1):
        t = types[k]
        d1, d2, d3 = discounts(t)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        sums = [F.sum("c").alias("total"), F.sum(cut).alias("cut"), F.count("*").alias("kinds")]
        alpha = lambda: (F.col("c") - cut) / F.col("total")
        if k == 1:
            s = t.agg(*sums).first()
            total, gamma = float(s["total"] or 1), float(s["cut"] or 1) / float(s["total"] or 1)
            floor = 1.0 / ((s["kinds"] or 0) + 1)
            unseen = float(np.log2(gamma * floor)) if gamma > 0 else float(np.log2(floor))
            p = t.select("gram", ((F.col("c") - cut) / F.lit(total) + F.lit(gamma * floor)).alias("p"))
        else:
            context = F.substring("gram", 1, k - 1)
            of = t.groupBy(context.alias("h")).agg(*sums).select("h", "total", (F.col("cut") / F.col("total")).alias("gamma"))
            of = written(of, f"contexts-{k}")
            keyed = t.select("gram", "c", context.alias("h"), F.substring("gram", 2, k - 1).alias("rest")).join(of, "h")
            p = keyed.join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("low")), "rest").select("gram", (alpha() + F.col("gamma") * F.col("low")).alias("p"))
            # the context's weight stands beside the context's own probability; a context of start marks alone has none
            out = lower.join(of.select(F.col("h").alias("gram"), "gamma"), "gram", "full") if out is None else out.unionByName(lower.join(of.select(F.col("h").alias("gram"), "gamma"), "gram", "full"))
        lower = written(p, f"grams-{k}")
    out = lower.withColumn("gamma", F.lit(None).cast("double")) if out is None else out.unionByName(lower.withColumn("gamma", F.lit(None).cast("double")))
    return out.select("gram", F.log2("p").alias("p"), F.log2("gamma").alias("gamma")), unseen


def sharded(grams: DataFrame, shards: int) -> DataFrame:
    """The model keyed by hash: ``shard, h, p, gamma`` (NULL as NaN)."""

    def task(batches):
        for b in batches:
            text = b.column(0).to_pylist()
            size = np.array([len(x) for x in text])
            h = np.zeros(len(text), np.uint64)
            for k in range(1, ORDER + 1):
                own = np.flatnonzero(size == k)
                if len(own):
                    codes = np.frombuffer("".join(text[i] for i in own).encode("utf-32-le"), "<u4").reshape(-1, k)
                    h[own] = gram_hash(list(codes.T))
            values = [b.column(c).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((h % np.uint64(shards)).astype(np.int32)), pa.array(h.view(np.int64)), *map(pa.array, values)], names=["shard", "h", "p", "gamma"]
            )

    return grams.mapInArrow(task, "shard int, h long, p double, gamma double")


def score(table: DataFrame, keyed: DataFrame, shards: int, unseen: float, salts: int = 1) -> DataFrame:
    """``doc_id, n_chars, log2_loss, held, carried`` of every document. ``salts``: copies of each shard."""
    if salts > 1:
        keyed = keyed.withColumn("shard", F.explode(F.sequence(F.col("shard"), F.col("shard") + shards * (salts - 1), F.lit(shards))))

    def send(b: bl.Block) -> pa.Table:
        runs = _by_shard(np.concatenate([h for _, _, h, _ in _Chars(b).grams()]), shards)
        copy = shards * (zlib.crc32(str(b.block).encode()) % salts)
        return pa.table({"shard": pa.array([s + copy for s, _ in runs], pa.int32()), "block": pa.array([b.block] * len(runs), pa.int64()), "run": pa.array([_pack(v) for _, v in runs], pa.binary())})

    def answer(m: pa.Table, t: pa.Table) -> pa.Table:
        h, p, g = m["h"].to_numpy().view(np.uint64), m["p"].to_numpy(), m["gamma"].to_numpy()
        order = np.argsort(h)
        h, p, g = h[order], p[order], g[order]
        out = []
        for run in t["run"].to_pylist():
            v = _unpack(run)
            at = np.minimum(np.searchsorted(h, v), max(0, len(h) - 1))
            hit = h[at] == v if len(h) else np.zeros(len(v), bool)
            both = [np.where(hit, x[at] if len(h) else 0.0, np.nan).astype("<f4") for x in (p, g)]
            out.append(bl.squeeze(np.concatenate(both).tobytes()))
        return pa.table({"block": t["block"].cast(pa.int64()), "shard": t["shard"].cast(pa.int32()), "run": pa.array(out, pa.binary())})

    runs = bl.each_block(table, send, bl.RUNS)
    answers = keyed.groupBy("shard").cogroup(runs.groupBy("shard")).applyInArrow(answer, bl.ANSWERS)

    def finish(b: bl.Block, rows: list[dict]) -> pa.Table:
        x = _Chars(b)
        got = {r["shard"] % shards: np.frombuffer(bl.unsqueeze(r["run"]), "<f4").reshape(2, -1) for r in rows}
        orders = list(x.grams())
        runs = _by_shard(np.concatenate([o[2] for o in orders]), shards)
        h = np.concatenate([v for _, v in runs])
        p, g = (np.concatenate([got[s][k] if s in got else np.full(len(v), np.nan, np.float32) for s, v in runs]).astype(np.float64) for k in (0, 1))
        order = np.argsort(h)
        h, p, g = h[order], p[order], g[order]
        loss = np.full(len(x.code), unseen)
        weight = np.where(np.isnan(g), 0.0, g)
        for k, number, own, _ in orders:
            if k > 1:
                loss[1:] += of_gram[before[:-1]]
            at = np.searchsorted(h, own)
            log_p, of_gram, before = p[at], weight[at], number
            here = log_p[number]
            loss = np.where(np.isnan(here), loss, here)
        total = np.bincount(x.doc[x.real], weights=-loss[x.real], minlength=len(x.n))
        ids = pa.array(b.ids, mask=b.ids == bl.LAST)
        return pa.table({"doc_id": ids, "n_chars": x.n.astype(np.int64), "log2_loss": total, "held": held_out(b), "carried": b.carried})

    return bl.each_answered(table, answers, finish, SCORES)


def quantile(rows: DataFrame, by: str | None, value: str, q: float, name: str) -> DataFrame:
    """Exact lower quantile of whole numbers per group: counted first, so that only distinct values
    meet in a window."""
    keys = [by] if by else []
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys).orderBy(value)
    up_to = counts.select(*keys, value, F.sum("n").over(run).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return up_to.filter(F.col("upto") >= F.ceil(F.col("all") * q)).groupBy(*keys).agg(F.min(value).alias(name))


def limits(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The highest log2 perplexity, in thousandths, that is kept: per language, and over all."""
    t = scored.filter("trusted and held").select("lang", F.lit(0).alias("one"), "milli")
    return quantile(t, "lang", "milli", HIGH, "limit"), quantile(t, "one", "milli", HIGH, "limit")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, lang, n_chars, perplexity, trusted, kept``."""
    size = bl.text_bytes(docs, text)
    parts = max(1, min(size // (2 * BLOCK_BYTES), 100_000))
    table = bl.bucketed(bl.make_blocks(docs, doc_id, text, BLOCK_BYTES, carry=F.col(lang).cast("string")), parts, "chars")
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL")
    top = written(count_grams(table, trusted), "grams")
    grams, unseen = model(top)
    grams = written(grams, "model")
    shards = 1 + grams.count() // SHARD_GRAMS
    plain = score(table, sharded(grams, shards), shards, unseen, 1 + size // (BLOCK_BYTES * SALT_BLOCKS)).select("doc_id", F.col("carried").alias("lang"), "n_chars", "held", (F.col("log2_loss") / (F.col("n_chars") + 1)).alias("rate"))
    known = trusted.distinct().select(F.col("id").alias("doc_id"), F.lit(True).alias("trusted"))
    scored = plain.join(known, "doc_id", "left").withColumns({"trusted": F.coalesce("trusted", F.lit(False)), "milli": F.round(F.col("rate") * 1000).cast("long")})
    scored = written(scored, "scores")
    own, over_all = limits(scored)
    # one row per language that has trusted documents: as many rows as languages, whatever the input's size
    rows = scored.join(F.broadcast(own.select(F.col("lang").alias("_lang"), "limit")), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rows = rows.join(F.broadcast(over_all.select(F.col("limit").alias("_all"))), how="left")
    limit = F.coalesce("limit", "_all", F.lit(float("inf")))
    return rows.select("doc_id", "lang", "n_chars", F.pow(F.lit(2.0), "rate").alias("perplexity"), "trusted", (F.col("milli") <= limit).alias("kept"))
