"""Exact, near, suffix and substring dedup against brute force, with the edge cases of the docstrings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import exact, minhash, substring, suffix
from tidemark.llm import wordhash as wh

VOCAB = [f"w{i}" for i in range(300)] + ["É", "naïve", "日本", "A", "a"]


def corpus(seed=1, n=120):
    """Copies, near copies, shared passages, short, blank and NULL texts, odd white space."""
    r = random.Random(seed)
    text = lambda k: " ".join(r.choices(VOCAB, k=k))
    passage = [text(60), text(36), text(35), text(34)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "one two")]
    for i in range(6, n):
        k = r.random()
        if k < 0.2 and len(docs) > 8:
            t = r.choice(docs)[1] or ""
        elif k < 0.45 and len(docs) > 8:
            w = (r.choice(docs)[1] or "x").split() or ["x"]
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            t = r.choice([" ", "\x0b"]).join(w)
        elif k < 0.7:
            t = text(r.randint(0, 40)) + "\n" + r.choice(passage) + " " + text(r.randint(0, 90))
        else:
            t = text(r.randint(1, 200))
        docs.append((i, t))
    long = text(5000)
    docs += [(n, long), (n + 1, long.lower() + " tail"), (n + 2, "x" * 3000), (n + 3, "y" + "x" * 2000)]
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


def frame(spark, docs, extra=True):
    d = spark.createDataFrame([(i, t, "en", 7) for i, t in docs], "doc_id long, text string, lang string, n long").repartition(5)
    return d if extra else d.select("doc_id", "text")


def test_exact(spark, docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.decide(frame(spark, docs)).collect()}
    assert got == brute.exact(docs)


def test_exact_rows_that_stay(spark, docs):
    want = {i for i, v in brute.exact(docs).items() if v[2]}
    out = exact.deduplicate(frame(spark, docs))
    assert out.columns == ["doc_id", "text", "lang", "n"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_exact_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a  b"), (None, "q"), (2, "z")], "doc_id long, text string")
    rows = exact.decide(d).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in rows) == [(-1, False), (-1, True), (1, False), (1, True), (2, True)]
    assert exact.deduplicate(d).count() == 3


def test_perfect_hash_knows_its_members_and_no_others():
    r = np.random.default_rng(3)
    keys, other = (np.frombuffer(r.bytes(32 * n), np.uint8).reshape(-1, 32) for n in (5000, 3000))
    p = exact.PerfectHash.of(exact.PerfectHash.build(keys, np.arange(5000)).row(0))
    slot = p.lookup(keys)
    assert sorted(slot) == list(range(5000)) and (p.winners[slot] == np.arange(5000)).all()
    assert (p.lookup(other) == -1).all()
    near = keys.copy()
    near[:, 31] ^= 1
    assert (p.lookup(near) == -1).all()
    assert exact.PerfectHash.build(keys[:0], np.zeros(0, int)).lookup(other[:2]).tolist() == [-1, -1]


def test_near(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components_of(frame(spark, docs)).collect()}
    assert got == brute.near(docs)


def test_near_crowded_buckets_take_the_exact_join(spark, monkeypatch):
    """A family of texts that share 70 to 90 % of their shingles, and no bucket counts as small."""
    r = random.Random(4)
    base = r.choices(VOCAB, k=120)
    docs = []
    for i in range(60):
        w = list(base)
        cut = r.randint(0, 30)
        w[:cut] = r.choices(VOCAB, k=cut)
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "SMALL", 1)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.components_of(frame(spark, docs)).collect()}
    assert got == brute.near(docs)


def test_near_share_and_the_stage_at_80(spark):
    """Four scattered edits in 200 words: 176 of 216 shingles, between 80 and 85 %."""
    r = random.Random(9)
    w = [f"u{i}" for i in range(200)]
    docs = [(1, " ".join(w)), (3, " ".join(r.choices(VOCAB, k=150)))]
    for at in (20, 70, 120, 170):
        w[at] = "edit"
    docs.append((2, " ".join(w)))
    d = frame(spark, docs)
    for share, apart in ((85, [1, 2, 3]), (80, [1, 1, 3])):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.components_of(d, share=share).collect()}
        assert got == brute.near(docs, share=share) and [got[i][1] for i in (1, 2, 3)] == apart
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, d, "").collect()) == [1, 3]
    assert minhash.side_of(85) == 12 and minhash.side_of(80) == 16


def test_near_chain_is_one_component(spark):
    r = random.Random(5)
    w = r.choices(VOCAB, k=200)
    docs = []
    for i in range(12):
        w[10 * i : 10 * i + 4] = r.choices(VOCAB, k=4)
        docs.append((100 - i, " ".join(w)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.components_of(frame(spark, docs)).collect()} == brute.near(docs)


def test_suffix(spark, docs):
    out = suffix.remove_repeats(frame(spark, docs), carry=F.to_json(F.struct("lang", "n")))
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out.collect()}
    assert got == brute.suffix(docs)


def test_suffix_over_many_blocks_and_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 9000)
    monkeypatch.setattr(suffix, "BATCHES", 7)
    out = suffix.remove_repeats(frame(spark, docs, extra=False))
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out.collect()} == brute.suffix(docs)


def test_suffix_levels_stay_few():
    f = suffix.Family()
    r = np.random.default_rng(1)
    every = set()
    for _ in range(37):
        s = np.unique(np.frombuffer(r.integers(65, 70, 50 * 20, np.uint8).tobytes(), "S50"))
        seen = f.seen(s)
        assert seen.tolist() == [x in every for x in s.tolist()]
        f.add(s[~seen])
        every |= set(s.tolist())
        assert len(f.levels) <= 6
    assert sum(map(len, f.levels.values())) == len(every)


def test_substring(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(spark, docs)).collect()}
    assert got == brute.substring(docs)


def test_substring_over_many_blocks_and_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring, "SHARD_BYTES", 9000)
    out = substring.remove_repeats(frame(spark, docs, extra=False))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == brute.substring(docs)


def test_substring_windows_that_agree_in_32_bits_are_not_repeats(spark):
    """Two different windows of 35 words, both on a shared block of 18, whose hashes have the same low half."""
    r = np.random.default_rng(7)
    data = np.frombuffer("".join(VOCAB).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in VOCAB])
    h = wh.hash_words(data, np.append(0, ends[:-1]), ends)
    pick = np.concatenate([np.tile(np.arange(18), (300_000, 1)), r.integers(0, len(VOCAB), (300_000, 17))], axis=1)
    low = wh.rolling(h[pick].ravel(), 35)[::35] & np.uint64(0xFFFFFFFF)
    order = np.argsort(low, kind="stable")
    at = np.flatnonzero(low[order][1:] == low[order][:-1])[0]
    a, b = pick[order[at]], pick[order[at + 1]]
    assert (a != b).any()
    docs = [(i, " ".join(VOCAB[k] for k in x)) for i, x in enumerate((a, b))]
    assert brute.substring(docs)[0][1] == 0
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.remove_repeats(frame(spark, docs)).collect()}
    assert got == brute.substring(docs)


def test_rows_that_share_an_id_and_null_ids(spark):
    t = " ".join(VOCAB[:80])
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (None, t), (2, "x " + t)], "doc_id long, text string")
    out = {(r.doc_id, r.n_removed) for r in suffix.remove_repeats(d).collect()}
    n = len(t.encode())
    assert out == {(1, 0), (None, n), (2, n)} or out == {(1, 0), (None, n), (2, n + 1)}
    assert {r.n_removed for r in substring.remove_repeats(d).collect()} == {80}
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.components_of(d).collect()} == {(1, 1, True), (None, 1, False), (2, 1, False)}


def test_near_null_and_repeated_ids_with_different_texts(spark):
    """A near copy under NULL (or a repeated id) takes no other document with it, whatever the order of rows."""
    r = random.Random(21)
    text = [r.choices(VOCAB, k=200) for _ in range(4)]
    near = lambda w: " ".join([*w[:-1], "changed"])
    t = [" ".join(w) for w in text]
    rows = [(5, t[0]), (None, near(text[0])), (None, t[1]), (None, t[2]), (None, near(text[2])), (7, t[3]), (7, "one two three"), (9, near(text[3]))]
    for given in (rows, rows[::-1]):
        d = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
        out = minhash.components_of(d, with_digest=True).join(d.select("text", minhash.digest("text").alias("tx")), "tx")
        got = {x.text: (x.component_id, x.kept) for x in out.collect()}
        assert got[t[0]] == (5, True) and got[near(text[0])] == (5, False)
        assert got[t[1]] == (None, True)
        assert {got[t[2]], got[near(text[2])]} == {(None, True), (None, False)}
        assert got[t[3]] == (7, True) and got["one two three"] == (7, True) and got[near(text[3])] == (7, False)
        left = [(x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, d, "").collect()]
        assert len(left) == 5 and {(5, t[0]), (None, t[1]), (7, t[3]), (7, "one two three")} < set(left)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    for out in (exact.decide(d), exact.deduplicate(d), minhash.components_of(d), suffix.remove_repeats(d), substring.remove_repeats(d)):
        assert out.count() == 0


def test_words_follow_documents_and_hashes_follow_words():
    texts = ["ab cd", "ef", "", " gh\x0bab", "cdcdcdcdcdcdcdcdcd cd"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, e, doc = wh.find_words(data, off)
    words = [data[a:b].tobytes().decode() for a, b in zip(s, e)]
    assert words == [w for t in texts for w in brute.words(t)] and doc.tolist() == [0, 0, 1, 3, 3, 4, 4]
    h = wh.hash_words(data, s, e)
    assert h[0] == h[4] and h[1] == h[6] and len(set(h.tolist())) == 5
