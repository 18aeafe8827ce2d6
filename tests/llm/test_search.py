"""Ranked search: against SQL (test_text also), against scoring every document, and with any cut into blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def wanted(docs, items, k=20):
    tf = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    count, words = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = set()
    for item, times in asked.items():
        found = []
        for (doc, _), c, own in zip(docs, tf, n):
            score = 0
            for t, x in times.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += x * w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * own * count // words)))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out |= {(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)}
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, score int"), spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, term string")


def some_text(r, vocabulary, n):
    return " ".join(vocabulary[min(len(vocabulary) - 1, int(r.expovariate(0.08)))] for _ in range(n))


@pytest.mark.parametrize("most", [1, 3000, search.BLOCK])
def test_equals_scoring_every_document(spark, monkeypatch, most):
    r = random.Random(most)
    vocabulary = [f"w{i}" for i in range(120)]
    docs = [(i, some_text(r, vocabulary, r.choice([1, 5, 20, 60]))) for i in range(700)]
    docs += docs[:30] + [(None, "w1 w2 w90"), (None, "W1 w2 w90"), (5000, None), (5001, ""), (5002, "!?"), (5003, "w3 " * 9000)]
    items = [(i, some_text(r, vocabulary, r.choice([1, 3, 12]))) for i in range(25)]
    items += [(None, "w80 w81"), (None, "w1"), (90, None), (91, "unseen"), (92, "w1 " * 50 + "w90"), (93, " ".join(vocabulary)), (94, "w100"), (94, "w101")]
    monkeypatch.setattr(search, "RANGE", 16)
    monkeypatch.setattr(search, "SHORT", 8)
    d, q = frames(spark, docs, items)
    # workers read the module anew, so blocks are built and searched here as well, with small ranges
    block = search.Block(search.index_block([search.LAST if i is None else i for i, _ in docs], [(t or "").encode() for _, t in docs]), sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs))
    df = Counter(t for _, x in docs for t in set(terms(x)))
    n, own = sum(bool(terms(t)) for _, t in docs), block.terms.to_pylist()
    local = set()
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    for item, c in asked.items():
        c = {t: x for t, x in c.items() if t in df}
        best = search.Best(20)
        if c:
            block.search(np.array([own.index(t.encode() + b"\n") for t in c]), np.array([x * search.weight(n, df[t]) for t, x in c.items()], np.int64), best)
        local |= {(item, k, None if i == search.LAST else i, s) for k, (s, i) in enumerate(zip(best.score.tolist(), best.id.tolist()), 1)}
    assert local == wanted(docs, items)
    got = search.search(search.build(d.repartition(3), most_bytes=most), q)
    assert {(x.item_id, x["rank"], x.doc_id, x.score) for x in got.collect()} == wanted(docs, items)


def test_ranges_are_skipped(monkeypatch):
    """Common words alone never bring in what rare words have put out of reach."""
    texts = [b"rare the of"] * 20 + [b"the of and"] * 5000
    block = search.Block(search.index_block(list(range(len(texts))), texts), len(texts), 3 * len(texts))
    at = {t: i for i, t in enumerate(block.terms.to_pylist())}
    read = []
    score = search.Block._score
    monkeypatch.setattr(search.Block, "_score", lambda self, i, r, *a: (read.append(r), score(self, i, r, *a))[1])
    best = search.Best(20)
    block.search(np.array([at[b"rare\n"], at[b"of\n"], at[b"and\n"]]), np.array([6000, 3, 10]), best)
    assert best.id.tolist() == list(range(20)) and set(read) == {0}


def test_batches_ties_and_empty_tables(spark, monkeypatch):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(100 + i, f"other{i}") for i in range(60)]
    items = [(i, "same here") for i in range(7)] + [(9, "words")]
    d, q = frames(spark, docs, items)
    monkeypatch.setattr(search, "TERMS", 3)
    got = search.search_documents(d, q)
    assert {(x.item_id, x["rank"], x.doc_id, x.score) for x in got.collect()} == wanted(docs, items)
    assert {x.doc_id for x in got.collect()} == set(range(1, 21))
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        assert search.search_documents(a, b).count() == 0


def test_terms():
    text = "Ab1-É日 x\x00y ŽZ_k{Q}" + " n"
    assert [t.decode() for part in search.terms_of(text.encode()) for t in part] == terms(text)
    long = " ".join(f"t{i}" for i in range(400_000)).encode()
    assert [t for part in search.terms_of(long) for t in part] == long.split()
