"""Rules, chat formatting, extraction, tokenising, packing, perplexity and the pipeline."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from check_oracle import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_dedup import corpus, frame
from tidemark.llm import chat, html, packing, perplexity, pieces, queries, rules


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    msg = compare(queries.QUERIES[name](spark, sf).toPandas(), duck(sf).execute(queries.ORACLES[name]).df())
    assert msg is None, msg


# --- quality rules

RULE_TEXTS = [None, "", " \n ", "a " * 19, "b c " * 30, "x " * 7 + "y", "p q r s t u v w " * 2, "# $ % & | < >" * 4, "\n\nline one\nline one\n \nline two\n" * 3,
              "Éa É日本\x0bq " * 12, "one two three four five six seven eight nine " + "ten one two three four five six seven eight", "W" * 5000]


def test_rules(spark):
    d = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(RULE_TEXTS)], "doc_id long, text string, lang string, n_words int")
    for r in rules.apply_rules(d).collect():
        want = brute.rules(RULE_TEXTS[r.doc_id])
        assert {k: r[k] for k in want} == want, RULE_TEXTS[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert rules.apply_rules(d.limit(0)).count() == 0
    assert rules.apply_rules(d.drop("lang")).filter("kept").count() <= len(RULE_TEXTS)


def test_rules_keep_labelled_good_and_reject_labelled_bad(spark):
    sf = "/root/testdata/sf0.01"
    j = queries.op7(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.ok): r["count"] for r in j.groupBy("quality", (F.col("kept") | F.col("base_failed")).alias("ok")).count().collect()}
    assert n.get((1, False), 0) == 0
    rejected = j.filter("quality = 0 and not kept").count()
    assert rejected >= 0.98 * j.filter("quality = 0").count()


def test_rules_use_no_python(spark, sf):
    plan = queries.op7(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- chat

CONV = [(1, 0, "system", "be nice"), (1, 1, "user", "hi <|end|> \\l \\b <"), (1, 2, "assistant", "\\<|assistant|>x"), (1, 3, "user", None), (2, 0, "user", "no reply"),
        (None, None, None, "t"), (None, 1, "assistant", "n"), (3, 0, "assistant", ""), (3, 0, "assistant", "tie"), (3, 1, "a|b|>c<", "odd role"), (4, 5, "assistant", "y" * 3000)]


def test_chat(spark):
    d = spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string").withColumn("target", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.expand(chat.format_conversations(d))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((t if t is not None else -1, ro or "", tx or "") for c, t, ro, tx in CONV if c == conv))
        loss = "".join(tx for _, ro, tx in turns if ro == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == brute.sha("".join(f"{ro}\n{tx}\n" for _, ro, tx in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
    assert chat.digests(chat.expand(chat.format_conversations(d.limit(0)))).count() == 0


def test_every_reply_is_one_example_after_all_turns_before_it(spark):
    d = spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string")
    e = [r for r in chat.expand(chat.format_conversations(d)).orderBy("conv_id", "example").collect() if r.conv_id == 1]
    assert [(r.example, r.trainable, r.is_last) for r in e] == [(2, True, False), (3, False, True)]
    assert e[0].prompt.startswith("<|system|>be nice<|end|><|user|>hi ") and e[0].prompt.endswith("<|assistant|>") and e[1].target == ""
    assert "<" not in e[0].target


def test_chat_uses_no_python(spark, sf):
    plan = queries.op4(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h2>The Site Of All Sites</h2></header><div class="cookie-notice"><p>We use cookies on this site to do many things for you</p></div>
<main><article><h1>Big &amp; News</h1><p>First para<b>graph</b> with   several
words &lt;in&gt; it.<br>Next line<aside>Related: other things to read</aside><div class="advert">Buy this now cheap cheap cheap</div>
<p>Second paragraph goes on here.</p><ul><li>One item<li>Two</ul></article><section id="comments"><p>I like this article said the reader</p></section></main>
<!-- a comment <p>with text</p> --><form><label>Name</label></form><footer>&copy; us &middot; Das ist der Fuß</footer></body>"""


def test_html():
    assert html.main_text(PAGE, {}) == "Big & News First paragraph with several words <in> it. Next line Second paragraph goes on here. One item Two"
    assert html.main_text("<p>&nbsp;a\x85 </p>", {}) == "\xa0a\x85"  # space beyond ASCII is text
    assert html.main_text("", {}) == "" and html.main_text("just <text &amp; more", {}).startswith("just")
    assert html.main_text("<nav><a>x</a></nav>", {}) == ""
    assert html.main_text("<p>" + "word " * 50_000, {}) == ("word " * 50_000).strip()


def test_html_pages_give_their_articles(spark, sf):
    import re
    from html import unescape

    page = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op6(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", page[r.page_id], re.S)[1]
        want = re.sub(r"[\x20\x09-\x0D]+", " ", unescape(re.sub(r"</?(?:h1|p|br|div)[^>]*>", " ", body).replace("<b>", "").replace("</b>", ""))).strip()
        assert (r.text, r.n_chars) == (want, len(want))
    d = spark.createDataFrame([(1, None, None), (None, "u", "<p>a b</p>")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html.extract(d, {}).collect()) == [("", 0), ("a b", 3)]
    assert html.extract(d.limit(0), {}).count() == 0


def test_the_region_decides():
    """A block that looks like content by itself is dropped when what lies between costs more than it brings."""
    article = "<div>" + "<p>" + "good words of the story " * 20 + "</p></div>"
    menu = "<nav>" + "<a>some other page here</a> " * 30 + "</nav>"
    lone = "<div>All rights are reserved</div>"
    page = article + menu + lone
    assert html.main_text(page, {}) == ("good words of the story " * 20).strip()
    runs, scores = html.scored(page, {})
    assert sum(s > 0 for s in scores) == 2 and html.region(scores) != (0, len(scores))
    near = article + "<nav><a>one</a></nav>" + lone  # little lies between: it belongs to the region
    assert html.main_text(near, {}).endswith("All rights are reserved")
    assert html.region([1.0, -2.0, 1.0]) == (0, 1) and html.region([-1.0]) == (0, 0) and html.region([2.0, -1.0, 3.0, -9.0, 4.0]) == (0, 3)


def test_the_weights_decide(spark):
    """Labelled pages teach that a class nobody has heard of holds no content, and that one that sounds like a widget does."""
    r = random.Random(6)
    say = lambda k: " ".join(r.choices("river stone mill house bread water road field".split(), k=k))
    pages, docs = [], []
    for i in range(30):
        text = say(40)
        docs.append((i, text))
        pages.append((i, f"http://x/{i}", f"<div class='q7'>{say(25)}</div><div class='widget-main'><p>{text}</p></div><div class='q7'>{say(12)}</div>"))
    p, d = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string")
    weights = html.fit(p.filter("page_id < 15"), d)
    assert weights["div.q7"] < -1 and weights["div.widget-main"] > 0
    for i, _, page in pages[15:]:
        assert html.main_text(page, weights) == docs[i][1]
        assert html.main_text(page, {}) != docs[i][1]


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<a " * 333_000 + '"', "<p>x" * 200_000, "<a b='" * 160_000, "</x>" * 200_000, "<li><ul>" * 100_000 + "x", "<div class='" + "advert_" * 140_000 + "'>x", "<div>x" * 150_000):
        t = time.time()
        html.main_text(page, {"div.": -0.1})
        sum(1 for _ in html._blocks(page))
        assert time.time() - t < 30, page[:12]  # the quadratic reading took hours


def test_held_out_pages(spark):
    """Token F1 of pages that no weight was fitted on."""
    import re
    from html import unescape

    sf = "/root/testdata/sf0.01"
    pages, docs = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    weights = html.fit(pages.filter("page_id % 2 = 0"), docs)
    both = found = true = 0
    for r in pages.filter("page_id % 2 = 1").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = Counter(unescape(re.sub(r"<[^>]*>", " ", body)).split())
        got = Counter(html.main_text(r.html, weights).split())
        both, found, true = both + sum((want & got).values()), found + sum(got.values()), true + sum(want.values())
    assert 2 * both / (found + true) > 0.99


# --- packing

PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", " ", "　", "\x1c", "\x85", "1", "'s", "!", "<|", "<|endoftext|>", "ü", "中", "\r\n", "\x7f", "ß ", "🙂", " word", ". "]


def test_packing_ids_are_the_tokenizers():
    r = random.Random(2)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 30))) for _ in range(1500)] + [None, "", " ", "word " * 3000]
    path = packing.tokenizer_path()
    full = packing._library(path)[0]
    for lo in range(0, len(texts), 400):
        ids, off = packing.encode(pa.array(texts[lo : lo + 400], pa.string()), path)
        for i, t in enumerate(texts[lo : lo + 400]):
            assert ids[off[i] : off[i + 1]].tolist() == full.encode(t or "", add_special_tokens=False).ids, repr(t)


def check_pieces(rows, docs):
    """Every id in exactly one piece; sequences gapless and within the length; returns the padding."""
    path = packing.tokenizer_path()
    full = packing._library(path)[0]
    ids = {i: full.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    total = pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH
        total, pad = total + at, pad + packing.padding(at)
    return pad / max(1, total)


def test_packing(spark, monkeypatch):
    docs = corpus(7, 400)
    assert check_pieces(packing.pack(frame(spark, docs).coalesce(1)).collect(), docs) < 0.03
    monkeypatch.setattr(packing, "CHUNK", 3000)
    check_pieces(packing.pack(frame(spark, docs)).collect(), docs)
    d = spark.createDataFrame([(None, None), (None, "x")], "doc_id long, text string")
    assert packing.pack(d).count() == 2 and packing.pack(d.limit(0)).count() == 0


def test_best_cuts_are_the_cheapest():
    r = random.Random(3)
    for _ in range(60):
        n, length = r.randint(1, 60), 16
        at = sorted({0, n, *range(0, n, 8), *r.sample(range(n + 1), min(n, 12))})
        penalty = [0 if p in (0, n) else r.choice([0, 2, 5]) for p in at]
        pad = lambda w: 0 if w in (2, 4, 8, 16) else length - w
        best = [0.0] + [math.inf] * (len(at) - 1)
        for i in range(1, len(at)):
            best[i] = penalty[i] + min(best[j] + pad(at[i] - at[j]) for j in range(i) if at[i] - at[j] <= length)
        cuts = packing.best_cuts(at, penalty, length)
        cost = sum(penalty[b] + pad(at[b] - at[a]) for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == len(at) - 1 and cost == best[-1]


# --- pieces


def test_viterbi_finds_the_best_path():
    m = pieces.model(pieces.model_path())
    piece = {m_: i for m_, i in _pieces(m).items()}
    for word in ("▁the", "▁then", "▁a🙂b", "中the", "▁▁▁x", "\n", "▁ünd"):
        b = word.encode()
        best = -math.inf
        starts = [0, *itertools.accumulate(len(c.encode()) for c in word)]
        for cut in itertools.product([0, 1], repeat=len(starts) - 2):
            edges = [0, *(s for s, c in zip(starts[1:-1], cut) if c), len(b)]
            total = 0.0
            for s, e in zip(edges, edges[1:]):
                part = b[s:e]
                total += m.score[piece[part]] if part in piece else m.unknown if len(part.decode()) == 1 else -math.inf
            best = max(best, total)
        got = m.solve_one(b)
        back, at = 0.0, 0
        while at < len(got):
            if m.out_size[got[at]] == 1 and got[at] in set(m.byte.tolist()):
                k = len(_first(bytes(m.out[m.out_at[x]] for x in got[at : at + 4])).encode())
                back, at = back + m.unknown, at + k
            else:
                back, at = back + m.score[got[at]], at + 1
        assert back == pytest.approx(best), word
        rows = np.frombuffer(b.ljust(24, b"\0"), np.uint8).reshape(1, -1)
        assert m.solve(rows, np.array([len(b)]))[0].tolist() == got


def _first(b):
    return next(b[:k].decode() for k in range(1, 5) if _ok(b[:k]))


def _ok(b):
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


def _pieces(m):
    out, todo = {}, [(0, b"")]
    while todo:
        s, p = todo.pop()
        if m.trie.value[s] >= 0:
            out[p] = int(m.trie.value[s])
        if m.trie.base[s]:
            for c in range(256):
                t = m.trie.base[s] + c
                if t < len(m.trie.check) and m.trie.check[t] == s:
                    todo.append((t, p + bytes([c])))
    return out


def test_pieces_round_trip(spark):
    r = random.Random(5)
    texts = ["".join(r.choices([*PARTS, "▁", "\0"], k=r.randint(0, 40))) for _ in range(800)] + [None, "", "x" * 5000, " " * 300, "日本" * 400]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in pieces.decode_documents(pieces.encode_documents(d)).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == (t or "").replace("▁", " "), repr(t)
    assert got[len(texts) - 4].n_ids == 0
    assert pieces.encode_documents(d.limit(0)).count() == 0


# --- perplexity


def kneser_ney(trusted, docs, order=perplexity.ORDER):
    """log2 loss per document, straight from the definition."""
    s, e = chr(perplexity.START), chr(perplexity.STOP)
    padded = lambda t: s * (order - 1) + (t or "") + e
    c = {order: Counter(p[i - order + 1 : i + 1] for p in map(padded, trusted) for i in range(order - 1, len(p)))}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d = {}
    for k in c:
        n = [sum(v == j for v in c[k].values()) for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        d[k] = [0, *(min(j, max(perplexity.LEAST, j - (j + 1) * y * n[j] / n[j - 1])) for j in (1, 2, 3))] if all(n) else [0, 0.5, 1.0, 1.5]
    total, cut = {k: Counter() for k in c}, {k: Counter() for k in c}
    for k in c:
        for g, v in c[k].items():
            total[k][g[:-1]] += v
            cut[k][g[:-1]] += d[k][min(v, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(c[1]) + 1)
        h = g[:-1]
        if h not in total[k]:
            return p(g[1:])
        v = c[k].get(g, 0)
        return (v - d[k][min(v, 3)]) / total[k][h] + cut[k][h] / total[k][h] * p(g[1:])

    return {i: -sum(math.log2(p(x[j - order + 1 : j + 1])) for x in [padded(t)] for j in range(order - 1, len(x))) for i, t in docs}


def test_perplexity(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(perplexity, "SHARD_GRAMS", 700)
    docs = [(i, t) for i, t in corpus(9, 60) if len(t or "") < 2500] + [(900, "ZZZ!!?? 中"), (901, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs if i < 50] + [(None, 1), (5000, 1), (7, 1)], "doc_id long, quality int")
    good = {i for i, _ in docs if i < 50 and i % 3 > 0} | {7}
    want = kneser_ney([t for i, t in docs if i in good and zlib.crc32((t or '').encode()) % perplexity.HELD], docs)
    out = perplexity.classify(frame(spark, docs), labels).collect()
    assert len(out) == len(docs)
    for r in out:
        assert math.log2(r.perplexity) == pytest.approx(want[r.doc_id] / (r.n_chars + 1), rel=1e-4, abs=1e-5)
        assert r.trusted == (r.doc_id in good)


def test_perplexity_without_trust_or_rows(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in perplexity.classify(docs, labels).collect()] == [True, True]
    assert perplexity.classify(docs.limit(0), labels).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    sentence = lambda: " ".join(r.choices("the of and to in that mill river stone was brought from over many old houses by hand".split(), k=12)).capitalize() + "."
    good = [" ".join(f"{sentence()}" for _ in range(8)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(good)] + [(50, good[3]), (51, good[4].replace(" old ", " new ", 1)), (52, None), (53, "too short"), (54, "### $$$ " * 40), (55, good[5] + " " + sentence() + " " + sentence() * 3)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rules.apply_rules(d).filter("kept").collect()}
    left = [(i, t) for i, t in docs if i in kept]
    left = [(i, t) for i, t in left if brute.exact(left)[i][2]]
    near = brute.near(left, share=corpus_pipeline.NEAR)
    left = [(i, t) for i, t in left if near[i][1] == i]
    first = {}
    for i, t in left:
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    cut = []
    for i, t in left:
        b, mask = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                mask[p : p + 50] = b"\1" * 50
        cut.append((i, bytes(x for x, m in zip(b, mask) if not m).decode(errors="ignore")))
    assert {52, 53, 54, 50}.isdisjoint(i for i, _ in cut)
    check_pieces(rows, cut)


def test_stages_on_an_empty_table_and_extra_columns(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, kept boolean, n_words long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns and out.count() == 0
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")


def clashing(spark):
    """Filled rows whose columns have the names that operators use inside, and types that text cannot carry."""
    r = random.Random(4)
    text = lambda k: " ".join(f"the of {r.choice('mill river stone house'.split())} and {r.randint(0, 99)} to" for _ in range(k))
    texts = [text(12) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[1], texts[2] + " more", None, "", "short"])] + [(None, text(14)), (3, text(15))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    k = F.coalesce("doc_id", F.lit(70))
    odd = {"n_words": F.concat(F.lit("w"), k), "kept": k.cast("double") / 3, "_f": k, "_facts": k, "_id": F.concat(F.lit("id"), k), "_digest": F.lit(b"x"), "_of": k, "_row": k, "tx": k, "fp": k, "carried": F.lit("c\nd"), "block": k, "shard": k,
           "component_id": k, "with.dot": k, "at": F.timestamp_micros(k * 1_000_000 + 123456), "ntz": F.timestamp_micros(k * 1_000_007).cast("timestamp_ntz"), "day": F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")),
           "by_number": F.create_map(k.cast("int"), F.lit("v")), "raw": F.unhex(F.lit("00ff80")), "price": k.cast("decimal(20,4)"), "nested": F.array(F.struct(k.alias("a"), F.lit(None).cast("string").alias("b"))), "nothing": F.lit(None).cast("int")}
    return d.withColumns(odd).repartition(3)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s.__name__)
def test_stages_keep_the_columns_they_are_given(spark, stage):
    d = clashing(spark)
    out = stage(spark, d, "")
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in d.schema]
    changed = {"text", "n_chars"} if stage is corpus_pipeline.suffix_dedup else set()
    keep = [c for c in d.columns if c not in changed]
    key = lambda row: str([row[c] for c in keep])
    given, got = Counter(map(key, d.collect())), Counter(map(key, out.collect()))
    assert got and not got - given
    if changed:
        assert got == given
        assert all((r.n_chars or 0) == len(r.text or "") for r in out.collect())
        assert sum(r.text is None for r in out.collect()) == 1


def test_perplexity_limit_is_the_held_out_quantile(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(perplexity, "SALT_BLOCKS", 2)  # several copies of the model
    r = random.Random(8)
    words = {"en": "the river stone was brought from over many old houses".split(), "de": "der alte fluss und die vielen steine im haus".split()}
    docs = [(i, " ".join(r.choices(words[lang], k=r.randint(5, 60))) + ("" if i % 9 else " qx zz##"), lang) for i, lang in enumerate(["en", "de"] * 120)] + [(900, "zq " * 30, "en"), (901, "der alte fluss", None)]
    labels = spark.createDataFrame([(i, int(i % 4 != 1)) for i in range(200)], "doc_id long, quality int")
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    trusted = {i for i in range(200) if i % 4 != 1}
    held = {i for i, t, _ in docs if zlib.crc32(t.encode()) % perplexity.HELD == 0}
    loss = kneser_ney([t for i, t, _ in docs if i in trusted - held], [(i, t) for i, t, _ in docs])
    milli = {i: math.floor(loss[i] / (len(t) + 1) * 1000 + 0.5) for i, t, _ in docs}
    limit = {}
    for lang in ("en", "de", None):
        own = sorted(milli[i] for i, _, x in docs if i in trusted & held and lang in (x, None))
        limit[lang] = own[math.ceil(len(own) * perplexity.HIGH) - 1]
    out = {x.doc_id: x for x in perplexity.classify(d, labels).collect()}
    near = {i for i, _, x in docs if abs(milli[i] - limit[x]) <= 1}  # a rounding apart
    assert {i for i, _, x in docs if milli[i] <= limit[x]} - near == {i for i, x in out.items() if x.kept} - near
    assert not out[900].kept and len(near) < 20
