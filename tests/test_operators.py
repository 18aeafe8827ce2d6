"""Operators on small frames with answers computed another way."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse, tails
from tidemark.operators import books, cascade, committee, ranks, regime, timeseries as ts, validate


def frame(spark, seed=0, n=900):
    r = np.random.default_rng(seed)
    g = r.choice(["a", "b", None], size=n, p=[0.7, 0.2, 0.1])
    x = np.where(r.random(n) < 0.3, r.integers(0, 4, n), np.exp(r.normal(0, 4, n)) * r.choice([-1, 1], n))
    pdf = pd.DataFrame({"id": range(n), "g": g, "x": x})
    pdf.loc[::17, "x"] = np.nan
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, g string, x double")
    return pdf, d


def test_percentiles_match_pandas_on_heavy_tails_and_ties(spark):
    pdf, d = frame(spark)
    got = {r["g"]: (r["n"], r["p1"], r["p50"], r["p99"]) for r in ranks.percentiles(d, ["g"], "x", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).collect()}
    for g, s in pdf.groupby("g", dropna=False)["x"]:
        k = None if pd.isna(g) else g
        assert got[k][0] == s.count()
        assert np.allclose(got[k][1:], [s.quantile(q) for q in (0.01, 0.5, 0.99)], rtol=1e-12)


def test_average_ranks_match_pandas(spark):
    pdf, d = frame(spark, 1)
    got = ranks.with_rank(d, ["g"], "x").select("id", "rank").toPandas().set_index("id")["rank"].astype(float)
    want = pdf.set_index("id").groupby("g", dropna=False)["x"].rank()
    assert np.allclose(got.sort_index(), want.sort_index(), equal_nan=True)


def test_zscore_flat_group_is_zero_and_null_stays(spark):
    d = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("a", 0.1), ("a", None)], "g string, x double")
    assert sorted((r["z"] for r in ranks.zscored(d, ["g"], "x", "z").collect()), key=str) == [0.0, 0.0, 0.0, None]


def test_quantile_bins_match_qcut(spark):
    pdf, d = frame(spark, 2)
    p = pdf.dropna(subset=["x"])
    want = pd.qcut(p["x"], 5, labels=False, duplicates="drop")
    got = ranks.quantile_bins(d.where("x is not null"), [], "x", 5, "b").toPandas().set_index("id")["b"]
    assert (got.loc[p["id"]].to_numpy() == want.to_numpy()).all()


def test_spearman_flat_or_short_is_null(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 1.0, 3.0), ("c", 2.0, 2.0), ("c", 3.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in ranks.spearman(d, ["g"], "x", "y").collect()}
    assert got["a"] is None and got["b"] is None and got["c"] == pytest.approx(-1.0)


def days(*ds):
    return [dt.date(2024, 1, x) for x in ds]


def test_asof_both_directions(spark):
    px = spark.createDataFrame([("t", d, float(d.day)) for d in days(3, 5, 9)], "ticker string, date date, close double")
    s = spark.createDataFrame([("t", d) for d in days(2, 3, 4, 9, 10)] + [("u", dt.date(2024, 1, 4))], "ticker string, date date")
    b = {(r["ticker"], r["date"].day): r["c"] for r in ts.asof_backward(s, px, "ticker", "date", {"close": "c"}).collect()}
    f = {(r["ticker"], r["date"].day): r["c"] for r in ts.asof_forward(s, px, "ticker", "date", {"close": "c"}).collect()}
    assert b == {("t", 2): None, ("t", 3): 3, ("t", 4): 3, ("t", 9): 9, ("t", 10): 9, ("u", 4): None}
    assert f == {("t", 2): 3, ("t", 3): 3, ("t", 4): 5, ("t", 9): 9, ("t", 10): None, ("u", 4): None}


def test_no_look_ahead(spark):
    base = [("t", dt.date(2020, 1, 1) + dt.timedelta(i), 100 + math.sin(i) * 5 + i * 0.1) for i in range(320)]
    cut = base[270][1]
    later = [(t, d, c * 3 if d > cut else c) for t, d, c in base]
    schema = "ticker string, date date, close double"
    score = lambda rows: ts.realised_vol(spark.createDataFrame(rows, schema).withColumn("mom", ts.momentum_12_1())).where(F.col("date") <= cut).orderBy("date").collect()
    assert score(base) == score(later)


def test_short_history_has_no_momentum(spark):
    rows = [("t", dt.date(2020, 1, 1) + dt.timedelta(i), 1.0 + i) for i in range(253)]
    d = spark.createDataFrame(rows, "ticker string, date date, close double").select("date", ts.momentum_12_1().alias("m")).orderBy("date").collect()
    assert [r["m"] for r in d[:252]] == [None] * 252 and d[252]["m"] == pytest.approx(232 / 1 - 1)


def test_interp_matches_numpy(spark):
    xs, ys = cascade.SELL_CURVES["w52"]
    v = [float(x) for x in range(0, 101)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").select(cascade.interp(F.col("x"), xs, ys)).collect()]
    assert np.allclose(got, np.interp(v, xs, ys))


def test_parse_null_dialects(spark):
    d = spark.createDataFrame([("94%",), ("--",), ("nan",), ("",), (None,), ("-3.5%",)], "c string")
    assert [r[0] for r in d.select(parse.percent("c")).collect()] == [94.0, None, None, None, None, -3.5]
    assert [r[0] for r in d.select(parse.percent("c", zero=True)).collect()] == [94.0, 0.0, 0.0, 0.0, 0.0, -3.5]
    c = spark.createDataFrame([("2.47T",), ("628B",), ("4M",), ("--",)], "c string")
    assert [r[0] for r in c.select(parse.market_cap("c")).collect()] == [2.47e12, 628e9, 4e6, 0.0]


def test_tails(spark):
    def t_tail(t, v):
        x = np.linspace(t, t + 400, 2_000_001)
        y = (1 + x * x / v) ** (-(v + 1) / 2)
        c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        return 2 * c * float(np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0]))

    cases = [(2.0, 10), (1.0, 30), (0.3, 5), (3.5, 200)]
    got = [r[0] for r in spark.createDataFrame([(t, n) for t, n in cases], "t double, n long").select(tails.t_two_sided(F.col("t"), F.col("n"))).collect()]
    assert np.allclose(got, [t_tail(*c) for c in cases], atol=2e-6)
    b = spark.createDataFrame([(7, 10), (60, 100), (0, 5)], "k long, n long").select(tails.binom_upper_half(F.col("k"), F.col("n"))).collect()
    want = [sum(math.comb(n, i) for i in range(k, n + 1)) / 2 ** n for k, n in ((7, 10), (60, 100), (0, 5))]
    assert np.allclose([r[0] for r in b], want, rtol=1e-9)
    from statistics import NormalDist
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.9999]
    z = spark.createDataFrame([(x,) for x in p], "p double").select(tails.norm_inv(F.col("p")).alias("z"))
    assert np.allclose([r[0] for r in z.collect()], [NormalDist().inv_cdf(x) for x in p], atol=1e-7)
    assert np.allclose([r[0] for r in z.select(tails.norm_cdf(F.col("z"))).collect()], p, atol=1e-8)


def test_two_forms_of_false_discovery_control(spark):
    p = {"a": 0.001, "b": 0.03, "c": 0.02, "d": 0.04, "e": 0.9}
    d = spark.createDataFrame(list(p.items()), "t string, p double")
    up = {r["t"] for r in validate.benjamini_hochberg(d, "p", 0.05).where("significant").collect()}
    stop = {r["t"] for r in validate.benjamini_hochberg(d, "p", 0.05, stop_at_first=True).where("significant").collect()}
    s = sorted(p.items(), key=lambda kv: kv[1])
    k = max((i for i, (_, v) in enumerate(s, 1) if v <= 0.05 * i / 5), default=0)
    first = list(itertools.takewhile(lambda iv: iv[1][1] <= 0.05 * iv[0] / 5, enumerate(s, 1)))
    assert up == {n for n, _ in s[:k]} and stop == {n for _, (n, _) in first}


def test_ols_two_regressors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 2))
    y = 0.5 + x @ [1.5, -2.0] + r.normal(size=80)
    d = spark.createDataFrame([("g", *map(float, a), float(b)) for a, b in zip(x, y)], "g string, x1 double, x2 double, y double")
    row = validate.ols(d, ["g"], "y", ["x1", "x2"]).collect()[0]
    m = np.column_stack([np.ones(80), x])
    coef, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    se = np.sqrt(rss[0] / 77 * np.diag(np.linalg.inv(m.T @ m)))
    assert np.allclose(row["coef"], coef) and np.allclose(row["se"], se)


def test_pbo_matches_brute_force(spark):
    m = np.random.default_rng(4).normal(size=(23, 5))
    d = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(23) for j in range(5)], "p int, c int, v double")
    got = {r["split"]: (r["best"], round(r["omega"], 9)) for r in validate.pbo(d, "p", "c", "v", 4).collect()}
    groups = np.array_split(np.arange(23), 4)
    for k, c in enumerate(itertools.combinations(range(4), 2)):
        ins = np.concatenate([groups[g] for g in c])
        oos = np.concatenate([groups[g] for g in range(4) if g not in c])
        best = int(np.argmax(m[ins].mean(axis=0)))
        rank = int(np.argsort(np.argsort(m[oos].mean(axis=0)))[best])
        assert got[k] == (best, round((rank + 1) / 6, 9))


def test_bootstrap_is_repeatable_and_covers(spark):
    r = np.random.default_rng(5)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(r.normal(2.0, 1.0, 4000))], "id long, x double")
    a = validate.bootstrap_ci(d, [], "id", "x", n_boot=200).collect()[0]
    b = validate.bootstrap_ci(d.repartition(7), [], "id", "x", n_boot=200).collect()[0]
    m = d.agg(F.avg("x")).collect()[0][0]
    assert a["ci_lo"] == pytest.approx(b["ci_lo"]) and a["ci_lo"] < m < a["ci_hi"]
    assert a["ci_hi"] - a["ci_lo"] == pytest.approx(2 * 1.645 / math.sqrt(4000), rel=0.25)


def test_book_risk_does_not_depend_on_names_outside_the_book(spark):
    r = np.random.default_rng(6)
    m = r.normal(size=(40, 1)) * r.uniform(0, 1, 8) + r.normal(size=(40, 8))
    day = [dt.date(2020, 1, 1) + dt.timedelta(31 * i) for i in range(40)]
    rows = [(j, day[i], float(m[i, j])) for i in range(40) for j in range(8)]
    others = [(100 + j, day[i], float(j)) for j in range(8) for i in range(j, 40, 7)]  # with many gaps
    names = spark.createDataFrame([(day[-1], j) for j in range(8)] + [(day[9], j) for j in range(3)], "book date, ticker long")
    for table in (rows, rows + others):
        d = spark.createDataFrame(table, "ticker long, month date, ret double")
        h = books.book_history(names, d, "book")
        assert {(x["book"], x["n_dates"], x["n_names"]) for x in h.collect()} == {(day[-1], 40, 8)}  # the early book has 10 dates: too few
        c = np.corrcoef(m, rowvar=False)
        got = {(e["a"], e["b"]): e["corr"] for e in books.correlation_edges(h, "book", 0.2).collect()}
        want = {(i, j): c[i, j] for i in range(8) for j in range(i + 1, 8) if abs(c[i, j]) >= 0.2}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        assert books.effective_positions(h, "book").collect()[0]["effective"] == pytest.approx(64 / c.sum())


def test_clusters_gather_linked_names_in_order(spark):
    day = dt.date(2024, 1, 1)
    links = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (4, 5), (6, 7), (8, 9), (8, 10), (9, 10), (3, 11)]
    d = spark.createDataFrame([(day, a, b, 0.5) for a, b in links], "book date, a long, b long, corr double")
    got = [(r["cluster"], r["members"], r["size"]) for r in books.greedy_clusters(d, "book").orderBy("cluster").collect()]
    assert got == [(0, [1, 2, 3, 4], 4), (1, [8, 9, 10], 3)]


def test_risk_parity_equalises_risk_and_respects_cap():
    a = np.random.default_rng(7).normal(size=(60, 5))
    s = np.cov(a, rowvar=False)
    w, done = books._erc(s)
    assert done
    share = w * (s @ w)
    assert np.allclose(share, share.mean(), rtol=1e-6) and w.sum() == pytest.approx(1)
    c = books._spread(np.array([0.5, 0.3, 0.1, 0.1]), 0.35)
    assert c.max() <= 0.35 + 1e-9 and c.sum() == pytest.approx(1)


def test_regime_confirmation_needs_a_run(spark):
    labels = ["neutral", "risk_off", "neutral", "crisis", "crisis", "neutral"]
    d = spark.createDataFrame([(dt.date(2024, 1, i + 1), x) for i, x in enumerate(labels)], "date date, regime string")
    assert [r["confirmed"] for r in regime.confirmed(d, 2).orderBy("date").collect()] == ["neutral", "neutral", "neutral", "neutral", "crisis", "crisis"]


def test_actions_and_audit(spark):
    d = spark.createDataFrame([(66.0, False, True), (66.0, True, False), (70.0, True, True), (40.0, True, True), (30.0, True, True), (10.0, True, True), (10.0, False, True)], "c double, h boolean, u boolean")
    assert [r[0] for r in d.select(committee.action(F.col("c"), F.col("h"), F.col("u"))).collect()] == ["BUY", "SELL", "ADD", "HOLD", "TRIM", "SELL", "NONE"]
    a = spark.createDataFrame([(-9.0, 30), (9.0, 30), (0.0, 30), (-9.0, 3), (None, 30)], "r double, n int")
    assert [r[0] for r in a.select(committee.audit_class(F.col("r"), F.col("n"))).collect()] == ["TRUE_POSITIVE", "FALSE_POSITIVE", "INCONCLUSIVE", "UNVERIFIED", "UNVERIFIED"]


def test_headlines_keep_the_first_of_each_chain(spark):
    from tidemark.operators import headlines

    text = {1: "alpha beta gamma delta epsilon", 2: "Alpha, beta gamma delta!", 3: "gamma delta epsilon zeta eta", 4: "two words", 5: "zeta eta theta iota kappa", 6: "zeta eta theta iota lambda",
            7: None, 8: "alpha beta gamma delta epsilon", 9: "eta theta iota kappa zeta mu nu xi omicron pi"}
    d = spark.createDataFrame(list(text.items()), "k long, t string")
    kept, sets = [], {k: set(t.lower().replace(",", "").replace("!", "").split()) for k, t in text.items() if t}
    for k, w in sorted(sets.items()):
        if len(w) >= 3 and all(len(w & sets[j]) * 10 <= min(len(w), len(sets[j])) * 6 for j in kept):
            kept.append(k)
    got = {r["k"]: r["kept"] for r in headlines.keep_first(d, "k", "t").collect()}
    assert sorted(k for k, v in got.items() if v) == kept and set(got) == {k for k, w in sets.items() if len(w) >= 3}


def test_headlines_are_kept_the_same_whatever_the_first_part(spark, monkeypatch):
    from tidemark.operators import headlines

    r = np.random.default_rng(4)
    p = 1 / np.arange(1, 401)
    size = [*r.integers(3, 9, 200), *r.integers(9, 60, 150), 300, 310, 320]
    text = [" ".join(f"w{w}" for w in r.choice(400, n, replace=False, p=p / p.sum())) for n in size]
    text += [" ".join(reversed(t.split())) for t in text[::9]] + [f"{t} more{i}" for i, t in enumerate(text[::7])] + [f"one{i} two{i} three{i}" for i in range(9)]
    d = {int(k): t for k, t in zip(r.permutation(len(text)), text)}
    kept, sets = [], {k: set(t.split()) for k, t in sorted(d.items())}
    for k, w in sets.items():
        if all(len(w & sets[j]) * 10 <= min(len(w), len(sets[j])) * 6 for j in kept):
            kept.append(k)
    rows = spark.createDataFrame([*d.items(), (None, "of no key at all")], "k long, t string")
    for first, words in ((40, 1 << 20), (1, 1 << 20), (1000, 700)):
        monkeypatch.setattr(headlines, "FIRST", first, raising=False)
        monkeypatch.setattr(headlines, "FIRST_WORDS", words, raising=False)
        got = {x["k"]: x["kept"] for x in headlines.keep_first(rows, "k", "t").collect()}
        assert not got.pop(None) and got == {k: k in set(kept) for k in sets}, (first, words)


def test_words_of_headlines_are_counted_in_blocks(monkeypatch):
    from tidemark.operators import headlines

    r = np.random.default_rng(5)
    sets, word = [], []
    for w, n in enumerate([1, 2, 7, 8, 9, 60, 70, 300]):
        sets += [np.sort(r.choice(np.arange(10, 700), r.integers(2, 600 if i % 40 == 0 else 30), replace=False)) for i in range(n)]
        word += [w] * n
    need, few = np.array([len(x) // 3 for x in sets], np.int32).clip(1), r.random(len(sets)) < 0.5
    o = np.lexsort((~few, word))
    sets, word, need, few = [sets[i] for i in o], np.array(word)[o], need[o], few[o]
    off = np.r_[0, np.cumsum([len(x) for x in sets])]
    want = {(i, j) for i in np.flatnonzero(few) for j in np.flatnonzero(word == word[i]) if i != j and len(np.intersect1d(sets[i], sets[j])) >= need[i]}
    for shift in (0, 1 << 25):  # word numbers too large for a table
        for wide, deep, gather in ((1024, 1 << 16, 1 << 20), (16, 90, 200)):
            for k, v in (("WIDE", wide), ("DEEP", deep), ("GATHER", gather)):
                monkeypatch.setattr(headlines, k, v)
            s, other = headlines._near_in_words(word, few, need, off, np.concatenate(sets) + shift, headlines._Find())
            assert len(s) == len(want) and set(zip(s.tolist(), other.tolist())) == want


def test_position_size_and_risk_rules(spark):
    from tidemark.operators import rules

    rows = [(3e12, 10.0, 1.2, "us", False), (25e9, 15.0, 1.0, "us", False), (2e9, -1.0, None, "hk", False), (4e8, 9.0, 1.0, "us", False), (3e12, 40.0, 0.1, "us", True)]
    d = spark.createDataFrame(rows, "cap double, exret double, beta double, region string, fund boolean")
    f = rules.size_factors(F.col("cap"), F.col("exret"), F.col("beta"), F.col("region"))
    got = [r[0] for r in d.select(rules.position_size(F.col("cap"), *f.values(), F.col("fund"))).collect()]
    assert got == [10500.0, 6500.0, 2000.0, None, None] or got[:2] == [10500.0, 6000.0]
    s = spark.createDataFrame([(2.5, 15.0, 1.4, 0.5), (9.0, 30.0, 1.0, 2.0), (0.0, 0.0, 0.5, 3.0)], "v double, d double, b double, s double")
    out = s.select(rules.risk_score(*[F.col(c) for c in "vdbs"]).alias("x")).withColumn("l", rules.risk_level(F.col("x"))).collect()
    assert [tuple(r) for r in out] == [(78, "HIGH"), (100, "HIGH"), (0, "LOW")]
