"""Listings, sector classes and the one-factor risk, on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import books, cascade, listing, sector_rules

D = dt.date


def test_grace_at_both_edges_of_the_range(spark):
    listed = spark.createDataFrame([("A", D(2020, 1, 10)), ("A", D(2022, 1, 1)), ("B", D(2020, 1, 1))], "ticker string, date date")
    days = [D(2020, 1, 9), D(2020, 1, 10), D(2020, 1, 10) + dt.timedelta(359), D(2020, 1, 10) + dt.timedelta(360), D(2021, 12, 31), D(2022, 1, 1), D(2022, 12, 26), D(2022, 12, 27)]
    d = spark.createDataFrame([("A", x) for x in days] + [("C", D(2020, 1, 1))], "ticker string, date date")
    got = {(r.ticker, r.date): (r.listed, r.in_grace) for r in listing.with_grace(d, listed).collect()}
    assert [got["A", x][1] for x in days] == [False, True, True, False, False, True, True, False]
    assert got["A", days[0]][0] is None and got["C", D(2020, 1, 1)] == (None, False)


def test_known_listing_days_replace_the_first_trading_day(spark):
    px = spark.createDataFrame([("A", D(2020, 5, 1)), ("A", D(2020, 4, 1)), ("B", D(2020, 3, 1))], "ticker string, date date")
    known = spark.createDataFrame([("B", D(2019, 1, 1)), ("B", D(2021, 1, 1))], "ticker string, date date")
    assert sorted(map(tuple, listing.listing_days(px, known).collect())) == [("A", D(2020, 4, 1)), ("B", D(2019, 1, 1)), ("B", D(2021, 1, 1))]


def test_grace_relaxes_two_sell_gates(spark):
    d = spark.createDataFrame([(1, 45.0, -30.0, True), (2, 45.0, -30.0, False), (3, 39.0, 0.0, True)], "id int, w52 double, am double, g boolean")
    for c in ("upside", "buy_pct", "si", "beta", "roe", "de", "pe_vs_sector"):
        d = d.withColumn(c, F.lit(None).cast("double"))
    d = d.withColumn("gate_region", F.lit("us")).withColumn("tier", F.lit("mega")).join(cascade.threshold_table(spark), ["gate_region", "tier"])
    got = {r.id: r.t for r in d.select("id", cascade.sell_triggers(F.col("g")).alias("t")).collect()}
    assert got == {1: [], 2: ["max_pct_from_52w_high", "max_analyst_momentum"], 3: ["max_pct_from_52w_high"]}


def test_asset_types_with_priorities_and_exclusions(spark):
    want = {
        ("BTC-USD", "Bitcoin"): "crypto", ("vet", None): "crypto", ("VET", "Vermilion Energy"): "stock", ("MSTR", "Strategy Inc"): "bitcoin_proxy", ("XX", "First Bitcoin Trust ETF"): "bitcoin_proxy",
        ("XX", "World Index"): "etf", ("XX", "Indexes of Things"): "stock", ("XX", "Betf"): "stock", ("JUP.L", "Jupiter Index"): "stock", ("XX", "Index Fund Management"): "stock", ("XX", "Old Investment Trust"): "etf",
        ("XX", "Old Trust"): "stock", ("XX", "Vanguard Growth Fund"): "etf", ("XX", "Vanguard Growth"): "stock", (" spy ", None): "etf", ("VIXY", None): "etf", ("^VIX3", None): "commodity", ("GOLD", "Barrick"): "commodity",
        ("XX", "Big Gold Fund"): "commodity", ("XX", "Big Gold Fund Ltd"): "stock", ("XOM", "Gold Fund"): "stock", ("", "World Index"): "other", (None, None): "other", ("QQQ", "Trust Bank"): "stock",
    }
    d = spark.createDataFrame(list(want), "ticker string, name string")
    assert {(r.ticker, r.name): r.asset_type for r in listing.with_asset_type(d).collect()} == want
    more = listing.ticker_lists(spark).unionByName(spark.createDataFrame([("etf", "XX")], "list string, ticker string"))
    assert listing.with_asset_type(d.where("name = 'Old Trust'"), more).first().asset_type == "etf"


def test_share_classes(spark):
    rows = [("ERICA.ST", None), ("ERICB.ST", None), ("VOLVB.ST", "x"), ("VOLV-A.ST", "x"), ("SOLOA.ST", "Solo"), ("NAMEA.CO", "Name Series A"), ("PAIRA.L", None), ("PAIRB.L", None), ("HYP-B.ST", "class"), ("A.ST", "class"), ("TEKE.ST", "class")]
    d = spark.createDataFrame(rows, "symbol string, company string")
    got = {r.symbol: r.fixed for r in listing.with_class_hyphen(d).collect()}
    assert {s: f for s, f in got.items() if s != f} == {"ERICA.ST": "ERIC-A.ST", "ERICB.ST": "ERIC-B.ST", "VOLVB.ST": "VOLV-B.ST", "NAMEA.CO": "NAME-A.CO"}


def test_duplicates_go_only_if_both_are_there(spark):
    d = spark.createDataFrame([(s,) for s in ("GOOGL", "GOOG", "SAP", "X.AS", "X.NV", "Y.AS", "a", "b", "c", "e", "a")], "symbol string")
    assert sorted(r.symbol for r in listing.without_duplicates(d).collect()) == ["GOOG", "SAP", "X.NV", "Y.AS", "a", "a", "b", "c", "e"]
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("e", "missing")], "secondary string, primary string")
    both = listing.listing_pairs(d, pairs, [])
    assert {tuple(r) for r in listing.survivors(both).select("secondary", "survivor").collect()} == {("a", "c"), ("b", "c")}
    assert sorted({r.symbol for r in listing.without_duplicates(d, pairs, []).collect()}) == ["GOOG", "GOOGL", "SAP", "X.AS", "X.NV", "Y.AS", "c", "e"]
    long = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "secondary string, primary string")
    assert {r.survivor for r in listing.survivors(long).collect()} == {"n20"}
    with pytest.raises(ValueError):
        listing.survivors(spark.createDataFrame([("a", "b"), ("b", "a")], "secondary string, primary string"))


def test_look_through(spark):
    bridge = spark.createDataFrame([("F", "x", 0.5), ("F", "G", 0.5), ("G", "x", 0.5), ("G", "H", 0.25), ("G", "y", 0.25), ("H", "z", 1.0)], "fund string, holding string, weight double")
    pos = spark.createDataFrame([("p", "F", 0.8), ("p", "x", 0.2), ("q", "unknown", 1.0)], "position string, asset string, weight double")
    got = {(r.position, r.asset): round(r.weight, 9) for r in listing.look_through(pos, bridge).collect()}
    assert got == {("p", "x"): 0.8, ("p", "y"): 0.1, ("p", "z"): 0.1, ("q", "unknown"): 1.0}
    circle = bridge.unionByName(spark.createDataFrame([("H", "F", 1.0)], "fund string, holding string, weight double"))
    with pytest.raises(ValueError):
        listing.look_through(pos, circle, most_rounds=6)


def test_most_specific_class_wins_and_other_gates_stay(spark):
    rows = [("JPM", "Credit Services", "Real Estate"), ("cat", None, None), ("p", "Credit Services", "Real Estate"), ("q", "x", "Real Estate"), ("r", None, "Technology"), (None, None, "Utilities")]
    d = spark.createDataFrame(rows, "ticker string, industry string, sector string")
    got = {(r.ticker, r.sector): r for r in sector_rules.with_class_gates(sector_rules.with_sector_class(d).withColumns({f"t_{g}": F.lit(-1.0) for g in sector_rules.OVERRIDDEN})).collect()}
    assert {k: r.sector_class for k, r in got.items()} == {("JPM", "Real Estate"): "FINANCIAL", ("cat", None): "EQUIPMENT_FINANCING", ("p", "Real Estate"): "PAYMENT_PROCESSORS", ("q", "Real Estate"): "REIT", ("r", "Technology"): None, (None, "Utilities"): "UTILITY"}
    assert got["JPM", "Real Estate"].t_min_roe == 6 and got["JPM", "Real Estate"].t_min_fcf_yield == -1
    assert got["q", "Real Estate"].t_min_roe is None and got["q", "Real Estate"].t_max_debt_equity == 300
    assert got["r", "Technology"].t_min_roe == -1 and got[None, "Utilities"].t_min_fcf_yield == -10


def test_large_member_lists_are_not_broadcast(spark):
    from tidemark.session import small

    d = spark.range(50).select(F.col("id").cast("string").alias("k"))
    assert "ResolvedHint" in small(d, 50)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small(d, 49)._jdf.queryExecution().analyzed().toString()


def test_one_factor_risk_equals_the_dense_form(spark):
    r = np.random.default_rng(4)
    n, t = 5, 40
    f = r.normal(0, 0.05, t)
    x = np.outer(f, r.uniform(0.5, 1.5, n)) + r.normal(0, 0.03, (t, n))
    w = np.array([1.0, 2, 3, 1, 3])
    hist = spark.createDataFrame([(1, f"n{j}", i, float(x[i, j]), t) for i in range(t) for j in range(n)], "book int, ticker string, month int, ret double, n_dates int")
    factor = spark.createDataFrame([(i, float(f[i])) for i in range(t)], "month int, f double")
    weights = spark.createDataFrame([(f"n{j}", float(w[j])) for j in range(n)], "ticker string, weight double")
    got = books.single_factor_risk(hist, factor, "book", weights).first()
    v = f.var(ddof=1)
    beta = np.array([np.cov(x[:, j], f)[0, 1] / v for j in range(n)])
    dense = np.outer(beta, beta) * v + np.diag(x.var(axis=0, ddof=1) - beta**2 * v)
    p = w / w.sum()
    sample = np.cov(x, rowvar=False)
    assert got.factor_vol == pytest.approx(np.sqrt(p @ dense @ p * 12)) and got.beta == pytest.approx(beta @ p)
    assert got.sample_vol == pytest.approx(np.sqrt(p @ sample @ p * 12))
    assert got.shrunk_vol == pytest.approx(np.sqrt(p @ (0.8 * sample + 0.2 * dense) @ p * 12))
