"""Sizing chain, votes and rule tables against the rules' own examples."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sizing as sz
from tidemark.operators import votes as vt

CHAIN = "id int, tier string, conviction int, regime string, cluster_size int, fx double, freshness string, var95 double, rotation string, rotation_pp double, net_return double, daily_volume double"


def sized(spark, *rows, **kw):
    return {r.id: r for r in sz.with_conviction_size(spark.createDataFrame(list(rows), CHAIN), **kw).collect()}


def test_chain(spark):
    big = 1e12
    got = sized(
        spark,
        (1, "mid", 80, "normal", None, None, "fresh", None, None, None, None, big),
        (2, "mega", 80, "high", 4, 0.928, "aging", 3.75, "losing", -10.0, 5.0, big),
        (3, "mid", 80, "low", 1, 1.0, "dead", 2.0, None, None, None, big),
        (4, "mid", 8, "low", 1, 1.0, "fresh", 2.0, "losing", -20.0, None, big),
        (5, "mid", 95, "low", 1, 1.0, "fresh", 2.0, "gaining", 30.0, 0.5, big),
        (6, "small", 50, "low", 1, 1.0, "fresh", 12.0, None, None, 1.0, big),
        (7, "small", 50, "odd", 1, 1.0, "odd", 5.0, "flat", 0.0, None, None),
        (8, "micro", 50, "low", 1, 1.0, "fresh", None, None, None, None, 1000.0),
    )
    assert got[1].size == 7500.0 and not got[1].blocked
    assert got[2].size == pytest.approx(2500 * 5 * 0.5 * 0.5 * 0.928 * 0.75 * 0.75, abs=0.01) and got[2].adjusted_conviction == 65
    assert got[3].blocked and got[3].size == 0 and got[4].blocked and got[4].adjusted_conviction == 0
    assert got[5].blocked and got[5].adjusted_conviction == 100
    assert got[6].size == 0 and not got[6].blocked and got[7].size == 2500.0
    assert got[8].blocked  # the size is 2.5 times a day's volume
    assert sized(spark, (1, "mega", 80, "low", None, None, "fresh", None, None, None, None, big), portfolio=100_000.0)[1].size == 5000.0
    assert sized(spark, (1, "mid", 50, "low", None, None, "fresh", None, None, None, None, big), clamped=False)[1].size == pytest.approx(7500 * 0.675)


def test_factors(spark):
    d = spark.createDataFrame([(1.0, 3), (2.5, 1), (3.75, 2), (5.0, 4), (9.9, None), (10.0, 0)], "v double, n int")
    got = d.select(sz.var_factor(F.col("v")), sz.cluster_factor(F.col("n")), sz.redundancy(F.col("n"))).collect()
    assert [r[0] for r in got] == [1.0, 1.0, 0.75, 0.5, 0.5, 0.0]
    assert [round(r[1], 9) for r in got] == [round(x, 9) for x in (1 / math.sqrt(3), 1, 1 / math.sqrt(2), 0.5, 1, 1)]
    assert [r[2] for r in got] == [-8, 0, -4, -8, 0, 0]
    assert d.select(sz.holding_cost_pct(F.lit(90), F.lit("mid"))).first()[0] == pytest.approx(0.2 + 0.064 * 90 / 365 * 100)


def test_suggested_sizes_keep_other_columns(spark):
    rows = [(1, "BUY", False, 1.0, True, 1.0, None), (2, "ADD", True, 1.0, True, 1.0, None), (3, "HOLD", False, 1.0, True, 1.0, None), (4, "BUY", False, 0.5, True, 0.5, 3.75), (5, "BUY", False, 1.0, False, 1.0, None)]
    d = spark.createDataFrame(rows, "id int, action string, in_cooldown boolean, vol_scale double, new_allowed boolean, breaker double, var95 double")
    d = d.withColumns({"tier": F.lit("mid"), "conviction": F.lit(50), "regime": F.lit("elevated"), "cluster_size": F.lit(None).cast("int"), "fx": F.lit(0.928), "size": F.lit("clash")})
    out = sz.with_suggested_size(d)
    assert out.columns == [*d.columns, "suggested_usd", "size_pct"]
    got = {r.id: (r.suggested_usd, r.size_pct) for r in out.collect()}
    assert got == {1: (5220.0, 1.25), 2: (0.0, 0.0), 3: (None, None), 4: (979.0, 1.25), 5: (0.0, 1.25)}


def test_votes(spark):
    names = "id int, fund_score double, fund_synthetic boolean, tech_signal string, tech_synthetic boolean, rsi double, tech_momentum int, regime string, macro_fit string, census_view string, census_div double, news_impact string, sentiment_view string, sentiment_volume string, risk_warning boolean, signal string, buy_pct double"
    rows = [
        (1, 80.0, False, "ENTER_NOW", False, 50.0, 0, "RISK_ON", "FAVORABLE", "ALIGNED", 50.0, "HIGH_POSITIVE", "BULLISH", "HIGH", False, "B", 100.0),
        (2, 30.0, True, "AVOID", True, 25.0, 0, "RISK_OFF", "UNFAVORABLE", "NEUTRAL", 0.0, "HIGH_NEGATIVE", "BEARISH", "LOW", True, "S", 0.0),
        (3, 75.0, False, "HOLD", False, 50.0, 30, "RISK_OFF", "x", "DIVERGENT", -25.0, "x", "", "LOW", True, "B", 90.0),
    ]
    got = {r.id: r for r in vt.with_votes(spark.createDataFrame(rows, names)).collect()}
    assert got[1].bull == pytest.approx(1.25 + 0.75 + 0.75 + 1.25 + 0.85 + 0.75 + 0.6 + 1.2) and got[1].bear == pytest.approx(0.15 + 0.4)
    assert got[1].directional == pytest.approx((1.25 + 0.75 + 0.75 + 1.25 + 1 + 0.75 + 1.2) / (1.25 + 0.75 + 0.75 + 1.25 + 1 + 0.75 + 1.2 + 1))
    quiet = 0.85 * 0.75  # no divergence score counts as half of the range
    assert got[2].bear == pytest.approx(0.625 + 0.1875 + 0.75 + quiet / 2 + 1.3 + 0.375 + 2.0 + 1.2)
    w = 1.25 * 0.75
    assert got[3].bull == pytest.approx(1.25 + 0.375 + 0.375 + w * 0.41 + 0.5 + 0.1875 + 0 + 15 / 25 * 1.2) and got[3].bear == pytest.approx(0.375 + 0.375 + w * 0.59 + 0.5 + 0.1875 + 0.6)


def test_rule_tables(spark):
    d = spark.createDataFrame([("B", "S", 14), ("B", "H", 30), ("S", "B", 3), ("H", "B", 15), ("H", "H", 91), ("I", None, 3), ("B", "S", 31)], "a string, b string, n int")
    assert [tuple(r[0]) for r in d.select(vt.velocity(F.col("a"), F.col("b"), F.col("n"))).collect()] == [(5, "ACCELERATING"), (3, "IMPROVING"), (-5, "DETERIORATING"), (-3, "WEAKENING"), (-2, "STALE"), (0, "NO_HISTORY"), (0, "STABLE")]
    d = spark.createDataFrame([(12.0, 2, "ACCELERATING"), (12.0, 2, "DECELERATING"), (6.0, 3, "ACCELERATING"), (6.0, 0, "DECELERATING"), (-11.0, 0, "DECELERATING"), (None, 5, "ACCELERATING"), (0.0, 2, None)], "p double, b int, t string")
    assert [tuple(r[0]) for r in d.select(vt.surprise(F.col("p"), F.col("b"), F.col("t"))).collect()] == [(10, "SERIAL_BEATER_ACCEL"), (8, "SERIAL_BEATER_DECEL"), (5, "BEAT_ACCEL"), (1, "BEAT_DECEL"), (-5, "BIG_MISS"), (0, "NO_DATA"), (0, "IN_LINE")]
    d = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 2.0), (2.4, 2.0), (2.5, 2.0), (3.0, 2.0), (4.0, 2.0)], "c double, l double")
    assert [tuple(r[0]) for r in d.select(vt.overweight(F.col("c"), F.col("l"))).collect()] == [(0, False), (20, True), (0, False), (5, False), (10, False), (15, True), (25, True)]


def test_opportunity_gate(spark):
    d = spark.createDataFrame([(1, 60, 50.0, "HOLD", "x", "x", "RISK_OFF", 2), (2, 60, 80.0, "HOLD", "x", "x", "CAUTIOUS", 0), (3, 95, 80.0, "ENTER_NOW", "x", "x", "", None), (4, 3, None, None, None, None, "", 1)],
                              "id int, conviction int, fund_score double, tech_signal string, macro_fit string, census_view string, regime string, sector_positions int")
    got = {r.id: (r.confirmations, r.gated, r.gate_action) for r in vt.with_opportunity_gate(d).collect()}
    assert got == {1: (0, 53, "BUY"), 2: (1, 63, "BUY"), 3: (2, 75, "BUY"), 4: (0, 0, "HOLD")}


def test_event_risk(spark):
    d = spark.createDataFrame([(["RegulatoryAction"],), (["x", None],), ([],), (None,), ([None],)], "w array<string>")
    assert [r[0] for r in d.select(vt.event_risk(F.col("w"), ["regul"])).collect()] == [True, False, False, False, False]
    assert [r[0] for r in d.select(vt.event_risk(F.col("w"))).collect()] == [True, True, False, False, True]
    assert [r[0] for r in d.select(vt.event_risk(F.col("w"), [])).collect()] == [False] * 5
