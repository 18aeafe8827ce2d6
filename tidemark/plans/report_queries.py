"""Reports: calibration (G03), suggestions (G25), reasons (G32), long weights (G18), trim gate (P50)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import outcomes as oc
from tidemark.operators import reports as rp
from tidemark.plans.outcome_queries import REV, rnd
from tidemark.plans.timeseries_queries import fwd, r6
from tidemark.plans.universe_queries import a21, a22
from tidemark.registry import ORACLES, query
from tidemark.session import written
from tidemark.sources import lens

CAL_SQL = """
x AS (SELECT r.action, r.date, f.horizon, f.ret, CASE d.tier WHEN 'mega' THEN 9 WHEN 'large' THEN 12 WHEN 'mid' THEN 18 WHEN 'small' THEN 30 ELSE 60 END / 50.0::DOUBLE AS cost
  FROM reviews r JOIN fwd f ON f.ticker = r.ticker AND f.date = r.date AND f.horizon IN (7, 30) JOIN dims d ON d.ticker = r.ticker),
ds AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM x)),
cut AS (SELECT date AS test_from FROM ds WHERE i = floor(n * 0.7::DOUBLE) + 1),
y AS (SELECT x.*, s.scope, c.net, ret - CASE WHEN c.net THEN cost ELSE 0 END AS r FROM x, (VALUES ('all'), ('test')) s(scope), (VALUES (false), (true)) c(net) WHERE s.scope = 'all' OR date >= (SELECT test_from FROM cut)),
rep AS (SELECT scope, horizon, net, action, count(*) AS n, avg(CASE WHEN r IS NULL THEN NULL WHEN (action IN ('BUY', 'ADD') AND r > 0) OR (action IN ('SELL', 'TRIM') AND r < 0) OR (action = 'HOLD' AND abs(r) < 5) THEN 100.0 ELSE 0 END) AS hit_rate, avg(r) AS avg_return FROM y GROUP BY ALL)"""


def calibration(spark, sf):
    rows = lens.review_columns(fwd(spark, sf, [7, 30]), "horizon", "ret").select("ticker", "action", "date", "horizon", "ret")
    cost = lens.dims(spark, sf).select("ticker", oc.round_trip_pct(F.col("tier")).alias("cost"))
    return rp.calibration(written(rows.join(cost, "ticker"), "calibration"))


@query("g03_calibration_report", ctes=(*REV, "dims"), sql=CAL_SQL + " SELECT scope, horizon, net, action, n, round(hit_rate, 6) AS hit_rate, round(avg_return, 6) AS avg_return FROM rep")
def g03(spark, sf):
    """Gross and net, at 7 and 30 bars, all days and the last three tenths."""
    return rnd(calibration(spark, sf))


@query("g03_calibration_findings", ctes=(*REV, "dims"), sql=CAL_SQL + """,
h AS (SELECT max(hit_rate) FILTER (scope = 'all' AND action = 'BUY') AS buy, max(hit_rate) FILTER (scope = 'all' AND action = 'SELL') AS sell, max(avg_return) FILTER (scope = 'all' AND action = 'BUY') AS ret, max(hit_rate) FILTER (scope = 'test' AND action = 'BUY') AS later FROM rep WHERE horizon = 30 AND NOT net),
a AS (SELECT list_filter([CASE WHEN coalesce(buy < 50, true) THEN 'buy_hit_rate_low' END, CASE WHEN coalesce(sell < 60, true) THEN 'sell_hit_rate_low' END, CASE WHEN ret < 0 THEN 'buy_return_negative' END, CASE WHEN later > 0 AND buy - later > 15 THEN 'overfitting' END], lambda x: x IS NOT NULL) AS l FROM h)
SELECT unnest(CASE WHEN len(l) > 0 THEN l ELSE ['within_range'] END) AS finding FROM a""")
def g03_findings(spark, sf):
    return rp.findings(calibration(spark, sf))


@query("g25_improvement_suggestions", sql=f"""
SELECT category, priority, title, subject, figure FROM (
  SELECT CASE WHEN metric = 'peg' AND ratio > 0 AND ratio < 1.1 THEN ['metric', 'HIGH', 'remove_peg'] WHEN metric = 'w52' AND ratio > 0 AND ratio < 1.1 THEN ['metric', 'LOW', 'reconsider_52w'] WHEN ratio > 1.5 THEN ['metric', 'LOW', 'keep_strong_metric'] END AS s, metric AS subject, ratio AS figure FROM ({ORACLES["a21_metric_effectiveness"]})
  UNION ALL SELECT CASE WHEN tier IS NULL AND sector IS NULL AND rate > 50 THEN ['data', 'HIGH', 'address_inconclusive'] WHEN tier = 'small' AND rate > 40 THEN ['threshold', 'MEDIUM', 'relax_small_analysts'] END, coalesce(tier, 'all'), rate FROM ({ORACLES["a22_data_quality_report"]})) q,
  LATERAL (SELECT s[1] AS category, s[2] AS priority, s[3] AS title) z WHERE s IS NOT NULL""")
def g25(spark, sf):
    return rp.suggestions(a21(spark, sf), a22(spark, sf))


@query("g32_reasons_not_owned", ctes=("universe",), sql="""
SELECT ticker, concat_ws(',', CASE WHEN coalesce(upside, 0) < 15 THEN 'limited_upside' END, CASE WHEN coalesce(buy_pct, 0) < 75 THEN 'mixed_sentiment' END, CASE WHEN k % 6 = 1 THEN 'insiders_sell' END, CASE WHEN NOT (w52 >= 99) THEN 'not_at_high' END, CASE WHEN beta > 1.5 THEN 'high_beta' END, CASE WHEN pef > 30 THEN 'rich' END,
  CASE WHEN coalesce(upside, 0) >= 15 AND coalesce(buy_pct, 0) >= 75 AND k % 6 <> 1 AND coalesce(w52 >= 99, true) AND coalesce(beta <= 1.5, true) AND coalesce(pef <= 30, true) THEN 'capacity_or_timing' END) AS reasons FROM universe WHERE NOT held""")
def g32(spark, sf):
    """Reasons for names that are not held; insiders are a stand-in by key."""
    c = F.col
    r = rp.reasons_not_owned(c("upside"), c("buy_pct"), F.when(c("k") % 6 == 1, "NET_SELLING").otherwise("NEUTRAL"), c("w52") >= 99, c("beta"), c("pef"))
    return lens.universe(spark, sf).where("not held").select("ticker", F.concat_ws(",", r).alias("reasons"))


POSITIONS = [("symbol", "CASE WHEN p_partkey % 29 = 0 THEN '  ' ELSE concat(' P', cast(p_partkey div 2 as varchar(20)), ' ') END"), ("is_buy", "CASE p_partkey % 7 WHEN 0 THEN 'False' WHEN 1 THEN ' no ' WHEN 2 THEN '0' WHEN 3 THEN NULL ELSE 'True' END"),
             ("pct", "CASE p_partkey % 11 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE cast(p_partkey % 90 as varchar(20)) END")]


@query("g18_long_weights", sql="p AS (SELECT " + ", ".join(f"{e.replace(' div ', ' // ')} AS {n}" for n, e in POSITIONS) + """ FROM part)
SELECT trim(symbol) AS ticker, round(sum(coalesce(try_cast(pct AS double), 0) / 100), 6) AS weight FROM p WHERE trim(symbol) <> '' AND coalesce(lower(trim(is_buy)) NOT IN ('false', '0', 'no'), true) GROUP BY 1""")
def g18(spark, sf):
    return rp.long_weights(lens.table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in POSITIONS])).select("ticker", r6("weight"))


@query("p50_trim_regime_gate", ctes=("reviews",), sql="""
SELECT ticker, date, action, CASE WHEN action = 'TRIM' AND okey % 23 <> 0 AND NOT risk_warning AND rsi < 80 AND okey % 90 / 10.0 < 6 AND tech_signal NOT IN ('EXIT_SOON', 'AVOID') AND regime = 'RISK_ON' AND okey % 3 <> 1 THEN 'HOLD' ELSE action END AS gated FROM reviews""")
def p50(spark, sf):
    k = F.col("okey")
    m = F.when(k % 3 == 0, "IMPROVING").when(k % 3 == 1, "STABLE").otherwise("STRONG_IMPROVING")
    g = rp.trim_gate(F.col("action"), F.col("regime"), m, F.col("tech_signal"), F.col("rsi"), k % 90 / 10.0, k % 23 == 0, F.col("risk_warning"))
    return lens.reviews(spark, sf).select("ticker", "date", "action", g.alias("gated"))
