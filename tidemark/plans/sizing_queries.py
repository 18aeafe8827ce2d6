"""Sizing chain (P26, C11, C13, G07, G09), votes and rule tables (P45, P51, P52, P55, P56), selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sizing as sz
from tidemark.operators import votes as vt
from tidemark.operators.timeseries import asof_backward
from tidemark.plans.timeseries_queries import ROT_SQL, r6, rotation
from tidemark.plans.universe_queries import CASCADE_SQL, classified
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources import lens

# --- the chain: inputs that the given tables lack are stand-ins by key

CHAIN_SQL = ROT_SQL + """,
cl AS (SELECT sector, count(*) AS size FROM dims WHERE ticker % 7 = 2 GROUP BY 1),
ch AS (SELECT r.*, d.tier, d.region, CASE WHEN r.ticker % 7 = 2 THEN cl.size END AS cluster_size, rot.state AS rotation, rot.delta_pp AS rotation_pp,
  CASE okey % 11 WHEN 0 THEN 'dead' WHEN 1 THEN 'stale' WHEN 2 THEN 'aging' ELSE 'fresh' END AS freshness, CASE WHEN d.region = 'eu' THEN 1.0 ELSE 0.928 END::DOUBLE AS fx,
  CASE WHEN okey % 13 <> 0 THEN okey % 120 / 10.0 END::DOUBLE AS var95, CASE r.regime WHEN 'RISK_OFF' THEN 'high' WHEN 'CAUTIOUS' THEN 'elevated' WHEN 'RISK_ON' THEN 'low' ELSE 'normal' END AS rg,
  exret - 2.0::DOUBLE AS net_return, CASE WHEN okey % 9 <> 0 THEN (okey % 1000 * 1000)::DOUBLE END AS volume
  FROM reviews r JOIN dims d USING (ticker) LEFT JOIN cl ON cl.sector = d.sector LEFT JOIN rot ON rot.sector = d.sector),
fc AS (SELECT *, 2500.0::DOUBLE * CASE tier WHEN 'mega' THEN 5 WHEN 'large' THEN 4 WHEN 'mid' THEN 3 WHEN 'small' THEN 2 ELSE 1 END AS tier_size, CASE rotation WHEN 'losing' THEN -15 WHEN 'gaining' THEN 10 ELSE 0 END AS points,
  CASE rg WHEN 'elevated' THEN 0.75 WHEN 'high' THEN 0.5 ELSE 1 END::DOUBLE AS regime_factor, CASE WHEN cluster_size > 1 THEN 1 / sqrt(cluster_size) ELSE 1 END::DOUBLE AS cluster_factor,
  CASE freshness WHEN 'aging' THEN 0.75 WHEN 'stale' THEN 0.5 WHEN 'dead' THEN 0 ELSE 1 END::DOUBLE AS freshness_factor,
  CASE WHEN var95 IS NULL OR var95 <= 2.5 THEN 1 WHEN var95 >= 10 THEN 0 WHEN var95 >= 5 THEN 0.5 ELSE round(1 - (var95 - 2.5::DOUBLE) / 2.5::DOUBLE * 0.5::DOUBLE, 2) END::DOUBLE AS var_factor FROM ch)"""


def chained(spark, sf, sig=None, *keep):
    """Review rows (of the signals ``sig``, with their columns ``keep``) with what the chain reads."""
    d = lens.dims(spark, sf)
    cl = d.where("ticker % 7 = 2").groupBy("sector").agg(F.count("*").alias("n"))
    rot = rotation(spark, sf).select("sector", F.col("state").alias("rotation"), F.col("delta_pp").alias("rotation_pp"))
    d = d.join(cl, "sector", "left").join(rot, "sector", "left").select("ticker", "tier", "region", "rotation", "rotation_pp", F.when(F.col("ticker") % 7 == 2, F.col("n")).alias("cluster_size"))
    k = F.col("okey")
    return lens.review_columns(lens.signals(spark, sf) if sig is None else sig, *keep).join(d, "ticker").withColumns({
        "freshness": F.when(k % 11 == 0, "dead").when(k % 11 == 1, "stale").when(k % 11 == 2, "aging").otherwise("fresh"), "fx": F.when(F.col("region") == "eu", 1.0).otherwise(0.928),
        "var95": F.when(k % 13 != 0, k % 120 / 10.0), "review_regime": F.col("regime"), "regime": sz.lookup(F.col("regime"), sz.REGIME_OF_REVIEW, "normal"), "net_return": F.col("exret") - 2.0,
        "daily_volume": F.when(k % 9 != 0, (k % 1000 * 1000).cast("double"))})


@query("p26_c11_g07_g09_conviction_size", ctes=("reviews", "signals", "dims"), sql=CHAIN_SQL + """,
b AS (SELECT *, greatest(0, least(100, conviction + points)) AS adjusted, coalesce(net_return < 1, false) OR coalesce(rotation = 'losing' AND rotation_pp <= -20, false) OR freshness_factor = 0
  OR CASE tier WHEN 'mega' THEN 2 WHEN 'large' THEN 5 WHEN 'mid' THEN 10 WHEN 'small' THEN 15 ELSE 20 END + CASE WHEN volume > 0 THEN tier_size / volume * 10000 ELSE 50 END > 300 AS blocked FROM fc)
SELECT ticker, date, adjusted AS adjusted_conviction, points AS rotation_points, CASE WHEN cluster_size >= 4 THEN -8 WHEN cluster_size >= 3 THEN -4 ELSE 0 END AS redundancy, round(cluster_factor, 6) AS cluster_factor, var_factor, blocked,
  CASE WHEN blocked THEN 0 ELSE round(round(least(tier_size * regime_factor * cluster_factor * fx * freshness_factor * var_factor, 22500), 2), 1) END::DOUBLE AS size FROM b""")
def p26(spark, sf):
    """Every review's size with its factors, redundancy points of its cluster and rotation points of its sector."""
    d = sz.with_conviction_size(chained(spark, sf))
    points = sz.redundancy(F.coalesce(F.col("cluster_size"), F.lit(1)) - 1)
    return d.select("ticker", "date", "adjusted_conviction", "rotation_points", points.alias("redundancy"), r6("cluster_factor"), "var_factor", "blocked", F.round("size", 1).alias("size"))


@query("c13_suggested_sizes", ctes=("reviews", "signals", "dims"), sql=CHAIN_SQL + """,
s AS (SELECT ticker, date AS stop FROM signals WHERE signal = 'S' AND conviction < 30),
a AS (SELECT fc.*, s.stop, coalesce(fc.date - s.stop <= 28, false) AS cool, CASE WHEN okey % 5 = 0 THEN 0.7 ELSE 1.2 END::DOUBLE AS vol_scale, CASE year(fc.date) WHEN 1994 THEN 0.5 ELSE 1 END::DOUBLE AS breaker, year(fc.date) <> 1996 AS allowed,
  round(least(tier_size * regime_factor * cluster_factor, 22500), 2) AS own FROM fc ASOF LEFT JOIN s ON s.ticker = fc.ticker AND fc.date >= s.stop)
SELECT ticker, date, action, CASE WHEN action NOT IN ('BUY', 'ADD') THEN NULL WHEN cool THEN 0 ELSE round(CASE WHEN allowed THEN own * fx * vol_scale * breaker ELSE 0 END * var_factor, 0) END::DOUBLE AS suggested_usd,
  CASE WHEN action NOT IN ('BUY', 'ADD') THEN NULL WHEN cool THEN 0 ELSE round(own / 450000 * 100, 2) END::DOUBLE AS size_pct FROM a""")
def c13(spark, sf):
    """BUY and ADD rows sized under cooldowns (28 days after a weak S of the ticker, as of the row's day), breaker and risk budget."""
    sig = written(lens.signals(spark, sf).drop("custkey"), "signals")
    stops = sig.where("signal = 'S' and conviction < 30").select("ticker", "date")
    # signals meet their stops while they are narrow; all else follows from the row and its ticker
    d = chained(spark, sf, asof_backward(sig, stops, "ticker", "date", {}, keep_date="stop"), "stop")
    year = F.year("date")
    d = d.withColumns({"in_cooldown": F.coalesce(F.datediff("date", "stop") <= 28, F.lit(False)), "vol_scale": F.when(F.col("okey") % 5 == 0, 0.7).otherwise(1.2), "breaker": F.when(year == 1994, 0.5).otherwise(1.0), "new_allowed": year != 1996})
    return sz.with_suggested_size(d).select("ticker", "date", "action", "suggested_usd", "size_pct")


# --- votes and rule tables

VOTE_ROWS = """v AS (SELECT *, okey % 31 = 0 AS fs, okey % 37 = 0 AS ts, (okey % 101 - 50)::DOUBLE AS cd, CASE sentiment WHEN 'NET_BUYING' THEN 'BULLISH' WHEN 'NET_SELLING' THEN 'BEARISH' ELSE '' END AS sv, okey % 2 = 0 AS loud FROM reviews)"""


def voting(spark, sf):
    k = F.col("okey")
    return lens.reviews(spark, sf).withColumns({"fund_synthetic": k % 31 == 0, "tech_synthetic": k % 37 == 0, "census_div": (k % 101 - 50).cast("double"), "sentiment_volume": F.when(k % 2 == 0, "HIGH").otherwise("LOW"),
                                                "sentiment_view": F.when(F.col("sentiment") == "NET_BUYING", "BULLISH").when(F.col("sentiment") == "NET_SELLING", "BEARISH").otherwise("")})


@query("p45_agent_votes", ctes=("reviews",), sql=VOTE_ROWS + """,
w AS (SELECT *, 1.25::DOUBLE * CASE WHEN fs THEN 0.5 ELSE 1 END AS wf, 0.75::DOUBLE * CASE WHEN ts THEN 0.5 ELSE 1 END AS wt, 0.5 + 0.5::DOUBLE * CASE WHEN cd = 0 THEN 0.5 ELSE least(abs(cd) / 50, 1) END AS sp, 0.75::DOUBLE * CASE WHEN loud THEN 1 ELSE 0.5 END AS ws,
  CASE WHEN buy_pct >= 90 AND fund_score >= 70 THEN 0.6 WHEN signal = 'S' THEN 2 ELSE 1.2 END::DOUBLE AS wr, CASE WHEN buy_pct >= 75 AND signal = 'B' THEN (buy_pct - 75) / 25 * 1.2::DOUBLE ELSE 0 END AS up, CASE WHEN buy_pct <= 25 AND signal = 'S' THEN (25 - buy_pct) / 25 * 1.2::DOUBLE ELSE 0 END AS dn FROM v),
p AS (SELECT *, CASE WHEN fund_score >= 70 THEN 1 WHEN fund_score < 45 THEN 0 END::DOUBLE AS lf,
  CASE WHEN tech_signal = 'ENTER_NOW' THEN 1 WHEN tech_signal IN ('AVOID', 'EXIT_SOON') THEN CASE WHEN rsi < 30 THEN NULL WHEN rsi < 40 THEN 0.4 ELSE 0 END WHEN tech_signal = 'WAIT_FOR_PULLBACK' THEN 0.6
    WHEN abs(tech_momentum) > 20 AND regime = 'RISK_OFF' THEN NULL WHEN tech_momentum > 20 THEN 0.7 WHEN tech_momentum < -20 THEN 0.3 END::DOUBLE AS lt,
  CASE macro_fit WHEN 'FAVORABLE' THEN 1 WHEN 'UNFAVORABLE' THEN 0 END::DOUBLE AS lm, CASE census_view WHEN 'ALIGNED' THEN 1 WHEN 'DIVERGENT' THEN 0.41 WHEN 'CENSUS_DIV' THEN 0.71 END::DOUBLE AS lc, CASE sv WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN 0 END::DOUBLE AS ls FROM w),
q AS (SELECT *, CASE WHEN lc IS NULL THEN 0.85::DOUBLE ELSE 1.25::DOUBLE END * sp AS wc,
  CASE news_impact WHEN 'HIGH_POSITIVE' THEN 0.85 WHEN 'LOW_POSITIVE' THEN 0.65 WHEN 'HIGH_NEGATIVE' THEN 0 WHEN 'LOW_NEGATIVE' THEN 0.25 ELSE 0.5 END::DOUBLE AS nb, CASE news_impact WHEN 'HIGH_POSITIVE' THEN 0.15 WHEN 'LOW_POSITIVE' THEN 0.35 WHEN 'HIGH_NEGATIVE' THEN 1.3 WHEN 'LOW_NEGATIVE' THEN 0.75 ELSE 0.5 END::DOUBLE AS nr,
  CASE WHEN risk_warning THEN 0 WHEN regime = 'RISK_ON' THEN 0.6 WHEN regime = 'RISK_OFF' THEN 0.4 ELSE 0.5 END::DOUBLE AS rb, CASE WHEN risk_warning THEN wr WHEN regime = 'RISK_ON' THEN 0.4 WHEN regime = 'RISK_OFF' THEN 0.6 ELSE 0.5 END::DOUBLE AS rr FROM p),
s AS (SELECT *, coalesce(lf, 0.5) * wf + coalesce(lt, 0.5) * wt + coalesce(lm, 0.5) * 0.75 + coalesce(lc, 0.5) * wc + nb + coalesce(ls, 0.5) * ws + rb + up AS bull,
  (1 - coalesce(lf, 0.5)) * wf + (1 - coalesce(lt, 0.5)) * wt + (1 - coalesce(lm, 0.5)) * 0.75 + (1 - coalesce(lc, 0.5)) * wc + nr + (1 - coalesce(ls, 0.5)) * ws + rr + dn AS bear,
  CASE WHEN lf IS NULL THEN 0 ELSE wf END + CASE WHEN lt IS NULL THEN 0 ELSE wt END + CASE WHEN lm IS NULL THEN 0 ELSE 0.75 END + CASE WHEN lc IS NULL THEN 0 ELSE wc END + CASE news_impact WHEN 'HIGH_NEGATIVE' THEN 1.3 WHEN 'NEUTRAL' THEN 0 ELSE 1 END + CASE WHEN ls IS NULL THEN 0 ELSE ws END + CASE WHEN risk_warning THEN wr ELSE 0 END + up + dn AS dir,
  CASE WHEN lf IS NULL THEN wf ELSE 0 END + CASE WHEN lt IS NULL THEN wt ELSE 0 END + CASE WHEN lm IS NULL THEN 0.75 ELSE 0 END + CASE WHEN lc IS NULL THEN wc ELSE 0 END + CASE news_impact WHEN 'NEUTRAL' THEN 1 ELSE 0 END + CASE WHEN ls IS NULL THEN ws ELSE 0 END + CASE WHEN risk_warning THEN 0 ELSE 1 END AS neu FROM q)
SELECT ticker, date, round(bull, 6) AS bull, round(bear, 6) AS bear, round(dir / (dir + neu), 6) AS directional FROM s""")
def p45(spark, sf):
    return vt.with_votes(voting(spark, sf)).select("ticker", "date", r6("bull"), r6("bear"), r6("directional"))


@query("p51_p52_rule_tables", ctes=("reviews", "dims"), sql="""
r AS (SELECT reviews.*, d.sector, lag(signal) OVER w AS prev, date - lag(date) OVER w AS days, CASE WHEN okey % 8 <> 0 THEN (okey % 41 - 20)::DOUBLE END AS spct, okey % 4 AS beats, CASE okey % 3 WHEN 0 THEN 'ACCELERATING' WHEN 1 THEN 'DECELERATING' END AS trend,
  okey % 30 AS age, okey % 12 / 2.0 AS cur, okey % 5 AS lim, okey % 6 AS held FROM reviews JOIN dims d ON d.ticker = reviews.ticker WINDOW w AS (PARTITION BY reviews.ticker ORDER BY date)),
x AS (SELECT *, CASE signal WHEN 'S' THEN 0 WHEN 'H' THEN 2 WHEN 'B' THEN 3 ELSE 1 END - CASE prev WHEN 'S' THEN 0 WHEN 'H' THEN 2 WHEN 'B' THEN 3 ELSE 1 END AS d,
  CASE WHEN spct IS NULL THEN 'NO_DATA' WHEN spct > 10 AND beats >= 2 THEN 'SERIAL_BEATER' WHEN spct > 5 THEN 'BEAT' WHEN spct < -10 THEN 'BIG_MISS' WHEN spct < -5 THEN 'MISS' ELSE 'IN_LINE' END AS sl,
  (fund_score >= 70)::INT + (tech_signal = 'ENTER_NOW')::INT + (macro_fit = 'FAVORABLE')::INT + (census_view = 'ALIGNED')::INT AS conf, CASE regime WHEN 'RISK_OFF' THEN 0.5 WHEN 'CAUTIOUS' THEN 0.7 ELSE 1 END::DOUBLE AS sc FROM r),
y AS (SELECT *, CASE sl WHEN 'SERIAL_BEATER' THEN 10 WHEN 'BEAT' THEN 3 WHEN 'BIG_MISS' THEN -5 WHEN 'MISS' THEN -3 ELSE 0 END AS sp, greatest(0, least(75, conviction - CASE conf WHEN 0 THEN floor(sc * 15) WHEN 1 THEN floor(sc * 10) ELSE 0 END + CASE WHEN held = 0 THEN 10 ELSE 0 END))::BIGINT AS gated FROM x)
SELECT ticker, date, (CASE WHEN macro_fit = 'UNFAVORABLE' AND tech_signal = 'ENTER_NOW' THEN 5 ELSE 0 END + CASE WHEN fund_score >= 70 AND risk_warning AND buy_pct < 90 THEN 3 ELSE 0 END + CASE WHEN census_view = 'DIVERGENT' AND news_impact LIKE '%POSITIVE%' THEN 3 ELSE 0 END
    + CASE WHEN macro_fit = 'UNFAVORABLE' AND news_impact = 'HIGH_POSITIVE' THEN 2 ELSE 0 END)::INTEGER AS contradiction,
  CASE WHEN prev IS NULL THEN 'NO_HISTORY' WHEN d > 0 AND days <= 14 THEN 'ACCELERATING' WHEN d > 0 AND days <= 30 THEN 'IMPROVING' WHEN d < 0 AND days <= 14 THEN 'DETERIORATING' WHEN d < 0 AND days <= 30 THEN 'WEAKENING' WHEN d = 0 AND days > 90 THEN 'STALE' ELSE 'STABLE' END AS velocity,
  CASE WHEN spct IS NOT NULL AND trend = 'ACCELERATING' AND beats >= 2 THEN least(sp + 2, 10) WHEN trend = 'DECELERATING' AND sl IN ('SERIAL_BEATER', 'BEAT') THEN greatest(sp - 2, 0) ELSE sp END::INTEGER AS surprise_points,
  sl || CASE WHEN spct IS NOT NULL AND trend = 'ACCELERATING' AND beats >= 2 THEN '_ACCEL' WHEN trend = 'DECELERATING' AND sl IN ('SERIAL_BEATER', 'BEAT') THEN '_DECEL' ELSE '' END AS surprise,
  CASE WHEN age <= 1 THEN 1 WHEN age <= 4 THEN 0.95 WHEN age <= 12 THEN 0.85 WHEN age <= 24 THEN 0.75 ELSE 0.6 END::DOUBLE AS freshness,
  CASE WHEN cur <= 0 THEN 0 WHEN lim <= 0 THEN 20 WHEN cur / lim <= 1 THEN 0 WHEN cur / lim < 1.25 THEN 5 WHEN cur / lim < 1.5 THEN 10 WHEN cur / lim < 2 THEN 15 ELSE 25 END::INTEGER AS overweight, coalesce(cur > 0 AND (lim <= 0 OR cur / lim >= 1.5), false) AS force_trim,
  conf::INTEGER AS confirmations, gated, CASE WHEN gated >= 50 THEN 'BUY' ELSE 'HOLD' END AS gate_action FROM y""")
def p51(spark, sf):
    """Contradictions, velocity, surprise, freshness, overweight and the opportunity gate of every review."""
    from tidemark.operators.timeseries import by_bar
    k = F.col("okey")
    r = lens.reviews(spark, sf).withColumns({"prev": F.lag("signal").over(by_bar()), "days": F.datediff("date", F.lag("date").over(by_bar())), "sector_positions": k % 6})
    pct, trend = F.when(k % 8 != 0, (k % 41 - 20).cast("double")), F.when(k % 3 == 0, "ACCELERATING").when(k % 3 == 1, "DECELERATING")
    d = vt.with_opportunity_gate(r).withColumns({"c": vt.contradictions(), "v": vt.velocity(F.col("signal"), F.col("prev"), F.col("days")), "s": vt.surprise(pct, k % 4, trend), "o": vt.overweight(k % 12 / 2.0, (k % 5).cast("double"))})
    return d.select("ticker", "date", F.col("c.points").alias("contradiction"), F.col("v.label").alias("velocity"), F.col("s.points").alias("surprise_points"), F.col("s.label").alias("surprise"), vt.freshness(k % 30).alias("freshness"),
                    F.col("o.penalty").alias("overweight"), F.col("o.force_trim").alias("force_trim"), "confirmations", "gated", "gate_action")


THEME = "CASE k % 9 WHEN 0 THEN 'Defense' WHEN 1 THEN 'Energy' WHEN 2 THEN 'Gold' ELSE 'Other' END"


@query("p55_p56_opportunity_scores", ctes=("universe",), sql=CASCADE_SQL + f""",
o AS (SELECT *, {THEME} AS theme, (k * 7 % 60)::DOUBLE AS pis, CASE signal WHEN 'B' THEN CASE WHEN upside > 25 THEN 90 WHEN upside >= 15 THEN 75 ELSE 60 END WHEN 'S' THEN 10 ELSE 40 END AS ss FROM cas),
q AS (SELECT *, CASE WHEN pis >= 50 THEN 90 WHEN pis >= 30 THEN 70 WHEN pis >= 15 THEN 50 WHEN pis >= 5 THEN 25 ELSE 10 END AS cs FROM o)
SELECT ticker, (ss - cs)::INTEGER AS divergence, CASE WHEN ss - cs > 40 THEN 'STRONG_SIGNAL_DIVERGENCE' WHEN ss - cs > 20 THEN 'MODERATE_SIGNAL_DIVERGENCE' WHEN ss - cs < -40 THEN 'STRONG_CENSUS_DIVERGENCE' WHEN ss - cs < -20 THEN 'MODERATE_CENSUS_DIVERGENCE' ELSE 'ALIGNED' END AS reading,
  least(100, CASE WHEN signal = 'B' AND buy_pct >= 60 AND upside >= 15 AND analysts >= 5 THEN 20 ELSE 0 END + CASE WHEN pef > 0 AND pef < 25 AND roe > 12 AND de < 100 THEN 15 ELSE 0 END + CASE WHEN theme <> 'Other' THEN 30 ELSE 0 END
    + CASE WHEN w52 < 70 AND upside > 25 AND roe > 15 AND signal = 'B' THEN 25 ELSE 0 END + CASE WHEN upside > 30 THEN 5 ELSE 0 END + CASE theme WHEN 'Defense' THEN 10 WHEN 'Energy' THEN 8 WHEN 'Gold' THEN 5 ELSE 0 END)::INTEGER AS criteria_score,
  round(least(100, upside / 50 * 100) * 0.25::DOUBLE + buy_pct * 0.15::DOUBLE + greatest(0, least(100, (50 - CASE WHEN coalesce(pef, 50) = 0 THEN 50 ELSE coalesce(pef, 50) END) * 2)) * 0.2::DOUBLE
    + least(100, 50 + CASE WHEN coalesce(w52 >= 99, false) THEN 30 ELSE 0 END + CASE WHEN CASE WHEN coalesce(beta, 1) = 0 THEN 1 ELSE coalesce(beta, 1) END BETWEEN 0.8 AND 1.2 THEN 20 ELSE 0 END) * 0.1::DOUBLE + least(100, pis * 5) * 0.2::DOUBLE, 6) AS priority FROM q""")
def p55(spark, sf):
    """Signal against holders, and both opportunity scores."""
    c = F.col
    d = classified(spark, sf).withColumn("theme", F.expr(THEME)).withColumn("pis", (c("k") * 7 % 60).cast("double"))
    gap = vt.signal_strength(c("signal"), c("upside")) - vt.census_strength(c("pis"))
    score = vt.criteria_score(c("signal"), c("buy_pct"), c("upside"), c("analysts"), c("pef"), c("roe"), c("de"), c("w52"), c("theme"))
    return d.select("ticker", gap.alias("divergence"), vt.divergence(gap).alias("reading"), score.alias("criteria_score"), r6(vt.priority_score(c("upside"), c("buy_pct"), c("pef"), c("beta"), c("w52") >= 99, c("pis")), "priority"))


# --- selections

KINDS = ["RegulatoryAction", "Earnings", "Insider", "ProductRegul", "Debt"]


@query("f08_event_risk_filter", ctes=("universe",), sql="""
w AS (SELECT ticker, list_filter([CASE WHEN k % 17 = 0 THEN 'RegulatoryAction' END, CASE WHEN k % 5 = 0 THEN 'Earnings' END, CASE WHEN k % 7 = 0 THEN 'Insider' END, CASE WHEN k % 29 = 0 THEN 'ProductRegul' END, CASE WHEN k % 11 = 0 THEN 'Debt' END], lambda x: x IS NOT NULL) AS ws FROM universe)
SELECT ticker, len(ws)::INTEGER AS warnings, len(list_filter(ws, lambda x: lower(x) LIKE '%regul%' OR lower(x) LIKE '%debt%')) > 0 AS blocked FROM w""")
def f08(spark, sf):
    """Names stopped by warnings of some kinds (which names have which is a stand-in by key)."""
    ws = F.filter(F.array(*[F.when(F.col("k") % m == 0, k) for k, m in zip(KINDS, (17, 5, 7, 29, 11))]), lambda x: x.isNotNull())
    return lens.universe(spark, sf).select("ticker", F.size(ws).alias("warnings"), vt.event_risk(ws, ["Regul", "DEBT"]).alias("blocked"))


@query("f19_followup_selection", ctes=("priced",), sql="SELECT ticker, date, signal, logged_price AS price FROM priced WHERE date < DATE '2001-08-01' - 7 AND logged_price IS NOT NULL AND logged_price <> 0")
def f19(spark, sf):
    """Signals older than a week that have a price."""
    d = lens.priced(lens.signals(spark, sf), lens.prices(spark, sf))
    return d.where("date < date_sub(DATE '2001-08-01', 7) and logged_price <> 0").select("ticker", "date", "signal", F.col("logged_price").alias("price"))


@query("k04_top_worst_performers", ctes=("prices",), sql="""
g AS (SELECT ticker, (max_by(close, date) / min_by(close, date) - 1) * 100 AS gain FROM prices GROUP BY 1)
SELECT 'top' AS side, ticker, round(gain, 6) AS gain FROM (SELECT * FROM g ORDER BY gain DESC, ticker LIMIT 5) UNION ALL SELECT 'worst', ticker, round(gain, 6) FROM (SELECT * FROM g ORDER BY gain, ticker LIMIT 5)""")
def k04(spark, sf):
    g = lens.prices(spark, sf).groupBy("ticker").agg(((F.max_by("close", "date") / F.min_by("close", "date") - 1) * 100).alias("gain"))
    return vt.extremes(g, "gain", "ticker").select("side", "ticker", r6("gain"))
