"""Joins of state, set operations, holder census and portfolio risk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import books as bk
from tidemark.operators import cascade as ca
from tidemark.operators import outcomes as oc
from tidemark.operators.ranks import _safe_join, value_counts
from tidemark.plans.outcome_queries import rnd
from tidemark.plans.timeseries_queries import r6
from tidemark.plans.universe_queries import CASCADE_SQL, classified
from tidemark.plans.validation_queries import PF_SQL, monthly_returns, price_factor_panel
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources import lens

# Urgency of a change of label, and its order.
URGENCY = {"BS": "CRITICAL", "BH": "HIGH", "HS": "MEDIUM", "SB": "OPPORTUNITY", "HB": "OPPORTUNITY", "SH": "LOW", "IB": "OPPORTUNITY", "IS": "MEDIUM", "BI": "HIGH", "SI": "LOW", "HI": "LOW"}
URGENCY_ORDER = {"CRITICAL": 0, "HIGH": 1, "OPPORTUNITY": 2, "MEDIUM": 3, "LOW": 4, "INFO": 5}
CHG_SQL = "c AS (SELECT * FROM daily_log WHERE date = DATE '2024-01-20'), p AS (SELECT * FROM daily_log WHERE date = DATE '2024-01-10'), ch AS (SELECT coalesce(c.ticker, p.ticker) AS ticker, p.signal AS previous_signal, c.signal AS current_signal, CASE WHEN p.ticker IS NULL THEN 'NEW' WHEN c.ticker IS NULL THEN 'REMOVED' ELSE 'TRANSITION' END AS change_type, CASE p.signal || c.signal " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in URGENCY.items()) + " ELSE 'INFO' END AS urgency, round((c.value - p.value) / nullif(p.value, 0) * 100, 6) AS change_pct FROM c FULL JOIN p ON c.ticker = p.ticker WHERE c.ticker IS NULL OR p.ticker IS NULL OR c.signal <> p.signal)"


def signal_changes(cur, prev):
    """Full outer join of two days' labels."""
    a = cur.select("ticker", F.col("signal").alias("current_signal"), F.col("value").alias("v1"))
    b = prev.select("ticker", F.col("signal").alias("previous_signal"), F.col("value").alias("v0"))
    j = a.join(b, "ticker", "full_outer").where("current_signal is null or previous_signal is null or current_signal <> previous_signal")
    t = F.when(F.col("previous_signal").isNull(), "NEW").when(F.col("current_signal").isNull(), "REMOVED").otherwise("TRANSITION")
    u = oc.lookup(F.concat("previous_signal", "current_signal"), URGENCY, "INFO")
    return j.select("ticker", "previous_signal", "current_signal", t.alias("change_type"), u.alias("urgency"), (F.try_divide(F.col("v1") - F.col("v0"), "v0") * 100).alias("change_pct"))


def _chg(spark, sf):
    d = lens.daily_log(spark, sf)
    return signal_changes(d.where("date = DATE '2024-01-20'"), d.where("date = DATE '2024-01-10'"))


@query("j03_k08_signal_changes", ctes=("daily_log",), sql=CHG_SQL + " SELECT * FROM ch")
def j03(spark, sf):
    return rnd(_chg(spark, sf).orderBy(oc.lookup(F.col("urgency"), URGENCY_ORDER, 99), "ticker"))


@query("g24_change_summary", ctes=("daily_log",), sql=CHG_SQL + " SELECT urgency, count(*) AS n, urgency IN ('CRITICAL','HIGH') AS critical, urgency = 'OPPORTUNITY' AS opportunity FROM ch GROUP BY 1")
def g24(spark, sf):
    return _chg(spark, sf).groupBy("urgency").agg(F.count("*").alias("n")).select("urgency", "n", F.col("urgency").isin("CRITICAL", "HIGH").alias("critical"), (F.col("urgency") == "OPPORTUNITY").alias("opportunity"))


SPEND = "h AS (SELECT ticker, month, sum(spend) AS s FROM holders GROUP BY 1, 2), w AS (SELECT ticker, month, s * 100 / sum(s) OVER (PARTITION BY month) AS pct FROM h), c AS (SELECT ticker, pct FROM w WHERE month = DATE '2000-05-01'), t AS (SELECT ticker, pct FROM w WHERE month = DATE '2000-06-01')"


def month_weights(spark, sf, month):
    h = lens.holders(spark, sf).where(F.col("month") == F.lit(month).cast("date")).groupBy("ticker").agg(F.sum("spend").alias("s"))
    return h.join(F.broadcast(h.agg(F.sum("s").alias("t")))).select("ticker", (F.col("s") * 100 / F.col("t")).alias("pct"))  # one row


def recommend(target, current, eps=1e-6):
    """J04."""
    j = target.withColumnRenamed("pct", "t").join(current.withColumnRenamed("pct", "c"), "ticker", "full_outer").fillna(0.0, ["t", "c"])
    d, t, c = F.col("t") - F.col("c"), F.col("t"), F.col("c")
    a = F.when(d > eps, F.when(c <= eps, "BUY").otherwise("ADD")).when(d < -eps, F.when(t <= eps, "SELL").otherwise("TRIM")).otherwise("HOLD")
    return j.select("ticker", c.alias("current"), t.alias("target"), d.alias("delta"), a.alias("action"))


@query("j04_target_vs_current", ctes=("holders",), sql=SPEND + " SELECT coalesce(t.ticker, c.ticker) AS ticker, round(coalesce(c.pct, 0), 6) AS current, round(coalesce(t.pct, 0), 6) AS target, round(coalesce(t.pct, 0) - coalesce(c.pct, 0), 6) AS delta, CASE WHEN coalesce(t.pct, 0) - coalesce(c.pct, 0) > 1e-6 THEN CASE WHEN coalesce(c.pct, 0) <= 1e-6 THEN 'BUY' ELSE 'ADD' END WHEN coalesce(t.pct, 0) - coalesce(c.pct, 0) < -1e-6 THEN CASE WHEN coalesce(t.pct, 0) <= 1e-6 THEN 'SELL' ELSE 'TRIM' END ELSE 'HOLD' END AS action FROM t FULL JOIN c ON t.ticker = c.ticker")
def j04(spark, sf):
    return rnd(recommend(month_weights(spark, sf, "2000-06-01"), month_weights(spark, sf, "2000-05-01")))


@query("j05_committee_change_report", ctes=("reviews",), sql="""
r AS (SELECT ticker, date, action, conviction, lag(action) OVER w AS pa, lag(conviction) OVER w AS pc FROM reviews WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date, action, pa AS previous_action, conviction - pc AS delta, CASE WHEN pa IS NULL THEN 'NEW' WHEN conviction > pc THEN 'UPGRADE' WHEN conviction < pc THEN 'DOWNGRADE' ELSE 'CHANGED' END AS kind FROM r WHERE pa IS NULL OR action <> pa OR abs(conviction - pc) > 5""")
def j05(spark, sf):
    w = Window.partitionBy("ticker").orderBy("date")
    r = lens.reviews(spark, sf).select("ticker", "date", "action", "conviction").withColumn("pa", F.lag("action").over(w)).withColumn("pc", F.lag("conviction").over(w))
    d = F.col("conviction") - F.col("pc")
    return r.where(F.col("pa").isNull() | (F.col("action") != F.col("pa")) | (F.abs(d) > 5)).select("ticker", "date", "action", F.col("pa").alias("previous_action"), d.alias("delta"), F.when(F.col("pa").isNull(), "NEW").when(d > 0, "UPGRADE").when(d < 0, "DOWNGRADE").otherwise("CHANGED").alias("kind"))


@query("j06_u04_position_reconciliation", ctes=("holders",), sql="""
a AS (SELECT DISTINCT investor, ticker FROM holders WHERE month = DATE '2000-06-01'), b AS (SELECT DISTINCT investor, ticker FROM holders WHERE month = DATE '2000-05-01')
SELECT coalesce(a.investor, b.investor) AS investor, coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN b.ticker IS NULL THEN 'new' WHEN a.ticker IS NULL THEN 'closed' ELSE 'matched' END AS state FROM a FULL JOIN b ON a.investor = b.investor AND a.ticker = b.ticker""")
def j06(spark, sf):
    h = lens.holders(spark, sf)
    a = h.where("month = DATE '2000-06-01'").select("investor", "ticker", F.lit(1).alias("a"))
    b = h.where("month = DATE '2000-05-01'").select("investor", "ticker", F.lit(1).alias("b"))
    return a.join(b, ["investor", "ticker"], "full_outer").select("investor", "ticker", F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "closed").otherwise("matched").alias("state"))


CANON = "regexp_replace(ticker, '\\.(L|DE|PA|ST|CO|HK|T)$', '')"


def canonical(c="ticker"):
    """One id per instrument, so equivalence is an equi join."""
    return F.regexp_replace(c, r"\.(L|DE|PA|ST|CO|HK|T)$", "")


@query("j07_j08_g36_opportunities_not_held", ctes=("universe", "portfolio", "no_trade"), sql=CASCADE_SQL + f" SELECT ticker, signal, {CANON} IN (SELECT {CANON} FROM portfolio) AS held_flag FROM cas WHERE signal IN ('B','S') AND {CANON} NOT IN (SELECT {CANON} FROM no_trade) AND ((signal = 'B' AND {CANON} NOT IN (SELECT {CANON} FROM portfolio)) OR (signal = 'S' AND {CANON} IN (SELECT {CANON} FROM portfolio)))")
def j07(spark, sf):
    c = classified(spark, sf).where(F.col("signal").isin("B", "S")).select("ticker", "signal", canonical().alias("cid"))
    c = c.join(lens.no_trade(spark, sf).select(canonical().alias("cid")).distinct(), "cid", "left_anti")
    p = lens.portfolio(spark, sf).select(canonical().alias("cid")).distinct()
    buys = c.where("signal = 'B'").join(p, "cid", "left_anti").withColumn("held_flag", F.lit(False))
    sells = c.where("signal = 'S'").join(p, "cid", "left_semi").withColumn("held_flag", F.lit(True))
    return buys.unionByName(sells).drop("cid")


@query("u01_s13_skip_list", ctes=("universe", "portfolio", "no_trade"), sql="SELECT ticker FROM ((SELECT ticker FROM universe EXCEPT SELECT ticker FROM universe WHERE targets >= 4) UNION (SELECT ticker FROM universe WHERE analysts < 3)) EXCEPT SELECT ticker FROM portfolio")
def u01(spark, sf):
    u = lens.universe(spark, sf)
    missing = u.select("ticker").subtract(u.where("targets >= 4").select("ticker"))
    return missing.union(u.where("analysts < 3").select("ticker")).distinct().join(lens.portfolio(spark, sf).select("ticker"), "ticker", "left_anti")


@query("u02_universe_delta", ctes=("daily_log",), sql="a AS (SELECT DISTINCT ticker FROM daily_log WHERE date = DATE '2024-01-20'), b AS (SELECT DISTINCT ticker FROM daily_log WHERE date = DATE '2024-01-19') SELECT ticker, 'new' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT ticker, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def u02(spark, sf):
    d = lens.daily_log(spark, sf)
    a, b = (d.where(f"date = DATE '2024-01-{x}'").select("ticker").distinct() for x in (20, 19))
    return a.subtract(b).withColumn("kind", F.lit("new")).unionByName(b.subtract(a).withColumn("kind", F.lit("removed")))


@query("u05_u06_priority_dedupe", ctes=("universe", "portfolio"), sql=CASCADE_SQL + " SELECT ticker, min(src) AS src FROM (SELECT c.ticker, 1 AS src FROM cas c JOIN portfolio p ON p.ticker = c.ticker WHERE c.signal = 'S' UNION ALL SELECT ticker, 2 FROM portfolio WHERE upside < 0) GROUP BY 1")
def u05(spark, sf):
    """Keep-first across sources as a minimum over the source order: an aggregate, not a sort."""
    p = lens.portfolio(spark, sf)
    m = classified(spark, sf).where("signal = 'S'").join(p.select("ticker"), "ticker", "left_semi").select("ticker", F.lit(1).alias("src"))
    return m.unionByName(p.where("upside < 0").select("ticker", F.lit(2).alias("src"))).groupBy("ticker").agg(F.min("src").alias("src"))


@query("g27_ticker_set", ctes=("universe", "portfolio", "no_trade"), sql="SELECT ticker FROM portfolio UNION SELECT ticker FROM no_trade UNION SELECT ticker FROM universe WHERE analysts >= 20")
def g27(spark, sf):
    return lens.portfolio(spark, sf).select("ticker").union(lens.no_trade(spark, sf)).union(lens.universe(spark, sf).where("analysts >= 20").select("ticker")).distinct()


@query("a16_a19_portfolio_exposure", ctes=("portfolio",), sql="SELECT CASE WHEN ticker LIKE '%.L' THEN 'GBP' WHEN ticker LIKE '%.HK' THEN 'HKD' WHEN ticker LIKE '%.DE' OR ticker LIKE '%.PA' THEN 'EUR' WHEN ticker LIKE '%.ST' THEN 'SEK' WHEN ticker LIKE '%.CO' THEN 'DKK' WHEN ticker LIKE '%.T' THEN 'JPY' ELSE 'USD' END AS currency, count(*) AS n, round(sum(pct), 6) AS weight FROM portfolio GROUP BY 1")
def a19(spark, sf):
    from tidemark.functions.parse import currency
    return lens.portfolio(spark, sf).groupBy(currency(F.col("ticker")).alias("currency")).agg(F.count("*").alias("n"), r6(F.sum("pct"), "weight"))


@query("a17_allocation_cube", ctes=("universe", "portfolio"), sql="SELECT p.sector, u.industry, round(sum(p.pct), 6) AS weight, count(*) AS n FROM portfolio p JOIN universe u ON u.ticker = p.ticker GROUP BY CUBE(p.sector, u.industry)")
def a17(spark, sf):
    j = lens.portfolio(spark, sf).join(lens.universe(spark, sf).select("ticker", "industry"), "ticker")
    return j.cube("sector", "industry").agg(r6(F.sum("pct"), "weight"), F.count("*").alias("n"))


@query("a18_positions_aggregate", ctes=("holders",), sql="SELECT investor, ticker, count(*) AS months, round(sum(spend), 2) AS spend, round(sum(spend * spend) / sum(spend), 4) AS weighted_size FROM holders GROUP BY 1, 2")
def a18(spark, sf):
    return lens.holders(spark, sf).groupBy("investor", "ticker").agg(F.count("*").alias("months"), F.round(F.sum("spend"), 2).alias("spend"), F.round(F.sum(F.col("spend") * F.col("spend")) / F.sum("spend"), 4).alias("weighted_size"))


INV = "inv AS (SELECT month AS date, count(DISTINCT investor) AS ic FROM holders GROUP BY 1), cp AS (SELECT c.date, c.ticker, c.holders, c.holders * 100.0 / ic AS pct FROM census c JOIN inv USING (date))"
WIN = "wi AS (SELECT * FROM inv WHERE date BETWEEN DATE '2000-01-01' AND DATE '2001-01-01'), wc AS (SELECT * FROM cp WHERE date BETWEEN DATE '2000-01-01' AND DATE '2001-01-01')"


def holder_pct(spark, sf):
    h = written(lens.holders(spark, sf).select("investor", "month", "ticker"), "holders")
    ic = h.select("month", "investor").distinct().groupBy("month").agg(F.count("*").alias("ic"))
    c = h.groupBy("month", "ticker").agg(F.count("*").alias("holders"))
    return c.join(F.broadcast(ic), "month").select(F.col("month").alias("date"), "ticker", "holders", (F.col("holders") * 100.0 / F.col("ic")).alias("pct"))  # ic: one row per month


@query("t17_holder_trends", ctes=("holders", "census"), sql=INV + ", " + WIN + """,
b AS (SELECT min(date) AS d0, max(date) AS d1 FROM wi), s7 AS (SELECT max(date) AS d7 FROM wi, b WHERE date <= d1 - 7),
g AS (SELECT ticker, count(*) AS n, max(holders) FILTER (date = d1) AS cur, max(holders) FILTER (date = d0) AS f, max(pct) FILTER (date = d1) AS cp, max(pct) FILTER (date = d0) AS fp, max(holders) FILTER (date = d7) AS h7 FROM wc, b, s7 GROUP BY 1),
x AS (SELECT ticker, cur, cur - coalesce(f, cur) AS d30, cur - h7 AS d7, CASE WHEN f > 0 THEN (cur - f) * 100.0 / f ELSE 0 END AS chg, cp - coalesce(fp, 0) AS pp FROM g WHERE n >= 2 AND cur IS NOT NULL)
SELECT ticker, cur AS current_holders, d30 AS delta_30d, d7 AS delta_7d, round(chg, 6) AS pct_change, CASE WHEN pp > 10 OR chg > 20 THEN 'strong_accumulation' WHEN pp > 3 OR chg > 5 THEN 'accumulation' WHEN pp < -10 OR chg < -20 THEN 'strong_distribution' WHEN pp < -3 OR chg < -5 THEN 'distribution' ELSE 'stable' END AS classification FROM x""")
def t17(spark, sf):
    return rnd(holder_trends(windowed(holder_pct(spark, sf))))


def windowed(cp, first="2000-01-01", last="2001-01-01"):
    """Snapshots of the look-back window."""
    return cp.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def holder_trends(cp):
    b = cp.agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    s7 = cp.join(F.broadcast(b)).where(F.col("date") <= F.date_sub("d1", 7)).agg(F.max("date").alias("d7"))
    d = cp.join(F.broadcast(b)).join(F.broadcast(s7))  # one row each
    at = lambda c, k: F.max(F.when(F.col("date") == F.col(k), F.col(c)))
    g = d.groupBy("ticker").agg(F.count("*").alias("n"), at("holders", "d1").alias("cur"), at("holders", "d0").alias("f"), at("pct", "d1").alias("cpct"), at("pct", "d0").alias("fp"), at("holders", "d7").alias("h7"))
    g = g.where("n >= 2 and cur is not null")
    chg = F.when(F.col("f") > 0, (F.col("cur") - F.col("f")) * 100.0 / F.col("f")).otherwise(0.0)
    pp = F.col("cpct") - F.coalesce("fp", F.lit(0.0))
    cl = F.when((pp > 10) | (chg > 20), "strong_accumulation").when((pp > 3) | (chg > 5), "accumulation").when((pp < -10) | (chg < -20), "strong_distribution").when((pp < -3) | (chg < -5), "distribution").otherwise("stable")
    return g.select("ticker", F.col("cur").alias("current_holders"), (F.col("cur") - F.coalesce("f", "cur")).alias("delta_30d"), (F.col("cur") - F.col("h7")).alias("delta_7d"), chg.alias("pct_change"), cl.alias("classification"))


@query("t18_holder_volatility_ema", ctes=("holders", "census"), sql=INV + """,
d AS (SELECT *, pct - lag(pct) OVER w AS diff, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM cp WINDOW w AS (PARTITION BY ticker ORDER BY date)),
l AS (SELECT ticker, list(pct ORDER BY date) AS ps FROM d WHERE rn <= 7 GROUP BY 1)
SELECT d.ticker, round(CASE WHEN max(n) >= 5 THEN stddev_pop(diff) ELSE 0 END, 6) AS volatility, round(max(list_reduce(ps, lambda a, p: 0.25 * p + 0.75 * a)), 6) AS ema FROM d JOIN l USING (ticker) WHERE rn <= 89 OR n < 90 GROUP BY 1""")
def t18(spark, sf):
    cp = holder_pct(spark, sf)
    w = Window.partitionBy("ticker").orderBy("date")
    wd = Window.partitionBy("ticker").orderBy(F.desc("date"))
    d = cp.select("ticker", "date", "pct", (F.col("pct") - F.lag("pct").over(w)).alias("diff"), F.row_number().over(wd).alias("rn"), F.count("*").over(Window.partitionBy("ticker")).alias("n"))
    last = F.array_sort(F.collect_list(F.when(F.col("rn") <= 7, F.struct("date", "pct"))))  # at most seven entries
    g = d.groupBy("ticker").agg(F.max("n").alias("n"), F.stddev_pop(F.when((F.col("rn") <= 89) | (F.col("n") < 90), F.col("diff"))).alias("sd"), last.alias("l"))
    ema = F.aggregate(F.slice("l", 2, 6), F.element_at("l", 1)["pct"], lambda a, x: x["pct"] * 0.25 + a * 0.75)
    return g.select("ticker", r6(F.when(F.col("n") >= 5, F.col("sd")).otherwise(0.0), "volatility"), r6(ema, "ema"))


@query("t19_fear_greed_trend", ctes=("market",), sql="""
f AS (SELECT date, cast(round(100 - vix) as bigint) AS fg FROM market), x AS (SELECT a.date, a.fg, s.fg AS f7, m.fg AS f30 FROM f a ASOF LEFT JOIN f s ON a.date - 7 >= s.date ASOF LEFT JOIN f m ON a.date - 30 >= m.date)
SELECT date, fg AS current, fg - f7 AS delta_7d, fg - f30 AS delta_30d, CASE WHEN coalesce(fg - f7, fg - f30) > 2 THEN 'rising' WHEN coalesce(fg - f7, fg - f30) < -2 THEN 'falling' WHEN coalesce(fg - f7, fg - f30) IS NULL THEN 'unknown' ELSE 'flat' END AS trend FROM x""")
def t19(spark, sf):
    """Latest value at least 7 / 30 days back: a range frame over day numbers of a calendar-long series."""
    d = lens.market(spark, sf).select("date", F.round(100 - F.col("vix")).cast("long").alias("fg"), F.datediff("date", F.lit("1970-01-01")).alias("n"), F.lit(0).alias("_m"))
    w = Window.partitionBy("_m").orderBy("n")
    back = lambda k: F.col("fg") - F.last("fg").over(w.rangeBetween(Window.unboundedPreceding, -k))
    d = d.select("date", "fg", back(7).alias("d7"), back(30).alias("d30"))
    r = F.coalesce("d7", "d30")
    return d.select("date", F.col("fg").alias("current"), F.col("d7").alias("delta_7d"), F.col("d30").alias("delta_30d"), F.when(r > 2, "rising").when(r < -2, "falling").when(r.isNull(), "unknown").otherwise("flat").alias("trend"))


@query("k05_top_accumulating", ctes=("holders", "census"), sql=INV + ", " + WIN + ", b AS (SELECT min(date) AS d0, max(date) AS d1 FROM wi), g AS (SELECT ticker, max(holders) FILTER (date = d1) AS cur, max(holders) FILTER (date = d0) AS f FROM wc, b GROUP BY 1), x AS (SELECT ticker, (cur - f) * 100.0 / f AS chg FROM g WHERE f > 0 AND cur IS NOT NULL) SELECT * FROM (SELECT ticker, round(chg, 6) AS pct_change, row_number() OVER (ORDER BY chg DESC, ticker) AS place FROM x WHERE chg > 0) WHERE place <= 10")
def k05(spark, sf):
    t = holder_trends(windowed(holder_pct(spark, sf))).where("pct_change > 0").select("ticker", "pct_change")
    top = t.orderBy(F.desc("pct_change"), "ticker").limit(10)
    return top.select("ticker", r6("pct_change"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("pct_change"), "ticker")).cast("long").alias("place"))  # ten rows


@query("a48_k06_hidden_gems", ctes=("holders",), sql="""
t AS (SELECT c_custkey AS investor FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100), n AS (SELECT count(*) AS nt FROM t), a AS (SELECT count(DISTINCT investor) AS na FROM holders),
p AS (SELECT ticker, investor, sum(spend) AS s FROM holders GROUP BY 1, 2)
SELECT p.ticker, count(t.investor) AS top_holders, count(*) AS all_holders, round((count(t.investor) * 1.0 / max(nt)) / (count(*) * 1.0 / max(na)), 6) AS ratio, round(avg(s) FILTER (t.investor IS NOT NULL), 2) AS mean_spend FROM p LEFT JOIN t ON t.investor = p.investor, n, a GROUP BY 1""")
def a48(spark, sf):
    """The hundred investors with the largest gain against everyone; the list is bounded by the report."""
    top = lens.table(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select(F.col("c_custkey").alias("investor"), F.lit(1).alias("is_top"))
    h = lens.holders(spark, sf)
    na = h.select("investor").distinct().agg(F.count("*").alias("na"))
    p = h.groupBy("ticker", "investor").agg(F.sum("spend").alias("s")).join(F.broadcast(top), "investor", "left")
    g = p.groupBy("ticker").agg(F.count("is_top").alias("top_holders"), F.count("*").alias("all_holders"), F.avg(F.when(F.col("is_top") == 1, F.col("s"))).alias("m")).join(F.broadcast(na))  # na: one row
    nt = F.broadcast(top.agg(F.count("*").alias("nt")))
    return g.join(nt).select("ticker", "top_holders", "all_holders", r6((F.col("top_holders") / F.col("nt")) / (F.col("all_holders") / F.col("na")), "ratio"), F.round("m", 2).alias("mean_spend"))


@query("a49_x05_consensus_book", ctes=("holders",), sql="""
g AS (SELECT c_custkey AS investor, ntile(10) OVER (ORDER BY c_acctbal DESC, c_custkey) AS dec FROM customer), w AS (SELECT investor, ticker, sum(spend) AS s FROM holders GROUP BY 1, 2), x AS (SELECT investor, ticker, s * 100 / sum(s) OVER (PARTITION BY investor) AS pct FROM w)
SELECT * FROM (SELECT cast(dec as bigint) AS decile, ticker, count(*) AS holders, round(sum(pct), 4) AS weight, row_number() OVER (PARTITION BY dec ORDER BY sum(pct) DESC, ticker) AS place FROM x JOIN g USING (investor) GROUP BY 1, 2, dec) WHERE place <= 20""")
def a49(spark, sf):
    """Deciles come from the position of each distinct gain (counts below), not from one global sort."""
    c = lens.table(spark, sf, "customer").select(F.col("c_custkey").alias("investor"), (-F.col("c_acctbal")).alias("neg"))
    vc = value_counts(c, [], "neg").select(F.col("neg").alias("v"), "below", "n")
    w1 = Window.partitionBy("neg").orderBy("investor")  # investors with one and the same gain
    pos = c.join(vc, F.col("neg") == F.col("v")).select("investor", "n", (F.col("below") + F.row_number().over(w1) - 1).alias("i"))
    big, size = F.col("n") % 10, F.floor(F.col("n") / 10)
    dec = F.when(F.col("i") < big * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(F.floor((F.col("i") - big) / size)) + 1
    h = lens.holders(spark, sf).groupBy("investor", "ticker").agg(F.sum("spend").alias("s"))
    t = h.groupBy("investor").agg(F.sum("s").alias("t"))
    x = h.join(t, "investor").join(pos.select("investor", dec.cast("long").alias("decile")), "investor")
    g = x.groupBy("decile", "ticker").agg(F.count("*").alias("holders"), F.sum(F.col("s") * 100 / F.col("t")).alias("wt"))
    place = F.row_number().over(Window.partitionBy("decile").orderBy(F.desc("wt"), "ticker"))
    return g.select("decile", "ticker", "holders", F.round("wt", 4).alias("weight"), place.cast("long").alias("place")).where("place <= 20")


BOOK_SQL = PF_SQL + """,
sel AS (SELECT month AS book, ticker FROM pf QUALIFY row_number() OVER (PARTITION BY month ORDER BY mom DESC, ticker) <= 20),
h AS (SELECT book, s.ticker, m.month, m.ret FROM sel s JOIN mret m ON m.ticker = s.ticker WHERE m.month <= book AND m.ret IS NOT NULL),
nm AS (SELECT book, count(DISTINCT ticker) AS n_names FROM h GROUP BY 1),
fm AS (SELECT book, month FROM h JOIN nm USING (book) GROUP BY book, month, n_names HAVING count(*) = n_names),
nd AS (SELECT book, count(*) AS n_dates FROM fm GROUP BY 1 HAVING count(*) >= 20),
cr AS (SELECT h.*, n_dates FROM h JOIN fm USING (book, month) JOIN nd USING (book))"""


def _books(spark, sf):
    """Candidates of every month and the monthly returns."""
    c = price_factor_panel(spark, sf, ("mom",)).select(F.col("month").alias("book"), "ticker", F.col("mom").alias("score"))
    return c, monthly_returns(spark, sf)


def _histories(spark, sf):
    """The twenty strongest names of every month with their returns so far."""
    c, r = _books(spark, sf)
    return bk.book_history(bk.top_names(c, "book").select("book", "ticker"), r, "book")


@query("t20_j20_correlation_edges", ctes=("prices", "mret"), sql=BOOK_SQL + """
SELECT a.book, a.ticker AS a, b.ticker AS b, round(corr(a.ret, b.ret), 6) AS corr, max(a.n_dates) AS n_dates FROM cr a JOIN cr b ON a.book = b.book AND a.month = b.month AND a.ticker < b.ticker
GROUP BY 1, 2, 3 HAVING abs(corr(a.ret, b.ret)) >= 0.3""")
def t20(spark, sf):
    return rnd(bk.correlation_edges(written(_histories(spark, sf), "histories"), "book", 0.3))


@query("t22_effective_positions", ctes=("prices", "mret"), sql=BOOK_SQL + """,
z AS (SELECT book, month, n_dates, (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w AS z FROM cr WINDOW w AS (PARTITION BY book, ticker)),
p AS (SELECT book, n_dates, month, sum(z) AS s, count(*) AS k FROM z GROUP BY 1, 2, 3), g AS (SELECT book, n_dates, max(k) AS n, sum(s * s) / count(*) AS t FROM p GROUP BY 1, 2)
SELECT book, n_dates, n, round(n * n / t, 6) AS effective, round(n / t, 6) AS ratio FROM g""")
def t22(spark, sf):
    return rnd(bk.effective_positions(_histories(spark, sf), "book"))


@query("t25_portfolio_var", ctes=("prices", "mret", "holders"), sql=BOOK_SQL + """,
w AS (SELECT ticker, sum(spend) AS w FROM holders GROUP BY 1),
p AS (SELECT book, n_dates, month, sum(ret * w) / sum(w) AS r FROM cr JOIN w USING (ticker) GROUP BY 1, 2, 3), q AS (SELECT book, quantile_cont(r, 0.05) AS q FROM p GROUP BY 1)
SELECT book, n_dates, round(stddev_samp(r) * 164.5, 6) AS var_95_pct, round(stddev_samp(r) * 232.6, 6) AS var_99_pct, round(abs(avg(r) FILTER (r <= q)) * 100, 6) AS cvar_95_pct FROM p JOIN q USING (book) GROUP BY 1, 2""")
def t25(spark, sf):
    w = lens.holders(spark, sf).groupBy("ticker").agg(F.sum("spend").alias("weight"))
    return rnd(bk.portfolio_var(_histories(spark, sf), w, "book"))


@query("c06_single_factor_risk", ctes=("prices", "mret", "holders", "bench"), sql=BOOK_SQL + """,
mb AS (SELECT month, close / lag(close) OVER (ORDER BY month) - 1 AS f FROM (SELECT cast(date_trunc('month', date) as date) AS month, max_by(close, date) AS close FROM bench GROUP BY 1)),
w AS (SELECT ticker, sum(spend) AS w FROM holders GROUP BY 1),
j AS (SELECT cr.*, f, w FROM cr JOIN mb USING (month) JOIN w USING (ticker) WHERE f IS NOT NULL),
nm2 AS (SELECT book, ticker, n_dates, w, var_samp(f) AS vf, covar_samp(ret, f) AS c, var_samp(ret) AS v FROM j GROUP BY ALL),
md AS (SELECT book, n_dates, count(*) AS n_names, sum(w * c / vf) / sum(w) AS beta, max(vf) AS vf, sum(w * w * greatest(0, v - c * c / vf)) / (sum(w) * sum(w)) AS idio FROM nm2 GROUP BY 1, 2),
sr AS (SELECT book, var_samp(r) AS s FROM (SELECT book, month, sum(ret * w) / sum(w) AS r FROM j GROUP BY 1, 2) GROUP BY 1)
SELECT book, n_dates, n_names, round(beta, 6) AS beta, round(sqrt(12 * (beta * beta * vf + idio)), 6) AS factor_vol, round(sqrt(12 * s), 6) AS sample_vol, round(sqrt(12 * (0.8::DOUBLE * s + 0.2::DOUBLE * (beta * beta * vf + idio))), 6) AS shrunk_vol FROM md JOIN sr USING (book)""")
def c06(spark, sf):
    """Books weighted by their holders' spend, under the benchmark's monthly return."""
    w = lens.holders(spark, sf).groupBy("ticker").agg(F.sum("spend").alias("weight"))
    m = lens.monthly(lens.bench(spark, sf).withColumn("ticker", F.lit(0)))
    f = m.select("month", (F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("month")) - 1).alias("f")).where("f is not null")  # one row per month
    return rnd(bk.single_factor_risk(_histories(spark, sf), f, "book", w))


@query("t24_g10_drawdown_alerts", ctes=("universe",), sql="""
d AS (SELECT ticker, (100 - w52) / 100 AS dd, CASE WHEN cap_value >= 500e9 THEN 0.15 WHEN cap_value >= 100e9 THEN 0.20 WHEN cap_value >= 10e9 THEN 0.25 WHEN cap_value >= 2e9 THEN 0.30 ELSE 0.35 END::double AS vol FROM universe WHERE w52 < 100)
SELECT ticker, round(dd * 100, 1) AS drawdown_pct, CASE WHEN dd > 2 * vol THEN 'CRITICAL' WHEN dd > 1.5::double * vol THEN 'WARNING' ELSE 'WATCH' END AS severity FROM d WHERE dd > vol""")
def t24(spark, sf):
    vol = oc.lookup(ca.tier_of(F.col("cap_value")), {"mega": 0.15, "large": 0.20, "mid": 0.25, "small": 0.30, "micro": 0.35})  # fixed values
    d = lens.universe(spark, sf).select("ticker", ((100 - F.col("w52")) / 100).alias("dd"), vol.alias("vol")).where("dd > 0 and dd > vol")
    return d.select("ticker", F.round(F.col("dd") * 100, 1).alias("drawdown_pct"), F.when(F.col("dd") > 2 * F.col("vol"), "CRITICAL").when(F.col("dd") > 1.5 * F.col("vol"), "WARNING").otherwise("WATCH").alias("severity"))


@query("p30_trailing_stop", ctes=("prices", "dims"), sql="""
h AS (SELECT ticker, date, close, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS hi FROM prices)
SELECT ticker, date, round((hi - close) / hi * 100, 6) AS drawdown, (hi - close) / hi * 100 >= CASE tier WHEN 'mega' THEN 25 WHEN 'large' THEN 22 WHEN 'micro' THEN 15 ELSE 20 END AS triggered FROM h JOIN dims USING (ticker)""")
def p30(spark, sf):
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = lens.prices(spark, sf).select("ticker", "date", "close", F.max("close").over(w).alias("hi")).join(lens.dims(spark, sf).select("ticker", "tier"), "ticker")
    dd = (F.col("hi") - F.col("close")) / F.col("hi") * 100
    return d.select("ticker", "date", r6(dd, "drawdown"), (dd >= oc.lookup(F.col("tier"), {"mega": 25.0, "large": 22.0, "micro": 15.0}, 20.0)).alias("triggered"))


@query("c05_c07_c08_risk_parity_books")
def c07(spark, sf):
    c, r = _books(spark, sf)
    return rnd(bk.risk_parity_books(c, r, "book"))


@query("t21_t23_clusters_per_book")
def t21(spark, sf):
    """Edges among the twenty names of each book, then its clusters and their exposure."""
    e = bk.correlation_edges(_histories(spark, sf), "book", 0.25)
    cl = bk.greedy_clusters(e, "book")
    pct = F.col("size") * 100.0 / 20  # equal weights in a book of twenty
    return cl.select("book", "cluster", "members", "size", pct.alias("weight_pct"), F.when(pct >= 35, "HARD").when(pct >= 30, "SOFT").alias("alert"))


@query("c09_c10_book_sizing", ctes=("portfolio", "universe"), sql=CASCADE_SQL + """,
x AS (SELECT c.ticker, c.sector, c.signal, coalesce(p.pct, 0) / 100 AS cur, CASE WHEN c.signal = 'B' AND p.pct IS NULL THEN 'BUY' WHEN c.signal = 'B' THEN 'ADD' WHEN c.signal = 'S' THEN 'SELL' ELSE 'HOLD' END AS action, c.buy_score FROM cas c LEFT JOIN portfolio p ON p.ticker = c.ticker WHERE p.ticker IS NOT NULL OR c.signal = 'B'),
gg AS (SELECT greatest(0, 1 - sum(CASE WHEN action IN ('ADD','HOLD') THEN cur ELSE 0 END)) AS room FROM x),
f AS (SELECT x.*, row_number() OVER (PARTITION BY action IN ('BUY','ADD') ORDER BY buy_score DESC, ticker) AS rk, least(0.3::double, room) AS budget FROM x, gg),
y AS (SELECT *, action IN ('BUY','ADD') AND rk <= greatest(1, cast(floor(budget / 0.01::double + 1e-9) as bigint)) AND budget > 0 AS funded FROM f),
z AS (SELECT *, CASE WHEN funded THEN budget / sum(funded::int) OVER () ELSE 0 END AS raw FROM y),
t AS (SELECT *, CASE action WHEN 'BUY' THEN least(raw, 0.08::double) WHEN 'ADD' THEN cur + least(raw, greatest(0, 0.08::double - cur)) WHEN 'HOLD' THEN cur ELSE 0 END AS tgt FROM z),
s AS (SELECT *, sum(CASE WHEN action NOT IN ('BUY','ADD') THEN tgt ELSE 0 END) OVER (PARTITION BY sector) AS held_s, sum(CASE WHEN action = 'BUY' THEN tgt WHEN action = 'ADD' THEN tgt - cur ELSE 0 END) OVER (PARTITION BY sector) AS add_s FROM t)
SELECT ticker, action, round(cur, 6) AS current_pct, round(CASE WHEN action IN ('BUY','ADD') AND held_s + add_s > 0.25::double + 1e-12 AND add_s > 0 THEN CASE WHEN action = 'BUY' THEN tgt * greatest(0, 0.25::double - held_s) / add_s ELSE cur + (tgt - cur) * greatest(0, 0.25::double - held_s) / add_s END ELSE tgt END, 6) AS target_pct FROM s""")
def c09(spark, sf):
    """Committed gross and budget are one aggregate row; sector scaling is an aggregate joined back."""
    p = lens.portfolio(spark, sf).select("ticker", (F.col("pct") / 100).alias("cur"))
    c = classified(spark, sf).select("ticker", "sector", "signal", "buy_score").join(p, "ticker", "left").where("cur is not null or signal = 'B'")
    act = F.when((F.col("signal") == "B") & F.col("cur").isNull(), "BUY").when(F.col("signal") == "B", "ADD").when(F.col("signal") == "S", "SELL").otherwise("HOLD")
    x = written(c.select("ticker", "sector", "buy_score", act.alias("action"), F.coalesce("cur", F.lit(0.0)).alias("cur")), "book")
    return rnd(size_book(x).select("ticker", "action", F.col("cur").alias("current_pct"), F.col("target").alias("target_pct")))


def size_book(x, budget=0.3, name_cap=0.08, sector_cap=0.25, min_position=0.01):
    deploy = F.col("action").isin("BUY", "ADD")
    g = x.agg(F.greatest(F.lit(0.0), 1 - F.sum(F.when(F.col("action").isin("ADD", "HOLD"), F.col("cur")).otherwise(0.0))).alias("room")).select(F.least(F.lit(budget), "room").alias("budget"))
    n_max = max(1, int(budget / min_position + 1e-9))  # most names any budget can fund
    top = x.where(deploy).orderBy(F.desc("buy_score"), "ticker").limit(n_max)
    w = Window.partitionBy(F.lit(0))  # at most budget / min_position rows
    top = top.join(F.broadcast(g)).withColumn("rk", F.row_number().over(w.orderBy(F.desc("buy_score"), "ticker")))
    top = top.where((F.col("budget") > 0) & (F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("budget") / min_position + 1e-9))))
    top = top.select("ticker", (F.col("budget") / F.count("*").over(w)).alias("raw"))
    t = x.join(F.broadcast(top), "ticker", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    a, cur = F.col("action"), F.col("cur")
    tgt = F.when(a == "BUY", F.least("raw", F.lit(name_cap))).when(a == "ADD", cur + F.least("raw", F.greatest(F.lit(0.0), name_cap - cur))).when(a == "HOLD", cur).otherwise(0.0)
    t = t.withColumn("tgt", tgt)
    s = t.groupBy("sector").agg(F.sum(F.when(~deploy, F.col("tgt")).otherwise(0.0)).alias("held_s"), F.sum(F.when(a == "BUY", F.col("tgt")).when(a == "ADD", F.col("tgt") - cur).otherwise(0.0)).alias("add_s"))
    t = _safe_join(t, s, ["sector"])
    k = F.greatest(F.lit(0.0), sector_cap - F.col("held_s")) / F.col("add_s")
    over = deploy & (F.col("held_s") + F.col("add_s") > sector_cap + 1e-12) & (F.col("add_s") > 0)
    return t.withColumn("target", F.when(over & (a == "BUY"), F.col("tgt") * k).when(over, cur + (F.col("tgt") - cur) * k).otherwise(F.col("tgt")))
