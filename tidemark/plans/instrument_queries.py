"""Row rules and reports on instruments: P12, P15, P16, P23, P25, P31, P38-P40, P57, P58, A40, A41, V21, X11, J18."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import instrument as ins
from tidemark.functions import tails
from tidemark.operators import outcomes as oc
from tidemark.operators import timeseries as ts
from tidemark.operators import validate as va
from tidemark.operators.ranks import with_group
from tidemark.plans.outcome_queries import rnd
from tidemark.plans.timeseries_queries import r6
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources import lens

U = ("universe",)
TG = "price * (1 + upside / 100)"


@query("p23_price_target_quality", ctes=U, sql=f"""
t AS (SELECT ticker, price, analysts, {TG} AS mean, {TG} * (1 + (k % 7 - 3) / 20.0::double) AS median, {TG} * (1 + (k % 13) / 10.0::double) AS high, {TG} * (1 - (k % 9) / 12.0::double) AS low FROM universe),
x AS (SELECT *, (high - low) / median * 100 AS sp, abs(mean - median) / median * 100 AS gap, greatest(abs(high - mean) / mean * 100, abs(low - mean) / mean * 100) AS far, abs(median - price) / price * 100 AS dist FROM t),
s AS (SELECT *, greatest(0, least(100, 100 - CASE WHEN sp > 100 THEN 50 WHEN sp > 75 THEN 35 WHEN sp > 50 THEN 25 WHEN sp > 30 THEN 15 ELSE 0 END - CASE WHEN gap > 20 THEN 25 WHEN gap > 10 THEN 15 WHEN gap > 5 THEN 5 ELSE 0 END
 - CASE WHEN far > 200 THEN 25 WHEN far > 100 THEN 15 WHEN far > 50 THEN 5 ELSE 0 END - CASE WHEN dist > 300 THEN 30 WHEN dist > 150 THEN 15 ELSE 0 END + CASE WHEN analysts >= 10 THEN 5 WHEN analysts >= 5 THEN 2 WHEN analysts > 0 AND analysts < 3 THEN -15 ELSE 0 END)) AS score FROM x)
SELECT ticker, score::double AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, score >= 70 OR (sp < 40 AND gap < 15 AND score >= 50) AS robust FROM s""")
def p23(spark, sf):
    k = F.col("k")
    u = lens.universe(spark, sf).withColumn("m", F.col("price") * (1 + F.col("upside") / 100))
    m = F.col("m")
    q = ins.target_quality(m, m * (1 + (k % 7 - 3) / 20.0), m * (1 + (k % 13) / 10.0), m * (1 - (k % 9) / 12.0), F.col("price"), F.col("analysts"))
    return u.select("ticker", q.alias("q")).select("ticker", "q.score", "q.grade", "q.robust")


@query("p25_size_by_risk_level", ctes=U, sql="""
SELECT ticker, round(greatest(0.01, least(0.05, CASE k % 3 WHEN 0 THEN 0.022 WHEN 1 THEN 0.034 ELSE 0.05 END * CASE WHEN beta > 0 THEN least(1, 1 / beta) ELSE 1 END * CASE WHEN cap_value > 100e9 THEN 1.2 WHEN cap_value > 10e9 THEN 1.0 ELSE 0.8 END
 * CASE WHEN upside * buy_pct > 0 THEN least(1.5, 1 + upside * buy_pct / 100 / 50) WHEN upside * buy_pct < 0 THEN 0.5 ELSE 1 END))::double, 6) AS size FROM universe""")
def p25(spark, sf):
    lvl = F.when(F.col("k") % 3 == 0, "low").when(F.col("k") % 3 == 1, "medium").otherwise("high")
    return lens.universe(spark, sf).select("ticker", r6(ins.size_by_risk(lvl, F.col("beta"), F.col("cap_value"), F.col("upside") * F.col("buy_pct") / 100), "size"))


@query("p12_p15_p16_symbols_names_display", ctes=U, sql="""
SELECT ticker, CASE WHEN regexp_matches(ticker, '^[0-9]+\\.HK$') THEN ticker ELSE ticker END AS symbol, substr(upper(trim(name)), 1, 14) AS short_name, coalesce(printf('%.1f', roe) || '%', '--') AS roe_text,
 CASE WHEN cap_value >= 1e12 THEN printf('%.2f', cap_value / 1e12) || 'T' WHEN cap_value >= 1e9 THEN CASE WHEN cap_value / 1e9 >= 100 THEN printf('%.0f', cap_value / 1e9) WHEN cap_value / 1e9 >= 10 THEN printf('%.1f', cap_value / 1e9) ELSE printf('%.2f', cap_value / 1e9) END || 'B' ELSE printf('%.0f', cap_value / 1e6) || 'M' END AS cap_text FROM universe""")
def p12(spark, sf):
    return lens.universe(spark, sf).select("ticker", ins.normal_symbol(F.col("ticker")).alias("symbol"), ins.clean_name(F.col("name")).alias("short_name"), ins.show_percent(F.col("roe")).alias("roe_text"), ins.show_cap(F.col("cap_value")).alias("cap_text"))


@query("p38_p39_ratings_and_momentum", ctes=("log",), sql="""
p AS (SELECT ticker, CASE WHEN date >= DATE '2024-01-24' THEN 0 WHEN date >= DATE '2024-01-17' THEN 1 WHEN date >= DATE '2024-01-10' THEN 2 ELSE 3 END AS period, signal FROM log),
g AS (SELECT ticker, count(*) FILTER (period = 0) AS n0, count(*) FILTER (period = 0 AND signal = 'B') AS b0, count(*) FILTER (period = 3) AS n3, count(*) FILTER (period = 3 AND signal = 'B') AS b3 FROM p GROUP BY 1)
SELECT ticker, n0 AS total_ratings, round(b0 * 100.0 / nullif(n0, 0), 6) AS buy_pct, b0 - b3 AS momentum, CASE WHEN n3 = 0 THEN 'unknown' WHEN n0 > n3 * 1.1 THEN 'rising' WHEN n0 < n3 * 0.9 THEN 'falling' ELSE 'stable' END AS coverage_trend FROM g""")
def p38(spark, sf):
    """Newest period against the one three back, as one conditional aggregate."""
    d = F.col("date")
    per = F.when(d >= F.lit("2024-01-24"), 0).when(d >= F.lit("2024-01-17"), 1).when(d >= F.lit("2024-01-10"), 2).otherwise(3)
    l = lens.log(spark, sf).select("ticker", per.alias("p"), (F.col("signal") == "B").alias("b"))
    n = lambda c: F.count(F.when(c, 1))
    g = l.groupBy("ticker").agg(n(F.col("p") == 0).alias("n0"), n((F.col("p") == 0) & F.col("b")).alias("b0"), n(F.col("p") == 3).alias("n3"), n((F.col("p") == 3) & F.col("b")).alias("b3"))
    tr = F.when(F.col("n3") == 0, "unknown").when(F.col("n0") > F.col("n3") * 1.1, "rising").when(F.col("n0") < F.col("n3") * 0.9, "falling").otherwise("stable")
    return g.select("ticker", F.col("n0").alias("total_ratings"), r6(F.try_divide(F.col("b0") * 100.0, "n0"), "buy_pct"), (F.col("b0") - F.col("b3")).alias("momentum"), tr.alias("coverage_trend"))


Q_SQL = "q AS (SELECT l_suppkey AS ticker, date_trunc('quarter', l_shipdate)::date AS quarter, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,2))) as double) AS income FROM lineitem GROUP BY 1, 2)"


def quarterly(spark, sf):
    amt = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,2)")
    return lens.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("quarter")).agg(F.sum(amt).cast("double").alias("income"))


@query("p40_earnings_growth", ctes=("prices",), sql=Q_SQL + """,
w AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY quarter DESC) AS rn, lag(income, 1) OVER o AS prev, lag(income, 3) OVER o AS y FROM q WINDOW o AS (PARTITION BY ticker ORDER BY quarter))
SELECT ticker, quarter, round(CASE WHEN abs(y) > 1000 THEN (income - y) / abs(y) * 100 WHEN abs(prev) > 1000 THEN (income - prev) / abs(prev) * 100 END, 4) AS growth, CASE WHEN abs(y) > 1000 THEN 'yoy' WHEN abs(prev) > 1000 THEN 'qoq' END AS basis FROM w WHERE rn = 1""")
def p40(spark, sf):
    """Newest quarter against the fourth newest by position, else the previous one."""
    w = Window.partitionBy("ticker").orderBy("quarter")
    q = quarterly(spark, sf).select("ticker", "quarter", "income", F.lag("income", 1).over(w).alias("p"), F.lag("income", 3).over(w).alias("y"))
    l = q.groupBy("ticker").agg(F.max_by(F.struct("quarter", "income", "p", "y"), "quarter").alias("l")).select("ticker", "l.*")
    yo, qo = F.abs("y") > 1000, F.abs("p") > 1000
    g = F.when(yo, (F.col("income") - F.col("y")) / F.abs("y") * 100).when(qo, (F.col("income") - F.col("p")) / F.abs("p") * 100)
    return l.select("ticker", "quarter", F.round(g, 4).alias("growth"), F.when(yo, "yoy").when(qo, "qoq").alias("basis"))


@query("a41_earnings_trend", ctes=("prices",), sql=Q_SQL + """,
g AS (SELECT ticker, (income - lag(income) OVER o) / abs(lag(income) OVER o) * 100 AS growth FROM q WINDOW o AS (PARTITION BY ticker ORDER BY quarter))
SELECT ticker, count(growth) AS quarters, round(avg(growth), 4) AS mean_growth, round(avg((growth > 0)::int) FILTER (growth IS NOT NULL), 6) AS consistency FROM g GROUP BY 1""")
def a41(spark, sf):
    w = Window.partitionBy("ticker").orderBy("quarter")
    g = quarterly(spark, sf).select("ticker", ((F.col("income") - F.lag("income").over(w)) / F.abs(F.lag("income").over(w)) * 100).alias("growth"))
    return g.groupBy("ticker").agg(F.count("growth").alias("quarters"), F.round(F.avg("growth"), 4).alias("mean_growth"), r6(F.avg((F.col("growth") > 0).cast("double")), "consistency"))


@query("a40_insider_summary", sql="""
x AS (SELECT l_suppkey AS ticker, CASE o_orderstatus WHEN 'F' THEN 'buy' WHEN 'P' THEN 'sell' END AS side, cast(l_extendedprice as decimal(18,2)) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F','P')),
g AS (SELECT ticker, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells, cast(coalesce(sum(v) FILTER (side = 'buy'), 0) as double) AS bv, cast(coalesce(sum(v) FILTER (side = 'sell'), 0) as double) AS sv FROM x GROUP BY 1)
SELECT ticker, buys, sells, round(bv - sv, 2) AS net_value, CASE WHEN bv > sv * 1.05 THEN 'BULLISH' WHEN sv > bv * 1.05 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment FROM g""")
def a40(spark, sf):
    """Sums per (order, instrument) first, so the join carries reduced rows."""
    li = lens.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"), F.count("*").alias("n"))
    o = lens.table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    buy = F.col("o_orderstatus") == "F"
    z = F.lit(0)
    g = j.groupBy(F.col("l_suppkey").alias("ticker")).agg(F.coalesce(F.sum(F.when(buy, F.col("n"))), z).alias("buys"), F.coalesce(F.sum(F.when(~buy, F.col("n"))), z).alias("sells"),
                                                         F.coalesce(F.sum(F.when(buy, F.col("v"))), z).cast("double").alias("bv"), F.coalesce(F.sum(F.when(~buy, F.col("v"))), z).cast("double").alias("sv"))
    s = F.when(F.col("bv") > F.col("sv") * 1.05, "BULLISH").when(F.col("sv") > F.col("bv") * 1.05, "BEARISH").otherwise("NEUTRAL")
    return g.select("ticker", "buys", "sells", F.round(F.col("bv") - F.col("sv"), 2).alias("net_value"), s.alias("sentiment"))


@query("p22_uptrend_flag", ctes=("bars",), sql="""
SELECT ticker, date, close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING) AND close > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING) AS uptrend FROM bars""")
def p22(spark, sf):
    w = ts.by_bar()
    ma = lambda n: F.avg("close").over(w.rowsBetween(-(n - 1), 0))
    return lens.prices(spark, sf).select("ticker", "date", ((F.col("close") > ma(50)) & (F.col("close") > ma(200))).alias("uptrend"))


@query("p11_j18_pe_vs_sector", ctes=U, sql="""
m AS (SELECT sector, median(pef) AS med FROM universe WHERE pef > 0 GROUP BY 1) SELECT u.ticker, round(CASE WHEN pef > 0 AND med > 0 THEN pef / med END, 6) AS pe_vs_sector FROM universe u LEFT JOIN m USING (sector)""")
def p11(spark, sf):
    from tidemark.operators.ranks import medians
    u = lens.universe(spark, sf).select("ticker", "sector", "pef")
    m = medians(u.where("pef > 0"), ["sector"], "pef", "med").select("sector", "med")
    return u.join(m, "sector", "left").select("ticker", r6(F.when((F.col("pef") > 0) & (F.col("med") > 0), F.col("pef") / F.col("med")), "pe_vs_sector"))


@query("v21_holder_excess_study", ctes=("holders", "mret"), sql="""
i AS (SELECT c_custkey AS investor, CASE WHEN c_acctbal >= (SELECT median(c_acctbal) FROM customer) THEN 'top' ELSE 'rest' END AS grp FROM customer),
h AS (SELECT month, investor, ticker, spend / sum(spend) OVER (PARTITION BY month, investor) AS w FROM holders),
b AS (SELECT month, grp, ticker, sum(w) AS w FROM h JOIN i USING (investor) GROUP BY 1, 2, 3),
r AS (SELECT b.month, grp, sum(w * m.ret) / sum(w) AS ret FROM b JOIN mret m ON m.ticker = b.ticker AND m.month = b.month + INTERVAL 1 MONTH WHERE m.ret IS NOT NULL GROUP BY 1, 2),
x AS (SELECT a.month, a.ret - c.ret AS excess FROM r a JOIN r c ON c.month = a.month AND c.grp = 'rest' WHERE a.grp = 'top')
SELECT count(*) AS n, round(avg(excess), 6) AS mean_excess, round(avg(excess) / (stddev_samp(excess) / sqrt(count(*))), 4) AS t FROM x""")
def v21(spark, sf):
    """Monthly book of the better half of investors against the rest: next-month return of the
    weighted book, excess, t ratio."""
    from tidemark.operators.ranks import medians
    from tidemark.plans.validation_queries import monthly_returns
    c = lens.table(spark, sf, "customer").select(F.col("c_custkey").alias("investor"), "c_acctbal")
    med = medians(c, [], "c_acctbal", "med").select("med")
    grp = c.join(F.broadcast(med)).select("investor", F.when(F.col("c_acctbal") >= F.col("med"), "top").otherwise("rest").alias("grp"))  # med: one row
    h = written(lens.holders(spark, sf), "holders")
    h = with_group(h, ["month", "investor"], F.sum("spend").alias("t")).join(grp, "investor")
    b = h.groupBy("month", "grp", "ticker").agg(F.sum(F.col("spend") / F.col("t")).alias("w"))
    m = monthly_returns(spark, sf).select("ticker", F.add_months("month", -1).alias("month"), "ret")
    r = b.join(m, ["ticker", "month"]).groupBy("month").pivot("grp", ["top", "rest"]).agg(F.sum(F.col("w") * F.col("ret")) / F.sum("w"))
    x = r.where("top is not null and rest is not null").select((F.col("top") - F.col("rest")).alias("e"))
    g = x.agg(F.count("*").alias("n"), F.avg("e").alias("m"), F.stddev_samp("e").alias("s"))
    return g.select("n", r6("m", "mean_excess"), F.round(F.col("m") / (F.col("s") / F.sqrt("n")), 4).alias("t"))


UP, DOWN = ["up", "rose", "gain", "rise"], ["down", "fell", "loss", "drop"]  # fixed values: direction words


@query("x11_directional_sentences", sql=r"""
s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\n]+')) AS sentence FROM documents),
w AS (SELECT doc_id, sentence, len(list_filter(regexp_split_to_array(sentence, '[^a-z]+'), lambda x: x IN ('up','rose','gain','rise'))) AS u, len(list_filter(regexp_split_to_array(sentence, '[^a-z]+'), lambda x: x IN ('down','fell','loss','drop'))) AS d FROM s)
SELECT doc_id, count(*) AS sentences, cast(sum(CASE WHEN u > d THEN 1 ELSE 0 END) as bigint) AS up_n, cast(sum(CASE WHEN d > u THEN 1 ELSE 0 END) as bigint) AS down_n FROM w WHERE length(trim(sentence)) > 0 GROUP BY 1""")
def x11(spark, sf):
    """Sentences of the whole text with more rising than falling words, and the reverse."""
    s = lens.table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence")).where(F.length(F.trim("sentence")) > 0)
    words = F.split("sentence", "[^a-z]+")
    n = lambda ws: F.size(F.filter(words, lambda x: x.isin(*ws)))
    s = s.select("doc_id", n(UP).alias("u"), n(DOWN).alias("d"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.when(F.col("u") > F.col("d"), 1).otherwise(0)).alias("up_n"), F.sum(F.when(F.col("d") > F.col("u"), 1).otherwise(0)).alias("down_n"))
