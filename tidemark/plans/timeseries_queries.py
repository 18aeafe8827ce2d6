"""Price-panel queries: T01-T05, J09-J15 and the flagship event study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import regime
from tidemark.operators import timeseries as ts
from tidemark.operators.ranks import medians
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources import lens


def hit_expr(sig="signal", r="ret", band=5.0):
    """Right direction; B up, S down, anything else inside the band."""
    s, x = F.col(sig), F.col(r)
    return F.when(s == "B", x > 0).when(s == "S", x < 0).otherwise(F.abs(x) < band)


def fwd(spark, sf, horizons=ts.HORIZONS):
    f = ts.forward_returns(lens.signals(spark, sf), lens.prices(spark, sf), lens.bench(spark, sf), horizons, lens.signal_days(spark, sf))
    return f.withColumn("logged_price", lens.logged_price())


@query("j11_forward_returns_hit_rate", ctes=("fwd",), sql="""
SELECT signal, count(*) AS n, round(avg(CASE WHEN (signal='B' AND ret>0) OR (signal='S' AND ret<0)
  OR (signal='H' AND abs(ret)<5) THEN 100.0 ELSE 0.0 END), 6) AS hit_rate,
  round(avg(ret), 6) AS mean_return, round(median(ret), 6) AS median_return, round(avg(alpha), 6) AS avg_alpha
FROM fwd WHERE horizon = 30 GROUP BY signal""")
def flagship(spark, sf):
    # two passes follow (means, exact medians): the joined rows are written once and read twice
    f = written(fwd(spark, sf, [30]).select("signal", "ret", "alpha"), "outcomes")
    g = f.groupBy("signal").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(hit_expr(), 100.0).otherwise(0.0)), 6).alias("hit_rate"),
        F.round(F.avg("ret"), 6).alias("mean_return"), F.round(F.avg("alpha"), 6).alias("avg_alpha"))
    m = medians(f, ["signal"], "ret", "m").select("signal", F.round("m", 6).alias("median_return"))
    return g.join(m, "signal")


def r6(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


@query("t01_daily_returns", ctes=("prices",), sql="""
SELECT ticker, date, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS ret FROM prices""")
def daily_returns(spark, sf):
    return ts.daily_returns(lens.prices(spark, sf)).select("ticker", "date", r6("ret"))


@query("t02_momentum_12_1", ctes=("bars",), sql="""
SELECT ticker, date, round(lag(close, 21) OVER w / lag(close, 252) OVER w - 1, 6) AS mom FROM bars
WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def momentum(spark, sf):
    return lens.prices(spark, sf).select("ticker", "date", r6(ts.momentum_12_1(), "mom"))


@query("t02_momentum_pct_rounded", ctes=("bars",), sql="""
SELECT ticker, round((lag21 / lag252 - 1) * 100, 2) AS mom_pct FROM (
  SELECT ticker, bar_no, max(bar_no) OVER (PARTITION BY ticker) AS mx, lag(close, 20) OVER w AS lag21,
         lag(close, 251) OVER w AS lag252 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
WHERE bar_no = mx AND bar_no >= 252""")
def momentum_pct(spark, sf):
    px = ts.with_bar_no(lens.prices(spark, sf)).withColumn("m", ts.momentum_12_1(near=20, far=251))
    return (px.groupBy("ticker").agg(F.max_by("m", "date").alias("m"), F.max("bar_no").alias("n"))
            .where("n >= 252").select("ticker", F.round(F.col("m") * 100, 2).alias("mom_pct")))


@query("t03_realised_vol", ctes=("prices",), sql="""
SELECT ticker, date, round(stddev_pop(lr) OVER (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING) * sqrt(252), 6) AS vol
FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM prices)""")
def vol(spark, sf):
    return ts.realised_vol(lens.prices(spark, sf)).select("ticker", "date", r6("vol"))


def beta_rows(px, bench, lookback=120, min_obs=30):
    """T04. The window counts benchmark bars, as both series are cut to their last ``lookback``
    returns before they are intersected."""
    b = ts.daily_returns(bench.withColumn("_b", F.lit(0)), "_b").withColumn(
        "bno", F.row_number().over(Window.partitionBy("_b").orderBy("date"))).select("date", "bno", F.col("ret").alias("mret"))
    # one row per trading day
    j = ts.daily_returns(px).join(F.broadcast(b), "date")
    w = Window.partitionBy("ticker").orderBy("bno").rangeBetween(-(lookback - 1), 0)
    ok = F.col("ret").isNotNull() & F.col("mret").isNotNull()
    a, m = F.when(ok, F.col("ret")), F.when(ok, F.col("mret"))
    j = j.select("ticker", "date", F.count(a).over(w).alias("n_obs"), F.covar_samp(a, m).over(w).alias("cov"),
                 F.var_samp(m).over(w).alias("var"))
    return j.withColumn("beta", F.when((F.col("n_obs") >= min_obs) & (F.col("var") > 0), F.col("cov") / F.col("var")))


BETA_SQL = """
br AS (SELECT date, row_number() OVER (ORDER BY date) AS bno, close / lag(close) OVER (ORDER BY date) - 1 AS mret FROM bench),
tr AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices),
jr AS (SELECT ticker, date, bno, CASE WHEN mret IS NOT NULL THEN ret END AS ret, CASE WHEN ret IS NOT NULL THEN mret END AS mret
       FROM tr JOIN br USING (date)),
betas AS (SELECT ticker, date, count(ret) OVER w AS n_obs,
                 CASE WHEN count(ret) OVER w >= 30 THEN covar_samp(ret, mret) OVER w / var_samp(mret) OVER w END AS beta
          FROM jr WINDOW w AS (PARTITION BY ticker ORDER BY bno RANGE BETWEEN 119 PRECEDING AND CURRENT ROW))
"""


@query("t04_trailing_beta", ctes=("prices", "bench"), sql=BETA_SQL + """
SELECT ticker, date, n_obs, round(beta, 6) AS beta FROM betas""")
def beta(spark, sf):
    return beta_rows(lens.prices(spark, sf), lens.bench(spark, sf)).select("ticker", "date", "n_obs", r6("beta"))


@query("t05_price_sleeve", ctes=("bars",), sql="""
SELECT ticker, CASE WHEN bar_no < 253 THEN 'H' WHEN mom > 0 AND close > ma THEN 'B' WHEN mom < 0 AND close < ma THEN 'S' ELSE 'H' END AS label
FROM (SELECT *, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom,
             avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING) AS ma,
             row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE rn = 1""")
def price_sleeve(spark, sf):
    w = ts.by_bar().rowsBetween(-199, 0)
    px = ts.with_bar_no(lens.prices(spark, sf)).withColumn("mom", ts.momentum_12_1()).withColumn("ma", F.avg("close").over(w))
    last = px.groupBy("ticker").agg(F.max_by(F.struct("bar_no", "mom", "ma", "close"), "date").alias("l")).select("ticker", "l.*")
    return last.select("ticker", F.when(F.col("bar_no") < 253, "H").when((F.col("mom") > 0) & (F.col("close") > F.col("ma")), "B")
                       .when((F.col("mom") < 0) & (F.col("close") < F.col("ma")), "S").otherwise("H").alias("label"))


@query("t14_regime_inputs", ctes=("market",), sql="""
m AS (SELECT *, row_number() OVER (ORDER BY date) AS n FROM market)
SELECT a.date, min(a.n) AS n, count(*) AS hist_n, round(sum(CASE WHEN b.vix < a.vix THEN 100.0 ELSE 0 END) / count(*), 6) AS vix_pctile,
  round(max(c.ret20), 6) AS ret20, round(max(c.high_252), 6) AS high_252, round(max(c.ret_2y), 6) AS ret_2y
FROM m a JOIN m b ON b.n BETWEEN a.n - 504 AND a.n
JOIN (SELECT date, (spy - lag(spy, 20) OVER w) / lag(spy, 20) OVER w * 100 AS ret20,
             max(spy) OVER (ORDER BY date ROWS 252 PRECEDING) AS high_252,
             CASE WHEN n >= 504 THEN (spy - lag(spy, 503) OVER w) / lag(spy, 503) OVER w * 100
                  WHEN n >= 252 THEN (spy - lag(spy, 251) OVER w) / lag(spy, 251) OVER w * 100 END AS ret_2y
      FROM m WINDOW w AS (ORDER BY date)) c ON c.date = a.date
GROUP BY a.date""")
def regime_inputs(spark, sf):
    d = regime.regime_inputs(lens.market(spark, sf))
    return d.select("date", F.col("n").cast("long").alias("n"), F.col("hist_n").cast("long").alias("hist_n"),
                    r6("vix_pctile"), r6("ret20"), r6("high_252"), r6("ret_2y"))


REGIME_SQL = """
m AS (SELECT *, row_number() OVER (ORDER BY date) AS n FROM market),
pc AS (SELECT a.n, count(*) AS hist_n, sum(CASE WHEN b.vix < a.vix THEN 100.0 ELSE 0 END) / count(*) AS pctile
       FROM m a JOIN m b ON b.n BETWEEN a.n - 504 AND a.n GROUP BY a.n),
f AS (SELECT m.*, CASE WHEN hist_n >= 20 THEN pctile ELSE 50.0 END AS pct,
        coalesce((spy - lag(spy, 20) OVER w) / lag(spy, 20) OVER w * 100, 0) AS r20,
        coalesce((spy - lag(spy, 60) OVER w) / lag(spy, 60) OVER w * 100, 0) AS r60,
        max(spy) OVER (ORDER BY date ROWS 252 PRECEDING) AS hi, coalesce(lag(vix, 5) OVER w, vix) AS v5
      FROM m JOIN pc ON pc.n = m.n WINDOW w AS (ORDER BY m.date)),
s AS (SELECT *, cast(round(cast((cast(round(cast(100 - pct as double), 1) as decimal(6,1)) + (CASE WHEN vix<13 THEN 90 WHEN vix<16 THEN 75 WHEN vix<20 THEN 60
        WHEN vix<25 THEN 45 WHEN vix<30 THEN 30 WHEN vix<40 THEN 15 ELSE 5 END)) * 0.5 as decimal(10,3)), 1) as double) AS vix_score,
        round(greatest(0, least(100, 50 + (1 - vix / vix3m) * 150)), 1) AS term_structure,
        round(greatest(0, least(100, 50 + (cast(0.6 as double) * r20 + cast(0.4 as double) * r60) * 5)), 1) AS spy_momentum,
        round(greatest(0, least(100, 85 + (spy - hi) / hi * 100 * 4)), 1) AS spy_drawdown,
        round(greatest(0, least(100, 50 - (vix - v5) / v5 * 100 * cast(1.75 as double))), 1) AS vix_trend FROM f),
sc AS (SELECT *, cast(round(cast(vix_score as decimal(6,1)) * 0.3 + cast(term_structure as decimal(6,1)) * 0.15 + cast(spy_momentum as decimal(6,1)) * 0.25 + cast(spy_drawdown as decimal(6,1)) * 0.15 + cast(vix_trend as decimal(6,1)) * 0.15, 1) as double) AS score0 FROM s),
regimes AS (SELECT *, CASE WHEN vix > 30 AND term_structure < 30 THEN 'crisis' WHEN score0 < 20 THEN 'crisis' WHEN score0 < 40 THEN 'risk_off'
        WHEN score0 < 60 THEN 'neutral' ELSE 'risk_on' END AS regime,
        CASE WHEN vix > 30 AND term_structure < 30 THEN least(score0, 15) ELSE score0 END AS score FROM sc)
"""


@query("p34_regime_features_class", ctes=("market",), sql=REGIME_SQL + """
SELECT date, vix_score, term_structure, spy_momentum, spy_drawdown, vix_trend, score, regime FROM regimes""")
def regime_class(spark, sf):
    return regime.regime_labels(regime.regime_inputs(lens.market(spark, sf))).select(
        "date", "vix_score", "term_structure", "spy_momentum", "spy_drawdown", "vix_trend", "score", "regime")


CONF_SQL = REGIME_SQL + """,
runs AS (SELECT *, row_number() OVER (PARTITION BY grp, regime ORDER BY date) AS run_len FROM (
   SELECT date, spy, regime, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY regime ORDER BY date) AS grp FROM regimes)),
conf AS (SELECT date, spy, regime, coalesce(last_value(CASE WHEN run_len >= 2 THEN regime END IGNORE NULLS) OVER (ORDER BY date
   ROWS UNBOUNDED PRECEDING), 'neutral') AS confirmed FROM runs)
"""


@query("t15_regime_confirmation", ctes=("market",), sql=CONF_SQL + "SELECT date, regime, confirmed FROM conf")
def regime_confirm(spark, sf):
    lab = regime.regime_labels(regime.regime_inputs(lens.market(spark, sf)))
    return regime.confirmed(lab, 2).select("date", "regime", "confirmed")


@query("t16_overlay_simulation", ctes=("market",), sql=CONF_SQL + """,
o AS (SELECT date, spy / lag(spy) OVER (ORDER BY date) - 1 AS ret, CASE confirmed WHEN 'risk_on' THEN 1.0 WHEN 'neutral' THEN 0.9 WHEN 'risk_off'
        THEN 0.65 ELSE 0.4 END AS mult FROM conf),
e AS (SELECT *, mult * ret * 0.1 AS strat, exp(sum(ln(1 + mult * ret * 0.1)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM o WHERE ret IS NOT NULL),
p AS (SELECT *, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak, lag(mult) OVER (ORDER BY date) AS pm FROM e)
SELECT count(*) AS n, round(max_by(equity, date) - 1, 6) AS total_return, round(pow(max_by(equity, date), 252.0 / count(*)) - 1, 6) AS cagr,
  round(stddev_samp(strat) * sqrt(252), 6) AS vol, round(avg(strat) / stddev_samp(strat) * sqrt(252), 6) AS sharpe,
  round(min((equity - peak) / peak), 6) AS max_drawdown, round(avg(CASE WHEN mult < 1 THEN 1.0 ELSE 0 END), 6) AS pct_derisked,
  cast(sum(CASE WHEN pm <> mult THEN 1 ELSE 0 END) as bigint) AS switches FROM p""")
def overlay(spark, sf):
    """The daily moves of the stand-in index are scaled by 0.1: they are far noisier than an index."""
    lab = regime.confirmed(regime.regime_labels(regime.regime_inputs(lens.market(spark, sf))), 2)
    w = Window.partitionBy("_m").orderBy("date")
    d = (lab.withColumn("_m", F.lit(0)).withColumn("ret", (F.col("spy") / F.lag("spy").over(w) - 1) * 0.1)
         .where("ret is not null").select("date", "ret", regime.lookup(F.col("confirmed"), regime.REGIME_EXPOSURE, 0.9).alias("mult")))
    g = regime.overlay_stats(d)
    return g.select(*[c if c in ("n", "switches") else r6(c) for c in g.columns])


@query("j09_asof_price_backfill", ctes=("priced",), sql="""
SELECT ticker, date, signal, coalesce(logged_price, asof_close) AS price, logged_price IS NULL AND asof_close IS NOT NULL AS filled FROM priced""")
def backfill(spark, sf):
    p = lens.priced(lens.signals(spark, sf), lens.prices(spark, sf))
    return p.select("ticker", "date", "signal", F.coalesce("logged_price", "asof_close").alias("price"),
                    (F.col("logged_price").isNull() & F.col("asof_close").isNotNull()).alias("filled"))


@query("j10_asof_forward_max_gap", ctes=("signals", "prices"), sql="""
SELECT s.ticker, s.date, CASE WHEN p.date - s.date <= 5 THEN p.date END AS bar_date,
  CASE WHEN p.date - s.date <= 5 THEN p.close END AS close
FROM signals s ASOF LEFT JOIN prices p ON s.ticker = p.ticker AND s.date <= p.date""")
def asof_fwd(spark, sf):
    j = ts.asof_forward(lens.signals(spark, sf), lens.prices(spark, sf), "ticker", "date", {"close": "close"}, "bar_date")
    near = F.datediff("bar_date", "date") <= 5
    return j.select("ticker", "date", F.when(near, F.col("bar_date")).alias("bar_date"), F.when(near, F.col("close")).alias("close"))


@query("j10_nearest_day_fallback", ctes=("signals", "prices"), sql="""
SELECT ticker, date, off, close FROM (
 SELECT s.ticker, s.date, o.off, p.close, row_number() OVER (PARTITION BY s.ticker, s.date ORDER BY abs(o.off), o.off DESC) AS rn
 FROM signals s CROSS JOIN (VALUES (0),(1),(-1),(2),(-2),(3),(-3),(4),(-4)) o(off)
 JOIN prices p ON p.ticker = s.ticker AND p.date = s.date + o.off) WHERE rn = 1""")
def nearest_day(spark, sf):
    """Exact day, else +1, -1, +2, ... -4. Prices are offered to the nine days around them: one equi
    join and a min per signal instead of nine lookups."""
    offs = F.explode(F.array(*[F.lit(i) for i in range(-4, 5)]))
    px = lens.prices(spark, sf).withColumn("off", offs).select("ticker", F.date_sub("date", F.col("off")).alias("date"), "off", "close")
    j = lens.signals(spark, sf).select("ticker", "date").join(px, ["ticker", "date"])
    best = F.min(F.struct(F.abs("off").alias("d"), (-F.col("off")).alias("o"), "close"))
    return j.groupBy("ticker", "date").agg(best.alias("b")).select("ticker", "date", (-F.col("b.o")).alias("off"), F.col("b.close").alias("close"))


@query("j12_clamped_bar_offset", ctes=("bars", "priced"), sql="""
SELECT p.ticker, p.date, f.date AS future_date, round((f.close - b.close) / b.close * 100, 6) AS ret
FROM (SELECT p.*, b.bar_no AS base FROM priced p ASOF JOIN bars b ON p.ticker = b.ticker AND p.date <= b.date) p
JOIN (SELECT ticker, max(bar_no) AS mx FROM bars GROUP BY 1) m ON m.ticker = p.ticker
JOIN bars b ON b.ticker = p.ticker AND b.bar_no = base
JOIN bars f ON f.ticker = p.ticker AND f.bar_no = least(base + 30, mx) AND f.bar_no > base""")
def clamped(spark, sf):
    px = lens.prices(spark, sf)
    fut = ts.with_future_bars(px, [30], clamp=True)
    j = ts.asof_forward(lens.signals(spark, sf), fut, "ticker", "date", {"close": "base", "f30": "f"})
    return j.where("f is not null").select("ticker", "date", F.col("f.date").alias("future_date"),
                                           r6((F.col("f.close") - F.col("base")) / F.col("base") * 100, "ret"))


@query("j13_regional_alpha", ctes=("fwd_dims", "bench", "regional_bench", "dims"), sql="""
fw AS MATERIALIZED (SELECT ticker, date, alpha, ret FROM fwd_dims WHERE horizon = 30),
rb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY regionkey ORDER BY date) AS n FROM regional_bench),
b AS MATERIALIZED (SELECT q.regionkey, q.date AS d0, r.close, r.n FROM (SELECT DISTINCT d.regionkey, f.date FROM fw f JOIN dims d USING (ticker)) q ASOF JOIN rb r ON q.regionkey = r.regionkey AND q.date <= r.date)
SELECT f.ticker, f.date, round(f.alpha, 6) AS alpha, round(f.ret - (e.close - b.close) / b.close * 100, 6) AS regional_alpha
FROM fw f JOIN dims d ON d.ticker = f.ticker LEFT JOIN b ON b.regionkey = d.regionkey AND b.d0 = f.date LEFT JOIN rb e ON e.regionkey = b.regionkey AND e.n = b.n + 30""")
def regional_alpha(spark, sf):
    f = fwd(spark, sf, [30]).join(lens.dims(spark, sf), "ticker")
    rb = ts.with_future_bars(lens.regional_bench(spark, sf), [30], key="regionkey")
    days = f.select("regionkey", "date").distinct()
    hit = ts.asof_forward(days, rb, "regionkey", "date", {"close": "rb", "f30": "rf"})
    # regions x calendar days
    j = f.join(F.broadcast(hit), ["regionkey", "date"], "left")
    return j.select("ticker", "date", r6("alpha"),
                    r6(F.col("ret") - (F.col("rf.close") - F.col("rb")) / F.col("rb") * 100, "regional_alpha"))


@query("j14_fx_adjusted_return", ctes=("fwd_dims", "regional_bench", "dims"), sql="""
SELECT f.ticker, f.date, round(((1 + f.ret / 100) * (a.close / b.close) - 1) * 100, 6) AS ret_base
FROM (SELECT f.*, d.regionkey AS rk FROM fwd f JOIN dims d ON d.ticker = f.ticker WHERE f.horizon = 30) f
ASOF LEFT JOIN regional_bench a ON a.regionkey = f.rk AND f.date <= a.date
ASOF LEFT JOIN regional_bench b ON b.regionkey = f.rk AND f.future_date <= b.date""")
def fx_return(spark, sf):
    """The regional series stands in for the currency's rate against the base currency."""
    f = fwd(spark, sf, [30]).join(lens.dims(spark, sf), "ticker")
    fx = lens.regional_bench(spark, sf)
    d0 = f.select("regionkey", "date").union(f.select("regionkey", F.col("future_date"))).distinct()
    fx = ts.asof_forward(d0, fx, "regionkey", "date", {"close": "rate"})
    # regions x calendar days
    a = F.broadcast(fx.select("regionkey", "date", F.col("rate").alias("r0")))
    b = F.broadcast(fx.select("regionkey", F.col("date").alias("future_date"), F.col("rate").alias("r1")))
    j = f.join(a, ["regionkey", "date"], "left").join(b, ["regionkey", "future_date"], "left")
    return j.select("ticker", "date", r6(((1 + F.col("ret") / 100) * F.try_divide("r0", "r1") - 1) * 100, "ret_base"))


def worst_within(rec, px, days=30):
    """Lowest return over bars in (day, day + days] and its first date.

    Each bar is offered to the calendar days it can serve, in blocks of ``days``: a recommendation
    meets at most two blocks, so the join is an equi join on (ticker, block).
    """
    p = px.select("ticker", F.col("date").alias("bar_date"), "close",
                  F.floor(F.datediff("date", F.lit("1970-01-01")) / days).alias("blk"))
    blk = F.floor(F.datediff("date", F.lit("1970-01-01")) / days)
    r = rec.withColumn("blk", F.explode(F.array(blk, blk + 1)))
    j = r.join(p, ["ticker", "blk"]).where((F.col("bar_date") > F.col("date")) & (F.col("bar_date") <= F.date_add("date", days)))
    ret = (F.col("close") - F.col("price")) / F.col("price") * 100
    return (j.groupBy("ticker", "date").agg(F.min(F.struct(ret.alias("ret"), F.col("bar_date"))).alias("w"), F.count("*").alias("bars"))
            .select("ticker", "date", "bars", F.col("w.ret").alias("worst"), F.col("w.bar_date").alias("worst_date")))


@query("j15_worst_return_interval", ctes=("priced", "prices"), sql="""
SELECT s.ticker, s.date, count(*) AS bars, round(min((p.close - s.asof_close) / s.asof_close * 100), 6) AS worst,
  arg_min(p.date, (p.close - s.asof_close) / s.asof_close) AS worst_date
FROM priced s JOIN prices p ON p.ticker = s.ticker AND p.date > s.date AND p.date <= s.date + 30
WHERE s.asof_close > 0 GROUP BY 1, 2""")
def worst_interval(spark, sf):
    px = lens.prices(spark, sf)
    rec = lens.priced(lens.signals(spark, sf), px).where("asof_close > 0").select("ticker", "date", F.col("asof_close").alias("price"))
    return worst_within(rec, px).withColumn("worst", F.round("worst", 6))


@query("t12_signal_velocity", ctes=("daily_log",), sql="""
b AS (SELECT * FROM daily_log WHERE signal IN ('B','S','H')),
c AS (SELECT *, lag(signal) OVER (PARTITION BY ticker ORDER BY date) AS prev, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS pdate,
  max(date) OVER (PARTITION BY ticker) AS last FROM b),
g AS (SELECT ticker, max_by(signal, date) AS current_signal,
   coalesce(max(CASE WHEN prev IS DISTINCT FROM signal THEN date END), min(date)) AS streak_start,
   cast(sum(CASE WHEN pdate >= DATE '2024-01-31' - 30 AND prev <> signal THEN 1 ELSE 0 END) as bigint) AS changes_30d FROM c GROUP BY ticker)
SELECT ticker, current_signal, cast(DATE '2024-01-31' - streak_start as bigint) AS days_at, changes_30d,
  CASE WHEN changes_30d >= 3 THEN 'volatile' WHEN DATE '2024-01-31' - streak_start < 7 THEN 'fresh'
       WHEN DATE '2024-01-31' - streak_start <= 60 THEN 'stable' ELSE 'stale' END AS velocity FROM g""")
def velocity(spark, sf):
    return signal_velocity(lens.daily_log(spark, sf).where(F.col("signal").isin("B", "S", "H")), F.lit("2024-01-31").cast("date"))


def signal_velocity(daily, as_of):
    """T12 on one row per (ticker, day): current streak and number of changes in 30 days."""
    w = ts.by_bar()
    prev, pdate = F.lag("signal").over(w), F.lag("date").over(w)
    d = daily.select("ticker", "date", "signal", prev.alias("prev"), pdate.alias("pdate"))
    g = d.groupBy("ticker").agg(
        F.max_by("signal", "date").alias("current_signal"),
        F.max(F.when(~F.col("prev").eqNullSafe(F.col("signal")), F.col("date"))).alias("streak_start"),
        F.sum(F.when((F.col("pdate") >= F.date_sub(as_of, 30)) & (F.col("prev") != F.col("signal")), 1).otherwise(0)).alias("changes_30d"))
    days = F.datediff(as_of, "streak_start")
    return g.select("ticker", "current_signal", days.cast("long").alias("days_at"), "changes_30d",
                    F.when(F.col("changes_30d") >= 3, "volatile").when(days < 7, "fresh").when(days <= 60, "stable")
                    .otherwise("stale").alias("velocity"))


@query("t13_data_freshness", ctes=("daily_log",), sql="""
c AS (SELECT *, abs(value - lag(value) OVER w) >= 20 AS cv, abs(score - lag(score) OVER w) >= 40 AS cs,
   first_value(date) OVER w AS d0 FROM daily_log WINDOW w AS (PARTITION BY ticker ORDER BY date)),
g AS (SELECT ticker, count(*) AS n, min(date) AS d0, max(CASE WHEN cv OR cs THEN date END) AS ch,
  max_by(concat(CASE WHEN cv THEN 'value;' ELSE '' END, CASE WHEN cs THEN 'score;' ELSE '' END), CASE WHEN cv OR cs THEN date END) AS what FROM c GROUP BY ticker)
SELECT ticker, n AS total_observations, coalesce(ch, d0) AS last_change, coalesce(what, '') AS metrics_changed,
  CASE WHEN n < 2 THEN 'stale' WHEN d < 30 THEN 'fresh' WHEN d < 60 THEN 'aging' WHEN d < 90 THEN 'stale' ELSE 'dead' END AS staleness,
  cast(CASE WHEN n < 2 THEN 0.5 WHEN d < 30 THEN 0.0 WHEN d < 60 THEN 0.25 WHEN d < 90 THEN 0.5 ELSE 1.0 END as double) AS penalty
FROM (SELECT *, DATE '2024-02-20' - coalesce(ch, d0) AS d FROM g)""")
def freshness(spark, sf):
    return data_freshness(lens.daily_log(spark, sf), {"value": 20.0, "score": 40.0}, F.lit("2024-02-20").cast("date"))


FRESHNESS_BANDS = [(30, "fresh", 0.0), (60, "aging", 0.25), (90, "stale", 0.5)]  # fixed values


def data_freshness(daily, thresholds, as_of):
    """Last day on which any metric moved by its threshold since the previous entry."""
    w = ts.by_bar()
    moved = {m: F.coalesce(F.abs(F.col(m) - F.lag(m).over(w)) >= t, F.lit(False)) for m, t in thresholds.items()}
    d = daily.select("ticker", "date", F.concat(*[F.when(c, f"{m};").otherwise("") for m, c in moved.items()]).alias("what"))
    hit = F.when(F.col("what") != "", F.struct("date", "what"))
    g = d.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("d0"), F.max(hit).alias("h"))
    last = F.coalesce(F.col("h.date"), F.col("d0"))
    age = F.datediff(as_of, last)
    st, pen = F.when(F.col("n") < 2, "stale"), F.when(F.col("n") < 2, 0.5)
    for b, name, p in FRESHNESS_BANDS:
        st, pen = st.when(age < b, name), pen.when(age < b, p)
    return g.select("ticker", F.col("n").alias("total_observations"), last.alias("last_change"),
                    F.coalesce(F.col("h.what"), F.lit("")).alias("metrics_changed"), st.otherwise("dead").alias("staleness"),
                    pen.otherwise(1.0).alias("penalty"))


@query("t26_sector_relative_momentum", ctes=("bars", "dims"), sql="""
sb AS (SELECT sector, l_shipdate::date AS date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) AS close
  FROM lineitem JOIN dims ON ticker = l_suppkey GROUP BY 1, 2),
sr AS (SELECT sector, (close / lag(close, 252) OVER (PARTITION BY sector ORDER BY date) - 1) * 100 AS ret, row_number() OVER (PARTITION BY sector ORDER BY date DESC) AS rn FROM sb),
tr AS (SELECT ticker, (close / lag(close, 252) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars)
SELECT t.ticker, d.sector, round(t.ret - s.ret, 6) AS rel, t.ret - s.ret < -15 AS underperforming
FROM tr t JOIN dims d USING (ticker) JOIN sr s ON s.sector = d.sector AND s.rn = 1 WHERE t.rn = 1 AND t.ret IS NOT NULL AND s.ret IS NOT NULL""")
def sector_relative(spark, sf):
    dm = lens.dims(spark, sf).select("ticker", "sector")
    px = lens.prices(spark, sf)
    w, ws = ts.by_bar(), ts.by_bar("sector")
    last = lambda d, k: (d.withColumn("r", (F.try_divide("close", F.lag("close", 252).over(ts.by_bar(k))) - 1) * 100)
                         .groupBy(k).agg(F.max_by("r", "date").alias("r")))
    t = last(px, "ticker")
    s = last(sector_prices(spark, sf), "sector").withColumnRenamed("r", "sr")
    j = t.join(dm, "ticker").join(s, "sector")
    rel = F.col("r") - F.col("sr")
    return j.where(rel.isNotNull()).select("ticker", "sector", r6(rel, "rel"), (rel < -15).alias("underperforming"))


def sector_prices(spark, sf):
    """One row per (sector, trading day). Lines are first reduced to (ticker, day)."""
    per = (lens.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))
           .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("a"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q")))
    return (per.join(lens.dims(spark, sf).select("ticker", "sector"), "ticker").groupBy("sector", "date")
            .agg((F.sum("a").cast("double") / F.sum("q").cast("double")).alias("close")))


ROT_SQL = """
cur AS (SELECT ticker, max_by(signal, date) AS signal FROM signals WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-07-01' GROUP BY 1),
pri AS (SELECT ticker, max_by(signal, date) AS signal FROM signals WHERE date BETWEEN DATE '2000-05-02' AND DATE '2000-06-01' GROUP BY 1),
cr AS (SELECT sector, round(count(*) FILTER (signal='B') * 100.0 / count(*), 1) AS br, count(*) AS n FROM cur JOIN dims USING (ticker) GROUP BY 1 HAVING count(*) >= 3),
pr AS (SELECT sector, round(count(*) FILTER (signal='B') * 100.0 / count(*), 1) AS br, count(*) AS n FROM pri JOIN dims USING (ticker) GROUP BY 1 HAVING count(*) >= 3),
rot AS (SELECT sector, cr.br AS current_rate, pr.br AS prior_rate, round(cr.br - pr.br, 1) AS delta_pp, cr.n AS n,
   CASE WHEN cr.br - pr.br >= 15 THEN 'gaining' WHEN cr.br - pr.br <= -15 THEN 'losing' ELSE 'flat' END AS state FROM cr JOIN pr USING (sector))
"""


def sector_rotation(sig, dims, as_of, lookback=30, threshold=15.0, min_n=3):
    """T27. The two windows share their boundary day."""
    def rates(d0, d1, name):
        latest = sig.where(F.col("date").between(d0, d1)).groupBy("ticker").agg(F.max_by("signal", "date").alias("signal"))
        return (latest.join(dims, "ticker").groupBy("sector")
                .agg(F.round(F.avg(F.when(F.col("signal") == "B", 100.0).otherwise(0.0)), 1).alias(f"{name}_rate"), F.count("*").alias(f"{name}_n"))
                .where(F.col(f"{name}_n") >= min_n))

    c, p = rates(F.date_sub(as_of, lookback), as_of, "current"), rates(F.date_sub(as_of, 2 * lookback), F.date_sub(as_of, lookback), "prior")
    d = F.col("current_rate") - F.col("prior_rate")
    return c.join(p, "sector").select("sector", "current_rate", "prior_rate", F.round(d, 1).alias("delta_pp"), F.col("current_n").alias("n"),
                                      F.when(d >= threshold, "gaining").when(d <= -threshold, "losing").otherwise("flat").alias("state"))


@query("t27_sector_rotation_signals", ctes=("signals", "dims"), sql=ROT_SQL + "SELECT * FROM rot")
def rotation(spark, sf):
    return sector_rotation(lens.signals(spark, sf), lens.dims(spark, sf).select("ticker", "sector"), F.lit("2000-07-01").cast("date"))


@query("j21_rotation_pairs", ctes=("signals", "dims"), sql=ROT_SQL + """
SELECT 'Rotation: ' || l.sector || ' -> ' || g.sector AS rotation, l.delta_pp AS from_pp, g.delta_pp AS to_pp
FROM rot l, rot g WHERE l.state = 'losing' AND g.state = 'gaining'""")
def rotation_pairs(spark, sf):
    """Pairs of sectors: both sides are one row per sector, a fixed classification."""
    r = rotation(spark, sf)
    lo = r.where("state = 'losing'").select(F.col("sector").alias("ls"), F.col("delta_pp").alias("from_pp"))
    g = r.where("state = 'gaining'").select(F.col("sector").alias("gs"), F.col("delta_pp").alias("to_pp"))
    return lo.join(F.broadcast(g), F.col("from_pp") < F.col("to_pp")).select(
        F.concat(F.lit("Rotation: "), "ls", F.lit(" -> "), "gs").alias("rotation"), "from_pp", "to_pp")


PRICE_ROT_SQL = ROT_SQL + """,
sb AS (SELECT sector, l_shipdate::date AS date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) AS close
  FROM lineitem JOIN dims ON ticker = l_suppkey GROUP BY 1, 2),
l AS (SELECT sector, close, lag(close, 21) OVER w AS c21, lag(close, 42) OVER w AS c42, row_number() OVER (PARTITION BY sector ORDER BY date DESC) AS rn
   FROM sb WHERE date <= DATE '2000-07-01' WINDOW w AS (PARTITION BY sector ORDER BY date)),
px AS (SELECT sector, (close / c21 - 1) * 100 AS cr, (c21 / c42 - 1) * 100 AS prr FROM l WHERE rn = 1),
pst AS (SELECT sector, round(cr - prr, 6) AS chg, CASE WHEN cr - prr >= 5 THEN 'gaining' WHEN cr - prr <= -5 THEN 'losing' ELSE 'flat' END AS pstate FROM px)
"""


@query("t28_combined_rotation", ctes=("signals", "dims"), sql=PRICE_ROT_SQL + """
SELECT p.sector, p.chg, p.pstate, coalesce(r.state, 'none') AS sstate,
  CASE WHEN p.pstate IN ('gaining','losing') AND p.pstate = r.state THEN 'confirmed' WHEN p.pstate IN ('gaining','losing') THEN 'early' ELSE 'none' END AS verdict,
  CASE WHEN count(*) FILTER (p.pstate IN ('gaining','losing') AND p.pstate = r.state) OVER () > 0 THEN 'HIGH'
       WHEN count(*) FILTER (p.pstate <> 'flat') OVER () > 0 THEN 'MEDIUM'
       WHEN count(*) FILTER (r.state = 'gaining') OVER () > 0 AND count(*) FILTER (r.state = 'losing') OVER () > 0 THEN 'LOW' ELSE 'NONE' END AS confidence
FROM pst p LEFT JOIN rot r USING (sector)""")
def rotation_combined(spark, sf):
    as_of = F.lit("2000-07-01").cast("date")
    w = ts.by_bar("sector")
    sp = sector_prices(spark, sf).where(F.col("date") <= as_of)
    sp = sp.select("sector", "date", ((F.col("close") / F.lag("close", 21).over(w) - 1)
                                      - (F.lag("close", 21).over(w) / F.lag("close", 42).over(w) - 1)).alias("c"))
    p = sp.groupBy("sector").agg((F.max_by("c", "date") * 100).alias("c"))
    p = p.withColumn("pstate", F.when(F.col("c") >= 5, "gaining").when(F.col("c") <= -5, "losing").otherwise("flat"))
    j = p.join(rotation(spark, sf).select("sector", F.col("state").alias("s")), "sector", "left")
    moving = F.col("pstate").isin("gaining", "losing")
    conf = moving & F.col("s").eqNullSafe(F.col("pstate"))
    allrows = Window.partitionBy(F.lit(0))  # one row per sector
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")).over(allrows) == 1
    return j.select("sector", r6("c", "chg"), "pstate", F.coalesce("s", F.lit("none")).alias("sstate"),
                    F.when(conf, "confirmed").when(moving, "early").otherwise("none").alias("verdict"),
                    F.when(any_(conf), "HIGH").when(any_(moving), "MEDIUM")
                    .when(any_(F.col("s") == "gaining") & any_(F.col("s") == "losing"), "LOW").otherwise("NONE").alias("confidence"))


@query("t29_sector_ranking_gaps", ctes=("dims",), sql="""
sb AS (SELECT sector, l_shipdate::date AS date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) AS close,
  sum(cast(l_extendedprice as decimal(18,2))) AS amt FROM lineitem JOIN dims ON ticker = l_suppkey GROUP BY 1, 2),
r AS (SELECT sector, (close / lag(close, 21) OVER w - 1) * 100 AS r1, (close / lag(close, 63) OVER w - 1) * 100 AS r3,
  (close / lag(close, 126) OVER w - 1) * 100 AS r6, row_number() OVER (PARTITION BY sector ORDER BY date DESC) AS rn FROM sb WINDOW w AS (PARTITION BY sector ORDER BY date)),
wt AS (SELECT sector, cast(sum(amt) as double) * 100 / (SELECT cast(sum(amt) as double) FROM sb) AS weight FROM sb GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY r1 DESC, sector) AS rank FROM r WHERE rn = 1)
SELECT k.sector, round(r1, 6) AS r1, round(r3, 6) AS r3, round(r6, 6) AS r6, rank, round(weight, 6) AS weight,
  weight < 3 AND rank <= 5 AND r1 > 0 AS is_gap, CASE WHEN weight < 3 AND rank <= 5 AND r1 > 0 THEN CASE WHEN rank <= 3 AND weight < 1 THEN 'HIGH' ELSE 'MEDIUM' END END AS urgency
FROM k JOIN wt USING (sector)""")
def sector_gaps(spark, sf):
    sp = sector_prices(spark, sf)
    w = ts.by_bar("sector")
    ret = lambda n: ((F.col("close") / F.lag("close", n).over(w) - 1) * 100)
    last = (sp.select("sector", "date", ret(21).alias("r1"), ret(63).alias("r3"), ret(126).alias("r6"))
            .groupBy("sector").agg(F.max_by(F.struct("r1", "r3", "r6"), "date").alias("l")).select("sector", "l.*"))
    li = (lens.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"))
          .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("a")))
    wt = li.join(lens.dims(spark, sf), "ticker").groupBy("sector").agg(F.sum("a").cast("double").alias("a"))
    one = Window.partitionBy(F.lit(0))  # one row per sector
    j = last.join(wt, "sector").select("sector", "r1", "r3", "r6", F.row_number().over(one.orderBy(F.desc("r1"), "sector")).alias("rank"),
                                       (F.col("a") * 100 / F.sum("a").over(one)).alias("weight"))
    gap = (F.col("weight") < 3) & (F.col("rank") <= 5) & (F.col("r1") > 0)
    return j.select("sector", r6("r1"), r6("r3"), r6("r6"), F.col("rank").cast("long").alias("rank"), r6("weight"), gap.alias("is_gap"),
                    F.when(gap, F.when((F.col("rank") <= 3) & (F.col("weight") < 1), "HIGH").otherwise("MEDIUM")).alias("urgency"))


@query("t30_regime_transition", ctes=("reviews",), sql="""
d AS (SELECT date, round(avg(conviction), 1) AS score, row_number() OVER (ORDER BY date) AS n FROM reviews GROUP BY date),
m AS (SELECT *, avg(score) OVER (ORDER BY date ROWS 2 PRECEDING) AS s, avg(score) OVER (ORDER BY date ROWS 6 PRECEDING) AS l, score - lag(score) OVER (ORDER BY date) AS dl FROM d)
SELECT date, round(s, 6) AS short_ma, round(l, 6) AS long_ma, round(dl, 6) AS recent_delta,
  CASE WHEN n < 3 THEN 'INSUFFICIENT_DATA' WHEN s - l > 2 THEN 'IMPROVING' WHEN s - l < -2 THEN 'DETERIORATING' ELSE 'STABLE' END AS transition FROM m""")
def regime_transition(spark, sf):
    """At every run date, not only the last. One row per run date."""
    d = lens.reviews(spark, sf).groupBy("date").agg(F.round(F.avg("conviction"), 1).alias("score")).withColumn("_m", F.lit(0))
    w = Window.partitionBy("_m").orderBy("date")
    s, lo = F.avg("score").over(w.rowsBetween(-2, 0)), F.avg("score").over(w.rowsBetween(-6, 0))
    d = d.select("date", s.alias("s"), lo.alias("l"), (F.col("score") - F.lag("score").over(w)).alias("dl"), F.row_number().over(w).alias("n"))
    sp = F.col("s") - F.col("l")
    return d.select("date", r6("s", "short_ma"), r6("l", "long_ma"), r6("dl", "recent_delta"),
                    F.when(F.col("n") < 3, "INSUFFICIENT_DATA").when(sp > 2, "IMPROVING").when(sp < -2, "DETERIORATING").otherwise("STABLE").alias("transition"))


@query("t31_regime_momentum", ctes=("reviews", "market"), sql="""
a AS (SELECT date, avg(CASE WHEN rsi < 30 THEN 1.0 ELSE 0 END) AS os, avg(CASE WHEN rsi > 70 THEN 1.0 ELSE 0 END) AS ob, avg(rsi) AS ar,
  count(*) FILTER (sentiment = 'NET_BUYING') AS nb, count(*) FILTER (sentiment = 'NET_SELLING') AS ns,
  count(*) FILTER (news_impact LIKE '%POSITIVE') AS pos, count(*) FILTER (news_impact LIKE '%NEGATIVE') AS neg FROM reviews GROUP BY date),
s AS (SELECT a.date, (CASE WHEN os >= 0.2 OR ar < 35 THEN 2 WHEN os >= 0.1 OR ar < 40 THEN 1 ELSE 0 END) - (CASE WHEN ob >= 0.2 THEN 1 ELSE 0 END)
 + (CASE WHEN nb + ns = 0 THEN 0 WHEN nb / (nb + ns) >= 0.8 THEN 2 WHEN nb / (nb + ns) >= 0.6 THEN 1 WHEN nb / (nb + ns) <= 0.3 THEN -2 WHEN nb / (nb + ns) <= 0.4 THEN -1 ELSE 0 END)
 + (CASE WHEN m.vix > 35 THEN -1 WHEN m.vix < 18 THEN 1 ELSE 0 END) + (CASE WHEN pos > neg + 1 THEN 1 WHEN neg > pos + 1 THEN -1 ELSE 0 END) AS score
 FROM a LEFT JOIN market m ON m.date = a.date)
SELECT date, cast(score as bigint) AS score, CASE WHEN score >= 4 THEN 'IMPROVING' WHEN score <= -4 THEN 'DETERIORATING' ELSE 'STABLE' END AS momentum FROM s""")
def regime_momentum(spark, sf):
    r = lens.reviews(spark, sf)
    share = lambda c: F.avg(c.cast("double"))
    n = lambda c: F.count(F.when(c, 1))
    a = r.groupBy("date").agg(share(F.col("rsi") < 30).alias("os"), share(F.col("rsi") > 70).alias("ob"), F.avg("rsi").alias("ar"),
                              n(F.col("sentiment") == "NET_BUYING").alias("nb"), n(F.col("sentiment") == "NET_SELLING").alias("ns"),
                              n(F.col("news_impact").endswith("POSITIVE")).alias("pos"), n(F.col("news_impact").endswith("NEGATIVE")).alias("neg"))
    # market: one row per trading day
    a = a.join(F.broadcast(lens.market(spark, sf).select("date", "vix")), "date", "left")
    br = F.try_divide("nb", F.col("nb") + F.col("ns"))
    breadth = F.when((F.col("os") >= 0.2) | (F.col("ar") < 35), 2).when((F.col("os") >= 0.1) | (F.col("ar") < 40), 1).otherwise(0)
    insiders = F.when(br >= 0.8, 2).when(br >= 0.6, 1).when(br <= 0.3, -2).when(br <= 0.4, -1).otherwise(0)
    level = F.when(F.col("vix") > 35, -1).when(F.col("vix") < 18, 1).otherwise(0)
    news = F.when(F.col("pos") > F.col("neg") + 1, 1).when(F.col("neg") > F.col("pos") + 1, -1).otherwise(0)
    d = a.select("date", (breadth - F.when(F.col("ob") >= 0.2, 1).otherwise(0) + insiders + level + news).cast("long").alias("score"))
    return d.withColumn("momentum", F.when(F.col("score") >= 4, "IMPROVING").when(F.col("score") <= -4, "DETERIORATING").otherwise("STABLE"))


@query("t32_opportunity_streak", ctes=("signals",), sql="""
runs AS (SELECT date, row_number() OVER (ORDER BY date) AS run FROM (SELECT DISTINCT date FROM signals)),
o AS (SELECT ticker, date, run, run - row_number() OVER (PARTITION BY ticker ORDER BY run) AS grp FROM signals JOIN runs USING (date) WHERE signal = 'B')
SELECT ticker, date, row_number() OVER (PARTITION BY ticker, grp ORDER BY run) AS streak, min(date) OVER (PARTITION BY ticker) AS first_seen,
  least((row_number() OVER (PARTITION BY ticker, grp ORDER BY run) - 1) * 3, 9) AS bonus FROM o""")
def streak(spark, sf):
    s = lens.signals(spark, sf).select("ticker", "date", "signal")
    runs = s.select("date").distinct().withColumn("run", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))  # one row per day
    o = s.where("signal = 'B'").join(F.broadcast(runs), "date")
    w = Window.partitionBy("ticker").orderBy("run")
    o = o.withColumn("grp", F.col("run") - F.row_number().over(w)).withColumn("first_seen", F.min("date").over(Window.partitionBy("ticker")))
    st = F.row_number().over(Window.partitionBy("ticker", "grp").orderBy("run")).cast("long")
    return o.select("ticker", "date", st.alias("streak"), "first_seen", F.least((st - 1) * 3, F.lit(9).cast("long")).alias("bonus"))


@query("t33_kill_thesis_cooldown", ctes=("log",), sql="""
SELECT ticker, max(ts) AS last_trigger, max(ts) + INTERVAL 28 DAY >= TIMESTAMP '2024-02-15' AS in_cooldown,
  greatest(0, cast(floor(epoch(max(ts) + INTERVAL 28 DAY - TIMESTAMP '2024-02-15') / 86400) as bigint)) AS days_left
FROM log WHERE signal = 'S' GROUP BY ticker""")
def cooldown(spark, sf):
    return thesis_cooldown(lens.log(spark, sf).where("signal = 'S'"), F.lit("2024-02-15").cast("timestamp"))


def thesis_cooldown(triggers, now, days=28):
    """Days left of the pause that starts with a ticker's latest trigger."""
    end = F.col("last_trigger") + F.expr(f"INTERVAL {days} DAY")
    left = F.floor((F.unix_micros(end) - F.unix_micros(now)) / F.lit(86400e6))
    return triggers.groupBy("ticker").agg(F.max("ts").alias("last_trigger")).select(
        "ticker", "last_trigger", (end >= now).alias("in_cooldown"), F.greatest(F.lit(0).cast("long"), left).alias("days_left"))


@query("t37_rebalance_grid", ctes=("bars",), sql="""
SELECT ticker, date, bar_no, round(lag(close, 21) OVER w / lag(close, 252) OVER w - 1, 6) AS score, round(lead(close, 21) OVER w / close - 1, 6) AS fwd
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date) QUALIFY bar_no >= 253 AND (bar_no - 253) % 21 = 0 AND lead(close, 21) OVER w IS NOT NULL""")
def rebalance_grid(spark, sf):
    """Score from bars up to t, return over [t, t+21]: every 21 bars after warm-up."""
    px = ts.with_bar_no(lens.prices(spark, sf)).withColumn("score", ts.momentum_12_1())
    px = px.withColumn("fwd", F.lead("close", 21).over(ts.by_bar()) / F.col("close") - 1)
    return px.where("bar_no >= 253 and (bar_no - 253) % 21 = 0 and fwd is not null").select(
        "ticker", "date", F.col("bar_no").cast("long").alias("bar_no"), r6("score"), r6("fwd"))
