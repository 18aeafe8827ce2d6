"""Reports over outcomes and metrics: calibration with a walk-forward split, findings, suggestions, reasons, long weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Share of days to train on, points of hit rate that hint at overfitting, hit rates that BUY and SELL need.
TRAIN, OVERFIT_PP, BUY_HIT, SELL_HIT = 0.7, 15.0, 50.0, 60.0


def test_start(rows: DataFrame, date: str = "date", share: float = TRAIN) -> DataFrame:
    """One row, ``test_from``: the day from which the later part of the days begins (days count, not rows)."""
    days = rows.select(date).distinct()
    w = Window.partitionBy(F.lit(0))  # one row per day of the calendar
    d = days.select(date, F.row_number().over(w.orderBy(date)).alias("i"), F.count("*").over(w).alias("n"))
    return d.where(F.col("i") == F.floor(F.col("n") * share) + 1).select(F.col(date).alias("test_from"))


def hits(action: Column, ret: Column) -> Column:
    """Whether an action was right, in per cent."""
    right = (action.isin("BUY", "ADD") & (ret > 0)) | (action.isin("SELL", "TRIM") & (ret < 0)) | ((action == "HOLD") & (F.abs(ret) < 5))
    return F.when(ret.isNotNull(), F.when(right, 100.0).otherwise(0.0))


def calibration(rows: DataFrame) -> DataFrame:
    """G03 over (action, date, horizon, ret, cost): count, hit rate and mean return per action and horizon, before and after costs, over
    all days and over the later part alone. A row is exploded into the groups it belongs to and summed once."""
    d = rows.join(F.broadcast(test_start(rows)), how="left")  # one row
    groups = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(n).alias("net"), F.when(c, F.col("ret") - (F.col("cost") if n else 0.0)).alias("r"), c.alias("own")) for s, c in (("all", F.lit(True)), ("test", F.coalesce(F.col("date") >= F.col("test_from"), F.lit(False)))) for n in (False, True)]))
    x = d.select("action", "horizon", groups.alias("g")).where("g.own").select("action", "horizon", "g.scope", "g.net", "g.r")
    return x.groupBy("scope", "horizon", "net", "action").agg(F.count("*").alias("n"), F.avg(hits(F.col("action"), F.col("r"))).alias("hit_rate"), F.avg("r").alias("avg_return"))


def findings(report: DataFrame, horizon: int = 30) -> DataFrame:
    """What the gross figures at ``horizon`` ask for; one row per finding, or one that says all is well."""
    at = lambda scope, action, c: F.max(F.when((F.col("scope") == scope) & (F.col("action") == action), F.col(c)))
    g = report.where((F.col("horizon") == horizon) & ~F.col("net")).agg(at("all", "BUY", "hit_rate").alias("buy"), at("all", "SELL", "hit_rate").alias("sell"), at("all", "BUY", "avg_return").alias("ret"), at("test", "BUY", "hit_rate").alias("later"))
    over = (F.col("later") > 0) & (F.col("buy") - F.col("later") > OVERFIT_PP)
    tests = [("buy_hit_rate_low", F.coalesce(F.col("buy") < BUY_HIT, F.lit(True))), ("sell_hit_rate_low", F.coalesce(F.col("sell") < SELL_HIT, F.lit(True))), ("buy_return_negative", F.coalesce(F.col("ret") < 0, F.lit(False))), ("overfitting", F.coalesce(over, F.lit(False)))]
    found = F.filter(F.array(*[F.when(t, n) for n, t in tests]), lambda x: x.isNotNull())
    return g.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("within_range")))).alias("finding"))


def suggestions(metrics: DataFrame, quality: DataFrame) -> DataFrame:
    """G25 over metric figures (metric, ratio) and data quality (tier, sector, rate; NULL: all): category, priority, title, figure."""
    weak = F.col("ratio").between(0, 1.1) & (F.col("ratio") > 0) & (F.col("ratio") < 1.1)
    row = lambda c, p, t: F.struct(F.lit(c).alias("category"), F.lit(p).alias("priority"), F.lit(t).alias("title"))
    m = metrics.select(F.when(weak & (F.col("metric") == "peg"), row("metric", "HIGH", "remove_peg")).when(weak & (F.col("metric") == "w52"), row("metric", "LOW", "reconsider_52w"))
                       .when(F.col("ratio") > 1.5, row("metric", "LOW", "keep_strong_metric")).alias("s"), F.col("metric").alias("subject"), F.col("ratio").alias("figure"))
    whole = F.col("tier").isNull() & F.col("sector").isNull()
    q = quality.select(F.when(whole & (F.col("rate") > 50), row("data", "HIGH", "address_inconclusive")).when((F.col("tier") == "small") & (F.col("rate") > 40), row("threshold", "MEDIUM", "relax_small_analysts")).alias("s"),
                       F.coalesce("tier", F.lit("all")).alias("subject"), F.col("rate").alias("figure"))
    return m.unionByName(q).where("s is not null").select("s.*", "subject", "figure")


def reasons_not_owned(upside: Column, buy_pct: Column, insiders: Column, at_high: Column, beta: Column, pef: Column) -> Column:
    """Why a candidate may not be held."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    tests = [("limited_upside", z(upside) < 15), ("mixed_sentiment", z(buy_pct) < 75), ("insiders_sell", insiders == "NET_SELLING"), ("not_at_high", ~at_high), ("high_beta", beta > 1.5), ("rich", pef > 30)]
    found = F.filter(F.array(*[F.when(t, n) for n, t in tests]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("capacity_or_timing")))


def long_weights(positions: DataFrame) -> DataFrame:
    """(ticker, weight) of long rows of (symbol, is_buy, pct), all texts as files give them: ``false``, ``0`` and ``no`` are short, a missing flag is long,
    blank symbols are skipped, an unreadable share is 0; shares of one symbol are added."""
    short = F.lower(F.trim("is_buy")).isin("false", "0", "no")
    d = positions.where(~F.coalesce(short, F.lit(False))).select(F.trim("symbol").alias("ticker"), (F.coalesce(F.expr("try_cast(pct AS double)"), F.lit(0.0)) / 100).alias("w"))
    return d.where("ticker <> ''").groupBy("ticker").agg(F.sum("w").alias("weight"))


def trim_gate(action: Column, regime: Column, momentum: Column, tech: Column, rsi: Column, position_pct: Column, killed: Column, warned: Column) -> Column:
    """P50: a TRIM that only follows a trend becomes HOLD in a calm, improving market; one that risk asks for stands."""
    risk = F.coalesce(killed, F.lit(False)) | F.coalesce(warned, F.lit(False)) | F.coalesce(rsi >= 80, F.lit(False)) | F.coalesce(position_pct >= 6, F.lit(False)) | F.coalesce(tech.isin("EXIT_SOON", "AVOID"), F.lit(False))
    calm = F.coalesce((regime == "RISK_ON") & momentum.isin("IMPROVING", "STRONG_IMPROVING"), F.lit(False))
    return F.when((action == "TRIM") & ~risk & calm, "HOLD").otherwise(action)
