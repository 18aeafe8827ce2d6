"""Aggregates over realised outcomes: rows with (signal, horizon, ret, alpha, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import _safe_join, moments_corr, order_statistics, percentiles, spearman

# Spread in basis points per tier, one way.
ROUND_TRIP_BPS = {"mega": 9.0, "large": 12.0, "mid": 18.0, "small": 30.0, "micro": 60.0}
BULLISH, BEARISH = ("BUY", "ADD"), ("SELL", "TRIM")


def lookup(key: Column, table: dict, otherwise=None) -> Column:
    c = None
    for k, v in table.items():
        c = F.when(key == k, v) if c is None else c.when(key == k, v)
    return c if otherwise is None else c.otherwise(otherwise)


def round_trip_pct(tier: Column, days: Column | int = 30, apr: float = 0.0) -> Column:
    """Spread both ways plus financing for the holding period."""
    d = F.lit(days) if isinstance(days, int) else days
    return F.round(lookup(tier, ROUND_TRIP_BPS, 18.0) / 100 * 2 + apr * d / 365.0, 3)


def rate(c: Column) -> Column:
    """Share in percent, of the rows where the test has an answer."""
    return F.avg(F.when(c, 100.0).when(~c, 0.0))


def is_hit(signal: Column, x: Column, band: float) -> Column:
    return F.when(signal == "B", x > 0).when(signal == "S", x < 0).otherwise(F.abs(x) < band)


def by_action_hit(action: Column, x: Column, band: float) -> Column:
    return (F.when(action.isin(*BULLISH), x > 0).when(action.isin(*BEARISH), x < 0).otherwise(F.abs(x) < band))


def grouping_report(rows: DataFrame) -> DataFrame:
    """Statistics per horizon by signal, tier, region and signal x tier, from one GROUPING SETS pass over cells.

    Groups that mix signals are judged by their most frequent one (smallest label on ties), so
    the hits under each of the three readings are counted side by side and one is picked.
    """
    r = rows.withColumn("net", F.col("alpha") - round_trip_pct(F.col("tier"), F.col("horizon")))
    cols = ["horizon", "signal", "tier", "region"]
    sets = [["horizon", "signal"], ["horizon", "tier"], ["horizon", "region"], ["horizon", "signal", "tier"]]
    readings = {s: (is_hit(F.lit(s), F.col("ret"), 5.0), is_hit(F.lit(s), F.col("alpha"), 2.0)) for s in "BHS"}
    means = {"mean_return": F.col("ret"), "avg_alpha": F.col("alpha"), "net_alpha": F.col("net")}
    for s, (h, a) in readings.items():
        means |= {f"h_{s}": F.when(h, 100.0).when(~h, 0.0), f"a_{s}": F.when(a, 100.0).when(~a, 0.0)}
    counts = {"n": F.lit(1), **{f"c_{s}": F.when(F.col("signal") == s, 1) for s in readings}}
    # rows are summed per cell once; the groupings add up cells
    cells = r.groupBy(*cols).agg(*[F.count(c).alias(k) for k, c in counts.items()], *[f(c).alias(f"{f.__name__}_{k}") for k, c in means.items() for f in (F.sum, F.count)])
    g = cells.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        *[F.sum(k).alias(k) for k in counts], *[F.try_divide(F.sum(f"sum_{k}"), F.sum(f"count_{k}")).alias(k) for k in means])
    top = F.greatest("c_B", "c_H", "c_S")
    mode = F.when(F.col("c_B") == top, "B").when(F.col("c_H") == top, "H").otherwise("S")
    g = g.withColumn("mode", mode)
    m = percentiles(r, cols, "ret", {"median_return": 0.5}, sets).drop("n")
    j = _safe_join(g, m, cols)
    return j.select(*cols, "n", lookup(F.col("mode"), {s: F.col(f"h_{s}") for s in "BHS"}).alias("hit_rate"),
                    lookup(F.col("mode"), {s: F.col(f"a_{s}") for s in "BHS"}).alias("alpha_hit_rate"),
                    "mean_return", "median_return", "avg_alpha", "net_alpha", (F.col("n") < 30).alias("low_sample"))


def action_performance(rows: DataFrame, horizon_days: int = 30) -> DataFrame:
    """Per action hits, alpha hits, information ratio, rank and linear correlation of
    conviction with alpha, the upper median, best and worst."""
    act = F.col("action")
    g = rows.groupBy("action").agg(
        F.count("*").alias("n"), rate(by_action_hit(act, F.col("ret"), 5.0)).alias("hit_rate"),
        rate(by_action_hit(act, F.col("alpha"), 2.0)).alias("alpha_hit_rate"), F.avg("ret").alias("avg_return"),
        F.avg("alpha").alias("avg_alpha"), F.stddev_pop("alpha").alias("_sd"), F.count("alpha").alias("_na"),
        moments_corr("conviction", "alpha").alias("pearson"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
        rate(F.col("ret") > 0).alias("positive_pct"))
    rho = spearman(rows, ["action"], "conviction", "alpha").select("action", F.col("rho").alias("spearman"))
    um = upper_medians(rows, ["action"], "ret")
    ir = F.when((F.col("_na") >= 3) & (F.col("_sd") > 0),
                F.col("avg_alpha") / F.col("_sd") * F.sqrt(F.lit(365.0 / horizon_days)))
    return (g.withColumn("information_ratio", ir).drop("_sd", "_na").join(rho, "action").join(um, "action"))


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element ``n div 2`` of the sorted values (the upper one of two middles)."""
    return order_statistics(rows, keys, value, {"upper_median": lambda n: F.floor(n / 2)}).drop("n")
