"""Market regime: features per day, label, confirmation, overlay. One row per trading day."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feature weights, score bands, exposures.
FEATURE_WEIGHTS = {"vix_score": 0.30, "term_structure": 0.15, "spy_momentum": 0.25,
                   "spy_drawdown": 0.15, "vix_trend": 0.15}
VIX_BANDS = [(13, 90.0), (16, 75.0), (20, 60.0), (25, 45.0), (30, 30.0), (40, 15.0)]
REGIME_EXPOSURE = {"risk_on": 1.00, "neutral": 0.90, "risk_off": 0.65, "crisis": 0.40}
FALLBACK = "neutral"
POSITION_MULTIPLIER = {"risk_on": 1.00, "neutral": 1.00, "risk_off": 0.75, "crisis": 0.50}
VIX_LEVELS = [(15, "low"), (25, "normal"), (35, "elevated")]


def steps(x: Column, bands, otherwise) -> Column:
    """Value of the first band whose bound lies above ``x``."""
    c = None
    for bound, val in bands:
        c = F.when(x < bound, val) if c is None else c.when(x < bound, val)
    return c.otherwise(otherwise)


def lookup(key: Column, table: dict, otherwise=None) -> Column:
    c = None
    for k, v in table.items():
        c = F.when(key == k, v) if c is None else c.when(key == k, v)
    return c.otherwise(otherwise) if otherwise is not None else c


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def _dec(x: Column) -> Column:
    """Scores have one decimal; weighting them exactly keeps a half from being rounded at random."""
    return x.cast("decimal(6,1)")


def _tenths(x: Column) -> Column:
    return F.round(x, 1).cast("double")


def regime_inputs(market: DataFrame, lookback: int = 504) -> DataFrame:
    """Trailing volatility percentile, 20/60-bar returns, 252-bar high, 5-bar lag, two-year return.

    The market table has one row per trading day, so its one window partition is as long as
    the calendar and no longer.
    """
    w = Window.partitionBy("_m").orderBy("date")
    back = lambda n: w.rowsBetween(-n, 0)
    d = market.withColumn("_m", F.lit(0)).withColumn("n", F.row_number().over(w))
    hist = F.collect_list("vix").over(back(lookback))  # at most lookback + 1 values
    return d.select(
        "date", "spy", "vix", "vix3m", "n",
        F.size(hist).alias("hist_n"),
        (F.size(F.filter(hist, lambda v: v < F.col("vix"))) * 100.0 / F.size(hist)).alias("vix_pctile"),
        ((F.col("spy") - F.lag("spy", 20).over(w)) / F.lag("spy", 20).over(w) * 100).alias("ret20"),
        ((F.col("spy") - F.lag("spy", 60).over(w)) / F.lag("spy", 60).over(w) * 100).alias("ret60"),
        F.max("spy").over(back(252)).alias("high_252"),
        F.coalesce(F.lag("vix", 5).over(w), F.col("vix")).alias("vix_5_ago"),
        F.when(F.col("n") >= 504, (F.col("spy") - F.lag("spy", 503).over(w)) / F.lag("spy", 503).over(w) * 100)
         .when(F.col("n") >= 252, (F.col("spy") - F.lag("spy", 251).over(w)) / F.lag("spy", 251).over(w) * 100)
         .alias("ret_2y"))


def regime_labels(inputs: DataFrame) -> DataFrame:
    """Five 0-100 scores, their weighted mean and the label."""
    pct = F.when(F.col("hist_n") >= 20, F.col("vix_pctile")).otherwise(50.0)
    vix = F.col("vix")
    mom = 0.6 * F.coalesce(F.col("ret20"), F.lit(0.0)) + 0.4 * F.coalesce(F.col("ret60"), F.lit(0.0))
    d = inputs.select(
        "*",
        _tenths((_dec(F.round(100.0 - pct, 1)) + _dec(steps(vix, VIX_BANDS, 5.0))) * F.lit(Decimal("0.5"))).alias("vix_score"),
        F.when(F.col("vix3m") > 0, F.round(_clip(50 + (1.0 - vix / F.col("vix3m")) * 150), 1)).otherwise(50.0).alias("term_structure"),
        F.round(_clip(50 + mom * 5), 1).alias("spy_momentum"),
        F.round(_clip(85 + (F.col("spy") - F.col("high_252")) / F.col("high_252") * 100 * 4), 1).alias("spy_drawdown"),
        F.round(_clip(50 - (vix - F.col("vix_5_ago")) / F.col("vix_5_ago") * 100 * 1.75), 1).alias("vix_trend"))
    score = reduce(add, [_dec(F.col(n)) * F.lit(Decimal(str(w))) for n, w in FEATURE_WEIGHTS.items()])
    d = d.withColumn("score", _tenths(score))
    crisis = (vix > 30) & (F.col("term_structure") < 30)
    label = F.when(crisis, "crisis").otherwise(
        steps(F.col("score"), [(20, "crisis"), (40, "risk_off"), (60, "neutral")], "risk_on"))
    return (d.withColumn("regime", label)
            .withColumn("score", F.when(crisis, F.least(F.col("score"), F.lit(15.0))).otherwise(F.col("score")))
            .withColumn("bear", F.coalesce(F.col("ret_2y") < 0, F.lit(False))))


def confirmed(labels: DataFrame, days: int, fallback: str = "neutral") -> DataFrame:
    """The label that most recently held for ``days`` consecutive rows."""
    w = Window.partitionBy("_m").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = labels.withColumn("_m", F.lit(0))
    d = d.withColumn("_new", F.when(F.lag("regime").over(w) == F.col("regime"), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(upto))
    d = d.withColumn("run_len", F.row_number().over(Window.partitionBy("_m", "_run").orderBy("date")))
    hit = F.when(F.col("run_len") >= max(1, days), F.col("regime"))
    return (d.withColumn("confirmed", F.coalesce(F.last(hit, ignorenulls=True).over(upto), F.lit(fallback)))
            .drop("_m", "_new", "_run"))


def overlay_stats(daily: DataFrame) -> DataFrame:
    """Totals of an exposure overlay; input (date, ret, mult), one row per trading day."""
    w = Window.partitionBy("_m").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("_m", F.lit(0)).withColumn("mult", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mult"))))
    d = d.withColumn("strat", F.col("mult") * F.col("ret")).withColumn("lg", F.sum(F.ln(1 + F.col("strat"))).over(upto))
    d = d.withColumn("equity", F.exp("lg")).withColumn("peak", F.max("equity").over(upto))
    d = d.withColumn("_sw", F.when(F.lag("mult").over(w) != F.col("mult"), 1).otherwise(0))
    g = d.agg(F.count("*").alias("n"), F.max_by("equity", "date").alias("eq"), F.stddev_samp("strat").alias("sd"),
              F.avg("strat").alias("m"), F.min((F.col("equity") - F.col("peak")) / F.col("peak")).alias("max_drawdown"),
              F.avg((F.col("mult") < 1).cast("double")).alias("pct_derisked"), F.sum("_sw").alias("switches"))
    return g.select("n", (F.col("eq") - 1).alias("total_return"), (F.pow("eq", 252.0 / F.col("n")) - 1).alias("cagr"),
                    (F.col("sd") * F.sqrt(F.lit(252.0))).alias("vol"),
                    F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
                    "max_drawdown", "pct_derisked", "switches")
