"""Review rules: conviction, action, lenses, decay, audits. Rows in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Component weights, action cuts, decay parameters.
CONVICTION_WEIGHTS = {"composite": 0.40, "upside": 0.25, "buy": 0.20, "quality": 0.15}
ACTION_CUTS = {"buy": 65, "add": 70, "hold": 40, "trim": 30}
DECAY = {"rate": 0.95, "floor": 0.70, "start_fraction": 0.5, "min_days": 7}
DROP_PCT, RISE_PCT = -8.0, 8.0


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def conviction(composite: Column, upside: Column, buy: Column, roe: Column, fcf: Column) -> Column:
    """Weighted components, a missing one counts as 50; quality steps by positive ROE and FCF."""
    pos = F.coalesce((roe > 0).cast("int"), F.lit(0)) + F.coalesce((fcf > 0).cast("int"), F.lit(0))
    quality = F.when(roe.isNull() & fcf.isNull(), 50.0).when(pos == 2, 100.0).when(pos == 1, 75.0).otherwise(0.0)
    half = F.lit(50.0)
    w = CONVICTION_WEIGHTS
    return _clip(w["composite"] * F.coalesce(composite, half) + w["upside"] * F.coalesce(_clip_null(upside), half) + w["buy"] * F.coalesce(_clip_null(buy), half) + w["quality"] * quality)


def _clip_null(x: Column) -> Column:
    return F.when(x.isNotNull(), _clip(x))


def action(conv: Column, held: Column, in_universe: Column) -> Column:
    """P44."""
    c = ACTION_CUTS
    return (F.when(~held, F.when(conv >= c["buy"], "BUY").otherwise("NONE")).when(~in_universe, "SELL").when(conv >= c["add"], "ADD")
            .when(conv >= c["hold"], "HOLD").when(conv >= c["trim"], "TRIM").otherwise("SELL"))


def lenses() -> dict[str, Column]:
    """Five rule lenses over snapshot columns; NULL fails a test."""
    c = F.col
    t = lambda x: F.coalesce(x, F.lit(False))
    v = lambda yes, no: F.when(t(yes), "approve").when(t(no), "reject").otherwise("neutral")
    return {
        "quality_value": v((c("roe") > 15) & (c("de") < 100) & (c("pet") > 0) & (c("pet") <= 25) & (c("beta") < 1.2), t(c("de") > 200) | t(c("pet") <= 0) | t(c("roe") <= 0)),
        "growth": v((c("eg") > 20) & (c("w52") >= 70), t(c("eg") < 0) | t(c("w52") < 40)),
        "margin_of_safety": v((c("upside") > 25) & (c("fcf") > 0) & (c("pet") > 0) & (c("pet") <= 15), t(c("fcf") < 0) | t(c("pet") > 40)),
        "macro_neutral": v(c("beta") < 0.8, c("beta") > 1.8),
        "fair_growth": v((c("peg") > 0) & (c("peg") < 1.5) & (c("eg") > 0), c("peg") > 3),
    }


def with_consensus(df: DataFrame) -> DataFrame:
    """Majority of the lenses, neutral ones left out, and the array of those that disagree."""
    ls = lenses()
    d = df.select("*", *[c.alias(f"_l_{n}") for n, c in ls.items()])
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_l_{n}").alias("v")) for n in ls])
    yes, no = F.size(F.filter(arr, lambda x: x["v"] == "approve")), F.size(F.filter(arr, lambda x: x["v"] == "reject"))
    d = d.withColumn("consensus", F.when(yes > no, "approve").when(no > yes, "reject").otherwise("split"))
    dis = F.transform(F.filter(arr, lambda x: (x["v"] != "neutral") & (F.col("consensus") != "split") & (x["v"] != F.col("consensus"))), lambda x: x["name"])
    return d.withColumn("dissent", dis).drop(*[f"_l_{n}" for n in ls])


def decayed(conv: Column, age_days: Column, horizon: Column, signal: Column) -> Column:
    """B and H only, weekly rate after half the horizon, never below the floor."""
    start = F.greatest(F.lit(float(DECAY["min_days"])), horizon * DECAY["start_fraction"])
    weeks = (age_days - start) / 7.0
    f = F.greatest(F.lit(DECAY["floor"]), F.pow(F.lit(DECAY["rate"]), weeks))
    return F.when(signal.isin("B", "H") & (age_days > start), conv * f).otherwise(conv.cast("double"))


def audit_class(ret: Column, days: Column) -> Column:
    """What happened since the trigger."""
    return (F.when(ret.isNull() | (days < 7), "UNVERIFIED").when(ret <= DROP_PCT, "TRUE_POSITIVE").when(ret >= RISE_PCT, "FALSE_POSITIVE").otherwise("INCONCLUSIVE"))


# Regime discounts, trim factor points, action cuts per label.
RISK_OFF_FACTOR = {"IMPROVING": 0.90, "DETERIORATING": 0.80}
TRIM_POINTS = {"technical": 12, "macro": 8, "risk": 7, "beta": 4, "rsi": 4}
CUTS = {"B_add": 55, "H_add": 70, "H_trim": 35, "S_sell": 60}


def with_base_conviction(df: DataFrame, momentum: Column) -> DataFrame:
    """Logistic of the bull share, regime discount, then floors and caps by label. Each step
    truncates to a whole number, so the steps are separate projections."""
    c = F.col
    fl = lambda x: F.floor(x).cast("long")
    d = df.withColumn("_a", F.greatest(F.lit(30), F.least(F.lit(80), fl(30 + 50 / (1 + F.exp(-(c("bull_pct") - 50) / 8.33))))))
    off = F.when(momentum == "IMPROVING", RISK_OFF_FACTOR["IMPROVING"]).when(momentum == "DETERIORATING", RISK_OFF_FACTOR["DETERIORATING"]).otherwise(0.85)
    k = F.when(c("regime") == "RISK_OFF", off).when(c("regime") == "CAUTIOUS", F.when(c("signal") == "B", 0.95).otherwise(0.92))
    d = d.withColumn("_a", F.when(k.isNotNull(), fl(c("_a") * k)).otherwise(c("_a")))
    over = c("_a") - 55
    b = F.when(over > 0, 55 + fl(over / 2) + over % 2).otherwise(55)
    d = d.withColumn("_b", F.when(c("fund_score") >= 80, F.greatest(b + 10, F.lit(60))).when(c("fund_score") >= 65, F.greatest(b + 5, F.lit(55))).otherwise(b))
    prem = F.when(c("bull_pct") >= 80, F.least(F.lit(8), fl((c("bull_pct") - 75) / 5))).otherwise(0)
    ex = F.when((c("excess_exret") > 40) & (c("bull_pct") < 65), -3).when(c("excess_exret") >= 5, F.least(F.lit(5), fl(c("excess_exret") / 4))).otherwise(0)
    bear = (100 - c("bull_pct")) / 100
    sell = F.when(bear >= 0.80, 85).when(bear >= 0.40, fl(50 + (bear - 0.40) * 87.5)).otherwise(50)
    base = F.when(c("signal") == "B", c("_b") + prem + ex).when(c("signal") == "S", sell).otherwise(F.least(c("_a"), F.lit(70)))
    return d.withColumn("base", base.cast("long")).drop("_a", "_b")


def active_points(waterfall: Column) -> Column:
    """Sum of the modifiers that are not switched off (those carry a tilde)."""
    on = F.map_filter(waterfall, lambda k, v: ~k.startswith("~"))
    return F.aggregate(F.map_values(on), F.lit(0).cast("long"), lambda a, x: a + x)


def floored(conv: Column, bulls: Column) -> Column:
    """B rows never fall below a floor that rises with quality hits."""
    c = F.col
    hits = (F.when(bulls >= 5, 2).when(bulls >= 4, 1).otherwise(0) + F.when(c("fund_score") >= 80, 2).when(c("fund_score") >= 70, 1).otherwise(0)
            + F.when(c("buy_pct") >= 80, 1).when(c("buy_pct") >= 70, 1).otherwise(0))
    f = F.when(c("signal") == "B", F.when(hits > 0, F.least(F.lit(55), 40 + hits * 3)).otherwise(40)).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.greatest(conv, f)))


def review_action(conv: Column, signal: Column) -> Column:
    """P49."""
    return (F.when(signal == "S", F.when(conv >= CUTS["S_sell"], "SELL").otherwise("TRIM")).when(signal == "B", F.when(conv >= CUTS["B_add"], "ADD").otherwise("HOLD"))
            .when(conv >= CUTS["H_add"], "ADD").when(conv >= CUTS["H_trim"], "HOLD").otherwise("TRIM"))


def hold_tier(conv: Column) -> Column:
    return F.when(conv >= 55, "STRONG").when(conv >= 40, "STANDARD").otherwise("WEAK")


def trim_conviction() -> Column:
    """Factor points sorted down, each weighted 0.7 times the one before, truncated."""
    c = F.col
    t = TRIM_POINTS
    pts = F.array(F.when(c("tech_signal").isin("EXIT_SOON", "AVOID"), t["technical"]), F.when(c("macro_fit") == "UNFAVORABLE", t["macro"]), F.when(c("risk_warning"), t["risk"]), F.when(c("beta") > 1.5, t["beta"]), F.when(c("rsi") > 70, t["rsi"]))
    pts = F.sort_array(F.filter(pts, lambda x: x.isNotNull()), asc=False)
    total = F.aggregate(pts, F.struct(F.lit(50).cast("long").alias("s"), F.lit(1.0).alias("w")), lambda a, p: F.struct((a["s"] + F.floor(p * a["w"])).alias("s"), (a["w"] * 0.7).alias("w")), lambda a: a["s"])
    return F.least(total - F.when(c("fund_score") >= 80, 10).otherwise(0) - F.when(c("census_view") == "ALIGNED", 5).otherwise(0), F.lit(80).cast("long"))


def book_share(conv: Column, beta: Column, peers: Column, buy_pct: Column) -> Column:
    """3 % times a conviction step, less for beta, peers and crowding, within 1 to 5 %."""
    s = 3.0 * F.when(conv >= 80, 1.5).when(conv >= 65, 1.2).when(conv >= 50, 1.0).otherwise(0.7)
    s = (s * F.when(beta > 1.5, 0.8).otherwise(1.0) - peers * 0.5) * F.when(buy_pct > 90, 0.9).otherwise(1.0)
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), s))
