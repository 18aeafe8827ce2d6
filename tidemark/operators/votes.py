"""Reviewers' votes and the small rule tables around them. Columns in, columns out."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of each reviewer's vote; a neutral census counts with its old weight.
VOTE = {"fundamental": 1.25, "technical": 0.75, "macro": 0.75, "census": 1.25, "news": 1.00, "sentiment": 0.75}
NEUTRAL_CENSUS = 0.85


def _vote(bull, bear, directional, neutral) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(lit(bull).alias("bull"), lit(bear).alias("bear"), lit(directional).alias("directional"), lit(neutral).alias("neutral"))


def _lean(w: Column, bull: float, neutral: bool = False) -> Column:
    """A vote of weight ``w``, the share ``bull`` of it for."""
    return _vote(w * bull, w * (1 - bull), F.lit(0.0) if neutral else w, w if neutral else F.lit(0.0))


def votes() -> dict[str, Column]:
    """Each reviewer's vote as (bull, bear, directional, neutral), over fund_score, fund_synthetic, tech_signal, tech_synthetic, rsi,
    tech_momentum, regime, macro_fit, census_view, census_div, news_impact, sentiment_view, sentiment_volume, risk_warning, signal, buy_pct."""
    c = F.col
    fund = F.when(c("fund_synthetic"), 0.5).otherwise(1.0) * VOTE["fundamental"]
    tech = F.when(c("tech_synthetic"), 0.5).otherwise(1.0) * VOTE["technical"]
    off, avoid = c("regime") == "RISK_OFF", c("tech_signal").isin("AVOID", "EXIT_SOON")
    macro = F.lit(VOTE["macro"])
    spread = F.when(F.coalesce(c("census_div"), F.lit(0.0)) == 0, 0.5).otherwise(F.least(F.abs("census_div") / 50.0, F.lit(1.0)))
    census, quiet = (0.5 + 0.5 * spread) * VOTE["census"], (0.5 + 0.5 * spread) * NEUTRAL_CENSUS
    mood = F.when(c("sentiment_volume").isin("HIGH", "MEDIUM"), 1.0).otherwise(0.5) * VOTE["sentiment"]
    risk = F.when((c("buy_pct") >= 90) & (c("fund_score") >= 70), 0.6).when(c("signal") == "S", 2.0).otherwise(1.2)
    more, less = (c("buy_pct") - 75) / 25 * 1.2, (25 - c("buy_pct")) / 25 * 1.2
    news = c("news_impact")
    return {
        "fundamental": F.when(c("fund_score") >= 70, _lean(fund, 1.0)).when(c("fund_score") < 45, _lean(fund, 0.0)).otherwise(_lean(fund, 0.5, True)),
        "technical": F.when(c("tech_signal") == "ENTER_NOW", _lean(tech, 1.0)).when(avoid & (c("rsi") < 30), _lean(tech, 0.5, True)).when(avoid & (c("rsi") < 40), _lean(tech, 0.4)).when(avoid, _lean(tech, 0.0))
        .when(c("tech_signal") == "WAIT_FOR_PULLBACK", _lean(tech, 0.6)).when((F.abs("tech_momentum") > 20) & off, _lean(tech, 0.5, True)).when(c("tech_momentum") > 20, _lean(tech, 0.7))
        .when(c("tech_momentum") < -20, _lean(tech, 0.3)).otherwise(_lean(tech, 0.5, True)),
        "macro": F.when(c("macro_fit") == "FAVORABLE", _lean(macro, 1.0)).when(c("macro_fit") == "UNFAVORABLE", _lean(macro, 0.0)).otherwise(_lean(macro, 0.5, True)),
        "census": F.when(c("census_view") == "ALIGNED", _lean(census, 1.0)).when(c("census_view") == "DIVERGENT", _lean(census, 0.41)).when(c("census_view") == "CENSUS_DIV", _lean(census, 0.71)).otherwise(_lean(quiet, 0.5, True)),
        "news": F.when(news.contains("HIGH_POSITIVE"), _vote(0.85, 0.15, 1, 0)).when(news.contains("LOW_POSITIVE"), _vote(0.65, 0.35, 1, 0)).when(news.contains("HIGH_NEGATIVE"), _vote(0, 1.3, 1.3, 0))
        .when(news.contains("LOW_NEGATIVE"), _vote(0.25, 0.75, 1, 0)).otherwise(_vote(0.5, 0.5, 0, 1)),
        "sentiment": F.when(c("sentiment_view") == "BULLISH", _lean(mood, 1.0)).when(c("sentiment_view") == "BEARISH", _lean(mood, 0.0)).otherwise(_lean(mood, 0.5, True)),
        "risk": F.when(c("risk_warning"), _vote(F.lit(0.0), risk, risk, F.lit(0.0))).when(c("regime") == "RISK_ON", _vote(0.6, 0.4, 0, 1)).when(off, _vote(0.4, 0.6, 0, 1)).otherwise(_vote(0.5, 0.5, 0, 1)),
        "consensus": F.when((c("buy_pct") >= 75) & (c("signal") == "B"), _lean(more, 1.0)).when((c("buy_pct") <= 25) & (c("signal") == "S"), _lean(less, 0.0)).otherwise(_vote(0, 0, 0, 0)),
    }


def with_votes(df: DataFrame) -> DataFrame:
    """Adds ``bull``, ``bear`` and ``directional``: the share of the weight that is not neutral."""
    own = votes()
    d = df.withColumns({f"_v_{k}": v for k, v in own.items()})
    total = lambda part: reduce(add, [F.col(f"_v_{k}.{part}") for k in own])
    return d.withColumns({"bull": total("bull"), "bear": total("bear"), "directional": total("directional") / (total("directional") + total("neutral"))}).drop(*[f"_v_{k}" for k in own])


def _rule(points, label) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(points).cast("int").alias("points"), lit(label).alias("label"))


def contradictions() -> Column:
    """(points, names) of reviewers who contradict each other, over macro_fit, tech_signal, fund_score, risk_warning, buy_pct, census_view, news_impact."""
    c = F.col
    good = c("news_impact").contains("POSITIVE")
    tests = [("macro_technical", (c("macro_fit") == "UNFAVORABLE") & (c("tech_signal") == "ENTER_NOW"), F.lit(5)),
             ("fundamental_risk", (c("fund_score") >= 70) & c("risk_warning"), F.when(c("buy_pct") >= 90, 0).otherwise(3)),
             ("census_news", (c("census_view") == "DIVERGENT") & good, F.lit(3)),
             ("macro_news", (c("macro_fit") == "UNFAVORABLE") & c("news_impact").contains("HIGH_POSITIVE"), F.lit(2))]
    points = reduce(add, [F.when(t, p).otherwise(0) for _, t, p in tests])
    names = F.filter(F.array(*[F.when(t, n) for n, t, _ in tests]), lambda x: x.isNotNull())
    return F.struct(points.cast("int").alias("points"), names.alias("names"))


def velocity(current: Column, previous: Column, days: Column) -> Column:
    """Points for a recent change of label (S < I < H < B)."""
    rank = lambda x: F.when(x == "S", 0).when(x == "H", 2).when(x == "B", 3).otherwise(1)
    d = rank(current) - rank(previous)
    return (F.when(previous.isNull() | days.isNull(), _rule(0, "NO_HISTORY")).when((d > 0) & (days <= 14), _rule(5, "ACCELERATING")).when((d > 0) & (days <= 30), _rule(3, "IMPROVING"))
            .when((d < 0) & (days <= 14), _rule(-5, "DETERIORATING")).when((d < 0) & (days <= 30), _rule(-3, "WEAKENING")).when((d == 0) & (days > 90), _rule(-2, "STALE")).otherwise(_rule(0, "STABLE")))


def surprise(pct: Column, beats: Column, trend: Column) -> Column:
    """Points for the last earnings surprise, more while beats grow, fewer while they shrink."""
    base = (F.when(pct.isNull(), _rule(0, "NO_DATA")).when((pct > 10) & (beats >= 2), _rule(10, "SERIAL_BEATER")).when(pct > 5, _rule(3, "BEAT")).when(pct < -10, _rule(-5, "BIG_MISS"))
            .when(pct < -5, _rule(-3, "MISS")).otherwise(_rule(0, "IN_LINE")))
    up = pct.isNotNull() & (trend == "ACCELERATING") & (beats >= 2)
    down = (trend == "DECELERATING") & base["label"].isin("SERIAL_BEATER", "BEAT")
    return (F.when(F.coalesce(up, F.lit(False)), _rule(F.least(base["points"] + 2, F.lit(10)), F.concat(base["label"], F.lit("_ACCEL"))))
            .when(F.coalesce(down, F.lit(False)), _rule(F.greatest(base["points"] - 2, F.lit(0)), F.concat(base["label"], F.lit("_DECEL")))).otherwise(base))


def freshness(age_hours: Column) -> Column:
    """Weight of a view by its age; unknown counts as fresh."""
    return F.when(age_hours.isNull() | (age_hours <= 1), 1.0).when(age_hours <= 4, 0.95).when(age_hours <= 12, 0.85).when(age_hours <= 24, 0.75).otherwise(0.6)


def overweight(current_pct: Column, limit: Column) -> Column:
    """(penalty, force_trim) of a position above its limit."""
    x = current_pct / limit
    row = lambda p, t: F.struct(F.lit(p).alias("penalty"), F.lit(t).alias("force_trim"))
    return (F.when(current_pct <= 0, row(0, False)).when(limit <= 0, row(20, True)).when(x <= 1, row(0, False)).when(x < 1.25, row(5, False)).when(x < 1.5, row(10, False)).when(x < 2, row(15, True)).otherwise(row(25, True)))


def with_opportunity_gate(df: DataFrame) -> DataFrame:
    """P52 over conviction, fund_score, tech_signal, macro_fit, census_view, regime, sector_positions: a new name needs others to confirm it. Adds
    ``confirmations``, ``fills_gap``, ``gated`` (conviction after discount, sector bonus and cap) and ``gate_action``."""
    c = F.col
    yes = lambda t: F.coalesce(t, F.lit(False)).cast("int")
    n = yes(c("fund_score") >= 70) + yes(c("tech_signal") == "ENTER_NOW") + yes(c("macro_fit") == "FAVORABLE") + yes(c("census_view") == "ALIGNED")
    d = df.withColumn("confirmations", n).withColumn("fills_gap", F.coalesce(c("sector_positions"), F.lit(0)) == 0)
    scale = F.when(c("regime") == "RISK_OFF", 0.5).when(c("regime") == "CAUTIOUS", 0.7).otherwise(1.0)
    off = F.when(c("confirmations") == 0, (scale * 15).cast("int")).when(c("confirmations") == 1, (scale * 10).cast("int")).otherwise(0)
    gated = F.greatest(F.lit(0), F.least(F.lit(75), c("conviction") - off + F.when(c("fills_gap"), 10).otherwise(0)))
    return d.withColumn("gated", gated.cast("long")).withColumn("gate_action", F.when(c("gated") >= 50, "BUY").otherwise("HOLD"))


def signal_strength(signal: Column, exret: Column) -> Column:
    """P55."""
    b = F.when(exret > 25, 90).when(exret >= 15, 75).otherwise(60)
    return F.when(signal == "B", b).when(signal == "S", 10).otherwise(40)


def census_strength(holders_pct: Column) -> Column:
    """P55."""
    return F.when(holders_pct >= 50, 90).when(holders_pct >= 30, 70).when(holders_pct >= 15, 50).when(holders_pct >= 5, 25).otherwise(10)


def divergence(score: Column) -> Column:
    """What the difference of both strengths says."""
    return (F.when(score > 40, "STRONG_SIGNAL_DIVERGENCE").when(score > 20, "MODERATE_SIGNAL_DIVERGENCE").when(score < -40, "STRONG_CENSUS_DIVERGENCE").when(score < -20, "MODERATE_CENSUS_DIVERGENCE").otherwise("ALIGNED"))


def criteria_score(signal: Column, buy_pct: Column, upside: Column, analysts: Column, pef: Column, roe: Column, de: Column, w52: Column, theme: Column) -> Column:
    """Weighted criteria (strength, value, theme, contrarian) and bonuses, 100 at most."""
    yes = lambda t, p: F.when(F.coalesce(t, F.lit(False)), p).otherwise(0)
    a = (signal == "B") & (buy_pct >= 60) & (upside >= 15) & (analysts >= 5)
    b = (pef > 0) & (pef < 25) & (roe > 12) & (de < 100)
    e = (w52 < 70) & (upside > 25) & (roe > 15) & (signal == "B")
    bonus = F.when(theme == "Defense", 10).when(theme == "Energy", 8).when(theme == "Gold", 5).otherwise(0)
    return F.least(F.lit(100), yes(a, 20) + yes(b, 15) + yes(theme.isin("Defense", "Energy", "Gold"), 30) + yes(e, 25) + yes(upside > 30, 5) + bonus)


def priority_score(exret: Column, buy_pct: Column, pef: Column, beta: Column, at_high: Column, census_pct: Column) -> Column:
    """Six normalised terms (the insiders' is open and counts 0)."""
    z = lambda x, v: F.coalesce(x, F.lit(float(v)))
    p, b = F.when(pef == 0, 50.0).otherwise(z(pef, 50)), F.when(beta == 0, 1.0).otherwise(z(beta, 1))
    macro = F.least(F.lit(100.0), 50 + F.when(F.coalesce(at_high, F.lit(False)), 30).otherwise(0) + F.when(b.between(0.8, 1.2), 20).otherwise(0))
    return F.least(F.lit(100.0), z(exret, 0) / 50 * 100) * 0.25 + z(buy_pct, 0) * 0.15 + F.greatest(F.lit(0.0), F.least(F.lit(100.0), (50 - p) * 2)) * 0.2 + macro * 0.1 + F.least(F.lit(100.0), z(census_pct, 0) * 5) * 0.2


def event_risk(warnings: Column, block_terms: list[str] | None = None) -> Column:
    """a name is stopped if the type of any of its warnings holds a block term (in any case); without terms, by any warning."""
    some = F.coalesce(F.size(warnings) > 0, F.lit(False))
    if block_terms is None:
        return some
    holds = lambda w: F.exists(F.array(*[F.lit(t.lower()) for t in block_terms]).cast("array<string>"), lambda t: F.contains(F.lower(w), t))
    return some & F.coalesce(F.exists(warnings, lambda w: F.coalesce(holds(w), F.lit(False))), F.lit(False))


def extremes(df: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` highest and lowest rows by ``value`` (NULL left out), ties by ``key``: two bounded sorts."""
    d = df.where(F.col(value).isNotNull())
    best = d.orderBy(F.desc(value), key).limit(n).withColumn("side", F.lit("top"))
    return best.unionByName(d.orderBy(value, key).limit(n).withColumn("side", F.lit("worst")))
