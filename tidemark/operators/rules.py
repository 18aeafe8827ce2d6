"""Small row rules: sizes, scores, constraints, budgets. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tier, beta and return sizing.
BASE_SIZE, TIERS = 2500.0, ((100e9, 4.0), (5e9, 2.0))
MIN_CAP, MIN_SIZE, MAX_SIZE, STEP = 500e6, 1000.0, 40000.0, 500.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def upside(target: Column, price: Column) -> Column:
    """Percent from price to target; NULL unless the price is positive."""
    return F.when(price > 0, (target / price - 1) * 100)


def confidence(analysts: Column, ratings: Column, exret: Column, upside_: Column, buy_pct: Column) -> Column:
    """0.6, more for coverage and expected return, less for missing inputs; within 0 and 1."""
    n, r = F.coalesce(analysts, F.lit(0)), F.coalesce(ratings, F.lit(0))
    x = F.lit(0.6) + F.when(n >= 5, 0.2).otherwise(0.0) + F.when(n >= 10, 0.1).otherwise(0.0) + F.when(r >= 5, 0.1).otherwise(0.0)
    x = x + F.abs(F.coalesce(exret, F.lit(0.0))) * 0.005
    return clamp(x - F.when(upside_.isNull(), 0.2).otherwise(0.0) - F.when(buy_pct.isNull(), 0.2).otherwise(0.0), 0.0, 1.0)


def size_factors(cap: Column, exret: Column, beta: Column, region: Column) -> dict[str, Column]:
    """P24, one column per multiplier."""
    base = F.when(cap >= TIERS[0][0], TIERS[0][1]).when(cap >= TIERS[1][0], TIERS[1][1]).otherwise(1.0) * BASE_SIZE
    return {
        "base_size": base,
        "beta_factor": F.when(beta > 0, clamp(1.4 - beta * 0.4, 0.8, 1.2)).otherwise(1.0),
        "return_factor": F.when(exret > 0, clamp(1.0 + exret * 0.0167, 1.0, 1.5)).otherwise(1.0),
        "region_factor": F.when(region == "hk", 0.75).otherwise(1.0),
    }


def position_size(cap: Column, base: Column, beta: Column, ret: Column, region: Column, excluded: Column) -> Column:
    """The product within its bounds, to the nearest 500 (ties to even); NULL for funds and small caps."""
    size = F.bround(clamp(base * beta * ret * region, MIN_SIZE, MAX_SIZE) / STEP, 0) * STEP
    return F.when(~excluded & (cap >= MIN_CAP), size)


def constraints(cash: Column, pnl: Column, above200: Column, drawdown: Column, position: Column, sector: Column) -> Column:
    """Array of (name, passed, severity). 15, -20, -15, 7, 25 percent."""
    stop = (pnl <= -20.0) & ~above200

    def row(name: str, failed: Column, severity: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), (~failed).alias("passed"), severity.alias("severity"))

    block = lambda failed, word="BLOCK": F.when(failed, word).otherwise("INFO")
    return F.array(
        row("cash_reserve", cash < 15.0, block(cash < 15.0)),
        row("position_stoploss", stop, F.when(stop, "BLOCK").when(pnl <= -20.0, "WARNING").otherwise("INFO")),
        row("portfolio_drawdown", drawdown <= -15.0, block(drawdown <= -15.0)),
        row("position_drift", position > 7.0, block(position > 7.0, "WARNING")),
        row("sector_concentration", sector >= 25.0, block(sector >= 25.0)),
    )


def risk_score(var95: Column, drawdown: Column, beta: Column, sortino: Column) -> Column:
    """Whole number within 0 and 100, cut off towards zero."""
    x = F.abs(var95) * 10 + F.abs(drawdown) * 2 + F.greatest(F.lit(0.0), beta - 1) * 20 + F.greatest(F.lit(0.0), 2 - sortino) * 10
    return clamp(x, 0.0, 100.0).cast("long")


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MODERATE").otherwise("LOW")


def hedge(exposure: Column, rate_diff: Column, cap: float = 0.4) -> Column:
    """WITHIN_CAP, UNHEDGED (hedging costs carry) or PARTIAL_HEDGE."""
    return F.when(exposure <= cap, "WITHIN_CAP").when(rate_diff > 0, "UNHEDGED").otherwise("PARTIAL_HEDGE")


def deployable(cash: Column, regime: Column, target: float = 0.07) -> Column:
    """P58."""
    return F.greatest(F.lit(0.0), cash - target) * clamp(regime, 0.0, 1.0)
