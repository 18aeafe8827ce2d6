"""The sizing chain: one column per multiplier, so that a size can be audited. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chain.
BASE_SIZE, MOST_USD, MOST_PCT, LEAST_NET_RETURN = 2500.0, 22500.0, 5.0, 1.0
TIER_FACTOR = {"mega": 5.0, "large": 4.0, "mid": 3.0, "small": 2.0, "micro": 1.0}
REGIME_FACTOR = {"low": 1.0, "normal": 1.0, "elevated": 0.75, "high": 0.5}
REGIME_OF_REVIEW = {"RISK_OFF": "high", "CAUTIOUS": "elevated", "NEUTRAL": "normal", "RISK_ON": "low"}
FRESHNESS_FACTOR = {"fresh": 1.0, "aging": 0.75, "stale": 0.5, "dead": 0.0}
IMPACT_SPREAD_BPS = {"mega": 2.0, "large": 5.0, "mid": 10.0, "small": 15.0, "micro": 20.0}
HOLDING_SPREAD_BPS = {"mega": 2.0, "large": 5.0, "mid": 10.0, "small": 20.0, "micro": 40.0}
FINANCING_RATE, NO_VOLUME_BPS, MOST_IMPACT_BPS = 0.064, 50.0, 300.0
VAR_TRIGGER, VAR_MAX = 2.5, 5.0


def lookup(c: Column, table: dict, other) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def conviction_factor(conviction: Column, clamped: bool = True) -> Column:
    """1 while clamped (conviction has shown no edge); else 0.35 to 1 on a line."""
    if clamped:
        return F.lit(1.0)
    return 0.35 + F.greatest(F.lit(0.0), F.least(F.lit(100.0), conviction.cast("double"))) / 100 * 0.65


def cluster_factor(size: Column) -> Column:
    """C11: one over the root of the number of names in the cluster; 1 outside any."""
    return F.when(size > 1, 1.0 / F.sqrt(size.cast("double"))).otherwise(1.0)


def redundancy(peers: Column) -> Column:
    """Points for the other names of the cluster."""
    return F.when(peers >= 3, -8).when(peers >= 2, -4).otherwise(0)


def rotation_points(state: Column) -> Column:
    """A losing sector costs 15 points, a gaining one gives 10."""
    return F.when(state == "losing", -15).when(state == "gaining", 10).otherwise(0)


def rotation_blocks(state: Column, delta_pp: Column) -> Column:
    """A sector whose share of B has fallen by 20 points or more takes no new position."""
    return F.coalesce((state == "losing") & (delta_pp <= -20), F.lit(False))


def var_factor(var95: Column) -> Column:
    """1 up to the trigger, down to one half at the maximum, none at twice the maximum; unknown counts as 1."""
    line = F.round(1 - (var95 - VAR_TRIGGER) / (VAR_MAX - VAR_TRIGGER) * 0.5, 2)
    return F.when(var95.isNull() | (var95 <= VAR_TRIGGER), 1.0).when(var95 >= 2 * VAR_MAX, 0.0).when(var95 >= VAR_MAX, 0.5).otherwise(line)


def impact_bps(position: Column, daily_volume: Column, tier: Column) -> Column:
    """Spread and the share of a day's volume; without volume a high one is assumed."""
    return lookup(tier, IMPACT_SPREAD_BPS, 10.0) + F.when(daily_volume > 0, position / daily_volume * 10000).otherwise(NO_VOLUME_BPS)


def holding_cost_pct(days: Column, tier: Column) -> Column:
    """Spread both ways and financing over the holding time."""
    return lookup(tier, HOLDING_SPREAD_BPS, 10.0) / 10000 * 2 * 100 + FINANCING_RATE * (days / 365.0) * 100


def with_conviction_size(df: DataFrame, portfolio: float = 450_000.0, base: float = BASE_SIZE, clamped: bool = True) -> DataFrame:
    """P26 over tier, conviction, regime, cluster_size, fx, freshness, var95, rotation, rotation_pp, net_return and
    daily_volume. Adds adjusted_conviction, the factors, ``blocked`` and ``size``: the product within the caps of a
    position, none where a block holds."""
    c = F.col
    d = df.withColumns({
        "tier_size": lookup(c("tier"), TIER_FACTOR, 3.0) * base,
        "rotation_points": rotation_points(c("rotation")),
        "regime_factor": lookup(c("regime"), REGIME_FACTOR, 1.0),
        "cluster_factor": cluster_factor(c("cluster_size")),
        "fx_factor": F.coalesce(c("fx"), F.lit(1.0)),
        "freshness_factor": lookup(c("freshness"), FRESHNESS_FACTOR, 1.0),
        "var_factor": var_factor(c("var95")),
    })
    d = d.withColumn("adjusted_conviction", F.greatest(F.lit(0), F.least(F.lit(100), c("conviction") + c("rotation_points"))))
    d = d.withColumn("conviction_factor", conviction_factor(c("adjusted_conviction"), clamped))
    product = c("tier_size") * c("conviction_factor") * c("regime_factor") * c("cluster_factor") * c("fx_factor") * c("freshness_factor") * c("var_factor")
    dear = F.coalesce(c("net_return") < LEAST_NET_RETURN, F.lit(False))
    heavy = F.coalesce(impact_bps(c("tier_size"), c("daily_volume"), c("tier")) > MOST_IMPACT_BPS, F.lit(False))
    blocked = dear | heavy | rotation_blocks(c("rotation"), c("rotation_pp")) | (c("freshness_factor") == 0)
    cap = min(MOST_USD, portfolio * MOST_PCT / 100) if portfolio > 0 else MOST_USD
    return d.withColumn("blocked", blocked).withColumn("size", F.when(c("blocked"), 0.0).otherwise(F.round(F.least(product, F.lit(cap)), 2)))


def with_suggested_size(df: DataFrame, portfolio: float = 450_000.0, base: float = BASE_SIZE) -> DataFrame:
    """C13 over action, in_cooldown, tier, conviction, regime, cluster_size, fx, vol_scale, breaker (factor), new_allowed and var95: the
    size of BUY and ADD rows, NULL for others. A name in its cooldown gets none; the book's breaker and risk
    budget scale or stop what is left. ``size_pct`` is the share of the book before those."""
    c = F.col
    none = {k: F.lit(None).cast(t) for k, t in (("freshness", "string"), ("rotation", "string"), ("rotation_pp", "double"), ("net_return", "double"), ("var95", "double"), ("daily_volume", "double"))}
    chain = ("tier", "conviction", "regime", "cluster_size")
    sized = with_conviction_size(df.select(F.struct(*df.columns).alias("row"), *chain, F.lit(1.0).alias("fx")).withColumns(none), portfolio, base)
    usd = c("size") * F.coalesce(c("row.fx"), F.lit(1.0)) * F.coalesce(c("row.vol_scale"), F.lit(1.0))
    usd = F.when(~c("row.new_allowed"), 0.0).otherwise(usd * F.least(F.lit(1.0), c("row.breaker"))) * var_factor(c("row.var95"))
    buys, stopped = c("row.action").isin("BUY", "ADD"), c("row.in_cooldown")
    size = F.when(buys & stopped, 0.0).when(buys, F.round(usd, 0))
    pct = F.when(buys & stopped, 0.0).when(buys, F.round(c("size") / portfolio * 100, 2))
    return sized.select("row.*", size.alias("suggested_usd"), pct.alias("size_pct"))
