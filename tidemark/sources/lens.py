"""Views of the given tables as instrument data.

Every panel view has at most one row per (ticker, day), so a per-ticker window never holds
more rows than the calendar has days, however hot the ticker is in the raw rows. The raw
rows are reduced with map-side aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.timeseries import asof_backward
from tidemark.sources.lens_columns import (
    EVENT_SIGNAL, NO_TRADE_MOD, PORTFOLIO_MOD, REGION_OF, REVIEW, TIER_OF_SUPPLIER, UNIVERSE, WATERFALL, sql_case,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _money(c: str) -> Column:
    """Exact sum, so the result does not depend on the order of partial sums."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def _close() -> Column:
    return _money("l_extendedprice") / _money("l_quantity")


def prices(spark, sf) -> DataFrame:
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))
            .agg(_close().alias("close"), _money("l_quantity").alias("volume")))


def bench(spark, sf) -> DataFrame:
    """One row per trading day."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
            .agg(_close().alias("close")))


def regional_bench(spark, sf) -> DataFrame:
    """One row per (region, trading day). Lines are reduced to (supplier, day) before the join."""
    per = (table(spark, sf, "lineitem")
           .groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date"))
           .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amt"),
                F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty")))
    return (per.join(dims(spark, sf), F.col("l_suppkey") == F.col("ticker"))
            .groupBy("regionkey", "date")
            .agg((F.sum("amt").cast("double") / F.sum("qty").cast("double")).alias("close")))


def monthly(px: DataFrame) -> DataFrame:
    """Last close of each month."""
    return (px.groupBy("ticker", F.trunc("date", "MM").alias("month"))
            .agg(F.max_by("close", "date").alias("close")))


def dims(spark, sf) -> DataFrame:
    """Ticker attributes; one row per ticker."""
    n = table(spark, sf, "nation")
    return (table(spark, sf, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
            .selectExpr("s_suppkey AS ticker", f"{sql_case('s_suppkey % 5', TIER_OF_SUPPLIER)} AS tier",
                        f"{sql_case('n_regionkey', REGION_OF)} AS region", "n_name AS sector",
                        "n_regionkey AS regionkey"))


def signals(spark, sf) -> DataFrame:
    """One row per (ticker, day): the order with the largest key wins. What is needed of it is reduced beside the key as
    numbers, so that this is a hash aggregate (map-side) and nothing is looked up after it."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_custkey", status.alias("code"))
    best = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("ticker"), "date")
            .agg(F.max("o_orderkey").alias("okey"), F.max_by("code", "o_orderkey").alias("code"), F.max_by("o_custkey", "o_orderkey").alias("custkey")))
    return best.select("ticker", "date", F.when(F.col("code") == 0, "B").when(F.col("code") == 1, "H").otherwise("S").alias("signal"),
                       (F.col("okey") % 101).alias("conviction"), "okey", "custkey")


def priced(sig: DataFrame, px: DataFrame) -> DataFrame:
    """Signals with the last close on or before their day; ``logged_price`` has gaps to fill."""
    out = asof_backward(sig, px, "ticker", "date", {"close": "asof_close"})
    return out.withColumn("logged_price", logged_price())


def logged_price() -> Column:
    return F.when(F.col("okey") % 10 != 0, F.col("asof_close"))


def signal_days(spark, sf) -> DataFrame:
    """The days of all orders; those of the signals are among them."""
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


def log(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.selectExpr(
        "user_id AS ticker", "cast(ts AS timestamp) AS ts", "cast(ts AS date) AS date",
        f"{sql_case('event_type', EVENT_SIGNAL, quote=True)} AS signal", "value",
        "cast(get_json_object(props, '$.k') AS bigint) AS score", "event_id")


def daily_log(spark, sf) -> DataFrame:
    """Latest entry per (ticker, day)."""
    return (log(spark, sf).groupBy("ticker", "date")
            .agg(F.max_by(F.struct("signal", "value", "score"), "ts").alias("r"))
            .select("ticker", "date", "r.signal", "r.value", "r.score"))


def universe(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in UNIVERSE])


def portfolio(spark, sf) -> DataFrame:
    u = universe(spark, sf).where(F.col("k") % PORTFOLIO_MOD == 0)
    raw = (F.col("k") * 17 % 23 + 1).cast("double")
    tot = u.agg(F.sum(raw).alias("tot"))
    # one row: the total
    return (u.crossJoin(F.broadcast(tot))
            .select("ticker", "k", "cap", "cap_value", "upside", "buy_pct", "beta", "sector", "price",
                    (raw * 100.0 / F.col("tot")).alias("pct")))


def no_trade(spark, sf) -> DataFrame:
    return universe(spark, sf).where(F.col("k") % NO_TRADE_MOD == 0).select("ticker")


def holders(spark, sf) -> DataFrame:
    """Investor's monthly spend per ticker."""
    li = (table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey")
          .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amt")))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.trunc("o_orderdate", "MM").alias("month"))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("investor"), "month", F.col("l_suppkey").alias("ticker"))
            .agg(F.sum("amt").cast("double").alias("spend")))


def census(spark, sf) -> DataFrame:
    """Holder count per (month, ticker); ``holders`` is unique per investor there."""
    return (holders(spark, sf).groupBy(F.col("month").alias("date"), "ticker")
            .agg(F.count("*").alias("holders"), F.sum("spend").alias("spend")))


def panel(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("date"), F.col("vec_id").alias("name"), "embedding")


def market(spark, sf) -> DataFrame:
    """One row per trading day: index level and two volatility gauges."""
    def gauge(c: str, k: float) -> Column:
        return 10 + k * (F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count("*"))

    return (table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
            .agg(_close().alias("spy"), gauge("l_discount", 400).alias("vix"), gauge("l_tax", 500).alias("vix3m")))


def review_columns(sig: DataFrame, *keep: str) -> DataFrame:
    """Review columns of signal rows (all follow from the row itself), with a map of modifier points."""
    r = sig.selectExpr(*[f"{e} AS {n}" for n, e in REVIEW], *keep)
    pairs = [x for n, e in WATERFALL for x in (F.lit(n), F.expr(f"cast({e} as bigint)"))]
    return r.withColumn("waterfall", F.create_map(*pairs))


def reviews(spark, sf) -> DataFrame:
    return review_columns(signals(spark, sf))


def waterfall(spark, sf) -> DataFrame:
    return reviews(spark, sf).select("ticker", "date", "okey", F.explode("waterfall").alias("name", "points"))
