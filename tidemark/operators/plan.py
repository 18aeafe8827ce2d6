"""A plan from a universe to sized orders, in stages that share written intermediates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import cascade as ca
from tidemark.operators.regime import FALLBACK, REGIME_EXPOSURE
from tidemark.operators.rules import deployable
from tidemark.session import new_path


class Stages:
    """Runs stages: each result is written once to the shared folder and read by those that follow. Leaving
    the block drops all but what was kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def run(self, name: str, df: DataFrame, keep: bool = False) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.mode("error").parquet(path)
        if not keep:
            self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for p in self.made:
            path(p).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path(p), True)


def passes_gates() -> Column:
    """size, coverage, earnings and trend are good enough; no crypto, with a price."""
    c = F.col
    non_pos = lambda x: F.coalesce(c(x) <= 0, F.lit(True))
    bad = F.coalesce(c("cap_value") < 2e9, F.lit(False)) | F.coalesce(c("analysts") < 5, F.lit(True)) | (non_pos("pet") & non_pos("pef") & non_pos("fcf")) | F.coalesce(c("w52").between(0, 100) & (c("w52") < 50), F.lit(False))
    return ~bad & ~c("ticker").endswith("-USD") & F.coalesce(c("price") > 0, F.lit(False))


def exposure_of(confirmed: DataFrame) -> float:
    """Exposure of the last confirmed regime of (date, confirmed): one row."""
    last = confirmed.agg(F.max_by("confirmed", "date").alias("r")).first()["r"]
    return REGIME_EXPOSURE.get(last, REGIME_EXPOSURE[FALLBACK])


def size_book(x: DataFrame, budget: float, name_cap: float = 0.08, sector_cap: float = 0.25, min_position: float = 0.01, score: str = "score") -> DataFrame:
    """Targets of a book (ticker, sector, action, cur, score) that may put ``budget`` to work: the best names get equal shares, within the
    caps of a name and of a sector."""
    deploy, a, cur = F.col("action").isin("BUY", "ADD"), F.col("action"), F.col("cur")
    most = max(1, int(budget / min_position + 1e-9)) if budget > 0 else 0  # a budget funds no more names than this
    w = Window.partitionBy(F.lit(0))  # at most ``most`` rows
    top = x.where(deploy).orderBy(F.desc(score), "ticker").limit(most).select("ticker", (F.lit(float(budget)) / F.count("*").over(w)).alias("raw"))
    t = x.join(F.broadcast(top), "ticker", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    tgt = F.when(a == "BUY", F.least("raw", F.lit(name_cap))).when(a == "ADD", cur + F.least("raw", F.greatest(F.lit(0.0), name_cap - cur))).when(a == "HOLD", cur).otherwise(0.0)
    t = t.withColumn("tgt", tgt)
    added = F.when(a == "BUY", F.col("tgt")).when(a == "ADD", F.col("tgt") - cur).otherwise(0.0)
    s = t.groupBy(F.col("sector").alias("_s")).agg(F.sum(F.when(~deploy, F.col("tgt")).otherwise(0.0)).alias("held_s"), F.sum(added).alias("add_s"))  # one row per sector
    t = t.join(F.broadcast(s), F.col("sector").eqNullSafe(F.col("_s")), "left")
    k = F.greatest(F.lit(0.0), sector_cap - F.col("held_s")) / F.col("add_s")
    over = deploy & (F.col("held_s") + F.col("add_s") > sector_cap + 1e-12) & (F.col("add_s") > 0)
    return t.withColumn("target", F.when(over & (a == "BUY"), F.col("tgt") * k).when(over, cur + (F.col("tgt") - cur) * k).otherwise(F.col("tgt"))).drop("_s", "held_s", "add_s", "raw", "tgt")


def sized_orders(universe: DataFrame, thresholds: DataFrame, members: Callable[[DataFrame], DataFrame], confirmed: DataFrame, held: Column, excluded: Column, top_n: int = 200, least_trade: float = 0.001) -> DataFrame:
    """Gates, classification, prescreen, exclusions, regime, budget, sizes, orders.

    ``universe``: typed instruments; ``held``: weight of a position in per cent before scaling (NULL: none); ``excluded``: names that may not be
    bought; ``members`` gives the sector classes' members from the universe. The universe is read once; every later stage reads what an earlier one wrote. Returns
    ticker, action, current, target, trade, regime exposure; trades below ``least_trade`` are left out."""
    spark = universe.sparkSession
    with Stages(spark) as st:
        universe = st.run("plan-universe", universe)
        judged = ca.classify(universe, thresholds, members=members(universe)).select("ticker", "sector", "signal", F.col("buy_score").alias("score"), passes_gates().alias("good"), held.cast("double").alias("raw"), excluded.alias("excluded"))
        u = st.run("plan-judged", judged)
        total = u.agg(F.sum("raw").alias("t"))  # one row
        own = st.run("plan-held", u.where("raw is not null").join(F.broadcast(total)).select("ticker", "sector", "signal", "score", (F.col("raw") / F.col("t")).alias("cur")))
        fresh = u.where("raw is null and signal = 'B' and good and not excluded").orderBy(F.desc("score"), "ticker").limit(top_n)
        book = own.unionByName(fresh.select("ticker", "sector", "signal", "score", F.lit(0.0).alias("cur")))
        action = F.when((F.col("signal") == "B") & (F.col("cur") == 0), "BUY").when(F.col("signal") == "B", "ADD").when(F.col("signal") == "S", "SELL").otherwise("HOLD")
        book = st.run("plan-book", book.withColumn("action", action))
        kept = book.agg(F.sum(F.when(F.col("action").isin("ADD", "HOLD"), F.col("cur")))).first()[0] or 0.0
        scale = exposure_of(confirmed)
        budget = spark.range(1).select(deployable(F.lit(1.0 - kept), F.lit(scale)).alias("b")).first()["b"]
        t = size_book(book, budget)
        trade = F.col("target") - F.col("cur")
        orders = t.where(F.abs(trade) >= least_trade).select("ticker", "action", F.col("cur").alias("current"), "target", trade.alias("trade"), F.lit(scale).alias("exposure"))
        return st.run("plan-orders", orders, keep=True)
