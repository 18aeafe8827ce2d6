"""Books of positions: correlation, clusters, risk, construction.

A book is a bounded selection of names (its top n at a rebalance date). Which dates count as complete
is decided inside each book, by its own names, so a growing table of other names takes no dates away
from it; the number of dates kept is part of every result. Pairs exist inside books alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

MIN_DATES = 20  # complete dates that a book needs before it has a risk figure


def top_names(cands: DataFrame, book: str, top_n: int = 20) -> DataFrame:
    """The ``top_n`` names of each book by score."""
    w = Window.partitionBy(book).orderBy(F.desc("score"), "ticker")
    return cands.where("score is not null").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top_n).drop("rk")


def book_history(names: DataFrame, rets: DataFrame, book: str, date: str = "month", least: int = MIN_DATES) -> DataFrame:
    """Returns of each book's names up to the book's date, on the dates on which every one of its names
    (that has any return) has one. Adds ``n_names`` and ``n_dates``; books with fewer than ``least`` complete
    dates have no rows here (see ``thin_books``)."""
    # names: twenty or so a book, so the returns of all other names stay where they are
    h = written(rets.join(F.broadcast(names), "ticker").where(F.col(date) <= F.col(book)), "book-history")  # read three times
    size = h.groupBy(book).agg(F.count_distinct("ticker").alias("n_names"))
    full = h.groupBy(book, date).agg(F.count("*").alias("c")).join(size, book).where("c = n_names").drop("c")
    dates = full.groupBy(book).agg(F.count("*").alias("n_dates")).where(F.col("n_dates") >= least)
    return h.join(full, [book, date]).join(dates, book)


def single_factor_risk(hist: DataFrame, factor: DataFrame, book: str, weights: DataFrame | None = None, date: str = "month", shrink: float = 0.2, ppy: int = 12) -> DataFrame:
    """C06 per book: the risk of its weighted names under one factor (``date``, ``f``), and the sample's risk shrunk towards it.

    With Cov = beta beta' var(f) + diag(idio) the book's variance needs two sums over its names, (sum w beta)^2 var(f) +
    sum w^2 idio, and no pair table; the sample variance of the book is that of its weighted return. Weights
    (ticker, weight) are scaled to one in each book; without them names weigh the same."""
    w = hist.withColumn("weight", F.lit(1.0)) if weights is None else hist.join(weights, "ticker")
    j = w.join(F.broadcast(factor.select(date, "f")), date)  # one row per date of the calendar
    name = j.groupBy(book, "ticker", "n_dates", "weight").agg(F.var_samp("f").alias("vf"), F.covar_samp("ret", "f").alias("c"), F.var_samp("ret").alias("v"))
    beta = F.try_divide(F.col("c"), F.col("vf"))
    name = name.select(book, "n_dates", "weight", "vf", beta.alias("beta"), F.greatest(F.lit(0.0), F.col("v") - F.coalesce(beta * F.col("c"), F.lit(0.0))).alias("idio"))
    total = F.sum("weight")
    model = name.groupBy(book, "n_dates").agg(F.count("*").alias("n_names"), (F.sum(F.col("weight") * F.col("beta")) / total).alias("beta"), F.max("vf").alias("vf"),
                                              (F.sum(F.col("weight") * F.col("weight") * F.col("idio")) / (total * total)).alias("idio"))
    series = j.groupBy(book, date).agg((F.sum(F.col("ret") * F.col("weight")) / total).alias("r")).groupBy(F.col(book).alias("_b")).agg(F.var_samp("r").alias("sample"))
    d = model.join(series, F.col(book) == F.col("_b")).withColumn("factor", F.coalesce(F.col("beta") * F.col("beta") * F.col("vf"), F.lit(0.0)) + F.col("idio"))
    vol = lambda x: F.sqrt(x * ppy)
    return d.select(book, "n_dates", "n_names", "beta", vol(F.col("factor")).alias("factor_vol"), vol(F.col("sample")).alias("sample_vol"), vol((1 - shrink) * F.col("sample") + shrink * F.col("factor")).alias("shrunk_vol"))


def correlation_edges(hist: DataFrame, book: str, threshold: float, date: str = "month") -> DataFrame:
    """Per book the pairs a < b with |corr| >= threshold; at most top_n^2 / 2 pairs a book."""
    l, r = hist.alias("l"), hist.alias("r")
    same = (F.col(f"l.{book}") == F.col(f"r.{book}")) & (F.col(f"l.{date}") == F.col(f"r.{date}")) & (F.col("l.ticker") < F.col("r.ticker"))
    corr = F.try_divide(F.covar_pop("l.ret", "r.ret"), F.stddev_pop("l.ret") * F.stddev_pop("r.ret"))
    pairs = l.join(r, same).groupBy(F.col(f"l.{book}").alias(book), F.col("l.ticker").alias("a"), F.col("r.ticker").alias("b"))
    return pairs.agg(corr.alias("corr"), F.max("l.n_dates").alias("n_dates")).where(F.abs("corr") >= threshold)


def effective_positions(hist: DataFrame, book: str, date: str = "month") -> DataFrame:
    """T22 per book, without pairs: with standardised returns z the sum of all correlations is the sum
    over dates of (sum z)^2 / n_dates. A flat series has no z."""
    sd = F.stddev_pop("ret").over(Window.partitionBy(book, "ticker"))
    mean = F.avg("ret").over(Window.partitionBy(book, "ticker"))
    z = hist.select(book, date, "n_dates", F.try_divide(F.col("ret") - mean, sd).alias("z")).where("z is not null")
    per = z.groupBy(book, date, "n_dates").agg(F.sum("z").alias("s"), F.count("*").alias("k"))
    g = per.groupBy(book, "n_dates").agg(F.max("k").alias("n"), (F.sum(F.col("s") * F.col("s")) / F.count("*")).alias("total"))
    return g.select(book, "n_dates", "n", (F.col("n") * F.col("n") / F.col("total")).alias("effective"), (F.col("n") / F.col("total")).alias("ratio"))


def portfolio_var(hist: DataFrame, weights: DataFrame, book: str, date: str = "month", horizon: int = 1) -> DataFrame:
    """T25 per book: parametric and tail risk of the weighted sum (weights sum to one in each book)."""
    c = hist.join(weights, "ticker")
    p = c.groupBy(book, date, "n_dates").agg((F.sum(F.col("ret") * F.col("weight")) / F.sum("weight")).alias("r"))
    p = p.withColumn("q", F.percentile("r", F.lit(0.05)).over(Window.partitionBy(book)))  # calendar-bounded
    g = p.groupBy(book, "n_dates").agg(F.stddev_samp("r").alias("sd"), F.abs(F.avg(F.when(F.col("r") <= F.col("q"), F.col("r")))).alias("tail"))
    h = math.sqrt(horizon)
    return g.select(book, "n_dates", (F.col("sd") * 1.645 * h * 100).alias("var_95_pct"), (F.col("sd") * 2.326 * h * 100).alias("var_99_pct"), (F.col("tail") * 100).alias("cvar_95_pct"))


def _erc(cov: np.ndarray, tol=1e-12, max_sweeps=10_000) -> tuple[np.ndarray, bool]:
    """Equal risk shares by cyclical coordinate descent: each step solves one name's quadratic, so it
    also converges where some covariances are negative. The flag says whether it did in time."""
    n = len(cov)
    var = np.maximum(np.diag(cov), 1e-18)
    x = 1 / np.sqrt(var)
    for _ in range(max_sweeps):
        old = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + math.sqrt(rest * rest + 4 * var[i] / n)) / (2 * var[i])
        if np.abs(x - old).max() < tol * np.abs(x).max():
            return x / x.sum(), True
    return x / x.sum(), False


def _spread(w: np.ndarray, cap: float) -> np.ndarray:
    """Name cap: excess goes to names still below it, in proportion to their weight."""
    while (w > cap + 1e-12).any():
        over = w > cap + 1e-12
        room = ~over & (w > 0)
        excess = (w[over] - cap).sum()
        w = np.where(over, cap, w)
        if w[room].sum() <= 0:
            break
        w = w + np.where(room, w, 0) * excess / w[room].sum()
    return w


def risk_parity_books(cands: DataFrame, rets: DataFrame, book: str, top_n: int = 20, shrink: float = 0.2, ppy: int = 12, target_vol: float = 0.10, name_cap: float = 0.08) -> DataFrame:
    """Per book (a rebalance date) the ``top_n`` names by score, shrunk covariance of their
    returns up to that date, equal-risk weights, volatility target, name cap.

    ``top_n`` bounds a book, so its pair table has at most top_n^2 rows; books run in parallel.
    """
    hist = rets.join(F.broadcast(top_names(cands, book, top_n)), "ticker").where(F.col("month") <= F.col(book)).select(book, "ticker", "month", "ret")

    def build(pdf):
        x = pdf.pivot_table(index="month", columns="ticker", values="ret").dropna()
        if len(x) < 12 or x.shape[1] < 2:
            # too little to estimate from: the book stays visible, without weights
            return pd.DataFrame({book: [pdf[book].iloc[0]], "ticker": pd.array([None], "Int64"), "weight": [np.nan], "n_obs": [len(x)], "status": ["TOO_FEW_DATES"]})
        s = np.cov(x.to_numpy(), rowvar=False) * ppy
        s = (1 - shrink) * s + shrink * np.diag(np.diag(s))
        v, done = _erc(s)
        pv = math.sqrt(v @ s @ v)
        v = _spread(v * min(target_vol / pv, 1.0), name_cap)
        return pd.DataFrame({book: pdf[book].iloc[0], "ticker": x.columns.astype("int64"), "weight": v, "n_obs": len(x), "status": "OK" if done else "NOT_CONVERGED"})

    return hist.groupBy(book).applyInPandas(build, f"{book} date, ticker long, weight double, n_obs long, status string")


def greedy_clusters(edges: DataFrame, book: str, min_size: int = 3, share: float = 0.67) -> DataFrame:
    """Clusters per book over an edge table (book, a, b, corr), one expression per book (books are
    bounded by their selection). Names are taken in order; a name that is in no cluster yet opens one and
    gathers, in order, those of its neighbours that are linked to at least ``share`` of the members so far."""
    both = edges.select(book, "a", "b").union(edges.select(book, F.col("b"), F.col("a")))
    near = both.groupBy(book, "a").agg(F.array_sort(F.collect_set("b")).alias("near"))
    books = near.groupBy(book).agg(F.map_from_entries(F.collect_list(F.struct("a", "near"))).alias("links"))
    longs = "array<bigint>"

    def gather(seed: Column) -> Column:
        def step(members: Column, x: Column) -> Column:
            shared = F.size(F.array_intersect(F.element_at("links", x), members))
            wanted = F.greatest(F.lit(1), F.floor(F.size(members) * share))
            return F.when(shared >= wanted, F.array_append(members, x)).otherwise(members)

        return F.aggregate(F.element_at("links", seed), F.array(seed), step)

    def open_one(found: Column, seed: Column) -> Column:
        added = F.transform(F.array(gather(seed)), lambda m: F.when(F.size(m) >= min_size, F.array_append(found, m)).otherwise(found))[0]
        return F.when(F.exists(found, lambda m: F.array_contains(m, seed)), found).otherwise(added)

    seeds = F.array_sort(F.map_keys("links"))
    found = F.aggregate(seeds, F.array().cast(f"array<{longs}>"), open_one)
    out = books.select(book, F.posexplode(found).alias("cluster", "members"))
    return out.select(book, F.col("cluster").cast("long").alias("cluster"), "members", F.size("members").cast("long").alias("size"))
