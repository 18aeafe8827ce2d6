"""Statistical validation: information coefficients, regressions, multiple testing, resampling."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType

from tidemark.functions import tails
from tidemark.operators.ranks import spearman, value_counts, with_group
from tidemark.session import written


def ic_by_date(panel: DataFrame, signal: str, forward: str, date: str = "date") -> DataFrame:
    """Rank correlation per date with at least three complete pairs (V02, first level)."""
    return spearman(panel, [date], signal, forward).where("rho is not null").select(date, F.col("rho").alias("ic"), "n")


def ic_summary(ics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    g = ics.groupBy(*(keys or [])).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.count("*").alias("n_dates"),
                                       F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    return g.withColumn("t_stat", F.when(F.col("ic_std") > 0, F.col("mean_ic") / (F.col("ic_std") / F.sqrt("n_dates"))))


def gram(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Sums of products of (1, xs, y) per group as one array: partial sums run map-side, one short
    row per group reaches the solver."""
    names = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    ok = F.col(y).isNotNull()
    for x in xs:
        ok = ok & F.col(x).isNotNull()
    prods = [F.sum(names[i] * names[j]) for i in range(len(names)) for j in range(i, len(names))]
    return rows.where(ok).groupBy(*keys).agg(F.array(*prods).alias("gram"))


def ols(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """(keys, n, coef array, se array, r2, rss) of y on (1, xs) from the group's Gram matrix.

    The variables are centred on the group means first (sums of large cross products would lose
    digits), so the normal equations stay well conditioned.
    """
    means = rows.where(" and ".join(f"{c} is not null" for c in [y, *xs]))
    means = with_group(means, keys, *[F.avg(c).alias(f"_m_{c}") for c in [y, *xs]])
    cen = means.select(*keys, *[F.col(f"_m_{c}") for c in [y, *xs]], *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in [y, *xs]])
    g = gram(cen, keys + [f"_m_{c}" for c in [y, *xs]], y, xs)
    k = len(xs)
    schema = g.select(*keys).schema.add("n", LongType()).add("coef", ArrayType(DoubleType())).add("se", ArrayType(DoubleType())).add("r2", DoubleType()).add("rss", DoubleType())

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = np.zeros((k + 2, k + 2))
                iu = np.triu_indices(k + 2)
                m[iu] = row["gram"]
                m = m + m.T - np.diag(np.diag(m))
                n, xx, xy, yy = m[0, 0], m[1:k + 1, 1:k + 1], m[1:k + 1, -1], m[-1, -1]
                inv = np.linalg.pinv(xx)
                b = inv @ xy
                mx = np.array([row[f"_m_{x}"] for x in xs])
                a = row[f"_m_{y}"] - mx @ b
                rss = max(yy - b @ xy, 0.0)
                dof = n - k - 1
                se = [None] * (k + 1)
                if dof > 0:
                    s2 = rss / dof
                    se = [float(np.sqrt(s2 * (1 / n + mx @ inv @ mx))), *np.sqrt(s2 * np.diag(inv)).tolist()]
                out.append({**{q: row[q] for q in keys}, "n": int(n), "coef": [float(a), *b.tolist()], "se": se,
                            "r2": float(1 - rss / yy) if yy > 0 else None, "rss": float(rss)})
            yield pd.DataFrame(out, columns=schema.names)

    return g.mapInPandas(solve, schema)


def residuals(rows: DataFrame, keys: list[str], y: str, xs: list[str], out: str = "resid") -> DataFrame:
    """Residual of y on (1, xs) within each group; the fit is one row per group and joins back."""
    fit = ols(rows, keys, y, xs).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "coef", F.col("n").alias("_n"))
    cond = None
    for k in keys:
        c = rows[k] == F.col(f"_k_{k}")
        cond = c if cond is None else cond & c
    j = rows.join(fit, cond)
    pred = F.col("coef")[0]
    for i, x in enumerate(xs, start=1):
        pred = pred + F.col("coef")[i] * F.col(x)
    return j.withColumn(out, F.col(y) - pred).drop("coef", *[f"_k_{k}" for k in keys])


def incremental_ic(panel: DataFrame, signal: str, incumbents: list[str], forward: str, date: str | list[str] = "date") -> DataFrame:
    """V03 per date (or per group of several keys): raw and incremental rank correlation (after removing the incumbents)."""
    keys = [date] if isinstance(date, str) else date
    cols = [signal, *incumbents, forward]
    p = panel.where(" and ".join(f"{c} is not null" for c in cols)).select(*keys, *cols)
    r = written(residuals(p, keys, signal, incumbents).where(F.col("_n") >= max(3, len(incumbents) + 2)), "residuals")
    raw = spearman(r, keys, signal, forward).where("rho is not null").select(*keys, F.col("rho").alias("raw_ic"))
    inc = spearman(r, keys, "resid", forward).select(*keys, F.col("rho").alias("rho"))
    sc = r.groupBy(*keys).agg((F.stddev_pop("resid") < 1e-8 * (F.stddev_pop(signal) + 1e-12)).alias("spanned"))
    return (raw.join(inc, keys).join(sc, keys)
            .select(*keys, "raw_ic", F.when(F.col("spanned"), 0.0).otherwise(F.coalesce("rho", F.lit(0.0))).alias("incr_ic")))


def correlations(rows: DataFrame, group: str, vector: str, width: int) -> DataFrame:
    """(group, a, b, n, r) for all pairs a < b of a vector's places (from 1), over the rows that have both. A task adds up matrices of sums,
    one set per group it meets, so what is shuffled does not grow with the rows; NULL vectors are left out. A flat side gives NULL."""
    kind = dict(rows.dtypes)[group]
    out = f"{group} {kind}, a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"
    first, second = np.triu_indices(width, 1)

    def task(batches):
        sums: dict = {}
        for t in batches:
            whole = t.filter(pc.is_valid(t.column(1)))
            x = np.array(whole.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            keys = np.array(whole.column(0).to_pylist(), object)
            for k in dict.fromkeys(keys.tolist()):
                own = x[keys == k]
                m = ~np.isnan(own)
                v = np.where(m, own, 0.0)
                part = [m.T.astype(float) @ m, v.T @ m, (v * v).T @ m, v.T @ v]
                sums[k] = part if k not in sums else [a + b for a, b in zip(sums[k], part)]
        for k, (n, s, ss, sab) in sums.items():
            cols = [n[first, second], s[first, second], s[second, first], ss[first, second], ss[second, first], sab[first, second]]
            key = pa.array([k] * len(first), keytype)
            yield pa.RecordBatch.from_arrays([key, pa.array(first + 1, pa.int32()), pa.array(second + 1, pa.int32()), *map(pa.array, cols)], names=names)

    names, keytype = [c.split()[0] for c in out.split(", ")], to_arrow_type(rows.schema[group].dataType)
    total = rows.select(group, vector).mapInArrow(task, out).groupBy(group, "a", "b").agg(*[F.sum(c).alias(c) for c in names[3:]])
    va, vb = (F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.col("n") for x in "ab")
    flat = (va <= 1e-12 * F.col("saa")) | (vb <= 1e-12 * F.col("sbb"))
    r = F.when(~flat, (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb))
    return total.select(group, "a", "b", F.col("n").cast("long").alias("n"), r.alias("r"))


def benjamini_hochberg(tests: DataFrame, p: str, alpha: float = 0.05, keys: list[str] | None = None, stop_at_first: bool = False) -> DataFrame:
    """V10. Step-up by default: reject all tests up to the last rank that passes. With
    ``stop_at_first`` the walk ends at the first rank that fails. The rank of a p-value comes from
    counts of distinct values, so a family may be of any size. Equal p-values share a fate under
    step-up, as the last of them decides."""
    keys = keys or []
    t = tests.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    vc = value_counts(t, keys, "_p").withColumn("top", F.col("below") + F.col("cnt"))
    if stop_at_first:
        # rank of the first member of a tie decides: ties are walked one by one
        vc = vc.withColumn("_bad", F.col("_p") > alpha * (F.col("below") + 1) / F.col("n"))
        cut = vc.groupBy(*keys).agg(F.min(F.when(F.col("_bad"), F.col("_p"))).alias("_cut"))
        rej = lambda: F.col("_cut").isNull() | (F.col("_p") < F.col("_cut"))
    else:
        vc = vc.withColumn("_ok", F.col("_p") <= alpha * F.col("top") / F.col("n"))
        cut = vc.groupBy(*keys).agg(F.max(F.when(F.col("_ok"), F.col("_p"))).alias("_cut"))
        rej = lambda: F.col("_cut").isNotNull() & (F.col("_p") <= F.col("_cut"))
    j = t.join(cut, keys) if keys else t.join(F.broadcast(cut))  # cut: one row per family
    return j.withColumn("significant", rej()).drop("_p", "_cut")


def folds(dates: DataFrame, n_folds: int = 5, embargo: int = 30, date: str = "date") -> DataFrame:
    """Expanding-window cut dates (V09): (fold, train_cut, test_start, test_end). One row per fold.

    Distinct dates are bounded by the calendar.
    """
    d = dates.select(date).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    d = d.select(date, (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"), F.max(date).over(Window.partitionBy(F.lit(0))).alias("mx"))
    cuts = n_folds + 1
    at = lambda k: F.least(F.bround(F.col("n") * k / cuts).cast("long"), F.col("n") - 1)
    picks = [F.max(F.when(F.col("i") == at(k), F.col(date))).alias(f"c{k}") for k in range(cuts + 1)]
    g = d.where("n >= 2").agg(*picks, F.max("mx").alias("mx"))
    rows = [F.struct(F.lit(k).alias("fold"), F.col(f"c{k + 1}").alias("train_cut"), F.date_add(f"c{k + 1}", embargo).alias("test_start"),
                     (F.date_add("mx", 1) if k + 2 == cuts else F.col(f"c{k + 2}")).alias("test_end")) for k in range(n_folds)]
    return g.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def fold_sides(rows: DataFrame, fold_table: DataFrame, date: str = "date") -> DataFrame:
    """Each row once per fold and side it belongs to; at most n_folds rows are broadcast."""
    t = F.broadcast(fold_table)
    train = rows.join(t, rows[date] < t["train_cut"]).withColumn("side", F.lit("train"))
    test = rows.join(t, (rows[date] >= t["test_start"]) & (rows[date] < t["test_end"])).withColumn("side", F.lit("test"))
    return train.unionByName(test).drop("train_cut", "test_start", "test_end")


EULER_GAMMA = 0.5772156649015329  # fixed value


def psr_z(sr: Column, bench: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Argument of the normal cdf for the probability that the true ratio exceeds ``bench``
    (kurtosis not in excess form). Keep it as a column of its own before taking ``norm_cdf``:
    the cdf mentions its argument many times."""
    den = F.sqrt(F.greatest(1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr, F.lit(1e-12)))
    return (sr - bench) * F.sqrt(F.greatest(n - 1, F.lit(1)).cast("double")) / den


def expected_max_sharpe(n_trials: Column, var_sr: Column) -> Column:
    n = n_trials.cast("double")
    z = (1 - EULER_GAMMA) * tails.norm_inv(1 - 1 / n) + EULER_GAMMA * tails.norm_inv(1 - 1 / (n * float(np.e)))
    return F.when(n_trials < 2, 0.0).otherwise(F.sqrt(F.greatest(var_sr, F.lit(0.0))) * z)


def pbo(perf: DataFrame, period: str, config: str, value: str, n_splits: int = 10) -> DataFrame:
    """Share of in-sample/out-of-sample splits whose in-sample best lands at or below the
    out-of-sample median. ``perf`` is long (period, config, value) and complete.

    Periods are cut into S consecutive blocks; only sums per (block, config) are combined, so the
    C(S, S/2) splits multiply S rows per config and not the raw data. The splits are a literal table.
    """
    s = max(2, n_splits - n_splits % 2)
    sp = perf.sparkSession
    p = perf.select(period).distinct()
    w = Window.partitionBy(F.lit(0))  # one row per period
    p = p.select(period, (F.row_number().over(w.orderBy(period)) - 1).alias("i"), F.count("*").over(w).alias("t"))
    big = F.col("t") % s  # the first t % s blocks hold one more period
    size = F.floor(F.col("t") / s)
    blk = F.when(F.col("i") < big * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(F.floor((F.col("i") - big) / size))
    b = perf.join(F.broadcast(p.select(period, blk.cast("int").alias("block"))), period)
    b = b.groupBy("block", config).agg(F.sum(value).alias("_sum"), F.count(value).alias("_cnt"))
    splits = [(k, g, g in c) for k, c in enumerate(combinations(range(s), s // 2)) for g in range(s)]
    t = sp.createDataFrame(splits, "split int, block int, is_in boolean")  # S * C(S, S/2) rows, fixed
    x = b.join(F.broadcast(t), "block").groupBy("split", config).agg(
        (F.sum(F.when(F.col("is_in"), F.col("_sum"))) / F.sum(F.when(F.col("is_in"), F.col("_cnt")))).alias("ins"),
        (F.sum(F.when(~F.col("is_in"), F.col("_sum"))) / F.sum(F.when(~F.col("is_in"), F.col("_cnt")))).alias("oos"))
    best = x.groupBy("split").agg(F.max("ins").alias("mx"))
    top = x.join(F.broadcast(best), "split").where("ins = mx").groupBy("split").agg(F.min(F.struct(F.col(config).alias("best"), F.col("oos").alias("best_oos"))).alias("b")).select("split", "b.*")
    r = x.join(F.broadcast(top), "split").groupBy("split", "best").agg(
        F.count(F.when((F.col("oos") < F.col("best_oos")) | ((F.col("oos") == F.col("best_oos")) & (F.col(config) < F.col("best"))), 1)).alias("rank"), F.count("*").alias("n"))
    return r.select("split", "best", ((F.col("rank") + 1) / (F.col("n") + 1)).alias("omega"), (((F.col("rank") + 1) / (F.col("n") + 1)) <= 0.5).alias("overfit"), F.col("n").alias("n_configs"))


def _mix(x: np.ndarray) -> np.ndarray:
    """Counter-based generator (SplitMix64 finaliser): the same row and replicate always draw alike,
    so a retried task gives the same numbers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


POISSON_CDF = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1)) or 1) for k in range(12)])


def _by_number(h: np.ndarray) -> np.ndarray:
    return np.searchsorted(POISSON_CDF, (h >> np.uint64(11)).astype(float) / float(1 << 53))


_CELL = np.arange(1 << 12, dtype=np.uint64) << np.uint64(52)
#: The weight of all numbers with the same 12 first bits; -1 where they differ.
_OF_CELL = np.where(_by_number(_CELL) == _by_number(_CELL | np.uint64((1 << 52) - 1)), _by_number(_CELL), -1).astype(float)


def _poisson(h: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of random 64-bit numbers; few of them need the search."""
    w = _OF_CELL[(h >> np.uint64(52)).astype(np.intp)]
    open_ = w < 0
    w[open_] = _by_number(h[open_])
    return w


def bootstrap_sums(rows: DataFrame, keys: list[str], row_id: str, value: str, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """Per (keys, rep) the weighted count and sum under Poisson(1) resampling.

    One scan: each Arrow batch draws a (rows x replicates) weight matrix from (row id, replicate)
    and hands on only its totals, so the shuffle carries batches x groups x replicates, not
    rows x replicates.
    """
    schema = rows.select(*keys).schema.add("rep", IntegerType()).add("w", DoubleType()).add("s", DoubleType())

    def draw(batches):
        rep = _mix(np.arange(n_boot, dtype=np.uint64) + np.uint64(seed * 1_000_003))
        for pdf in batches:
            for k, g in (pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]):
                w_tot, s_tot = np.zeros(n_boot), np.zeros(n_boot)
                v = g[value].to_numpy(dtype=float)
                ids = _mix(g[row_id].to_numpy(dtype=np.int64).astype(np.uint64))
                for i in range(0, len(g), 128):  # small enough to stay in a core's cache
                    w = _poisson(_mix(ids[i:i + 128, None] ^ rep[None, :]))
                    w_tot += w.sum(axis=0)
                    s_tot += v[i:i + 128] @ w
                d = pd.DataFrame({"rep": np.arange(n_boot, dtype=np.int32), "w": w_tot, "s": s_tot})
                for n, x in zip(keys, k if isinstance(k, tuple) else (k,)):
                    d[n] = x
                yield d[schema.names]

    part = rows.where(F.col(value).isNotNull()).select(*keys, row_id, value).mapInPandas(draw, schema)
    return part.groupBy(*keys, "rep").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def bootstrap_ci(rows, keys, row_id, value, n_boot=500, ci=0.90, seed=42) -> DataFrame:
    """Percentile interval of the mean. At most ``n_boot`` rows per group meet here."""
    b = bootstrap_sums(rows, keys, row_id, value, n_boot, seed).withColumn("m", F.try_divide("s", "w"))
    a = (1 - ci) / 2
    return b.groupBy(*keys).agg(F.percentile("m", F.lit(a)).alias("ci_lo"), F.percentile("m", F.lit(1 - a)).alias("ci_hi"), F.count("m").alias("reps"))


def block_bootstrap_ci(rows, keys, date, value, block=30, n_boot=500, ci=0.90, seed=42) -> DataFrame:
    """Moving blocks of consecutive days. Rows are first summed per day, so a replicate draws
    blocks of at most calendar length; prefix sums give a block's total with two lookups."""
    d = rows.where(F.col(value).isNotNull()).groupBy(*keys, date).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = part.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(*keys, F.row_number().over(part.orderBy(date)).alias("i"), F.count("*").over(part).alias("n"), F.sum("s").over(upto).alias("ps"), F.sum("c").over(upto).alias("pc"))
    # value and count of the block that starts at bar i
    end = F.lead("ps", block - 1).over(part.orderBy("i")), F.lead("pc", block - 1).over(part.orderBy("i"))
    prev = F.coalesce(F.lag("ps").over(part.orderBy("i")), F.lit(0.0)), F.coalesce(F.lag("pc").over(part.orderBy("i")), F.lit(0))
    blocks = d.select(*keys, "i", "n", (end[0] - prev[0]).alias("bs"), (end[1] - prev[1]).alias("bc")).where("bs is not null")
    starts = blocks.groupBy(*keys).agg(F.max("n").alias("n"))
    k = F.greatest(F.lit(1), F.floor(F.col("n") / block)).cast("int")
    draws = starts.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep"), k.alias("k"))
    draws = draws.select(*keys, "n", "rep", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j"))
    i = F.pmod(F.xxhash64(F.lit(seed), "rep", "j"), F.col("n") - block + 1) + 1
    draws = draws.select(*keys, "rep", i.cast("int").alias("i"))
    m = draws.join(blocks, [*keys, "i"]).groupBy(*keys, "rep").agg((F.sum("bs") / F.sum("bc")).alias("m"))
    a = (1 - ci) / 2
    return m.groupBy(*keys).agg(F.percentile("m", F.lit(a)).alias("ci_lo"), F.percentile("m", F.lit(1 - a)).alias("ci_hi"), F.count("m").alias("reps"))
