"""Exact ranks and percentiles of large groups without pulling a group into one task.

A date, a region or a signal class can hold a third of all rows, so a window over it, or the
``percentile`` aggregate (one hash map of all distinct values), would put that share on one
task. Here equal values are counted first (map-side), the distinct values are cut into
ordered buckets by a monotone rule, and running counts are taken inside buckets; only one
row per bucket is summed along the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import small, written

GRID = 256


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """Non-decreasing in ``v``: an equal-width grid, refined by a signed log grid so that a
    long tail does not crowd the bulk of the values into one bucket."""
    lin = F.floor((v - lo) / (hi - lo) * GRID)
    logg = F.floor(F.signum(v) * F.ln(F.abs(v) * 1000.0 + 1.0) * 8.0)
    return F.struct(F.when(hi > lo, lin).otherwise(F.lit(0)).cast("int").alias("a"),
                    logg.cast("int").alias("b"))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, cnt, below, n): how often a value occurs, how many rows of its group lie
    below it, and the group size. NULL values are left out; NULL keys are a group."""
    freq = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
            .agg(F.count("*").alias("cnt")))
    if not keys:
        freq = freq.withColumn("_g", F.lit(0))
    gk = keys or ["_g"]
    span = freq.groupBy(*gk).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("cnt").alias("n"))
    b = _safe_join(freq, span, gk).withColumn("_b", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi")))
    per = b.groupBy(*gk, "_b").agg(F.sum("cnt").alias("_bc"))
    off = per.withColumn("_off", F.coalesce(
        F.sum("_bc").over(Window.partitionBy(*gk).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_bc")
    w = Window.partitionBy(*gk, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    out = _safe_join(b, off, [*gk, "_b"]).withColumn(
        "below", F.col("_off") + F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    return out.select(*keys, F.col("_v").alias(value), "cnt", "below", "n")


def _safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches NULL keys and keeps one copy of them."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # right: one row, an ungrouped aggregate
    r = right.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(r[f"_r_{i}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def _step(v: Column, per: int) -> Column:
    """Non-decreasing in ``v`` over all doubles: ``per`` steps for each factor of e, zero and NaN (the largest) apart."""
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(1000.0)) * per) + 750 * per
    return F.when(F.isnan(v), 2000 * per).when(v > 0, size).when(v < 0, -size).otherwise(0)


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]], sets: list[list[str]] | None = None) -> DataFrame:
    """(keys, n, one column per name): the values at exact places (from 0, given the group size) of each group in order.

    Two passes. The first counts rows per step of a fixed grid, map-side; running counts tell which steps hold the places. The
    second counts distinct values in those steps alone, so neither all rows nor all values are shuffled. ``sets``:
    groupings by a part of the keys each, the other keys being NULL; counts, not rows, are multiplied by them in the first pass."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_s", _step(F.col("_v"), 64))
    kinds = dict(rows.dtypes)

    def arms(d: DataFrame, *rest: str) -> DataFrame:
        if not sets:
            return d
        a = F.array(*[F.struct(*[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for s in sets])
        return d.select(F.explode(a).alias("_a"), *rest).select("_a.*", *rest)

    hist = rows.groupBy(*keys, "_s").agg(F.count("*").alias("cnt"))
    if sets:
        hist = arms(hist, "_s", "cnt").groupBy(*keys, "_s").agg(F.sum("cnt").alias("cnt"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per step of the grid
    hist = hist.withColumn("_n", F.sum("cnt").over(whole)).withColumn("_base", F.sum("cnt").over(whole.orderBy("_s")) - F.col("cnt"))
    inside = F.lit(False)
    for at in places.values():
        inside |= (F.col("_base") <= at(F.col("_n"))) & (at(F.col("_n")) < F.col("_base") + F.col("cnt"))
    wanted = hist.where(inside).select(*keys, "_s", "_n", "_base")
    wanted = small(written(wanted, "steps")) if keys else F.broadcast(wanted)  # one group: at most a row per place
    if sets:
        rows = arms(rows.join(F.broadcast(wanted.select("_s").distinct()), "_s", "left_semi"), "_v", "_s")  # steps of the grid
    vc = value_counts(_safe_join(rows, wanted, [*keys, "_s"]), [*keys, "_s", "_n", "_base"], "_v")
    aggs = [F.max("_n").alias("n")]
    for name, at in places.items():
        i = at(F.col("_n")) - F.col("_base")
        aggs.append(F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("cnt")), F.col("_v"))).alias(name))
    return vc.groupBy(*keys).agg(*aggs)


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], sets: list[list[str]] | None = None) -> DataFrame:
    """(keys, n, one column per name): exact percentiles with linear interpolation."""
    places, outs = {}, []
    for name, p in probs.items():
        places[f"_{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(float(p)))
        places[f"_{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(float(p)))
        fp = (F.col("n") - 1) * F.lit(float(p))
        outs.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
                     * (fp - F.floor(fp))).alias(name))
    return order_statistics(df, keys, value, places, sets).select(*keys, "n", *outs)


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return percentiles(df, keys, value, {name: 0.5})


def with_rank(df: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """Add ``{prefix}rank`` (average rank of ties, from 1), ``{prefix}n``, ``{prefix}le`` (rows
    not above). Rows with a NULL value get NULLs."""
    vc = value_counts(df, keys, value).select(
        *keys, F.col(value).alias("_val"),
        (F.col("below") + (F.col("cnt") + 1) / 2.0).alias(f"{prefix}rank"),
        F.col("n").alias(f"{prefix}n"), (F.col("below") + F.col("cnt")).alias(f"{prefix}le"))
    d = df.withColumn("_val", F.col(value).cast("double"))
    # keys are never NULL in ranked panels except as a real group, hence the null-safe join
    r = vc.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
                  F.col("_val").alias("_rv"), f"{prefix}rank", f"{prefix}n", f"{prefix}le")
    cond = F.col("_val") == F.col("_rv")
    for i, k in enumerate(keys):
        cond = cond & d[k].eqNullSafe(F.col(f"_r_{i}"))
    return d.join(r, cond, "left").drop("_val", "_rv", *[f"_r_{i}" for i in range(len(keys))])


def with_group(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates to every row by aggregate-and-join: partial sums run map-side,
    and a hot group is spread over tasks, which a window over the group would not do."""
    return _safe_join(df, df.groupBy(*keys).agg(*aggs), keys)


def winsorised(df: DataFrame, keys: list[str], value: str, out: str | None = None,
               lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clip to the group's percentiles."""
    cut = percentiles(df, keys, value, {"_wl": lower, "_wu": upper}).drop("n")
    j = _safe_join(df, cut, keys, "left")
    v = F.col(value)
    return j.withColumn(out or value, F.when(v.isNotNull(), F.greatest(F.least(v, F.col("_wu")), F.col("_wl")))
                        ).drop("_wl", "_wu")


def zscored(df: DataFrame, keys: list[str], value: str, out: str, winsor: bool = True,
            clamp: float | None = None) -> DataFrame:
    """Population z-score; a flat group gives 0 to present rows, NULL stays NULL.

    Flatness is judged on the extremes: a sum-based deviation of equal values may leave
    rounding dust.
    """
    d = winsorised(df, keys, value, "_x", 0.01, 0.99) if winsor else df.withColumn("_x", F.col(value))
    d = with_group(d, keys, F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"),
                   (F.max("_x") > F.min("_x")).alias("_spread"))
    z = F.when(F.col("_x").isNull(), None).when(F.col("_spread"), F.try_divide(F.col("_x") - F.col("_m"), F.col("_s"))
                                               ).otherwise(0.0)
    if clamp is not None:
        z = F.greatest(F.least(z, F.lit(clamp)), F.lit(-clamp))
        z = F.when(F.col("_x").isNotNull(), z)
    return d.withColumn(out, z).drop("_x", "_m", "_s", "_spread")


def quantile_bins(df: DataFrame, keys: list[str], value: str, bins: int, out: str) -> DataFrame:
    """Right-closed bins on the value percentiles, equal edges merged (never splits ties)."""
    names = {f"_e{i}": i / bins for i in range(bins + 1)}
    cuts = percentiles(df, keys, value, names)
    cuts = cuts.select(*keys, F.array_distinct(F.array(*names)).alias("_edges"))
    j = _safe_join(df, cuts, keys, "left")
    v = F.col(value)
    inner = F.size(F.filter("_edges", lambda e: e < v))
    return j.withColumn(out, F.when(v.isNotNull(), F.greatest(inner - 1, F.lit(0)))).drop("_edges")


def moments_corr(x: str, y: str, how: str = "pearson") -> Column:
    """Correlation as an aggregate that returns NULL for a flat side instead of failing."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    flat = (F.max(a) <= F.min(a)) | (F.max(b) <= F.min(b))
    return F.when(~flat, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _ranked(d: DataFrame, keys: list[str], value: str, weights: dict[str, str]) -> DataFrame:
    """Add, per name, the average rank of ``value`` in its group less the mean rank, where a row counts as often as
    the column of the name says. Rows are shuffled and sorted once: by a step of a fixed grid inside the group, whose
    running counts (one row per group and step, written once) say what lies below."""
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per step of the grid
    d = d.withColumn("_s", _step(F.col(value), 256))
    below = d.groupBy(*keys, "_s").agg(*[F.sum(c).alias(f"_c{o}") for o, c in weights.items()])
    below = below.select(*keys, "_s", *[(F.sum(f"_c{o}").over(whole.orderBy("_s")) - F.col(f"_c{o}")).alias(f"_b{o}") for o in weights],
                         *[F.sum(f"_c{o}").over(whole).alias(f"_n{o}") for o in weights])
    below = small(written(below, "steps"))
    part = Window.partitionBy(*keys, "_s").orderBy(value)
    upto, tied = part.rangeBetween(Window.unboundedPreceding, 0), part.rangeBetween(0, 0)
    j = d.select("*", *[F.sum(c).over(upto).alias(f"_l{o}") for o, c in weights.items()], *[F.sum(c).over(tied).alias(f"_t{o}") for o, c in weights.items()])
    j = _safe_join(j, below, [*keys, "_s"])
    ranks = {o: F.col(f"_b{o}") + F.col(f"_l{o}") - (F.col(f"_t{o}") - 1) / 2.0 - (F.col(f"_n{o}") + 1) / 2.0 for o in weights}
    return j.withColumns(ranks).drop("_s", *[f"_{k}{o}" for k in "bnlt" for o in weights])


def spearman_each(df: DataFrame, keys: list[str], xs: list[str], y: str, min_n: int = 3) -> DataFrame:
    """V01 for several columns against one: (keys, name, n, rho) from average ranks of the pairs that are complete for
    the column; NULL when n < ``min_n`` or flat.

    Rows are ranked by ``y`` once, for all columns side by side, and then summed per value of a column: the products
    need no more of them, and a column with few values shuffles next to nothing."""
    some = F.lit(False)
    for x in xs:
        some |= F.col(x).isNotNull()
    d = df.where(F.col(y).isNotNull() & some).select(*keys, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    d = d.withColumns({f"_w{i}": F.col(f"_x{i}").isNotNull().cast("long") for i in range(len(xs))})
    d = _ranked(d, keys, "_y", {f"_r{i}": f"_w{i}" for i in range(len(xs))})
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("_name"), F.col(f"_x{i}").alias("_x"), F.col(f"_r{i}").alias("_r")) for i, x in enumerate(xs)]))
    d = d.select(*keys, each.alias("_e")).select(*keys, "_e.*").where("_x is not null")
    d = d.groupBy(*keys, "_name", "_x").agg(F.count("*").alias("_w"), F.sum("_r").alias("_r"), F.sum(F.col("_r") * F.col("_r")).alias("_rr"))
    d = written(d, "values")  # ranked next, in two passes
    d = _ranked(d, [*keys, "_name"], "_x", {"_q": "_w"})
    g = d.groupBy(*keys, F.col("_name").alias("name")).agg(F.sum("_w").alias("n"), F.sum(F.col("_q") * F.col("_r")).alias("_xy"),
                                                           F.sum(F.col("_w") * F.col("_q") * F.col("_q")).alias("_xx"), F.sum("_rr").alias("_yy"))
    ok = (F.col("n") >= min_n) & (F.col("_xx") > 0) & (F.col("_yy") > 0)
    return g.select(*keys, "name", "n", F.when(ok, F.col("_xy") / (F.sqrt("_xx") * F.sqrt("_yy"))).alias("rho"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """(keys, n, rho) from average ranks of complete pairs; NULL when n < ``min_n`` or flat."""
    return spearman_each(df, keys, [x], y, min_n).drop("name")
