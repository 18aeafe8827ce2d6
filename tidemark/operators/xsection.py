"""Cross-sectional factors. A factor is a name, an input expression and a sign; higher is better."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantile_bins, with_rank, zscored


def mean_present(cols: list[Column]) -> Column:
    """Mean of the non-NULL values; NULL when none is present."""
    n = reduce(add, [c.isNotNull().cast("int") for c in cols])
    s = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(n > 0, s / n)


def weighted_present(cols: list[Column], weights: list[float]) -> Column:
    """Weighted mean over present values."""
    den = reduce(add, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in zip(cols, weights)])
    num = reduce(add, [F.coalesce(c, F.lit(0.0)) * w for c, w in zip(cols, weights)])
    return F.when(den > 0, num / den)


def _inv_pos(c: str) -> Column:
    return F.when(F.col(c) > 0, 1.0 / F.col(c))


def factor_inputs() -> dict[str, dict[str, Column]]:
    """Each factor is the mean of the z-scores of its inputs. A registry of builders (E01):
    callers add an entry instead of injecting a function per row."""
    c = F.col
    return {
        "value": {"ey_t": _inv_pos("pet"), "ey_f": _inv_pos("pef"), "fcf": c("fcf"), "sy": _inv_pos("ps")},
        "quality": {"roe": c("roe"), "de": -c("de"), "fcf": c("fcf"), "eg": c("eg")},
        "momentum": {"w52": c("w52"), "am": c("am")},
        "low_vol": {"beta": -c("beta")},
        "size": {"cap": F.when(c("cap_value") > 0, -F.ln("cap_value"))},
    }


def _long(df: DataFrame, ids: list[str], keys: list[str], cols: dict[str, Column]) -> DataFrame:
    """One row per (row, column): all columns then share one ranking or scoring pass, where a chain
    of passes would re-read its whole lineage for every column."""
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("_col"), c.cast("double").alias("_x")) for n, c in cols.items()]))
    return df.select(*dict.fromkeys([*ids, *keys]), e.alias("_e")).select(*dict.fromkeys([*ids, *keys]), "_e.*")


def _wide(long: DataFrame, ids: list[str], cols, value: str, prefix: str) -> DataFrame:
    return long.groupBy(*ids).agg(*[F.max(F.when(F.col("_col") == n, F.col(value))).alias(f"{prefix}{n}") for n in cols])


def factors(df: DataFrame, ids: list[str], keys: list[str], which: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """(ids, one column per factor), scored within ``keys``."""
    which = which or factor_inputs()
    inputs = {n: e for parts in which.values() for n, e in parts.items()}
    z = zscored(_long(df, ids, keys, inputs), [*keys, "_col"], "_x", "_z")
    w = _wide(z, ids, inputs, "_z", "z_")
    return w.select(*ids, *[mean_present([F.col(f"z_{n}") for n in parts]).alias(f) for f, parts in which.items()])


def pct_rank(df: DataFrame, keys: list[str], value: str, out: str, ascending: bool = True, nulls_last_pct: bool = False) -> DataFrame:
    """Average rank over n. With ``nulls_last_pct`` NULLs are ranked above all values, sharing
    the average of the top places."""
    d = with_rank(df.withColumn("_v", F.col(value) if ascending else -F.col(value)), keys, "_v", "_p_")
    if not nulls_last_pct:
        return d.withColumn(out, F.col("_p_rank") / F.col("_p_n")).drop("_v", "_p_rank", "_p_n", "_p_le")
    from tidemark.operators.ranks import with_group
    d = with_group(d, keys, F.count("*").alias("_all"), F.count("_v").alias("_have"))
    top = (F.col("_have") + 1 + F.col("_all")) / 2.0
    return d.withColumn(out, F.coalesce(F.col("_p_rank"), top) / F.col("_all")).drop("_v", "_p_rank", "_p_n", "_p_le", "_all", "_have")


def quantile_labels(df: DataFrame, keys: list[str], value: str, top: float, bottom: float, names=("B", "S", "H")) -> DataFrame:
    """Top and bottom fractions by percentile cuts; the bottom label is written last, so it
    wins at a point mass. NULL takes the neutral label."""
    if top + bottom > 1.0 + 1e-9:
        raise ValueError("top and bottom fractions overlap")
    from tidemark.operators.ranks import _safe_join, percentiles
    cuts = percentiles(df, keys, value, {"_hi": 1 - top, "_lo": bottom}).drop("n")
    j = _safe_join(df, cuts, keys, "left")
    v = F.col(value)
    lab = F.when(v.isNull(), names[2])
    if bottom > 0:
        lab = lab.when(v <= F.col("_lo"), names[1])
    if top > 0:
        lab = lab.when(v >= F.col("_hi"), names[0])
    return j.withColumn("label", lab.otherwise(names[2])).drop("_hi", "_lo")


def percentile_composite(df: DataFrame, ids: list[str], keys: list[str], weights: dict[str, tuple[float, bool]], out: str = "composite") -> DataFrame:
    """Weighted sum of percent ranks (NULL counts as 50), and a quintile 5..1 of the result."""
    long = _long(df, ids, keys, {c: (F.col(c) if asc else -F.col(c)) for c, (_, asc) in weights.items()})
    r = with_rank(long, [*keys, "_col"], "_x", "_p_").withColumn("_pct", F.col("_p_rank") / F.col("_p_n") * 100.0)
    w = _wide(r, list(dict.fromkeys([*ids, *keys])), weights, "_pct", "_r_")
    score = reduce(add, [F.coalesce(F.col(f"_r_{c}"), F.lit(50.0)) * wt for c, (wt, _) in weights.items()])
    # rounding keeps equal scores equal before they are binned
    d = w.select(*dict.fromkeys([*ids, *keys]), score.alias(out), F.round(score, 9).alias("_s"))
    return quantile_bins(d, keys, "_s", 5, "_bin").withColumn("quintile", 5 - F.col("_bin")).drop("_s", "_bin")
