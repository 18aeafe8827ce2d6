"""Row rules on one instrument: price-target quality, sizing, symbols, names, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (limit, points) from the widest limit down.
SPREAD_CUTS = [(100, 50), (75, 35), (50, 25), (30, 15)]
GAP_CUTS = [(20, 25), (10, 15), (5, 5)]
OUTLIER_CUTS = [(200, 25), (100, 15), (50, 5)]
DISTANCE_CUTS = [(300, 30), (150, 15)]
GRADES = [(85, "A"), (70, "B"), (55, "C"), (40, "D")]
LEGAL_SUFFIX = r"(?i)[ ,]+(inc|incorporated|corp|corporation|ltd|limited|plc|llc|co|company|sa|ag|nv|se)\.?$"
DROPPED_SUFFIX = r"\.(RTH|FUT|24-7)$"


def _points(x: Column, cuts) -> Column:
    c = None
    for limit, pts in cuts:
        c = F.when(x > limit, float(pts)) if c is None else c.when(x > limit, float(pts))
    return c.otherwise(0.0)


def target_quality(mean: Column, median: Column, high: Column, low: Column, price: Column, analysts: Column) -> Column:
    """Struct (score, grade, robust, flags). Any missing or zero target gives grade F."""
    known = F.coalesce((mean != 0) & (median != 0) & (high != 0) & (low != 0) & (price > 0), F.lit(False))
    spread, gap = (high - low) / median * 100, F.abs(mean - median) / median * 100
    far = F.greatest(F.abs(high - mean) / mean * 100, F.abs(low - mean) / mean * 100)
    dist = F.abs(median - price) / price * 100
    cover = F.when(analysts >= 10, 5.0).when(analysts >= 5, 2.0).when((analysts > 0) & (analysts < 3), -15.0).otherwise(0.0)
    raw = 100.0 - _points(spread, SPREAD_CUTS) - _points(gap, GAP_CUTS) - _points(far, OUTLIER_CUTS) - _points(dist, DISTANCE_CUTS) + cover
    score = F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).otherwise(0.0)
    grade = None
    for cut, g in GRADES:
        grade = F.when(score >= cut, g) if grade is None else grade.when(score >= cut, g)
    robust = known & ((score >= 70) | ((spread < 40) & (gap < 15) & (score >= 50)))
    flags = F.filter(F.array(F.when(~known, "missing"), F.when(known & (spread > 30), "spread"), F.when(known & (gap > 20), "gap"), F.when(known & (far > 200), "outlier"),
                             F.when(known & (analysts > 0) & (analysts < 3), "coverage"), F.when(known & (dist > 300), "distance")), lambda x: x.isNotNull())
    return F.struct(score.alias("score"), grade.otherwise("F").alias("grade"), F.coalesce(robust, F.lit(False)).alias("robust"), flags.alias("flags"))


def size_by_risk(level: Column, beta: Column, cap: Column, exret: Column, lo: float = 0.01, hi: float = 0.05) -> Column:
    """P25: share of the portfolio by risk level, damped by beta, tilted by size and expected return."""
    base = F.when(level == "low", lo + (hi - lo) * 0.3).when(level == "medium", lo + (hi - lo) * 0.6).otherwise(hi)
    vol = F.when(beta > 0, F.least(F.lit(1.0), 1.0 / beta)).otherwise(1.0)
    size = F.when(cap > 100e9, 1.2).when(cap > 10e9, 1.0).when(cap > 0, 0.8).otherwise(1.0)
    tilt = F.when(exret > 0, F.least(F.lit(1.5), 1.0 + exret / 50.0)).when(exret < 0, 0.5).otherwise(1.0)
    return F.greatest(F.lit(lo), F.least(base * vol * size * tilt, F.lit(hi)))


def normal_symbol(t: Column) -> Column:
    """NULL for junk suffixes, no ``.US``, four-digit Hong Kong numbers, hyphen for class dots."""
    s = F.upper(F.trim(t))
    s = F.regexp_replace(s, r"\.US$", "")
    s = F.when(s.rlike(r"^[0-9]+\.HK$"), F.concat(F.lpad(F.regexp_extract(s, r"^0*([0-9]+)\.HK$", 1), 4, "0"), F.lit(".HK"))).otherwise(s)
    s = F.regexp_replace(s, r"^([A-Z]+)\.([AB])$", "$1-$2")
    return F.when(~F.upper(F.trim(t)).rlike(DROPPED_SUFFIX), s)


def clean_name(n: Column, width: int = 14) -> Column:
    """P15."""
    return F.substring(F.upper(F.trim(F.regexp_replace(n, LEGAL_SUFFIX, ""))), 1, width)


def show_percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), "--").otherwise(F.concat(F.format_string(f"%.{digits}f", x), F.lit("%")))


def show_cap(x: Column) -> Column:
    """Three significant digits and a unit."""
    def unit(scale, u):
        v = x / scale
        return F.concat(F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v)), F.lit(u))

    return F.when(x.isNull(), "--").when(x >= 1e12, unit(1e12, "T")).when(x >= 1e9, unit(1e9, "B")).when(x >= 1e6, unit(1e6, "M")).otherwise(F.format_string("%.0f", x))
