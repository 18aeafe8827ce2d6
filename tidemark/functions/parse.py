"""Text to typed columns, ticker attributes, and filter building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ticker suffix -> region, currency.
REGION_OF_SUFFIX = {".L": "uk", ".HK": "hk", ".DE": "eu", ".PA": "eu", ".AS": "eu", ".MI": "eu", ".MC": "eu", ".CO": "eu", ".ST": "eu", ".OL": "eu", ".HE": "eu", ".BR": "eu", ".NV": "eu"}
CURRENCY_OF_SUFFIX = {".L": "GBP", ".HK": "HKD", ".DE": "EUR", ".PA": "EUR", ".AS": "EUR", ".MI": "EUR", ".MC": "EUR", ".BR": "EUR", ".HE": "EUR", ".ST": "SEK", ".CO": "DKK", ".OL": "NOK", ".T": "JPY"}
CAP_UNITS = {"T": 1e12, "B": 1e9, "M": 1e6}


def number(c: str | Column) -> Column:
    """Double or NULL; blanks, dashes and NaN become NULL."""
    x = F.col(c) if isinstance(c, str) else c
    v = x.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def percent(c: str, zero: bool = False) -> Column:
    """``"94%"`` to 94.0; unreadable text is NULL, or 0 with ``zero``."""
    v = number(F.rtrim(F.trim(F.col(c)), F.lit("%")))
    return F.coalesce(v, F.lit(0.0)) if zero else v


def market_cap(c: str) -> Column:
    """``2.47T``, ``628B``, ``4M``; unreadable text is 0."""
    t = F.upper(F.trim(F.col(c)))
    unit = F.lit(1.0)
    for u, m in CAP_UNITS.items():
        unit = F.when(t.endswith(u), m).otherwise(unit)
    return F.coalesce(F.round(number(F.regexp_replace(t, "[TBM,$]", "")) * unit), F.lit(0.0))


def _by_suffix(t: Column, table: dict[str, str], otherwise: str) -> Column:
    suffix = F.regexp_extract(t, r"(\.[A-Z]+)$", 1)
    c = None
    for k, v in table.items():
        c = F.when(suffix == k, v) if c is None else c.when(suffix == k, v)
    return c.otherwise(otherwise)


def region(t: Column) -> Column:
    return _by_suffix(t, REGION_OF_SUFFIX, "us")


def currency(t: Column) -> Column:
    return _by_suffix(t, CURRENCY_OF_SUFFIX, "USD")


def apply_criteria(df: DataFrame, criteria: dict[str, dict]) -> DataFrame:
    """range, membership and equality tests from a dict. NULL passes a numeric range and
    fails a membership test. Only literal predicates are built, so they reach the scan."""
    for c, rule in criteria.items():
        x = F.col(c)
        if "min" in rule:
            df = df.where((x >= rule["min"]) | x.isNull())
        if "max" in rule:
            df = df.where((x <= rule["max"]) | x.isNull())
        if "in" in rule:
            df = df.where(x.isin(*rule["in"]))
        if "eq" in rule:
            df = df.where(x == rule["eq"])
    return df
