"""Sector classes and the gates they change.

A listing's class is its most specific match: its ticker, else its industry, else its sector. A
class states some gates (or switches them off); every other gate stays as region and tier have it.

Members of a class come as one table (scope, key, class). Each scope is an equi-join on a key that is
unique there; a side is broadcast only if it was counted to be small, so a ticker list may grow
with the universe while industries and sectors, whose keys are hot, stay dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import small

SCOPES = ("ticker", "industry", "sector")
# Gates that a class states; None switches the gate off.
CLASS_GATES: dict[str, dict[str, float | None]] = {
    "FINANCIAL": {"min_roe": 6, "sell_roe": 3, "max_debt_equity": 500, "sell_debt_equity": 800},
    "REIT": {"min_roe": None, "sell_roe": None, "min_fcf_yield": None, "max_debt_equity": 300, "sell_debt_equity": 400},
    "MLP": {"min_roe": 15, "sell_roe": 8, "max_debt_equity": 800, "sell_debt_equity": 1000},
    "PHARMA_HIGH_LEVERAGE": {"min_roe": 20, "sell_roe": 12, "max_debt_equity": 300, "sell_debt_equity": 400},
    "EQUIPMENT_FINANCING": {"min_roe": 12, "sell_roe": 8, "max_debt_equity": 300, "sell_debt_equity": 400},
    "UTILITY": {"min_roe": 8, "sell_roe": 5, "max_debt_equity": 250, "sell_debt_equity": 350, "min_fcf_yield": -10},
    "PAYMENT_PROCESSORS": {"min_roe": 30, "sell_roe": 20, "max_debt_equity": 250, "sell_debt_equity": 400, "max_pe_vs_sector": 1.8},
    "TELECOM": {"min_roe": 10, "sell_roe": 5, "max_debt_equity": 220, "sell_debt_equity": 350, "max_short_interest": 4, "min_fcf_yield": -5},
    "TECHNOLOGY_HARDWARE": {"min_fcf_yield": -15},
}
# The members of each class.
CLASS_TICKERS: dict[str, list[str]] = {
    "FINANCIAL": ["C", "STT", "WBS", "RITM", "MET", "GL", "SCHW", "BAC", "JPM", "WFC", "GS", "MS"],
    "REIT": ["CCI", "AMT", "SBAC", "EQIX", "DLR", "PLD"],
    "MLP": ["TRGP", "EPD", "ET", "MMP", "MPLX"],
    "PHARMA_HIGH_LEVERAGE": ["LLY", "BMY", "ABBV", "GILD"],
    "EQUIPMENT_FINANCING": ["DE", "CAT", "CNH"],
    "UTILITY": ["VIE.PA", "NEE", "DUK", "SO", "D"],
    "PAYMENT_PROCESSORS": ["V", "MA", "AXP", "PYPL"],
    "TELECOM": ["TMUS", "VZ", "T", "VOD", "ORAN"],
    "TECHNOLOGY_HARDWARE": ["SMSN.L", "TSM", "INTC", "QCOM", "MU", "ASML"],
}
CLASS_INDUSTRIES: dict[str, list[str]] = {
    "FINANCIAL": ["Banks—Regional", "Banks—Diversified", "Insurance—Life", "Insurance—Property & Casualty", "Insurance—Diversified", "Insurance—Specialty",
                  "Asset Management", "Capital Markets", "Savings & Cooperative Banks", "Banks - Regional"],
    "REIT": ["REIT—Industrial", "REIT—Residential", "REIT—Retail", "REIT—Healthcare Facilities", "REIT—Specialty", "REIT—Office", "REIT—Diversified", "REIT—Mortgage",
             "REIT—Hotel & Motel", "Real Estate Services"],
    "UTILITY": ["Utilities—Regulated Electric", "Utilities—Diversified", "Utilities—Regulated Gas", "Utilities—Regulated Water", "Utilities—Independent Power Producers", "Utilities—Renewable"],
    "TELECOM": ["Telecom Services", "Wireless Telecommunications Services", "Integrated Telecommunications Services", "Alternative Telecommunications Services"],
    "TECHNOLOGY_HARDWARE": ["Semiconductor Equipment & Materials", "Semiconductors", "Computer Hardware", "Electronic Components", "Scientific & Technical Instruments"],
    "PAYMENT_PROCESSORS": ["Credit Services", "Financial Data & Stock Exchanges"],
    "PHARMA_HIGH_LEVERAGE": ["Drug Manufacturers—General", "Drug Manufacturers—Specialty & Generic", "Biotechnology"],
    "EQUIPMENT_FINANCING": ["Farm & Heavy Construction Machinery", "Industrial Distribution"],
    "MLP": ["Oil & Gas Midstream", "Oil & Gas Pipelines"],
}
CLASS_SECTORS: dict[str, list[str]] = {"FINANCIAL": ["Financial Services", "Financial"], "REIT": ["Real Estate"], "UTILITY": ["Utilities"]}
# Usual price-earnings ratio of each sector name, and of any other.
SECTOR_PE: dict[str, float] = {
    "Technology": 28, "Information Technology": 28, "Healthcare": 22, "Health Care": 22, "Financials": 12, "Financial Services": 12, "Financial": 12,
    "Consumer Discretionary": 20, "Consumer Cyclical": 20, "Consumer Staples": 22, "Consumer Defensive": 22, "Energy": 12, "Industrials": 18,
    "Materials": 14, "Basic Materials": 14, "Real Estate": 35, "Utilities": 18, "Communication Services": 18,
}
OTHER_PE = 20.0
OVERRIDDEN = sorted({g for gates in CLASS_GATES.values() for g in gates})


def members(spark: SparkSession) -> DataFrame:
    """Published members: scope, key, sector_class."""
    rows = [(s, k, c) for s, table in zip(SCOPES, (CLASS_TICKERS, CLASS_INDUSTRIES, CLASS_SECTORS)) for c, keys in table.items() for k in keys]
    return spark.createDataFrame(rows, "scope string, key string, sector_class string")


def with_sector_class(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """P10: adds ``sector_class`` (NULL: none). Tickers match in any case. If a key has several classes in
    one scope, the first in the alphabet counts."""
    table = members(df.sparkSession) if table is None else table
    table = table.withColumn("key", F.when(F.col("scope") == "ticker", F.upper("key")).otherwise(F.col("key")))
    one = table.groupBy("scope", "key").agg(F.min("sector_class").alias("c"))
    out, found = df, []
    for s in SCOPES:
        own = small(one.filter(F.col("scope") == s).select(F.col("key").alias(f"_k_{s}"), F.col("c").alias(f"_c_{s}")))
        key = F.upper(F.col(s)) if s == "ticker" else F.col(s)
        out = out.join(own, key == F.col(f"_k_{s}"), "left")
        found.append(F.col(f"_c_{s}"))
    return out.withColumn("sector_class", F.coalesce(*found)).drop(*[f"_{x}_{s}" for s in SCOPES for x in "kc"])


def with_class_gates(df: DataFrame, gates: dict[str, dict[str, float | None]] | None = None) -> DataFrame:
    """The ``t_`` gates of region and tier, replaced where the row's class states them."""
    gates = gates or CLASS_GATES
    changed = {}
    for g in sorted({g for own in gates.values() for g in own}):
        col = F.col(f"t_{g}")
        c = None
        for name, own in gates.items():
            if g in own:
                is_it, value = F.col("sector_class") == name, F.lit(own[g]).cast("double")
                c = F.when(is_it, value) if c is None else c.when(is_it, value)
        changed[f"t_{g}"] = c.otherwise(col)
    return df.withColumns(changed)


def pe_vs_sector(pe: Column, sector: Column) -> Column:
    """Price-earnings ratio over its sector's usual one, two digits; NULL without positive earnings."""
    usual = F.coalesce(F.element_at(F.create_map(*[x for k, v in SECTOR_PE.items() for x in (F.lit(k), F.lit(float(v)))]), sector), F.lit(OTHER_PE))
    return F.when(pe > 0, F.round(pe / usual, 2))
