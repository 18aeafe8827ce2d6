"""Column definitions of the lens views that both engines read as the same SQL text."""

from __future__ import annotations

# How driver keys stand in for instrument attributes.
TIER_OF_SUPPLIER = {0: "mega", 1: "large", 2: "mid", 3: "small", 4: "micro"}
REGION_OF = {0: "us", 1: "eu", 2: "uk", 3: "hk", 4: "other"}
EVENT_SIGNAL = {"purchase": "B", "error": "S", "click": "H", "view": "H", "signup": "I"}
SUFFIXES = ["", ".L", ".HK", ".DE", "", ".PA", ".ST", "-USD", "", ".CO", ".T", ""]
CAPS = [("3.1T", 3.1e12), ("620B", 6.2e11), ("240B", 2.4e11), ("120B", 1.2e11), ("45B", 4.5e10),
        ("11B", 1.1e10), ("6B", 6e9), ("3B", 3e9), ("2.1B", 2.1e9), ("800M", 8e8)]
SECTORS = ["Technology", "Healthcare", "Financial Services", "Consumer Cyclical",
           "Consumer Defensive", "Industrials", "Energy", "Utilities", "Real Estate",
           "Basic Materials", "Communication Services"]
INDUSTRIES = ["Semiconductors", "Biotechnology", "Banks", "Retail", "Beverages", "Airlines",
              "Oil & Gas", "Electric", "REIT", "Gold", "Media"]
PORTFOLIO_MOD = 13
NO_TRADE_MOD = 37


def sql_case(expr: str, values, quote: bool = False) -> str:
    """CASE text mapping ``expr`` to string values; reads the same in Spark and DuckDB."""
    items = values.items() if isinstance(values, dict) else enumerate(values)
    arms = " ".join(f"WHEN {repr(k) if quote else k} THEN '{v}'" for k, v in items)
    return f"CASE {expr} {arms} END"


def _num(expr: str, null_mod: int | None = None) -> str:
    body = f"cast({expr} as double)"
    return f"CASE WHEN p_partkey % {null_mod} <> 0 THEN {body} END" if null_mod else body


_ticker = f"concat('P', cast(p_partkey as varchar(20)), {sql_case('p_partkey % 12', SUFFIXES)})"
_cap_val = "CASE p_partkey % 10 " + " ".join(
    f"WHEN {i} THEN cast({v:.0f} as double)" for i, (_, v) in enumerate(CAPS)) + " END"

UNIVERSE: list[tuple[str, str]] = [
    ("ticker", _ticker),
    ("k", "p_partkey"),
    ("name", "p_name"),
    ("cap", sql_case("p_partkey % 10", [c for c, _ in CAPS])),
    ("cap_value", _cap_val),
    ("price", _num("p_partkey * 83 % 490 + 10")),
    ("upside", _num("p_partkey * 37 % 61 - 15")),
    ("buy_pct", _num("p_partkey * 53 % 76 + 25")),
    ("analysts", _num("p_partkey * 7 % 30")),
    ("targets", _num("p_partkey * 11 % 28")),
    ("pef", _num("p_partkey * 13 % 70 + 5", 17)),
    ("pet", "CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 23 = 0 "
            "THEN cast(-(p_partkey * 29 % 80 + 8) as double) ELSE cast(p_partkey * 29 % 80 + 8 as double) END"),
    ("w52", _num("p_partkey * 41 % 86 + 15", 43)),
    ("above200", "p_partkey % 4 <> 0"),
    ("am", _num("p_partkey * 31 % 17 - 8", 47)),
    ("beta", _num("p_partkey * 43 % 36", 31).replace("as double)", "as double) / 10")),
    ("roe", _num("p_partkey * 47 % 55 - 8", 13)),
    ("de", _num("p_partkey * 59 % 331", 11)),
    ("fcf", _num("p_partkey * 61 % 24 - 6", 29)),
    ("si", _num("p_partkey * 67 % 90", 37).replace("as double)", "as double) / 10")),
    ("eg", _num("p_partkey * 71 % 80 - 20", 14)),
    ("peg", _num("p_partkey * 73 % 60 + 1", 21).replace("as double)", "as double) / 10")),
    ("ps", _num("p_partkey * 79 % 90 + 2", 26).replace("as double)", "as double) / 10")),
    ("dispersion", _num("p_partkey * 89 % 160", 9)),
    ("gross_margin", _num("p_partkey * 97 % 90", 3)),
    ("dma200_pct", _num("p_partkey * 101 % 50 + 75", 15)),
    ("sector", sql_case("p_partkey % 11", SECTORS)),
    ("industry", sql_case("p_partkey * 5 % 11", INDUSTRIES)),
    ("rating_type", "CASE WHEN p_partkey % 2 = 0 THEN 'E' ELSE 'A' END"),
    ("upside_str", "CASE WHEN p_partkey % 16 = 0 THEN '--' ELSE concat(cast(p_partkey * 37 % 61 - 15 as varchar(20)), '.5%') END"),
    ("roe_str", "CASE WHEN p_partkey % 13 = 0 THEN 'nan' WHEN p_partkey % 27 = 0 THEN '' "
                "ELSE concat(cast(p_partkey * 47 % 55 - 8 as varchar(20)), '%') END"),
    ("days_to_earnings", "CASE WHEN p_partkey % 6 <> 0 THEN p_partkey * 103 % 60 - 10 END"),
    ("held", "p_partkey % 13 = 0"),
]


# Review rows: one per signal, with the views of each reviewer (fixed values: the view names).
_cyc = lambda expr, names: sql_case(expr, names)
REVIEW: list[tuple[str, str]] = [
    ("ticker", "ticker"), ("date", "date"), ("signal", "signal"), ("conviction", "conviction"), ("okey", "okey"),
    ("action", sql_case("okey % 5", ["BUY", "ADD", "HOLD", "TRIM", "SELL"])),
    ("fund_view", sql_case("okey % 3", ["BUY", "HOLD", "SELL"])),
    ("fund_score", "cast(okey * 7 % 101 as double)"),
    ("tech_signal", sql_case("okey % 7", ["ENTER_NOW", "WAIT_FOR_PULLBACK", "HOLD", "AVOID", "EXIT_SOON",
                                          "ACCUMULATE", "HOLD"])),
    ("tech_momentum", "okey * 11 % 121 - 60"),
    ("rsi", "cast(okey * 13 % 81 + 10 as double)"),
    ("macro_fit", sql_case("okey % 11 % 3", ["FAVORABLE", "NEUTRAL", "UNFAVORABLE"])),
    ("census_view", sql_case("okey % 13 % 3", ["ALIGNED", "NEUTRAL", "DIVERGENT"])),
    ("news_impact", sql_case("okey % 17 % 5", ["HIGH_POSITIVE", "LOW_POSITIVE", "NEUTRAL", "LOW_NEGATIVE",
                                               "HIGH_NEGATIVE"])),
    ("risk_warning", "okey % 19 < 4"),
    ("exret", "cast(okey * 17 % 60 - 10 as double)"),
    ("bull_pct", "cast(okey * 23 % 101 as double)"),
    ("excess_exret", "cast(okey * 29 % 40 - 15 as double)"),
    ("beta", "cast(okey * 31 % 30 as double) / 10"),
    ("buy_pct", "cast(okey * 37 % 71 + 30 as double)"),
    ("w52", "cast(okey * 41 % 86 + 15 as double)"),
    ("am", "cast(okey * 43 % 25 - 12 as double)"),
    ("sentiment", sql_case("okey % 23 % 3", ["NET_BUYING", "NEUTRAL", "NET_SELLING"])),
    ("regime", sql_case("okey % 29 % 3", ["RISK_ON", "CAUTIOUS", "RISK_OFF"])),
]
# Modifier points per review row: name, value expression (0 = not active).
WATERFALL: list[tuple[str, str]] = [
    ("rsi_oversold", "okey % 9 - 4"), ("census_bonus", "okey % 4 * 2"), ("news_penalty", "-(okey % 5)"),
    ("~sector_lag", "okey % 6 - 3"), ("high_beta", "-(okey % 3) * 2"), ("quality", "okey % 8 - 2"),
]
