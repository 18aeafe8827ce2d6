"""Listings: age, asset type, share classes, duplicates, and what funds hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timeseries import asof_backward
from tidemark.session import small, written

#: Fixed value: days after its listing in which a name is judged mildly (twelve months of thirty days).
GRACE_DAYS = 360


def listing_days(px: DataFrame, known: DataFrame) -> DataFrame:
    """Dated dimension (ticker, date): the known listing days of a ticker (a relisted one has several), else its first
    trading day."""
    first = px.groupBy("ticker").agg(F.min("date").alias("date"))
    return known.select("ticker", "date").unionByName(first.join(known, "ticker", "left_anti").select("ticker", "date"))


def with_grace(df: DataFrame, listed: DataFrame, days: int = GRACE_DAYS) -> DataFrame:
    """adds ``listed`` (the last listing day on or before the row's day) and ``in_grace``: from that day on, for
    ``days`` days. One shuffle on the ticker, whatever the number of listings."""
    d = asof_backward(df, listed, "ticker", "date", {}, keep_date="listed")
    return d.withColumn("in_grace", F.coalesce(F.col("date") < F.date_add("listed", days), F.lit(False)))


# Fixed values of the asset types: tickers, and texts that a name holds.
PROXY_TICKERS = ["MSTR", "COIN", "CLSK", "MARA", "RIOT", "HUT", "BTBT", "CIFR", "IREN", "BTDR"]
PROXY_TEXTS = ["BITCOIN", "CRYPTO MINING", "BTC MINING", "DIGITAL MINING"]
CRYPTO_TICKERS = ["BTC", "ETH", "XRP", "LTC", "BCH", "ADA", "DOT", "LINK", "XLM", "DOGE", "SOL", "HBAR", "MATIC", "AVAX", "ATOM", "ALGO", "VET", "FIL", "THETA", "TRX", "EOS", "XMR", "DASH", "ZEC", "NEO", "QTUM",
                  "ONT", "IOTA", "XTZ"]
BUSINESS_TEXTS = ["ENERGY", "OIL", "GAS", "PETROLEUM", "MINING", "MINERALS", "INC", "CORP", "LTD", "LIMITED", "PLC", "LLC", "CO.", "BANK", "FINANCIAL", "INSURANCE", "MANUFACTURING", "RESOURCES", "EXPLORATION",
                  "PRODUCTION", "SERVICES"]
NOT_ETF_TICKERS = ["JUP.L", "BLK", "TROW", "BEN", "IVZ", "SEIC", "AMG", "JHG", "VCTR", "APAM", "VRTS", "NTRS", "BNY", "STB.L", "TFC", "FITB", "CFG"]
MANAGER_TEXTS = ["MANAGEMENT", "MANAGERS", "BANK", "BANCORP", "FINANCIAL SERVICES", "TRUST CORP", "TRUST BANK", "FINANCIAL GROUP", "TRUST COMPANY", "BANKING"]
ETF_WORDS = ["ETF", "INDEX"]
TRUST_TEXTS = ["INVESTMENT TRUST", "UNIT TRUST", "EXCHANGE TRADED"]
ETF_BRANDS, BRAND_TEXTS = ["ISHARES", "VANGUARD", "SPDR"], ["ETF", "INDEX", "FUND"]
ETF_TICKERS = [
    "SPY", "QQQ", "IWM", "VTI", "VOO", "VEA", "VWO", "BND", "AGG", "LQD", "HYG", "EMB", "TLT", "IEF", "SHY", "TIP", "GLD", "SLV", "USO", "UNG", "PDBC", "DJP", "IAU", "SGOL", "XLE", "XLF", "XLK", "XLV", "XLI", "XLB",
    "XLRE", "XLY", "XLP", "XLU", "VGT", "VHT", "VFH", "VNQ", "VDE", "VAW", "VIS", "VCR", "VDC", "VPU", "ARKK", "ARKQ", "ARKW", "ARKG", "ARKF", "ICLN", "CLEAN", "PBW", "QCLN", "SMOG", "FAN", "EWJ", "EWZ", "EWW",
    "EWG", "EWU", "EWC", "EWA", "EWS", "EWT", "EWY", "EWP", "EWI", "EWQ", "EWL", "EWK", "EWD", "EWN", "EWO", "EWH", "EPP", "EZA", "ECH", "EPHE", "EPU", "ERUS", "RSX", "EEM", "IEMG", "SCHE", "EDC", "EWX", "FXI",
    "ASHR", "MCHI", "KWEB", "CXSE", "GXC", "TAO", "LYXGRE.DE", "UVXY", "VXX", "VIXY", "SVXY",
]
COMMODITY_TICKERS = ["GC=F", "SI=F", "CL=F", "NG=F", "HG=F", "PA=F", "PL=F", "GOLD", "SILVER", "COPPER", "PLATINUM", "PALLADIUM", "WHEAT", "CORN", "SOYBEAN", "SUGAR", "COFFEE", "COTTON"]
NOT_COMMODITY_TICKERS = ["XOM", "CVX", "COP", "EOG", "SLB", "OXY", "PSX", "VLO", "MPC", "HES", "IMO", "CNQ", "SU", "CVE", "TRP", "ENB", "BP", "SHEL", "TTE", "BP.L", "SHEL.L", "TTE.PA", "ENI.MI", "REP.MC", "EQNR.OL",
                         "IG.MI", "ANTO.L", "RIO", "BHP", "VALE", "FCX", "NEM", "GOLD", "AEM"]
COMPANY_TEXTS = ["INC", "CORP", "LTD", "LIMITED", "PLC", "LLC", "CO.", "COMPANY", "HOLDINGS", "GROUP", "PARTNERS", "RESOURCES", "ENERGY", "PETROLEUM", "EXPLORATION", "PRODUCTION", "MINING", "MINERALS",
                 "UTILITIES", "SERVICES"]
COMMODITY_TEXTS = ["COMMODITY FUND", "COMMODITY ETF", "GOLD FUND", "GOLD ETF", "SILVER FUND", "SILVER ETF", "OIL FUND", "OIL ETF", "NATURAL GAS FUND", "COPPER FUND", "PLATINUM FUND"]

#: Which list a ticker can be on; a ticker may be on several.
TICKER_LISTS = {"proxy": PROXY_TICKERS, "crypto": CRYPTO_TICKERS, "not_etf": NOT_ETF_TICKERS, "etf": ETF_TICKERS, "commodity": COMMODITY_TICKERS, "not_commodity": NOT_COMMODITY_TICKERS}


def ticker_lists(spark) -> DataFrame:
    """Dictionary (list, ticker) of the published tickers; a caller may add rows."""
    return spark.createDataFrame([(k, t) for k, v in TICKER_LISTS.items() for t in v], "list string, ticker string")


def with_asset_type(df: DataFrame, lists: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Crypto, bitcoin_proxy, etf, commodity or stock, in this order of priority; other without a ticker.

    The ticker dictionary is reduced to one row per ticker and joined (sent to all only if it is
    small); words and texts of the name are tested in the same projection, so names are not exploded. A
    crypto ticker whose name is that of a business is none; names of managers and banks are no funds; names
    of companies are no commodities.
    """
    lists = ticker_lists(df.sparkSession) if lists is None else lists
    on = lists.groupBy(F.upper(F.trim("ticker")).alias("_t")).agg(F.collect_set("list").alias("_on"))
    d = df.withColumn("_key", F.upper(F.trim("ticker"))).join(small(on), F.col("_key") == F.col("_t"), "left")
    n = F.coalesce(F.upper(F.col(name)), F.lit(""))
    words = F.split(F.regexp_replace(n, "[,.]", " "), r"\s+")
    listed = lambda k: F.coalesce(F.array_contains("_on", k), F.lit(False))
    word = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))

    def holds(texts: list[str]) -> Column:
        c = n.contains(texts[0])
        for t in texts[1:]:
            c |= n.contains(t)
        return c

    crypto = F.col("_key").endswith("-USD") | (listed("crypto") & ~holds(BUSINESS_TEXTS))
    proxy = listed("proxy") | holds(PROXY_TEXTS)
    fund = word(*ETF_WORDS) | (word("TRUST") & holds(TRUST_TEXTS)) | (holds(ETF_BRANDS) & holds(BRAND_TEXTS)) | listed("etf")
    etf = ~listed("not_etf") & ~holds(MANAGER_TEXTS) & fund
    vix = F.col("_key").startswith("VIX") | F.col("_key").startswith("^VIX")
    commodity = vix | listed("commodity") | (~listed("not_commodity") & ~holds(COMPANY_TEXTS) & holds(COMMODITY_TEXTS))
    kind = F.when(F.coalesce(F.col("_key"), F.lit("")) == "", "other").when(crypto, "crypto").when(proxy, "bitcoin_proxy").when(etf, "etf").when(commodity, "commodity").otherwise("stock")
    return d.withColumn("asset_type", kind).drop("_key", "_t", "_on")


# Exchanges whose symbols carry share classes, and words of a name that say so.
CLASS_SUFFIXES = [".ST", ".CO", ".HE", ".OL"]
CLASS_WORDS = ["ser.", "series", "class", "klass", "aktie"]


def with_class_hyphen(df: DataFrame, symbol: str = "symbol", company: str = "company") -> DataFrame:
    """Adds ``fixed``: the symbol with a hyphen before its share class A or B, if the other class is there too (with
    or without a hyphen) or the name speaks of a class. Only symbols of that shape look for their sibling
    (two candidate keys each, a semi join)."""
    s = F.col(symbol)
    parts = F.regexp_extract(s, r"^([^-]+)([AB])(\.(?:ST|CO|HE|OL))$", 1), F.regexp_extract(s, r"^([^-]+)([AB])(\.(?:ST|CO|HE|OL))$", 2), F.regexp_extract(s, r"^([^-]+)([AB])(\.(?:ST|CO|HE|OL))$", 3)
    shaped = df.select(s.alias("_s"), *[p.alias(n) for p, n in zip(parts, ("_base", "_class", "_end"))]).where("_class <> ''").distinct()
    other = F.when(F.col("_class") == "A", "B").otherwise("A")
    keys = F.array(F.concat("_base", other, "_end"), F.concat("_base", F.lit("-"), other, "_end"))
    sibling = shaped.select("_s", F.explode(keys).alias("_key")).join(df.select(s.alias("_key")).distinct(), "_key", "left_semi").select("_s").distinct().withColumn("_pair", F.lit(True))
    named = F.lit(False)
    for w in CLASS_WORDS:
        named |= F.contains(F.lower(F.coalesce(F.col(company), F.lit(""))), F.lit(w))
    d = df.join(sibling, s == F.col("_s"), "left")
    fix = (parts[1] != "") & (F.coalesce(F.col("_pair"), F.lit(False)) | named)
    return d.withColumn("fixed", F.when(fix, F.concat(parts[0], F.lit("-"), parts[1], parts[2])).otherwise(s)).drop("_s", "_pair")


# Secondary listing and the one to keep; suffixes of the same exchange.
SAME_SECURITY = [("GOOGL", "GOOG"), ("BRK.A", "BRK.B"), ("BABA", "9988.HK"), ("NVO", "NOVO-B.CO"), ("SAP", "SAP.DE"), ("SONY", "6758.T"), ("TCEHY", "0700.HK"), ("JD", "9618.HK"), ("SHEL", "SHEL.L"), ("BYDDY", "1211.HK"),
                 ("SNY", "SAN.PA"), ("TM", "7203.T"), ("UL", "ULVR.L"), ("RIO", "RIO.L"), ("BHP", "BHP.AX")]
SAME_EXCHANGE = [(".AS", ".NV")]


def listing_pairs(df: DataFrame, pairs: DataFrame | None = None, suffixes=SAME_EXCHANGE, symbol: str = "symbol") -> DataFrame:
    """(secondary, primary) of listings that are both present: stated pairs, and equal stems under suffixes of one exchange."""
    spark = df.sparkSession
    there = df.select(F.col(symbol).alias("s")).distinct()
    stated = spark.createDataFrame(SAME_SECURITY, "secondary string, primary string") if pairs is None else pairs.select("secondary", "primary")
    for a, b in suffixes:
        stem = F.expr(f"substring(s, 1, length(s) - {len(a)})")
        stated = stated.unionByName(there.where(F.col("s").endswith(a)).select(F.col("s").alias("secondary"), F.concat(stem, F.lit(b)).alias("primary")))
    both = stated.distinct().join(there.select(F.col("s").alias("secondary")), "secondary", "left_semi")
    return both.join(there.select(F.col("s").alias("primary")), "primary", "left_semi").where("secondary <> primary").select("secondary", "primary")


def survivors(pairs: DataFrame) -> DataFrame:
    """(secondary, survivor): the end of each chain of pairs, by pointer doubling: the number of rounds is the
    logarithm of the longest chain. Of several primaries the first in order counts. Pairs that run in a circle are an error."""
    p = written(pairs.groupBy("secondary").agg(F.min("primary").alias("survivor")), "pairs")
    rounds = 1 + math.ceil(math.log2(p.count() + 1))
    for _ in range(rounds):
        step = p.select(F.col("secondary").alias("_s"), F.col("survivor").alias("_to"))
        nxt = written(p.join(step, F.col("survivor") == F.col("_s"), "left").select("secondary", F.coalesce("_to", "survivor").alias("survivor"), F.col("_to").isNotNull().alias("moved")), "pairs")
        p = nxt.select("secondary", "survivor")
        if nxt.where("moved").isEmpty():
            return p
    raise ValueError("listing pairs run in a circle")


def without_duplicates(df: DataFrame, pairs: DataFrame | None = None, suffixes=SAME_EXCHANGE, symbol: str = "symbol") -> DataFrame:
    """Listings without those whose primary is there as well."""
    gone = listing_pairs(df, pairs, suffixes, symbol).select(F.col("secondary").alias(symbol)).distinct()
    return df.join(gone, symbol, "left_anti")


def look_through(positions: DataFrame, bridge: DataFrame, most_rounds: int = 32) -> DataFrame:
    """What positions hold in the end. ``positions``: position, asset, weight; ``bridge``: fund, holding, weight (the
    holdings of a fund weigh 1 together). Funds are replaced by their holdings until none is left; equal
    holdings of a position are added up in each round, so a round has at most one row per position and
    holding. A fund without holdings stays as it is. More rounds than ``most_rounds`` mean that funds hold
    each other in a circle, which is an error."""
    b = written(bridge.groupBy("fund", "holding").agg(F.sum("weight").alias("share")), "bridge")
    funds = b.select("fund").distinct()
    open_, done = positions.select("position", "asset", "weight"), None
    for _ in range(most_rounds):
        now = written(open_.join(funds.withColumn("_fund", F.lit(True)), open_["asset"] == funds["fund"], "left").drop("fund"), "look-through")
        flat = now.where("_fund is null").select("position", "asset", "weight")
        done = flat if done is None else done.unionByName(flat)
        nested = now.where("_fund")
        if nested.isEmpty():
            return done.groupBy("position", "asset").agg(F.sum("weight").alias("weight"))
        open_ = nested.join(b, F.col("asset") == F.col("fund")).groupBy("position", F.col("holding").alias("asset")).agg(F.sum(F.col("weight") * F.col("share")).alias("weight"))
    raise ValueError("funds hold each other in a circle")


# Place by listing; what a fund of unknown holdings counts as.
PLACE_OF_SUFFIX = {".DE": "Europe", ".PA": "Europe", ".MI": "Europe", ".L": "Europe", ".CO": "Europe", ".HK": "China"}
UNKNOWN_FUND = {"United States": 0.40, "Europe": 0.25, "China": 0.10, "Other": 0.25}


def place(symbol: Column, home: Column, asset_type: Column) -> Column:
    """Geography of a holding: crypto and commodities by themselves, then the listing's suffix, then its stated home; NULL for a fund."""
    c = F.when(asset_type == "crypto", "Crypto").when(asset_type == "commodity", "Commodities").when(asset_type == "etf", F.lit(None))
    for suffix, where in PLACE_OF_SUFFIX.items():
        c = c.when(symbol.endswith(suffix), F.coalesce(home, F.lit(where)) if suffix == ".HK" else F.lit(where))
    return c.otherwise(F.coalesce(home, F.lit("Other")))


def exposures(held: DataFrame) -> DataFrame:
    """(position, dim, bucket, weight) of look-through rows (position, weight, place, industry, asset_type); funds of unknown
    holdings are spread by ``UNKNOWN_FUND``, their industry is Diversified."""
    spread = F.when(F.col("place").isNull(), F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(v).alias("share")) for k, v in UNKNOWN_FUND.items()])).otherwise(F.array(F.struct(F.col("place").alias("bucket"), F.lit(1.0).alias("share"))))
    industry = F.when(F.col("asset_type") == "etf", "Diversified").when(F.col("asset_type") == "crypto", "Crypto").when(F.col("asset_type") == "commodity", "Commodities").otherwise(F.coalesce("industry", F.lit("Other")))
    geo = held.select("position", F.lit("geography").alias("dim"), F.explode(spread).alias("x"), "weight").select("position", "dim", "x.bucket", (F.col("weight") * F.col("x.share")).alias("weight"))
    ind = held.select("position", F.lit("industry").alias("dim"), industry.alias("bucket"), "weight")
    return geo.unionByName(ind).groupBy("position", "dim", "bucket").agg(F.sum("weight").alias("weight"))
