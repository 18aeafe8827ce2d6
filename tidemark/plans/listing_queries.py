"""Listings: age after listing (F06), asset types (P09), share classes (P13), duplicates (G34), look-through."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cascade as ca
from tidemark.operators import listing as li
from tidemark.plans.universe_queries import GATE_NAMES, GATE_ROWS
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources import lens
from tidemark.sources.lens_columns import SUFFIXES, sql_case

# --- F06

F06_SQL = f"""
th AS (SELECT gate_region, tier, COLUMNS('^t_')::DOUBLE FROM (VALUES {GATE_ROWS}) t({GATE_NAMES})),
kn AS (SELECT ticker, DATE '1995-01-01' + (ticker * 37 % 700)::INT AS date FROM dims WHERE ticker % 10 = 3 UNION ALL SELECT ticker, DATE '1995-01-01' + (ticker * 37 % 700 + 1200)::INT FROM dims WHERE ticker % 20 = 3),
ls AS (SELECT * FROM kn UNION ALL SELECT ticker, min(date) FROM prices WHERE ticker NOT IN (SELECT ticker FROM kn) GROUP BY 1),
r AS (SELECT r.*, l.date AS listed, coalesce(r.date < l.date + 360, false) AS in_grace FROM reviews r ASOF LEFT JOIN ls l ON l.ticker = r.ticker AND r.date >= l.date),
g AS (SELECT r.*, th.* FROM r JOIN dims d ON d.ticker = r.ticker JOIN th ON th.tier = d.tier AND th.gate_region = CASE d.region WHEN 'eu' THEN 'eu' WHEN 'uk' THEN 'eu' WHEN 'hk' THEN 'hk' ELSE 'us' END)
SELECT ticker, date, listed, in_grace, concat_ws(',', CASE WHEN exret <= t_sell_upside THEN 'max_upside' END, CASE WHEN buy_pct <= t_sell_buy_percentage THEN 'min_buy_percentage' END, CASE WHEN beta > t_sell_beta THEN 'min_beta' END,
  CASE WHEN w52 < CASE WHEN in_grace THEN least(t_sell_pct_from_52w_high, 40) ELSE t_sell_pct_from_52w_high END THEN 'max_pct_from_52w_high' END, CASE WHEN NOT in_grace AND am < t_sell_analyst_momentum THEN 'max_analyst_momentum' END) AS triggers FROM g"""


def known_listings(spark, sf):
    """Stated listing days of some tickers, two of every other one: a stand-in by key."""
    d = lens.dims(spark, sf).select("ticker")
    day = lambda plus: F.date_add(F.lit("1995-01-01").cast("date"), (F.col("ticker") * 37 % 700 + plus).cast("int"))
    return d.where("ticker % 10 = 3").select("ticker", day(0).alias("date")).unionByName(d.where("ticker % 20 = 3").select("ticker", day(1200).alias("date")))


@query("f06_listing_grace_sell_triggers", ctes=("reviews", "prices", "dims"), sql=F06_SQL)
def f06(spark, sf):
    """Each review against the sell gates of its region and tier, judged by the age of the listing on that day."""
    region = F.when(F.col("region").isin("eu", "uk"), "eu").when(F.col("region") == "hk", "hk").otherwise("us")
    dims = lens.dims(spark, sf).select("ticker", "tier", region.alias("gate_region"))
    listed = li.listing_days(lens.prices(spark, sf), known_listings(spark, sf))
    none = F.lit(None).cast("double")
    r = lens.reviews(spark, sf).select("ticker", "date", F.col("exret").alias("upside"), "buy_pct", "w52", "am", "beta", none.alias("si"), none.alias("roe"), none.alias("de"), none.alias("pe_vs_sector"))
    d = li.with_grace(r, listed).join(dims, "ticker")
    d = d.join(F.broadcast(ca.threshold_table(spark)), ["gate_region", "tier"])  # a literal per region and tier
    return d.select("ticker", "date", "listed", "in_grace", F.concat_ws(",", ca.sell_triggers(F.col("in_grace"))).alias("triggers"))


# --- P09: a stand-in for names and symbols by key

NAME_ENDS = ["", " Inc", " ETF", " Index Fund", " Investment Trust", " Bitcoin Holdings", " Fund Management plc", " Gold ETF", " Trust Bank", " iShares Growth Fund", " Energy Ltd", " Gold Fund", " Oil Fund Corp",
             " Crypto Mining", " Unit Trust", " Trust", " Vanguard", " INDEX, Europe", " Commodity Fund", " Wealth Managers", " SPDR Index", " Digital Mining Inc", " Incline ETF.", " Bancorp"]
SYMBOLS = {1: "BTC", 2: "VET", 3: "MSTR", 4: "SPY", 5: "BLK", 6: "GOLD", 7: "VIXM", 8: "XOM", 9: "GC=F", 10: "", 11: "eth-usd", 12: "NTRS", 13: " spy ", 14: "CORN"}
NAMED = [("k", "p_partkey"), ("symbol", f"coalesce({sql_case('p_partkey % 60', SYMBOLS)}, concat('P', cast(p_partkey as varchar(20)), {sql_case('p_partkey % 12', SUFFIXES)}))"),
         ("asset_name", f"concat(p_name, {sql_case('p_partkey % 24', NAME_ENDS)})")]


@query("p09_asset_types", sql="nm AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in NAMED) + """ FROM part),
u AS (SELECT *, upper(trim(symbol)) AS t, upper(asset_name) AS n, regexp_split_to_array(regexp_replace(upper(asset_name), '[,.]', ' ', 'g'), '\\s+') AS w FROM nm)
SELECT k, symbol, asset_name, CASE WHEN t = '' THEN 'other'
  WHEN t LIKE '%-USD' OR (t IN ('BTC', 'VET', 'ETH') AND NOT regexp_matches(n, 'ENERGY|OIL|GAS|PETROLEUM|MINING|MINERALS|INC|CORP|LTD|LIMITED|PLC|LLC|CO[.]|BANK|FINANCIAL|INSURANCE|MANUFACTURING|RESOURCES|EXPLORATION|PRODUCTION|SERVICES')) THEN 'crypto'
  WHEN t = 'MSTR' OR regexp_matches(n, 'BITCOIN|CRYPTO MINING|BTC MINING|DIGITAL MINING') THEN 'bitcoin_proxy'
  WHEN t NOT IN ('BLK', 'NTRS') AND NOT regexp_matches(n, 'MANAGEMENT|MANAGERS|BANK|BANCORP|FINANCIAL SERVICES|TRUST CORP|TRUST COMPANY|FINANCIAL GROUP')
    AND (list_contains(w, 'ETF') OR list_contains(w, 'INDEX') OR (list_contains(w, 'TRUST') AND regexp_matches(n, 'INVESTMENT TRUST|UNIT TRUST|EXCHANGE TRADED')) OR (regexp_matches(n, 'ISHARES|VANGUARD|SPDR') AND regexp_matches(n, 'ETF|INDEX|FUND')) OR t = 'SPY') THEN 'etf'
  WHEN t LIKE 'VIX%' OR t LIKE '^VIX%' OR t IN ('GOLD', 'GC=F', 'CORN') THEN 'commodity'
  WHEN t <> 'XOM' AND NOT regexp_matches(n, 'INC|CORP|LTD|LIMITED|PLC|LLC|CO[.]|COMPANY|HOLDINGS|GROUP|PARTNERS|RESOURCES|ENERGY|PETROLEUM|EXPLORATION|PRODUCTION|MINING|MINERALS|UTILITIES|SERVICES')
    AND regexp_matches(n, 'COMMODITY FUND|COMMODITY ETF|GOLD FUND|GOLD ETF|SILVER FUND|SILVER ETF|OIL FUND|OIL ETF|NATURAL GAS FUND|COPPER FUND|PLATINUM FUND') THEN 'commodity'
  ELSE 'stock' END AS asset_type FROM u""")
def p09(spark, sf):
    d = lens.table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in NAMED])
    return li.with_asset_type(d.withColumn("ticker", F.col("symbol")).withColumn("name", F.col("asset_name"))).select("k", "symbol", "asset_name", "asset_type")


# --- P13, G34

CLASSED = [("symbol", "concat(CASE WHEN p_partkey % 4 = 3 THEN 'SZ' ELSE 'SY' END, cast(p_partkey div 4 as varchar(20)), CASE p_partkey % 4 WHEN 1 THEN 'B' WHEN 2 THEN '-A' ELSE 'A' END, CASE p_partkey div 4 % 5 WHEN 0 THEN '.ST' WHEN 1 THEN '.CO' WHEN 2 THEN '.L' WHEN 3 THEN '.HE' ELSE '.OL' END)"),
           ("company", "CASE p_partkey % 9 WHEN 0 THEN 'Alpha Ser. A' WHEN 1 THEN 'Beta Klass' WHEN 2 THEN NULL ELSE p_name END")]


@query("p13_share_class_repair", sql="s AS (SELECT " + ", ".join(f"{e.replace(' div ', ' // ')} AS {n}" for n, e in CLASSED) + """ FROM part WHERE p_partkey % 7 <> 3),
b AS (SELECT *, regexp_extract(symbol, '^([^-]+)([AB])([.](ST|CO|HE|OL))$', 1) AS base, regexp_extract(symbol, '^([^-]+)([AB])([.](ST|CO|HE|OL))$', 2) AS cl, regexp_extract(symbol, '^([^-]+)([AB])([.](ST|CO|HE|OL))$', 3) AS suf FROM s)
SELECT symbol, company, CASE WHEN cl <> '' AND (base || CASE cl WHEN 'A' THEN 'B' ELSE 'A' END || suf IN (SELECT symbol FROM s) OR base || '-' || CASE cl WHEN 'A' THEN 'B' ELSE 'A' END || suf IN (SELECT symbol FROM s)
  OR regexp_matches(lower(coalesce(company, '')), 'ser[.]|series|class|klass|aktie')) THEN base || '-' || cl || suf ELSE symbol END AS fixed FROM b""")
def p13(spark, sf):
    d = lens.table(spark, sf, "part").where("p_partkey % 7 <> 3").selectExpr(*[f"{e} AS {n}" for n, e in CLASSED])
    return li.with_class_hyphen(d).select("symbol", "company", "fixed")


def crossed(spark, sf):
    """Up to three listings of each security, one of five left out: a stand-in by key."""
    end = F.when(F.col("p_partkey") % 3 == 0, ".US").when(F.col("p_partkey") % 3 == 1, ".AS").otherwise(".NV")
    return lens.table(spark, sf, "part").where("p_partkey % 5 <> 4").select(F.concat(F.lit("Q"), F.expr("p_partkey div 3").cast("string"), end).alias("symbol"))


@query("g34_p13_listing_survivors", sql="""
d AS (SELECT 'Q' || (p_partkey // 3)::VARCHAR || CASE p_partkey % 3 WHEN 0 THEN '.US' WHEN 1 THEN '.AS' ELSE '.NV' END AS symbol FROM part WHERE p_partkey % 5 <> 4),
e AS (SELECT symbol AS a, left(symbol, length(symbol) - 3) || CASE right(symbol, 3) WHEN '.US' THEN '.AS' ELSE '.NV' END AS b FROM d WHERE right(symbol, 3) <> '.NV'),
p AS (SELECT a, b FROM e WHERE b IN (SELECT symbol FROM d))
SELECT symbol, coalesce(p2.b, p1.b, symbol) AS survivor, p1.b IS NULL AS kept FROM d LEFT JOIN p p1 ON p1.a = symbol LEFT JOIN p p2 ON p2.a = p1.b""")
def g34(spark, sf):
    """Chains of up to three listings: the ones that go, and what stands for them."""
    d = written(crossed(spark, sf), "listings")
    rules = [(".US", ".AS"), (".AS", ".NV")]
    kept = li.without_duplicates(d, suffixes=rules).select("symbol", F.lit(True).alias("kept"))
    ends = li.survivors(li.listing_pairs(d, suffixes=rules))
    out = d.join(kept, "symbol", "left").join(ends.withColumnRenamed("secondary", "symbol"), "symbol", "left")
    return out.select("symbol", F.coalesce("survivor", "symbol").alias("survivor"), F.coalesce("kept", F.lit(False)).alias("kept"))


# --- P59: funds (every 41st key) hold others; a stand-in by key

HOLDINGS_SQL = """
n AS (SELECT max(p_partkey) + 1 AS n FROM part),
f AS (SELECT p_partkey AS fund, n FROM part, n WHERE p_partkey % 41 = 0 AND p_partkey // 41 % 7 <> 3),
h AS (SELECT fund, n, CASE WHEN fund // 41 % 6 <> 5 AND fund + 41 < n THEN fund + 41 ELSE 1 END AS holding, 0.4::DOUBLE AS w FROM f
  UNION ALL SELECT fund, n, CASE WHEN (fund * m + a) % n % 41 <> 0 THEN (fund * m + a) % n WHEN (fund * m + a) % n + 1 < n THEN (fund * m + a) % n + 1 ELSE 1 END, w FROM f, (VALUES (5, 1, 0.3::DOUBLE), (7, 3, 0.2::DOUBLE), (11, 2, 0.1::DOUBLE)) t(m, a, w)),
b AS (SELECT fund, holding, sum(w) AS w FROM h GROUP BY 1, 2),
x AS (SELECT p_partkey AS position, p_partkey AS asset, 1::DOUBLE AS w FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 41 = 0 UNION ALL SELECT x.position, b.holding, x.w * b.w FROM x JOIN b ON b.fund = x.asset),
o AS (SELECT position, asset, sum(w) AS weight FROM x WHERE asset NOT IN (SELECT fund FROM b) GROUP BY 1, 2),
c AS (SELECT o.*, u.industry, CASE WHEN asset % 41 = 0 THEN 'etf' WHEN u.ticker LIKE '%-USD' THEN 'crypto' ELSE 'stock' END AS kind, u.ticker, p.p_size FROM o JOIN universe u ON u.k = o.asset JOIN part p ON p.p_partkey = o.asset),
g AS (SELECT position, weight, CASE WHEN kind = 'crypto' THEN 'Crypto' WHEN kind = 'etf' THEN NULL WHEN ticker LIKE '%.DE' OR ticker LIKE '%.PA' OR ticker LIKE '%.L' OR ticker LIKE '%.CO' THEN 'Europe'
  WHEN ticker LIKE '%.HK' THEN CASE WHEN p_size < 10 THEN 'United States' ELSE 'China' END WHEN p_size < 10 THEN 'United States' ELSE 'Other' END AS place FROM c)"""


def funds_held(spark, sf):
    part = lens.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    n = part.agg((F.max("k") + 1).alias("n"))
    f = part.where("k % 41 = 0 and k div 41 % 7 <> 3").join(F.broadcast(n))  # n: one row
    first = F.expr("CASE WHEN k div 41 % 6 <> 5 AND k + 41 < n THEN k + 41 ELSE 1 END")
    other = lambda m, a: F.expr(f"CASE WHEN (k * {m} + {a}) % n % 41 <> 0 THEN (k * {m} + {a}) % n WHEN (k * {m} + {a}) % n + 1 < n THEN (k * {m} + {a}) % n + 1 ELSE 1 END")
    rows = [(first, 0.4), (other(5, 1), 0.3), (other(7, 3), 0.2), (other(11, 2), 0.1)]
    held = F.explode(F.array(*[F.struct(h.cast("long").alias("holding"), F.lit(w).alias("weight")) for h, w in rows]))
    return f.select(F.col("k").alias("fund"), held.alias("h")).select("fund", "h.holding", "h.weight")


@query("p59_fund_look_through", ctes=("universe",), sql="RECURSIVE " + HOLDINGS_SQL.strip() + """,
e AS (SELECT position, 'geography' AS dim, place AS bucket, weight FROM g WHERE place IS NOT NULL
  UNION ALL SELECT position, 'geography', r.bucket, weight * r.share FROM g, (VALUES ('United States', 0.4::DOUBLE), ('Europe', 0.25::DOUBLE), ('China', 0.1::DOUBLE), ('Other', 0.25::DOUBLE)) r(bucket, share) WHERE place IS NULL
  UNION ALL SELECT position, 'industry', CASE kind WHEN 'etf' THEN 'Diversified' WHEN 'crypto' THEN 'Crypto' ELSE industry END, weight FROM c)
SELECT position, dim, bucket, round(sum(weight), 9) AS weight FROM e GROUP BY 1, 2, 3""")
def p59(spark, sf):
    """Positions (funds among them) down to what they hold, by geography and industry."""
    part = lens.table(spark, sf, "part")
    positions = part.where("p_partkey % 13 = 0 or p_partkey % 41 = 0").select(F.col("p_partkey").alias("position"), F.col("p_partkey").alias("asset"), F.lit(1.0).alias("weight"))
    held = li.look_through(positions, funds_held(spark, sf))
    home = part.select(F.col("p_partkey").alias("asset"), F.when(F.col("p_size") < 10, "United States").alias("home"))
    kind = F.when(F.col("k") % 41 == 0, "etf").when(F.col("ticker").endswith("-USD"), "crypto").otherwise("stock")
    u = lens.universe(spark, sf).select(F.col("k").alias("asset"), "ticker", "industry", kind.alias("asset_type"))
    d = held.join(u, "asset").join(home, "asset").withColumn("place", li.place(F.col("ticker"), F.col("home"), F.col("asset_type")))
    return li.exposures(d).select("position", "dim", "bucket", F.round("weight", 9).alias("weight"))
