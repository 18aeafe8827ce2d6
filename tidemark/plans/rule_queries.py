"""Row rules (P05, P21, P24, P31, P32, P57, P58) and near-duplicate headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import headlines as hl
from tidemark.operators import rules
from tidemark.plans.timeseries_queries import r6
from tidemark.registry import query
from tidemark.sources import lens

U = ("universe",)
EXRET = "upside * buy_pct / 100"


@query("p05_p21_upside_confidence", ctes=U, sql=f"""
SELECT ticker, round(CASE WHEN price > 0 THEN (price * (1 + upside / 100) / price - 1) * 100 END, 6) AS upside_pct,
 round(greatest(0, least(1, 0.6::double + CASE WHEN analysts >= 5 THEN 0.2::double ELSE 0 END + CASE WHEN analysts >= 10 THEN 0.1::double ELSE 0 END + CASE WHEN targets >= 5 THEN 0.1::double ELSE 0 END
  + abs(coalesce({EXRET}, 0)) * 0.005::double - CASE WHEN upside IS NULL THEN 0.2::double ELSE 0 END - CASE WHEN buy_pct IS NULL THEN 0.2::double ELSE 0 END)), 6) AS confidence FROM universe""")
def p05(spark, sf):
    c = F.col
    target = c("price") * (1 + c("upside") / 100)
    conf = rules.confidence(c("analysts"), c("targets"), c("upside") * c("buy_pct") / 100, c("upside"), c("buy_pct"))
    return lens.universe(spark, sf).select("ticker", r6(rules.upside(target, c("price")), "upside_pct"), r6(conf, "confidence"))


@query("p24_g37_position_size", ctes=U, sql=f"""
f AS (SELECT ticker, cap_value, ticker LIKE '%-USD' AS fund, CASE WHEN cap_value >= 100e9 THEN 10000 WHEN cap_value >= 5e9 THEN 5000 ELSE 2500 END::double AS base_size,
  CASE WHEN beta > 0 THEN greatest(0.8::double, least(1.2::double, 1.4::double - beta * 0.4::double)) ELSE 1 END AS beta_factor,
  CASE WHEN {EXRET} > 0 THEN greatest(1::double, least(1.5::double, 1 + {EXRET} * 0.0167::double)) ELSE 1 END AS return_factor, CASE WHEN ticker LIKE '%.HK' THEN 0.75::double ELSE 1 END AS region_factor FROM universe)
SELECT ticker, base_size, round(beta_factor, 6) AS beta_factor, round(return_factor, 6) AS return_factor, region_factor,
 CASE WHEN NOT fund AND cap_value >= 5e8 THEN round_even(greatest(1000::double, least(40000::double, base_size * beta_factor * return_factor * region_factor)) / 500, 0) * 500 END AS size FROM f""")
def p24(spark, sf):
    c = F.col
    f = rules.size_factors(c("cap_value"), c("upside") * c("buy_pct") / 100, c("beta"), parse.region(c("ticker")))
    d = lens.universe(spark, sf).select("ticker", "cap_value", *[v.alias(k) for k, v in f.items()])
    size = rules.position_size(c("cap_value"), *[c(k) for k in f], c("ticker").endswith("-USD"))
    return d.select("ticker", "base_size", r6("beta_factor"), r6("return_factor"), "region_factor", size.alias("size"))


@query("p31_portfolio_constraints", ctes=("portfolio", "universe"), sql="""
s AS (SELECT sector, sum(pct) AS sp FROM portfolio GROUP BY 1), x AS (SELECT p.ticker, p.pct, s.sp, u.upside - 25 AS pnl, u.above200, u.w52 - 100 AS dd, u.beta * 10 AS cash FROM portfolio p JOIN s USING (sector) JOIN universe u ON u.ticker = p.ticker),
r AS (SELECT ticker, 'cash_reserve' AS name, NOT cash < 15 AS passed, CASE WHEN cash < 15 THEN 'BLOCK' ELSE 'INFO' END AS severity FROM x
 UNION ALL SELECT ticker, 'position_stoploss', NOT (pnl <= -20 AND NOT above200), CASE WHEN pnl <= -20 AND NOT above200 THEN 'BLOCK' WHEN pnl <= -20 THEN 'WARNING' ELSE 'INFO' END FROM x
 UNION ALL SELECT ticker, 'portfolio_drawdown', NOT dd <= -15, CASE WHEN dd <= -15 THEN 'BLOCK' ELSE 'INFO' END FROM x
 UNION ALL SELECT ticker, 'position_drift', NOT pct > 7, CASE WHEN pct > 7 THEN 'WARNING' ELSE 'INFO' END FROM x
 UNION ALL SELECT ticker, 'sector_concentration', NOT sp >= 25, CASE WHEN sp >= 25 THEN 'BLOCK' ELSE 'INFO' END FROM x)
SELECT * FROM r""")
def p31(spark, sf):
    """Five checks per position; sector weights are one small aggregate joined back."""
    c = F.col
    p = lens.portfolio(spark, sf).select("ticker", "sector", "pct")
    s = p.groupBy("sector").agg(F.sum("pct").alias("sp"))
    u = lens.universe(spark, sf).select("ticker", (c("upside") - 25).alias("pnl"), "above200", (c("w52") - 100).alias("dd"), (c("beta") * 10).alias("cash"))
    x = p.join(s, "sector").join(u, "ticker")
    return x.select("ticker", F.explode(rules.constraints(c("cash"), c("pnl"), c("above200"), c("dd"), c("pct"), c("sp"))).alias("r")).select("ticker", "r.*")


@query("p32_risk_score", ctes=U, sql="""
x AS (SELECT ticker, greatest(0, least(100, abs(si) * 10 + abs(w52 - 100) * 2 + greatest(0, beta - 1) * 20 + greatest(0, 2 - coalesce(roe, 20) / 10) * 10)) AS s FROM universe WHERE si IS NOT NULL AND w52 IS NOT NULL AND beta IS NOT NULL)
SELECT ticker, cast(trunc(s) AS bigint) AS score, CASE WHEN trunc(s) >= 70 THEN 'HIGH' WHEN trunc(s) >= 40 THEN 'MODERATE' ELSE 'LOW' END AS level FROM x WHERE s IS NOT NULL""")
def p32(spark, sf):
    c = F.col
    s = rules.risk_score(c("si"), c("w52") - 100, c("beta"), F.coalesce("roe", F.lit(20.0)) / 10)
    u = lens.universe(spark, sf).where("si is not null and w52 is not null and beta is not null")
    return u.select("ticker", s.alias("score")).withColumn("level", rules.risk_level(c("score")))


#: Policy rates of the currency blocs; the book is held in euro.
RATES, HOME = {"us": 4.5, "uk": 4.25, "eu": 2.0, "hk": 4.75}, "eu"


@query("p57_p58_hedge_and_budget", ctes=("portfolio",), sql="""
e AS (SELECT CASE WHEN ticker LIKE '%.L' THEN 'uk' WHEN ticker LIKE '%.HK' THEN 'hk' WHEN ticker LIKE '%.DE' OR ticker LIKE '%.PA' OR ticker LIKE '%.ST' OR ticker LIKE '%.CO' THEN 'eu' ELSE 'us' END AS region, sum(pct) / 100 AS exposure FROM portfolio GROUP BY 1),
r AS (SELECT * FROM (VALUES ('us', 4.5), ('uk', 4.25), ('eu', 2.0), ('hk', 4.75)) t(region, rate))
SELECT region, round(exposure, 6) AS exposure, round(rate - 2.0, 2)::DOUBLE AS carry, CASE WHEN exposure <= 0.1::DOUBLE THEN 'WITHIN_CAP' WHEN rate > 2.0 THEN 'UNHEDGED' ELSE 'PARTIAL_HEDGE' END AS advice,
 round(greatest(0, exposure - 0.07::double) * 0.75::double, 6) AS budget FROM e JOIN r USING (region)""")
def p57(spark, sf):
    """Exposure per currency bloc, what holding its currency earns over the home rate, the advice on it, and the budget its surplus would give."""
    p = lens.portfolio(spark, sf).groupBy(parse.region(F.col("ticker")).alias("region")).agg((F.sum("pct") / 100).alias("exposure"))
    rates = spark.createDataFrame([(k, v, RATES[HOME]) for k, v in RATES.items()], "region string, rate double, home double")
    p = p.join(F.broadcast(rates), "region").withColumn("carry", F.col("rate") - F.col("home"))  # a literal of four rows
    return p.select("region", r6("exposure"), F.round("carry", 2).alias("carry"), rules.hedge(F.col("exposure"), F.col("carry"), 0.1).alias("advice"), r6(rules.deployable(F.col("exposure"), F.lit(0.75)), "budget"))


@query("x09_headline_near_duplicates", sql=r"""
RECURSIVE h AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(string_split(text, chr(10))[1], '')), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> ''))) AS ws FROM documents),
s AS (SELECT min(doc_id) AS doc_id, ws FROM h WHERE len(ws) >= 3 GROUP BY ws), o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM s),
wd AS (SELECT i, len(ws) AS n, unnest(ws) AS w FROM o),
e AS (SELECT a.i AS a, b.i AS b FROM wd a JOIN wd b ON a.w = b.w AND a.i < b.i GROUP BY 1, 2 HAVING count(*) * 10 > least(max(a.n), max(b.n)) * 6),
ea AS (SELECT o.i, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS before FROM o LEFT JOIN e ON e.b = o.i GROUP BY 1),
g(i, kept) AS (SELECT 0::bigint, []::bigint[] UNION ALL SELECT g.i + 1, CASE WHEN list_has_any(g.kept, ea.before) THEN g.kept ELSE list_append(g.kept, g.i + 1) END FROM g JOIN ea ON ea.i = g.i + 1),
k AS (SELECT unnest(kept) AS i FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))
SELECT h.doc_id, len(h.ws)::bigint AS n_words, kk.doc_id IS NOT NULL AS kept FROM h LEFT JOIN (SELECT o.doc_id FROM k JOIN o USING (i)) kk ON kk.doc_id = h.doc_id WHERE len(h.ws) >= 3""")
def x09(spark, sf):
    """The first lines of all documents are their headlines."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring_index("text", "\n", 1).alias("headline"))
    return hl.keep_first(d, "doc_id", "headline")
