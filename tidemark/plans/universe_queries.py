"""Snapshot queries over the universe view: F01-F17, P01-P31, K*, A11-A24, G14-G19."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import cascade as ca
from tidemark.operators import outcomes as oc
from tidemark.operators import sector_rules as sr
from tidemark.operators.ranks import _safe_join, medians, percentiles
from tidemark.plans.outcome_queries import rnd
from tidemark.plans.timeseries_queries import r6
from tidemark.registry import query
from tidemark.sources import lens

U = ("universe",)


def typed(spark, sf):
    u = lens.universe(spark, sf)
    asset = F.when(F.col("ticker").endswith("-USD"), "crypto").when(F.col("k") % 41 == 0, "etf").when(F.col("k") % 43 == 5, "bitcoin_proxy").otherwise("stock")
    return u.withColumn("asset_type", asset)


def sql_interp(x, xs, ys):
    c = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {xs[0]} THEN {float(ys[0])}"
    for (x0, x1), (y0, y1) in zip(zip(xs, xs[1:]), zip(ys, ys[1:])):
        c += f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) * {float(y1 - y0)} / {float(x1 - x0)}"
    return f"cast({c} ELSE {float(ys[-1])} END as double)"


S, B = ca.SELL_CURVES, ca.BUY_CURVES
RATIO = "CASE WHEN pet > 10 AND pef > 10 THEN pef / pet END"
SELL_SCORE = (f"(({sql_interp('upside', *S['upside'])} + {sql_interp('buy_pct', *S['buy_pct'])}) / 2 * 0.2::double + (coalesce({sql_interp('w52', *S['w52'])}, 0) * 0.6::double + coalesce({sql_interp('ratio', *S['pe_ratio'])}, 0) * 0.4::double) * 0.1::double"
              f" + (CASE WHEN pet < 0 THEN 85 WHEN pet IS NOT NULL THEN {sql_interp('pet', *S['pet'])} WHEN pef < 0 THEN 70 ELSE 0 END) * 0.25::double"
              f" + (coalesce({sql_interp('roe', *S['roe'])}, 0) + coalesce({sql_interp('de', *S['de'])}, 0)) / 2 * 0.25::double + coalesce({sql_interp('am', *S['am'])}, 0) * 0.15::double)")
BUY_SCORE = (f"({sql_interp('upside', *B['upside'])} * 0.1::double + greatest(0, least(100, coalesce({sql_interp('w52', *B['w52'])}, 25) * 2 + CASE WHEN dma200_pct < 100 THEN {sql_interp('dma200_pct', *B['dma'])} ELSE 0 END)) * 0.15::double"
             f" + greatest(0, least(100, CASE WHEN pet > 0 THEN {sql_interp('pet', *B['pet'])} WHEN pet < 0 THEN 10 ELSE 40 END + coalesce({sql_interp('ratio', *B['pe_ratio'])}, 0) + coalesce({sql_interp('fcf', *B['fcf'])}, 0))) * 0.3::double"
             f" + greatest(0, least(100, coalesce({sql_interp('roe', *B['roe'])}, 40) + coalesce({sql_interp('de', *B['de'])}, 0) + coalesce({sql_interp('gross_margin', *B['margin'])}, 0))) * 0.25::double + coalesce({sql_interp('am', *B['am'])}, 50) * 0.2::double)"
             " * CASE WHEN dispersion > 80 THEN 0.85::double ELSE 1 END * CASE WHEN (w52 IS NULL)::int + (pet IS NULL)::int + (pef IS NULL)::int + (roe IS NULL)::int + (de IS NULL)::int + (fcf IS NULL)::int > 2 THEN 0.8::double ELSE 1 END")
# Fixed values of the check, its own copy: one row per region and tier.
GATE_ROWS = """
  ('us', 'mega', 10, 100, 80, 8, 5, 1, 0.2, 3, 0.5, 60, 0.5, 90, 3.5, 2, 8, 300, 45, 0, -5, -5, 150, 65, -5, 35, 85, 20, 1.5, 0, 50, 3.5, 4, 5, 250, 50, -20, 2.0),
  ('us', 'large', 20, 100, 70, 8, 5, 1, 0.2, 2.5, 0.5, 55, 0.5, 85, 3.5, 3.5, 14, 175, 60, 0, -5, -3, 130, 65, -3, 38, 85, 18, 1.5, -3.5, 55, 3, 4.25, 5, 250, 50, -20, 2.0),
  ('us', 'mid', 18, 100, 75, 8, NULL, 0, 0.2, 2.5, 0.5, 50, 0.5, 80, 3.5, 2.5, 10, 130, 75, 1, -5, 0, 120, 60, -3, 40, 88, 22, 1.4, 7.5, 60, 3, 4.5, 5, 250, 45, -18, 1.8),
  ('us', 'small', 25, 100, 68, 6, NULL, 0, 0.2, 2.5, 0.5, 45, 0.5, 75, 3.5, 2.75, 10, 120, 75, 1, -5, -1, 100, 55, 0, 45, 90, 25, 1.3, 10, 65, 3, 4.75, 5, 250, 40, -15, 1.6),
  ('us', 'micro', 40, 100, 72, 6, NULL, 0, 0.2, 2.5, 0.5, 40, 0.5, 70, 3.5, 3, 10, 100, 80, 1, -3, NULL, 80, 50, 0, 50, 92, 30, 1.2, 12.5, 70, 3, 5, 5, 250, 35, -12, 1.5),
  ('eu', 'mega', 10, 100, 58, 6, 4, 1, 0.2, 2.5, 0.5, 60, 0.5, 90, 3.5, 2, 8, 200, 45, 0, -5, -5, 150, 65, -5, 35, 82, 18, 1.5, 5, 50, 2.5, 4, 5, 250, 50, -20, 2.0),
  ('eu', 'large', 12, 100, 60, 6, 4, 1, 0.2, 2.5, 0.5, 55, 0.5, 85, 3.5, 3.5, 8, 175, 50, 0, -5, -3, 130, 62, -3, 38, 83, 18, 1.5, -9, 55, 3, 4.25, 5, 250, 50, -20, 2.0),
  ('eu', 'mid', 18, 100, 63, 8, NULL, 0, 0.2, 2, 0.5, 50, 0.5, 80, 3.5, 2.5, 8, 150, 75, 1, -5, 0, 120, 58, -3, 42, 85, 20, 1.4, -6.9, 60, 2.5, 4.5, 5, 250, 45, -18, 1.8),
  ('eu', 'small', 28, 100, 65, 6, NULL, 0, 0.2, 2, 0.5, 45, 0.5, 75, 3.5, 2.75, 8, 150, 75, 1, -5, -1, 100, 55, 0, 45, 88, 23, 1.3, 12.5, 65, 2.5, 4.75, 5, 250, 40, -15, 1.6),
  ('eu', 'micro', 38, 100, 68, 6, NULL, 0, 0.2, 2, 0.5, 40, 0.5, 70, 3.5, 3, 10, 120, 80, 1, -3, NULL, 80, 50, 0, 50, 90, 28, 1.2, 15, 70, 2.5, 5, 5, 250, 35, -12, 1.5),
  ('hk', 'mega', 15, 100, 65, 15, NULL, 0, 0.2, 2.5, 0.5, 60, 0.5, 90, 3.5, 2, 10, 120, 70, 0, -5, 0.75, 150, 68, -5, 38, 88, 22, 1.5, 7.5, 55, 3, 4, 5, 250, 45, -25, 2.2),
  ('hk', 'large', 18, 100, 68, 12, NULL, 0, 0.2, 2, 0.5, 55, 0.5, 85, 3.5, 2.25, 10, 120, 75, 0, -5, 0.5, 130, 65, -3, 40, 88, 23, 1.5, 10, 60, 2.5, 4.25, 5, 250, 45, -25, 2.2),
  ('hk', 'mid', 22, 100, 70, 10, NULL, 0, 0.2, 2, 0.5, 50, 0.5, 80, 3.5, 2.5, 10, 120, 80, 1, -5, 0.25, 120, 62, -3, 42, 90, 25, 1.5, 12.5, 65, 2.5, 4.5, 5, 250, 40, -20, 2.0),
  ('hk', 'small', 30, 100, 72, 8, NULL, 0, 0.2, 2, 0.5, 45, 0.5, 75, 3.5, 2.75, 12, 100, 80, 1, -5, 0, 100, 58, 0, 48, 92, 28, 1.4, 15, 70, 2.5, 4.75, 5, 250, 35, -18, 1.8),
  ('hk', 'micro', 50, 100, 75, 8, NULL, 0, 0.2, 2, 0.5, 40, 0.5, 70, 3.5, 3, 12, 80, 85, 1, -3, NULL, 80, 55, 0, 52, 95, 32, 1.3, 17.5, 75, 2.5, 5, 5, 250, 30, -15, 1.6)"""
GATE_NAMES = """gate_region, tier, t_min_upside, t_max_upside_buy, t_min_buy_percentage, t_min_analysts, t_min_analysts_earnings, t_quality_relief, t_min_beta, t_max_beta, t_min_forward_pe, t_max_forward_pe,
  t_min_trailing_pe, t_max_trailing_pe, t_max_peg, t_max_short_interest, t_min_roe, t_max_debt_equity, t_min_pct_from_52w_high, t_require_above_200dma, t_min_analyst_momentum, t_min_fcf_yield,
  t_max_target_dispersion, t_score_threshold, t_hard_upside, t_hard_buy_pct, t_quality_buy_pct, t_quality_upside, t_max_pe_vs_sector, t_sell_upside, t_sell_buy_percentage, t_sell_beta,
  t_sell_short_interest, t_sell_roe, t_sell_debt_equity, t_sell_pct_from_52w_high, t_sell_analyst_momentum, t_sell_pe_vs_sector"""


TYPED_SQL = f"""
th AS (SELECT gate_region, tier, COLUMNS('^t_')::DOUBLE FROM (VALUES {GATE_ROWS}) t({GATE_NAMES})),
ty AS (SELECT *, {RATIO} AS ratio, CASE WHEN ticker LIKE '%-USD' THEN 'crypto' WHEN k % 41 = 0 THEN 'etf' WHEN k % 43 = 5 THEN 'bitcoin_proxy' ELSE 'stock' END AS asset_type,
  CASE WHEN cap_value >= 500e9 THEN 'mega' WHEN cap_value >= 100e9 THEN 'large' WHEN cap_value >= 10e9 THEN 'mid' WHEN cap_value >= 2e9 THEN 'small' ELSE 'micro' END AS tier,
  CASE WHEN ticker LIKE '%.HK' THEN 'hk' WHEN ticker LIKE '%.L' OR ticker LIKE '%.DE' OR ticker LIKE '%.PA' OR ticker LIKE '%.ST' OR ticker LIKE '%.CO' THEN 'eu' ELSE 'us' END AS gate_region FROM universe),
cl AS (SELECT *, CASE WHEN k % 97 = 5 THEN ['FINANCIAL', 'REIT', 'MLP', 'PHARMA_HIGH_LEVERAGE', 'EQUIPMENT_FINANCING', 'UTILITY', 'PAYMENT_PROCESSORS', 'TELECOM', 'TECHNOLOGY_HARDWARE'][k % 9 + 1]
   WHEN industry = 'Semiconductors' THEN 'TECHNOLOGY_HARDWARE' WHEN industry = 'Biotechnology' THEN 'PHARMA_HIGH_LEVERAGE'
   WHEN sector = 'Financial Services' THEN 'FINANCIAL' WHEN sector = 'Real Estate' THEN 'REIT' WHEN sector = 'Utilities' THEN 'UTILITY' END AS sector_class,
  CASE WHEN pef > 0 THEN round(pef / CASE sector WHEN 'Technology' THEN 28.0::double WHEN 'Healthcare' THEN 22 WHEN 'Financial Services' THEN 12 WHEN 'Consumer Cyclical' THEN 20 WHEN 'Consumer Defensive' THEN 22
   WHEN 'Energy' THEN 12 WHEN 'Industrials' THEN 18 WHEN 'Basic Materials' THEN 14 WHEN 'Real Estate' THEN 35 WHEN 'Utilities' THEN 18 WHEN 'Communication Services' THEN 18 ELSE 20 END, 2) END AS pe_vs_sector FROM ty),
gt AS (SELECT cl.*, th.* EXCLUDE (gate_region, tier) REPLACE (
  CASE sector_class WHEN 'FINANCIAL' THEN 6 WHEN 'REIT' THEN NULL WHEN 'MLP' THEN 15 WHEN 'PHARMA_HIGH_LEVERAGE' THEN 20 WHEN 'EQUIPMENT_FINANCING' THEN 12 WHEN 'UTILITY' THEN 8 WHEN 'PAYMENT_PROCESSORS' THEN 30 WHEN 'TELECOM' THEN 10 ELSE t_min_roe END AS t_min_roe,
  CASE sector_class WHEN 'FINANCIAL' THEN 3 WHEN 'REIT' THEN NULL WHEN 'MLP' THEN 8 WHEN 'PHARMA_HIGH_LEVERAGE' THEN 12 WHEN 'EQUIPMENT_FINANCING' THEN 8 WHEN 'UTILITY' THEN 5 WHEN 'PAYMENT_PROCESSORS' THEN 20 WHEN 'TELECOM' THEN 5 ELSE t_sell_roe END AS t_sell_roe,
  CASE sector_class WHEN 'FINANCIAL' THEN 500 WHEN 'REIT' THEN 300 WHEN 'MLP' THEN 800 WHEN 'PHARMA_HIGH_LEVERAGE' THEN 300 WHEN 'EQUIPMENT_FINANCING' THEN 300 WHEN 'UTILITY' THEN 250 WHEN 'PAYMENT_PROCESSORS' THEN 250 WHEN 'TELECOM' THEN 220 ELSE t_max_debt_equity END AS t_max_debt_equity,
  CASE sector_class WHEN 'FINANCIAL' THEN 800 WHEN 'REIT' THEN 400 WHEN 'MLP' THEN 1000 WHEN 'PHARMA_HIGH_LEVERAGE' THEN 400 WHEN 'EQUIPMENT_FINANCING' THEN 400 WHEN 'UTILITY' THEN 350 WHEN 'PAYMENT_PROCESSORS' THEN 400 WHEN 'TELECOM' THEN 350 ELSE t_sell_debt_equity END AS t_sell_debt_equity,
  CASE sector_class WHEN 'REIT' THEN NULL WHEN 'UTILITY' THEN -10 WHEN 'TELECOM' THEN -5 WHEN 'TECHNOLOGY_HARDWARE' THEN -15 ELSE t_min_fcf_yield END AS t_min_fcf_yield,
  CASE sector_class WHEN 'TELECOM' THEN 4 ELSE t_max_short_interest END AS t_max_short_interest, CASE sector_class WHEN 'PAYMENT_PROCESSORS' THEN 1.8 ELSE t_max_pe_vs_sector END AS t_max_pe_vs_sector)
  FROM cl JOIN th USING (gate_region, tier))"""
CASCADE_SQL = TYPED_SQL + f""",
sc AS (SELECT *, {SELL_SCORE} AS sell_score, {BUY_SCORE} AS buy_score, CASE WHEN held THEN 0.85::double ELSE 1 END AS rx FROM gt),
g AS (SELECT *,
 ((upside >= 0 AND upside >= t_min_upside * rx) OR (upside < t_min_upside * rx AND upside BETWEEN -30 AND 0 AND coalesce(w52 >= 70, false) AND coalesce(above200, false) AND buy_pct >= 80 AND coalesce(am >= -2, true)))
 AND upside <= t_max_upside_buy AND buy_pct >= least(t_min_buy_percentage, 95)
 AND analysts >= CASE WHEN t_quality_relief = 1 AND am >= 0 THEN greatest(4, CASE WHEN rating_type = 'E' AND t_min_analysts_earnings IS NOT NULL THEN greatest(4, t_min_analysts_earnings) ELSE greatest(4, t_min_analysts) END - 1)
   ELSE CASE WHEN rating_type = 'E' AND t_min_analysts_earnings IS NOT NULL THEN greatest(4, t_min_analysts_earnings) ELSE greatest(4, t_min_analysts) END END
 AND coalesce(beta BETWEEN t_min_beta AND t_max_beta, true) AND coalesce(pef > t_min_forward_pe AND pef <= t_max_forward_pe, true)
 AND (coalesce(pef > 0 AND pet / pef > 10, false) OR coalesce(pet > t_min_trailing_pe AND pet <= t_max_trailing_pe, true)) AND (coalesce(pef > 0 AND pet / pef > 10, false) OR ratio IS NULL OR pef <= pet * 1.25::double)
 AND coalesce(peg <= t_max_peg, true) AND coalesce(si <= t_max_short_interest, true) AND coalesce(roe >= t_min_roe, true) AND coalesce(de <= t_max_debt_equity, true) AND coalesce(pe_vs_sector <= t_max_pe_vs_sector, true) AND coalesce(w52 >= t_min_pct_from_52w_high * rx, true)
 AND (t_require_above_200dma = 0 OR coalesce(above200, true)) AND coalesce(am >= t_min_analyst_momentum, true) AND coalesce(fcf < -100 OR fcf >= t_min_fcf_yield, true) AND coalesce(dispersion <= t_max_target_dispersion, true) AS val,
 coalesce(w52 >= 80 AND above200 AND buy_pct >= 75 AND coalesce(am >= 0, true) AND cap_value >= 10e9 AND coalesce(pef <= 80, true), false) AS mom,
 cap_value >= 2e9 AND analysts >= CASE WHEN cap_value < 5e9 THEN 6 ELSE 4 END AND targets >= 4 AS conf,
 NOT ((buy_pct >= t_quality_buy_pct AND upside >= t_quality_upside AND coalesce(roe > 0, true) AND coalesce(de < 200, true) AND NOT coalesce(am <= -5, false)) OR (coalesce(am <= -5, false) AND buy_pct >= t_quality_buy_pct)) AS selling,
 (upside <= t_hard_upside AND buy_pct <= 55) OR buy_pct <= t_hard_buy_pct OR (upside <= -10 AND buy_pct < 65) AS hard, (upside < 0 AND buy_pct < 70) OR buy_pct < 50 AS soft,
 sell_score * CASE WHEN dispersion > 80 THEN 0.9::double ELSE 1 END AS adj FROM sc),
cas AS (SELECT *, CASE WHEN asset_type = 'bitcoin_proxy' AND NOT coalesce(beta > 4, false) AND NOT coalesce(si > 10, false) AND w52 IS NOT NULL THEN
   CASE WHEN w52 >= 50 AND buy_pct >= 60 AND upside >= 0 THEN CASE WHEN w52 >= 70 AND coalesce(above200, false) THEN 'B' ELSE 'H' END WHEN w52 <= 35 THEN 'S' ELSE 'H' END
  WHEN asset_type = 'etf' THEN 'I' WHEN asset_type = 'crypto' THEN CASE WHEN w52 IS NULL THEN 'I' WHEN w52 >= 85 THEN CASE WHEN coalesce(above200, false) THEN 'B' ELSE 'H' END WHEN w52 <= 55 THEN 'S' ELSE 'H' END
  WHEN NOT conf THEN 'I' WHEN days_to_earnings BETWEEN 0 AND 7 THEN 'H' WHEN w52 < 20 THEN 'S' WHEN abs(upside) <= 3 AND buy_pct >= 80 THEN 'H' WHEN selling AND NOT hard AND soft THEN 'S'
  WHEN selling AND adj >= t_score_threshold * CASE WHEN held THEN 1.1::double ELSE 1 END THEN 'S' WHEN val OR mom THEN 'B' WHEN selling AND hard THEN 'S' ELSE 'H' END AS signal,
  CASE WHEN val AND mom THEN 'value+momentum' WHEN mom THEN 'momentum' ELSE 'value' END AS track FROM g)
"""


def class_members(universe):
    """Published members of the sector classes, and a ticker list that grows with the universe (a stand-in by key)."""
    u = universe.where("k % 97 = 5")
    own = F.element_at(F.array(*map(F.lit, sr.CLASS_GATES)), (F.col("k") % 9 + 1).cast("int"))
    return sr.members(u.sparkSession).unionByName(u.select(F.lit("ticker").alias("scope"), F.col("ticker").alias("key"), own.alias("sector_class")))


def classified(spark, sf):
    return ca.classify(typed(spark, sf), ca.threshold_table(spark), members=class_members(lens.universe(spark, sf)))


CLASS_GATE_NAMES = ("min_roe", "sell_roe", "max_debt_equity", "sell_debt_equity", "min_fcf_yield", "max_short_interest", "max_pe_vs_sector")


@query("p10_sector_class_gates", ctes=U, sql=TYPED_SQL + " SELECT ticker, sector_class, pe_vs_sector, " + ", ".join(f"t_{g} AS {g}" for g in CLASS_GATE_NAMES) + " FROM gt")
def p10(spark, sf):
    """Class by ticker, industry or sector, and the gates that may differ by class."""
    d = ca.with_gates(lens.universe(spark, sf), ca.threshold_table(spark), class_members(lens.universe(spark, sf)))
    return d.select("ticker", "sector_class", "pe_vs_sector", *[F.col(f"t_{g}").alias(g) for g in CLASS_GATE_NAMES])


@query("f04_regional_sell_triggers", ctes=U, sql=TYPED_SQL + """
SELECT ticker, concat_ws(',', CASE WHEN upside <= t_sell_upside THEN 'max_upside' END, CASE WHEN buy_pct <= t_sell_buy_percentage THEN 'min_buy_percentage' END, CASE WHEN si > t_sell_short_interest THEN 'min_short_interest' END,
 CASE WHEN beta > t_sell_beta THEN 'min_beta' END, CASE WHEN roe < t_sell_roe THEN 'min_roe' END, CASE WHEN de > t_sell_debt_equity THEN 'max_debt_equity' END, CASE WHEN w52 < t_sell_pct_from_52w_high THEN 'max_pct_from_52w_high' END,
 CASE WHEN am < t_sell_analyst_momentum THEN 'max_analyst_momentum' END, CASE WHEN pe_vs_sector > t_sell_pe_vs_sector THEN 'max_pe_vs_sector' END) AS triggers FROM gt""")
def f04_regional(spark, sf):
    """The any-trigger rule with the gates of region, tier and sector class."""
    d = ca.with_gates(lens.universe(spark, sf), ca.threshold_table(spark), class_members(lens.universe(spark, sf)))
    return d.select("ticker", F.concat_ws(",", ca.sell_triggers()).alias("triggers"))


@query("f01_signal_cascade", ctes=U, sql=CASCADE_SQL + """
SELECT ticker, tier, asset_type, signal, track, round(CASE signal WHEN 'B' THEN buy_score WHEN 'S' THEN adj END, 9) AS score,
 CASE WHEN track = 'value' THEN 90 WHEN track = 'value+momentum' THEN 45 WHEN w52 >= 90 THEN 7 ELSE 30 END AS horizon FROM cas""")
def f01(spark, sf):
    d = classified(spark, sf)
    return d.select("ticker", "tier", "asset_type", "signal", "track", F.round("score", 9).alias("score"), ca.horizon_days(F.col("track"), F.col("w52")).alias("horizon"))


@query("p18_p19_scores", ctes=U, sql=CASCADE_SQL + " SELECT ticker, round(sell_score, 9) AS sell_score, round(buy_score, 9) AS buy_score FROM cas")
def scores(spark, sf):
    return ca.with_buy_score(ca.with_sell_score(typed(spark, sf))).select("ticker", F.round("sell_score", 9).alias("sell_score"), F.round("buy_score", 9).alias("buy_score"))


@query("p18_sell_factors", ctes=U, sql="""
SELECT ticker, concat_ws(',', CASE WHEN upside <= -5 THEN 'severe_negative_upside' END, CASE WHEN upside > -5 AND upside <= 0 THEN 'negative_upside' END, CASE WHEN buy_pct < 40 THEN 'low_buy_pct' END,
 CASE WHEN pet > 10 AND pef > 10 AND pef / pet > 1.25 THEN 'earnings_deterioration' END, CASE WHEN w52 < 50 THEN '52w_decline' END, CASE WHEN pet < 0 THEN 'trailing_losses' END, CASE WHEN pet > 60 THEN 'high_trailing_pe' END,
 CASE WHEN pet IS NULL AND pef < 0 THEN 'negative_forward_earnings' END, CASE WHEN roe < 5 THEN 'low_roe' END, CASE WHEN de > 200 THEN 'high_leverage' END, CASE WHEN am <= -5 THEN 'am_decline' END) AS factors FROM universe""")
def sell_factor_list(spark, sf):
    return typed(spark, sf).select("ticker", F.concat_ws(",", ca.sell_factors()).alias("factors"))


@query("f02_confidence_gate", ctes=U, sql="SELECT ticker FROM universe WHERE cap_value >= 2e9 AND targets >= 4 AND analysts >= CASE WHEN cap_value < 5e9 THEN 6 ELSE 4 END")
def f02(spark, sf):
    return lens.universe(spark, sf).where(ca.confident()).select("ticker")


@query("f03_momentum_track", ctes=U, sql="SELECT ticker FROM universe WHERE w52 >= 80 AND above200 AND buy_pct >= 75 AND coalesce(am >= 0, true) AND cap_value >= 10e9 AND coalesce(pef <= 80, true)")
def f03(spark, sf):
    return lens.universe(spark, sf).where(ca.momentum_track()).select("ticker")


@query("f04_any_trigger_sell", ctes=U, sql="""
SELECT ticker, concat_ws(',', CASE WHEN upside <= 5 THEN 'upside' END, CASE WHEN buy_pct <= 55 THEN 'buy_pct' END, CASE WHEN pef > 75 THEN 'pef' END, CASE WHEN pet > 90 THEN 'pet' END, CASE WHEN peg > 5.5 THEN 'peg' END, CASE WHEN si > 4.25 THEN 'si' END,
 CASE WHEN beta > 3 THEN 'beta' END, CASE WHEN roe < 5 THEN 'roe' END, CASE WHEN de > 250 THEN 'de' END, CASE WHEN w52 < 50 THEN 'w52' END, CASE WHEN am < -20 THEN 'am' END) AS triggers FROM universe""")
def f04(spark, sf):
    t = [("upside", "upside <= 5"), ("buy_pct", "buy_pct <= 55"), ("pef", "pef > 75"), ("pet", "pet > 90"), ("peg", "peg > 5.5"), ("si", "si > 4.25"), ("beta", "beta > 3"), ("roe", "roe < 5"), ("de", "de > 250"), ("w52", "w52 < 50"), ("am", "am < -20")]
    arr = F.filter(F.array(*[F.when(F.expr(e), n) for n, e in t]), lambda x: x.isNotNull())
    return lens.universe(spark, sf).select("ticker", F.concat_ws(",", arr).alias("triggers"))


@query("f10_universe_quality_gates", ctes=U, sql="""
SELECT ticker, concat_ws(',', CASE WHEN cap_value < 2e9 THEN 'min_cap' END, CASE WHEN analysts IS NULL OR analysts < 5 THEN 'min_analysts' END,
 CASE WHEN (pet IS NULL AND pef IS NULL AND fcf IS NULL) OR (coalesce(pet <= 0, true) AND coalesce(pef <= 0, true) AND coalesce(fcf <= 0, true)) THEN 'positive_earnings' END, CASE WHEN w52 >= 0 AND w52 <= 100 AND w52 < 50 THEN 'trend' END) AS reasons
FROM universe WHERE ticker NOT LIKE '%-USD' AND price > 0""")
def f10(spark, sf):
    c = F.col
    non_pos = lambda x: F.coalesce(c(x) <= 0, F.lit(True))
    gates = [("min_cap", c("cap_value") < 2e9), ("min_analysts", F.coalesce(c("analysts") < 5, F.lit(True))), ("positive_earnings", non_pos("pet") & non_pos("pef") & non_pos("fcf")), ("trend", c("w52").between(0, 100) & (c("w52") < 50))]
    arr = F.filter(F.array(*[F.when(t, n) for n, t in gates]), lambda x: x.isNotNull())
    return lens.universe(spark, sf).where(~c("ticker").endswith("-USD") & (c("price") > 0)).select("ticker", F.concat_ws(",", arr).alias("reasons"))


@query("f09_a47_asset_routing", ctes=U, sql=TYPED_SQL + """
SELECT asset_type, CASE WHEN price IS NULL OR price <= 0 THEN 'excluded' WHEN asset_type = 'crypto' THEN 'price_only' WHEN pet IS NULL AND pef IS NULL AND roe IS NULL THEN 'price_only' ELSE 'fundamental' END AS route, count(*) AS n FROM ty GROUP BY 1, 2""")
def f09(spark, sf):
    r = F.when(F.col("price").isNull() | (F.col("price") <= 0), "excluded").when(F.col("asset_type") == "crypto", "price_only").when(F.coalesce("pet", "pef", "roe").isNull(), "price_only").otherwise("fundamental")
    return typed(spark, sf).groupBy("asset_type", r.alias("route")).agg(F.count("*").alias("n"))


@query("f12_f14_criteria_filters", ctes=U, sql="SELECT ticker FROM universe WHERE (upside >= 10 OR upside IS NULL) AND (roe >= 5 OR roe IS NULL) AND (pef <= 50 OR pef IS NULL) AND (beta BETWEEN 0.5 AND 3 OR beta IS NULL) AND sector IN ('Technology','Energy')")
def f12(spark, sf):
    return parse.apply_criteria(lens.universe(spark, sf), {"upside": {"min": 10}, "roe": {"min": 5}, "pef": {"max": 50}, "beta": {"min": 0.5, "max": 3}, "sector": {"in": ["Technology", "Energy"]}}).select("ticker")


@query("f13_data_quality", ctes=U, sql="""
SELECT ticker, round(((pef IS NOT NULL)::int + (pet IS NOT NULL)::int + (w52 IS NOT NULL)::int + (am IS NOT NULL)::int + (beta IS NOT NULL)::int + (roe IS NOT NULL)::int + (de IS NOT NULL)::int + (fcf IS NOT NULL)::int) / 8.0, 6) AS completeness FROM universe
WHERE price > 0 AND upside BETWEEN -100 AND 500 AND completeness >= 0.75""")
def f13(spark, sf):
    cs = ["pef", "pet", "w52", "am", "beta", "roe", "de", "fcf"]
    comp = sum((F.col(c).isNotNull().cast("int") for c in cs), F.lit(0)) / len(cs)
    return lens.universe(spark, sf).where((F.col("price") > 0) & F.col("upside").between(-100, 500)).select("ticker", r6(comp, "completeness")).where("completeness >= 0.75")


@query("f15_selection_lists", ctes=U, sql=CASCADE_SQL + " SELECT ticker, signal, round(buy_score, 9) AS buy_score FROM cas WHERE (signal = 'B' AND upside >= 0) OR signal IN ('S', 'H')")
def f15(spark, sf):
    return classified(spark, sf).where(((F.col("signal") == "B") & (F.col("upside") >= 0)) | F.col("signal").isin("S", "H")).select("ticker", "signal", F.round("buy_score", 9).alias("buy_score"))


@query("f16_liquidity_flag", ctes=("prices", "dims"), sql="""
SELECT ticker, tier, round(avg(close * volume), 2) AS adv, coalesce(avg(close * volume) >= CASE tier WHEN 'mega' THEN 50000 WHEN 'large' THEN 20000 WHEN 'mid' THEN 10000 WHEN 'small' THEN 5000 ELSE 2000 END, true) AS passes,
 CASE tier WHEN 'mega' THEN 2.0 WHEN 'large' THEN 5.0 WHEN 'mid' THEN 10.0 WHEN 'small' THEN 20.0 ELSE 40.0 END::double AS spread_bps FROM prices JOIN dims USING (ticker) GROUP BY 1, 2""")
def f16(spark, sf):
    """Tier minimums are scaled to the stand-in volumes (thousands)."""
    mins = {"mega": 50000.0, "large": 20000.0, "mid": 10000.0, "small": 5000.0, "micro": 2000.0}
    bps = {"mega": 2.0, "large": 5.0, "mid": 10.0, "small": 20.0, "micro": 40.0}
    g = lens.prices(spark, sf).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("adv")).join(lens.dims(spark, sf), "ticker")
    t = F.col("tier")
    return g.select("ticker", "tier", F.round("adv", 2).alias("adv"), F.coalesce(F.col("adv") >= oc.lookup(t, mins), F.lit(True)).alias("passes"), oc.lookup(t, bps).alias("spread_bps"))


@query("f05_g14_g15_simple_category", ctes=U, sql="""
c AS (SELECT ticker, sector, CASE WHEN analysts < 5 OR targets < 4 THEN 'INCONCLUSIVE' WHEN upside < 5 OR buy_pct < 60 OR pef > 60 OR si > 4 OR beta > 3 THEN 'SELL'
  WHEN upside >= 20 AND buy_pct >= 75 AND coalesce(beta BETWEEN 0.25 AND 2.5, true) AND coalesce(pef BETWEEN 0.5 AND 45, true) THEN 'BUY' ELSE 'HOLD' END AS category FROM universe)
SELECT category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM c GROUP BY 1""")
def g15(spark, sf):
    c = F.col
    g0 = F.coalesce
    sell = g0(c("upside") < 5, F.lit(False)) | g0(c("buy_pct") < 60, F.lit(False)) | g0(c("pef") > 60, F.lit(False)) | g0(c("si") > 4, F.lit(False)) | g0(c("beta") > 3, F.lit(False))
    buy = (c("upside") >= 20) & (c("buy_pct") >= 75) & g0(c("beta").between(0.25, 2.5), F.lit(True)) & g0(c("pef").between(0.5, 45), F.lit(True))
    cat = F.when((c("analysts") < 5) | (c("targets") < 4), "INCONCLUSIVE").when(sell, "SELL").when(buy, "BUY").otherwise("HOLD")
    g = lens.universe(spark, sf).groupBy(cat.alias("category")).agg(F.count("*").alias("n"))
    return g.select("category", "n", r6(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), "pct"))  # four rows


@query("p01_p03_parse", ctes=U, sql="""
SELECT ticker, coalesce(try_cast(rtrim(trim(upside_str), '%') AS double), 0) AS upside_zero, CASE WHEN isnan(try_cast(rtrim(trim(roe_str), '%') AS double)) THEN NULL ELSE try_cast(rtrim(trim(roe_str), '%') AS double) END AS roe_null, cap_value AS cap_parsed FROM universe""")
def p01(spark, sf):
    return lens.universe(spark, sf).select("ticker", parse.percent("upside_str", zero=True).alias("upside_zero"), parse.percent("roe_str").alias("roe_null"), parse.market_cap("cap").alias("cap_parsed"))


@query("j17_threshold_lookup", ctes=U, sql=TYPED_SQL + """
SELECT ticker, gate_region, tier, t_min_upside AS min_upside, t_min_buy_percentage AS min_buy_percentage, t_min_analysts AS min_analysts, t_max_beta AS max_beta, t_min_fcf_yield AS min_fcf_yield, t_score_threshold AS score_threshold
FROM ty JOIN th USING (gate_region, tier)""")
def j17(spark, sf):
    """Every listing with the gates of its region and size (a literal table of fifteen rows is broadcast)."""
    u = lens.universe(spark, sf).select("ticker", ca.gate_region(F.col("ticker")).alias("gate_region"), ca.tier_of(F.col("cap_value")).alias("tier"))
    gates = ["min_upside", "min_buy_percentage", "min_analysts", "max_beta", "min_fcf_yield", "score_threshold"]
    return u.join(F.broadcast(ca.threshold_table(spark)), ["gate_region", "tier"]).select("ticker", "gate_region", "tier", *[F.col(f"t_{g}").alias(g) for g in gates])


@query("p04_p08_projections", ctes=U, sql="""
SELECT ticker, round(upside * buy_pct / 100, 6) AS exret, CASE WHEN cap_value >= 500e9 THEN 'mega' WHEN cap_value >= 100e9 THEN 'large' WHEN cap_value >= 10e9 THEN 'mid' WHEN cap_value >= 2e9 THEN 'small' ELSE 'micro' END AS tier,
 CASE WHEN ticker LIKE '%.L' THEN 'uk' WHEN ticker LIKE '%.HK' THEN 'hk' WHEN ticker LIKE '%.DE' OR ticker LIKE '%.PA' OR ticker LIKE '%.ST' OR ticker LIKE '%.CO' THEN 'eu' ELSE 'us' END AS region,
 CASE WHEN ticker LIKE '%.L' THEN 'GBP' WHEN ticker LIKE '%.HK' THEN 'HKD' WHEN ticker LIKE '%.DE' OR ticker LIKE '%.PA' THEN 'EUR' WHEN ticker LIKE '%.ST' THEN 'SEK' WHEN ticker LIKE '%.CO' THEN 'DKK' WHEN ticker LIKE '%.T' THEN 'JPY' ELSE 'USD' END AS currency FROM universe""")
def p04(spark, sf):
    c = F.col
    return lens.universe(spark, sf).select("ticker", r6(c("upside") * c("buy_pct") / 100, "exret"), ca.tier_of(c("cap_value")).alias("tier"), parse.region(c("ticker")).alias("region"), parse.currency(c("ticker")).alias("currency"))


@query("k01_k02_k03_sorts", ctes=U, sql=CASCADE_SQL + """
SELECT * FROM (SELECT sector, ticker, row_number() OVER (PARTITION BY sector ORDER BY CASE asset_type WHEN 'stock' THEN 1 WHEN 'etf' THEN 2 WHEN 'crypto' THEN 3 ELSE 4 END, cap_value DESC, ticker) AS place FROM cas) WHERE place <= 10""")
def k02(spark, sf):
    """Top names per sector; the limit is pushed below the shuffle as a partial top-k."""
    pri = oc.lookup(F.col("asset_type"), {"stock": 1, "etf": 2, "crypto": 3}, 4)
    w = Window.partitionBy("sector").orderBy(pri, F.desc("cap_value"), "ticker")
    return typed(spark, sf).select("sector", "ticker", F.row_number().over(w).cast("long").alias("place")).where("place <= 10")


@query("a11_a14_concentration_and_beta", ctes=("portfolio",), sql="""
SELECT sector, count(*) AS n, round(sum(cap_value) / (SELECT sum(cap_value) FROM portfolio), 6) AS weight, sum(cap_value) / (SELECT sum(cap_value) FROM portfolio) > 0.25 AS warn,
 round(sum(CASE WHEN beta > 0 AND beta < 10 THEN beta * cap_value END) / sum(CASE WHEN beta > 0 AND beta < 10 THEN cap_value END), 6) AS beta FROM portfolio GROUP BY 1""")
def a11(spark, sf):
    ok = (F.col("beta") > 0) & (F.col("beta") < 10)
    g = lens.portfolio(spark, sf).groupBy("sector").agg(F.count("*").alias("n"), F.sum("cap_value").alias("c"), F.sum(F.when(ok, F.col("beta") * F.col("cap_value"))).alias("b"), F.sum(F.when(ok, F.col("cap_value"))).alias("bw"))
    w = F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(0)))  # one row per sector
    return g.select("sector", "n", r6(w, "weight"), (w > 0.25).alias("warn"), r6(F.try_divide("b", "bw"), "beta"))


@query("a12_a13_signal_concentration", ctes=U, sql=CASCADE_SQL + """,
s AS (SELECT sector, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM cas WHERE signal = 'B' GROUP BY 1)
SELECT sector, n, round(share, 6) AS share, share > 0.25 AS warn, round(100 * (1 - sum(share * share) OVER ()), 6) AS diversification FROM s""")
def a12(spark, sf):
    g = classified(spark, sf).where("signal = 'B'").groupBy("sector").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per sector
    g = g.withColumn("share", F.col("n") / F.sum("n").over(w))
    return g.select("sector", "n", r6("share"), (F.col("share") > 0.25).alias("warn"), r6(100 * (1 - F.sum(F.col("share") * F.col("share")).over(w)), "diversification"))


@query("a15_market_metrics", ctes=U, sql=CASCADE_SQL + """
SELECT sector, count(*) AS n, round(avg(upside), 6) AS avg_upside, round(median(upside), 6) AS median_upside, round(avg(pet), 6) AS avg_pet, round(median(pet), 6) AS median_pet,
 round(count(*) FILTER (signal = 'B') * 100.0 / count(*) - count(*) FILTER (signal = 'S') * 100.0 / count(*), 6) AS net_breadth FROM cas GROUP BY ROLLUP(sector)""")
def a15(spark, sf):
    d = classified(spark, sf).select("sector", "upside", "pet", "signal")
    g = d.rollup("sector").agg(F.count("*").alias("n"), F.avg("upside").alias("avg_upside"), F.avg("pet").alias("avg_pet"),
                               (oc.rate(F.col("signal") == "B") - oc.rate(F.col("signal") == "S")).alias("net_breadth"))
    x = d.select(F.explode(F.array(F.col("sector"), F.lit(None).cast("string"))).alias("sector"), "upside", "pet")
    m = _safe_join(medians(x, ["sector"], "upside", "median_upside").drop("n"), medians(x, ["sector"], "pet", "median_pet").drop("n"), ["sector"])
    return rnd(_safe_join(g, m, ["sector"]))


@query("a20_sector_medians", ctes=U, sql="SELECT sector, round(median(upside * buy_pct / 100), 6) AS median_exret FROM universe GROUP BY ROLLUP(sector)")
def a20(spark, sf):
    x = lens.universe(spark, sf).select(F.explode(F.array(F.col("sector"), F.lit(None).cast("string"))).alias("sector"), (F.col("upside") * F.col("buy_pct") / 100).alias("e"))
    return medians(x, ["sector"], "e", "m").select("sector", r6("m", "median_exret"))


METRIC = ["upside", "buy_pct", "pef", "peg", "si", "de", "roe", "fcf", "w52"]
LOWER = {"pef", "peg", "si", "de"}


@query("a21_metric_effectiveness", ctes=U, sql=CASCADE_SQL + ", m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, signal, {m} AS x, {str(m in LOWER).lower()} AS lower FROM cas" for m in METRIC) + """),
mg AS (SELECT metric, bool_or(lower) AS lower, median(x) FILTER (signal = 'B') AS b, median(x) FILTER (signal = 'S') AS s, median(x) FILTER (signal = 'H') AS h FROM m GROUP BY 1),
mr AS (SELECT *, CASE WHEN b IS NULL OR s IS NULL OR s = 0 THEN NULL WHEN lower THEN s / nullif(b, 0) ELSE b / s END AS ratio FROM mg)
SELECT metric, round(b, 6) AS buy_median, round(s, 6) AS sell_median, round(h, 6) AS hold_median, round(ratio, 6) AS ratio, CASE WHEN ratio IS NULL THEN 'none' WHEN ratio > 1.5 THEN 'EXCELLENT' WHEN ratio > 1.2 THEN 'GOOD' WHEN ratio > 0.95 THEN 'WEAK' ELSE 'NO_POWER' END AS verdict FROM mr""")
def a21(spark, sf):
    d = classified(spark, sf)
    long = d.select("signal", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRIC])).alias("e")).select("signal", "e.*")
    m = medians(long, ["metric", "signal"], "x", "m")
    g = m.groupBy("metric").agg(*[F.max(F.when(F.col("signal") == s, F.col("m"))).alias(n) for s, n in (("B", "b"), ("S", "s"), ("H", "h"))])
    ratio = F.when(F.col("b").isNull() | F.col("s").isNull() | (F.col("s") == 0), None).when(F.col("metric").isin(*LOWER), F.try_divide("s", "b")).otherwise(F.try_divide("b", "s"))
    r = F.col("ratio")
    return g.withColumn("ratio", ratio).select("metric", r6("b", "buy_median"), r6("s", "sell_median"), r6("h", "hold_median"), r6("ratio"),
                                               F.when(r.isNull(), "none").when(r > 1.5, "EXCELLENT").when(r > 1.2, "GOOD").when(r > 0.95, "WEAK").otherwise("NO_POWER").alias("verdict"))


@query("a22_data_quality_report", ctes=U, sql=CASCADE_SQL + """
SELECT tier, sector, count(*) AS total, count(*) FILTER (signal = 'I') AS inconclusive, round(count(*) FILTER (signal = 'I') * 100.0 / count(*), 6) AS rate, count(*) FILTER (signal = 'I' AND analysts < 4) AS low_analysts FROM cas GROUP BY GROUPING SETS ((), (tier), (sector))""")
def a22(spark, sf):
    t, s, i = F.col("tier"), F.col("sector"), F.col("signal") == "I"
    return rnd(classified(spark, sf).groupingSets([[], [t], [s]], t, s).agg(F.count("*").alias("total"), F.count(F.when(i, 1)).alias("inconclusive"), oc.rate(i).alias("rate"), F.count(F.when(i & (F.col("analysts") < 4), 1)).alias("low_analysts")))


@query("a23_distribution_summary", ctes=U, sql="""
SELECT count(upside) AS n, round(avg(upside), 6) AS mean, round(stddev_samp(upside), 6) AS std, round(quantile_cont(upside, 0.1), 6) AS p10, round(quantile_cont(upside, 0.25), 6) AS p25, round(median(upside), 6) AS p50, round(quantile_cont(upside, 0.75), 6) AS p75, round(quantile_cont(upside, 0.9), 6) AS p90, min(upside) AS mn, max(upside) AS mx FROM universe""")
def a23(spark, sf):
    u = lens.universe(spark, sf)
    p = percentiles(u, [], "upside", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}).drop("n")
    g = u.agg(F.count("upside").alias("n"), F.avg("upside").alias("mean"), F.stddev_samp("upside").alias("std"), F.min("upside").alias("mn"), F.max("upside").alias("mx"))
    return rnd(g.crossJoin(F.broadcast(p)))  # one row each


@query("a24_threshold_sensitivity", ctes=U, sql="""
g AS (SELECT t.t AS threshold, count(*) FILTER (upside >= t.t) AS passing, count(*) FILTER (upside < t.t) AS failing, count(*) AS n FROM universe, range(0, 45, 5) t(t) GROUP BY 1)
SELECT threshold, passing, failing, round(passing * 100.0 / n, 6) AS pass_rate, row_number() OVER (ORDER BY abs(passing * 100.0 / n - 10), threshold) = 1 AS recommended FROM g""")
def a24(spark, sf):
    """The grid becomes one conditional count per step, so rows are read once and not multiplied."""
    grid = list(range(0, 45, 5))
    g = lens.universe(spark, sf).agg(F.count("*").alias("n"), *[F.count(F.when(F.col("upside") >= t, 1)).alias(f"p{t}") for t in grid], *[F.count(F.when(F.col("upside") < t, 1)).alias(f"f{t}") for t in grid])
    e = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"p{t}").alias("passing"), F.col(f"f{t}").alias("failing"), (F.col(f"p{t}") * 100.0 / F.col("n")).alias("r")) for t in grid]))
    d = g.select(e.alias("e")).select("e.*")
    w = Window.partitionBy(F.lit(0)).orderBy(F.abs(F.col("r") - 10), "threshold")  # one row per step
    return d.select("threshold", "passing", "failing", r6("r", "pass_rate"), (F.row_number().over(w) == 1).alias("recommended"))
