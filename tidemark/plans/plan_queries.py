"""The end-to-end plan (C12, G28) and the upkeep of the action log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cascade as ca
from tidemark.operators import plan, regime
from tidemark.plans.outcome_queries import rnd
from tidemark.plans.timeseries_queries import CONF_SQL
from tidemark.plans.universe_queries import CASCADE_SQL, class_members, typed
from tidemark.registry import query
from tidemark.session import new_path
from tidemark.sources import lens
from tidemark.sources.keyed_log import KeyedLog


@query("c12_g28_end_to_end_plan", ctes=("universe", "market"), sql=CASCADE_SQL + f""",
ex AS (WITH {CONF_SQL.strip()} SELECT CASE confirmed WHEN 'risk_on' THEN 1.0 WHEN 'risk_off' THEN 0.65 WHEN 'crisis' THEN 0.4 ELSE 0.9 END::DOUBLE AS exposure FROM conf ORDER BY date DESC LIMIT 1),
jd AS (SELECT ticker, sector, signal, buy_score AS score, CASE WHEN k % 13 = 0 THEN (k * 17 % 23 + 1)::DOUBLE END AS raw, k % 37 = 0 AS excluded,
  price > 0 AND ticker NOT LIKE '%-USD' AND NOT (coalesce(cap_value < 2e9, false) OR coalesce(analysts < 5, true) OR (coalesce(pet <= 0, true) AND coalesce(pef <= 0, true) AND coalesce(fcf <= 0, true)) OR coalesce(w52 BETWEEN 0 AND 100 AND w52 < 50, false)) AS good FROM cas),
own AS (SELECT ticker, sector, signal, score, raw / sum(raw) OVER () AS cur FROM jd WHERE raw IS NOT NULL),
fresh AS (SELECT ticker, sector, signal, score, 0::DOUBLE AS cur FROM jd WHERE raw IS NULL AND signal = 'B' AND good AND NOT excluded ORDER BY score DESC, ticker LIMIT 200),
x AS (SELECT *, CASE WHEN signal = 'B' AND cur = 0 THEN 'BUY' WHEN signal = 'B' THEN 'ADD' WHEN signal = 'S' THEN 'SELL' ELSE 'HOLD' END AS action FROM (SELECT * FROM own UNION ALL SELECT * FROM fresh)),
bg AS (SELECT exposure, greatest(0, 1 - sum(CASE WHEN action IN ('ADD', 'HOLD') THEN cur ELSE 0 END) - 0.07::DOUBLE) * exposure AS budget FROM x, ex GROUP BY exposure),
f AS (SELECT x.*, bg.*, row_number() OVER (PARTITION BY action IN ('BUY', 'ADD') ORDER BY score DESC, ticker) AS rk FROM x, bg),
y AS (SELECT *, budget > 0 AND action IN ('BUY', 'ADD') AND rk <= greatest(1, floor(budget / 0.01::DOUBLE + 1e-9)) AS funded FROM f),
z AS (SELECT *, CASE WHEN funded THEN budget / sum(funded::INT) OVER () ELSE 0 END AS part FROM y),
t AS (SELECT *, CASE action WHEN 'BUY' THEN least(part, 0.08::DOUBLE) WHEN 'ADD' THEN cur + least(part, greatest(0, 0.08::DOUBLE - cur)) WHEN 'HOLD' THEN cur ELSE 0 END AS tgt FROM z),
s AS (SELECT *, sum(CASE WHEN action NOT IN ('BUY', 'ADD') THEN tgt ELSE 0 END) OVER (PARTITION BY sector) AS held_s, sum(CASE WHEN action = 'BUY' THEN tgt WHEN action = 'ADD' THEN tgt - cur ELSE 0 END) OVER (PARTITION BY sector) AS add_s FROM t),
o AS (SELECT *, CASE WHEN action IN ('BUY', 'ADD') AND held_s + add_s > 0.25::DOUBLE + 1e-12 AND add_s > 0 THEN CASE WHEN action = 'BUY' THEN tgt * greatest(0, 0.25::DOUBLE - held_s) / add_s ELSE cur + (tgt - cur) * greatest(0, 0.25::DOUBLE - held_s) / add_s END ELSE tgt END AS target FROM s)
SELECT ticker, action, round(cur, 6) AS current, round(target, 6) AS target, round(target - cur, 6) AS trade, exposure FROM o WHERE abs(target - cur) >= 0.001::DOUBLE""")
def c12(spark, sf):
    """From the universe to sized orders; positions and exclusions are stand-ins by key."""
    u = typed(spark, sf)
    held = F.when(F.col("k") % 13 == 0, F.col("k") * 17 % 23 + 1)
    labels = regime.regime_labels(regime.regime_inputs(lens.market(spark, sf)))
    # the classification reads no key, so the rules see the columns they need
    return rnd(plan.sized_orders(u, ca.threshold_table(spark), class_members, regime.confirmed(labels, 2), held, F.col("k") % 37 == 0))


CUT = "DATE '1997-01-01'"


def action_log(spark, rows):
    return KeyedLog(spark, new_path(spark, "action-log"), ["date", "ticker"], rows.schema)


@query("g04_action_log_backfill", ctes=("reviews",), sql=f"""
SELECT ticker, date, action, conviction, CASE WHEN date >= {CUT} AND okey % 3 <> 0 THEN 'live' ELSE 'backfill' END AS source FROM reviews""")
def g04(spark, sf):
    """A log that its writer has kept in part is filled from the history, twice: the second time adds nothing."""
    r = lens.reviews(spark, sf).select("ticker", "date", "action", "conviction", "okey")  # lies by ticker and day, as an append needs it
    row = lambda d, source: d.select("ticker", "date", "action", "conviction", F.lit(source).alias("source"))
    live, history = row(r.where(f"date >= {CUT} and okey % 3 <> 0"), "live"), row(r, "backfill")
    log = action_log(spark, live)
    log.append(live, F.col("conviction"))
    log.append(history, F.col("conviction"))
    log.append(history, F.col("conviction"))
    return log.read()


@query("g05_gated_action_log_write", ctes=("reviews",), sql="""
w AS (SELECT *, year(date) % 2 = 0 AS odd, CASE WHEN okey % CASE WHEN year(date) % 2 = 0 THEN 3 ELSE 50 END = 0 THEN NULL ELSE okey % 9 - 4 END AS points FROM reviews),
g AS (SELECT odd, count(points) >= 0.9 * count(*) AS kept FROM w GROUP BY 1)
SELECT ticker, date, action, points FROM w JOIN g USING (odd) WHERE kept""")
def g05(spark, sf):
    """Two writes: every other year, where one row of fifty lacks its modifiers, and the rest, where one of three
    does. A write needs nine of ten."""
    every_other = F.year("date") % 2 == 0
    missing = F.col("okey") % F.when(every_other, 3).otherwise(50) == 0
    r = lens.reviews(spark, sf).select("ticker", "date", "action", F.when(~missing, F.col("okey") % 9 - 4).alias("points"))
    log = action_log(spark, r)
    for part in (r.where(~every_other), r.where(every_other)):
        log.append(part, F.col("points"), F.col("points").isNotNull(), 0.9)
    return log.read()
