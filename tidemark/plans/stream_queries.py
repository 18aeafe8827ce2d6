"""Streams over several arrivals, with restarts and late files: R03 by sector, R04, R05, R06, R08."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.sources import lens
from tidemark.sources.lens_columns import EVENT_SIGNAL, sql_case
from tidemark.streaming import arrivals, jobs

#: Rows that arrive one file late, a stand-in by key.
LATE = "event_id % 97 = 11"
#: A stand-in: which regime a label of the log observes.
REGIME_OF = {"B": "risk_on", "H": "neutral", "S": "risk_off", "I": "crisis"}

ARRIVALS_SQL = f"""
mid AS (SELECT min(date) + ((max(date) - min(date)) // 2)::INT AS m FROM log),
arr AS (SELECT log.*, (date >= m)::INT + ({LATE})::INT AS arrival FROM log, mid)"""


def labelled(stream):
    return stream.selectExpr("user_id AS ticker", "cast(ts AS timestamp) AS ts", f"{sql_case('event_type', EVENT_SIGNAL, quote=True)} AS signal", "value")


def events(spark, sf):
    return lens.table(spark, sf, "events")


def with_late_files(spark, sf):
    return arrivals.in_two_halves(events(spark, sf), F.expr(LATE))


@query("r04_stream_sessions", ctes=("log",), sql="""
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM log),
i AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY ts) AS sid FROM g)
SELECT ticker, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM i GROUP BY ticker, sid""")
def r04(spark, sf):
    """All sessions: the log in two arrivals, then a heartbeat that closes what is open."""
    e = events(spark, sf)
    files = [*arrivals.in_two_halves(e), arrivals.heartbeat(e)]
    out = arrivals.run(spark, files, lambda s: jobs.sessions(labelled(s)), "sessions", "append")["all"]
    return out.where("ticker <> -1").drop("batch")


@query("r03_stream_sector_buy_rate", ctes=("log",), sql="""
SELECT n_name AS sector, date_trunc('day', ts) AS start, count(*) AS n, count(*) FILTER (signal = 'B') AS buys FROM log JOIN customer ON c_custkey = ticker JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def r03_sector(spark, sf):
    """Share of B per sector and day. The dimension grows with the customers, so the join picks its own side."""
    n = lens.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("sector"))
    dim = lens.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ticker"), "sector")

    def rate(stream):
        d = labelled(stream).withWatermark("ts", "40 days").join(dim, "ticker").groupBy("sector", F.window("ts", "1 day"))
        return d.agg(F.count("*").alias("n"), F.count(F.when(F.col("signal") == "B", 1)).alias("buys")).select("sector", F.col("window.start").alias("start"), "n", "buys")

    return jobs.latest(arrivals.run(spark, with_late_files(spark, sf), rate, "sector-rates")["all"], ["sector", "start"])


@query("r05_stream_regime_history", ctes=("log",), sql=ARRIVALS_SQL + f""",
o AS (SELECT ticker, date AS day, ts, arrival, {sql_case('signal', REGIME_OF, quote=True)} AS regime, max(date) OVER (PARTITION BY ticker ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM arr),
e AS (SELECT ticker, day, max_by(regime, ts) AS regime FROM o WHERE newest IS NULL OR day >= newest GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i, lag(regime) OVER (PARTITION BY ticker ORDER BY day) = regime AS again FROM e),
c AS (SELECT n.ticker, n.day, n.regime, n.i, coalesce((SELECT max_by(p.regime, p.i) FROM n p WHERE p.ticker = n.ticker AND p.again AND p.i BETWEEN greatest(n.i - 8, 2) AND n.i), 'neutral') AS confirmed FROM n)
SELECT ticker, day, regime, confirmed, CASE confirmed WHEN 'risk_on' THEN 1.0 WHEN 'neutral' THEN 0.9 WHEN 'risk_off' THEN 0.65 ELSE 0.4 END::DOUBLE AS exposure, least(i, 10)::INTEGER AS entries FROM c""")
def r05(spark, sf):
    """One observation per row of the log, three arrivals, a restart before each; the last word on each day."""

    def history(stream):
        label = F.expr(sql_case("signal", REGIME_OF, quote=True))
        return arrivals.regime_history(labelled(stream).select("ticker", F.col("ts").cast("date").alias("day"), "ts", label.alias("regime")))

    return jobs.latest(arrivals.run(spark, with_late_files(spark, sf), history, "regimes")["all"], ["ticker", "day"])


@query("r06_stream_cooldown_timers", ctes=("log",), sql=ARRIVALS_SQL + """,
wm AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival) - INTERVAL 1 DAY AS w FROM arr GROUP BY 1),
s AS (SELECT ticker, ts FROM arr LEFT JOIN wm ON wm.arrival = arr.arrival - 1 WHERE signal = 'S' AND (w IS NULL OR ts > w)),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts) <= INTERVAL 3 DAY THEN 0 ELSE 1 END AS new FROM s),
n AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY ts) AS no FROM g)
SELECT ticker, no::INTEGER AS no, min(ts) AS started, max(ts) AS last, max(ts) + INTERVAL 3 DAY AS expires, count(*)::INTEGER AS triggers,
  CASE WHEN max(ts) + INTERVAL 3 DAY <= (SELECT max(w) FROM wm) OR no < max(no) OVER (PARTITION BY ticker) THEN 'expired' ELSE 'running' END AS status FROM n GROUP BY ticker, no""")
def r06_timers(spark, sf):
    """Cooldowns of three days (the log has thirty); rows behind the watermark are late and dropped."""
    build = lambda s: arrivals.cooldowns(arrivals.behind_watermark(labelled(s).withWatermark("ts", "1 day"), F.col("signal") == "S").select("ticker", "ts"), 3)
    return jobs.latest(arrivals.run(spark, with_late_files(spark, sf), build, "cooldowns")["all"], ["ticker", "no"])


def alerts_and_late(spark, sf):
    build = lambda s: jobs.change_alerts(labelled(s).withWatermark("ts", "2 days"))
    return arrivals.run(spark, with_late_files(spark, sf), build, "alerts", "append", {"late": F.col("late") > 0, "alerts": F.col("current_signal").isNotNull()})


LATENESS_SQL = ARRIVALS_SQL + ", l AS (SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY ticker ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM arr)"


@query("r08_stream_late_rows", ctes=("log",), sql=LATENESS_SQL + " SELECT ticker, count(*) AS late FROM l WHERE late GROUP BY 1")
def r08(spark, sf):
    """How many rows of each ticker were older than what its state had when they came: the second sink of the alerts."""
    return alerts_and_late(spark, sf)["late"].groupBy("ticker").agg(F.sum("late").alias("late"))


@query("r02_r08_alerts_with_late_files", ctes=("log",), sql=LATENESS_SQL + """
SELECT ticker, ts, prev AS previous_signal, signal AS current_signal FROM (SELECT *, lag(signal) OVER (PARTITION BY ticker ORDER BY ts) AS prev FROM l WHERE NOT late) WHERE prev <> signal""")
def r02_late(spark, sf):
    return alerts_and_late(spark, sf)["alerts"].drop("batch", "late")
