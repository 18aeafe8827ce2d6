"""Streams over several arrivals: every arrival is a restart from the checkpoint."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import arrivals, jobs

T = dt.datetime


def rows(spark, *events):
    """(id, time, ticker, event type)."""
    return spark.createDataFrame([(i, t, k, e, 1.0, "{}") for i, t, k, e in events], jobs.EVENTS)


def triggers(stream):
    return arrivals.behind_watermark(stream.withWatermark("ts2", "1 day"), F.col("event_type") == "error", "ts2").select(F.col("user_id").alias("ticker"), F.col("ts2").alias("ts"))


def test_cooldown_timer_fires_after_a_restart_and_a_late_trigger_is_dropped(spark):
    files = [
        rows(spark, (1, T(2024, 1, 1), 7, "error"), (2, T(2024, 1, 2), 7, "error"), (3, T(2024, 1, 3), 8, "view")),
        rows(spark, (4, T(2024, 1, 9), 8, "view")),  # moves the watermark past ticker 7's end; no row of its own
        rows(spark, (5, T(2024, 1, 3), 7, "error"), (6, T(2024, 1, 9, 6), 7, "error"), (7, T(2024, 1, 9, 7), 9, "error")),  # the first comes too late
    ]
    out = arrivals.run(spark, files, lambda s: arrivals.cooldowns(triggers(s.withColumn("ts2", F.col("ts").cast("timestamp"))), 3), "test-cooldown")["all"]
    got = {(r.ticker, r.no): (r.started, r.last, r.expires, r.triggers, r.status) for r in jobs.latest(out, ["ticker", "no"]).collect()}
    assert got == {
        (7, 1): (T(2024, 1, 1), T(2024, 1, 2), T(2024, 1, 5), 2, "expired"),
        (7, 2): (T(2024, 1, 9, 6), T(2024, 1, 9, 6), T(2024, 1, 12, 6), 1, "running"),
        (9, 1): (T(2024, 1, 9, 7), T(2024, 1, 9, 7), T(2024, 1, 12, 7), 1, "running"),
    }
    fired = out.where("status = 'expired'").collect()
    assert [(r.ticker, r.no) for r in fired] == [(7, 1)]  # once, by the timer


def test_regime_history_overwrites_the_same_day_stays_bounded_and_survives_restarts(spark):
    kind = {"up": "risk_on", "down": "risk_off"}
    day = lambda d, h=0: T(2024, 1, d, h)
    files = [
        rows(spark, (1, day(1), 1, "up"), (2, day(1, 5), 1, "down"), (3, day(2), 1, "down"), (4, day(1), 2, "up")),
        rows(spark, (5, day(2, 3), 1, "up"), (6, day(1, 9), 1, "up"), (7, day(3), 1, "up")),  # the same day again; an older day; a new one
        rows(spark, *[(10 + d, day(d), 1, "up" if d % 2 else "down") for d in range(4, 16)]),
    ]
    label = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])[F.col("event_type")]
    build = lambda s: arrivals.regime_history(s.select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("day"), F.col("ts").cast("timestamp").alias("ts"), label.alias("regime")))
    out = jobs.latest(arrivals.run(spark, files, build, "test-regime")["all"], ["ticker", "day"])
    got = {(r.ticker, r.day.day): (r.regime, r.confirmed, r.exposure, r.entries) for r in out.collect()}
    assert got[1, 1] == ("risk_off", "neutral", 0.9, 1) and got[2, 1] == ("risk_on", "neutral", 0.9, 1)
    assert got[1, 2] == ("risk_on", "neutral", 0.9, 2)  # was risk_off and confirmed until the later observation
    assert got[1, 3] == ("risk_on", "risk_on", 1.0, 3)
    assert got[1, 11] == ("risk_on", "risk_on", 1.0, 10)  # the run of days 2 and 3 is still in the history
    assert got[1, 15] == ("risk_on", "neutral", 0.9, 10)  # it has left the ten entries kept


def test_late_rows_have_their_own_sink(spark):
    files = [
        rows(spark, (1, T(2024, 1, 1), 1, "view"), (2, T(2024, 1, 5), 1, "error"), (3, T(2024, 1, 5), 2, "view")),
        rows(spark, (4, T(2024, 1, 2), 1, "view"), (5, T(2024, 1, 3), 1, "view"), (6, T(2024, 1, 6), 2, "error")),
    ]
    label = F.when(F.col("event_type") == "error", "S").otherwise("H")
    build = lambda s: s.select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), label.alias("signal")).groupBy("ticker").transformWithStateInPandas(
        jobs.ChangeAlerts(), jobs.CHANGE_SCHEMA, "append", "none")
    out = arrivals.run(spark, files, build, "test-late", "append", {"late": F.col("late") > 0, "alerts": F.col("current_signal").isNotNull()})
    assert [(r.ticker, r.late) for r in out["late"].collect()] == [(1, 2)]
    assert sorted((r.ticker, r.current_signal) for r in out["alerts"].collect()) == [(1, "S"), (2, "S")]


def test_heartbeat_closes_open_sessions(spark):
    e = rows(spark, (1, T(2024, 1, 1), 1, "view"), (2, T(2024, 1, 1, 5), 1, "view"), (3, T(2024, 1, 4), 1, "view"))
    build = lambda s: jobs.sessions(s.selectExpr("user_id AS ticker", "cast(ts AS timestamp) AS ts", "event_type AS signal", "value"))
    out = arrivals.run(spark, [e, arrivals.heartbeat(e)], build, "test-sessions", "append")["all"].where("ticker <> -1")
    assert sorted((r.start, r.n) for r in out.collect()) == [(T(2024, 1, 1), 2), (T(2024, 1, 4), 1)]


def test_alerts_of_a_bucket_are_those_of_its_tickers_in_one_call(spark):
    import numpy as np
    import pandas as pd

    class Cell:
        value = None

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        put = update

    r = np.random.default_rng(4)
    names, each, whole = [None, "9007199254740993", "9007199254740994", "5"], {}, jobs.ChangeAlertsOfBucket()
    whole.last = Cell()
    for day in (9, 5, 12):
        d = pd.DataFrame({"ticker": pd.Series(r.choice(np.array(names, object), 40), dtype=object), "ts": pd.Timestamp(2024, 1, day) + pd.to_timedelta(r.permutation(40) * 7, unit="h"),
                          "signal": pd.Series(r.choice(np.array(["B", "S", None], object), 40), dtype=object)})
        d["ts"] = d["ts"].astype("datetime64[ns]")
        got, want = pd.concat(whole.handleInputRows((3,), iter([d[:25], d[25:]]), None)), []
        for n in names:
            one = each.setdefault(n, jobs.ChangeAlerts())
            one.last = getattr(one, "last", Cell())
            rows = d[d["ticker"].isna() if n is None else d["ticker"] == n]
            if len(rows):
                want += list(one.handleInputRows((n,), iter([rows]), None))
        plain = lambda x: sorted(str([None if pd.isna(v) else v for v in (*row[:1], pd.Timestamp(row[1]), *row[2:])]) for row in x.astype(object).values.tolist())
        assert plain(got) == plain(pd.concat(want))
        assert got["late"].sum() > 0 or day != 5
    assert {x[0] for x in whole.last.value} == set(names) and {x[0]: x[1:] for x in whole.last.value} == {n: one.last.value for n, one in each.items()}


def test_alerts_are_grouped_by_bucket(spark):
    log = spark.readStream.schema(jobs.EVENTS).parquet("/root/testdata/sf0.001").selectExpr("user_id AS ticker", "cast(ts AS timestamp) AS ts", "event_type AS signal")
    assert "bucket" in jobs.change_alerts(log)._jdf.queryExecution().analyzed().toString()
