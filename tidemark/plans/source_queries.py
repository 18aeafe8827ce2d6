"""Queries that go through files or streams: S*, R*. Their folders are in the shared directory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.timeseries_queries import r6
from tidemark.registry import query
from tidemark.session import new_path
from tidemark.sources import files, lens
from tidemark.streaming import jobs


@query("s01_universe_csv", ctes=("universe",), sql="SELECT ticker, upside, roe FROM universe")
def s01(spark, sf):
    path = new_path(spark, "universe-csv")
    files.write_result(lens.universe(spark, sf).select("ticker", "k", "upside", "roe"), path, "csv")
    return files.read_universe_csv(spark, path, ["ticker", "k", "upside", "roe"], ["upside", "roe", "k"], order="k").select("ticker", "upside", "roe")


@query("s02_signal_log_json", ctes=("log",), sql="SELECT cast(ticker as varchar) AS ticker, date, max_by(signal, ts) AS signal, max_by(value, ts) AS price FROM log WHERE signal IN ('B','S','H') GROUP BY 1, 2")
def s02(spark, sf):
    path = new_path(spark, "signal-log")
    rows = lens.log(spark, sf).select(F.col("ticker").cast("string").alias("ticker"), "signal", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("value").alias("price_at_signal"), F.array().cast("array<string>").alias("sell_triggers"))
    text = rows.select(F.to_json(F.struct("*")).alias("value"))
    bad = rows.limit(1).select(F.lit('{"ticker": "BUY1", "signal": "B", "timestamp": "2024-01-01"}\n{"broken').alias("value"))
    text.unionByName(bad).write.text(path)
    return files.read_signal_log(spark, path).select("ticker", "date", "signal", F.col("price_at_signal").alias("price"))


@query("s04_x07_history_json", ctes=("reviews",), sql="SELECT cast(date as date) AS date, cast(ticker as varchar) AS ticker, action, conviction FROM reviews")
def s04(spark, sf):
    """Each line is one run date in one of two shapes, a list or a map by ticker. A line holds the
    tickers of one day and one shard of them, so no line grows with the table."""
    r = lens.reviews(spark, sf).select("date", F.col("ticker").cast("string").alias("ticker"), "action", "conviction", F.pmod(F.xxhash64("ticker"), F.lit(64)).alias("shard"))
    g = r.groupBy("date", "shard").agg(F.collect_list(F.struct("ticker", "action", "conviction")).alias("rows"))
    as_map = F.map_from_entries(F.transform("rows", lambda x: F.struct(x["ticker"], F.struct(x["action"].alias("action"), x["conviction"].alias("conviction")))))
    even = F.to_json(F.struct("date", "rows"))
    odd = F.to_json(F.struct("date", as_map.alias("stocks")))
    path = new_path(spark, "history")
    g.select(F.when(F.col("shard") % 2 == 0, even).otherwise(odd).alias("value")).write.text(path)
    return files.read_history(spark, path)


@query("s05_s06_price_freshness", ctes=("prices", "dims"), sql="""
SELECT d.ticker, max(p.date) AS last_date, CASE WHEN max(p.date) IS NULL THEN 'missing' WHEN DATE '2001-11-05' - max(p.date) <= 2 THEN 'fresh' WHEN DATE '2001-11-05' - max(p.date) <= 7 THEN 'stale' ELSE 'very_stale' END AS status FROM dims d LEFT JOIN prices p ON p.ticker = d.ticker GROUP BY 1""")
def s06(spark, sf):
    path = new_path(spark, "prices")
    files.append_partitioned(lens.prices(spark, sf).withColumn("year", F.year("date")), path, "year")
    return files.freshness(lens.dims(spark, sf).select("ticker"), spark.read.parquet(path), F.lit("2001-11-05").cast("date")).drop("age")


@query("s07_universe_shards", ctes=("universe",), sql="SELECT k % 6 AS shard, count(*) AS n, min(k) AS first_k FROM universe GROUP BY 1")
def s07(spark, sf):
    """Dealt by a key already numbered from 0: no global row number is needed."""
    return lens.universe(spark, sf).groupBy(F.pmod("k", F.lit(6).cast("long")).alias("shard")).agg(F.count("*").alias("n"), F.min("k").alias("first_k"))


@query("s08_s12_shard_merge", ctes=("universe",), sql="SELECT ticker, cap_value, CASE WHEN k % 2 = 0 THEN 0 WHEN k % 3 = 0 THEN 1 ELSE 2 END AS src FROM universe")
def s08(spark, sf):
    u = lens.universe(spark, sf).select("ticker", "cap_value", "k")
    a = u.where("k % 2 = 0").drop("k").withColumn("src", F.lit(0))
    b = u.where("k % 3 = 0").drop("k").withColumn("src", F.lit(1))
    c = u.where("k % 2 != 0 and k % 3 != 0").drop("k").withColumn("src", F.lit(2))
    return files.merge_shards([a, b, c], "ticker", "cap_value")


@query("s09_month_end_upsert", ctes=("prices",), sql="""
SELECT ticker, date_trunc('month', date)::date AS month, max_by(close, date) AS close FROM prices GROUP BY 1, 2""")
def s09(spark, sf):
    px = lens.prices(spark, sf)
    part = lambda d: d.groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("asof"), F.max_by("close", "date").alias("close"))
    return files.upsert_latest(part(px.where("date < DATE '1999-06-15'")), part(px), ["ticker", "month"], "asof").drop("asof")


@query("s10_parameter_history", ctes=("reviews",), sql="SELECT date, ticker, conviction, 'review' AS source FROM reviews WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-01-31'")
def s10(spark, sf):
    """Partitioned by month, so a date filter prunes folders."""
    path = new_path(spark, "parameters")
    r = lens.reviews(spark, sf).select("date", "ticker", "conviction", F.lit("review").alias("source"), F.date_format("date", "yyyy-MM").alias("month"))
    files.append_partitioned(r, path, "source", "month")
    d = spark.read.parquet(path).where("source = 'review' and month = '2000-01' and date between DATE '2000-01-01' and DATE '2000-01-31'")
    return d.select("date", "ticker", "conviction", "source")


@query("s03_j22_census_files", ctes=("holders",), sql="SELECT month AS date, 'T' || ticker AS symbol, count(*) AS holders FROM holders GROUP BY 1, 2")
def s03(spark, sf):
    """Nested snapshot documents, ids in one array and holdings in another; a day is written as one
    document per shard of the instruments."""
    h = lens.holders(spark, sf).groupBy(F.col("month").alias("date"), "ticker").agg(F.count("*").alias("holders"))
    g = h.withColumn("shard", F.pmod(F.xxhash64("ticker"), F.lit(64))).groupBy("date", "shard").agg(F.collect_list(F.struct(F.col("ticker").alias("instrumentId"), F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("symbolFull"))).alias("d"),
                              F.collect_list(F.struct(F.col("ticker").alias("instrumentId"), F.col("holders").alias("holdersCount"))).alias("t"))
    doc = F.to_json(F.struct(F.struct(F.col("d").alias("details")).alias("instruments"), F.array(F.struct(F.lit(100).alias("investorCount"), F.lit(50).alias("fearGreedIndex"), F.col("t").alias("topHoldings"))).alias("analyses")))
    path = new_path(spark, "census")
    g.select(F.concat(F.lit("snapshot-"), F.date_format("date", "yyyy-MM-dd"), F.lit("-06-00")).alias("day"), doc.alias("value")).repartition("day").write.partitionBy("day").text(path)
    raw = spark.read.text(path).select(F.regexp_extract("day", r"(\d{4}-\d{2}-\d{2})", 1).cast("date").alias("date"), F.from_json("value", files.CENSUS_SCHEMA).alias("v")).select("date", "v.*")
    a = F.get(F.filter("analyses", lambda x: x["investorCount"] == 100), F.lit(0))
    ids = F.map_from_entries(F.transform("instruments.details", lambda x: F.struct(x["instrumentId"], x["symbolFull"])))
    return raw.select("date", a.alias("a"), ids.alias("ids")).select("date", "ids", F.explode("a.topHoldings").alias("h")).select("date", F.col("ids")[F.col("h.instrumentId")].alias("symbol"), F.col("h.holdersCount").alias("holders"))


@query("r01_stream_daily_latest", ctes=("log",), sql="SELECT ticker, date, max_by(signal, ts) AS signal, max(ts) AS last_ts FROM log GROUP BY 1, 2")
def r01(spark, sf):
    return jobs.latest(jobs.run(jobs.daily_latest(jobs.log_stream(spark, sf)), "daily"), ["ticker", "date"])


@query("r02_stream_change_alerts", ctes=("log",), sql="""
SELECT ticker, ts, prev AS previous_signal, signal AS current_signal FROM (SELECT *, lag(signal) OVER (PARTITION BY ticker ORDER BY ts) AS prev FROM log) WHERE prev <> signal""")
def r02(spark, sf):
    s = jobs.log_stream(spark, sf).withWatermark("ts", "2 days")
    a = jobs.change_alerts(s)
    with jobs.rocksdb_state(spark):
        out = jobs.run(a, "alerts", "append")
    return out.where("current_signal is not null").drop("batch", "late")


@query("r03_stream_sliding_buy_rate", ctes=("log",), sql="""
SELECT date_trunc('day', ts) - INTERVAL 1 DAY * o.o AS start, count(*) AS n, count(*) FILTER (signal = 'B') AS buys FROM log, (VALUES (0),(1),(2),(3),(4),(5),(6)) o(o) GROUP BY 1""")
def r03(spark, sf):
    return jobs.latest(jobs.run(jobs.buy_rate(jobs.log_stream(spark, sf), "7 days", "1 day"), "rates"), ["start"])


@query("r09_stream_static_join", ctes=("log",), sql="SELECT ticker, ts, signal, value FROM log JOIN (VALUES ('B', 20.0), ('S', 10.0), ('H', 30.0)) t(signal, m) USING (signal) WHERE value >= m")
def r09(spark, sf):
    t = spark.createDataFrame([("B", 20.0), ("S", 10.0), ("H", 30.0)], "signal string, min_value double")
    return jobs.run(jobs.with_thresholds(jobs.log_stream(spark, sf), t).select("ticker", "ts", "signal", "value"), "joined", "append").drop("batch")


@query("r06_r07_stream_state_tables", ctes=("log",), sql="SELECT ticker, max(ts) FILTER (signal = 'S') AS last_trigger, max(value) AS high, max_by(value, ts) AS last_value, max_by(value, ts) <= max(value) * 0.8 AS stop_hit FROM log GROUP BY 1")
def r06(spark, sf):
    """Cooldown start and running high per ticker as stateful aggregates; timers are derived at read time."""
    s = jobs.log_stream(spark, sf).groupBy("ticker").agg(F.max(F.when(F.col("signal") == "S", F.col("ts"))).alias("last_trigger"), F.max("value").alias("high"), F.max_by("value", "ts").alias("last_value"))
    d = jobs.latest(jobs.run(s, "state"), ["ticker"])
    return d.withColumn("stop_hit", F.col("last_value") <= F.col("high") * 0.8)
