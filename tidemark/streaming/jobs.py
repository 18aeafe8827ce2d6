"""Structured Streaming jobs over an event log (ticker, ts, signal, value).

Time and lateness rules are ours: event time is ``ts``; rows later than the watermark are
dropped by the stateful operators, and a batch recompute over the full log is the truth. Sinks are written once per
batch id, so a retried batch replaces its own output.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.session import new_path
from tidemark.sources.lens_columns import EVENT_SIGNAL, sql_case

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def log_stream(spark: SparkSession, sf: str, files_per_trigger: int = 1) -> DataFrame:
    """The event files as a stream source, so many to a micro-batch."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf)
    return raw.selectExpr("user_id AS ticker", "cast(ts AS timestamp) AS ts", f"{sql_case('event_type', EVENT_SIGNAL, quote=True)} AS signal", "value")


def run(df: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Drain what is available through ``foreachBatch`` into a shared folder, one sub-folder per
    batch id (overwritten on retry), and read it back with the batch id as ``batch``."""
    spark = df.sparkSession
    out = new_path(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", new_path(spark, name + "-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema.add("batch", IntegerType())).parquet(out)


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key (R10: the upsert is taken at read time)."""
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def daily_latest(log: DataFrame, delay: str = "2 days") -> DataFrame:
    """Latest entry per (ticker, day)."""
    d = log.withWatermark("ts", delay)
    return (d.groupBy("ticker", F.window("ts", "1 day")).agg(F.max_by("signal", "ts").alias("signal"), F.max("ts").alias("last_ts"))
            .select("ticker", F.col("window.start").cast("date").alias("date"), "signal", "last_ts"))


def buy_rate(log: DataFrame, width: str, slide: str, delay: str = "2 days") -> DataFrame:
    """Tumbling or sliding share of B per window."""
    g = log.withWatermark("ts", delay).groupBy(F.window("ts", width, slide))
    return g.agg(F.count("*").alias("n"), F.count(F.when(F.col("signal") == "B", 1)).alias("buys")).select(F.col("window.start").alias("start"), "n", "buys")


def sessions(log: DataFrame, gap: str = "12 hours", delay: str = "2 days") -> DataFrame:
    """Activity sessions per ticker, emitted once the watermark has passed them."""
    g = log.withWatermark("ts", delay).groupBy("ticker", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("ticker", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def with_thresholds(log: DataFrame, table: DataFrame) -> DataFrame:
    """Stream joined to a small static table (a literal per label)."""
    return log.join(F.broadcast(table), "signal").where(F.col("value") >= F.col("min_value"))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State store that arbitrary state needs, for the streams run inside; other streams of the session keep theirs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class ChangeAlerts(StatefulProcessor):
    """Last label per ticker as state; emits a row when the label changes.

    A micro-batch is taken in time order within a ticker, as one pandas block (its size follows the trigger's
    limits on files). A row older than the stored time is late: it is dropped, and a row without labels says how
    many were dropped (R08). State per ticker is one row.
    """

    def init(self, handle):
        self.last = handle.getValueState("last", "ts timestamp, signal string")

    def handleInputRows(self, key, rows, timer_values):
        # most calls see a few rows: plain arrays, as the fixed cost of pandas would be most of the time of a stream with many keys
        before, sig = self.last.get() or (None, None)
        parts = [(c["ts"].to_numpy(), c["signal"].to_numpy(object)) for c in rows]
        ts, label = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ts, kind="stable")
        ts, label = ts[order], label[order]
        first = ts[0]
        if before is not None:
            fresh = ts >= np.datetime64(before)
            ts, label = ts[fresh], label[fresh]
        late = len(order) - len(ts)
        prev = np.empty(len(ts), object)
        if len(ts):
            prev[0], prev[1:] = sig, label[:-1]
            self.last.update((pd.Timestamp(ts[-1]).to_pydatetime(), label[-1]))
        hit = ~pd.isna(prev) & (prev != label)
        out = [ts[hit], prev[hit], label[hit], np.zeros(hit.sum(), "int64")]
        if late:
            out = [np.append(a, np.array([x], a.dtype)) for a, x in zip(out, (first, None, None, late))]
        if len(out[0]):
            yield pd.DataFrame({"ticker": key[0], "ts": out[0], "previous_signal": out[1], "current_signal": out[2], "late": out[3]})

    def close(self):
        pass


CHANGE_SCHEMA = "ticker bigint, ts timestamp, previous_signal string, current_signal string, late bigint"


#: Groups of tickers that share a call and a list of states.
BUCKETS = 1024


class ChangeAlertsOfBucket(StatefulProcessor):
    """``ChangeAlerts`` for all tickers of a bucket side by side: one call, one read and one write of state per bucket and batch,
    where a call per ticker would be most of the time of a stream with many tickers. The state is a list with one entry per ticker.
    Tickers come as text, so that NULL is one of them and no number is rounded."""

    def init(self, handle):
        self.last = handle.getListState("last", "ticker string, ts timestamp, signal string")

    def handleInputRows(self, key, rows, timer_values):
        held = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        d = pd.concat(list(rows))
        code, names = pd.factorize(np.concatenate([np.array([h[0] for h in held], object), d["ticker"].to_numpy(object)]), use_na_sentinel=False)
        known, at, label = np.zeros(len(names), bool), np.full(len(names), "NaT", "datetime64[us]"), np.empty(len(names), object)
        old, code = code[: len(held)], code[len(held) :]
        known[old], at[old] = True, np.array([h[1] for h in held], "datetime64[us]")
        label[old] = [h[2] for h in held]
        ts, sig = d["ts"].to_numpy().astype("datetime64[us]"), d["signal"].to_numpy(object)
        order = np.lexsort((ts, code))
        code, ts, sig = code[order], ts[order], sig[order]
        first = np.r_[True, code[1:] != code[:-1]]
        begins = dict(zip(code[first].tolist(), ts[first]))
        late = known[code] & ~(ts >= at[code])
        dropped = np.bincount(code[late], minlength=len(names))
        code, ts, sig = code[~late], ts[~late], sig[~late]
        new = np.r_[True, code[1:] != code[:-1]][: len(code)]
        end = np.r_[code[1:] != code[:-1], True][: len(code)]
        prev = np.where(new, label[code], np.r_[sig[:1], sig[:-1]])
        hit = ~pd.isna(prev) & (prev != sig)
        at[code[end]], label[code[end]] = ts[end], sig[end]
        self.last.put(list(zip([None if pd.isna(n) else n for n in names], at.tolist(), label)))
        gone = np.flatnonzero(dropped)
        none = np.full(len(gone), None, object)
        out = {"ticker": (names[code[hit]], names[gone]), "ts": (ts[hit], np.array([begins[g] for g in gone.tolist()], "datetime64[us]")),
               "previous_signal": (prev[hit], none), "current_signal": (sig[hit], none), "late": (np.zeros(hit.sum(), "int64"), dropped[gone])}
        yield pd.DataFrame({c: np.concatenate(x) for c, x in out.items()})

    def close(self):
        pass


def change_alerts(log: DataFrame) -> DataFrame:
    """R02, R08 over (ticker, ts, signal): label changes and how many late rows were dropped."""
    d = log.select(F.col("ticker").cast("string").alias("ticker"), "ts", "signal").withColumn("bucket", F.pmod(F.hash("ticker"), F.lit(BUCKETS)))
    out = d.groupBy("bucket").transformWithStateInPandas(ChangeAlertsOfBucket(), CHANGE_SCHEMA.replace("ticker bigint", "ticker string"), "append", "none")
    return out.withColumn("ticker", F.col("ticker").cast("bigint"))
