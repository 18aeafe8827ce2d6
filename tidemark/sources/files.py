"""File sources and sinks: CSV snapshots, JSON logs, nested holder files, price folders, result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import parse

# Tickers of test rows, and labels that count.
TEST_TICKER = r"^(STOCK\d+|BUY\d+|SELL\d+|HOLD\d+|WEAK\d*)$"
LABELS = ("B", "S", "H")

LOG_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("signal", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("price_at_signal", T.DoubleType()), T.StructField("sell_triggers", T.ArrayType(T.StringType())),
    T.StructField("_corrupt", T.StringType())])
CENSUS_SCHEMA = "instruments struct<details:array<struct<instrumentId:long,symbolFull:string>>>, analyses array<struct<investorCount:long,fearGreedIndex:long,topHoldings:array<struct<instrumentId:long,holdersCount:long>>>>"


def read_universe_csv(spark: SparkSession, path: str, columns: list[str], numeric: list[str], key: str = "ticker", order: str | None = None) -> DataFrame:
    """All text in, numbers tried, first row per key kept by an explicit order column."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    d = spark.read.schema(schema).option("header", True).csv(path)
    d = d.select(*[(parse.number(c) if c in numeric else F.col(c)).alias(c) for c in columns])
    if order is None:
        return d
    rest = [c for c in columns if c != key]
    g = d.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))  # aggregate, so a hot key is combined map-side
    return g.select(key, "r.*")


def read_signal_log(spark: SparkSession, path: str) -> DataFrame:
    """Bad lines skipped, test tickers and other labels dropped, latest per (ticker, day)."""
    d = spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    d = d.where(F.col("_corrupt").isNull() & ~F.col("ticker").rlike(TEST_TICKER) & F.col("signal").isin(*LABELS))
    d = d.withColumn("ts", F.col("timestamp").try_cast("timestamp")).where("ts is not null").withColumn("date", F.col("ts").cast("date"))
    g = d.groupBy("ticker", "date").agg(F.max(F.struct("ts", "signal", "price_at_signal", "sell_triggers")).alias("r"))
    return g.select("ticker", "date", "r.*")


def read_census(spark: SparkSession, path: str, tier: int) -> DataFrame:
    """Date and time from the file name, latest file per day, the analysis of one tier, ids to symbols."""
    d = spark.read.schema(CENSUS_SCHEMA).option("multiLine", True).json(path)
    name = F.col("_metadata.file_path")
    d = d.select("*", F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})-(\d{2}-\d{2})\.json$", 1).cast("date").alias("date"), F.regexp_extract(name, r"(\d{2}-\d{2})\.json$", 1).alias("time"))
    d = d.groupBy("date").agg(F.max_by(F.struct("instruments", "analyses"), "time").alias("f")).select("date", "f.*")
    a = F.get(F.filter("analyses", lambda x: x["investorCount"] == tier), F.lit(0))
    ids = F.map_from_entries(F.transform("instruments.details", lambda x: F.struct(x["instrumentId"], x["symbolFull"])))
    d = d.select("date", a.alias("a"), ids.alias("ids")).where("a is not null")
    return d.select("date", "ids", F.explode("a.topHoldings").alias("h")).select("date", F.col("ids")[F.col("h.instrumentId")].alias("symbol"), F.col("h.holdersCount").alias("holders"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line that is either a list of rows, or an object that holds the
    list or a map by ticker; all become (date, ticker, action, conviction)."""
    d = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    row = "ticker string, action string, conviction bigint"
    as_list = F.coalesce(F.try_variant_get("v", "$.rows", f"array<struct<{row}>>"), F.try_variant_get("v", "$", f"array<struct<{row}>>"))
    as_map = F.transform(F.map_entries(F.try_variant_get("v", "$.stocks", "map<string, struct<action string, conviction bigint>>")),
                         lambda e: F.struct(e["key"].alias("ticker"), e["value"]["action"].alias("action"), e["value"]["conviction"].alias("conviction")))
    d = d.select(F.try_variant_get("v", "$.date", "date").alias("date"), F.explode(F.coalesce(as_list, as_map)).alias("r"))
    return d.select(F.coalesce("date", F.lit(None).cast("date")).alias("date"), "r.*")


def freshness(universe: DataFrame, px: DataFrame, as_of) -> DataFrame:
    """Age of the last bar per ticker; absent tickers are missing."""
    last = px.groupBy("ticker").agg(F.max("date").alias("last_date"))
    age = F.datediff(as_of, "last_date")
    st = F.when(age.isNull(), "missing").when(age <= 2, "fresh").when(age <= 7, "stale").otherwise("very_stale")
    return universe.join(last, "ticker", "left").select("ticker", "last_date", age.alias("age"), st.alias("status"))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key of both tables, as one aggregate."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def merge_shards(shards: list[DataFrame], key: str, rank: str) -> DataFrame:
    """Union of shard outputs, first shard wins on a repeated key, sorted by ``rank``."""
    tagged = [s.withColumn("_s", F.lit(i)) for i, s in enumerate(shards)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in (key, "_s")]
    return u.groupBy(key).agg(F.min_by(F.struct(*rest), "_s").alias("r")).select(key, "r.*").orderBy(F.desc_nulls_last(rank), key)


def append_partitioned(df: DataFrame, path: str, *parts: str) -> None:
    """Append to a table partitioned by ``parts``; the same columns prune later reads."""
    df.write.mode("append").partitionBy(*parts).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """An empty result still writes its schema (CSV: its header)."""
    w = df.write.mode("error")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path) if fmt == "json" else w.parquet(path))
