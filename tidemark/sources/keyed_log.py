"""An append-only log with keys on a shared folder: appends are idempotent, gated and appear whole or not at all.

An append writes its rows to a folder of their own that no reader looks at, and counts them on the way (an
``Observation``, no second pass). Only then a commit file with the next version number names the folder. Readers
follow commit files. A commit file that another writer made first fails the commit; the append is then tried again
against the log as it has become. Rows whose key the log has are left out, so the same append again adds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Outcome:
    """What an append did: the version it made (None: nothing was committed), its new rows and how many were covered."""

    version: int | None
    rows: int
    covered: int
    refused: bool = False


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    def _commit_file(self, version: int):
        return self._path(f"{self.path}/_commits/{version:010d}")

    def folders(self) -> list[str]:
        """Committed folders, oldest first."""
        top = self._path(f"{self.path}/_commits")
        if not self._fs.exists(top):
            return []
        files = sorted((s.getPath() for s in self._fs.listStatus(top)), key=lambda p: p.getName())
        out = []
        for f in files:
            stream = self._fs.open(f)
            try:
                out.append(self._text(stream))
            finally:
                stream.close()
        return out

    def read(self) -> DataFrame:
        found = [f"{self.path}/{x}" for x in self.folders()]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, first: Column, covered: Column | None = None, least: float = 0.0, tries: int = 5) -> Outcome:
        """Append rows with new keys; of several rows of one key the one with the smallest ``first`` (NULL last) counts. The append is refused
        if fewer than the share ``least`` of its new rows are ``covered``: then nothing is visible or left behind.
        Rows with a NULL in a key are refused by an error."""
        covered = F.lit(True) if covered is None else F.coalesce(covered, F.lit(False))
        names = self.schema.fieldNames()
        for _ in range(tries):
            version = len(self.folders())
            rest = [c for c in names if c not in self.keys]
            d = rows.withColumn("_first", F.struct(first.isNull(), first)).groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.col("_first")).alias("_r")).select(*self.keys, "_r.*")
            d = d.join(self.read().select(*self.keys), self.keys, "left_anti").select(*names)  # the log has a key once
            null = F.lit(False)
            for k in self.keys:
                null |= F.col(k).isNull()
            seen, name = Observation(), f"part-{uuid.uuid4().hex}"
            d = d.observe(seen, F.count("*").alias("rows"), F.count(F.when(covered, 1)).alias("covered"), F.count(F.when(null, 1)).alias("null_keys"))
            d.write.mode("error").parquet(f"{self.path}/{name}")
            n = seen.get
            if n["null_keys"] or not n["rows"] or n["covered"] < least * n["rows"]:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
                if n["null_keys"]:
                    raise ValueError(f"{n['null_keys']} rows without a key")
                return Outcome(None, n["rows"], n["covered"], bool(n["rows"]))
            if self._commit(version, name):
                return Outcome(version, n["rows"], n["covered"])
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        raise RuntimeError("other writers committed first each time")

    def _commit(self, version: int, name: str) -> bool:
        try:
            out = self._fs.create(self._commit_file(version), False)
        except Py4JJavaError as e:
            if "already exist" in str(e.java_exception).lower():
                return False
            raise
        try:
            out.write(bytearray(name.encode()))
        finally:
            out.close()
        return True
