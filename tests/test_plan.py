"""The keyed log and the end-to-end plan."""

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidemark.operators import plan
from tidemark.session import shared_dir
from tidemark.sources.keyed_log import KeyedLog


def rows(spark, *r):
    return spark.createDataFrame(list(r), "date int, ticker string, x double")


def test_appends_are_idempotent_and_refusals_leave_nothing(spark, tmp_path):
    a = rows(spark, (1, "a", 1.0), (1, "b", None), (1, "a", 0.5))
    log = KeyedLog(spark, str(tmp_path / "log"), ["date", "ticker"], a.schema)
    assert log.read().count() == 0
    got = log.append(a, F.col("x"))
    assert (got.version, got.rows, got.refused) == (0, 2, False)
    again = log.append(a, F.col("x"))
    assert (again.version, again.rows, again.refused) == (None, 0, False)
    assert sorted((r.ticker, r.x) for r in log.read().collect()) == [("a", 0.5), ("b", None)]
    b = rows(spark, (2, "a", 1.0), (2, "b", None), (2, "c", None), (1, "a", 9.0))
    before = sorted(os.listdir(tmp_path / "log"))
    bad = log.append(b, F.col("x"), F.col("x").isNotNull(), 0.5)
    assert (bad.version, bad.rows, bad.covered, bad.refused) == (None, 3, 1, True)
    assert log.read().count() == 2 and sorted(os.listdir(tmp_path / "log")) == before
    good = log.append(b, F.col("x"), F.col("x").isNotNull(), 0.3)
    assert (good.version, good.rows) == (1, 3) and log.read().count() == 5
    with pytest.raises(ValueError):
        log.append(rows(spark, (None, "a", 1.0)), F.col("x"))
    assert log.read().count() == 5


def test_a_commit_that_came_first_wins_and_the_append_is_done_again(spark, tmp_path, monkeypatch):
    a = rows(spark, (1, "a", 1.0), (2, "a", 1.0))
    one, two = (KeyedLog(spark, str(tmp_path / "log"), ["date", "ticker"], a.schema) for _ in range(2))
    commit, raced = KeyedLog._commit, []

    def late(self, version, name):
        if not raced:
            raced.append(1)
            two.append(rows(spark, (1, "a", 7.0)), F.col("x"))
        return commit(self, version, name)

    monkeypatch.setattr(KeyedLog, "_commit", late)
    got = one.append(a, F.col("x"))
    assert got.version == 1 and got.rows == 1
    assert sorted((r.date, r.x) for r in one.read().collect()) == [(1, 7.0), (2, 1.0)]


def test_stages_drop_what_they_wrote(spark, sf):
    top = shared_dir(spark)
    before = {x for x in os.listdir(top) if x.startswith("plan-")}
    out = queries()["c12_g28_end_to_end_plan"](spark, sf)
    after = {x for x in os.listdir(top) if x.startswith("plan-")} - before
    assert len(after) == 1 and next(iter(after)).startswith("plan-orders") and out.count() > 0
    with pytest.raises(RuntimeError), plan.Stages(spark) as st:
        st.run("plan-x", spark.range(3))
        raise RuntimeError
    assert {x for x in os.listdir(top) if x.startswith("plan-")} - before == after


def test_book_stays_within_its_caps(spark):
    x = spark.createDataFrame([(f"t{i:03}", "S" if i < 30 else f"s{i}", "BUY", 0.0, float(-i)) for i in range(60)] + [("h", "S", "HOLD", 0.10, 1.0), ("o", None, "SELL", 0.2, 0.0), ("p", None, "ADD", 0.07, 5.0)],
                              "ticker string, sector string, action string, cur double, score double")
    t = {r.ticker: r for r in plan.size_book(x, 0.3).collect()}
    assert sum(r.target for r in t.values() if r.sector == "S") <= 0.25 + 1e-9
    assert t["o"].target == 0 and t["h"].target == 0.10 and 0.07 < t["p"].target <= 0.08
    assert sum(r.target > 0 for r in t.values() if r.action == "BUY") == 29  # thirty names in all, one of them held
    assert all(r.target == r.cur for r in plan.size_book(x, 0.0).where("action <> 'SELL'").collect())
