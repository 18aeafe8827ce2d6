"""What is shuffled and read: shared steps must not move all rows again and again."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidemark.operators import ranks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_percentiles_count_values_in_few_steps_only(spark, monkeypatch):
    seen, count = [], ranks.value_counts

    def watched(df, keys, value):
        seen.append(df.count())
        return count(df, keys, value)

    monkeypatch.setattr(ranks, "value_counts", watched)
    x = np.random.default_rng(5).normal(0, 50, 20_000)
    d = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(x)) % 2, "h": np.arange(len(x)) % 3, "x": x}))
    got = {(r["g"], r["h"]): r["m"] for r in ranks.percentiles(d, ["g", "h"], "x", {"m": 0.5}, [["g"], ["h"], []]).collect()}
    assert seen[0] < 3 * len(x) / 20
    s = pd.DataFrame({"g": np.arange(len(x)) % 2, "h": np.arange(len(x)) % 3, "x": x})
    want = {(None, None): s["x"].median(), **{(g, None): v for g, v in s.groupby("g")["x"].median().items()}, **{(None, h): v for h, v in s.groupby("h")["x"].median().items()}}
    assert set(got) == set(want) and all(np.isclose(got[k], v, rtol=1e-12) for k, v in want.items())


def test_outcomes_meet_in_one_exchange_by_ticker(spark, sf):
    from tidemark.plans.timeseries_queries import fwd

    moves = [x for x in plan(fwd(spark, sf, [30])).split("\n") if "Exchange hashpartitioning(ticker#" in x]
    assert sum("date#" not in x for x in moves) == 1 and not any("_side#" in x for x in moves)


def test_categories_move_signals_once(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = plan(queries()["x03_waterfall_categories"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning") == 3  # lines, orders, signals


def test_rank_correlations_rank_rows_once_for_all_columns(spark):
    r = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": r.integers(0, 9, 900).astype(float), "b": r.normal(0, 3, 900), "y": r.normal(0, 9, 900).round(1)})
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::11, "b"] = np.nan
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, y double")
    rho = ranks.spearman_each(d, [], ["a", "b"], "y")
    for row in rho.collect():
        own = pdf[[row["name"], "y"]].dropna()
        assert row["n"] == len(own) and np.isclose(row["rho"], own[row["name"]].rank().corr(own["y"].rank()), atol=1e-12)


def test_decay_reads_the_conviction_of_the_outcome_rows(spark, sf, monkeypatch):
    from tidemark.sources import lens

    calls, signals = [], lens.signals
    monkeypatch.setattr(lens, "signals", lambda *a: calls.append(1) or signals(*a))
    for name in ("v04_ic_decay", "v14_modifier_calibration", "a30_factor_attribution", "t35_k07_post_mortem", "c13_suggested_sizes"):
        calls.clear()
        queries()[name](spark, sf)
        # c13: its rotation of sectors may read signals too
        assert len(calls) <= (2 if name.startswith("c13") else 1), name


def test_books_compute_only_the_factor_they_rank_by(spark, sf):
    from tidemark.plans.book_queries import _books

    c, r = _books(spark, sf)
    assert "stddev_pop" not in plan(c) and "lead(" not in plan(c)


def test_poisson_weights_follow_the_distribution():
    from tidemark.operators import validate

    h = validate._mix(np.arange(200_000, dtype=np.uint64))
    assert (validate._poisson(h) == validate._by_number(h)).all()


def test_headline_pairs_are_judged_where_they_are_found(spark):
    from tidemark.operators import headlines

    r = np.random.default_rng(9)
    text = {k: " ".join(f"w{w}" for w in r.choice(40, r.integers(3, 14), replace=False)) for k in range(300)}
    d = spark.createDataFrame(list(text.items()), "k long, t string")
    sets = headlines.word_sets(d, "k", "t").groupBy("words", "n").agg({"k": "min"}).withColumnRenamed("min(k)", "k").localCheckpoint()
    near = headlines.alike(sets, "k")
    joins = [x for x in plan(near).split("\n") if "Join" in x]
    assert len(joins) == 1 and "array_intersect" in joins[0]  # no pair that is not alike is shuffled
    w = {x["k"]: set(x["words"]) for x in sets.collect()}
    want = {(a, b) for a in w for b in w if a < b and len(w[a] & w[b]) * 10 > min(len(w[a]), len(w[b])) * 6}
    assert {(x["a"], x["b"]) for x in near.collect()} == want and want


def test_short_headlines_make_no_pair_with_every_long_one(spark, monkeypatch):
    from tidemark.operators import headlines

    rows, writes = {}, headlines.written

    def written(df, name):
        out = writes(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    r = np.random.default_rng(6)
    text = {int(k): " ".join(f"w{w}" for w in r.choice(12, 5, replace=False)) if k % 3 == 1 else "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 " + " ".join(f"x{w}" for w in r.choice(900, 25, replace=False)) for k in range(900)}
    monkeypatch.setattr(headlines, "written", written)
    monkeypatch.setattr(headlines, "FIRST", 30, raising=False)
    d = spark.createDataFrame(list(text.items()), "k long, t string")
    assert headlines.keep_first(d, "k", "t").where("kept").count() > 500
    assert sum(rows["headline-pairs"]) < 900  # over 100 000 if a short headline meets every long one


def test_categories_are_summed_inside_the_row(spark, sf):
    p = plan(queries()["x03_waterfall_categories"](spark, sf))
    p = p[p.index("== Initial Plan ==") :] if "== Initial Plan ==" in p else p
    assert "category" not in "".join(x for x in p.split("\n") if "Aggregate(" in x) and p.count("HashAggregate(") == 2  # the winner of a (ticker, day)


def test_outcomes_are_sorted_once_and_move_what_is_used(spark, sf):
    from tidemark.plans.timeseries_queries import fwd

    p = plan(fwd(spark, sf, [7, 30])).split("\n")
    assert sum("Sort [ticker#" in x for x in p) == 1 and sum("Window [" in x and "(ticker#" in x for x in p) == 1
    assert "o_custkey" not in plan(queries()["a30_factor_attribution"](spark, sf))


def test_outcomes_on_and_between_the_days_of_bars(spark):
    from datetime import date

    from tidemark.operators import timeseries as ts

    def day(i):
        return date(2020, 1, i)

    px = spark.createDataFrame([(1, day(3), 10.0), (1, day(5), None), (1, day(7), 12.0), (1, day(9), 15.0), (2, day(5), 7.0)], "ticker long, date date, close double")
    sig = spark.createDataFrame([(1, day(i), i) for i in range(1, 11)] + [(1, day(3), 33), (2, day(5), 2)], "ticker long, date date, okey long")
    bench = px.where("ticker = 1").select("date", "close")
    got = {(r["okey"], r["horizon"]): (r["price"], r["future_price"], r["future_date"]) for r in ts.forward_returns(sig, px, bench, [1, 2]).collect()}
    # none before the first bar, none on a bar without a close or after it until the next, which still counts as a bar
    assert got == {(3, 1): (10.0, None, day(5)), (33, 1): (10.0, None, day(5)), (4, 1): (10.0, 12.0, day(7)), (7, 1): (12.0, 15.0, day(9)),
                   (3, 2): (10.0, 12.0, day(7)), (33, 2): (10.0, 12.0, day(7)), (4, 2): (10.0, 15.0, day(9))}


def test_families_take_one_pass_over_the_outcomes(spark, sf):
    p = plan(queries()["v19_family_analysis"](spark, sf)).split("\n")
    assert sum("FileScan" in x and "o_orderstatus" in x for x in p) == 1


def test_rank_correlations_move_rows_once(spark, monkeypatch):
    plans, write = {}, ranks.written

    def watched(df, name):
        plans[name] = plan(df)
        return write(df, name)

    monkeypatch.setattr(ranks, "written", watched)
    d = spark.range(500).selectExpr("id % 3 AS g", "id % 7 AS a", "cast(id * 37 % 101 AS double) AS y")
    ranks.spearman(d, ["g"], "a", "y").collect()
    p = plans["values"].split("\n")  # the ranked rows, summed per value
    assert sum("Exchange hashpartitioning" in x for x in p) == 2 and sum("Sort [" in x for x in p) == 1


def test_top_rows_are_labelled_where_they_lie(spark, sf):
    from tidemark.plans.outcome_queries import before_cut, top_cut

    assert "row_number" not in plan(queries()["a27_baselines"](spark, sf))
    r = np.random.default_rng(11)
    pdf = pd.DataFrame([(t, pd.Timestamp("2020-01-01") + pd.Timedelta(days=d)) for t in range(30) for d in range(20)], columns=["ticker", "date"])
    pdf["v"] = r.integers(0, 4, len(pdf))
    d = spark.createDataFrame(pdf).withColumns({"date": F.col("date").cast("date")})
    for k in (1, 3, 7, 600, 10_000):
        cut = top_cut(d, "v", k).toDF("v_edge", "v_ticker", "v_date")
        got = d.join(F.broadcast(cut), F.lit(True), "left").where(before_cut("v")).select("ticker", "date").collect()
        want = pdf.sort_values(["v", "ticker", "date"], ascending=[False, True, True]).head(max(1, len(pdf) // k))
        assert {(x["ticker"], x["date"]) for x in got} == {(t, x.date()) for t, x in zip(want["ticker"], want["date"])}


def test_outcomes_of_one_horizon_meet_listings_without_a_sort(spark, sf):
    from tidemark.plans.outcome_queries import fwd_dims

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = plan(fwd_dims(spark, sf, [90])).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Sort [ticker#" in x for x in p) == 2  # signals with bars, listings


def test_outcomes_keep_the_number_of_partitions_they_are_sorted_in(spark, sf):
    from tidemark.plans.timeseries_queries import fwd

    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert any("Exchange hashpartitioning(ticker#" in x and f", {n}), REPARTITION_BY_NUM" in x for x in plan(fwd(spark, sf, [30])).split("\n"))
