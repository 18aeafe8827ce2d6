"""Conversation repair: against SQL (test_text), a brute-force search, and cuts at every size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from check_oracle import compare, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import queries, repair

KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}


def best_edits(turns):
    """(cost, audit, repaired) by trying every edit from the end; turns: (role, text, must go, truncated)."""
    after = {0: (0, "", ()), 3: (0, "", ())}
    role = lambda s: "assistant" if s == 2 else "user"

    def with_inserts(own):
        best = dict(own)
        for _ in range(4):
            for s in range(4):
                if (x := best.get(GIVEN[s])) is not None:
                    c = (x[0] + 2, "I" + x[1], (role(s) + ":", *x[2]))
                    best[s] = min(c, best.get(s, c))
        return best

    after = with_inserts(after)
    for r, t, gone, cut in reversed(turns):
        own = {}
        for s in range(4):
            found = [(after[s][0] + 3, "D" + after[s][1], after[s][2])]
            if not gone:
                if (k := KEPT.get((s, r[:1]))) is not None:
                    found.append((after[k][0] + cut, "K" + after[k][1], (f"{r}:{t}", *after[k][2])))
                g = after[GIVEN[s]]
                found.append((g[0] + 2 + cut, "R" + g[1], (f"{role(s)}:{t}", *g[2])))
            own[s] = min(found)
        after = with_inserts(own)
    return after[0]


def wanted(rows):
    """Contract's columns for rows (conv, turn, role, text) that are damaged already."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1][:32], x[2][:32]))
        seen, marked = set(), []
        for _, r, x in turns:
            shown = x.rstrip(repair.BLANKS)
            blank, again = not shown, bool(shown) and (r, x) in seen
            seen.add((r, x))
            marked.append((r, x, blank, again, not blank and not again and shown[-1] not in ".!?"))
        cost, audit, left = best_edits([(r, x, b or a, c) for r, x, b, a, c in marked])
        own = [t for t, _, _ in turns if t is not None]
        pairs = zip([r[:1] for _, r, _ in turns], [r[:1] for _, r, _ in turns[1:]])
        out[conv] = (max(own) - min(own) + 1 - len(set(own)) if own else 0, sum(m[2] for m in marked), sum(m[3] for m in marked), sum(m[4] for m in marked),
                     sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


KINDS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b", "c?", " ", "d!  ", ""])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(KINDS, st.integers(1, 4))
def test_chunks_with_fix_ups_give_the_least_edits(turns, size):
    """The kernel alone, with the passes of ``run_backward`` done in plain Python."""
    seen, marked = set(), []
    for r, x in turns:
        blank, again = not x.strip(), (r, x) in seen
        seen.add((r, x))
        marked.append((r, x, blank or again, not (blank or again) and x.rstrip()[-1] not in ".!?"))
    kinds = bytes(repair.BLANK if g else repair.kind_of(r[:1], c) for r, _, g, c in marked)
    chunks = [kinds[i : i + size] for i in range(0, len(kinds), size)]
    runs = [[c, repair.END, *(lambda v, n: (v[0], n))(*repair.backward(c, repair.END))] for c in chunks]
    passes = 0
    while stale := [(i, w) for i, w in enumerate([*(r[2] for r in runs[1:]), repair.END][: len(runs)]) if w != runs[i][1]]:
        for i, w in stale:
            runs[i][2], runs[i][3] = repair.again(runs[i][0], runs[i][1], w, runs[i][2], runs[i][3])
            runs[i][1] = w
        passes += 1
        assert passes <= len(chunks)
    state, audit, cost = 0, "", 0
    for i, (c, tail, _, _) in enumerate(runs):
        part, state, spent = repair.trace(c, tail, state, i == len(runs) - 1)
        audit, cost = audit + part, cost + spent
    want = best_edits(marked)
    assert (cost, audit) == want[:2] if turns else (cost, audit) == (0, "")
    if runs:
        assert cost == sum(r[3] for r in runs) + runs[0][2][0]  # the stitched backward costs
        left = repair.apply_edits([{"role": r, "text": x} for r, x, _, _ in marked], audit, 0)
        assert tuple(f"{t['role']}:{t['text']}" for t in left) == want[2]


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, r.choice([turn, turn, turn, None, turn // 2]), r.choice(["system", "user", "user", "assistant", "assistant", None, "x", "", "used"]), r.choice(["one.", "two", "three!", "  ", "", None, f"t{turn}?", "é日 . \n"])))
    rows += [(99, i if i % 7 else None, ["user", "assistant"][i % 2 if i % 11 else 0], f"text {i % 400}" + "." * (i % 5 > 0)) for i in range(900)]  # one conversation of many
    return rows + rows[:20]


@pytest.mark.parametrize("most", [1, 7, 2048])
def test_repair(spark, most):
    rows = conversations(most)
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(3)
    assert found(repair.totals(repair.repair(d, most_rows=most))) == wanted(rows)


def test_equal_rows_of_one_conversation_are_spread(spark):
    rows = [(1, None, "user", "same.")] * 3000 + [(2, 0, "user", "q."), (2, 1, "assistant", "r.")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chunks = repair.cut_into_chunks(d, 500)
    assert chunks.filter("conv_id = 1").select("part").distinct().count() > 1
    got = found(repair.totals(repair.repair(d, 500)))
    assert got == wanted(rows)
    assert got[1][:6] == (0, 0, 2999, 0, 2999, 3 * 2999 + 2)


def test_long_and_empty(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 2_000_000), (1, 2, "user", "z" * 3_000_000), (1, 3, "assistant", "w.")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(repair.totals(repair.repair(d))) == wanted(rows)
    assert repair.totals(repair.repair(d.limit(0))).count() == 0


def test_damage_and_query(spark, sf, tmp_path):
    rows = [(c, t, r, x) for c in [None, *range(60)] for t, (r, x) in enumerate([("user", "Is it. So?"), ("assistant", "Yes!"), ("user", None), (None, "odd."), ("assistant", "End.")])]
    rows += [(777, None, "user", "a."), (3, None, "system", "b?")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
        hurt += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    want = wanted(hurt)
    none = (0, 0, 0, 0, 0, 0, "", brute.sha(""))
    got = queries.op12(spark, str(tmp_path))
    assert found(got) == {c: want.get(c, none) for c, *_ in rows}
    con = duck(sf)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(got.toPandas(), con.execute(queries.OP12_SQL).df()) is None


def test_all_rows_dropped(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(queries.op12(spark, str(tmp_path))) == {gone: (0, 0, 0, 0, 0, 0, "", brute.sha(""))}
    assert queries.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet").withColumn("k", F.lit("clash"))).count() == 0
