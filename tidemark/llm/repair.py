"""Conversation structure repair: least-cost edits by a rank-convergence parallel Viterbi.

A repaired conversation has the roles ``(s?(ua)+)?`` (system, user, assistant by their initials). A walk
over four states (nothing yet, after s, after u, after a) edits the turns in order: Keep costs 0,
Rerole to user or assistant ``REROLE``, Delete ``DELETE``, Insert an empty user or assistant turn ``INSERT``;
a truncated turn that stays costs ``CUT`` more. Blank turns and repetitions have to be deleted. Which role
a rerole or insert gives follows from the state. Of the cheapest edits the ones whose
initials come first in ASCII are taken: with the costs from each turn to the end at hand, the
first edit in the order D, I, K, R that loses nothing is the right one.

Those backward costs are a product of (min, +) matrices, one per turn. A conversation may hold a
third of all rows, so its turns are dealt out in order and cut into chunks (``ROWS`` turns or ``BYTES``):

1. Rows are written, dealt by ranges of (conversation, turn, ...) and sorted; a task cuts them into
   chunks. A conversation inside one task and one chunk is solved on the spot.
2. Chunks of all others start from a speculative cost vector, side by side.
3. Fix-up passes: a chunk whose next chunk gives another vector than it started from, not just
   another constant, is run again from the right one, in step with its old run until the two vectors
   differ by a constant only; from there on the old run stands. Passes end when no
   vector changes; each pass makes at least one more chunk of each conversation final.
4. Each chunk tells for all four states in which state it ends; these small maps are put together, and
   with its real start each chunk writes down its least edits.

Repetitions across tasks: each task reports the digests it meets first, the smallest task
keeps one, the others mark it. Between passes chunks are written to the shared folder, so a lost
executor costs a re-read. ``repair`` returns chunks, so no task holds a whole conversation; ``totals``
streams over them (a digest of a whole conversation is sequential).

Order of turns: by turn (NULL first); of one turn by the first 32 characters of the role and of the text, then by a
digest of both; what is left are equal rows. Defined results: NULL role or text counts as one blank;
rows with a NULL conv_id form one conversation; repeated rows are repetitions; an empty table gives
no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import to_arrow
from tidemark.session import written

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
ROWS, BYTES = 2048, 4 << 20
#: Input bytes of a range of turns.
RANGE = 64 << 20

#: State after keeping a turn of that initial; after an inserted or reroled one (its role: see ``given_role``).
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
GIVEN = (2, 2, 3, 2)
Vector = tuple[int, int, int, int]
#: Costs from each state when no turn is left: inserts up to the end of a pair.
END: Vector = (0, 2 * INSERT, INSERT, 0)
MUST_GO = 0

KEYS = "conv_id long, part int, no int"
FACTS = "first_turn long, last_turn long, turns int, first_initial string, last_initial string, illegal int"
CHUNKS = f"{KEYS}, alone boolean, kinds binary, digests binary, rows array<struct<role:string,text:string>>, {FACTS}"
RUNS = f"{KEYS}, kinds binary, tail array<int>, head array<int>, cost long"
PIECES = f"{KEYS}, audit string, turns_left array<struct<role:string,text:string>>, cost long, blank int, duplicate int, truncated int, {FACTS}"
TOTALS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
KEY, FACT = (["conv_id", "part", "no"], [x.split()[0] for x in FACTS.split(", ")])

# kinds of a turn: 0 blank, 1 repeated; else 2 + 2 * number of the initial + truncated
BLANK, REPEATED = 0, 1


def kind_of(initial: str, truncated: bool) -> int:
    return 2 + 2 * ("sua".find(initial) if initial and initial in "sua" else 3) + truncated


def given_role(state: int) -> str:
    return "assistant" if state == 2 else "user"


def _shift(v: list[int]) -> tuple[Vector, int]:
    low = min(v)
    return tuple(x - low for x in v), low


@cache
def step(kind: int, after: Vector) -> tuple[Vector, int]:
    """Costs from each state before a turn of that kind, given those after it; shifted so that the least is 0."""
    letter, cut = ("sua?"[(kind - 2) // 2], (kind - 2) % 2 * CUT) if kind > REPEATED else ("", 0)
    own = []
    for s in range(4):
        costs = [DELETE + after[s]]
        if kind > REPEATED:
            costs.append(REROLE + cut + after[GIVEN[s]])
            if letter in KEPT and KEPT[letter][s] is not None:
                costs.append(cut + after[KEPT[letter][s]])
        own.append(min(costs))
    return _shift([min(own[s], INSERT + own[GIVEN[s]], 2 * INSERT + own[GIVEN[GIVEN[s]]]) for s in range(4)])


@cache
def edits(kind: int, after: Vector, state: int) -> tuple[str, int, int]:
    """The least edits at a turn from a state: initials (inserts come before the turn's own), the next
    state, what they cost."""
    before, low = step(kind, after)
    letter, cut = ("sua?"[(kind - 2) // 2], (kind - 2) % 2 * CUT) if kind > REPEATED else ("", 0)
    done, spent = "", 0
    while True:
        left = before[state] + low
        if DELETE + after[state] == left:
            return done + "D", state, spent + DELETE
        if INSERT + before[GIVEN[state]] + low == left:
            done, state, spent = done + "I", GIVEN[state], spent + INSERT
            continue
        if letter in KEPT and (to := KEPT[letter][state]) is not None and cut + after[to] == left:
            return done + "K", to, spent + cut
        return done + "R", GIVEN[state], spent + REROLE + cut


def backward(kinds: bytes, tail: Vector) -> tuple[list[Vector], int]:
    """Vectors after each turn (the last is ``tail``) with the one before the first turn in front; the sum of
    the shifts."""
    vectors, v, cost = [tail], tail, 0
    for k in reversed(kinds):
        v, low = step(k, v)
        cost += low
        vectors.append(v)
    return vectors[::-1], cost


def again(kinds: bytes, old: Vector, new: Vector, head: Vector, cost: int) -> tuple[Vector, int]:
    """The run of a chunk from ``new`` instead of ``old``: both in step until they are equal."""
    for k in reversed(kinds):
        if old == new:
            return head, cost
        (old, a), (new, b) = step(k, old), step(k, new)
        cost += b - a
    return new, cost


def trace(kinds: bytes, tail: Vector, state: int, last: bool) -> tuple[str, int, int]:
    """Initials of the least edits of a chunk from a state, the state behind them, what they cost."""
    vectors, _ = backward(kinds, tail)
    parts, cost = [], 0
    for k, after in zip(kinds, vectors[1:]):
        done, state, spent = edits(k, after, state)
        parts.append(done)
        cost += spent
    while last and END[state]:
        parts.append("I")
        state, cost = GIVEN[state], cost + INSERT
    return "".join(parts), state, cost


def apply_edits(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The turns that the edits leave or make."""
    out, given = [], iter(rows)
    for e in audit:
        if e == "I":
            out.append({"role": given_role(state), "text": ""})
            state = GIVEN[state]
            continue
        r = next(given)
        if e == "K":
            out.append(r)
            state = KEPT[r["role"][0]][state]
        elif e == "R":
            out.append({"role": given_role(state), "text": r["text"]})
            state = GIVEN[state]
    return out


class Cutter:
    """Cuts the sorted turns of one task into chunks."""

    def __init__(self, part: int, most_rows: int):
        self.part, self.most = part, most_rows
        self.conv, self.begun, self.first_conv, self.no, self.seen = None, False, True, 0, set()
        self._empty()

    def _empty(self) -> None:
        self.rows, self.kinds, self.digests, self.size = [], bytearray(), [], 0
        self.turns, self.first_turn, self.last_turn, self.illegal, self.initials = 0, None, None, 0, []

    def add(self, conv: int | None, turn: int | None, role: str, text: str) -> list[dict]:
        out = []
        if self.begun and conv != self.conv:
            out.append(self.chunk(open_right=False))
            self.no, self.seen, self.first_conv = 0, set(), False
        elif len(self.rows) >= self.most or self.size >= BYTES:
            out.append(self.chunk(open_right=True))
            self.no += 1
        self.begun, self.conv = True, conv
        visible, initial = text.rstrip(BLANKS), role[:1]
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        kind = BLANK if not visible else REPEATED if digest in self.seen else kind_of(initial, visible[-1] not in ENDINGS)
        if kind > REPEATED:
            self.seen.add(digest)
        if self.initials:
            self.illegal += self.initials[-1] + initial not in LEGAL
        self.initials = [*self.initials[:1], initial]
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.rows.append({"role": role, "text": text})
        self.kinds.append(kind)
        self.digests.append(digest)
        self.size += len(text)
        return out

    def chunk(self, open_right: bool) -> dict:
        alone = not (open_right or self.no or self.first_conv and self.part)
        row = {"conv_id": self.conv, "part": self.part, "no": self.no, "alone": alone, "kinds": bytes(self.kinds), "digests": b"" if alone else b"".join(self.digests), "rows": self.rows}
        row |= dict(zip(FACT, (self.first_turn, self.last_turn, self.turns, self.initials[0], self.initials[-1], self.illegal)))
        self._empty()
        return row


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _each(df: DataFrame, work, ddl: str) -> DataFrame:
    """``work`` on each row (a chunk), one row out, a few MB at a time."""
    schema = to_arrow(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = 1 + BYTES // (1 + b.nbytes // max(1, b.num_rows))
            for lo in range(0, b.num_rows, many):
                yield _table([work(r) for r in b.slice(lo, many).to_pylist()], schema)

    return df.mapInArrow(task, ddl)


def cut_into_chunks(rows: DataFrame, most_rows: int = ROWS) -> DataFrame:
    """Chunks of turns, in order of (part, no) inside a conversation."""
    spark = rows.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = written(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role"), empty("text")), "turns")
    size = given.agg(F.sum(F.octet_length("text") + F.octet_length("role"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + int(size) // RANGE)
    # the number of the row parts equal rows, which may be many; the rows are read from files, so it is the same each time
    order = given.withColumns({"k1": F.left("role", F.lit(32)), "k2": F.left("text", F.lit(32)), "k3": F.xxhash64("role", "text"), "k4": F.monotonically_increasing_id()})
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "k1", "k2", "k3", "k4")]
    schema = to_arrow(CHUNKS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, out, size = Cutter(TaskContext.get().partitionId(), most_rows), [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                out += cutter.add(*row)
                size += len(row[3])
                if size >= BYTES and out:
                    yield _table(out, schema)
                    out, size = [], 0
        if cutter.begun:
            out.append(cutter.chunk(open_right=True))
        if out:
            yield _table(out, schema)

    return order.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text").mapInArrow(task, CHUNKS)


def _mark_repeated(chunks: DataFrame) -> DataFrame:
    """``conv_id, part, no, kinds`` of open chunks, with the repetitions of turns that an earlier task has."""
    schema = to_arrow(f"{KEYS}, at int, digest binary")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = [i for i, k in enumerate(r["kinds"]) if k > REPEATED]
                yield _table([{**{k: r[k] for k in KEY}, "at": i, "digest": r["digests"][16 * i : 16 * i + 16]} for i in own], schema)

    # a task reports a digest once, so a group has at most as many rows as there are tasks
    met = chunks.select(*KEY, "kinds", "digests").mapInArrow(firsts, f"{KEYS}, at int, digest binary")
    places = met.groupBy("conv_id", "digest").agg(F.array_sort(F.collect_list(F.struct("part", "no", "at"))).alias("p")).filter(F.size("p") > 1)
    late = places.select("conv_id", F.explode(F.slice("p", 2, F.size("p"))).alias("p")).groupBy(F.col("conv_id").alias("c"), F.col("p.part").alias("q"), F.col("p.no").alias("m")).agg(F.collect_list("p.at").alias("late"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("q")) & (F.col("no") == F.col("m"))

    def mark(r: dict) -> dict:
        kinds = bytearray(r["kinds"])
        for i in r["late"] or []:
            kinds[i] = REPEATED
        return {**{k: r[k] for k in KEY}, "kinds": bytes(kinds)}

    return _each(chunks.select(*KEY, "kinds").join(late, same, "left").select(*KEY, "kinds", "late"), mark, f"{KEYS}, kinds binary")


def run_backward(kinds: DataFrame) -> DataFrame:
    """``RUNS`` of all chunks with their final vectors: speculative runs, then fix-up passes."""

    def speculate(r: dict) -> dict:
        vectors, cost = backward(r["kinds"], END)
        return {**r, "tail": list(END), "head": list(vectors[0]), "cost": cost}

    def fix(r: dict) -> dict:
        if r["want"] == r["tail"]:
            return {k: r[k] for k in (*KEY, "kinds", "tail", "head", "cost")}
        head, cost = again(r["kinds"], tuple(r["tail"]), tuple(r["want"]), tuple(r["head"]), r["cost"])
        return {**{k: r[k] for k in (*KEY, "kinds")}, "tail": r["want"], "head": list(head), "cost": cost}

    runs = written(_each(kinds, speculate, RUNS), "viterbi")
    w = Window.partitionBy("conv_id").orderBy("part", "no")  # one small row for each ``ROWS`` turns
    while True:
        wanted = written(runs.withColumn("want", F.coalesce(F.lead("head").over(w), F.array(*map(F.lit, END)))), "wanted")
        if wanted.filter("want != tail").isEmpty():
            return runs
        runs = written(_each(wanted, fix, RUNS), "viterbi")


def _starts(to: DataFrame) -> DataFrame:
    """Where each chunk starts (``start``, and whether it is the ``last``), from the ``ends`` of those before it: four
    numbers for each ``ROWS`` turns pass by, one conversation after the other."""
    ddl = "c long, q int, m int, start int, last boolean"
    schema = to_arrow(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                same = held is not None and held["c"] == r["conv_id"]
                if held is not None:
                    out.append({**held, "last": not same})
                state = state if same else 0
                held = {"c": r["conv_id"], "q": r["part"], "m": r["no"], "start": state}
                state = r["ends"][state]
            yield _table(out, schema)
        if held is not None:
            yield _table([{**held, "last": True}], schema)

    return to.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(task, ddl)


def repair(rows: DataFrame, most_rows: int = ROWS) -> DataFrame:
    """One row per chunk of a conversation, in order of (``part``, ``no``): ``audit`` (initials of the edits), ``turns_left`` (the
    repaired turns), what they cost, faults and facts of the chunk. ``rows``: conv_id, turn, role, text."""
    chunks = written(cut_into_chunks(rows, most_rows), "chunks")
    several = chunks.filter("not alone")
    runs = run_backward(written(_mark_repeated(several), "kinds"))

    def ends(r: dict) -> dict:
        return {**{k: r[k] for k in KEY}, "ends": [trace(r["kinds"], tuple(r["tail"]), s, False)[1] for s in range(4)]}

    to = _each(runs.select(*KEY, "kinds", "tail"), ends, f"{KEYS}, ends array<int>")
    starts = _starts(to)

    def write_down(r: dict) -> dict:
        start, kinds = r.get("start", 0), r["kinds"]
        audit, _, cost = trace(kinds, tuple(r.get("tail", END)), start, r.get("last", True))
        counts = {"blank": kinds.count(BLANK), "duplicate": kinds.count(REPEATED), "truncated": sum(k > REPEATED and k % 2 for k in kinds)}
        return {k: r[k] for k in (*KEY, *FACT)} | {"audit": audit, "turns_left": apply_edits(r["rows"], audit, start), "cost": cost} | counts

    whole = _each(chunks.filter("alone").select(*KEY, "kinds", "rows", *FACT), write_down, PIECES)
    same = lambda a, b: a["conv_id"].eqNullSafe(b["c"]) & (a["part"] == b["q"]) & (a["no"] == b["m"])
    found = runs.select(*KEY, "kinds", "tail")
    found = found.join(starts, same(found, starts)).select(F.col("conv_id").alias("c"), F.col("part").alias("q"), F.col("no").alias("m"), "kinds", "tail", "start", "last")
    texts = several.select(*KEY, "rows", *FACT)
    parts = _each(texts.join(found, same(texts, found)).select(*KEY, "kinds", "tail", "start", "last", "rows", *FACT), write_down, PIECES)
    return whole.unionByName(parts)


class Totals:
    """Sums over the pieces of one conversation, in order."""

    def __init__(self, conv: int | None):
        self.conv, self.sums, self.audit, self.sha = conv, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), [], hashlib.sha256()
        self.turns, self.first, self.last, self.initial, self.any = 0, None, None, None, False

    def add(self, r: dict) -> None:
        for k in self.sums:
            self.sums[k] += r[k]
        if self.initial is not None:
            self.sums["illegal"] += self.initial + r["first_initial"] not in LEGAL
        self.initial = r["last_initial"]
        if r["turns"]:
            self.turns += r["turns"] - (r["first_turn"] == self.last)
            self.first = r["first_turn"] if self.first is None else self.first
            self.last = r["last_turn"]
        self.audit.append(r["audit"])
        for t in r["turns_left"]:
            self.sha.update(("\n" * self.any + t["role"] + ":" + t["text"]).encode())
            self.any = True

    def row(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.sums, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def totals(pieces: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of the repaired turns (``role:text``, joined by
    line feeds). A conversation's pieces pass one task, one piece in memory at a time, as a digest needs them in order."""
    schema = to_arrow(TOTALS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if now is None or now.conv != r["conv_id"]:
                    out += [now.row()] if now else []
                    now = Totals(r["conv_id"])
                now.add(r)
            if out:
                yield _table(out, schema)
                out = []
        if now:
            yield _table([now.row()], schema)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(task, TOTALS)
