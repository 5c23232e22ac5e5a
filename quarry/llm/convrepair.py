"""Conversation structure repair: the cheapest edits that turn a damaged conversation into legal turns.

A conversation's rows are taken by turn (nulls first, then by role and text). A row's first fault counts: blank (no
character but white space), duplicate (role and text stood in an earlier row), truncated (its last character but white
space ends no sentence). Edits: keep costs 0, give it the role user or assistant (rerole) 1, delete 2, insert an empty turn
5; blank and duplicate rows must be deleted, truncated ones that stay cost 5 more. The roles' initials have to become
``(s?(ua)+)?``; of equally cheap edits the ASCII-least string of initials (D, I, K, R) is taken.

The method is a dynamic program over four grammar states (nothing yet, behind a system turn, behind user, behind
assistant), held as time-major NumPy tensors: conversations of about one length form a bucket, all of a bucket's state costs
are updated turn by turn from the last to the first, these backward costs are kept, and the edits of all conversations are
then traced forwards, again turn by turn.

Spark deals conversations out by id, sorted by turn; a task streams them and holds at most about BATCH_ROWS rows or
BATCH_BYTES of texts and the costs of these. A conversation of more than LONG_ROWS rows or LONG_BYTES of texts goes another
way, with the same result: its rows get positions by a range sort, pieces of PIECE rows are turned into four by four
min-plus matrices by separate tasks, the matrices of one conversation are chained, and each piece is traced from the state
and costs at its ends. Its repaired text is hashed as a stream, for a hash knows only one order; nothing holds it whole.

Nulls and odd cases: a null role or text is one space (so the text is blank); a null id is a conversation of its own; roles of
other initials, and empty ones, can only be reroled or deleted; a conversation all of whose rows are absent has zeros, an
empty audit and the hash of the empty text; rows that repeat are duplicates; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, release, store
from quarry.operators.positions import positions

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
BATCH_ROWS, BATCH_BYTES = 1 << 15, 1 << 23
LONG_ROWS, LONG_BYTES = 20_000, 1 << 25
PIECE = 4096
#: What may end a sentence, and white space (fixed values).
ENDS, WHITE = ".!?", " \t\n\x0b\x0c\r"

# Grammar states, and the one behind the next user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
NAME = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
# Classes of roles: the state that a kept row leads to, by state and initial (s, u, a, other); -1: can't be kept there.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
OTHER = 3
# A row's code: its role's class, plus 4 if it must be deleted, plus 8 if it is truncated; PAD: no row.
MUST, SHORT, PAD = 4, 8, 16
RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def initial_class(role: np.ndarray) -> np.ndarray:
    """Class of each first character (0: none)."""
    out = np.full(len(role), OTHER, np.uint8)
    for i, c in enumerate(b"sua"):
        out[role == c] = i
    return out


def relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs (n, 4) from each state, when empty turns may be inserted first."""
    user, assistant = cost[:, USER], cost[:, ASSISTANT]
    out = cost.copy()
    out[:, USER] = np.minimum(user, INSERT + assistant)
    out[:, ASSISTANT] = np.minimum(assistant, INSERT + user)
    out[:, START] = np.minimum(cost[:, START], INSERT + out[:, USER])
    out[:, SYSTEM] = np.minimum(cost[:, SYSTEM], INSERT + out[:, USER])
    return out


def final_costs(n: int) -> np.ndarray:
    """Costs behind the last row: nothing, or an assistant's turn, may end a conversation."""
    cost = np.full((n, 4), FAR, np.int64)
    cost[:, [START, ASSISTANT]] = 0
    return relaxed(cost)


def row_options(after: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (n, 4) of deleting, keeping and reroling a row of each conversation, by the state before it."""
    stays = np.where(code & MUST, FAR, np.where(code & SHORT, CUT_OFF, 0))[:, None]
    to = KEPT[:, code & 3].T
    keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1) + KEEP, FAR) + stays
    return after + DELETE, keep, after[:, NEXT] + REROLE + stays


def backward(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Costs (T + 1, n, 4) before each row and behind the last, of conversations codes (T, n), padded at the end."""
    cost = np.empty((len(codes) + 1, *last.shape), np.int64)
    cost[-1] = last
    for t in range(len(codes) - 1, -1, -1):
        best = relaxed(np.minimum.reduce(row_options(cost[t + 1], codes[t])))
        cost[t] = np.where((codes[t] == PAD)[:, None], cost[t + 1], best)
    return cost


def trace(codes: np.ndarray, cost: np.ndarray, state: np.ndarray, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edits: (conversation, row, letter, state behind it) in order of conversation and edit; and the last states.

    ends: empty turns may follow the last row, too."""
    n, state = codes.shape[1], state.copy()
    every = np.arange(n)
    noted: list[tuple[np.ndarray, int, int, np.ndarray]] = []

    def note(mask: np.ndarray, t: int, letter: str) -> None:
        at = np.flatnonzero(mask)
        if len(at):
            noted.append((at, t, ord(letter), state[at]))

    for t in range(len(codes)):
        drop, keep, _ = row_options(cost[t + 1], codes[t])
        open_ = codes[t] != PAD
        while open_.any():
            here = cost[t][every, state]
            dropped = open_ & (drop[every, state] == here)
            inserted = open_ & ~dropped & (INSERT + cost[t][every, NEXT[state]] == here)
            stays = open_ & ~dropped & ~inserted
            kept = stays & (keep[every, state] == here)
            changed = stays & ~kept
            state = np.where(kept, KEPT[state, codes[t] & 3], np.where(changed | inserted, NEXT[state], state))
            for mask, letter in ((dropped, "D"), (inserted, "I"), (kept, "K"), (changed, "R")):
                note(mask, t, letter)
            open_ = inserted
    while ends and (inserted := (state == SYSTEM) | (state == USER)).any():
        state = np.where(inserted, NEXT[state], state)
        note(inserted, len(codes), "I")
    if not noted:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint8), none, state
    who = np.concatenate([x[0] for x in noted])
    order = np.argsort(who, kind="stable")
    at = np.concatenate([np.full(len(x[0]), x[1]) for x in noted])[order]
    what = np.concatenate([np.full(len(x[0]), x[2], np.uint8) for x in noted])[order]
    return who[order], at, what, np.concatenate([x[3] for x in noted])[order], state


def solve(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(cost, edits as (row, letter, state)) of conversations whose rows' codes are codes[first[i]:first[i + 1]].

    Conversations go by buckets of lengths within a power of two, each a time-major tensor."""
    size = np.diff(first)
    cost, edits = np.zeros(len(size), np.int64), [None] * len(size)
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        longest = int(size[own].max())
        t = np.arange(longest)[:, None]
        tensor = np.where(t < size[own], codes[np.minimum(first[own] + t, max(len(codes) - 1, 0))] if len(codes) else PAD, PAD).astype(np.uint8)
        costs = backward(tensor, final_costs(len(own)))
        who, at, what, state, _ = trace(tensor, costs, np.full(len(own), START))
        cost[own] = costs[0][:, START]
        cut = np.searchsorted(who, np.arange(len(own) + 1))
        for i, c in enumerate(own):
            part = slice(cut[i], cut[i + 1])
            edits[c] = (at[part], what[part], state[part])
    return cost, edits


def turn_lines(edits: tuple[np.ndarray, np.ndarray, np.ndarray], roles: list[str], texts: list[str]) -> Iterator[str]:
    """The repaired turns, role:text."""
    for row, letter, state in zip(*(x.tolist() for x in edits), strict=True):
        if letter == 73:  # I
            yield f"{NAME[state]}:"
        elif letter != 68:  # D
            yield f"{roles[row] if letter == 75 else NAME[state]}:{texts[row]}"


def changes(ids: pa.Array) -> np.ndarray:
    """True where an id differs from the one before it; nulls are alike."""
    a, b = ids[:-1], ids[1:]
    alike = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.r_[True, ~np.asarray(alike)]


def repaired_batch(t: pa.Table) -> tuple[pa.Array, list[list]]:
    """(ids, the other columns of RESULT, and last the repaired turns) of whole conversations, sorted."""
    ids = t.column("conv_id").combine_chunks()
    new = changes(ids)
    here = np.asarray(t.column("present"))
    conv = (np.cumsum(new) - 1)[here]
    n = int(new.sum())
    rows = t.filter(pa.array(here))
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    blank, short = np.asarray(rows.column("blank")), np.asarray(rows.column("short"))
    again = np.zeros(len(roles), bool)
    seen: set[tuple[str, str]] = set()
    last = -1
    for i, (c, key) in enumerate(zip(conv.tolist(), zip(roles, texts, strict=True), strict=True)):
        if c != last:
            seen, last = set(), c
        if not blank[i]:
            again[i] = key in seen
        seen.add(key)
    short &= ~blank & ~again
    role = initial_class(np.array([ord(r[0]) if r else 0 for r in roles], np.int64))
    codes = role | np.where(blank | again, MUST, 0).astype(np.uint8) | np.where(short, SHORT, 0).astype(np.uint8)
    first = np.searchsorted(conv, np.arange(n + 1))
    count = lambda mask: np.bincount(conv[mask], minlength=n)
    pairs = np.flatnonzero(conv[1:] == conv[:-1])
    legal = LEGAL[role[pairs], role[pairs + 1]]
    illegal = np.bincount(conv[pairs[~legal]], minlength=n)
    turns = rows.column("turn").combine_chunks()
    known = np.asarray(turns.is_valid())
    number, whose = np.asarray(turns.drop_null()).astype(np.int64), conv[known]
    gaps = np.zeros(n, np.int64)
    if len(number):
        starts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
        distinct = np.add.reduceat(np.r_[True, (whose[1:] != whose[:-1]) | (number[1:] != number[:-1])].astype(np.int64), starts)
        gaps[whose[starts]] = number[np.r_[starts[1:] - 1, len(number) - 1]] - number[starts] + 1 - distinct
    cost, edits = solve(codes, first)
    audit = [e[1].tobytes().decode() for e in edits]
    lines = ["\n".join(turn_lines(e, roles[a:b], texts[a:b])) for e, a, b in zip(edits, first[:-1], first[1:], strict=True)]
    return ids.filter(pa.array(new)), [gaps, count(blank), count(again), count(short), illegal, cost, audit, lines]


LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au


def whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end with a conversation, of about BATCH_ROWS rows or BATCH_BYTES."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
            if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                t = pa.Table.from_batches(held)
                last = int(np.flatnonzero(changes(t.column("conv_id").combine_chunks()))[-1])
                if last:
                    yield t.slice(0, last)
                    held = t.slice(last).combine_chunks().to_batches()
                    rows, size = t.num_rows - last, sum(x.nbytes for x in held)
                    release()
    if held:
        yield pa.Table.from_batches(held)


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _read(rows: DataFrame, id_col: str) -> DataFrame:
    """conv_id, turn, role, text, present, blank, short of every row."""
    some = rows.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    out = rows.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), (F.col("present") if "present" in some else F.lit(True)).alias("present"))
    bare = F.rtrim("text", F.lit(WHITE))
    return out.withColumn("blank", bare == "").withColumn("short", ~F.substring(bare, -1, 1).isin(*ENDS))


def repair(rows: DataFrame, id_col: str = "conv_id", turns: bool = False) -> DataFrame:
    """The columns of RESULT for each id of rows (id, turn, role, text); turns: also the repaired turns as one text.

    A boolean column present, if there is one, tells rows that are there from those that only make a conversation known."""
    spark = rows.sparkSession
    data = _read(rows, id_col)
    kind = data.schema["conv_id"].dataType.simpleString()
    sizes = data.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = store(sizes.where((F.col("n") > LONG_ROWS) | (F.col("size") > LONG_BYTES)).select(F.col("conv_id").alias("long_id")), "long-conversations")
    n = long.limit(BROADCAST_ROWS + 1).count()
    ids = F.broadcast(long) if n <= BROADCAST_ROWS else long
    is_long = data["conv_id"].eqNullSafe(ids["long_id"])
    usual = data.join(ids, is_long, "left_anti") if n else data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_conversations(batches):
            found, (*numbers, audit, lines) = repaired_batch(t)
            hashes = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
            columns = [found, *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(audit, pa.string()), pa.array(hashes, pa.string()), *([pa.array(lines, pa.string())] if turns else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = RESULT.format(kind) + (", repaired string" if turns else "")
    names = [x.split()[0] for x in schema.split(", ")]
    dealt = usual.repartition(F.col("conv_id")).sortWithinPartitions(*_order())
    out = dealt.mapInArrow(run, schema)
    if n:
        out = out.unionByName(_repair_long(data.join(ids, is_long, "left_semi"), schema, turns))
    return out.withColumnRenamed("conv_id", id_col)


def _piece_matrix(codes: np.ndarray) -> np.ndarray:
    """(4, 4) least costs from a state before the piece to a state behind it; empty turns before rows only."""
    last = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    return backward(np.repeat(codes[:, None], 4, 1), last)[0].T


def _pieces(fn, schema: str):  # noqa: ANN001, ANN202
    """A function for mapInArrow that gives a row for each row of pieces."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = list(zip(*(fn(r) for r in batch.to_pylist()), strict=True)) if batch.num_rows else []
            made = [pa.array(list(x)) for x in more]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), *made], names=names)

    return run


def _chained_costs(t: pa.Table) -> pa.Table:
    """The costs behind each piece of a conversation: those of the next piece's start."""
    t = t.sort_by("piece")
    m = np.array(t.column("matrix").to_pylist(), np.int64).reshape(-1, 4, 4)
    behind = np.empty((len(m), 4), np.int64)
    cost = final_costs(1)[0]
    for i in range(len(m) - 1, -1, -1):
        behind[i] = cost
        cost = np.minimum((m[i] + cost).min(axis=1), FAR)
    return pa.table([t.column("conv_id"), t.column("piece"), pa.array(behind.tolist(), pa.list_(pa.int64())), pa.array(np.full(len(m), cost[START]))], ["conv_id", "piece", "behind", "cost"])


def _chained_states(t: pa.Table) -> pa.Table:
    """The state before each piece of a conversation."""
    t = t.sort_by("piece")
    state, out = START, []
    for to in t.column("exits").to_pylist():
        out.append(state)
        state = to[state]
    return pa.table([t.column("conv_id"), t.column("piece"), pa.array(out, pa.int64())], ["conv_id", "piece", "entry"])


def _traces(r: dict) -> tuple[list[int], list[str]]:
    """From each state before the piece: the state behind it, and the edits' letters."""
    codes = np.frombuffer(r["codes"], np.uint8)
    four = np.repeat(codes[:, None], 4, 1)
    costs = backward(four, np.repeat(np.array([r["behind"]], np.int64), 4, 0))
    who, _, what, _, state = trace(four, costs, np.arange(4), ends=r["final"])
    cut = np.searchsorted(who, np.arange(5))
    return state.tolist(), [what[a:b].tobytes().decode() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _repair_long(data: DataFrame, schema: str, turns: bool) -> DataFrame:
    """The result for long conversations: no task holds more than a piece's rows, but for a byte or two of each."""
    kind = data.schema["conv_id"].dataType.simpleString()
    known = data.groupBy("conv_id").agg(F.count_if("present").alias("rows"))
    at = positions(data.where("present"), ["conv_id"], _order()[1:], "pos")
    rows = store(at.withColumn("digest", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256))), "long-rows")
    firsts = rows.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("leads"))
    r = rows.alias("r").join(firsts.alias("f"), F.expr("r.conv_id <=> f.conv_id and r.pos = f.pos"), "left").select("r.*", F.col("f.leads").isNull().alias("again"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    must = F.col("blank") | F.col("again")
    code = role + F.when(must, MUST).when(F.col("short"), SHORT).otherwise(0)
    r = store(r.withColumn("code", code).withColumn("piece", F.floor(F.col("pos") / PIECE)).drop("digest", "present"), "long-codes")
    listed = F.array_sort(F.collect_list(F.struct("pos", "code")))
    one = F.unhex(F.array_join(F.transform(listed, lambda x: F.lpad(F.hex(x["code"]), 2, "0")), ""))
    pieces = store(r.groupBy("conv_id", "piece").agg(one.alias("codes")), "long-pieces")
    head = f"conv_id {kind}, piece long"
    matrices = pieces.mapInArrow(_pieces(lambda x: (_piece_matrix(np.frombuffer(x["codes"], np.uint8)).ravel().tolist(),), m := f"{head}, matrix array<long>"), m)
    behind = store(matrices.groupBy("conv_id").applyInArrow(_chained_costs, f"{head}, behind array<long>, cost long"), "long-costs")
    ends = pieces.groupBy("conv_id").agg(F.max("piece").alias("top"))
    full = pieces.alias("p").join(behind.alias("b"), F.expr("p.conv_id <=> b.conv_id and p.piece = b.piece")).join(ends.alias("e"), F.expr("p.conv_id <=> e.conv_id")).select("p.conv_id", "p.piece", "p.codes", "b.behind", (F.col("p.piece") == F.col("e.top")).alias("final"))
    traced = store(full.mapInArrow(_pieces(_traces, m := f"{head}, exits array<long>, audits array<string>"), m), "long-traces")
    entry = traced.groupBy("conv_id").applyInArrow(_chained_states, f"{head}, entry long")
    chosen = traced.alias("t").join(entry.alias("e"), F.expr("t.conv_id <=> e.conv_id and t.piece = e.piece")).join(behind.alias("b"), F.expr("t.conv_id <=> b.conv_id and t.piece = b.piece")).select("t.conv_id", "t.piece", F.lit(-1).cast("long").alias("pos"), F.element_at("t.audits", (F.col("e.entry") + 1).cast("int")).alias("audit"), "b.cost")
    none = known.select("conv_id", F.lit(-1).cast("long").alias("piece"), F.lit(-1).cast("long").alias("pos"))
    stream = none.unionByName(chosen, allowMissingColumns=True).unionByName(r.select("conv_id", "piece", "pos", "turn", "role", "text", "blank", "again", "short", "code"), allowMissingColumns=True)
    dealt = stream.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "piece", "pos")
    return dealt.mapInArrow(_streamed(schema, turns), schema)


class _Stream:
    """What is known of one long conversation so far: counts, the edits still to be made, and the running hash."""

    def __init__(self, conv_id: object, turns: bool) -> None:
        self.id, self.hash, self.empty, self.cost = conv_id, hashlib.sha256(), True, 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        self.low = self.high = self.role = None
        self.state, self.audits, self.left, self.at, self.kept = START, [], "", 0, [] if turns else None

    def say(self, line: str) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.hash.update(line.encode())
        self.empty = False
        if self.kept is not None:
            self.kept.append(line)

    def inserts(self) -> None:
        while self.left[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = int(NEXT[self.state])
            self.say(f"{NAME[self.state]}:")

    def piece(self, audit: str, cost: int) -> None:
        self.audits.append(audit)
        self.left, self.at, self.cost = audit, 0, cost

    def row(self, x: dict) -> None:
        c, code = self.counts, x["code"]
        again, role = x["again"] and not x["blank"], code & 3
        c["blank"] += x["blank"]
        c["duplicate"] += again
        c["truncated"] += bool(code & SHORT)
        if self.role is not None:
            c["illegal"] += not LEGAL[self.role, role]
        self.role = role
        if x["turn"] is not None:
            c["distinct"] += x["turn"] != self.high
            self.low, self.high = x["turn"] if self.low is None else self.low, x["turn"]
        self.inserts()
        letter = self.left[self.at]
        self.at += 1
        if letter == "K":
            self.state = int(KEPT[self.state, role])
            self.say(f"{x['role']}:{x['text']}")
        elif letter == "R":
            self.state = int(NEXT[self.state])
            self.say(f"{NAME[self.state]}:{x['text']}")

    def result(self) -> list:
        self.inserts()
        c = self.counts
        gaps = 0 if self.low is None else self.high - self.low + 1 - c["distinct"]
        return [self.id, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost, "".join(self.audits), self.hash.hexdigest(), *([] if self.kept is None else ["\n".join(self.kept)])]


def _streamed(schema: str, turns: bool):  # noqa: ANN202
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Stream | None = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[i]) for i, v in enumerate(now.result())], names=names)

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, *[pa.string()] * (len(names) - 7)]
            for a in range(0, batch.num_rows, 256):
                for x in batch.slice(a, 256).to_pylist():
                    if x["piece"] < 0:
                        if now:
                            yield done()
                        now = _Stream(x["conv_id"], turns)
                    elif x["pos"] < 0:
                        now.piece(x["audit"], x["cost"])
                    else:
                        now.row(x)
        if now:
            yield done()

    return run


def damaged(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """rows as they are after the damage of the task, by crc32 of id:turn modulo 20; rows that it drops have present false."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    some = rows.select(F.col(id_col).alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    out = some.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy"))
    return out.drop("copy").withColumnRenamed("conv_id", id_col)
