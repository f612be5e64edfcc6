"""Conversations put in order at the least cost: turns kept, deleted, given another role, or inserted.

The roles of a sound conversation begin with `(s?(ua)+)?`: an optional system turn, then pairs of user and assistant. That
is an automaton of four states; a row moves through it by the edit that it gets, and a dynamic program over rows and
states finds the cheapest edits. It runs time-major: conversations are put into buckets of like length, and for each
turn, from the last to the first, one numpy step updates the costs of all states of all conversations of a bucket. The
costs stay, and a second vectorised walk from the first turn reads the edits off them, at each point the least letter
that still reaches the least cost.

A conversation of more than BLOCK rows is cut into blocks, which are lanes of the same tensors: one run gives each
block's costs from every state to every state, a product of those matrices the costs at the blocks' ends, a second run
the edits. So a long conversation costs no more steps than its blocks are long, and is exact.

What reaches that step is narrow: a row's class and its number of copies. Texts move once, sorted behind their
conversation's edits, and are streamed through; a task holds the edits of the conversation at hand, a byte a row, which
is what the result's own cell holds, and no texts. Repeats are found by a minimum combined before its exchange, so a text
that fills a conversation costs one row a turn.

Defined cases: a null role or text is one space, so a null text is blank and a null role illegal; an empty role counts as
one space where its initial is asked for; a null conversation id is a conversation; rows of one turn follow the digest of
role and text; null turns come first and count in no gap; conversations without rows have zeros, no edits and no lines;
further columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
#: Rows of finished conversations that are solved together.
TOGETHER = 200_000
#: Costs of the edits, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
_MANY = 1 << 40
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_ENDS = np.array([0, _MANY, _MANY, 0], dtype=np.int64)
#: The state after a turn of the role that a state asks for (user, or assistant after user).
_NEXT = np.array([2, 2, 3, 2])
#: The state after keeping a row, by state and initial (other, s, u, a); -1 where that is not allowed.
_KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: Classes of rows: initial (other, s, u, a) and four times the fault (none, truncated, to be deleted); and no row.
_PAD = 12
_LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)

STATS = "c long, c_null boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs (state, lane) where turns may be inserted before anything else; two are the most that can pay."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[_NEXT])
    return costs


def _moves(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs (edit, state, lane) of deleting, keeping and rerolling a row of each lane, with the costs after it."""
    lanes = np.arange(after.shape[1])
    row = codes < _PAD
    initial, fault = np.where(row, codes % 4, 0), np.where(row, codes // 4, 2)
    extra = np.where(fault == 1, TRUNCATED, 0) + np.where(fault == 2, _MANY, 0)
    to = _KEPT[:, initial]
    keep = np.where(to >= 0, after[to, lanes], _MANY) + extra
    return np.stack([np.where(row, DELETE, 0) + after, keep, REROLE + after[_NEXT] + extra])


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs (turn, state, lane) from before each turn to the end; codes: (turn, lane), ends: (state, lane)."""
    costs = np.empty((len(codes) + 1, 4, codes.shape[1]), dtype=np.int64)
    costs[-1] = ends
    for t in range(len(codes) - 1, -1, -1):
        costs[t] = np.minimum(_closed(_moves(codes[t], costs[t + 1]).min(axis=0)), _MANY)
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, start: np.ndarray, last: bool | np.ndarray = True) -> tuple[np.ndarray, np.ndarray]:
    """Edits (slot, lane; letters D I K R as 1 to 4, 0 for none) along the least costs, and the state of each lane at its end.

    last: whether turns may be inserted after a lane's last row; a block that another one follows leaves that to it.
    """
    turns, lanes = codes.shape
    out = np.zeros((3 * turns + 2, lanes), dtype=np.uint8)
    state, each = start.copy(), np.arange(lanes)
    for t in range(turns):
        options = _moves(codes[t], costs[t + 1])
        waits = np.ones(lanes, dtype=bool)
        for slot in range(3):
            best = costs[t][state, each]
            deleted, kept, _ = options[:, state, each] == best
            inserted = INSERT + costs[t][_NEXT[state], each] == best
            letter = np.where(deleted, 1, np.where(inserted, 2, np.where(kept, 3, 4)))
            row = codes[t] < _PAD
            out[3 * t + slot] = np.where(waits & row, letter, 0)
            moved = np.where(letter == 1, state, np.where(letter == 3, _KEPT[state, np.where(row, codes[t] % 4, 0)], _NEXT[state]))
            state = np.where(waits & row, moved, state)
            waits &= row & (letter == 2)
    for slot in range(2):
        inserted = (costs[-1][state, each] > 0) & last
        out[3 * turns + slot] = np.where(inserted, 2, 0)
        state = np.where(inserted, _NEXT[state], state)
    return out, state


def _texts(out: np.ndarray) -> list[bytes]:
    """Each lane's letters, put together."""
    flat = np.ascontiguousarray(out.T)
    ends = np.cumsum((flat > 0).sum(axis=1)).tolist()
    letters = _LETTERS[flat[flat > 0]].tobytes()
    return [letters[a:b] for a, b in zip([0, *ends], ends)]


def _long(codes: np.ndarray) -> tuple[int, bytes]:
    """Cost and edits of one long conversation, block by block."""
    blocks = -(-len(codes) // BLOCK)
    lanes = np.full(blocks * BLOCK, _PAD, dtype=np.uint8)
    lanes[: len(codes)] = codes
    lanes = np.ascontiguousarray(lanes.reshape(blocks, BLOCK).T)
    step = 16  # blocks at a time: their costs are held for each turn
    into = np.full((blocks, 4, 4), _MANY, dtype=np.int64)
    for a in range(0, blocks, step):
        part = lanes[:, a : a + step]
        for end in range(4):
            ends = np.full((4, part.shape[1]), _MANY, dtype=np.int64)
            ends[end] = 0
            into[a : a + step, :, end] = backward(part, ends)[0].T
    after = np.empty((blocks + 1, 4), dtype=np.int64)
    after[-1] = _closed(_ENDS[:, None])[:, 0]
    for b in range(blocks - 1, -1, -1):
        after[b] = np.minimum(_closed((into[b] + after[b + 1]).min(axis=1)[:, None])[:, 0], _MANY)
    state, edits = 0, []
    for a in range(0, blocks, step):
        part = lanes[:, a : a + step]
        wide = np.repeat(part, 4, axis=1)
        ends = np.repeat(after[a + 1 : a + 1 + part.shape[1]].T, 4, axis=1)
        last = np.repeat(np.arange(a, a + part.shape[1]) == blocks - 1, 4)
        out, to = trace(wide, backward(wide, ends), np.tile(np.arange(4), part.shape[1]), last)
        texts = _texts(out)
        for b in range(part.shape[1]):
            edits.append(texts[4 * b + state])
            state = int(to[4 * b + state])
    return int(after[0][0]), b"".join(edits)


def solve(conversations: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(cost, edits) of each conversation, given by the classes of its rows; conversations of like length together."""
    found: list = [None] * len(conversations)
    buckets: dict[int, list[int]] = {}
    for i, codes in enumerate(conversations):
        if len(codes) > BLOCK:
            found[i] = _long(codes)
        else:
            buckets.setdefault(max(len(codes) - 1, 0).bit_length(), []).append(i)
    for size, members in buckets.items():
        most = max(1, TOGETHER >> size)
        for a in range(0, len(members), most):
            some = members[a : a + most]
            lengths = np.array([len(conversations[i]) for i in some])
            codes = np.full((len(some), int(lengths.max())), _PAD, dtype=np.uint8)
            codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.concatenate([conversations[i] for i in some])
            codes = np.ascontiguousarray(codes.T)
            costs = backward(codes, np.repeat(_closed(_ENDS[:, None]), len(some), axis=1))
            out, _ = trace(codes, costs, np.zeros(len(some), dtype=np.int64))
            for i, cost, edits in zip(some, costs[0][0].tolist(), _texts(out)):
                found[i] = (cost, edits)
    return found


def _runs(batch: pd.DataFrame) -> list[dict]:
    """What a batch of sorted rows says of each conversation in it, all rows at once: faults, classes, first and last rows."""
    c, z, n = batch["c"].to_numpy(), batch["c_null"].to_numpy(bool), batch["n"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (z[1:] != z[:-1])])
    of = np.repeat(np.cumsum(np.isin(np.arange(len(c)), starts)) - 1, n)  # the conversation of each copy
    place = np.repeat(np.arange(len(c)), n)
    first = np.r_[True, place[1:] != place[:-1]][: len(place)]
    initial, fault = batch["initial"].to_numpy()[place], batch["fault"].to_numpy()[place]
    blank = fault == 3
    twice = (batch["repeat"].to_numpy(bool)[place] | ~first) & ~blank
    cut = (fault == 1) & ~twice
    codes = (initial + 4 * np.where(blank | twice, 2, np.where(cut, 1, 0))).astype(np.uint8)
    ends = np.searchsorted(of, np.arange(len(starts)), side="right")
    begins = np.r_[0, ends[:-1]]
    count = lambda flags, a, b: (lambda s: s[b] - s[a])(np.r_[0, np.cumsum(flags)])
    inside = of[1:] == of[:-1]
    bad = np.r_[False, inside & ~_legal(initial[:-1], initial[1:])][: len(of)]
    turn = batch["turn"].to_numpy()
    dated = np.flatnonzero(~batch["turn_null"].to_numpy(bool) & (n > 0))
    by = np.searchsorted(starts, dated, side="right") - 1
    low, high = np.searchsorted(by, np.arange(len(starts)), side="left"), np.searchsorted(by, np.arange(len(starts)), side="right")
    steps = np.diff(turn[dated])
    missing = np.r_[0, np.where((by[1:] == by[:-1]) & (steps > 0), steps - 1, 0)][: len(dated)]  # over neighbours this adds up to max - min + 1 - distinct
    columns = zip(
        c[starts].tolist(), z[starts].tolist(), begins.tolist(), ends.tolist(), low.tolist(), high.tolist(),
        count(missing, low, high).tolist(), *(count(flags, begins, ends).tolist() for flags in (blank, twice, cut, bad)),
    )
    return [
        {
            "c": c, "z": z, "codes": [codes[a:b]], "gaps": gaps, "blank": blanks, "duplicate": twices, "truncated": cuts, "illegal": bads,
            "first": int(initial[a]) if b > a else None, "last": int(initial[b - 1]) if b > a else None,
            "low": int(turn[dated[d]]) if e > d else None, "high": int(turn[dated[e - 1]]) if e > d else None,
        }
        for c, z, a, b, d, e, gaps, blanks, twices, cuts, bads in columns
    ]


def _legal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether initials may follow each other: s or a before u, u before a."""
    return ((one == 1) | (one == 3)) & (two == 2) | (one == 2) & (two == 3)


def _continued(now: dict, more: dict) -> None:
    """A conversation that goes on in the next batch."""
    now["codes"] += more["codes"]
    for k in ("gaps", "blank", "duplicate", "truncated", "illegal"):
        now[k] += more[k]
    if now["last"] is not None and more["first"] is not None:
        now["illegal"] += int(not _legal(np.int64(now["last"]), np.int64(more["first"])))
    if now["high"] is not None and more["low"] is not None:
        now["gaps"] += max(0, more["low"] - now["high"] - 1)
    for k, empty in (("first", now["first"] is None), ("low", now["low"] is None), ("last", more["last"] is not None), ("high", more["high"] is not None)):
        if empty:
            now[k] = more[k]


def _planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole conversations, sorted (c_null, c, turn), to one row each: STATS."""
    done: list[dict] = []
    now: dict | None = None
    waiting = 0

    def finished() -> pd.DataFrame:
        solved = solve([np.concatenate(d["codes"]) for d in done])
        rows = [(d["c"], d["z"], d["gaps"], d["blank"], d["duplicate"], d["truncated"], d["illegal"], cost, edits.decode()) for d, (cost, edits) in zip(done, solved)]
        return pd.DataFrame(rows, columns=["c", "c_null", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    for batch in batches:
        for found in _runs(batch) if len(batch) else []:
            if now is not None and (now["c"], now["z"]) == (found["c"], found["z"]):
                _continued(now, found)
            else:
                if now is not None:
                    done.append(now)
                now = found
            waiting += len(found["codes"][-1])
        if waiting > TOGETHER and done:
            yield finished()
            done, waiting = [], 0
    if now is not None:
        done.append(now)
    if done:
        yield finished()


def _seen(rows: DataFrame, copies: str | None) -> DataFrame:
    """rows with the operator's own columns: c, turn, role, text (nulls filled, marked), h, n copies."""
    return rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"),
        F.col("conv_id").isNull().alias("c_null"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.col("turn").isNull().alias("turn_null"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"),
    ).withColumn("h", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _initial(role: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring(role, 1, 1)), F.lit(0)).cast("int")


def _fault(text: Column) -> Column:
    """3 blank, 1 truncated, 0 neither; what follows the last character that is not white space is looked at alone."""
    end = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(end == "", 3).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(1).cast("int")


def plans(seen: DataFrame) -> DataFrame:
    """One row for each conversation: STATS, with the cheapest edits as letters D I K R in order."""
    narrow = seen.select("c", "c_null", "turn", "turn_null", "h", "n", _initial(F.col("role")).alias("initial"), _fault(F.col("text")).alias("fault"))
    # Equal rows of one turn are one row with its number of copies; a dropped row (n = 0) still names its conversation.
    keys = ["c", "c_null", "turn", "turn_null", "h"]
    merged = narrow.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("initial").alias("initial"), F.min("fault").alias("fault"))
    place = F.struct((~F.col("turn_null")).alias("z"), "turn")
    first = narrow.filter("n > 0").groupBy("c", "c_null", "h").agg(F.min(place).alias("_first"))
    marked = merged.join(first, ["c", "c_null", "h"], "left").withColumn("repeat", F.coalesce(F.col("_first") != place, F.lit(False)))
    ready = marked.select("c", "c_null", (~F.col("turn_null")).alias("_z"), "turn", "turn_null", "h", "n", "initial", "fault", "repeat")
    ordered = ready.repartition("c", "c_null").sortWithinPartitions("c_null", "c", "_z", "turn", "h").drop("_z", "h")
    return ordered.mapInPandas(_planned, STATS)


def _behind_plans(seen: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan and then its rows, in order, whole conversations to a partition."""
    names = [c for c in planned.columns if c not in ("c", "c_null")]
    head = planned.select("c", "c_null", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("turn"), F.lit(None).cast("binary").alias("h"), F.struct(*names).alias("plan"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(1).cast("long").alias("n"))
    rows = seen.filter("n > 0").select("c", "c_null", F.when(F.col("turn_null"), 1).otherwise(2).alias("_k"), "turn", "h", F.lit(None).cast(head.schema["plan"].dataType).alias("plan"), "role", "text", "n")
    return head.unionByName(rows).repartition("c", "c_null").sortWithinPartitions("c_null", "c", "_k", "turn", "h").drop("h", "turn")


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(plan row or None, role, text) in order: first a conversation's plan, then each line of the repaired conversation."""
    audit, at, state = "", 0, 0

    def added():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield None, "assistant" if state == 2 else "user", ""
            at, state = at + 1, int(_NEXT[state])

    for batch in batches:
        for c, z, kind, plan, role, text, n in zip(*(batch[k] for k in ("c", "c_null", "_k", "plan", "role", "text", "n"))):
            if kind == 0:
                yield from added()
                audit, at, state = plan["audit"], 0, 0
                yield (c, z, plan), None, None
                continue
            for _ in range(int(n)):
                yield from added()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = "assistant" if state == 2 else "user", int(_NEXT[state])
                else:
                    state = int(_KEPT[state, " sua".find(role[:1] or " ")])
                yield None, role, text
    yield from added()


def turns(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text.

    rows: conv_id, turn, role, text; copies names a column of how often a row stands there (0: only its conversation counts).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, who, place = [], 0, (0, True), 0
        for plan, role, text in _lines(batches):
            if plan is not None:
                who, place = (int(plan[0]), bool(plan[1])), 0
                continue
            held.append((*who, place, role, text))
            place, size = place + 1, size + len(text) + 40
            if size > 4_000_000:
                yield pd.DataFrame(held, columns=["c", "c_null", "place", "role", "text"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["c", "c_null", "place", "role", "text"])

    seen = _seen(rows, copies)
    made = _behind_plans(seen, plans(seen)).mapInPandas(run, "c long, c_null boolean, place long, role string, text string")
    return made.select(F.when(~F.col("c_null"), F.col("c")).alias("conv_id"), "place", "role", "text")


def repaired(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each conversation of rows (see `turns`): conv_id, gaps, faults, illegal, cost, audit, repaired_sha256."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, digest, lines, size = [], None, None, 0, 0

        def closed():
            return (now[0], now[1], *(now[2][k] for k in names), digest.hexdigest())

        for plan, role, text in _lines(batches):
            if plan is None:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                lines += 1
                continue
            if now is not None:
                held.append(closed())
                size += len(now[2]["audit"]) + 200
            now, digest, lines = plan, hashlib.sha256(), 0
            if size > 4_000_000:
                yield pd.DataFrame(held, columns=["c", "c_null", *names, "repaired_sha256"])
                held, size = [], 0
        if now is not None:
            held.append(closed())
            yield pd.DataFrame(held, columns=["c", "c_null", *names, "repaired_sha256"])

    seen = _seen(rows, copies)
    made = _behind_plans(seen, plans(seen)).mapInPandas(run, STATS + ", repaired_sha256 string")
    return made.select(F.when(~F.col("c_null"), F.col("c")).alias("conv_id"), *names, "repaired_sha256")


def damaged(convs: DataFrame) -> DataFrame:
    """conversations with known damage: by the CRC-32 of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes
    its sentence ends away, 3 repeats it, 4 makes it a user's. A dropped row stays with no copies, so that its conversation counts."""
    spaced = lambda c: F.coalesce(convs[c].cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("_d")
    rows = convs.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind)
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1).alias("copies"))
