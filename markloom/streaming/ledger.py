"""A ledger of a provider's token allowance, as a stream with keyed state and as a replay of a table.

Requests of a key run one at a time, in order of arrival. One is charged before it is sent, at what it reserves, in the
window of the last `window_ms`; its reply corrects the charge to what was used, and a failed request keeps it. What a
provider says of its own allowance holds while it is fresh, less what was charged since, if it is tighter. A request that
doesn't fit waits until the oldest charge leaves the window, or until the provider's window resets, and is looked at again;
one larger than the whole allowance is refused.

Both forms go through `Ledger`, whose state is small: charges of one window, requests that wait, one provider's word. A
replay streams the sorted requests of a key through a task, since each start depends on the one before; keys run apart.
The stream holds events until the watermark has passed them, so that its verdicts are those of a replay in order of time,
however events fall into batches; a timer wakes it for events that are due and for waits that end.

Defined cases: events of one millisecond come as request, reply, note, then by id; a reply to a request that isn't in
flight is ignored; a request without a reply keeps those behind it waiting, in a replay as `pending`; a null id or time is
left out; no requests give no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How long a window is, and the least that a request waits before it is looked at again. Fixed values.
WINDOW_MS, LEAST_WAIT_MS = 60_000, 250
VERDICTS = "id long, verdict string, asked_ms long, started_ms long, waited_ms long, used_before long"
_KINDS = {"request": 0, "reply": 1, "note": 2}


class Ledger:
    """What is known of one key's allowance; times are milliseconds."""

    def __init__(self, limit: int, window_ms: int = WINDOW_MS):
        self.limit, self.window_ms = limit, window_ms
        self.charges: deque = deque()  # [at, tokens, id], oldest first
        self.waiting: deque = deque()  # (id, asked, reserve)
        self.server: tuple | None = None  # at, remaining, resets
        self.busy: int | None = None
        self.free, self.wakes, self.waited = 0, None, 0

    def room(self, now: int) -> tuple[int, int]:
        """Tokens that may be charged now, and when there may be more."""
        while self.charges and self.charges[0][0] <= now - self.window_ms:
            self.charges.popleft()
        room = self.limit - sum(c[1] for c in self.charges)
        more = self.charges[0][0] + self.window_ms if self.charges else now
        if self.server and self.server[2] > now:
            at, remaining, resets = self.server
            theirs = remaining - sum(c[1] for c in self.charges if c[0] > at)
            if theirs < room:
                room, more = theirs, resets
        return room, more

    def due(self) -> int | None:
        """When the first waiting request is to be looked at; null while one is in flight or none waits."""
        if self.busy is not None or not self.waiting:
            return None
        return max(self.free, self.waiting[0][1], self.wakes or 0)

    def advance(self, to: float) -> Iterator[tuple]:
        """Verdicts (VERDICTS) of what can start up to a time."""
        while (now := self.due()) is not None and now <= to:
            name, asked, reserve = self.waiting[0]
            room, more = self.room(now)
            if reserve <= room:
                self.waiting.popleft()
                before = sum(c[1] for c in self.charges)
                self.charges.append([now, reserve, name])
                self.busy, self.wakes = name, None
                yield name, "admitted", asked, now, self.waited, before
                self.waited = 0
            else:
                wait = max(LEAST_WAIT_MS, more - now)
                self.wakes, self.waited = now + wait, self.waited + wait

    def ask(self, name: int, at: int, reserve: int) -> Iterator[tuple]:
        if reserve > self.limit:
            yield name, "too_large", at, None, 0, None
        else:
            self.waiting.append((name, at, reserve))

    def reply(self, name: int, at: int, used: int | None, remaining: int | None, reset_ms: int | None) -> None:
        if self.busy != name:
            return
        for charge in self.charges:
            if charge[2] == name and used is not None and used >= 0:
                charge[1] = used
        if remaining is not None:
            self.server = (at, remaining, at + (self.window_ms if reset_ms is None else reset_ms))
        self.busy, self.free = None, at

    def note(self, at: int, remaining: int, reset_ms: int | None) -> None:
        """What a provider says of its window beside any request, as after a refusal."""
        self.server = (at, max(0, remaining), at + max(0, reset_ms or 0))

    def event(self, kind: str, name: int, at: int, tokens: int | None, remaining: int | None, reset_ms: int | None) -> Iterator[tuple]:
        """Verdicts of what starts before an event, which is then taken in; `advance` gives those of its own millisecond."""
        yield from self.advance(at - 1)
        if kind == "request":
            yield from self.ask(name, at, tokens or 0)
        elif kind == "reply":
            if self.busy != name:  # it may have been answered within the millisecond of its start
                yield from self.advance(at)
            self.reply(name, at, tokens, remaining, reset_ms)
        elif remaining is not None:
            self.note(at, remaining, reset_ms)


def _whole(value) -> int | None:
    return None if value is None or value != value else int(value)


def replay(requests: DataFrame, limit: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """(key, VERDICTS) of requests: key, id, at_ms, reserve, took_ms, and of the reply used, remaining, reset_ms.

    took_ms: from start to reply; null for a request that is never answered.
    """
    kind = requests.schema["key"].dataType.simpleString()
    columns = ["key", "id", "at_ms", "reserve", "took_ms", "used", "remaining", "reset_ms"]
    # Nulls travel as -1 or less: no column is made a float for them.
    flat = requests.filter("id IS NOT NULL AND at_ms IS NOT NULL AND key IS NOT NULL").select("key", *[F.col(c).cast("long").alias(c) for c in ("id", "at_ms")], F.coalesce(F.col("reserve").cast("long"), F.lit(0)).alias("reserve"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in columns[4:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ledger = None, Ledger(limit, window_ms)
        for batch in batches:
            rows = []
            for k, name, at, reserve, *reply in zip(*(batch[c].tolist() for c in columns)):
                if k != key:
                    rows += [(key, n, "pending", a, None, 0, None) for n, a, _ in ledger.waiting]
                    key, ledger = k, Ledger(limit, window_ms)
                took, used, remaining, reset = (None if v < 0 else v for v in reply)
                rows += [(k, *v) for v in ledger.ask(name, at, reserve)]
                for v in ledger.advance(float("inf")):
                    rows.append((k, *v))
                    if took is not None:
                        ledger.reply(v[0], v[3] + took, used, remaining, reset)
            yield _frame(rows)
        yield _frame([(key, n, "pending", a, None, 0, None) for n, a, _ in ledger.waiting])

    return flat.repartition("key").sortWithinPartitions("key", "at_ms", "id").mapInPandas(run, f"key {kind}, {VERDICTS}")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["key", *(c.split()[0] for c in VERDICTS.split(", "))]
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[3:]} | {"verdict": "object"})


#: Events of a stream: a request (tokens: what it reserves), a reply (tokens: what it used), or a provider's note.
EVENTS = "key string, id long, kind string, at timestamp, tokens long, remaining long, reset_ms long"


def admissions(events: DataFrame, limit: int, window_ms: int = WINDOW_MS, lateness: str = "10 seconds") -> DataFrame:
    """(key, VERDICTS) of a stream of EVENTS; state is kept by key, events later than `lateness` are dropped."""
    from pyspark.sql.streaming import StatefulProcessor

    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    class Admit(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.early = handle.getListState("early", "at long, kind string, id long, tokens long, remaining long, reset_ms long")
            self.charges = handle.getListState("charges", "at long, tokens long, id long")
            self.waiting = handle.getListState("waiting", "id long, asked long, reserve long")
            self.rest = handle.getValueState("rest", "busy long, free long, wakes long, waited long, server_at long, remaining long, resets long")

        def handleInputRows(self, key, rows, timerValues):
            new = [e for batch in rows for e in self._events(batch)]
            yield from self._passed(key, new, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from self._passed(key, [], timerValues.getCurrentWatermarkInMs())

        def close(self) -> None:
            pass

        def _events(self, batch: pd.DataFrame) -> list[tuple]:
            some = batch[batch["id"].notna() & batch["ms"].notna()]
            return [(int(at), kind, int(name), _whole(tokens), _whole(remaining), _whole(reset)) for at, kind, name, tokens, remaining, reset in zip(*(some[c] for c in ("ms", "kind", "id", "tokens", "remaining", "reset_ms")))]

        def _passed(self, key, new: list[tuple], watermark: int):
            """Events up to the watermark in order of time; the rest stays, with a timer for what is due first."""
            ledger = Ledger(limit, window_ms)
            ledger.charges = deque([list(c) for c in self.charges.get()])
            ledger.waiting = deque([tuple(w) for w in self.waiting.get()])
            if self.rest.exists():
                ledger.busy, free, ledger.wakes, waited, *server = self.rest.get()
                ledger.free, ledger.waited = free or 0, waited or 0
                ledger.server = None if server[0] is None else tuple(server)
            early = sorted([*map(tuple, self.early.get()), *new], key=lambda e: (e[0], _KINDS.get(e[1], 3), e[2]))
            found = []
            for at, kind, name, tokens, remaining, reset in (e for e in early if e[0] <= watermark):
                found += ledger.event(kind, name, at, tokens, remaining, reset)
            found += ledger.advance(watermark)
            early = [e for e in early if e[0] > watermark]
            for state, values in ((self.early, early), (self.charges, [tuple(c) for c in ledger.charges]), (self.waiting, list(ledger.waiting))):
                state.put(values) if values else state.clear()
            self.rest.update((ledger.busy, ledger.free, ledger.wakes, ledger.waited, *(ledger.server or (None, None, None))))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            due = [t for t in (ledger.due(), early[0][0] if early else None) if t is not None]
            if due:
                self.handle.registerTimer(max(min(due), watermark + 1))
            if found:
                yield _frame([(key[0], *v) for v in found])

    timed = events.withColumn("ms", F.unix_millis("at")).withWatermark("at", lateness)
    return timed.groupBy("key").transformWithStateInPandas(Admit(), outputStructType=f"key string, {VERDICTS}", outputMode="Append", timeMode="EventTime")


def events_of(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The log (EVENTS) that requests and their replies leave, when each starts as `verdicts` say."""
    stamp: Column = F.timestamp_millis("_at")
    asked = requests.select(F.col("key").cast("string").alias("key"), "id", F.lit("request").alias("kind"), F.col("at_ms").alias("_at"), F.col("reserve").cast("long").alias("tokens"), F.lit(None).cast("long").alias("remaining"), F.lit(None).cast("long").alias("reset_ms"))
    started = requests.filter("took_ms IS NOT NULL").join(verdicts.filter("started_ms IS NOT NULL").select("key", "id", "started_ms"), ["key", "id"])
    replied = started.select(F.col("key").cast("string").alias("key"), "id", F.lit("reply").alias("kind"), (F.col("started_ms") + F.col("took_ms")).alias("_at"), F.col("used").cast("long").alias("tokens"), F.col("remaining").cast("long").alias("remaining"), F.col("reset_ms").cast("long").alias("reset_ms"))
    return asked.unionByName(replied).select("key", "id", "kind", stamp.alias("at"), "tokens", "remaining", "reset_ms")
