"""The token ledger: the reference cases, a replay against a plain simulation, and the stream against the replay."""

import datetime
import random

import pytest

from markloom.streaming import ledger

REQUESTS = "key string, id long, at_ms long, reserve long, took_ms long, used long, remaining long, reset_ms long"


def run(requests, limit=8000):
    """Requests (at, reserve, used, remaining, reset) that are answered at once, as (waited, used after the last one)."""
    held, now, out = ledger.Ledger(limit), 0, []
    for name, (at, reserve, used, remaining, reset) in enumerate(requests):
        out += list(held.ask(name, at, reserve))
        for v in held.advance(float("inf")):
            out.append(v)
            held.reply(v[0], v[3], used, remaining, reset)
            now = v[3]
    held.room(now)
    return [v[4] for v in out if v[1] == "admitted"], sum(c[1] for c in held.charges), [v[1] for v in out]


@pytest.mark.parametrize(
    "requests,waits,left",
    [
        ([(0, 3000, None, None, None), (0, 3000, None, None, None)], [0, 0], 6000),  # fits
        ([(0, 5000, None, None, None), (0, 5000, None, None, None)], [0, 60_000], 5000),  # waits for the window
        ([(0, 5000, 1200, None, None), (0, 5000, 1000, None, None)], [0, 0], 2200),  # reservations are corrected
        ([(0, 1000, 1000, 500, 10_000), (0, 2000, 2000, None, None)], [0, 10_000], 3000),  # the provider's word is tighter
        ([(0, 3000, None, None, None)], [0], 3000),  # a failed request keeps its charge
    ],
)
def test_cases(requests, waits, left):
    assert run(requests)[:2] == (waits, left)


def test_too_large_is_refused_at_once():
    assert run([(0, 9000, None, None, None), (0, 100, None, None, None)])[2] == ["too_large", "admitted"]


def drawn(seed=4, n=400):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 50, 900, 4000, 20_000])
        known = rng.random() < 0.15
        rows.append((f"k{rng.randrange(3)}", i, at, rng.choice([200, 1500, 3000, 7000, 9000]), rng.choice([0, 300, 5000]), rng.choice([None, 100, 2500]), rng.randrange(3000) if known else None, rng.choice([None, 5000, 40_000]) if known else None))
    return rows


def simulated(rows, limit=8000, window=60_000):
    """One key after another by a plain clock that sleeps."""
    out = []
    for key in sorted({r[0] for r in rows}):
        clock, charges, server = 0, [], None
        for _, name, at, reserve, took, used, remaining, reset in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if reserve > limit:
                out.append((key, name, "too_large", at, None, 0, None))
                continue
            clock, slept = max(clock, at), 0
            while True:
                charges = [c for c in charges if c[0] > clock - window]
                room, more = limit - sum(t for _, t in charges), charges[0][0] + window if charges else clock
                if server and server[2] > clock and server[1] - sum(t for a, t in charges if a > server[0]) < room:
                    room, more = server[1] - sum(t for a, t in charges if a > server[0]), server[2]
                if reserve <= room:
                    break
                nap = max(250, more - clock)
                clock, slept = clock + nap, slept + nap
            out.append((key, name, "admitted", at, clock, slept, sum(t for _, t in charges)))
            charges.append((clock, reserve if used is None else used))
            clock += took
            if remaining is not None:
                server = (clock, remaining, clock + (window if reset is None else reset))
    return sorted(out)


def test_replay_equals_a_simulation(spark):
    rows = drawn()
    got = sorted(map(tuple, ledger.replay(spark.createDataFrame(rows, REQUESTS).repartition(3), 8000).collect()))
    assert got == simulated(rows)
    assert {"admitted", "too_large"} == {r[2] for r in got} and any(r[5] for r in got)


def test_replay_of_odd_rows(spark):
    rows = [("a", 1, 0, 100, None, None, None, None), ("a", 2, 5, 100, 1, None, None, None), ("b", None, 0, 1, 1, None, None, None), ("b", 4, None, 1, 1, None, None, None), ("b", 5, 0, None, 1, -5, None, None)]
    got = sorted(map(tuple, ledger.replay(spark.createDataFrame(rows, REQUESTS), 8000).collect()))
    assert got == [("a", 1, "admitted", 0, 0, 0, 0), ("a", 2, "pending", 5, None, 0, None), ("b", 5, "admitted", 0, 0, 0, 0)]
    assert ledger.replay(spark.createDataFrame([], REQUESTS), 10).count() == 0


def test_stream_gives_the_verdicts_of_a_replay(spark, tmp_path):
    """The log comes in small files, out of order inside a file; the last event moves the watermark past the others."""
    rows = drawn(seed=8, n=120)
    requests = spark.createDataFrame(rows, REQUESTS)
    verdicts = ledger.replay(requests, 8000).cache()
    log = ledger.events_of(requests, verdicts).orderBy("at").collect()
    folder = str(tmp_path / "in")
    parts = [log[k : k + 40] for k in range(0, len(log), 40)]
    for k, part in enumerate(parts):
        random.Random(k).shuffle(part)
    end = max(r["at"] for r in log)
    parts += [[("z", -late, "note", end + datetime.timedelta(hours=late), None, None, None)] for late in (3, 4)]
    for part in parts:
        spark.createDataFrame(part, ledger.EVENTS).coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(ledger.EVENTS).option("maxFilesPerTrigger", 1).json(folder)
    # Lateness is wider than a file's span, and all events lie behind the watermark in the end.
    query = ledger.admissions(stream, 8000, lateness="2 hours").writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("verdicts").collect())) == sorted(map(tuple, verdicts.collect()))
