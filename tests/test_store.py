"""The store: writers that meet, what lookups open, keys that hide earlier rows; and leases on top of it."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from markloom.plans.rounds import Rules
from markloom.sources import store
from markloom.streaming import jobs

ROWS = "id string, v int"


@pytest.fixture
def s(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/store")


def content(df):
    return sorted((r.id, r.v) for r in df.collect())


def test_upserts_and_deletes_rewrite_nothing(spark, s):
    df = lambda rows: spark.createDataFrame(rows, ROWS)
    s.write("t", df([(f"k{i:03d}", i) for i in range(100)]))
    s.upsert("t", df([("k005", -5), ("new", 1)]))
    s.append("t", df([("k005", 77)]))
    s.delete("t", df([("k006", 0), ("absent", 0)]))
    s.upsert("t", df([("k006", 66), (None, 9)]))
    want = {(f"k{i:03d}", i) for i in range(100)} - {("k005", 5), ("k006", 6)} | {("k005", -5), ("k005", 77), ("new", 1), ("k006", 66)}
    assert {r for r in content(s.read("t").filter("id IS NOT NULL"))} == want and s.read("t").filter("id IS NULL").count() == 1
    number, parts = s._latest("t")
    assert number == 5 and [p["kind"] for p in parts] == ["rows", "deletes", "rows", "rows", "deletes", "deletes", "rows"]
    assert sorted(r.v for r in s.lookup("t", ["k005"]).collect()) == [-5, 77] and s.get("t", "k006").v == 66
    with pytest.raises(store.NotFound):
        s.get("t", "nobody")
    before = s.read("t")
    s.compact("t")
    assert {r for r in content(s.read("t").filter("id IS NOT NULL"))} == want and len(s._latest("t")[1]) == 1
    assert before.count() == s.read("t").count()  # an earlier version can still be read


def test_lookups_open_only_files_that_may_hold_the_key(spark, s):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part in "abc":
            s.append("t", spark.range(400).select(F.concat(F.lit(part), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.col("id").cast("int").alias("v")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    all_files = len(s.read("t").inputFiles())
    assert all_files >= 12 and len(s.lookup("t", ["b0123"]).inputFiles()) == 1 and s.get("t", "b0123").v == 123
    assert len(s.lookup("t", ["a0000", "c0399"]).inputFiles()) == 2 and s.lookup("t", ["zzz"]).count() == 0
    s.upsert("t", spark.createDataFrame([("b0123", -1)], ROWS))
    assert s.get("t", "b0123").v == -1 and len(s.lookup("t", ["b0123"]).inputFiles()) == 3  # the old file, the keys, the new file
    assert content(s.lookup("t", ["b0123", "b0124"])) == [("b0123", -1), ("b0124", 124)]


def test_writers_that_meet_all_end_up_in_the_table(spark, s):
    s.write("t", spark.createDataFrame([("seed", 0)], ROWS))
    start, failed = threading.Barrier(4), []

    def write(k):
        try:
            start.wait()
            for i in range(2):
                s.append("t", spark.createDataFrame([(f"w{k}{i}", k)], ROWS))
                s.upsert("t", spark.createDataFrame([("seed", 10 * k + i)], ROWS))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = content(s.read("t"))
    assert not failed and {k for k, _ in got} == {"seed", *(f"w{k}{i}" for k in range(4) for i in range(2))} and len(got) == 9
    assert s._latest("t")[0] == 17


def test_a_taken_number_is_never_overwritten(spark, s):
    s.write("t", spark.createDataFrame([("a", 1)], ROWS))
    number, parts = s._latest("t")
    assert s._put("t", number + 1, parts) and not s._put("t", number + 1, []) and s._latest("t") == (number + 1, parts)
    with pytest.raises(store.Conflict):
        s.write("t", spark.createDataFrame([("b", 1)], ROWS), since=number)
    tries = []

    def work(table):
        tries.append(table.count())
        if len(tries) == 1:  # another writer comes between
            s.append("t", spark.createDataFrame([("c", 3)], ROWS))
        return table.groupBy(F.lit("sum").alias("id")).agg(F.sum("v").cast("int").alias("v"))

    assert content(s.change("t", work)) == [("sum", 4)] and tries == [1, 2] and ("sum", 4) in content(s.read("t"))


def test_leases(spark, s):
    clock = [1000.0]
    held = jobs.Leases(s, seconds=60, now=lambda: clock[0])
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    taken = lambda df: sorted(r.id for r in df.collect())
    assert taken(held.claim(docs("a", "a", "b", None), "one")) == ["a", "b"] and taken(held.claim(docs("a", "c"), "two")) == ["c"]
    assert taken(held.claim(docs("a"), "one")) == ["a"]  # its own, when a batch runs again
    held.close(spark.createDataFrame([("a", "done", None), ("b", "failed", "why"), ("c", "done", None)], "id string, status string, error string"), "one")
    rows = {r.id: (r.status, r.claims, r.error) for r in s.read("leases").collect()}
    assert rows == {"a": ("done", 1, None), "b": ("failed", 1, "why"), "c": ("claimed", 1, None)}  # c is the other's
    assert taken(held.claim(docs("a", "b", "c"), "three")) == ["b"]
    clock[0] += 61
    assert taken(held.claim(docs("a", "b", "c"), "four")) == ["b", "c"]
    won = []
    start = threading.Barrier(3)

    def race(k):
        start.wait()
        won.extend((k, i) for i in taken(held.claim(docs("x", "y"), f"racer {k}")))

    threads = [threading.Thread(target=race, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(i for _, i in won) == ["x", "y"]


def test_arrivals_make_one_job(spark, s, tmp_path):
    """A document twice in a batch and again in the next; a failed one is read when it comes again."""
    log = tmp_path / "log"
    folder = tmp_path / "in"
    folder.mkdir()

    def ask(row):
        with log.open("a") as f:
            f.write(f"{row['doc_id']}\n")
        if row["doc_id"] == "weak" and log.read_text().count("weak") == 1:
            return "permanent", None, "no"
        return "ok", json.dumps({"lines": [{"text": "read"}], "legibility": "good"}), None

    schema = "doc_id string, page int, text string, source string"
    rows = [[("a", 0), ("a", 0), ("weak", 0)], [("a", 0), ("b", 0), ("weak", 0)], [("typed", 0)]]
    for k, some in enumerate(rows):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"doc_id": d, "page": p, "text": "Long enough to be read as it stands here." if d == "typed" else ""}) for d, p in some))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    jobs.reading_stream(stream, ask, s, jobs.Leases(s), str(tmp_path / "state")).awaitTermination()
    assert sorted(log.read_text().split()) == ["a", "b", "weak", "weak"]
    assert {r.id: (r.status, r.claims) for r in s.read("leases").collect()} == {"a": ("done", 1), "b": ("done", 1), "weak": ("done", 2), "typed": ("done", 1)}
    assert {r.id: r.status for r in s.read("transcriptions").collect()} == {"a": "done", "b": "done", "weak": "done", "typed": "readable"}
    assert s.get("pages", "a:0").text == "read" and s.get("pages", "typed:0").source is None

    def broken(row):
        raise RuntimeError("gone")

    pages = spark.createDataFrame([("z", 0, "", None)], schema)
    jobs.read_batch(pages, broken, s, jobs.Leases(s), "mine", Rules(attempts=1))
    assert s.get("leases", "z").status == "failed" and "gone" in s.get("leases", "z").error
