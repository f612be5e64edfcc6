"""Rounds of asking: every fate of a piece, with judges that fail in known ways."""

import json

import pytest
from pyspark.sql import functions as F

from markloom.operators import judge as judges
from markloom.plans import ask, rounds

PIECES = "doc_id long, path array<int>, text string, page int"


def usable(replies):
    return replies.withColumn("errors", F.when(F.col("raw").startswith("bad"), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")))


def test_every_fate(spark):
    lines = "\n".join(f"line {i} of this text" for i in range(64))
    pieces = spark.createDataFrame([(1, [0], "fine", 0), (1, [1], lines, 1), (2, [0], "flaky", 2), (3, [0], "down", 3), (4, [0], "BAD " + lines, 4), (5, [0], "endless", 5), (6, [0], "locked", 6), (7, [0], "mended", 7), (8, [0], None, 8)], PIECES)

    def judge(batch):
        def one(text, attempt, errors):
            if text == "flaky" and attempt < 3 or text == "down":
                return "transient", None
            if text == "locked":
                return "permanent", None
            if len(text) > 600 or "endless" in text:
                return "too_large", None
            if "BAD" in text or text == "mended" and errors is None:
                return "ok", "bad"
            return "ok", f"read {len(text)}"

        return batch.assign(**{c: v for c, v in zip(("outcome", "raw"), zip(*[one(*r) for r in zip(batch["text"], batch["attempt"], batch["errors"])]))})

    waits = []
    got = rounds.rounds(pieces, judge, ["doc_id"], rounds.Rules(repairs=1), usable, waits.append)
    answered = sorted((r.doc_id, list(r.path), r.text, r.page, r.repairs) for r in got.answered.collect())
    assert waits == [0.4, 0.8]
    assert [r for r in answered if r[0] in (2, 7, 8)] == [(2, [0], "flaky", 2, 0), (7, [0], "mended", 7, 1), (8, [0], "", 8, 0)]
    # A refused piece is read in parts, whose paths keep their order; nothing is lost between them.
    parts = [r for r in answered if r[0] == 1 and len(r[1]) > 1]
    assert "\n".join(r[2] for r in parts) == lines and len(parts) >= 3 and all(r[3] == 1 and r[1][0] == 1 for r in parts)
    fates = {(r.doc_id, r.fate) for r in got.failed.collect()}
    assert fates == {(3, "outage"), (4, "unusable"), (5, "too_large"), (6, "refused")}
    # What could be read of document 4 was: only its first line's part stays unusable, at the depth allowed.
    assert max(len(r.path) for r in got.failed.collect()) <= 5
    tried = {(r.doc_id, r.attempt, r.outcome, r.wait_ms) for r in got.attempts.filter("doc_id IN (2, 3)").collect()}
    assert tried == {(2, 1, "transient", 400), (2, 2, "transient", 800), (2, 3, "ok", None), (3, 1, "transient", 400), (3, 2, "transient", 800), (3, 3, "transient", None)}


def test_no_pieces(spark):
    got = rounds.rounds(spark.createDataFrame([], PIECES), lambda b: b, ["doc_id"])
    assert got.answered.count() == got.failed.count() == got.attempts.count() == 0


GOOD = {"questionId": "q1", "summary": "s", "selfConfidence": 0.9, "criteria": [{"criterionId": "c", "awardedMarks": 1, "status": "correct", "reasoning": "r"}], "findings": []}


def test_ask_ends_as_attempt_fate_says(spark):
    """Malformed replies are asked for again with their errors; outages leave nothing behind."""
    answers = spark.createDataFrame([(1, "q1", "fine"), (1, "q2", "mended"), (1, "q3", "never"), (2, "q1", "flaky"), (2, "q2", "down"), (3, "q1", "prose")], "doc_id long, question_id string, text string")
    seen = []

    def judge(batch):
        out = []
        for text, attempt, errors in zip(batch["text"], batch["attempt"], batch["errors"]):
            if text == "flaky" and attempt == 1 or text == "down":
                out.append(("transient", None))
            elif text == "never" or text == "mended" and errors is None:
                out.append(("ok", json.dumps({**GOOD, "criteria": [{"criterionId": "c", "status": "wrong"}]})))
            elif text == "prose":
                out.append(("ok", "I cannot grade this."))
            else:
                out.append(("ok", json.dumps({**GOOD, "summary": ",".join(errors) if errors is not None else "first"})))
        return batch.assign(outcome=[o for o, _ in out], raw=[r for _, r in out])

    got = ask.ask(answers, judge, 1000, check=ask.well_formed, pause=seen.append)
    replies = {(r.doc_id, r.question_id): (json.loads(r.raw)["summary"], r.repairs) for r in got.replies.collect()}
    assert set(replies) == {(1, "q1"), (1, "q2"), (2, "q1")} and replies[1, "q1"] == ("first", 0) and seen == [0.4, 0.8]
    # The judge was told what was wrong, and where.
    assert replies[1, "q2"][1] == 1 and "criteria.0.awardedMarks: Required" in replies[1, "q2"][0] and "criteria.0.status" in replies[1, "q2"][0]
    reasons = {(r.doc_id, r.question_id): r.reason for r in got.ungraded.collect()}
    assert set(reasons) == {(1, "q3"), (3, "q1")} and "awardedMarks" in reasons[1, "q3"] and "not a JSON object" in reasons[3, "q1"]
    assert [(r.doc_id, r.question_id) for r in got.outages.collect()] == [(2, "q2")]
    fates = judges.attempt_fate(got.attempts.withColumn("outcome", F.regexp_replace("outcome", "unusable", "invalid")).withColumn("shrinks", F.lit(0)), ["doc_id", "question_id"])
    assert {(r.doc_id, r.question_id): r.fate for r in fates.collect()} == {(1, "q1"): "done", (1, "q2"): "done", (1, "q3"): "ungraded", (2, "q1"): "done", (2, "q2"): "outage", (3, "q1"): "ungraded"}


@pytest.mark.parametrize("outcome,fate", [("transient", "outage"), ("permanent", "outage"), ("invalid", "ungraded"), ("too_large", "ungraded"), ("ok", "judged")])
def test_ask_with_a_judge_that_always_fails(spark, outcome, fate):
    answers = spark.createDataFrame([(1, "q1", "word " * 400)], "doc_id long, question_id string, text string")
    got = ask.ask(answers, lambda b: b.assign(outcome=outcome, raw="{}"), 500, pause=lambda s: None)
    assert {"outage": got.outages, "ungraded": got.ungraded, "judged": got.replies}[fate].count() >= 1
    assert sum(t.count() > 0 for t in (got.outages, got.ungraded, got.replies)) == 1
