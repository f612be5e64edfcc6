"""Asking a judge: answers in passages that fit, replies put right once, failures waited for, refused answers in smaller passages.

Rounds are driver steps, a few at most; in each the answers still open are split and judged as one table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunk import split_oversized
from ..operators.judge import Judge
from ..operators.validate import parse_judgements
from .rounds import Check, Rules, rounds
from .steps import settled

#: Tokens of a passage under which splitting has no point, and rounds of halving. Fixed values.
LEAST_PASSAGE, MOST_ROUNDS = 120, 3
#: An answer's passages are asked about three times at most, once with the errors of a reply; it's split as a whole. Fixed values.
PASSAGE = Rules(attempts=3, repairs=1, depth=0, split_unusable=False)
UNUSABLE = "The judge's reply could not be used, even when asked again."


class Asked(NamedTuple):
    """replies: keys, pass_no, chars, raw, repairs. ungraded: keys, reason. outages: keys whose judge could not be reached,
    of which nothing may be kept. attempts: keys, path (of pass_no), attempt, repairs, outcome, wait_ms."""

    replies: DataFrame
    ungraded: DataFrame
    outages: DataFrame
    attempts: DataFrame


def well_formed(replies: DataFrame) -> DataFrame:
    """The check of a judge that replies with judgements: their errors, as `parse_judgements` words them."""
    return parse_judgements(replies).drop("parsed")


def ask(answers: DataFrame, judge: Judge, allowance: int, keys: list[str] | None = None, check: Check | None = None, pause: Callable[[float], None] = time.sleep) -> Asked:
    """Judges answers (keys, text) that aren't blank.

    judge: batches of (keys, pass_no, text, attempt, earlier, errors) in; out, in the same order, `outcome` (ok, too_large,
    transient, invalid or permanent), `raw` and, if wanted, `message`. A reply that `check` finds errors in, or that the
    judge itself calls invalid, is asked for once more with them. An answer with a refused passage is split anew at half the
    allowance and judged again as a whole; one that can't be split further, or whose reply stays unusable, is ungraded.
    Nothing is cut from an answer. An answer that the judge couldn't be reached for is neither judged nor ungraded.
    """
    keys = keys or ["doc_id", "question_id"]
    open_answers, judged, undone, lost, tried = answers.select(*keys, "text"), [], [], [], []

    def checked(replies: DataFrame) -> DataFrame:
        found = check(replies) if check else replies.withColumn("errors", F.array().cast("array<string>"))
        own = F.when(F.col("_message") == "\0invalid", F.array(F.lit("(root): the reply could not be read")))
        return found.withColumn("errors", F.coalesce(own, "errors"))

    def reader(batch):
        out = judge(batch).reset_index(drop=True)
        bad = out["outcome"] == "invalid"
        message = out["message"] if "message" in out else [None] * len(out)
        return out.assign(outcome=out["outcome"].mask(bad, "ok"), message=["\0invalid" if b else m for b, m in zip(bad, message)])

    for k in range(MOST_ROUNDS + 1):
        passages = open_answers.select(*keys, F.posexplode(split_oversized(F.col("text"), allowance)).alias("_n", "text")).select(*keys, F.array(F.col("_n")).alias("path"), "text", (F.col("_n") + 1).alias("pass_no"))
        worked = rounds(settled(passages), reader, keys, PASSAGE, checked, pause)
        tried.append(worked.attempts)
        fates = settled(worked.failed.select(*keys, "fate", "message").distinct())
        out = fates.filter("fate IN ('outage', 'refused')").groupBy(*keys).agg(F.max("message").alias("message"))
        refused = fates.filter("fate = 'too_large'").select(*keys).distinct().join(out, keys, "left_anti")
        invalid = fates.filter("fate = 'unusable'").join(out, keys, "left_anti").join(refused, keys, "left_anti").groupBy(*keys).agg(F.min("message").alias("message"))
        judged.append(worked.answered.join(fates, keys, "left_anti").select(*keys, "pass_no", F.length("text").alias("chars"), "raw", "repairs"))
        undone.append(invalid.select(*keys, F.concat(F.lit(UNUSABLE), F.lit(" "), F.col("message")).alias("reason")))
        lost.append(out)
        if refused.isEmpty():
            break
        if allowance // 2 < LEAST_PASSAGE or k == MOST_ROUNDS:
            undone.append(refused.withColumn("reason", F.lit(f"The answer could not be sent to the judge, even in passages of about {allowance} tokens. Nothing was cut from it; it needs marking by hand.")))
            break
        allowance //= 2
        open_answers = settled(open_answers.join(refused, keys, "left_semi"))
    return Asked(*(reduce(DataFrame.unionByName, t) for t in (judged, undone, lost, tried)))
