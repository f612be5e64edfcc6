"""The rule judge: the first rule that matches, as a relation; and the protocol for other judges.

Rules are rows (criterion_id, description, phase, ordinal, is_regex, pattern, comment, correction) with phases fault,
award, partial, weak, missing. They meet answers on the criterion's id and its wording, so that a rule never fires on
another paper's criterion of the same id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RULE_THRESHOLD, find_phrase, normalise, sentence_around, source_offsets, window_around

RULES = "criterion_id string, description string, phase string, ordinal int, is_regex boolean, pattern string, comment string, correction string"
#: Surface errors noted for each answer. Fixed value.
MOST_SURFACE = 6


def match_rules(answers: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Every rule of every criterion with its place in the answer: keys, criterion_id, phase, ordinal, from, to (null if none).

    answers: keys, criterion_id, description, max_marks, text.
    """
    named = rules.select("criterion_id", normalise(F.col("description")).alias("_d"), "phase", "ordinal", "is_regex", "pattern", "comment", "correction")
    met = answers.withColumn("_d", normalise(F.col("description"))).join(named, ["criterion_id", "_d"]).drop("_d")
    literal = met.filter("NOT is_regex AND phase != 'missing'")
    found = literal.withColumn("_f", find_phrase(normalise(F.col("text")), normalise(F.col("pattern")), RULE_THRESHOLD)).withColumn("_o", F.when(F.col("_f").isNotNull(), source_offsets(F.col("text"))))
    located = found.withColumn("from", F.get("_o", F.col("_f.start"))).withColumn("to", F.get("_o", F.col("_f.end") - 1) + 1).drop("_f", "_o")
    pattern = met.filter("is_regex AND phase != 'missing'")
    at = F.regexp_instr("text", F.col("pattern"))
    raw = pattern.withColumn("from", F.when(at > 0, at - 1)).withColumn("to", F.when(at > 0, at - 1 + F.length(F.regexp_substr("text", F.col("pattern")))))
    none = met.filter("phase = 'missing'").withColumn("from", F.lit(None).cast("int")).withColumn("to", F.lit(None).cast("int"))
    return located.unionByName(raw).unionByName(none)


def rule_judgements(answers: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, criterion_id, awarded, status, quote, finding_quote, comment, correction) for every criterion that has rules.

    fault: 0, incorrect. award: the full mark, or half where a partial matches too. weak: 0, incorrect. Else missing.
    """
    matched = match_rules(answers, rules, keys)
    hit = F.col("from").isNotNull()
    first = lambda phase: F.min(F.when((F.col("phase") == phase) & (hit | F.lit(phase == "missing")), F.struct("ordinal", "from", "to", "comment", "correction"))).alias(phase)
    one = matched.groupBy(*keys, "criterion_id").agg(F.first("max_marks").alias("max_marks"), F.first("text").alias("text"), *[first(p) for p in ("fault", "award", "partial", "weak", "missing")])
    c = F.col
    kind = F.when(c("fault").isNotNull(), "fault").when(c("award").isNotNull() & c("partial").isNotNull(), "partial").when(c("award").isNotNull(), "award").when(c("weak").isNotNull(), "weak").otherwise("missing")
    one = one.withColumn("_k", kind)
    quoted = F.when(c("_k") == "fault", c("fault")).when(c("_k").isin("partial", "award"), c("award")).when(c("_k") == "weak", c("weak"))
    told = F.when(c("_k") == "partial", c("partial")).when(c("_k") == "award", c("award")).otherwise(F.coalesce(quoted, c("missing")))
    one = one.withColumn("_q", quoted).withColumn("_t", told)
    quote = F.when(c("_q").isNotNull(), sentence_around(c("text"), c("_q.from"), c("_q.to")))
    return one.select(
        *keys, "criterion_id", F.when(c("_k") == "award", c("max_marks")).when(c("_k") == "partial", c("max_marks") / 2).otherwise(0.0).alias("awarded"),
        F.when(c("_k").isin("fault", "weak"), "incorrect").when(c("_k") == "partial", "partial").when(c("_k") == "award", "correct").otherwise("missing").alias("status"), quote.alias("quote"),
        F.when(c("_k") == "partial", window_around(c("text"), c("partial.from"), c("partial.to"), 6)).otherwise(quote).alias("finding_quote"), c("_t.comment").alias("comment"), c("_t.correction").alias("correction"),
    )


def surface_errors(answers: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """The first six slips of each answer, in table order: quoted with four words around; they never cost marks.

    errors: ordinal, wrong, right and, if there, kind (spelling or grammar).
    """
    kind = F.col("kind") if "kind" in errors.columns else F.lit("spelling")
    known = errors.select(F.col("ordinal").alias("_o"), "wrong", "right", kind.alias("kind"))
    at = F.instr("text", F.col("wrong"))
    met = answers.select(*keys, "text").join(known, F.contains("text", "wrong"))
    hits = met.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))).filter(F.col("_n") <= MOST_SURFACE)
    comment = F.concat(F.lit('"'), "wrong", F.lit('" should be "'), "right", F.lit('".'))
    return hits.select(*keys, "wrong", "right", "kind", comment.alias("comment"), F.lit("minor").alias("severity"), window_around(F.col("text"), at - 1, at - 1 + F.length("wrong"), 4).alias("quote"))


def unjudgeable(asked: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) of questions that the rule judge can't mark: inferred (its criteria are nobody's rules), or
    unsupported (no rule knows any of its criteria).

    asked: keys, criterion_id, description and, if there, source (instructor or ai-inferred).
    """
    known = rules.select("criterion_id", normalise(F.col("description")).alias("_d")).distinct().withColumn("_k", F.lit(True))
    inferred = F.col("source") == "ai-inferred" if "source" in asked.columns else F.lit(False)
    met = asked.withColumn("_d", normalise(F.col("description"))).join(known, ["criterion_id", "_d"], "left")
    one = met.groupBy(*keys).agg(F.bool_or(F.coalesce(inferred, F.lit(False))).alias("_i"), F.count("_k").alias("_n"))
    return one.filter("_i OR _n = 0").select(*keys, F.when(F.col("_i"), "inferred").otherwise("unsupported").alias("reason"))


def self_confidence(judged: DataFrame, keys: list[str]) -> DataFrame:
    """0.92 less 0.12 for each missing criterion, at least 0.35."""
    return judged.groupBy(*keys).agg(F.greatest(F.lit(0.35), 0.92 - 0.12 * F.count_if(F.col("status") == "missing")).alias("self"))


#: A judge of another make: batches of answers in, raw judgements out (columns result_id, question_id, pass_no, raw).
Judge = Callable[[pd.DataFrame], pd.DataFrame]


def judge_with(answers: DataFrame, judge: Judge, schema: str = "result_id string, question_id string, pass_no int, raw string") -> DataFrame:
    """Raw judgements of a pluggable judge, which runs on Arrow batches inside the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield judge(batch)

    return answers.mapInPandas(run, schema)


# Judges that misbehave, for tests of everything behind them.


def truncated(judge: Judge) -> Judge:
    return lambda batch: judge(batch).assign(raw=lambda d: d["raw"].str.slice(0, 40))


def in_prose(judge: Judge) -> Judge:
    return lambda batch: judge(batch).assign(raw=lambda d: "Here you are: " + d["raw"] + " I hope this helps.")


def not_json(judge: Judge) -> Judge:
    return lambda batch: judge(batch).assign(raw="I cannot grade this.")


def attempt_fate(attempts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """What follows the last attempt of each request: done, retry (with its wait), repair, split, ungraded or outage.

    attempts: keys, attempt, outcome (ok, transient, invalid, too_large), repairs, shrinks.
    """
    last = attempts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("attempt").desc()))).filter("_n = 1")
    fate = (
        F.when(F.col("outcome") == "ok", "done").when((F.col("outcome") == "transient") & (F.col("attempt") < most), "retry").when(F.col("outcome") == "transient", "outage")
        .when((F.col("outcome") == "invalid") & (F.col("repairs") < 1), "repair").when(F.col("outcome") == "invalid", "ungraded").when(F.col("shrinks") < 3, "split").otherwise("ungraded")
    )
    wait = F.when(fate == "retry", (F.lit(400) * F.pow(F.lit(2.0), F.col("attempt") - 1)).cast("long"))
    return last.select(*keys, "attempt", "outcome", fate.alias("fate"), wait.alias("wait_ms"))


#: HTTP statuses worth another try, and those of a wrong key. Fixed values.
TRANSIENT, AUTH = (408, 409, 429, 500, 502, 503, 504), (401, 403)
#: What the message of a spent allowance says. Fixed value.
SPENT = "rate limit|too many requests|quota"


def classify_errors(errors: DataFrame, status: str = "status", message: str = "message") -> DataFrame:
    """Adds `kind` (what to say of the error: rate_limit, auth, transient or permanent) and `retryable`.

    A spent allowance is one whatever the status, by its message; a wrong key goes by status alone. What is worth another
    try goes by status, and an error without one always is.
    """
    code, text = F.col(status), F.lower(F.coalesce(F.col(message), F.lit("")))
    spent = (F.coalesce(code, F.lit(0)) == 429) | text.rlike(SPENT)
    again = F.coalesce(code.isin(*TRANSIENT), F.lit(True))
    kind = F.when(spent, "rate_limit").when(code.isin(*AUTH), "auth").when(again, "transient").otherwise("permanent")
    return errors.withColumns({"kind": kind, "retryable": again})
