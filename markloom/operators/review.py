"""Paper totals, confidence, the review decision with its reasons, and result invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.marks import REVIEW_BELOW, paper_confidence, round4


def paper_totals(questions: DataFrame, keys: list[str]) -> DataFrame:
    """total, max_marks, confidence of each paper and which of its questions are shaky, blank or ungraded.

    questions: keys, number, awarded, max_marks, confidence, state. A paper's questions are a few: shaky lists their
    (number, confidence), blanks and undone their numbers, in order; unsure, blank and ungraded count them.
    """
    state, some = F.col("state"), lambda when, value: F.sort_array(F.collect_list(F.when(when, value)))
    out = questions.groupBy(*keys).agg(
        round4(F.sum("awarded")).alias("total"), round4(F.sum("max_marks")).alias("max_marks"), paper_confidence(F.col("confidence"), F.col("max_marks")).alias("confidence"),
        some((state == "graded") & (F.col("confidence") < REVIEW_BELOW), F.struct("number", "confidence")).alias("shaky"), some(state == "blank", F.col("number")).alias("blanks"), some(state == "ungraded", F.col("number")).alias("undone"),
    )
    return out.withColumns({"unsure": F.size("shaky").cast("long"), "blank": F.size("blanks").cast("long"), "ungraded": F.size("undone").cast("long")})


def audit_counts(audit: DataFrame, keys: list[str]) -> DataFrame:
    """Clamps, unverified quotes, missing criteria and recomputed totals of each paper, in one pass."""
    one = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return audit.groupBy(*keys).agg(one("clamped_above_max", "clamped_below_zero").alias("clamped"), one("evidence_unverified").alias("unverified"), one("rubric_criterion_missing").alias("unmarked"), one("total_recomputed").alias("recomputed"))


def review_reasons(scan_unread: Column | None = None) -> Column:
    """Why a person should look at a paper; columns as of `decide`. An unread scan comes first."""
    many = lambda n, one, more: F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {more}")))
    percent = lambda v: F.floor(v * 100 + 0.5).cast("string")
    named = lambda numbers: F.concat(F.lit(" (Q"), F.array_join(numbers.cast("array<string>"), ", Q"), F.lit(")"))
    c = F.col
    overall = F.when(c("confidence") < REVIEW_BELOW, F.concat(F.lit("Overall confidence is "), percent(c("confidence")), F.lit("%.")))
    shaky = F.transform("shaky", lambda q: F.concat(F.lit("Question "), q["number"].cast("string"), F.lit(" has a confidence of only "), percent(q["confidence"]), F.lit("%.")))
    rules = [
        (c("blank") > 0, F.concat(many(c("blank"), "question was", "questions were"), F.lit(" detected as unanswered"), named(c("blanks")), F.lit("."))),
        (c("ungraded") > 0, F.concat(many(c("ungraded"), "question", "questions"), F.lit(" could not be marked automatically"), named(c("undone")), F.lit("."))),
        (c("clamped") > 0, F.concat(many(c("clamped"), "mark was", "marks were"), F.lit(" out of range and corrected."))),
        (c("unverified") > 0, F.concat(many(c("unverified"), "quotation", "quotations"), F.lit(" could not be found in the answer."))),
        (c("unmarked") > 0, F.concat(many(c("unmarked"), "rubric point", "rubric points"), F.lit(" had no judgement."))),
    ]
    reasons = F.array_compact(F.concat(F.array(overall), shaky, F.array(*[F.when(applies, said) for applies, said in rules])))
    if scan_unread is None:
        return reasons
    return F.when(F.coalesce(scan_unread, F.lit(False)), F.array_prepend(reasons, F.lit("The script is a scan that could not be read; zeros for what is on its pages are no judgement of the work."))).otherwise(reasons)


def decide(totals: DataFrame, counts: DataFrame, keys: list[str], scan_unread: Column | None = None) -> DataFrame:
    """totals with audit counts, reasons and needs_review."""
    joined = totals.join(counts, keys, "left").fillna(0, ["clamped", "unverified", "unmarked", "recomputed"])
    out = joined.withColumn("reasons", review_reasons(scan_unread))
    return out.withColumn("needs_review", F.size("reasons") > 0)


def violations(scores: DataFrame, questions: DataFrame, papers: DataFrame, paper: list[str], question: list[str]) -> DataFrame:
    """Broken invariants of results (paper keys, rule): sums and bounds at both levels, at six places."""
    same = lambda a, b: F.abs(a - b) < 1e-6
    sums = scores.groupBy(*question).agg(F.sum("mark").alias("_sum"), F.max(F.when((F.col("mark") < 0) | (F.col("mark") > F.col("max_marks") + 1e-6), 1).otherwise(0)).alias("_bad"))
    q = questions.filter("state = 'graded'").join(sums, question)
    rows = [
        q.filter(~same(F.col("_sum"), F.col("awarded"))).select(*paper, F.lit("question is not the sum of its criteria").alias("rule")),
        q.filter("_bad = 1").select(*paper, F.lit("criterion mark out of range").alias("rule")),
        questions.filter((F.col("awarded") < 0) | (F.col("awarded") > F.col("max_marks") + 1e-6)).select(*paper, F.lit("question mark out of range").alias("rule")),
    ]
    totals = questions.groupBy(*paper).agg(F.sum("awarded").alias("_sum")).join(papers, paper)
    rows.append(totals.filter(~same(F.col("_sum"), F.col("total"))).select(*paper, F.lit("total is not the sum of its questions").alias("rule")))
    rows.append(papers.filter(F.col("total") > F.col("max_marks") + 1e-6).select(*paper, F.lit("total over the maximum").alias("rule")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def enforce(papers: DataFrame, broken: DataFrame, paper: list[str]) -> DataFrame:
    """Papers with a violation get confidence 0 and go to review, saying why."""
    said = broken.groupBy(*paper).agg(F.sort_array(F.collect_set("rule")).alias("_rules"))  # five rules at most
    out = papers.join(said, paper, "left")
    bad = F.col("_rules").isNotNull()
    return out.withColumns({
        "confidence": F.when(bad, 0.0).otherwise(F.col("confidence")),
        "needs_review": bad | F.col("needs_review"),
        "reasons": F.when(bad, F.array_union("reasons", "_rules")).otherwise(F.col("reasons")),
    }).drop("_rules")
