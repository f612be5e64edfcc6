"""Judgements against the rubric: matching, clamping, totals and the audit trail.

Judgements are untrusted: marks exist only against rubric criteria, every total is recomputed, and each correction
leaves a row in the audit. `keys` name what a paper's marks hang on (a result and a question, say); the rubric is a small
table that Spark broadcasts by its size or shuffles on the same keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import GRANULARITY, clamp_kind, clamp_mark, is_finite, snap
from ..plans.steps import dealt, tasks_for

AUDIT = "kind", "criterion_id", "detail", "before", "after"
#: Findings without quote or region that are drawn for each question. Fixed value.
MOST_UNPLACED = 2


def last_judgements(judgements: DataFrame, keys: list[str], criterion: str = "criterion_id", ordinal: str = "ordinal") -> DataFrame:
    """One judgement for each criterion: of several the last."""
    latest = Window.partitionBy(*keys, criterion).orderBy(F.col(ordinal).desc())
    return judgements.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def score_criteria(rubric: DataFrame, judgements: DataFrame, keys: list[str], criterion: str = "criterion_id", awarded: str = "awarded", most: str = "max_marks", step: float = GRANULARITY) -> DataFrame:
    """A row for each rubric row: raw, mark, clamp (audit kind or null), missing.

    A criterion without a judgement scores 0 and is missing. rubric has the keys already (one row for each criterion of
    each result).
    """
    said = last_judgements(judgements, keys, criterion).select(*keys, criterion, F.col(awarded).alias("raw"), F.lit(True).alias("_said"))
    joined = rubric.join(said, [*keys, criterion], "left")
    missing = F.col("_said").isNull()
    kind = F.when(~missing, clamp_kind(F.col("raw"), F.col(most)))
    mark = F.when(missing, 0.0).otherwise(clamp_mark(F.col("raw"), F.col(most), step))
    return joined.withColumns({"clamp": kind, "mark": mark, "missing": missing}).drop("_said")


def unknown_judgements(rubric: DataFrame, judgements: DataFrame, keys: list[str], criterion: str = "criterion_id") -> DataFrame:
    """Judgements of criteria that the rubric doesn't have; they carry no marks."""
    return judgements.join(rubric.select(*keys, criterion), [*keys, criterion], "left_anti")


def question_totals(scores: DataFrame, keys: list[str], most: str = "max_marks", step: float = GRANULARITY) -> DataFrame:
    """awarded (snapped sum of marks), max, raw_total, clamps, missing, recomputed for each question."""
    raw = F.sum(F.when(is_finite(F.col("raw")), F.col("raw")).otherwise(0.0))
    sums = scores.groupBy(*keys).agg(
        snap(F.sum("mark"), step).alias("awarded"), F.sum(most).alias("max_marks"), raw.alias("raw_total"), F.count("clamp").alias("clamps"), F.count_if("missing").alias("missing")
    )
    return sums.withColumn("recomputed", F.abs(F.col("raw_total") - F.col("awarded")) > 1e-9)


def place_findings(findings: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Adds `fate`: kept, noted (nothing to point at, beyond the first two of a question) — before anchoring."""
    has_quote = F.length(F.trim(F.coalesce("quote", F.lit("")))) > 0
    placeable = has_quote | F.col("region").isNotNull()
    order = Window.partitionBy(*keys, placeable).orderBy(ordinal)
    return findings.withColumn("fate", F.when(placeable | (F.row_number().over(order) <= MOST_UNPLACED), "kept").otherwise("noted"))


def drop_unanchored(findings: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(findings kept, audit rows): those whose quote no anchor resolves go, and say so."""
    joined = findings.join(anchors.select(*keys, F.col("status").alias("_status")), keys, "left")
    lost = (F.length(F.trim(F.coalesce("quote", F.lit("")))) > 0) & (F.coalesce("_status", F.lit("unresolved")) == "unresolved")
    said = F.concat(F.lit('An annotation quoted "'), F.substring("quote", 1, 60), F.lit('", which is not in the answer. The annotation was dropped.'))
    audit = joined.filter(lost).select(*keys, F.lit("evidence_unverified").alias("kind"), said.alias("detail"))
    return joined.filter(~lost).drop("_status"), audit


def audit_rows(scores: DataFrame, unknown: DataFrame, totals: DataFrame, keys: list[str], criterion: str = "criterion_id", most: str = "max_marks") -> DataFrame:
    """The audit of a validation: keys, kind, criterion_id, detail, before, after."""
    none = F.lit(None)

    def row(df: DataFrame, kind: Column, of: Column, detail: Column, before: Column, after: Column) -> DataFrame:
        return df.select(*keys, kind.alias("kind"), of.cast("string").alias("criterion_id"), detail.alias("detail"), before.cast("double").alias("before"), after.cast("double").alias("after"))

    name = F.col(criterion).cast("string")
    clamped = scores.filter(F.col("clamp").isNotNull())
    reason = F.when(F.col("clamp") == "clamped_above_max", F.concat(F.lit("Awarded "), F.col("raw"), F.lit(" for a criterion worth "), F.col(most), F.lit("; reduced to the maximum."))).when(is_finite(F.col("raw")), F.concat(F.lit("Awarded "), F.col("raw"), F.lit(", which is negative; raised to 0."))).otherwise(F.lit("Awarded marks were not a finite number; recorded as 0."))
    parts = [
        row(clamped, F.col("clamp"), name, reason, F.when(is_finite(F.col("raw")), F.col("raw")), F.col("mark")),
        row(scores.filter("missing"), F.lit("rubric_criterion_missing"), name, F.concat(F.lit('No judgement for "'), name, F.lit('". Recorded as 0 and flagged for review.')), none, F.lit(0.0)),
        row(unknown, F.lit("unknown_criterion_ignored"), name, F.concat(F.lit('A judgement for "'), name, F.lit('", which is not in the rubric. Ignored.')), none, none),
        row(totals.filter("recomputed"), F.lit("total_recomputed"), none, F.concat(F.lit("Marks summed to "), F.col("raw_total"), F.lit("; recomputed from the corrected criteria.")), F.col("raw_total"), F.col("awarded")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What a criterion's status, a finding's kind and its severity may be. Fixed values.
STATUSES = ("correct", "partial", "missing", "incorrect")
FINDING_KINDS = ("incorrect", "missing", "spelling", "grammar", "layout", "praise")
SEVERITIES = ("minor", "major")
JUDGEMENT_SCHEMA = """questionId STRING, summary STRING, selfConfidence DOUBLE,
 criteria ARRAY<STRUCT<criterionId: STRING, awardedMarks: DOUBLE, status: STRING, evidenceQuote: STRING, reasoning: STRING, correction: STRING>>,
 findings ARRAY<STRUCT<criterionId: STRING, kind: STRING, quote: STRING, region: STRUCT<page: INT, x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>, comment: STRING, correction: STRING, severity: STRING>>"""


def parse_judgements(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds `parsed` (struct) and `errors`: messages with their path, array places included; empty if it is well-formed.

    Null and missing are the same; what may be null isn't asked for.
    """
    from ..functions.text import salvage_json

    parsed = raw.withColumn("_json", salvage_json(F.col(column))).withColumn("parsed", F.from_json("_json", JUDGEMENT_SCHEMA))
    p, there = F.col("parsed"), F.col("_json").isNotNull()

    def required(of: Column, field: str) -> tuple[Column, str]:
        return of[field].isNull(), f"{field}: Required"

    def one_of(of: Column, field: str, allowed: tuple[str, ...]) -> tuple[Column, str]:
        return ~F.coalesce(of[field].isin(*allowed), F.lit(False)), f"{field}: Expected one of {', '.join(allowed)}"

    def each(field: str, rules: Callable[[Column], list[tuple[Column, str]]]) -> Column:
        say = lambda x, i: F.array_compact(F.array(*[F.when(bad, F.concat(F.lit(f"{field}."), i.cast("string"), F.lit(f".{m}"))) for bad, m in rules(x)]))
        return F.flatten(F.transform(F.coalesce(p[field], F.array()), say))

    root = [(~there, "(root): not a JSON object"), *[(there & bad, m) for bad, m in (required(p, f) for f in ("questionId", "criteria", "findings", "summary", "selfConfidence"))]]
    in_criteria = each("criteria", lambda c: [required(c, "criterionId"), required(c, "awardedMarks"), one_of(c, "status", STATUSES), required(c, "reasoning")])
    box = lambda f: [(f["region"].isNotNull() & f["region"][k].isNull(), f"region.{k}: Required") for k in ("page", "x", "y", "width", "height")]
    page = lambda f: (F.coalesce(f["region"]["page"] < 0, F.lit(False)), "region.page: Expected 0 or more")
    in_findings = each("findings", lambda f: [one_of(f, "kind", FINDING_KINDS), required(f, "comment"), one_of(f, "severity", SEVERITIES), *box(f), page(f)])
    said = F.array_compact(F.array(*[F.when(bad, F.lit(m)) for bad, m in root]))
    return parsed.withColumn("errors", F.concat(said, in_criteria, in_findings)).drop("_json")


#: Questions whose criteria one task adds up. It orders the work, not the result.
TASK_QUESTIONS = 25_000


def rubric_errors(criteria: DataFrame, questions: DataFrame, rubrics: DataFrame, tasks: int | None = None) -> DataFrame:
    """Broken arithmetic of rubrics: criteria against question, questions against paper, ids twice (rubric_id, question_id, error).

    tasks: those that share the questions, one for TASK_QUESTIONS of them unless given, so that a task's memory doesn't grow with the input.
    """
    keys = ["rubric_id", "question_id"]
    tasks = tasks or tasks_for(questions, TASK_QUESTIONS)
    sums = dealt(criteria, tasks, *keys).groupBy(*keys).agg(F.sum("max_marks").alias("_sum"), (F.count("criterion_id") - F.count_distinct("criterion_id")).alias("_twice"))
    q = dealt(questions, tasks, *keys).join(sums, keys, "left")
    wrong = F.when(F.abs(F.coalesce("_sum", F.lit(0.0)) - F.col("max_marks")) > 1e-9, "criteria do not add up to the question")
    found = q.select(*keys, F.explode(F.array_compact(F.array(wrong, F.when(F.col("_twice") > 0, "a criterion id occurs twice")))).alias("error"))
    total = questions.groupBy("rubric_id").agg(F.sum("max_marks").alias("_sum")).join(rubrics, "rubric_id", "right")
    paper = total.filter(F.abs(F.coalesce("_sum", F.lit(0.0)) - F.col("total_marks")) > 1e-9).select("rubric_id", F.lit(None).cast("string").alias("question_id"), F.lit("questions do not add up to the paper").alias("error"))
    return found.unionByName(paper)
