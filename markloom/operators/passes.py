"""Several gradings of one answer merged into one: the best mark of each criterion, careful confidence inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import round4


def best_scores(scores: DataFrame, keys: list[str], criterion: str = "criterion_id", ties: list[str] | None = None) -> DataFrame:
    """Of each criterion the pass with the highest mark; of equal ones a verified one, then the first.

    scores: keys, criterion, pass_no, mark, verified. Not `max_by`, which leaves ties open.
    """
    order = [F.col("mark").desc(), F.coalesce("verified", F.lit(False)).desc(), F.col("pass_no"), *(ties or [])]
    return scores.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, criterion).orderBy(*order))).filter("_n = 1").drop("_n")


def merged_totals(best: DataFrame, keys: list[str]) -> DataFrame:
    return best.groupBy(*keys).agg(round4(F.sum("mark")).alias("awarded"))


def merge_drafts(drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence inputs of all passes as one: least self-confidence and missing, most repairs, sums of the rest. `passes` says how many there were, a note too where it was several."""
    several = F.format_string("Judged in %d passages, since the answer is longer than one request allows; each rubric point has its best mark.", F.count(F.lit(1)))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pass_no", c))), lambda x: x[c])  # noqa: E731  a few passes
    return drafts.groupBy(*keys).agg(
        F.min("self").alias("self"), F.sum("quoted").alias("quoted"), F.sum("verified").alias("verified"), F.sum("clamps").alias("clamps"), F.max("repairs").alias("repairs"),
        F.min("missing").alias("missing"), F.sum("chars").alias("chars"), F.bool_or("approximate").alias("approximate"), F.array_distinct(F.filter(listed("summary"), lambda s: s != "")).alias("summaries"),
        F.concat(F.array_distinct(F.flatten(listed("notes"))), F.when(F.count(F.lit(1)) > 1, F.array(several)).otherwise(F.array().cast("array<string>"))).alias("notes"), F.count(F.lit(1)).alias("passes"),
    )


def worst_legibility(pages: DataFrame, keys: list[str]) -> DataFrame:
    """poor over fair over good; null where no page says."""
    rank = F.expr("CASE legibility WHEN 'poor' THEN 3 WHEN 'fair' THEN 2 WHEN 'good' THEN 1 END")
    return pages.groupBy(*keys).agg(F.get(F.array(F.lit(None).cast("string"), F.lit("good"), F.lit("fair"), F.lit("poor")), F.coalesce(F.max(rank), F.lit(0))).alias("legibility"))
