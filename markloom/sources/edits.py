"""Edits of annotations by people, as a table of requests: each is checked, and those that pass are applied at once.

Requests are (edit_id, action, annotation_id, body, at), the action create, update or delete, the body a JSON object; they
count in order of (at, edit_id). Of several updates of one annotation each field has its last value. Nothing here changes
a mark. Fields that nobody knows are ignored; null and missing differ for a correction alone, which null takes away.

Defined cases: a body that isn't a JSON object, an update without a field, a kind or severity that doesn't exist and a box
off the page are invalid, with the place of each fault; an annotation that isn't there, or was deleted before, is not
found; no requests change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.validate import FINDING_KINDS, SEVERITIES

FIELDS = ("rect", "comment", "correction", "kind", "severity")
SIDES = ("x", "y", "width", "height")
BODY = "rect STRUCT<page: DOUBLE, x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>, comment STRING, correction STRING, kind STRING, severity STRING, questionId STRING, criterionId STRING"


def checked(edits: DataFrame) -> DataFrame:
    """edits with `_b` (the body), `_has` (its fields) and `errors`: messages with their place; none if it may be applied."""
    parsed = edits.withColumn("_has", F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>"))).withColumn("_b", F.from_json("body", BODY))
    b, has = F.col("_b"), lambda f: F.array_contains("_has", f)
    rect = b["rect"]
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    one_of = lambda f, allowed: (has(f) & bad(b[f].isin(*allowed)), f"{f}: Expected one of {', '.join(allowed)}")
    asked = (F.col("action") == "create") | has("rect")
    rules: list[tuple[Column, str]] = [
        (~F.coalesce(F.startswith(F.ltrim("body"), F.lit("{")), F.lit(False)) | F.json_object_keys("body").isNull(), "(root): not a JSON object"),
        ((F.col("action") == "update") & ~F.arrays_overlap("_has", F.array(*map(F.lit, FIELDS))), "(root): Provide at least one field to update."),
        (asked & rect.isNull(), "rect: Required"),
        (asked & rect.isNotNull() & bad((rect["page"] >= 0) & (rect["page"] == F.floor(rect["page"]))), "rect.page: Expected a whole number, 0 or more"),
        *[(asked & rect.isNotNull() & bad(rect[s].between(0, 1)), f"rect.{s}: Expected a number from 0 to 1") for s in SIDES],
        (has("comment") & b["comment"].isNull(), "comment: Expected text"),
        one_of("kind", FINDING_KINDS),
        one_of("severity", SEVERITIES),
    ]
    needs = F.col("action").isin("create", "update")
    found = F.array_compact(F.array(*[F.when(needs & wrong, F.lit(m)) for wrong, m in rules]))
    unknown = F.when(~F.coalesce(F.col("action").isin("create", "update", "delete"), F.lit(False)), F.array(F.lit("action: Expected one of create, update, delete")))
    return parsed.withColumn("errors", F.coalesce(unknown, F.when(F.array_contains(found, "(root): not a JSON object"), F.slice(found, 1, 1)).otherwise(found)))


def apply_edits(annotations: DataFrame, edits: DataFrame, result_id: str = "result_id") -> tuple[DataFrame, DataFrame]:
    """(annotations, outcomes): annotations (id, result_id, rect, extra_rects, comment, correction, kind, severity, edited_by_human,
    updated_at and further columns) after all edits that pass; outcomes: edit_id, outcome (applied, invalid, not_found), errors.

    A created annotation gets its edit's annotation_id as id; a box that is moved stands alone. Columns that a created one
    doesn't have are null.
    """
    told = checked(edits)
    sound = told.filter(F.size("errors") == 0).withColumn("_at", F.struct("at", "edit_id"))
    there = annotations.select(F.col("id").alias("annotation_id"), F.lit(True).alias("_there")).distinct()
    of = Window.partitionBy("annotation_id")
    born = F.min(F.when(F.col("action") == "create", F.col("_at"))).over(of)
    gone = F.min(F.when((F.col("action") == "delete") & (F.col("_there") | (F.col("_at") > born)), F.col("_at"))).over(of)
    met = sound.join(there, "annotation_id", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    seen = met.withColumns({"_born": born, "_gone": gone})
    alive = (F.col("_there") | (F.col("_at") >= F.col("_born"))) & (F.col("_gone").isNull() | (F.col("_at") <= F.col("_gone")))
    again = (F.col("action") == "create") & (F.col("_there") | (F.col("_at") > F.col("_born")))
    fated = seen.withColumn("_ok", F.coalesce(alive & ~again, F.lit(False)))
    outcomes = told.filter(F.size("errors") > 0).select("edit_id", F.lit("invalid").alias("outcome"), "errors").unionByName(fated.select("edit_id", F.when(F.col("_ok"), "applied").otherwise("not_found").alias("outcome"), "errors"))

    good = fated.filter("_ok")
    last = lambda f: F.max(F.when(F.array_contains("_has", f), F.struct("_at", F.col(f"_b.{f}").alias("v")))).alias(f"_{f}")
    per = good.groupBy("annotation_id").agg(*[last(f) for f in FIELDS], F.max("at").alias("_when"), F.bool_or(F.col("action") == "delete").alias("_dead"), F.bool_or(F.col("action") == "create").alias("_new"), F.max(F.when(F.col("action") == "create", F.col("_b"))).alias("_first"), F.max(F.when(F.col("action") == "create", F.col("result_id"))).alias("_result"))
    kinds = {f.name: f.dataType for f in annotations.schema}
    new = lambda f: F.col(f"_{f}.v").cast(kinds[f])
    changed = annotations.join(per.filter("NOT _new"), annotations["id"] == per["annotation_id"], "left").filter("_dead IS NULL OR NOT _dead")
    touched = F.col("_when").isNotNull()
    set_ = {f: F.when(F.col(f"_{f}").isNotNull(), new(f)).otherwise(annotations[f]) for f in FIELDS}
    set_ |= {"extra_rects": F.when(F.col("_rect").isNotNull(), F.slice("extra_rects", 1, 0)).otherwise(F.col("extra_rects")), "edited_by_human": F.when(touched, True).otherwise(F.col("edited_by_human")), "updated_at": F.when(touched, F.col("_when")).otherwise(F.col("updated_at"))}
    kept = changed.select(*[(set_[c].alias(c) if c in set_ else annotations[c]) for c in annotations.columns])
    drawn = per.filter("_new AND NOT _dead")
    given = {"id": F.col("annotation_id"), result_id: F.col("_result"), "rect": new("rect"), "extra_rects": F.array().cast(kinds["extra_rects"]), "comment": F.coalesce(new("comment"), F.lit("")), "correction": new("correction"), "kind": F.coalesce(new("kind"), F.lit("incorrect")), "severity": F.coalesce(new("severity"), F.lit("major")), "edited_by_human": F.lit(True), "updated_at": F.col("_when"), "anchor_status": F.lit("exact"), "origin": F.lit("human"), "question_id": F.col("_first.questionId"), "criterion_id": F.col("_first.criterionId")}
    made = drawn.select(*[(given[c] if c in given else F.lit(None)).cast(kinds[c]).alias(c) for c in annotations.columns])
    return kept.unionByName(made), outcomes
