"""Grading, end to end: documents, rubric and judgements in; scores, papers, annotations and audit out.

Everything is relational. What several branches read (answers, judgements, anchors, scores) is settled in the checkpoint
folder, so that no branch computes or plans it again and a lost executor costs a re-read. A live judge's raw output should
be written to a table before it comes here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import BLANK_CONFIDENCE, question_confidence
from ..functions.text import is_blank
from ..operators import anchor, diagram, judge, passes, review, segment, validate
from .steps import settled

PAPER, QUESTION = ["doc_id"], ["doc_id", "question_id"]
PASS = [*QUESTION, "pass_no"]


def answers_of(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """(doc_id, question_id, number, text, start_page, approximate, blank) of every document and question."""
    return settled(segment.segments(segment.joined_pages(pages), questions).withColumn("blank", is_blank(F.col("text"))))


def rule_judged(answers: DataFrame, criteria: DataFrame, rules: DataFrame) -> DataFrame:
    """Judgements of the rule judge for answers that aren't blank: it never sees a blank one."""
    asked = answers.filter("NOT blank").join(criteria.select("question_id", "criterion_id", "description", "max_marks"), "question_id")
    judged = settled(judge.rule_judgements(asked.select(*QUESTION, "criterion_id", "description", "max_marks", "text"), rules, QUESTION))
    confidence = judge.self_confidence(judged, QUESTION)
    return judged.join(confidence, QUESTION).withColumn("ordinal", F.row_number().over(Window.partitionBy(*QUESTION).orderBy("criterion_id")))


#: Columns that judgements may leave out, with what stands for them.
OPTIONAL = {"pass_no": ("int", 1), "repairs": ("int", 0), "chars": ("int", None), "summary": ("string", ""), "region": ("struct<page:int,x:double,y:double,width:double,height:double>", None)}
NO_BOXES = "array<struct<page:int,x:double,y:double,width:double,height:double>>"


def _complete(judgements: DataFrame) -> DataFrame:
    there = {c: F.coalesce(F.col(c).cast(kind), F.lit(value).cast(kind)) if c in judgements.columns else F.lit(value).cast(kind) for c, (kind, value) in OPTIONAL.items()}
    return judgements.withColumns(there)


def grade(pages: DataFrame, questions: DataFrame, criteria: DataFrame, judgements: DataFrame, runs: DataFrame | None = None, answers: DataFrame | None = None, documents: DataFrame | None = None, ungraded: DataFrame | None = None) -> dict[str, DataFrame]:
    """scores, questions, papers, annotations, audit and violations.

    judgements: doc_id, question_id, ordinal, criterion_id, awarded, status, quote, finding_quote, comment, correction, self;
    and, where the judge gives them, pass_no (an answer judged in passages), repairs, chars (of a passage), summary and
    region (a box of a finding, page, x, y, width, height). documents: doc_id, transcription (done, pending, unsupported,
    failed, or null for a text layer), unclear (spans that a transcript couldn't read). ungraded: doc_id, question_id,
    reason, of questions whose judgement could not be used.
    """
    answers = answers if answers is not None else answers_of(pages, questions)
    marked = answers.filter("NOT blank")
    asked = marked if ungraded is None else marked.join(ungraded.select(*QUESTION).distinct(), QUESTION, "left_anti")
    said = _complete(judgements)
    passed = asked.join(said.select(*PASS).distinct(), QUESTION, "left").withColumn("pass_no", F.coalesce("pass_no", F.lit(1)))
    rubric = passed.select(*PASS, "number").join(criteria, "question_id")
    judged = said.select(*PASS, "ordinal", "criterion_id", F.col("awarded").cast("double").alias("awarded"), "status", "quote")
    scored = settled(validate.score_criteria(rubric.select(*PASS, "number", "criterion_id", "description", "max_marks", F.col("ordinal").alias("place")), judged, PASS))
    unknown = validate.unknown_judgements(rubric, judged.join(asked.select(*QUESTION), QUESTION, "left_semi"), PASS)
    # Quotes are verified against the whole document, without a hint.
    ids = [*PASS, "criterion_id"]
    quotes = validate.last_judgements(judged, PASS).select(*ids, "quote", "status").withColumn("hint", F.lit(None).cast("int"))
    cited = quotes.filter(F.length(F.trim(F.coalesce("quote", F.lit("")))) > 0)
    anchors = settled(anchor.anchor_quotes(cited, pages, runs, ids))
    every = scored.join(quotes.select(*ids, "quote", F.col("status").alias("judged")), ids, "left").join(anchors.select(*ids, F.col("status").alias("anchor"), "similarity", "matched_text", "rects"), ids, "left")
    every = every.withColumn("verified", F.when(F.col("anchor").isNotNull(), F.col("anchor").isin("exact", "fuzzy"))).withColumn("status", F.coalesce("judged", F.lit("missing"))).drop("judged")
    every = settled(every)
    scores = settled(passes.best_scores(every, QUESTION))

    placed, dropped = place_annotations(said, asked, pages, runs)
    placed = settled(placed)
    at = placed.groupBy(*QUESTION).agg(F.count_if(F.col("anchor_status") == "unresolved").alias("unresolved"), F.count_if(F.col("anchor_status") == "region").alias("regions"))
    totals = settled(validate.question_totals(scored, PASS))
    cites = every.groupBy(*PASS).agg(F.count("anchor").alias("quoted"), F.count_if("verified").alias("verified"))
    selves = said.groupBy(*PASS).agg(F.max("self").alias("self"), F.max("repairs").alias("repairs"), F.max("chars").alias("_chars"), F.max("summary").alias("summary"))
    drafts = totals.join(cites, PASS).join(selves, PASS, "left").join(asked.select(*QUESTION, "approximate", F.length("text").alias("_whole")), QUESTION)
    drafts = drafts.withColumns({"self": F.coalesce("self", F.lit(0.0)), "repairs": F.coalesce("repairs", F.lit(0)), "chars": F.coalesce("_chars", "_whole"), "summary": F.coalesce("summary", F.lit("")), "notes": F.array().cast("array<string>")})
    merged = passes.merge_drafts(drafts, QUESTION).join(passes.merged_totals(scores, QUESTION).withColumnRenamed("awarded", "_merged"), QUESTION)
    alone = totals.groupBy(*QUESTION).agg(F.max("awarded").alias("_alone"), F.max("max_marks").alias("max_marks"))  # of a single pass: its snapped sum
    read = documents_of(documents, answers)
    known = merged.join(alone, QUESTION).join(asked.select(*QUESTION, "number"), QUESTION).join(at, QUESTION, "left").join(read, PAPER, "left").fillna(0, ["unresolved", "regions"])
    confidence = question_confidence({c: F.col(c) for c in ("self", "quoted", "verified", "clamps", "repairs", "missing", "chars", "approximate", "transcribed", "unclear", "unresolved", "regions")})
    awarded = F.when(F.col("passes") == 1, F.col("_alone")).otherwise(F.col("_merged"))
    graded = known.withColumn("_c", confidence).select(*QUESTION, "number", F.lit("graded").alias("state"), awarded.alias("awarded"), "max_marks", F.col("_c.value").alias("confidence"), F.concat("notes", "_c.factors").alias("factors"))
    worth = criteria.groupBy("question_id").agg(F.sum("max_marks").alias("max_marks"))

    def unjudged(rows: DataFrame, state: str, confidence: float, factors: Column) -> DataFrame:
        return rows.join(worth, "question_id").select(*QUESTION, "number", F.lit(state).alias("state"), F.lit(0.0).alias("awarded"), "max_marks", F.lit(confidence).alias("confidence"), factors.alias("factors"))

    none = F.array().cast("array<string>")
    results = graded.unionByName(unjudged(answers.filter("blank"), "blank", BLANK_CONFIDENCE, none))
    if ungraded is not None:
        undone = marked.join(ungraded.groupBy(*QUESTION).agg(F.min("reason").alias("reason")), QUESTION)
        results = results.unionByName(unjudged(undone, "ungraded", 0.0, F.array("reason")))
    results = settled(results)

    def event(rows: DataFrame, kind: str, criterion: Column, detail: Column, after: float | None = None) -> DataFrame:
        return rows.select(*QUESTION, F.lit(kind).alias("kind"), criterion.cast("string").alias("criterion_id"), detail.alias("detail"), F.lit(None).cast("double").alias("before"), F.lit(after).cast("double").alias("after"))

    nobody = F.lit(None)
    parts = [
        validate.audit_rows(scored, unknown, totals, PASS).drop("pass_no"),
        event(every.filter("anchor = 'unresolved'"), "evidence_unverified", F.col("criterion_id"), F.lit("The quote cited does not appear in the answer.")),
        event(dropped, "evidence_unverified", F.col("criterion_id"), F.col("detail")),
        event(placed.filter("anchor_status = 'unresolved'"), "anchor_unresolved", nobody, F.lit("An annotation has no place on the page and stands in the margin.")),
        event(answers.filter("blank"), "blank_answer_detected", nobody, F.lit("No answer text found for this question. Scored 0 without asking the judge."), 0.0),
        event(selves.filter("repairs > 0"), "malformed_output_repaired", nobody, F.lit("The judge's first reply was malformed and was put right when asked again.")),
    ]
    if ungraded is not None:
        parts.append(event(undone, "malformed_output_unrecoverable", nobody, F.col("reason")))
    audit = settled(reduce(DataFrame.unionByName, parts))

    totalled = review.paper_totals(results, PAPER).join(read.select(*PAPER, "scan_unread"), PAPER, "left")
    papers = settled(review.decide(totalled, review.audit_counts(audit, PAPER), PAPER, F.col("scan_unread")))
    broken = review.violations(scores, results, papers, PAPER, QUESTION)
    papers = review.enforce(papers, broken, PAPER)
    return {"scores": scores, "questions": results, "papers": papers, "annotations": placed, "audit": audit, "violations": broken}


def documents_of(documents: DataFrame | None, answers: DataFrame) -> DataFrame:
    """(doc_id, transcribed, unclear, scan_unread) of every document answered in."""
    if documents is None:
        return answers.select(*PAPER).distinct().withColumns({"transcribed": F.lit(False), "unclear": F.lit(0), "scan_unread": F.lit(False)})
    status = F.col("transcription")
    return documents.select(*PAPER, F.coalesce(status == "done", F.lit(False)).alias("transcribed"), F.coalesce("unclear", F.lit(0)).alias("unclear"), F.coalesce(status != "done", F.lit(False)).alias("scan_unread"))


def place_annotations(judgements: DataFrame, answers: DataFrame, pages: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotations, audit rows of findings dropped because their quote isn't in the document).

    A finding stands at its quote: the widest box, the others as extra_rects; else at the drawing that its region means;
    else in the margin of the last page that its question's boxes touch, or the answer's first page. Of findings with
    neither quote nor region two stay for each question. Annotations are numbered by document.
    """
    ids = [*PASS, "ordinal", "criterion_id"]
    found = _complete(judgements).filter("comment IS NOT NULL").join(answers.select(*QUESTION, "number", "start_page"), QUESTION)
    found = found.select(*ids, "number", "status", F.col("finding_quote").alias("quote"), F.col("start_page").alias("hint"), "comment", "correction", "region")
    kept = validate.place_findings(found, PASS).filter("fate = 'kept'")
    anchors = settled(anchor.anchor_quotes(kept.filter("quote IS NOT NULL").select(*ids, "quote", "hint"), pages, runs, ids))
    sound, dropped = validate.drop_unanchored(kept, anchors, ids)
    at = anchors.select(*ids, F.col("status").alias("_status"), F.col("rects").alias("_rects"), "approximate")
    placed = sound.join(at, ids, "left").withColumn("_drawn", F.lit(None).cast(NO_BOXES))
    if runs is not None:
        counts = pages.groupBy(*PAPER).agg(F.count(F.lit(1)).cast("int").alias("_pages"))
        boxes = sound.filter("region IS NOT NULL").join(counts, PAPER).select(*ids, diagram.clamp_region(F.col("region"), F.col("_pages")).alias("_r")).select(*ids, "_r.*")
        grounded = diagram.ground(boxes, diagram.drawings(runs), ids).select(*ids, F.array(F.struct("page", "x", "y", "width", "height")).cast(NO_BOXES).alias("_g"))
        placed = placed.join(grounded, ids, "left").withColumn("_drawn", F.col("_g")).drop("_g")
    quoted = F.size(F.coalesce("_rects", F.array().cast(NO_BOXES))) > 0
    lost = F.coalesce("_status", F.lit("unresolved")) == "unresolved"
    boxes = F.when(quoted, F.col("_rects")).when(lost, F.col("_drawn"))
    widest = F.transform(F.sort_array(F.transform("_boxes", lambda r, i: F.struct((-r["width"]).alias("w"), i.alias("i"), r.alias("r")))), lambda x: x["r"])
    status = F.when(F.size("_boxes") == 0, "unresolved").when(~quoted | F.coalesce("approximate", F.lit(False)), "region").otherwise(F.col("_status"))
    placed = placed.withColumn("_boxes", F.coalesce(boxes, F.array().cast(NO_BOXES))).withColumn("_ordered", widest).withColumn("anchor_status", status)
    touched = F.max(F.array_max(F.transform("_boxes", lambda r: r["page"]))).over(Window.partitionBy(*QUESTION))
    slot = F.row_number().over(Window.partitionBy(*PAPER).orderBy("number", "pass_no", "ordinal", "criterion_id")) - 1
    placed = placed.withColumns({"slot": slot, "_margin": F.coalesce(touched, F.col("hint"))})
    kind = F.when(F.col("status") == "correct", "praise").when(F.col("status") == "missing", "missing").otherwise("incorrect")
    rect = F.coalesce(F.get("_ordered", F.lit(0)), anchor.margin_rect(F.col("_margin"), F.col("slot")))
    extra = F.slice("_ordered", 2, F.greatest(F.size("_ordered") - 1, F.lit(0)))
    return placed.select(*QUESTION, "criterion_id", "slot", kind.alias("kind"), "anchor_status", rect.alias("rect"), extra.alias("extra_rects"), "quote", "comment", "correction", F.lit("ai").alias("origin")), dropped
