"""Rubrics read end to end: parsed where the scheme's layout is known, else read by a judge in pieces and joined by number.

The question paper is read first, so that every piece of the scheme is read with the questions and marks there are, and the
scheme is cut at their bare numbers too. Pieces go through `rounds`: what a judge refuses or misreads is read in smaller
parts, in order. Worked answers are the scheme's own text, cut at the headings; a judge's copy stands in only where a
heading isn't found. Questions without criteria get a judge's, or one that says so.

Defined cases: a document of which a piece can't be read, or in which no question with marks is found, is a failure with its
reasons and gives no rubric; questions that only one side has are warnings; no question paper leaves prompts empty.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import salvage_json
from ..operators import chunk, rubric
from .rounds import Reader, Rules, rounds
from .steps import settled

FLAGS = "continuesFromPreviousChunk: BOOLEAN, continuesIntoNextChunk: BOOLEAN"
PAPER = f"questions ARRAY<STRUCT<number: INT, subject: STRING, prompt: STRING, maxMarks: DOUBLE, requiresDiagram: BOOLEAN, {FLAGS}>>"
SCHEME = f"questions ARRAY<STRUCT<number: INT, maxMarks: DOUBLE, modelAnswer: STRING, guidance: ARRAY<STRING>, requiresDiagram: BOOLEAN, criteria: ARRAY<STRUCT<description: STRING, maxMarks: DOUBLE>>, {FLAGS}>>"
INFERRED = "criteria ARRAY<STRUCT<description: STRING, maxMarks: DOUBLE>>"
BY_MODEL = "This rubric was read by the language model rather than parsed directly. Check it carefully."


class Readers(NamedTuple):
    """A judge's ways of reading, as `rounds` asks them. scheme's batches have `known`, the paper's questions (number,
    max_marks); criteria's have `max_marks`, and its text is prompt and worked answer."""

    scheme: Reader
    paper: Reader | None = None
    criteria: Reader | None = None


class Rubrics(NamedTuple):
    """rubrics: doc_id, source (parsed or model), total_marks, warnings. questions: doc_id, question_id, number, subject,
    prompt, max_marks, model_answer, guidance, requires_diagram. criteria: doc_id, question_id, criterion_id, ordinal,
    description, max_marks, source. failures: doc_id, reasons."""

    rubrics: DataFrame
    questions: DataFrame
    criteria: DataFrame
    failures: DataFrame


def shaped(schema: str, root: str, needed: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """The check of replies that have a list `root` of objects: what is missing, with its place."""

    def check(replies: DataFrame) -> DataFrame:
        parsed = replies.withColumn("_p", F.from_json(salvage_json(F.col("raw")), schema))
        lacks = lambda x, i: F.array_compact(F.array(*[F.when(x[f].isNull(), F.concat(F.lit(f"{root}."), i.cast("string"), F.lit(f".{f}: Required"))) for f in needed]))
        errors = F.when(F.col(f"_p.{root}").isNull(), F.array(F.lit(f"{root}: Required"))).otherwise(F.flatten(F.transform(F.col(f"_p.{root}"), lacks)))
        return parsed.withColumn("errors", errors).drop("_p")

    return check


def _parts(answered: DataFrame, schema: str) -> DataFrame:
    """A row for each question a piece told of, in order of pieces: doc_id, ordinal, chunk, q."""
    told = answered.select("doc_id", "path", F.posexplode(F.from_json(salvage_json(F.col("raw")), schema)["questions"]).alias("_i", "q"))
    order = Window.partitionBy("doc_id").orderBy("path", "_i")
    return settled(told.select("doc_id", F.row_number().over(order).alias("ordinal"), F.col("path")[0].alias("chunk"), "q"))


def _pieces(chunks: DataFrame, *carried: str) -> DataFrame:
    return chunks.select("doc_id", F.array("chunk").alias("path"), "text", *carried)


def _failures(worked, what: str) -> DataFrame:
    """Why the pieces of a document couldn't be read (doc_id, reason)."""
    fate = F.when(F.col("fate") == "too_large", "is too large to send to the model even on its own").when(F.col("fate") == "unusable", "was not read in the expected shape, even in its smallest part").when(F.col("fate") == "outage", "could not be read, since the model was not reached").otherwise("was refused by the model")
    place = F.array_join(F.transform("path", lambda x: (x + 1).cast("string")), ".")
    return worked.failed.select("doc_id", F.concat_ws(" ", F.lit(f"Piece"), place, F.lit(f"of the {what}"), F.concat(fate, F.lit(".")), F.col("message")).alias("reason"))


def _fated(criteria: DataFrame, stated: DataFrame) -> DataFrame:
    return settled(rubric.trim_fate(criteria.join(stated, ["doc_id", "number"], "left"), ["doc_id", "number"], "ordinal"))


def staged(schemes: DataFrame, papers: DataFrame | None, readers: Readers, chunk_tokens: int, rules: Rules = Rules(), pause: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(questions, criteria, warnings, failures) of schemes (doc_id, text) read in pieces."""
    number = lambda c: F.col(f"q.{c}").alias(c)
    failures, counts = [], []
    if papers is not None and readers.paper is not None:
        cut = settled(chunk.chunks(papers, chunk_tokens))
        counts.append(cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pieces"), F.lit("question paper").alias("_what")))
        worked = rounds(_pieces(cut), readers.paper, ["doc_id"], rules, shaped(PAPER, "questions", ("number", "subject", "prompt", "requiresDiagram")), pause)
        failures.append(_failures(worked, "question paper"))
        told = _parts(worked.answered, PAPER).select("doc_id", "ordinal", "chunk", number("number"), F.trim("q.subject").alias("subject"), number("prompt"), F.col("q.maxMarks").alias("max_marks"), F.col("q.requiresDiagram").alias("requires_diagram"))
        paper = settled(rubric.merge_paper_parts(told))
    else:
        paper = schemes.limit(0).select("doc_id", F.lit(0).alias("number"), F.lit("").alias("subject"), F.lit("").alias("prompt"), F.lit(0.0).alias("max_marks"), F.lit(False).alias("requires_diagram"), F.array().cast("array<int>").alias("chunks"))
    known = paper.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("number", "max_marks"))).alias("known"))
    told_of = settled(schemes.join(known, "doc_id", "left"))
    there, none = told_of.filter("known IS NOT NULL"), told_of.filter("known IS NULL")
    numbers = F.transform("known", lambda x: x["number"])
    cut = settled(chunk.chunks(there, chunk_tokens, expected=numbers).unionByName(chunk.chunks(none, chunk_tokens)))
    counts.append(cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pieces"), F.lit("marking scheme").alias("_what")))
    worked = rounds(_pieces(cut.join(told_of.select("doc_id", "known"), "doc_id"), "known"), readers.scheme, ["doc_id"], rules, shaped(SCHEME, "questions", ("number", "modelAnswer", "guidance", "requiresDiagram", "criteria")), pause)
    failures.append(_failures(worked, "marking scheme"))
    told = _parts(worked.answered, SCHEME)
    scheme = settled(rubric.merge_scheme_parts(told.select("doc_id", "ordinal", "chunk", number("number"), F.col("q.modelAnswer").alias("model_answer"), F.col("q.maxMarks").alias("max_marks"), F.col("q.requiresDiagram").alias("requires_diagram"))))
    # The scheme's own words stand for a judge's copy of them.
    wanted = schemes.join(scheme.groupBy("doc_id").agg(F.collect_set("number").alias("_n")), "doc_id")
    own = settled(chunk.question_texts(wanted, F.col("_n")))
    spoken = scheme.join(own.withColumnRenamed("text", "_own"), ["doc_id", "number"], "left")
    copied = spoken.filter("_own IS NULL").select("doc_id", F.concat(F.lit("Question "), F.col("number"), F.lit(": its heading was not found in the marking scheme, so the model's shortened copy stands for the worked answer.")).alias("warning"), "number")
    scheme = settled(spoken.withColumn("model_answer", F.coalesce("_own", "model_answer")).drop("_own"))

    listed = told.select("doc_id", number("number"), "ordinal", F.posexplode("q.criteria").alias("_i", "c")).select("doc_id", "number", "ordinal", "_i", F.trim("c.description").alias("description"), F.col("c.maxMarks").alias("max_marks"))
    unlike = rubric.dedupe_criteria(listed, ["doc_id", "number"], ["ordinal", "_i"])
    criteria = unlike.select("doc_id", "number", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("ordinal", "_i")).alias("ordinal"), "description", "max_marks")
    hints = told.select("doc_id", number("number"), "ordinal", F.posexplode("q.guidance").alias("_i", "line")).withColumn("line", F.trim("line"))
    hints = rubric.dedupe_lines(hints, ["doc_id", "number"], "line", ["ordinal", "_i"])
    stated = paper.select("doc_id", "number", F.col("max_marks").alias("_p")).join(scheme.select("doc_id", "number", F.col("max_marks").alias("_s")), ["doc_id", "number"], "full_outer").select("doc_id", "number", F.coalesce("_s", "_p").alias("stated"))
    fated = _fated(criteria, stated)
    boxes = rubric.summary_guidance(fated, ["doc_id", "number"], "ordinal")
    extra = fated.filter("fate = 'extra'").groupBy("doc_id", "number").agg(F.sort_array(F.collect_list(F.struct("ordinal", "description", "max_marks"))).alias("_x")).select("doc_id", "number", F.concat(F.lit("Alternative or further points, beyond the stated total: "), F.array_join(F.transform("_x", lambda x: F.concat(x["description"], F.lit(" — "), rubric.plain_number(x["max_marks"]))), "; "), F.lit(".")).alias("guidance"))
    kept = settled(fated.filter("fate = 'kept'").select("doc_id", "number", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("ordinal")).alias("ordinal"), "description", "max_marks"))

    joined = settled(rubric.join_questions(paper, scheme, kept))
    put = [boxes.select("doc_id", "number", F.lit(0).alias("_k"), F.lit(0).alias("ordinal"), F.lit(0).alias("_i"), F.col("guidance").alias("line")), extra.select("doc_id", "number", F.lit(1).alias("_k"), F.lit(0).alias("ordinal"), F.lit(0).alias("_i"), F.col("guidance").alias("line")), hints.select("doc_id", "number", F.lit(2).alias("_k"), "ordinal", "_i", "line")]
    guidance = reduce(DataFrame.unionByName, put).groupBy("doc_id", "number").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "ordinal", "_i", "line"))), lambda x: x["line"]).alias("guidance"))
    questions = joined.filter("NOT dropped").join(guidance, ["doc_id", "number"], "left").withColumn("guidance", F.coalesce("guidance", F.array().cast("array<string>")))
    questions = settled(questions.select("doc_id", F.format_string("q%d", "number").alias("question_id"), "number", F.when(F.col("subject") == "", "General").otherwise(F.col("subject")).alias("subject"), "prompt", "max_marks", "model_answer", "guidance", "requires_diagram"))
    named = kept.join(questions.select("doc_id", "number", "question_id"), ["doc_id", "number"]).select("doc_id", "question_id", F.format_string("%sc%d", "question_id", "ordinal").alias("criterion_id"), "ordinal", "description", "max_marks")

    pieces = reduce(DataFrame.unionByName, counts).groupBy("doc_id").agg(F.sum(F.when(F.col("_what") == "question paper", F.col("_pieces"))).alias("_p"), F.sum(F.when(F.col("_what") == "marking scheme", F.col("_pieces"))).alias("_s"))
    found = questions.groupBy("doc_id").agg(F.array_sort(F.collect_list("number")).alias("_n"))
    read_in = pieces.join(found, "doc_id").select("doc_id", F.lit(-2).alias("number"), F.concat(F.lit("Read in pieces: "), F.coalesce("_p", F.lit(0)), F.lit(" from the question paper and "), F.coalesce("_s", F.lit(0)), F.lit(" from the marking scheme, joined by question number into "), F.size("_n"), F.lit(" (Q"), F.array_join(F.transform("_n", lambda n: n.cast("string")), ", Q"), F.lit(").")).alias("warning"))
    noted = boxes.select("doc_id", "number", F.concat(F.lit("Question "), F.col("number"), F.lit(": "), F.col("note")).alias("warning"))
    over = extra.select("doc_id", "number", F.concat(F.lit("Question "), F.col("number"), F.lit(": its points came to more than the stated marks; those beyond them are guidance.")).alias("warning"))
    warnings = [read_in, copied, noted, over, joined.select("doc_id", "number", F.explode("warnings").alias("warning"))]
    empty = schemes.join(questions.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("No questions could be read from the marking scheme.").alias("reason"))
    return questions, named, settled(reduce(lambda a, b: a.unionByName(b), (w.select("doc_id", "number", "warning") for w in warnings))), settled(reduce(DataFrame.unionByName, [*failures, empty]))


def read_rubrics(schemes: DataFrame, papers: DataFrame | None, readers: Readers | None, chunk_tokens: int, rules: Rules = Rules(), pause: Callable[[float], None] = time.sleep) -> Rubrics:
    """Rubrics of marking schemes (doc_id, text) and their question papers (doc_id, text).

    A scheme that the parser finds questions in is parsed; every other one is read in pieces, or fails where nobody reads.
    """
    lined, points = (settled(t) for t in rubric.parse_scheme(schemes))
    prompts = rubric.parse_question_paper(papers) if papers is not None else None
    parsed, named = (settled(t) for t in rubric.assemble(lined, points, prompts))
    told = parsed.select("doc_id", "number", F.explode("warnings").alias("warning"))
    shape = ["doc_id", "question_id", "number", "subject", "prompt", "max_marks", "model_answer", "guidance", "requires_diagram"]
    parts, listed, warnings = [parsed.select(*shape)], [named], [told]
    failures = schemes.limit(0).select("doc_id", F.lit("").alias("reason"))
    rest = settled(schemes.join(parsed.select("doc_id").distinct(), "doc_id", "left_anti"))
    if not rest.isEmpty():
        if readers is None:
            failures = rest.select("doc_id", F.lit("The marking scheme could not be parsed, and nothing was given that reads one.").alias("reason"))
        else:
            theirs = papers.join(rest.select("doc_id"), "doc_id", "left_semi") if papers is not None else None
            questions, criteria, said, failures = staged(rest, theirs, readers, chunk_tokens, rules, pause)
            sound = settled(questions.select("doc_id").distinct().join(failures.select("doc_id"), "doc_id", "left_anti"))
            by_model = sound.select("doc_id", F.lit(-1).alias("number"), F.lit(BY_MODEL).alias("warning"))
            parts.append(questions.join(sound, "doc_id").select(*shape))
            listed.append(criteria.join(sound, "doc_id").select(*named.columns))
            warnings += [said.join(sound, "doc_id"), by_model]
    every = settled(reduce(DataFrame.unionByName, parts))
    points = settled(reduce(DataFrame.unionByName, listed))
    made, more = _inferred(every, points, readers, pause)
    criteria = settled(rubric.fill_missing(every, points, made))
    worth = rubric.finalise(every, criteria)
    final = settled(every.drop("max_marks").join(worth.select("doc_id", "question_id", "max_marks", "repaired"), ["doc_id", "question_id"]))
    mended = final.filter("repaired").select("doc_id", "number", F.concat(F.lit("Question "), F.col("number"), F.lit(": worth the sum of its criteria, not what was stated.")).alias("warning"))
    said = reduce(DataFrame.unionByName, (w.select("doc_id", F.col("number").cast("int").alias("number"), "warning") for w in [*warnings, more, mended]))
    lines = said.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("number", "warning"))), lambda x: x["warning"]).alias("warnings"))
    source = F.when(F.col("_parsed").isNotNull(), "parsed").otherwise("model")
    whose = parsed.select("doc_id").distinct().withColumn("_parsed", F.lit(True))
    rubrics = final.groupBy("doc_id").agg(F.sum("max_marks").alias("total_marks")).join(lines, "doc_id", "left").join(whose, "doc_id", "left")
    failed = failures.groupBy("doc_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return Rubrics(rubrics.select("doc_id", source.alias("source"), "total_marks", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")), final.select(*shape), criteria, failed)


def _inferred(questions: DataFrame, criteria: DataFrame, readers: Readers | None, pause: Callable[[float], None]) -> tuple[DataFrame | None, DataFrame]:
    """A judge's criteria for questions that have none, and what is to be said of it."""
    lacking = settled(questions.join(criteria.select("doc_id", "question_id").distinct(), ["doc_id", "question_id"], "left_anti"))
    told: Column = F.concat(F.lit("Question "), F.col("number"), F.lit(": the scheme has no criteria for it; "))
    if readers is None or readers.criteria is None or lacking.isEmpty():
        return None, lacking.select("doc_id", "number", F.concat(told, F.lit("one stands for the whole question.")).alias("warning"))
    pieces = lacking.select("doc_id", "question_id", F.array("number").alias("path"), F.concat_ws("\n\n", "prompt", "model_answer").alias("text"), "max_marks")
    worked = rounds(pieces, readers.criteria, ["doc_id", "question_id"], Rules(depth=0, split_unusable=False), shaped(INFERRED, "criteria", ("description", "maxMarks")), pause)
    made = settled(worked.answered.select("doc_id", "question_id", F.posexplode(F.from_json(salvage_json(F.col("raw")), INFERRED)["criteria"]).alias("_i", "c")).select("doc_id", "question_id", (F.col("_i") + 1).alias("ordinal"), F.trim("c.description").alias("description"), F.col("c.maxMarks").alias("max_marks")))
    fine = made.filter("description != '' AND max_marks > 0").select("doc_id", "question_id").distinct().withColumn("_f", F.lit(True))
    said = lacking.join(fine, ["doc_id", "question_id"], "left")
    return made, said.select("doc_id", "number", F.concat(told, F.when(F.col("_f"), "they were inferred.").otherwise("none could be inferred, so one stands for the whole question.")).alias("warning"))
