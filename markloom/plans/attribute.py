"""Answers of sheets without headings: a judge reads them chunk by chunk and tells which answers begin where.

Attribution is best effort. A document that can't be read to its end, or of which nothing was told, keeps the segments
that its headings give, which then are approximate.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, salvage_json
from ..operators import chunk, segment
from .rounds import Reader, Rules, rounds
from .rubrics import shaped
from .steps import settled

ANSWERS = "answers ARRAY<STRUCT<questionNumber: INT, beginsInThisChunk: BOOLEAN, firstWords: STRING>>"


def attribute(docs: DataFrame, questions: DataFrame, reader: Reader, chunk_tokens: int, rules: Rules = Rules(), pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Segments (see `segment.segments`) of the documents that a judge could attribute; docs as of `segment.joined_pages`.

    reader: as `rounds` asks it; its batches have `questions`, an array of (number, prompt). A chunk whose reply stays
    unusable in its smallest part tells nothing, and counts as read.
    """
    numbers = questions.agg(F.sort_array(F.collect_set("number")).alias("_n"))  # one row
    asked = questions.agg(F.sort_array(F.collect_list(F.struct("number", (F.col("prompt") if "prompt" in questions.columns else F.lit("")).alias("prompt")))).alias("questions"))
    cut = chunk.chunks(docs.crossJoin(F.broadcast(numbers)), chunk_tokens, expected=F.col("_n"))
    pieces = settled(cut.select("doc_id", F.array("chunk").alias("path"), "text").crossJoin(F.broadcast(asked)))
    worked = rounds(pieces, reader, ["doc_id"], rules, shaped(ANSWERS, "answers", ("questionNumber", "beginsInThisChunk")), pause)
    failed = settled(worked.failed.select("doc_id", "path", "text", "fate"))
    lost = failed.filter("fate != 'unusable'").select("doc_id").distinct()
    read = worked.answered.select("doc_id", "path", "text", "raw").unionByName(failed.filter("fate = 'unusable'").select("doc_id", "path", "text", F.lit(None).cast("string").alias("raw")))
    read = settled(read.join(lost, "doc_id", "left_anti"))
    placed = settled(segment.placed_chunks(docs, read.select("doc_id", "path", "text")))
    told = read.select("doc_id", "path", F.posexplode(F.from_json(salvage_json(F.col("raw")), ANSWERS)["answers"]).alias("ordinal", "a")).join(placed.select("doc_id", "path", "place"), ["doc_id", "path"])
    said = told.select("doc_id", "place", "ordinal", F.col("a.questionNumber").alias("number"), F.col("a.beginsInThisChunk").alias("begins"), F.col("a.firstWords").alias("first_words"))
    return segment.attributed(placed, said, questions)


def answers_of(pages: DataFrame, questions: DataFrame, reader: Reader, chunk_tokens: int, rules: Rules = Rules(), pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """As `grade.answers_of`, but documents without any heading are attributed by a judge where it can."""
    docs = settled(segment.joined_pages(pages))
    bare = docs.join(segment.markers(docs).select("doc_id").distinct(), "doc_id", "left_anti")
    by_words = settled(attribute(settled(bare), questions, reader, chunk_tokens, rules, pause))
    by_heading = segment.segments(docs, questions).join(by_words.select("doc_id").distinct(), "doc_id", "left_anti")
    both = by_heading.select(*by_words.columns).unionByName(by_words)
    return settled(both.withColumn("blank", is_blank(F.col("text"))))
