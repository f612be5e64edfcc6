"""What a report shows: numbered boxes in page points, legend and summary lines."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, hex_to_rgb, let, truncate
from ..operators.anchor import numbered, to_points

#: Kinds of annotation with label and colour. Fixed values.
PALETTE = [
    ("incorrect", "Incorrect", "#D62E33"),
    ("missing", "Missing", "#DB7A05"),
    ("spelling", "Spelling", "#1668C4"),
    ("grammar", "Grammar", "#4F4ECC"),
    ("layout", "Layout", "#8B45BD"),
    ("praise", "Good", "#0F8F56"),
]


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PALETTE, "kind string, label string, colour string").withColumn("rgb", hex_to_rgb(F.col("colour")))


def drawn_boxes(annotations: DataFrame, pages: DataFrame, kinds: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(result_id, slot, page, box in points, shape, rgb, label): what an annotated copy draws; praise is underlined.

    annotations: result_id, doc, ordinal, kind, rect; pages: doc, page, width, height in points.
    """
    placed = numbered(annotations).withColumn("page", F.col("rect.page"))
    joined = placed.join(pages.select(doc, "page", "width", "height"), [doc, "page"]).join(kinds, "kind", "left")
    box = to_points(F.col("rect"), F.col("width"), F.col("height"))
    return joined.select("result_id", (F.col("slot") + 1).alias("number"), "page", box.alias("box"), F.when(F.col("kind") == "praise", "underline").otherwise("box").alias("shape"), "rgb", F.coalesce("label", "kind").alias("label"))


def summary_lines(papers: DataFrame, questions: DataFrame, scores: DataFrame, annotations: DataFrame) -> DataFrame:
    """(result_id, section, ordinal, part, line): the marking summary as lines of printable ASCII, in order.

    Sections: 0 score, 1 reasons for review, 2 questions with their criteria, 3 annotations.
    """
    say = lambda *parts: ascii_fold(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    c = F.col
    head = papers.select("result_id", F.lit(0).alias("section"), F.lit(0).alias("ordinal"), F.lit(0).alias("part"), say("Score: ", c("total"), " / ", c("max_marks"), " (confidence ", F.floor(c("confidence") * 100 + 0.5), "%)").alias("line"))
    why = papers.select("result_id", F.lit(1).alias("section"), F.posexplode("reasons").alias("ordinal", "r")).select("result_id", "section", "ordinal", F.lit(0).alias("part"), say("Review: ", c("r")).alias("line"))
    per = questions.select("result_id", F.lit(2).alias("section"), c("number").alias("ordinal"), F.lit(0).alias("part"), say("Question ", c("number"), ": ", c("awarded"), " / ", c("max_marks"), F.when(c("state") != "graded", F.concat(F.lit(" ("), c("state"), F.lit(")"))).otherwise("")).alias("line"))
    points = scores.select("result_id", F.lit(2).alias("section"), c("number").alias("ordinal"), (c("ordinal") + 1).alias("part"), say("  ", c("mark"), " / ", c("max_marks"), "  ", truncate(c("description"), 90)).alias("line"))
    notes = numbered(annotations).select("result_id", F.lit(3).alias("section"), c("slot").alias("ordinal"), F.lit(0).alias("part"), say(c("slot") + 1, ". ", c("comment")).alias("line"))
    out = head
    for part in (why, per, points, notes):
        out = out.unionByName(part)
    return out


def report_text(lines: DataFrame) -> DataFrame:
    """(result_id, value): each result's summary as one text, for a text sink. A report is a page or two."""
    listed = F.sort_array(F.collect_list(F.struct("section", "ordinal", "part", "line")))
    return lines.groupBy("result_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("value"))


#: Widths of the characters from space to tilde in Helvetica, in thousandths of the font's size. Fixed values.
WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)


def wrap_words(texts: pd.Series, room: int, widths: tuple[int, ...]) -> pd.Series:
    """Texts of printable ASCII with their words in lines of a width of at most room, or of one wider word."""
    table = np.zeros(256, dtype=np.int64)
    table[32 : 32 + len(widths)] = widths
    out = []
    for text in texts:
        flat = " ".join(text.split())
        raw = np.frombuffer(flat.encode(), dtype=np.uint8)
        upto = np.cumsum(table[raw])
        stops = np.append(np.flatnonzero(raw == 32), len(raw))
        ends = (upto[stops - 1] if flat else stops).tolist()  # the width up to each word's end
        places, lines, word, begun = stops.tolist(), [], 0, 0
        while flat and word < len(ends):
            behind = max(bisect_right(ends, begun + room, word), word + 1)  # the first word of the next line
            lines.append(flat[places[word - 1] + 1 if word else 0 : places[behind - 1]])
            begun, word = ends[behind - 1] + widths[0], behind
        out.append("\n".join(lines))
    return pd.Series(out, dtype=object)


def wrapped(text: Column, size: float, width: float, widths: tuple[int, ...] = WIDTHS) -> Column:
    """The lines of a text, folded to ASCII, that a box of that width takes: each word goes on the line where it fits, else on
    the next; a word wider than the box has a line of its own. Blank text has no lines.

    Widths are summed up over the text once; a line's end is looked up among the sums.
    """
    room = int(width * 1000 / size)
    lines = F.pandas_udf(lambda texts: wrap_words(texts, room, widths), "string")(ascii_fold(F.coalesce(text, F.lit(""))))
    return let(lines, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n")))


def summary_page(lines: DataFrame, size: float = 9.0, width: float = 495.0) -> DataFrame:
    """Lines of `summary_lines` as they stand on a page: (result_id, section, ordinal, part, row, line), wrapped to its width."""
    return lines.select("result_id", "section", "ordinal", "part", F.posexplode(wrapped(F.col("line"), size, width)).alias("row", "line"))
