"""Answer sheets into answers: by headings, or by what a judge said of each chunk and the opening words that it quoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import locate, strip, trim_heading_remainder

#: "Answer 3", "Ans. 3", "Q3", "Question 3" at a line's start, whatever the case.
MARKER = r"(?i)(?:^|\n)[ \t]*(?:Answer|Ans\.?|Q(?:uestion)?)[ \t]*(\d+)"


def joined_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """doc, text (pages joined by line ends) and page_starts. A document's pages are a few, so they meet in one row."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    one = pages.groupBy(doc).agg(listed.alias("_l"))
    lengths = F.transform("_l", lambda x: F.length(x["t"]) + 1)
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n), lambda a: F.slice(a, 1, F.size(a) - 1))
    return one.select(doc, F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias("text"), starts.alias("page_starts"))


def page_of(offset: Column, starts: Column) -> Column:
    """The page that an offset of joined text lies on."""
    return F.greatest(F.lit(0), F.size(F.filter(starts, lambda s: s <= offset)) - 1)


def markers(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, number, start, body_start, end): the first heading of each number, in order; an answer ends at the next.

    Headings are found by splitting at them, so offsets are running sums of lengths, in the row.
    """
    heads = docs.withColumn("_h", F.regexp_extract_all(text, F.lit(MARKER), 0)).withColumn("_n", F.regexp_extract_all(text, F.lit(MARKER), 1)).filter(F.size("_h") > 0)
    # Everything between headings, in order; regexes find the same places.
    heads = heads.withColumn("_b", F.split(text, MARKER))
    found = heads.select(doc, F.posexplode(F.arrays_zip("_h", "_n", "_b")).alias("_k", "_m"), F.length(text).alias("_len")).filter(F.col("_m._h").isNotNull())
    order = Window.partitionBy(doc).orderBy("_k")
    upto = F.sum(F.length("_m._b") + F.length("_m._h")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = found.select(doc, "_len", F.col("_m._n").try_cast("long").alias("number"), (upto - F.length("_m._h")).alias("start"), upto.alias("body_start"))
    first = placed.filter("number IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy(doc, "number").orderBy("start"))).filter("_r = 1")
    end = F.coalesce(F.lead("start").over(Window.partitionBy(doc).orderBy("start")), F.col("_len"))
    return first.select(doc, "number", F.col("start").cast("int"), F.col("body_start").cast("int"), end.cast("int").alias("end"))


def segments(docs: DataFrame, questions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """An answer for each document and question: (doc, question_id, number, text, start_page, approximate).

    docs as of `joined_pages`. Without any heading the whole document stands for every question; a number without a
    heading, where others have one, is an empty answer. Both are approximate.
    """
    marks = markers(docs, doc)
    any_mark = marks.select(doc).distinct().withColumn("_any", F.lit(True))
    wanted = docs.join(any_mark, doc, "left").crossJoin(questions.select("question_id", "number"))  # an answer for each: the size of the result
    joined = wanted.join(marks, [doc, "number"], "left")
    body = strip(trim_heading_remainder(F.substring("text", F.col("body_start") + 1, F.col("end") - F.col("body_start"))))
    whole = F.col("_any").isNull()
    return joined.select(
        doc, "question_id", "number", F.when(whole, strip(F.col("text"))).when(F.col("start").isNull(), "").otherwise(body).alias("text"),
        F.when(F.col("start").isNull(), 0).otherwise(page_of(F.col("start"), F.col("page_starts"))).alias("start_page"), F.col("start").isNull().alias("approximate"),
    )


def placed_chunks(docs: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """chunks (doc, path, text) with `place` (0, 1, ... by path), `start` (in the chunks joined by line ends) and `start_page`.

    A chunk is a run of its document's text, so its page is that of the next place, after the chunk before, where it stands;
    it is looked for from there on, in one fold over a document's chunks.
    """
    order = Window.partitionBy(doc).orderBy("path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.select(doc, "path", "text", (F.row_number().over(order) - 1).alias("place"), F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int").alias("start"))
    listed = rows.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("place", F.col("text").alias("t")))).alias("_c")).join(docs.select(doc, F.col("text").alias("_t"), "page_starts"), doc)
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        found = F.call_function("locate", c["t"], F.col("_t"), s["at"])
        at = F.when(found > 0, found).otherwise(s["at"])
        return F.struct((at + F.when(found > 0, F.length(c["t"])).otherwise(0)).alias("at"), F.array_append(s["out"], at - 1).alias("out"))

    pages = listed.select(doc, "page_starts", F.posexplode(F.aggregate("_c", begin, step, lambda s: s["out"])).alias("place", "_at")).select(doc, "place", page_of(F.col("_at"), F.col("page_starts")).alias("start_page"))
    return rows.join(pages, [doc, "place"])


def attributed(chunks: DataFrame, told: DataFrame, questions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, question_id, number, text, start_page, approximate) from what a judge said of each chunk.

    chunks: as `placed_chunks` gives them. told: doc, place, ordinal, number, begins, first_words: the answers that a chunk
    was said to hold. An answer starts where the first chunk that it was said to begin in has its opening words, or at that
    chunk's start if they aren't there, and runs to the next answer's start. One that nobody saw begin is all chunks that it was
    seen in; one never seen is empty. Both are approximate. Documents of which nothing was told have no rows.
    """
    known = told.join(questions.select("number").distinct(), "number").join(chunks.select(doc, "place", "text", "start", "start_page"), [doc, "place"])
    opening = F.col("start") + F.coalesce(locate(F.col("text"), F.col("first_words")), F.lit(0))
    first = Window.partitionBy(doc, "number").orderBy("place", "ordinal")
    starts = known.filter("begins").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(doc, "number", opening.cast("int").alias("_at"), "start_page")
    # Of answers that start at one place each runs to the next further on.
    ends = starts.select(doc, "_at").distinct().withColumn("_end", F.lead("_at").over(Window.partitionBy(doc).orderBy("_at")))
    whole = chunks.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("_all"))
    spans = starts.join(ends, [doc, "_at"]).join(whole, doc)
    begun = spans.select(doc, "number", strip(F.substring("_all", F.col("_at") + 1, F.coalesce("_end", F.length("_all")) - F.col("_at"))).alias("text"), "start_page", F.lit(False).alias("approximate"))
    seen = known.join(starts.select(doc, "number"), [doc, "number"], "left_anti").select(doc, "number", "place", "text", "start_page").distinct()
    pieces = seen.groupBy(doc, "number").agg(strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")).alias("text"), F.min_by("start_page", "place").alias("start_page"), F.lit(True).alias("approximate"))
    found = begun.unionByName(pieces)
    wanted = known.select(doc).distinct().crossJoin(questions.select("question_id", "number"))  # an answer for each: the size of the result
    return wanted.join(found, [doc, "number"], "left").select(doc, "question_id", "number", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("start_page", F.lit(0)).alias("start_page"), F.coalesce("approximate", F.lit(True)).alias("approximate"))


def questions_with_segments(questions: DataFrame, segs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Every question of every document, with an empty approximate answer where there is none."""
    pairs = segs.select(doc).distinct().crossJoin(questions)
    joined = pairs.join(segs.drop("number"), [doc, "question_id"], "left")
    return joined.withColumns({"text": F.coalesce("text", F.lit("")), "start_page": F.coalesce("start_page", F.lit(0)), "approximate": F.coalesce("approximate", F.lit(True))})
