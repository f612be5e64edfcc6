"""Documents in: files, page text from text items, rubrics, references to equal content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The largest upload in bytes. Fixed value.
MOST_BYTES = 25 * 1024 * 1024


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, is_pdf and content of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), looks_like_pdf(F.col("content")).alias("is_pdf"), "content")


def looks_like_pdf(content: Column) -> Column:
    return (F.octet_length(content) > 4) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def rejected(files: DataFrame) -> DataFrame:
    """Files that an upload refuses, and why."""
    why = F.when(F.col("bytes") == 0, "empty_body").when(F.col("bytes") > MOST_BYTES, "too_large").when(~F.col("is_pdf"), "not_a_pdf")
    return files.withColumn("error", why).filter("error IS NOT NULL").drop("content")


#: A parser of file bytes, where one is installed: bytes to rows (page, item_no, text, x, y, width, font, eol, page_width, page_height).
Parser = Callable[[bytes], list[tuple]]
ITEMS = "path string, page int, item_no int, text string, x double, y double, width double, font double, eol boolean, page_width double, page_height double"


def parse_files(files: DataFrame, parser: Parser) -> DataFrame:
    """Text items of files, by a pluggable parser; a file that it can't read gives one row of nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEMS.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, *r) for r in parser(bytes(content))]
                except ValueError:
                    rows.append((path, *[None] * (len(names) - 1)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, ITEMS)


def item_rect(x: Column, y: Column, width: Column, font: Column, page: Column, page_width: Column, page_height: Column) -> Column:
    """The box of a text item from its baseline, in parts of the page: ascent 0.8 and height 1.05 of the font's size."""
    inside = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    left, top = inside(x / page_width), inside((page_height - y - 0.8 * font) / page_height)
    return F.struct(page.alias("page"), left.alias("x"), top.alias("y"), F.least(1.0 - left, F.greatest(F.lit(0.0), width / page_width)).alias("width"), F.least(1.0 - top, 1.05 * font / page_height).alias("height"))


def with_separators(items: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `separator`, what stands before an item: a line end after an end of line or a baseline shift over 2.5 points;
    nothing where there is white space at the seam; a space at a gap over a fifth of the font; else nothing."""
    order = Window.partitionBy(*keys).orderBy("item_no")
    prior = lambda c: F.lag(c).over(order)
    gap = F.col("x") - (prior("x") + prior("width"))
    seam = prior("text").rlike(r"\s$") | F.col("text").rlike(r"^\s")
    sep = F.when(prior("text").isNull(), "").when(prior("eol") | (F.abs(F.col("y") - prior("y")) > 2.5), "\n").when(seam, "").when(gap > 0.2 * F.col("font"), " ").otherwise("")
    return items.withColumn("separator", sep)


def pages_and_runs(items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pages, runs): each page's text, and a run for each item at its place in it."""
    put = with_separators(items, keys)
    order = Window.partitionBy(*keys).orderBy("item_no")
    end = F.sum(F.length("separator") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    placed = put.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", F.concat("separator", "text").alias("t")))), lambda i: i["t"]), "")
    rect = item_rect(*(F.col(c) for c in ("x", "y", "width", "font", "page", "page_width", "page_height")))
    return put.groupBy(*keys).agg(text.alias("text")), placed.select(*keys, F.col("item_no").alias("run_no"), "text", "start", "end", rect.alias("rect"))


RUBRIC = "id STRING, title STRING, totalMarks DOUBLE, questions ARRAY<STRUCT<id: STRING, number: INT, subject: STRING, prompt: STRING, maxMarks: DOUBLE, modelAnswer: STRING, guidance: ARRAY<STRING>, requiresDiagram: BOOLEAN, criteriaSource: STRING, criteria: ARRAY<STRUCT<id: STRING, description: STRING, maxMarks: DOUBLE>>>>"


def load_rubrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rubrics, questions, criteria) of rubric files, one JSON object each. Check them with `validate.rubric_errors`."""
    raw = spark.read.schema(RUBRIC).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rubrics = raw.select(F.col("id").alias("rubric_id"), "title", F.col("totalMarks").alias("total_marks"))
    q = raw.select(F.col("id").alias("rubric_id"), F.posexplode("questions").alias("ordinal", "q"))
    questions = q.select("rubric_id", F.col("q.id").alias("question_id"), F.col("q.number").alias("number"), F.col("q.subject").alias("subject"), F.col("q.prompt").alias("prompt"), F.col("q.maxMarks").alias("max_marks"), F.col("q.modelAnswer").alias("model_answer"), F.coalesce("q.guidance", F.array().cast("array<string>")).alias("guidance"), F.coalesce("q.requiresDiagram", F.lit(False)).alias("requires_diagram"), F.coalesce("q.criteriaSource", F.lit("instructor")).alias("criteria_source"))
    criteria = q.select("rubric_id", F.col("q.id").alias("question_id"), F.posexplode("q.criteria").alias("ordinal", "c")).select("rubric_id", "question_id", "ordinal", F.col("c.id").alias("criterion_id"), F.col("c.description").alias("description"), F.col("c.maxMarks").alias("max_marks"))
    return rubrics, questions, criteria


def content_twins(docs: DataFrame, key: str = "sha256", order: list[str] | None = None) -> DataFrame:
    """(doc_id, twin_id): for each document the latest other one of equal content that is read and has positions.

    docs: doc_id, key, created_at, reusable. The two latest of each content are enough to answer for all its documents, so
    a content shared by very many documents makes no pairs.
    """
    latest = Window.partitionBy(key).orderBy(*(order or [F.col("created_at").desc(), F.col("doc_id").desc()]))
    ready = docs.filter("reusable").withColumn("_n", F.row_number().over(latest)).filter("_n <= 2")
    two = ready.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col("doc_id"))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col("doc_id"))).alias("_b"))
    return docs.join(two, key).select("doc_id", F.when(F.col("_a") != F.col("doc_id"), F.col("_a")).otherwise(F.col("_b")).alias("twin_id")).filter("twin_id IS NOT NULL")
