"""Quotes anchored to places on pages: exact first, then typo-tolerant, then boxes from text runs.

Quotes and pages meet on their document, never as a cross product. The exact stage is one containment test; only quotes
it doesn't find go on to token windows, so the dear test runs on few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import clamp01, round4
from ..functions.text import ANCHOR_THRESHOLD, best_window, let, normalise, source_offsets, token_spans, tokens

#: Shorter quotes are too common to anchor. Fixed value.
LEAST_QUOTE = 8
#: Advance widths in em: space, narrow, wide, capitals, digits, others. Fixed values.
NARROW, WIDE, CAPITALS = "ijltfrI.,;:'`|!()[]-", "mwMW@%&", "ABCDEFGHJKLNOPQRSTUVXYZ"


def usable(quotes: DataFrame, quote: str = "quote") -> DataFrame:
    return quotes.filter(F.length(F.trim(F.coalesce(quote, F.lit("")))) >= LEAST_QUOTE)


def matches(quotes: DataFrame, pages: DataFrame, doc: str = "doc_id", quote: str = "quote", ids: list[str] | None = None, threshold: float = ANCHOR_THRESHOLD) -> DataFrame:
    """(ids, doc, page, similarity, status, start, end): each page on which a quote is found, at its place in the normalised page.

    quotes: ids, doc, quote, hint (a page or null); pages: doc, page, text.
    """
    ids = list(dict.fromkeys([*(ids or ["quote_id"]), doc]))
    normal = usable(quotes, quote).select(*ids, "hint", normalise(F.trim(quote)).alias("_q")).filter("_q != ''")
    sheets = pages.select(doc, "page", normalise(F.col("text")).alias("_t")).filter("_t != ''")
    pairs = normal.join(sheets, doc)
    at = F.instr("_t", F.col("_q"))
    exact = pairs.filter(at > 0).select(*ids, "page", "hint", F.lit(1.0).alias("similarity"), F.lit("exact").alias("status"), (at - 1).cast("int").alias("start"), (at - 1 + F.length("_q")).cast("int").alias("end"))
    rest = pairs.filter(at == 0).withColumn("_p", tokens(F.col("_q"))).withColumn("_w", tokens(F.col("_t"))).filter(F.size("_w") >= F.size("_p"))
    found = rest.withColumn("_b", best_window(F.col("_p"), F.col("_w"))).filter(F.col("_b.similarity") >= threshold)
    spans = found.withColumn("_s", token_spans(F.col("_t")))
    fuzzy = spans.select(*ids, "page", "hint", F.col("_b.similarity").alias("similarity"), F.lit("fuzzy").alias("status"), F.get("_s", F.col("_b.offset"))["start"].alias("start"), F.get("_s", F.col("_b.offset") + F.size("_p") - 1)["end"].alias("end"))
    return exact.unionByName(fuzzy)


def best_match(found: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """The most similar page of each quote; of equal ones the hinted page, then the lowest. (A fuzzy 1.0 seen first wins.)"""
    ids = ids or ["quote_id"]
    visit = F.when(F.col("page") == F.col("hint"), -1).otherwise(F.col("page"))
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*ids).orderBy(F.col("similarity").desc(), visit))).filter("_n = 1").drop("_n")


def source_span(best: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds `from`, `to` and matched_text: the span in the page's own text."""
    joined = best.join(pages.select(doc, "page", "text"), [doc, "page"]).withColumn("_o", source_offsets(F.col("text")))
    spanned = joined.withColumn("from", F.get("_o", F.col("start"))).withColumn("to", F.get("_o", F.col("end") - 1) + 1)
    return spanned.withColumn("matched_text", F.substring("text", F.col("from") + 1, F.col("to") - F.col("from"))).drop("_o", "text")


def width_of(text: Column) -> Column:
    """The width of a text in em, by kinds of letters."""

    def one(c: Column) -> Column:
        inside = lambda letters: F.instr(F.lit(letters), c) > 0
        return F.when(c == " ", 0.25).when(inside(NARROW), 0.3).when(inside(WIDE), 0.85).when(inside(CAPITALS), 0.68).when(c.rlike("^[0-9]$"), 0.5).otherwise(0.48)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0.0), lambda t, c: t + one(c))


def slice_rect(run: Column, start: Column, end: Column) -> Column:
    """The part of a text run's box that covers [start, end) of the page text. run: (text, start, end, rect)."""
    rect, text = run["rect"], run["text"]
    low = F.greatest(F.lit(0), start - run["start"])
    high = F.least(F.length(text), end - run["start"])
    total = width_of(text)
    before, covered = width_of(F.substring(text, F.lit(1), low)), width_of(F.substring(text, low + 1, high - low))
    x = clamp01(rect["x"] + rect["width"] * before / total)
    part = F.struct(rect["page"].alias("page"), x.alias("x"), rect["y"].alias("y"), F.least(1.0 - x, F.greatest(F.lit(0.002), rect["width"] * covered / total)).alias("width"), rect["height"].alias("height"))
    return F.when(((low <= 0) & (high >= F.length(text))) | (total <= 0), rect).otherwise(part)


def merge_rects(rects: Column) -> Column:
    """Boxes of one line as one box: same page, tops within 0.004, gap under 0.02 from the box grown so far."""
    kind = "array<struct<page:int,x:double,y:double,width:double,height:double>>"

    def step(out: Column, r: Column) -> Column:
        p = F.try_element_at(out, F.lit(-1))
        joins = p.isNotNull() & (p["page"] == r["page"]) & (F.abs(p["y"] - r["y"]) < 0.004) & (r["x"] - (p["x"] + p["width"]) < 0.02)
        right = F.greatest(p["x"] + p["width"], r["x"] + r["width"])
        grown = F.struct(p["page"].alias("page"), p["x"].alias("x"), p["y"].alias("y"), (right - p["x"]).alias("width"), F.greatest(p["height"], r["height"]).alias("height"))
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), grown)).otherwise(F.array_append(out, r))

    return F.aggregate(rects, F.array().cast(kind), step)


def span_rects(spans: DataFrame, runs: DataFrame, ids: list[str] | None = None, doc: str = "doc_id") -> DataFrame:
    """Adds rects: the merged boxes of the runs that [from, to) overlaps. runs: doc, page, run_no, text, start, end, rect."""
    ids = ids or ["quote_id"]
    r = runs.select(doc, "page", F.col("run_no"), F.struct("text", "start", "end", "rect").alias("_run"))
    met = spans.join(r, [doc, "page"]).filter((F.col("_run.end") > F.col("from")) & (F.col("_run.start") < F.col("to")))
    cut = met.withColumn("_rect", slice_rect(F.col("_run"), F.col("from"), F.col("to")))
    one = cut.groupBy(*ids).agg(F.transform(F.sort_array(F.collect_list(F.struct("run_no", "_rect"))), lambda x: x["_rect"]).alias("_rects"))
    return spans.join(one.withColumn("rects", merge_rects(F.col("_rects"))).drop("_rects"), ids, "left")


def anchor_quotes(quotes: DataFrame, pages: DataFrame, runs: DataFrame | None = None, ids: list[str] | None = None, doc: str = "doc_id") -> DataFrame:
    """(ids, status, similarity, matched_text, page, rects, approximate) for every quote; unresolved where not found.

    A quote found on a page that has runs, but without a box, is unresolved; on a page without runs it stands, boxless.
    """
    ids = ids or ["quote_id"]
    best = source_span(best_match(matches(quotes, pages, doc, ids=ids), ids), pages, doc)
    if runs is not None:
        placed = span_rects(best, runs, ids, doc)
        has = runs.select(doc, "page").distinct().withColumn("_runs", F.lit(True))
        placed = placed.join(has, [doc, "page"], "left")
    else:
        placed = best.withColumn("rects", F.lit(None).cast("array<struct<page:int,x:double,y:double,width:double,height:double>>")).withColumn("_runs", F.lit(None).cast("boolean"))
    source = pages.select(doc, "page", F.coalesce("source", F.lit("text-layer")).alias("_source")) if "source" in pages.columns else pages.select(doc, "page", F.lit("text-layer").alias("_source"))
    placed = placed.join(source, [doc, "page"])
    failed = F.col("rects").isNull() & F.coalesce("_runs", F.lit(False))
    fine = placed.filter(~failed).select(*ids, "status", round4(F.col("similarity")).alias("similarity"), "matched_text", "page", F.coalesce("rects", F.array()).alias("rects"), (F.col("rects").isNotNull() & (F.col("_source") == "transcription")).alias("approximate"))
    out = quotes.select(*ids).join(fine, ids, "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("unresolved")), "similarity": F.coalesce("similarity", F.lit(0.0)), "rects": F.coalesce("rects", F.array()), "approximate": F.coalesce("approximate", F.lit(False))})


def main_rect(rects: Column) -> Column:
    """The widest box, the first of equal ones."""
    return F.when(F.size(rects) > 0, let(F.transform(rects, lambda r: r["width"]), lambda w: F.get(rects, F.array_position(w, F.array_max(w)).cast("int") - 1)))


def margin_rect(page: Column, slot: Column) -> Column:
    """Where a note stands that has no place of its own: the right margin, nine to a page."""
    return F.struct(F.greatest(F.lit(0), page).alias("page"), F.lit(0.8).alias("x"), (0.08 + F.pmod(slot, F.lit(9)) * 0.095).alias("y"), F.lit(0.17).alias("width"), F.lit(0.055).alias("height"))


def numbered(annotations: DataFrame, key: str = "result_id", order: list[str] | None = None) -> DataFrame:
    """Adds `slot`: the 0-based place of each annotation of a result, in order of emission."""
    return annotations.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["ordinal"]))) - 1)


def to_points(rect: Column, width: Column, height: Column) -> Column:
    """A normalised top-left box in page points from the bottom left."""
    return F.struct((rect["x"] * width).alias("x"), (height - (rect["y"] + rect["height"]) * height).alias("y"), (rect["width"] * width).alias("width"), (rect["height"] * height).alias("height"))
