"""Transcribed pages: boxes, diagram markers, unstable transcripts, and lines aligned to ink rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, needs_transcription, strip

#: Where a transcript says that a diagram stands. Fixed value.
MARKER = r"(?i)\[\s*diagram\s*(\d+)\s*\]"
#: What stands for drawings that nobody described: several, and one. Fixed values.
DRAWINGS_UNKNOWN = "[Diagram: one or more drawings are present here but could not be described — do not assume what they show]"
DRAWING_UNKNOWN = ("[Diagram ", ": a drawing is present here but could not be described — do not assume what it shows]")
#: A page beyond these is unstable. Fixed values.
MOST_CHARS, MOST_MARKERS, MOST_REPEATS, LONG_LINE = 7000, 8, 4, 25


def pages_to_read(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): the pages of each document that need transcription, in order."""
    return pages.filter(needs_transcription(F.col("text"), F.col("source"))).groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("pages"))


def normalise_box(top: Column, bottom: Column, left: Column, right: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """A model's box as fractions, whether it came in fractions, thousandths or pixels; null for none, or a sliver."""
    most = F.greatest(top, bottom, left, right)
    fine = ~(F.isnan(top) | F.isnan(bottom) | F.isnan(left) | F.isnan(right)) & top.isNotNull() & bottom.isNotNull() & left.isNotNull() & right.isNotNull()
    w, h = (width, height) if width is not None else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    across = F.when(most <= 1.001, 1.0).when(most <= 1000.5, 1000.0).when((w > 0) & (h > 0), w)
    down = F.when(most <= 1.001, 1.0).when(most <= 1000.5, 1000.0).when((w > 0) & (h > 0), h)
    inside = lambda v, d: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / d))
    box = F.struct(inside(top, down).alias("top"), inside(bottom, down).alias("bottom"), inside(left, across).alias("left"), inside(right, across).alias("right"))
    return F.when(fine & across.isNotNull() & (box["bottom"] - box["top"] >= 0.002) & (box["right"] - box["left"] >= 0.002), box)


def undescribed_markers(lines: DataFrame, diagrams: DataFrame, keys: list[str]) -> DataFrame:
    """Markers placed in lines without a description (keys, marker)."""
    placed = lines.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(MARKER), 1)).alias("m")).select(*keys, F.col("m").try_cast("int").alias("marker")).distinct()
    return placed.join(diagrams.select(*keys, "marker").distinct(), [*keys, "marker"], "left_anti")


def expand_markers(lines: DataFrame, diagrams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, text): markers in lines replaced by their diagram's description; descriptions nobody placed come last.

    Of two descriptions of one marker the last stands; a marker without one says so. Where lines and diagrams have a `box`
    the result has one: a line takes the box of the last diagram in it that has one, else it keeps its own.
    """
    boxed = "box" in lines.columns and "box" in diagrams.columns
    last = diagrams.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "marker").orderBy(F.col("ordinal").desc()))).filter("_n = 1")
    labels = F.when(F.size("labels") > 0, F.concat(F.lit(" Labels: "), F.array_join("labels", " | "), F.lit("."))).otherwise("")
    said = last.select(*keys, "marker", F.concat(F.lit("[Diagram "), F.col("marker"), F.lit(": "), F.trim("description"), labels, F.lit("]")).alias("said"), *(["box"] if boxed else []))
    entries = lambda v: F.map_from_entries(F.collect_list(F.struct(F.col("marker").cast("string"), v)))
    per_page = said.groupBy(*keys).agg(entries("said").alias("_said"), *([entries("box").alias("_boxes")] if boxed else []))  # a page's few diagrams
    joined = lines.join(per_page, keys, "left")
    unknown = lambda m: F.when(m == "0", F.lit(DRAWINGS_UNKNOWN)).otherwise(F.concat(F.lit(DRAWING_UNKNOWN[0]), m, F.lit(DRAWING_UNKNOWN[1])))
    marks = F.regexp_extract_all("text", F.lit(MARKER), 1)
    between = F.split("text", MARKER)
    filled = F.zip_with(between, marks, lambda b, m: F.concat(F.coalesce(b, F.lit("")), F.when(m.isNull(), "").otherwise(F.coalesce(F.try_element_at("_said", F.regexp_replace(m, "^0+(?=\\d)", "")), unknown(m)))))
    text = F.regexp_replace(F.array_join(filled, ""), r"\s+$", "")
    placed = lines.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(MARKER), 1)).alias("m")).select(*keys, F.col("m").try_cast("int").alias("marker")).distinct()
    tail = Window.partitionBy(*keys).orderBy("marker")
    loose = said.join(placed, [*keys, "marker"], "left_anti").select(*keys, (F.lit(1_000_000) + F.row_number().over(tail)).alias("line"), F.col("said").alias("text"), *(["box"] if boxed else []))
    theirs = F.filter(F.transform(marks, lambda m: F.try_element_at("_boxes", F.regexp_replace(m, "^0+(?=\\d)", ""))), lambda b: b.isNotNull()) if boxed else None
    own = [F.coalesce(F.try_element_at(theirs, F.lit(-1)), F.col("box")).alias("box")] if boxed else []
    return joined.select(*keys, "line", text.alias("text"), *own).unionByName(loose)


def trust_positions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, trusted): whether at least 70 % of neighbouring boxes run downwards, at a tolerance of 0.02."""
    boxed = lines.filter("box IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("line")
    steps = boxed.withColumn("_d", F.col("box.top") >= F.lag("box.top").over(order) - 0.02)
    return steps.groupBy(*keys).agg((F.coalesce(F.avg(F.col("_d").cast("int")), F.lit(1.0)) >= 0.7).alias("trusted"))


def page_text(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pages, runs) of transcribed lines: the text, and a run for each line with a trusted box at its place in the text."""
    order = Window.partitionBy(*keys).orderBy("line")
    start = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = lines.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))
    pages = lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")).withColumn("text", strip(F.col("text")))
    b = F.col("box")
    rect = F.struct(F.col("page").alias("page"), b["left"].alias("x"), b["top"].alias("y"), F.greatest(F.lit(0.002), b["right"] - b["left"]).alias("width"), F.greatest(F.lit(0.002), b["bottom"] - b["top"]).alias("height"))
    runs = placed.join(trust_positions(lines, keys).filter("trusted"), keys).filter((strip(F.col("text")) != "") & b.isNotNull())
    return pages, runs.select(*keys, F.col("line").alias("run_no"), "text", "start", "end", rect.alias("rect"))


def degenerate(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, chars, markers, repeated, degenerate): transcripts that a model looped on.

    Lines are counted in two steps, so a line that fills a page is one row after the first.
    """
    shown = lines.withColumn("_k", strip(F.col(text)))
    sizes = shown.groupBy(*keys).agg((F.sum(F.length(text) + 1) - 1).alias("chars"), F.sum(F.regexp_count(text, F.lit(MARKER))).alias("markers"))
    repeats = shown.filter(F.length("_k") >= LONG_LINE).groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    out = sizes.join(repeats, keys, "left").fillna(0, ["repeated"])
    return out.withColumn("degenerate", (F.col("chars") > MOST_CHARS) | (F.col("markers") > MOST_MARKERS) | (F.col("repeated") >= MOST_REPEATS))


def degenerate_text(text: Column) -> Column:
    """(chars, markers, repeated, degenerate) of a whole transcript in one value, in the row."""
    long = F.sort_array(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) >= LONG_LINE))
    again = let(long, lambda s: F.size(F.array_distinct(F.filter(F.transform(s, lambda x, i: F.when(x == F.get(s, i - 1), x)), lambda x: x.isNotNull()))))
    counted = F.struct(F.length(text).cast("long").alias("chars"), F.regexp_count(text, F.lit(MARKER)).cast("long").alias("markers"), again.cast("long").alias("repeated"))
    return let(counted, lambda c: F.struct(c["chars"].alias("chars"), c["markers"].alias("markers"), c["repeated"].alias("repeated"), ((c["chars"] > MOST_CHARS) | (c["markers"] > MOST_MARKERS) | (c["repeated"] >= MOST_REPEATS)).alias("degenerate")))


def sanitise(lines: DataFrame, diagrams: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without repeats of long ones; runs of markers without a description are one `[diagram 0]`."""
    marker = F.regexp_extract("text", r"(?i)^\s*\[\s*diagram\s*(\d+)\s*\]\s*$", 1).try_cast("int")
    known = diagrams.select(*keys, F.col("marker").alias("_m")).distinct().withColumn("_known", F.lit(True))
    put = lines.withColumn("_m", marker).join(known, [*keys, "_m"], "left").withColumn("_void", F.col("_m").isNotNull() & F.col("_known").isNull())
    order = Window.partitionBy(*keys).orderBy("line")
    key = strip(F.col("text"))
    first = F.row_number().over(Window.partitionBy(*keys, "_void", key).orderBy("line")) == 1
    kept = put.withColumn("_first", first).withColumn("_again", F.coalesce(F.lag("_void").over(order), F.lit(False)))
    kept = kept.filter(F.when(F.col("_void"), ~F.col("_again")).otherwise((F.length(key) < LONG_LINE) | F.col("_first")))
    return kept.withColumn("text", F.when(F.col("_void"), "[diagram 0]").otherwise(F.col("text"))).drop("_m", "_known", "_void", "_first", "_again")


def rated_unstable(pages: DataFrame, unstable: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys, legibility, unclear) with those of `unstable` rated poor, and a line that says so among what is unclear."""
    hit = unstable.select(*keys).distinct().withColumn("_u", F.lit(True))
    joined = pages.join(hit, keys, "left")
    said = F.array_append(F.coalesce("unclear", F.array().cast("array<string>")), F.lit("the transcript of this page was unstable and was cleaned up; compare it with the page"))
    bad = F.col("_u").isNotNull()
    return joined.withColumns({"legibility": F.when(bad, "poor").otherwise(F.col("legibility")), "unclear": F.when(bad, said).otherwise(F.col("unclear"))}).drop("_u")


# ---- lines on ink rows --------------------------------------------------------------------------------------------

#: Cost of leaving a line or a row out; the widest gap of coordinates that still pairs. Fixed values.
SKIP, MOST_GAP = 0.3, 0.25


def align(lines: np.ndarray, rows: np.ndarray, gap: float = MOST_GAP) -> list[tuple[int, int]]:
    """Pairs (line, row) in order, by least cost: rank difference and distance of centres, or SKIP for either left out."""
    n, m = len(lines), len(rows)
    if not n or not m:
        return []
    ranks = np.abs(np.arange(n)[:, None] / max(1, n - 1) - np.arange(m)[None, :] / max(1, m - 1))
    apart = np.abs(lines[:, None] - rows[None, :])
    cost = np.where(apart > gap, np.inf, ranks + np.where(np.isnan(apart), 0.0, apart))
    best = np.zeros((n + 1, m + 1))
    best[:, 0], best[0, :] = np.arange(n + 1) * SKIP, np.arange(m + 1) * SKIP
    how = np.zeros((n + 1, m + 1), dtype=np.int8)
    how[1:, 0], how[0, 1:] = 1, 2
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = (best[i - 1, j - 1] + cost[i - 1, j - 1], best[i - 1, j] + SKIP, best[i, j - 1] + SKIP)
            how[i, j] = int(np.argmin(options))  # ties: pair, then line, then row
            best[i, j] = options[how[i, j]]
    pairs, i, j = [], n, m
    while i or j:
        step = how[i, j]
        if step == 0:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif step == 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def snapped(lines: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Lines of a page with the bounds of the ink row each lies on; a second pass corrects a steady drift first."""
    lines, rows = lines.sort_values("line").reset_index(drop=True), rows.sort_values("top").reset_index(drop=True)
    at, ink = ((lines["top"] + lines["bottom"]) / 2).to_numpy(float), ((rows["top"] + rows["bottom"]) / 2).to_numpy(float)
    pairs = align(at, ink)
    sound = [(i, j) for i, j in pairs if not np.isnan(at[i])]
    if len(sound) >= 4:
        x, y = at[[i for i, _ in sound]], ink[[j for _, j in sound]]
        slope, shift = np.polyfit(x, y, 1) if np.ptp(x) > 0 else (1.0, 0.0)
        if 0.5 <= slope <= 2:
            pairs = align(at * slope + shift, ink, 2 * MOST_GAP)
    out = lines.copy()
    for i, j in pairs:
        for side in ("top", "bottom", "left", "right"):
            out.loc[i, side] = rows.loc[j, side]
    return out


def snap_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page, line, top, bottom, left, right): lines moved onto the ink rows of their page. A group is one page."""
    kind = f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, page int, line int, top double, bottom double, left double, right double"
    cols = [c.split()[0] for c in kind.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return snapped(a, b)[cols] if len(a) else pd.DataFrame(columns=cols)

    return lines.groupBy("doc_id", "page").cogroup(rows.groupBy("doc_id", "page")).applyInPandas(run, kind)
