"""Drawings on a page, measured from the labels inside them, and regions grounded to drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Geometry in parts of the page. Fixed values.
LABEL_WIDTH, PROSE_WIDTH, MARGIN_TOLERANCE, SHARED_EDGE = 0.3, 0.5, 0.012, 3
CAPTION_GAP, CAPTION_WIDTH, LINE_SPACING, PAD, NEAR, LABEL_GAP = 0.05, 0.35, 0.03, 0.015, 0.15, 0.25
LEAST_LABELS, LEAST_HEIGHT = 2, 0.05
CAPTION = r"(?i)\b(diagram|graph|figure|fig|sketch|drawing|chart|plot)\b"
HEADING = r"(?i)^(answer|question|q)\s*\d"

PAGE = ["doc_id", "page"]


def margins(runs: DataFrame) -> DataFrame:
    """(doc_id, page, margins): left edges of full-width runs, or else edges that three runs share; the first of near ones."""
    first = lambda edges: F.aggregate(edges, F.array().cast("array<double>"), lambda a, x: F.when(F.exists(a, lambda m: F.abs(m - x) <= MARGIN_TOLERANCE), a).otherwise(F.array_append(a, x)))
    listed = runs.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("run_no", F.col("rect.x").alias("x"), F.col("rect.width").alias("w"), (F.trim("text") != "").alias("t")))).alias("l"))
    wide = first(F.transform(F.filter("l", lambda r: r["w"] >= PROSE_WIDTH), lambda r: r["x"]))
    written = F.filter("l", lambda r: r["t"])
    shared = first(F.transform(F.filter(written, lambda r: F.size(F.filter(F.col("l"), lambda o: o["t"] & (F.abs(o["x"] - r["x"]) <= MARGIN_TOLERANCE))) >= SHARED_EDGE), lambda r: r["x"]))
    return listed.withColumn("_w", wide).select(*PAGE, F.when(F.size("_w") > 0, F.col("_w")).otherwise(shared).alias("margins"))


def classified(runs: DataFrame) -> DataFrame:
    """runs with `top`, `low`, `label` (part of a drawing) and `written`.

    A label is narrow, no caption or heading, and either off the margins or with clear paper above and below.
    """
    on = lambda x, m: F.exists(m, lambda k: F.abs(k - x) <= MARGIN_TOLERANCE)
    put = runs.join(margins(runs), PAGE).withColumns({"top": F.col("rect.y"), "low": F.col("rect.y") + F.col("rect.height"), "written": F.trim("text") != ""})
    put = put.withColumn("_on", on(F.col("rect.x"), F.col("margins")))
    others = put.filter(F.col("_on") & F.col("written")).select(*PAGE, F.col("run_no").alias("_o"), F.col("top").alias("_top"), F.col("low").alias("_low"))
    flow = put.filter(F.col("_on")).join(others, PAGE).filter((F.col("_o") != F.col("run_no")) & (F.greatest(F.col("_top") - F.col("low"), F.col("top") - F.col("_low")) <= LINE_SPACING)).select(*PAGE, "run_no").distinct().withColumn("_flow", F.lit(True))
    text = F.trim("text")
    label = F.col("written") & (F.col("rect.width") <= LABEL_WIDTH) & ~text.rlike(CAPTION) & ~text.rlike(HEADING) & (~F.col("_on") | F.col("_flow").isNull())
    return put.join(flow, [*PAGE, "run_no"], "left").withColumn("label", label).drop("_on", "_flow", "margins")


def drawings(runs: DataFrame) -> DataFrame:
    """(doc_id, page, region_no, caption, x, y, width, height): bands of labels tall and full enough to be a drawing.

    A band ends where the next label is far below all so far, or prose stands between. The reach of a band is a running
    maximum: a break means that the next label lies beyond it, so the maximum over all labels before is the band's own.
    """
    all_runs = classified(runs)
    labels = all_runs.filter("label")
    by = Window.partitionBy(*PAGE).orderBy("top", "run_no")
    reach = labels.withColumn("_reach", F.max("low").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    prose = all_runs.filter(~F.col("label") & F.col("written")).select(*PAGE, F.col("top").alias("_pt"), F.col("low").alias("_pl"))
    parted = reach.join(prose, PAGE).filter((F.col("_pt") >= F.col("_reach")) & (F.col("_pl") <= F.col("top"))).select(*PAGE, "run_no").distinct().withColumn("_parted", F.lit(True))
    breaks = reach.join(parted, [*PAGE, "run_no"], "left").withColumn("_break", F.when(F.col("_reach").isNotNull() & ((F.col("top") - F.col("_reach") > LABEL_GAP) | F.col("_parted").isNotNull()), 1).otherwise(0))
    bands = breaks.withColumn("_band", F.sum("_break").over(by)).groupBy(*PAGE, "_band").agg(F.count(F.lit(1)).alias("n"), F.min("top").alias("t"), F.max("low").alias("b"), F.min("rect.x").alias("l"), F.max(F.col("rect.x") + F.col("rect.width")).alias("r"))
    kept = bands.filter((F.col("n") >= LEAST_LABELS) & (F.col("b") - F.col("t") >= LEAST_HEIGHT))
    named = all_runs.filter(F.col("written") & (F.col("rect.width") <= CAPTION_WIDTH) & F.trim("text").rlike(CAPTION)).select(*PAGE, F.col("run_no").alias("_c"), F.trim("text").alias("caption"), F.col("rect").alias("_cr"), F.col("low").alias("_cl"))
    above = kept.join(named, PAGE).filter((F.col("t") - F.col("_cl") >= 0) & (F.col("t") - F.col("_cl") <= CAPTION_GAP))
    nearest = above.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE, "_band").orderBy(F.col("_cl").desc(), "_c"))).filter("_n = 1").select(*PAGE, "_band", "caption", "_cr")
    boxed = kept.join(nearest, [*PAGE, "_band"], "left")
    c = F.col("_cr")
    left = F.greatest(F.lit(0.0), F.least("l", c["x"]) - PAD)
    top = F.greatest(F.lit(0.0), F.least("t", c["y"]) - PAD)
    far = F.least(F.lit(1.0), F.greatest("r", c["x"] + c["width"]) + PAD)
    low = F.least(F.lit(1.0), F.greatest("b", c["y"] + c["height"]) + PAD)
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("_band")) - 1
    return boxed.select(*PAGE, place.alias("region_no"), "caption", left.alias("x"), top.alias("y"), (far - left).alias("width"), (low - top).alias("height"))


def ground(regions: DataFrame, drawn: DataFrame, ids: list[str]) -> DataFrame:
    """For each region (ids, doc_id, page, x, y, width, height) the drawing it means, if any: most overlap, else nearest in
    height within 0.15; of equal ones the first."""
    d = drawn.select(*PAGE, "region_no", "caption", F.struct("x", "y", "width", "height").alias("_d"))
    met = regions.join(d, PAGE)
    wide = F.least(F.col("x") + F.col("width"), F.col("_d.x") + F.col("_d.width")) - F.greatest("x", "_d.x")
    tall = F.least(F.col("y") + F.col("height"), F.col("_d.y") + F.col("_d.height")) - F.greatest("y", "_d.y")
    area = F.when((wide > 0) & (tall > 0), wide * tall).otherwise(0.0)
    gap = F.greatest(F.lit(0.0), F.col("_d.y") - (F.col("y") + F.col("height")), F.col("y") - (F.col("_d.y") + F.col("_d.height")))
    scored = met.withColumn("_area", area).withColumn("_gap", gap).filter((F.col("_area") > 0) | (F.col("_gap") <= NEAR))
    best = Window.partitionBy(*ids).orderBy(F.col("_area").desc(), F.col("_gap"), F.col("region_no"))
    return scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*ids, *PAGE, "region_no", "caption", F.col("_d.x").alias("x"), F.col("_d.y").alias("y"), F.col("_d.width").alias("width"), F.col("_d.height").alias("height"))


def by_caption(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first drawing of each document with a wanted caption (doc_id, caption), whatever the case."""
    key = lambda c: F.lower(F.trim(c))
    met = drawn.withColumn("_k", key("caption")).join(wanted.select("doc_id", key("caption").alias("_k")), ["doc_id", "_k"])
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_k").orderBy("page", "region_no"))).filter("_n = 1").drop("_n", "_k")


def clamp_region(region: Column, pages: Column) -> Column:
    """A model's box on an existing page, inside it."""
    fine = lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))
    x, y = fine(region["x"]), fine(region["y"])
    page = F.least(F.greatest(F.lit(0), region["page"].cast("int")), F.greatest(F.lit(0), pages - 1))
    return F.struct(page.alias("page"), x.alias("x"), y.alias("y"), F.least(1.0 - x, fine(region["width"])).alias("width"), F.least(1.0 - y, fine(region["height"])).alias("height"))
