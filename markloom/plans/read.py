"""Scanned documents read end to end: pages without text to a transcriber, in order; text, runs and status out.

Each page is read with the end of the page before it, so a document's pages are a fold, in a task's own loop over its sorted
pages; documents run apart. A page is asked about again where its reply fails or is misshapen (after a wait that
doubles), once with a smaller image where it is refused or its transcript loops, and once for its drawings alone where one
is marked without being described. What comes after that is relational: unstable transcripts cleaned, markers expanded,
lines moved onto ink rows, headings mended with all numbers that any page of the document told, runs placed in the text.

Defined cases: pages with text stay as they are; a document of which a page can't be read keeps its pages and has failed,
with the reason; without a transcriber all documents with unread pages are unsupported; documents that lack nothing
aren't listed; no pages give no rows.
"""

from __future__ import annotations

import json
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import needs_transcription, normalise_headings
from ..operators import passes, transcript
from .rounds import Rules
from .steps import settled

#: Characters of a page that the next one is read with. Fixed value.
TAIL = 300
BOX = "top: DOUBLE, bottom: DOUBLE, left: DOUBLE, right: DOUBLE"
TRANSCRIPT = f"lines ARRAY<STRUCT<text: STRING, {BOX}>>, diagrams ARRAY<STRUCT<marker: INT, description: STRING, labels: ARRAY<STRING>, {BOX}>>, unclear ARRAY<STRING>, struck ARRAY<STRING>, questionNumbers ARRAY<INT>, legibility STRING"
KEYS = ["doc_id", "page"]

#: One page to read, as a mapping: doc_id, page, page_count, previous_tail, smaller, focus (None or diagrams) and the further
#: columns of pages, such as an image; out: (outcome, raw, message), the outcome ok, transient, too_large or permanent.
Transcriber = Callable[[dict], tuple[str, str | None, str | None]]


class Read(NamedTuple):
    """pages: doc_id, page, text, source. runs: doc_id, page, run_no, text, start, end, rect. documents: doc_id, status
    (done, failed or unsupported), read (its pages), legibility, unclear, error."""

    pages: DataFrame
    runs: DataFrame | None
    documents: DataFrame


def _shape(raw: str | None) -> tuple[dict | None, str]:
    """A reply as a transcript, or what is wrong with it."""
    try:
        got = json.loads(raw[raw.index("{") : raw.rindex("}") + 1])
    except (AttributeError, ValueError):
        return None, "(root): not a JSON object"
    lines, drawings = got.get("lines"), got.get("diagrams", [])
    wrong = [f"lines.{i}.text: Required" for i, x in enumerate(lines if isinstance(lines, list) else []) if not isinstance(x, dict) or not isinstance(x.get("text"), str)]
    wrong += [f"diagrams.{i}: marker and description Required" for i, x in enumerate(drawings) if not isinstance(x, dict) or not isinstance(x.get("marker"), int) or not isinstance(x.get("description"), str)]
    wrong += [] if isinstance(lines, list) else ["lines: Required"]
    wrong += [] if got.get("legibility") in ("good", "fair", "poor") else ["legibility: Expected one of good, fair, poor"]
    fine = {"diagrams": [], "unclear": [], "struck": [], "questionNumbers": []} | got
    return (None, "; ".join(wrong[:3])) if wrong else (fine, "")


_MARKER = re.compile(transcript.MARKER)


def _loops(page: dict) -> bool:
    """As `transcript.degenerate`, for one page."""
    text = [x["text"] for x in page["lines"]]
    again = Counter(t.strip() for t in text if len(t.strip()) >= transcript.LONG_LINE)
    return sum(map(len, text)) + len(text) - 1 > transcript.MOST_CHARS or sum(len(_MARKER.findall(t)) for t in text) > transcript.MOST_MARKERS or sum(n > 1 for n in again.values()) >= transcript.MOST_REPEATS


def _tail(page: dict) -> str:
    """The end of a page as it will be read: drawings described, repeats of long lines dropped."""
    told = {d["marker"]: d["description"] for d in page["diagrams"]}
    seen, lines = set(), []
    for x in page["lines"]:
        key = x["text"].strip()
        if len(key) >= transcript.LONG_LINE and key in seen:
            continue
        seen.add(key)
        lines.append(_MARKER.sub(lambda m: f"[Diagram {m[1]}: {told.get(int(m[1]), '?').strip()}]", x["text"].rstrip()))
    return "\n".join(lines)[-TAIL:]


def _one_page(ask: Transcriber, row: dict, rules: Rules, pause: Callable[[float], None], smaller: bool = False) -> tuple[dict | None, bool, str | None]:
    """(transcript, unstable, error) of one page."""
    error = None
    for attempt in range(1, rules.attempts + 1):
        outcome, raw, message = ask(row | {"smaller": smaller, "focus": None})
        if outcome == "too_large" and not smaller:
            return _one_page(ask, row, rules, pause, smaller=True)
        if outcome in ("too_large", "permanent"):
            return None, False, message or "The page was refused."
        page, wrong = _shape(raw) if outcome == "ok" else (None, "")
        if page is not None and _loops(page):
            return (page, True, None) if smaller else _one_page(ask, row, rules, pause, smaller=True)
        if page is not None:
            return _drawings(ask, row, page, smaller), False, None
        error = f"The transcriber's reply for page {row['page'] + 1} did not match the expected shape: {wrong}" if wrong else message or "The transcriber was not reached."
        if attempt < rules.attempts:
            pause(rules.wait_ms * 2 ** (attempt - 1) / 1000)
    return None, False, error


def _drawings(ask: Transcriber, row: dict, page: dict, smaller: bool) -> dict:
    """The page with drawings described that were only marked, if the transcriber can when asked for them alone."""
    known = {d["marker"] for d in page["diagrams"]}
    if {int(m) for x in page["lines"] for m in _MARKER.findall(x["text"])} <= known:
        return page
    outcome, raw, _ = ask(row | {"previous_tail": None, "smaller": smaller, "focus": "diagrams"})
    more = _shape(raw)[0] if outcome == "ok" else None
    return page | {"diagrams": page["diagrams"] + [d for d in more["diagrams"] if d["marker"] not in known]} if more else page


def transcribed(pages: DataFrame, ask: Transcriber, rules: Rules = Rules(), pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(doc_id, page, transcript, unstable, error) of pages that lack text; a document's pages in order, until one fails."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    wanted = pages.filter(needs_transcription(F.col("text"), F.col("source"))).join(counts, "doc_id")
    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, tail, lost = None, None, False
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                if row["doc_id"] != doc:
                    doc, tail, lost = row["doc_id"], None, False
                if lost:
                    continue
                page, unstable, error = _one_page(ask, row | {"previous_tail": tail}, rules, pause)
                lost = page is None
                tail = _tail(page) if page else None
                rows.append((doc, row["page"], json.dumps(page) if page else None, unstable, error))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "transcript", "unstable", "error"])

    return wanted.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInPandas(run, f"doc_id {kind}, page int, transcript string, unstable boolean, error string")


def read_documents(pages: DataFrame, ask: Transcriber | None, ink: DataFrame | None = None, rules: Rules = Rules(), pause: Callable[[float], None] = time.sleep) -> Read:
    """Documents' pages (doc_id, page, text, source and what the transcriber needs) with those that lack text read.

    ink: (doc_id, page, top, bottom, left, right) rows of ink of scanned pages, as `pixels` finds them.
    """
    targets = transcript.pages_to_read(pages)
    whole = pages.select(*KEYS, "text", "source")
    if ask is None:
        said = F.lit("The transcriber cannot read images, so the scanned pages could not be transcribed.")
        none = [F.lit(None).cast("string").alias("legibility"), F.array().cast("array<string>").alias("unclear"), said.alias("error")]
        return Read(whole, None, targets.select("doc_id", F.lit("unsupported").alias("status"), F.col("pages").alias("read"), *none))
    replies = settled(transcribed(pages, ask, rules, pause))
    failed = replies.filter("transcript IS NULL").groupBy("doc_id").agg(F.min("error").alias("error"))
    sound = settled(replies.join(failed, "doc_id", "left_anti").withColumn("t", F.from_json("transcript", TRANSCRIPT)).drop("transcript", "error"))
    box = lambda x: transcript.normalise_box(x["top"], x["bottom"], x["left"], x["right"])
    lines = sound.select(*KEYS, "unstable", F.posexplode("t.lines").alias("line", "l")).select(*KEYS, "unstable", "line", F.rtrim(F.replace("l.text", F.lit("\r\n"), F.lit("\n"))).alias("text"), box(F.col("l")).alias("box"))
    drawn = sound.select(*KEYS, F.posexplode("t.diagrams").alias("ordinal", "d")).select(*KEYS, "ordinal", "d.marker", "d.description", F.coalesce("d.labels", F.array().cast("array<string>")).alias("labels"), box(F.col("d")).alias("box"))
    lines, drawn = settled(lines), settled(drawn)
    clean = transcript.sanitise(lines.filter("unstable"), drawn, KEYS).unionByName(lines.filter("NOT unstable")).drop("unstable")
    last = clean.groupBy(*KEYS).agg(F.max("line").alias("_last"))
    composed = settled(transcript.expand_markers(clean, drawn, KEYS).join(last, KEYS, "left").filter((F.trim("text") != "") | (F.col("line") < F.col("_last"))).drop("_last"))
    if ink is not None:
        plain = composed.filter(~F.col("text").startswith("[Diagram")).select(*KEYS, F.col("line").cast("int").alias("line"), "box.top", "box.bottom", "box.left", "box.right")
        moved = transcript.snap_lines(plain, ink.join(sound.select(*KEYS), KEYS, "left_semi").select(*KEYS, "top", "bottom", "left", "right"))
        at = moved.filter("top IS NOT NULL").select(*KEYS, "line", F.struct("top", "bottom", "left", "right").alias("_at"))
        composed = composed.join(at, [*KEYS, "line"], "left").withColumn("box", F.coalesce("_at", "box")).drop("_at")
    numbers = sound.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("t.questionNumbers"))).alias("_n"))
    mended = settled(composed.join(numbers, "doc_id").withColumn("text", normalise_headings(F.col("text"), F.coalesce("_n", F.array().cast("array<int>")))).drop("_n"))
    texts, runs = transcript.page_text(mended, KEYS)
    blank = sound.select(*KEYS).join(texts.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit("").alias("text"))
    new = texts.unionByName(blank).select(*KEYS, F.col("text").alias("_text"))
    out = whole.join(new, KEYS, "left").select(*KEYS, F.coalesce("_text", "text").alias("text"), F.when(F.col("_text").isNotNull(), "transcription").otherwise(F.col("source")).alias("source"))
    rated = transcript.rated_unstable(sound.select(*KEYS, F.col("t.legibility").alias("legibility"), F.col("t.unclear").alias("unclear")), sound.filter("unstable"), KEYS)
    worst = passes.worst_legibility(rated, ["doc_id"])
    unsure = rated.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "unclear"))), lambda x: x["unclear"])).alias("unclear"))
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("done")
    documents = targets.join(failed, "doc_id", "left").join(worst, "doc_id", "left").join(unsure, "doc_id", "left")
    return Read(out, runs, documents.select("doc_id", status.alias("status"), F.col("pages").alias("read"), "legibility", F.coalesce("unclear", F.array().cast("array<string>")).alias("unclear"), "error"))
