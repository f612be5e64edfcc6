"""Documents into chunks under a token budget: question blocks, greedy packing, splitting of what is too large.

Headings depend on what came before (numbers only climb and never repeat), and a pack on what it already holds, so these
are folds over the lines of one document: array functions in the row, no shuffle. Only the cascade for a block larger
than a whole chunk is a pandas function.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, estimate_tokens, strip

#: Lines that begin a section, a question or a part of one. Fixed values.
SECTION = r"(?i)^\s*SECTION\s*[-–—:]?\s*([A-Z])\b"
PREFIXED = r"(?i)^\s*(?:Q(?:uestion)?|Ques|Ans(?:wer)?)\.?\s*(?:No\.?\s*)?(\d{1,3})\b"
NUMBERED = r"^\s*\(?(\d{1,3})\)?\s*[.):]\s+\S"
BARE = r"^\s*(\d{1,3})\.?\s*$"
SUBPART = r"(?i)^\s*\(?(?:[a-h]|i{1,3}|iv|v|vi{1,3}|ix|x)\)\s*"
#: Without a list of questions a number is a heading only if it climbs by at most this much. Fixed value.
MOST_JUMP = 20


def heading_candidate(line: Column, expected: bool) -> Column:
    """The number a line would have as a heading; null if it can't be one."""
    found = [F.regexp_extract(line, p, 1) for p in (PREFIXED, NUMBERED, *([BARE] if expected else []))]
    first = F.coalesce(*[F.when(x != "", x) for x in found])
    return first.cast("int")


def line_blocks(lines: Column, expected: Column | None = None) -> Column:
    """For each line its block and heading number: array of (block, number); lines before any heading are block 0, number null.

    expected: the question numbers there are; null or absent means that numbers must climb.
    """
    numbers = F.transform(lines, lambda x: heading_candidate(x, expected is not None))
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("block"), F.lit(None).cast("int").alias("number"), F.lit(0).alias("lines"), F.array().cast("array<struct<block:int,number:int>>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        fits = F.array_contains(expected, n) if expected is not None else (s["last"].isNull() | ((n > s["last"]) & (n - s["last"] <= MOST_JUMP)))
        opens = n.isNotNull() & ~F.array_contains(s["seen"], n) & fits
        block = s["block"] + F.when(opens & (s["lines"] > 0), 1).otherwise(0)
        number = F.when(opens, n).otherwise(s["number"])
        return F.struct(
            F.when(opens, F.array_append(s["seen"], n)).otherwise(s["seen"]).alias("seen"), F.when(opens, n).otherwise(s["last"]).alias("last"), block.alias("block"), number.alias("number"), (s["lines"] + 1).alias("lines"),
            F.array_append(s["out"], F.struct(block.alias("block"), number.alias("number"))).alias("out"),
        )

    return F.aggregate(numbers, start, step, lambda s: s["out"])


def blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text", expected: Column | None = None) -> DataFrame:
    """(doc, block, number, section, text, tokens, first_line): the question blocks of each document."""
    lined = docs.select(doc, F.split(text, "\n").alias("_lines"), *([expected.alias("_exp")] if expected is not None else []))
    marked = lined.withColumn("_b", line_blocks(F.col("_lines"), F.col("_exp") if expected is not None else None))
    rows = marked.select(doc, F.posexplode(F.arrays_zip("_lines", "_b")).alias("line", "_x")).select(doc, "line", F.col("_x._lines").alias("t"), F.col("_x._b.block").alias("block"), F.col("_x._b.number").alias("number"))
    section = F.when(F.col("t").rlike(SECTION), strip(F.col("t")))
    so_far = F.last(section, ignorenulls=True).over(Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    own = F.first(section, ignorenulls=True).over(Window.partitionBy(doc, "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    put = rows.withColumn("_before", so_far).withColumn("_own", own)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    made = put.groupBy(doc, "block", "number").agg(F.min("line").alias("first_line"), F.min_by("_before", "line").alias("_before"), F.first("_own").alias("_own"), joined.alias("text"))
    named = F.coalesce("_before", F.when(F.col("number").isNull(), F.col("_own")))
    return made.select(doc, "block", "number", named.alias("section"), "text", estimate_tokens(F.col("text")).alias("tokens"), "first_line")


def pack(sizes: Column, budget: int) -> Column:
    """The group of each of the sizes: filled in order, a new one when the next doesn't fit; none is split."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        new = (F.size(s["out"]) > 0) & (s["held"] + n > budget)
        group = s["group"] + F.when(new, 1).otherwise(0)
        return F.struct(group.alias("group"), (F.when(new, 0).otherwise(s["held"]) + n).cast("long").alias("held"), F.array_append(s["out"], group).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


# ---- what is larger than a chunk --------------------------------------------------------------------------------

_WORD, _SYMBOL = re.compile(rf"[^{SPACES}]+"), re.compile(rf"[^\w{SPACES}]|_")


def _tokens(lines: list[str]) -> int:
    text = "\n".join(lines)
    return max(math.ceil(len(text) / 3.2), math.ceil(len(_WORD.findall(text)) * 1.3 + len(_SYMBOL.findall(text)) * 0.5)) if text else 0


def _runs(lines: list[str], opens) -> list[list[str]]:
    out: list[list[str]] = []
    for k, line in enumerate(lines):
        if not out or (opens(k, line) and out[-1]):
            out.append([])
        out[-1].append(line)
    return out


def _packed(runs: list[list[str]], budget: int) -> list[list[str]]:
    out, held = [], 0
    for run in runs:
        n = _tokens(run)
        if not out or held + n > budget:
            out.append([])
            held = 0
        out[-1] += run
        held += n
    return out


def _cut(line: str, budget: int) -> list[str]:
    most, out = max(200, int(budget * 3)), []
    while len(line) > most:
        at = line.rfind(" ", 0, most + 1)
        at = most if at < most / 2 else at
        out.append(line[:at])
        line = line[at:].lstrip()
    return [*out, line] if line else out


def split_text(text: str, budget: int) -> list[str]:
    """A text as pieces under the budget: at sub-parts, else blank lines, else lines, else words of a long line."""
    lines = text.split("\n")
    if _tokens(lines) <= budget:
        return [text]
    subpart = re.compile(SUBPART)
    for opens in (lambda k, x: bool(subpart.match(x)), lambda k, x: k > 0 and not lines[k - 1].strip(), lambda k, x: True):
        runs = _runs(lines, opens)
        if len(runs) > 1 and all(_tokens(r) <= budget for r in runs):
            break
    else:
        runs = [[piece] for x in lines for piece in (_cut(x, budget) if _tokens([x]) > budget else [x])]
    pieces = ["\n".join(p).strip() for p in _packed(runs, budget)]
    return [p for p in pieces if p]


def split_refused(text: str, budget: int) -> list[str]:
    """The parts of a chunk that a judge refused as too large: as `split_text`, else its two halves by lines, else itself."""
    pieces = split_text(text, budget)
    lines = text.split("\n")
    if len(pieces) > 1 or len(lines) < 2:
        return pieces
    middle = -(-len(lines) // 2)
    return [p for p in ("\n".join(lines[:middle]).strip(), "\n".join(lines[middle:]).strip()) if p]


def split_oversized(text: Column, budget: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, budget), na_action="ignore")

    return run(text)


def chunks(docs: DataFrame, budget: int, doc: str = "doc_id", text: str = "text", expected: Column | None = None) -> DataFrame:
    """(doc, chunk, total, section, numbers, part, parts, text, tokens): blocks packed in order, large ones split into parts."""
    own = blocks(docs, doc, text, expected).withColumn("_big", F.col("tokens") > budget)
    order = Window.partitionBy(doc).orderBy("block")
    # A large block stands alone: packing starts anew after it.
    stretch = own.withColumn("_s", F.sum(F.col("_big").cast("int")).over(order))
    small = stretch.filter(~F.col("_big")).groupBy(doc, "_s").agg(F.sort_array(F.collect_list(F.struct("block", "number", "section", "text", "tokens"))).alias("_l"))
    grouped = small.withColumn("_g", pack(F.transform("_l", lambda x: x["tokens"]), budget)).select(doc, "_s", F.explode(F.arrays_zip("_l", "_g")).alias("x")).select(doc, "_s", F.col("x._g").alias("_g"), "x._l.*")
    listed = F.sort_array(F.collect_list(F.struct("block", "number", "section", "text")))
    whole = grouped.groupBy(doc, "_s", "_g").agg(listed.alias("l")).select(
        doc, F.get("l", F.lit(0))["block"].alias("_at"), F.get("l", F.lit(0))["section"].alias("section"), F.filter(F.transform("l", lambda x: x["number"]), lambda n: n.isNotNull()).alias("numbers"),
        F.lit(0).alias("part"), F.lit(1).alias("parts"), strip(F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("text"),
    )
    large = stretch.filter("_big").withColumn("_p", split_oversized(F.col("text"), budget)).select(
        doc, F.col("block").alias("_at"), "section", F.when(F.col("number").isNull(), F.array().cast("array<int>")).otherwise(F.array("number")).alias("numbers"), F.posexplode("_p").alias("part", "text"), F.size("_p").alias("parts")
    )
    both = whole.unionByName(large).filter("text != ''")
    place = Window.partitionBy(doc).orderBy("_at", "part")
    return both.select(doc, (F.row_number().over(place) - 1).alias("chunk"), F.count(F.lit(1)).over(Window.partitionBy(doc)).cast("int").alias("total"), "section", "numbers", "part", "parts", "text", estimate_tokens(F.col("text")).alias("tokens"))


def question_texts(docs: DataFrame, expected: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, number, text): the verbatim text of each expected question."""
    return blocks(docs, doc, text, expected).filter("number IS NOT NULL").select(doc, "number", strip(F.col("text")).alias("text")).filter("text != ''")
