"""Quality rules as a short-circuit cascade, with built-in DataFrame functions only.

A rule is a name and a condition under which a text is rejected. On a bounded sample the cascade measures what each rule
costs (seconds to run it alone over many copies of the sample in one task, less those of a run without a rule) and how
many texts it rejects, and then tests rules in order of rejections per second: most texts that go are gone after cheap
rules, and the dear ones run on the rest alone. Costs count by powers of COARSE, so that the noise of a clock seldom
changes the order. The order changes only which rule is named first and what the cascade costs; a text is kept if no rule
rejects it, in any order.

Counts of repeated windows need no shuffle: a text's windows are hashed, and only texts in which a hash occurs twice
sort their windows (as strings, so that the count is exact).

Defined cases: a null or empty text has no words and is rejected as short; texts of fewer than three words have no
window; an empty table gives no rows; repeated rows are judged alike; further columns pass through `keep` unchanged.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: The sample on which costs and rejections are estimated: of the first rows, one in SPREAD by a hash of its text, up to
#: SAMPLE_ROWS, of texts of up to SAMPLE_CHARS each. Only the order of the rules follows from it.
SAMPLE_ROWS, SAMPLE_CHARS, SPREAD = 200, 50_000, 8
#: Copies of the sample in timed runs: the next number where a rule took under LEAST_S. And the step by which costs differ.
COPIES, LEAST_S, COARSE = (1, 8), 0.1, 4.0

#: Limits of the rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # words in repeated windows, % of words
MOST_SYMBOLS = 5  # symbols, % of characters in words
MOST_DUP_LINES = 50  # repeated lines, % of lines with a word
LEAST_LETTERS = 50  # runs of letters, % of words


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words covered by windows (w: string, i: place) that occur twice or more."""

    def places(ordered: Column) -> Column:
        same = F.transform(ordered, lambda x, k: F.when((x["w"] == F.get(ordered, k - 1)["w"]) | (x["w"] == F.get(ordered, k + 1)["w"]), x["i"]))
        return F.sort_array(F.array_compact(same))

    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    step = lambda s, i: F.struct((s["n"] + F.least(i - s["at"], F.lit(3))).alias("n"), i.alias("at"))
    return F.aggregate(let(F.sort_array(windows), places), start, step, lambda s: s["n"])


def repeated_words(words: Column) -> Column:
    """Words of `words` (a column or a bound variable, not an expression) in a three-word window found twice or more, the first included."""
    n = F.size(words) - 2
    hashes = F.transform(F.slice(words, 1, F.greatest(n, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.transform(F.slice(words, 1, n), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    return F.when(n < 2, 0).when(F.size(F.array_distinct(hashes)) == n, 0).otherwise(_covered(windows)).cast("long")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """What the rules look at, by name; text has no nulls, words is the column of its words."""
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "lines": lines,
        "n_letter_runs": F.regexp_count(text, F.lit(r"\p{L}+")).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def rules(m: dict[str, Column]) -> dict[str, Column]:
    """The conditions under which a text is rejected, by name."""
    return {
        "few_words": m["n_words"] < LEAST_WORDS,
        "symbols": m["n_symbols"] * 100 > m["word_chars"] * MOST_SYMBOLS,
        "repeated_lines": let(m["lines"], lambda x: x["dup"] * 100 > x["n"] * MOST_DUP_LINES),
        "few_letters": m["n_letter_runs"] * 100 < m["n_words"] * LEAST_LETTERS,
        "repeated_words": m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED,
    }


def sampled(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample of texts (_text, no nulls), as a table of the driver in one partition. Files are read only up to its last row."""
    whole = F.coalesce(docs[text], F.lit(""))
    drawn = docs.filter((F.pmod(F.xxhash64(whole), F.lit(SPREAD)) == 0) & (F.length(whole) <= SAMPLE_CHARS)).select(whole.alias("_text")).take(rows)
    return docs.sparkSession.createDataFrame(pa.table({"_text": pa.array([r["_text"] for r in drawn], pa.string())})).coalesce(1)


def order_rules(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds over the timed copies of the sample, part rejected), the most rejections per second first."""
    sample = sampled(docs, text, rows).withColumn("_words", words_of(F.col("_text")))
    n = max(1, sample.count())

    def run(rejects: Column, copies: int) -> tuple[float, int]:
        query = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).agg(F.count_if(rejects).alias("n"))
        query.first()
        began = time.perf_counter()
        rejected = query.first()["n"]
        return time.perf_counter() - began, rejected

    idle = {k: run(F.size("_words") + F.col("_copy") < 0, k)[0] for k in COPIES}
    found = []
    for name, rejects in rules(measures(F.col("_text"), F.col("_words"))).items():
        for copies in COPIES:
            took, rejected = run(rejects, copies)
            if took - idle[copies] >= LEAST_S:
                break
        found.append((name, max(took - idle[copies], 1e-3) / copies, rejected / n / copies))
    step = lambda seconds: round(math.log(seconds, COARSE))
    return sorted(found, key=lambda x: (-(x[2] + 1e-4) / COARSE ** step(x[1]), x[0]))


def verdict(conditions: dict[str, Column], order: list[str]) -> Column:
    """The first rule, in this order, that rejects; null keeps. Later rules aren't evaluated."""
    out = F.when(conditions[order[0]], order[0])
    for name in order[1:]:
        out = out.when(conditions[name], name)
    return out


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs alone."""
    order = [name for name, _, _ in order_rules(docs, text)]
    whole = F.coalesce(docs[text], F.lit(""))
    # Bound in the row: a filter would be pushed below the column of words, and split the text again for every word.
    judged = let(F.struct(whole.alias("t"), words_of(whole).alias("w")), lambda x: verdict(rules(measures(x["t"], x["w"])), order))
    return docs.filter(judged.isNull())


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's measures, first rejecting rule and whether it is kept."""
    order = [name for name, _, _ in order_rules(docs, text)]
    whole = F.coalesce(docs[text], F.lit(""))
    # One column for all measures, its words bound in the row (see `keep`).
    made = let(F.struct(whole.alias("t"), words_of(whole).alias("w")), lambda x: F.struct(*[c.alias(n) for n, c in measures(x["t"], x["w"]).items()]))
    measured = docs.select(docs[doc_id].alias("doc_id"), made.alias("_m")).select("doc_id", "_m.*")
    failed = verdict(rules({n: F.col(n) for n in measured.columns[1:]}), order)
    out = measured.withColumn("_failed", failed)
    base_failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines")["dup"].cast("long").alias("n_dup_lines"), "n_repeat_words", base_failed.alias("base_failed"), F.col("_failed").isNull().alias("kept"))
