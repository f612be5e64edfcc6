"""Mark arithmetic: clamping, snapping, four-place rounding, confidence."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks come in halves; papers under this confidence go to a person; a blank question's confidence. Fixed values.
GRANULARITY = 0.5
REVIEW_BELOW = 0.65
BLANK_CONFIDENCE = 0.9


def round4_exact(value: Column) -> Column:
    """Four places by the exact value of the double, halves away from zero, in decimals: what `round4` is held against."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        place = Decimal("0.0001")
        return values.map(lambda v: float(Decimal(v).quantize(place, ROUND_HALF_UP)), na_action="ignore")

    return run(value)


def round4(value: Column) -> Column:
    """Four places by the exact value of the double, halves away from zero, without leaving the JVM.

    Spark's `round` goes by the shortest spelling of a double: 0.61725 is below its spelling, so the answer is 0.6172, not
    0.6173. Here the value is compared with the double nearest the midpoint of its two candidates; if it is that very
    double, the sign of its error decides, from a product split into two exact halves.
    """
    size = F.abs(value)
    low = F.floor(size * F.lit(10_000.0)).cast("double")
    odd = low * 2 + 1
    middle = odd / F.lit(20_000.0)
    wide = middle * F.lit(134_217_729.0)  # 2^27 + 1 splits a double into halves
    high = wide - (wide - middle)
    error = (high * 20_000.0 - odd) + (middle - high) * 20_000.0
    up = (size > middle) | ((size == middle) & (error >= 0))
    return F.signum(value) * (low + F.when(up, 1.0).otherwise(0.0)) / F.lit(10_000.0)


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def snap(value: Column, step: float = GRANULARITY) -> Column:
    """The nearest multiple of step, halves upward; unchanged if step isn't positive."""
    return value if step <= 0 else F.floor(value / F.lit(float(step)) + 0.5) * F.lit(float(step))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def clamp_kind(raw: Column, most: Column) -> Column:
    """The audit kind of a mark out of range; null for a mark in range."""
    return F.when(~is_finite(raw), "clamped_below_zero").when(raw > most, "clamped_above_max").when(raw < 0, "clamped_below_zero")


def clamp_mark(raw: Column, most: Column, step: float = GRANULARITY) -> Column:
    """A mark in range: out of range at the bound as it stands, in range snapped, but never over the maximum."""
    return F.when(~is_finite(raw) | (raw < 0), 0.0).when(raw > most, most.cast("double")).otherwise(F.least(most.cast("double"), snap(raw, step)))


def percentage(part: Column, whole: Column) -> Column:
    return F.floor(F.try_divide(part * 100.0, whole) + 0.5).cast("int")


def backoff_ms(attempt: Column, base: int = 400) -> Column:
    """The wait after an attempt: 400, 800, 1600 ms ..."""
    return (F.lit(base) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def confidence_factors(draft: dict[str, Column]) -> list[tuple[str, Column, Column]]:
    """The terms of a question's confidence: (sentence, whether it applies, the change as a function's value).

    draft: self, quoted, verified, clamps, repairs, missing, chars, approximate, transcribed, unclear, unresolved, regions.
    """
    d = draft
    ratio = F.try_divide(d["verified"].cast("double"), d["quoted"].cast("double"))
    read = F.coalesce(d["transcribed"], F.lit(False))
    return [
        ("quotes verified", d["quoted"] > 0, 0.6 + 0.4 * ratio),
        ("no quotes given", d["quoted"] <= 0, F.lit(0.85)),
        ("marks out of range", d["clamps"] > 0, -F.least(F.lit(0.3), 0.1 * d["clamps"])),
        ("output repaired", d["repairs"] > 0, -0.15 * d["repairs"]),
        ("rubric points unmarked", d["missing"] > 0, -F.least(F.lit(0.4), 0.12 * d["missing"])),
        ("very short answer", (d["chars"] > 0) & (d["chars"] < 200), F.lit(-0.1)),
        ("answer bounds approximate", d["approximate"], F.lit(-0.08)),
        ("read from a scan", read, -(0.05 + F.least(F.lit(0.2), 0.03 * d["unclear"]))),
        ("quotes not placed", ~read & (d["unresolved"] > 0), -F.least(F.lit(0.15), 0.04 * d["unresolved"])),
        ("regions approximate", ~read & (d["regions"] > 0), -F.least(F.lit(0.1), 0.03 * d["regions"])),
    ]


def question_confidence(draft: dict[str, Column]) -> Column:
    """(value, factors): the self-confidence, scaled by its quotes and lowered term by term, and the terms that applied."""
    terms = confidence_factors(draft)
    value = clamp01(draft["self"])
    for _, applies, change in terms[:2]:
        value = value * F.when(applies, change).otherwise(1.0)
    for _, applies, change in terms[2:]:
        value = value + F.when(applies, change).otherwise(0.0)
    said = F.array_compact(F.array(*[F.when(applies, F.lit(sentence)) for sentence, applies, _ in terms]))
    return F.struct(round4(clamp01(value)).alias("value"), said.alias("factors"))


def paper_confidence(confidence: Column, weight: Column) -> Column:
    """An aggregate: three quarters the mean weighted by maximum marks, one quarter the least; 0 without weight."""
    mean = F.try_divide(F.sum(confidence * weight), F.sum(weight))
    return round4(clamp01(F.coalesce(0.75 * mean + 0.25 * F.min(confidence), F.lit(0.0))))
