"""Rows of ink on a page image, from its pixels: one page is one row, numpy inside an Arrow function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = "array<struct<top:double,bottom:double,left:double,right:double>>"
#: Darkness, and lengths as parts of the page. Fixed values.
DARK, RULED_RUN, RULED_COLUMN = 110, 0.30, 0.35
LEAST_INK, JOIN, LEAST_TALL = 0.004, 0.003, 0.008
SPLIT, VALLEY, DEEPEST, EDGE = 1.35, 0.45, 3, 0.01


def _longest_run(dark: np.ndarray) -> np.ndarray:
    """The longest run of True in each row."""
    best = np.zeros(len(dark), dtype=int)
    now = np.zeros(len(dark), dtype=int)
    for column in dark.T:
        now = np.where(column, now + 1, 0)
        best = np.maximum(best, now)
    return best


def _bands(filled: np.ndarray, join: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], filled.astype(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for a, b in zip(edges[::2], edges[1::2]):
        if out and a - out[-1][1] <= join:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _split(ink: np.ndarray, a: int, b: int, usual: int, least: int, depth: int = 0) -> list[tuple[int, int]]:
    """A band much taller than usual is two lines that touch: cut at a clear valley in its middle half, which goes to neither."""
    if depth > DEEPEST or b - a < SPLIT * usual or b - a < 2 * least:
        return [(a, b)]
    low, high = a + (b - a) // 4, b - (b - a) // 4
    at = low + int(np.argmin(ink[low:high]))
    if ink[at] > VALLEY * ink[a:b].mean():
        return [(a, b)]
    return _split(ink, a, at, usual, least, depth + 1) + _split(ink, at + 1, b, usual, least, depth + 1)


def _rounded(x: float) -> int:
    return math.floor(x + 0.5)


def ink_rows(pixels: bytes, width: int, height: int) -> list[tuple[float, float, float, float]]:
    """(top, bottom, left, right) in parts of the page, for each row of writing in an RGB image; ruled lines don't count."""
    if not width or not height or len(pixels) < 3 * width * height:
        return []
    rgb = np.frombuffer(pixels, dtype=np.uint8, count=3 * width * height).reshape(height, width, 3).astype(int)
    dark = (299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2]) / 1000 < DARK
    ruled, margin = _longest_run(dark) > RULED_RUN * width, dark.sum(axis=0) > RULED_COLUMN * height
    dark[ruled] = False
    dark[:, margin] = False
    ink, least = dark.sum(axis=1), max(2, _rounded(LEAST_TALL * height))
    bands = [x for x in _bands(ink >= max(3, _rounded(LEAST_INK * width)), max(1, _rounded(JOIN * height))) if x[1] - x[0] >= least]
    if not bands:
        return []
    usual = sorted(b - a for a, b in bands)[len(bands) // 2]
    out = []
    for a, b in [x for band in bands for x in _split(ink, *band, usual, least)]:
        if b - a < least:
            continue
        across = np.cumsum(dark[a:b].sum(axis=0))
        n = int(across[-1])
        # The places of the dots at a hundredth from either end.
        left = int(np.searchsorted(across, math.floor(n * EDGE) + 1)) if n else 0
        right = int(np.searchsorted(across, min(n - 1, math.ceil(n * (1 - EDGE))) + 1)) if n else 0
        out.append((a / height, b / height, left / width, max(left + 1, right + 1) / width))
    return out


def detect(pixels: Column, width: Column, height: Column) -> Column:
    @F.pandas_udf(ROWS)
    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        names = ("top", "bottom", "left", "right")
        return pd.Series([[dict(zip(names, map(float, r))) for r in ink_rows(bytes(x), int(y), int(z))] for x, y, z in zip(p, w, h)])

    return run(pixels, width, height)
