"""Rows dealt to tasks in a total order, each task also getting the rows just before and after its own.

The order is that of a key column, of a hash of the row's text where keys are equal, and of the row's place in the input
where those are equal too; so no two rows have one place, and rows of one key, null keys or copies of one row are cut like
any others. `deal` cuts the order into ranges of about RANGE_BYTES and sends each range to a partition of its own, sorted.
The first row of each range is sent a second time, to the end of the range before, and the last row of each range to the
start of the range after, so that a task can look at both neighbours of all its rows without a global window.

Where ranges begin and end is read off the narrow columns alone, which are sorted and settled once: bytes are summed within
each partition of the engine's own range exchange, partitions' sums are added up, and a row's range is its share of all
bytes. The driver holds a first and a last key for each range, MOST_RANGES at most; beyond that ranges grow.

Rows must come from files or a checkpoint: a row's place has to be the same whenever a task runs again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Bytes of text of a range; there are at least as many ranges as shuffle partitions, and never more than MOST_RANGES.
RANGE_BYTES, MOST_RANGES = 64 << 20, 100_000
#: What a row counts besides its text.
ROW_BYTES = 64
ORDER = ["_key", "_tie", "_place"]


def edges_of(rows: DataFrame, ranges: int | None = None) -> list[tuple[int, tuple, tuple]]:
    """(range, first, last) of each range with rows, ascending, in the order of rows (_key, _tie, _place, _bytes)."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upto = 0
        for batch in batches:
            ends = upto + batch["_bytes"].cumsum()
            yield batch[[*ORDER, "_part"]].assign(_start=ends - batch["_bytes"])
            upto = int(ends.iloc[-1]) if len(ends) else upto

    ranged = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    held = settle(ranged.withColumn("_part", F.spark_partition_id()))
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    parts = held.groupBy("_part").agg(F.sum("_bytes").alias("_sum"))  # a row for each partition
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    total = parts.agg(F.sum("_sum")).first()[0] or 0
    ranges = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-total // RANGE_BYTES)))
    started = held.mapInPandas(summed, ", ".join(f"{c} {kinds[c]}" for c in (*ORDER, "_part")) + ", _start long")
    point = F.struct(*ORDER)
    number = F.floor((F.col("_before") + F.col("_start")) / F.lit(max(1, total) / ranges)).cast("int")
    found = started.join(F.broadcast(before), "_part").groupBy(F.least(number, F.lit(ranges - 1)).alias("_range")).agg(F.min(point).alias("lo"), F.max(point).alias("hi"))
    return sorted((r["_range"], tuple(r["lo"].values()), tuple(r["hi"].values())) for r in found.toArrow().to_pylist())


def _held(cuts: pd.DataFrame, kind: str) -> list[Column]:
    """The cut points as three constant arrays."""
    return [F.from_json(F.lit(json.dumps(cuts[name].tolist(), ensure_ascii=False)), f"array<{k}>") for name, k in zip(ORDER, (kind, "bigint", "bigint"))]


def _compared(arrays: list[Column], at: Column, equal: bool) -> Column:
    """Whether the point at this place of the arrays is the row's (equal), or the row's or before it."""
    pairs = [(F.get(a, at), F.col(name)) for a, name in zip(arrays, ORDER)]
    same = reduce(lambda x, y: x & y, [p == c for p, c in pairs])
    (a, x), (b, y), (c, z) = pairs
    return same if equal else (a < x) | ((a == x) & ((b < y) | ((b == y) & (c <= z))))


def range_no(cuts: pd.DataFrame, kind: str) -> Column:
    """The number of cuts at or before the row, by bisection of the constant arrays."""
    if not len(cuts):
        return F.lit(0)
    arrays = _held(cuts, kind)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(_compared(arrays, at + step - 1, equal=False), at + step).otherwise(at))


def deal(rows: DataFrame, key: str, text: str, columns: dict[str, Column] | None = None, ranges: int | None = None, before: bool = False, after: bool = False, wrap: bool = False) -> DataFrame:
    """rows in partitions by range of the order (key, hash of text, place), sorted, with `_range` and `halo`: 0 for the
    partition's own rows, -1 for the row before them, 1 for the row after them; wrap: after the last row of all comes the first.

    key (a long or string) and text have no nulls. columns: what is sent instead of the columns of rows, made where rows
    are dealt and nowhere else.
    """
    kind = rows.schema[key].dataType.simpleString()
    marks = {"_key": F.col(key), "_tie": F.xxhash64(text), "_place": F.monotonically_increasing_id(), "_bytes": (F.octet_length(text) + ROW_BYTES).cast("long")}
    marked = rows.withColumns(marks)
    edges = edges_of(marked.select(*marks), ranges)
    edges = [(k, *e[1:]) for k, e in enumerate(edges)]  # ranges without rows, as behind one very long text, are left out
    cuts = pd.DataFrame([e[1] for e in edges[1:]], columns=ORDER)
    dealt = marked.withColumn("_range", range_no(cuts, kind))
    copies = [F.struct(F.col("_range"), F.lit(0).alias("halo"), F.lit(False).alias("_last"))]
    if before or after:
        numbers = [e[0] for e in edges]
        behind, ahead = dict(zip(numbers, [None, *numbers])), dict(zip(numbers, numbers[1:]))
        if wrap and numbers:
            behind[numbers[0]] = numbers[-1]
        firsts, lasts = ({e[0]: e[k] for e in edges} for k in (1, 2))

        def sent(edge: dict, to: dict, halo: int) -> Column:
            some = [k for k in numbers if to.get(k) is not None]
            if not some:
                return F.lit(None)
            points = pd.DataFrame([edge[k] for k in some], columns=ORDER)
            place = F.col("_range") - some[0]
            target = F.get(F.split(F.lit(",".join(str(to[k]) for k in some)), ",").cast("array<int>"), place)
            last = F.col("_range") == numbers[0] if wrap and halo == 1 else F.lit(False)
            hit = (place >= 0) & _compared(_held(points, kind), place, equal=True)
            return F.when(hit, F.struct(target.alias("_range"), F.lit(halo).alias("halo"), last.alias("_last")))

        copies += [sent(firsts, behind, 1)] * after + [sent(lasts, ahead, -1)] * before
    out = columns or {c: F.col(c) for c in rows.columns}
    sending = dealt.select(*ORDER, *[c.alias(n) for n, c in out.items()], F.array_compact(F.array(*copies)).alias("_to") if len(copies) > 1 else F.array(*copies).alias("_to"))
    named = [F.col(n) for n in out]
    placed = sending.select(*ORDER, *named, F.explode("_to").alias("_to")) if len(copies) > 1 else sending.withColumn("_to", F.get("_to", F.lit(0)))
    return placed.select(*ORDER, *named, "_to.*").repartitionById(len(cuts) + 1, "_range").sortWithinPartitions("_last", *ORDER, "halo").select(*named, "_range", "halo")
