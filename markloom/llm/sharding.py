"""Reproducible shuffling and sharding by a keyed permutation of global row numbers.

A balanced Feistel network permutes [0, 4^h), the smallest such domain that holds the n rows; positions that fall
outside [0, n) are encrypted again (cycle walking) until they land inside, which makes the permutation one of [0, n)
itself. Position p goes to shard p mod shards, slot p div shards. So every reader can compute where a row is, and which
row a slot holds (the inverse), from (n, seed) alone: no shuffled copy of the data is needed.

Global row numbers follow (doc_id, CRC, size). They come from a range exchange of the narrow columns only, a count for
each partition, and one running sum over those counts; no row goes through a single task.

Defined cases: a null id sorts first; a null text has no bytes and CRC 0; repeated rows get numbers of their own; an
empty table gives an empty result; further columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, settle

ROUNDS = 6


def _half_bits(n: int) -> int:
    bits = 1
    while 1 << (2 * bits) < n:
        bits += 1
    return bits


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    """A keyed mixing of one half; multiplication wraps at 64 bits."""
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) & mask


def _keys(seed: int) -> list[int]:
    """Round keys, of a linear congruence started at the seed."""
    keys, x = [], seed & (2**64 - 1)
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        keys.append(x)
    return keys


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The seeded permutation of [0, n) at the given places, or its inverse."""
    h = _half_bits(n)
    shift, mask = np.uint64(h), np.uint64((1 << h) - 1)
    out = np.asarray(rows).astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    keys = _keys(seed)
    while todo.any():
        left, right = out[todo] >> shift, out[todo] & mask
        if inverse:
            for key in reversed(keys):
                left, right = right ^ _round(left, key, mask), left
        else:
            for key in keys:
                left, right = right, left ^ _round(right, key, mask)
        out[todo] = (left << shift) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the 0-based global row number in the given order; df should be narrow.

    Rows that are equal throughout go by their place in the input, so that they spread over ranges like others. A row's
    place in its sorted range is read off its id there; both are fixed by a checkpoint, since numbering needs them twice.
    """
    ranged = df.withColumn("_in", F.monotonically_increasing_id()).repartitionByRange(*order, "_in").sortWithinPartitions(*order, "_in").drop("_in")
    held = settle(ranged.withColumn("_id", F.monotonically_increasing_id()))  # the partition, and 33 bits for the row in it
    placed = held.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # a row for each partition
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    numbered = placed.join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_place")).drop("_id", "_part", "_place", "_before")


def shard(docs: DataFrame, shards: int = 24, seed: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (bytes and 8), text_crc32, row, shard and slot of every row."""
    data = pick(docs, doc_id=doc_id, text=text)
    narrow = data.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    rows = number_rows(narrow, ["doc_id", "text_crc32", "size"], "row")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for row, n in batches:
            yield pd.Series(permute(row.to_numpy(), int(n.iloc[0]), seed) if len(row) else [], dtype="int64")

    at = F.pandas_udf(place, "long")
    placed = rows.crossJoin(F.broadcast(total)).withColumn("_at", at("row", "_n"))  # one row: the count
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("_at") % shards).cast("int").alias("shard"), F.floor(F.col("_at") / F.lit(shards)).cast("long").alias("slot"))


def row_at(shard_no: int, slot: int, n: int, shards: int = 24, seed: int = 20) -> int:
    """The global row number that a slot of a shard holds."""
    return int(permute(np.array([slot * shards + shard_no]), n, seed, inverse=True)[0])
