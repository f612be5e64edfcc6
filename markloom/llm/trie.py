"""The prefix trie of conversations: what they share from their first turn on, and what storing it once would save.

A node is a distinct sequence of first turns. Its key is the exclusive or of a hash of each turn with its depth, 128 bits
in two lanes; so a prefix's key is a running sum over turns, which any number of tasks can take parts of, and the key of a
node's parent is its own without its last turn: edges are keyed by digests, and no prefix is ever put together.

Sums over subtrees come from pointer jumping. Every node points to its ancestor 2^k levels up and has the sums over its
descendants fewer than 2^k levels down; adding to each node the sums of those that point to it doubles both. A trie of any
depth is done in log2(depth) + 1 rounds. Each round settles narrow rows; sums are combined before they move, so a node
that a third of all conversations pass costs each task one row. Joins to a parent meet many rows on one side and one on
the other, which adaptive execution splits.

Turns are numbered by a range exchange of digests, so that a conversation which holds most rows lies over many tasks.

Defined cases: a null role or text is empty; null turns come first; rows of one turn follow the digest of role and text,
repeated rows are turns of their own; rows without a conversation id belong to none and are left out; an empty table has
no nodes, not even a root; further columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .sharding import number_rows

#: Turns of a conversation over which one task takes a running sum.
BLOCK = 4096
#: Ids that are written as one piece of text before they are hashed.
PIECE = 20_000
KEY = ["depth", "k1", "k2"]


def positions(convs: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), h (digest of role and text), n_bytes (of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = convs.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("h"), F.octet_length(text).cast("long").alias("n_bytes"))
    numbered = number_rows(narrow, ["conv_id", "turn", "h"], "_row")
    first = numbered.groupBy("conv_id").agg(F.min("_row").alias("_first"))
    return numbered.join(first, "conv_id").select("conv_id", (F.col("_row") - F.col("_first")).alias("pos"), "h", "n_bytes")


def grafted(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of one of their `every` neighbours; turns: as `positions` gives them.

    Conversation c gets the first h turns of conversation c - c mod `every`, h being the CRC-32 of c modulo `most` + 1, and
    then its own turns from the h-th on. Returns (conv_id, depth from 1, h, n_bytes) and (conv_id, length).
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    hop = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("_hop")
    own = sizes.select("conv_id", "_n", hop, (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("_base"))
    base = sizes.select(F.col("conv_id").alias("_base"), F.col("_n").alias("_of"))
    known = own.join(base, "_base", "left").select("conv_id", "_hop", "_base", F.least("_hop", F.coalesce("_of", F.lit(0))).alias("_taken"), "_n")
    known = settle(known.withColumn("length", F.col("_taken") + F.greatest(F.col("_n") - F.col("_hop"), F.lit(0))))
    shared = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "_base").join(known.filter("_taken > 0").select("conv_id", "_hop", "_base"), "_base").filter("pos < _hop")
    kept = turns.join(known.select("conv_id", "_hop", "_taken"), "conv_id").filter("pos >= _hop")
    rows = shared.select("conv_id", (F.col("pos") + 1).alias("depth"), "h", "n_bytes")
    return rows.unionByName(kept.select("conv_id", (F.col("_taken") + F.col("pos") - F.col("_hop") + 1).alias("depth"), "h", "n_bytes")), known.select("conv_id", "length")


def prefixes(paths: DataFrame) -> DataFrame:
    """Adds to each turn of (conv_id, depth, h, n_bytes) its prefix's key (k1, k2) and its parent's (p1, p2)."""
    lanes = {f"_l{i}": F.xxhash64(F.lit(i), F.col("depth"), F.col("h")) for i in (1, 2)}
    cut = paths.withColumns(lanes).withColumn("_block", F.floor(F.col("depth") / BLOCK)).drop("h")
    within = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = settle(cut.withColumns({f"k{i}": F.bit_xor(f"_l{i}").over(within) for i in (1, 2)}))
    if run.filter("_block > 0").limit(1).count():
        # What comes before a block: a row for each block of a conversation.
        whole = run.groupBy("conv_id", "_block").agg(*[F.bit_xor(f"_l{i}").alias(f"_w{i}") for i in (1, 2)])
        before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        ahead = whole.select("conv_id", "_block", *[F.coalesce(F.bit_xor(f"_w{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in (1, 2)])
        run = run.join(ahead, ["conv_id", "_block"]).withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"_b{i}")) for i in (1, 2)})
    return run.select("conv_id", "depth", "n_bytes", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"_l{i}")).alias(f"p{i}") for i in (1, 2)])


def nodes(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node: its key (depth, k1, k2), its parent's (p1, p2), conv_id (smallest member), n_convs, n_bytes."""
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[F.lit(0).cast("long").alias(c) for c in KEY], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    below = members.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"))
    return root.unionByName(below)


def rolled_up(found: DataFrame) -> DataFrame:
    """found (see `nodes`) with parent_conv_id, n_children, and over each subtree n_leaves and saved_tokens.

    After round k a node has the sums over fewer than 2^k levels below it, and `up` is its ancestor 2^k levels above it, by
    smallest member; with its depth that names it.
    """
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    linked = settle(found.join(above, ["depth", "p1", "p2"], "left").select(*KEY, "conv_id", "n_convs", "n_bytes", "up"))
    children = linked.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    fixed = linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    fixed = settle(fixed.withColumnRenamed("up", "parent_conv_id"))
    deepest = fixed.agg(F.max("depth")).first()[0] or 0
    now = fixed.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    step = 1
    while step <= deepest:
        sums = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        further = now.filter("up IS NOT NULL").select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("_up"))
        added = now.join(sums, ["conv_id", "depth"], "left").join(further, ["up", "depth"], "left")
        now = settle(added.select("conv_id", "depth", F.col("_up").alias("up"), (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_s", F.lit(0))).alias("saved_tokens")))
        step *= 2
    return fixed.join(now.drop("up"), ["conv_id", "depth"])


def ends(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id): the node at which each conversation ends."""
    at = members.join(lengths, "conv_id").filter("depth = length").select(*KEY, "conv_id")
    return at.unionByName(lengths.filter("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id"))


def end_digests(at: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ids that end at a node, ascending, joined by commas.

    A hash goes through its bytes one after the other, so a node's ids meet in one task; they come there as sorted pieces
    of text, made in many, and are fed on as they come.
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = (batch[KEY] != batch[KEY].shift()).any(axis=1).cumsum()
            part = batch.groupby(new).cumcount() // PIECE
            rows = [(*g[KEY].iloc[0].tolist(), int(g["conv_id"].iloc[0]), ",".join(map(str, g["conv_id"].tolist()))) for _, g in batch.groupby([new, part], sort=False)]
            yield pd.DataFrame(rows, columns=[*KEY, "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            rows = []
            for *now, ids in zip(*(batch[c].tolist() for c in (*KEY, "ids"))):
                if now != key:
                    if key is not None:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(rows, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    named = "depth long, k1 long, k2 long"
    pieces = at.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInPandas(joined, f"{named}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(hashed, f"{named}, ends_sha256 string")


def trie(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every node of the conversations given by their turns (conv_id, depth, h, n_bytes) and lengths (conv_id, length)."""
    members = settle(prefixes(paths))
    summed = rolled_up(nodes(members, lengths))
    told = summed.join(end_digests(ends(members, lengths)), KEY, "left")
    none = hashlib.sha256().hexdigest()
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def shared_prefixes(convs: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = settle(positions(convs))
    return trie(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "h", "n_bytes"), turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")))


def grafted_prefixes(convs: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """The trie of the conversations that `grafted` makes."""
    paths, lengths = grafted(settle(positions(convs)), every, most)
    return trie(paths, lengths)
