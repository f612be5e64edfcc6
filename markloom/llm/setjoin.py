"""Texts that share most of their word shingles: an exact join at a Jaccard similarity, by prefix filtering.

A text is the set of hashes of its five-word shingles. Two sets at `least` or more share one of the first (1 - least) n + 1
of each, in any order that is the same for all sets; that order has shingles common in a bounded sample last, so that few
sets meet. One pass over the texts gives each its prefix keys and `marks`, a bitmap of parities that bounds how many
shingles two sets differ in from below, at a sixteenth of the set's size. Sets that share a key are candidates; sizes and
marks rule most of them out, and the rest are settled by counting, for which the sets of those texts alone are made again
from the texts. A key travels with its set's size and its own place in the prefix: where sets meet first, at places i and j,
they can share no more than what comes from there on, which rules out most pairs before anything is joined to them; then
64 bytes of folded parities do, and only pairs that both leave over meet their whole marks.

A key of up to FEW sets gives all their pairs. What is wanted are classes, so the sets of a larger key are tested against a
hub, and where some stay apart against another; a group of near copies, however large, is connected by that. Then only sets
that are not yet connected are compared, all blocks of BLOCK sets against all, several tasks to a key. No pair is estimated,
capped or dropped; what comes after the hubs is quadratic in a group of sets that share keys and yet are not connected.

Defined cases: a text without a word has no shingle, no key and no partner; fewer words than a shingle make one shingle;
equal sets are one set; no texts give no edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fingerprint
from .common import Tables
from .graph import components

#: Texts from which common shingles are learned, and how many of those travel to the tasks. They order the work, not the result.
COMMON_TEXTS, COMMON = 4_000, 500_000
#: Sets of a key up to which all its pairs are met at once; sets of a block of a larger key.
FEW, BLOCK = 24, 256
#: Rounds of hubs at most, and pairs of a round after which no other is worth it. They order the work, not the result.
ROUNDS, ENOUGH = 5, 20_000
#: 64-bit words of a set's folded parities, and so of the shortest marks.
SHORT = 8
#: Pairs, each with two sets or their marks, that Python gets at once.
PAIRS_A_BATCH = 200


def lowered(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that several of a bounded number of texts have, and in how many; the commonest if very many."""
    n = docs.count()
    drawn = docs.select(docs[text].alias("text"))
    if n > COMMON_TEXTS:
        drawn = drawn.sample(COMMON_TEXTS / n, seed=3)

    @F.pandas_udf("array<long>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(g, dtype=np.int64) for some in fingerprint.groups(lowered(texts)) for g in fingerprint.shingle_sets(some)], dtype=object)

    counts = drawn.select(F.explode(each("text")).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    shingle = found["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    by = np.argsort(shingle)
    return shingle[by], found["n"].to_numpy(dtype=np.int64)[by]


def prefix(g: bytes, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set, so many that sets alike enough share one: one that shares least n of n can't miss n - least n + 1."""
    x = np.frombuffer(g, dtype=np.uint64)
    n = len(x) - int(np.ceil(least * len(x) - fingerprint.SLACK)) + 1
    known, often = common
    if len(known):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        x = x[np.argsort(np.where(known[at] == x, often[at], 0), kind="stable")]
    return x[:n].view(np.int64)


def parities(g: bytes) -> bytes:
    """Of each bin of shingles whether it has an odd number; four bins a shingle or more, a power of two.

    A shingle that only one of two sets has changes one bin, so sets differ in as many shingles as in bins or in more.
    """
    x = np.frombuffer(g, dtype=np.uint64)
    bins = 64 * SHORT
    while bins < 4 * len(x) and bins < 1 << 16:
        bins *= 2
    return np.packbits(np.bincount((x & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1, bitorder="little").tobytes()


def folded(marks: Column) -> Column:
    """Parities in SHORT words: a bin of each word is the parity of all bins of the marks that fall into it."""

    @F.pandas_udf("array<long>")
    def run(each: pd.Series) -> pd.Series:
        return pd.Series([np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.int64).reshape(-1, SHORT), axis=0) for x in each], dtype=object)

    return run(marks)


def can_meet(x: str, y: str, least: float) -> str:
    """SQL: whether sets x and y (structs with n and pos), if they meet first at those places of their prefixes, can be alike."""
    share = least / (1 + least)
    sizes = f"least({x}.n, {y}.n) + {fingerprint.SLACK}D >= {least}D * greatest({x}.n, {y}.n)"
    return f"{sizes} AND least({x}.n - {x}.pos, {y}.n - {y}.pos) + {fingerprint.SLACK}D >= {share!r}D * ({x}.n + {y}.n)"


def possible(n: np.ndarray, marks: list[bytes], m: np.ndarray, others: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of sets, of sizes n and m, that their sizes and parities don't rule out."""
    rows, columns = [], []
    width, wide = np.array([len(x) for x in marks]), np.array([len(x) for x in others])
    for v in np.unique(width):
        for w in np.unique(wide):
            i, j = np.flatnonzero(width == v), np.flatnonzero(wide == w)
            to = min(v, w)
            fold = lambda x, k: np.bitwise_xor.reduce(np.frombuffer(b"".join(x), dtype=np.uint64).reshape(len(x), k // to, to // 8), axis=1)
            a, c = fold([marks[k] for k in i], v), fold([others[k] for k in j], w)
            for k, row in zip(i, a):
                total = n[k] + m[j]
                # shared >= least * union, so that differing <= (1 - least) / (1 + least) * total
                fits = np.minimum(n[k], m[j]) + fingerprint.SLACK >= least * np.maximum(n[k], m[j])
                fits &= np.bitwise_count(c ^ row).sum(axis=1, dtype=np.int64) <= (1 - least) / (1 + least) * total + fingerprint.SLACK
                found = j[fits]
                rows.append(np.full(len(found), k))
                columns.append(found)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


def may_be_alike(n: int, marks: bytes, m: int, other: bytes, least: float) -> bool:
    """`possible` for one pair."""
    if min(n, m) + fingerprint.SLACK < least * max(n, m):
        return False
    to = min(len(marks), len(other)) // 8
    fold = lambda x: np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(-1, to), axis=0)
    return np.bitwise_count(fold(marks) ^ fold(other)).sum() <= (1 - least) / (1 + least) * (n + m) + fingerprint.SLACK


@contextmanager
def small_batches(spark: SparkSession, rows: int = PAIRS_A_BATCH) -> Iterator[None]:
    """While it lasts, jobs hand Python few rows at once: a pair of long texts' sets is some hundred kilobytes. Workers and
    the JVM hold several copies of a batch, and keep the room."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Sets:
    """The sets of a table of texts.

    known: (s, n, marks, keys) for each text: the hash of its set, its size, marks and prefix keys; copies may be repeated
    and may lack keys but for one. made: for a settled table of distinct s, (s, g), the sets themselves, once each; what it
    settles itself goes into the tables it is given. Results are in `tables`; what a step alone needs goes with the step.
    """

    def __init__(self, known: DataFrame, made: Callable[[DataFrame, Tables], DataFrame], least: float, tables: Tables):
        self.known, self.made, self.least, self.tables = known, made, least, tables
        self.one = tables.settle(known.groupBy("s").agg(F.first("n").alias("n"), F.first("marks").alias("marks")).withColumn("short", folded(F.col("marks"))))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose similarity, counted, is at least `least`, settled: marks decide first, then the sets."""
        least = self.least

        @F.pandas_udf("boolean")
        def may(n: pd.Series, x: pd.Series, m: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([may_be_alike(*v, least) for v in zip(n, x, m, y)], dtype=bool)

        @F.pandas_udf("boolean")
        def holds(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([fingerprint.jaccard_at_least(a, c, least) for a, c in zip(x, y)], dtype=bool)

        left, right = (self.one.select(F.col("s").alias(a), F.col("n").alias(n), F.col("short").alias(x)) for a, n, x in (("a", "_n", "_x"), ("b", "_m", "_y")))
        differing = "aggregate(zip_with(_x, _y, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
        few = F.expr(f"{differing} <= {(1 - least) / (1 + least)!r}D * (_n + _m) + {fingerprint.SLACK}D")
        with self.tables.part() as own, small_batches(self.one.sparkSession):
            pairs = own.settle(pairs.join(left, "a").join(right, "b").filter(few).select("a", "b"))
            left = self.one.select(F.col("s").alias("a"), F.col("n").alias("_n"), F.col("marks").alias("_x"))
            right = self.one.select(F.col("s").alias("b"), F.col("n").alias("_m"), F.col("marks").alias("_y"))
            near = own.settle(pairs.join(left, "a").join(right, "b").filter(may("_n", "_x", "_m", "_y")).select("a", "b"))
            used = own.settle(near.select(F.explode(F.array("a", "b")).alias("s")).distinct())
            sets = own.settle(self.made(used, own))
            left, right = sets.select(F.col("s").alias("a"), F.col("g").alias("_x")), sets.select(F.col("s").alias("b"), F.col("g").alias("_y"))
            return self.tables.settle(near.join(left, "a").join(right, "b").filter(holds("_x", "_y")).select("a", "b"))

    def _shared(self) -> DataFrame:
        """(key, s, n, pos, m): the keys that several sets have, with their sets, once each, and how many they are.

        Keys are first counted alone, as numbers of 48 bits: combined before the exchange, so a key of any share of the
        rows is a row of each task, and most of what moves is gone after it. Two keys of a set may fall together there;
        the earlier place rules out less. Keys that the very same sets have, as those of near copies do, are one key, with
        each set's earliest place of them.
        """
        keys = self.known.select("s", "n", F.posexplode("keys").alias("pos", "key")).withColumn("key", F.col("key").bitwiseAND(F.lit((1 << 48) - 1)))
        often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
        own = self.tables.part()
        held = own.settle(keys.join(often, "key", "left_semi").groupBy("key", "s").agg(F.min("n").alias("n"), F.min("pos").alias("pos")))
        whose = held.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *[F.bit_xor(F.xxhash64(F.lit(i), "s")).alias(f"_w{i}") for i in (1, 2)]).filter("m > 1")
        same = Window.partitionBy("m", "_w1", "_w2")
        named = whose.select("key", "m", F.min("key").over(same).alias("_as"))
        with own:
            return self.tables.settle(held.join(named, "key").groupBy(F.col("_as").alias("key"), "s").agg(F.min("n").alias("n"), F.min("pos").alias("pos"), F.min("m").alias("m")))

    def edges(self, few: int = FEW) -> DataFrame:
        """Edges (a, b) between sets that connect exactly those connected by pairs of that similarity or more.

        Keys of up to `few` sets give all their pairs. Those of larger keys meet hubs first (see `_through_hubs`).
        """
        met = self._shared()
        small = met.filter(F.col("m") <= few).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "n", "pos"))).alias("l")).select("l").distinct()
        each = f"flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, {few}), y -> {can_meet('x', 'y', self.least)}), y -> struct(x.s AS a, y.s AS b))))"
        pairs = small.select(F.explode(F.expr(each)).alias("e")).select("e.a", "e.b").distinct()
        found = self.verified(pairs)
        crowd = met.filter(F.col("m") > few)
        return found if crowd.isEmpty() else self._through_hubs(crowd, found)

    def _through_hubs(self, crowd: DataFrame, found: DataFrame) -> DataFrame:
        """found, and edges that connect the sets of crowded keys (key, s).

        A hub is the set of a key that has the most crowded keys: of near copies the one closest to all. Where sets of a
        key stay unconnected, the best of those outside the classes of earlier hubs is the next, up to ROUNDS times or
        until few are left; pairs that no round settled are compared all with all.
        """
        tables = self.tables
        met = tables.settle(crowd.withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("s"))).select("key", "s", "d", "n", "pos"))
        tested = used = None

        def joined_by(edges: DataFrame, roots: DataFrame, own: Tables) -> DataFrame:
            """roots after new edges, in own: only those that join different roots are looked at."""
            one, two = (roots.select(F.col("s").alias(e), F.col("root").alias(f"_{e}")) for e in "ab")
            # A set may be connected to the crowd through one outside it, which is then its own root.
            ends = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
            with own.part() as rounds:
                parts = components(rounds.settle(ends.filter("a != b").distinct()), tables=rounds).select(F.col("node").alias("root"), F.col("component").alias("_c"))
                return own.settle(roots.join(parts, "root", "left").select("s", F.coalesce("_c", "root").alias("root")))

        def still_apart(live: DataFrame, roots: DataFrame, own: Tables) -> DataFrame:
            """The rows of keys whose sets have several roots, with their roots, in own; the others are done."""
            with own.part() as step:
                rows = step.settle(live.drop("root").join(roots, "s"))
                apart = rows.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo != _hi").select("key")
                return own.settle(rows.join(apart, "key", "left_semi"))

        now = tables.part()  # roots and live rows of a round, which go when the next round's are there
        roots = joined_by(found, met.select("s").distinct().withColumn("root", F.col("s")), now)
        live = still_apart(met, roots, now)
        for _ in range(ROUNDS):
            rooted = fresh = live
            new = F.lit(True)
            if used is not None:
                taken = used.join(roots, "s").select("root").distinct().withColumn("_taken", F.lit(True))
                fresh, new = rooted.join(taken, "root", "left"), F.col("_taken").isNull()
            best = F.max(F.when(new, F.struct("d", "s", "root", "n", "pos")))
            hubs = now.settle(fresh.groupBy("key").agg(best.alias("_b")).filter("_b IS NOT NULL").select("key", "_b"))
            ways = rooted.withColumn("_x", F.struct("s", "root", "n", "pos")).join(hubs, "key").filter("_x.root != _b.root").filter(F.expr(can_meet("_x", "_b", self.least)))
            pairs = ways.select(F.least("_x.s", "_b.s").alias("a"), F.greatest("_x.s", "_b.s").alias("b")).distinct()
            pairs = tables.settle(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
            n = pairs.count()
            if n == 0:
                break
            tested = pairs if tested is None else tested.unionByName(pairs)
            chosen = hubs.select(F.col("_b.s").alias("s"))
            used = tables.settle((chosen if used is None else used.unionByName(chosen)).distinct())
            more = self.verified(pairs)
            found = found.unionByName(more)
            later = tables.part()
            roots = joined_by(more, roots, later)
            live = still_apart(live, roots, later)
            now.close()
            now = later
            if n <= ENOUGH:
                break
        with now:
            if live.isEmpty():
                return found
            with small_batches(found.sparkSession):
                rest = now.settle(self._blocks(live).distinct())
            rest = rest if tested is None else rest.join(tested, ["a", "b"], "left_anti")
            return found.unionByName(self.verified(rest))

    def _blocks(self, met: DataFrame) -> DataFrame:
        """Pairs (a < b) of different roots of larger keys that marks don't rule out: block by block, all with all."""
        least = self.least
        sizes = met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
        held = met.join(sizes, "key").join(self.one.select("s", "marks"), "s")
        own = held.withColumn("_own", F.pmod(F.xxhash64("s", "key"), F.col("_blocks")).cast("int"))
        sent = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        blocks = sent.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))

        def pairs(block: pd.DataFrame) -> pd.DataFrame:
            i, j = int(block["_i"].iloc[0]), int(block["_j"].iloc[0])
            left, right = block[block["_own"] == i], block[block["_own"] == j]
            x, y = possible(left["n"].to_numpy(), left["marks"].tolist(), right["n"].to_numpy(), right["marks"].tolist(), least)
            a, b = left["s"].to_numpy()[x], right["s"].to_numpy()[y]
            apart = left["root"].to_numpy()[x] != right["root"].to_numpy()[y]
            apart &= (a < b) | (i != j)
            # What both have from their key on must be enough, if they meet there first.
            ahead = np.minimum((left["n"] - left["pos"]).to_numpy()[x], (right["n"] - right["pos"]).to_numpy()[y])
            apart &= ahead + fingerprint.SLACK >= least / (1 + least) * (left["n"].to_numpy()[x] + right["n"].to_numpy()[y])
            return pd.DataFrame({"a": np.minimum(a, b)[apart], "b": np.maximum(a, b)[apart]})

        return blocks.select("key", "_i", "_j", "_own", "s", "root", "n", "pos", "marks").groupBy("key", "_i", "_j").applyInPandas(pairs, "a long, b long")


def shingle_set(text: Column) -> Column:
    """The text's distinct shingles, as `fingerprint.shingle_sets` packs them; empty without a word."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([g for some in fingerprint.groups(lowered(texts)) for g in fingerprint.shingle_sets(some)], dtype=object)

    return run(text)
