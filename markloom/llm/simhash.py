"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 places: 1 where more than half of the shingles' XXH64 hashes have a 1. Two
fingerprints are linked at `radius` or fewer differing bits. Each bit place gets a vector of radius + 1 bits; each
nonzero vector v gives a mask, of the places whose vector has an odd inner product with v. For any `radius` places some
v is orthogonal to all their vectors, so a pair within the radius agrees under that mask: with its 2^(radius+1) - 1
tables the search finds every pair, not most.

Equal fingerprints are summed to one row before anything is compared, so copies cost nothing. A bucket of a table with
few distinct fingerprints is compared pair by pair. A larger bucket, of many fingerprints that are all close, would make
a quadratic number of pairs; its members differ only outside the mask, so each is sent to the midpoints within
ceil(radius / 2) of it instead: members within the radius meet at a midpoint, linear work in the bucket's size, and a
midpoint has few members however large the bucket is. Nothing is capped: both ways are exact.

Radius 2 finds all but equal texts. Pairs at a five-word Jaccard similarity of 0.8 differ in ten of 64 bits, and no
covering family of workable size reaches that far, so `keep_one`, which promises 0.8, adds a second search over the sets of
five-word shingles themselves, by prefix filtering, which is exact as well: see `setjoin`.

Defined cases: a null or empty text, and one of white space alone, has fingerprint zero and links like any other; fewer
words than a shingle make one shingle; repeated rows and ties of ids share a class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fingerprint, setjoin
from .common import Tables, joined, let_go, settle
from .graph import components

BITS = 64
#: Distinct fingerprints of a bucket up to which pairs are compared one by one.
FEW = 24
#: Bytes of texts that are profiled together, or one longer text; and texts that Python gets at once for it. They bound memory.
PROFILED, TEXTS_A_BATCH = 250_000, 1_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a UTF-8 text, repeats included; A to Z count as a to z."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-words_each].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words_each - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes (runs of the given sizes): bits set in over half of a run.

    Bits are counted eight at a time in the bytes of 64-bit words, over blocks of at most 255 hashes.
    """
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    ends = np.cumsum(sizes[full])
    begins = ends - sizes[full]
    blocks = np.concatenate([np.arange(a, b, 255) for a, b in zip(begins, ends)])
    of = np.searchsorted(ends, blocks, side="right")
    first = np.flatnonzero(np.diff(of, prepend=-1))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, blocks)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        more = (2 * counts > sizes[full][:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(more).view(np.uint64).ravel() << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words_each: int = 3, doc_id: str = "doc_id", text: str = "text", keep: dict | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns of `keep` (name: Column over docs)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = [np.zeros(0, dtype=np.uint64)]
            for group in fingerprint.groups([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
                each = [shingle_hashes(t, words_each) for t in group]
                made.append(majority(np.concatenate(each), np.array([len(h) for h in each], dtype=np.int64)))
            yield pd.Series(np.concatenate(made).view(np.int64))

    simhash = F.pandas_udf(run, "long")
    return docs.select(docs[doc_id].alias("doc_id"), simhash(docs[text]).alias("fp"), *[c.alias(n) for n, c in (keep or {}).items()])


def covering_masks(radius: int, bits: int = BITS, seed: int = 5) -> list[int]:
    """The masks of the covering family, as signed longs; places get their vectors from a seeded shuffle that uses each vector about equally often."""
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % (1 << (radius + 1)))
    masks = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _differing(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(points: DataFrame, radius: int = 2, few: int = FEW, tables: Tables | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all pairs within the radius.

    Buckets of up to `few` give their pairs within the radius; larger ones give edges through shared midpoints.
    """
    masks = covering_masks(radius)
    masked = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    dealt = points.select("fp", F.explode(masked).alias("_b")).select("fp", "_b.t", "_b.key")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = (tables.settle if tables else settle)(dealt.join(sizes, ["t", "key"]))
    small = met.filter(F.col("n") <= few).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    apart = small.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {few}), y -> bit_count(x ^ y) <= {radius}), y -> struct(x AS a, y AS b))))")).alias("e")).select("e.a", "e.b")
    # Larger buckets: to every midpoint that differs in at most half the radius of the places outside the mask.
    free = {k: [i for i in range(BITS) if not (m >> i) & 1] for k, m in enumerate(masks)}
    flips = {k: [0] + [sum(1 << i for i in c) for size in range(1, (radius + 1) // 2 + 1) for c in combinations(places, size)] for k, places in free.items()}
    chosen = F.element_at(F.array(*[F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in flips[k]]) for k in sorted(flips)]), F.col("t") + 1)
    near = met.filter(F.col("n") > few).select("fp", F.explode(chosen).alias("_f")).select("fp", F.col("fp").bitwiseXOR(F.col("_f")).alias("mid")).distinct()
    if radius % 2:
        return apart.unionByName(_through_odd(near, radius))
    hub = near.groupBy("mid").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    through = near.join(hub, "mid").filter(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return apart.unionByName(through).distinct()


def _through_odd(near: DataFrame, radius: int) -> DataFrame:
    """For an odd radius members of a midpoint can be one place too far apart, so a midpoint's few members are compared."""
    met = near.groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("m")).filter(F.size("m") > 1)
    return met.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(m, y -> y > x AND bit_count(x ^ y) <= {radius}), y -> struct(x AS a, y AS b))))")).alias("e")).select("e.a", "e.b").distinct()


def classes(prints: DataFrame, radius: int = 2, also: DataFrame | None = None, tables: Tables | None = None) -> DataFrame:
    """(fp, root) for each distinct fingerprint of (fp, ...): root is one fingerprint of its connected class.

    also: further edges (a, b) between fingerprints. tables: see `components`.
    """
    put = tables.settle if tables else settle
    points = prints.select("fp").distinct()
    edges = put(links(points, radius, tables=tables))
    parts = components(edges if also is None else edges.unionByName(put(also)), tables=tables)
    return points.join(parts.select(F.col("node").alias("fp"), F.col("component").alias("_c")), "fp", "left").select("fp", F.coalesce("_c", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words_each: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest id of its class) of every row."""
    held = settle(fingerprints(docs, words_each, doc_id, text))
    least = held.groupBy("fp").agg(F.min("doc_id").alias("_first"))  # combined before the exchange: copies cost nothing
    # A class of null ids alone keeps a null component.
    rooted = settle(least.join(classes(least, radius), "fp"))
    lowest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return held.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def profiles(text: Column, common: tuple, words_each: int, least: float) -> Column:
    """In one pass over a text: fp, and what `setjoin.Sets` has to know: s, n, marks and keys (keys once a task for each set)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        try:
            for texts in batches:
                for group in fingerprint.groups(((t or "").encode("utf-8", "surrogatepass") for t in texts), PROFILED):
                    rows = []
                    each = [shingle_hashes(t, words_each) for t in group]
                    prints = majority(np.concatenate(each), np.array([len(h) for h in each], dtype=np.int64)).view(np.int64).tolist()
                    for fp, g in zip(prints, fingerprint.shingle_sets([t.lower() for t in group])):
                        s = xxhash.xxh64_intdigest(g, 7)
                        s -= (s >> 63) << 64
                        keys = None if s in seen or not g else setjoin.prefix(g, common, least)
                        seen.add(s)
                        rows.append((fp, s, len(g) // 8, setjoin.parities(g), keys))
                    yield pd.DataFrame(rows, columns=["fp", "s", "n", "marks", "keys"])
        finally:
            let_go()

    return F.pandas_udf(run, "fp long, s long, n long, marks binary, keys array<long>")(text)


def alike(docs: DataFrame, held: DataFrame, least: float, tables: Tables, text: str = "text") -> DataFrame:
    """Edges (a, b) between fingerprints that connect all texts of that similarity; held: (h, fp, s, n, marks, keys) of the
    rows of docs, docs having the hash _h that held has as h. Both are read from `tables`, as the result is."""
    worded = held.filter("n > 0")

    def made(used: DataFrame, own: Tables) -> DataFrame:
        # One row of docs for each set wanted; rows of one hash are alike, and give their set once a task.
        row = own.settle(joined(worded.select("s", "h"), used, "s").groupBy("s").agg(F.min("h").alias("_h")))
        found = joined(docs.select("_h", F.col(text).alias("_t")), row, "_h")
        return found.select("s", setjoin.shingle_set(F.col("_t")).alias("g")).groupBy("s").agg(F.first("g").alias("g"))

    edges = setjoin.Sets(worded.select("s", "n", "marks", "keys"), made, least, tables).edges()
    # Every fingerprint of a set is joined to the set's first one, and that to the first one of each alike set.
    first = worded.groupBy("s").agg(F.min("fp").alias("f"), F.max("fp").alias("_g"))
    same = worded.select("s", "fp").join(first.filter("f != _g"), "s").filter("fp != f").select(F.col("f").alias("a"), F.col("fp").alias("b")).distinct()
    linked = edges.join(first.select(F.col("s").alias("a"), "f"), "a").join(first.select(F.col("s").alias("b"), F.col("f").alias("g")), "b").select(F.col("f").alias("a"), F.col("g").alias("b"))
    return linked.unionByName(same)


def keep_one(docs: DataFrame, words_each: int = 3, radius: int = 2, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each class the row of the smallest (id, text hash) stays.

    Linked are fingerprints within the radius, and texts at a five-word Jaccard similarity of `similarity` or more, by
    counting their shingles (see `setjoin`).

    Rows equal in id and text are one row here; of those any one stays, since nothing tells them apart but further columns.
    """
    hashed = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text], docs[doc_id]).alias("_h"))
    with Tables(docs.sparkSession) as tables, setjoin.small_batches(docs.sparkSession, TEXTS_A_BATCH):
        common = setjoin.common_shingles(docs, text)
        profiled = hashed.select("doc_id", F.col("_h").alias("h"), profiles(F.col("text"), common, words_each, similarity).alias("_p"))
        held = tables.settle(profiled.select("doc_id", "h", "_p.*"))
        least = held.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("_first"))
        rooted = least.join(classes(least.select("fp"), radius, alike(hashed, held, similarity, tables), tables), "fp")
        winners = settle(rooted.groupBy("root").agg(F.min("_first").alias("_w")).select("_w.doc_id", "_w.h"))
        won = winners.select(F.col("doc_id").alias("_i"), F.col("h").alias("_k"))
        rows = held.select("doc_id", "h").join(won, (F.col("_k") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left_semi")
        repeated = not rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    same = docs[doc_id].eqNullSafe(winners["doc_id"]) & (F.xxhash64(docs[text], docs[doc_id]) == winners["h"])
    kept = docs.join(winners, same, "left_semi")
    return kept.dropDuplicates([doc_id, text]) if repeated else kept
