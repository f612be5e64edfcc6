"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that a document counts for). Each pattern offers its
words once at cost 1 and again, a repetition, at the higher cost of that repetition (convex, so whole passes come
first); each source asks for its target. The flow from patterns to sources gives the words of each pattern that the mix
takes; seeded documents of the pattern then supply them.

The flow is found by successive cheapest augmenting paths, apart for each connected part of the graph of patterns and
sources, many parts to a task. A pattern of one source that no other pattern shares is a part by itself; the others' parts
are found first. What is solved has a row for each pattern and source, never for each document: the size of a part grows
with the number of distinct sets of sources that overlap, which is a property of the sources, not of the rows.

Selection: documents have a seeded 62-bit draw. Sums for ranges of draws find, for each pattern, the one range in which
the supply ends; only the documents of that range are put in order. Both the ranges of a pattern and the documents in
one range grow as the square root of the rows, so a pattern with a third of all rows still has small groups. The last
document chosen supplies a part of its words, so that totals meet their targets to within rounding.

Defined cases: a null text has no words; a null source is a source of its own, last; an empty table or one without
words gives targets of 0; equal rows are interchangeable.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, word_count
from .graph import components


#: Groups that connected parts are dealt to, to be solved.
PARTS = 64


def weigh(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat over the sources in code point order, null last; together
    they ask for share x all sizes, none for over most x its own, the excess going to the others by weight.

    The level at which capping stops is found with running sums over sources ordered by most x size / weight.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(listed, ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = ranked.withColumn("_level", level).withColumn("_rank", F.row_number().over(by))
    # The first source, in this order, that stays below its cap: the level there is everyone's.
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_rank", "_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(first["_level"] * F.col("_w"), F.col("_cap")))
    return levels.select("source", "source_size", target.alias("target"))


def cheapest_flow(supplies: dict, demands: dict, members: dict, most: float = 2.0, costs: tuple[float, ...] = (1.0, 3.0)) -> dict:
    """Min-cost flow from patterns to the sources they belong to.

    supplies: words of each pattern; demands: target of each source; members: sources of each pattern. Each pattern has
    one edge for every repetition, of capacity its words, with rising cost. Returns {(pattern, source): words}.
    """
    graph: dict = defaultdict(dict)  # node -> {(node, level): [capacity, cost]}; both directions

    def edge(a, b, level, capacity, cost):
        graph[a][b, level] = [capacity, cost]
        graph[b].setdefault((a, level), [0.0, -cost])

    for p, words in sorted(supplies.items(), key=lambda x: str(x)):
        for level in range(math.ceil(most)):
            edge("S", ("p", p), level, words * min(1.0, most - level), costs[min(level, len(costs) - 1)] * (1 + max(0, level - len(costs) + 1)))
        for s in members[p]:
            edge(("p", p), ("s", s), 0, math.inf, 0.0)
    for s, want in sorted(demands.items(), key=lambda x: str(x)):
        edge(("s", s), "T", 0, float(want), 0.0)
    potential: dict = defaultdict(float)
    tiny = 1e-9 * max([1.0, *demands.values()])
    while True:
        cost, came, heap, n = {"S": 0.0}, {}, [(0.0, 0, "S")], 0
        while heap:
            d, _, a = heapq.heappop(heap)
            if d > cost[a] + 1e-12:
                continue
            for (b, level), (capacity, price) in graph[a].items():
                e = d + price + potential[a] - potential[b]
                if capacity > tiny and e < cost.get(b, math.inf) - 1e-12:
                    cost[b], came[b], n = e, (a, level), n + 1
                    heapq.heappush(heap, (e, n, b))
        if "T" not in came:
            break
        for node, d in cost.items():
            potential[node] += d
        path, b = [], "T"
        while b != "S":
            a, level = came[b]
            path.append((a, b, level))
            b = a
        amount = min(graph[a][b, level][0] for a, b, level in path)
        for a, b, level in path:
            graph[a][b, level][0] -= amount
            graph[b][a, level][0] += amount
    return {(p, s): graph["s", s][("p", p), 0][0] for p in supplies for s in members[p]}


def _solve(patterns: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Words that the mix takes of each pattern (pattern, words, sources) -> (pattern, words, supply)."""
    named = patterns.withColumn("_s", F.explode("sources"))
    wanted = named.join(targets.select(F.col("source").alias("_t"), "target"), F.col("_s").eqNullSafe(F.col("_t"))).select("pattern", "words", F.col("_s"), "target")
    shared = wanted.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_s", "_t")
    counted = wanted.join(shared, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    alone = counted.groupBy("pattern").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_m")).filter("_n = 1 AND _m = 1").select("pattern", F.col("pattern").alias("component"))
    hard = settle(wanted.join(alone, "pattern", "left_anti"))
    part = alone
    if not hard.isEmpty():
        parts = components(hard.select(F.concat(F.lit("p"), "pattern").alias("a"), F.coalesce(F.concat(F.lit("s"), "_s"), F.lit("n")).alias("b")))
        part = alone.unionByName(parts.filter(F.col("node").startswith("p")).select(F.expr("substring(node, 2)").alias("pattern"), "component"))
    grouped = wanted.join(part, "pattern").withColumn("_group", F.pmod(F.xxhash64("component"), F.lit(PARTS)))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.astype({"_s": object}).groupby("component", sort=False):
            names = [None if pd.isna(s) else s for s in part["_s"]]
            supplies = dict(zip(part["pattern"], part["words"].astype(float)))
            members: dict = defaultdict(list)
            for p, s in zip(part["pattern"], names):
                members[p].append(s)
            flow = cheapest_flow(supplies, dict(zip(names, part["target"])), members, most)
            out += [(p, int(words), sum(flow[p, s] for s in members[p])) for p, words in supplies.items()]
        return pd.DataFrame(out, columns=["pattern", "words", "supply"])

    return grouped.groupBy("_group").applyInPandas(solve, "pattern string, words long, supply double")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", sources: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row.

    sources: the array of all sources that a document counts for; by default its one source. source_size and target are
    those of the first of them.
    """
    chosen = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), (F.array(docs[source]) if sources is None else F.array_sort(sources)).alias("sources"))
    # The pattern is spelled with lengths so that no two lists of sources agree by chance.
    spelled = F.array_join(F.transform("sources", lambda s: F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))), ",")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.crc32("text"), F.lit(seed)), 2)
    held = settle(chosen.select("doc_id", "sources", spelled.alias("pattern"), word_count(F.col("text")).alias("size"), draw.alias("_draw")))
    patterns = settle(held.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("_docs")))
    sizes = patterns.withColumn("source", F.explode("sources")).groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = settle(weigh(sizes, weights, share, most))
    supply = settle(_solve(patterns, targets, most))

    n = held.count()
    ranges = 1 << max(6, math.ceil(math.log2(max(1, n)) / 2))
    bits = 62 - int(math.log2(ranges))
    ranged = held.withColumn("_range", F.shiftright("_draw", bits))
    whole = F.floor(F.col("supply") / F.greatest("words", F.lit(1)) + F.lit(1e-12))
    plan = supply.select("pattern", whole.cast("long").alias("_passes"), F.round(F.col("supply") - whole * F.col("words")).cast("long").alias("_rest"))
    sums = ranged.groupBy("pattern", "_range").agg(F.sum("size").alias("_sum"))
    running = F.sum("_sum").over(Window.partitionBy("pattern").orderBy("_range"))
    ends = sums.withColumn("_upto", running).join(plan, "pattern").filter((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_sum") < F.col("_rest")))
    ends = ends.groupBy("pattern").agg(F.min(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_end"))
    first = F.get("sources", F.lit(0))
    decided = patterns.select("pattern", first.alias("_source")).join(plan, "pattern").join(ends, "pattern", "left")
    decided = decided.join(targets, decided["_source"].eqNullSafe(targets["source"])).drop("_source", "source")
    rows = ranged.join(decided, "pattern")
    inner = rows.filter(F.col("_range") == F.col("_end._range"))
    outer = rows.filter(F.col("_end").isNull() | (F.col("_range") != F.col("_end._range")))
    base = F.col("_passes") * F.col("size")
    outer = outer.withColumn("taken", base + F.when(F.col("_range") < F.col("_end._range"), F.col("size")).otherwise(0))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_end._before") - (upto - F.col("size"))))
    inner = inner.withColumn("taken", base + part)
    return outer.unionByName(inner).select("doc_id", first.alias("source"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def passes(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: a row of docs for each pass that the mix takes of it, with the columns of docs.

    A part of a document counts as a pass if it is at least half. Rows without words, which no target can ask for, go.
    Rows are matched to their decisions by (id, text hash); of n equal rows with unequal decisions each gives the first's.
    """
    mark = F.xxhash64(docs[doc_id], docs[text])
    taken = mix(docs.select(F.struct(docs[doc_id].alias("i"), mark.alias("h")).alias("_key"), docs[text].alias("text"), docs[source].alias("source")), weights, share, most, seed, "_key", "text", "source")
    counted = taken.select("doc_id.*", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias("_n")).groupBy("i", "h").agg(F.max("_n").alias("_n")).filter("_n > 0")
    # Columns of docs can have any names: they travel in one.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[doc_id].alias("_id"), mark.alias("_mark"))
    both = whole.join(counted, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_mark") == F.col("h")))
    return both.select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")
