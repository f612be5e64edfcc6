"""Near-duplicate embeddings by cross-polytope hashing, with multiprobe buckets and verified pairs.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform and takes the axis, of either
sign, that comes nearest. A table joins K hashes; a vector goes to the `probes` buckets of each table whose axes are
nearest together. Two vectors meet where they share a bucket. K follows from the number of vectors to compare, so that a
bucket of unlike vectors stays small at any size; `tables` and `probes` follow from K, the dimension and the threshold:
they're the cheapest with which at most MISS of the pairs just at the threshold meet nowhere, measured on seeded random
pairs. Closer pairs are missed far less often. Nothing is read off the data but counts.

Every pair that meets is verified by its cosine in double precision, as products of blocks of a bucket. A pair counts in
the first table and the first bucket that its vectors share, which both sides' vectors tell; so links are counted without
being listed, and a block gives only counts and the edges of a forest.

Equal vectors are one vector with a count. A bucket of many near copies doesn't cost the square of its size: a few hubs
are chosen in it, and vectors within half the threshold's angle of a hub form its core; any two of a core are linked, by
the triangle inequality, so they are counted and not compared. What lies outside cores is compared with all, in blocks.
A crowd whose members keep further apart than that, though linked, is compared in full.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and those without a label,
link with nothing; vectors of different length have no cosine and don't link; rows that repeat an id are vectors of
their own; a null id counts as a vector, and as smallest id only where a class has no other; an empty table gives no
rows; further columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, settle
from .graph import components

#: The share of pairs just at the threshold that may meet nowhere.
MISS = 1e-4
#: Unlike vectors that a bucket should hold at most; more hashes are joined beyond it.
FILL = 128
#: Rows of a bucket that are compared in one task, and of a block where there are more.
WHOLE, PART = 2048, 1024
HUBS = 4


@lru_cache(maxsize=4096)
def _signs(width: int, table: int, k: int) -> np.ndarray:
    return np.random.default_rng([41, width, table, k]).choice([-1.0, 1.0], size=(3, width))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; additions alone, so it is the same anywhere."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(x: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
    """The nearest buckets (row, probe) of unit vectors in a table of k hashes, nearest first."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    wide = np.zeros((n, width))
    wide[:, :d] = x
    codes, far = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
    for h in range(k):
        y = wide
        for signs in _signs(width, table, h):
            y = _hadamard(y * signs)
        size = np.abs(y)
        axes = np.argsort(-size, axis=1, kind="stable")[:, :probes]
        size = np.take_along_axis(size, axes, 1)
        own = 2 * axes + (np.take_along_axis(y, axes, 1) > 0)
        apart = (size[:, :1] - size) ** 2
        codes = (codes[:, :, None] * (2 * width) + own[:, None, :]).reshape(n, -1)
        far = (far[:, :, None] + apart[:, None, :]).reshape(n, -1)
        best = np.argsort(far, axis=1, kind="stable")[:, :probes]
        codes, far = np.take_along_axis(codes, best, 1), np.take_along_axis(far, best, 1)
    return codes


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest bucket that rows of a and b share, -1 for none."""
    both = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, np.iinfo(np.int64).max).min(axis=1)
    return np.where(both == np.iinfo(np.int64).max, -1, both)


@lru_cache(maxsize=256)
def layout(d: int, k: int, least: float, miss: float = MISS, pairs: int = 3000) -> tuple[int, int]:
    """(tables, probes) of the fewest entries by which no more than `miss` of the pairs at cosine `least` meet nowhere."""
    if d == 1:
        return 1, 1
    draw = np.random.default_rng([43, d, k])
    x = unit(draw.normal(size=(pairs, d)))
    across = draw.normal(size=(pairs, d))
    across -= (across * x).sum(axis=1, keepdims=True) * x
    y = least * x + math.sqrt(max(0.0, 1 - least * least)) * unit(across)
    best = None
    for probes in (1, 2, 3, 4, 6, 8, 12, 16):
        met = min(0.999, float((_shared(buckets(x, 0, k, probes), buckets(y, 0, k, probes)) >= 0).mean()))
        if met > 0.05:
            tables = max(1, math.ceil(math.log(miss) / math.log(1 - met)))
            best = min(best or (tables * probes, tables, probes), (tables * probes, tables, probes))
    return best[1:] if best else (200, 16)


def hashes_for(n: int, d: int, fill: int = FILL) -> int:
    """Hashes a table joins for n vectors: the fewest that keep its buckets of unlike vectors at `fill`."""
    width = max(2, 1 << (d - 1).bit_length())
    k = 1
    while n > fill * (2 * width) ** k:
        k += 1
    return k


def _vectors(cells, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=kind) for v in cells])


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by keys, over the borders of batches."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys]
        new = np.flatnonzero((values != values.shift()).any(axis=1).to_numpy())  # where a group begins
        if rest and (rest[-1][keys].iloc[-1] == values.iloc[0]).all():
            new = new[1:]
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(batch)]):
            if a in new and rest:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            if b > a:
                rest.append(batch.iloc[a:b])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _linked(group: pd.DataFrame, least: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of one bucket, or of two of its blocks: links to add to each, and each one's root in this group."""
    ids, core, m = group["id"].to_numpy(), group["core"].to_numpy(), group["m"].to_numpy()
    table, code, k = int(group["tab"].iloc[0]), int(group["code"].iloc[0]), int(group["k"].iloc[0])
    x = unit(_vectors(group["vec"], kind))
    cosines = x @ x.T
    close = np.argwhere(np.triu(np.abs(cosines - least) < 1e-9, 1))
    for i, j in close.tolist():  # at the threshold itself, one sum in one order decides
        cosines[i, j] = cosines[j, i] = math.fsum((x[i] * x[j]).tolist())
    met = cosines >= least
    np.fill_diagonal(met, False)
    met &= (core[:, None] != core[None, :]) | (core < 0)[:, None]
    side = group["side"].to_numpy()
    if side.any():  # two blocks: only pairs across them
        met &= side[:, None] != side[None, :]
    first, second = np.nonzero(np.triu(met))
    add = np.zeros(len(ids), dtype=np.int64)
    if len(first):
        used = np.unique(np.r_[first, second])
        at = np.zeros(len(ids), dtype=np.int64)
        at[used] = np.arange(len(used))
        _, probes = layout(x.shape[1], k, least)
        own = np.ones(len(first), dtype=bool)
        for t in range(table + 1):
            seen = buckets(x[used], t, k, probes)
            where = _shared(seen[at[first]], seen[at[second]])
            own &= (where == code) if t == table else (where < 0)
        np.add.at(add, first[own], m[second[own]])
        np.add.at(add, second[own], m[first[own]])
    root = np.arange(len(ids))
    while len(first):
        low = root.copy()
        np.minimum.at(low, first, root[second])
        np.minimum.at(low, second, root[first])
        if (low == root).all():
            break
        root = low
    return ids, add, ids[root]


def near_duplicates(vecs: DataFrame, least: float = 0.93, fill: int = FILL) -> DataFrame:
    """vec_id, n_links (other vectors of its label at cosine `least` or more), component_id, kept for every row."""
    kind = "f4" if "array<float>" in vecs.schema["embedding"].dataType.simpleString() else "f8"
    e = F.col("embedding") if kind == "f4" else F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = vecs.select("vec_id", "label", e.alias("e"), sound.alias("ok"), F.xxhash64(F.lit(1), e).alias("d1"), F.xxhash64(F.lit(2), e).alias("d2"))
    narrow = settle(rows.drop("e"))
    same = ["label", "d1", "d2"]
    single = rows.filter("ok").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m"), F.first("e").alias("e"))
    single = settle(single.withColumn("d", F.size("e"))).withColumn("id", F.monotonically_increasing_id())
    many = settle(single.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n"))).withColumn("gid", F.monotonically_increasing_id())
    points = joined(single.select("label", "d", "id", "m", "e"), many, ["label", "d"]).select("gid", "n", "d", "id", "m", "e")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ks = np.array([hashes_for(n, d, fill) for n, d in zip(batch["n"].tolist(), batch["d"].tolist())], dtype=np.int64)
            for (d, k), at in batch.groupby([batch["d"], ks]).indices.items():
                part = batch.iloc[at]
                raw = np.stack(part["e"].to_list()).astype(kind)
                tables, probes = layout(int(d), int(k), least)
                x = unit(raw)
                codes = np.concatenate([buckets(x, t, int(k), probes) for t in range(tables)], axis=1)
                yield pd.DataFrame({"gid": part["gid"], "id": part["id"], "m": part["m"], "k": int(k), "tables": tables, "codes": list(codes), "vec": [v.tobytes() for v in raw]})

    put = settle(points.mapInPandas(hashed, "gid long, id long, m long, k int, tables int, codes array<long>, vec binary"))

    # Cores: only buckets of the first table that hold more than one task compares have hubs.
    home = put.withColumn("home", F.element_at("codes", 1))
    crowded = settle(home.groupBy("gid", "home").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE).drop("_n"))
    if crowded.isEmpty():
        cores = None
        at_core = put.withColumn("core", F.lit(-1).cast("long"))
    else:
        there = joined(home, crowded, ["gid", "home"])
        chosen = there.groupBy("gid", "home").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("o"), "id", "vec")) for i in range(HUBS)])).alias("hubs"))
        half = math.cos(math.acos(least) / 2) + 1e-9

        def core(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = np.full(len(batch), -1, dtype=np.int64)
                for _, at in batch.groupby(["gid", "home"]).indices.items():
                    x = unit(_vectors(batch["vec"].iloc[at], kind))
                    for hub in sorted(batch["hubs"].iloc[at[0]], key=lambda h: -h["id"]):
                        out[at[x @ unit(_vectors([hub["vec"]], kind))[0] >= half]] = hub["id"]  # the smallest id is set last
                yield pd.DataFrame({"id": batch["id"], "core": out})

        held = there.select("gid", "home", "id", "vec").join(chosen, ["gid", "home"]).mapInPandas(core, "id long, core long")
        in_core = settle(held.filter("core >= 0"))
        cores = in_core.join(put.select("id", "m"), "id")
        at_core = put.join(in_core, "id", "left").withColumn("core", F.coalesce("core", F.lit(-1)))

    per = F.expr("size(codes) div tables")
    entry = at_core.select("gid", "id", "m", "k", "core", "vec", F.posexplode("codes").alias("_p", "code"), per.alias("_per")).withColumn("tab", F.expr("_p div _per").cast("int")).drop("_p", "_per")
    spot = ["gid", "tab", "code"]
    narrow_entry = at_core.select("gid", "core", F.posexplode("codes").alias("_p", "code"), per.alias("_per")).select("gid", F.expr("_p div _per").cast("int").alias("tab"), "code", "core")
    sizes = settle(narrow_entry.groupBy(*spot, "core").agg(F.count(F.lit(1)).alias("n")))
    whole = sizes.groupBy(*spot).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("segments"), F.min("core").alias("core"))
    large = settle(whole.filter(F.col("n") > WHOLE).select(*spot))
    dealt = ["gid", "tab", "code", "core_a", "part_a", "core_b", "part_b"]
    zero = [F.lit(0).cast("long").alias(c) for c in dealt[3:]]
    # A bucket of one vector, or of one core, has nothing to compare.
    few = entry.join(settle(whole.filter((F.col("n") > 1) & (F.col("n") <= WHOLE) & ~((F.col("segments") == 1) & (F.col("core") >= 0))).select(*spot)), spot)
    groups = few.select(*spot, *zero, F.lit(0).alias("side"), "id", "m", "k", "core", "vec")
    if not large.isEmpty():
        parts = joined(sizes, large, spot).withColumn("parts", F.ceil(F.col("n") / PART).cast("long")).drop("n")
        one, two = (parts.select(*spot, F.col("core").alias(f"core_{s}"), F.col("parts").alias(f"parts_{s}")) for s in "ab")
        pairs = one.join(two, spot).filter("core_a < core_b OR core_a = core_b AND core_a < 0")
        pairs = pairs.withColumn("part_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_b") - 1)))
        pairs = settle(pairs.filter("core_a < core_b OR part_a <= part_b").select(*dealt))
        blocks = joined(entry, parts, [*spot, "core"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")))
        sides = []
        for n, s in enumerate("ab"):
            wanted = pairs if n == 0 else pairs.filter("core_a < core_b OR part_a < part_b")
            near = wanted.withColumns({"core": F.col(f"core_{s}"), "part": F.col(f"part_{s}")})
            sides.append(blocks.join(near, [*spot, "core", "part"]).select(*dealt, F.lit(n).alias("side"), "id", "m", "k", "core", "vec"))
        groups = groups.unionByName(sides[0]).unionByName(sides[1])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(batches, dealt):
            ids, add, root = _linked(group, least, kind)
            some = (add > 0) | (root != ids)
            if some.any():
                yield pd.DataFrame({"id": ids[some], "n": add[some], "root": root[some]})

    found = settle(groups.repartition(*dealt).sortWithinPartitions(*dealt).mapInPandas(compare, "id long, n long, root long"))
    links = found.groupBy("id").agg(F.sum("n").alias("_n"))
    edges = found.filter("root != id").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    if cores is not None:
        size = cores.groupBy("core").agg(F.sum("m").alias("_m"))
        inside = cores.join(size, "core").select("id", (F.col("_m") - F.col("m")).alias("_n"))
        links = links.unionByName(inside).groupBy("id").agg(F.sum("_n").alias("_n"))
        edges = edges.unionByName(cores.filter("id != core").select(F.col("id").alias("a"), F.col("core").alias("b")))
    root = components(settle(edges)).select(F.col("node").alias("id"), "component")
    told = single.drop("e", "d").join(links, "id", "left").join(root, "id", "left").withColumn("component", F.coalesce("component", "id"))
    told = settle(told.select(*same, "first", (F.col("m") - 1 + F.coalesce("_n", F.lit(0))).alias("n_links"), "component"))
    lowest = told.groupBy("component").agg(F.min("first").alias("component_id"))
    named = told.join(lowest, "component").select(*same, "n_links", "component_id", F.lit(True).alias("ok"))
    out = narrow.join(named, [*same, "ok"], "left")
    smallest = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), smallest.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == smallest, F.lit(False)).alias("kept"))
