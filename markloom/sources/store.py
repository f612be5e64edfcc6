"""Tables of results at rest: append, upsert, delete, lookups by key, annotation edits, history; writers that meet queue up."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTIONS = ("documents", "rubrics", "results", "annotations", "document_bytes")
#: Tries of a commit whose number another writer takes, and parts of deleted keys after which an upsert puts the table together.
TRIES, MOST_DELETES = 50, 32


class NotFound(LookupError):
    """No row has the id asked for."""


class Conflict(RuntimeError):
    """Other writers were first too often, or have changed what a write was to be based on."""


class Store:
    """Parquet tables under a folder. Each table is a folder of parts and of numbered commits, files that list the parts of
    a version, one JSON object a line; the highest number counts.

    A write makes new parts and then puts the next commit in place, if its number is free: by a link or a rename where the
    file system does that for one writer only, else by a file that is never overwritten. So readers see the old table or
    the new one, and a crash at any point leaves the old one. A writer that finds its number taken reads the latest commit
    and tries again on top of it: appends, upserts and deletes apply to any version, `change` works its rows out anew.

    Nothing is rewritten by an upsert or a delete: they add a part of the keys that end there, which hides rows of earlier
    parts, and the new rows. Rows are laid out by ranges of the key, with Bloom filters inside the files; each part has a
    list of its files' ranges, and a commit the range of each part, so that a lookup opens only files that may hold its
    keys. A table that can't be read is an error, never an empty table.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self, name: str) -> tuple[int, list[dict]]:
        """The number of the latest commit and its parts; 0 and none without a commit."""
        fs, folder = self._fs(), self._path(name)
        if not fs.exists(folder):
            return 0, []
        numbers = [int(n.removeprefix("commit-")) for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("commit-")]
        if not numbers:
            return 0, []
        last = max(numbers)
        lines = self.spark.read.text(self._path(name, f"commit-{last:012d}").toString()).collect()  # a line for each write since the table was put together
        return last, sorted((json.loads(r[0]) for r in lines if r[0]), key=lambda p: p["seq"])

    def exists(self, name: str) -> bool:
        return self._latest(name)[0] > 0

    # ---- commits -------------------------------------------------------------------------------------------------

    def _put(self, name: str, number: int, parts: list[dict]) -> bool:
        """The commit of that number, unless there is one: true for one of any writers that try at once."""
        fs, final = self._fs(), self._path(name, f"commit-{number:012d}")
        text = bytearray("\n".join(json.dumps(p | {"seq": k}) for k, p in enumerate(parts)).encode())
        scheme = fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs", "abfs", "abfss"):
            try:  # an object store: the object is there once it is closed, and put only where there is none
                out = fs.create(final, False)
                out.write(text)
                out.close()
                return True
            except Exception as error:
                if fs.exists(final):
                    return False
                raise error
        fresh = self._path(name, f".{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(text)
        out.close()
        try:
            if scheme != "file":
                return fs.rename(fresh, final)  # refused where there is one
            file = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self.spark._jvm.java.nio.file.Files.createLink(file(final), file(fresh))
                return True
            except Exception as error:
                if fs.exists(final):
                    return False
                raise error
        finally:
            fs.delete(fresh, False)

    def _commit(self, name: str, make: Callable[[int, list[dict]], list[dict] | None]) -> int:
        """Puts make(latest number, its parts) in place as the next commit, again where another writer was first; no commit for None."""
        for k in range(TRIES):
            number, parts = self._latest(name)
            made = make(number, parts)
            if made is None or self._put(name, number + 1, made):
                return number + (made is not None)
            time.sleep(min(1.0, 0.01 * 2**k) * random.random())
        raise Conflict(f"{name}: other writers were first {TRIES} times")

    def _part(self, name: str, rows: DataFrame, kind: str = "rows") -> dict:
        """Writes a part by ranges of the key, the list of its files beside it."""
        part = f"part-{uuid.uuid4().hex}"
        at = f"{self.folder}/{name}/{part}"
        keyed = self.key in rows.columns
        laid = rows.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key) if keyed else rows
        laid.write.option(f"parquet.bloom.filter.enabled#{self.key}", str(keyed).lower()).parquet(at)
        if not keyed:
            return {"part": part, "kind": kind}
        as_text = F.col(self.key).cast("string")
        files = self.spark.read.parquet(at).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min(as_text).alias("low"), F.max(as_text).alias("high"), F.count(F.lit(1)).alias("rows"))
        files.coalesce(1).write.parquet(f"{at}.files")
        low, high, n = self.spark.read.parquet(f"{at}.files").agg(F.min("low"), F.max("high"), F.sum("rows")).first()
        return {"part": part, "kind": kind, "low": low, "high": high, "rows": n or 0}

    # ---- writing -------------------------------------------------------------------------------------------------

    def write(self, name: str, rows: DataFrame, since: int | None = None) -> int:
        """The table is these rows from now on; since: refuse where there is a later commit than that one."""
        part = self._part(name, rows)

        def make(number: int, parts: list[dict]) -> list[dict]:
            if since is not None and number != since:
                raise Conflict(f"{name}: commit {number} came after {since}")
            return [part]

        return self._commit(name, make)

    def append(self, name: str, rows: DataFrame) -> int:
        part = self._part(name, rows.select(*self.read(name).columns) if self.exists(name) else rows)
        return self._commit(name, lambda number, parts: [*parts, part])

    def upsert(self, name: str, rows: DataFrame, key: str | None = None) -> int:
        """rows replace those of equal key; others stay."""
        self._same(key)
        new = [self._part(name, rows.select(self.key).distinct(), "deletes"), self._part(name, rows.select(*self.read(name).columns) if self.exists(name) else rows)]
        number = self._commit(name, lambda number, parts: [*parts, *new] if parts else new[1:])
        return self.compact(name) if sum(p["kind"] == "deletes" for p in self._latest(name)[1]) > MOST_DELETES else number

    def delete(self, name: str, keys: DataFrame) -> int:
        """Rows of these keys (a table with the key column) go."""
        gone = self._part(name, keys.select(self.key).distinct(), "deletes")
        return self._commit(name, lambda number, parts: [*parts, gone])

    def change(self, name: str, work: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
        """Upserts work(table) and returns it, of the version that it was worked out of: where another writer comes between, it's worked out again.

        What it returns is read from the part that was written, so that it is what the table has, however often rows are read.
        """
        for _ in range(TRIES):
            number, parts = self._latest(name)
            rows = work(self._rows(name, parts) if number else None)
            new = self._part(name, rows)
            if not new["rows"]:
                return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}/{new['part']}")
            gone = self._part(name, self.spark.read.parquet(f"{self.folder}/{name}/{new['part']}").select(self.key).distinct(), "deletes")
            if self._put(name, number + 1, [*parts, gone, new] if number else [new]):
                return self.spark.read.parquet(f"{self.folder}/{name}/{new['part']}")
        raise Conflict(f"{name}: other writers were first {TRIES} times")

    def compact(self, name: str) -> int:
        """One part of the rows that count. Readers of earlier commits keep theirs."""
        for _ in range(TRIES):
            number, parts = self._latest(name)
            whole = self._part(name, self._rows(name, parts))
            if self._put(name, number + 1, [whole]):
                return number + 1
        raise Conflict(f"{name}: other writers were first {TRIES} times")

    # ---- reading -------------------------------------------------------------------------------------------------

    def _same(self, key: str | None) -> None:
        if key not in (None, self.key):
            raise ValueError(f"this store's key is {self.key}")

    def _files(self, name: str, part: dict, values: list[str] | None) -> list[str]:
        """The part's paths that may hold one of the keys: all of it, or files by their ranges."""
        at = f"{self.folder}/{name}/{part['part']}"
        if values is None or part.get("low") is None:
            return [at] if values is None or part.get("rows") != 0 else []
        inside = [v for v in values if part["low"] <= v <= part["high"]]
        if not inside:
            return []
        fits: Column = reduce(lambda a, b: a | b, [(F.col("low") <= v) & (F.col("high") >= v) for v in inside])
        return [f"{at}/{r[0]}" for r in self.spark.read.parquet(f"{at}.files").filter(fits).select("file").collect()]

    def _rows(self, name: str, parts: list[dict], values: list[str] | None = None) -> DataFrame:
        """The rows of these parts that no later part of deleted keys hides."""
        rows, gone, group = [], [], []
        runs: list[tuple[int, list[str]]] = []
        for k, part in enumerate(parts):
            paths = self._files(name, part, values)
            if part["kind"] == "deletes":
                gone += [(k, paths)] if paths else []
                runs += [(k, group)] if group else []
                group = []
            else:
                group += paths
        runs += [(len(parts), group)] if group else []
        some = next((f"{self.folder}/{name}/{p['part']}" for p in parts if p["kind"] == "rows"), None)
        if some is None:
            raise NotFound(name)
        schema = self.spark.read.parquet(some).schema
        if not runs:
            return self.spark.createDataFrame([], schema)
        if not gone:
            return self.spark.read.schema(schema).parquet(*[p for _, g in runs for p in g])
        rows = [self.spark.read.schema(schema).parquet(*g).withColumn("_until", F.lit(k)) for k, g in runs]
        keys = [self.spark.read.parquet(*paths).select(self.key, F.lit(k).alias("_gone")) for k, paths in gone]
        last = reduce(DataFrame.unionByName, keys).groupBy(self.key).agg(F.max("_gone").alias("_gone"))
        # Rows of a run stand before the part of keys that ended it: what was deleted there or later is gone.
        joined = reduce(DataFrame.unionByName, rows).join(last, self.key, "left")
        return joined.filter(F.col("_gone").isNull() | (F.col("_gone") < F.col("_until"))).select(*schema.names)

    def read(self, name: str) -> DataFrame:
        number, parts = self._latest(name)
        if not number:
            raise NotFound(name)
        return self._rows(name, parts)

    def lookup(self, name: str, values: list) -> DataFrame:
        """The rows with one of these keys, from the files that may hold them."""
        number, parts = self._latest(name)
        if not number:
            raise NotFound(name)
        return self._rows(name, parts, [str(v) for v in values]).filter(F.col(self.key).isin(*values))

    def get(self, name: str, value, key: str | None = None):
        self._same(key)
        found = self.lookup(name, [value]).take(1)
        if not found:
            raise NotFound(f"{name}: {value}")
        return found[0]


def upserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


PATCHABLE = ("rect", "comment", "correction", "kind", "severity")


def patch_annotation(annotations: DataFrame, annotation_id: str, changes: dict, now: str) -> DataFrame:
    """annotations with one changed by a person. Marks don't hang on them; ids, result and creation can't change.

    A moved box stands alone: its further boxes go.
    """
    unknown = set(changes) - set(PATCHABLE)
    if unknown or not changes:
        raise ValueError(f"cannot change {sorted(unknown)}" if unknown else "nothing to change")
    hit = F.col("id") == annotation_id
    new = {c: F.when(hit, v if hasattr(v, "alias") else F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}
    new |= {"edited_by_human": F.when(hit, True).otherwise(F.col("edited_by_human")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    if "rect" in changes:
        new["extra_rects"] = F.when(hit, F.slice("extra_rects", 1, 0)).otherwise(F.col("extra_rects"))
    return annotations.withColumns(new)


def delete_annotation(annotations: DataFrame, annotation_id: str) -> DataFrame:
    return annotations.filter(F.col("id") != annotation_id)


def human_annotation(rows: DataFrame) -> DataFrame:
    """Annotations that a person drew: their box is exact."""
    return rows.withColumns({"anchor_status": F.lit("exact"), "origin": F.lit("human"), "edited_by_human": F.lit(True)})


def result_history(results: DataFrame, annotations: DataFrame, key: str = "id", ref: str = "result_id", columns: list[str] | None = None, newest: str = "created_at") -> DataFrame:
    """Results with their number of annotations (0 if none), the newest first. Annotations are counted before the join."""
    counts = annotations.groupBy(F.col(ref).alias(key)).agg(F.count(F.lit(1)).alias("annotation_count"))
    joined = results.select(key, newest, *(columns or [])).join(counts, key, "left")
    return joined.withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0))).orderBy(F.col(newest).desc(), key)


def document_listing(docs: DataFrame) -> DataFrame:
    """Documents without their texts, the newest first; the scan reads no text column."""
    return docs.drop("pages", "full_text", "content").orderBy(F.col("created_at").desc())
