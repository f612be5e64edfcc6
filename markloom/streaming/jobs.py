"""One reading job for each document: leases as rows of the store, claimed before the work and closed after it.

A document is claimed by putting a row with its owner and an end in the table of leases, in one commit: of writers that
want the same document at once one is first, and the others work their claims out again and find it taken. A lease that
is done stays; one that failed may be claimed again, a few times; one whose end has passed too, since its owner may be
lost. Closing a lease counts only for its owner. A batch of a stream that is run again finds its own claims and goes on.

Defined cases: a document that arrives several times in a batch is claimed once; null ids are left out; a job that fails
leaves all its documents failed, with the reason, and the stream goes on.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.read import Transcriber, read_documents
from ..plans.rounds import Rules
from ..sources.store import Store

#: How long an owner may hold a document, and how often a failed one is claimed.
LEASE_SECONDS, MOST_CLAIMS = 1800, 3
LEASE = "id string, status string, owner string, until long, claims int, error string"


class Leases:
    """Who reads which document, in table `name` of a store."""

    def __init__(self, store: Store, name: str = "leases", seconds: int = LEASE_SECONDS, most: int = MOST_CLAIMS, now: Callable[[], float] = time.time):
        self.store, self.name, self.seconds, self.most, self.now = store, name, seconds, most, now

    def _table(self, table: DataFrame | None) -> DataFrame:
        return table if table is not None else self.store.spark.createDataFrame([], LEASE)

    def claim(self, docs: DataFrame, owner: str) -> DataFrame:
        """(id, ...LEASE) of those of docs (id) that are the owner's from now on, or were already."""
        wanted = docs.filter("id IS NOT NULL").select(F.col("id").cast("string").alias("id")).distinct()
        now = int(self.now() * 1000)

        def work(table: DataFrame | None) -> DataFrame:
            held = wanted.join(self._table(table), "id", "left")
            mine = F.col("owner") == owner
            free = F.col("status").isNull() | ((F.col("status") == "failed") & (F.col("claims") < self.most)) | ((F.col("status") == "claimed") & (mine | (F.col("until") <= now)))
            claims = F.coalesce("claims", F.lit(0)) + F.when(F.coalesce(mine & (F.col("status") == "claimed"), F.lit(False)), 0).otherwise(1)
            return held.filter(free).select("id", F.lit("claimed").alias("status"), F.lit(owner).alias("owner"), F.lit(now + self.seconds * 1000).cast("long").alias("until"), claims.cast("int").alias("claims"), F.lit(None).cast("string").alias("error"))

        return self.store.change(self.name, work)

    def close(self, results: DataFrame, owner: str) -> None:
        """Ends the owner's leases: results are (id, status, error), the status done or failed."""
        said = results.select(F.col("id").cast("string").alias("id"), F.col("status").alias("_s"), F.col("error").alias("_e"))

        def work(table: DataFrame | None) -> DataFrame:
            held = self._table(table).filter((F.col("owner") == owner) & (F.col("status") == "claimed"))
            return held.join(said, "id").select("id", F.col("_s").alias("status"), "owner", "until", "claims", F.col("_e").alias("error"))

        self.store.change(self.name, work)


def _reason(error: Exception) -> str:
    """What a job failed of: the innermost error that its message names."""
    said = str(error)
    lines = [x.strip() for x in said.splitlines() if re.match(r"\s*[\w.]*(Error|Exception): ", x)]
    return (lines[-1] if lines else said)[:500]


def read_batch(pages: DataFrame, ask: Transcriber | None, store: Store, leases: Leases, owner: str, rules: Rules = Rules(), pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Reads the documents of a batch of pages (see `read_documents`) that nobody has or had; the leases that it took.

    Their pages go to table pages, their status to table transcriptions, both by document; then the leases are closed.
    """
    taken = leases.claim(pages.select(F.col("doc_id").alias("id")), owner)
    ours = pages.join(taken.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "page"])
    if taken.isEmpty():
        return taken
    try:
        got = read_documents(ours, ask, rules=rules, pause=pause)
        named = got.pages.select(F.concat_ws(":", "doc_id", "page").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "page", "text", "source")
        store.upsert("pages", named)
        status = taken.select("id").join(got.documents.select(F.col("doc_id").cast("string").alias("id"), "status", "legibility", "unclear", "error"), "id", "left")
        store.upsert("transcriptions", status.withColumn("status", F.coalesce("status", F.lit("readable"))))
        written = store.read("transcriptions").join(taken.select("id"), "id", "left_semi")
        leases.close(written.select("id", F.when(F.col("status") == "failed", "failed").otherwise("done").alias("status"), "error"), owner)
    except Exception as error:  # the job's documents have failed; what it wrote before is whole
        leases.close(taken.select("id", F.lit("failed").alias("status"), F.lit(_reason(error)).alias("error")), owner)
    return taken


def reading_stream(pages: DataFrame, ask: Transcriber | None, store: Store, leases: Leases, checkpoint: str, name: str = "reader") -> StreamingQuery:
    """Reads documents as their pages arrive, each document once; all pages of a document arrive in one file."""

    def work(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            read_batch(held, ask, store, leases, f"{name}-{number}")
        finally:
            held.unpersist()

    return pages.writeStream.queryName(name).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
