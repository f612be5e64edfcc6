"""Files that arrive in a folder: each content is handled once, however often it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PAGES = "doc_id STRING, page INT, text STRING, source STRING, sha256 STRING, arrived TIMESTAMP"


def arriving_pages(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Pages that land in a folder as JSON lines, some files to a batch."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).json(folder)


def once_each(pages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first arrival of each page's content; the state of contents older than the watermark is dropped."""
    return pages.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["sha256", "page"])


def transcribe_stream(pages: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of pages that need reading to `work`, until the folder is read; a failed batch is handed again."""
    from ..functions.text import needs_transcription

    wanted = once_each(pages).filter(needs_transcription(F.col("text"), F.col("source")))
    return wanted.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
