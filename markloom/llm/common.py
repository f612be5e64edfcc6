"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder serves a local
    session, whose executor is the driver; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or f"file://{tempfile.gettempdir()}/markloom-checkpoints"


def shipped(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to all executors; its name there, for SparkFiles.get."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def let_go() -> None:
    """Gives the machine back what this Python worker has freed. Spark keeps workers for the stages and queries that follow,
    and what a task's batches took would stay with them otherwise. For the end of a task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a checkpoint in the shared folder.

    Used only for narrow columns (ids, hashes, sizes): a lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


class Tables:
    """Settled tables of one piece of work: Parquet in the shared folder, removed when the work ends.

    What `settle` cuts with a checkpoint stays until somebody clears the folder; work in many rounds leaves many of those.
    A table here is written once, read by columns, and gone with its part. Nothing that is read later may come from it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self._next = spark, folder or f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", count()

    def settle(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{next(self._next)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def part(self) -> Tables:
        """Tables that go earlier than these."""
        return Tables(self.spark, f"{self.folder}/part-{next(self._next)}")

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark._jvm.System.gc()  # Spark removes the files of exchanges when the driver has collected their plans

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


#: Rows up to which a settled table of ids travels to all tasks; a longer one is joined by an exchange.
SENT = 500_000


def joined(rows: DataFrame, wanted: DataFrame, by: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined to a settled narrow table, which travels to the tasks only while it has up to SENT rows."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, by, how)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; further columns can't clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
