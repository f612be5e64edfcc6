"""Steps of a plan: a result computed once, kept in the folder that all executors share."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session, whose executor is the driver; a cluster is an error. What several branches of a plan read is settled, so that neither the work nor the plan is repeated in each.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/markloom-checkpoints")
    return df.checkpoint(eager=True)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for an exchange that get about so many rows of df each, spark.sql.shuffle.partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by keys to so many tasks, if Spark's own exchanges have fewer; else df."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
