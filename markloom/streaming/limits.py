"""Token allowances: what a rolling window has used, as a query and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_usage(requests: DataFrame, key: list[str], at: str = "ts", tokens: str = "tokens", seconds: int = 60, precision: int = 1_000_000) -> DataFrame:
    """Adds `used`: tokens of the key in the window up to each request. One exactly `seconds` old no longer counts.

    Times are whole microseconds, so the open end is a range that starts one microsecond later. Keys keep windows apart:
    nothing is summed in one task but one key's requests.
    """
    stamp = F.unix_micros(F.col(at).cast("timestamp"))
    frame = Window.partitionBy(*key).orderBy(stamp).rangeBetween(-seconds * precision + 1, Window.currentRow)
    return requests.withColumn("used", F.sum(tokens).over(frame))


def admission(requests: DataFrame, key: list[str], limit: int, at: str = "ts", tokens: str = "tokens", seconds: int = 60) -> DataFrame:
    """Adds to `rolling_usage` whether the allowance was kept, and refuses what could never fit."""
    used = rolling_usage(requests, key, at, tokens, seconds)
    return used.withColumn("verdict", F.when(F.col(tokens) > limit, "too_large").when(F.col("used") > limit, "must_wait").otherwise("fits"))


def usage_stream(requests: DataFrame, key: str = "provider", at: str = "ts", tokens: str = "tokens", lateness: str = "2 minutes") -> DataFrame:
    """Tokens by key and minute of a stream, with a watermark: state of minutes past it is dropped."""
    return requests.withWatermark(at, lateness).groupBy(key, F.window(at, "1 minute")).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("requests"))
