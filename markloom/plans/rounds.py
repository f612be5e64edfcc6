"""Pieces of documents handed to a judge in rounds, as a table of work that each round extends.

A piece has its document's keys and a path: its place among its siblings, after its parents' places. A round asks about all
open pieces at once. A transient failure is asked again after a wait that doubles; a reply that can't be used is asked for
again with its errors, as often as the rules allow; a refused piece, and where the rules say so an unusable one, is split
and its parts are asked about, down to a depth. What is answered, what failed and every attempt are tables; paths keep
parts in order. Rounds are driver steps, at most (depth + 1) x attempts of them, each settled, so that a lost executor
costs no request twice.

Defined cases: no pieces make no request; a null text is empty; a judge that leaves a piece out has failed for now
(transient); pieces of a document go on when another piece of it has failed, so that all failures are told at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators.chunk import split_refused
from .steps import settled


@dataclass(frozen=True)
class Rules:
    """How often a piece is asked about, the first wait, replies asked for again with their errors, depth of splitting,
    tokens under which parts aren't wished for, and whether an unusable reply splits its piece. Fixed values."""

    attempts: int = 3
    wait_ms: int = 400
    repairs: int = 0
    depth: int = 4
    least_tokens: int = 150
    split_unusable: bool = True


class Worked(NamedTuple):
    """answered: keys, path, text, carried columns, raw, repairs. failed: keys, path, text, fate (outage, too_large,
    unusable, refused), message. attempts: keys, path, attempt, repairs, outcome, wait_ms."""

    answered: DataFrame
    failed: DataFrame
    attempts: DataFrame


#: Batches of pieces in (keys, path, text, carried columns, attempt, earlier, errors); out, in the same order, `outcome`
#: (ok, transient, too_large, permanent), `raw` and, if wanted, `message`. errors: what was wrong with the reply `earlier`.
Reader = Callable[[pd.DataFrame], pd.DataFrame]
#: Adds `errors`, an array of messages, to replies with a column raw; none means usable.
Check = Callable[[DataFrame], DataFrame]

_STATE = "_attempt int, _repairs int, _earlier string, _errors array<string>"


def rounds(pieces: DataFrame, judge: Reader, keys: list[str], rules: Rules = Rules(), check: Check | None = None, pause: Callable[[float], None] = time.sleep) -> Worked:
    """Asks about pieces (keys, path array<int>, text, further columns, which a split keeps) until none is open."""
    carried = [c for c in pieces.columns if c not in (*keys, "path", "text")]
    own = [*keys, "path", "text", *carried]
    todo = pieces.select(*keys, "path", F.coalesce("text", F.lit("")).alias("text"), *carried)
    todo = todo.withColumns({"_attempt": F.lit(1), "_repairs": F.lit(0), "_earlier": F.lit(None).cast("string"), "_errors": F.lit(None).cast("array<string>")})
    said = "_outcome string, _raw string, _message string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema) + f", {said}"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            reply = judge(batch.rename(columns={"_attempt": "attempt", "_earlier": "earlier", "_errors": "errors"}).drop(columns="_repairs")).reset_index(drop=True)
            there = lambda c: reply[c].to_numpy() if c in reply else None
            yield batch.reset_index(drop=True).assign(_outcome=there("outcome"), _raw=there("raw"), _message=there("message"))

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([split_refused(t, b) for t, b in zip(texts, budget)], dtype=object)

    answered, failed, attempts = [], [], []
    first = todo
    while True:
        replies = todo.mapInPandas(ask, schema)
        wrong = F.array().cast("array<string>")
        if check:
            replies = check(replies.withColumnRenamed("_raw", "raw")).withColumnsRenamed({"raw": "_raw", "errors": "_wrong"})
            wrong = F.when(F.col("_outcome") == "ok", F.coalesce("_wrong", wrong)).otherwise(wrong)
        replies = replies.withColumn("_wrong", wrong).withColumn("_outcome", F.when(F.size("_wrong") > 0, "unusable").otherwise(F.coalesce("_outcome", F.lit("transient"))))
        replies = settled(replies.select(*todo.columns, "_outcome", "_raw", "_message", "_wrong"))
        outcome, last = F.col("_outcome"), F.col("_attempt") >= rules.attempts
        again = F.when(outcome == "transient", ~last).when(outcome == "unusable", (F.col("_repairs") < rules.repairs) & ~last).otherwise(False)
        wait = F.when((outcome == "transient") & again, F.lit(rules.wait_ms) * F.pow(F.lit(2.0), F.col("_attempt") - 1)).cast("long")
        attempts.append(replies.select(*keys, "path", F.col("_attempt").alias("attempt"), F.col("_repairs").alias("repairs"), outcome.alias("outcome"), wait.alias("wait_ms")))
        answered.append(replies.filter("_outcome = 'ok'").select(*own, F.col("_raw").alias("raw"), F.col("_repairs").alias("repairs")))
        small = (outcome == "too_large") | ((outcome == "unusable") & ~again & F.lit(rules.split_unusable))
        budget = F.greatest(F.lit(rules.least_tokens), F.floor(estimate_tokens(F.col("text")) / 2)).cast("int")
        depth = F.size("path") - F.lit(1)
        cut = settled(replies.filter(small & (depth < rules.depth)).withColumn("_parts", parts("text", budget)).filter(F.size("_parts") > 1))
        names = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "path")]
        was_cut = cut.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "path")])
        over = replies.filter((outcome != "ok") & ~again).join(was_cut, reduce(lambda a, b: a & b, names), "left_anti")
        fate = F.when(outcome == "transient", "outage").when(outcome.isin("too_large", "unusable"), outcome).otherwise("refused")
        failed.append(over.select(*keys, "path", "text", fate.alias("fate"), F.when(outcome == "unusable", F.array_join(F.slice("_wrong", 1, 5), "; ")).otherwise(F.col("_message")).alias("message")))
        once_more = replies.filter(again).withColumns({"_attempt": F.col("_attempt") + 1, "_repairs": F.col("_repairs") + F.when(outcome == "unusable", 1).otherwise(0), "_earlier": F.when(outcome == "unusable", F.col("_raw")).otherwise(F.col("_earlier")), "_errors": F.when(outcome == "unusable", F.col("_wrong")).otherwise(F.col("_errors"))})
        children = cut.select("*", F.posexplode("_parts").alias("_n", "_t")).withColumns({"path": F.array_append("path", F.col("_n")), "text": F.col("_t"), "_attempt": F.lit(1), "_repairs": F.lit(0), "_earlier": F.lit(None).cast("string"), "_errors": F.lit(None).cast("array<string>")})
        todo = settled(once_more.select(*first.columns).unionByName(children.select(*first.columns)))
        waits = replies.agg(F.max(wait)).first()[0]
        if todo.isEmpty():
            break
        if waits:
            pause(waits / 1000)
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    return Worked(union(answered), union(failed), union(attempts))
