"""A stated set of quotes searched for in all texts: one scan of the texts, which are never joined or moved.

Quotes and texts are normalised first (`functions.text.normalise`). An exact place is found by one Aho-Corasick automaton
over all quotes. A typo-tolerant one is a run of words of which each is near its counterpart in the quote (token
similarity TOKEN_FLOOR or more); so the quote's longest word must be near some word of the text, and only there a window is
scored. Which words are near is settled once, for the distinct words of all texts: a word meets those of the quotes' longest
words whose length allows it, in a join on the length, letter counts rule out most, the built-in edit distance the rest.
Nothing is lost by this, whatever the slips.

The quotes and the words near them travel to the tasks, in blocks of BLOCK_BYTES; each block is one more scan of the texts,
and the distinct words are one before them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ANCHOR_THRESHOLD, TOKEN_FLOOR, normalise, ocr_fold
from ..plans.steps import settled
from .anchor import usable

#: Bytes of quotes and words that travel at once; characters of text that a task works on together; distances that it remembers.
BLOCK_BYTES, GROUP_CHARS, REMEMBERED = 16 << 20, 1_000_000, 500_000


def fold(text: str) -> str:
    """`functions.text.ocr_fold` of a Python string."""
    text = text.replace("rn", "m")
    for a, b in zip("l1|05", "iiios"):  # faster than a table where a text isn't ASCII
        text = text.replace(a, b)
    return text


def distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> float:
    """Token similarity of folded tokens."""
    longest = max(len(a), len(b))
    return 1.0 if a == b or not longest else 1.0 - distance(a, b) / longest


def may_be_near(a: str, b: str) -> bool:
    """False only if two folded tokens are under the floor: by their lengths, or by letters that only one of them has, each of which takes an edit."""
    most = max(len(a), len(b))
    if not most or 1.0 - abs(len(a) - len(b)) / most < TOKEN_FLOOR:
        return not most
    x, y = set(a), set(b)
    return 1.0 - max(len(x - y), len(y - x)) / most >= TOKEN_FLOOR


def longest(tokens: list[str]) -> str:
    """The longest token, the first of equal ones."""
    return max(tokens, key=len)


#: Letters that words are first compared by. They order the work, not the result.
COMPARED = "abcdefghijklmnopqrstuvwxyzäéöüß"
#: Keys that travel to the tasks; more are joined by an exchange.
SENT = 100_000


def _letters(word: Column) -> Column:
    """A bit for each of the letters that a word has."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.contains(word, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(COMPARED)))


def distinct_words(sheets: DataFrame) -> DataFrame:
    """(word): the distinct folded words of normalised texts (_t); each batch of texts gives its own once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": list(set().union(*[fold(t).split(" ") for t in batch["_t"]]))}, dtype=object)

    return sheets.select("_t").mapInPandas(run, "word string").distinct()


def near_words(sheets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, word): the distinct folded words of normalised texts (_t) that are near a key, a folded word of a quote.

    Words and keys meet on the words' length: a key is sent to the lengths that TOKEN_FLOOR allows.
    """
    most = 1 - TOKEN_FLOOR  # edits, as a share of the longer word's length
    tasks = int(sheets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out anew: a few bytes of words are much work.
    words = distinct_words(sheets).repartition(tasks, "word").select("word", F.length("word").alias("n"), _letters(F.col("word")).alias("_w"))
    sent = keys.withColumns({"_n": F.length("key"), "_k": _letters(F.col("key"))})
    sent = sent.withColumn("n", F.explode(F.sequence(F.ceil(F.col("_n") * (1 - most) - 1e-9).cast("int"), F.floor(F.col("_n") / (1 - most) + 1e-9).cast("int"))))
    met = words.join(F.broadcast(sent) if keys.count() <= SENT else sent, "n")
    # A letter that only one of them has takes an edit, and an edit is for one letter of each at most.
    lacks = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    fits = F.greatest(lacks("_w", "_k"), lacks("_k", "_w")) <= F.greatest("n", "_n") * most + 1e-9
    near = (F.col("word") == F.col("key")) | (1.0 - F.levenshtein("key", "word") / F.greatest("n", "_n") >= TOKEN_FLOOR)
    return met.filter(fits).filter(near).select("key", "word")


class Quotes:
    """Normalised quotes, ready to be looked for."""

    def __init__(self, quotes: list[tuple], threshold: float, near: dict[str, list[str]] | None):
        """quotes: (id, text, ...). near: words of texts, folded, and the longest words of quotes that each is near to; None: exact places alone."""
        self.threshold, self.fuzzy = threshold, near is not None
        self.ids, self.texts = [q[0] for q in quotes], [q[1] for q in quotes]
        by_text = defaultdict(list)
        for k, t in enumerate(self.texts):
            by_text[t].append(k)
        self.automaton = ahocorasick.Automaton()
        for t, of in by_text.items():
            self.automaton.add_word(t, (len(t), of))
        self.automaton.make_automaton()
        self.tokens = [fold(t).split(" ") for t in self.texts]
        # The word of each quote that a window must have something near to: the longest, the first of equal ones.
        self.at = [t.index(longest(t)) for t in self.tokens]
        keys: dict[str, list[int]] = defaultdict(list)
        for k, (t, i) in enumerate(zip(self.tokens, self.at)):
            keys[t[i]].append(k)
        self.near = {word: sorted(k for name in names for k in keys[name]) for word, names in (near or {}).items()}
        self.known: dict[tuple[str, str], float] = {}

    def _similar(self, a: str, b: str) -> float:
        if (found := self.known.get((a, b))) is None:
            found = self.known[a, b] = similarity(a, b) if may_be_near(a, b) else 0.0
        return found

    def _score(self, quote: int, words: list[str], start: int) -> float:
        total = 0.0
        for p, w in zip(self.tokens[quote], words[start : start + len(self.tokens[quote])]):
            s = self._similar(p, w)
            if s < TOKEN_FLOOR:
                return 0.0
            total += s
        return total / len(self.tokens[quote])

    def find(self, texts: list[str]) -> Iterator[list[tuple]]:
        """For each normalised text (quote, status, place, similarity): the place is the character of an exact quote, else the word."""
        cut = [fold(t).split(" ") if t and self.fuzzy else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        for text, words in zip(texts, cut):
            exact: dict[int, int] = {}
            for end, (size, of) in self.automaton.iter(text) if self.ids else ():
                for k in of:
                    exact.setdefault(k, end - size + 1)
            best: dict[int, tuple[float, int]] = {}
            for place, word in enumerate(words):
                for k in self.near.get(word, ()):
                    start = place - self.at[k]
                    if k in exact or start < 0 or start + len(self.tokens[k]) > len(words):
                        continue
                    score = self._score(k, words, start)
                    if score >= self.threshold and score > best.get(k, (0.0, 0))[0]:
                        best[k] = score, start
            yield [(k, "exact", at, 1.0) for k, at in exact.items()] + [(k, "fuzzy", start, score) for k, (score, start) in best.items()]


def search_quotes(quotes: DataFrame, texts: DataFrame, quote_id: str = "quote_id", quote: str = "quote", text_id: str = "doc_id", text: str = "text", threshold: float = ANCHOR_THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """(quote_id, text_id, status, place, similarity) of every quote in every text that holds it: exactly (place: its first
    character in the normalised text) or else, by the best window, with slips (place: its first word).

    Quotes too short to anchor are not looked for. Repeated ids give repeated rows.
    """
    wanted = settled(usable(quotes, quote).select(quote_id, normalise(F.trim(quote)).alias("_q")).filter("_q != ''"))
    kinds = {quote_id: wanted.schema[quote_id].dataType.simpleString(), text_id: texts.schema[text_id].dataType.simpleString()}
    sheets = texts.select(text_id, normalise(F.col(text)).alias("_t")).filter("_t != ''")
    folded = F.split(ocr_fold(F.col("_q")), " ")
    first = F.aggregate(folded, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    near = settled(near_words(sheets, wanted.select(first.alias("key")).distinct())) if fuzzy else None
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("_q") + 64), F.lit(0))).first()[0]
    size += near.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("key") + 64), F.lit(0))).first()[0] if fuzzy else 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    at = F.pmod(F.xxhash64(first), F.lit(blocks))
    out = None
    for block in range(blocks):
        some = [tuple(r) for r in wanted.filter(at == block).toLocalIterator()]  # BLOCK_BYTES, with the words
        words: dict[str, list[str]] = defaultdict(list)
        for r in near.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).toLocalIterator() if fuzzy else ():
            words[r["word"]].append(r["key"])
        shared = texts.sparkSession.sparkContext.broadcast((some, dict(words) if fuzzy else None))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = Quotes(shared.value[0], threshold, shared.value[1])
            for batch in batches:
                rows, group, ids, chars = [], [], [], 0

                def search() -> None:
                    for i, found in zip(ids, held.find(group)):
                        rows.extend((held.ids[k], i, status, place, score) for k, status, place, score in found)

                for i, t in zip(batch[text_id], batch["_t"]):
                    group.append(t)
                    ids.append(i)
                    chars += len(t)
                    if chars > GROUP_CHARS:
                        search()
                        group, ids, chars = [], [], 0
                search()
                yield pd.DataFrame(rows, columns=[quote_id, text_id, "status", "place", "similarity"])

        found = sheets.mapInPandas(run, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", status string, place int, similarity double")
        out = found if out is None else out.unionByName(found)
    return out
