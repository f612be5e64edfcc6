"""Language identification by compression.

For each language a raw-content dictionary is cut from a bounded sample of its labelled texts. A text belongs to the
language whose dictionary compresses it best. What is compressed are the words of the whole text, in lower case and each
once: a word that is said a hundred times would else be found in the text itself, and tell nothing of the dictionary.
They are compressed in blocks, so that the dictionary counts for all of a long text. The margin between the best and the second-best size is the score; a
text with a margin under `least_margin` is rejected (the operator's `rejected`), since no dictionary explains it.

Sample: per language SAMPLE_TEXTS distinct texts, those of the smallest hashes of their content. Each is read whole and
gives all its words. A dictionary is a list of these words, the commonest last, where they are cheapest to refer to; where
they are more than DICTIONARY_BYTES, those that most texts have are taken. Dictionaries are all that is collected and
broadcast.

Defined cases: a null text, or one without a letter, is `und` with score 0; with one learned language every other text
gets it with score 0; with none every text is `und`; rows with a null language are predicted, not learned from; ties go
to the first language in code point order; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import joined, settle

#: Rows that are learned from, and the size of what comes of them, for each language.
SAMPLE_TEXTS = 500
DICTIONARY_BYTES = 192 * 1024
BLOCK = 4096
LEAST_MARGIN = 0.01
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """The distinct runs of letters (category L) of a text in lower case, in order of their first place."""
    found = dict.fromkeys(_WORD.findall(text.lower()))
    if all(map(str.isalpha, found)):
        return list(found)
    # Number signs such as fractions count as word characters there, but aren't letters.
    return list(dict.fromkeys(x for w in found for x in ([w] if w.isalpha() else _LETTERS.findall(w))))


def vocabulary_of(text: str) -> str:
    return " ".join(words_of(text))


def learn(docs: DataFrame, use: Column, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, from the rows for which `use` holds.

    Distinct texts are drawn by their hashes, so that a text with very many copies is one text. The hashes of a language
    are first thinned to about three times what is needed (counts are known), so that ordering them never gathers a
    whole language in one task; only the texts drawn, SAMPLE_TEXTS a language, are then read and moved.
    """
    named = docs.select(docs[text].alias("text"), docs[lang].alias("lang"), use.alias("_use")).filter("_use AND lang IS NOT NULL AND length(text) > 0").select("lang", F.xxhash64("text", F.lit(3)).alias("_h"), "text")
    hashes = settle(named.select("lang", "_h").distinct())
    counts = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    thin = hashes.join(counts, "lang").filter(F.pmod("_h", F.lit(1 << 40)) / float(1 << 40) < 3.0 * SAMPLE_TEXTS / F.col("n"))
    drawn = settle(thin.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 40)), "_h"))).filter(F.col("_k") <= SAMPLE_TEXTS).select("lang", "_h", "_k"))

    @F.pandas_udf("array<string>")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    # Copies of a text are one before its words are counted.
    held = joined(named, drawn, ["lang", "_h"]).groupBy("lang", "_k").agg(F.min("text").alias("text"))
    counts = held.select("lang", F.explode(each("text")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    fit = counts.withColumn("_upto", F.sum(F.octet_length("word") + 1).over(order)).filter(F.col("_upto") <= DICTIONARY_BYTES)
    words = defaultdict(list)
    for row in fit.orderBy("lang", "n", F.desc("word")).toLocalIterator():
        words[row["lang"]].append(row["word"])
    return {name: " ".join(words[name]).encode("utf-8", "surrogatepass") for name in sorted(words)}


class Classifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = -1):
        self.names = sorted(dictionaries)
        self.coders = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False))

    def sizes(self, words: str) -> list[int]:
        data = words.encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = vocabulary_of(text or "")
        if not self.names or not words:
            return "und", 0.0
        if len(self.names) == 1:
            return self.names[0], 0.0
        sizes = self.sizes(words)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.names[best], max(0.0, min(1.0, 1 - sizes[best] / second))


def identify(spark: SparkSession, docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns of `carry`, lang_pred, score and rejected of every row. Only the text is looked at."""
    shared = spark.sparkContext.broadcast(dictionaries)  # DICTIONARY_BYTES for each language

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    guess = F.pandas_udf(run, "lang_pred string, score double")
    out = docs.select(docs[doc_id].alias("doc_id"), *[c.alias(n) for n, c in (carry or {}).items()], guess(docs[text]).alias("_g")).select("*", "_g.*").drop("_g")
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < least_margin))
