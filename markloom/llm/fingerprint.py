"""Document fingerprints by one-permutation MinHash with optimal densification.

Each word shingle is hashed once. The upper bits of the hash give one of BINS bins, and each bin keeps its smallest hash.
An empty bin takes the value of the first full one in an order of its own, made by hashing (the same for every text), so that the estimate stays unbiased for short texts too. Of each bin only the B lowest bits are stored,
packed; the share of equal bins is corrected for the 2^-B of bins that agree by chance.

Hashes are polynomials over the bytes of a word, from running sums over a whole batch of texts, mixed per shingle: no
Python code runs for a word.

Defined cases: a null or empty text, or one of white space, has no shingle and the fingerprint EMPTY; two such have
likeness 1, one such and another text 0; fewer words than a shingle make one shingle; equal texts have equal
fingerprints; an empty table gives no rows. Words are as [^\\x20\\x09-\\x0D]+ and case counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import deal

WORDS = 5
BINS = 512
B = 4
EMPTY = "-"
#: For products of a similarity and a count that floating point leaves a little above a whole number.
SLACK = 1e-6
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, and the number of the text it is in."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _IS_SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(joined)), dtype=np.uint64)])
    # The sum over a word, divided by the power at its start, is a polynomial in the word's bytes alone.
    value = (sums[ends] - sums[starts]) * _powers(_ODD_INVERSE, len(joined))[starts]
    limits = np.cumsum([len(t) + 1 for t in texts])
    return _mix(value ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(limits, starts, side="right")


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of the texts and the text of each; a shorter text is one shingle."""
    hashes, of = word_hashes(texts)
    n = np.bincount(of, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(len(hashes)) - begin[of]
    total = np.zeros(len(hashes), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, dtype=np.uint64)])
    for k in range(words):
        # a word past the end of a short text counts as 0
        inside = place + k < n[of]
        total = _mix(total * np.uint64(3) + np.where(inside, padded[k : k + len(hashes)], np.uint64(0)) + np.uint64(k + 1))
    whole = (place + words <= n[of]) | (place == 0)
    return total[whole], of[whole]


@cache
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it looks at the others when it is empty, and each other bin's place in that order."""
    keys = _mix(np.arange(1, bins * bins + 1, dtype=np.uint64)).reshape(bins, bins)
    order = np.argsort(keys, axis=1, kind="stable")
    return order, np.argsort(order, axis=1, kind="stable")


#: Looks at single bins, all texts at once, before what is still empty is settled text by text.
LOOKS = 16


def bin_minima(texts: list[bytes], words: int = WORDS, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each text and bin, densified, and which texts have no shingle."""
    hashes, of = shingles(texts, words)
    flat = np.full(len(texts) * bins, _FULL, dtype=np.uint64)
    top = (hashes >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    np.minimum.at(flat, of * bins + top, hashes)
    low = flat.reshape(len(texts), bins)
    empty = low == _FULL
    blank = empty.all(axis=1)
    dense = low.copy()
    order, place = _orders(bins)
    row, column = np.nonzero(empty & ~blank[:, None])
    for look in range(LOOKS):
        pick = order[column, look]
        full = ~empty[row, pick]
        dense[row[full], column[full]] = low[row[full], pick[full]]
        row, column = row[~full], column[~full]
    # Texts with few full bins: each bin still empty takes the full bin that is first in its order.
    for k, first, n in zip(*np.unique(row, return_index=True, return_counts=True)):
        left, full = column[first : first + n], np.flatnonzero(~empty[k])
        dense[k, left] = low[k, full[place[np.ix_(left, full)].argmin(axis=1)]]
    return dense, blank


def codes(texts: list[bytes], words: int = WORDS, bins: int = BINS, b: int = B) -> tuple[np.ndarray, np.ndarray]:
    dense, blank = bin_minima(texts, words, bins)
    return (dense & np.uint64((1 << b) - 1)).astype(np.uint8), blank


def packed(code: np.ndarray, blank: np.ndarray, b: int = B) -> list[str]:
    """The fingerprints as hexadecimal text, B bits for each bin."""
    bits = np.unpackbits(code[:, :, None], axis=2)[:, :, 8 - b :].reshape(len(code), -1)
    rows = np.packbits(bits, axis=1)
    return [EMPTY if e else r.tobytes().hex() for r, e in zip(rows, blank)]


def likeness(a: np.ndarray, a_blank: np.ndarray, c: np.ndarray, c_blank: np.ndarray, b: int = B) -> np.ndarray:
    """The estimated Jaccard similarity, corrected for chance agreement, in 0 to 1."""
    chance = 2.0**-b
    got = np.clip(((a == c).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_blank | c_blank, (a_blank & c_blank).astype(float), got)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[bytes]:
    """The distinct shingle hashes of each text in order, eight bytes each."""
    hashes, of = shingles(texts, words)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    ends = np.cumsum(np.bincount(of[fresh], minlength=len(texts)))
    return [x.tobytes() for x in np.split(hashes[fresh], ends[:-1])]


def jaccard_at_least(a: bytes, c: bytes, least: float) -> bool:
    """Whether two shingle sets have that Jaccard similarity, by counting; two empty ones have 1."""
    x, y = len(a) // 8, len(c) // 8
    if min(x, y) + SLACK < least * max(x, y):
        return False
    both = np.concatenate([np.frombuffer(a, dtype=np.uint64), np.frombuffer(c, dtype=np.uint64)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared + SLACK >= least * (x + y - shared)


#: Texts that a task works on together: so many bytes, or one longer text, and so many texts. It bounds memory.
GROUP_CHARS, GROUP_TEXTS = 1_000_000, 1_500


def groups(data: Iterable[bytes], most: int = GROUP_CHARS) -> Iterator[list[bytes]]:
    held, size = [], 0
    for d in data:
        if held and (size + len(d) > most or len(held) >= GROUP_TEXTS):
            yield held
            held, size = [], 0
        held.append(d)
        size += len(d)
    if held:
        yield held


def fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, b: int = B, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made: list[str] = []
            for data in groups([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
                made += packed(*codes(data, words, bins, b), b)
            yield pd.Series(made, dtype=object)

    return docs.select(docs[doc_id].alias("doc_id"), F.pandas_udf(run, "string")(docs[text]).alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NO_ID = (1 << 63) - 1


def edits(docs: DataFrame, ranges: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next document.

    The next document is the one before in ids (descending order); after the last comes the first. Null ids come last in
    that order. Rows of equal id are in the order of a hash of their texts.
    """
    # -id ascending is id descending; nulls get the largest key.
    key = F.coalesce(-docs[doc_id].cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    dealt = deal(rows, "key", "text", ranges=ranges, after=True, wrap=True)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def group(held: list[tuple]) -> pd.DataFrame:
        """held: rows in order, of which the last is only the next document of the one before."""
        texts = [t for _, t in held]
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        changed = [edited(a, c).encode("utf-8", "surrogatepass") for a, c in zip(texts, texts[1:])]
        code, blank = codes(data)
        other, none = codes(changed)
        n = len(changed)
        return pd.DataFrame(
            {
                "doc_id": pd.array([i for i, _ in held[:n]], dtype="Int64"),
                "n_chars": [len(t) for t in texts[:n]],
                "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
                "fingerprint": packed(code[:n], blank[:n]),
                "edited_fingerprint": packed(other, none),
                "near_edited": likeness(code[:n], blank[:n], other, none),
                "near_next": likeness(code[:n], blank[:n], code[1:], blank[1:]),
            }
        )[columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0  # a task has one range, ended by the row after it
        for batch in batches:
            for k, t in zip(batch["key"], batch["text"]):
                held.append((None if k == NO_ID else -int(k), t))
                chars += len(t)
                if (chars > GROUP_CHARS or len(held) > GROUP_TEXTS) and len(held) > 1:
                    yield group(held)
                    held, chars = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield group(held)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("key", "text").mapInPandas(run, kinds)
