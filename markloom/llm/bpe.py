"""BPE encoding by speculation and verification, and decoding, for word-end vocabularies.

Texts fall into the same pieces as in the vocabulary's own normaliser and splitter. For the distinct pieces of a batch,
all at once, greedy longest match over the vocabulary proposes tokens. A row of tokens is what merging gives if and only if
every adjacent pair is what merging gives for the two tokens' characters alone; so all pairs of a batch are looked up at
once in a table of pairs, and only pairs never met before are tested by merging. Pieces with a bad pair undergo exact
merging, again many at once: each step merges the lowest pair of every piece that has one. Pieces of over SHORT bytes are
merged one by one with a heap of candidate merges, so that a piece of any length takes n log n steps.

A task holds a bounded number of words with their tokens (two generations of WORDS_HELD; a word that comes again stays)
and of tested pairs, and lets go of them when it ends.

Defined cases: a null or empty text has no tokens, and its digests are those of the empty string; special tokens that
stand in a text are one id each; repeated rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, shipped

#: Words of a generation of those whose tokens a task keeps at hand, and pairs of tokens that it remembers. They bound
#: memory alone: what was let go is encoded or tested again.
WORDS_HELD, PAIRS_HELD = 100_000, 300_000
#: Pieces of up to so many bytes are merged together, longer ones each with a heap.
SHORT = 64
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|[_\x1c-\x1f])+")
_NONE = np.int32(1 << 30)


class Lookup:
    """A hash table from whole numbers to whole numbers (both 0 or more), filled and asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        bits = int(2 * max(len(keys), room, 8)).bit_length()
        self.shift, self.last, self.n = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        self.add(keys, values)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there."""
        at = self._places(keys)
        self.n += len(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys  # of several that wanted a place one has it
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.last

    def get(self, keys: np.ndarray, none: int = -1) -> np.ndarray:
        at = self._places(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(none))
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            place = (at[todo] + 1) & self.last
            at[todo], found, wanted = place, self.keys[place], keys[todo]
            out[todo] = np.where(found == wanted, self.values[place], np.int32(none))
            todo = todo[(found != wanted) & (found >= 0)]
        return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordBpe:
    """A BPE vocabulary with word ends, from a file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        count = 1 + max([*ids.values(), *self.special.values()])
        self.names = [""] * count
        for t, i in [*ids.items(), *self.special.items()]:
            self.names[i] = t
        self.numerals = [str(i) for i in range(count)]
        # How a byte-level vocabulary spells bytes: printable ones as themselves, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        spelling = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.bytes_of = {ord(c): b for b, c in spelling.items()}
        # Single bytes inside a word and at its end.
        self.inner = np.array([ids[spelling[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([ids[spelling[b] + suffix] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.rank = Lookup(np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64), np.arange(len(pairs), dtype=np.int32))
        self._grow(ids, suffix)
        self.forget()
        self.merged = 0  # pieces that needed exact merging

    def _grow(self, ids: dict[str, int], suffix: str) -> None:
        """The trie over the bytes of all tokens: steps (node, byte) to a node, and the tokens that end at a node."""
        step: dict[int, int] = {}
        inside, ends = [-1], [-1]
        parts: list[bytes] = [b""] * len(self.names)
        at_end = np.zeros(len(self.names), dtype=bool)
        for token, i in ids.items():
            end = bool(suffix) and token.endswith(suffix)
            spelled = token[: -len(suffix)] if end else token
            parts[i], at_end[i] = bytes(self.bytes_of[ord(c)] for c in spelled), end
            node = 0
            for b in parts[i]:
                nearer = step.setdefault(node << 8 | b, len(inside))
                if nearer == len(inside):
                    inside.append(-1)
                    ends.append(-1)
                node = nearer
            (ends if end else inside)[node] = i
        self.steps = Lookup(np.fromiter(step.keys(), np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step)))
        self.token_inside, self.token_end = np.array(inside, dtype=np.int32), np.array(ends, dtype=np.int32)
        # The single bytes of each token, as ids, in one row.
        self.part_size = np.array([len(p) for p in parts], dtype=np.int64)
        self.part_at = np.cumsum(self.part_size) - self.part_size
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.parts = self.inner[data]
        last = (self.part_at + self.part_size - 1)[at_end & (self.part_size > 0)]
        self.parts[last] = self.final[data[last]]

    def forget(self) -> None:
        """Lets go of all words and pairs at hand."""
        none = np.zeros(0, dtype=np.int64)
        self.pairs = Lookup(none, none, PAIRS_HELD)  # left * 2^32 + right (ALONE: no right) -> whether it fits
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    ALONE = (1 << 31) - 1

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging of one row of ids: the lowest rank first, of equal ranks the leftmost. For long rows."""
        n, ids = len(ids), list(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        x = np.array(ids, dtype=np.int64)
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(self.rank.get(x[:-1] << 32 | x[1:]).tolist()) if r >= 0]
        heapq.heapify(heap)
        known: dict[int, int] = {}

        def push(k: int, j: int) -> None:
            pair = ids[k] << 32 | ids[j]
            if (r := known.get(pair)) is None:
                r = known[pair] = int(self.rank.get(np.array([pair]))[0])
            if r >= 0:
                heapq.heappush(heap, (r, k, ids[k], ids[j]))

        while heap:
            rank, k, left, right = heapq.heappop(heap)
            if not alive[k] or ids[k] != left or (j := after[k]) >= n or ids[j] != right:
                continue
            ids[k], alive[j], after[k] = int(self.made[rank]), False, after[j]
            if after[k] < n:
                before[after[k]] = k
                push(k, after[k])
            if before[k] >= 0:
                push(before[k], k)
        return [i for i, a in zip(ids, alive) if a]

    def _merge_even(self, ids: np.ndarray) -> np.ndarray:
        """Exact merging of many rows at once, each ended by one -1 or more. Returns rows of the same shape."""
        out = ids.copy()
        live, wide = np.arange(len(ids)), ids.shape[1]
        columns = np.arange(wide)

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = np.full(a.shape, _NONE, dtype=np.int32)
            both = (a >= 0) & (b >= 0)
            found[both] = self.rank.get(a[both].astype(np.int64) << 32 | b[both], int(_NONE))
            return found

        near = np.full(ids.shape, _NONE, dtype=np.int32)
        near[:, :-1] = ranks(ids[:, :-1], ids[:, 1:])
        while len(live):
            k = near.argmin(axis=1)
            low = near[np.arange(len(live)), k]
            go = low < _NONE
            if not go.all():
                out[live[~go]] = ids[~go]
                live, ids, near, k, low = live[go], ids[go], near[go], k[go], low[go]
                if not len(live):
                    break
            row = np.arange(len(live))
            past = np.minimum(columns + (columns > k[:, None]), wide - 1)
            ids, near = np.take_along_axis(ids, past, 1), np.take_along_axis(near, past, 1)
            ids[row, k] = self.made[low]
            near[row, k] = ranks(ids[row, k], ids[row, k + 1])
            inner = np.flatnonzero(k > 0)
            near[inner, k[inner] - 1] = ranks(ids[inner, k[inner] - 1], ids[inner, k[inner]])
        return out

    def merge_all(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of rows of ids (laid end to end, of the given sizes): the merged rows and their sizes."""
        starts = np.cumsum(sizes) - sizes
        got_sizes = np.zeros(len(sizes), dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows, their tokens laid end to end
        low = 0
        for wide in (4, 6, 8, 10, 12, 16, 24, 40, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= wide))
            low = wide
            for some in np.array_split(rows, max(1, len(rows) * wide // 400_000)):
                if not len(some):
                    continue
                x = np.full((len(some), wide + 1), -1, dtype=np.int32)
                x[np.repeat(np.arange(len(some)), sizes[some]), _runs(np.zeros(len(some), dtype=np.int64), sizes[some])] = flat[_runs(starts[some], sizes[some])]
                x = self._merge_even(x)
                got_sizes[some] = (x >= 0).sum(axis=1)
                held.append((some, x[x >= 0]))
        for row in np.flatnonzero(sizes > SHORT).tolist():
            one = np.array(self.merge(flat[starts[row] : starts[row] + sizes[row]].tolist()), dtype=np.int32)
            got_sizes[row] = len(one)
            held.append((np.array([row]), one))
        out = np.zeros(got_sizes.sum(), dtype=np.int32)
        begins = np.cumsum(got_sizes) - got_sizes
        for some, tokens in held:
            out[_runs(begins[some], got_sizes[some])] = tokens
        return out, got_sizes

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy longest match over each stretch of data: the token that begins at each byte, -1 where none does."""
        out = np.full(len(data), -1, dtype=np.int32)
        begin, at, end = starts.copy(), starts.copy(), ends
        node = np.zeros(len(begin), dtype=np.int64)
        best, best_end = np.full(len(begin), -1, dtype=np.int32), starts.copy()
        while len(begin):
            node = self.steps.get(node << 8 | data[at]).astype(np.int64)
            went = node >= 0
            at = at + went
            here = np.where(at == end, self.token_end[node], self.token_inside[node])
            better = went & (here >= 0)
            best, best_end = np.where(better, here, best), np.where(better, at, best_end)
            stop = ~went | (at == end)
            if stop.any():
                out[begin[stop]] = best[stop]
                begin, at, node = np.where(stop, best_end, begin), np.where(stop, best_end, at), np.where(stop, 0, node)
                left = begin < end
                begin, at, end, node, best, best_end = begin[left], at[left], end[left], node[left], best[left], best_end[left]
        return out

    def _fitting(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair is what merging gives; pairs not in the table are tested and added."""
        distinct, back = np.unique(codes, return_inverse=True)
        fits = self.pairs.get(distinct)
        new = np.flatnonzero(fits < 0)
        if len(new):
            left, right = distinct[new] >> 32, distinct[new] & self.ALONE
            alone = right == self.ALONE
            right = np.where(alone, 0, right)
            sizes = np.stack([self.part_size[left], np.where(alone, 0, self.part_size[right])], axis=1)
            flat = self.parts[_runs(np.stack([self.part_at[left], self.part_at[right]], axis=1).ravel(), sizes.ravel())]
            tokens, got = self.merge_all(flat, sizes.sum(axis=1))
            begins = np.cumsum(got) - got
            second = tokens[np.minimum(begins + 1, len(tokens) - 1)]
            fits[new] = (tokens[begins] == left) & np.where(alone, got == 1, (got == 2) & (second == right))
            if self.pairs.n + len(new) > PAIRS_HELD:
                none = np.zeros(0, dtype=np.int64)
                self.pairs = Lookup(none, none, max(PAIRS_HELD, len(new)))
            self.pairs.add(distinct[new], fits[new])
        return fits[back] > 0

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct pieces (bytes, not empty), laid end to end, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        short = sizes <= SHORT
        proposed = self.propose(data, starts[short], ends[short])
        place = np.flatnonzero(proposed >= 0)
        tokens = proposed[place].astype(np.int64)
        of = np.searchsorted(ends, place, side="right")
        counts = np.bincount(of, minlength=len(pieces))
        good = short.copy()
        if len(tokens):
            last = np.append(of[1:] != of[:-1], True)
            right = np.where(last, self.ALONE, np.append(tokens[1:], 0))
            tested = ~last | (counts[of] == 1)
            fits = np.ones(len(tokens), dtype=bool)
            fits[tested] = self._fitting(tokens[tested] << 32 | right[tested])
            good[of[~fits]] = False
        bad = np.flatnonzero(~good)
        self.merged += len(bad)
        single = self.inner[data]
        single[ends - 1] = self.final[data[ends - 1]]
        merged, merged_sizes = self.merge_all(single[_runs(starts[bad], sizes[bad])], sizes[bad])
        counts[bad] = merged_sizes
        out = np.zeros(counts.sum(), dtype=np.int32)
        begins = np.cumsum(counts) - counts
        fine = good[of]
        out[_runs(begins[good], counts[good])] = tokens[fine]
        out[_runs(begins[bad], counts[bad])] = merged
        return out, counts

    def _cut(self, words: list[str]) -> tuple[list[bytes | int], np.ndarray]:
        """The pieces of words, in order, and the word of each: bytes, or the id of a special token."""
        latin = [k for k, w in enumerate(words) if max(w) < "\xff" and "<|" not in w and "\xa0" not in w and "\x85" not in w]
        # Latin-1 needs no normalisation but lower case, and its classes are few: the library's own steps, faster.
        found: list = _LATIN.findall(" ".join([words[k] for k in latin]).lower())
        ends = np.cumsum(np.fromiter((len(words[k]) for k in latin), np.int64, len(latin)))
        upto = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        of = np.array(latin, dtype=np.int64)[np.searchsorted(ends, upto, side="left")] if found else np.zeros(0, dtype=np.int64)
        found = [p.encode() for p in found]
        others: list[int] = []
        for k in sorted({*range(len(words))}.difference(latin)):
            for part in self.at_special.split(words[k]) if "<|" in words[k] else (words[k],):
                if part in self.special:
                    new: list = [self.special[part]]
                else:
                    new = [p.translate(self.bytes_of).encode("latin-1") for p, _ in self.split(self.normalise(part))] if part else []
                found += new
                others += [k] * len(new)
        return found, np.append(of, np.array(others, dtype=np.int64))

    def encode_words(self, words: list[str]) -> list[tuple[int, str, str, bytes]]:
        """For each word (no spaces in it) the number of its ids, the ids as text, decoded, and as unsigned 32-bit integers."""
        found, of = self._cut(words)
        order = np.argsort(of, kind="stable")
        distinct = {p: k for k, p in enumerate(dict.fromkeys(found))}
        kinds = list(distinct)
        tokens, counts = self.encode_pieces([p for p in kinds if isinstance(p, bytes)])
        if any(isinstance(p, int) for p in kinds):  # special tokens: pieces of one id, put back between the others
            sizes = np.ones(len(kinds), dtype=np.int64)
            plain = np.array([isinstance(p, bytes) for p in kinds])
            sizes[plain] = counts
            flat = np.zeros(sizes.sum(), dtype=np.int32)
            begins = np.cumsum(sizes) - sizes
            flat[_runs(begins[plain], counts)] = tokens
            flat[begins[~plain]] = [p for p in kinds if isinstance(p, int)]
            tokens, counts = flat, sizes
        which = np.fromiter(map(distinct.__getitem__, found), np.int64, len(found))[order]
        begins = np.cumsum(counts) - counts
        flat = tokens[_runs(begins[which], counts[which])]
        ends = np.cumsum(np.bincount(of[order], weights=counts[which], minlength=len(words)).astype(np.int64)).tolist()
        listed, raw = flat.tolist(), flat.astype("<u4").tobytes()
        numerals = list(map(self.numerals.__getitem__, listed))
        names = list(map(self.names.__getitem__, listed))
        return [(b - a, " ".join(numerals[a:b]), " ".join(names[a:b]), raw[4 * a : 4 * b]) for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens' names, a space between."""
        return " ".join([self.names[i] for i in ids])

    def texts(self, texts: list[str]) -> Iterator[list[tuple]]:
        """For each text what `encode_words` gives for its words that have ids, in order."""
        for c in "\t\n\x0b\f\r":
            texts = [t.replace(c, " ") for t in texts]
        cut = [t.split(" ") for t in texts]
        distinct = set().union(*cut)
        distinct.discard("")
        young, old = self.young, self.old
        missing = [w for w in distinct if w not in young]
        young.update((w, old[w]) for w in missing if w in old)
        missing = [w for w in missing if w not in old]
        if missing:
            young.update(zip(missing, self.encode_words(missing)))
        young[""] = (0, "", "", b"")
        get = young.__getitem__
        for words in cut:
            yield [x for x in map(get, words) if x[0]]
        if len(young) > WORDS_HELD:
            self.young, self.old = {}, young if len(young) <= 2 * WORDS_HELD else {}


@cache
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def _batches(texts: pd.Series, most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in groups of so many characters, or one longer text."""
    held, size = [], 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def encode(docs: DataFrame, path: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with_ids adds ids (unsigned 32-bit, little-endian)."""
    name = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = vocabulary(SparkFiles.get(name))
        try:
            for series in batches:
                for group in _batches(series):
                    rows = []
                    for found in model.texts(group):
                        ids = " ".join([x[1] for x in found])
                        decoded = " ".join([x[2] for x in found])
                        row = (sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                        rows.append((*row, b"".join([x[3] for x in found])) if with_ids else row)
                    yield pd.DataFrame(rows, columns=names)
        finally:
            model.forget()
            let_go()

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(docs[doc_id].alias("doc_id"), F.pandas_udf(run, kinds)(docs[text]).alias("_e")).select("doc_id", "_e.*")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the decoded text of ids as `encode` gives them."""
    name = shipped(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        model = vocabulary(SparkFiles.get(name))
        return rows.map(lambda b: model.decode(np.frombuffer(b, dtype="<u4").tolist()), na_action="ignore")

    return encoded.select(encoded[doc_id].alias("doc_id"), run(encoded[ids]).alias("text"))
