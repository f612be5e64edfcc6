"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record frames one document: its length (8 bytes, little-endian), a masked checksum of those bytes (4), the payload, a
masked checksum of the payload (4). The payload is the document's number in id order (8), its id (8), a flag for a null
id (1) and its token ids (2 bytes each for vocabularies up to 65,536 ids, else 4). Checksums are CRC-32, masked by
rotation and a constant, so that a checksum stored among data isn't mistaken for one of its own. Each file has an index
beside it: (offset, length, tokens) of every record, so a reader can fetch any record alone.

Files hold ranges of ascending ids and are written by the tasks that hold the ranges, under a name of their own attempt,
and then renamed: a task that is run again replaces its file with an equal one. They go to a folder that all executors
share, through pyarrow's file systems, so the folder may be in any store that those reach.

Defined cases: a null or empty text has the end id alone; null ids come first in order; rows of equal id are in the order
of a hash of their texts; an empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, shared_folder, shipped
from .ordering import deal

MASK = 0xA282EAD8
#: Pieces whose ids a worker keeps at hand, and characters of such a piece at most; beyond, those stay that came again.
#: It bounds memory alone: others are encoded when they come.
PIECES_HELD, PIECE_CHARS = 500_000, 40
#: Bytes of text that are encoded together, or up to the end of one longer piece.
BLOCK_BYTES = 4 << 20
#: One piece of the file's splitter: Latin letters, digits or signs, and a space before them.
_PLAIN = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-/:-@\[-`{-~]+)")
#: Kinds of bytes: what is in plain pieces, line ends, spaces, first bytes of other characters that aren't white space.
_OTHER, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _LINE, _SPACE, _FIRST = range(8)


def _kind(byte: int) -> int:
    c = chr(byte)
    if byte >= 0xC3:  # U+00C0 on, up to U+023F letters but for two; three of the others may begin white space
        return _LETTER if byte <= 0xC8 else _OTHER if 0xE1 <= byte <= 0xE3 else _FIRST
    if byte >= 0x7F or byte < 0x20:
        return _LINE if c == "\n" else _OTHER
    return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else {" ": _SPACE, "'": _APOSTROPHE}.get(c, _SIGN)


def _rules(pair: int) -> int:
    """For two kinds in a row (8 * first + second), a bit for each cut: between them (1), before both (2), between them if
    there is one before both by the first rule (4)."""
    a, b = divmod(pair, 8)
    plain = (_LETTER, _DIGIT, _SIGN, _APOSTROPHE)
    signs = (_SIGN, _APOSTROPHE)
    between = a in plain and (b == _LINE or b in plain and a != b and not (a in signs and b in signs) and (a, b) != (_APOSTROPHE, _LETTER))
    return between | (a == _SPACE and b in (*plain, _FIRST)) << 1 | (a == _LINE and b in plain) << 2


_KINDS, _RULES = bytes(map(_kind, range(256))), bytes(_rules(p) if p < 64 else 0 for p in range(256))


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def read_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record; a wrong length or checksum is an error."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        (crc,) = struct.unpack_from("<I", data, at + 8)
        (size,) = struct.unpack("<Q", head)
        payload = data[at + 12 : at + 12 + size]
        if crc != masked_crc(head) or len(payload) != size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked_crc(payload):
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += 16 + size


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a text (its bytes) may be cut before each byte, so that both sides have the ids that they have together.

    The splitter of byte-level files never joins letters, digits, signs and line ends to each other, but for an apostrophe
    and letters after it, nor a space before something else than white space to what is before the space; and a single line
    end is a piece of its own. Bytes of other characters are cut nowhere but before such a space.
    """
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KINDS)), dtype=np.uint8)
    lead = np.flatnonzero(data >= 0xC3)
    kind[lead[lead >= len(data) - 2]] = _OTHER  # near the end bytes may be missing: no cut there
    lead = lead[lead < len(data) - 2]
    first, second, third = data[lead], data[lead + 1], data[lead + 2]
    latin = first <= 0xC8
    kind[lead[latin] + 1] = _LETTER
    signs = lead[(first == 0xC3) & ((second == 0x97) | (second == 0xB7))]
    kind[signs], kind[signs + 1] = _FIRST, _OTHER
    # White space there is U+1680, U+2000-200A, 2028, 2029, 202F, 205F and U+3000.
    dark = (first == 0xE1) & (second != 0x9A) | (first == 0xE3) & (second != 0x80)
    dark |= (first == 0xE2) & ((second > 0x81) | (second == 0x80) & (third >= 0x90) & (third < 0xA8))
    kind[lead[dark]] = _FIRST
    out = np.zeros(len(data), dtype=np.uint8)
    rules = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(_RULES), dtype=np.uint8)
    out[1:] = rules & 1
    out[:-1] |= rules >> 1 & 1
    out[2:] |= rules[1:] >> 2 & rules[:-1] & 1
    return out.view(bool)


class ByteTokens:
    """Ids of texts by a byte-level BPE file of the tokenizers library, as little-endian bytes.

    A text falls into pieces (see `cuts`) whose ids don't depend on their surroundings. Arrow numbers the distinct pieces of
    a block; those that are not at hand are encoded by the library: plain ones, which its splitter leaves whole, by its BPE
    model, given as the file spells bytes, others by all its steps. The ids of all pieces are then laid end to end at once.
    A text with one of the file's special tokens is one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65_536 else np.dtype("<u4")
        # Printable bytes are spelled as themselves, the others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelling = np.zeros(256, dtype="<u2")
        self.spelling[printable] = printable
        self.spelling[self.spelling == 0] = np.arange(256, 512 - len(printable))
        self._hold({}, np.zeros(0, dtype=np.int32), np.zeros(0, dtype=self.dtype), np.zeros(0, dtype=bool))

    def _hold(self, place: dict[str, int], counts: np.ndarray, ids: np.ndarray, again: np.ndarray) -> None:
        """Pieces at hand with their places; for each place how many ids it has and whether it came again; the ids, laid
        end to end."""
        if len(place) > PIECES_HELD:
            stay = again if again.sum() <= PIECES_HELD // 2 else np.zeros_like(again)
            number = (np.cumsum(stay) - 1).tolist()
            place = {p: number[k] for (p, k), s in zip(place.items(), stay.tolist()) if s}
            ids, counts, again = ids[np.repeat(stay, counts)], counts[stay], np.zeros(len(place), dtype=bool)
        self.place, self.counts, self.ids, self.again = place, counts, ids, again

    def _encoded(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """The ids of pieces, laid end to end, and how many each has."""
        plain = list(map(_PLAIN.fullmatch, pieces))
        lines = "\n".join([p for p, by_model in zip(pieces, plain) if by_model])
        spelled = iter(self.spelling[np.frombuffer(bytearray(lines.encode()), dtype=np.uint8)].tobytes().decode("utf-16-le").split(chr(self.spelling[10])))
        others = iter(self.tokenizer.encode_batch_fast([p for p, by_model in zip(pieces, plain) if not by_model], add_special_tokens=False))
        ids: list[int] = []
        counts: list[int] = []
        for by_model in plain:
            got = [t.id for t in self.model.tokenize(next(spelled))] if by_model else next(others).ids
            ids += got
            counts.append(len(got))
        return ids, counts

    def _block(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, laid end to end, and how many each has."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(self.place)
        found = list(map(self.place.get, distinct))
        missing = [p for p, k in zip(distinct, found) if k is None]
        short = [p for p in missing if len(p) <= PIECE_CHARS]
        if len(short) < len(missing):
            missing = short + [p for p in missing if len(p) > PIECE_CHARS]
        new = dict(zip(missing, range(known, known + len(missing))))
        places = np.array([new[p] if k is None else k for p, k in zip(distinct, found)], dtype=np.int32)
        new_ids, new_counts = self._encoded(missing)
        counts = np.concatenate([self.counts, np.array(new_counts, dtype=np.int32)])
        ids = np.concatenate([self.ids, np.array(new_ids, dtype=self.dtype)])
        which = coded.indices.to_numpy()
        starts, each = (np.cumsum(counts) - counts)[places], counts[places][which]
        ends = np.cumsum(each)
        got = np.repeat(starts[which] - (ends - each), each)
        got += np.arange(len(got))
        kept = known + len(short)
        again = np.append(self.again, np.zeros(len(short), dtype=bool))
        again[places[places < known]] = True
        self.place.update(zip(short, range(known, kept)))
        self._hold(self.place, counts[:kept], ids[: counts[:kept].sum()], again)
        return ids[got], each

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """The ids of each text (strings, no nulls) and the end id."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        special = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole = [(int(offsets[k]), int(offsets[k + 1])) for k in np.flatnonzero(special)]
        before = np.zeros(len(offsets), dtype=np.int64)  # ids before each text
        made: list[np.ndarray] = []
        at, last, total, size = int(offsets[0]), int(offsets[-1]), 0, BLOCK_BYTES
        while at < last:
            stop = min(at + size, last)
            cut = cuts(data[at:stop])
            for a, b in whole:
                cut[max(0, a - at) : max(0, b - at)] = False
            low, high = np.searchsorted(offsets, (at, stop))
            cut[offsets[low:high] - at] = True
            cut[0] = True
            pieces = np.flatnonzero(cut)
            if stop == last:
                pieces = np.append(pieces, stop - at)
            elif len(pieces) == 1:  # one piece fills the block
                size *= 2
                continue
            size = BLOCK_BYTES
            upto = int(pieces[-1])
            block = pa.StringArray.from_buffers(len(pieces) - 1, pa.py_buffer(pieces.astype(np.int32)), pa.py_buffer(data[at : at + upto]))
            ids, counts = self._block(block)
            high = np.searchsorted(offsets, at + upto)
            before[low:high] = total + (np.cumsum(counts) - counts)[np.searchsorted(pieces, offsets[low:high] - at)]
            made.append(ids)
            total += len(ids)
            at += upto
        before[np.searchsorted(offsets, last) :] = total
        ids = np.insert(np.concatenate([np.zeros(0, dtype=self.dtype), *made]), before[1:], end)
        ends = (before + np.arange(len(offsets))) * self.dtype.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


@cache
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def token_bytes(text: Column, path: str, end_id: int) -> Column:
    """The ids of a text (not null) and the end id, as little-endian integers of the width that the vocabulary needs.

    path: a name for SparkFiles.get.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = byte_tokens(SparkFiles.get(path))
        for texts in batches:
            yield coder.encode(texts, end_id).cast(pa.binary())

    return F.arrow_udf(run, "binary")(text)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


NO_ID = -(1 << 63)


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, ranges: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the records and indexes of docs to the folder; returns a row for each file: file, range, docs, tokens, width.

    Texts are encoded where they are read; only their ids go through the exchange.
    """
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    ids = token_bytes(F.col("text"), shipped(docs.sparkSession, tokenizer_path), end_id)
    dealt = deal(rows, "key", "text", {"key": F.col("key"), "ids": ids}, ranges)
    width = byte_tokens(tokenizer_path).dtype.itemsize
    made = ["file", "range", "docs", "tokens", "width"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _open(folder)
        batch = next(batches, None)
        while batch is not None and not len(batch):
            batch = next(batches, None)
        if batch is None:
            return
        number = int(batch["_range"].iloc[0])  # a task has one range
        name = f"{top}/part-{number:06d}.rec"
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        index, count, tokens, at = [], 0, 0, 0
        with store.open_output_stream(temporary) as out:
            while batch is not None:
                for k, ids in zip(batch["key"].tolist(), batch["ids"]):
                    n = len(ids) // width
                    record = frame(struct.pack("<Qq?", count, k, k == NO_ID) + ids)
                    out.write(record)
                    index.append((at, len(record), n))
                    count, tokens, at = count + 1, tokens + n, at + len(record)
                batch = next(batches, None)
        with store.open_output_stream(f"{temporary}.index") as f:
            f.write(np.asarray(index, dtype="<u8").tobytes())
        for suffix in (".index", ""):
            store.move(temporary + suffix, name + suffix)
        yield pd.DataFrame([(name.rpartition("/")[2], number, count, tokens, width)], columns=made)

    store, top = _open(folder)
    store.create_dir(top, recursive=True)
    return dealt.select("_range", "key", "ids").mapInPandas(run, "file string, range int, docs long, tokens long, width int")


def clear(folder: str) -> None:
    """Removes what failed attempts left in a folder of records that is written."""
    store, top = _open(folder)
    for found in store.get_file_info(fs.FileSelector(top)):
        if ".tmp" in found.base_name:
            store.delete_file(found.path)


#: Bytes that a reader holds at once, or one longer record.
READ_BYTES = 8 << 20


def read(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as unsigned 32-bit integers) of every record of the files.

    files: what `write` returned. Records are checked against their checksums and the index.
    """
    before = files.select("file", "width", (F.sum("tokens").over(Window.orderBy("range")) - F.col("tokens")).alias("before"))  # a row for each file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _open(folder)
        for batch in batches:
            for name, start, width in zip(batch["file"], batch["before"], batch["width"]):
                with store.open_input_file(f"{top}/{name}.index") as f:
                    index = np.frombuffer(f.readall(), dtype="<u8").reshape(-1, 3)
                with store.open_input_file(f"{top}/{name}") as f:
                    first = 0
                    while first < len(index):
                        last = first + 1
                        while last < len(index) and index[last, 0] + index[last, 1] - index[first, 0] <= READ_BYTES:
                            last += 1
                        data = f.read_at(int(index[last - 1, 0] + index[last - 1, 1] - index[first, 0]), int(index[first, 0]))
                        out = []
                        for (offset, payload), (at, _, n) in zip(read_frames(data), index[first:last]):
                            if offset + index[first, 0] != at:
                                raise ValueError("the index doesn't fit its file")
                            _, k, null = struct.unpack_from("<Qq?", payload)
                            ids = np.frombuffer(payload, dtype=f"<u{width}", offset=17)
                            if len(ids) != n:
                                raise ValueError("the index doesn't fit its file")
                            out.append((None if null else k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        made = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        made["doc_id"] = pd.array([r[0] for r in out], dtype="Int64")
                        yield made
                        first = last

    return before.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_one(folder: str, file: str, record: int, width: int = 2) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one record, by the index: what a shuffled reader does."""
    store, top = _open(folder)
    with store.open_input_file(f"{top}/{file}.index") as f:
        offset, size, _ = np.frombuffer(f.read_at(24, 24 * record), dtype="<u8").tolist()
    with store.open_input_file(f"{top}/{file}") as f:
        _, payload = next(read_frames(f.read_at(size, offset)))
    _, k, null = struct.unpack_from("<Qq?", payload)
    return (None if null else k), np.frombuffer(payload, dtype=f"<u{width}", offset=17)


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None, ranges: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to a new folder under the shared one and reads the records back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    files = settle(write(docs, tokenizer_path, folder, ranges=ranges, doc_id=doc_id, text=text))
    clear(folder)
    return read(spark, files, folder)
