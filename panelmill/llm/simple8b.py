"""Token ids in files of Simple-8b words.

A word of 64 bits has a 4-bit selector and as many equal-width values as fit into 60 bits; values of more than 60 bits
stand in an exception list that escape words point into. Ids are packed in blocks of `BLOCK`, each with its word
offset, so blocks pack and unpack side by side in numpy.

File: magic, words (little-endian unsigned 64 bit), exceptions, document table (id, number of ids), block table (first
word, number of ids), counts of the four parts and of documents without an id (they come first), magic. Ids of consecutive documents are contiguous.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices
from .encoder import encoder
from .files import Attempt, new_folder, resolve
from .registry import query, table

MAGIC = b"PMS8B\x00\x01\n"
BLOCK = 1024
#: Blocks that are packed or unpacked at a time.
GROUP = 512
# Values per word and their width, by selector; the last selector is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
ESCAPE = 14


_BITS16 = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int8)


def bit_length(v: np.ndarray) -> np.ndarray:
    if not v.size or v.max() < 1 << 16:
        return _BITS16.take(v.view(np.int64))
    out = np.zeros(v.shape, np.int8)
    for k in (48, 32, 16):
        big = v >= np.uint64(1) << np.uint64(k)
        if big.any():
            part = v[big]
            out[big] = np.maximum(out[big], k + _BITS16[np.minimum(part >> np.uint64(k), np.uint64(65535)).astype(np.int64)])
    low = out == 0
    out[low] = _BITS16[v[low].astype(np.int64)]
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, exceptions, and the number of words of each block of BLOCK values (the last may be shorter)."""
    n = len(values)
    lanes = -(-n // BLOCK)
    v = np.zeros((lanes, BLOCK + 64), np.uint64)
    full = np.zeros(lanes * BLOCK, np.uint64)
    full[:n] = values
    v[:, :BLOCK] = full.reshape(lanes, BLOCK)
    sizes = np.full(lanes, BLOCK)
    if n:
        sizes[-1] = n - (lanes - 1) * BLOCK
    bits = bit_length(v)
    choice = np.full((lanes, BLOCK), ESCAPE, np.int8)
    power, size, most = bits, 1, []  # largest width among the next 1, 2, 4, ... values
    while size <= COUNTS[0]:
        most.append(power)
        power, size = np.maximum(power[:, : power.shape[1] - size], power[:, size:]), 2 * size
    for s in range(ESCAPE - 1, -1, -1):  # wide first, so that the selector with most values stays
        n_s = int(COUNTS[s])
        k = n_s.bit_length() - 1
        widest = np.maximum(most[k][:, :BLOCK], most[k][:, n_s - (1 << k) : n_s - (1 << k) + BLOCK])
        np.copyto(choice, np.int8(s), where=widest <= np.int8(WIDTHS[s]))
    choice = choice.ravel()
    first = np.arange(lanes) * BLOCK
    at, stop = first, first + sizes
    begins = np.zeros(lanes * BLOCK, bool)  # values that begin a word; every block goes one word further at a time
    while len(at):
        begins[at] = True
        at = at + COUNTS.take(choice.take(at))
        more = at < stop
        if not more.all():
            at, stop = at[more], stop[more]
    at = np.flatnonzero(begins)
    s, lane = choice[at].astype(np.int64), at // BLOCK
    flat, at = v.ravel(), at + lane * (v.shape[1] - BLOCK)
    words = s.astype(np.uint64) << np.uint64(60)
    for k in range(ESCAPE):
        mine = np.flatnonzero(s == k)
        if len(mine):
            here, part = at[mine], words[mine]
            for j in range(int(COUNTS[k])):
                part |= flat.take(here + j) << np.uint64(j * WIDTHS[k])
            words[mine] = part
    odd = np.flatnonzero(s == ESCAPE)
    words[odd] |= np.arange(len(odd), dtype=np.uint64)
    return words, flat[at[odd]], np.bincount(lane, minlength=lanes)


def unpack(words: np.ndarray, exceptions: np.ndarray, block_words: np.ndarray, block_values: np.ndarray, first_exception: int = 0) -> np.ndarray:
    """Values of whole blocks; what pads a block's last word is dropped. Escapes count from `first_exception` on."""
    s = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    count = COUNTS[s]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    within = np.arange(total) - np.repeat(ends - count, count)
    width = np.repeat(WIDTHS[s], count)
    out = (np.repeat(payload, count) >> (within * width).astype(np.uint64)) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
    odd = np.flatnonzero(s == ESCAPE)
    if len(odd):
        out[ends[odd] - 1] = exceptions[payload[odd].astype(np.int64) + first_exception]
    stops = ends[np.cumsum(block_words) - 1] if len(block_words) else np.empty(0, np.int64)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    keep = np.repeat(starts - (np.cumsum(block_values) - block_values), block_values) + np.arange(int(block_values.sum()))
    return out[keep]


class Writer:
    """Streams documents' ids into one file; only one group of blocks and the tables are held."""

    def __init__(self, folder: str, name: str):
        self.file = Attempt(folder, name)
        self.file.write(MAGIC)
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.block_words: list[np.ndarray] = []
        self.block_values: list[np.ndarray] = []
        self.exceptions: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.total = 0
        self.no_id = 0

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, no_id: int = 0) -> None:
        self.no_id += no_id
        self.docs.append(doc_ids)
        self.counts.append(counts)
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= BLOCK * GROUP:
            self._pack(self.n_held // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        values = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        for at in range(0, n, BLOCK * GROUP):
            part = values[at : min(n, at + BLOCK * GROUP)]
            words, odd, per_block = pack(part)
            if len(odd):  # escapes count within the file
                escaped = np.flatnonzero(words >> np.uint64(60) == ESCAPE)
                words[escaped] += np.uint64(sum(map(len, self.exceptions)))
            self.exceptions.append(odd)
            self.file.write(words.astype("<u8").tobytes())
            self.block_words.append(per_block)
            self.block_values.append(np.minimum(BLOCK, len(part) - np.arange(len(per_block)) * BLOCK))
        self.held = [values[n:]]
        self.n_held = len(values) - n

    def close(self) -> None:
        self._pack(self.n_held)
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        odd, docs, counts = join(self.exceptions, "<u8"), join(self.docs, "<i8"), join(self.counts, "<i8")
        words, values = join(self.block_words, "<i8"), join(self.block_values, "<i8")
        for part in (odd, docs, counts, np.cumsum(words) - words, values, np.array([words.sum(), len(odd), len(docs), len(values), self.no_id], "<i8")):
            self.file.write(part.astype(part.dtype).tobytes())
        self.file.write(MAGIC)
        self.file.commit()


def read_file(uri: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Document ids (null where there is none), their numbers of ids, and these ids, for runs of whole documents."""
    where, path = resolve(uri)
    with where.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(48, size - 48)
        if f.read_at(8, 0) != MAGIC or tail[40:] != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        n_words, n_odd, n_docs, n_blocks, no_id = np.frombuffer(tail, "<i8", 5).tolist()
        at = 8 + 8 * n_words
        tables = np.frombuffer(f.read_at(8 * (n_odd + 2 * n_docs + 2 * n_blocks), at), "<i8")
        odd, docs, counts, first, values = np.split(tables, np.cumsum([n_odd, n_docs, n_docs, n_blocks]))
        per_block = np.diff(np.append(first, n_words))
        rest, done = np.empty(0, np.uint64), 0
        for b in range(0, max(1, n_blocks), GROUP):
            w = per_block[b : b + GROUP]
            words = np.frombuffer(f.read_at(8 * int(w.sum()), 8 + 8 * int(first[b])), "<u8") if n_blocks else np.empty(0, np.uint64)
            rest = np.concatenate([rest, unpack(words, odd.view(np.uint64), w, values[b : b + GROUP])])
            ends = np.cumsum(counts[done:])
            k = int(np.searchsorted(ends, len(rest), "right")) if b + GROUP < n_blocks else n_docs - done
            if k:
                n = int(ends[k - 1])
                yield pa.array(docs[done : done + k], mask=np.arange(done, done + k) < no_id), counts[done : done + k], rest[:n]
                rest, done = rest[n:], done + k


#: Text bytes that are encoded together: different words are looked up once a slice.
SLICE = 4 << 20
#: Words a worker remembers here, where every rare one costs a call of the tokenizer.
MEMO = 400_000


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, e, w = TaskContext.get().partitionId(), encoder(vocabulary, memo=MEMO), None
        for b in slices(batches, "text", SLICE):
            w = w or Writer(folder, f"part-{part:06d}.s8b")
            ids, counts = e.encode([x or "" for x in b.column(1).to_pylist()])
            out = np.full(len(ids) + len(counts), end_id, np.uint64)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(counts + 1) - 1] = False
            out[keep] = ids
            w.add(b.column(0).fill_null(0).to_numpy(), counts + 1, out, b.column(0).null_count)
        if w:
            w.close()
            yield pa.RecordBatch.from_arrays([pa.array([w.file.uri]), pa.array([part], pa.int64()), pa.array([w.total], pa.int64())], ["file", "part", "n_ids"])

    return run


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes them in ascending id order, one file a range of ids; returns file, part, n_ids.

    Null or empty texts have the end id alone. Null ids come first; rows
    that repeat an id are ordered by a hash of their text. Other columns are ignored; an empty table writes no file. A long
    text is encoded by itself, so a task holds one text's ids beside a group of blocks.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut_lineage(ordered.mapInArrow(_write(folder, vocabulary, end_id), "file string, part long, n_ids long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for docs, counts, ids in read_file(uri):
                raw = ids.astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[x - n : x]) for x, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )
                base += int(ends[-1])


def read_ids(files: DataFrame) -> DataFrame:
    """From write_ids' table: doc_id, start (ids of all documents before), n_tokens, ids_crc32, read from the files.

    The running total is over files, one row each.
    """
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    at = files.select("file", before.alias("base"))
    spread = at.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "file")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op10_simple8b_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_ids(table(spark, sf_dir, "documents"), new_folder(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(files)
