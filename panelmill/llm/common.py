"""Pieces that several operators share: Arrow columns, word hashes, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Text bytes that one vectorised step takes at a time.
SLICE_BYTES = 4 << 20
#: Entries after which a worker's memo of hashes or encodings starts afresh.
MEMO_ENTRIES = 400_000


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores put before it until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_column(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps, and the offsets of its rows; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    a = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    if not len(a):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text has a batch of its own."""
    for b in batches:
        _, offsets = byte_column(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


class WordHashes(dict):
    """64-bit hashes of words, computed once per word and worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, component (the smallest node reachable) for every node of the links, by alternating stars.

    A round joins every node's larger neighbours to its smallest one, then its smaller ones; each is a map-side
    combined minimum joined back by the node, so a centre with many neighbours can be split by the adaptive join.
    Rounds are written to the shared folder; the driver sees one checksum a round. Null ends are no link.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct()
    e = cut_lineage(e)
    before = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("pmod(xxhash64(v, u), 1000003)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.where("u > v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
