"""Removal of word windows that an earlier document already holds, by level-wise doubling.

A window is `window` consecutive words. Levels run from short to long (13, 25, 50 words): only where a window of one
length is found in two documents is the next, twice as long one looked at, until the last length is the window itself.

At a level each window that is still a candidate sends the smallest hash of the level's length inside it, so equal windows
send equal hashes and a long stretch sends few; at the last level it sends itself. Hashes are settled per slice (some
megabytes of text) before they travel, so a passage that a third of all documents share is one row a slice. The smallest and largest document of
every hash go back to the slices that sent it; windows whose hash stayed with one document are out, and documents without
a candidate leave the table of the next level. Whole equal documents are found at the first level, by one hash a document,
and all but the smallest leave there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import byte_column, mix, slices
from .registry import query, table


@dataclass(frozen=True)
class Params:
    window: int = 50
    base: int = 13  # the shortest level is at most this long
    slice_bytes: int = 2 << 20


LAST = 2**63 - 1
_rng = np.random.default_rng(12)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_STEPS = [int(x) | 5 for x in _rng.integers(2**62, 2**63, 3)]
_DOCUMENT = np.uint64(0x5851F42D4C957F2D)
_HASH_BYTES = 4 << 20


def levels(p: Params) -> list[int]:
    """Lengths from short to long; each is at most twice the one before."""
    out = [p.window]
    while out[0] > p.base:
        out.insert(0, -(-out[0] // 2))
    return out


def powers(step: int, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, a bounded number of bytes at a time."""
    size = end - begin
    out = np.empty(len(size), np.uint64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + _HASH_BYTES, "right")))
        n, first = size[at:stop], np.cumsum(size[at:stop]) - size[at:stop]
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        part = _BYTE[data[within + np.repeat(begin[at:stop], n)]] * powers(_STEPS[0], int(n.max()))[within]
        out[at:stop] = mix(np.add.reduceat(part, first) + n.astype(np.uint64))
        at = stop
    return out


def sliding(op: Callable, x: np.ndarray, w: int) -> np.ndarray:
    """op (minimum or maximum) over every w neighbours."""
    size = 1
    while 2 * size <= w:
        x, size = op(x[:-size], x[size:]), 2 * size
    return op(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


class Slice:
    """Words of a slice's documents, whose texts have one space between words, and which windows are candidates."""

    def __init__(self, texts, runs: list[bytes | None], p: Params):
        self.data, self.offsets = byte_column(texts)
        gap = self.data == 32
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        self.begin = np.flatnonzero(~gap & (edge[:-1] | np.append(True, gap[:-1])[: len(gap)]))
        self.end = np.flatnonzero(~gap & (edge[1:] | np.append(gap[1:], True)[: len(gap)])) + 1
        self.first = np.searchsorted(self.begin, self.offsets)  # of each document, its first word
        self.words = word_hashes(self.data, self.begin, self.end) if len(self.begin) else np.empty(0, np.uint64)
        self.p, n = p, len(self.begin)
        self.n_windows = max(0, n - p.window + 1)
        self.doc = np.repeat(np.arange(len(runs)), np.diff(self.first))
        self.open = np.zeros(self.n_windows + 1, np.int64)
        for k, r in enumerate(runs):  # None: every window
            a, z = int(self.first[k]), int(self.first[k + 1]) - p.window + 1
            if r is None and z > a:
                self.open[a] += 1
                self.open[z] -= 1
            elif r:
                pairs = np.frombuffer(r, np.int64).reshape(-1, 2) + a
                np.add.at(self.open, pairs[:, 0], 1)
                np.add.at(self.open, pairs[:, 1], -1)
        self.open = np.cumsum(self.open[:-1]) > 0

    def _grams(self, length: int, step: int) -> np.ndarray:
        n = len(self.words)
        up = powers(step, n)
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.words * up, dtype=np.uint64)])
        return mix((total[length:] - total[:-length]) * powers(pow(step, -1, 1 << 64), n)[: n - length + 1])

    def marks(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions that the candidates send at this level, their hash and a check value of 32 bits."""
        if not self.open.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.maximum(self._grams(length, _STEPS[1]), np.uint64(1))
        w = self.p.window - length + 1
        low = np.where(self.open, sliding(np.minimum, h, w), np.uint64(0))
        pad = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(sliding(np.maximum, np.concatenate([pad, low, pad]), w) == h)
        return at, h[at], (self._grams(length, _STEPS[2])[at] >> np.uint64(32)).astype(np.int64)

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a window or more, with hash and check value of all their words."""
        size = np.diff(self.first)
        docs = np.flatnonzero(size >= self.p.window)
        if not len(docs):
            return docs, np.empty(0, np.uint64), np.empty(0, np.int64)
        n = size[docs]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        words = self.words[np.repeat(size >= self.p.window, size)]
        out = [mix(np.add.reduceat(words * powers(step, int(n.max()))[within], first)) ^ _DOCUMENT for step in _STEPS[1:]]
        return docs, out[0], (out[1] >> np.uint64(32)).astype(np.int64)

    def narrow(self, at: np.ndarray, shared: np.ndarray, length: int) -> None:
        """Only windows with a shared hash of this level stay candidates."""
        if not self.n_windows:
            return
        seen = np.zeros(len(self.words) - length + 2, np.int64)
        seen[at[shared] + 1] = 1
        seen = np.cumsum(seen)
        w = self.p.window - length + 1
        self.open &= seen[w : w + self.n_windows] - seen[: self.n_windows] > 0

    def runs(self, k: int) -> bytes:
        """Candidate windows of a document as (first, end) pairs."""
        a, z = int(self.first[k]), int(self.first[k + 1])
        return _ranges(self.open[a : max(a, min(z, self.n_windows))]).tobytes()


def _ranges(flags: np.ndarray) -> np.ndarray:
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], 1).astype(np.int64)


def _prepare(p: Params):
    """Texts with one space between words, cut into slices; a longer text has a slice of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, "text", p.slice_bytes):
            words = [(x or "").encode().split() for x in b.column(1).to_pylist()]
            texts = [b" ".join(x) for x in words]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), b.column(0), pa.array([len(x) for x in words], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["slice", "row", "doc_id", "n_words", "sha256", "text"])
            number += 1

    return run


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A written table's batches, cut where the slice changes."""
    for b in batches:
        s = np.asarray(b.column(0))
        for a, z in zip(cuts := [0, *(np.flatnonzero(np.diff(s)) + 1).tolist()], [*cuts[1:], len(s)]):
            if z > a:
                yield b.slice(a, z - a)


def _send(length: int, first: bool, p: Params):
    """Rows (slice, hash, check, smallest and largest document), one for each hash of a slice's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_slice(batches):
            ids = np.asarray(b.column(1))
            s = Slice(b.column(2), [None] * len(ids) if first else b.column(3).to_pylist(), p)
            at, h, g = s.marks(length)
            doc = s.doc[at]
            if first:
                docs, wh, wg = s.whole()
                doc, h, g = np.concatenate([doc, docs]), np.concatenate([h, wh]), np.concatenate([g, wg])
            if not len(h):
                continue
            ids = ids[doc]
            order = np.lexsort((ids, g, h))
            h, g, ids = h[order], g[order], ids[order]
            begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            low, high = ids[begin], ids[np.append(begin[1:], len(ids)) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), b.column(0)[0].as_py()), pa.int64()), pa.array(h[begin].view(np.int64)), pa.array(g[begin]), pa.array(low), pa.array(high)],
                                             ["slice", "h", "g", "low", "high"])

    return run


def _found(h: np.ndarray, g: np.ndarray, answers: tuple[np.ndarray, ...]) -> np.ndarray:
    """Smallest document of each hash; LAST for those that one document has alone."""
    ah, ag, low = answers
    out = np.full(len(h), LAST)
    if len(ah) and len(h):
        at = np.searchsorted(ah, h)
        most = int(np.diff(np.flatnonzero(np.append(np.append(True, ah[1:] != ah[:-1]), True))).max())
        for k in range(most):  # hashes may agree where check values differ
            j = np.minimum(at + k, len(ah) - 1)
            hit = (ah[j] == h) & (ag[j] == g)
            out[hit] = low[j[hit]]
    return out


def _receive(length: int, first: bool, last: bool, p: Params):
    """A slice's documents and its answers -> the next level's documents, or after the last level the removals."""

    def run(docs: pa.Table, given: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(given.column("g")), np.asarray(given.column("h")).view(np.uint64)))
        answers = tuple(x[order] for x in (np.asarray(given.column("h")).view(np.uint64), np.asarray(given.column("g")), np.asarray(given.column("low"))))
        docs = docs.combine_chunks()
        ids, n, texts = np.asarray(docs.column("doc_id")), np.asarray(docs.column("n_words")), docs.column("text")
        runs = [None] * len(ids) if first else docs.column("runs").to_pylist()
        copy = np.zeros(len(ids), bool) if first else np.asarray(docs.column("copy"))
        s = Slice(texts, runs, p)
        at, h, g = s.marks(length)
        low = _found(h, g, answers)
        if first:
            which, wh, wg = s.whole()
            copy[which] = _found(wh, wg, answers) < ids[which]
            s.open &= ~copy[s.doc[: s.n_windows]]
        if not last:
            s.narrow(at, low < LAST, length)
            state = [s.runs(k) for k in range(len(ids))]
            keep = np.flatnonzero(copy | np.array([len(x) > 0 for x in state], bool))
            text = pa.array([None if copy[k] else texts[k].as_py() for k in keep.tolist()], pa.string())
            return pa.table([docs.column("slice").take(keep), docs.column("row").take(keep), pa.array(ids[keep]), pa.array(n[keep]), text, pa.array([state[k] for k in keep.tolist()], pa.binary()), pa.array(copy[keep])],
                            names=["slice", "row", "doc_id", "n_words", "text", "runs", "copy"])
        gone = np.zeros(len(s.words) + 1, np.int64)
        hit = at[low < ids[s.doc[at]]]
        gone[hit] += 1
        gone -= np.append(np.zeros(p.window, np.int64), gone)[: len(gone)]
        gone = np.cumsum(gone[:-1]) > 0
        spans, kept = [], []
        for k in range(len(ids)):
            a, z = int(s.first[k]), int(s.first[k + 1])
            spans.append([{"start": 0, "end": int(n[k])}] if copy[k] else [{"start": x, "end": y} for x, y in _ranges(gone[a:z]).tolist()])
            left = _ranges(~gone[a:z]) + a  # words of a run stand together, with one space between them
            kept.append(b" ".join(s.data[s.begin[x] : s.end[y - 1]].tobytes() for x, y in left.tolist()))
        changed = np.array([len(x) > 0 for x in spans], bool)
        t = pa.table([docs.column("slice"), docs.column("row"), pa.array([sum(y["end"] - y["start"] for y in x) for x in spans], pa.int64()),
                      pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=["slice", "row", "n_removed", "spans", "kept"])
        return t.filter(pa.array(changed))

    return run


NEXT = "slice long, row int, doc_id long, n_words long, text string, runs binary, copy boolean"
REMOVED = "slice long, row int, n_removed long, spans array<struct<start: long, end: long>>, kept string"


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word ranges, end exclusive), kept (words that stay, joined by one space)
    and kept_sha256: a row per input row.

    Null, empty and short texts lose nothing. A row without an id counts as the last document: it loses what any row
    with an id holds, and takes nothing from others. Rows that repeat an id don't cover each other. Other columns of
    the input, whatever their names, play no part. An empty table gives no rows. Long texts are taken whole.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    start = cut_lineage(d.mapInArrow(_prepare(p), "slice long, row int, doc_id long, n_words long, sha256 string, text string"))
    now = start.where(F.col("n_words") >= p.window).select("slice", "row", F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "n_words", "text")
    lengths = levels(p)
    for length in lengths:
        first, last = length == lengths[0], length == lengths[-1]
        sent = now.select("slice", "doc_id", "text", *([] if first else ["runs"])).mapInArrow(_send(length, first, p), "slice long, h long, g long, low long, high long")
        sent = sent.repartition("h", "g")  # one exchange feeds the totals and the join back
        shared = sent.groupBy("h", "g").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
        answers = sent.join(shared, ["h", "g"]).select("slice", "h", "g", F.col("least").alias("low"))
        got = now.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_receive(length, first, last, p), REMOVED if last else NEXT)
        now = got if last else cut_lineage(got)
    out = start.join(now, ["slice", "row"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start: long, end: long>>)")).alias("spans"), F.coalesce("kept", "text").alias("kept"),
        F.when(F.col("kept").isNull(), F.col("sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"))


def without_windows(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id and text after removal, for use as a cleaning step."""
    return repeated_windows(docs, p=p).select("doc_id", F.col("kept").alias("text"))


SQL = r"""
with w as (select row_number() over () as r, coalesce(doc_id, 9223372036854775807) as id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select r, id, unnest(range(1, len(w) + 1)) as s, unnest(w) as word, w from w),
x as (select r, id, s, word, case when s + 49 <= len(w) then sha256(array_to_string(w[s : s + 49], ' ')) end as h from p),
y as (select r, s, word, case when h is null then false else min(id) over (partition by h) < id end as hit from x),
z as (select r, s, word, coalesce(bool_or(hit) over (partition by r order by s rows between 49 preceding and current row), false) as gone from y),
k as (select r, sum(gone::int) as n_removed, string_agg(word, ' ' order by s) filter (where not gone) as kept from z group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (r)
"""


@query("op12_doubled_windows", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
