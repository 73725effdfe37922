"""Near-duplicate vectors by cross-polytope hashing.

Unit vectors are turned by random signs and fast Hadamard transforms; the hash is the signed axis nearest to the turned
vector. A table joins the hashes of several rotations. A vector goes to the bucket of its nearest axes and, for every
rotation, to the bucket with that one's second nearest axis (multiprobe).

Buckets hold ids and 128 signs of random projections, not vectors. Two vectors that meet and differ in few signs are a
candidate pair; a bucket gives the links of a spanning forest of them. Vectors then travel once, to the blocks of their
candidate class, where all pairs are verified by their cosine in double precision. No pair becomes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, mix
from .registry import query, table


@dataclass(frozen=True)
class Params:
    """Two hashes a table fit some 10^8 vectors of 64 components; one more is due for each further factor of 128.

    At a cosine of exactly 0.95 and 64 components, a pair shares no bucket with a chance of about 6e-6 and differs in
    more than `signs` of 128 signs with a chance of about 2e-6; both fall steeply above that cosine.
    """

    cosine: float = 0.95
    tables: int = 7
    hashes: int = 2  # per table
    signs: int = 30  # sign differences up to which a pair is a candidate
    block: int = 1024
    seed: int = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each column, in place; the column length is a power of two."""
    h = 1
    while h < len(x):
        pairs = x.reshape(-1, 2, h, x.shape[1])
        a, b = pairs[:, 0], pairs[:, 1]
        a += b
        b *= -2
        b += a
        h *= 2
    return x


@cache
def _turns(dim: int, p: Params) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(0, 2, (p.tables, p.hashes, 3, dim, 1)).astype(np.float32) * 2 - 1


@cache
def _planes(length: int, p: Params) -> np.ndarray:
    return np.random.default_rng(p.seed + 1).normal(size=(length, 128))


def axes(columns: np.ndarray, t: int, k: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest signed axis of each column under one rotation."""
    x = columns
    for s in _turns(len(columns), p)[t, k]:
        x = hadamard(x * s)
    x /= np.float32(len(x))
    size, each = np.abs(x), np.arange(x.shape[1])
    first = size.argmax(axis=0)
    size[first, each] = -1
    second = size.argmax(axis=0)
    return first * 2 + (x[first, each] < 0), second * 2 + (x[second, each] < 0)


def bucket_keys(unit: np.ndarray, p: Params) -> np.ndarray:
    """Per row the buckets it goes to: in each table its own, then one for each rotation's second axis."""
    dim = 1 << max(0, unit.shape[1] - 1).bit_length()
    columns = np.zeros((dim, len(unit)), np.float32)
    columns[: unit.shape[1]] = unit.T
    out = []
    for t in range(p.tables):
        near = [axes(columns, t, k, p) for k in range(p.hashes)]
        for probe in range(-1, p.hashes):
            key = np.full(len(unit), t + 1 + (unit.shape[1] << 16), np.uint64)  # lengths never meet
            for k, (first, second) in enumerate(near):
                key = key * np.uint64(0x9E3779B97F4A7C15) + (second if k == probe else first).astype(np.uint64) + np.uint64(1)
            out.append(mix(key).view(np.int64))
    return np.stack(out, 1)


def sign_words(unit: np.ndarray, p: Params) -> np.ndarray:
    """Two 64-bit words of signs a row."""
    return np.packbits(unit @ _planes(unit.shape[1], p) > 0, axis=1).view(np.int64)


def _units(column: pa.Array, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors (doubles) of the usable vectors among `keep`, by length and some hundred at a time."""
    if pa.types.is_null(column.type) or not len(column):
        return
    valid = np.asarray(column.is_valid()) & keep
    sizes = np.asarray(column.value_lengths().fill_null(0))
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column)].astype(np.int64)
    values = np.asarray(column.values.cast(pa.float64()).fill_null(float("nan")))
    for length in np.unique(sizes[valid & (sizes > 0)]).tolist():
        rows = np.flatnonzero(valid & (sizes == length))
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            m = values[starts[part][:, None] + np.arange(length)]
            top = np.abs(m).max(axis=1)
            good = np.isfinite(top) & (top > 0)  # a NaN makes the maximum NaN
            part, m = part[good], m[good] / top[good][:, None]  # no overflow in the norm
            if len(part):
                yield part, m / np.linalg.norm(m, axis=1, keepdims=True) + 0.0


def _digest(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and a 128-bit digest of the unit vector; nothing for unusable vectors."""
    for b in batches:
        ids = np.asarray(b.column(0))
        for rows, unit in _units(b.column(1), np.ones(b.num_rows, bool)):
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(list(map(_digest, unit)), pa.binary())], ["vec_id", "h"])


def _entries(p: Params):
    """A row for each bucket that a class's vector goes to; rows that hold another vector under the id are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wanted = np.asarray(b.column(0)), b.column(2).to_pylist()
            for rows, unit in _units(b.column(1), np.ones(b.num_rows, bool)):
                own = np.fromiter((_digest(u) == wanted[i] for i, u in zip(rows.tolist(), unit)), bool, len(rows))
                rows, unit = rows[own], unit[own]
                if len(rows):
                    keys, signs = bucket_keys(unit, p), sign_words(unit, p)
                    n = keys.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(x, n)) for x in (ids[rows], signs[:, 0], signs[:, 1]))], ["key", "vec_id", "s0", "s1"])

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per item the smallest item that the links reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _differ(s0: np.ndarray, s1: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count((s0[i] ^ s0[j]).view(np.uint64)) + np.bitwise_count((s1[i] ^ s1[j]).view(np.uint64))


def _stars(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link to the root of its class for every other member."""
    at = np.flatnonzero((root != np.arange(len(root))) & (ids != ids[root]))
    return ids[root[at]], ids[at]


def candidates(key: np.ndarray, ids: np.ndarray, s0: np.ndarray, s1: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the candidate pairs of whole buckets; rows are ordered by key, in runs of at most a block."""
    root, lag, i = np.arange(len(key)), 1, np.arange(len(key))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    while True:
        i = i[i + lag < len(key)]
        i = i[key[i] == key[i + lag]]
        if not len(i):
            break
        hit = i[_differ(s0, s1, i, i + lag) <= p.signs]
        if len(hit):
            found.append((hit, hit + lag))
            size += len(hit)
        if size > 1 << 20:  # fold what is found so far
            root = _labels(len(key), *(np.concatenate([own, *part]) for own, part in zip((root, np.arange(len(key))), zip(*found))))
            found, size = [], 0
        lag += 1
    if found:
        root = _labels(len(key), *(np.concatenate([own, *part]) for own, part in zip((root, np.arange(len(key))), zip(*found))))
    return _stars(ids, root)


def _meet(p: Params):
    """Buckets, in order of their keys: links of those within a block, the rows of larger ones with their block number."""
    names = ["a", "b", "key", "s0", "s1", "at"]

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, none], names)

    def large(rows: np.ndarray, first: int) -> pa.RecordBatch:
        key, ids, s0, s1 = map(np.ascontiguousarray, rows)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(key), pa.array(s0), pa.array(s1), pa.array((np.arange(len(ids)) + first) // p.block)], names)

    def closed(rows: np.ndarray, sent: int) -> Iterator[pa.RecordBatch]:
        """Whole buckets; the first `sent` rows of the first one have gone before."""
        if not rows.shape[1]:
            return
        start = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] ^ 1))
        size = np.diff(start, append=rows.shape[1])
        big = size > p.block
        big[0] |= sent > 0
        for s, n in zip(start[big].tolist(), size[big].tolist()):
            yield large(rows[:, s : s + n], sent if s == 0 else 0)
        small = np.repeat(~big, size)
        yield links(*candidates(*rows[:, small], p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, sent = np.empty((4, 0), np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([rest, np.stack([np.asarray(c) for c in b.columns])], axis=1)
            end = int(np.searchsorted(rows[0], rows[0, -1]))
            if end:
                yield from closed(rows[:, :end], sent)
                sent = 0
            rest = rows[:, end:]
            if rest.shape[1] > 8 * p.block:
                yield large(rest, sent)
                sent += rest.shape[1]
                rest = rest[:, :0]
        if rest.shape[1]:
            yield from closed(rest, sent)

    return run


def _meet_blocks(p: Params):
    """Two blocks of a large bucket, or one with itself."""

    def run(t: pa.Table) -> pa.Table:
        ids, s0, s1, at = (np.asarray(t.column(c)) for c in ("a", "s0", "s1", "at"))
        x = np.flatnonzero(at == at.min())
        y = np.flatnonzero(at == at.max())
        hit = _differ(s0, s1, x[:, None], y[None]) <= p.signs
        i, j = np.nonzero(hit)
        a, b = _stars(ids, _labels(len(ids), x[i], y[j]))
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _verify(p: Params):
    """Two blocks of a candidate class, or one with itself: links of each vector, and forest links."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, at, copies = (np.asarray(t.column(c)) for c in ("vec_id", "at", "copies"))
        wanted = t.column("h").to_pylist()
        rows, units, seen = [], [], set()
        for part, unit in _units(t.column("v").chunk(0) if t.num_rows else pa.array([]), np.ones(t.num_rows, bool)):
            for i, u in zip(part.tolist(), unit):
                if ids[i] not in seen and _digest(u) == wanted[i]:  # a row can stand twice in the input
                    seen.add(ids[i])
                    rows.append(i)
                    units.append(u)
        a, b, n = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(rows), np.int64)
        if rows:
            ids, at, copies = ids[rows], at[rows], copies[rows]
            for length in sorted({len(u) for u in units}):
                mine = np.array([i for i, u in enumerate(units) if len(u) == length])
                m, place = np.stack([units[i] for i in mine]), at[mine]
                x = np.flatnonzero(place == place.min())
                y = np.flatnonzero(place == place.max())
                if t.column("bi")[0].as_py() != t.column("bj")[0].as_py() and place.min() == place.max():
                    continue
                hit = m[x] @ m[y].T >= p.cosine
                hit &= ids[mine[x]][:, None] != ids[mine[y]][None]
                n[mine[x]] += hit @ copies[mine[y]]
                if place.min() != place.max():
                    n[mine[y]] += copies[mine[x]] @ hit
                i, j = np.nonzero(hit)
                more = _stars(ids[mine], _labels(len(mine), x[i], y[j]))
                a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
        hit = np.flatnonzero(n)
        k, none = len(hit), pa.nulls(len(hit), pa.int64())
        ids = ids[hit] if k else np.empty(0, np.int64)
        return pa.table([pa.concat_arrays([pa.array(ids), pa.array(a)]), pa.concat_arrays([none, pa.array(b)]), pa.concat_arrays([pa.array(n[hit]), pa.nulls(len(a), pa.int64())])], ["a", "b", "n"])

    return run


def _pairs_of_blocks(placed: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in."""
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return other.withColumns({"bi": F.least("at", "o"), "bj": F.greatest("at", "o")}).drop("o", "parts")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor do rows with a null
    id (component null, kept). Vectors of different length never link. Equal directions collapse to one class first:
    copies count as links of each other. Rows that repeat an id are one vector by its id: the first by digest counts.
    """
    kind = dict(vectors.dtypes)[vector_col]
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    usable = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    one = cut_lineage(usable.mapInArrow(_digests, "vec_id long, h binary").groupBy("vec_id").agg(F.min("h").alias("h")))
    kinds = cut_lineage(one.groupBy("h").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    entries = usable.join(kinds.select("vec_id", "h"), "vec_id").mapInArrow(_entries(p), "key long, vec_id long, s0 long, s1 long")
    met = cut_lineage(entries.repartition("key").sortWithinPartitions("key", "vec_id").mapInArrow(_meet(p), "a long, b long, key long, s0 long, s1 long, at long"))
    large = met.where(F.col("at").isNotNull()).drop("b")
    parts = large.groupBy("key").agg((F.max("at") + 1).alias("parts"))
    links = _pairs_of_blocks(large.join(parts, "key")).groupBy("key", "bi", "bj").applyInArrow(_meet_blocks(p), "a long, b long")
    near = components(met.where(F.col("b").isNotNull()).select("a", "b").unionByName(links))
    members = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct()).distinct()
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / p.block).alias("parts"))
    placed = members.join(sizes, "component").withColumn("at", F.expr("pmod(xxhash64(node), parts)")).join(kinds, F.col("node") == F.col("vec_id")).drop("node")
    blocks = _pairs_of_blocks(placed.join(usable, "vec_id"))
    found = cut_lineage(blocks.groupBy("component", "bi", "bj").applyInArrow(_verify(p), "a long, b long, n long"))
    return _result(v, one, kinds, found)


def _result(v: DataFrame, one: DataFrame, kinds: DataFrame, found: DataFrame) -> DataFrame:
    """Links and components of classes, given back to every vector of the class."""
    links = found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("more"))
    comp = components(found.where(F.col("b").isNotNull())).withColumnRenamed("node", "vec_id")
    classes = kinds.join(links, "vec_id", "left").join(comp, "vec_id", "left")
    classes = classes.select("h", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    by_vector = one.join(classes, "h").select("vec_id", "n_links", "component")
    out = v.select("vec_id").join(by_vector, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
u as (select vec_id, e from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
l as (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.95),
r(vec_id, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.vec_id where r.c < l.b),
n as (select a, count(*) as n from l group by 1)
select m.vec_id, coalesce(n.n, 0) as n_links, min(r.c) as component_id, m.vec_id = min(r.c) as kept
from embeddings m left join n on n.a = m.vec_id join r on r.vec_id = m.vec_id group by m.vec_id, n.n
"""


@query("op3_cross_polytope", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
