"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of word shingles. Equal sets collapse to one class first, so exact copies cost one row. Every class
has a MinHash signature; classes that agree on all rows of a band meet in a bucket. Inside a bucket pairs are compared
by batches of signature values: after each batch a pair is dropped when the posterior probability that its similarity
reaches the threshold falls under `miss` (uniform prior, so a Beta posterior). Survivors are verified on full sets.

No pair is ever a row. A bucket is cut into blocks of bounded size, by members and by bytes of their sets (a block pair is one task's work), a task returns
each member with the numbers of its surviving partners, and after verification at most one link per member: a
spanning forest of the true links of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WordHashes, components, mix, unused
from .registry import query, table


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 85  # 100 * intersection >= percent * union
    bands: int = 28
    rows: int = 6
    batch: int = 28  # signature values per Bayesian step
    miss: float = 1e-6  # posterior chance of dropping a pair that does reach the threshold
    block: int = 1024  # members of a bucket that meet in one task, squared
    block_shingles: int = 1 << 21  # shingles of those members together: sets of 16 MB, twice that in a task
    seed: int = 7


_hashes = WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence when shorter; empty without words."""
    w = text.encode().lower().split() if text else []  # exactly \x20 and \x09-\x0D separate; only A-Z change
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    n = len(w) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


@cache
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def signature(s: np.ndarray, p: Params) -> np.ndarray:
    a, b = _permutations(p.bands * p.rows, p.seed)
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, p: Params) -> np.ndarray:
    acc = np.arange(1, p.bands + 1, dtype=np.uint64)
    for column in sig.reshape(p.bands, p.rows).T:
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return acc.view(np.int64)


@cache
def least_matches(p: Params) -> tuple[int, ...]:
    """Per batch, the fewest matching values with P(similarity >= threshold | matches) >= miss.

    With a uniform prior and m of n matches the posterior is Beta(m+1, n-m+1); its upper tail at t is the chance
    that a Binomial(n+1, t) is at most m. Eight bits of each value are kept, so unequal values agree with chance
    1/256 and t moves up by that much.
    """
    t = p.percent / 100
    t += (1 - t) / 256
    out = []
    for n in range(p.batch, p.bands * p.rows + 1, p.batch):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= p.miss:
                out.append(m)
                break
    return tuple(out)


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Of the given pairs of signature rows, those never dropped by the posterior bound."""
    found = np.zeros(len(left), np.int32)
    for step, least in enumerate(least_matches(p)):
        part = sig[:, step * p.batch : (step + 1) * p.batch]
        found = found + (part[left] == part[right]).sum(axis=1, dtype=np.int32)
        keep = found >= least
        left, right, found = left[keep], right[keep], found[keep]
    return left, right


def _sketch(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, bands, sigs = [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), p.words)
                n.append(len(s))
                if len(s):
                    sig = signature(s, p)
                    cls.append(set_digest(s))
                    bands.append(band_keys(sig, p))
                    sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    cls.append(None)
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "cls", "bands", "sig"],
            )

    return run


def _compare(p: Params):
    """Members of one block pair -> each member with a surviving partner, and its partners' numbers in class order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        cls = t.column("cls").to_pylist()
        n = len(cls)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(n, -1)
        at, bi, bj = (np.asarray(t.column(c)) for c in ("at", "bi", "bj"))
        one = bi[0] == bj[0]
        ls, rs = [], []
        for i in range(n):  # a row against the later ones, so memory stays linear
            other = np.arange(i + 1, n) if one else np.flatnonzero(at[i + 1 :] != at[i]) + i + 1
            l, r = surviving_pairs(sig, np.full(len(other), i), other, p)
            ls.append(l)
            rs.append(r)
        l, r = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ls, rs))
        used = np.unique(np.concatenate([l, r])).astype(np.int64)
        number = np.zeros(n, np.int32)
        number[used] = np.arange(len(used), dtype=np.int32)
        starts = np.searchsorted(l, used), np.searchsorted(l, used, "right")
        partners = [number[r[a:b]].astype(np.int32).tobytes() for a, b in zip(*starts)]
        keys = [pa.array(np.full(len(used), np.asarray(t.column(c))[0]), pa.int64()) for c in ("key", "bi", "bj")] if n else []
        return pa.table([*keys, pa.array([cls[i] for i in used], pa.binary()), pa.array(partners, pa.binary())], ["key", "bi", "bj", "cls", "partners"])

    return run


def _verify(p: Params):
    """Exact test of the surviving partners; returns the links of a spanning forest by class representative."""

    def run(t: pa.Table) -> pa.Table:
        rows = {c: (r, q, s) for c, r, q, s in zip(*(t.column(k).to_pylist() for k in ("cls", "rep", "partners", "shingles")))}
        order = sorted(rows)
        sets = [np.frombuffer(rows[c][2], np.uint64) for c in order]
        reps = [rows[c][0] for c in order]
        root = list(range(len(order)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i, c in enumerate(order):
            for j in np.frombuffer(rows[c][1], np.int32).tolist():
                x, y = find(i), find(j)
                if x == y:
                    continue
                m, n = len(sets[i]), len(sets[j])
                if 100 * min(m, n) < p.percent * max(m, n):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= p.percent * (m + n - both):
                    root[max(x, y)] = min(x, y)
                    a.append(reps[i])
                    b.append(reps[j])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sets(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                got = [shingles(x.as_py(), p.words) for x in b.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], ["cls", "shingles"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Null, empty or word-free texts have an empty set, link with nothing and form their own component. A null id takes
    part in no link: its component is null and it is kept. Rows that repeat an id are judged by their own text. Equal
    sets always share a component. Other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = cut_lineage(d.mapInArrow(_sketch(p), "doc_id long, n_shingles long, cls binary, bands array<long>, sig binary"))
    usable = sketch.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut_lineage(usable.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("size")))
    banded = classes.select("cls", "size", F.explode("bands").alias("key"))
    # Buckets with the same members are compared once: the same pairs agree on many bands.
    buckets = (
        banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(cls))").alias("x"), F.expr("sum(pmod(xxhash64(cls, 1), 4294967296))").alias("y"), F.sum("size").alias("size"))
        .where("n > 1").groupBy("n", "x", "y", "size").agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.greatest(F.col("n") / p.block, F.col("size") / p.block_shingles)).alias("parts"))
    )
    members = banded.drop("size").join(buckets, "key").withColumn("at", F.expr("pmod(xxhash64(cls, 2), parts)"))
    blocks = (
        members.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("key", F.least("at", "o").alias("bi"), F.greatest("at", "o").alias("bj"), "at", "cls")
        .join(classes.select("cls", "sig"), "cls")
    )
    found = cut_lineage(blocks.groupBy("key", "bi", "bj").applyInArrow(_compare(p), "key long, bi long, bj long, cls binary, partners binary"))
    wanted = found.select("cls").distinct().join(classes.select("cls", "rep"), "cls")
    sets = d.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text").mapInArrow(_sets(p), "cls binary, shingles binary")
    links = (
        found.join(wanted, "cls").join(sets, "cls").select("key", "bi", "bj", "cls", "rep", "partners", "shingles")
        .groupBy("key", "bi", "bj").applyInArrow(_verify(p), "a long, b long")
    )
    comp = components(links)
    by_class = classes.select("cls", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that stay: the smallest id of each group, with every column they came with, whatever its name.

    Rows without an id stay. An id is judged as a whole: where rows repeat it, all stay if one of them is kept.
    """
    name = unused(docs, "_id")
    stays = near_duplicates(docs, p=p).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stays, docs["doc_id"] == stays[name], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when coalesce(len(w), 0) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
i as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on e.a = r.doc_id where r.c < e.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.c) as component_id, d.doc_id = min(r.c) as kept
from documents d left join n using (doc_id) join r on r.doc_id = d.doc_id group by d.doc_id, n.n
"""


@query("op1_minhash_bayes", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
