"""Phrase collocations, counted in counting quotient filters.

Phrases of n words are counted after phrases of n - 1 words: only where both parts of n - 1 words are frequent can the
phrase be, so nothing is lost. Frequent words and phrases of a language have ids of 32 bits, and a phrase is packed
into 64 bits as (id of all words but the last, id of the last word). An invertible permutation of these bits gives a
shard (first bits), a quotient and a remainder. A filter keeps the quotients as one bit string, the whole remainders
and small counters with escapes, so packed phrases and counts are read back without loss.

Every slice of the corpus makes one filter for each shard. Filters of a shard are merged as sorted lists; the frequent
phrases go through the inverse permutation into the phrase table, and each slice gets the ids of those it holds back.
What travels of the text are word numbers, not words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import mix, slices
from .registry import query, table


@dataclass(frozen=True)
class Params:
    words: int = 4  # longest phrase
    least: int = 30  # occurrences of a phrase
    inside: int = 80  # percent of a phrase's occurrences inside a longer candidate from which it is dropped
    top: int = 2000  # the report's rows per language
    slice_bytes: int = 8 << 20
    shard_bytes: int = 16 << 20  # filter bytes under one shard


_BREAK = b"\xff"  # in no UTF-8 text
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
_M1, _M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53  # the factors of mix
_I1, _I2 = np.uint64(pow(_M1, -1, 1 << 64)), np.uint64(pow(_M2, -1, 1 << 64))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> np.uint64(32))
    x = x * _I2
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x = x * _I1
    return x ^ (x >> np.uint64(33))


def pack(keys: np.ndarray, counts: np.ndarray, shard_bits: int) -> bytes:
    """A filter of sorted, permuted keys of one shard.

    There are as many quotients as keys, rounded up to a power of two. Runs are written in unary: a one for each key of
    a quotient, then a zero. Remainders are whole bytes; counters have one byte, and those of 255 or more an entry apart.
    """
    m = len(keys)
    q = max(0, int(m - 1).bit_length()) if m else 0
    rest_bits = 64 - shard_bits - q
    body = keys & np.uint64((1 << (64 - shard_bits)) - 1)
    unary = np.zeros(m + (1 << q), bool)
    unary[(body >> np.uint64(rest_bits) if rest_bits < 64 else np.zeros(m, np.uint64)).astype(np.int64) + np.arange(m)] = True
    rest = (body & np.uint64((1 << rest_bits) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-rest_bits // 8)]
    shard = int(keys[0] >> np.uint64(64 - shard_bits)) if shard_bits and m else 0
    large = counts[counts >= 255].astype("<u8")
    return pickle.dumps((shard, m, q, np.packbits(unary).tobytes(), np.ascontiguousarray(rest).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.tobytes()), 5)


def unpack(blob: bytes, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    shard, m, q, unary, rest, small, large = pickle.loads(blob)
    rest_bits = 64 - shard_bits - q
    width = -(-rest_bits // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8), count=m + (1 << q)))
    wide = np.zeros((m, 8), np.uint8)
    wide[:, :width] = np.frombuffer(rest, np.uint8).reshape(m, width)
    keys = wide.view("<u8").ravel()
    if rest_bits < 64:
        keys = keys | (ones - np.arange(m)).astype(np.uint64) << np.uint64(rest_bits)
    if shard_bits:
        keys = keys | np.uint64(shard) << np.uint64(64 - shard_bits)
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, "<u8").astype(np.int64)
    return keys, counts


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of keys into one, counts of equal keys added up."""
    keys, counts = np.concatenate([k for k, _ in filters]), np.concatenate([c for _, c in filters])
    order = np.argsort(keys, kind="stable")  # merges runs that are sorted already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _squeeze(*arrays) -> bytes:
    return zstandard.ZstdCompressor(1).compress(pickle.dumps(arrays, 5))


def _open(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _tokens(p: Params):
    """Per slice and language the distinct words, their counts, and the text as word numbers (0 between pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, "text", p.slice_bytes):
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of.setdefault(lang, []).append((text or "").encode())
            for lang, texts in of.items():
                known = _Numbers({_BREAK: 0})
                words = _BREAK.join(texts).lower().translate(_ENDS).replace(_BREAK, b" \xff ").split()  # only space and tab are left as white space
                ids = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                vocabulary = pa.array(list(known)[1:], pa.binary()).cast(pa.string())
                counts = np.bincount(ids, minlength=len(known))[1:]
                ends = pa.array([0, len(vocabulary)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.ListArray.from_arrays(ends, vocabulary), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())), pa.array([_squeeze(ids)], pa.binary())],
                    ["slice", "lang", "words", "counts", "tokens"])
                number += 1

    return run


def _number_words(docs: pa.Table, given: pa.Table) -> pa.Table:
    """Word numbers of a slice become ids of frequent words; 0 for all else."""
    docs = docs.combine_chunks()
    (tokens,) = _open(docs.column("tokens")[0].as_py())
    ids = np.zeros(docs.column("n_words")[0].as_py() + 1, np.uint32)
    ids[np.asarray(given.column("at")) + 1] = np.asarray(given.column("id"))
    ids = ids[tokens]
    return pa.table([docs.column("slice"), pa.array([_squeeze(ids, ids)], pa.binary())], names=["slice", "state"])


def _filters(n: int, shard_bits: int):
    """Filters of a slice's phrases of n words, one for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                word, before = _open(blob)
                keys, counts = np.unique(mix(_keys(word, before, n)[1]), return_counts=True)
                cuts = np.searchsorted(keys, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)).tolist() if shard_bits else [0]
                rows = [(k, pack(keys[a:z], counts[a:z], shard_bits)) for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(keys)])) if z > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "shard", "filter"])

    return run


def _keys(word: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of phrases of n words whose parts of n - 1 words are frequent, and the packed phrases."""
    m = max(0, len(word) - n + 1)
    at = np.flatnonzero((before[:m] > 0) & (before[1 : m + 1] > 0))
    return at, before[at].astype(np.uint64) << np.uint64(32) | word[at + n - 1].astype(np.uint64)


def _merge_shard(shard_bits: int, p: Params):
    """All filters of a shard -> rows of frequent phrases, and for each slice its frequent keys with their ids."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        blobs = t.column("filter").to_pylist()
        parts = [unpack(x, shard_bits) for x in blobs]
        keys, counts = merge(parts)
        keep = counts >= p.least
        keys, counts = keys[keep], counts[keep]
        ids = (np.arange(1, len(keys) + 1) << shard_bits) + shard
        if len(ids) and ids[-1] >= 1 << 32:
            raise ValueError("more frequent phrases than 32-bit ids")
        slices_, answers = [], []
        for s, (mine, _) in zip(t.column("slice").to_pylist(), parts):
            if len(keys):
                j = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                hit = keys[j] == mine
                if hit.any():
                    slices_.append(s)
                    answers.append(_squeeze(mine[hit], ids[j[hit]].astype(np.uint32)))
        plain = unmix(keys)
        n, k = len(answers), len(keys)
        none = pa.nulls(n, pa.int64())
        columns = [pa.chunked_array([pa.array(slices_, pa.int64()), pa.nulls(k, pa.int64())]), pa.chunked_array([pa.array(answers, pa.binary()), pa.nulls(k, pa.binary())])]
        for x in (plain >> np.uint64(32), plain & np.uint64(0xFFFFFFFF), counts, ids):
            columns.append(pa.chunked_array([none, pa.array(x.astype(np.int64))]))
        return pa.table(columns, names=["slice", "answer", "first", "last", "f", "id"])

    return run


def _number_phrases(n: int):
    def run(docs: pa.Table, given: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        word, before = _open(docs.column("state")[0].as_py())
        at, keys = _keys(word, before, n)
        out = np.zeros(len(word), np.uint32)
        if given.num_rows and len(at):
            parts = [_open(x) for x in given.column("answer").to_pylist()]
            known, ids = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(known, kind="stable")
            known, ids, keys = known[order], ids[order], mix(keys)
            j = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            out[at] = np.where(known[j] == keys, ids[j], 0)
        if not out.any():
            return docs.select(["slice", "state"]).slice(0, 0)
        return pa.table([docs.column("slice"), pa.array([_squeeze(word, out)], pa.binary())], names=["slice", "state"])

    return run


def _id_space(words: DataFrame, bits: int) -> DataFrame:
    """Ids from 1 on, numbered within buckets of equal low bits."""
    bucket = F.pmod(F.xxhash64("lang", "phrase"), F.lit(1 << bits))
    row = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "phrase"))
    return words.withColumn("bucket", bucket).withColumn("id", row * (1 << bits) + F.col("bucket")).drop("bucket")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, n_words, phrase, f) of all phrases of one to p.words words that occur p.least times in a language,
    and (lang, n) with all word occurrences.

    A-Z become lower case; pieces end at `. , ; : ! ?` and line breaks, words at spaces and tabs. A null language is
    `und`, null and empty texts have no words, repeated rows count each time, other columns play no part. An empty
    table gives two empty tables. Texts are taken whole.
    """
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    start = cut_lineage(d.mapInArrow(_tokens(p), "slice long, lang string, words array<string>, counts array<long>, tokens binary"))
    per_slice = start.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("slice", "lang", "at", F.col("w.words").alias("phrase"), F.col("w.counts").alias("f"))
    totals = start.select("lang", F.explode("counts").alias("f")).groupBy("lang").agg(F.sum("f").alias("n"))
    words = per_slice.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= p.least)
    words = cut_lineage(words)
    size = start.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    words = cut_lineage(_id_space(words, max(0, (words.count() >> 16).bit_length())))
    if (words.agg(F.max("id")).first()[0] or 0) >= 1 << 32:
        raise ValueError("more frequent words than 32-bit ids")
    ids = per_slice.join(words.drop("f"), ["lang", "phrase"]).select(F.col("slice").alias("slice"), "at", F.col("id").cast("long").alias("id"))
    held = start.select("slice", "tokens", F.size("words").alias("n_words"))
    now = cut_lineage(held.groupBy("slice").cogroup(ids.groupBy("slice")).applyInArrow(_number_words, "slice long, state binary"))
    phrases = [words.select("id", "lang", "phrase", "f")]
    shard_bits = max(0, (8 * size // p.shard_bytes).bit_length())  # a filter entry has some five times a packed word's bytes
    for n in range(2, p.words + 1):
        found = now.mapInArrow(_filters(n, shard_bits), "slice long, shard long, filter binary").groupBy("shard").applyInArrow(_merge_shard(shard_bits, p), "slice long, answer binary, first long, last long, f long, id long")
        found = cut_lineage(found)
        rows = found.where(F.col("slice").isNull()).select("id", "first", "last", "f")
        word = phrases[0].select(F.col("id").alias("last"), F.col("phrase").alias("word"))
        before = phrases[-1].select(F.col("id").alias("first"), "lang", "phrase")
        phrases.append(cut_lineage(rows.join(before, "first").join(word, "last").select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "f")))
        if n < p.words:
            answers = found.where(F.col("slice").isNotNull()).select("slice", "answer")
            now = cut_lineage(now.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_number_phrases(n), "slice long, state binary"))
    out = None
    for n, x in enumerate(phrases, 1):
        x = x.select("lang", F.lit(n).alias("n_words"), "phrase", "f")
        out = x if out is None else out.unionByName(x)
    return out, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first p.top phrases of each language.

    A phrase's score is that of its worst cut: floor(2000000 * a / (l + r)), ties to the shortest first part. Phrases
    that stand inside a longer candidate in p.inside percent of their occurrences or more are left out. Ties in score
    go by a, then by the phrase's bytes.
    """
    every, totals = frequent_phrases(docs, lang_col, text_col, p)
    candidates = every.where("n_words >= 2").withColumnRenamed("f", "a")
    part = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", "n_words", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(part, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(part, F.col("k") + 1, F.col("n_words") - F.col("k")), " ")})
    known = every.select("lang", "phrase", "f")
    cuts = cuts.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div cast(l + r as decimal(20,0))")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
    inner = candidates.where("n_words >= 3").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = worst.join(longer, ["lang", "phrase"], "left").where(F.expr(f"around is null or cast(around as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {p.inside}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase"))
    best = left.withColumn("rank", rank).where(F.col("rank") <= p.top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").cast("long").alias("score"))


SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from w, (values (1), (2), (3), (4)) as t(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all),
c as (select lang, k, phrase, f, string_split(phrase, ' ') as w from f where f >= 30),
cuts as (select lang, k, phrase, f, w, unnest(range(1, k)) as cut from c where k > 1),
s as (select cuts.lang, cuts.k, cuts.phrase, cuts.f as a, cut, x.f as l, y.f as r, ((2000000::hugeint * cuts.f) // (x.f::hugeint + y.f)) as score
  from cuts join c x on x.lang = cuts.lang and x.phrase = array_to_string(cuts.w[1 : cut], ' ') join c y on y.lang = cuts.lang and y.phrase = array_to_string(cuts.w[cut + 1 :], ' ')),
b as (select lang, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
i as (select lang, f, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')] || case when k = 4 then [array_to_string(w[3 : 4], ' '), array_to_string(w[1 : 3], ' '), array_to_string(w[2 : 4], ' ')] else [] end) as phrase from c where k > 2),
m as (select lang, phrase, max(f) as around from i group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
o as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank from b left join m on m.lang = b.lang and m.phrase = b.phrase where around is null or 100 * around::hugeint < 80 * a::hugeint)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from o join n using (lang) where rank <= 2000
"""


@query("op13_quotient_phrases", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
