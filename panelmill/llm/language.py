"""Language identification with word-first backoff.

Known words are scored by their log frequency in each language. An unseen word is scored by its 4-character pieces
(with its ends marked), or 3, 2, 1 characters where no longer piece is known. Frequencies are counted over all training
rows and every (token, language) pair stays in the model, a table. Tasks hold the scores of the most frequent words and
pieces alone; the others meet the table in a join, so that what is held does not change a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import MEMO_ENTRIES
from .registry import query, table

_WORDS = re.compile(r"[^\W\d_]+")
_SUMS = pa.list_(pa.struct([("k", pa.int32()), ("v", pa.int64())]))
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    head: int = 100_000  # words whose scores every task holds at most, the most frequent; the others are joined
    pieces: int = 200_000  # the same for the pieces of one length
    longest: int = 4
    smoothing: float = 0.5


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty when the text has no letter."""
    w = _WORDS.findall(text.lower()) if text else []
    return w if any(c.isalpha() for x in w for c in x) else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    counts, size = {}, 0
    for b in batches:
        for text, lang in zip(b.column(0), b.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
        size = sum(map(len, counts.values()))
        if size > MEMO_ENTRIES:
            yield from out(counts)
            counts = {}
    yield from out(counts)


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", p: Params = Params()) -> DataFrame:
    """The model as a table: length (0 for words), token, lang, n, total (of the length and language), types.

    Rows with a null label are not used; null and letter-free texts add nothing.
    """
    r = rows.where(F.col(label_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    words = cut_lineage(r.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    marked = words.select("lang", "n", "word", F.explode(F.array(*map(F.lit, range(1, p.longest + 1)))).alias("length"))
    marked = marked.withColumn("m", F.when(F.col("length") > 1, F.concat(F.lit("<"), "word", F.lit(">"))).otherwise(F.col("word")))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("m") - (F.col("length") - 1), F.lit(1))))
    pieces = marked.select("length", "lang", "n", "m", at.alias("i")).groupBy("length", "lang", F.substring("m", F.col("i"), F.col("length")).alias("token")).agg(F.sum("n").alias("n"))
    pairs = words.select(F.lit(0).alias("length"), "lang", F.col("word").alias("token"), "n").unionByName(cut_lineage(pieces))
    totals = pairs.groupBy("length", "lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    return pairs.join(F.broadcast(cut_lineage(totals)), ["length", "lang"]).select("length", "token", "lang", "n", "total", "types")  # one row a length and language


#: Scores are whole multiples of 1 / SCALE: their sums do not depend on the order, so equal scores stay equal.
SCALE = 1 << 30


def _scores(model: DataFrame, langs: list[str], floors: dict[int, float], p: Params) -> DataFrame:
    """length, token, n (over all languages), scores (language number, log frequency above the floor of the length)."""
    floor = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in floors.items()))[F.col("length")]
    log = F.log((F.col("n") + p.smoothing) / (F.col("total") + F.col("types") * p.smoothing))
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    scored = model.select("length", "token", "n", F.struct(number.alias("k"), F.round((log - floor) * SCALE).cast("long").alias("v")).alias("s"))
    return scored.groupBy("length", "token").agg(F.sum("n").alias("n"), F.collect_list("s").alias("scores"))  # one entry a language


def _head(words: DataFrame, n_langs: int, most: int) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent words, at most `most` (all of equal frequency or none), and their scores."""
    # Frequencies with 10 leading bits: at most some 28,000 levels, whatever the corpus.
    level = F.expr("shiftleft(shiftright(n, int(greatest(0, floor(log2(n)) - 9))), int(greatest(0, floor(log2(n)) - 9)))")
    least, taken = None, 0
    for x, k in sorted(map(tuple, words.groupBy(level).count().collect()), reverse=True):
        if taken + k > most:
            break
        least, taken = x, taken + k
    if least is None:
        return {}, np.zeros((0, n_langs), np.int64)
    t = words.where(F.col("n") >= least).select("token", F.explode("scores").alias("s")).select("token", "s.k", "s.v").toArrow()
    number: dict[str, int] = {}
    at = [number.setdefault(x, len(number)) for x in t.column(0).to_pylist()]
    scores = np.zeros((len(number), n_langs), np.int64)
    scores[at, t.column(1).to_numpy()] = t.column(2).to_numpy()
    return number, scores


def _unseen_scores(words: DataFrame, tokens: DataFrame, n_langs: int, p: Params) -> DataFrame:
    """word, scores of the words with a known piece: the mean over the known ones among its pieces, longest length first.

    Pieces are several times a word's own size, so tasks look up the frequent ones where the word is; only the others travel.
    """
    out = []
    for k in range(p.longest, 0, -1):
        of_length = tokens.where(F.col("length") == k)
        held = _head(of_length, n_langs, p.pieces)
        shared = words.sparkSession.sparkContext.broadcast(held)

        def look_up(batches: Iterator[pa.RecordBatch], k=k, shared=shared) -> Iterator[pa.RecordBatch]:
            number, scores = shared.value
            scores = np.vstack([scores, np.zeros((1, n_langs), np.int64)])  # the last row is that of a piece that is not held
            for b in batches:
                sums, rest = [], []
                for word in b.column(0).to_pylist():
                    m = f"<{word}>" if k > 1 else word
                    found = [m[i : i + k] for i in range(max(1, len(m) - k + 1))]
                    at = [number.get(x, -1) for x in found]
                    n = len(at) - at.count(-1)
                    total = scores[at].sum(axis=0).tolist() if n else ()
                    # Number -1 counts the known pieces.
                    sums.append([{"k": -1, "v": n}, *({"k": i, "v": v} for i, v in enumerate(total) if v)] if n else [])
                    rest.append([x for x, i in zip(found, at) if i < 0])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, _SUMS), pa.array(rest, pa.list_(pa.string()))], ["word", "s", "rest"])

        looked = words.select("word").mapInArrow(look_up, "word string, s array<struct<k: int, v: long>>, rest array<string>")
        mean = F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x: F.struct(x["k"].alias("k"), F.round(x["v"] / F.col("s")[0]["v"]).cast("long").alias("v")))
        if len(held[0]) == of_length.count():  # a piece that is not held is unknown
            looked = cut_lineage(looked.drop("rest"))
            out.append(looked.where(F.size("s") > 0).select("word", mean.alias("scores")))
            words = looked.where(F.size("s") == 0).select("word")
            continue
        looked = cut_lineage(looked)
        known = looked.select("word", F.explode("rest").alias("token")).join(of_length, "token")
        each = known.select("word", F.explode(F.concat("scores", F.array(F.struct(F.lit(-1).alias("k"), F.lit(1).cast("long").alias("v"))))).alias("s"))
        each = each.unionByName(looked.select("word", F.explode("s").alias("s")))
        sums = each.groupBy("word", "s.k").agg(F.sum("s.v").alias("v")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s"))
        out.append(cut_lineage(sums.select("word", mean.alias("scores"))))
        if k > 1:
            words = cut_lineage(words.join(out[-1], "word", "left_anti"))
    return reduce(lambda a, b: a.unionByName(b), out)


def predict(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """doc_id, lang_pred, score (posterior under equal priors): one row per input row, from the text alone.

    `und` with score 0 where the text is null or has no letter, or where the model is empty. Ties go to the language
    that sorts first. Each row is scored by the words that tasks hold; its other words are joined with the table once each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = model.select("length", "lang", "total", "types").distinct().collect()
    langs = sorted({r["lang"] for r in stats})
    if not langs:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # One floor for all, or a language with few training words would profit from it.
    floors: dict[int, float] = {}
    for r in stats:
        floors[r["length"]] = min(floors.get(r["length"], 0.0), math.log(p.smoothing / (r["total"] + p.smoothing * r["types"])))
    tokens = cut_lineage(_scores(model, langs, floors, p))
    words = tokens.where("length = 0")
    shared = docs.sparkSession.sparkContext.broadcast(_head(words, len(langs), p.head))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, scores = shared.value
        for b in batches:
            n_words, sums, ends, rest, times = [], np.zeros((b.num_rows, len(langs)), np.int64), [0], [], []
            for i, x in enumerate(b.column(1)):
                found = words_of(x.as_py())
                at = list(map(number.get, found))
                sums[i] = scores[[k for k in at if k is not None]].sum(axis=0)
                others = Counter(w for w, k in zip(found, at) if k is None)
                n_words.append(len(found))
                rest += others.keys()
                times += others.values()
                ends.append(len(rest))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(langs), pa.int32()), pa.array(sums.ravel())),
                 pa.ListArray.from_arrays(ends, pa.array(rest, pa.string())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                ["doc_id", "n_words", "sums", "rest", "times"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).flatten().to_numpy().reshape(b.num_rows, len(langs)).copy()
            for i, added in enumerate(b.column(3).to_pylist()):
                for x in added or ():
                    total[i, x["k"]] += x["v"]
            best = total.argmax(axis=1)
            score = 1 / np.exp((total - total.max(axis=1, keepdims=True)) / SCALE).sum(axis=1)
            none = b.column(1).to_numpy() == 0
            names = [UNKNOWN if u else langs[i] for u, i in zip(none, best)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score))], ["doc_id", "lang_pred", "score"])

    parts = rows.mapInArrow(split, "doc_id long, n_words long, sums array<long>, rest array<string>, times array<long>")
    parts = cut_lineage(parts.withColumn("row", F.monotonically_increasing_id()))  # written once, so the numbers stay
    rest = parts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    known = words.select(F.col("token").alias("word"), "scores")
    unseen = cut_lineage(rest.select("word").distinct().join(known, "word", "left_anti"))
    met = rest.join(known.unionByName(_unseen_scores(unseen, tokens, len(langs), p)), "word").select("row", "times", F.explode("scores").alias("s"))
    added = met.groupBy("row", "s.k").agg(F.sum(F.col("s.v") * F.col("times")).alias("v")).groupBy("row").agg(F.collect_list(F.struct("k", "v")).alias("added"))
    whole = parts.join(added, "row", "left").select("doc_id", "n_words", "sums", "added")
    return whole.mapInArrow(decide, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """True for a quarter of the ids, by CRC-32 of their decimal text; a null id is not held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@query("op5_word_backoff")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
