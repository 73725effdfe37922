"""Pipeline stages on tables whose other columns have the names of inner ones, and with nulls and repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelmill.llm import simple8b, suffix
from panelmill.llm.encoder import Encoder
from panelmill.llm.files import new_folder
from tests.llm.test_operators import DOCS, ROWS, VOCABULARY
from tokenizers import Tokenizer

NAMES = ["_w", "_q", "_id", "_n", "_k", "__id", "place", "copies", "rest", "kept", "cls", "n_shingles", "mark", "a.b"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_other_columns_come_back(spark, stage):
    d = spark.createDataFrame(ROWS, DOCS).repartition(2)
    fn = dict(corpus_pipeline.STAGES)[stage]
    plain = fn(spark, d, "")
    full = fn(spark, d.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in NAMES}), "")
    assert full.columns == [*d.columns, *NAMES]
    rows = full.collect()
    assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in NAMES)
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(str(tuple(r)) for r in plain.collect())
    assert fn(spark, d.limit(0), "").count() == 0


def test_a_sentence_of_all_documents_is_spread_over_buckets(spark):
    opening = "Every one of these documents begins with this same long opening sentence, word by word. "
    rows = [(k, opening + f"unlike {k} others {k * k} " * 5) for k in range(400)]
    p = suffix.Params(slice_bytes=3000)
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    anchors = d.mapInArrow(suffix._anchors(64, p), "bucket long, local boolean, anchors binary").where("local").groupBy("bucket").count()
    assert anchors.count() > 20 and anchors.agg(F.max("count")).first()[0] < 10
    got = suffix.repeated_passages(d, p=p).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, suffix.brute_force(rows, 50)))


def test_smallest_id_and_no_id_are_told_apart(spark):
    d = spark.createDataFrame([(None, "one"), (-(2**63), "two words"), (0, ""), (None, None)], "doc_id long, text string")
    got = simple8b.read_ids(simple8b.write_ids(d, new_folder(spark, "test-ids"), VOCABULARY)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(2**63), 0]


def test_new_words_by_the_model_alone():
    t, e = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY, memo=50)
    words = ["Hello", "été,", "naïve...", "ſtrange", "ǅ", "don't", "x.,", "ªº", "漢字", "a1", "b_c", "ÀÖØöøɏ", "<|endoftext|>", "***", "ß.", "İstanbul", "ŉ"]
    rng = np.random.default_rng(4)
    texts = ["", " ", "\n", "one", "\none", "a\n\nb", " lead", "tail ", "tab\tin"]
    texts += [rng.choice(["", "\n", " "]) + "".join(w + s for w, s in zip(rng.choice(words, 30), rng.choice([" ", " ", " ", "\n"], 30))).rstrip(" ") for _ in range(200)]
    ids, counts = e.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_large_slices_are_cut_by_arrow_and_new_words_joined(monkeypatch):
    class Counting:
        def __init__(self, t):
            self.t, self.batches, self.single = t, 0, 0

        def encode_batch_fast(self, *a, **kw):
            self.batches += 1
            return self.t.encode_batch_fast(*a, **kw)

        def encode(self, *a, **kw):
            self.single += 1
            return self.t.encode(*a, **kw)

    from panelmill.llm import encoder as module

    monkeypatch.setattr(module, "LARGE", 1)
    rng = np.random.default_rng(5)
    words = ["été,", "don't", "漢字", "a1", "<|endoftext|>", "***", "😀!", *["".join(rng.choice(list("abcdefgé"), 7)) for _ in range(2000)]]
    even = ["".join(w + s for w, s in zip(rng.choice(words, 40), rng.choice([" ", "\n"], 40)))[:-1] for _ in range(60)]
    odd = ["", " ", "\n", " lead", "tail\n", "tab\tin it", "two  spaces here", "a b c", "x\x1cy z", "no break", "line\r\nbreak", "　"]
    texts = [x for pair in zip(even, [*odd, *even][: len(even)]) for x in pair] + odd
    e = Encoder(VOCABULARY)
    t, e.tokenizer = e.tokenizer, Counting(e.tokenizer)
    ids, counts = e.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert e.tokenizer.batches == 1 and e.tokenizer.single <= len(set(texts)) + len(odd)
    assert e.encode([])[0].tolist() == []


def test_anchors_are_searched_in_blocks(monkeypatch):
    """No block's hashes go beyond BLOCK starts, and runs don't depend on where blocks begin."""
    rng, p = np.random.default_rng(6), suffix.Params()
    data = rng.choice(list(b"ab "), 9000).astype(np.uint8)
    data[5000:7000] = data[1000:3000]
    offsets = np.cumsum([0, 0, 700, 49, 50, 0, 3201, 4990, 10])
    seen, whole = [], suffix.gram_hashes

    def hashes(part, k):
        seen.append(len(part))
        return whole(part, k)

    monkeypatch.setattr(suffix, "gram_hashes", hashes)
    monkeypatch.setattr(suffix, "BLOCK", 1 << 20)
    want = suffix.runs(data, offsets, p)
    for block in (1, 37, 1000):
        monkeypatch.setattr(suffix, "BLOCK", block)
        del seen[:]
        got = suffix.runs(data, offsets, p)
        assert max(seen) <= block + p.length - 1 and all((a == b).all() for a, b in zip(got, want))
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(want[1], want[2])])
    assert sorted(covered) == [i for i in range(len(data)) for e in [offsets[offsets > i].min()] if i + p.length <= e]
    assert all(offsets[d] <= a < offsets[d + 1] for d, a in zip(want[0], want[1]))


def test_prefixes_are_compared_at_ends_of_stretches():
    """A text that repeats is compared at few places, so its common prefixes need no pass over every byte."""
    rng = np.random.default_rng(7)
    for t in (np.zeros(500, np.uint8), np.tile(rng.integers(0, 3, 90).astype(np.uint8), 9), np.append(rng.integers(0, 2, 300), np.zeros(70)).astype(np.uint8)):
        b, sa = t.tobytes(), suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for limit in (1, 8, 20, 50):
            want = [0] + [next(k for k in range(limit + 1) if k == limit or max(x, y) + k >= len(b) or b[x + k] != b[y + k]) for x, y in zip(sa[:-1].tolist(), sa[1:].tolist())]
            assert suffix.common_prefixes(t, sa, limit).tolist() == want
    assert len(suffix.common_prefixes(np.empty(0, np.uint8), np.empty(0, np.int64), 50)) == 0


def test_words_past_the_memo_are_not_remembered():
    """A full memo takes no word in, not even for the length of a call; ids of those words are there for that call."""

    class Full(dict):
        def popitem(self):
            raise AssertionError("a word was taken in and out again")

    t, e = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY, memo=40)
    e.number = Full()
    rng = np.random.default_rng(8)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice(list("abcdé,"), 5)) for _ in range(30)) for _ in range(5)] + ["  odd\tone", ""]
        ids, counts = e.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert list(e.number.values()) == list(range(40))
    e = Encoder(VOCABULARY, memo=0)
    assert [e.encode(["a b a"])[0].tolist() for _ in range(2)] == [t.encode("a b a", add_special_tokens=False).ids] * 2
