"""Edge cases of the training-data operators against brute-force versions, on small tables."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panelmill.llm import chunked_bpe, embeddings, language, licenses, minhash, mixing, quality, simple8b, suffix, warc
from panelmill.llm.files import new_folder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 700} and" for i in range(20_000))
BASE = "The quick brown fox jumps over the lazy dog while seventeen other animals look on from the old garden wall. "
ROWS = [
    (1, BASE * 3, "en", "a", 1), (2, BASE * 3, "en", "a", 1), (3, BASE * 3 + "One more line.", "en", "b", 1), (4, None, None, None, None), (5, "", "fr", "b", 0),
    (6, " \n\t ", "fr", "a", 3), (7, "two words", "fr", None, 9), (8, "two words", "fr", None, 9), (8, "two words", "fr", None, 9), (None, BASE * 3, "en", "a", 1), (None, None, None, None, None),
    (9, "naïve — 漢字 <|endoftext|> tail \x00 and   more  spaces\r\nend", "de", "c", 5), (10, LONG, "en", "a", 7), (11, "x " + LONG, "en", "a", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, DOCS).repartition(3)
    return d.withColumns({"k": F.lit(1), "kept": F.lit("clash"), "rest": F.lit(2), "hash": F.lit("z")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, empty):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    assert len(rows) == len(ROWS)
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[1][2] == by[2][2] == by[3][2] == 1 and not by[2][3] and by[1][3]
    assert by[4][1:] == (0, 4, True) and by[5][1:] == (0, 5, True) and by[6][1] == 0 and by[7][1:] == (1, 7, True) and by[8][2] == 7
    assert all(r[2] is None and r[3] for r in rows if r[0] is None)
    assert by[11][2] == 10
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_blocks_cut_by_bytes(spark):
    """A group of long copies with one word changed each is cut into many blocks; its links and those of other documents stay."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:k] + [f"new{k}"] + words[k + 1 :]) for k in range(0, 400, 10)] + [" ".join(f"v{i}" for i in range(300)), "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(minhash.shingles(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:  # smallest id reachable
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = min(root[i], root[j])
    for size in (1 << 21, 1500):  # one block; a few sets a block
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, p=minhash.Params(block_shingles=size)).collect()}
        assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_signatures_prune_only_dissimilar_sets():
    p = minhash.Params()
    a = np.unique(np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64))
    pairs = [(a[:2000], a[100:2100]), (a[:1000], a[900:1900])]  # similarities 0.90 and 0.05
    sig = np.stack([(minhash.signature(s, p) & np.uint32(255)).astype(np.uint8) for pair in pairs for s in pair])
    left, _ = minhash.surviving_pairs(sig, np.array([0, 2]), np.array([1, 3]), p)
    assert left.tolist() == [0]


def test_quality_rules(docs, empty):
    rows = {r.doc_id: r._q for r in quality.measures(docs).collect()}
    assert rows[4].n_words == 0 and rows[4].base_failed and not rows[5].kept
    assert rows[6].n_dup_lines == 0 and rows[1].n_repeat_words == rows[1].n_words
    nav = "Home | About | Contact | Help\n"
    spark = docs.sparkSession
    body = " ".join(f"Sentence{i} number{i} tells{i} something new{i}." for i in range(30))
    d = spark.createDataFrame([(1, nav + body, "en", "a", 1), (2, nav * 40 + body[:300], "en", "a", 1)], DOCS)
    out = {r.doc_id: r for r in quality.clean(d).collect()}
    assert set(out) == {1} and out[1].text == body and out[1].n_chars == len(body)
    assert quality.measures(empty).count() == 0


def test_passages_match_brute_force(docs, empty):
    got = suffix.repeated_passages(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    want = suffix.brute_force([(r[0], r[1]) for r in ROWS], 50)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffix.repeated_passages(empty).count() == 0
    assert suffix.without_passages(docs).columns == docs.columns


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n, letters in ((1, 1), (60, 1), (400, 2), (900, 250)):
        t = rng.integers(0, letters, n).astype(np.uint8)
        b, sa = t.tobytes(), suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        want = [0] + [next(k for k in range(51) if k == 50 or max(x, y) + k >= n or b[x + k] != b[y + k]) for x, y in zip(sa[:-1], sa[1:])]
        assert suffix.common_prefixes(t, sa, 50).tolist() == want


def test_shards_are_merged():
    rng = np.random.default_rng(1)
    base = bytes(rng.choice(list(b"ab cd"), 300).astype(np.uint8))
    at, n, d = rng.integers(0, 250, 60), rng.integers(1, 20, 60), rng.integers(0, 9, 60)
    pieces = [base[a : a + k + 19] for a, k in zip(at, n)]
    n = np.array([len(p) - 19 for p in pieces])
    first = {}
    for p, k, doc in zip(pieces, n, d):
        for i in range(k):
            first[p[i : i + 20]] = min(first.get(p[i : i + 20], 99), doc)
    want = [first[p[i : i + 20]] for p, k in zip(pieces, n) for i in range(k)]
    for size in (10**9, 200):
        assert suffix.smallest_documents(pieces, n, d, 20, size).tolist() == want


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    per = {r.source: r for r in rows}
    assert abs(sum(r.target for r in per.values()) - 1.5 * total) < 0.01 and all(r.target <= 2 * r.source_size + 1e-6 for r in per.values())
    for source in per:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - per[source].target) <= max(r.size for r in mine)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_chunked_encoding(docs, empty, ranks):
    t = Tokenizer.from_file(VOCABULARY)
    want = sorted(str((r[0], t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    encoded = chunked_bpe.encode_documents(docs, VOCABULARY, ranks)
    assert sorted(str((r.doc_id, list(r.ids))) for r in encoded.collect()) == want
    if ranks:
        d = chunked_bpe.encode_digests(docs).where("doc_id = 9").first()
        assert d.decoded_sha256 == hashlib.sha256(ROWS[11][1].encode()).hexdigest()
        assert chunked_bpe.encode_documents(empty, VOCABULARY, ranks).count() == 0


def test_packed_ids(spark, docs, empty):
    t = Tokenizer.from_file(VOCABULARY)
    files = simple8b.write_ids(docs, new_folder(spark, "test-ids"), VOCABULARY)
    got = simple8b.read_ids(files).collect()
    assert len(got) == len(ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    crc = lambda text: zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted(str((r.doc_id, r.ids_crc32)) for r in got) == sorted(str((r[0], crc(r[1]))) for r in ROWS)
    assert simple8b.read_ids(simple8b.write_ids(empty, new_folder(spark, "test-ids"), VOCABULARY)).count() == 0


def test_words_of_64_bits():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1025, 9000):
        for top in (2, 50_257, 2**33, 2**64 - 1):
            v = rng.integers(0, top, n, np.uint64)
            v[rng.random(n) < 0.5] //= np.uint64(97)
            words, odd, per_block = simple8b.pack(v)
            sizes = np.minimum(simple8b.BLOCK, n - np.arange(len(per_block)) * simple8b.BLOCK)
            assert (simple8b.unpack(words, odd, per_block, sizes) == v).all()


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.1, 0.0]), (4, [0.0, 1.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0]), (9, [None, 1.0, 0.0]),
            (10, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (12, [1e200, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("copies", F.lit(1))
    got = {r.vec_id: tuple(r)[1:] for r in embeddings.near_vectors(d).collect()}
    assert len(got) == len(rows)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[12] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, True)
    assert embeddings.near_vectors(d.limit(0)).count() == 0


def test_vector_groups_beyond_a_block(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 32))
    x = np.concatenate([c + rng.normal(size=(k, 32)) * s for c, k, s in zip(centres, (90, 40, 5, 3, 1, 1), (0.05, 0.2, 0.05, 0.3, 1, 1))])
    x = np.concatenate([x, x[:30]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    least = np.arange(len(x))
    while True:
        new = np.where(near, least[None], len(x)).min(axis=1, initial=len(x))
        if (np.minimum(new, least) == least).all():
            break
        least = np.minimum(new, least)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(d, p=embeddings.Params(block=16)).collect())
    assert got == [(i, int(near[i].sum()), int(least[i])) for i in range(len(x))]


def test_language(docs, empty):
    m = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, m).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[4].score == 0
    assert got[1].lang_pred == "en" and 0 <= got[1].score <= 1 and got[7].lang_pred == "fr"
    assert language.predict(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def _plain_scan(text, templates, p):
    """The row of a text by trying every passage of every template."""
    w = licenses.words_of(text)
    joined = {k: b" " + b" ".join(licenses.words_of(t)) + b" " for k, t in templates.items()}
    holds = lambda a, b: {k for k, t in joined.items() if b" " + b" ".join(w[a:b]) + b" " in t}
    longest = [max((k for k in range(1, i + 1) if holds(i - k, i)), default=0) for i in range(1, len(w) + 1)]
    found = [(i - k, i, holds(i - k, i)) for i, k in enumerate(longest, 1) if k >= p.least and (i == len(w) or longest[i] != k + 1)]
    own = {k for k in templates if sum(b - a for a, b, on in found if on == {k}) >= p.label_words}
    base = [(i, label, n) for i in range(len(w)) for phrase, label in licenses.PHRASES.items() for n in [len(phrase.split())] if b" ".join(w[i : i + n]).decode() == phrase]
    covered = {j for i, _, n in base for j in range(i, i + n)}
    for k in own:
        parts = sorted((a, b) for a, b, on in found if k in on)
        first, last = parts[0]
        for a, b in parts[1:]:
            if a - last > p.gap:
                covered |= set(range(first, last))
                first = a
            last = b
        covered |= set(range(first, last))
    names = {label for _, label, _ in base}
    return (len(w), len(base), min((i for i, *_ in base), default=None), max((i for i, *_ in base), default=None), ",".join(sorted(names)), ",".join(sorted(own | names)), round(len(covered) / len(w), 9) if w else 0.0)


def test_license_rows_equal_plain_ones(spark):
    """Whole rows of the operator, with the fixed passages and with templates given as texts, against trying everything."""
    rng = np.random.default_rng(5)
    given = {"one": "You MAY copy, use; and share this work: for any purpose at all!", "two": "use and share this work for any good reason, at your own risk", "three": "All rights reserved. No part may be copied."}
    p = licenses.Params()
    for templates in (licenses.TEMPLATES, given):
        pool = [licenses.words_of(t) for t in templates.values()] + [b"cc by".split(), b"general public license".split(), b"all rights reserved".split(), b"some other words of the text".split()]
        texts = [None, "", " .,;", "cc by", "Cc-By cc by", *templates.values()]
        for _ in range(60):
            parts = [pool[i][a : a + n] for i, a, n in zip(rng.integers(0, len(pool), 6), rng.integers(0, 12, 6), rng.integers(1, 15, 6))]
            texts.append(" ".join(x.decode().upper() if rng.random() < 0.2 else x.decode() for part in parts for x in part))
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r[0]: tuple(r)[1:7] + (round(r.score, 9),) for r in licenses.scan_licenses(d, templates=templates).drop("spans").collect()}
        assert got == {i: _plain_scan(t, templates, p) for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="templates of"):
        licenses.scan_licenses(d, p=licenses.Params(template_words=10), templates=given)
    assert licenses.scan_licenses(d, templates={}).where("labels <> base_labels").count() == 0


def test_licenses(docs, empty):
    assert licenses.scan_licenses(docs).count() == len(ROWS) and licenses.scan_licenses(empty).count() == 0
    s = licenses.scan("X. Licensed under CC BY-NC 4.0. ALL rights reserved, all rights reserved")
    assert (s["n_words"], s["n_base"], s["first_word"], s["last_word"], s["base_labels"]) == (14, 3, 3, 11, "cc-by,reserved") and "cc-by-nc" in s["labels"]
    assert licenses.scan(None)["labels"] == "" and licenses.scan("naïve ÀB")["n_words"] == 2
    assert licenses.scan("the tenants live under the terms of the lease")["labels"] == ""  # words of several templates
    assert licenses.base_places(licenses.words_of("cc by cc by gpl general public license cc by")) == [(0, "cc-by"), (2, "cc-by"), (5, "gpl"), (8, "cc-by")]
    a, words = licenses.automaton(), "permission to use copy the gnu general public license as published by zzz of this software and".encode().split()
    longest = [max((k for t in licenses.TEMPLATES.values() for k in range(i + 2) if f" {b' '.join(words[i + 1 - k : i + 1]).decode()} " in f" {t} "), default=0) for i in range(len(words))]
    want = [(i + 1, m) for i, m in enumerate(longest) if m >= 2 and (i + 1 == len(words) or longest[i + 1] != m + 1)]
    assert [(e, n) for e, n, _ in a.matches(words, 2)] == want


def test_archives(spark):
    big = "é" * 400_000
    rows = [(3, "u", "same"), (1, "u\r\nX: y", "same"), (2, None, None), (5, "u", ""), (7, "u", big), (8, "u", big), (None, "u", "same"), (9, "u", "a\r\n\r\nb")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    files = warc.write_archive(d, new_folder(spark, "test-warc"), limit=100)
    table = warc.read_archive(files).collect()
    got = {r.page_id: tuple(r)[1:] for r in warc.records(warc.read_archive(files)).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert got[1] == (4, sha("same"), "response", None) and got[3] == (4, sha("same"), "revisit", 1) and got[2] == (0, sha(""), "response", None) and got[5] == (0, sha(""), "revisit", 2)
    assert got[8] == (800_000, sha(big), "revisit", 7) and got[None] == (4, sha("same"), "response", None)
    assert b"".join(r.chunk for r in sorted((r for r in table if r.page_id == 7), key=lambda r: r.chunk_no)).decode() == big
    assert warc.records(warc.read_archive(warc.write_archive(d.limit(0), new_folder(spark, "test-warc")))).count() == 0


def test_pipeline_stages(spark, empty):
    body = [" ".join(f"Story{k}x{i} line{i}y{k} brings{i}z{k} a{i} thing{k}w{i} to light{i}v{k}." for i in range(40)) for k in range(4)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate([*body, body[0], body[1] + " End.", "short"])]
    d = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = stage(spark, d, "")
        if name != "token_ids":
            assert d.columns == before.columns
        assert stage(spark, before.limit(0), "").count() == 0
        if name == "near_duplicates":
            assert {r.doc_id for r in d.collect()} == {0, 1, 2, 3}
    assert d.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def backoff_scores(rows, texts, p=language.Params()):
    """Languages and, per text, the posterior of each by a plain reading of the rules."""
    counts = {}
    for text, lang in rows:
        for w in language.words_of(text):
            for k in range(p.longest + 1):
                m = f"<{w}>" if k > 1 else w
                for t in [w] if k == 0 else [m[i : i + k] for i in range(max(1, len(m) - k + 1))]:
                    of = counts.setdefault(k, {}).setdefault(lang, {})
                    of[t] = of.get(t, 0) + 1
    langs = sorted(counts[0])
    log = lambda k, x, n: np.log((n + p.smoothing) / (sum(counts[k][x].values()) + p.smoothing * len(counts[k][x])))
    floor = {k: min(log(k, x, 0) for x in langs) for k in counts}
    row = lambda k, t: np.array([log(k, x, counts[k][x][t]) if t in counts[k][x] else floor[k] for x in langs])
    out = []
    for text in texts:
        total = np.zeros(len(langs))
        for w in language.words_of(text):
            for k in (0, *range(p.longest, 0, -1)):
                m = f"<{w}>" if k > 1 else w
                got = [t for t in ([w] if k == 0 else [m[i : i + k] for i in range(max(1, len(m) - k + 1))]) if any(t in counts[k][x] for x in langs)]
                if got:
                    total += np.mean([row(k, t) for t in got], axis=0)
                    break
        e = np.exp(total - total.max())
        out.append(e / e.sum())
    return langs, out


@pytest.mark.parametrize("head", [0, 3, 100_000])
def test_language_scores_match_brute_force(spark, head):
    train = [("the old house by the river is old", "en"), ("la maison est près de la rivière", "fr"), ("das alte Haus am Fluß ist alt", "de"), ("漢字 kana", "ja"), ("the la das", "fr"), (None, "en"), ("zzz", None)]
    texts = ["the river", "rivers housing maisonette", "qqq 漢語 old", "éé", "Ж", "", None, "the the la rivière rivière unhaus", "Flußhaus a b", "the river"]
    m = language.fit(spark.createDataFrame(train, "text string, lang string"))
    d = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    langs, scores = backoff_scores([r for r in train if r[1]], texts)
    want = sorted((i % 9, "und" if not language.words_of(t) else langs[int(s.argmax())], 0.0 if not language.words_of(t) else float(s.max())) for i, (t, s) in enumerate(zip(texts, scores)))
    got = sorted(map(tuple, language.predict(d, m, p=language.Params(head=head)).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-6)


def test_a_rare_language_keeps_all_its_words(spark):
    letters = "abcdefghij"
    word = lambda i, a: a + "".join(letters[int(c)] for c in f"{i:05d}")
    common = [(i, " ".join(word(60 * (i // 2) + j, "xk"[i % 2]) for j in range(120)), ("en", "fr")[i % 2], "a", 1) for i in range(1998)]  # 120,000 pairs, each seen twice
    rare = [(5000 + i, " ".join(word(900 * i + j, "q") for j in range(30)), "es", "a", 1) for i in range(2)]
    m = language.fit(spark.createDataFrame(common + rare, DOCS))
    assert m.where("lang = 'es' and length = 0").count() == 60 and m.where("length = 0").count() > 100_000
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(rare, DOCS), m).collect()}
    assert all(got[r[0]][0] == "es" and got[r[0]][1] > 0.999 for r in rare)
