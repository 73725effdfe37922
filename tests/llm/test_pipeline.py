"""The stages of the corpus pipeline, and run() as a whole, against plain Python versions on a small table."""

import hashlib
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from panelmill.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(quality.WORD, text or "")


def chars(text):
    return sum(map(len, words(text)))


def fails(line):
    n, c, nav = len(words(line)), chars(line), sum(line.count(x) for x in quality.SEPARATORS)
    return c > 0 and (
        not re.search(quality.SENTENCE_MARK, line) or (nav >= 3 and 100 * nav >= 20 * n) or 100 * sum(line.count(x) for x in quality.SYMBOLS) > 15 * c
        or 100 * line.count("!!") > 30 * n or bool(re.search(quality.BOILERPLATE, line.lower())))


def plain_quality(rows):
    out = []
    for i, text, lang, source, _ in rows:
        w, t = words(text), text or ""
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        repeated = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 3)}
        cleaned = "\n".join(x for x in t.split("\n") if not fails(x))
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 100 * (chars(t) - chars(cleaned)) <= 50 * chars(t):
            out.append((i, cleaned, lang, source, len(cleaned)))
    return out


def plain_near(rows):
    sets = []
    for r in rows:
        w = words(r[1].lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g and r[0] is not None) for g, r in zip(group, rows) if r[0] is not None}
    return [r for r, g in zip(rows, group) if r[0] is None or r[0] == least[g]]


def plain_passages(rows, length=50):
    first, out = {}, []
    for i, text, *_ in rows:
        for k in range(len(text) - length + 1):
            first[text[k : k + length]] = min(first.get(text[k : k + length], i), i)
    for i, text, lang, source, _ in rows:
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - length + 1):
            if first[text[k : k + length]] < i:
                gone[k : k + length] = True
        kept = "".join(c for c, g in zip(text, gone) if not g)
        out.append((i, kept, lang, source, len(kept)))
    return out


def plain_mix(rows):
    names = sorted({r[3] for r in rows})
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in names}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    full, left, target = set(), 1.5 * sum(size.values()), {}
    while True:
        level = (left - sum(2 * size[s] for s in full)) / (sum(weight[s] for s in names if s not in full) or 1)
        more = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    out = []
    for s in names:
        target[s] = round(2 * size[s] if s in full else min(weight[s] * level, 2 * size[s]), 6)
        copies, upto = int(target[s] // size[s]), 0
        rest = target[s] - copies * size[s]
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            n = len(words(r[1]))
            extra = upto + n <= rest or (upto <= rest and upto + n - rest < rest - upto)
            upto += n
            out += [r] * (min(2, copies + extra) if n else 0)
    return out


def plain_ids(rows):
    t, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text, *_ in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def story(k, n=40):
    return [f"Tale{k}x{i} line{i}y{k} brings{i}z{k} a{i} thing{k}w{i} to light{i}v{k}." for i in range(n)]


def rows_of_all_kinds():
    shared = "This sentence of more than fifty characters is found in two of the documents of this table."
    texts = [
        "\n".join(story(0)), "\n".join(story(1)) + "\n" + shared, "\n".join(story(2)) + "\nHome | About | Contact | Help.\nRead more\nno mark here", shared + "\n" + "\n".join(story(3)),
        "\n".join(story(0)), "\n".join(story(1)) + "\n" + shared + "\nEnd.", "too short.", "again and again. " * 40, None, "\n".join(story(4, 25)), "\n".join(story(5, 60)), "\n".join(story(6, 33)),
        "\n".join(story(7)[:30] + ["Wow!! Buy!! now!!", "### $$$ ***."]), "no marks at all " * 30,
    ]
    return [(i, t, "en", "abcd"[i % 3 if i < 11 else 3], len(t or "")) for i, t in enumerate(texts)]


def test_stages_and_run_match_plain_versions(spark, tmp_path):
    rows = rows_of_all_kinds()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    plain = {"quality_rules": plain_quality, "near_duplicates": plain_near, "repeated_passages": plain_passages, "source_mix": plain_mix, "token_ids": plain_ids}
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, plain[name](rows)
        assert rows and (name in ("source_mix", "token_ids") or rows != before)  # the fixture has something for every stage
        got = stage(spark, spark.createDataFrame(before, DOCS).repartition(3), "")
        assert sorted(map(tuple, got.collect())) == sorted(rows), name
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(rows)
