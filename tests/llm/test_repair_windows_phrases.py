"""Conversation repair, word windows and phrases against brute-force versions, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import doubling, phrases, repair

CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string"
CLASH = ["k", "slice", "row", "h", "chunk", "pos", "at", "n_words", "kept", "words", "a", "low"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# ---- conversations


def plain_lightest(roles, faults):
    """All edits of every row with up to two insertions before it, the least (cost, audit)."""
    best = None
    gaps = [""] if len(roles) > 4 else ["", "I", "II"]

    def go(i, state, cost, audit):
        nonlocal best
        if i == len(roles):
            for extra in ("", "I", "II"):
                q = state
                for _ in extra:
                    q = {"-": "u", "s": "u", "u": "a", "a": "u"}[q]
                if q in "-a":
                    best = min(best or (10**9, ""), (cost + 5 * len(extra), audit + extra))
            return
        for extra in gaps:
            q = state
            for _ in extra:
                q = {"-": "u", "s": "u", "u": "a", "a": "u"}[q]
            c, a = cost + 5 * len(extra), audit + extra
            go(i + 1, q, c + 2, a + "D")
            if faults[i] not in (1, 2):
                more = 5 if faults[i] == 3 else 0
                if roles[i] in {"-": "su", "s": "u", "u": "a", "a": "u"}[q]:
                    go(i + 1, roles[i], c + more, a + "K")
                go(i + 1, {"-": "u", "s": "u", "u": "a", "a": "u"}[q], c + 1 + more, a + "R")

    go(0, "-", 0, "")
    return best


def test_agenda_finds_the_least_of_all_edits():
    for n in range(4):
        for roles in itertools.product("sua?", repeat=n):
            for faults in itertools.product((0, 2, 3), repeat=n):
                (found,) = repair.lightest("".join(roles), list(faults), "-", "-a").values()
                assert found == plain_lightest("".join(roles), list(faults)), (roles, faults)


def test_stretches_join_to_the_whole():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(0, 14)
        roles, faults = "".join(rng.choice("suuaa?") for _ in range(n)), [rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)]
        (whole,) = repair.lightest(roles, faults, "-", "-a").values()
        cuts = sorted(rng.sample(range(n + 1), min(n, 3)))
        bounds = list(zip([0, *cuts], [*cuts, n]))
        parts = [{k: v for p in "-sua" for k, v in repair.lightest(roles[a:z], faults[a:z], p).items()} for a, z in bounds]
        joined = repair.compose_all(parts)
        assert min(v for (p, q), v in joined.items() if p == "-" and q in "-a") == whole
        split = repair.split_audit(whole[1], [roles[a:z] for a, z in bounds])
        assert "".join(x for _, x in split) == whole[1]


def plain_repair(rows):
    """The contract row by row, for tests."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = "".join(r[1][:1] if r[1][:1] in ("s", "u", "a") else "?" for r in mine)
        cost, audit = plain_lightest(initials, faults) if len(mine) <= 7 else next(iter(repair.lightest(initials, faults, "-", "-a").values()))
        state, lines, at = "-", [], 0
        for letter in audit:
            if letter in "IR":
                state = {"-": "u", "s": "u", "u": "a", "a": "u"}[state]
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + ("" if letter == "I" else mine[at][2]))
            elif letter == "K":
                state = initials[at]
                lines.append(f"{mine[at][1]}:{mine[at][2]}")
            at += letter != "I"
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "", None, "tool", "Umlaut", "äh"]
    texts = ["Hello.", "Why?", "and so", "", " \n", None, "Fine! \t", "naïve — 漢字.", "same.", "same.", "x" * 100_000 + "."]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (None, 2, "assistant", "Me."), (70, -5, "user", "a."), (70, -5, "user", "a."), (70, -5, "assistant", "b."), (71, None, None, None)]
    rows += [(80, t // 2, ("user", "assistant")[t % 2], f"line {t % 900}.") for t in range(5000)]  # one conversation over several stretches
    return rows


def test_conversations_match_the_plain_version(spark, monkeypatch):
    rows = conversations()
    monkeypatch.setattr(repair, "STRETCH", 100)
    df = clashing(spark.createDataFrame(rows, CONV).repartition(5))
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damage(df), df).collect()}
    want = plain_repair(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_conversations_match_sql_with_repeats_and_nulls(spark):
    rows = [r for r in conversations() if r[0] != 80]
    df = spark.createDataFrame(rows, CONV)
    got = sorted(map(str, repair.repair(repair.damage(df), df).collect()))
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    cur = con.execute(repair.SQL)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert got == sorted(str(r) for r in spark.createDataFrame([tuple(w[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for w in want], "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").collect())


def test_repaired_turns_and_empty_tables(spark):
    empty = spark.createDataFrame([], CONV)
    assert repair.repair(repair.damage(empty), empty).count() == 0 and repair.repaired_turns(empty).count() == 0
    df = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "Still me."), (1, 3, "assistant", "Yes."), (2, 1, "user", "")], CONV)
    assert [tuple(r) for r in repair.repaired_turns(df).orderBy("conv_id", "at").collect()] == [(1, 0, "user", "Still me."), (1, 1, "assistant", "Yes.")]
    assert repair.repair(df.where("conv_id = 2"), df).orderBy("conv_id").select("cost", "audit").collect()[1] == (2, "D")


# ---- word windows


def plain_windows(rows, window):
    words = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for _, t, *_ in rows]
    ids = [2**63 - 1 if r[0] is None else r[0] for r in rows]
    first = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, i), i)
    out = []
    for r, i, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def documents():
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "été", "x", "漢字"])
    common = [word() for _ in range(70)]
    texts = []
    for k in range(40):
        own = [word() for _ in range(rng.randint(0, 120))]
        cut = rng.randint(0, len(own))
        a = rng.randint(0, 30)
        texts.append(rng.choice([" ", "\n", " \t\r\n"]).join(own[:cut] + common[a : a + rng.randint(10, 70)] + own[cut:]))
    texts += [texts[3], texts[3].replace(" ", "\n"), None, "", " \n ", "one", " ".join(common) * 60, "w " * 3000, "w " * 49, "w w " * 60, "y" * 300_000 + " " + " ".join(common)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    return rows + [(None, texts[3], None), (None, texts[5], "de"), (2, texts[3], None), (2, texts[3], None), (-7, texts[8], "de"), (5, texts[5], "en"), (2**63 - 1, texts[9], "en")]


@pytest.mark.parametrize("window,base,slice_bytes", [(50, 13, 2 << 20), (50, 13, 500), (7, 2, 2000), (3, 13, 500), (1, 1, 500)])
def test_windows_match_the_plain_version(spark, window, base, slice_bytes):
    rows = documents()
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(4))
    got = doubling.repeated_windows(df, p=doubling.Params(window=window, base=base, slice_bytes=slice_bytes))
    out = got.collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out))) == sorted(map(str, plain_windows(rows, window)))
    assert all(sum(s["end"] - s["start"] for s in r.spans) == r.n_removed for r in out)


def test_windows_of_an_empty_table_and_levels(spark):
    assert doubling.repeated_windows(spark.createDataFrame([], DOCS)).count() == 0
    assert doubling.repeated_windows(spark.createDataFrame([(1, None, "en")], DOCS)).collect()[0]["kept"] == ""
    assert doubling.levels(doubling.Params()) == [13, 25, 50]
    assert doubling.without_windows(spark.createDataFrame([(1, "a  b", "en")], DOCS)).collect() == [(1, "a b")]


def test_a_passage_of_all_documents_is_one_row_a_slice(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, f"own{k} {passage}", "en") for k in range(400)]
    p = doubling.Params()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    start = df.select("doc_id", "text").mapInArrow(doubling._prepare(p), "slice long, row int, doc_id long, n_words long, sha256 string, text string")
    sent = start.select("slice", "doc_id", "text").mapInArrow(doubling._send(50, True, p), "slice long, h long, g long, low long, high long")
    assert sent.where("low < high").count() == 11


# ---- phrases


def plain_phrases(rows, p):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, p.words + 1):
                for k in range(len(w) - m + 1):
                    f[lang, tuple(w[k : k + m])] += 1
    c = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= p.least}
    around = Counter()
    for (lang, w), v in c.items():
        for m in range(2, len(w)):
            for k in range(len(w) - m + 1):
                around[lang, w[k : k + m]] = max(around[lang, w[k : k + m]], v)
    out = {}
    for (lang, w), a in c.items():
        if 100 * around[lang, w] >= p.inside * a and around[lang, w]:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in out.items() for i, x in enumerate(sorted(v)[: p.top], 1))


def texts():
    rng = random.Random(9)
    vocabulary = ["The", "a", "cat", "Été", "漢字", "of", "Ä", "new", "york", "x y", "-", "\x00", "CITY"]
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["new", "York", "City"], ["of", "the"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
            words[-1] += rng.choice(["", "", "", ",", ".", "!", "\n", "\t", ";;"])
        rows.append((k, rng.choice([" ", "  "]).join(words), rng.choice(["en", "de", None, "und", ""])))
    return rows + [(1, None, "en"), (2, "", None), (3, " \t ", "fr"), (None, "new york city " * 4000, "en"), (None, "new york city " * 10, "xx"), (None, "new york city " * 10, "xx"), (4, "only once here", "yy")]


@pytest.mark.parametrize("p", [phrases.Params(), phrases.Params(least=3, inside=50, top=7, slice_bytes=300, shard_bytes=64), phrases.Params(words=2, least=1, slice_bytes=1000)])
def test_phrases_match_the_plain_version(spark, p):
    rows = texts()
    got = phrases.collocations(clashing(spark.createDataFrame(rows, DOCS).repartition(4)), p=p).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, p)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b c", "en")], DOCS)).count() == 0


def test_filters_are_lossless():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 10_000, np.uint64)
    assert (phrases.unmix(phrases.mix(x)) == x).all() and (phrases.mix(phrases.unmix(x)) == x).all()
    for bits in (0, 3, 7):
        for m in (1, 2, 3, 1000):
            keys = np.unique(rng.integers(0, 2 ** (64 - bits), m, np.uint64) | np.uint64((1 << bits) - 1) << np.uint64(64 - bits) if bits else rng.integers(0, 2**64, m, np.uint64))
            counts = rng.integers(1, 600, len(keys))
            counts[0] = 2**40
            a, b = phrases.unpack(phrases.pack(keys, counts, bits), bits)
            assert (a == keys).all() and (b == counts).all()
    a, b = phrases.merge([(np.array([1, 5, 9], np.uint64), np.array([1, 1, 1])), (np.array([5, 10], np.uint64), np.array([2**33, 4]))])
    assert a.tolist() == [1, 5, 9, 10] and b.tolist() == [1, 2**33 + 1, 1, 4]
