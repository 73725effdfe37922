"""License scans with a generalised suffix automaton of license tokens.

The automaton holds every substring of every template. Reading a file word by word gives its matching statistics: for
each word the longest template passage that ends there. Passages of at least `least` words are chained into covered
spans. A template labels the file when passages that no other template holds have enough words, so that wording common to
several licenses ("under the terms of the") labels nothing by itself. Base labels come from fixed phrases.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .registry import query, table

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening or grant passages of public license texts, by label.
TEMPLATES = {
    "mit": "released under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version licensed under the gnu general public license version 3",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by": "licensed under a creative commons attribution 4 0 international license licensed under cc by 4 0",
    "cc-by-nc": "licensed under a creative commons attribution noncommercial 4 0 international license licensed under cc by nc 4 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}


@dataclass(frozen=True)
class Params:
    least: int = 5  # words of a passage worth chaining
    label_words: int = 5  # words of a passage of one template alone that give its label
    gap: int = 8  # words between two passages of one span at most
    template_words: int = 200_000  # words of all templates together, some 300 whole license texts; every task holds their automaton


class Automaton:
    """Suffix automaton of several word sequences; every state knows the templates its passages occur in."""

    def __init__(self, templates: Mapping[str, str]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.labels: list[set[str]] = [set()]
        for label, text in templates.items():
            last = 0
            for word in words_of(text):
                last = self._extend(last, word)
                state = last
                while state > 0 and label not in self.labels[state]:
                    self.labels[state].add(label)
                    state = self.link[state]

    def _new(self, length: int, link: int, edges: dict[bytes, int], labels: set[str]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.labels.append(labels)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), set(self.labels[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # known from an earlier template
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._new(self.length[last] + 1, 0, {}, set())
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def matches(self, words: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """Maximal passages as (end, length, state): matching statistics where the next word no longer extends them."""
        out, state, length = [], 0, 0
        start, nxt, link, longest = self.next[0], self.next, self.link, self.length
        for i, w in enumerate(words):
            if not state:
                state = start.get(w, 0)
                length = 1 if state else 0
                continue
            to = nxt[state].get(w)
            if to is not None:
                state, length = to, length + 1
                continue
            if length >= least:
                out.append((i, length, state))
            while state > 0 and w not in nxt[state]:
                state = link[state]
                length = longest[state]
            state = nxt[state].get(w, 0) if state >= 0 else 0
            length = length + 1 if state else 0
        if length >= least:
            out.append((len(words), length, state))
        return out


@cache
def _built(templates: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(dict(templates))


def automaton(templates: Mapping[str, str] = TEMPLATES) -> Automaton:
    """The automaton of (label, whole text) templates, built once in a worker."""
    return _built(tuple(templates.items()))


def spans(found: list[tuple[int, int, int]], a: Automaton, gap: int) -> dict[str, list[list[int]]]:
    """Covered spans [first, last, covered words] by label: passages with at most `gap` words between are one span."""
    out: dict[str, list[list[int]]] = {}
    for end, length, state in found:
        for label in a.labels[state]:
            s = out.setdefault(label, [])
            if s and end - length - s[-1][1] - 1 <= gap:
                s[-1][2] += end - 1 - max(s[-1][1], end - length - 1)
                s[-1][1] = end - 1
            else:
                s.append([end - length, end - 1, length])
    return out


# Words are runs of 0-9, A-Z (lower-cased) and bytes over 0x7F; everything else separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_PHRASES = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in _PHRASES:
        at, seen, word = line.find(phrase), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            out.append((word, label))
            seen, at = at, line.find(phrase, at + 1)
    return sorted(out)


def scan(text: str | None, p: Params = Params(), templates: Mapping[str, str] = TEMPLATES) -> dict:
    a, w = automaton(templates), words_of(text)
    base = base_places(w)
    found = a.matches(w, p.least)
    by_label = spans(found, a, p.gap)
    own = {label for label in by_label if sum(n for _, n, state in found if a.labels[state] == {label}) >= p.label_words}
    covered = set()
    for label in own:
        for first, last, _ in by_label[label]:
            covered.update(range(first, last + 1))
    for at, label in base:
        covered.update(range(at, at + next(ph.count(b" ") - 1 for ph, x in _PHRASES if x == label)))
    names = sorted({label for _, label in base})
    return {
        "n_words": len(w), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(names), "labels": ",".join(sorted(own | set(names))), "score": len(covered) / len(w) if w else 0.0,
        "spans": [{"label": label, "first": f, "last": t, "covered": n} for label in sorted(own) for f, t, n in by_label[label]],
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, last long, covered long>>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
    ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64())]))),
])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, counts, labels, score (share of words inside spans or phrases), spans.

    templates: whole license texts by label, of `template_words` words together at most (more is an error); letters are
    lower-cased and punctuation separates words, as in the documents. Without templates only the phrases label.
    Null, empty and word-free texts have no words, no labels (empty strings), null places and score 0. Ids are carried,
    null or repeated as they are; other columns are ignored.
    """

    held = sum(len(words_of(x)) for x in templates.values())
    if held > p.template_words:
        raise ValueError(f"templates of {held} words: a task holds {p.template_words} at most; scan with parts of them")
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(x.as_py(), p, templates) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(_ARROW)[1:])], schema=_ARROW)

    d = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return d.mapInArrow(run, f"doc_id long, {SCHEMA}")


#: The columns of the base contract; labels and score follow from the templates and have no SQL.
BASE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) - 1 as pos from w),
n as (select *, lead(x) over o as x2, lead(x, 2) over o as x3 from t window o as (partition by doc_id order by pos)),
l as (select doc_id, pos, case when x = 'cc' and x2 = 'by' then 'cc-by' when x = 'general' and x2 = 'public' and x3 = 'license' then 'gpl' when x = 'all' and x2 = 'rights' and x3 = 'reserved' then 'reserved' end as label from n),
h as (select * from l where label is not null),
g as (select doc_id, count(*) as n, min(pos) as a, max(pos) as b, string_agg(distinct label, ',' order by label) as labels from h group by 1)
select w.doc_id, len(w.w) as n_words, coalesce(n, 0) as n_base, a as first_word, b as last_word, coalesce(labels, '') as base_labels from w left join g using (doc_id)
"""


@query("license_base_places", BASE_SQL)
def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express, through the same operator."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@query("op7_license_automaton")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
