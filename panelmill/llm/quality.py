"""Line-first quality rules with SQL functions only.

Every line with a word is judged on its own: sentence mark, navigation separators, symbol share, shouting, boilerplate.
Failing lines are taken out; a document whose removed lines held more than `max_lost` of its word characters is
rejected, and so is one that fails the whole-text rules (too few words, too many repeated three-word windows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused
from .registry import query, table

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·•"
SENTENCE_MARK = "[.!?…。！？]"
BOILERPLATE = (
    r"^[^a-z]*(all rights reserved|skip to (main )?content|terms of (use|service)|privacy policy|(accept|we use) (all )?cookies"
    r"|(please )?enable javascript|lorem ipsum|click here|read more|share this( page)?|sign (in|up)|log in|back to top|cookie settings)[^a-z]*$"
)


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 50
    separators: int = 3  # at least so many, and `separator_percent` of the words, make a navigation line
    separator_percent: int = 20
    symbol_percent: int = 15  # of the characters in words
    shout_percent: int = 30  # words with a doubled exclamation mark


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _only(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _word_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, GAP, ""))


def line_fails(line: Column, p: Params = Params()) -> Column:
    """True for a line with words that breaks a rule; lines without words never fail."""
    words, chars = F.regexp_count(line, F.lit(WORD)), _word_chars(line)
    nav = _only(line, SEPARATORS)
    return (chars > 0) & (
        ~line.rlike(SENTENCE_MARK)
        | ((nav >= p.separators) & (100 * nav >= p.separator_percent * words))
        | (100 * _only(line, SYMBOLS) > p.symbol_percent * chars)
        | (100 * F.regexp_count(line, F.lit("!!")) > p.shout_percent * words)
        | F.lower(line).rlike(BOILERPLATE)
    )


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows found at least twice. Windows are compared by a 64-bit hash."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
        return _let(
            F.sort_array(windows),
            lambda s: F.size(F.array_distinct(F.flatten(F.transform(
                F.filter(s, lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))].h == x.h)) | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)].h == x.h))),
                lambda x: F.array(x.i, x.i + 1, x.i + 2),
            )))),
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(words, of))


def measures(docs: DataFrame, text_col: str = "text", p: Params = Params(), name: str = "_q") -> DataFrame:
    """The input's columns and one struct column, `_q` or as named (the input must not have it): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, cleaned (text without failing lines).

    A null or word-free text has zero counts and fails. Repeated rows are judged alike; extra columns stay untouched.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(t, "\n", -1)

    def worded(a: Column) -> Column:
        return F.filter(a, lambda x: x.rlike(WORD))

    w = unused(docs, "_w")
    step = docs.withColumn(w, F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn(
        name,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            _word_chars(t).cast("long").alias("word_chars"),
            _only(t, SYMBOLS).cast("long").alias("n_symbols"),
            _let(worded(lines), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col(w)).cast("long").alias("n_repeat_words"),
            F.array_join(F.filter(lines, lambda x: ~line_fails(x, p)), "\n").alias("cleaned"),
        ),
    ).drop(w)
    q = F.col(name)
    failed = (q.n_words < p.min_words) | (100 * q.n_repeat_words > p.max_repeat_percent * q.n_words)
    kept = ~failed & (100 * (q.word_chars - _word_chars(q.cleaned)) <= p.max_lost_percent * q.word_chars)
    return step.withColumn(name, q.withField("base_failed", failed).withField("kept", kept))


def clean(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Documents that pass, without their failing lines; n_chars follows the text. Other columns, whatever their names,
    come back as they were; an empty table stays empty."""
    q = unused(docs, "_q")
    m = measures(docs, p=p, name=q).where(F.col(q).kept).withColumn("text", F.col(q).cleaned)
    return m.withColumn("n_chars", F.length("text").cast("long")).select([f"`{c}`" for c in docs.columns])


SQL = rf"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w),
y as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as k from x),
r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from y where k > 1) group by 1),
m as (select doc_id, len(w) as n_words, length(regexp_replace(t, '{GAP}', '', 'g')) as word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols,
        len(list_filter(l, lambda a: regexp_matches(a, '{WORD}'))) - len(list_distinct(list_filter(l, lambda a: regexp_matches(a, '{WORD}')))) as n_dup_lines,
        array_to_string(list_filter(l, lambda a: not (length(regexp_replace(a, '{GAP}', '', 'g')) > 0 and (
            not regexp_matches(a, '{SENTENCE_MARK}')
            or (length(a) - length(translate(a, '{SEPARATORS}', '')) >= 3 and 100 * (length(a) - length(translate(a, '{SEPARATORS}', ''))) >= 20 * len(regexp_extract_all(a, '{WORD}')))
            or 100 * (length(a) - length(translate(a, '{SYMBOLS}', ''))) > 15 * length(regexp_replace(a, '{GAP}', '', 'g'))
            or 100 * len(regexp_extract_all(a, '!!')) > 30 * len(regexp_extract_all(a, '{WORD}'))
            or regexp_matches(lower(a), '{BOILERPLATE}')))), chr(10)) as cleaned from w)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words)
        and 100 * (word_chars - length(regexp_replace(coalesce(cleaned, ''), '{GAP}', '', 'g'))) <= 50 * word_chars as kept
from m left join r using (doc_id)
"""


@query("op9_line_rules", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return measures(table(spark, sf_dir, "documents")).select("doc_id", *q)
