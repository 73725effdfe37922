"""Repair of damaged conversations as lightest derivations, found by Knuth's agenda.

An item (i, q) says that the first i rows of a stretch have been edited and what came out ends in q: nothing yet, a
system, a user or an assistant turn. A deduction edits the next row (keep, change the role, delete) or inserts an empty
turn. A derivation weighs (cost, audit), the audit being its edits' initials. Items leave the agenda by (cost, i,
audit): every deduction raises cost or i, so it is superior to its premise. Two audits of one item at one cost never
begin with one another (they edit the same rows, and insertions cost), so more letters keep their order: weights are monotone, and what
is popped first is final.

Conversations are cut into stretches of bounded length wherever range partitions put them, so a conversation that holds
a third of all rows is solved by many tasks. A stretch of several yields the lightest derivation from each state to each
state; neighbours are joined pairwise by the same order. Only letters are joined, never texts: the texts meet their
edits again in a sorted stream, which keeps one batch. A conversation's digest is one SHA-256 over its turns in order,
so that last stream, of no more than hashing, passes through one task per conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .registry import query, table

#: Rows of one conversation that one agenda takes at a time.
STRETCH = 1024
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: What an undeleted truncated row adds.
CUT_SHORT = 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_WHITE = " \t\n\x0b\f\r"
_FOLLOWS = {"-": "u", "s": "u", "u": "a", "a": "u"}
_MAY_KEEP = {"-": "su", "s": "u", "u": "a", "a": "u"}
_NAME = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}

Weights = dict[tuple[str, str], tuple[int, str]]


def lightest(roles: str, faults: list[int], start: str = "-", goal: str = "") -> Weights:
    """Lightest derivations of a stretch from a state, by (start, end). With a goal (states), only the first of it."""
    agenda, final, out = [(0, 0, "", start)], set(), {}
    while agenda:
        cost, i, audit, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        follows = _FOLLOWS[q]
        if i == len(roles):
            out[start, q] = (cost, audit)
            if q in goal:
                return {(start, q): (cost, audit)}
        else:
            role, fault = roles[i], faults[i]
            heapq.heappush(agenda, (cost + DELETE, i + 1, audit + "D", q))
            if fault not in (BLANK, DUPLICATE):
                more = CUT_SHORT if fault == TRUNCATED else 0
                if role in _MAY_KEEP[q]:
                    heapq.heappush(agenda, (cost + KEEP + more, i + 1, audit + "K", role))
                heapq.heappush(agenda, (cost + REROLE + more, i + 1, audit + "R", follows))
        if (i, follows) not in final:
            heapq.heappush(agenda, (cost + INSERT, i, audit + "I", follows))
    return out


def compose(a: Weights, b: Weights) -> Weights:
    """Lightest derivations of two neighbouring stretches together."""
    out: Weights = {}
    for (p, m), (c1, x) in a.items():
        for (n, q), (c2, y) in b.items():
            if m == n and ((p, q) not in out or (c1 + c2, x + y) < out[p, q]):
                out[p, q] = (c1 + c2, x + y)
    return out


def compose_all(stretches: list[Weights]) -> Weights:
    """Pairwise, halves of equal size, so that letters are copied a logarithmic number of times."""
    while len(stretches) > 1:
        stretches = [compose(*pair) if len(pair) == 2 else pair[0] for pair in (stretches[k : k + 2] for k in range(0, len(stretches), 2))]
    return stretches[0]


def split_audit(audit: str, roles: list[str]) -> list[tuple[str, str]]:
    """State before each stretch and the letters of its rows; insertions behind the last row go to the last stretch."""
    out, state, at = [], "-", 0
    for k, stretch in enumerate(roles):
        before, first, j = state, at, 0
        while j < len(stretch):
            letter, at = audit[at], at + 1
            state = _FOLLOWS[state] if letter in "IR" else stretch[j] if letter == "K" else state
            j += letter != "I"
        at = len(audit) if k == len(roles) - 1 else at
        out.append((before, audit[first:at]))
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged conversations: by crc32 of "conv_id:turn" modulo 20 a row is dropped (0), loses its
    text (1) or its `.!?` (2), comes twice (3) or speaks as user (4). Nulls in role, text and that key count as one space."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *part).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    d = d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time"))
    return d.drop("time")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers sorted rows: a stretch holds rows of one conversation; numbers rise in the order of the rows."""
    part = TaskContext.get().partitionId() << 32
    number, size, last = -1, 0, object()
    for b in batches:
        chunk, pos = [], []
        for conv in b.column(0).to_pylist():
            if conv != last or size == STRETCH:
                number, size, last = number + 1, 0, conv
            chunk.append(part + number)
            pos.append(size)
            size += 1
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(pos, pa.int64()), *b.columns], ["chunk", "pos", *b.schema.names])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_WEIGHT = pa.list_(pa.struct([("p", pa.string()), ("q", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_SOLVED = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("roles", pa.string()), ("weights", _WEIGHT), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())])
SOLVED = "conv_id long, chunk long, roles string, weights array<struct<p: string, q: string, cost: long, audit: string>>, blank long, duplicate long, truncated long"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, pos, conv_id, role's initial, fault, first and last stretch of the conversation) -> a row per stretch."""

    def solved():
        for chunk, rows in groupby(_rows(batches), lambda r: r[0]):
            rows = list(rows)
            roles, faults = "".join(r[3] for r in rows), [r[4] for r in rows]
            conv, first, last = rows[0][2], rows[0][5], rows[0][6]
            if first == last:
                found = lightest(roles, faults, "-", "-a")
            else:
                found = {}
                for p in "-" if chunk == first else "-sua":
                    found |= lightest(roles, faults, p)
            w = [{"p": p, "q": q, "cost": c, "audit": x} for (p, q), (c, x) in found.items()]
            yield conv, chunk, roles, w, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED)

    yield from _batches(solved(), _SOLVED)


_EDITS = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("state", pa.string()), ("edits", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
EDITS = "conv_id long, chunk long, state string, edits string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a conversation in order -> the edits of each; the last one carries the conversation's totals."""

    def edits():
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            _, chunks, roles, weights, *faults = zip(*rows)
            whole = compose_all([{(w["p"], w["q"]): (w["cost"], w["audit"]) for w in x} for x in weights])
            cost, audit = min(v for (p, q), v in whole.items() if p == "-" and q in "-a")
            all_roles = "".join(roles)
            illegal = sum(x + y not in _LEGAL for x, y in zip(all_roles, all_roles[1:]))
            for k, (chunk, (state, mine)) in enumerate(zip(chunks, split_audit(audit, list(roles)))):
                totals = (*(sum(f) for f in faults), illegal, cost, audit) if k == len(chunks) - 1 else (None,) * 6
                yield conv, chunk, state, mine, *totals

    yield from _batches(edits(), _EDITS, 500)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str | None]]:
    """(conv_id, role, text) of repaired turns, and (conv_id, None, None) at the end of each conversation."""
    for conv, rows in groupby(_rows(batches), lambda r: r[0]):
        state, letters = "-", iter("")
        for _, _, pos, role, text, before, edits in rows:
            if pos < 0:  # a stretch's edits come before its rows
                state, letters = before, iter(edits)
                continue
            for letter in letters:
                if letter == "I":
                    state = _FOLLOWS[state]
                    yield conv, _NAME[state], ""
                    continue
                if letter == "K":
                    state = role[:1]
                    yield conv, role, text
                elif letter == "R":
                    state = _FOLLOWS[state]
                    yield conv, _NAME[state], text
                break
        for _ in letters:  # insertions behind the last row
            state = _FOLLOWS[state]
            yield conv, _NAME[state], ""
        yield conv, None, None


_TURNS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def turns():
        at = 0
        for conv, role, text in _repaired(batches):
            if role is not None:
                yield conv, at, role, text
            at = 0 if role is None else at + 1

    yield from _batches(turns(), _TURNS, 500)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests():
        h, first = hashlib.sha256(), True
        for conv, role, text in _repaired(batches):
            if role is None:
                yield conv, h.hexdigest()
                h, first = hashlib.sha256(), True
            else:
                h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

    yield from _batches(digests(), _DIGESTS)


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows in order, cut into stretches, and the edits of every stretch."""
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    r = r.withColumn("digest", F.md5("text"))
    order = ["conv_id", "turn", "role", "digest"]
    r = r.repartitionByRange(*order).sortWithinPartitions(*order)
    r = cut_lineage(r.mapInArrow(_stretches, "chunk long, pos long, conv_id long, turn long, role string, text string, digest string"))
    here = F.struct("chunk", "pos")
    seen = r.groupBy("conv_id", "role", "digest").agg(F.min(here).alias("seen"))
    ends = r.groupBy("conv_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    bare = F.rtrim("text", F.lit(_WHITE))
    a = r.select("chunk", "pos", "conv_id", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated")).alias("a")
    a = a.join(seen.alias("s"), F.expr("a.conv_id <=> s.conv_id and a.role = s.role and a.digest = s.digest")).join(ends.alias("e"), F.expr("a.conv_id <=> e.conv_id"))
    initial = F.when(F.left(F.col("a.role"), F.lit(1)).isin("s", "u", "a"), F.left(F.col("a.role"), F.lit(1))).otherwise("?")
    fault = F.when(F.col("blank"), BLANK).when(F.struct("a.chunk", "a.pos") > F.col("seen"), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(0)
    flagged = a.select("a.chunk", "a.pos", F.col("a.conv_id").alias("conv_id"), initial.alias("role"), fault.cast("int").alias("fault"), "first", "last")
    solved = flagged.repartition("chunk").sortWithinPartitions("chunk", "pos").mapInArrow(_solve, SOLVED)
    return r, cut_lineage(solved.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_join_up, EDITS))


def _stream(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each stretch's edits followed by its rows, conversations in one piece."""
    a = rows.select("conv_id", "chunk", "pos", "role", "text", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("edits"))
    b = edits.select("conv_id", "chunk", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "state", "edits")
    return a.unionByName(b).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "pos")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, at (from 0), role, text of the repaired conversations; repaired to nothing, a conversation has no rows."""
    return _stream(*plan(rows)).mapInArrow(_turn_rows, "conv_id long, at long, role string, text string")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row per conversation of `rows`, and
    of `conversations` where given (a frame with conv_id), whose conversations without rows have zeros and an empty audit.

    Rows are ordered by turn (nulls first), then role, then the text's md5. Null roles and texts count as one space, a
    null conv_id is a conversation of its own. Of equal rows all but the first are duplicates. Other columns play no
    part. An empty table gives no rows, long texts are taken whole. A conversation's span of turns that 64 bits cannot hold gives null gaps.
    """
    ordered, edits = plan(rows)
    digests = _stream(ordered, edits).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    wide = [F.col(c).cast("decimal(38,0)") for c in ("high", "low")]
    gaps = ordered.groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("turns"))
    gaps = gaps.select("conv_id", F.when(F.col("turns") == 0, 0).otherwise((wide[0] - wide[1] + 1 - F.col("turns")).try_cast("long")).alias("gaps"))
    parts = [gaps, edits.where(F.col("cost").isNotNull()).drop("chunk", "state", "edits"), digests]
    if conversations is not None:
        parts.append(conversations.select(F.col("conv_id").cast("long").alias("conv_id")))
    every = parts[0].withColumn("found", F.lit(True))
    for x in parts[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    one = every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*counts, "audit", "repaired_sha256", "found"]])
    zero = F.lit(0).cast("long")
    return one.select(
        "conv_id", F.when(F.col("found").isNull(), zero).otherwise(F.col("gaps")).alias("gaps"), *[F.coalesce(c, zero).alias(c) for c in counts[1:]],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _edit(state: str, cost: str, letter: str, line: str, when: str = "true") -> str:
    return f"case when {when} and {state} is not null then {{'c': {state}.c + {cost}, 'd': {state}.d || '{letter}', 'x': {state}.x || {line}}} end"


_ME, _USER, _ASSISTANT = "chr(10) || f.role || ':' || f.text", "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_KEPT, _TURNED = "case when f.cut then 5 else 0 end", "case when f.cut then 6 else 1 end"


def _best(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


SQL = rf"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    flatten([[(ord(c) >> b) & 1 for b in range(8)] for c in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')]) as bits from conversations),
kinds as (select conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bits::bigint[]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) % 20 as kind from raw),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as time from kinds where kind <> 0),
placed as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from damaged),
tests as (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as open_end, lag(role) over (partition by conv_id order by i) as before from placed),
f as (select conv_id, i, role, text, left(role, 1) as r, blank or again as out, blank as is_blank, again and not blank as is_again, open_end and not blank and not again as cut,
    before is not null and (left(before, 1) || left(role, 1)) not in ('su', 'ua', 'au') as odd, turn from tests),
best as (select distinct conv_id, 0::bigint as i, {{'c': 0, 'd': '', 'x': ''}} as z, null::struct(c integer, d varchar, x varchar) as s, null::struct(c integer, d varchar, x varchar) as u, null::struct(c integer, d varchar, x varchar) as a from f
  union all
  select b.conv_id, f.i,
    {_edit("b.z", "2", "D", "''")},
    {_best(_edit("b.s", "2", "D", "''"), _edit("b.z", _KEPT, "K", _ME, "f.r = 's' and not f.out"))},
    {_best(_edit("b.iu", "2", "D", "''"), _edit("b.eu", _KEPT, "K", _ME, "f.r = 'u' and not f.out"), _edit("b.eu", _TURNED, "R", "chr(10) || 'user:' || f.text", "not f.out"))},
    {_best(_edit("b.ia", "2", "D", "''"), _edit("b.iu", _KEPT, "K", _ME, "f.r = 'a' and not f.out"), _edit("b.iu", _TURNED, "R", "chr(10) || 'assistant:' || f.text", "not f.out"))}
  from (select *, {_best("z", "s", "ia")} as eu from (select *, {_best("u", _edit("z", "5", "I", _USER), _edit("s", "5", "I", _USER), _edit("a", "5", "I", _USER))} as iu, {_best("a", _edit("u", "5", "I", _ASSISTANT))} as ia from best)) b
  join f on f.conv_id is not distinct from b.conv_id and f.i = b.i + 1),
ends as (select conv_id, {_best("z", "a", _edit("iu", "5", "I", _ASSISTANT))} as w from (select *, {_best("u", _edit("z", "5", "I", _USER), _edit("s", "5", "I", _USER))} as iu from best)
  qualify row_number() over (partition by conv_id order by i desc) = 1),
counts as (select conv_id, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, sum(is_blank::int) as blank, sum(is_again::int) as duplicate, sum(cut::int) as truncated, sum(odd::int) as illegal from f group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(w.c, 0)::bigint as cost, coalesce(w.d, '') as audit, sha256(coalesce(w.x[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts on counts.conv_id is not distinct from c.conv_id left join ends on ends.conv_id is not distinct from c.conv_id
"""


@query("op11_lightest_repair", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damage(conversations), conversations)
