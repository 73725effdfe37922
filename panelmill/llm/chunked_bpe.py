"""BPE encoding with content-defined chunks that are encoded once.

Texts are cut where a rolling hash of 16 bytes meets a pattern, so equal passages give equal chunks wherever they
stand. Chunks found in several documents are encoded once, in the document with the smallest id that holds them; the
ids travel to the other documents by the chunk's hash. A chunk's ids hold for the chunk alone, so every join of two
chunks is repaired: the stretch from the last safe cut before the join to the first safe one behind it is encoded
anew, and both chunks must agree with it there; where they don't, the stretch grows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SLICE_BYTES, byte_column, slices
from .encoder import Encoder, alphabet, encoder
from .registry import query, table

#: A chunk ends where these bits of the rolling hash are zero (1 KB on average), but not before LEAST bytes.
MASK = np.uint32(((1 << 10) - 1) << 22)
LEAST = 64
_rng = np.random.default_rng(11)
_GEAR = _rng.integers(0, 2**32, 256, np.uint32)
_STEP = np.uint32(0x9E3779B1)
_SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")


def boundaries(data: np.ndarray) -> np.ndarray:
    """Positions behind which a chunk may end: by the 16 bytes before, and only in front of a whole character."""
    h, m = _GEAR[data], _STEP
    for k in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[k:] += h[:-k] * m
        h, m = nxt, np.uint32(int(m) * int(m) & 0xFFFFFFFF)
    at = np.flatnonzero((h & MASK) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def cut(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per text its chunks as byte ranges. Without bytes a text has none."""
    at = boundaries(data).tolist() if len(data) else []
    out, k = [], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        chunks, start = [], a
        while k < len(at) and at[k] < b:
            if at[k] - start >= LEAST:  # also keeps the window inside this text
                chunks.append((start, at[k]))
                start = at[k]
            k += 1
        if b > start:
            chunks.append((start, b))
        out.append(chunks)
    return out


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed; null counts as empty."""
    z = zstandard.ZstdCompressor(3, write_content_size=True)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(x.as_buffer() if x.is_valid else b"") for x in b.column(1)], pa.binary())], ["doc_id", "packed"])


def _loosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches with their texts back, a bounded number of bytes at a time."""
    z = zstandard.ZstdDecompressor()
    for b in batches:
        at, texts, size = 0, [], 0
        for i, x in enumerate(b.column(1).to_pylist()):
            texts.append(z.decompress(x))
            size += len(texts[-1])
            if size >= SLICE_BYTES // 4 or i == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, i + 1 - at), pa.array(texts, pa.binary()).cast(pa.string()), b.column(2).slice(at, i + 1 - at)], ["doc_id", "text", "given"])
                at, texts, size = i + 1, [], 0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        data, offsets = byte_column(b.column(1))
        raw = data.tobytes()
        got = [list({xxhash.xxh3_128_digest(raw[x:y]) for x, y in chunks}) for chunks in cut(data, offsets)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.binary()))], ["doc_id", "hashes"])


def _encode_shared(vocabulary: str, ranks: str | None):
    """The listed chunks of each document, encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, ranks)
        for b in _loosen(batches):
            data, offsets = byte_column(b.column(1))
            raw = data.tobytes()
            hashes, texts = [], []
            for chunks, wanted in zip(cut(data, offsets), b.column(2).to_pylist()):
                wanted = set(wanted)
                for x, y in chunks:
                    h = xxhash.xxh3_128_digest(raw[x:y])
                    if h in wanted:
                        wanted.discard(h)
                        hashes.append(h)
                        texts.append(raw[x:y].decode())
            ids, counts = e.encode(texts)
            parts = np.split(ids.astype("<i4"), np.cumsum(counts)[:-1]) if len(counts) else []
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([_small(p) for p in parts], pa.binary())], ["hash", "ids"])

    return run


def _small(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where all of them fit, else in four; the first byte says which."""
    raw = b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 65536 else b"\x04" + ids.astype("<u4").tobytes()
    return zstandard.compress(raw, 3)


def _large(packed: bytes) -> np.ndarray:
    blob = zstandard.decompress(packed)
    return np.frombuffer(blob, "<u2" if blob[:1] == b"\x02" else "<u4", offset=1).astype(np.int32)


def repaired(e: Encoder, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """Ids of the joined text from the ids of its chunks."""
    done: list[np.ndarray] = []
    text, own = texts[0], ids[0]  # what is open on the left: its text and ids, not yet in `done`
    for right, right_ids in zip(texts[1:], ids[1:]):
        first = _SAFE.search(right)
        head = right[: first.start()] if first else right
        merged = False
        cuts = [m.start() for m in _SAFE.finditer(text, max(0, len(text) - 64))] or [m.start() for m in _SAFE.finditer(text)]
        while cuts:  # from the last safe cut to the left, until the ids agree there
            at = cuts.pop()
            tail = text[at:]
            (a, b, mid), n = _three(e, tail, head, tail + head)
            if len(a) <= len(own) and (own[len(own) - len(a) :] == a).all() and len(b) <= len(right_ids) and (right_ids[: len(b)] == b).all():
                done.append(own[: len(own) - len(a)])
                done.append(mid)
                if first:
                    text, own = right[first.start() :], right_ids[len(b) :]
                else:
                    done.pop()
                    text, own = tail + head, mid
                merged = True
                break
        if not merged:
            text = text + right
            own = e.encode([text])[0].astype(np.int32)
    done.append(own)
    return np.concatenate(done)


def _three(e: Encoder, *texts: str):
    ids, counts = e.encode(list(texts))
    return np.split(ids, np.cumsum(counts)[:-1]), counts


def _assemble(vocabulary: str, ranks: str | None, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, ranks)
        for b in _loosen(batches):
            data, offsets = byte_column(b.column(1))
            raw = data.tobytes()
            plans, unknown = [], []
            for chunks, shared in zip(cut(data, offsets), b.column(2).to_pylist()):
                known = {x["hash"]: x["ids"] for x in shared} if shared else {}
                plan = []
                for x, y in chunks:
                    blob = known.get(xxhash.xxh3_128_digest(raw[x:y])) if known else None
                    text = raw[x:y].decode()
                    plan.append((text, None if blob is None else _large(blob)))
                # Neighbours that are nobody else's are encoded as one stretch.
                joined: list[list] = []
                for text, ids in plan:
                    if ids is None and joined and joined[-1][1] is None:
                        joined[-1][0] += text
                    else:
                        joined.append([text, ids])
                plans.append(joined)
                unknown += [j for j in joined if j[1] is None]
            ids, counts = e.encode([j[0] for j in unknown])
            if unknown:
                for j, part in zip(unknown, np.split(ids, np.cumsum(counts)[:-1])):
                    j[1] = part
            out = [repaired(e, [j[0] for j in p], [j[1] for j in p]) if len(p) > 1 else p[0][1] if p else np.empty(0, np.int32) for p in plans]
            yield finish(b.column(0), out)

    return run


def _as_lists(doc_ids, ids: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])


def encode_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", finish=_as_lists, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, one row per input row.

    finish turns ids of a batch and their documents into rows of `schema`, in the task that encodes them.

    Null and empty texts have no ids. Rows with a null id are encoded by themselves; rows that repeat an id are each
    encoded by their own text. Other columns are ignored. Chunks are equal when their 128-bit hashes are.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    places = cut_lineage(d.where(F.col("doc_id").isNotNull()).mapInArrow(_sketch, "doc_id long, hashes array<binary>").select("doc_id", F.explode("hashes").alias("hash")))
    shared = places.groupBy("hash").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("other")).where("home < other")
    # Both joins read the same exchange of the texts: a key without nulls keeps the joins' filters off it.
    by_id = d.mapInArrow(_squeeze, "doc_id long, packed binary").withColumn("k", F.coalesce("doc_id", F.lit(-(2**63)))).repartition("k")
    homes = shared.groupBy(F.col("home").alias("k")).agg(F.collect_list("hash").alias("given"))  # as many as the document has chunks
    coded = by_id.join(homes, "k").select("doc_id", "packed", "given").mapInArrow(_encode_shared(vocabulary, ranks), "hash binary, ids binary").groupBy("hash").agg(F.any_value("ids").alias("ids"))
    given = places.join(coded, "hash").groupBy(F.col("doc_id").alias("k")).agg(F.collect_list(F.struct("hash", "ids")).alias("given"))
    return by_id.join(given, "k", "left").select("doc_id", "packed", "given").mapInArrow(_assemble(vocabulary, ranks, finish), schema)


_decoders: dict[str, tuple[list[bytes], list[bytes]]] = {}


def _decoder(vocabulary: str) -> tuple[list[bytes], list[bytes]]:
    """Bytes and decimal text of every id."""
    if vocabulary not in _decoders:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        byte = {c: i for i, c in enumerate(alphabet())}
        _decoders[vocabulary] = [bytes(byte[c] for c in tokens[i]) for i in range(len(tokens))], [str(i).encode() for i in range(len(tokens))]
    return _decoders[vocabulary]


def decode(ids: list[int], vocabulary: str) -> str:
    """Text of ids, as the library's decode with special tokens kept: broken UTF-8 becomes replacement characters."""
    return b"".join(map(_decoder(vocabulary)[0].__getitem__, ids)).decode("utf-8", "replace")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_rows(vocabulary: str):
    """Digests of ids and of the text they decode to."""

    def rows(doc_ids, ids: list[np.ndarray]) -> pa.RecordBatch:
        decimal = _decoder(vocabulary)[1]
        a, t = [], []
        for x in ids:
            own = x.tolist()
            a.append(hashlib.sha256(b",".join(map(decimal.__getitem__, own))).hexdigest())
            t.append(hashlib.sha256(decode(own, vocabulary).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array(a, pa.string()), pa.array(t, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows


def encode_digests(docs: DataFrame) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return encode_documents(docs, vocabulary, public_tokenizers.path("byte_bpe_50k.tiktoken"), finish=digest_rows(vocabulary), schema=DIGESTS)


@query("op2_chunked_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
