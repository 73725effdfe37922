"""WARC archives through a chunked record table.

A payload is never copied whole: it is cut into (record, chunk number) rows, each with the digest of all bytes so far
(the running hash is copied, not restarted). The writer turns chunk rows into record-wise gzip members; the reader
streams archive files back into the same table, checking lengths and digests as the bytes pass.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .files import Attempt, new_folder, resolve
from .registry import query, table

CHUNK = 256 << 10
#: An archive file is closed after the record that takes it past this many compressed bytes.
FILE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
CHUNK_SCHEMA = "page_id long, record_type string, refers_to long, url string, chunk_no long, last boolean, n_bytes long, payload_bytes long, chunk binary, digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks(payload: memoryview, size: int = CHUNK) -> Iterator[tuple[int, memoryview, str, bool]]:
    """Chunk number, bytes, base-32 SHA-1 of everything up to here, whether it is the last. Empty: one empty chunk."""
    sha = hashlib.sha1()
    n = max(1, -(-len(payload) // size))
    for k in range(n):
        part = payload[k * size : (k + 1) * size]
        sha.update(part)
        yield k, part, base32(sha.copy().digest()), k == n - 1


def record_head(page_id, record_type: str, refers_to, url, digest: str, payload_bytes: int) -> bytes:
    """Header block of a record; a revisit has no body and names the response that has the same payload."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")  # no line breaks in a header
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {payload_bytes}"]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if record_type == 'revisit' else payload_bytes}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out, names, counts = TaskContext.get().partitionId(), 0, None, [], []
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(b.column(i) for i in range(5))):
                if out is None:
                    out = Attempt(folder, f"part-{part:06d}-{made:05d}.warc.gz")
                    names.append(out.uri)
                    counts.append(0)
                    made += 1
                payload = memoryview(html.as_buffer() or b"") if html.is_valid else memoryview(b"")
                kind = "response" if refers_to.as_py() is None else "revisit"
                z = zlib.compressobj(3, wbits=31)
                out.write(z.compress(record_head(page_id.as_py(), kind, refers_to.as_py(), url.as_py(), base32(bytes.fromhex(digest.as_py())), len(payload))))
                if kind == "response":
                    for _, bytes_, _, _ in chunks(payload):
                        out.write(z.compress(bytes_))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                counts[-1] += 1
                if out.size >= limit:
                    out.commit()
                    out = None
        if out is not None:
            out.commit()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return run


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = 0) -> DataFrame:
    """page_id, url, html, digest, refers_to: refers_to is null for responses.

    Of equal payloads of at least `least` bytes the smallest id stays a response. Equality means equal SHA-1 and length.
    Digests are compared without the payloads; only their ids meet the pages again.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = p.select("page_id", F.sha1("html").alias("d"), F.octet_length("html").alias("n")).where(F.col("page_id").isNotNull() & (F.col("n") >= least))
    first = keyed.groupBy("d", "n").agg(F.min("page_id").alias("to"), F.max("page_id").alias("last")).where("to < last").drop("last")
    revisits = keyed.join(first, ["d", "n"]).where("page_id > to").select("page_id", "d", "to").distinct()
    return p.withColumn("digest", F.sha1("html")).join(revisits.withColumnRenamed("d", "digest"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", F.col("to").alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, limit: int = FILE_BYTES) -> DataFrame:
    """Writes one record per row and returns file, records. Null payloads are empty; a null id is written as `null`,
    never refers and is never referred to. Rows that repeat an id with the same payload have the same record type.
    """
    rows = with_revisits(pages, id_col, url_col, html_col, least)
    return cut_lineage(rows.mapInArrow(_write(folder, limit), "file string, records long"))


def stream_members(raw, size: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """The gzip members of an open file, each as an iterator over its inflated bytes."""
    rest = raw.read(size)
    while rest:
        z = zlib.decompressobj(wbits=31)
        state = [rest]

        def member(z=z, state=state):
            data = state[0]
            while not z.eof:
                if not data:
                    data = raw.read(size)
                    if not data:
                        raise EOFError("archive ends inside a record")
                yield z.decompress(data, size)
                data = z.unconsumed_tail if not z.eof else z.unused_data
            state[0] = data

        yield member()
        rest = state[0] or raw.read(size)


def read_record(member: Iterator[bytes]) -> Iterator[tuple[dict[str, str], int, bytes, str, bool]]:
    """Headers, chunk number, chunk, digest so far, last: for one record, holding one chunk at a time."""
    buffer = b""
    for data in member:
        buffer += data
        if b"\r\n\r\n" in buffer:
            break
    head, _, buffer = buffer.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    left, sha, k, n = int(headers["Content-Length"]), hashlib.sha1(), 0, 0
    while True:
        while len(buffer) < min(left, CHUNK):
            data = next(member, None)
            if data is None:
                raise EOFError("record shorter than its Content-Length")
            buffer += data
        part, buffer = buffer[: min(left, CHUNK)], buffer[min(left, CHUNK) :]
        sha.update(part)
        left -= len(part)
        n += len(part)
        last = left == 0
        yield headers, k, part, base32(sha.copy().digest()), last
        k += 1
        if last:
            break
    for data in member:
        buffer += data
    if buffer != b"\r\n\r\n":
        raise ValueError("record doesn't end where its Content-Length says")


def _page(name: str | None) -> int | None:
    return None if name in (None, "<urn:page:null>") else int(name[10:-1])


def _read(with_bytes: bool):
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()),
                        ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("chunk", pa.binary()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for uri in b.column(0).to_pylist():
                where, path = resolve(uri)
                with where.open_input_stream(path, compression=None) as raw:
                    for member in stream_members(raw):
                        for h, k, part, digest, last in read_record(member):
                            kind, size = h["WARC-Type"], int(h["WARC-Payload-Length"])
                            claimed = h["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "revisit":
                                digest = claimed
                            elif last and digest != claimed:
                                raise ValueError(f"{uri}: {h['WARC-Record-ID']} fails its digest")
                            rows.append((_page(h["WARC-Record-ID"]), kind, _page(h.get("WARC-Refers-To")), h["WARC-Target-URI"], k, last, len(part), size, part if with_bytes else None, digest))
                            held += len(part) * with_bytes + 64
                            if held > (8 << 20):
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archive(files: DataFrame, with_bytes: bool = True) -> DataFrame:
    """The record table of archive files (column file): page_id, record_type, refers_to, url, chunk_no, last, n_bytes,
    payload_bytes, chunk, digest (of all bytes up to this chunk; a revisit's is the claimed one). A broken length or
    digest is an error.
    """
    spread = files.select("file").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "file")
    return spread.mapInArrow(_read(with_bytes), CHUNK_SCHEMA)


def records(chunk_table: DataFrame) -> DataFrame:
    """One row per record: its last chunk carries the digest of the whole payload."""
    return chunk_table.where("last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


SQL = """
with h as (select page_id, strlen(coalesce(html, '')) as n, unhex(sha1(coalesce(html, ''))) as d from pages),
f as (select d, n, min(page_id) as first from h group by 1, 2),
b as (select h.*, first, list_reduce(list_transform(range(0, 20), lambda i: ('0x' || substr(hex(d), 2 * i + 1, 2))::int::varchar), lambda x, y: x || ',' || y) as bytes from h join f using (d, n)),
q as (select *, list_transform(string_split(bytes, ','), lambda x: lpad(bin(x::int), 8, '0')) as bits from b)
select page_id, n as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: substr(array_to_string(bits, ''), 5 * i + k + 1, 1)::int * (1 << (4 - k)::int)))::int, 1)), '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from q
"""


@query("op8_warc_chunks", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archive(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return records(read_archive(files, with_bytes=False))
