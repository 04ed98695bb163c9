"""WARC archives as a chunked record table.

A payload is never one value in a Python worker: it travels as rows of record
and chunk number, at most ``chunk_bytes`` each. The writer appends chunks to a
gzip member as they arrive; the reader inflates a member bit by bit and yields
chunk rows again, each with the digest and the length of the payload so far.

Of records with equal payloads the one with the smallest page_id is a
``response``; others become ``revisit`` records (identical-payload-digest),
whose block holds only the HTTP head, with the payload's length. Which is which
is decided from digests alone, with map-side partial aggregation; the payloads
are shuffled once, by page, so a payload that a third of all pages share
doesn't meet in one task.

Archives go to the shared folder through Arrow's file systems, one a task
attempt. A manifest table names segments of some megabytes of each committed
archive, so that the archives are read in parallel; files of attempts that
failed are in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, small_batches, table

CHUNK_BYTES = 64 << 10
SEGMENT_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, start long, length long, records long"
CHUNKS = "page_id long, record_type string, refers_to long, url string, declared_bytes long, declared_digest string, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def _open(path: str):
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_head(row, kind: str, nth: int, date: str) -> bytes:
    """The WARC head and the HTTP head of a record; its payload, if it is a response, follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    name = lambda page, k: f"<urn:page:{'null' if pd.isna(page) else int(page)}:{row.sha1}:{k}>"
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(row.page_id, nth)}", f"WARC-Date: {date}"]
    if row.url is not None:
        fields.append(f"WARC-Target-URI: {_safe(row.url)}")
    fields.append(f"WARC-Payload-Digest: sha1:{_base32(bytes.fromhex(row.sha1))}")
    if kind == "revisit":
        fields += [f"WARC-Refers-To: {name(row.response_id, 0)}", f"WARC-Profile: {PROFILE}"]
    block = len(http) + (row.payload_bytes if kind == "response" else 0)
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def chunked(pages: DataFrame, chunk_bytes: int, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per chunk of a payload (a payload of no bytes has one, empty), with what its record is to be."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("page_id", "url", "row", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload", F.coalesce("page_id", F.lit(0)).alias("id0"), F.col("page_id").isNull().alias("no_id"))
    heads = rows.select("page_id", "id0", "no_id", "sha1", "row")
    least = heads.groupBy("sha1").agg(F.min("page_id").alias("response_id"))
    role = heads.join(least, "sha1").groupBy("id0", "no_id", "sha1").agg(
        F.first("response_id").alias("response_id"),
        F.first("page_id").eqNullSafe(F.first("response_id")).alias("is_response"),
        F.min("row").alias("first_row"),
    )
    # Chunks are cut one by one: a task never has an array of all chunks of a payload.
    chunks = rows.withColumn("chunk_no", F.explode(F.expr(f"sequence(0, cast(greatest(0, (payload_bytes - 1) div {chunk_bytes}) as int))")))
    data = F.expr(f"substring(payload, cast(chunk_no * {chunk_bytes}L + 1 as int), {chunk_bytes})")
    chunks = chunks.select("page_id", "id0", "no_id", "sha1", "url", "row", "payload_bytes", "chunk_no", data.alias("data"))
    # A row's chunks come from one task and have one key, so however the join is done they stay together; rows may go anywhere.
    return chunks.join(role, ["id0", "no_id", "sha1"]).sortWithinPartitions("row", "chunk_no")


def write_archives(
    pages: DataFrame,
    scratch: Scratch,
    chunk_bytes: int = CHUNK_BYTES,
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write a record per row of ``pages`` into archives; return the manifest.

    * a null html is an empty payload; a null url leaves out the target;
    * payloads under ``min_bytes`` are all responses;
    * rows alike in page_id and payload: the first is as above, the others
      revisit it; a null page_id counts as larger than all others;
    * an empty table writes no archive.
    """
    small_batches(pages.sparkSession, 256)
    chunks = chunked(pages, chunk_bytes, min_bytes, id_col, url_col, html_col)
    base = scratch.path("warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, out, packer = None, None, None
        at, start, records, done = 0, 0, 0, []
        path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        kind = ""

        def put(data: bytes) -> None:
            nonlocal at
            out.write(data)
            at += len(data)

        def close_record() -> None:
            nonlocal packer, start, records
            put(packer.compress(b"\r\n\r\n") + packer.flush())
            packer, records = None, records + 1
            if at - start >= SEGMENT_BYTES:
                done.append((path, start, at - start, records))
                start, records = at, 0

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if out is None:
                    files, local = _open(path)
                    files.create_dir(local.rpartition("/")[0])
                    out = files.open_output_stream(local, compression=None)
                if row.chunk_no == 0:
                    if packer is not None:
                        close_record()
                    first = row.row == row.first_row
                    kind = "response" if row.is_response and first or row.payload_bytes < min_bytes else "revisit"
                    nth = 0 if first else row.row + 1
                    packer = zlib.compressobj(4, wbits=31)
                    put(packer.compress(record_head(row, kind, nth, date)))
                if kind == "response":
                    put(packer.compress(row.data))
        if out is not None:
            close_record()
            out.close()
            if at > start:
                done.append((path, start, at - start, records))
        yield pd.DataFrame(done, columns=["path", "start", "length", "records"]).astype({"start": "int64", "length": "int64", "records": "int64"})

    return scratch.keep(chunks.mapInPandas(write, MANIFEST), "manifest")


class _Member:
    """Bytes of one archive segment, inflated on demand."""

    def __init__(self, source, length: int):
        self.source, self.left, self.raw, self.text = source, length, b"", b""
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        if not self.raw and self.left:
            self.raw = bytes(self.source.read(min(self.left, 64 << 10)))
            self.left -= len(self.raw)
        if not self.raw:
            return False
        self.text += self.inflate.decompress(self.raw, 256 << 10)
        self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def head(self) -> list[str] | None:
        while (end := self.text.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        lines, self.text = self.text[:end].decode().split("\r\n"), self.text[end + 4 :]
        return lines

    def take(self, n: int) -> bytes:
        while len(self.text) < n:
            if not self.more():
                raise ValueError("an archive ends within a record")
        out, self.text = self.text[:n], self.text[n:]
        return out


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(name: str | None) -> int | None:
    return None if not name or name.split(":")[2] == "null" else int(name.split(":")[2])


def read_segment(path: str, start: int, length: int, chunk_bytes: int, data: bool) -> Iterator[tuple]:
    files, local = _open(path)
    with files.open_input_file(local) as source:
        source.seek(start)
        member = _Member(source, length)
        while (lines := member.head()) is not None:
            warc = _fields(lines)
            http = _fields(member.head())
            kind, declared = warc["warc-type"], int(http["content-length"])
            digest = warc["warc-payload-digest"].removeprefix("sha1:")
            same = (_page(warc["warc-record-id"]), kind, _page(warc.get("warc-refers-to")), warc.get("warc-target-uri"), declared, digest)
            left, so_far, sha = declared if kind == "response" else 0, 0, hashlib.sha1()
            for n in range(max(1, -(-left // chunk_bytes))):
                chunk = member.take(min(left, chunk_bytes))
                sha.update(chunk)
                left, so_far = left - len(chunk), so_far + len(chunk)
                now = _base32(sha.digest())
                if kind == "response" and not left and now != digest:
                    raise ValueError(f"the payload of page {same[0]} doesn't have its digest")
                yield (*same, n, chunk if data else None, so_far, now, not left)
            if member.take(4) != b"\r\n\r\n":
                raise ValueError("a record isn't as long as it says")


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """Chunk rows of the archives' records: record, chunk number, bytes, and the length and digest so far.

    A revisit has one row without payload; ``declared_bytes`` and
    ``declared_digest`` are those of the full payload. A payload whose digest
    isn't the declared one raises. ``data=False`` leaves the bytes out.
    """
    spark = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = {"page_id": "Int64", "refers_to": "Int64", "declared_bytes": "int64", "chunk_no": "int32", "bytes_so_far": "int64"}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                rows, held = [], 0
                for row in read_segment(s.path, s.start, s.length, chunk_bytes, data):
                    rows.append(row)
                    held += len(row[7] or b"") + 200
                    if held >= 4 << 20:
                        yield pd.DataFrame(rows, columns=names).astype(kinds)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(kinds)

    return manifest.repartition(tasks, "path", "start").mapInPandas(read, CHUNKS)


def op2_chunked_records(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    chunks = read_chunks(write_archives(table(spark, sf_dir, "pages"), scratch, min_bytes=0), data=False)
    ends = chunks.where("last")
    response = F.col("record_type") == "response"
    return ends.select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


#: Base32 from SHA-1 in hexadecimal: each five hexadecimal digits are four characters.
_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((CAST('0x' || substr(sha, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * j}) & 31) + 1), 1)" for g in range(8) for j in range(4)
)
OP2_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS sha FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha) AS least FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32_SQL} AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM q
"""
