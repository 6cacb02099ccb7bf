"""WARC archives as a chunked record table.

A payload travels as rows (record, chunk number, bytes): the JVM slices it, so no Python worker holds a
whole record. Writers stream the chunks of a record through one gzip member and one running SHA-1, whose
result must agree with the header written before them; readers stream the archive back, inflating a few
hundred KB at a time, and give one row per chunk with the running CRC-32 and byte count, the SHA-1 on the
last chunk.

Archives are files in the shared folder. A task writes under a name of its own attempt; only the names
that committed tasks return are read, and that manifest is a written table: a task that is run again
leaves at most a file nobody reads.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import fresh_path, met, named, parts, slices, text_of, written
from loom.sources.files import filesystem

CHUNK = 256 * 1024
#: A new archive file begins once one has this many compressed bytes.
ROLL = 1 << 30
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, record_type string, refers_to long, url string, payload_digest string, full_bytes long, record_no long, file string, chunk_no int, chunk binary, bytes_so_far long, crc32_so_far long, sha1 string, last boolean"


def base32_of_hex(hexed):
    """Base32 of a 160-bit hex digest as a Column: 5 hex digits are 4 letters."""
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def decided(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None, least: int) -> DataFrame:
    """Each row with its payload's digest and size and the id that responds for equal payloads.

    Groups meet as one row per digest and map task. Payloads that many rows share stay where they lie and learn
    their group from a bounded broadcast; the others move once, to join it."""
    payload = F.encode(text_of(payload_col), "UTF-8")
    rows = pages.select(
        named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url") if url_col else F.lit(None).cast("string").alias("url"), payload.alias("payload"),
    ).withColumns({"sha": F.sha2("payload", 256), "sha1": F.sha1("payload"), "full_bytes": F.octet_length("payload").cast("long")})
    best = rows.groupBy("sha").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("best_rows"))
    best = written(best.select(F.col("sha").alias("best_sha"), "best", "best_rows"), "responses")
    total = best.agg(F.sum("best_rows")).first()[0] or 0
    both = met(rows, best, F.col("sha") == F.col("best_sha"), "best_rows", total)
    alone = (F.col("full_bytes") < least) | F.col("page_id").eqNullSafe(F.col("best"))
    return both.select("page_id", "url", "payload", "full_bytes", base32_of_hex(F.col("sha1")).alias("digest"), F.when(~alone, F.col("best")).alias("refers_to"))


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk; a revisit has one chunk without bytes. The chunks of a record stay together, in order."""
    sent = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length(sent) / chunk), F.lit(1)).cast("int")
    out = rows.withColumn("sent", sent).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.select("page_id", "url", "full_bytes", "digest", "refers_to", "chunk_no", (F.col("chunk_no") == n - 1).alias("last"), F.expr(f"substring(sent, chunk_no * {chunk} + 1, {chunk})").alias("chunk"))


def _safe(url: str | None) -> str:
    from urllib.parse import quote

    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "urn:unknown"


def writer(folder: str, roll: int = ROLL, level: int = 1):
    """Arrow function: chunk rows -> (file, records, bytes) of the archives written."""

    def head(kind: str, page, url, digest: str, size: int, refers) -> tuple[bytes, bytes]:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        length = len(http) + (size if kind == "response" else 0)
        lines = [
            "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Target-URI: {_safe(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        ]
        if page is not None:
            lines.append(f"X-Page-Id: {page}")
        if kind == "revisit":
            lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers}"]
        lines.append(f"Content-Length: {length}")
        return ("\r\n".join(lines) + "\r\n\r\n").encode(), http

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple] = []
        out, name, count, size = None, "", 0, 0
        pack, sha, want = None, None, ""
        for b in slices(batches):
            cols = [b.column(k).to_pylist() for k in ("page_id", "url", "full_bytes", "digest", "refers_to", "chunk_no", "last", "chunk")]
            for page, url, full, digest, refers, no, last, data in zip(*cols):
                if no == 0:
                    if out is None:
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                        out, count, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    first, http = head("response" if refers is None else "revisit", page, url, digest, full, refers)
                    pack, sha, want = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1(), digest
                    size += out.write(pack.compress(first + http))
                if data:
                    sha.update(data)
                    size += out.write(pack.compress(data))
                if last:
                    if refers is None and base64.b32encode(sha.digest()).decode() != want:
                        raise ValueError(f"page {page}: the chunks written don't have the payload's digest")
                    size += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    count += 1
                    if size >= roll:
                        out.close()
                        done.append((f"{folder}/{name}", count, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col="page_id", payload_col="html", url_col: str | None = "url", least=0, chunk=CHUNK) -> DataFrame:
    """Writes one record per row into gzip archives in `folder`; the manifest (file, records, bytes) is a written table."""
    rows = chunked(decided(pages, id_col, payload_col, url_col, least), chunk)
    return written(rows.mapInArrow(writer(folder), "file string, records long, bytes long"), "manifest")


class Members:
    """The bytes of a .warc.gz file, inflated as they are asked for, at most `step` compressed bytes ahead."""

    def __init__(self, stream, step: int = 1 << 18):
        self.stream, self.step = stream, step
        self.z, self.raw, self.have = zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw = self.z.unused_data
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.raw, 1 << 20)  # also without input: output may be waiting
            self.raw = self.z.unconsumed_tail
            if got:
                self.have += got
                return True
            if not self.z.eof and not self.raw:
                self.raw = self.stream.read(self.step)
                if not self.raw:
                    return False

    def line_block(self) -> bytes | None:
        """Up to and with the next empty line; None at the end of the file."""
        seen = 0
        while (at := self.have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.have)
            if not self._more():
                if self.have.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.have[: at + 4])
        del self.have[: at + 4]
        return out

    def some(self, most: int) -> bytes:
        """1 to `most` bytes."""
        if not self.have and not self._more():
            raise ValueError("the archive ends inside a record")
        out = bytes(self.have[:most])
        del self.have[:most]
        return out


def reader(chunk: int = CHUNK, payload: bool = True):
    """Arrow function: (file) -> the chunk rows of its records, column by column as in CHUNKS; without `payload` only the
    last row of each record, and its bytes are counted and digested but not kept."""

    def fields(block: bytes) -> dict[str, str]:
        lines = block.decode("utf-8").split("\r\n")
        return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}

    def records(name: str) -> Iterator[tuple]:
        fs, path = filesystem(name)
        with fs.open_input_stream(path, compression=None) as stream:
            m, number = Members(stream), -1
            while (block := m.line_block()) is not None:
                h, number = fields(block), number + 1
                if not h[""].startswith("WARC/1."):
                    raise ValueError(f"{name}: record {number} has no WARC header")
                left = int(h["content-length"])
                http = m.line_block()
                left -= len(http)
                kind, page, refers = h["warc-type"], h.get("x-page-id"), h.get("x-refers-to-page-id")
                same = (None if page is None else int(page), kind, None if refers is None else int(refers), h.get("warc-target-uri"), h["warc-payload-digest"].removeprefix("sha1:"), int(fields(http)["content-length"]), number, name)
                sha, crc, so_far, no = hashlib.sha1(), 0, 0, 0
                while True:
                    data, need = [], min(chunk, left)
                    while need:
                        x = m.some(need)
                        sha.update(x)
                        crc, so_far = binascii.crc32(x, crc), so_far + len(x)
                        need, left = need - len(x), left - len(x)
                        if payload:
                            data.append(x)
                    if payload or not left:
                        yield (*same, no, b"".join(data) if payload else None, so_far, crc, None if left else base64.b32encode(sha.digest()).decode(), not left)
                    no += 1
                    if not left:
                        break
                tail = b""
                while len(tail) < 4:
                    tail += m.some(4 - len(tail))
                if tail != b"\r\n\r\n":
                    raise ValueError(f"{name}: record {number} doesn't end where its length says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in CHUNKS.split(", ")])
        rows, held = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                for r in records(name):
                    rows.append(r)
                    held += len(r[9] or b"")
                    if held >= 2 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunked record table of the manifest's archives: one row per chunk, in order within a record; without
    `payload` the last row of each record, `chunk` being null."""
    n = max(parts(manifest.sparkSession), manifest.count())  # a file is at most about ROLL bytes
    return manifest.select("file").repartition(n, "file").mapInArrow(reader(chunk, payload), CHUNKS)


def round_trip(pages: DataFrame, id_col="page_id", payload_col="html", url_col: str | None = "url", least=0) -> DataFrame:
    """Writes the archives, reads them back, and returns one row per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to, and archive_bytes (of the payload as read; 0 for revisits).

    Of records whose payloads are equal and have at least `least` bytes the one with the largest id is the
    response and the others are revisits of it; smaller ones are all responses. Size and digest of a
    response are counted anew from the bytes read; a revisit's come from its record, as its payload is not
    in the archive.

    Defined cases: a null payload is empty; a null id counts as smallest (all null: all are responses); rows
    that repeat the responding id and its payload are responses each; line ends and other characters that a
    header can't hold are percent-encoded in the URL; an empty table writes no file and gives no row.
    """
    spark = pages.sparkSession
    manifest = write_archives(pages, fresh_path(spark, "warc"), id_col, payload_col, url_col, least)
    ends = read_archives(manifest, payload=False)
    response = F.col("record_type") == "response"
    return ends.select(
        F.col("page_id").cast(pages.schema[id_col].dataType).alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha1")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(pages.schema[id_col].dataType).alias("refers_to"),
        F.col("bytes_so_far").alias("archive_bytes"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from loom.llm.common import table

    return round_trip(table(spark, sf_dir, "pages")).drop("archive_bytes")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1), '' ORDER BY i) AS digest
      FROM p, (SELECT unnest(range(32)) AS i) GROUP BY page_id)
SELECT g.page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN g.page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.page_id <> best THEN best END AS refers_to
FROM g JOIN b ON g.page_id = b.page_id
"""
