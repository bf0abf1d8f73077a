"""WARC archives: one gzip member a record, written by Spark's own writer, read back sequentially."""

from __future__ import annotations

import base64
import hashlib

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch_path, stage

#: Members are gathered into blocks of about this many bytes; a file has BLOCKS_A_FILE blocks.
BLOCK, BLOCKS_A_FILE = 4 << 20, 6
#: Payloads from this many bytes on are written once, later copies as revisits.
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    """A URN that holds the id; a null id is written as ``none``."""
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, size: int, refers) -> bytes:
    """One record as a gzip member: headers, empty line, block, two line ends."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if refers is not None:
        head += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Profile: {PROFILE}"]
    b32 = lambda x: base64.b32encode(bytes.fromhex(x)).decode()
    block = b"" if refers is not None else payload
    head += [f"WARC-Payload-Digest: sha1:{b32(digest)}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).hexdigest())}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(id, url, html, digest, size, refers): of equal payloads of ``revisit_from`` bytes or more the largest id is the response.

    The digest table has one row for each repeated payload; the join with it is one Spark can split, so a payload that
    a third of all pages share does not land in one task. A row that repeats the response's own id is a revisit of it
    only if its id differs, so repeated rows are all responses.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    large = rows.where(F.col("size") >= revisit_from)
    copies = stage(large.groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "last"), "copies")
    joined = rows.join(copies, (F.col("digest") == F.col("d")) & (F.col("size") >= revisit_from), "left")
    refers = F.when(F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("last"))), F.col("last"))
    return joined.select("id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "size", refers.alias("refers"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the rows of ``mark_revisits`` as WARC files under ``path``, on any store Spark can write to.

    Tasks make gzip members and Spark's text writer puts them into files and commits them, so a lost executor or a
    second attempt leaves nothing behind. That writer ends each row with a separator, which a gzip stream has no place
    for; but the last byte of a member is the top byte of its length, zero for records under 16 MiB, so each row leaves
    out that zero and the separator supplies it. A larger record is followed by an empty member, whose last byte is zero.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for id_, url, html, digest, n, refers in zip(*(pdf[c] for c in ("id", "url", "html", "digest", "size", "refers"))):
                member = record(None if pd.isna(id_) else int(id_), url, (html or "").encode(), digest, int(n), None if pd.isna(refers) else int(refers))
                if member[-1]:
                    member += zlib.compressobj(6, zlib.DEFLATED, 31).flush()
                held.append(member)
                size += len(member)
                if size >= BLOCK:
                    yield pd.DataFrame({"block": [b"".join(held)[:-1]]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"block": [b"".join(held)[:-1]]})

    rows = records.mapInPandas(blocks, "block binary").select(F.col("block").cast("string").alias("value"))
    rows.write.option("lineSep", "\x00").option("maxRecordsPerFile", BLOCKS_A_FILE).text(path)


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Contents of the gzip members of an archive, one at a time, fed to zlib in steps."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("the archive ends within a record")
            out.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        yield b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; its frame and digest must be right."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length {size} doesn't frame the record")
    digest = fields.get("warc-block-digest", "")
    if digest and digest != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the block doesn't match its digest")
    return fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each record under ``path``.

    Files are of bounded size and each is read from its start to its end. A broken frame or digest fails the job.
    ``payload`` is null for revisits; length and digest are those of the full payload.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def number(urn: str | None) -> int | None:
        tail = urn.rstrip(">").rpartition(":")[2] if urn else "none"
        return None if tail == "none" else int(tail)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]

        def frame(rows: list) -> pd.DataFrame:
            pdf = pd.DataFrame(rows, columns=names)
            return pdf.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

        rows, size = [], 0
        for pdf in batches:
            for data in pdf["content"]:
                for member in members(data):
                    if not member:
                        continue  # follows a record of 16 MiB or more
                    f, block = parse_record(member)
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    answer = f["warc-type"] == "response"
                    if answer and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError("the payload doesn't match its digest")
                    rows.append((number(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], len(block) if answer else int(f["x-payload-length"]), digest, number(f.get("warc-refers-to")), block if answer else None))
                    size += len(block) + 200
                    if size >= BLOCK:
                        yield frame(rows)
                        rows, size = [], 0
        if rows:
            yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(read, schema)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives under ``path`` and reads them back.

    A null html has an empty payload, a null id comes back null, a null url has no target. An empty table gives no
    rows. Extra columns are not written.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write_warc(mark_revisits(pages), path)
    return read_warc(pages.sparkSession, path)
