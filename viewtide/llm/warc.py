"""Web archives: a writer with revisit records, and a sequential reader.

Written archives have one gzip member for each record, so a reader can begin at any member. Records with equal payloads of
at least ``REVISIT_BYTES`` bytes are kept once: that with the smallest page_id is a response, the others are revisit records
that name it and carry its digest and size, but no payload. Digests and lengths are computed from the pages by Spark; only
(digest, page_id) pairs are grouped, pre-aggregated before the shuffle, and only rows of repeated payloads are joined.

The reader inflates a member piece by piece, frames the record by its Content-Length, and compares the payload with the
record's digest and length; a wrong digest, length or trailing data is an error, and so is a revisit whose digest and length
aren't those of the response that it names. It holds one record at a time.

A task writes an archive under a name of its own and reports it; only reported archives are read.

Defined results: a null html is an empty payload; a null url an empty target; a record without page_id
is a response, and none refers to it; repeated rows of the page that holds the smallest page_id are all responses; an empty
table gives no archives and no rows; other columns are ignored; a very long page is one record, which a task holds whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, open_fs, rows_of, shared_folder, text_batches

REVISIT_BYTES = 100
#: Compressed bytes read and inflated bytes produced at a time.
CHUNK = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class BadRecord(ValueError):
    """A record that isn't what its headers say."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as one gzip member."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


class Members:
    """The bytes of a file's gzip members, one member after another, inflated as they are asked for."""

    def __init__(self, file):
        self.file, self.raw, self.plain, self.z = file, b"", bytearray(), None

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the file."""
        self.raw = self.raw or self.file.read(CHUNK)
        self.plain, self.z = bytearray(), zlib.decompressobj(31)
        return bool(self.raw)

    def more(self) -> bool:
        """Inflates some more of this member; False at its end."""
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.raw or self.file.read(CHUNK)
        got = self.z.decompress(data, CHUNK)
        if not (data or got or self.z.eof):
            raise BadRecord("the file ends within a member")
        self.plain += got
        self.raw = self.z.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.plain.find(mark)) < 0:
            if not self.more():
                raise BadRecord("a record without its header's end")
        found = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.more():
                raise BadRecord("a record shorter than its Content-Length")
        found = bytes(self.plain[:n])
        del self.plain[:n]
        return found


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, HTTP body) of each record, verified."""
    members = Members(file)
    while members.begin():
        first, *lines = members.until(b"\r\n\r\n").decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise BadRecord(f"not a record: {first[:40]!r}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = members.take(int(head["Content-Length"]))
        end = members.take(4)
        while not members.plain and members.more():
            pass
        if end != b"\r\n\r\n" or members.plain:
            raise BadRecord("data after a record's end")
        body = block[block.index(b"\r\n\r\n") + 4 :]
        if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise BadRecord("wrong block digest")
        if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(body).hexdigest()}":
            raise BadRecord("wrong payload digest")
        if head["WARC-Type"] == "response" and int(head["WARC-Payload-Length"]) != len(body):
            raise BadRecord("wrong payload length")
        yield head, body


def _digest():
    return F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload a page with a smaller page_id has."""
    long = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= REVISIT_BYTES
    digests = cut(pages.where(long).select("page_id", _digest().alias("digest")))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return digests.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every page and returns a row for each archive: path, folder, n_records."""
    import pyarrow as pa

    spark = pages.sparkSession
    text_batches(spark)
    folder = folder or shared_folder(spark, "warc")
    again = cut(revisits(pages))
    rows = pages.select("page_id", "url", "html", _digest().alias("digest")).join(again, ["page_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        path, out, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page_id, url, html, refers_to in rows_of(batch, "page_id", "url", "html", "refers_to"):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    # The path says how it is compressed; the stream must not compress once more.
                    out = fs.open_output_stream(path, compression=None)
                out.write(record_bytes(page_id, url, (html or "").encode("utf-8", "replace"), refers_to))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([folder]), pa.array([n], pa.int64())], ["path", "folder", "n_records"])

    return cut(rows.mapInArrow(write, "path string, folder string, n_records long"))


def _rows(archives: DataFrame, digest_only: bool) -> DataFrame:
    import pyarrow as pa

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn[10:-1] else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        kinds = kinds[:6] if digest_only else kinds
        for batch in batches:
            for path, folder in rows_of(batch, "path", "folder"):
                fs, _ = open_fs(folder)
                with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as f:
                    kept: list[tuple] = []
                    for head, body in read_records(f):
                        revisit = head["WARC-Type"] == "revisit"
                        row = (number(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"][7:], head["WARC-Type"], number(head.get("WARC-Refers-To")))
                        kept.append(row if digest_only else (*row, None if revisit else body))
                        if len(kept) == (1000 if digest_only else 100):
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names[: len(kinds)])
                            kept = []
                    if kept:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names[: len(kinds)])

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ("" if digest_only else ", payload binary")
    n = max(1, min(archives.count(), 10_000))
    return archives.repartition(n, "path").mapInArrow(read, kinds)


def read_archives(archives: DataFrame, digest_only: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record, and unless digest_only its payload (null for revisits).

    A revisit is believed only where the response that it names was read with that digest and length; BadRecord otherwise.
    """
    found = cut(_rows(archives, True))
    same = ["payload_digest", "payload_bytes"]
    responses = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *same)
    claims = found.where("record_type = 'revisit'").select("refers_to", *same).distinct()
    wrong = claims.join(responses, ["refers_to", *same], "left_anti").first()
    if wrong is not None:
        raise BadRecord(f"revisits name page {wrong['refers_to']} for a payload that it hasn't got")
    return found if digest_only else _rows(archives, False)
