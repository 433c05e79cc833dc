"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes one archive of records that are gzip members of their own, and returns the
index rows: file, offset, length, URL and digest. The index is written as a table; only the
files of tasks that ended well are in it, so lost executors and repeated attempts leave no
doubt about what belongs to the archive. Reading selects index rows, sorts them by file and
offset, joins ranges that lie close together, and fetches each joined range with one read.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id
is a response; the others are revisits that refer to it and carry no payload. Reading
resolves revisits through the index.

Defined results: a null html is an empty payload, a null url an empty target. Rows that
share a page_id are records of their own; between equal payloads of one page_id the record
with the least row hash is the response. A null page_id sorts last. Files go to the folder
in ``spark.checkpoint.dir`` through its file system.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, save

GAP = 64 << 10  # bytes between two ranges that are still read at once
RANGE = 8 << 20  # bytes of one read
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, page_id, digest: str, payload: bytes, refers_to=None, date="2024-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record, not compressed. A revisit has the headers of the payload only."""
    body = b"" if kind == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}",
             "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest-equal groups settled: record_type and refers_to."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("same", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn(
        "rank", F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("url").alias("h")))
    first = base.groupBy("same").agg(F.min("rank").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = base.join(first, "same", "left")
    revisit = (F.col("rank") != F.col("first")) & (F.octet_length("html") >= least)
    revisit = F.coalesce(revisit, F.lit(False))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first.id")).alias("refers_to"))


def write(settled: DataFrame, folder: str) -> DataFrame:
    """Write the archives under ``folder``; the index as a saved table."""
    def run(batches):
        system, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        system.create_dir(path, recursive=True)
        name, out, offset = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, kind, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                payload = html.encode()
                digest = sha1(payload)
                data = gzip.compress(record(kind, url, page_id, digest, payload, refers_to), 6, mtime=0)
                out = out or system.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                rows.append((page_id, name, offset, len(data), url, digest, kind, refers_to))
                offset += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                                                            pa.string(), pa.string(), pa.int64()))],
                names=["page_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"]) if rows else _no_rows()
        if out:
            out.close()

    columns = settled.select("page_id", "url", "html", "record_type", "refers_to")
    return save(columns.mapInArrow(run, INDEX), "warc-index")


def _no_rows() -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)


def ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """Joined ranges (file, offset, length, number of rows) of sorted (file, offset, length)."""
    found: list[list] = []
    for file, offset, length in rows:
        last = found[-1] if found else None
        end = last and last[1] + last[2]
        if last and last[0] == file and offset <= end + GAP and offset + length - last[1] <= RANGE:
            last[2], last[3] = max(end, offset + length) - last[1], last[3] + 1
        else:
            found.append([file, offset, length, 1])
    return [tuple(r) for r in found]


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, digest, payload_bytes (of the headers' count) and
    payload of the records in ``index``; a revisit's payload is null. Records are checked against their digests."""
    def run(batches):
        system, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        handle = (None, None)
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            at = 0
            for file, offset, length, count in ranges(rows):
                if handle[0] != file:
                    handle = (file, system.open_input_file(f"{path}/{file}"))
                data = handle[1].read_at(length, offset)
                out = []
                for _, start, size in rows[at:at + count]:
                    fields, payload = parse(zlib.decompress(data[start - offset:start - offset + size], 31))
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and sha1(payload) != digest:
                        raise ValueError(f"damaged record at {file}:{start}")
                    page, refers = fields["x-page-id"], fields.get("x-refers-to-page")
                    out.append((int(page) if page else None, fields["warc-target-uri"], kind, int(refers) if refers else None,
                                digest, len(payload) if kind == "response" else None, payload if kind == "response" else None))
                at += count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                                                               pa.int64(), pa.binary()))],
                    names=["page_id", "url", "record_type", "refers_to", "digest", "payload_bytes", "payload"])

    chunk = F.floor(F.col("offset") / (64 << 20))
    dealt = index.select("file", "offset", "length").repartition("file", chunk).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, digest string, "
                                 "payload_bytes long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """One row per page as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = write(decide(pages), folder)
    got = read(index, folder).drop("payload")
    sizes = got.where("record_type = 'response'").groupBy("digest").agg(F.max("payload_bytes").alias("full"))
    # Revisits take the size of the payload that their digest names.
    late = got.where("record_type = 'revisit'").join(sizes, "digest", "left")
    both = got.where("record_type = 'response'").withColumn("full", F.col("payload_bytes")).unionByName(late)
    return both.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                       "record_type", "refers_to")
