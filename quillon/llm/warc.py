"""Operator 1: WARC archives with an index that is written first and read by coalesced ranges.

``write_archives`` gives every page one record, each its own gzip member, and writes an index row for
each record: file, offset, length, URL and digest. ``read_records`` takes any selection of index rows,
sorts it by file and offset, joins neighbouring ranges into one read each and parses the members.

Of pages with equal payloads the one with the largest page_id becomes a ``response``, the others become
``revisit`` records that refer to it.

Defined results: a null html is the empty payload, which is a payload like any other; null page_ids count
as smallest, and a group that has no other ids is written as responses; rows that repeat the winning page_id are all
responses; a null url leaves out the target URI; an empty table gives no records; other columns are ignored.

An archive's name carries its task attempt, and the index is a table that Spark's committer wrote: it
names only files of tasks that ended, whatever executors were lost.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stores import scratch
from .common import shuffle_parts, written
from .workers import lean

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Header fields of our own: what a revisit record has no payload to tell.
PAGE, REFERS, LENGTH = "X-Page-ID", "X-Refers-To-Page-ID", "X-Payload-Length"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """The bytes of one record, not compressed."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"{LENGTH}: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        head.append(f"{PAGE}: {page_id}")
    block = HTTP % len(payload)
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"{REFERS}: {refers_to}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload; the block must have the length that the header states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the block does not end where the header says")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _open(path: str, mode: str):
    """A file by any URI that pyarrow's file systems know (file, hdfs, s3, gs) or by a plain path."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(name.rpartition("/")[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    return system.open_input_file(name)


def write_archives(pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", level: int = 4) -> DataFrame:
    """Writes the archives below ``path`` and returns the index, a written table."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("sha1", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    kind = src.schema["page_id"].dataType
    # Only payloads that occur more than once need a look-up; the table is written, so the planner knows its size.
    twins = written(src.groupBy("sha1").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twins")
    rows = src.join(twins, "sha1", "left").select("page_id", "url", "html", "sha1", "keep_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name, out, at = f"{path}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz", None, 0
        for b in batches:
            index = []
            for page, url, html, sha, keep in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = _open(name, "w")
                    info = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name, '')}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), mtime=0)
                    at = out.write(info)
                digest = base64.b32encode(sha).decode()
                revisit = keep is not None and page != keep
                member = gzip.compress(build_record(page, url, html.encode(), digest, keep, revisit), level, mtime=0)
                out.write(member)
                index.append((name, at, len(member), page, url, digest, "revisit" if revisit else "response"))
                at += len(member)
            if index:
                cols = list(zip(*index, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), b.column(0).type, pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)],
                                                 names=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"])
        if out is not None:
            out.close()

    schema = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("page_id", kind), T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType())])
    return written(rows.mapInArrow(lean(run), schema), "warc-index")


def ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> list[tuple[str, int, int, int, int]]:
    """Joins sorted (file, offset, length) into (file, begin, end, first row, row after the last).

    Neighbours at most ``gap`` bytes apart share a read; no read but that of a single record passes ``most`` bytes.
    """
    out: list[tuple[str, int, int, int, int]] = []
    for i, (file, offset, length) in enumerate(rows):
        if out and out[-1][0] == file and offset - out[-1][2] <= gap and offset + length - out[-1][1] <= most:
            out[-1] = (file, out[-1][1], max(out[-1][2], offset + length), out[-1][3], i + 1)
        else:
            out.append((file, offset, offset + length, i, i + 1))
    return out


def read_records(index: DataFrame, *, gap: int = 64 << 10, most: int = 8 << 20, payload: bool = True,
                 parts: int | None = None) -> DataFrame:
    """Reads the records that the index rows name: header columns, and the payload unless it is switched off.

    A response's payload is checked against its digest and length; a mismatch ends the job.
    """
    spark = index.sparkSession
    kind = index.schema["page_id"].dataType
    cut = (index.select("file", "offset", "length")
           .repartitionByRange(parts or shuffle_parts(spark), "file", "offset").sortWithinPartitions("file", "offset"))
    number = isinstance(kind, (T.IntegralType,))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (lambda x: None if x is None else int(x)) if number else (lambda x: x)
        arrow = pa.int64() if number else pa.string()
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            name, source = None, None
            for file, begin, end, first, last in ranges(rows, gap, most):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, _open(file, "r")
                block = source.read_at(end - begin, begin)
                out = []
                for _, offset, length in rows[first:last]:
                    f, body = parse_record(zlib.decompress(block[offset - begin: offset - begin + length], 31))
                    digest, size, revisit = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f[LENGTH]), f["WARC-Type"] == "revisit"
                    if not revisit and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"damaged record in {file} at {offset}")
                    row = (key(f.get(PAGE)), f.get("WARC-Target-URI"), size, digest, f["WARC-Type"], key(f.get(REFERS)) if revisit else None)
                    out.append((*row, None if revisit else body) if payload else row)
                cols = list(zip(*out, strict=True))
                kinds = [arrow, pa.string(), pa.int64(), pa.string(), pa.string(), arrow] + [pa.binary()] * payload
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)
            if source is not None:
                source.close()

    ids = T.LongType() if number else T.StringType()
    schema = T.StructType([
        T.StructField("page_id", ids), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", ids)])
    return cut.mapInArrow(lean(run), schema.add("payload", T.BinaryType()) if payload else schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives revisit records the payload of the response that they refer to."""
    full = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload").alias("full"))
    full = full.dropDuplicates(["refers_to", "payload_digest"])
    return (records.join(full, ["refers_to", "payload_digest"], "left")
            .withColumn("payload", F.coalesce("payload", "full")).drop("full"))


def scan_archive(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """Header fields of every record of one archive file, for checks without an index."""
    with _open(path, "r") as f:
        data = f.readall()
    out = []
    while data:
        d = zlib.decompressobj(31)
        raw = d.decompress(data) + d.flush()
        data = d.unused_data
        out.append(parse_record(raw)[0])
    return out
