"""Web archives: a writer and a sequential reader of gzipped WARC files.

Each record is one gzip member. The reader takes a file from front to back in chunks: it feeds an incremental zlib
decompressor until a member ends, frames the record by Content-Length, and checks the block's and the payload's
digests. Broken members, short records and wrong digests raise ValueError.

Equal payloads are stored once: the record with the smallest id is a response, the others are revisits that refer to
it. A revisit holds the HTTP head only, with the length of the full payload, and the payload's digest. A payload of
fewer than ``least`` bytes is always a response. Null payloads are empty payloads. Rows that repeat id and payload of a response are responses too. A
null id is larger than any id; if all ids of a payload are null, all are responses. Null URLs are left out; control
characters and spaces in URLs are percent-encoded in the archive. Columns that the archive has no place for are not
read; an empty table makes no archive.

Files are written straight into the folder that all executors share, by any scheme that pyarrow.fs opens, under a name
of the task attempt's own. Only attempts that succeed report their files, so a lost or repeated task leaves no record
twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skein.llm.shared import work_path, written

ARCHIVE_BYTES = 32 << 20
CHUNK = 256 << 10
#: Records of one payload from which it counts as hot; of the table's records a hot payload has at least one in MOST_HOT.
HOT_RECORDS, MOST_HOT = 1 << 16, 100_000
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.0", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType())])


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_first_of_payload(df: DataFrame, least: int = 0, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """id, url, payload and the id of the first record with an equal payload (null: the row is itself a response).

    The first ids of hot payloads, MOST_HOT at most, are broadcast; the pages of any other payload are few enough to meet
    in one task. A table without a column url has none."""
    url = F.col("url") if "url" in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), url.alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")).withColumn("key", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1 and first is not null"), "warc-firsts")
    hot = F.col("n") >= max(HOT_RECORDS, (firsts.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    joined = rows.join(F.broadcast(firsts.where(hot).select("key", F.col("first").alias("hot_first"))), "key", "left")
    joined = joined.withColumn("cold", F.when(F.col("hot_first").isNull(), F.col("key")))
    # A hot payload's rows have a key of their own each in this join, which has no partner.
    joined = joined.withColumn("cold", F.coalesce("cold", F.concat(F.lit("hot "), F.xxhash64("page_id", "url").cast("string"))))
    joined = joined.join(firsts.where(~hot).select(F.col("key").alias("cold"), "first"), "cold", "left").withColumn("first", F.coalesce("hot_first", "first"))
    return joined.select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed."""
    digest = sha1_base32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-Id", str(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z", level: int = 5) -> DataFrame:
    """Writes rows of with_first_of_payload into folder; returns the files written, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, n, size, path = None, 0, 0, ""

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "n_bytes": size}], pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                page_id, url, payload, refers_to = (x.as_py() for x in row)
                if out is None:
                    path, n, size = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{path.rpartition('/')[2]}")
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = press.compress(record(page_id, url, payload, refers_to, date)) + press.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one at a time."""
    rest, press, parts = b"", zlib.decompressobj(31), []
    while chunk := rest or stream.read(CHUNK):
        parts.append(press.decompress(chunk))
        rest = press.unused_data
        if press.eof:
            yield b"".join(parts)
            press, parts = zlib.decompressobj(31), []
    if parts:  # even if no byte came out of it yet
        raise ValueError("the last gzip member is cut off")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(member: bytes) -> dict:
    """A record with its payload, its lengths and digests checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    if not head.startswith(VERSION):
        raise ValueError("no WARC record")
    named = fields(head)
    size = int(named["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    if f"sha1:{sha1_base32(block)}" != named["warc-block-digest"]:
        raise ValueError("the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length, kind = int(fields(http)["content-length"]), named["warc-type"]
    if kind == "response" and (len(payload) != length or f"sha1:{sha1_base32(payload)}" != named["warc-payload-digest"]):
        raise ValueError("the payload's digest is wrong")
    whole = lambda k: int(named[k]) if k in named else None
    return {"page_id": whole("page-id"), "url": named.get("warc-target-uri"), "record_type": kind, "refers_to": whole("refers-to-page-id"), "payload_bytes": length, "payload_digest": named["warc-payload-digest"].removeprefix("sha1:"), "payload": payload if kind == "response" else None}


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
READ_SQL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files in the column path, in any order of files; a file that has not as many as n_records tells
    raises ValueError. payloads: with what responses hold."""
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_records in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(place) as stream:
                    rows, size, n = [], 0, 0
                    for n, member in enumerate(members(stream), 1):  # noqa: B007
                        rows.append(parse(member) | ({} if payloads else {"payload": None}))
                        size += len(rows[-1]["payload"] or b"") + 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, READ)
                            rows, size = [], 0
                    if n != n_records:
                        raise ValueError(f"{path} has {n} records, not {n_records}")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, READ)

    return manifest.select("path", "n_records").repartitionByRange(files, "path").mapInArrow(run, READ_SQL)


def archive_and_read(spark: SparkSession, pages: DataFrame, least: int = 0, payloads: bool = True) -> DataFrame:
    """Archives pages in a new shared folder and reads the archives back."""
    return read_archives(write_archives(with_first_of_payload(pages, least), work_path(spark, "warc")), payloads)
