"""WARC archives: a writer with revisit records and a splittable reader (operator 3).

Writing: every task writes one ``.warc.gz`` file, one gzip member per record, into a folder
on the shared file system and reports its name, size and record count. Only files reported
by tasks that succeeded are in the manifest, so what a lost executor left behind is never
read. Of the records whose payloads are equal and at least ``min_revisit`` bytes, that with
the largest key is the response; the others become revisit records without payload.

Reading: the files are cut into byte ranges. A task looks for the gzip magic from the start
of its range on, takes a candidate for a member only if it decodes to a WARC header and to
its checksum, and owns the records that start inside its range, reading past the end of the
range to finish the last one. So the ranges need no index and each record is read once.

Defined cases: a null payload is the empty payload; a null key is written as an empty key and
read back as null; rows that repeat the largest key of a payload group are all responses;
an empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.llm.common import join_unique, shared_folder, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes read at a time.
CHUNK = 1 << 20
#: Bytes of a byte range.
SPLIT = 16 << 20
MANIFEST = "path string, size long, records long"
RECORD = ("key string, record_type string, target_uri string, date string, refers_to string, "
          "payload_bytes long, payload_digest string, path string, position long, payload binary")


def _fs(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def record_bytes(key: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record, not compressed. ``digest``: hex SHA-1 of the payload."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-record:{key}>",
            f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{b32}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-record:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(rows: DataFrame, folder: str, key: str, uri: str, payload: str, min_revisit: int = 1000,
               date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``rows`` as WARC files under ``folder`` (a URI that all executors reach).
    Returns the manifest: path, size, records of each file (a written table)."""
    text = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = rows.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), text.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    total = rows.count()
    groups = (rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
              .agg(F.max("key").alias("__response"), F.count("*").alias("n")).where("n > 1"))
    typed = join_unique(rows, groups, "digest", total, "n")
    is_revisit = F.col("__response").isNotNull() & ~F.col("key").eqNullSafe(F.col("__response"))
    typed = typed.select(F.col("key").cast("string").alias("key"), "uri", "digest",
                         F.octet_length("payload").cast("long").alias("size"), "payload",
                         F.when(is_revisit, F.col("__response").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for k, u, digest, body, ref in zip(batch["key"], batch["uri"], batch["digest"], batch["payload"],
                                               batch["refers_to"], strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path = posixpath.join(base, f"part-{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(path, compression=None)
                k = "" if k is None else k
                clean = " ".join(("" if u is None else u).split())
                member = _member(record_bytes(k, clean, body, digest, ref if isinstance(ref, str) else None, date))
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [posixpath.join(folder, posixpath.basename(path))], "size": [size], "records": [n]})

    return written(typed.mapInPandas(write, MANIFEST), "warc-manifest")


class _Window:
    """Bytes of a file by position, read in chunks; positions asked for mostly rise."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def peek(self, position: int, n: int) -> bytes:
        """The ``n`` bytes from ``position`` on, fewer at the file's end."""
        n = max(0, min(n, self.size - position))
        if not self.at <= position <= position + n <= self.at + len(self.data):
            self.file.seek(position)
            self.at, self.data = position, self.file.read(min(max(CHUNK, n), self.size - position))
        return self.data[position - self.at : position - self.at + n]


def decoded_member(window: _Window, position: int) -> tuple[bytes, int] | None:
    """The member's content and the position after it; None if no WARC member starts there."""
    z, content, at, step = zlib.decompressobj(31), bytearray(), position, 4096
    while not z.eof:
        raw = window.peek(at, step)
        if not raw:
            return None
        try:
            content += z.decompress(raw)
        except zlib.error:
            return None
        if not content.startswith(b"WARC/1."[: len(content)]):
            return None
        at, step = at + len(raw), min(2 * step, CHUNK)
    return bytes(content), at - len(z.unused_data)


def parsed(record: bytes) -> dict | None:
    """Fields of one uncompressed WARC record; None if it is not whole."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = int(fields.get("content-length", -1))
    if length < 0 or len(rest) < length:
        return None
    http, _, body = rest[:length].partition(b"\r\n\r\n")
    full = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
    name = lambda v: v.strip("<>").removeprefix("urn:x-record:")
    revisit = fields.get("warc-type") == "revisit"
    digest = (base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex() if revisit
              else hashlib.sha1(body).hexdigest())
    return {"key": name(fields.get("warc-record-id", "")) or None, "record_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "refers_to": name(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
            "payload_bytes": full if revisit else len(body), "payload_digest": digest,
            "payload": None if revisit else body}


def records_of(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """Position and fields of the records that start in [start, end) of a gzip WARC file."""
    window, at = _Window(file, size), start
    while at < end:
        data = window.peek(at, len(MAGIC))
        if data != MAGIC:  # only at the start of a range, or after a broken member
            data = window.peek(at, 1 << 16)
            found = data.find(MAGIC)
            at += found if found >= 0 else max(1, len(data) - len(MAGIC) + 1)
            continue
        got = decoded_member(window, at)
        fields = parsed(got[0]) if got else None
        if fields is None:
            at += 1
            continue
        yield at, fields
        at = got[1]


def read_warc(spark: SparkSession, manifest: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """Records of the files of ``manifest`` (columns path, size), read by byte ranges."""
    ranges = manifest.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {int(split)}L)")).alias("start"))
    tasks = max(1, ranges.count())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["size"], batch["start"], strict=True):
                fs, name = _fs(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for position, r in records_of(file, int(size), int(start), min(int(start) + split, int(size))):
                        if not payload:
                            r["payload"] = None
                        held += len(r["payload"] or b"")
                        rows.append(r | {"path": path, "position": position})
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    # a set number of tasks: these few short rows stand for much reading
    return ranges.repartition(min(tasks, 100_000)).mapInPandas(read, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, split: int = SPLIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC and read the archives back without payloads."""
    spark = pages.sparkSession
    manifest = write_warc(pages, folder or shared_folder(spark, "warc"), "page_id", "url", "html")
    back = read_warc(spark, manifest, split, payload=False)
    kind = dict(pages.dtypes)["page_id"]
    return back.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"), "target_uri")
