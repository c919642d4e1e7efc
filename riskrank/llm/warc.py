"""WARC archives with an index, and coalesced byte-range reads.

Every row becomes a WARC/1.1 record, a gzip member of its own, in an archive written by its
task. Tasks return an index row for each record (file, offset, length, URL, digest); the
index is a table that Spark commits, so archives of failed or repeated attempts, whose names
are unique, are in no index and are never read. Reading starts from index rows only: they
are ordered by file and offset, neighbouring ranges become one read, and each record is cut
out of it.

Of records with equal payloads of ``REVISIT_BYTES`` or more, those with the largest page_id
are responses, and the others are revisits without a payload that refer to it.

Archives live in the shared folder, through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
#: Ranges with gaps up to the first are read together, up to the second in one read.
GAP_BYTES, READ_BYTES = 1 << 16, 8 << 20
#: Bytes of records one task reads: at most so many on average, and so many before another core is asked.
TASK_BYTES, MIN_TASK_BYTES = 64 << 20, 1 << 18
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
INDEX = ("page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, "
         "record_type string, refers_to long")
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(uri: str):
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers),
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def page_record(page_id, url, payload: bytes, digest: str, size: int, refers_to, place: str) -> bytes:
    """One response (or revisit, when ``refers_to`` is set) as WARC bytes."""
    kind = "response" if refers_to is None else "revisit"
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    ident = _record_id(page_id, digest) if refers_to is None else _record_id(page_id, digest, place)
    headers = [("WARC-Record-ID", ident), ("WARC-Payload-Digest", sha1), ("X-Payload-Length", str(size)),
               ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to)),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record(kind, headers, http + (payload if refers_to is None else b""))


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record. The payload of a response is checked against its
    digest; a revisit has none."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(h["Content-Length"])]
    hexed = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
    out = {"page_id": int(h["X-Page-Id"]) if "X-Page-Id" in h else None, "url": h.get("WARC-Target-URI"),
           "record_type": h["WARC-Type"], "refers_to": int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None}
    if h["WARC-Type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": hexed}
    payload = block.partition(b"\r\n\r\n")[2]
    if hashlib.sha1(payload).hexdigest() != hexed:
        raise ValueError(f"record of page {out['page_id']}: the payload does not match its digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hexed}


def typed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, digest, n, refers_to``: which rows revisit which page."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
                        F.octet_length(html).cast("long").alias("n"))
    best = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n") \
               .agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1") \
               .select(F.col("digest").alias("d"), F.col("n").alias("m"), "best")
    best = written(best, "warc-copies")
    both = rows.join(best, (rows["digest"] == best["d"]) & (rows["n"] == best["m"]), "left")
    revisit = F.col("best").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best")))
    return both.select("page_id", "url", "html", "digest", "n", F.when(revisit, F.col("best")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write one record a row; gives the index table.

    Null payloads are empty ones. Rows with a null page_id can revisit but are not referred
    to; rows that share the largest page_id are all responses. An empty table writes no
    archive. Other columns are not read."""
    path = path or shared_path(pages.sparkSession, "warc")

    def run(batches):
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, html, digest, n, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = _gzip(_record("warcinfo", [("WARC-Record-ID", _record_id(name)), ("Content-Type", "application/warc-fields")],
                                         b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    at = len(info)
                data = _gzip(page_record(page_id, url, html.encode(), digest, n, refers_to, f"{name}:{at}"))
                out.write(data)
                index.append((page_id, url, name, at, len(data), digest, n, "response" if refers_to is None else "revisit", refers_to))
                at += len(data)
            if index:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*index), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                                                                  pa.string(), pa.int64(), pa.string(), pa.int64()))],
                    names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()
    index = typed_pages(pages, **columns).mapInArrow(run, INDEX)
    return written(index.withColumn("archive", F.lit(path)), "warc-index")


def read_tasks(index: DataFrame) -> int:
    """As many tasks as ``TASK_BYTES`` of the selected records need, and at least one a core
    where each still gets ``MIN_TASK_BYTES``."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = index.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // TASK_BYTES), min(cores, total // MIN_TASK_BYTES))


def read_records(index: DataFrame) -> DataFrame:
    """The records of index rows (all, or any selection of them), read from the archives by
    sorted, coalesced byte ranges. The number of tasks follows the bytes to read, not those of
    the index."""
    spots = index.select("archive", "file", "offset", "length") \
                 .repartitionByRange(read_tasks(index), "archive", "file", "offset") \
                 .sortWithinPartitions("archive", "file", "offset")

    def run(batches):
        opened, handle = None, None

        def records(spots):
            """One read for all; the ranges are cut out of it."""
            nonlocal opened, handle
            place, start = spots[0][:2], spots[0][2]
            if opened != place:
                if handle is not None:
                    handle.close()
                fs, root = _filesystem(place[0])
                opened, handle = place, fs.open_input_file(f"{root}/{place[1]}")
            data = handle.read_at(spots[-1][2] + spots[-1][3] - start, start)
            rows = [parse_record(zlib.decompress(data[at - start:at - start + n], 31)) for _, _, at, n in spots]
            return pa.RecordBatch.from_pylist(rows, SCHEMA)
        held = []
        for batch in batches:
            for spot in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (spot[:2] != held[0][:2] or spot[2] - held[-1][2] - held[-1][3] > GAP_BYTES
                             or spot[2] + spot[3] - held[0][2] > READ_BYTES):
                    yield records(held)
                    held = []
                held.append(spot)
        if held:
            yield records(held)
        if handle is not None:
            handle.close()
    return spots.mapInArrow(run, RECORD)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
