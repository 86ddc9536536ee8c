"""WARC archives with an index made first, and coalesced byte-range reads.

Every record is a gzip member of its own, so a range of an archive can be read alone.
Writing: each task writes one archive file into the shared folder and returns one
index row for each record (file, offset, length, URL, digest).  The index is a written
table, and it names the file of the attempt that succeeded, so repeated or lost tasks
do no harm.  Reading starts from the index: selected records are sorted by file and
offset, ranges with small gaps between them merge into one read, and runs of a file
are dealt out as bounded read jobs.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, new_path, written

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@lru_cache(maxsize=8)
def _fs(folder: str):
    """File system and path of a URI, for any store that pyarrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    name = lambda x: "" if x is None else str(x)
    target = name(url).replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name(page_id)} {target}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {name(page_id)}",
    ]
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 4, mtime=0)


def parse(raw: bytes) -> dict:
    """The record of a gzip member."""
    raw = gzip.decompress(raw)
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    http_end = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:http_end].decode().split("\r\n")[1:])
    number = lambda k: int(head[k]) if head.get(k) else None
    return {"page_id": number("X-Page-ID"), "url": head["WARC-Target-URI"], "payload": block[http_end + 4 :], "payload_bytes": int(http["Content-Length"]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}


def revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, html, digest, first (the page that has the payload; null: itself)."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    ids = written(p.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest"), "digests")
    # A digest is counted once for each task before it is shuffled, so a very common page costs no more than another.
    first = written(ids.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    # Only ids and digests meet by digest; pages meet the few that revisit another one by their own id.
    again = attach(ids, first, ["digest"], "n").filter("first <> page_id").select("page_id", "digest", "first").distinct()
    return p.join(again, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Write a record for each page and return the index (INDEX).

    Null html is the empty payload; null ids and URLs are empty fields.  Ids are read as
    long.  Of pages of equal payload of at least ``least_bytes``, that with the largest id
    is the response and the others revisit it; of repeated rows with this id each is a
    response, and so is a row of null id.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        file = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        offset, out = 0, None
        for b in batches:
            rows = []
            for page_id, url, html, digest, first in zip(*(b.column(k) for k in ("page_id", "url", "html", "digest", "first")), strict=True):
                page_id, first, payload, digest, url = page_id.as_py(), first.as_py(), html.as_py().encode("utf-8", "surrogatepass"), digest.as_py(), url.as_py()
                kind, refers = ("revisit", first) if first is not None and first != page_id else ("response", None)
                raw = record(page_id, url, payload, digest, kind, refers)
                out = out or fs.open_output_stream(f"{root}/{file}", compression=None)
                out.write(raw)
                rows.append((page_id, file, offset, len(raw), url, digest, kind, refers))
                offset += len(raw)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"])
        if out:
            out.close()

    index = written(revisits(pages, id_col, url_col, html_col, least_bytes).mapInArrow(run, INDEX), "cdx")
    return index.withColumn("file", F.concat(F.lit(folder + "/"), F.col("file")))


def ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) merged into reads: start, end, the records inside."""
    start = end = 0
    own: list[tuple[int, int]] = []
    for offset, length in rows:
        if own and (offset > end + gap or offset + length - start > most):
            yield start, end, own
            own = []
        if not own:
            start = offset
        own.append((offset, length))
        end = max(end, offset + length) if len(own) > 1 else offset + length
    if own:
        yield start, end, own


def parsed(raw: bytes, start: int, own: list[tuple[int, int]], payloads: bool, most: int) -> Iterator[list[dict]]:
    """The records of a read that began at ``start``, in lists of about ``most`` payload bytes.

    A short range may hold long payloads, so they are unpacked one after another.
    """
    found, held = [], 0
    for o, n in own:
        x = parse(raw[o - start : o - start + n])
        if x["record_type"] == "response":
            x["payload_digest"] = hashlib.sha1(x["payload"]).hexdigest()
        if not payloads:
            x["payload"] = None
        found.append(x)
        held += len(x["payload"] or b"")
        if held > most:
            yield found
            found, held = [], 0
    if found:
        yield found


def read_records(index: DataFrame, payloads: bool = True, gap: int = 65_536, most: int = 8_388_608, job_bytes: int = 16_777_216) -> DataFrame:
    """The selected records (rows of an index, any filter applied), READ by range.

    ``gap``: bytes read in vain between two records rather than by a second request.
    ``most``: bytes in one read, and of payloads in one batch, unless one record is longer.  ``job_bytes``: of a file,
    bytes given to one task.  A response's digest is computed from the bytes read.  An
    empty index gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(b.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True):
                by_file.setdefault(file, []).append((offset, length))
            for file, rows in by_file.items():
                folder, _, name = file.rpartition("/")
                fs, root = _fs(folder)
                with fs.open_input_file(f"{root}/{name}") as f:
                    for start, end, own in ranges(sorted(rows), gap, most):
                        f.seek(start)
                        raw = f.read(end - start)
                        for found in parsed(raw, start, own, payloads, most):
                            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    picked = index.select("file", "offset", "length")
    # Index rows are small, what they stand for is not: the number of tasks comes from the bytes to read.
    total = picked.agg(F.sum("length")).head()[0] or 0
    dealt = picked.repartition(max(1, -(-total // job_bytes)), "file", (F.col("offset") / job_bytes).cast("long")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, READ)
