"""WARC archives: writing, streaming back, and resolving revisits.

``write_archives`` turns pages into response records; each task writes its own archives (one gzip member per record,
rolled at ``ROLL`` payload bytes) to the shared folder. ``read_headers`` streams archives back record by record and
checks lengths and digests. ``resolve`` shuffles headers only, by payload digest: per digest the smallest page id is the
original (combined on the map side, so a payload that a third of all pages have is a row per task), and the other records
are joined to it. ``deduplicate_archives`` rewrites each archive with the decisions for its records and fresh headers:
payloads never leave the archive they are in. Files are written under a temporary name and moved into place, so a task
that runs twice leaves one whole file.

Defined cases: null html is an empty payload; ties of page_id go to the record written first; records without page_id
come after all others; control characters in a URL are percent-encoded in the header; payloads under ``min_bytes`` stay
responses; long payloads are written whole; empty tables give no archives; extra columns are ignored.
"""

import base64
import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from cohortspark.llm.common import shared_path, stored

ROLL = 64_000_000
FIRST_LINE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest, place):
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{place}')}>"


def _url(url):
    return urllib.parse.quote((url or "").encode("utf-8"), safe="".join(chr(c) for c in range(33, 127)))


def record_bytes(kind, page_id, url, payload, digest, rid, refers_to=None, refers_id=None, full_length=None):
    """One WARC/1.1 record. A revisit has the HTTP head only and points to its original."""
    head = FIRST_LINE + b"Content-Length: %d\r\n\r\n" % (len(payload) if full_length is None else full_length)
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_url(url)}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_id}"] + ([f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else [])
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Archives of one task: part-<task>-<n>.warc.gz, moved into place when complete."""

    def __init__(self, folder, stem):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.folder, self.stem = folder, stem
        self.n, self.out, self.size, self.records, self.done = 0, None, 0, 0, []

    def put(self, raw):
        if self.out is None:
            self.name = f"{self.stem}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
        deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
        self.out.write(deflate.compress(raw) + deflate.flush())
        self.size += len(raw)
        self.records += 1
        if self.size >= ROLL:
            self.close()

    def close(self):
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((f"{self.folder}/{self.name}", self.records))
            self.out, self.size, self.records, self.n = None, 0, 0, self.n + 1

    def manifest(self):
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in self.done], pa.string()), pa.array([d[1] for d in self.done], pa.int64())], names=["path", "records"])


def read_records(path):
    """(place, headers, block) of every record, streamed; raises where a length or digest does not hold."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    place, buffer = 0, b""
    with files.open_input_stream(name, compression=None) as source:
        inflate, parts = zlib.decompressobj(31), []
        while True:
            buffer = buffer or source.read(1 << 20)
            if not buffer:
                break
            parts.append(inflate.decompress(buffer))
            buffer = b""
            if inflate.eof:
                buffer = inflate.unused_data
                yield (place, *parse_record(b"".join(parts)))
                place += 1
                inflate, parts = zlib.decompressobj(31), []
        if any(parts):
            raise ValueError(f"{path} ends within a record")


def parse_record(raw):
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n" or f"sha1:{payload_digest(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError("a record's length or digest does not hold")
    return headers, block


def payload_of(block):
    return block.partition(b"\r\n\r\n")[2]


def payload_length(kind, block):
    """Length of the payload a record stands for: its own, or for a revisit the one its HTTP head states."""
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = [line[15:] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return int(stated[-1]) if kind == "revisit" and stated else len(payload)


def _task():
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write_archives(pages, folder):
    """Manifest (path, records) of archives with one response record per row of ``pages`` (page_id, url, html)."""

    def run(batches):
        writer = ArchiveWriter(folder, f"part-{_task():06d}")
        place = 0
        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url"), batch.column("html")):
                payload = (html.as_py() or "").encode("utf-8")
                digest = payload_digest(payload)
                writer.put(record_bytes("response", page, url.as_py(), payload, digest, record_id(page, digest, f"{_task()}-{place}")))
                place += 1
        yield writer.manifest()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(rows.mapInArrow(run, "path string, records long"), "manifest")


HEADERS = "path string, place long, record_id string, page_id long, type string, digest string, payload_bytes long, refers_id string, refers_to long"


def one_task_each(manifest):
    """Archives dealt so that every task gets about one."""
    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "path")


def read_headers(manifest):
    """One row per record of the archives, with the length of the payload it holds or stands for."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for place, h, block in read_records(path):
                    page = h.get("X-Page-Id")
                    to = h.get("X-Refers-To-Page-Id")
                    payload = payload_of(block)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"record {place} of {path}: the payload does not have its digest")
                    rows.append((path, place, h["WARC-Record-ID"], page and int(page), h["WARC-Type"], digest, payload_length(h["WARC-Type"], block), h.get("WARC-Refers-To"), to and int(to)))
                names = [c.split()[0] for c in HEADERS.split(", ")]
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                for start in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[start:start + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return one_task_each(manifest).mapInArrow(run, HEADERS)


def resolve(headers, min_bytes=0):
    """Each record's decision: path, place, type (response or revisit), refers_to, refers_id. Shuffles headers only.
    Earlier revisits go to the payload's original too, so that none points to a record that has become a revisit."""
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "path", "place", "record_id")
    eligible = headers.where((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes))
    first = eligible.groupBy("digest", "payload_bytes").agg(F.min(order).alias("original"))
    joined = headers.join(first, ["digest", "payload_bytes"], "left")
    other = (F.col("path") != F.col("original.path")) | (F.col("place") != F.col("original.place"))  # ids may repeat between archives
    again = F.col("original").isNotNull() & other & F.col("type").isin("response", "revisit")
    return joined.select("path", "place", F.when(again, "revisit").otherwise(F.col("type")).alias("kind"),
                         F.when(again, F.col("original.page_id")).otherwise(F.col("refers_to")).alias("to_page"),
                         F.when(again, F.col("original.record_id")).otherwise(F.col("refers_id")).alias("to_record"))


def deduplicate_archives(manifest, folder, min_bytes=0):
    """Archives with revisit records for repeated payloads, under fresh headers. An archive's decisions (bounded, as
    archives are rolled by size) go to the task that rewrites it. New names hold a hash of the archive's whole path, so
    archives of one name in several folders stay apart; as many records must come out as were read."""
    headers = stored(read_headers(manifest), "headers")
    decisions = resolve(headers, min_bytes)
    changes = decisions.where("kind = 'revisit'").groupBy(F.col("path").alias("_path")).agg(F.collect_list(F.struct("place", "to_page", "to_record")).alias("changes"))
    work = manifest.join(changes, manifest["path"] == changes["_path"], "left").select("path", "changes")
    n = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, changes_ in zip(batch.column("path").to_pylist(), batch.column("changes").to_pylist()):
                again = {c["place"]: c for c in changes_ or []}
                writer = ArchiveWriter(folder, f"{path.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{hashlib.sha1(path.encode()).hexdigest()[:12]}")
                for place, h, block in read_records(path):
                    page, digest, payload = h.get("X-Page-Id"), h["WARC-Payload-Digest"].removeprefix("sha1:"), payload_of(block)
                    url = h["WARC-Target-URI"]
                    if place in again:
                        c = again[place]
                        raw = record_bytes("revisit", page, url, b"", digest, h["WARC-Record-ID"], c["to_page"], c["to_record"], payload_length(h["WARC-Type"], block))
                    else:
                        raw = record_bytes("response", page, url, payload, digest, h["WARC-Record-ID"])
                    writer.put(raw)
                yield writer.manifest()

    done = stored(work.repartitionByRange(n, "path").mapInArrow(run, "path string, records long"), "manifest")
    read, written = headers.count(), done.agg(F.sum("records").alias("n")).first()["n"] or 0
    if read != written:
        raise ValueError(f"{read} records were read and {written} written")
    return done


def resolved_pages(manifest):
    """One row per record of deduplicated archives; revisits are joined to their originals for the payload's length."""
    headers = stored(read_headers(manifest), "headers")
    originals = headers.where("type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_bytes"))
    joined = headers.join(originals, headers["refers_id"] == originals["_id"], "left")
    return joined.select("page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "record_id", "path")


def archive_pages(pages, min_bytes=0):
    """Write the pages, deduplicate the archives, read them back: (one row per page, manifest of the final archives)."""
    spark = pages.sparkSession
    raw = write_archives(pages, shared_path(spark, "warc"))
    final = deduplicate_archives(raw, shared_path(spark, "warc-deduplicated"), min_bytes)
    return resolved_pages(final), final
