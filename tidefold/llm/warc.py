"""WARC archives of pages, with a two-level capture index.

Writing: a record per page in gzip members of their own, so any record is one ranged read.  Of
pages with equal payloads of at least `least` bytes the one with the smallest page_id is stored
as a response, the others as revisits without payload that name it.

Index: a line per capture, sorted by a key with the host reversed (com,example,www)/path) and by
page_id, in compressed blocks of `BLOCK` lines.  An index file ends with the sparse directory of its
blocks: each one's first line and place.  The files themselves are a short list, a row for each task
that wrote one.  A lookup searches that list by bisection, then the file's directory, reads one block,
searches it by bisection too and then reads the record's range.  `find` does so for a table of pages:
their keys are dealt by index file, so no task holds more of the index than a file's directory.

Defined results: null html is an empty payload; null urls get a urn of their page; of rows that
repeat a page_id with equal payload all are responses or revisits alike; a null page_id is never
referred to, and where only such rows share a payload all are responses; very long html is a record
like any other; an empty table gives no archives, an empty index and no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import fresh_path, map_arrow, materialize, open_input, open_output, read_range, row_slices, small_enough, tidy

LEAST = 100
BLOCK = 1000
LEVEL = 4
MOST_REVISITS = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, archive string, offset long, length long"


def url_key(url: str) -> str:
    """Sort key with the host's labels reversed; scheme, user, default port, leading www and fragment don't count."""
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url)
    if not m:
        return url.lower()
    host, port, rest = m[1].lower().rstrip("."), m[2], m[3] or "/"
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + rest.lower()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one uncompressed record: page_id, type, url, payload, payload_bytes, payload_digest, refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != told):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page-ID"), "record_type": kind, "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": told, "payload_digest": digest, "refers_to": number("Refers-To-Page-ID")}


def gzip_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_refers_to(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses).

    Digests are grouped without the pages; only the revisits found come back to the pages, by
    broadcast while they are few and by shuffle beyond that.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    light = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    again = light.distinct().join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = materialize(again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to"), "revisits")
    if small_enough(again, MOST_REVISITS):
        again = F.broadcast(again)
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST) -> DataFrame:
    """Write archives below `folder`; a row per capture (CAPTURE).  Archives of failed task attempts are named by no row."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        path, out, at = f"{folder}/archive-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for whole in batches:
            for batch in row_slices(whole, column="html"):
                if out is None:
                    out = open_output(path)
                    info = b"software: tidefold\r\nformat: WARC File Format 1.1\r\n"
                    head = gzip_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                    out.write(head)
                    at = len(head)
                rows = []
                for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    member = gzip_member(record(page_id, url, html.encode(), digest, refers_to, date))
                    out.write(member)
                    rows.append((url_key(url or f"urn:page:{page_id}"), page_id, path, at, len(member)))
                    at += len(member)
                key, page, archive, offset, length = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(page, pa.int64()), pa.array(archive, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return materialize(map_arrow(with_refers_to(pages, least), run, CAPTURE), "captures")


PARTS = "part long, first_key string, first_page long, path string, offset long, length long"


def place(key: str, page_id: int | None) -> tuple:
    """How index lines are sorted; null page_ids come first."""
    return key, page_id is not None, page_id or 0


def index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Write the index below `folder`; a row per file, in key order by part: its first line, and where its directory is."""
    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["key", "page_id", "archive", "offset"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path, out, at, lines, directory = f"{folder}/index-{part:06d}-{uuid.uuid4().hex}.cdx", None, 0, [], []

        def put(rows: list) -> tuple[int, int]:
            nonlocal at
            packed = zlib.compress("\n".join(json.dumps(x) for x in rows).encode())
            out.write(packed)
            at += len(packed)
            return at - len(packed), len(packed)

        def flush():
            directory.append([*lines[0][:2], *put(lines)])
            lines.clear()

        for batch in batches:
            out = out or (open_output(path) if batch.num_rows else None)
            for line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines.append(line)
                if len(lines) == block:
                    flush()
        if lines:
            flush()
        if out is not None:
            offset, length = put(directory)
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "first_key": [directory[0][0]], "first_page": pa.array([directory[0][1]], pa.int64()), "path": [path], "offset": pa.array([offset], pa.int64()), "length": pa.array([length], pa.int64())})

    rows = captures.select("key", "page_id", "archive", "offset", "length").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(map_arrow(rows, run, PARTS), "index-files")


def read_lines(handle, offset: int, length: int) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(read_range(handle, offset, length)).decode().split("\n")]


def read_record(archive: str, offset: int, length: int) -> dict:
    with open_input(archive) as f:
        return parse(zlib.decompress(read_range(f, offset, length), 31))


def reach(firsts: list, low, high) -> range:
    """Which of the sorted runs that begin with `firsts` may hold anything from `low` to `high`."""
    return range(max(bisect.bisect_left(firsts, low) - 1, 0), bisect.bisect_right(firsts, high))


class IndexFile:
    """Bisection in one index file; holds its directory and the block read last."""

    def __init__(self, path: str, offset: int, length: int):
        self.handle = open_input(path)
        self.blocks = read_lines(self.handle, offset, length)
        self.firsts = [place(*b[:2]) for b in self.blocks]
        self.number, self.lines = -1, []

    def between(self, low, high):
        """Lines from place `low` to place `high`."""
        for k in reach(self.firsts, low, high):
            if k != self.number:
                self.number, self.lines = k, read_lines(self.handle, *self.blocks[k][2:])
            at = bisect.bisect_left(self.lines, low, key=lambda x: place(*x[:2]))
            while at < len(self.lines) and place(*self.lines[at][:2]) <= high:
                yield self.lines[at]
                at += 1


class Lookup:
    """Captures of single urls.  Holds the list of index files."""

    def __init__(self, files: DataFrame):
        self.files = [tuple(r) for r in files.orderBy("part").collect()]
        self.firsts = [place(*f[1:3]) for f in self.files]

    def captures(self, url: str) -> list[list]:
        low, high = (url_key(url), False, 0), (url_key(url), True, 1 << 63)
        return [line for k in reach(self.firsts, low, high) for line in IndexFile(*self.files[k][3:]).between(low, high)]

    def pages(self, url: str) -> list[dict]:
        return [read_record(*c[2:]) for c in self.captures(url)]


def find(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Captures (CAPTURE) of the given pages (page_id, url), each found by bisection."""
    n = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    listed = [tuple(r) for r in files.orderBy("part").collect()]  # as many as index() had tasks
    shared = files.sparkSession.sparkContext.broadcast(listed)

    def deal(batches):
        import pyarrow as pa

        firsts = [place(*f[1:3]) for f in shared.value]
        for batch in batches:
            keys, ids, parts = [], [], []
            for page_id, url in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = url_key(url or f"urn:page:{page_id}")
                for k in reach(firsts, place(key, page_id), place(key, page_id)):
                    keys.append(key)
                    ids.append(page_id)
                    parts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(parts, pa.int64())], names=["key", "page_id", "part"])

    def search(batches):
        import pyarrow as pa

        part, file = None, None
        for batch in batches:
            out = []
            for key, page_id, k in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != part:
                    part, file = k, IndexFile(*shared.value[k][3:])
                at = place(key, page_id)
                out += file.between(at, at)
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "archive", "offset", "length"])

    wanted = map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url").distinct(), deal, "key string, page_id long, part long")
    order = ["part", "key", "page_id"]
    return map_arrow(wanted.distinct().repartitionByRange(n, *order).sortWithinPartitions(*order), search, CAPTURE)


def read(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of captures, read by ranges: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def records(batches):
        import pyarrow as pa

        path, f = None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = []
                for archive, offset, length in zip(*[c.to_pylist() for c in batch.slice(a, 500).columns], strict=True):
                    if archive != path:
                        path, f = archive, open_input(archive)
                    r = parse(zlib.decompress(read_range(f, offset, length), 31))
                    rows.append([r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]])
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                    keep = 6 if with_payload else 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], types[:keep], strict=True)], names=names[:keep])

    # a stretch of 64 MB of an archive goes to one task, front to back
    found = captures.select("archive", "offset", "length").repartition(n, "archive", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("archive", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_arrow(found, records, schema + (", payload binary" if with_payload else ""))


@tidy
def round_trip(pages: DataFrame) -> DataFrame:
    """Write all of `pages` as archives in the shared storage, index them, find each page by bisection and read its record back."""
    folder = fresh_path(pages.sparkSession, "warc")
    out = read(find(index(write(pages, folder), folder), pages))
    out._folders = {folder.rpartition("/")[2]}
    return out
