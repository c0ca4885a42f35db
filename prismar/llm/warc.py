"""WARC (operator 3): archives with revisit records, and a two-level capture index over them.

Archives and index blocks are plain files in a folder that all executors share, reached through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import NO_ID, materialize, shared_dir, slices

ENTRY = "key string, page_id long, file string, at long, size long"
_ENTRY = ["key", "page_id", "file", "at", "size"]


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def reversed_host_key(url: str | None) -> str:
    """http://www.a.org:80/x?y -> org,a,www:80)/x?y; captures of a site and its parts stand side by side. Null is the empty key."""
    if not url:
        return ""
    url = url.translate({9: "%09", 10: "%0A", 13: "%0D"})
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, as a gzip member of its own."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(3, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """The headers of a record, and its payload (of a response: what follows the HTTP head)."""
    data = zlib.decompress(raw, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    declared = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    return {"fields": fields, "payload": payload, "declared": declared}


def plan_records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(pid, digest, refers_to) of the pages that revisit another: of equal payloads of `min_bytes` or more, the largest page_id responds."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    narrow = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("pid"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    keepers = narrow.groupBy("digest").agg(F.max("pid").alias("refers_to"), F.min("pid").alias("least")).where(F.col("least") != F.col("refers_to")).drop("least")
    return narrow.select("pid", "digest").distinct().join(keepers, "digest").where(F.col("pid") != F.col("refers_to"))


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 1000, block_lines: int = 1000) -> DataFrame:
    """Write one archive per task and the index over all; returns the block directory: file, first_key, first_page, at, size, lines.

    Index lines are sorted by (reversed-host key, page_id) over range partitions; each partition is a file of zlib blocks of
    `block_lines` lines, closed by its own part of the directory. The directory has a row for each block. A url that many pages share is spread by page_id.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("pid"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    planned = rows.join(materialize(plan_records(pages, min_bytes), "warc-plan"), ["pid", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in slices(batches, "html"):
            entries = []
            for pid, digest, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("pid", "digest", "url", "html", "refers_to"))):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                raw = record("response" if refers is None else "revisit", pid, url, payload, digest, len(payload), refers)
                out.write(raw)
                entries.append((reversed_host_key(url), pid, name, at, len(raw)))
                at += len(raw)
            if entries:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*entries)], _ENTRY)
        if out is not None:
            out.close()

    entries = materialize(planned.mapInArrow(write, ENTRY), "warc-entries")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        name, at, out, held, blocks = f"{uuid.uuid4().hex}.idx", 0, None, [], []

        def block(lines: list[tuple]) -> tuple:
            nonlocal at, out
            if out is None:
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
            out.write(raw)
            at += len(raw)
            blocks.append((lines[0][0], lines[0][1], at - len(raw), len(raw)))
            return (name, lines[0][0], lines[0][1], at - len(raw), len(raw), len(lines))

        for batch in batches:
            made = []
            held += zip(*(batch.column(c).to_pylist() for c in _ENTRY))
            while len(held) >= block_lines:
                made.append(block(held[:block_lines]))
                held = held[block_lines:]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["file", "first_key", "first_page", "at", "size", "lines"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[block(held)])], ["file", "first_key", "first_page", "at", "size", "lines"])
        if out is not None:
            raw = zlib.compress("\n".join("\t".join(map(str, b)) for b in blocks).encode(), 6)
            out.write(raw + len(raw).to_bytes(8, "big"))
            out.close()

    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = entries.repartitionByRange(parts, "key", "page_id", F.xxhash64("file", "at")).sortWithinPartitions("key", "page_id", "file", "at")
    return materialize(ordered.mapInArrow(index, "file string, first_key string, first_page long, at long, size long, lines long"), "warc-directory")


class IndexReader:
    """Finds captures: the file by the top level, the block by the directory at the file's end, the lines in the block, each by
    binary search, and then reads just those ranges."""

    def __init__(self, folder: str, top: list[tuple[str, int, str]]):
        self.files, self.root = open_folder(folder)
        self.top, self.directory, self.loaded = top, ("", []), (("", -1), [])

    def read(self, file: str, at: int, size: int) -> bytes:
        with self.files.open_input_file(f"{self.root}/{file}") as f:
            f.seek(at)
            return f.read(size)

    def blocks(self, file: str) -> list[tuple]:
        if self.directory[0] != file:
            with self.files.open_input_file(f"{self.root}/{file}") as f:
                end = f.size()
                f.seek(end - 8)
                size = int.from_bytes(f.read(8), "big")
                f.seek(end - 8 - size)
                lines = zlib.decompress(f.read(size)).decode().split("\n")
            self.directory = (file, [(k, int(p), int(at), int(n)) for k, p, at, n in (x.split("\t") for x in lines)])
        return self.directory[1]

    def block(self, file: str, at: int, size: int) -> list[tuple]:
        if self.loaded[0] != (file, at):
            lines = (x.split("\t") for x in zlib.decompress(self.read(file, at, size)).decode().split("\n"))
            self.loaded = ((file, at), [(k, int(p), f, int(a), int(n)) for k, p, f, a, n in lines])
        return self.loaded[1]

    def lines(self, key: str, page_id: int) -> Iterator[tuple]:
        """All index lines of a capture; equal ones may go on in the next blocks or files."""
        def span(rows: list[tuple]) -> list[tuple]:
            first = max(0, bisect_left(rows, want, key=lambda t: t[:2]) - 1)
            return rows[first : max(first + 1, bisect_right(rows, want, key=lambda t: t[:2]))]

        want = (key, page_id)
        for _, _, file in span(self.top):
            for _, _, at, size in span(self.blocks(file)):
                found = self.block(file, at, size)
                yield from found[bisect_left(found, want, key=lambda t: t[:2]) : bisect_right(found, want, key=lambda t: t[:2])]


CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def lookup(keys: DataFrame, folder: str, directory: DataFrame, payload: bool = False) -> DataFrame:
    """The captures of distinct (key, page_id) rows, read back from the archives; with `payload`, a response's payload too.

    Keys are dealt in the index's order, so that a task meets each block once. What is broadcast is the top level: a row for each index
    file, of which there is one per write task. A response's digest is taken over the payload read; a revisit's comes from its record.
    """
    top = [tuple(r) for r in directory.groupBy("file").agg(F.min(F.struct("first_key", "first_page")).alias("m")).select("m.first_key", "m.first_page", "file").orderBy("first_key", "first_page", "file").collect()]
    shared = keys.sparkSession.sparkContext.broadcast(top)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payload]
    names = [c.split()[0] for c in CAPTURE.split(", ")] + ["payload"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, shared.value)
        for batch in batches:
            lines = [x for k, p in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()) for x in reader.lines(k, p)] if shared.value else []
            out: list = [None] * len(lines)
            order = sorted(range(len(lines)), key=lambda i: lines[i][2:4])
            for file, group in groupby(order, key=lambda i: lines[i][2]):
                with reader.files.open_input_file(f"{reader.root}/{file}") as f:
                    for i in group:
                        f.seek(lines[i][3])
                        got = parse_record(f.read(lines[i][4]))
                        kind, body = got["fields"]["WARC-Type"], got["payload"]
                        digest = hashlib.sha1(body).hexdigest() if kind == "response" else base64.b32decode(got["fields"]["WARC-Payload-Digest"][5:]).hex()
                        refers = got["fields"].get("WARC-Refers-To")
                        page = lines[i][1] if lines[i][1] != NO_ID else None
                        out[i] = (page, len(body) if kind == "response" else got["declared"], digest, kind, int(refers[10:-1]) if refers else None, *[body if kind == "response" else None] * payload)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(read, CAPTURE + ", payload binary" * payload)


def page_keys(pages: DataFrame) -> DataFrame:
    """Distinct (key, page_id) of pages."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reversed_host_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], ["key", "page_id"])

    return pages.select("url", F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id")).mapInArrow(keyed, "key string, page_id long").distinct()


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write all pages to archives with their index, then look every page up again: a row per page row.

    A null html is an empty payload; pages without url have the empty key; repeated rows are written and read each; a null
    page_id counts as the smallest and comes back null; pages of any length are one record each; with no page there is no file and no row.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    directory = write_archive(pages, folder, min_bytes)
    return lookup(page_keys(pages), folder, directory)
