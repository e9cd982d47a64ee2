"""WARC archives with a two-level capture index.

Writing: each page becomes a gzip member of its own in a WARC/1.1 file. Pages with equal payloads are decided on a slim
table (digests grouped with partial maxima); payloads travel compressed, once. A task writes its own file into the
shared folder and returns where each record lies, so a task that is run again writes another file and only the records
of the attempt that counted are indexed.

Index: lines sorted by reversed-host URL key and page id, range-partitioned, cut into gzip blocks of `block_lines`; the
directory holds a block's first and last key and where it lies, a line for each block. A look-up sorts its keys by
range, reads only the stretch of the directory that its keys span, finds the block by binary search, reads that range
of the index file, finds the line by binary search and reads the record's range of the archive.

Defined results: a null payload is empty; equal payloads shorter than `least_bytes` are all responses; of longer ones,
the rows with the largest page id are responses (all of them, if rows repeat) and the others revisit it; a row with a
null id revisits, or is a response where all ids are null; a null or broken URL is a key as it stands; an empty table
gives no archive and no rows; extra columns are ignored. The shared folder must be one that pyarrow's file systems
open (a mounted path, HDFS, S3)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DATE = "2000-01-01T00:00:00Z"
#: Records that one task of a look-up reads.
RECORDS_A_TASK = 10_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACES = "page_id long, key string, url string, file string, offset long, length long"
DIRECTORY = "first string, last string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The key that URLs sort by: host parts reversed, then path and query; no scheme, www, default port or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    host = re.sub(r"^www\d*\.", "", host)
    plain = {"http": 80, "https": 443}.get(parts.scheme.lower())
    at = f":{port}" if port and port != plain else ""
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + at + ")" + (parts.path or "/") + query


def sort_key(key: str, page_id: int | None) -> str:
    """One text that sorts as (key, page id); a tab sorts before all that keys hold."""
    clean = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", key)
    return f"{clean}\t{page_id if page_id is not None else -1:020d}"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None or pd.isna(page_id) else int(page_id)}>"


def _id(urn: str | None) -> int | None:
    digits = re.search(r"urn:page:(-?\d+)", urn or "")
    return int(digits[1]) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None = None) -> bytes:
    """A response or, without payload, a revisit record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """What a record holds; a response's size and digest are those of the payload read back."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out = {"page_id": _id(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": _id(fields.get("WARC-Refers-To"))}
    if out["record_type"] == "response":
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
    size = re.search(rb"Content-Length: (\d+)", http)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return out | {"payload": None, "payload_bytes": int(size[1]), "payload_digest": digest}


def _file(folder: str, name: str) -> tuple[pafs.FileSystem, str]:
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    attempt = TaskContext.get()
    return store, f"{path}/{name}-{attempt.partitionId():05d}-{attempt.taskAttemptId()}"


class Archive:
    """Folders of the WARC files, the index blocks and the directory."""

    def __init__(self, scratch: Scratch, least_bytes: int = 1000, block_lines: int = 3000):
        self.scratch, self.least_bytes, self.block_lines = scratch, least_bytes, block_lines
        self.files, self.blocks, self.directory = (f"{scratch.root}/{x}" for x in ("warc", "index", "directory"))

    def write(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
        """Writes the archives; where each record lies."""
        body = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"))
        slim = rows.select("page_id", F.sha1("body").alias("digest"), F.octet_length("body").alias("size"))
        slim = slim.where(F.col("size") >= self.least_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("copies"))
        equal = self.scratch.stage(slim.where((F.col("copies") > 1) & F.col("keep").isNotNull()), "equal").select(F.col("digest").alias("of"), "keep")

        def pack(batches):
            for batch in batches:
                ids, urls, bodies = (batch.column(c).to_pylist() for c in ("page_id", "url", "body"))
                digests = [hashlib.sha1(b).hexdigest() for b in bodies]
                sizes = [len(b) for b in bodies]
                members = [record(*x) for x in zip(ids, urls, bodies, sizes, digests, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(digests), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())],
                    names=["page_id", "url", "digest", "size", "member"],
                )

        packed = rows.mapInArrow(pack, "page_id long, url string, digest string, size long, member binary")
        packed = packed.join(equal, packed["digest"] == equal["of"], "left")
        revisits = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
        packed = packed.select("page_id", "url", "digest", "size", F.when(revisits, F.col("keep")).alias("keep"), F.when(~revisits, F.col("member")).alias("member"))
        folder = self.files

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, at = None, 0
            for batch in batches:
                if out is None and batch.num_rows:
                    store, path = _file(folder, "part")
                    out = store.open_output_stream(f"{path}.warc.gz", compression=None)
                    name = f"{path}.warc.gz".rpartition("/")[2]
                found = []
                for row in batch.to_pylist():
                    member = row["member"]
                    if member is None:
                        member = record(row["page_id"], row["url"], None, row["size"], row["digest"], row["keep"])
                    out.write(member)
                    found.append((row["page_id"], sort_key(url_key(row["url"]), row["page_id"]), row["url"], name, at, len(member)))
                    at += len(member)
                if found:
                    columns = zip(*found, strict=True)
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "key", "url", "file", "offset", "length"])
            if out is not None:
                out.close()

        return self.scratch.stage(packed.mapInArrow(write, PLACES), "places")

    def index(self, places: DataFrame) -> DataFrame:
        """Writes the index blocks and the directory; returns the directory."""
        folder, most = self.blocks, self.block_lines

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, at, lines, rows = None, 0, [], []

            def block():
                nonlocal at, lines
                data = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
                out.write(data)
                rows.append((lines[0].split(" ", 1)[0], lines[-1].split(" ", 1)[0], name, at, len(data)))
                at, lines = at + len(data), []

            for batch in batches:
                if out is None and len(batch):
                    store, path = _file(folder, "index")
                    name = f"{path}.gz".rpartition("/")[2]
                    out = store.open_output_stream(f"{path}.gz", compression=None)
                for line in zip(batch["key"], batch["file"], batch["offset"], batch["length"], strict=True):
                    lines.append("{} {} {} {}".format(*line))
                    if len(lines) == most:
                        block()
            if out is not None:
                if lines:
                    block()
                out.close()
                yield pd.DataFrame(rows, columns=["first", "last", "file", "offset", "length"])

        ordered = places.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
        return self.scratch.stage(ordered.mapInPandas(write, DIRECTORY), "directory")

    def look_up(self, keys: DataFrame) -> DataFrame:
        """The records under the keys (column `key`, as sort_key gives them): one row for each line of the index."""
        files, blocks, directory = self.files, self.blocks, self.directory

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            warcs = {}
            loaded, lines, line_keys = None, [], []

            def open_(folder: str, name: str):
                if (folder, name) not in warcs:
                    store, path = pafs.FileSystem.from_uri(folder)
                    warcs[folder, name] = store.open_input_file(f"{path}/{name}")
                return warcs[folder, name]

            for batch in batches:
                wanted = batch.column(0).to_pylist()
                if not wanted:
                    continue
                store, path = pafs.FileSystem.from_uri(directory)
                # Keys come in order: the least and the greatest of a batch bound the stretch of the directory to read.
                span = (ds.field("last") >= min(wanted)) & (ds.field("first") <= max(wanted))
                entries = ds.dataset(path, filesystem=store, format="parquet").to_table(filter=span).sort_by([("first", "ascending"), ("last", "ascending")]).to_pydict()
                firsts, lasts = entries["first"], entries["last"]
                rows = []
                for key in wanted:
                    # Equal keys may run over several blocks: from the first whose last key is not below, on.
                    at = bisect_left(lasts, key)
                    while at < len(firsts) and firsts[at] <= key:
                        place = (entries["file"][at], entries["offset"][at], entries["length"][at])
                        if loaded != place:
                            source = open_(blocks, place[0])
                            source.seek(place[1])
                            lines = zlib.decompress(source.read(place[2]), wbits=31).decode().split("\n")
                            line_keys, loaded = [x.split(" ", 1)[0] for x in lines], place
                        for line in lines[bisect_left(line_keys, key) : bisect_right(line_keys, key)]:
                            _, file, offset, length = line.rsplit(" ", 3)
                            source = open_(files, file)
                            source.seek(int(offset))
                            rows.append(parse(source.read(int(length))))
                        at += 1
                    if len(rows) >= 2000:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

        asked = keys.select("key").distinct()
        # As many partitions as there are records to read, not as the few bytes of their keys ask for.
        asked = asked.repartitionByRange(max(1, -(-asked.count() // RECORDS_A_TASK)), "key").sortWithinPartitions("key")
        return asked.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _records(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))
