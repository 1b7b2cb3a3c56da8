"""WARC archives with a two-level capture index.

Each task writes one archive, a gzip member per record. Captures are then sorted by their reversed-host key
(com,example)/path and page over the whole crawl. The index has two levels: blocks of sorted captures, compressed and
appended to a shard's file, and beside it the shard's sparse directory with each block's first key and byte range. A
lookup binary-searches the shards' first keys, the shard's directory and the block, and reads a byte range of an archive
for each capture. Many lookups go sorted, so that each block is opened once.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from itertools import batched
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, HOT_KEYS, Scratch, slices, typed

MIN_REVISIT = 100
BLOCK_CAPTURES = 256
#: One date for all records: the tables hold no capture time, and equal inputs shall give equal archives.
DATE = "2000-01-01T00:00:00Z"


def sort_key(url: str | None) -> str:
    """Reversed host, port and path with query, lower-case host, without scheme, user, fragment and a leading www."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return "!" + re.sub(r"[\x00-\x20]", "_", url or "")
    if not host:
        return "!" + re.sub(r"[\x00-\x20]", "_", url or "")
    host = re.sub(r"^www\d*\.", "", host)
    path = u.path or "/"
    tail = path + ("?" + u.query if u.query else "")
    return re.sub(r"[\x00-\x20]", "_", ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail)


def urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def clean(url: str | None) -> str:
    """A header value: no line breaks; anything beyond printable ASCII is percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")


def record(page_id, url: str | None, payload: bytes, n: int, digest: str, refers_to) -> bytes:
    """A gzip member with one response or revisit record. A revisit carries headers only, and the payload's length n."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out = {"version": lines[0], **{k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}}
    body = rest[: int(out["content-length"])]
    http, _, out["payload"] = body.partition(b"\r\n\r\n")
    out["http-length"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return out


def page_of(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def open_folder(path: str):
    """(file system, path) of a folder URI or plain path, the same on every executor."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


CAPTURES = "skey string,page_id long,archive string,offset long,length long,digest string"
SHARDS = "shard string,first_key string,first_page long,blocks int,captures long"
NO_PAGE = -(1 << 63)  # stands for a null page_id in keys


def write_archives(work: Scratch, pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives into folder; returns one row per capture: key, page_id, archive and byte range.

    pages: page_id, url, html (null: empty). Of equal payloads of MIN_REVISIT bytes or more the smallest page_id is the
    response. Fully repeated rows: every row of the smallest page_id is a response. A null page_id never is referred
    to and refers to none. Null or broken URLs sort first, under keys that begin with "!". Every attempt of a task writes
    a file of its own name, and only the attempt whose rows stay is in the index.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"), "html")
    same = keyed.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c")).where("first <> last").drop("last")
    same = work.table("same", same)
    rows = same.agg(F.sum("c")).first()[0] or 0
    # At most HOT_KEYS digests stand in more rows than this: they are broadcast, and their revisits travel without html.
    hot = F.col("c") > max(FEW, rows // HOT_KEYS)
    near = keyed.join(F.broadcast(same.where(hot).select("digest", F.col("first").alias("hot"))), "digest", "left")
    # Of the rest only digests that can have revisits meet in the payloads' one exchange; other rows are dealt out evenly.
    alone = F.col("hot").isNotNull() | (F.col("n") < MIN_REVISIT)
    near = near.withColumn("key", F.when(alone, F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string"))).otherwise(F.col("digest")))
    near = near.withColumn("html", F.when(F.col("page_id") > F.col("hot"), None).otherwise(F.col("html")))
    rest = same.where(~hot).select(F.col("digest").alias("key"), "first").hint("merge")
    linked = near.join(rest, "key", "left").withColumn("first", F.coalesce("hot", "first"))
    linked = linked.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    columns = [x.split()[0] for x in CAPTURES.split(",")]

    def write(batches):
        name, out, at = f"part-{uuid.uuid4().hex}", None, 0
        store, path = open_folder(folder)
        try:
            for b in slices(batches, "html"):
                rows = []
                for p in b.to_pylist():
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                    member = record(p["page_id"], p["url"], (p["html"] or "").encode(), p["n"], p["digest"], p["refers_to"])
                    out.write(member)
                    rows.append((sort_key(p["url"]), p["page_id"], name, at, len(member), p["digest"]))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], columns)
        finally:
            if out is not None:
                out.close()

    return linked.select("page_id", "url", "digest", "n", "refers_to", "html").mapInArrow(typed(write, CAPTURES), CAPTURES)


def place(skey: str, page_id: int | None) -> tuple[str, int]:
    return skey, NO_PAGE if page_id is None else page_id


def write_index(captures: DataFrame, folder: str, size: int = BLOCK_CAPTURES) -> DataFrame:
    """Writes the sorted index of captures into folder, shard by shard: blocks of size captures and a sparse directory
    of them. Returns a row a shard."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "skey", "page_id").sortWithinPartitions("skey", "page_id", "archive", "offset")
    columns = [x.split()[0] for x in SHARDS.split(",")]

    def write(batches):
        directory, entries, name, out, at, total = [], [], f"shard-{uuid.uuid4().hex}", None, 0, 0
        store, path = open_folder(folder)

        def flush():
            nonlocal at, out, total
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}.idx", compression=None)
            data = zlib.compress("\n".join(json.dumps(e, separators=(",", ":")) for e in entries).encode(), 6)
            out.write(data)
            directory.append((*place(entries[0]["skey"], entries[0]["page_id"]), at, len(data)))
            at, total = at + len(data), total + len(entries)
            entries.clear()

        try:
            for b in batches:
                for c in b.to_pylist():
                    entries.append(c)
                    if len(entries) == size:
                        flush()
            if entries:
                flush()
        finally:
            if out is not None:
                out.close()
        if directory:
            with store.open_output_stream(f"{path}/{name}.dir", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory).encode(), 6))
        rows = [(name, *directory[0][:2], len(directory), total)] if directory else []
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([])] * len(columns), columns)

    return ordered.mapInArrow(typed(write, SHARDS), SHARDS)


class CaptureIndex:
    """The index in folder. shards: (first key, name), sorted, one for each task that wrote; it travels with tasks. One
    directory and one block are held at a time."""

    def __init__(self, folder: str, shards: list[tuple[tuple[str, int], str]]):
        self.folder, self.shards = folder, sorted(shards)
        self.held: dict = {}

    def __getstate__(self):
        return {"folder": self.folder, "shards": self.shards, "held": {}}

    def _once(self, kind: str, what, load):
        if self.held.get(kind, (None,))[0] != what:
            self.held[kind] = what, load()
        return self.held[kind][1]

    def directory(self, name: str) -> list[tuple[tuple[str, int], int, int]]:
        """(first key, offset, length) of each block of a shard."""

        def load():
            store, path = open_folder(self.folder)
            with store.open_input_file(f"{path}/{name}.dir") as f:
                return [((k, p), at, n) for k, p, at, n in json.loads(zlib.decompress(f.read()))]

        return self._once("directory", name, load)

    def block(self, name: str, at: int, n: int) -> list[tuple[tuple[str, int], dict]]:
        def load():
            store, path = open_folder(self.folder)
            with store.open_input_file(f"{path}/{name}.idx") as f:
                data = zlib.decompress(f.read_at(n, at)).decode()
            return [(place(e["skey"], e["page_id"]), e) for e in map(json.loads, data.split("\n"))]

        return self._once("block", (name, at), load)

    def entries(self, low: tuple[str, int], high: tuple[str, int]):
        """Captures with keys from low to high, one after another, by binary search in shards, directory and block."""
        first = itemgetter(0)
        for _, name in self.shards[max(0, bisect_left(self.shards, low, key=first) - 1) : bisect_right(self.shards, high, key=first)]:
            directory = self.directory(name)
            for _, at, n in directory[max(0, bisect_left(directory, low, key=first) - 1) : bisect_right(directory, high, key=first)]:
                block = self.block(name, at, n)
                yield from (e for _, e in block[bisect_left(block, low, key=first) : bisect_right(block, high, key=first)])

    def lookup(self, url: str):
        """Records captured under url's key, one after another."""
        key = sort_key(url)
        store, path = open_folder(self.folder)
        for some in batched(self.entries((key, NO_PAGE), (key, 1 << 63)), READ_ENTRIES):
            for _, data in read_ranges(store, path, list(some)):
                yield parse_record(data)


READ_ENTRIES, READ_BYTES = 4096, 8 << 20
RECORDS = "page_id long,payload_bytes long,payload_digest string,record_type string,refers_to long,url string"


def read_ranges(store, path: str, entries: list[dict]):
    """(entry, bytes) of each, archive by archive in order of offset; neighbours take one read, of READ_BYTES or one record."""
    entries = sorted(entries, key=lambda e: (e["archive"], e["offset"]))
    i = 0
    while i < len(entries):
        with store.open_input_file(f"{path}/{entries[i]['archive']}.warc.gz") as f:
            name = entries[i]["archive"]
            while i < len(entries) and entries[i]["archive"] == name:
                k, end = i, entries[i]["offset"] + entries[i]["length"]
                while k + 1 < len(entries) and entries[k + 1]["archive"] == name and entries[k + 1]["offset"] == end and end - entries[i]["offset"] < READ_BYTES:
                    k += 1
                    end += entries[k]["length"]
                start = entries[i]["offset"]
                data = f.read_at(end - start, start)
                for e in entries[i : k + 1]:
                    yield e, data[e["offset"] - start : e["offset"] - start + e["length"]]
                i = k + 1


def read_pages(index: CaptureIndex, pages: DataFrame) -> DataFrame:
    """The captures of pages (page_id, url), each looked up in the index; a capture once, however often its page stands.

    A response's length and digest are computed from the payload read; a revisit's are those of its record.
    """
    columns = [x.split()[0] for x in RECORDS.split(",")]

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sort_key(u) for u in b.column("url").to_pylist()], pa.string()), b.column("page_id")], ["skey", "page_id"])

    def row(entry: dict, data: bytes) -> tuple:
        x = parse_record(data)
        stated = x["warc-payload-digest"].removeprefix("sha256:")
        revisit = x["warc-type"] == "revisit"
        digest = stated if revisit else hashlib.sha256(x["payload"]).hexdigest()
        if digest != stated or not revisit and len(x["payload"]) != x["http-length"]:
            raise ValueError(f"{entry['archive']} at {entry['offset']}: the payload isn't the one written")
        return page_of(x["warc-record-id"]), x["http-length"], digest, x["warc-type"], page_of(x["warc-refers-to"]) if revisit else None, x["warc-target-uri"]

    def read(batches):
        store, path = open_folder(index.folder)
        for b in batches:
            wanted = (place(r["skey"], r["page_id"]) for r in b.to_pylist())
            for some in batched((e for key in wanted for e in index.entries(key, key)), READ_ENTRIES):
                rows = [row(e, data) for e, data in read_ranges(store, path, list(some))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], columns)

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = pages.select("page_id", "url").mapInArrow(typed(keys, "skey string,page_id long"), "skey string,page_id long").distinct()
    return wanted.repartitionByRange(n, "skey", "page_id").sortWithinPartitions("skey", "page_id").mapInArrow(typed(read, RECORDS), RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame) -> CaptureIndex:
    """Writes archives and index to the shared folder. Of the index only a name and a key a shard come to the driver,
    and there are as many shards as tasks that write them; these rows aren't written as files, which would be one a shard."""
    work = Scratch(spark, "warc")
    folder = f"{work.path}/archives"
    captures = work.table("captures", write_archives(work, pages, folder))
    shards = write_index(captures, folder).collect()
    work.drop("captures", "same")
    return CaptureIndex(folder, [((r.first_key, r.first_page), r.shard) for r in shards])
