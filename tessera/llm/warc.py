"""WARC archives with a two-level capture index.

Every task writes one archive: gzip members, one record each, through a
filesystem of the path's own kind. Repeated payloads become revisit records.
Captures are ranged by their reversed-host URL key over the whole corpus and
written as compressed blocks, one index file for each task; the sparse directory
holds each block's first and last key and place. Lookups bisect the index files'
key ranges, then the file's part of the directory, read the blocks that may hold
the key, bisect them, and read the records' ranges only. Only the key ranges of
the files, one row for each index task, are on the driver; a file's part of the
directory meets its lookups in a task. The query looks up all keys this way.

Defined cases: null html is an empty payload; a null or malformed URL is its
own key; payloads under 100 bytes are never revisits; rows without a page_id are
always responses; equal rows of one id are all responses; an empty table gives
no archives and an empty result; other columns are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import new_folder, small_enough, table, written

LEAST_REVISIT_BYTES = 100
#: Captures in one compressed index block.
BLOCK_CAPTURES = 2000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Reversed-host key: ``https://www.a.example.com/x?y#z`` becomes ``com,example,a)/x?y``."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", ""), "#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.coalesce(key, url, F.lit(""))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, key, digest, refers_to and refers_to_url of every page; the smallest id of equal payloads is the response."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("html"))
    base = base.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "key": url_key(F.col("url"))})
    # payloads stay where they are: only digests and ids are grouped and joined
    slim = base.where((F.octet_length("html") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("digest", "page_id", "url")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    firsts = written(firsts, "firsts")
    known = slim.join(small_enough(firsts), "digest")
    urls = known.where("page_id = first").groupBy("digest").agg(F.min("url").alias("refers_to_url"))
    refers = known.where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct().join(urls, "digest")
    return base.join(small_enough(written(refers, "refers")), ["page_id", "digest"], "left")


def record_name(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>"


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None = None) -> bytes:
    """One WARC record, uncompressed."""
    body = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_name(page_id, url), "WARC-Date": DATE, "WARC-Target-URI": one_line(url),
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)),
    }
    if kind == "revisit":
        named = refers_to_url or ""
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_name(refers_to, named), "WARC-Refers-To-Target-URI": one_line(named), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-Id": str(refers_to)}
    return packed(head, body)


def one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def packed(head: dict[str, str], body: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def warcinfo(path: str) -> bytes:
    """The record that opens an archive."""
    body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    name = path.rpartition("/")[2]
    return packed({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": str(len(body))}, body)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    if len(body) != int(headers["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    return headers, body.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else b""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page; returns the written captures (key, page_id, file, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, inner = opened(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        out, at = None, 0
        try:
            for batch in batches:
                rows = {"key": [], "page_id": [], "file": [], "offset": [], "length": []}
                for r in batch.to_pylist():
                    if out is None:
                        out = system.open_output_stream(inner, compression=None)
                        first = gzip.compress(warcinfo(path), 6, mtime=0)
                        out.write(first)
                        at = len(first)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    member = gzip.compress(record(kind, r["page_id"], r["url"] or "", r["html"].encode(), r["digest"], r["refers_to"], r["refers_to_url"]), 6, mtime=0)
                    out.write(member)
                    for k, v in zip(rows, (r["key"], r["page_id"], path, at, len(member)), strict=True):
                        rows[k].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"], pa.string()), pa.array(rows["page_id"], pa.int64()), pa.array(rows["file"], pa.string()), pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64())], list(rows))
        finally:
            if out:
                out.close()

    slim = with_revisits(pages).select("key", "page_id", "url", "html", "digest", "refers_to", "refers_to_url")
    return written(slim.mapInArrow(run, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, block: int = BLOCK_CAPTURES) -> DataFrame:
    """Range the captures by key, write compressed blocks; returns the written directory
    (first key, last key, file, offset, length, captures), one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}.cdx.gz"
        system, inner = opened(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        out, at, held = None, 0, []

        def flush(rows: list[dict]) -> dict:
            nonlocal out, at
            out = out or system.open_output_stream(inner, compression=None)
            packed = zlib.compress("\n".join(json.dumps([r["key"], r["page_id"], r["file"], r["offset"], r["length"]]) for r in rows).encode(), 6)
            out.write(packed)
            at += len(packed)
            return {"first": rows[0]["key"], "last": rows[-1]["key"], "file": path, "offset": at - len(packed), "length": len(packed), "captures": len(rows)}

        kind = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("captures", pa.int64())])
        try:
            for batch in batches:
                held += batch.to_pylist()
                done = []
                while len(held) >= block:
                    done.append(flush(held[:block]))
                    held = held[block:]
                yield pa.RecordBatch.from_pylist(done, kind)
            if held:
                yield pa.RecordBatch.from_pylist([flush(held)], kind)
        finally:
            if out:
                out.close()

    ranged = captures.repartitionByRange("key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    return written(ranged.mapInArrow(run, "first string, last string, file string, offset long, length long, captures long"), "directory")


def read_range(path: str, offset: int, length: int) -> bytes:
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        return f.read_at(length, offset)


def block_rows(path: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(read_range(path, offset, length)).decode().split("\n")]


def equal_range(keys: list[str], key: str) -> range:
    return range(bisect_left(keys, key), bisect_right(keys, key))


def holding(firsts: list[str], lasts: list[str], key: str) -> Iterator[int]:
    """The places of the ranges, in order, that may hold the key; a key may go on over several."""
    i = bisect_left(lasts, key)
    while i < len(firsts) and firsts[i] <= key:
        yield i
        i += 1


def lookup(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """The captures of the keys in ``wanted`` (key): files by their ranges, blocks by the directory, rows by bisection."""
    files = sorted(tuple(r) for r in directory.groupBy("file").agg(F.min("first"), F.max("last")).select("min(first)", "max(last)", "file").collect())  # one row for each index task
    shared = directory.sparkSession.sparkContext.broadcast(files)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, names = ([f[i] for f in shared.value] for i in range(3))
        for batch in batches:
            keys = [(k, names[i]) for k in batch["key"].to_pylist() for i in holding(firsts, lasts, k)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([f for _, f in keys], pa.string())], ["key", "file"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        name, blocks, firsts, lasts, at, rows, keys = None, [], [], [], None, [], []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, blocks, firsts, lasts, at = r["file"], [], [], [], None
                if r["length"] is not None:  # the file's blocks come before the keys that are looked up in it
                    blocks.append((r["key"], r["last"], r["offset"], r["length"]))
                    continue
                if not firsts:
                    firsts, lasts = [b[0] for b in blocks], [b[1] for b in blocks]
                for i in holding(firsts, lasts, r["key"]):
                    if i != at:
                        at, rows = i, block_rows(name, *blocks[i][2:])
                        keys = [x[0] for x in rows]
                    out += [dict(zip(kind.names, rows[k], strict=True)) for k in equal_range(keys, r["key"])]
                    if len(out) >= BLOCK_CAPTURES:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out = []
            yield pa.RecordBatch.from_pylist(out, kind)

    placed = wanted.where("key is not null").select("key").distinct().mapInArrow(place, "key string, file string")
    asked = placed.select("file", "key", F.lit(None).cast("string").alias("last"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"))
    both = directory.select("file", F.col("first").alias("key"), "last", "offset", "length").union(asked)
    met = both.repartition("file").sortWithinPartitions("file", F.col("length").isNull(), "key", "offset")
    return met.mapInArrow(find, CAPTURE)


def read_records(captures: DataFrame) -> DataFrame:
    """Read each capture's range from its archive, in the order of places: page_id, url, html, payload_bytes,
    payload_digest, record_type and refers_to. A revisit has no html; its digest and length are those it declares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        source, name = None, None
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(first, 256).to_pylist():
                    if r["file"] != name:
                        if source:
                            source.close()
                        system, inner = opened(r["file"])
                        source, name = system.open_input_file(inner), r["file"]
                    head, payload = parse(gzip.decompress(source.read_at(r["length"], r["offset"])))
                    revisit, declared = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha256:")
                    digest = declared if revisit else hashlib.sha256(payload).hexdigest()
                    if digest != declared:
                        raise ValueError(f"{name} at {r['offset']}: payload does not match its digest")
                    rows.append({
                        "page_id": int(head["X-Page-Id"]) if head["X-Page-Id"] else None, "url": head["WARC-Target-URI"], "html": None if revisit else payload.decode(),
                        "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(payload), "payload_digest": digest, "record_type": head["WARC-Type"],
                        "refers_to": int(head["X-Refers-To-Page-Id"]) if revisit else None,
                    })
                yield pa.RecordBatch.from_pylist(rows, kind)
        if source:
            source.close()

    places = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    directory = write_index(write_archives(pages, folder), folder)
    captures = lookup(directory, pages.select(url_key(F.col("url")).alias("key")))
    return read_records(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of the query's rows.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, cast(n AS bigint) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
