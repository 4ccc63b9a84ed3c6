"""WARC archives with a two-level capture index.

``write`` turns pages into WARC 1.1 records, each its own gzip member: of
records with equal payloads of ``least`` bytes or more, the one of largest
page id is a response and the others are revisits that refer to it; smaller
payloads are all responses. Each task writes one archive through pyarrow's
file system layer, under a name no other attempt uses, and reports its
captures; what Spark commits of those reports decides which archives count,
so a lost or repeated task leaves at most an unlisted file.

The capture index has two levels, like a zipped CDX. Captures are sorted by
reversed-host URL key over range partitions; each task cuts its stretch into
blocks of ``BLOCK`` lines, each compressed by itself in one file, and lists
every block's first key, offset and length in a sparse directory. ``lookup``
binary-searches the directory, range-reads single blocks, and then
range-reads the records. ``read`` walks the whole index and reads every
record back.

Defined results: null html is an empty payload; a null URL has the empty
key; a null page id is smaller than any other, and a record whose group has
only null ids is a response; several records of the largest id of a group
are all responses; repeated rows each become a record; an empty table gives
no archive and empty results; other columns are ignored. Payloads are
written whole.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import os
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, scratch, shuffle_partitions, table

BLOCK = 2000  # index lines per compressed block
LEAST = 0  # bytes of a payload that may be revisited
CAPTURES = "url_key string, page_id bigint, url string, file string, offset bigint, length bigint, kind string, digest string"
DIRECTORY = "part int, first_key string, last_key string, file string, offset bigint, length bigint, n_lines bigint"
RECORDS = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
           "url string, payload_crc32 bigint")
STAMP = "2025-01-01T00:00:00Z"  # pages have no capture time


def url_key(url: str | None) -> str:
    """Reversed host, port, path and query: ``com,example,www)/a?b``; scheme, user and fragment are left out."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    key = ",".join(reversed(host.rstrip(".").split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, sha1: bytes, refers_to) -> bytes:
    """A response record, or a revisit that keeps the HTTP head and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
            f"WARC-Date: {STAMP}", f"WARC-Payload-Digest: sha1:{digest32(sha1)}"]
    if url is not None:
        head.insert(2, "WARC-Target-URI: " + json.dumps(url)[1:-1])  # control and other characters escaped
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; the payload digest is computed anew where the payload is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[:int(f["Content-Length"])]
    if rest[len(body):] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda name: int(name[10:-1]) if name[10:-1] else None
    stated = f["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = f["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest32(hashlib.sha1(payload).digest()) != stated):
        raise ValueError("a payload does not match its digest")
    url = f.get("WARC-Target-URI")
    return {"page_id": number(f["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": stated,
            "record_type": f["WARC-Type"], "refers_to": number(f["WARC-Refers-To"]) if revisit else None,
            "url": None if url is None else json.loads(f'"{url}"'), "payload_crc32": None if revisit else zlib.crc32(payload)}


def _sink(path: str):
    store, place = pafs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    return store.open_output_stream(place, compression=None)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_I, _S = pa.int64(), pa.string()
_CAPTURE = pa.schema([("url_key", _S), ("page_id", _I), ("url", _S), ("file", _S), ("offset", _I), ("length", _I),
                      ("kind", _S), ("digest", _S)])
_DIRECTORY = pa.schema([("part", pa.int32()), ("first_key", _S), ("last_key", _S), ("file", _S), ("offset", _I),
                        ("length", _I), ("n_lines", _I)])
_PLACE = pa.schema([("file", _S), ("offset", _I), ("length", _I)])
_RECORD = pa.schema([("page_id", _I), ("payload_bytes", _I), ("payload_digest", _S), ("record_type", _S),
                     ("refers_to", _I), ("url", _S), ("payload_crc32", _I)])


def with_original(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with their payload, its SHA-1, and ``refers_to`` for those that revisit another."""
    rows = pages.withColumn("sha1", F.sha1("payload"))
    same = (rows.where(F.octet_length("payload") >= least).groupBy("sha1")
            .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # Only payloads met again are joined; a hot one is a skewed join that Spark splits.
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return (rows.join(same, "sha1", "left")
            .select("page_id", "url", "payload", "sha1", F.when(other, F.col("keeper")).alias("refers_to")))


def _write(out):
    def write(batches):
        path, sink, at = f"{out}/archive/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            rows = []
            for page_id, url, payload, sha1, refers in zip(*(b.column(c).to_pylist() for c in (
                    "page_id", "url", "payload", "sha1", "refers_to"))):
                sink = sink or _sink(path)
                sha1 = bytes.fromhex(sha1)
                data = gzip.compress(record(page_id, url, payload, sha1, refers), 5, mtime=0)
                sink.write(data)
                rows.append((url_key(url), page_id, url, path, at, len(data),
                             "response" if refers is None else "revisit", digest32(sha1)))
                at += len(data)
            yield _batch(rows, _CAPTURE)
        if sink:
            sink.close()
    return write


def _index(out, block):
    def index(batches):
        part = TaskContext.get().partitionId()
        path, sink, at, lines, keys = f"{out}/index/{part:06d}-{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def flush():
            nonlocal sink, at, lines, keys
            sink = sink or _sink(path)
            data = gzip.compress("\n".join(lines).encode(), 5, mtime=0)
            sink.write(data)
            row = (part, keys[0], keys[-1], path, at, len(data), len(lines))
            at, lines, keys = at + len(data), [], []
            return row

        for b in batches:
            rows = []
            for r in b.to_pylist():
                lines.append(json.dumps(r))
                keys.append(r["url_key"])
                if len(lines) == block:
                    rows.append(flush())
            yield _batch(rows, _DIRECTORY)
        if lines:
            yield _batch([flush()], _DIRECTORY)
        if sink:
            sink.close()
    return index


def write(pages: DataFrame, out: str, least: int = LEAST, block: int = BLOCK, id_col="page_id", url_col="url",
          html_col="html") -> DataFrame:
    """Write archives and index under ``out``; the directory, one row per index block, is returned."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    captures = saved(with_original(rows, least).mapInArrow(_write(out), CAPTURES), f"{out}/captures")
    n = shuffle_partitions(pages.sparkSession)
    ordered = (captures.repartitionByRange(n, "url_key", "page_id", "file", "offset")
               .sortWithinPartitions("url_key", "page_id", "file", "offset"))
    return saved(ordered.mapInArrow(_index(out, block), DIRECTORY), f"{out}/directory")


class Files:
    """Open files of a task, the latest few."""

    def __init__(self, most: int = 64):
        self.open, self.most = {}, most

    def read(self, path: str, offset: int, length: int) -> bytes:
        f = self.open.pop(path, None)
        if f is None:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            store, place = pafs.FileSystem.from_uri(path)
            f = store.open_input_file(place)
        self.open[path] = f
        data = f.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{path} is shorter than its index says")
        return data


def block_lines(files: Files, path: str, offset: int, length: int) -> list[dict]:
    return [json.loads(x) for x in gzip.decompress(files.read(path, offset, length)).decode().split("\n")]


def _lines_of_blocks(batches):
    files = Files()
    for b in batches:
        for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
            yield _batch([(x["file"], x["offset"], x["length"]) for x in block_lines(files, path, offset, length)], _PLACE)


def _records(batches):
    files = Files()
    for b in batches:
        rows = []
        for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
            r = parse(gzip.decompress(files.read(path, offset, length)))
            rows.append(tuple(r[f.name] for f in _RECORD))
        yield _batch(rows, _RECORD)


def read(directory: DataFrame) -> DataFrame:
    """Every record, read back through the index: blocks, lines, then the archives in file order."""
    n = shuffle_partitions(directory.sparkSession)
    places = directory.repartition(n, "file", "offset").mapInArrow(_lines_of_blocks, "file string, offset bigint, length bigint")
    # 64 MB stretches of an archive go to one task each, in order.
    stretch = F.shiftright("offset", 26)
    return (places.repartition(n, F.col("file"), stretch).sortWithinPartitions("file", "offset")
            .mapInArrow(_records, RECORDS))


def lookup(directory: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Records of the asked URLs' keys: url_key, page_id, payload_bytes, record_type, ...

    The directory's stretches (one per index file, as many as range
    partitions) are the upper level; each asked key is sent to the stretches
    that may hold it and binary-searches their blocks there. A stretch that
    many keys ask for is dealt to several tasks by key.
    """
    spark = directory.sparkSession
    parts = [r.asDict() for r in directory.groupBy("part", "file").agg(
        F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).orderBy("lo", "hi", "part").collect()]
    blocks = saved(directory, scratch(spark, "directory"))
    los = [p["lo"] for p in parts]

    def route(batches):
        for b in batches:
            rows = []
            for u in b.column("url").to_pylist():
                k = url_key(u)
                at = bisect.bisect_right(los, k) - 1
                while at >= 0 and parts[at]["hi"] >= k:  # a key with very many captures may span stretches
                    rows.append((k, parts[at]["file"]))
                    at -= 1
            yield _batch(rows, pa.schema([("key", _S), ("index_file", _S)]))

    asked = urls.select(F.col(url_col).alias("url")).distinct().mapInArrow(route, "key string, index_file string").distinct()
    hit = asked.join(blocks, (F.col("index_file") == F.col("file")) & F.col("key").between(F.col("first_key"), F.col("last_key")))
    wanted = (hit.groupBy("file", "offset", "length").agg(F.collect_set("key").alias("wanted_keys")))

    def search(batches):
        files = Files()
        for b in batches:
            for path, offset, length, keys in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length", "wanted_keys"))):
                lines = block_lines(files, path, offset, length)
                of = [x["url_key"] for x in lines]
                got = []
                for k in keys:
                    for x in lines[bisect.bisect_left(of, k):bisect.bisect_right(of, k)]:
                        got.append((x["file"], x["offset"], x["length"]))
                yield _batch(got, _PLACE)

    found = wanted.mapInArrow(search, "file string, offset bigint, length bigint")
    return (found.repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "offset")
            .mapInArrow(_records, RECORDS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))).drop("url", "payload_crc32")
