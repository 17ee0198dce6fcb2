"""WARC archives with a two-level capture index.

write_archive() writes one WARC record a page, each a gzip member of its own, to
files of bounded size in the shared folder. Of records with equal payloads the
one with the smallest page_id is a response, the others are revisits of it. The
capture index is sorted by reversed-host URL key and page and cut into files, one a
task; a file holds compressed blocks of BLOCK_LINES lines, and beside it stands its
sparse directory, a line a block. What write_archive() returns, the index, has a row
a file.

lookup() finds the captures of any number of URL keys: a key's files by binary search
among the files, its blocks by binary search in a file's directory, one range read a
block, and binary search among its lines. Keys meet at the blocks, so a key of very
many captures is read by many tasks, and a block once. read_records() reads records
by ranges, file by file in order of offset. read_archive() looks up every key.

A task writes under a name of its own and returns what it wrote, so a task that
is run again leaves at most a file that no index names.

Nulls: a null html is an empty payload; a null URL has the key ''. A null
page_id comes after all others; a group of copies that has no id at all is all
responses. Rows that repeat a page's id and payload have the same record type.
An empty table gives an empty archive. Columns other than page_id, url and html
are not read. Pages are handled a few megabytes at a time, a longer page alone.
"""

from __future__ import annotations

import gzip
import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import by_bytes, materialize, scratch

BLOCK_LINES = 1000
MAX_FILE_BYTES = 1 << 28
DATE = "2024-01-01T00:00:00Z"

_CAPTURE = (
    "surt string, page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, file string, offset long, length long"
)
_INDEX = "first_surt string, last_surt string, file string, directory string, blocks long, lines long"
_BLOCK = "file string, offset long, length long, key string"
#: Bytes of payloads that a batch of records holds about.
_AT_ONCE = 4 << 20
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(path: str):
    """(file system, path in it) of a URI or a local path, in driver or executor."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def surt(url: str | None) -> str:
    """Sort key: host labels reversed, then port, path and query; the scheme, a leading www and the fragment don't count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    labels = host.split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def _header(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def warc_record(page_id, url, record_type: str, refers_to, digest: str, payload: bytes) -> bytes:
    """One record as a gzip member. A revisit holds no payload but says its length and digest."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if record_type == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
        body += b"\r\n"
    else:
        body += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """Fields of a record; a response's digest and length are computed from its payload and compared."""
    import base64
    import hashlib

    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(body) != int(fields["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    payload = body.partition(b"\r\n\r\n")[2]
    page = lambda key: int(x) if (x := fields[key].removeprefix("<urn:page:").rstrip(">")) else None
    out = {
        "page_id": page("WARC-Record-ID"),
        "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To") if "WARC-Refers-To" in fields else None,
        "payload": payload,
    }
    if out["record_type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != out["payload_digest"] or len(payload) != out["payload_bytes"]:
            raise ValueError("a WARC payload differs from its digest")
    return out


class _Writer:
    """Writes batches of pages to archive files and yields their captures."""

    def __init__(self, folder: str, max_bytes: int):
        self.folder, self.max_bytes = folder, max_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        names = [x.split()[0] for x in _CAPTURE.split(", ")]
        out, at, name = None, 0, ""
        try:
            for batch in (x for whole in batches for x in by_bytes(whole, "html", _AT_ONCE)):
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= self.max_bytes:
                        if out is not None:
                            out.close()
                        name = f"{self.folder}/pages-{uuid.uuid4().hex}.warc.gz"
                        out, at = _create(name), 0
                    payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    kind = "revisit" if r["first_id"] is not None and r["first_id"] != r["page_id"] else "response"
                    to = r["first_id"] if kind == "revisit" else None
                    member = warc_record(r["page_id"], r["url"], kind, to, digest, payload)
                    out.write(member)
                    rows.append((surt(r["url"]), r["page_id"], r["url"], kind, to, digest, len(payload), name, at, len(member)))
                    at += len(member)
                if rows:
                    yield _batch(rows, _CAPTURE)
        finally:
            if out is not None:
                out.close()


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [f for f, _ in fields])


class _BlockWriter:
    """Writes sorted captures as a file of compressed blocks, and its directory; yields the file's row of the index."""

    def __init__(self, folder: str, lines: int):
        self.folder, self.lines = folder, lines

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks, at, out = [], [], 0, None
        name = f"{self.folder}/captures-{uuid.uuid4().hex}"

        def write_block() -> None:
            nonlocal at
            data = gzip.compress("".join(json.dumps(x) + "\n" for x in held).encode(), 6, mtime=0)
            blocks.append((held[0]["surt"], held[-1]["surt"], at, len(data), len(held)))
            out.write(data)
            at += len(data)
            held.clear()

        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if out is None:
                        out = _create(f"{name}.cdx.gz")
                    held.append(r)
                    if len(held) >= self.lines:
                        write_block()
            if held:
                write_block()
        finally:
            if out is not None:
                out.close()
        if blocks:
            with _create(f"{name}.dir.gz") as d:
                d.write(gzip.compress("".join(json.dumps(x) + "\n" for x in blocks).encode(), 6, mtime=0))
            row = (blocks[0][0], blocks[-1][1], f"{name}.cdx.gz", f"{name}.dir.gz", len(blocks), sum(x[-1] for x in blocks))
            yield _batch([row], _INDEX)


def _create(path: str):
    store, where = _open(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    return store.open_output_stream(where, compression=None)


def _read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    store, where = _open(path)
    with store.open_input_file(where) as f:
        f.seek(offset)
        return f.read(length)


def _lines(data: bytes) -> list:
    return [json.loads(x) for x in gzip.decompress(data).decode().splitlines()]


def surt_keys(urls: DataFrame) -> DataFrame:
    """key: the distinct keys of the column url."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(surt, batch.column(0).to_pylist()), pa.string())], ["key"])

    return urls.select("url").distinct().mapInArrow(keys, "key string").distinct()


def spans_of(key: str, firsts: list[str], lasts: list[str]) -> range:
    """Places in a sorted list of spans (first to last) that can hold the key, by binary search."""
    at = bisect_left(lasts, key)
    to = at
    while to < len(firsts) and firsts[to] <= key:
        to += 1
    return range(at, to)


class _BlockFinder:
    """The blocks that can hold each key; a task keeps the directory of the file it used last."""

    def __init__(self, files: list[tuple[str, str, str, str]]):
        self.files = files  # first key, last key, file, directory; in order

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = ([x[k] for x in self.files] for k in (0, 1))
        held, blocks = -1, []
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for k in spans_of(key, firsts, lasts):
                    if k != held:
                        held, blocks = k, _lines(_read(self.files[k][3]))
                        first, last = ([x[i] for x in blocks] for i in (0, 1))
                    for b in spans_of(key, first, last):
                        rows.append((self.files[k][2], blocks[b][2], blocks[b][3], key))
            yield _batch(rows, _BLOCK)


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures of the wanted keys of each block, which is read once."""
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    for batch in batches:
        for r in batch.to_pylist():
            lines = _lines(_read(r["file"], r["offset"], r["length"]))
            keys, rows = [x["surt"] for x in lines], []
            for key in r["keys"]:
                at = bisect_left(keys, key)
                while at < len(keys) and keys[at] == key:
                    rows.append(tuple(lines[at][n] for n in names))
                    at += 1
            yield _batch(rows, _CAPTURE)


class _RecordReader:
    """Range-reads records of captures that come in order of file and offset."""

    def __init__(self, payloads: bool):
        self.payloads = payloads

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        try:
            for batch in batches:
                rows, size = [], 0
                for c in batch.to_pylist():
                    if c["file"] != name:
                        if f is not None:
                            f.close()
                        store, path = _open(c["file"])
                        name, f = c["file"], store.open_input_file(path)
                    f.seek(c["offset"])
                    r = parse_record(f.read(c["length"]))
                    rows.append(
                        (r["page_id"], c["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                         r["payload"] if self.payloads else None)
                    )
                    size += len(r["payload"]) if self.payloads else 0
                    if size > _AT_ONCE:
                        yield _batch(rows, _RECORD)
                        rows, size = [], 0
                yield _batch(rows, _RECORD)
        finally:
            if f is not None:
                f.close()


def write_archive(
    pages: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES, max_file_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """Writes the archives and the index of (page_id, url, html) rows; returns the index, a row a file of blocks.

    Only the digests with more than one record meet the pages, in a join that
    Spark splits where one digest has very many.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("sha1", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    firsts = (
        rows.groupBy("sha1")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("sha1", "first_id")
    )
    captures = materialize(rows.join(firsts, "sha1", "left").mapInArrow(_Writer(folder, max_file_bytes), _CAPTURE), "captures")
    ordered = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return materialize(ordered.mapInArrow(_BlockWriter(folder, block_lines), _INDEX), "index")


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of the keys (distinct, column key), as in the capture index.

    The index's rows, one for each task that wrote it, go to the driver and to the tasks.
    """
    files = sorted((r.first_surt, r.last_surt, r.file, r.directory) for r in index.collect())
    near = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_BlockFinder(files), _BLOCK)
    blocks = near.groupBy("file", "offset", "length").agg(F.collect_set("key").alias("keys"))  # at most a block's lines
    return blocks.mapInArrow(_search_blocks, _CAPTURE)


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the captures, file by file in order of offset."""
    ordered = captures.repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_RecordReader(payloads), _RECORD)


def read_archive(index: DataFrame, urls: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all captures of the URLs (column url, repeated or not)."""
    return read_records(lookup(index, surt_keys(urls)), payloads)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archive(write_archive(pages), pages.select(F.col("url").cast("string").alias("url")), payloads=False).drop("payload")


SQL = """
WITH payloads AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first_id
  FROM pages)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(i // 4 AS INT) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INT))) & 31 AS INT) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM payloads
"""
