"""WARC: archives of gzip members, and a splittable reader.

Writer: a record per row, each a gzip member of its own.  Of rows with equal
payloads of at least ``least`` bytes the smallest page_id is a response; the
others are revisits without a body that name it.  Rows that repeat the
response's page_id and payload are responses too; null page_ids come last.
Tasks write files under names of their own and return them; the stored manifest
lists those of successful attempts.

Reader: files are cut into byte ranges; a task scans its range for the gzip
magic, accepts a candidate member only if it inflates to a WARC header, and owns
the records that start inside its range (the last one is read beyond it).  From
an owned record on, the next starts where its member ends.  An archive whose
payloads hold gzipped WARC records stored without compression could show a
false start; this writer compresses payloads, so its members never do.

A null html is an empty payload.  An empty table gives an archive without
records.  Extra columns are ignored; a null url is written as an empty target.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm.common import cut, scratch_path, slices, to_batch
from hirelens.llm.files import open_file, write_file

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8_000_000
FILE_BYTES = 32_000_000
CHUNK = 1 << 16
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122 name space for URLs


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def member(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool,
           date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; of a revisit only the headers are kept."""
    body = b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head)
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """``pages``: page_id, url, html.  Returns the stored manifest: path, bytes, records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("digest") \
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select(F.col("digest").alias("of"), "first")
    rows = rows.join(firsts, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "html", "digest", "first",
        (F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "html", 4_000_000):
                for page, url, html, digest, first, revisit in zip(*(c.to_pylist() for c in part.columns),
                                                                   strict=True):
                    held.append(member(page, url, html.encode(), digest, first, revisit))
                    size += len(held[-1])
                    if size >= FILE_BYTES:
                        yield to_batch(schema, [[write_file(folder, "pages", ".warc.gz", held)], [size], [len(held)]])
                        held, size = [], 0
        if held:
            yield to_batch(schema, [[write_file(folder, "pages", ".warc.gz", held)], [size], [len(held)]])

    return cut(rows.mapInArrow(write, "path string, bytes long, records long"), "warc-manifest")


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers by lower-case name and the body, or None if it is no whole WARC record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or not gap:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.decode().strip().lower()] = v.decode().strip()
    if not fields.get("content-length", "").isdigit():
        return None
    return fields, rest[:int(fields["content-length"])]


class _Source:
    """A file read forward in chunks from any place."""

    def __init__(self, f):
        self.f, self.size = f, f.size()

    def chunks(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            got = self.f.read_at(min(CHUNK, self.size - at), at)
            at += len(got)
            yield got


def inflate(source: _Source, at: int, only_head: bool = False) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at``; None if there is none.  ``only_head``: up to the blank line."""
    z, out, used = zlib.decompressobj(31), [], 0
    try:
        for got in source.chunks(at):
            out.append(z.decompress(got))
            used += len(got)
            if z.eof:
                return b"".join(out), at + used - len(z.unused_data)
            if only_head and (not (seen := b"".join(out)).startswith(b"WARC/1."[:len(seen)]) or b"\r\n\r\n" in seen):
                return seen, at
    except zlib.error:
        pass
    return None


def next_start(source: _Source, at: int, end: int) -> int | None:
    """The first validated record start in [at, end)."""
    tail, base = b"", at
    for got in source.chunks(at):
        data, origin = tail + got, base - len(tail)
        k = data.find(MAGIC)
        while k >= 0:
            if origin + k >= end:
                return None
            seen = inflate(source, origin + k, only_head=True)
            if seen and seen[0].startswith(b"WARC/1.") and parse(seen[0]):
                return origin + k
            k = data.find(MAGIC, k + 1)
        tail, base = data[-2:], base + len(got)
        if base - 2 >= end:
            return None
    return None


def records(f, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in [start, end)."""
    source = _Source(f)
    at = next_start(source, start, end)
    while at is not None and at < end:
        whole = inflate(source, at)
        found = parse(whole[0]) if whole else None
        if found:
            yield found
            at = whole[1]
            if at < min(end, source.size) and f.read_at(3, at) != MAGIC:
                at = next_start(source, at, end)
            elif at >= source.size:
                return
        else:
            at = next_start(source, at + 1, end)


def splits(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, start, end for each ``split`` bytes of (path, bytes)."""
    return files.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
        .alias("start")).select("path", "start", F.least(F.col("start") + split, "bytes").alias("end"))


def read_archives(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """headers (map) and payload (binary) of every record of (path, bytes)."""
    schema = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heads, bodies, size = [], [], 0
                with open_file(path) as f:
                    for head, body in records(f, start, end):
                        heads.append(list(head.items()))
                        bodies.append(body)
                        size += len(body) + 1000
                        if size >= 8_000_000:
                            yield to_batch(schema, [heads, bodies])
                            heads, bodies, size = [], [], 0
                yield to_batch(schema, [heads, bodies])

    ranges = splits(files, split)
    tasks = max(1, min(ranges.count(), 4096))  # without a number, so few rows would go to one task
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, "headers map<string,string>, payload binary")


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes of every archive in a folder, for archives without a manifest."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder) \
        .select("path", F.col("length").alias("bytes"))


def op6_query(pages: DataFrame) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc-files")
    manifest = write_archives(pages, folder)
    found = read_archives(manifest.select("path", "bytes"))
    h = F.col("headers")
    kind = h["warc-type"]
    number = lambda name: F.expr(f"try_cast(headers['{name}'] as long)")
    return found.select(
        number("x-page-id").alias("page_id"),
        F.when(kind == "revisit", number("x-payload-length")).otherwise(F.octet_length("payload").cast("long"))
        .alias("payload_bytes"),
        F.when(kind == "revisit", F.substring_index(h["warc-payload-digest"], ":", -1))
        .otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        kind.alias("record_type"), number("x-refers-to-page-id").alias("refers_to"))


SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM rows WHERE strlen(html) >= 100 GROUP BY digest)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, rows.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows LEFT JOIN firsts ON rows.digest = firsts.digest
"""
