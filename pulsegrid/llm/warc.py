"""WARC archives: a writer with one gzip member a record, and a reader that splits files at any byte.

Writing: the payload digests are counted first; only digests that occur more than once are joined back (narrow rows,
a third of which may share one), and every task writes one archive through Arrow's file systems, beside its final
name, and moves it there, so that a task that runs again replaces its own file. Reading: a task takes a byte range,
looks for gzip's magic bytes, and takes a place for a record's start only if the member inflates to a WARC header
with a length, however long the header is; it owns the records that start in its range and reads past the end to finish the last one.

Records: ``response`` with the payload, or ``revisit`` with an empty block that names the response. Of equal
payloads of at least ``least`` bytes, the row with the smallest id is the response and the others revisit it.

Cases: a null payload is empty. Rows that repeat the smallest id of a payload are responses as well. Null ids are
larger than others; if a payload has only such rows, all are responses. An empty table writes and returns nothing. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import file_system, shared_folder, stage

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:pulsegrid:page:"

#: Payloads of fewer bytes are responses always.
LEAST_BYTES = 0
SPLIT_BYTES = 4 << 20
#: What a reader fetches at once.
CHUNK = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member with the record of a page; ``refers_to`` makes it a revisit."""
    block = b"" if refers_to is not None else payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
              ("WARC-Date", date), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(block)),
              ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Payload-Length", len(payload))]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + head + b"\r\n" + block + END) + packer.flush()


def _write_partition(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = file_system(folder)
        final = posixpath.join(root, f"part-{task.partitionId():06d}.warc.gz")
        trial, out, size = f"{final}.{task.taskAttemptId()}.tmp", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(trial)
                data = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"])
                out.write(data)
                size += len(data)
        if out is None:
            return
        out.close()
        if fs.get_file_info(final).type.name == "File":
            fs.delete_file(final)
        fs.move(trial, final)
        yield pa.RecordBatch.from_pydict({"file": [posixpath.basename(final)], "size": [size]})
    return write


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes ``pages`` under ``folder``; returns (file, size), a row an archive."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = F.unhex(F.sha1(F.encode("html", "UTF-8")))
    shared = rows.where(F.octet_length("html") >= least).groupBy(digest.alias("digest")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    shared = stage(shared, "shared_payloads")
    refers_to = F.when((F.octet_length("html") >= least) & (~F.col("page_id").eqNullSafe(F.col("first"))), F.col("first"))
    with_first = rows.join(shared, digest == F.col("digest"), "left").select("page_id", "url", "html", refers_to.alias("refers_to"))
    return stage(with_first.mapInArrow(_write_partition(folder), "file string, size bigint"), "archives")


# ---- reading

class _Window:
    """Bytes of a file by position, fetched in chunks; earlier ones are dropped on request."""

    def __init__(self, source):
        self.source, self.size, self.at, self.data = source, source.size(), 0, b""

    def ensure(self, position: int, length: int) -> None:
        if position < self.at or position > self.at + len(self.data):
            self.at, self.data = position, b""
        while self.at + len(self.data) < min(position + length, self.size):
            self.source.seek(self.at + len(self.data))
            self.data += self.source.read(min(CHUNK, self.size - self.at - len(self.data)))
        if position - self.at > CHUNK:
            self.data, self.at = self.data[position - self.at:], position

    def get(self, position: int, length: int) -> bytes:
        self.ensure(position, length)
        return self.data[position - self.at:position - self.at + length]

    def find(self, what: bytes, position: int, end: int) -> int:
        """The next place of ``what`` that starts in [position, end), or -1."""
        while position < end:
            piece = self.get(position, CHUNK + len(what) - 1)
            k = piece.find(what)
            if k >= 0:
                return position + k if position + k < end else -1
            position += max(1, len(piece) - len(what) + 1)
            if position >= self.size:
                return -1
        return -1


def _member(window: _Window, position: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header fields, block and end of the record whose member starts here, or None if none does."""
    unpacker, out, at, head_end, length, fields = zlib.decompressobj(31), bytearray(), position, -1, 0, {}
    try:
        while not unpacker.eof:
            piece = window.get(at, 1 << 14 if head_end < 0 else 1 << 18)
            if not piece:
                return None
            seen = max(0, len(out) - 3)
            out += unpacker.decompress(piece)
            at += len(piece)
            if head_end < 0:
                if not out.startswith(VERSION[:5][:len(out)]):
                    return None
                head_end = out.find(b"\r\n\r\n", seen)
                if head_end >= 0:
                    fields = dict(line.split(": ", 1) for line in out[:head_end].decode().split("\r\n")[1:] if ": " in line)
                    length = int(fields["Content-Length"])
    except (zlib.error, UnicodeDecodeError, ValueError, KeyError):
        return None
    if head_end < 0 or len(out) < head_end + 4 + length:
        return None
    return fields, bytes(out[head_end + 4:head_end + 4 + length]), at - len(unpacker.unused_data)


def read_range(fs, path: str, lo: int, hi: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and blocks of the records that start in [lo, hi)."""
    with fs.open_input_file(path) as source:
        window, at = _Window(source), lo
        while (at := window.find(MAGIC, at, hi)) >= 0:
            found = _member(window, at)
            if found is None:
                at += 1
            else:
                yield found[0], found[1]
                at = found[2]


def _page(field: str | None) -> int | None:
    value = (field or "").removeprefix(f"<{ID_PREFIX}").removesuffix(">")
    return int(value) if value else None


READ_SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read_warc(spark: SparkSession, folder: str, files: DataFrame, split: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives (file, size) under ``folder``; digests of responses are made from their payloads."""
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("bigint"))).alias("lo"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for head, block in read_range(fs, posixpath.join(root, row["file"]), row["lo"], row["lo"] + split):
                    kind = head["WARC-Type"]
                    whole = kind == "response"
                    digest = base32_sha1(block) if whole else head["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, len(block) if whole else int(head["WARC-Payload-Length"]),
                                 digest, _page(head.get("WARC-Refers-To")), block if with_payload and whole else None))
                    held += len(block) if with_payload else 100
                    if held > 1 << 23:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # by number: ranges are tiny rows for much work, and would be put in one partition by their size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "file", "lo").mapInArrow(read, READ_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# the SHA-1 in base32: its 160 bits in groups of five, each a letter of the alphabet
OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
       (CAST(('0x' || substr(h, 1 + (i // 8) * 10, 10)) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1), '' ORDER BY i)
   FROM range(32) AS r(i)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
