"""Web archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames followed by a skippable frame with the seek
table: compressed and decompressed size of every frame, their number, and a magic number. The
index maps each record to its bundle, frame and place inside the decompressed frame, so one
record is read with two small reads and one frame is decompressed.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.shared import saved

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

SALTS = 16
INDEX = "record_id string, record_type string, bundle string, frame bigint, frame_offset bigint, record_bytes bigint"
RECORD = "record_id string, record_type string, refers_to string, url string, digest string, payload binary"


def filesystem(uri: str):
    """The file system of a path and the path on it; any that Arrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class BundleWriter:
    """One bundle file: records are gathered into frames of about ``frame_bytes``."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        import zstandard

        files, path = filesystem(uri)
        self.uri, self.frame_bytes = uri, frame_bytes
        self.out = files.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.filled = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the decompressed frame) of the record."""
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.filled
        self.parts.append(record)
        self.filled += len(record)
        return place

    def flush(self) -> None:
        if self.filled:
            packed = self.packer.compress(b"".join(self.parts))
            self.out.write(packed)
            self.table.append((len(packed), self.filled))
            self.written += len(packed)
            self.parts, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, uri: str):
        import zstandard

        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * frames, size - 9 - 8 * frames)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        packed, plain = self.sizes[number]
        return self.unpacker.decompress(self.file.read_at(packed, self.starts[number]), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def record_bytes(record_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record with its payload, or a revisit record that names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{_name(record_id)}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:x-page:{_name(refers_to)}>")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


def _name(record_id) -> str:
    return "" if record_id is None else "=" + quote(str(record_id), safe="")


def _id(name: str | None) -> str | None:
    name = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return unquote(name[1:]) if name.startswith("=") else None


def parsed(data: bytes, at: int = 0) -> Iterator[tuple]:
    """Records from ``at`` on, as rows of ``RECORD``. A revisit has no payload."""
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = head + 4
        stop = begin + int(fields["Content-Length"])
        kind = fields["WARC-Type"]
        body = data.index(b"\r\n\r\n", begin, stop) + 4
        url = fields.get("WARC-Target-URI")
        yield (
            _id(fields["WARC-Record-ID"]),
            kind,
            _id(fields.get("WARC-Refers-To")),
            None if url is None else unquote(url),
            fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            data[body:stop] if kind == "response" else None,
        )
        at = stop + 4


def with_revisits(
    pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000
) -> DataFrame:
    """One row per page: record_id, url, payload (binary), digest, refers_to.

    Of pages with equal payloads of at least ``least`` bytes that with the largest id is stored
    whole and the others refer to it. A null payload is empty. Pages that share the largest id are
    all stored whole; a page without an id refers to the largest id, if its group has one. The
    largest id of a payload is found with map-side combining; only payloads that occur twice reach
    the join, where rows of one payload are dealt over ``SALTS`` tasks.
    """
    facts = pages.select(
        F.col(id).alias("record_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    first = (
        facts.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("record_id").alias("largest"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 AND largest IS NOT NULL")
        .select("digest", "largest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    dealt = facts.withColumn("salt", F.pmod(F.xxhash64("record_id", "url"), F.lit(SALTS)).cast("int"))
    older = F.col("record_id").isNull() | (F.col("record_id") < F.col("largest"))
    return dealt.join(first.hint("shuffle_hash"), ["digest", "salt"], "left").select(
        "record_id", "url", "payload", "digest", F.when(older, F.col("largest")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    out_dir: str,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 1000,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 1 << 27,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per page into bundles under ``out_dir``; return the index, columns ``INDEX``.

    ``out_dir`` must be visible to all executors. A task writes bundles under names of its own
    attempt, and the index is committed once: bundles of lost or repeated attempts are in no index
    row. A task holds one frame. Empty input writes no bundle and an empty index. A record over
    ``frame_bytes`` has a frame of its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        files, path = filesystem(out_dir)
        files.create_dir(path, recursive=True)
        for batch in batches:
            for page, address, body, digest, refers in zip(*(c for c in batch.columns), strict=True):
                page, refers = page.as_py(), refers.as_py()
                record = record_bytes(page, address.as_py(), body.as_py(), digest.as_py(), refers, date)
                if bundle is None:
                    bundle = BundleWriter(f"{out_dir}/bundle-{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                frame, offset = bundle.add(record)
                kind = "response" if refers is None else "revisit"
                rows.append((None if page is None else str(page), kind, bundle.uri, frame, offset, len(record)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
                    yield _batch(rows, _INDEX)
                    rows = []
        if bundle is not None:
            bundle.close()
            yield _batch(rows, _INDEX)

    typed = with_revisits(pages, id, url, payload, least)
    index = typed.mapInArrow(write, INDEX)
    path = f"{out_dir}/index"
    index.write.parquet(path)
    return pages.sparkSession.read.schema(INDEX).parquet(path)


def read_archives(index: DataFrame) -> DataFrame:
    """All records of the bundles of an index, columns ``RECORD``; a task holds one frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                bundle = BundleReader(uri)
                for number in range(len(bundle.sizes)):
                    yield _batch(list(parsed(bundle.frame(number))), _RECORD)
                bundle.close()

    bundles = index.groupBy("bundle").agg(F.count(F.lit(1)).alias("records")).select("bundle")
    return bundles.mapInArrow(read, RECORD)


def read_records(index: DataFrame) -> DataFrame:
    """Only the records of the given index rows: one seek and one frame for each frame they lie in."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = number = bundle = data = None
        for batch in batches:
            rows = []
            for name, frame, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != uri:
                    if bundle is not None:
                        bundle.close()
                    uri, number, bundle = name, None, BundleReader(name)
                if frame != number:
                    number, data = frame, bundle.frame(frame)
                rows.append(next(parsed(data, offset)))
            yield _batch(rows, _RECORD)

    ordered = index.select("bundle", "frame", "frame_offset").repartition("bundle", "frame")
    return ordered.sortWithinPartitions("bundle", "frame", "frame_offset").mapInArrow(read, RECORD)


def payload_facts(records: DataFrame) -> DataFrame:
    """Per record: record_id, record_type, refers_to, payload_bytes, payload_digest, both of the full payload.

    Those of a response come from its stored payload. A revisit names its response and the digest of
    its payload, and takes both from the stored payload with that name and digest, since several pages
    may share an id; rows of one response are dealt over ``SALTS`` tasks.
    """
    facts = saved(
        records.select(
            "record_id",
            "record_type",
            "refers_to",
            F.col("digest").alias("named"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.when(F.col("payload").isNotNull(), F.sha1("payload")).alias("payload_digest"),
            F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "payload-facts",
    )
    responses, revisits = facts.filter("record_type = 'response'"), facts.filter("record_type = 'revisit'")
    wanted = revisits.select("refers_to", "named").distinct()
    stored = responses.select(
        F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("named"), "payload_bytes", "payload_digest"
    ).distinct()
    targets = wanted.join(stored, ["refers_to", "named"]).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    resolved = revisits.drop("payload_bytes", "payload_digest").join(targets, ["refers_to", "named", "salt"], "left")
    columns = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return responses.select(*columns).unionByName(resolved.select(*columns))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


_INDEX, _RECORD = _schema(INDEX), _schema(RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def archived(spark: SparkSession, pages: DataFrame, out_dir: str) -> DataFrame:
    """Write the pages, read the archives back and return the facts of every record."""
    return payload_facts(read_archives(write_archives(pages, out_dir)))
