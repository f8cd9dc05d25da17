"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding whole WARC records, and a seek table
in a skippable frame at the end (the public seekable format): compressed and plain size of every
frame, their number, and a magic footer. Any Zstandard reader reads the bundle as one stream; with
the footer a reader fetches only the frame that it needs. The index, kept as a table beside the
bundles, maps each record identifier to bundle, frame, and place in the plain bytes of the frame.

Payloads that repeat are stored once: the record with the smallest identifier is a response, the
others are revisits that refer to it. The smallest identifier by payload is a grouped minimum
(combined beside the scan), and it is joined back on the payload's SHA-256, a plain join that is
split where a digest is hot; the texts are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from terrastat.sources import stage as write_and_reread

from . import files
from .common import col, join_split

#: Plain bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Fixed values of the public seekable Zstandard format: the skippable frame's magic number, the footer's.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

DATE = "1970-01-01T00:00:00Z"
#: The record of a page without identifier; those of the others begin with the second.
NO_PAGE = "<urn:no-page>"
PAGE = "urn:page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def urn_of(page_id) -> str:
    """The record's name in angle brackets; whatever a URN may not have is percent-encoded."""
    return NO_PAGE if page_id is None else f"<{PAGE}{quote(str(page_id), safe='')}>"


def record_of(page_id, uri: str | None, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps digest and length of the full payload, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    named = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", urn_of(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(uri) if uri else "urn:unknown"),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if is_revisit:
        named += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", urn_of(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in named) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one record."""

    def headers(text: bytes) -> dict[str, str]:
        lines = text.decode().split("\r\n")[1:]
        return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}

    head, _, rest = record.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, headers(http), body


class BundleWriter:
    """Writes records into frames of one bundle, and the seek table at its end."""

    def __init__(self, location: str, part: int, frame_bytes: int):
        self.name, self.frame_bytes = files.new_name(part, "warc.zst"), frame_bytes
        self.file = files.create(location, self.name)
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.open = bytearray()
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's plain bytes) of the record."""
        place = len(self.frames), len(self.open)
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self._close_frame()
        return place

    def _close_frame(self) -> None:
        if self.open:
            packed = self.compressor.compress(bytes(self.open))
            self.file.write(packed)
            self.frames.append((len(packed), len(self.open)))
            self.size += len(packed)
            self.open.clear()

    def close(self) -> None:
        self._close_frame()
        entries = b"".join(struct.pack("<II", *frame) for frame in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.file.close()


class BundleReader:
    """Random access to the frames of a bundle, by the seek table at its end."""

    def __init__(self, location: str):
        self.file = files.open_mapped(location)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{location} has no seek table")
        self.sizes, self.begins = [], [0]
        for packed, plain in struct.iter_unpack("<II", self.file.read_at(8 * count, end - 9 - 8 * count)):
            self.sizes.append((packed, plain))
            self.begins.append(self.begins[-1] + packed)
        self.at, self.plain = None, b""

    def frame(self, n: int) -> bytes:
        """The plain bytes of a frame; the last one is kept."""
        if self.at != n:
            packed, plain = self.sizes[n]
            self.plain = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.begins[n]), max_output_size=plain)
            self.at = n
        return self.plain


def write_bundles(
    df: DataFrame,
    location: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write a record for each row of ``df``; returns the index, stored beside the bundles as well.

    The index has a row for each record: page_id, bundle, frame, offset, length. Identifiers are
    whole numbers or texts of any characters, other types are refused. Payloads are the UTF-8 text
    (NULL: empty), and equal if length and SHA-256 are. Of records with equal payloads of at least ``least_bytes`` bytes, the
    one with the smallest identifier is a response and the others revisit it; every row that repeats
    that identifier and payload is a response. A NULL identifier comes after all others and, if all
    are NULL, every record is a response. NULL and odd URIs are written as one line. Other columns
    are ignored.
    """
    id_type = df.select(col(id_col)).schema[0].dataType
    if not isinstance(id_type, (T.IntegralType, T.StringType)):
        raise TypeError(f"{id_col}: an identifier is a whole number or a text, not {id_type.simpleString()}")
    rows = df.select(
        col(id_col).alias("page_id"),
        col(uri_col).cast("string").alias("uri"),
        F.coalesce(col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    owners = (
        rows.filter(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes")
        .agg(F.min("page_id").alias("owner"))
    )
    joined = join_split(rows, owners, ["digest", "bytes"], "left").select("page_id", "uri", "payload", "owner")
    data = f"{location}/bundles"
    schema = T.StructType([T.StructField("page_id", id_type), *T.StructType.fromDDL("bundle string, frame int, offset bigint, length bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            places = []
            for page_id, uri, payload, owner in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "payload", "owner"))):
                writer = writer or BundleWriter(data, part, frame_bytes)
                record = record_of(page_id, uri, payload, owner, owner is not None and page_id != owner)
                places.append((writer.name, *writer.add(record), len(record)))
                if writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            if places:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), *(pa.array(c, kind) for c, kind in zip(zip(*places), (pa.string(), pa.int32(), pa.int64(), pa.int64())))],
                    schema.names,
                )
        if writer:
            writer.close()

    return write_and_reread(joined.mapInArrow(run, schema), f"{location}/index")


def read_bundles(index: DataFrame, location: str) -> DataFrame:
    """What the records of the index say, read from the bundles by their frames.

    page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload (NULL in revisits).
    payload_bytes and payload_digest are those of the full payload; for a response they are taken
    from the bytes read, and a digest that its header doesn't confirm is an error. The index may be
    filtered first: only the frames of its rows are read.
    """
    data = f"{location}/bundles"
    id_type = index.schema["page_id"].dataType
    schema = T.StructType(
        [
            T.StructField("page_id", id_type),
            *T.StructType.fromDDL("payload_bytes bigint, payload_digest string, record_type string"),
            T.StructField("refers_to", id_type),
            *T.StructType.fromDDL("uri string, payload binary"),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bundle = None, None
        for batch in batches:
            kind = batch.schema.field("page_id").type
            is_text = pa.types.is_string(kind) or pa.types.is_large_string(kind)
            found, size = [], 0
            for wanted, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if wanted != name:
                    name, bundle = wanted, BundleReader(f"{data}/{wanted}")
                warc, http, body = parse_record(bundle.frame(frame)[offset : offset + length])
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                response = warc["warc-type"] == "response"
                if response and digest != digest_of(body):
                    raise ValueError(f"{wanted}, frame {frame}: the payload of {warc['warc-record-id']} is damaged")
                found.append(
                    (
                        _identifier(warc["warc-record-id"], is_text),
                        len(body) if response else int(http["content-length"]),
                        digest,
                        warc["warc-type"],
                        None if response else _identifier(warc["warc-refers-to"], is_text),
                        warc["warc-target-uri"],
                        body if response else None,
                    )
                )
                size += length
                if size >= FRAME_BYTES * 4:
                    yield _batch(found, kind, schema)
                    found, size = [], 0
            if found:
                yield _batch(found, kind, schema)

    return index.mapInArrow(run, schema)


def _identifier(urn: str, is_text: bool):
    if urn == NO_PAGE:
        return None
    value = unquote(urn.removeprefix(f"<{PAGE}").removesuffix(">"))
    return value if is_text else int(value)


def _batch(found: list[tuple], kind: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], schema.names)
