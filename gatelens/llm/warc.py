"""Web archives in seekable Zstandard bundles.

A bundle is a file of independent frames, each with whole WARC records. A skippable frame maps
record ids to frame, offset inside the frame and length; a seek table in the public seekable format
ends the file. One record is read by decompressing its frame alone. Records whose payload another
record holds are revisits of that one.
"""

import base64
import hashlib
import json
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.blobs import read_files, write_files

#: Bytes of records in a frame, and of frames in a bundle, after which the next one begins.
FRAME_BYTES = 512 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3

# Fixed values of the public Zstandard seekable format.
SEEK_FRAME = 0x184D2A5E
SEEK_END = b"\xb1\xea\x92\x8f"
#: A skippable frame of our own: the map from record ids to their places.
INDEX_FRAME = 0x184D2A50

# Fixed values of the public WARC 1.1 format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, response_id``; the last is null for responses.

    Only ids and digests are grouped and shuffled by payload; the payloads go by page.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    light = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    chosen = (
        light.groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("response_id").isNotNull())
        .drop("n")
    )
    revisits = (
        light.join(chosen, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("response_id")))
        .distinct()
        .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "response_id")
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return rows.join(revisits, same, "left").drop("_id", "_digest")


def write_bundles(pages: DataFrame, path: str, *, least_bytes: int = 0, date: str = DATE) -> None:
    """Write a record per row of ``page_id, url, html`` below ``path``.

    A null html is an empty payload and a null url gives no target header. Of records with equal
    payloads of at least ``least_bytes`` bytes the one with the largest page id is the response
    (all rows of that id are) and the others revisit it; a null id comes before all others. An
    empty table gives no file.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _bundles(batches, date):
            yield pa.RecordBatch.from_pydict({"content": pa.array([content], pa.large_binary())})

    rows = planned(pages, least_bytes).mapInArrow(bundle, "content binary")
    write_files(rows, "content", path, SEEK_END)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str
) -> bytes:
    """One WARC record with its closing blank lines; a revisit leaves the payload off."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {SAME_PAYLOAD}"]
    return b"\r\n".join([VERSION, *[line.encode() for line in head], b"", block, b"", b""])


def _bundles(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[bytes]:
    """Contents of bundles without their last four bytes; one bundle is held at a time."""
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    frames: list[bytes] = []
    sizes: list[int] = []
    places: list[tuple[str, int, int, int]] = []
    records: list[bytes] = []
    filled = stored = 0

    def close_frame() -> int:
        frames.append(zstd.compress(b"".join(records)))
        sizes.append(filled)
        records.clear()
        return len(frames[-1])

    def content() -> bytes:
        index = zstd.compress(json.dumps(places).encode())
        frames.append(struct.pack("<2I", INDEX_FRAME, len(index)) + index)
        sizes.append(0)
        seek = b"".join(
            struct.pack("<2I", len(f), n) for f, n in zip(frames, sizes, strict=True)
        ) + struct.pack("<IB", len(frames), 0)
        seek = struct.pack("<2I", SEEK_FRAME, len(seek) + len(SEEK_END)) + seek
        return b"".join([*frames, seek])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
            data = record(page_id, url, payload, digest, refers_to, date)
            places.append((record_id(page_id), len(frames), filled, len(data)))
            records.append(data)
            filled += len(data)
            if filled >= FRAME_BYTES:
                stored += close_frame()
                filled = 0
            if stored >= BUNDLE_BYTES:
                if records:
                    close_frame()
                yield content()
                frames, sizes, places, filled, stored = [], [], [], 0, 0
    if records:
        close_frame()
    if frames:
        yield content()


def frames_of(content: bytes) -> list[tuple[int, int, int]]:
    """Start, stored and full size of every frame of a bundle, from its seek table."""
    if content[-4:] != SEEK_END:
        raise ValueError("not a seekable bundle, or a cut one")
    (n,) = struct.unpack_from("<I", content, len(content) - 9)
    at = len(content) - 9 - 8 * n
    if struct.unpack_from("<I", content, at - 8)[0] != SEEK_FRAME:
        raise ValueError("the seek table of a bundle is damaged")
    out, start = [], 0
    for i in range(n):
        stored, full = struct.unpack_from("<2I", content, at + 8 * i)
        out.append((start, stored, full))
        start += stored
    return out


def places_of(content: bytes) -> dict[str, list[tuple[int, int, int]]]:
    """Frame, offset in it and length of the records of each record id."""
    start, stored, _ = frames_of(content)[-1]
    if struct.unpack_from("<I", content, start)[0] != INDEX_FRAME:
        raise ValueError("the record map of a bundle is missing")
    raw = zstandard.ZstdDecompressor().decompress(content[start + 8 : start + stored])
    out: dict[str, list[tuple[int, int, int]]] = {}
    for name, frame, offset, length in json.loads(raw):
        out.setdefault(name, []).append((frame, offset, length))
    return out


def raw_records(content: bytes, wanted: Sequence[str] | None = None) -> Iterator[bytes]:
    """Records of a bundle; only frames with wanted record ids are decompressed."""
    zstd = zstandard.ZstdDecompressor()
    frames = frames_of(content)
    found = places_of(content)
    by_frame: dict[int, list[tuple[int, int]]] = {}
    for name in found if wanted is None else wanted:
        for frame, offset, length in found.get(name, ()):
            by_frame.setdefault(frame, []).append((offset, length))
    for frame in sorted(by_frame):
        start, stored, _ = frames[frame]
        data = zstd.decompress(content[start : start + stored])
        for offset, length in sorted(by_frame[frame]):
            yield data[offset : offset + length]


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, in lower case, and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    pairs = (line.decode().split(": ", 1) for line in lines[1:])
    fields = {name.lower(): value for name, value in pairs}
    return fields, rest[: int(fields["content-length"])]


def _page(name: str) -> int | None:
    return int(name[10:-1]) if name[10:-1] else None


def read_bundles(
    spark: SparkSession, path: str, wanted: Sequence[int] | None = None, *, payloads: bool = False
) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the archives' records.

    With ``payloads`` the column ``payload`` follows, null for revisits. The digest of a response is
    computed from its payload and must be the stored one; a revisit gives size and digest of the
    payload that it left off.
    """
    names = None if wanted is None else [record_id(i) for i in wanted]
    schema = RECORD + ", payload binary" if payloads else RECORD
    columns = [part.split()[0] for part in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = [summary(data, payloads) for data in raw_records(value.as_py(), names)]
                arrays = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                kinds += [pa.large_binary()] * payloads
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [a.cast(k) for a, k in zip(arrays, kinds, strict=True)], names=columns
                    )

    return read_files(spark, path).select("content").mapInArrow(read, schema)


def summary(data: bytes, payloads: bool) -> tuple:
    """What ``read_bundles`` returns of one record."""
    fields, block = parsed(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {fields['warc-record-id']} is damaged")
    refers_to = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    row = (_page(fields["warc-record-id"]), size, digest, kind, refers_to)
    return (*row, payload if kind == "response" else None) if payloads else row
