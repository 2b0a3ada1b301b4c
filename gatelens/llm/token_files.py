"""Token ids in binary files with a shared dictionary and an offset index.

A file holds documents in ascending id order. Each document is a Zstandard frame of its own, made
with a dictionary trained on id arrays, so that short documents compress well and one document can
be read without its neighbours::

    magic 8 | sha-256 of the dictionary 32 | segment u64 | part u64 | bytes per id u64
    frames, one a document
    index, compressed: id i64 x n | frame end u64 x n | ids u64 x n
    index length u64 | documents u64 | ids u64 | end mark 8

The dictionary lies beside the files as Parquet, named by the same hash.
"""

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gatelens.llm.blobs import read_files, write_files
from gatelens.llm.common import small, starts
from gatelens.llm.token_ids import ids_of, sliced

MAGIC = b"GTIDS001"
END = b"GTIDSEND"
HEAD = struct.Struct("<8s32s3Q")
TAIL = struct.Struct("<3Q8s")
FIRST_FRAME = HEAD.size
#: Documents that a file is meant to hold, and bytes of frames after which a new one is begun.
FILE_DOCS = 2048
FILE_BYTES = 32 << 20
#: Ranges of ids that are told apart, at most, and ids drawn for each; larger ranges make more files.
MOST_RANGES = 65_536
PER_RANGE = 16
#: The dictionary is trained on this many documents at most, up to this many bytes of each.
TRAIN_DOCS = 1024
TRAIN_BYTES = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3


def sample(docs: DataFrame, n: int, id_col: str, text: str, rows: int = TRAIN_DOCS) -> DataFrame:
    """``text`` of about ``rows`` of ``n`` documents, at most, by the hash of their ids; the bound of the training."""
    lowest = min((1 << 63) - 1, (rows << 64) // max(n, 1) - (1 << 63))
    return docs.where((F.xxhash64(id_col) <= lowest) & (F.length(text) > 0)).select(text).limit(rows)


def id_bounds(docs: DataFrame, n: int, id_col: str, rows: int) -> np.ndarray:
    """Ids that cut ``n`` documents into ranges of about ``rows``, from a bounded sample of them."""
    ranges = min(MOST_RANGES, -(-n // rows))
    if ranges < 2:
        return np.zeros(0, np.int64)
    some = docs.select(F.col(id_col).cast("long").alias("id")).sample(fraction=min(1.0, PER_RANGE * ranges / n), seed=1)
    ids = np.sort(some.toPandas()["id"].to_numpy(np.int64))
    return np.unique(ids[np.arange(1, ranges) * len(ids) // ranges]) if len(ids) else ids


def train_dictionary(docs: DataFrame, n: int, tokenizer: str, id_col: str, text: str) -> bytes:
    """A dictionary for id arrays of these documents; empty where there is nothing to learn from."""
    width = id_width(tokenizer)

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            ids = ids_of(tokenizer).of_texts(batch.column(0)).to_pylist()
            short = [narrow(x, width)[:TRAIN_BYTES] for x in ids]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(short, pa.large_binary())})

    rows = sample(docs, n, id_col, text).mapInArrow(serialise, "ids binary").collect()
    samples = sorted(bytes(r.ids) for r in rows if r.ids)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few documents to train on
        return b"".join(samples)[:DICTIONARY_BYTES]


def id_width(tokenizer: str) -> int:
    """Bytes of an id on disk: 2 where every id of the tokenizer fits, else 4."""
    return 2 if ids_of(tokenizer).library.get_vocab_size() < 1 << 16 else 4


def narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def widen(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    end: int = 2,
    id_col: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the ids of all documents below ``path``, ascending by id.

    A null text counts as empty; every document ends with the id ``end``. Repeated ids are written
    each, in the order of their bytes. An empty table gives a dictionary and no file. Documents are
    compressed where they lie; only their frames are shuffled, by ranges of ids. A document without
    an id has no place in that order: a table with one is refused before anything is written.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer)
    if end >= 1 << 8 * width:
        raise ValueError(f"the end id {end} does not fit {width} bytes")
    n, named = docs.agg(F.count("*"), F.count(id_col)).first()
    if n > named:
        raise ValueError(f"{n - named} documents have no {id_col}")
    trained = train_dictionary(docs, n, tokenizer, id_col, text)
    digest = hashlib.sha256(trained).digest()
    frame = spark.createDataFrame([(digest.hex(), trained)], "sha256 string, content binary")
    frame.coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(trained)
    bounds = id_bounds(docs, n, id_col, FILE_DOCS)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ids_of(tokenizer)
        known = dictionary_of(shared.value)
        if known:
            known.precompute_compress(level=LEVEL)
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        for batch in sliced(batches, 1):
            ids = words.of_texts(batch.column(1), end)
            n = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
            segment = np.searchsorted(bounds, batch.column(0).to_numpy(), side="right")
            data = memoryview(narrow(b"".join(ids.to_pylist()), width))
            ends = np.cumsum(n.to_numpy()) * width
            places = zip((ends - n.to_numpy() * width).tolist(), ends.tolist(), strict=True)
            frames = [zstd.compress(data[a:b]) for a, b in places]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment, pa.int64()), batch.column(0), n, pa.array(frames, pa.large_binary())],
                names=["segment", "id", "n", "frame"],
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _files(batches, digest, width):
            yield pa.RecordBatch.from_pydict({"content": pa.array([content], pa.large_binary())})

    files = (
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(text).alias("text"),
        )
        .mapInArrow(compress, "segment long, id long, n long, frame binary")
        .repartition("segment")
        .sortWithinPartitions("segment", "id", "n", "frame")
        .mapInArrow(assemble, "content binary")
    )
    write_files(files, "content", f"{path}/files", END)


def _files(batches: Iterator[pa.RecordBatch], digest: bytes, width: int) -> Iterator[bytes]:
    """Contents without their end mark, from sorted rows; one file is held at a time."""
    segment = part = -1
    ids: list[int] = []
    counts: list[int] = []
    frames: list[bytes] = []
    size = 0

    def content() -> bytes:
        ends = np.cumsum([len(f) for f in frames])
        index = b"".join(
            np.asarray(x, kind).tobytes() for x, kind in ((ids, "<i8"), (ends, "<u8"), (counts, "<u8"))
        )
        index = zstandard.ZstdCompressor(level=LEVEL).compress(index)
        head = HEAD.pack(MAGIC, digest, segment, part, width)
        tail = TAIL.pack(len(index), len(ids), sum(counts), END)[: -len(END)]
        return b"".join([head, *frames, index, tail])

    for batch in batches:
        for where, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if where != segment or size > FILE_BYTES:
                if ids:
                    yield content()
                part = part + 1 if where == segment else 0
                segment, size = where, 0
                ids, counts, frames = [], [], []
            ids.append(doc)
            counts.append(n)
            frames.append(frame)
            size += len(frame)
    if ids:
        yield content()


def index_of(content: bytes) -> tuple[int, int, int, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Segment, part, width, hash, and by document: id, frame ends (from byte 0) and ids."""
    magic, digest, segment, part, width = HEAD.unpack_from(content)
    length, n, total, end = TAIL.unpack_from(content, len(content) - TAIL.size)
    if magic != MAGIC or end != END:
        raise ValueError("not a token file, or a cut one")
    at = len(content) - TAIL.size - length
    raw = zstandard.ZstdDecompressor().decompress(content[at : at + length])
    ids = np.frombuffer(raw, "<i8", n)
    ends = np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64) + HEAD.size
    counts = np.frombuffer(raw, "<u8", n, 16 * n).astype(np.int64)
    if int(counts.sum()) != total:
        raise ValueError("the index of a token file is damaged")
    return segment, part, width, digest, ids, ends, counts


def place_of(content: bytes | pa.Buffer) -> tuple[int, int, int]:
    """Segment, part and number of ids of a file."""
    segment, part = HEAD.unpack_from(content)[2:4]
    return segment, part, TAIL.unpack_from(content, len(content) - TAIL.size)[2]


def stored_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().content)


def read_token_files(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents, or of the ``wanted`` ids only.

    ``ids`` are little-endian unsigned 32-bit integers, ``start`` the ids of all documents before.
    Only frames of wanted documents are decompressed.
    """
    trained = stored_dictionary(spark, path)
    shared = spark.sparkContext.broadcast(trained)
    digest = hashlib.sha256(trained).digest()
    only = None if wanted is None else np.unique(np.asarray(wanted, np.int64))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                content = value.as_buffer()
                segment, part, total = place_of(content)
                yield pa.RecordBatch.from_pydict(
                    {"segment": [segment], "part": [part], "total": [total]}
                )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor(dict_data=dictionary_of(shared.value))
        for batch in batches:
            for value in batch.column(0):
                content = value.as_buffer()
                segment, part, width, made_with, ids, ends, counts = index_of(content.to_pybytes())
                if made_with != digest:
                    raise ValueError("a token file was made with another dictionary")
                begins = np.concatenate([[FIRST_FRAME], ends[:-1]])
                rows = np.arange(len(ids))
                rows = rows if only is None else rows[np.isin(ids, only)]
                arrays = [
                    widen(zstd.decompress(content[int(begins[i]) : int(ends[i])]), width)
                    for i in rows
                ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": np.full(len(rows), segment),
                        "part": np.full(len(rows), part),
                        "doc_id": ids[rows],
                        "local": (np.cumsum(counts) - counts)[rows],
                        "n_tokens": counts[rows],
                        "ids": pa.array(arrays, pa.large_binary()),
                    }
                )

    files = read_files(spark, f"{path}/files").select("content")
    sums = files.mapInArrow(totals, "segment long, part long, total long")
    # parts of a segment are few; segments are the order that is added up
    inside = W.partitionBy("segment").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    per_part = sums.withColumn("inner", F.coalesce(F.sum("total").over(inside), F.lit(0)))
    bases = starts(
        sums.groupBy("segment").agg(F.sum("total").alias("total")), "segment", "total", "outer"
    )
    bases = per_part.join(bases.select("segment", "outer"), "segment").select(
        "segment", "part", (F.col("inner") + F.col("outer")).alias("base")
    )
    kind = "segment long, part long, doc_id long, local long, n_tokens long, ids binary"
    found = files.mapInArrow(documents, kind)
    # one row of three numbers a file: broadcast while that is few, so that no ids are shuffled
    bases = small(bases, read_files(spark, f"{path}/files").select("path").count())
    return found.join(bases, ["segment", "part"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids"
    )
