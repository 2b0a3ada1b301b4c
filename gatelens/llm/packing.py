"""Packing: all documents end to end in one stream of ids, cut into sequences of one size.

Two passes. The first encodes the texts where they lie and writes their ids with the offset of each
document inside its partition. Sums over the totals of the partitions then give every document its
place in the stream, and the second pass cuts there; a document over a cut gets a piece on each side.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import small, starts, written
from gatelens.llm.token_ids import ids_of, sliced

_ENCODED = pa.schema(
    [
        ("id", pa.int64()),
        ("part", pa.int64()),
        ("local", pa.int64()),
        ("n", pa.int64()),
        ("ids", pa.large_binary()),
    ]
)


def encoded(docs: DataFrame, tokenizer: str, end: int, id_col: str, text: str) -> DataFrame:
    """``id, part, local, n, ids``: ids of each row and the ids before it in its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ids_of(tokenizer)
        part = TaskContext.get().partitionId()
        done = 0
        for batch in sliced(batches, 1):
            ids = words.of_texts(batch.column(1), end)
            n = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            local = done + np.cumsum(n) - n
            done += int(n.sum())
            columns = [batch.column(0), np.full(len(n), part), local, n, ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_ENCODED
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "id long, part long, local long, n long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    end: int = 1,
    length: int = 2048,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids.

    Returns ``id_col, start, length, ids, doc_tokens, sequence_id, offset``: the ids of a piece as
    little-endian unsigned 32-bit integers, the ids of its document before it, and its place in
    its sequence. Every document ends with the id ``end``, so a null or empty text is one piece of
    one id. Documents follow each other in the order of the table's partitions; repeated rows are
    packed each, other columns are left aside, and an empty table gives no pieces. All sequences
    but the last are full.
    """
    rows = written(encoded(docs, tokenizer, end, id_col, text), "packing")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    bases = small(starts(totals, "part", "total", "base").select("part", "base"), totals.count())
    begin = F.col("base") + F.col("local")
    last = F.floor((begin + F.col("n") - 1) / length)
    placed = (
        rows.join(bases, "part")
        .withColumn("begin", begin)
        .withColumn("sequence_id", F.explode(F.sequence(F.floor(begin / length), last)))
    )
    edge = F.col("sequence_id") * length
    start = F.greatest(F.lit(0), edge - F.col("begin"))
    size = F.least(F.col("n"), edge + length - F.col("begin")) - start
    cut = placed.withColumns({"start": start, "length": size})
    piece = F.substring(
        F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")
    )
    return cut.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        piece.alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("begin") + F.col("start") - edge).alias("offset"),
    )
