"""Helpers that several operators of this subpackage share."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gatelens.session import scratch

#: Neighbouring positions that one window adds up; two such steps cover BLOCK * BLOCK per row left.
BLOCK = 4096
#: Rows of two numbers that may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Shuffle files of a finished write are removed at once, so rounds do not pile them up.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` after a round trip through a table in the shared folder; cuts lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def starts(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, in ascending ``order``.

    ``order`` is a distinct integer from 0. Sums of blocks are added up first, so the one window
    without partitions gets a row for each block only.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        blocks.groupBy("_block")
        .agg(F.sum(value).alias("_sum"))
        .select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        blocks.join(totals, "_block")
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_block", "_base")
    )


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast where its known number of rows is small enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def id_blocks(df: DataFrame, id_col: str, rows: int) -> tuple[int, int]:
    """Least id and width of id ranges that hold about ``rows`` rows each, were ids spread evenly."""
    low, high, n = df.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    if not n:
        return 0, 1
    return low, max(1, -(-(high - low + 1) // max(1, -(-n // rows))))


def clear_of(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``docs`` without columns of the names that an operator adds."""
    return docs.drop(*[c for c in docs.columns if c.lower() in {x.lower() for x in columns}])


#: Counts in one row of a partition's report; partitions are added up in this many groups first.
COUNT_BLOCK = 4096
GROUPS = 64


def report(key: str, part: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``key, block, part, counts`` of one vector of counts."""
    for block, at in enumerate(range(0, len(counts), COUNT_BLOCK)):
        some = counts[at : at + COUNT_BLOCK].astype("<i8")
        if some.any():
            yield pa.RecordBatch.from_pydict(
                {"key": [key], "block": [block], "part": [part], "counts": [some.tobytes()]}
            )


REPORT = "key string, block long, part long, counts binary"


def summed(reports: DataFrame, size: int) -> dict[str, np.ndarray]:
    """The summed vector of each key; few keys, vectors of ``size`` counts.

    The vectors of all partitions are added in two steps, so no task holds many of them.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["counts"].iloc[0], "<i8").copy()
        for other in pdf["counts"].iloc[1:]:
            total += np.frombuffer(other, "<i8")
        return pdf.head(1).assign(counts=[total.tobytes()])

    some = reports.withColumn("part", F.col("part") % GROUPS)
    some = some.groupBy("key", "block", "part").applyInPandas(add, REPORT)
    rows = some.groupBy("key", "block").applyInPandas(add, REPORT).collect()
    out: dict[str, np.ndarray] = {}
    for row in rows:
        vector = out.setdefault(row.key, np.zeros(size, np.int64))
        found = np.frombuffer(row.counts, "<i8")
        vector[row.block * COUNT_BLOCK : row.block * COUNT_BLOCK + len(found)] = found
    return out
