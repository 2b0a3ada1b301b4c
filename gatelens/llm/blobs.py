"""Whole binary files through Spark's own writers and readers.

A row is a file: the text writer puts the bytes of a value down as they are and its line separator
behind them, so that a file's own end mark serves as the separator. Files thus get Spark's commit
protocol (a lost or repeated task leaves no half files) and work on any store that Spark writes to.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(df: DataFrame, content: str, path: str, end: bytes) -> None:
    """Write the binary column ``content``, which leaves off the last bytes ``end`` of each file."""
    (
        df.select(F.col(content).cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", end.decode("latin-1"))
        .option("compression", "none")
        .text(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of each file that is not empty."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("length") > 0).select("path", "content")
