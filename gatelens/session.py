"""Session settings and lineage cutting shared by jobs, tests and the benchmark."""

import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", *, memory: str = "12g", shuffle: int = 8) -> SparkSession:
    """A session for tests and single-machine benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gatelens")
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that every machine of the session sees.

    ``spark.checkpoint.dir`` names it. Where that is unset, a session on one machine uses a folder
    below its warehouse; on a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        folder = f"{warehouse}/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the cluster."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` read back from compressed files in the shared folder: cuts lineage, and readers take
    the columns that they need."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's own files, below the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
