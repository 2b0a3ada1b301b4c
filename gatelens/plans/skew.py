"""Joins and top-n selections that survive one key holding a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SALTS = 16


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    *,
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join many ``rows`` with a ``table`` that has one row per key.

    As it stands a hot key is split at run time, when the shuffle has been measured (adaptive skew
    join). With ``salts`` the rows of every key are spread over that many reducers and the lookup
    row is repeated for each of them, for callers that know of hot keys and go on by the same key.
    Rows then get their salt from their own content (not from a random number), so a retried task
    reproduces it.
    """
    if salts is None:
        return rows.join(table, list(keys), how)
    payload = [c for c in rows.columns if c not in keys] or list(keys)
    # complex columns may hold maps, which xxhash64 refuses: hash the scalar columns only
    scalar = [
        f.name
        for f in rows.schema.fields
        if f.name in payload and f.dataType.typeName() not in ("map", "variant", "struct", "array")
    ] or list(keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*scalar), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; partial aggregation, no window."""
    return _edge_per_key(df, keys, order, F.max_by)


def oldest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order``; partial aggregation, no window."""
    return _edge_per_key(df, keys, order, F.min_by)


def _edge_per_key(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(
        pick(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    Each key is first cut to ``n`` rows per salt, so the last window sees at most
    ``n * salts`` rows of a key however hot it is.
    """
    scalar = [
        f.name
        for f in df.schema.fields
        if f.dataType.typeName() not in ("map", "variant", "struct", "array")
    ]
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    last = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*scalar), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(last))
        .where(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )
