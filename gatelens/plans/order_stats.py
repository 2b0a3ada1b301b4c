"""Exact order statistics per group without sorting or collecting a whole group."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gatelens.plans.skew import lookup

ACCURACY = 10_000
#: Places in which the distinct values of a group meet its brackets.
SALTS = 128
#: Half the width of a bracket, as a share of the group.
MARGIN = 5.0 / ACCURACY
#: A rank lies at most this many rows from its quantile; see the rank functions below.
OFF = 2
#: Beyond so many rows a bracket holds its rank: the sketch is off by n / ACCURACY at most, and the
#: margin of n * MARGIN is wider than that and OFF together. Groups up to here are taken whole.
WHOLE = int(OFF / (MARGIN - 1.0 / ACCURACY)) + 1


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, tuple[float, Callable[[Column], Column]]],
    *,
    small: int = WHOLE,
    salts: int | None = SALTS,
) -> DataFrame:
    """Exact values at 1-based ranks of each group: ``keys``, ``n`` and one column per rank.

    ``ranks`` maps an output name to (quantile, function of the group size giving the rank).
    A quantile sketch (bounded size, partially aggregated) brackets each rank; only rows inside
    a bracket, counted per distinct value, are ordered. Groups of up to ``small`` rows are
    bracketed by their own minimum and maximum. Every bracket is checked against the counts below
    it: should one miss its rank, the query fails rather than return a neighbour.

    The distinct values of a group meet its bracket in ``salts`` places, so that no task gets them all;
    there they are folded to what lies inside the brackets and one row for the rest. Callers with
    very many groups and none that is large pass None.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    brackets = sorted({q for q, _ in ranks.values()})
    points = [p for q in brackets for p in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", points, ACCURACY).alias("_q"),
    )
    whole = F.col("n") <= small
    bounds = []
    for i, _ in enumerate(brackets):
        bounds.append(F.when(whole, F.col("_min")).otherwise(F.col("_q")[2 * i]).alias(f"_lo{i}"))
        bounds.append(
            F.when(whole, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias(f"_hi{i}")
        )
    limits = sketch.select(*keys, "n", *bounds)
    weighted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_w"))
    inside = F.lit(False)
    for i, _ in enumerate(brackets):
        inside = inside | F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    # values inside a bracket stay; all others of a group fold into one row without a value
    counted = (
        lookup(weighted, limits, keys, how="inner", salts=salts)
        .withColumn("_c", F.when(inside, F.col("_v")))
        .groupBy(*keys, "_c")
        .agg(
            F.sum("_w").alias("_m"),
            F.first("n").alias("n"),
            *[F.first(f"_lo{i}").alias(f"_lo{i}") for i, _ in enumerate(brackets)],
            *[
                F.sum(F.when(F.col("_v") < F.col(f"_lo{i}"), F.col("_w")).otherwise(0)).alias(
                    f"_below{i}"
                )
                for i, _ in enumerate(brackets)
            ],
        )
    )
    upto = (
        W.partitionBy(*keys)
        .orderBy(F.col("_c").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    # rows up to a value of a bracket: kept values so far and the folded ones below the bracket
    ranked = counted.withColumns(
        {
            f"_cum{i}": F.sum(
                F.when(F.col("_c").isNull(), F.col(f"_below{i}")).otherwise(F.col("_m"))
            ).over(upto)
            for i, _ in enumerate(brackets)
        }
    )
    picked = []
    kind = df.schema[value].dataType
    for name, (q, rank) in ranks.items():
        i = brackets.index(q)
        hit = (
            F.col("_c").isNotNull()
            & (F.col("_c") >= F.col(f"_lo{i}"))
            & (F.col(f"_cum{i}") >= rank(F.col("n")))
        )
        found = F.min(F.when(hit, F.col("_c")))
        holds = (F.sum(f"_below{i}") < rank(F.first("n"))) & found.isNotNull()
        missed = F.raise_error(F.lit(f"a bracket misses the rank of {name}"))
        picked.append(F.when(holds, found).otherwise(missed.cast(kind)).alias(name))
    return ranked.groupBy(*keys).agg(F.first("n").alias("n"), *picked)


def lower_middle(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2) + 1


def ceil_rank(percent: int) -> Callable[[Column], Column]:
    """Nearest rank: ``max(1, ceil(percent/100 * n))``."""
    return lambda n: F.greatest(F.lit(1), F.ceil(F.lit(percent) / 100 * n))


def half_even_rank(q: float) -> Callable[[Column], Column]:
    """``round(q*n + 0.5)`` with ties to even, kept inside 1..n."""
    return lambda n: F.least(n, F.greatest(F.lit(1), F.bround(F.lit(q) * n + 0.5, 0).cast("long")))


def half_even_index(q: float) -> Callable[[Column], Column]:
    """Rank of the zero-based index ``round(q*(n-1))`` with ties to even."""
    return lambda n: F.least(n, F.bround(F.lit(q) * (n - 1), 0).cast("long") + 1)


MEDIAN = {"_m1": (0.5, lower_middle), "_m2": (0.5, upper_middle)}


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``keys``, ``n`` and the interpolated median (mean of the two middle values)."""
    stats = order_statistics(df, keys, value, MEDIAN)
    middle = (F.col("_m1").cast("double") + F.col("_m2").cast("double")) / 2
    return stats.select(*keys, "n", middle.alias(out))
