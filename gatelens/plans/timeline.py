"""Ordered computations per key, cut into time buckets so that a hot key is never one task.

Every function here works in three steps: summarise each (key, bucket) with a partially
aggregated group-by, carry the summaries forward over the buckets (a bounded number of rows
per key), and finish inside each bucket. The widest sort group is one key within one bucket.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FINE_SECONDS = 60
COARSE_SECONDS = 86_400


def bucket_of(ts: str | Column, seconds: int) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(column.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    value: Column,
    out: str,
    *,
    fine: int = FINE_SECONDS,
    coarse: int = COARSE_SECONDS,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows of the key that come before this row.

    The order is (``ts``, ``ties``). Sums start at zero, never NULL.
    """
    return running_totals(df, keys, ts, ties, {out: value}, fine=fine, coarse=coarse)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    values: Mapping[str, Column],
    *,
    fine: int = FINE_SECONDS,
    coarse: int = COARSE_SECONDS,
) -> DataFrame:
    """``running_total`` of several values by name; the rows are shuffled once for all of them."""
    rows = df.withColumns(
        {f"_v{i}": F.coalesce(value, F.lit(0)).cast("long") for i, value in enumerate(values.values())}
    )
    rows = rows.withColumn("_fine", bucket_of(ts, fine)).withColumn("_coarse", bucket_of(ts, coarse))
    places = range(len(values))

    def before(name: str, parts: Sequence[str], *order: str) -> Column:
        earlier = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(earlier), F.lit(0))

    fine_totals = rows.groupBy(*keys, "_coarse", "_fine").agg(
        *[F.sum(f"_v{i}").alias(f"_s{i}") for i in places]
    )
    coarse_totals = fine_totals.groupBy(*keys, "_coarse").agg(
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in places]
    )
    coarse_carry = coarse_totals.select(
        *keys, "_coarse", *[before(f"_s{i}", keys, "_coarse").alias(f"_c{i}") for i in places]
    )
    fine_carry = fine_totals.select(
        *keys,
        "_coarse",
        "_fine",
        *[before(f"_s{i}", [*keys, "_coarse"], "_fine").alias(f"_d{i}") for i in places],
    )
    carry = fine_carry.join(coarse_carry, [*keys, "_coarse"]).select(
        *keys, "_fine", *[(F.col(f"_c{i}") + F.col(f"_d{i}")).alias(f"_carry{i}") for i in places]
    )
    inside = {f"_in{i}": before(f"_v{i}", [*keys, "_fine"], ts, *ties) for i in places}
    return (
        rows.withColumns(inside)
        .join(carry, [*keys, "_fine"])
        .withColumns({out: F.col(f"_in{i}") + F.col(f"_carry{i}") for i, out in enumerate(values)})
        .select(*df.columns, *values)
    )


def as_of(
    rows: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    ts: str,
    history_ts: str,
    payload: Sequence[str],
    *,
    ties: Sequence[str] = (),
    inclusive: bool = True,
    fine: int = 3600,
) -> DataFrame:
    """Left as-of join: each row gets ``payload`` of the newest history row up to its ``ts``.

    ``inclusive`` decides whether a history row with the very same timestamp counts. Rows with
    no earlier history get NULLs. Among equal history timestamps the greatest ``ties`` wins.
    """
    stamp = F.struct(F.col(history_ts), *[F.col(c) for c in ties])
    packed = history.select(
        *keys,
        F.col(history_ts).alias("_ts"),
        F.struct(*payload).alias("_p"),
        stamp.alias("_o"),
        bucket_of(history_ts, fine).alias("_b"),
    )
    base = rows.withColumn("_b", bucket_of(ts, fine))
    # 1. newest history row of each bucket, carried to the later buckets of the key
    newest = packed.groupBy(*keys, "_b").agg(F.max_by("_p", "_o").alias("_last"))
    wanted = base.select(*keys, "_b").distinct()
    carried = (
        wanted.join(newest, [*keys, "_b"], "full_outer")
        .withColumn(
            "_carry",
            F.last("_last", ignorenulls=True).over(
                W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .select(*keys, "_b", "_carry")
    )
    # 2. newest history row inside the bucket of the row
    side = F.lit(1 if inclusive else -1)
    left = base.select(
        *keys,
        "_b",
        F.col(ts).alias("_t"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(packed.schema["_o"].dataType).alias("_o"),
        F.lit(None).cast(packed.schema["_p"].dataType).alias("_p"),
        F.struct(*rows.columns).alias("_row"),
    )
    right = packed.select(
        *keys,
        "_b",
        F.col("_ts").alias("_t"),
        (-side).alias("_side"),
        "_o",
        "_p",
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
    )
    inside = (
        W.partitionBy(*keys, "_b")
        .orderBy("_t", "_side", "_o")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    merged = (
        left.unionByName(right)
        .withColumn("_in", F.last("_p", ignorenulls=True).over(inside))
        .where(F.col("_side") == 0)
        .select(*keys, "_b", "_row", "_in")
    )
    return (
        merged.join(carried, [*keys, "_b"], "left")
        .withColumn("_hit", F.coalesce("_in", "_carry"))
        .select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in payload])
    )


def stab_count(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str,
    end: str,
    out: str,
    *,
    closed_end: bool = False,
    fine: int = FINE_SECONDS,
) -> DataFrame:
    """Add ``out`` = number of intervals of the key that contain the point.

    Intervals open at ``start`` (inclusive) and close at ``end`` (exclusive, or inclusive with
    ``closed_end``). Counting opened minus closed ends needs no point x interval pairs.
    """
    opened = intervals.where(F.col(start) <= F.col(end)).select(
        *keys, F.col(start).alias("_t"), F.lit(0).alias("_o"), F.lit(1).alias("_d")
    )
    closed = intervals.where(F.col(start) <= F.col(end)).select(
        *keys,
        F.col(end).alias("_t"),
        F.lit(2 if closed_end else 0).alias("_o"),
        F.lit(-1).alias("_d"),
    )
    empty = F.lit(None).cast(
        points.select(F.struct(*points.columns).alias("r")).schema["r"].dataType
    )
    marks = opened.unionByName(closed).withColumn("_row", empty)
    probes = points.select(
        *keys,
        F.col(ts).alias("_t"),
        F.lit(1).alias("_o"),
        F.lit(0).alias("_d"),
        F.struct(*points.columns).alias("_row"),
    )
    # summing per instant first keeps the marks of one instant from depending on each other
    totals = running_total(
        marks.unionByName(probes), keys, "_t", ["_o"], F.col("_d"), out, fine=fine
    )
    return totals.where(F.col("_row").isNotNull()).select("_row.*", out)


#: Positions of a second on the line of dyadic nodes, and of the line; it starts at FIRST seconds.
_SECOND_BITS, _LINE_BITS = 20, 59
_FIRST = -(1 << 38)


def _position(ts: Column) -> Column:
    """Place of a timestamp on a line where whole seconds fall on multiples of a power of two."""
    micros = F.unix_micros(ts.cast("timestamp"))
    second = F.floor(micros / F.lit(1_000_000)).cast("long")
    return (second - F.lit(_FIRST)) * (1 << _SECOND_BITS) + F.pmod(micros, F.lit(1_000_000))


def stab_min(
    points: DataFrame,
    intervals: DataFrame,
    ids: Sequence[str],
    keys: Sequence[str],
    ts: str,
    start: str,
    end: str,
    value: str,
    out: str,
    *,
    few: int = 64,
) -> DataFrame:
    """``ids`` and ``out``: the least ``value`` among the intervals of the key that contain the point.

    ``ids`` tell points apart; a point in no interval has NULL. Intervals open at ``start`` (NULL: always
    open) and close before ``end`` (NULL: never). Those of a key with ``few`` at most are one list, and a
    point reads the list of its key. All others are cut into dyadic nodes, two a level at most;
    a node keeps its least value, and a point asks the one node of each level that it lies in. So there
    are no pairs of points and intervals, no order to keep inside a key, and only points of keys with
    many intervals are repeated.
    """
    lo = F.coalesce(_position(F.col(start)), F.lit(0).cast("long"))
    hi = F.coalesce(_position(F.col(end)), F.lit(1 << _LINE_BITS).cast("long"))
    ends = intervals.select(*keys, lo.alias("_lo"), hi.alias("_hi"), F.col(value).alias("_v"))

    def nodes_of(level: Column) -> Column:
        # the whole nodes of a level; the odd ones at either edge belong to no larger node inside
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        inside = (F.pmod(F.col("_lo"), size) > 0).cast("long")
        first = F.call_function("shiftright", F.col("_lo"), level) + inside
        last = F.call_function("shiftright", F.col("_hi"), level)
        left = F.when((first < last) & (first % 2 == 1), first)
        right = F.when((first < last) & (last % 2 == 1), last - 1)
        return F.transform(
            F.array_compact(F.array(left, right)), lambda n: F.struct(level.alias("_level"), n.alias("_node"))
        )

    levels = F.transform(F.sequence(F.lit(0), F.lit(_LINE_BITS)), nodes_of)
    ends = ends.where("_lo < _hi")
    # counted first, so that no list grows with its key
    sizes = ends.groupBy(*keys).agg(F.count("*").alias("_n"))
    small = F.struct("_lo", "_hi", "_v")
    lists = (
        ends.join(sizes.where(F.col("_n") <= few).select(*keys), list(keys))
        .groupBy(*keys)
        .agg(F.collect_list(small).alias("_list"))
    )
    crowded = sizes.where(F.col("_n") > few).select(*keys)
    cut = (
        ends.join(crowded, list(keys))
        .select(*keys, "_v", F.explode(F.flatten(levels)).alias("_n"))
        .select(*keys, "_v", "_n.*")
    )
    least = cut.groupBy(*keys, "_level", "_node").agg(F.min("_v").alias("_v"))
    # levels that any interval has: sixty at most
    used = sorted(r[0] for r in least.select("_level").distinct().collect())
    place = _position(F.col(ts)).alias("_p")
    asked = points.select(*ids, *[k for k in keys if k not in ids], place)
    inside = F.filter("_list", lambda x: (x["_lo"] <= F.col("_p")) & (F.col("_p") < x["_hi"]))
    hit = asked.join(lists, list(keys), "left").select(
        *ids, F.array_min(F.transform(inside, lambda x: x["_v"])).alias("_v")
    )
    if used:
        levels = F.explode(F.array(*[F.lit(x) for x in used]).cast("array<int>")).alias("_level")
        probes = asked.join(crowded, list(keys), "left_semi")
        probes = probes.select("*", levels).withColumn("_node", F.expr("shiftright(_p, _level)"))
        hit = hit.unionByName(probes.join(least, [*keys, "_level", "_node"]).select(*ids, "_v"))
    # an id that is NULL is told apart from none, so it meets nothing
    whole = F.lit(True)
    for name in ids:
        whole = whole & F.col(name).isNotNull()
    if used:
        least_of = hit.where(whole).groupBy(*ids).agg(F.min("_v").alias(out))
        return asked.select(*ids).join(least_of, list(ids), "left")
    over = F.min("_v").over(W.partitionBy(*ids))
    return hit.select(*ids, F.when(whole, over).alias(out))
