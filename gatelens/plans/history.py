"""Medians of the rows before each moment, for many moments and keys of any size.

The rows of a key stand in order of time, so what is known at a moment is a prefix of them. Keys of
ordinary size share tasks, where a wavelet matrix answers all prefixes of all of them at once. A key
too large for that is cut two ways: into blocks by time and into cells by value. How many rows of a
prefix lie below a value is then a number stored for its block, plus rows of the block itself, plus
rows of one cell; a search over values asks for many such numbers in each of a few rounds.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.session import durable

#: Rows of one key that one task takes, rows that a task takes on average, and rows of a block.
LARGE = 1 << 20
TASK_ROWS = 1 << 15
BLOCK = 1 << 16
#: Cells by value of a large key, and values that a round of the search tries.
CELLS = 256
TRIES = 15


class Ranks:
    """Counts and order statistics of any range of a sequence of whole numbers."""

    def __init__(self, values: np.ndarray) -> None:
        self.known, codes = np.unique(values, return_inverse=True)
        bits = max(1, int(max(len(self.known) - 1, 0)).bit_length())
        self.zeros = []
        for bit in reversed(range(bits)):
            one = (codes >> bit & 1).astype(bool)
            self.zeros.append((bit, np.concatenate([[0], np.cumsum(~one)]).astype(np.int32)))
            codes = np.concatenate([codes[~one], codes[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the positions ``lo`` to ``hi`` hold less than ``value``."""
        code = np.searchsorted(self.known, value)
        every = code >= len(self.known)
        out = np.where(every, hi - lo, 0)
        for bit, zeros in self.zeros:
            left, right = zeros[lo], zeros[hi]
            up = (code >> bit & 1).astype(bool)
            out += np.where(up & ~every, right - left, 0)
            lo = np.where(up, zeros[-1] + lo - left, left)
            hi = np.where(up, zeros[-1] + hi - right, right)
        return out

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k``, from 0, in the positions ``lo`` to ``hi``."""
        code = np.zeros(len(k), np.int64)
        for bit, zeros in self.zeros:
            left, right = zeros[lo], zeros[hi]
            up = k >= right - left
            k = np.where(up, k - (right - left), k)
            code |= up.astype(np.int64) << bit
            lo = np.where(up, zeros[-1] + lo - left, left)
            hi = np.where(up, zeros[-1] + hi - right, right)
        return self.known[code]


def _spread(ranks: Ranks, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the median and four times the median absolute deviation of ``n`` rows from ``lo`` on."""
    hi = lo + n
    middle = ranks.kth(lo, hi, (n - 1) // 2) + ranks.kth(lo, hi, n // 2)
    total = np.zeros(len(n), np.int64)
    for need in ((n - 1) // 2 + 1, n // 2 + 1):
        # the least doubled deviation d that so many rows keep to
        low = np.zeros(len(n), np.int64)
        high = np.maximum(2 * ranks.known[-1] - middle, middle - 2 * ranks.known[0])
        while (low < high).any():
            d = (low + high) // 2
            inside = ranks.below(lo, hi, (middle + d) // 2 + 1) - ranks.below(lo, hi, -((d - middle) // 2))
            enough = inside >= need
            low, high = np.where(enough, low, d + 1), np.where(enough, d, high)
        total += low
    return middle, total


_FOUND = "n long, middle long, spread long"


def _ordinary(rows: DataFrame, states: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Keys that fit a task, many of them in each."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + _FOUND

    def answer(posted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        posted = posted.sort_values([*keys, "pos"], kind="stable")
        first = (posted[keys] != posted[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
        starts = posted.iloc[first][keys].assign(_lo=first)
        asked = asked.merge(starts, on=keys)
        if not len(asked):
            return pd.DataFrame({c: [] for c in [*keys, "n", "middle", "spread"]}).astype(
                {k: posted[k].dtype for k in keys} | {"n": "int64", "middle": "int64", "spread": "int64"}
            )
        ranks = Ranks(posted["x"].to_numpy(np.int64))
        middle, spread = _spread(ranks, asked["_lo"].to_numpy(), asked["n"].to_numpy(np.int64))
        return asked[[*keys, "n"]].assign(middle=middle, spread=spread)

    task = F.pmod(F.xxhash64(*keys), F.lit(tasks)).alias("_task")
    left = rows.select(task, *keys, "pos", "x").groupBy("_task")
    return left.cogroup(states.select(task, *keys, "n").groupBy("_task")).applyInPandas(answer, schema)


class _Large:
    """Rows of large keys by block and by cell, and counts below a value in prefixes of them."""

    def __init__(self, rows: DataFrame, keys: list[str], block: int, cells: int) -> None:
        self.keys, self.block = keys, block
        shares = [i / cells for i in range(1, cells)]
        cuts = rows.groupBy(*keys).agg(
            F.percentile_approx("x", shares, 10_000).alias("_c"), F.min("x").alias("lo"), F.max("x").alias("hi")
        )
        # a value that many rows share is a cell of its own
        both = F.flatten(F.transform("_c", lambda c: F.array(c, c + 1)))
        self.cuts = durable(cuts.select(*keys, F.array_sort(F.array_distinct(both)).alias("cuts"), "lo", "hi"))
        self.rows = durable(
            rows.join(self.cuts, keys).select(
                *keys, "pos", "x", F.floor(F.col("pos") / block).alias("_block"), _cell("x").alias("_cell"),
                # rows of a cell with one value lie below none of it
                (~_is_cut(F.col("x")) | ~_is_cut(F.col("x") + 1)).alias("_wide"),
            )
        )
        counts = self.rows.groupBy(*keys, "_block", "_cell").agg(F.count("*").alias("m"))
        kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
        self.kinds = kinds

        def stored(some: pd.DataFrame) -> pd.DataFrame:
            grid = np.zeros((int(some["_block"].max()) + 2, 2 * cells), np.int64)
            np.add.at(grid, (some["_block"].to_numpy(int) + 1, some["_cell"].to_numpy(int) + 1), some["m"].to_numpy())
            grid = grid.cumsum(axis=0).cumsum(axis=1)
            out = some.iloc[[0] * len(grid)][keys].reset_index(drop=True)
            return out.assign(_block=range(len(grid)), before=list(grid))

        # one row a block, of numbers of cells
        self.before = durable(
            counts.groupBy(*keys).applyInPandas(stored, f"{kinds}, _block long, before array<long>")
        )

    def below(self, probes: DataFrame) -> DataFrame:
        """``probe, m``: of the first ``n`` rows of the key, how many lie below ``v``; to be summed."""
        keys = self.keys
        asked = probes.join(self.cuts.select(*keys, "cuts"), keys).select(
            *keys, "probe", "n", "v", F.floor(F.col("n") / self.block).alias("_block"), _cell("v").alias("_cell"), (~_is_cut(F.col("v"))).alias("_wide")
        )
        stored = asked.join(self.before, [*keys, "_block"]).select("probe", F.col("before")[F.col("_cell").cast("int")].alias("m"))
        size = self.block

        def inside(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pos")
            upto = np.searchsorted(rows["pos"].to_numpy(), some["upto"].to_numpy())
            found = Ranks(rows["x"].to_numpy(np.int64)).below(np.zeros(len(some), np.int64), upto, some["v"].to_numpy())
            return pd.DataFrame({"probe": some["probe"].to_numpy(), "m": found})

        parts = [stored]
        by_block = asked.withColumn("upto", F.col("n"))
        by_cell = asked.where("_wide").withColumn("upto", F.col("_block") * size)
        for place, some, rows in (("_block", by_block, self.rows), ("_cell", by_cell, self.rows.where("_wide"))):
            # a place that very many ask is copied, so that no task gets more than a block of probes for each
            asking = some.groupBy(*keys, place).agg(F.ceil(F.count("*") / (TRIES * size)).cast("int").alias("_copies"))
            dealt = some.join(asking, [*keys, place]).withColumn("_copy", F.pmod(F.xxhash64("probe"), "_copies").cast("int"))
            copied = rows.join(asking, [*keys, place]).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
            group = [*keys, place, "_copy"]
            parts.append(
                copied.select(*group, "pos", "x").groupBy(*group)
                .cogroup(dealt.select(*group, "probe", "v", "upto").groupBy(*group))
                .applyInPandas(lambda key, rows, some: inside(rows, some), "probe string, m long")
            )
        return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _cell(value: str):
    """The number of cuts up to a value."""
    return F.size(F.filter("cuts", lambda c: c <= F.col(value)))


def _is_cut(value):
    return F.array_contains("cuts", value)


def _searched(large: _Large, states: DataFrame, counted) -> DataFrame:
    """``state, found``: the least whole number from ``lo`` to ``hi`` for which the count reaches ``need``.

    ``counted`` names the prefixes to count for a number ``t``: pairs of a sign and a bound.
    """
    keys = large.keys
    waiting, done = states, None
    while True:
        waiting = durable(waiting)
        ended = waiting.where("lo >= hi").select("state", F.col("lo").alias("found"))
        done = ended if done is None else done.unionByName(ended)
        waiting = waiting.where("lo < hi")
        if waiting.isEmpty():
            return done
        step = F.transform(
            F.sequence(F.lit(1), F.lit(TRIES)),
            lambda j: F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * j / F.lit(TRIES + 1)),
        )
        tried = waiting.withColumn("t", F.explode(F.array_distinct(step)))
        name = F.concat_ws("|", "state", "t")
        probes = None
        for sign, bound in counted:
            some = tried.select(*keys, F.concat(F.lit(sign), name).alias("probe"), "n", bound.cast("long").alias("v"))
            probes = some if probes is None else probes.unionByName(some)
        sums = large.below(probes).groupBy(F.substring("probe", 2, 1000).alias("name")).agg(
            F.sum(F.when(F.startswith("probe", F.lit("+")), F.col("m")).otherwise(-F.col("m"))).alias("m")
        )
        seen = tried.withColumn("name", name).join(sums, "name")
        enough = F.col("m") >= F.col("need")
        bounds = seen.groupBy("state").agg(
            F.max(F.when(~enough, F.col("t") + 1)).alias("_lo"), F.min(F.when(enough, F.col("t"))).alias("_hi")
        )
        waiting = waiting.join(bounds, "state").withColumns(
            {"lo": F.coalesce("_lo", "lo"), "hi": F.coalesce("_hi", "hi")}
        ).drop("_lo", "_hi")


def _of_large(rows: DataFrame, states: DataFrame, keys: list[str], block: int, cells: int) -> DataFrame:
    """Keys beyond a task, by rounds of counting."""
    large = _Large(rows, keys, block, cells)
    named = durable(states.withColumn("id", F.concat_ws("/", F.xxhash64(*keys).cast("string"), "n")))
    middles = F.explode(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)).alias("need")
    which = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("which")

    def two(frame: DataFrame) -> DataFrame:
        need = F.when(F.col("which") == "a", F.floor((F.col("n") + 1) / 2)).otherwise(F.floor(F.col("n") / 2) + 1)
        return frame.select("*", which).withColumns(
            {"need": need, "state": F.concat_ws("/", "id", "which")}
        )

    first = two(named.join(large.cuts.select(*keys, "lo", "hi"), keys))
    found = _searched(large, first, [("+", F.col("t") + 1)])
    middle = found.groupBy(F.substring_index("state", "/", 2).alias("id")).agg(F.sum("found").alias("middle"))
    known = durable(named.join(middle, "id").join(large.cuts.select(*keys, "lo", "hi"), keys))
    widest = F.greatest(2 * F.col("hi") - F.col("middle"), F.col("middle") - 2 * F.col("lo"))
    second = two(known.withColumns({"hi": widest, "lo": F.lit(0).cast("long")}))
    # doubled deviations up to t: 2 x from middle - t to middle + t
    upper = F.floor((F.col("middle") + F.col("t")) / 2) + 1
    lower = F.ceil((F.col("middle") - F.col("t")) / 2)
    found = _searched(large, second, [("+", upper), ("-", lower)])
    spread = found.groupBy(F.substring_index("state", "/", 2).alias("id")).agg(F.sum("found").alias("spread"))
    return known.join(spread, "id").select(*keys, "n", "middle", "spread")


def prefix_spread(
    rows: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    *,
    large: int = LARGE,
    block: int = BLOCK,
    cells: int = CELLS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``keys, n, median, mad`` for each distinct (key, n) of ``states``: exact, over the first n rows.

    ``rows``: keys, ``pos`` (0, 1, ... within the key), ``x`` (long). A state asks for at least one row
    and at most all of its key. Neither a task nor a broadcast grows with the largest key.
    """
    keys = list(keys)
    # names of their own, since both may stem from one table
    states = states.select(*keys, "n").distinct().toDF(*keys, "n")
    sizes = durable(rows.groupBy(*keys).agg(F.count("*").alias("_size")))
    total = sizes.where(F.col("_size") <= large).agg(F.sum("_size")).first()[0] or 0
    small_keys = sizes.where(F.col("_size") <= large).select(*keys)
    large_keys = sizes.where(F.col("_size") > large).select(*keys)
    found = None
    if total:
        some = rows.join(small_keys, keys, "left_semi"), states.join(small_keys, keys, "left_semi")
        found = _ordinary(*some, keys, max(1, -(-total // task_rows)))
    if not large_keys.isEmpty():
        some = durable(rows.join(large_keys, keys, "left_semi")), states.join(large_keys, keys, "left_semi")
        more = _of_large(*some, keys, block, cells)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = states.select(*keys, "n", F.col("n").alias("middle"), F.col("n").alias("spread")).limit(0)
    return found.select(
        *keys, "n", (F.col("middle") / 2).alias("median"), (F.col("spread") / 4).alias("mad")
    )
