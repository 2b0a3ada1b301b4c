"""Near duplicates by MinHash with tensored banding, confirmed on whole shingle sets.

Two small collections of sub-keys, each from a few minhashes; a table key combines one sub-key of
either, so ``T`` by ``T`` tables cost ``2 * T`` sub-keys only. A sub-key that no other document has
can meet nobody and is dropped before keys are combined. Documents that meet in a table are
gathered in families; inside a family every link is tested on the full sets. Families too large
for one task are tested by pairs of blocks.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import written
from gatelens.llm.components import components
from gatelens.llm.token_ids import sliced

#: Words of a shingle.
WIDTH = 5
#: Minhashes of a sub-key.
ROWS = 3
#: Chance that a pair exactly at the threshold meets in no table, at most.
MISS = 5e-5
#: Documents and shingles of a family that one task tests at once, at most.
FAMILY_DOCS = 4096
FAMILY_SHINGLES = 4_000_000

_U64 = np.uint64


def sub_keys(percent: int) -> int:
    """Sub-keys of a collection: enough for ``MISS`` at the threshold."""
    hit = (percent / 100) ** ROWS
    return max(1, math.ceil(math.log(MISS / 2) / math.log(1 - hit)))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, repeats included, and how many each text has.

    Words are runs without ASCII white space, with A-Z in lower case. A text with fewer words than
    a shingle has one, its whole sequence; a text without words has none.
    """
    # lower case first: it misreads a slice that was cast to wide offsets
    texts = pc.fill_null(pc.ascii_lower(texts), "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words = pc.dictionary_encode(lists.flatten())
    known = words.dictionary.to_pylist()
    blank = known.index("") if "" in known else -1
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], _U64)
    codes = words.indices.to_numpy(zero_copy_only=False)
    word = hashes[codes] if len(codes) else np.zeros(0, _U64)
    cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    n = np.diff(cuts).astype(np.int64)
    if blank >= 0:
        n[(n == 1) & (codes[np.minimum(cuts[:-1], len(codes) - 1)] == blank)] = 0
    made = np.zeros(max(0, len(word) - WIDTH + 1), _U64)
    for j in range(WIDTH):
        made = made * _U64(0x9E3779B97F4A7C15) + word[j : j + len(made)]
        made ^= made >> _U64(29)
    made = _mixed(made)
    count = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), _U64)
    whole = n >= WIDTH
    sizes = count[whole]
    at = np.repeat(cuts[:-1][whole], sizes) + _inside(sizes)
    out[np.repeat(begin[whole], sizes) + _inside(sizes)] = made[at]
    for i in np.flatnonzero((n > 0) & ~whole):
        value = xxhash.xxh64_intdigest(word[cuts[i] : cuts[i] + n[i]].tobytes(), seed=int(n[i]))
        out[begin[i]] = value
    return out, count


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


def signatures(docs: DataFrame, percent: int, id_col: str, text: str) -> DataFrame:
    """``id, n, same, keys``: size and 128-bit hash of the set, and the sub-keys of both collections."""
    per_side = sub_keys(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(4)
        many = 2 * per_side * ROWS
        times = draw.integers(0, 1 << 31, many, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        plus = draw.integers(0, 1 << 32, many, dtype=np.uint32)
        for batch in sliced(batches, 1):
            all_hashes, count = shingles(batch.column(1))
            begin = np.cumsum(count) - count
            size = np.zeros(len(count), np.int64)
            same = []
            for i, (a, c) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)):
                own = np.unique(all_hashes[a : a + c])
                size[i] = len(own)
                same.append(xxhash.xxh3_128_digest(own.tobytes()))
            some = np.flatnonzero(count)
            keys = np.zeros((len(count), 2 * per_side), _U64)
            if len(some):
                low = (all_hashes >> _U64(32)).astype(np.uint32)
                for k in range(2 * per_side):
                    key = np.full(len(some), k + 1, _U64)
                    for r in range(k * ROWS, (k + 1) * ROWS):
                        least = np.minimum.reduceat(low * times[r] + plus[r], begin[some])
                        key = _mixed(key * _U64(0x9E3779B97F4A7C15) + least)
                    keys[some, k] = key
            listed = pa.ListArray.from_arrays(
                np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32),
                pa.array(keys.view(np.int64).ravel()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(same, pa.binary()), listed],
                names=["id", "n", "same", "keys"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "id long, n long, same binary, keys array<long>")


def meetings(classes: DataFrame, per_side: int) -> DataFrame:
    """``a, b``: every document that shares a table key, with the least one that has the key."""
    keys = classes.select("id", F.posexplode("keys").alias("k", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    live = keys.join(shared, "key").groupBy("id").agg(
        F.collect_list(F.when(F.col("k") < per_side, F.col("key"))).alias("one"),
        F.collect_list(F.when(F.col("k") >= per_side, F.col("key"))).alias("other"),
    )
    pairs = live.where("size(one) > 0 AND size(other) > 0").select(
        "id", F.explode("one").alias("one"), "other"
    )
    tables = pairs.select("id", "one", F.explode("other").alias("other")).select(
        "id", F.xxhash64("one", "other").alias("key")
    )
    least = tables.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("_n"))
    met = tables.join(least.where("_n > 1"), "key").where("id <> b")
    return met.select(F.col("id").alias("a"), "b").distinct()


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first set of its component, by links at the threshold.

    A set whose shingles are mostly its own cannot reach the threshold with anyone and is left out
    first. Then each set that is not yet in the component of the most central one meets all others at
    once, through the lists of sets by shingle; every pair outside that component is thus tested.
    """
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    root = np.arange(len(sets))
    live = np.ones(len(sets), bool)
    while True:
        spread = np.bincount(code[live[owner]], minlength=code.max() + 1)
        common = np.bincount(owner, weights=(spread[code] > 1) & live[owner], minlength=len(sets))
        keep = live & (100 * common >= percent * n)
        if (keep == live).all():
            break
        live = keep
    used = live[owner]
    owner, code = owner[used], code[used]
    order = np.argsort(code, kind="stable")
    holders = owner[order]
    start = np.searchsorted(code[order], np.arange(code.max() + 2)) if len(code) else np.zeros(1, int)
    begin = np.searchsorted(owner, np.arange(len(sets) + 1))
    centrality = np.bincount(owner, weights=spread[code], minlength=len(sets)) if len(code) else n * 0
    waiting = [int(i) for i in np.argsort(-centrality, kind="stable") if live[i]]
    for i in waiting:
        if i != waiting[0] and root[i] == root[waiting[0]]:
            continue
        mine = code[begin[i] : begin[i + 1]]
        sizes = start[mine + 1] - start[mine]
        met = holders[np.repeat(start[mine], sizes) + _inside(sizes)]
        both = np.bincount(met, minlength=len(sets))
        link = live & (100 * both >= percent * (n + n[i] - both))
        joined = np.unique(root[link])
        root[np.isin(root, joined)] = joined.min(initial=root[i])
    return root


def tested(texts: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links inside groups of ``group, id, text``, as edges to one of each component."""

    def close(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        root = linked(sets, percent)
        found = np.array(ids, np.int64)
        other = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_pydict({"a": found[other], "b": found[root[other]]})

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        ids: list[int] = []
        sets: list[np.ndarray] = []
        for batch in sliced(batches, 2):
            hashes, count = shingles(batch.column(2))
            begin = (np.cumsum(count) - count).tolist()
            rows = zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), begin, count.tolist(), strict=True
            )
            for where, i, a, c in rows:
                if where != group:
                    if len(ids) > 1:
                        yield close(ids, sets)
                    group, ids, sets = where, [], []
                ids.append(i)
                sets.append(np.unique(hashes[a : a + c]))
        if len(ids) > 1:
            yield close(ids, sets)

    dealt = texts.select("group", "id", "text").repartition("group").sortWithinPartitions("group", "id")
    return dealt.mapInArrow(test, "a long, b long")


def grouped(families: DataFrame) -> DataFrame:
    """``group, id``: a family that fits one task is a group, any other all pairs of its blocks.

    Blocks follow from the hash of the id; a document of a family of ``k`` blocks is in ``k`` groups.
    """
    sizes = families.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    parts = F.greatest(
        F.ceil(F.col("docs") / FAMILY_DOCS), F.ceil(F.col("shingles") / FAMILY_SHINGLES)
    )
    # two blocks meet in a task
    parts = F.when(parts <= 1, F.lit(1)).otherwise(2 * parts)
    rows = families.join(sizes.select("family", parts.cast("int").alias("parts")), "family")
    block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("block", block)
    pairs = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return pairs.select(
        F.xxhash64(
            "family", F.least("block", "with"), F.greatest("block", "with")
        ).alias("group"),
        "id",
    )


def near_duplicates(
    docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every document.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of five-word
    shingles; a component is named by its least id, which alone is kept. Null, empty and blank texts
    have no shingles, are linked with nothing and are kept. Equal sets are one class, represented by
    its least id, so copies never meet each other. Rows that repeat an id count as one document each
    and share its component; other columns are left aside; an empty table gives no rows.
    """
    signed = written(signatures(docs, percent, id_col, text), "signatures")
    full = signed.where("n > 0")
    classes = full.groupBy("same", "n").agg(F.min("id").alias("id"))
    standing = full.join(
        classes.withColumnRenamed("id", "first"), ["same", "n"]
    ).select("id", "first")
    first = full.join(classes.select("same", "id"), ["same", "id"]).dropDuplicates(["same", "id"])
    met = meetings(first.select("id", "keys"), sub_keys(percent))
    roots = components(met)
    families = roots.select(F.col("node").alias("id"), F.col("root").alias("family")).union(
        roots.select("root", "root").distinct()
    )
    sized = families.join(first.select("id", "n"), "id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    dealt = written(grouped(sized), "families")
    edges = tested(texts.join(dealt, "id"), percent)
    final = components(edges).select(F.col("node").alias("first"), "root")
    placed = standing.join(final, "first", "left").select(
        "id", F.coalesce("root", "first").alias("component_id")
    )
    of_id = placed.groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("id", "n").join(of_id, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
