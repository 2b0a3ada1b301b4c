"""Near duplicates by 64-bit SimHash, found through unequal shares of the allowed distance.

If two fingerprints differ in ``limit`` bits at most, and the bits are dealt to parts with
thresholds whose sum plus the number of parts is ``limit + 1``, then in one part at least they differ
by no more than its threshold. Bits that go together share a part. Each fingerprint chooses its own
thresholds, by dynamic programming over how many candidates each threshold of each part would bring,
and then asks for all values within them. Parts where very many fingerprints agree are not joined:
two fingerprints within an even distance meet at a point half way, so each of the crowd lists its
neighbourhood, which is linear in the crowd.
"""

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatelens.llm.common import REPORT, report, summed, written
from gatelens.llm.components import components
from gatelens.llm.token_ids import sliced

#: Words of a shingle, and the seed of its hash.
WIDTH = 4
SEED = 42
BITS = 64
#: Bits in which linked fingerprints differ at most.
LIMIT = 4
#: Bits of a sub-part, whose values are counted one by one to estimate candidates.
COUNTED = 11
#: Bytes of one text that are cut into words at a time, and shingles hashed at a time.
PIECE = 4_000_000
HASHED = 1 << 17
#: Fingerprints that choose their thresholds at a time.
ROWS = 4096

_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bit k of a byte in byte k of a number, so that up to 255 bytes can be added at once.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words; each starts with the last three words before."""
    at, carry = 0, b""
    while at < len(data):
        found = _SPACE.search(data, at + PIECE) if len(data) - at > PIECE else None
        end = found.start() if found else len(data)
        piece = carry + data[at:end]
        yield piece
        back = 4096
        while len(tail := piece[-back:].split()) < WIDTH and back < len(piece):
            back *= 2
        carry = b" ".join(tail[-(WIDTH - 1) :]) + b" "
        at = end


def _hashes(parts: list[bytes], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``owner, hash`` of the shingles of each part; a part with fewer words is one if ``whole``."""
    buffer = np.frombuffer(b"".join(parts).lower(), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    letter = ~_IS_SPACE[buffer]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[begin[sizes > 0]] = False
    starts = np.flatnonzero(letter & ~before)
    if not len(starts):
        return
    owner = np.searchsorted(begin, starts, side="right") - 1
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[(begin + sizes - 1)[sizes > 0]] |= letter[(begin + sizes - 1)[sizes > 0]]
    ends = np.flatnonzero(last) + 1
    # words with one space between them: a space is kept where a word follows
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    norm = np.where(letter, buffer, 0x20)[keep].tobytes()
    moved = np.cumsum(keep)
    starts, ends = moved[starts] - 1, moved[ends - 1]
    n = np.bincount(owner, minlength=len(parts))
    first = np.cumsum(n) - n
    full = np.flatnonzero(owner[: len(owner) - WIDTH + 1] == owner[WIDTH - 1 :]) if len(owner) >= WIDTH else np.zeros(0, int)
    end = full + WIDTH - 1
    if whole:
        short = np.flatnonzero((n > 0) & (n < WIDTH))
        full = np.concatenate([full, first[short]])
        end = np.concatenate([end, first[short] + n[short] - 1])
        order = np.argsort(full, kind="stable")
        full, end = full[order], end[order]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(full), HASHED):
        some = slice(at, at + HASHED)
        spans = zip(starts[full[some]].tolist(), ends[end[some]].tolist(), strict=True)
        made = [digest(norm[a:b], SEED) for a, b in spans]
        yield owner[full[some]], np.array(made, np.uint64)


def _bit_counts(owner: np.ndarray, hashes: np.ndarray, out: np.ndarray, total: np.ndarray) -> None:
    """Add to ``out`` (owners by bits) how many hashes of each owner have each bit; owners ascend."""
    place = np.arange(len(owner))
    fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
    inside = place - np.maximum.accumulate(np.where(fresh, place, 0))
    cuts = np.flatnonzero(inside % 255 == 0)
    spread = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(spread, cuts, axis=0).astype("<u8").view(np.uint8).reshape(-1, BITS)
    heads = np.flatnonzero(fresh)
    chunk = np.searchsorted(cuts, heads)
    out[owner[heads]] += np.add.reduceat(counts.astype(np.int64), chunk, axis=0)
    total[owner[heads]] += np.diff(np.append(heads, len(owner)))


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """The fingerprints of texts as unsigned numbers; 0 for a null text or one without words."""
    data = pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()
    counts = np.zeros((len(data), BITS), np.int64)
    total = np.zeros(len(data), np.int64)
    usual = [text if len(text) <= PIECE else b"" for text in data]
    for owner, made in _hashes(usual, True):
        _bit_counts(owner, made, counts, total)
    for i, text in enumerate(data):
        if len(text) > PIECE:
            few = len(text.split(None, WIDTH)) < WIDTH
            for piece in [text] if few else _pieces(text):
                for owner, made in _hashes([piece], few):
                    _bit_counts(owner, made, counts[i : i + 1], total[i : i + 1])
    set_bits = 2 * counts > total[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, fp`` of every row, the fingerprint as a signed 64-bit number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            made = pa.array(fingerprints_of(batch.column(1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "id long, fp long")


def _column(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The unsigned fingerprints of batches, ``ROWS`` at most at a time."""
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(values), ROWS):
            yield values[at : at + ROWS]


def correlations(distinct: DataFrame) -> np.ndarray:
    """Size of the correlation of every two bits over all distinct fingerprints ``fp``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for values in _column(batches):
            bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float32)
            both += bits.T @ bits
            n += len(values)
        part = TaskContext.get().partitionId()
        yield from report("both", part, both.ravel().astype(np.int64))
        yield from report("n", part, np.array([n]))

    found = summed(distinct.select("fp").mapInArrow(count, REPORT), BITS * BITS)
    n = max(1, int(found["n"][0])) if "n" in found else 1
    both = found.get("both", np.zeros(BITS * BITS)).reshape(BITS, BITS) / n
    ones = np.diag(both)
    spread = np.sqrt(ones * (1 - ones))
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.abs(both - np.outer(ones, ones)) / np.outer(spread, spread)
    return np.nan_to_num(found, posinf=0.0)


def keys_within(bits: int, distance: int) -> int:
    """Values of ``bits`` bits within a distance of one; none for distance -1."""
    return sum(math.comb(bits, t) for t in range(distance + 1))


def parts_for(n: int, limit: int = LIMIT) -> int:
    """The number of parts with the fewest keys and candidates to expect among ``n`` even values."""

    def cost(parts: int) -> float:
        width = BITS // parts
        low, more = divmod(limit + 1, parts)
        keys = more * keys_within(width, low) + (parts - more) * keys_within(width, low - 1)
        return keys * (1 + n / 2**width)

    return min(range(2, limit + 2), key=cost)


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in ``parts`` groups: the most correlated pairs join first, while a group has room."""
    room = math.ceil(BITS / parts)
    groups = {b: [b] for b in range(BITS)}
    of = list(range(BITS))
    pairs = sorted(combinations(range(BITS), 2), key=lambda p: (-correlation[p], p))
    for a, b in pairs:
        one, other = of[a], of[b]
        if one != other and len(groups[one]) + len(groups[other]) <= room:
            groups[one] += groups.pop(other)
            for bit in groups[one]:
                of[bit] = one
    in_order = [b for g in sorted(groups.values(), key=lambda g: (-len(g), g)) for b in g]
    return [in_order[at : at + room] for at in range(0, BITS, room)]


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The number made of the given bits of each fingerprint."""
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def sub_parts(part: list[int]) -> list[list[int]]:
    many = math.ceil(len(part) / COUNTED)
    return [part[i::many] for i in range(many)]


class Plan:
    """Parts, and what each threshold costs each value; its size does not depend on the table."""

    def __init__(self, parts: list[list[int]], counts: dict[str, np.ndarray], n: int, limit: int) -> None:
        self.parts, self.limit = parts, limit
        self.n = n
        #: By part, sub-part, distance and value: share of all fingerprints at that distance.
        self.shares = [
            [_at_distance(counts[f"{i}.{j}"][: 1 << len(s)] / max(n, 1), limit) for j, s in enumerate(sub_parts(p))]
            for i, p in enumerate(parts)
        ]

    def costs(self, fps: np.ndarray, i: int) -> np.ndarray:
        """Keys and estimated candidates of part ``i``, by fingerprint and threshold from -1."""
        share = np.zeros((len(fps), self.limit + 1))
        share[:, 0] = 1
        for bits, table in zip(sub_parts(self.parts[i]), self.shares[i], strict=True):
            own = table[:, _values(fps, bits)].T
            share = np.stack(
                [(share[:, : t + 1] * own[:, t::-1]).sum(axis=1) for t in range(self.limit + 1)], axis=1
            )
        keys = [keys_within(len(self.parts[i]), t) for t in range(self.limit + 1)]
        costs = np.zeros((len(fps), self.limit + 2))
        costs[:, 1:] = np.cumsum(share, axis=1) * self.n + np.array(keys, float)
        return costs

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each fingerprint, by part; -1 leaves a part out."""
        size = self.limit + 2
        best = np.full((len(fps), size), np.inf)
        best[:, 0] = 0
        taken = []
        for i in range(len(self.parts)):
            cost = self.costs(fps, i)
            ways = np.full((len(fps), size, size), np.inf)
            for used in range(size):
                ways[:, used:, used] = best[:, : size - used] + cost[:, used, None]
            taken.append(ways.argmin(axis=2))
            best = ways.min(axis=2)
        left = np.full(len(fps), size - 1)
        out = np.empty((len(fps), len(self.parts)), int)
        for i in reversed(range(len(self.parts))):
            used = taken[i][np.arange(len(fps)), left]
            out[:, i] = used - 1
            left -= used
        return out


def _at_distance(counts: np.ndarray, limit: int) -> np.ndarray:
    """``[t, v]``: the sum of ``counts`` over the values at distance ``t`` from ``v``."""
    near = np.zeros((limit + 1, len(counts)))
    near[0] = counts
    bit = 1
    while bit < len(counts):
        moved = near[:, np.arange(len(counts)) ^ bit]
        near[1:] += moved[:-1]
        bit <<= 1
    return near


def flips(bits, distance: int) -> np.ndarray:
    """All masks of at most ``distance`` of the given bits."""
    made = [_mask(some) for t in range(distance + 1) for some in combinations(bits, t)]
    return np.array(made, np.uint64)


def planned(distinct: DataFrame, n: int, limit: int) -> Plan:
    parts = grouped_bits(correlations(distinct), parts_for(n, limit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {
            f"{i}.{j}": (bits, np.zeros(1 << len(bits), np.int64))
            for i, part in enumerate(parts)
            for j, bits in enumerate(sub_parts(part))
        }
        for values in _column(batches):
            for bits, counts in held.values():
                counts += np.bincount(_values(values, bits), minlength=len(counts))
        part = TaskContext.get().partitionId()
        for key, (_, counts) in held.items():
            yield from report(key, part, counts)

    size = 1 << COUNTED
    counts = summed(distinct.select("fp").mapInArrow(count, REPORT), size)
    every = [f"{i}.{j}" for i, p in enumerate(parts) for j in range(len(sub_parts(p)))]
    return Plan(parts, {key: counts.get(key, np.zeros(size)) for key in every}, n, limit)


def probes(distinct: DataFrame, plan: Plan) -> DataFrame:
    """``part, value, fp``: the values that each fingerprint asks for, within its own thresholds."""
    schema = pa.schema([("part", pa.int32()), ("value", pa.int64()), ("fp", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.uint64(_mask(p)) for p in plan.parts]
        for fps in _column(batches):
            chosen = plan.thresholds(fps)
            for i, part in enumerate(plan.parts):
                for t in range(plan.limit + 1):
                    asking = fps[chosen[:, i] == t]
                    moves = flips(part, t) if len(asking) else np.zeros(0, np.uint64)
                    step = max(1, (1 << 20) // max(1, len(moves)))
                    for at in range(0, len(asking), step):
                        some = asking[at : at + step]
                        values = ((some & masks[i])[:, None] ^ moves).ravel().view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(values), i, np.int32)),
                                pa.array(values),
                                pa.array(np.repeat(some, len(moves)).view(np.int64)),
                            ],
                            schema=schema,
                        )

    return distinct.select("fp").mapInArrow(ask, "part int, value long, fp long")


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def met_half_way(crowd: DataFrame, limit: int) -> DataFrame:
    """``a, b``: edges that join all of ``fp`` within ``limit`` bits, an even number, of each other.

    Two values are within the limit exactly if some point is within half of it of both. A point has
    no more values around it than that ball holds, so no group grows with the crowd.
    """

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = flips(range(BITS), limit // 2)
        for fps in _column(batches):
            for at in range(0, len(fps), 256):
                some = fps[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((some[:, None] ^ moves).ravel().view(np.int64)),
                        pa.array(np.repeat(some, len(moves)).view(np.int64)),
                    ],
                    names=["point", "a"],
                )

    points = crowd.select("fp").mapInArrow(around, "point long, a long")
    nearest = F.min("a").over(W.partitionBy("point"))
    return points.select("a", nearest.alias("b")).where("a <> b").distinct()


def links(distinct: DataFrame, limit: int = LIMIT, crowded: int | None = None) -> DataFrame:
    """``a, b``: edges between distinct fingerprints ``fp`` whose components are those of all links.

    A value of a part that more than ``crowded`` fingerprints have (by default as many as a ball of
    half the limit holds, from where listing neighbourhoods is the cheaper way) is taken out of the
    join; who has it and who asks for it are linked by their neighbourhoods instead. So every link is
    either found in the join or lies between two of the crowd.
    """
    if limit % 2:
        raise ValueError("the limit is an even number of bits")
    most = keys_within(BITS, limit // 2) if crowded is None else crowded
    plan = planned(distinct, distinct.count(), limit)
    held = F.array(
        *[
            F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(p)))).alias("value"))
            for i, p in enumerate(plan.parts)
        ]
    )
    data = distinct.select(F.col("fp").alias("other"), F.explode(held).alias("h")).select("other", "h.*")
    asked = probes(distinct, plan)
    sizes = data.groupBy("part", "value").agg(F.count("*").alias("n"))
    crowds = written(sizes.where(F.col("n") > most).select("part", "value"), "crowds")
    keys = ["part", "value"]
    apart = None
    if crowds.take(1):
        inside = data.join(crowds, keys, "left_semi").select(F.col("other").alias("fp"))
        asking = asked.join(crowds, keys, "left_semi").select("fp")
        apart = met_half_way(written(inside.union(asking).distinct(), "crowd"), limit)
        data = data.join(crowds, keys, "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= limit
    met = asked.join(data, keys).where(near & (F.col("fp") != F.col("other")))
    edges = met.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()
    return edges if apart is None else edges.union(apart)


def near_duplicates(
    docs: DataFrame, *, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row.

    Words are runs without ASCII white space, with A-Z in lower case; shingles are four words joined
    by spaces, repeats counted; a text with fewer words has one, its whole sequence. A bit is set that
    is set in more than half of the shingles' hashes. A null, empty or blank text has no shingles and
    fingerprint zero, which is linked like any other. Fingerprints that differ in ``limit`` bits at
    most are linked; ``component_id`` is the least id that can be reached. Texts of any length are
    taken whole, a few megabytes at a time. Rows that repeat an id stand each for their own text; a
    null id names no component unless no row of it has an id, and then it is null. An empty table
    gives no rows; other columns are left aside.
    """
    signed = written(fingerprints(docs, id_col, text), "simhash")
    classes = written(signed.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    found = components(written(links(classes, limit), "links"))
    standing = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")
    )
    least = standing.groupBy("root").agg(F.min("id").alias("component_id"))
    placed = standing.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return signed.join(placed, "fp").select(
        F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id"
    )
