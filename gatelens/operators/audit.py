"""Audit logs as Merkle trees: hashing, roots, proofs and tamper checks as joins.

A tree is built in rounds of ``WIDTH`` leaves. One row holds one block with all of its inner
levels, and the block roots are the leaves of the next round. Splits of an RFC 6962 tree always
fall on multiples of a power of two, so a block is a subtree (the last one may be ragged) and
no step ever needs more than one block per row. Proofs and prefix roots join each leaf with its
own block only, so no node near the root becomes a hot join key.
"""

import json
import re
from collections.abc import Collection
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatelens.functions.hashing import EMPTY_ROOT, canonical_json, has_float, leaf_hash, node_hash
from gatelens.functions.scalars import key_purpose
from gatelens.session import durable

BITS = 10
WIDTH = 1 << BITS
#: Leaves of a block that meet their rows together.
PART_BITS = 5
HEAD_EVERY = 16
MAX_PAGE = 200


@dataclass(frozen=True)
class Tree:
    """Rounds of blocks: (block, levels), levels being an array of arrays of hex hashes."""

    rounds: tuple[DataFrame, ...]
    bits: int

    @property
    def width(self) -> int:
        return 1 << self.bits


def _pair_up(level: Column) -> Column:
    """Next level: hash pairs, promote an odd last node."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")),
        lambda i: F.when(
            i * 2 + 1 < F.size(level), node_hash(F.get(level, i * 2), F.get(level, i * 2 + 1))
        ).otherwise(F.get(level, i * 2)),
    )


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Pack (idx, hash) into blocks with all inner levels; a block has at most 2**bits nodes."""
    packed = nodes.groupBy(F.shiftright("idx", bits).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("_n")
    )
    leaves = F.transform("_n", lambda n: n["hash"])
    # one expression that grows the list of levels, so the plan stays small however deep
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(bits)),
        F.array(leaves),
        lambda acc, _: F.concat(acc, F.array(_pair_up(F.element_at(acc, -1)))),
    )
    return packed.select("block", levels.alias("levels"))


def build_tree(
    leaves: DataFrame, size: int | None = None, *, bits: int = BITS, keep: bool = False
) -> Tree:
    """Tree over ``leaves`` (idx 0..n-1 without gaps, hash in hex).

    ``size`` is the number of leaves (the latest head knows it); without it they are counted.
    ``keep`` writes each round to the checkpoint folder, for trees that many proofs share.
    """
    n = leaves.count() if size is None else size
    rounds = []
    nodes = leaves.select(F.col("idx").cast("long"), "hash")
    while True:
        block = durable(_blocks(nodes, bits)) if keep else _blocks(nodes, bits)
        rounds.append(block)
        n = -(-n // (1 << bits))
        if n <= 1:
            return Tree(tuple(rounds), bits)
        nodes = block.select(F.col("block").alias("idx"), _top(F.col("levels"), bits).alias("hash"))


def _top(levels: Column, bits: int) -> Column:
    return F.get(F.get(levels, F.lit(bits)), F.lit(0))


def hash_leaves(log: DataFrame, payload: str = "payload") -> DataFrame:
    return log.select("idx", leaf_hash(payload).alias("hash"))


def tree_root(tree: Tree) -> DataFrame:
    """One row with the root; the root of an empty log is the hash of nothing."""
    root = tree.rounds[-1].agg(F.max(_top(F.col("levels"), tree.bits)).alias("root"))
    return root.select(F.coalesce("root", F.lit(EMPTY_ROOT)).alias("root"))


def tree_nodes(tree: Tree, size: int) -> DataFrame:
    """Every node: ``level``, ``index``, ``hash``; promoted nodes appear on each level."""
    out = None
    for place, block in enumerate(tree.rounds):
        low = 0 if place == 0 else 1
        opened = block.select("block", F.posexplode("levels").alias("l", "hashes")).where(
            F.col("l") >= low
        )
        nodes = opened.select(
            (F.col("l") + place * tree.bits).cast("int").alias("level"),
            "block",
            "l",
            F.posexplode("hashes").alias("p", "hash"),
        ).select(
            "level",
            (F.shiftleft(F.col("block"), tree.bits) / F.pow(F.lit(2), F.col("l")) + F.col("p"))
            .cast("long")
            .alias("index"),
            "hash",
        )
        out = nodes if out is None else out.unionByName(nodes)
    return out.where(F.col("level") <= max(size - 1, 0).bit_length())


# ---------------------------------------------------------------- paths and peaks


def _path(levels: Column, offset: Column, bits: int, first: Column | int = 0) -> Column:
    """Sibling hashes from level ``first`` up inside a block; a promoted node has no sibling."""
    start = first if isinstance(first, Column) else F.lit(first)

    def sibling(level: Column) -> Column:
        place = F.call_function("shiftright", offset, level)
        return F.get(F.get(levels, level), place.bitwiseXOR(F.lit(1)))

    found = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda level: level >= start), sibling
    )
    return F.array_compact(found)


def _peaks(levels: Column, count: Column, bits: int) -> Column:
    """Roots of the full subtrees that cover the first ``count`` nodes, left to right."""

    def peak(level: Column) -> Column:
        place = F.call_function("shiftright", count, level)
        return F.when(
            place.bitwiseAND(F.lit(1)) == 1, F.get(F.get(levels, level), place - 1)
        )

    return F.array_compact(F.transform(F.sequence(F.lit(bits), F.lit(0), F.lit(-1)), peak))


def _fold(peaks: Column) -> Column:
    """Root over peaks: hash them together from the right."""
    return F.aggregate(
        F.reverse(peaks),
        F.lit(None).cast("string"),
        lambda acc, p: F.when(acc.isNull(), p).otherwise(node_hash(p, acc)),
    )


def _split(column: str, bits: int) -> tuple[Column, Column]:
    c = F.col(column)
    return F.shiftright(c, bits), c.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _upper(tree: Tree, place: int, what: str) -> DataFrame:
    """Per block of round ``place``: its path to the root, or the peaks left of it."""
    empty = F.array().cast("array<string>")
    if place == len(tree.rounds) - 1:
        return tree.rounds[place].select("block", empty.alias("upper"))
    parent = tree.rounds[place + 1].join(_upper(tree, place + 1, what), "block")
    opened = parent.select(
        "levels",
        "upper",
        "block",
        F.posexplode(F.get("levels", F.lit(0))).alias("offset", "_"),
    )
    own = (
        F.concat(_path(F.col("levels"), F.col("offset"), tree.bits), F.col("upper"))
        if what == "path"
        else F.concat(F.col("upper"), _peaks(F.col("levels"), F.col("offset"), tree.bits))
    )
    return opened.select(
        (F.shiftleft("block", tree.bits) + F.col("offset")).alias("block"), own.alias("upper")
    )


def _with_blocks(tree: Tree, what: str) -> DataFrame:
    return tree.rounds[0].join(_upper(tree, 0, what), "block")


def inclusion_proofs(tree: Tree, wanted: DataFrame | None = None) -> DataFrame:
    """``idx``, ``leaf_hash``, ``path`` of every leaf, or of the distinct ``idx`` in ``wanted``."""
    blocks = _with_blocks(tree, "path")
    if wanted is None:
        rows = blocks.select(
            "block", "levels", "upper", F.posexplode(F.get("levels", F.lit(0))).alias("offset", "_")
        )
    else:
        block, offset = _split("idx", tree.bits)
        asked = wanted.select(F.col("idx").cast("long")).distinct()
        rows = asked.select(block.alias("block"), offset.alias("offset")).join(blocks, "block")
    return rows.select(
        (F.shiftleft("block", tree.bits) + F.col("offset")).alias("idx"),
        F.get(F.get("levels", F.lit(0)), F.col("offset")).alias("leaf_hash"),
        F.concat(_path(F.col("levels"), F.col("offset"), tree.bits), "upper").alias("path"),
    )


def _parts(tree: Tree) -> tuple[DataFrame, int]:
    """Blocks cut into subtrees of at most 2**PART_BITS leaves, each with its own path to the root.

    A leaf then meets a few kilobytes instead of its whole block. ``part`` is the index of the leaves
    by the bits of a part, which are returned too.
    """
    bits = min(PART_BITS, tree.bits)
    leaves = F.get("levels", F.lit(0))
    last = F.shiftright(F.size(leaves) - 1, bits)
    cut = _with_blocks(tree, "path").select("*", F.explode(F.sequence(F.lit(0), last)).alias("_part"))
    first = F.shiftleft("_part", bits)
    levels = [
        F.slice(F.get("levels", F.lit(x)), F.shiftright(first, x) + 1, F.lit(1 << (bits - x))) for x in range(bits)
    ]
    # a node without sibling is NULL
    above = [
        F.get(F.get("levels", F.lit(x)), F.shiftright(first, x).bitwiseXOR(F.lit(1))) for x in range(bits, tree.bits)
    ]
    path = F.array_compact(F.array(*above).cast("array<string>"))
    return cut.select(
        (F.shiftleft("block", tree.bits - bits) + F.col("_part")).alias("part"),
        F.array(*levels).alias("levels"),
        F.concat(path, "upper").alias("upper"),
    ), bits


def proofs_beside(tree: Tree, rows: DataFrame) -> DataFrame:
    """The ``rows`` whose ``idx`` is in the tree, with ``leaf_hash`` and ``path``.

    The rows travel to the leaves: a path is far wider than what it is asked for. No path is shuffled, and
    no side is broadcast: estimates made before leaves are hashed do not tell how wide parts are.
    """
    parts, bits = _parts(tree)
    part, offset = _split("idx", bits)
    asked = rows.withColumn("idx", F.col("idx").cast("long")).withColumns({"part": part, "_offset": offset})
    met = asked.join(parts.hint("merge"), "part").where(F.col("_offset") < F.size(F.get("levels", F.lit(0))))
    return met.select(
        *rows.columns,
        F.get(F.get("levels", F.lit(0)), F.col("_offset")).alias("leaf_hash"),
        F.concat(_path(F.col("levels"), F.col("_offset"), bits), "upper").alias("path"),
    )


def prefix_roots(tree: Tree, sizes: DataFrame) -> DataFrame:
    """``size`` and ``root`` for each requested size from 0 to the size of the log."""
    asked = sizes.select(F.col("size").cast("long")).distinct()
    # a size is looked up by its last leaf, which always exists; nothing comes after it
    block, offset = _split("_last", tree.bits)
    rows = asked.withColumn("_last", F.col("size") - 1)
    joined = rows.where("size > 0").withColumns({"block": block, "offset": offset}).join(
        _with_blocks(tree, "peaks"), "block"
    )
    # a full block ends on its own root, which the enclosing rounds may merge further
    inside = _peaks(F.col("levels"), F.col("offset") + 1, tree.bits)
    roots = joined.select("size", _fold(F.concat("upper", inside)).alias("root"))
    empty = asked.where("size = 0").select("size", F.lit(EMPTY_ROOT).alias("root"))
    return roots.unionByName(empty)


def _trailing_zeros(n: Column) -> Column:
    lowest = n.bitwiseAND(-n)
    return F.round(F.log2(lowest.cast("double"))).cast("int")


def consistency_proofs(tree: Tree, sizes: DataFrame, total: int) -> DataFrame:
    """``size`` and ``path`` proving each old size to be a prefix of the log of ``total`` leaves.

    The path starts at the last full subtree of the old log (left out when the old log is that
    subtree) and goes on like an inclusion path. Sizes 0 and ``total`` have an empty path.
    """
    asked = sizes.select(F.col("size").cast("long")).distinct()
    inner = asked.where((F.col("size") > 0) & (F.col("size") < total))
    block, offset = _split("_last", tree.bits)
    rows = (
        inner.withColumn("_zeros", _trailing_zeros(F.col("size")))
        .withColumn("_last", F.col("size") - 1)
        .withColumns({"block": block, "offset": offset})
    )
    shift = tree.bits
    near = rows.where(F.col("_zeros") <= shift).join(_with_blocks(tree, "path"), "block")
    start = F.get(
        F.get("levels", F.col("_zeros")),
        F.call_function("shiftright", F.col("offset"), F.col("_zeros")),
    )
    whole = F.col("size") == F.pow(F.lit(2), F.col("_zeros")).cast("long")
    head = F.when(whole, F.array().cast("array<string>")).otherwise(F.array(start))
    path = F.concat(
        head, _path(F.col("levels"), F.col("offset"), shift, F.col("_zeros")), F.col("upper")
    )
    out = near.select("size", path.alias("path"))
    if len(tree.rounds) > 1:
        # the subtree spans whole blocks: the same question one round up
        far = rows.where(F.col("_zeros") > shift).select(
            F.shiftright("size", shift).alias("size")
        )
        upper = Tree(tree.rounds[1:], tree.bits)
        lifted = consistency_proofs(upper, far, -(-total // (1 << shift)))
        out = out.unionByName(
            lifted.select(F.shiftleft("size", shift).alias("size"), "path")
        )
    edge = asked.where((F.col("size") == 0) | (F.col("size") == total))
    return out.unionByName(edge.select("size", F.array().cast("array<string>").alias("path")))


# ---------------------------------------------------------------- verifiers

STATE = "struct<fn:bigint,sn:bigint,fr:string,sr:string,ok:boolean>"


def _skip(fn: Column) -> Column:
    """Levels without a sibling above a right-edge node: trailing zeros of its index."""
    return F.when(fn == 0, F.lit(0)).otherwise(_trailing_zeros(fn))


def _walk(path: Column, fn: Column, sn: Column, first: Column, second: Column) -> Column:
    """Fold a proof path upwards, carrying the root of the old and the new tree."""

    def step(acc: Column, p: Column) -> Column:
        odd = acc["fn"].bitwiseAND(F.lit(1)) == 1
        left = odd | (acc["fn"] == acc["sn"])
        skip = F.when(left & ~odd, _skip(acc["fn"])).otherwise(F.lit(0)) + 1
        return F.struct(
            F.call_function("shiftright", acc["fn"], skip).alias("fn"),
            F.call_function("shiftright", acc["sn"], skip).alias("sn"),
            F.when(left, node_hash(p, acc["fr"])).otherwise(acc["fr"]).alias("fr"),
            F.when(left, node_hash(p, acc["sr"]))
            .otherwise(node_hash(acc["sr"], p))
            .alias("sr"),
            (acc["ok"] & (acc["sn"] != 0)).alias("ok"),
        )

    start = F.struct(
        fn.cast("long").alias("fn"),
        sn.cast("long").alias("sn"),
        first.alias("fr"),
        second.alias("sr"),
        F.lit(True).alias("ok"),
    ).cast(STATE)
    return F.aggregate(path, start, lambda acc, p: step(acc, p).cast(STATE))


def verify_inclusion(leaf: Column, index: Column, size: Column, path: Column, root: Column) -> Column:
    """True when the path leads from the leaf to the root."""
    end = _walk(path, index, size - 1, leaf, leaf)
    valid = (index >= 0) & (size > 0) & (index < size)
    return F.coalesce(valid & end["ok"] & (end["sn"] == 0) & (end["sr"] == root), F.lit(False))


def verify_consistency(
    first: Column, second: Column, first_root: Column, second_root: Column, path: Column
) -> Column:
    """True when the path shows the first tree to be a prefix of the second."""
    zeros = _trailing_zeros(first)
    power = first.bitwiseAND(first - 1) == 0
    full = F.when(power, F.concat(F.array(first_root), path)).otherwise(path)
    start = F.get(full, F.lit(0))
    end = _walk(
        F.slice(full, 2, F.size(full)),
        F.call_function("shiftright", first - 1, zeros),
        F.call_function("shiftright", second - 1, zeros),
        start,
        start,
    )
    climbed = (
        (F.size(full) > 0)
        & end["ok"]
        & (end["sn"] == 0)
        & (end["fr"] == first_root)
        & (end["sr"] == second_root)
    )
    return F.coalesce(
        F.when((first < 0) | (second < first), F.lit(False))
        .when(first == second, (F.size(path) == 0) & (first_root == second_root))
        .when(first == 0, F.size(path) == 0)
        .otherwise(climbed),
        F.lit(False),
    )


# ---------------------------------------------------------------- tamper checks


def positions(log: DataFrame, *, chunk_bits: int = 16) -> DataFrame:
    """Distinct idx with its ``position`` (number of rows before it) and ``copies``.

    Counting runs over chunks of the idx range, so no task sees more than one chunk.
    """
    counted = log.groupBy(F.col("idx").cast("long").alias("idx")).agg(
        F.count("*").alias("copies"),
        F.bool_or(
            F.coalesce(leaf_hash("payload") != F.col("leaf_hash"), F.lit(True))
        ).alias("bad_hash"),
    )
    chunked = counted.withColumn("_chunk", F.shiftright("idx", chunk_bits))
    chunks = chunked.groupBy("_chunk").agg(F.sum("copies").alias("_n"))
    upper = chunks.withColumn("_group", F.shiftright("_chunk", chunk_bits))
    before = W.unboundedPreceding, -1
    groups = upper.groupBy("_group").agg(F.sum("_n").alias("_g")).select(
        "_group",
        F.coalesce(F.sum("_g").over(W.orderBy("_group").rowsBetween(*before)), F.lit(0)).alias("_c1"),
    )
    carry = (
        upper.withColumn(
            "_c2",
            F.coalesce(
                F.sum("_n").over(W.partitionBy("_group").orderBy("_chunk").rowsBetween(*before)),
                F.lit(0),
            ),
        )
        .join(groups, "_group")
        .select("_chunk", (F.col("_c1") + F.col("_c2")).alias("_carry"))
    )
    inside = W.partitionBy("_chunk").orderBy("idx").rowsBetween(*before)
    return (
        chunked.withColumn("_in", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(carry, "_chunk")
        .select("idx", (F.col("_in") + F.col("_carry")).alias("position"), "copies", "bad_hash")
    )


def first_bad_leaf(log: DataFrame) -> DataFrame:
    """One row: the first position whose idx or hash is wrong, NULL for an intact log.

    ``log``: idx, payload, leaf_hash (stored).
    """
    placed = positions(log)
    bad = F.when(
        (F.col("idx") != F.col("position")) | F.col("bad_hash"), F.col("position")
    ).when(F.col("copies") > 1, F.col("position") + 1)
    return placed.agg(F.min(bad).alias("bad_index"))


def invalid_heads(heads: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """Sizes of stored heads that do not hold: range, root, signature or key purpose.

    ``heads``: size, root, key_id, sig_ok. ``roots``: size, root as recomputed.
    """
    actual = roots.select("size", F.col("root").alias("_actual"))
    good = (
        F.col("size").between(1, size)
        & (F.col("root") == F.col("_actual"))
        & F.col("sig_ok")
        & (key_purpose("key_id") == "tree-head-signer")
    )
    return (
        heads.join(actual, "size", "left")
        .where(~F.coalesce(good, F.lit(False)))
        .select("size")
    )


def verify_log(log: DataFrame, heads: DataFrame) -> DataFrame:
    """One row: ``ok``, ``size``, ``bad_index``, ``n_invalid_heads`` (their sizes come from
    ``invalid_heads``). Heads are compared with the payloads as they are now."""
    size = log.count()
    placed = hash_leaves(log)
    tree = build_tree(placed, size)
    asked = heads.where(F.col("size").between(1, size)).select("size")
    bad = invalid_heads(heads, prefix_roots(tree, asked), size)
    summary = first_bad_leaf(log).withColumn("_k", F.lit(1))
    counts = bad.agg(F.count("*").alias("n_invalid_heads")).withColumn("_k", F.lit(1))
    return summary.join(counts, "_k").select(
        (F.col("bad_index").isNull() & (F.col("n_invalid_heads") == 0)).alias("ok"),
        F.lit(size).cast("long").alias("size"),
        "bad_index",
        "n_invalid_heads",
    )


def leaf_page(log: DataFrame, start: int, limit: int) -> DataFrame:
    """A page of at most 200 leaves from an index on, each with an ``intact`` flag.

    A log without gaps has its page between two indexes: only those leaves are read. A page that is
    not full there (the end of the log, or a gap) is taken from all leaves that follow.
    """
    limit = min(limit, MAX_PAGE)
    following = log.where(F.col("idx") >= start)
    near = following.where(F.col("idx") < start + limit)
    if near.select("idx").limit(limit).count() == limit:
        following = near
    return (
        following.orderBy("idx")
        .limit(limit)
        .select(
            "idx",
            "leaf_hash",
            F.coalesce(leaf_hash("payload") == F.col("leaf_hash"), F.lit(False)).alias("intact"),
            "payload",
        )
    )


def head_schedule(log: DataFrame, every: int = HEAD_EVERY) -> DataFrame:
    """Sizes at which a head is due."""
    size = F.col("idx").cast("long") + 1
    return log.where(size % every == 0).select(size.alias("size"))


NO_OBJECT, FRACTION = "not a JSON object", "a number with a fraction"


def event_payloads(events: DataFrame) -> DataFrame:
    """``seq``, ``payload`` and ``refused`` of each event; one of the last two is NULL.

    An event is refused that is no JSON object the engine can parse (also one nested deeper than its
    parser goes, or with a key twice) or holds a fraction, since amounts are whole.
    """
    document = F.try_parse_json(drop_secret_keys(F.col("event")))
    rows = events.select("seq", document.alias("_d"))
    reason = F.when(F.col("_d").isNull(), NO_OBJECT).when(has_float(F.col("_d")), FRACTION)
    rows = rows.withColumns({"payload": canonical_json(F.col("_d")), "refused": reason})
    return rows.select("seq", "payload", "refused")


def refused_events(events: DataFrame) -> DataFrame:
    """``seq, refused`` of the events that have no canonical form, to be set aside before hashing."""
    return event_payloads(events).where("refused IS NOT NULL").select("seq", "refused")


def canonical_leaves(events: DataFrame, start: int = 0) -> DataFrame:
    """Leaves of a batch of events: secret keys dropped, canonical JSON, hash, next indexes.

    ``events``: seq (order in the batch, 0.. without gaps) and event (JSON text). A leaf is never
    NULL: an event without canonical form ends the query; see ``refused_events``.
    """
    refusal = F.raise_error(F.concat(F.lit("event "), F.col("seq"), F.lit(" has no leaf: "), F.col("refused")))
    payload = F.when(F.col("refused").isNull(), F.col("payload")).otherwise(refusal.cast("string"))
    return (
        event_payloads(events)
        .select((F.col("seq").cast("long") + start).alias("idx"), payload.alias("payload"))
        .withColumn("leaf_hash", leaf_hash("payload"))
    )


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s"{}\[\],:]+', re.S)


def without_keys(document: str, names: Collection[str]) -> str:
    """JSON text without the members of those names (lower case), at any depth and inside lists.

    What stays keeps its own text, so numbers and strings are never read or written anew. The text
    is walked token by token with a stack; ValueError for what is no JSON.
    """
    tokens = _TOKEN.findall(document)
    out: list[str] = []
    open_: list[list] = []  # bracket and whether something is in it
    after_key = False
    at = 0
    try:
        while at < len(tokens):
            token = tokens[at]
            at += 1
            if token == ",":
                continue
            if token in "}]":
                open_.pop()
                out.append(token)
                continue
            if open_ and not after_key:
                inside = open_[-1]
                named = inside[0] == "{"
                if named and json.loads(token).lower() in names:
                    depth = 0
                    at += 1
                    while True:
                        depth += (tokens[at] in "{[") - (tokens[at] in "}]")
                        at += 1
                        if not depth:
                            break
                    continue
                if inside[1]:
                    out.append(",")
                inside[1] = True
                if named:
                    out += token, ":"
                    at += 1
                    after_key = True
                    continue
            after_key = False
            out.append(token)
            if token in "{[":
                open_.append([token, False])
    except (IndexError, AttributeError) as broken:
        raise ValueError("not JSON") from broken
    return "".join(out)


def drop_secret_keys(document: Column) -> Column:
    """JSON text without secret-named keys, at any depth and inside lists.

    Only texts that may hold such a key (or an escaped name) leave the JVM. NULL for what is no JSON
    object.
    """
    from gatelens.operators.scan import SECRET_KEYS

    @F.pandas_udf("string")
    def stripped(documents: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else without_keys(text, SECRET_KEYS)
            except ValueError:
                return None

        return documents.map(one)

    names = "|".join(SECRET_KEYS)
    suspect = F.regexp_like(document, F.lit(f'(?i)"(?:{names})"\\s*:')) | F.contains(
        document, F.lit("\\u")
    )
    whole = F.when(suspect, stripped(F.when(suspect, document))).otherwise(document)
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json(document)), F.lit("OBJECT<"))
    return F.when(is_object, whole)


def tamper_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Leaves whose payload differs between two copies, or that only one of them has."""
    a = left.select("idx", F.col("payload").alias("left_payload"))
    b = right.select("idx", F.col("payload").alias("right_payload"))
    return (
        a.join(b, "idx", "full_outer")
        .where(~F.col("left_payload").eqNullSafe(F.col("right_payload")))
        .select("idx", "left_payload", "right_payload")
    )


def verify_report(entries: DataFrame, head: DataFrame, domain: str) -> DataFrame:
    """One row ``ok``: every entry re-checked against the signed head.

    ``entries``: idx, proof_idx, payload, domain, leaf_hash, path, tree_size, root. ``head``:
    one row size, root, sig_ok. A report without a head must be empty, and one with several heads
    is not ok, whatever they say.
    """
    fixed = head.groupBy(F.lit(1).alias("_k")).agg(
        F.when(F.count("*") == 1, F.min("size")).alias("_size"),
        F.when(F.count("*") == 1, F.min("root")).alias("_root"),
        F.bool_and("sig_ok").alias("sig_ok"),
        (F.count("*") > 1).alias("_several"),
    )
    # an aggregate of one row
    rows = entries.withColumn("_k", F.lit(1)).join(F.broadcast(fixed), "_k", "left")
    good = (
        (F.col("domain") == domain)
        & (F.col("idx") == F.col("proof_idx"))
        & (F.col("tree_size") == F.col("_size"))
        & (F.col("root") == F.col("_root"))
        & F.col("sig_ok")
        & (leaf_hash("payload") == F.col("leaf_hash"))
        & verify_inclusion(
            F.col("leaf_hash"), F.col("proof_idx"), F.col("tree_size"), F.col("path"), F.col("root")
        )
    )
    per_index = rows.groupBy("proof_idx").agg(
        F.count("*").alias("_n"), F.bool_and(F.coalesce(good, F.lit(False))).alias("_ok")
    )
    verdict = F.bool_and(F.col("_ok") & (F.col("_n") == 1))
    checked = per_index.agg(F.coalesce(verdict, F.lit(True)).alias("_ok"), F.lit(1).alias("_k"))
    return checked.join(F.broadcast(fixed.select("_k", "_several")), "_k", "left").select(
        (F.col("_ok") & ~F.coalesce("_several", F.lit(False))).alias("ok")
    )
