"""Document fingerprints from closed syncmers, in DataFrame operations only.

A k-mer of bytes is an anchor if the least hash among its inner s-mers is that of its first or last
one. That depends on the k-mer alone, so equal passages have equal anchors wherever they stand. A
fingerprint keeps the least anchor hash of each of a fixed number of slots.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gatelens.llm.common import id_blocks

K = 16
S = 10
SLOTS = 64
#: Positions made at once for one text.
SPAN = 1 << 16
#: Documents in a range of ids, if ids are spread evenly.
NEIGHBOURS = 256
FAMILY = 4096


def _inner(data: str, at: int) -> str:
    return f"xxhash64(substring({data}, _pos + {at}, {S}))"


def is_anchor(data: str) -> Column:
    """Whether the k-mer of the binary column ``data`` at ``_pos`` is a closed syncmer.

    Hashes that tie with the least one count as least, so runs of one sign are anchors.
    """
    last = K - S
    edges = [
        " AND ".join(f"{_inner(data, edge)} <= {_inner(data, i)}" for i in order)
        for edge, order in ((0, range(1, last + 1)), (last, range(last - 1, -1, -1)))
    ]
    return F.expr(f"octet_length({data}) < {K} OR ({edges[0]}) OR ({edges[1]})")


def anchors(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, _pos, _anchor``: position (bytes, from 1) and hash of every anchor of each text.

    A text shorter than a k-mer is its own and only anchor; a null or empty text has none.
    """
    rows = texts.select(*keys, F.col(text).cast("binary").alias("_data"))
    last = f"greatest(1, octet_length(_data) - {K - 1})"
    spans = rows.where("octet_length(_data) > 0").select(
        *keys,
        "_data",
        F.expr(f"explode(sequence(0L, CAST(({last} - 1) DIV {SPAN} AS BIGINT)))").alias("_span"),
    )
    places = spans.select(
        *keys,
        "_data",
        F.expr(
            f"explode(sequence(CAST(_span * {SPAN} + 1 AS INT),"
            f" CAST(least((_span + 1) * {SPAN}, {last}) AS INT)))"
        ).alias("_pos"),
    )
    kept = places.where(is_anchor("_data"))
    return kept.select(
        *keys, "_pos", F.expr(f"xxhash64(substring(_data, _pos, {K}))").alias("_anchor")
    )


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, slots``: ascending (slot * 2^32 + hash) of the filled slots of each text.

    Texts without anchors have no row. Where ``texts`` lies by one of the keys nothing is shuffled.
    """
    found = anchors(texts, keys, text)
    least = (
        found.withColumn("_slot", F.pmod("_anchor", F.lit(SLOTS)))
        .groupBy(*keys, "_slot")
        .agg(F.min("_anchor").alias("_least"))
    )
    entry = F.shiftleft("_slot", 32).bitwiseOR(
        F.shiftrightunsigned("_least", 6).bitwiseAND(F.lit(0xFFFFFFFF))
    )
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("slots"))


def as_text(slots: Column) -> Column:
    """A fingerprint as text: two hexadecimal digits for each slot and eight for its hash."""
    digits = F.transform(slots, lambda e: F.lower(F.lpad(F.hex(e), 10, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(one: Column, other: Column) -> Column:
    """Share of the slots filled in either in which both agree; 1 for two empty fingerprints."""
    empty = F.array().cast("array<bigint>")
    one, other = F.coalesce(one, empty), F.coalesce(other, empty)
    filled = F.array_union(
        F.transform(one, lambda e: F.shiftright(e, 32)),
        F.transform(other, lambda e: F.shiftright(e, 32)),
    )
    same = F.size(F.array_intersect(one, other)) / F.size(filled)
    return F.when(F.size(filled) == 0, F.lit(1.0)).otherwise(same)


def chained(blocks: DataFrame) -> DataFrame:
    """``block, next_block`` of distinct blocks; the first follows the last."""
    families = blocks.withColumn("_family", F.floor(F.col("block") / FAMILY))
    inside = W.partitionBy("_family").orderBy("block")
    heads = families.groupBy("_family").agg(F.min("block").alias("_head"))
    everything = W.orderBy("_family")
    heads = heads.select(
        "_family",
        F.coalesce(
            F.lead("_head").over(everything),
            F.first("_head").over(everything.rowsBetween(W.unboundedPreceding, 0)),
        ).alias("_next_head"),
    )
    return (
        families.withColumn("_lead", F.lead("block").over(inside))
        .join(heads, "_family")
        .select("block", F.coalesce("_lead", "_next_head").alias("next_block"))
    )


def with_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``block, place, id, text, next_text``: each document with the next by id, the last with the first.

    Only neighbours of a range of ids meet in one task; equal ids follow each other by text, and a
    null id comes first.
    """
    low, width = id_blocks(docs, id_col, NEIGHBOURS)
    block = F.coalesce(F.floor((F.col(id_col).cast("long") - low) / width), F.lit(-1)).cast("long")
    rows = docs.select(
        block.alias("block"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = W.partitionBy("block").orderBy("id", "text")
    placed = rows.withColumn("place", F.row_number().over(order))
    firsts = placed.where("place = 1").select(
        F.col("block").alias("next_block"), F.col("text").alias("_first")
    )
    following = chained(rows.select("block").distinct()).join(firsts, "next_block")
    return (
        placed.withColumn("_lead", F.lead("text").over(order))
        .join(following.drop("next_block"), "block")
        .select(
            "block", "place", "id", "text", F.coalesce("_lead", "_first").alias("next_text")
        )
    )


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by as many code points of the next one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half)
    )


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text ends in the beginning of the next document by id (of the first one
    after the last). A null text counts as empty and has an empty fingerprint. Repeated rows are
    documents of their own, other columns are left aside, and an empty table gives no rows.
    """
    rows = with_next(docs, id_col, text).withColumn(
        "edited", edited(F.col("text"), F.col("next_text"))
    )
    both = rows.select(
        "block", "place", "text", "edited", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")
    ).select("block", "place", "kind", F.expr("IF(kind = 0, text, edited)").alias("text"))
    made = fingerprints(both, ["block", "place", "kind"], "text")
    pair = made.groupBy("block", "place").agg(
        F.max(F.when(F.col("kind") == 0, F.col("slots"))).alias("own"),
        F.max(F.when(F.col("kind") == 1, F.col("slots"))).alias("changed"),
    )
    facts = rows.select(
        "block",
        "place",
        "id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
    )
    known = facts.join(pair, ["block", "place"], "left")
    firsts = known.where("place = 1").select(
        F.col("block").alias("next_block"),
        F.struct("own").alias("_first"),
    )
    following = chained(known.where("place = 1").select("block")).join(firsts, "next_block")
    order = W.partitionBy("block").orderBy("place")
    near = known.withColumn("_lead", F.lead(F.struct("own")).over(order)).join(
        following.drop("next_block"), "block"
    )
    return near.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("_lead", "_first")["own"]).alias("near_next"),
    )


def aligned(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Shared passages of given pairs: ``one, other, shift, anchors, begin, end``.

    ``pairs`` has ``one, other`` (ids) and ``found`` has ``id, _pos, _anchor``. An anchor counts at
    its first position in a text, so a pair meets each anchor once; anchors that keep one distance
    (``shift``) between both texts make up a passage from byte ``begin`` to ``end`` of ``one``.
    """
    once = found.groupBy("id", "_anchor").agg(F.min("_pos").alias("_pos"))
    left = once.select(F.col("id").alias("one"), "_anchor", F.col("_pos").alias("_p"))
    right = once.select(F.col("id").alias("other"), "_anchor", F.col("_pos").alias("_q"))
    met = pairs.select("one", "other").distinct().join(left, "one").join(right, ["other", "_anchor"])
    return met.groupBy("one", "other", (F.col("_q") - F.col("_p")).alias("shift")).agg(
        F.count("*").alias("anchors"),
        F.min("_p").alias("begin"),
        (F.max("_p") + K - 1).alias("end"),
    )
