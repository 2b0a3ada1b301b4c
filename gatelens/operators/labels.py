"""Labels as tables: joins of labels, covering, lookups, and summaries for display.

A label table is long: one row per (key, source, tag) with a level. Levels and tags come from
small fixed domains, source ids do not, so a joined label is split the same way: a summary row
(level, kinds, tags) and a table of distinct sources. No group is ever collected into one row
unless its size is bounded by the domain.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import pointer_ancestors
from gatelens.functions.text import close_tags
from gatelens.operators.ruleset import LEVEL_NAMES, TRUSTED_SYSTEM, TRUSTED_USER, UNTRUSTED

LABEL = ("level", "source_kind", "source_id", "tag")


def joined_level() -> Column:
    return F.coalesce(F.max("level"), F.lit(TRUSTED_USER)).alias("level")


def joined_kinds() -> Column:
    """At most one entry per source kind (eight exist)."""
    return F.array_sort(F.collect_set("source_kind")).alias("kinds")


def joined_tags() -> Column:
    return close_tags(F.collect_set("tag")).alias("tags")


def label_join(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least upper bound per key: greatest level, all kinds, all tags (closed).

    All three aggregates are combined before the shuffle and bounded by their domains, so a key
    with a third of all label rows costs no more than any other.
    """
    return labels.groupBy(*keys).agg(joined_level(), joined_kinds(), joined_tags())


def label_sources(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The source part of the joined label as rows: distinct (key, kind, id)."""
    return (
        labels.where(F.col("source_kind").isNotNull())
        .select(*keys, "source_kind", "source_id")
        .distinct()
    )


def label_leq(a: Column, b: Column) -> Column:
    """Partial order of two label structs: no higher level, no further kinds or tags."""
    return (
        (a["level"] <= b["level"])
        & (F.size(F.array_except(a["kinds"], b["kinds"])) == 0)
        & (F.size(F.array_except(a["tags"], b["tags"])) == 0)
    )


def cover_labels(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """Label rows that reach each leaf: those on the leaf itself or on any ancestor pointer.

    Prefix matching is turned into an equi join on (call, ancestor pointer). Leaves nobody
    labels keep one row with a NULL level.
    """
    opened = leaves.select("call_id", "pointer").withColumn(
        "_at", F.explode(pointer_ancestors("pointer"))
    )
    hits = opened.join(
        labels.withColumnRenamed("pointer", "_at"), ["call_id", "_at"], "inner"
    ).select("call_id", "pointer", *LABEL)
    return leaves.select("call_id", "pointer").join(hits, ["call_id", "pointer"], "left")


def leaf_labels(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """Effective label of every leaf; an uncovered leaf is UNTRUSTED and marked ``missing``."""
    covered = cover_labels(leaves, labels)
    summary = covered.groupBy("call_id", "pointer").agg(
        F.coalesce(F.max("level"), F.lit(UNTRUSTED)).alias("level"),
        joined_kinds(),
        joined_tags(),
        F.max("level").isNull().alias("missing"),
    )
    return summary


def arg_label(effective: DataFrame, path: str) -> DataFrame:
    """Join of the leaf labels under a path; calls without the argument have no row."""
    under = (F.col("pointer") == path) | F.startswith(F.col("pointer"), F.lit(path + "/"))
    return (
        effective.where(under)
        .groupBy("call_id")
        .agg(
            F.max("level").alias("level"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
            close_tags(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        )
    )


def display_labels(labels: DataFrame) -> DataFrame:
    """Text per top-level argument: ``UNTRUSTED_EXTERNAL:<kind>`` or the level name.

    The kind is the first in order that is not the model itself.
    """
    top = F.split("pointer", "/")[1]
    joined = (
        labels.withColumn("arg", F.replace(F.replace(top, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
        .groupBy("call_id", "arg")
        .agg(
            F.max("level").alias("level"),
            F.min(F.when(F.col("source_kind") != "model", F.col("source_kind"))).alias("kind"),
        )
    )
    names = F.array(*[F.lit(n) for n in LEVEL_NAMES])
    shown = F.when(
        F.col("level") == UNTRUSTED,
        F.concat(F.lit("UNTRUSTED_EXTERNAL:"), F.coalesce("kind", F.lit("model"))),
    ).otherwise(F.get(names, F.col("level")))
    return joined.select("call_id", "arg", shown.alias("shown"))


def derive_label(edges: DataFrame, labels: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Label of each derived value: join of its parents' labels and of ``extra`` labels.

    ``edges`` is (child, parent); ``labels`` is a label table keyed by ``parent``, ``extra`` one
    keyed by ``child``.
    """
    inherited = edges.join(labels, "parent").select("child", *LABEL)
    if extra is not None:
        inherited = inherited.unionByName(extra.select("child", *LABEL))
    return label_join(inherited, ["child"])


# fixed values: tool results that are trusted as they come
TRUSTED_RESULTS = (
    "upi.list_payees",
    "upi.get_balance",
    "upi.add_payee",
    "upi.pay_upi",
    "mail.send_email",
)


def label_results(results: DataFrame) -> DataFrame:
    """Add ``level``, ``source_kind``, ``source_id`` to tool results.

    Input columns: ``server``, ``tool``, ``ref`` (document or mail id), ``trust`` (documents),
    ``task_id``. Documents uploaded by the user and customer records are system-trusted, other
    documents and mail are untrusted, and unknown tools count as planner output.
    """
    key = F.concat_ws(".", "server", "tool")
    is_document = key == "files.read_document"
    upload = F.coalesce(F.col("trust") == "user_upload", F.lit(False))
    is_customer = key.isin("crm.read_customer_data", "crm.export_records")
    level = (
        F.when(is_document & upload, TRUSTED_SYSTEM)
        .when(is_document, UNTRUSTED)
        .when(key == "mail.read_inbox", UNTRUSTED)
        .when(is_customer, TRUSTED_SYSTEM)
        .when(key.isin(*TRUSTED_RESULTS), TRUSTED_SYSTEM)
        .otherwise(UNTRUSTED)
    )
    kind = (
        F.when(is_document, "document")
        .when(key == "mail.read_inbox", "email")
        .when(is_customer, "tool_result")
        .when(key.isin(*TRUSTED_RESULTS), "system")
        .otherwise("model")
    )
    source = (
        F.when(is_document | (key == "mail.read_inbox"), F.col("ref"))
        .when(is_customer, F.lit("crm"))
        .when(key.isin(*TRUSTED_RESULTS), key)
        .otherwise(F.col("task_id"))
    )
    return (
        results.withColumn("level", level)
        .withColumn("source_kind", kind)
        .withColumn("source_id", source)
    )
