"""Consent facts: who the data is about, which purposes are covered, what may be shown."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import normalise
from gatelens.functions.text import close_tags, field_tag, pii_tags
from gatelens.operators.provenance import substring_taint
from gatelens.plans.skew import lookup
from gatelens.plans.timeline import stab_min

# fixed values: purpose -> tools that may touch personal data
PURPOSE_TOOLS = {
    "order_support": ("read_customer_data", "send_email"),
    "payment_processing": ("read_customer_data",),
    "payment_reminders": ("read_customer_data", "send_email"),
    "marketing": (),
}
# fixed values: purpose -> record fields that may be shown
PURPOSE_FIELDS = {
    "order_support": ("id", "customer_id", "name", "order_status", "city", "email"),
    "payment_processing": ("id", "customer_id", "name", "pan"),
    "payment_reminders": ("id", "customer_id", "name", "email", "phone"),
    "marketing": ("id", "customer_id", "city"),
}


def _per_purpose(table: Mapping[str, Sequence[str]], purpose: Column) -> Column:
    pairs = [
        x
        for name, values in table.items()
        for x in (F.lit(name), F.array(*[F.lit(v) for v in values]).cast("array<string>"))
    ]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), purpose), F.array().cast("array<string>")
    )


def consent_status(consents: DataFrame, now: Column) -> DataFrame:
    """withdrawn before expired before active."""
    state = (
        F.when(F.col("withdrawn_at").isNotNull(), "withdrawn")
        .when(now >= F.col("exp"), "expired")
        .otherwise("active")
    )
    return consents.select("consent_id", state.alias("status"))


def apply_withdrawals(consents: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Consents with their first withdrawal; requests for unknown ids change nothing."""
    first = withdrawals.groupBy("consent_id").agg(F.min("ts").alias("_w"))
    return (
        consents.join(first, "consent_id", "left")
        .withColumn("withdrawn_at", F.coalesce("withdrawn_at", "_w"))
        .drop("_w")
    )


def consent_epoch(consents: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Number of withdrawal requests for known consents, repeats included."""
    known = lookup(
        withdrawals, consents.select("consent_id").distinct(), ["consent_id"], how="inner"
    )
    return known.agg(F.count("*").alias("epoch"))


def call_subjects(calls: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct (call_id, subject): explicit ids, else customers named in the text, else the
    principal.

    ``calls``: call_id, tool, principal, customer_id, customer_ids, text. ``customers``:
    subject, email, phone, pan, aadhaar. Which identifiers occur in which text is found by the
    blocked substring join, not by testing every customer against every text.
    """
    explicit_one = calls.where("tool = 'read_customer_data' AND customer_id IS NOT NULL").select(
        "call_id", F.col("customer_id").alias("subject")
    )
    explicit_many = calls.where("tool = 'export_records'").select(
        "call_id", F.explode("customer_ids").alias("subject")
    )
    free = calls.where(
        "NOT (tool = 'read_customer_data' AND customer_id IS NOT NULL) AND tool <> 'export_records'"
    )
    known = customers.select(
        "subject",
        F.explode(
            F.array_compact(F.array(*[normalise(c) for c in ("email", "phone", "pan", "aadhaar")]))
        ).alias("text"),
    ).where("text <> ''")
    values = free.select("call_id", F.col("text").alias("value")).where("value IS NOT NULL")
    words = substring_taint(values, known, ["call_id"], tiers=(1, 3, 9))
    named = words.join(known, "text").select("call_id", "subject").distinct()
    rest = free.join(named, "call_id", "left_anti").select(
        "call_id", F.col("principal").cast("string").alias("subject")
    )
    return explicit_one.unionByName(explicit_many).unionByName(named).unionByName(rest).distinct()


def consent_facts(
    calls: DataFrame,
    subjects: DataFrame,
    consents: DataFrame,
    emails: DataFrame,
    *,
    tools: Mapping[str, Sequence[str]] = PURPOSE_TOOLS,
) -> DataFrame:
    """``consent_active`` and ``sink_allowed_for_purpose`` of each call.

    ``calls``: call_id, ts, tool, purpose, to. ``subjects``: call_id, subject. ``consents``:
    principal_id, category, purpose (one row per purpose), exp, withdrawn_at, and granted_at where it
    is known: a consent stored after the call then does not cover it. ``emails``:
    subject, email. Without a purpose both facts are NULL. All subjects must be covered. A consent
    holds up to its expiry or withdrawal; a withdrawal after the call does not undo the call.
    """
    own = emails.groupBy("subject").agg(F.min(normalise("email")).alias("_email"))
    pairs = subjects.join(calls.select("call_id", "ts", "purpose", "to"), "call_id")
    if "granted_at" in consents.columns:
        pairs = pairs.join(_next_end(pairs.distinct(), consents), ["call_id", "subject"])
        good = F.col("_exp").isNotNull()
    else:
        usable = (
            consents.where("category = 'customer_data'")
            .groupBy(F.col("principal_id").cast("string").alias("subject"), "purpose")
            .agg(F.max(F.least("exp", "withdrawn_at")).alias("_last"))
        )
        pairs = lookup(pairs, usable, ["subject", "purpose"])
        good = F.coalesce(F.col("ts") < F.col("_last"), F.lit(False))
    pairs = lookup(pairs, own, ["subject"])
    per_call = pairs.groupBy("call_id").agg(
        F.bool_and(good).alias("_active"),
        F.bool_and(F.coalesce(F.col("_email") == normalise("to"), F.lit(False))).alias("_own"),
    )
    rows = calls.join(per_call, "call_id", "left")
    listed = F.array_contains(_per_purpose(tools, F.col("purpose")), F.col("tool"))
    allowed = (
        listed
        & F.col("_active").isNotNull()
        & ((F.col("tool") != "send_email") | F.coalesce("_own", F.lit(False)))
    )
    known = F.col("purpose").isNotNull()
    active = F.coalesce("_active", F.lit(False))
    return rows.select(
        "call_id",
        F.when(known, active).alias("consent_active"),
        F.when(known, allowed).alias("sink_allowed_for_purpose"),
    )


def _next_end(pairs: DataFrame, consents: DataFrame) -> DataFrame:
    """``call_id, subject, _exp``: the earliest expiry among the consents that hold at the call.

    A consent holds from ``granted_at``, where that is a column, to its expiry or withdrawal. What is
    withdrawn later still holds, and its stored expiry counts.
    """
    start = F.col("granted_at") if "granted_at" in consents.columns else F.lit(None).cast("timestamp")
    held = consents.where("category = 'customer_data'").select(
        F.col("principal_id").cast("string").alias("subject"),
        "purpose",
        start.alias("_from"),
        F.least("exp", "withdrawn_at").alias("_to"),
        "exp",
    )
    return stab_min(
        pairs, held, ["call_id", "subject"], ["subject", "purpose"], "ts", "_from", "_to", "exp", "_exp"
    )


def consent_valid_until(calls: DataFrame, subjects: DataFrame, consents: DataFrame) -> DataFrame:
    """Earliest expiry the consent fact of a call depends on: per subject the next expiry among the
    consents that hold at the call, and the earliest of those.

    Withdrawals count from their own time on. Calls with a subject that nothing covers are left out.
    """
    asked = calls.where("purpose IS NOT NULL").select("call_id", "ts", "purpose")
    pairs = subjects.select("call_id", "subject").distinct().join(asked, "call_id")
    return (
        _next_end(pairs, consents)
        .groupBy("call_id")
        .agg(F.min("_exp").alias("valid_until"), F.bool_and(F.col("_exp").isNotNull()).alias("_all"))
        .where("_all")
        .select("call_id", "valid_until")
    )


def consent_covers(calls: DataFrame, consents: DataFrame, purpose: str) -> DataFrame:
    """Fact for the rule predicate: one active consent covers all requested fields.

    ``calls``: call_id, ts, principal, wanted (array, NULL when not a list of texts).
    ``consents``: principal, purpose, status, granted_at, withdrawn_at, fields (array).
    """
    offered = consents.where((F.col("purpose") == purpose) & (F.col("status") == "active")).select(
        "principal", "granted_at", "withdrawn_at", "fields"
    )
    hits = calls.where("wanted IS NOT NULL").join(
        offered.withColumnRenamed("principal", "_p"),
        (F.col("principal") == F.col("_p"))
        & (F.col("granted_at") <= F.col("ts"))
        & (F.col("withdrawn_at").isNull() | (F.col("withdrawn_at") > F.col("ts")))
        & (F.size(F.array_except("wanted", "fields")) == 0),
        "left_semi",
    )
    flagged = hits.select("call_id", F.lit(True).alias("_hit"))
    return calls.join(flagged, "call_id", "left").select(
        "call_id",
        F.when(F.col("wanted").isNotNull(), F.coalesce("_hit", F.lit(False))).alias(
            "consent_covers"
        ),
    )


def minimise(
    purpose: Column, record: Column, fields: Mapping[str, Sequence[str]] = PURPOSE_FIELDS
) -> Column:
    """Struct(kept, removed) of a record (map): allowed fields stay, the rest is named."""
    allowed = _per_purpose(fields, purpose)
    kept = F.map_filter(record, lambda k, v: F.array_contains(allowed, k))
    removed = F.array_sort(F.array_except(F.map_keys(record), allowed))
    return F.struct(kept.alias("kept"), removed.alias("removed"))


def response_tags(record: Column) -> Column:
    """Tags of a record (map of texts): from its values, its keys and its field names.

    A field name says nothing while its value is empty.
    """
    texts = F.concat_ws(" \n ", F.map_keys(record), F.map_values(record))
    filled = F.map_filter(record, lambda k, v: v.isNotNull() & (v != ""))
    named = F.array_compact(F.transform(F.map_keys(filled), field_tag))
    return close_tags(F.array_union(pii_tags(texts), named))
