"""Approvals, their life cycle, and tool tokens."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.operators.ruleset import ALLOW, DENY, STEP_UP
from gatelens.plans.skew import lookup, oldest_per_key
from gatelens.plans.timeline import stab_count

TTL_SECONDS = 120


def approval_check(calls: DataFrame, approvals: DataFrame) -> DataFrame:
    """``approval_valid`` and ``approval_binding_mismatch`` of each call.

    ``calls``: call_id, ts, task_id, tool, digest. ``approvals``: task_id, tool, digest,
    issued_at, expires_at, status, consumed_ts, sig_ok. An approved token is live from its issue
    up to its expiry or its use (both exclusive); a use after the call does not undo the call. Both questions are answered by
    counting live intervals at the time of the call, so a busy task never pairs all its calls
    with all its approvals.
    """
    usable = approvals.where("status = 'approved'").withColumn(
        "_end", F.least("expires_at", "consumed_ts")
    )
    points = calls.select("call_id", "ts", "task_id", "tool", "digest")
    live = stab_count(
        points, usable, ["task_id", "tool"], "ts", "issued_at", "_end", "live"
    )
    exact = stab_count(
        live,
        usable.where("sig_ok"),
        ["task_id", "tool", "digest"],
        "ts",
        "issued_at",
        "_end",
        "exact",
    )
    valid = F.col("exact") > 0
    return exact.select(
        "call_id",
        valid.alias("approval_valid"),
        (~valid & (F.col("live") > 0)).alias("approval_binding_mismatch"),
    )


def approval_present(calls: DataFrame, approvals: DataFrame) -> DataFrame:
    """Fact for the rule predicate: a live token with the call's tool as scope and its digest."""
    counted = stab_count(
        calls.select("call_id", "ts", "tool", "digest"),
        approvals,
        ["tool", "digest"],
        "ts",
        "issued_at",
        "expires_at",
        "n",
    )
    return counted.select("call_id", (F.col("n") > 0).alias("approval_present"))


def approval_lifecycle(approvals: DataFrame, now: Column, *, ttl: int = TTL_SECONDS) -> DataFrame:
    """``state`` of each approval at ``now``; decisions by voice or by nobody are refused.

    ``approvals``: approval_id, status (requested decision), approver, decided_ts, consumed_ts.
    """
    refused = (F.col("status") != "pending") & (
        F.coalesce(F.col("approver") == "", F.lit(True))
        | F.startswith(F.lower("approver"), F.lit("voice"))
    )
    expiry = F.col("decided_ts") + F.make_dt_interval(secs=F.lit(float(ttl)).cast("decimal(18,6)"))
    state = (
        F.when((F.col("status") == "pending") | refused, "pending")
        .when(F.col("status") == "rejected", "rejected")
        .when(F.col("consumed_ts").isNotNull(), "consumed")
        .when(now >= expiry, "expired")
        .otherwise("approved")
    )
    return approvals.select(
        "approval_id", state.alias("state"), F.coalesce(refused, F.lit(False)).alias("refused")
    )


def approval_gate(verdicts: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests to open, and verdicts with their approval.

    ``verdicts``: call_id, ts, task_id, tool, digest, decision, token_id (NULL without a valid
    token). ``pending``: approval_id, task_id, tool, digest. A STEP_UP reuses the pending
    approval of the same call, or opens one (the first such call names it). An ALLOW with a
    token consumes it once, in time order; later uses are refused as replays.
    """
    key = ["digest", "task_id", "tool"]
    open_now = pending.groupBy(*key).agg(F.min("approval_id").alias("pending_id"))
    raised = verdicts.where(F.col("decision") == STEP_UP)
    firsts = oldest_per_key(raised.select(*key, "ts", "call_id"), key, ["ts", "call_id"])
    requests = firsts.join(open_now, key, "left_anti").select(
        F.concat(F.lit("apr_"), F.col("call_id").cast("string")).alias("approval_id"), *key
    )
    every = open_now.unionByName(requests.select(*key, F.col("approval_id").alias("pending_id")))
    users = verdicts.where((F.col("decision") == ALLOW) & F.col("token_id").isNotNull())
    winner = oldest_per_key(
        users.select("token_id", "ts", F.col("call_id").alias("winner")),
        ["token_id"],
        ["ts", "winner"],
    ).select("token_id", "winner")
    rows = lookup(lookup(verdicts, every, key), winner, ["token_id"])
    uses = (F.col("decision") == ALLOW) & F.col("token_id").isNotNull()
    replay = uses & (F.col("winner") != F.col("call_id"))
    decided = rows.select(
        "call_id",
        F.when(replay, DENY).otherwise(F.col("decision")).alias("decision"),
        F.when(F.col("decision") == STEP_UP, F.col("pending_id"))
        .when(uses & ~replay, F.col("token_id"))
        .alias("approval"),
        F.when(replay, "CORE.APPROVAL.REPLAY").alias("rule_id"),
    )
    return requests, decided


def approval_queue(approvals: DataFrame) -> DataFrame:
    """Pending first, then by creation and id."""
    return approvals.orderBy(
        (F.col("status") == "pending").desc(), F.col("created_ts").asc(), F.col("approval_id").asc()
    )


# ---------------------------------------------------------------- tool tokens
TOKEN_TTL_MS = 30_000
MAX_SKEW_MS = 5_000


def tool_token_check(tokens: DataFrame) -> DataFrame:
    """``ok`` and the first ``reason`` against each presented token.

    ``tokens``: call_id, now_ms, nonce, key_ok, aud, tool, iat, exp, args_sha256 and the call's
    own server, call_tool, digest. Checks run in a fixed order; only tokens that pass all of
    them consume their nonce, and the first one to do so wins it.
    """
    reason = (
        F.when(~F.coalesce("key_ok", F.lit(False)), "bad signature")
        .when(F.col("aud") != F.col("server"), "audience mismatch")
        .when(F.col("tool") != F.col("call_tool"), "tool mismatch")
        .when(F.col("args_sha256") != F.col("digest"), "arguments mismatch")
        .when(
            (F.col("exp") - F.col("iat") > TOKEN_TTL_MS) | (F.col("exp") <= F.col("iat")),
            "invalid lifetime",
        )
        .when(F.col("now_ms") > F.col("exp"), "token expired")
        .when(F.col("iat") > F.col("now_ms") + MAX_SKEW_MS, "token issued in the future")
    )
    checked = tokens.withColumn("reason", reason)
    owner = oldest_per_key(
        checked.where("reason IS NULL").select("nonce", "now_ms", F.col("call_id").alias("owner")),
        ["nonce"],
        ["now_ms", "owner"],
    ).select("nonce", "owner")
    rows = lookup(checked, owner, ["nonce"])
    final = F.coalesce(
        "reason", F.when(F.col("owner") != F.col("call_id"), "token already used")
    )
    return rows.withColumn("reason", final).select(
        "call_id", F.col("reason").isNull().alias("ok"), "reason"
    )
