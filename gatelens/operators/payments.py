"""Payment facts: mandates, caps, running spend, ledgers and amount anomalies."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import key_purpose, rupees_text
from gatelens.operators.ruleset import STEP_UP
from gatelens.plans.history import prefix_spread
from gatelens.plans.skew import lookup, newest_per_key, oldest_per_key
from gatelens.plans.timeline import as_of, running_total, running_totals
from gatelens.session import durable, stored

FACTS = (
    "mandate_sig_valid",
    "mandate_time_valid",
    "mandate_nonce_fresh",
    "payee_in_mandate",
    "amount_within_payee_cap",
    "amount_within_per_txn_cap",
    "amount_within_daily_cap",
    "category_matches",
)


def latest_mandate(mandates: DataFrame) -> DataFrame:
    """Newest stored mandate of each principal."""
    return newest_per_key(mandates, ["principal"], ["stored_order"])


def mandate_as_of(calls: DataFrame, mandates: DataFrame) -> DataFrame:
    """Each call with the mandate that was newest in the store when the call came."""
    payload = [c for c in mandates.columns if c not in ("principal", "stored_at")]
    return as_of(
        calls,
        mandates,
        ["principal"],
        "ts",
        "stored_at",
        payload,
        ties=["stored_order"],
        fine=86_400,
    )


def nonce_owners(mandates: DataFrame) -> DataFrame:
    """The first mandate that used a nonce owns it, whatever is stored later."""
    first = oldest_per_key(
        mandates.select("nonce", "mandate_id", "stored_order"), ["nonce"], ["stored_order"]
    )
    return first.select("nonce", F.col("mandate_id").alias("owner"))


def time_valid(now: Column) -> Column:
    """``nbf <= now < exp``."""
    return (F.col("nbf") <= now) & (now < F.col("exp"))


def spend_before(
    calls: DataFrame, ledger: DataFrame, *, id_column: str = "call_id", fine: int = 60
) -> DataFrame:
    """``id``, ``spent`` on the same UTC day by the principal before each call.

    The running sum is cut into minutes, so the widest task is one principal's minute. A posted
    payment counts for calls after it: by time, then by id, and never for its own call.
    """
    posted = ledger.select(
        "principal",
        F.to_date("ts").alias("day"),
        "ts",
        F.col("txn_id").cast("string").alias("_id"),
        F.lit(1).alias("_kind"),
        F.col("amount_paise").alias("_amount"),
    )
    probes = calls.select(
        "principal",
        F.to_date("ts").alias("day"),
        "ts",
        F.col(id_column).cast("string").alias("_id"),
        F.lit(0).alias("_kind"),
        F.lit(0).cast("long").alias("_amount"),
    )
    order = ["_length", "_id", "_kind"]
    both = posted.unionByName(probes).withColumn("_length", F.length("_id"))
    totals = running_total(
        both, ["principal", "day"], "ts", order, F.col("_amount"), "spent", fine=fine
    )
    return totals.where("_kind = 0").select(F.col("_id").alias("id"), "spent")


def payment_facts(
    calls: DataFrame,
    mandates: DataFrame,
    payees: DataFrame,
    ledger: DataFrame,
) -> DataFrame:
    """The eight mandate facts of each payment call; NULL where they cannot be determined.

    ``calls``: call_id, ts, principal, payee_vpa, amount_paise, task_category,
    declared_category. ``mandates``: principal, mandate_id, nonce, stored_order, stored_at,
    per_txn_cap, daily_cap, category (one or an array of them), nbf, exp, key_id, sig_ok and
    optionally ``parsed``. ``payees``: mandate_id, vpa, cap. A call is judged by the mandate that
    was the newest when it came and by that mandate's own payees; what is stored later changes
    nothing. Without a mandate every fact is NULL; a mandate that cannot be read only fails the
    signature fact. The signature verdict arrives as a column; the purpose of the key is checked
    here.
    """
    stored = mandates
    if "parsed" not in stored.columns:
        stored = stored.withColumn("parsed", F.lit(True))
    categories = F.col("category")
    if stored.schema["category"].dataType.typeName() != "array":
        categories = F.array("category")
    fresh = F.coalesce(F.col("owner") == F.col("mandate_id"), F.lit(False))
    signed = F.coalesce(F.col("sig_ok") & (key_purpose("key_id") == "mandate-signer"), F.lit(False))
    history = stored.join(nonce_owners(mandates), "nonce", "left").select(
        "principal",
        "stored_at",
        "stored_order",
        F.struct(
            "mandate_id", "per_txn_cap", "daily_cap", categories.alias("categories"),
            "nbf", "exp", "parsed", fresh.alias("fresh"), signed.alias("signed"),
        ).alias("m"),
    )
    caps = payees.groupBy("mandate_id", "vpa").agg(F.min("cap").alias("payee_cap")).select(
        F.col("mandate_id").alias("_mandate"), F.col("vpa").alias("payee_vpa"), "payee_cap"
    )
    spent = spend_before(calls, ledger).select(F.col("id").alias("_id"), "spent")
    rows = mandate_as_of(calls, history).withColumn("_mandate", F.col("m.mandate_id"))
    rows = lookup(rows, caps, ["_mandate", "payee_vpa"])
    rows = rows.withColumn("_id", F.col("call_id").cast("string")).join(spent, "_id", "left")
    readable = F.col("m").isNotNull() & F.col("m.parsed")
    amount = F.when(F.col("amount_paise") > 0, F.col("amount_paise"))
    declared = F.col("declared_category")
    facts = {
        "mandate_sig_valid": F.when(F.col("m").isNotNull(), F.col("m.parsed") & F.col("m.signed")),
        "mandate_time_valid": F.when(
            readable, (F.col("m.nbf") <= F.col("ts")) & (F.col("ts") < F.col("m.exp"))
        ),
        "mandate_nonce_fresh": F.when(readable, F.col("m.fresh")),
        "payee_in_mandate": F.when(
            readable & F.col("payee_vpa").isNotNull(), F.col("payee_cap").isNotNull()
        ),
        "amount_within_payee_cap": F.when(
            readable & F.col("payee_vpa").isNotNull() & amount.isNotNull(),
            F.coalesce(amount <= F.col("payee_cap"), F.lit(False)),
        ),
        "amount_within_per_txn_cap": F.when(readable, amount <= F.col("m.per_txn_cap")),
        "amount_within_daily_cap": F.when(
            readable, F.coalesce("spent", F.lit(0)) + amount <= F.col("m.daily_cap")
        ),
        "category_matches": F.when(
            readable,
            F.coalesce(F.array_contains("m.categories", F.col("task_category")), F.lit(False))
            & F.coalesce(declared == "PAYMENT", F.lit(True)),
        ),
    }
    return rows.select("call_id", *[column.alias(name) for name, column in facts.items()])


def mandate_status(
    mandates: DataFrame, payees: DataFrame, ledger: DataFrame, now: Column
) -> DataFrame:
    """State of each stored mandate, what its principal used today and ever, payee names."""
    used = ledger.groupBy("principal").agg(
        F.sum(
            F.when(F.to_date("ts") == F.to_date(now), F.col("amount_paise")).otherwise(0)
        ).alias("used_today"),
        F.count("*").alias("uses"),
    )
    # a mandate lists its own payees: their number is bounded by the mandate document
    names = payees.groupBy("mandate_id").agg(
        F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("payee_names")
    )
    owned = mandates.join(nonce_owners(mandates), "nonce", "left")
    state = (
        F.when(
            ~F.coalesce(F.col("sig_ok") & (F.col("owner") == F.col("mandate_id")), F.lit(False)),
            "invalid",
        )
        .when(now < F.col("nbf"), "not_yet_valid")
        .when(now >= F.col("exp"), "expired")
        .otherwise("valid")
    )
    return (
        owned.withColumn("state", state)
        .join(used, "principal", "left")
        .join(names, "mandate_id", "left")
        .select(
            "mandate_id",
            "principal",
            "state",
            F.coalesce("used_today", F.lit(0)).cast("long").alias("used_today"),
            F.coalesce("uses", F.lit(0)).cast("long").alias("uses"),
            F.coalesce("payee_names", F.lit("")).alias("payee_names"),
        )
    )


# ---------------------------------------------------------------- accounts and ledger


def preview_payments(calls: DataFrame, accounts: DataFrame) -> DataFrame:
    """What a payment would do, without doing it: ``refusal`` or ``summary`` and new balance."""
    rows = lookup(calls, accounts.select("principal", "balance_paise"), ["principal"])
    amount, vpa = F.col("amount_paise"), F.col("payee_vpa")
    refusal = (
        F.when(
            F.coalesce(amount <= 0, F.lit(True)),
            "amount must be a positive integer number of paise",
        )
        .when(F.coalesce(F.trim(vpa) == "", F.lit(True)), "payee_vpa must not be empty")
        .when(F.col("balance_paise").isNull(), "no account for principal")
        .when(F.col("balance_paise") < amount, "insufficient funds")
    )
    summary = F.concat(F.lit("Pay INR "), rupees_text(amount), F.lit(" to "), vpa)
    return rows.withColumn("refusal", refusal).select(
        "call_id",
        "refusal",
        F.when(F.col("refusal").isNull(), summary).alias("summary"),
        F.when(F.col("refusal").isNull(), F.col("balance_paise") - amount).alias("balance_after"),
    )


def check_ledger_balance(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ledger rows whose ``balance_after`` is not the opening balance less all spend so far."""
    posted = ledger.select("txn_id", "principal", "ts", "amount_paise", "balance_after")
    running = running_total(
        posted, ["principal"], "ts", ["txn_id"], F.col("amount_paise"), "_spent", fine=86_400,
        coarse=86_400 * 365,
    )
    rows = lookup(running, accounts.select("principal", "opening"), ["principal"])
    expected = F.col("opening") - F.col("_spent") - F.col("amount_paise")
    return (
        rows.withColumn("expected", expected)
        .where(F.col("expected").isNull() | (F.col("expected") != F.col("balance_after")))
        .select("txn_id", "principal", "balance_after", "expected")
    )


def execution_delta(
    ledger: DataFrame, accounts: DataFrame, *, keep: Sequence[str] = ()
) -> DataFrame:
    """Balance and row count of the principal before and after each executed payment.

    Columns of the ledger named in ``keep`` stay beside them, so that rows need not be joined again.
    """
    own = ["txn_id", "principal", "ts", "amount_paise"]
    # read for the rows and for the sums of buckets
    posted = stored(ledger.select(*own, *[c for c in keep if c not in own]), "ledger")
    sums = {"_spent": F.col("amount_paise"), "rows_before": F.lit(1)}
    counted = running_totals(posted, ["principal"], "ts", ["txn_id"], sums)
    rows = lookup(counted, accounts.select("principal", "opening"), ["principal"])
    before = F.col("opening") - F.col("_spent")
    return rows.select(
        "txn_id",
        *[c for c in keep if c != "txn_id"],
        before.alias("balance_before"),
        (before - F.col("amount_paise")).alias("balance_after"),
        "rows_before",
        (F.col("rows_before") + 1).alias("rows_after"),
    )


# ---------------------------------------------------------------- anomaly
MIN_SAMPLES = 5
MAD_SCALE = 1.4826
Z_LIMIT = 3.5


PAIR = ["principal", "payee_vpa"]


def _placed(calls: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger rows with their place ``pos`` in the history of their (principal, payee), and calls with
    the size ``n`` and sum ``total`` of the history before them.

    Running count and sum by time bucket; a row posted at the very instant of a call comes after it.
    """
    posted = ledger.select(
        *PAIR, "ts", F.lit(None).cast("string").alias("_id"), F.lit(1).alias("_n"), F.col("amount_paise").alias("_a")
    )
    probes = calls.select(
        *PAIR, "ts", F.col("call_id").cast("string").alias("_id"), F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_a")
    )
    order = ["_n", "_id", "_a"]
    counted = running_total(posted.unionByName(probes), PAIR, "ts", order, F.col("_n"), "n", fine=86_400, coarse=86_400 * 365)
    counted = durable(counted)  # both parts are read more than once
    rows = counted.where("_n = 1").select(*PAIR, "ts", F.col("n").alias("pos"), F.col("_a").alias("x"))
    return rows, counted


def payee_history(calls: DataFrame, ledger: DataFrame, *, amounts: int = 100) -> DataFrame:
    """``call_id, n, total, amounts``: the history of each call's (principal, payee), before the call.

    ``amounts`` are the past amounts in ascending order where there are ``amounts`` of them at most,
    else NULL: a long history is never attached to a call. Size and sum cover any history.
    """
    rows, counted = _placed(calls, ledger)
    summed = running_total(counted, PAIR, "ts", ["_n", "_id", "_a"], F.col("_a"), "total", fine=86_400, coarse=86_400 * 365)
    asked = durable(summed.where("_n = 0").select(*PAIR, F.col("_id").alias("call_id"), "n", "total"))
    # histories of so few rows are the same for all calls that see as many rows of a pair
    states = asked.where(F.col("n").between(1, amounts)).select(*PAIR, "n").distinct()
    first = rows.where(F.col("pos") < amounts).select(*PAIR, "pos", "x")
    seen = (
        first.groupBy(*PAIR)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("_first"))
        .join(states, PAIR)
        .select(*PAIR, "n", F.array_sort(F.slice("_first", F.lit(1), F.col("n").cast("int"))).alias("amounts"))
    )
    none = F.array().cast("array<bigint>")
    return asked.join(seen, [*PAIR, "n"], "left").select(
        "call_id", "n", "total", F.when(F.col("n") == 0, none).otherwise(F.col("amounts")).alias("amounts")
    )


def history_profile(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """``call_id, n, median, mad``: exact median and median absolute deviation of the amounts that were
    posted to the call's pair before the call; NULL with fewer than ``MIN_SAMPLES``.

    Calls that see the same rows share one answer, so no pair is answered more often than it has rows.
    """
    rows, counted = _placed(calls, ledger)
    asked = counted.where("_n = 0").select(*PAIR, F.col("_id").alias("call_id"), "n")
    found = prefix_spread(rows.select(*PAIR, "pos", "x"), asked.where(F.col("n") >= MIN_SAMPLES), PAIR)
    return asked.join(found, [*PAIR, "n"], "left").select("call_id", "n", "median", "mad")


def robust_z(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """``call_id, z, decision`` of each amount against the history of its pair before the call.

    What is posted at the time of the call or later changes nothing. A history without spread gives 0
    for its own amount and infinity for any other.
    """
    rows = calls.select(F.col("call_id").cast("string").alias("call_id"), "amount_paise").join(
        history_profile(calls, ledger), "call_id"
    )
    gap = F.abs(F.col("amount_paise") - F.col("median"))
    z = F.when(
        F.col("n") >= MIN_SAMPLES,
        F.when(
            F.col("mad") == 0, F.when(gap == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
        ).otherwise(gap / (MAD_SCALE * F.col("mad"))),
    )
    return rows.withColumn("z", z).select(
        "call_id", "z", F.when(F.col("z") > Z_LIMIT, STEP_UP).alias("decision")
    )


# ---------------------------------------------------------------- transfers in agent suites


def authorised_payees(
    prompts: DataFrame, transactions: DataFrame, *, iban: str = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
) -> DataFrame:
    """Distinct (user, payee) already authorised: both sides of past transactions and account
    numbers in the prompt, without the user's own account and the alias "me"."""
    sides = transactions.select(
        "user", "own", F.explode(F.array("recipient", "sender")).alias("payee")
    )
    named = prompts.select(
        "user", "own", F.explode(F.regexp_extract_all("prompt", F.lit(iban), 0)).alias("payee")
    )
    return (
        sides.unionByName(named)
        .where("payee <> '' AND payee <> 'me'")
        .where(F.col("own").isNull() | (F.col("payee") != F.col("own")))
        .select("user", "payee")
        .distinct()
    )


# fixed values: tools of the suite that move money
GUARDED_TRANSFERS = ("send_money", "schedule_transaction", "update_scheduled_transaction")


def guard_transfers(calls: DataFrame, payees: DataFrame) -> DataFrame:
    """Pre-checks and authorisation of transfers: ``allowed`` and ``detail``.

    ``calls``: call_id, user, tool, recipient, amount (text). ``payees``: user, payee.
    """
    known = payees.select("user", F.col("payee").alias("recipient"), F.lit(True).alias("_ok"))
    rows = lookup(calls, known, ["user", "recipient"])
    paise = F.when(F.col("amount").isNull(), F.lit(1)).otherwise(
        F.bround(F.col("amount").try_cast("double") * 100, 0).cast("long")
    )
    unnamed = F.coalesce(F.col("recipient") == "", F.lit(True))
    unchanged = (F.col("tool") == "update_scheduled_transaction") & F.col("recipient").isNull()
    detail = (
        F.when(~F.col("tool").isin(*GUARDED_TRANSFERS) | unchanged, "ALLOW")
        .when(unnamed, "DENY: missing recipient (adapter pre-check)")
        .when(paise.isNull(), "DENY: unparseable amount (adapter pre-check)")
        .when(paise <= 0, "DENY: non-positive amount (adapter pre-check)")
        .when(F.coalesce("_ok", F.lit(False)), "ALLOW")
        .otherwise("DENY")
    )
    return rows.withColumn("detail", detail).select(
        "call_id", (F.col("detail") == "ALLOW").alias("allowed"), "detail"
    )


# ---------------------------------------------------------------- switches


def mode_at(calls: DataFrame, controls: DataFrame) -> DataFrame:
    """Guard mode and classifier switch in force at each call; unset or unreadable means on.

    ``controls``: key (mode or ml_enabled), value, ts.
    """
    out = calls
    for key, name in (("mode", "mode"), ("ml_enabled", "ml")):
        history = controls.where(F.col("key") == key).select(
            F.lit(0).alias("_all"), F.col("ts").alias("_cts"), F.col("value").alias(f"_{name}")
        )
        out = as_of(
            out.withColumn("_all", F.lit(0)),
            history,
            ["_all"],
            "ts",
            "_cts",
            [f"_{name}"],
            fine=60,
        ).drop("_all")
    return out.select(
        *calls.columns,
        F.when(F.col("_mode") == "off", "off").otherwise("on").alias("mode"),
        F.coalesce(F.col("_ml") != "0", F.lit(True)).alias("ml_on"),
    )


def mandate_covers(calls: DataFrame, offers: DataFrame) -> DataFrame:
    """Fact for the rule predicate: some mandate allows this payee and amount at this time.

    ``offers``: principal, payee_vpa, cap, nbf, exp (end inclusive). UNKNOWN without an integer
    amount and a payee. The semi join stops at the first match and emits no pairs.
    """
    terms = offers.select(
        F.col("principal").alias("_p"), F.col("payee_vpa").alias("_v"), "cap", "nbf", "exp"
    ).distinct()
    hits = calls.join(
        terms,
        (F.col("principal") == F.col("_p"))
        & (F.col("payee_vpa") == F.col("_v"))
        & (F.col("amount_paise") <= F.col("cap"))
        & F.col("ts").between(F.col("nbf"), F.col("exp")),
        "left_semi",
    ).select("call_id", F.lit(True).alias("_hit"))
    asked = F.col("amount_paise").isNotNull() & F.col("payee_vpa").isNotNull()
    return calls.join(hits, "call_id", "left").select(
        "call_id", F.when(asked, F.coalesce("_hit", F.lit(False))).alias("mandate_covers")
    )
