"""Queries for mandate, consent, approval and ledger facts."""

from pyspark.sql import functions as F

from gatelens.operators import approvals as ap
from gatelens.operators import consents as cs
from gatelens.operators import payments as pay
from gatelens.registry.base import query

PAYS = """
SELECT call_id, ts, principal, CASE WHEN call_id % 59 = 0 THEN NULL ELSE payee_vpa END AS payee_vpa, CASE WHEN call_id % 61 = 0 THEN NULL WHEN call_id % 67 = 0 THEN -5 ELSE amount_paise END AS amount_paise,
  CASE WHEN call_id % 12 = 0 THEN 'READ' ELSE 'PAYMENT' END AS task_category, declared_category FROM v_calls WHERE tool = 'pay_upi'
"""
# the mandate that was the newest in the store when the call came
LATEST = (
    "SELECT * FROM (SELECT c.call_id AS for_call, m.*, row_number() OVER (PARTITION BY c.call_id ORDER BY m.stored_at DESC, m.stored_order DESC) AS rn "
    "FROM pays c JOIN v_mandates m ON m.principal = c.principal AND m.stored_at <= c.ts) z WHERE rn = 1"
)
OWNERS = "SELECT nonce, min_by(mandate_id, stored_order) AS owner FROM v_mandates GROUP BY nonce"
SPENT = """
SELECT txn_id AS call_id, coalesce(sum(amount_paise) OVER (PARTITION BY principal, CAST(ts AS DATE) ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM v_payments
"""
FACT_SQL = """
SELECT c.call_id,
  CASE WHEN m.mandate_id IS NOT NULL THEN m.sig_ok AND m.key_id = 'mandate-signer' END AS mandate_sig_valid,
  CASE WHEN m.mandate_id IS NOT NULL THEN m.nbf <= c.ts AND c.ts < m.exp END AS mandate_time_valid,
  CASE WHEN m.mandate_id IS NOT NULL THEN o.owner = m.mandate_id END AS mandate_nonce_fresh,
  CASE WHEN m.mandate_id IS NOT NULL AND c.payee_vpa IS NOT NULL THEN p.cap IS NOT NULL END AS payee_in_mandate,
  CASE WHEN m.mandate_id IS NOT NULL AND c.payee_vpa IS NOT NULL AND c.amount_paise > 0 THEN coalesce(c.amount_paise <= p.cap, false) END AS amount_within_payee_cap,
  CASE WHEN m.mandate_id IS NOT NULL AND c.amount_paise > 0 THEN c.amount_paise <= m.per_txn_cap END AS amount_within_per_txn_cap,
  CASE WHEN m.mandate_id IS NOT NULL AND c.amount_paise > 0 THEN s.spent + c.amount_paise <= m.daily_cap END AS amount_within_daily_cap,
  CASE WHEN m.mandate_id IS NOT NULL THEN c.task_category = m.category AND coalesce(c.declared_category = 'PAYMENT', true) END AS category_matches
FROM pays c LEFT JOIN latest m ON m.for_call = c.call_id LEFT JOIN owners o ON o.nonce = m.nonce
LEFT JOIN v_mandate_payees p ON p.mandate_id = m.mandate_id AND p.vpa = c.payee_vpa LEFT JOIN spent s ON s.call_id = c.call_id
"""
PARTS = {"pays": PAYS, "latest": LATEST, "owners": OWNERS, "spent": SPENT, "facts": FACT_SQL}


def _facts(t):
    return pay.payment_facts(t.sql(PAYS.strip()), t.v_mandates, t.v_mandate_payees, t.v_payments)


@query(
    "fct01_latest_mandate",
    "SELECT c.call_id, m.mandate_id FROM v_calls c ASOF LEFT JOIN v_mandates m ON m.principal = c.principal AND m.stored_at <= c.ts",
)
def latest_mandate(t):
    calls = t.v_calls.select("call_id", "ts", "principal")
    return pay.mandate_as_of(calls, t.v_mandates).select("call_id", "mandate_id")


def _fact(number: int, name: str) -> None:
    @query(f"fct{number:02d}_{name}", f"SELECT call_id, {name} FROM facts", **PARTS)
    def run(t):
        return _facts(t).select("call_id", name)


for _number, _name in (
    (2, "mandate_time_valid"),
    (3, "mandate_nonce_fresh"),
    (4, "payee_in_mandate"),
    (5, "amount_within_payee_cap"),
    (6, "amount_within_per_txn_cap"),
    (7, "amount_within_daily_cap"),
    (8, "category_matches"),
):
    _fact(_number, _name)


@query("fct09_payment_facts", "SELECT * FROM facts", **PARTS)
def payment_facts(t):
    return _facts(t)


CHECK_CALLS = "SELECT call_id, ts + INTERVAL 30 SECOND AS ts, task_id, tool, CAST(call_id AS STRING) AS digest FROM v_calls"
CHECK_APPROVALS = "SELECT approval_id, task_id, tool, CAST(bound_call_id AS STRING) AS digest, issued_at, expires_at, status, consumed_ts, sig_ok FROM v_approvals"
CHECKED = """
SELECT c.call_id, bool_or(a.sig_ok AND a.digest = c.digest) IS TRUE AS approval_valid,
  count(a.task_id) > 0 AND bool_or(a.sig_ok AND a.digest = c.digest) IS NOT TRUE AS approval_binding_mismatch
FROM ccalls c LEFT JOIN capps a ON a.task_id = c.task_id AND a.tool = c.tool AND a.status = 'approved' AND (a.consumed_ts IS NULL OR c.ts < a.consumed_ts) AND a.issued_at <= c.ts AND c.ts < a.expires_at
GROUP BY c.call_id
"""


@query("fct10_approval_check", "SELECT * FROM checked", ccalls=CHECK_CALLS, capps=CHECK_APPROVALS, checked=CHECKED)
def approval_check(t):
    return ap.approval_check(t.sql(CHECK_CALLS), t.sql(CHECK_APPROVALS))


@query(
    "prd16_approval_present",
    "SELECT c.call_id, EXISTS (SELECT 1 FROM capps a WHERE a.tool = c.tool AND a.digest = c.digest AND a.issued_at <= c.ts AND c.ts < a.expires_at) AS approval_present FROM ccalls c",
    ccalls=CHECK_CALLS,
    capps=CHECK_APPROVALS,
)
def approval_present(t):
    return ap.approval_present(t.sql(CHECK_CALLS), t.sql(CHECK_APPROVALS))


NOW = "TIMESTAMP '2024-01-15 12:00:00'"


@query(
    "fct11_approval_lifecycle",
    f"SELECT approval_id, CASE WHEN status = 'pending' OR approver = '' OR approver LIKE 'voice%' THEN 'pending' WHEN status = 'rejected' THEN 'rejected' WHEN consumed_ts IS NOT NULL THEN 'consumed' "
    f"WHEN {NOW} >= issued_at + INTERVAL 120 SECOND THEN 'expired' ELSE 'approved' END AS state, status <> 'pending' AND (approver = '' OR approver LIKE 'voice%') AS refused FROM v_approvals",
)
def approval_lifecycle(t):
    return ap.approval_lifecycle(
        t.v_approvals.withColumnRenamed("issued_at", "decided_ts"), F.expr(NOW)
    )


SUBJECT_CALLS = """
SELECT call_id, ts, tool, principal, CASE WHEN tool = 'read_customer_data' THEN CAST(session_id AS STRING) END AS customer_id,
  CASE call_id % 4 WHEN 0 THEN 'order_support' WHEN 1 THEN 'payment_reminders' WHEN 2 THEN 'marketing' END AS purpose,
  CASE WHEN tool = 'send_email' THEN 'c' || CAST(session_id AS STRING) || '@mail.example' END AS "to", args FROM v_call_args
""".replace('"to"', "dest")
CUSTOMERS = "SELECT CAST(c_custkey AS STRING) AS subject, 'c' || CAST(c_custkey AS STRING) || '@mail.example' AS email, CASE WHEN c_acctbal > 0 THEN '98' || lpad(CAST(c_custkey AS STRING), 8, '0') END AS phone FROM customer"
SUBJECTS = """
SELECT s.call_id, s.customer_id AS subject FROM scalls s WHERE s.tool = 'read_customer_data'
UNION SELECT s.call_id, c.subject FROM scalls s JOIN cust c ON s.tool = 'send_email' AND contains(s.args, c.email)
UNION SELECT s.call_id, CAST(s.principal AS VARCHAR) FROM scalls s WHERE s.tool <> 'read_customer_data' AND NOT (s.tool = 'send_email' AND EXISTS (SELECT 1 FROM cust c WHERE contains(s.args, c.email)))
"""
SUBJECT_PARTS = {"scalls": SUBJECT_CALLS, "cust": CUSTOMERS, "subj": SUBJECTS}


def _subject_calls(t):
    text = F.concat_ws(
        " ",
        *[F.get_json_object("args", f"$.{a}") for a in ("to", "subject", "body", "destination")],
    )
    return (
        t.sql(SUBJECT_CALLS.strip())
        .withColumnRenamed("dest", "to")
        .withColumn("text", F.when(F.col("tool") == "send_email", text))
        .withColumn("customer_ids", F.lit(None).cast("array<string>"))
    )


def _customers(t):
    none = F.lit(None).cast("string")
    return t.sql(CUSTOMERS).withColumn("pan", none).withColumn("aadhaar", none)


@query("fct13_call_subjects", "SELECT call_id, subject FROM subj", **SUBJECT_PARTS)
def call_subjects(t):
    return cs.call_subjects(_subject_calls(t), _customers(t))


CONSENT_FACTS = """
SELECT s.call_id, CASE WHEN s.purpose IS NOT NULL THEN bool_and(EXISTS (SELECT 1 FROM v_consents k WHERE CAST(k.principal_id AS VARCHAR) = j.subject AND k.purpose = s.purpose AND k.category = 'customer_data' AND s.ts < k.exp AND (k.withdrawn_at IS NULL OR s.ts < k.withdrawn_at))) END AS consent_active,
  CASE WHEN s.purpose IS NOT NULL THEN s.purpose <> 'marketing' AND s.tool IN ('read_customer_data', 'send_email') AND (s.tool <> 'send_email' OR bool_and(c.email IS NOT NULL AND c.email = s.dest)) END AS sink_allowed_for_purpose
FROM scalls s JOIN subj j ON j.call_id = s.call_id
LEFT JOIN cust c ON c.subject = j.subject GROUP BY s.call_id, s.purpose, s.tool
"""


def _consent_facts(t):
    calls = _subject_calls(t)
    customers = _customers(t)
    return cs.consent_facts(calls, cs.call_subjects(calls, customers), t.v_consents, customers)


@query("fct12_consent_active", "SELECT call_id, consent_active FROM cf", **SUBJECT_PARTS, cf=CONSENT_FACTS)
def consent_active(t):
    return _consent_facts(t).select("call_id", "consent_active")


@query("fct14_sink_allowed", "SELECT call_id, sink_allowed_for_purpose FROM cf", **SUBJECT_PARTS, cf=CONSENT_FACTS)
def sink_allowed(t):
    return _consent_facts(t).select("call_id", "sink_allowed_for_purpose")


RECORD_FIELDS = ("id", "name", "email", "phone", "city", "pan")
RECORDS = """
SELECT c_custkey AS id, c_name AS name, 'c' || CAST(c_custkey AS STRING) || '@mail.example' AS email, CASE WHEN c_acctbal > 0 THEN '98' || lpad(CAST(c_custkey AS STRING), 8, '0') ELSE '' END AS phone, c_mktsegment AS city,
  CASE WHEN c_nationkey = 3 THEN 'ABCPK' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || 'Z' ELSE '' END AS pan,
  CASE c_nationkey % 5 WHEN 0 THEN 'order_support' WHEN 1 THEN 'payment_processing' WHEN 2 THEN 'payment_reminders' WHEN 3 THEN 'marketing' END AS purpose FROM customer
"""


def _record(*names):
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


@query(
    "fct15_minimise_record",
    "SELECT id, CASE purpose WHEN 'order_support' THEN 'city,email,id,name' WHEN 'payment_processing' THEN 'id,name,pan' WHEN 'payment_reminders' THEN 'email,id,name,phone' WHEN 'marketing' THEN 'city,id' ELSE '' END AS kept, "
    "CASE purpose WHEN 'order_support' THEN 'pan,phone' WHEN 'payment_processing' THEN 'city,email,phone' WHEN 'payment_reminders' THEN 'city,pan' WHEN 'marketing' THEN 'email,name,pan,phone' ELSE 'city,email,id,name,pan,phone' END AS removed FROM rec",
    rec=RECORDS,
)
def minimise_record(t):
    rows = t.sql(RECORDS.strip())
    split = rows.select("id", cs.minimise(F.col("purpose"), _record(*RECORD_FIELDS)).alias("m"))
    return split.select(
        "id",
        F.array_join(F.array_sort(F.map_keys("m.kept")), ",").alias("kept"),
        F.array_join("m.removed", ",").alias("removed"),
    )


# purposes as a caller supplies them
OWN_FIELDS = {"order_support": ("id", "pan"), "marketing": ("city",)}


@query(
    "udf07_purpose_tables",
    "SELECT id, CASE purpose WHEN 'order_support' THEN 'id,pan' WHEN 'marketing' THEN 'city' ELSE '' END AS kept FROM rec",
    rec=RECORDS,
)
def purpose_tables(t):
    kept = cs.minimise(F.col("purpose"), _record(*RECORD_FIELDS), OWN_FIELDS)["kept"]
    return t.sql(RECORDS.strip()).select("id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@query(
    "lbl17_response_tags",
    "SELECT id, 'PII,PII_EMAIL' || CASE WHEN pan <> '' THEN ',PII_PAN' ELSE '' END || CASE WHEN phone <> '' THEN ',PII_PHONE' ELSE '' END AS tags FROM rec",
    rec=RECORDS,
)
def response_tags(t):
    rows = t.sql(RECORDS.strip())
    return rows.select("id", F.array_join(cs.response_tags(_record(*RECORD_FIELDS)), ",").alias("tags"))


@query(
    "fct16_consent_status",
    f"SELECT consent_id, CASE WHEN withdrawn_at IS NOT NULL THEN 'withdrawn' WHEN {NOW} >= exp THEN 'expired' ELSE 'active' END AS status FROM v_consents",
)
def consent_status(t):
    return cs.consent_status(t.v_consents, F.expr(NOW))


WITHDRAWALS = "SELECT 'cn' || CAST(user_id * 3 AS STRING) AS consent_id, ts FROM events WHERE event_type = 'error'"


@query(
    "fct17_apply_withdrawals",
    "SELECT c.consent_id, coalesce(c.withdrawn_at, w.ts) AS withdrawn_at, (SELECT count(*) FROM wd WHERE consent_id IN (SELECT consent_id FROM v_consents)) AS epoch "
    "FROM v_consents c LEFT JOIN (SELECT consent_id, min(ts) AS ts FROM wd GROUP BY consent_id) w ON w.consent_id = c.consent_id",
    wd=WITHDRAWALS,
)
def apply_withdrawals(t):
    consents, withdrawals = t.v_consents, t.sql(WITHDRAWALS)
    epoch = cs.consent_epoch(consents, withdrawals).withColumn("_one", F.lit(1))
    changed = cs.apply_withdrawals(consents, withdrawals).withColumn("_one", F.lit(1))
    return changed.join(epoch, "_one").select("consent_id", "withdrawn_at", "epoch")


@query(
    "fct18_consent_valid_until",
    "SELECT s.call_id, min(x.nexp) AS valid_until FROM scalls s JOIN subj j ON j.call_id = s.call_id LEFT JOIN LATERAL (SELECT min(exp) AS nexp FROM v_consents k WHERE CAST(k.principal_id AS VARCHAR) = j.subject "
    "AND k.purpose = s.purpose AND k.category = 'customer_data' AND (k.withdrawn_at IS NULL OR k.withdrawn_at > s.ts) AND k.exp > s.ts) x ON true WHERE s.purpose IS NOT NULL GROUP BY s.call_id HAVING bool_and(x.nexp IS NOT NULL)",
    **SUBJECT_PARTS,
)
def consent_valid_until(t):
    calls = _subject_calls(t)
    return cs.consent_valid_until(calls, cs.call_subjects(calls, _customers(t)), t.v_consents)


# some consents are stored in the middle of the calls
GRANTED = """
SELECT *, CASE WHEN principal_id % 3 = 0 THEN TIMESTAMP '2024-01-12 10:00:00' ELSE TIMESTAMP '2023-06-01 00:00:00' END AS granted_at FROM v_consents
"""


@query(
    "fct18_consent_when_granted",
    "SELECT s.call_id, CASE WHEN bool_and(x.nexp IS NOT NULL) THEN min(x.nexp) END AS valid_until, bool_and(x.nexp IS NOT NULL) AS consent_active FROM scalls s JOIN subj j ON j.call_id = s.call_id LEFT JOIN LATERAL (SELECT min(exp) AS nexp FROM granted k WHERE CAST(k.principal_id AS VARCHAR) = j.subject "
    "AND k.purpose = s.purpose AND k.category = 'customer_data' AND k.granted_at <= s.ts AND (k.withdrawn_at IS NULL OR k.withdrawn_at > s.ts) AND k.exp > s.ts) x ON true WHERE s.purpose IS NOT NULL GROUP BY s.call_id",
    granted=GRANTED,
    **SUBJECT_PARTS,
)
def consent_when_granted(t):
    calls, granted = _subject_calls(t), t.sql(GRANTED.strip())
    subjects = cs.call_subjects(calls, _customers(t))
    until = cs.consent_valid_until(calls, subjects, granted)
    active = cs.consent_facts(calls, subjects, granted, _customers(t).select("subject", "email"))
    known = active.where("consent_active IS NOT NULL").select("call_id", "consent_active")
    return known.join(until, "call_id", "left").select("call_id", "valid_until", "consent_active")


COVER_CONSENTS = """
SELECT principal_id AS principal, purpose, CASE WHEN exp > TIMESTAMP '2024-02-01 00:00:00' THEN 'active' ELSE 'expired' END AS status, TIMESTAMP '2024-01-05 00:00:00' AS granted_at, withdrawn_at,
  CASE WHEN principal_id % 3 = 0 THEN 'name' ELSE 'email,name,phone' END AS fields FROM v_consents
"""


@query(
    "prd13_consent_covers",
    "SELECT c.call_id, CASE WHEN c.tool = 'read_customer_data' AND json_valid(c.args) THEN EXISTS (SELECT 1 FROM cc k WHERE k.principal = c.session_id AND k.purpose = 'payment_reminders' AND k.status = 'active' AND k.granted_at <= c.ts "
    "AND (k.withdrawn_at IS NULL OR k.withdrawn_at > c.ts) AND (k.fields LIKE '%email%' OR c.call_id % 23 = 8)) END AS consent_covers FROM v_call_args c",
    cc=COVER_CONSENTS,
)
def consent_covers(t):
    wanted = F.from_json(F.get_json_object("args", "$.fields"), "array<string>")
    calls = t.v_call_args.select("call_id", "ts", F.col("session_id").alias("principal"), wanted.alias("wanted"))
    offered = t.sql(COVER_CONSENTS.strip()).withColumn("fields", F.split("fields", ","))
    return cs.consent_covers(calls, offered, "payment_reminders")


@query(
    "prd14_mandate_present",
    "SELECT c.call_id, EXISTS (SELECT 1 FROM v_mandates m WHERE m.principal = c.principal AND m.nbf <= c.ts AND c.ts <= m.exp) AS mandate_present FROM v_calls c",
)
def mandate_present(t):
    from gatelens.plans.timeline import stab_count

    counted = stab_count(
        t.v_calls.select("call_id", "ts", "principal"), t.v_mandates, ["principal"], "ts", "nbf", "exp", "n", closed_end=True
    )
    return counted.select("call_id", (F.col("n") > 0).alias("mandate_present"))


@query(
    "prd15_mandate_covers",
    "SELECT c.call_id, CASE WHEN c.amount_paise IS NOT NULL AND c.payee_vpa IS NOT NULL THEN EXISTS (SELECT 1 FROM v_mandates m JOIN v_mandate_payees p ON p.mandate_id = m.mandate_id "
    "WHERE m.principal = c.principal AND p.vpa = c.payee_vpa AND c.amount_paise <= p.cap AND m.nbf <= c.ts AND c.ts <= m.exp) END AS mandate_covers FROM pays c",
    pays=PAYS,
)
def mandate_covers(t):
    offers = t.v_mandates.join(t.v_mandate_payees.drop("principal"), "mandate_id").select(
        "principal", F.col("vpa").alias("payee_vpa"), "cap", "nbf", "exp"
    )
    return pay.mandate_covers(t.sql(PAYS.strip()), offers)


@query(
    "fct19_mandate_status",
    f"SELECT m.mandate_id, m.principal, CASE WHEN NOT m.sig_ok OR o.owner <> m.mandate_id THEN 'invalid' WHEN {NOW} < m.nbf THEN 'not_yet_valid' WHEN {NOW} >= m.exp THEN 'expired' ELSE 'valid' END AS state, "
    f"CAST(coalesce(u.today, 0) AS BIGINT) AS used_today, coalesce(u.uses, 0) AS uses, coalesce(n.names, '') AS payee_names FROM v_mandates m JOIN owners o ON o.nonce = m.nonce "
    f"LEFT JOIN (SELECT principal, sum(CASE WHEN CAST(ts AS DATE) = CAST({NOW} AS DATE) THEN amount_paise ELSE 0 END) AS today, count(*) AS uses FROM v_payments GROUP BY principal) u ON u.principal = m.principal "
    "LEFT JOIN (SELECT mandate_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM v_mandate_payees GROUP BY mandate_id) n ON n.mandate_id = m.mandate_id",
    owners=OWNERS,
)
def mandate_status(t):
    return pay.mandate_status(t.v_mandates, t.v_mandate_payees, t.v_payments, F.expr(NOW))


ACCOUNTS = "SELECT n_nationkey AS principal, CAST(n_nationkey AS BIGINT) * 900 AS balance_paise, CAST(n_nationkey AS BIGINT) * 1000000 AS opening FROM nation WHERE n_name <> 'NATION_9'"


@query(
    "fct20_preview_payment",
    "SELECT c.call_id, refusal, CASE WHEN refusal IS NULL THEN 'Pay INR ' || (c.amount_paise // 100) || '.' || lpad(CAST(c.amount_paise % 100 AS VARCHAR), 2, '0') || ' to ' || c.payee_vpa END AS summary, "
    "CASE WHEN refusal IS NULL THEN c.balance_paise - c.amount_paise END AS balance_after FROM (SELECT p.*, a.balance_paise, CASE WHEN p.amount_paise IS NULL OR p.amount_paise <= 0 THEN 'amount must be a positive integer number of paise' "
    "WHEN p.payee_vpa IS NULL THEN 'payee_vpa must not be empty' WHEN a.principal IS NULL THEN 'no account for principal' WHEN a.balance_paise < p.amount_paise THEN 'insufficient funds' END AS refusal "
    "FROM pays p LEFT JOIN acc a ON a.principal = p.principal) c",
    pays=PAYS,
    acc=ACCOUNTS,
)
def preview_payment(t):
    return pay.preview_payments(t.sql(PAYS.strip()), t.sql(ACCOUNTS))


UNIQUE_LEDGER = """
SELECT txn_id, min(principal) AS principal, min(payee_vpa) AS payee_vpa, min(ts) AS ts, min(amount_paise) AS amount_paise FROM v_ledger GROUP BY txn_id
"""
RUNNING = "SELECT l.*, a.opening - sum(l.amount_paise) OVER (PARTITION BY l.principal ORDER BY l.ts, l.txn_id) AS expected FROM led l LEFT JOIN acc a ON a.principal = l.principal"


@query(
    "fct21_check_ledger_balance",
    "SELECT txn_id, principal, CAST(coalesce(expected, 0) + CASE WHEN amount_paise % 1000 = 0 THEN 1 ELSE 0 END AS BIGINT) AS balance_after, CAST(expected AS BIGINT) AS expected FROM run WHERE expected IS NULL OR amount_paise % 1000 = 0",
    led=UNIQUE_LEDGER,
    acc=ACCOUNTS,
    run=RUNNING,
)
def check_ledger_balance(t):
    accounts, ledger = t.sql(ACCOUNTS), t.sql(UNIQUE_LEDGER.strip())
    posted = pay.execution_delta(ledger, accounts, keep=["principal", "ts", "amount_paise"])
    shifted = F.coalesce("balance_after", F.lit(0)) + F.when(
        F.col("amount_paise") % 1000 == 0, 1
    ).otherwise(0)
    rows = posted.where("txn_id IS NOT NULL").withColumn("balance_after", shifted.cast("long"))
    return pay.check_ledger_balance(rows, accounts)


# calls within the time of the ledger, some at the very instant of postings
PAY_CALLS = """
SELECT call_id, principal, payee_vpa, amount_paise, CASE WHEN call_id % 4 = 0 THEN date_trunc('day', moment) ELSE moment END AS moment
FROM (SELECT *, ts - INTERVAL 8766 DAY + to_days(CAST(call_id % 3000 AS INT)) AS moment FROM v_calls WHERE tool = 'pay_upi') c
"""
SEEN = "SELECT c.call_id, l.amount_paise AS x FROM pay_calls c JOIN v_ledger l ON l.principal = c.principal AND l.payee_vpa = c.payee_vpa AND l.ts < c.moment"
MIDDLES = "SELECT call_id, median(x) AS med, count(*) AS n FROM seen GROUP BY call_id"
SPREADS = "SELECT s.call_id, med, n, median(abs(x - med)) AS mad FROM seen s JOIN middles m ON m.call_id = s.call_id GROUP BY s.call_id, med, n"


def _pay_calls(t):
    at = F.expr("ts - INTERVAL 8766 DAY + make_dt_interval(CAST(call_id % 3000 AS INT))")
    at = F.when(F.col("call_id") % 4 == 0, F.date_trunc("day", at)).otherwise(at)
    return t.v_calls.where("tool = 'pay_upi'").withColumn("ts", at)


@query(
    "fct22_payee_history",
    "SELECT CAST(c.call_id AS VARCHAR) AS call_id, count(s.x) AS n, CAST(coalesce(sum(s.x), 0) AS BIGINT) AS total, "
    "CASE WHEN count(s.x) = 0 THEN '' WHEN count(s.x) <= 60 THEN string_agg(CAST(s.x AS VARCHAR), ',' ORDER BY s.x) END AS amounts FROM pay_calls c LEFT JOIN seen s ON s.call_id = c.call_id GROUP BY c.call_id",
    pay_calls=PAY_CALLS,
    seen=SEEN,
)
def payee_history(t):
    found = pay.payee_history(_pay_calls(t), t.v_ledger, amounts=60)
    return found.withColumn("amounts", F.array_join(F.col("amounts").cast("array<string>"), ","))


@query(
    "fct23_robust_z",
    "SELECT c.call_id, CASE WHEN h.n >= 5 THEN CASE WHEN h.mad = 0 THEN CASE WHEN c.amount_paise * 900 = h.med THEN 0.0 ELSE CAST('inf' AS DOUBLE) END ELSE abs(c.amount_paise * 900 - h.med) / (1.4826 * h.mad) END END AS z, "
    "CASE WHEN h.n >= 5 AND (h.mad = 0 AND c.amount_paise * 900 <> h.med OR abs(c.amount_paise * 900 - h.med) / (1.4826 * h.mad) > 3.5) THEN 1 END AS decision FROM pay_calls c LEFT JOIN spreads h ON h.call_id = c.call_id",
    pay_calls=PAY_CALLS,
    seen=SEEN,
    middles=MIDDLES,
    spreads=SPREADS,
)
def robust_z(t):
    calls = _pay_calls(t).withColumn("amount_paise", F.col("amount_paise") * 900)
    return pay.robust_z(calls, t.v_ledger).withColumn("call_id", F.col("call_id").cast("long"))


TRANSFERS = """
SELECT event_id AS call_id, user_id AS "user", CASE event_type WHEN 'click' THEN 'send_money' WHEN 'view' THEN 'schedule_transaction' WHEN 'error' THEN 'update_scheduled_transaction' ELSE 'get_balance' END AS tool,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '' ELSE 'DE' || CAST(10 + event_id % 7 AS STRING) || 'ABCDEFGHIJ' END AS recipient,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'ten' WHEN event_id % 31 = 0 THEN '-4' ELSE CAST(value AS STRING) END AS amount FROM events
""".replace('"user"', "usr")
PROMPTS = """
SELECT user_id AS usr, 'DE' || CAST(10 + user_id % 3 AS STRING) || 'ABCDEFGHIJ' AS own, 'Send money to DE' || CAST(10 + user_id % 7 AS STRING) || 'ABCDEFGHIJ and DE' || CAST(10 + event_id % 2 AS STRING) || 'ABCDEFGHIJ please' AS prompt,
  CASE WHEN event_id % 2 = 0 THEN 'me' ELSE 'GB77ABCDEFGHIJ' END AS sender, 'DE' || CAST(10 + user_id % 5 AS STRING) || 'ABCDEFGHIJ' AS recipient FROM events WHERE event_type = 'signup'
"""
AUTHORISED = """
SELECT usr, sender AS payee FROM pr WHERE sender <> own AND sender <> 'me' UNION SELECT usr, recipient FROM pr WHERE recipient <> own
UNION SELECT usr, x FROM (SELECT usr, own, unnest(regexp_extract_all(prompt, 'DE[0-9]{2}[A-Z]{10}')) AS x FROM pr) z WHERE x <> own
"""


def _authorised(t):
    rows = t.sql(PROMPTS.strip()).withColumnRenamed("usr", "user")
    return pay.authorised_payees(rows.select("user", "own", "prompt"), rows)


@query("fct24_authorised_payees", "SELECT usr AS user_id, payee FROM au", pr=PROMPTS, au=AUTHORISED)
def authorised_payees(t):
    return _authorised(t).withColumnRenamed("user", "user_id")


@query(
    "fct25_guard_transfers",
    "SELECT t.call_id, detail = 'ALLOW' AS allowed, detail FROM (SELECT t.*, CASE WHEN t.tool = 'get_balance' OR (t.tool = 'update_scheduled_transaction' AND t.recipient IS NULL) THEN 'ALLOW' "
    "WHEN t.recipient IS NULL OR t.recipient = '' THEN 'DENY: missing recipient (adapter pre-check)' WHEN t.amount IS NOT NULL AND try_cast(t.amount AS DOUBLE) IS NULL THEN 'DENY: unparseable amount (adapter pre-check)' "
    "WHEN round(coalesce(try_cast(t.amount AS DOUBLE), 0.01) * 100) <= 0 THEN 'DENY: non-positive amount (adapter pre-check)' WHEN a.payee IS NOT NULL THEN 'ALLOW' ELSE 'DENY' END AS detail "
    "FROM tr t LEFT JOIN au a ON a.usr = t.usr AND a.payee = t.recipient) t",
    tr=TRANSFERS,
    pr=PROMPTS,
    au=AUTHORISED,
)
def guard_transfers(t):
    calls = t.sql(TRANSFERS.strip()).withColumnRenamed("usr", "user")
    return pay.guard_transfers(calls, _authorised(t))


TOKENS = """
SELECT event_id AS call_id, CAST(event_id AS BIGINT) * 1000 AS now_ms, 'nonce' || CAST(CASE WHEN event_id % 7 = 0 THEN event_id - event_id % 14 ELSE event_id END AS STRING) AS nonce, event_id % 41 <> 0 AS key_ok,
  CASE WHEN event_id % 37 = 0 THEN 'mail' ELSE 'upi' END AS aud, CASE WHEN event_id % 31 = 0 THEN 'list_payees' ELSE 'pay_upi' END AS tool,
  event_id * 1000 + CASE WHEN event_id % 23 = 0 THEN 6000 WHEN event_id % 22 = 0 THEN 5000 ELSE -2000 END AS iat, event_id * 1000 + CASE WHEN event_id % 19 = 0 THEN -1 WHEN event_id % 17 = 0 THEN 40000 WHEN event_id % 16 = 0 THEN 0 ELSE 20000 END AS exp,
  CASE WHEN event_id % 29 = 0 THEN 'x' ELSE 'd' END AS args_sha256, 'upi' AS server, 'pay_upi' AS call_tool, 'd' AS digest FROM events
"""
TOKEN_CHECK = """
SELECT *, CASE WHEN NOT key_ok THEN 'bad signature' WHEN aud <> server THEN 'audience mismatch' WHEN tool <> call_tool THEN 'tool mismatch' WHEN args_sha256 <> digest THEN 'arguments mismatch'
  WHEN exp - iat > 30000 OR exp <= iat THEN 'invalid lifetime' WHEN now_ms > exp THEN 'token expired' WHEN iat > now_ms + 5000 THEN 'token issued in the future' END AS r FROM tok
"""


@query(
    "fct26_tool_token_check",
    "SELECT call_id, r IS NULL AND rn = 1 AS ok, coalesce(r, CASE WHEN rn > 1 THEN 'token already used' END) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY nonce, r IS NULL ORDER BY now_ms, call_id) AS rn FROM chk) z",
    tok=TOKENS,
    chk=TOKEN_CHECK,
)
def tool_token_check(t):
    return ap.tool_token_check(t.sql(TOKENS.strip()))


@query(
    "fct27_execution_delta",
    "SELECT p.txn_id, CAST(a.opening - s AS BIGINT) AS balance_before, CAST(a.opening - s - amount_paise AS BIGINT) AS balance_after, n AS rows_before, n + 1 AS rows_after FROM ("
    "SELECT *, coalesce(sum(amount_paise) OVER w, 0) AS s, count(*) OVER w AS n FROM v_payments WINDOW w AS (PARTITION BY principal ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) p LEFT JOIN acc a ON a.principal = p.principal",
    acc=ACCOUNTS,
)
def execution_delta(t):
    return pay.execution_delta(t.v_payments, t.sql(ACCOUNTS))


CONTROLS = """
SELECT CASE WHEN event_id % 2 = 0 THEN 'mode' ELSE 'ml_enabled' END AS "key", CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'off' WHEN event_id % 3 = 1 THEN 'on' ELSE 'garbled' END
  ELSE CASE WHEN event_id % 5 = 0 THEN '0' ELSE '1' END END AS value, ts FROM events WHERE event_type = 'purchase' AND value > 60
""".replace('"key"', "switch")


@query(
    "fct28_mode_at",
    "SELECT c.call_id, CASE WHEN m.value = 'off' THEN 'off' ELSE 'on' END AS mode, coalesce(l.value <> '0', true) AS ml_on FROM v_calls c "
    "ASOF LEFT JOIN (SELECT * FROM ctl WHERE switch = 'mode') m ON m.ts <= c.ts ASOF LEFT JOIN (SELECT * FROM ctl WHERE switch = 'ml_enabled') l ON l.ts <= c.ts",
    ctl=CONTROLS,
)
def mode_at(t):
    controls = t.sql(CONTROLS.strip()).withColumnRenamed("switch", "key")
    return pay.mode_at(t.v_calls.select("call_id", "ts"), controls).select("call_id", "mode", "ml_on")


GATE = """
SELECT call_id, ts, task_id, tool, 'd' || CAST(session_id AS STRING) || '-' || CAST(amount_paise % 20 AS STRING) AS digest, CASE WHEN call_id % 3 = 0 THEN 1 WHEN call_id % 3 = 1 THEN 0 ELSE 2 END AS decision,
  CASE WHEN call_id % 2 = 0 THEN 'tok' || CAST(session_id AS STRING) || '-' || CAST(call_id % 40 AS STRING) END AS token_id FROM v_calls WHERE tool = 'pay_upi'
"""
PENDING = "SELECT approval_id, task_id, tool, 'd' || substr(task_id, 2) || '-3' AS digest FROM v_approvals WHERE status = 'pending'"


@query(
    "rul19_approval_gate",
    "SELECT g.call_id, CASE WHEN g.decision = 0 AND g.token_id IS NOT NULL AND u.rn > 1 THEN 2 ELSE g.decision END AS decision, "
    "CASE WHEN g.decision = 1 THEN coalesce(p.pid, f.rid) WHEN g.decision = 0 AND u.rn = 1 THEN g.token_id END AS approval, CASE WHEN g.decision = 0 AND u.rn > 1 THEN 'CORE.APPROVAL.REPLAY' END AS rule_id "
    "FROM gate g LEFT JOIN (SELECT task_id, tool, digest, min(approval_id) AS pid FROM pend GROUP BY 1, 2, 3) p ON p.task_id = g.task_id AND p.tool = g.tool AND p.digest = g.digest "
    "LEFT JOIN (SELECT task_id, tool, digest, 'apr_' || min_by(call_id, ts) AS rid FROM gate WHERE decision = 1 GROUP BY 1, 2, 3) f ON f.task_id = g.task_id AND f.tool = g.tool AND f.digest = g.digest "
    "LEFT JOIN (SELECT call_id, row_number() OVER (PARTITION BY token_id ORDER BY ts, call_id) AS rn FROM gate WHERE decision = 0 AND token_id IS NOT NULL) u ON u.call_id = g.call_id",
    gate=GATE,
    pend=PENDING,
)
def approval_gate(t):
    return ap.approval_gate(t.sql(GATE.strip()), t.sql(PENDING))[1]
