"""Queries for invariants over decisions and logs."""

from pyspark.sql import functions as F

from gatelens.operators import evaluate as ev
from gatelens.operators import invariants as iv
from gatelens.registry.base import query
from gatelens.registry.rules import ALL_PARTS, ALL_SQL, DOC, FACTS, RULES, STATUS, facts, reasons_sql, verdicts

DROPPED = ("PAYSHIELD.TAINT.UNTRUSTED_PAYEE", "PAYSHIELD.TAINT.UNTRUSTED_NEW_PAYEE", "PURPOSELOCK.TAINT.UNTRUSTED_RECIPIENT")
WEAK = RULES.without(*DROPPED)
WEAK_SQL = reasons_sql([s for s in ALL_PARTS if not any(f"'{d}'" in s for d in DROPPED)])


def _decided(t, rules):
    decided = verdicts(t, rules).join(facts(t).drop("ml_decision"), "call_id")
    return decided


SINK_LEVEL = (
    "(d.tool = 'pay_upi' AND (coalesce(e.payee, 2) = 2 OR coalesce(e.amount, 2) = 2)) OR (d.tool = 'add_payee' AND coalesce(e.vpa, 2) = 2) OR (d.tool = 'send_email' AND (coalesce(e.dest, 2) = 2 OR coalesce(e.body, 2) = 2))"
)


@query(
    "inv01_untrusted_sink",
    f"SELECT d.call_id, d.tool FROM doc d JOIN verdict v ON v.call_id = d.call_id JOIN lev e ON e.call_id = d.call_id JOIN facts f ON f.call_id = d.call_id WHERE v.decision = 0 AND NOT f.approval_valid AND ({SINK_LEVEL})",
    **WEAK_SQL,
)
def untrusted_sink(t):
    return iv.untrusted_sink(_decided(t, WEAK), t.v_call_labels, RULES)


@query("inv01_untrusted_sink_shipped", "SELECT tool, count(*) AS calls, 0 AS hits FROM v_calls GROUP BY tool")
def untrusted_sink_shipped(t):
    hits = iv.untrusted_sink(_decided(t, RULES), t.v_call_labels, RULES).groupBy("tool").agg(F.count("*").alias("hits"))
    calls = t.v_calls.groupBy("tool").agg(F.count("*").alias("calls"))
    return calls.join(hits, "tool", "left").select("tool", "calls", F.coalesce("hits", F.lit(0)).alias("hits"))


@query(
    "inv02_lowered_decision",
    "SELECT call_id FROM verdict WHERE rule_decision > 0 AND call_id % 50 = 0",
    **ALL_SQL,
)
def lowered(t):
    broken = F.when(F.col("call_id") % 50 == 0, 0).otherwise(F.col("decision"))
    return iv.lowered(verdicts(t).withColumn("decision", broken))


@query(
    "inv03_allowed_after_failure",
    "SELECT call_id FROM verdict WHERE decision = 0 AND call_id IN (SELECT call_id FROM stat WHERE failed)",
    **ALL_SQL,
    stat=STATUS,
)
def allowed_after_failure(t):
    return iv.allowed_after_failure(verdicts(t), t.sql(STATUS.strip()))


NO_CAP = RULES.without("PAYSHIELD.CAP.DAILY", "PAYSHIELD.MANDATE.TIME")
NO_CAP_SQL = reasons_sql([s for s in ALL_PARTS if "PAYSHIELD.CAP.DAILY" not in s and "PAYSHIELD.MANDATE.TIME" not in s])
VALID = (
    "coalesce(f.mandate_sig_valid AND f.mandate_time_valid AND f.mandate_nonce_fresh AND f.payee_in_mandate AND f.category_matches, false) AND (coalesce(f.amount_within_payee_cap AND f.amount_within_per_txn_cap AND f.amount_within_daily_cap, false) OR f.approval_valid)"
)


@query(
    "inv04_unmandated_payment",
    f"SELECT v.call_id FROM verdict v JOIN facts f ON f.call_id = v.call_id WHERE v.tool IN ('pay_upi', 'issue_refund') AND v.decision = 0 AND NOT ({VALID})",
    **NO_CAP_SQL,
)
def unmandated_payment(t):
    return iv.unmandated_payment(_decided(t, NO_CAP))


NO_PII = RULES.without("PURPOSELOCK.EGRESS.PII_WITHOUT_CONSENT")


@query(
    "inv05_unconsented_personal_data",
    "SELECT v.call_id FROM verdict v JOIN facts f ON f.call_id = v.call_id WHERE v.tool = 'send_email' AND v.decision = 0 AND NOT f.consent_active AND EXISTS (SELECT 1 FROM v_call_labels l WHERE l.call_id = v.call_id AND l.tag LIKE 'PII%')",
    **reasons_sql([s for s in ALL_PARTS if "PII_WITHOUT_CONSENT" not in s]),
)
def unconsented(t):
    return iv.unconsented_personal_data(_decided(t, NO_PII), t.v_call_labels)


TOKEN_USES = "SELECT 'tok' || CAST(CASE WHEN event_id % 9 = 0 THEN event_id - 9 ELSE event_id END AS STRING) AS token_id, CAST(CASE WHEN event_id % 7 = 0 THEN event_id + 1 ELSE event_id END AS STRING) AS digest FROM events"
TOKENS = "SELECT 'tok' || CAST(event_id AS STRING) AS token_id, CAST(event_id AS STRING) AS digest FROM events"


@query(
    "inv06_misused_token",
    "SELECT u.token_id, count(*) AS uses, bool_or(u.digest <> k.digest) AS wrong_call FROM tu u JOIN tk k ON k.token_id = u.token_id GROUP BY u.token_id HAVING count(*) > 1 OR bool_or(u.digest <> k.digest)",
    tu=TOKEN_USES,
    tk=TOKENS,
)
def misused_token(t):
    return iv.misused_tokens(t.sql(TOKEN_USES), t.sql(TOKENS))


EXECS = "SELECT event_id AS call_id, event_id * 2 + 1 AS idx FROM events WHERE event_type = 'purchase'"
DECS = "SELECT event_id AS call_id, CASE WHEN user_id = 7 THEN event_id * 2 + 2 ELSE event_id * 2 END AS idx FROM events WHERE user_id <> 9"


@query(
    "inv07_audit_gap",
    "SELECT event_id AS call_id, event_id * 2 + 1 AS idx FROM events WHERE event_type = 'purchase' AND user_id IN (7, 9)",
)
def audit_gap(t):
    return iv.audit_gaps(t.sql(EXECS), t.sql(DECS))


# each payment of the log under all label levels, approvals and signals, its other facts kept
SWEEP_FACTS = FACTS
SWEPT = (
    "SELECT f.call_id, a.lv AS payee, b.lv AS amount, g.lv AS sig, CASE c.lv WHEN 0 THEN true WHEN 1 THEN false END AS approved, f.* EXCLUDE (call_id, approval_valid) FROM facts f JOIN v_calls v ON v.call_id = f.call_id AND v.tool = 'pay_upi', "
    "(SELECT unnest([0, 1, 2]) AS lv) a, (SELECT unnest([0, 1, 2]) AS lv) b, (SELECT unnest([0, 1, 2]) AS lv) c, (SELECT unnest([0, 1, 2]) AS lv) g"
)
ALLOWS = (
    "sig = 0 AND amount < 2 AND coalesce(mandate_sig_valid AND mandate_nonce_fresh AND payee_in_mandate AND category_matches, false) AND mandate_time_valid AND NOT approval_binding_mismatch "
    "AND (coalesce(amount_within_payee_cap, false) OR coalesce(approved, false)) AND (coalesce(amount_within_per_txn_cap, false) OR coalesce(approved, false)) AND (coalesce(amount_within_daily_cap, false) OR coalesce(approved, false))"
)


@query(
    "inv08_policy_sweep",
    f"SELECT call_id, count(*) AS combinations, count(CASE WHEN {ALLOWS} THEN 1 END) AS allowed, count(CASE WHEN {ALLOWS} AND payee = 2 AND NOT coalesce(approved, false) THEN 1 END) AS untrusted_sink, CAST(0 AS BIGINT) AS unmandated FROM sw GROUP BY call_id",
    facts=FACTS,
    sw=SWEPT,
)
def policy_sweep(t):
    weak = RULES.without("PAYSHIELD.TAINT.UNTRUSTED_PAYEE")
    own = [f for f in RULES.facts() if f in facts(t).columns and f != "approval_valid"]
    calls = facts(t).join(t.v_calls.where("tool = 'pay_upi'").select("call_id"), "call_id")
    calls = calls.select("call_id", *[F.col(f).alias(f"fact_{f}") for f in own])
    swept = iv.policy_sweep(calls, weak, "pay_upi", facts=["approval_valid"])
    return swept.groupBy("call_id").agg(
        F.count("*").alias("combinations"),
        F.count_if(F.col("decision") == 0).alias("allowed"),
        F.count_if(F.array_contains("invariants", "untrusted_sink")).alias("untrusted_sink"),
        F.count_if(F.array_contains("invariants", "unmandated_payment")).alias("unmandated"),
    )


# every fact, level, tag, signal and failed stage of every tool of the log, under rules with gaps
GAPS = ("PAYSHIELD.TAINT.UNTRUSTED_PAYEE", "PAYSHIELD.MANDATE.TIME", "PURPOSELOCK.TAINT.UNTRUSTED_EMAIL_CONTENT")
THREE = "SELECT * FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) v(x)"
LEVELS = "SELECT * FROM (VALUES (0), (1), (2)) v(x)"
PAID = (
    "SELECT *, coalesce(sg AND nf AND pm AND cm AND NOT mis, false) AND (pc OR ap) IS TRUE AND (tx OR ap) IS TRUE AND (dy OR ap) IS TRUE AS ok, (sg AND tv AND nf AND pm AND cm AND ((pc AND tx AND dy) OR ap)) IS TRUE AS mandated FROM "
    "(SELECT a.x AS sg, b.x AS tv, c.x AS nf, d.x AS pm, e.x AS cm, f.x AS pc, g.x AS tx, h.x AS dy, i.x AS ap, j.x AS mis FROM three a, three b, three c, three d, three e, three f, three g, three h, three i, three j) z"
)
ROWS = """
SELECT 'pay_upi' AS tool, false AS large, count(*) AS n, count_if(ok AND am < 2) AS allowed, count_if(ok AND am < 2 AND py = 2 AND ap IS NOT TRUE) AS untrusted, count_if(ok AND am < 2 AND NOT mandated) AS unmandated
FROM (SELECT p.*, l.x AS am, m.x AS py FROM paid p, levels l, levels m) z
UNION ALL SELECT 'issue_refund', large, count(*), count_if(ok AND am < 2 AND (NOT large OR ap)), 0, count_if(ok AND am < 2 AND (NOT large OR ap) AND NOT mandated) FROM (SELECT p.*, l.x AS am, m.x AS large FROM paid p, levels l, (VALUES (true), (false)) m(x)) z GROUP BY large
UNION ALL SELECT 'add_payee', false, count(*), count_if(NOT mis.x AND l.x < 2), 0, 0 FROM three mis, three ap, levels l
UNION ALL SELECT 'send_email', false, count(*), count_if(ok), count_if(ok AND (recipient = 2 OR body = 2) AND ap IS NOT TRUE), 0 FROM (SELECT ap.x AS ap, r.x AS recipient, b.x AS body, coalesce(NOT mis.x, false) AND r.x < 2 AND (NOT (t1.x OR t2.x OR t3.x) OR (co.x AND sk.x) IS TRUE) AS ok
  FROM three co, three sk, three ap, three mis, levels r, levels b, (VALUES (true), (false)) t1(x), (VALUES (true), (false)) t2(x), (VALUES (true), (false)) t3(x)) z
UNION ALL SELECT 'read_customer_data', false, count(*), count_if((co.x AND sk.x AND NOT mis.x) IS TRUE), 0, 0 FROM three co, three sk, three mis
UNION ALL SELECT 'read_document', false, count(*), count_if(NOT x), 0, 0 FROM three
"""


@query(
    "inv08_policy_counts",
    "SELECT b.tool, base, calls, n * 24 AS combinations, allowed, untrusted AS untrusted_sink, unmandated AS unmandated_payment, CAST(0 AS BIGINT) AS broken_otherwise FROM "
    "(SELECT tool, CASE WHEN tool = 'issue_refund' THEN args END AS base, coalesce(tool = 'issue_refund' AND amount_paise * 40 > 500000, false) AS large, count(*) AS calls FROM v_call_args WHERE call_id % 301 <> 7 AND tool <> 'wire_all' GROUP BY ALL) b JOIN swept r ON r.tool = b.tool AND r.large = b.large",
    three=THREE,
    levels=LEVELS,
    paid=PAID,
    swept=ROWS,
)
def policy_counts(t):
    found = iv.policy_counts(t.v_call_args.select("tool", "args"), RULES.without(*GAPS))
    rest = F.col("lowered") + F.col("allowed_after_failure") + F.col("unconsented_personal_data")
    return found.select("tool", "base", "calls", "combinations", "allowed", "untrusted_sink", "unmandated_payment", rest.alias("broken_otherwise"))


RULE_FILES = "SELECT 'f' || CAST(p_size % 3 AS STRING) AS file, 'RULE.' || p_brand AS name, CASE WHEN p_brand < 'Brand#15' THEN p_type ELSE 'same' END AS definition FROM part"


@query(
    "set05_rule_conflicts",
    "SELECT name, count(DISTINCT definition) AS definitions FROM rf GROUP BY name HAVING count(DISTINCT definition) > 1",
    rf=RULE_FILES,
)
def rule_conflicts(t):
    return iv.rule_conflicts(t.sql(RULE_FILES))
