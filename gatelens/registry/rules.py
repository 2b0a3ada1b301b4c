"""Queries for rule evaluation."""

from pyspark.sql import functions as F

from gatelens.operators import evaluate as ev
from gatelens.operators import predicates as p
from gatelens.operators.ruleset import all_rules, core_rules, merge, payment_rules, purpose_rules, voice_rules
from gatelens.registry.base import query
from gatelens.registry.labels import COVER, TREES
from gatelens.registry.predicates import DOC

RULES = all_rules()

FACTS = """
SELECT call_id,
  CASE WHEN call_id % 5 = 0 THEN NULL ELSE call_id % 6 <> 5 END AS mandate_sig_valid,
  amount_paise < 9000 AS mandate_time_valid, principal <> 20 AS mandate_nonce_fresh,
  CASE WHEN tool = 'pay_upi' THEN principal % 3 <> 0 END AS payee_in_mandate,
  amount_paise < 5000 AS amount_within_payee_cap, amount_paise < 8000 AS amount_within_per_txn_cap,
  CASE WHEN amount_paise > 6000 THEN false WHEN amount_paise > 5500 THEN NULL ELSE true END AS amount_within_daily_cap,
  principal <> 4 AS category_matches, call_id % 13 = 0 AS approval_valid, call_id % 51 = 0 AS approval_binding_mismatch,
  principal % 2 = 0 AS consent_active, CASE WHEN principal % 5 = 0 THEN NULL ELSE true END AS sink_allowed_for_purpose,
  CASE WHEN call_id % 71 = 0 THEN 1 WHEN call_id % 73 = 0 THEN 2 END AS ml_decision
FROM v_calls
"""

# ---- the rules once more, written as SQL over one row per call
# label level of the arguments the rules read (2 where unlabelled), NULL where the argument is absent
LEVELS = """
SELECT d.call_id,
  max(CASE WHEN l.pointer = '/payee_vpa' THEN l.level END) AS payee, max(CASE WHEN l.pointer = '/amount_paise' THEN l.level END) AS amount,
  max(CASE WHEN l.pointer = '/vpa' THEN l.level END) AS vpa, max(CASE WHEN l.pointer = '/to' THEN l.level END) AS dest,
  max(CASE WHEN l.pointer = '/subject' THEN l.level END) AS subject, max(CASE WHEN l.pointer = '/body' THEN l.level END) AS body,
  bool_or(l.tag LIKE 'PII%' AND l.pointer IN ('/to', '/subject', '/body')) AS pii
FROM doc d LEFT JOIN v_call_labels l ON l.call_id = d.call_id GROUP BY d.call_id
"""
SCHEMA = """
SELECT call_id, 'CORE.SCHEMA.MALFORMED_INPUT' AS rule_id, 2 AS decision, false AS unknown FROM doc WHERE j IS NULL
UNION ALL SELECT call_id, 'CORE.SCHEMA.UNKNOWN_TOOL', 2, false FROM doc WHERE j IS NOT NULL AND tool = 'wire_all'
UNION ALL SELECT call_id, 'CORE.SCHEMA.CATEGORY_MISMATCH', 2, false FROM doc WHERE j IS NOT NULL AND tool <> 'wire_all'
  AND declared_category <> CASE WHEN tool IN ('pay_upi', 'issue_refund') THEN 'PAYMENT' WHEN tool = 'add_payee' THEN 'WRITE' WHEN tool = 'send_email' THEN 'COMMUNICATION' ELSE 'READ' END
UNION ALL SELECT call_id, 'CORE.SCHEMA.UNKNOWN_ARG', 2, false FROM doc WHERE tool <> 'wire_all' AND (json_exists(j, '$.memo') OR json_exists(j, '$.Purpose'))
UNION ALL SELECT call_id, 'CORE.SCHEMA.WRONG_TYPE', 2, false FROM doc WHERE tool = 'pay_upi' AND json_exists(j, '$.amount_paise') AND json_type(j, '$.amount_paise') <> 'UBIGINT'
UNION ALL SELECT call_id, 'CORE.SCHEMA.MISSING_ARG', 2, false FROM doc WHERE tool = 'pay_upi' AND j IS NOT NULL AND NOT json_exists(j, '$.payee_vpa')
"""
PAY = "d.tool IN ('pay_upi', 'issue_refund')"
MISSING = """(d.tool = 'pay_upi' AND (e.payee IS NULL OR e.amount IS NULL OR json_exists(d.j, '$.note')))
  OR (d.tool = 'issue_refund' AND (e.amount IS NULL OR NOT EXISTS (SELECT 1 FROM v_call_labels l WHERE l.call_id = d.call_id AND l.pointer = '/order_id')))
  OR (d.tool = 'add_payee' AND (e.vpa IS NULL OR NOT EXISTS (SELECT 1 FROM v_call_labels l WHERE l.call_id = d.call_id AND l.pointer = '/name')))
  OR (d.tool = 'read_document' AND NOT EXISTS (SELECT 1 FROM v_call_labels l WHERE l.call_id = d.call_id))
  OR (d.tool = 'read_customer_data' AND ((SELECT count(DISTINCT l.pointer) FROM v_call_labels l WHERE l.call_id = d.call_id) < 2))
  OR (d.tool = 'send_email' AND (e.dest IS NULL OR e.body IS NULL))"""
_MANDATE = [
    ("SIGNATURE", "mandate_sig_valid"),
    ("TIME", "mandate_time_valid"),
    ("REPLAY", "mandate_nonce_fresh"),
    ("PAYEE", "payee_in_mandate"),
    ("CATEGORY", "category_matches"),
]
_CAPS = [
    ("PAYEE", "amount_within_payee_cap"),
    ("PER_TXN", "amount_within_per_txn_cap"),
    ("DAILY", "amount_within_daily_cap"),
]


def _fired(rule_id: str, decision: int, where: str, truth: str) -> str:
    """A rule as rows: it fires unless ``truth`` is false for the calls in ``where``."""
    return (
        f"SELECT d.call_id, '{rule_id}' AS rule_id, {decision} AS decision, ({truth}) IS NULL AS unknown "
        f"FROM doc d JOIN lev e ON e.call_id = d.call_id LEFT JOIN facts f ON f.call_id = d.call_id "
        f"WHERE ({where}) AND coalesce(({truth}), true)"
    )


PAYMENT_SQL = (
    [_fired(f"PAYSHIELD.MANDATE.{k}", 2, PAY, f"NOT f.{n}") for k, n in _MANDATE]
    + [_fired(f"PAYSHIELD.CAP.{k}", 1, PAY, f"NOT f.{n} AND NOT f.approval_valid") for k, n in _CAPS]
    + [
        _fired("PAYSHIELD.TAINT.UNTRUSTED_PAYEE", 2, PAY + " AND json_exists(d.j, '$.payee_vpa')", "coalesce(e.payee, 2) >= 2"),
        _fired("PAYSHIELD.TAINT.UNTRUSTED_AMOUNT", 2, PAY + " AND json_exists(d.j, '$.amount_paise')", "coalesce(e.amount, 2) >= 2"),
        _fired("PAYSHIELD.APPROVAL.BINDING_MISMATCH", 2, "true", "f.approval_binding_mismatch"),
        _fired("PAYSHIELD.TAINT.UNTRUSTED_NEW_PAYEE", 2, "d.tool = 'add_payee'", "coalesce(e.vpa, 2) >= 2"),
        _fired("CORE.CAP.LARGE_REFUND", 1, "d.tool = 'issue_refund'", "CAST(d.j->>'$.amount_paise' AS BIGINT) > 500000 AND NOT f.approval_valid"),
    ]
)
COVERED = "f.consent_active AND f.sink_allowed_for_purpose"
PURPOSE_SQL = [
    _fired("PURPOSELOCK.EGRESS.PII_WITHOUT_CONSENT", 2, "d.tool = 'send_email'", f"coalesce(e.pii, false) AND NOT ({COVERED})"),
    _fired("PURPOSELOCK.CONSENT.READ_WITHOUT_CONSENT", 2, "d.tool = 'read_customer_data'", f"NOT ({COVERED})"),
    _fired("PURPOSELOCK.TAINT.UNTRUSTED_RECIPIENT", 2, "d.tool = 'send_email'", "coalesce(e.dest, 2) >= 2"),
    _fired("PURPOSELOCK.TAINT.UNTRUSTED_EMAIL_CONTENT", 1, "d.tool = 'send_email'", "(coalesce(e.subject, 2) >= 2 OR coalesce(e.body, 2) >= 2) AND NOT f.approval_valid"),
]
MISSING_SQL = (
    "SELECT d.call_id, 'CORE.LABEL.MISSING' AS rule_id, 0 AS decision, false AS unknown FROM doc d JOIN lev e ON e.call_id = d.call_id WHERE "
    + MISSING
)
NO_SCHEMA = "WHERE call_id NOT IN (SELECT call_id FROM bad)"


def reasons_sql(parts: list[str]) -> dict[str, str]:
    return {
        "doc": DOC,
        "facts": FACTS,
        "lev": LEVELS,
        "bad": SCHEMA,
        "rules": f"SELECT * FROM ({' UNION ALL '.join(parts)}) {NO_SCHEMA}",
        "found": "SELECT * FROM bad UNION ALL SELECT * FROM rules",
        "sig": "SELECT c.call_id, c.tool, coalesce(max(r.decision), 0) AS rule_decision, bool_or(b.call_id IS NOT NULL) AS failed, max(f.ml_decision) AS ml "
        "FROM v_calls c LEFT JOIN found r ON r.call_id = c.call_id LEFT JOIN (SELECT DISTINCT call_id FROM bad) b ON b.call_id = c.call_id "
        "LEFT JOIN facts f ON f.call_id = c.call_id GROUP BY c.call_id, c.tool",
        "allr": "SELECT call_id, rule_id, decision, unknown FROM found UNION ALL "
        "SELECT call_id, 'CORE.ML.SIGNAL', ml, false FROM sig WHERE NOT failed AND ml > rule_decision",
        "verdict": "SELECT s.call_id, s.tool, s.rule_decision, max(greatest(s.rule_decision, CASE WHEN s.failed THEN 0 ELSE coalesce(s.ml, 0) END)) AS decision, "
        "coalesce(string_agg(r.rule_id, ',' ORDER BY r.decision DESC, r.rule_id), '') AS rules, "
        "CAST(count(CASE WHEN r.unknown THEN 1 END) AS BIGINT) AS n_unknown "
        "FROM sig s LEFT JOIN allr r ON r.call_id = s.call_id GROUP BY s.call_id, s.tool, s.rule_decision",
    }


ALL_PARTS = [MISSING_SQL, *PAYMENT_SQL, *PURPOSE_SQL]
ALL_SQL = reasons_sql(ALL_PARTS)


def facts(t):
    return t.sql(FACTS.strip())


def verdicts(t, rules=RULES):
    return ev.evaluate_policy(t.v_call_args, t.v_call_labels, rules, facts=facts(t))


def shown(rows):
    return rows.select(
        "call_id",
        "tool",
        "rule_decision",
        "decision",
        F.array_join(F.transform("reasons", lambda r: r["rule_id"]), ",").alias("rules"),
        F.size(F.filter("reasons", lambda r: r["unknown"])).cast("long").alias("n_unknown"),
    )


@query("rul01_evaluate_policy", "SELECT * FROM verdict", **ALL_SQL)
def evaluate_policy(t):
    return shown(verdicts(t))


@query(
    "rul02_rule_fired",
    "SELECT call_id, coalesce(NOT mandate_sig_valid, true) AS fired, mandate_sig_valid IS NULL AS unknown FROM facts",
    facts=FACTS,
)
def rule_fired(t):
    when = ~F.col("mandate_sig_valid")
    return facts(t).select("call_id", ev.fired(when).alias("fired"), when.isNull().alias("unknown"))


@query("rul03_combine_decisions", "SELECT call_id, rule_decision AS decision FROM sig", **ALL_SQL)
def combine_decisions(t):
    plain = verdicts(t)
    return plain.select(
        "call_id",
        ev.combine(F.filter("reasons", lambda r: r["rule_id"] != ev.SIGNAL)).alias("decision"),
    )


@query(
    "rul04_order_reasons",
    "SELECT call_id, rule_id, decision, row_number() OVER (PARTITION BY call_id ORDER BY decision DESC, rule_id) AS place FROM allr",
    **ALL_SQL,
)
def order_reasons(t):
    return verdicts(t).select("call_id", F.posexplode("reasons").alias("pos", "r")).select(
        "call_id", "r.rule_id", "r.decision", (F.col("pos") + 1).cast("long").alias("place")
    )


def _schema_rows(t, build):
    rows = ev.with_tools(t.v_call_args, RULES)
    return rows.select("call_id", F.explode(build).alias("r")).select("call_id", "r.rule_id", "r.evidence")


@query(
    "rul05_unknown_tool",
    "SELECT call_id, 'CORE.SCHEMA.UNKNOWN_TOOL' AS rule_id, tool AS evidence FROM v_calls WHERE tool = 'wire_all'",
)
def unknown_tool(t):
    return _schema_rows(t, ev.unknown_tool_reasons())


@query(
    "rul06_category_mismatch",
    "SELECT call_id, 'CORE.SCHEMA.CATEGORY_MISMATCH' AS rule_id, declared_category || '/' || cat AS evidence FROM (SELECT *, "
    "CASE WHEN tool IN ('pay_upi', 'issue_refund') THEN 'PAYMENT' WHEN tool = 'add_payee' THEN 'WRITE' WHEN tool = 'send_email' THEN 'COMMUNICATION' "
    "WHEN tool <> 'wire_all' THEN 'READ' END AS cat FROM v_calls) c WHERE declared_category <> cat",
)
def category_mismatch(t):
    return _schema_rows(t, ev.category_mismatch_reasons())


@query(
    "rul07_unknown_arg",
    "SELECT call_id, 'CORE.SCHEMA.UNKNOWN_ARG' AS rule_id, CASE WHEN json_exists(j, '$.memo') THEN 'memo' ELSE 'Purpose' END AS evidence "
    "FROM doc WHERE tool <> 'wire_all' AND (json_exists(j, '$.memo') OR json_exists(j, '$.Purpose'))",
    doc=DOC,
)
def unknown_arg(t):
    rows = ev.with_tools(t.v_call_args, RULES).where("specs IS NOT NULL")
    return rows.select("call_id", F.explode(ev.unknown_arg_reasons()).alias("r")).select(
        "call_id", "r.rule_id", "r.evidence"
    )


@query(
    "rul08_wrong_type",
    "SELECT call_id, 'CORE.SCHEMA.WRONG_TYPE' AS rule_id, 'amount_paise:integer' AS evidence FROM doc "
    "WHERE tool = 'pay_upi' AND json_type(j, '$.amount_paise') <> 'UBIGINT'",
    doc=DOC,
)
def wrong_type(t):
    return _schema_rows(t, ev.wrong_type_reasons())


@query(
    "rul09_missing_arg",
    "SELECT call_id, 'CORE.SCHEMA.MISSING_ARG' AS rule_id, 'payee_vpa' AS evidence FROM doc "
    "WHERE tool = 'pay_upi' AND j IS NOT NULL AND NOT json_exists(j, '$.payee_vpa')",
    doc=DOC,
)
def missing_arg(t):
    rows = ev.with_tools(t.v_call_args, RULES).where(F.col(p.ARGS).isNotNull())
    return rows.select("call_id", F.explode(ev.missing_arg_reasons()).alias("r")).select(
        "call_id", "r.rule_id", "r.evidence"
    )


@query(
    "rul10_missing_label",
    "SELECT call_id, string_agg(DISTINCT pointer, ',' ORDER BY pointer) AS paths FROM cover WHERE level IS NULL GROUP BY call_id",
    **TREES,
    cover=COVER,
)
def missing_label(t):
    rows = ev.with_labels(ev.with_tools(t.v_call_args, RULES), t.v_call_labels, RULES)
    return rows.select("call_id", F.explode(ev.missing_label_reasons()).alias("r")).select(
        "call_id", F.col("r.evidence").alias("paths")
    )


@query(
    "rul11_tighten_with_signal",
    "SELECT call_id, rule_decision, ml, CASE WHEN NOT failed AND ml > rule_decision THEN ml ELSE rule_decision END AS decision, "
    "coalesce(NOT failed AND ml > rule_decision, false) AS tightened FROM sig",
    **ALL_SQL,
)
def tighten_with_signal(t):
    return verdicts(t).join(facts(t).select("call_id", F.col("ml_decision").alias("ml")), "call_id").select(
        "call_id",
        "rule_decision",
        "ml",
        "decision",
        F.exists("reasons", lambda r: r["rule_id"] == ev.SIGNAL).alias("tightened"),
    )


@query(
    "rul12_quarantine_malformed",
    "SELECT call_id, CASE WHEN call_id % 301 = 7 THEN 'unparsable' ELSE 'string' END AS evidence, 2 AS decision FROM v_calls WHERE call_id % 301 = 7 OR tool = 'wire_all'",
)
def quarantine_malformed(t):
    raw = t.v_call_args.withColumn(
        "args", F.expr("CASE WHEN tool = 'wire_all' AND call_id % 301 <> 7 THEN '\"text\"' ELSE args END")
    )
    rows = ev.with_tools(raw, RULES).select("call_id", F.explode(ev.malformed_reasons()).alias("r"))
    return rows.select("call_id", "r.evidence", "r.decision")


ERRORS = """
SELECT session_id, CASE call_id % 3 WHEN 0 THEN 'args' WHEN 1 THEN event_type ELSE 'labels' END AS step, CASE WHEN call_id % 2 = 0 THEN 'tool' ELSE 'k' || CAST(call_id AS STRING) END AS leaf,
  'type_' || CAST(amount_paise % 30 AS STRING) AS kind FROM v_calls
"""
KNOWN_STEPS = ("call", "args", "labels", "tool")


@query(
    "rul12_error_locations",
    "SELECT session_id, array_to_string(list_slice(list_sort(list_distinct(list('call/' || CASE WHEN step IN ('args', 'labels') THEN step ELSE '*' END || '/' || CASE WHEN leaf = 'tool' THEN leaf ELSE '*' END || ': ' || kind))), 1, 20), ',') AS errors FROM er GROUP BY session_id",
    er=ERRORS,
)
def error_locations(t):
    errors = t.sql(ERRORS.strip()).select("session_id", F.array(F.lit("call"), "step", "leaf").alias("path"), "kind")
    found = ev.error_evidence(errors, KNOWN_STEPS, key="session_id")
    return found.select("session_id", F.array_join("errors", ",").alias("errors"))


@query(
    "rul12_call_errors",
    "SELECT call_id, array_to_string(list_sort(e), ',') AS errors FROM (SELECT call_id, list_filter(["
    "CASE WHEN tool = 'wire_all' THEN 'call/tool: unknown_tool' END, CASE WHEN declared_category = 'READ' AND tool IN ('pay_upi', 'add_payee', 'send_email', 'issue_refund') THEN 'call/category: category_mismatch' END, "
    "CASE WHEN call_id % 301 = 7 THEN 'call/args: unparsable' WHEN call_id % 59 = 11 THEN 'call/args: object_expected' END, CASE WHEN parsed AND tool = 'pay_upi' AND call_id % 43 = 5 THEN 'call/args/payee_vpa: missing' END, "
    "CASE WHEN parsed AND (tool = 'pay_upi' AND call_id % 41 = 3 OR tool = 'read_customer_data' AND call_id % 19 = 6) THEN 'call/args/*: undeclared' END, "
    "CASE WHEN parsed AND tool = 'pay_upi' AND (call_id % 31 = 2 OR call_id % 37 = 4) THEN 'call/args/amount_paise: integer_expected' END], lambda x: x IS NOT NULL) AS e "
    "FROM (SELECT *, call_id % 301 <> 7 AND call_id % 59 <> 11 AS parsed FROM v_calls) c) z WHERE len(e) > 0",
)
def call_errors(t):
    listed = F.expr("CASE WHEN call_id % 301 <> 7 AND call_id % 59 = 11 THEN '[1,{}]' ELSE args END")
    errors = ev.call_errors(t.v_call_args.withColumn("args", listed), RULES)
    found = ev.error_evidence(errors, ev.known_steps(RULES))
    return found.select("call_id", F.array_join("errors", ",").alias("errors"))


SHIPPED = merge("shipped", [core_rules(), payment_rules(), voice_rules()])


@query(
    "rul13_apply_builtin_rules",
    "SELECT r.rule_id, count(*) AS n_calls, count(CASE WHEN unknown THEN 1 END) AS n_unknown FROM rules r JOIN v_calls c ON c.call_id = r.call_id "
    "WHERE c.tool NOT IN ('send_email', 'read_customer_data') GROUP BY r.rule_id",
    **reasons_sql([MISSING_SQL, *PAYMENT_SQL]),
)
def apply_builtin_rules(t):
    return _rule_counts(
        ev.evaluate_policy(t.v_call_args, t.v_call_labels, SHIPPED, facts=facts(t).drop("ml_decision")).where(
            "NOT schema_failed"
        )
    )


@query(
    "rul14_apply_purpose_rules",
    "SELECT rule_id, count(*) AS n_calls, count(CASE WHEN unknown THEN 1 END) AS n_unknown FROM rules r JOIN v_calls c ON c.call_id = r.call_id "
    "WHERE c.tool IN ('send_email', 'read_customer_data') GROUP BY r.rule_id",
    **reasons_sql([MISSING_SQL, *PURPOSE_SQL]),
)
def apply_purpose_rules(t):
    return _rule_counts(
        ev.evaluate_policy(t.v_call_args, t.v_call_labels, purpose_rules(), facts=facts(t).drop("ml_decision")).where(
            "NOT schema_failed"
        )
    )


def _rule_counts(rows):
    return (
        rows.select(F.explode("reasons").alias("r"))
        .groupBy("r.rule_id")
        .agg(F.count("*").alias("n_calls"), F.count_if("r.unknown").alias("n_unknown"))
    )


@query(
    "rul15_compare_policies",
    "SELECT a.call_id, a.tool, a.rule_decision AS decision_before, coalesce(max(r.decision), 0) AS decision_after FROM sig a "
    "LEFT JOIN found r ON r.call_id = a.call_id AND r.rule_id <> 'PAYSHIELD.TAINT.UNTRUSTED_NEW_PAYEE' "
    "GROUP BY a.call_id, a.tool, a.rule_decision HAVING coalesce(max(r.decision), 0) <> a.rule_decision",
    **ALL_SQL,
)
def compare_policies(t):
    weaker = RULES.without("PAYSHIELD.TAINT.UNTRUSTED_NEW_PAYEE")
    return ev.compare_policies(t.v_call_args, t.v_call_labels, RULES, weaker, facts=facts(t).drop("ml_decision"))


STATUS = """
SELECT call_id, stage, (call_id + k) % 29 = 0 AS failed FROM (
  SELECT call_id, 'ml' AS stage, 3 AS k FROM v_calls UNION ALL SELECT call_id, 'ingress', 7 FROM v_calls
  UNION ALL SELECT call_id, 'guards', 11 FROM v_calls UNION ALL SELECT call_id, 'preview', 3 FROM v_calls UNION ALL SELECT call_id, 'policy', 11 FROM v_calls) s
"""


@query(
    "rul16_failsafe_reasons",
    "SELECT call_id, CASE WHEN (call_id + 7) % 29 = 0 THEN 'CORE.FAILSAFE.INGRESS' WHEN (call_id + 11) % 29 = 0 THEN 'CORE.FAILSAFE.GUARDS' ELSE 'CORE.FAILSAFE.ML' END AS rule_id, "
    "CASE WHEN (call_id + 7) % 29 = 0 THEN 2 ELSE 1 END AS decision FROM v_calls WHERE (call_id + 7) % 29 = 0 OR (call_id + 11) % 29 = 0 OR (call_id + 3) % 29 = 0",
)
def failsafe_reasons(t):
    return ev.failsafe(t.sql(STATUS.strip())).select("call_id", "rule_id", "decision")


WIRE_NAME = "CASE WHEN tool = 'wire_all' THEN 'wire_all' WHEN tool = 'read_document' THEN 'files_' || tool WHEN tool = 'send_email' THEN 'mail_' || tool WHEN tool = 'issue_refund' THEN 'read_handle' ELSE 'upi_' || tool END"


@query(
    "rul17_resolve_tool_name",
    "SELECT call_id, CASE WHEN tool = 'wire_all' THEN 'unknown' WHEN tool = 'read_document' THEN 'files' WHEN tool = 'send_email' THEN 'mail' WHEN tool = 'issue_refund' THEN 'gateway' ELSE 'upi' END AS server, "
    "CASE WHEN tool = 'issue_refund' THEN 'read_handle' ELSE tool END AS tool FROM v_calls",
)
def resolve_tool_name(t):
    return t.v_calls.select("call_id", ev.resolve_tool_name(F.expr(WIRE_NAME)).alias("r")).select("call_id", "r.*")


@query(
    "rul18_domain_of_tool",
    "SELECT domain, CASE domain WHEN 'payshield' THEN 'finbot' WHEN 'purposelock' THEN 'supportbot' ELSE 'agent' END AS agent, count(*) AS n FROM ("
    "SELECT CASE WHEN tool IN ('pay_upi', 'add_payee') THEN 'payshield' WHEN tool IN ('send_email', 'read_customer_data') THEN 'purposelock' ELSE 'core' END AS domain FROM v_calls) x GROUP BY domain",
)
def domain_of_tool(t):
    domain = ev.domain_of(F.col("tool"))
    return (
        t.v_calls.groupBy(domain.alias("domain"))
        .agg(F.count("*").alias("n"))
        .withColumn("agent", ev.agent_of(F.col("domain")))
    )


@query(
    "rul20_denial_summary",
    "SELECT call_id, CASE decision WHEN 2 THEN 'DENY' ELSE 'STEP_UP' END AS decision, rules, decision = 1 AS has_digest FROM verdict WHERE decision > 0",
    **ALL_SQL,
)
def denial_summary(t):
    return ev.denial_summary(verdicts(t)).select(
        "call_id", "decision", "rules", F.col("call_digest").isNotNull().alias("has_digest")
    )


@query(
    "rul21_strip_agent_purpose",
    "SELECT call_id, json_exists(j, '$.Purpose') AS purpose_ignored, replace(args, '\"Purpose\":\"marketing\",', '') AS args FROM doc WHERE j IS NOT NULL",
    doc=DOC,
)
def strip_agent_purpose(t):
    reads = t.v_call_args.where(F.try_parse_json("args").isNotNull())
    return ev.strip_agent_purpose(reads).select("call_id", "purpose_ignored", "args")


@query(
    "rul22_call_digest",
    "SELECT call_id, sha256('{\"args\":{' || string_agg('\"' || name || '\":' || CAST(json_extract(j, '$.\"' || name || '\"') AS VARCHAR), ',' ORDER BY name) || '},\"principal\":\"' || principal || "
    "'\",\"server\":\"upi\",\"task_id\":\"' || task_id || '\",\"tool\":\"' || tool || '\"}') AS digest FROM (SELECT *, unnest(json_keys(j)) AS name FROM doc WHERE j IS NOT NULL) k GROUP BY call_id, principal, task_id, tool",
    doc=DOC,
)
def call_digest(t):
    return t.v_call_args.select("call_id", ev.call_digest().alias("digest")).where("digest IS NOT NULL")
