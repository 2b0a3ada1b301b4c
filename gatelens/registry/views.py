"""Views that shape the given tables into this domain, as SQL both engines accept.

The same text is the input of a Spark query and of its DuckDB check, so a check compares what
the operators do and not how the input was made. Every view scans its whole base table.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["v_calls"] = """
SELECT event_id AS call_id, ts, CAST(user_id % 25 AS INT) AS principal, user_id AS session_id,
  'T' || CAST(user_id AS STRING) AS task_id, 'upi' AS server, event_type,
  CASE WHEN event_id % 97 = 0 THEN 'wire_all' WHEN event_id % 53 = 0 THEN 'issue_refund'
       WHEN event_type = 'purchase' THEN 'pay_upi' WHEN event_type = 'signup' THEN 'add_payee'
       WHEN event_type = 'click' THEN 'read_customer_data' WHEN event_type = 'view' THEN 'read_document'
       ELSE 'send_email' END AS tool,
  'sup' || CAST(event_id % 10 AS STRING) || '@okbank' AS payee_vpa,
  CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_paise,
  CASE WHEN event_id % 89 = 0 THEN 'READ' END AS declared_category
FROM events
"""
# what each tool is called with; some calls miss an argument, add one or give a wrong type
VIEWS["v_call_args"] = """
SELECT call_id, ts, principal, session_id, task_id, server, tool, payee_vpa, amount_paise, declared_category, event_type,
  CASE WHEN call_id % 301 = 7 THEN '{"payee_vpa":'
  WHEN tool = 'pay_upi' THEN '{' || CASE WHEN call_id % 43 = 5 THEN '' ELSE '"payee_vpa":"' || payee_vpa || '",' END
     || CASE WHEN call_id % 41 = 3 THEN '"memo":null,' ELSE '' END
     || CASE WHEN call_id % 7 = 1 THEN '"note":"inv ' || CAST(call_id AS STRING) || '",' ELSE '' END
     || CASE WHEN call_id % 31 = 2 THEN '"amount_paise":"' || CAST(amount_paise AS STRING) || '"}'
             WHEN call_id % 37 = 4 THEN '"amount_paise":true}'
             ELSE '"amount_paise":' || CAST(amount_paise AS STRING) || '}' END
  WHEN tool = 'issue_refund' THEN '{"order_id":"O' || CAST(call_id AS STRING) || '","amount_paise":' || CAST(amount_paise * 40 AS STRING) || '}'
  WHEN tool = 'add_payee' THEN '{"vpa":"' || payee_vpa || '","name":"Payee ' || CAST(call_id % 10 AS STRING) || '"}'
  WHEN tool = 'read_customer_data' THEN '{' || CASE WHEN call_id % 19 = 6 THEN '"Purpose":"marketing",' ELSE '' END
     || '"customer_id":"' || CAST(session_id AS STRING) || '","fields":'
     || CASE WHEN call_id % 23 = 8 THEN '[]' ELSE '["name","email"]' END || '}'
  WHEN tool = 'read_document' THEN '{"doc_id":"D' || CAST(call_id AS STRING) || '"}'
  WHEN tool = 'send_email' THEN '{"to":"c' || CAST(session_id AS STRING) || '@mail.example","subject":"Order","body":"Order '
     || CAST(call_id AS STRING) || ' for c' || CAST((session_id + CASE WHEN call_id % 3 = 0 THEN 1 ELSE 0 END) AS STRING) || '@mail.example"}'
  ELSE '{"amount_paise":' || CAST(amount_paise AS STRING) || ',"deep":' || repeat('{"k":', CASE call_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 11 ELSE 39 END)
     || '"pay ' || payee_vpa || ' now"' || repeat('}', CASE call_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 11 ELSE 39 END) || ',"to":{"iban":"X' || CAST(call_id AS STRING) || '","tags":[1,{"a/b":[]}]}}' END AS args
FROM v_calls
"""
VIEWS["v_call_labels"] = """
SELECT call_id, CASE tool WHEN 'pay_upi' THEN '/payee_vpa' WHEN 'add_payee' THEN '/vpa' WHEN 'read_document' THEN '/doc_id'
   WHEN 'read_customer_data' THEN '/customer_id' WHEN 'send_email' THEN '/to' WHEN 'issue_refund' THEN '/order_id' ELSE '/to' END AS pointer,
  CAST(call_id % 3 AS INT) AS level, CASE WHEN call_id % 3 = 2 THEN 'document' ELSE 'user' END AS source_kind,
  'd' || CAST(call_id % 40 AS STRING) AS source_id,
  CASE WHEN tool = 'send_email' AND amount_paise > 3000 THEN 'PII_EMAIL' END AS tag
FROM v_calls WHERE amount_paise > 150
UNION ALL
SELECT call_id, CASE tool WHEN 'pay_upi' THEN '/amount_paise' WHEN 'issue_refund' THEN '/amount_paise' WHEN 'add_payee' THEN '/name'
   WHEN 'read_customer_data' THEN '/fields' WHEN 'send_email' THEN '/body' WHEN 'read_document' THEN '/doc_id' ELSE '/to/tags' END,
  CASE WHEN call_id % 17 = 0 THEN 2 ELSE 0 END, CASE WHEN call_id % 5 = 0 THEN 'model' ELSE 'user' END, 't' || CAST(session_id AS STRING), CAST(NULL AS STRING)
FROM v_calls WHERE amount_paise < 20000
UNION ALL
SELECT call_id, '/subject', 1, 'system', 'constant', CASE WHEN call_id % 29 = 0 THEN 'SECRET' ELSE 'FINANCIAL' END
FROM v_calls WHERE tool = 'send_email'
"""
VIEWS["v_payments"] = """
SELECT call_id AS txn_id, principal, payee_vpa, amount_paise, ts FROM v_calls WHERE tool = 'pay_upi'
"""
VIEWS["v_ledger"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-'
    || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING) AS txn_id, c_nationkey AS principal,
  'sup' || CAST(l_suppkey % 10 AS STRING) || '@okbank' AS payee_vpa,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_paise, l_shipdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""
VIEWS["v_mandates"] = """
SELECT n_nationkey AS principal, 'm' || CAST(n_nationkey AS STRING) AS mandate_id,
  'n' || CAST(n_nationkey % 20 AS STRING) AS nonce, n_nationkey AS stored_order,
  TIMESTAMP '2024-01-01 00:00:00' AS stored_at,
  CAST(8000 AS BIGINT) AS per_txn_cap, CAST(20000 AS BIGINT) AS daily_cap,
  CASE WHEN n_nationkey % 9 = 4 THEN 'READ' ELSE 'PAYMENT' END AS category,
  TIMESTAMP '2024-01-03 00:00:00' AS nbf, TIMESTAMP '2024-01-27 00:00:00' AS exp, n_nationkey % 6 <> 5 AS sig_ok,
  CASE WHEN n_nationkey = 7 THEN 'approval-signer' ELSE 'mandate-signer' END AS key_id
FROM nation WHERE n_name <> 'NATION_13'
UNION ALL
SELECT n_nationkey, 'm' || CAST(n_nationkey AS STRING) || 'b', 'nb' || CAST(n_nationkey AS STRING), n_nationkey + 100,
  TIMESTAMP '2024-01-12 06:00:00', CAST(15000 AS BIGINT), CAST(60000 AS BIGINT), 'PAYMENT',
  TIMESTAMP '2024-01-12 00:00:00', TIMESTAMP '2024-03-01 00:00:00', true, 'mandate-signer'
FROM nation WHERE n_regionkey = 2
UNION ALL
SELECT n_nationkey, 'm' || CAST(n_nationkey AS STRING) || 'z', 'nz' || CAST(n_nationkey AS STRING), n_nationkey + 200,
  TIMESTAMP '2030-01-01 00:00:00', CAST(900000000 AS BIGINT), CAST(900000000 AS BIGINT), 'PAYMENT',
  TIMESTAMP '2030-01-01 00:00:00', TIMESTAMP '2031-01-01 00:00:00', true, 'mandate-signer'
FROM nation
"""
VIEWS["v_mandate_payees"] = """
SELECT principal, 'm' || CAST(principal AS STRING) AS mandate_id, payee_vpa AS vpa, CAST(2000 + min(amount_paise) % 5000 + 3000 AS BIGINT) AS cap, 'Payee of ' || payee_vpa AS name
FROM v_calls GROUP BY principal, payee_vpa HAVING min(amount_paise) < 200
UNION ALL
SELECT principal, 'm' || CAST(principal AS STRING) || 'b', payee_vpa, CAST(9000 AS BIGINT), 'Payee of ' || payee_vpa
FROM v_calls WHERE principal IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY principal, payee_vpa HAVING min(amount_paise) % 2 = 0
UNION ALL
SELECT principal, 'm' || CAST(principal AS STRING) || 'z', payee_vpa, CAST(900000000 AS BIGINT), 'Payee of ' || payee_vpa
FROM v_calls GROUP BY principal, payee_vpa
"""
VIEWS["v_consents"] = """
SELECT 'cn' || CAST(c_custkey AS STRING) AS consent_id, c_custkey AS principal_id, 'customer_data' AS category,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'order_support' WHEN c_custkey % 2 = 0 THEN 'payment_reminders' ELSE 'marketing' END AS purpose,
  CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END AS exp,
  CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' WHEN c_custkey % 7 = 3 THEN TIMESTAMP '2024-06-01 00:00:00' END AS withdrawn_at
FROM customer
UNION ALL
SELECT 'co' || CAST(c_custkey AS STRING), c_custkey, CASE WHEN c_acctbal < 0 THEN 'location' ELSE 'customer_data' END, 'order_support',
  TIMESTAMP '2024-01-20 00:00:00', CAST(NULL AS TIMESTAMP) FROM customer
"""
VIEWS["v_approvals"] = """
SELECT 'a' || CAST(event_id AS STRING) AS approval_id, 'T' || CAST(user_id AS STRING) AS task_id, 'pay_upi' AS tool,
  CASE WHEN event_id % 4 = 0 THEN event_id + 1 ELSE event_id END AS bound_call_id,
  ts - INTERVAL 60 SECOND AS issued_at, ts + INTERVAL 60 SECOND AS expires_at,
  CASE WHEN event_id % 10 = 0 THEN ts - INTERVAL 1 SECOND WHEN event_id % 10 = 5 THEN ts + INTERVAL 31 SECOND WHEN event_id % 10 = 7 THEN ts + INTERVAL 20 SECOND END AS consumed_ts, event_id % 9 <> 0 AS sig_ok,
  CASE WHEN event_id % 14 = 0 THEN 'rejected' WHEN event_id % 15 = 0 THEN 'pending' ELSE 'approved' END AS status,
  CASE WHEN event_id % 11 = 0 THEN 'voice-desk' WHEN event_id % 13 = 0 THEN '' ELSE 'ops' || CAST(event_id % 5 AS STRING) END AS approver
FROM events WHERE event_type = 'purchase' AND value > 20
"""
VIEWS["v_tasks"] = """
SELECT 'K' || CAST(event_id AS STRING) AS task_id, user_id AS session_id, CAST(user_id % 25 AS INT) AS principal,
  CASE WHEN event_id % 3 = 0 THEN 'marketing' WHEN event_id % 3 = 1 THEN 'order_support' ELSE 'payment_processing' END AS purpose,
  CASE WHEN event_id % 4 = 0 THEN 'READ' ELSE 'PAYMENT' END AS category, ts AS created_ts,
  'Pay Rs ' || CAST(CAST(value AS DECIMAL(18,2)) AS STRING) || ' to sup' || CAST(event_id % 10 AS STRING) || '@okbank, (invoice INV-' || CAST(event_id AS STRING) || ').' AS text,
  '{"limit":' || CAST(event_id % 900 AS STRING) || ',"to":"Sup' || CAST(event_id % 10 AS STRING) || '@OkBank","ok":true}' AS params
FROM events WHERE event_type = 'signup'
"""
VIEWS["v_stage_spans"] = """
SELECT event_id AS span_id, event_type AS stage, value AS ms, ts FROM events
"""
VIEWS["v_scores"] = """
SELECT d.doc_id AS clip_id, d.lang, CASE WHEN l.toxic = 1 THEN 'spoof' ELSE 'bonafide' END AS label, d.source,
  CAST((d.doc_id * 37) % 101 + CASE WHEN l.toxic = 1 THEN 45 ELSE 0 END AS DOUBLE) / 150.0 AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
VIEWS["v_outcomes"] = """
SELECT d.doc_id AS scenario_id, CASE WHEN l.toxic = 1 THEN 'attack' ELSE 'benign' END AS kind, d.source AS category, 'on' AS mode,
  CASE WHEN l.toxic = 1 THEN d.doc_id % 12 = 0 ELSE l.quality = 1 OR d.doc_id % 2 = 0 END AS executed,
  CASE WHEN d.n_chars < 300 THEN 'harness_error: timeout' ELSE 'ok' END AS detail
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'attack' ELSE 'benign' END, d.source, 'off',
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE l.quality = 1 OR d.doc_id % 2 = 0 END, 'ok'
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
VIEWS["v_leaves"] = """
SELECT event_id AS idx, '{"call_id":' || CAST(event_id AS STRING) || ',"domain":"' || CASE WHEN event_type = 'click' THEN 'purposelock' ELSE 'payshield' END
  || '","type":"' || event_type || '"}' AS payload FROM events
"""
VIEWS["v_speech"] = """
SELECT conv_id * 1000 + turn AS utt_id, role AS lang, text AS ref,
  CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN regexp_replace(text, '^[^ ]+ ', '') ELSE lower(text) || ' uh' END AS hyp
FROM conversations
"""
VIEWS["v_nonce_issues"] = """
SELECT event_id AS nonce_id, user_id AS session_id, ts AS issued_at, 'amber ' || event_type || ' maple' AS phrase
FROM events WHERE event_type IN ('click', 'view')
"""
VIEWS["v_nonce_attempts"] = """
SELECT event_id AS nonce_id, CASE WHEN event_id % 28 = 0 THEN user_id + 1 ELSE user_id END AS session_id,
  CASE WHEN event_id % 20 = 0 THEN ts + INTERVAL 31 SECOND ELSE ts + INTERVAL 12 SECOND END AS ts,
  CASE WHEN event_id % 12 = 0 THEN 'open the vault' WHEN event_id % 16 = 0 THEN NULL ELSE 'please amber ' || event_type || ' maple thanks' END AS transcript,
  'g' || CAST(event_id % 6 AS STRING) AS digest
FROM events WHERE event_type IN ('click', 'view')
UNION ALL
SELECT event_id, user_id, ts + INTERVAL 20 SECOND, 'amber ' || event_type || ' maple', 'g' || CAST(event_id % 3 AS STRING)
FROM events WHERE event_type = 'view'
UNION ALL
SELECT event_id, user_id, ts + INTERVAL 5 SECOND, 'amber maple', 'g0' FROM events WHERE event_type = 'error'
"""

DEPENDS = {
    name: [v for v in VIEWS if v != name and f"FROM {v}" in text] for name, text in VIEWS.items()
}


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in DEPENDS.get(name, []):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return ordered


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the views it names (and those they name) as common tables."""
    extra = extra or {}
    text = body + " ".join(extra.values())
    used = _closure([v for v in VIEWS if f"{v} " in f"{text} " or f"{v}\n" in text or f"{v})" in text])
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in used]
    parts += [f"{name} AS ({sql.strip()})" for name, sql in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip() if parts else body.strip()


def load(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the base tables a statement names as temporary views."""
    for table in TABLES:
        if not re.search(rf"\b{table}\b", text):
            continue
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A query over the base tables and the views above."""
    if body.startswith("SELECT * FROM ") and body[14:] in TABLES:
        return spark.read.parquet(f"{sf_dir}/{body[14:]}.parquet")
    text = with_views(body)
    load(spark, sf_dir, text)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {name}")
