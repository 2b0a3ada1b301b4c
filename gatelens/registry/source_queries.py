"""Queries for sources and sinks, windows, sorting and set forms."""

import pandas as pd
from pyspark.sql import functions as F

from gatelens.operators import approvals as ap
from gatelens.registry.base import query
from gatelens.session import scratch
from gatelens.sources import tables as tb

LEDGER = "SELECT 't' || CAST(txn_id AS STRING) AS txn_id, CAST(principal AS STRING) AS principal_id, 'acc' AS account_id, payee_vpa, amount_paise, amount_paise AS balance_after, '' AS note, CAST(NULL AS STRING) AS task_id, CAST(txn_id AS STRING) AS call_id, ts FROM v_payments"


@query("src01_read_table", "SELECT 't' || txn_id AS txn_id, CAST(principal AS VARCHAR) AS principal_id, amount_paise, ts FROM v_payments")
def read_table(t):
    path = scratch(t.spark, "ledger")
    t.sql(LEDGER).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return tb.read_table(t.spark, "ledger", path).select("txn_id", "principal_id", "amount_paise", "ts")


MIXED = "SELECT event_id AS idx, CASE event_id % 9 WHEN 0 THEN '{broken' WHEN 1 THEN '[1]' WHEN 2 THEN '\"text\"' ELSE '{\"n\":' || CAST(event_id AS STRING) || '}' END AS payload FROM events"


@query("src02_read_audit_log", "SELECT event_id AS idx, event_id AS n FROM events WHERE event_id % 9 > 2")
def read_audit_log(t):
    return tb.read_audit_log(t.sql(MIXED)).select("idx", F.try_variant_get("event", "$.n", "bigint").alias("n"))


@query(
    "src04_read_documents",
    "SELECT 'page' || page_id || CASE WHEN page_id % 3 = 0 THEN '_inject' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.txt' END AS name, CASE WHEN page_id % 3 = 0 THEN 'external' ELSE 'user_upload' END AS trust, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'text/plain' END AS mime, length(html) AS chars FROM pages",
)
def read_documents(t):
    folder = scratch(t.spark, "docs")
    name = F.expr("'page' || page_id || CASE WHEN page_id % 3 = 0 THEN '_inject' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.txt' END")

    local = folder.removeprefix("file:")

    def store(batches):
        import os

        os.makedirs(local, exist_ok=True)
        for pdf in batches:
            for row in pdf.itertuples():
                with open(f"{local}/{row.name}", "w", encoding="utf-8", newline="") as out:
                    out.write(row.html)
            yield pd.DataFrame({"n": [len(pdf)]})

    t.pages.select(name.alias("name"), "html").mapInPandas(store, "n long").agg(F.sum("n")).collect()
    return tb.read_documents(t.spark, folder).select("name", "trust", "mime", F.length("content").cast("long").alias("chars"))


CUSTOMER_JSON = """
SELECT '{' || CASE c_custkey % 3 WHEN 0 THEN '"customer_id":"C' || CAST(c_custkey AS STRING) || '",' WHEN 1 THEN '"id":' || CAST(c_custkey AS STRING) || ',' ELSE '"customer_id":"","id":"I' || CAST(c_custkey AS STRING) || '",' END
  || CASE WHEN c_custkey % 4 = 0 THEN '"principal":"p' || CAST(c_custkey AS STRING) || '",' ELSE '' END || '"name":"' || c_name || '","email":"c@x.example","segment":"' || c_mktsegment || '","age":' || CAST(c_nationkey AS STRING) || '}' AS value FROM customer
"""


@query(
    "src05_read_customers",
    "SELECT id AS customer_id, CASE WHEN c_custkey % 4 = 0 THEN 'p' || c_custkey ELSE id END AS principal_id, c_name AS name, 'c@x.example' AS email, CASE WHEN c_custkey % 4 = 0 THEN '{\"age\":' || c_nationkey || ',\"principal\":\"p' || c_custkey || '\",\"segment\":\"' || c_mktsegment || '\"}' "
    "ELSE '{\"age\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}' END AS extra FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'C' || c_custkey WHEN 1 THEN '' || c_custkey ELSE 'I' || c_custkey END AS id FROM customer) z",
)
def read_customers(t):
    path = scratch(t.spark, "customers")
    t.sql(CUSTOMER_JSON.strip()).write.text(path)
    return tb.read_customers(t.spark, path).select("customer_id", "principal_id", "name", "email", "extra")


@query("src06_read_consents", "SELECT consent_id, purpose, exp FROM v_consents UNION ALL SELECT consent_id, 'audit', exp FROM v_consents WHERE withdrawn_at IS NULL")
def read_consents(t):
    path = scratch(t.spark, "consents")
    purposes = F.expr("CASE WHEN withdrawn_at IS NULL THEN '[\"' || purpose || '\",\"audit\"]' ELSE '[\"' || purpose || '\"]' END")
    rows = t.v_consents.select("consent_id", F.col("principal_id").cast("string"), "category", purposes.alias("purposes"), F.col("exp").cast("timestamp"), F.col("withdrawn_at").cast("timestamp"))
    rows.write.parquet(path)
    return tb.read_consents(t.spark, path).select("consent_id", F.explode("purposes").alias("purpose"), "exp")


MANIFEST = """
SELECT 'clip' || CAST(doc_id AS STRING) AS file, 's' AS speaker_id, CASE doc_id % 5 WHEN 0 THEN 'clone' WHEN 1 THEN 'other' ELSE 'real' END AS type, 'clean' AS condition, lang AS language, CASE WHEN doc_id % 7 = 0 THEN 'no' ELSE ' YES ' END AS consent,
  CASE WHEN doc_id % 11 = 0 THEN 'abc' ELSE CAST(n_chars % 50 AS STRING) END AS duration_s, CASE WHEN doc_id % 2 = 0 THEN 'm1' END AS source_model, 'mit' AS source_license FROM documents
"""
CLIPS = "SELECT 'clip' || CAST(doc_id AS STRING) AS file, CAST(n_chars % 50 AS DOUBLE) + CASE WHEN doc_id % 13 = 0 THEN 0.2 ELSE 0.05 END AS actual_s FROM documents WHERE source <> 'src1'"


@query(
    "src07_validate_manifest",
    "SELECT m.file, p AS problem FROM man m LEFT JOIN cl c ON c.file = m.file, LATERAL (SELECT unnest([CASE WHEN m.consent = 'no' THEN 'consent must be ''yes''' END, CASE WHEN m.type = 'other' THEN 'type must be real or clone' END, CASE WHEN m.type = 'clone' AND m.source_model IS NULL THEN 'clone rows need source_model and source_license' END, "
    "CASE WHEN c.file IS NULL THEN 'file missing' WHEN m.duration_s = 'abc' THEN 'unreadable duration or wav' WHEN abs(CAST(m.duration_s AS DOUBLE) - c.actual_s) > 0.1 THEN 'duration differs from the file' END]) AS p) x WHERE p IS NOT NULL",
    man=MANIFEST,
    cl=CLIPS,
)
def validate_manifest(t):
    path = scratch(t.spark, "manifest")
    t.sql(MANIFEST.strip()).select(*tb.MANIFEST).write.option("header", True).csv(path)
    return tb.validate_manifest(tb.read_manifest(t.spark, path), t.sql(CLIPS))


@query("src08_read_results", "SELECT 'r' || p_partkey AS commit, p_size AS asr, CASE WHEN p_size > 25 THEN p_brand END AS voice FROM part")
def read_results(t):
    folder = scratch(t.spark, "results")
    docs = t.part.select(
        F.expr("'{\"commit\":\"r' || p_partkey || '\",\"with\":{\"asr\":' || p_size || '}' || CASE WHEN p_size > 25 THEN ',\"voice\":\"' || p_brand || '\"}' ELSE '}' END").alias("value")
    )
    docs.write.text(folder)
    lines = tb.read_results_lines(t.spark, folder, ["commit", "with", "voice"])
    return lines.select(
        F.try_variant_get("commit", "$", "string").alias("commit"),
        F.try_variant_get("with", "$.asr", "int").alias("asr"),
        F.try_variant_get("voice", "$", "string").alias("voice"),
    )


@query(
    "src08_read_results_files",
    "SELECT p_brand AS commit, max(p_size) AS asr, CASE WHEN count(*) % 2 = 0 THEN 'v' || count(*) END AS voice FROM part GROUP BY p_brand",
)
def read_results_files(t):
    folder = scratch(t.spark, "results")
    docs = t.part.groupBy("p_brand").agg(F.max("p_size").alias("s"), F.count("*").alias("n"))
    value = "'{\"commit\":\"' || p_brand || '\",\\n\"with\":{\"asr\":' || s || '}' || CASE WHEN n % 2 = 0 THEN ',\"voice\":\"v' || n || '\"}' ELSE '}' END"
    docs.select(F.expr(value).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    found = tb.read_results(t.spark, folder, ["commit", "with", "voice"])
    return found.select(
        F.try_variant_get("commit", "$", "string").alias("commit"),
        F.try_variant_get("with", "$.asr", "int").alias("asr"),
        F.try_variant_get("voice", "$", "string").alias("voice"),
    )


WRITES = "SELECT user_id AS key, value AS amount, event_id FROM events WHERE event_type = 'signup'"
KEPT = "SELECT c_custkey AS key, c_acctbal AS amount, CAST(-1 AS BIGINT) AS event_id FROM customer WHERE c_acctbal > 0"


@query(
    "src09_insert_or_ignore",
    "SELECT key, min(event_id) AS event_id, min_by(amount, event_id) AS amount FROM w WHERE key NOT IN (SELECT key FROM k) GROUP BY key",
    w=WRITES,
    k=KEPT,
)
def insert_or_ignore(t):
    return tb.insert_or_ignore(t.sql(WRITES), t.sql(KEPT), ["key"], ["event_id"])


@query(
    "src10_insert_or_replace",
    "SELECT key, max(event_id) AS event_id, max_by(amount, event_id) AS amount FROM (SELECT * FROM w UNION ALL SELECT * FROM k) z GROUP BY key",
    w=WRITES,
    k=KEPT,
)
def insert_or_replace(t):
    return tb.insert_or_replace(t.sql(WRITES), t.sql(KEPT), ["key"], ["event_id"])


@query("src11_write_report", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def write_report(t):
    path = scratch(t.spark, "report")
    tb.write_report(t.documents.groupBy("source", "lang").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("lang string, n long, source string").json(path)


@query("src12_read_after", "SELECT event_id, event_type FROM events WHERE event_id > 5000")
def read_after(t):
    return tb.read_after(t.events.select("event_id", "event_type"), 5000, "event_id")


SPANS = "SELECT CASE WHEN event_id % 3 = 0 THEN 'tool.' ELSE 'stage.' END || event_type AS name, CAST(event_id AS BIGINT) * 1000000 AS start_ns, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id AS BIGINT) * 1000000 + CAST(floor(value * 1000) AS BIGINT) END AS end_ns FROM events"


@query("src13_read_stage_spans", "SELECT substr(name, 7) AS stage, (end_ns - start_ns) / 1e6 AS ms FROM sp WHERE name LIKE 'stage.%' AND end_ns IS NOT NULL", sp=SPANS)
def read_stage_spans(t):
    return tb.read_stage_spans(t.sql(SPANS))


@query(
    "src14_systematic_sample",
    "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) z WHERE i % greatest(1, n // 20) = 0 AND i // greatest(1, n // 20) < 20",
)
def systematic_sample(t):
    return tb.systematic_sample(t.documents.select("doc_id", "lang"), ["lang"], ["doc_id"], 20)


@query(
    "src14_systematic_sample_by_name",
    "SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY 'k' || (c_custkey % 100), c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) z WHERE i % greatest(1, n // 7) = 0 AND i // greatest(1, n // 7) < 7",
)
def systematic_sample_by_name(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", F.expr("'k' || (c_custkey % 100)").alias("name"))
    return tb.systematic_sample(rows, ["c_mktsegment"], ["name", "c_custkey"], 7).drop("name")


OFF_CALLS = "SELECT call_id, ts, tool, CASE WHEN tool IN ('read_document', 'read_customer_data') THEN 'READ' WHEN tool = 'pay_upi' THEN 'PAYMENT' END AS category, payee_vpa, amount_paise, CASE WHEN amount_paise % 2 = 0 THEN 'off' ELSE 'on' END AS mode FROM v_calls"


@query(
    "src15_off_mode_route",
    "SELECT call_id, CASE WHEN tool = 'read_document' THEN 'passed' ELSE 'UNGUARDED' END AS decision, CASE WHEN tool = 'pay_upi' THEN payee_vpa END AS payee_vpa, CASE WHEN tool = 'read_document' THEN NULL WHEN tool = 'pay_upi' THEN amount_paise ELSE 0 END AS amount_paise FROM oc WHERE mode = 'off'",
    oc=OFF_CALLS,
)
def off_mode_route(t):
    passed, ledger = tb.off_mode_route(t.sql(OFF_CALLS))
    ran = passed.select("call_id", F.lit("passed").alias("decision"), F.lit(None).cast("string").alias("payee_vpa"), F.lit(None).cast("long").alias("amount_paise"))
    return ran.unionByName(ledger.select("call_id", "decision", "payee_vpa", "amount_paise"))


# ---------------------------------------------------------------- windows, sorting, sets
FEED = "SELECT user_id AS feed, event_id AS seq FROM events"


@query(
    "win06_sequence_gaps",
    "SELECT feed, prev + 1 AS gap_from, seq - 1 AS gap_to FROM (SELECT feed, seq, lag(seq) OVER (PARTITION BY feed ORDER BY seq) AS prev FROM f) z WHERE seq > prev + 1",
    f=FEED,
)
def sequence_gaps(t):
    return tb.sequence_gaps(t.sql(FEED), ["feed"])


@query("win07_last_n_per_feed", "SELECT feed, seq FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY seq DESC) AS rn FROM f) z WHERE rn <= 5", f=FEED)
def last_n(t):
    return tb.last_n(t.sql(FEED), ["feed"], 5)


@query(
    "win09_attempts_in_window",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS recent FROM events",
)
def attempts_in_window(t):
    return tb.attempts_in_window(t.events, ["user_id"], seconds=43_200).select("event_id", "recent")


APPROVALS = "SELECT approval_id, status, issued_at AS created_ts, consumed_ts, approver FROM v_approvals"


@query("srt02_approval_queue", "SELECT approval_id, status, issued_at AS created_ts FROM v_approvals ORDER BY status = 'pending' DESC, issued_at, approval_id")
def approval_queue(t):
    return ap.approval_queue(t.sql(APPROVALS)).select("approval_id", "status", "created_ts")


@query("srt07_resolved_history", "SELECT approval_id, approver, issued_at AS created_ts FROM v_approvals WHERE status <> 'pending'")
def resolved_history(t):
    resolved = t.sql(APPROVALS).where("status <> 'pending'").orderBy("created_ts", "approval_id")
    return resolved.select("approval_id", "approver", "created_ts")


@query("srt06_top_head", "SELECT (max(event_id) + 1) // 16 * 16 AS size FROM events")
def top_head(t):
    from gatelens.operators.audit import head_schedule

    heads = head_schedule(t.v_leaves)
    return heads.agg(F.max("size").alias("size"))
