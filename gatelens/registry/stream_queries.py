"""Streaming queries: the whole event table runs through a stream, the result is a table."""

from pyspark.sql import functions as F

from gatelens.operators import evaluate as ev
from gatelens.registry.audits import ROOTED
from gatelens.registry.base import query
from gatelens.registry.rules import ALL_SQL, RULES, facts
from gatelens.registry.views import with_views
from gatelens.session import scratch
from gatelens.streaming import streams as st


def _events(t):
    schema = t.events.schema
    stream = st.read_call_stream(t.spark, f"{t.sf_dir}/event*.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _shaped(t, body: str):
    """A view over the event stream instead of the event table."""
    _events(t).createOrReplaceTempView("events")
    return t.spark.sql(with_views(body))


def seconds():
    return st.epoch_seconds(F.col("ts"))


@query("src03_read_call_stream", "SELECT event_id, event_type, value FROM events")
def read_call_stream(t):
    return st.run_available(_events(t).select("event_id", "event_type", "value"), "calls")


@query("stm01_score_stream", "SELECT call_id, decision, rules FROM verdict", **ALL_SQL)
def score_stream(t):
    labels, known = t.v_call_labels, facts(t)
    labels_at, facts_at, out = (scratch(t.spark, n) for n in ("labels", "facts", "scored"))
    labels.write.parquet(labels_at)
    known.write.parquet(facts_at)
    labels, known = t.spark.read.parquet(labels_at), t.spark.read.parquet(facts_at)

    def decide(batch):
        decided = ev.evaluate_policy(batch, labels, RULES, facts=known)
        return decided.select("call_id", "decision", F.array_join(F.transform("reasons", lambda r: r["rule_id"]), ",").alias("rules"))

    st.score_stream(_shaped(t, "SELECT * FROM v_call_args"), decide, out)
    return t.spark.read.parquet(out).drop("batch")


@query("stm02_dedup_calls", "SELECT DISTINCT user_id FROM events")
def dedup_calls(t):
    # every user is a "call id" here; the watermark spans the whole table
    kept = st.dedup_calls(_events(t).select("user_id", "ts"), "user_id", "ts", "90 days")
    return st.run_available(kept, "dedup").select("user_id")


@query(
    "stm03_gap_alerts",
    "SELECT feed, prev + 1 AS gap_from, seq - 1 AS gap_to FROM (SELECT user_id AS feed, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) z WHERE seq > prev + 1",
)
def gap_alerts(t):
    feed = _events(t).select(F.col("user_id").alias("feed"), F.col("event_id").alias("seq"))
    return st.run_available(st.gap_alerts(feed), "gaps")


NONCES = """
SELECT nonce_id, 'issue' AS kind, 0 AS kind_order, session_id, issued_at AS ts, CAST(NULL AS BOOLEAN) AS heard FROM v_nonce_issues
UNION ALL SELECT nonce_id, 'attempt', 1, session_id, ts, contains(transcript, 'amber') FROM v_nonce_attempts
"""


@query(
    "stm04_nonce_match",
    "SELECT nonce_id, session_id, liveness, count(*) AS n FROM (SELECT a.nonce_id, a.session_id, CASE WHEN NOT own OR (u.ts IS NOT NULL AND a.ts > u.ts) THEN 'mismatch' WHEN late THEN 'expired' WHEN transcript IS NULL THEN 'unknown' WHEN contains(transcript, 'amber') THEN 'match' ELSE 'mismatch' END AS liveness FROM ("
    "SELECT a.*, coalesce(i.session_id = a.session_id AND a.ts >= i.issued_at, false) AS own, a.ts > i.issued_at + INTERVAL 30 SECOND AS late FROM v_nonce_attempts a LEFT JOIN v_nonce_issues i ON i.nonce_id = a.nonce_id) a LEFT JOIN (SELECT a.nonce_id, min(a.ts) AS ts FROM v_nonce_attempts a JOIN v_nonce_issues i "
    "ON i.nonce_id = a.nonce_id AND i.session_id = a.session_id AND a.ts >= i.issued_at WHERE a.transcript IS NOT NULL OR a.ts > i.issued_at + INTERVAL 30 SECOND GROUP BY a.nonce_id) u ON u.nonce_id = a.nonce_id) z GROUP BY 1, 2, 3",
)
def nonce_match(t):
    mixed = _shaped(t, NONCES.strip()).withColumn("ts", seconds())
    return st.run_available(st.nonce_match(mixed), "nonces").groupBy("nonce_id", "session_id", "liveness").agg(F.count("*").alias("n"))


TOKENS = """
SELECT 'tok' || CAST(event_id AS STRING) AS token_id, 'issue' AS kind, 0 AS kind_order, ts, ts + INTERVAL 120 SECOND AS expires, CAST(user_id AS STRING) AS digest FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'tok' || CAST(event_id AS STRING), 'use', 1, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 120 SECOND ELSE ts + INTERVAL 90 SECOND END, CAST(NULL AS TIMESTAMP), CAST(CASE WHEN event_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS STRING) FROM events
UNION ALL SELECT 'tok' || CAST(event_id AS STRING), 'use', 1, ts + INTERVAL 100 SECOND, CAST(NULL AS TIMESTAMP), CAST(user_id AS STRING) FROM events WHERE event_type = 'click'
"""


@query(
    "stm05_approval_expiry",
    "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'replay' WHEN event_id % 3 = 0 THEN 'expired' WHEN event_id % 4 = 0 THEN 'mismatch' ELSE 'valid' END AS verdict FROM events "
    "UNION ALL SELECT CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 'valid' ELSE 'replay' END FROM events WHERE event_type = 'click') z GROUP BY verdict",
)
def approval_expiry(t):
    mixed = _shaped(t, TOKENS.strip()).withColumns({"ts": seconds(), "expires": st.epoch_seconds(F.col("expires"))})
    return st.run_available(st.approval_expiry(mixed), "approvals").groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "stm06_token_replay",
    "SELECT nonce, call_id FROM (SELECT 'n' || (event_id // 3) AS nonce, event_id AS call_id, row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts, event_id) AS rn FROM events) z WHERE rn > 1",
)
def token_replay(t):
    nonce = F.concat(F.lit("n"), F.floor(F.col("event_id") / 3).cast("string"))
    uses = _events(t).select(nonce.alias("nonce"), seconds().alias("ts"), F.col("event_id").alias("call_id"))
    return st.run_available(st.token_replay(uses), "replay")


# the bucket, the sliding limit and the daily cap feed back on themselves: their checks walk each key row by row
REQUESTS = "SELECT user_id AS client, event_id AS request_id, epoch_us(ts) / 1e6 / 1000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"
BUCKET = (
    "SELECT client, request_id, rn, sec, true AS admitted, CAST(4.0 AS DOUBLE) AS tokens FROM req WHERE rn = 1 UNION ALL SELECT client, request_id, rn, sec, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END FROM "
    "(SELECT r.*, least(CAST(5.0 AS DOUBLE), w.tokens + (r.sec - w.sec) * CAST(5 / 60.0 AS DOUBLE)) AS t FROM walk w JOIN req r ON r.client = w.client AND r.rn = w.rn + 1) z"
)


@query("stm07_rate_limit", "SELECT client, request_id, admitted FROM walk", req=REQUESTS, walk=BUCKET)
def rate_limit(t):
    requests = _events(t).select(F.col("user_id").alias("client"), (seconds() / 1000).alias("ts"), F.col("event_id").alias("request_id"))
    return st.run_available(st.rate_limit(requests, per_minute=5), "rate")


RECENT = (
    "SELECT client, request_id, rn, sec, true AS admitted, [sec] AS times FROM req WHERE rn = 1 UNION ALL SELECT client, request_id, rn, sec, len(recent) < 5, CASE WHEN len(recent) < 5 THEN list_append(recent, sec) ELSE recent END FROM "
    "(SELECT r.*, list_filter(w.times, lambda x: x > r.sec - 60) AS recent FROM walk w JOIN req r ON r.client = w.client AND r.rn = w.rn + 1) z"
)


@query("stm08_sliding_attempts", "SELECT client, request_id, admitted FROM walk", req=REQUESTS.replace("/ 1000", "/ 3000"), walk=RECENT)
def sliding_attempts(t):
    requests = _events(t).select(F.col("user_id").alias("client"), (seconds() / 3000).alias("ts"), F.col("event_id").alias("request_id"))
    return st.run_available(st.sliding_attempts(requests), "sliding")


PAYS = "SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY principal, CAST(ts AS DATE) ORDER BY ts, txn_id) AS rn FROM v_payments"
SPENT = (
    "SELECT txn_id, principal, day, rn, amount_paise <= 20000 AS allowed, CASE WHEN amount_paise <= 20000 THEN amount_paise ELSE 0 END AS spent FROM pays WHERE rn = 1 UNION ALL "
    "SELECT p.txn_id, p.principal, p.day, p.rn, w.spent + p.amount_paise <= 20000, CASE WHEN w.spent + p.amount_paise <= 20000 THEN w.spent + p.amount_paise ELSE w.spent END FROM walk w JOIN pays p ON p.principal = w.principal AND p.day = w.day AND p.rn = w.rn + 1"
)
CAPPED = "SELECT txn_id, principal, ts, amount_paise, CAST(CAST(ts AS DATE) AS STRING) AS day, CAST(20000 AS BIGINT) AS daily_cap FROM v_payments"


@query("stm09_daily_cap_stream", "SELECT txn_id, principal, allowed, spent FROM walk", pays=PAYS, walk=SPENT)
def daily_cap_stream(t):
    return st.run_available(st.daily_cap_stream(_shaped(t, CAPPED).withColumn("ts", seconds())), "cap")


#: Rows of a file of a dealt batch, about.
FILE_ROWS = 250_000


def _mixed(t, rows, keys, batches=4):
    """A table as a stream whose batches are cut across time, with two late rows that end the wait.

    Batches go by the hash of ``keys`` and time, so each holds rows from the whole span of time. The
    late rows have no ``keys``. Every batch, the late ones too, has the same number of files.
    """
    path = scratch(t.spark, "mixed")
    last, n = rows.agg(F.max("ts").alias("ts"), F.count("*")).first()
    files = max(1, -(-n // (batches * FILE_ROWS)))
    kinds = rows.dtypes
    blank = rows.limit(1).withColumns({c: F.lit(None).cast(dict(kinds)[c]) for c in keys})
    dealt = rows.withColumn("_batch", F.pmod(F.xxhash64(*keys, "ts"), F.lit(batches)))
    for k in range(batches):
        some = dealt.where(F.col("_batch") == k).drop("_batch")
        some = some.repartition(files) if files > 1 else some.coalesce(1)
        some.write.mode("append").parquet(path)
    each = t.spark.range(0, files, 1, files)
    for k in (1, 2):
        late = each.crossJoin(F.broadcast(blank.withColumn("ts", F.lit(last + k * 1e9)))).drop(each["id"])
        late.write.mode("append").parquet(path)
    schema = ", ".join(f"{c} {kind}" for c, kind in kinds)
    return st.read_call_stream(t.spark, path, schema, files_per_trigger=files)


#: Longer than the events span: an order across all of them.
WAIT = "4000 days"


USED = (
    "SELECT a.nonce_id, min(a.ts) AS ts FROM v_nonce_attempts a JOIN v_nonce_issues i ON i.nonce_id = a.nonce_id AND i.session_id = a.session_id AND a.ts >= i.issued_at WHERE a.transcript IS NOT NULL OR a.ts > i.issued_at + INTERVAL 30 SECOND GROUP BY a.nonce_id"
)


@query(
    "stm04_nonce_match_ordered",
    "SELECT a.nonce_id, a.session_id, epoch_us(a.ts) / 1e6 AS ts, CASE WHEN NOT own OR (u.ts IS NOT NULL AND a.ts > u.ts) THEN 'mismatch' WHEN late THEN 'expired' WHEN transcript IS NULL THEN 'unknown' WHEN contains(transcript, 'amber') THEN 'match' ELSE 'mismatch' END AS liveness FROM ("
    "SELECT a.*, coalesce(i.session_id = a.session_id AND a.ts >= i.issued_at, false) AS own, a.ts > i.issued_at + INTERVAL 30 SECOND AS late FROM v_nonce_attempts a LEFT JOIN v_nonce_issues i ON i.nonce_id = a.nonce_id) a LEFT JOIN used u ON u.nonce_id = a.nonce_id",
    used=USED,
)
def nonce_match_ordered(t):
    mixed = _mixed(t, t.sql(NONCES.strip()).withColumn("ts", seconds()), ["nonce_id", "kind"])
    found = st.run_available(st.nonce_match(mixed, delay=WAIT, ordered=True, keep_seconds=1e9), "nonces")
    return found.where("nonce_id IS NOT NULL").select("nonce_id", "session_id", "ts", "liveness")


@query(
    "stm05_approval_expiry_ordered",
    "SELECT token_id, epoch_us(used) / 1e6 AS ts, verdict FROM (SELECT 'tok' || event_id AS token_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 120 SECOND ELSE ts + INTERVAL 90 SECOND END AS used, CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'replay' WHEN event_id % 3 = 0 THEN 'expired' WHEN event_id % 4 = 0 THEN 'mismatch' ELSE 'valid' END AS verdict FROM events "
    "UNION ALL SELECT 'tok' || event_id, ts + INTERVAL 100 SECOND, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 'valid' ELSE 'replay' END FROM events WHERE event_type = 'click') z",
)
def approval_expiry_ordered(t):
    rows = t.sql(TOKENS.strip()).withColumns({"ts": seconds(), "expires": st.epoch_seconds(F.col("expires"))})
    mixed = _mixed(t, rows, ["token_id", "kind"])
    found = st.run_available(st.approval_expiry(mixed, delay=WAIT, ordered=True, keep_seconds=1e9), "approvals")
    return found.where("token_id IS NOT NULL")


@query(
    "stm06_token_replay_ordered",
    "SELECT nonce, call_id FROM (SELECT 'n' || (event_id % 900) AS nonce, event_id AS call_id, row_number() OVER (PARTITION BY event_id % 900 ORDER BY ts, event_id) AS rn FROM events) z WHERE rn > 1",
)
def token_replay_ordered(t):
    nonce = F.concat(F.lit("n"), (F.col("event_id") % 900).cast("string"))
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).select(nonce.alias("nonce"), seconds().alias("ts"), F.col("event_id").alias("call_id"))
    found = st.run_available(st.token_replay(_mixed(t, rows, ["nonce", "call_id"]), delay=WAIT, ordered=True, keep_seconds=1e9), "replay")
    return found.where("nonce IS NOT NULL")


@query("stm09_daily_cap_ordered", "SELECT txn_id, principal, allowed, spent FROM walk", pays=PAYS, walk=SPENT)
def daily_cap_ordered(t):
    mixed = _mixed(t, t.sql(CAPPED).withColumn("ts", seconds()), ["txn_id"])
    found = st.run_available(st.daily_cap_stream(mixed, delay=WAIT, ordered=True, keep_seconds=1e9), "cap")
    return found.where("txn_id IS NOT NULL")


CLOSED = "time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "stm10_stage_metrics_window",
    f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS stage, count(*) AS n, list_extract(list(value ORDER BY value), CAST(ceil(0.5 * count(*)) AS BIGINT)) AS p50_ms, list_extract(list(value ORDER BY value), CAST(ceil(0.99 * count(*)) AS BIGINT)) AS p99_ms FROM events WHERE {CLOSED} GROUP BY 1, 2",
)
def stage_metrics_window(t):
    spans = _events(t).select("ts", F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return st.run_available(st.stage_metrics_window(spans), "stages")


@query(
    "stm11_decision_counts_window",
    f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS calls, count(CASE WHEN event_id % 3 > 0 THEN 1 END) AS blocked, count(CASE WHEN event_id % 3 = 2 THEN 1 END) AS denied FROM events WHERE {CLOSED} GROUP BY 1",
)
def decision_counts_window(t):
    decisions = _events(t).select("ts", (F.col("event_id") % 3).alias("decision"))
    return st.run_available(st.decision_counts_window(decisions), "decisions")


BEHIND = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
COUNTS = "count(*) AS calls, count(CASE WHEN event_id % 3 > 0 THEN 1 END) AS blocked, count(CASE WHEN event_id % 3 = 2 THEN 1 END) AS denied"


@query(
    "stm11_decision_counts_sliding",
    f"SELECT window_start, {COUNTS} FROM (SELECT event_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events) z "
    f"WHERE window_start + INTERVAL 1 HOUR <= {BEHIND} GROUP BY 1",
)
def decision_counts_sliding(t):
    decisions = _events(t).select("ts", (F.col("event_id") % 3).alias("decision"))
    return st.run_available(st.decision_counts_window(decisions, slide="30 minutes"), "decisions")


@query(
    "stm11_decision_counts_session",
    f"SELECT user_id, min(ts) AS session_start, {COUNTS} FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) y) z "
    f"GROUP BY user_id, sid HAVING max(ts) + INTERVAL 6 HOUR <= {BEHIND}",
)
def decision_counts_session(t):
    decisions = _events(t).select("user_id", "ts", (F.col("event_id") % 3).alias("decision"))
    return st.run_available(st.decision_counts_session(decisions, "user_id", gap="6 hours"), "sessions")


@query(
    "jon13_stream_interval_join",
    "SELECT a.nonce_id, a.session_id, a.ts FROM v_nonce_issues i JOIN v_nonce_attempts a ON a.nonce_id = i.nonce_id AND a.ts >= i.issued_at AND a.ts <= i.issued_at + INTERVAL 30 SECOND",
)
def stream_interval_join(t):
    issues, attempts = _shaped(t, "SELECT * FROM v_nonce_issues"), _shaped(t, "SELECT * FROM v_nonce_attempts")
    return st.run_available(st.attempts_in_time(issues, attempts), "attempts")


@query(
    "stm12_consent_withdrawal_stream",
    "SELECT c.consent_id, coalesce(c.withdrawn_at, w.ts) AS withdrawn_at FROM v_consents c LEFT JOIN (SELECT 'cn' || (user_id * 3) AS consent_id, min(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY 1) w ON w.consent_id = c.consent_id",
)
def consent_withdrawals(t):
    consents = t.v_consents.withColumns({c: F.col(c).cast("timestamp") for c in ("exp", "withdrawn_at")})
    events = _shaped(t, "SELECT 'cn' || CAST(user_id * 3 AS STRING) AS consent_id, ts FROM events WHERE event_type = 'error'")
    path = scratch(t.spark, "consent-table")
    st.consent_withdrawals(events, consents, path)
    return st.latest_version(t.spark, path).select("consent_id", "withdrawn_at")


@query("stm13_append_audit_stream", "SELECT idx, sha256(from_hex('00') || encode(payload)) AS leaf_hash FROM v_leaves")
def append_audit(t):
    rows = _shaped(t, "SELECT idx AS seq, payload FROM v_leaves")
    path = scratch(t.spark, "audit")
    st.append_audit(rows, path)
    return t.spark.read.parquet(path).select("idx", "leaf_hash")


@query("stm13_audit_heads", "SELECT size, root FROM roots", **ROOTED)
def audit_heads(t):
    # three batches, cut where no subtree ends
    rows = t.v_leaves.withColumnRenamed("idx", "seq")
    folder, path = scratch(t.spark, "leaves"), scratch(t.spark, "audit")
    n = t.events.count()
    edges = [0, n // 3 + 1, n // 2 + 3, n]
    for a, b in zip(edges, edges[1:], strict=False):
        rows.where(F.col("seq").between(a, b - 1 if b < n else 1 << 60)).coalesce(1).write.mode("append").parquet(folder)
    stream = st.read_call_stream(t.spark, folder, "seq bigint, payload string", files_per_trigger=1)
    st.append_audit(stream, path, heads=16)
    return t.spark.read.parquet(f"{path}-heads").select("size", "root")


@query("stm14_redact_stream", "SELECT event_id, 'call [REDACTED:email] &lt;now&gt;' AS note FROM events")
def redact_stream(t):
    notes = _shaped(t, "SELECT event_id, 'call c' || CAST(user_id AS STRING) || '@mail.example <now>' AS note FROM events")
    return st.run_available(st.redact_stream(notes, ["note"]), "redact")


@query(
    "stm15_late_events",
    "SELECT feed, seq, coalesce(seq <= max(seq) OVER (PARTITION BY feed ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM (SELECT user_id AS feed, event_id AS seq, event_id + CASE WHEN event_id % 10 = 0 THEN 1500.5 ELSE 0.0 END AS arrival FROM events) z",
)
def late_events(t):
    feed = _shaped(t, "SELECT user_id AS feed, event_id AS seq, CAST(event_id + CASE WHEN event_id % 10 = 0 THEN 1500.5 ELSE 0.0 END AS DOUBLE) AS arrival FROM events")
    return st.run_available(st.late_events(feed), "late")
