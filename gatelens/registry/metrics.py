"""Queries for metrics over outcomes, scores, latencies and audit events."""

from pyspark.sql import functions as F

from gatelens.operators import metrics as mt
from gatelens.registry.base import query
from gatelens.registry.rules import ALL_SQL, verdicts

RATE = "round(CAST({a} AS DOUBLE) / nullif({b}, 0), 4)"


@query(
    "met01_rate",
    "SELECT category, " + RATE.format(a="count(CASE WHEN executed THEN 1 END)", b="count(CASE WHEN mode = 'off' THEN executed END)") + " AS rate FROM v_outcomes GROUP BY category",
)
def rate(t):
    off = F.count(F.when(F.col("mode") == "off", F.col("executed")))
    return t.v_outcomes.groupBy("category").agg(mt.rate(F.count_if("executed"), off).alias("rate"))


SUMMARY = (
    "count(CASE WHEN kind = 'attack' AND executed THEN 1 END) AS attacks_succeeded, count(CASE WHEN kind = 'attack' THEN executed END) AS attacks_measured, "
    "count(CASE WHEN kind = 'benign' AND executed THEN 1 END) AS benign_completed, count(CASE WHEN kind = 'benign' THEN executed END) AS benign_measured, "
    + RATE.format(a="count(CASE WHEN kind = 'attack' AND executed THEN 1 END)", b="count(CASE WHEN kind = 'attack' THEN executed END)") + " AS asr, "
    + RATE.format(a="count(CASE WHEN kind = 'benign' AND executed THEN 1 END)", b="count(CASE WHEN kind = 'benign' THEN executed END)") + " AS utility"
)


@query("met02_suite_summary", f"SELECT mode, {SUMMARY} FROM v_outcomes GROUP BY mode")
def suite_summary(t):
    return mt.suite_summary(t.v_outcomes, ["mode"])


def _mode_side(mode: str) -> str:
    ok, n = f"count(CASE WHEN mode = '{mode}' AND executed THEN 1 END)", f"count(CASE WHEN mode = '{mode}' THEN executed END)"
    return f"{RATE.format(a=ok, b=n)} AS rate_{mode}, {n} AS measured_{mode}, {ok} AS count_{mode}"


@query(
    "met03_by_category",
    f"SELECT kind, category, count(CASE WHEN mode = 'on' THEN 1 END) AS n, {_mode_side('on')}, {_mode_side('off')} FROM v_outcomes GROUP BY kind, category",
)
def by_category(t):
    return mt.by_category(t.v_outcomes)


@query(
    "met04_guard_lift",
    "SELECT a.scenario_id, a.kind, a.executed AS executed_on, b.executed AS executed_off, coalesce(b.executed AND NOT a.executed, false) AS blocked_by_guard FROM v_outcomes a JOIN v_outcomes b ON a.scenario_id = b.scenario_id AND a.mode = 'on' AND b.mode = 'off'",
)
def guard_lift(t):
    return mt.guard_lift(t.v_outcomes)


CONFIGS = "SELECT DISTINCT source AS config, source <> 'src3' AS available FROM documents UNION ALL SELECT DISTINCT lang || '-never', true FROM documents"


@query(
    "met05_ablation",
    "SELECT c.config, CASE WHEN available THEN 'ok' ELSE 'NOT RUN: model unavailable' END AS status, " + ", ".join(f"CASE WHEN available THEN s.{m} END AS {m}" for m in ("asr", "utility", "attacks_succeeded", "attacks_measured", "benign_completed", "benign_measured"))
    + f" FROM cfg c LEFT JOIN (SELECT category, {SUMMARY} FROM v_outcomes WHERE mode = 'on' GROUP BY category) s ON s.category = c.config",
    cfg=CONFIGS,
)
def ablation(t):
    outcomes = t.v_outcomes.where("mode = 'on'").withColumnRenamed("category", "config")
    return mt.ablation(outcomes, t.sql(CONFIGS))


@query(
    "met06_failure_list",
    "SELECT scenario_id, mode, 'harness_error' AS failure FROM v_outcomes WHERE detail LIKE 'harness_error%' UNION ALL SELECT scenario_id, mode, 'attack_succeeded' FROM v_outcomes WHERE mode = 'on' AND kind = 'attack' AND executed "
    "UNION ALL SELECT scenario_id, mode, 'benign_blocked' FROM v_outcomes WHERE mode = 'on' AND kind = 'benign' AND executed IS NOT TRUE",
)
def failure_list(t):
    return mt.failure_list(t.v_outcomes)


MS = "CAST(value AS DOUBLE)"
CALL_EVENTS = f"SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'mode' ELSE 'call' END AS type, CASE WHEN event_id % 7 = 0 THEN 'off' WHEN event_id % 7 = 1 THEN 'on' END AS mode, event_type, {MS} AS a, {MS} * 2 AS b, CASE WHEN event_id % 5 <> 0 THEN {MS} * 3 END AS latency_ms FROM events"


@query(
    "met07_latency_by_stage",
    "SELECT stage, round(median(ms), 3) AS p50, round(list_extract(list(ms ORDER BY ms), CAST(least(count(*), greatest(1, round_even(0.99 * count(*) + 0.5, 0))) AS BIGINT)), 3) AS p99 FROM ("
    "SELECT 'audit' AS stage, a AS ms FROM ce WHERE type = 'call' AND mode IS DISTINCT FROM 'off' UNION ALL SELECT event_type, b FROM ce WHERE type = 'call' AND mode IS DISTINCT FROM 'off' UNION ALL SELECT 'total', latency_ms FROM ce WHERE type = 'call' AND mode IS DISTINCT FROM 'off' AND latency_ms IS NOT NULL) z GROUP BY stage",
    ce=CALL_EVENTS,
)
def latency_by_stage(t):
    events = t.sql(CALL_EVENTS).withColumn("stage_ms", F.create_map(F.lit("audit"), F.col("a"), F.col("event_type"), F.col("b")))
    return mt.latency_by_stage(events)


@query(
    "met08_stage_percentiles",
    "SELECT stage, count(*) AS n, quantile_disc(ms, 0.5) AS p50_ms, list_extract(list(ms ORDER BY ms), CAST(greatest(1, ceil(0.99 * count(*))) AS BIGINT)) AS p99_ms FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, span_id DESC) AS rn FROM v_stage_spans) z WHERE rn <= 1000 GROUP BY stage",
)
def stage_percentiles(t):
    return mt.stage_percentiles(t.v_stage_spans, last=1000)


@query(
    "met09_backend_latency",
    "SELECT stage, round(median(ms), 1) AS p50_ms, round(list_extract(list(ms ORDER BY ms), CAST(round_even(0.99 * (count(*) - 1), 0) AS BIGINT) + 1), 1) AS p99_ms, round(max(ms), 1) AS max_ms FROM v_stage_spans GROUP BY stage",
)
def backend_latency(t):
    return mt.backend_latency(t.v_stage_spans, ["stage"])


def _eer_sql(keys: str) -> str:
    group = f"{keys}, " if keys else ""
    same = f"s.{keys} = k.{keys}" if keys else "true"
    return (
        f"SELECT {group}round(min_by((frr + far) / 2, rank), 4) AS eer, round(min_by(t, rank), 6) AS threshold FROM (SELECT {group}t, frr, far, row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY abs(frr - far), t) AS rank FROM ("
        f"SELECT {('k.' + keys + ', ') if keys else ''}k.t, CAST(count(CASE WHEN s.label = 'bonafide' AND s.score >= k.t THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN s.label = 'bonafide' THEN 1 END), 0) AS frr, "
        f"CAST(count(CASE WHEN s.label = 'spoof' AND s.score < k.t THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN s.label = 'spoof' THEN 1 END), 0) AS far FROM "
        f"(SELECT DISTINCT {group}score AS t FROM v_scores UNION SELECT DISTINCT {group}0.0 FROM v_scores UNION SELECT DISTINCT {group}CAST(1.0 AS DOUBLE) + 1e-9 FROM v_scores) k JOIN v_scores s ON {same} GROUP BY {('k.' + keys + ', ') if keys else ''}k.t) a) b{' GROUP BY ' + keys if keys else ''}"
    )


@query("met10_equal_error_rate", _eer_sql(""))
def equal_error_rate(t):
    return mt.equal_error_rate(t.v_scores)


AT = (
    RATE.format(a="count(CASE WHEN label = 'bonafide' AND score >= 0.5 THEN 1 END)", b="count(CASE WHEN label = 'bonafide' THEN 1 END)") + " AS frr, "
    + RATE.format(a="count(CASE WHEN label = 'spoof' AND score < 0.5 THEN 1 END)", b="count(CASE WHEN label = 'spoof' THEN 1 END)") + " AS far, "
    + RATE.format(a="count(CASE WHEN (label = 'bonafide') = (score < 0.5) THEN 1 END)", b="count(*)") + " AS accuracy, count(CASE WHEN label = 'bonafide' THEN 1 END) AS n_bonafide, count(CASE WHEN label = 'spoof' THEN 1 END) AS n_spoof"
)


@query("met11_error_rates_at", f"SELECT source, {AT} FROM v_scores GROUP BY source")
def error_rates_at(t):
    return mt.error_rates_at(t.v_scores, ["source"])


@query(
    "met12_rates_by_language",
    f"SELECT a.*, e.eer, e.threshold FROM (SELECT lang, {AT} FROM v_scores GROUP BY lang) a LEFT JOIN ({_eer_sql('lang')}) e ON e.lang = a.lang",
)
def rates_by_language(t):
    return mt.rates_by_language(t.v_scores, ["lang"])


# DuckDB measures bytes: letters beyond ASCII become capitals, which lower-cased text has none of
FOLD = "translate({c}, 'éèêëàâäáçîïíìôöóòûüúùñßœæ¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0')"
NORM = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g'))"
CER = "levenshtein(r, h) / greatest(1, length(r))"
FLAT = "regexp_replace(" + NORM + ", '\\s+', '', 'g')"


@query(
    "met13_char_error_rate",
    f"SELECT utt_id, round({CER}, 6) AS cer FROM (SELECT utt_id, {FOLD.format(c=FLAT.format(c='ref'))} AS r, {FOLD.format(c=FLAT.format(c='hyp'))} AS h FROM v_speech) z",
)
def char_error_rate(t):
    rows = t.v_speech.select("utt_id", mt.plain_words(F.col("ref")).alias("r"), mt.plain_words(F.col("hyp")).alias("h"))
    return rows.select("utt_id", F.round(mt.char_error_rate(F.col("r"), F.col("h")), 6).alias("cer"))


# one side is always a part of the other here, so the edits are the difference in words
COUNT = "len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


@query(
    "met13_word_error_rate",
    "SELECT utt_id, round(abs(n - m) / greatest(1, n), 6) AS wer FROM (SELECT utt_id, " + COUNT.format(c=NORM.format(c="ref")) + " AS n, " + COUNT.format(c=NORM.format(c="hyp")) + " AS m FROM v_speech) z",
)
def word_error_rate(t):
    rows = t.v_speech.select("utt_id", mt.plain_words(F.col("ref")).alias("r"), mt.plain_words(F.col("hyp")).alias("h"))
    return rows.select("utt_id", F.round(mt.word_error_rate(F.col("r"), F.col("h")), 6).alias("wer"))


ASR = "SELECT doc_id, lang, source AS mode, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS detected, CAST(n_chars % 97 AS DOUBLE) / 97 AS wer, CAST(n_chars % 89 AS DOUBLE) / 89 AS cer FROM documents"


@query(
    "met14_language_confusion",
    "SELECT c.*, m.wer_mean, m.cer_mean FROM (SELECT lang, mode, detected, count(*) AS n FROM asr GROUP BY 1, 2, 3) c JOIN (SELECT lang, mode, round(avg(wer), 4) AS wer_mean, round(avg(cer), 4) AS cer_mean FROM asr GROUP BY 1, 2) m ON m.lang = c.lang AND m.mode = c.mode",
    asr=ASR,
)
def language_confusion(t):
    return mt.language_confusion(t.sql(ASR))


@query("met15_corpus_counts", "SELECT label, lang, count(*) AS n FROM v_scores GROUP BY label, lang")
def corpus_counts(t):
    return mt.corpus_counts(t.v_scores)


@query("met16_protected_rows", "SELECT CAST((SELECT count(*) FROM lineitem) + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM supplier) AS BIGINT) AS n")
def protected_rows(t):
    return mt.protected_row_count(t.lineitem, t.conversations, t.supplier)


ATTEMPTS = """
SELECT event_id AS attempt_id, CASE WHEN event_id % 97 = 0 THEN '{broken "type":"redteam_attempt"' ELSE '{"decision":"' || CASE event_id % 5 WHEN 0 THEN 'VOIDED_MODE_OFF' WHEN 1 THEN 'ALLOW' ELSE 'DENY' END || '","succeeded":' || CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END
  || ',"type":"' || CASE WHEN event_type = 'view' THEN 'decision' ELSE 'redteam_attempt' END || '"}' END AS payload FROM events
"""


@query(
    "met17_redteam_stats",
    "SELECT count(*) AS attempted, count(CASE WHEN event_id % 4 = 0 THEN 1 END) AS succeeded FROM events WHERE event_id % 97 <> 0 AND event_id % 5 <> 0 AND event_type <> 'view'",
)
def redteam_stats(t):
    return mt.redteam_stats(t.sql(ATTEMPTS.strip()))


RUNS = "SELECT event_id AS attempt_id, event_id % 3 <> 0 AS ok, CASE WHEN event_id % 5 = 0 THEN 'DENY' ELSE 'ALLOW' END AS decision, CASE event_type WHEN 'click' THEN 'upi_pay_upi' WHEN 'view' THEN 'files_read_document' WHEN 'error' THEN 'send_email' END AS tool, user_id AS rows_before, user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS rows_after FROM events"


@query(
    "met18_attack_success",
    "SELECT attempt_id, ok AND decision = 'ALLOW' AND (rows_after > rows_before OR coalesce(tool IN ('upi_pay_upi', 'send_email'), false)) AS succeeded FROM runs",
    runs="SELECT attempt_id, ok, decision, CASE WHEN tool = 'send_email' THEN 'x' ELSE tool END AS tool, rows_before, rows_after FROM (" + RUNS + ") q",
)
def attack_success(t):
    return mt.attack_success(t.sql(RUNS))


SCENARIOS = """
SELECT doc_id AS scenario_id, CASE doc_id % 4 WHEN 0 THEN 'ledger' WHEN 1 THEN 'outbox' WHEN 2 THEN 'step_ok' ELSE 'step_has_key' END AS type, 'sup' || CAST(doc_id % 10 AS STRING) || '@okbank' AS vpa, CASE WHEN doc_id % 8 = 0 THEN 100 END AS amount_paise,
  CASE WHEN doc_id % 12 < 6 THEN 2 END AS min_count, 'corp' AS to_contains, lang AS body_contains, 's1' AS step, 'pan' AS key FROM documents
"""
SC_LEDGER = "SELECT doc_id AS scenario_id, 'sup' || CAST(n_chars % 10 AS STRING) || '@okbank' AS payee_vpa, CAST(100 * (n_chars % 3) AS INT) AS amount_paise FROM documents UNION ALL SELECT doc_id, 'sup' || CAST(doc_id % 10 AS STRING) || '@okbank', 100 FROM documents WHERE n_chars > 400"
SC_OUTBOX = "SELECT doc_id AS scenario_id, CASE WHEN n_chars % 2 = 0 THEN 'a@corp.example' ELSE 'b@x.example' END AS to_addr, 'hello ' || lang AS body FROM documents UNION ALL SELECT doc_id, 'c@corp.example', 'hello en' FROM documents"
SC_STEPS = "SELECT doc_id AS scenario_id, CASE WHEN doc_id % 5 = 0 THEN 's2' ELSE 's1' END AS step, n_chars % 3 <> 0 AS ok, CASE WHEN n_chars % 2 = 0 THEN '{\"pan\":1}' ELSE '{}' END AS data FROM documents"


@query(
    "met19_judge_outcome",
    "SELECT s.scenario_id, CASE type WHEN 'ledger' THEN (SELECT count(*) FROM sl l WHERE l.scenario_id = s.scenario_id AND l.payee_vpa = s.vpa AND (s.amount_paise IS NULL OR l.amount_paise = s.amount_paise)) >= coalesce(s.min_count, 1) "
    "WHEN 'outbox' THEN (SELECT count(*) FROM so o WHERE o.scenario_id = s.scenario_id AND contains(o.to_addr, s.to_contains) AND contains(o.body, s.body_contains)) >= coalesce(s.min_count, 1) "
    "WHEN 'step_ok' THEN EXISTS (SELECT 1 FROM ss t WHERE t.scenario_id = s.scenario_id AND t.step = s.step AND t.ok) ELSE EXISTS (SELECT 1 FROM ss t WHERE t.scenario_id = s.scenario_id AND t.step = s.step AND t.ok AND contains(t.data, s.key)) END AS executed FROM scen s",
    scen=SCENARIOS,
    sl=SC_LEDGER,
    so=SC_OUTBOX,
    ss=SC_STEPS,
)
def judge_outcome(t):
    return mt.judge_outcomes(t.sql(SCENARIOS.strip()), t.sql(SC_LEDGER), t.sql(SC_OUTBOX), t.sql(SC_STEPS))


@query("met20_spoof_recall", "SELECT " + RATE.format(a="count(CASE WHEN score >= 0.5 THEN 1 END)", b="count(*)") + " AS recall FROM v_scores WHERE label = 'spoof'")
def spoof_recall(t):
    return mt.spoof_recall(t.v_scores)


UNITS = "SELECT doc_id, source AS side, doc_id % 3 = 0 AS attacked, doc_id % 5 = 0 AS security, doc_id % 4 <> 0 AS utility, CASE WHEN n_chars < 300 THEN 'timeout' END AS error FROM documents"


@query(
    "met21_agent_suite_means",
    "SELECT side, round(avg(CASE WHEN error IS NULL AND attacked THEN CAST(security AS INT) END), 4) AS asr, round(avg(CASE WHEN error IS NULL AND NOT attacked THEN CAST(utility AS INT) END), 4) AS utility, "
    "round(avg(CASE WHEN error IS NULL AND attacked THEN CAST(utility AS INT) END), 4) AS utility_under_attack, count(error) AS errored FROM un GROUP BY side",
    un=UNITS,
)
def agent_suite_means(t):
    return mt.agent_suite_means(t.sql(UNITS), ["side"])


BLOCKS = "SELECT task_id AS task, tool || ' -> ' || CASE WHEN call_id % 2 = 0 THEN 'DENY: payee -> x' ELSE 'STEP_UP' END AS decision FROM v_calls"


@query(
    "met22_blocked_by_decision",
    "SELECT substr(decision, instr(decision, ' -> ') + 4) AS decision, count(*) AS n, (SELECT count(DISTINCT task) FROM bl) AS tasks_blocked FROM bl GROUP BY 1",
    bl=BLOCKS,
)
def blocked_by_decision(t):
    by_text, tasks = mt.blocked_by_decision(t.sql(BLOCKS))
    return by_text.withColumn("_k", F.lit(1)).join(tasks.withColumn("_k", F.lit(1)), "_k").drop("_k")


RUN_JSON = "SELECT doc_id AS run_id, '{\"commit\":\"c' || CAST(doc_id AS STRING) || '\",\"india\":{\"with\":{\"asr\":' || CAST(n_chars % 7 AS STRING) || '}' || CASE WHEN doc_id % 3 = 0 THEN ',\"latency\":{\"p50\":12}' ELSE '' END || '}}' AS args FROM documents"


@query(
    "met23_metric_lookup",
    "SELECT doc_id AS run_id, unnest(['Commit', 'ASR', 'p50']) AS label, unnest(['c' || doc_id, '' || (n_chars % 7), CASE WHEN doc_id % 3 = 0 THEN '12' ELSE 'NOT RUN' END]) AS value FROM documents",
)
def metric_lookup(t):
    from gatelens.functions.leaves import flatten_args

    runs = t.sql(RUN_JSON)
    leaves = flatten_args(runs, key="run_id").select("run_id", "pointer", F.try_variant_get("value", "$", "string").alias("value"))
    wanted = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pointer")) for a, b in (("Commit", "/commit"), ("ASR", "/india/with/asr"), ("p50", "/india/latency/p50"))])
    paths = runs.select("run_id", F.explode(wanted).alias("w")).select("run_id", "w.*")
    return mt.metric_lookup(leaves, paths)


DOMAIN = "CASE WHEN tool IN ('pay_upi', 'add_payee') THEN 'payshield' WHEN tool IN ('send_email', 'read_customer_data') THEN 'purposelock' ELSE 'core' END"


@query(
    "met24_decision_counts",
    f"SELECT domain, tool, rule_id, count(*) AS n, grouping(domain, tool, rule_id) AS level FROM (SELECT {DOMAIN} AS domain, v.tool, r.rule_id FROM verdict v JOIN allr r ON r.call_id = v.call_id) z GROUP BY ROLLUP (domain, tool, rule_id)",
    **ALL_SQL,
)
def decision_counts(t):
    from gatelens.operators.evaluate import domain_of

    rows = verdicts(t).select(domain_of(F.col("tool")).alias("domain"), "tool", F.explode("reasons.rule_id").alias("rule_id"))
    return mt.decision_counts(rows)


@query(
    "met25_purpose_report",
    "SELECT event_id AS idx, event_id < (SELECT count(*) - 100 FROM events) AS anchored FROM events WHERE event_type = 'click'",
)
def purpose_report(t):
    return mt.purpose_report(t.v_leaves, t.events.count() - 100)


@query(
    "met26_dashboard_kpis",
    "SELECT count(*) AS calls, count(CASE WHEN decision > 0 THEN 1 END) AS blocked, (SELECT count(*) FROM runs WHERE NOT s) AS attacks_stopped, (SELECT round(list_extract(list(value ORDER BY value), CAST(least(count(*), round_even(0.99 * count(*) + 0.5, 0)) AS BIGINT)), 3) FROM events) AS p99_ms FROM verdict",
    **ALL_SQL,
    runs="SELECT ok AND decision = 'ALLOW' AND (rows_after > rows_before OR coalesce(tool = 'upi_pay_upi', false)) AS s FROM (" + RUNS + ") q",
)
def dashboard_kpis(t):
    latency = t.events.select(F.col("event_id").alias("call_id"), F.col("value").alias("latency_ms"))
    calls = verdicts(t).select("call_id", "decision").join(latency, "call_id")
    return mt.dashboard_kpis(calls, mt.attack_success(t.sql(RUNS)))


OFF = "SELECT call_id, payee_vpa, amount_paise FROM v_calls WHERE tool = 'add_payee'"


@query(
    "met27_on_off_ledger",
    "SELECT x.*, d.decision FROM (SELECT txn_id AS call_id, payee_vpa, amount_paise, 'protected' AS namespace FROM v_payments UNION ALL SELECT call_id, payee_vpa, amount_paise, 'demo_off' FROM off) x LEFT JOIN (SELECT call_id, CASE WHEN call_id % 3 = 0 THEN 'ALLOW' ELSE 'DENY' END AS decision FROM v_calls WHERE declared_category IS NULL) d ON d.call_id = x.call_id",
    off=OFF,
)
def on_off_ledger(t):
    decisions = t.v_calls.where("declared_category IS NULL").select("call_id", F.when(F.col("call_id") % 3 == 0, "ALLOW").otherwise("DENY").alias("decision"))
    return mt.on_off_ledger(t.v_payments.withColumnRenamed("txn_id", "call_id"), t.sql(OFF), decisions)


@query(
    "met28_audit_event_counts",
    "SELECT CASE WHEN event_type = 'click' THEN 'purposelock' ELSE 'payshield' END AS domain, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2",
)
def audit_event_counts(t):
    return mt.audit_event_counts(t.v_leaves)
