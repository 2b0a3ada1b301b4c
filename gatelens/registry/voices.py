"""Queries for voice clips, challenges and the voice decision."""

from pyspark.sql import functions as F

from gatelens.operators import voice as vo
from gatelens.registry.base import query

FRAME, RATE = 4, 16
CLIP = "SELECT vec_id AS clip_id, embedding AS samples FROM embeddings"
ENERGY = (
    "SELECT vec_id AS clip_id, i AS frame, list_sum(list_transform(embedding[i * 4 + 1 : i * 4 + 4], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 4 AS energy "
    "FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 4)) AS i FROM embeddings) z"
)
DECILES = (
    "SELECT clip_id, count(*) AS n, list_avg(list(energy ORDER BY energy DESC)[1 : greatest(1, count(*) // 10)]) AS top, list_avg(list(energy ORDER BY energy)[1 : greatest(1, count(*) // 10)]) AS bottom FROM en GROUP BY clip_id"
)
# every third clip is stretched so that loud and quiet frames differ
LOUD = "CASE WHEN clip_id % 3 = 0 AND i < 8 THEN 100.0 WHEN clip_id % 3 = 1 AND i >= 8 AND i < 12 THEN 0.001 ELSE 1.0 END"


def _clips(t):
    scaled = F.transform(
        "samples",
        lambda v, i: v.cast("double")
        * F.when((F.col("clip_id") % 3 == 0) & (i < 8), 100.0)
        .when((F.col("clip_id") % 3 == 1) & (i >= 8) & (i < 12), 0.001)
        .otherwise(1.0),
    )
    return t.sql(CLIP).withColumn("samples", scaled)


SCALED = "SELECT vec_id, list_transform(embedding, lambda v, j: CAST(v AS DOUBLE) * CASE WHEN vec_id % 3 = 0 AND j <= 8 THEN 100.0 WHEN vec_id % 3 = 1 AND j > 8 AND j <= 12 THEN 0.001 ELSE 1.0 END) AS embedding FROM embeddings"
PARTS = {"sc": SCALED, "en": ENERGY.replace("FROM embeddings", "FROM sc"), "de": DECILES}


@query("vox01_frame_energies", "SELECT clip_id, frame, round(energy, 9) AS energy FROM en", en=ENERGY)
def frame_energies(t):
    return vo.frame_energies(t.sql(CLIP), frame=FRAME).withColumn("energy", F.round("energy", 9))


@query(
    "vox02_clip_quality",
    "SELECT c.vec_id AS clip_id, CASE WHEN len(c.embedding) / 16.0 NOT BETWEEN 1 AND 15 THEN 'low' WHEN d.n < 10 THEN 'unknown' WHEN 10 * log10(greatest(d.top, 1e-12) / greatest(d.bottom, 1e-12)) < 10 THEN 'low' ELSE 'ok' END AS quality, "
    "CASE WHEN len(c.embedding) / 16.0 BETWEEN 1 AND 15 AND d.n >= 10 THEN round(10 * log10(greatest(d.top, 1e-12) / greatest(d.bottom, 1e-12)), 4) END AS snr_db FROM sc c LEFT JOIN de d ON d.clip_id = c.vec_id",
    **PARTS,
)
def clip_quality(t):
    return vo.clip_quality(_clips(t), frame=FRAME, sample_rate=RATE).select("clip_id", "quality", F.round("snr_db", 4).alias("snr_db"))


@query(
    "vox03_vad_bounds",
    "SELECT e.clip_id, min(CASE WHEN e.energy > greatest(d.bottom * 4, d.top * 0.02) THEN e.frame END) AS first_frame, max(CASE WHEN e.energy > greatest(d.bottom * 4, d.top * 0.02) THEN e.frame END) AS last_frame FROM en e JOIN de d ON d.clip_id = e.clip_id GROUP BY e.clip_id",
    **PARTS,
)
def vad_bounds(t):
    return vo.vad_bounds(_clips(t), frame=FRAME)


@query(
    "vox04_liveness_distance",
    "SELECT a.nonce_id, a.transcript, round(min(CASE WHEN a.transcript IS NULL THEN NULL ELSE levenshtein(i.phrase, w) / greatest(length(i.phrase), length(w)) END), 6) AS distance FROM v_nonce_issues i JOIN (SELECT DISTINCT nonce_id, transcript, unnest(list_concat(list_transform(range(1, greatest(1, len(tk) - 1) + 1), lambda s: array_to_string(tk[s : s + 1], ' ')), "
    "list_concat(list_transform(range(1, greatest(1, len(tk) - 2) + 1), lambda s: array_to_string(tk[s : s + 2], ' ')), list_transform(range(1, greatest(1, len(tk) - 3) + 1), lambda s: array_to_string(tk[s : s + 3], ' '))))) AS w FROM "
    "(SELECT nonce_id, transcript, regexp_extract_all(lower(transcript), '[a-z0-9]+') AS tk FROM v_nonce_attempts) q) a ON a.nonce_id = i.nonce_id WHERE a.transcript IS NOT NULL GROUP BY a.nonce_id, a.transcript",
)
def liveness_distance(t):
    heard = t.v_nonce_attempts.where("transcript IS NOT NULL").select("nonce_id", "transcript").distinct()
    rows = heard.join(t.v_nonce_issues, "nonce_id")
    return rows.select("nonce_id", "transcript", F.round(vo.liveness_distance(F.col("phrase"), F.col("transcript")), 6).alias("distance"))


ATTEMPTS = "SELECT CAST(nonce_id AS STRING) || '-' || CAST(ts AS STRING) AS attempt_id, * FROM v_nonce_attempts"
STATES = """
SELECT a.nonce_id, a.session_id, a.ts, a.digest, a.transcript, CASE WHEN NOT own OR (u.ts IS NOT NULL AND a.ts > u.ts) THEN 'mismatch' WHEN late THEN 'expired' WHEN transcript IS NULL THEN 'unknown'
  WHEN contains(transcript, 'amber') AND contains(transcript, event_type) THEN 'match' ELSE 'mismatch' END AS liveness FROM (
  SELECT a.*, e.event_type, coalesce(i.session_id = a.session_id AND a.ts >= i.issued_at, false) AS own, a.ts > i.issued_at + INTERVAL 30 SECOND AS late FROM v_nonce_attempts a LEFT JOIN v_nonce_issues i ON i.nonce_id = a.nonce_id LEFT JOIN events e ON e.event_id = a.nonce_id) a
LEFT JOIN (SELECT a.nonce_id, min(a.ts) AS ts FROM v_nonce_attempts a JOIN v_nonce_issues i ON i.nonce_id = a.nonce_id AND i.session_id = a.session_id AND a.ts >= i.issued_at WHERE a.transcript IS NOT NULL OR a.ts > i.issued_at + INTERVAL 30 SECOND GROUP BY a.nonce_id) u ON u.nonce_id = a.nonce_id
"""


def _states(t):
    attempts = t.v_nonce_attempts.withColumn("attempt_id", F.concat_ws("-", F.col("nonce_id").cast("string"), F.col("ts").cast("string"), "digest"))
    return vo.liveness_states(attempts, t.v_nonce_issues)


@query("vox05_liveness_state", "SELECT nonce_id, session_id, ts, liveness FROM st", st=STATES)
def liveness_state(t):
    return _states(t).select("nonce_id", "session_id", "ts", "liveness")


SIGNALS = """
SELECT event_id AS clip_id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'low' ELSE 'unknown' END AS quality, CASE user_id % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'expired' ELSE 'unknown' END AS liveness,
  event_id % 5 <> 0 AS asr_ran, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 49 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(event_id % 8 AS DOUBLE) / 10.0 END AS spoof, CASE WHEN event_type = 'purchase' THEN 'high' ELSE 'low' END AS sink FROM events
"""
HIGH = "coalesce(spoof >= 0.5 OR isnan(spoof), false)"
SUSPECT = "coalesce(spoof >= 0.2 AND spoof < 0.5, false)"


@query(
    "vox06_voice_decision",
    f"SELECT clip_id, CASE WHEN liveness IN ('mismatch', 'expired') OR {HIGH} THEN 2 WHEN liveness = 'unknown' OR {SUSPECT} OR quality <> 'ok' OR NOT asr_ran OR sink = 'high' THEN 1 ELSE 0 END AS decision, "
    f"concat_ws(',', CASE WHEN NOT asr_ran THEN 'VOICETRUST.ASR.NOT_RUN' END, CASE liveness WHEN 'expired' THEN 'VOICETRUST.LIVENESS.EXPIRED' WHEN 'mismatch' THEN 'VOICETRUST.LIVENESS.MISMATCH' WHEN 'unknown' THEN 'VOICETRUST.LIVENESS.UNKNOWN' END, "
    f"CASE WHEN quality <> 'ok' THEN 'VOICETRUST.QUALITY.INSUFFICIENT' END, CASE WHEN sink = 'high' THEN 'VOICETRUST.SINK.HIGH_RISK' END, CASE WHEN {HIGH} THEN 'VOICETRUST.SPOOF.HIGH' WHEN {SUSPECT} THEN 'VOICETRUST.SPOOF.SUSPECT' END) AS rules FROM sg",
    sg=SIGNALS,
)
def voice_decision(t):
    return vo.voice_decision(t.sql(SIGNALS.strip())).select("clip_id", "decision", F.array_join("rules", ",").alias("rules"))


@query(
    "vox07_voice_facts",
    f"SELECT clip_id, quality = 'ok' AS voice_quality_ok, asr_ran AS voice_asr_ran, liveness = 'match' AS voice_liveness_match, liveness = 'mismatch' AS voice_liveness_mismatch, liveness = 'expired' AS voice_liveness_expired, "
    f"spoof IS NOT NULL AS voice_spoof_ran, {HIGH} AS voice_spoof_high, {SUSPECT} AS voice_spoof_suspect, sink = 'high' AS voice_sink_high FROM sg",
    sg=SIGNALS,
)
def voice_facts(t):
    return vo.voice_facts(t.sql(SIGNALS.strip()), "clip_id")


@query(
    "vox08_resume_after_approval",
    "SELECT s.nonce_id, s.ts, CASE WHEN r THEN 'match' ELSE liveness END AS liveness, r AS resumed FROM (SELECT s.*, coalesce(s.liveness = 'mismatch' AND m.digest = s.digest AND s.digest <> 'g2', false) AS r FROM st s LEFT JOIN (SELECT nonce_id, session_id, digest FROM st WHERE liveness = 'match') m ON m.nonce_id = s.nonce_id AND m.session_id = s.session_id) s",
    st=STATES,
)
def resume_after_approval(t):
    approvals = t.v_nonce_attempts.select("digest", (F.col("digest") != "g2").alias("valid"))
    states = _states(t)
    return vo.resume_after_approval(states, approvals).join(states.select("attempt_id", "nonce_id", "ts"), "attempt_id").select("nonce_id", "ts", "liveness", "resumed")


@query(
    "vox09_spoof_probability",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value / 500 WHEN event_id % 4 = 1 THEN CASE WHEN value / 300 <= 1 THEN value / 300 END WHEN event_id % 4 = 2 THEN CASE WHEN value / 300 <= 1 THEN 1 - value / 300 END END AS p FROM events",
)
def spoof_probability(t):
    score = F.col("value") / 300
    label = F.when(F.col("event_id") % 4 == 1, "Spoofed").when(F.col("event_id") % 4 == 2, "bonafide").otherwise("other")
    scores = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("spoof"), F.col("value") / 500))
    out = F.array(F.struct(label.alias("label"), score.alias("score"), scores.alias("all_scores")))
    return t.events.select("event_id", vo.spoof_probability(out).alias("p"))


@query(
    "vox10_pick_model",
    "SELECT user_id, min(p50) AS p50_ms, CASE WHEN min(p50) <= 2000 THEN '1B' ELSE '500M' END AS model FROM (SELECT user_id, event_type, list_extract(list(value * 40 ORDER BY value), CAST(count(*) // 2 + 1 AS BIGINT)) AS p50 FROM events GROUP BY 1, 2) z GROUP BY user_id",
)
def pick_model(t):
    rows = t.events.select("user_id", F.col("event_type").alias("device"), (F.col("value") * 40).alias("ms"))
    return vo.pick_model(rows, ["user_id"])
