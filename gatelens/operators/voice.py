"""Voice-clip tables: signal quality, liveness, and the voice decision.

A clip is one row; its samples are one array column, so everything about the signal is a Column
over that row and needs no shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import decibels, let, normalised_distance
from gatelens.operators.ruleset import ALLOW, DENY, STEP_UP
from gatelens.plans.order_stats import order_statistics
from gatelens.plans.skew import lookup, oldest_per_key

SAMPLE_RATE = 16_000
FRAME = 320
MIN_SECONDS, MAX_SECONDS = 1.0, 15.0
MIN_FRAMES = 10
MIN_SNR_DB = 10.0
NONCE_TTL_SECONDS = 30
MAX_DISTANCE = 0.25
SPOOF_DENY, SPOOF_STEP_UP = 0.5, 0.2


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return total / F.size(values)


def energies(samples: Column, *, frame: int = FRAME) -> Column:
    """Mean square of each full frame; a shorter tail is dropped."""
    count = F.floor(F.size(samples) / frame).cast("int")
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.aggregate(
                F.slice(samples, i * frame + 1, F.lit(frame)),
                F.lit(0.0),
                lambda a, v: a + v.cast("double") * v.cast("double"),
            )
            / frame,
        ),
    ).otherwise(F.array().cast("array<double>"))


def frame_energies(clips: DataFrame, *, frame: int = FRAME) -> DataFrame:
    """``clip_id``, ``frame``, ``energy``."""
    return clips.select(
        "clip_id", F.posexplode(energies(F.col("samples"), frame=frame)).alias("frame", "energy")
    )


def deciles(frames: Column) -> Column:
    """Struct(top, bottom): mean energy of the loudest and quietest tenth of the frames."""
    k = F.greatest(F.lit(1), F.floor(F.size(frames) / 10).cast("int"))
    return let(
        F.struct(F.array_sort(frames).alias("e"), k.alias("k")),
        lambda x: F.struct(
            _mean(F.slice(x["e"], F.size(x["e"]) - x["k"] + 1, x["k"])).alias("top"),
            _mean(F.slice(x["e"], F.lit(1), x["k"])).alias("bottom"),
        ),
    )


def clip_quality(
    clips: DataFrame, *, frame: int = FRAME, sample_rate: int = SAMPLE_RATE
) -> DataFrame:
    """``quality`` (ok, low, unknown), ``duration_s`` and ``snr_db`` of each clip."""
    duration = F.size("samples") / F.lit(float(sample_rate))
    rows = clips.select(
        "clip_id",
        F.col("samples").isNull().alias("_none"),
        duration.alias("duration_s"),
        energies(F.col("samples"), frame=frame).alias("_e"),
    ).withColumn("_d", F.when(F.size("_e") > 0, deciles(F.col("_e"))))
    fits = F.col("duration_s").between(MIN_SECONDS, MAX_SECONDS)
    finite = ~F.exists("_e", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    estimated = fits & (F.size("_e") >= MIN_FRAMES) & finite
    rows = rows.withColumn(
        "snr_db", F.when(estimated, decibels(F.col("_d.top"), F.col("_d.bottom")))
    )
    quality = (
        F.when(F.col("_none"), "unknown")
        .when(~fits, "low")
        .when(F.col("snr_db").isNull(), "unknown")
        .when(F.col("snr_db") < MIN_SNR_DB, "low")
        .otherwise("ok")
    )
    return rows.select("clip_id", quality.alias("quality"), "duration_s", "snr_db")


def vad_bounds(clips: DataFrame, *, frame: int = FRAME) -> DataFrame:
    """First and last active frame of each clip over its own threshold, NULL without one."""
    rows = clips.select("clip_id", energies(F.col("samples"), frame=frame).alias("_e")).withColumn(
        "_d", F.when(F.size("_e") > 0, deciles(F.col("_e")))
    )
    limit = F.greatest(F.col("_d.bottom") * 4.0, F.col("_d.top") * 0.02)
    active = F.array_compact(F.transform("_e", lambda v, i: F.when(v > F.col("_limit"), i)))
    return (
        rows.withColumn("_limit", limit)
        .withColumn("_a", active)
        .select(
            "clip_id",
            F.array_min("_a").alias("first_frame"),
            F.array_max("_a").alias("last_frame"),
        )
    )


# ---------------------------------------------------------------- liveness


def liveness_distance(phrase: Column, transcript: Column) -> Column:
    """Least normalised edit distance of the phrase over word windows of about its length."""
    words = F.filter(F.split(phrase, " "), lambda w: w != "")
    heard = F.regexp_extract_all(F.lower(transcript), F.lit("[a-z0-9]+"), 0)

    def over(pair: Column) -> Column:
        n = F.size(pair["words"])
        target = F.array_join(pair["words"], " ")
        sizes = F.array_distinct(F.array(F.greatest(F.lit(1), n - 1), n, n + 1))

        def windows(size: Column) -> Column:
            last = F.greatest(F.lit(1), F.size(pair["heard"]) - size + 1)
            return F.transform(
                F.sequence(F.lit(1), last),
                lambda i: normalised_distance(
                    target, F.array_join(F.slice(pair["heard"], i, size), " ")
                ),
            )

        best = F.array_min(F.flatten(F.transform(sizes, windows)))
        nothing = (F.size(pair["heard"]) == 0) | (target == "")
        return F.when(nothing, F.lit(1.0)).otherwise(F.least(F.lit(1.0), best))

    return let(F.struct(words.alias("words"), heard.alias("heard")), over)


def liveness_states(
    attempts: DataFrame, issues: DataFrame, *, ttl: int = NONCE_TTL_SECONDS
) -> DataFrame:
    """Liveness of each attempt on a challenge: match, mismatch, expired or unknown.

    ``attempts``: attempt_id, nonce_id, session_id, ts, transcript. ``issues``: nonce_id,
    session_id, issued_at, phrase. The first attempt that is too late or has a transcript uses
    the challenge up. Without a transcript nothing was attempted. Exactly ``ttl`` seconds is
    still in time.
    """
    known = issues.select(
        "nonce_id", F.col("session_id").alias("_session"), "issued_at", "phrase"
    )
    rows = lookup(attempts, known, ["nonce_id"])
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("issued_at").cast("timestamp"))) / 1e6
    own = F.coalesce(
        (F.col("session_id") == F.col("_session")) & (F.col("ts") >= F.col("issued_at")),
        F.lit(False),
    )
    rows = rows.withColumns({"_own": own, "_late": age > ttl})
    order = F.struct(F.col("ts"), F.col("attempt_id"))
    users = rows.where(F.col("_own") & (F.col("_late") | F.col("transcript").isNotNull()))
    used = oldest_per_key(
        users.select("nonce_id", "ts", "attempt_id"), ["nonce_id"], ["ts", "attempt_id"]
    ).select("nonce_id", F.struct("ts", "attempt_id").alias("_used"))
    rows = lookup(rows, used, ["nonce_id"])
    after = F.coalesce(order > F.col("_used"), F.lit(False))
    distance = liveness_distance(F.col("phrase"), F.col("transcript"))
    state = (
        F.when(~F.col("_own") | after, "mismatch")
        .when(F.col("_late"), "expired")
        .when(F.col("transcript").isNull(), "unknown")
        .when(distance <= MAX_DISTANCE, "match")
        .otherwise("mismatch")
    )
    return rows.select(*attempts.columns, state.alias("liveness"))


def resume_after_approval(states: DataFrame, approvals: DataFrame) -> DataFrame:
    """Attempts whose used-up challenge counts again: it had matched for the very same call and
    a human approved that call.

    ``states``: attempt_id, session_id, nonce_id, digest, ts, liveness. ``approvals``: digest,
    valid.
    """
    key = ["session_id", "nonce_id"]
    matched = oldest_per_key(
        states.where("liveness = 'match'").select(*key, "ts", F.col("digest").alias("_bound")),
        key,
        ["ts"],
    ).select(*key, "_bound")
    approved = approvals.where("valid").select("digest").distinct().withColumn("_ok", F.lit(True))
    rows = lookup(lookup(states, matched, key), approved, ["digest"])
    resumed = (
        (F.col("liveness") == "mismatch")
        & (F.col("_bound") == F.col("digest"))
        & F.coalesce("_ok", F.lit(False))
    )
    resumed = F.coalesce(resumed, F.lit(False))
    return rows.select(
        "attempt_id",
        F.when(resumed, "match").otherwise(F.col("liveness")).alias("liveness"),
        resumed.alias("resumed"),
    )


# ---------------------------------------------------------------- decision
_DENIES = ("VOICETRUST.LIVENESS.MISMATCH", "VOICETRUST.LIVENESS.EXPIRED", "VOICETRUST.SPOOF.HIGH")


def _spoof_high() -> Column:
    # a score that is not a number is as bad as a high one
    return F.coalesce((F.col("spoof") >= SPOOF_DENY) | F.isnan("spoof"), F.lit(False))


def _spoof_suspect() -> Column:
    return F.coalesce(~_spoof_high() & (F.col("spoof") >= SPOOF_STEP_UP), F.lit(False))


def voice_decision(signals: DataFrame) -> DataFrame:
    """``decision`` and sorted ``rules`` from quality, liveness, asr_ran, spoof and sink."""
    not_ok = ~F.coalesce(F.col("quality") == "ok", F.lit(False))
    not_low = ~F.coalesce(F.col("sink") == "low", F.lit(False))
    rules = F.array_compact(
        F.array(
            F.when(F.col("liveness") == "mismatch", F.lit("VOICETRUST.LIVENESS.MISMATCH"))
            .when(F.col("liveness") == "expired", F.lit("VOICETRUST.LIVENESS.EXPIRED"))
            .when(
                ~F.coalesce(F.col("liveness") == "match", F.lit(False)),
                F.lit("VOICETRUST.LIVENESS.UNKNOWN"),
            ),
            F.when(_spoof_high(), F.lit("VOICETRUST.SPOOF.HIGH")).when(
                _spoof_suspect(), F.lit("VOICETRUST.SPOOF.SUSPECT")
            ),
            F.when(not_ok, F.lit("VOICETRUST.QUALITY.INSUFFICIENT")),
            F.when(~F.coalesce("asr_ran", F.lit(False)), F.lit("VOICETRUST.ASR.NOT_RUN")),
            F.when(not_low, F.lit("VOICETRUST.SINK.HIGH_RISK")),
        )
    )
    rows = signals.withColumn("rules", F.array_sort(rules))
    denies = F.arrays_overlap("rules", F.array(*[F.lit(r) for r in _DENIES]))
    return rows.withColumn(
        "decision",
        F.when(denies, DENY).when(F.size("rules") > 0, STEP_UP).otherwise(ALLOW),
    )


def voice_facts(signals: DataFrame, key: str) -> DataFrame:
    """The nine facts the voice rules read; never NULL."""

    def sure(column: Column) -> Column:
        return F.coalesce(column, F.lit(False))

    return signals.select(
        key,
        sure(F.col("quality") == "ok").alias("voice_quality_ok"),
        sure(F.col("asr_ran")).alias("voice_asr_ran"),
        sure(F.col("liveness") == "match").alias("voice_liveness_match"),
        sure(F.col("liveness") == "mismatch").alias("voice_liveness_mismatch"),
        sure(F.col("liveness") == "expired").alias("voice_liveness_expired"),
        F.col("spoof").isNotNull().alias("voice_spoof_ran"),
        _spoof_high().alias("voice_spoof_high"),
        _spoof_suspect().alias("voice_spoof_suspect"),
        (~sure(F.col("sink") == "low")).alias("voice_sink_high"),
    )


def spoof_probability(outputs: Column) -> Column:
    """P(spoof) from a model's output list of (label, score, all_scores map), NULL if unclear."""

    def one(o: Column) -> Column:
        named = F.try_element_at(o["all_scores"], F.lit("spoof"))
        label = F.lower(o["label"])
        valid = o["score"].between(0.0, 1.0)
        return F.when(
            o["all_scores"].isNotNull(), F.when(named.between(0.0, 1.0), named)
        ).otherwise(
            F.when(valid & F.contains(label, F.lit("spoof")), o["score"]).when(
                valid & F.contains(label, F.lit("bonafide")), 1.0 - o["score"]
            )
        )

    return F.get(F.array_compact(F.transform(outputs, one)), F.lit(0))


def pick_model(latencies: DataFrame, keys: list[str], *, limit_ms: float = 2000.0) -> DataFrame:
    """The large model unless its upper-median latency on the best device is over the limit.

    ``latencies``: keys, device, ms (of the large model).
    """
    middle = order_statistics(
        latencies, [*keys, "device"], "ms", {"p50": (0.5, lambda n: F.floor(n / 2) + 1)}
    )
    best = middle.groupBy(*keys).agg(F.min("p50").alias("p50_ms"))
    return best.withColumn("model", F.when(F.col("p50_ms") <= limit_ms, "1B").otherwise("500M"))
