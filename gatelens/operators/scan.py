"""Scans over documents, mails and requests, and what their signals mean for a call."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions import text as tx
from gatelens.functions.hashing import pseudonym
from gatelens.functions.scalars import ordered_case
from gatelens.operators.labels import cover_labels
from gatelens.operators.ruleset import ALLOW, DENY, STEP_UP
from gatelens.plans.skew import lookup

WINDOW_TOKENS = 512
OVERLAP_TOKENS = 64
ESCALATE_AT = 0.5


def find_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``kind``, ``start``, ``end``: one row per recognised value."""
    return docs.select(key, F.explode(tx.pii_spans(text)).alias("s")).select(
        key, "s.kind", "s.start", "s.end"
    )


def redact_leaves(leaves: DataFrame, labels: DataFrame, key: bytes) -> DataFrame:
    """Redacted value of each argument leaf: ``call_id``, ``pointer``, ``value``, ``reason``.

    ``leaves``: call_id, pointer, value (text). A SECRET label drops the value, a personal-data
    label leaves a keyed pseudonym, and unlabelled secrets are caught by their pattern. Labels
    on ancestors count.
    """
    tags = (
        cover_labels(leaves, labels)
        .groupBy("call_id", "pointer")
        .agg(
            F.max(F.when(F.col("tag") == "SECRET", 1)).alias("_secret"),
            F.max(F.when(F.startswith("tag", F.lit("PII")), 1)).alias("_pii"),
        )
    )
    kinds = tx.find_secrets("value")
    reason = (
        F.when(F.col("_secret") == 1, "secret")
        .when(F.col("_pii") == 1, "pii")
        .when(F.size(kinds) > 0, F.concat(F.lit("pattern:"), F.get(kinds, F.lit(0))))
    )
    rows = leaves.join(tags, ["call_id", "pointer"], "left").withColumn("reason", reason)
    return rows.select(
        "call_id",
        "pointer",
        F.when(F.col("reason").isNull(), F.col("value"))
        .when(F.col("reason") != "secret", pseudonym(F.col("value"), key))
        .alias("value"),
        "reason",
    )


# fixed values: keys dropped before hashing
SECRET_KEYS = (
    "secret",
    "password",
    "passwd",
    "api_key",
    "private_key",
    "seed",
    "sig",
    "signature",
)


def drop_secret_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves without a secret name anywhere on their path."""
    names = F.transform(F.split("pointer", "/"), F.lower)
    return leaves.where(~F.arrays_overlap(names, F.array(*[F.lit(k) for k in SECRET_KEYS])))


MAX_DEPTH = 12


def sanitise_leaves(leaves: DataFrame, **options) -> DataFrame:
    """Public form of event leaves: control characters, secrets and markup made harmless.

    A value under a secret-looking name, or nested deeper than twelve levels, is masked.
    ``leaves`` has ``pointer`` and ``value`` (text, NULL for JSON null).
    """
    parts = F.split("pointer", "/")
    rows = leaves.withColumn("_names", F.slice(parts, 2, F.size(parts)))
    # names are looked at one by one only where some name can be secret or unsafe at all
    least = max(1, min(tx.least_secret(), tx.least_secret(**options)))
    unsafe = r"\A(?!/)|[\x00-\x1f\x7f-\x9f&<>@]|[^/]{%d}" % least
    rows = rows.withColumn("_unsafe", F.regexp_like("pointer", F.lit(unsafe)))
    suspect = F.col("_unsafe") | F.regexp_like("pointer", F.lit(tx.SECRET_KEY))
    secret = F.when(suspect, F.exists("_names", tx.is_secret_key)).otherwise(F.lit(False))
    masked = secret | (F.size("_names") > MAX_DEPTH)
    safe_names = F.transform("_names", lambda n: tx.safe_text(n, **options))
    safe_pointer = F.concat(F.lit("/"), F.array_join(safe_names, "/"))
    return rows.withColumn(
        "value", F.when(masked, F.lit(tx.REDACTED)).otherwise(tx.safe_text("value", **options))
    ).withColumn("pointer", F.when(F.col("_unsafe"), safe_pointer).otherwise(F.col("pointer"))).drop("_names", "_unsafe")


def document_summary(docs: DataFrame) -> DataFrame:
    """``doc_id``, trust, length, hidden-text flag and score of each document."""
    return docs.select(
        "doc_id",
        F.when(F.col("trust") == "user_upload", "trusted").otherwise("untrusted").alias("trust"),
        F.length("content").cast("long").alias("chars"),
        tx.has_hidden_text("content").alias("hidden_text_detected"),
        tx.hidden_text_score("content").alias("injection_score"),
    )


def inbox_summary(mails: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per inbox: number of mails, highest score, whether anything is hidden.

    The ids of the mails stay rows of ``mails``; they are not packed into one value.
    """
    return mails.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.max(tx.hidden_text_score("body")).alias("injection_score"),
        F.bool_or(tx.has_hidden_text("body")).alias("hidden_text"),
    )


# ---------------------------------------------------------------- classifier windows


def chunk_windows(
    docs: DataFrame,
    key: str,
    text: str = "text",
    *,
    size: int = WINDOW_TOKENS,
    overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """``key``, ``window``, ``n_tokens``, ``text``: overlapping windows over the whole text."""
    step = size - overlap
    tokens = F.filter(F.split(tx.visible_text(text), " "), lambda w: w != "")
    rows = docs.select(key, tokens.alias("_t")).where(F.size("_t") > 0)
    # as many windows as it takes for the last one to reach the end
    count = F.greatest(F.lit(1), F.ceil((F.size("_t") - overlap) / F.lit(step))).cast("int")
    # windows are cut inside the row, so the tokens of a document are never repeated whole
    cut = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.slice("_t", i * step + 1, F.lit(size))
    )
    parts = F.transform(
        cut,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_tokens"), F.array_join(w, " ").alias("text")
        ),
    )
    return rows.select(key, F.posexplode(parts).alias("window", "p")).select(key, "window", "p.*")


def score_texts(
    windows: DataFrame, classifier: Callable[[Column], Column], text: str = "text"
) -> DataFrame:
    """Add ``score`` from a pluggable classifier, called once per distinct text.

    ``classifier`` turns a text column into a probability column; a pandas UDF that loads its
    model once per worker is the usual choice.
    """
    scored = (
        windows.select(F.sha2(text, 256).alias("_d"), text)
        .groupBy("_d")
        .agg(F.any_value(text).alias(text))
        .select("_d", classifier(F.col(text)).alias("score"))
    )
    return lookup(windows.withColumn("_d", F.sha2(text, 256)), scored, ["_d"]).drop("_d")


def max_window_score(
    docs: DataFrame, windows: DataFrame, key: str, *, threshold: float = ESCALATE_AT
) -> DataFrame:
    """Signal per document: highest window score, whether it escalates, and why.

    ``docs`` has ``key`` and ``status`` (ok, unavailable, timeout, error); ``windows`` has
    ``key`` and ``score``. Anything but ok escalates; an empty text does not.
    """
    best = windows.groupBy(key).agg(F.max("score").alias("_s"))
    rows = docs.join(best, key, "left")
    ok = F.col("status") == "ok"
    score = F.when(ok, F.coalesce("_s", F.lit(0.0)))
    return rows.withColumn("score", score).select(
        key,
        "status",
        "score",
        (~ok | (F.coalesce("score", F.lit(0.0)) >= threshold)).alias("escalate"),
    )


def analyse_requests(requests: DataFrame) -> DataFrame:
    """Combine phrase rules with the classifier: ``flagged``, ``model``, ``flags``.

    ``requests``: request_id, text, status (NULL when detectors are off), score.
    """
    found = tx.red_flags("text")
    hit = F.coalesce(F.col("score") >= ESCALATE_AT, F.lit(False))
    state = (
        F.when(F.col("status").isNull(), "off")
        .when(F.col("status") != "ok", "unavailable")
        .when(hit, "flagged")
        .otherwise("clean")
    )
    rows = requests.withColumn("model", state).withColumn("_f", found)
    flags = (
        F.when(F.col("model") == "flagged", F.concat(F.array(F.lit(tx.MODEL_FLAGGED)), "_f"))
        .when(F.col("model") == "unavailable", F.concat("_f", F.array(F.lit(tx.MODEL_MISSING))))
        .otherwise(F.col("_f"))
    )
    return rows.withColumn("flags", flags).select(
        "request_id", (F.size("flags") > 0).alias("flagged"), "model", "flags"
    )


def route_requests(requests: DataFrame) -> DataFrame:
    """``path`` and ``kind`` of each request: untrusted, or a lookup, a payment or no action.

    ``requests``: request_id, text, flagged.
    """
    intent = tx.parse_intent("text")
    rows = requests.withColumn("_i", intent)
    customer = F.regexp_like("text", F.lit(tx.CUSTOMER))
    looks_up = F.regexp_like("text", F.lit(tx.LOOKUP_VERB))
    says_amount = F.lit(False)
    for pattern in tx.SPOKEN_AMOUNTS:
        says_amount = says_amount | F.regexp_like("text", F.lit(pattern))
    kind = ordered_case(
        [
            (F.col("flagged"), "untrusted"),
            (~F.col("_i.kind").isin("pay", "export", "email") & customer & looks_up, "data"),
            ((F.col("_i.kind") == "pay") & says_amount, "payment"),
        ],
        "no_action",
    )
    return rows.select(
        "request_id",
        F.when(F.col("flagged"), "untrusted").otherwise("request").alias("path"),
        kind.alias("kind"),
    )


# ---------------------------------------------------------------- signals of a call
HARD_SINKS = ("PAYMENT", "EXPORT", "COMMUNICATION")
READER_TOOLS = ("extract_field", "read_handle")


def ml_stage(calls: DataFrame) -> DataFrame:
    """Decision of the signal stage: ``ml_decision``, ``waived`` and the rule it goes by.

    ``calls``: call_id, tool, category, z, injection, escalate (classifier), approved (a valid
    token for this exact call), ml_on, rule_decision. An approval waives a STEP_UP, never a
    DENY. With detectors off there is no signal.
    """
    reader = F.col("tool").isin(*READER_TOOLS)
    anomaly = F.when((F.col("tool") == "pay_upi") & (F.col("z") > 3.5), STEP_UP)
    hidden = F.when(~reader & (F.col("injection") >= ESCALATE_AT), STEP_UP)
    hard = F.coalesce(F.col("category").isin(*HARD_SINKS), F.lit(False))
    told = F.when(F.col("escalate") & ~reader, F.when(hard, DENY).otherwise(STEP_UP))
    raw = F.greatest(F.lit(ALLOW), anomaly, hidden, told)
    rows = calls.withColumn("_raw", raw)
    waived = (F.col("_raw") == STEP_UP) & F.coalesce("approved", F.lit(False))
    decision = F.when(F.col("ml_on"), F.when(waived, ALLOW).otherwise(F.col("_raw")))
    rows = rows.withColumn("ml_decision", decision)
    tightens = F.col("ml_decision") > F.col("rule_decision")
    return rows.select(
        "call_id",
        "ml_decision",
        F.coalesce(F.col("ml_on") & waived, F.lit(False)).alias("waived"),
        F.when(
            tightens,
            F.when(F.coalesce(F.col("escalate") & ~reader, F.lit(False)), "CORE.ML.CLASSIFIER").otherwise(
                "CORE.ML.SIGNAL"
            ),
        ).alias("rule_id"),
    )


def display_scores(calls: DataFrame) -> DataFrame:
    """Scores as shown: spoof, the worse of hidden text and classifier, z over seven capped at 1."""
    return calls.select(
        "call_id",
        F.col("spoof").cast("double").alias("spoof"),
        F.greatest("injection", "classifier").alias("injection"),
        F.when(
            F.col("z").isNotNull(), F.least(F.lit(1.0), F.least(F.lit(1000.0), F.col("z")) / 7.0)
        ).alias("anomaly"),
    )


# ---------------------------------------------------------------- extraction
# schema name -> field -> check over a column; callers may add their own
SCHEMAS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "invoice": {
        "payee_vpa": lambda c: c.isNotNull() & F.regexp_like(c, F.lit(tx.VPA_SHAPE)),
        "amount_paise": lambda c: c.isNotNull() & c.between(1, 10**12),
        "invoice_id": lambda c: c.isNull() | (F.length(c) <= 64),
    },
    "voice_command": {
        "intent": lambda c: c.isNotNull() & c.isin("pay", "add_payee", "balance", "other"),
        "payee_vpa": lambda c: c.isNull() | F.regexp_like(c, F.lit(tx.VPA_SHAPE)),
        "amount_paise": lambda c: c.isNull() | c.between(1, 10**12),
    },
    "email": {
        "sender": lambda c: c.isNotNull() & F.length(c).between(1, 320),
        "subject_intent": lambda c: c.isNotNull() & F.length(c).between(1, 200),
    },
}


def validate_extraction(fields: DataFrame, schema: str, key: str) -> DataFrame:
    """``ok``, the names of the failing fields and the rule an unusable document leads to."""
    checks = SCHEMAS[schema]
    bad = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(check(F.col(name)), F.lit(False)), F.lit(name))
                for name, check in checks.items()
            ]
        )
    )
    return fields.withColumn("bad_fields", bad).select(
        key,
        (F.size("bad_fields") == 0).alias("ok"),
        "bad_fields",
        F.when(F.size("bad_fields") > 0, DENY).otherwise(ALLOW).alias("decision"),
    )


def extract_email_fields(mails: DataFrame, key: str) -> DataFrame:
    """Sender and subject (200 characters at most) of the first message, else from its text."""
    sender = F.coalesce(
        F.nullif("sender", F.lit("")),
        F.nullif(F.regexp_extract("body", r"(?U)From:\s*(\S+)", 1), F.lit("")),
    )
    subject = F.coalesce(
        F.nullif("subject", F.lit("")),
        F.nullif(
            F.trim(F.regexp_extract(tx.visible_text("body"), r"(?U)Subject:\s*(.+)", 1)), F.lit("")
        ),
    )
    return mails.select(
        key, sender.alias("sender"), F.substring(subject, 1, 200).alias("subject_intent")
    )
