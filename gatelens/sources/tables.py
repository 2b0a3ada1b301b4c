"""Typed scans, readers for seed files, and sinks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.operators.ruleset import ALLOW
from gatelens.plans.skew import newest_per_key, oldest_per_key, top_n_per_key

# money is integer paise, time is a timestamp, nested parts stay JSON text
SCHEMAS = {
    "meta": "key string, value string",
    "accounts": "account_id string, principal_id string, balance_paise bigint, currency string",
    "payees": "payee_id string, principal_id string, vpa string, name string, added_by string, "
    "created_ts timestamp",
    "ledger": "txn_id string, principal_id string, account_id string, payee_vpa string, "
    "amount_paise bigint, balance_after bigint, note string, task_id string, call_id string, "
    "ts timestamp",
    "mandates": "mandate_id string, principal_id string, nonce string, key_id string, "
    "body string, sig string, nbf timestamp, exp timestamp, created_ts timestamp",
    "mandate_nonces": "nonce string, mandate_id string, ts timestamp",
    "consents": "consent_id string, principal_id string, category string, purposes string, "
    "exp timestamp, withdrawn_at timestamp",
    "consent_epoch": "id int, epoch bigint",
    "approvals": "approval_id string, task_id string, tool string, call_digest string, "
    "canonical_call string, status string, created_ts timestamp, decided_ts timestamp, "
    "approver string, token string, token_id string, consumed_ts timestamp",
    "audit_leaves": "idx bigint, payload binary, leaf_hash string",
    "tree_heads": "size bigint, root string, ts timestamp, sig string, key_id string",
    "documents": "doc_id string, name string, trust string, mime string, content string, "
    "meta string",
    "customers": "customer_id string, principal_id string, name string, email string, "
    "phone string, pan string, aadhaar string, address string, extra string",
    "inbox": "mail_id string, sender string, subject string, body string, ts timestamp",
    "outbox": "mail_id string, sender string, to_addr string, subject string, body string, "
    "task_id string, call_id string, ts timestamp",
    "control": "id bigint, key string, value string, origin string, ts timestamp",
    "ns_ledger": "txn_id string, namespace string, tool string, payee_vpa string, "
    "amount_paise bigint, args string, call_id string, ts timestamp",
    "task_bindings": "task_id string, principal string, purpose string, category string, "
    "text string, params string, created_ts timestamp",
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A state table under its fixed schema; nothing is inferred from the files."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_audit_log(leaves: DataFrame) -> DataFrame:
    """Leaves whose payload is a JSON object, parsed; others are left out, ``idx`` is kept."""
    parsed = leaves.withColumn("event", F.try_parse_json(F.col("payload").cast("string")))
    return parsed.where(F.startswith(F.schema_of_variant("event"), F.lit("OBJECT")))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``.html`` and ``.txt`` files: name, trust, mime, content.

    A name (without suffix) that contains "inject" marks outside content.
    """
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{html,txt}")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    )
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.select(
        "name",
        F.when(F.contains(stem, F.lit("inject")), "external").otherwise("user_upload").alias("trust"),
        F.when(F.endswith("name", F.lit(".html")), "text/html").otherwise("text/plain").alias("mime"),
        "content",
    )


KNOWN_FIELDS = ("name", "email", "phone", "pan", "aadhaar", "address")


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """Customer records, one JSON object per line; unknown fields are kept in ``extra``.

    The id is ``customer_id``, else ``id``, else made from the record itself. The principal is
    ``principal_id``, else ``principal``, else the id.
    """
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v"), "value")
    members = F.try_variant_get("v", "$", "map<string,variant>")

    def text(name: str) -> Column:
        return F.nullif(F.try_variant_get("v", f"$.{name}", "string"), F.lit(""))

    made = F.concat(F.lit("cust_"), F.substring(F.sha2("value", 256), 1, 12))
    rows = raw.where("v IS NOT NULL").withColumn(
        "customer_id", F.coalesce(text("customer_id"), text("id"), made)
    )
    drop = ("customer_id", "id", *KNOWN_FIELDS)
    extra = F.map_filter(members, lambda k, _: ~k.isin(*drop))
    return rows.select(
        "customer_id",
        F.coalesce(text("principal_id"), text("principal"), "customer_id").alias("principal_id"),
        F.coalesce(text("name"), "customer_id").alias("name"),
        *[F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in KNOWN_FIELDS[1:]],
        F.to_json(F.to_variant_object(extra)).alias("extra"),
    )


def read_consents(spark: SparkSession, path: str) -> DataFrame:
    """Consents with their purposes as an array; the table stores them as JSON text."""
    return read_table(spark, "consents", path).withColumn(
        "purposes", F.from_json("purposes", "array<string>")
    )


MANIFEST = (
    "file",
    "speaker_id",
    "type",
    "condition",
    "language",
    "consent",
    "duration_s",
    "source_model",
    "source_license",
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Clip manifest CSV; a header other than the fixed one is an error, not a guess."""
    rows = spark.read.option("header", True).csv(path)
    if tuple(rows.columns) != MANIFEST:
        raise ValueError(f"header must be {','.join(MANIFEST)}; got {','.join(rows.columns)}")
    return rows


def validate_manifest(manifest: DataFrame, clips: DataFrame, *, tolerance: float = 0.1) -> DataFrame:
    """One row per problem: ``file``, ``problem``. ``clips``: file, actual_s."""
    rows = manifest.join(clips.withColumn("_here", F.lit(True)), "file", "left")
    declared = F.col("duration_s").try_cast("double")

    def blank(name: str) -> Column:
        return F.coalesce(F.trim(name) == "", F.lit(True))

    here = F.coalesce("_here", F.lit(False))
    unreadable = declared.isNull() | F.col("actual_s").isNull()
    problems = F.array_compact(
        F.array(
            F.when(
                ~F.coalesce(F.lower(F.trim("consent")) == "yes", F.lit(False)),
                F.lit("consent must be 'yes'"),
            ),
            F.when(
                ~F.coalesce(F.col("type").isin("real", "clone"), F.lit(False)),
                F.lit("type must be real or clone"),
            ),
            F.when(
                (F.col("type") == "clone") & (blank("source_model") | blank("source_license")),
                F.lit("clone rows need source_model and source_license"),
            ),
            F.when(~here, F.lit("file missing")),
            F.when(here & unreadable, F.lit("unreadable duration or wav")),
            F.when(
                here & ~unreadable & (F.abs(declared - F.col("actual_s")) > tolerance),
                F.lit("duration differs from the file"),
            ),
        )
    )
    return rows.select("file", F.explode(problems).alias("problem"))


def read_results(spark: SparkSession, path: str, blocks: Sequence[str]) -> DataFrame:
    """Nested results documents, one variant column per block; a missing block is NULL."""
    docs = spark.read.text(path, wholetext=True)
    parsed = docs.select(F.try_parse_json("value").alias("v"))
    return parsed.select(*[F.try_variant_get("v", f"$.{b}", "variant").alias(b) for b in blocks])


def read_results_lines(spark: SparkSession, path: str, blocks: Sequence[str]) -> DataFrame:
    """The same for many results kept as one document per line."""
    parsed = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    return parsed.select(*[F.try_variant_get("v", f"$.{b}", "variant").alias(b) for b in blocks])


def insert_or_ignore(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Rows of ``new`` to append: the first per key, none whose key exists already."""
    return oldest_per_key(new, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def insert_or_replace(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Table after the writes: the last write per key wins, over what was there."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest_per_key(both, keys, ["_new", *order]).drop("_new")


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines with sorted keys (Spark writes fields in column order)."""
    report.select(*sorted(report.columns)).write.mode("overwrite").json(path)


def read_after(table: DataFrame, last_id: int, id_column: str = "id") -> DataFrame:
    """Rows after the last one seen, in order. For streams use a checkpointed file source."""
    return table.where(F.col(id_column) > last_id).orderBy(id_column)


STAGE_PREFIX = "stage."


def read_stage_spans(spans: DataFrame, prefix: str = STAGE_PREFIX) -> DataFrame:
    """``stage`` and ``ms`` of finished stage spans; times come in nanoseconds."""
    done = (
        F.startswith("name", F.lit(prefix))
        & F.col("start_ns").isNotNull()
        & F.col("end_ns").isNotNull()
    )
    return spans.where(done).select(
        F.substr("name", F.lit(len(prefix) + 1)).alias("stage"),
        ((F.col("end_ns") - F.col("start_ns")) / 1e6).alias("ms"),
    )


def systematic_sample(
    corpus: DataFrame, strata: Sequence[str], order: Sequence[str], k: int
) -> DataFrame:
    """Per stratum every ``max(1, n // k)``-th row in ``order``, the first ``k`` of them.

    The rows are dealt into ranges of ``order``, which may be of any type that can be sorted, and
    written with the number of their range; a row's place is its place in the range plus the rows
    in the ranges before.
    """
    from pyspark.sql import Window as W

    from gatelens.session import durable

    sizes = corpus.groupBy(*strata).agg(F.count("*").alias("_n"))
    ranged = corpus.repartitionByRange(*order).withColumn("_r", F.spark_partition_id())
    ranges = durable(ranged)
    counts = ranges.groupBy(*strata, "_r").agg(F.count("*").alias("_c"))
    before = (W.unboundedPreceding, -1)
    carry = counts.select(
        *strata,
        "_r",
        F.coalesce(
            F.sum("_c").over(W.partitionBy(*strata).orderBy("_r").rowsBetween(*before)), F.lit(0)
        ).alias("_before"),
    )
    inside = W.partitionBy(*strata, "_r").orderBy(*order)
    placed = (
        ranges.withColumn("_i", F.row_number().over(inside) - 1)
        .join(carry, [*strata, "_r"])
        .join(sizes, list(strata))
        .withColumn("_place", F.col("_i") + F.col("_before"))
    )
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    chosen = placed.where((F.col("_place") % step == 0) & (F.col("_place") / step < k))
    return chosen.select(*corpus.columns)


# fixed values: reads that still run while the guard is off
PASS_WHILE_OFF = ("read_document", "list_payees", "get_balance")


def off_mode_route(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls made while the guard is off: those that run, and rows of the isolated ledger.

    ``calls``: call_id, ts, tool, category, payee_vpa, amount_paise, mode.
    """
    off = calls.where(F.col("mode") == "off")
    runs = F.coalesce(
        (F.col("category") == "READ") & F.col("tool").isin(*PASS_WHILE_OFF), F.lit(False)
    )
    pays = F.col("tool") == "pay_upi"
    ledger = off.where(~runs).select(
        "call_id",
        "ts",
        "tool",
        F.when(pays, F.col("payee_vpa")).alias("payee_vpa"),
        F.when(pays, F.col("amount_paise")).otherwise(F.lit(0)).cast("long").alias("amount_paise"),
        F.lit("demo_off").alias("namespace"),
        F.lit("UNGUARDED").alias("decision"),
    )
    return off.where(runs), ledger


def sequence_gaps(events: DataFrame, feed: Sequence[str], seq: str = "seq") -> DataFrame:
    """Missing ranges of each feed: ``gap_from``, ``gap_to``.

    A gap starts after a present number whose successor is absent and ends before the next
    present one. Both ends are found by a self anti join on seq + 1, then paired in order within
    blocks of numbers, so a long feed is never sorted as a whole.
    """
    present = events.select(*feed, F.col(seq).cast("long").alias("s")).distinct()
    following = present.select(*feed, (F.col("s") - 1).alias("s"))
    preceding = present.select(*feed, (F.col("s") + 1).alias("s"))
    ends = present.groupBy(*feed).agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"))
    starts = (
        present.join(following, [*feed, "s"], "left_anti")
        .join(ends, list(feed))
        .where("s < _hi")
        .select(*feed, F.col("s").alias("_t"), (F.col("s") + 1).alias("gap_from"))
    )
    stops = (
        present.join(preceding, [*feed, "s"], "left_anti")
        .join(ends, list(feed))
        .where("s > _lo")
        .select(*feed, F.col("s").alias("_t"), (F.col("s") - 1).alias("gap_to"))
    )
    # the n-th start belongs to the n-th stop; equal counts per feed by construction
    from gatelens.plans.timeline import running_total

    def numbered(df: DataFrame) -> DataFrame:
        at = df.withColumn("_at", F.timestamp_seconds("_t"))
        return running_total(at, feed, "_at", ["_t"], F.lit(1), "_k", fine=65_536, coarse=2**32)

    return (
        numbered(starts)
        .select(*feed, "_k", "gap_from")
        .join(numbered(stops).select(*feed, "_k", "gap_to"), [*feed, "_k"])
        .select(*feed, "gap_from", "gap_to")
    )


def last_n(events: DataFrame, feed: Sequence[str], n: int, seq: str = "seq") -> DataFrame:
    """The newest ``n`` events of each feed."""
    return top_n_per_key(events, feed, [F.desc(seq)], n)


def attempts_in_window(
    attempts: DataFrame, client: Sequence[str], ts: str = "ts", *, seconds: int = 60
) -> DataFrame:
    """Add ``recent``: attempts of the client in the trailing window, this one included.

    Attempts up to now minus attempts up to the window's start: two running counts.
    """
    from gatelens.plans.timeline import stab_count

    rows = attempts.withColumn(
        "_until", F.col(ts) + F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)"))
    )
    spans = rows.select(*client, F.col(ts).alias("_from"), "_until")
    return stab_count(attempts, spans, list(client), ts, "_from", "_until", "recent")


def allowed(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("decision") == ALLOW)
