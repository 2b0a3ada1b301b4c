"""Structured Streaming forms of the stateful checks.

Stateless operators (rules, redaction, scans) run on a stream as they are. Where the answer
depends on order within a key, state is kept with ``applyInPandasWithState``: each micro-batch
brings the key's new rows, they are put in event order, and a few numbers stay as state. Keys are
spread over buckets by their hash and these over the cluster; what has to be sequential is only
one key.
"""

import json
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatelens.functions.hashing import leaf_hash, node_hash
from gatelens.session import scratch

#: How far behind the newest event an event may come before it is dropped.
DELAY = "1 hour"
#: How long the state of a nonce, token or approval is kept after its last event.
KEEP_SECONDS = 86_400.0
#: States that all keys share by their hash.
BUCKETS = 1024

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_call_stream(
    spark: SparkSession, path: str, schema: str = EVENTS, *, files_per_trigger: int | None = None
) -> DataFrame:
    """Call events as a stream of Parquet files under a fixed schema."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what the source holds now into a Parquet sink and read the result."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, name + "-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], name: str
) -> StreamingQuery:
    """Run ``work`` on each micro-batch of what the source holds now.

    ``work`` must be idempotent per batch id: a batch is repeated after a failure.
    """
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", scratch(stream.sparkSession, name + "-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame]):
    """A ``foreachBatch`` worker that writes each batch to its own folder, replacing a retry."""

    def work(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return work


def score_stream(calls: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str):
    """Decide a stream of calls: the batch evaluation, joined with static tables per batch."""
    return each_batch(calls, batch_writer(path, decide), "score")


def dedup_calls(events: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """One event per call id within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def keyed(
    stream: DataFrame,
    keys: list[str],
    order: list[str],
    step: Callable[[tuple, dict], tuple[tuple, list[dict]]],
    initial: tuple,
    output: str,
    *,
    keep_seconds: float | None = None,
    delay: str = DELAY,
    ordered: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Fold the rows of each key in event order over a small state.

    ``step(state, row) -> (state, output rows)``; rows and states are plain numbers, texts and lists. With
    ``keep_seconds`` a key starts anew with a row that comes so long after its last one (by ``ts``,
    epoch seconds), and its state is dropped once the watermark (``delay`` behind the newest row) is
    that far on, so keys that are used once do not pile up; rows behind the watermark are dropped.

    Rows are put in order within a micro-batch. ``ordered`` puts them in order for good: a row waits in
    the state until the watermark has passed it, so no earlier one can follow, and the result is the
    same however the input was cut into batches. It comes ``delay`` later in return, and the rows of
    the last ``delay`` wait for newer ones.

    Keys share ``buckets`` states by their hash, since a call of Python for each key costs far more than
    its few rows. A batch rewrites the buckets that it meets.
    """
    names = [field.split()[0] for field in output.split(", ")]
    doubles = [f.name for f in stream.schema if f.dataType.typeName() in ("double", "float")]
    timeout = GroupStateTimeout.NoTimeout
    timed = ordered or keep_seconds is not None
    keep = float("inf") if keep_seconds is None else keep_seconds
    packed = F.to_json(F.struct(*stream.columns), {"ignoreNullFields": "false"}).alias("_row")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    if timed:
        timeout = GroupStateTimeout.EventTimeTimeout
        # one second on, since the first watermark is the epoch and would drop its instant
        at = F.timestamp_micros(((F.col("ts") + 1) * 1_000_000).cast("long"))
        stream = stream.withColumn("_at", at).withWatermark("_at", delay).select(bucket, packed, "_at")
    else:
        stream = stream.select(bucket, packed)

    def place(row: dict) -> int:
        return int((row["ts"] + 1) * 1000)

    def gone(last: float) -> int:
        return int((last + 1 + keep) * 1000)

    def unpacked(texts: list[str]) -> list[dict]:
        rows = json.loads(f"[{','.join(texts)}]")
        for name in doubles:
            for row in rows:
                value = row[name]
                row[name] = float("nan") if value is None else float(value)
        return rows

    def named(values: list) -> tuple:
        # one NaN is as good as another
        return tuple("NaN" if value != value else value for value in values)

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState):
        states, waiting, ready = {}, [], []
        if held.exists:
            known, waiting = json.loads(zlib.decompress(held.get[0]))
            states = {named(name): (tuple(current), last) for name, current, last in known}
        passed = held.getCurrentWatermarkMs() if timed else 0
        if ordered:
            # rows that wait on are not read again
            ready = unpacked([text for at, text in waiting if at < passed])
            waiting = [kept for kept in waiting if kept[0] >= passed]
        if not held.hasTimedOut:
            for batch in batches:
                texts = batch["_row"].tolist()
                rows = unpacked(texts)
                if ordered:
                    for text, row in zip(texts, rows):
                        if (at := place(row)) >= passed:
                            waiting.append([at, text])
                        else:
                            ready.append(row)
                else:
                    ready.extend(rows)
        until = [at + 1 for at, _ in waiting]
        due: dict[tuple, list[dict]] = {}
        for row in ready:
            due.setdefault(named([row[name] for name in keys]), []).append(row)
        out: list[dict] = []
        for name, rows in due.items():
            if len(rows) > 1:
                rows.sort(key=lambda row: tuple(row[field] for field in order))
            current, last = states.get(name, (initial, float("-inf")))
            for row in rows:
                if timed:
                    current = initial if row["ts"] - last > keep else current
                    last = max(last, row["ts"])
                current, emitted = step(current, row)
                out.extend(emitted)
            states[name] = (current, last)
        if keep_seconds is not None:
            states = {name: kept for name, kept in states.items() if gone(kept[1]) >= passed}
            until.extend(gone(last) for _, last in states.values())
        if states or waiting:
            known = [(name, *kept) for name, kept in states.items()]
            held.update((zlib.compress(json.dumps((known, waiting)).encode(), 1),))
            if until:
                held.setTimeoutTimestamp(max(min(until), passed + 1))
        elif held.exists:
            held.remove()
        # objects, so that a missing number makes no fractions of the whole ones beside it
        yield pd.DataFrame(out, columns=names, dtype=object)

    return stream.groupBy("_bucket").applyInPandasWithState(update, output, "held binary", "append", timeout)


def gap_alerts(events: DataFrame) -> DataFrame:
    """Missing ranges per feed as they show. Input: feed, seq."""

    def step(state, row):
        (last,) = state
        seq = int(row["seq"])
        if last >= 0 and seq <= last:
            return state, []
        gap = [{"feed": row["feed"], "gap_from": last + 1, "gap_to": seq - 1}]
        return (seq,), gap if last >= 0 and seq > last + 1 else []

    return keyed(
        events, ["feed"], ["seq"], step, (-1,), "feed bigint, gap_from bigint, gap_to bigint"
    )


def late_events(events: DataFrame) -> DataFrame:
    """Events with a flag telling those at or behind the last number of their feed, in order of
    arrival. Input: feed, seq, arrival."""

    def step(state, row):
        (last,) = state
        seq = int(row["seq"])
        late = seq <= last
        return (max(last, seq),), [{"feed": row["feed"], "seq": seq, "late": late}]

    return keyed(
        events, ["feed"], ["arrival"], step, (-1,), "feed bigint, seq bigint, late boolean"
    )


def nonce_match(
    events: DataFrame,
    *,
    ttl_seconds: float = 30.0,
    keep_seconds: float = KEEP_SECONDS,
    delay: str = DELAY, ordered: bool = False,
) -> DataFrame:
    """Liveness of each attempt; issues and attempts come in one stream.

    Input: nonce_id, kind (issue or attempt), session_id, ts (epoch seconds), heard (whether the
    phrase was heard, NULL without a transcript). State: session, time of issue, used; it is dropped
    ``keep_seconds`` after the last event of the nonce, and an attempt after that is a mismatch.
    """

    def step(state, row):
        session, issued, used = state
        if row["kind"] == "issue":
            return (int(row["session_id"]), float(row["ts"]), False), []
        now = float(row["ts"])
        mine = issued >= 0 and int(row["session_id"]) == session and not used
        if not mine:
            verdict = "mismatch"
        elif now - issued > ttl_seconds:
            verdict, used = "expired", True
        elif row["heard"] is None or pd.isna(row["heard"]):
            verdict = "unknown"
        else:
            verdict, used = ("match" if row["heard"] else "mismatch"), True
        found = {"nonce_id": row["nonce_id"], "session_id": row["session_id"], "ts": now, "liveness": verdict}
        return (session, issued, used), [found]

    return keyed(
        events,
        ["nonce_id"],
        ["ts", "kind_order"],
        step,
        (-1, -1.0, False),
        "nonce_id bigint, session_id bigint, ts double, liveness string",
        keep_seconds=keep_seconds,
        delay=delay, ordered=ordered,
    )


def approval_expiry(
    events: DataFrame, *, keep_seconds: float = KEEP_SECONDS, delay: str = DELAY, ordered: bool = False
) -> DataFrame:
    """First use of a live token wins; other uses are late, unknown or for another call.

    Input: token_id, kind (issue or use), ts (epoch seconds), expires (issue), digest. A token is
    forgotten ``keep_seconds`` after its last event; uses after that are unknown.
    """

    def step(state, row):
        expires, digest, used = state
        if row["kind"] == "issue":
            return (float(row["expires"]), str(row["digest"]), used), []
        now = float(row["ts"])
        if expires < 0:
            verdict = "unknown"
        elif used:
            verdict = "replay"
        elif now >= expires:
            verdict = "expired"
        elif str(row["digest"]) != digest:
            verdict = "mismatch"
        else:
            verdict, used = "valid", True
        return (expires, digest, used), [{"token_id": row["token_id"], "ts": now, "verdict": verdict}]

    return keyed(
        events,
        ["token_id"],
        ["ts", "kind_order"],
        step,
        (-1.0, "", False),
        "token_id string, ts double, verdict string",
        keep_seconds=keep_seconds,
        delay=delay, ordered=ordered,
    )


def token_replay(
    events: DataFrame, *, keep_seconds: float = KEEP_SECONDS, delay: str = DELAY, ordered: bool = False
) -> DataFrame:
    """Later uses of a nonce within ``keep_seconds``. Input: nonce, ts (epoch seconds), call_id."""

    def step(state, row):
        (seen,) = state
        again = [{"nonce": row["nonce"], "call_id": row["call_id"]}] if seen else []
        return (True,), again

    return keyed(events, ["nonce"], ["ts", "call_id"], step, (False,), "nonce string, call_id bigint", keep_seconds=keep_seconds, delay=delay, ordered=ordered)


def rate_limit(events: DataFrame, *, per_minute: int = 20, ordered: bool = False, delay: str = DELAY) -> DataFrame:
    """Token bucket per client: a full bucket at first, one token per request.

    Input: client, ts (epoch seconds), request_id.
    """
    capacity, per_second = float(per_minute), per_minute / 60.0

    def step(state, row):
        tokens, stamp = state
        now = float(row["ts"])
        tokens = capacity if stamp < 0 else min(capacity, tokens + (now - stamp) * per_second)
        admitted = tokens >= 1.0
        left = tokens - 1.0 if admitted else tokens
        return (left, now), [{"client": row["client"], "request_id": row["request_id"], "admitted": admitted}]

    return keyed(
        events,
        ["client"],
        ["ts", "request_id"],
        step,
        (capacity, -1.0),
        "client bigint, request_id bigint, admitted boolean",
        ordered=ordered,
        delay=delay,
    )


def sliding_attempts(events: DataFrame, *, limit: int = 5, seconds: float = 60.0, ordered: bool = False, delay: str = DELAY) -> DataFrame:
    """Attempts over the limit in the trailing window are refused and do not count themselves.

    Input: client, ts (epoch seconds), request_id. State: times of the counted attempts, at most
    ``limit`` of them.
    """

    def step(state, row):
        (times,) = state
        now = float(row["ts"])
        recent = [t for t in times if t > now - seconds]
        admitted = len(recent) < limit
        kept = [*recent, now] if admitted else recent
        return (kept,), [{"client": row["client"], "request_id": row["request_id"], "admitted": admitted}]

    return keyed(
        events,
        ["client"],
        ["ts", "request_id"],
        step,
        ([],),
        "client bigint, request_id bigint, admitted boolean",
        ordered=ordered,
        delay=delay,
    )


def daily_cap_stream(
    payments: DataFrame, *, keep_seconds: float = 2 * KEEP_SECONDS, delay: str = DELAY, ordered: bool = False
) -> DataFrame:
    """Payments allowed under the daily cap, where only allowed ones use it up.

    Input: principal, day, ts (epoch seconds), txn_id, amount_paise, daily_cap.
    """

    def step(state, row):
        (spent,) = state
        fits = spent + int(row["amount_paise"]) <= int(row["daily_cap"])
        after = spent + int(row["amount_paise"]) if fits else spent
        found = {"txn_id": row["txn_id"], "principal": row["principal"], "allowed": fits, "spent": after}
        return (after,), [found]

    return keyed(
        payments,
        ["principal", "day"],
        ["ts", "txn_id"],
        step,
        (0,),
        "txn_id bigint, principal int, allowed boolean, spent bigint",
        keep_seconds=keep_seconds,
        delay=delay, ordered=ordered,
    )


def stage_metrics_window(spans: DataFrame, *, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """p50, p99 and count per stage and tumbling window, once the watermark has passed it."""
    return (
        spans.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "stage")
        .agg(
            F.count("*").alias("n"),
            F.percentile_approx("ms", 0.5, 10_000).alias("p50_ms"),
            F.percentile_approx("ms", 0.99, 10_000).alias("p99_ms"),
        )
        .select(F.col("w.start").alias("window_start"), "stage", "n", "p50_ms", "p99_ms")
    )


def _decision_counts() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        F.count_if(F.col("decision") > 0).alias("blocked"),
        F.count_if(F.col("decision") == 2).alias("denied"),
    ]


def decision_counts_window(
    decisions: DataFrame,
    *,
    delay: str = "10 minutes",
    width: str = "1 hour",
    slide: str | None = None,
) -> DataFrame:
    """Calls, blocked calls and denials per window, tumbling or, with ``slide``, sliding."""
    return (
        decisions.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide).alias("w"))
        .agg(*_decision_counts())
        .select(F.col("w.start").alias("window_start"), "calls", "blocked", "denied")
    )


def decision_counts_session(
    decisions: DataFrame, key: str, *, delay: str = "10 minutes", gap: str = "30 minutes"
) -> DataFrame:
    """The same per session of a key: a session ends ``gap`` after its last call."""
    return (
        decisions.withWatermark("ts", delay)
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(*_decision_counts())
        .select(key, F.col("w.start").alias("session_start"), "calls", "blocked", "denied")
    )


def attempts_in_time(
    issues: DataFrame, attempts: DataFrame, *, seconds: int = 30, delay: str = DELAY
) -> DataFrame:
    """Attempts that follow the issue of their nonce within ``seconds``: two streams joined.

    ``issues``: nonce_id, issued_at. ``attempts``: nonce_id, session_id, ts. Both watermarks and the
    interval bound how long either side is kept.
    """
    left = issues.select(F.col("nonce_id").alias("_nonce"), "issued_at")
    right = attempts.select("nonce_id", "session_id", "ts").withWatermark("ts", delay)
    near = F.expr(f"ts >= issued_at AND ts <= issued_at + INTERVAL {int(seconds)} SECONDS")
    return (
        left.withWatermark("issued_at", delay)
        .join(right, (F.col("_nonce") == F.col("nonce_id")) & near)
        .select("nonce_id", "session_id", "ts")
    )


def consent_withdrawals(withdrawals: DataFrame, consents: DataFrame, path: str) -> StreamingQuery:
    """Keep a consent table up to date from a stream of withdrawals.

    Version n of the table is written beside version n-1 and named by the batch id, so a
    repeated batch writes the same version again and readers never see a half-written one.
    """
    from gatelens.operators.consents import apply_withdrawals

    spark = withdrawals.sparkSession
    consents.write.mode("overwrite").parquet(f"{path}/version=-1")

    def work(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{path}/version={batch_id - 1}")
        apply_withdrawals(before, batch).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return each_batch(withdrawals, work, "withdrawals")


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """Newest version of a table kept by ``consent_withdrawals``."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("version"))
    return versions.join(newest, "version").drop("version")


def append_audit(
    events: DataFrame, path: str, *, chunk_bits: int = 16, heads: int | None = None
) -> StreamingQuery:
    """Append each micro-batch to an audit log with continuing indexes.

    Input: seq (unique, increasing), payload. Indexes are counted over chunks of ``seq``. What is kept
    from batch to batch is the frontier of the Merkle tree: the size of the log and the roots of the
    full subtrees that make it up, as many as the size has bits. So no earlier leaf is read, and a
    repeated batch writes the same. With ``heads`` the root at every size that is a multiple of it, a
    power of two, goes to ``<path>-heads`` (size, root).
    """
    from gatelens.operators.audit import positions

    if heads is not None and heads & (heads - 1):
        raise ValueError("heads are due at multiples of a power of two")
    spark = events.sparkSession

    def work(batch: DataFrame, batch_id: int) -> None:
        size, peaks = 0, []
        if batch_id > 0:
            held = spark.read.schema(_FRONTIER).parquet(f"{path}-frontier/batch={batch_id - 1}").collect()
            size = held[0]["size"]
            peaks = [(r.level, r.hash) for r in held if r.hash is not None]
        rows = batch.select(F.col("seq").alias("idx"), "payload").withColumn(
            "leaf_hash", leaf_hash("payload")
        )
        place = positions(rows, chunk_bits=chunk_bits).select("idx", "position")
        placed = rows.join(place, "idx").select(
            (F.col("position") + size).alias("idx"), "payload", "leaf_hash"
        )
        placed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        leaves = spark.read.schema("idx bigint, payload string, leaf_hash string").parquet(f"{path}/batch={batch_id}")
        grown = size + leaves.count()
        every = heads or 1 << 62
        nodes = _new_nodes(leaves, size, grown, peaks, every)
        known = spark.createDataFrame([(lv, (size >> lv) - 1, h) for lv, h in peaks], _NODE)
        nodes = nodes.unionByName(known).dropDuplicates(["level", "node"])
        if heads is not None:
            due = spark.range(-(-(size + 1) // heads) * heads, grown + 1, heads).withColumnRenamed("id", "size")
            _roots(due, nodes).write.mode("overwrite").parquet(f"{path}-heads/batch={batch_id}")
        ends = _peaks_of(spark.createDataFrame([(grown,)], "size bigint"), nodes)
        frontier = ends.unionByName(spark.createDataFrame([(grown, None, None)], _FRONTIER))
        frontier.coalesce(1).write.mode("overwrite").parquet(f"{path}-frontier/batch={batch_id}")

    return each_batch(events, work, "audit")


_NODE = "level int, node bigint, hash string"
_FRONTIER = "size bigint, level int, hash string"
#: Levels of the tree that one group of rows is folded over.
_FOLD = 10


def _new_nodes(leaves: DataFrame, size: int, grown: int, peaks: list[tuple[int, str]], every: int) -> DataFrame:
    """Full subtrees that the leaves from ``size`` on complete, as ``level, node, hash``.

    Those below the level of ``every`` are left out unless the new log ends with them. Each round folds
    groups of 1024 neighbouring nodes; the frontier steps in for the nodes before.
    """
    floor = every.bit_length() - 1

    def folded(base: int):
        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            block = int(rows["node"].iloc[0]) >> _FOLD
            now = dict(zip(rows["node"].tolist(), rows["hash"].map(bytes.fromhex), strict=True))
            out = []
            for level in range(base, base + _FOLD + 1):
                for held, text in peaks:
                    at = (size >> held) - 1
                    if held == level and at >> (base + _FOLD - level) == block:
                        now[at] = bytes.fromhex(text)
                new = level > base or base == 0
                for at, value in now.items():
                    if new and (level >= floor or level == base + _FOLD or at == (grown >> level) - 1):
                        out.append((level, at, value.hex()))
                now = {
                    at >> 1: sha256(b"\1" + value + now[at + 1]).digest()
                    for at, value in now.items()
                    if not at & 1 and at + 1 in now
                }
            return pd.DataFrame(out, columns=["level", "node", "hash"])

        return fold

    spark = leaves.sparkSession
    rows = leaves.select(F.col("idx").alias("node"), F.col("leaf_hash").alias("hash"))
    found = spark.createDataFrame([], _NODE)
    base = 0
    while base == 0 or grown >> base:
        made = rows.groupBy(F.shiftright("node", _FOLD)).applyInPandas(folded(base), _NODE)
        at = scratch(spark, "nodes")
        made.write.parquet(at)
        made = spark.read.schema(_NODE).parquet(at)
        found = found.unionByName(made)
        base += _FOLD
        rows = made.where(F.col("level") == base).select("node", "hash")
    return found


def _peaks_of(sizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``size, level, hash``: the full subtrees that logs of these sizes are made of."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(61)), lambda b: F.pmod(F.call_function("shiftright", F.col("size"), b), F.lit(2)) == 1)
    wanted = sizes.withColumn("level", F.explode(bits)).withColumn(
        "node", F.call_function("shiftright", F.col("size"), F.col("level")) - 1
    )
    return wanted.join(nodes, ["level", "node"]).select("size", "level", "hash")


def _roots(sizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``size, root`` from the peaks of each size, the smallest folded first."""
    listed = _peaks_of(sizes, nodes).groupBy("size").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("peaks"))
    first = F.element_at("peaks", 1)["hash"]
    rest = F.slice("peaks", F.lit(2), F.size("peaks"))
    return listed.select("size", F.aggregate(rest, first, lambda acc, peak: node_hash(peak["hash"], acc)).alias("root"))


def redact_stream(events: DataFrame, columns: list[str]) -> DataFrame:
    """Public form of text columns; stateless, so the same on a stream and on a table."""
    from gatelens.functions.text import safe_text

    return events.withColumns({c: safe_text(c) for c in columns})


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6
