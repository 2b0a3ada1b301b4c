"""Keyed streaming state against brute force, in one batch and in several."""

import hashlib
import random

from pyspark.sql import functions as F

from gatelens.streaming import streams as st


def stream_of(spark, tmp_path, df, name, parts):
    """The table as a stream of ``parts`` files in order, one file per micro-batch."""
    folder = str(tmp_path / name)
    n = df.count()
    for i in range(parts):
        piece = df.where((F.col("seq") >= i * n // parts) & (F.col("seq") < (i + 1) * n // parts))
        piece.coalesce(1).write.mode("append").parquet(folder)
    return st.read_call_stream(spark, folder, df.schema.simpleString()[7:-1].replace(":", " "), files_per_trigger=1)


def requests(n=300, seed=3):
    rng = random.Random(seed)
    now, rows = 0.0, []
    for i in range(n):
        now += rng.random() * 4
        rows.append((i, 1 if rng.random() < 0.6 else rng.randrange(2, 5), round(now, 3)))
    return rows


def test_rate_limit_and_sliding_window(spark, tmp_path):
    rows = requests()
    df = spark.createDataFrame(rows, "seq long, client long, ts double").withColumn("request_id", F.col("seq"))
    bucket, counted, want_rate, want_slide = {}, {}, {}, {}
    for i, client, now in rows:
        tokens, stamp = bucket.get(client, (6.0, now))
        tokens = min(6.0, tokens + (now - stamp) * 0.1)
        want_rate[i] = tokens >= 1
        bucket[client] = (tokens - 1 if tokens >= 1 else tokens, now)
        recent = [t for t in counted.get(client, []) if t > now - 60]
        want_slide[i] = len(recent) < 5
        counted[client] = [*recent, now] if want_slide[i] else recent
    for parts in (1, 3):
        live = stream_of(spark, tmp_path, df, f"r{parts}", parts)
        got = st.run_available(st.rate_limit(live, per_minute=6), "rate").collect()
        assert {r.request_id: r.admitted for r in got} == want_rate
        live = stream_of(spark, tmp_path, df, f"s{parts}", parts)
        got = st.run_available(st.sliding_attempts(live), "slide").collect()
        assert {r.request_id: r.admitted for r in got} == want_slide


def test_daily_cap_counts_only_allowed(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), f"d{i // 100}", float(i), rng.randrange(1, 400)) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, principal int, day string, ts double, amount_paise long")
    df = df.withColumns({"txn_id": F.col("seq"), "daily_cap": F.lit(2000).cast("long")})
    spent, want = {}, {}
    for i, principal, day, _, amount in rows:
        used = spent.get((principal, day), 0)
        want[i] = used + amount <= 2000
        spent[principal, day] = used + amount if want[i] else used
    live = stream_of(spark, tmp_path, df, "cap", 2)
    got = st.run_available(st.daily_cap_stream(live), "cap").collect()
    assert {r.txn_id: r.allowed for r in got} == want
    assert not all(want.values())


def test_audit_stream_continues_indexes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "seq long, payload string")
    live = stream_of(spark, tmp_path, df, "log", 3)
    path = str(tmp_path / "leaves")
    st.append_audit(live, path)
    got = spark.read.parquet(path).orderBy("idx").collect()
    assert [(r.idx, r.payload) for r in got] == [(i, f"p{i}") for i in range(40)]
    assert len({r.batch for r in got}) == 3


def test_heads_of_an_appended_log(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(150)], "seq long, payload string")

    def root(leaves):
        if len(leaves) == 1:
            return hashlib.sha256(b"\0" + leaves[0]).digest()
        half = 1 << ((len(leaves) - 1).bit_length() - 1)
        return hashlib.sha256(b"\1" + root(leaves[:half]) + root(leaves[half:])).digest()

    texts = [f"p{i}".encode() for i in range(150)]
    for parts in (1, 4):
        path = str(tmp_path / f"heads{parts}")
        st.append_audit(stream_of(spark, tmp_path, df, f"l{parts}", parts), path, heads=16)
        got = {r.size: r.root for r in spark.read.parquet(f"{path}-heads").collect()}
        assert got == {n: root(texts[:n]).hex() for n in range(16, 151, 16)}
        last = spark.read.parquet(f"{path}-frontier/batch={parts - 1}").collect()
        assert {r["size"] for r in last} == {150} and sorted(r.level for r in last if r.hash) == [1, 2, 4, 7]


def test_heads_over_several_rounds(spark, tmp_path):
    # more leaves than one round folds, met in two unequal batches
    n = 2_500
    df = spark.range(n).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("payload"))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    st.append_audit(stream_of(spark, tmp_path, df, "a", 1), one, heads=64)
    st.append_audit(stream_of(spark, tmp_path, df, "b", 3), two, heads=64)
    rows = [sorted((r.size, r.root) for r in spark.read.parquet(f"{p}-heads").collect()) for p in (one, two)]
    assert rows[0] == rows[1] and len(rows[0]) == n // 64


def test_event_order_does_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"n{rng.randrange(12)}", float(rng.randrange(0, 3000))) for i in range(150)]
    seen, want = {}, set()
    for i, nonce, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if nonce in seen:
            want.add(i)
        seen[nonce] = at
    end = [(150, "end", 20_000.0), (151, "end", 40_000.0)]
    for parts in (1, 5):
        mixed = list(rows)
        random.Random(parts).shuffle(mixed)
        mixed = [(k, i, n, at) for k, (i, n, at) in enumerate(mixed + end)]
        df = spark.createDataFrame(mixed, "seq long, call_id long, nonce string, ts double")
        live = stream_of(spark, tmp_path, df, f"o{parts}", parts)
        out = st.token_replay(live, delay="3600 seconds", ordered=True)
        assert {r.call_id for r in st.run_available(out, "order").collect()} - {150, 151} == want


def test_state_of_old_keys_is_dropped(spark, tmp_path):
    rows = [(0, "a", 0.0), (1, "a", 50.0), (2, "b", 5_000.0), (3, "c", 9_000.0), (4, "a", 20_000.0), (5, "a", 20_010.0)]
    df = spark.createDataFrame(rows, "seq long, nonce string, ts double").withColumn("call_id", F.col("seq"))
    live = stream_of(spark, tmp_path, df, "replay", 3)
    kept = st.token_replay(live, keep_seconds=1e9, delay="1 second")
    assert {r.call_id for r in st.run_available(kept, "kept").collect()} == {1, 4, 5}
    dropped = st.token_replay(live, keep_seconds=100.0, delay="1 second")
    assert {r.call_id for r in st.run_available(dropped, "dropped").collect()} == {1, 5}


def test_keys_share_bounded_states(spark, tmp_path):
    n = 3 * st.BUCKETS
    df = spark.range(2 * n).select(
        F.col("id").alias("seq"),
        F.concat(F.lit("n"), F.col("id") % n).alias("nonce"),
        (F.col("id") / 1000).alias("ts"),
        F.col("id").alias("call_id"),
    )
    live = stream_of(spark, tmp_path, df, "many", 1)
    query = (
        st.token_replay(live)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= st.BUCKETS
    got = [r.call_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(n, 2 * n))


def test_keys_of_one_bucket_stay_apart(spark, tmp_path):
    # whole numbers beyond 2**53, one of them missing, in one state
    big = 2**60
    rows = [(i, None if i % 4 == 0 else big + i % 4, float(i * 7 % 40)) for i in range(40)]
    end = [(40, -1, 20_000.0), (41, -1, 40_000.0)]
    df = spark.createDataFrame(rows + end, "seq long, client long, ts double")

    def step(state, row):
        (total,) = state
        total += row["seq"]
        return (total,), [{"client": row["client"], "seq": row["seq"], "total": total}]

    totals, want = {}, set()
    for seq, client, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        totals[client] = totals.get(client, 0) + seq
        want.add((client, seq, totals[client]))
    for parts in (1, 3):
        live = stream_of(spark, tmp_path, df, f"one{parts}", parts)
        out = st.keyed(
            live, ["client"], ["ts", "seq"], step, (0,), "client bigint, seq bigint, total bigint",
            ordered=True, delay="3600 seconds", buckets=1,
        )
        assert {tuple(r) for r in st.run_available(out, "one").collect() if r.seq < 40} == want


def test_rows_that_wait_are_read_once(spark, monkeypatch):
    import json
    from types import SimpleNamespace

    import pandas as pd

    rows = spark.createDataFrame([(1, 1.0)], "k long, ts double")
    made = []

    class Stream:
        schema, columns = rows.schema, rows.columns

        def __getattr__(self, name):
            def call(*given):
                made.append((name, given))
                return self

            return call

    def step(state, row):
        return (state[0] + 1,), [{"k": row["k"], "n": state[0] + 1}]

    st.keyed(Stream(), ["k"], ["ts"], step, (0,), "k bigint, n bigint", ordered=True)
    update = dict(made)["applyInPandasWithState"][0]
    held = SimpleNamespace(exists=False, hasTimedOut=False, now=0, removed=False)
    held.getCurrentWatermarkMs = lambda: held.now
    held.setTimeoutTimestamp = lambda at: None
    held.update = lambda value: held.__dict__.update(get=value, exists=True)
    held.remove = lambda: held.__dict__.update(exists=False)
    texts = [json.dumps({"k": i % 3, "ts": float(i)}) for i in range(9)]
    batch = pd.DataFrame({"_row": texts})
    read = []
    loads = json.loads
    monkeypatch.setattr(st.json, "loads", lambda text: read.append(text) or loads(text))
    assert [len(x) for x in update((0,), iter([batch]), held)] == [0]
    read.clear()
    assert [len(x) for x in update((0,), iter([]), held)] == [0]
    # the state alone is read, not its rows
    assert len(read) == 2 and read[1] == "[]"
    held.now = 5000
    (out,) = update((0,), iter([]), held)
    assert sorted(out.itertuples(index=False, name=None)) == [(0, 1), (0, 2), (1, 1), (2, 1)]
