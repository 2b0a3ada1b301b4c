"""Skew-safe plan helpers against brute force, with one key holding most of the rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gatelens.plans.order_stats import ceil_rank, exact_median, order_statistics
from gatelens.plans.skew import lookup, newest_per_key, oldest_per_key, top_n_per_key
from gatelens.plans.timeline import as_of, running_total, stab_count, stab_min

START = datetime(2024, 1, 1)


def hot_rows(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}"
        at = START + timedelta(seconds=rng.randrange(0, 400_000, 7))
        rows.append((i, key, at, rng.randrange(50)))
    return rows


def test_running_total_matches_brute_force(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, v long")
    got = {
        r.id: r.s
        for r in running_total(df, ["k"], "ts", ["id"], F.col("v"), "s", fine=3600, coarse=86400).collect()
    }
    for i, key, at, _ in rows:
        assert got[i] == sum(v for j, k, t, v in rows if k == key and (t, j) < (at, i))


def test_as_of_matches_brute_force(spark):
    left, right = hot_rows(300, 2), hot_rows(200, 3)
    calls = spark.createDataFrame(left, "id long, k string, ts timestamp, v long")
    history = spark.createDataFrame(right, "hid long, k string, hts timestamp, hv long")
    for inclusive in (True, False):
        joined = as_of(calls, history, ["k"], "ts", "hts", ["hid"], ties=["hid"], inclusive=inclusive)
        got = {r.id: r.hid for r in joined.collect()}
        assert len(got) == len(left)
        for i, key, at, _ in left:
            past = [(t, h) for h, k, t, _ in right if k == key and (t <= at if inclusive else t < at)]
            assert got[i] == (max(past)[1] if past else None)


def test_stab_count_matches_brute_force(spark):
    points = hot_rows(200, 4)
    spans = [(k, t, t + timedelta(seconds=random.Random(i).randrange(0, 90_000))) for i, k, t, _ in hot_rows(200, 5)]
    p = spark.createDataFrame(points, "id long, k string, ts timestamp, v long")
    s = spark.createDataFrame(spans, "k string, a timestamp, b timestamp")
    for closed in (True, False):
        got = {r.id: r.n for r in stab_count(p, s, ["k"], "ts", "a", "b", "n", closed_end=closed).collect()}
        for i, key, at, _ in points:
            assert got[i] == sum(k == key and a <= at and (at <= b if closed else at < b) for k, a, b in spans)


def test_stab_min_matches_brute_force(spark):
    rng = random.Random(7)
    points = [(i, k, t + timedelta(microseconds=rng.choice([0, 0, 1, 999_999]))) for i, k, t, _ in hot_rows(250, 8)]
    spans = []
    for i, k, t, v in hot_rows(250, 9):
        a = None if i % 9 == 0 else t + timedelta(microseconds=rng.choice([0, 0, 5]))
        b = None if i % 7 == 0 else t + timedelta(seconds=rng.randrange(-50, 90_000), microseconds=rng.choice([0, 0, 3]))
        spans.append((k, a, b, rng.randrange(1000)))
    spans += [("hot", points[3][2], points[3][2] + timedelta(microseconds=1), -5), ("k1", points[9][2], points[9][2], -9)]
    got = stab_min(
        spark.createDataFrame(points, "id long, k string, ts timestamp"),
        spark.createDataFrame(spans, "k string, a timestamp, b timestamp, v long"),
        ["id"], ["k"], "ts", "a", "b", "v", "m",
    ).collect()
    assert sorted(r.id for r in got) == sorted(p[0] for p in points)
    for row in got:
        _, key, at = points[row.id]
        inside = [v for k, a, b, v in spans if k == key and (a is None or a <= at) and (b is None or at < b)]
        assert row.m == min(inside, default=None)


def test_order_statistics_with_brackets_and_whole_groups(spark):
    rows = [("hot", float(v % 977)) for v in range(40_000)] + [("small", float(v)) for v in (5, 1, 9)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranks = {"p50": (0.5, ceil_rank(50)), "p99": (0.99, ceil_rank(99))}
    for small in (10, 100_000):  # the small limit forces the sketch to bracket the hot group
        got = {r.k: (r.n, r.p50, r.p99) for r in order_statistics(df, ["k"], "v", ranks, small=small).collect()}
        for key in ("hot", "small"):
            values = sorted(v for k, v in rows if k == key)
            n = len(values)
            want = (n, values[-(-n * 50 // 100) - 1], values[-(-n * 99 // 100) - 1])
            assert got[key] == want


def test_distinct_values_of_a_group_do_not_meet_in_one_task(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(60_000).select(F.lit("k").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(59_999)) * 3).alias("v"))
        stats = order_statistics(df, ["k"], "v", {"p99": (0.99, ceil_rank(99))}, small=10)
        values = sorted(3 * ((i * 7919) % 59_999) for i in range(60_000))
        assert stats.first().p99 == values[-(-60_000 * 99 // 100) - 1]
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "_salt" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_exact_median_of_even_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 10), ("a", 4)], "k string, v long")
    assert exact_median(df, ["k"], "v", "m").first().m == 3.0


def test_lookup_keeps_every_row_once(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(500)], "id long, k string")
    table = spark.createDataFrame([("hot", 1)], "k string, v int")
    out = lookup(rows, table, ["k"])
    assert out.count() == 500
    assert out.where("v IS NULL").count() == sum(i % 3 == 0 for i in range(500))


def test_edges_and_top_n(spark):
    rows = hot_rows(300, 6)
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, v long")
    newest = {r.k: r.id for r in newest_per_key(df, ["k"], ["ts", "id"]).collect()}
    oldest = {r.k: r.id for r in oldest_per_key(df, ["k"], ["ts", "id"]).collect()}
    top = top_n_per_key(df, ["k"], [F.desc("v"), F.desc("id")], 5).collect()
    for key in {k for _, k, _, _ in rows}:
        mine = [(t, i) for i, k, t, _ in rows if k == key]
        assert newest[key] == max(mine)[1] and oldest[key] == min(mine)[1]
        want = sorted(((v, i) for i, k, _, v in rows if k == key), reverse=True)[:5]
        assert sorted(((r.v, r.id) for r in top if r.k == key), reverse=True) == want


def test_order_statistics_on_both_sides_of_the_bracket_size(spark):
    from gatelens.plans.order_stats import WHOLE, half_even_index, half_even_rank, upper_middle

    ranks = {"mid": (0.5, upper_middle), "p95": (0.95, half_even_rank(0.95)), "p99": (0.99, half_even_index(0.99))}
    for n in (1, 2, 7, WHOLE - 1, WHOLE, WHOLE + 1, 3 * WHOLE, 250_000):
        df = spark.range(n).select(
            F.lit("k").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(n)) * F.lit(3)).alias("v")
        )
        row = order_statistics(df, ["k"], "v", ranks).first()
        values = [3 * i for i in range(n)]
        at = {"mid": n // 2 + 1, "p95": min(n, max(1, round(0.95 * n + 0.5))), "p99": min(n, round(0.99 * (n - 1)) + 1)}
        assert row.n == n and {c: row[c] for c in ranks} == {c: values[r - 1] for c, r in at.items()}


def test_a_cycle_of_handles_is_reported(spark):
    from gatelens.operators.provenance import handle_roots

    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")]
    got = {r.handle: (r.root, r.depth) for r in handle_roots(spark.createDataFrame(rows, "handle string, parent string")).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": (None, None), "y": (None, None), "z": (None, None)}


def test_contained_texts_meet_without_a_broadcast(spark):
    from gatelens.operators.provenance import substring_taint

    texts = [f"c{i}@mail.example" for i in range(1, 40)] + ["amber", "amberly", None]
    values = [(i, f"to C{i % 50}@mail.example, c{i}@Mail.example amberly") for i in range(60)] + [(60, None), (61, "c1@mail")]
    want = {(i, t) for i, v in values for t in texts if v and t and len(t) >= 6 and t in v.lower()}
    found = substring_taint(
        spark.createDataFrame(values, "id long, value string"), spark.createDataFrame([(t,) for t in texts], "text string"), ["id"]
    )
    assert {tuple(r) for r in found.collect()} == want
    # pieces are many more than the texts they are cut from, so no estimate may send them to the driver
    assert "BroadcastExchange" not in found._jdf.queryExecution().toString()


def test_least_value_of_keys_with_few_and_with_many_intervals(spark):
    import random

    from gatelens.plans.timeline import stab_min

    draw = random.Random(5)
    spans = [(k, draw.randrange(900), draw.randrange(900), draw.randrange(50)) for k in (1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3)]
    asks = [(i, draw.choice((1, 2, 3, 4, None)), draw.randrange(900)) for i in range(300)]
    asks += [(None, 2, 450), (7, 2, 451)]
    at = "k, v, timestamp_seconds(a) AS a, timestamp_seconds(b) AS b"
    held = spark.createDataFrame(spans, "k int, a long, b long, v int").selectExpr(*at.split(", "))
    points = spark.createDataFrame(asks, "id int, k int, t long").selectExpr("id", "k", "timestamp_seconds(t) AS t")

    def least(i, k, t):
        # points that share an id share their least value
        same = [(q, u) for j, q, u in asks if j == i] if i is not None else []
        return min((v for q, u in same for key, a, b, v in spans if key == q and a <= u < b), default=None)

    want = sorted(((i, least(i, k, t)) for i, k, t in asks), key=str)
    for few in (0, 4, 64):
        found = stab_min(points, held, ["id"], ["k"], "t", "a", "b", "v", "w", few=few)
        assert sorted((tuple(r) for r in found.collect()), key=str) == want
    # a point of a key with few intervals is one row
    plan = stab_min(points, held, ["id"], ["k"], "t", "a", "b", "v", "w")._jdf.queryExecution().optimizedPlan().toString()
    assert "_level" not in plan
