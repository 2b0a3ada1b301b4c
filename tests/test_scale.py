"""Work that is done once: stored inputs, running sums, cheap looks before dear ones."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_several_running_totals_share_one_pass_and_the_ledger_is_read_once(spark):
    from gatelens.operators import payments as pay
    from gatelens.plans.timeline import running_totals

    start = datetime(2024, 1, 1)
    data = [(f"t{i:03d}", i % 3, start + timedelta(hours=7 * (i % 40)), None if i % 11 == 0 else i) for i in range(90)]
    ledger = spark.createDataFrame(data, "txn_id string, principal int, ts timestamp, amount_paise long")
    sums = {"spent": F.col("amount_paise"), "n": F.lit(1)}
    got = {r.txn_id: (r.spent, r.n) for r in running_totals(ledger, ["principal"], "ts", ["txn_id"], sums).collect()}
    for name, who, at, _ in data:
        seen = [x[3] or 0 for x in data if x[1] == who and (x[2], x[0]) < (at, name)]
        assert got[name] == (sum(seen), len(seen))
    accounts = spark.createDataFrame([(0, 1000), (1, 50)], "principal int, opening long")
    made = spark.range(90).select(
        F.concat(F.lit("t"), "id").alias("txn_id"), (F.col("id") % 3).cast("int").alias("principal"),
        F.lit(start).alias("ts"), F.col("id").alias("amount_paise"), F.lit("x").alias("payee_vpa"),
    )
    found = pay.execution_delta(made, accounts, keep=["ts", "payee_vpa"])
    assert found.columns == ["txn_id", "ts", "payee_vpa", "balance_before", "balance_after", "rows_before", "rows_after"]
    assert "Range" not in plan_of(found)
    assert found.count() == 90


def test_values_are_looked_up_once_before_texts_are_cut(spark):
    from gatelens.operators.provenance import label_for_values, register_values

    leaves = spark.range(6).select(
        F.col("id").alias("call_id"), F.lit("/body").alias("pointer"), F.lit("T").alias("task_id"),
        F.parse_json(F.concat(F.lit('"for c'), (F.col("id") % 4).cast("string"), F.lit('@mail.example ok"'))).alias("value"),
    )
    tokens = spark.createDataFrame([("T", "s:for c2@mail.example ok")], "task_id string, key string")
    values = spark.range(2).select(
        F.concat(F.lit("c"), "id", F.lit("@mail.example")).alias("text"), F.lit(None).cast("long").alias("number"),
        F.lit(1).alias("level"), F.lit("document").alias("source_kind"), F.lit(None).cast("string").alias("tag"),
    )
    found = label_for_values(leaves, tokens, register_values(values))
    assert "Range" not in plan_of(found)
    got = {r.call_id: r.found for r in found.collect()}
    assert got == {0: "contains", 1: "contains", 2: "task", 3: "model", 4: "contains", 5: "contains"}


HARD = [
    None, "", "a", "id", "a@b.cc", "x <a@b.cc>", "\x01a@b.co", "9876543210", "987654321", "2345 6789 0123", "ABCDE1234F",
    "token:abcdef", "token:abcde", "ſecret=abcdef", "passwd=\x07abcdef", "Bearer abcdefgh", "sk-123456789012", "a&b", "<i>",
    "gateway_session=1", "gateway_session=", "s=1", "\U0001f600" * 9 + "&", "password", "api-key", "line\nfeed\ttab\x85",
]


def scrubbed_by_all(text, **options):
    from gatelens.functions import text as tx

    out = F.regexp_replace(text, tx.CONTROL, "")
    for kind, pattern in tx.secret_patterns(**options):
        out = F.regexp_replace(out, pattern, f"[REDACTED:{kind}]")
    return tx.html_escape(out)


@pytest.mark.parametrize("options", [{}, {"session_cookie": "s"}, {"session_cookie": "s?"}])
def test_short_texts_need_no_pattern(spark, options):
    from gatelens.functions import text as tx
    from gatelens.operators.scan import sanitise_leaves

    texts = spark.createDataFrame([(x,) for x in HARD], "v string")
    any_kind = F.lit(False)
    for _, pattern in tx.secret_patterns(**options):
        any_kind = any_kind | F.coalesce(F.regexp_like("v", F.lit(pattern)), F.lit(False))
    asked = texts.select(
        "v", tx.safe_text("v", **options).alias("got"), scrubbed_by_all(F.col("v"), **options).alias("want"),
        tx.contains_secret("v", **options).alias("hit"), any_kind.alias("any"),
        F.coalesce(tx.may_hold_secret(F.col("v"), **options), F.lit(False)).alias("may"),
    )
    for row in asked.collect():
        assert row.got == row.want and row.hit == row.any and (row.may or not row.hit), row
    pointers = [None, "", "x", "password", "/a/b", "//", "/a/", "/a@b.cc/x", "/Password", "/a<b/c", "/x\x02y/z", "/ABCDE1234F", "/s=1/t", "/n" * 13]
    rows = spark.createDataFrame([(p, "v@w.example") for p in pointers], "pointer string, value string")
    for before, row in zip(pointers, sanitise_leaves(rows, **options).collect(), strict=True):
        names = spark.createDataFrame([(before,)], "p string").select(
            F.slice(F.split("p", "/"), 2, 99).alias("n")
        )
        wanted = names.select(
            F.concat(F.lit("/"), F.array_join(F.transform("n", lambda n: scrubbed_by_all(n, **options)), "/")).alias("p"),
            (F.exists("n", lambda n: F.regexp_like(n, F.lit(tx.SECRET_KEY)) | tx.contains_secret(n)) | (F.size("n") > 12)).alias("m"),
        ).first()
        assert row.pointer == wanted.p and (row.value == tx.REDACTED) == bool(wanted.m), before


def test_leaves_are_opened_once_and_empty_documents_have_none(spark):
    from gatelens.functions.leaves import flatten_args

    docs = ['{"a":{"b":{"c":{"d":{"e":[1,{}]}}}},"f":null}', "{}", "[]", "3", None, "{", '{"x":[]}']
    calls = spark.createDataFrame(list(enumerate(docs)), "call_id int, args string")
    got = sorted((r.call_id, r.pointer) for r in flatten_args(calls).select("call_id", "pointer").collect())
    assert got == [(0, "/a/b/c/d/e/0"), (0, "/a/b/c/d/e/1"), (0, "/f"), (6, "/x")]
    assert plan_of(flatten_args(calls)).count("walk_documents") == 1
    # no filter that computes the whole array again
    assert "size(CASE" not in plan_of(flatten_args(calls))


def test_the_pluggable_classifier_gets_arrow_batches(spark, tmp_path):
    import re

    import __spark_entry__ as entry

    texts = [None, "", "a" * 2500, "é\U0001f600" * 1250, "b" * 5000, "c" * 9000]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["udf02_pluggable_classifier"](spark, str(tmp_path))
    assert {r.doc_id: r.score for r in found.collect()} == {0: None, 1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0, 5: 1.0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    pandas_kinds = {"200", "204"}
    kinds = set(re.findall(r"ArrowEvalPython \[.*\], (\d+)", plan))
    assert kinds and not kinds & pandas_kinds
