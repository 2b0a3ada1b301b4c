"""Rules, labels and verdicts on small hand-made calls."""

import json

import pytest
from pyspark.sql import functions as F

from gatelens.functions.hashing import canonical_json
from gatelens.functions.leaves import flatten_args
from gatelens.operators import evaluate as ev
from gatelens.operators import invariants as iv
from gatelens.operators import labels as lb
from gatelens.operators import predicates as p
from gatelens.operators.ruleset import (
    Arg,
    Rule,
    RuleConflict,
    RuleSet,
    Tool,
    all_rules,
    merge,
    payment_rules,
)

CALL = "call_id string, tool string, declared_category string, args string"
LABEL = "call_id string, pointer string, level int, source_kind string, source_id string, tag string"
GOOD = {
    "mandate_sig_valid": True,
    "mandate_time_valid": True,
    "mandate_nonce_fresh": True,
    "payee_in_mandate": True,
    "amount_within_payee_cap": True,
    "amount_within_per_txn_cap": True,
    "amount_within_daily_cap": True,
    "category_matches": True,
    "approval_valid": False,
    "approval_binding_mismatch": False,
}
PAY = {"payee_vpa": "shop@okaxis", "amount_paise": 100}


def decide(spark, tool, args, labels, facts=None, declared=None, rules=None, ml=None):
    text = args if isinstance(args, str) else json.dumps(args)
    calls = spark.createDataFrame([("c", tool, declared, text)], CALL)
    if ml is not None:
        calls = calls.withColumn("ml_decision", F.lit(ml))
    rows = [("c", ptr, level, "user", "u1", tag) for ptr, level, tag in labels]
    known = {**GOOD, **(facts or {})}
    schema = "call_id string, " + ", ".join(f"{k} boolean" for k in known)
    table = spark.createDataFrame([("c", *known.values())], schema)
    out = ev.evaluate_policy(
        calls, spark.createDataFrame(rows, LABEL), rules or all_rules(), facts=table
    ).first()
    return out.decision, [r.rule_id for r in out.reasons], {r.rule_id: r.unknown for r in out.reasons}


TRUSTED = [("/payee_vpa", 0, None), ("/amount_paise", 0, None)]


@pytest.mark.parametrize(
    ("tool", "args", "labels", "facts", "want"),
    [
        ("pay_upi", PAY, TRUSTED, {}, (0, [])),
        ("pay_upi", PAY, [("/payee_vpa", 2, None), ("/amount_paise", 0, None)], {}, (2, ["PAYSHIELD.TAINT.UNTRUSTED_PAYEE"])),
        ("pay_upi", PAY, TRUSTED, {"mandate_sig_valid": False}, (2, ["PAYSHIELD.MANDATE.SIGNATURE"])),
        ("pay_upi", PAY, TRUSTED, {"amount_within_daily_cap": None}, (1, ["PAYSHIELD.CAP.DAILY"])),
        ("pay_upi", PAY, TRUSTED, {"amount_within_daily_cap": False, "approval_valid": True}, (0, [])),
        ("pay_upi", {**PAY, "x": 1}, TRUSTED, {}, (2, ["CORE.SCHEMA.UNKNOWN_ARG"])),
        ("pay_upi", {"payee_vpa": "a@b", "amount_paise": True}, TRUSTED, {}, (2, ["CORE.SCHEMA.WRONG_TYPE"])),
        ("pay_upi", {"payee_vpa": "a@b"}, TRUSTED, {}, (2, ["CORE.SCHEMA.MISSING_ARG"])),
        ("pay_upi", "{broken", TRUSTED, {}, (2, ["CORE.SCHEMA.MALFORMED_INPUT"])),
        ("nope", PAY, TRUSTED, {}, (2, ["CORE.SCHEMA.UNKNOWN_TOOL"])),
        ("list_payees", {}, [], {}, (0, [])),
        ("issue_refund", {"order_id": "o", "amount_paise": 500_001}, [("/order_id", 0, None), ("/amount_paise", 0, None)], {}, (1, ["CORE.CAP.LARGE_REFUND"])),
        ("issue_refund", {"order_id": "o", "amount_paise": 500_000}, [("/order_id", 0, None), ("/amount_paise", 0, None)], {}, (0, [])),
    ],
)
def test_verdicts(spark, tool, args, labels, facts, want):
    decision, rules, _ = decide(spark, tool, args, labels, facts)
    assert (decision, rules) == want


def test_missing_label_counts_as_untrusted(spark):
    decision, rules, _ = decide(spark, "pay_upi", PAY, [("/amount_paise", 0, None)])
    assert decision == 2
    assert rules == ["PAYSHIELD.TAINT.UNTRUSTED_PAYEE", "CORE.LABEL.MISSING"]


def test_unknown_fires_and_is_marked(spark):
    _, rules, unknown = decide(spark, "pay_upi", PAY, TRUSTED, {"mandate_time_valid": None})
    assert rules == ["PAYSHIELD.MANDATE.TIME"] and unknown["PAYSHIELD.MANDATE.TIME"]


def test_signal_only_tightens(spark):
    assert decide(spark, "pay_upi", PAY, TRUSTED, ml=1)[:2] == (1, ["CORE.ML.SIGNAL"])
    assert decide(spark, "pay_upi", PAY, TRUSTED, ml=0)[:2] == (0, [])
    assert decide(spark, "nope", PAY, TRUSTED, ml=2)[1] == ["CORE.SCHEMA.UNKNOWN_TOOL"]


def test_purpose_rules_on_mail(spark):
    args = {"to": "a@b.example", "subject": "s", "body": "b"}
    labels = [("/to", 0, None), ("/subject", 0, None), ("/body", 0, "PII_EMAIL")]
    both = {"consent_active": True, "sink_allowed_for_purpose": True}
    assert decide(spark, "send_email", args, labels, both)[:2] == (0, [])
    for bad in ({"consent_active": False}, {"sink_allowed_for_purpose": None}):
        decision, rules, _ = decide(spark, "send_email", args, labels, {**both, **bad})
        assert (decision, rules) == (2, ["PURPOSELOCK.EGRESS.PII_WITHOUT_CONSENT"])


def test_nested_argument_labels(spark):
    """A rule on a container argument joins all leaves below it."""
    tool = Tool("WRITE", {"to": Arg("object", True)})
    rule = Rule("R", "LABEL", 2, "", p.label_at_least("/to", 2))
    rules = RuleSet("one", {"send": tool}, (rule,))
    args = {"to": {"name": "x", "box": [1, 2]}}
    covered = [("/to/name", 0, None), ("/to/box", 1, None)]
    assert decide(spark, "send", args, covered, rules=rules)[:2] == (0, [])
    assert decide(spark, "send", args, covered[:1], rules=rules)[0] == 2
    assert decide(spark, "send", args, [("/to", 1, None)], rules=rules)[:2] == (0, [])


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        (p.arg_compare("/n", "eq", 1), True),
        (p.arg_compare("/n", "eq", "1"), False),
        (p.arg_compare("/n", "ne", True), True),
        (p.arg_compare("/t", "eq", True), True),
        (p.arg_compare("/t", "ge", 1), None),
        (p.arg_compare("/s", "lt", "b"), True),
        (p.arg_compare("/z", "eq", None), True),
        (p.arg_compare("/absent", "ne", 1), None),
        (p.arg_compare("/d/e", "gt", 4), True),
        (p.arg_exists("/z"), True),
        (p.arg_exists("/d/e"), True),
        (p.arg_exists("/d/f"), False),
        (p.amount_exceeds("/s", 1), None),
        (p.const(True) & p.arg_compare("/absent", "eq", 1), None),
        (p.const(False) & p.arg_compare("/absent", "eq", 1), False),
        (p.const(True) | p.arg_compare("/absent", "eq", 1), True),
        (~p.arg_compare("/absent", "eq", 1), None),
        (p.all_of(), True),
        (p.any_of(), False),
    ],
)
def test_predicate_truth(spark, predicate, want):
    args = json.dumps({"n": 1, "t": True, "s": "a", "z": None, "d": {"e": 5}})
    calls = spark.createDataFrame([("c", "x", None, args)], CALL)
    rows = ev.with_tools(calls, RuleSet("none", {}, ()))
    assert rows.select(predicate.build().alias("v")).first().v is want


def test_leaves_native_and_any_depth_agree(spark):
    docs = [{"a": {"x~y": [1, {"b/c": []}], "z": None}, "e": {}}, {}, {"deep": {"b": {"c": {"d": {"e": {"f": 1}}}}}}]
    df = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "call_id string, args string")
    deep = {(r.call_id, r.pointer) for r in flatten_args(df, depth=None).collect()}
    native = {(r.call_id, r.pointer) for r in flatten_args(df, depth=8).collect()}
    assert native == deep
    assert ("0", "/a/x~0y/1/b~1c") in native and ("2", "/deep/b/c/d/e/f") in native
    cut = {(r.call_id, r.pointer) for r in flatten_args(df, depth=4).collect()}
    assert ("2", "/deep/b/c/d") in cut


def test_canonical_json(spark):
    rows = [
        ('{"b":1,"a":{"d":[],"c":"é\\u0041"}}', '{"a":{"c":"éA","d":[]},"b":1}'),
        ('{"x":1.5}', None),
        ('{"big":123456789012345678901234567890}', '{"big":123456789012345678901234567890}'),
        ('{"t":true,"n":null}', '{"n":null,"t":true}'),
    ]
    df = spark.createDataFrame(rows, "doc string, want string")
    for r in df.select(canonical_json(F.parse_json("doc")).alias("got"), "want").collect():
        assert r.got == r.want


def test_lattice_laws(spark):
    rows = [("a", 0, "user", "1", "PII_PAN"), ("a", 2, "web", "2", None), ("b", 1, "user", "1", "SECRET")]
    labels = spark.createDataFrame(rows, "k string, level int, source_kind string, source_id string, tag string")
    one = lb.label_join(labels, ["k"])
    twice = lb.label_join(labels.unionByName(labels), ["k"])
    assert one.exceptAll(twice).isEmpty() and twice.exceptAll(one).isEmpty()
    top = {r.k: (r.level, r.kinds, r.tags) for r in one.collect()}
    assert top["a"] == (2, ["user", "web"], ["PII", "PII_PAN"])
    a = F.struct("level", "kinds", "tags")
    assert one.where(~lb.label_leq(a, a)).isEmpty()


def test_conflicting_sets_are_refused():
    other = RuleSet("o", {"pay_upi": Tool("READ", {})}, ())
    with pytest.raises(RuleConflict):
        merge("m", [payment_rules(), other])
    with pytest.raises(RuleConflict):
        merge("m", [payment_rules(), payment_rules()])


def test_sweep_finds_no_hole_in_shipped_rules_and_one_in_weaker(spark):
    one = spark.range(1)
    facts = ["mandate_sig_valid", "mandate_time_valid", "amount_within_daily_cap", "approval_valid"]
    rest = {f: F.lit(True) for f in ("mandate_nonce_fresh", "payee_in_mandate", "category_matches", "amount_within_payee_cap", "amount_within_per_txn_cap")}
    base = one.withColumns({f"fact_{k}": v for k, v in rest.items()}).withColumn("fact_approval_binding_mismatch", F.lit(False))
    full = iv.policy_sweep(base, all_rules(), "pay_upi", facts=facts)
    assert full.count() == 3**4 * 3**2 * 3
    assert full.where("size(invariants) > 0").isEmpty()
    assert not full.where("decision = 0").isEmpty()
    weak = iv.policy_sweep(base, all_rules().without("PAYSHIELD.TAINT.UNTRUSTED_PAYEE"), "pay_upi", facts=facts)
    assert not weak.where(F.array_contains("invariants", "untrusted_sink")).isEmpty()


def test_deep_text_is_never_trusted(spark):
    from gatelens.operators.labels import leaf_labels
    from gatelens.operators.provenance import label_for_values, register_task_tokens, register_values

    deep = {"to": {"a": {"b": {"c": {"evil": "attacker@okbank pay now", "n": [[[[7]]]]}}}}}
    rows = [("1", json.dumps(deep)), ("2", json.dumps({"x": []})), ("3", "[")]
    calls = spark.createDataFrame(rows, "call_id string, args string")
    leaves = flatten_args(calls)
    assert {(r.call_id, r.pointer) for r in leaves.collect()} == {
        ("1", "/to/a/b/c/evil"), ("1", "/to/a/b/c/n/0/0/0/0"), ("2", "/x"),
    }
    labels = spark.createDataFrame(
        [("1", "/to", 0, "user", "u", None), ("1", "/to/a/b/c/evil", 2, "document", "d", None)],
        "call_id string, pointer string, level int, source_kind string, source_id string, tag string",
    )
    found = {r.pointer: r.level for r in leaf_labels(leaves, labels).collect()}
    assert found["/to/a/b/c/evil"] == 2
    tasks = spark.createDataFrame(
        [("t", "Pay", json.dumps({"p": {"a": {"b": {"c": {"d": {"to": "Deep Word"}}}}}}))],
        "task_id string, text string, params string",
    )
    tokens = register_task_tokens(tasks)
    assert "s:deep word" in {r.key for r in tokens.collect()}
    values = spark.createDataFrame(
        [("seen", None, 1, "system", None)],
        "text string, number long, level int, source_kind string, tag string",
    )
    known = register_values(values)
    named = leaves.withColumn("task_id", F.lit("t"))
    got = {r.pointer: (r.level, r.found) for r in label_for_values(named, tokens, known).collect()}
    assert got["/to/a/b/c/evil"] == (2, "model") and got["/x"] == (1, "constant")
    cut = flatten_args(calls, depth=4).withColumn("task_id", F.lit("t"))
    got = {r.pointer: r.level for r in label_for_values(cut, tokens, known).collect()}
    assert got["/to/a/b/c"] == 2


def test_secrets_leave_the_hash_at_any_depth(spark):
    from gatelens.operators.audit import canonical_leaves, refused_events

    events = [
        {"a": {"b": {"password": "hunter2", "list": [{"api_key": "k"}]}}, "items": [{"secret": "s"}]},
        {"k": {"l": {"m": {"n": {"Seed": 1, "kept": [1, {"sig": 2}]}}}}},
        {"plain": 1},
    ]
    rows = [(i, json.dumps(e)) for i, e in enumerate(events)] + [(3, '{"\\u0073eed": 1, "x": 2}'), (4, "[1]")]
    table = spark.createDataFrame(rows, "seq long, event string")
    # what is no object has no leaf, and is named so that it can be set aside
    refused = refused_events(table)
    assert [(r.seq, r.refused) for r in refused.collect()] == [(4, "not a JSON object")]
    got = canonical_leaves(table.join(refused, "seq", "left_anti")).collect()
    assert {r.idx: r.payload for r in got} == {
        0: '{"a":{"b":{"list":[{}]}},"items":[{}]}',
        1: '{"k":{"l":{"m":{"n":{"kept":[1,{}]}}}}}',
        2: '{"plain":1}',
        3: '{"x":2}',
    }


def test_facts_are_those_of_the_time_of_the_call(spark):
    from gatelens.operators.approvals import approval_check
    from gatelens.operators.consents import consent_facts
    from gatelens.operators.payments import FACTS, payment_facts

    calls = spark.sql(
        "SELECT 'c' AS call_id, TIMESTAMP '2024-01-05 00:00:00' AS ts, 1 AS principal, 'old@x' AS payee_vpa, 60L AS amount_paise,"
        " 'READ' AS task_category, CAST(NULL AS STRING) AS declared_category"
    )
    mandates = spark.sql(
        "SELECT * FROM VALUES (1, 'm1', 'n1', 1, TIMESTAMP '2024-01-01 00:00:00', 50L, 50L, array('PAYMENT', 'READ')),"
        " (1, 'm2', 'n1', 2, TIMESTAMP '2024-01-20 00:00:00', 9000L, 9000L, array('PAYMENT'))"
        " AS t(principal, mandate_id, nonce, stored_order, stored_at, per_txn_cap, daily_cap, category)"
    ).selectExpr("*", "TIMESTAMP '2024-01-01 00:00:00' AS nbf", "TIMESTAMP '2025-01-01 00:00:00' AS exp", "'mandate-signer/1' AS key_id", "true AS sig_ok")
    payees = spark.sql("SELECT 'm1' AS mandate_id, 'old@x' AS vpa, 55L AS cap UNION ALL SELECT 'm2', 'new@x', 9000L")
    ledger = spark.sql("SELECT 1 AS principal, TIMESTAMP '2024-01-06 00:00:00' AS ts, 't' AS txn_id, 5L AS amount_paise")
    row = payment_facts(calls, mandates, payees, ledger).first()
    assert (row.payee_in_mandate, row.mandate_nonce_fresh, row.category_matches) == (True, True, True)
    assert not (row.amount_within_per_txn_cap or row.amount_within_daily_cap or row.amount_within_payee_cap)
    later = payment_facts(calls.withColumn("ts", F.expr("TIMESTAMP '2024-02-01 00:00:00'")), mandates, payees, ledger).first()
    assert (later.payee_in_mandate, later.mandate_nonce_fresh, later.category_matches) == (False, False, False)
    assert later.amount_within_per_txn_cap and set(FACTS) < set(later.asDict())

    points = spark.sql(
        "SELECT call_id, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts, 't' AS task_id, 'pay' AS tool, 'd' AS digest"
        " FROM VALUES ('a', 30), ('b', 31), ('c', 40) AS v(call_id, s)"
    )
    approvals = spark.sql(
        "SELECT 't' AS task_id, 'pay' AS tool, 'd' AS digest, TIMESTAMP '2024-01-01 00:00:00' AS issued_at, TIMESTAMP '2024-01-01 00:02:00' AS expires_at,"
        " 'approved' AS status, TIMESTAMP '2024-01-01 00:00:31' AS consumed_ts, true AS sig_ok"
    )
    assert {r.call_id: r.approval_valid for r in approval_check(points, approvals).collect()} == {"a": True, "b": False, "c": False}

    asked = spark.sql(
        "SELECT call_id, ts, 'read_customer_data' AS tool, 'order_support' AS purpose, CAST(NULL AS STRING) AS `to` FROM VALUES"
        " ('a', TIMESTAMP '2024-01-05 00:00:00'), ('b', TIMESTAMP '2024-06-01 00:00:00') AS v(call_id, ts)"
    )
    subjects = spark.sql("SELECT 'a' AS call_id, '7' AS subject UNION ALL SELECT 'b', '7'")
    consents = spark.sql(
        "SELECT 7 AS principal_id, 'customer_data' AS category, 'order_support' AS purpose, TIMESTAMP '2025-01-01 00:00:00' AS exp,"
        " TIMESTAMP '2024-06-01 00:00:00' AS withdrawn_at"
    )
    emails = spark.sql("SELECT '7' AS subject, 'e@x' AS email")
    found = {r.call_id: r.consent_active for r in consent_facts(asked, subjects, consents, emails).collect()}
    assert found == {"a": True, "b": False}


def test_a_report_with_two_heads_is_not_ok(spark):
    from gatelens.operators.audit import verify_report

    entries = spark.createDataFrame([], "idx long, proof_idx long, payload string, domain string, leaf_hash string, path array<string>, tree_size long, root string")
    heads = spark.createDataFrame([(1, "r", True), (1, "r", True)], "size long, root string, sig_ok boolean")
    assert verify_report(entries, heads.limit(1), "d").first().ok
    assert not verify_report(entries, heads, "d").first().ok


def test_keys_are_sorted_by_code_point(spark):
    rows = [('{"\\uffee":1,"\\ud83d\\ude42":{"b":[true,null],"a":"x"},"a":2}',), ('{"b":1,"a":2}',), ('{"a":1.5}',)]
    got = spark.createDataFrame(rows, "t string").select(canonical_json(F.try_parse_json("t")).alias("c")).collect()
    assert [r.c for r in got] == ['{"a":2,"\uffee":1,"\U0001f642":{"a":"x","b":[true,null]}}', '{"a":2,"b":1}', None]
