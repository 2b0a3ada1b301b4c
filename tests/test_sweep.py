import math

import pytest
from pyspark.sql import functions as F

from gatelens.operators import predicates as p
from gatelens.operators.invariants import policy_counts, policy_sweep
from gatelens.operators.ruleset import DENY, STEP_UP, UNTRUSTED, Arg, Rule, RuleSet, Tool, all_rules

ENDS = 24  # signals by stages that fail, or none


def counted(spark, ruleset, tools, args="{}", **more):
    calls = spark.createDataFrame([(t, args) for t in tools], "tool string, args string")
    return {r.tool: r for r in policy_counts(calls, ruleset, **more).collect()}


@pytest.mark.parametrize(
    ("tool", "facts", "weakened"),
    [
        ("add_payee", ["approval_binding_mismatch", "approval_valid"], True),
        ("send_email", ["consent_active", "sink_allowed_for_purpose", "approval_valid", "approval_binding_mismatch"], True),
        ("pay_upi", None, False),
        ("pay_upi", None, True),
    ],
)
def test_counts_equal_full_enumeration(spark, tool, facts, weakened):
    rules = all_rules()
    if weakened:
        rules = rules.without("PAYSHIELD.TAINT.UNTRUSTED_PAYEE", "PAYSHIELD.TAINT.UNTRUSTED_NEW_PAYEE", "PAYSHIELD.MANDATE.TIME", "PURPOSELOCK.TAINT.UNTRUSTED_RECIPIENT")
    if tool == "pay_upi":
        # unknown and false facts of a mandate are told apart by the rules alone, so four are fixed
        facts = ["mandate_time_valid", "amount_within_daily_cap", "approval_valid", "approval_binding_mismatch"]
        fixed = ["mandate_sig_valid", "mandate_nonce_fresh", "payee_in_mandate", "category_matches", "amount_within_payee_cap", "amount_within_per_txn_cap"]
        base = spark.range(1).select(*[F.lit(True).alias(f"fact_{f}") for f in fixed])
    else:
        base = spark.range(1)
    tags = sorted({x.name for x in rules.probes() if x.what == "tag" and x.path[1:] in rules.tools[tool].args})
    levels = [f"/{n}" for n in rules.tools[tool].args if n != "note"]
    base = base.select("*", *[F.explode(F.array(F.lit(1), F.lit(None).cast("int"))).alias(t) for t in tags[:1]])
    for t in tags[1:]:
        base = base.withColumn(t, F.explode(F.array(F.lit(1), F.lit(None).cast("int"))))
    swept = policy_sweep(base, rules, tool, facts=facts, levels=levels).where("_signal = 0")
    allowed = F.col("decision") == 0
    whole = swept.agg(
        F.count("*").alias("n"),
        F.count_if(allowed).alias("allowed"),
        F.count_if(F.array_contains("invariants", "untrusted_sink")).alias("untrusted"),
        F.count_if(F.array_contains("invariants", "unmandated_payment")).alias("unmandated"),
    ).first()
    got = counted(spark, rules, [tool])[tool]
    if tool == "pay_upi":
        fired = 3 ** 10 * 9 * ENDS
        assert got.combinations == fired
        if not weakened:
            # all five mandate facts hold, no mismatch, trusted labels; caps hold or the approval does
            assert got.allowed == 4 * (27 + 2) and got.untrusted_sink == got.unmandated_payment == 0
        else:
            assert got.allowed == 3 * 6 * (27 + 2)
            assert got.untrusted_sink == 3 * 2 * 2 * 1
            assert got.unmandated_payment == 2 * 6 * (27 + 2)
        assert whole.n == 3 ** 4 * 9
    else:
        spare = 3 ** (1 if tool == "send_email" and "/subject" not in levels else 0)
        assert got.combinations == whole.n * ENDS * spare
        assert got.allowed == whole.allowed * spare
        assert got.untrusted_sink == whole.untrusted * spare
    assert got.lowered == got.allowed_after_failure == 0


def test_optional_arguments_and_what_rules_read_of_them(spark):
    tools = {"act": Tool("READ", {"who": Arg("string", sink=True), "sum": Arg("integer", True)})}
    rules = (
        Rule("A", "LABEL", STEP_UP, "", p.label_at_least("/who", UNTRUSTED) & ~p.fact("approval_valid")),
        Rule("B", "CAP", DENY, "", p.amount_exceeds("/sum", 10)),
        Rule("C", "CAP", DENY, "", p.tool_is("other") & p.fact("never")),
    )
    calls = [("act", '{"sum":5}'), ("act", '{"sum":5}'), ("act", '{"sum":11}'), ("act", "broken"), ("nothing", "{}")]
    found = policy_counts(spark.createDataFrame(calls, "tool string, args string"), RuleSet("x", tools, rules)).collect()
    got = {r.base: r for r in found}
    assert set(got) == {'{"sum":5}', '{"sum":11}'}
    for row in found:
        assert row.combinations == 3 * 2 * 3 * ENDS  # level, presence, approval
    # all but an untrusted one that is there and not approved
    assert got['{"sum":5}'].calls == 2 and got['{"sum":5}'].allowed == 18 - 2
    assert got['{"sum":11}'].allowed == 0
    weak = policy_counts(spark.createDataFrame(calls, "tool string, args string"), RuleSet("x", tools, rules[1:])).collect()
    assert {r.base: r.untrusted_sink for r in weak} == {'{"sum":5}': 2, '{"sum":11}': 0}


def test_every_tool_is_swept(spark):
    rules = all_rules()
    got = counted(spark, rules, sorted(rules.tools))
    assert set(got) == set(rules.tools)
    for row in got.values():
        assert row.untrusted_sink == row.lowered == row.allowed_after_failure == row.unmandated_payment == 0
        assert row.unconsented_personal_data == 0
        assert row.allowed > 0 and math.log(row.combinations / ENDS / 2**9, 3) < 30
    part = counted(spark, rules.without("PAYSHIELD.MANDATE.PAYEE"), ["pay_upi"], merge_every=1)["pay_upi"]
    assert part.unmandated_payment > 0
