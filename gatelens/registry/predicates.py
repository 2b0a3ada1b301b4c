"""Queries for the rule predicates: truth value per call (NULL is UNKNOWN)."""

from pyspark.sql import functions as F

from gatelens.operators import evaluate as ev
from gatelens.operators import predicates as p
from gatelens.operators.ruleset import Rule, RuleSet, all_rules
from gatelens.registry.base import query

# the argument of a call as DuckDB reads it; a broken document has no arguments
DOC = """
SELECT *, CASE WHEN json_valid(args) THEN json(args) END AS j FROM v_call_args
"""


def _truth(t, predicate: p.Predicate):
    base = all_rules()
    rules = RuleSet("one", base.tools, (Rule("R", "CAP", 2, "", predicate),))
    rows = ev.with_tools(t.v_call_args.withColumn("purpose", F.lit(None).cast("string")), rules)
    if predicate.probes:
        rows = ev.with_labels(rows, t.v_call_labels, rules)
    return rows.select("call_id", predicate.build().alias("truth"))


def _register(name: str, predicate: p.Predicate, check: str, **extra: str) -> None:
    @query(name, f"SELECT call_id, {check} AS truth FROM doc", doc=DOC, **extra)
    def run(t):
        return _truth(t, predicate)


_register("prd01_const", p.const(True), "true")
_register(
    "prd02_all",
    p.all_of(p.tool_is("pay_upi"), p.amount_exceeds("/amount_paise", 3000)),
    "CASE WHEN tool <> 'pay_upi' THEN false WHEN json_type(j, '$.amount_paise') = 'UBIGINT' "
    "THEN CAST(j->>'$.amount_paise' AS BIGINT) > 3000 END",
)
_register(
    "prd03_any",
    p.any_of(p.tool_is("pay_upi"), p.amount_exceeds("/amount_paise", 3000)),
    "CASE WHEN tool = 'pay_upi' THEN true WHEN json_type(j, '$.amount_paise') = 'UBIGINT' "
    "THEN CAST(j->>'$.amount_paise' AS BIGINT) > 3000 END",
)
_register(
    "prd04_not",
    ~p.amount_exceeds("/amount_paise", 3000),
    "CASE WHEN json_type(j, '$.amount_paise') = 'UBIGINT' "
    "THEN CAST(j->>'$.amount_paise' AS BIGINT) <= 3000 END",
)
_register("prd05_tool", p.tool_is("add_payee"), "tool = 'add_payee'")
_register(
    "prd06_tool_category",
    p.tool_category_in("PAYMENT", "COMMUNICATION"),
    "CASE WHEN tool = 'wire_all' THEN NULL ELSE tool IN ('pay_upi', 'issue_refund', 'send_email') END",
)
_register(
    "prd07_arg_exists",
    p.arg_exists("/memo"),
    "coalesce(json_exists(j, '$.memo'), false)",
)
_register(
    "prd08_arg_compare_eq",
    p.arg_compare("/name", "eq", "Payee 3"),
    "CASE WHEN json_exists(j, '$.name') THEN json_type(j, '$.name') = 'VARCHAR' AND j->>'$.name' = 'Payee 3' END",
)
_register(
    "prd08_arg_compare_ne",
    p.arg_compare("/amount_paise", "ne", 0),
    "CASE WHEN json_exists(j, '$.amount_paise') THEN json_type(j, '$.amount_paise') <> 'UBIGINT' "
    "OR TRY_CAST(j->>'$.amount_paise' AS BIGINT) <> 0 END",
)
_register(
    "prd08_arg_compare_order",
    p.arg_compare("/amount_paise", "ge", 2500),
    "CASE WHEN json_type(j, '$.amount_paise') = 'UBIGINT' THEN CAST(j->>'$.amount_paise' AS BIGINT) >= 2500 END",
)
# label of one path: join over its leaves, an unlabelled leaf is untrusted
PATH_LABEL = """
SELECT d.call_id, max(coalesce(l.level, 2)) AS level, string_agg(DISTINCT l.tag, ',') AS tags, string_agg(DISTINCT l.source_kind, ',') AS kinds
FROM doc d LEFT JOIN v_call_labels l ON l.call_id = d.call_id AND l.pointer = '{path}'
WHERE json_exists(d.j, '$.{name}') GROUP BY d.call_id
"""


def _register_label(name: str, predicate: p.Predicate, arg: str, check: str) -> None:
    @query(
        name,
        f"SELECT d.call_id, coalesce({check}, false) AS truth FROM doc d LEFT JOIN lab ON lab.call_id = d.call_id",
        doc=DOC,
        lab=PATH_LABEL.format(path=f"/{arg}", name=arg),
    )
    def run(t):
        return _truth(t, predicate)


_register_label("prd09_label_at_least", p.label_at_least("/payee_vpa", 2), "payee_vpa", "lab.level >= 2")
_register_label("prd10_label_has_tag", p.label_has_tag("/to", "PII"), "to", "lab.tags LIKE '%PII%'")
_register_label(
    "prd11_source_kind_in",
    p.source_kind_in("/vpa", "document", "web"),
    "vpa",
    "lab.kinds LIKE '%document%' OR lab.kinds LIKE '%web%'",
)


@query(
    "prd12_purpose_is",
    "SELECT call_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type = 'click' END AS truth FROM v_calls",
)
def purpose_is(t):
    purpose = F.when(
        F.col("event_type") != "error",
        F.when(F.col("event_type") == "click", "order_support").otherwise("marketing"),
    )
    rows = t.v_calls.withColumn("purpose", purpose)
    return rows.select("call_id", p.purpose_is("order_support").build().alias("truth"))


_register(
    "prd17_amount_exceeds",
    p.amount_exceeds("/amount_paise", 4000),
    "CASE WHEN json_type(j, '$.amount_paise') = 'UBIGINT' THEN CAST(j->>'$.amount_paise' AS BIGINT) > 4000 END",
)


@query(
    "prd18_fact",
    "SELECT call_id, CASE WHEN tool = 'pay_upi' THEN amount_paise < 8000 END AS truth FROM v_calls",
)
def fact(t):
    facts = t.v_calls.where("tool = 'pay_upi'").select(
        "call_id", (F.col("amount_paise") < 8000).alias("small")
    )
    rules = RuleSet("one", {}, (Rule("R", "CAP", 2, "", p.fact("small")),))
    rows = ev.with_facts(t.v_calls, facts, rules)
    return rows.select("call_id", p.fact("small").build().alias("truth"))
