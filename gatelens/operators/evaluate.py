"""Deciding calls: schema checks, label coverage, every rule, one verdict per call.

The plan is two shuffles by call id (calls and labels; facts add one more when they are not
already laid out by call id) and one projection. Rules are Columns, so Catalyst evaluates all
of them in a single pass over the call row.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.hashing import canonical_json, sha256_hex
from gatelens.functions.leaves import flatten_args, with_leaves
from gatelens.functions.scalars import escape_token, is_prefix, strip
from gatelens.operators import predicates as p
from gatelens.operators.labels import cover_labels
from gatelens.operators.ruleset import ALLOW, ARG_STRUCT, DECISION_NAMES, DENY, STEP_UP, UNTRUSTED, RuleSet

REASON = (
    "struct<rule_id:string,stage:string,decision:int,explanation:string,unknown:boolean,"
    "evidence:string>"
)
MISSING_LABEL = "CORE.LABEL.MISSING"
SIGNAL = "CORE.ML.SIGNAL"


def reason(
    rule_id: str | Column,
    stage: str,
    decision: int | Column,
    text: str | Column,
    *,
    unknown: Column | None = None,
    evidence: Column | None = None,
) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        lit(rule_id).alias("rule_id"),
        F.lit(stage).alias("stage"),
        lit(decision).cast("int").alias("decision"),
        lit(text).alias("explanation"),
        (F.lit(False) if unknown is None else unknown).alias("unknown"),
        (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"),
    )


def combine(reasons: Column) -> Column:
    """Most restrictive decision; without reasons ALLOW."""
    return F.coalesce(F.array_max(F.transform(reasons, lambda r: r["decision"])), F.lit(ALLOW))


def order_reasons(reasons: Column) -> Column:
    """Most restrictive first, then by rule id."""
    keyed = F.transform(
        reasons,
        lambda r: F.struct(
            (-r["decision"]).alias("k"), r["rule_id"].alias("id"), r.alias("reason")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["reason"])


def decision_name(decision: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in DECISION_NAMES]), decision)


# ---------------------------------------------------------------- preparing call rows


NO_TYPES = "map<string,string>"


def with_tools(calls: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Add the declared category and argument specs (NULL for unknown tools), the parsed
    arguments and the JSON type of each of them."""
    types = (
        f"transform_values(coalesce(try_variant_get({p.ARGS}, '$', 'map<string,variant>'), "
        f"CAST(map() AS map<string,variant>)), (k, v) -> {p.json_type_sql('v')})"
    )
    typed = calls.withColumn(p.ARGS, F.try_parse_json("args")).withColumns(
        {p.TYPES: F.expr(types), "_spec": ruleset.tool_spec(F.col("tool"))}
    )
    return typed.select("*", "_spec.*").drop("_spec")


def label_probes(labels: DataFrame, probes: list[p.Probe]) -> DataFrame:
    """One row per call: its labelled pointers and the answers for scalar arguments.

    Everything but the pointers is a plain ``max``, combined before the shuffle. Pointers are
    bounded by the size of a call's arguments, and repeats collapse before the shuffle too.
    """
    answers = [
        F.max(F.when(F.col("pointer") == probe.path, probe.answer())).alias(probe.name)
        for probe in probes
    ]
    return labels.groupBy("call_id").agg(F.collect_set("pointer").alias("_pointers"), *answers)


def nested_probes(
    calls: DataFrame, labels: DataFrame, probes: list[p.Probe]
) -> DataFrame:
    """Answers for container arguments: the join over all leaves under the path."""
    covered = cover_labels(flatten_args(calls), labels)
    answers = []
    for probe in probes:
        under = is_prefix(F.lit(probe.path), F.col("pointer"))
        value = probe.answer()
        if probe.what == "level":
            value = F.coalesce(value, F.lit(UNTRUSTED))
        answers.append(F.max(F.when(under, value)).alias(probe.name))
    return covered.groupBy("call_id").agg(*answers)


def with_pointers(calls: DataFrame, out: str) -> DataFrame:
    """Add the pointers of all leaves; only calls with container arguments are opened further."""
    top = F.transform(
        F.map_entries(p.TYPES),
        lambda e: F.concat(F.lit("/"), escape_token(e["key"])),
    )
    nested = F.exists(F.map_values(p.TYPES), lambda t: t.isin("array", "object"))
    opened = with_leaves(calls, F.when(nested, F.col(p.ARGS)), "_leaves")
    deep = F.transform("_leaves", lambda x: x["pointer"])
    return opened.withColumn(out, F.when(nested, deep).otherwise(top)).drop("_leaves")


def with_labels(calls: DataFrame, labels: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Add the answers to the rules' label probes and the list of unlabelled leaves."""
    probes = ruleset.probes()
    flat = [x for x in probes if ruleset.is_scalar(x.path)]
    nested = [x for x in probes if not ruleset.is_scalar(x.path)]
    rows = calls.join(label_probes(labels, flat), "call_id", "left")
    if nested:
        rows = rows.join(nested_probes(calls, labels, nested), "call_id", "left")
    known = F.coalesce("_pointers", F.array().cast("array<string>"))
    unlabelled = F.filter(
        "_leaf_pointers", lambda leaf: ~F.exists(known, lambda k: is_prefix(k, leaf))
    )
    rows = with_pointers(rows, "_leaf_pointers")
    return rows.withColumn("_missing", F.array_sort(unlabelled)).drop(
        "_pointers", "_leaf_pointers"
    )


def with_facts(calls: DataFrame, facts: DataFrame | None, ruleset: RuleSet) -> DataFrame:
    """Add one nullable ``fact_`` column per fact the rules read; facts not given are UNKNOWN."""
    wanted = ruleset.facts()
    given_columns = [] if facts is None else facts.columns
    known = [f for f in wanted if f in given_columns]
    extra = [c for c in ("ml_decision", "purpose") if c in given_columns and c not in calls.columns]
    if known or extra:
        given = facts.select("call_id", *extra, *[F.col(f).alias(f"fact_{f}") for f in known])
        calls = calls.join(given, "call_id", "left")
    unknown = F.lit(None).cast("boolean")
    return calls.withColumns({f"fact_{f}": unknown for f in wanted if f not in known})


# ---------------------------------------------------------------- reasons


def unknown_tool_reasons() -> Column:
    return F.when(
        F.col("specs").isNull(),
        F.array(
            reason(
                "CORE.SCHEMA.UNKNOWN_TOOL",
                "SCHEMA",
                DENY,
                "Tool is not declared in the policy",
                evidence=F.col("tool"),
            )
        ),
    )


def category_mismatch_reasons() -> Column:
    differs = F.col("declared_category") != F.col(p.CATEGORY)
    return F.when(
        F.coalesce(differs, F.lit(False)),
        F.array(
            reason(
                "CORE.SCHEMA.CATEGORY_MISMATCH",
                "SCHEMA",
                DENY,
                "Declared category differs from policy",
                evidence=F.concat_ws("/", "declared_category", p.CATEGORY),
            )
        ),
    ).otherwise(F.array().cast(f"array<{REASON}>"))


def unknown_arg_reasons() -> Column:
    declared = F.transform("specs", lambda s: s["name"])
    return F.transform(
        F.array_sort(F.array_except(F.map_keys(p.TYPES), declared)),
        lambda name: reason(
            "CORE.SCHEMA.UNKNOWN_ARG",
            "SCHEMA",
            DENY,
            "Argument is not declared for this tool",
            evidence=name,
        ),
    )


def wrong_type_reasons() -> Column:
    """Declared arguments whose JSON type differs; a boolean is not an integer."""
    wrong = F.filter(
        "specs",
        lambda s: F.coalesce(
            F.try_element_at(F.col(p.TYPES), s["name"]) != s["type"], F.lit(False)
        ),
    )
    return F.transform(
        wrong,
        lambda s: reason(
            "CORE.SCHEMA.WRONG_TYPE",
            "SCHEMA",
            DENY,
            "Argument has the wrong type",
            evidence=F.concat_ws(":", s["name"], s["type"]),
        ),
    )


def missing_arg_reasons() -> Column:
    absent = F.filter(
        "specs", lambda s: s["required"] & ~F.map_contains_key(F.col(p.TYPES), s["name"])
    )
    return F.transform(
        absent,
        lambda s: reason(
            "CORE.SCHEMA.MISSING_ARG",
            "SCHEMA",
            DENY,
            "Required argument is missing",
            evidence=s["name"],
        ),
    )


def malformed_reasons() -> Column:
    """Arguments that are not a JSON object are a DENY row, never a dropped row."""
    kind = F.expr(p.json_type_sql(p.ARGS))
    return F.when(
        F.coalesce(kind != "object", F.lit(True)),
        F.array(
            reason(
                "CORE.SCHEMA.MALFORMED_INPUT",
                "PARSE",
                DENY,
                "Input could not be validated as a tool call and context",
                evidence=F.coalesce(kind, F.lit("unparsable")),
            )
        ),
    )


def schema_reasons() -> Column:
    return F.coalesce(
        malformed_reasons(),
        unknown_tool_reasons(),
        F.concat(
            category_mismatch_reasons(),
            unknown_arg_reasons(),
            wrong_type_reasons(),
            missing_arg_reasons(),
        ),
    )


def missing_label_reasons() -> Column:
    return F.when(
        F.size("_missing") > 0,
        F.array(
            reason(
                MISSING_LABEL,
                "LABEL",
                ALLOW,
                "Argument had no label; treated as UNTRUSTED",
                evidence=F.array_join("_missing", ","),
            )
        ),
    ).otherwise(F.array().cast(f"array<{REASON}>"))


def fired(when: Column) -> Column:
    """A rule fires when its predicate is TRUE or UNKNOWN."""
    return F.coalesce(when, F.lit(True))


def rule_reasons(ruleset: RuleSet) -> Column:
    """Reasons of all rules that fire, in the order of the set."""
    if not ruleset.rules:
        return F.array().cast(f"array<{REASON}>")
    # one CASE per rule keeps the projection free of lambdas, so it stays in generated code
    built = ", ".join(
        f"CASE WHEN coalesce({r.when.sql}, true) THEN named_struct("
        f"'rule_id', {p.quoted(r.rule_id)}, 'stage', {p.quoted(r.stage)}, "
        f"'decision', {r.then}, 'explanation', {p.quoted(r.explain)}, "
        f"'unknown', {r.when.sql} IS NULL, 'evidence', CAST(NULL AS string)) END"
        for r in ruleset.rules
    )
    return F.expr(f"array_compact(array({built}))")


# ---------------------------------------------------------------- the decision


def prepared(
    calls: DataFrame, labels: DataFrame, ruleset: RuleSet, facts: DataFrame | None
) -> DataFrame:
    """Calls with everything the rules read, and their schema problems in ``_schema``."""
    rows = with_facts(with_labels(with_tools(calls, ruleset), labels, ruleset), facts, ruleset)
    for name, kind in (("purpose", "string"), ("ml_decision", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.withColumn("_schema", schema_reasons())


def found_reasons(ruleset: RuleSet) -> Column:
    """Reasons of a prepared call under a rule set."""
    return F.when(F.size("_schema") > 0, F.col("_schema")).otherwise(
        F.concat(missing_label_reasons(), rule_reasons(ruleset))
    )


def evaluate_policy(
    calls: DataFrame,
    labels: DataFrame,
    ruleset: RuleSet,
    *,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Verdict per call: the input columns plus ``category``, ``decision`` and ``reasons``.

    ``calls`` needs ``call_id``, ``tool``, ``declared_category`` and ``args`` (JSON text);
    ``purpose`` and ``ml_decision`` are read when present there or among the facts. Schema problems stop the rules, as
    does an unknown tool. Rules can only escalate, and so can the signal in ``ml_decision``.
    """
    keep = calls.columns
    rows = prepared(calls, labels, ruleset, facts).withColumn("_found", found_reasons(ruleset))
    return tighten_with_signal(
        rows.select(
            *keep,
            p.CATEGORY,
            combine(F.col("_found")).alias("rule_decision"),
            F.col("_found").alias("reasons"),
            (F.size("_schema") > 0).alias("schema_failed"),
            F.col("ml_decision").cast("int").alias("_signal"),
        )
    )


def tighten_with_signal(verdicts: DataFrame) -> DataFrame:
    """Combine ``rule_decision`` with ``_signal``; a reason is added only when it tightens.

    Calls refused for their schema are never looked at by the signal.
    """
    tightens = ~F.col("schema_failed") & F.coalesce(
        F.col("_signal") > F.col("rule_decision"), F.lit(False)
    )
    added = F.array(
        reason(SIGNAL, "ML", F.col("_signal"), "ML signal tightened the decision")
    )
    return (
        verdicts.withColumn(
            "decision", F.when(tightens, F.col("_signal")).otherwise(F.col("rule_decision"))
        )
        .withColumn(
            "reasons",
            order_reasons(
                F.when(tightens, F.concat("reasons", added)).otherwise(F.col("reasons"))
            ),
        )
        .drop("_signal")
    )


def compare_policies(
    calls: DataFrame,
    labels: DataFrame,
    before: RuleSet,
    after: RuleSet,
    *,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Calls whose decision differs between two rule sets.

    Sets for the same tools are decided side by side on one prepared row; otherwise each set is
    evaluated by itself.
    """
    changed = F.col("decision_before") != F.col("decision_after")
    if before.tools != after.tools:
        old = evaluate_policy(calls, labels, before, facts=facts).select(
            "call_id", "tool", F.col("decision").alias("decision_before")
        )
        new = evaluate_policy(calls, labels, after, facts=facts).select(
            "call_id", F.col("decision").alias("decision_after")
        )
        return old.join(new, "call_id").where(changed)
    both = RuleSet(f"{before.name}+{after.name}", before.tools, before.rules + after.rules)
    rows = prepared(calls, labels, both, facts)
    ruled = rows.select(
        "call_id",
        "tool",
        (F.size("_schema") > 0).alias("_failed"),
        F.col("ml_decision").cast("int").alias("_signal"),
        combine(found_reasons(before)).alias("_before"),
        combine(found_reasons(after)).alias("_after"),
    )

    def tightened(decision: str) -> Column:
        above = ~F.col("_failed") & F.coalesce(F.col("_signal") > F.col(decision), F.lit(False))
        return F.when(above, F.col("_signal")).otherwise(F.col(decision))

    return ruled.select(
        "call_id",
        "tool",
        tightened("_before").alias("decision_before"),
        tightened("_after").alias("decision_after"),
    ).where(changed)


#: Errors that the evidence of a malformed call names.
MOST_ERRORS = 20


def error_evidence(
    errors: DataFrame, known: Sequence[str], *, key: str = "call_id", most: int = MOST_ERRORS
) -> DataFrame:
    """``key``, ``errors``: the first distinct ``location: kind`` texts of each malformed call.

    ``errors`` has ``key``, ``path`` (array of texts) and ``kind``. Steps of a path that are not
    ``known`` field names may be chosen by an attacker and become ``*``. What is masked alike is one
    error, so a call has few of them however many keys it holds.
    """
    step = lambda name: F.when(name.isin(*known), name).otherwise("*")
    place = F.array_join(F.transform("path", step), "/")
    told = errors.select(key, F.concat(place, F.lit(": "), F.col("kind")).alias("_error"))
    listed = told.groupBy(key).agg(F.array_sort(F.collect_set("_error")).alias("errors"))
    return listed.select(key, F.slice("errors", 1, most).alias("errors"))


def call_errors(calls: DataFrame, ruleset: RuleSet) -> DataFrame:
    """``call_id, path, kind``: every place where a call does not fit the tool it names.

    The arguments are walked by the tool's own specification: undeclared, missing and mistyped ones
    each have their place, arguments that are no object one for all. The tool and the declared
    category are fields of their own. All of it is expressions on the prepared row.
    """
    rows = with_tools(calls, ruleset)
    kind = F.expr(p.json_type_sql(p.ARGS))
    none = F.array().cast("array<struct<path:array<string>,kind:string>>")

    def error(what: Column | str, *steps: Column | str) -> Column:
        path = F.array(*[s if isinstance(s, Column) else F.lit(s) for s in steps])
        return F.struct(path.alias("path"), (what if isinstance(what, Column) else F.lit(what)).alias("kind"))

    def one(when: Column, found: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.array(found)).otherwise(none)

    is_object = F.coalesce(kind == "object", F.lit(False))
    specs = F.coalesce("specs", F.array().cast(f"array<{ARG_STRUCT}>"))
    declared = F.transform(specs, lambda s: s["name"])
    given = lambda s: F.map_contains_key(F.col(p.TYPES), s["name"])
    mistyped = lambda s: F.try_element_at(F.col(p.TYPES), s["name"]) != s["type"]
    extra = F.transform(F.array_except(F.map_keys(p.TYPES), declared), lambda n: error("undeclared", "call", "args", n))
    wrong = F.transform(
        F.filter(specs, lambda s: F.coalesce(mistyped(s), F.lit(False))),
        lambda s: error(F.concat(s["type"], F.lit("_expected")), "call", "args", s["name"]),
    )
    absent = F.transform(
        F.filter(specs, lambda s: s["required"] & ~given(s)), lambda s: error("missing", "call", "args", s["name"])
    )
    inside = F.when(is_object & F.col("specs").isNotNull(), F.concat(extra, wrong, absent)).otherwise(none)
    found = F.concat(
        one(F.col("specs").isNull(), error("unknown_tool", "call", "tool")),
        one(F.col("declared_category") != F.col(p.CATEGORY), error("category_mismatch", "call", "category")),
        one(kind.isNull(), error("unparsable", "call", "args")),
        one(kind.isNotNull() & ~is_object, error("object_expected", "call", "args")),
        inside,
    )
    return rows.select("call_id", F.explode(found).alias("e")).select("call_id", "e.path", "e.kind")


def known_steps(ruleset: RuleSet) -> tuple[str, ...]:
    """Names that may stand in an error's place: fields of a call and arguments that tools declare."""
    args = {name for tool in ruleset.tools.values() for name in tool.args}
    return ("call", "args", "tool", "category", *sorted(args))


# ---------------------------------------------------------------- around the decision
# fixed values: what a failed stage escalates to, in the order the stages run
STAGE_FAILURE = {
    "ingress": DENY,
    "handles": DENY,
    "provenance": DENY,
    "guards": STEP_UP,
    "policy": DENY,
    "ml": STEP_UP,
    "preview": STEP_UP,
}
# fixed values: tool namespaces and native tools
NAMESPACES = ("upi", "crm", "mail", "files")
NATIVE_TOOLS = ("extract_field", "read_handle", "voice_command")
DOMAIN_OF_TOOL = {
    "pay_upi": "payshield",
    "add_payee": "payshield",
    "read_customer_data": "purposelock",
    "export_records": "purposelock",
    "send_email": "purposelock",
    "voice_command": "voicetrust",
}
AGENT_OF_DOMAIN = {
    "payshield": "finbot",
    "purposelock": "supportbot",
    "voicetrust": "voicedesk",
    "core": "agent",
}


def _table(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def domain_of(tool: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(DOMAIN_OF_TOOL), tool), F.lit("core"))


def agent_of(domain: Column) -> Column:
    return F.try_element_at(_table(AGENT_OF_DOMAIN), domain)


def resolve_tool_name(name: Column) -> Column:
    """Struct(server, tool) of ``namespace_tool``; native tools belong to the gateway."""
    pattern = r"\A(" + "|".join(NAMESPACES) + r")_(.+)\z"
    server = F.regexp_extract(name, "(?s)" + pattern, 1)
    return (
        F.when(
            name.isin(*NATIVE_TOOLS),
            F.struct(F.lit("gateway").alias("server"), name.alias("tool")),
        )
        .when(
            server != "",
            F.struct(
                server.alias("server"),
                F.regexp_extract(name, "(?s)" + pattern, 2).alias("tool"),
            ),
        )
        .otherwise(F.struct(F.lit("unknown").alias("server"), name.alias("tool")))
    )


def failsafe(statuses: DataFrame) -> DataFrame:
    """First failed stage of each call (``call_id``, ``stage``, ``failed``) and its escalation.

    Later stages do not run, so only the first failure counts.
    """
    order = F.create_map(*[F.lit(x) for i, s in enumerate(STAGE_FAILURE) for x in (s, i)])
    escalation = F.create_map(*[F.lit(x) for pair in STAGE_FAILURE.items() for x in pair])
    first = (
        statuses.where("failed")
        .groupBy("call_id")
        .agg(F.min_by("stage", F.try_element_at(order, F.col("stage"))).alias("stage"))
    )
    return first.select(
        "call_id",
        F.concat(F.lit("CORE.FAILSAFE."), F.upper("stage")).alias("rule_id"),
        F.coalesce(F.try_element_at(escalation, F.col("stage")), F.lit(DENY)).alias("decision"),
        F.concat(F.lit("Stage '"), "stage", F.lit("' failed; failing closed")).alias("explanation"),
    )


def denial_summary(verdicts: DataFrame) -> DataFrame:
    """One compact row per refused call: decision, rules in order, top explanation, digest."""
    top = F.get("reasons", F.lit(0))
    return verdicts.where(F.col("decision") > ALLOW).select(
        "call_id",
        decision_name(F.col("decision")).alias("decision"),
        F.array_join(F.transform("reasons", lambda r: r["rule_id"]), ",").alias("rules"),
        F.coalesce(top["explanation"], F.lit("")).alias("reason"),
        F.when(F.col("decision") == STEP_UP, call_digest()).alias("call_digest"),
    )


def strip_agent_purpose(calls: DataFrame) -> DataFrame:
    """Drop arguments named "purpose" in any case; flag calls that carried one."""
    members = F.coalesce(
        F.try_variant_get(F.try_parse_json("args"), "$", "map<string,variant>"),
        F.create_map().cast("map<string,variant>"),
    )
    had = F.exists(F.map_keys(members), lambda k: F.lower(k) == "purpose")
    clean = F.to_json(F.map_filter(members, lambda k, v: F.lower(k) != "purpose"))
    return calls.withColumn("purpose_ignored", had).withColumn(
        "args", F.when(F.col("purpose_ignored"), clean).otherwise(F.col("args"))
    )


def call_text() -> Column:
    """Canonical JSON of what an approval binds to: not the call id, labels or time."""
    return F.concat(
        F.lit('{"args":'),
        canonical_json(F.try_parse_json("args")),
        F.lit(',"principal":'),
        _json_text(F.col("principal")),
        F.lit(',"server":'),
        _json_text(F.col("server")),
        F.lit(',"task_id":'),
        _json_text(F.col("task_id")),
        F.lit(',"tool":'),
        _json_text(F.col("tool")),
        F.lit("}"),
    )


def _json_text(value: Column) -> Column:
    return F.to_json(F.to_variant_object(F.array(value.cast("string")))).substr(
        F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(value.cast("string"))))) - 2
    )


def call_digest() -> Column:
    return sha256_hex(call_text())


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))
