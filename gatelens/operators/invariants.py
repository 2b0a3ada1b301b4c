"""Invariants over decision tables: rows that should not exist, and sweeps that look for them."""

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions.hashing import sha256_hex
from gatelens.operators import predicates as p
from gatelens.operators.evaluate import (
    STAGE_FAILURE,
    combine,
    label_probes,
    rule_reasons,
    with_facts,
    with_tools,
)
from gatelens.operators.ruleset import ALLOW, DENY, UNTRUSTED, RuleSet
from gatelens.session import durable

MANDATE_FACTS = (
    "mandate_sig_valid",
    "mandate_time_valid",
    "mandate_nonce_fresh",
    "payee_in_mandate",
    "category_matches",
)
CAP_FACTS = ("amount_within_payee_cap", "amount_within_per_txn_cap", "amount_within_daily_cap")


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def untrusted_sink(decided: DataFrame, labels: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Calls ALLOWed without a valid approval although a sink argument is untrusted.

    ``decided``: call_id, tool, args, decision, approval_valid.
    """
    probes = [p.Probe(f"/{n}", "level") for t in ruleset.tools.values() for n, a in t.args.items() if a.sink]
    probes = sorted(set(probes), key=lambda x: x.name)
    rows = with_tools(decided, ruleset).join(label_probes(labels, probes), "call_id", "left")
    levels = F.create_map(
        *[x for pr in probes for x in (F.lit(pr.path[1:]), F.coalesce(F.col(f"`{pr.name}`"), F.lit(UNTRUSTED)))]
    )
    hit = F.exists(
        "specs",
        lambda s: s["sink"]
        & F.map_contains_key(F.col(p.TYPES), s["name"])
        & (F.try_element_at(F.col("_levels"), s["name"]) == UNTRUSTED),
    )
    return (
        rows.withColumn("_levels", levels)
        .where((F.col("decision") == ALLOW) & ~_true("approval_valid"))
        .where(F.coalesce(hit, F.lit(False)))
        .select("call_id", "tool")
    )


def lowered(decided: DataFrame) -> DataFrame:
    """Final decision below the decision of the rules."""
    return decided.where(F.col("decision") < F.col("rule_decision")).select("call_id")


def allowed_after_failure(decided: DataFrame, statuses: DataFrame) -> DataFrame:
    """ALLOW although a stage failed."""
    failed = statuses.where("failed").select("call_id").distinct()
    return decided.where(F.col("decision") == ALLOW).join(failed, "call_id", "left_semi").select(
        "call_id"
    )


def unmandated_payment(decided: DataFrame) -> DataFrame:
    """Payments ALLOWed without all mandate facts and either all caps or a valid approval.

    ``decided``: call_id, category, decision and the fact columns.
    """
    mandate = F.lit(True)
    for name in MANDATE_FACTS:
        mandate = mandate & _true(name)
    caps = F.lit(True)
    for name in CAP_FACTS:
        caps = caps & _true(name)
    valid = mandate & (caps | _true("approval_valid"))
    return decided.where((F.col("category") == "PAYMENT") & (F.col("decision") == ALLOW) & ~valid).select(
        "call_id"
    )


def unconsented_personal_data(decided: DataFrame, labels: DataFrame) -> DataFrame:
    """Mail or export ALLOWed with personal data and without active consent."""
    personal = labels.where(F.startswith("tag", F.lit("PII"))).select("call_id").distinct()
    sinks = F.col("tool").isin("send_email", "export_records")
    return (
        decided.where(sinks & (F.col("decision") == ALLOW) & ~_true("consent_active"))
        .join(personal, "call_id", "left_semi")
        .select("call_id")
    )


def misused_tokens(uses: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens used for another call than they were issued for, or more than once.

    ``uses``: token_id, digest. ``tokens``: token_id, digest.
    """
    bound = tokens.select("token_id", F.col("digest").alias("_bound"))
    per = uses.join(bound, "token_id").groupBy("token_id").agg(
        F.count("*").alias("uses"),
        F.bool_or(F.col("digest") != F.col("_bound")).alias("wrong_call"),
    )
    return per.where((F.col("uses") > 1) | F.col("wrong_call"))


def audit_gaps(executions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Executed calls with no decision leaf before the execution leaf.

    ``executions``: call_id, idx. ``decisions``: call_id, idx.
    """
    first = decisions.groupBy("call_id").agg(F.min("idx").alias("_d"))
    return (
        executions.join(first, "call_id", "left")
        .where(F.col("_d").isNull() | (F.col("_d") >= F.col("idx")))
        .select("call_id", "idx")
    )


def vary(rows: DataFrame, choices: Mapping[str, Sequence], types: Mapping[str, str]) -> DataFrame:
    """Every combination of the given values in place of the columns, for each row."""
    for name, values in choices.items():
        options = F.array(*[F.lit(v).cast(types[name]) for v in values])
        rows = rows.withColumn(name, F.explode(options))
    return rows


def policy_sweep(
    calls: DataFrame,
    ruleset: RuleSet,
    tool: str,
    *,
    facts: Sequence[str],
    levels: Sequence[str] | None = None,
    signals: Sequence[int] = (0, 1, 2),
) -> DataFrame:
    """Decide each row of ``calls`` under every combination of label levels, facts and signal.

    ``facts`` are swept over true, false and unknown, ``levels`` (argument paths, the sinks by
    default) over the three levels; facts not swept keep the row's own value or are unknown.
    Result: the swept columns, ``rule_decision``, ``decision`` and the names of the broken
    ``invariants``.
    """
    spec = ruleset.tools[tool]
    paths = [f"/{n}" for n, a in spec.args.items() if a.sink] if levels is None else list(levels)
    rows = calls.withColumn("tool", F.lit(tool))
    args = ", ".join(f"{p.quoted(n)}, {p.quoted(a.type)}" for n, a in spec.args.items() if a.required)
    rows = rows.withColumns(
        {
            p.CATEGORY: F.lit(spec.category),
            p.ARGS: F.expr("CAST(NULL AS variant)"),
            p.TYPES: F.expr(f"map({args})" if args else "CAST(map() AS map<string,string>)"),
        }
    )
    probes = ruleset.probes()
    swept = {pr.name: (0, 1, 2) for pr in probes if pr.path in paths and pr.what == "level"}
    fixed = {
        pr.name: F.lit(None).cast("int")
        for pr in probes
        if pr.name not in swept and pr.name not in rows.columns
    }
    rows = rows.withColumns(fixed) if fixed else rows
    fact_columns = {f"fact_{f}": (True, False, None) for f in facts}
    rows = vary(
        rows,
        {**swept, **fact_columns, "_signal": signals},
        {**dict.fromkeys(swept, "int"), **dict.fromkeys(fact_columns, "boolean"), "_signal": "int"},
    )
    for name in ruleset.facts():
        if f"fact_{name}" not in rows.columns:
            rows = rows.withColumn(f"fact_{name}", F.lit(None).cast("boolean"))
    for name in (*MANDATE_FACTS, *CAP_FACTS, "approval_valid"):
        if f"fact_{name}" not in rows.columns:
            rows = rows.withColumn(f"fact_{name}", F.lit(None).cast("boolean"))
    if "purpose" not in rows.columns:
        rows = rows.withColumn("purpose", F.lit(None).cast("string"))
    decided = rows.withColumn("rule_decision", combine(rule_reasons(ruleset))).withColumn(
        "decision", F.greatest("rule_decision", "_signal")
    )
    allow = F.col("decision") == ALLOW
    approved = _true("fact_approval_valid")
    tainted = F.lit(False)
    for name in swept:
        tainted = tainted | (F.col(f"`{name}`") == UNTRUSTED)
    mandate = F.lit(True)
    for name in MANDATE_FACTS:
        mandate = mandate & _true(f"fact_{name}")
    caps = F.lit(True)
    for name in CAP_FACTS:
        caps = caps & _true(f"fact_{name}")
    broken = [
        F.when(allow & tainted & ~approved, F.lit("untrusted_sink")),
        F.when(F.col("decision") < F.col("rule_decision"), F.lit("lowered")),
    ]
    if spec.category == "PAYMENT":
        broken.append(
            F.when(allow & ~(mandate & (caps | approved)), F.lit("unmandated_payment"))
        )
    return decided.withColumn("invariants", F.array_compact(F.array(*broken))).drop(
        p.ARGS, p.TYPES
    )


@dataclass(frozen=True)
class _Unknown:
    """Something a rule reads that a sweep gives every value; for ``tools`` only, others do not read it."""

    column: str
    kind: str
    values: tuple
    tools: frozenset[str]

    def spread(self, rows: DataFrame) -> DataFrame:
        """A row for each value where it can still matter; a row that is denied already counts for all."""
        reads = F.col("tool").isin(*sorted(self.tools))
        open_ = reads & (F.col("_decision") < DENY)
        every = F.array(*[F.lit(v).cast(self.kind) for v in self.values])
        none = F.array(F.lit(None).cast(self.kind))
        many = F.when(reads & ~open_, len(self.values)).otherwise(1)
        return rows.withColumn("_weight", F.col("_weight") * many).withColumn(
            self.column, F.explode(F.when(open_, every).otherwise(none))
        )


def _types_of(ruleset: RuleSet, optional: Mapping[str, str], tools: Collection[str]) -> Column:
    """Types of the arguments that a call of one of the tools has; ``optional`` names the columns that say
    whether an argument is there that need not be."""
    parts = []
    for name in sorted(tools):
        spec = ruleset.tools[name]
        entries = [
            F.when(F.col(optional[n]) if n in optional else F.lit(True), F.struct(F.lit(n), F.lit(a.type)))
            for n, a in spec.args.items()
            if a.required or n in optional
        ]
        if entries:
            parts.append((name, F.map_from_entries(F.array_compact(F.array(*entries)))))
    out = F.expr("CAST(map() AS map<string,string>)")
    for name, types in parts:
        out = F.when(F.col("tool") == name, types).otherwise(out)
    return out


def _able_rules(ruleset: RuleSet, spark: SparkSession) -> dict[str, set[str]]:
    """Tools by rule id: those for whose calls the rule is not false whatever the facts and labels are.

    With unknown facts a three-valued rule that is false stays so for all facts; labels are tried at
    both ends.
    """
    extremes = spark.createDataFrame([(t, s.category) for t, s in ruleset.tools.items()], f"tool string, {p.CATEGORY} string")
    optional = {n: "_there" for t in ruleset.tools.values() for n, a in t.args.items() if not a.required}
    extremes = (
        extremes.withColumn("_high", F.explode(F.array(F.lit(True), F.lit(False))))
        .withColumns({"_there": F.lit(True), p.ARGS: F.expr("CAST(NULL AS variant)"), "purpose": F.lit(None).cast("string")})
        .withColumn(p.TYPES, _types_of(ruleset, optional, ruleset.tools))
    )
    labels = {
        probe.name: F.when(F.col("_high"), 2 if probe.what == "level" else 1).otherwise(F.lit(0 if probe.what == "level" else None))
        for probe in ruleset.probes()
    }
    extremes = extremes.withColumns(labels | {f"fact_{f}": F.lit(None).cast("boolean") for f in ruleset.facts()})
    seen = extremes.select("tool", *[F.coalesce(r.when.build(), F.lit(True)).alias(f"r{i}") for i, r in enumerate(ruleset.rules)])
    able: dict[str, set[str]] = {r.rule_id: set() for r in ruleset.rules}
    for row in seen.collect():
        for i, rule in enumerate(ruleset.rules):
            if row[f"r{i}"]:
                able[rule.rule_id].add(row.tool)
    return able


def policy_counts(calls: DataFrame, ruleset: RuleSet, *, signals: Sequence[int] = (0, 1, 2), merge_every: int = 6) -> DataFrame:
    """Combinations of everything unknown, by tool and base row, and how many break each invariant.

    ``calls``: tool, args. Swept are all facts that a rule or an invariant of the tool reads (true,
    false, unknown), the levels of all labels its rules or sinks have, tags and kinds that rules ask
    for, presence of optional labelled arguments, the signal and the failure of a stage. Only what
    rules read in the arguments themselves stays as it is: a base row is a tool, with its ``args``
    where some rule reads them. Calls of unknown tools and arguments that are no object do not reach
    the rules and are left out.

    Rules are applied one after the other. What is unknown is spread only when a rule asks for it, a
    row that is denied is not spread any more, and what no later rule or invariant reads is summed out;
    so the work follows the number of cases that differ, not of combinations.
    """
    spark = calls.sparkSession
    able = _able_rules(ruleset, spark)
    reads_args = {t for r in ruleset.rules if p.ARGS in r.when.sql.replace(p.TYPES, "") for t in able[r.rule_id]}
    sinks = {t: [p.Probe(f"/{n}", "level") for n, a in s.args.items() if a.sink] for t, s in ruleset.tools.items()}
    paying = {t for t, s in ruleset.tools.items() if s.category == "PAYMENT"}
    purposed = {t for r in ruleset.rules if r.stage == "PURPOSE" for t in able[r.rule_id]}
    personal = {probe for r in ruleset.rules if r.stage == "PURPOSE" for probe in r.when.probes if "PII" in probe.values}

    facts: dict[str, set[str]] = {}
    probes: dict[p.Probe, set[str]] = {}

    def declared(probe: p.Probe, tools: set[str]) -> set[str]:
        return {t for t in tools if probe.path.split("/")[1] in ruleset.tools[t].args}

    for rule in ruleset.rules:
        for name in rule.when.facts:
            facts.setdefault(name, set()).update(able[rule.rule_id])
        for probe in rule.when.probes:
            probes.setdefault(probe, set()).update(declared(probe, able[rule.rule_id]))
    sinking = {t for t, found in sinks.items() if found}
    for tool, found in sinks.items():
        for probe in found:
            probes.setdefault(probe, set()).add(tool)
    for name in (*MANDATE_FACTS, *CAP_FACTS):
        facts.setdefault(name, set()).update(paying)
    facts.setdefault("approval_valid", set()).update(paying | sinking)
    facts.setdefault("consent_active", set()).update(purposed)

    unknown: dict[str, _Unknown] = {}
    for name, tools in facts.items():
        unknown[f"fact_{name}"] = _Unknown(f"fact_{name}", "boolean", (True, False, None), frozenset(tools))
    optional: dict[str, str] = {}
    for probe, tools in probes.items():
        values = (0, 1, 2) if probe.what == "level" else (1, None)
        unknown[probe.name] = _Unknown(probe.name, "int", values, frozenset(tools))
        arg = probe.path.split("/")[1]
        loose = {t for t in tools if not ruleset.tools[t].args[arg].required}
        if loose:
            optional[arg] = f"_has {arg}"
            known = unknown[f"_has {arg}"].tools if f"_has {arg}" in unknown else frozenset()
            unknown[f"_has {arg}"] = _Unknown(f"_has {arg}", "boolean", (True, False), known | loose)
    unknown = {c: u for c, u in unknown.items() if u.tools}

    def read_by(rule) -> set[str]:
        names = {f"fact_{f}" for f in rule.when.facts} | {x.name for x in rule.when.probes}
        args = {x.path.split("/")[1] for x in rule.when.probes}
        return {c for c in names | {optional[a] for a in args if a in optional} if c in unknown}

    invariant = {x.name for found in sinks.values() for x in found} | {x.name for x in personal}
    invariant |= {optional[x.path[1:]] for found in sinks.values() for x in found if x.path[1:] in optional}
    invariant |= {f"fact_{f}" for f in (*MANDATE_FACTS, *CAP_FACTS, "approval_valid", "consent_active")}

    category = F.create_map(*[F.lit(x) for t, s in ruleset.tools.items() for x in (t, s.category)])
    base = F.when(F.col("tool").isin(*sorted(reads_args)), F.col("args")) if reads_args else F.lit(None).cast("string")
    is_object = F.expr(p.json_type_sql("try_parse_json(args)")) == "object"
    rows = (
        calls.where(F.col("tool").isin(*sorted(ruleset.tools)) & is_object)
        .groupBy("tool", base.alias("base"))
        .agg(F.count("*").alias("calls"))
        .withColumns({"_weight": F.lit(1).cast("long"), "_decision": F.lit(ALLOW)})
    )
    kept = ["tool", "base", "calls", "_decision"]
    open_: list[str] = []
    rules = [r for r in ruleset.rules if able[r.rule_id]]
    rules.sort(key=lambda r: (-r.then, len(read_by(r)), r.rule_id))
    for at, rule in enumerate(rules):
        for column in sorted(read_by(rule) - set(open_)):
            rows = unknown[column].spread(rows)
            open_.append(column)
        shown = {a: c for a, c in optional.items() if c in open_}
        never = [x.name for x in rule.when.probes if x.name not in unknown]
        given = {
            p.TYPES: _types_of(ruleset, shown, able[rule.rule_id]),
            p.ARGS: F.try_parse_json("base"),
            p.CATEGORY: F.try_element_at(category, F.col("tool")),
            "purpose": F.lit(None).cast("string"),
        } | {name: F.lit(None).cast("int") for name in never}
        fires = F.col("tool").isin(*sorted(able[rule.rule_id])) & F.coalesce(rule.when.build(), F.lit(True))
        rows = rows.withColumns(given).withColumn(
            "_decision", F.when(fires, F.greatest("_decision", F.lit(rule.then))).otherwise(F.col("_decision"))
        ).drop(*given)
        if at % merge_every == merge_every - 1 or at == len(rules) - 1:
            later = set().union(invariant, *[read_by(r) for r in rules[at + 1 :]])
            # a denied row is all that its unknowns can still say
            live = [c for c in open_ if c in later]
            denied = F.col("_decision") >= DENY
            rows = rows.select(
                *kept, "_weight", *[F.when(~denied, F.col(f"`{c}`")).alias(c) for c in live]
            ).groupBy(*kept, *[F.col(f"`{c}`") for c in live]).agg(F.sum("_weight").alias("_weight"))
            rows = durable(rows)  # few rows, and a short plan for the next rules
            gone = set(open_) - set(live)
            unknown = {c: u for c, u in unknown.items() if c not in gone}
            open_ = live
    for column in sorted((invariant & set(unknown)) - set(open_)):
        rows = unknown[column].spread(rows)
    none = F.lit(None)
    rows = rows.withColumns({c: none.cast("boolean" if c.startswith("fact_") or c.startswith("_has") else "int") for c in invariant if c not in rows.columns})

    failures = [ALLOW, *STAGE_FAILURE.values()]
    ends = [(s, i > 0, f) for s in signals for i, f in enumerate(failures)]
    end = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(x).alias("failed"), F.lit(f).alias("least")) for s, x, f in ends]))
    final = F.greatest("_decision", "_end.signal", "_end.least")
    allow = F.col("_final") == ALLOW
    approved = _true("fact_approval_valid")
    tainted = F.lit(False)
    for tool, found in sorted(sinks.items()):
        for probe in found:
            there = F.col(f"`{optional[probe.path[1:]]}`") if not ruleset.tools[tool].args[probe.path[1:]].required else F.lit(True)
            tainted = tainted | ((F.col("tool") == tool) & there & F.coalesce(F.col(f"`{probe.name}`") == UNTRUSTED, F.lit(False)))
    mandate, caps = F.lit(True), F.lit(True)
    for name in MANDATE_FACTS:
        mandate = mandate & _true(f"fact_{name}")
    for name in CAP_FACTS:
        caps = caps & _true(f"fact_{name}")
    leaks = F.lit(False)
    for tool in sorted(purposed):
        asked = [x for x in personal if declared(x, {tool})]
        flows = F.lit(not asked)
        for probe in asked:
            flows = flows | F.coalesce(F.col(f"`{probe.name}`") == 1, F.lit(False))
        leaks = leaks | ((F.col("tool") == tool) & flows)
    broken = {
        "untrusted_sink": allow & tainted & ~approved,
        "lowered": F.col("_final") < F.col("_decision"),
        "allowed_after_failure": allow & F.col("_end.failed"),
        "unmandated_payment": allow & F.col("tool").isin(*sorted(paying)) & ~(mandate & (caps | approved)),
        "unconsented_personal_data": allow & leaks & ~_true("fact_consent_active"),
    }

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("_weight")).otherwise(0))

    return (
        rows.withColumn("_end", end)
        .withColumn("_final", final)
        .groupBy("tool", "base", "calls")
        .agg(
            F.sum("_weight").alias("combinations"),
            total(allow).alias("allowed"),
            *[total(when).alias(name) for name, when in broken.items()],
        )
    )


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Rule or tool names defined differently in several files: ``name``, ``definitions``.

    ``rules``: file, name, definition (text). Equal definitions merge.
    """
    digests = rules.select("name", sha256_hex("definition").alias("_d")).distinct()
    return (
        digests.groupBy("name")
        .agg(F.count("*").alias("definitions"))
        .where(F.col("definitions") > 1)
    )


__all__ = [
    "allowed_after_failure",
    "audit_gaps",
    "lowered",
    "misused_tokens",
    "policy_counts",
    "policy_sweep",
    "rule_conflicts",
    "unconsented_personal_data",
    "unmandated_payment",
    "untrusted_sink",
    "vary",
    "with_facts",
]
