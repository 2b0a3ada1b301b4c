"""Rule sets: tools with their argument specs, rules, and the sets shipped with the library."""

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.operators import predicates as p

ALLOW, STEP_UP, DENY = 0, 1, 2
DECISION_NAMES = ("ALLOW", "STEP_UP", "DENY")
TRUSTED_USER, TRUSTED_SYSTEM, UNTRUSTED = 0, 1, 2
LEVEL_NAMES = ("TRUSTED_USER", "TRUSTED_SYSTEM", "UNTRUSTED")


@dataclass(frozen=True)
class Arg:
    type: str
    required: bool = False
    sink: bool = False


@dataclass(frozen=True)
class Tool:
    category: str
    args: Mapping[str, Arg]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    stage: str
    then: int
    explain: str
    when: p.Predicate


@dataclass(frozen=True)
class RuleSet:
    name: str
    tools: Mapping[str, Tool]
    rules: tuple[Rule, ...]

    def probes(self) -> list[p.Probe]:
        """Label questions of the rules, and the level of every sink argument."""
        found = {probe for rule in self.rules for probe in rule.when.probes}
        for tool in self.tools.values():
            found |= {p.Probe(f"/{n}", "level") for n, a in tool.args.items() if a.sink}
        return sorted(found, key=lambda probe: probe.name)

    def is_scalar(self, path: str) -> bool:
        """True when the path is a top-level argument that every tool declares as a scalar.

        Calls that pass the schema checks then hold a single leaf there.
        """
        name = path[1:]
        types = {t.args[name].type for t in self.tools.values() if name in t.args}
        return "/" not in name and not types & {"array", "object"}

    def facts(self) -> list[str]:
        return sorted({f for rule in self.rules for f in rule.when.facts})

    def without(self, *rule_ids: str) -> "RuleSet":
        """The same set with some rules dropped (to study what they protect)."""
        kept = tuple(r for r in self.rules if r.rule_id not in rule_ids)
        return RuleSet(self.name + "-reduced", self.tools, kept)

    def tool_spec(self, tool: Column) -> Column:
        """Struct(category, specs) of a declared tool, NULL for others.

        The definitions are driver-side constants, so they travel as one literal map in the
        plan and need no join.
        """
        entries = []
        for name, spec in sorted(self.tools.items()):
            args = ", ".join(
                f"named_struct('name', {p.quoted(n)}, 'type', {p.quoted(a.type)}, "
                f"'required', {p.quoted(a.required)}, 'sink', {p.quoted(a.sink)})"
                for n, a in sorted(spec.args.items())
            )
            entries.append(
                f"{p.quoted(name)}, named_struct('category', {p.quoted(spec.category)}, "
                f"'specs', CAST(array({args}) AS array<{ARG_STRUCT}>))"
            )
        entries = entries or [
            f"'', named_struct('category', '', 'specs', CAST(array() AS array<{ARG_STRUCT}>))"
        ]
        return F.try_element_at(F.expr(f"map({', '.join(entries)})"), tool)


ARG_STRUCT = "struct<name:string,type:string,required:boolean,sink:boolean>"


class RuleConflict(ValueError):
    """The same rule or tool is defined differently in two sets."""


def merge(name: str, sets: Iterable[RuleSet]) -> RuleSet:
    """Union of rule sets: equal tool definitions merge, a rule id may appear only once."""
    tools: dict[str, Tool] = {}
    rules: dict[str, Rule] = {}
    for ruleset in sets:
        for tool, spec in ruleset.tools.items():
            if tools.setdefault(tool, spec) != spec:
                raise RuleConflict(f"tool {tool} is defined twice")
        for rule in ruleset.rules:
            if rule.rule_id in rules:
                raise RuleConflict(f"rule {rule.rule_id} is defined twice")
            rules[rule.rule_id] = rule
    return RuleSet(name, tools, tuple(rules[k] for k in sorted(rules)))


# fixed values: tools and rules shipped with the library -------------------------------------

_PAY = Tool(
    "PAYMENT",
    {
        "payee_vpa": Arg("string", required=True, sink=True),
        "amount_paise": Arg("integer", required=True, sink=True),
        "note": Arg("string"),
    },
)
_PAYMENT = p.tool_category_in("PAYMENT")
_APPROVED = p.fact("approval_valid")


def _fails(name: str) -> p.Predicate:
    return _PAYMENT & ~p.fact(name)


def _over_cap(name: str) -> p.Predicate:
    return _PAYMENT & ~p.fact(name) & ~_APPROVED


def core_rules() -> RuleSet:
    tools = {
        "extract_field": Tool("READ", {"handle": Arg("string", True), "field": Arg("string", True)}),
        "read_handle": Tool("READ", {"handle": Arg("string", True), "schema": Arg("string", True)}),
        "read_document": Tool("READ", {"doc_id": Arg("string", True)}),
        "get_balance": Tool("READ", {"account_id": Arg("string")}),
        "close_account": Tool("IDENTITY", {"account_id": Arg("string", True)}),
        "issue_refund": Tool(
            "PAYMENT", {"order_id": Arg("string", True), "amount_paise": Arg("integer", True)}
        ),
    }
    rules = (
        Rule(
            "CORE.APPROVAL.CLOSE_ACCOUNT",
            "APPROVAL",
            STEP_UP,
            "Closing an account requires a bound human approval",
            p.tool_is("close_account") & ~_APPROVED,
        ),
        Rule(
            "CORE.CAP.LARGE_REFUND",
            "CAP",
            STEP_UP,
            "Refund above 5,000.00 INR requires a bound human approval",
            p.tool_is("issue_refund") & p.amount_exceeds("/amount_paise", 500_000) & ~_APPROVED,
        ),
        Rule(
            "CORE.TAINT.UNTRUSTED_ACCOUNT",
            "LABEL",
            STEP_UP,
            "Account identifier derived from untrusted content",
            p.label_at_least("/account_id", UNTRUSTED),
        ),
    )
    return RuleSet("core", tools, rules)


def payment_rules() -> RuleSet:
    tools = {
        "pay_upi": _PAY,
        "list_payees": Tool("READ", {}),
        "add_payee": Tool(
            "WRITE", {"vpa": Arg("string", True, sink=True), "name": Arg("string", True)}
        ),
    }
    mandate = [
        ("SIGNATURE", "mandate_sig_valid", "Mandate signature missing or invalid"),
        ("TIME", "mandate_time_valid", "Mandate is expired or not yet valid"),
        (
            "REPLAY",
            "mandate_nonce_fresh",
            "Mandate nonce was already used by a different mandate (replay)",
        ),
        ("PAYEE", "payee_in_mandate", "Payee is not covered by the mandate"),
        ("CATEGORY", "category_matches", "Task category is not covered by the mandate"),
    ]
    caps = [
        ("PAYEE", "amount_within_payee_cap", "payee"),
        ("PER_TXN", "amount_within_per_txn_cap", "per-transaction"),
        ("DAILY", "amount_within_daily_cap", "daily"),
    ]
    rules = [
        Rule(f"PAYSHIELD.MANDATE.{key}", "MANDATE", DENY, text, _fails(name))
        for key, name, text in mandate
    ]
    rules += [
        Rule(
            f"PAYSHIELD.CAP.{key}",
            "CAP",
            STEP_UP,
            f"Amount exceeds the {text} cap; human approval required",
            _over_cap(name),
        )
        for key, name, text in caps
    ]
    rules += [
        Rule(
            "PAYSHIELD.TAINT.UNTRUSTED_PAYEE",
            "LABEL",
            DENY,
            "Payee derived from untrusted content",
            _PAYMENT & p.label_at_least("/payee_vpa", UNTRUSTED),
        ),
        Rule(
            "PAYSHIELD.TAINT.UNTRUSTED_AMOUNT",
            "LABEL",
            DENY,
            "Payment amount derived from untrusted content",
            _PAYMENT & p.label_at_least("/amount_paise", UNTRUSTED),
        ),
        Rule(
            "PAYSHIELD.APPROVAL.BINDING_MISMATCH",
            "APPROVAL",
            DENY,
            "An approval exists but is bound to different arguments",
            ~p.tool_category_in("VOICE") & p.fact("approval_binding_mismatch"),
        ),
        Rule(
            "PAYSHIELD.TAINT.UNTRUSTED_NEW_PAYEE",
            "LABEL",
            DENY,
            "New payee VPA derived from untrusted content",
            p.tool_is("add_payee") & p.label_at_least("/vpa", UNTRUSTED),
        ),
    ]
    return RuleSet("payments", tools, tuple(rules))


def voice_rules() -> RuleSet:
    tools = {
        "voice_command": Tool(
            "VOICE",
            {
                "transcript": Arg("string", True),
                "clip_id": Arg("string", True),
                "nonce_id": Arg("string", True),
                "clip_sha256": Arg("string"),
            },
        )
    }
    voice = p.tool_is("voice_command")

    def f(name: str) -> p.Predicate:
        return p.fact(f"voice_{name}")

    def rule(key: str, stage: str, then: int, text: str, when: p.Predicate) -> Rule:
        return Rule(f"VOICETRUST.{key}", stage, then, text, voice & when)

    rules = (
        rule(
            "LIVENESS.MISMATCH",
            "LABEL",
            DENY,
            "Spoken text does not match the challenge nonce",
            f("liveness_mismatch"),
        ),
        rule("LIVENESS.EXPIRED", "LABEL", DENY, "Challenge nonce expired", f("liveness_expired")),
        rule(
            "SPOOF.HIGH", "ML", DENY, "Anti-spoof score indicates synthetic speech", f("spoof_high")
        ),
        rule(
            "LIVENESS.UNKNOWN",
            "LABEL",
            STEP_UP,
            "Liveness could not be established",
            ~f("liveness_match") & ~f("liveness_mismatch") & ~f("liveness_expired") & ~_APPROVED,
        ),
        rule(
            "QUALITY.INSUFFICIENT",
            "LABEL",
            STEP_UP,
            "Audio quality low or unknown",
            ~f("quality_ok") & ~_APPROVED,
        ),
        rule(
            "ASR.NOT_RUN",
            "LABEL",
            STEP_UP,
            "No ASR backend ran on this clip",
            ~f("asr_ran") & ~_APPROVED,
        ),
        rule(
            "SPOOF.SUSPECT",
            "ML",
            STEP_UP,
            "Anti-spoof score is suspicious",
            f("spoof_suspect") & ~_APPROVED,
        ),
        rule(
            "SINK.HIGH_RISK",
            "LABEL",
            STEP_UP,
            "Voice command targets a high-risk sink",
            f("sink_high") & ~_APPROVED,
        ),
        rule(
            "SPOOF.NOT_RUN",
            "ML",
            STEP_UP,
            "Anti-spoof check did not run; out-of-band approval required",
            ~f("spoof_ran") & ~_APPROVED,
        ),
    )
    return RuleSet("voice", tools, rules)


def purpose_rules() -> RuleSet:
    """Purpose rules for tools that touch personal data."""
    tools = {
        "read_customer_data": Tool(
            "READ", {"customer_id": Arg("string", True), "fields": Arg("array")}
        ),
        "export_records": Tool(
            "EXPORT", {"customer_ids": Arg("array", True), "destination": Arg("string", True)}
        ),
        "send_email": Tool(
            "COMMUNICATION",
            {
                "to": Arg("string", True, sink=True),
                "subject": Arg("string", True),
                "body": Arg("string", True, sink=True),
            },
        ),
        "read_inbox": Tool("READ", {}),
    }
    email = p.tool_is("send_email")
    covered = p.fact("consent_active") & p.fact("sink_allowed_for_purpose")
    personal = p.any_of(*[p.label_has_tag(f"/{a}", "PII") for a in ("to", "subject", "body")])
    untrusted_mail = p.any_of(
        *[p.label_at_least(f"/{a}", UNTRUSTED) for a in ("subject", "body")]
    )
    rules = (
        Rule(
            "PURPOSELOCK.EGRESS.PII_WITHOUT_CONSENT",
            "PURPOSE",
            DENY,
            "Personal data leaves without consent for this purpose",
            email & personal & ~covered,
        ),
        Rule(
            "PURPOSELOCK.CONSENT.READ_WITHOUT_CONSENT",
            "PURPOSE",
            DENY,
            "Personal data read without consent for this purpose",
            p.tool_is("read_customer_data") & ~covered,
        ),
        Rule(
            "PURPOSELOCK.EGRESS.EXPORT_WITHOUT_CONSENT",
            "PURPOSE",
            DENY,
            "Records exported without consent for this purpose",
            p.tool_is("export_records") & ~covered,
        ),
        Rule(
            "PURPOSELOCK.TAINT.UNTRUSTED_RECIPIENT",
            "LABEL",
            DENY,
            "Recipient derived from untrusted content",
            email & p.label_at_least("/to", UNTRUSTED),
        ),
        Rule(
            "PURPOSELOCK.TAINT.UNTRUSTED_EMAIL_CONTENT",
            "LABEL",
            STEP_UP,
            "Message content derived from untrusted content",
            email & untrusted_mail & ~_APPROVED,
        ),
    )
    return RuleSet("purpose", tools, rules)


def shipped_rules() -> RuleSet:
    return merge("shipped", [core_rules(), payment_rules(), voice_rules()])


def all_rules() -> RuleSet:
    return merge("all", [core_rules(), payment_rules(), voice_rules(), purpose_rules()])
