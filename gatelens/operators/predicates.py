"""Three-valued rule predicates: each is a nullable boolean SQL expression over one call row.

NULL means UNKNOWN. Spark's AND, OR and NOT already follow Kleene logic, so composition is
plain expression text, and a whole rule set becomes one projection. A predicate also states
which labels and facts it reads, so the evaluation knows what to bring to the call row.
"""

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.functions.scalars import variant_path

ARGS = "_args"  # variant column with the call's arguments
TYPES = "_types"  # map of argument name -> JSON type, for the top level
CATEGORY = "category"  # category of the tool as the rule set declares it
UNTRUSTED_LEVEL = 2


def quoted(value: str | int | bool | None) -> str:
    """A constant as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Probe:
    """One question about the label of an argument path, answered before the rules run.

    ``what`` is level, tag or kind; ``values`` are the tags or kinds asked for. The answer is a
    column named ``name``: the greatest level, or 1 when a tag or kind is present.
    """

    path: str
    what: str
    values: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return "_lab " + " ".join([self.path, self.what, *self.values])

    def answer(self) -> Column:
        """Value of one label row (columns level, source_kind, tag) for this question."""
        if self.what == "level":
            return F.col("level")
        if self.what == "kind":
            return F.when(F.col("source_kind").isin(*self.values), 1)
        hit = F.col("tag").isin(*self.values)
        if "PII" in self.values:  # every specific personal-data tag implies the general one
            hit = hit | F.startswith(F.col("tag"), F.lit("PII"))
        return F.when(hit, 1)


@dataclass(frozen=True)
class Predicate:
    """Expression text with the label probes and fact names it needs."""

    sql: str
    probes: frozenset[Probe] = field(default=frozenset())
    facts: frozenset[str] = field(default=frozenset())

    def build(self) -> Column:
        return F.expr(self.sql)

    def __and__(self, other: "Predicate") -> "Predicate":
        return all_of(self, other)

    def __or__(self, other: "Predicate") -> "Predicate":
        return any_of(self, other)

    def __invert__(self) -> "Predicate":
        return not_(self)


def _merge(items: Iterable[Predicate], sql: str) -> Predicate:
    items = list(items)
    return Predicate(
        sql,
        frozenset().union(*[p.probes for p in items]),
        frozenset().union(*[p.facts for p in items]),
    )


def const(value: bool) -> Predicate:
    return Predicate(quoted(value))


def all_of(*items: Predicate) -> Predicate:
    return _merge(items, "(" + " AND ".join(p.sql for p in items) + ")" if items else "true")


def any_of(*items: Predicate) -> Predicate:
    return _merge(items, "(" + " OR ".join(p.sql for p in items) + ")" if items else "false")


def not_(item: Predicate) -> Predicate:
    return _merge([item], f"(NOT {item.sql})")


def tool_is(tool: str) -> Predicate:
    return Predicate(f"(tool = {quoted(tool)})")


def tool_category_in(*categories: str) -> Predicate:
    return Predicate(f"({CATEGORY} IN ({', '.join(quoted(c) for c in categories)}))")


# fixed values: how the type names of variants read as JSON types
_JSON_TYPES = {
    "STRING": "string",
    "BIGINT": "integer",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "ARRAY": "array",
    "OBJECT": "object",
    "DOUBLE": "number",
    "FLOAT": "number",
    "DECIMAL": "number",
}


def json_type_sql(value: str) -> str:
    """string, integer, number, boolean, null, array or object; NULL when absent.

    Integers beyond 64 bits are held as decimals without a fraction and count as integers.
    """
    schema = rf"regexp_replace(schema_of_variant({value}), '^DECIMAL\\(\\d+, ?0\\)$', 'BIGINT')"
    table = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in _JSON_TYPES.items())
    return f"try_element_at(map({table}), regexp_extract({schema}, '^[A-Z]+', 0))"


def _value_sql(path: str, kind: str = "variant") -> str:
    return f"try_variant_get({ARGS}, {quoted(variant_path(path))}, '{kind}')"


def _present_sql(path: str) -> str:
    if path.count("/") == 1:
        name = path[1:].replace("~1", "/").replace("~0", "~")
        return f"map_contains_key({TYPES}, {quoted(name)})"
    return f"({_value_sql(path)} IS NOT NULL)"


def _type_sql(path: str) -> str:
    if path.count("/") == 1:
        name = path[1:].replace("~1", "/").replace("~0", "~")
        return f"try_element_at({TYPES}, {quoted(name)})"
    return json_type_sql(_value_sql(path))


def arg_exists(path: str) -> Predicate:
    """An explicit null counts as existing."""
    return Predicate(_present_sql(path))


_BIG = "decimal(38,0)"


def arg_compare(path: str, op: str, expected: bool | int | str | None) -> Predicate:
    """Absent: UNKNOWN. eq/ne compare type and value. Order needs two ints or two strings."""
    kind = _type_sql(path)
    signs = {"lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    if isinstance(expected, bool):
        wanted, value = "boolean", _value_sql(path, "boolean")
    elif isinstance(expected, int):
        wanted, value = "integer", _value_sql(path, _BIG)
    elif expected is None:
        wanted, value = "null", None
    else:
        wanted, value = "string", _value_sql(path, "string")
    right_type = f"coalesce({kind} = '{wanted}', false)"
    if op in ("eq", "ne"):
        same = right_type
        if value is not None:
            same = f"({right_type} AND coalesce({value} = {quoted(expected)}, false))"
        result = same if op == "eq" else f"(NOT {same})"
    elif wanted in ("integer", "string"):
        result = f"CASE WHEN {right_type} THEN {value} {signs[op]} {quoted(expected)} END"
    else:
        result = "CAST(NULL AS boolean)"
    return Predicate(f"(CASE WHEN {_present_sql(path)} THEN {result} END)")


def label_at_least(path: str, level: int) -> Predicate:
    """Absent argument: FALSE, never UNKNOWN. A present one without a label is untrusted."""
    probe = Probe(path, "level")
    known = f"coalesce(`{probe.name}`, {UNTRUSTED_LEVEL})"
    return Predicate(
        f"coalesce({_present_sql(path)} AND {known} >= {level}, false)", frozenset({probe})
    )


def _has(probe: Probe) -> Predicate:
    return Predicate(
        f"coalesce({_present_sql(probe.path)} AND `{probe.name}` = 1, false)", frozenset({probe})
    )


def label_has_tag(path: str, tag: str) -> Predicate:
    return _has(Probe(path, "tag", (tag,)))


def source_kind_in(path: str, *kinds: str) -> Predicate:
    return _has(Probe(path, "kind", tuple(sorted(kinds))))


def purpose_is(purpose: str) -> Predicate:
    return Predicate(f"(purpose = {quoted(purpose)})")


def amount_exceeds(path: str, cap: int) -> Predicate:
    """UNKNOWN unless the argument is an integer."""
    return Predicate(
        f"(CASE WHEN {_type_sql(path)} = 'integer' THEN {_value_sql(path, _BIG)} > {cap} END)"
    )


def fact(name: str) -> Predicate:
    """A nullable boolean computed elsewhere; missing or NULL is UNKNOWN.

    Consent, mandate and approval predicates are facts too: their joins run once, as
    DataFrames (see ``consents``, ``payments`` and ``approvals``), and arrive here as one
    column each.
    """
    return Predicate(f"`fact_{name}`", frozenset(), frozenset({name}))
