"""Where a value came from: task tokens, observed values, handles, lineage, task binding."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.leaves import is_filled, with_leaves
from gatelens.functions.scalars import normalise, strip
from gatelens.functions.text import amount_tokens, close_tags, pii_tags
from gatelens.operators.predicates import json_type_sql
from gatelens.operators.ruleset import TRUSTED_SYSTEM, TRUSTED_USER, UNTRUSTED
from gatelens.plans.skew import lookup
from gatelens.plans.timeline import as_of
from gatelens.session import stored

HANDLE = r"\A\$(?:DOC|EMAIL|VOICE|VAR)_[1-9][0-9]*\z"
MIN_SUBSTRING = 6
PASS_THROUGH = (("extract_field", "handle"), ("read_handle", "handle"))


def text_key(value: Column) -> Column:
    return F.concat(F.lit("s:"), normalise(value))


def number_key(value: Column) -> Column:
    return F.concat(F.lit("i:"), value.cast("string"))


def register_task_tokens(tasks: DataFrame) -> DataFrame:
    """Distinct (task_id, key) of everything the user said: words, amounts, parameters.

    Numbers in parameters count as given and as hundredths (rupees to paise).
    """
    punctuation = r"[\"'()\[\],;:!?]"
    bare = F.transform(
        F.split("text", r"(?U)\s+"),
        lambda w: F.regexp_replace(
            F.regexp_replace(w, f"^{punctuation}+|{punctuation}+$", ""), r"\.+$", ""
        ),
    )
    words = F.transform(F.filter(bare, lambda w: w != ""), text_key)
    amounts = F.transform(amount_tokens("text"), number_key)
    leaves = tasks.select(
        "task_id", F.concat(words, amounts).alias("_a"), F.try_parse_json("params").alias("_p")
    )
    typed = with_leaves(leaves, F.col("_p"), "_found").select(
        "task_id",
        "_a",
        F.transform(
            F.coalesce("_found", F.array().cast("array<struct<pointer:string,value:variant>>")),
            lambda x: F.struct(
                F.try_variant_get(x["value"], "$", "string").alias("text"),
                x["value"].alias("value"),
            ),
        ).alias("_l"),
    ).select("task_id", "_a", F.explode_outer("_l").alias("_x"))
    kind = F.expr(json_type_sql("_x.value"))
    number = F.try_variant_get("_x.value", "$", "bigint")
    from_params = (
        F.when(kind == "integer", F.array(number_key(number), number_key(number * 100)))
        .when(
            kind == "string",
            F.concat(
                F.array(text_key(F.col("_x.text"))),
                F.transform(amount_tokens("_x.text"), number_key),
            ),
        )
        .otherwise(F.array().cast("array<string>"))
    )
    keyed = typed.select("task_id", "_a", from_params.alias("_b"))
    # the words of a task repeat once per parameter here; distinct removes the repeats
    return keyed.select("task_id", F.explode(F.array_union("_a", "_b")).alias("key")).distinct()


def register_values(values: DataFrame) -> DataFrame:
    """Observed values by key with their joined label: ``key``, ``text``, level, kinds, tags.

    ``values`` has ``text`` or ``number`` and a label (level, source_kind, tag).
    """
    key = F.when(F.col("number").isNotNull(), number_key(F.col("number"))).otherwise(
        text_key(F.col("text"))
    )
    return (
        values.withColumn("key", key)
        .groupBy("key")
        .agg(
            F.min(normalise("text")).alias("text"),
            F.max("level").alias("level"),
            F.array_sort(F.collect_set("source_kind")).alias("kinds"),
            close_tags(F.collect_set("tag")).alias("tags"),
        )
    )


def _shingles(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters; NULL for shorter texts."""
    n = F.length(text)
    return F.when(
        n >= size,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substr(text, i, F.lit(size))
            )
        ),
    )


def _pieces(value: Column, size: int) -> Column:
    """Hashes of the distinct pieces of ``size`` characters."""
    return F.transform(_shingles(value, size), lambda piece: F.xxhash64(piece))


def substring_taint(
    values: DataFrame,
    registry: DataFrame,
    keys: Sequence[str],
    *,
    tiers: Sequence[int] = (MIN_SUBSTRING, 12),
) -> DataFrame:
    """Registered texts contained in a value: distinct ``keys``, ``text``.

    A contained text has all its pieces in the value, so values and texts meet on one piece of
    each text: the one fewest registered texts share, which keeps common prefixes from pairing
    everything with everything. ``contains`` then decides. Texts are cut into pieces as long as
    their length tier allows; texts below the first tier do not count. Each distinct value is cut
    once, and pieces travel as hashes with the hash of their value, never with the value. No side is
    broadcast: estimates made before texts are cut do not tell how many pieces there are.
    """
    texts = registry.select("text").distinct()
    whole = values.select(*keys, normalise("value").alias("_v")).where("_v IS NOT NULL")
    whole = whole.withColumn("_id", F.xxhash64("_v"))
    unique = whole.select("_id", "_v").distinct()
    hits = None
    for place, size in enumerate(tiers):
        fits = F.length("text") >= size
        if place + 1 < len(tiers):
            fits = fits & (F.length("text") < tiers[place + 1])
        pieces = texts.where(fits).select("text", F.explode(_pieces(F.col("text"), size)).alias("piece"))
        shared = pieces.groupBy("piece").agg(F.count("*").alias("_n"))
        anchors = (
            lookup(pieces, shared.hint("merge"), ["piece"], how="inner")
            .groupBy("text")
            .agg(F.min_by("piece", F.struct("_n", "piece")).alias("piece"))
        )
        opened = unique.select("_id", F.explode(_pieces(F.col("_v"), size)).alias("piece"))
        found = opened.join(anchors.hint("merge"), "piece").select("_id", "text")
        hits = found if hits is None else hits.unionByName(found)
    # values and pieces whose hashes collide are told apart here
    inside = hits.distinct().join(unique.hint("merge"), "_id").where(F.contains("_v", "text"))
    return whole.join(inside.hint("merge"), ["_id", "_v"]).select(*keys, "text").distinct()


def label_for_values(
    leaves: DataFrame, task_tokens: DataFrame, registry: DataFrame
) -> DataFrame:
    """Label of each argument leaf: ``call_id``, ``pointer``, level, kinds, tags, ``found``.

    ``leaves`` has ``call_id``, ``pointer``, ``task_id`` and ``value`` (variant). Order of
    lookup: words of the task, then observed values, then observed texts inside the value. A
    value found nowhere is the model's own and untrusted. Flags, nulls and empty containers
    carry no content.
    """
    kind = F.expr(json_type_sql("value"))
    text = F.try_variant_get("value", "$", "string")
    key = F.when(kind == "integer", number_key(F.try_variant_get("value", "$", "bigint"))).when(
        kind == "string", text_key(text)
    )
    rows = leaves.select(
        "call_id",
        "pointer",
        "task_id",
        kind.alias("_kind"),
        F.when(kind == "string", text).alias("_text"),
        is_filled(F.col("value")).alias("_filled"),
        key.alias("key"),
    )
    registry = stored(registry.select("key", "text", "level", "kinds", "tags"), "registry")
    said = lookup(
        rows, task_tokens.withColumn("_said", F.lit(True)), ["task_id", "key"], how="left"
    )
    known = lookup(
        said,
        registry.select(
            "key",
            F.col("level").alias("_level"),
            F.col("kinds").alias("_kinds"),
            F.col("tags").alias("_tags"),
        ),
        ["key"],
    )
    # read many times below: as often as texts are cut into pieces and met again
    known = stored(known.drop("key", "task_id"), "known")
    loose = known.where("_kind = 'string' AND _said IS NULL AND _level IS NULL").select(
        "call_id", "pointer", F.col("_text").alias("value")
    )
    hits = (
        substring_taint(loose, registry, ["call_id", "pointer"])
        .join(registry.select("text", "level", "kinds", "tags"), "text")
        .groupBy("call_id", "pointer")
        .agg(
            F.max("level").alias("_hit_level"),
            F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("_hit_kinds"),
            F.array_distinct(F.flatten(F.collect_set("tags"))).alias("_hit_tags"),
        )
    )
    empty = F.array().cast("array<string>")
    # a container that was not opened may hold anything: it counts as the model's own
    constant = F.col("_kind").isin("boolean", "null", "array", "object") & ~F.coalesce(
        "_filled", F.lit(False)
    )
    found = (
        F.when(constant, "constant")
        .when(F.col("_said"), "task")
        .when(F.col("_level").isNotNull(), "observed")
        .when(F.col("_hit_level").isNotNull(), "contains")
        .otherwise("model")
    )
    level = (
        F.when(constant, TRUSTED_SYSTEM)
        .when(F.col("_said"), TRUSTED_USER)
        .otherwise(F.coalesce("_level", F.lit(UNTRUSTED)))
    )
    kinds = (
        F.when(constant, F.array(F.lit("system")))
        .when(F.col("_said"), F.array(F.lit("user")))
        .when(F.col("_level").isNotNull(), F.col("_kinds"))
        .otherwise(F.array_union(F.coalesce("_hit_kinds", empty), F.array(F.lit("model"))))
    )
    own = F.when(F.col("_text").isNotNull(), pii_tags("_text")).otherwise(empty)
    inherited = F.when(F.col("_said"), empty).otherwise(F.coalesce("_tags", "_hit_tags", empty))
    return known.join(hits, ["call_id", "pointer"], "left").select(
        "call_id",
        "pointer",
        level.alias("level"),
        F.array_sort(kinds).alias("kinds"),
        close_tags(F.array_union(own, inherited)).alias("tags"),
        found.alias("found"),
    )


# ---------------------------------------------------------------- handles


def resolve_handles(leaves: DataFrame, handles: DataFrame) -> DataFrame:
    """Handles among argument leaves: the value they stand for, or a DENY for unknown ones.

    ``leaves`` has ``call_id``, ``tool``, ``pointer``, ``value`` (text); ``handles`` has
    ``handle``, ``value``, ``level``. Arguments a reader tool dereferences itself keep the
    handle as their value.
    """
    used = leaves.where(F.regexp_like("value", F.lit(HANDLE))).withColumnRenamed("value", "handle")
    found = lookup(
        used,
        handles.select("handle", F.col("value").alias("_v"), "level", F.lit(True).alias("_known")),
        ["handle"],
    )
    top = F.split("pointer", "/")[1]
    kept = F.lit(False)
    for tool, arg in PASS_THROUGH:
        kept = kept | ((F.col("tool") == tool) & (top == arg))
    known = F.coalesce("_known", F.lit(False))
    return found.select(
        "call_id",
        "pointer",
        "handle",
        F.when(known & ~kept, F.col("_v")).otherwise(F.col("handle")).alias("value"),
        "level",
        F.when(~known, "CORE.HANDLE.UNKNOWN").alias("rule_id"),
    )


def handle_roots(handles: DataFrame) -> DataFrame:
    """Source handle of every handle: ``handle``, ``root``, ``depth`` of derivation.

    Pointer doubling: each round every handle jumps to what its current ancestor has reached,
    so a chain of length n needs log2(n) joins. Only counts come to the driver. A round that ends
    no walk leaves nothing but cycles and what hangs on them: those get a NULL root and depth.
    """
    from gatelens.session import durable

    state = handles.select(
        "handle",
        F.coalesce("parent", "handle").alias("root"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
        F.col("parent").isNull().alias("done"),
    )
    before = None
    while True:
        ahead = state.select(
            F.col("handle").alias("root"),
            F.col("root").alias("_next"),
            F.col("depth").alias("_more"),
            F.col("done").alias("_done"),
        )
        joined = lookup(state, ahead, ["root"])
        state = durable(
            joined.select(
                "handle",
                F.coalesce("_next", "root").alias("root"),
                (F.col("depth") + F.when(F.col("done"), 0).otherwise(F.coalesce("_more", F.lit(0)))).alias(
                    "depth"
                ),
                # an ancestor nobody knows ends the walk too
                (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done"),
            )
        )
        open_walks = state.where(~F.col("done")).count()
        if open_walks in (0, before):
            ended = [F.when(F.col("done"), F.col(c)).alias(c) for c in ("root", "depth")]
            return state.select("handle", *ended)
        before = open_walks


def lineage(
    calls: DataFrame, labels: DataFrame, uses: DataFrame, handles: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from sources over derivations to sinks, each once per call.

    ``calls``: call_id, server, tool. ``labels``: call_id, pointer, level, source_kind,
    source_id. ``uses``: call_id, pointer, handle. ``handles``: handle, kind (doc or var),
    source_kind, ref, op.
    """
    sink = F.concat(F.lit("sink:"), F.concat_ws(".", "server", "tool"))
    named = calls.select("call_id", sink.alias("dst"))
    opened = uses.join(handles, "handle").join(named, "call_id")
    source = F.concat_ws(":", F.lit("src"), "source_kind", "ref")
    derived = F.concat(F.lit("var:"), "handle")
    arg = F.concat(F.lit("arg:"), "pointer")
    extract = opened.where("kind = 'var'").select(
        "call_id", source.alias("src"), derived.alias("dst"), F.lit("extract").alias("op")
    )
    flow = opened.where("kind = 'var'").select(
        "call_id", derived.alias("src"), "dst", arg.alias("op")
    )
    direct = opened.where("kind <> 'var'").select(
        "call_id", source.alias("src"), "dst", arg.alias("op")
    )
    rest = labels.join(uses.select("call_id", "pointer"), ["call_id", "pointer"], "left_anti")
    labelled = (
        rest.where(F.col("source_kind").isNotNull())
        .join(named, "call_id")
        .select(
            "call_id",
            F.concat_ws(":", F.lit("src"), "source_kind", "source_id").alias("src"),
            "dst",
            arg.alias("op"),
        )
    )
    edges = extract.unionByName(flow).unionByName(direct).unionByName(labelled).distinct()
    sinks = (
        labels.groupBy("call_id")
        .agg(F.max("level").alias("level"))
        .join(named, "call_id", "right")
        .select(
            "call_id",
            F.col("dst").alias("id"),
            F.lit("sink").alias("kind"),
            F.coalesce("level", F.lit(TRUSTED_USER)).alias("level"),
        )
    )
    others = edges.select("call_id", F.col("src").alias("id")).distinct()
    kind = F.when(F.startswith("id", F.lit("var:")), "derivation").otherwise("source")
    nodes = sinks.unionByName(
        others.select("call_id", "id", kind.alias("kind"), F.lit(None).cast("int").alias("level"))
    )
    return nodes, edges


def bind_tasks(calls: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task of each call: ``bound_task``, ``purpose``, ``category`` and a DENY rule without one.

    A call follows the newest task bound in its session up to its time. A call that pins a task
    id gets exactly that task, and only when the pin was right (``pin_ok``).
    """
    payload = ["bound_task", "purpose", "category"]
    bound = tasks.withColumnRenamed("task_id", "bound_task")
    free = as_of(
        calls.where("pinned_task IS NULL"),
        bound,
        ["session_id"],
        "ts",
        "created_ts",
        payload,
        ties=["bound_task"],
    )
    pins = bound.select(F.col("bound_task").alias("pinned_task"), *payload)
    pinned = lookup(calls.where("pinned_task IS NOT NULL"), pins, ["pinned_task"])
    for name in payload:
        pinned = pinned.withColumn(name, F.when(F.col("pin_ok"), F.col(name)))
    unbound = F.when(F.col("bound_task").isNull(), "CORE.TASK.UNBOUND")
    return free.unionByName(pinned).withColumn("rule_id", unbound)


def injection_of_calls(uses: DataFrame, handles: DataFrame) -> DataFrame:
    """Highest injection score among the handles a call uses."""
    return (
        lookup(uses, handles.select("handle", "injection_score"), ["handle"], how="inner")
        .groupBy("call_id")
        .agg(F.max("injection_score").alias("injection"))
    )


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))
