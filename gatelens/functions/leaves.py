"""Leaves of JSON arguments: pointer, type and value of every scalar and empty container."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import escape_token, let

#: Levels opened inside the JVM; deeper containers, which are rare, are finished in Arrow batches.
NATIVE_LEVELS = 4


def _children(value: Column) -> Column:
    """Child entries of a container as array<struct<key, value>>, NULL for scalars."""
    members = F.transform(
        F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")),
        lambda e: F.struct(escape_token(e["key"]).alias("key"), e["value"].alias("value")),
    )
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")),
    )
    return F.coalesce(members, items)


def leaf_array(args: Column, *, depth: int = NATIVE_LEVELS) -> Column:
    """Leaves of a variant as array<struct<pointer, value>>, inside the row and the JVM.

    ``depth`` levels are opened. A container below that stays in the result as it is;
    ``with_leaves`` finishes it.
    """
    found = F.transform(
        _children(args),
        lambda e: F.struct(
            F.concat(F.lit("/"), e["key"]).alias("pointer"), e["value"].alias("value")
        ),
    )
    return open_leaves(found, depth - 1)


def _is_container(value: Column) -> Column:
    # one look at the schema: it is written out whole each time
    return F.substring(F.schema_of_variant(value), 1, 6).isin("OBJECT", "ARRAY<")


def is_filled(value: Column) -> Column:
    """Whether a variant is a container with members; only an empty one is a leaf."""
    return _is_container(value) & (F.size(_children(value)) > 0)


def open_leaves(found: Column, levels: int) -> Column:
    """Replace containers in an array of (pointer, value) by their children, ``levels`` times.

    Arrays without containers are left at once, so flat arguments cost one look per leaf.
    """

    def opened(node: Column) -> Column:
        itself = F.array(node)

        def named(children: Column) -> Column:
            return F.when(
                F.size(children) > 0,
                F.transform(
                    children,
                    lambda e: F.struct(
                        F.concat(node["pointer"], F.lit("/"), e["key"]).alias("pointer"),
                        e["value"].alias("value"),
                    ),
                ),
            ).otherwise(itself)

        return F.when(_is_container(node["value"]), let(_children(node["value"]), named)).otherwise(
            itself
        )

    if levels == 0:
        return found
    return let(
        found,
        lambda nodes: F.when(
            F.exists(nodes, lambda n: _is_container(n["value"])),
            open_leaves(F.flatten(F.transform(nodes, opened)), levels - 1),
        ).otherwise(nodes),
    )


def _finished(rest: Column) -> Column:
    """Leaves of (pointer, JSON text) containers at any depth; most rows have none of them."""

    @F.pandas_udf("array<struct<pointer:string,value:string>>")
    def walk_documents(rows: pd.Series) -> pd.Series:
        import json

        def walk(value, base):
            waiting = [(value, base)]
            while waiting:
                value, base = waiting.pop()
                if isinstance(value, dict) and value:
                    inner = [(k.replace("~", "~0").replace("/", "~1"), v) for k, v in value.items()]
                elif isinstance(value, list) and value:
                    inner = list(enumerate(value))
                else:
                    yield {"pointer": base, "value": json.dumps(value, ensure_ascii=False)}
                    continue
                waiting.extend((item, f"{base}/{name}") for name, item in reversed(inner))

        def one(nodes):
            if nodes is None or not len(nodes):
                return []
            return [x for n in nodes for x in walk(json.loads(n["value"]), n["pointer"])]

        return rows.map(one)

    # not to be evaluated twice, nor to be moved into a filter below the projection
    return walk_documents.asNondeterministic()(rest)


def with_leaves(df: DataFrame, args: Column, out: str) -> DataFrame:
    """``df`` with all leaves of a variant as array<struct<pointer, value>>, at any depth.

    The first levels are opened in the JVM. Only containers below them go through Arrow, as text;
    rows without such a container send an empty array. NULL for what is no container.
    """
    native = df.withColumn("_native", leaf_array(args)).withColumn(
        "_filled", F.transform("_native", lambda n: is_filled(n["value"]))
    )
    filled = F.filter("_native", lambda n, i: F.get("_filled", i))
    rest = F.transform(
        F.coalesce(filled, F.array().cast("array<struct<pointer:string,value:variant>>")),
        lambda n: F.struct(n["pointer"].alias("pointer"), F.to_json(n["value"]).alias("value")),
    )
    below = F.transform(
        "_below",
        lambda n: F.struct(
            n["pointer"].alias("pointer"), F.try_parse_json(n["value"]).alias("value")
        ),
    )
    ready = F.filter("_native", lambda n, i: ~F.get("_filled", i))
    return (
        native.withColumn("_below", _finished(rest))
        .withColumn(
            out, F.when(F.size("_below") == 0, F.col("_native")).otherwise(F.concat(ready, below))
        )
        .drop("_native", "_filled", "_below")
    )


def flatten_args(
    calls: DataFrame, *, args: str = "args", key: str = "call_id", depth: int | None = None
) -> DataFrame:
    """``key``, ``pointer``, ``value`` (variant): one row per leaf of the JSON text ``args``.

    Leaves are found at any depth. With ``depth`` only so many levels are opened, and a container
    below them is a row of its own.
    """
    parsed = F.try_parse_json(args)
    if depth is None:
        opened = with_leaves(calls.select(key, args), parsed, "leaves")
    else:
        opened = calls.select(key, leaf_array(parsed, depth=depth).alias("leaves"))
    # the plain explode would have its array computed twice more, to leave out empty ones beforehand
    rows = opened.select(key, F.explode_outer("leaves").alias("leaf")).where("leaf IS NOT NULL")
    return rows.select(key, "leaf.*")
