"""Policies of the gateway: projections of results, grants, and checks of references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Allowed = Mapping[str, "bool | Sequence[str]"]


def _fields(kind: T.StructType, keys: Sequence[str], get) -> list[Column]:
    return [get(f.name).alias(f.name) for f in kind if f.name in set(keys)]


def allow(payload: DataFrame, allowed: Allowed | None) -> DataFrame:
    """Columns that a policy allows: ``True`` keeps one whole, a list keeps those fields of a
    struct or of an array of structs; any other type, or an unknown tool (None), is left out."""
    columns = []
    for key, what in (allowed or {}).items():
        if key not in payload.columns:
            continue
        kind, column = payload.schema[key].dataType, F.col(f"`{key}`")
        if what is True:
            columns.append(column)
        elif isinstance(kind, T.StructType):
            inner = _fields(kind, what, lambda n, c=column: c[n])
            if inner:
                columns.append(F.struct(*inner).alias(key))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            element = kind.elementType
            if any(f.name in set(what) for f in element):
                columns.append(F.transform(column, lambda x: F.struct(*_fields(element, what, lambda n: x[n]))).alias(key))
    return payload.select(*columns)


def grant(asked: Column, intent: Column, agent: Column) -> Column:
    """Capabilities asked for that both the intent and the agent have, sorted."""
    return F.array_sort(F.array_intersect(F.array_intersect(asked, intent), agent))


def pass_through(payload: DataFrame) -> DataFrame:
    """The filter that leaves a result as it is."""
    return payload


def grants(requests: DataFrame, agents: DataFrame, intents: DataFrame) -> DataFrame:
    """``requests`` (``agent, intent, asked``) with the ``tools`` they get, or the ``error`` that refuses them.

    ``agents(name, intents)``, ``intents(name, tools)``.  Nothing asked for (null) means all tools
    of the intent; an empty list, an unknown agent or intent, an intent that is not the agent's,
    and a list without a tool of the intent are refused.
    """
    joined = requests.join(
        agents.select(F.col("name").alias("__agent"), F.col("intents").alias("__intents")), F.col("agent") == F.col("__agent"), "left"
    ).join(intents.select(F.col("name").alias("__intent"), F.col("tools").alias("__tools")), F.col("intent") == F.col("__intent"), "left")
    common = F.array_sort(F.coalesce(F.array_intersect("asked", "__tools"), F.col("__tools")))
    error = (
        F.when(F.size("asked") == 0, "NOTHING_ASKED")
        .when(F.col("__agent").isNull(), "UNKNOWN_AGENT")
        .when(F.col("__intent").isNull(), "UNKNOWN_INTENT")
        .when(~F.array_contains("__intents", F.col("intent")), "INTENT_NOT_ALLOWED")
        .when(F.col("asked").isNotNull() & (F.size(common) == 0), "NO_TOOL_ALLOWED")
    )
    return joined.select(*requests.columns, F.when(error.isNull(), common).alias("tools"), error.alias("error"))


def may_call(capabilities: Column, tool: Column) -> Column:
    return F.array_contains(capabilities, tool)


def broken_references(agents: DataFrame, intents: DataFrame, filters: DataFrame) -> DataFrame:
    """``kind, name, missing``: references of a policy to what it does not define.

    ``agents(name, intents)``, ``intents(name, filter)``, ``filters(name)``.
    """
    wanted = agents.select(F.col("name"), F.explode("intents").alias("missing"))
    a = wanted.join(intents, wanted["missing"] == intents["name"], "left_anti").select(
        F.lit("agent").alias("kind"), "name", "missing"
    )
    used = intents.select("name", F.col("filter").alias("missing")).where("missing IS NOT NULL")
    b = used.join(filters, used["missing"] == filters["name"], "left_anti").select(
        F.lit("intent").alias("kind"), "name", "missing"
    )
    return a.unionByName(b)


def filter_faults(filters: DataFrame, intents: DataFrame) -> DataFrame:
    """``kind, name, missing``: allow-lists without schemas, and schemas of tools that no intent with the filter has.

    ``filters(name, type, schemas)`` with the tools that have a schema, ``intents(name, filter, tools)``.
    """
    lists = filters.where("type = 'structural_allowlist'")
    bare = lists.where("schemas IS NULL OR size(schemas) = 0").select(
        F.lit("filter").alias("kind"), "name", F.lit("schemas").alias("missing")
    )
    used = intents.select(F.col("filter").alias("f"), F.explode("tools").alias("t")).distinct()
    named = lists.select("name", F.explode("schemas").alias("missing"))
    stray = named.join(used, (F.col("name") == F.col("f")) & (F.col("missing") == F.col("t")), "left_anti")
    return bare.unionByName(stray.select(F.lit("schema").alias("kind"), "name", "missing"))
