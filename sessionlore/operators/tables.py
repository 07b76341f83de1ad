"""Joins, group attachments, pivots, JSON unnesting and table checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlore.functions.catalogue import KEYS, PLAYER, SESSION
from sessionlore.session import materialize


def attach_group(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Group aggregates on every row of the group.

    The aggregate is combined before its shuffle and joined back, so that a group of any size is
    read by many tasks; a window would put it into one.
    """
    groups = df.groupBy(*keys).agg(*[value.alias(name) for name, value in values.items()])
    return df.join(groups, list(keys))


def in_both(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose session and whose player each occur in ``other``: two tests, not one of the pair."""
    sessions, players = other.select(SESSION).distinct(), other.select(PLAYER).distinct()
    return df.join(sessions, SESSION, "left_semi").join(players, PLAYER, "left_semi")


#: Rows of a reduced table up to which it is sent to all tasks.
FEW = 100_000


def join_counted(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Inner join with a reduced table, written and counted first: broadcast where it is small, else shuffled."""
    dim = materialize(dim)
    return df.join(F.broadcast(dim) if dim.count() <= FEW else dim, on)


def not_in_sessions(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select(SESSION).distinct(), SESSION, "left_anti")


def keep_left(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return left.join(right, list(keys), "left")


def keep_right(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return left.join(right, list(keys), "right")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def only(df: DataFrame, names: Sequence[str]) -> DataFrame:
    wanted = set(names)
    return df.select([F.col(f"`{c}`") for c in df.columns if c in wanted])


def pivot(df: DataFrame, by: Sequence[str], column: str, values: dict, cell: Column) -> DataFrame:
    """``cell`` per group and declared value, in columns named by ``values``; 0 where none."""
    wide = df.groupBy(*by).pivot(column, list(values)).agg(cell)
    return wide.select(
        *by, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(name) for v, name in values.items()]
    )


def pivot_presence(df: DataFrame, by: Sequence[str], column: str, values: dict,
                   absent: int | None = 0) -> DataFrame:
    """1 where the group has the value, else ``absent``."""
    return df.groupBy(*by).agg(*[
        F.coalesce(F.max(F.when(F.col(column) == v, 1)), F.lit(absent)).alias(name)
        for v, name in values.items()
    ])


def same_width(left: DataFrame, right: DataFrame) -> bool:
    return len(left.columns) == len(right.columns)


def require_columns(table: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The table, if it has exactly the expected columns."""
    if len(table.columns) != len(expected) or set(table.columns) != set(expected):
        odd = sorted(set(table.columns) ^ set(expected))
        raise ValueError(f"columns differ: {odd}")
    return table


def object_schema(df: DataFrame, column: str) -> T.StructType:
    """The union of the keys of a JSON object column, each with its type; keys that are only null are text."""
    parsed = F.schema_of_variant_agg(F.try_parse_json(F.col(column)))
    found = df.agg(parsed.alias("s")).first()["s"]
    if not found.startswith("OBJECT<"):
        raise ValueError(f"{column} holds no JSON objects: {found}")
    return _object_fields(found, len("OBJECT<"))[0]


def _object_fields(text: str, at: int) -> tuple[T.StructType, int]:
    """Fields from ``name: type, ...>``; names that hold other characters than word ones stand in backticks."""
    fields = []
    while text[at] != ">":
        if text[at] == "`":
            end = at + 1
            while text[end] != "`" or text[end + 1] == "`":
                end += 2 if text[end] == "`" else 1
            name, at = text[at + 1:end].replace("``", "`"), end + 1
        else:
            end = text.index(":", at)
            name, at = text[at:end], end
        kind, at = _object_type(text, at + len(": "))
        fields.append(T.StructField(name, kind))
        at += len(", ") if text.startswith(", ", at) else 0
    return T.StructType(fields), at + 1


def _object_type(text: str, at: int) -> tuple[T.DataType, int]:
    if text.startswith("OBJECT<", at):
        return _object_fields(text, at + len("OBJECT<"))
    if text.startswith("ARRAY<", at):
        inner, at = _object_type(text, at + len("ARRAY<"))
        return T.ArrayType(inner), at + 1
    simple = re.match(r"[A-Z_]+(\([0-9, ]+\))?", text[at:])[0]
    kind = T.StringType() if simple in ("VOID", "VARIANT") else T.DataType.fromDDL(simple)
    return kind, at + len(simple)


def json_unnest(df: DataFrame, column: str, schema: T.StructType | str | None = None, prefix: str = "json_") -> DataFrame:
    """The table with a column per JSON key; a key missing in a row gives null.

    A key that names a column of the table, or an earlier key, in whatever case, gets ``prefix`` before it, as
    often as it takes.
    """
    schema = schema or object_schema(df, column)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken, columns, layers = {c.lower() for c in df.columns}, [], []
    for field in schema:
        new = field.name
        while new.lower() in taken:
            new = prefix + new
        taken.add(new.lower())
        # Keys that differ in case only are read by schemas of their own.
        layer = next((k for k, names in enumerate(layers) if field.name.lower() not in names), len(layers))
        layers[layer:layer + 1] = [(layers[layer] if layer < len(layers) else {}) | {field.name.lower(): field}]
        columns.append((layer, field.name, new))
    parsed = df.withColumns({
        f"_json{k}": F.from_json(column, T.StructType(list(names.values()))) for k, names in enumerate(layers)})
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns], *[
        F.col(f"_json{layer}").getField(name).alias(new) for layer, name, new in columns])
