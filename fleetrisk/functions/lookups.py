"""Turn small fixed mappings into column expressions, so that they need no join at all."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    """SQL text of a fixed value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(sql_literal, value))})" if value else "cast(array() AS array<string>)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(mapping: Mapping) -> Column:
    """One parsed expression instead of a call per entry."""
    return F.expr(f"map({', '.join(sql_literal(x) for x in chain.from_iterable(mapping.items()))})")


def lookup(mapping: Mapping, key: Column) -> Column:
    """Value for ``key`` or NULL."""
    return F.try_element_at(literal_map(mapping), key)


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def rows_where(*cases: tuple[Column, Column]) -> Column:
    """Array of the values whose condition holds: feed it to ``explode`` to emit rows in one pass."""
    return F.array_compact(F.array(*[F.when(condition, value) for condition, value in cases]))


def nullif_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def concat_or_empty(*columns: Column) -> Column:
    return F.concat(*[F.coalesce(c, F.lit("")) for c in columns])
