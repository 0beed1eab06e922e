"""Small literal lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def pick(key: Column, table: Mapping[object, object], default: object = None) -> Column:
    """Value of ``key`` in a small literal table, ``default`` where it is missing."""
    entries = F.expr(f"map({', '.join(_literal(part) for pair in table.items() for part in pair)})")
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def one_of(key: Column, values: Iterable[str]) -> Column:
    return key.isin(list(values))


def texts(*items: Column) -> Column:
    """Array of the non-null texts among ``items``."""
    return F.array_compact(F.array(*items))
