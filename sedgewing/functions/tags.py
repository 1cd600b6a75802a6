"""Auxiliary tags: maps from two-letter names to values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(tags: Column, name: str) -> Column:
    """The tag's text, null if it is missing."""
    return F.try_element_at(tags, F.lit(name))


def number(tags: Column, name: str) -> Column:
    return get(tags, name).try_cast("double")


def checked(tags: Column, name: str) -> Column:
    """The tag's text; a missing tag is an error."""
    return F.coalesce(get(tags, name), F.raise_error(F.lit(f"missing tag {name}")).cast("string"))


def get_any_case(tags: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(tags, lambda k, v: F.lower(k) == name.lower())), 0)


def keep(tags: Column, names: list[str]) -> Column:
    return F.map_filter(tags, lambda k, v: k.isin(*names))


def drop(tags: Column, names: list[str]) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin(*names))


def ordered(tags: Column) -> Column:
    """The tags by name."""
    return F.map_from_entries(F.array_sort(F.map_entries(tags)))


def put(tags: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(tags, lambda k, v: k != name), F.create_map(F.lit(name), value))


def names(tags: Column, without: tuple[str, ...] = ()) -> Column:
    return F.array_sort(F.filter(F.map_keys(tags), lambda k: ~k.isin(*without) if without else F.lit(True)))


def copied(to: Column, source: Column, chosen: list[str]) -> Column:
    """``to`` with the chosen tags of ``source``."""
    extra = keep(source, chosen)
    return F.map_concat(F.map_filter(to, lambda k, v: ~F.map_contains_key(extra, k)), extra)
