"""Tolerant readings of loosely typed JSON properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_string(json: Column, key: str) -> Column:
    """A scalar property as text, "" if absent or null."""
    return F.coalesce(F.get_json_object(json, f"$.{key}"), F.lit(""))


def any_int(json: Column, key: str) -> Column:
    """A number, or a text that is one, as an int; 0 otherwise."""
    return F.coalesce(F.trim(F.get_json_object(json, f"$.{key}")).try_cast("double").try_cast("int"), F.lit(0))


def any_bool(json: Column, key: str) -> Column:
    """true, yes, 1 (any case) and non-zero numbers; false otherwise."""
    v = F.lower(F.trim(F.get_json_object(json, f"$.{key}")))
    return F.coalesce(v.isin("true", "yes", "1") | (v.try_cast("double") != 0), v.isin("true", "yes", "1"), F.lit(False))


def route_list(value: Column) -> Column:
    """Routes of a comma list or a JSON array: trimmed, without empty ones."""
    parsed = F.from_json(value, "array<string>")
    listed = F.when(F.trim(value).startswith("["), parsed).otherwise(F.split(value, ","))
    return F.coalesce(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def acts_index(routes: Column, masks: Column) -> Column:
    """``route=NN`` for each route with the index of its mask; "" if an id holds a separator or lengths differ."""
    safe = F.forall(routes, lambda r: ~r.rlike("[=,;]"))
    pairs = F.transform(routes, lambda r, i: F.concat(r, F.lit("="), F.lpad(i.cast("string"), 2, "0")))
    return F.when(safe & (F.size(routes) == F.size(masks)), F.array_join(pairs, ",")).otherwise("")


def kind_code(kind: Column) -> Column:
    """Code of a segment kind in the binary format."""
    return F.when(kind == "steady", 0).when(kind == "transition", 1).when(kind == "bridge", 2).otherwise(255)
