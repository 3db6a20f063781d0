"""Keeping or dropping rows by a set of keys, with the join chosen by the size of the set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from isochron.plans.runtime import cut_lineage

#: A key set is broadcast up to this many rows (16 bytes each or so); larger ones are shuffled.
BROADCAST_KEYS = 4_000_000


def _checked(keys: DataFrame, limit: int) -> DataFrame:
    keys = cut_lineage(keys.distinct())
    return keys.hint("broadcast") if keys.count() <= limit else keys.hint("shuffle_hash")


def without_keys(rows: DataFrame, keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` whose values in the columns of ``keys`` are not there; rows with a null in them stay."""
    return rows.join(_checked(keys.dropna(), limit), keys.columns, "left_anti").select(*rows.columns)


def with_keys(rows: DataFrame, keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` whose values in the columns of ``keys`` are there."""
    return rows.join(_checked(keys.dropna(), limit), keys.columns, "left_semi").select(*rows.columns)
