"""Telling rows apart by what they hold, where ids may be null or repeated."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.operators.selection import without_keys


def free(name: str, columns: Iterable[str]) -> str:
    """``name``, with as many more underscores before it as no column begins with (names differ without case)."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = "_" + name
    return name


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that equal rows share and, but for chance, no others."""
    cols = [column(c) for c in docs.columns]
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``keys`` (two columns)."""
    k = free("_k", docs.columns)
    a, b = row_key(docs)
    marked = docs.withColumns({f"{k}1": a, f"{k}2": b})
    return without_keys(marked, keys.toDF(f"{k}1", f"{k}2")).drop(f"{k}1", f"{k}2")
