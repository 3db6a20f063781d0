"""Keeping the heaviest rows of a group until they cover a share of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.operators.ranking import running_total


def keep_coverage(rows: DataFrame, group: list[str], weight: str, order: list[Column | str], cover: float, floor: float = 0.0) -> DataFrame:
    """Rows of each group, heaviest first, up to and with the one that reaches ``cover`` of the group's weight.

    ``order`` breaks ties and must make the order total. With ``floor``, rows below
    that share of the weight are dropped, but never the heaviest. Weights are
    positive; a ``cover`` above 1 keeps all.
    """
    by = W.partitionBy(*group)
    ordered = by.orderBy(F.col(weight).desc(), *order)
    marked = rows.select(
        "*",
        F.coalesce(F.sum(weight).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum(weight).over(by).alias("_total"),
        F.row_number().over(ordered).alias("_rank"),
    )
    kept = (F.col("_before") < F.lit(cover) * F.col("_total")) & ((F.col("_rank") == 1) | (F.col(weight) >= F.lit(floor) * F.col("_total")))
    return marked.where(kept).drop("_before", "_total", "_rank")


def importance(rows: DataFrame, score: str, out: str = "importance") -> DataFrame:
    """Adds 0..100, the percentile of ``score`` with ties at the lowest rank."""
    counts = running_total(rows.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n")), ["_s"], "_n", "_below")
    total = rows.count()
    pct = F.round(100 * F.col("_below") / F.lit(max(1, total - 1))).cast("int")
    return rows.join(counts, F.col(score).eqNullSafe(F.col("_s"))).withColumn(out, pct).drop("_s", "_n", "_below")


def majority(rows: DataFrame, group: list[str], value: str, weight: Column | None = None, out: str = "winner") -> DataFrame:
    """The value with the most votes in each group; of equals the smallest."""
    votes = rows.groupBy(*group, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("_votes"))
    first = F.min_by(F.col(value), F.struct((-F.col("_votes")).alias("v"), F.col(value).alias("x")))
    return votes.groupBy(*group).agg(first.alias(out), F.max("_votes").alias("votes"))


def floor_quantile(values: Column, q: float) -> Column:
    """Element ``floor(q * (n - 1))`` (from 0) of the sorted array; null for an empty one."""
    return F.try_element_at(F.array_sort(values), F.floor(F.lit(q) * (F.size(values) - 1)).cast("int") + 1)


def upper_median(values: Column) -> Column:
    """Element ``n // 2`` (from 0) of the sorted array; null for an empty one."""
    return F.try_element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)
