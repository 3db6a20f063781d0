"""Running totals and ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.plans.runtime import cut_lineage


def running_total(rows: DataFrame, order: list[str], value: str, out: str = "total_before") -> DataFrame:
    """Adds the sum of ``value`` over all rows that come earlier in the total order ``order``.

    Rows are range-partitioned; each partition sums its own, and the sums of the
    partitions before it (one number each) are added.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sums = {r["_pid"]: r["s"] for r in ranged.groupBy("_pid").agg(F.sum(value).alias("s")).collect()}
    before, offset = 0, {}
    for pid in sorted(sums):
        offset[pid] = before
        before += sums[pid] or 0
    own = F.coalesce(F.sum(value).over(W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if not offset:
        return rows.withColumn(out, F.lit(0).cast("bigint"))
    start = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])
    return ranged.withColumn(out, own + start[F.col("_pid")]).drop("_pid")
