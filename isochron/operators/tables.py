"""Set operations between tables: unions, differences, cascades, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.plans.runtime import cut_lineage


def first_wins_union(frames: list[DataFrame], key: str) -> DataFrame:
    """All rows in order of the frames, of equal keys only the first frame's; rows with a null key all stay.

    Inside one frame the row of least content wins.
    """
    out = frames[0].withColumn("_src", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_src", F.lit(i)), allowMissingColumns=True)
    cols = [c for c in out.columns if c not in ("_src", key)]
    keyed = out.where(F.col(key).isNotNull())
    kept = keyed.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("_src", *cols)).alias("_row")).select(key, "_row.*")
    return kept.unionByName(out.where(F.col(key).isNull()).drop("_src"))


def first_filled(rows: DataFrame, key: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """For each key and column, the first value in ``order`` that isn't empty or null."""
    pick = [F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(*order))).alias(c) for c in cols]
    return rows.groupBy(*key).agg(*pick)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): created, deleted, modified or same, between two keyed tables."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), new.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = (
        F.when(F.col("_in_a").isNull(), "created").when(F.col("_in_b").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("modified")
    )
    return a.join(b, key, "full").select(key, change.alias("change"))


def missing_rows(have: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key isn't in ``have``."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def closure(seed: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """All nodes that ``edges(src, dst)`` reach from ``seed(node)``, the seed too.

    Each round joins only the nodes found in the last one.
    """
    seen = cut_lineage(seed.select("node").distinct())
    front = seen
    for _ in range(max_rounds):
        nxt = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut_lineage(nxt.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(front))
    raise RuntimeError(f"closure not complete after {max_rounds} rounds")


def unordered_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(lo, hi, n, one_way): edges between each two nodes in either direction, and whether all run the same way."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(lo.alias("lo"), hi.alias("hi")).agg(
        F.count("*").alias("n"), (F.bool_and(F.col(a) <= F.col(b)) | F.bool_and(F.col(a) >= F.col(b))).alias("one_way")
    )


def canonical_hash(rows: DataFrame, group: list[str], parts: list[str], out: str = "hash", bits: str = "sha1") -> DataFrame:
    """Hash of the sorted distinct ``a|b`` lines of each group."""
    text = F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", *parts))), "\n")
    return rows.groupBy(*group).agg((F.sha1(text) if bits == "sha1" else F.sha2(text, 256)).alias(out))
