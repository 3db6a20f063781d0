"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components.

Equal fingerprints are one class from the start; only distinct ones are compared.
The 64 bits are split into ``distance + m`` blocks. Two fingerprints that differ
in at most ``distance`` bits agree on at least ``m`` whole blocks, so each pair
meets in the bucket of some choice of ``m`` blocks. ``m`` grows with the number
of distinct fingerprints, so that buckets of unrelated ones stay small.

Inside a bucket only a spanning forest of the links is emitted, never all pairs,
by a search that removes each fingerprint from the unvisited ones once it is
linked. A bucket above ``BUCKET`` is dealt out as pairs of bounded parts.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.rows import column, free, row_key, without_rows
from isochron.operators.components import connected_components
from isochron.operators.selection import with_keys
from isochron.plans.runtime import cut_lineage

#: Most distinct fingerprints that one search takes; larger buckets are split into parts of this size.
BUCKET = 1 << 18


#: Shingles of a text are hashed so many at a time.
PART = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 if it has no word. Of a long text only PART shingles are held at once."""
    raw = (text or "").encode().lower()  # bytes: A-Z only
    if len(raw) <= 8 * PART:
        words = raw.split()  # at 0x20 and 0x09-0x0D
        if not words:
            return 0
        rows = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
        ones, n = _bits([xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, rows)])
    else:
        ones, n, last, h = np.zeros(64, dtype=np.int64), 0, deque(maxlen=width), []
        for m in _WORD.finditer(raw):
            last.append(m[0])
            if len(last) == width:
                h.append(xxhash.xxh64_intdigest(b" ".join(last), 42))
            if len(h) == PART:
                more, k = _bits(h)
                ones, n, h = ones + more, n + k, []
        if not n and not h:
            if not last:
                return 0
            h = [xxhash.xxh64_intdigest(b" ".join(last), 42)]
        more, k = _bits(h)
        ones, n = ones + more, n + k
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _bits(h: list[int]) -> tuple[np.ndarray, int]:
    """How many of the hashes have each bit set, and how many hashes."""
    bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64), len(h)


def fingerprints(docs: DataFrame, width: int = 4, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and fp of every row; fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(len(keep))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[column(c) for c in keep], column(text_col)).mapInArrow(run, f"{types}, fp bigint")


def block_masks(distance: int, m: int) -> list[int]:
    """For each choice of ``m`` of ``distance + m`` blocks, the mask of their bits."""
    n = distance + m
    edge = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m)]


def blocks_for(count: int, distance: int) -> int:
    """The least ``m`` of two or more whose buckets hold about four unrelated fingerprints at most."""
    m = 2
    while m < 8 and count > 4 << (64 * m // (distance + m)):
        m += 1
    return m


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs linking every two of the distinct ``fps`` that a chain of steps of at most ``distance`` bits connects."""
    a, b = [], []
    left = np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= distance
            if near.any():
                got = left[near]
                a.append(np.full(len(got), x))
                b.append(got)
                front.extend(got.tolist())
                left = left[~near]
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, dtype=np.int64)
    return cat(a), cat(b)


def _link_buckets(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            col = batch.column(0)
            values = col.flatten()
            rep = values.to_numpy()
            fp = rep.view(np.uint64)
            edge = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            two = np.flatnonzero(np.diff(edge) == 2)  # by far the most
            i = edge[two]
            near = np.bitwise_count(fp[i] ^ fp[i + 1]) <= distance
            us.append(rep[i[near]])
            vs.append(rep[i[near] + 1])
            for k in np.flatnonzero(np.diff(edge) > 2):
                lo, hi = edge[k], edge[k + 1]
                a, b = spanning_links(fp[lo:hi], distance)
                us.append(rep[lo:hi][a])
                vs.append(rep[lo:hi][b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    return run


def near_links(classes: DataFrame, count: int, distance: int = 4, bucket: int = BUCKET, m: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all pairs within ``distance`` bits."""
    masks = block_masks(distance, m or blocks_for(count, distance))
    keys = classes.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(x - (1 << 64) if x >> 63 else x)).alias("key")) for i, x in enumerate(masks)])).alias("b")
    ).select("fp", "b.choice", "b.key")
    group = ["choice", "key", "part"]
    if count <= bucket:  # no bucket can be larger
        keys = keys.withColumn("part", F.lit(0))
    else:
        # At most len(masks) * count / bucket buckets are large, so the list of them is short.
        large = keys.groupBy("choice", "key").count().where(F.col("count") > bucket).withColumn("parts", F.ceil(F.col("count") / bucket).cast("int"))
        keys = keys.join(large.drop("count"), ["choice", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts").cast("bigint"))
        # part i is compared with itself and with each other part: pairs (i, j), i <= j, numbered i * parts + j
        pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
        keys = keys.withColumn("part", F.explode(pair))
    buckets = keys.groupBy(*group).agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return buckets.select("members").mapInArrow(_link_buckets(distance), "u bigint, v bigint").distinct()


def _grouped(fps: DataFrame, distance: int, bucket: int, m: int | None = None) -> DataFrame:
    """(fp, group) of every distinct ``fp`` of ``fps``; group is the least fp reachable over links."""
    classes = cut_lineage(fps.select("fp").distinct())
    comp = connected_components(near_links(classes, classes.count(), distance, bucket, m))
    return classes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(
    docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, m: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` and ``component_id``, the smallest id reachable over links.

    Rows link if their fingerprints differ in at most ``distance`` bits. Texts
    without words (null, empty, blank) have fingerprint zero and link like any
    other. Rows link by their texts, not their ids: rows of one id may be in several
    groups, a row with a null id links like any other and takes the smallest id of
    its group (null if there is none). Repeated rows stay repeated; an empty table
    gives an empty result; other columns are ignored. Long texts are hashed in
    parts. Ids are integers.
    """
    fps = cut_lineage(fingerprints(docs, width, (id_col,), text_col).withColumnRenamed(id_col, "_id"))  # two longs a row
    groups = _grouped(fps, distance, bucket, m)
    low = fps.groupBy("fp").agg(F.min("_id").cast("bigint").alias("low")).join(groups, "fp")
    least = low.groupBy("group").agg(F.min("low").alias("component_id"))
    named = low.select("fp", "group").join(least, "group").select("fp", "component_id")
    return fps.join(named, "fp", "left").select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one_of_each(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, of equal ids the one with the least ``row_key``.

    Ids may be null (they come last) or repeated; equal rows count as one. No text
    is shuffled but of equal rows.
    """
    k = free("_k", docs.columns)
    a, b = row_key(docs)
    keyed = docs.withColumns({f"{k}1": a, f"{k}2": b})
    fps = cut_lineage(fingerprints(keyed, width, (id_col, f"{k}1", f"{k}2"), text_col).toDF("_id", "_k1", "_k2", "fp"))
    rows = fps.groupBy("fp", "_id", "_k1", "_k2").agg(F.count("*").alias("times")).join(_grouped(fps, distance, bucket), "fp")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_k1", "_k2")).alias("best"))
    judged = cut_lineage(rows.join(first, "group").select("_k1", "_k2", "times", ((F.col("best._k1") == F.col("_k1")) & (F.col("best._k2") == F.col("_k2"))).alias("stays")))
    kept = without_rows(docs, judged.where("NOT stays").select("_k1", "_k2"))
    repeated = judged.where("stays AND times > 1").select("_k1", "_k2")
    if repeated.isEmpty():
        return kept
    many = kept.withColumns({f"{k}1": a, f"{k}2": b})
    once = with_keys(many, repeated.toDF(f"{k}1", f"{k}2")).dropDuplicates([f"{k}1", f"{k}2"])
    return without_rows(kept, repeated).unionByName(once.drop(f"{k}1", f"{k}2"))


def op5_simhash(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the fingerprint in hexadecimal."""
    d = near_duplicates(docs)
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
