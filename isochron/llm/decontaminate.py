"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into windows (``window`` consecutive words; a shorter
item is one window). A window is the set of its word shingles, and a text that
contains the window contains all of them, so the necessary prefix is a single
shingle: the one rarest in the corpus. Windows holding a shingle the corpus lacks
are never joined.

Windows, shingles and prefixes are tables. A task leaves out the shingles of its
texts that a bitmap of fixed size shows not to be in the table; the others are
joined to the table by hash. The first pass over the texts counts documents for
each shingle, the second joins prefixes, with the words around the place. A pair
is kept if the window fits into the text there (length and position) and if all
its words are equal. A benchmark of any size goes the same way: a fuller bitmap
lets more shingles into the join, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from isochron.llm import words as W
from isochron.llm.rows import row_key, without_rows
from isochron.plans.runtime import cut_lineage

#: Bits of the bitmap that a task tests shingles against (a power of two): 4 MB.
FILTER_BITS = 1 << 25
#: Windows are broadcast up to this many (some 200 bytes each); more are joined by a shuffle that splits hot keys.
BROADCAST_WINDOWS = 200_000


def _item_words(texts: list[str | None]) -> list[list[bytes]]:
    out = []
    for t in texts:
        w = W.find_words([(t or "").encode()], W.NOT_ALNUM, True)
        low = w.buf.tobytes()
        out.append([low[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)])
    return out


def benchmark_windows(bench: DataFrame, window: int, shingle: int, item_col: str, item_text_col: str) -> DataFrame:
    """(item, words, size, shingle, hashes) of every window of every item: its words joined by blanks, how many, and the shingles' length and hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        for b in batches:
            for i in range(b.num_rows):
                raw = [(b.column(1)[i].as_py() or "").encode()]
                w = W.find_words(raw, W.NOT_ALNUM, True)
                n = len(w.starts)
                size = min(window, n)
                short = min(shingle, size)
                low, h = w.buf.tobytes(), hasher.words(w)
                ws = [low[x:y] for x, y in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
                g = W.grams(h, short).view(np.int64) if n else np.zeros(0, dtype=np.int64)
                count = n - size + 1 if n else 0
                for lo in range(0, count, 10_000):
                    at = range(lo, min(lo + 10_000, count))
                    cols = [pa.array([b.column(0)[i].as_py()] * len(at), pa.string()), pa.array([b" ".join(ws[k : k + size]).decode() for k in at])]
                    hashes = pa.array([g[k : k + size - short + 1] for k in at], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([size] * len(at), pa.int32()), pa.array([short] * len(at), pa.int32()), hashes], names=["item", "words", "size", "shingle", "hashes"])

    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    return items.mapInArrow(run, "item string, words string, size int, shingle int, hashes array<bigint>")


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits at the column ``h`` modulo ``bits``, as bytes; summed up in 64-bit cells, of which there are ``bits`` / 64 at most."""
    at = F.pmod("h", F.lit(bits))
    cells = hashes.select(F.floor(at / 64).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for batch in cells.toArrow().to_batches():
        out[batch["cell"].to_numpy()] = batch["bit"].to_numpy()
    return out.view(np.uint8)


def _maybe_in(table: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Positions in ``g`` whose bit is set."""
    at = g & np.uint64(8 * len(table) - 1)
    return np.flatnonzero(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def _grams_in_text(h: np.ndarray, w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each shingle that lies in one text."""
    g = W.grams(h, size)
    at = np.flatnonzero(w.text[: len(g)] == w.text[size - 1 :]) if len(g) else np.zeros(0, dtype=np.int64)
    return at, g[at]


def _document_counts(docs: DataFrame, text_col: str, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """(shingle, h, df): in how many texts each shingle is that passes the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        held: list[pa.Table] = []
        merged = lambda: pa.concat_tables(held).group_by(["shingle", "h"]).aggregate([("n", "sum")]).rename_columns(["shingle", "h", "n"])
        for batch in batches:
            for _, texts in W.chunks(batch.column(0)):
                w = W.find_words(texts, W.NOT_ALNUM, True)
                h = hasher.words(w)
                for size in sizes:
                    at, g = _grams_in_text(h, w, size)
                    hit = _maybe_in(table, g)
                    if len(hit):
                        pairs = np.unique(np.stack([g[hit], w.text[at[hit]].astype(np.uint64)]), axis=1)
                        held.append(pa.table({"shingle": pa.array(np.full(pairs.shape[1], size), pa.int32()), "h": pairs[0].view(np.int64), "n": np.ones(pairs.shape[1], dtype=np.int64)}))
            if sum(map(len, held)) > 1_000_000:
                held = [merged()]
                if len(held[0]) > 500_000:
                    yield from held[0].to_batches(100_000)
                    held = []
        if held:
            yield from merged().to_batches(100_000)

    counted = docs.select(text_col).mapInArrow(run, "shingle int, h bigint, n bigint")
    return counted.groupBy("shingle", "h").agg(F.sum("n").alias("df"))


_PLACES = "array<struct<shingle:int,h:bigint,pos:bigint,before:int,near:string>>"


def _places(docs: DataFrame, keep: list[str], table: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """The ``keep`` columns, n_words, and the shingles that pass the bitmap: word position, words before it in ``near``, the words around."""
    kinds = pa.struct([("shingle", pa.int32()), ("h", pa.int64()), ("pos", pa.int64()), ("before", pa.int32()), ("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, texts in W.chunks(batch.column(len(keep))):
                w = W.find_words(texts, W.NOT_ALNUM, True)
                n_words[first : first + len(texts)] = np.diff(w.first)
                h = hasher.words(w)
                low = None
                for size in sizes:
                    at, g = _grams_in_text(h, w, size)
                    hit = _maybe_in(table, g)
                    for p, x in zip(at[hit].tolist(), g[hit].view(np.int64).tolist(), strict=True):
                        t = int(w.text[p])
                        lo, hi = max(int(w.first[t]), p - window + 1), min(int(w.first[t + 1]), p + window)
                        low = low or w.buf.tobytes()
                        near = b" ".join(low[w.starts[k] : w.ends[k]] for k in range(lo, hi)).decode()
                        found[first + t].append({"shingle": size, "h": x, "pos": p - int(w.first[t]), "before": p - lo, "near": near})
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words), pa.array(found, pa.list_(kinds))], names=[*keep, "n_words", "places"])

    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{types}, n_words bigint, places {_PLACES}")


def _hits(
    docs: DataFrame, bench: DataFrame, keys: dict[str, Column], window: int, shingle: int, text_col: str, item_col: str, item_text_col: str, bits: int, broadcast: int
) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): the ``keys`` of every row of ``docs`` with _row and n_words; (_row, item, a, b) of every window found, words a to b."""
    windows = cut_lineage(benchmark_windows(bench, window, shingle, item_col, item_text_col))
    few = windows.count() <= broadcast
    shingles = windows.select("shingle", F.explode("hashes").alias("h")).distinct()
    sizes = [r[0] for r in windows.select("shingle").distinct().collect()]  # at most ``shingle`` lengths
    counts = _document_counts(docs, text_col, bitmap(shingles, bits), sizes)
    # of each distinct window the rarest shingle, the first of equally rare ones; a shingle no text has ends the window
    distinct = windows.select("words", "size", "shingle", "hashes").dropDuplicates(["words"])
    at = distinct.select("words", "size", "shingle", F.posexplode("hashes").alias("off", "h"))
    rare = at.join(counts, ["shingle", "h"], "left").groupBy("words", "size", "shingle")
    rare = rare.agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "h")).alias("x")).where("x.df > 0")
    prefixes = cut_lineage(rare.select("words", "size", "shingle", "x.off", "x.h"))
    names = [*keys]
    source = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text_col).alias("_text"))
    placed = _places(source, names, bitmap(prefixes, bits), sizes, window)
    placed = cut_lineage(placed.withColumn("_row", F.monotonically_increasing_id()))  # no text but the words around a hit
    small = lambda df: F.broadcast(df) if few else df
    met = placed.select("_row", F.explode("places").alias("p")).select("_row", "p.*").join(small(prefixes), ["shingle", "h"])
    near = F.split("near", " ")
    first = F.col("before") - F.col("off")
    fits = (first >= 0) & (first + F.col("size") <= F.size(near))
    same = F.array_join(F.slice(near, F.when(first >= 0, first + 1).otherwise(1), F.col("size")), " ") == F.col("words")
    start = F.col("pos") - F.col("off")
    found = met.where(fits).where(same).select("_row", "words", start.alias("a"), (start + F.col("size")).alias("b"))
    hits = found.join(small(windows.select("words", "item").distinct()), "words").select("_row", "item", "a", "b")
    return placed.drop("places"), hits


def mark_contamination(
    docs: DataFrame,
    bench: DataFrame,
    window: int = 10,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    filter_bits: int = FILTER_BITS,
    broadcast: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside an occurrence of a window), ``items`` (sorted ids).

    Words are runs of letters, digits and non-ASCII characters after lower-casing
    A-Z. Null and empty texts have no words; items without words have no window;
    an item with a null id marks words but is not named. Repeated rows of either
    table are allowed and judged each by itself, and either may be empty. A long
    text is taken alone, with some forty bytes for each of its characters. Other
    columns are ignored, whatever their names.
    """
    rows, hits = _hits(docs, bench, {"_id": F.col(id_col)}, window, shingle, text_col, item_col, item_text_col, filter_bits, broadcast)
    spans = hits.select("_row", "a", "b").distinct()
    ahead = Over.partitionBy("_row").orderBy("a", "b").rowsBetween(Over.unboundedPreceding, -1)
    fresh = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(ahead), F.lit(0))), F.lit(0))
    covered = spans.withColumn("n", fresh).groupBy("_row").agg(F.sum("n").cast("bigint").alias("n_hit"))
    named = hits.where("item IS NOT NULL").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(covered, "_row", "left").join(named, "_row", "left")
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def drop_contaminated(
    docs: DataFrame,
    bench: DataFrame,
    window: int = 10,
    shingle: int = 5,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    filter_bits: int = FILTER_BITS,
    broadcast: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item; each is judged by its own text, whatever its id."""
    a, b = row_key(docs)
    rows, hits = _hits(docs, bench, {"_k1": a, "_k2": b}, window, shingle, text_col, item_col, item_text_col, filter_bits, broadcast)
    return without_rows(docs, rows.join(hits.select("_row").distinct(), "_row", "left_semi").select("_k1", "_k2"))


def op4_decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Counts and the digest of the items found, from ``mark_contamination``."""
    m = mark_contamination(docs, bench)
    return m.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], bench: list[tuple[object, str | None]], window: int = 10) -> dict[int, tuple]:
    """The same result for (id, text) pairs by trying every window at every place."""
    items = [(None if k is None else str(k), ws) for (k, _), ws in zip(bench, _item_words([t for _, t in bench]), strict=True)]
    out = {}
    for doc_id, text in docs:
        ws = _item_words([text])[0]
        hit, names = set(), set()
        for name, item in items:
            size = min(window, len(item))
            for i in range(len(item) - size + 1 if item else 0):
                for p in range(len(ws) - size + 1):
                    if ws[p : p + size] == item[i : i + size]:
                        hit.update(range(p, p + size))
                        names.update({name} if name is not None else ())
        out[doc_id] = (len(ws), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out
