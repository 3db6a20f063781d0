"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are code points as they are, its n-grams runs of ORDER of
them, and its table has a row for every n-gram of the corpus, so it grows with
the input. The steps:

1. each task counts the n-grams of its texts, trusted ones by fold; the counts
   are summed in shards by n-gram;
2. order by order the counts are joined to their contexts' totals and to the
   next lower order (continuation counts), which gives log-probabilities;
3. a task scores the n-grams it finds among the HOT most frequent ones, a table
   whose size that parameter bounds, by itself; what is left of a document, one
   row per distinct n-gram, is joined to the sharded table by n-gram.

The split in step 3 moves no result: a frequent n-gram would otherwise be a hot
key in the join. A document is kept if its perplexity is at most a quantile of
those of the trusted documents of its language. The quantile is exact and taken
over perplexities that a model of the other half of the trusted documents gives,
as a model flatters the texts it has seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from isochron.plans.runtime import cut_lineage, ensure_checkpoint_dir

ORDER = 5
#: Most n-grams in the table that is shipped to the tasks (some 30 bytes each).
HOT = 1 << 18
#: Share of a language's trusted documents that its threshold lets pass.
QUANTILE = 0.995
#: Trusted ids are broadcast up to this many (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Thresholds are broadcast up to this many languages.
BROADCAST_LANGUAGES = 100_000
#: Characters that are taken together; a longer text goes in pieces.
RUN_CHARS = 1 << 21

#: The model of all trusted texts and those of either half.
MODELS = ("a", "f0", "f1")


def _stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: what checkpoint() does, but compressed by column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/grams-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Run:
    """Some texts, or a piece of one, as n-gram numbers over the characters that occur."""

    def __init__(self, pieces: list[tuple[int, str, str]], order: int) -> None:
        """Of each piece: the text it belongs to, the ``order - 1`` characters before it, its own."""
        self.order = order
        cp = np.frombuffer("".join(lead + t for _, lead, t in pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = np.zeros(0x110000, dtype=bool)
        seen[cp] = True
        self.chars = np.flatnonzero(seen).astype(np.uint32)
        place = np.zeros(0x110000, dtype=np.int64)
        place[self.chars] = np.arange(len(self.chars))
        s, n = place[cp], max(len(cp) - order + 1, 0)
        self.pairs = None
        if len(self.chars) ** order < 2**62:
            g = np.zeros(n, dtype=np.int64)
            for k in range(order):
                g = g * len(self.chars) + s[k : k + n]
        else:  # too many different characters: number the pairs that occur, of which a run has few enough
            two = s[:-1] * len(self.chars) + s[1:]
            self.pairs = np.unique(two)
            rank = np.searchsorted(self.pairs, two)
            g = np.zeros(n, dtype=np.int64)
            for k in range(0, order - 1, 2):
                g = g * len(self.pairs) + rank[k : k + n]
            if order % 2:
                g = g * len(self.chars) + s[order - 1 : order - 1 + n]
        size = np.array([len(t) for _, _, t in pieces], dtype=np.int64)
        whole = size + order - 1
        own = np.ones(n, dtype=bool)
        own[(np.cumsum(whole)[:-1, None] - order + 1 + np.arange(order - 1)).reshape(-1)] = False  # n-grams that reach into the next piece
        self.grams = g[own]
        self.text = np.repeat(np.array([i for i, _, _ in pieces], dtype=np.int64), size)

    def spell(self, grams: np.ndarray) -> pa.Array:
        """The n-grams of these numbers as strings."""
        cps = np.empty((len(grams), self.order), dtype="<u4")
        g, k = grams.copy(), self.order
        if self.pairs is None:
            while k:
                k -= 1
                g, r = np.divmod(g, len(self.chars))
                cps[:, k] = self.chars[r]
        else:
            if k % 2:
                k -= 1
                g, r = np.divmod(g, len(self.chars))
                cps[:, k] = self.chars[r]
            while k:
                k -= 2
                g, r = np.divmod(g, len(self.pairs))
                first, second = np.divmod(self.pairs[r], len(self.chars))
                cps[:, k], cps[:, k + 1] = self.chars[first], self.chars[second]
        raw = cps.tobytes().decode("utf-32-le", "surrogatepass")
        return pa.array([raw[i : i + self.order] for i in range(0, len(raw), self.order)], pa.string())

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """The numbers of n-grams given as rows of code points; -1 where a character or pair doesn't occur here."""
        at = np.minimum(np.searchsorted(self.chars, points), max(len(self.chars) - 1, 0))
        there = (self.chars[at] == points).all(axis=1) if len(self.chars) else np.zeros(len(points), dtype=bool)
        at = at.astype(np.int64)
        g = np.zeros(len(points), dtype=np.int64)
        if self.pairs is None:
            for k in range(self.order):
                g = g * len(self.chars) + at[:, k]
        else:
            for k in range(0, self.order - 1, 2):
                two = at[:, k] * len(self.chars) + at[:, k + 1]
                rank = np.minimum(np.searchsorted(self.pairs, two), len(self.pairs) - 1)
                there &= self.pairs[rank] == two
                g = g * len(self.pairs) + rank
            if self.order % 2:
                g = g * len(self.chars) + at[:, -1]
        return np.where(there, g, -1)


def _clean(text: str | None) -> str:
    return (text or "").replace("\0", "�")  # Arrow and NumPy strings both hold it, SQL engines may not


def runs(col: pa.Array, order: int, size: int = RUN_CHARS) -> Iterator[Run]:
    """The texts (null is empty; each starts after line breaks) in runs of about ``size`` characters."""
    held, total = [], 0
    for i, x in enumerate(col):
        t = _clean(x.as_py())
        for at in range(0, len(t), size):
            lead = "\n" * (order - 1) if at == 0 else t[at - order + 1 : at]
            piece = t[at : at + size]
            if held and total + len(piece) > size:
                yield Run(held, order)
                held, total = [], 0
            held.append((i, lead, piece))
            total += len(piece)
    if held:
        yield Run(held, order)


def count_grams(docs: DataFrame, order: int = ORDER, text_col: str = "text", fold_col: str = "_fold") -> DataFrame:
    """(g, n_a, n_f0, n_f1) of every n-gram of the corpus: occurrences in trusted texts, in all and by fold (null: not trusted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            summed = pa.concat_tables(held).group_by("g").aggregate([("n0", "sum"), ("n1", "sum")]).rename_columns(["g", "n0", "n1"])
            return summed.sort_by("g")  # neighbours alike, which a shuffle compresses well

        for b in batches:
            fold = np.nan_to_num(b.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=2).astype(np.int64)
            for r in runs(b.column(0), order):
                f = fold[r.text]
                u = np.unique(r.grams)
                n0, n1 = np.zeros(len(u), dtype=np.int64), np.zeros(len(u), dtype=np.int64)
                for k, n in ((0, n0), (1, n1)):
                    v, c = np.unique(r.grams[f == k], return_counts=True)
                    n[np.searchsorted(u, v)] = c
                held.append(pa.table({"g": r.spell(u), "n0": n0, "n1": n1}))
            if sum(map(len, held)) > 3_000_000:
                held = [merged()]
                if len(held[0]) > 1_500_000:  # as many as a task holds; the rest is summed in the shards
                    yield from held[0].to_batches(100_000)
                    held = []
        if held:
            yield from merged().to_batches(100_000)

    parts = docs.select(text_col, F.col(fold_col).cast("int").alias(fold_col)).mapInArrow(run, "g string, n0 bigint, n1 bigint")
    return parts.groupBy("g").agg(F.sum("n0").alias("n_f0"), F.sum("n1").alias("n_f1")).select("g", (F.col("n_f0") + F.col("n_f1")).alias("n_a"), "n_f0", "n_f1")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of one, two, and three or more, from how many n-grams have counts 1 to 4."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.9, 2.9), strict=True))


def _is(n: Column, k: int) -> Column:
    return F.sum((n >= 3 if k == 3 else n == k).cast("bigint"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, n_a, p_a, p_f0, p_f1) of every row of ``counts``: P(last character | the others) in each of MODELS.

    The highest order uses counts, lower orders the number of distinct characters
    before; each interpolates with the next lower one, the lowest with uniform over
    the characters of the corpus. A context without counts leaves it to the lower order.
    """
    first = counts.agg(*[F.sum((F.col(f"n_{m}") == k).cast("bigint")).alias(f"{m}{k}") for m in MODELS for k in (1, 2, 3, 4)]).first()
    d = {m: discounts(*[first[f"{m}{k}"] or 0 for k in (1, 2, 3, 4)]) for m in MODELS}
    n = {m: F.col(f"n_{m}") for m in MODELS}
    context = [x for m in MODELS for x in (F.sum(n[m]).alias(f"t_{m}"), *[_is(n[m], k).alias(f"s{k}_{m}") for k in (1, 2, 3)])]

    def interpolated(m: str, lower: Column) -> Column:
        c = n[m]
        off = F.when(c == 0, 0.0).when(c == 1, d[m][0]).when(c == 2, d[m][1]).otherwise(d[m][2])
        rest = sum((F.col(f"s{k}_{m}") * d[m][k - 1] for k in (1, 2, 3)), F.lit(0.0))
        return F.when(F.col(f"t_{m}") > 0, (c - off + rest * lower) / F.col(f"t_{m}")).otherwise(lower).alias(f"p_{m}")

    if order == 1:  # a row for each character: at most as many as there are code points
        whole = counts.agg(*context, F.count("*").alias("size"))
        return counts.crossJoin(F.broadcast(whole)).select("g", "n_a", *[interpolated(m, 1.0 / F.col("size")) for m in MODELS])
    tail, head = F.substring("g", 2, order - 1), F.substring("g", 1, order - 1)
    below = counts.groupBy(tail.alias("g")).agg(*[F.sum((n[m] > 0).cast("bigint")).alias(f"n_{m}") for m in MODELS])
    lower = kneser_ney(_stored(below), order - 1).select(F.col("g").alias("_tail"), *[F.col(f"p_{m}").alias(f"l_{m}") for m in MODELS])
    contexts = counts.groupBy(head.alias("_head")).agg(*context)
    joined = counts.join(contexts, head == F.col("_head")).join(lower, tail == F.col("_tail"))
    return joined.select("g", "n_a", *[interpolated(m, F.col(f"l_{m}")) for m in MODELS])


_SCORED = "n_scored bigint, s_own double, s_held double, cold array<struct<g:string,n:int>>"


def perplexities(docs: DataFrame, model: DataFrame, keep: tuple[str, ...], order: int = ORDER, hot: int = HOT, text_col: str = "text", fold_col: str = "_fold") -> DataFrame:
    """The ``keep`` columns, n_scored (characters), perplexity and held_out of every row; null without characters.

    held_out is the perplexity under the half that a trusted row isn't in, for
    other rows that under all. ``hot`` n-grams are shipped; 0 joins all of them.
    """
    logs = model.select("g", "n_a", *[F.log(f"p_{m}").alias(m) for m in MODELS])
    top = logs.where("n_a > 0").orderBy(F.desc("n_a"), "g").limit(hot).toArrow() if hot else None  # at most ``hot`` rows
    names = top["g"].to_pylist() if top is not None else []
    points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, order) if names else np.zeros((0, order), dtype="<u4")
    table = np.array([top[m].to_numpy() for m in MODELS]) if names else np.zeros((3, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.num_rows
            fold = np.nan_to_num(b.column(len(keep) + 1).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
            other = np.where(fold < 0, 0, 2 - fold)  # the model that hasn't seen the row
            n, own, held = np.zeros(size, dtype=np.int64), np.zeros(size), np.zeros(size)
            texts, spelt, counts = [], [], []
            for r in runs(b.column(len(keep)), order):
                n += np.bincount(r.text, minlength=size)
                number = r.numbers(points)
                by = np.argsort(number, kind="stable")
                by = by[np.searchsorted(number[by], 0) :]
                known = number[by]
                at = np.minimum(np.searchsorted(known, r.grams), max(len(known) - 1, 0))
                hit = known[at] == r.grams if len(known) else np.zeros(len(r.grams), dtype=bool)
                which, text = by[at[hit]] if len(known) else np.zeros(0, dtype=np.int64), r.text[hit]
                own += np.bincount(text, table[0][which], minlength=size)
                held += np.bincount(text, table[other[text], which], minlength=size)
                left, text = r.grams[~hit], r.text[~hit]
                if len(left):
                    u, inv = np.unique(left, return_inverse=True)
                    pairs, c = np.unique(text * len(u) + inv, return_counts=True)
                    texts.append(pairs // len(u))
                    spelt.append(r.spell(u).take(pa.array(pairs % len(u))))
                    counts.append(c)
            t = np.concatenate([np.zeros(0, dtype=np.int64), *texts])
            order_by = np.argsort(t, kind="stable")
            g = pa.concat_arrays(spelt).take(pa.array(order_by)) if spelt else pa.array([], pa.string())
            c = np.concatenate([np.zeros(0, dtype=np.int64), *counts])[order_by].astype(np.int32)
            offsets = np.searchsorted(t[order_by], np.arange(size + 1)).astype(np.int32)
            cold = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([g, pa.array(c)], ["g", "n"]))
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fold), pa.array(n), pa.array(own), pa.array(held), cold], names=[*keep, "_f", "n_scored", "s_own", "s_held", "cold"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    part = docs.select(*keep, text_col, F.col(fold_col).cast("int").alias(fold_col)).mapInArrow(run, f"{types}, _f bigint, {_SCORED}")
    # the row's number and, in its last two bits, the model that scores it held out
    part = _stored(part.withColumn("_row", F.monotonically_increasing_id() * 4 + F.col("_f") + 1).drop("_f"))
    rows = part.select("_row", F.explode("cold").alias("c")).select("_row", "c.g", "c.n")
    met = rows.join(logs.drop("n_a"), "g")
    theirs = F.when(F.col("_row") % 4 == 1, F.col("f1")).when(F.col("_row") % 4 == 2, F.col("f0")).otherwise(F.col("a"))
    sums = met.groupBy("_row").agg(F.sum(F.col("n") * F.col("a")).alias("c_own"), F.sum(F.col("n") * theirs).alias("c_held"))
    out = part.drop("cold").join(sums, "_row", "left")
    mean = lambda s, c: F.when(F.col("n_scored") > 0, F.exp(-(F.col(s) + F.coalesce(c, F.lit(0.0))) / F.col("n_scored")))
    return out.select(*keep, "n_scored", mean("s_own", "c_own").alias("perplexity"), mean("s_held", "c_held").alias("held_out"))


def exact_quantile(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, quantile): the least value that a share ``q`` of a group's values do not exceed.

    A histogram finds the bin that holds it, and only that bin's distinct values
    are ranked; ties are counted, not listed. Values are positive.
    """
    binned = rows.select(F.col(group).alias("_g"), F.col(value).alias("_v"), F.floor(F.log(value) * 4096).alias("_bin")).groupBy("_g", "_bin", "_v").agg(F.count("*").alias("n"))
    bins = binned.groupBy("_g", "_bin").agg(F.sum("n").alias("n"))
    whole = Over.partitionBy("_g")
    upto = whole.orderBy("_bin").rowsBetween(Over.unboundedPreceding, Over.currentRow)
    bins = bins.select("_g", "_bin", F.sum("n").over(upto).alias("_upto"), (F.sum("n").over(upto) - F.col("n")).alias("_before"), F.ceil(F.sum("n").over(whole) * F.lit(q)).alias("_rank"))
    right = bins.where("_before < _rank AND _rank <= _upto").select("_g", "_bin", (F.col("_rank") - F.col("_before")).alias("_rank"))
    inside = binned.join(right, ["_g", "_bin"])
    ranked = inside.withColumn("_upto", F.sum("n").over(whole.orderBy("_v").rowsBetween(Over.unboundedPreceding, Over.currentRow)))
    return ranked.where("_upto >= _rank").groupBy(F.col("_g").alias(group)).agg(F.min("_v").alias("quantile"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_scored, perplexity, threshold, kept.

    ``trusted`` has the doc_id of the texts to learn from, all of them used. A null
    language is one of its own; a language without trusted documents takes the
    threshold of all of them; without any trusted document every scored text is
    kept. Null and empty texts have no perplexity and are not kept. Texts of any
    length go in pieces of RUN_CHARS characters, so memory follows the piece and
    the distinct n-grams of a batch. Rows with the same id are judged each by its
    own text; an empty table gives an empty result; other columns are ignored.
    """
    ids = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    marked = ids.withColumn("_own", F.lit(True))
    marked = F.broadcast(marked) if few else marked.hint("shuffle_hash")
    folded = docs.select("doc_id", "lang", "text").join(marked, F.col("doc_id") == F.col("_id"), "left")
    folded = folded.select("doc_id", "lang", "text", F.when(F.col("_own"), F.pmod(F.xxhash64("doc_id"), F.lit(2))).alias("_fold"))
    model = _stored(kneser_ney(_stored(count_grams(folded, order)), order))
    scored = perplexities(folded.withColumn("_trusted", F.col("_fold").isNotNull()), model, ("doc_id", "lang", "_trusted"), order, hot)
    scored = cut_lineage(scored)  # a few numbers a row
    good = scored.where("_trusted AND perplexity IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("_lang"), "held_out")
    by_lang = cut_lineage(exact_quantile(good, "_lang", "held_out", quantile)).withColumnRenamed("quantile", "_own")
    if by_lang.count() <= BROADCAST_LANGUAGES:  # else a join that can split a frequent language
        by_lang = F.broadcast(by_lang)
    overall = exact_quantile(good.withColumn("_lang", F.lit("")), "_lang", "held_out", quantile).first()
    out = scored.join(by_lang, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
    threshold = F.coalesce("_own", F.lit(overall["quantile"] if overall else inf).cast("double"))
    return out.select("doc_id", "lang", "n_scored", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))


def op6_quality_lm(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels.where("quality = 1"))


def brute_force(docs: list[tuple[str | None, bool | int | None]], order: int = ORDER) -> list[tuple[float | None, float | None]]:
    """(perplexity, held_out) of (text, fold or None) rows, with dictionaries and no shortcut."""
    lead = "\n" * (order - 1)
    grams = [[(lead + _clean(t))[i : i + order] for i in range(len(_clean(t)))] for t, _ in docs]
    alphabet = {g[-1] for gs in grams for g in gs}

    def model(folds: set[int]):
        level: dict[str, int] = {}
        for gs, (_, f) in zip(grams, docs, strict=True):
            if f in folds:
                for g in gs:
                    level[g] = level.get(g, 0) + 1
        levels = [level]
        for _ in range(order - 1):
            below: dict[str, int] = {}
            for g in levels[-1]:
                below[g[1:]] = below.get(g[1:], 0) + 1
            levels.append(below)
        cuts = [discounts(*[sum(c == k for c in lv.values()) for k in (1, 2, 3, 4)]) for lv in levels]
        follow: list[dict[str, list[int]]] = []
        for lv in levels:
            by: dict[str, list[int]] = {}
            for g, c in lv.items():
                by.setdefault(g[:-1], []).append(c)
            follow.append(by)

        def p(g: str, k: int) -> float:
            lower = p(g[1:], k + 1) if k + 1 < order else 1 / len(alphabet)
            seen = follow[k].get(g[:-1])
            if not seen:
                return lower
            d = (0.0, *cuts[k])
            c = levels[k].get(g, 0)
            return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in seen) * lower) / sum(seen)

        return lambda gs: np.exp(-sum(log(p(g, 0)) for g in gs) / len(gs)) if gs else None

    all_, halves = model({0, 1}), (model({0}), model({1}))
    return [(all_(gs), (all_ if f is None else halves[1 - f])(gs)) for gs, (_, f) in zip(grams, docs, strict=True)]
