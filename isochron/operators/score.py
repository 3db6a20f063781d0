"""How well a build follows drawn reference lines, and how much of its inputs a group keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.functions import names
from isochron.operators import coverage, lines, spatial
from isochron.plans.runtime import cut_lineage


@dataclass(frozen=True)
class ScoreConfig:
    """Distances in metres, angles in degrees, shares in percent."""

    step: float = 5.0
    hole: float = 120.0
    near: float = 25.0
    doubled: float = 12.0
    apart: float = 3.0
    corridor: float = 30.0
    fail_p90: float = 15.0
    fail_cover: float = 95.0
    fail_wobble: float = 12.0
    fail_turn: float = 40.0
    fail_spikes: float = 1.0
    spike: float = 25.0
    fail_doubled: float = 8.0


def forward(drawn: DataFrame, colors: DataFrame, feats: DataFrame, routes: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """One row a drawn line: km, mean, p90, worst, cover_pct, color_pct, doubled_pct, worst_x, worst_y, fail.

    ``drawn`` (line, seq, x, y), ``colors`` (line, color) of its routes, ``feats``
    (feat, seq, x, y), ``routes`` (feat, color, routes) of the features.
    """
    samples = cut_lineage(lines.resample(drawn, ["line"], cfg.step).select("line", "i", "x", "y"))
    length = lines.arc_length(drawn, ["line"]).groupBy("line").agg(F.max("arc").alias("length")).where("length >= 1")
    samples = samples.join(length, "line", "left_semi")
    segs = lines.segments(lines.densify(feats, ["feat"], cfg.hole).withColumn("seq", F.struct("seq", "k")), ["feat"])
    pairs = spatial.near_segments(samples, segs, cfg.hole)
    foot = lambda a, b: F.col(a) + F.col("t") * (F.col(b) - F.col(a))
    pairs = pairs.withColumns({"fx": foot("ax_r", "bx_r"), "fy": foot("ay_r", "by_r")})
    per = pairs.groupBy("line", "i", F.col("feat_r").alias("feat")).agg(F.min("dist").alias("dist"), F.min_by(F.struct("fx", "fy"), "dist").alias("foot"))
    per = cut_lineage(per.join(routes, "feat"))
    best = per.groupBy("line", "i").agg(F.min("dist").alias("dist"), F.min_by("color", F.struct("dist", "feat")).alias("color"))
    close = per.where(F.col("dist") < cfg.doubled)
    a, b = close.select("line", "i", "feat", "routes", "foot"), close.select("line", "i", F.col("feat").alias("feat_b"), F.col("routes").alias("routes_b"), F.col("foot").alias("foot_b"))
    apart = F.hypot(F.col("foot.fx") - F.col("foot_b.fx"), F.col("foot.fy") - F.col("foot_b.fy")) > cfg.apart
    twice = a.join(b, ["line", "i"]).where((F.col("feat") < F.col("feat_b")) & F.arrays_overlap("routes", "routes_b") & apart).select("line", "i").distinct().withColumn("_twice", F.lit(1))
    own = colors.select("line", F.upper(names.text_color(F.col("color"))).alias("_c")).groupBy("line").agg(F.collect_set("_c").alias("_own"))
    s = samples.join(best, ["line", "i"], "left").join(twice, ["line", "i"], "left").join(own, "line", "left")
    s = s.withColumn("dist", F.coalesce("dist", F.lit(cfg.hole))).withColumn("_match", F.coalesce(F.array_contains("_own", F.upper(names.text_color(F.col("color")))), F.lit(False)))
    pct = lambda c: 100 * F.avg(c.cast("double"))
    g = s.groupBy("line").agg(
        F.avg("dist").alias("mean"), coverage.floor_quantile(F.collect_list("dist"), 0.9).alias("p90"), F.max("dist").alias("worst"),
        pct((F.col("dist") <= cfg.near).cast("int")).alias("cover_pct"), pct(F.col("_match").cast("int")).alias("color_pct"), pct(F.coalesce("_twice", F.lit(0))).alias("doubled_pct"),
        F.max_by(F.struct("x", "y"), F.struct("dist", -F.col("i"))).alias("_w"),
    )
    fail = (F.col("p90") > cfg.fail_p90) | (F.col("cover_pct") < cfg.fail_cover) | (F.col("doubled_pct") > cfg.fail_doubled)
    return g.join(length, "line").select(
        "line", (F.col("length") / 1000).alias("km"), "mean", "p90", "worst", "cover_pct", "color_pct", "doubled_pct", F.col("_w.x").alias("worst_x"), F.col("_w.y").alias("worst_y"), fail.alias("fail")
    )


def reverse(drawn: DataFrame, feats: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """One row: wobble_mean, wobble_p90, max_turn, spikes, km, spikes_per_km over features whose middle is on a drawn line."""
    segs = cut_lineage(lines.segments(lines.densify(drawn, ["line"], 2 * cfg.corridor).withColumn("seq", F.struct("seq", "k")), ["line"]))
    arc = lines.arc_length(feats, ["feat"])
    size = arc.groupBy("feat").agg(F.max("arc").alias("length"))
    half = lines.resample(feats.join(size.where("length > 0"), "feat", "left_semi"), ["feat"], 8.0)
    middle = half.join(size, "feat").groupBy("feat").agg(F.min_by(F.struct("x", "y"), F.abs(F.col("arc") - F.col("length") / 2)).alias("m")).select("feat", "m.x", "m.y")
    on = cut_lineage(spatial.near_segments(middle, segs, cfg.corridor).select("feat").distinct())
    samples = half.join(on, "feat", "left_semi")
    wob = spatial.near_segments(samples, segs, 2 * cfg.corridor).groupBy("feat", "i").agg(F.min("dist").alias("d"))
    w = wob.agg(F.avg("d").alias("wobble_mean"), F.count("*").alias("_n"))
    ranked = _p90(wob)
    long = size.where("length >= 24").join(on, "feat", "left_semi")
    twelve = lines.resample(feats.join(long, "feat", "left_semi"), ["feat"], 12.0).select("feat", F.col("i").alias("seq"), "x", "y")
    t = lines.turns(twelve, ["feat"])
    jag = t.agg(F.max("turn").alias("max_turn"), F.coalesce(F.sum((F.col("turn") > cfg.spike).cast("int")), F.lit(0)).alias("spikes"))
    km = long.agg((F.coalesce(F.sum("length"), F.lit(0.0)) / 1000).alias("km"))
    # four one-row tables
    return w.drop("_n").crossJoin(ranked).crossJoin(jag).crossJoin(km).withColumn("spikes_per_km", F.when(F.col("km") > 0, F.col("spikes") / F.col("km")).otherwise(0.0))


def _p90(wob: DataFrame) -> DataFrame:
    """The floor-indexed 90 % value over all rows, from running counts by value."""
    from isochron.operators.ranking import running_total

    counts = wob.groupBy("d").agg(F.count("*").alias("n"))
    total = wob.count()
    at = int(0.9 * (total - 1)) if total else 0
    placed = running_total(counts, ["d"], "n")
    return placed.where((F.col("total_before") <= at) & (F.col("total_before") + F.col("n") > at)).agg(F.min("d").alias("wobble_p90"))


def spikes(feats: DataFrame, least: float = 25.0, top: int = 6) -> DataFrame:
    """The ``top`` sharpest turns at a uniform 12 m scale: a report."""
    twelve = lines.resample(feats, ["feat"], 12.0).select("feat", F.col("i").alias("seq"), "x", "y")
    return lines.turns(twelve, ["feat"]).where(F.col("turn") > least).select("feat", "seq", "x", "y", "turn").orderBy(F.desc("turn"), "feat", "seq").limit(top)


def failures(fwd: DataFrame, rev: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """One row: how many gates failed."""
    a = fwd.agg(F.coalesce(F.sum(F.col("fail").cast("int")), F.lit(0)).alias("a"))
    jag = (F.coalesce(F.col("max_turn"), F.lit(0.0)) > cfg.fail_turn) | (F.col("spikes_per_km") > cfg.fail_spikes)
    b = rev.select((jag.cast("int") + F.coalesce((F.col("wobble_p90") > cfg.fail_wobble).cast("int"), F.lit(0))).alias("b"))
    return a.crossJoin(b).select((F.col("a") + F.col("b")).alias("failures"))


def retention(member: DataFrame, group: DataFrame, step: float = 25.0, reach: float = 30.0, least: float = 0.90) -> DataFrame:
    """(feed, samples, hits, share, ok): share of each member's ink (feed, line, seq, x, y) within reach of the group's (line, seq, x, y)."""
    samples = lines.resample(member, ["feed", "line"], step)
    segs = lines.segments(lines.densify(group, ["line"], 4 * reach).withColumn("seq", F.struct("seq", "k")), ["line"])
    out = spatial.coverage_share(samples, segs, reach, ["feed"], ["feed", "line", "i"])
    return out.withColumn("ok", F.col("share") >= least)


def centering_audit(built: DataFrame, track: DataFrame, step: float = 10.0, reach: float = 25.0, gap: float = 4.5) -> DataFrame:
    """(line, samples, mean_error, worst, strands): how far built lines (line, seq, x, y) are from the median of the track (track, seq, x, y) beside them.

    ``strands`` counts samples by how many strands they see; samples that see none are left out.
    """
    from isochron.functions import geo

    samples = lines.tangents(lines.resample(built, ["line"], step), ["line"]).where("tx IS NOT NULL")
    segs = lines.segments(lines.densify(track, ["track"], 4 * reach).withColumn("seq", F.struct("seq", "k")), ["track"])
    seen = lines.strand_clusters(lines.cross_sections(samples, segs, reach).select("line", "i", "offset"), ["line", "i"], gap)
    err = seen.withColumn("err", F.abs(geo.median_strand(F.col("strands")))).withColumn("n", F.size("strands"))
    hist = err.groupBy("line", "n").agg(F.count("*").alias("c")).groupBy("line").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "c")))).alias("strands"))
    return err.groupBy("line").agg(F.count("*").alias("samples"), F.avg("err").alias("mean_error"), F.max("err").alias("worst")).join(hist, "line")
