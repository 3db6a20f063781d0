"""Schedule feeds as string tables: a folder, a zip, or texts held in memory.

All tables come out with the wanted columns as trimmed strings, "" where a cell
or column is missing; typed readings use ``try_cast`` so that a bad number drops
or nulls a row as the operator decides, and never fails the query.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the schedule format that are read.
TABLES: dict[str, tuple[str, ...]] = {
    "agency": ("agency_id", "agency_name"),
    "routes": ("route_id", "route_short_name", "route_long_name", "route_color", "route_text_color", "agency_id", "route_type", "route_sort_order"),
    "stops": ("stop_id", "stop_name", "parent_station", "stop_lat", "stop_lon"),
    "transfers": ("from_stop_id", "to_stop_id", "transfer_type"),
    "trips": ("route_id", "shape_id", "trip_id", "service_id"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"),
    "shapes": ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "frequencies": ("trip_id", "start_time", "end_time"),
}


class FeedError(ValueError):
    """A feed that can't be read: nothing there, or a required table missing."""


def _schema(cols: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` string" for c in cols)


def _parse(lines: Iterator[str], cols: tuple[str, ...], strict: bool) -> Iterator[tuple[str, ...]]:
    rows = csv.reader(lines)
    header = [h.strip() for h in next(rows, [])]
    if header:
        header[0] = header[0].lstrip("﻿")
    at = {h: i for i, h in enumerate(header)}  # of equal names the last
    if not strict:
        at = {h: i for i, h in reversed(list(enumerate(header)))}
    where = [at.get(c, -1) for c in cols]
    for r in rows:
        if not r or strict and len(r) < len(header):
            continue
        yield tuple(r[i].strip() if 0 <= i < len(r) else "" for i in where)


@dataclass
class Feed:
    """Tables by name (without ``.txt``); ``table`` gives one as a DataFrame of strings."""

    spark: SparkSession
    path: str = ""
    kind: str = "folder"  # folder, zip, inline or frames
    names: frozenset[str] = frozenset()
    texts: Mapping[str, str] = field(default_factory=dict)
    strict: bool = False
    frames: Mapping[str, DataFrame] = field(default_factory=dict)

    def has(self, name: str) -> bool:
        return name in self.names

    def need(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FeedError(f"{self.path or 'inline feed'} has no {name}.txt")
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        """The wanted columns of a table; no rows if it is absent."""
        cols = TABLES[name]
        if not self.has(name):
            return self.spark.createDataFrame([], _schema(cols))
        if self.kind == "inline":
            return self.spark.createDataFrame(list(_parse(io.StringIO(self.texts[name]), cols, self.strict)), _schema(cols))
        if self.kind == "frames":
            df = self.frames[name]
            return df.select(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in cols])
        if self.kind == "zip":
            return self._unzipped(name, cols)
        return self._read(name, cols)

    def _read(self, name: str, cols: tuple[str, ...]) -> DataFrame:
        path = f"{self.path}/{name}.txt"
        first = self.spark.read.text(path).limit(1).collect()
        header = [h.strip().lstrip("﻿") for h in next(csv.reader([first[0][0]]), [])] if first else []
        if not header:
            return self.spark.createDataFrame([], _schema(cols))
        names = [f"{i}:{h}" for i, h in enumerate(header)]
        df = self.spark.read.csv(
            path, schema=_schema(tuple(names)), header=True, enforceSchema=True, mode="PERMISSIVE",
            ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, quote='"', escape='"', multiLine=False,
        )
        order = list(enumerate(header)) if self.strict else list(reversed(list(enumerate(header))))
        at = {h: names[i] for i, h in order}
        if self.strict:
            df = df.where(F.col(f"`{names[-1]}`").isNotNull())
        return df.select(*[F.coalesce(F.trim(F.col(f"`{at[c]}`")), F.lit("")).alias(c) if c in at else F.lit("").alias(c) for c in cols])

    def _unzipped(self, name: str, cols: tuple[str, ...]) -> DataFrame:
        strict = self.strict

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content in b.column(0):
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        member = _members(z.namelist())[name]
                        held: list[tuple[str, ...]] = []
                        with z.open(member) as f:
                            for row in _parse(io.TextIOWrapper(f, "utf-8-sig", errors="replace", newline=""), cols, strict):
                                held.append(row)
                                if len(held) == 50_000:
                                    yield _batch(held, cols)
                                    held = []
                        if held:
                            yield _batch(held, cols)

        # One task unpacks a member, which zip demands; what follows can be repartitioned.
        return self.spark.read.format("binaryFile").load(self.path).select("content").mapInArrow(run, _schema(cols))


def _batch(rows: list[tuple[str, ...]], cols: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=list(cols))


def _members(names: list[str]) -> dict[str, str]:
    """Table -> member; a member at the top wins over one in a folder."""
    out: dict[str, str] = {}
    for full in sorted(names, key=lambda n: n.count("/")):
        base = full.rsplit("/", 1)[-1]
        if base.endswith(".txt"):
            out.setdefault(base[:-4], full)
    return out


def open_feed(spark: SparkSession, source: str | Mapping[str, str | DataFrame], strict: bool = False) -> Feed:
    """A feed from a folder, a ``.zip`` or a mapping from table name (``.txt`` optional) to CSV text, or to a DataFrame."""
    if not isinstance(source, str):
        if any(isinstance(v, DataFrame) for v in source.values()):
            frames = {k.removesuffix(".txt"): v for k, v in source.items()}
            return Feed(spark, "", "frames", frozenset(frames), {}, strict, frames)
        texts = {k.removesuffix(".txt"): v for k, v in source.items()}
        if "routes" not in texts:
            raise FeedError(f"inline feed needs routes.txt; it has {', '.join(sorted(texts)) or 'nothing'}")
        return Feed(spark, "", "inline", frozenset(texts), texts, strict)
    if source.endswith(".zip"):
        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content in b.column(0):
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        yield _batch([(n,) for n in _members(z.namelist())] or [("",)], ("name",))

        found = spark.read.format("binaryFile").load(source).select("content").mapInArrow(names, "name string").collect()
        have = frozenset(r[0] for r in found) - {""}
    else:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(source).select("path").collect()
        have = frozenset(r[0].rsplit("/", 1)[-1][:-4] for r in listed)
    if not have:
        raise FeedError(f"{source} holds no tables")
    return Feed(spark, source.rstrip("/"), "zip" if source.endswith(".zip") else "folder", have, {}, strict)


def routes(feed: Feed, prefix: str = "") -> DataFrame:
    """Typed routes; a sole agency fills in where a route names none."""
    r = feed.need("routes")
    agencies = feed.table("agency").select(F.when(F.col("agency_id") != "", F.col("agency_id")).otherwise(F.col("agency_name")).alias("a")).distinct()
    sole = agencies.agg(F.when(F.count("*") == 1, F.min("a")).otherwise("").alias("sole"))
    p = F.lit(prefix)
    own = F.when(F.col("agency_id") != "", F.col("agency_id")).otherwise(F.col("sole"))
    return r.crossJoin(F.broadcast(sole)).select(  # one row
        F.concat(p, "route_id").alias("route_id"),
        F.col("route_short_name").alias("short_name"),
        F.col("route_long_name").alias("long_name"),
        F.col("route_color").alias("color"),
        F.col("route_text_color").alias("text_color"),
        F.coalesce(F.col("route_type").try_cast("int"), F.lit(0)).alias("route_type"),
        F.when(own != "", F.concat(p, own)).otherwise("").alias("agency"),
        F.coalesce(F.col("route_sort_order").try_cast("int"), F.lit(-1)).alias("sort_order"),
    )


def stops(feed: Feed, prefix: str = "") -> DataFrame:
    """Typed stops; rows without numeric coordinates are dropped."""
    p = F.lit(prefix)
    return (
        feed.table("stops")
        .select(
            F.concat(p, "stop_id").alias("stop_id"),
            F.col("stop_name").alias("name"),
            F.col("stop_lon").try_cast("double").alias("lon"),
            F.col("stop_lat").try_cast("double").alias("lat"),
            F.when(F.col("parent_station") != "", F.concat(p, "parent_station")).otherwise("").alias("parent"),
        )
        .where("lon IS NOT NULL AND lat IS NOT NULL")
    )


def transfers(feed: Feed, prefix: str = "") -> DataFrame:
    """Stop pairs that can be walked (type 3 means they can't)."""
    p = F.lit(prefix)
    return feed.table("transfers").where("transfer_type <> '3'").select(F.concat(p, "from_stop_id").alias("from_stop"), F.concat(p, "to_stop_id").alias("to_stop"))


def shape_points(feed: Feed) -> DataFrame:
    """(shape_id, seq, lon, lat) with numeric values only."""
    return (
        feed.table("shapes")
        .select("shape_id", F.col("shape_pt_sequence").try_cast("int").alias("seq"), F.col("shape_pt_lon").try_cast("double").alias("lon"), F.col("shape_pt_lat").try_cast("double").alias("lat"))
        .where("seq IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    )


def rail_shapes(feed: Feed, keep: Column) -> DataFrame:
    """(shape_id, points ordered by (seq, lon, lat)) of shapes that trips of the kept routes use; ``keep`` is over ``routes``."""
    used = feed.need("trips").where("shape_id <> ''").join(routes(feed).where(keep).select("route_id"), "route_id", "left_semi").select("shape_id").distinct()
    pts = shape_points(feed).join(used, "shape_id", "left_semi").groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("points"))
    return pts.where(F.size("points") > 1)


def subset_by_agency(feed: Feed, agencies: list[str]) -> dict[str, DataFrame]:
    """The rows of every table that the routes of some agencies need: semi joins down the keys, parents of stops kept."""
    out = {"agency": feed.table("agency").where(F.col("agency_id").isin(agencies)), "routes": feed.need("routes").where(F.col("agency_id").isin(agencies))}
    semi = lambda name, by, key: feed.table(name).join(by.select(key).distinct(), key, "left_semi")
    out["trips"] = semi("trips", out["routes"], "route_id")
    out["stop_times"] = semi("stop_times", out["trips"], "trip_id")
    out["frequencies"] = semi("frequencies", out["trips"], "trip_id")
    out["shapes"] = semi("shapes", out["trips"], "shape_id")
    out["calendar"] = semi("calendar", out["trips"], "service_id")
    out["calendar_dates"] = semi("calendar_dates", out["trips"], "service_id")
    used = semi("stops", out["stop_times"], "stop_id")
    parents = feed.table("stops").join(used.select(F.col("parent_station").alias("stop_id")).where("stop_id <> ''").distinct(), "stop_id", "left_semi")
    out["stops"] = used.unionByName(parents).dropDuplicates(["stop_id"])
    both = out["stops"].select("stop_id")
    out["transfers"] = feed.table("transfers").join(both.withColumnRenamed("stop_id", "from_stop_id"), "from_stop_id", "left_semi").join(both.withColumnRenamed("stop_id", "to_stop_id"), "to_stop_id", "left_semi")
    out = {name: df.select(*TABLES[name]) for name, df in out.items()}
    return out
