"""URL rules as intervals over reversed-host keys, applied by one sorted sweep.

The canonical key of a host is its labels in reverse order, each closed by a dot
(``blog.example.net`` -> ``net.example.blog.``). A rule for a host fits it and all
its subdomains, which is exactly the keys with the rule's key as prefix: the
interval [``net.``, ``net/``) since ``/`` follows ``.`` in byte order. Intervals of
this kind nest or are disjoint, so a sweep over sorted keys needs one stack of
the rules that are open. URLs are range-partitioned on (key, path, id), which
splits a host of any size over several tasks. A task enters the rules where its
first key lies and keeps its place and its stack from batch to batch. More rules
than a task should hold go in parts, one sweep after another over the same sorted
rows, each keeping the better rule.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import batched
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.rows import column

#: Rules shipped with one sweep (some 200 bytes each).
PART_RULES = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``action`` for urls of ``host`` or below it whose path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #``, ASCII letters lower-cased; "" for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?`` or ``#``; "" for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _intervals(rules: Iterable[Rule]) -> list[tuple[str, str, Rule]]:
    out = []
    for r in rules:
        start = ".".join(reversed(r.host.split("."))) + "."
        out.append((start, start[:-1] + "/", r))
    return sorted(out, key=lambda x: (x[0], x[2].path))


def _better(rule: Rule | None, best: Rule | None) -> bool:
    """The longer text wins, then the longer host, then the later path, then block."""
    rank = lambda r: (len(r.text), len(r.host), r.path, r.action)
    return rule is not None and (best is None or rank(rule) > rank(best))


class Sweep:
    """The rules that are open at a key, while keys ascend."""

    def __init__(self, spans: list[tuple[str, str, Rule]]) -> None:
        self.spans, self.starts = spans, [x[0] for x in spans]
        self.stack: list[tuple[str, Rule]] = []
        self.next, self.key = 0, None

    def _enter(self, key: str) -> None:
        """Take the place of ``key``: the rules that hold it begin at its prefixes."""
        self.stack = []
        at = key.find(".")
        while at >= 0:
            start = key[: at + 1]
            for i in range(bisect_left(self.starts, start), bisect_right(self.starts, start)):
                self.stack.append((self.spans[i][1], self.spans[i][2]))
            at = key.find(".", at + 1)
        self.next = bisect_right(self.starts, key)

    def best(self, key: str, path: str) -> Rule | None:
        """The longest fitting rule of (key, path)."""
        if self.key is None or key < self.key:
            self._enter(key)
        elif key != self.key:
            while self.next < len(self.spans) and self.starts[self.next] <= key:
                start, end, rule = self.spans[self.next]
                while self.stack and self.stack[-1][0] <= start:
                    self.stack.pop()
                if key < end:
                    self.stack.append((end, rule))
                self.next += 1
            while self.stack and self.stack[-1][0] <= key:
                self.stack.pop()
        self.key = key
        best = None
        for _, rule in self.stack:
            if path.startswith(rule.path) and _better(rule, best):
                best = rule
        return best


def sweep(keys: Iterable[str], paths: Iterable[str], spans: list[tuple[str, str, Rule]]) -> Iterator[Rule | None]:
    """The longest fitting rule of each (key, path); keys ascend."""
    s = Sweep(spans)
    for key, path in zip(keys, paths, strict=True):
        yield s.best(key, path)


def judge_urls(
    pages: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", part_rules: int = PART_RULES
) -> DataFrame:
    """One row per input row: id, host, path, the winning rule (null if none) and the verdict.

    The longest rule text wins; of equally long ones the longer host, then the
    later path. Null urls, urls without ``://`` and empty urls have empty host and
    path and get ``default`` (a rule never fits them). A url of any length is taken
    whole. Repeated rows stay repeated, null ids are allowed, an empty table gives an
    empty result, and further columns are ignored, whatever their names.
    """
    keyed = pages.select(column(id_col).alias("_id"), url_host(column(url_col)).alias("host"), url_path(column(url_col)).alias("path"))
    keyed = keyed.withColumn("_key", host_key(F.col("host"))).withColumns({c: F.lit(None).cast("string") for c in ("_action", "_rhost", "_rpath")})
    order = ["_key", "path", "_id"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ranged.schema
    for part in batched((Rule(*r) for r in rules), part_rules):
        ranged = ranged.mapInArrow(_sweeper(_intervals(part)), schema)
    rule = F.concat("_rhost", "_rpath")
    return ranged.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce("_action", F.lit(default)).alias("verdict"))


def _sweeper(spans: list[tuple[str, str, Rule]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sweep(spans)
        for b in batches:
            cols = {k: b.column(k) for k in ("_action", "_rhost", "_rpath")}
            before = [None if a is None else Rule(a, h, p) for a, h, p in zip(*(c.to_pylist() for c in cols.values()), strict=True)]
            won = [r if _better(r := s.best(key, path), old) else old for key, path, old in zip(b.column("_key").to_pylist(), b.column("path").to_pylist(), before, strict=True)]
            new = {f: pa.array([None if r is None else r[i] for r in won], pa.string()) for i, f in enumerate(cols)}
            yield pa.RecordBatch.from_arrays([new.get(f, b.column(f)) for f in b.schema.names], names=b.schema.names)

    return run
