"""Map matching of pattern shapes to track: a hidden Markov model with a gap state.

States of a sample are directed track pieces in reach and GAP. Emissions weigh
distance, heading and class; transitions are shortest constrained walks over the
piece graph. Pieces ridden by earlier patterns earn a bonus, so patterns of one
city are decoded in order, heaviest first, in one task; cities are independent.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.functions import modes
from isochron.operators.corridor import arc_of


@dataclass(frozen=True)
class MatchConfig:
    """Metres and unit costs."""

    sample: float = 20.0
    most_samples: int = 20_000
    reach: float = 90.0
    candidates: int = 14
    heading: float = 35.0
    turn: float = 0.8
    same_route: float = 25.0
    same_color: float = 18.0
    ridden: float = 12.0
    gap: float = 75.0
    gap_free: float = 45.0
    gap_barred: float = 1e7
    gap_switch: float = 40.0
    walk: float = 350.0
    walk_cost: float = 1.0
    hop: float = 2.0
    u_turn: float = 200.0
    wrong_class: float = 100.0
    level_jump: float = 300.0
    weld: float = 0.6


@dataclass
class Track:
    """Pieces between junctions; directed edge 2p runs along piece p, 2p + 1 against it."""

    pieces: list[np.ndarray]
    cls: list[str]
    level: list[int]
    way: list[str]
    ends: list[tuple[int, int]]
    out: dict[int, list[int]]

    def points(self, e: int) -> np.ndarray:
        return self.pieces[e // 2][:: -1 if e % 2 else 1]

    def tail(self, e: int) -> int:
        return self.ends[e // 2][e % 2]

    def head(self, e: int) -> int:
        return self.ends[e // 2][1 - e % 2]


def build_track(ways: list[tuple[str, str, int, np.ndarray]], weld: float = 0.6) -> Track:
    """Split ways (id, class, level, points) where another way of the same layer ends, and weld ends that meet.

    Ways are taken in order of id, so the result doesn't depend on the input's order.
    """
    ways = sorted(ways, key=lambda w: w[0])
    layer = lambda c: c if c in ("street", "seaway") else "rail"
    key = lambda c, p: (layer(c), round(p[0] / weld), round(p[1] / weld))
    ends_at = {key(c, p[i]) for _, c, _, p in ways for i in (0, -1)}
    t = Track([], [], [], [], [], defaultdict(list))
    node: dict[tuple, int] = {}

    def weld_node(c: str, p: np.ndarray) -> int:
        k = key(c, p)
        for dx in (0, -1, 1):
            for dy in (0, -1, 1):
                if (near := (k[0], k[1] + dx, k[2] + dy)) in node:
                    return node[near]
        return node.setdefault(k, len(node))

    for wid, cls, level, p in ways:
        cuts = [0, *[i for i in range(1, len(p) - 1) if key(cls, p[i]) in ends_at], len(p) - 1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = p[a : b + 1]
            if len(part) < 2 or arc_of(part)[-1] == 0:
                continue
            k = len(t.pieces)
            t.pieces.append(part)
            t.cls.append(cls)
            t.level.append(level)
            t.way.append(wid)
            t.ends.append((weld_node(cls, part[0]), weld_node(cls, part[-1])))
            t.out[t.ends[k][0]].append(2 * k)
            t.out[t.ends[k][1]].append(2 * k + 1)
    return t


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.hypot(*v)
    return v / n if n else v


def _project(p: np.ndarray, line: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(distance, arc, direction) of the nearest place of a polyline."""
    a, d = line[:-1], np.diff(line, axis=0)
    n = (d * d).sum(axis=1)
    t = np.clip(((p - a) * d).sum(axis=1) / np.where(n == 0, 1, n), 0, 1)
    off = np.hypot(*(a + t[:, None] * d - p).T)
    i = int(off.argmin())
    return float(off[i]), float(arc_of(line)[i] + t[i] * np.sqrt(n[i])), _unit(d[i])


def _turn(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip(_unit(a) @ _unit(b), -1, 1))))


class Matcher:
    """Decodes patterns one after another over a track."""

    def __init__(self, track: Track, cfg: MatchConfig = MatchConfig()) -> None:
        self.t, self.cfg = track, cfg
        self.used: dict[int, set[str]] = defaultdict(set)
        self.used_color: dict[int, set[str]] = defaultdict(set)
        self._walks: dict[tuple[int, int], tuple[float, list[int]] | None] = {}
        self.grid: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.size = cfg.reach
        for k, p in enumerate(track.pieces):
            for a, b in zip(p, p[1:], strict=False):
                lo, hi = np.floor(np.minimum(a, b) / self.size).astype(int), np.floor(np.maximum(a, b) / self.size).astype(int)
                for i in range(lo[0], hi[0] + 1):
                    for j in range(lo[1], hi[1] + 1):
                        self.grid[i, j].add(k)

    def _near(self, p: np.ndarray) -> list[int]:
        i, j = np.floor(p / self.size).astype(int)
        return sorted({k for a in (-1, 0, 1) for b in (-1, 0, 1) for k in self.grid.get((i + a, j + b), ())})

    def _walk(self, u: int, v: int) -> tuple[float, list[int]] | None:
        """Cheapest walk from u to v by turns, lengths and penalties, at most ``walk`` metres between them."""
        if (u, v) in self._walks:
            return self._walks[u, v]
        t, c = self.t, self.cfg
        heap: list[tuple[float, float, int, tuple[int, ...]]] = [(0.0, 0.0, u, ())]
        settled: dict[int, list[tuple[float, float]]] = defaultdict(list)
        found = None
        while heap:
            cost, length, e, via = heapq.heappop(heap)
            if e == v:
                found = (cost, list(via[:-1]))
                break
            if any(a <= cost and b <= length for a, b in settled[e]):
                continue
            settled[e].append((cost, length))
            out_dir = t.points(e)[-1] - t.points(e)[-2]
            for nx in t.out[t.head(e)]:
                step = cost + _turn(out_dir, t.points(nx)[1] - t.points(nx)[0]) * c.turn + (c.u_turn if nx == e ^ 1 else 0)
                run = length
                if nx != v:
                    n = arc_of(t.points(nx))[-1]
                    step += n * c.walk_cost + c.hop + (c.level_jump if t.level[e // 2] * t.level[nx // 2] < 0 else 0)
                    run += n
                    if run > c.walk:
                        continue
                heapq.heappush(heap, (step, run, nx, (*via, nx)))
        self._walks[u, v] = found
        return found

    def match(self, route: str, color: str, rides: set[str] | None, layer: str, shape: np.ndarray) -> list[tuple[int, list[int]]]:
        """Runs of (kind, edges): kind 1 with directed edges ridden, 0 for a gap with the samples it spans."""
        c, t = self.cfg, self.t
        total = arc_of(shape)[-1]
        n = int(min(max(2, np.ceil(total / c.sample) + 1), c.most_samples))
        at = np.linspace(0, total, n)
        arc = arc_of(shape)
        pts = np.stack([np.interp(at, arc, shape[:, k]) for k in (0, 1)], axis=1)
        head = np.stack([_unit(b - a) for a, b in zip(pts[np.maximum(np.arange(n) - 1, 0)], pts[np.minimum(np.arange(n) + 1, n - 1)], strict=True)])
        way_layer = lambda k: t.cls[k] if t.cls[k] in ("street", "seaway") else "rail"
        gap = -1
        back: list[dict[int, int]] = []
        prev: dict[int, float] = {}
        for i in range(n):
            near = [(*_project(pts[i], t.pieces[k]), k) for k in self._near(pts[i]) if way_layer(k) == layer]
            near = sorted((x for x in near if x[0] <= c.reach), key=lambda x: (x[0], x[3]))[: c.candidates]
            fits = lambda k: rides is None or t.cls[k] in rides
            some = any(fits(x[3]) for x in near)
            emit: dict[int, float] = {}
            usable = False
            for d, _, direction, k in near:
                dot = float(direction @ head[i])
                ok = fits(k) or not some
                usable |= ok and d < c.gap_free and abs(dot) >= 0.5
                bonus = c.same_route if route in self.used[k] else c.same_color if color in self.used_color[k] else c.ridden if self.used[k] else 0.0
                for e, s in ((2 * k, dot), (2 * k + 1, -dot)):
                    emit[e] = d + c.heading * (1 - s) + (0 if ok else c.wrong_class) - bonus
            emit[gap] = c.gap_barred if usable else c.gap
            if i == 0:
                prev = emit
                back.append({})
                continue
            order = sorted(prev.items(), key=lambda kv: (kv[1], kv[0]))
            cur, link = {}, {}
            for s, cost in emit.items():
                best, came = np.inf, gap
                for u, before in order:
                    if before >= best:
                        break
                    if u == s:
                        step = 0.0
                    elif gap in (u, s):
                        step = c.gap_switch
                    else:
                        w = self._walk(u, s)
                        step = np.inf if w is None else w[0]
                    if before + step < best:
                        best, came = before + step, u
                if best < np.inf:
                    cur[s], link[s] = best + cost, came
            prev = cur
            back.append(link)
        state = min(prev, key=lambda s: (prev[s], s))
        states = [state]
        for link in reversed(back[1:]):
            state = link[state]
            states.append(state)
        states.reverse()
        runs: list[tuple[int, list[int]]] = []
        for i, s in enumerate(states):
            if s == gap:
                if runs and runs[-1][0] == 0:
                    runs[-1][1].append(i)
                else:
                    runs.append((0, [i]))
                continue
            if not runs or runs[-1][0] == 0:
                runs.append((1, [s]))
            elif runs[-1][1][-1] != s:
                w = self._walk(runs[-1][1][-1], s)
                runs[-1][1].extend([*(w[1] if w else []), s])
        for kind, es in runs:
            for e in es if kind else ():
                self.used[e // 2].add(route)
                self.used_color[e // 2].add(color)
        self.samples = pts
        return runs

    def line(self, runs: list[tuple[int, list[int]]]) -> np.ndarray:
        """Points along the runs."""
        out = []
        for kind, es in runs:
            out += [self.t.points(e) for e in es] if kind else [self.samples[es]]
        pts = np.concatenate(out) if out else np.zeros((0, 2))
        keep = np.concatenate([[True], (np.abs(np.diff(pts, axis=0)) > 1e-9).any(axis=1)]) if len(pts) else []
        return pts[keep]


def match_patterns(patterns: DataFrame, ways: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(city, route_id, shape_id, way_ids, length, gap, points) of the patterns' ways over the track.

    ``patterns``: city, route_id, shape_id, trips, color, route_type, points (x, y);
    ``ways``: city, id, cls, level, points. One city is one task.
    """
    p = patterns.withColumns({"cls": modes.route_class(F.col("route_type")), "layer": modes.pattern_layer(F.col("route_type"))})
    rides = {k: set(v) for k, v in modes.RIDES.items()}

    def run(key: tuple, pats: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        xy = lambda v: np.array([[q["x"], q["y"]] for q in v], dtype=float)
        matcher = Matcher(build_track([(w.id, w.cls, int(w.level), xy(w.points)) for w in own.itertuples(index=False)], cfg.weld), cfg)
        rows = []
        for r in pats.sort_values(["trips", "route_id", "shape_id"], ascending=[False, True, True]).itertuples(index=False):
            shape = xy(r.points)
            if len(shape) < 2:
                continue
            runs = matcher.match(r.route_id, r.color, rides.get(r.cls), r.layer, shape)
            line = matcher.line(runs)
            gap = sum(max(0, len(es) - 1) for kind, es in runs if not kind) * cfg.sample
            ways_ridden = list(dict.fromkeys(matcher.t.way[e // 2] for kind, es in runs if kind for e in es))
            rows.append((key[0], r.route_id, r.shape_id, ways_ridden, float(arc_of(line)[-1]) if len(line) > 1 else 0.0, float(gap), [{"x": a, "y": b} for a, b in line.tolist()]))
        return pd.DataFrame(rows, columns=["city", "route_id", "shape_id", "way_ids", "length", "gap", "points"])

    out = "city string, route_id string, shape_id string, way_ids array<string>, length double, gap double, points array<struct<x:double,y:double>>"
    return p.groupBy("city").cogroup(ways.groupBy("city")).applyInPandas(run, out)


def chain_ways(ways: list[tuple[str, np.ndarray]], weld: float = 0.6) -> list[tuple[list[str], np.ndarray]]:
    """Join ways (id, points) where exactly two meet end to end; (ids, points) of each strand, by first id."""
    key = lambda p: (round(p[0] / weld), round(p[1] / weld))
    ways = sorted(ways, key=lambda w: w[0])
    at: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, p) in enumerate(ways):
        at[key(p[0])].append((i, 0))
        at[key(p[-1])].append((i, 1))
    used: set[int] = set()

    def grow(i: int, end: int) -> list[tuple[int, bool]]:
        """Ways after way i beyond its end (1) or start (0): (way, reversed)."""
        out = []
        while True:
            k = key(ways[i][1][-1 if end else 0])
            nxt = [x for x in at[k] if x != (i, end)]
            if len(at[k]) != 2 or len(nxt) != 1 or nxt[0][0] in used:
                return out
            i, e = nxt[0]
            used.add(i)
            out.append((i, e == 1))
            end = 1 - e

    strands = []
    for i, (wid, p) in enumerate(ways):
        if i in used:
            continue
        used.add(i)
        after, before = grow(i, 1), grow(i, 0)
        chain = [(j, not r) for j, r in reversed(before)] + [(i, False)] + after
        pts = [ways[j][1][::-1] if r else ways[j][1] for j, r in chain]
        strands.append(([ways[j][0] for j, _ in chain], np.concatenate([pts[0], *[q[1:] for q in pts[1:]]])))
    return strands


def snap_endpoints(ways: list[tuple[str, np.ndarray]], reach: float = 2.0) -> list[tuple[str, np.ndarray]]:
    """Ways with a vertex put into a segment wherever another way ends within ``reach`` of it, so that they join there."""
    ways = sorted(ways, key=lambda w: w[0])
    out = []
    for wid, p in ways:
        joints = []
        for other, q in ways:
            if other == wid:
                continue
            for end in (q[0], q[-1]):
                d, arc, _ = _project(end, p)
                total = arc_of(p)[-1]
                if d <= reach and reach < arc < total - reach:
                    joints.append((arc, end))
        a = arc_of(p)
        rows = sorted([*((s, 1, tuple(v)) for s, v in joints), *((s, 0, tuple(v)) for s, v in zip(a, p, strict=True))])
        pts = [r[2] for r in rows]
        out.append((wid, np.array([v for i, v in enumerate(pts) if i == 0 or v != pts[i - 1]])))
    return out


def heal_breaks(ends: list[tuple[np.ndarray, np.ndarray]], reach: float = 5.0, facing: float = 0.7) -> list[tuple[int, int]]:
    """Pairs of dead ends (place, outward direction) to weld: near, facing each other, each once, in order of index."""
    used: set[int] = set()
    out = []
    for i, (p, u) in enumerate(ends):
        if i in used:
            continue
        best = None
        for j in range(i + 1, len(ends)):
            q, v = ends[j]
            d = float(np.hypot(*(q - p)))
            if j not in used and d <= reach and -float(_unit(u) @ _unit(v)) >= facing and (best is None or d < best[0]):
                best = (d, j)
        if best:
            used |= {i, best[1]}
            out.append((i, best[1]))
    return out
