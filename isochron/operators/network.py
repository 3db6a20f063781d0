"""From matched paths to drawable segments: splitting, refining, ordering lanes, drawing.

Network geometry is order-dependent inside one city and independent between
cities, so these kernels work on one city's network in memory and the DataFrame
functions run them with one city to a task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from isochron.operators.corridor import arc_of


@dataclass(frozen=True)
class NetworkConfig:
    """Metres, and costs of lane order."""

    quantum: float = 1.0
    lens_ratio: float = 2.0
    lens_gap: float = 80.0
    stub: float = 60.0
    bundle: float = 12.0
    bundle_run: float = 60.0
    refine_reach: float = 25.0
    strand_gap: float = 4.5
    refine_step: float = 6.0
    rounds: int = 5
    damp: float = 0.8
    flip: float = 8.0
    change: float = 2.0
    split: float = 1.0
    exhaustive: int = 6
    pitch: float = 3.0
    cut: float = 60.0


@dataclass
class Edge:
    a: int
    b: int
    points: np.ndarray
    routes: set[str]
    masks: dict[str, tuple[int, ...]] = field(default_factory=dict)


@dataclass
class Network:
    nodes: dict[int, np.ndarray]
    edges: dict[int, Edge]

    def at(self, node: int) -> list[int]:
        return sorted(k for k, e in self.edges.items() if node in (e.a, e.b))

    def degree(self) -> Counter:
        c: Counter = Counter()
        for e in self.edges.values():
            c[e.a] += 1
            c[e.b] += 1
        return c


def _or(a: dict, b: dict) -> dict:
    return {k: tuple(x | y for x, y in zip(a.get(k, b.get(k)), b.get(k, a.get(k)), strict=True)) for k in a.keys() | b.keys()}


def split_paths(paths: Iterable[tuple[str, np.ndarray, tuple[int, ...] | None]], cfg: NetworkConfig = NetworkConfig()) -> Network:
    """Network of the steps of paths (route, points, mask): nodes where the set of routes or the number of branches changes.

    Steps between the same two quantised vertices are one edge that all their routes ride.
    """
    q = cfg.quantum
    where: dict[tuple[int, int], np.ndarray] = {}
    steps: dict[tuple, tuple[set[str], dict]] = {}
    for route, pts, mask in paths:
        keys = [tuple(np.rint(p / q).astype(int).tolist()) for p in pts]
        for k, p in zip(keys, pts, strict=True):
            where.setdefault(k, p)
        for a, b in zip(keys, keys[1:], strict=False):
            if a != b:
                rs, ms = steps.setdefault((min(a, b), max(a, b)), (set(), {}))
                rs.add(route)
                if mask is not None:
                    ms.update(_or(ms, {route: mask}))
    near: dict[tuple, list[tuple]] = defaultdict(list)
    for a, b in steps:
        near[a].append(b)
        near[b].append(a)
    edge_of = lambda a, b: steps[min(a, b), max(a, b)]
    real = {v for v, ns in near.items() if len(ns) != 2 or edge_of(v, ns[0])[0] != edge_of(v, ns[1])[0]}
    number: dict[tuple, int] = {}
    net = Network({}, {})

    def node(v: tuple) -> int:
        if v not in number:
            number[v] = len(number)
            net.nodes[number[v]] = where[v]
        return number[v]

    seen: set[tuple] = set()

    def follow(start: tuple, nxt: tuple) -> None:
        chain = [start, nxt]
        seen.add((min(start, nxt), max(start, nxt)))
        while chain[-1] not in real:
            (n,) = [x for x in near[chain[-1]] if x != chain[-2]] or [None]
            if n is None or (min(chain[-1], n), max(chain[-1], n)) in seen:
                break
            seen.add((min(chain[-1], n), max(chain[-1], n)))
            chain.append(n)
        rs, ms = edge_of(start, nxt)
        masks = dict(ms)
        for a, b in zip(chain[1:], chain[2:], strict=False):
            masks = _or(masks, edge_of(a, b)[1])
        net.edges[len(net.edges)] = Edge(node(chain[0]), node(chain[-1]), np.array([where[v] for v in chain]), set(rs), masks)

    for v in sorted(real):
        for n in sorted(near[v]):
            if (min(v, n), max(v, n)) not in seen:
                follow(v, n)
    for a, b in sorted(steps):  # rings without a real node
        if (a, b) not in seen:
            real.add(a)
            follow(a, b)
    return net


def contract_chains(net: Network) -> None:
    """Join the two edges of a node of degree two that carry the same routes; repeat until there is none."""
    while True:
        for v, d in sorted(net.degree().items()):
            ks = net.at(v)
            if d != 2 or len(ks) != 2:
                continue
            e, f = net.edges[ks[0]], net.edges[ks[1]]
            if e.routes != f.routes or e.a == e.b or f.a == f.b:
                continue
            p = e.points if e.b == v else e.points[::-1]
            r = f.points if f.a == v else f.points[::-1]
            net.edges[ks[0]] = Edge(e.a if e.b == v else e.b, f.b if f.a == v else f.a, np.concatenate([p, r[1:]]), e.routes, _or(e.masks, f.masks))
            del net.edges[ks[1]], net.nodes[v]
            break
        else:
            return


def _resample(p: np.ndarray, n: int) -> np.ndarray:
    arc = arc_of(p)
    at = np.linspace(0, arc[-1], n)
    return np.stack([np.interp(at, arc, p[:, k]) for k in (0, 1)], axis=1)


def _distance(p: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of each point to a polyline."""
    a, d = line[:-1], np.diff(line, axis=0)
    n = (d * d).sum(axis=1)
    t = np.clip(((p[:, None] - a) * d).sum(axis=2) / np.where(n == 0, 1, n), 0, 1)
    return np.hypot(*np.moveaxis(a + t[..., None] * d - p[:, None], 2, 0)).min(axis=1)


def merge_lenses(net: Network, cfg: NetworkConfig = NetworkConfig()) -> int:
    """Merge edges of one node pair and route set that run close together; returns how many went."""
    gone = 0
    while True:
        groups: dict[tuple, list[int]] = defaultdict(list)
        for k, e in net.edges.items():
            groups[min(e.a, e.b), max(e.a, e.b), tuple(sorted(e.routes))].append(k)
        for ks in (sorted(v) for v in groups.values() if len(v) > 1):
            e, f = net.edges[ks[0]], net.edges[ks[1]]
            m, n = arc_of(e.points)[-1], arc_of(f.points)[-1]
            if min(m, n) * cfg.lens_ratio < max(m, n):
                continue
            p, r = _resample(e.points, 32), _resample(f.points if f.a == e.a else f.points[::-1], 32)
            if (_distance(p, r).mean() + _distance(r, p).mean()) / 2 > cfg.lens_gap:
                continue
            net.edges[ks[0]] = Edge(e.a, e.b, (p + r) / 2, e.routes, _or(e.masks, f.masks))
            del net.edges[ks[1]]
            gone += 1
            break
        else:
            return gone


def bundle_parallel(net: Network, cfg: NetworkConfig = NetworkConfig()) -> int:
    """Merge edges of one node pair whose every sample is within the bundle distance, routes united; returns how many went."""
    gone = 0
    while True:
        pairs: dict[tuple, list[int]] = defaultdict(list)
        for k, e in net.edges.items():
            pairs[min(e.a, e.b), max(e.a, e.b)].append(k)
        for ks in (sorted(v) for v in pairs.values() if len(v) > 1):
            hit = None
            for i, x in enumerate(ks):
                for y in ks[i + 1 :]:
                    e, f = net.edges[x], net.edges[y]
                    n = max(2, int(max(arc_of(e.points)[-1], arc_of(f.points)[-1]) / cfg.bundle_run) * 4 + 2)
                    p, r = _resample(e.points, n), _resample(f.points if f.a == e.a else f.points[::-1], n)
                    if max(_distance(p, r).max(), _distance(r, p).max()) <= cfg.bundle:
                        hit = (x, y, (p + r) / 2)
                        break
                if hit:
                    break
            if hit:
                x, y, mid = hit
                e, f = net.edges[x], net.edges[y]
                net.edges[x] = Edge(e.a, e.b, mid, e.routes | f.routes, _or(e.masks, f.masks))
                del net.edges[y]
                gone += 1
                break
        else:
            return gone


def fold_rings(net: Network, least: float = 250.0) -> None:
    """Drop loops at one node that are shorter than ``least``."""
    for k in [k for k, e in net.edges.items() if e.a == e.b and arc_of(e.points)[-1] < least]:
        del net.edges[k]


def drop_stubs(net: Network, cfg: NetworkConfig = NetworkConfig()) -> None:
    """Drop dead ends that a longer edge at their node with all their routes covers."""
    deg = net.degree()
    for k in sorted(net.edges):
        e = net.edges[k]
        if arc_of(e.points)[-1] >= cfg.stub or min(deg[e.a], deg[e.b]) != 1:
            continue
        inner = e.a if deg[e.a] > 1 else e.b
        others = [net.edges[j] for j in net.at(inner) if j != k and net.edges[j].routes >= e.routes]
        if any(_distance(e.points, o.points).max() <= cfg.bundle for o in others):
            del net.edges[k]
            deg = net.degree()


def compact_nodes(net: Network) -> None:
    """Drop nodes without edges and number the rest from 0."""
    used = sorted({v for e in net.edges.values() for v in (e.a, e.b)})
    new = {v: i for i, v in enumerate(used)}
    net.nodes = {new[v]: net.nodes[v] for v in used}
    for e in net.edges.values():
        e.a, e.b = new[e.a], new[e.b]


def cluster_strands(offsets: np.ndarray, gap: float) -> np.ndarray:
    """Means of runs of sorted offsets that are at most ``gap`` apart."""
    if not len(offsets):
        return offsets
    s = np.sort(offsets)
    return np.array([c.mean() for c in np.split(s, np.flatnonzero(np.diff(s) > gap) + 1)])


def refine_centerline(line: np.ndarray, strands: list[np.ndarray], cfg: NetworkConfig = NetworkConfig()) -> np.ndarray:
    """Move a line's inner vertices towards the median of the strands beside it, damped, some rounds; ends stay."""
    p = _resample(line, max(3, int(arc_of(line)[-1] / cfg.refine_step) + 1))
    for _ in range(cfg.rounds):
        tangent = np.gradient(p, axis=0)
        tangent /= np.maximum(np.hypot(*tangent.T), 1e-12)[:, None]
        normal = np.stack([-tangent[:, 1], tangent[:, 0]], axis=1)
        move = np.zeros(len(p))
        for i in range(1, len(p) - 1):
            votes = []
            for s in strands:
                a, d = s[:-1], np.diff(s, axis=0)
                den = d[:, 0] * normal[i, 1] - d[:, 1] * normal[i, 0]
                rel = p[i] - a
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = (rel[:, 0] * normal[i, 1] - rel[:, 1] * normal[i, 0]) / den
                ok = (np.abs(den) > 1e-12) & (t >= 0) & (t <= 1)
                if ok.any():
                    off = ((a[ok] + t[ok, None] * d[ok]) - p[i]) @ normal[i]
                    best = off[np.abs(off).argmin()]
                    if abs(best) <= cfg.refine_reach:
                        votes.append(best)
            c = cluster_strands(np.array(votes), cfg.strand_gap)
            if len(c):
                move[i] = (c[(len(c) - 1) // 2] + c[len(c) // 2]) / 2
        p = p + cfg.damp * move[:, None] * normal
    return p


def place_nodes(net: Network, reach: float = 30.0) -> None:
    """Move nodes of degree three or more to the least-squares meeting point of their edges' end rays, if that is near."""
    for v in net.nodes:
        ks = net.at(v)
        if len(ks) < 3:
            continue
        m, rhs = np.zeros((2, 2)), np.zeros(2)
        for k in ks:
            p = net.edges[k].points if net.edges[k].a == v else net.edges[k].points[::-1]
            d = p[min(len(p) - 1, 2)] - p[0]
            n = np.hypot(*d)
            if n:
                proj = np.eye(2) - np.outer(d, d) / n**2
                m += proj
                rhs += proj @ p[min(len(p) - 1, 1)]
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        x = np.linalg.solve(m, rhs)
        if np.hypot(*(x - net.nodes[v])) > reach:
            continue
        for k in ks:
            e = net.edges[k]
            pts = e.points.copy()
            if e.a == v:
                pts[0] = x
            if e.b == v:
                pts[-1] = x
            e.points = pts
        net.nodes[v] = x


def order_cost(net: Network, slots: dict[int, list[str]], key: dict[str, str], cfg: NetworkConfig = NetworkConfig()) -> float:
    """Crossings of lane groups at nodes: each inverted pair of shared groups costs ``flip``, less where one or both leave."""
    total = 0.0
    for v in net.nodes:
        ks = net.at(v)
        for i, x in enumerate(ks):
            for y in ks[i + 1 :]:
                total += _pair_cost(net, slots, v, x, y, ks, cfg)
    return total


def _facing(net: Network, slots: dict[int, list[str]], v: int, k: int) -> list[str]:
    """Groups left to right, looking along the edge into the node."""
    return slots[k] if net.edges[k].b == v else slots[k][::-1]


def _pair_cost(net: Network, slots: dict, v: int, x: int, y: int, ks: list[int], cfg: NetworkConfig) -> float:
    a, b = _facing(net, slots, v, x), _facing(net, slots, v, y)[::-1]
    shared = [g for g in a if g in b]
    place = {g: i for i, g in enumerate(b)}
    leaves = {g: any(g in slots[k] for k in ks if k not in (x, y)) for g in shared}
    cost = 0.0
    for i, g in enumerate(shared):
        for h in shared[i + 1 :]:
            if place[g] > place[h]:
                cost += cfg.flip if not (leaves[g] or leaves[h]) else cfg.change if leaves[g] != leaves[h] else cfg.split
    return cost


def order_lanes(net: Network, key: dict[str, str], cfg: NetworkConfig = NetworkConfig()) -> dict[int, list[str]]:
    """Lane groups of each edge, left to right along it: local search from sorted order until no edge improves.

    Up to ``exhaustive`` groups all orders of an edge are tried, beyond that swaps of neighbours.
    """
    slots = {k: sorted({key.get(r, r) for r in e.routes}) for k, e in net.edges.items()}

    def local(k: int) -> float:
        e = net.edges[k]
        total = 0.0
        for v in {e.a, e.b}:
            ks = net.at(v)
            total += sum(_pair_cost(net, slots, v, min(k, j), max(k, j), ks, cfg) for j in ks if j != k)
        return total

    for _ in range(25):
        better = False
        for k in sorted(slots):
            g = slots[k]
            if len(g) < 2:
                continue
            tries = permutations(sorted(g)) if len(g) <= cfg.exhaustive else ([*g[:i], g[i + 1], g[i], *g[i + 2 :]] for i in range(len(g) - 1))
            best, least = g, local(k)
            for t in map(list, tries):
                slots[k] = t
                c = local(k)
                if c < least:
                    best, least, better = t, c, True
            slots[k] = best
        if not better:
            break
    return slots


# Zoom bands (first, end), scale of cuts and pitch.
BANDS = ((15, 24, 1.0, 1.0), (14, 15, 1.5, 0.8), (13, 14, 2.5, 0.65), (0, 13, 4.0, 0.5))


def _sub(p: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The part of a polyline between two arcs."""
    arc = arc_of(p)
    at = lambda s: np.array([np.interp(s, arc, p[:, k]) for k in (0, 1)])
    inner = p[(arc > lo) & (arc < hi)]
    return np.concatenate([[at(lo)], inner, [at(hi)]])


def _curve(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray, n: int = 12) -> np.ndarray:
    """Cubic from a along da to b along db."""
    r = np.hypot(*(b - a)) / 2
    t = np.linspace(0, 1, n)[:, None]
    c1, c2 = a + da * r, b - db * r
    return (1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t**2 * c2 + t**3 * b


def draw(net: Network, slots: dict[int, list[str]], key: dict[str, str], cfg: NetworkConfig = NetworkConfig()) -> list[dict]:
    """Steady pieces of each edge and lane group, and transitions where a group goes on over a node, in every zoom band.

    A piece is offset by its slot's distance from the middle; a transition runs
    from the offset on one side to that on the other, and is active when both are.
    """
    out = []
    unit = lambda v: v / max(np.hypot(*v), 1e-12)
    for lo, hi, scale, narrow in BANDS:
        pitch = cfg.pitch * narrow
        cut_of = {k: min(cfg.cut * scale, arc_of(e.points)[-1] / 3) for k, e in net.edges.items()}
        deg = net.degree()
        body = {}
        for k, e in net.edges.items():
            n = arc_of(e.points)[-1]
            if n <= 0:
                continue
            p = _sub(e.points, cut_of[k] if deg[e.a] > 1 else 0.0, n - (cut_of[k] if deg[e.b] > 1 else 0.0))
            body[k] = p
            for i, g in enumerate(slots[k]):
                routes = sorted(r for r in e.routes if key.get(r, r) == g)
                out.append({
                    "kind": "steady", "edge": k, "node": -1, "group": g, "routes": routes, "slot": i, "nslots": len(slots[k]), "offset_px": (i - (len(slots[k]) - 1) / 2) * pitch,
                    "off_from_px": 0.0, "off_to_px": 0.0, "band_min": lo, "band_max": hi, "masks": [e.masks.get(r) for r in routes], "points": p,
                })
        for v in net.nodes:
            ks = [k for k in net.at(v) if k in body]
            for i, x in enumerate(ks):
                for y in ks[i + 1 :]:
                    e, f = net.edges[x], net.edges[y]
                    p = body[x] if e.b == v else body[x][::-1]
                    q = body[y] if f.a == v else body[y][::-1]
                    da, db = unit(p[-1] - p[-2]), unit(q[1] - q[0])
                    if da @ db < -0.5:  # no line turns back on itself
                        continue
                    for g in slots[x]:
                        shared = sorted(r for r in e.routes & f.routes if key.get(r, r) == g)
                        if not shared:
                            continue
                        side = lambda k, s, g=g: s * (slots[k].index(g) - (len(slots[k]) - 1) / 2) * pitch
                        both = [None if e.masks.get(r) is None or f.masks.get(r) is None else tuple(m & w for m, w in zip(e.masks[r], f.masks[r], strict=True)) for r in shared]
                        out.append({
                            "kind": "transition", "edge": x, "node": v, "group": g, "routes": shared, "slot": slots[x].index(g), "nslots": len(slots[x]), "offset_px": 0.0,
                            "off_from_px": side(x, 1 if e.b == v else -1), "off_to_px": side(y, 1 if f.a == v else -1),
                            "band_min": lo, "band_max": hi, "masks": both, "points": _curve(p[-1], da, q[0], db),
                        })
    return out


def cut_at_terminals(line: np.ndarray, arcs: Iterable[float], apart: float = 60.0, margin: float = 120.0) -> list[np.ndarray]:
    """Pieces of a line cut at arcs, each at least ``apart`` from the one before and ``margin`` from the ends."""
    n = arc_of(line)[-1]
    kept: list[float] = []
    for a in sorted(arcs):
        if margin <= a <= n - margin and (not kept or a - kept[-1] >= apart):
            kept.append(a)
    edges = [0.0, *kept, n]
    return [_sub(line, a, b) for a, b in zip(edges, edges[1:], strict=False)]


def piece_masks(piece: np.ndarray, paths: list[tuple[str, np.ndarray, tuple[int, ...]]], whole: dict[str, tuple[int, ...]], reach: float = 40.0) -> dict[str, tuple[int, ...]]:
    """Masks of the routes on a piece from the paths that pass its middle.

    A route's mask is replaced only if the paths found on the whole line explain every hour it had.
    """
    mid = _sub(piece, 0, arc_of(piece)[-1] / 2)[-1:]
    out = {}
    for r, had in whole.items():
        own = [(m, _distance(mid, p)[0] <= reach) for q, p, m in paths if q == r]
        found = [0] * 7
        here = [0] * 7
        for m, near in own:
            found = [a | b for a, b in zip(found, m, strict=True)]
            if near:
                here = [a | b for a, b in zip(here, m, strict=True)]
        out[r] = tuple(here) if all(f | h == f for f, h in zip(found, had, strict=True)) else had
    return out


def simplify_network(net: Network, cfg: NetworkConfig = NetworkConfig()) -> Network:
    """Contraction, rings, stubs, parallel edges, lenses and nodes, in the order the steps depend on."""
    fold_rings(net)
    contract_chains(net)
    bundle_parallel(net, cfg)
    drop_stubs(net, cfg)
    contract_chains(net)
    merge_lenses(net, cfg)
    contract_chains(net)
    place_nodes(net)
    compact_nodes(net)
    return net


def trim_edge_ends(net: Network) -> None:
    """Cut each edge to its closest approach to its end nodes and end it there."""
    for e in net.edges.values():
        p = e.points
        if len(p) < 3 or e.a == e.b:
            continue
        i = int(np.hypot(*(p[: len(p) // 2] - net.nodes[e.a]).T).argmin())
        j = len(p) // 2 + int(np.hypot(*(p[len(p) // 2 :] - net.nodes[e.b]).T).argmin())
        inner = p[i + 1 : j]
        e.points = np.concatenate([[net.nodes[e.a]], inner, [net.nodes[e.b]]])


def through_members(line: np.ndarray, members: list[np.ndarray], reach: float = 25.0, share: float = 0.8) -> list[np.ndarray]:
    """The strands that are within ``reach`` along at least ``share`` of a line."""
    at = _resample(line, max(2, int(arc_of(line)[-1] / 6) + 1))
    return [m for m in members if (_distance(at, m) <= reach).mean() >= share]


def edge_mates(line: np.ndarray, strands: list[np.ndarray], reach: float = 12.0, run: float = 60.0) -> list[int]:
    """Indices of strands that stay within ``reach`` of a line for ``run`` metres on end."""
    n = max(2, int(arc_of(line)[-1] / 6) + 1)
    at, step = _resample(line, n), arc_of(line)[-1] / (n - 1)
    out = []
    for k, s in enumerate(strands):
        longest = best = 0
        for ok in _distance(at, s) <= reach:
            longest = longest + 1 if ok else 0
            best = max(best, longest)
        if (best - 1) * step >= run:
            out.append(k)
    return out


def cover_interval(line: np.ndarray, path: np.ndarray, reach: float = 40.0) -> tuple[float, float] | None:
    """First and last arc of a line that a path rides along; None if it doesn't."""
    n = max(2, int(arc_of(line)[-1] / 10) + 1)
    hit = np.flatnonzero(_distance(_resample(line, n), path) <= reach)
    return None if len(hit) < 2 else tuple(np.linspace(0, arc_of(line)[-1], n)[[hit[0], hit[-1]]].tolist())


def fillet_corners(p: np.ndarray, radius: float, least_turn: float = 20.0) -> np.ndarray:
    """Replace sharp vertices by arcs tangent to both legs; legs shorter than needed shrink the radius."""
    out = [p[0]]
    for i in range(1, len(p) - 1):
        a, b, c = p[i - 1], p[i], p[i + 1]
        u, v = b - a, c - b
        lu, lv = np.hypot(*u), np.hypot(*v)
        if not lu or not lv:
            continue
        turn = np.arccos(np.clip(u @ v / (lu * lv), -1, 1))
        if np.degrees(turn) < least_turn or np.pi - turn < 1e-6:
            out.append(b)
            continue
        cut = min(radius * np.tan(turn / 2), lu / 2, lv / 2)
        out += list(_curve(b - u / lu * cut, u / lu, b + v / lv * cut, v / lv, 6))
    out.append(p[-1])
    return np.array(out)


SEGMENTS = (
    "city string, kind string, edge int, node int, color string, routes array<string>, slot int, nslots int, offset_px double, off_from_px double, "
    "off_to_px double, band_min int, band_max int, acts array<string>, len_m double, points array<struct<x:double,y:double>>"
)


def build_segments(paths: DataFrame, routes: DataFrame, cfg: NetworkConfig = NetworkConfig()) -> DataFrame:
    """Segments of every city: ``paths`` (city, route_id, points, mask: seven ints or null), ``routes`` (city, route_id, trunk, color)."""

    def run(key: tuple, own: pd.DataFrame, rts: pd.DataFrame) -> pd.DataFrame:
        trunk = dict(zip(rts.route_id, rts.trunk, strict=True))
        votes: dict[str, Counter] = defaultdict(Counter)
        for t, c in zip(rts.trunk, rts.color, strict=True):
            votes[t][c] += 1
        color = {t: min(v.items(), key=lambda kv: (-kv[1], kv[0]))[0] for t, v in votes.items()}
        own = own.sort_values(["route_id"], kind="stable")
        items = [(r.route_id, np.array([[q["x"], q["y"]] for q in r.points], dtype=float), None if r.mask is None else tuple(int(x) for x in r.mask)) for r in own.itertuples(index=False)]
        net = simplify_network(split_paths([i for i in items if len(i[1]) > 1], cfg), cfg)
        slots = order_lanes(net, trunk, cfg)
        rows = []
        for s in draw(net, slots, trunk, cfg):
            acts = ["" if m is None else "".join(f"{x:06x}" for x in m) for m in s["masks"]]
            rows.append((
                key[0], s["kind"], s["edge"], s["node"], color.get(s["group"], "888888"), s["routes"], s["slot"], s["nslots"], s["offset_px"], s["off_from_px"], s["off_to_px"],
                s["band_min"], s["band_max"], acts, float(arc_of(s["points"])[-1]), [{"x": a, "y": b} for a, b in s["points"].tolist()],
            ))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.replace("struct<x:double,y:double>", "p").split(", ")])

    return paths.groupBy("city").cogroup(routes.groupBy("city")).applyInPandas(run, SEGMENTS)
