"""Geometry that SQL does not express: grouped pandas functions on one branch, stop or ring at a time.

A group is one rail branch or one station, a few thousand points at most; the shuffle key is its id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplake.session import ship_package

#: Platform strips, hulls and smoothing, in metres; CONCAVITY is a ratio of lengths.
HALF_LENGTH_M, DENSIFY_M, GAP_M, WIDTH_M, CONCAVITY = 52.0, 16.0, 1.2, 5.0, 60.0
SMOOTH_PASSES, SMOOTH_AREA_M2, AREA_TOLERANCE = 2, 12.0, 0.25

#: The grid on which cut edges meet, and how far beside an edge its sides are looked at.
SNAP_M, SIDE_M = 1e-6, 1e-4

Point = tuple[float, float]


def chain(runs: Iterable[list[Point]]) -> list[Point]:
    """Ways chained by equal end points, reversed where needed; the longest chain, the first of equals.

    Each chain starts from the last way that is left and takes the first one that fits either of its ends, the
    tail before the head, until none does. The last way takes the place of one that was taken.
    """
    rest = [list(r) for r in runs if len(r) > 1]
    best: list[Point] = []
    best_length = 0.0
    while rest:
        run = rest.pop()
        while True:
            fits = (k for k, way in enumerate(rest) if {way[0], way[-1]} & {run[0], run[-1]})
            at = next(fits, None)
            if at is None:
                break
            rest[at], rest[-1] = rest[-1], rest[at]
            way = rest.pop()
            if run[-1] in (way[0], way[-1]):
                run += (way if way[0] == run[-1] else way[::-1])[1:]
            else:
                run = (way if way[-1] == run[0] else way[::-1])[:-1] + run
        length = float(np.hypot(*np.diff(np.array(run), axis=0).T).sum())
        if length > best_length:
            best, best_length = run, length
    return [p for k, p in enumerate(best) if k == 0 or p != best[k - 1]]


def stitch(members: DataFrame) -> DataFrame:
    """branch, pos, lon, lat of each branch's polyline (J01, E18). members: branch, seq, way_id, lons, lats.

    A way counts once for each branch, at its first seq; fewer than two points give no shape.
    """

    ship_package(members.sparkSession)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["seq", "way_id"]).drop_duplicates("way_id")
        line = chain([list(zip(x, y)) for x, y in zip(g.lons, g.lats)])
        line = line if len(line) > 1 else []
        return pd.DataFrame({"branch": [g.branch.iloc[0]] * len(line), "pos": range(len(line)), "lon": [p[0] for p in line], "lat": [p[1] for p in line]})

    return members.groupBy("branch").applyInPandas(one, "branch string, pos int, lon double, lat double")


def chaikin(ring: np.ndarray) -> np.ndarray:
    """One pass of corner cutting on a ring without its closing point; fewer than three points stay."""
    if len(ring) < 3:
        return ring
    after = np.roll(ring, -1, axis=0)
    return np.stack([0.75 * ring + 0.25 * after, 0.25 * ring + 0.75 * after], axis=1).reshape(-1, 2)


def area(ring: np.ndarray) -> float:
    after = np.roll(ring, -1, axis=0)
    return abs(float((ring[:, 0] * after[:, 1] - after[:, 0] * ring[:, 1]).sum())) / 2


def covers(ring: np.ndarray, p: Point) -> bool:
    """Whether a point is in a ring or on its border."""
    a, b = ring, np.roll(ring, -1, axis=0)
    x, y = p
    cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    within = (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
    if ((np.abs(cross) < 1e-9) & within).any():
        return True
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    at = a[spans, 0] + (y - a[spans, 1]) / (b[spans, 1] - a[spans, 1]) * (b[spans, 0] - a[spans, 0])
    return bool((at > x).sum() % 2)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def meets(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether segments ab and pq have a point in common, over arrays that broadcast."""
    sides = [np.sign(_cross(y - x, z - x)) for x, y, z in ((a, b, p), (a, b, q), (p, q, a), (p, q, b))]
    crossing = (sides[0] != sides[1]) & (sides[2] != sides[3])
    flat = (sides[0] == 0) & (sides[1] == 0)
    boxes = ((np.minimum(a, b) <= np.maximum(p, q)) & (np.minimum(p, q) <= np.maximum(a, b))).all(axis=-1)
    return np.where(flat, boxes, crossing & boxes)


def is_simple(ring: np.ndarray) -> bool:
    """Whether a ring without its closing point is a sound polygon: finite, with an area, and no edge that meets another but in a shared corner."""
    n = len(ring)
    if n < 3 or not np.isfinite(ring).all() or area(ring) == 0 or len(np.unique(ring, axis=0)) < n:
        return False
    after = np.roll(ring, -1, axis=0)
    touch = meets(ring[:, None], after[:, None], ring[None], after[None])
    apart = np.abs(np.arange(n)[:, None] - np.arange(n))
    if touch[(apart > 1) & (apart < n - 1)].any():
        return False
    # an edge that folds back onto the one before it
    way, back = after - ring, ring - np.roll(ring, 1, axis=0)
    return not ((_cross(back, way) == 0) & ((back * way).sum(axis=1) < 0)).any()


def simplify(ring: np.ndarray, least_area: float = SMOOTH_AREA_M2) -> np.ndarray:
    """Visvalingam-Whyatt: the vertex with the smallest triangle goes until none is under the limit; one whose loss would make edges meet stays."""
    ring = np.asarray(ring, float)
    held = np.zeros(len(ring), bool)
    while len(ring) > 3:
        a, c = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
        tri = np.where(held, np.inf, np.abs(_cross(ring - a, c - a)) / 2)
        k = int(tri.argmin())
        if tri[k] >= least_area:
            break
        others = np.setdiff1d(np.arange(len(ring)), [(k - 2) % len(ring), (k - 1) % len(ring), k, (k + 1) % len(ring)])
        if len(others) and meets(a[k], c[k], ring[others], c[others]).any():
            held[k] = True
            continue
        ring, held = np.delete(ring, k, axis=0), np.delete(held, k)
    return ring


def smooth(ring: np.ndarray, stops: list[Point]) -> np.ndarray:
    """Two rounds of corner cutting and a simplification, unless edges meet, a stop would fall out or the area change by over 25 %."""
    out = ring
    for _ in range(SMOOTH_PASSES):
        out = chaikin(out)
    out = simplify(out)
    before = max(area(ring), 1e-6)
    sound = is_simple(out) and all(covers(out, s) for s in stops) and abs(area(out) - before) <= AREA_TOLERANCE * before
    return out if sound else ring


def convex_hull(points: Iterable[Point]) -> np.ndarray | None:
    """Convex hull by monotone chain, counter-clockwise; None with fewer than three points off one line."""
    p = sorted(set(map(tuple, points)))
    half = []
    for order in (p, p[::-1]):
        h: list[Point] = []
        for q in order:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (q[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (q[0] - h[-2][0]) <= 0:
                h.pop()
            h.append(q)
        half += h[:-1]
    return np.array(half) if len(half) >= 3 else None


def segment_distance(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points (rows) to segments (columns)."""
    way = b - a
    share = ((points[:, None] - a) * way).sum(axis=-1) / np.maximum((way * way).sum(axis=-1), 1e-300)
    return np.hypot(*np.moveaxis(points[:, None] - (a + np.clip(share, 0, 1)[..., None] * way), -1, 0))


def concave_hull(points: Iterable[Point], concavity: float = CONCAVITY) -> np.ndarray | None:
    """A hull that is dug in, counter-clockwise (J03); None where there is no convex one.

    An edge gives way to its nearest inner point if it is over concavity times as long as the point is far from the nearer of its
    ends, and no other edge is nearer to the point: the larger the number, the closer to the convex hull.
    """
    points = list(map(tuple, points))
    ring = convex_hull(points)
    if ring is None:
        return None
    corners = list(map(tuple, ring))
    inner = sorted(set(points) - set(corners))
    todo, done = deque(zip(corners, corners[1:] + corners[:1])), []
    while todo and inner:
        a, b = todo.popleft()
        edges, p = np.array([(a, b), *todo, *done], float), np.array(inner, float)
        far = segment_distance(p, edges[:1, 0], edges[:1, 1])[:, 0]
        k = int(far.argmin())
        ends = min(np.hypot(*(p[k] - a)), np.hypot(*(p[k] - b)))
        if np.hypot(*np.subtract(b, a)) > concavity * ends and segment_distance(p[k : k + 1], edges[:, 0], edges[:, 1]).min() >= far[k]:
            c = inner.pop(k)
            todo.extendleft([(c, b), (a, c)])
        else:
            done.append((a, b))
    return np.array([a for a, _ in [*done, *todo]], float)


def densified(line: np.ndarray, step_m: float = DENSIFY_M) -> np.ndarray:
    """A polyline whose segments of over twice step_m are cut into equal parts of at least step_m."""
    out = []
    for a, b in zip(line[:-1], line[1:]):
        parts = max(1, int(np.hypot(*(b - a)) // step_m))
        out += [a + (b - a) * k / parts for k in range(parts)]
    return np.array([*out, line[-1]])


def platform_ring(track: np.ndarray, at: int) -> np.ndarray | None:
    """A closed strip on the left of a track beside its vertex number `at`.

    The track counts up to the first vertices that are 52 m or more along it from there, either way, or to its ends.
    """
    low = high = at
    along = 0.0
    while low > 0 and along < HALF_LENGTH_M:
        along += float(np.hypot(*(track[low] - track[low - 1])))
        low -= 1
    along = 0.0
    while high + 1 < len(track) and along < HALF_LENGTH_M:
        along += float(np.hypot(*(track[high + 1] - track[high])))
        high += 1
    part = densified(track[low : high + 1])
    if len(part) < 2:
        return None
    way = np.concatenate([part[1:], part[-1:]]) - np.concatenate([part[:1], part[:-1]])
    left = np.stack([-way[:, 1], way[:, 0]], axis=1) / np.maximum(np.hypot(way[:, 0], way[:, 1]), 1e-6)[:, None]
    near, far = part + GAP_M * left, part + (GAP_M + WIDTH_M) * left
    return np.concatenate([near, far[::-1], near[:1]])


def inside(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether points are in a ring, by crossings; for points on its border either answer may come."""
    a, b = ring[:, None], np.roll(ring, -1, axis=0)[:, None]
    spans = (a[..., 1] > points[:, 1]) != (b[..., 1] > points[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[..., 0] + (points[:, 1] - a[..., 1]) / (b[..., 1] - a[..., 1]) * (b[..., 0] - a[..., 0])
    return (spans & (at > points[:, 0])).sum(axis=0) % 2 == 1


def union(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Border rings of the union of simple rings: outer ones counter-clockwise, holes clockwise, all without closing points.

    Edges are cut where they meet, and those pieces are the border that have the union on one side only. They are
    followed with the union on the left, turning left as far as possible, so that parts that touch in a point stay apart.
    """
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    pieces = set()
    for p, q in zip(a, b):
        way, ways = q - p, b - a
        length2 = max(float(way @ way), 1e-300)
        den = _cross(way, ways)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = _cross(a - p, ways) / den, _cross(a - p, way) / den
        met = t[(den != 0) & (t > 0) & (t < 1) & (u >= -SNAP_M) & (u <= 1 + SNAP_M)]
        along = ((a - p) @ way) / length2
        on = np.abs(_cross(way, a - p)) / np.sqrt(length2) < SNAP_M
        cuts = np.sort(np.concatenate([[0.0, 1.0], met, along[on & (along > 0) & (along < 1)]]))
        places = [tuple(x) for x in np.round((p + cuts[:, None] * way) / SNAP_M).astype(np.int64).tolist()]
        pieces |= {(x, y) if x < y else (y, x) for x, y in zip(places, places[1:]) if x != y}
    ends = np.array(sorted(pieces), float) * SNAP_M
    way = ends[:, 1] - ends[:, 0]
    left = np.stack([-way[:, 1], way[:, 0]], axis=1) / np.hypot(way[:, 0], way[:, 1])[:, None] * SIDE_M
    middle = ends.mean(axis=1)
    sides = [np.any([inside(r, middle + k * left) for r in rings], axis=0) for k in (1, -1)]
    ahead: dict[tuple, list[tuple]] = {}
    for (x, y), is_left, is_right in zip(sorted(pieces), *sides):
        if is_left != is_right:
            x, y = (x, y) if is_left else (y, x)
            ahead.setdefault(x, []).append(y)
    out = []
    while ahead:
        start = now = next(iter(ahead))
        ring, came = [], None
        while True:
            options = ahead.get(now)
            if not options:
                break
            if came is None:
                to = options[0]
            else:
                to = max(options, key=lambda y: _turn(came, now, y))
            options.remove(to)
            if not options:
                del ahead[now]
            ring.append(now)
            came, now = now, to
            if now == start:
                break
        if len(ring) >= 3 and now == start:
            out.append(np.array(ring, float) * SNAP_M)
    return out


def _turn(came: tuple, now: tuple, to: tuple) -> float:
    """The angle of a turn, left positive."""
    (x0, y0), (x1, y1) = (now[0] - came[0], now[1] - came[1]), (to[0] - now[0], to[1] - now[1])
    return float(np.arctan2(x0 * y1 - y0 * x1, x0 * x1 + y0 * y1))


def centroid(ring: np.ndarray) -> np.ndarray:
    after = np.roll(ring, -1, axis=0)
    weight = _cross(ring, after)
    return ((ring + after) * weight[:, None]).sum(axis=0) / (3 * weight.sum())


def dissolve(hull: np.ndarray, strips: list[np.ndarray], stops: list[Point]) -> np.ndarray:
    """The hull joined with the strips that are partly outside it, as one outer ring.

    Strips that are not finite, inside the hull or wholly outside it leave it as it is (C23), and so does a union that is not sound, has
    the hull's centroid outside, or loses a stop. Holes are filled. Rings come and go without closing points.
    """
    if not is_simple(hull):
        return hull
    rings = [hull]
    for strip in strips:
        if len(strip) >= 3 and np.isfinite(strip).all():
            held = [covers(hull, p) for p in strip]
            if any(held) and not all(held) and is_simple(strip):
                rings.append(strip)
    if len(rings) == 1:
        return hull
    borders = union(rings)
    middle = tuple(centroid(hull))
    holes = [r for r in borders if _signed(r) < 0]
    best = next((r for r in borders if _signed(r) > 0 and covers(r, middle)), None)
    lost = lambda p: not covers(best, p) or any(covers(h, p) and not segment_distance(np.array([p], float), h, np.roll(h, -1, axis=0)).min() < SNAP_M for h in holes)
    if best is None or lost(middle) or not is_simple(best) or any(lost(s) for s in stops if not _beside(best, s)):
        return hull
    return best


def _signed(ring: np.ndarray) -> float:
    return float(_cross(ring, np.roll(ring, -1, axis=0)).sum()) / 2


def _beside(ring: np.ndarray, p: Point) -> bool:
    """Whether a point is on a ring's border, as near as cut edges are placed."""
    return bool(segment_distance(np.array([p], float), ring, np.roll(ring, -1, axis=0)).min() <= SNAP_M)


def station_hulls(points: DataFrame) -> DataFrame:
    """name, pos, x, y of each station's smoothed hull (J03, J05). points: name, x, y, is_stop."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        hull = concave_hull(zip(g.x, g.y))
        ring = np.zeros((0, 2)) if hull is None else smooth(hull, list(zip(g.x[g.is_stop], g.y[g.is_stop])))
        return pd.DataFrame({"name": [g.name.iloc[0]] * len(ring), "pos": range(len(ring)), "x": ring[:, 0], "y": ring[:, 1]})

    ship_package(points.sparkSession)
    return points.groupBy("name").applyInPandas(lambda g: one(g.rename(columns={"name": "name"})), "name string, pos int, x double, y double")


def line_features(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """GeoJSON features of lines (B05). lines: line_key, kind, route, ref, color, network, routable; shapes: line_key, way_id, points."""
    coords = shapes.groupBy("line_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("way_id", "points"))), lambda w: F.transform(w["points"], lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))
    properties = F.struct("kind", "route", F.col("ref").alias("line"), "color", "network", "routable")
    geometry = F.struct(F.lit("MultiLineString").alias("type"), "coordinates")
    return lines.join(coords, "line_key").select("line_key", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("feature"))
