"""Planar geometry as columns: points are structs (x, y), polygons closed rings of them.

Predicates and measures are column expressions evaluated in the JVM. What has no
closed expression (WKB decoding, convex hull, polygon clipping) is an Arrow
function over whole batches.
"""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(points: list[tuple[float, float]] | list[tuple[Column, Column]]) -> Column:
    """A closed ring from its corners."""
    cols = [F.array(*(c.cast("double") if isinstance(c, Column) else F.lit(float(c)) for c in p)) for p in points]
    return F.transform(F.array(*cols), lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def parse_wkt(text: str) -> list[tuple[float, float]]:
    """Corners of a POINT or POLYGON text."""
    kind, _, body = text.strip().partition("(")
    pairs = [tuple(map(float, p.split())) for p in re.sub(r"[()]", " ", body).split(",")]
    if kind.strip().upper() not in ("POINT", "POLYGON") or any(len(p) != 2 for p in pairs):
        raise ValueError(f"not a planar point or polygon: {text!r}")
    return pairs


def wkt(text: str) -> Column:
    """A literal of a WKT text."""
    corners = parse_wkt(text)
    return point(F.lit(corners[0][0]), F.lit(corners[0][1])) if len(corners) == 1 else ring(corners)


def encode_wkb(corners: list[tuple[float, float]]) -> bytes:
    """WKB of a point (one corner) or a polygon (a closed ring)."""
    if len(corners) == 1:
        return struct.pack("<BI2d", 1, 1, *corners[0])
    return struct.pack("<BIII", 1, 3, 1, len(corners)) + b"".join(struct.pack("<2d", *c) for c in corners)


def _decode(raw: bytes | None) -> list[dict] | None:
    if raw is None:
        return None
    order = "<" if raw[0] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", raw, 1)
    if kind == 1:
        at, n = 5, 1
    elif kind == 3:
        rings, n = struct.unpack_from(order + "II", raw, 5)
        if rings != 1:
            raise ValueError("polygons with holes are not supported")
        at = 13
    else:
        raise ValueError(f"WKB kind {kind} is not supported")
    xy = np.frombuffer(raw, order + "f8", 2 * n, at).reshape(-1, 2)
    return [{"x": float(x), "y": float(y)} for x, y in xy]


_RING_ARROW = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def from_wkb(wkb: Column) -> Column:
    """Corners of a WKB point or polygon; decode once at load, not per query."""
    return F.arrow_udf(lambda batch: pa.array([_decode(b) for b in batch.to_pylist()], _RING_ARROW), RING)(wkb)


def st_x(p: Column) -> Column:
    return p["x"]


def st_y(p: Column) -> Column:
    return p["y"]


def distance(a: Column, b: Column) -> Column:
    """Point to point."""
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def line_length(a: Column, b: Column) -> Column:
    return distance(a, b)


def _edges(r: Column) -> Column:
    return F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def on_boundary(p: Column, r: Column) -> Column:
    def touches(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) - (e["by"] - e["ay"]) * (p["x"] - e["ax"])
        return (cross == 0) & p["x"].between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & p["y"].between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    return F.exists(_edges(r), touches)


def is_box(r: Column) -> Column:
    """Whether a ring is an axis-parallel box given by five corners; its measures then need two corners only."""
    c = [F.get(r, F.lit(i)) for i in range(5)]
    turns = lambda u, v: (c[0][u] == c[1][u]) & (c[1][v] == c[2][v]) & (c[2][u] == c[3][u]) & (c[3][v] == c[0][v])
    closed = (F.size(r) == 5) & (c[0]["x"] == c[4]["x"]) & (c[0]["y"] == c[4]["y"])
    return F.coalesce(closed & (turns("x", "y") | turns("y", "x")), F.lit(False))


def frame(r: Column) -> Column:
    """Bounds of a ring that is a box, else null; computed once a polygon, it spares each pair the general test."""
    return F.when(is_box(r), bounds(r))


def in_box(p: Column, b: Column, strict: bool) -> Column:
    """Point inside a box, on its boundary too unless ``strict``."""
    if strict:
        return (p["x"] > b["x0"]) & (p["x"] < b["x1"]) & (p["y"] > b["y0"]) & (p["y"] < b["y1"])
    return p["x"].between(b["x0"], b["x1"]) & p["y"].between(b["y0"], b["y1"])


def box_distance(p: Column, b: Column) -> Column:
    """Point to box; 0 inside."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(b["x0"] - p["x"], zero, p["x"] - b["x1"]), F.greatest(b["y0"] - p["y"], zero, p["y"] - b["y1"])
    return F.sqrt(dx * dx + dy * dy)


def _crossings_odd(p: Column, r: Column) -> Column:
    def crosses(n: Column, e: Column) -> Column:
        spans = (e["ay"] > p["y"]) != (e["by"] > p["y"])
        at = (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        return n + F.when(spans & (p["x"] < at), 1).otherwise(0)

    return F.aggregate(_edges(r), F.lit(0), crosses) % 2 == 1


def within(p: Column, r: Column) -> Column:
    """Point strictly inside the polygon."""
    return _crossings_odd(p, r) & ~on_boundary(p, r)


def intersects(p: Column, r: Column) -> Column:
    """Point inside the polygon or on its boundary."""
    return _crossings_odd(p, r) | on_boundary(p, r)


def area(r: Column) -> Column:
    """Shoelace area."""
    return F.abs(F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def polygon_distance(p: Column, r: Column) -> Column:
    """Point to polygon; 0 inside."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        t = ((p["x"] - e["ax"]) * dx + (p["y"] - e["ay"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))
        ex, ey = p["x"] - (e["ax"] + t * dx), p["y"] - (e["ay"] + t * dy)
        return F.sqrt(ex * ex + ey * ey)

    return F.when(intersects(p, r), 0.0).otherwise(F.array_min(F.transform(_edges(r), to_edge)))


def bounds(r: Column) -> Column:
    """Struct (x0, y0, x1, y1) of a ring."""
    xs, ys = F.transform(r, lambda c: c["x"]), F.transform(r, lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull corners, counter-clockwise (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(points.tolist()) + half(points[::-1].tolist()))


def _shoelace(c: np.ndarray) -> float:
    if len(c) < 3:
        return 0.0
    x, y = c[:, 0], c[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _rings(column: pa.Array) -> list[np.ndarray | None]:
    flat, valid = column.flatten(), column.is_valid().to_numpy(zero_copy_only=False)
    xy = np.column_stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)]).astype(float).reshape(-1, 2)
    ends = np.cumsum(np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)).tolist()
    return [xy[a:b] if v else None for v, a, b in zip(valid.tolist(), [0, *ends], ends)]


def hull_area(points: Column) -> Column:
    """Area of the convex hull of an array of points."""
    return F.arrow_udf(lambda batch: pa.array([None if r is None else abs(_shoelace(hull(r))) for r in _rings(batch)], pa.float64()), T.DoubleType())(points)


def _clip(subject: list, a, b) -> list:
    """Part of a convex polygon on the left of the line a-b."""
    out = []
    side = lambda q: (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])
    for p, q in zip(subject, subject[1:] + subject[:1]):
        sp, sq = side(p), side(q)
        if sp >= 0:
            out.append(p)
        if (sp > 0 > sq) or (sp < 0 < sq):
            t = sp / (sp - sq)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def overlap_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area of the intersection of two simple polygons.

    Each polygon is a signed sum of triangles of a fan from its first corner, and
    the area of an intersection is additive in both.
    """

    def fan(c: np.ndarray):
        for i in range(1, len(c) - 1):
            t = np.array([c[0], c[i], c[i + 1]])
            s = _shoelace(t)
            if s:
                yield math.copysign(1, s), (t if s > 0 else t[::-1]).tolist()

    fp, fq = (list(fan(c[:-1] if len(c) > 1 and (c[0] == c[-1]).all() else c)) for c in (p, q))
    total = 0.0
    for sp, tp in fp:
        for sq, tq in fq:
            part = [tuple(c) for c in tp]
            for a, b in zip(tq, tq[1:] + tq[:1]):
                part = _clip(part, a, b) if part else part
            total += sp * sq * _shoelace(np.array(part)) if len(part) > 2 else 0.0
    signs = [math.copysign(1, _shoelace(c[:-1])) if len(c) > 3 else 1 for c in (p, q)]
    return abs(total * signs[0] * signs[1])


def intersection_area(a: Column, b: Column, frame_a: Column | None = None, frame_b: Column | None = None) -> Column:
    """Area of the intersection of two polygons; ``frame`` of both, if given, takes box pairs off the Python path."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else overlap_area(p, q) for p, q in zip(_rings(x), _rings(y))], pa.float64())

    general = F.arrow_udf(run, T.DoubleType())
    if frame_a is None or frame_b is None:
        return general(a, b)
    side = lambda i: F.greatest(F.least(frame_a[i + "1"], frame_b[i + "1"]) - F.greatest(frame_a[i + "0"], frame_b[i + "0"]), F.lit(0.0))
    both = frame_a.isNotNull() & frame_b.isNotNull()
    # Two boxes reach the Python worker as nulls.
    return F.when(both, side("x") * side("y")).otherwise(general(F.when(~both, a), F.when(~both, b)))


def _touch(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two polygons share a point."""
    a, b, c, d = p[:-1, None], p[1:, None], q[None, :-1], q[None, 1:]
    turn = lambda u, v, w: np.sign((v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0]))
    inside = lambda u, v, w: (np.minimum(u, v) <= w).all(-1) & (w <= np.maximum(u, v)).all(-1)
    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    if ((t1 * t2 < 0) & (t3 * t4 < 0)).any():
        return True
    for t, u, v, w in ((t1, a, b, c), (t2, a, b, d), (t3, c, d, a), (t4, c, d, b)):
        if ((t == 0) & inside(u, v, w)).any():
            return True

    def holds(r: np.ndarray, w: np.ndarray) -> bool:
        x0, y0, x1, y1 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
        cross = (y0 > w[1]) != (y1 > w[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            return bool((cross & (w[0] < (x1 - x0) * (w[1] - y0) / (y1 - y0) + x0)).sum() % 2)

    return holds(p, q[0]) or holds(q, p[0])


def polygons_intersect(a: Column, b: Column, frame_a: Column | None = None, frame_b: Column | None = None) -> Column:
    """Whether two polygons share a point; ``frame`` of both, if given, takes box pairs off the Python path."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else _touch(p, q) for p, q in zip(_rings(x), _rings(y))], pa.bool_())

    general = F.arrow_udf(run, T.BooleanType())
    if frame_a is None or frame_b is None:
        return general(a, b)
    meet = (frame_a["x0"] <= frame_b["x1"]) & (frame_b["x0"] <= frame_a["x1"]) & (frame_a["y0"] <= frame_b["y1"]) & (frame_b["y0"] <= frame_a["y1"])
    both = frame_a.isNotNull() & frame_b.isNotNull()
    return F.when(both, meet).otherwise(general(F.when(~both, a), F.when(~both, b)))
