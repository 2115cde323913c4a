"""Planar geometry over coordinates and ARRAY<STRUCT<x, y>> as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def heading(a: Column, b: Column) -> Column:
    return F.atan2(b["y"] - a["y"], b["x"] - a["x"])


def angle_between(first: Column, second: Column) -> Column:
    """Smaller angle between two headings, in [0, pi]."""
    gap = F.abs(first - second)
    return F.when(gap > F.pi(), 2 * F.pi() - gap).otherwise(gap)


def deviation(before: Column, centre: Column, after: Column) -> Column:
    return angle_between(heading(before, centre), heading(centre, after))


@dataclass(frozen=True)
class RadiusGuard:
    """Below these a turn counts as straight."""

    side: float
    area_squared: float


# The guards of the road-network and of the street-graph radius.
NETWORK_GUARD = RadiusGuard(side=1e-4, area_squared=0.0)
CURVATURE_GUARD = RadiusGuard(side=1e-9, area_squared=1e-16)


def circumradius(p: Column, q: Column, r: Column, guard: RadiusGuard) -> Column:
    """Radius of the circle through three points; Infinity for a straight or degenerate turn."""
    a, b, c = distance(p, q), distance(q, r), distance(r, p)
    s = (a + b + c) / 2
    squared = s * (s - a) * (s - b) * (s - c)
    straight = (F.least(a, b, c) < guard.side) | F.coalesce(squared <= guard.area_squared, F.lit(True))
    radius = (a * b * c) / F.nullif(4 * F.sqrt(F.greatest(squared, F.lit(0.0))), F.lit(0.0))
    return F.when(straight, F.lit(INFINITY)).otherwise(F.coalesce(radius, F.lit(INFINITY)))


def pieces(line: Column) -> Column:
    """Consecutive vertex pairs of a line as ARRAY<STRUCT<a, b>>, zero-length pieces left out."""

    def pairs(points):
        steps = F.greatest(F.size(points) - 1, F.lit(0))
        return F.zip_with(
            F.slice(points, F.lit(1), steps), F.slice(points, F.lit(2), steps),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        )

    return F.filter(let(line, pairs), lambda s: (s["a"]["x"] != s["b"]["x"]) | (s["a"]["y"] != s["b"]["y"]))


def line_length(line: Column) -> Column:
    return F.aggregate(pieces(line), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def _side(piece: Column, half: Column, sign: int) -> Column:
    """The two ends of a piece moved ``half`` to its right (sign 1) or left (sign -1)."""
    a, b = piece["a"], piece["b"]
    length = distance(a, b)
    nx, ny = (b["y"] - a["y"]) / length * half * sign, (a["x"] - b["x"]) / length * half * sign
    return F.array(point(a["x"] + nx, a["y"] + ny), point(b["x"] + nx, b["y"] + ny))


def ribbon(line: Column, width: Column) -> Column:
    """A line widened to a polygon ring: one side forward, the other side back; null if degenerate."""
    half = width / 2

    def ring(parts):
        near = F.flatten(F.transform(parts, lambda s: _side(s, half, 1)))
        far = F.reverse(F.flatten(F.transform(parts, lambda s: _side(s, half, -1))))
        return F.when((F.size(parts) > 0) & width.isNotNull(), F.concat(near, far))

    return let(pieces(line), ring)


def rectangle(a: Column, b: Column, width: Column) -> Column:
    """Closed form of ``ribbon`` for one straight piece (four corners)."""
    length = F.nullif(distance(a, b), F.lit(0.0))
    nx, ny = (b["y"] - a["y"]) / length * (width / 2), (a["x"] - b["x"]) / length * (width / 2)
    ring = F.array(
        point(a["x"] + nx, a["y"] + ny),
        point(b["x"] + nx, b["y"] + ny),
        point(b["x"] - nx, b["y"] - ny),
        point(a["x"] - nx, a["y"] - ny),
    )
    return F.when(nx.isNotNull(), ring)


def point_along(line: Column, metres: Column) -> Column:
    """The point ``metres`` along a line from its first vertex (clamped to the line)."""
    start = F.get(line, F.lit(0))
    state = F.struct(
        F.greatest(metres, F.lit(0.0)).alias("left"), start["x"].alias("x"), start["y"].alias("y")
    )

    def walk(acc, s):
        length = distance(s["a"], s["b"])
        share = F.least(acc["left"] / length, F.lit(1.0))
        return F.when(
            acc["left"] > 0,
            F.struct(
                F.greatest(acc["left"] - length, F.lit(0.0)).alias("left"),
                (s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * share).alias("x"),
                (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * share).alias("y"),
            ),
        ).otherwise(acc)

    end = F.aggregate(pieces(line), state, walk)
    return point(end["x"], end["y"])


def arm_point(line: Column, node: Column, reach: float) -> Column:
    """Point at ``reach`` from the end of ``line`` that lies at ``node``; halfway on shorter lines."""
    at_start = distance(F.get(line, F.lit(0)), node) < 1e-5

    def along(length):
        used = F.when(length < reach, length * 0.5).otherwise(F.lit(reach))
        return point_along(line, F.when(at_start, used).otherwise(length - used))

    return let(line_length(line), along)


def ring_sides(ring: Column) -> Column:
    """Sides of a ring (open or closed) as ARRAY<STRUCT<a, b>>."""

    def sides(points):
        rest = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
        turned = F.concat(rest, F.slice(points, F.lit(1), F.lit(1)))
        return F.zip_with(points, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(ring, sides)


def _crosses(side: Column, x: Column, y: Column) -> Column:
    a, b = side["a"], side["b"]
    spans = (a["y"] > y) != (b["y"] > y)
    return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])


def _touches(side: Column, x: Column, y: Column) -> Column:
    a, b = side["a"], side["b"]
    turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return (
        (turn == 0)
        & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    )


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether a ring encloses a point (an odd number of sides to its right)."""
    return F.size(F.filter(ring_sides(ring), lambda s: _crosses(s, x, y))) % 2 == 1


def covers(ring: Column, x: Column, y: Column) -> Column:
    """``contains``, or the point lies on the ring itself."""
    return let(
        ring_sides(ring),
        lambda sides: (F.size(F.filter(sides, lambda s: _crosses(s, x, y))) % 2 == 1)
        | F.exists(sides, lambda s: _touches(s, x, y)),
    )


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring."""
    double = F.aggregate(
        ring_sides(ring), F.lit(0.0), lambda acc, s: acc + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    )
    return F.abs(double) / 2


def _clip_half_plane(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    other = "y" if axis == "x" else "x"

    def inside(p):
        return p[axis] >= bound if keep_above else p[axis] <= bound

    def crossing(a, b):
        share = (bound - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        moved = a[other] + (b[other] - a[other]) * share
        return point(bound, moved) if axis == "x" else point(moved, bound)

    def emit(s):
        a, b = s["a"], s["b"]
        return (
            F.when(inside(a) & inside(b), F.array(point(b["x"], b["y"])))
            .when(inside(a), F.array(crossing(a, b)))
            .when(inside(b), F.array(crossing(a, b), point(b["x"], b["y"])))
            .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        )

    return F.flatten(F.transform(ring_sides(ring), emit))


def clip_to_box(ring: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Sutherland-Hodgman clip of a convex ring to a box; null when nothing is left."""
    out = _clip_half_plane(ring, "x", min_x, True)
    out = _clip_half_plane(out, "x", max_x, False)
    out = _clip_half_plane(out, "y", min_y, True)
    out = _clip_half_plane(out, "y", max_y, False)
    return let(out, lambda kept: F.when(F.size(kept) > 2, kept))
