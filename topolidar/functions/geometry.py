"""Plane geometry over rings and polylines: arrays of structs x, y. A polyline has an array of its own for each vertex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """Neighbouring vertices as structs a, b; the last vertex of an open ring is joined to the first."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")))


def area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def centroid(ring: Column) -> Column:
    """The centre of a ring's area as a struct x, y; of a ring without area the mean of its vertices."""
    weight = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    total = lambda f: F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + f(e))
    twice = total(weight)
    mean = lambda c: F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / F.size(ring)
    at = lambda c: F.coalesce(F.try_divide(total(lambda e: weight(e) * (e["a"][c] + e["b"][c])), 3 * twice), mean(c)).alias(c)
    return F.struct(at("x"), at("y"))


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Distance of a point to the segment from a to b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    px, py = x - a["x"] - t * dx, y - a["y"] - t * dy
    return F.sqrt(px * px + py * py)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule. What lies on an edge may fall on either side."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * F.try_divide(b["x"] - a["x"], b["y"] - a["y"]))

    return F.pmod(F.size(F.filter(edges(ring), crosses)), F.lit(2)) == 1


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    return F.array_min(F.transform(edges(ring), lambda e: segment_distance(x, y, e["a"], e["b"])))


def within(x: Column, y: Column, ring: Column, buffer: float = 0.0) -> Column:
    """Inside a ring or less than ``buffer`` from it; exact distances, where a polygonised buffer would cut its arcs."""
    return inside(x, y, ring) | (ring_distance(x, y, ring) < buffer) if buffer else inside(x, y, ring)


def line_edges(line: Column) -> Column:
    """Segments of a polyline of structs at, x, y (at: the distance so far, that orders it)."""
    return F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(F.get(line, i - 1).alias("a"), F.get(line, i).alias("b")))


def line_distance(x: Column, y: Column, line: Column) -> Column:
    return F.when(F.size(line) >= 2, F.array_min(F.transform(line_edges(line), lambda e: segment_distance(x, y, e["a"], e["b"]))))


def signed_crosstrack(x: Column, y: Column, line: Column) -> Column:
    """Distance to the polyline, positive to the left of the chord from its first vertex to its last; NULL below two vertices."""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return F.when(F.size(line) >= 2, line_distance(x, y, line) * F.when(cross < 0, -1.0).otherwise(1.0))


def projected_alongtrack(x: Column, y: Column, line: Column) -> Column:
    """The at of the nearest point of the polyline, interpolated on its segment; the first of equally near segments."""

    def near(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.struct(segment_distance(x, y, a, b).alias("d"), (a["at"] + t * (b["at"] - a["at"])).alias("at"))

    return F.when(F.size(line) >= 2, F.array_min(F.transform(line_edges(line), near))["at"])


def box(xs: tuple[Column, Column], ys: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((xs[0], ys[0]), (xs[1], ys[0]), (xs[1], ys[1]), (xs[0], ys[1]))))


def crossings(ring: Column, line: Column) -> Column:
    """How often a polyline properly crosses a ring."""

    def side(a: Column, b: Column, p: Column) -> Column:
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

    def crossed(e: Column) -> Column:
        hits = F.filter(line_edges(line), lambda s: (side(e["a"], e["b"], s["a"]) * side(e["a"], e["b"], s["b"]) < 0) & (side(s["a"], s["b"], e["a"]) * side(s["a"], s["b"], e["b"]) < 0))
        return F.size(hits)

    return F.aggregate(F.transform(edges(ring), crossed), F.lit(0), lambda s, n: s + n)
