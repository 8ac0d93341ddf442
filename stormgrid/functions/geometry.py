"""Points, polygons and grid cells as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = Sequence[tuple[float, float]]


def within(x: Column, y: Column, rings: Sequence[Ring]) -> Column:
    """Is the point inside the rings (even-odd, so inner rings are holes)? Points on an edge are not."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                at = F.lit(float(x1)) + (y - y1) * ((x2 - x1) / (y2 - y1))
                straddles = (y >= min(y1, y2)) & (y < max(y1, y2))
                crossings = crossings + F.when(straddles & (x < at), 1).otherwise(0)
            cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
            on_edge = on_edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return (crossings % 2 == 1) & ~on_edge


def meets_box(x: Column, y: Column, half: float, rings: Sequence[Ring]) -> Column:
    """Does the square of that half width around the point share a point with the polygon, edges included?

    It does if its centre is inside, or if an edge meets it: an edge misses a square
    only if their ranges in x or in y do not meet, or all four corners are on one
    side of the edge's line. A hole that holds the whole square leaves it out.
    """
    hit = within(x, y, rings)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            near = (x + half >= min(x1, x2)) & (x - half <= max(x1, x2)) & (y + half >= min(y1, y2)) & (y - half <= max(y1, y2))
            side = F.abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))
            hit = hit | (near & (side <= (abs(x2 - x1) + abs(y2 - y1)) * half))
    return hit


def within_column(x: Column, y: Column, rings: Column) -> Column:
    """The same against a column of rings: array<array<struct<x, y>>>."""

    def ring(acc: Column, r: Column) -> Column:
        n = F.size(r)

        def edge(a: Column, k: Column) -> Column:
            p, q = F.element_at(r, k), F.element_at(r, F.when(k == n, 1).otherwise(k + 1))
            at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
            hit = (y >= F.least(p["y"], q["y"])) & (y < F.greatest(p["y"], q["y"])) & (x < at)
            on = ((x - p["x"]) * (q["y"] - p["y"]) - (y - p["y"]) * (q["x"] - p["x"]) == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
            return F.struct((a["n"] + F.when(hit, 1).otherwise(0)).alias("n"), (a["on"] | on).alias("on"))

        return F.aggregate(F.sequence(F.lit(1), n), acc, edge)

    got = F.aggregate(rings, F.struct(F.lit(0).alias("n"), F.lit(False).alias("on")), ring)
    return (got["n"] % 2 == 1) & ~got["on"]


def pixel_centre(row: Column, col: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """Coordinates of a pixel's centre under an affine transform."""
    return F.lit(c) + (col + 0.5) * a + (row + 0.5) * b, F.lit(f) + (col + 0.5) * d + (row + 0.5) * e


def cell(value: Column, edge: float, width: float) -> Column:
    """Number of the cell of that width, half-open from the edge."""
    return F.floor((value - edge) / width).cast("int")


def in_box(x: Column, y: Column, box: tuple[float, float, float, float], half: float = 0.0) -> Column:
    """Cell centre in the box, inclusive; with `half` a cell's width, footprint and box overlap."""
    x0, y0, x1, y1 = box
    return (x + half >= x0) & (x - half <= x1) & (y + half >= y0) & (y - half <= y1)


def distance(dy: Column, dx: Column) -> Column:
    """Length of a step, in cells."""
    return F.hypot(dy, dx)
