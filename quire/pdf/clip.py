"""Clipping paths: flattened polygons with their rules, and on which side of them a glyph's box lies."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

#: Nearer than this to an edge counts as on it, and so as inside. Vertices beyond which a clip is no longer told, and points a side of the grid.
EDGE, LIMIT_VERTICES, GRID = 1e-6, 10_000, 9
Point = tuple[float, float]


def turn(a: Point, b: Point, p: Point) -> float:
    """Positive if p lies to the left of the line from a to b."""
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _edges(polygons: Sequence[Sequence[Point]]) -> Iterator[tuple[Point, Point]]:
    for polygon in polygons:
        if len(polygon) > 1:
            yield from zip(polygon, [*polygon[1:], polygon[0]], strict=True)


def _touches(a: Point, b: Point, p: Point) -> bool:
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = dx * dx + dy * dy
    t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / long)) if long else 0.0
    return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1]) <= EDGE


def _cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two segments cross at a point inside both."""
    return turn(c, d, a) * turn(c, d, b) < 0 and turn(a, b, c) * turn(a, b, d) < 0


def _within(corners: Sequence[Point], p: Point) -> bool:
    turns = [turn(a, b, p) for a, b in _edges([corners])]
    return all(t > 0 for t in turns) or all(t < 0 for t in turns)


@dataclass(frozen=True)
class Path:
    """Polygons, each closed, under the nonzero or the even-odd rule, and the box around them."""

    polygons: tuple
    rule: str
    box: tuple

    @property
    def upright(self) -> bool:
        """Whether it is one rectangle along the axes."""
        if len(self.polygons) != 1:
            return False
        corners = {(round(x, 9), round(y, 9)) for x, y in self.polygons[0]}
        b = [round(v, 9) for v in self.box]
        return corners == {(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])} and len(self.polygons[0]) in (4, 5)

    def holds(self, p: Point) -> bool:
        b = self.box
        if not (b[0] - EDGE <= p[0] <= b[2] + EDGE and b[1] - EDGE <= p[1] <= b[3] + EDGE):
            return False
        winds = 0
        for a, c in _edges(self.polygons):
            if _touches(a, c, p):
                return True
            if (a[1] <= p[1]) != (c[1] <= p[1]) and (turn(a, c, p) > 0) == (c[1] > p[1]):
                winds += 1 if c[1] > p[1] else -1
        return winds != 0 if self.rule == "nonzero" else winds % 2 == 1

    def side(self, corners: Sequence[Point]) -> str:
        """inside, outside or partial, for a box of four corners in order around it."""
        xs, ys = [p[0] for p in corners], [p[1] for p in corners]
        if min(xs) > self.box[2] or max(xs) < self.box[0] or min(ys) > self.box[3] or max(ys) < self.box[1]:
            return "outside"
        middle = (corners[0][0] + corners[2][0]) / 2, (corners[0][1] + corners[2][1]) / 2
        held = [self.holds(p) for p in (*corners, middle)]
        if len({*held}) > 1:
            return "partial"
        sides = [*_edges([corners])]
        for a, b in _edges(self.polygons):  # an edge may pass between points that agree
            half = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
            if _within(corners, a) or _within(corners, half) or any(_cross(*x, a, b) for x in sides):
                return "partial"
        return "inside" if held[0] else "outside"


@dataclass(frozen=True)
class Clip:
    """What all paths leave. box: around it, null where nothing is left or nothing is clipped yet; known: whether the paths were few enough."""

    paths: tuple = ()
    box: tuple | None = None
    vertices: int = 0

    @classmethod
    def of_box(cls, b: tuple) -> Clip:
        return cls().cut([[(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]], "nonzero")

    @property
    def upright(self) -> bool:
        return all(p.upright for p in self.paths) and self.vertices <= LIMIT_VERTICES

    def cut(self, polygons: Sequence[Sequence[Point]], rule: str) -> Clip:
        xs, ys = [p[0] for q in polygons for p in q], [p[1] for q in polygons for p in q]
        own = min(xs), min(ys), max(xs), max(ys)
        box = own
        if self.paths or self.vertices:
            box = (max(own[0], self.box[0]), max(own[1], self.box[1]), min(own[2], self.box[2]), min(own[3], self.box[3])) if self.box else None
            box = box if box and box[0] <= box[2] and box[1] <= box[3] else None
        n = self.vertices + len(xs)
        paths = () if n > LIMIT_VERTICES else (*self.paths, Path(tuple(map(tuple, polygons)), rule, own))
        return Clip(paths, box, n)

    def side(self, corners: Sequence[Point]) -> str:
        """inside, outside or partial; unknown past the limit of vertices. Several paths that each leave a part are tried on a grid of points together."""
        if self.vertices > LIMIT_VERTICES:
            return "unknown"
        found = [p.side(corners) for p in self.paths]
        if "outside" in found:
            return "outside"
        if "partial" not in found:
            return "inside"
        part = [p for p, f in zip(self.paths, found, strict=True) if f == "partial"]
        if len(part) > 1:
            (ax, ay), (bx, by), (cx, cy), (dx, dy) = corners
            steps = [k / (GRID - 1) for k in range(GRID)]
            grid = (((ax + (bx - ax) * u) * (1 - v) + (dx + (cx - dx) * u) * v, (ay + (by - ay) * u) * (1 - v) + (dy + (cy - dy) * u) * v) for u in steps for v in steps)
            if not any(all(p.holds(q) for p in part) for q in grid):
                return "outside"
        return "partial"
