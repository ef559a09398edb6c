"""Shapes of a query on the driver, and the SQL expressions that test table columns against them.

Angles are degrees, lengths metres on a sphere of radius ``EARTH``. Expressions are strings for F.expr, so they
stay inside generated code. A box is given by four column names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import asin, atan2, cos, degrees, radians, sin, sqrt

EARTH = 6_371_000.0
Point = tuple[float, float]  # latitude, longitude
BOX = ("min_lat", "max_lat", "min_lon", "max_lon")


def box_columns(prefix: str = "") -> tuple[str, str, str, str]:
    return tuple(prefix + c for c in BOX)


# ---- on the driver


def distance(a: Point, b: Point) -> float:
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH * asin(min(1.0, sqrt(h)))


def bearing(a: Point, b: Point) -> float:
    """Degrees from north, 0 to 360."""
    lat1, lat2, d = radians(a[0]), radians(b[0]), radians(b[1] - a[1])
    return degrees(atan2(sin(d) * cos(lat2), cos(lat1) * sin(lat2) - sin(lat1) * cos(lat2) * cos(d))) % 360


def destination(a: Point, angle: float, length: float) -> Point:
    lat, turn, arc = radians(a[0]), radians(angle), length / EARTH
    end = asin(sin(lat) * cos(arc) + cos(lat) * sin(arc) * cos(turn))
    lon = radians(a[1]) + atan2(sin(turn) * sin(arc) * cos(lat), cos(arc) - sin(lat) * sin(end))
    return degrees(end), degrees(lon)


def middle(a: Point, b: Point) -> Point:
    lat1, lat2, d = radians(a[0]), radians(b[0]), radians(b[1] - a[1])
    x, y = cos(lat2) * cos(d), cos(lat2) * sin(d)
    return degrees(atan2(sin(lat1) + sin(lat2), sqrt((cos(lat1) + x) ** 2 + y * y))), degrees(radians(a[1]) + atan2(y, cos(lat1) + x))


def clipped(points: Iterable[Point]) -> list[Point]:
    return [(min(90.0, max(-90.0, lat)), min(180.0, max(-180.0, lon))) for lat, lon in points]


def hull(points: Iterable[Point]) -> list[Point]:
    """Convex hull: the lower and the upper chain of the sorted points."""
    ordered = sorted(set(points))

    def chain(some: Iterable[Point]) -> list[Point]:
        out: list[Point] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    if len(ordered) < 3:
        return ordered
    return chain(ordered)[:-1] + chain(reversed(ordered))[:-1]


def _number(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# ---- expressions


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Metres between two points given as expressions."""
    h = f"(POWER(SIN(RADIANS(({lat2})-({lat1}))/2),2)+COS(RADIANS({lat1}))*COS(RADIANS({lat2}))*POWER(SIN(RADIANS(({lon2})-({lon1}))/2),2))"
    return f"({2 * EARTH:.1f}E0*ASIN(LEAST(1E0,SQRT({h}))))"


def boxes_meet(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Closed boxes share a point."""
    return f"({a[0]}<={b[1]} AND {b[0]}<={a[1]} AND {a[2]}<={b[3]} AND {b[2]}<={a[3]})"


def segment_meets_box(p: tuple[str, str], q: tuple[str, str], box: tuple[str, ...]) -> str:
    """The segment has a point in the closed box: their boxes meet, and the box isn't on one side of the segment's line."""
    own = (f"LEAST({p[0]},{q[0]})", f"GREATEST({p[0]},{q[0]})", f"LEAST({p[1]},{q[1]})", f"GREATEST({p[1]},{q[1]})")
    sides = [f"(({q[0]}-{p[0]})*({box[k]}-{p[1]})-({q[1]}-{p[1]})*({box[j]}-{p[0]}))" for j in (0, 1) for k in (2, 3)]
    return f"({boxes_meet(own, box)} AND LEAST({','.join(sides)})<=0 AND GREATEST({','.join(sides)})>=0)"


@dataclass(frozen=True)
class Rect:
    """A closed box on the driver."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float

    @classmethod
    def around(cls, points: Iterable[Point]) -> Rect:
        lats, lons = zip(*points)
        return cls(min(lats), max(lats), min(lons), max(lons))

    @classmethod
    def square(cls, centre: Point, radius: float) -> Rect:
        """That reaches radius metres to each side."""
        d = degrees(radius / EARTH)
        e = d / max(0.01, cos(radians(centre[0])))
        return cls(centre[0] - d, centre[0] + d, centre[1] - e, centre[1] + e)

    def grown(self, metres: float) -> Rect:
        """By at least so many metres to each side."""
        d = degrees(metres / EARTH)
        e = d / max(0.01, cos(radians(min(90.0, max(abs(self.min_lat), abs(self.max_lat)) + d))))
        return Rect(self.min_lat - d, self.max_lat + d, self.min_lon - e, self.max_lon + e)

    @property
    def centre(self) -> Point:
        return (self.min_lat + self.max_lat) / 2, (self.min_lon + self.max_lon) / 2

    @property
    def diagonal(self) -> float:
        return distance((self.min_lat, self.min_lon), (self.max_lat, self.max_lon))

    @property
    def corners(self) -> list[Point]:
        return [(self.min_lat, self.min_lon), (self.max_lat, self.min_lon), (self.max_lat, self.max_lon), (self.min_lat, self.max_lon)]

    @property
    def box(self) -> Rect:
        return self

    @property
    def first(self) -> Point:
        return self.min_lat, self.min_lon

    @property
    def length(self) -> float:
        return sum(distance(a, b) for a, b in zip(self.corners, self.corners[1:] + self.corners[:1]))

    def _values(self) -> tuple[str, ...]:
        return tuple(map(_number, (self.min_lat, self.max_lat, self.min_lon, self.max_lon)))

    def contains(self, lat: str, lon: str) -> str:
        a = self._values()
        return f"({lat} BETWEEN {a[0]} AND {a[1]} AND {lon} BETWEEN {a[2]} AND {a[3]})"

    def meets_box(self, box: tuple[str, ...]) -> str:
        return boxes_meet(self._values(), box)

    def encloses_box(self, box: tuple[str, ...]) -> str:
        a = self._values()
        return f"({a[0]}<={box[0]} AND {box[1]}<={a[1]} AND {a[2]}<={box[2]} AND {box[3]}<={a[3]})"

    def meets_segment(self, p: tuple[str, str], q: tuple[str, str]) -> str:
        return segment_meets_box(p, q, self._values())

    def touches(self, box: Rect) -> bool:
        """On the driver: the closed boxes share a point."""
        return self.min_lat <= box.max_lat and box.min_lat <= self.max_lat and self.min_lon <= box.max_lon and box.min_lon <= self.max_lon


@dataclass(frozen=True)
class Polygon:
    """A simple polygon on the driver, closed by itself."""

    points: tuple[Point, ...]

    @property
    def box(self) -> Rect:
        return Rect.around(self.points)

    @property
    def first(self) -> Point:
        return self.points[0]

    @property
    def edges(self) -> list[tuple[Point, Point]]:
        return list(zip(self.points, self.points[1:] + self.points[:1]))

    @property
    def length(self) -> float:
        return sum(distance(a, b) for a, b in self.edges)

    def contains(self, lat: str, lon: str) -> str:
        """Ray casting: an odd number of edges lies east of the point."""
        crossed = []
        for (lat1, lon1), (lat2, lon2) in self.edges:
            if lat1 == lat2:
                continue
            slope = (lon2 - lon1) / (lat2 - lat1)
            low, high = min(lat1, lat2), max(lat1, lat2)
            crossed.append(f"(CASE WHEN {lat}>={_number(low)} AND {lat}<{_number(high)} AND {lon}<{_number(slope)}*({lat}-{_number(lat1)})+{_number(lon1)} THEN 1 ELSE 0 END)")
        return f"(({'+'.join(crossed) or '0'})%2=1)"

    def _edge_meets_box(self, box: tuple[str, ...]) -> str:
        return "(" + " OR ".join(segment_meets_box(tuple(map(_number, a)), tuple(map(_number, b)), box) for a, b in self.edges) + ")"

    def meets_box(self, box: tuple[str, ...]) -> str:
        """An edge has a point in the box, or the box lies inside."""
        return f"({self.box.meets_box(box)} AND ({self.contains(box[0], box[2])} OR {self._edge_meets_box(box)}))"

    def encloses_box(self, box: tuple[str, ...]) -> str:
        return f"({self.contains(box[0], box[2])} AND NOT {self._edge_meets_box(box)})"

    def meets_segment(self, p: tuple[str, str], q: tuple[str, str]) -> str:
        """An end lies inside, or an edge crosses or touches."""
        tests = [self.contains(*p), self.contains(*q)]
        for a, b in self.edges:
            a, b = tuple(map(_number, a)), tuple(map(_number, b))
            side = lambda u, v, w: f"SIGN(({v[0]}-{u[0]})*({w[1]}-{u[1]})-({v[1]}-{u[1]})*({w[0]}-{u[0]}))"
            own = lambda u, v: (f"LEAST({u[0]},{v[0]})", f"GREATEST({u[0]},{v[0]})", f"LEAST({u[1]},{v[1]})", f"GREATEST({u[1]},{v[1]})")
            tests.append(f"({boxes_meet(own(p, q), own(a, b))} AND {side(p, q, a)}*{side(p, q, b)}<=0 AND {side(a, b, p)}*{side(a, b, q)}<=0)")
        return "(" + " OR ".join(tests) + ")"

    def touches(self, box: Rect) -> bool:
        """On the driver: a box shares a point with the polygon. Boxes within rounding of it count."""
        slack = 1e-9
        box = Rect(box.min_lat - slack, box.max_lat + slack, box.min_lon - slack, box.max_lon + slack)
        if not self.box.touches(box):
            return False
        lat, lon = box.first
        turns = sum((a[0] <= lat) != (b[0] <= lat) and lon < a[1] + (lat - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in self.edges)
        if turns % 2:
            return True
        for a, b in self.edges:
            sides = [(b[0] - a[0]) * (o - a[1]) - (b[1] - a[1]) * (p - a[0]) for p, o in box.corners]
            if Rect.around((a, b)).touches(box) and min(sides) <= 0 <= max(sides):
                return True
        return False


Shape = Rect | Polygon
