"""Spherical geometry as Spark SQL text. Angles are in degrees, shapes include their boundary.

A box is an interval of longitude and latitude around its centre. Where a box meets a polygon it is taken as the polygon of
its corners. Polygons have great-circle edges and lie within a hemisphere; the centroid of a polygon is the direction of
the mean of its corners.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from aquila.functions.stcs import FLAVORS, FRAMES, POSITIONS, Region


def _number(sql: str) -> float | None:
    try:
        return float(sql.strip("()").removesuffix("D"))
    except ValueError:
        return None


Edge = Callable[[tuple[str, str], tuple[str, str]], str]
#: All pairs of kinds would make an expression too large for Catalyst.
_TWO_COLUMNS = "whether a region of a column meets or holds that of another column is not supported"


@dataclass(frozen=True)
class Shape:
    """kind: point, circle, box, polygon, union, intersection, not, stored (a column with a region's text) or ring (a polygon
    of such a column). parts: SQL of its numbers, or of its text; of a ring the SQL of an array of its numbers, and the name of
    the variable that goes over its edges. system: SQL of its coordinate system's text."""

    kind: str
    parts: tuple[str, ...] = ()
    inner: tuple[Shape, ...] = ()
    system: str = "''"

    @property
    def centre(self) -> tuple[str, str]:
        if self.kind == "stored":
            return by_stored_kind(self, "i", lambda s: s.centre[0]), by_stored_kind(self, "i", lambda s: s.centre[1])
        if self.kind in ("polygon", "ring"):
            x, y, z = (_total(self, lambda a, _, i=i: unit(*a)[i]) for i in range(3))
            return f"pmod(degrees(atan2({y}, {x})), 360D)", f"degrees(atan2({z}, sqrt({x}*{x} + {y}*{y})))"
        return self.parts[0], self.parts[1]

    @property
    def corners(self) -> list[tuple[str, str]]:
        if self.kind == "box":
            lon, lat, w, h = self.parts
            return [(f"({lon} {a} {w} / 2D)", f"({lat} {b} {h} / 2D)") for a, b in ("--", "+-", "++", "-+")]
        return list(zip(self.parts[::2], self.parts[1::2]))


def from_region(r: Region) -> Shape:
    kind = {"POSITION": "point"}.get(r.kind, r.kind.lower())
    return Shape(kind, tuple(f"({x!r}D)" for x in r.numbers), tuple(map(from_region, r.inner)), f"'{r.system.text()}'")


def unit(lon: str, lat: str) -> tuple[str, str, str]:
    return f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"


def distance(a: tuple[str, str], b: tuple[str, str]) -> str:
    """Great-circle distance by the haversine formula."""
    half_lat, half_lon = f"sin(radians({b[1]} - {a[1]}) / 2D)", f"sin(radians({b[0]} - {a[0]}) / 2D)"
    return f"degrees(2D * asin(least(1D, sqrt({half_lat} * {half_lat} + cos(radians({a[1]})) * cos(radians({b[1]})) * {half_lon} * {half_lon}))))"


def _lon_apart(a: str, b: str) -> str:
    return f"abs(pmod({a} - {b} + 180D, 360D) - 180D)"


def _cross(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))


def _dot(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b)) + ")"


def _edges(s: Shape) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    c = s.corners
    return list(zip(c, c[1:] + c[:1]))


def _ring_edge(s: Shape) -> tuple[str, tuple[str, str], tuple[str, str]]:
    """The numbers of a ring's edges, and the corners of the one that its variable names."""
    numbers, v = s.parts
    n = f"CAST(size({numbers}) / 2 AS INT)"
    corner = lambda i: (f"element_at({numbers}, 2 * {i} + 1)", f"element_at({numbers}, 2 * {i} + 2)")
    return f"sequence(0, {n} - 1)", corner(v), corner(f"(({v} + 1) % {n})")


def _each(s: Shape, holds: Edge, word: str = "forall") -> str:
    """SQL boolean: the condition holds for all edges (forall) or for one (exists)."""
    if s.kind == "ring":
        all_, a, b = _ring_edge(s)
        return f"{word}({all_}, {s.parts[1]} -> {holds(a, b)})"
    return (_all if word == "forall" else _any)([holds(a, b) for a, b in _edges(s)])


def _total(s: Shape, value: Edge) -> str:
    if s.kind == "ring":
        all_, a, b = _ring_edge(s)
        return f"aggregate({all_}, 0D, (sum, {s.parts[1]}) -> sum + {value(a, b)})"
    return "(" + " + ".join(value(a, b) for a, b in _edges(s)) + ")"


def _first(s: Shape) -> Shape:
    """A corner."""
    return Shape("point", tuple(f"element_at({s.parts[0]}, {i})" for i in (1, 2)) if s.kind == "ring" else s.corners[0])


def _arc_distance(p: tuple[str, str], a: tuple[str, str], b: tuple[str, str]) -> str:
    """From a point to the great-circle arc a b."""
    u, v, w = unit(*p), unit(*a), unit(*b)
    normal = _cross(v, w)
    size = f"sqrt({_dot(normal, normal)})"
    between = f"{_dot(_cross(normal, v), u)} >= 0 AND {_dot(_cross(w, normal), u)} >= 0"
    return f"(CASE WHEN {size} > 0 AND {between} THEN degrees(asin(least(1D, abs({_dot(normal, u)}) / {size}))) ELSE least({distance(p, a)}, {distance(p, b)}) END)"


def _point_in_polygon(p: tuple[str, str], s: Shape) -> str:
    """The edges' angles seen from the point sum to a full turn inside; points on an edge belong to the polygon."""
    u = unit(*p)

    def angle(a: tuple[str, str], b: tuple[str, str]) -> str:
        v, w = unit(*a), unit(*b)
        return f"atan2({_dot(u, _cross(v, w))}, {_dot(v, w)} - {_dot(v, u)} * {_dot(w, u)})"

    near = f"{_total(s, lambda a, _: _dot(u, unit(*a)))} > 0"
    return f"({near} AND (abs({_total(s, angle)}) > pi() OR {_each(s, lambda a, b: f'{_arc_distance(p, a, b)} <= 1e-11D', 'exists')}))"


def stored(text: str) -> Shape:
    """Of a column with a region as text; its system is among the words after the first."""
    words = ", ".join(f"'{w}'" for w in FRAMES + POSITIONS + FLAVORS)
    return Shape("stored", (text,), system=f"array_join(filter(split(upper(trim({text})), ' +'), w -> w IN ({words})), ' ')")


def by_stored_kind(s: Shape, variable: str, what: Callable[[Shape], str]) -> str:
    """What holds for the shape that a column's text tells; compound ones are errors when they are met. The text is taken apart
    once a row. variable: for the edges of its polygon, another one for each column that an expression reads."""
    text, n = s.parts[0], f"n{variable}"
    kind = f"element_at(split(upper(trim({text})), ' +'), 1)"
    words = f"CASE WHEN {kind} IN ('POSITION', 'CIRCLE', 'BOX', 'POLYGON') THEN split(trim({text}), ' +') END"
    numbers = f"transform(filter({words}, w -> w RLIKE '^[-+.0-9]'), w -> CAST(w AS DOUBLE))"
    at = [f"element_at({n}, {i})" for i in range(1, 5)]
    shapes = {"POSITION": Shape("point", tuple(at[:2])), "CIRCLE": Shape("circle", tuple(at[:3])), "BOX": Shape("box", tuple(at)), "POLYGON": Shape("ring", (n, variable))}
    whens = " ".join(f"WHEN '{k}' THEN {what(shape)}" for k, shape in shapes.items())
    case = f"CASE {kind} {whens} ELSE CASE WHEN {text} IS NOT NULL THEN raise_error(concat('not supported in a column: ', {text})) END END"
    return f"element_at(transform(array({numbers}), {n} -> {case}), 1)"


def _any(items: list[str]) -> str:
    return "(" + " OR ".join(items) + ")"


def _all(items: list[str]) -> str:
    return "(" + " AND ".join(items) + ")"


def _to_box(p: tuple[str, str], s: Shape) -> str:
    """Distance from a point to a box: 0 inside, along the meridian above or below, else to the nearer side."""
    lon, lat, w, h = s.parts
    low, high = f"({lat} - {h} / 2D)", f"({lat} + {h} / 2D)"
    apart = f"greatest(0D, {_lon_apart(p[0], lon)} - {w} / 2D)"
    foot = f"least({high}, greatest({low}, degrees(atan2(sin(radians({p[1]})), cos(radians({p[1]})) * cos(radians({apart}))))))"
    return f"(CASE WHEN {apart} = 0D THEN abs({p[1]} - least({high}, greatest({low}, {p[1]}))) ELSE {distance((apart, p[1]), ('0D', foot))} END)"


def _edges_cross(a: Shape, b: Shape, most: str = "<= 0") -> str:
    """An edge of the one crosses or touches one of the other; with a smaller ``most`` only if they cross."""

    def crosses(p: tuple[str, str], q: tuple[str, str], r: tuple[str, str], s: tuple[str, str]) -> str:
        n, m = _cross(unit(*p), unit(*q)), _cross(unit(*r), unit(*s))
        return f"({_dot(n, unit(*r))} * {_dot(n, unit(*s))} {most} AND {_dot(m, unit(*p))} * {_dot(m, unit(*q))} {most} AND {_dot(unit(*p), unit(*r))} > 0)"

    return _each(a, lambda p, q: _each(b, lambda r, s: crosses(p, q, r, s), "exists"), "exists")


def contains(inner: Shape, outer: Shape) -> str:
    """SQL boolean: the first shape lies wholly in the second."""
    if outer.kind == "intersection":
        return _all([contains(inner, s) for s in outer.inner])
    if outer.kind == "not":
        return f"(NOT {intersects(inner, outer.inner[0])})"
    if outer.kind == "union":
        return _any([contains(inner, s) for s in outer.inner])
    if inner.kind == "union":
        return _all([contains(s, outer) for s in inner.inner])
    if inner.kind == outer.kind == "stored":
        raise ValueError(_TWO_COLUMNS)
    if inner.kind == "stored":
        return by_stored_kind(inner, "i", lambda s: contains(s, outer))
    if outer.kind == "stored":
        return by_stored_kind(outer, "j", lambda s: contains(inner, s))
    if inner.kind in ("intersection", "not"):
        raise ValueError(f"whether a region of kind {inner.kind} lies in another is not supported")
    c = inner.centre if inner.kind in ("point", "circle") else ("", "")
    match inner.kind, outer.kind:
        case "point", "point":
            return f"({distance(c, outer.centre)} = 0D)"
        case "point", "circle":
            return f"({_near(c, outer)}{distance(c, outer.centre)} <= {outer.parts[2]})"
        case "point", "box":
            lon, lat, w, h = outer.parts
            return f"({c[1]} BETWEEN {lat} - {h} / 2D AND {lat} + {h} / 2D AND {_lon_apart(c[0], lon)} <= {w} / 2D)"
        case "point", "polygon" | "ring":
            return _point_in_polygon(c, outer)
        case _, "point":
            return "false"
        case "circle", "circle":
            return f"({distance(c, outer.centre)} + {inner.parts[2]} <= {outer.parts[2]})"
        case "circle", "box":
            lon, lat, w, h = outer.parts
            r = inner.parts[2]
            return f"({c[1]} - {r} >= {lat} - {h} / 2D AND {c[1]} + {r} <= {lat} + {h} / 2D AND {_lon_apart(c[0], lon)} + degrees(asin(least(1D, sin(radians({r})) / greatest(1e-12D, cos(radians({c[1]})))))) <= {w} / 2D)"
        case "circle", "polygon" | "ring":
            return _all([_point_in_polygon(c, outer), _each(outer, lambda a, b: f"{_arc_distance(c, a, b)} >= {inner.parts[2]}")])
        case "box", "box":
            return f"({_lon_apart(inner.parts[0], outer.parts[0])} + {inner.parts[2]} / 2D <= {outer.parts[2]} / 2D AND abs({inner.parts[1]} - {outer.parts[1]}) + {inner.parts[3]} / 2D <= {outer.parts[3]} / 2D)"
    inside = _each(inner, lambda a, _: contains(Shape("point", a), outer))
    return inside if outer.kind in ("circle", "box") else _all([inside, f"NOT {_edges_cross(inner, outer, '< -1e-24D')}"])


def intersects(a: Shape, b: Shape) -> str:
    """SQL boolean: the shapes share a point."""
    if a.kind == b.kind == "stored":
        raise ValueError(_TWO_COLUMNS)
    if a.kind == "stored":
        return by_stored_kind(a, "i", lambda s: intersects(s, b))
    if b.kind == "stored":
        return by_stored_kind(b, "j", lambda s: intersects(a, s))
    for one, other in ((a, b), (b, a)):
        if other.kind == "union":
            return _any([intersects(one, s) for s in other.inner])
        if other.kind == "point":
            return contains(other, one)
        if other.kind == "not":
            return f"(NOT {contains(one, other.inner[0])})"
        if other.kind == "intersection" and one.kind != "point":
            raise ValueError(f"whether an extended shape meets a region of kind {other.kind} is not supported")
    for one, other in ((a, b), (b, a)):
        c, r = one.centre if one.kind == "circle" else ("", ""), one.parts[-1]
        match one.kind, other.kind:
            case "circle", "circle":
                return f"({distance(c, other.centre)} <= {r} + {other.parts[2]})"
            case "circle", "box":
                return f"({_to_box(c, other)} <= {r})"
            case "circle", "polygon" | "ring":
                return _any([_point_in_polygon(c, other), _each(other, lambda p, q: f"{_arc_distance(c, p, q)} <= {r}", "exists")])
            case "box", "box":
                return f"({_lon_apart(one.parts[0], other.parts[0])} <= ({one.parts[2]} + {other.parts[2]}) / 2D AND abs({one.parts[1]} - {other.parts[1]}) <= ({one.parts[3]} + {other.parts[3]}) / 2D)"
    return _any([contains(_first(a), b), contains(_first(b), a), _edges_cross(a, b)])


def _near(p: tuple[str, str], circle: Shape) -> str:
    """A range of latitude that a scan can skip row groups by, where the circle is given as numbers."""
    lat, r = _number(circle.parts[1]), _number(circle.parts[2])
    if lat is None or r is None:
        return ""
    return f"{p[1]} BETWEEN {lat - r - 1e-9!r}D AND {lat + r + 1e-9!r}D AND "


def area(s: Shape) -> str:
    """Square degrees."""
    square = repr((180 / math.pi) ** 2) + "D"
    match s.kind:
        case "stored":
            return by_stored_kind(s, "i", area)
        case "point":
            return "0D"
        case "circle":
            return f"(2D * pi() * (1D - cos(radians({s.parts[2]}))) * {square})"
        case "box":
            _, lat, w, h = s.parts
            return f"(radians({w}) * (sin(radians(least(90D, {lat} + {h} / 2D))) - sin(radians(greatest(-90D, {lat} - {h} / 2D)))) * {square})"
        case "polygon" | "ring":

            def term(a: tuple[str, str], b: tuple[str, str]) -> str:
                step, t1, t2 = f"tan(radians(pmod({b[0]} - {a[0]} + 180D, 360D) - 180D) / 2D)", f"tan(radians({a[1]}) / 2D)", f"tan(radians({b[1]}) / 2D)"
                return f"2D * atan2({step} * ({t1} + {t2}), 1D + {t1} * {t2})"

            return f"(abs({_total(s, term)}) * {square})"
    raise ValueError(f"the area of a region of kind {s.kind} is not supported")


PREDICATES: dict[str, Callable[[Shape, Shape], str]] = {"CONTAINS": contains, "INTERSECTS": intersects}
