"""Keys that make joins by distance or by an interval equi-joins, which spread over the cluster.

Cells: the sphere is cut into zones of latitude, and each zone into cells at least as wide as high. A point lies in one cell;
a circle is given one row for each cell that it may reach. Where radii vary, each circle belongs to a class by its radius, with
cells about as high as its circles, and a point has a cell in each class. Bins: numbers are cut into bins as wide as the
interval. The exact condition decides on each pair, and no pair comes twice.

A side's keys come from lateral steps after its SQL, each a projection or an explode, so that all is compiled and computed once
a row. Each function returns the steps, named after ``v``; the key is ``{v}.key`` of the last one, see ``key``."""

from __future__ import annotations

import math

#: Least and usual height of a zone in degrees; the usual one serves varying radii of no known bound where points can't have a
#: row per class.
LEAST_HEIGHT, USUAL_HEIGHT = 0.01, 1.0
#: Classes of radius; each is FACTOR times as high as the one before, the last reaches around the sphere.
CLASSES, FACTOR = 15, 2.0
#: Parts of the numbers that name a cell: of its zone and of its class.
ZONE, CLASS = "10000000L", "1000000000000L"
#: Chords nearer than this to a radius's chord are left to the exact condition.
MARGIN = 1e-9


def number(radius: str) -> float | None:
    try:
        return float(radius.strip("()").removesuffix("D"))
    except ValueError:
        return None


def height(degrees: float) -> str:
    return f"{max(LEAST_HEIGHT, degrees)!r}D"


USUAL = height(USUAL_HEIGHT)


def _let(name: str, **columns: str) -> str:
    return f" JOIN LATERAL (SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())}) AS {name}"


def _each(name: str, column: str, array: str) -> str:
    return f" JOIN LATERAL explode({array}) AS {name}({column})"


def key(v: str) -> str:
    return f"{v}k.key"


def point(v: str, lon: str, lat: str, radius: str | None = None) -> str:
    """Position and unit vector of a side's points; with a radius that of their circles, null if none can lie in one, and the
    squared chords below which and above which a distance surely is shorter and longer than it. A position without one of its
    numbers has no latitude, and so no cell."""
    out = _let(f"{v}q", lon=lon, lat=lat) + _let(f"{v}p", lon=f"{v}q.lon", lat=f"CASE WHEN {v}q.lon IS NOT NULL THEN {v}q.lat END")
    columns = {"x": f"cos(radians({v}p.lat)) * cos(radians({v}p.lon))", "y": f"cos(radians({v}p.lat)) * sin(radians({v}p.lon))", "z": f"sin(radians({v}p.lat))"}
    if radius is None:
        return out + _let(v, **columns)
    out += _let(f"{v}r", r=f"CASE WHEN {radius} >= 0D THEN least(180D, {radius}) END") + _let(f"{v}s", chord=f"2D * sin(radians({v}r.r) / 2D)")
    return out + _let(v, **columns, low=f"pow(greatest(0D, {v}s.chord - {MARGIN!r}D), 2D)", high=f"pow({v}s.chord + {MARGIN!r}D, 2D)")


def within(a: str, b: str, radius: str, exact: str) -> str:
    """The exact condition on the distance of two sides' points, found without it for all pairs but those at the very radius.
    b: the side with the circles."""
    chord = " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz")
    low, high = f"{b}.low", f"{b}.high"
    if (r := number(radius)) is not None:
        at = 2 * math.sin(math.radians(min(180.0, max(0.0, r))) / 2)
        low, high = f"{max(0.0, at - MARGIN) ** 2!r}D", f"{(at + MARGIN) ** 2!r}D"
    return f"(CASE WHEN {chord} < {low} THEN true WHEN {chord} BETWEEN {high} AND 5D THEN false ELSE {exact} END)"


def _zone(lat: str, h: str) -> str:
    return f"floor(({lat} + 90D) / {h})"


def _cells_in(zone: str, h: str) -> str:
    top = f"greatest(abs({zone} * {h} - 90D), abs(({zone} + 1) * {h} - 90D))"
    return f"greatest(1L, floor(360D * cos(radians(least(89.99D, {top}))) / {h}))"


def cell_of_point(v: str, h: str, part: str = "") -> str:
    """One row. part: SQL that is added to the cell. An explode of one key keeps Spark from filtering null keys by the whole
    expression at the scan, where it would take apart a text with a point dozens of times."""
    zone = _let(f"{v}z", zone=_zone(f"{v}p.lat", h)) + _let(f"{v}n", n=_cells_in(f"{v}z.zone", h))
    return zone + _each(f"{v}k", "key", f"array({part}{v}z.zone * {ZONE} + least({v}n.n - 1, floor(pmod({v}p.lon, 360D) / 360D * {v}n.n)))")


def cells_of_circle(v: str, radius: str, h: str, part: str = "") -> str:
    """Rows without repeats; none for a radius or a latitude that is null, which greatest and least pass over. The radius is widened a little against rounding."""
    lat, r, n = f"{v}p.lat", f"{v}w.r", f"{v}n.n"
    out = _let(f"{v}w", r=f"{radius} + 1e-9D")
    out += _let(f"{v}d", wide=f"CASE WHEN abs({lat}) + {r} >= 90D THEN 180D ELSE degrees(asin(least(1D, sin(radians({r})) / cos(radians({lat}))))) + 1e-9D END")
    out += _each(f"{v}z", "zone", f"CASE WHEN {lat} + {r} IS NOT NULL THEN sequence({_zone(f'greatest(-90D, {lat} - {r})', h)}, {_zone(f'least(90D, {lat} + {r})', h)}) END")
    out += _let(f"{v}n", n=_cells_in(f"{v}z.zone", h))
    low, high = (f"floor((pmod({v}p.lon, 360D) {sign} {v}d.wide) / 360D * {n})" for sign in "-+")
    out += _let(f"{v}b", low=low, high=high)
    out += _each(f"{v}c", "c", f"CASE WHEN {v}b.high - {v}b.low + 1 >= {n} THEN sequence(0L, {n} - 1) ELSE sequence({v}b.low, {v}b.high) END")
    return out + _let(f"{v}k", key=f"{part}{v}z.zone * {ZONE} + pmod({v}c.c, {n})")


def _class(v: str) -> str:
    """Of a circle; it has none without a radius."""
    steps = f"ceil(ln(greatest({LEAST_HEIGHT!r}D, {v}r.r) / {LEAST_HEIGHT!r}D) / ln({FACTOR!r}D))"
    return _let(f"{v}g", c=f"CASE WHEN {v}r.r IS NOT NULL THEN least({CLASSES - 1}L, {steps}) END")


def _classes(v: str, most: float | None) -> str:
    """All that a radius up to ``most`` can have."""
    last = CLASSES - 1 if most is None else min(CLASSES - 1, math.ceil(math.log(max(LEAST_HEIGHT, most) / LEAST_HEIGHT, FACTOR)) + 1)
    return _each(f"{v}g", "c", f"sequence(0L, {last}L)")


def _height_of_class(v: str, times: str = "") -> str:
    return _let(f"{v}h", h=f"{LEAST_HEIGHT!r}D * pow({FACTOR!r}D, {v}g.c){times}")


def _part(v: str) -> str:
    return f"{v}g.c * {CLASS} + "


def classed_cell(v: str) -> str:
    """The cell of a circle's centre among those of its class."""
    return _class(v) + _height_of_class(v) + cell_of_point(v, f"{v}h.h", _part(v))


def reach_by_class(v: str, most: float | None) -> str:
    """The cells of each class that the centre of a circle around a point can lie in."""
    radius = f"CASE WHEN {v}g.c = {CLASSES - 1} THEN 180D ELSE {v}h.h END"
    return _classes(v, most) + _height_of_class(v) + cells_of_circle(v, radius, f"{v}h.h", _part(v))


def classed_cells(v: str) -> str:
    """The cells of a circle in its class, half as high as in ``classed_cell``: 9 to 25, but near the poles."""
    return _class(v) + _height_of_class(v, " / 2D") + cells_of_circle(v, f"{v}r.r", f"{v}h.h", _part(v))


def cells_by_class(v: str, most: float | None) -> str:
    """A point's cell in each class of ``classed_cells``."""
    return _classes(v, most) + _height_of_class(v, " / 2D") + cell_of_point(v, f"{v}h.h", _part(v))


def bin_of(v: str, x: str, width: float) -> str:
    return _let(f"{v}k", key=_bin(x, width))


def bins_between(v: str, low: str, high: str, width: float) -> str:
    """For an interval no wider than ``width``; null bounds have none. Casts, division and floor keep the order of numbers, so
    rounding loses nothing."""
    return _let(f"{v}b", low=_bin(low, width), high=_bin(high, width)) + _each(f"{v}k", "key", f"sequence({v}b.low, greatest({v}b.low, {v}b.high))")


def _bin(x: str, width: float) -> str:
    return f"floor(CAST({x} AS DOUBLE) / {width!r}D)"
