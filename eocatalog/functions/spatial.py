"""Exact spatial predicates as Columns: areas of rows against one shape, without Python in the tasks.

A row's area is its rings, arrays of struct(x, y) that are closed and have the area on their left (outer rings against the
clock, holes with it). Each edge of one shape is cut where the other's edges meet it; each piece then lies inside, outside, or
on the other's boundary with the areas on the same or on opposite sides. Which of these occur, for both shapes, tells every
predicate. Coordinates are doubles: shapes that share vertices or lie on a common grid are told exactly.

Quad keys prune before: a row has the key of the smallest cell of a quad tree of longitude and latitude that holds its box.
Whatever meets a search's box has a key above or below one of at most four cells, which are plain comparisons of text that
reach the scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
#: What pieces of edges are, and that edges meet.
INSIDE, OUTSIDE, ON_SAME, ON_OPPOSITE, MEET = 1, 2, 4, 8, 16
#: Levels of the quad tree.
DEPTH = 14


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# ---- rings of rows


def _signed_area(ring: Column) -> Column:
    """Twice the area, positive against the clock; relative to the first point."""
    first = F.get(ring, F.lit(0))
    turn = lambda i: (F.get(ring, i - 1).x - first.x) * (F.get(ring, i).y - first.y) - (F.get(ring, i).x - first.x) * (F.get(ring, i - 1).y - first.y)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0.0), lambda total, i: total + F.coalesce(turn(i), F.lit(0.0)))


def oriented(ring: Column, hole: Column) -> Column:
    return F.when((_signed_area(ring) < 0) != hole, F.reverse(ring)).otherwise(ring)


def rings(geojson: Column) -> Column:
    """The rings of a GeoJSON polygon or multipolygon; null for anything else."""
    kind = F.get_json_object(geojson, "$.type")
    one = F.from_json(geojson, "coordinates array<array<array<double>>>").coordinates
    many = F.from_json(geojson, "coordinates array<array<array<array<double>>>>").coordinates
    polygons = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    points = lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return F.flatten(F.transform(polygons, lambda own: F.transform(own, lambda ring, i: oriented(points(ring), i > 0))))


def box_rings(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The one ring of a box."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(p(xmin, ymin), p(xmax, ymin), p(xmax, ymax), p(xmin, ymax), p(xmin, ymin)))


def box(rings_: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of rings; null without any."""
    ends = lambda p: F.struct(F.array_min(p.x).alias("xmin"), F.array_min(p.y).alias("ymin"), F.array_max(p.x).alias("xmax"), F.array_max(p.y).alias("ymax"))
    return let(F.flatten(rings_), lambda points: F.when(F.size(points) > 0, ends(points)))


def edges(rings_: Column) -> Column:
    """All edges of rings, but for those without length."""
    edge = lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))
    of_ring = lambda r: F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda b, i: edge(F.get(r, i), b))
    return F.filter(F.flatten(F.transform(rings_, of_ring)), lambda e: (e.x1 != e.x2) | (e.y1 != e.y2))


# ---- how the edges of one shape lie to another


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _meeting(e: Column, o: Column) -> Column:
    """Where o meets e, as places t0 to t1 along it; null if nowhere. line: along a stretch, same: in e's direction."""
    dx, dy = e.x2 - e.x1, e.y2 - e.y1
    turns = F.struct(
        _turn(o.x1, o.y1, o.x2, o.y2, e.x1, e.y1).alias("a"), _turn(o.x1, o.y1, o.x2, o.y2, e.x2, e.y2).alias("b"),
        _turn(e.x1, e.y1, e.x2, e.y2, o.x1, o.y1).alias("c"), _turn(e.x1, e.y1, e.x2, e.y2, o.x2, o.y2).alias("d"),
    )
    along = lambda x, y: ((x - e.x1) * dx + (y - e.y1) * dy) / (dx * dx + dy * dy)
    place = lambda t0, t1, line, same: F.struct(t0.alias("t0"), t1.alias("t1"), line.alias("line"), same.alias("same"))

    def told(t: Column) -> Column:
        low, high = F.least(along(o.x1, o.y1), along(o.x2, o.y2)), F.greatest(along(o.x1, o.y1), along(o.x2, o.y2))
        on_line = F.when((high >= 0) & (low <= 1), place(low, high, F.least(high, F.lit(1.0)) > F.greatest(low, F.lit(0.0)), along(o.x2, o.y2) > along(o.x1, o.y1)))
        at = F.try_divide(t.a, t.a - t.b)
        crossing = F.when((F.signum(t.a) * F.signum(t.b) <= 0) & (F.signum(t.c) * F.signum(t.d) <= 0), place(at, at, F.lit(False), F.lit(False)))
        return F.when((t.a == 0) & (t.b == 0), on_line).otherwise(crossing)

    return let(turns, told)


def _within(x: Column, y: Column, other: Column) -> Column:
    """Whether a point that isn't on an edge is inside: the edges to its right are odd in number."""
    right = lambda o: ((o.y1 > y) != (o.y2 > y)) & (x < F.try_divide((o.x2 - o.x1) * (y - o.y1), o.y2 - o.y1) + o.x1)
    return F.aggregate(other, F.lit(0), lambda odd, o: odd.bitwiseXOR(F.coalesce(right(o), F.lit(False)).cast("int"))) == 1


def lie(own: Column, other: Column) -> Column:
    """Which of INSIDE ... MEET occur among the pieces of own edges, beside the area that other's edges bound."""

    def of_edge(e: Column) -> Column:
        def cut(met: Column) -> Column:
            ends = F.filter(F.flatten(F.transform(met, lambda m: F.array(m.t0, m.t1))), lambda t: (t > 0) & (t < 1))
            cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), ends)))

            def what(t: Column) -> Column:
                on = lambda same: F.exists(met, lambda m: m.line & (m.t0 <= t) & (t <= m.t1) & (m.same == same))
                inside = _within(e.x1 + (e.x2 - e.x1) * t, e.y1 + (e.y2 - e.y1) * t, other)
                return F.when(on(F.lit(True)), ON_SAME).when(on(F.lit(False)), ON_OPPOSITE).when(inside, INSIDE).otherwise(OUTSIDE)

            pieces = let(cuts, lambda c: F.transform(F.slice(c, 2, F.size(c) - 1), lambda t, i: what((F.get(c, i) + t) / 2)))
            return F.aggregate(pieces, F.when(F.size(met) > 0, MEET).otherwise(0), lambda all_, x: all_.bitwiseOR(x))

        return let(F.filter(F.transform(other, lambda o: _meeting(e, o)), lambda m: m.isNotNull()), cut)

    return F.aggregate(F.transform(own, of_edge), F.lit(0), lambda all_, x: all_.bitwiseOR(x))


def lie_of_point(x: float, y: float, other: Column) -> Column:
    on = F.exists(other, lambda o: (_turn(o.x1, o.y1, o.x2, o.y2, F.lit(x), F.lit(y)) == 0) & F.lit(x).between(F.least(o.x1, o.x2), F.greatest(o.x1, o.x2)) & F.lit(y).between(F.least(o.y1, o.y2), F.greatest(o.y1, o.y2)))
    return F.when(on, MEET).when(_within(F.lit(x), F.lit(y), other), INSIDE).otherwise(OUTSIDE)


# ---- one shape


def _literal_edges(lines: list[list]) -> Column:
    found = [{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for line in lines for a, b in zip(line, line[1:], strict=False) if a[:2] != b[:2]]
    return F.from_json(F.lit(json.dumps([{k: float(v) for k, v in e.items()} for e in found])), _EDGES)


def _oriented(rings_: list[list], area) -> list[list]:
    """A polygon's rings, closed, the area on their left."""
    out = []
    for k, ring in enumerate(rings_):
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        out.append(closed[::-1] if (area(closed) < 0) != (k > 0) else closed)
    return out


def _area(ring: list) -> float:
    x0, y0 = ring[0][:2]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:], strict=False))


def predicate(op: str, shape: dict, rings_: Column) -> Column:
    """Whether a row's area stands in op (s_intersects, s_within, ...) to a GeoJSON shape; null without rings.

    ValueError for a collection of several kinds beside s_intersects and s_disjoint.
    """
    kind, at = shape["type"], shape.get("coordinates")
    any_of = lambda cols: cols[0] if len(cols) == 1 else cols[0] | any_of(cols[1:])
    if kind == "GeometryCollection":
        if op not in ("s_intersects", "s_disjoint"):
            raise ValueError(f"{op} of a collection")
        met = any_of([predicate("s_intersects", s, rings_) for s in shape["geometries"]])
        return met if op == "s_intersects" else ~met
    if kind in ("Point", "MultiPoint"):

        def told(own: Column) -> Column:
            out = F.lit(0)
            for p in [at] if kind == "Point" else at:
                out = out.bitwiseOR(lie_of_point(float(p[0]), float(p[1]), own))
            return let(out, lambda b: _of_part(op, b))

        return let(edges(rings_), told)
    if kind in ("LineString", "MultiLineString"):
        both = F.struct(edges(rings_).alias("own"), _literal_edges([at] if kind == "LineString" else at).alias("other"))
        return let(both, lambda e: let(lie(e.other, e.own), lambda b: _of_part(op, b)))
    area = _literal_edges([r for p in ([at] if kind == "Polygon" else at) for r in _oriented(p, _area)])
    both = F.struct(edges(rings_).alias("own"), area.alias("other"))
    return let(both, lambda e: let(F.struct(lie(e.own, e.other).alias("a"), lie(e.other, e.own).alias("b")), lambda x: _of_area(op, x.a, x.b)))


def _has(bits: Column, what: int) -> Column:
    return bits.bitwiseAND(what) != 0


def _of_part(op: str, b: Column) -> Column:
    """A row's area beside lines or points, of which b tells where they lie."""
    inside, outside = _has(b, INSIDE), _has(b, OUTSIDE)
    meets = inside | _has(b, MEET)
    return {
        "s_intersects": meets, "s_disjoint": ~meets, "s_contains": inside & ~outside, "s_within": F.lit(False), "s_touches": meets & ~inside,
        "s_crosses": inside & outside, "s_overlaps": F.lit(False), "s_equals": F.lit(False),
    }[op]


def _of_area(op: str, a: Column, b: Column) -> Column:
    """A row's area beside another area: a tells where its edges lie, b where the other's do."""
    inner = _has(a, INSIDE) | _has(b, INSIDE) | _has(a, ON_SAME)
    meets = inner | _has(a, MEET)
    within = inner & ~_has(a, OUTSIDE) & ~_has(b, INSIDE)
    contains = inner & ~_has(b, OUTSIDE) & ~_has(a, INSIDE)
    return {
        "s_intersects": meets, "s_disjoint": ~meets, "s_within": within, "s_contains": contains, "s_equals": within & contains, "s_touches": meets & ~inner,
        "s_overlaps": inner & ~within & ~contains, "s_crosses": F.lit(False),
    }[op]


# ---- quad keys


def _step(value: Column, low: float, span: float) -> Column:
    return F.least(F.greatest(F.floor((value - low) / span * (1 << DEPTH)), F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("int")


def quad_key(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Of the smallest cell that holds a box: a digit from 0 to 3 for each level; null without a box."""
    steps = zip(("x0", "x1", "y0", "y1"), (xmin, xmax, ymin, ymax), (-180.0, -180.0, -90.0, -90.0), (360.0, 360.0, 180.0, 180.0), strict=True)
    bit = lambda v, k: F.shiftright(v, DEPTH - 1 - k).bitwiseAND(1)

    def told(at: Column) -> Column:
        differ = at.x0.bitwiseXOR(at.x1).bitwiseOR(at.y0.bitwiseXOR(at.y1))
        levels = F.lit(DEPTH) - F.length(F.regexp_replace(F.conv(differ.cast("string"), 10, 2), "^0+", ""))
        digits = F.concat(*((bit(at.x0, k) + 2 * bit(at.y0, k)).cast("string") for k in range(DEPTH)))
        return F.when(at.x0.isNotNull() & at.x1.isNotNull() & at.y0.isNotNull() & at.y1.isNotNull(), F.left(digits, levels))

    # greatest and least leave nulls out, so a missing bound is told before
    step = lambda v, low, span: F.when(v.isNotNull(), _step(v, low, span))
    return let(F.struct(*(step(v, low, span).alias(name) for name, v, low, span in steps)), told)


def covering(x0: float, y0: float, x1: float, y1: float) -> list[str]:
    """At most four cells, as large as a box or larger, that hold it together."""
    step = lambda v, low, span: min(max(int((v - low) // (span / (1 << DEPTH))), 0), (1 << DEPTH) - 1)
    xs, ys = (step(x0, -180.0, 360.0), step(x1, -180.0, 360.0)), (step(y0, -90.0, 180.0), step(y1, -90.0, 180.0))
    drop = max(xs[1] - xs[0], ys[1] - ys[0], 0).bit_length()
    levels = max(DEPTH - drop, 0)
    key = lambda x, y: "".join(str((x >> (DEPTH - 1 - k) & 1) + 2 * (y >> (DEPTH - 1 - k) & 1)) for k in range(levels))
    return sorted({key(x, y) for x in xs for y in ys})


def near(key: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Keys above or below the cells that cover a box: no row whose box meets it has another."""
    cells = covering(x0, y0, x1, y1)
    above = sorted({c[:k] for c in cells for k in range(len(c))})
    out = key.isin(above) if above else F.lit(False)
    for c in cells:
        out = out | ((key >= c) & (key < c + "4"))
    return out
