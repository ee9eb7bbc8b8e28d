"""Boundaries as rings of points: reading WKT, area, box, clipping, projection.

A shape is an array of polygons, a polygon an array of rings (the shell, then its holes), a ring
an array of points (x, y) whose last is its first. All are native expressions over one row's
shape, so a table of boundaries is worked on where it lies and a huge one splits by rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_POLYGON = r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"

# The spherical equal-area map of the United States (EPSG 2163), its centre in
# degrees and its radius in metres.
US_CENTRE = (-100.0, 45.0)
US_RADIUS = 6_370_997.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _point(text: Column) -> Column:
    parts = F.split(F.trim(text), r"\s+")
    return F.struct(*[F.try_element_at(parts, F.lit(i)).try_cast("double").alias(n)
                      for i, n in ((1, "x"), (2, "y"))])


def _body(wkt: Column) -> Column:
    """The brackets of a polygon or multipolygon, empty if it is neither."""
    head = r"(?is)^\s*(?:POLYGON|MULTIPOLYGON)(?:\s*Z?M?)\s*"
    return F.regexp_extract(wkt, head + r"(\(.*\))\s*$", 1)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _polygons(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(_POLYGON), F.lit(1)), lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(r"\(([^()]*)\)"), F.lit(1)),
        lambda r: F.transform(F.split(r, ","), _point)))


def _problem(t: Column, body: Column, shape: Column) -> Column:
    rings = F.flatten(shape)
    number = F.forall(rings, lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()
                      & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))))
    rest = F.regexp_replace(F.regexp_replace(body, _POLYGON, "P"), r"\s+", "")
    single = F.lower(F.ltrim(t)).startswith("polygon")
    nested = F.when(single, rest == "P").otherwise(rest.rlike(r"^\(P(,P)*\)$"))
    return (F.when(t.isNull(), "no text")
            .when(t.rlike(r"(?i)^\s*(MULTI)?POLYGON\s*(ZM?|M)?\s*EMPTY\s*$"), F.lit(None).cast("string"))
            .when(body == "", "not a polygon").when(~nested, "brackets").when(~number, "not a number")
            .when(F.exists(rings, lambda r: F.size(r) < 4), "ring of less than four points")
            .when(F.exists(rings, lambda r: r[0] != F.element_at(r, -1)), "ring not closed"))


def read_shape(wkt: Column | str) -> Column:
    """struct(shape, problem) of WKT text: one of them is NULL.

    A POLYGON or MULTIPOLYGON gives its shape, coordinates after the second left out, and EMPTY
    an empty one; of other text ``problem`` says what is wrong."""
    t = _col(wkt)

    def judged(body: Column) -> Column:
        return _let(_polygons(body), lambda shape: F.struct(
            shape.alias("shape"), _problem(t, body, shape).alias("problem")))

    def kept(r: Column) -> Column:
        return F.struct(F.when(r["problem"].isNull(), r["shape"]).alias("shape"), r["problem"].alias("problem"))

    return _let(_let(F.coalesce(_body(t), F.lit("")), judged), kept)


def ring_area(ring: Column) -> Column:
    """Signed: positive if the ring runs counter-clockwise."""
    n = F.size(ring)
    # from the first point, which keeps the products small
    x0, y0 = ring[0]["x"], ring[0]["y"]
    cross = F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0))
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def shape_area(shape: Column | str) -> Column:
    """Shells less holes, whichever way they run; 0 for an empty shape."""
    def polygon(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda r, i: F.when(i == 0, F.abs(ring_area(r)))
                                       .otherwise(-F.abs(ring_area(r)))), F.lit(0.0), lambda s, v: s + v)

    return F.aggregate(F.transform(_col(shape), polygon), F.lit(0.0), lambda s, v: s + v)


def shape_box(shape: Column | str) -> Column:
    """struct(x_min, y_min, x_max, y_max); its fields are NULL for an empty shape."""
    points = F.flatten(F.flatten(_col(shape)))
    of = {"x": F.transform(points, lambda p: p["x"]), "y": F.transform(points, lambda p: p["y"])}
    return F.struct(*[f(of[c]).alias(f"{c}_{n}")
                      for n, f in (("min", F.array_min), ("max", F.array_max)) for c in ("x", "y")])


def _clip_edge(ring: Column, axis: str, bound: float, side: int) -> Column:
    """An open ring (last point not repeated) cut at one line; ``side`` 1 keeps what is above."""
    other = "y" if axis == "x" else "x"
    n = F.size(ring)

    def inside(p: Column) -> Column:
        return p[axis] >= bound if side > 0 else p[axis] <= bound

    def crossing(p: Column, q: Column) -> Column:
        share = (F.lit(bound) - p[axis]) / (q[axis] - p[axis])
        at = {axis: F.lit(bound), other: p[other] + share * (q[other] - p[other])}
        return F.struct(at["x"].alias("x"), at["y"].alias("y"))

    def step(q: Column, i: Column) -> Column:
        p = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        q = F.struct(q["x"].alias("x"), q["y"].alias("y"))
        return (F.when(inside(p) & inside(q), F.array(q)).when(inside(q), F.array(crossing(p, q), q))
                .when(inside(p), F.array(crossing(p, q))).otherwise(F.slice(F.array(q), 1, 0)))

    return F.flatten(F.transform(ring, step))


def clip_ring(ring: Column, x_range: tuple[float, float], y_range: tuple[float, float]) -> Column:
    """The part of a ring inside a rectangle, cut edge by edge; empty if nothing is left.

    Where the cut leaves several pieces they hang together along the rectangle's edge, which
    changes no area."""
    edges = [("x", x_range[0], 1), ("x", x_range[1], -1), ("y", y_range[0], 1), ("y", y_range[1], -1)]

    def after(open_ring: Column, k: int) -> Column:
        if k == len(edges):
            return F.when(F.size(open_ring) >= 3, F.concat(open_ring, F.slice(open_ring, 1, 1))).otherwise(
                F.slice(open_ring, 1, 0))
        return _let(_clip_edge(open_ring, *edges[k]), lambda r: after(r, k + 1))

    return _let(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda r: after(r, 0))


def clip_shape(shape: Column | str, x_range: tuple[float, float], y_range: tuple[float, float]) -> Column:
    """The part of a shape inside a rectangle: polygons and holes that it leaves out are gone."""
    def polygon(p: Column) -> Column:
        # what only touches the rectangle is left with no area
        return _let(F.transform(p, lambda r: clip_ring(r, x_range, y_range)), lambda rings: F.when(
            ring_area(rings[0]) != 0, F.filter(rings, lambda r: ring_area(r) != 0))
            .otherwise(F.slice(rings, 1, 0)))

    return F.filter(F.transform(_col(shape), polygon), lambda p: F.size(p) > 0)


def to_wkt(shape: Column | str) -> Column:
    """A MULTIPOLYGON of the shape."""
    def ring(r: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(
            " ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))

    def polygon(p: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))

    s = _col(shape)
    return F.when(F.size(s) == 0, "MULTIPOLYGON EMPTY").when(s.isNotNull(), F.concat(
        F.lit("MULTIPOLYGON ("), F.array_join(F.transform(s, polygon), ", "), F.lit(")")))


def project(lon: Column, lat: Column, centre: tuple[float, float] = US_CENTRE,
            radius: float = US_RADIUS) -> Column:
    """struct(x, y) in metres: Lambert's azimuthal equal-area map of the sphere. NULL at the
    point opposite the centre, which has no place on it."""
    lon0, lat0 = (math.radians(v) for v in centre)
    turn, phi = F.radians(lon) - lon0, F.radians(lat)
    toward = math.sin(lat0) * F.sin(phi) + math.cos(lat0) * F.cos(phi) * F.cos(turn)
    scale = F.when(toward > -1 + 1e-15, F.lit(radius) * F.sqrt(F.lit(2.0) / (1 + toward)))
    return F.struct((scale * F.cos(phi) * F.sin(turn)).alias("x"),
                    (scale * (math.cos(lat0) * F.sin(phi) - math.sin(lat0) * F.cos(phi) * F.cos(turn)))
                    .alias("y"))


def unproject(x: Column, y: Column, centre: tuple[float, float] = US_CENTRE,
              radius: float = US_RADIUS) -> Column:
    """struct(lon, lat) in degrees, of a point that `project` made; NULL off the map."""
    lon0, lat0 = centre
    sin0, cos0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    rho = F.hypot(x, y)
    c = F.when(rho <= 2 * radius, 2 * F.asin(rho / (2 * radius)))
    height = F.cos(c) * sin0 + F.when(rho > 0, y * F.sin(c) * cos0 / rho).otherwise(0.0)
    # rounding may leave the sine's range; greatest and least would pass over a NULL
    lat = F.when(c.isNotNull(), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height))))
    lon = F.degrees(F.atan2(x * F.sin(c), rho * cos0 * F.cos(c) - y * sin0 * F.sin(c)))
    turned = F.pmod(lon + lon0 + 180.0, F.lit(360.0)) - 180.0
    return F.struct(F.when(rho > 0, turned).when(rho == 0, F.lit(float(lon0))).alias("lon"),
                    F.degrees(lat).alias("lat"))


def _each_point(shape: Column, f) -> Column:
    return F.transform(shape, lambda p: F.transform(p, lambda r: F.transform(r, f)))


def project_shape(shape: Column | str, centre: tuple[float, float] = US_CENTRE,
                  radius: float = US_RADIUS) -> Column:
    """A shape of degrees as one of metres; its area is in square metres of the sphere, but for
    the edges, which are straight on the map."""
    return _each_point(_col(shape), lambda p: project(p["x"], p["y"], centre, radius))


def unproject_shape(shape: Column | str, centre: tuple[float, float] = US_CENTRE,
                    radius: float = US_RADIUS) -> Column:
    def point(p: Column) -> Column:
        q = unproject(p["x"], p["y"], centre, radius)
        return F.struct(q["lon"].alias("x"), q["lat"].alias("y"))

    return _each_point(_col(shape), point)
