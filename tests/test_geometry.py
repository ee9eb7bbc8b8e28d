"""Boundaries as rings: reading, area, clipping against brute force, projection there and back."""

import math
import random

import pytest
from pyspark.sql import functions as F

from playmetrics.functions.geometry import (
    clip_shape, project, project_shape, read_shape, shape_area, shape_box, to_wkt, unproject,
    unproject_shape,
)
from playmetrics.operators import clip_outlying, clip_shapes, project_shapes, with_shapes
from playmetrics.sources import read_boundaries

SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
TEXTS = {
    SQUARE: (None, 16.0),
    "polygon((0 0,4 0,4 4,0 4,0 0),(1 1, 1 2, 2 2, 2 1, 1 1))": (None, 15.0),
    "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))": (None, 15.0),  # either way round
    "MULTIPOLYGON (((0 0, 2 0, 0 2, 0 0)), ((10 10, 11 10, 11 11, 10 11, 10 10), "
    "(10.2 10.2, 10.2 10.4, 10.4 10.4, 10.4 10.2, 10.2 10.2)))": (None, 2.96),
    "POLYGON Z ((0 0 9, 1 0 9, 1 1 9, 0 0 9))": (None, 0.5),
    " MultiPolygon\n(((-1e1 -.5, 0 0, 0 1., -1e1 -.5)))\t": (None, 5.0),
    "POLYGON EMPTY": (None, 0.0), "MULTIPOLYGON EMPTY": (None, 0.0),
    "POLYGON ((0 0, 4 0, 4 4, 0 4))": ("ring not closed", None),
    "POLYGON ((0 0, 1 1, 0 0))": ("ring of less than four points", None),
    "POLYGON ((0 0, 1 x, 1 1, 0 0))": ("not a number", None),
    "POLYGON ((0 0, 1, 1 1, 0 0))": ("not a number", None),
    "POLYGON ((0 0, NaN 1, 1 1, 0 0))": ("not a number", None),
    "POLYGON ((0 0, 1 0, 1 1, 0 0)": ("brackets", None),
    "POLYGON (0 0, 1 0, 1 1, 0 0)": ("brackets", None),
    "MULTIPOLYGON ((0 0, 1 0, 1 1, 0 0))": ("brackets", None),
    "POLYGON (((0 0, 1 0, 1 1, 0 0)))": ("brackets", None),
    "POINT (1 2)": ("not a polygon", None), "": ("not a polygon", None), None: ("no text", None),
}


def test_reading(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "geometry string")
    got = {r["geometry"]: r for r in with_shapes(df).collect()}
    for text, (problem, area) in TEXTS.items():
        r = got[text]
        assert r["problem"] == problem, text
        assert (r["shape"] is None) == (problem is not None)
        assert r["area"] is None if area is None else math.isclose(r["area"], area, abs_tol=1e-12), text
    many = got[next(t for t in TEXTS if t and t.startswith("MULTIPOLYGON (((0 0, 2"))]
    assert [len(p) for p in many["shape"]] == [1, 2]
    assert tuple(many[c] for c in ("x_min", "y_min", "x_max", "y_max")) == (0.0, 0.0, 11.0, 11.0)
    assert got["POLYGON EMPTY"]["x_min"] is None and got["POLYGON EMPTY"]["shape"] == []


def test_text_round_trip(spark):
    df = spark.createDataFrame([(t,) for t, (p, _) in TEXTS.items() if p is None], "geometry string")
    shape = read_shape("geometry")["shape"]
    back = read_shape(to_wkt(shape))["shape"]
    assert all(r[0] == r[1] for r in df.select(shape, back).collect())


def test_boundaries_with_extra_columns(spark, tmp_path):
    rows = [("Square", "SQ", SQUARE), ("Point", "PT", "POINT (1 1)"), ("None", "NO", None)]
    spark.createDataFrame(rows, "NAME string, STUSPS string, geometry string").write.parquet(str(tmp_path / "b"))
    got = with_shapes(read_boundaries(spark, str(tmp_path / "b")))
    assert got.columns[:5] == ["NAME", "STUSPS", "geometry", "shape", "problem"]
    assert {r["NAME"]: r["area"] for r in got.collect()} == {"Square": 16.0, "Point": None, "None": None}


# ------------------------------------------------------------------ clipping

def star(rng, n):
    """A ring that winds once round its centre, convex or not."""
    x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
    turns = [2 * math.pi * (k + rng.uniform(0, 0.9)) / n for k in range(n)]
    points = [(x + r * math.cos(t), y + r * math.sin(t)) for t in turns for r in [rng.uniform(0.3, 4)]]
    return points + points[:1]




def brute_area(ring, box, rows=4000):
    """Area of the part in the box: exact widths on many lines."""
    (x0, x1), (y0, y1) = box
    total = 0.0
    for k in range(rows):
        y = y0 + (k + 0.5) * (y1 - y0) / rows
        cuts = sorted(a + (y - b) / (d - b) * (c - a) for (a, b), (c, d) in zip(ring, ring[1:])
                      if (b > y) != (d > y))
        total += sum(max(0.0, min(q, x1) - max(p, x0)) for p, q in zip(cuts[::2], cuts[1::2]))
    return total * (y1 - y0) / rows


def wkt(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings) + ")"


def test_clipped_area_against_brute_force(spark):
    rng = random.Random(4)
    box = ((-1.5, 2.0), (-2.0, 1.25))
    rings = [star(rng, rng.randint(4, 12)) for _ in range(60)]
    df = with_shapes(spark.createDataFrame([(i, wkt(r)) for i, r in enumerate(rings)], "id long, geometry string"))
    got = {r["id"]: r["a"] for r in clip_shapes(df, *box).select("id", shape_area("shape").alias("a")).collect()}
    for i, ring in enumerate(rings):
        assert math.isclose(got.get(i, 0.0), brute_area(ring, box), abs_tol=0.02), i
    points = clip_shapes(df, *box).select(F.explode(F.flatten(F.flatten("shape"))).alias("p"))
    edge = points.agg(F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
    assert tuple(edge) == (-1.5, 2.0, -2.0, 1.25)  # on the edge exactly, never beyond


def test_clipping_whole_parts_and_holes(spark):
    cases = {
        "inside": (wkt([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]), 1.0, [1]),
        "around": (wkt([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)]), 16.0, [1]),
        "hole cut": (wkt([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)],
                         [(1, 1), (5, 1), (5, 2), (1, 2), (1, 1)]), 15.0, [2]),
        "hole outside": (wkt([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)],
                             [(5, 5), (6, 5), (6, 6), (5, 6), (5, 5)]), 16.0, [1]),
        "outside": (wkt([(5, 5), (6, 5), (6, 6), (5, 5)]), None, None),
        "touching": (wkt([(2, -1), (4, -1), (4, 1), (2, 1), (2, -1)]), None, None),
        "all hole": (wkt([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)],
                         [(-3, -3), (3, -3), (3, 3), (-3, 3), (-3, -3)]), 0.0, [2]),
        "two, one left": ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((7 7, 8 7, 8 8, 7 7)))", 0.5, [1]),
        "empty": ("POLYGON EMPTY", None, None), "bad": ("POINT (0 0)", None, None), "null": (None, None, None),
    }
    df = with_shapes(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "id string, geometry string"))
    for table in (df, df.drop("x_min")):
        got = {r["id"]: (r["a"], [len(p) for p in r["shape"]]) for r in clip_shapes(
            table, (-2.0, 2.0), (-2.0, 2.0)).select("id", "shape", shape_area("shape").alias("a")).collect()}
        assert got == {k: (a, n) for k, (_, a, n) in cases.items() if a is not None}
    assert df.where("false").select(clip_shape("shape", (0.0, 1.0), (0.0, 1.0))).collect() == []


def test_outlying_islands(spark):
    world = wkt([(-179, -80), (179, -80), (179, 80), (-179, 80), (-179, -80)])
    df = with_shapes(spark.createDataFrame([("AK", world), ("HI", world), ("CA", world), (None, world)],
                                           "state string, geometry string"))
    areas = {r["state"]: r["a"] for r in clip_outlying(df).select("state", shape_area("shape").alias("a")).collect()}
    assert areas == {"AK": 30.0 * 22, "HI": 40.0 * 80, "CA": 358.0 * 160, None: 358.0 * 160}


# ------------------------------------------------------------------ projection

def test_projection_round_trip(spark):
    rng = random.Random(6)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(500)]
    points += [(-100.0, 45.0), (0.0, 90.0), (0.0, -90.0), (-179.999, 12.0), (179.999, 12.0)]
    df = spark.createDataFrame(points, "lon double, lat double").withColumn("p", project(F.col("lon"), F.col("lat")))
    df = df.withColumn("q", unproject(F.col("p")["x"], F.col("p")["y"]))
    for r in df.collect():
        assert math.isclose(r["q"]["lat"], r["lat"], abs_tol=1e-9)
        if abs(r["lat"]) < 90:
            assert math.isclose((r["q"]["lon"] - r["lon"] + 180) % 360 - 180, 0, abs_tol=1e-9)
    centre = df.where("lon = -100 AND lat = 45").first()["p"]
    assert tuple(centre) == (0.0, 0.0)


def test_projection_edges(spark):
    df = spark.createDataFrame([(80.0, -45.0), (None, 1.0)], "lon double, lat double")
    assert all(tuple(r[0]) == (None, None) for r in df.select(project(F.col("lon"), F.col("lat"))).collect())
    off = spark.createDataFrame([(2e7, 0.0), (None, 0.0)], "x double, y double")
    assert all(tuple(r[0]) == (None, None) for r in off.select(unproject(F.col("x"), F.col("y"))).collect())


def test_areas_are_kept(spark):
    """Small squares of a degree: their area on the map is theirs on the sphere."""
    rows = []
    for lon, lat in ((-100, 45), (-150, 65), (-75, 25), (-160, 20)):
        ring = [(lon + 0.1 * a, lat + 0.1 * b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
        exact = 6_370_997.0 ** 2 * math.radians(0.1) * (math.sin(math.radians(lat + 0.1)) - math.sin(math.radians(lat)))
        rows.append((exact, wkt(ring)))
    df = with_shapes(spark.createDataFrame(rows, "exact double, geometry string"))
    shapes = project_shapes(df).select("exact", shape_area("shape").alias("a"), shape_box("shape").alias("b"))
    for r in shapes.collect():
        assert math.isclose(r["a"], r["exact"], rel_tol=1e-4)
    back = df.select("shape", unproject_shape(project_shape("shape")).alias("again")).collect()
    for r in back:
        for p, q in zip(r["shape"][0][0], r["again"][0][0]):
            assert math.isclose(p["x"], q["x"], abs_tol=1e-9) and math.isclose(p["y"], q["y"], abs_tol=1e-9)
