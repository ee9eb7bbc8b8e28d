"""Map tables: state fill, boundary attach, colour scale and map filters
(J1-J3, P4, P13, A14, F8, F9, F12).

Joins here pair a dimension (51 or 57 rows) with per-state counts (at most
one row per state and artist). No side is forced into a broadcast: the
dimension is the preserved side of its outer joins, which a hash join cannot
build from, and the counts are measured by adaptive execution at run time,
which broadcasts them when they fit and keeps a sort-merge join when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import (
    clip_shape, project_shape, read_shape, shape_area, shape_box,
)
from ..functions.scale import clipped_minmax
from ..sources.schemas import ALASKA_BOX, HAWAII_BOX

LISTENS = "listens"


def map_prep(counts: DataFrame, artist: "str | F.Column", dim: DataFrame) -> DataFrame:
    """Every dimension state with the artist's listens, 0 where none.

    ``counts`` is the output of `artist_by_state` (``artist, state, listens``);
    ``dim`` has ``NAME, state``. States outside the dimension drop out. An
    unknown artist gives one zero row per dimension state.
    Columns ``artist, state, listens, NAME``.
    """
    c = counts.select(F.col("artist").alias("__artist"), "state",
                      F.col(LISTENS).alias("__listens"))
    joined = dim.select("NAME", "state").join(c, on="state", how="left")
    return joined.select(
        F.coalesce(F.col("__artist"), artist if isinstance(artist, Column) else F.lit(artist))
        .alias("artist"),
        "state",
        F.coalesce(F.col("__listens"), F.lit(0).cast("long")).alias(LISTENS),
        "NAME",
    )


def map_join_inline(counts: DataFrame, dim: DataFrame, name_col: str = "NAME",
                    code_col: str = "state") -> DataFrame:
    """State fill without NULL filling, keeping both state columns.

    Counts are matched to the dimension on code; clashing names come out as
    ``state_x`` (the counts' code, NULL where none) and ``state_y`` (the
    dimension's full name); the dimension's code column is dropped.
    Columns ``artist, state_x, listens, state_y``.
    """
    d = dim.select(F.col(name_col).alias("state_y"), F.col(code_col).alias("__code"))
    c = counts.select("artist", F.col("state").alias("state_x"), LISTENS)
    joined = d.join(c, on=F.col("__code") == F.col("state_x"), how="left")
    return joined.select("artist", "state_x", LISTENS, "state_y")


def attach_boundaries(boundaries: DataFrame, mapped: DataFrame,
                      on: str = "NAME", right_on: str | None = None) -> DataFrame:
    """Every boundary row with its map values, NULL where none.

    ``right_on`` names the matching column of ``mapped`` when it differs
    (``state_y`` after `map_join_inline`).
    """
    if right_on is None or right_on == on:
        return boundaries.join(mapped, on=on, how="left")
    return boundaries.join(mapped, on=boundaries[on] == mapped[right_on], how="left")


def listens_bounds(df: DataFrame, col: str = LISTENS) -> DataFrame:
    """Minimum and maximum of the map value (A14), one row."""
    return df.agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))


def map_scale(df: DataFrame, col: str = LISTENS, out: str = "scaled") -> DataFrame:
    """Add ``out`` = clipped min-max scaling of ``col``.

    The bounds come from one scalar subquery: a partial/final aggregate whose
    single (min, max) row is injected into the projection. No join, and no
    window pulling ``df`` into one partition.
    """
    bounds = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    return df.withColumn(out, clipped_minmax(F.col(col), bounds.getField("lo"),
                                             bounds.getField("hi")))


def exclude_states(df: DataFrame, states=("HI", "AK"), col: str = "state") -> DataFrame:
    """Rows outside the listed states (F8); NULL states drop out, as in SQL."""
    return df.where(~F.col(col).isin(*states))


def only_state(df: DataFrame, state: str, col: str = "state") -> DataFrame:
    """Rows of one state."""
    return df.where(F.col(col) == F.lit(state))


def in_rectangle(df: DataFrame, lon_range, lat_range, lon: str = "lon",
                 lat: str = "lat") -> DataFrame:
    """Rows whose point lies in a lon/lat rectangle, bounds included.

    Both predicates are plain column ranges, so a parquet scan receives them
    as pushed filters and skips row groups by their min/max statistics.
    """
    (x0, x1), (y0, y1) = lon_range, lat_range
    return df.where(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1))


BOX = ("x_min", "y_min", "x_max", "y_max")


def with_shapes(boundaries: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Boundaries with their WKT read (S8): ``shape``, ``problem`` (NULL if it was read), and the
    shape's ``area`` and box (``x_min, y_min, x_max, y_max``) in the units of its coordinates.
    Write the result (`materialize`) where several queries share it."""
    def facts(r):
        return F.struct(r["shape"].alias("shape"), r["problem"].alias("problem"),
                        shape_area(r["shape"]).alias("area"), shape_box(r["shape"]).alias("box"))

    # one expression, so that the text is read once a row
    read = boundaries.withColumn("__facts", F.element_at(F.transform(
        F.array(read_shape(geometry)), facts), 1))
    f = F.col("__facts")
    return read.select(*boundaries.columns, f["shape"].alias("shape"), f["problem"].alias("problem"),
                       f["area"].alias("area"), *[f["box"][n].alias(n) for n in BOX])


def clip_shapes(df: DataFrame, lon_range, lat_range, shape: str = "shape") -> DataFrame:
    """Rows whose shape reaches into a lon/lat rectangle, the shape cut to it.

    Rows with a box from `with_shapes` are left out by it first, plain ranges of columns."""
    (x0, x1), (y0, y1) = lon_range, lat_range
    if set(BOX) <= set(df.columns):
        df = df.where((F.col("x_min") <= x1) & (F.col("x_max") >= x0)
                      & (F.col("y_min") <= y1) & (F.col("y_max") >= y0))
    cut = df.withColumn(shape, clip_shape(shape, (x0, x1), (y0, y1)))
    return cut.where(F.size(shape) > 0)


def clip_outlying(df: DataFrame, state: str = "state", shape: str = "shape") -> DataFrame:
    """Alaska and Hawaii without their outlying islands; other rows as they are."""
    code = F.col(state)
    cut = F.when(code == "AK", clip_shape(shape, *ALASKA_BOX)).when(
        code == "HI", clip_shape(shape, *HAWAII_BOX)).otherwise(F.col(shape))
    return df.withColumn(shape, cut)


def project_shapes(df: DataFrame, shape: str = "shape") -> DataFrame:
    """Shapes in degrees as shapes in metres of the equal-area map of the United States."""
    return df.withColumn(shape, project_shape(shape))


def in_alaska_box(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return in_rectangle(df, *ALASKA_BOX, lon=lon, lat=lat)


def in_hawaii_box(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return in_rectangle(df, *HAWAII_BOX, lon=lon, lat=lat)
