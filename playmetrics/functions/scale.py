"""Min-max scaling with clipping (P13), the numeric half of map colouring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_minmax(x: Column, lo: Column, hi: Column) -> Column:
    """``clip((x - lo) / (hi - lo), 0, 1)``; 0 when ``hi == lo``; NULL x stays NULL.

    Same rule as a clipping ``Normalize(vmin=lo, vmax=hi)``.
    """
    xd, lod, hid = x.cast("double"), lo.cast("double"), hi.cast("double")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (xd - lod) / (hid - lod)))
    return (F.when(xd.isNull(), F.lit(None).cast("double"))
            .when(hid == lod, F.lit(0.0))
            .otherwise(scaled))
