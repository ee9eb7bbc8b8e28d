"""Display labels and unit scaling (P10, P12), as native expressions.

Python's ``round(x)`` is round-half-even on the exact binary value; for a
whole-number target Spark's ``bround(x, 0)`` gives the same answer, since
every double tie at 0 decimals (k + 0.5) is exact.

Python's ``'{:.1f}'`` also rounds the exact binary value half-even.
``format_number`` uses ``java.text.DecimalFormat``, which rounds the same way
(``format_string('%.1f')`` does not: it rounds the shortest decimal form half
up, so 0.35 would print as 0.4 instead of 0.3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c: Column, scale: float = 1.0) -> Column:
    """``round(c / scale)`` as a BIGINT, half-even like Python's ``round``."""
    return F.bround(c / F.lit(float(scale)), 0).cast("long")


def count_label(c: Column, scale: float, suffix: str) -> Column:
    """``f'{round(c / scale)}{suffix}'``; NULL stays NULL."""
    return F.concat(round_half_even(c, scale).cast("string"), F.lit(suffix))


def percent_label(c: Column, decimals: int = 1) -> Column:
    """``'{:.1f}%'.format(c)`` for values below 1000 (no digit grouping)."""
    return F.concat(F.format_number(c, decimals), F.lit("%"))
