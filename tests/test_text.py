"""Repair of UTF-8 text read as Latin-1, both modes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playmetrics.functions.text import damage_text, repair_text

FFFD = "\ufffd"


def damage(s: str, times: int = 1) -> str:
    for _ in range(times):
        s = s.encode("utf-8").decode("latin-1")
    return s


# (input, intended result, compat result)
CASES = [
    (None, None, None),
    ("Coldplay", "Coldplay", "Coldplay"),
    ("Beyoncé", "Beyoncé", "Beyoncé"),
    (damage("Beyoncé"), "Beyoncé", "Beyonc" + FFFD),
    (damage("Beyoncé", 2), "Beyoncé", "Beyoncé"),
    (damage("Beyoncé?"), "Beyoncé?", damage("Beyoncé?")),
    (damage("Beyoncé?", 2), "Beyoncé?", damage("Beyoncé?", 2)),
    ("Ωmega", "Ωmega", "Ωmega"),
    (damage("Don’t"), "Don’t", damage("Don’t")),
    (damage("Don’t", 2), "Don’t", "Don’t"),
    (damage("Beyoncé") + "\u2028", damage("Beyoncé") + "\u2028",
     damage("Beyoncé") + "\u2028"),
    ("🎵 song", "🎵 song", "🎵 song"),
    (damage("🎵 Motörhead", 2), "🎵 Motörhead", "🎵 Motörhead"),
    ("", "", ""),
]


@pytest.mark.parametrize("mode,idx", [("intended", 1), ("compat", 2)])
def test_repair_table(spark, mode, idx):
    rows = [(i, c[0]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = dict(df.select("i", repair_text("t", mode).alias("r")).collect())
    for i, case in enumerate(CASES):
        assert got[i] == case[idx], (mode, case[0], got[i], case[idx])


def test_damage_matches_python(spark):
    texts = ["Beyoncé", "Don’t", "中文", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(damage_text("t", 2)).collect()]
    assert got == [damage(t, 2) for t in texts]


def test_unknown_mode():
    with pytest.raises(ValueError):
        repair_text("t", "other")


# Letters whose Latin-1 bytes never continue a UTF-8 sequence, so clean text
# made of them can't be mistaken for damaged text.
ALPHABET = st.sampled_from(list("abcXYZ 0129.,-") + [chr(c) for c in range(0xC0, 0x100)]
                           + list("€Ω中ş"))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=20))
def test_round_trip_property(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    out = df.select("i", "t", *[repair_text(damage_text("t", k)).alias(f"r{k}")
                                for k in range(3)])
    for r in out.collect():
        assert r.r0 == r.t and r.r1 == r.t and r.r2 == r.t


def test_repair_under_filter_and_aggregate(spark):
    # The guard must hold when the repaired column is filtered and grouped:
    # text above U+00FF must never reach the Latin-1 encoder.
    rows = [("Ωmega",), (damage("Beyoncé"),), ("🎵",), (None,)] * 50
    df = spark.createDataFrame(rows, "t string").select(repair_text("t").alias("r"))
    got = {r.r: r.n for r in df.where(F.col("r") != "x").groupBy("r")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"Ωmega": 50, "Beyoncé": 50, "🎵": 50}


def test_no_python_udf_in_plan(spark):
    df = spark.createDataFrame([("a",)], "t string").select(repair_text("t", "compat"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def compat_rule(t):
    """The legacy rule restated: text with a character above U+00FF, with no
    non-ASCII character, or with '?' is kept; otherwise decode the Latin-1
    bytes as UTF-8 (bad bytes -> U+FFFD); if that holds a character above
    U+00FF keep the input, else decode once more."""
    if t is None:
        return None
    if any(ord(ch) > 0xFF for ch in t) or all(ord(ch) < 0x80 for ch in t) or "?" in t:
        return t
    once = t.encode("latin-1").decode("utf-8", errors="replace")
    if any(ord(ch) > 0xFF for ch in once):
        return t
    return once.encode("latin-1").decode("utf-8", errors="replace")


MIXED = st.sampled_from(list("ab ?é€中") + [chr(c) for c in (0x80, 0x9F, 0xA9, 0xC3, 0xE2, 0xFF)])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=MIXED, max_size=12), st.integers(0, 2)),
                min_size=1, max_size=25))
def test_compat_property(spark, items):
    texts = [damage(t, k) for t, k in items]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", repair_text("t", "compat").alias("r")).collect())
    for i, t in enumerate(texts):
        assert got[i] == compat_rule(t), (t, got[i], compat_rule(t))
