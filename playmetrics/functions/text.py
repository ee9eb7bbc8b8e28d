"""Repair of text that was decoded as Latin-1 when it was UTF-8.

Everything is a native Catalyst expression evaluated inside the JVM task: no
Python worker and no serialization per row (the stage is whole-stage
generated; the lambda-based parts run interpreted within it), and the
expression can sit under filters and aggregates.

One repair *layer* takes a string whose characters all fit in one byte
(U+0000..U+00FF) and at least one of which is non-ASCII, re-encodes it as
Latin-1 and, if those bytes are valid UTF-8, reads them as UTF-8.

``encode(x, 'ISO-8859-1')`` raises on characters above U+00FF, so it only
ever runs inside a CASE branch guarded by ``NOT x RLIKE '[^\\x00-\\xff]'``.
(``^[\\x00-\\xff]*$`` would be wrong: ``$`` also matches before a final line
separator.) Intermediate values are bound as higher-order-function lambda
variables, so each is computed once and the plan holds one copy of the layer
body per layer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex classes.
WIDE = r"[^\x00-\xff]"        # some character does not fit in Latin-1
NON_ASCII = r"[^\x00-\x7f]"   # some character is outside ASCII

#: Layers of damage undone by default.
MAX_LAYERS = 2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _latin1_bytes_as_string(x: Column) -> Column:
    return F.encode(x, "ISO-8859-1").cast("string")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _layer(x: Column) -> Column:
    """One repair layer for a string known to hold a non-ASCII character."""
    fixed = _let(_latin1_bytes_as_string(x),
                 lambda b: F.when(F.is_valid_utf8(b), b).otherwise(x))
    return F.when(~x.rlike(WIDE), fixed).otherwise(x)


def _layers(x: Column, k: int) -> Column:
    """Up to ``k`` layers, stopping as soon as one changes nothing.

    A layer that leaves its input unchanged would leave it unchanged again, so
    clean text pays for one layer only. A layer that does change its input
    decodes valid multi-byte sequences, so its output is again non-ASCII and
    needs no second ASCII test.
    """
    if k == 1:
        return _layer(x)
    return _let(_layer(x), lambda y: F.when(y == x, y).otherwise(_layers(y, k - 1)))


def _lossy_decode(x: Column) -> Column:
    """Latin-1 bytes of ``x`` read as UTF-8, bad sequences becoming U+FFFD."""
    return F.make_valid_utf8(_latin1_bytes_as_string(x))


def repair_text(c: Column | str, mode: str = "intended", layers: int = MAX_LAYERS) -> Column:
    """Undo up to ``layers`` layers of UTF-8-read-as-Latin-1 damage.

    ``layers`` (1 or more) counts in ``mode='intended'`` only: text damaged more often comes
    back with the rest of its damage. Each more layer makes the expression longer, and costs
    only the texts that have it.

    ``mode='intended'``: each layer is applied only when it yields valid UTF-8,
    so correct text, text with characters above U+00FF, and NULL pass unchanged.

    ``mode='compat'``: the legacy rule, kept bug for bug. Text holding ``?``,
    any character above U+00FF, or whose first decode yields one (including
    the U+FFFD replacement) is returned unchanged; otherwise the first decode
    if it is pure ASCII, else the second decode. Single damage therefore comes
    back with a U+FFFD where the accent was.
    """
    t = _col(c)
    if mode == "intended":
        if layers < 1:
            raise ValueError("layers must be 1 or more")
        return F.when(t.rlike(NON_ASCII), _layers(t, layers)).otherwise(t)
    if mode == "compat":
        unchanged = (t.isNull() | ~t.rlike(NON_ASCII) | t.rlike(WIDE)
                     | (F.instr(t, "?") > 0))

        def second(o: Column) -> Column:
            return (F.when(o.rlike(WIDE), t)
                    .when(~o.rlike(NON_ASCII), o)
                    .otherwise(_lossy_decode(o)))

        return F.when(unchanged, t).otherwise(_let(_lossy_decode(t), second))
    raise ValueError(f"unknown repair mode {mode!r}")


def damage_text(c: Column | str, times: int = 1) -> Column:
    """The damage `repair_text` undoes: UTF-8 bytes read back as Latin-1.

    Used to build damaged fixtures from clean text.
    """
    x = _col(c)
    for _ in range(times):
        x = F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return x
