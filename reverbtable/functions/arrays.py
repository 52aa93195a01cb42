"""Sample-array expressions. ``x`` is ARRAY<DOUBLE>; positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``.

    Catalyst inlines a column into every use, and a lambda re-evaluates whatever it
    captures for each element; a bound lambda variable is computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(value: Column) -> Column:
    """Evaluate in its own projection: the optimiser neither copies nor merges an expression
    it cannot call deterministic. Use before a kernel, whose arguments should be plain columns, and
    before an explode of something costly. The value itself is unchanged."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def let_all(values: list[Column], body) -> Column:
    """``let`` for several values."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return let(named, lambda s: body(*[s[f"v{i}"] for i in range(len(values))]))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def cut(x: Column, start: Column | int, length: Column | int) -> Column:
    """``x[start : start+length]`` with 0-based start; empty when length <= 0."""
    start = start if isinstance(start, Column) else F.lit(start)
    length = length if isinstance(length, Column) else F.lit(length)
    return F.slice(x, (start + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def power(x: Column) -> Column:
    return energy(x) / F.size(x)


def argmax(x: Column) -> Column:
    """First index of the signed maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def peak(x: Column) -> Column:
    return F.greatest(F.array_max(x), -F.array_min(x))


def scaled(x: Column, gain: Column) -> Column:
    return F.transform(x, lambda v: v * gain)


def db(ratio: Column) -> Column:
    return F.lit(10.0) * F.log10(ratio)


def rnd(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)
