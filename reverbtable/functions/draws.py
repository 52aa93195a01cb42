"""Reproducible draws: a pure function of (seed, id), whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: str, *ids: str | Column) -> Column:
    parts = [F.lit(seed)] + [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts))


def uniform(seed: str, *ids: str | Column) -> Column:
    """Uniform on [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(seed, *ids), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_range(lo, hi, seed: str, *ids: str | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return lo + (hi - lo) * uniform(seed, *ids)


def pick_index(n: Column, seed: str, *ids: str | Column) -> Column:
    """Uniform integer on [0, n)."""
    return F.floor(uniform(seed, *ids) * n).cast("long")


def normal(seed: str, *ids: str | Column) -> Column:
    """Standard normal by Box-Muller on two digests."""
    u1 = F.greatest(uniform(seed + ":a", *ids), F.lit(2.0 ** -33))
    u2 = uniform(seed + ":b", *ids)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
