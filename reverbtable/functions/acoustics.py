"""Closed-form geometry and room acoustics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SOUND_SPEED = 343.0
SABINE = 0.161
DP_HALF_MS = 2.5


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def dist(a: tuple, b: tuple) -> Column:
    return norm(*[p - q for p, q in zip(a, b)])


def xyz(alias: str = "") -> tuple[Column, Column, Column]:
    pre = f"{alias}." if alias else ""
    return F.col(f"{pre}x"), F.col(f"{pre}y"), F.col(f"{pre}z")


def cart2sph(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Azimuth, elevation from +z, radius."""
    return {"azi": F.atan2(y, x), "ele": F.atan2(F.sqrt(x * x + y * y), z), "r": norm(x, y, z)}


def sph2cart(azi: Column, ele: Column, r: Column | None = None) -> dict[str, Column]:
    rr = F.lit(1.0) if r is None else F.coalesce(r, F.lit(1.0))
    return {"x": rr * F.sin(ele) * F.cos(azi), "y": rr * F.sin(ele) * F.sin(azi), "z": rr * F.cos(ele)}


def unit(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Direction of a vector; null for the zero vector."""
    n = norm(x, y, z)
    return {"x": F.try_divide(x, n), "y": F.try_divide(y, n), "z": F.try_divide(z, n)}


def rotate_z(x: Column, y: Column, z: Column, deg: Column, scale: Column, shift: tuple) -> dict[str, Column]:
    """Turn about z, scale, then translate."""
    c, s = F.cos(F.radians(deg)), F.sin(F.radians(deg))
    return {"x": shift[0] + (x * c - y * s) * scale, "y": shift[1] + (x * s + y * c) * scale,
            "z": shift[2] + z * scale}


def rotate(rot: Column, x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Apply a 3x3 rotation given as ARRAY<ARRAY<DOUBLE>>."""
    row = lambda i: sum((F.get(F.get(rot, F.lit(i)), F.lit(j)) * v for j, v in enumerate((x, y, z))), F.lit(0.0))
    return {"x": row(0), "y": row(1), "z": row(2)}


def volume(lx: Column, ly: Column, lz: Column) -> Column:
    return lx * ly * lz


def surface(lx: Column, ly: Column, lz: Column) -> Column:
    return 2.0 * (lx * ly + lx * lz + ly * lz)


def wall_absorption(lx: Column, ly: Column, lz: Column, walls: list[Column]) -> Column:
    """Sum of absorption times area over the walls x0 x1 y0 y1 z0 z1."""
    return ((walls[0] + walls[1]) * ly * lz + (walls[2] + walls[3]) * lx * lz
            + (walls[4] + walls[5]) * lx * ly)


def sabine_t60(lx: Column, ly: Column, lz: Column, walls: list[Column], eps: float = 0.0) -> Column:
    return SABINE * volume(lx, ly, lz) / (wall_absorption(lx, ly, lz, walls) + eps)


def absorption_from_t60(lx: Column, ly: Column, lz: Column, t60: Column, half_surface: bool = False) -> Column:
    s = surface(lx, ly, lz)
    return F.try_divide(SABINE * volume(lx, ly, lz), (s / 2.0 if half_surface else s) * t60)


def wall_weight_for_t60(lx: Column, ly: Column, lz: Column, t60: Column, weights: list[Column]) -> tuple:
    """Common factor x in [0, 1] giving Sabine T60 with absorptions x*w, weights scaled to max 1.

    Sabine's equation is linear in x, so no solver is needed.
    """
    top = F.greatest(*weights)
    w = [c / top for c in weights]
    x = F.least(F.lit(1.0), SABINE * volume(lx, ly, lz) / (t60 * wall_absorption(lx, ly, lz, w)))
    return x, [F.sqrt(1.0 - x * c) for c in w], [x * c for c in w]


def t60_feasible(lx: Column, ly: Column, lz: Column, t60: Column, walls: list[Column],
                 c: float = SOUND_SPEED, ism_db: float = 12.0, third_test: bool = True) -> Column:
    sab = sabine_t60(lx, ly, lz, walls, eps=1e-4)
    product = F.lit(1.0)
    for a in walls:
        product = product * (1.0 - a)
    ok = ((F.abs(t60 - sab) < 0.005) & (product != 0.0) & (wall_absorption(lx, ly, lz, walls) != 0.0))
    if third_test:
        ok = ok & (F.lit(ism_db / 60.0) * sab >= 3.0 * norm(lx, ly, lz) / F.lit(c))
    return ok


def diffuse_coherence(freq: Column, d: Column, c: float = SOUND_SPEED) -> Column:
    """Spherical diffuse field: sin(x)/x at x = 2*pi*f*d/c."""
    x = F.lit(2 * math.pi) * freq * d / F.lit(c)
    return F.when(x == 0.0, F.lit(1.0)).otherwise(F.sin(x) / x)


def dp_phase(ele: Column, azi: Column, m1: tuple, m2: tuple, freq: Column, c: float = SOUND_SPEED) -> dict[str, Column]:
    """Direct-path phase difference exp(-j 2 pi f ITD) of a microphone pair."""
    look = sph2cart(azi, ele)
    itd = (look["x"] * (m2[0] - m1[0]) + look["y"] * (m2[1] - m1[1]) + look["z"] * (m2[2] - m1[2])) / F.lit(c)
    ph = F.lit(-2 * math.pi) * freq * itd
    return {"re": F.cos(ph), "im": F.sin(ph)}
