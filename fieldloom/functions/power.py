"""Yeo-Johnson power transform and other element-wise transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def yeo_johnson(c: Column, lam: Column) -> Column:
    """Forward transform; null stays null."""
    up = F.when(F.abs(lam) < 1e-12, F.log1p(c)).otherwise((F.pow(c + 1, lam) - 1) / F.when(F.abs(lam) < 1e-12, 1.0).otherwise(lam))
    two = 2 - lam
    down = F.when(F.abs(two) < 1e-12, -F.log1p(-c)).otherwise(-(F.pow(1 - c, two) - 1) / F.when(F.abs(two) < 1e-12, 1.0).otherwise(two))
    return F.when(c >= 0, up).when(c < 0, down)


def yeo_johnson_inverse(c: Column, lam: Column) -> Column:
    safe = F.when(F.abs(lam) < 1e-12, 1.0).otherwise(lam)
    two = 2 - lam
    safe_two = F.when(F.abs(two) < 1e-12, 1.0).otherwise(two)
    up = F.when(F.abs(lam) < 1e-12, F.exp(c) - 1).otherwise(F.pow(c * lam + 1, 1 / safe) - 1)
    down = F.when(F.abs(two) < 1e-12, 1 - F.exp(-c)).otherwise(1 - F.pow(1 - two * c, 1 / safe_two))
    return F.when(c >= 0, up).when(c < 0, down)


def yeo_johnson_np(x: np.ndarray, lam: float) -> np.ndarray:
    y = np.empty_like(x)
    pos = x >= 0
    y[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else (np.power(x[pos] + 1, lam) - 1) / lam
    y[~pos] = -np.log1p(-x[~pos]) if abs(2 - lam) < 1e-12 else -(np.power(1 - x[~pos], 2 - lam) - 1) / (2 - lam)
    return y


def fit_lambda(x: np.ndarray, low: float = -3.0, high: float = 5.0) -> float:
    """Maximum-likelihood lambda, by a grid and golden-section search."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 2 or np.ptp(x) == 0:
        return 1.0
    const = np.sum(np.sign(x) * np.log1p(np.abs(x)))

    def loss(lam: float) -> float:
        v = yeo_johnson_np(x, lam).var()
        return np.inf if not np.isfinite(v) or v <= 0 else len(x) / 2 * np.log(v) - (lam - 1) * const

    grid = np.linspace(low, high, 81)
    best = int(np.argmin([loss(g) for g in grid]))
    a, b, ratio = grid[max(0, best - 1)], grid[min(80, best + 1)], (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float((a + b) / 2)


def pack(c: Column, low: Column, high: Column, bits: int = 16, signed: bool = True) -> tuple[Column, Column, Column]:
    """(packed, scale, offset): floats as integers of ``bits``; null is the lowest value (0 if unsigned); rounds half to even."""
    scale = (high - low) / (2**bits - 2)
    offset = (high + low) / 2 if signed else low - scale
    nodata = -(2 ** (bits - 1)) if signed else 0
    kind = {8: "byte", 16: "short", 32: "int"}[bits] if signed else {8: "short", 16: "int", 32: "long"}[bits]
    return F.coalesce(F.rint((c - offset) / F.nullif(scale, F.lit(0.0))), F.when(c.isNotNull(), 0.0), F.lit(nodata)).cast(kind), scale, offset


def unpack(c: Column, scale: Column, offset: Column, nodata: int) -> Column:
    return F.when(c != nodata, c * scale + offset)
