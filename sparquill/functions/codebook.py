"""Optimal scalar codebooks for a coordinate of a random unit vector.

Such a coordinate has the density G(d/2) / (sqrt(pi) G((d-1)/2)) (1 - x^2)^((d-3)/2) on [-1, 1]. Lloyd's fixed point
alternates cell edges (midpoints) and levels (conditional means) until the distortion settles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..errors import InvalidBits, InvalidDim

MAX_DIM = 1024
_EDGE = 1 - 1e-15


@dataclass(frozen=True)
class Codebook:
    """Levels and interior cell edges of a scalar quantizer, and its expected squared error."""

    dim: int
    bits: int
    centroids: tuple[float, ...]
    boundaries: tuple[float, ...]
    mse_per_coord: float

    @property
    def mse_total(self) -> float:
        return self.mse_per_coord * self.dim


def density(x, dim: int):
    """Density of a coordinate at x (array)."""
    x = np.clip(x, -_EDGE, _EDGE)
    log_norm = math.lgamma(dim / 2) - math.lgamma((dim - 1) / 2) - 0.5 * math.log(math.pi)
    return np.exp(log_norm + (dim - 3) / 2 * np.log1p(-x * x))


def integral(f, lo: float, hi: float, n: int) -> float:
    """Trapezoid rule with n steps; 0 for an empty range."""
    if hi <= lo or n <= 0:
        return 0.0
    y = f(np.linspace(lo, hi, n + 1))
    return float((y.sum() - 0.5 * (y[0] + y[-1])) * (hi - lo) / n)


def _cell_steps(lo: float, hi: float, resolution: int) -> int:
    return max(64, int((hi - lo) / 2 * resolution))


def _cell_mean(lo: float, hi: float, dim: int, resolution: int) -> float:
    n = _cell_steps(lo, hi, resolution)
    mass = integral(lambda x: density(x, dim), lo, hi, n)
    if hi <= lo or mass < 1e-30:
        return (lo + hi) / 2
    return integral(lambda x: x * density(x, dim), lo, hi, n) / mass


def distortion(levels, edges, dim: int, resolution: int) -> float:
    """Expected squared error per coordinate; edges include -1 and 1."""
    return sum(
        integral(lambda x, c=c: (x - c) ** 2 * density(x, dim), lo, hi, _cell_steps(lo, hi, resolution))
        for c, lo, hi in zip(levels, edges, edges[1:])
    )


@lru_cache(maxsize=256)
def lloyd_max(dim: int, bits: int, max_iter: int = 200, tol: float = 1e-12, resolution: int = 10_000) -> Codebook:
    """The codebook of 2**bits levels. Results are kept per set of arguments."""
    if not 3 <= dim <= MAX_DIM:
        raise InvalidDim(f"dim must be 3 to {MAX_DIM}, not {dim}")
    if not 1 <= bits <= 4:
        raise InvalidBits(f"bits must be 1 to 4, not {bits}")
    count = 1 << bits
    grid = np.linspace(-1 + 1e-10, 1 - 1e-10, 10_000)
    share = np.cumsum(density(grid, dim))
    levels = grid[np.minimum(np.searchsorted(share / share[-1], (np.arange(count) + 0.5) / count), len(grid) - 1)]
    cost = math.inf
    for _ in range(max_iter):
        edges = np.concatenate(([-1.0], (levels[1:] + levels[:-1]) / 2, [1.0]))
        levels = np.array([_cell_mean(lo, hi, dim, resolution) for lo, hi in zip(edges, edges[1:])])
        last, cost = cost, distortion(levels, edges, dim, resolution)
        if abs(last - cost) < tol:
            break
    levels = (levels - levels[::-1]) / 2  # the density is even
    levels = levels.astype(np.float32).astype(float)
    edges = ((levels[1:] + levels[:-1]) / 2).astype(np.float32).astype(float)
    return Codebook(dim, bits, tuple(levels.tolist()), tuple(edges.tolist()), cost)
