"""Random rotations and sketches, made once on the driver from a seed and never on executors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..errors import InvalidDim, InvalidSeed
from .codebook import MAX_DIM

SEED_SPAN = 1 << 32


def gaussian(dim: int, seed: int):
    if not 1 <= dim <= MAX_DIM:
        raise InvalidDim(f"dim must be 1 to {MAX_DIM}, not {dim}")
    if not 0 <= seed < SEED_SPAN:
        raise InvalidSeed(f"seed must be 0 to {SEED_SPAN - 1}, not {seed}")
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim))


@lru_cache(maxsize=32)
def rotation(dim: int, seed: int):
    """A Haar-distributed orthogonal matrix: QR of a Gaussian, signs fixed by the diagonal of R. Rounded to float32."""
    q, r = np.linalg.qr(gaussian(dim, seed))
    out = (q * np.where(np.diag(r) < 0, -1.0, 1.0)).astype(np.float32).astype(np.float64)
    out.setflags(write=False)
    return out


@lru_cache(maxsize=32)
def sketch(dim: int, seed: int):
    """A Gaussian matrix for signs of projections, seeded 1000 above the rotation's seed (modulo 2**32)."""
    out = gaussian(dim, (seed + 1000) % SEED_SPAN).astype(np.float32).astype(np.float64)
    out.setflags(write=False)
    return out
