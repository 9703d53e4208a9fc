"""What a codec is made of. A spec is checked when it is built; its constants derive from it alone."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from .errors import InvalidBits, InvalidDim, ShapeMismatch
from .functions.codebook import MAX_DIM, Codebook, lloyd_max
from .functions.linalg import gaussian, rotation, sketch

#: Bits that a code of so many bits takes when packed: three are stored as four.
STORED_BITS = {1: 1, 2: 2, 3: 4, 4: 4, 8: 8}


def packed_bytes(dim: int, bits: int) -> int:
    per_byte = 8 // STORED_BITS[bits]
    return -(-dim // per_byte)


def _fits(book: Codebook | None, dim: int, bits: int) -> None:
    if book is not None and (book.dim, book.bits) != (dim, bits):
        raise ShapeMismatch(f"a codebook for {dim} and {bits} bits is needed, not for {book.dim} and {book.bits}")


def _matrix(m, dim: int):
    import numpy as np

    m = np.asarray(m, np.float32).astype(np.float64)
    if m.shape != (dim, dim):
        raise ShapeMismatch(f"a matrix of {dim} x {dim} is needed, not {m.shape}")
    return m


@dataclass(frozen=True)
class MseSpec:
    """Rotate, then quantize each coordinate to `bits` bits."""

    dim: int
    bits: int
    seed: int = 42
    matrix: Any = field(default=None, compare=False, repr=False)
    book: Codebook | None = field(default=None, repr=False)  # else the optimal one

    def __post_init__(self):
        if self.bits not in (1, 2, 3, 4):
            raise InvalidBits(f"bits must be 1 to 4, not {self.bits}")
        if not 3 <= self.dim <= MAX_DIM:
            raise InvalidDim(f"dim must be 3 to {MAX_DIM}, not {self.dim}")
        _fits(self.book, self.dim, self.bits)
        if self.matrix is not None:
            object.__setattr__(self, "matrix", _matrix(self.matrix, self.dim))
        else:
            gaussian(1, self.seed)  # checks the seed

    @property
    def codebook(self) -> Codebook:
        return self.book or lloyd_max(self.dim, self.bits)

    @property
    def pi(self):
        return rotation(self.dim, self.seed) if self.matrix is None else self.matrix

    @property
    def bytes_per_vector(self) -> int:
        return packed_bytes(self.dim, self.bits) + 4


@dataclass(frozen=True)
class ProdSpec:
    """An MSE code of bits - 1 bits and one sign per coordinate of the sketched residual."""

    dim: int
    bits: int
    seed: int = 42
    matrix: Any = field(default=None, compare=False, repr=False)
    sketch_matrix: Any = field(default=None, compare=False, repr=False)
    book: Codebook | None = field(default=None, repr=False)  # of bits - 1 bits

    def __post_init__(self):
        if self.bits not in (2, 3, 4):
            raise InvalidBits(f"bits must be 2 to 4, not {self.bits}")
        MseSpec(self.dim, self.bits - 1, self.seed, self.matrix, self.book)
        if self.sketch_matrix is not None:
            object.__setattr__(self, "sketch_matrix", _matrix(self.sketch_matrix, self.dim))

    @property
    def mse(self) -> MseSpec:
        return MseSpec(self.dim, self.bits - 1, self.seed, self.matrix, self.book)

    @property
    def s(self):
        return sketch(self.dim, self.seed) if self.sketch_matrix is None else self.sketch_matrix

    @property
    def scale(self) -> float:
        return math.sqrt(math.pi / 2) / self.dim

    @property
    def bytes_per_vector(self) -> int:
        return packed_bytes(self.dim, self.bits - 1) + packed_bytes(self.dim, 1) + 8


@dataclass(frozen=True)
class ValueSpec:
    """Per group of coordinates: a zero, a scale and codes of `bits` bits."""

    dim: int
    bits: int
    group_size: int = 32

    def __post_init__(self):
        if self.bits not in (2, 4, 8):
            raise InvalidBits(f"bits must be 2, 4 or 8, not {self.bits}")
        if self.dim < 1 or self.group_size < 1 or self.dim % self.group_size:
            raise InvalidDim(f"a group size of {self.group_size} does not divide {self.dim}")

    @property
    def levels(self) -> int:
        return (1 << self.bits) - 1

    @property
    def bytes_per_vector(self) -> int:
        return packed_bytes(self.dim, self.bits) + 8 * (self.dim // self.group_size)


@dataclass(frozen=True)
class KvSpec:
    """Compressed history of keys and values behind a buffer of recent tokens."""

    head_dim: int
    num_kv_heads: int
    key_bits: int = 4
    val_bits: int = 4
    value_group_size: int = 32
    ring_capacity: int = 128
    seed: int = 42
    min_history: int = 16  # shorter histories are not attended to

    def __post_init__(self):
        if self.num_kv_heads < 1 or self.ring_capacity < 1:
            raise InvalidDim("heads and capacity must be positive")
        self.key, self.value  # noqa: B018  both are checked

    @property
    def key(self) -> ProdSpec:
        return ProdSpec(self.head_dim, self.key_bits, self.seed)

    @property
    def value(self) -> ValueSpec:
        return ValueSpec(self.head_dim, self.val_bits, self.value_group_size)
