"""Errors raised while a plan is built, before any job runs."""


class SparquillError(ValueError):
    """Base of the library's errors."""


class InvalidDim(SparquillError):
    """A dimension is out of range or does not divide as it must."""


class InvalidBits(SparquillError):
    """A bit width that the codec does not have."""


class InvalidSeed(SparquillError):
    """A seed outside of 0 to 2**32 - 1."""


class ShapeMismatch(SparquillError):
    """Arrays or matrices of the wrong size."""


class InvalidArgument(SparquillError):
    """Arguments that do not go together."""


class CodebookMissing(SparquillError):
    """No codebook for the dimension and bit width."""


class CodebookCorrupt(SparquillError):
    """A stored codebook that breaks its own rules."""


class BufferTooSmall(SparquillError):
    """More tokens than the buffer has room for."""
