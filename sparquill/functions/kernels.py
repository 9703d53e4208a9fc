"""The codecs over NumPy batches (rows, dim), for Arrow UDFs. A second form of what `expressions` says.

A spec, or what `udfs.constants` takes from one, gives the constants. Sums are in double precision, as codes at a cell's
edge would else differ between machines; a cell is found by comparing with each edge in turn, at most 15 passes.
"""

from __future__ import annotations

import numpy as np

from ..specs import STORED_BITS, MseSpec, ProdSpec, ValueSpec, packed_bytes

ROWS = 2048  # rows worked on at once, so that the intermediate arrays stay in the processor's cache


def pack(indices, bits: int):
    """(n, dim) small numbers to (n, packed_bytes) uint8, lowest bits first."""
    width = STORED_BITS[bits]
    indices = np.ascontiguousarray(indices, np.uint8)
    if width == 8:
        return indices
    n, dim = indices.shape
    if width == 1:
        return np.packbits(indices, axis=1, bitorder="little")
    per = 8 // width
    if dim % per:
        full = np.zeros((n, packed_bytes(dim, bits) * per), np.uint8)
        full[:, :dim] = indices
        indices = full
    out = indices[:, ::per].copy()
    for k in range(1, per):
        out |= indices[:, k::per] << np.uint8(width * k)
    return out


def unpack(data, dim: int, bits: int):
    width = STORED_BITS[bits]
    data = np.asarray(data, np.uint8)
    if width == 8:
        return data[:, :dim]
    if width == 1:
        return np.unpackbits(data, axis=1, count=dim, bitorder="little")
    per = 8 // width
    out = np.empty((len(data), data.shape[1] * per), np.uint8)
    for k in range(per):
        out[:, k::per] = (data >> np.uint8(width * k)) & np.uint8((1 << width) - 1)
    return out[:, :dim]


def _parts(n: int):
    for at in range(0, n, ROWS):
        yield slice(at, min(n, at + ROWS))


def lengths(x):
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def mse_cells(x, pi, boundaries):
    """(cells, norms) of the rows of x."""
    x = np.asarray(x, np.float64)
    cells, norms = np.zeros(x.shape, np.uint8), lengths(x)
    by = (1 / (norms + 1e-10))[:, None]
    for rows in _parts(len(x)):
        turned, found = (x[rows] * by[rows]) @ pi.T, cells[rows]
        for edge in boundaries:  # a value on an edge belongs to the lower cell
            found += (turned > edge).view(np.uint8)
    return cells, norms


def mse_quantize(x, spec: MseSpec):
    cells, norms = mse_cells(x, spec.pi, spec.codebook.boundaries)
    return pack(cells, spec.bits), norms


def spelled(values, data, dim: int, bits: int):
    """The values that the codes in data (n, packed_bytes) stand for: a byte at a time, from a table of what each byte spells."""
    width, data = STORED_BITS[bits], np.asarray(data, np.uint8)
    by_code = np.full(1 << width, np.nan)  # a code without a value, of a damaged byte
    by_code[: len(values)] = values
    table = by_code[np.arange(256)[:, None] >> np.arange(0, 8, width) & (1 << width) - 1]
    return table.take(data, 0).reshape(len(data), -1)[:, :dim]


def mse_levels(data, spec: MseSpec):
    """The levels of the cells, still rotated and of unit scale."""
    return spelled(spec.codebook.centroids, data, spec.dim, spec.bits)


def mse_dequantize(data, norms, spec: MseSpec, kind: str = "float64"):
    """The vectors, as numbers of that kind; worked out in double precision, block by block."""
    out, norms = np.empty((len(data), spec.dim), kind), np.asarray(norms, np.float64)[:, None]
    for rows in _parts(len(data)):
        out[rows] = (mse_levels(data[rows], spec) @ spec.pi) * norms[rows]
    return out


def prod_quantize(x, spec: ProdSpec):
    """(mse_indices, qjl_signs, residual_norms, norms)."""
    x = np.asarray(x, np.float64)
    cells, norms = mse_cells(x, spec.mse.pi, spec.mse.codebook.boundaries)
    levels, signs, rest_norms = np.asarray(spec.mse.codebook.centroids), np.empty(x.shape, np.uint8), np.empty(len(x))
    for rows in _parts(len(x)):
        rest = x[rows] - (levels[cells[rows]] @ spec.mse.pi) * norms[rows, None]
        rest_norms[rows] = lengths(rest)
        signs[rows] = rest @ spec.s.T > 0
    return pack(cells, spec.mse.bits), pack(signs, 1), rest_norms, norms


def sign_values(signs, dim: int):
    return spelled((-1.0, 1.0), signs, dim, 1)


def prod_dequantize(data, signs, residual_norms, norms, spec: ProdSpec, kind: str = "float64"):
    out, norms = np.empty((len(data), spec.dim), kind), np.asarray(norms, np.float64)[:, None]
    fine = spec.scale * np.asarray(residual_norms, np.float64)[:, None]
    for rows in _parts(len(data)):
        near = mse_levels(data[rows], spec.mse) @ spec.mse.pi
        near *= norms[rows]
        rest = sign_values(signs[rows], spec.dim) @ spec.s
        rest *= fine[rows]
        near += rest
        out[rows] = near
    return out


def prod_query(query, spec: ProdSpec):
    """(rotated, sketched) queries: what keys in code form are multiplied with."""
    query = np.asarray(query, np.float64)
    return query @ spec.mse.pi.T, query @ spec.s.T


def prod_score(query, data, signs, residual_norms, norms, spec: ProdSpec):
    """(queries, keys) estimates of the inner products."""
    return scores(prod_query(query, spec), data, signs, residual_norms, norms, spec)


def scores(prepared, data, signs, residual_norms, norms, spec: ProdSpec):
    """`prod_score` with queries from `prod_query`: queries are rotated once, keys are never rotated back."""
    turned, sketched = prepared
    out = turned @ mse_levels(data, spec.mse).T * np.asarray(norms)
    out += spec.scale * np.asarray(residual_norms) * (sketched @ sign_values(signs, spec.dim).T)
    return out


def value_quantize(v, spec: ValueSpec):
    """(data, scales, zeros)."""
    groups = np.asarray(v, np.float64).reshape(len(v), spec.dim // spec.group_size, spec.group_size)
    zeros = groups.min(2)
    scales = np.maximum((groups.max(2) - zeros) * (1.0 / spec.levels), 1e-10)
    codes = np.clip(np.rint((groups - zeros[:, :, None]) * (1 / scales)[:, :, None]), 0, spec.levels)
    return pack(codes.reshape(len(v), spec.dim).astype(np.uint8), spec.bits), scales, zeros


def value_dequantize(data, scales, zeros, spec: ValueSpec, kind: str = "float64"):
    out = np.empty((len(data), spec.dim // spec.group_size, spec.group_size), kind)
    scales, zeros = np.asarray(scales)[:, :, None], np.asarray(zeros)[:, :, None]
    for rows in _parts(len(data)):
        codes = data[rows] if spec.bits == 8 else spelled(np.arange(1 << spec.bits), data[rows], spec.dim, spec.bits)
        out[rows] = codes.reshape(-1, *out.shape[1:]) * scales[rows] + zeros[rows]
    return out.reshape(len(data), spec.dim)


class Partial:
    """Softmax attention of some queries over the tokens seen so far: the largest logit, the sum of exponentials relative
    to it, and the values weighted by them. Two partials merge into that of both their tokens."""

    def __init__(self, queries: int, dim: int):
        self.most = np.full(queries, -np.inf)
        self.total = np.zeros(queries)
        self.sums = np.zeros((queries, dim))

    def add(self, at, logits, values):
        """Tokens with logits (queries at, tokens) and values (tokens, dim)."""
        if not logits.shape[1]:
            return
        most = np.maximum(self.most[at], logits.max(1))
        keep = np.exp(self.most[at] - most)
        weights = np.exp(logits - most[:, None])
        self.total[at] = self.total[at] * keep + weights.sum(1)
        self.sums[at] = self.sums[at] * keep[:, None] + weights @ values
        self.most[at] = most


def merged(most, total, sums):
    """(total, sums) of partials of one query, relative to their largest logit."""
    by = np.exp(most - most.max())
    return by @ total, by @ sums
