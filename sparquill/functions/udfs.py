"""Arrow UDFs over the NumPy kernels, and their SQL names.

A vector column is one contiguous buffer per Arrow batch, so a batch is a matrix without a Python loop; codes go back as
one buffer of bytes with offsets. A null vector gives a null code. A wrong length or a value that is not finite is an
error, or with mode="permissive" a null code.

Functions that run on workers name other functions, never modules of this package: a function travels by value, with what
it names, while a module would be looked up on the worker.
"""

from __future__ import annotations

import math
import types
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..specs import MseSpec, ProdSpec, ValueSpec, packed_bytes
from .codebook import MAX_DIM, lloyd_max
from .kernels import (
    mse_dequantize, mse_levels, mse_quantize, prod_dequantize, prod_quantize, prod_query, sign_values, value_dequantize, value_quantize,
)

from .linalg import SEED_SPAN, rotation, sketch

# the functions below their caches: a cache does not travel to a worker
make_book, make_rotation, make_sketch = lloyd_max.__wrapped__, rotation.__wrapped__, sketch.__wrapped__

MSE_TYPE = "struct<indices:binary,norm:float>"
PROD_TYPE = "struct<mse_indices:binary,qjl_signs:binary,residual_norm:float,norm:float>"
VALUE_TYPE = "struct<data:binary,scales:array<float>,zeros:array<float>>"
TYPES = {MseSpec: MSE_TYPE, ProdSpec: PROD_TYPE, ValueSpec: VALUE_TYPE}


def vectors(column, dim: int, mode: str = "strict"):
    """(valid rows, matrix of those rows) of an Arrow list column."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    ok = lengths == dim
    if mode == "strict" and (~ok & (lengths != -1)).any():
        raise ValueError(f"a vector does not have {dim} elements")
    flat = (column if ok.all() else column.filter(pa.array(ok))).flatten()
    if flat.null_count:
        flat = pc.fill_null(flat, float("nan"))
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    if not np.isfinite(x.sum()) and not (finite := np.isfinite(x).all(1)).all():
        if mode == "strict":
            raise ValueError("a vector holds a null or a value that is not finite")
        ok[np.nonzero(ok)[0][~finite]] = False
        x = x[finite]
    return ok, x


def _spread(ok, values):
    """Arrow array with values where ok and nulls elsewhere."""
    import numpy as np
    import pyarrow as pa

    if ok.all():
        return values
    at = np.where(ok, np.cumsum(ok) - 1, 0)
    return values.take(pa.array(at, mask=~ok))


def _binary(rows):
    """Rows of a uint8 matrix as an Arrow binary array, without a copy for each."""
    import numpy as np
    import pyarrow as pa

    rows = np.ascontiguousarray(rows, np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _bytes(column, width: int):
    """Arrow binary column of fixed width and without nulls to a (rows, width) matrix."""
    import numpy as np

    if not len(column):
        return np.zeros((0, width), np.uint8)
    _, offsets, data = column.buffers()
    kind = np.int64 if "large" in str(column.type) else np.int32
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    if (np.diff(ends) != width).any():
        raise ValueError(f"a code does not have {width} bytes")
    return np.frombuffer(data, np.uint8, len(column) * width, int(ends[0])).reshape(-1, width)


def lists(x, kind: str = "float32"):
    import numpy as np
    import pyarrow as pa

    x = np.ascontiguousarray(x, kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def code_parts(code, spec) -> tuple:
    """NumPy parts of an Arrow struct column of codes without nulls, as the kernels take them."""
    import numpy as np

    def matrix(name):
        return np.asarray(code.field(name).flatten(), np.float64).reshape(len(code), -1) if len(code) else np.zeros((0, spec.dim // spec.group_size))

    number = lambda name: np.asarray(code.field(name), np.float64)
    if hasattr(spec, "group_size"):
        return _bytes(code.field("data"), packed_bytes(spec.dim, spec.bits)), matrix("scales"), matrix("zeros")
    if hasattr(spec, "mse"):
        data, signs = _bytes(code.field("mse_indices"), packed_bytes(spec.dim, spec.bits - 1)), _bytes(code.field("qjl_signs"), packed_bytes(spec.dim, 1))
        return data, signs, number("residual_norm"), number("norm")
    return _bytes(code.field("indices"), packed_bytes(spec.dim, spec.bits)), number("norm")


def encoded(x, local, mode: str = "strict"):
    """Arrow struct of the codes of a vector column; local: a spec's constants."""
    import numpy as np
    import pyarrow as pa

    ok, m = vectors(x, local.dim, mode)
    f32 = lambda a: pa.array(np.asarray(a, np.float32))
    if hasattr(local, "group_size"):
        data, scales, zeros = value_quantize(m, local)
        parts = {"data": _binary(data), "scales": lists(scales), "zeros": lists(zeros)}
    elif hasattr(local, "mse"):
        data, signs, rest, norms = prod_quantize(m, local)
        parts = {"mse_indices": _binary(data), "qjl_signs": _binary(signs), "residual_norm": f32(rest), "norm": f32(norms)}
    else:
        data, norms = mse_quantize(m, local)
        parts = {"indices": _binary(data), "norm": f32(norms)}
    return _spread(ok, pa.StructArray.from_arrays(list(parts.values()), list(parts)))


def decoded(code, local):
    """Arrow lists of the vectors of a code column."""
    import numpy as np

    ok = np.asarray(code.is_valid())
    decode_parts = value_dequantize if hasattr(local, "group_size") else prod_dequantize if hasattr(local, "mse") else mse_dequantize
    return _spread(ok, lists(decode_parts(*code_parts(code if ok.all() else code.filter(code.is_valid()), local), local, "float32")))


def scored(q, code, local):
    """Arrow doubles: the estimate of the inner product of each query vector with its code."""
    import numpy as np
    import pyarrow as pa

    ok, _ = vectors(q, local.dim)
    ok &= np.asarray(code.is_valid())
    turned, sketched = prod_query(vectors(q.filter(pa.array(ok)), local.dim)[1], local)
    data, signs, rest, norms = code_parts(code.filter(pa.array(ok)), local)
    coarse = (turned * mse_levels(data, local.mse)).sum(1) * norms
    fine = (sketched * sign_values(signs, local.dim)).sum(1) * rest * local.scale
    return _spread(ok, pa.array(coarse + fine))


def encoder(spec: MseSpec | ProdSpec | ValueSpec, mode: str = "strict") -> Callable:
    """Column function: vector -> code struct of the spec's codec."""
    if mode not in ("strict", "permissive"):
        raise InvalidArgument(mode)
    held = constants(spec)

    @F.arrow_udf(TYPES[type(spec)])
    def encode(x):
        return encoded(x, held(), mode)

    return encode


def decoder(spec: MseSpec | ProdSpec | ValueSpec) -> Callable:
    """Column function: code struct -> vector. A code of the wrong width is an error, a null code a null vector."""
    held = constants(spec)

    @F.arrow_udf("array<float>")
    def decode(code):
        return decoded(code, held())

    return decode


def scorer(spec: ProdSpec) -> Callable:
    """Column function: (query vector, code struct) -> estimate of their inner product, row by row."""
    held = constants(spec)

    @F.arrow_udf("double")
    def score(q, code):
        return scored(q, code, held())

    return score


def plain(spec):
    """A spec's constants as made on the driver. Of standard types only, so that workers need no copy of this package."""
    if isinstance(spec, MseSpec):
        book = types.SimpleNamespace(centroids=spec.codebook.centroids, boundaries=spec.codebook.boundaries)
        return types.SimpleNamespace(dim=spec.dim, bits=spec.bits, pi=spec.pi, codebook=book)
    if isinstance(spec, ProdSpec):
        return types.SimpleNamespace(dim=spec.dim, bits=spec.bits, mse=plain(spec.mse), s=spec.s, scale=spec.scale)
    return types.SimpleNamespace(dim=spec.dim, bits=spec.bits, group_size=spec.group_size, levels=spec.levels)


def constants(spec) -> Callable:
    """A function that gives `plain(spec)` on a worker, from a broadcast of at most two matrices of dim x dim."""
    session = SparkSession.getActiveSession()
    if session is None:
        held = plain(spec)
        return lambda: held
    shared = session.sparkContext.broadcast(plain(spec))
    return lambda: shared.value


def register(spark: SparkSession, mse: MseSpec, prod: ProdSpec, value: ValueSpec) -> list[str]:
    """Registers the seven SQL functions for these specs and returns their names."""
    named = {
        "mse_quantize": encoder(mse), "mse_dequantize": decoder(mse), "prod_quantize": encoder(prod), "prod_dequantize": decoder(prod),
        "attention_score": scorer(prod), "value_quantize": encoder(value), "value_dequantize": decoder(value),
    }
    for name, f in named.items():
        spark.udf.register(name, f)
    return list(named)


#: Constants that a worker keeps for functions with attributes.
KEPT_SPECS = 64


def _made_here(codec: str, dim: int, bits: int, third: int):
    """A spec's constants, made on the worker from its attributes and kept there for as long as it lives. third: seed, or the size of
    a group of a value codec."""
    import sys

    store = sys.modules.setdefault("_sparquill_constants", types.ModuleType("_sparquill_constants")).__dict__
    key = ("spec", codec, dim, bits, third)
    if key not in store:
        if codec == "value":
            if bits not in (2, 4, 8) or dim < 1 or third < 1 or dim % third:
                raise ValueError(f"no value codec of {dim} elements, {bits} bits and groups of {third}")
            made = types.SimpleNamespace(dim=dim, bits=bits, group_size=third, levels=(1 << bits) - 1)
        else:
            low = 2 if codec == "prod" else 1
            if not 3 <= dim <= MAX_DIM or not low <= bits <= 4 or not 0 <= third < SEED_SPAN:
                raise ValueError(f"no {codec} codec of {dim} elements, {bits} bits and seed {third}")
            book = make_book(dim, bits - (codec == "prod"))
            book = types.SimpleNamespace(centroids=book.centroids, boundaries=book.boundaries)
            made = types.SimpleNamespace(dim=dim, bits=bits - (codec == "prod"), pi=make_rotation(dim, third), codebook=book)
            if codec == "prod":
                made = types.SimpleNamespace(dim=dim, bits=bits, mse=made, s=make_sketch(dim, third), scale=math.sqrt(math.pi / 2) / dim)
        if len(store) > KEPT_SPECS:
            for old in [k for k in store if isinstance(k, tuple)]:
                del store[old]
        store[key] = made
    return store[key]


def _by_attributes(codec: str, f: Callable, columns: list, attributes: list):
    """f(columns, constants) for the rows of each set of attributes in a batch, of which there is mostly one."""
    import numpy as np
    import pyarrow as pa

    known = np.stack([np.asarray(a.fill_null(-1), np.int64) for a in attributes], 1)
    sets, which = np.unique(known, axis=0, return_inverse=True)
    if len(sets) == 1:
        return f(*columns, _made_here(codec, *map(int, sets[0])))
    parts, places = [], []
    for i, one in enumerate(sets):
        at = np.nonzero(which.ravel() == i)[0]
        parts.append(f(*[c.take(pa.array(at)) for c in columns], _made_here(codec, *map(int, one))))
        places.append(at)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places))))


def register_with_attributes(spark: SparkSession) -> list[str]:
    """Registers the seven functions with their attributes as arguments, so that one statement may use any number of specs:
    mse_quantize_with(x, dim, bits, seed), mse_dequantize_with(code, dim, bits, seed), the same for prod,
    attention_score_with(q, code, dim, bits, seed), value_quantize_with(v, dim, bits, group_size) and value_dequantize_with.

    Constants are made on the workers. They are rounded to single precision, which hides that machines differ in the last bits
    of a factorization; the functions of `register` take the driver's.
    """
    named = {}
    for codec, kind in (("mse", MSE_TYPE), ("prod", PROD_TYPE), ("value", VALUE_TYPE)):

        def encode(x, dim, bits, third, codec=codec):
            return _by_attributes(codec, encoded, [x], [dim, bits, third])

        def decode(code, dim, bits, third, codec=codec):
            return _by_attributes(codec, decoded, [code], [dim, bits, third])

        named[f"{codec}_quantize_with"] = F.arrow_udf(_four(encode), kind)
        named[f"{codec}_dequantize_with"] = F.arrow_udf(_four(decode), "array<float>")

    def score(q, code, dim, bits, seed):
        return _by_attributes("prod", scored, [q, code], [dim, bits, seed])

    named["attention_score_with"] = F.arrow_udf(score, "double")
    for name, f in named.items():
        spark.udf.register(name, f)
    return list(named)


def _four(f: Callable) -> Callable:
    """f as a function of four arguments, without its default."""
    return lambda a, b, c, d: f(a, b, c, d)
