"""The codecs over DataFrames: encode a vector column, decode a code column, measure the error, count the bytes.

`engine="arrow"`, the default, runs the NumPy kernels on Arrow batches; `engine="jvm"` builds Catalyst expressions (fixed
order of sums, no Python), some ten times slower at 64 dimensions: the cross-check. Both are narrow projections without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import expressions as x
from ..functions import udfs
from ..specs import MseSpec, ProdSpec, ValueSpec, packed_bytes

ENGINES = ("arrow", "jvm")
_QUANTIZE = {MseSpec: x.mse_quantize, ProdSpec: x.prod_quantize, ValueSpec: x.value_quantize}
_DEQUANTIZE = {MseSpec: x.mse_dequantize, ProdSpec: x.prod_dequantize, ValueSpec: x.value_dequantize}


def _checked(engine: str) -> str:
    if engine not in ENGINES:
        raise InvalidArgument(f"engine must be one of {ENGINES}, not {engine!r}")
    return engine


def encode(df: DataFrame, vector: str, spec, engine: str = "arrow", to: str = "code") -> DataFrame:
    """Adds the code: with "arrow" one struct column `to`, with "jvm" the parts as columns."""
    return df.withColumn(to, udfs.encoder(spec)(vector)) if _checked(engine) == "arrow" else _QUANTIZE[type(spec)](df, vector, spec)


def decode(df: DataFrame, spec, engine: str = "arrow", code: str = "code", to: str = "decoded") -> DataFrame:
    """Adds the decoded vector of a code made by `encode` with the same engine."""
    return df.withColumn(to, udfs.decoder(spec)(code)) if _checked(engine) == "arrow" else _DEQUANTIZE[type(spec)](df, spec, to)


def code_text(df: DataFrame, spec, engine: str = "arrow", code: str = "code") -> DataFrame:
    """The packed bytes of the parts as hex text: `codes`, and for a ProdSpec `signs`."""
    if _checked(engine) == "arrow":
        name = {MseSpec: "indices", ProdSpec: "mse_indices", ValueSpec: "data"}[type(spec)]
        df = df.withColumn("codes", F.hex(F.col(code)[name]))
        return df.withColumn("signs", F.hex(F.col(code)["qjl_signs"])) if isinstance(spec, ProdSpec) else df
    if isinstance(spec, ValueSpec):
        return df.withColumn("codes", x.to_hex(x.pack(F.col("vidx"), spec.dim, spec.bits)))
    bits = spec.bits - 1 if isinstance(spec, ProdSpec) else spec.bits
    df = df.withColumn("codes", x.to_hex(x.pack(F.col("idx"), spec.dim, bits)))
    return df.withColumn("signs", x.to_hex(x.pack(F.col("sign"), spec.dim, 1))) if isinstance(spec, ProdSpec) else df


def squared_error(df: DataFrame, vector: str, decoded: str, to: str = "sq_error") -> DataFrame:
    d = x.fence(df.withColumn("_d", F.zip_with(vector, decoded, lambda a, b: a.cast("double") - b)))
    return d.withColumn(to, x.dot(F.col("_d"), F.col("_d"))).drop("_d")


def width(spec) -> int:
    return packed_bytes(spec.dim, spec.bits)
