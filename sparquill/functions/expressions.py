"""The codecs as Catalyst expressions over array columns. Everything stays in the JVM and in double precision.

Constants enter as one folded literal each. A stage's result is fenced before the next stage reads it inside a lambda,
so that the optimizer does not repeat the stage for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import STORED_BITS, MseSpec, ProdSpec, ValueSpec, packed_bytes


def fence(df: DataFrame) -> DataFrame:
    """df, whose columns no projection or filter above repeats."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).where("_fence >= 0").drop("_fence")


def vector_literal(values) -> Column:
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def matrix_literal(rows) -> Column:
    return F.expr("array(" + ",".join("array(" + ",".join(f"{float(v)!r}D" for v in r) + ")" for r in rows) + ")")


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def times(matrix, x: Column) -> Column:
    """matrix @ x for a matrix of constants."""
    return F.transform(matrix_literal(matrix), lambda row: dot(row, x))


def cells(y: Column, boundaries) -> Column:
    """Number of boundaries strictly below each coordinate: ties go to the lower cell."""
    edges = vector_literal(boundaries)
    return F.transform(y, lambda v: F.size(F.filter(edges, lambda b: b < v)))


def gather(indices: Column, levels) -> Column:
    table = vector_literal(levels)
    return F.transform(indices, lambda i: F.element_at(table, i + 1))


def pack(indices: Column, dim: int, bits: int) -> Column:
    """Small whole numbers to bytes (as ints), lowest bits first; three bits take four."""
    width = STORED_BITS[bits]
    per = 8 // width
    return F.transform(
        F.sequence(F.lit(0), F.lit(packed_bytes(dim, bits) - 1)),
        lambda b: F.aggregate(
            F.sequence(F.lit(0), F.lit(per - 1)),
            F.lit(0),
            lambda acc, k: (acc + F.coalesce(F.get(indices, b * per + k), F.lit(0)) * F.element_at(F.array(*[F.lit(1 << (width * i)) for i in range(per)]), k + 1)).cast("int"),
        ),
    )


def unpack(data: Column, dim: int, bits: int) -> Column:
    """Bytes (as ints) to the dim numbers packed in them."""
    width = STORED_BITS[bits]
    per = 8 // width
    step = F.array(*[F.lit(1 << (width * i)) for i in range(per)])
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (F.floor(F.get(data, F.floor(i / per).cast("int")) / F.element_at(step, i % per + 1)) % (1 << width)).cast("int"),
    )


def to_hex(data: Column) -> Column:
    """Bytes (as ints) to upper-case hex text."""
    return F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b), 2, "0")), "")


def to_binary(data: Column) -> Column:
    return F.unhex(to_hex(data))


def from_binary(data: Column) -> Column:
    """A binary column to bytes as ints (0 to 255)."""
    return F.transform(
        F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")
    )


def signs(p: Column) -> Column:
    """1 where positive, else 0."""
    return F.transform(p, lambda v: F.when(v > 0, 1).otherwise(0))


# --- codecs: each takes a DataFrame with a vector column and adds its parts ---------------------------------------------


def mse_quantize(df: DataFrame, x: str, spec: MseSpec) -> DataFrame:
    """Adds idx (array of cells) and norm."""
    unit = fence(df.withColumn("norm", norm(doubles(F.col(x)))))
    unit = fence(unit.withColumn("_u", F.transform(x, lambda v: v.cast("double") * (1 / (F.col("norm") + 1e-10)))))
    turned = fence(unit.withColumn("_y", times(spec.pi, F.col("_u"))).drop("_u"))
    return fence(turned.withColumn("idx", cells(F.col("_y"), spec.codebook.boundaries)).drop("_y"))


def mse_dequantize(df: DataFrame, spec: MseSpec, to: str = "xhat") -> DataFrame:
    """Adds the decoded vector of idx and norm."""
    levels = fence(df.withColumn("_c", gather(F.col("idx"), spec.codebook.centroids)))
    back = fence(levels.withColumn("_b", times(spec.pi.T, F.col("_c"))).drop("_c"))
    return back.withColumn(to, scaled(F.col("_b"), F.col("norm"))).drop("_b")


def prod_quantize(df: DataFrame, x: str, spec: ProdSpec) -> DataFrame:
    """Adds idx, norm, sign (array of 0 and 1) and residual_norm."""
    coded = fence(mse_dequantize(mse_quantize(df, x, spec.mse), spec.mse, "_m"))
    rest = fence(coded.withColumn("_r", F.zip_with(doubles(F.col(x)), "_m", lambda a, b: a - b)).drop("_m"))
    projected = fence(rest.withColumn("residual_norm", norm(F.col("_r"))).withColumn("_p", times(spec.s, F.col("_r"))).drop("_r"))
    return fence(projected.withColumn("sign", signs(F.col("_p"))).drop("_p"))


def prod_dequantize(df: DataFrame, spec: ProdSpec, to: str = "xhat") -> DataFrame:
    """Adds the decoded vector of idx, norm, sign and residual_norm."""
    coarse = fence(mse_dequantize(df, spec.mse, "_m").withColumn("_s", F.transform("sign", lambda b: (2 * b - 1).cast("double"))))
    fine = fence(coarse.withColumn("_q", times(spec.s.T, F.col("_s"))).drop("_s"))
    return fine.withColumn(to, F.zip_with("_m", "_q", lambda m, q: m + spec.scale * F.col("residual_norm") * q)).drop("_m", "_q")


def value_quantize(df: DataFrame, v: str, spec: ValueSpec) -> DataFrame:
    """Adds vidx (array of codes), scales and zeros (arrays, one per group)."""
    g = spec.group_size
    groups = F.transform(F.sequence(F.lit(0), F.lit(spec.dim // g - 1)), lambda k: F.slice(v, k * g + 1, g))
    split = fence(df.withColumn("_g", F.transform(groups, doubles)))
    ranged = fence(
        split.withColumn("zeros", F.transform("_g", F.array_min)).withColumn(
            "scales", F.transform("_g", lambda x: F.greatest((F.array_max(x) - F.array_min(x)) * (1.0 / spec.levels), F.lit(1e-10)))
        )
    )
    codes = F.flatten(
        F.transform(
            F.arrays_zip(F.col("_g").alias("x"), F.col("scales").alias("s"), F.col("zeros").alias("z")),
            lambda p: F.transform(p["x"], lambda a: F.least(F.greatest(F.rint((a - p["z"]) * (1 / p["s"])), F.lit(0.0)), F.lit(float(spec.levels))).cast("int")),
        )
    )
    return fence(ranged.withColumn("vidx", codes).drop("_g"))


def value_dequantize(df: DataFrame, spec: ValueSpec, to: str = "vhat") -> DataFrame:
    """Adds the decoded vector of vidx, scales and zeros."""
    g = spec.group_size
    at = lambda c, i: F.element_at(c, F.floor(i / g).cast("int") + 1)
    return df.withColumn(to, F.transform("vidx", lambda q, i: q * at("scales", i) + at("zeros", i)))
