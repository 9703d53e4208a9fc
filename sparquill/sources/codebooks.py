"""Codebooks as tables: read from JSON files, written and looked up as rows (dim, bits, centroids, boundaries, ...)."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CodebookCorrupt, CodebookMissing, InvalidBits, InvalidDim
from ..functions.codebook import MAX_DIM, Codebook, lloyd_max
from ..specs import MseSpec, ProdSpec

SCHEMA = "dim int, bits int, centroids array<double>, boundaries array<double>, mse_per_coord double, mse_total double"
_JSON = "d int, bits int, centroids array<double>, boundaries array<double>, mse_per_coord double, mse_total double"
#: Setting that names a folder of JSON codebooks, codebook_d{dim}_b{bits}.json.
FOLDER_CONF = "spark.sparquill.codebooks"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Codebooks of JSON files (comments allowed). Files hold the edges with -1 and 1; the table has interior ones.

    A file that breaks a rule raises CodebookCorrupt: a field is missing, sizes are not 2**bits and 2**bits + 1, the
    ends are not -1 and 1, or the levels do not rise.
    """
    raw = spark.read.schema(_JSON).option("multiLine", True).option("allowComments", True).json(path)
    steps = F.zip_with(F.slice("centroids", 1, F.size("centroids") - 1), F.slice("centroids", 2, F.size("centroids")), lambda a, b: a < b)
    sound = (
        F.col("d").isNotNull() & F.col("bits").between(1, 4) & (F.size("centroids") == F.pow(F.lit(2), "bits"))
        & (F.size("boundaries") == F.size("centroids") + 1) & (F.element_at("boundaries", 1) == -1.0) & (F.element_at("boundaries", -1) == 1.0)
        & F.forall(steps, lambda s: s)
    )
    if not raw.where(~F.coalesce(sound, F.lit(False))).isEmpty():
        raise CodebookCorrupt(f"a codebook under {path} breaks the rules of the format")
    mse = F.coalesce("mse_per_coord", F.lit(0.0))
    return raw.select(
        F.col("d").alias("dim"), "bits", "centroids", F.slice("boundaries", F.lit(2), F.size("boundaries") - 2).alias("boundaries"),
        mse.alias("mse_per_coord"), F.coalesce("mse_total", mse * F.col("d")).alias("mse_total"),
    )


def to_table(spark: SparkSession, books: list[Codebook]) -> DataFrame:
    rows = [(b.dim, b.bits, list(b.centroids), list(b.boundaries), b.mse_per_coord, b.mse_total) for b in books]
    return spark.createDataFrame(rows, SCHEMA)


def find(books: DataFrame, dim: int, bits: int) -> Codebook:
    """The codebook of a table of them."""
    row = books.where((F.col("dim") == dim) & (F.col("bits") == bits)).first()
    if row is None:
        raise CodebookMissing(f"no codebook for dimension {dim} and {bits} bits")
    return Codebook(dim, bits, tuple(row["centroids"]), tuple(row["boundaries"]), row["mse_per_coord"])


def get(spark: SparkSession, dim: int, bits: int, books: DataFrame | None = None, folder: str | None = None) -> Codebook:
    """From the table if it is there, else from the folder given or configured, else computed (and kept)."""
    if not 1 <= dim <= MAX_DIM:
        raise InvalidDim(f"dim must be 1 to {MAX_DIM}, not {dim}")
    if bits not in (1, 2, 3, 4):
        raise InvalidBits(f"bits must be 1 to 4, not {bits}")
    if books is not None:
        try:
            return find(books, dim, bits)
        except CodebookMissing:
            pass
    folder = folder or spark.conf.get(FOLDER_CONF, None)
    if folder:
        path = os.path.join(folder, f"codebook_d{dim}_b{bits}.json")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return find(read_json(spark, path), dim, bits)  # checked against what was asked for
    return lloyd_max(dim, bits)


def with_book(spark: SparkSession, spec: MseSpec | ProdSpec, books: DataFrame | None = None, folder: str | None = None) -> MseSpec | ProdSpec:
    """spec with the codebook that `get` finds for it. Both engines then code with its levels and edges."""
    bits = spec.bits if isinstance(spec, MseSpec) else spec.mse.bits
    return replace(spec, book=get(spark, spec.dim, bits, books, folder))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, x, label) of the embeddings table."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"), "label")
