"""Python data sources: seeded Gaussian vectors and codebooks, made on executors.

    register(spark)
    spark.read.format("gaussian_vectors").option("rows", 10**9).option("dim", 64).option("seed", 7).load()   # vec_id, x
    spark.read.format("codebooks").option("dims", "64,128").option("bits", "1,2,3,4").load()                 # as sources.codebooks.SCHEMA
    spark.read.format("codebooks").option("path", "hdfs://.../codebook_d64_b3.json").load()

Vectors come in blocks of BLOCK rows, each with its own stream of the seed, so the same rows come out whatever the number of
partitions. A codebook is computed by the task that gives it, or read from JSON files (comma-separated) and checked.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import CodebookCorrupt, InvalidArgument, InvalidDim
from ..functions.codebook import MAX_DIM, lloyd_max
from .codebooks import SCHEMA

BLOCK = 4096
_BOOK = lloyd_max.__wrapped__


class GaussianVectors(DataSource):
    """Options: rows, dim, seed (0), partitions (8), std (1.0)."""

    @classmethod
    def name(cls) -> str:
        return "gaussian_vectors"

    def schema(self) -> str:
        return "vec_id long, x array<float>"

    def reader(self, schema) -> DataSourceReader:
        return GaussianReader(self.options)


class GaussianReader(DataSourceReader):
    def __init__(self, options):
        try:
            self.rows, self.dim = int(options["rows"]), int(options["dim"])
        except KeyError as e:
            raise InvalidArgument(f"gaussian_vectors needs the option {e}") from None
        self.seed, self.partitions_wanted, self.std = int(options.get("seed", 0)), int(options.get("partitions", 8)), float(options.get("std", 1.0))
        if self.rows < 0 or self.seed < 0 or self.partitions_wanted < 1:
            raise InvalidArgument("rows and seed are 0 or more, partitions 1 or more")
        if not 1 <= self.dim <= MAX_DIM:
            raise InvalidDim(f"dim must be 1 to {MAX_DIM}, not {self.dim}")

    def partitions(self):
        blocks = -(-self.rows // BLOCK)
        n = max(1, min(self.partitions_wanted, blocks))
        return [InputPartition((blocks * i // n, blocks * (i + 1) // n)) for i in range(n)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        for block in range(*partition.value):
            first = block * BLOCK
            n = min(BLOCK, self.rows - first)
            x = np.random.Generator(np.random.PCG64([self.seed, block])).standard_normal((n, self.dim)) * self.std
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.dim), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), vectors], names=["vec_id", "x"])


class Codebooks(DataSource):
    """Options: dims and bits (comma-separated), computed for every pair; or path, JSON files (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "codebooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CodebookReader(self.options)


class CodebookReader(DataSourceReader):
    def __init__(self, options):
        numbers = lambda name: [int(x) for x in options.get(name, "").split(",") if x.strip()]
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        self.wanted = [(d, b) for d in numbers("dims") for b in numbers("bits")]
        if bool(self.paths) == bool(self.wanted):
            raise InvalidArgument("codebooks takes either path or dims and bits")

    def partitions(self):
        return [InputPartition(x) for x in self.paths or self.wanted]

    def read(self, partition):
        if isinstance(partition.value, str):
            yield read_book(partition.value)
            return
        book = _BOOK(*partition.value)
        yield book.dim, book.bits, list(book.centroids), list(book.boundaries), book.mse_per_coord, book.mse_per_coord * book.dim


def read_book(path: str) -> tuple:
    """The row of a JSON codebook, comments allowed; CodebookCorrupt if it breaks the rules of the format."""
    import json
    import re

    from pyarrow import fs

    if "://" in path:
        store, at = fs.FileSystem.from_uri(path)
    else:
        store, at = fs.LocalFileSystem(), path
    with store.open_input_stream(at) as f:
        text = f.read().decode("utf-8")
    try:
        book = json.loads(re.sub(r"/[*].*?[*]/|//[^\n]*", "", text, flags=re.S))
        dim, bits = int(book["d"]), int(book["bits"])
        levels, edges = [float(x) for x in book["centroids"]], [float(x) for x in book["boundaries"]]
    except (ValueError, KeyError, TypeError) as e:
        raise CodebookCorrupt(f"{path}: {e}") from None
    sizes = 1 <= bits <= 4 and len(levels) == 1 << bits and len(edges) == len(levels) + 1
    if not sizes or edges[0] != -1.0 or edges[-1] != 1.0 or any(a >= b for a, b in zip(levels, levels[1:])):
        raise CodebookCorrupt(f"{path} breaks the rules of the format")
    each = float(book.get("mse_per_coord") or 0.0)
    return dim, bits, levels, edges[1:-1], each, float(book.get("mse_total") or each * dim)


def register(spark: SparkSession) -> list[str]:
    """Makes both formats known to the session and returns their names."""
    for source in (GaussianVectors, Codebooks):
        spark.dataSource.register(source)
    return [GaussianVectors.name(), Codebooks.name()]
