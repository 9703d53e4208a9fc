"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**BITS cells in its own order, the cells' curve index sorts the rows, and the sorted run
is cut into shards whose row counts differ by one at most. Rows near each other on the curve are near in every
dimension, so a shard or a file within it spans a small box and a filter on any of the dimensions skips most files.

Defined cases: a null in a dimension has the lowest cell; a null text has size 1 and the checksum 0; ties of the curve
are cut by doc_id, size and checksum, and rows that agree in all of them are interchangeable; an empty table gives no
row; a dimension with one value only adds nothing; columns of the input with the names of the result are not read, and in
the files of `write` a column `shard` of the input gives way to that of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import global_rank, stash, table, tidy

BITS = 8
SHARDS = 16
_KEY_BYTES = 6


def hilbert_index(cells, bits: int = BITS):
    """Curve index of each row of an (n, dimensions) array of cells: axes to transposed index, then bits interleaved."""
    import numpy as np

    x = [np.asarray(c, np.int64).copy() for c in np.asarray(cells).T]
    k = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the cubes, largest first
        for i in range(k):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turned, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, k):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[k - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(k):
            index = (index << 1) | (((x[i] ^ t) >> b) & 1)
    return index


def _number(c: Column, kind: T.DataType, skip: int) -> Column:
    """A column's value as a number that keeps its order: strings by the bytes after what all values share."""
    if isinstance(kind, T.StringType):
        key = F.rpad(F.hex(F.substring(c.cast("binary"), skip + 1, _KEY_BYTES)), 2 * _KEY_BYTES, "0")
        return F.conv(key, 16, 10).cast("double")
    return F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1)


def curve(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Adds `curve`, the Hilbert index over the dimensions (strings, or numbers on a logarithmic scale)."""
    kinds = {d: df.schema[d].dataType for d in dimensions}
    # one row: the span of each dimension
    span = df.agg(*[f(d).alias(f"{n}_{i}") for i, d in enumerate(dimensions) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    skips = {}
    for i, d in enumerate(dimensions):
        lo, hi = (str(span[f"{n}_{i}"] or "").encode() for n in ("lo", "hi"))
        skips[d] = next((at for at, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
    edges = df.sparkSession.createDataFrame(
        [tuple(span[f"{n}_{i}"] for i in range(len(dimensions))) for n in ("lo", "hi")],
        T.StructType([T.StructField(d, kinds[d]) for d in dimensions]),
    )
    lo, hi = (list(r) for r in edges.select(*[_number(F.col(d), kinds[d], skips[d]).alias(d) for d in dimensions]).collect())
    top = (1 << bits) - 1
    cells = []
    for i, d in enumerate(dimensions):
        width = (hi[i] or 0.0) - (lo[i] or 0.0)
        share = (_number(F.col(d), kinds[d], skips[d]) - F.lit(lo[i] or 0.0)) / F.lit(width or 1.0)
        cells.append(F.coalesce(1 + F.floor(share * (top - 1)), F.lit(0)).cast("long"))

    @F.pandas_udf("long")
    def index(c):
        import numpy as np
        import pandas as pd

        return pd.Series(hilbert_index(np.stack([c[x].to_numpy(np.int64) for x in c.columns], 1), bits))

    return df.withColumn("curve", index(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)])))


@tidy
def shard(docs: DataFrame, dimensions: tuple[str, ...] = ("lang", "source", "size"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, curve, shard and slot of every row of docs."""
    own = [d for d in dimensions if d != "size"]
    facts = stash(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), *own,
        )
    )
    n = facts.count()
    placed = stash(curve(facts, list(dimensions), bits))  # range bounds and the sort itself both read it
    ranked = global_rank(placed, "curve", "doc_id", "size", "text_crc32")
    # whole numbers only: the least rank of a shard is the least r with r * shards >= shard * n
    at = F.expr(f"(rank * {shards}) div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", at.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long")).drop("rank")


def write(docs: DataFrame, to: str, files_per_shard: int = 4, **options) -> str:
    """Writes the rows of docs, with their columns, into a folder per shard; files follow the curve."""
    key = [(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")]
    placed = shard(docs, **options).groupBy("doc_id", "size", "text_crc32").agg(F.min(F.struct("shard", "curve", "slot")).alias("at"))
    placed = placed.withColumnRenamed("doc_id", "_of")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), *key).alias("d")
    rows = rows.join(placed.alias("p"), F.expr("d._id <=> p._of and d.size = p.size and d.text_crc32 = p.text_crc32"))
    n = files_per_shard * options.get("shards", SHARDS)
    slot = "_" * (1 + max(map(len, docs.columns))) + "slot"  # longer than any name of the input
    (
        rows.select(*[F.col("d._row").getField(c).alias(c) for c in docs.columns if c != "shard"], F.col("p.at.shard").alias("shard"), F.col("p.at.slot").alias(slot))
        .repartitionByRange(n, "shard", slot).sortWithinPartitions("shard", slot).drop(slot)
        .write.partitionBy("shard").parquet(to)
    )
    return to


def op4_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
