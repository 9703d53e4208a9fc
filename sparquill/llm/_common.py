"""Helpers shared by the training-data operators: lineage cuts, ranks, words and connected components."""

from __future__ import annotations

import functools
import gc
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and DuckDB spelling of the word separators: space and tab to carriage return.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the session's checkpoint folder. There is no fallback
    to a folder of one machine, which other machines could not read."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


_scopes = threading.local()


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives a lost executor, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sparquill-{uuid.uuid4().hex}"
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    _sweep(spark)
    return out


def _sweep(spark: SparkSession) -> None:
    """Lets shuffle files go that nothing refers to any more, which else may stay for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame) -> None:
    """Deletes what `stash` or `tidy` wrote for df; does nothing to any other DataFrame."""
    if path := getattr(df, "_stashed_at", None):
        _delete(df.sparkSession, path)


def tidy(f):
    """Decorator of a function that returns a DataFrame: the result is stashed, what f stashed on the way is deleted."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        if not hasattr(_scopes, "open"):
            _scopes.open = []
        spark = SparkSession.active()
        mine: list[str] = []
        _scopes.open.append(mine)
        try:
            out = f(*args, **kwargs)
            _scopes.open.pop()
            return stash(out)
        finally:
            if _scopes.open and _scopes.open[-1] is mine:
                _scopes.open.pop()
            out = None
            for path in mine:
                _delete(spark, path)
            _sweep(spark)

    return run


#: Bytes up to which a table is sent to every task.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows take at most `limit` bytes; else as it is, to be joined by a shuffle.

    Counts the bytes in a job over df, so df should be a written table.
    """

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 24
        if isinstance(kind, T.ArrayType):
            return F.greatest(F.size(c), F.lit(0)) * 24 + 24
        return F.lit(8 * len(kind.fields) + 16 if isinstance(kind, T.StructType) else 8)

    row = sum((width(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(32))  # with what hashing adds
    held = df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= limit else df


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def fence(df: DataFrame) -> DataFrame:
    """df, with its columns computed before any filter that stands above.

    The optimizer moves filters below projections by repeating the projected expressions in them; for expressions over
    arrays, repeated once more inside a lambda, that would cost the square of a text's length. A condition on a
    non-deterministic column stays where it is.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id()).where("_fence >= 0").drop("_fence")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """Adds `rank`, gapless from 0 in the given order, without one task that sees all rows.

    A range partitioning sorts the rows; the sorted table is stashed so that its positions stay as they are, and the
    rows of the partitions before it are added to each position. The order must be total over differing rows.
    """
    placed = stash(
        df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism * 4, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    before = _offsets(placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")), "_n")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")  # a row for each partition of the sort
        .withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_before")
    )


def _offsets(counts: DataFrame, n: str) -> DataFrame:
    """For a row per partition: the sum of n over the partitions before it."""
    from pyspark.sql import Window

    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_part", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long").alias("_before"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Labels move along the edges and then jump to the label of their label, so that a chain of n nodes takes about
    log n rounds; each round is written to the shared folder. No edge leaves the executors.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("component")))
    while True:
        told = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("c"))
        )
        moved = labels.join(told, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        to = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = stash(moved.join(to, "component", "left").select("node", F.least("component", "next").alias("component"), "was"))
        if new.where("component != was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
