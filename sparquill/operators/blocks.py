"""All pairs of rows of two tables that agree in some columns, met as blocks on executors.

Rows are packed where they are shuffled to: an Arrow stream of up to so many rows of one group is one binary value. A group of
more than a cell's rows is dealt over several cells; its blocks meet those of the other side in every pair of their cells, so
a group that holds most rows, on either side, is spread over as many tasks as it has pairs of cells. The driver sees the row
counts of the two tables, and nothing of their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group that lie in one cell.
CELL_ROWS = 1 << 18
#: Groups of more than a cell, at most: their table is broadcast.
LARGE_GROUPS = 1 << 16


def to_bytes(table) -> bytes:
    """An Arrow table or batch as one stream."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data):
    """The Arrow table of a stream, one chunk a column."""
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _large(df: DataFrame, by: list[str], cell: int, name: str) -> DataFrame:
    """(by, name) of the groups of more than a cell: the number of their cells. At most LARGE_GROUPS rows."""
    cell = max(cell, -(-df.count() // LARGE_GROUPS))
    counts = df.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > cell)
    return counts.select(*by, F.ceil(F.col("_rows") / cell).cast("int").alias(name))


def _packed(df: DataFrame, by: list[str], rows: int, name: str) -> DataFrame:
    """(by, _own, name): blocks of up to `rows` rows of one group and cell, the columns other than those as an Arrow stream."""
    keys = [*by, "_own"]
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField(name, T.BinaryType())])
    width = len(keys)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, key, size = [], None, 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(i).combine_chunks().slice(0, 1) for i in range(width)]
            data = to_bytes(table.select(range(width, table.num_columns)))
            return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], names=[*table.schema.names[:width], name])

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.unique(np.concatenate([np.asarray(pc.run_end_encode(batch.column(i)).run_ends) for i in range(width)]))
            start = 0
            for end in ends.tolist():
                now = tuple(batch.column(i)[start].as_py() for i in range(width))
                if held and now != key:
                    yield block()
                    held, size = [], 0
                key = now
                while start < end:
                    part = batch.slice(start, min(end - start, rows - size))
                    held.append(part)
                    size, start = size + part.num_rows, start + part.num_rows
                    if size == rows:
                        yield block()
                        held, size = [], 0
        if held:
            yield block()

    data = df.select(*keys, *[c for c in df.columns if c not in keys])
    return data.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def block_pairs(left: DataFrame, right: DataFrame, by: list[str], left_rows: int, right_rows: int, cell: int | None = None) -> DataFrame:
    """(by, left, right): every pair of a block of left and one of right whose rows agree in `by` (null agrees with nothing).

    left and right hold Arrow streams of the columns other than `by`; each pair of rows that agree is in exactly one row of
    the result. An empty `by` pairs everything.
    """
    cell = cell or CELL_ROWS
    if not by:
        by, left, right = ["_all"], left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
    left, right = (x.dropna(subset=by) for x in (left, right))
    cells = {"left": _large(left, by, cell, "_cells"), "right": _large(right, by, cell, "_cells")}

    def side(df: DataFrame, me: str, other: str, rows: int) -> DataFrame:
        n = F.coalesce("_cells", F.lit(1))
        # which cell a row lies in is of no matter, so its place in its partition decides
        dealt = df.join(F.broadcast(cells[me]), by, "left").withColumn("_own", F.pmod(F.monotonically_increasing_id(), n).cast("int")).drop("_cells")
        packed = _packed(dealt, by, rows, me).withColumnRenamed("_own", f"_{me}")
        met = packed.join(F.broadcast(cells[other]), by, "left")
        return met.select(*by, f"_{me}", F.explode(F.sequence(F.lit(0), n - 1)).alias(f"_{other}"), me)

    a, b = side(left, "left", "right", left_rows), side(right, "right", "left", right_rows)
    return a.join(b, [*by, "_left", "_right"]).select(*[c for c in by if c != "_all"], "left", "right")
