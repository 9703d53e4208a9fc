"""Inner products estimated on the codes. Queries are rotated and sketched once; keys are never rotated back.

Queries of up to BLOCK_BYTES travel to every task, one pass over the keys, which are dealt over tasks by the scores to make.
More of them, and queries that only meet the keys of their own group, are met in blocks on executors (`blocks.block_pairs`): the
driver then sees no query, a task holds one block of either side, and only pairs that are asked for are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import prod_query, scores
from ..functions.udfs import code_parts, constants, vectors
from ..specs import ProdSpec
from .blocks import block_pairs, from_bytes, to_bytes

#: Bytes of query vectors (as doubles, rotated and sketched) that travel to every task at once.
BLOCK_BYTES = 32 << 20
#: Score rows that a task makes at once.
ROWS = 1 << 16
#: Scores of a task in all, where queries travel to every task; with `top`, which leaves a task few rows, more of them.
TASK_ROWS, TOP_ROWS = 1 << 22, 1 << 26
#: Queries and keys of a block.
BLOCK_QUERIES, BLOCK_KEYS = 512, 4096


def query_blocks(queries: DataFrame, q: str, dim: int, width: int = 2) -> Iterator:
    """Arrow tables of the queries, each of about BLOCK_BYTES at most; width: doubles kept per element of a vector."""
    n = queries.count()
    blocks = max(1, -(-n * dim * 8 * width // BLOCK_BYTES))
    if blocks == 1:
        yield queries.toArrow()
        return
    named = [c for c in queries.columns if c != q]
    part = F.pmod(F.xxhash64(*named), F.lit(2 * blocks))  # twice the blocks, so that uneven ones stay below the bound
    for b in range(2 * blocks):
        yield queries.where(part == b).toArrow()


def _query_parts(table, q: str, dim: int):
    """(Arrow table without the vectors, matrix of the vectors); a null vector is no query."""
    import pyarrow as pa

    column = table[q].combine_chunks()
    ok, x = vectors(column, dim)
    return table.drop_columns([q]).filter(pa.array(ok)).combine_chunks(), x


def attention_score(
    queries: DataFrame, keys: DataFrame, spec: ProdSpec, q: str = "q", code: str = "code", group: str | None = None, top: int | None = None, slack: float = 0.0, exact: str | None = None
) -> DataFrame:
    """The rows of queries x keys (within a group, if a column of both is named) with their score.

    keys hold a code column made by `encode` for a ProdSpec, queries a vector column q; the other columns are kept. A null
    vector, code or group has no scores. With `top`, only the `top` best keys of what a task sees at once are given for each
    query, and those that are worse than them by up to `slack`, for a rank by rounded scores. `exact` names the keys' own vectors:
    they are no column of the result, but the inner product with them is, as "exact"; a key without one has no scores.
    """
    named = [f for f in queries.schema.fields if f.name not in (q, group)]
    if exact:
        keys = keys.dropna(subset=[exact])
    kept, own = [f for f in keys.schema.fields if f.name not in (code, exact)], [exact] if exact else []
    schema = T.StructType([*kept, *named, *[T.StructField(c, T.DoubleType()) for c in ("score", *(["exact"] if exact else []))]])
    queries, keys = queries.select(*[f.name for f in named], q, *([group] if group else [])), keys.select(code, *own, *[f.name for f in kept])
    held, by = constants(spec), [group] if group else []
    limit = BLOCK_BYTES // (2 * 8 * spec.dim)
    if not group and queries.limit(limit + 1).count() <= limit:
        table, x = _query_parts(queries.toArrow(), q, spec.dim)
        keys = _dealt(keys, table.num_rows, TASK_ROWS if top is None else TOP_ROWS)
        shared = keys.sparkSession.sparkContext.broadcast((to_bytes(table), *prod_query(x, spec), *([x] if exact else [])))

        def blocks(batches):
            sink, *prepared = shared.value
            names = from_bytes(sink)
            for batch in batches:
                yield names, prepared, batch

        return keys.mapInArrow(_scores(blocks, held, [f.name for f in kept], top, slack, exact), schema)

    def blocks(batches):
        import pyarrow as pa

        local, last, asked = held(), None, None
        for batch in batches:
            groups = [batch.column(c) for c in by]
            for i, (left, right) in enumerate(zip(batch.column("left"), batch.column("right"))):
                if last is None or not left.equals(last):
                    table, x = _query_parts(from_bytes(left.as_buffer()), q, local.dim)
                    last, asked = left, (table, (*prod_query(x, local), *([x] if exact else [])))
                key = from_bytes(right.as_buffer())
                for c, values in zip(by, groups):  # the group is no part of the block
                    key = key.append_column(c, values.take(pa.array([i] * key.num_rows)))
                for part in key.to_batches():
                    yield *asked, part

    pairs = block_pairs(queries, keys, by, BLOCK_QUERIES, BLOCK_KEYS)
    return pairs.mapInArrow(_scores(blocks, held, [f.name for f in kept], top, slack, exact), schema)


def _dealt(keys: DataFrame, n_queries: int, most: int) -> DataFrame:
    """keys over so many tasks that each makes about `most` scores: a file that one task reads may hold all of them."""
    tasks = -(-keys.count() * n_queries // most)
    return keys.repartition(tasks) if tasks > 1 else keys


def _scores(blocks, constants, kept: list[str], top: int | None, slack: float, exact: str | None):
    """Rows of scores of (names of queries, prepared queries, batch of keys), ROWS at a time. Rows come key by key, so that a file
    of them says each key once and the queries as one repeated sequence."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        local = constants()
        best: list = []
        seen = None
        for names, prepared, whole in blocks(batches):
            n_queries = len(prepared[0])
            if seen is not names and best:
                yield _kept(best, top, slack)[2]
                best = []
            seen = names
            valid = whole.filter(whole.column(0).is_valid())
            step = max(1, ROWS // max(1, n_queries))
            for at in range(0, valid.num_rows if n_queries else 0, step):
                batch = valid.slice(at, step)
                found = scores(prepared[:2], *code_parts(batch.column(0), local), local)
                keep = np.ones(found.shape, bool)
                if top is not None and found.shape[1] > top:
                    keep = found >= -np.partition(-found, top - 1, axis=1)[:, top - 1 : top] - slack  # ties stay, the final rank decides
                at_k, at_q = np.nonzero(keep.T)
                columns = [batch.column(c).take(pa.array(at_k)) for c in kept]
                columns += [names.column(i).combine_chunks().take(pa.array(at_q)) for i in range(names.num_columns)]
                score = found[at_q, at_k]
                columns.append(pa.array(score))
                if exact:
                    columns.append(pa.array((prepared[2] @ vectors(batch.column(exact), local.dim)[1].T)[at_q, at_k]))
                out = pa.RecordBatch.from_arrays(columns, names=[*kept, *names.schema.names, "score", *(["exact"] if exact else [])])
                if top is None:
                    yield out
                else:
                    best.append((at_q, score, out))
                    if sum(len(a) for a, _, _ in best) > 8 * ROWS + 4 * top * n_queries:
                        best = [_kept(best, top, slack)]
        if best:
            yield _kept(best, top, slack)[2]

    return run


def _kept(best: list, top: int, slack: float):
    """The rows among the `top` best of their query, ties and what is worse by up to slack included."""
    import numpy as np
    import pyarrow as pa

    at_q, score = np.concatenate([a for a, _, _ in best]), np.concatenate([s for _, s, _ in best])
    rows = pa.Table.from_batches([r for _, _, r in best]).combine_chunks().to_batches()
    order = np.lexsort((-score, at_q))
    first = np.searchsorted(at_q[order], at_q[order], "left")
    last = np.minimum(first + top - 1, np.searchsorted(at_q[order], at_q[order], "right") - 1)
    keep = np.sort(order[score[order] >= score[order][last] - slack])
    return at_q[keep], score[keep], rows[0].take(pa.array(keep))


def top_k(scored: DataFrame, k: int, by: str = "q_id", key: str = "k_id") -> DataFrame:
    """The k best keys of each query; ties go to the smaller key. Partial limits run before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
