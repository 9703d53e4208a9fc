"""Softmax attention of grouped query heads over a compressed history and recent tokens.

A task goes over its tokens once, batch by batch, and keeps for each query the largest logit, the sum of exponentials
relative to it and the weighted values. These partials, one per task and query, are merged by a small aggregation, so
neither tokens nor logits are shuffled, and a head that holds all tokens is spread over all tasks. Queries come in blocks
(`score.query_blocks`), each one pass over the tokens; a task makes at most `score.ROWS` logits at once.

`session_attention` keeps sessions apart: blocks of a session's queries meet blocks of its tokens (`blocks.block_pairs`), so
neither a session with most of the tokens nor one with most of the queries is one task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, InvalidDim, ShapeMismatch
from ..functions.kernels import Partial, merged, prod_query, scores, value_dequantize
from ..functions.udfs import code_parts, constants, lists, vectors
from ..specs import KvSpec
from .blocks import block_pairs, from_bytes
from .score import BLOCK_KEYS, BLOCK_QUERIES, ROWS, query_blocks

_PARTIAL = "q_token int, q_head int, most double, total double, sums array<double>"


def _check(queries: DataFrame, head_dim: int, num_query_heads: int, num_kv_heads: int) -> None:
    if num_query_heads < 1:
        raise InvalidDim("no query heads")
    if num_query_heads % num_kv_heads:
        raise InvalidArgument(f"{num_query_heads} query heads do not share {num_kv_heads} key heads evenly")
    odd = queries.where((F.size("q") != head_dim) | (F.col("q_head") < 0) | (F.col("q_head") >= num_query_heads))
    if not odd.isEmpty():
        raise ShapeMismatch(f"a query has not {head_dim} elements, or a head that is not 0 to {num_query_heads - 1}")


def _blocks(queries: DataFrame, dim: int):
    """(q_token, q_head, matrix) of each block of queries."""
    import numpy as np

    named = queries.select(F.col("q_token").cast("int"), F.col("q_head").cast("int"), "q")
    for table in query_blocks(named, "q", dim, 4):
        ok, x = vectors(table["q"].combine_chunks(), dim)
        yield (*(np.asarray(table[c].combine_chunks())[ok] for c in ("q_token", "q_head")), x)


def _attend(found: Partial, at, queries: tuple, keys, values, local, scale: float, dim: int) -> None:
    """Adds tokens to the partials at these places: Arrow columns of codes, if local has the constants of both codecs, or of vectors."""
    step = max(1, ROWS // len(at))
    for i in range(0, len(keys), step):
        key, value = keys.slice(i, step), values.slice(i, step)
        if local:
            logits = scores(queries, *code_parts(key, local[0]), local[0])
            found.add(at, logits * scale, value_dequantize(*code_parts(value, local[1]), local[1]))
        else:
            found.add(at, (queries[0] @ vectors(key, dim)[1].T) * scale, vectors(value, dim)[1])


def _partials(tokens: DataFrame, held, shared, per_head: int, scale: float, dim: int) -> DataFrame:
    """Partials of the broadcast queries over tokens (kv_head, key, value), which are codes if held gives the constants of both codecs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        q_token, q_head, *queries = shared.value
        local = held() if held else None
        found = Partial(len(q_token), dim)
        heads = q_head // per_head
        seen = np.zeros(len(q_token), bool)
        for batch in batches:
            for head in np.unique(heads):
                at = np.nonzero(heads == head)[0]
                mine = batch.filter(pc.equal(batch.column(0), int(head)))
                if not mine.num_rows or not len(at):
                    continue
                _attend(found, at, tuple(x[at] for x in queries), mine.column(1), mine.column(2), local, scale, dim)
                seen[at] = True
        if seen.any():
            columns = [pa.array(q_token[seen]), pa.array(q_head[seen]), pa.array(found.most[seen]), pa.array(found.total[seen])]
            yield pa.RecordBatch.from_arrays([*columns, lists(found.sums[seen], "float64")], names=["q_token", "q_head", "most", "total", "sums"])

    return tokens.mapInArrow(run, _PARTIAL)


def _merge(partials: DataFrame) -> DataFrame:
    """(q_token, q_head, most, total, sums) of each query; a group has a row for each task that saw tokens of its head."""

    def one(table):
        import numpy as np
        import pyarrow as pa

        most, total = (table[c].to_numpy() for c in ("most", "total"))
        sums = np.asarray(table["sums"].combine_chunks().flatten()).reshape(len(most), -1)
        total, sums = merged(most, total, sums)
        return pa.table({"q_token": table["q_token"][:1], "q_head": table["q_head"][:1], "most": [most.max()], "total": [total], "sums": [sums.tolist()]})

    return partials.groupBy("q_token", "q_head").applyInArrow(one, _PARTIAL)


def hybrid_attention(queries: DataFrame, store: DataFrame, recent: DataFrame, spec: KvSpec, num_query_heads: int, scale: float = 0.0) -> DataFrame:
    """(q_token, q_head, pos, value) for queries (q_token, q_head, q).

    store holds (kv_head, token_idx) with the code columns key_code and value_code, recent (kv_head, token_idx, key, value).
    A history of fewer than spec.min_history tokens is not attended to, also when there are recent ones. Without any token
    the result is zero. A token with a null vector or code is not attended to.
    """
    _check(queries, spec.head_dim, num_query_heads, spec.num_kv_heads)
    scale = scale if scale > 0 else 1 / math.sqrt(spec.head_dim)
    per_head = num_query_heads // spec.num_kv_heads
    attended = store.select("token_idx").distinct().limit(spec.min_history).count() >= spec.min_history
    key, value = constants(spec.key), constants(spec.value)
    coded = store.where("key_code is not null and value_code is not null").select("kv_head", "key_code", "value_code")
    late = recent.where("key is not null and value is not null").select("kv_head", "key", "value")
    spark, found = queries.sparkSession, None
    for q_token, q_head, x in _blocks(queries, spec.head_dim):
        part = _partials(late, None, spark.sparkContext.broadcast((q_token, q_head, x)), per_head, scale, spec.head_dim)
        if attended:
            asked = spark.sparkContext.broadcast((q_token, q_head, *prod_query(x, spec.key)))
            part = part.unionByName(_partials(coded, lambda: (key(), value()), asked, per_head, scale, spec.head_dim))
        found = part if found is None else found.unionByName(part)
    values = _merge(found).select("q_token", "q_head", F.posexplode(F.transform("sums", lambda v: v / F.col("total"))).alias("pos", "value"))
    places = queries.select("q_token", "q_head", F.explode(F.sequence(F.lit(0), F.lit(spec.head_dim - 1))).alias("pos"))
    return places.join(values, ["q_token", "q_head", "pos"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


_SESSION_PARTIAL = "q_token int, q_head int, old boolean, n long, most double, total double, sums array<double>"


def session_attention(queries: DataFrame, store: DataFrame, recent: DataFrame, spec: KvSpec, num_query_heads: int, scale: float = 0.0) -> DataFrame:
    """(session, q_token, q_head, pos, value) for queries (session, q_token, q_head, q), each over the tokens of its session.

    store holds (session, kv_head, key_code, value_code), as `History.latest` gives it, recent (session, kv_head, key, value).
    A history of fewer than spec.min_history tokens, counted session by session, is not attended to; recent tokens are. A
    session without tokens gives zeros. A token with a null vector or code is not attended to; a null session has no tokens.
    """
    _check(queries, spec.head_dim, num_query_heads, spec.num_kv_heads)
    dim, per_head = spec.head_dim, num_query_heads // spec.num_kv_heads
    scale = scale if scale > 0 else 1 / math.sqrt(dim)
    key, value = constants(spec.key), constants(spec.value)
    asked = queries.select("session", F.col("q_token").cast("int"), F.col("q_head").cast("int"), "q")
    kv_head = F.col("kv_head").cast("int")
    none = F.lit(None).cast("array<float>")
    tokens = store.select("session", kv_head.alias("kv_head"), F.lit(True).alias("old"), "key_code", "value_code", none.alias("key"), none.alias("value"))
    tokens = tokens.unionByName(recent.select("session", kv_head.alias("kv_head"), F.lit(False).alias("old"), "key", "value"), allowMissingColumns=True)
    heads = asked.where("q is not null").withColumn("kv_head", F.floor(F.col("q_head") / per_head).cast("int"))
    pairs = block_pairs(heads, tokens, ["session", "kv_head"], BLOCK_QUERIES, BLOCK_KEYS)
    session = queries.select("session").schema
    names = [x.split()[0] for x in _SESSION_PARTIAL.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        local = (key(), value())
        last = table = asked_now = prepared = None
        parts: dict = {}

        def rows(of):
            for old, (part, n) in parts.items():
                columns = [table["q_token"], table["q_head"], pa.array([old] * len(table)), pa.array([n] * len(table)), part.most, part.total, lists(part.sums, "float64")]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([of.take(pa.array([0] * len(table))), *columns], names=["session", *names])

        of = None
        for batch in batches:
            for i, (left, right) in enumerate(zip(batch.column("left"), batch.column("right"))):
                mine = batch.column("session").slice(i, 1)
                if last is None or not left.equals(last) or not mine.equals(of):
                    if last is not None:
                        yield from rows(of)
                    last, of, parts = left, mine, {}
                    table = from_bytes(left.as_buffer())
                    asked_now = vectors(table["q"].combine_chunks(), dim)[1]
                    prepared = prod_query(asked_now, local[0])
                tokens = from_bytes(right.as_buffer())
                for old in (True, False):
                    some = tokens.filter(pc.equal(tokens["old"], old))
                    if not some.num_rows:
                        continue
                    part, n = parts.get(old) or (Partial(len(table), dim), 0)
                    parts[old] = (part, n + some.num_rows)
                    k, v = (some[c].combine_chunks() for c in (("key_code", "value_code") if old else ("key", "value")))
                    ok = pc.and_(k.is_valid(), v.is_valid())
                    _attend(part, np.arange(len(table)), prepared if old else (asked_now,), k.filter(ok), v.filter(ok), local if old else None, scale, dim)
        if last is not None:
            yield from rows(of)

    partial = f"{session.fields[0].simpleString().replace(':', ' ')}, {_SESSION_PARTIAL}"
    found = pairs.mapInArrow(run, partial)
    # every query has a partial of no tokens, which gives zeros where there are no others
    nothing = [F.lit(False).alias("old"), F.lit(0).cast("long").alias("n"), F.lit(float("-inf")).alias("most"), F.lit(0.0).alias("total")]
    found = found.unionByName(asked.select("session", "q_token", "q_head", *nothing, F.array_repeat(F.lit(0.0), dim).alias("sums")))
    least = spec.min_history

    def one(table):
        import numpy as np
        import pyarrow as pa

        old, n, most, total = (table[c].to_numpy() for c in ("old", "n", "most", "total"))
        sums = np.asarray(table["sums"].combine_chunks().flatten()).reshape(len(most), -1)
        use = (total > 0) & (~old | (n[old].sum() >= least))
        out = np.zeros(dim)
        if use.any():
            total, sums = merged(most[use], total[use], sums[use])
            out = sums / total
        return pa.table({**{c: table[c][:1] for c in ("session", "q_token", "q_head")}, "out": pa.array([out.tolist()])})

    kinds = f"{partial.split(', ')[0]}, q_token int, q_head int, out array<double>"
    whole = found.groupBy("session", "q_token", "q_head").applyInArrow(one, kinds)
    return whole.select("session", "q_token", "q_head", F.posexplode("out").alias("pos", "value"))


def attention_weights(queries: DataFrame, tokens: DataFrame, num_query_heads: int, num_kv_heads: int, head_dim: int, scale: float = 0.0) -> DataFrame:
    """(q_token, q_head, token_idx, weight) over uncompressed tokens (kv_head, token_idx, key).

    Two passes over the tokens: the first finds each query's largest logit and its sum, the second gives the weights.
    """
    _check(queries, head_dim, num_query_heads, num_kv_heads)
    scale = scale if scale > 0 else 1 / math.sqrt(head_dim)
    per_head = num_query_heads // num_kv_heads
    keys = tokens.where("key is not null").select("kv_head", "key", "token_idx")
    spark, out = queries.sparkSession, None

    def logits(shared):
        def run(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            q_token, q_head, x = shared.value
            for batch in batches:
                for head in np.unique(q_head // per_head):
                    at = np.nonzero(q_head // per_head == head)[0]
                    mine = batch.filter(pc.equal(batch.column(0), int(head)))
                    n = mine.num_rows
                    if n:
                        s = (x[at] @ vectors(mine.column(1), head_dim)[1].T) * scale
                        columns = [pa.array(np.repeat(c[at], n)) for c in (q_token, q_head)]
                        columns += [pa.array(np.tile(np.asarray(mine.column(2)), len(at))), pa.array(s.ravel())]
                        yield pa.RecordBatch.from_arrays(columns, names=["q_token", "q_head", "token_idx", "s"])

        return keys.mapInArrow(run, "q_token int, q_head int, token_idx long, s double")

    for q_token, q_head, x in _blocks(queries, head_dim):
        shared = spark.sparkContext.broadcast((q_token, q_head, x))
        whole = _merge(_partials(keys.select("kv_head", "key", F.col("key").alias("value")), None, shared, per_head, scale, head_dim))
        # a row for each query of the block, which is bounded
        weights = logits(shared).join(F.broadcast(whole.select("q_token", "q_head", "most", "total")), ["q_token", "q_head"])
        part = weights.select("q_token", "q_head", "token_idx", (F.exp(F.col("s") - F.col("most")) / F.col("total")).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out
