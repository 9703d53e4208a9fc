"""Softmax attention as two SQL aggregates over uncompressed tokens.

    select session, head, attention_merge(part) as out from (
      select session, head, attention_part(q, key, value, scale) as part from tokens group by session, head, token_idx div 4096)
    group by session, head

The inner one gives the partial of a bounded group of tokens, the outer one merges partials, so a session with most of the
tokens is spread over as many groups as it has thousands of tokens. A partial is the array (largest logit, sum of exponentials,
weighted values).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .kernels import Partial, merged
from .udfs import vectors

#: Logits that are made at once.
ROWS = 1 << 16


def part_of(q, key, value, scale) -> list[float] | None:
    """Partial of the tokens of one query: a vector column q, the same in every row, keys, values and the factor of the logits.
    Tokens with a null key or value are left out; without any the partial is that of no token; a null query has none."""
    if not q[0].is_valid:
        return None
    dim = len(q[0])
    query = np.asarray(q[0].values, np.float64)[None, :]
    ok = np.asarray(key.is_valid()) & np.asarray(value.is_valid())
    key, value = key.filter(pa.array(ok)), value.filter(pa.array(ok))
    found, at = Partial(1, dim), np.zeros(1, np.int64)
    for i in range(0, len(key), ROWS):
        logits = query @ vectors(key.slice(i, ROWS), dim)[1].T
        found.add(at, logits * scale[0].as_py(), vectors(value.slice(i, ROWS), dim)[1])
    return [float(found.most[0]), float(found.total[0]), *found.sums[0].tolist()]


def merge_of(parts) -> list[float] | None:
    """Attention of the partials of one query: their weighted values over their sum, zeros if none has a token."""
    parts = parts.drop_null()
    if not len(parts):
        return None
    m = np.asarray(parts.flatten(), np.float64).reshape(len(parts), -1)
    m_used = m[m[:, 1] > 0]
    if not len(m_used):
        return [0.0] * (m.shape[1] - 2)
    total, sums = merged(m_used[:, 0], m_used[:, 1], m_used[:, 2:])
    return (sums / total).tolist()


def _aggregates() -> dict[str, Callable]:
    def attention_part(q: pa.Array, key: pa.Array, value: pa.Array, scale: pa.Array) -> pa.Scalar:
        return pa.scalar(part_of(q, key, value, scale), pa.list_(pa.float64()))

    def attention_merge(parts: pa.Array) -> pa.Scalar:
        return pa.scalar(merge_of(parts), pa.list_(pa.float64()))

    for f in (attention_part, attention_merge):  # the hints are what makes them aggregates
        f.__annotations__ = {k: {"pa.Array": pa.Array, "pa.Scalar": pa.Scalar}[v] for k, v in f.__annotations__.items()}
    return {f.__name__: F.arrow_udf(f, "array<double>") for f in (attention_part, attention_merge)}


def register_aggregates(spark: SparkSession) -> list[str]:
    """Registers attention_part and attention_merge for SQL."""
    named = _aggregates()
    for name, f in named.items():
        spark.udf.register(name, f)
    return list(named)
